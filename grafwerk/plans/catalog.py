"""One query per operator of the graph engine, over the derived graphs, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics, health, resolve, search, traverse
from ..schema import MOST_CANDIDATES
from .derived import SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None, graph: bool = True, recursive: bool = False):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            lead = f"WITH {'RECURSIVE ' if recursive else ''}{SQL}"
            ORACLE_SQL[name] = sql if not graph else lead + (", " + sql if " AS (" in sql.split("SELECT")[0] or " AS MATERIALIZED (" in sql.split("SELECT")[0] else sql)
        return f

    return add


n = lambda: F.count(F.lit(1)).alias("n")
long = lambda c: F.col(c).cast("long").alias(c)


def _ids(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "id string")


# ---- sources -----------------------------------------------------------------


@_query("src_duplicate_texts", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1", graph=False)
def _(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1")


_SNAPSHOTS = """a AS (SELECT doc_id % 1000 AS k, CAST(doc_id AS VARCHAR) AS path, n_chars AS size, doc_id AS m FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size, doc_id AS m FROM documents WHERE doc_id % 11 <> 0)"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two states of a folder: without every 7th, and without every 11th file and with every 5th changed."""
    d = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("path"), "n_chars", F.col("doc_id").alias("mtime_ns"))
    old = d.filter("doc_id % 7 <> 0").select("path", F.col("n_chars").alias("size"), "mtime_ns")
    new = d.filter("doc_id % 11 <> 0").select("path", (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size"), "mtime_ns")
    return old, new


@_query("src_drift", f"WITH {_SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size", graph=False)
def _(t):
    return health.drift(*_snapshots(t))


@_query("src_language_of_path", "SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' END AS language, regexp_replace(replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '.'), '\\.__init__$', '') AS module, count(*) AS symbols FROM sym GROUP BY ALL")
def _(t):
    from ..sources.repository import language_of, module_of

    return t.symbols().groupBy("path").agg(F.count(F.lit(1)).alias("symbols")).select("path", language_of(F.col("path")).alias("language"), module_of(F.col("path")).alias("module"), "symbols")


@_query("src_scope_filter", "SELECT symbol_id, path FROM sym WHERE path LIKE 'nations/%' AND NOT (path LIKE 'nations/A%')")
def _(t):
    from ..sources.repository import ignored, in_scope

    return t.symbols().filter(in_scope(F.col("path"), ["nations"]) & ~ignored(F.col("path"), ["nations/A*"])).select("symbol_id", "path")


@_query("src_change_set", """WITH a AS (SELECT doc_id, sha256(text) AS s FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE sha256(text) END AS s FROM documents WHERE doc_id % 11 <> 0)
SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS symbol_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'signature_changed' END AS change FROM a FULL JOIN b USING (doc_id) WHERE a.s IS DISTINCT FROM b.s""", graph=False)
def _(t):
    d = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("symbol_id"), F.sha2("text", 256).alias("signature"))
    new = d.filter("doc_id % 11 <> 0").withColumn("signature", F.when(F.col("doc_id") % 5 == 0, "new").otherwise(F.col("signature")))
    return health.changes(d.filter("doc_id % 7 <> 0"), new)


# ---- filters and joins -------------------------------------------------------


@_query("flt_min_confidence", "SELECT src, dst_name, conf FROM edge WHERE kind = 'calls' AND conf >= 1")
def _(t):
    return t.edges().filter("kind = 'calls' AND conf >= 1").select("src", "dst_name", "conf")


@_query("flt_test_paths", "SELECT path, count(*) AS n FROM sym WHERE path LIKE 'tests/%' GROUP BY path")
def _(t):
    return t.symbols().filter(traverse.is_test_path(F.col("path"))).groupBy("path").agg(n())


@_query("flt_dangling_by_name", "SELECT dst_name, src, line FROM edge WHERE dst IS NULL AND (dst_name = 'P7' OR ends_with(dst_name, '7'))")
def _(t):
    return t.edges().filter(F.col("dst").isNull() & ((F.col("dst_name") == "P7") | F.col("dst_name").endswith("7"))).select("dst_name", "src", "line")


@_query("join_references", "SELECT e.src, s.fqn AS src_fqn, s.path, e.kind, e.line FROM edge e LEFT JOIN sym s ON s.symbol_id = e.src WHERE e.dst_name LIKE 'S1%'")
def _(t):
    e = t.edges().filter(F.col("dst_name").startswith("S1"))
    s = t.symbols().select(F.col("symbol_id").alias("src"), F.col("fqn").alias("src_fqn"), "path")
    return e.join(s, "src", "left").select("src", "src_fqn", "path", "kind", "line")


@_query("join_callees_outer", "SELECT e.src, e.dst_name, s.fqn AS dst_fqn, e.line FROM edge e LEFT JOIN sym s ON s.symbol_id = e.dst WHERE e.kind = 'calls' AND e.src LIKE 'S%'")
def _(t):
    s = t.symbols().select(F.col("symbol_id").alias("dst"), F.col("fqn").alias("dst_fqn"))
    return t.edges().filter(F.col("src").startswith("S") & (F.col("kind") == "calls")).join(s, "dst", "left").select("src", "dst_name", "dst_fqn", "line")


@_query("join_both_ends", "SELECT a.kind AS src_kind, b.kind AS dst_kind, e.kind, count(*) AS n FROM edge e JOIN sym a ON a.symbol_id = e.src JOIN sym b ON b.symbol_id = e.dst GROUP BY ALL")
def _(t):
    pairs = t.edges().filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst", "kind").agg(n())
    end = lambda c, k: t.symbols().select(F.col("symbol_id").alias(c), F.col("kind").alias(k))
    return pairs.join(end("src", "src_kind"), "src").join(end("dst", "dst_kind"), "dst").groupBy("src_kind", "dst_kind", "kind").agg(F.sum("n").alias("n"))


@_query("join_semi_frontier", "SELECT count(*) AS n FROM edge WHERE dst IN (SELECT symbol_id FROM sym WHERE path LIKE 'nations/A%')")
def _(t):
    return t.edges().join(t.symbols().filter(F.col("path").startswith("nations/A")).select(F.col("symbol_id").alias("dst")), "dst", "left_semi").agg(n())


@_query("join_containment", """SELECT point_id, span_id FROM (SELECT p.o_orderkey AS point_id, s.span_id, row_number() OVER (PARTITION BY p.o_orderkey ORDER BY s.b - s.a, s.a, s.span_id) AS k
 FROM (SELECT o_orderkey, o_custkey % 50 AS path, o_orderkey % 1000 AS line FROM orders) p
 JOIN (SELECT p_partkey AS span_id, p_partkey % 50 AS path, p_partkey % 700 AS a, p_partkey % 700 + p_size * 5 AS b FROM part WHERE p_partkey <= 5000) s ON p.path = s.path AND s.a <= p.line AND p.line <= s.b) WHERE k = 1""", graph=False)
def _(t):
    points = t.orders.select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 50).alias("path"), (F.col("o_orderkey") % 1000).alias("line"))
    spans = t.part.filter("p_partkey <= 5000").select(F.col("p_partkey").alias("span_id"), (F.col("p_partkey") % 50).alias("path"), (F.col("p_partkey") % 700).alias("start_line"), (F.col("p_partkey") % 700 + F.col("p_size") * 5).alias("end_line"))
    return resolve.smallest_container(points, spans)


@_query("join_best_confidence", "SELECT src, line, arg_max(dst, conf * 1000000 - CAST(substr(dst, 2) AS BIGINT)) AS dst FROM edge WHERE kind = 'calls' AND dst IS NOT NULL GROUP BY src, line")
def _(t):
    e = t.edges().filter("kind = 'calls' AND dst IS NOT NULL")
    return e.groupBy("src", "line").agg(F.max_by("dst", F.col("conf").cast("long") * 1000000 - F.substring("dst", 2, 20).cast("long")).alias("dst"))


@_query("join_orphans", "SELECT symbol_id FROM sym WHERE symbol_id NOT IN (SELECT src FROM edge UNION SELECT dst FROM edge WHERE dst IS NOT NULL)")
def _(t):
    met = t.edges().select(F.explode(F.array("src", "dst")).alias("symbol_id"))
    return t.symbols().select("symbol_id").join(met, "symbol_id", "left_anti")


@_query("join_file_statistics", """r AS (SELECT dst, count(*) AS d FROM edge WHERE dst IS NOT NULL GROUP BY dst)
SELECT path, max(coalesce(d, 0)) AS top, CAST(sum(coalesce(d, 0)) AS BIGINT) AS total, count(*) AS symbols FROM sym LEFT JOIN r ON dst = symbol_id GROUP BY path""")
def _(t):
    r = t.edges().filter("dst IS NOT NULL").groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("d"))
    return t.symbols().join(r, "symbol_id", "left").groupBy("path").agg(F.max(F.coalesce("d", F.lit(0))).alias("top"), F.sum(F.coalesce("d", F.lit(0))).alias("total"), F.count(F.lit(1)).alias("symbols"))


# ---- resolution: parts by brand and name are homonyms ------------------------

_NAMES = """ref AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, replace(p_name, ' ', '_') AS g, p_brand AS path FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49),
cand AS (SELECT ref_id, p_partkey AS sid, ref.path = part.p_brand AS same FROM ref JOIN part ON replace(p_name, ' ', '_') = g AND p_size <= 3),
cnt AS (SELECT ref_id, count(*) AS k, sum(same::INT) AS s, min(sid) AS low FROM cand GROUP BY ref_id HAVING count(*) <= 5),
dec AS (SELECT cand.ref_id, sid, CASE WHEN k = 1 OR (s = 1 AND same) THEN 1 ELSE 0 END AS conf, k = 1 OR (s = 1 AND same) OR sid = low AS first FROM cand JOIN cnt USING (ref_id) WHERE k = 1 OR (s = 1 AND same) OR s <> 1)"""


def _homonyms(t: Tables) -> tuple[DataFrame, DataFrame]:
    name = F.regexp_replace("p_name", " ", "_")
    refs = t.lineitem.filter("l_quantity >= 49").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), "l_partkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    refs = refs.select("ref_id", F.lit("calls").alias("kind"), name.alias("dst_name"), F.col("p_brand").alias("path"), F.lit("python").alias("language"))
    symbols = t.part.filter("p_size <= 3").select(F.col("p_partkey").alias("symbol_id"), F.lit("function").alias("kind"), name.alias("name"), F.concat(F.lit("m"), F.col("p_partkey"), F.lit("."), name).alias("fqn"), F.col("p_brand").alias("path"), F.lit("python").alias("language"))
    return refs, symbols


@_query("res_candidates", f"WITH {_NAMES} SELECT ref_id, sid AS symbol_id, same AS same_file FROM cand", graph=False)
def _(t):
    return resolve.candidates(*_homonyms(t))


@_query("res_decide", f"WITH {_NAMES} SELECT ref_id, sid AS dst, CAST(conf AS INTEGER) AS conf, first FROM dec", graph=False)
def _(t):
    return resolve.decide(resolve.candidates(*_homonyms(t), MOST_CANDIDATES))


@_query("res_invalidate", "SELECT kind, src, CASE WHEN dst LIKE 'P1%' THEN NULL ELSE dst END AS dst, dst_name, line, CASE WHEN dst LIKE 'P1%' THEN 0 ELSE conf END AS conf, 'l0' AS resolver FROM (SELECT DISTINCT * FROM edge WHERE kind = 'calls' AND src LIKE 'S%')")
def _(t):
    e = t.edges().filter("kind = 'calls' AND src LIKE 'S%'").distinct().withColumns({"path": F.lit("x"), "col": F.lit(0)})
    gone = t.part.select(F.concat(F.lit("P"), F.col("p_partkey")).alias("symbol_id")).filter("symbol_id LIKE 'P1%'")
    return resolve.invalidate(e, gone).drop("path", "col")


@_query("res_promote", "SELECT src, CASE WHEN line % 3 = 0 THEN 'P1' ELSE dst END AS dst, line, CASE WHEN line % 3 = 0 THEN 2 ELSE conf END AS conf, CASE WHEN line % 3 = 0 THEN 'l1' ELSE 'l0' END AS resolver FROM (SELECT DISTINCT * FROM edge WHERE kind = 'calls' AND src LIKE 'S%')")
def _(t):
    e = t.edges().filter("kind = 'calls' AND src LIKE 'S%'").withColumns({"path": F.col("src"), "col": F.substring("dst_name", 2, 20).cast("int")}).distinct()
    return resolve.promote(e, e.filter("line % 3 = 0").select("path", "line", "col", F.lit("P1").alias("dst"))).select("src", "dst", "line", "conf", "resolver")


# ---- aggregates --------------------------------------------------------------


@_query("agg_totals", "SELECT (SELECT count(DISTINCT path) FROM sym) AS files, (SELECT count(*) FROM sym) AS symbols, count(*) AS edges, count(dst) AS resolved, count(*) - count(dst) AS dangling FROM edge")
def _(t):
    return health.totals(t.symbols(), t.edges())


@_query("agg_by_language", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang", graph=False)
def _(t):
    return t.documents.groupBy("lang").agg(n(), F.sum("n_chars").alias("chars"))


@_query("agg_by_confidence", "SELECT CASE conf WHEN 2 THEN 'certain' WHEN 1 THEN 'inferred' ELSE 'possible' END AS confidence, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM edge WHERE kind = 'calls' GROUP BY conf")
def _(t):
    return health.by_confidence(t.edges())


@_query("agg_degree", """ends AS (SELECT src AS id, kind, false AS into_ FROM edge UNION ALL SELECT dst, kind, true FROM edge WHERE dst IS NOT NULL)
SELECT id, count(*) FILTER (kind = 'calls' AND into_) AS callers, count(*) FILTER (kind = 'calls' AND NOT into_) AS callees, count(*) FILTER (into_) AS refs FROM ends GROUP BY id""")
def _(t):
    return health.degree_counts(t.edges())


@_query("agg_unresolved", "SELECT dst_name AS name, count(*) FILTER (conf = 0 AND dst IS NOT NULL) AS possible, count(*) FILTER (dst IS NULL) AS dangling FROM edge WHERE conf = 0 OR dst IS NULL GROUP BY dst_name")
def _(t):
    return health.unresolved(t.edges())


@_query("agg_file_pairs", "SELECT least(a.path, b.path) AS a, greatest(a.path, b.path) AS b, count(*) AS weight, CAST(max(conf) AS BIGINT) AS conf FROM edge JOIN sym a ON a.symbol_id = src JOIN sym b ON b.symbol_id = dst WHERE a.path <> b.path GROUP BY 1, 2")
def _(t):
    return health.file_pairs(t.edges(), t.symbols())


@_query("agg_symbol_pairs", "SELECT src, dst, kind, count(*) AS n, CAST(max(conf) AS BIGINT) AS conf FROM edge WHERE dst IS NOT NULL GROUP BY ALL")
def _(t):
    return t.edges().filter("dst IS NOT NULL").groupBy("src", "dst", "kind").agg(n(), F.max("conf").cast("long").alias("conf"))


@_query("agg_external_names", "SELECT dst_name, count(*) AS n FROM edge WHERE dst IS NULL GROUP BY dst_name")
def _(t):
    return t.edges().filter("dst IS NULL").groupBy("dst_name").agg(n())


@_query("agg_aggregate_label", "SELECT src, CASE WHEN min(conf) = max(conf) THEN CASE min(conf) WHEN 2 THEN 'certain' WHEN 1 THEN 'inferred' ELSE 'possible' END ELSE 'mixed' END AS label FROM edge WHERE kind = 'calls' GROUP BY src")
def _(t):
    from ..schema import confidence_name

    g = t.edges().filter("kind = 'calls'").groupBy("src").agg(F.min("conf").alias("lo"), F.max("conf").alias("hi"))
    return g.select("src", F.when(F.col("lo") == F.col("hi"), confidence_name(F.col("lo"))).otherwise("mixed").alias("label"))


@_query("agg_confusion", """WITH c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM (SELECT n_chars >= 400 AS p, quality = 1 AS a FROM labels JOIN documents USING (doc_id)))
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1, round(tp / (tp + fn) - fp / (fp + tn), 6) AS score FROM c""", graph=False)
def _(t):
    return health.confusion(t.labels.join(t.documents, "doc_id"), F.col("n_chars") >= 400, F.col("quality") == 1)


@_query("agg_agreement", """WITH x AS (SELECT DISTINCT source, lang, n_chars % 97 AS k FROM documents WHERE doc_id % 2 = 0), y AS (SELECT DISTINCT source, lang, n_chars % 97 AS k FROM documents WHERE doc_id % 3 = 0),
z AS (SELECT count(*) FILTER (x.source IS NOT NULL AND y.source IS NOT NULL) AS in_both, count(*) FILTER (y.source IS NULL) AS only_a, count(*) FILTER (x.source IS NULL) AS only_b FROM x FULL JOIN y ON x.source = y.source AND x.lang = y.lang AND x.k = y.k)
SELECT in_both, only_a, only_b, round(in_both / (in_both + only_a + only_b), 6) AS jaccard FROM z""", graph=False)
def _(t):
    d = t.documents.select("doc_id", "source", "lang", (F.col("n_chars") % 97).alias("k"))
    return health.agreement(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0"), ["source", "lang", "k"])


@_query("agg_conversation_turns", "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id", graph=False)
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.sum(F.length("text")).alias("chars"))


# ---- windows, sorts ----------------------------------------------------------

_IN = "deg AS (SELECT symbol_id, path, fqn, (SELECT count(*) FROM edge WHERE dst = symbol_id) AS d FROM sym)"


def _in_degree(t: Tables) -> DataFrame:
    d = t.edges().filter("dst IS NOT NULL").groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("d"))
    return t.symbols().join(d, "symbol_id", "left").withColumn("d", F.coalesce("d", F.lit(0)))


@_query("win_top_symbols_of_file", f"{_IN} SELECT path, fqn, symbol_id, d, k FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY d DESC, fqn, symbol_id) AS k FROM deg) WHERE k <= 6")
def _(t):
    w = Window.partitionBy("path").orderBy(F.desc("d"), "fqn", "symbol_id")
    return _in_degree(t).withColumn("k", F.row_number().over(w)).filter("k <= 6").select("path", "fqn", "symbol_id", "d", long("k"))


@_query("win_overload_ordinals", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_size, p_partkey) - 1 AS ordinal FROM part", graph=False)
def _(t):
    p = t.part.select("p_partkey", F.col("p_brand").alias("path"), F.col("p_name").alias("fqn"), F.lit("function").alias("kind"), F.col("p_size").alias("start_line"), F.col("p_partkey").alias("start_col"))
    return resolve.overload_ordinals(p).select("p_partkey", long("ordinal"))


@_query("win_overview_budget", f"""{_IN}, f AS (SELECT path, CAST(sum(d) AS BIGINT) AS score, CAST(length(path) + sum(length(fqn) + 12) AS BIGINT) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY d DESC, fqn, symbol_id) AS k FROM deg) WHERE k <= 6 GROUP BY path),
u AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS place, CAST(sum(cost) OVER (ORDER BY score DESC, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM f) SELECT * FROM u WHERE place = 1 OR used <= 4800""")
def _(t):
    w = Window.partitionBy("path").orderBy(F.desc("d"), "fqn", "symbol_id")
    top = _in_degree(t).withColumn("k", F.row_number().over(w)).filter("k <= 6")
    files = top.groupBy("path").agg(F.sum("d").alias("score"), (F.length(F.first("path")) + F.sum(F.length("fqn") + 12)).cast("long").alias("cost"))
    return search.overview(files, 4800)


@_query("srt_references_page", "SELECT dst_name, line, src FROM edge WHERE kind = 'calls' ORDER BY dst_name, line, src LIMIT 60")
def _(t):
    return t.edges().filter("kind = 'calls'").orderBy("dst_name", "line", "src").limit(60).select("dst_name", "line", "src")


@_query("srt_most_connected_files", "SELECT path, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT a.path AS p, b.path AS q, count(*) AS w FROM edge JOIN sym a ON a.symbol_id = src JOIN sym b ON b.symbol_id = dst WHERE a.path <> b.path GROUP BY ALL), LATERAL (SELECT unnest([p, q]) AS path) GROUP BY path ORDER BY degree DESC, path LIMIT 10")
def _(t):
    return health.file_pairs(t.edges(), t.symbols()).select(F.explode(F.array("a", "b")).alias("path"), "weight").groupBy("path").agg(F.sum("weight").alias("degree")).orderBy(F.desc("degree"), "path").limit(10)


# ---- search ------------------------------------------------------------------

_TIER = """t AS (SELECT symbol_id, kind, name, fqn, size AS rank, CASE WHEN fqn = '{q}' THEN 1 WHEN ends_with(fqn, '.{q}') THEN 2 WHEN name = '{q}' THEN 3
 WHEN len(list_filter({tokens}, lambda x: NOT list_contains(regexp_extract_all(lower(name || ' ' || fqn), '[a-z0-9]+'), x))) = 0 THEN 4 WHEN contains(lower(name), lower('{q}')) THEN 5 END AS tier FROM sym)"""


def _ranked(t: Tables) -> DataFrame:
    return t.symbols().withColumn("rank", F.col("size").cast("double"))


@_query("sea_tiers", _TIER.format(q="red", tokens="['red']") + " SELECT symbol_id, kind, fqn, CAST(tier AS BIGINT) AS tier FROM t WHERE tier IS NOT NULL ORDER BY tier, rank DESC, fqn, symbol_id LIMIT 25")
def _(t):
    return search.find(_ranked(t), "red", limit=25, code_floor=False).select("symbol_id", "kind", "fqn", "tier")


@_query("sea_find_kind", _TIER.format(q="Customer#000000001", tokens="['customer', '000000001']") + " SELECT symbol_id, fqn, CAST(tier AS BIGINT) AS tier FROM t WHERE tier IS NOT NULL AND kind = 'method' ORDER BY tier, rank DESC, fqn, symbol_id LIMIT 10")
def _(t):
    return search.find(_ranked(t), "Customer#000000001", kind="method").select("symbol_id", "fqn", "tier")


@_query("sea_suggest_files", """w AS (SELECT unnest(['red', 'blue', 'steel']) AS word) SELECT path, round(sum(size + 1.0), 6) AS score, string_agg(DISTINCT word, ',' ORDER BY word) AS reasons FROM sym JOIN w ON contains(lower(name), word) GROUP BY path ORDER BY score DESC, path LIMIT 8""")
def _(t):
    return search.suggest_files(_ranked(t), "red blue of steel")


@_query("sea_grep", r"SELECT doc_id, CAST(k AS BIGINT) AS line_number, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE regexp_matches(line, '(?i)license|copyright')", graph=False)
def _(t):
    return search.grep(t.documents, "(?i)license|copyright")


@_query("sea_all_tokens", "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'of')", graph=False)
def _(t):
    return search.with_all_tokens(t.documents, ["the", "of"])


# ---- traversals --------------------------------------------------------------


def _impact_sql(edges: str, seed: str, depth: int, kinds: str = "('calls', 'imports', 'inherits', 'references')") -> str:
    return f"""e AS (SELECT src, dst, kind, conf FROM {edges} WHERE src IS NOT NULL AND dst IS NOT NULL AND kind IN {kinds}),
r(id, depth, conf) AS (SELECT id, 0, 2 FROM ({seed}) UNION SELECT e.src, r.depth + 1, least(r.conf, e.conf) FROM r JOIN e ON e.dst = r.id WHERE r.depth < {depth}),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id),
c AS (SELECT r.id, r.depth, max(r.conf) AS conf FROM r JOIN m ON m.id = r.id AND m.depth = r.depth GROUP BY ALL),
v AS (SELECT c.id, c.depth, arg_min(e.kind, (-least(e.conf, p.conf), e.kind)) AS via FROM c JOIN e ON e.src = c.id JOIN c p ON p.id = e.dst AND p.depth = c.depth - 1 GROUP BY ALL)
SELECT c.id, CAST(c.depth AS BIGINT) AS depth, CAST(c.conf AS BIGINT) AS conf, v.via FROM c JOIN v ON v.id = c.id AND v.depth = c.depth WHERE c.depth > 0"""


@_query("trv_impact", _impact_sql("edge", "SELECT 'R0' AS id", 3), recursive=True)
def _(t):
    return traverse.impact(t.edges(), _ids(t, "R0"))


@_query("trv_impact_cyclic", _impact_sql("sess", "SELECT min(src) AS id FROM sess", 3), recursive=True)
def _(t):
    e = t.session_edges()
    return traverse.impact(e, e.agg(F.min("src").alias("id")))


@_query("trv_impact_chain", _impact_sql("chain", "SELECT min(dst) AS id FROM chain", 6), recursive=True)
def _(t):
    e = t.chain_edges()
    return traverse.impact(e, e.agg(F.min("dst").alias("id")), depth=6)


def _walk_sql(forward: bool, seed: str, depth: int) -> str:
    near, far = ("src", "dst") if forward else ("dst", "src")
    return f"""e AS (SELECT * FROM edge WHERE kind = 'calls' AND {near} IS NOT NULL),
r(id, depth) AS (SELECT id, 0 FROM ({seed}) UNION SELECT e.{far}, r.depth + 1 FROM r JOIN e ON e.{near} = r.id WHERE r.depth < {depth} AND e.{far} IS NOT NULL),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT CAST(m.depth + 1 AS BIGINT) AS depth, src, dst, dst_name, line, CAST(conf AS BIGINT) AS conf FROM e JOIN m ON m.id = e.{near} WHERE m.depth < {depth}"""


@_query("trv_callers", _walk_sql(False, "SELECT 'S' || s_suppkey AS id FROM supplier WHERE s_suppkey <= 5", 2), recursive=True)
def _(t):
    return traverse.call_walk(t.edges(), _ids(t, *[f"S{k}" for k in range(0, 6)]), 2)


@_query("trv_callees", _walk_sql(True, "SELECT DISTINCT src AS id FROM edge WHERE src LIKE 'C1%'", 2), recursive=True)
def _(t):
    e = t.edges()
    return traverse.call_walk(e, e.filter("src LIKE 'C1%'").select(F.col("src").alias("id")), 2, forward=True)


@_query("trv_reaches", """e AS (SELECT * FROM edge WHERE kind = 'calls'),
h AS (SELECT src, min((line, dst_name, conf)) AS b FROM e WHERE regexp_matches(dst_name, '(?i)^P[0-9]*7$') GROUP BY src),
w0 AS (SELECT DISTINCT src AS id, [src] AS chain, 2 AS conf FROM e WHERE src LIKE 'C1%'),
w1 AS (SELECT e.dst AS id, min((w0.chain, -least(w0.conf, e.conf))) AS b FROM w0 JOIN e ON e.src = w0.id WHERE e.dst IS NOT NULL AND e.dst NOT IN (SELECT id FROM w0) GROUP BY e.dst),
w AS (SELECT * FROM w0 UNION ALL SELECT id, list_append(b[1], id), -b[2] FROM w1)
SELECT w.id AS source, h.b[2] AS sink_name, h.b[1] AS line, CAST(len(chain) AS BIGINT) AS length, array_to_string(chain, '>') AS chain, CAST(least(w.conf, h.b[3]) AS BIGINT) AS conf, len(list_intersect(chain, (SELECT coalesce(list(DISTINCT src), []) FROM e WHERE regexp_matches(dst_name, '(?i)^P1')))) > 0 AS via_present
FROM w JOIN h ON h.src = w.id ORDER BY length, source, line LIMIT 20""")
def _(t):
    e = t.edges()
    seeds = e.filter("kind = 'calls' AND src LIKE 'C1%'").select(F.col("src").alias("id"))
    return traverse.reaches(e, seeds, "^P[0-9]*7$", via="^P1", depth=2)


@_query("trv_ego", "SELECT direction, kind, other, count(*) AS n, CAST(max(conf) AS BIGINT) AS conf FROM (SELECT 'out' AS direction, kind, coalesce(dst, dst_name) AS other, conf FROM edge WHERE src = 'S1' UNION ALL SELECT 'in', kind, src, conf FROM edge WHERE dst = 'S1') GROUP BY ALL")
def _(t):
    return traverse.ego(t.edges(), "S1")


@_query("trv_neighbourhood", """e AS (SELECT * FROM edge WHERE dst IS NOT NULL AND conf >= 1),
f1 AS (SELECT 'S7' AS id), l1 AS (SELECT DISTINCT e.* FROM e WHERE src IN (FROM f1) OR dst IN (FROM f1)),
f2 AS (SELECT src AS id FROM l1 UNION SELECT dst FROM l1), l2 AS (SELECT DISTINCT e.* FROM e WHERE src IN (FROM f2) OR dst IN (FROM f2))
SELECT src, dst, kind, count(*) AS n, CAST(max(conf) AS BIGINT) AS conf FROM (SELECT DISTINCT src, dst, kind, conf, line FROM (FROM l1 UNION ALL FROM l2)) GROUP BY ALL""")
def _(t):
    return traverse.neighbourhood(t.edges(), _ids(t, "S7"), 2, min_conf=1)


@_query("trv_closure", "r(id) AS (SELECT 'R1' UNION SELECT e.src FROM r JOIN edge e ON e.dst = r.id WHERE e.kind IN ('inherits', 'imports')) SELECT id FROM r", recursive=True)
def _(t):
    return traverse.closure(t.edges(), _ids(t, "R1"), kinds=("inherits", "imports"))


@_query("trv_change_impact", _impact_sql("edge", "SELECT symbol_id AS id FROM sym WHERE path IN ('parts/Brand#2.py', 'regions/__init__.py')", 2), recursive=True)
def _(t):
    return traverse.change_impact(t.edges(), t.symbols(), ["parts/Brand#2.py", "regions/__init__.py"], depth=2)


@_query("trv_affected_modules", _impact_sql("edge", "SELECT symbol_id AS id FROM sym WHERE path IN ('parts/Brand#2.py')", 2).replace("SELECT c.id, CAST", "SELECT path, count(*) AS symbols, CAST(min(depth) AS BIGINT) AS depth FROM (SELECT c.id, CAST") + ") i JOIN sym ON symbol_id = i.id GROUP BY path", recursive=True)
def _(t):
    hit = traverse.change_impact(t.edges(), t.symbols(), ["parts/Brand#2.py"], depth=2)
    return hit.join(t.symbols(), hit["id"] == F.col("symbol_id")).groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.min("depth").alias("depth"))


@_query("trv_related_tests", "SELECT fqn, path, CAST(1 AS BIGINT) AS depth FROM (SELECT DISTINCT b.fqn, b.path FROM edge e JOIN sym b ON b.symbol_id = e.dst WHERE e.kind = 'calls' AND b.path LIKE 'tests/%' AND e.src IN ('S1', 'S2', 'S3', 'S4'))")
def _(t):
    turned = t.edges().withColumns({"src": F.col("dst"), "dst": F.col("src")})  # parts call their suppliers, so that tests are callers
    return traverse.related_tests(turned, t.symbols(), _ids(t, "S1", "S2", "S3", "S4"), depth=1)


# ---- analytics ---------------------------------------------------------------


def _pagerank_sql(rounds: int = 20) -> str:
    lead = "l AS MATERIALIZED (SELECT DISTINCT src, dst FROM edge WHERE dst IS NOT NULL AND src <> dst), o AS MATERIALIZED (SELECT src, dst, 0.85 / count(*) OVER (PARTITION BY src) AS share FROM l), k AS MATERIALIZED (SELECT count(*) AS n FROM sym), r0 AS MATERIALIZED (SELECT symbol_id AS id, CAST(1.0 AS DOUBLE) / n AS rank FROM sym, k)"
    for i in range(1, rounds + 1):
        lead += f", r{i} AS MATERIALIZED (SELECT symbol_id AS id, (1 - CAST(0.85 AS DOUBLE)) / n + coalesce(g, 0) AS rank FROM sym CROSS JOIN k LEFT JOIN (SELECT o.dst, sum(r.rank * o.share) AS g FROM o JOIN r{i - 1} r ON r.id = o.src GROUP BY o.dst) x ON x.dst = symbol_id)"
    return lead + f" SELECT id, round(rank, 10) AS rank FROM r{rounds}"


@_query("ana_pagerank", _pagerank_sql())
def _(t):
    return analytics.pagerank(t.symbols().select(F.col("symbol_id").alias("id")), t.edges()).select("id", F.round("rank", 10).alias("rank"))


@_query("ana_weighted_pairs", "SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS weight FROM edge WHERE dst IS NOT NULL AND src <> dst AND kind IN ('calls', 'imports', 'inherits') GROUP BY 1, 2")
def _(t):
    return analytics.weighted_pairs(t.edges())


@_query("ana_communities", None)
def _(t):
    return analytics.communities(analytics.weighted_pairs(t.edges()))


# ---- extraction --------------------------------------------------------------


@_query("ext_html_classes", """SELECT page_id, c AS name, count(*) AS n FROM (SELECT page_id, unnest(string_split_regex(trim(x), '[ \\t\\r\\n]+')) AS c FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS x FROM pages)) WHERE c <> '' GROUP BY ALL""", graph=False)
def _(t):
    from ..functions.extract import extract

    files = t.pages.select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("language"), F.col("html").alias("text"))
    refs = extract(files).filter("record = 'ref' AND kind = 'references'")
    return refs.groupBy(F.col("path").cast("long").alias("page_id"), F.col("name")).agg(n())


@_query("ext_document_lines", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents", graph=False)
def _(t):
    return t.documents.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"))


# ---- streams over events -----------------------------------------------------


@_query("str_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", graph=False)
def _(t):
    from ..streaming.events import tumbling

    return tumbling(t.events, "1 hour")


@_query("str_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT * FROM g ORDER BY user_id, ts))
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""", graph=False)
def _(t):
    from ..streaming.events import sessions

    return sessions(t.events, "30 minutes")


@_query("str_latest_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id", graph=False)
def _(t):
    from ..streaming.events import latest

    return latest(t.events)


# ---- more of sources, filters and sets ---------------------------------------


@_query("join_import_paths", "SELECT DISTINCT a.path || '>' || b.path AS ref_id, b.path AS dst, CAST(1 AS INTEGER) AS conf FROM edge e JOIN sym a ON a.symbol_id = e.src JOIN sym b ON b.symbol_id = e.dst WHERE e.kind = 'calls' AND e.src LIKE 'S%'")
def _(t):
    """Files that call files, as relative imports without an extension."""
    at = lambda end, name: t.symbols().select(F.col("symbol_id").alias(end), F.col("path").alias(name))
    pairs = t.edges().filter("kind = 'calls' AND src LIKE 'S%'").join(at("src", "p"), "src").join(at("dst", "q"), "dst").select("p", "q").distinct()
    refs = pairs.select(F.concat("p", F.lit(">"), "q").alias("ref_id"), F.col("p").alias("path"), F.lit("python").alias("language"), F.concat(F.lit(".././"), F.regexp_replace("q", "\\.py$", "")).alias("dst_name"))
    return resolve.resolve_paths(refs, t.symbols().select("path").distinct().withColumn("symbol_id", F.col("path")))


@_query("flt_sink_preset", "SELECT page_id, len(regexp_extract_all(html, '(?i)href|src=|https?://')) AS n FROM pages WHERE regexp_matches(html, '(?i)href|src=|https?://')", graph=False)
def _(t):
    preset = "(?i)href|src=|https?://"
    return t.pages.filter(F.col("html").rlike(preset)).select("page_id", F.regexp_count("html", F.lit(preset)).cast("long").alias("n"))


@_query("agg_fingerprints", "SELECT substr(sha256(lang || '|' || source), 1, 24) AS fingerprint, count(*) AS n FROM documents GROUP BY 1", graph=False)
def _(t):
    return t.documents.groupBy(F.substring(F.sha2(F.concat("lang", F.lit("|"), "source"), 256), 1, 24).alias("fingerprint")).agg(n())


@_query("agg_localisation", """g AS (SELECT src, list_sort(list(DISTINCT dst)) AS gold FROM edge WHERE kind = 'calls' AND dst IS NOT NULL AND conf >= 1 GROUP BY src), p AS (SELECT src, list(DISTINCT dst) AS said FROM edge WHERE kind = 'calls' AND dst IS NOT NULL AND line % 2 = 0 GROUP BY src)
SELECT src, round(coalesce(len(list_intersect(gold, said)), 0) / len(gold), 6) AS recall, coalesce(len(list_intersect(gold, said)), 0) > 0 AS any_hit, coalesce(len(list_intersect(gold, said)), 0) = len(gold) AS all_hit FROM g LEFT JOIN p USING (src)""")
def _(t):
    e = t.edges().filter("kind = 'calls' AND dst IS NOT NULL")
    pairs = e.groupBy("src", "dst").agg(F.max((F.col("conf") >= 1).cast("int")).alias("gold"), F.max((F.col("line") % 2 == 0).cast("int")).alias("said"))
    g = pairs.groupBy("src").agg(F.sum("gold").alias("gold"), F.sum(F.col("gold") * F.col("said")).alias("hit")).filter("gold > 0")
    return g.select("src", F.round(F.col("hit") / F.col("gold"), 6).alias("recall"), (F.col("hit") > 0).alias("any_hit"), (F.col("hit") == F.col("gold")).alias("all_hit"))


@_query("srt_top_symbols", "d AS (SELECT dst, count(*) AS n FROM edge WHERE dst IS NOT NULL GROUP BY dst) SELECT dst, n FROM d ORDER BY n DESC, dst LIMIT 25")
def _(t):
    return t.edges().filter("dst IS NOT NULL").groupBy("dst").agg(n()).orderBy(F.desc("n"), "dst").limit(25)


@_query("set_union_of_impacts", "SELECT id, CAST(min(d) AS BIGINT) AS depth FROM (SELECT src AS id, 1 AS d FROM edge WHERE dst = 'R0' UNION ALL SELECT src, 1 FROM edge WHERE dst = 'R1' UNION ALL SELECT b.src, 2 FROM edge a JOIN edge b ON b.dst = a.src WHERE a.dst IN ('R0', 'R1')) GROUP BY id")
def _(t):
    e = t.edges()
    both = traverse.impact(e, _ids(t, "R0"), 2).unionByName(traverse.impact(e, _ids(t, "R1"), 2))
    return both.groupBy("id").agg(F.min("depth").alias("depth"))


@_query("win_conversation_alternation", "SELECT conv_id, count(*) FILTER (role = before) AS repeats FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id", graph=False)
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.withColumn("before", F.lag("role").over(w)).groupBy("conv_id").agg(F.count_if(F.col("role") == F.col("before")).alias("repeats"))


@_query("str_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL", graph=False)
def _(t):
    from ..streaming.events import sliding

    return sliding(t.events, "2 hours", "1 hour")


@_query("ext_markdown_sections", None)
def _(t):
    from ..functions.extract import extract

    files = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.lit("markdown").alias("language"), "text")
    return extract(files).filter("record = 'sym'").groupBy("kind").agg(n())


_PROGRAM = """import os
def read():
    return input()
def run(command, quiet):
    os.system(command)
def main():
    run(read(), False)
def safe():
    run(quote(read()), True)
"""


@_query("flow_taint", None)
def _(t):
    from ..functions.extract import extract
    from ..functions.flow import flow_table
    from ..operators.taint import taint

    files = t.spark.createDataFrame([("app.py", "python", _PROGRAM)], "path string, language string, text string")
    found = extract(files)
    names = found.filter("record = 'sym' AND kind = 'function'").select(F.col("fqn").alias("dst"), F.col("name").alias("dst_name"))
    calls = found.filter("record = 'ref' AND kind = 'calls'").select("kind", F.col("fqn").alias("src"), F.col("name").alias("dst_name"), F.col("start_line").cast("long").alias("line")).join(names, "dst_name", "left").withColumn("conf", F.lit(1))
    return taint(flow_table(files), calls)
