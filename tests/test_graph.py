"""Operators on small graphs, against plain Python and against their SQL on the smallest tables."""

import os

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from grafwerk.operators import analytics, resolve, search, traverse
from grafwerk.plans import catalog

SF = "/root/testdata/sf0.001"
EDGES = "kind string, src string, dst string, dst_name string, line long, conf int, path string, col int, resolver string"


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(kind, a, b, b or "gone", i, c, "f.py", 0, "l0") for i, (a, b, c) in enumerate(pairs)], EDGES)


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def test_walks_end_on_cycles(spark):
    e = edges(spark, [("a", "b", 2), ("b", "a", 1), ("c", "c", 2), ("x", "a", 0)])
    assert sorted((r.id, r.depth, r.conf) for r in traverse.impact(e, ids(spark, "a"), 6).collect()) == [("b", 1, 1), ("x", 1, 0)]
    assert {r.id for r in traverse.closure(e, ids(spark, "a"), kinds=("calls",)).collect()} == {"a", "b", "x"}
    assert sorted((r.depth, r.src, r.dst) for r in traverse.call_walk(e, ids(spark, "a"), 3).collect()) == [(1, "b", "a"), (1, "x", "a"), (2, "a", "b")]


def test_path_confidence_is_the_best_of_the_weakest(spark):
    e = edges(spark, [("t", "m", 0), ("t", "n", 1), ("m", "s", 2), ("n", "s", 2)])
    assert {(r.id, r.conf) for r in traverse.impact(e, ids(spark, "s"), 2).collect()} == {("m", 2), ("n", 2), ("t", 1)}


def test_reaches_gives_one_chain_a_function(spark):
    e = edges(spark, [("a", "b", 2), ("b", "c", 1), ("a", "c", 0), ("c", None, 2)])
    (row,) = traverse.reaches(e, ids(spark, "a"), "^gone$", via="^b$").collect()
    assert (row.source, row.chain, row.conf, row.via_present) == ("c", "a>c", 0, True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcde"), st.sampled_from("abcde"), st.integers(0, 2)), max_size=12))
def test_impact_against_brute_force(spark, pairs):
    best, frontier, seen = {}, {"a": 2}, {"a"}
    for d in (1, 2, 3):
        nxt = {}
        for s, t, c in pairs:
            if t in frontier and s not in seen:
                nxt[s] = max(nxt.get(s, -1), min(c, frontier[t]))
        best |= {k: (d, v) for k, v in nxt.items()}
        seen |= set(nxt)
        frontier = nxt
    assert {r.id: (r.depth, r.conf) for r in traverse.impact(edges(spark, pairs), ids(spark, "a"), 3).collect()} == best


def test_pagerank(spark):
    got = {r.id: r.rank for r in analytics.pagerank(ids(spark, "a", "b", "c"), edges(spark, [("a", "b", 2), ("a", "b", 2), ("b", "b", 2)]), rounds=2).collect()}
    base = 0.05
    assert got == pytest.approx({"a": base, "c": base, "b": base + 0.85 * base})


def test_two_triangles_are_two_communities():
    pairs = [(a, b, 1.0) for t in ("abc", "xyz") for i, a in enumerate(t) for b in t[i + 1 :]] + [("c", "x", 1.0)]
    got = analytics.louvain_of(pairs)
    assert len(set(got.values())) == 2 and got["a"] == got["b"] == got["c"] != got["x"]
    assert analytics.louvain_of(pairs[::-1]) == got and analytics.louvain_of([]) == {}


def test_resolution_caps_and_fans_out(spark):
    refs = spark.createDataFrame([(str(i), "calls", n, p, "python") for i, (n, p) in enumerate([("one", "a"), ("two", "a"), ("two", "c"), ("six", "a"), ("m.two", "z"), ("none", "a"), ("", "a"), ("x*", "a")])], "ref_id string, kind string, dst_name string, path string, language string")
    rows = [("s1", "one", "k.one", "b"), ("s2", "two", "m.two", "b"), ("s3", "two", "n.two", "c")] + [(f"t{i}", "six", f"q{i}.six", "b") for i in range(6)]
    symbols = spark.createDataFrame([(i, "function", n, f, p, "python") for i, n, f, p in rows], "symbol_id string, kind string, name string, fqn string, path string, language string")
    got = sorted((r.ref_id, r.dst, r.conf) for r in resolve.decide(resolve.candidates(refs, symbols)).collect())
    assert got == [("0", "s1", 1), ("1", "s2", 0), ("1", "s3", 0), ("2", "s3", 1), ("4", "s2", 1)]


def louvain_by_sweeps(pairs):
    """Louvain that looks at every vertex in every sweep."""
    names = sorted({x for p in pairs for x in p[:2]})
    member, edges = {v: v for v in names}, [(a, b, w) for a, b, w in pairs]
    while edges:
        nodes = sorted({x for p in edges for x in p[:2]})
        around = {v: {} for v in nodes}
        degree = dict.fromkeys(nodes, 0.0)
        for a, b, w in edges:
            degree[a] += w
            degree[b] += w
            if a != b:
                around[a][b] = around[a].get(b, 0.0) + w
                around[b][a] = around[b].get(a, 0.0) + w
        home, total, twice, moved = {v: v for v in nodes}, dict(degree), sum(degree.values()), True
        while moved:
            moved = False
            for v in nodes:
                near = {}
                for u, w in around[v].items():
                    near[home[u]] = near.get(home[u], 0.0) + w
                old, best, gain = home[v], home[v], analytics.LEAST_GAIN
                total[old] -= degree[v]
                for c in sorted(near):
                    more = near[c] - near.get(old, 0.0) - degree[v] * (total[c] - total[old]) / twice
                    if c != old and more > gain:
                        best, gain = c, more
                home[v] = best
                total[best] += degree[v]
                moved |= best != old
        if len(set(home.values())) == len(nodes):
            break
        member = {v: home[m] for v, m in member.items()}
        edges = [(home[a], home[b], w) for a, b, w in edges]
    order = {}
    return {v: order.setdefault(member[v], len(order)) for v in names}


@settings(max_examples=300, deadline=None)
@given(st.integers(2, 40), st.integers(1, 120), st.randoms(use_true_random=False))
def test_vertices_passed_over_would_not_have_moved(n, m, r):
    pairs = [(f"v{r.randrange(n):02}", f"v{min(r.randrange(n), r.randrange(n)):02}", float(r.choice([1, 1, 1, 2, 5]))) for _ in range(m)]
    assert analytics.louvain_of(pairs) == louvain_by_sweeps(pairs)


def test_contracted_graphs_keep_every_vertex(spark, monkeypatch):
    """Also those of a part that became one label, and has no pair left."""
    monkeypatch.setattr(analytics, "MOST_PAIRS", 3)
    pairs = [("a", "b", 5), ("x", "y", 5), ("y", "z", 1), ("z", "w", 5), ("w", "u", 1), ("u", "t", 5)]
    got = {r.id: r.community for r in analytics.communities(spark.createDataFrame(pairs, "a string, b string, weight long")).collect()}
    assert sorted(got) == sorted("abtuwxyz")
    assert got["a"] == got["b"] and got["a"] not in {got[v] for v in "tuwxyz"}


REFS = "ref_id string, kind string, dst_name string, path string, language string"
SYMBOLS = "symbol_id string, kind string, name string, fqn string, path string, language string"


def test_each_row_of_an_id_has_its_candidates(spark):
    refs = spark.createDataFrame([("r", "calls", "one", "a", "python"), ("r", "calls", "one", "b", "python")], REFS)
    symbols = spark.createDataFrame([("s1", "function", "one", "k.one", "b", "python"), ("s2", "function", "one", "k.one", "a", "python")], SYMBOLS)
    got = sorted((r.ref_id, r.symbol_id, r.same_file) for r in resolve.candidates(refs, symbols).collect())
    assert got == [("r", "s1", False), ("r", "s1", True)]


def test_references_beyond_the_cap_are_left_out_before_the_join(spark):
    """By all rows of an id: that of r1 has one candidate by itself, five and one with the other row."""
    refs = spark.createDataFrame([("r0", "calls", "six", "a", "python"), ("r1", "calls", "one", "a", "python"), ("r1", "calls", "m.five", "a", "python"), ("r2", "calls", "m.five", "a", "python")], REFS)
    rows = [("s0", "one", "k.one")] + [(f"t{i}", "six", f"q{i}.six") for i in range(6)] + [(f"u{i}", "five", f"q{i}.m.five") for i in range(5)] + [("u5", "five", "q5.n.five")]
    symbols = spark.createDataFrame([(i, "function", n, f, "b", "python") for i, n, f in rows], SYMBOLS)
    found = resolve.candidates(refs, symbols, 5)
    assert sorted((r.ref_id, r.symbol_id) for r in found.collect()) == [("r2", f"u{i}") for i in range(5)]
    decided = lambda x: sorted(map(tuple, resolve.decide(x).collect()))
    assert decided(found) == decided(resolve.candidates(refs, symbols)) != []


NAMES = ["foo", "a.foo", "b.a.foo", ".foo", "a.", "x.a.foo", "foo.a", "a"]
fqns = st.one_of(st.none(), st.sampled_from([*NAMES, "a..foo", "xa.foo"]))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.sampled_from(["calls", "inherits", "references", "imports", None]), st.sampled_from([*NAMES, "", "*"]), st.sampled_from(["p", "q"]), st.sampled_from(["python", "java", None])), min_size=20, max_size=40),
    st.lists(st.tuples(st.sampled_from(["function", "class", "css_class", "key", None]), st.sampled_from(["foo", "a", "", "a.foo", None]), fqns, st.sampled_from(["p", "q"]), st.sampled_from(["python", "java", None])), min_size=20, max_size=40),
)
def test_candidates_against_brute_force(spark, refs, symbols):
    want = []
    for i, (kind, wanted, path, language) in enumerate(refs):
        best = {}
        for k, (s_kind, name, fqn, s_path, s_language) in enumerate(symbols):
            dotted = "." in wanted
            kinds = {"calls": ("function", "method", "class"), "inherits": ("class", "interface", "struct", "module"), "references": ("css_class", "html_id")}.get(kind)
            fits = (s_kind in kinds if kinds else dotted) and (kind not in ("calls", "inherits") or language is not None and s_language == language)
            fits = fits and name == wanted.rpartition(".")[2] and (not dotted or fqn is not None and (fqn == wanted or fqn.endswith("." + wanted)))
            if fits and wanted and "*" not in wanted:
                best.setdefault(fqn, (f"{k:02}", s_path == path))
        want += [(f"r{i}", *x) for x in best.values()]
    r = spark.createDataFrame([(f"r{i}", *x) for i, x in enumerate(refs)], REFS)
    s = spark.createDataFrame([(f"{k:02}", *x) for k, x in enumerate(symbols)], SYMBOLS)
    assert sorted((x.ref_id, x.symbol_id, x.same_file) for x in resolve.candidates(r, s).collect()) == sorted(want)


def test_promotion_and_invalidation(spark):
    e = edges(spark, [("a", "x", 0), ("a", "y", 0)]).withColumn("line", __import__("pyspark").sql.functions.lit(1).cast("long")).withColumn("dst_name", __import__("pyspark").sql.functions.lit("n"))
    sure = resolve.promote(e, spark.createDataFrame([("f.py", 1, 0, "x")], "path string, line long, col int, dst string"))
    assert [(r.dst, r.conf, r.resolver) for r in sure.collect()] == [("x", 2, "l1")]
    gone = resolve.invalidate(e, spark.createDataFrame([("x",)], "symbol_id string"))
    assert [(r.dst, r.dst_name, r.conf) for r in gone.collect()] == [(None, "n", 0)]


def test_code_floor_keeps_half(spark):
    rows = [(f"c{i}", "css_class", "menu", f"s.menu{i}", 1.0) for i in range(13)] + [("f1", "function", "menuOpen", "a.menuOpen", 0.1), ("f2", "function", "openMenu", "a.openMenu", 0.2)]
    s = spark.createDataFrame(rows, "symbol_id string, kind string, name string, fqn string, rank double")
    got = [r.kind for r in search.find(s, "menu", limit=4).collect()]
    assert got.count("function") == 2 and len(got) == 4
    assert [r.kind for r in search.find(s, "menu", kind="css_class", limit=4).collect()] == ["css_class"] * 4


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda d: sorted(repr([None if v is None or v != v else v.isoformat() if hasattr(v, "isoformat") else round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in r]) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from grafwerk.streaming import events

    rows = [(f"p{i % 2}", "upsert" if i < 3 else "remove", i) for i in range(4)]
    spark.createDataFrame(rows, "path string, kind string, t int").withColumn("ts", F.timestamp_seconds("t")).drop("t").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    events.drained(source, lambda df, n: seen.extend((r.path, r.kind) for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(seen) == [("p0", "upsert"), ("p1", "remove")]
    table = spark.createDataFrame([("a", 1), ("b", 2)], "path string, v int")
    out = events.upserted(table, spark.createDataFrame([("c", 3)], table.schema), spark.createDataFrame([("b",)], "path string"))
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("c", 3)]
