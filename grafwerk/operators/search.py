"""Symbol search by tiers, the code floor, selectors, file suggestions and text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LOW_INFO_KINDS

WORDS = r"[A-Za-z0-9]+"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def tier(query: str) -> Column:
    """1 exact fqn, 2 dotted end of it, 3 name, 4 all tokens of the query in name, fqn or doc, 5 part of the name in any case; null: no match."""
    wanted = F.array(*[F.lit(t) for t in sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))])
    own = F.array_distinct(F.concat(tokens_of(F.col("name")), tokens_of(F.col("fqn"))))
    all_tokens = (F.size(wanted) > 0) & (F.size(F.array_except(wanted, own)) == 0)
    return F.when(F.col("fqn") == query, 1).when(F.col("fqn").endswith("." + query), 2).when(F.col("name") == query, 3).when(all_tokens, 4).when(F.lower("name").contains(query.lower()), 5)


def find(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 10, code_floor: bool = True) -> DataFrame:
    """The best `limit` symbols by tier, files last, then rank, then fqn. One scan; the tier is a column, so only top-k rows move.

    Without a kind, at least half of the places go to symbols other than markup and keys, as far as there are any.
    symbols: symbol_id, kind, name, fqn, rank.
    """
    hit = symbols.withColumn("tier", tier(query).cast("long")).filter("tier IS NOT NULL")
    if kind is not None:
        hit = hit.filter(F.col("kind") == kind)
    order = [F.col("tier"), (F.col("kind") == "file").cast("int"), F.desc("rank"), F.col("fqn"), F.col("symbol_id")]
    top = hit.orderBy(*order).limit(limit)
    if kind is not None or not code_floor:
        return top
    low = F.col("kind").isin(*LOW_INFO_KINDS)
    code = hit.filter(~low).orderBy(*order).limit((limit + 1) // 2)
    both = top.unionByName(code).dropDuplicates(["symbol_id"])
    w = Window.orderBy(*order)  # over at most 1.5 * limit rows
    mine = both.withColumn("is_low", low.cast("int"))
    placed = mine.withColumn("low_before", F.sum("is_low").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("codes", F.sum(1 - F.col("is_low")).over(Window.partitionBy(F.lit(1))))
    room = F.lit(limit) - F.least(F.col("codes"), F.lit((limit + 1) // 2))
    kept = placed.filter((F.col("is_low") == 0) | (F.col("low_before") <= room)).drop("is_low", "low_before", "codes")
    return kept.orderBy((F.col("tier") != 1).cast("int"), low.cast("int"), *order).limit(limit)


class NotFound(LookupError):
    pass


class Ambiguous(LookupError):
    pass


def select_symbol(symbols: DataFrame, selector: str) -> str:
    """The symbol_id that a selector names: by exact fqn, else dotted end, else name; raises NotFound, or Ambiguous with up to 8 fqns."""
    level = F.when(F.col("fqn") == selector, 1).when(F.col("fqn").endswith("." + selector), 2).when(F.col("name") == selector, 3)
    rows = symbols.withColumn("level", level).filter("level IS NOT NULL").orderBy("level", "fqn", "symbol_id").select("level", "symbol_id", "fqn").limit(9).collect()
    best = [r for r in rows if r.level == rows[0].level]
    if not best:
        raise NotFound(selector)
    if len(best) > 1:
        raise Ambiguous(f"{selector}: " + ", ".join(r.fqn for r in best[:8]))
    return best[0].symbol_id


def suggest_files(symbols: DataFrame, task: str, limit: int = 8) -> DataFrame:
    """path, score, reasons: files whose symbols hold words of the task (3 characters or more, 8 at most); a match counts its rank + 1."""
    words = list(dict.fromkeys(w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in task.lower()).split() if len(w) >= 3))[:8]
    hits = F.array(*[F.when(F.lower("name").contains(w), F.lit(w)) for w in words]) if words else F.array()
    m = symbols.select("path", "rank", F.explode(F.array_compact(hits)).alias("word"))
    return m.groupBy("path").agg(F.round(F.sum(F.col("rank") + 1), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("word")), ",").alias("reasons")).orderBy(F.desc("score"), "path").limit(limit)


def grep(documents: DataFrame, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_number (from 1), line of every line that matches the regular expression."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    return lines.filter(F.col("line").rlike(pattern)).select(key, (F.col("at") + 1).cast("long").alias("line_number"), "line")


def with_all_tokens(documents: DataFrame, words: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key of documents that hold every word as a whole lower-cased token."""
    own = tokens_of(F.col(text))
    return documents.filter(F.size(F.array_except(F.array(*[F.lit(w) for w in words]), own)) == 0).select(key)


def overview(files: DataFrame, budget_chars: int) -> DataFrame:
    """files (path, score, cost) by score until the running cost passes the budget; the first always stays, later ones stop at the first overflow."""
    w = Window.orderBy(F.desc("score"), "path")  # one row per file that is shown
    return files.withColumn("place", F.row_number().over(w).cast("long")).withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).filter((F.col("place") == 1) | (F.col("used") <= budget_chars)).select("path", "score", "cost", "place", "used")
