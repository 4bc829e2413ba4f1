"""Totals, health and evaluation figures of a program graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import confidence_name


def totals(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """files, symbols, edges, resolved, dangling: one row, one pass over each table."""
    s = symbols.agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("symbols"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count("dst").alias("resolved"), F.count_if(F.col("dst").isNull()).alias("dangling"))
    return s.join(F.broadcast(e))  # one row each


def by_confidence(edges: DataFrame, kind: str = "calls") -> DataFrame:
    """confidence, n, pct (one decimal) of the edges of a kind."""
    g = edges.filter(F.col("kind") == kind).groupBy("conf").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select(confidence_name(F.col("conf")).alias("confidence"), "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))  # at most three rows


def degree_counts(edges: DataFrame) -> DataFrame:
    """id, callers, callees, refs of every node with an edge, from one scan: an edge counts once at each end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(False).alias("into")), F.struct(F.col("dst").alias("id"), F.lit(True).alias("into")))).alias("e"), "kind").select("e.*", "kind").filter("id IS NOT NULL")
    call = F.col("kind") == "calls"
    return ends.groupBy("id").agg(F.count_if(call & F.col("into")).alias("callers"), F.count_if(call & ~F.col("into")).alias("callees"), F.count_if(F.col("into")).alias("refs"))


def unresolved(edges: DataFrame) -> DataFrame:
    """name, possible, dangling: guesses of the least confidence and calls without a target, by name."""
    return edges.filter((F.col("conf") == 0) | F.col("dst").isNull()).groupBy(F.col("dst_name").alias("name")).agg(F.count_if((F.col("conf") == 0) & F.col("dst").isNotNull()).alias("possible"), F.count_if(F.col("dst").isNull()).alias("dangling"))


def file_pairs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """a, b, weight, conf: undirected links between files, with their number and strongest confidence.

    Edges are summed by symbol pair before the joins with symbols, so hot files don't multiply rows.
    """
    pairs = edges.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.max("conf").alias("conf"))
    at = lambda end, name: symbols.select(F.col("symbol_id").alias(end), F.col("path").alias(name))
    p = pairs.join(at("src", "p"), "src").join(at("dst", "q"), "dst").filter("p <> q")
    return p.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("n").alias("weight"), F.max("conf").cast("long").alias("conf"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """symbol_id, change (added, removed, signature_changed) between two snapshots (symbol_id, signature)."""
    a, b = old.select("symbol_id", F.col("signature").alias("before")).withColumn("o", F.lit(1)), new.select("symbol_id", F.col("signature").alias("after")).withColumn("n", F.lit(1))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "signature_changed")
    return a.join(b, "symbol_id", "full").select("symbol_id", kind.alias("change")).filter("change IS NOT NULL")


def drift(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """path, state (new, removed, changed): what a stat sweep finds against the index; both have path, size, mtime_ns."""
    a = indexed.select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("m1")).withColumn("i", F.lit(1))
    b = on_disk.select("path", F.col("size").alias("s2"), F.col("mtime_ns").alias("m2")).withColumn("d", F.lit(1))
    state = F.when(F.col("i").isNull(), "new").when(F.col("d").isNull(), "removed").when(~(F.col("s1").eqNullSafe(F.col("s2")) & F.col("m1").eqNullSafe(F.col("m2"))), "changed")
    return a.join(b, "path", "full").select("path", state.alias("state")).filter("state IS NOT NULL")


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, score (true less false positive rate), in one pass."""
    c = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"), F.round(r - F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), 6).alias("score"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """in_both, only_a, only_b, jaccard of two sets of findings by their keys."""
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(1)), b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    n = x.join(y, keys, "full").agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("in_both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
    return n.withColumn("jaccard", F.round(F.try_divide(F.col("in_both"), F.col("in_both") + F.col("only_a") + F.col("only_b")), 6))
