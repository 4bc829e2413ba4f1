"""Bounded graph traversals with path confidence.

A path's confidence is the least of its edges'; of the paths that reach a node at its first depth the best counts. Each
round is one join of the frontier with the edges and one aggregate, so a round's shuffle is bounded by the edges that touch
the frontier. Up to LAZY rounds stay in one plan; deeper walks write each frontier to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from ..schema import IMPACT_KINDS

LAZY = 4


def _step(df: DataFrame, depth: int, rounds: int, name: str) -> DataFrame:
    return cut(df, name) if rounds > LAZY else df


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, kinds: tuple[str, ...] = IMPACT_KINDS) -> DataFrame:
    """id, depth, conf, via: everything that reaches a seed (column id) backwards within depth edges, at its first depth.

    via is the kind of the best edge that reached it (of equals, the first by name). Null ends are never walked.
    """
    e = edges.filter(F.col("dst").isNotNull() & F.col("src").isNotNull() & F.col("kind").isin(*kinds)).select("src", "dst", "kind", "conf")
    frontier = seeds.select("id").distinct().withColumn("conf", F.lit(2))
    seen = frontier.select("id")
    found: list[DataFrame] = []
    for d in range(1, depth + 1):
        reached = e.join(frontier.select(F.col("id").alias("dst"), F.col("conf").alias("path")), "dst").select(F.col("src").alias("id"), F.least("conf", "path").alias("conf"), "kind")
        best = reached.groupBy("id").agg(F.max("conf").alias("conf"), F.min(F.struct((-F.col("conf")).alias("c"), "kind")).alias("b")).select("id", "conf", F.col("b.kind").alias("via"))
        frontier = _step(best.join(seen, "id", "left_anti"), d, depth, "impact")
        found.append(frontier.select("id", F.lit(d).cast("long").alias("depth"), F.col("conf").cast("long").alias("conf"), "via"))
        seen = seen.unionByName(frontier.select("id"))
    return reduce(DataFrame.unionByName, found)


def call_walk(edges: DataFrame, seeds: DataFrame, depth: int = 1, forward: bool = False, kinds: tuple[str, ...] = ("calls",)) -> DataFrame:
    """depth, src, dst, dst_name, line, conf: every edge at the frontier of each depth; only nodes not met before are walked on.

    Backwards these are callers; forward callees, with unresolved ones (null dst) too.
    """
    near, far = ("src", "dst") if forward else ("dst", "src")
    e = edges.filter(F.col("kind").isin(*kinds) & F.col(near).isNotNull())
    frontier = seeds.select("id").distinct()
    seen = frontier
    found: list[DataFrame] = []
    for d in range(1, depth + 1):
        hit = e.join(frontier.select(F.col("id").alias(near)), near, "left_semi")
        found.append(hit.select(F.lit(d).cast("long").alias("depth"), "src", "dst", "dst_name", "line", F.col("conf").cast("long").alias("conf")))
        if d < depth:
            frontier = _step(hit.filter(F.col(far).isNotNull()).select(F.col(far).alias("id")).distinct().join(seen, "id", "left_anti"), d, depth, "walk")
            seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, found)


def reaches(edges: DataFrame, seeds: DataFrame, sink: str, via: str | None = None, depth: int = 8, max_paths: int = 20) -> DataFrame:
    """source, sink_name, line, length, chain, conf, via_present: shortest chains from the seeds to functions with a call that matches sink.

    A chain is the path of first visits (of equal ones, the smallest parent); for a function with several matching calls the
    first by line counts. via_present says whether any function of the chain calls a name that matches via.
    """
    e = edges.filter(F.col("kind") == "calls").select("src", "dst", "dst_name", "line", "conf")
    frontier = seeds.select("id").distinct().select("id", F.array("id").alias("chain"), F.lit(2).alias("conf"))
    walked = frontier
    seen = frontier.select("id")
    for d in range(1, depth):
        reached = e.filter("dst IS NOT NULL").join(frontier.select(F.col("id").alias("src"), "chain", F.col("conf").alias("path")), "src")
        nxt = reached.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("chain", (-F.least("conf", "path")).alias("c"))).alias("b")).select("id", F.concat("b.chain", F.array("id")).alias("chain"), (-F.col("b.c")).alias("conf"))
        frontier = _step(nxt.join(seen, "id", "left_anti"), d, depth, "reaches")
        walked = walked.unionByName(frontier)
        seen = seen.unionByName(frontier.select("id"))
    hits = e.filter(F.col("dst_name").rlike(f"(?i){sink}")).groupBy("src").agg(F.min(F.struct("line", "dst_name", "conf")).alias("h"))
    out = walked.join(hits, walked["id"] == hits["src"]).select(F.col("id").alias("source"), F.col("h.dst_name").alias("sink_name"), F.col("h.line").alias("line"), F.size("chain").cast("long").alias("length"), "chain", F.least("conf", "h.conf").cast("long").alias("conf"))
    if via is None:
        out = out.withColumn("via_present", F.lit(False))
    else:
        guards = e.filter(F.col("dst_name").rlike(f"(?i){via}")).select(F.col("src").alias("node"), F.lit(True).alias("guards")).distinct()
        marks = out.select("source", F.explode("chain").alias("node")).join(guards, "node").select("source").distinct().withColumn("marked", F.lit(True))
        out = out.join(marks, "source", "left").withColumn("via_present", F.coalesce("marked", F.lit(False))).drop("marked")
    return out.orderBy("length", "source", "line").limit(max_paths).withColumn("chain", F.array_join("chain", ">"))


def ego(edges: DataFrame, node: str) -> DataFrame:
    """direction, kind, other, n, conf: the typed edges into and out of one node."""
    out = edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), "kind", F.coalesce("dst", "dst_name").alias("other"), "conf")
    into = edges.filter(F.col("dst") == node).select(F.lit("in").alias("direction"), "kind", F.col("src").alias("other"), "conf")
    return out.unionByName(into).groupBy("direction", "kind", "other").agg(F.count(F.lit(1)).alias("n"), F.max("conf").cast("long").alias("conf"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, min_conf: int = 0) -> DataFrame:
    """src, dst, kind, n, conf: links met by walking edges of any kind in both directions; parallel ones are one link."""
    e = edges.filter(F.col("dst").isNotNull() & (F.col("conf") >= min_conf))
    frontier = seeds.select("id").distinct()
    seen = frontier
    links: list[DataFrame] = []
    for d in range(1, depth + 1):
        ids = frontier.select("id")
        hit = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "kind", "conf", "line").unionByName(e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind", "conf", "line"))
        links.append(hit)
        if d < depth:
            frontier = _step(hit.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(seen, "id", "left_anti"), d, depth, "near")
            seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, links).distinct().groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("conf").cast("long").alias("conf"))


def closure(edges: DataFrame, roots: DataFrame, kinds: tuple[str, ...] = ("inherits",), most: int = 64) -> DataFrame:
    """id: all that reaches a root over edges of these kinds (descendants, for inheritance), roots included; ends when a round adds nothing."""
    e = edges.filter(F.col("kind").isin(*kinds) & F.col("dst").isNotNull()).select("src", "dst")
    frontier = cut(roots.select("id").distinct(), "closure")
    seen = frontier
    for _ in range(most):
        frontier = cut(e.join(frontier.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct().join(seen, "id", "left_anti"), "closure")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def change_impact(edges: DataFrame, symbols: DataFrame, paths: list[str], depth: int = 3) -> DataFrame:
    """id, depth, conf, via of what the symbols of changed files reach; each symbol once, at its least depth."""
    return impact(edges, symbols.filter(F.col("path").isin(*paths)).select(F.col("symbol_id").alias("id")), depth)


def is_test_path(path: Column) -> Column:
    """A test folder on the way, a .test. or .spec. infix, or a stem that begins or ends with test."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec)/") | path.rlike(r"\.(test|spec)\.[^/]*$") | path.rlike(r"(^|/)(test_[^/]*|[^/]*_test)\.[^/.]*$")


def related_tests(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """fqn, path, depth: transitive callers in test files, each at its least depth."""
    callers = call_walk(edges, seeds, depth).groupBy(F.col("src").alias("symbol_id")).agg(F.min("depth").alias("depth"))
    return callers.join(symbols.filter(is_test_path(F.col("path"))), "symbol_id").groupBy("fqn", "path").agg(F.min("depth").alias("depth"))
