"""Taint between functions: a fixpoint of joins over (function, argument) states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import cut
from ..functions.flow import FIRST_ONLY, Rules


def _is_sink(rules: Rules) -> Column:
    bare = F.col("callee").isin(*rules.bare_sinks) & ~F.col("qualified").contains(".") if rules.bare_sinks else F.lit(False)
    named = F.col("callee").isin(*rules.sinks) & ((F.col("arg_index") < 0) | ~F.col("callee").isin(*FIRST_ONLY) | (F.col("arg_index") == 0)) if rules.sinks else F.lit(False)
    return bare | named


def call_targets(calls: DataFrame) -> DataFrame:
    """func, line, callee, target, conf of resolved call edges whose ends are fqns: the best target of each site and name."""
    c = calls.filter("kind = 'calls' AND dst IS NOT NULL").withColumn("callee", F.element_at(F.split("dst_name", r"\."), -1))
    return c.groupBy(F.col("src").alias("func"), "line", "callee").agg(F.min(F.struct((-F.col("conf")).alias("c"), "dst")).alias("m")).select("func", "line", "callee", F.col("m.dst").alias("target"), (-F.col("m.c")).alias("conf"))


def returning_sources(flows: DataFrame, targets: DataFrame, most: int = 6) -> DataFrame:
    """func: functions that return source data, themselves or by way of functions they call."""
    returns = flows.filter("callee IS NULL")
    found = cut(returns.filter("seed = 'source'").select("func").distinct(), "wrappers")
    by_call = returns.filter("startswith(seed, 'call:')").withColumn("part", F.split("seed", ":")).select("func", F.col("part")[1].alias("callee"), F.col("part")[2].cast("long").alias("line")).join(targets, ["func", "line", "callee"]).select("func", "target")
    for _ in range(most):
        more = cut(by_call.join(found.withColumnRenamed("func", "target"), "target", "left_semi").select("func").distinct().join(found, "func", "left_anti"), "wrappers")
        if more.isEmpty():
            break
        found = cut(found.unionByName(more), "wrappers")
    return found


def taint(flows: DataFrame, calls: DataFrame, rules: Rules | None = None, depth: int = 3, max_findings: int = 100) -> DataFrame:
    """origin, sink, sink_func, line, arg_index, conf, depth, steps: source data that reaches a sink within depth calls.

    Each (function, argument) is expanded once, for its first state in order of depth, origin and place. confidence is the
    least of the resolved calls on the way. Findings of production code come before those in tests, then the surer ones.
    """
    rules = rules or Rules()
    targets = cut(call_targets(calls), "targets")
    wrappers = returning_sources(flows, targets)
    direct = flows.filter("seed = 'source' AND callee IS NOT NULL")
    part = F.split("seed", ":")
    by_call = flows.filter("startswith(seed, 'call:') AND callee IS NOT NULL").withColumns({"_c": part[1], "_l": part[2].cast("long")})
    through = by_call.join(targets.select("func", F.col("line").alias("_l"), F.col("callee").alias("_c"), "target"), ["func", "_l", "_c"]).join(wrappers.withColumnRenamed("func", "target"), "target", "left_semi")
    columns = ["func", "path", "callee", "qualified", "arg_index", "line", "via"]
    state = direct.select(*columns).unionByName(through.select(*columns)).distinct().select(F.col("func").alias("origin"), "*", F.lit(2).alias("conf"), F.col("func").alias("steps"))
    of_param = flows.filter("startswith(seed, 'param:') AND callee IS NOT NULL").select(F.col("func").alias("_func"), F.substring("seed", 7, 9).cast("int").alias("_arg"), F.col("path").alias("_path"), F.col("callee").alias("_callee"), F.col("qualified").alias("_qualified"), F.col("arg_index").alias("_index"), F.col("line").alias("_line"), F.col("via").alias("_via"))
    seen: DataFrame | None = None
    found: list[DataFrame] = []
    for d in range(1, depth + 1):
        state = cut(state, "taint")
        found.append(state.filter(_is_sink(rules)).select("origin", F.col("callee").alias("sink"), F.col("func").alias("sink_func"), "path", "line", "arg_index", "conf", F.lit(d).alias("depth"), "steps"))
        if d == depth or state.isEmpty():
            break
        reached = state.filter((F.col("arg_index") >= 0) & ~F.col("callee").isin(*rules.sanitizers)).join(targets.withColumnRenamed("conf", "_conf"), ["func", "line", "callee"])
        first = reached.groupBy("target", "arg_index").agg(F.min(F.struct("origin", "path", "line", "func", F.least("conf", "_conf").alias("conf"), "steps")).alias("m"))
        if seen is not None:
            first = first.join(seen, ["target", "arg_index"], "left_anti")
        first = cut(first, "taint-first")
        seen = first.select("target", "arg_index") if seen is None else seen.unionByName(first.select("target", "arg_index"))
        nxt = first.join(of_param, (F.col("target") == F.col("_func")) & (F.col("arg_index") == F.col("_arg")))
        state = nxt.select(F.col("m.origin").alias("origin"), F.col("target").alias("func"), F.col("_path").alias("path"), F.col("_callee").alias("callee"), F.col("_qualified").alias("qualified"), F.col("_index").alias("arg_index"), F.col("_line").alias("line"), F.col("_via").alias("via"), F.col("m.conf").alias("conf"), F.concat("m.steps", F.lit(" > "), "target").alias("steps"))
    rows = reduce(DataFrame.unionByName, found)
    best = rows.groupBy("origin", "sink", "sink_func", "path", "line", "arg_index").agg(F.min(F.struct((-F.col("conf")).alias("c"), "depth", "steps")).alias("m")).select("origin", "sink", "sink_func", "path", "line", "arg_index", (-F.col("m.c")).alias("conf"), F.col("m.depth").alias("depth"), F.col("m.steps").alias("steps"))
    from .traverse import is_test_path

    return best.withColumn("in_test", is_test_path(F.col("path"))).orderBy("in_test", F.desc("conf"), "depth", "origin", "line", "arg_index").limit(max_findings)


def data_flow(flows: DataFrame, func: str, rules: Rules | None = None) -> DataFrame:
    """seed, callee, arg_index, line, via, is_sink of one function's parameters; a row without callee: the parameter reaches the return."""
    return flows.filter((F.col("func") == func) & F.col("seed").startswith("param:")).select("seed", "callee", "arg_index", "line", "via", F.coalesce(_is_sink(rules or Rules()), F.lit(False)).alias("is_sink"))
