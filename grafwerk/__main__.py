"""python -m grafwerk ROOT COMMAND [ARGUMENT...]: index, find, info, callers, callees, impact, reaches, refs, ego, tests, changes, modules, suggest, overview, communities, taint, flow, explain, stats, doctor, map, capabilities, compact."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import Answer, Graph, capabilities, to_html


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="grafwerk", description=__doc__)
    p.add_argument("root")
    p.add_argument("command")
    p.add_argument("argument", nargs="*")
    p.add_argument("--depth", type=int)
    p.add_argument("--scope", action="append")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    if a.command == "capabilities":
        print(json.dumps(capabilities(), indent=1))
        return 0
    spark = SparkSession.builder.appName("grafwerk").getOrCreate()
    g = Graph(spark, a.root, scopes=a.scope)
    deep = {} if a.depth is None else {"depth": a.depth}
    commands = {
        "index": lambda: g.index(a.force), "find": lambda: g.find(*a.argument), "info": lambda: g.symbol_info(*a.argument), "callers": lambda: g.callers(*a.argument, **deep), "callees": lambda: g.callees(*a.argument, **deep), "impact": lambda: g.impact(*a.argument, **deep),
        "reaches": lambda: g.reaches(*a.argument, **deep), "refs": lambda: g.references(*a.argument), "ego": lambda: g.ego_graph(*a.argument), "tests": lambda: g.related_tests(*a.argument, **deep), "changes": lambda: g.change_impact(sys.stdin.read(), **deep), "modules": lambda: g.affected_modules(sys.stdin.read(), **deep),
        "suggest": lambda: g.suggest_files(" ".join(a.argument)), "overview": lambda: g.overview(2000), "communities": g.communities, "taint": lambda: g.taint(**deep), "flow": lambda: g.data_flow(*a.argument), "explain": lambda: g.explain(*a.argument), "stats": g.stats, "doctor": g.doctor, "compact": g.compact,
        "map": lambda: print(to_html(g.visualize(*(a.argument or ["files"])))),
    }
    if a.command not in commands:
        p.error(f"no command {a.command}")
    out = commands[a.command]()
    if isinstance(out, Answer):
        for w in out.warnings:
            print(f"note: {w}", file=sys.stderr)
        out.rows.show(1000, truncate=False)
    elif out is not None:
        print(json.dumps(out, indent=1, default=str))
    return int(a.command == "doctor" and bool(out["failed"]))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
