"""The library's front: a program graph of a source tree, kept as versioned Parquet tables, and everything one can ask it."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import ship
from .functions import flow as flows
from .functions.extract import PARSERS, extract
from .operators import analytics, health, resolve, search, taint, traverse
from .schema import confidence_name
from .sources import repository

VERSION = 1


@dataclass
class Answer:
    """Rows, and what one should know about them."""

    rows: DataFrame
    fresh: bool = True
    completeness: str = "static: dynamic calls may be missing"
    truncated: bool = False
    warnings: list[str] = field(default_factory=list)


class Graph:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None, scopes: list[str] | None = None, excludes: list[str] | None = None) -> None:
        ship(spark)
        self.spark, self.root, self.scopes, self.excludes = spark, root.rstrip("/"), scopes or [], excludes or []
        self.store = (store or f"{self.root}/.grafwerk").rstrip("/")

    # ---- storage ----

    def _meta(self) -> dict:
        f = Path(self.store, "meta.json")
        if f.is_file():
            meta = json.loads(f.read_text())
            if meta.get("version") == VERSION:
                return meta
        return {}

    def table(self, name: str) -> DataFrame:
        meta = self._meta()
        if name not in meta.get("tables", {}):
            raise LookupError("the tree isn't indexed; call index() first")
        return self.spark.read.parquet(meta["tables"][name])

    def _save(self, tables: dict[str, DataFrame]) -> None:
        """Writes a new version of each table, then switches to all at once; the versions before the last are deleted."""
        import shutil

        meta = self._meta()
        old = dict(meta.get("tables", {}))
        paths = {}
        for name, df in tables.items():
            paths[name] = f"{self.store}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(paths[name])
        Path(self.store).mkdir(parents=True, exist_ok=True)
        fresh = Path(self.store, "meta.json.new")
        fresh.write_text(json.dumps({"version": VERSION, "scopes": self.scopes, "excludes": self.excludes, "tables": old | paths}))
        fresh.replace(Path(self.store, "meta.json"))
        for name in paths:
            if name in old:
                shutil.rmtree(old[name], ignore_errors=True)

    # ---- building ----

    def index(self, force: bool = False) -> dict[str, int]:
        """Parses what is new or changed, keeps the rest, resolves all references, and returns counts. Unchanged trees are left as they are."""
        files = repository.hashed(repository.scan(self.spark, self.root, self.scopes, [*self.excludes, ".grafwerk/"]))
        known = None if force or not self._meta() else self.table("files")
        todo = files if known is None else repository.changed(files, known)
        found = extract(todo.select("path", "language", "text")).join(files.select("path", "language"), "path")
        if known is not None:
            gone = files.select("path").join(todo.select("path"), "path", "left_anti")  # unchanged ones stay
            kept = self.table("extracted").join(gone, "path", "left_semi")
            found = kept.unionByName(found)
        status = found.groupBy("path").agg(F.when(F.max((F.col("record") == "failed").cast("int")) == 1, "failed").otherwise("ok").alias("parse_status"))
        self._save({"extracted": found, "files": files.drop("text").join(status, "path", "left")})
        found = self.table("extracted")
        symbols = self._symbols(found)
        self._save({"symbols": symbols})
        symbols = self.table("symbols")
        self._save({"edges": resolve.resolve(self._refs(found, symbols), symbols, symbols.filter("kind = 'file'").select("path", "symbol_id"))})
        edges = self.table("edges")
        ranks = analytics.pagerank(symbols.select(F.col("symbol_id").alias("id")), edges)
        self._save({"ranks": ranks, "communities": analytics.communities(analytics.weighted_pairs(edges))})
        return health.totals(symbols, edges).first().asDict()

    @staticmethod
    def _symbols(found: DataFrame) -> DataFrame:
        s = resolve.overload_ordinals(found.filter("record = 'sym'"))
        ident = F.substring(F.sha2(F.concat_ws("\u0000", "path", "fqn", "kind", F.col("ordinal").cast("string")), 256), 1, 20)
        return s.withColumn("symbol_id", ident).drop("record", "reason", "ordinal").withColumnRenamed("parent", "parent_fqn")

    @staticmethod
    def _refs(found: DataFrame, symbols: DataFrame) -> DataFrame:
        """References with an id and their owner: the symbol of the source's fqn in the file, if there is exactly one."""
        owner = symbols.filter("kind <> 'file'").groupBy("path", "fqn").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("src")).filter("n = 1").drop("n")
        r = found.filter("record = 'ref'").join(owner, ["path", "fqn"], "left")
        ident = F.sha2(F.concat_ws("\u0000", "path", "kind", "name", "fqn", F.col("start_line").cast("string"), F.col("start_col").cast("string")), 256)
        return r.select(ident.alias("ref_id"), "kind", "src", F.col("name").alias("dst_name"), "path", "language", F.col("start_line").alias("line"), F.col("start_col").alias("col")).dropDuplicates(["ref_id"])

    # ---- asking ----

    @property
    def symbols(self) -> DataFrame:
        return self.table("symbols").join(self.table("ranks").withColumnRenamed("id", "symbol_id"), "symbol_id", "left")

    @property
    def edges(self) -> DataFrame:
        return self.table("edges")

    def freshness(self) -> DataFrame:
        """path, state of files that differ from the index by their stats."""
        return health.drift(self.table("files"), repository.scan(self.spark, self.root, self.scopes, [*self.excludes, ".grafwerk/"], contents=False))

    def _answer(self, rows: DataFrame, limit: int | None = None) -> Answer:
        stale = not self.freshness().isEmpty()
        return Answer(rows, fresh=not stale, truncated=limit is not None and rows.count() >= limit, warnings=["files changed since the index was built"] if stale else [])

    def _seed(self, selector: str) -> DataFrame:
        return self.spark.createDataFrame([(search.select_symbol(self.symbols, selector),)], "id string")

    def _named(self, rows: DataFrame, column: str) -> DataFrame:
        return rows.join(self.table("symbols").select(F.col("symbol_id").alias(column), "fqn", "kind", "path", "start_line"), column)

    def find(self, query: str, kind: str | None = None, limit: int = 10) -> Answer:
        return self._answer(search.find(self.symbols, query, kind, limit).select("fqn", "kind", "path", "start_line", "signature", "rank"), limit)

    def symbol_info(self, selector: str) -> dict:
        """The symbol's card: its row, its children, how many callers, callees and references, its community."""
        ident = search.select_symbol(self.symbols, selector)
        card = self.symbols.filter(F.col("symbol_id") == ident).first().asDict()
        counts = health.degree_counts(self.edges).filter(F.col("id") == ident).first()
        community = self.table("communities").filter(F.col("id") == ident).first()
        children = [r.fqn for r in self.symbols.filter((F.col("parent_fqn") == card["fqn"]) & (F.col("path") == card["path"])).orderBy("start_line").collect()]
        return card | {"children": children, "community": community.community if community else None} | {k: counts[k] if counts else 0 for k in ("callers", "callees", "refs")}

    def references(self, selector: str, kind: str | None = None, limit: int = 60) -> Answer:
        e = self.edges.join(self._seed(selector).withColumnRenamed("id", "dst"), "dst", "left_semi")
        e = e if kind is None else e.filter(F.col("kind") == kind)
        return self._answer(e.orderBy("path", "line", "col").limit(limit), limit)

    def callers(self, selector: str, depth: int = 1) -> Answer:
        return self._answer(self._named(traverse.call_walk(self.edges, self._seed(selector), depth), "src"))

    def callees(self, selector: str, depth: int = 1) -> Answer:
        walk = traverse.call_walk(self.edges, self._seed(selector), depth, forward=True)
        return self._answer(walk.join(self.table("symbols").select(F.col("symbol_id").alias("dst"), "fqn"), "dst", "left"))

    def impact(self, selector: str, depth: int = 3) -> Answer:
        hit = self._named(traverse.impact(self.edges, self._seed(selector), depth), "id").join(self.table("ranks"), "id", "left")
        return self._answer(hit.withColumn("confidence", confidence_name(F.col("conf"))).orderBy("depth", F.desc("rank"), "fqn"))

    def reaches(self, selector: str, sink: str, via: str | None = None, depth: int = 8, max_paths: int = 20) -> Answer:
        return self._answer(traverse.reaches(self.edges, self._seed(selector), sink, via, depth, max_paths), max_paths)

    def ego_graph(self, selector: str) -> Answer:
        return self._answer(traverse.ego(self.edges, search.select_symbol(self.symbols, selector)))

    def change_impact(self, target: str, depth: int = 3) -> Answer:
        return self._answer(self._named(traverse.change_impact(self.edges, self.table("symbols"), repository.diff_paths(target), depth), "id"))

    def affected_modules(self, target: str, depth: int = 3) -> Answer:
        hit = self.change_impact(target, depth).rows
        return self._answer(hit.groupBy("path").agg(F.count(F.lit(1)).alias("symbols"), F.min("depth").alias("depth")).orderBy("depth", F.desc("symbols"), "path"))

    def related_tests(self, selector: str, depth: int = 3) -> Answer:
        return self._answer(traverse.related_tests(self.edges, self.table("symbols"), self._seed(selector), depth).orderBy("depth", "path", "fqn"))

    def explain(self, selector: str, top: int = 5) -> dict:
        name = lambda a, c: [r[0] for r in a.rows.filter(F.col("fqn").isNotNull()).select("fqn").distinct().orderBy("fqn").limit(top).collect()]
        return self.symbol_info(selector) | {"called_by": name(self.callers(selector), "fqn"), "calls": name(self.callees(selector), "fqn")}

    def suggest_files(self, task: str, limit: int = 8) -> Answer:
        return self._answer(search.suggest_files(self.symbols, task, limit), limit)

    def overview(self, token_budget: int = 1200, top: int = 6) -> Answer:
        w = Window.partitionBy("path").orderBy(F.desc("rank"), "fqn")
        best = self.symbols.filter("kind <> 'file'").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top)
        shown = F.length(F.when(F.col("signature") != "", F.col("signature")).otherwise(F.col("name"))) + 12
        return self._answer(search.overview(best.groupBy("path").agg(F.max("rank").alias("score"), (F.length(F.first("path")) + F.sum(shown)).alias("cost")), token_budget * 4))

    def communities(self, limit: int = 20, min_size: int = 3) -> Answer:
        return self._answer(analytics.community_summary(self.table("communities"), self.table("symbols"), self.table("ranks"), limit, min_size), limit)

    def _flows(self, rules: flows.Rules) -> DataFrame:
        files = repository.hashed(repository.scan(self.spark, self.root, self.scopes, [*self.excludes, ".grafwerk/"]))
        return flows.flow_table(files.select("path", "language", "text"), rules)

    def rules(self) -> flows.Rules:
        """The default rules with the additions and removals of .grafwerk/taint.json."""
        f = Path(self.root, ".grafwerk", "taint.json")
        data = json.loads(f.read_text()) if f.is_file() else {}
        return flows.Rules().changed(data.get("add"), data.get("remove"))

    def _calls_by_name(self) -> DataFrame:
        name = lambda c: self.table("symbols").select(F.col("symbol_id").alias(c), F.col("fqn").alias(f"{c}_fqn"))
        return self.edges.join(name("src"), "src").join(name("dst"), "dst").select("kind", F.col("src_fqn").alias("src"), F.col("dst_fqn").alias("dst"), "dst_name", "line", "conf")

    def taint(self, depth: int = 3, max_findings: int = 100) -> Answer:
        rules = self.rules()
        answer = self._answer(taint.taint(self._flows(rules), self._calls_by_name(), rules, depth, max_findings), max_findings)
        answer.warnings.append("findings are may-taint")
        return answer

    def data_flow(self, selector: str) -> Answer:
        fqn = self.symbols.filter(F.col("symbol_id") == search.select_symbol(self.symbols, selector)).first().fqn
        rules = self.rules()
        return self._answer(taint.data_flow(self._flows(rules), fqn, rules))

    def stats(self) -> dict:
        return health.totals(self.table("symbols"), self.edges).first().asDict() | {"languages": {r.language: r.n for r in self.table("files").groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()}}

    def doctor(self, failed_limit: int = 20) -> dict:
        files = self.table("files")
        failed = files.filter("parse_status = 'failed'")
        return self.stats() | {"confidence": {r.confidence: r.pct for r in health.by_confidence(self.edges).collect()}, "failed": failed.count(), "failed_sample": [r.path for r in failed.orderBy("path").limit(failed_limit).collect()], "drifted": self.freshness().count()}

    def diagnose(self, path: str) -> str | None:
        """Why a file's parser failed, or None."""
        row = self.table("extracted").filter((F.col("path") == path) & (F.col("record") == "failed")).first()
        return row.reason if row else None

    def compact(self) -> dict[str, int]:
        size = lambda: sum(f.stat().st_size for f in Path(self.store).rglob("*") if f.is_file())
        before = size()
        self.index(force=True)
        live = {Path(p).name for p in self._meta()["tables"].values()}
        import shutil

        for f in Path(self.store).iterdir():
            if f.is_dir() and f.name not in live:
                shutil.rmtree(f)
        return {"before": before, "after": size()}

    def describe(self, selector: str, provider) -> str:
        """provider(system, user) on the symbol's card, kept until its signature changes."""
        card = self.symbol_info(selector)
        cache = Path(self.store, "descriptions.json")
        kept = json.loads(cache.read_text()) if cache.is_file() else {}
        mark = [card["signature"], card["start_line"], card["end_line"]]
        if kept.get(card["symbol_id"], {}).get("mark") != mark:
            kept[card["symbol_id"]] = {"mark": mark, "text": provider("Describe this symbol in two sentences.", json.dumps(card, default=str))}
            cache.write_text(json.dumps(kept))
        return kept[card["symbol_id"]]["text"]

    def visualize(self, mode: str = "files", selector: str | None = None, depth: int = 2, top: int = 250, min_conf: int = 0) -> dict:
        """{nodes, links} of a map of files, of the symbols near one, or of communities."""
        if mode == "files":
            links = health.file_pairs(self.edges.filter(F.col("conf") >= min_conf), self.table("symbols")).orderBy(F.desc("weight"), "a", "b").limit(top)
        elif mode == "domains":
            of = self.table("communities")
            ends = self.edges.filter("src IS NOT NULL AND dst IS NOT NULL").join(of.select(F.col("id").alias("src"), F.col("community").cast("string").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("community").cast("string").alias("b")), "dst")
            links = ends.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), F.max("conf").alias("conf")).orderBy(F.desc("weight"), "a", "b").limit(top)
        else:
            near = traverse.neighbourhood(self.edges, self._seed(selector), depth, min_conf)
            name = lambda c: self.table("symbols").select(F.col("symbol_id").alias(c), F.col("fqn").alias(c + "_"))
            links = near.join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_").alias("a"), F.col("dst_").alias("b"), F.col("n").alias("weight"), "conf", "kind").orderBy(F.desc("weight"), "a", "b").limit(top)
        rows = [r.asDict() for r in links.collect()]
        return {"nodes": sorted({r[k] for r in rows for k in "ab"}), "links": rows}


def to_html(data: dict) -> str:
    """A page with the map as tables and as JSON that can't end its script element."""
    payload = json.dumps(data, default=str).replace("<", "\\u003c")
    rows = "".join(f"<tr><td>{escape(str(r['a']))}<td>{escape(str(r['b']))}<td>{r['weight']}" for r in data["links"])
    return f"<!DOCTYPE html><meta charset=utf-8><title>graph</title><table>{rows}</table><script type=application/json id=graph>{payload}</script>"


def capabilities() -> list[dict]:
    """What there is for each language: symbols, references, resolution, data flow."""
    return [{"language": x, "symbols": True, "references": x not in ("markdown", "json", "yaml", "toml"), "dedicated_parser": x in PARSERS, "data_flow": x == "python"} for x in repository.LANGUAGES]
