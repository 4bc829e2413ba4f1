"""A source tree as relations: scan, scope, ignore rules, languages, hashes and incremental upserts."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MAX_FILE_BYTES

LANGUAGES: dict[str, tuple[str, ...]] = {
    "python": ("py", "pyi"), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "javascript": ("js", "jsx", "mjs", "cjs"), "java": ("java",), "go": ("go",), "rust": ("rs",),
    "c": ("c",), "cpp": ("h", "hpp", "hh", "hxx", "cc", "cpp", "cxx"), "cuda": ("cu", "cuh"), "csharp": ("cs",), "kotlin": ("kt", "kts"), "php": ("php",), "ruby": ("rb", "rake"), "lua": ("lua",), "luau": ("luau",),
    "swift": ("swift",), "scala": ("scala", "sc"), "clojure": ("clj", "cljs", "cljc"), "terraform": ("tf", "tfvars", "hcl"), "html": ("html", "htm"), "css": ("css",), "scss": ("scss",), "markdown": ("md", "markdown"),
    "json": ("json",), "yaml": ("yaml", "yml"), "toml": ("toml",), "zig": ("zig",), "elixir": ("ex", "exs"), "sql": ("sql",), "bash": ("sh", "bash"), "dart": ("dart",), "vue": ("vue",), "svelte": ("svelte",), "haskell": ("hs",),
    "ocaml": ("ml", "mli"), "julia": ("jl",), "r": ("r",), "perl": ("pl", "pm"), "erlang": ("erl",), "fsharp": ("fs",), "groovy": ("groovy",), "nim": ("nim",), "objc": ("m", "mm"), "powershell": ("ps1",), "solidity": ("sol",),
}
EXTENSIONS = {e: lang for lang, all_ in LANGUAGES.items() for e in all_}
DEFAULT_IGNORES = (".git/", "node_modules/", "__pycache__/", ".venv/", "venv/", "dist/", "build/", "target/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".idea/", ".vscode/", "vendor/", "*.min.js")


def language_of(path: Column) -> Column:
    """The language of a path's extension, or null."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for e in EXTENSIONS.items() for x in e]), ext)


def module_of(path: Column) -> Column:
    """a/b/c.py -> a.b.c; an __init__ is its package."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit(".")), r"\.__init__$", "")


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Equal to a prefix or under it; no scopes, everything."""
    if not scopes:
        return F.lit(True)
    out = F.lit(False)
    for s in scopes:
        out = out | (path == s.rstrip("/")) | path.startswith(s.rstrip("/") + "/")
    return out


def glob_regex(pattern: str) -> str:
    """A regular expression for one gitignore-like pattern."""
    folder = pattern.endswith("/")
    p = pattern.strip("/")
    anchored = "/" in p or pattern.startswith("/")
    out, k = "", 0
    while k < len(p):
        if p.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif p.startswith("**", k):
            out, k = out + ".*", k + 2
        elif p[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif p[k] == "?":
            out, k = out + "[^/]", k + 1
        elif p[k] == "[" and "]" in p[k:]:
            end = p.index("]", k)
            out, k = out + "[" + p[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, k = out + re.escape(p[k]), k + 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches ignores the path; a leading ! takes a match back."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        if p.startswith("!"):
            out = out & ~path.rlike(glob_regex(p[1:]))
        else:
            out = out | path.rlike(glob_regex(p))
    return out


def safe_relative(path: str) -> str | None:
    """The path without a leading ./, or None if it is absolute or leaves the root."""
    p = path.strip().replace("\\", "/").removeprefix("./")
    if not p or p.startswith("/") or re.match(r"^[A-Za-z]:", p) or ".." in PurePosixPath(p).parts:
        return None
    return p


def ignore_rules(root: str, extra: list[str] | None = None) -> list[str]:
    rules = [*DEFAULT_IGNORES]
    for name in (".gitignore",):
        f = Path(root, name)
        if f.is_file():
            rules += f.read_text(errors="replace").splitlines()
    return rules + (extra or [])


def _filesystem(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def scan(spark: SparkSession, root: str, scopes: list[str] | None = None, excludes: list[str] | None = None, contents: bool = True) -> DataFrame:
    """path, language, size, mtime_ns, and content where asked: the files of a tree that have a language and may be indexed.

    Tasks list the folders beneath the root's, and read only what is left after all filters. (Spark's own file sources pass
    over names that begin with _ or a dot, among them package initialisers.)
    """
    from pyarrow import fs

    system, base = _filesystem(root.rstrip("/"))
    top = system.get_file_info(fs.FileSelector(base))
    folders = sorted(f.path for f in top if f.type == fs.FileType.Directory)
    flat = [(f.path, f.size, f.mtime_ns) for f in top if f.type == fs.FileType.File]
    where = root.rstrip("/")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, _ = _filesystem(where)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in on.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([f.path for f in found], pa.string()), pa.array([f.size for f in found], pa.int64()), pa.array([f.mtime_ns for f in found], pa.int64())], names=["full", "size", "mtime_ns"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, _ = _filesystem(where)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                data = []
                for path in some.column("full").to_pylist():
                    with on.open_input_file(path) as f:
                        data.append(f.read())
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("path", "size", "mtime_ns", "language")], pa.array(data, pa.binary())], names=["path", "size", "mtime_ns", "language", "content"])

    schema = "full string, size long, mtime_ns long"
    files = spark.createDataFrame(flat, schema)
    if folders:
        files = files.union(spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), 256)).mapInArrow(walk, schema))
    rel = F.substring("full", len(base) + 2, 1 << 20)
    rows = files.select("full", rel.alias("path"), "size", "mtime_ns").withColumn("language", language_of(F.col("path")))
    kept = rows.filter(F.col("language").isNotNull() & (F.col("size") <= MAX_FILE_BYTES) & in_scope(F.col("path"), scopes or []) & ~ignored(F.col("path"), ignore_rules(root, excludes)))
    return kept.mapInArrow(read, "path string, size long, mtime_ns long, language string, content binary") if contents else kept.select("path", "size", "mtime_ns", "language")


def hashed(files: DataFrame) -> DataFrame:
    """files with text and content_hash in the place of content."""
    return files.withColumn("content_hash", F.sha2("content", 256)).withColumn("text", F.col("content").cast("string")).drop("content")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of files (path, content_hash) that known doesn't have with the same hash."""
    return files.join(known.select("path", F.col("content_hash").alias("_known")), "path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("_known"))).drop("_known")


def diff_paths(target: str) -> list[str]:
    """The safe, sorted paths of a unified diff, or of a list with one a line."""
    found = re.findall(r"^(?:\+\+\+|---) [ab]/(\S+)", target, re.M) or ([] if target.lstrip().startswith("diff ") else target.split())
    return sorted({p for p in map(safe_relative, found) if p and p != "dev/null"})


def git_changed(root: str, ref: str | None = None) -> list[str]:
    """Paths that differ from ref (or from the index), and untracked ones."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.splitlines()
    return sorted({p for p in map(safe_relative, run("diff", "--name-only", *([ref] if ref else [])) + run("ls-files", "--others", "--exclude-standard")) if p})
