"""Shared helpers: tables, the cluster's shared folder, and vectorised work on Arrow text buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: The words of every operator are maximal runs of bytes outside this set.
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a temporary one of our own only where it is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="grafwerk-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage and survives lost executors. The driver is trimmed."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or a plain path; usable in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its worker gives freed memory back: idle workers stay beside the next stage's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def trim_driver(spark: SparkSession) -> str | None:
    """Gives back what the driver's JVM has freed outside its heap and its C library keeps; the JVM's words, null where it has no such command.

    Compiling the code of hundreds of plans leaves some 150 MB of it. The heap isn't touched.
    """
    context = spark.sparkContext
    java, array = context._jvm.java.lang, context._gateway.new_array
    try:
        of = java.Class.forName
        server = context._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kinds, values = array(java.Class, 4), array(java.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = of(kind)
        values[0] = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1] = "systemTrimNativeHeap"
        values[2], values[3] = array(java.Object, 0), array(java.String, 0)
        return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    except Py4JError:  # another JVM
        return None


# ---- vectorised text ---------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices a string column into runs of rows of about chunk_bytes (one row at least).

    Yields (first row, end row, uint8 bytes of the run, int64 offsets of its rows, from 0).
    A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count or column.type != pa.large_string() else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(off, off[first] + chunk_bytes, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of a run of rows; a row's edge ends a word."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[key] = p
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), in place where it can."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: tabulated bytes in a polynomial over Z/2^64, from prefix sums, then mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(raw) + 1)
    values = _LOWERED if lower else _BYTE
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.multiply(values[raw], up[: len(raw)], out=sums[1:])
    np.cumsum(sums, out=sums)
    h = (sums[end] - sums[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_LOWERED = _BYTE.copy()
_LOWERED[65:91] = _BYTE[97:123]


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a per-byte 0/1 or small integer array over the rows that off delimits."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]
