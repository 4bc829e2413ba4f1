"""Quality rules: document statistics, hard limits, and gradient-boosted trees with monotonic constraints.

Statistics of whole texts are made in numpy over Arrow buffers, in one pass. The trees are fitted on at most
LABELLED labelled documents (those whose ids have the lowest hashes), flattened into node arrays and scored
for all rows of a batch at once. The chance of low quality never falls as a constrained feature rises.

Repeats within a text are found by 64-bit hashes of lines and of windows of WINDOW words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, mix, row_sums, span_hashes, text_chunks, tidy, words_of, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words
LABELLED = 20_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_digits", "n_punct", "n_lines", "n_letters"]
#: name -> 1 where a higher value may only raise the chance of low quality, 0 where the trees are free.
FEATURES = {"symbols_a_word": 1, "dup_line_share": 1, "repeat_share": 1, "upper_share": 0, "digit_share": 0, "punct_a_word": 0, "letter_share": 0, "word_length": 0, "words_a_line": 0, "log_words": 0}


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOLS = _flags(b"#*$%&|<>")
_UPPER = _flags(bytes(range(65, 91)))
_DIGITS = _flags(bytes(range(48, 58)))
_PUNCT = _flags(b"!?.,;:'\"()[]{}-_/\\=+~^`@")
_LETTERS = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC0, 256)))
_LEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_WORD_LEAD = _LEAD & ~SPACE


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def statistics(raw: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """BASE and MORE of each row of a chunk."""
    n = len(off) - 1
    start, end, row = words_of(raw, off)
    out = {"n_words": np.bincount(row, minlength=n).astype(np.int64)}
    for name, table in (("word_chars", _WORD_LEAD), ("n_symbols", _SYMBOLS), ("n_upper", _UPPER), ("n_digits", _DIGITS), ("n_punct", _PUNCT), ("n_letters", _LETTERS)):
        out[name] = row_sums(table[raw], off)
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    # lines that hold a word
    breaks = np.flatnonzero(raw == 10)
    first = np.unique(np.concatenate([off[:-1][off[:-1] < off[1:]], breaks + 1]))
    first = first[first < len(raw)]
    ends = np.append(first[1:], len(raw))
    if len(first):
        ends = ends - ((raw[ends - 1] == 10) & (ends > first))
        held = np.searchsorted(start, ends) > np.searchsorted(start, first)
        first, ends = first[held], ends[held]
    line_row = np.searchsorted(off, first, "right") - 1
    keys = span_hashes(raw, first, ends) ^ salt[line_row] if len(first) else np.zeros(0, np.uint64)
    _, once = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(line_row, minlength=n).astype(np.int64)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[once], minlength=n)
    # words in windows that occur twice
    out["n_repeat_words"] = np.zeros(n, np.int64)
    m = len(start) - WINDOW + 1
    if m > 0:
        w = span_hashes(raw, start, end)
        g = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            g = g * np.uint64(0x9DDFEA08EB382D69) + w[k : k + m]
        inside = row[:m] == row[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        at = at[_repeated(mix(g[at]) ^ salt[row[at]])]
        if len(at):
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            hit = np.cumsum(cover)[:-1] > 0
            out["n_repeat_words"] = np.bincount(row[hit], minlength=n).astype(np.int64)
    return out


_STATISTICS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row; a null text counts as empty, other columns are ignored, rows with one doc_id stay apart."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, off in text_chunks(batch.column(1)):
                found = statistics(raw, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *[pa.array(found[c].astype(np.int64)) for c in BASE + MORE]], names=["doc_id", *BASE, *MORE])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(measure), _STATISTICS)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    f = {k: v.astype(np.float64) for k, v in s.items()}
    words, chars, lines = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1), np.maximum(f["n_lines"], 1)
    columns = {
        "symbols_a_word": f["n_symbols"] / words, "dup_line_share": f["n_dup_lines"] / lines, "repeat_share": f["n_repeat_words"] / words, "upper_share": f["n_upper"] / chars, "digit_share": f["n_digits"] / chars,
        "punct_a_word": f["n_punct"] / words, "letter_share": f["n_letters"] / chars, "word_length": f["word_chars"] / words, "words_a_line": f["n_words"] / lines, "log_words": np.log1p(f["n_words"]),
    }
    return np.stack([columns[k] for k in FEATURES], axis=1)


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, penalty: float = 1.0, least: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss on histograms.

    A split on a constrained feature must leave the left value at or below (1) or above (-1) the right one, and the
    midpoint then bounds all values beneath, so that each tree, and their sum, is monotonic. With one class only, or no
    rows, there are no trees.
    """
    node: list[list[float]] = []
    roots: list[int] = []
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.0001
    base = float(np.log(share / (1 - share)))
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(node)
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-gs / (hs + penalty), low, high))
            node.append([0, np.inf, at, at, rate * value])
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level and len(rows) >= 2:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
                    loss = lambda v, a, b: -(a * v + 0.5 * (b + penalty) * v * v)
                    gain = loss(vl, gl, hl) + loss(vr, gr, hr) - loss(value, gs, hs)
                    ok = (hl * 4 >= least) & (hr * 4 >= least) & (monotone[j] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -1.0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
            if best[1] >= 0:
                _, j, k, vl, vr = best
                left = binned[rows, j] <= k
                middle = (vl + vr) / 2
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
                a = grow(rows[left], g, h, level - 1, *bounds[0])
                b = grow(rows[~left], g, h, level - 1, *bounds[1])
                node[at] = [j, float(cuts[j][k]), a, b, 0.0]
            return at

        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-margin))
            first = len(node)
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
            one = Trees(*[np.array([r[k] for r in node[first:]]) - (first if k in (2, 3) else 0) for k in range(5)], np.array([0]), depth, 0.0)
            one.feature, one.left, one.right = (a.astype(np.int64) for a in (one.feature, one.left, one.right))
            margin += one.margin(x)
    columns = [np.array([r[k] for r in node]) for k in range(5)]
    return Trees(columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4], np.array(roots, np.int64), depth, base)


def labelled_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most bound rows (doc_id, label), those with the lowest hashes of doc_id; nulls dropped, of several labels the largest."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def train(measured: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Trees:
    rows = measured.join(F.broadcast(labelled_sample(labels, "quality", bound)), "doc_id").dropDuplicates(["doc_id"]).limit(bound).toPandas().sort_values("doc_id")
    x = features({c: rows[c].to_numpy() for c in BASE + MORE})
    return fit_trees(x, 1.0 - rows["label"].to_numpy(np.float64), list(FEATURES.values()))


def judge(documents: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = LABELLED) -> DataFrame:
    """doc_id, BASE, base_failed, low_quality (the trees' chance) and kept, one row per row of documents.

    base_failed: fewer than LEAST_WORDS words, or more than MOST_REPEATED per cent of the words repeated; such a document
    isn't kept. Else kept is low_quality < threshold. Without labels of both classes all others are kept. A null or empty
    text has no words and fails. An empty table gives an empty result.
    """
    measured = written(document_statistics(documents), "quality-statistics")
    trees = train(measured, labels, bound)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, low_quality double, kept boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {c: batch.column(c).to_numpy() for c in BASE + MORE}
            failed = (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])
            chance = trees.chance(features(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[batch.column(c) for c in BASE], pa.array(failed), pa.array(chance), pa.array(~failed & (chance < threshold))], names=["doc_id", *BASE, "base_failed", "low_quality", "kept"])

    return measured.mapInArrow(tidy(score), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
