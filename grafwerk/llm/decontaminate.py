"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact similarity.

Words are runs of letters and digits of the lower-cased text; of scripts written without spaces each letter is a word. A
window's features are its SHINGLE-word shingles, weighted by the length of their words; an item of fewer words is one shingle of
them all, and its windows are of that many words. Windows have the length of an item and are placed wherever a document and
the item share a shingle, in line with it: a window that shares none has similarity 0 with every item.

A window's fingerprint of BITS bits is looked up in BLOCKS blocks of 16 bits. Of two fingerprints within RADIUS, some block
differs by RADIUS // BLOCKS bits at most, so the items filed under all values that near hold every item within RADIUS. A
block's neighbourhood is 137 of 65,536 values. Of the items within RADIUS, those with weighted Jaccard similarity of THRESHOLD
or more are reported. Two bags of that
similarity have fingerprints that differ by about 0.17 * BITS bits; of pairs just above it, 0.91 lie within RADIUS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, span_hashes, text_chunks, tidy, written

SHINGLE = 3
BITS = 1024
BLOCKS = BITS // 16
RADIUS = 3 * BLOCKS - 1
THRESHOLD = 0.8
ITEMS_A_BLOCK = 20_000
FEATURES_A_STEP = 1 << 10  # of windows fingerprinted at a time, of BITS votes each: some 10 KB a feature with the copies

_A = np.uint64(0x9DDFEA08EB382D69)
_WORDS = np.zeros(256, bool)
_WORDS[[*range(48, 58), *range(97, 123), *range(0x80, 256)]] = True
_NEAR = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i in range(16) for j in range(i))], np.int64)


def _dense_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of letters of scripts written without spaces: Thai to Khmer, kana, Chinese characters, and their like."""
    first = np.zeros(len(raw), bool)
    at = np.flatnonzero(raw >= 0xE0)
    at = at[at + 2 < len(raw)]
    lead, second = raw[at], raw[at + 1]
    thai = (lead == 0xE0) & (second >= 0xB8) & (second < 0xBC)
    khmer = (lead == 0xE1) & (((second >= 0x80) & (second < 0x83)) | ((second >= 0x9E) & (second < 0xA0)))
    east = (lead == 0xE3) & (second >= 0x81) | (lead > 0xE3) & (lead < 0xEA) | (lead == 0xEF) & (second >= 0xA4) & (second < 0xAC) | (lead == 0xF0) & (second >= 0xA0)
    first[at[thai | khmer | east]] = True
    return first


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, length in bytes, row) of the words of lower-cased texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = _WORDS[raw]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner], end[inner - 1] = word[inner], word[inner - 1]
    dense = np.flatnonzero(_dense_starts(raw)) if (raw >= 0xE0).any() else []
    if len(dense):  # a word begins at each of them and behind each
        behind = dense + np.where(raw[dense] >= 0xF0, 4, 3)
        for at in (dense, behind[behind < n]):
            start[at] = word[at]
            before = at[at > 0]
            end[before - 1] = word[before - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return span_hashes(raw, s, e), e - s, np.searchsorted(off, s, "right") - 1


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of the shingle that begins at each word but the last SHINGLE - 1, whatever the rows."""
    m = len(hashes) - SHINGLE + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, w = np.zeros(m, np.uint64), np.zeros(m, np.int64)
    for k in range(SHINGLE):
        g = g * _A + hashes[k : k + m]
        w = w + lengths[k : k + m]
    return mix(g), w


def _short(hashes: np.ndarray, lengths: np.ndarray, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, weight) of the runs of `width` words, fewer than SHINGLE (all words, if not given), told from whole shingles."""
    width = width or len(hashes)
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, w = np.full(m, width, np.uint64), np.zeros(m, np.int64)
    for k in range(width):
        g = g * _A + hashes[k : k + m]
        w = w + lengths[k : k + m]
    return mix(g ^ np.uint64(0x6A09E667F3BCC909)), w


def _signs(features: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of BITS bits of each feature."""
    both = np.stack([mix(features ^ np.uint64(0xA5A5A5A5A5A5A5A5 + 977 * k)) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprints(features: np.ndarray, weights: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Packed SimHash of each run edges[i]:edges[i + 1] of features, FEATURES_A_STEP of them at a time, however long a run is."""
    out = np.zeros((len(edges) - 1, BITS // 8), np.uint8)
    k = 0
    while k < len(edges) - 1:
        end = max(k + 1, int(np.searchsorted(edges, edges[k] + FEATURES_A_STEP, "right")) - 1)
        sums = np.zeros((end - k, BITS), np.float32)
        for low in range(int(edges[k]), int(edges[end]), FEATURES_A_STEP):
            high = min(low + FEATURES_A_STEP, int(edges[end]))
            cut = np.clip(edges[k:end], low, high) - low
            some = np.flatnonzero(np.diff(np.append(cut, high - low)))
            sums[some] += np.add.reduceat(_signs(features[low:high]).astype(np.float32) * weights[low:high, None].astype(np.float32), cut[some], axis=0)
        out[k:end] = np.packbits(sums > 0, axis=1)
        k = end
    return out


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard: sum of the smaller weights over the sum of the larger."""
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / ((sum(a.values()) + sum(b.values()) - common) or 1)


def _bag(features: np.ndarray, weights: np.ndarray) -> dict[int, int]:
    bag: dict[int, int] = {}
    for s, w in zip(features.tolist(), weights.tolist()):
        bag[s] = bag.get(s, 0) + w
    return bag


class Index:
    """Items of one block: shingle postings for placing windows, Hamming blocks for finding items."""

    def __init__(self, item_ids: list[int], texts: list[str | None]) -> None:
        column = pc.utf8_lower(pa.array(texts, pa.large_string()))
        self.item_ids: list[int] = []
        self.sizes: list[int] = []
        self.bags: list[dict[int, int]] = []
        prints, keys, items, places = [], [], [], []
        for first, _, raw, off in text_chunks(column):
            h, length, row = words(raw, off)
            edges = np.searchsorted(row, np.arange(len(off)))
            for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if b == a:
                    continue
                f, w = shingles(h[a:b], length[a:b]) if b - a >= SHINGLE else _short(h[a:b], length[a:b])
                keys.append(f)
                items.append(np.full(len(f), len(self.item_ids)))
                places.append(np.arange(len(f)))
                prints.append(fingerprints(f, w, np.array([0, len(f)]))[0])
                self.item_ids.append(item_ids[first + k])
                self.sizes.append(b - a)
                self.bags.append(_bag(f, w))
        if not self.item_ids:
            return
        self.prints = np.stack(prints)
        key, item, place = np.concatenate(keys), np.concatenate(items), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], item[order], place[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.key >> np.uint64(44)] = True
        value = self.prints.view(">u2").astype(np.int64)
        order = np.argsort(value, axis=0, kind="stable")
        self.filed = order.T.copy()  # of each block, items by value; first[b, v]:first[b, v + 1] are those of v
        self.first = np.stack([np.searchsorted(value[order[:, b], b], np.arange((1 << 16) + 1)) for b in range(BLOCKS)]).astype(np.int32)
        self.taken = np.diff(self.first, axis=1) > 0

    def near(self, prints: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint, all items within RADIUS."""
        values = prints.view(">u2").astype(np.int64)
        block = np.arange(BLOCKS)[:, None]
        out = []
        for k in range(len(prints)):
            probe = values[k][:, None] ^ _NEAR[None]
            b, p = np.nonzero(self.taken[block, probe])
            v = probe[b, p]
            low, high = self.first[b, v], self.first[b, v + 1]
            c = np.unique(np.concatenate([self.filed[x, i:j] for x, i, j in zip(b, low, high)])) if len(b) else np.zeros(0, np.int64)
            distance = np.bitwise_count(self.prints[c] ^ prints[k]).sum(axis=1)
            out.append(c[distance <= RADIUS])
        return out

    def matches(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int]]:
        """(row, item, similarity, first word) of the best window of each row and item that match."""
        if not self.item_ids:
            return []
        h, length, row = words(raw, off)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        edges = np.searchsorted(row, np.arange(len(off)))
        sizes = np.array(self.sizes)
        for width in (SHINGLE, *range(1, SHINGLE)):  # whole shingles, then items of fewer words
            mine = sizes >= SHINGLE if width == SHINGLE else sizes == width
            if not mine.any():
                continue
            f, w = shingles(h, length) if width == SHINGLE else _short(h, length, width)
            if not len(f):
                continue
            inside = row[: len(f)] == row[width - 1 :]
            at = np.flatnonzero(inside & self.seen[f >> np.uint64(44)])
            low, high = np.searchsorted(self.key, f[at], "left"), np.searchsorted(self.key, f[at], "right")
            count = high - low
            place = np.repeat(at, count)
            post = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            size = sizes[self.item[post]]
            r = row[place]
            begin, end = edges[r], edges[r + 1]
            start = np.maximum(begin, np.minimum(place - self.place[post], end - size))
            stop = np.minimum(end, start + size)
            on = stop - start >= width
            if not on.any():
                continue
            windows = np.unique(np.stack([r, start, stop], axis=1)[on], axis=0)
            n = windows[:, 2] - windows[:, 1] - width + 1
            upto = np.cumsum(n)
            k = 0
            while k < len(windows):
                last = max(k + 1, int(np.searchsorted(upto, upto[k] - n[k] + FEATURES_A_STEP, "right")))
                self._verified(windows[k:last], n[k:last], f, w, width, edges, best)
                k = last
        return [(r, i, s, -first) for (r, i), (s, first) in sorted(best.items())]

    def _verified(self, windows: np.ndarray, n: np.ndarray, f: np.ndarray, w: np.ndarray, width: int, edges: np.ndarray, best: dict) -> None:
        edge = np.concatenate([[0], np.cumsum(n)])
        if len(windows) > 1:
            index = np.repeat(windows[:, 1] - edge[:-1], n) + np.arange(edge[-1])
            prints = fingerprints(f[index], w[index], edge)
        else:
            a, b = windows[0, 1], windows[0, 1] + n[0]
            prints = fingerprints(f[a:b], w[a:b], edge)
        for j, items in enumerate(self.near(prints)):
            bag = None
            for item in items.tolist():
                if bag is None:
                    a, b = windows[j, 1], windows[j, 2] - width + 1
                    bag = _bag(f[a:b], w[a:b])
                s = similarity(self.bags[item], bag)
                key, first = (int(windows[j, 0]), item), int(windows[j, 1] - edges[windows[j, 0]])
                if s >= THRESHOLD and (s, -first) > best.get(key, (0.0, 0)):
                    best[key] = (s, -first)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word: one row per row of documents and item that it holds.

    Documents and items without words (null and empty texts too) match nothing; items of one or two words match where these
    stand. Texts and items of any length are searched whole. Equal items are each reported, also where they share an item_id; of
    a document and an item there is one row, that of the best window, of equal ones the first. A null doc_id or item_id is
    reported as null; rows with one doc_id stay apart. The benchmark is taken in blocks of about ITEMS_A_BLOCK items, each sent
    to the tasks of one pass over all documents; other columns are ignored, whatever their names.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-items.count() // ITEMS_A_BLOCK))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found: DataFrame | None = None
    for b in range(blocks):
        some = sorted(((r.item_id, r.text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect() if r.text), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        index = Index([i for i, _ in some], [t for _, t in some])

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for first, _, raw, off in text_chunks(pc.utf8_lower(batch.column(1).cast(pa.large_string()))):
                    m = index.matches(raw, off)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([first + x[0] for x in m], pa.int64())), pa.array([index.item_ids[x[1]] for x in m], pa.int64()), pa.array([x[2] for x in m], pa.float64()), pa.array([x[3] for x in m], pa.int64())],
                        names=["doc_id", "item_id", "similarity", "first_word"],
                    )

        one = rows.mapInArrow(tidy(run), "doc_id long, item_id long, similarity double, first_word long")
        found = one if found is None else found.union(one)
    return found


def clean(documents: DataFrame, benchmark: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """documents without those that hold an item; a null doc_id stays."""
    bad = written(contaminated(documents, benchmark).select("doc_id").filter("doc_id IS NOT NULL").distinct(), "contaminated")
    return documents.join(F.broadcast(bad) if bad.count() <= most_broadcast else bad, "doc_id", "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
