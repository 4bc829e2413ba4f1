"""Toxicity by lexicon induction: random walks from labelled seeds over a graph of positive pointwise mutual information.

Words are runs of letters, lower-cased and whole; scripts written without spaces give pairs of letters instead. A word whose
own share among toxic labelled documents isn't telling, but that holds a run of GRAM letters (its edges count as letters)
whose share is, takes that run's term: so inflected forms share statistics, and long words are read to their ends. All other
words are their own terms. What is counted over all documents is summed in each task first:

1. of labelled training documents: those that hold a word or a run of letters, by label. Terms that lean to toxic ones
   by LEAST_Z deviations and LEAST_ODDS or more, and stand in LEAST_SHARE of them, are the toxic seeds
2. occurrences of every term, and pairs of a toxic seed and any term within SPAN words. Nodes of the graph are the toxic seeds
   and the terms tied to them together (LEAST_PAIRS pairs, SHIFT of mutual information, TIED_Z deviations above chance); those of
   them that labelled documents show leaning to clean ones are the neutral seeds
3. pairs of nodes within SPAN words, which make the graph

No count of seeds, nodes or edges is fixed: they are tables. Node hashes go to the tasks that count pairs up to
MOST_BROADCAST; beyond, all pairs are counted and joined with the nodes, and the walks are joins, one a step. Below that a
step is a product in tasks over edges that lie by their end, or in the driver up to MOST_HELD edges.

Two walks with restart, from toxic and from neutral seeds (these with a chance of UNIFORM from anywhere), visit each node. Its
polarity is the toxic walk's share of the visits, from -1 to 1, and its weight the polarity times the log of how much more than
an average node the toxic walk visits it. A document's features are sums over its terms' weights; a logistic
curve, fitted on the labelled training rows of the sample, makes a score of them. Only rows with crc32(doc_id) mod 4 <> 2 are
learned from, at most LABELLED of them, those with the lowest hashes of doc_id. Language, source and id are inputs of nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, span_hashes, text_chunks, tidy, written

GRAM = 4
SPAN = 4
PIECE = 1 << 18  # bytes of text at a time; the arrays of a piece are 8 times as long, and some ten live at once
LABELLED = 50_000
MOST_BROADCAST = 2_000_000  # terms sent to tasks
MOST_HELD = 2_000_000  # edges walked over in the driver
LEAST_Z = 5.0
LEAST_SHARE = 0.005  # of the toxic training documents: rarer terms are no evidence at any size
LEAST_ODDS = 2.0, 3.0  # natural log: of a word, of a run of letters (which stands in other words too)
LEAST_PAIRS = 4
TIED_Z = 4.0
SHIFT = 1.0  # natural log: pairs three times as often as by chance
RESTART = 0.3
UNIFORM = 0.01
STEPS = 60
PREDICT_AT = 0.3

_A = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _DENSE = np.zeros(0x40000, bool), np.zeros(0x40000, bool)
_LETTER[[*range(97, 123), 0xAA, 0xB5, 0xBA]] = True
_LETTER[0xC0:] = True
for _low, _high in ((0xD7, 0xD8), (0xF7, 0xF8), (0x2000, 0x2070), (0x20A0, 0x2C00), (0x3000, 0x3005), (0x3007, 0x3021), (0xE000, 0xF900), (0xFE00, 0xFE70), (0xFF00, 0xFF21), (0xFF3B, 0xFF41), (0xFF5B, 0xFF66), (0x1F000, 0x20000)):
    _LETTER[_low:_high] = False
for _low, _high in ((0xE00, 0xF00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000)):
    _DENSE[_low:_high] = True


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first and end code point) of each word of lower-cased texts, in order, and the code points."""
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    none = np.zeros(0, np.int64)
    if not len(cp):
        return none.astype(np.uint64), none, none, none, cp
    lead = np.arange(len(raw) + 1) if len(cp) == len(raw) else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    low = np.minimum(cp, 0x3FFFF)
    letter = _LETTER[low]
    dense = _DENSE[low] & letter
    edge = np.zeros(len(cp) + 1, bool)
    edge[np.searchsorted(lead, off)] = True
    start, end = letter.copy(), letter.copy()
    joined = letter[:-1] & letter[1:] & ~edge[1:-1] & ~dense[:-1] & ~dense[1:]
    start[1:] &= ~joined
    end[:-1] &= ~joined
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    pair = dense[s] & (e < len(cp))
    pair[pair] &= dense[e[pair]] & ~edge[e[pair]]
    e = e + pair  # two letters of a script without spaces
    return span_hashes(raw, lead[s], lead[e]), np.searchsorted(off, lead[s], "right") - 1, s, e, cp


def grams(s: np.ndarray, e: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of the runs of GRAM letters of words of GRAM - 1 letters or more, with an edge before and after each word."""
    some = np.flatnonzero(e - s >= GRAM - 1)
    n = (e - s)[some] + 2
    at = np.cumsum(n) - n
    letters = np.zeros(int(n.sum()), np.uint64)  # 0: an edge
    inside = np.repeat(s[some] - 1 - at, n) + np.arange(len(letters))
    ok = np.ones(len(letters), bool)
    ok[at], ok[at + n - 1] = False, False
    letters[ok] = cp[inside[ok]]
    g = np.zeros(max(0, len(letters) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        g = g * _A + letters[k : k + len(g)] + np.uint64(1)
    of = np.repeat(some, n)
    same = of[: len(g)] == of[GRAM - 1 :]
    return mix(g[same] ^ np.uint64(0x5851F42D4C957F2D)), of[: len(g)][same]


class Terms:
    """The term of each word: the word, or the most telling of its runs of letters."""

    def __init__(self, hot: np.ndarray, lean: np.ndarray) -> None:
        order = np.argsort(hot)
        self.hot, self.lean = hot[order], lean[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hot >> np.uint64(44)] = True

    def of(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of the terms of lower-cased texts, in order."""
        h, row, s, e, cp = words(raw, off)
        if not len(self.hot) or not len(h):
            return h, row
        g, of = grams(s, e, cp)
        some = np.flatnonzero(self.seen[g >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hot, g[some]), len(self.hot) - 1)
        hit = self.hot[at] == g[some]
        at, of = at[hit], of[some[hit]]
        whole = _within(h[of], self.hot)
        at, of = at[~whole], of[~whole]
        order = np.lexsort((self.hot[at], self.lean[at], of))
        at, of = at[order], of[order]
        last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
        h = h.copy()
        h[of[last]] = self.hot[at[last]]
        return h, row


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


class Counts:
    """Sums by 64-bit key (and more columns), merged as they come; beyond `hold` keys they are given out, and go on after the shuffle."""

    def __init__(self, columns: int, hold: int = 500_000) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.columns, self.held, self.hold = columns, 0, hold

    def add(self, keys: np.ndarray, values: np.ndarray) -> bool:
        """Whether the sums should be taken out now."""
        self.parts.append((keys, values))
        self.held += len(keys)
        if self.held > 2 * self.hold:
            self.merge()
        return self.held > self.hold and len(self.parts) == 1

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros((0,), np.uint64), np.zeros((0, self.columns), np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        values = np.concatenate([v for _, v in self.parts])
        u, inverse = np.unique(keys, return_inverse=True)
        sums = np.stack([np.bincount(inverse, values[:, c], len(u)).astype(np.int64) for c in range(self.columns)], axis=1)
        self.parts, self.held = [(u, sums)], len(u)
        return u, sums

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merge()
        self.parts, self.held = [], 0
        return out


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def training_labels(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> dict[int, int]:
    """At most bound labelled doc_ids of the training share; of several labels of one doc_id the largest.

    Copies of a text count once: those with one text and label are told by the smallest doc_id.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = written(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound), "toxicity-labels")
    texts = _texts(documents).join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("_text"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct().toArrow()
    return dict(zip(texts.column("doc_id").to_pylist(), texts.column("toxic").to_pylist()))


def _label_arrays(labels: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(sorted(labels), np.int64)
    return ids, np.array([labels[i] for i in ids.tolist()], np.int64)


def _labels_of(doc_ids: np.ndarray, ids: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 or 1, or -1 for rows without a training label."""
    if not len(ids):
        return np.full(len(doc_ids), -1)
    at = np.minimum(np.searchsorted(ids, doc_ids), len(ids) - 1)
    return np.where(ids[at] == doc_ids, toxic[at], -1)


def leanings(documents: DataFrame, labels: dict[int, int]) -> DataFrame:
    """term, n_toxic, n_clean, is_word: labelled training documents that hold each word or run of letters; no more of them than labels."""
    ids, toxic = _label_arrays(labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counts(3)

        def out() -> pa.RecordBatch:
            u, n = sums.take()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n[:, 0]), pa.array(n[:, 1]), pa.array(n[:, 2])], names=["term", "n_toxic", "n_clean", "is_word"])

        for batch in batches:
            label = _labels_of(batch.column(0).fill_null(-(1 << 62)).to_numpy(), ids, toxic)
            some = np.flatnonzero(label >= 0)
            if not len(some):
                continue
            label = label[some]
            for first, _, raw, off in text_chunks(_lowered(batch.column(1).take(pa.array(some))), PIECE):
                h, row, s, e, cp = words(raw, off)
                g, of = grams(s, e, cp)
                for hashes, rows, is_word in ((h, row, 1), (g, row[of], 0)):
                    _, one = np.unique(mix(hashes ^ (rows.astype(np.uint64) * _A)), return_index=True)
                    t, back = np.unique(hashes[one], return_inverse=True)
                    value = label[first + rows[one]]
                    if sums.add(t, np.stack([np.bincount(back, value == 1, len(t)), np.bincount(back, value == 0, len(t)), np.full(len(t), is_word)], axis=1).astype(np.int64)):
                        yield out()
        yield out()

    counted = _texts(documents).mapInArrow(tidy(count), "term long, n_toxic long, n_clean long, is_word long")
    return counted.groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"), (F.max("is_word") > 0).alias("is_word"))


def term_counts(documents: DataFrame, terms: Terms) -> DataFrame:
    """a, b, n: occurrences n of every term b (a = 0), and of b within SPAN words of a toxic seed a."""
    hot = terms.hot

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = Counts(1)

        def out() -> pa.RecordBatch:
            u, n = single.take()
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), np.int64)), pa.array(u.view(np.int64)), pa.array(n[:, 0])], names=["a", "b", "n"])

        near: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, raw, off in text_chunks(_lowered(batch.column(1)), PIECE):
                h, row = terms.of(raw, off)
                u, n = np.unique(h, return_counts=True)
                if single.add(u, n[:, None]):
                    yield out()
                at = np.flatnonzero(_within(h, hot))
                for move in (*range(1, SPAN + 1), *range(-SPAN, 0)):
                    k = at[(at + move >= 0) & (at + move < len(h))]
                    k = k[row[k] == row[k + move]]
                    near.append((h[k], h[k + move]))
        yield out()
        a, b = (np.concatenate([x[k] for x in near]) if near else np.zeros(0, np.uint64) for k in range(2))
        _, first, n = np.unique(mix(a) + b, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(n)], names=["a", "b", "n"])

    return _texts(documents).mapInArrow(tidy(count), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_counts(documents: DataFrame, terms: Terms, one: np.ndarray | None, other: np.ndarray | None, hold: int = 2_000_000) -> DataFrame:
    """a, b, n: occurrences of a term b (of `other`, or any) within SPAN words of a term a of `one`, or any (sorted hashes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, least = 0, hold // 4

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, n = (np.concatenate([h[k] for h in held]) for k in range(3)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
            _, first, inverse = np.unique(mix(a) + b, return_index=True, return_inverse=True)
            return a[first], b[first], np.bincount(inverse, n, len(first)).astype(np.int64)

        def batch_of(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            for _, _, raw, off in text_chunks(_lowered(batch.column(1)), PIECE):
                h, row = terms.of(raw, off)
                at = np.arange(len(h)) if one is None else np.flatnonzero(_within(h, one))
                for step in range(1, SPAN + 1):
                    for move in (step, -step):
                        k = at[(at + move >= 0) & (at + move < len(h))]
                        k = k[row[k] == row[k + move]]
                        b = h[k + move]
                        if other is not None:
                            ok = _within(b, other)
                            k, b = k[ok], b[ok]
                        held.append((h[k], b, np.ones(len(b), np.int64)))
                        rows += len(b)
                if rows > least:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > hold:  # the sums by pair go on after the shuffle
                        yield batch_of(*held[0])
                        held, rows = [], 0
                    least = max(hold // 4, 2 * rows)
        yield batch_of(*merged())

    return _texts(documents).mapInArrow(tidy(count), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def node_pairs(documents: DataFrame, terms: Terms, nodes: np.ndarray, least: int = 1, hold: int = 1_000_000) -> DataFrame:
    """a, b, n: what pair_counts gives for nodes and nodes, without pairs of a term with itself, where n is `least` or more."""
    size = np.uint64(max(1, len(nodes)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new: list[np.ndarray] = []
        keys, n, rows = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            u, some = np.unique(np.concatenate(new), return_counts=True) if new else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            both = np.concatenate([keys, u])
            order = np.argsort(both, kind="stable")
            both, m = both[order], np.concatenate([n, some])[order]
            first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
            return both[first], np.add.reduceat(m, first) if len(first) else m

        def batch_of(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for _, _, raw, off in text_chunks(_lowered(batch.column(1)), PIECE):
                h, row = terms.of(raw, off)
                at = np.minimum(np.searchsorted(nodes, h), max(0, len(nodes) - 1))
                on = nodes[at] == h if len(nodes) else np.zeros(len(h), bool)
                at = at.astype(np.uint64)
                for step in range(1, SPAN + 1):
                    k = np.flatnonzero(on[:-step] & on[step:] & (row[:-step] == row[step:]) & (at[:-step] != at[step:]))
                    x, y = at[k], at[k + step]
                    new.append(np.minimum(x, y) * size + np.maximum(x, y))
                    rows += len(k)
                if rows > hold:
                    (keys, n), new, rows = merged(), [], 0
                    if len(keys) > hold:  # the sums by pair go on after the shuffle
                        yield batch_of(keys, n)
                        keys, n = keys[:0], n[:0]
        yield batch_of(*merged())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            x, y = (nodes[k].view(np.int64) for k in (key // size, key % size))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(x, y)), pa.array(np.append(y, x)), pa.concat_arrays([batch.column(1)] * 2)], names=["a", "b", "n"])

    sums = _texts(documents).mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") >= least).mapInArrow(tidy(named), "a long, b long, n long")


def _within(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(h), bool)
    return some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h


def _leaning(terms: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """lean: the z value of the difference between the shares of toxic and of clean training documents with the term."""
    a, b = F.col("n_toxic") / n_toxic, F.col("n_clean") / n_clean
    p = (F.col("n_toxic") + F.col("n_clean") + 1) / (n_toxic + n_clean + 2)
    return terms.withColumn("lean", (a - b) / F.sqrt(p * (1 - p) * (1 / n_toxic + 1 / n_clean))).withColumn("odds", F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("n_clean") + 0.5) / (n_clean + 1)))


def _sent(terms: DataFrame, most: int) -> np.ndarray | None:
    """The sorted hashes of the column term, or None (any) beyond `most`."""
    if terms.count() > most:
        return None
    return np.sort(terms.select("term").toArrow().column("term").to_numpy().view(np.uint64))


def _product(edges: DataFrame, n: int, most_held: int) -> Callable[[np.ndarray], np.ndarray]:
    """x -> the sums of w * x[a] by b, over edges (a, b, w) between n numbered nodes; beyond most_held edges in tasks."""

    def sums(a: np.ndarray, b: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(b, w * x[a, k], n) for k in range(x.shape[1])], axis=1)

    if edges.count() <= most_held:
        held = edges.toArrow()
        a, b, w = (held.column(c).to_numpy() for c in ("a", "b", "w"))
        return lambda x: sums(a, b, w, x)

    def product(x: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y, met = np.zeros_like(x), np.zeros(n, bool)
            held: list[pa.RecordBatch] = []

            def add() -> None:
                some = pa.Table.from_batches(held)
                a, b, w = (some.column(k).to_numpy() for k in range(3))
                np.add(y, sums(a, b, w, x), out=y)
                met[b] = True
                held.clear()

            for batch in batches:
                held.append(batch)
                if len(held) * len(held[0]) > n:
                    add()
            if held:
                add()
            b = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(y[b, 0]), pa.array(y[b, -1])], names=["b", "first", "last"])

        got = edges.mapInArrow(tidy(run), "b int, first double, last double").toArrow()  # tables lie by b: about a row a node
        b = got.column("b").to_numpy()
        return np.stack([np.bincount(b, got.column(c).to_numpy(), n) for c in ("first", "last")], axis=1)

    return product


def walked(nodes: DataFrame, edges: DataFrame, most_held: int = MOST_HELD, most: int = MOST_BROADCAST) -> DataFrame:
    """term, plus, minus: two walks with restart over edges (a, b, w) of nodes (term, hot, cold), from hot and from cold ones."""
    n_hot, n_cold, n = nodes.agg(F.sum(F.col("hot").cast("long")), F.sum(F.col("cold").cast("long")), F.count(F.lit(1))).first()
    share = lambda c, n: F.when(F.col(c), F.lit(1.0 / max(1, n or 0))).otherwise(0.0)
    minus = (1 - UNIFORM) * share("cold", n_cold) + UNIFORM / max(1, n)  # without neutral seeds, the uniform part alone
    start = written(nodes.select("term", share("hot", n_hot).alias("s_plus"), minus.alias("s_minus")), "toxicity-start")
    if start.count() <= most:
        table = start.toArrow().sort_by("term")
        term = table.column("term").to_numpy()

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (pa.array(np.searchsorted(term, batch.column(k).to_numpy()).astype(np.int32)) for k in range(2))
                yield pa.RecordBatch.from_arrays([a, b, batch.column(2)], names=["a", "b", "w"])

        times = _product(written(edges.select("a", "b", "w").mapInArrow(tidy(number), "a int, b int, w double").repartition("b"), "toxicity-edges"), len(term), most_held)
        d = times(np.ones((len(term), 2)))[:, :1]
        scale = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0.0)
        s = p = np.stack([table.column(c).to_numpy() for c in ("s_plus", "s_minus")], axis=1)
        for _ in range(STEPS):
            p = (1 - RESTART) * scale * times(scale * p) + RESTART * s
        return nodes.sparkSession.createDataFrame(pa.table({"term": term, "plus": p[:, 0].copy(), "minus": p[:, 1].copy()}))
    edges = written(edges, "toxicity-edges")
    degree = edges.groupBy("a").agg(F.sum("w").alias("d"))
    step = edges.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("d_b")), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("d_b"))).alias("step"))
    step = written(step, "toxicity-steps")
    p = start.select("term", F.col("s_plus").alias("plus"), F.col("s_minus").alias("minus"))
    for _ in range(STEPS):
        come = step.join(p.withColumnRenamed("term", "a"), "a").groupBy(F.col("b").alias("term")).agg(F.sum(F.col("step") * F.col("plus")).alias("plus"), F.sum(F.col("step") * F.col("minus")).alias("minus"))
        moved = lambda c: ((1 - RESTART) * F.coalesce(c, F.lit(0.0)) + RESTART * F.col(f"s_{c}")).alias(c)
        p = written(start.join(come, "term", "left").select("term", moved("plus"), moved("minus")), "toxicity-walk")
    return p


def _pmi(total: int, pairs: Column, n_a: Column, n_b: Column) -> Column:
    return F.log(pairs * F.lit(float(total)) / (2.0 * SPAN * n_a * n_b))


def _discounted(n: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The share of mutual information that small counts leave."""
    return n / (n + 1) * least / (least + 1)


def graph(documents: DataFrame, terms: Terms, counted: DataFrame, lean: DataFrame, most: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Nodes (term, n, hot, cold) and edges (a, b, w): toxic seeds and every term that is tied to one."""
    single = counted.filter("a = 0").select(F.col("b").alias("term"), "n")
    total = single.agg(F.sum("n")).first()[0] or 0
    hot = written(single.join(lean.filter("hot").select("term"), "term"), "toxicity-hot")
    n_hot = hot.agg(F.sum("n")).first()[0] or 0
    near = counted.filter("a <> 0").join(F.broadcast(hot.select(F.col("term").alias("a"))), "a", "left_semi").groupBy("b").agg(F.sum("n").alias("pairs"))  # hot: no more than leaned
    near = near.filter(F.col("pairs") >= LEAST_PAIRS).join(single.select(F.col("term").alias("b"), F.col("n").alias("n_b")), "b")
    chance = 2.0 * SPAN * n_hot * F.col("n_b") / F.lit(float(max(1, total)))
    near = near.filter((F.log(F.col("pairs") / chance) >= SHIFT) & (F.col("pairs") - chance >= TIED_Z * F.sqrt(chance)))
    tied = near.select(F.col("b").alias("term"), F.col("n_b").alias("n")).distinct().join(hot.select("term"), "term", "left_anti")
    tied = tied.join(lean.select("term", "lean", "odds"), "term", "left").select("term", "n", F.lit(False).alias("hot"), F.coalesce((F.col("lean") < 0) & (F.col("odds") < 0), F.lit(False)).alias("cold"))
    nodes = written(hot.select("term", "n", F.lit(True).alias("hot"), F.lit(False).alias("cold")).unionByName(tied), "toxicity-nodes")
    sent = _sent(nodes, most)
    if sent is None:
        end = lambda c: nodes.select(F.col("term").alias(c), F.col("n").alias(f"n_{c}"))
        pairs = pair_counts(documents, terms, None, None).filter(F.col("n") >= LEAST_PAIRS).withColumnRenamed("n", "pairs")
        least = F.least("n_a", "n_b")
        w = _pmi(total, F.col("pairs"), F.col("n_a"), F.col("n_b")) * F.col("pairs") / (F.col("pairs") + 1) * least / (least + 1)
        return nodes, pairs.join(end("a"), "a").join(end("b"), "b").filter("a <> b").select("a", "b", w.alias("w")).filter("w > 0")
    table = nodes.select("term", "n").toArrow()
    n = np.zeros(len(sent))
    n[np.searchsorted(sent, table.column("term").to_numpy().view(np.uint64))] = table.column("n").to_numpy()

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.searchsorted(sent, batch.column(k).to_numpy().view(np.uint64)) for k in range(2))
            pairs = batch.column(2).to_numpy()
            w = np.log(pairs * float(total) / (2 * SPAN * n[a] * n[b])) * _discounted(pairs, np.minimum(n[a], n[b]))
            on = pa.array(w > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on), pa.array(w).filter(on)], names=["a", "b", "w"])

    return nodes, node_pairs(documents, terms, sent, LEAST_PAIRS).mapInArrow(tidy(weighed), "a long, b long, w double")


def seeds(documents: DataFrame, labels: dict[int, int]) -> tuple[DataFrame, Terms] | None:
    """(term, n_toxic, n_clean, is_word, lean, odds, hot of the training documents; how words become terms), or None without toxic seeds.

    Toxic words are seeds of their own; a toxic run of letters is one where it stands in words that aren't.
    """
    n_toxic, n_clean = sum(labels.values()), sum(1 - v for v in labels.values())
    if not n_toxic or not n_clean:
        return None
    lean = written(_leaning(leanings(documents, labels), n_toxic, n_clean).withColumn("hot", (F.col("lean") >= LEAST_Z) & (F.col("odds") >= F.when(F.col("is_word"), LEAST_ODDS[0]).otherwise(LEAST_ODDS[1])) & (F.col("n_toxic") >= LEAST_SHARE * n_toxic)), "toxicity-terms")
    hot = lean.filter("hot").select("term", "lean").toArrow()  # of at most LABELLED documents, and only those that lean
    if not len(hot):
        return None
    return lean, Terms(hot.column("term").to_numpy().view(np.uint64), hot.column("lean").to_numpy())


def induce(documents: DataFrame, labels: dict[int, int]) -> tuple[Terms, np.ndarray, np.ndarray]:
    """(how words become terms, sorted term hashes, weights): the lexicon. Empty where the labels have one class only."""
    none = np.zeros(0, np.uint64)
    found = seeds(documents, labels)
    if found is None:
        return Terms(none, np.zeros(0)), none, np.zeros(0)
    lean, terms = found
    counted = written(term_counts(documents, terms), "toxicity-counts")
    nodes, edges = graph(documents, terms, counted, lean)
    polarity = (F.col("plus") - F.col("minus")) / (F.col("plus") + F.col("minus"))
    weight = polarity * F.log1p(F.col("plus") * F.lit(float(nodes.count())))
    lexicon = walked(nodes, edges).filter("plus > minus").select("term", weight.alias("weight")).toArrow()
    found, weights = lexicon.column("term").to_numpy().view(np.uint64), lexicon.column("weight").to_numpy()
    order = np.argsort(found)
    return terms, found[order], weights[order]


FEATURES = ["total", "hits", "density", "strongest", "kinds", "strong_density"]
STRONG = 1.0  # a weight that a lone tie to a seed does not reach


def _measure(raw: np.ndarray, off: np.ndarray, terms: Terms, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    h, row = terms.of(raw, off)
    hit = np.flatnonzero(_within(h, lexicon))
    at, r = np.searchsorted(lexicon, h[hit]), row[hit]
    w = weights[at]
    words = np.maximum(np.bincount(row, minlength=n), 1)
    strongest = np.zeros(n)
    np.maximum.at(strongest, r, w)
    total = np.bincount(r, w, n)
    strong = w >= STRONG
    hits = np.bincount(r[strong], minlength=n)
    kinds = np.bincount(np.unique(np.stack([r, at], axis=1)[strong], axis=0)[:, 0], minlength=n) if strong.any() else np.zeros(n)
    return np.stack([np.log1p(total), np.log1p(hits), np.sqrt(total / words), strongest, np.log1p(kinds), np.sqrt(hits / words)], axis=1)


def measured(documents: DataFrame, terms: Terms, lexicon: np.ndarray, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, off in text_chunks(_lowered(batch.column(1)), PIECE):
                x = _measure(raw, off, terms, lexicon, weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], names=["doc_id", *FEATURES])

    return _texts(documents).mapInArrow(tidy(run), "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES))


def _expanded(x: np.ndarray) -> np.ndarray:
    pairs = [x[:, i : i + 1] * x[:, j : j + 1] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.concatenate([np.ones((len(x), 1)), x, *pairs], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method on scaled columns; returns coefficients for unscaled ones."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    z, c = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(c)), z.T @ (y - p) - penalty * c)
        c = c + step
        if np.abs(step).max() < 1e-8:
            break
    return c / scale


def score(documents: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of documents.

    An empty or null text has no terms and gets the score of such texts. A null doc_id isn't held out. Rows with one doc_id
    are each scored by their own text; where it is labelled, all of them count and one of the texts is fitted on. Texts
    are read whole, whatever their length. With labels of one class only, or none, every score is the share of toxic labels. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    train = training_labels(documents, labels, bound)
    terms, lexicon, weights = induce(documents, train)
    table = written(measured(documents, terms, lexicon, weights), "toxicity-features")
    share = sum(train.values()) / max(1, len(train))
    if len(lexicon):
        ids, toxic = _label_arrays(train)
        ids = documents.sparkSession.createDataFrame(pa.table({"doc_id": ids, "toxic": toxic.astype(np.int32)}))
        rows = table.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max(F.struct(*FEATURES, "toxic")).alias("x")).select("doc_id", "x.*").toArrow().sort_by("doc_id").to_pandas()  # at most bound
        c = fit_logistic(_expanded(rows[FEATURES].to_numpy(float)), rows["toxic"].to_numpy(float))
    else:
        c = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f).to_numpy() for f in FEATURES], axis=1)
            s = np.full(len(x), share) if c is None else 1 / (1 + np.exp(-np.clip(_expanded(x) @ c, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= PREDICT_AT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return table.withColumn("held_out", held).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
