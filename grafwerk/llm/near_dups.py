"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard confirmation.

A document's set: distinct SHINGLE-word shingles of its text with A-Z lower-cased, as 64-bit hashes. Equal sets form a
class at once (a hash of the whole set); everything below is between classes. Two permutations give all signature
coordinates: sigma scatters a shingle, pi is applied to sigma's value shifted circularly by k steps, and coordinate k is
the least pi. Bands of ROWS coordinates make buckets.

Candidates are thinned before any set moves: by the sizes of the sets, which bound their similarity, and by AGREE, the
least number of equal coordinates (of the last byte of each) that a pair must show. Then by the first two bytes of all
hashes of both sets: equal hashes have equal beginnings, so these bound the intersection from above, and no link is lost.
What is left is confirmed on full sets.

Links inside buckets, without all pairs: a bucket has a centre, its other members are compared with the centre, and the
centre leaves. Buckets whose members all lie in one component are done. The classes of buckets that still hold several
components (many texts that share a passage) are joined exactly, by prefixes: in any order of all shingles, two sets of
similarity 0.7 share a shingle among the first n - ceil(0.7 n) + 1 of each. The order is from rare to frequent, so a text
with enough shingles of its own has an empty prefix and meets nobody. The shared shingles make new buckets, which go
through rounds of centres. Those that stay mixed are divided by the next shared shingle of longer prefixes where that makes
them cheaper (halves the sum of squares of their members), at any depth; where it doesn't, because hundreds of texts share
all their rare shingles and still aren't alike, rounds with ever more centres compare all members. So no link is lost there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, span_hashes, text_chunks, tidy, words_of, written

SHINGLE = 5
PERCENT = 70
BANDS = 40
ROWS = 4
AGREE = 84  # of the BANDS * ROWS coordinates; at similarity 0.7 fewer agree with chance 2e-6
CENTRES = 4  # of a bucket of shared prefixes, in its first round
SMALL = 128  # members of a bucket beside those of its largest component, up to which it isn't worth dividing
BLOCK = 1 << 15
SHORT = 1 << 13  # hashes of a set, up to which their beginnings have 16 bits, not 32
MOST_BROADCAST = 1_000_000

_A = np.uint64(0x9DDFEA08EB382D69)


def shingles(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all shingles, rows ascending; a text of fewer words is one shingle, one without words none."""
    start, end, row = words_of(raw, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = span_hashes(raw, start, end, lower=True)
    n = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    m = len(w) - width + 1
    parts: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    if m > 0:
        g = np.zeros(m, np.uint64)
        for k in range(width):
            g = g * _A + w[k : k + m]
        inside = row[:m] == row[width - 1 :]
        parts.append(mix(g[inside]))
        rows.append(row[:m][inside])
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        g = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = n[short] > k
            g[more] = g[more] * _A + w[first[short[more]] + k]
        parts.append(mix(g ^ (n[short].astype(np.uint64) << np.uint64(56))))
        rows.append(short)
    h, r = np.concatenate(parts), np.concatenate(rows)
    if len(short) and m > 0:
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def sets_of(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each row."""
    h, row = shingles(raw, off)
    edges = np.searchsorted(row, np.arange(len(off)))
    return [np.unique(h[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of circulant MinHash coordinates for each non-empty set."""
    out = np.empty((len(sets), size), np.uint32)
    k = 0
    while k < len(sets):
        end, held = k + 1, len(sets[k])
        while end < len(sets) and held + len(sets[end]) <= BLOCK:
            held += len(sets[end])
            end += 1
        x = np.concatenate(sets[k:end])
        sigma = (x >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[k : end - 1]], dtype=np.int64)]).astype(np.int64)
        v = np.empty_like(sigma)
        t = np.empty_like(sigma)
        for j in range(size):
            np.add(sigma, np.uint32((j * 0x9E3779B1) & 0xFFFFFFFF), out=v)  # the circular shift
            v *= np.uint32(0x85EBCA6B)  # pi, a bijection of 32 bits
            np.right_shift(v, np.uint32(15), out=t)
            v ^= t
            v *= np.uint32(0xC2B2AE35)
            np.right_shift(v, np.uint32(16), out=t)
            v ^= t
            out[k:end, j] = np.minimum.reduceat(v, starts)
        k = end
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """64-bit bucket keys, one per band, that differ between bands."""
    s = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * _A + s[:, :, k])
    return key.view(np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), same (64-bit hash of the set; null if empty), bands, sketch (a byte of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, off in text_chunks(batch.column(1)):
                sets = sets_of(raw, off)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                same = [_class_of(s) if len(s) else None for s in sets]
                signature = signatures([sets[i] for i in full]) if len(full) else np.zeros((0, BANDS * ROWS), np.uint32)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands_of(signature).reshape(-1)))
                sketch: list[bytes | None] = [None] * len(n)
                for i, row in zip(full.tolist(), (signature & np.uint32(255)).astype(np.uint8)):
                    sketch[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), pa.array(same, pa.int64()), bands, pa.array(sketch, pa.binary())], names=["doc_id", "n", "same", "bands", "sketch"])

    return _texts(documents).mapInArrow(tidy(run), "doc_id long, n long, same long, bands array<long>, sketch binary")


def _small(df: DataFrame, name: str, most: int = MOST_BROADCAST) -> DataFrame:
    """df, written; to be broadcast in a join if it has `most` rows at most."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= most else df


def beginnings(s: np.ndarray) -> np.ndarray:
    """The first 16 bits of each hash of a sorted set (32 of more than SHORT hashes), sorted, repeats and all."""
    return (s >> np.uint64(48)).astype(np.uint16) if len(s) <= SHORT else (s >> np.uint64(32)).astype(np.uint32)


def most_common(x: bytes, y: bytes) -> tuple[int, int, int]:
    """(sizes of two sets, the most hashes that they can share) by their beginnings."""
    p, q = (np.frombuffer(b, np.uint16 if len(b) <= 2 * SHORT else np.uint32) for b in (x, y))
    if p.dtype != q.dtype:
        p, q = (b if b.dtype == np.uint16 else (b >> np.uint32(16)).astype(np.uint16) for b in (p, q))
    # each with the number of its equals before it, so that repeats are matched one by one
    p, q = ((b.astype(np.uint64) << np.uint64(32)) + (np.arange(len(b)) - np.searchsorted(b, b)).astype(np.uint64) for b in (p, q))
    return len(p), len(q), _common(p, q)


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """The values that two sorted arrays without repeats share."""
    small, large = (p, q) if len(p) < len(q) else (q, p)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def _full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """same, set (sorted 64-bit hashes), begin (their beginnings) of the classes in wanted (same, doc: a document with that set), from whole texts."""
    wanted = _small(wanted, "dup-wanted")
    rows = _texts(documents).join(wanted.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in text_chunks(batch.column(1)):
                sets = [s for s in sets_of(raw, off) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([beginnings(s).tobytes() for s in sets], pa.binary())], names=["same", "set", "begin"])

    found = written(rows.mapInArrow(tidy(run), "same long, set binary, begin binary").join(wanted.select("same"), "same", "left_semi"), "dup-sets")
    if found.count() > wanted.count():  # repeated rows
        found = written(found.dropDuplicates(["same"]), "dup-sets")
    return found


def _alike(pairs: DataFrame, sketches: DataFrame, agree: int = AGREE) -> DataFrame:
    """The pairs (u, v) whose sketches agree in `agree` bytes or more."""
    a = sketches.select(F.col("same").alias("u"), F.col("sketch").alias("of_u"))
    b = sketches.select(F.col("same").alias("v"), F.col("sketch").alias("of_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            kept = pa.array((x == y).sum(axis=1) >= agree)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    return pairs.join(a, "u").join(b, "v").select("u", "v", "of_u", "of_v").mapInArrow(tidy(run), "u long, v long")


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """u, v, of_u, of_v: the column of both sets of each of the pairs, which are written. Of other sets none moves."""
    few = F.broadcast if pairs.count() <= MOST_BROADCAST else lambda df: df
    a = sets.select(F.col("same").alias("v"), F.col(column).alias("of_v"))
    b = sets.select(F.col("same").alias("u"), F.col(column).alias("of_u")).join(few(pairs.select("u").distinct()), "u", "left_semi")
    return few(pairs).join(a, "v").join(b, "u").select("u", "v", "of_u", "of_v")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that may be links by the beginnings of their hashes: all links, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                n, m, common = most_common(x, y)
                keep.append(100 * common >= percent * (n + m - common))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    return _with_both(pairs, sets, "begin").mapInArrow(tidy(run), "u long, v long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= percent * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = _common(p, q)
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    return _with_both(pairs, sets, "set").mapInArrow(tidy(run), "u long, v long")


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each) of undirected edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (label[a], label[b]):  # the roots of both ends take the lower label
            np.minimum.at(new, x, low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def components(edges: DataFrame, most_held: int = MOST_BROADCAST) -> DataFrame:
    """node, component (the smallest node reachable) of undirected edges (u, v).

    Up to most_held distinct edges (16 bytes each) are joined up in the driver, more by alternating large and small stars.
    """
    spark = edges.sparkSession
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    held = e.limit(most_held + 1).toArrow()
    if len(held) <= most_held:
        node, least = least_reachable(held.column("u").to_numpy(), held.column("v").to_numpy())
        return spark.createDataFrame(pa.table({"node": node, "component": least}))
    e = written(e, "stars")
    while True:
        # done when every node has one neighbour below it, which has none
        forked = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        chained = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        if forked.union(chained).isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = written(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """same, n, place (from 1), key: the shingles that several sets hold, by their place in the order of the set from rare to frequent.

    Shingles of one set alone come first in its order; they have places, but no rows.
    """

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0).to_numpy(), [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
            start = 0
            while start < len(values):  # rows by the hundred thousand
                end, held = start + 1, len(values[start])
                while end < len(values) and held + len(values[end]) <= 100_000:
                    held += len(values[end])
                    end += 1
                n = np.array([len(v) for v in values[start:end]])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[start:end], n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(values[start:end]))], names=["same", "n", "key"])
                start = end

    rows = sets.select("same", "set").mapInArrow(tidy(list_), "same long, n long, key long")
    often = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "dup-often")
    shared = written(rows.join(F.broadcast(often) if often.count() <= MOST_BROADCAST else often, "key"), "dup-shared")
    own = shared.groupBy("same").agg(F.count(F.lit(1)).alias("_shared"))
    # sets with enough shingles of their own have nothing in any prefix; what is left is ordered within each set
    near = shared.join(own, "same").withColumn("_own", F.col("n") - F.col("_shared")).filter(F.col("_own") < F.col("n"))
    order = Window.partitionBy("same").orderBy("held", "key")
    return near.select("same", "n", (F.col("_own") + F.row_number().over(order)).alias("place"), "key")


def _reach(n: Column, level: int, percent: int) -> Column:
    """The last place at which the level-th shared shingle of a set of n can lie, if it has a link."""
    return n - F.ceil(n * percent / 100) + level


class _Search:
    """Links between classes, found bucket by bucket; components grow as links come."""

    def __init__(self, documents: DataFrame, classes: DataFrame, percent: int) -> None:
        self.documents, self.classes, self.percent = documents, classes, percent
        self.component: DataFrame | None = None  # node, component of the classes with links
        self.nodes = 0  # rows of it
        self.tested: DataFrame | None = None

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with the component of each class (itself, if it has no link)."""
        if self.component is None:
            return rows.withColumn("component", F.col("same"))
        component = self.component.withColumnRenamed("node", "same")
        component = F.broadcast(component) if self.nodes <= MOST_BROADCAST else component
        return rows.join(component, "same", "left").withColumn("component", F.coalesce("component", "same"))

    def mixed(self, left: DataFrame) -> DataFrame | None:
        """The rows of buckets that hold several components, or None if there are none."""
        placed = self.placed(left.drop("component"))
        several = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
        several = _small(several, "dup-several")
        left = written(placed.join(several, "key", "left_semi"), "dup-left")
        return None if left.isEmpty() else left

    def round(self, left: DataFrame, centres: int) -> DataFrame:
        """Tests the members of every bucket against its centres (one of each slot, of the smallest component); the rows without centres."""
        slots = left.withColumn("slot", F.pmod(F.xxhash64("same"), F.lit(centres)))
        parts = slots.groupBy("key", "slot", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("same", F.col("n").alias("size"))).alias("c"))
        chosen = parts.groupBy("key", "slot").agg(F.min(F.struct("n", "c", "component")).alias("c")).select("key", F.col("c.c.same").alias("centre"), F.col("c.c.size").alias("size"), F.col("c.component").alias("of"))
        chosen = _small(chosen, "dup-centres")
        close = (100 * F.least("n", "size") >= self.percent * F.greatest("n", "size")) & (F.col("component") != F.col("of"))
        pairs = left.join(chosen, "key").filter(close).select(F.least("centre", "same").alias("u"), F.greatest("centre", "same").alias("v")).distinct()
        likely = _alike(pairs, self.sketches)
        if self.tested is not None:
            likely = likely.join(self.tested, ["u", "v"], "left_anti")
        likely = written(likely, "dup-likely")
        self.tested = likely if self.tested is None else self.tested.union(likely)
        if not likely.isEmpty():
            possible = written(_possible(likely, self.sets, self.percent), "dup-possible")
            if not possible.isEmpty():
                self.link(written(_confirmed(possible, self.sets, self.percent), "dup-links"))
        return left.join(chosen.select("key", F.col("centre").alias("same")), ["key", "same"], "left_anti")

    def link(self, found: DataFrame) -> None:
        """Joins components by new links: only the components that they touch are joined up anew."""
        if found.isEmpty():
            return
        if self.component is None:
            self.component = written(components(found), "dup-components")
            self.nodes = self.component.count()
            return
        named = self.placed(found.select(F.col("u").alias("same"), "v")).select(F.col("component").alias("a"), F.col("v").alias("same"))
        named = self.placed(named).select(F.col("a").alias("u"), F.col("component").alias("v"))
        merged = written(components(named), "dup-merged")
        old = self.component.join(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        fresh = merged.join(self.component.select("node"), "node", "left_anti").select("node", "component")
        self.component = written(old.union(fresh), "dup-components")
        self.nodes = self.component.count()

    def run(self, buckets: DataFrame) -> None:
        left = self.mixed(buckets)
        if left is None:
            return
        met = _small(left.select("same").distinct(), "dup-met")
        self.sketches = written(self.classes.select("same", "sketch").join(met, "same", "left_semi"), "dup-sketches")
        self.sets = _full_sets(self.documents, self.classes.select("same", "doc").join(met, "same", "left_semi"))
        left = self.mixed(self.round(left, 1))
        if left is None:
            return
        own = written(prefixes(self.sets.join(_small(left.select("same").distinct(), "dup-among"), "same", "left_semi"), self.percent), "dup-prefixes")
        level = 1
        left = own.filter(F.col("place") <= _reach(F.col("n"), 1, self.percent)).select("key", "same", "n", "place")
        left = self.mixed(left)
        while left is not None:
            left = self.mixed(self.round(left, CENTRES))
            if left is None:
                return
            sizes = left.groupBy("key", "component").count().groupBy("key").agg(F.sum("count").alias("m"), F.max("count").alias("most"))
            large = written(sizes.filter(F.col("m") - F.col("most") > SMALL).select("key"), "dup-large")
            if large.isEmpty():
                return self.exhaust(left)
            # centres come from small components first: members outside the largest one are what rounds cost
            self.exhaust(written(left.join(large, "key", "left_anti"), "dup-small"))
            level += 1
            left, whole = self.divided(self.mixed(left.join(large, "key", "left_semi")), own, level)
            self.exhaust(whole)
            if left is not None:
                left = self.mixed(left)

    def divided(self, left: DataFrame | None, own: DataFrame, level: int) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows of finer buckets, rows of the buckets that these don't make cheaper: by the squares of their members, halved at least)."""
        if left is None:
            return None, None
        more = own.select("same", F.col("place").alias("_next"), F.col("key").alias("_key"))
        finer = left.join(more, "same").filter((F.col("_next") > F.col("place")) & (F.col("_next") <= _reach(F.col("n"), level, self.percent)))
        finer = written(finer.select(F.col("key").alias("of"), F.xxhash64("key", "_key").alias("key"), "same", "n", F.col("_next").alias("place")), "dup-finer")
        parts = finer.groupBy("of", "key").agg(F.count(F.lit(1)).cast("double").alias("m")).filter("m > 1")
        whole = left.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("m"))
        cost = whole.join(parts.groupBy(F.col("of").alias("key")).agg(F.sum(F.col("m") * F.col("m")).alias("parts")), "key", "left")
        cost = written(cost.select("key", (2 * F.coalesce("parts", F.lit(0.0)) <= F.col("m") * F.col("m")).alias("worth")), "dup-cost")
        worth = _small(cost.filter("worth").select(F.col("key").alias("of")), "dup-worth")
        down = written(finer.join(worth, "of", "left_semi").drop("of"), "dup-down")
        rest = written(left.join(_small(cost.filter("NOT worth").select("key"), "dup-whole"), "key", "left_semi"), "dup-rest")
        return None if down.isEmpty() else down, rest

    def exhaust(self, left: DataFrame | None) -> None:
        """Rounds with more and more centres, until every bucket is of one component or has no members left."""
        centres = 8 * CENTRES
        rest = None if left is None else self.mixed(left)
        while rest is not None:
            rest = self.mixed(self.round(rest, centres))
            centres *= 2


def groups(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of documents.

    A text without words (null, empty or white space) has an empty set and no links. Rows with one doc_id and equal texts
    are one document here and all get its row; with one doc_id and other texts, each text's links are found, and all are
    links of the doc_id. A null doc_id has no links, component_id is null and it is kept. Other columns are ignored,
    whatever their names; ties don't matter, as a component has one smallest doc_id; a text of any length is compared as a
    whole; an empty table gives an empty result.
    """
    rows = written(signed(documents), "dup-signatures")
    usable = rows.filter("n > 0 AND doc_id IS NOT NULL")
    named = usable.select("doc_id", "same")
    least = written(named.groupBy("same").agg(F.min("doc_id").alias("doc")), "dup-classes")
    # one row stands for a class: that of its smallest doc_id
    others = named.join(least, "same").filter("doc_id <> doc").select("doc_id", "same")
    classes = usable.join(_small(others, "dup-others"), ["doc_id", "same"], "left_anti").withColumnRenamed("doc_id", "doc")
    every = classes.select("same", "n", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    search = _Search(documents, classes, percent)
    search.run(written(every.join(_small(shared, "dup-shared"), "key").select("key", "same", "n"), "dup-buckets"))
    if search.component is not None:
        label = search.placed(least.withColumnRenamed("doc", "_doc"))
    else:
        label = least.select("same", F.col("doc").alias("_doc"), F.col("same").alias("component"))
    # a doc_id with several texts joins their components
    several = named.distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    several = written(named.distinct().join(_small(several, "dup-texts"), "doc_id").join(label.select("same", "component"), "same").select("doc_id", "component"), "dup-texts")
    if not several.isEmpty():
        stars = several.join(several.groupBy("doc_id").agg(F.min("component").alias("v")), "doc_id").select(F.col("component").alias("u"), "v")
        label = label.join(components(stars).select(F.col("node").alias("component"), F.col("component").alias("_c")), "component", "left").select("same", "_doc", F.coalesce("_c", "component").alias("component"))
    first = label.groupBy("component").agg(F.min("_doc").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    label = written(label.join(first.filter("_n > 1"), "component", "left").select("same", F.coalesce("component_id", "_doc").alias("component_id")), "dup-labels")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same")).join(label, "same", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 70 * (a.n + b.n - common)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m.y, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""
