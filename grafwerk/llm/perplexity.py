"""Quality classifier: interpolated modified Kneser-Ney over characters, trained on trusted text.

Grams are runs of up to ORDER code points (white space as a space, digits as 0, PAD before a text), by language. Counts of
all trusted documents are summed in each task, then by gram; discounts, continuation counts, context totals and
interpolation are joins and aggregates of gram tables, and give rows like those of an ARPA file: log probability of a gram
and log weight of backing off from it.

Scoring brings each task the part of the model that it needs. The rows of the documents fall into chunks of CHUNK_ROWS
rows of a file. A first pass lists the distinct grams of each chunk; these keys and the model are joined, sharded by key;
what is found is gathered by chunk and written as one slice per chunk to the shared folder; a second pass over the
documents reads the slice of each chunk and looks up every position. No text is shuffled and no model broadcast; what is
shuffled is the distinct grams of each chunk. Both passes settle the grams that a chunk repeats by one look (Known): sorts
and lookups are for the others.

A document is rejected if its perplexity lies above the threshold of its language: the QUANTILE of the perplexities of
those trusted documents that are held out of training (one in HELD_OUT, by hash), with ROOM and an allowance for short
texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, mix, text_chunks, tidy, words_of, written

ORDER = 5
CHUNK_ROWS = 16_384
CHUNK_BYTES = 1 << 19  # of text at a time; every array of a chunk is 8 or more times as long
QUANTILE = 0.99
HELD_OUT = 4
ROOM = 0.1  # nats a character
SHORT = 2.5  # nats a character, divided by the square root of the characters
MOST_BROADCAST = 2_000_000
KNOWN_BITS = 20  # of the slots for grams met before; fewer slots make more work, never another result
PAD = 2

_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(ORDER + 1)]
_SPACES = np.zeros(0x3001, bool)
_SPACES[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True


def language_key(lang: str | None) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b((lang or "").encode(), digest_size=8).digest(), "little")


def characters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with ORDER - 1 PADs before each row, position of each row's first PAD with the end appended, row of each)."""
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = off if len(cp) == len(raw) else np.searchsorted(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)), off)
    n = np.diff(at)
    cp = cp.copy()
    low = np.minimum(cp, 0x3001 - 1)
    cp[_SPACES[low] & (cp < 0x3001)] = 32
    cp[(cp >= 48) & (cp <= 57)] = 48
    starts = np.concatenate([[0], np.cumsum(n + ORDER - 1)])
    row = np.repeat(np.arange(len(n)), n + ORDER - 1)
    out = np.full(starts[-1], PAD, np.uint32)
    pad = np.zeros(starts[-1], bool)
    for k in range(ORDER - 1):
        pad[starts[:-1] + k] = True
    out[~pad] = cp
    return out, starts, row


def grams(chars: np.ndarray, at: np.ndarray, most: int = ORDER) -> list[np.ndarray]:
    """polynomials[m - 1]: of the m code points that end at each of at (m - 1 stand before each at least), for m up to most."""
    value = lambda where: chars[where].astype(np.uint64) + np.uint64(1)
    found = [value(at)]
    for m in range(1, most):
        found.append(found[-1] + value(at - m) * _POWERS[m])
    return found


def full_grams(chars: np.ndarray) -> np.ndarray:
    """The polynomial of the ORDER code points that end at each position (wrong for the first ORDER - 1)."""
    c = chars.astype(np.uint64) + np.uint64(1)
    out = c.copy()
    for m in range(1, ORDER):
        out[m:] += c[:-m] * _POWERS[m]
    return out


def unmixed(polynomial: np.ndarray, m: int, lang: np.ndarray | np.uint64) -> np.ndarray:
    """A gram's key before it is mixed: as distinct, in fewer steps."""
    return polynomial * np.uint64(0xD6E8FEB86659FD93) + np.uint64(m) ^ lang


def keyed(polynomial: np.ndarray, m: int, lang: np.ndarray | np.uint64) -> np.ndarray:
    return mix(unmixed(polynomial, m, lang))


def keys_of_strings(values: list[str], langs: list[str | None]) -> np.ndarray:
    """The keys of gram strings of any lengths."""
    out = np.zeros(len(values), np.uint64)
    by_lang = {x: np.uint64(language_key(x)) for x in set(langs)}
    lang = np.array([by_lang[x] for x in langs], np.uint64) if langs else np.zeros(0, np.uint64)
    length = np.array([len(v) for v in values])
    for m in np.unique(length).tolist():
        at = np.flatnonzero(length == m)
        if not m:
            out[at] = keyed(np.zeros(len(at), np.uint64), 0, lang[at])
            continue
        cps = np.frombuffer("".join(values[i] for i in at).encode("utf-32-le"), np.uint32).reshape(-1, m).astype(np.uint64) + np.uint64(1)
        g = np.zeros(len(at), np.uint64)
        for k in range(m):
            g += cps[:, m - 1 - k] * _POWERS[k]
        out[at] = keyed(g, m, lang[at])
    return out


# ---- training ----------------------------------------------------------------


def _counted(texts: DataFrame) -> DataFrame:
    """lang, gram, n of all ORDER-grams of (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key = np.concatenate([p[0] for p in parts])
            key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(key)).astype(np.int64)
            return key, np.concatenate([p[1] for p in parts])[first], n

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, end, raw, off in text_chunks(batch.column(1), CHUNK_BYTES):
                chars, at, row = _positions(raw, off)
                if not len(at):
                    continue
                full = full_grams(chars)
                of = langs[first:end]
                for lang in dict.fromkeys(of.tolist()):
                    mine = at[(of == lang)[row]]
                    key, one, n = np.unique(full[mine], return_index=True, return_counts=True)
                    mine = mine[one]
                    windows = np.stack([chars[mine - ORDER + 1 + k] for k in range(ORDER)], axis=1)
                    parts = held.setdefault(lang, [])
                    parts.append((key, windows, n))
                    if len(parts) > 8:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            _, windows, n = merged(parts)
            text = np.ascontiguousarray(windows).tobytes().decode("utf-32-le")
            strings = [text[k : k + ORDER] for k in range(0, len(text), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(strings, pa.string()), pa.array(n)], names=["lang", "gram", "n"])

    return texts.mapInArrow(tidy(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discount(n: Column, d: list[Column]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def train(texts: DataFrame) -> DataFrame:
    """key, logp, backoff: the model of (lang, text) rows. lang must not be null.

    Counts, contexts and probabilities of each order are written: unwritten, each is planned and computed again wherever it is
    used, in plans whose size takes most of the driver's memory.
    """
    counts = {ORDER: written(_counted(texts), "kn-counts")}
    for m in range(ORDER - 1, 0, -1):
        counts[m] = written(counts[m + 1].groupBy("lang", F.substring("gram", 2, m).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "kn-counts")
    below: DataFrame | None = None
    rows: list[DataFrame] = []
    backoffs: list[DataFrame] = []
    for m in range(1, ORDER + 1):
        c = counts[m].withColumn("context", F.substring("gram", 1, m - 1))
        of = [F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4)]
        d = c.groupBy("lang").agg(*[x.alias(f"n{k}") for k, x in enumerate(of, 1)]).withColumn("y", F.try_divide("n1", F.col("n1") + 2 * F.col("n2")))
        clamp = lambda x, low, high: F.least(F.greatest(F.coalesce(x, F.lit(low)), F.lit(low)), F.lit(high))
        d = d.select(
            F.col("lang"),
            clamp(1 - 2 * F.col("y") * F.try_divide("n2", "n1"), 0.1, 0.95).alias("d1"),
            clamp(2 - 3 * F.col("y") * F.try_divide("n3", "n2"), 0.2, 1.9).alias("d2"),
            clamp(3 - 4 * F.col("y") * F.try_divide("n4", "n3"), 0.3, 2.9).alias("d3"),
        )
        ds = [F.col("d1"), F.col("d2"), F.col("d3")]
        contexts = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("k1"), F.sum((F.col("n") == 2).cast("long")).alias("k2"), F.sum((F.col("n") > 2).cast("long")).alias("k3"))
        contexts = contexts.join(F.broadcast(d), "lang").withColumn("gamma", (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total"))  # d: one row per language
        contexts = written(contexts, "kn-contexts")
        p = c.join(contexts, ["lang", "context"]).withColumn("own", F.greatest(F.col("n") - _discount(F.col("n"), ds), F.lit(0.0)) / F.col("total"))
        if below is None:
            alphabet = counts[1].groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
            p = p.join(F.broadcast(alphabet), "lang").withColumn("p", F.col("own") + F.col("gamma") / (F.col("v") + 1))
            unknown = contexts.join(F.broadcast(alphabet), "lang").select("lang", F.lit("").alias("gram"), F.log(F.col("gamma") / (F.col("v") + 1)).alias("logp"))
            rows.append(unknown)
        else:
            lower = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = p.withColumn("suffix", F.substring("gram", 2, m - 1)).join(lower, ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
            backoffs.append(contexts.select("lang", F.col("context").alias("gram"), F.log("gamma").alias("backoff")))
        below = p.select("lang", "gram", "p")
        if m < ORDER:
            below = written(below, "kn-order")
        rows.append(below.select("lang", "gram", F.log("p").alias("logp")))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = keys_of_strings(batch.column("gram").to_pylist(), batch.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column("logp").cast(pa.float32()), batch.column("backoff").cast(pa.float32())], names=["key", "logp", "backoff"])

    both = union(rows).withColumn("backoff", F.lit(None).cast("double")).unionByName(union(backoffs).withColumn("logp", F.lit(None).cast("double")))
    return both.mapInArrow(tidy(key), "key long, logp float, backoff float").groupBy("key").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff"))


# ---- scoring -----------------------------------------------------------------


class Table:
    """64-bit keys to rows, by direct address with an overflow for slots that keys share."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = np.uint64(64 - max(10, int(len(keys)).bit_length() + 2))
        slot = (keys >> self.bits).astype(np.int64)
        self.row = np.full(1 << (64 - int(self.bits)), -1, np.int32)
        order = np.arange(len(keys) - 1, -1, -1)
        self.row[slot[order]] = order  # the first of a slot stays
        rest = np.flatnonzero(self.row[slot] != np.arange(len(keys)))
        self.keys = keys if len(keys) else np.zeros(1, np.uint64)
        by_key = np.argsort(keys[rest])
        self.rest, self.rest_keys = rest[by_key], keys[rest][by_key]
        self.size = len(keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        row = self.row[(keys >> self.bits).astype(np.int64)].astype(np.int64)
        wrong = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        if len(wrong):
            row[wrong] = -1
            if len(self.rest):
                at = np.minimum(np.searchsorted(self.rest_keys, keys[wrong]), len(self.rest) - 1)
                hit = self.rest_keys[at] == keys[wrong]
                row[wrong[hit]] = self.rest[at[hit]]
        return row


class Known:
    """Grams met before, by their unmixed keys: the latest of each slot, by direct address. A gram that another one has pushed out is new again.

    Text repeats its grams: most positions are settled here by one look, without a sort or a search.
    """

    def __init__(self, valued: bool = False) -> None:
        self.bits = np.uint64(64 - KNOWN_BITS)
        slots = np.arange(1 << KNOWN_BITS, dtype=np.uint64)
        self.key = (slots ^ np.uint64(1)) << self.bits  # empty: a key of another slot
        self.value = np.zeros(1 << KNOWN_BITS if valued else 0)

    def new(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the distinct keys that aren't known, a position of each); from now on they are."""
        fresh = np.flatnonzero(self.key[keys >> self.bits] != keys)
        distinct, one = np.unique(keys[fresh], return_index=True)
        self.key[distinct >> self.bits] = distinct
        return distinct, fresh[one]

    def values(self, keys: np.ndarray, find: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The value of each key; find has those that aren't known, from a position of each."""
        slot = keys >> self.bits
        out = self.value[slot]
        fresh = np.flatnonzero(self.key[slot] != keys)
        distinct, one, inverse = np.unique(keys[fresh], return_index=True, return_inverse=True)
        found = find(fresh[one])
        out[fresh] = found[inverse]
        slot = distinct >> self.bits
        self.key[slot] = distinct
        stays = self.key[slot] == distinct
        self.value[slot[stays]] = found[stays]
        return out


class Slice:
    """The part of the model that a chunk needs."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, backoff: np.ndarray) -> None:
        self.table, self.logp, self.backoff = Table(keys), logp, np.nan_to_num(backoff, nan=0.0)
        self.known = Known(valued=True)

    def logs(self, chars: np.ndarray, at: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """ln P of the character at each position, by the longest gram that the model has; NaN without a model."""
        out = np.full(len(at), np.nan)
        weight = np.zeros(len(at))
        left = np.arange(len(at))
        ends, contexts = grams(chars, at), grams(chars, at - 1, ORDER - 1)
        for m in range(ORDER, -1, -1):
            key = keyed(ends[m - 1][left] if m else np.zeros(len(left), np.uint64), m, lang[left])
            row = self.table.find(key)
            p = np.where(row >= 0, self.logp[row], np.nan) if self.table.size else np.full(len(row), np.nan)
            hit = ~np.isnan(p)
            out[left[hit]] = p[hit] + weight[left[hit]]
            left = left[~hit]
            if not len(left) or not m:
                break
            if m > 1:
                row = self.table.find(keyed(contexts[m - 2][left], m - 1, lang[left]))
                weight[left] += np.where(row >= 0, self.backoff[row], 0.0) if self.table.size else 0.0
        return out

    def text_logs(self, chars: np.ndarray, at: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """logs of running text: it depends on the full gram and the language alone, so each distinct one is looked up once while it is known."""
        return self.known.values(unmixed(full_grams(chars)[at], ORDER, lang), lambda one: self.logs(chars, at[one], lang[one]))


def _chunked(documents: DataFrame, key: str | None = None) -> DataFrame:
    """key (null without a column of that name), doc_id, lang, text, chunk.

    A chunk is a run of CHUNK_ROWS rows of a file; documents that aren't read from files are written first.
    """
    key = F.col(key) if key else F.lit(None)

    def columns(df: DataFrame) -> DataFrame:
        return df.select(key.cast("long").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / CHUNK_ROWS)).alias("chunk"))

    try:
        return columns(documents)
    except AnalysisException:
        return columns(written(documents, "kn-documents"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The parts of a batch with one chunk each."""
    chunk = batch.column("chunk").to_numpy()
    edges = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)] if len(chunk) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(chunk[a]), batch.slice(a, b - a)


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("lang").to_pylist()
    known = {x: np.uint64(language_key(x)) for x in set(values)}
    return np.array([known[x] for x in values], np.uint64)


def _positions(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, positions of real ones, row of each)."""
    chars, starts, row = characters(raw, off)
    real = np.ones(len(chars), bool)
    for k in range(ORDER - 1):
        real[starts[:-1] + k] = False
    at = np.flatnonzero(real)
    return chars, at, row[at]


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(chunk: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.unique(np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), chunk)), pa.array(keys.view(np.int64))], names=["chunk", "key"])

    now, parts = None, []
    for batch in batches:
        for chunk, run in _runs(batch):
            if chunk != now:
                if parts:
                    yield out(now, parts)
                parts, full, shorter = [], Known(), Known()
            now = chunk
            lang = _languages(run)
            for first, end, raw, off in text_chunks(run.column("text"), CHUNK_BYTES):
                chars, at, row = _positions(raw, off)
                of = lang[first:end][row]
                parts.append(keyed(np.uint64(0), 0, np.unique(lang[first:end])))
                new, one = full.new(unmixed(full_grams(chars)[at], ORDER, of))
                parts.append(mix(new))
                at, of = at[one], of[one]
                for polynomials in (grams(chars, at, ORDER - 1), grams(chars, at - 1, ORDER - 1)):  # the ends of the distinct full grams, and their contexts
                    for m, polynomial in enumerate(polynomials, 1):
                        parts.append(mix(shorter.new(unmixed(polynomial, m, of))[0]))
                if sum(map(len, parts)) > max(1 << 20, 2 * len(parts[0])):  # grams that were pushed out come again
                    parts = [np.unique(np.concatenate(parts))]
    if parts:
        yield out(now, parts)


def score(documents: DataFrame, model: DataFrame, key: str | None = None) -> DataFrame:
    """key, doc_id, lang, n_chars, n_words, mean_log (null where there is no character or no model of the language), one row per row."""
    spark = documents.sparkSession
    rows = _chunked(documents, key)
    folder = fresh_path(spark, "kn-slices")
    wanted = rows.select("lang", "text", "chunk").mapInArrow(tidy(_chunk_keys), "chunk long, key long")
    # both halves of a chunk that two tasks read list its grams: partitioned by key, they become one row without another shuffle
    wanted = wanted.repartition("key").dropDuplicates(["key", "chunk"])
    found = wanted.join(model, "key").select("chunk", "key", "logp", "backoff")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: list[pa.RecordBatch] = []
        now = None
        done: list[int] = []

        def close() -> None:
            fs, local = filesystem(f"{folder}/{now}/")
            fs.create_dir(local, recursive=True)
            t = pa.Table.from_batches(held)
            temporary = f"{local.rstrip('/')}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, t.schema) as out:
                out.write_table(t)
            fs.move(temporary, f"{local.rstrip('/')}/slice.arrow")  # the same rows whichever attempt wrote them
            done.append(now)

        for batch in batches:
            for chunk, run in _runs(batch):
                if chunk != now and held:
                    close()
                    held = []
                now = chunk
                held.append(run.select(["key", "logp", "backoff"]))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["chunk"])

    # a chunk's slice is bounded by the distinct grams of its rows
    written(found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(tidy(store), "chunk long"), "kn-stored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for batch in batches:
            for chunk, some in _runs(batch):
                if chunk != now or part is None:
                    now, part = chunk, _load(folder, chunk)
                lang = _languages(some)
                for first, end, raw, off in text_chunks(some.column("text"), CHUNK_BYTES):
                    n = end - first
                    chars, at, row = _positions(raw, off)
                    logs = part.text_logs(chars, at, lang[first:end][row])
                    count = np.bincount(row, minlength=n)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        mean = np.bincount(row, logs, n) / count
                    words = np.bincount(words_of(raw, off)[2], minlength=n)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("key").slice(first, n), some.column("doc_id").slice(first, n), some.column("lang").slice(first, n), pa.array(count.astype(np.int64)), pa.array(words.astype(np.int64)), pa.array(mean, pa.float64(), from_pandas=True)], names=["key", "doc_id", "lang", "n_chars", "n_words", "mean_log"]
                    )

    return rows.mapInArrow(tidy(run), "key long, doc_id long, lang string, n_chars long, n_words long, mean_log double")


def _load(folder: str, chunk: int) -> Slice:
    fs, local = filesystem(f"{folder}/{chunk}/slice.arrow")
    from pyarrow.fs import FileType

    if fs.get_file_info(local).type == FileType.NotFound:  # no gram of the chunk is in the model
        return Slice(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    with fs.open_input_file(local) as f:
        t = pa.ipc.open_file(f).read_all()
    column = lambda c: t.column(c).combine_chunks()
    return Slice(np.asarray(column("key").to_numpy()).view(np.uint64), column("logp").to_numpy(zero_copy_only=False).astype(float), column("backoff").to_numpy(zero_copy_only=False).astype(float))


# ---- the classifier ----------------------------------------------------------


def classify(documents: DataFrame, labels: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, lang, perplexity (a character), threshold (of the language), kept: one row per row of documents (key, if named, first).

    Trusted documents are those that labels call quality 1 (of several labels of one doc_id, the largest). A text without
    words isn't kept. Where none of a language's trusted documents is held out, its threshold is that of all languages'
    held-out documents; where there is no trusted text of the language, or none is held out at all, its documents are kept. A null
    language is a language of its own (shown as an empty string); a null doc_id is scored but never trusted. Rows with one
    doc_id are each judged by their own text, and are all trusted or none. Equal texts of one language get equal results.
    Texts of any length are scored whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    trusted = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q")).filter("q = 1").select("doc_id")
    n = trusted.count()
    small = (lambda df: F.broadcast(df)) if n <= MOST_BROADCAST else (lambda df: df)
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    model = written(train(text.join(small(trusted.filter(~held)), "doc_id", "left_semi").select("lang", "text")), "kn-model")
    scores = written(score(documents, model, key), "kn-scores")
    loss = -F.col("mean_log") - SHORT / F.sqrt("n_chars")
    judged = scores.withColumn("loss", loss)
    outside = judged.filter("mean_log IS NOT NULL AND n_words > 0").join(small(trusted.filter(held)), "doc_id", "left_semi")
    quantile = F.percentile_approx("loss", F.lit(QUANTILE), F.lit(100_000))
    thresholds = written(outside.groupBy("lang").agg(quantile.alias("limit")), "kn-limits")
    if thresholds.count() <= MOST_BROADCAST:
        thresholds = F.broadcast(thresholds)
    overall = outside.agg(quantile).first()[0]
    out = judged.join(thresholds, "lang", "left").withColumn("limit", F.coalesce("limit", F.when(F.col("mean_log").isNotNull(), F.lit(overall).cast("double"))))
    keep = (F.col("n_words") > 0) & (F.col("limit").isNull() | F.coalesce(F.col("loss") <= F.col("limit") + ROOM, F.lit(True)))
    named = [F.col("key").alias(key)] if key else []
    return out.select(*named, "doc_id", "lang", F.exp(-F.col("mean_log")).alias("perplexity"), F.exp(F.col("limit") + ROOM).alias("threshold"), keep.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
