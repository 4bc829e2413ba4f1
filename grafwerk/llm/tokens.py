"""Token ids of documents in bit-plane-shuffled shard files.

Encoding: texts are cut into pretokens with numpy (the pattern of byte-level BPE, which merges never cross);
each distinct pretoken of a chunk that the worker hasn't met goes through the tokenizers library once, and
texts are put together from the ids of their pretokens. A row that holds characters whose class may differ
between Unicode versions is given to the library whole. The result is what the library gives for the text.
(Pretokens are told apart by 64-bit hashes within one worker's table of at most CACHE_ENTRIES.)

A shard file: MAGIC; blocks of BLOCK ids, each split into planes (bytes or bits of the fixed-width ids), each
plane compressed by zstandard; document ids and id counts, compressed likewise; a chunk index (for each block
its place, count and plane lengths); its length and place. Shards follow one another in ascending doc_id.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, fresh_path, span_hashes, text_chunks, tidy, written

MAGIC = b"GWPLANE1"
BLOCK = 1 << 16
CACHE_ENTRIES = 4_000_000
END_ID = 2
LEVEL = 1
VOCABULARY = "byte_bpe_50k.json"

# ---- pretokens ---------------------------------------------------------------

_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = range(5)
_SPACES = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
_state: dict = {}


def _classes() -> np.ndarray:
    """The class of every code point; _UNSURE where an old and the current Unicode database disagree."""
    if "classes" not in _state:
        table = np.full(0x110000, _UNSURE, np.uint8)
        old = unicodedata.ucd_3_2_0
        kind = {"L": _LETTER, "N": _NUMBER}
        for cp in range(0x110000):
            c = chr(cp)
            a = kind.get(unicodedata.category(c)[0], _OTHER)
            if a == kind.get(old.category(c)[0], _OTHER) and unicodedata.category(c) != "Cn":
                table[cp] = a
        for cp in _SPACES:
            table[cp] = _SPACE
        table[ord("'")] = _OTHER
        _state["classes"] = table
    return _state["classes"]


def pretokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte starts of all pretokens with the end appended, row of each, rows for the library)."""
    text = raw.tobytes().decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(cp)
    cls = _classes()[cp]
    if n == len(raw):
        byte_at, rows_at = np.arange(n + 1), off
    else:
        byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        rows_at = np.searchsorted(byte_at, off)
    odd = np.unique(np.searchsorted(rows_at, np.flatnonzero(cls == _UNSURE), "right") - 1)
    edge = np.zeros(n + 1, bool)
    edge[rows_at] = True
    before = np.empty(n, np.uint8)
    before[0] = 255
    before[1:] = cls[:-1]
    begin = (cls != before) | edge[:-1]
    begin[rows_at[:-1][rows_at[:-1] < n]] = True
    space = cls == _SPACE
    # of a run of spaces before something else, the last stands alone, or with what follows if it is U+0020
    next_other = np.zeros(n, bool)
    next_other[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    begin |= next_other
    glued = np.zeros(n, bool)
    glued[1:] = next_other[:-1] & (cp[:-1] == 0x20)
    # contractions: an apostrophe that begins a pretoken, with s t m d or re ve ll after it
    quote = np.flatnonzero((cp == 0x27) & begin & ~glued)
    for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
        q = quote[quote + len(tail) < n]
        for k, c in enumerate(tail, 1):
            q = q[(cp[q + k] == ord(c)) & ~edge[q + k]]
        begin[q + 1] = False
        after = q + len(tail) + 1
        after = after[after < n]
        begin[after] = True
    begin[glued] = False
    starts = np.flatnonzero(begin)
    row = np.searchsorted(rows_at, starts, "right") - 1
    return np.append(byte_at[starts], len(raw)), row, odd


class Encoder:
    """ids of texts, by way of the distinct pretokens that a worker has met."""

    def __init__(self, vocabulary: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.library.encode_special_tokens = True  # for pretokens; rows with the string of an added token go through the library as it comes
        size = self.library.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.uint16 if self.width == 2 else np.uint32
        chars = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes_of = np.array([len(c) for c in chars], np.int64)  # one character of the byte alphabet a byte
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.dtype)

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """New pretokens, given in ascending order of keys. Runs of ' letters' are encoded as one text, the rest one by one."""
        plain = np.array([p[:1] == b" " and p[1:].isalpha() and len(p) < 200 for p in parts])
        joined = np.flatnonzero(plain)
        alone = np.flatnonzero(~plain)
        texts = [b"".join([parts[i] for i in joined[k : k + 500]]).decode() for k in range(0, len(joined), 500)]
        texts += [parts[i].decode("utf-8") for i in alone]
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter((i for x in ids for i in x), self.dtype)
        order = np.concatenate([joined, alone])
        ends = np.cumsum(np.array([len(parts[i]) for i in order], np.int64))
        upto = np.searchsorted(np.cumsum(self.bytes_of[flat]), ends) + 1
        first = np.concatenate([[0], upto[:-1]])
        at, count = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        at[order], count[order] = first + len(self.pool), upto - first
        self.pool = np.concatenate([self.pool, flat])
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.count = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.count, where, count)

    def rows(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids of each row)."""
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(n, np.int64)
        starts, row, odd = pretokens(raw, off)
        h, first, inverse = np.unique(span_hashes(raw, starts[:-1], starts[1:]), return_index=True, return_inverse=True)
        if len(self.keys) + len(h) > CACHE_ENTRIES:
            self.clear()
        found = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        inside = found < len(self.keys)
        new[inside] = self.keys[found[inside]] != h[inside]
        if new.any():
            data = raw.tobytes()
            self._learn(h[new], [data[starts[i] : starts[i + 1]] for i in first[new].tolist()])
            found = np.searchsorted(self.keys, h)
        count = self.count[found][inverse]
        ends = np.cumsum(count)
        at = np.repeat(self.at[found][inverse] - (ends - count), count)
        at += np.arange(len(at))
        ids = self.pool[at]
        counts = np.bincount(row, count, n).astype(np.int64)
        data = raw.tobytes()
        places = [m.start() for t in self.added for m in re.finditer(re.escape(t), data)]
        if places:
            odd = np.union1d(odd, np.searchsorted(off, places, "right") - 1)
        if len(odd):
            edges = np.concatenate([[0], np.cumsum(counts)])
            self.library.encode_special_tokens = False
            whole = self.library.encode_batch_fast([data[off[r] : off[r + 1]].decode() for r in odd], add_special_tokens=False)
            self.library.encode_special_tokens = True
            parts, done = [], 0
            for r, e in zip(odd.tolist(), whole):
                parts += [ids[edges[done] : edges[r]], np.array(e.ids, self.dtype)]
                counts[r], done = len(e.ids), r + 1
            ids = np.concatenate([*parts, ids[edges[done] :]])
        return ids, counts


def encoder(vocabulary: str) -> Encoder:
    key = ("encoder", vocabulary)
    if key not in _state:
        _state[key] = Encoder(vocabulary)
    return _state[key]


# ---- the shard format --------------------------------------------------------


def to_planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The byte planes of little-endian ids of width bytes, or their bit planes, lowest first."""
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    if not bits:
        return [np.ascontiguousarray(planes[:, k]).tobytes() for k in range(width)]
    return [np.packbits((planes[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, width), np.uint8)
    for k, p in enumerate(planes):
        if bits:
            out[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << np.uint8(k % 8)
        else:
            out[:, k] = np.frombuffer(p, np.uint8)
    return out.reshape(-1).view(f"<u{width}")


class ShardWriter:
    def __init__(self, sink, width: int, bits: bool = False, block: int = BLOCK) -> None:
        self.sink, self.width, self.bits, self.block = sink, width, bits, block
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.sink.write(MAGIC)
        self.at, self.index, self.kept, self.held = len(MAGIC), [], [], 0
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.kept.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.kept)
            whole = len(ids) - len(ids) % self.block
            for k in range(0, whole, self.block):
                self._block(ids[k : k + self.block])
            self.kept, self.held = [ids[whole:]], len(ids) - whole

    def _write(self, data: bytes) -> int:
        self.sink.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        place = self.at
        self.index.append([place, len(ids), *[self._write(self.zstd.compress(p)) for p in to_planes(ids, self.width, self.bits)]])

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.kept))
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype("<i8").tobytes()
        docs = [self.at, self._write(self.zstd.compress(join(self.doc_ids))), self._write(self.zstd.compress(join(self.counts)))]
        place = self.at
        data = self.zstd.compress(json.dumps({"width": self.width, "bits": self.bits, "block": self.block, "docs": docs, "chunks": self.index}).encode())
        self._write(data)
        self._write(struct.pack("<QQ", place, len(data)))


class ShardReader:
    """Random access by chunk; `documents()` goes through them in order."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 16)
        place, length = struct.unpack("<QQ", source.read(16))
        self.zstd = zstandard.ZstdDecompressor()
        self.head = json.loads(self.zstd.decompress(self._at(place, length)))
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        at, a, b = self.head["docs"]
        self.doc_ids = np.frombuffer(self.zstd.decompress(self._at(at, a)), "<i8")
        self.counts = np.frombuffer(self.zstd.decompress(self._at(at + a, b)), "<i8")

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def chunk(self, k: int) -> np.ndarray:
        place, n, *lengths = self.head["chunks"][k]
        data, planes, at = self._at(place, sum(lengths)), [], 0
        for x in lengths:
            planes.append(self.zstd.decompress(data[at : at + x]))
            at += x
        return from_planes(planes, n, self.head["width"], self.head["bits"])

    def documents(self, group: int = 16) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, id counts, ids) of runs of whole documents."""
        rest, k, doc, n = np.zeros(0, f"<u{self.head['width']}"), 0, 0, len(self.head["chunks"])
        ends = np.cumsum(self.counts)
        base = 0
        while k < n or doc < len(self.counts):
            more = [self.chunk(j) for j in range(k, min(n, k + group))]
            k = min(n, k + group)
            rest = np.concatenate([rest, *more])
            upto = int(np.searchsorted(ends, base + len(rest), "right"))
            if upto > doc:
                taken = int(ends[upto - 1] - base)
                yield doc, self.counts[doc:upto], rest[:taken]
                rest, base, doc = rest[taken:], int(ends[upto - 1]), upto
            elif k >= n and doc < len(self.counts):
                raise ValueError("the shard ends within a document")


# ---- Spark -------------------------------------------------------------------

_MANIFEST = "shard long, path string, n_docs long, n_ids long"
_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"


def write_shards(documents: DataFrame, folder: str, vocabulary: str, end_id: int | None = END_ID, bits: bool = False) -> DataFrame:
    """Encodes and writes documents (doc_id, text; other columns are ignored) as shards under folder, in ascending doc_id.

    A null text is empty, a null doc_id comes first and is stored as the least long. Equal doc_ids stay side by side,
    ordered by a hash of the text. Returns the manifest: one row per shard. A repeated task writes another file; only
    files in the manifest count. An empty table gives an empty manifest.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = documents.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        shard, n_docs, n_ids, out = TaskContext.get().partitionId(), 0, 0, None
        path = f"{folder}/ids-{shard:08d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, local = filesystem(path)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(local)
                out = ShardWriter(sink, e.width, bits)
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, raw, off in text_chunks(batch.column(1)):
                ids, counts = e.rows(raw, off)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                out.add(doc_ids[first:end], counts, ids)
                n_docs, n_ids = n_docs + end - first, n_ids + len(ids)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return written(rows.mapInArrow(tidy(encode), _MANIFEST), "ids-manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over shards, not documents
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    tasks = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = filesystem(row["path"])
                start = row["base"]
                with fs.open_input_file(local) as source:
                    reader = ShardReader(source)
                    for doc, counts, ids in reader.documents():
                        data = memoryview(ids.astype("<u4").view(np.uint8).data)
                        ends = np.cumsum(counts)
                        crc = [zlib.crc32(data[4 * (b - c) : 4 * b]) for b, c in zip(ends.tolist(), counts.tolist())]
                        n = len(counts)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.doc_ids[doc : doc + n]), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.array(np.full(n, row["shard"], np.int64))],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                        )
                        start += int(ends[-1])

    return placed.repartition(tasks).mapInArrow(tidy(read), _DIGEST).withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(documents: DataFrame) -> DataFrame:
    manifest = write_shards(documents, fresh_path(documents.sparkSession, "ids"), vocabulary_path())
    return read_digests(manifest)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "n_tokens", "ids_crc32")
