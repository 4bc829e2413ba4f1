"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading. Archives are cut into splits, of SPLIT_BYTES or a quarter of the file, whichever is less. A task finds in its split every place that looks like the head of a
record (also inside payloads) and follows each one's successors to the first beyond the split: candidate
offset -> exit offset. Pointer jumping over these hops, from offset 0 of each file, doubles the distance each
round and so finds, in log2(splits of a file) rounds, the places where the true chain enters each split.
Only records on that chain are parsed; magic inside a payload is never on it.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, fresh_path, tidy, written

MAGIC = b"WARC/1.1\r\n"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 16 << 20
HEAD_BYTES = 1 << 16
LEAST_REVISIT = 100
MOST_BROADCAST = 300_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_records(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, body (the payload, compressed by zstandard for the shuffle; null: empty), payload_bytes, payload_digest, refers_to.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, that with the smallest page_id is the response and
    the others revisit it. Repeated rows with that same smallest page_id are all responses; a null page_id never is the
    smallest unless all are null, when all are responses. Extra columns are dropped. The only group that is counted
    by digest is pre-aggregated. The digests that recur are broadcast if they are most_broadcast at most (about 100 bytes
    each), else joined by a shuffle of compressed payloads.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"))
    first = rows.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy(F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    first = written(first, "warc-first")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "html"] + [T.StructField("body", T.BinaryType())])
    if first.count() <= most_broadcast:
        first = F.broadcast(first)
    joined = rows.mapInArrow(tidy(_compressed), schema).join(first, F.col("payload_digest") == F.col("_digest"), "left")
    return joined.select("page_id", "url", "body", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        body = [zstd.compress(x.encode()) for x in batch.column("html").to_pylist()]
        rest = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(body, pa.binary())], names=[*rest, "body"])


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record if refers_to is given. Control characters of a url are percent-encoded."""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:page:null-{uuid.uuid4()}"
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "urn:unknown"
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes records as .warc files of about file_bytes at most (a larger record has its own) and returns path and size of each.

    A repeated task writes other files; only files in the returned manifest count. No records, no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, sink, size, path, k, zstd = [], None, 0, "", 0, zstandard.ZstdDecompressor()
        for batch in batches:
            for page_id, url, body, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "payload_digest", "refers_to"))):
                data = record(page_id, url, zstd.decompress(body), digest, refers_to)
                if sink is not None and size + len(data) > file_bytes:
                    sink.close()
                    done.append((path, size))
                    sink = None
                if sink is None:
                    path, size, k = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{k:04d}-{uuid.uuid4().hex}.warc", 0, k + 1
                    fs, local = filesystem(path)
                    fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(local)
                sink.write(data)
                size += len(data)
        if sink is not None:
            sink.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    return written(records.select("page_id", "url", "body", "payload_digest", "refers_to").mapInArrow(tidy(write), "path string, size long"), "warc-manifest")


def parse_head(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(fields, start of the block, start of the next record) of a head at that place, or None if there is none."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(MAGIC, at):
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not (length := fields.get("content-length", "")).isdecimal() or "warc-type" not in fields:
        return None
    return fields, end + 4, end + 4 + int(length) + 4


def candidates(data: bytes, length: int) -> tuple[list[tuple[int, int]], int | None]:
    """((offset, start of the next record) of every head that begins in data[:length], the first that data may end too early for, or None).

    Linear in data, whatever it holds: the lines before a blank line are looked at once, from the last one up, for all heads
    that end with it.
    """
    found: list[tuple[int, int]] = []
    at = data.find(MAGIC, 0, length + len(MAGIC) - 1)
    while at >= 0:
        begin = at + len(MAGIC)
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            # no blank line yet: a head only if all whole lines so far have a colon
            bad = _last_bad(data, begin)
            while at >= 0 and at + len(MAGIC) <= bad:
                at = data.find(MAGIC, at + 1, length + len(MAGIC) - 1)
            return found, at if at >= 0 else None
        bad, size, kind, value = -1, -1, -1, 0
        place = end
        for line in reversed(data[begin:end].split(b"\r\n")):
            place -= len(line)
            name, colon, rest = line.partition(b":")
            if not colon:
                bad = place
                break
            name = name.strip().lower()
            if name == b"content-length" and size < 0:
                size, value = place, int(rest) if rest.strip().isdigit() else -1
            if name == b"warc-type" and kind < 0:
                kind = place
            place -= 2
        while 0 <= at <= end:
            if at < length and at + len(MAGIC) > bad and size >= at + len(MAGIC) and kind >= at + len(MAGIC) and value >= 0:
                found.append((at, end + 4 + value + 4))
            at = data.find(MAGIC, at + 1, length + len(MAGIC) - 1)
    return found, None


def _last_bad(data: bytes, begin: int) -> int:
    """Where the last whole line without a colon from begin on starts, or -1."""
    place, last = begin, -1
    for line in data[begin:].split(b"\r\n")[:-1]:
        if b":" not in line:
            last = place
        place += len(line) + 2
    return last


def hops_of_split(read, start: int, length: int, size: int) -> list[tuple[int, int]]:
    """Candidates of the split at start: (offset, exit offset). read(offset, n) gives the file's bytes.

    What follows the split is read as far as a head that crosses its end needs.
    """
    more = HEAD_BYTES
    data = read(start, length + more)
    found, open_at = candidates(data, length)
    while open_at is not None and start + len(data) < size:
        more *= 4
        data = read(start, length + more)
        found, open_at = candidates(data, length)
    after = {start + a: start + b for a, b in found if start + b <= size}
    exits: dict[int, int] = {}
    for offset in sorted(after, reverse=True):  # successors lie behind, so their exits are known
        to = after[offset]
        exits[offset] = exits.get(to, to) if to < start + length else to
    return sorted(exits.items())


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record on the chains from the starts of the files: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload_matches.

    payload_matches says whether a response's payload has the digest and length that its head gives (true for revisits).
    Heads and payloads may be of any length. A null url comes back as urn:unknown, a null page_id as null. A chain that meets
    something other than a record before the end of its file raises. No files, no rows.
    """
    files = manifest.filter("size > 0").withColumn("split", F.least(F.lit(split_bytes), F.greatest(F.lit(1024), F.ceil(F.col("size") / 4))).cast("long"))
    splits = files.select("path", "size", "split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("split"))).alias("start"))
    most = files.agg(F.max(F.ceil(F.col("size") / F.col("split"))), F.sum(F.ceil(F.col("size") / F.col("split")))).first()
    per_file, tasks = int(most[0] or 1), int(most[1] or 1)
    if not most[1]:
        splits = splits.limit(0)
    spread = lambda df: df.repartition(tasks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = filesystem(row["path"])
                with fs.open_input_file(local) as f:

                    def read(offset: int, n: int) -> bytes:
                        f.seek(offset)
                        return f.read(n)

                    found = hops_of_split(read, row["start"], row["split"], row["size"])
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["path", "at", "to"])

    entered = files.select("path", F.lit(0).cast("long").alias("at"))
    hops = written(spread(splits).mapInArrow(tidy(scan), "path string, at long, to long"), "warc-hops")
    targets = hops.select("path", F.col("to").alias("at")).union(entered).distinct()
    jumps = written(hops.join(targets, ["path", "at"], "left_semi"), "warc-jumps")
    for _ in range(math.ceil(math.log2(per_file)) if per_file > 1 else 0):
        ahead = jumps.select("path", F.col("at").alias("to"), F.col("to").alias("_next"))
        step = entered.join(jumps, ["path", "at"]).select("path", F.col("to").alias("at"))
        entered = written(entered.union(step).distinct(), "warc-entered")
        jumps = written(jumps.join(ahead, ["path", "to"]).select("path", "at", F.col("_next").alias("to")), "warc-jumps")
    entries = entered.join(files, "path").filter("at < size").withColumn("end", F.least(F.col("size"), (F.floor(F.col("at") / F.col("split")) + 1) * F.col("split")))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = filesystem(row["path"])
                out = []
                with fs.open_input_file(local) as f:
                    at = row["at"]
                    f.seek(at)
                    data, base = f.read(row["end"] - at), at
                    while at < row["end"]:
                        found = parse_head(data, at - base)
                        if not found or base + found[2] > base + len(data):  # its head or block goes beyond what was read
                            n = HEAD_BYTES
                            while True:
                                f.seek(at)
                                data, base = f.read(min(n, row["size"] - at)), at
                                if (found := parse_head(data, 0)) or at + n >= row["size"] or not data.startswith(MAGIC):
                                    break
                                n *= 4
                            if not found or at + found[2] > row["size"]:
                                raise ValueError(f"{row['path']}: no record at {at}")
                            f.seek(at)
                            data = f.read(found[2])
                            found = parse_head(data, 0)
                        fields, block, after = found
                        out.append(_row(fields, data[block : after - 4]))
                        at = base + after
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    return spread(entries).mapInArrow(tidy(parse), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_matches boolean")


_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_matches"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix("urn:page:")
    return int(number) if not number.startswith("null") else None


def _row(fields: dict[str, str], block: bytes) -> tuple:
    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        got = hashlib.sha256(payload).hexdigest()
        return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), len(payload), got, kind, None, got == digest and len(payload) == int(fields["x-payload-length"])
    return _page(fields["warc-record-id"]), fields.get("warc-target-uri"), int(fields["x-payload-length"]), digest, kind, _page(fields["warc-refers-to"]), True


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(with_records(pages), fresh_path(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
