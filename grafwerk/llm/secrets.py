"""Secret scans with a trigram inverted index.

Of each rule's regular expression, parsed by the standard library, a Boolean query over trigrams is derived that
every text with a match satisfies. A segment of texts (a run of rows of a batch) gets an inverted index: postings of
the trigrams that any rule asks for, made by one numpy lookup over its bytes. The queries combine postings; only the
texts that satisfy a rule's query are searched with its expression. A rule without mandatory trigrams (a bare
character class) is searched for in all texts. Segments are indexed where they lie, so nothing is shuffled.

Expressions match ASCII only, in bytes; spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tidy
from .spans import EMPTY_DIGEST, digest, joined

MOST_STRINGS = 64  # alternatives kept exactly while a query is derived; beyond, they become trigram conditions


def _entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * np.log2(c / n) for c in (data.count(b) for b in set(data)))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = field(default=lambda m: True)
    base: bool = False
    #: the pattern's matches in linear time, where the expression alone would try a run of characters from each of its places
    find: Callable[[bytes], Iterator[tuple[int, int]]] | None = None


_SCHEME = re.compile(rb"[a-z]")
_LOGIN = re.compile(rb"://[^\x00-\x20:@/]+:[^\x00-\x20:@/]{4,}@")
_TOKEN = re.compile(rb"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+")
_SCHEME_RUN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789+.-")
_TOKEN_RUN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def _back(text: bytes, at: int, done: int, run: frozenset[int]) -> int:
    while at > done and text[at - 1] in run:
        at -= 1
    return at


def _logins(text: bytes) -> Iterator[tuple[int, int]]:
    """From each :// backwards: all starts in the run before it have the same end, so the first letter of the run is the match's."""
    done, at = 0, text.find(b"://")
    while at >= 0:
        m = _LOGIN.match(text, at)
        start = m and _SCHEME.search(text, _back(text, at, done, _SCHEME_RUN), at)
        if start:
            yield start.start(), m.end()
            done = m.end()
        at = text.find(b"://", max(done, at + 1))


def _tokens(text: bytes) -> Iterator[tuple[int, int]]:
    """From each .eyJ backwards, likewise."""
    done, at = 0, text.find(b".eyJ")
    while at >= 0:
        m = _TOKEN.match(text, at)
        start = text.find(b"eyJ", _back(text, at, done, _TOKEN_RUN), at) if m else -1
        if start >= 0 and at - start >= 11:
            yield start, m.end()
            done = m.end()
        at = text.find(b".eyJ", max(done, at + 1))


_assign = "(" + "|".join("".join(f"[{c.lower()}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
RULES = [
    Rule("assign", _assign + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16, True),
    Rule("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", find=_tokens),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)", lambda m: _entropy(m[1]) >= 3),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20:@/]+:([^\x00-\x20:@/]{4,})@", find=_logins),
]
KINDS = [r.kind for r in RULES]

# ---- Boolean trigram queries -------------------------------------------------
# A query is True (no condition), a trigram, or ("and" | "or", queries).


def all_of(queries: list) -> object:
    rest = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not rest else rest[0] if len(rest) == 1 else ("and", tuple(rest))


def any_of(queries: list) -> object:
    rest = list(dict.fromkeys(queries))
    return True if True in rest or not rest else rest[0] if len(rest) == 1 else ("or", tuple(rest))


def _of_string(s: bytes) -> object:
    return all_of([s[i : i + 3] for i in range(len(s) - 2)])


def _of_strings(strings: set[bytes]) -> object:
    return any_of([_of_string(s) for s in sorted(strings)])


def _class(items) -> set[int] | None:
    if items[0][0] is sre.NEGATE:
        return None
    found: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            found.add(arg)
        elif op is sre.RANGE:
            found.update(range(arg[0], arg[1] + 1))
        else:
            return None
    return found if len(found) <= 8 else None


def _fold(c: int) -> bytes:
    return bytes([c]).lower()


def _derive(tree) -> tuple[set[bytes] | None, object]:
    """(all strings that the tree matches, lower-cased, if few; a condition that every match's text satisfies)."""
    exact: set[bytes] | None = {b""}
    conditions: list[object] = []

    def flush() -> None:
        nonlocal exact
        if exact:
            conditions.append(_of_strings(exact))
        exact = None

    whole = True
    for op, arg in tree:
        strings: set[bytes] | None
        condition: object = True
        if op is sre.LITERAL:
            strings = {_fold(arg)}
        elif op is sre.IN:
            c = _class(arg)
            strings = None if c is None else {_fold(x) for x in c}
        elif op is sre.SUBPATTERN:
            strings, condition = _derive(arg[3])
        elif op is sre.BRANCH:
            parts = [_derive(t) for t in arg[1]]
            strings = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            condition = True if strings is not None else any_of([c if s is None else all_of([c, _of_strings(s)]) for s, c in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            s, c = _derive(sub)
            if low == 0:
                strings = s | {b""} if s is not None and high == 1 else None
            else:
                strings = s if low == high == 1 else None
                condition = c if s is None else all_of([c, _of_strings(s)])
        else:
            strings = None
        conditions.append(condition)
        if strings is None:
            flush()
            whole, exact = False, {b""}
        elif len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            flush()
            whole, exact = False, strings
    if whole:
        return exact, all_of(conditions)
    flush()
    return None, all_of(conditions)


def trigram_query(pattern: str) -> object:
    """The condition on lower-cased trigrams that every text with a match of pattern satisfies; True if there is none."""
    strings, condition = _derive(parser.parse(pattern.encode()))
    return condition if strings is None else all_of([condition, _of_strings(strings)])


def _trigrams(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


# ---- a segment's index -------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings (ascending rows) of the trigrams in `wanted` over one segment."""

    _tables: dict[tuple[bytes, ...], np.ndarray] = {}

    def __init__(self, raw: np.ndarray, off: np.ndarray, wanted: list[bytes]) -> None:
        self.rows = np.arange(len(off) - 1)
        key = tuple(wanted)
        if key not in self._tables:
            table = np.zeros(1 << 24, np.uint16)
            for i, t in enumerate(wanted, 1):
                table[t[0] << 16 | t[1] << 8 | t[2]] = i
            self._tables[key] = table
        b = _LOWER[raw]
        if len(b) < 3:
            self.postings = {}
            return
        code = b[:-2].astype(np.uint32)
        code <<= np.uint32(8)
        code |= b[1:-1]
        code <<= np.uint32(8)
        code |= b[2:]
        which = self._tables[key][code]
        at = np.flatnonzero(which)
        row = np.searchsorted(off, at, "right") - 1
        inside = at + 3 <= off[row + 1]
        at, row = at[inside], row[inside]
        pairs = np.unique(which[at].astype(np.int64) << 40 | row)
        ids, rows = pairs >> 40, pairs & ((1 << 40) - 1)
        edges = np.searchsorted(ids, np.arange(1, len(wanted) + 2))
        self.postings = {t: rows[edges[i] : edges[i + 1]] for i, t in enumerate(wanted)}

    def answer(self, query: object) -> np.ndarray:
        if query is True:
            return self.rows
        if isinstance(query, bytes):
            return self.postings.get(query, self.rows[:0])
        op, parts = query
        found = sorted((self.answer(q) for q in parts), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if op == "and" else np.union1d(out, x)
        return out


# ---- scanning ----------------------------------------------------------------

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _hex_runs(raw: np.ndarray, off: np.ndarray, least: int = 32) -> list[tuple[int, int, int]]:
    """(row, start, end) in bytes of the maximal runs of [0-9a-f] of least or more: the full scan of the hex rule, in numpy."""
    hit = _HEX[raw]
    if not len(hit):
        return []
    start, end = hit.copy(), hit.copy()
    start[1:] &= ~hit[:-1]
    end[:-1] &= ~hit[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    start[inner], end[inner - 1] = hit[inner], hit[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = e - s >= least
    s, e = s[long], e[long]
    row = np.searchsorted(off, s, "right") - 1
    return list(zip(row.tolist(), (s - off[row]).tolist(), (e - off[row]).tolist()))


class Scanner:
    def __init__(self, rules: list[Rule] = RULES) -> None:
        self.rules = [(r, re.compile(r.pattern.encode()), trigram_query(r.pattern)) for r in rules]
        self.wanted = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))

    def segment(self, raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
        """row -> spans in code points, of rows with any."""
        index = TrigramIndex(raw, off, self.wanted)
        data = raw.tobytes()
        found: dict[int, list[tuple[str, int, int]]] = {}
        for rule, expression, query in self.rules:
            if rule.kind == "hex":
                for row, a, b in _hex_runs(raw, off):
                    found.setdefault(row, []).append(("hex", a, b))
                continue
            for row in index.answer(query).tolist():
                # over a slice, so that no match reaches beyond the text
                text = data[off[row] : off[row + 1]]
                if rule.find is not None:
                    found.setdefault(row, []).extend((rule.kind, a, b) for a, b in rule.find(text))
                    continue
                for m in expression.finditer(text):
                    if rule.accept(m):
                        found.setdefault(row, []).append((rule.kind, m.start(), m.end()))
        found = {row: spans for row, spans in found.items() if spans}
        for row, spans in found.items():
            text = data[off[row] : off[row + 1]]
            if not text.isascii():
                before = np.concatenate([[0], np.cumsum((raw[off[row] : off[row + 1]] & 0xC0) != 0x80)])
                found[row] = [(k, int(before[a]), int(before[b])) for k, a, b in spans]
        return found


_scanners: dict[str, Scanner] = {}


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of documents.

    A null text is empty, and an empty one has no spans (spans is an empty string). Spans of different kinds may overlap;
    all are kept. Other columns are ignored, a null doc_id stays null, an empty table gives an empty result.
    """
    base = [r.kind for r in RULES if r.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.setdefault("default", Scanner())
        for batch in batches:
            for first, end, raw, off in text_chunks(batch.column(1)):
                n = end - first
                counts = {k: np.zeros(n, np.int64) for k in base}
                digests, texts = [EMPTY_DIGEST] * n, [""] * n
                for row, spans in scanner.segment(raw, off).items():
                    kept = [s for s in spans if s[0] in counts]
                    for k, _, _ in kept:
                        counts[k][row] += 1
                    digests[row], texts[row] = digest(kept, KINDS), joined(spans, KINDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *[pa.array(counts[k]) for k in base], pa.array(digests), pa.array(texts)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
