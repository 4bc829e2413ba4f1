"""The Kneser-Ney scorer settles repeated grams once, with the results of looking up each position."""

import numpy as np
import pyarrow as pa
import pytest

from grafwerk.llm import perplexity
from grafwerk.llm.common import text_chunks


def batch(chunks):
    texts = ["the cat sat on the mat, the cat sat", "", None, "die Katze saß auf der Matte 2024", "a", "the cat\tsat　on it " * 50]
    langs = ["en", "en", "", "de", "", "en"]
    return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(texts), pa.array(chunks)], names=["lang", "text", "chunk"])


def strings(row):
    """All grams of a row's text up to ORDER, and contexts."""
    text = "".join(" " if c.isspace() else "0" if c.isdigit() else c for c in row["text"] or "")
    padded = chr(perplexity.PAD) * (perplexity.ORDER - 1) + text
    ends = range(perplexity.ORDER, len(padded) + 1)
    return {padded[e - m : e] for e in ends for m in range(perplexity.ORDER + 1)} | {padded[e - 1 - m : e - 1] for e in ends for m in range(1, perplexity.ORDER)}


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_listed_keys_and_logs_whatever_the_slots(monkeypatch, bits):
    monkeypatch.setattr(perplexity, "KNOWN_BITS", bits)
    rows = batch([3, 3, 3, 3, 4, 4])
    got = pa.Table.from_batches(list(perplexity._chunk_keys(iter([rows.slice(0, 2), rows.slice(2)])))).to_pylist()
    want = set()
    for row in rows.to_pylist():
        grams = sorted(strings(row) | {""})
        want |= {(row["chunk"], int(k)) for k in perplexity.keys_of_strings(grams, [row["lang"]] * len(grams)).view(np.int64)}
    assert len(got) == len(want) and {(r["chunk"], r["key"]) for r in got} == want

    keys = np.unique(np.array([k for _, k in want]).view(np.uint64))
    rng = np.random.default_rng(1)
    part = perplexity.Slice(keys, np.where(rng.random(len(keys)) < 0.6, -rng.random(len(keys)), np.nan), -rng.random(len(keys)))
    lang = perplexity._languages(rows)
    for first, end, raw, off in text_chunks(rows.column("text"), 200):
        chars, at, row = perplexity._positions(raw, off)
        of = lang[first:end][row]
        for _ in range(2):
            np.testing.assert_array_equal(part.text_logs(chars, at, of), part.logs(chars, at, of))


def test_repeated_text_is_looked_up_once(monkeypatch):
    looked = []
    find = perplexity.Table.find
    monkeypatch.setattr(perplexity.Table, "find", lambda self, keys: looked.append(len(keys)) or find(self, keys))
    part = perplexity.Slice(np.arange(1, 9, dtype=np.uint64) << np.uint64(40), -np.ones(8), np.zeros(8))
    lang = perplexity._languages(batch([1] * 6))
    (_, _, raw, off), = text_chunks(pa.array(["some words again " * 1000]))
    chars, at, row = perplexity._positions(raw, off)
    part.text_logs(chars, at, lang[:1][row])
    assert len(at) == 17_000 and sum(looked) < 2 * perplexity.ORDER * 40
