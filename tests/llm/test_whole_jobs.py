"""Inputs of which an operator once did only a part."""

import itertools
import time

import numpy as np
import pyarrow as pa
import pytest

from grafwerk.cluster import ship
from grafwerk.llm import pii, toxicity
from grafwerk.llm.common import text_chunks


def hashes(words):
    _, _, raw, off = next(text_chunks(pa.array([" ".join(words)])))
    return toxicity.words(raw, off)[0]


# ---- 6: toxicity -------------------------------------------------------------


@pytest.fixture(scope="module")
def many_terms(spark):
    """300 toxic seeds, and 1,300 unlabelled terms that stand beside them only."""
    ship(spark)
    words = ["".join(w) for w in itertools.islice(itertools.product("klmnopq", repeat=5), 1600)]
    bad, tied = words[:300], words[300:]
    common = ["".join(w) for w in itertools.islice(itertools.product("abcdefg", repeat=5), 400)]
    fill = [" ".join(common[(7 * i + j) % 400] for j in range(200)) for i in range(300)]
    rows = [(i, " ".join(bad)) for i in range(60)] + [(100 + i, t) for i, t in enumerate(fill)]
    rows += [(1000 + i, " ".join([bad[i % 1300 % 300], t, bad[i % 1300 % 300]])) for i, t in enumerate(tied * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, {i: int(i < 60) for i, _ in rows if i < 400}, bad, tied


def test_every_toxic_seed_and_every_tied_term_gets_a_weight(many_terms):
    docs, labels, bad, tied = many_terms
    _, lexicon, weights = toxicity.induce(docs, labels)
    assert set(hashes(bad).tolist()) <= set(lexicon.tolist()) and (weights > 0).all()
    assert set(hashes(tied).tolist()) <= set(lexicon.tolist())


def test_toxicity_graph_and_walks_by_joins_alone(many_terms, monkeypatch):
    docs, labels, _, _ = many_terms
    docs = docs.filter("doc_id < 30 OR doc_id BETWEEN 100 AND 130 OR doc_id % 9 = 0")
    monkeypatch.setattr(toxicity, "STEPS", 3)
    lean, terms = toxicity.seeds(docs, labels)
    counted = toxicity.written(toxicity.term_counts(docs, terms), "test-counts")
    (nodes, edges), (far_nodes, far_edges) = toxicity.graph(docs, terms, counted, lean), toxicity.graph(docs, terms, counted, lean, most=0)
    key = lambda df: {(r.a, r.b): r.w for r in df.collect()}
    assert sorted(nodes.collect()) == sorted(far_nodes.collect())
    assert key(edges) == pytest.approx(key(far_edges)) and edges.count() > 1000
    sent = toxicity._sent(nodes, 1 << 40)
    count = lambda df: {(r.a, r.b): r.n for r in df.collect()}
    assert count(toxicity.node_pairs(docs, terms, sent, hold=50)) == count(toxicity.pair_counts(docs, terms, sent, sent).filter("a <> b"))
    rows = [sorted((r.term, r.plus, r.minus) for r in toxicity.walked(nodes, edges, *most).collect()) for most in ((1 << 40, 1 << 40), (0, 1 << 40), (0, 0))]
    for other in rows[1:]:
        assert [r[0] for r in rows[0]] == [r[0] for r in other] and np.allclose(np.array(rows[0])[:, 1:].astype(float), np.array(other)[:, 1:].astype(float), rtol=1e-9, atol=0)


# ---- 8: personal data --------------------------------------------------------


def test_a_long_stretch_among_short_ones_is_decoded_in_its_own_time():
    t, r = pii.Tagger(3), np.random.default_rng(1)
    length = np.array([3000, *r.integers(2, 12, 400)])
    e = r.normal(0, 3, (len(length), 3000, pii.TAGS))
    seconds = []
    for rows in (1, len(length)):
        t.decode(e[:rows, :50], np.minimum(length[:rows], 50))
        begun = time.process_time()
        t.decode(e[:rows], length[:rows])
        seconds.append(time.process_time() - begun)
    assert seconds[1] < 6 * seconds[0]


def test_decoding_against_logarithms_and_every_path():
    t, r = pii.Tagger(3), np.random.default_rng(2)
    t.w["move"], t.w["first"] = r.normal(0, 1, (pii.TAGS, pii.TAGS)), r.normal(0, 1, pii.TAGS)
    length = np.array([4, 1, 90, 3, 2, 90, 17])
    e = r.normal(0, 4, (7, 90, pii.TAGS))
    e[1, 0, 0], e[5, 30:, 4] = 99, 60  # a row of O alone; sums far beyond what a plain number holds
    start, final = r.normal(0, 1, (7, pii.TAGS)) + t.mask_first, r.normal(0, 1, (7, pii.TAGS))
    tags, chance = t.decode(e, length, start, final)
    move = t.w["move"] + t.mask
    for k, n in enumerate(length):
        z, alpha, beta = t.forward_backward(e[k : k + 1, :n], None, start[k : k + 1], final[k : k + 1])
        want = np.exp((alpha + beta)[0, np.arange(n), tags[k, :n]] - z)
        assert np.isnan(chance[k, :n]).all() if not tags[k, :n].any() else chance[k, :n] == pytest.approx(np.minimum(want, 1), abs=1e-9)
        if n < 5:
            score = lambda p: start[k, p[0]] + e[k, range(len(p)), p].sum() + move[p[:-1], p[1:]].sum() + final[k, p[-1]]
            best = max(itertools.product(range(pii.TAGS), repeat=int(n)), key=lambda p: score(np.array(p)))
            assert tuple(tags[k, :n].tolist()) == best


def test_scores_are_those_of_the_trained_network_averaged_over_windows():
    t, r = pii.Tagger(3), np.random.default_rng(3)
    edges = np.cumsum([0, 1, 47, 48, 49, 64, 65, 112, 113, 400])
    symbols = r.integers(0, 98, edges[-1])
    got = pii.averaged(t, symbols, edges[:-1], edges[1:], step=5)
    total, weight = np.zeros((len(symbols), pii.TAGS)), np.zeros(len(symbols))
    for a, b in itertools.pairwise(edges.tolist()):
        for at in range(a, max(a + 1, b - (pii.WIDTH - pii.STRIDE)), pii.STRIDE):
            x = np.append(symbols[at : min(b, at + pii.WIDTH)], [98] * (pii.WIDTH - min(b - at, pii.WIDTH))).astype(int)
            e = (t._lstm(t.w["emb"][x][None], None) @ t.w["out"] + t.w["bias"])[0]
            for k in range(min(b - at, pii.WIDTH)):
                m = 1 + min(k, pii.WIDTH - 1 - k)
                total[at + k] += m * e[k]
                weight[at + k] += m
    assert np.abs(got - total / weight[:, None]).max() < 1e-4


def test_texts_left_out_have_no_part_of_any_form():
    r = np.random.default_rng(4)
    some = ["at", " at ", "@", "(at)", "[AT]", ".", " dot ", "[dot]", "a", "b-c", " ", "1", "23", "\u0663", "\u00b2", "1.2.3.4", "one", "zwei", " three ", "Z\u00c9RO", "s\u0131x", "cinq-", "someone", "twosome", "\u212a"]
    out = 0
    for _ in range(1500):
        text = "".join(r.choice(some, r.integers(1, 14)))
        if not pii.may_hold(text):
            out += 1
            parts = {text[a:b] for a in range(len(text)) for b in range(a + 1, len(text) + 1)}
            assert not any(pii.trimmed(k, x) for x in parts for k in range(len(pii.BASE))), text
    assert out > 300
    assert not pii.may_hold("Someone looked at it in 2024, on page 17. " + "no more of it " * 50)
    for text in ("jane dot doe at example dot org", "x at b.c", "1 . 2 . 3 . 4", "123-456-789", "\u0661" * 9, "tone two three four five six sevenths"):
        assert pii.may_hold("word " * 99 + text + " word" * 99)


def test_letters_alike_but_for_case():
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    letters = {c for w in pii._WORDS_OF_DIGITS for c in w}
    for c in letters:
        assert all(x.lower() == c or pii._LIKE_ASCII.match(x) for x in pii.re.findall(c, every, pii.re.I))
    word = set(pii.re.findall(r"[^\W\d_]", every))
    assert all(all(y in word for y in x.lower()) == (x in word) for x in every if x.lower() != x and not pii._LIKE_ASCII.match(x))


def test_spans_are_the_same_with_the_texts_left_out(monkeypatch):
    r = np.random.default_rng(5)
    plain = "the man looked at home and then one of two came by to see it all again in May, "
    texts = [plain * 3 + pii._written(pii.BASE[r.integers(4)], r) + " " + plain if k % 3 == 0 else plain[: 60 + k] for k in range(150)]
    tagger = pii.Tagger()
    tagger.fit(*pii.labelled_windows([plain * 20], 1500), steps=350)
    _, _, raw, off = next(text_chunks(pa.array(texts)))
    seen = []
    averaged = pii.averaged
    monkeypatch.setattr(pii, "averaged", lambda t, symbols, *rest: seen.append(len(symbols)) or averaged(t, symbols, *rest))
    few = pii.scan_chunk(tagger, raw, off)
    monkeypatch.setattr(pii, "may_hold", lambda text: True)
    assert few == pii.scan_chunk(tagger, raw, off)
    assert sum(x[0].startswith("model") for s in few.values() for x in s) >= 5 and seen[0] < 0.9 * seen[1]
