"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions for spans that the patterns miss.

Patterns (email, ip, card, phone) run over whole texts. The model adds spans of the same four meanings written otherwise, also
in words ("jane dot doe at example dot org"). Windows of WIDTH characters every STRIDE lie over whole texts, but for texts in
which no span could be reported, as no part of them has the form of any kind (may_hold(): spans are the same with them). They overlap:
the scores of a character are averaged over its windows, weighted towards their middles, and one Viterbi pass reconciles
them. Viterbi runs only where the best path can leave O: a run of characters whose scores, with the dearest transitions
granted, can't add up to more than O's is O in every best path, so leaving it out changes nothing. Texts beyond BLOCK
characters are taken in blocks that overlap by OVER on either side; a span belongs to the block in whose core it begins.

The model is trained in numpy, by Adam on the exact CRF likelihood, from at most WINDOWS labelled windows of excerpts of
EXCERPT characters, at a place given by a hash, of at most twice SAMPLE documents of any length: the patterns' spans in
them, and written variants placed in them, with numbers of other meanings as O. SAMPLE and WINDOWS are parameters of scan().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks, tidy
from .spans import EMPTY_DIGEST, digest, joined

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *[f"model_{k}" for k in BASE]]
WIDTH, STRIDE = 64, 48
BLOCK, OVER = 1 << 18, 1 << 12
SAMPLE = 400
WINDOWS = 6000
HIDDEN, EMBEDDED, STEPS, BATCH = 16, 14, 900, 48
EXCERPT = 20_000
SURE = 0.7  # least posterior chance of a span's tags, on average
TAGS = 1 + 2 * len(BASE)  # O, then B and I of each kind

# ---- patterns ----------------------------------------------------------------

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(rb"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(rb"[^0-9]+")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: bytes) -> list[tuple[str, int, int]]:
    """Leftmost matches, found from each @ backwards, in linear time."""
    found, done, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
        # what lies before this @ can't belong to a later address
        done = m.end() if m else at + 1
        at = text.find(b"@", done)
    return found


def base_spans(text: bytes) -> list[tuple[str, int, int]]:
    """The patterns' spans, in bytes."""
    found = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (p.lstrip(b"0") for p in m[0].split(b"."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _NOT_DIGITS.sub(b"", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub(b"", m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


# ---- the network -------------------------------------------------------------


def alphabet(cp: np.ndarray) -> np.ndarray:
    """Symbols of code points: printable ASCII each its own, digits one, 96 white space, 97 other letters and signs, 98 beyond the text."""
    out = np.full(cp.shape, 97, np.int64)
    ascii_ = (cp >= 32) & (cp < 127)
    out[ascii_] = cp[ascii_] - 32
    out[(cp >= 48) & (cp <= 57)] = 16
    out[(cp == 32) | ((cp >= 9) & (cp <= 13))] = 96
    return out


SYMBOLS = 99


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): in the place of tanh, and as 0.5 + 0.5 * squash(x) of a sigmoid; an eighth of their time. Its slope is (1 - |y|)^2."""
    return x / (1 + np.abs(x))


def packed(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places of rows so long: all first places, longest row first, then all second ones, and so on."""
    order = np.argsort(-length, kind="stable")
    row, place = np.repeat(order, length[order]), np.arange(length.sum()) - np.repeat(np.cumsum(length[order]) - length[order], length[order])
    by_place = np.argsort(place, kind="stable")
    return row[by_place], place[by_place]


class Tagger:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        h, e = HIDDEN, EMBEDDED
        self.w = {"emb": r.normal(0, 0.3, (SYMBOLS, e)), "out": r.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 1 / np.sqrt(e), (e, 4 * h))
            self.w[f"h{d}"] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.w[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.mask = np.zeros((TAGS, TAGS))
        for a in range(TAGS):
            for b in range(2, TAGS, 2):  # I of a kind follows B or I of it
                if a not in (b - 1, b):
                    self.mask[a, b] = -1e4
        self.mask_first = np.array([-1e4 if b and b % 2 == 0 else 0.0 for b in range(TAGS)])

    def _lstm(self, x: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (rows, places, 2 * HIDDEN) of both directions, run side by side: the second one over reversed places."""
        n, t, _ = x.shape
        wx, wh, bias = (np.stack([self.w[k + "f"], self.w[k + "b"]]) for k in "xhc")
        both = np.stack([x, x[:, ::-1]]).reshape(2, n * t, -1)
        gates = np.ascontiguousarray((both @ wx + bias[:, None]).reshape(2, n, t, -1).transpose(2, 0, 1, 3))
        h, c = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
        out = np.empty((n, t, 2 * HIDDEN))
        for k in range(t):
            z = gates[k] + h @ wh
            z = squash(z)
            s = 0.5 + 0.5 * z[..., : 3 * HIDDEN]
            i, f, o = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :]
            g = z[..., 3 * HIDDEN :]
            before, last = c, h
            c = f * c + i * g
            tc = squash(c)
            h = o * tc
            out[:, k, :HIDDEN] = h[0]
            out[:, t - 1 - k, HIDDEN:] = h[1]
            if keep is not None:
                keep.append((k, i, f, o, g, before, last, tc))
        return out

    def tables(self) -> dict[str, np.ndarray]:
        """The weights of a pass without training, transposed and of single precision; "step" takes the hidden state, the embedding and a 1.

        Hidden states of such a pass are twice as large, as its gates aren't halved: the weights upon them are.
        """
        if not hasattr(self, "_tables"):
            step = np.stack([np.concatenate([self.w["h" + d].T / 2, self.w["x" + d].T, self.w["c" + d][:, None]], axis=1) for d in "fb"])
            emb = np.concatenate([self.w["emb"], np.ones((SYMBOLS, 1))], axis=1).T
            made = {"step": step, "emb": emb, "out": self.w["out"].T / 2, "bias": self.w["bias"][:, None]}
            self._tables = {k: np.ascontiguousarray(v, np.float32) for k, v in made.items()}
        return self._tables

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """Scores (rows, places, TAGS) of windows. Rows lie innermost, so that each step works on long runs of memory."""
        w = self.tables()
        n, t = symbols.shape
        one, half = np.float32(1), np.float32(0.5)
        x = np.ascontiguousarray(np.take(w["emb"], symbols.T, axis=1).transpose(1, 0, 2))
        fed, c = np.zeros((2, HIDDEN + EMBEDDED + 1, n), np.float32), np.zeros((2, HIDDEN, n), np.float32)
        out = np.empty((t, 2 * HIDDEN, n), np.float32)
        z, some = np.empty((2, 4 * HIDDEN, n), np.float32), np.empty((2, 4 * HIDDEN, n), np.float32)
        i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        h, gates, small = fed[:, :HIDDEN], z[:, : 3 * HIDDEN], some[:, :HIDDEN]
        for k in range(t):
            fed[0, HIDDEN:], fed[1, HIDDEN:] = x[k], x[t - 1 - k]
            np.matmul(w["step"], fed, out=z)
            np.abs(z, out=some)
            some += one
            z /= some
            gates += one  # twice the gates
            c *= f
            i *= g
            c += i
            c *= half
            np.abs(c, out=small)
            small += one
            np.divide(c, small, out=h)
            h *= o
            out[k, :HIDDEN] = h[0]
            out[t - 1 - k, HIDDEN:] = h[1]
        return (w["out"] @ out + w["bias"]).transpose(2, 0, 1)

    @staticmethod
    def _lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    def forward_backward(self, e: np.ndarray, length: np.ndarray | None = None, start: np.ndarray | None = None, final: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ln Z, alpha, beta) of emissions (rows, places, tags); places from length on don't count.

        start and final are scores of the first and after the last place (of a text's start and nothing, if not given).
        """
        n, t, _ = e.shape
        move = self.w["move"] + self.mask
        real = np.ones((n, t), bool) if length is None else np.arange(t)[None] < length[:, None]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + (self.w["first"] + self.mask_first if start is None else start)
        last = np.zeros((n, TAGS)) if final is None else final
        beta[:, -1] = last
        for k in range(1, t):
            a = self._lse(alpha[:, k - 1, :, None] + move, 1) + e[:, k]
            alpha[:, k] = np.where(real[:, k, None], a, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            b = self._lse(move + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(real[:, k + 1, None], b, last)
        return self._lse(alpha[:, -1] + last, 1), alpha, beta

    def step(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a character, and its gradient."""
        n, t = symbols.shape
        x = self.w["emb"][symbols]
        kept: list = []
        h = self._lstm(x, kept)
        e = h @ self.w["out"] + self.w["bias"]
        z, alpha, beta = self.forward_backward(e)
        move = self.w["move"] + self.mask
        rows = np.arange(n)
        gold = e[rows[:, None], np.arange(t)[None], tags].sum(1) + (self.w["first"] + self.mask_first)[tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(1)
        scale = 1 / (n * t)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        de = np.exp(alpha + beta - z[:, None, None])
        g["first"] = de[:, 0].sum(0)
        np.add.at(g["first"], tags[:, 0], -1)
        de[rows[:, None], np.arange(t)[None], tags] -= 1
        g["move"] = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.add.at(g["move"], (tags[:, :-1].reshape(-1), tags[:, 1:].reshape(-1)), -1)
        g["bias"] = de.sum((0, 1))
        g["out"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        dh = de @ self.w["out"].T
        wx, wh = (np.stack([self.w[k + "f"], self.w[k + "b"]]) for k in "xh")
        part = np.stack([dh[:, :, :HIDDEN], dh[:, ::-1, HIDDEN:]])
        back, cell = np.zeros((2, n, HIDDEN)), np.zeros((2, n, HIDDEN))
        dzs, lasts = np.empty((2, n, t, 4 * HIDDEN)), np.empty((2, n, t, HIDDEN))
        for k, i, f, o, c_in, before, last, tc in reversed(kept):
            dhk = part[:, :, k] + back
            dc = cell + dhk * o * (1 - np.abs(tc)) ** 2
            slope = lambda gate: 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            dz = np.concatenate([dc * c_in * slope(i), dc * before * slope(f), dhk * tc * slope(o), dc * i * (1 - np.abs(c_in)) ** 2], axis=2)
            cell, back = dc * f, dz @ wh.transpose(0, 2, 1)
            dzs[:, :, k], lasts[:, :, k] = dz, last
        flat = dzs.reshape(2, n * t, -1)
        both = np.stack([x, x[:, ::-1]]).reshape(2, n * t, -1)
        of_x, of_h, of_c = both.transpose(0, 2, 1) @ flat, lasts.reshape(2, n * t, -1).transpose(0, 2, 1) @ flat, flat.sum(1)
        for d, name in enumerate("fb"):
            g[f"x{name}"], g[f"h{name}"], g[f"c{name}"] = of_x[d], of_h[d], of_c[d]
        back_x = (flat @ wx.transpose(0, 2, 1)).reshape(2, n, t, -1)
        dx = back_x[0] + back_x[1][:, ::-1]
        np.add.at(g["emb"], symbols.reshape(-1), dx.reshape(-1, EMBEDDED))
        return float((z - gold).sum() * scale), {k: v * scale for k, v in g.items()}

    def fit(self, symbols: np.ndarray, tags: np.ndarray, steps: int = STEPS, rate: float = 0.02, seed: int = 11) -> list[float]:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for s in range(1, steps + 1):
            some = r.integers(0, len(symbols), BATCH)
            loss, g = self.step(symbols[some], tags[some])
            losses.append(loss)
            norm = np.sqrt(sum((v**2).sum() for v in g.values()))
            now = rate * min(1, 2 * (1 - s / (steps + 1)))
            for k in self.w:
                v = g[k] * min(1, 0.5 / (norm + 1e-12))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                self.w[k] = self.w[k] - now * (first[k] / (1 - 0.9**s)) / (np.sqrt(second[k] / (1 - 0.999**s)) + 1e-8)
        return losses

    def decode(self, e: np.ndarray, length: np.ndarray, start: np.ndarray | None = None, final: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(best tags, posterior chance of each) of stretches padded to one length; no chances (nan) in rows of O alone."""
        n, t, _ = e.shape
        start = np.broadcast_to(self.w["first"] + self.mask_first if start is None else start, (n, TAGS))
        final = np.broadcast_to(np.zeros(TAGS) if final is None else final, (n, TAGS))
        row, place = packed(length)
        tags, chance = np.zeros((n, t), np.int64), np.full((n, t), np.nan)
        tags[row, place], chance[row, place] = self.decode_packed(e[row, place].astype(float), row, place, start, final)
        return tags, chance

    def decode_packed(self, e: np.ndarray, row: np.ndarray, place: np.ndarray, start: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """decode() of scores in the order of packed(): each stretch costs its own length, however long the others are."""
        move = self.w["move"] + self.mask
        base = np.searchsorted(place, np.arange(place[-1] + 2)).tolist() if len(place) else [0, 0]
        order = row[: base[1]]
        best = e[: base[1]] + start[order]
        back = np.empty(e.shape, np.int8)
        for a, b in zip(base[1:], base[2:]):
            s = best[: b - a, :, None] + move
            back[a:b] = s.argmax(1)
            np.add(s.max(1), e[a:b], out=best[: b - a])
        now = (best + final[order]).argmax(1) if len(e) else np.zeros(0, np.int64)
        tags = np.empty(len(e), np.int64)
        each = np.arange(len(order))
        for a, b in zip(base[-2::-1], base[:0:-1]):
            tags[a:b] = now[: b - a]
            now[: b - a] = back[a:b][each[: b - a], tags[a:b]]
        chance = np.full(len(e), np.nan)
        some = np.zeros(int(row.max(initial=-1)) + 1, bool)
        some[row[tags > 0]] = True
        if some.any():
            on = some[row]
            chance[on] = self._chances(e[on], row[on], place[on], tags[on], start, final)
        return tags, chance

    def _chances(self, e: np.ndarray, row: np.ndarray, place: np.ndarray, tags: np.ndarray, start: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Posterior chances of tags, packed. Sums are of plain numbers, scaled at each place to add up to one.

        What that rounds to zero can't be on a path that counts: a span with a head of so little weight would do better to begin after it.
        """
        base = np.searchsorted(place, np.arange(place[-1] + 2)).tolist()
        order = row[: base[1]]
        step = np.exp(self.w["move"] + self.mask)
        back_step = np.ascontiguousarray(step.T)
        own = np.exp(e - e.max(1, keepdims=True))
        alpha, beta = np.empty_like(e), np.empty_like(e)
        x = e[: base[1]] + start[order]
        alpha[: base[1]] = np.exp(x - x.max(1, keepdims=True))
        for last, a, b in zip(base, base[1:], base[2:]):
            x = alpha[last : last + b - a] @ step
            x *= own[a:b]
            np.divide(x, x.sum(1, keepdims=True), out=alpha[a:b])
        x = final[order]
        now = np.exp(x - x.max(1, keepdims=True))
        for a, b in zip(base[-2::-1], base[:0:-1]):
            beta[a:b] = now[: b - a]
            x = (own[a:b] * beta[a:b]) @ back_step
            np.divide(x, x.sum(1, keepdims=True), out=now[: b - a])
        alpha *= beta
        return np.minimum(alpha[np.arange(len(e)), tags] / alpha.sum(1), 1.0)

    def may_leave(self, e: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Of scores (places, TAGS) in a row: where any best path can have another tag than O. No span runs over a text's start.

        A span of one kind gains at most: B's score and the dearest way into it, I's scores and the dearest steps to them, and
        the dearest way out, each against O at that place. Places that lie in no possible span with a gain are O.
        """
        move = self.w["move"] + self.mask
        first = self.w["first"] + self.mask_first
        on = np.zeros(len(e), bool)
        after = [0, *range(1, TAGS, 2)]  # what can follow a span
        for b in range(1, TAGS, 2):
            i = b + 1
            opening = (e[:, b] - e[:, 0]).astype(float) + max(float((move[:, b] - move[:, 0]).max()), float(first[b] - first[0]))
            gain = (e[:, i] - e[:, 0]).astype(float) + (max(move[b, i], move[i, i]) - move[0, 0])
            if start is not None:
                gain[start] += self.mask_first[i]
            total = np.cumsum(gain)
            out = max(0.0, float((move[b : i + 1, after] - move[0, after]).max()))
            on |= np.maximum.accumulate(opening - total) + np.maximum.accumulate(total[::-1])[::-1] + out > -1e-6
        return on


# ---- labelled windows --------------------------------------------------------


_DIGIT_WORDS = [x.split() for x in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve")]


def _written(kind: str, r: np.random.Generator) -> str:
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    w = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvw"), r.integers(3, 8)))
    pick = lambda *x: x[r.integers(len(x))]
    if kind == "email" and r.random() < 0.45:
        at = pick(" at ", " (at) ", " [at] ", "(at)", "[at]", " AT ")
        dot = pick(" dot ", " dot ", ".", " [dot] ", " (dot) ") if at.strip().lower() == "at" else pick(" dot ", ".", "[dot]", "(dot)", " [dot] ")
        name = pick(w(), w() + d(2), f"{w()}{pick(dot, '.', '_')}{w()}")
        return f"{name}{at}{w()}{' dot ' if at.strip().lower() == 'at' and dot == '.' else dot}{pick('com', 'org', 'net', 'de', 'fr', 'es')}"
    if kind == "phone" and r.random() < 0.3:
        words = _DIGIT_WORDS[r.integers(len(_DIGIT_WORDS))]
        return pick(" ", " ", "-").join(words[i] for i in r.integers(0, 10, r.integers(7, 12)))
    if kind == "email":
        at, dot = pick(("@", "."), (" @ ", "."), (" @ ", " . "), ("@", "."))
        return f"{w()}{pick('.', '_', '')}{w() if r.random() < 0.5 else d(2)}{at}{w()}{dot}{pick('com', 'org', 'net', 'de', 'fr')}"
    if kind == "ip":
        return pick(".", ".", " . ").join(str(r.integers(0, 256)) for _ in range(4))
    if kind == "card":
        digits = pick("4", "5", "37") + d(13)
        digits += next(c for c in "0123456789" if luhn((digits + c).encode()))
        return pick("", " ", "-", ".").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return pick(f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(2)} {d(3)} {d(4)}")


def _number(r: np.random.Generator) -> str:
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    kinds = [d(1), d(2), f"19{d(2)}", f"20{d(2)}", f"{d(2)}:{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}", f"{d(3)},{d(3)}", f"{d(2)}%", f"${d(3)}.{d(2)}", f"{d(5)}", f"v{d(1)}.{d(2)}", f"({d(4)})", "@", f"{d(4)}-{d(4)}", "".join(r.choice(list("0123456789abcdef"), 32)), f"{d(8)}", f"{d(3)} {d(3)}", f"{d(2)}-{d(2)}", f"id{d(6)}", "@word", f"{d(24)}"]
    return kinds[r.integers(len(kinds))]


def _common(r: np.random.Generator) -> str:
    """Words that spelled-out addresses and numbers are made of, in other places."""
    words = ["at", "dot", "(at)", "com", "at the", "dot the", "AT", "[at]", *[x for some in _DIGIT_WORDS for x in some]]
    return " ".join(words[i] for i in r.integers(0, len(words), r.integers(1, 3)))


def labelled_windows(texts: list[str], count: int = WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, tags) of windows: the patterns' spans in the texts, and variants and other numbers placed in them."""
    r = np.random.default_rng(seed)
    texts = [t for t in texts if len(t) >= WIDTH] or ["word " * WIDTH]
    symbols, tags = [], []

    def add(text: str, spans: list[tuple[str, int, int]], at: int) -> None:
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        t = np.zeros(len(cp), np.int64)
        for kind, a, b in spans:
            k = 1 + 2 * BASE.index(kind)
            t[a], t[a + 1 : b] = k, k + 1
        s = alphabet(cp)[at : at + WIDTH]
        t = t[at : at + WIDTH].copy()
        for k in range(len(t)):  # a span cut by the window's start begins there
            if t[k] and t[k] % 2 == 0 and k == 0:
                t[k] -= 1
        pad = WIDTH - len(s)
        symbols.append(np.concatenate([s, np.full(pad, 98)]))
        tags.append(np.concatenate([t, np.zeros(pad, np.int64)]))

    found: list[tuple[str, list, int]] = []
    for text in texts:
        data = text.encode()
        before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        spans = [(k, int(before[a]), int(before[b])) for k, a, b in base_spans(data)]
        spans = [s for s in spans if not any(o is not s and o[1] < s[2] and s[1] < o[2] for o in spans)]
        found += [(text, spans, max(0, a - int(r.integers(4, 40)))) for _, a, _ in spans]
    for k in r.permutation(len(found))[: count // 3]:  # any of them, of any text
        add(*found[k])
    tries = 0
    while len(symbols) < count:
        text = texts[r.integers(len(texts))]
        at = int(r.integers(0, len(text) - WIDTH + 1))
        piece = text[at : at + WIDTH]
        if any(c.isdigit() or c == "@" for c in piece):  # it may hold personal data itself; texts of nothing else give plain words
            tries += 1
            if tries < 20 * count:
                continue
            piece = ("word " * WIDTH)[:WIDTH]
        parts, spans, done = [], [], 0
        for cut in sorted(r.integers(0, WIDTH, r.integers(1, 3)).tolist()):
            while cut < WIDTH and not piece[cut].isspace():
                cut += 1
            parts.append(piece[done:cut])
            held = sum(map(len, parts))
            done = cut
            if r.random() < 0.5:
                kind = BASE[r.integers(len(BASE))]
                new = _written(kind, r)
                spans.append((kind, held + 1, held + 1 + len(new)))
            else:
                new = _number(r) if r.random() < 0.7 else _common(r)
            parts += [" ", new, ["", " ", ".", ",", " "][r.integers(5)]]
        whole = "".join(parts) + piece[done:]
        add(whole, spans, int(r.integers(0, max(1, min(24, len(whole) - WIDTH)))))
    return np.stack(symbols), np.stack(tags)


def train(texts: list[str], windows: int = WINDOWS) -> Tagger:
    tagger = Tagger()
    tagger.fit(*labelled_windows(texts, windows))
    return tagger


# ---- decoding ----------------------------------------------------------------

_MIDDLE = (1 + np.minimum(np.arange(WIDTH), WIDTH - 1 - np.arange(WIDTH))).astype(np.float32)


def averaged(tagger: Tagger, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 384) -> np.ndarray:
    """Scores (places, TAGS) of the stretches start:end of symbols, averaged over the windows of each character."""
    n = np.maximum(1, -(-(end - start - (WIDTH - STRIDE)) // STRIDE))
    which = np.repeat(np.arange(len(n)), n)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    begin, stop = start[which] + STRIDE * turn, end[which]
    total = np.zeros((len(symbols), TAGS), np.float32)
    padded = np.append(symbols, 98)
    # a window's first STRIDE places, and the rest, which the next window of the stretch has too
    own, rest = np.empty((len(which), STRIDE, TAGS), np.float32), np.empty((len(which), WIDTH - STRIDE, TAGS), np.float32)
    for k in range(0, len(which), step):
        at = begin[k : k + step, None] + np.arange(WIDTH)
        at[at >= stop[k : k + step, None]] = len(symbols)
        e = tagger.emissions(padded[at]) * _MIDDLE[:, None]
        own[k : k + step], rest[k : k + step] = e[:, :STRIDE], e[:, STRIDE:]
    again, last = turn > 0, np.append(turn[1:] == 0, True)[: len(turn)]
    own[again, : WIDTH - STRIDE] += rest[:-1][again[1:]]
    weight = np.broadcast_to(_MIDDLE[:STRIDE], (len(which), STRIDE)).copy()
    weight[again, : WIDTH - STRIDE] += _MIDDLE[STRIDE:]
    own /= weight[:, :, None]
    for places, scores in ((begin[:, None] + np.arange(STRIDE), own), (begin[last, None] + np.arange(STRIDE, WIDTH), rest[last] / _MIDDLE[STRIDE:, None])):
        real = places < (stop if scores is own else stop[last])[:, None]
        total[places[real]] = scores[real]
    return total


def model_spans(tagger: Tagger, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) that the model finds in the stretches start:end of code points."""
    scores = averaged(tagger, alphabet(cp), start, end)
    out: list[tuple[int, int, int]] = []
    if not len(scores):
        return out
    on = tagger.may_leave(scores, start)
    on[1:] |= on[:-1].copy()
    edge = np.zeros(len(on) + 1, bool)
    edge[start], edge[end] = True, True
    inside = np.zeros(len(on) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    on &= np.cumsum(inside)[:-1] > 0
    opens, closes = on.copy(), on.copy()
    opens[1:] &= ~on[:-1] | edge[1:-1]
    closes[:-1] &= ~on[1:] | edge[1:-1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    move = tagger.w["move"] + tagger.mask
    first = tagger.w["first"] + tagger.mask_first
    # what lies beside a stretch is O, or the text's edge
    begin = np.where(edge[a][:, None], first, move[0])
    final = np.where(edge[b][:, None], 0.0, move[:, 0])
    row, place = packed(b - a)
    at = a[row] + place
    tags, chance = np.zeros(len(scores) + 1, np.int64), np.zeros(len(scores))
    tags[at], chance[at] = tagger.decode_packed(scores[at].astype(float), row, place, begin, final)
    for x in np.flatnonzero(tags % 2).tolist():  # no I stands at a text's start, so a span ends with it
        kind, y = int(tags[x]), x + 1
        while tags[y] == kind + 1:
            y += 1
        if chance[x:y].mean() >= SURE:
            out.append(((kind - 1) // 2, x, y))
    return out


_DIGIT_WORD = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted({x for some in _DIGIT_WORDS for x in some})) + r")(?![^\W\d_])", re.I)
_SPELLED = re.compile(r"[\w._%+-]+(?:\s*(?:\[dot\]|\(dot\)|\sdot\s|\.)\s*[\w-]+)*\s*(?:@|\[at\]|\(at\)|\sat\s)\s*[\w-]+(?:\s*(?:\[dot\]|\(dot\)|\sdot\s|\.)\s*[\w-]+)+", re.I)


_PHONE_PART = re.compile(r"[+(]*\d|" + _DIGIT_WORD.pattern, re.I)


def trimmed(kind: int, text: str) -> tuple[int, int] | None:
    """The part of a decoded span that has the form of its kind, or None: an e-mail's, an address's, a card's or a phone number's."""
    if BASE[kind] == "email":
        m = _SPELLED.search(text)
        return m and m.span()
    if BASE[kind] == "ip":
        m = re.search(r"\d+(?:\s?\.\s?\d+){3}", text)
        return m.span() if m and all(len(p) < 4 and int(p) <= 255 for p in re.findall(r"\d+", m[0])) else None
    parts = list(_PHONE_PART.finditer(text))
    if not parts:
        return None
    low = parts[0].start()
    high = max(parts[-1].end(), *[m.end() for m in re.finditer(r"\d", text)], 0)
    text = text[low:high]
    digits, words = sum(c.isdigit() for c in text), len(_DIGIT_WORD.findall(text))
    if BASE[kind] == "card":
        return (low, high) if 12 <= digits <= 19 and luhn("".join(c for c in text if c in "0123456789").encode()) else None
    return (low, high) if 9 <= digits <= 15 or not digits and 7 <= words <= 15 else None


_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS_OF_DIGITS = frozenset(x for some in _DIGIT_WORDS for x in some)
_DIGIT = re.compile(r"[\d" + "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal()) + "]")
_LIKE_ASCII = re.compile("[\u0130\u0131\u017f\u212a]")  # equal to ASCII letters where case doesn't count, but not in lower case
_AFTER_LOCAL = re.compile(r"(?:@|\[at\]|\(at\)|\sat\s)\s*[\w-]+\s*(?:\[dot\]|\(dot\)|\sdot\s|\.)\s*[\w-]", re.I)
_FOUR_NUMBERS = re.compile(r"\d\s?\.\s?\d+\s?\.\s?\d+\s?\.\s?\d")


def may_hold(text: str) -> bool:
    """False only if trimmed() is None for every kind and every part of the text, so that no span of the model's could be reported.

    Each form leaves a trace in the whole text: an e-mail's what follows its name, an address four numbers, a card and a phone
    number nine digits, and one in words seven digit words, of which a part may cut two out of longer words.
    """
    digits = len(_DIGIT.findall(text))
    if digits >= 9 or digits >= 4 and _FOUR_NUMBERS.search(text) or _AFTER_LOCAL.search(text) or _LIKE_ASCII.search(text):
        return True
    return sum(map(_WORDS_OF_DIGITS.__contains__, _LETTERS.findall(text.lower()))) >= 5


_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True


def scan_chunk(tagger: Tagger | None, raw: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """row -> spans in code points, of rows with any."""
    found: dict[int, list[tuple[str, int, int]]] = {}
    if not len(raw):
        return found
    at = np.flatnonzero(_TRIGGER[raw])  # every pattern has a digit or an @
    lead = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    for r in np.unique(np.searchsorted(off, at, "right") - 1).tolist():
        a, b = int(off[r]), int(off[r + 1])
        spans = base_spans(raw[a:b].tobytes())
        if spans:
            found[r] = [(k, int(before[a + s] - before[a]), int(before[a + e] - before[a])) for k, s, e in spans]
    if tagger is not None:
        whole = raw.tobytes().decode("utf-8")
        cut = before[off].tolist()
        rows = [r for r in range(len(cut) - 1) if cut[r] < cut[r + 1] and may_hold(whole[cut[r] : cut[r + 1]])]
        text = "".join(whole[cut[r] : cut[r + 1]] for r in rows)
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = np.cumsum([0, *[cut[r + 1] - cut[r] for r in rows]])
        for core, low, high in _blocks(edges):
            for kind, a, b in model_spans(tagger, cp[low:high], *core[1]):
                a, b = a + low, b + low
                if not core[0][0] <= a < core[0][1] or (part := trimmed(kind, text[a:b])) is None:
                    continue
                at = int(np.searchsorted(edges, a, "right") - 1)
                r, s, e = rows[at], int(a - edges[at]) + part[0], int(a - edges[at]) + part[1]
                if not any(x < e and s < y for _, x, y in found.get(r, [])):
                    found.setdefault(r, []).append((f"model_{BASE[kind]}", s, e))
    return found


def _blocks(edges: np.ndarray, block: int = BLOCK, over: int = OVER) -> Iterator[tuple[tuple, int, int]]:
    """((core, (starts, ends) of stretches from low), low, high): runs of whole texts of about `block` characters; a longer text in parts."""
    n, first = len(edges) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(edges, edges[first] + block, "right")) - 1)
        low, high = int(edges[first]), int(edges[end])
        if high - low <= block:
            full = np.flatnonzero(np.diff(edges[first : end + 1])) + first
            if len(full):
                yield ((low, high), (edges[full] - low, edges[full + 1] - low)), low, high
        else:
            for core in range(low, high, block):
                a, b = max(low, core - over), min(high, core + block + over)
                yield ((core, min(high, core + block)), (np.array([0]), np.array([b - a]))), a, b
        first = end


def scan(documents: DataFrame, sample: int = SAMPLE, windows: int = WINDOWS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of documents.

    The patterns' spans all stay, overlapping or not; the model's spans are added where they overlap no other. A null text
    is empty and has none. Rows with one doc_id are each scanned; equal texts give equal spans. Texts of any length are scanned
    whole. Other columns are ignored, whatever their names, a null doc_id stays null, an empty table gives an empty result; without
    a text to train on, the patterns alone are used.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    some = named.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marked = named.filter(F.col("text").rlike("[0-9@]")).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    wanted = some.union(marked).distinct()
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - EXCERPT + 1)).cast("int") + 1
    excerpts = named.join(F.broadcast(wanted), "doc_id").select("doc_id", F.substring(F.col("text"), at, F.lit(EXCERPT)).alias("text"))
    texts = [r.text for r in excerpts.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect() if r.text]  # excerpts, at most 2 * sample
    tagger = train(texts, windows) if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, off in text_chunks(batch.column(1)):
                n = end - first
                counts = {k: np.zeros(n, np.int64) for k in BASE}
                digests, joint = [EMPTY_DIGEST] * n, [""] * n
                for row, spans in scan_chunk(tagger, raw, off).items():
                    kept = [s for s in spans if s[0] in counts]
                    for k, _, _ in kept:
                        counts[k][row] += 1
                    digests[row], joint[row] = digest(kept, KINDS), joined(spans, KINDS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *[pa.array(counts[k]) for k in BASE], pa.array(digests), pa.array(joint)], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return rows.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
