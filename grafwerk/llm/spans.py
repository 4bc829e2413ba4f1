"""Spans of kinds in texts, as digest columns."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    """kind:start:end by start, then by the place of the kind in kinds (then by end), comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: list[tuple[str, int, int]], kinds: list[str]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
