"""Vectorised word and shingle hashes of a list of texts, shared by the operators that run inside
Arrow tasks. Everything here sees a bounded block of whole texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xC2B2AE3D27D4EB4F
_powers = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``: white space is ASCII only, so bytes decide.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: ASCII digits and letters, all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least ``n`` of each."""
    if _powers["n"] < n:
        size = max(n, BLOCK_BYTES + (1 << 18))
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each input bit over the word (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of whole texts of about ``limit`` characters; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


class Words:
    """Words of texts: ``starts``/``ends`` byte positions in ``data``, ``first`` the index of each
    text's first word (one entry more than texts), ``hashes`` a 64-bit hash of each lower-cased
    word. Null counts as the empty text."""

    def __init__(self, texts: list[str | None], word_bytes: np.ndarray = SPACED):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        self.at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=self.at[1:])
        self.at += 1
        inside = word_bytes[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.at)
        self._sums = None

    def sums(self) -> np.ndarray:
        """Running polynomial sums; ``span`` turns two positions into the hash of what lies between."""
        if self._sums is None:
            up, _ = _power_tables(len(self.data))
            terms = LOWER[self.data].astype(np.uint64)
            terms += np.uint64(1)
            terms *= up[: len(terms)]
            self._sums = np.zeros(len(terms) + 1, np.uint64)
            np.cumsum(terms, out=self._sums[1:])
        return self._sums

    def span(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self.sums()
        _, down = _power_tables(len(self.data))
        return mix((sums[end] - sums[begin]) * down[begin])

    @property
    def hashes(self) -> np.ndarray:
        return self.span(self.starts, self.ends)

    def shingles(self, size: int) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's ``size``-word shingles. A text of fewer words has
        its whole word sequence as its one shingle; a text without words has none."""
        hashes = self.hashes
        n = len(hashes) - size + 1
        joined = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for j in range(size):
                joined *= np.uint64(_STEP)
                joined += hashes[j : j + n]
            joined = mix(joined)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(joined[a : b - size + 1]))
            elif b > a:
                whole = b - a
                for h in hashes[a:b].tolist():
                    whole = (whole * _STEP + h) & _MASK
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
