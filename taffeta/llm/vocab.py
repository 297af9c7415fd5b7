"""Words of a block of texts as numbers, exact: equal numbers are equal words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from taffeta.llm.hashing import LOWER, Words, mix

_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def coded(words: Words, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, and the distinct words that the numbers stand for."""
    m = len(words.starts)
    if not m:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    data = LOWER[words.data] if lower else words.data
    edges = np.empty(2 * m, np.int64)
    edges[::2], edges[1::2] = words.starts, words.ends
    spans = pa.Array.from_buffers(pa.large_string(), 2 * m - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    table = spans.dictionary_encode()
    codes = table.indices.to_numpy(zero_copy_only=False)[::2].astype(np.int64)
    used = np.bincount(codes, minlength=len(table.dictionary)) > 0  # the others stand between words only
    return (np.cumsum(used) - 1)[codes], table.dictionary.filter(pa.array(used))


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some distinct words, the same in every task."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def follow(hashed: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of sequences, from those of all but the last member and those of the last."""
    return mix(hashed * _STEP + following)


def doc_of(words: Words) -> np.ndarray:
    """The index of each word's text."""
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
