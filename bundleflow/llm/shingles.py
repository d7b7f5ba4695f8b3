"""Word shingles of whole Arrow text columns as sorted 64-bit hashes, in numpy.

Bytes are treated at once for a chunk of texts: a table lower-cases A-Z and marks separators, running sums of a
polynomial in the bytes give every word's hash by subtraction, and five neighbouring word hashes make a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(ord("A"), ord("Z") + 1):
    _BYTE[_c] = _BYTE[_c + 32]
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the largest n so far."""
    if base not in _powers or len(_powers[base]) <= n:
        size = 1 << max(n, CHUNK_BYTES).bit_length()
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n + 1]


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number of each word, hash of each word) for texts that follow each other in ``data``."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    is_word = _IS_WORD[data]
    first = np.zeros(n + 1, bool)
    first[starts[sizes > 0]] = True
    first[n] = True
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1] | first[1:n]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | first[1:n]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, n)[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * _power(_P_INVERSE, n)[begin])
    owner = np.searchsorted(starts[sizes > 0], begin, "right") - 1
    return np.flatnonzero(sizes > 0)[owner], hashes


def sets_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words, the whole sequence as one; else none."""
    owner, words = word_hashes(data, starts, sizes)
    counts = np.bincount(owner, minlength=len(sizes))
    ends = np.cumsum(counts)
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        total = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            total += words[k:n + k] * _PLACE[k]
        total = mix(total)
    out = []
    for count, stop in zip(counts.tolist(), ends.tolist(), strict=True):
        if count >= WORDS:
            own = np.sort(total[stop - count:stop - WORDS + 1])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif count:
            few = words[stop - count:stop]
            own = mix((few * _PLACE[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count))
        else:
            own = words[:0]
        out.append(own)
    return out


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first text, its and the following texts' sets) for stretches of about CHUNK_BYTES; null: empty."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK_BYTES, "right")) - 1)
        yield a, sets_of(data[ends[a]:ends[b]], ends[a:b] - ends[a], ends[a + 1:b + 1] - ends[a:b])
        a = b


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number; equal sets share it."""
    total = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total + np.uint64(len(shingles))).view(np.int64)[0])
