"""Word hashes and shingle sets of texts, computed with numpy over the bytes of Arrow arrays inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from salesflow.llm.common import WHITE

#: Bytes of text that are hashed at once (more if one word is longer).
PIECE = 1 << 20
#: An odd factor, 3 modulo 8, and its inverse modulo 2^64, for polynomial hashes.
FACTOR = 0xBF58476D1CE4E5BB
INVERSE = pow(FACTOR, -1, 1 << 64)

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of FACTOR and of INVERSE at least; they are kept by the worker."""
    if len(_POWERS[0]) < n:
        for k, factor in enumerate((FACTOR, INVERSE)):
            out = np.full(max(n, PIECE), factor, np.uint64)
            out[0] = 1
            _POWERS[k] = np.cumprod(out, dtype=np.uint64)
    return _POWERS


#: A number for each byte: white space is 0, A-Z are a-z.
_OF_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_WHITE = np.zeros(256, bool)
_WHITE[[ord(c) for c in WHITE]] = True
_OF_BYTE[_WHITE] = 0


def _hashed(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of some bytes; fresh: where texts begin."""
    white, (power, back) = _WHITE[data], powers(len(data))
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[fresh] = True
    after[fresh[fresh > 0] - 1] = True
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts]
    return mixed(h + (ends - starts).astype(np.uint64)), starts


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all texts (A-Z lower-cased, cut at ASCII white space), in order, and the bounds of
    each text's words: text i has [bounds[i], bounds[i + 1])."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    hashes, starts, lo, end = [], [], int(at[0]), int(at[-1])
    while lo < end:
        hi = min(end, lo + PIECE)
        while hi < end and not _WHITE[data[hi]]:  # a piece ends before white space or at the end
            white = np.flatnonzero(_WHITE[data[hi : hi + PIECE]])
            hi = hi + int(white[0]) if len(white) else min(end, hi + PIECE)
        h, s = _hashed(data[lo:hi], np.unique(at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]) - lo)
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def each_text(texts: pa.Array):
    """The word hashes of each text."""
    words, bounds = words_of(texts)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield words[a:b]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, k, np.uint64)
        for j in range(k):
            h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mixed(h)


def shingle_sets(texts: pa.Array, k: int = 5):
    """Distinct hashes of the k-word shingles of each text, ascending; fewer words count as one shingle."""
    words, bounds = words_of(texts)
    grams = windows(words, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a < k:
            yield windows(words[a:b], max(1, b - a))
        else:
            own = np.sort(grams[a : b - k + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            yield own[fresh]


def winnowed(grams: np.ndarray, wide: int) -> np.ndarray:
    """Places of the first smallest of each `wide` neighbours (of all, if fewer), each once, ascending. Hashes are compared by
    their upper 44 bits, which leaves room for the place."""
    wide = min(wide, len(grams))
    low, n, span = np.uint64((1 << 20) - 1), len(grams) - wide + 1, 1
    least = grams & ~low | np.arange(len(grams), dtype=np.uint64) & low
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[wide - span : wide - span + n])
    first = np.arange(n, dtype=np.uint64)
    return np.unique((first + ((least & low) - first & low)).astype(np.int64))
