"""Vectorised helpers over the UTF-8 bytes of an Arrow string column.

Everything here works on a run of texts at once, a few MB at a time, and knows nothing of Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer text is handled by itself.
CHUNK = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after lower-casing: digits, letters, everything that is not ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_HASH = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, (2, 256), np.uint64)
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the rolling hash's base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_P, _P_INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


class RangeHash:
    """64-bit hashes of any byte ranges of ``buf``, by differences of a prefix sum."""

    def __init__(self, buf: np.ndarray, salt: int = 0):
        p, self.inverse = powers(len(buf) + 1)
        self.prefix = np.empty(len(buf) + 1, U)
        self.prefix[0] = 0
        np.cumsum(BYTE_HASH[salt][buf] * p[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(U))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    binary = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
    wide = pa.types.is_large_binary(binary.type)
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[binary.offset:binary.offset + len(binary) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of texts with at most ``limit`` bytes, or one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end
        first = end


def word_spans(buf: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text index) of the words, runs of ``word_bytes``, of the texts in ``buf``."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    inside = word_bytes[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets[:-1]] = True
    fresh = first[:-1].copy()
    fresh[0] = True
    fresh[1:] |= ~inside[:-1]
    last = first[1:].copy()
    last[-1] = True
    last[:-1] |= ~inside[1:]
    start, end = np.flatnonzero(inside & fresh), np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int = 64) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes folded in at a time; longer than ``longest``: a digest."""
    length = end - start
    h = mix(length.astype(U) * U(0x2545F4914F6CDD1D) + U(0x9E3779B97F4A7C15))
    eights = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    live, at = np.flatnonzero((length > 0) & (length <= longest)), 0
    while len(live):
        rest = length[live] - at
        part = eights[start[live] + at].astype(U)
        part &= np.where(rest < 8, (U(1) << (U(8) * np.minimum(rest, 7).astype(U))) - U(1), ~U(0))
        h[live] = mix(h[live] ^ part)
        live, at = live[rest > 8], at + 8
    for i in np.flatnonzero(length > longest):
        h[i] = np.frombuffer(hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=8).digest(), U)[0]
    return h


def folded(ids: np.ndarray, start: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of the runs ids[start : start + length]; every id passes through ``mix``, so order counts."""
    h = np.full(len(start), mix(np.array([salt], U))[0]) ^ length.astype(U)
    live, at = np.arange(len(start)), 0
    while len(live):
        live = live[length[live] > at]
        h[live] = mix(h[live] ^ ids[start[live] + at]) + U(at)
        at += 1
    return h


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of word shingles, lower-cased; a text of fewer words is one shingle."""
    start, end, doc = word_spans(buf, offsets)
    n = len(start)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    words = word_hashes(LOWER[buf], start, end)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    out, owner = [], []
    if n >= size:
        m = n - size + 1
        h = np.zeros(m, U)
        for j in range(size):
            h = mix(h ^ words[j:j + m]) + U(j)
        full = doc[:m] == doc[size - 1:]
        out.append(h[full])
        owner.append(doc[:m][full])
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for k in range(1, size):
        few = np.flatnonzero(counts == k)
        if len(few):
            h = np.zeros(len(few), U)
            for j in range(k):
                h = mix(h ^ words[begin[few] + j]) + U(j)
            out.append(h)
            owner.append(few)
    h, d = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def weighted_set(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, count) of distinct shingles per text; ``doc`` ascends."""
    if not len(h):
        return h, doc, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return h[first], doc[first], np.diff(np.append(first, len(h)))
