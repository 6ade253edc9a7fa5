"""Suffix ranks of token arrays by prefix doubling, and what they answer.

Each Arrow batch is taken in runs of rows of about ``TOKENS`` tokens, a longer row alone.
All rows of a run are ranked together: n tokens take one sort per doubling, until every
suffix is told apart.  Nothing is shuffled, and equal tokens of other rows never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import as_col

#: Tokens ranked at once; a rank table of them takes 4 bytes a token and doubling.
TOKENS = 1 << 18

PLACES = ArrayType(IntegerType())


def _ends(offsets: np.ndarray) -> np.ndarray:
    """For each token the place where its row ends."""
    return np.repeat(offsets[1:], np.diff(offsets))


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs; both parts count from 0 and stay below 2^31."""
    return np.unique((high.astype(np.int64) << 32) | low, return_inverse=True)[1].astype(np.int32)


def rank_table(codes: np.ndarray, offsets: np.ndarray, depth: int | None = None) -> list[np.ndarray]:
    """Entry j ranks the 2^j tokens from each place on, within its row.

    Shorter rests at the end of a row rank before what they begin.  Ends when all ranks
    differ, or with the blocks of at most ``depth`` tokens.
    """
    ends, at = _ends(offsets), np.arange(len(codes))
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    table = [_dense(rows, codes)]
    while len(codes) and int(table[-1].max()) + 1 < len(codes):
        half = 1 << (len(table) - 1)
        if depth is not None and 2 * half > depth:
            break
        rest = np.zeros(len(codes), np.int64)
        inside = at + half < ends
        rest[inside] = table[-1][at[inside] + half] + 1
        table.append(_dense(table[-1], rest))
    return table


def least_unique(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each place the least length from there on that occurs once in its row.

    One more than the longer common prefix with a neighbour in suffix order; more than what is
    left of the row where nothing from there on is unique.
    """
    table, ends, n = rank_table(codes, offsets), _ends(offsets), len(codes)
    order = np.argsort(table[-1], kind="stable")
    left, right = order[:-1], order[1:]
    common = np.zeros(len(left), np.int64)
    # Blocks that reach past the end of a row are never equal, so the table alone bounds the sum.
    for j in range(len(table) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a < ends[left]) & (b < ends[right])
        same = table[j][np.minimum(a, n - 1)] == table[j][np.minimum(b, n - 1)]
        common += np.where(inside & same, 1 << j, 0)
    longest = np.zeros(n, np.int64)
    longest[left] = common
    longest[right] = np.maximum(longest[right], common)
    return longest + 1


def _runs(offsets: np.ndarray, tokens: int = 0) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``tokens`` tokens (``TOKENS`` by default)."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + (tokens or TOKENS), "right")) - 1
        stop = max(start + 1, stop)
        yield start, stop
        start = stop


def _lists(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat values and offsets from 0 of a list array; null lists are empty."""
    sizes = np.asarray(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return array.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def _codes(values: pa.Array) -> np.ndarray:
    """Equal tokens as equal numbers; a null is a token of its own."""
    return np.asarray(values.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False), np.int64)


def _as_lists(parts: list[np.ndarray], sizes: np.ndarray, nulls: pa.Array) -> pa.Array:
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()), mask=nulls)


@F.arrow_udf(PLACES)
def least_unique_from(tokens: pa.Array) -> pa.Array:
    """Per place the least length from there on that is unique in the array (null: null)."""
    values, offsets = _lists(tokens)
    codes, parts = _codes(values), []
    for start, stop in _runs(offsets):
        lo, hi = offsets[start], offsets[stop]
        parts.append(least_unique(codes[lo:hi], offsets[start:stop + 1] - lo))
    return _as_lists(parts, np.diff(offsets), tokens.is_null())


def _matches(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Rows alternate between tokens and a phrase: the places of each phrase in the tokens before it."""
    sizes = np.diff(offsets)
    # Tokens and phrase are ranked as one row, so equal blocks of both have equal ranks.
    table = rank_table(codes, offsets[::2], int(sizes[1::2].max(initial=1)))
    found = []
    for p in range(len(sizes) // 2):
        text, phrase, m = offsets[2 * p], offsets[2 * p + 1], int(sizes[2 * p + 1])
        n = int(sizes[2 * p])
        if not 0 < m <= n:
            found.append(np.zeros(0, np.int64))
            continue
        # Two blocks of the largest size cover the phrase.  Where the table ended before that size
        # all its last ranks differ, so nothing matches.
        j = min(len(table), m.bit_length()) - 1
        hit = np.ones(n - m + 1, bool)
        for done in (0, m - (1 << j)):
            hit &= table[j][text + done:text + done + n - m + 1] == table[j][phrase + done]
        found.append(np.flatnonzero(hit))
    return found


@F.arrow_udf(PLACES)
def phrase_positions(phrase: pa.Array, tokens: pa.Array) -> pa.Array:
    """Zero-based places of ``phrase`` in ``tokens`` (null if one is null, none for an empty phrase)."""
    (words, cuts), (sought, ends) = _lists(tokens), _lists(phrase)
    # Tokens and phrase of a row side by side: [tokens, phrase] of row 0, of row 1, ...
    codes = _codes(pa.concat_arrays([words, sought.cast(words.type)]))
    texts, phrases = codes[:len(words)], codes[len(words):]
    both = np.zeros(2 * len(tokens) + 1, np.int64)
    both[1:] = np.cumsum(np.column_stack([np.diff(cuts), np.diff(ends)]).ravel())
    parts: list[np.ndarray] = []
    for start, stop in _runs(both[::2]):
        joined = np.concatenate([x for r in range(start, stop) for x in (
            texts[cuts[r]:cuts[r + 1]], phrases[ends[r]:ends[r + 1]])])
        parts += _matches(joined, both[2 * start:2 * stop + 1] - both[2 * start])
    sizes = np.array([len(p) for p in parts], np.int64)
    return _as_lists(parts, sizes, pc.or_(tokens.is_null(), phrase.is_null()))


def unique_lengths(tokens: Column | str) -> tuple[Column, Column]:
    """(starts, ends): least unique length from place i on, and up to (not including) place i.

    Both have one entry more than there are tokens: ``starts[n]`` and ``ends[0]`` are 1, of which
    no token is left.
    """
    one = F.array(F.lit(1))
    starts = F.concat(least_unique_from(as_col(tokens)), one)
    ends = F.concat(one, F.reverse(least_unique_from(F.reverse(as_col(tokens)))))
    return starts, ends
