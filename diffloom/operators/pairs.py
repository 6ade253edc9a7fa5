"""Edits between the two sides of a row, found in numpy over Arrow batches.

A batch is taken in runs of rows of about ``TOKENS`` tokens, a longer row alone.  Tokens are
compared whole, as the codes Arrow's dictionary gives them.  Nothing is shuffled, and tokens
of other rows never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .suffixes import _codes, _lists, _runs

FIELDS = ["i1", "i2", "j1", "j2"]
EDITS = ArrayType(StructType([StructField(f, IntegerType()) for f in FIELDS]))
#: New sides from this length on have popular tokens: more than 1 + length / POPULAR_SHARE of one token.
POPULAR_FROM, POPULAR_SHARE = 200, 100
#: Equal tokens (one of the old and one of the new side) held at once.
EQUAL = 1 << 21


class Sides(NamedTuple):
    """Codes of both sides of a run of rows, one gap before each row; ``ao`` and ``bo`` tell where rows start, ``n`` and ``m`` their sizes."""

    a: np.ndarray
    b: np.ndarray
    ao: np.ndarray
    bo: np.ndarray
    n: np.ndarray
    m: np.ndarray


def _ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and place in the group of each member of groups of these sizes."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spaced(codes: np.ndarray, sizes: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes with a gap before each row, and where rows start."""
    starts = np.cumsum(sizes) - sizes + np.arange(len(sizes)) + 1
    out = np.full(len(codes) + len(sizes) + 1, gap, np.int64)
    which, k = _ragged(sizes)
    out[starts[which] + k] = codes
    return out, starts


def _taken(sides: Sides, start: int, stop: int) -> Sides:
    """The rows from ``start`` to ``stop``."""
    def cut(codes, starts, sizes):
        lo = starts[start] - 1
        return codes[lo:starts[stop - 1] + sizes[stop - 1] + 1], starts[start:stop] - lo, sizes[start:stop]

    (a, ao, n), (b, bo, m) = cut(sides.a, sides.ao, sides.n), cut(sides.b, sides.bo, sides.m)
    return Sides(a, b, ao, bo, n, m)


def _sides(old: pa.Array, new: pa.Array) -> Iterator[Sides]:
    """The sides of one run of rows after the other; a null token has code -3."""
    (x, xo), (y, yo) = _lists(old), _lists(new)
    both = pa.concat_arrays([x, y.cast(x.type)])
    codes = _codes(both)
    if both.null_count:
        codes = np.where(np.asarray(both.is_null()), -3, codes)
    a, b = codes[:len(x)], codes[len(x):]
    for start, stop in _runs(xo + yo):
        n, m = np.diff(xo[start:stop + 1]), np.diff(yo[start:stop + 1])
        (p, po), (q, qo) = _spaced(a[xo[start]:xo[stop]], n, -1), _spaced(b[yo[start]:yo[stop]], m, -2)
        yield Sides(p, q, po, qo, n, m)


def _agree(sides: Sides, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many tokens from places ``i`` and ``j`` on agree, ``room`` at most; ``step`` -1 goes back.

    Looks at twice as many with each pass, so the work is in proportion to what agrees.
    """
    done, alive, width = np.zeros(len(i), np.int64), np.flatnonzero(room > 0), 4
    while len(alive):
        take = np.minimum(room[alive] - done[alive], width)
        which, k = _ragged(take)
        to = step * (done[alive][which] + k)
        miss = np.flatnonzero(sides.a[i[alive][which] + to] != sides.b[j[alive][which] + to])[::-1]
        same = take.copy()
        same[which[miss]] = k[miss]  # the first miss is written last
        done[alive] += same
        alive = alive[(same == take) & (done[alive] < room[alive])]
        width *= 2
    return done


def _by_row(sides: Sides) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of tokens told apart by row, 0-based, on both sides, and their number; gaps and null tokens have the last one."""
    rows = [np.repeat(np.arange(len(n)), n) for n in (sides.n, sides.m)]
    at = [np.flatnonzero((x != gap)) for x, gap in ((sides.a, -1), (sides.b, -2))]
    codes = np.concatenate([sides.a[at[0]], sides.b[at[1]]])
    values, group = np.unique((np.concatenate(rows) << 32) | (codes & 0xffffffff), return_inverse=True)
    size = len(values)
    group = np.where(codes < 0, size, group)
    out = [np.full(len(x), size, np.int64) for x in (sides.a, sides.b)]
    out[0][at[0]], out[1][at[1]] = group[:len(at[0])], group[len(at[0]):]
    return out[0], out[1], size


def _gaps(sides: Sides, row: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, i1, i2, j1, j2) between kept parts that are in order; row starts and ends count as such."""
    rows = np.arange(len(sides.n))
    first = np.argsort(np.concatenate([rows, row]), kind="stable")
    last = np.argsort(np.concatenate([row, rows]), kind="stable")
    i1, i2 = np.concatenate([sides.ao, i + n])[first], np.concatenate([i, sides.ao + sides.n])[last]
    j1, j2 = np.concatenate([sides.bo, j + n])[first], np.concatenate([j, sides.bo + sides.m])[last]
    return np.concatenate([rows, row])[first], i1, i2, j1, j2


def anchored(sides: Sides) -> tuple[np.ndarray, ...]:
    """(row, i1, i2, j1, j2): what differs between anchors, in order."""
    a, b, size = _by_row(sides)
    single = (np.bincount(a, minlength=size + 1) == 1) & (np.bincount(b, minlength=size + 1) == 1)
    single[size] = False
    at = np.zeros(size + 1, np.int64)
    at[b] = np.arange(len(b))
    i = np.flatnonzero(single[a])
    j = at[a[i]]
    # Later rows have later places on both sides, so running values need no row.
    keep = (np.maximum.accumulate(j) == j) & (np.minimum.accumulate(j[::-1])[::-1] == j)
    i, j = i[keep], j[keep]
    row = np.searchsorted(sides.ao, i, "right") - 1
    row, i1, i2, j1, j2 = _gaps(sides, row, i, j, np.ones(len(i), np.int64))
    room = np.minimum(i2 - i1, j2 - j1)
    p = _agree(sides, i1, j1, room, 1)
    s = _agree(sides, i2 - 1, j2 - 1, room - p, -1)
    return row, i1 + p, i2 - s, j1 + p, j2 - s


def _equal(sides: Sides) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the old side by row, places of the new side by code, and how many of them may start a block."""
    a, b, size = _by_row(sides)
    many = np.bincount(b, minlength=size + 1)
    limit = np.where(sides.m >= POPULAR_FROM, sides.m // POPULAR_SHARE + 1, np.iinfo(np.int64).max)
    most = np.full(size + 1, np.iinfo(np.int64).max)
    most[b] = limit[np.maximum(np.searchsorted(sides.bo, np.arange(len(b)), "right") - 1, 0)] if len(limit) else 0
    kept = np.where(many > most, 0, many)
    kept[size] = 0
    return a, b, kept


def matched(sides: Sides, a: np.ndarray, b: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, i1, i2, j1, j2): what differs between the longest matching blocks, in order.

    All open intervals of all rows are split together, each at its longest run of equal tokens.
    """
    order = np.argsort(b, kind="stable")
    start = np.cumsum(np.bincount(b, minlength=len(kept))) - np.bincount(b, minlength=len(kept))
    which, k = _ragged(kept[a])
    i, j = which, order[start[a[which]] + k]
    diagonal = np.argsort(j - i, kind="stable")
    i, j = i[diagonal], j[diagonal]
    new = np.ones(len(i), bool)
    # A gap between rows keeps runs apart.
    new[1:] = (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
    heads = np.flatnonzero(new)
    i, j, n = i[heads], j[heads], np.diff(np.append(heads, len(i)))
    interval = np.searchsorted(sides.ao, i, "right") - 1
    alo, ahi, blo, bhi = sides.ao, sides.ao + sides.n, sides.bo, sides.bo + sides.m
    found = [(np.zeros(0, np.int64),) * 3]
    big = np.iinfo(np.int64).max
    while len(i):
        order = np.argsort(interval, kind="stable")
        i, j, n, interval = i[order], j[order], n[order], interval[order]
        heads = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
        own, interval = interval[heads], np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(i))))
        alo, ahi, blo, bhi = alo[own], ahi[own], blo[own], bhi[own]
        # The longest, then the first in the old and in the new side.
        z = np.maximum.reduceat(n, heads)
        x = np.minimum.reduceat(np.where(n == z[interval], i, big), heads)
        y = np.minimum.reduceat(np.where((n == z[interval]) & (i == x[interval]), j, big), heads)
        back = _agree(sides, x - 1, y - 1, np.minimum(x - alo, y - blo), -1)
        z = z + back + _agree(sides, x + z, y + z, np.minimum(ahi - x - z, bhi - y - z), 1)
        x, y = x - back, y - back
        found.append((x, y, z))
        alo, ahi = np.stack([alo, x + z], 1).ravel(), np.stack([x, ahi], 1).ravel()
        blo, bhi = np.stack([blo, y + z], 1).ravel(), np.stack([y, bhi], 1).ravel()
        parts = []
        for side in (0, 1):
            to = 2 * interval + side
            skip = np.maximum(np.maximum(alo[to] - i, blo[to] - j), 0)
            rest = np.minimum(np.minimum(ahi[to] - i, bhi[to] - j), n) - skip
            stay = rest > 0
            parts.append((i[stay] + skip[stay], j[stay] + skip[stay], rest[stay], to[stay]))
        i, j, n, interval = (np.concatenate(p) for p in zip(*parts))
    x, y, z = (np.concatenate(p) for p in zip(*found))
    order = np.argsort(x, kind="stable")
    x, y, z = x[order], y[order], z[order]
    row, i1, i2, j1, j2 = _gaps(sides, np.searchsorted(sides.ao, x, "right") - 1, x, y, z)
    # Popular tokens that open a gap on both sides belong to the block before it.
    p = _agree(sides, i1, j1, np.minimum(i2 - i1, j2 - j1), 1)
    return row, i1 + p, i2, j1 + p, j2


def _blocks(sides: Sides) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """Edits between matching blocks, and which rows are left out: those with more than ``EQUAL`` equal tokens."""
    a, b, kept = _equal(sides)
    total = np.add.reduceat(np.append(kept[a], 0), sides.ao - 1)
    before, start = np.cumsum(total) - total, 0
    while start < len(total):
        stop = max(start + 1, int(np.searchsorted(before + total, before[start] + EQUAL, "right")))
        part = _taken(sides, start, stop)
        if stop == start + 1 and total[start] > EQUAL:
            yield tuple(np.zeros(0, np.int64) for _ in range(5)), np.ones(1, bool)
        else:
            x, y = sides.ao[start] - 1, sides.bo[start] - 1
            yield matched(part, a[x:x + len(part.a)], b[y:y + len(part.b)], kept), np.zeros(stop - start, bool)
        start = stop


def _as_edits(parts: list[tuple[Sides, tuple[np.ndarray, ...]]], nulls: pa.Array) -> pa.Array:
    sizes, columns = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in FIELDS]
    for sides, (row, i1, i2, j1, j2) in parts:
        some = (i1 < i2) | (j1 < j2)
        row = row[some]
        sizes.append(np.bincount(row, minlength=len(sides.n)))
        for column, values, starts in zip(columns, (i1, i2, j1, j2), (sides.ao, sides.ao, sides.bo, sides.bo)):
            column.append(values[some] - starts[row])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(np.int32)) for c in columns], FIELDS)
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=nulls)


@F.arrow_udf(EDITS)
def edits_by_anchors(old: pa.Array, new: pa.Array) -> pa.Array:
    """The parts that differ between anchors (null if a side is null)."""
    return _as_edits([(s, anchored(s)) for s in _sides(old, new)], pc.or_(old.is_null(), new.is_null()))


@F.arrow_udf(EDITS)
def edits_by_blocks(old: pa.Array, new: pa.Array) -> pa.Array:
    """The parts that differ between matching blocks; null if a side is null or more than ``EQUAL`` tokens are equal."""
    parts, out = [], [np.zeros(0, bool)]
    for sides in _sides(old, new):
        start = 0
        for edits, left in _blocks(sides):
            parts.append((_taken(sides, start, start + len(left)), edits))
            out.append(left)
            start += len(left)
    nulls = pc.or_(old.is_null(), new.is_null())
    return _as_edits(parts, pc.or_(nulls, pa.array(np.concatenate(out))))
