"""Overlaps of the sides of one row, counted in numpy over Arrow batches.

Sides arrive as 64-bit hashes of their items, made in the JVM.  A batch is taken in runs of
rows of about ``TOKENS`` items, a longer row alone.  All n-grams of a run get dense codes:
an order extends the codes of the one before by an item, one sort an order, so nothing beyond
the items' hashes can collide, and items of other rows never meet.  Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import as_col
from .suffixes import _dense, _ends, _lists, _runs

Side = tuple[np.ndarray, np.ndarray]


def item_hashes(items: Column | str, marked: list[str] | None = None) -> Column:
    """The items as 64-bit hashes, none for a null array; with ``marked``, the lowest bit tells which are among them."""
    def hashed(t):
        if marked is None:
            return F.xxhash64(t)
        return F.xxhash64(t).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(t.isin(*marked), 1).otherwise(0).cast("long"))

    return F.transform(F.coalesce(as_col(items), F.array().cast("array<string>")), hashed)


def _rows_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _sides(columns: tuple[pa.Array, ...]) -> Iterator[list[Side]]:
    """The sides of one run of rows after the other."""
    whole = [(np.asarray(v.to_numpy(zero_copy_only=False), np.int64), o) for v, o in map(_lists, columns)]
    for start, stop in _runs(reduce(np.add, [o for _, o in whole])):
        yield [(v[o[start]:o[stop]], o[start:stop + 1] - o[start]) for v, o in whole]


class Grams:
    """The n-grams of one order of all sides of a run: places, sides and codes of the occurrences."""

    def __init__(self, at, side, codes, rows, n_rows, n_sides):
        self.at, self.side, self.codes, self.n_rows = at, side, codes, n_rows
        size = int(codes.max(initial=-1)) + 1
        self.row = np.zeros(size, np.int64)
        self.row[codes] = rows
        self.counts = [np.bincount(codes[side == s], minlength=size) for s in range(n_sides)]

    def per_row(self, counts: np.ndarray) -> np.ndarray:
        """Sums of a number a gram over the grams of each row."""
        return np.bincount(self.row, weights=counts, minlength=self.n_rows).astype(np.int64)


def grams_of(sides: list[Side], orders: int) -> Iterator[Grams]:
    """The n-grams of orders 1, 2, ... of the sides of a run; equal grams of a row have one code on all sides."""
    starts = np.concatenate([[0], np.cumsum([len(v) for v, _ in sides])])
    rows = np.concatenate([_rows_of(o) for _, o in sides])
    ends = np.concatenate([_ends(o) + start for (_, o), start in zip(sides, starts)])
    side = np.repeat(np.arange(len(sides)), np.diff(starts))
    items = np.unique(np.concatenate([v for v, _ in sides]), return_inverse=True)[1]
    at, first = np.arange(len(items)), _dense(rows, items)
    codes = first
    for n in range(1, orders + 1):
        if n > 1:
            inside = at + n - 1 < ends[at]
            at = at[inside]
            codes = _dense(codes[inside], first[at + n - 1])
        yield Grams(at, side[at], codes, rows[at], len(sides[0][1]) - 1, len(sides))


def _table(parts: list[list[np.ndarray]], fields: list[str], kind: pa.DataType) -> pa.Array:
    columns = zip(*parts) if parts else [[] for _ in fields]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([np.zeros(0, np.int64), *c]), kind) for c in columns], fields)


def _counted(names: list[str], count):
    """An expression over hashed sides: a struct of int columns that ``count`` gives per run of rows."""
    @F.arrow_udf(StructType([StructField(name, IntegerType()) for name in names]))
    def counts(a: pa.Array, b: pa.Array) -> pa.Array:
        return _table([count(sides) for sides in _sides((a, b))], names, pa.int32())

    return counts


def pair_matches(hyp: Column, ref: Column, orders: int, marked: bool) -> Column:
    """struct(hyp_len, ref_len, m1, ...): lengths and clipped matches per order; with ``marked``
    also ``mk`` and ``rk``, matches and reference items among those whose lowest bit is set."""
    def count(sides):
        out = [np.diff(o) for _, o in sides]
        for n, grams in enumerate(grams_of(sides, orders), 1):
            both = np.minimum(*grams.counts)
            out.append(grams.per_row(both))
            if n == 1 and marked:
                odd = np.zeros(len(grams.row), np.int64)
                odd[grams.codes] = np.concatenate([v for v, _ in sides])[grams.at] & 1
                extra = [grams.per_row(both * odd), grams.per_row(grams.counts[1] * odd)]
        return out + extra if marked else out

    names = ["hyp_len", "ref_len", *[f"m{n}" for n in range(1, orders + 1)], *(["mk", "rk"] if marked else [])]
    return _counted(names, count)(hyp, ref)


def net_matches(src: Column, hyp: Column, ref: Column, orders: int) -> Column:
    """struct(hyp_len, ref_len, g1, ...): matches with the reference less matches with source
    n-grams the reference does not have, not below 0."""
    names = ["hyp_len", "ref_len", *[f"g{n}" for n in range(1, orders + 1)]]

    @F.arrow_udf(StructType([StructField(name, IntegerType()) for name in names]))
    def counts(s: pa.Array, h: pa.Array, r: pa.Array) -> pa.Array:
        parts = []
        for sides in _sides((s, h, r)):
            out = [np.diff(o) for _, o in sides[1:]]
            for grams in grams_of(sides, orders):
                cs, ch, cr = grams.counts
                out.append(np.maximum(grams.per_row(np.minimum(ch, cr) - np.where(cr == 0, np.minimum(ch, cs), 0)), 0))
            parts.append(out)
        return _table(parts, names, pa.int32())

    return counts(src, hyp, ref)


def _occurrence(codes: np.ndarray) -> np.ndarray:
    """How often a code came before, for each place."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(codes) else np.zeros(0, np.int64)
    out = np.zeros(len(codes), np.int64)
    out[order] = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    return out


def matched_places(hyp: Column, ref: Column, orders: int) -> Column:
    """struct(len, p1, ...): the reference's length and, per order, bitmaps in words of 64 of the
    hypothesis' places whose n-gram the reference has at least as often as it came up to there."""
    names = [f"p{n}" for n in range(1, orders + 1)]
    kind = StructType([StructField("len", LongType()), *[StructField(name, ArrayType(LongType())) for name in names]])

    @F.arrow_udf(kind)
    def places(h: pa.Array, r: pa.Array) -> pa.Array:
        lengths, bits, sizes = [], [[] for _ in names], [[] for _ in names]
        for sides in _sides((h, r)):
            begins = sides[0][1]
            lengths.append(np.diff(sides[1][1]))
            for n, grams in enumerate(grams_of(sides, orders)):
                own = grams.side == 0
                codes, at = grams.codes[own], grams.at[own]
                hit = _occurrence(codes) < grams.counts[1][codes]
                words = (np.maximum(np.diff(begins) - n, 0) + 63) // 64
                starts = np.concatenate([[0], np.cumsum(words)])
                rows = grams.row[codes]
                flags = np.zeros(int(starts[-1]) * 64, np.uint8)
                flags[starts[rows] * 64 + at - begins[rows]] = hit
                bits[n].append(np.packbits(flags, bitorder="little").view("<i8"))
                sizes[n].append(words)
        none = np.zeros(0, np.int64)
        lists = [pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], *map(np.cumsum, [np.concatenate([none, *s])])]).astype(np.int32)),
            pa.array(np.concatenate([none, *b]), pa.int64())) for b, s in zip(bits, sizes)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([none, *lengths]), pa.int64()), *lists], ["len", *names])

    return places(hyp, ref)


def contained(items: Column, among: Column) -> Column:
    """How many of the hashed ``items``, repeats counted, occur in ``among``."""
    def count(sides):
        grams = next(grams_of(sides, 1))
        return [grams.per_row(np.where(grams.counts[1] > 0, grams.counts[0], 0))]

    return _counted(["n"], count)(items, among)["n"]


def _first_seen(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each item the number, from 1, of its code in order of first appearance within its row; codes tell rows apart."""
    first, back = np.unique(codes, return_index=True, return_inverse=True)[1:]
    order = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    # Rows come in order, so the codes of a row have ranks in a row.
    opens = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    least = rank[back][opens]
    return rank[back] - np.repeat(least, np.diff(np.append(np.flatnonzero(opens), len(rows)))) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.arrow_udf(ArrayType(LongType()))
def normalized_edges(rel: pa.Array, sizes: pa.Array, names: pa.Array) -> pa.Array:
    """A hash per edge, told by its relation and its names numbered by first appearance in the row.

    Per row and in reading order: the edges' relations, how many names each has, and all names.
    """
    edge_values, edges = _lists(rel)
    relation = np.asarray(edge_values.to_numpy(zero_copy_only=False), np.int64)
    width = np.asarray(_lists(sizes)[0].to_numpy(zero_copy_only=False), np.int64)
    parts = []
    name_values, cuts = _lists(names)
    tokens = np.asarray(name_values.to_numpy(zero_copy_only=False), np.int64)
    for start, stop in _runs(cuts):
        lo, hi = cuts[start], cuts[stop]
        rows = _rows_of(cuts[start:stop + 1] - lo)
        codes = _dense(rows, np.unique(tokens[lo:hi], return_inverse=True)[1])
        own = width[edges[start]:edges[stop]]
        begins = np.concatenate([[0], np.cumsum(own)[:-1]]).astype(np.int64)
        # The last name is the variable, told apart from its parents by the place 0.
        place = np.arange(hi - lo) - np.repeat(begins, own) + 1
        place[begins + own - 1] = 0
        mixed = _mixed(_first_seen(codes, rows).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _mixed(place.astype(np.uint64) + np.uint64(1)))
        whole = np.add.reduceat(mixed, begins) if len(own) else np.zeros(0, np.uint64)
        parts.append(_mixed(whole ^ relation[edges[start]:edges[stop]].astype(np.uint64)).astype(np.int64))
    flat = np.concatenate([np.zeros(0, np.int64), *parts])
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat, pa.int64()))
