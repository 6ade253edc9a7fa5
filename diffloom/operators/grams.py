"""N-gram multisets: per-row statistics as expressions, corpus-wide counts as tables.

What a score needs of one row (overlaps of its own sides) is folded inside the row:
no explode, no shuffle.  Only counts that span rows are exploded and grouped.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions import as_col, let
from ..functions.draws import numbers
from ..layout import by_key, by_repeats
from . import runs
from .suffixes import _lists, _runs

MAX_ORDER = 4
SEP = "\u001f"


def gram_counts(df: DataFrame, keys: list[str], sides: dict[str, Column | str],
                max_order: int = MAX_ORDER, nested: bool = False) -> DataFrame:
    """Rows (keys, n, gram, <side>...) with the count of each n-gram on each side.

    Sides may be expressions over raw text (``words("pred")``): they are evaluated after
    the rows are laid out by key, so only the text is shuffled.  The n-grams of a row are
    counted over its Arrow batch; only rows that share their keys are grouped after that.

    Order 0 carries one row per key with the token counts of the sides, so rows
    without any n-gram stay in the result.

    ``nested`` tells which n-grams a row has, with a row a place instead of one an order: rows
    (keys, n, least, gram, part, <side>) of the one side stand for the first ``least`` to n tokens of
    ``gram`` (see ``runs``); the count is that of the places with this longest run.
    """
    names = list(sides)

    def staged_rows(rows):
        return rows.select(*keys, *[F.coalesce(as_col(c), F.array().cast("array<string>")).alias(f"_s{i}")
                                      for i, c in enumerate(sides.values())])

    def counted(rows):
        staged = staged_rows(rows)
        schema = StructType([*staged.schema[:len(keys)], StructField("n", IntegerType()), StructField("gram", StringType()),
                             *[StructField(name, LongType()) for name in names]])
        return staged.mapInArrow(_row_grams(len(keys), names, max_order), schema)

    once, again = by_repeats(by_key(df, *keys), *keys)
    grouped = counted(again).groupBy(*keys, "n", "gram").agg(*[F.sum(c).alias(c) for c in names])
    if not nested:
        return counted(once).unionByName(grouped)
    if len(names) != 1:
        raise ValueError("nested n-grams are of one side")
    staged = staged_rows(once)
    schema = StructType([*staged.schema[:len(keys)], *runs.FIELDS, StructField(names[0], LongType())])
    return (staged.mapInArrow(runs.row_runs(len(keys), names[0], max_order), schema)
            .unionByName(runs.as_runs(grouped, keys, names[0])))


def _row_grams(n_keys: int, names: list[str], max_order: int):
    """Batches (keys, sides) to batches (keys, n, gram, counts), one row per key row and gram."""
    def grams(batches):
        for batch in batches:
            sides = [_lists(c) for c in batch.columns[n_keys:]]
            for start, stop in _runs(sum(o for _, o in sides)):
                own = batch.slice(start, stop - start).select(range(n_keys))
                sizes = [np.diff(o[start:stop + 1]) for _, o in sides]
                tokens = [v.slice(o[start], o[stop] - o[start]) for v, o in sides]
                yield table(own, 0, np.arange(stop - start), pa.array([""] * (stop - start), pa.string()), sizes)
                for n in range(1, max_order + 1):
                    found = [texts_of(t, size, n) for t, size in zip(tokens, sizes)]
                    rows, side = np.concatenate([r for r, _ in found]), np.repeat(np.arange(len(found)), [len(r) for r, _ in found])
                    coded = pa.concat_arrays([g for _, g in found]).dictionary_encode()
                    code = np.asarray(coded.indices.to_numpy(zero_copy_only=False), np.int64)
                    pairs, at = np.unique((rows << 32) | code, return_inverse=True)
                    yield table(own, n, pairs >> 32, coded.dictionary.take(pa.array(pairs & 0xffffffff)),
                                [np.bincount(at[side == s], minlength=len(pairs)) for s in range(len(found))])

    def texts_of(tokens, sizes, n):
        """Rows and texts of the runs of ``n`` tokens; null tokens are skipped in a text."""
        many = np.maximum(sizes - (n - 1), 0)
        rows = np.repeat(np.arange(len(sizes)), many)
        at = np.arange(len(rows)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(many) - many), many)
        return rows, pc.binary_join_element_wise(*[tokens.take(pa.array(at + k)) for k in range(n)], SEP, null_handling="skip")

    def table(own, n, rows, texts, counts):
        return pa.RecordBatch.from_arrays(
            [*[c.take(pa.array(rows)) for c in own.columns], pa.array(np.full(len(rows), n, np.int32)), texts.cast(pa.string()),
             *[pa.array(c.astype(np.int64)) for c in counts]], [*own.schema.names, "n", "gram", *names])

    return grams


class Bag(NamedTuple):
    """The n-grams of one order of one side, as 64-bit hashes in text order, and the
    sorted copies left after the first of each is taken away; both bound."""

    grams: Column
    again: Column


def bind_orders(body, orders: int, *sides: Column) -> Column:
    """``body`` applied to one list of bags per side, order 1 first.

    Each order extends the hashes of the one before by a token, so no string is built.
    Every bag is made once per side.  Only n-grams of one row meet, so a collision needs
    two of its n-grams to share 64 bits (for 10,000 n-grams about 1 in 10**11 rows).
    """
    names = [(f"g{n}", f"a{n}") for n in range(1, orders + 1)]

    def extend(grams):
        n = len(grams) + 1
        if n > orders:
            return F.struct(*[col.alias(name) for g, pair in zip(grams, names)
                              for col, name in zip((g, repeats(g)), pair)])
        size = F.greatest(F.size(grams[0]) - (n - 1), F.lit(0))
        grown = F.zip_with(F.slice(grams[-1], F.lit(1), size), F.slice(grams[0], F.lit(n), size),
                           lambda g, x: F.xxhash64(g, x))
        return let(lambda g: extend([*grams, g]), grown)

    # One bound struct per side: lambdas nested per bag would make the plan slow to analyse.
    made = [let(lambda g: extend([g]), F.transform(side, lambda t: F.xxhash64(t))) for side in sides]
    return let(lambda *bound: body(*[[Bag(v[g], v[again]) for g, again in names] for v in bound]), *made)


def repeats(items: Column) -> Column:
    """The (bound) items sorted, one copy of each taken away; most n-grams do not repeat."""
    again = let(lambda s: F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))), F.sort_array(items))
    return F.when(F.size(F.array_distinct(items)) == F.size(items),
                  F.array().cast("array<bigint>")).otherwise(again)


def run_starts(ordered: Column) -> Column:
    marks = F.transform(ordered, lambda x, i: F.when(
        (i == 0) | (x != F.get(ordered, i - 1)), i))
    return F.filter(marks, lambda i: i.isNotNull())


def numbered(ordered: Column) -> Column:
    """A sorted (bound) multiset as a set of hashes: equal elements get running numbers."""
    def runs(starts):
        def run(at, r):
            count = F.coalesce(F.get(starts, r + 1), F.size(ordered)) - at
            return F.transform(F.sequence(F.lit(1), count), lambda k: F.xxhash64(F.get(ordered, at), k))

        return F.flatten(F.transform(starts, run))

    return F.when(F.size(ordered) == 0, F.array().cast("array<bigint>")).otherwise(
        let(runs, run_starts(ordered)))


def shared_repeats(p: Column, q: Column) -> Column:
    """Size of the multiset intersection of two sorted (bound) arrays."""
    return F.when((F.size(p) == 0) | (F.size(q) == 0), 0).otherwise(
        F.size(F.array_intersect(numbered(p), numbered(q))))


def shared(a: Bag, b: Bag) -> Column:
    """Size of the multiset intersection of two bags.

    First as sets, which is a hash intersection; then the repeats, numbered so that
    they form sets too.
    """
    return F.size(F.array_intersect(a.grams, b.grams)) + shared_repeats(a.again, b.again)


def shared_items(a: Column, b: Column) -> Column:
    """As ``shared`` for two bound arrays of hashes."""
    return let(lambda x, y: shared(Bag(a, x), Bag(b, y)), repeats(a), repeats(b))


def shared_without(a: Bag, b: Bag, c: Bag) -> Column:
    """As ``shared(a, b)``, but n-grams that occur in ``c`` do not count."""
    def deeper(new):
        def among(again):
            return F.filter(again, lambda v: F.array_contains(new, v))

        more = F.when((F.size(a.again) == 0) | (F.size(b.again) == 0), 0).otherwise(
            let(shared_repeats, among(a.again), among(b.again)))
        return F.when(F.size(new) == 0, 0).otherwise(F.size(new) + more)

    return let(deeper, F.array_except(F.array_intersect(a.grams, b.grams), c.grams))


def as_set(bag: Bag) -> Column:
    """The bag as a set: each n-gram once in text order, then its repeats, numbered."""
    return F.concat(F.array_distinct(bag.grams), numbered(bag.again))


def place_bits(items: Column, found: Column) -> Column:
    """Words of 64 bits: which places of the (bound) set ``items`` its (bound) subset
    ``found``, in the same order, takes."""
    def word(acc, w):
        def bit(s, j):
            taken = F.get(items, w * 64 + j) == F.get(found, s["next"])
            return F.when(taken, F.struct((s["next"] + 1).alias("next"), s["bits"].bitwiseOR(
                F.call_function("shiftleft", F.lit(1).cast("long"), j)).alias("bits"))).otherwise(s)

        places = F.sequence(F.lit(0), F.least(F.lit(63), F.size(items) - 1 - w * 64))
        done = F.aggregate(places, F.struct(acc["next"].alias("next"), F.lit(0).cast("long").alias("bits")), bit)
        return let(lambda s: F.struct(s["next"].alias("next"), F.concat(acc["words"], F.array(s["bits"])).alias(
            "words")), done)

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<bigint>").alias("words"))
    count = F.ceil(F.size(items) / 64).cast("int")
    return F.when(F.size(found) == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(
        F.transform(numbers(count), lambda i: i - 1), start, word, lambda acc: acc["words"]))


def gram_total(tokens: Column, n: int) -> Column:
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0))


def document_frequency(counts: DataFrame, side: str) -> DataFrame:
    """In how many rows an n-gram of ``side`` occurs; ``counts`` may be nested, which moves far less."""
    some = counts.where((F.col("n") > 0) & (F.col(side) > 0))
    if "least" in counts.columns:
        return runs.frequencies(some)
    return (some.groupBy("n", "gram").agg(F.count("*").alias("df")))
