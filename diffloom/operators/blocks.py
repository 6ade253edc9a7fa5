"""Edit scripts by longest matching blocks, the cuts published diffs have.

The longest block of equal tokens (first in the old side, then in the new) splits both sides;
what is left of it and what is right of it are split again.  Tokens that fill more than one
hundredth of a new side of 200 or more do not start a block, they only extend one.

A pair with up to ``pairs.EQUAL`` equal tokens (one of each side) is resolved in its row, in numpy
over Arrow batches.  Pairs with more are Spark jobs: equal tokens of a pair are joined, diagonals
are folded into runs by gaps-and-islands, and all open intervals of all pairs are resolved
together, several rounds a job, every job's intervals a written table.  Runs stay narrow rows; no
such pair is handled in one Python call and none is too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import let
from ..functions.text import lines
from ..session import materialize
from .pairs import EDITS, POPULAR_FROM, POPULAR_SHARE, edits_by_blocks
from .scripts import common_prefix, hunks_of, script_of, span

#: Rounds of splitting in one job.
ROUNDS = 4
PAIR = ["_p", "_q"]


def _pairs_by_content(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with 128 bits of the pair's content; the length tells where one side ends."""
    return df.withColumns({"_p": F.xxhash64(F.size(a), a, b), "_q": F.xxhash64(F.lit(7), b, F.size(b), a)})


def matching_runs(sides: DataFrame) -> DataFrame:
    """(pair, i, j, n, fi, fn): runs of equal tokens that may start a block, and the equal tokens around them.

    ``fi`` and ``fn`` tell where the run begins and how long it is with popular tokens.
    """
    old = sides.select(*PAIR, F.posexplode("a").alias("i", "t"))
    new = sides.select(*PAIR, F.size("b").alias("m"), F.posexplode("b").alias("j", "t"))
    often = F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "t"))
    limit = F.floor(F.col("m") / POPULAR_SHARE) + 1
    new = new.withColumn("popular", (F.col("m") >= POPULAR_FROM) & (often > limit))
    kept = new.where(~F.col("popular")).select(*PAIR, "t", "j")
    equal = old.join(kept, [*PAIR, "t"]).select(*PAIR, "i", (F.col("j") - F.col("i")).alias("d"))
    diagonal = Window.partitionBy(*PAIR, "d").orderBy("i")
    runs = (equal.withColumn("g", F.col("i") - F.row_number().over(diagonal)).groupBy(*PAIR, "d", "g")
            .agg(F.min("i").alias("i"), F.count(F.lit(1)).cast("int").alias("n"))
            .select(*PAIR, "i", (F.col("i") + F.col("d")).alias("j"), "n"))
    # Only sides with popular tokens have more equal tokens on a diagonal than the run itself.
    long_sides = sides.where(F.size("b") >= POPULAR_FROM)
    wide = runs.join(long_sides, PAIR, "left")

    def reach(at, other, room):
        """How far the sides agree from places ``at`` and ``other`` on; ``room`` tokens at most."""
        def look(k):
            return common_prefix(F.slice(F.col("a"), at + 1, k), F.slice(F.col("b"), other + 1, k))

        near = F.least(room, F.lit(32))
        return let(lambda found: F.when((found == near) & (near < room), look(room)).otherwise(found), look(near))

    def back(at, other):
        def look(k):
            return common_prefix(F.reverse(F.slice(F.col("a"), at - k + 1, k)), F.reverse(F.slice(F.col("b"), other - k + 1, k)))

        room = F.least(at, other)
        near = F.least(room, F.lit(32))
        return let(lambda found: F.when((found == near) & (near < room), look(room)).otherwise(found), look(near))

    end, other = F.col("i") + F.col("n"), F.col("j") + F.col("n")
    before = F.when(F.col("a").isNotNull(), back(F.col("i"), F.col("j"))).otherwise(0)
    after = F.when(F.col("a").isNotNull(), reach(end, other, F.least(F.size("a") - end, F.size("b") - other))).otherwise(0)
    return wide.select(*PAIR, "i", "j", "n", (F.col("i") - before).alias("fi"), (F.col("n") + before + after).alias("fn"))


def _split(state: DataFrame) -> DataFrame:
    """One round: every interval yields its longest block and its runs move left or right of it."""
    best = F.max(F.struct("n", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "fi", "fn")).over(
        Window.partitionBy(*PAIR, "found", "alo", "blo"))
    # The block is the run with the equal tokens around it, inside the interval.
    shift = best["i"] - best["j"]
    start = F.greatest(best["fi"], F.col("alo"), F.col("blo") - shift)
    end = F.least(best["fi"] + best["fn"], F.col("ahi"), F.col("bhi") - shift)
    state = state.withColumns({"best": best}).select(
        *state.columns, start.alias("x"), (start + shift).alias("y"), (end - start).alias("z"),
        ((F.col("i") == -best["i"]) & (F.col("j") == -best["j"])).alias("first"))
    fields = ["found", "alo", "ahi", "blo", "bhi", "i", "j", "n", "fi", "fn"]

    def row(found, alo, ahi, blo, bhi, i, j, n):
        values = [F.lit(found), alo, ahi, blo, bhi, i, j, n, F.col("fi"), F.col("fn")]
        return F.struct(*[v.cast("boolean" if k == "found" else "int").alias(k) for k, v in zip(fields, values)])

    def clip(alo, ahi, blo, bhi):
        d = F.col("j") - F.col("i")
        lo = F.greatest(F.col("i"), alo, blo - d)
        return row(False, alo, ahi, blo, bhi, lo, lo + d, F.least(F.col("i") + F.col("n"), ahi, bhi - d) - lo)

    alo, ahi, blo, bhi, x, y, z = (F.col(c) for c in ("alo", "ahi", "blo", "bhi", "x", "y", "z"))
    moved = F.array(clip(alo, x, blo, y), clip(x + z, ahi, y + z, bhi),
                    row(True, alo, ahi, blo, bhi, x, y, F.when(F.col("first"), z).otherwise(0)))
    own = F.array(F.struct(*[F.col(k).cast("boolean" if k == "found" else "int").alias(k) for k in fields]))
    return state.select(*PAIR, F.inline(F.when(F.col("found"), own).otherwise(F.filter(moved, lambda r: r["n"] > 0))))


def split_blocks(sides: DataFrame) -> DataFrame:
    """(pair, i, j, n): the matching blocks of sides (pair, a, b), all open intervals in one job."""
    whole = sides.select(*PAIR, F.size("a").alias("ahi"), F.size("b").alias("bhi"))
    state = matching_runs(sides).join(whole, PAIR).select(
        *PAIR, F.lit(False).alias("found"), F.lit(0).alias("alo"), "ahi", F.lit(0).alias("blo"), "bhi", "i", "j", "n", "fi", "fn")
    done = None
    while True:
        state = state.repartition(*PAIR)
        for _ in range(ROUNDS):
            state = _split(state)
        state = materialize(state, "intervals")
        found = state.where("found").select(*PAIR, "i", "j", "n")
        done = found if done is None else done.union(found)
        state = state.where("NOT found")
        if state.isEmpty():
            return done


def _split_edits(sides: DataFrame) -> DataFrame:
    """(pair, edits) of sides (pair, a, b) by ``split_blocks``."""
    blocks = split_blocks(sides).groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("i", "j", "n"))).alias("blocks"))

    def gaps(a, b, blocks):
        def gap(k):
            last, here = F.get(blocks, k - 1), F.get(blocks, k)
            i1, j1 = F.coalesce(last["i"] + last["n"], F.lit(0)), F.coalesce(last["j"] + last["n"], F.lit(0))
            i2, j2 = F.coalesce(here["i"], F.size(a)), F.coalesce(here["j"], F.size(b))

            # Popular tokens that open a gap on both sides belong to the block before it.
            def cut(p, i1, i2, j1, j2):
                return F.struct((i1 + p).alias("i1"), i2.alias("i2"), (j1 + p).alias("j1"), j2.alias("j2"))

            return let(lambda i1, i2, j1, j2: let(lambda p: cut(p, i1, i2, j1, j2), common_prefix(span(a, i1, i2), span(b, j1, j2))),
                       i1, i2, j1, j2)

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(blocks)), gap), lambda e: (e["i1"] < e["i2"]) | (e["j1"] < e["j2"]))

    none = F.array().cast("array<struct<i:int,j:int,n:int>>")
    return sides.join(blocks, PAIR, "left").select(*PAIR, let(gaps, "a", "b", F.coalesce("blocks", none)).cast(EDITS).alias("edits"))


def matching_blocks(sides: DataFrame) -> DataFrame:
    """(pair, edits): what differs between the matching blocks of sides (pair, a, b), in order; null if a side is null."""
    made = sides.withColumn("edits", edits_by_blocks("a", "b"))
    # Tokens are written only of the pairs that are left.
    left = F.col("edits").isNull() & F.col("a").isNotNull() & F.col("b").isNotNull()
    made = materialize(made.select(*PAIR, "edits", left.alias("left"), *[F.when(left, F.col(c)).alias(c) for c in ("a", "b")]), "edits")
    done, rest = made.where("NOT left").select(*PAIR, "edits"), made.where("left").select(*PAIR, "a", "b")
    return done if rest.isEmpty() else done.unionByName(_split_edits(rest))


def block_edits(df: DataFrame, a: str, b: str, out: str = "edits") -> DataFrame:
    """Add ``out``: array<struct(i1, i2, j1, j2)>, what differs between the matching blocks, in order.

    Equal pairs of sides are computed once.  Null if a side is null.
    """
    keyed = _pairs_by_content(df, a, b).withColumn("_both", F.col(a).isNotNull() & F.col(b).isNotNull())
    # Missing sides stay in: a condition on them would be pushed below what computes the tokens.
    sides = keyed.select(*PAIR, F.col(a).alias("a"), F.col(b).alias("b")).dropDuplicates(PAIR)
    edits = matching_blocks(sides).withColumnRenamed("edits", out)
    # One row a content: rows that share one find it by a join whose hot keys Spark splits.
    joined = keyed.join(edits, PAIR, "left")
    return joined.withColumn(out, F.when(F.col("_both"), F.col(out))).drop(*PAIR, "_both")


def with_block_script(df: DataFrame, a: str, b: str, out: str = "ops") -> DataFrame:
    """Add the longest-matching-block edit script of array columns ``a`` and ``b``."""
    # Sizes are taken before rows meet their edits, so sides that are not asked for are not shuffled.
    sized = df.withColumns({"_n": F.size(a), "_m": F.size(b)})
    return block_edits(sized, a, b, out).withColumn(out, script_of(F.col(out), F.col("_n"), F.col("_m"))).drop("_n", "_m")


def block_hunks(pairs: DataFrame, old: str = "old_contents", new: str = "new_contents", context: int = 3) -> DataFrame:
    """Add ``hunks`` as published diffs cut them: the block script over lines, headers left out."""
    made = block_edits(pairs.withColumns({"_old": lines(old), "_new": lines(new)}), "_old", "_new", "hunks")
    return made.withColumn("hunks", hunks_of(F.col("_old"), F.col("_new"), F.col("hunks"), context)).drop("_old", "_new")
