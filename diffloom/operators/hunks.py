"""Line hunks, intermediate states and relational line deltas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import let
from ..functions.draws import numbers, pick
from ..functions.patch import side_lines, rebuild_single
from ..functions.text import lines
from ..layout import by_key
from .scripts import anchored_edits, hunks_of

TOKEN_BUDGET = 510
STATE_SAMPLE = 3


def extract_hunks(pairs: DataFrame, old: str = "old_contents", new: str = "new_contents",
                  context: int = 3) -> DataFrame:
    """Add ``hunks``: one string per hunk of the anchored line diff, headers left out.

    One row in, one row out, no shuffle; equal sides give an empty array.
    """
    a, b = lines(old), lines(new)
    return pairs.withColumn("hunks", hunks_of(a, b, anchored_edits(a, b), context))


def with_hunks_only(df: DataFrame) -> DataFrame:
    return df.where(F.size("hunks") > 0)


def changed_lines(pairs: DataFrame, old: str = "old_contents", new: str = "new_contents") -> DataFrame:
    """The pairs that have hunks, told by their lines before any diff is made.

    A condition on ``hunks`` itself would be pushed below the projection, which evaluates the
    diff twice.
    """
    return pairs.where(lines(old) != lines(new))


def state_ids(m: Column, k: int, seed: str, *key) -> Column:
    """States of an ``m``-hunk change: all when few, else 0 and ``k`` drawn ones."""
    return F.when(m <= k, F.transform(numbers(m), lambda i: i - 1)).otherwise(
        F.concat(F.array(F.lit(0)), pick(m - 1, k, seed, *key)))


def states_of(hunks, k: int, seed: str, *key, compat: bool = False) -> Column:
    """array<struct(state_idx, state_cnt, old, new)> of one group of hunks.

    In state ``t`` the first ``t`` hunks are already applied.  ``compat`` keeps the
    line break that published data carries between the two parts even when one is
    empty.
    """

    def text(news, olds, t):
        done, todo = F.slice(news, 1, t), F.slice(olds, t + 1, F.size(olds))
        if compat:
            return F.concat(F.array_join(F.flatten(done), "\n"), F.lit("\n"),
                            F.array_join(F.flatten(todo), "\n"))
        return F.array_join(F.flatten(F.concat(done, todo)), "\n")

    def build(ids, olds, news, target):
        return F.transform(ids, lambda t: F.struct(
            t.alias("state_idx"), F.size(ids).alias("state_cnt"),
            text(news, olds, t).alias("old"), target.alias("new")))

    def bound(hs):
        return let(lambda news: let(
            build, state_ids(F.size(hs), k, seed, *key),
            F.transform(hs, lambda h: side_lines(h, "-")), news,
            F.array_join(F.flatten(news), "\n")),
            F.transform(hs, lambda h: side_lines(h, "+")))

    return let(bound, hunks)


def budget_groups(hunks, measure: Callable[[Column], Column], budget: int = TOKEN_BUDGET) -> Column:
    """Groups of hunks that fit a token budget.

    The whole change if it fits; else without the hunks that are too long by
    themselves, as one group if those are below the budget, else in consecutive
    pairs (an odd last hunk has no partner and is left out).
    """
    none = F.array().cast("array<array<string>>")

    def pairs(kept):
        return F.transform(numbers(F.floor(F.size(kept) / 2)),
                           lambda i: F.slice(kept, i * 2 - 1, F.lit(2)))

    def rest(kept):
        return F.when(F.size(kept) == 0, none).when(
            measure(F.array_join(kept, "\n")) < budget, F.array(kept)).otherwise(pairs(kept))

    return let(lambda hs: F.when(
        (F.size(hs) == 1) | (measure(F.array_join(hs, "\n")) <= budget), F.array(hs)).otherwise(
        let(rest, F.filter(hs, lambda h: measure(h) <= budget))), hunks)


def budget_rejects(df: DataFrame, measure: Callable[[Column], Column], budget: int = TOKEN_BUDGET) -> DataFrame:
    """Rows of ``df`` (without ``hunks``) with (hunk_idx, reason): the hunks ``budget_groups`` leaves out.

    ``over budget``: too long by itself; ``odd tail``: the last of an odd number of short hunks
    that go in pairs.
    """
    rest = [c for c in df.columns if c != "hunks"]

    def left_out(hs):
        whole = (F.size(hs) == 1) | (measure(F.array_join(hs, "\n")) <= budget)
        sized = F.transform(hs, lambda h, i: F.struct(i.alias("hunk_idx"), h.alias("hunk"), (measure(h) <= budget).alias("fits")))

        def rejects(sized):
            over = F.transform(F.filter(sized, lambda h: ~h["fits"]), lambda h: F.struct(
                h["hunk_idx"].alias("hunk_idx"), F.lit("over budget").alias("reason")))

            def tail(kept):
                paired = measure(F.array_join(kept["hunk"], "\n")) >= budget
                return F.when((F.size(kept) % 2 == 1) & paired, F.array(F.struct(
                    F.element_at(kept, -1)["hunk_idx"].alias("hunk_idx"), F.lit("odd tail").alias("reason")))).otherwise(
                    F.array().cast("array<struct<hunk_idx:int,reason:string>>"))

            return F.concat(over, let(tail, F.filter(sized, lambda h: h["fits"])))

        return F.when(whole, F.array().cast("array<struct<hunk_idx:int,reason:string>>")).otherwise(let(rejects, sized))

    return df.select(*rest, F.inline(let(left_out, F.col("hunks"))))


def expand_states(df: DataFrame, measure: Callable[[Column], Column], seed: str = "states",
                  k: int = STATE_SAMPLE, budget: int = TOKEN_BUDGET,
                  compat: bool = False) -> DataFrame:
    """Rows (commit, repos, msg, group_idx, state_idx, state_cnt, old, new) from ``hunks``."""
    rest = [c for c in df.columns if c != "hunks"]
    grouped = df.select(*rest, F.size("hunks").alias("_n"),
                        F.posexplode(budget_groups("hunks", measure, budget))
                        .alias("group_idx", "_hunks"))
    # A one-hunk change is one plain pair; splitting it apart needs no state.
    single = let(lambda s: F.array(F.struct(
        F.lit(0).alias("state_idx"), F.lit(1).alias("state_cnt"), s["old"].alias("old"),
        s["new"].alias("new"))), rebuild_single(F.get(F.col("_hunks"), F.lit(0)), compat))
    many = states_of("_hunks", k, seed, "commit", "group_idx", compat=compat)
    states = F.when(F.col("_n") == 1, single).otherwise(many)
    return grouped.select(*rest, "group_idx", F.inline(states))


def line_delta(pairs: DataFrame, key: str, old: str = "old_contents", new: str = "new_contents",
               *slices: str) -> DataFrame:
    """Per pair and distinct line: how often it was added, removed and kept.

    The pair key is hashed once; the line counts reuse that layout.
    """
    def tagged(c, side):
        return F.transform(lines(c), lambda ln: F.struct(ln.alias("line"), F.lit(side).alias("s")))

    counts = (by_key(pairs.select(key, *slices, old, new), key)
              .select(key, *slices, F.inline(F.concat(tagged(old, 0), tagged(new, 1))))
              .groupBy(key, *slices, "line")
              .agg(F.sum(1 - F.col("s")).alias("old_n"), F.sum("s").alias("new_n")))
    return counts.select(
        key, *slices, "line",
        F.greatest(F.col("new_n") - F.col("old_n"), F.lit(0)).alias("added"),
        F.greatest(F.col("old_n") - F.col("new_n"), F.lit(0)).alias("removed"),
        F.least("old_n", "new_n").alias("kept"))


def churn(deltas: DataFrame, *slices: str) -> DataFrame:
    """Line churn per slice, with subtotals."""
    return deltas.rollup(*slices).agg(
        F.sum("added").alias("added"), F.sum("removed").alias("removed"),
        F.sum("kept").alias("kept"))
