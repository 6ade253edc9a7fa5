"""Phrase search in token arrays and unique anchors for edits, both by suffix ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_col, let, once
from .suffixes import phrase_positions, unique_lengths


def positions(phrase, tokens) -> Column:
    """All zero-based positions of ``phrase`` in ``tokens``.

    None for an empty or null phrase; a null token is equal to a null token.
    """
    return F.coalesce(phrase_positions(as_col(phrase), as_col(tokens)), F.array().cast("array<int>"))


def find_phrase(phrase, tokens) -> Column:
    """struct(first, freq, ambiguous); first is -1 when absent, 0 for an empty phrase."""
    return let(
        lambda at: F.struct(
            F.when(F.size(as_col(phrase)) == 0, 0).when(F.size(at) > 0, F.get(at, F.lit(0))).otherwise(-1)
            .alias("first"),
            F.size(at).alias("freq"), (F.size(at) > 1).alias("ambiguous")),
        positions(phrase, tokens))


def anchor_edits(df: DataFrame, a: str, b: str, ops: str, *key: str) -> DataFrame:
    """One row per edit: how it can be named by a phrase that is unique in the old text.

    ``anchor`` is ``self`` (old phrase is unique), ``before`` or ``after`` (unique with
    ``context`` kept tokens on that side) or ``full`` (the whole text must be replaced).
    Inserts have no old phrase and need context.  More context never makes a unique phrase
    ambiguous, so the least unique length from the phrase's start, or up to its end, tells the
    least context: two look-ups an edit, whatever the text repeats.
    """
    # Longer than the name of any column beside them.
    starts, ends = ("_".join([*key, ops, name]) for name in ("starts", "ends"))
    from_place, to_place = unique_lengths(a)
    ranked = df.select(*key, ops, from_place.alias(starts), to_place.alias(ends))

    def per_row(ops, starts, ends):
        def edit(op, i):
            prev, nxt = F.get(ops, i - 1), F.get(ops, i + 1)
            size = op["i2"] - op["i1"]
            before = F.get(ends, op["i2"]) - size
            after = F.get(starts, op["i1"]) - size

            def kept(o):
                return F.coalesce(F.when(o["tag"] == "equal", o["i2"] - o["i1"]), F.lit(0))

            def named(how, context):
                return F.struct(F.lit(how).alias("anchor"), context.cast("int").alias("context"))

            found = (F.when((size > 0) & (after <= 0), named("self", F.lit(0)))
                     .when(before <= kept(prev), named("before", before))
                     .when(after <= kept(nxt), named("after", after))
                     .otherwise(named("full", F.lit(0))))
            return F.struct(i.alias("edit"), op["tag"].alias("tag"), op["i1"].alias("at"), found.alias("found"))

        return F.filter(F.transform(ops, edit), lambda e: e["tag"] != "equal")

    return (ranked.select(*key, F.inline(once(let(per_row, ops, starts, ends))))
            .select(*key, "edit", "tag", "at", "found.anchor", "found.context"))
