"""Coarse edit nodes: very short pieces of a script are merged into replacements.

A node of one token joins the longer node after it (or, at the end, the one before);
two or more one-token nodes in a row form a node of their own; then neighbouring
edits become one replacement.  Which nodes stay kept depends on at most two
neighbours on either side, so the merge is two index filters, not a walk.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import as_col, let
from ..functions.draws import numbers


def _short(op: Column) -> Column:
    size = (F.when(op["tag"] == "insert", op["j2"] - op["j1"])
            .when(op["tag"] == "replace", F.lit(2)).otherwise(op["i2"] - op["i1"]))
    return size == 1


def kept_flags(ops) -> Column:
    """Per node: true if it survives the first merge as a plain kept node."""

    def build(ops, short):
        n = F.size(ops)

        def at(i):
            return F.coalesce(F.get(short, i), F.lit(False))

        def flag(op, i):
            # a lone short node right before, or as the very last node right after
            lone_before = at(i - 1) & ~at(i - 2)
            lone_last = (i == n - 2) & at(i + 1)
            alone = (n == 1) | (~at(i) & ~lone_before & ~lone_last)
            return (op["tag"] == "equal") & alone

        return F.transform(ops, flag)

    return let(lambda ops: let(lambda s: build(ops, s), F.transform(ops, _short)), ops)


def merge_short_edits(ops) -> Column:
    """The script with short edits merged; only ``equal`` and ``replace`` remain."""

    def build(ops, keep):
        def is_first(i):
            return (i == 1) | F.get(keep, i - 1) | F.get(keep, i - 2)

        def is_last(i):
            return (i == F.size(ops)) | F.get(keep, i - 1) | F.get(keep, i)

        firsts = F.filter(numbers(F.size(ops)), is_first)
        lasts = F.filter(numbers(F.size(ops)), is_last)

        def node(f, l):
            a, b = F.element_at(ops, f), F.element_at(ops, l)
            tag = F.when(F.element_at(keep, f), "equal").otherwise("replace")
            return F.struct(tag.alias("tag"), a["i1"].alias("i1"), b["i2"].alias("i2"),
                            a["j1"].alias("j1"), b["j2"].alias("j2"))

        return F.zip_with(firsts, lasts, node)

    return let(lambda ops: let(lambda k: build(ops, k), kept_flags(ops)), as_col(ops))
