"""Hunk strings, patches and comment removal."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import as_col, let
from ..markers import HUNK_MARKER
from .text import BLANK, is_blank, lines

HUNK_HEAD = r"\A@@ -[0-9]+,[0-9]+ \+[0-9]+,[0-9]+ @@"
HEAD_THEN_BLANK = "@@\n\n"

# Comment shapes.
BLOCK_COMMENT = r"/\*(?s:.*?)\*/"
LINE_COMMENT = r"//[^\n]*"
SINGLE_QUOTED = r"'[^'\\]*(?:\\(?s:.)[^'\\]*)*'"
DOUBLE_QUOTED = r'"[^"\\]*(?:\\(?s:.)[^"\\]*)*"'
COMMENT_AWARE = "|".join([LINE_COMMENT, BLOCK_COMMENT, SINGLE_QUOTED, DOUBLE_QUOTED,
                          r"""[^/'"]+""", r"(?s:.)"])


def pack_hunks(hunks) -> Column:
    return F.array_join(as_col(hunks), f"\n{HUNK_MARKER}\n")


def unpack_hunks(packed) -> Column:
    return F.split(as_col(packed), f"\n{HUNK_MARKER}\n", -1)


def side_lines(hunk, sign: str) -> Column:
    """The lines of one side: ``-`` for old, ``+`` for new; context belongs to both."""
    kept = F.filter(F.split(as_col(hunk), "\n", -1),
                    lambda ln: ln.startswith(sign) | ln.startswith(" "))
    return F.transform(kept, lambda ln: F.substring(ln, 2, 2**31 - 1))


def rebuild_old(hunk) -> Column:
    return F.array_join(side_lines(hunk, "-"), "\n")


def rebuild_new(hunk) -> Column:
    return F.array_join(side_lines(hunk, "+"), "\n")


def rebuild_single(hunk, compat: bool = False) -> Column:
    """struct(old, new) of a one-hunk change; lines without a sign go to both sides.

    ``compat`` keeps a known fault of published data: a deleted line stands twice on
    the old side and once on the new side.
    """
    parts = F.split(as_col(hunk), "\n", -1)

    def cut(ln):
        return F.substring(ln, 2, 2**31 - 1)

    def old(ln):
        plus = F.array().cast("array<string>")
        minus = F.array(cut(ln), cut(ln)) if compat else F.array(cut(ln))
        return F.when(ln.startswith("+"), plus).when(ln.startswith("-"), minus).otherwise(
            F.array(cut(ln)))

    def new(ln):
        minus = F.array(cut(ln)) if compat else F.array().cast("array<string>")
        return F.when(ln.startswith("-"), minus).otherwise(F.array(cut(ln)))

    return F.struct(F.array_join(F.flatten(F.transform(parts, old)), "\n").alias("old"),
                    F.array_join(F.flatten(F.transform(parts, new)), "\n").alias("new"))


def patch_body_sides(body) -> Column:
    """struct(old, new) of patch text; unsigned lines go to both, blank lines are dropped."""
    parts = F.split(as_col(body), "\n", -1)

    def side(drop: str):
        kept = F.filter(parts, lambda ln: ~ln.startswith(drop))
        plain = F.transform(kept, lambda ln: F.when(
            ln.rlike(r"\A[-+ ]"), F.substring(ln, 2, 2**31 - 1)).otherwise(ln))
        return F.array_join(F.filter(plain, lambda ln: F.replace(ln, F.lit(" "), F.lit("")) != ""),
                            "\n")

    return F.struct(side("+").alias("old"), side("-").alias("new"))


def split_patch(diff) -> Column:
    """Sides of a patch that opens with a hunk head; null without a head or a change."""
    d = as_col(diff)
    sides = patch_body_sides(F.regexp_replace(d, HUNK_HEAD, ""))
    return F.when(d.rlike(HUNK_HEAD), let(lambda s: F.when(s["old"] != s["new"], s), sides))


def split_patch_after_blank(diff) -> Column:
    """Sides of the text after the first ``@@`` line followed by an empty line; else null."""
    d = as_col(diff)
    at = F.instr(d, HEAD_THEN_BLANK)
    body = F.substring(d, at + F.lit(len(HEAD_THEN_BLANK)), F.length(d))
    return F.when(at > 0, patch_body_sides(body))


def drop_blank_lines(c) -> Column:
    return F.array_join(F.filter(lines(c), lambda ln: ~is_blank(ln)), "\n")


def strip_java_comments(c) -> Column:
    """Comments removed wherever they stand, then blank lines removed."""
    return drop_blank_lines(F.regexp_replace(as_col(c), f"{BLOCK_COMMENT}|{LINE_COMMENT}", ""))


def strip_comments_keep_literals(c) -> Column:
    """Comments outside literals become one space; blank lines are removed."""
    pieces = F.regexp_extract_all(as_col(c), F.lit(COMMENT_AWARE), F.lit(0))
    cleaned = F.array_join(
        F.transform(pieces, lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.lit(" "))
                    .otherwise(p)), "")
    kept = F.filter(F.split(cleaned, "\n", -1), lambda ln: ~ln.rlike(rf"\A{BLANK}*\z"))
    return F.array_join(kept, "\n")
