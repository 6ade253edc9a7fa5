"""Projections, row gates, rejects and audit counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_col
from ..functions.lex import token_length
from ..functions.text import is_blank, words

STATE_TYPE = "commitpack_diffusion"


def conform(df: DataFrame, columns: dict[str, str], literals: dict[str, str]) -> DataFrame:
    """Rename source columns and add constant ones."""
    return df.select(*[F.col(src).alias(dst) for dst, src in columns.items()],
                     *[F.lit(v).alias(k) for k, v in literals.items()])


def real_change(old="old", new="new") -> Column:
    """Both sides non-empty and different; null sides fail."""
    o, n = as_col(old), as_col(new)
    return (o != "") & (n != "") & (o != n)


def real_change_nonblank(old="old", new="new") -> Column:
    o, n = as_col(old), as_col(new)
    return (o != n) & ~is_blank(o) & ~is_blank(n)


def length_gate(df: DataFrame, msg: str = "msg", old: str = "old", new: str = "new",
                measure: Callable[[Column], Column] = token_length, min_words: int = 3,
                budget: int = 510) -> DataFrame:
    """Messages of at least three words, both sides within the token budget.

    The cheap word test comes first: a conjunction short-circuits from the left.
    """
    return df.where((F.size(words(msg)) >= min_words)
                    & (measure(F.col(old)) <= budget) & (measure(F.col(new)) <= budget))


def with_message(df: DataFrame, nl_tokens: str = "nl_tokens", type_col: str = "type") -> DataFrame:
    """Only state rows may go without a message."""
    return df.where((F.col(type_col) == STATE_TYPE) | (F.size(nl_tokens) > 0))


def scanned_limit(df: DataFrame, idx: str, n: int) -> DataFrame:
    """The first ``n`` scanned rows, before any other filter; -1 means all."""
    return df if n < 0 else df.where(F.col(idx) < n)


def reject_reason(reasons: dict[str, Column]) -> Column:
    """Name of the first condition that holds, null if none does."""
    out = None
    for name, cond in reasons.items():
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def route(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejects with ``reason``): nothing is lost silently."""
    tagged = df.withColumn("reason", reject_reason(reasons))
    return (tagged.where(F.col("reason").isNull()).drop("reason"),
            tagged.where(F.col("reason").isNotNull()))


def funnel(df: DataFrame, *slices: str, old: str = "old", new: str = "new") -> DataFrame:
    """Row counts and empty or missing sides per slice."""
    def empty(c):
        return F.count_if(F.col(c) == "")

    def missing(c):
        return F.count_if(F.col(c).isNull())

    return df.groupBy(*slices).agg(
        F.count("*").alias("n_rows"), empty(old).alias("empty_old"), empty(new).alias("empty_new"),
        missing(old).alias("null_old"), missing(new).alias("null_new"),
        F.count_if(F.col(old) == F.col(new)).alias("unchanged"),
        F.count_if(real_change(old, new)).alias("kept"))


def composition(df: DataFrame, *slices: str) -> DataFrame:
    """Row counts with subtotals."""
    return df.rollup(*slices).agg(F.count("*").alias("n_rows"))


def union_corpora(*parts: DataFrame) -> DataFrame:
    """Bag union; duplicates stay."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
