"""Key-derived randomness.

A draw is a pure function of (seed, key parts), so samples, masks and mixtures
do not change with partitioning, retries or row order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import as_col


def digest(seed: str, *key: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[as_col(k).cast("string") for k in key]))


def draw(seed: str, *key: Column | str) -> Column:
    """Uniform double in [0, 1): the first 32 bits of the digest over 2**32."""
    head = F.conv(F.substring(digest(seed, *key), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)


def pick(n: Column, k: Column | int, seed: str, *key: Column | str) -> Column:
    """``k`` of the numbers 1..n without replacement, ascending (fewer if n < k)."""
    keyed = F.transform(
        numbers(n),
        lambda i: F.struct(draw(seed, *key, i).alias("u"), i.alias("i")),
    )
    chosen = F.slice(F.sort_array(keyed), F.lit(1), F.lit(k) if isinstance(k, int) else k)
    return F.sort_array(F.transform(chosen, lambda s: s["i"]))


def numbers(n: Column) -> Column:
    """1..n; empty for n < 1 (``sequence(1, 0)`` alone would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(
        F.array().cast("array<int>"))
