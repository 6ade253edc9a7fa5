"""Mask vectors and sentinel collapsing on token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import as_col, let
from ..markers import SENTINEL_LIMIT
from .draws import numbers, pick

MEAN_SPAN = 2.5


def floor_div(x: Column, y: float) -> Column:
    """Floor division the way the fmod-based definition rounds it."""
    return F.round((x - x % F.lit(y)) / F.lit(y))


def span_length(n: Column, share: float) -> Column:
    """Mean noise span length for masking ``share`` of ``n`` tokens."""
    return F.greatest(floor_div(n.cast("double") * F.lit(share), MEAN_SPAN), F.lit(1.0))


def noise_total(n: Column, mean_len: Column, mean_count: float = MEAN_SPAN) -> Column:
    wanted = F.bround(F.lit(mean_count) * mean_len).cast("int")
    most = F.greatest(F.floor(n / F.lit(1.5)).cast("int"), F.lit(1))
    return F.least(F.greatest(wanted, F.lit(1)), most)


def noise_spans(total: Column, mean_len: Column) -> Column:
    return F.greatest(F.bround(total / mean_len).cast("int"), F.lit(1))


def composition(n: Column, parts: Column, seed: str, *key) -> Column:
    """Lengths of ``parts`` positive segments that sum to ``n``, cut at drawn points."""
    cuts = F.concat(F.array(F.lit(0)), pick(n - 1, parts - 1, seed, *key), F.array(n))
    return let(lambda c: F.transform(
        numbers(F.size(c) - 1), lambda i: F.element_at(c, i + 1) - F.element_at(c, i)), cuts)


def span_noise_mask(n, share: float, seed: str, *key) -> Column:
    """0/1 vector of length ``n``: kept and noise segments alternate, kept first.

    All zeros where the wanted number of segments does not fit.
    """

    def build(n, total, spans):
        kept = n - total
        # One segment per side where they do not fit: kept then noise, blanked below.
        fits = (kept >= spans) & (total >= spans)
        parts = F.when(fits, spans).otherwise(F.lit(1))
        mask = F.flatten(F.zip_with(
            composition(kept, parts, seed + "-keep", *key),
            composition(total, parts, seed + "-noise", *key),
            lambda a, b: F.concat(F.array_repeat(F.lit(0), a), F.array_repeat(F.lit(1), b))))
        return F.when(fits, mask).otherwise(F.array_repeat(F.lit(0), n))

    return let(
        lambda n, mean: let(
            lambda total: let(lambda spans: build(n, total, spans), noise_spans(total, mean)),
            noise_total(n, mean)),
        as_col(n).cast("int"), span_length(as_col(n), share))


def message_mask(n, seed: str, *key) -> Column:
    """Short token runs (five or fewer) stay whole; longer ones lose a fifth."""
    return let(lambda n: F.when(n > 5, span_noise_mask(n, 0.2, seed, *key)).otherwise(
        F.array_repeat(F.lit(0), n)), as_col(n).cast("int"))


def sentinel(rank: Column) -> Column:
    """The sentinel for a 1-based rank."""
    return F.concat(F.lit("<extra_id_"), (rank - 1).cast("string"), F.lit(">"))


def ranked_hits(flags) -> Column:
    """Positions (1-based) of the first 99 set flags; a position's index is its rank."""
    keyed = F.transform(as_col(flags), lambda x, i: F.when(x == 1, i + 1))
    return F.slice(F.filter(keyed, lambda i: i.isNotNull()), 1, SENTINEL_LIMIT)


def run_starts(mask) -> Column:
    return let(lambda m: F.transform(m, lambda x, i: F.when(
        (x == 1) & ((i == 0) | (F.get(m, i - 1) == 0)), 1).otherwise(0)), mask)


def collapse_masks(tokens, mask) -> Column:
    """Each run of masked tokens becomes one sentinel; runs after the 99th vanish."""

    def build(t, m, ranked):
        out = F.transform(t, lambda x, i: F.when(F.get(m, i) == 0, x).otherwise(
            let(lambda r: F.when(r > 0, sentinel(r)), F.array_position(ranked, i + 1))))
        return F.filter(out, lambda x: x.isNotNull())

    return let(lambda t, m: let(lambda r: build(t, m, r), ranked_hits(run_starts(m))),
               tokens, mask)


def mark_tokens(tokens, flags, replace: bool) -> Column:
    """Put a sentinel at each of the first 99 flagged tokens: in its place or before it."""

    def piece(x, rank):
        mark = F.array(sentinel(rank)) if replace else F.array(sentinel(rank), x)
        return F.when(rank > 0, mark).otherwise(F.array(x))

    def build(t, f, ranked):
        return F.flatten(F.transform(t, lambda x, i: F.when(
            F.get(f, i) == 1, let(lambda r: piece(x, r), F.array_position(ranked, i + 1)))
            .otherwise(F.array(x))))

    return let(lambda t, f: let(lambda r: build(t, f, r), ranked_hits(f)), tokens, flags)
