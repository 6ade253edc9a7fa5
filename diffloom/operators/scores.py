"""Corpus scores: per-row statistics, their sums, a closed form on the sums.

``preds`` tables hold one row per prediction.  All statistics are additive, so any
score can be taken per corpus slice, per row, over resamples or over a stream.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import as_col
from ..functions.draws import draw
from ..functions.text import (normalize_for_match, normalize_tokens_for_match, strip, words)
from ..layout import by_key
from ..markers import KEYWORD_WEIGHT, OTHER_WEIGHT
from .overlaps import contained, item_hashes, matched_places, net_matches, normalized_edges, pair_matches

ORDERS = (1, 2, 3, 4)
EPSILON, ALPHA, K = 0.1, 5.0, 5.0  # fixed values: smoothing constants
TINY = sys.float_info.min
Z95 = 1.959964  # fixed value: 95 % normal interval


# --- statistics ---------------------------------------------------------------

def pair_stats(preds: DataFrame, keys: list[str], hyp: Column | str, ref: Column | str,
               keywords: list[str] | None = None, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """One row per key: lengths, and per order matches ``m``, hypothesis ``h`` and reference
    ``r`` n-gram counts; with ``keywords`` also the weighted unigram sums ``wm``, ``wr``.

    A projection: rows stay where they are.
    """
    top = max(orders)
    hashed = preds.select(*keys, item_hashes(hyp, keywords).alias("_h"), item_hashes(ref, keywords).alias("_r"))
    made = _fields(hashed, keys, pair_matches(F.col("_h"), F.col("_r"), top, keywords is not None))

    def rest(length, n):
        return F.greatest(F.col(f"{length}") - (n - 1), F.lit(0))

    cols = [F.col("hyp_len"), F.col("ref_len")]
    for n in orders:
        cols += [F.col(f"m{n}"), rest("hyp_len", n).alias(f"h{n}"), rest("ref_len", n).alias(f"r{n}")]
    # Every token weighs OTHER_WEIGHT, a keyword that much more.
    if keywords is not None:
        cols += [(F.lit(OTHER_WEIGHT) * F.col(f"{of}") + F.lit(KEYWORD_WEIGHT - OTHER_WEIGHT) * F.col(f"{kw}")).alias(name)
                 for name, of, kw in (("wm", "m1", "mk"), ("wr", "ref_len", "rk"))]
    return made.select(*keys, *cols)


def _fields(df: DataFrame, keys: list[str], stats: Column) -> DataFrame:
    """keys plus the fields of ``stats``; a generator, so it is evaluated once."""
    return df.select(*keys, F.inline(F.array(stats)))


def multi_ref_stats(preds: DataFrame, refs: DataFrame, key: str, hyp: Column | str,
                    ref: Column | str, ref_id: str) -> DataFrame:
    """As ``pair_stats`` with several references per row.

    An n-gram matches up to its largest count in any reference: with repeats numbered, the
    matches are the union over references of the hypothesis' places they match.  A reference
    leaves a bitmap of those places, and bitmaps are united word by word: no n-gram leaves its
    row, and only texts and their tokens' hashes are shuffled.
    ``ref_len`` is the shortest and ``close_len`` the closest reference length.
    """
    places = [f"p{n}" for n in ORDERS]
    own = by_key(preds, key).select(key, item_hashes(hyp).alias("_h"))
    each = by_key(refs, key).select(key, item_hashes(ref).alias("_r"))
    sized = each.join(own, key).withColumn("hyp_len", F.size("_h").cast("long"))
    paired = _fields(sized, [key, "hyp_len"], matched_places(F.col("_h"), F.col("_r"), max(ORDERS)))

    def entry(n, word, mask, size):
        return F.struct(F.lit(n).alias("n"), word.alias("word"), mask.alias("mask"), size.cast("long").alias("len"))

    def of_order(n):
        return lambda mask, word: entry(n, word, mask, F.lit(None))

    # One row per reference for its length, and one per 64 places of an order.
    flat = paired.select(key, "hyp_len", F.inline(F.concat(
        F.array(entry(0, F.lit(0), F.lit(0).cast("long"), F.col("len"))),
        *[F.transform(p, of_order(n)) for n, p in zip(ORDERS, places)])))
    once = flat.groupBy(key, "n", "word").agg(
        F.max("hyp_len").alias("hyp_len"), F.bit_or("mask").alias("mask"), F.min("len").alias("ref_len"),
        F.min(F.struct(F.abs(F.col("len") - F.col("hyp_len")).alias("gap"), "len"))["len"].alias("close_len"))
    sums = once.groupBy(key).agg(
        F.max("hyp_len").alias("hyp_len"), F.min("ref_len").alias("ref_len"),
        F.max(F.when(F.col("n") == 0, F.col("close_len"))).alias("close_len"),
        *[F.sum(F.when(F.col("n") == n, F.bit_count("mask")).otherwise(0)).alias(f"m{n}") for n in ORDERS])
    return sums.select("*", *[F.greatest(F.col("hyp_len") - (n - 1), F.lit(0)).alias(f"h{n}") for n in ORDERS])


def gleu_stats(preds: DataFrame, keys: list[str], src: Column | str, hyp: Column | str,
               ref: Column | str) -> DataFrame:
    """Per row: lengths and per order ``g`` = matches with the reference less matches with
    source n-grams the reference does not have, not below 0; ``d`` = hypothesis n-grams."""
    hashed = preds.select(*keys, item_hashes(src).alias("_s"), item_hashes(hyp).alias("_h"), item_hashes(ref).alias("_r"))
    made = _fields(hashed, keys, net_matches(F.col("_s"), F.col("_h"), F.col("_r"), max(ORDERS)))
    cols = [F.col("hyp_len"), F.col("ref_len")]
    for n in ORDERS:
        cols += [F.col(f"g{n}"), F.greatest(F.col("hyp_len") - (n - 1), F.lit(0)).alias(f"d{n}")]
    return made.select(*keys, *cols)


def total(stats: DataFrame, *slices: str, exprs: dict[str, Column] | None = None,
          weight: Column | None = None) -> DataFrame:
    """Sums of statistics per slice."""
    cols = exprs or {c: F.col(c) for c in stats.columns if c not in slices}
    w = weight if weight is not None else F.lit(1)
    return stats.groupBy(*slices).agg(*[F.sum(c * w).alias(name) for name, c in cols.items()])


# --- closed forms -------------------------------------------------------------

def brevity(ref_len, hyp_len) -> Column:
    r, h = as_col(ref_len), as_col(hyp_len)
    return F.when(h > r, F.lit(1.0)).when(h == 0, F.lit(0.0)).otherwise(
        F.exp(1 - F.try_divide(r, h)))


def geometric(precisions: list[Column], weights: list[Column] | None = None) -> Column:
    ws = weights or [F.lit(1.0 / len(precisions))] * len(precisions)
    logs = [w * F.ln(p) for w, p in zip(ws, precisions)]
    return F.exp(sum(logs[1:], logs[0]))


def bleu_form(stats: DataFrame, smooth: bool = True, out: str = "bleu") -> DataFrame:
    """BLEU-4 from summed ``m``, ``h`` and lengths; ``smooth`` adds one on every order."""
    if smooth:
        ps = [(F.col(f"m{n}") + 1.0) / (F.col(f"h{n}") + 1.0) for n in ORDERS]
        score = geometric(ps)
    else:
        ps = [F.coalesce(F.try_divide(f"m{n}", f"h{n}"), F.lit(0.0)) for n in ORDERS]
        score = F.when(F.least(*ps) > 0, geometric(ps)).otherwise(0.0)
    return stats.withColumn(out, score * brevity("ref_len", "hyp_len"))


def corpus_bleu(preds: DataFrame, key: str, hyp, ref, *slices: str, smooth: bool = True) -> DataFrame:
    """(slices, bleu): one score per slice of a table with one reference per row."""
    sums = total(pair_stats(preds, [key, *slices], hyp, ref).drop(key), *slices)
    return bleu_form(sums, smooth)


def file_bleu(preds: DataFrame, key: str, hyp: str, ref: str) -> DataFrame:
    """Score in percent with two digits from raw lines."""
    scored = corpus_bleu(preds, key, words(hyp), words(ref))
    return scored.select(F.round(F.col("bleu") * 100, 2).alias("bleu"))


Smoothing = Callable[[list[Column], list[Column], Column], list[Column]]


def smoothing(method: int) -> Smoothing:
    """Smoothing 0-7: numerators, denominators and hypothesis length to precisions.

    5, 6 and 7 read the n-grams of one sentence and are meant for per-row statistics;
    5 and 7 need a fifth order.
    """

    def plain(num, den):
        return [m / d for m, d in zip(num, den)]

    def m0(num, den, hyp):
        return [F.when(m == 0, F.lit(TINY)).otherwise(m / d) for m, d in zip(num, den)]

    def m1(num, den, hyp):
        return [F.when(m == 0, EPSILON / d).otherwise(m / d) for m, d in zip(num, den)]

    def m2(num, den, hyp):
        return [(m + 1) / (d + 1) for m, d in zip(num, den)]

    def m3(num, den, hyp):
        out, zeros = [], F.lit(0)
        for m, d in zip(num, den):
            zeros = zeros + F.when(m == 0, 1).otherwise(0)
            out.append(F.when(m == 0, 1 / (F.pow(F.lit(2.0), zeros) * d)).otherwise(m / d))
        return out

    def m4(num, den, hyp):
        # No value for a one-token hypothesis: its logarithm is zero.
        extra = F.try_divide(F.lit(K), F.ln(hyp))
        return [F.when((m == 0) & (hyp != 0), (F.lit(i) + extra) / d).otherwise(m / d)
                for i, (m, d) in enumerate(zip(num, den))]

    def averaged(ps, extra):
        out, before = [], ps[0] + 1
        for here, after in zip(ps, ps[1:] + [extra]):
            before = (before + here + after) / 3
            out.append(before)
        return out

    def m5(num, den, hyp):
        ps = plain(num, den)
        return averaged(ps[:4], ps[4])

    def m6(num, den, hyp):
        ps = plain(num, den)
        for i in range(2, len(ps)):
            prior = F.coalesce(F.try_divide(ps[i - 1] * ps[i - 1], ps[i - 2]), F.lit(0.0))
            grams = F.greatest(hyp - i, F.lit(0))
            ps[i] = (num[i] + ALPHA * prior) / (grams + ALPHA)
        return ps

    def m7(num, den, hyp):
        return averaged(m4(num[:4], den[:4], hyp), num[4] / den[4])

    return [m0, m1, m2, m3, m4, m5, m6, m7][method]


def epsilon_inputs(close_len: str = "ref_len", orders=ORDERS) -> dict[str, Column]:
    """What the epsilon-smoothed score sums: denominators are at least 1 per row."""
    cols = {"hyp_len": F.col("hyp_len"), "ref_len": F.col(close_len)}
    for n in orders:
        cols[f"num{n}"] = F.col(f"m{n}")
        cols[f"den{n}"] = F.greatest(F.col(f"h{n}"), F.lit(1))
    return cols


def smoothed_form(sums: DataFrame, method: int = 1, auto_reweigh: bool = False,
                  out: str = "score") -> DataFrame:
    """Score from summed ``num``, ``den`` and lengths; 0 without any unigram match."""
    orders = (1, 2, 3, 4, 5) if method in (5, 7) else ORDERS
    ps = smoothing(method)([F.col(f"num{n}") for n in orders], [F.col(f"den{n}") for n in orders],
                           F.col("hyp_len"))
    hyp = F.col("hyp_len")
    short = F.lit(auto_reweigh) & (hyp < 4)
    even = F.try_divide(F.lit(1.0), hyp)
    ws = [F.when(short, F.when(F.lit(n) <= hyp, even).otherwise(0.0)).otherwise(0.25)
          for n in ORDERS]
    score = brevity("ref_len", "hyp_len") * geometric(ps, ws)
    return sums.withColumn(out, F.when(F.col("num1") == 0, 0.0).otherwise(score))


def epsilon_bleu(preds: DataFrame, key: str, hyp, ref, *slices: str, method: int = 1) -> DataFrame:
    stats = pair_stats(preds, [key, *slices], hyp, ref)
    return smoothed_form(total(stats, *slices, exprs=epsilon_inputs()), method)


def sentence_scores(stats: DataFrame, method: int = 1, out: str = "score") -> DataFrame:
    """One score per row of statistics."""
    orders = (1, 2, 3, 4, 5) if method in (5, 7) else ORDERS
    cols = epsilon_inputs(orders=orders)
    keep = [c for c in stats.columns if c not in cols]
    per_row = stats.select(*keep, *[c.alias(name) for name, c in cols.items()])
    return smoothed_form(per_row, method, out=out)


def keyword_inputs(true_length: bool = False) -> dict[str, Column]:
    """What the keyword-weighted recall sums.

    Published scores measure every reference as two tokens long; ``true_length``
    takes its real length instead.
    """
    cols = {"hyp_len": F.col("hyp_len"),
            "ref_len": F.col("ref_len") if true_length else F.lit(2).cast("long"),
            "num1": F.col("wm"), "den1": F.greatest(F.col("wr"), F.lit(1.0))}
    for n in ORDERS[1:]:
        cols[f"num{n}"] = F.col(f"m{n}")
        cols[f"den{n}"] = F.greatest(F.col(f"r{n}"), F.lit(1))
    return cols


def keyword_recall(preds: DataFrame, key: str, hyp, ref, keywords: list[str], *slices: str,
                   true_length: bool = False) -> DataFrame:
    stats = pair_stats(preds, [key, *slices], hyp, ref, keywords)
    return smoothed_form(total(stats, *slices, exprs=keyword_inputs(true_length)))


def by_side(df: DataFrame, keys: list[str], side: str, items: Column) -> DataFrame:
    """(keys, ref, cand): the array ``items`` of both sides' rows, one after the other."""
    packed = df.select(*keys, F.col(side).alias("_side"), items.alias("_items"))
    return packed.groupBy(*keys).agg(*[
        F.flatten(F.collect_list(F.when(F.col("_side") == name, F.col("_items")))).alias(name) for name in ("ref", "cand")])


def structure_match(features: DataFrame, key: str, side: str, sigs: str, *slices: str) -> DataFrame:
    """(slices, matched, total, score): share of reference features whose signature
    the candidate also has, however often.  A feature row holds an array of signatures, so
    what is grouped is a row per text; features meet inside their row as 64-bit hashes."""
    paired = by_side(features, [key, *slices], side, item_hashes(sigs))
    counted = paired.select(*slices, contained(F.col("ref"), F.col("cand")).alias("_hit"), F.size("ref").alias("_all"))
    return counted.groupBy(*slices).agg(F.sum("_hit").alias("matched"), F.sum("_all").alias("total")).withColumn(
        "score", F.try_divide("matched", "total"))


def containment(features: DataFrame, key: str, side: str, sigs: str, *slices: str) -> DataFrame:
    """(slices, n): reference features that the candidate side of the same key has; rows without a key match none.

    A join of the sides by key: what meets is a row per text, and signatures meet inside it as 64-bit hashes.
    """
    def hashed(name):
        return features.where(F.col(side) == name).select(key, *slices, item_hashes(sigs).alias(name))

    cands = hashed("cand").groupBy(key).agg(F.flatten(F.collect_list("cand")).alias("cand"))
    counted = hashed("ref").join(cands, key).select(*slices, contained(F.col("ref"), F.col("cand")).alias("_hit"))
    return counted.where("_hit > 0").groupBy(*slices).agg(F.sum("_hit").cast("long").alias("n"))


def normalize_flow(edges: DataFrame, key: str, side: str) -> DataFrame:
    """(key, ref, cand): hashes of edges with variables numbered by first appearance.

    Input rows hold an array ``edges`` of ``pos``, ``name``, ``rel``, ``parents`` (names), in
    order of ``pos``.  A text's parents count as seen before the variable they feed.  Null
    names are left out, and rows without a key.
    """
    def nodes(e):
        return F.filter(F.concat(e["parents"], F.array(e["name"])), lambda x: x.isNotNull())

    # Every name of an edge in reading order: parents first, then the variable itself.
    named = F.filter(F.transform("edges", lambda e: F.struct(
        e["pos"].alias("pos"), F.xxhash64(e["rel"]).alias("rel"),
        F.transform(nodes(e), lambda x: F.xxhash64(x)).alias("nodes"))), lambda e: F.size(e["nodes"]) > 0)
    rows = edges.where(F.col(key).isNotNull()).select(
        key, side, F.struct(F.monotonically_increasing_id().alias("row"), named.alias("e")).alias("_r"))
    packed = rows.groupBy(key, side).agg(F.collect_list("_r").alias("_all"))

    def placed(r):
        return F.transform(r["e"], lambda e, i: F.struct(
            e["pos"].alias("pos"), r["row"].alias("row"), i.alias("i"), e["rel"].alias("rel"), e["nodes"].alias("nodes")))

    # Texts that share a key are read as one, by place and then in the order of the rows.
    merged = F.transform(F.array_sort(F.flatten(F.transform("_all", placed))), lambda x: F.struct(
        x["pos"].alias("pos"), x["rel"].alias("rel"), x["nodes"].alias("nodes")))
    ordered = packed.select(key, side, F.when(F.size("_all") == 1, F.get("_all", F.lit(0))["e"]).otherwise(merged).alias("_e"))
    flat = ordered.select(key, side, F.col("_e.rel").alias("_rel"), F.transform("_e", lambda e: F.size(e["nodes"])).alias("_n"),
                          F.flatten("_e.nodes").alias("_names"))
    made = flat.select(key, side, normalized_edges(F.col("_rel"), F.col("_n"), F.col("_names")).alias("_edges"))
    return by_side(made, [key], side, F.col("_edges"))


def flow_match(edges: DataFrame, key: str, side: str) -> DataFrame:
    """(matched, total, score): clipped overlap of normalised edges; 0 without reference edges."""
    sums = _fields(normalize_flow(edges, key, side), [key], pair_matches(F.col("cand"), F.col("ref"), 1, False))
    return sums.agg(F.coalesce(F.sum("m1"), F.lit(0)).alias("matched"),
                    F.coalesce(F.sum("ref_len"), F.lit(0)).alias("total")).withColumn(
        "score", F.coalesce(F.try_divide("matched", "total"), F.lit(0.0)))


def composite(parts: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """One row: the named one-row scores and their weighted sum (null if one is missing)."""
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("_part"), F.col("score").cast("double").alias("_score"))
        rows = one if rows is None else rows.unionByName(one)
    scores = rows.agg(*[F.max(F.when(F.col("_part") == n, F.col("_score"))).alias(n) for n in parts])
    cols = [F.col(n) * F.lit(w) for n, w in weights.items()]
    return scores.withColumn("composite", sum(cols[1:], cols[0]))


def gleu_form(sums: DataFrame, smooth: bool = False, out: str = "gleu") -> DataFrame:
    """Edit-aware score from summed ``g``, ``d`` and lengths; 0 if any sum is 0."""
    names = ["hyp_len", "ref_len"] + [f"{p}{n}" for n in ORDERS for p in "gd"]
    val = {c: F.when(F.col(c) == 0, F.lit(1)).otherwise(F.col(c)) if smooth else F.col(c)
           for c in names}
    score = F.exp(F.least(F.lit(0.0), 1 - F.try_divide(val["ref_len"], val["hyp_len"]))) * geometric(
        [F.try_divide(val[f"g{n}"], val[f"d{n}"]) for n in ORDERS])
    return sums.withColumn(out, F.when(F.least(*val.values()) == 0, 0.0).otherwise(score))


def gleu(preds: DataFrame, key: str, src, hyp, ref, *slices: str) -> DataFrame:
    """A missing hypothesis counts as the unchanged source."""
    stats = gleu_stats(preds, [key, *slices], src, F.coalesce(as_col(hyp), as_col(src)), ref)
    return gleu_form(total(stats.drop(key), *slices))


def gleu_multi(preds: DataFrame, refs: DataFrame, key: str, src, hyp, ref: str, ref_id: str,
               seed: str | None = None) -> DataFrame:
    """One reference text is used per row: a drawn one, or the first without a seed."""
    order = draw(seed, key, ref_id) if seed else F.col(ref_id)
    chosen = refs.groupBy(key).agg(F.min_by(ref, order).alias("_ref"))
    return gleu(preds.join(chosen, key), key, src, hyp, words("_ref"))


# --- accuracy, bundles, resampling --------------------------------------------

def exact_match(preds: DataFrame, pred: str, gold: str, *slices: str) -> DataFrame:
    hit = (strip(pred) == strip(gold)).cast("double")
    return preds.groupBy(*slices).agg((F.avg(hit) * 100).alias("em"),
                                      F.count("*").alias("n_rows"))


def normalized_accuracy(preds: DataFrame, pred, gold, *slices: str, on: str = "text") -> DataFrame:
    norm = normalize_for_match if on == "text" else normalize_tokens_for_match
    hit = (norm(pred) == norm(gold)).cast("double")
    return preds.groupBy(*slices).agg((F.avg(hit) * 100).alias("acc"))


def as_metrics(df: DataFrame, columns: list[str], *ids: str) -> DataFrame:
    """Long form (ids, metric, value)."""
    return df.select(*ids, F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in columns])))


def edit_bundle(preds: DataFrame, key: str, src, hyp, ref) -> DataFrame:
    """(metric, value): edit-aware score and normalised accuracy on token arrays."""
    return as_metrics(gleu(preds, key, src, hyp, ref), ["gleu"]).unionByName(
        as_metrics(normalized_accuracy(preds, hyp, ref, on="tokens"), ["acc"]))


def bootstrap(stats: DataFrame, key: str, rounds: int, form: Callable[[DataFrame], DataFrame],
              score: str, seed: str = "boot") -> DataFrame:
    """(mean, std, low, high) of a score over resamples of rows.

    Each row's weight in a round is a drawn Poisson(1) count, so rounds need no global
    sampling: one aggregate with a weighted sum per round and column, and no row is copied.
    """
    cols = [c for c in stats.columns if c != key]
    weights = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: poisson_one(draw(seed, key, r)))
    sums = [F.sum(F.col(c) * F.get("_w", F.lit(r))).alias(f"{c}_{r}") for r in range(rounds) for c in cols]
    wide = stats.withColumn("_w", weights).agg(*sums)
    each = wide.select(F.inline(F.array(*[F.struct(*[F.col(f"{c}_{r}").alias(c) for c in cols])
                                          for r in range(rounds)])))
    return interval(form(each), score)


def poisson_steps(bits: int = 32) -> list[float]:
    """The Poisson(1) distribution function as far as a draw of ``bits`` bits can reach."""
    steps, term, total_ = [], math.exp(-1), 0.0
    while total_ < 1 - 2.0 ** -bits:
        total_ += term
        steps.append(round(total_, 15))
        term /= len(steps)
    return steps


def poisson_one(u: Column) -> Column:
    """Inverse transform of a uniform draw; no count is cut off."""
    return F.size(F.filter(F.array(*[F.lit(s) for s in poisson_steps()]), lambda s: u >= s))


def interval(scores: DataFrame, score: str) -> DataFrame:
    """Mean, population deviation and 95 % normal interval."""
    out = scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return (out.withColumn("low", F.col("mean") - Z95 * F.col("std"))
            .withColumn("high", F.col("mean") + Z95 * F.col("std")))
