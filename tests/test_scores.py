"""Published score values and properties of scores."""

import collections
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from diffloom.operators import scores as S

HYP1 = "It is a guide to action which ensures that the military always obeys the commands of the party".split()
HYP2 = "It is to insure the troops forever hearing the activity guidebook that party direct".split()
REF1 = "It is a guide to action that ensures that the military will forever heed Party commands".split()
REF2 = ("It is the guiding principle which guarantees the military forces always being under the command "
        "of the Party").split()
REF3 = "It is the practical guide for the army always to heed the directions of the party".split()


def one(spark, hyp, refs, method=1):
    preds = spark.createDataFrame([(1, hyp)], "k int, h array<string>")
    rows = [(1, i, r) for i, r in enumerate(refs)]
    stats = S.multi_ref_stats(preds, spark.createDataFrame(rows, "k int, i int, r array<string>"),
                              "k", "h", "r", "i")
    cols = S.epsilon_inputs("close_len")
    sums = stats.select(*[c.alias(n) for n, c in cols.items()])
    return S.smoothed_form(sums, method).first()["score"]


def test_three_references(spark):
    assert one(spark, HYP1, [REF1, REF2, REF3]) == pytest.approx(0.5045, abs=1e-4)


@pytest.mark.parametrize("method,want", [(0, .4118), (1, .4118), (2, .4489), (3, .4118), (4, .4118),
                                         (5, .4905), (6, .4135), (7, .4905)])
def test_smoothing_values(spark, method, want):
    df = spark.createDataFrame([(1, HYP1, REF1)], "k int, h array<string>, r array<string>")
    stats = S.pair_stats(df, ["k"], "h", "r", orders=(1, 2, 3, 4, 5))
    assert S.sentence_scores(stats, method).first()["score"] == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("refs,hyp,want", [((12, 15, 17), 12, 1.0), ((28, 28), 12, 0.2635971381157267),
                                           ((13, 2), 12, 0.9200), ((11, 8), 7, 0.8668),
                                           ((11, 8, 6, 7), 7, 1.0)])
def test_brevity(spark, refs, hyp, want):
    preds = spark.createDataFrame([(1, ["a"] * hyp)], "k int, h array<string>")
    rows = spark.createDataFrame([(1, i, ["a"] * n) for i, n in enumerate(refs)],
                                 "k int, i int, r array<string>")
    close = S.multi_ref_stats(preds, rows, "k", "h", "r", "i")
    got = close.select(S.brevity("close_len", "hyp_len").alias("b")).first()["b"]
    assert got == pytest.approx(want, abs=1e-4)


def test_many_references_of_one_row_meet_by_gram(spark):
    preds = spark.createDataFrame([(1, "a a b".split())], "k int, h array<string>")
    refs = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "a", "c"]), (1, 2, ["b"])],
                                 "k int, i int, r array<string>")
    got = S.multi_ref_stats(preds, refs, "k", "h", "r", "i").first()
    assert (got["m1"], got["h1"], got["m2"], got["h2"], got["ref_len"], got["close_len"]) == (3, 3, 1, 2, 1, 3)


def brute(h, r, s, n):
    def grams(t):
        return collections.Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))

    gh, gr, gs = grams(h), grams(r), grams(s)
    stale = collections.Counter({g: c for g, c in gs.items() if g not in gr})
    both = sum((gh & gr).values())
    return both, max(both - sum((gh & stale).values()), 0)


def test_row_statistics_against_counters(spark):
    rng = random.Random(7)
    rows = [(i, *[[rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(3)])
            for i in range(120)]
    df = spark.createDataFrame(rows, "k int, h array<string>, r array<string>, s array<string>")
    pair = {x["k"]: x for x in S.pair_stats(df, ["k"], "h", "r").collect()}
    edit = {x["k"]: x for x in S.gleu_stats(df, ["k"], "s", "h", "r").collect()}
    for k, h, r, s in rows:
        for n in S.ORDERS:
            both, net = brute(h, r, s, n)
            assert pair[k][f"m{n}"] == both and edit[k][f"g{n}"] == net
            assert pair[k][f"h{n}"] == max(len(h) - n + 1, 0) == edit[k][f"d{n}"]


def test_statistics_need_no_shuffle(spark):
    df = spark.range(5).select(F.col("id").alias("k"), F.array(F.lit("a")).alias("h"))
    plan = S.pair_stats(df, ["k"], "h", "h")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=4, max_size=12), min_size=1, max_size=4))
def test_identical_sides_score_one(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t array<string>")
    assert S.corpus_bleu(df, "k", "t", "t").first()["bleu"] == pytest.approx(1.0)
    assert S.gleu(df, "k", "t", "t", "t").first()["gleu"] == pytest.approx(1.0)


def test_empty_hypothesis(spark):
    df = spark.createDataFrame([(1, [], ["a"])], "k int, h array<string>, r array<string>")
    assert S.corpus_bleu(df, "k", "h", "r").first()["bleu"] == 0.0


def test_composite_with_missing_part_is_null(spark):
    one_row = spark.createDataFrame([(0.5,)], "score double")
    parts = {"a": one_row, "b": one_row.withColumn("score", F.lit(None).cast("double"))}
    assert S.composite(parts, {"a": 0.5, "b": 0.5}).first()["composite"] is None


def test_row_statistics_of_long_repetitive_sides_are_not_quadratic(spark):
    """Every n-gram twice on both sides: looking each repeat up in a list of all n-grams took minutes."""
    df = spark.range(1).select(F.col("id").alias("k"), F.transform(
        F.sequence(F.lit(0), F.lit(119999)), lambda i: (i % 60000).cast("string")).alias("h"))
    start = time.time()
    got = S.gleu_stats(df.withColumn("s", F.slice("h", 1, 7)).withColumn("r", F.slice("h", 60000, 10)), ["k"], "h", "h", "r").first()
    assert got["hyp_len"] == 120000 and got["g1"] == 0 and got["d4"] == 119997
    assert time.time() - start < 30


def test_row_statistics_are_counted_in_batches(spark):
    df = spark.range(3).select(F.col("id").alias("k"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("h"))
    for stats in (S.pair_stats(df, ["k"], "h", "h", ["a"]), S.gleu_stats(df, ["k"], "h", "h", "h")):
        assert "ArrowEvalPython" in stats._jdf.queryExecution().executedPlan().toString()
    assert {(r["m1"], r["m2"], round(r["wm"], 6), round(r["wr"], 6)) for r in S.pair_stats(df, ["k"], "h", "h", ["a"]).collect()} == {
        (3, 2, 2.2, 2.2)}


def test_features_and_edges_meet_inside_their_row(spark):
    """One row per text: no exploded feature or edge is shuffled, whatever a text repeats."""
    rows = [(1, "x", "ref", ["a", "a", "b", "c"]), (1, "x", "cand", ["a", "c", "d"]), (2, "x", "ref", ["a"]), (None, "y", "ref", ["a"]),
            (None, "y", "cand", ["a"])]
    df = spark.createDataFrame(rows, "k int, lang string, side string, sigs array<string>")
    got = {r["lang"]: (r["matched"], r["total"]) for r in S.structure_match(df, "k", "side", "sigs", "lang").collect()}
    assert got == {"x": (3, 5), "y": (1, 1)}
    assert [tuple(r) for r in S.containment(df, "k", "side", "sigs", "lang").collect()] == [("x", 3)]

    edge = "array<struct<pos int, name string, rel string, parents array<string>>>".replace(" int", ":int").replace(
        " string", ":string").replace(" array", ":array")
    flow = spark.createDataFrame([(1, "ref", [(0, "u", "r", []), (1, "v", "r", ["u"]), (2, "u", "r", ["v"])]),
                                  (1, "cand", [(0, "p", "r", []), (1, "q", "r", ["p"]), (2, "q", "s", ["p"])])],
                                 f"k int, side string, edges {edge}")
    assert tuple(S.flow_match(flow, "k", "side").first())[:2] == (2, 3)
    assert tuple(S.flow_match(flow.where("side = 'cand'"), "k", "side").first()) == (0, 0, 0.0)
