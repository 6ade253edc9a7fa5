"""Suffix ranks against plain counting, and on long repetitive texts."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from diffloom.operators import suffixes
from diffloom.operators.anchors import anchor_edits, find_phrase, positions


def occurrences(tokens, phrase):
    m = len(phrase)
    return [i for i in range(len(tokens) - m + 1) if tokens[i:i + m] == phrase] if m else []


def drawn_rows(count, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        tokens = [rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.choice([0, 1, 2, 7, 40, 60]))]
        if k % 5 == 0:
            tokens += tokens
        rows.append((k, tokens))
    return rows


def test_least_unique_lengths(spark):
    rows = drawn_rows(150, 3) + [(150, None), (151, [None, "a", None, "a", "a"]), (152, ["x"] * 60)]
    df = spark.createDataFrame(rows, "k int, a array<string>")
    starts, ends = suffixes.unique_lengths("a")
    for r in df.select("a", starts.alias("s"), ends.alias("e")).collect():
        a = r["a"]
        if a is None:
            assert r["s"] is None and r["e"] is None
            continue
        n = len(a)
        assert len(r["s"]) == len(r["e"]) == n + 1
        for i in range(n + 1):
            forth = [m for m in range(1, n - i + 1) if len(occurrences(a, a[i:i + m])) == 1]
            back = [m for m in range(1, i + 1) if len(occurrences(a, a[i - m:i])) == 1]
            assert r["s"][i] == (forth[0] if forth else n - i + 1)
            assert r["e"][i] == (back[0] if back else i + 1)


def test_rows_of_a_run_do_not_meet(monkeypatch):
    """The same answers however many rows are ranked together."""
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 5, 30]) for _ in range(60)]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.array([rng.randrange(3) for _ in range(offsets[-1])])
    alone = [suffixes.least_unique(codes[a:b], np.array([0, b - a])) for a, b in zip(offsets, offsets[1:])]
    assert (suffixes.least_unique(codes, offsets) == np.concatenate(alone)).all()
    for size in (1, 7, 100):
        monkeypatch.setattr(suffixes, "TOKENS", size)
        runs = list(suffixes._runs(offsets))
        assert runs[0][0] == 0 and runs[-1][1] == len(sizes)
        assert all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_positions(spark):
    rng = random.Random(8)
    rows = []
    for k, tokens in drawn_rows(200, 9):
        at, m = rng.randint(0, max(len(tokens) - 1, 0)), rng.choice([0, 1, 2, 3, 5, 8, 17])
        rows.append((k, tokens, tokens[at:at + m] if k % 4 else [rng.choice("abz") for _ in range(m)]))
    rows += [(900, None, ["a"]), (901, ["a"], None), (902, ["a", None, "b", None, "b"], [None, "b"]), (903, [], [])]
    df = spark.createDataFrame(rows, "k int, a array<string>, p array<string>").coalesce(2)
    got = df.select("k", positions("p", "a").alias("at"), find_phrase("p", "a").alias("f")).collect()
    for (k, a, p), r in zip(sorted(rows, key=lambda x: x[0]), sorted(got, key=lambda x: x["k"])):
        want = occurrences(a or [], p or []) if a is not None and p is not None else []
        assert r["at"] == want
        first = 0 if p == [] else want[0] if want else -1
        assert tuple(r["f"]) == (first, len(want), len(want) > 1)
    assert df.where("false").select(positions("p", "a").alias("at")).collect() == []


def test_many_edits_in_a_long_repetitive_text(spark):
    """200,000 tokens of a period of 1,000 with 20,000 edits: seconds, not edits times text."""
    n = 200_000
    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 7919 == 0, F.concat(F.lit("mark"), i)).otherwise((i % 1000).cast("string"))).alias("a"),
        F.transform(F.sequence(F.lit(0), F.lit(2 * n // 10 - 1)), lambda i: F.struct(
            F.when(i % 2 == 0, "equal").otherwise("delete").alias("tag"),
            (F.floor(i / 2) * 10 + F.when(i % 2 == 0, 0).otherwise(9)).cast("int").alias("i1"),
            (F.floor(i / 2) * 10 + F.when(i % 2 == 0, 9).otherwise(10)).cast("int").alias("i2"),
            F.lit(0).alias("j1"), F.lit(0).alias("j2"))).alias("ops"))
    begun = time.time()
    kinds = {r["anchor"]: r["count"] for r in anchor_edits(df, "a", "a", "ops").groupBy("anchor").count().collect()}
    assert sum(kinds.values()) == n // 10 and kinds["full"] > kinds["before"] > 0
    phrase = F.transform(F.sequence(F.lit(1), F.lit(900)), lambda i: i.cast("string"))
    assert 0 < df.select(find_phrase(phrase, "a").alias("f")).first()["f"]["freq"] < n // 1000
    assert time.time() - begun < 60
