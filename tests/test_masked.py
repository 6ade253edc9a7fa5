"""Drawn masks, sentinels and corrupted tokens in numpy, against plain Python on own rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom.functions.text import BLANK, JVM_BLANK
from diffloom.operators.masked import heads
from diffloom.operators.scripts import anchored_script, trim_script
from diffloom.plans import examples as X

PAIRS = "id long, lang string, nl array<string>, old array<string>, new array<string>"


def draw(*parts):
    return int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:8], 16) / 2 ** 32


def noise(n, share, seed, key):
    mean = max(round((n * share - n * share % 2.5) / 2.5), 1)
    total = min(max(round(2.5 * mean), 1), max(int(n / 1.5), 1))
    spans = max(round(total / mean), 1)
    if n - total < spans or total < spans:
        return [0] * n

    def cuts(size, name):
        picked = sorted(sorted(range(1, size), key=lambda i: (draw(seed + name, key, i), i))[:spans - 1])
        return np.diff([0, *picked, size])

    return [x for k, m in zip(cuts(n - total, "-keep"), cuts(total, "-noise")) for x in [0] * k + [1] * m]


def collapse(tokens, mask):
    out, rank = [], 0
    for i, (t, m) in enumerate(zip(tokens, mask)):
        if m and not (i and mask[i - 1]):
            rank += 1
            out += [f"<extra_id_{rank - 1}>"] if rank <= 99 else []
        elif not m:
            out.append(t)
    return [t for t in out if t is not None]


def message(n, seed, key):
    return noise(n, 0.2, seed, key) if n > 5 else [0] * n


def framed(r):
    return ["<msg>", *r["nl"], None if r["lang"] is None else f"<{r['lang']}>", *r["old"]]


def sides(r, kept):
    return [int((op["tag"] == "equal") == kept) for op in r["ops"] for _ in range(op["i1"], op["i2"])]


def keep_span(r, seed, compat):
    flags, left = sides(r, True), iter(noise(sum(sides(r, True)), 0.3, seed, r["id"]))
    mask, nl = [next(left) if f else 0 for f in flags], message(len(r["nl"]), seed + "-nl", r["id"])
    if not compat:
        return collapse(framed(r), [0, *nl, 0, *mask])
    n = len(collapse(r["old"], mask))
    return collapse(framed(r)[:2 + len(nl) + n], [0, *nl, 0, *[0] * n])


def edit_content(r, seed, compat):
    changed = [i for i, f in enumerate(sides(r, False)) if f]
    if compat:
        stop = next((k for k in range(len(changed)) if draw(seed, r["id"], k + 1) >= 0.5), len(changed))
        hit = set(changed[:stop])
    else:
        hit = {i for i in changed if draw(seed, r["id"], i + 1) < 0.5}
    return collapse(framed(r), [0, *message(len(r["nl"]), seed + "-nl", r["id"]), 0, *[int(i in hit) for i in range(len(r["old"]))]])


def corrupted(r, seed, replace):
    out, rank = [], 0
    for i, t in enumerate(r["old"]):
        u = draw(seed, r["id"], i + 1)
        if u < 0.495:
            continue
        if u < 0.71 or replace:
            rank += 1
        marked = rank <= 99 and (u < 0.71 or replace)
        out += ([f"<extra_id_{rank - 1}>"] if marked else []) + ([] if marked and u >= 0.71 else [t])
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(60):
        n = rng.choice([0, 1, 3, 7, 40, 400, 1500])
        old = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n)]
        new = [t + "x" if rng.random() < 0.1 else t for t in old if rng.random() < 0.9] + ["z"] * rng.randrange(3)
        data.append((rng.choice([i, i, None, 10 ** 17]), rng.choice(["en", None]), ["m"] * rng.randrange(30), old, new))
    return spark.createDataFrame(data, PAIRS).withColumn("ops", anchored_script("old", "new")).cache()


@pytest.mark.parametrize("seed", ["s", "a seed that is longer than one block of a digest holds"])
def test_examples_follow_their_draws(rows, seed):
    pair = ("nl", "lang", "old", "new")
    built = rows.select(
        "*", X.keep_span_example(*pair, "ops", seed, "id", batched=True).alias("keep"),
        X.keep_span_example(*pair, "ops", seed, "id", compat=True, batched=True).alias("keep_compat"),
        X.edit_content_example(*pair, "ops", seed, "id", batched=True).alias("edit"),
        X.edit_content_example(*pair, "ops", seed, "id", compat=True, batched=True).alias("edit_compat"),
        X.corrupt_tokens("old", seed, "id", batched=True).alias("corrupt"),
        X.corrupt_tokens("old", seed, "id", replace=True, batched=True).alias("corrupt_replace")).collect()
    for r in built:
        assert r["keep"]["input"] == keep_span(r, seed, False)
        assert r["keep_compat"]["input"] == keep_span(r, seed, True)
        assert r["edit"]["input"] == edit_content(r, seed, False)
        assert r["edit_compat"]["input"] == edit_content(r, seed, True)
        assert r["corrupt"] == corrupted(r, seed, False)
        assert r["corrupt_replace"] == corrupted(r, seed, True)


def test_draws_are_not_made_token_by_token(rows):
    pair = ("nl", "lang", "old", "new")
    for e in (X.keep_span_example(*pair, "ops", "s", "id", compat=True, batched=True),
              X.edit_content_example(*pair, "ops", "s", "id", compat=True, batched=True), X.corrupted_example(*pair, "s", "id", True, batched=True)):
        plan = rows.select(e.alias("e"))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "md5(" not in plan and "array_position(" not in plan


def test_null_sides_give_null_examples(spark):
    df = spark.createDataFrame([(1, "en", None, None, None)], PAIRS).withColumn("ops", trim_script("old", "new"))
    pair = ("nl", "lang", "old", "new")
    r = df.select(X.keep_span_example(*pair, "ops", "s", "id", compat=True, batched=True).alias("a"),
                  X.edit_content_example(*pair, "ops", "s", "id", compat=True, batched=True).alias("b"),
                  X.corrupted_example(*pair, "s", "id", True, batched=True).alias("c")).first()
    assert r["a"]["input"] is r["b"]["input"] is r["c"]["input"] is None


def test_digests_of_every_prefix_length_and_number():
    rng = np.random.default_rng(1)
    prefixes = [b"p" * n + b"|" for n in range(70)]
    row, k = rng.integers(0, 70, 5000), rng.integers(0, 30_000_000, 5000)
    k[:4000] %= 100_000
    k[:2000] %= 200
    want = [int(hashlib.md5(prefixes[r] + b"%d" % i).hexdigest()[:8], 16) for r, i in zip(row, k)]
    assert heads(prefixes, row, k).tolist() == want


def test_both_patterns_know_the_same_blanks(spark):
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    df = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(c.alias("c"))
    assert df.where(F.col("c").rlike(BLANK) != F.col("c").rlike(JVM_BLANK)).count() == 0
    assert df.where(F.col("c").rlike(JVM_BLANK)).count() == 29
