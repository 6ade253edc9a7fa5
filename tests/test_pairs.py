"""Edits of pairs in numpy against the standard library's matcher and a restatement."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators import blocks, pairs, suffixes
from diffloom.operators.blocks import with_block_script
from diffloom.operators.grams import gram_counts
from diffloom.operators.scripts import with_script
from diffloom.operators.vocabulary import decode, lookup_ids
from test_blocks import sides
from test_changes import opcodes

SCHEMA = "k int, a array<string>, b array<string>"


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = [(k, *sides(rng)) for k in range(n)]
    return rows + [(n, None, ["a"]), (n + 1, ["a"], None), (n + 2, [], []), (n + 3, ["x"], []), (n + 4, [], ["x"])]


@pytest.mark.parametrize("tokens,equal", [(1 << 18, 1 << 21), (300, 2000), (1, 1)])
def test_runs_of_rows_do_not_change_edits(monkeypatch, tokens, equal):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "TOKENS", tokens)
    monkeypatch.setattr(pairs, "EQUAL", equal)
    rows = rows_of(tokens, 150)
    a, b = (pa.array([r[c] for r in rows], pa.list_(pa.string())) for c in (1, 2))
    by_blocks, by_anchors = pairs.edits_by_blocks.func(a, b).to_pylist(), pairs.edits_by_anchors.func(a, b).to_pylist()
    for (_, x, y), one, other in zip(rows, by_blocks, by_anchors):
        if x is None or y is None:
            assert one is None and other is None
            continue
        assert [tuple(e.values()) for e in other] == [o[1:] for o in opcodes(x, y) if o[0] != "equal"]
        if one is None:
            assert equal < 1 << 21
        else:
            assert [tuple(e.values()) for e in one] == [o[1:] for o in difflib.SequenceMatcher(None, x, y).get_opcodes() if o[0] != "equal"]


def test_pairs_with_too_many_equal_tokens_are_split_as_jobs(spark, monkeypatch):
    """Both ways give the same; which one a pair takes is told by its equal tokens."""
    seen = []
    monkeypatch.setattr(blocks, "split_blocks", lambda s, whole=blocks.split_blocks: seen.append(s.count()) or whole(s))
    many = int((pairs.EQUAL / 100) ** 0.5) + 2
    x = [str(k % 100) for k in range(100 * many)]  # 1 % of the side each: none is popular
    rows = rows_of(8, 20) + [(99, x, x[:5] + ["new"] + x[5:])]
    got = {r.k: r.ops and [tuple(o) for o in r.ops] for r in with_block_script(spark.createDataFrame(rows, SCHEMA), "a", "b").collect()}
    assert seen == [1]
    for k, a, b in rows:
        assert got[k] == (None if a is None or b is None else difflib.SequenceMatcher(None, a, b).get_opcodes())


def test_block_scripts_write_no_row_per_equal_token(spark, monkeypatch):
    """What is written to the shared folder is one row a pair."""
    written = []
    monkeypatch.setattr(blocks, "materialize", lambda df, name, whole=blocks.materialize: written.append(out := whole(df, name)) or out)
    rows = [(k, [f"w{i % 50}" for i in range(150)], [f"w{i * 7 % 50}" for i in range(150 - k)]) for k in range(20)]
    with_block_script(spark.createDataFrame(rows, SCHEMA), "a", "b").collect()
    assert [w.count() for w in written] == [20]


def test_anchored_scripts_sort_nothing_in_expressions(spark):
    rows = rows_of(4, 30)
    df = with_script(spark.createDataFrame(rows, SCHEMA), "a", "b")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "array_sort" not in plan
    for r in df.withColumn("old", F.size("a")).collect():
        assert (r.ops and [tuple(o) for o in r.ops]) == (None if r.a is None or r.b is None else opcodes(r.a, r.b))


def test_grams_of_rows_that_share_a_key(spark):
    """Grams are counted per key: rows that share one are summed, rows of a null key too."""
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(30)]), [rng.choice("abc") for _ in range(rng.randint(0, 9))], rng.choice([None, ["a", "b"]])) for _ in range(60)]
    want = {}
    for k, *texts in rows:
        for side, t in enumerate(texts):
            want.setdefault((k, 0, ""), [0, 0])[side] += len(t or [])
            for n in (1, 2, 3):
                for i in range(len(t or []) - n + 1):
                    want.setdefault((k, n, "\x1f".join(t[i:i + n])), [0, 0])[side] += 1
    df = gram_counts(spark.createDataFrame(rows, SCHEMA).repartition(5), ["k"], {"a": "a", "b": "b"}, 3)
    got = df.collect()
    found = {(r.k, r.n, r.gram): [r.a, r.b] for r in got}
    assert len(got) == len(found) and found == want
    # Rows per gram come counted from their batch.
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()


def test_ids_and_tokens_of_rows_that_share_a_key(spark):
    rows = [(1, ["a", "b", "x"]), (2, None), (3, ["b", "zz", None, "a"]), (1, ["b", "a"]), (None, ["a"]), (4, [])]
    vocab = spark.createDataFrame([("<unk>", 0), ("</s>", 1), ("a", 2), ("b", 3)], "token string, id int")
    df = spark.createDataFrame(rows, "k int, t array<string>")
    ids = lookup_ids(df, "k", "t", vocab, ["<unk>", "</s>"])
    assert "Generate" not in ids._jdf.queryExecution().executedPlan().toString()  # no row per token
    assert {r.k: r.ids for r in ids.collect()} == {1: [2, 3, 2, 3, 0, 1], 2: [1], 3: [3, 0, 2, 1], None: [2, 1], 4: [1]}
    assert {r.k: r.tokens for r in decode(ids, "k", "ids", vocab, ["<unk>", "</s>"]).collect()} == {
        1: ["a", "b", "a", "b"], 2: [], 3: ["b", "a"], None: ["a"], 4: []}
