"""Longest-matching-block scripts against the standard library's matcher."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from diffloom.operators import blocks
from diffloom.operators.blocks import block_hunks, with_block_script


def sides(rng):
    vocab = [f"w{x}" for x in range(40)] if rng.random() < 0.5 else list("abcdefgh"[:rng.randint(1, 8)])
    a = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 30, 120, 260, 400]))]
    if rng.random() < 0.2:
        return a, [rng.choice(vocab) for _ in range(rng.choice([0, 3, 250]))]
    b = list(a)
    for _ in range(rng.randint(0, 12)):
        if b and rng.random() < 0.5:
            del b[rng.randrange(len(b))]
        else:
            b.insert(rng.randint(0, len(b)), rng.choice(vocab))
    return a, b


@pytest.mark.parametrize("rounds", [1, 4])
def test_block_script(spark, monkeypatch, rounds):
    monkeypatch.setattr(blocks, "ROUNDS", rounds)
    rng = random.Random(rounds)
    rows = [(k, *sides(rng)) for k in range(60 * rounds)]
    rows += [(500, None, ["a"]), (501, ["a"], None), (502, [], []), (503, *rows[7][1:]), (504, ["x"], []), (505, [], ["x"]), (None, *rows[9][1:])]
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {r.k: r.ops and [tuple(o) for o in r.ops] for r in with_block_script(df, "a", "b").collect()}
    assert len(got) == len(rows)
    for k, a, b in rows:
        want = None if a is None or b is None else difflib.SequenceMatcher(None, a, b).get_opcodes()
        assert got[k] == want, k


def test_equal_pairs_are_computed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(blocks, "matching_blocks", lambda s, whole=blocks.matching_blocks: seen.append(s.count()) or whole(s))
    rows = [(k, ["a", "b"], ["b", "c"] if k % 3 else ["b", f"n{k}"]) for k in range(30)]
    got = with_block_script(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), "a", "b")
    assert got.count() == 30 and seen == [11]


def test_block_hunks_are_unified_diffs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(80):
        a = [rng.choice("abcdefghij") * rng.randint(0, 2) for _ in range(rng.randint(0, 60))]
        b = [x for x in a for x in (x, x + "!")[:rng.choice([0, 1, 1, 1, 1, 2])]]
        rows.append((k, "\n".join(a), "\n".join(b)))
    rows += [(100, None, "a"), (101, "", ""), (102, "same", "same")]
    got = {r.k: r.hunks for r in block_hunks(spark.createDataFrame(rows, "k int, old_contents string, new_contents string")).collect()}
    for k, a, b in rows[:-3]:
        want, hunk = [], None
        for line in list(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm=""))[2:]:
            if line.startswith("@@"):
                want.append([])
            else:
                want[-1].append(line)
        assert got[k] == ["\n".join(h) for h in want], k
    assert got[101] == got[102] == [] and not got[100]


def test_matching_runs_know_popular_neighbours(spark):
    a = ["p"] * 5 + ["x"] + ["p"] * 3 + [f"q{i}" for i in range(220)]
    df = spark.createDataFrame([(1, 2, a, a)], "_p long, _q long, a array<string>, b array<string>")
    runs = blocks.matching_runs(df).where(F.col("i") == F.col("j")).orderBy("i").collect()
    assert [(r.i, r.n, r.fi, r.fn) for r in runs] == [(5, 1, 0, len(a)), (9, 220, 0, len(a))]


def test_streams_replay(spark):
    """Against a reading token by token, on streams of any keywords and words."""
    from diffloom.operators.scripts import COMMANDS, replay_commands, replay_tokens
    rng = random.Random(2)
    insert, delete, old_, new_, keep = COMMANDS
    rows = []
    for k in range(200):
        a = [f"t{i}" for i in range(rng.randint(0, 12))]
        rows.append((k, a, [rng.choice([*COMMANDS, "x", "y", "z"]) for _ in range(rng.randint(0, 30))]))
    rows.append((300, None, None))
    df = spark.createDataFrame(rows, "k int, a array<string>, s array<string>")
    got = {r.k: r for r in df.select("k", replay_tokens("s").alias("t"), replay_commands("a", "s").alias("c")).collect()}
    assert got.pop(300)[1:] == (None, None)
    for k, a, s in rows[:-1]:
        state, tokens, commands, at = keep, [], [], 0
        for t in s:
            if t in COMMANDS:
                state = t
            elif state in (insert, new_, keep):
                tokens.append(t)
            if t in (keep, delete, old_):
                if t == keep and at < len(a):
                    commands.append(a[at])
                at += 1
            elif t not in COMMANDS:
                commands.append(t)
        assert (got[k].t, got[k].c) == (tokens, commands), k


def test_metrics_written_twice_count_once(spark, tmp_path):
    from diffloom.sources.writers import append_metrics, compact_metrics, read_metrics
    rows = spark.createDataFrame([("r", 1, "bleu", 0.5), ("r", 1, "em", None), (None, None, None, 1.0)], "run string, epoch int, metric string, value double")
    for batch in ("r-1", "r-2", "r-1"):
        append_metrics(rows, f"{tmp_path}/log", batch)
    append_metrics(rows.limit(0), f"{tmp_path}/log", "r-3")
    compact_metrics(spark, f"{tmp_path}/log", f"{tmp_path}/small")
    for path in ("log", "small"):
        assert sorted(map(str, read_metrics(spark, f"{tmp_path}/{path}").collect())) == sorted(map(str, rows.collect() * 2))


def test_edit_script_query_finds_longest_blocks(spark, tmp_path):
    """Words that repeat leave no anchors; the query's script is the library's all the same."""
    import __spark_entry__ as entry
    from diffloom.catalog.base import changes
    rng = random.Random(4)
    rows = [(k, "\n".join(" ".join(rng.choice("abcd") for _ in range(6)) for _ in range(rng.randint(0, 25))), "en", "s")
            for k in range(40)] + [(100, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in entry.queries()["edit_script"](spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.tag, r.i1, r.i2, r.j1, r.j2))
    for r in changes(spark, str(tmp_path)).where("old_contents IS NOT NULL").collect():
        want = difflib.SequenceMatcher(None, r.old_contents.split(), r.new_contents.split()).get_opcodes()
        assert sorted(got.pop(r.doc_id, []), key=lambda o: o[1:]) == sorted(want, key=lambda o: o[1:]), r.doc_id
    assert not got
