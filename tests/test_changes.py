"""Scripts, hunks, states, merges and anchors on small literal rows."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from diffloom.functions.lex import word_length
from diffloom.functions.masks import span_noise_mask
from diffloom.functions.patch import strip_comments_keep_literals
from diffloom.operators.anchors import anchor_edits
from diffloom.catalog.base import next_in_order
from diffloom.operators.hunks import budget_groups, budget_rejects, expand_states, extract_hunks
from diffloom.operators.nodes import merge_short_edits
from diffloom.operators.scripts import edit_streams, payload, replay, with_script
from diffloom.plans.selection import early_stop
from diffloom.operators.ranking import running


def commits(spark, *pairs):
    return spark.createDataFrame([(str(i), "r", "m", a, b) for i, (a, b) in enumerate(pairs)],
                                 "commit string, repos string, msg string, old_contents string, new_contents string")


def random_lines(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "", "x = 1;"]) + str(rng.randint(0, 4)) for _ in range(n)]


def anchored(a, b):
    """Plain restatement of the anchored edits: (i1, i2, j1, j2) of what differs."""
    na, nb = collections.Counter(a), collections.Counter(b)
    pairs = [(i, b.index(x)) for i, x in enumerate(a) if na[x] == 1 and nb[x] == 1]
    keep = [(i, j) for i, j in pairs if all((x < i) == (y < j) for x, y in pairs if x != i)]
    out, i0, j0 = [], 0, 0
    for i, j in keep + [(len(a), len(b))]:
        x, y = a[i0:i], b[j0:j]
        p = 0
        while p < min(len(x), len(y)) and x[p] == y[p]:
            p += 1
        s = 0
        while s < min(len(x), len(y)) - p and x[-1 - s] == y[-1 - s]:
            s += 1
        if p + s < max(len(x), len(y)):
            out.append((i0 + p, i - s, j0 + p, j - s))
        i0, j0 = i + 1, j + 1
    return out


def opcodes(a, b):
    out, i, j = [], 0, 0
    for i1, i2, j1, j2 in anchored(a, b) + [(len(a), len(a), len(b), len(b))]:
        if i < i1:
            out.append(("equal", i, i1, j, j1))
        if i1 < i2 or j1 < j2:
            out.append(("replace" if i1 < i2 and j1 < j2 else "delete" if i1 < i2 else "insert", i1, i2, j1, j2))
        i, j = i2, j2
    return out


def cut_hunks(a, b, context=3):
    groups = []
    for e in anchored(a, b):
        if groups and e[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])
    out = []
    for g in groups:
        ls, at = [], max(0, g[0][0] - context)
        for i1, i2, j1, j2 in g:
            ls += [" " + x for x in a[at:i1]] + ["-" + x for x in a[i1:i2]] + ["+" + x for x in b[j1:j2]]
            at = i2
        out.append("\n".join(ls + [" " + x for x in a[at:at + context]]))
    return out


def test_hunks_of_the_anchored_diff(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(40):
        a = random_lines(rng, rng.randint(0, 40))
        b = [x for x in a if rng.random() > 0.15] + random_lines(rng, rng.randint(0, 3))
        pairs.append(("\n".join(a), "\r\n".join(b)))
    pairs += [("a\nb\nc", "a\nB\nc"), ("same\ntext", "same\ntext"), ("", "x")]
    got = {r["commit"]: r["hunks"] for r in extract_hunks(commits(spark, *pairs)).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[str(i)] == cut_hunks(a.splitlines(), b.splitlines())


def test_scripts_equal_the_restatement_and_replay(spark):
    rng = random.Random(5)
    words = "abcdefghijklmnopqrstuvwxyz"
    rows = [([rng.choice(words[:k]) for _ in range(rng.randint(0, 40))],
             [rng.choice(words[:k]) for _ in range(rng.randint(0, 40))]) for k in (2, 6, 26) for _ in range(40)]
    rows += [(list(words), list(words[:3] + "?" + words[5:] + "!")), (list(words), list(words)[::-1])]
    df = with_script(spark.createDataFrame(rows, "a array<string>, b array<string>"), "a", "b")
    for r in df.select("a", "b", "ops", replay("a", payload("b", "ops"), "ops").alias("r")).collect():
        assert [tuple(o) for o in r["ops"]] == opcodes(r["a"], r["b"])
        assert r["r"]["tokens"] == r["b"] and r["r"]["tiles"]


def test_a_long_row_with_many_edits(spark):
    """200,000 tokens and 20,000 edits: linear up to a sort, replay included."""
    df = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: i.cast("string")).alias("a"),
        F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: F.when(i % 10 == 5, F.concat(F.lit("new"), i)).otherwise(i.cast("string"))).alias("b"))
    start = time.time()
    r = with_script(df, "a", "b").select(F.size("ops").alias("n"), (replay("a", payload("b", "ops"), "ops")["tokens"] == F.col("b")).alias("same")).first()
    assert (r["n"], r["same"]) == (40_001, True)
    assert time.time() - start < 90


def test_hunks_left_out_of_budget_groups_are_rejects(spark):
    hunks = ["a b", "a b c d e f g h i j", "a b c", "a", "b c"]
    df = spark.createDataFrame([("k", hunks), ("one", ["a b c d e f g h"]), ("none", [])], "commit string, hunks array<string>")
    kept = {r["commit"]: sum(map(len, r["g"])) for r in df.select("commit", budget_groups("hunks", word_length, 6).alias("g")).collect()}
    gone = collections.Counter((r["commit"], r["reason"]) for r in budget_rejects(df, word_length, 6).collect())
    assert gone == {("k", "over budget"): 1}
    assert kept["k"] + 1 == len(hunks) and kept["one"] == 1
    odd = spark.createDataFrame([("k", ["a b c", "d e f", "g h i"])], "commit string, hunks array<string>")
    assert [(r["hunk_idx"], r["reason"]) for r in budget_rejects(odd, word_length, 6).collect()] == [(2, "odd tail")]


def test_anchor_needs_a_context_longer_than_any_fixed_bound(spark):
    a = ["x"] * 3000 + ["y"] + ["x"] * 3000
    ops = [("equal", 0, 3000, 0, 3000), ("delete", 3000, 3001, 3000, 3000), ("equal", 3001, 5000, 3000, 4999),
           ("delete", 5000, 5001, 4999, 4999), ("equal", 5001, 6001, 4999, 5999)]
    df = spark.createDataFrame([(1, a, [], ops)], "k int, a array<string>, b array<string>, "
                               "ops array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>")
    got = {r["edit"]: (r["anchor"], r["context"]) for r in anchor_edits(df, "a", "b", "ops", "k").collect()}
    assert got == {1: ("self", 0), 3: ("full", 0)}
    wide = [("equal", 0, 5000, 0, 5000), ("delete", 5000, 5001, 5000, 5000), ("equal", 5001, 6001, 5000, 6000)]
    df = spark.createDataFrame([(1, a, [], wide)], df.schema)
    assert [(r["anchor"], r["context"]) for r in anchor_edits(df, "a", "b", "ops", "k").collect()] == [("before", 2000)]


@pytest.mark.parametrize("block", [2, 1024])
def test_next_turn_with_gaps_and_long_conversations(spark, block):
    turns = [("c", t) for t in range(0, 5000, 2) if t not in (4, 6, 8)] + [("d", 0), ("e", 1000), ("e", 9)]
    df = spark.createDataFrame([(c, t, f"{c}{t}") for c, t in turns], "conv_id string, turn int, text string")
    got = {(r["conv_id"], r["turn"]): r["gold"] for r in next_in_order(df, "conv_id", "turn", "text", "gold", block).collect()}
    want = {}
    for c in "cde":
        own = sorted(t for x, t in turns if x == c)
        want |= {(c, t): f"{c}{n}" if n is not None else None for t, n in zip(own, own[1:] + [None])}
    assert got == want


def test_three_hunks_give_three_states(spark):
    a = [str(i) for i in range(1, 31)]
    b = [x + "!" if x in ("3", "15", "27") else x for x in a]
    rows = expand_states(extract_hunks(commits(spark, ("\n".join(a), "\n".join(b)))).select(
        "commit", "repos", "msg", "hunks"), word_length).orderBy("state_idx").collect()
    assert [(r["state_idx"], r["state_cnt"]) for r in rows] == [(0, 3), (1, 3), (2, 3)]
    assert [r["old"].count("!") for r in rows] == [0, 1, 2] and {r["new"].count("!") for r in rows} == {3}


def test_streams(spark):
    df = with_script(spark.createDataFrame([("x y z".split(), "x q z".split())],
                                            "a array<string>, b array<string>"), "a", "b")
    s = df.select(edit_streams("a", "b", "ops").alias("s"), edit_streams("a", "b", "ops", True).alias("m")).first()
    assert s["s"]["commands"] == ["<KEEP>", "<REPLACE_OLD>", "<REPLACE_NEW>", "q", "<KEEP>"]
    assert s["m"]["spans"] == ["<REPLACE_OLD>", "y", "<REPLACE_NEW>", "q", "<REPLACE_END>"]


def merged_by_walking(ops):
    """Plain restatement: glue short nodes, then neighbouring edits."""
    def is_short(op):
        tag, i1, i2, j1, j2 = op
        return tag != "replace" and max(i2 - i1, j2 - j1) == 1

    groups, k = [], 0
    while k < len(ops):
        end = k
        while end < len(ops) and is_short(ops[end]):
            end += 1
        if end - k == 1 and end < len(ops):
            groups.append(ops[k:end + 1])
            k = end + 1
        elif end - k == 1 and groups:
            groups[-1] = groups[-1] + ops[k:end]
            k = end
        elif end > k:
            groups.append(ops[k:end])
            k = end
        else:
            groups.append([ops[k]])
            k += 1
    out = []
    for g in groups:
        kept = len(g) == 1 and g[0][0] == "equal"
        node = ["equal" if kept else "replace", g[0][1], g[-1][2], g[0][3], g[-1][4]]
        if out and not kept and out[-1][0] == "replace":
            out[-1][2], out[-1][4] = node[2], node[4]
        else:
            out.append(node)
    return [tuple(x) for x in out]


def test_merge_short_edits(spark):
    rng = random.Random(11)
    rows = [([rng.choice("abcd") for _ in range(rng.randint(0, 25))],
             [rng.choice("abcd") for _ in range(rng.randint(0, 25))]) for _ in range(150)]
    df = with_script(spark.createDataFrame(rows, "a array<string>, b array<string>"), "a", "b")
    for r in df.select("ops", merge_short_edits("ops").alias("m")).collect():
        assert [tuple(x) for x in r["m"]] == merged_by_walking([tuple(x) for x in r["ops"]])


def test_anchors_are_least_and_unique(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice("abc") for _ in range(30)], [rng.choice("abc") for _ in range(30)]) for i in range(40)]
    df = with_script(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), "a", "b")
    ops = {r["k"]: [tuple(o) for o in r["ops"]] for r in df.collect()}

    def count(a, phrase):
        n = len(phrase)
        return sum(a[p:p + n] == phrase for p in range(len(a) - n + 1)) if n else 0

    for r in anchor_edits(df, "a", "b", "ops", "k").collect():
        a, script, e = rows[r["k"]][1], ops[r["k"]], r["edit"]
        _, i1, i2, _, _ = script[e]

        def room(x):
            return script[x][2] - script[x][1] if 0 <= x < len(script) and script[x][0] == "equal" else 0

        want = ("self", 0) if count(a, a[i1:i2]) == 1 else None
        for name, limit, phrase in (("before", room(e - 1), lambda k: a[i1 - k:i2]),
                                    ("after", room(e + 1), lambda k: a[i1:i2 + k])):
            if want is None:
                hits = [k for k in range(1, limit + 1) if count(a, phrase(k)) == 1]
                want = (name, hits[0]) if hits else None
        assert (r["anchor"], r["context"]) == (want or ("full", 0))


def test_noise_mask_totals(spark):
    df = spark.range(1, 400).select("id", span_noise_mask(F.col("id"), 0.3, "t", "id").alias("m"))
    for r in df.collect():
        n, m = r["id"], r["m"]
        mean = max(int(n * 0.3 // 2.5), 1)
        total = min(max(round(2.5 * mean), 1), max(int(n / 1.5), 1))
        spans = max(round(total / mean), 1)
        assert len(m) == n
        if n - total >= spans and total >= spans:
            runs = sum(x == 1 and (i == 0 or m[i - 1] == 0) for i, x in enumerate(m))
            assert sum(m) == total and runs == spans and m[0] == 0
        else:
            assert sum(m) == 0


def test_comments_in_literals_stay(spark):
    df = spark.createDataFrame([('s = "// no"; // yes\n/* a\nb */\nx',)], "c string")
    assert df.select(strip_comments_keep_literals("c")).first()[0] == 's = "// no";  \nx'


SCORES = [179.92, 183.13, 185.55, 186.19, 186.18, 186.10, 186.63, 186.42, 186.22, 187.30, 185.80, 187.13, 187.02, 187.16]


def test_early_stop_replays_a_recorded_log(spark):
    log = spark.createDataFrame([("r", i, s) for i, s in enumerate(SCORES)], "run string, epoch int, score double")
    r = early_stop(log).first()
    assert (r["best_epoch"], r["best_score"], r["stop_epoch"]) == (9, 187.30, 13)


@pytest.mark.parametrize("block", [1, 3, 100])
def test_running_values_across_blocks(spark, block):
    rng = random.Random(1)
    rows = [(run, i, float(rng.randint(0, 99))) for run in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "run string, step int, v double")
    got = {(r["run"], r["step"]): r for r in running(
        df, "run", "step", {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))}, include_current=True, block=block).collect()}
    for run in "ab":
        vals = [v for r, _, v in rows if r == run]
        for i in range(20):
            assert got[run, i]["m"] == max(vals[:i + 1]) and got[run, i]["s"] == sum(vals[:i + 1])
