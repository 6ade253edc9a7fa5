"""Importance resampling, automata dedup and hard negatives: against brute force, and in every odd case."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffloom.llm import automata_dedup, bytes_np, hard_negatives, importance
from test_operators import docs, odd_rows, order, prose, words

# --- importance resampling ----------------------------------------------------------

TARGET = "text string, item_id string, _id long"


def features(text, longest=2):
    w = words(text)
    return [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def expected_draw(rows, target, percent, min_words):
    corpus, wanted = [0] * 10_000, [0] * 10_000
    for _, text, *_ in rows:
        for f in features(text):
            corpus[zlib.crc32(f.encode()) % 10_000] += 1
    for text in target:
        for f in features(text):
            wanted[zlib.crc32(f.encode()) % 10_000] += 1
    s_all, t_all = sum(corpus), sum(wanted)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(corpus, wanted)]
    out = []
    for i, text, *_ in rows:
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], order(r[0]), r[2], r[3]))
    take = len(able) * percent // 100
    ranked = [(*r, k + 1 if k < take else None) for k, r in enumerate(able)]
    return sorted(ranked + [(*r, None) for r in out if r[1] < min_words], key=repr)


@pytest.mark.parametrize("percent", [25, 100])
def test_resample(spark, percent):
    rows = odd_rows()
    target = [rows[4][1][:200], None, "", "One  word-and another"]
    t = spark.createDataFrame([(x, "i", 1) for x in target], TARGET)
    got = importance.resample(docs(spark, rows).repartition(5), t, percent=percent)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected_draw(rows, target, percent, 20)
    chosen = importance.drawn(docs(spark, rows), got)
    assert chosen.columns == docs(spark, rows).columns and chosen.count() >= 25 * percent // 100


def test_resample_of_empty_tables(spark):
    none, t = docs(spark, []), spark.createDataFrame([], TARGET)
    assert importance.resample(none, t).collect() == []
    rows = [(1, "only null target " * 10), (2, None)]
    got = importance.resample(docs(spark, rows), t, percent=100)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == expected_draw(rows, [], 100, 20)


@pytest.mark.parametrize("chunk", [1, 7, 50, 1 << 20])
def test_long_texts_are_split_between_words(chunk):
    text = "Aé-b1 ccc  Dd_e\nÀB x" * 9
    for longest in (1, 2, 3):
        found, n = importance.bucket_counts(text.encode(), longest, 97, chunk)
        want = {}
        for f in features(text, longest):
            want[zlib.crc32(f.encode()) % 97] = want.get(zlib.crc32(f.encode()) % 97, 0) + 1
        assert dict(found) == want and n == len(words(text))


# --- automata dedup -----------------------------------------------------------------

def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected_runs(rows, length):
    """{(id, text): (words, removed, kept)}; rows alike are one document."""
    seen, out = set(), {}
    for i, text in rows:
        w, hit = spaced(text), set()
        for s in range(len(w) - length + 1):
            run = tuple(w[s:s + length])
            if run in seen:
                hit.update(range(s, s + length))
            seen.add(run)
        kept = " ".join(x for k, x in enumerate(w) if k not in hit)
        out[i, text] = (len(w), len(hit), hashlib.sha256(kept.encode()).hexdigest())
    return out


def in_corpus_order(spark, rows):
    table = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").distinct()
    return [(r.doc_id, r.text) for r in table.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


def run_rows():
    rng = random.Random(8)
    base, frame = prose(rng, 200).split(), prose(rng, 12)
    rows = odd_rows() + [(100, " ".join(base)), (101, " ".join(base[:90] + ["new"] + base[90:])), (102, " ".join(base[40:75]) + " A\tb\x0bc\x1c" + frame),
                         (103, "same " * 80), (104, ("a b " * 40) + " ".join(base[:25])), (105, " ".join(base[60:100] * 3)),
                         (106, "w" * 200 + " " + " ".join(base[100:130]) + " " + "w" * 200)]
    # One context with many phrases: the same twelve words between others.
    return rows + [(200 + k, f"{prose(rng, 9)} {frame} {prose(rng, 9)}") for k in range(60)]


@pytest.mark.parametrize("length,shard", [(20, 1500), (20, 5), (9, 3), (33, 1500)])
def test_repeated_runs(spark, length, shard):
    rows = run_rows()
    want = expected_runs(in_corpus_order(spark, rows), length)
    got = automata_dedup.remove_repeated_runs(docs(spark, rows).repartition(7), length, with_text=True, shard=shard).collect()
    assert len(got) == len(rows)
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, []).append(v)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) in by_id[r.doc_id]
        assert r.n_removed == sum(y - x for x, y in r.spans) and hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:]))
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *v) for (i, _), v in want.items()}


def test_hot_contexts_are_dealt_by_phrase(spark, monkeypatch):
    monkeypatch.setattr(automata_dedup, "HOT_SHARE", 50)  # 1 / 400 of the phrases is hot
    rows = run_rows()
    hot = automata_dedup.hot_contexts(automata_dedup.with_keys(docs(spark, rows), "doc_id", "text"), 20)
    assert hot.count() > 0
    want = expected_runs(in_corpus_order(spark, rows), 20)
    got = automata_dedup.remove_repeated_runs(docs(spark, rows).repartition(3), 20, shard=10).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == {(i, *v) for (i, _), v in want.items()}


def test_phrases_are_told_hot_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(automata_dedup, "HOT_SHARE", 50)
    plans, write = {}, automata_dedup.materialize

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(automata_dedup, "materialize", seen)
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"{words} a{i} b{i} {words}") for i in range(60)]
    keyed = automata_dedup.with_keys(docs(spark, rows), "doc_id", "text")
    assert automata_dedup.hot_contexts(keyed, 20).count() > 0
    automata_dedup.repeated_runs(keyed, 20)
    assert "Join" not in plans["phrases"]


def test_runs_of_empty_table_and_short_length(spark):
    assert automata_dedup.remove_repeated_runs(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        automata_dedup.remove_repeated_runs(docs(spark, [(1, "a")]), 3)


def test_suffix_automaton_against_search():
    rng = random.Random(4)
    for _ in range(60):
        known = [[rng.randrange(3) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 5))]
        a = automata_dedup.SuffixAutomaton()
        for k in known:
            a.add(k)
        text = [rng.randrange(3) for _ in range(20)]
        runs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
        want = [max([n for n in range(1, e + 2) if tuple(text[e + 1 - n:e + 1]) in runs], default=0) for e in range(len(text))]
        assert a.matches(text) == want


def test_word_hashes_tell_built_strings_apart():
    """Strings over two bytes by bit parity agree in every linear hash modulo 2**64."""
    parity = [bin(i).count("1") & 1 for i in range(2048)]
    one, two = bytes(97 + p for p in parity), bytes(98 - p for p in parity)
    for n in (8, 64, 65, 1024, 2048):
        buf = np.frombuffer(one[:n] + two[:n], np.uint8)
        h = bytes_np.word_hashes(buf, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
    ids = bytes_np.word_hashes(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
    runs = np.concatenate([ids[np.array(parity)], ids[1 - np.array(parity)]])
    h = bytes_np.folded(runs, np.array([0, 2048]), np.array([2048, 2048]), 1)
    assert h[0] != h[1]


# --- hard negatives -----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string, id string, score double"
LONG_MAX = (1 << 63) - 1


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "r", "i", 1.0) for r in rows], VECTORS)


def expected_negatives(rows, every):
    able = [(i, [max(min(math.floor(256 * float(np.float32(x))), LONG_MAX), -LONG_MAX - 1) for x in v], lab) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(float(np.float32(x))) for x in v)]

    def dot(a, b):
        return max(min(sum(x * y for x, y in zip(a, b)), LONG_MAX), -LONG_MAX)

    out = []
    for i, v, lab in able:
        if i is None or i % every:
            continue
        scored = sorted(((dot(v, w), j, other) for j, w, other in able), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, j, _ in [s for s in scored if s[2] == lab and s[1] != i][:5]:
            found = [s for s in scored if s[2] != lab and 80 * p <= 100 * s[0] <= 100 * p][:5]
            out += [(i, j, k + 1, n, p, s) for k, (s, n, _) in enumerate(found)]
    return sorted(out, key=repr)


def mined(spark, rows, every, **kw):
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(4), F.col("vec_id") % every == 0, **kw)
    return sorted([tuple(r) for r in got.collect()], key=repr)


@pytest.mark.parametrize("dims,scale", [(16, 1.0), (5, 0.01), (9, 3e4), (8, 1e12), (3, 3e18)])
def test_hard_negatives(spark, dims, scale):
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(0.2, 1) * scale for _ in range(dims)], rng.randrange(3)) for i in range(120)]
    rows += [(200, None, 1), (201, [1.0] * dims, None), (202, [float("nan")] * dims, 1), (203, [float("inf")] * dims, 2), (204, [None] * dims, 0),
             (None, rows[3][1], 1), (210, [], 0), (220, rows[10][1][:2], 1), (230, [0.0] * dims, 2)]
    rows += [(300 + k, rows[0][1], (k + 1) % 3) for k in range(30)]  # ties
    assert mined(spark, rows, 10) == expected_negatives(rows, 10)


def test_hard_negatives_in_several_slices(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLICE_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 3)
    monkeypatch.setattr(hard_negatives, "STEP", 7)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(12)], rng.randrange(4)) for i in range(200)]
    # Tasks read the module's own sizes; slices of the plan are small.
    assert mined(spark, rows, 5) == expected_negatives(rows, 5)


def test_hard_negatives_of_odd_tables(spark):
    assert mined(spark, [], 2) == []
    assert mined(spark, [(1, [1.0], 1), (3, [1.0], 2)], 2) == []  # no anchor
    twice = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 1.9], 0), (3, [1.0, 1.9], 0)]
    got = mined(spark, twice, 10)
    assert len(got) == 4 and {g[:2] for g in got} == {(0, 2)} and sorted(g[2] for g in got) == [1, 1, 2, 2]


def test_four_russians_scores_are_inner_products():
    rng = np.random.default_rng(2)
    for low, high in ((-1, 1), (0, 1), (-128, 127), (-5000, 9000), (-1, 0)):
        v, a = rng.integers(low, high + 1, (50, 24)), rng.integers(low, high + 1, (7, 24))
        planes = hard_negatives.bit_planes(v, max(int(v.max()), -int(v.min()) - 1, 0).bit_length() + 1)
        assert (hard_negatives.scores(planes, hard_negatives.subset_sums(a)) == v @ a.T).all()
