"""Training-data operators on small tables: against brute force, and in every odd case."""

import collections
import hashlib
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from diffloom.llm import (decontaminate, exact_dedup, graph, line_dedup, mixing, near_dup, quality, rans, sharding,
                          suffix_dedup, token_files, url_filter)
from diffloom.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, label string, size string"
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "lé", "7")]


def docs(spark, rows):
    """Rows of (doc_id, text[, source]) with further columns whose names the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", None, "y") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, null identifiers, copies of all kinds."""
    rng = random.Random(3)
    base, other = prose(rng, 120), prose(rng, 90)
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, base, "a"), (10, base, None), (11, base.upper(), "b"),
            (12, base + " " + prose(rng, 4), "b"), (13, other, "a"), (13, other, "a"), (14, other + "\n" + base, None),
            (None, other, "c"), (None, base, "c"), (15, "é" * 50 + "\n" + "ÀB" * 70, "b"), (16, prose(rng, 5000), "b"),
            (17, "x" * 400, "a"), (18, "ab" * 300, "a"), (8, "another text under a used number", "a")]
    return rows + [(20 + i, prose(rng, rng.randint(1, 60)), rng.choice("abc")) for i in range(30)]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def order(i):
    return (i is None, i or 0)


# --- exact dedup --------------------------------------------------------------------

@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("min_slice", [1, 100])
def test_exact_dedup(spark, keep, min_slice):
    rows = odd_rows() + [(1000 + i, "copy") for i in range(60)]
    got = exact_dedup.content_sort_dedup(docs(spark, rows), keep=keep, min_slice=min_slice).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    pick = min if keep == "smallest" else max
    want = collections.Counter()
    for t, ids in groups.items():
        best = pick([i for i in ids if i is not None], default=None)
        for i in ids:
            want[(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r[0], r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r[0] == r.keep_id for r in got if r.kept)


# --- lines --------------------------------------------------------------------------

def brute_lines(rows):
    first = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = lower(line.strip(" \t\n\x0b\x0c\r"))
            if k not in first or order(i) < order(first[k]):
                first[k] = i
    out = collections.Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keys = [lower(x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        kept = [x for x, k in zip(lines, keys) if len(k) < 10 or first[k] == i]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("min_slice", [1, 100])
def test_line_dedup(spark, min_slice):
    rng = random.Random(5)
    rows = odd_rows()
    rows += [(100 + i, "\n".join(["A shared line of text", prose(rng, 6), " \ta SHARED line of text\r", "short"] * 40))
             for i in range(25)]
    d = docs(spark, rows)
    got = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d, min_slice=min_slice))
    assert got.columns[:len(d.columns)] == d.columns
    assert collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(rows)


# --- benchmark ------------------------------------------------------------------------

def brute_contamination(rows, items, n=10):
    wins = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins[tuple(w[i:i + k])].add("null" if item is None else str(item))
    sizes = {len(w) for w in wins}
    out = collections.Counter()
    for i, t, *_ in rows:
        w, hit, its = words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in wins:
                    hit.update(range(s, s + k))
                    its |= wins[tuple(w[s:s + k])]
        out[(i, len(w), len(hit), tuple(sorted(its)))] += 1
    return out


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_decontaminate(spark, limit):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 6, 10, 11, 30]))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "..."), (33, items[3][1]), (33, items[3][1]), (None, prose(rng, 12))]
    rows = odd_rows()
    for i in range(40):
        w = words(rng.choice(items)[1])
        a = rng.randint(0, max(0, len(w) - 10))
        rows.append((200 + i, prose(rng, rng.randint(0, 15)) + ", " + " ".join(w[a:a + rng.randint(5, 20)]).upper() + "; " + prose(rng, 3)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, rows), bench, max_broadcast=limit).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == brute_contamination(rows, items)


# --- mixing ---------------------------------------------------------------------------

def test_mixing_targets_and_words(spark):
    rows = odd_rows()
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2] if len(r) > 2 else "s"] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x)))}
    total, clamped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in clamped)
        free = [s for s in sizes if s not in clamped]
        share = {s: weight[s] * rest / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            break
        clamped |= over
    share |= {s: 2.0 * sizes[s] for s in clamped}
    by_source = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
    for r in mixing.mix(d.withColumn("doc_id", F.coalesce("source", F.lit("~")))).collect():
        by_source[None if r.doc_id == "~" else r.doc_id] += r.taken
        assert r.target == pytest.approx(share[None if r.doc_id == "~" else r.doc_id])
    for s in sizes:
        assert abs(by_source[s] - share[s]) <= 0.5
    assert sorted(map(str, mixing.mix(d.repartition(7)).collect())) == sorted(map(str, got))


def test_mixing_copies(spark):
    d = docs(spark, odd_rows())
    mixed = mixing.mix(d)
    out = mixing.repeat_documents(d, mixed)
    assert out.columns == d.columns
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert out.exceptAll(d.union(d)).count() == 0


# --- quality --------------------------------------------------------------------------

def test_quality_learns_and_agrees_with_its_column(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) if i % 2 else "### ".join(prose(rng, 12).split())) for i in range(400)] + [(900, None), (901, "")]
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(901, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(d, labels.where(~quality.held_out("doc_id")))
    got = {r.doc_id: r.score for r in quality.score(d.select("doc_id", "text"), model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == i % 2 for i in held]) > 0.98
    import pyarrow as pa
    direct = model.predict(quality.statistics_of(pa.array([r[1] for r in rows])))
    assert np.allclose(direct, [got[r[0]] for r in rows])
    assert quality.score(d, model).columns == [*d.columns, "score"]


def test_quality_without_or_with_one_label(spark):
    d = docs(spark, odd_rows())
    none = quality.train(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.rules == () and none.intercept == 0
    one = quality.train(d, spark.createDataFrame([(9, 1), (13, 1)], "doc_id long, quality int"))
    assert quality.score(d, one).where("score < 0.9").count() == 0


# --- repeated strings -------------------------------------------------------------------

def brute_repeats(rows, n):
    """Distinct (id, text) are documents; ids ascend with nulls first."""
    texts = sorted({(i, t or "") for i, t, *_ in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    return texts


def cut(texts, n):
    seen, out = set(), {}
    for i, t in texts:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - n + 1):
            w = raw[s:s + n]
            if w in seen:
                gone[s:s + n] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out[(i, t)] = (len(raw), int(gone.sum()), runs, left)
    return out


@pytest.mark.parametrize("n, min_slice", [(40, 1000), (100, 1000), (64, 2)])
def test_repeated_strings(spark, n, min_slice):
    rng = random.Random(11)
    passages = [prose(rng, 60) for _ in range(4)]
    rows = [r for r in odd_rows() if r[0] not in (None, 8)] + [(None, prose(rng, 50) + passages[0])]
    for i in range(120):
        p = rng.choice(passages)
        a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
        rows.append((100 + i, prose(rng, rng.randint(0, 20)) + p[a:b] + prose(rng, rng.randint(0, 20)) + p[:rng.randint(0, 200)]))
    want = cut(brute_repeats(rows, n), n)
    got = suffix_dedup.remove_repeats(docs(spark, rows).repartition(5), n, with_text=True, min_slice=min_slice).collect()
    assert len(got) == len(rows)
    by_id = collections.defaultdict(list)
    for (i, _), v in want.items():
        by_id[i].append(v)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) in by_id[r.doc_id], r.doc_id
        assert r.kept_sha256 == hashlib.sha256(r.kept).hexdigest()


def test_repeated_strings_settles_contexts_across_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RESOLVE_ROWS", 3)
    rng = random.Random(2)
    shared = prose(rng, 40)
    rows = [(i, prose(rng, 9) + shared + prose(rng, 9)) for i in range(30)]
    want = cut(brute_repeats(rows, 64), 64)
    got = suffix_dedup.remove_repeats(docs(spark, rows), 64, with_text=True).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in got} == {i: (v[1], v[3]) for (i, _), v in want.items()}


def test_repeated_strings_deals_hot_contexts_by_phrase(spark, monkeypatch):
    """Every context with two phrases in a batch is hot: the same answer."""
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**6)
    rng = random.Random(6)
    shared = prose(rng, 40)
    rows = [(i, prose(rng, 9) + shared[:rng.randint(150, len(shared))] + prose(rng, i % 9)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(None, rows[3][1]), (200, None), (201, "")]
    d = docs(spark, rows).repartition(4).cache()
    keyed = suffix_dedup.with_keys(d, "doc_id", "text")
    assert suffix_dedup.hot_contexts(keyed, 64).count() > 1
    want = cut(brute_repeats(rows, 64), 64)
    got = suffix_dedup.remove_repeats(d, 64, with_text=True, min_slice=2).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in got} == {i: (v[1], v[3]) for (i, _), v in want.items()}


# --- token files ----------------------------------------------------------------------------

def test_rans_round_trip_checkpoints_and_checksum():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.2, 50_000), 60_000).astype(np.uint32)
    table = rans.normalize(np.bincount(ids))
    for n in (0, 1, 63, 64, 65, 50_000):
        block = rans.encode(ids[:n], table, lanes=64, interval=16)
        assert (rans.decode(block, table) == ids[:n]).all()
    block = rans.encode(ids, table, lanes=64, interval=16)
    for k in (1, 5, 40):
        assert (rans.decode(block, table, k) == ids[k * 16 * 64:]).all()
    broken = bytearray(block)
    broken[-5] ^= 1
    with pytest.raises((ValueError, IndexError)):
        rans.decode(bytes(broken), table)
    with pytest.raises(ValueError):
        rans.encode(np.array([len(table.freq) - 1, 3]), rans.normalize(np.bincount([1, 2, 2], minlength=len(table.freq))))


def test_word_memo_equals_the_library():
    enc = token_files.WordCachedEncoder(tokenizer_path(), limit=50)
    rng = random.Random(4)
    texts = ["", " ", "a", " a", "a ", "a  b", "it's we'll  o'clock", "x\n y", "tab\tin \t it", "über naïve  ﬁ ² ½ ٣ 日本 語　a",
             "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>", "non break  x", "\n\n a\n\nb \n", "a ​ b 😀 😀"]
    texts += [prose(rng, 50) for _ in range(20)] + ["".join(rng.choice(" \n\tab'1.é") for _ in range(60)) for _ in range(300)]
    for _ in range(2):
        got = enc.encode(texts)
        assert [x.tolist() for x in got] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_once_whatever_stands_beside_them():
    enc = token_files.WordCachedEncoder(tokenizer_path())
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdeé") for _ in range(8)) for _ in range(100)]
    beside = ["%s.", "%s,", "(%s)", "%s!!", "%s.\n%s", "%s\n\n\t%s", "  %s", "%s12", "\"%s\""]
    texts = [" ".join(f.replace("%s", rng.choice(base)) for f in beside for _ in range(30)) for _ in range(20)]
    enc._direct = lambda texts: [] if not texts else pytest.fail("a text or word went through the pre-tokenizer")
    got = enc.encode(texts)
    assert [x.tolist() for x in got] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(enc.memo) <= 2 * len(base) + 20  # with and without a space before, and what stands beside


def test_characters_of_all_kinds_equal_the_library():
    enc = token_files.WordCachedEncoder(tokenizer_path(), limit=5000)
    rng = random.Random(7)
    chars = [chr(c) for c in [*range(0x500), *rng.sample([c for c in range(0x500, 0x110000) if not 0xD800 <= c < 0xE000], 1500)]]
    odd = [" ", "\n", "\r\n", "\t", "\x0b", "'", "'s", "<|", "<|endoftext|>", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u0301", "a", "B", "1", "²", "."]
    texts = [f % c for c in chars for f in ("a%sb", "1%s2", "!%s ?", "a %s", "\n%sx", "%s")]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for some in (texts[i:i + 700] for i in range(0, len(texts), 700)):
        want = [e.ids for e in enc.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(some)] == want


def test_other_tokenizers_take_texts_whole():
    enc = token_files.WordCachedEncoder(tokenizer_path("word_bpe_49k.json"))
    texts = ["", "A word,  a Word\nand e\u0301 12", "x <|endoftext|> y", " it's "]
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    rows = odd_rows()
    files = token_files.write_token_files(docs(spark, rows), str(tmp_path / "t"), tokenizer_path(), 2, block_ids=300, lanes=32, interval=4)
    got = token_files.read_token_files(spark, files, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=order)
    start, texts = 0, collections.Counter((r[0], (r[1] or "")) for r in rows)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.start == start and r.n_tokens == len(ids) and ids[-1] == 2 and r.ids_crc32 == zlib.crc32(r.ids)
        start += len(ids)
        match = [t for (i, t), n in texts.items() if n and i == r.doc_id and tok.encode(t, add_special_tokens=False).ids == ids[:-1].tolist()]
        assert match
        texts[(r.doc_id, match[0])] -= 1
    assert spark.read.parquet(files.blocks).count() > 3


# --- near copies ------------------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if any(y != z and x in (y, z) for y, z in edges)}


def brute_near(texts, p):
    """Links of the texts, from exact document frequencies (all below the floor here but hot ones)."""
    sets = []
    for t in texts:
        w = words(t)
        k = min(p.shingle, len(w))
        sets.append(collections.Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if k else collections.Counter())
    df = collections.Counter(s for c in sets for s in c)
    idf = {s: np.log((1 + len(texts)) / (1 + max(n, p.floor * len(texts)))) + 1 for s, n in df.items()}
    links = []
    for i in range(len(texts)):
        for j in range(i):
            both = sum(min(n, sets[j][s]) * idf[s] for s, n in sets[i].items())
            every = sum(n * idf[s] for c in (sets[i], sets[j]) for s, n in c.items()) - both
            if every:
                links.append((j, i, both / every))
    return links


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows = odd_rows()
    for g in range(25):
        base = prose(rng, 150).split()
        for k in range(4):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((1000 + 10 * g + k, " ".join(w)))
    p = near_dup.Params(tile=2)
    got = near_dup.near_duplicates(docs(spark, rows), p).collect()
    assert len(got) == len(rows)
    cls = {}
    for r in got:
        cls.setdefault((r.doc_id, r.text_digest), r.class_id)
    links = brute_near([r[1] for r in rows], p)
    keys = [r[0] for r in rows]
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.class_id)
    sure = [(keys[i], keys[j]) for i, j, s in links if s >= 0.83 and keys.count(keys[i]) == 1 and keys.count(keys[j]) == 1]
    assert len(sure) > 50 and all(by_id[a] == by_id[b] for a, b in sure)
    near = {x: {x} for x in range(len(rows))}
    for i, j, s in links:
        if s >= 0.77 or lower(rows[i][1]) == lower(rows[j][1]):
            near[i], near[j] = near[i] | {j}, near[j] | {i}
    for r in got:  # nobody is in a class without a chain of links
        i = next(k for k, x in enumerate(rows) if x[0] == r.doc_id)
        if r.class_size == 1 and r.doc_id is not None:
            assert r.kept and r.class_id == r.doc_id
        elif rows[i][1] and words(rows[i][1]):
            assert len(near[i]) > 1
    kept = near_dup.keep_one(docs(spark, rows), near_dup.near_duplicates(docs(spark, rows), p))
    classes = {(r.class_id, r.class_size) for r in got}
    assert kept.columns == docs(spark, rows[:1]).columns and kept.count() >= len(classes)


def test_near_duplicates_links_whatever_the_samples_agree_on(spark):
    rng = random.Random(14)
    rows = []
    for g in range(2):
        base = prose(rng, 300).split()
        for k in range(16):
            w = list(base) + base[:10] * rng.randrange(2)
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((100 * g + k, " ".join(w)))
    # One sample a band: a bucket for any pair near the threshold; no pair agrees in 41 of 40.
    p = near_dup.Params(bands=40, rows=1, tile=8, tile_bytes=3000)
    links = [x for x in brute_near([r[1] for r in rows], p) if x[2] >= p.threshold]
    label = list(range(len(rows)))
    for _ in rows:
        for i, j, _ in links:
            label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs(spark, rows), p).collect()}
    assert 3 < len(set(label)) < len(rows) - 10
    assert [got[r[0]] for r in rows] == [rows[x][0] for x in label]


def test_frequencies_of_long_texts_are_no_collisions(spark):
    rng = random.Random(16)
    texts = [prose(rng, 2000) for _ in range(200)]
    idf = near_dup.inverse_frequencies(docs(spark, list(enumerate(texts))), "text", near_dup.Params())
    buf = np.frombuffer(texts[0].encode(), np.uint8)
    h, _, _ = near_dup.weighted_set(*near_dup.shingles(buf, np.array([0, len(buf)]), 5))
    rare = np.log(201 / 3) + 1  # in one document, which counts as the floor's two
    assert (np.abs(near_dup.weights(h, np.ones(len(h)), idf) - rare) < 1e-4).mean() > 0.9


def test_tile_links_against_brute_force():
    rng = random.Random(15)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(60):
        w = base + base[:rng.randrange(12)] * rng.randrange(3)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    p = near_dup.Params(floor=1.0)  # all shingles weigh 1
    idf = np.ones(near_dup.CELLS * near_dup.ROWS_OF_CELLS, np.float32)
    node = [b"%02d" % i for i in range(len(texts))]
    bands = [[i, i % 7, i + 100] for i in range(len(texts))]  # those alike in i % 7 meet in band 1
    table = pa.table({"probe": pa.array([i < 25 for i in range(len(texts))]), "node": pa.array(node, pa.binary()),
                      "band": pa.array([2] * len(texts), pa.int32()), "bands": pa.array(bands, pa.list_(pa.int64())),
                      "label": pa.array(node, pa.binary()), "text": pa.array(texts),
                      "sig": pa.array([np.full(p.samples, i, np.uint32).tobytes() for i in range(len(texts))], pa.binary())})
    got = near_dup._tile_links(p, types.SimpleNamespace(value=idf))(table)
    want = {(node[i], node[j]) for i, j, s in brute_near(texts, p) if i < 25 <= j and i % 7 != j % 7 and s >= p.threshold - 1e-9}
    assert 100 < len(want) < 25 * 35 - 100
    assert set(zip(got.column("a").to_pylist(), got.column("b").to_pylist())) == want


def test_consistent_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    wa, wb = rng.uniform(1, 5, 400), rng.uniform(1, 5, 400)
    wb[:300] = wa[:300]
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    a = near_dup.consistent_samples(h, wa, np.array([0]), 2000)[0]
    b = near_dup.consistent_samples(h, wb, np.array([0]), 2000)[0]
    assert abs((a == b).mean() - true) < 0.05


# --- urls ---------------------------------------------------------------------------------

def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["com", "example.com", "www.example.com", "EXAMPLE.com", "xexample.com", "a.b.net", "net", "org", "", "a..com", ".com"]
    urls = [None, "", "x", "://", "http://", "http://Ex\nample.com/a", "no scheme/en/"]
    urls += [f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/x?y#z', '/es/1', '/fr/#/en/', '?/en/', '#/'])}"
             for _ in range(400)]
    rules = url_filter.RULES + [("org", "/e", "block"), ("org", "/en/", "allow"), ("a.b.net", "/", "allow"), ("", "/", "block"), (None, "/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(urls)] + [(None, urls[9], None, None)], "page_id long, url string, host string, key string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = lower(host)
        fit = [(len(h + p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    want = collections.Counter((i, *judge(u)) for i, u in [*enumerate(urls), (None, urls[9])])
    assert collections.Counter(tuple(r) for r in got) == want


def test_cascade_is_exact_on_its_universe(spark):
    listed, universe = {f"k{i}" for i in range(0, 3000, 7)}, [f"k{i}" for i in range(3000)]
    cascade = url_filter.build_cascade(spark.createDataFrame([(k,) for k in [*listed, *listed, None]], "key string"),
                                       spark.createDataFrame([(k,) for k in [*universe, None]], "key string"))
    h = url_filter._hashes(spark.createDataFrame([(k,) for k in universe], "key string")).collect()
    inside = cascade.contains(np.array([r.h1 for r in h]).view(np.uint64), np.array([r.h2 for r in h]).view(np.uint64))
    assert {r.key for r, x in zip(h, inside) if x} == listed
    assert len(cascade.levels) > 1


# --- shards ---------------------------------------------------------------------------------

def brute_ring(arcs, owners, caps):
    """Keys one by one, home shards first, then one node further in every round."""
    room, left, got = list(caps), {a: list(k) for a, k in arcs.items()}, {}
    for d in range(len(owners)):
        for a in sorted(left):
            s = owners[(a + d) % len(owners)]
            while left[a] and room[s]:
                got[left[a].pop(0)] = s
                room[s] -= 1
    return got


@pytest.mark.parametrize("shards", [1, 3, 40, 90])
def test_shards(spark, shards):
    rows = odd_rows()
    got = sharding.shard_rows(docs(spark, rows), shards, vnodes=4).collect()
    assert len(got) == len(rows)
    n = collections.Counter(r.shard for r in got)
    sizes = [n[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    again = sharding.shard_rows(docs(spark, rows).repartition(3), shards, vnodes=4).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_ring_places_like_keys_one_by_one_and_moves_little():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 30, 24)
    _, owners = sharding.ring(6, 4)
    caps = sharding.capacities(int(counts.sum()), 6)
    want = brute_ring({a: [(a, k) for k in range(c)] for a, c in enumerate(counts)}, owners, caps)
    got = {(a, k): s for a, lo, hi, s, _ in sharding.place(counts, owners, caps) for k in range(lo, hi)}
    assert got == want
    keys = rng.integers(0, 1 << 63, 40_000, dtype=np.int64).view(np.uint64) * np.uint64(2)

    def shard_of(n):
        pos, own = sharding.ring(n, 64)
        arc = np.searchsorted(pos, np.sort(keys)) % len(pos)
        c = np.bincount(arc, minlength=len(pos))
        out = np.empty(len(keys), int)
        begin = np.concatenate([[0], np.cumsum(np.bincount(arc, minlength=len(pos)))])
        by_arc = np.argsort(arc, kind="stable")
        for a, lo, hi, s, _ in sharding.place(c, own, sharding.capacities(len(keys), n)):
            out[by_arc[begin[a] + lo:begin[a] + hi]] = s
        return out

    assert (shard_of(40) != shard_of(41)).mean() < 0.35


# --- empty tables -----------------------------------------------------------------------------

def test_empty_tables(spark):
    none = docs(spark, [(1, "a")]).where("false")
    one = docs(spark, [(1, "a b c d e f g h i j k l")])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.content_sort_dedup(none).count() == 0
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert [r.n_hit for r in decontaminate.decontaminate(one, bench).collect()] == [0]
    assert mixing.mix(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert token_files.tokenize_documents(none, tokenizer_path()).count() == 0
    assert sharding.shard_rows(none, 4).count() == 0
    assert quality.score(none, quality.RuleEnsemble(0.0, ())).count() == 0
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert [r.verdict for r in url_filter.judge_urls(pages, rules).collect()] == ["allow"]
