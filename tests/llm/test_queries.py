"""Registered training-data queries: against DuckDB where SQL can state them, else by contract."""

import collections
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, connect
from diffloom.llm.common import tokenizer_path
from diffloom.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_query_matches_sql(spark, name):
    problem, n = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert problem is None and n > 0


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in rows(spark, "op1_quality")}
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in labels) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    good = [got[r.doc_id].score for r in labels if r.quality == 1]
    bad = [got[r.doc_id].score for r in labels if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.95  # area under the ROC curve


def test_token_files_of_documents(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    start = 0
    for r in sorted(rows(spark, "op3_token_files"), key=lambda r: r.start):
        ids = np.array([*tok.encode(texts.pop(r.doc_id), add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not texts


def test_shards_of_documents(spark):
    got = rows(spark, "op7_sharding")
    n = collections.Counter(r.shard for r in got)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    assert {(r.shard, r.slot) for r in got} == {(s, k) for s in n for k in range(n[s])}


def test_near_copies_of_documents(spark):
    got = rows(spark, "op4_near_dup")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_class = collections.defaultdict(list)
    for r in got:
        by_class[r.class_id].append(r)
    assert all(len(c) == c[0].class_size and sum(r.kept for r in c) == 1 for c in by_class.values())
    cls = {r.doc_id: r.class_id for r in got}
    by_text = collections.defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(cls[i])
    assert all(len(c) == 1 for c in by_text.values())


def test_pipeline_stages_on_planted_cases(spark, tmp_path):
    """Every stage drops what it should, keeps clean documents, and the last one tokenises what is left."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("aeioubdfgklmnrst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n)) + "."

    items = [(i, prose(40)) for i in range(10)]
    docs, kind = [], {}
    for i in range(300):
        docs.append((i, prose(rng.randint(60, 200)), f"src{i % 4}"))
        kind[i] = "clean"
    for i in range(300, 360):
        docs.append((i, " ".join(w + "&&&" for w in prose(60).split()), "src0"))
        kind[i] = "junk"
    for i in range(360, 400):
        w = docs[i - 360][1].split()
        w[len(w) // 2] = "changed"
        docs.append((i, " ".join(w), "src1"))
        kind[i] = "copy"
    for i in range(400, 420):
        leak = items[i % 10][1].split()[5:25]
        docs.append((i, prose(50) + " " + " ".join(leak) + " " + prose(50), "src2"))
        kind[i] = "leak"
    docs += [(420, None, None), (421, "", "src3")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(kind.get(i) != "junk"), 0) for i in range(420)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dup", "decontaminate", "mix", "tokens"]
    d, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = d.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, d, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        assert d.columns == columns
        seen[name] = collections.Counter(r.doc_id for r in d.select("doc_id").collect())
    clean = {i for i, k in kind.items() if k == "clean"}
    assert clean <= set(seen["quality"]) and not {i for i in seen["quality"] if kind.get(i) == "junk"}
    assert clean <= set(seen["near_dup"]) and not {i for i in seen["near_dup"] if kind.get(i) == "copy"}
    assert clean <= set(seen["decontaminate"]) and not {i for i in seen["decontaminate"] if kind.get(i) == "leak"}
    assert max(seen["mix"].values()) == 2 and set(seen["mix"]) <= set(seen["decontaminate"])
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert collections.Counter(r.doc_id for r in out) == seen["mix"]
    from tokenizers import Tokenizer
    tok, text, start = Tokenizer.from_file(tokenizer_path()), {i: t for i, t, _ in docs}, 0
    for r in out:
        ids = np.array([*tok.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
