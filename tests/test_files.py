"""Readers, writers and streams on small files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from diffloom import schemas
from diffloom.functions.text import words
from diffloom.operators.hunks import extract_hunks, with_hunks_only
from diffloom.operators.scores import corpus_bleu
from diffloom.sources.readers import numbered_lines, read_commits, read_json_records
from diffloom.session import scratch_root
from diffloom.sources.tasks import READERS, load_task
from diffloom.streaming import jobs


def test_lines_are_numbered_across_blocks_and_files(spark, tmp_path):
    for part in range(2):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{part} line {i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = {r["idx"]: r["value"] for r in numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == {500 * p + i: f"{p} line {i}" for p in range(2) for i in range(500)}


def test_commit_shards_carry_their_number(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"data-{n}.json").write_text(json.dumps({"commit": f"c{n}", "old_contents": "a"}) + "\n\nbroken\n")
    rows = read_commits(spark, str(tmp_path / "*.json")).collect()
    assert sorted((r["shard_no"], r["commit"]) for r in rows if r["commit"]) == [(2, "c2"), (10, "c10")]
    assert sum(r["_corrupt_record"] == "broken" for r in rows) == 2


def test_json_array(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"old": "a", "comment": "b", "new": "c"}] * 3, indent=1))
    assert read_json_records(spark, str(tmp_path / "a.json"), schemas.NL_REFINEMENT).count() == 3


def _pair(root, name, src, tgt, exts):
    for ext, text in zip(exts, (src, tgt)):
        (root / f"{name}.{ext}").write_text(text)


def test_task_readers(spark, tmp_path):
    small = tmp_path / "small"
    small.mkdir()
    _pair(small, "train.small", "a  b\nc\nextra\n", "x\ty\nz\n", ("buggy", "fixed"))
    _pair(small, "valid.java-cs.txt", "j 1\n", "c 1\n", ("java", "cs"))
    _pair(small, "test.buggy-fixed", " raw  line\n", "t\n", ("buggy", "fixed"))
    _pair(small, "test.code-review", "code <s>  note\n", "new\n", ("buggy", "fixed"))
    (small / "train_o.json").write_text('{"nl": " n ", "code": "c"}\n{"input": "i", "output": " o"}\n')
    (small / "dev_o.json").write_text('{"nl": "d", "code": "e"}\n')
    rec = {"old_comment": " oc ", "old_code": "a", "new_code": "b\nc", "new_comment": "n\nc "}
    (small / "valid.json").write_text(json.dumps([rec]))
    (small / "patch.jsonl").write_text(json.dumps(
        {"diff": "@@ -1 +1 @@\n\n-a\n+b\n c", "old_nl": "o", "nl": "n"}) + "\n")
    root = str(small)

    def rows(task, split="train", where=root):
        return [(r["source"], r["target"], r["old_comm"]) for r in
                load_task(spark, task, where, split).orderBy("idx").collect()]

    assert rows("bugfix") == [("a b", "x y", ""), ("c", "z", "")]
    assert rows("java-to-csharp", "dev") == [("j 1", "c 1", "")]
    assert rows("csharp-to-java", "dev") == [("c 1", "j 1", "")]
    assert rows("refinement", "test") == [(" raw  line", "t", "")]
    assert rows("review", "test") == [("code <s> note", "new", "")]
    assert rows("generation") == [("n", "c", ""), ("i", "o", "")]
    assert rows("generation", "anything") == [("d", "e", "")]
    assert rows("comment-update", "dev") == [("oc <s> a <s> b c", "n c", "oc")]
    assert rows("comment-patch", where=root + "/patch.jsonl") == [("o <s> a\nc <s> b c", "n", "o")]


def test_stream_of_commits_equals_batch(spark, tmp_path):
    rows = [(f"c{i}", "r", "m", f"a\n{i}\nb", f"a\n{i % 3}\nb") for i in range(9)]
    df = spark.createDataFrame(rows, schemas.COMMITS)
    df.repartition(3).write.json(str(tmp_path / "in"))
    query = jobs.start_hunks(jobs.stream_commits(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"),
                             str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    got = sorted((r["commit"], *r["hunks"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["commit"], *r["hunks"]) for r in with_hunks_only(extract_hunks(df)).collect())
    assert got == want and len(got) == 6


def test_streamed_score_equals_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], f"the cat {i} sat on the mat", "the cat sat on a mat today") for i in range(12)]
    df = spark.createDataFrame(rows, "k int, s string, h string, r string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.start_scores(stream, str(tmp_path / "sums"), str(tmp_path / "cp"), "k", words("h"), words("r"), "s",
                      available_now=True).awaitTermination(180)
    got = {r["s"]: r["bleu"] for r in jobs.read_scores(spark, str(tmp_path / "sums"), "s").collect()}
    want = {r["s"]: r["bleu"] for r in corpus_bleu(df, "k", words("h"), words("r"), "s").collect()}
    assert got == pytest.approx(want)


def test_numbering_shuffles_no_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    plan = numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan and "SortMergeJoin" not in plan


def test_paired_lines_are_shaped_before_they_meet(spark, tmp_path):
    _pair(tmp_path, "valid.code-review", "a  b\n\nc\nextra\n", "x\ny \nz\n", ("buggy", "fixed"))
    read = load_task(spark, "review", str(tmp_path), "valid", F.md5)
    assert sorted(map(tuple, read.select("source", "target").collect())) == sorted(
        (hashlib.md5(a.encode()).hexdigest(), hashlib.md5(b.encode()).hexdigest()) for a, b in (("a b", "x"), ("", "y"), ("c", "z")))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan[:plan.index("Join")] and plan.count("md5") == 2


def test_task_files_are_there_only_while_they_are_read(spark, tmp_path):
    rows = [(k, "en", "s", None if k == 7 else f"first {k}\n\tline  {k % 4}\n") for k in range(230)] + [(3, "en", "s", "again"), (None, "en", "s", "x")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    root = scratch_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    tasks = entry.queries()["load_task"](spark, str(tmp_path)).groupBy("task").count().collect()
    # Patches are joined by document: 3 meets itself, a missing number meets nothing; a missing text leaves no patch.
    assert {r["task"]: r["count"] for r in tasks} == {t: 228 + 4 if t == "comment-patch" else len(rows) for t in READERS}
    assert {x.split("-")[0] for x in os.listdir(root) if x not in before and os.listdir(f"{root}/{x}")} == {"task"}
