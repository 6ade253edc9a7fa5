"""Reader, writer, task and prompt queries."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import collapse, words
from ..operators.ranking import with_shards
from ..plans import prompts as P
from ..session import discard, materialize, rename, scratch_path
from ..sources import tasks as T
from ..sources.readers import (jsonl_rejects, numbered_jsonl, numbered_lines, pair_lines, read_commits, read_json_records,
                               read_jsonl, split_corrupt)
from ..sources.writers import (append_metrics, cached_features, compact_metrics, fingerprint, read_metrics, write_jsonl,
                               write_predictions, write_shards)
from .base import (CHANGES, CONVERSATION_PAIRS, changes, changes_of, conversation_pairs, documents, edited, query,
                   sql_join, sql_strip, sql_words, table)
from .text import SIGNED, q, signed

# --- files: written below the shared folder, then read back --------------------------------


def _commit_files(spark, sf):
    path = scratch_path(spark, "commits")
    write_jsonl(changes(spark, sf).select(*schemas.COMMITS.names), path)
    return path


query("read_commits", f"""WITH {CHANGES} SELECT "commit", repos, message, md5(old_contents) AS old, md5(new_contents) AS new
    FROM changes""")(
    lambda spark, sf: read_commits(spark, _commit_files(spark, sf)).select(
        "commit", "repos", "message", F.md5("old_contents").alias("old"), F.md5("new_contents").alias("new")))


def _with_bad_lines(spark, sf):
    """JSON lines of which every tenth is cut off."""
    path = scratch_path(spark, "broken")
    line = F.to_json(F.struct("repos", "message"))
    cut = F.when(F.col("doc_id") % 10 == 0, F.expr("substr(value, 1, length(value) - 2)")).otherwise(F.col("value"))
    changes(spark, sf).select("doc_id", line.alias("value")).select(cut.alias("value")).write.text(path)
    good, bad = split_corrupt(read_jsonl(spark, path, schemas.COMMITS))
    return (good.groupBy("repos").agg(F.count("*").alias("n"))
            .unionByName(bad.groupBy(F.col("reason").alias("repos")).agg(F.count("*").alias("n"))))


query("read_jsonl_rejects", """SELECT CASE WHEN doc_id % 10 = 0 THEN 'unparsable' ELSE source END AS repos, count(*) AS n
    FROM documents GROUP BY 1""")(_with_bad_lines)


def _lines_written(spark, sf, column, name):
    """Text files per source, in document order: several files each, cut by key range."""
    path = scratch_path(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(spark, sf).select("doc_id", F.col("source").alias("part"), "text")
    # The range is cut and sorted on raw rows, so that sampling evaluates nothing else.
    text = F.col("text") if column == "old_contents" else edited(F.col("text"), "edit", "doc_id")
    (rows.repartitionByRange(n, "part", "doc_id").sortWithinPartitions("part", "doc_id")
     .select("part", collapse(text).alias("value")).write.partitionBy("part").text(path))
    return path


def _paired_files(spark, sf):
    old = numbered_lines(spark, _lines_written(spark, sf, "old_contents", "old-lines"), "part")
    new = numbered_lines(spark, _lines_written(spark, sf, "new_contents", "new-lines"), "part")
    return pair_lines(old, new, "part").select("part", "idx", F.md5("source").alias("source"),
                                               F.md5("target").alias("target"))


query("read_paired_lines", f"""WITH {CHANGES} SELECT repos AS part,
    row_number() OVER (PARTITION BY repos ORDER BY doc_id) - 1 AS idx,
    md5({sql_join(sql_words('old_contents'))}) AS source, md5({sql_join(sql_words('new_contents'))}) AS target
    FROM changes""")(_paired_files)


def _shard_files(spark, sf):
    path = scratch_path(spark, "shards")
    docs = with_shards(documents(spark, sf).select("doc_id", "text"), "42", "doc_id")
    write_shards(docs, path, files_per_shard=2)
    back = spark.read.schema("doc_id bigint, text string, rank bigint, shard int").json(path)
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"),
                                     F.sum(F.length("text")).alias("chars"))


query("write_shards", """WITH r AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) - 1
        AS rank, count(*) OVER () AS total FROM documents)
    SELECT CASE WHEN total // 30 = 0 THEN 29 ELSE least(rank // (total // 30), 29) END AS shard, count(*) AS n,
        sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS chars FROM r GROUP BY 1""")(_shard_files)


def _prediction_files(spark, sf):
    root = scratch_path(spark, "preds")
    rows = conversation_pairs(spark, sf).select(F.col("row_id").alias("idx"), "pred", "gold",
                                                F.col("role").alias("source"))
    write_predictions(rows, root, "test")
    counts = [spark.read.schema(f"{c} string").json(f"{root}/test.{kind}").agg(
        F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(F.length(c)).alias("chars"))
        for c, kind in (("pred", "output"), ("gold", "gold"), ("source", "src"))]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


query("write_predictions", f"WITH {CONVERSATION_PAIRS} " + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, count(*) AS n, sum(length({sql_strip(c)}))::BIGINT AS chars FROM conversation_pairs"
    for c, kind in (("pred", "output"), ("gold", "gold"), ("role", "src"))))(_prediction_files)


def _feature_cache(spark, sf):
    """Two entries of one cache: of all documents, read again, and of another split."""
    path = scratch_path(spark, "features")
    docs = documents(spark, sf).select("doc_id", F.size(words("text")).alias("n"))
    key, other = (fingerprint(split=split, limit=None, files=f"{sf}/documents.parquet") for split in ("train", "valid"))
    cached_features(spark, path, lambda: docs, docs.schema, key)  # built
    cached_features(spark, path, lambda: docs.where("n < 0"), docs.schema, other)  # another entry
    return cached_features(spark, path, lambda: docs.limit(0), docs.schema, key)  # read


query("feature_cache", f"SELECT doc_id, len({sql_words('text')}) AS n FROM documents")(_feature_cache)


def _metrics_log(spark, sf):
    """Two appends, one of them retried, and a compaction; then the last value per run and metric."""
    path = scratch_path(spark, "metrics")
    ev = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"), F.dayofmonth("ts").alias("epoch"),
        F.col("event_type").alias("metric"), "value")
    for batch, rows in (("a-d", "metric < 'e'"), ("e-z", "metric >= 'e'"), ("a-d", "metric < 'e'")):
        append_metrics(ev.where(rows), path, batch)
    compacted = scratch_path(spark, "metrics")
    compact_metrics(spark, path, compacted)
    return read_metrics(spark, compacted).groupBy("run", "metric").agg(
        F.count("*").alias("n"), F.max("epoch").alias("last_epoch"), F.max("value").alias("best"))


query("metrics_log", """SELECT CAST(user_id AS VARCHAR) AS run, event_type AS metric, count(*) AS n,
    max(day(ts)) AS last_epoch, max(value) AS best FROM events GROUP BY ALL""")(_metrics_log)

query("positional_join", f"""WITH {CONVERSATION_PAIRS} SELECT row_id AS idx, md5(pred) AS pred, md5(gold) AS gold
    FROM conversation_pairs""")(
    lambda spark, sf: (lambda p: p.select(F.col("row_id").alias("idx"), F.md5("pred").alias("pred")).join(
        p.select(F.col("row_id").alias("idx"), F.md5("gold").alias("gold")), "idx"))(conversation_pairs(spark, sf)))

# --- task readers on rows of the tables ---------------------------------------------------------


def _sql_flat(x):
    return sql_strip(f"replace({x}, chr(10), ' ')")


def _idx(df):
    return df.withColumnRenamed("doc_id", "idx")


def _out(df):
    return df.select("idx", "source", "target", "old_comm")


query("task_generation", f"""SELECT doc_id AS idx, {sql_strip("CASE WHEN doc_id % 2 = 0 THEN text ELSE source END")} AS source,
    {sql_strip("CASE WHEN doc_id % 2 = 0 THEN lang ELSE text END")} AS target, '' AS old_comm FROM documents""")(
    lambda spark, sf: _out(T.shape_generation(_idx(documents(spark, sf)).select(
        "idx", *[F.when((F.col("idx") % 2 == 0) == even, F.col(src)).alias(name) for name, src, even in (
            ("nl", "text", True), ("code", "lang", True), ("input", "source", False), ("output", "text", False))]))))

for _name, _raw in (("task_pairs", False), ("task_pairs_raw", True)):
    query(_name, f"""WITH {CHANGES} SELECT doc_id AS idx,
        {'old_contents' if _raw else sql_join(sql_words('old_contents'))} AS source,
        {'new_contents' if _raw else sql_join(sql_words('new_contents'))} AS target, '' AS old_comm FROM changes""")(
        lambda spark, sf, raw=_raw: _out(T.shape_pairs(_idx(changes(spark, sf)).select(
            "idx", F.col("old_contents").alias("source"), F.col("new_contents").alias("target")), raw)))

for _name, _suffix in (("task_comment_update", ""), ("task_comment_update_raw", "_raw")):
    query(_name, f"""WITH {CHANGES} SELECT doc_id AS idx, {sql_strip('message')} || ' <s> ' || {sql_strip('old_contents')}
        || ' <s> ' || replace({sql_strip('new_contents')}, chr(10), ' ') AS source, {_sql_flat('new_contents')} AS target,
        {_sql_flat('message')} AS old_comm FROM changes""")(
        lambda spark, sf, x=_suffix: _out(T.shape_comment_update(_idx(changes(spark, sf)).select(
            "idx", F.col("message").alias("old_comment" + x), F.col("old_contents").alias("old_code" + x),
            F.col("new_contents").alias("new_code" + x), F.col("new_contents").alias("new_comment" + x)), x)))


def _sql_side(drop):
    return f"""coalesce(array_to_string(list_filter(list_transform(list_filter(string_split(hunk, chr(10)),
        lambda ln: NOT starts_with(ln, '{drop}')), lambda ln: CASE WHEN starts_with(ln, '-')
        OR starts_with(ln, '+') OR starts_with(ln, ' ') THEN substr(ln, 2) ELSE ln END),
        lambda ln: replace(ln, ' ', '') <> ''), chr(10)), '')"""


query("task_comment_patch", f"""WITH {SIGNED}, t AS (SELECT s.doc_id, text, {_sql_side('+')} AS o, {_sql_side('-')} AS n
        FROM signed s JOIN documents d ON d.doc_id = s.doc_id)
    SELECT doc_id AS idx, 'c' || ' <s> ' || {sql_strip('o')} || ' <s> ' || replace({sql_strip('n')}, chr(10), ' ') AS source,
        {_sql_flat('text')} AS target, 'c' AS old_comm FROM t""")(
    lambda spark, sf: _out(T.shape_comment_patch(_idx(signed(spark, sf).join(
        documents(spark, sf).select("doc_id", "text"), "doc_id")).select(
        "idx", F.concat(F.lit("@@ -1,1 +1,1 @@\n\n"), "hunk").alias("diff"), F.lit(" c ").alias("old_nl"),
        F.col("text").alias("nl")))))

query("task_nl_refinement", f"""WITH {CHANGES} SELECT doc_id AS idx, old_contents || ' <s> ' || message AS source,
    new_contents AS target, '' AS old_comm FROM changes""")(
    lambda spark, sf: _out(T.shape_nl_refinement(_idx(changes(spark, sf)).select(
        "idx", F.col("old_contents").alias("old"), F.col("message").alias("comment"),
        F.col("new_contents").alias("new")))))

# --- tasks from files ---------------------------------------------------------------------------
# Files of every task are written from the changes, then read by name.


#: Names of paired lines, old and new side, in the order in which tasks read them.
FLAT = [[f"valid.{stem}.{ext}" for ext in exts] for stem, exts in (
    ("java-cs.txt", ("java", "cs")), ("buggy-fixed", ("buggy", "fixed")), ("code-review", ("buggy", "fixed")))]


def _ordered(spark, sf):
    """Changes in document order; the raw rows are ordered, so that sampling and the shuffle have nothing else."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf, "documents").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    return changes_of(rows)


def _write_flat(root):
    """Paired lines; both sides are written from the same parts of the same table, so in the same order."""
    def write(d):
        for side, to in zip(("old_contents", "new_contents"), FLAT[0]):
            d.select(collapse(side).alias("value")).write.option("compression", "gzip").text(f"{root}/{to}")

    return write


def _renamed(spark, root, k):
    """The next tasks have the same lines under other names."""
    def write(d):
        for was, to in zip(FLAT[k - 1], FLAT[k]):
            rename(spark, f"{root}/{was}", f"{root}/{to}")

    return write


def _write_generation(root):
    return lambda d: d.select(collapse("old_contents").alias("nl"), collapse("new_contents").alias("code")).write.option(
        "compression", "gzip").json(f"{root}/dev_o.json")


def _write_update(root, suffix):
    """JSON arrays of up to a hundred records in their order, a file each."""
    def arrays(batches):
        for batch in batches:
            records = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(
                ["[" + ",".join(records[k:k + 100]) + "]" for k in range(0, len(records), 100)], pa.string())], ["value"])

    record = F.struct(F.col("message").alias("old_comment" + suffix), F.col("old_contents").alias("old_code" + suffix),
                      F.col("new_contents").alias("new_code" + suffix), F.col("new_contents").alias("new_comment" + suffix))
    return lambda d: (d.select(F.to_json(record).alias("value")).mapInArrow(arrays, "value string")
                      .write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(f"{root}/valid.json"))


def _write_refinement(root):
    return lambda d: d.select(F.col("old_contents").alias("old"), F.col("message").alias("comment"), F.col("new_contents").alias("new")
                              ).write.option("compression", "gzip").json(f"{root}/valid.json")


def _write_patches(spark, sf, root):
    return lambda d: signed(spark, sf).join(documents(spark, sf).select("doc_id", "text"), "doc_id").select(
        F.concat(F.lit("@@ -1,1 +1,1 @@\n\n"), "hunk").alias("diff"), F.lit(" c ").alias("old_nl"),
        F.col("text").alias("nl")).write.option("compression", "gzip").json(root)


def _load_tasks(spark, sf):
    """The changes are made once and held as a table; the files of a task, compressed, are there only while it is read."""
    held = scratch_path(spark, "changes")
    d = materialize(_ordered(spark, sf).select("message", "old_contents", "new_contents"), "changes", held, compression="zstd")
    base = scratch_path(spark, "tasks")
    # A folder's name tells the bug fixes theirs, so they share them with the refinements.
    flat, patches = f"{base}/buggy-fixed", f"{base}/patches.json"
    groups = [(f"{base}/generation", _write_generation(f"{base}/generation"), ("generation",)),
              (flat, _write_flat(flat), ("java-to-csharp", "csharp-to-java")),
              (flat, _renamed(spark, flat, 1), ("bugfix", "refinement")),
              (flat, _renamed(spark, flat, 2), ("review",)),
              (f"{base}/update", _write_update(f"{base}/update", ""), ("comment-update",)),
              (f"{base}/update-raw", _write_update(f"{base}/update-raw", "_raw"), ("comment-update-raw",)),
              (patches, _write_patches(spark, sf, patches), ("comment-patch",)),
              (f"{base}/nl", _write_refinement(f"{base}/nl"), ("nl-refinement",))]
    parts = []
    for k, (root, write, tasks) in enumerate(groups):
        write(d)
        parts += [materialize(T.load_task(spark, task, root, "valid", F.md5).select("task", "source", "target"), "task", compression="zstd")
                  for task in tasks]
        if root not in [x for x, _, _ in groups[k + 1:]]:
            discard(spark, root)
    discard(spark, held)
    return reduce(lambda a, b: a.unionByName(b), parts)


_OLD, _NEW = sql_join(sql_words("old_contents")), sql_join(sql_words("new_contents"))
_UPDATE = f"""{sql_strip('message')} || ' <s> ' || {sql_strip('old_contents')} || ' <s> ' || replace({sql_strip('new_contents')}, chr(10), ' ')"""
query("load_task", f"""WITH {CHANGES}, {SIGNED}, sides AS (SELECT s.doc_id, text, {_sql_side('+')} AS o, {_sql_side('-')} AS n
        FROM signed s JOIN documents d ON d.doc_id = s.doc_id),
    x AS ({' UNION ALL '.join(f"SELECT '{t}' AS task, {a} AS source, {b} AS target FROM changes" for t, a, b in (
        ('generation', _OLD, _NEW), ('java-to-csharp', _OLD, _NEW), ('csharp-to-java', _NEW, _OLD), ('bugfix', _OLD, _NEW),
        ('refinement', _OLD, _NEW), ('review', _OLD, _NEW), ('comment-update', _UPDATE, _sql_flat('new_contents')),
        ('comment-update-raw', _UPDATE, _sql_flat('new_contents')),
        ('nl-refinement', "old_contents || ' <s> ' || message", 'new_contents')))} UNION ALL
        SELECT 'comment-patch', 'c' || ' <s> ' || {sql_strip('o')} || ' <s> ' || replace({sql_strip('n')}, chr(10), ' '),
            {_sql_flat('text')} FROM sides)
    SELECT task, md5(source) AS source, md5(target) AS target FROM x""")(_load_tasks)


def _json_records(spark, sf):
    path = scratch_path(spark, "records")
    (_ordered(spark, sf).groupBy(F.floor(F.col("doc_id") / 100)).agg(F.to_json(F.collect_list(F.struct(
        F.col("message").alias("old"), F.col("old_contents").alias("comment"), F.col("new_contents").alias("new")))).alias("value"))
     .select("value").write.option("maxRecordsPerFile", 1).text(path))
    return read_json_records(spark, path, schemas.NL_REFINEMENT).select(
        F.md5("old").alias("old"), F.md5("comment").alias("comment"), F.md5("new").alias("new"))


query("read_json_records", f"""WITH {CHANGES} SELECT md5(message) AS old, md5(old_contents) AS comment, md5(new_contents) AS new
    FROM changes""")(_json_records)


def _line_rejects(spark, sf):
    """Numbered JSON lines of which every tenth is cut off."""
    path = scratch_path(spark, "numbered")
    line = F.to_json(F.struct(F.col("old_contents").alias("old"), F.col("message").alias("comment")))
    cut = F.when(F.col("doc_id") % 10 == 0, F.expr("substr(value, 1, length(value) - 2)")).otherwise(F.col("value"))
    _ordered(spark, sf).select("doc_id", line.alias("value")).select(cut.alias("value")).write.text(path)
    good = numbered_jsonl(spark, path, schemas.NL_REFINEMENT).select(F.lit("kept").alias("part"), "idx")
    return good.unionByName(jsonl_rejects(spark, path, schemas.NL_REFINEMENT).select(F.col("reason").alias("part"), "idx"))


query("numbered_jsonl", """SELECT CASE WHEN doc_id % 10 = 0 THEN 'unparsable' ELSE 'kept' END AS part,
    row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents""")(_line_rejects)

# --- prompts --------------------------------------------------------------------------------------


def inputs(spark, sf):
    """Conversation turns as `code <s> comment <s> more`."""
    return conversation_pairs(spark, sf).select("row_id", F.concat_ws(
        " <s> ", "pred", "gold", "role").alias("input"))


INPUTS = f"""{CONVERSATION_PAIRS}, inputs AS (SELECT row_id, pred || ' <s> ' || gold || ' <s> ' || role AS input
    FROM conversation_pairs), seg AS (SELECT *, string_split(input, '<s>') AS seg FROM inputs)"""


def sql_fill(template, values):
    """``values``: Python strings are constants, one-element tuples are SQL expressions."""
    parts = template.split("{}")
    out = [q(parts[0])]
    for v, tail in zip(values, parts[1:]):
        out += [v[0] if isinstance(v, tuple) else q(v), q(tail)]
    return " || ".join(out)


def prompts(df):
    return df.select("row_id", "prompt")


query("review_prompts", f"""WITH {INPUTS} SELECT row_id, {sql_fill(P.REVIEW, [*P.REVIEW_SHOT, (sql_strip('seg[1]'),),
    (sql_strip('seg[2]'),)])} AS prompt FROM seg""")(
    lambda spark, sf: prompts(P.review_prompts(inputs(spark, sf))))
query("bugfix_prompts", f"""WITH {INPUTS} SELECT row_id, {sql_fill(P.BUGFIX, [*P.BUGFIX_SHOT, (sql_strip('seg[1]'),),
    ("array_to_string(seg[2:], chr(10))",)])} AS prompt FROM seg""")(
    lambda spark, sf: prompts(P.bugfix_prompts(inputs(spark, sf))))
query("refinement_prompts", f"""WITH {INPUTS} SELECT row_id, {sql_fill(P.REFINEMENT, [*P.REFINEMENT_SHOT, ('input',)])} AS prompt
    FROM seg""")(lambda spark, sf: prompts(P.refinement_prompts(inputs(spark, sf))))
for _a, _b in (("java", "csharp"), ("csharp", "java")):
    query(f"translation_prompts_{_a}_to_{_b}", f"""WITH {INPUTS} SELECT row_id, {sql_fill(P.TRANSLATION, [
        _a, _b, _a, P.TRANSLATION_SHOT[_a], _b, P.TRANSLATION_SHOT[_b], _a, _b, _a, ('input',)])} AS prompt FROM seg""")(
        lambda spark, sf, a=_a, b=_b: prompts(P.translation_prompts(inputs(spark, sf), a, b)))


def _refine(spark, sf):
    train = changes(spark, sf).select(
        F.col("doc_id").alias("idx"), F.col("old_contents").alias("old"), F.col("new_contents").alias("new"))
    rows = conversation_pairs(spark, sf).select("row_id", F.col("pred").alias("old"), F.col("gold").alias("comment"))
    return prompts(P.refine_prompts(rows, train))


query("refine_prompts", f"""WITH {CHANGES}, {CONVERSATION_PAIRS}, shot AS (SELECT old_contents AS so, new_contents AS sn
        FROM changes WHERE doc_id = 1)
    SELECT row_id, {sql_fill(P.REVIEW, [('so',), P.REFINE_DESCRIPTION, ('sn',), (sql_strip('pred'),), (sql_strip('gold'),)])}
        AS prompt FROM conversation_pairs, shot""")(_refine)


def _prompt_files(spark, sf):
    path = scratch_path(spark, "prompts")
    write_jsonl(P.refinement_prompts(inputs(spark, sf)), path)
    return spark.read.schema("row_id string, input string, prompt string").json(path)


query("write_prompts", f"""WITH {INPUTS} SELECT row_id, input, {sql_fill(P.REFINEMENT, [*P.REFINEMENT_SHOT, ('input',)])}
    AS prompt FROM seg""")(_prompt_files)
