"""Filters, ranks, shards, samples, audits and corpus assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import once
from ..functions.draws import pick
from ..functions.lex import word_length
from ..functions.text import first_line, words
from ..markers import TASK_LIMITS
from ..operators import filters as B, ranking as G
from ..operators.hunks import changed_lines, expand_states, extract_hunks
from ..operators.vocabulary import truncation_report
from ..plans.corpus import assemble, commit_rejects, prepared, scripted, shard_corpus
from ..plans.selection import early_stop, replay_epochs, running_loss, selection_score
from .base import (CHANGES, CONVERSATION_PAIRS, changes, conversation_pairs, documents, query, sql_draw, sql_edits, sql_lines,
                   sql_strip, sql_words, table)
from .changes import _BUDGET, _signed_hunks, _sql_states, sql_prepared_states
from .scores import rounded
from .text import sql_lex

# Corpus rows with the faults that filters look for: empty, missing, blank, unchanged sides.
ROWS = f"""{CHANGES}, corpus AS (SELECT doc_id AS row_key, lang, repos AS proj,
        CASE doc_id % 5 WHEN 0 THEN '{B.STATE_TYPE}' WHEN 1 THEN 'ccn' ELSE 'commitpack' END AS "type",
        CASE WHEN doc_id % 9 = 0 THEN '' ELSE message END AS nl,
        CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 13 = 0 THEN NULL
             WHEN doc_id % 17 = 0 THEN ' ' || chr(10) ELSE old_contents END AS old,
        CASE WHEN doc_id % 11 = 0 THEN old_contents ELSE new_contents END AS new FROM changes)"""


def corpus(spark, sf):
    k = F.col("doc_id")
    return changes(spark, sf).select(
        k.alias("row_key"), "lang", F.col("repos").alias("proj"),
        F.when(k % 5 == 0, B.STATE_TYPE).when(k % 5 == 1, "ccn").otherwise("commitpack").alias("type"),
        F.when(k % 9 == 0, "").otherwise(F.col("message")).alias("nl"),
        F.when(k % 7 == 0, "").when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, " \n")
        .otherwise(F.col("old_contents")).alias("old"),
        F.when(k % 11 == 0, F.col("old_contents")).otherwise(F.col("new_contents")).alias("new"))


query("keep_real_changes", f"""WITH {ROWS} SELECT row_key, "type" FROM corpus
    WHERE old <> '' AND new <> '' AND old <> new""")(
    lambda spark, sf: corpus(spark, sf).where(B.real_change()).select("row_key", "type"))

query("keep_nonblank_changes", f"""WITH {ROWS} SELECT row_key FROM corpus
    WHERE old <> new AND {sql_strip('old')} <> '' AND {sql_strip('new')} <> ''""")(
    lambda spark, sf: corpus(spark, sf).where(B.real_change_nonblank()).select("row_key"))

query("length_gate", f"""WITH {ROWS} SELECT row_key FROM corpus WHERE len({sql_words('nl')}) >= 3
    AND len({sql_lex('old')}) <= 510 AND len({sql_lex('new')}) <= 510""")(
    lambda spark, sf: B.length_gate(corpus(spark, sf), msg="nl").select("row_key"))

query("length_gate_words", f"""WITH {ROWS} SELECT row_key FROM corpus WHERE len({sql_words('nl')}) >= 3
    AND len({sql_words('old')}) <= 510 AND len({sql_words('new')}) <= 510""")(
    lambda spark, sf: B.length_gate(corpus(spark, sf), msg="nl", measure=word_length).select("row_key"))

query("hunked_commits", f"""WITH {CHANGES} SELECT "commit", message FROM changes
    WHERE {sql_lines('old_contents')} <> {sql_lines('new_contents')}""")(
    lambda spark, sf: extract_hunks(changed_lines(changes(spark, sf))).select("commit", "message"))

query("keep_with_message", f"""WITH {ROWS} SELECT row_key FROM corpus
    WHERE "type" = '{B.STATE_TYPE}' OR len({sql_words('nl')}) > 0""")(
    lambda spark, sf: B.with_message(corpus(spark, sf).withColumn("nl_tokens", words("nl"))).select("row_key"))

# The limit counts scanned rows: it is taken before the filter, not after.
query("scanned_limit", f"""WITH {ROWS} SELECT row_key FROM corpus WHERE row_key < 100
    AND old <> '' AND new <> '' AND old <> new""")(
    lambda spark, sf: B.scanned_limit(corpus(spark, sf), "row_key", 100).where(B.real_change()).select("row_key"))


def _routed(spark, sf):
    kept, rejects = B.route(corpus(spark, sf), {
        "missing side": F.col("old").isNull() | F.col("new").isNull(),
        "empty side": (F.col("old") == "") | (F.col("new") == ""),
        "unchanged": F.col("old") == F.col("new"),
        "no message": F.col("nl") == ""})
    return (kept.groupBy(F.lit("kept").alias("reason")).agg(F.count("*").alias("n"))
            .unionByName(rejects.groupBy("reason").agg(F.count("*").alias("n"))))


query("route_rejects", f"""WITH {ROWS} SELECT CASE WHEN old IS NULL OR new IS NULL THEN 'missing side'
    WHEN old = '' OR new = '' THEN 'empty side' WHEN old = new THEN 'unchanged' WHEN nl = '' THEN 'no message'
    ELSE 'kept' END AS reason, count(*) AS n FROM corpus GROUP BY 1""")(_routed)

query("commit_rejects", f"""WITH {CHANGES} SELECT "commit", 'unchanged' AS reason FROM changes
    WHERE old_contents = new_contents""")(
    lambda spark, sf: commit_rejects(changes(spark, sf)).select("commit", "reason"))

query("funnel", f"""WITH {ROWS} SELECT "type", count(*) AS n_rows, count(*) FILTER (old = '') AS empty_old,
    count(*) FILTER (new = '') AS empty_new, count(*) FILTER (old IS NULL) AS null_old,
    count(*) FILTER (new IS NULL) AS null_new, count(*) FILTER (old = new) AS unchanged,
    count(*) FILTER (old <> '' AND new <> '' AND old <> new) AS kept FROM corpus GROUP BY 1""")(
    lambda spark, sf: B.funnel(corpus(spark, sf), "type"))

query("corpus_composition", f"""WITH {ROWS} SELECT "type", lang, count(*) AS n_rows FROM corpus
    GROUP BY ROLLUP ("type", lang)""")(
    lambda spark, sf: B.composition(corpus(spark, sf), "type", "lang"))

query("conform_columns", """SELECT source AS proj, text AS nl, 'java' AS lang, 'commitpack' AS "type" FROM documents""")(
    lambda spark, sf: B.conform(documents(spark, sf), {"proj": "source", "nl": "text"},
                                {"lang": "java", "type": "commitpack"}))

# --- ranks and shards ------------------------------------------------------------------


def _rank(seed, key):
    return f"row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', {key})), {key}) - 1"


query("shuffled_rank", f"SELECT l_orderkey * 10 + l_linenumber AS k, {_rank('42', 'l_orderkey * 10 + l_linenumber')} "
                       "AS rank FROM lineitem")(
    lambda spark, sf: G.shuffled_rank(table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), "42", "k"))

query("epoch_order", f"""SELECT doc_id, 1 AS epoch, {_rank('epoch-43', 'doc_id')} AS rank FROM documents UNION ALL
    SELECT doc_id, 2, {_rank('epoch-44', 'doc_id')} FROM documents""")(
    lambda spark, sf: B.union_corpora(*[G.epoch_order(documents(spark, sf).select(
        "doc_id", F.lit(e).alias("epoch")), 42, e, "doc_id") for e in (1, 2)]))

_SHARD = ("CASE WHEN total // 30 = 0 THEN 29 ELSE least(rank // (total // 30), 29) END")
query("even_shards", f"""WITH r AS (SELECT doc_id, {_rank('42', 'doc_id')} AS rank, count(*) OVER () AS total FROM documents)
    SELECT doc_id, rank, {_SHARD} AS shard FROM r""")(
    lambda spark, sf: G.with_shards(documents(spark, sf).select("doc_id"), "42", "doc_id"))
query("few_rows_shards", f"""WITH r AS (SELECT r_regionkey, {_rank('42', 'r_regionkey')} AS rank, count(*) OVER () AS total FROM region)
    SELECT r_regionkey, rank, {_SHARD} AS shard FROM r""")(
    lambda spark, sf: G.with_shards(table(spark, sf, "region").select("r_regionkey"), "42", "r_regionkey"))

query("trainer_slots", f"""WITH r AS (SELECT doc_id, {_rank('t', 'doc_id')} AS rank, count(*) OVER () AS total FROM documents)
    SELECT doc_id, rank, rank % 3 AS slot FROM r WHERE rank < total - total % 3""")(
    lambda spark, sf: G.trainer_slots(documents(spark, sf).select("doc_id"), "t", "doc_id", 3))

query("drawn_subset", """SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem
    ORDER BY md5(concat_ws('|', 'sub', l_orderkey * 10 + l_linenumber)), 1 LIMIT 5000""")(
    lambda spark, sf: G.drawn_subset(table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")), 5000, "sub", "k"))

# A number of words per document; three of them drawn, in order.
query("drawn_positions", f"""WITH t AS (SELECT doc_id, len({sql_words('text')}) AS n FROM documents)
    SELECT doc_id, coalesce(array_to_string(list_sort(list_transform(list_sort(list_transform(range(1, n + 1),
        lambda i: {{'u': {sql_draw('g2', 'doc_id', 'i')}, 'i': i}}))[1:3], lambda z: z.i)), ' '), '') AS picked FROM t""")(
    lambda spark, sf: documents(spark, sf).select("doc_id", F.size(words("text")).alias("n")).select(
        "doc_id", F.array_join(F.transform(pick(F.col("n"), 3, "g2", "doc_id"), lambda i: i.cast("string")), " ")
        .alias("picked")))

query("shard_numbers", """SELECT o_orderkey, CAST(regexp_extract('data-' || o_orderkey || '.json', '-([0-9]+)\\.[^/]*$', 1)
    AS INTEGER) AS shard_no FROM orders""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", G.shard_number(
        F.concat(F.lit("data-"), "o_orderkey", F.lit(".json"))).alias("shard_no")))

# --- assembly ---------------------------------------------------------------------------


def _assembled(spark, sf):
    annotated = conversation_pairs(spark, sf).select(
        F.col("row_id").alias("row_key"), F.col("role").alias("proj"), first_line("pred").alias("msg"),
        F.col("pred").alias("old"), F.col("gold").alias("new"), F.lit("en").alias("lang"))
    commits = changes(spark, sf).select(
        F.col("commit").alias("row_key"), "repos", F.col("message").alias("msg"),
        F.col("old_contents").alias("old"), F.col("new_contents").alias("new"))
    states = expand_states(_signed_hunks(spark, sf), word_length, budget=_BUDGET).select(
        F.concat_ws("-", "commit", "group_idx", "state_idx").alias("row_key"), F.lit("r").alias("repos"),
        F.lit("m").alias("msg"), "old", "new")
    return assemble(annotated, commits, states)


_STATES = _sql_states(False)
_CUT = _STATES.rindex("SELECT \"commit\", group_idx, t AS state_idx")
_ASSEMBLED = f"""{_STATES[:_CUT].rstrip()}, states AS ({_STATES[_CUT:]}), {CONVERSATION_PAIRS}, {CHANGES}, asm AS (
    SELECT 'ccn/' || row_id AS row_key, role AS proj, 'en' AS lang, 'ccn' AS "type", pred AS old, gold AS new
        FROM conversation_pairs UNION ALL
    SELECT 'commitpack/' || "commit", repos, 'java', 'commitpack', old_contents, new_contents FROM changes UNION ALL
    SELECT '{B.STATE_TYPE}/' || "commit" || '-' || group_idx || '-' || state_idx, 'r', 'java', '{B.STATE_TYPE}', old, new FROM states),
    kept AS (SELECT * FROM asm WHERE old <> '' AND new <> '' AND old <> new)"""

query("assemble_corpus", f"""{_ASSEMBLED} SELECT row_key, proj, lang, "type", md5(old) AS old, md5(new) AS new FROM kept""")(
    lambda spark, sf: _assembled(spark, sf).select("row_key", "proj", "lang", "type", F.md5("old").alias("old"),
                                                   F.md5("new").alias("new")))

query("sharded_corpus", f"""{_ASSEMBLED}, r AS (SELECT row_key, "type", {_rank('42', 'row_key')} AS rank,
        count(*) OVER () AS total FROM kept) SELECT row_key, "type", rank, {_SHARD} AS shard FROM r""")(
    lambda spark, sf: shard_corpus(_assembled(spark, sf)).select("row_key", "type", "rank", "shard"))

# Lexer tokens of both sides and their script, for rows with two different sides that are not blank.
query("scripted_corpus", f"""WITH {ROWS}, sides AS MATERIALIZED (SELECT row_key AS doc_id, {sql_lex('old')} AS a, {sql_lex('new')} AS b
        FROM corpus WHERE old <> new AND {sql_strip('old')} <> '' AND {sql_strip('new')} <> ''), {sql_edits('sides')}
    SELECT doc_id AS row_key, tag, i1, i2, j1, j2 FROM ops""")(
    lambda spark, sf: scripted(corpus(spark, sf)).select("row_key", F.inline(once("ops"))))

# Commits to sharded training rows: hunks of the anchored diff, states, gate, shuffle, shards.
query("prepared_corpus", (lambda groups: f"""WITH {groups}, r AS (SELECT "commit" || '-' || group_idx || '-' || state_idx AS row_key, old, new, msg
        FROM states WHERE len({sql_words('msg')}) >= 3 AND len({sql_words('old')}) <= 510 AND len({sql_words('new')}) <= 510
        AND old <> '' AND new <> '' AND old <> new),
    n AS (SELECT *, {_rank('42', 'row_key')} AS rank, count(*) OVER () AS total FROM r)
    SELECT row_key, md5(old) AS old, md5(new) AS new, rank, {_SHARD} AS shard FROM n""")(sql_prepared_states()))(
    lambda spark, sf: prepared(changes(spark, sf), word_length).select(
        "row_key", F.md5("old").alias("old"), F.md5("new").alias("new"), "rank", "shard"))

# --- limits ------------------------------------------------------------------------------


def _lengths(spark, sf):
    names = F.array(*[F.lit(t) for t, _, _ in TASK_LIMITS])
    return changes(spark, sf).select(
        F.get(names, (F.col("doc_id") % len(TASK_LIMITS)).cast("int")).alias("task"),
        F.size(words("old_contents")).alias("source_len"), F.size(words("new_contents")).alias("target_len"))


_LIMITS = "limits(i, task, sl, tl) AS (VALUES " + ", ".join(
    f"({i}, '{t}', {s}, {g})" for i, (t, s, g) in enumerate(TASK_LIMITS)) + ")"
query("truncation_report", f"""WITH {CHANGES}, {_LIMITS} SELECT task, count(*) AS n_rows,
    round(avg((len({sql_words('old_contents')}) > sl)::INT), 6) AS source_cut,
    round(avg((len({sql_words('new_contents')}) > tl)::INT), 6) AS target_cut
    FROM changes JOIN limits ON i = doc_id % {len(TASK_LIMITS)} GROUP BY task""")(
    lambda spark, sf: rounded(truncation_report(_lengths(spark, sf), spark.createDataFrame(
        TASK_LIMITS, "task string, source_limit int, target_limit int")), "source_cut", "target_cut"))

# --- checkpoint selection: orders as epochs, fifty to a run ----------------------------------


def epochs(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 50).alias("run"), (F.col("o_orderkey") % 50).alias("epoch"),
        (cents % 97).cast("double").alias("bleu"), (cents % 89).cast("double").alias("em"),
        (cents % 83).cast("double").alias("codebleu"))
    return selection_score(o, "bleu", "em", "codebleu")


EPOCHS = """c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders),
    epochs AS (SELECT o_orderkey // 50 AS run, o_orderkey % 50 AS epoch,
        (cents % 97 + cents % 89 + cents % 83)::DOUBLE AS score FROM c),
    imp AS (SELECT *, score > greatest(coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) AS improved FROM epochs),
    mis AS (SELECT *, epoch - coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS misses FROM imp)"""

query("selection_score", f"WITH {EPOCHS} SELECT run, epoch, round(score, 4) AS score FROM epochs")(
    lambda spark, sf: rounded(epochs(spark, sf).select("run", "epoch", "score"), "score", digits=4))
query("replay_epochs", f"WITH {EPOCHS} SELECT run, epoch, improved::INTEGER AS improved, misses FROM mis")(
    lambda spark, sf: replay_epochs(epochs(spark, sf)).select("run", "epoch", F.col("improved").cast("int").alias("improved"), "misses"))


def _sql_stop(patience):
    return f"""WITH {EPOCHS}, stop AS (SELECT run, min(epoch) FILTER (misses > {patience}) AS stop_epoch FROM mis GROUP BY run)
    SELECT run, max(epoch) FILTER (improved) AS best_epoch, round(max(score) FILTER (improved), 4) AS best_score,
        max(stop_epoch) AS stop_epoch FROM mis JOIN stop USING (run)
    WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY run"""


for _name, _patience in (("early_stop", 3), ("early_stop_impatient", 1)):
    query(_name, _sql_stop(_patience))(
        lambda spark, sf, p=_patience: rounded(early_stop(epochs(spark, sf), patience=p), "best_score", digits=4))

query("running_loss", """SELECT o_orderkey // 50 AS run, o_orderkey % 50 + 1 AS step, floor(sum(round(o_totalprice * 100))
    OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) / (o_orderkey % 50 + 2))::BIGINT AS train_loss FROM orders""")(
    lambda spark, sf: running_loss(table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 50).alias("run"), (F.col("o_orderkey") % 50 + 1).alias("step"),
        F.round(F.col("o_totalprice") * 100).alias("loss"))).select(
        "run", "step", F.floor("train_loss").alias("train_loss")))
