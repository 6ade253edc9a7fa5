"""Queries that decode edit streams again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import let
from ..functions.draws import draw
from ..functions.text import words
from ..operators.scripts import COMMANDS, edit_streams, replay_commands, replay_tokens, trim_script
from .base import TOKEN_PAIRS, changes, query, sql_draw, sql_words

# One word in 500 of the new side is written like a keyword.
_RATE = 0.002


def _replayed(spark, sf):
    """Streams of pairs whose new sides hold keyword-like words, replayed and compared."""
    c = changes(spark, sf).select("doc_id", "lang", "old_contents", "new_contents")
    marked = F.transform(words("new_contents"), lambda t, i: F.when(draw("keyword", "doc_id", i + 1) < _RATE, "<KEEP>").otherwise(t))

    def compare(a, b, s):
        return F.struct(F.array_contains(b, "<KEEP>").cast("int").alias("m"), (replay_tokens(s["tokens"]) == b).cast("int").alias("t"),
                        (replay_commands(a, s["commands"]) == b).cast("int").alias("c"))

    row = let(lambda a, b: let(lambda ops: let(lambda s: compare(a, b, s), edit_streams(a, b, ops)), trim_script(a, b)),
              words("old_contents"), marked)
    # A generator keeps the row's result from being evaluated once per field.
    return c.select("lang", F.inline(F.array(row))).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("m").alias("marked"), F.sum("t").alias("by_tokens"), F.sum("c").alias("by_commands"))


_WORDS = sql_words("new_contents")
_PAIRS = TOKEN_PAIRS.replace(f"{_WORDS} AS b FROM changes", f"""list_transform({_WORDS}, lambda w, i:
        CASE WHEN {sql_draw('keyword', 'doc_id', 'i')} < {_RATE} THEN '<KEEP>' ELSE w END) AS b FROM changes""")
_NAMES = ", ".join(f"'{c}'" for c in COMMANDS)


def _labelled(label, part):
    return f"flatten(list_transform({part}, lambda t: ['{label}', t]))"


def _many(label, part):
    return f"list_transform({part}, lambda t: '{label}')"


query("replay_streams", f"""WITH {_PAIRS}, st AS MATERIALIZED (SELECT doc_id, lang, a, b,
        {_labelled('<KEEP>', 'head')} || CASE mid WHEN 'replace' THEN {_labelled('<REPLACE_OLD>', 'gone')} || {_labelled('<REPLACE_NEW>', 'came')}
            WHEN 'delete' THEN {_labelled('<DELETE>', 'gone')} WHEN 'insert' THEN {_labelled('<INSERT>', 'came')} ELSE [] END
            || {_labelled('<KEEP>', 'tail')} AS tokens,
        {_many('<KEEP>', 'head')} || CASE mid WHEN 'replace' THEN {_many('<REPLACE_OLD>', 'gone')} || {_labelled('<REPLACE_NEW>', 'came')}
            WHEN 'delete' THEN {_many('<DELETE>', 'gone')} WHEN 'insert' THEN {_labelled('<INSERT>', 'came')} ELSE [] END
            || {_many('<KEEP>', 'tail')} AS commands FROM token_pairs),
    tk AS (SELECT doc_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS k FROM st),
    ts AS (SELECT *, last_value(CASE WHEN t IN ({_NAMES}) THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM tk),
    tn AS (SELECT doc_id, list(t ORDER BY k) AS new FROM ts WHERE t NOT IN ({_NAMES})
        AND coalesce(state, '<KEEP>') IN ('<KEEP>', '<INSERT>', '<REPLACE_NEW>') GROUP BY doc_id),
    ot AS (SELECT doc_id, unnest(a) AS o, generate_subscripts(a, 1) - 1 AS r FROM st),
    ck AS (SELECT doc_id, unnest(commands) AS t, generate_subscripts(commands, 1) AS k FROM st),
    cs AS (SELECT *, coalesce(sum((t IN ('<KEEP>', '<DELETE>', '<REPLACE_OLD>'))::INT) OVER (PARTITION BY doc_id ORDER BY k
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM ck),
    cn AS (SELECT doc_id, list(CASE WHEN t = '<KEEP>' THEN o ELSE t END ORDER BY k) AS new FROM cs LEFT JOIN ot USING (doc_id, r)
        WHERE (t = '<KEEP>' AND o IS NOT NULL) OR t NOT IN ({_NAMES}) GROUP BY doc_id)
    SELECT lang, count(*) AS n_rows, count(*) FILTER (list_contains(b, '<KEEP>')) AS marked,
        count(*) FILTER (coalesce(tn.new, []) = b) AS by_tokens, count(*) FILTER (coalesce(cn.new, []) = b) AS by_commands
    FROM st LEFT JOIN tn USING (doc_id) LEFT JOIN cn USING (doc_id) GROUP BY lang""")(_replayed)
