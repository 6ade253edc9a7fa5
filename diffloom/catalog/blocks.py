"""Queries of longest-matching-block scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import once
from ..functions.text import words
from ..operators.blocks import block_hunks, with_block_script
from ..operators.hunks import changed_lines
from ..operators.scripts import edit_profile
from .base import CHANGES, changes, query, sql_block_edits, sql_edits, sql_words
from .changes import _HUNKS

_SIDES = f"""{CHANGES}, sides AS MATERIALIZED (SELECT doc_id, lang, {sql_words('old_contents')} AS a, {sql_words('new_contents')} AS b
    FROM changes), {sql_block_edits('sides')}"""


def block_scripted(spark, sf):
    p = changes(spark, sf).select("doc_id", "lang", words("old_contents").alias("a"), words("new_contents").alias("b"))
    return with_block_script(p, "a", "b")


query("block_script", f"WITH RECURSIVE {_SIDES} SELECT doc_id, tag, i1, i2, j1, j2 FROM ops")(
    lambda spark, sf: block_scripted(spark, sf).select("doc_id", F.inline(once("ops"))))

query("block_script_profile", f"""WITH RECURSIVE {_SIDES}, w AS (SELECT doc_id, CASE tag WHEN 'equal' THEN '<KEEP>' WHEN 'delete' THEN '<DELETE>'
        ELSE '<REPLACE_OLD>' END AS keyword, i2 - i1 AS n FROM ops WHERE tag <> 'insert' UNION ALL
        SELECT doc_id, CASE tag WHEN 'insert' THEN '<INSERT>' ELSE '<REPLACE_NEW>' END, j2 - j1 FROM ops WHERE tag IN ('insert', 'replace'))
    SELECT lang, keyword, sum(n)::BIGINT AS tokens FROM w JOIN sides USING (doc_id) GROUP BY ALL""")(
    lambda spark, sf: edit_profile(block_scripted(spark, sf), "ops", "lang"))

query("block_hunks", f"""WITH RECURSIVE {_HUNKS.replace(sql_edits('sides'), sql_block_edits('sides'))}
    SELECT "commit", repos, message, string_agg(hunk, chr(10) ORDER BY g) AS diff, count(*) AS n_hunks FROM hunks GROUP BY ALL""")(
    lambda spark, sf: block_hunks(changed_lines(changes(spark, sf))).select(
        "commit", "repos", "message", F.array_join("hunks", "\n").alias("diff"), F.size("hunks").alias("n_hunks")))
