"""A query that is SQL text over the registered functions and views."""

from __future__ import annotations

from ..sql import register
from .base import changes, query, CHANGES, sql_draw, sql_lines, sql_strip, sql_words


def _surface(spark, sf):
    register(spark, {"dl_changes": changes(spark, sf)})
    return spark.sql("""
        SELECT doc_id, CAST(size(dl_words(old_contents)) AS BIGINT) AS n_words, md5(dl_collapse(new_contents)) AS collapsed,
               CAST(size(dl_lines(new_contents)) AS BIGINT) AS n_lines, dl_strip(dl_first_line(old_contents)) AS title,
               CAST(size(dl_ngrams(dl_words(new_contents), 3)) AS BIGINT) AS n_grams,
               dl_draw('surface', CAST(doc_id AS STRING)) AS u, dl_is_change(old_contents, new_contents) AS changed
        FROM dl_changes""")


query("sql_surface", f"""WITH {CHANGES} SELECT doc_id, len({sql_words('old_contents')}) AS n_words,
    md5(coalesce(array_to_string({sql_words('new_contents')}, ' '), '')) AS collapsed, len({sql_lines('new_contents')}) AS n_lines,
    {sql_strip("split_part(old_contents, chr(10), 1)")} AS title, greatest(len({sql_words('new_contents')}) - 2, 0) AS n_grams,
    {sql_draw('surface', 'CAST(doc_id AS VARCHAR)')} AS u,
    old_contents <> '' AND new_contents <> '' AND old_contents <> new_contents AS changed FROM changes""")(_surface)
