"""Shared inputs of the registered queries and the SQL that states the same.

The driver tables hold prose, so (old, new) pairs are derived from them: every
document is an old side, and a drawn edit of its lines is the new side.  Deriving is
one projection per row, so the pairs grow with the table and have no hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import let
from ..functions.draws import draw
from ..functions.text import BLANK, LINE_BREAK, words
from ..layout import by_key
from ..operators.scripts import trim_script

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- derived inputs -----------------------------------------------------------

VOWELS, SHIFTED = "aeiou", "eioua"


def edited(text, seed: str, key: str) -> Column:
    """A drawn edit of each line: dropped, vowels shifted, preceded by a copy, or extended."""
    def edit(line, u):
        return (F.when(u < 0.10, F.array().cast("array<string>"))
                .when(u < 0.15, F.array(F.translate(line, VOWELS, SHIFTED)))
                .when(u < 0.20, F.array(F.concat(F.lit("new: "), line), line))
                .when(u < 0.25, F.array(F.concat(line, F.lit(" edited"))))
                .otherwise(F.array(line)))

    parts = F.split(text, "\n", -1)
    return F.array_join(F.flatten(F.transform(
        parts, lambda ln, i: let(lambda u: edit(ln, u), draw(seed, key, i + 1)))), "\n")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, hashed by their key.

    Work per row is heavy here (lexing, edits, n-grams), so one exchange of the rows pays
    for even tasks, whatever the files look like.
    """
    return by_key(table(spark, sf, "documents"), "doc_id")


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, commit, repos, lang, message, old_contents, new_contents)."""
    return changes_of(documents(spark, sf))


def changes_of(d: DataFrame) -> DataFrame:
    """The changes of documents, wherever these are laid out."""
    return d.select("doc_id", F.col("doc_id").cast("string").alias("commit"),
                    F.col("source").alias("repos"), "lang",
                    F.substring_index("text", "\n", 1).alias("message"),
                    F.col("text").alias("old_contents"),
                    edited(F.col("text"), "edit", "doc_id").alias("new_contents"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, lang, text): the sides of a row are the expressions below."""
    return documents(spark, sf).select(F.col("doc_id").alias("row_id"), "lang", "text")


def src_words() -> Column:
    return words("text")


def gold_words() -> Column:
    return words(edited(F.col("text"), "edit", "row_id"))


def pred_words() -> Column:
    return words(edited(F.col("text"), "pred", "row_id"))


def conversation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, role, pred, gold): a turn and the next one there is."""
    paired = next_in_order(table(spark, sf, "conversations"), "conv_id", "turn", "text", "gold")
    return paired.where(F.col("gold").isNotNull()).select(
        F.concat_ws("-", "conv_id", "turn").alias("row_id"), "role", F.col("text").alias("pred"), "gold")


def next_in_order(df: DataFrame, group: str, order: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """``df`` with the ``value`` of the next row of its group, null at the end; numbers may have gaps.

    A group is cut into blocks of ``order``; the last row of a block takes the first value of
    the next block there is, so a very long group is spread over many tasks.
    """
    blocked = df.withColumn("_blk", F.floor(F.col(order) / block)).repartition(group, "_blk")
    inside = F.lead(value).over(W.partitionBy(group, "_blk").orderBy(order))
    firsts = blocked.groupBy(group, "_blk").agg(F.min_by(value, order).alias("_first"))
    carried = firsts.withColumn("_next", F.lead("_first").over(W.partitionBy(group).orderBy("_blk")))
    last = F.row_number().over(W.partitionBy(group, "_blk").orderBy(F.desc(order))) == 1
    return (blocked.withColumn(out, inside).withColumn("_last", last)
            .join(carried.select(group, "_blk", "_next"), [group, "_blk"])
            .withColumn(out, F.when(F.col("_last"), F.col("_next")).otherwise(F.col(out)))
            .drop("_blk", "_last", "_next"))


def token_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, lang, type, nl_tokens, old_tokens, new_tokens, ops) with trim scripts."""
    c = changes(spark, sf)
    staged = c.select("doc_id", "lang", words("message").alias("nl_tokens"),
                      words("old_contents").alias("old_tokens"),
                      words("new_contents").alias("new_tokens"))
    return staged.withColumn("ops", trim_script("old_tokens", "new_tokens"))


# --- the same in SQL ----------------------------------------------------------

def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A{BLANK}+|{BLANK}+\\z', '', 'g')"


def sql_lines(x: str) -> str:
    """splitlines: no empty last line."""
    parts = f"regexp_split_to_array({x}, '{LINE_BREAK}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def sql_draw(seed: str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", *keys])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def sql_join(x: str, sep: str = "' '") -> str:
    return f"coalesce(array_to_string({x}, {sep}), '')"


def sql_edited(text: str, seed: str, key: str) -> str:
    u = sql_draw(seed, key, "i")
    return f"""array_to_string(flatten(list_transform(string_split({text}, chr(10)), lambda ln, i:
        CASE WHEN {u} < 0.10 THEN []::VARCHAR[]
             WHEN {u} < 0.15 THEN [translate(ln, '{VOWELS}', '{SHIFTED}')]
             WHEN {u} < 0.20 THEN ['new: ' || ln, ln]
             WHEN {u} < 0.25 THEN [ln || ' edited']
             ELSE [ln] END)), chr(10))"""


CHANGES = f"""changes AS MATERIALIZED (
    SELECT doc_id, CAST(doc_id AS VARCHAR) AS "commit", source AS repos, lang,
           split_part(text, chr(10), 1) AS message, text AS old_contents,
           coalesce({sql_edited('text', 'edit', 'doc_id')}, '') AS new_contents
    FROM documents)"""

PREDICTIONS = f"""predictions AS MATERIALIZED (
    SELECT doc_id AS row_id, lang, {sql_words('text')} AS source,
           {sql_words("coalesce(" + sql_edited('text', 'edit', 'doc_id') + ", '')")} AS gold,
           {sql_words("coalesce(" + sql_edited('text', 'pred', 'doc_id') + ", '')")} AS pred
    FROM documents)"""

CONVERSATION_PAIRS = """conversation_pairs AS MATERIALIZED (
    SELECT conv_id || '-' || turn AS row_id, role, text AS pred, nx AS gold
    FROM (SELECT conv_id, turn, role, text,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) z
    WHERE nx IS NOT NULL)"""

# Trim scripts: p common leading, s common trailing tokens, n and m lengths.
TOKEN_PAIRS = CHANGES + f""", tp0 AS MATERIALIZED (
    SELECT doc_id, lang, {sql_words('message')} AS nl, {sql_words('old_contents')} AS a,
           {sql_words('new_contents')} AS b FROM changes),
tp1 AS MATERIALIZED (
    SELECT *, len(a) AS n, len(b) AS m,
           coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1),
                    lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) AS p FROM tp0),
tp2 AS MATERIALIZED (
    SELECT *, coalesce(list_position(list_transform(range(0, least(n, m) - p),
                    lambda i: a[n - i] = b[m - i]), false) - 1, least(n, m) - p) AS s FROM tp1),
token_pairs AS MATERIALIZED (
    SELECT *, n - s - p AS dn, m - s - p AS dm,
           CASE WHEN n - s > p AND m - s > p THEN 'replace' WHEN n - s > p THEN 'delete'
                WHEN m - s > p THEN 'insert' END AS mid,
           a[1:p] AS head, a[p + 1:n - s] AS gone, b[p + 1:m - s] AS came, a[n - s + 1:n] AS tail
    FROM tp2)"""

# Longest matching blocks of the sides: equal tokens, runs on diagonals, then intervals split at their best run.
def sql_block_edits(sides: str) -> str:
    """edits and ops as ``sql_edits`` gives them."""
    interval = "PARTITION BY doc_id, alo, ahi, blo, bhi ORDER BY n DESC, i, d"
    block = f"""SELECT *, greatest(bs.fi, alo, blo - bs.d) AS x, least(bs.fi + bs.fn, ahi, bhi - bs.d) AS e, bs.d AS bd FROM (
        SELECT *, first_value({{'fi': fi, 'fn': fn, 'd': d}}) OVER ({interval}) AS bs FROM b_s)"""
    return f"""b_o AS (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS i FROM {sides}),
    b_n AS (SELECT *, m >= 200 AND count(*) OVER (PARTITION BY doc_id, t) > m // 100 + 1 AS popular FROM (
        SELECT doc_id, len(b) AS m, unnest(b) AS t, generate_subscripts(b, 1) - 1 AS j FROM {sides})),
    b_f AS (SELECT doc_id, i, j - i AS d, popular, i - row_number() OVER (PARTITION BY doc_id, j - i ORDER BY i) AS g
        FROM b_o JOIN b_n USING (doc_id, t)),
    b_h AS (SELECT *, min(i) OVER f AS fi, count(*) OVER f AS fn FROM b_f WINDOW f AS (PARTITION BY doc_id, d, g)),
    b_c AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS h FROM b_h WHERE NOT popular),
    b_r AS MATERIALIZED (SELECT doc_id, d, min(i) AS i, count(*) AS n, any_value(fi) AS fi, any_value(fn) AS fn FROM b_c GROUP BY doc_id, d, h),
    b_s AS (SELECT doc_id, 0 AS alo, len(a) AS ahi, 0 AS blo, len(b) AS bhi, i, d, n, fi, fn FROM b_r JOIN {sides} USING (doc_id)
        UNION ALL SELECT doc_id, lo, hi, lo2, hi2, s, d, e2 - s, fi, fn FROM (
            SELECT *, greatest(i, lo, lo2 - d) AS s, least(i + n, hi, hi2 - d) AS e2 FROM (
                SELECT *, unnest([alo, e]) AS lo, unnest([x, ahi]) AS hi, unnest([blo, e + bd]) AS lo2, unnest([x + bd, bhi]) AS hi2
                FROM ({block}))) WHERE e2 > s),
    b_b AS (SELECT DISTINCT doc_id, x, x + bd AS y, e - x AS z FROM ({block})),
    b_a AS (SELECT * FROM b_b UNION ALL SELECT doc_id, len(a), len(b), 0 FROM {sides}),
    b_g AS (SELECT doc_id, coalesce(lag(x + z) OVER w, 0) AS i0, x AS i9, coalesce(lag(y + z) OVER w, 0) AS j0, y AS j9
        FROM b_a WINDOW w AS (PARTITION BY doc_id ORDER BY x, y, z DESC)),
    b_x AS (SELECT g.*, a[i0 + 1:i9] AS l, b[j0 + 1:j9] AS r FROM b_g g JOIN {sides} USING (doc_id) WHERE i9 > i0 OR j9 > j0),
    b_p AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(l), len(r)) + 1), lambda i: l[i] = r[i]), false) - 1,
        least(len(l), len(r))) AS p FROM b_x),
    edits AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i0, j0) - 1 AS k, (i0 + p)::INTEGER AS i1,
        i9::INTEGER AS i2, (j0 + p)::INTEGER AS j1, j9::INTEGER AS j2 FROM b_p WHERE i0 + p < i9 OR j0 + p < j9),
    {sql_ops(sides)}"""


# Anchored scripts of the sides (doc_id, a, b) of a CTE: tokens once on each side that cross no
# other such token are anchors; between two anchors, prefix and suffix are taken off.
def sql_edits(sides: str) -> str:
    """edits(doc_id, k, i1, i2, j1, j2) and ops(doc_id, idx, tag, i1, i2, j1, j2), idx from 1."""
    return f"""e_t AS (SELECT doc_id, 0 AS side, unnest(a) AS t, generate_subscripts(a, 1) - 1 AS ps FROM {sides} UNION ALL
        SELECT doc_id, 1, unnest(b), generate_subscripts(b, 1) - 1 FROM {sides}),
    e_u AS (SELECT doc_id, max(ps) FILTER (side = 0) AS i, max(ps) FILTER (side = 1) AS j FROM e_t GROUP BY doc_id, t
        HAVING count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1),
    e_c AS (SELECT *, max(j) OVER (PARTITION BY doc_id ORDER BY i) AS hi, min(j) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lo FROM e_u),
    e_a AS (SELECT doc_id, i, j FROM e_c WHERE j = hi AND j = lo UNION ALL SELECT doc_id, len(a), len(b) FROM {sides}),
    e_g AS (SELECT doc_id, coalesce(lag(i) OVER w, -1) + 1 AS i0, i AS i9, coalesce(lag(j) OVER w, -1) + 1 AS j0, j AS j9
        FROM e_a WINDOW w AS (PARTITION BY doc_id ORDER BY i, j)),
    e_x AS (SELECT g.*, a[i0 + 1:i9] AS x, b[j0 + 1:j9] AS y FROM e_g g JOIN {sides} USING (doc_id) WHERE i9 > i0 OR j9 > j0),
    e_p AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] = y[i]), false) - 1,
        least(len(x), len(y))) AS p FROM e_x),
    e_s AS (SELECT *, coalesce(list_position(list_transform(range(0, least(len(x), len(y)) - p),
        lambda i: x[len(x) - i] = y[len(y) - i]), false) - 1, least(len(x), len(y)) - p) AS s FROM e_p),
    edits AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i0, j0) - 1 AS k, (i0 + p)::INTEGER AS i1,
        (i9 - s)::INTEGER AS i2, (j0 + p)::INTEGER AS j1, (j9 - s)::INTEGER AS j2 FROM e_s WHERE i0 + p < i9 - s OR j0 + p < j9 - s),
    {sql_ops(sides)}"""


def sql_ops(sides: str) -> str:
    """ops(doc_id, idx, tag, i1, i2, j1, j2) of edits(doc_id, k, i1, i2, j1, j2)."""
    return f"""e_k AS (SELECT doc_id, coalesce(lag(i2) OVER w, 0) AS i1, i1 AS i2, coalesce(lag(j2) OVER w, 0) AS j1, j1 AS j2
        FROM edits WINDOW w AS (PARTITION BY doc_id ORDER BY k) UNION ALL
        SELECT s.doc_id, coalesce(max(i2), 0), len(any_value(a)), coalesce(max(j2), 0), len(any_value(b))
        FROM {sides} s LEFT JOIN edits e ON e.doc_id = s.doc_id GROUP BY s.doc_id),
    e_o AS (SELECT doc_id, 'equal' AS tag, i1, i2, j1, j2 FROM e_k WHERE i1 < i2 UNION ALL
        SELECT doc_id, CASE WHEN i1 < i2 AND j1 < j2 THEN 'replace' WHEN i1 < i2 THEN 'delete' ELSE 'insert' END, i1, i2, j1, j2 FROM edits),
    ops AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i1, j1, i2, j2) AS idx FROM e_o)"""


# N-gram counts of the sides in PREDICTIONS, as grams(row_id, lang, n, gram, h, r, s).
_RUNS = " UNION ALL ".join(
    f"""SELECT row_id, lang, {n} AS n, '{side}' AS side, unnest(list_transform(
        range(1, len({col}) - {n} + 2), lambda i: array_to_string({col}[i:i + {n - 1}], chr(31)))) AS gram
    FROM predictions"""
    for side, col in (("h", "pred"), ("r", "gold"), ("s", "source")) for n in (1, 2, 3, 4))
GRAMS = PREDICTIONS + f""", grams AS MATERIALIZED (
    SELECT row_id, lang, n, gram, count(*) FILTER (side = 'h') AS h,
           count(*) FILTER (side = 'r') AS r, count(*) FILTER (side = 's') AS s
    FROM ({_RUNS}) GROUP BY ALL)"""


def sql_stats(keywords: list[str] | None = None) -> str:
    """stats(row_id, lang, hyp_len, ref_len, m1.., h1.., r1.., wm, wr) from GRAMS."""
    cols = []
    for n in (1, 2, 3, 4):
        cols += [f"coalesce(sum(least(h, r)) FILTER (n = {n}), 0)::BIGINT AS m{n}",
                 f"coalesce(sum(h) FILTER (n = {n}), 0)::BIGINT AS h{n}",
                 f"coalesce(sum(r) FILTER (n = {n}), 0)::BIGINT AS r{n}"]
    if keywords:
        inlist = ", ".join(f"'{k}'" for k in keywords)
        w = f"(CASE WHEN gram IN ({inlist}) THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END)"
        cols += [f"coalesce(sum(least(h, r) * {w}) FILTER (n = 1), 0) AS wm",
                 f"coalesce(sum(r * {w}) FILTER (n = 1), 0) AS wr"]
    return f"""gstats AS (SELECT row_id, {', '.join(cols)} FROM grams GROUP BY row_id),
stats AS (SELECT p.row_id, p.lang, len(p.pred) AS hyp_len, len(p.gold) AS ref_len,
          g.* EXCLUDE (row_id) FROM predictions p JOIN gstats g ON p.row_id = g.row_id)"""


def sql_brevity(ref: str, hyp: str) -> str:
    return (f"(CASE WHEN {hyp} > {ref} THEN 1.0::DOUBLE WHEN {hyp} = 0 THEN 0.0::DOUBLE "
            f"ELSE exp(1 - {ref}::DOUBLE / {hyp}) END)")
