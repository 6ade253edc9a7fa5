"""The scalar operators and tables from SQL text: ``register(spark, tables)`` once a session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .functions.text import BLANK, LINE_BREAK

#: name(parameters) and type of each function, and what it returns; later ones may call earlier ones.
FUNCTIONS = {
    "dl_words(x STRING) RETURNS ARRAY<STRING>": f"filter(split(x, r'{BLANK}+', -1), w -> w <> '')",
    "dl_collapse(x STRING) RETURNS STRING": "array_join(dl_words(x), ' ')",
    "dl_strip(x STRING) RETURNS STRING": rf"regexp_replace(x, r'\A{BLANK}+|{BLANK}+\z', '')",
    "dl_lines(x STRING) RETURNS ARRAY<STRING>": (
        f"CASE WHEN element_at(split(x, r'{LINE_BREAK}', -1), -1) = '' THEN slice(split(x, r'{LINE_BREAK}', -1), 1, "
        f"size(split(x, r'{LINE_BREAK}', -1)) - 1) ELSE split(x, r'{LINE_BREAK}', -1) END"),
    "dl_first_line(x STRING) RETURNS STRING": r"substring_index(x, '\n', 1)",
    "dl_ngrams(t ARRAY<STRING>, n INT) RETURNS ARRAY<ARRAY<STRING>>": (
        "CASE WHEN size(t) >= n THEN transform(sequence(1, size(t) - n + 1), i -> slice(t, i, n)) "
        "ELSE CAST(array() AS ARRAY<ARRAY<STRING>>) END"),
    "dl_draw(seed STRING, key STRING) RETURNS DOUBLE": (
        "CAST(conv(substring(md5(concat_ws('|', seed, key)), 1, 8), 16, 10) AS DOUBLE) / 4294967296D"),
    "dl_is_change(a STRING, b STRING) RETURNS BOOLEAN": "a <> '' AND b <> '' AND a <> b",
}


def register(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> None:
    """Make the functions callable from SQL text in this session, and ``tables`` readable by name.

    Functions are SQL expressions, so plans stay what the column functions give: no Python.
    """
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
