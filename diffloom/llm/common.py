"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import as_col
from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: ASCII characters that are not part of a word, after A-Z are lower-cased.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NON_WORD_CHARS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

__all__ = ["as_col", "ascii_lower", "fresh", "hot_keys", "materialize", "normalized_words", "parts", "table", "tokenizer_path", "whole"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """The number of shuffle partitions the cluster sets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole(c: Column | str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(as_col(c), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all other characters as they are.

    ``lower`` does just that to pure ASCII and is much faster than ``translate``.
    """
    return (F.when(F.length(c) == F.octet_length(c), F.lower(c))
            .otherwise(F.translate(c, UPPER, LOWER)))


def normalized_words(c: Column | str) -> Column:
    """Words of a text with A-Z lower-cased; an empty array for a null or wordless text."""
    inner = F.btrim(ascii_lower(whole(c)), F.lit(NON_WORD_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, NON_WORD, -1))


def hot_keys(df: DataFrame, key: str, limit: int, slices: str = "slices") -> DataFrame:
    """(key, slices): the keys with more than ``limit`` rows, and how many slices they need.

    Counted exactly, pre-aggregated before the shuffle.  At most rows / limit keys come
    out, so with ``limit`` = rows / (2 * partitions) the result may be broadcast.
    """
    return (df.groupBy(key).count().where(F.col("count") > limit)
            .select(key, F.ceil(F.col("count") / limit).alias(slices)))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is installed."""
    import public_tokenizers
    return public_tokenizers.path(name)
