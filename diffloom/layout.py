"""Row layout: where a shuffle goes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by ``keys``; adaptive execution sizes the parts.

    Done on the narrow input, before a row is exploded: aggregations whose keys
    include ``keys`` then need no further shuffle.  The same plan for inputs of any size.
    """
    return df.repartition(*keys)


def parts_for(df: DataFrame, each: int) -> int:
    """Parts of about ``each`` bytes of the estimated size of ``df``; at least what the session asks for, at most 2,000."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // each, 2000))


def by_repeats(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys occur once, which need no grouping, and the others (null keys among them).

    Only keys are counted; without any that repeat, adaptive execution drops the join.
    """
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    repeated = df.where(some).groupBy(*keys).count().where("count > 1").select(*keys)
    once = df.where(some).join(repeated, [*keys], "left_anti")
    return once, df.where(~some).unionByName(df.where(some).join(repeated, [*keys], "left_semi"))
