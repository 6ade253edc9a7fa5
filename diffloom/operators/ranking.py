"""Global ranks, shards, samples and running aggregates without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import as_col
from ..functions.draws import digest

BUCKET_HEX = 3  # 16**3 = 4096 buckets


def shuffled_rank(df: DataFrame, seed: str, key: str, out: str = "rank", total: str | None = None,
                  bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """Dense zero-based rank of rows in the order of their draw: a seeded full shuffle.

    Only keys and draws are ranked; other columns are joined back by the key, which is
    unique.  Keys are bucketed by the leading digits of the draw, ranked by a window per
    bucket, and the start of each bucket is a running count over at most
    ``16**bucket_hex`` rows, which is what gets broadcast, with the ``total`` if asked for.
    Draws are hashes of unique keys, so buckets are even whatever the data looks like.
    """
    narrow = df.select(key, digest(seed, key).alias("_d")).withColumn("_b", F.substring("_d", 1, bucket_hex))
    every = W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    starts = narrow.groupBy("_b").agg(F.count("*").alias("_n")).select(
        "_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_start"),
        *([F.sum("_n").over(every).alias(total)] if total else []))
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_d", key)) - 1
    ranked = (narrow.withColumn("_in", inside).join(F.broadcast(starts), "_b")
              .select(key, (F.col("_start") + F.col("_in")).cast("long").alias(out), *([total] if total else [])))
    if df.columns == [key]:
        return ranked
    return df.join(ranked, key).select(*df.columns, out, *([total] if total else []))


def shard_of(rank, total, k: int = 30) -> Column:
    """Even shards by rank; the last one also takes the remainder."""
    size = F.floor(as_col(total) / F.lit(k))
    return F.when(size == 0, F.lit(k - 1)).otherwise(
        F.least(F.floor(as_col(rank) / size), F.lit(k - 1))).cast("int")


def with_shards(df: DataFrame, seed: str, key: str, k: int = 30) -> DataFrame:
    ranked = shuffled_rank(df, seed, key, total="_total")
    return ranked.withColumn("shard", shard_of("rank", "_total", k)).drop("_total")


def trainer_slots(df: DataFrame, seed: str, key: str, workers: int) -> DataFrame:
    """Round-robin rows over trainers; the remainder that does not fill a round is left out."""
    ranked = shuffled_rank(df, seed, key, total="_total")
    even = F.col("_total") - F.pmod(F.col("_total"), F.lit(workers))
    return (ranked.where(F.col("rank") < even)
            .withColumn("slot", F.pmod("rank", F.lit(workers)).cast("int")).drop("_total"))


def drawn_subset(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """``n`` rows chosen by draw: a top-k, so each task keeps only ``n`` rows."""
    return df.orderBy(digest(seed, key), key).limit(n)


def epoch_order(df: DataFrame, seed: int, epoch: int, key: str) -> DataFrame:
    """A new full shuffle per epoch."""
    return shuffled_rank(df, f"epoch-{seed + epoch}", key)


def shard_number(name) -> Column:
    """The number in ``...-<n>.<ext>``."""
    return F.regexp_extract(as_col(name), r"-([0-9]+)\.[^/]*$", 1).cast("int")


def running(df: DataFrame, run: str, step: str, aggs: dict[str, Column], *,
            include_current: bool, block: int = 4096) -> DataFrame:
    """Running max/sum per run in step order, for runs of any length.

    ``aggs`` maps an output name to ``(function name, column)``.  A run is cut into
    blocks of steps; blocks are aggregated first, their running values joined back and
    combined with a window inside the block.  No task ever sees a whole long run.
    """
    merge = {"max": F.greatest, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    fn = {"max": F.max, "sum": F.sum}
    # Blocks are laid out once: their totals and the windows inside read the same exchange.
    blocked = df.withColumn("_blk", F.floor(F.col(step) / block)).repartition(run, "_blk")
    per_block = blocked.groupBy(run, "_blk").agg(
        *[fn[f](c).alias(f"_t_{name}") for name, (f, c) in aggs.items()])
    before = (W.partitionBy(run).orderBy("_blk")
              .rowsBetween(W.unboundedPreceding, -1))
    carried = per_block.select(run, "_blk", *[
        fn[f](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (f, _) in aggs.items()])
    inner = (W.partitionBy(run, "_blk").orderBy(step)
             .rowsBetween(W.unboundedPreceding, W.currentRow if include_current else -1))
    local = blocked.select("*", *[fn[f](c).over(inner).alias(f"_l_{name}")
                                  for name, (f, c) in aggs.items()])
    joined = local.join(carried, [run, "_blk"])
    for name, (f, _) in aggs.items():
        joined = joined.withColumn(name, merge[f](F.col(f"_c_{name}"), F.col(f"_l_{name}")))
    return joined.select(*df.columns, *aggs)
