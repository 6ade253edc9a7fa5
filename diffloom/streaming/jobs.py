"""Structured Streaming jobs.

Commit preparation is stateless per row, so the batch functions take a stream as they
are.  Scores are sums of per-row statistics: each micro-batch adds its sums to a small
table and the closed form is read off the totals, so no n-gram is ever kept as state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators.scores import bleu_form, pair_stats, total
from ..plans.corpus import hunked


def stream_commits(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schemas.COMMITS)
            .option("maxFilesPerTrigger", files_per_trigger).json(path))


def stream_hunks(commits: DataFrame) -> DataFrame:
    """(commit, repos, msg, hunks) of arriving commits that change a line."""
    return hunked(commits)


def start_hunks(commits: DataFrame, path: str, checkpoint: str, available_now: bool = False
                ) -> StreamingQuery:
    writer = (stream_hunks(commits).writeStream.format("parquet")
              .option("checkpointLocation", checkpoint).outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def start_scores(preds: DataFrame, path: str, checkpoint: str, key: str, hyp: str, ref: str,
                 *slices: str, available_now: bool = False) -> StreamingQuery:
    """Sums of pair statistics per slice and batch, one directory per batch id.

    A replayed batch overwrites its own directory, so nothing is counted twice.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        sums = total(pair_stats(batch, [key, *slices], hyp, ref).drop(key), *slices)
        sums.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (preds.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
              .outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scores(spark: SparkSession, path: str, *slices: str) -> DataFrame:
    """The score over everything that has arrived."""
    sums = spark.read.parquet(path).drop("batch_id")
    return bleu_form(total(sums, *slices))
