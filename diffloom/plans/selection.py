"""Checkpoint selection over a metrics log (run, epoch, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import running

PATIENCE = 3


def selection_score(df: DataFrame, *parts: str, out: str = "score") -> DataFrame:
    """The sum that picks a checkpoint."""
    cols = [F.col(p) for p in parts]
    return df.withColumn(out, sum(cols[1:], cols[0]))


def replay_epochs(log: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score",
                  start: float = -1.0) -> DataFrame:
    """Per epoch: whether it beat everything before (and ``start``), and the misses since.

    Epochs of a run count from 0 without gaps.
    """
    # The running best is (score, earliest epoch): it changes exactly where a score beats
    # everything before, so one running value tells improvements and the misses since.
    beats = F.when(F.col(score) > start, F.struct(F.col(score).alias("s"), (-F.col(epoch)).alias("e")))
    seen = running(log, run, epoch, {"_best": ("max", beats)}, include_current=True)
    at = -F.col("_best.e")
    return (seen.withColumn("improved", F.coalesce(at == F.col(epoch), F.lit(False)))
            .withColumn("best_so_far", at).withColumn("best_score_so_far", F.col("_best.s")).drop("_best")
            .withColumn("misses", (F.col(epoch) - F.coalesce("best_so_far", F.lit(-1))).cast("long")))


def early_stop(log: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score",
               patience: int = PATIENCE) -> DataFrame:
    """(run, best_epoch, best_score, stop_epoch): stop when misses exceed ``patience``.

    Epochs after the stop do not count; ``stop_epoch`` is null for runs that end first.
    """
    played = replay_epochs(log, run, epoch, score)
    best = F.struct(F.col("best_so_far").alias("e"), F.col("best_score_so_far").alias("s"))
    over = F.col("misses") > patience
    # What is best at the stop is known there; without a stop it is what is best at the end.
    ends = played.groupBy(run).agg(
        F.min(F.when(over, F.col(epoch))).alias("stop_epoch"), F.min_by(best, F.when(over, F.col(epoch))).alias("at_stop"),
        F.max_by(best, F.col(epoch)).alias("at_end"))
    last = F.when(F.col("stop_epoch").isNotNull(), F.col("at_stop")).otherwise(F.col("at_end"))
    return ends.withColumn("_last", last).select(
        run, F.col("_last.e").alias("best_epoch"), F.col("_last.s").alias("best_score"), "stop_epoch")


def running_loss(steps: DataFrame, run: str = "run", step: str = "step", loss: str = "loss",
                 accumulate: int = 1) -> DataFrame:
    """The loss shown while training: summed loss over steps seen plus one.

    ``step`` counts from 1; shown only where an accumulation round is full.
    """
    summed = running(steps, run, step, {"_sum": ("sum", F.col(loss))}, include_current=True)
    shown = summed.where(F.pmod(F.col(step), F.lit(accumulate)) == 0)
    return shown.withColumn(
        "train_loss", F.col("_sum") * accumulate / (F.col(step) + 1)).drop("_sum")
