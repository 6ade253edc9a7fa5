"""Early stop and running loss of training runs while their rows arrive.

A row may come in any order and more than once: rows ahead of a gap wait in the run's state,
rows already counted are passed over.  What is kept of a run is its next place, its running
values and the waiting rows, never its history.  The results are those of ``plans.selection``.

With ``idle_ms`` a run without a new row for so long has ended, and its state goes.  A stream
with such a timer always has another batch to run, so it does not end by itself: streams
triggered with ``availableNow`` leave it out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.selection import PATIENCE


def _timer(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def _in_order(pdfs: Iterator[pd.DataFrame], place: str, value: str, at: int, waiting: dict[int, float]
              ) -> Iterator[tuple[int, float]]:
    """(place, value) from ``at`` on without gaps; what cannot be placed yet stays in ``waiting``.

    The first value seen of a place counts.
    """
    for pdf in pdfs:
        for p, v in zip(pdf[place].tolist(), pdf[value].tolist()):
            if p >= at:
                waiting.setdefault(p, v)
        while at in waiting:
            yield at, waiting.pop(at)
            at += 1


def _beats(score: float, best: float) -> bool:
    """Greater in Spark's order, where NaN is the greatest."""
    return score > best or (math.isnan(score) and not math.isnan(best))


def _named(log: DataFrame, run: str, place: str, value: str, missing: float) -> DataFrame:
    """(run, place, value) with plain types; rows without a place are left out."""
    return log.where(F.col(place).isNotNull()).select(
        F.col(run), F.col(place).cast("long").alias("place"), F.coalesce(F.col(value).cast("double"), F.lit(missing)).alias("value"))


def stream_early_stop(log: DataFrame, run: str = "run", epoch: str = "epoch", score: str = "score",
                      patience: int = PATIENCE, start: float = -1.0, idle_ms: int | None = None) -> DataFrame:
    """(run, best_epoch, best_score, stop_epoch), once per run: at its stop, or when it has ended.

    A run stops at the first epoch with more than ``patience`` misses.  A run that ends without a
    stop is told with what it knows and a null ``stop_epoch``; of one that stopped only the state
    goes.  Epochs count from 0; what waits behind a missing epoch at the end does not count.  A null score beats nothing.
    """
    state_schema = ("next long, best_epoch long, best_score double, stop long, "
                    "late_epochs array<long>, late_scores array<double>")

    def told(key, best_epoch, best, stop) -> pd.DataFrame:
        known = best_epoch is not None
        return pd.DataFrame({run: [key[0]], "best_epoch": pd.array([best_epoch], "Int64"),
                             "best_score": pd.Series([best if known else None], dtype=object),
                             "stop_epoch": pd.array([stop], "Int64")})

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, best_epoch, best, stop, epochs, scores = state.get if state.exists else (0, None, start, None, [], [])
        if state.hasTimedOut:
            state.remove()
            if stop is None and at > 0:
                yield told(key, best_epoch, best, None)
            return
        waiting = dict(zip(epochs, scores))
        if stop is None:
            for at, value in _in_order(pdfs, "place", "value", at, waiting):
                if _beats(value, best):
                    best, best_epoch = value, at
                elif at - (-1 if best_epoch is None else best_epoch) > patience:
                    stop = at
                    waiting.clear()
                    yield told(key, best_epoch, best, stop)
                    break
                at += 1
        state.update((at, best_epoch, best, stop, list(waiting), list(waiting.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)

    out = f"`{run}` {dict(log.dtypes)[run]}, best_epoch long, best_score double, stop_epoch long"
    return _named(log, run, epoch, score, -math.inf).groupBy(run).applyInPandasWithState(
        step, out, state_schema, "append", _timer(idle_ms))


def stream_running_loss(steps: DataFrame, run: str = "run", step: str = "step", loss: str = "loss",
                        accumulate: int = 1, idle_ms: int | None = None) -> DataFrame:
    """(run, step, train_loss): summed loss over the steps seen plus one, where a round is full.

    Steps count from 1.  A null loss adds nothing.  Steps behind a gap are not shown.
    """
    state_schema = "next long, total double, late_steps array<long>, late_losses array<double>"

    def add(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, total, places, losses = state.get if state.exists else (1, 0.0, [], [])
        waiting, shown = dict(zip(places, losses)), []
        for place, value in _in_order(pdfs, "place", "value", at, waiting):
            at, total = place + 1, total + value
            if place % accumulate == 0:
                shown.append((place, total * accumulate / (place + 1)))
        state.update((at, total, list(waiting), list(waiting.values())))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        if shown:
            frame = pd.DataFrame(shown, columns=["step", "train_loss"])
            frame.insert(0, run, [key[0]] * len(shown))
            yield frame

    out = f"`{run}` {dict(steps.dtypes)[run]}, step long, train_loss double"
    return _named(steps, run, step, loss, 0.0).groupBy(run).applyInPandasWithState(
        add, out, state_schema, "append", _timer(idle_ms))
