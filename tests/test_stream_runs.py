"""Streams of training runs against the batch results, over shuffled arrival and a restart."""

import random
import time

import pytest

from diffloom.plans.selection import early_stop, running_loss
from diffloom.streaming.runs import stream_early_stop, stream_running_loss


def arriving(spark, folder, rows, schema, parts, seed):
    """The rows dealt over ``parts`` files in any order, some of them twice."""
    rng = random.Random(seed)
    rows = rows + rng.sample(rows, len(rows) // 4)
    rng.shuffle(rows)
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def play(stream, out, checkpoint):
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def seen(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_early_stop_of_a_stream(spark, tmp_path, few_partitions):
    """Stopped runs after a restart half way, the others when they have ended."""
    rng = random.Random(4)
    rows = [(f"r{k}", e, rng.choice([None, rng.random(), rng.random() + 0.05 * e]))
            for k in range(12) for e in range(rng.randint(1, 14))]
    schema = "run string, epoch int, score double"
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    cut = len(rows) // 2
    mixed = random.Random(1).sample(rows, len(rows))
    play(stream_early_stop(arriving(spark, folder, mixed[:cut], schema, 2, 5)), out, check)
    play(stream_early_stop(arriving(spark, folder, mixed[cut:], schema, 2, 6)), out, check)
    want = early_stop(spark.createDataFrame(rows, schema)).select("run", "best_epoch", "best_score", "stop_epoch").collect()
    stopped = sorted(tuple(r) for r in want if r["stop_epoch"] is not None)
    assert 0 < len(stopped) < len(want)
    assert seen(spark.read.parquet(out)) == stopped

    # The whole log in one stream whose idle time is short: every run is told once.
    query = (stream_early_stop(spark.readStream.schema(schema).parquet(folder), idle_ms=3000).writeStream.format("memory")
             .queryName("told").outputMode("append").start())
    try:
        limit = time.time() + 60
        while time.time() < limit and spark.table("told").count() < len(want):
            time.sleep(1)
        assert sorted(map(str, spark.table("told").collect())) == sorted(map(str, want))
    finally:
        query.stop()


def test_running_loss_of_a_stream(spark, tmp_path, few_partitions):
    rng = random.Random(7)
    rows = [(k, s, rng.random()) for k in range(5) for s in range(1, 40)]
    schema = "run long, step int, loss double"
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    cut = len(rows) // 2
    mixed = rng.sample(rows, len(rows))
    play(stream_running_loss(arriving(spark, folder, mixed[:cut], schema, 2, 8), accumulate=3), out, check)
    play(stream_running_loss(arriving(spark, folder, mixed[cut:], schema, 2, 9), accumulate=3), out, check)
    got = seen(spark.read.parquet(out))
    want = seen(running_loss(spark.createDataFrame(rows, schema), accumulate=3).select("run", "step", "train_loss"))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want])
