"""Sinks: JSON lines, shards, feature tables and the metrics log."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import strip

METRICS = T.StructType([T.StructField("run", T.StringType()), T.StructField("epoch", T.IntegerType()),
                        T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())])


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_predictions(df: DataFrame, root: str, name: str, mode: str = "errorifexists") -> None:
    """Predictions, references and sources as three datasets that share ``idx``."""
    for column, kind in (("pred", "output"), ("gold", "gold"), ("source", "src")):
        write_jsonl(df.select("idx", strip(column).alias(column)), f"{root}/{name}.{kind}", mode)


def write_shards(df: DataFrame, path: str, files_per_shard: int, shard: str = "shard", fmt: str = "json",
                 mode: str = "errorifexists") -> None:
    """One directory per shard, each written by ``files_per_shard`` tasks.

    The caller knows the size of a shard: choose files of some hundred megabytes.
    """
    # Rows of a shard are dealt by a hash of the row, so a retry deals them alike.
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    shards = df.withColumn("_f", spread)
    (shards.repartition(F.col(shard), F.col("_f")).drop("_f")
     .write.mode(mode).partitionBy(shard).format(fmt).save(path))


def fingerprint(**parts) -> str:
    """A name for a cache entry: split, row limit, input files and whatever else its rows depend on."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def cached_features(spark: SparkSession, path: str, build, schema: T.StructType, key: str = "all") -> DataFrame:
    """Features written under ``path`` by ``key``: built on first use, read afterwards.

    An entry is written aside and published by one rename, so it is whole or absent; of two
    builders of one key the later reads what the first published.  Other keys are other entries.
    (On a store without atomic renames the rename is only as safe as the store makes it.)
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, aside = f"{path}/{key}", f"{path}/_{key}-{uuid.uuid4().hex}"
    final, draft = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(aside)
    fs = final.getFileSystem(conf)
    if not fs.exists(final):
        build().write.parquet(aside)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)
        except Exception:
            if not fs.exists(final):
                raise
            fs.delete(draft, True)  # another builder was first
    return spark.read.schema(schema).parquet(target)


def append_metrics(df: DataFrame, path: str, batch: str) -> None:
    """Write (run, epoch, metric, value) rows to the log as the append ``batch``, say run and epoch.

    An append replaces what was written under its name: done again, or after a job that died
    half-way, it counts once.
    """
    rows = df.select("run", F.col("epoch").cast("int"), "metric", F.col("value").cast("double"), F.lit(batch).alias("batch"))
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(path)


def compact_metrics(spark: SparkSession, path: str, target: str) -> None:
    """The log in few files ordered by run, for logs of many small appends."""
    read_metrics(spark, path).repartitionByRange("run", "epoch", "metric").write.mode("overwrite").parquet(target)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path).select(*METRICS.names)
