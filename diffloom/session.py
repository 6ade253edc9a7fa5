"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "diffloom", **conf) -> SparkSession:
    """A session with the settings the jobs assume; ``conf`` uses ``_`` for ``.``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Plans here are large expressions; call sites of every part would be recorded.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), str(value))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Where none is set, a local session takes one inside its warehouse; on a cluster that
    may be a folder of one machine, so there it is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse or not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = f"{warehouse.rstrip('/')}/_scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several consumers share an expensive result: unlike a local
    checkpoint the table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scratch_file(spark: SparkSession, path: str):
    """Hadoop's path and file system of a table or folder below the shared folder."""
    if not path.startswith(scratch_root(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared folder that nothing reads any more."""
    found, fs = _scratch_file(spark, path)
    fs.delete(found, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Give a table or folder of the shared folder another name there."""
    (found, fs), (target, _) = _scratch_file(spark, path), _scratch_file(spark, to)
    if not fs.rename(found, target):
        raise OSError(f"{path} was not renamed to {to}")
