"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def session(app: str = "tracewright", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Recording the call site of every column costs more than building the column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names, or one below the warehouse, which is shared as well."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(remove_scratch)
    _written.append(path)
    return path


def remove_scratch() -> None:
    """Delete every scratch path of this program, as far as a session is left to do it."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and go on from the written rows.

    Spark knows the bytes of what is written, so small tables are broadcast by its own threshold, without a hint.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
