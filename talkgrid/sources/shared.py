"""Folders that the driver and all executors see, for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def base_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; else on a cluster the warehouse, on a single machine its folder for temporary files."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    named = set_already.get() if set_already.isDefined() else context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context.master.startswith("local") and "cluster" not in context.master:
        return tempfile.gettempdir()
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if warehouse.startswith(("/", "file:")):
        raise ValueError("no folder that all executors share is named: set spark.checkpoint.dir")
    return warehouse.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of one's own in the shared one. It goes when the driver's Python ends."""
    path = f"{base_folder(spark)}/talk-{kind}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """As a written table, read back: later steps don't do it again, and a lost executor costs little."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_all() -> None:
    while _made:
        path, spark = _made.popitem()
        if spark.sparkContext._jsc is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
