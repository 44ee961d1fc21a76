"""Reading the input tables and small Spark helpers shared by the operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Only where it is unset, one of our own: in the warehouse, which a cluster
    shares, or on a single machine in its folder for temporary files."""
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        base = tempfile.gettempdir() if context.master.startswith("local") and "cluster" not in context.master else spark.conf.get("spark.sql.warehouse.dir")
        named = f"{base.rstrip('/')}/checkpoints/{uuid.uuid4().hex}"
    context.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from reliable checkpoint files, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    return _noted(out, file.get() if file.isDefined() else None)


def packed(df: DataFrame, *own: str) -> DataFrame:
    """df with its own columns as they are and all others in one, _other, so that no name of theirs can clash with one of ours."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in own]
    return df.select(*own, F.struct(*others, F.lit(0).alias("_end")).alias("_other"))


def unpacked(df: DataFrame, columns: list[str], own: tuple[str, ...], *results: str) -> DataFrame:
    """The given columns in their order, those of packed() that are not own from _other, and then the results."""
    return df.select(*[F.col(c) if c in own else F.col("_other").getField(c).alias(c) for c in columns], *results)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_of(column: str, parts: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def written(df: DataFrame) -> DataFrame:
    """The same rows read back from Parquet files in the shared folder; they go by release(), or when the driver's Python ends."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _noted(df.sparkSession.read.schema(df.schema).parquet(path), path)


def stored(df: DataFrame) -> DataFrame:
    """written(), and a call of the collectors.

    Spark removes the shuffle files of a finished job once the driver's collector has found its plan
    unused, which by itself may take long: a call of the collector keeps the disk that a chain of steps takes low.
    """
    out = written(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


_files: dict[str, SparkSession] = {}


def _noted(df: DataFrame, path: str | None) -> DataFrame:
    if path:
        df._own_files = path
        _files[path] = df.sparkSession
    return df


def release(*frames: DataFrame | None) -> None:
    """Remove the files behind results of cut() and stored() whose last reader has run."""
    for df in frames:
        path = getattr(df, "_own_files", None)
        if path in _files:
            _drop(_files.pop(path), path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has been stopped, and with it the way to the files
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    while _files:
        path, spark = _files.popitem()
        _drop(spark, path)
