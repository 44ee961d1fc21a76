"""Small helpers for streams whose state is kept by transformWithState."""

from __future__ import annotations

import sys
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from talkgrid.sources.shared import new_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store that transformWithState needs, for the queries that are started within."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


@contextmanager
def by_value(*modules: str):
    """Functions and classes of these modules, and of this one, are sent as they are. What reads a stream's state beside the driver gets none of the
    files that executors get, so it could not import them."""
    found = [sys.modules[m] for m in (__name__, *modules)]
    for m in found:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for m in found:
            cloudpickle.unregister_pickle_by_value(m)


def drained(stream: DataFrame, kind: str) -> DataFrame:
    """What a stream gives for all that its source has now, as a table in the shared folder; Spark commits each batch to it once."""
    spark = stream.sparkSession
    path = new_folder(spark, kind)
    with rocks(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def floats(cells) -> np.ndarray:
    return np.asarray([] if cells is None else cells, np.float32)


def in_order(batches, by: str) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(by, kind="stable")
