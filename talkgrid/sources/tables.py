"""The input tables, and the domain's views of them: segments, turns, voices and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Speaking rate of the segments view, in characters a second.
RATE = 15.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seq, text, start_s, end_s, avg_logprob, no_speech, speaker: conversations at a steady rate with pauses."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    spoken = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / RATE
    paused = F.sum((F.col("turn") % 3) * 0.7).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = spoken + paused
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").alias("seq"),
        "text",
        start.alias("start_s"),
        (start + F.length("text") / RATE).alias("end_s"),
        (-((F.col("turn") * 7 + F.col("conv_id") * 3) % 15).cast("double") / 10).alias("avg_logprob"),
        (((F.col("turn") * 5 + F.col("conv_id")) % 10).cast("double") / 10).alias("no_speech"),
        F.col("role").alias("speaker"),
    )


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all of the session's shuffle partitions: before texts become grids, which are a thousand times their size, few rows must not be joined to a task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, turn_ix, speaker, start_s, end_s: events as speaker turns, an hour for a unit of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"),
        F.row_number().over(w).alias("turn_ix"),
        F.col("event_type").alias("speaker"),
        start.alias("start_s"),
        (start + F.col("value") / 6.0).alias("end_s"),
    )


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, turn_ix, speaker, start_s, end_s: turns as a listener to the segments may have found them, off by up to a second."""
    s = segments(spark, sf_dir)
    late = ((F.col("seq") * 5 + F.col("recording_id")) % 7 - 3) * 0.3
    longer = ((F.col("seq") * 3 + F.col("recording_id")) % 5 - 2) * 0.4
    return s.select("recording_id", F.col("seq").cast("int").alias("turn_ix"), "speaker", (F.col("start_s") + late).alias("start_s"), (F.col("end_s") + longer).alias("end_s"))


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
