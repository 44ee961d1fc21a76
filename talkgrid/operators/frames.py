"""Frame grids: painting turns on frames, votes, runs, and turns from runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.intervals import islands, union


def painted(turns: DataFrame, step: float) -> DataFrame:
    """A row for every frame that a turn touches: from floor(start / step) to ceil(end / step) - 1."""
    first, last = F.floor(F.col("start_s") / step), F.ceil(F.col("end_s") / step) - 1
    return turns.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))


def votes(turns: DataFrame, step: float, track: str = "speaker") -> DataFrame:
    return painted(turns, step).groupBy("recording_id", "frame", track).agg(F.count("*").alias("votes"))


def rounded_paint(turns: DataFrame, step: float) -> DataFrame:
    """One label a frame, frames from start / step to end / step rounded half to even; frames of several speakers are -2."""
    first, last = F.bround(F.col("start_s") / step).cast("long"), F.bround(F.col("end_s") / step).cast("long") - 1
    rows = turns.where(last >= first).withColumn("frame", F.explode(F.sequence(first, last)))
    return rows.groupBy("recording_id", "frame").agg(F.when(F.min("speaker") != F.max("speaker"), "-2").otherwise(F.min("speaker")).alias("label"))


def runs(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of frames in a row: keys, first_frame, last_frame, n."""
    w = Window.partitionBy(*keys).orderBy("frame")
    marked = frames.select(*keys, "frame").distinct().withColumn("_run", F.col("frame") - F.row_number().over(w))
    return marked.groupBy(*keys, "_run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n")).drop("_run")


def bridged_turns(found: DataFrame, bridge: float = 0.25, shortest: float = 0.25) -> DataFrame:
    """Runs (recording_id, speaker, start_s, end_s) to turns: gaps up to bridge close, turns under shortest go, and speakers are
    numbered by first appearance."""
    w = Window.partitionBy("recording_id", "speaker").orderBy("start_s")
    gap = F.col("start_s") - F.lag("end_s").over(w)
    marked = islands(found.withColumn("_gap", gap), ["recording_id", "speaker"], ["start_s"], F.col("_gap").isNull() | (F.col("_gap") > bridge))
    turns = marked.groupBy("recording_id", "speaker", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).drop("island")
    turns = turns.where(F.col("end_s") - F.col("start_s") >= shortest)
    first = F.min("start_s").over(Window.partitionBy("recording_id", "speaker"))
    turns = turns.withColumn("_first", first)
    number = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("_first", "speaker"))
    return turns.withColumn("number", number - 1).drop("_first")


def contested(voted: DataFrame, share: float = 0.6, track: str = "speaker") -> DataFrame:
    """Frames in which two or more tracks have at least a share of the most votes."""
    most = F.max("votes").over(Window.partitionBy("recording_id", "frame"))
    close = voted.withColumn("_most", most).where(F.col("votes") >= share * F.col("_most"))
    return close.groupBy("recording_id", "frame").agg(F.count("*").alias("tracks")).where("tracks >= 2")


def confusion(left: DataFrame, right: DataFrame) -> DataFrame:
    """How many frames have each pair of labels; a frame that one side lacks is quiet there."""
    a, b = left.select("recording_id", "frame", F.col("label").alias("a")), right.select("recording_id", "frame", F.col("label").alias("b"))
    both = a.join(b, ["recording_id", "frame"], "full")
    return both.groupBy(F.coalesce("a", F.lit("quiet")).alias("a"), F.coalesce("b", F.lit("quiet")).alias("b")).agg(F.count("*").alias("frames"))


def swept_confusion(left: DataFrame, right: DataFrame, step: float) -> DataFrame:
    """confusion() of two sides painted by rounded_paint(), from the turns' borders alone: between two borders nothing changes, so there is a row a border instead of a frame."""
    first, last = F.bround(F.col("start_s") / step).cast("long"), F.bround(F.col("end_s") / step).cast("long")

    def borders(turns: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        spans = turns.where("speaker IS NOT NULL").select("recording_id", "speaker", first.alias("start_s"), last.alias("end_s")).where("end_s > start_s")
        spans = union(spans, ["recording_id", "speaker"])  # of one speaker no two overlap
        number = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("speaker"))
        spans = spans.withColumn("_id", number)
        ends = F.explode(F.array(F.struct(F.col("start_s").alias("at"), F.lit(1).alias("n")), F.struct(F.col("end_s").alias("at"), F.lit(-1).alias("n"))))
        rows = spans.select("recording_id", "_id", ends.alias("e")).groupBy("recording_id", F.col("e.at").alias("at")).agg(F.sum("e.n").alias(f"{side}_n"), F.sum(F.col("e.n") * F.col("_id")).alias(f"{side}_id"))
        return rows, spans.select("recording_id", F.col("_id").alias(f"{side}_id"), F.col("speaker").alias(side)).distinct()

    (a, a_names), (b, b_names) = borders(left, "a"), borders(right, "b")
    none = [F.lit(0).cast("long").alias(c) for c in ("n", "id")]
    both = a.select("*", *[x.alias(f"b_{c}") for x, c in zip(none, ("n", "id"))]).unionByName(b.select("*", *[x.alias(f"a_{c}") for x, c in zip(none, ("n", "id"))]))
    both = both.groupBy("recording_id", "at").agg(*[F.sum(c).alias(c) for c in ("a_n", "a_id", "b_n", "b_id")])
    w = Window.partitionBy("recording_id").orderBy("at")
    active = both.select("recording_id", (F.lead("at").over(w) - F.col("at")).alias("frames"), *[F.sum(c).over(w).alias(c) for c in ("a_n", "a_id", "b_n", "b_id")])
    active = active.where("frames > 0 AND a_n + b_n > 0")
    known = [F.when(F.col(f"{s}_n") == 0, 0).when(F.col(f"{s}_n") > 1, -2).otherwise(F.col(f"{s}_id")).alias(f"{s}_id") for s in "ab"]
    counts = active.select("recording_id", "frames", *known).groupBy("recording_id", "a_id", "b_id").agg(F.sum("frames").alias("frames"))
    named = counts.join(a_names, ["recording_id", "a_id"], "left").join(b_names, ["recording_id", "b_id"], "left")
    label = lambda s: F.when(F.col(f"{s}_id") == 0, "quiet").when(F.col(f"{s}_id") == -2, "-2").otherwise(F.col(s)).alias(s)
    return named.groupBy(label("a"), label("b")).agg(F.sum("frames").alias("frames"))
