"""Joins and unions of time intervals within a recording.

Intervals that overlap are found by equality of recording and time bucket: both sides are spread over the buckets that
they touch, and a pair is kept in the bucket where the later of the two starts, so it appears once.
A long recording is thereby dealt over many tasks, and the plan is a hash or sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket, in the unit of the intervals.
BUCKET = 60.0


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _spread(df: DataFrame, start: str, end: str, bucket: float) -> DataFrame:
    first, last = F.floor(F.col(start) / bucket), F.floor(F.greatest(F.col(start), F.col(end)) / bucket)
    return df.withColumn("_bucket", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, key: str = "recording_id", bucket: float = BUCKET) -> DataFrame:
    """Pairs of rows of one key whose intervals (start_s, end_s) overlap by more than nothing. Columns of the right
    side are prefixed with r_, and shared is the overlap."""
    right = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    a = _spread(left, "start_s", "end_s", bucket)
    b = _spread(right, "r_start_s", "r_end_s", bucket).withColumnRenamed("_bucket", "_b")
    meet = F.floor(F.greatest(F.col("start_s"), F.col("r_start_s")) / bucket)
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_bucket") == F.col("_b"))
    pairs = a.join(b, on).where((F.col("start_s") < F.col("r_end_s")) & (F.col("end_s") > F.col("r_start_s")) & (F.col("_bucket") == meet))
    return pairs.drop("_bucket", "_b").withColumn("shared", overlap(F.col("start_s"), F.col("end_s"), F.col("r_start_s"), F.col("r_end_s")))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, starts: Column) -> DataFrame:
    """df with island, a number that grows by one at each row for which starts holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("island", F.sum("_starts").over(w)).drop("_starts")


def union(df: DataFrame, keys: Sequence[str] = ("recording_id",)) -> DataFrame:
    """The union of the intervals of each key; touching ones merge. Gives keys, start_s, end_s and n, how many went in."""
    w = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    reach = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = islands(df.withColumn("_reach", reach), keys, ["start_s", "end_s"], F.col("_reach").isNull() | (F.col("start_s") > F.col("_reach")))
    return marked.groupBy(*keys, "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n")).drop("island")


def crosstalk(turns: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Stretches in which two speakers of a recording talk at once, united."""
    pairs = interval_join(turns, turns, bucket=bucket).where("turn_ix < r_turn_ix AND speaker <> r_speaker")
    both = pairs.select("recording_id", F.greatest("start_s", "r_start_s").alias("start_s"), F.least("end_s", "r_end_s").alias("end_s"))
    return union(both).select("recording_id", "start_s", "end_s")


def best_overlap(items: DataFrame, turns: DataFrame, item: str, bucket: float = BUCKET) -> DataFrame:
    """items with the speaker of the turn that shares most with each, earlier turns winning ties; an item that no turn
    meets takes the recording's first turn. shared is null there. A turn that ends before it begins shares nothing."""
    met = interval_join(items, turns, bucket=bucket).where("shared > 0")
    best = met.groupBy("recording_id", item).agg(F.max(F.struct("shared", -F.col("r_turn_ix"), "r_speaker")).alias("best"))
    best = best.select("recording_id", item, F.col("best.r_speaker").alias("met_speaker"), F.col("best.shared").alias("shared"))
    first = turns.groupBy("recording_id").agg(F.min(F.struct("turn_ix", "speaker")).alias("first")).select("recording_id", F.col("first.speaker").alias("first_speaker"))
    out = items.drop("shared").join(best, ["recording_id", item], "left").join(first, "recording_id", "left")
    return out.withColumn("best_speaker", F.coalesce("met_speaker", "first_speaker")).drop("met_speaker", "first_speaker")


def covered(items: DataFrame, spans: DataFrame, item: str, bucket: float = BUCKET) -> DataFrame:
    """items with covered, the sum of what spans share with each; spans that overlap each other count each."""
    sums = interval_join(items, spans, bucket=bucket).groupBy("recording_id", item).agg(F.sum("shared").alias("covered"))
    return items.join(sums, ["recording_id", item], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def mark_overlapped(items: DataFrame, spans: DataFrame, item: str, share: float = 0.5) -> DataFrame:
    """items with overlapped: spans cover at least a share of the item's length."""
    length = F.col("end_s") - F.col("start_s")
    return covered(items, spans, item).withColumn("overlapped", (length > 0) & (F.col("covered") >= length * share))


def sole_voice(items: DataFrame, turns: DataFrame, item: str, most: float = 1.0, rest: float = 0.5) -> DataFrame:
    """items that one speaker alone holds: theirs is at least most, and all others' together under rest."""
    by = interval_join(items, turns).groupBy("recording_id", item, F.col("r_speaker").alias("voice")).agg(F.sum("shared").alias("held"))
    top = by.groupBy("recording_id", item).agg(F.max(F.struct("held", "voice")).alias("top"), F.sum("held").alias("all"))
    return top.where((F.col("top.held") >= most) & (F.col("all") - F.col("top.held") < rest)).select("recording_id", item, F.col("top.voice").alias("voice"), F.col("top.held").alias("held"))


def uncovered(items: DataFrame, spans: DataFrame, item: str) -> DataFrame:
    """items that no span overlaps."""
    return items.join(interval_join(items, spans).select("recording_id", item), ["recording_id", item], "left_anti")


def clean_turns(turns: DataFrame, shortest: float = 1.5, most: int = 5) -> DataFrame:
    """For each speaker the longest turns that no other speaker overlaps."""
    others = interval_join(turns, turns).where("speaker <> r_speaker").select("recording_id", "turn_ix")
    clean = turns.where(F.col("end_s") - F.col("start_s") >= shortest).join(others, ["recording_id", "turn_ix"], "left_anti")
    w = Window.partitionBy("recording_id", "speaker").orderBy(F.desc(F.col("end_s") - F.col("start_s")), "turn_ix")
    return clean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def latest_before(points: DataFrame, items: DataFrame, point: str, back: float = 0.9, ahead: float = 0.2) -> DataFrame:
    """points (recording_id, point, at_s) with snap_s: the latest item start between back before and ahead after at_s, or null."""
    around = points.withColumn("start_s", F.col("at_s") - back).withColumn("end_s", F.col("at_s") + ahead)
    lo, hi = F.floor(F.col("start_s") / BUCKET), F.floor(F.col("end_s") / BUCKET)
    a = around.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    b = items.select(F.col("recording_id"), F.col("start_s").alias("_start"), F.floor(F.col("start_s") / BUCKET).alias("_bucket"))
    near = a.join(b, ["recording_id", "_bucket"]).where("_start >= start_s AND _start <= end_s")
    best = near.groupBy("recording_id", point).agg(F.max("_start").alias("snap_s"))
    return points.join(best, ["recording_id", point], "left")


def timeline(turns: DataFrame) -> DataFrame:
    """For each recording and speaker: turns, seconds, first start, longest turn, share of speech, and seconds of crosstalk."""
    length = F.col("end_s") - F.col("start_s")
    each = turns.groupBy("recording_id", "speaker").agg(F.count("*").alias("n_turns"), F.sum(length).alias("seconds"), F.min("start_s").alias("first_s"), F.max(length).alias("longest_s"))
    whole = Window.partitionBy("recording_id")
    each = each.withColumn("share", F.try_divide("seconds", F.sum("seconds").over(whole)))
    held = covered(turns, crosstalk(turns), "turn_ix").groupBy("recording_id", "speaker").agg(F.sum("covered").alias("crosstalk_s"))
    return each.join(held, ["recording_id", "speaker"])
