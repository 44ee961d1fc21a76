"""Repairs and runs along a recording's own order; every window sorts by that order, never by time stamps.

The rules that look like loops have closed forms: running minima, running maxima over prefix sums, and islands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions.text import continues_sentence, ends_sentence
from talkgrid.operators.intervals import islands


def _order(key: str = "recording_id", by: str = "seq"):
    return Window.partitionBy(key).orderBy(by)


def _backwards(keys: Sequence[str], by: str):
    """A row and all after it, as a running window from the end: frames that begin at the row itself are summed up anew for each row."""
    return Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, 0)


def decoder_order(segments: DataFrame, window_start: F.Column, window_end: F.Column) -> DataFrame:
    """Clip what runs past the window, then pull starts back so that none is after the next one's; lengths stay."""
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    moved = F.greatest(window_start, F.least(F.col("start_s"), window_end - length))
    start = F.when((F.col("end_s") > window_end) & (F.col("start_s") >= window_end), moved).otherwise(F.col("start_s"))
    clipped = segments.withColumns({"_s": start, "_e": F.least("end_s", window_end)})
    later = F.min("_s").over(_backwards(["recording_id"], "seq"))
    clipped = clipped.withColumn("_n", later)
    end = F.when(F.col("_n") < F.col("_s"), F.col("_n") + F.greatest(F.lit(0.0), F.col("_e") - F.col("_s"))).otherwise(F.col("_e"))
    return clipped.withColumns({"start_s": F.col("_n"), "end_s": end}).drop("_s", "_e", "_n")


def push_forward(segments: DataFrame, by: str = "seq") -> DataFrame:
    """Move each segment past the end of the one before, keeping its length; pushes cascade."""
    length = F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))
    w = _order(by=by).rowsBetween(Window.unboundedPreceding, 0)
    out = segments.withColumn("_len", length).withColumn("_sum", F.sum("_len").over(w))
    out = out.withColumn("_end", F.col("_sum") + F.max(F.col("start_s") - (F.col("_sum") - F.col("_len"))).over(w))
    return out.withColumns({"start_s": F.col("_end") - F.col("_len"), "end_s": F.col("_end")}).drop("_len", "_sum", "_end")


def untangle(segments: DataFrame, by: str = "seq") -> DataFrame:
    """Cut each end to the next start, but not before its own start."""
    following = F.lead("start_s").over(_order(by=by))
    return segments.withColumn("end_s", F.when(following.isNull(), F.col("end_s")).otherwise(F.greatest("start_s", F.least(F.col("end_s"), following))))


def carry_speaker(segments: DataFrame, pause: float = 2.0) -> DataFrame:
    """Give a piece that goes on with an unfinished sentence the speaker who began it."""
    w = _order()
    before = {c: F.lag(c).over(w) for c in ("speaker", "end_s", "text")}
    linked = before["speaker"].isNotNull() & F.col("speaker").isNotNull() & (F.col("start_s") - before["end_s"] <= pause) & ~ends_sentence(before["text"]) & continues_sentence("text")
    marked = islands(segments.withColumn("_linked", linked), ["recording_id"], ["seq"], ~F.col("_linked"))
    first = F.first("speaker").over(Window.partitionBy("recording_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("speaker", first).drop("_linked", "island")


def renumber_by_appearance(segments: DataFrame) -> DataFrame:
    """Number automatic labels ("Speaker n") by first appearance; a recording with any other label stays as it is."""
    whole = Window.partitionBy("recording_id")
    automatic = F.bool_and(F.coalesce(F.col("speaker").rlike("^Speaker -?[0-9]+$"), F.lit(True))).over(whole)
    first = F.min("seq").over(Window.partitionBy("recording_id", "speaker"))
    number = F.dense_rank().over(whole.orderBy(F.when(F.col("speaker").isNotNull(), F.col("_first")).asc_nulls_last()))
    out = segments.withColumns({"_auto": automatic, "_first": first}).withColumn("_number", number)
    return out.withColumn("speaker", F.when(F.col("_auto") & F.col("speaker").isNotNull(), F.concat(F.lit("Speaker "), F.col("_number"))).otherwise(F.col("speaker"))).drop("_auto", "_first", "_number")


def tidy(turns: DataFrame, gap: float = 0.75) -> DataFrame:
    """Merge turns in a row of one speaker with less than gap between; the order given holds."""
    w = _order(by="turn_ix")
    run = islands(turns.withColumn("_other", F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))), ["recording_id"], ["turn_ix"], ~F.col("_other"))
    reach = F.max("end_s").over(Window.partitionBy("recording_id", "island").orderBy("turn_ix").rowsBetween(Window.unboundedPreceding, -1))
    run = run.withColumnRenamed("island", "_run").withColumn("_reach", F.max("end_s").over(Window.partitionBy("recording_id", "_run").orderBy("turn_ix").rowsBetween(Window.unboundedPreceding, -1)))
    joined = islands(run, ["recording_id"], ["turn_ix"], F.col("_reach").isNull() | (F.col("start_s") - F.col("_reach") >= gap))
    return joined.groupBy("recording_id", "island", "speaker").agg(F.min("turn_ix").alias("turn_ix"), F.min_by("start_s", "turn_ix").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n")).drop("island")


def fill_labels(words: DataFrame, by: str = "word_ix", keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Words without a label take the one before them, and at the start the first after them."""
    w = Window.partitionBy(*keys).orderBy(by)
    ahead = F.last("label", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.last("label", ignorenulls=True).over(_backwards(keys, by))
    return words.withColumn("label", F.coalesce(ahead, behind))


def interpolate(words: DataFrame, by: str = "word_ix") -> DataFrame:
    """Times (at_s) that are null lie on the line between the known ones around them; then none is before an earlier one."""
    w = Window.partitionBy("recording_id").orderBy(by)
    known = F.when(F.col("at_s").isNotNull(), F.struct(F.col(by).alias("i"), F.col("at_s").alias("t")))
    a = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.last(known, ignorenulls=True).over(_backwards(["recording_id"], by))
    out = words.withColumns({"_a": a, "_b": b})
    between = F.col("_a.t") + (F.col("_b.t") - F.col("_a.t")) * F.try_divide(F.col(by) - F.col("_a.i"), F.col("_b.i") - F.col("_a.i"))
    out = out.withColumn("at_s", F.coalesce("at_s", between, "_a.t", "_b.t")).drop("_a", "_b")
    return out.withColumn("at_s", F.max("at_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
