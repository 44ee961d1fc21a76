"""Paragraphs and the readable forms of a transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions.text import blank, clock, cue_time, ends_paragraph, stripped
from talkgrid.operators.intervals import islands

PAUSE = 1.2
LONGEST = 700


def paragraph_numbers(segments: DataFrame, pause: float = PAUSE, longest: int = LONGEST) -> DataFrame:
    """Segments that aren't blank, with para_ix.

    A paragraph ends at a change of speaker or of overlap; at a pause or, from longest characters on, anywhere,
    if a sentence has ended. The length starts anew with each paragraph, so it is folded over the segments
    between changes of speaker, each such stretch on its own; all other rules are window functions.
    """
    w = Window.partitionBy("recording_id").orderBy("seq")
    if "overlapped" not in segments.columns:
        segments = segments.withColumn("overlapped", F.lit(False))
    rows = segments.where(~blank("text"))
    ended = ends_paragraph(F.lag("text").over(w))
    hard = F.lag("seq").over(w).isNull() | ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) | (F.lag("overlapped").over(w) != F.col("overlapped")) | ((F.col("start_s") - F.lag("end_s").over(w) >= pause) & ended)
    rows = islands(rows.withColumns({"_hard": hard, "_ended": F.coalesce(ended, F.lit(False)), "_n": F.length(stripped("text")) + 1}), ["recording_id"], ["seq"], F.col("_hard"))
    # Within a stretch: (length so far, number of the part, parts by segment).
    items = F.array_sort(F.collect_list(F.struct("seq", "_ended", "_n")))
    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("part"), F.array().cast("array<struct<seq:bigint,part:int>>").alias("out"))

    def step(state, x):
        new = (state.getField("length") >= longest) & x.getField("_ended")
        part = state.getField("part") + new.cast("int")
        length = F.when(new, 0).otherwise(state.getField("length")) + x.getField("_n")
        return F.struct(length.alias("length"), part.alias("part"), F.concat(state.getField("out"), F.array(F.struct(x.getField("seq").cast("bigint").alias("seq"), part.alias("part")))).alias("out"))

    parts = rows.groupBy("recording_id", "island").agg(F.aggregate(items, start, step, lambda s: s.getField("out")).alias("parts"))
    parts = parts.select("recording_id", F.inline("parts"))
    out = rows.join(parts, ["recording_id", "seq"])
    number = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("island", "part")) - 1
    return out.withColumn("para_ix", number).drop("_hard", "_ended", "_n", "island", "part")


def joined(text: str = "text") -> F.Column:
    """The group's texts in order of seq, trimmed, empty ones left out, with spaces between."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", stripped(text).alias("t"))))
    return F.array_join(F.filter(F.transform(ordered, lambda x: x.getField("t")), lambda t: t != ""), " ")


def paragraphs(segments: DataFrame, pause: float = PAUSE, longest: int = LONGEST) -> DataFrame:
    """recording_id, para_ix, speaker, start_s, end_s, text, overlapped (all of its segments are)."""
    return paragraph_numbers(segments, pause, longest).groupBy("recording_id", "para_ix").agg(
        F.min_by("speaker", "seq").alias("speaker"), F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s"), joined().alias("text"), F.bool_and("overlapped").alias("overlapped")
    )


def full_text(segments: DataFrame) -> DataFrame:
    return segments.groupBy("recording_id").agg(joined().alias("text"))


def _document(lines: DataFrame, order: str, between: str) -> DataFrame:
    """One text a recording: lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "line")))
    return lines.groupBy("recording_id").agg(F.array_join(F.transform(ordered, lambda x: x.getField("line")), between).alias("text"))


def _named(speaker: str = "speaker") -> F.Column:
    return F.coalesce(speaker, F.lit("")) != ""


def plain_text(paras: DataFrame) -> DataFrame:
    line = F.concat(F.when(_named(), F.concat("speaker", F.lit(": "))).otherwise(""), F.col("text"))
    return _document(paras.withColumn("line", line), "para_ix", "\n\n")


def markdown_lines(paras: DataFrame) -> DataFrame:
    name = F.when(_named(), F.concat(F.lit("**"), F.col("speaker"), F.lit("** "))).otherwise("")
    return paras.select("recording_id", "para_ix", F.concat(F.lit("**["), clock("start_s"), F.lit("]** "), name, F.col("text")).alias("line"))


def markdown(paras: DataFrame) -> DataFrame:
    return _document(markdown_lines(paras), "para_ix", "\n\n")


def cues(segments: DataFrame) -> DataFrame:
    """Subtitle cues: cue (from 1, over segments that aren't blank) and its text."""
    rows = segments.where(~blank("text"))
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("seq"))
    name = F.when(_named(), F.concat("speaker", F.lit(": "))).otherwise("")
    rows = rows.withColumn("cue", number)
    return rows.select("recording_id", "cue", F.concat(F.col("cue"), F.lit("\n"), cue_time("start_s"), F.lit(" --> "), cue_time("end_s"), F.lit("\n"), name, stripped("text")).alias("line"))


def subtitles(segments: DataFrame) -> DataFrame:
    return _document(cues(segments), "cue", "\n\n")


def by_speaker(segments: DataFrame) -> DataFrame:
    """Stretches of one speaker: who, and the texts."""
    rows = segments.where(~blank("text"))
    before = F.lag("speaker").over(Window.partitionBy("recording_id").orderBy("seq"))
    rows = islands(rows.withColumn("_same", before.eqNullSafe(F.col("speaker"))), ["recording_id"], ["seq"], ~F.col("_same"))
    return rows.groupBy("recording_id", "island").agg(F.min("seq").alias("seq"), F.min_by("speaker", "seq").alias("speaker"), joined().alias("text")).drop("island")


def readable(segments: DataFrame) -> DataFrame:
    """A recording's text by speaker: a line with the name, if there is one, then what they say; an empty line between."""
    line = F.concat(F.when(F.coalesce(F.trim("speaker"), F.lit("")) != "", F.concat("speaker", F.lit(":\n"))).otherwise(""), F.col("text"))
    return _document(by_speaker(segments).withColumn("line", line), "seq", "\n\n")


def at_time(paras: DataFrame, times: DataFrame) -> DataFrame:
    """The paragraph in which each time (recording_id, at_s) lies: its start counts, its end doesn't."""
    return times.join(paras, "recording_id").where((F.col("start_s") <= F.col("at_s")) & (F.col("at_s") < F.col("end_s")))


def matching(numbered: DataFrame, query: str) -> DataFrame:
    """Where a query stands (case aside): segments that have it, else whole paragraphs that have it across a join."""
    q = query.lower()
    segment = numbered.withColumn("_hit", F.lower("text").contains(q))
    paras = segment.groupBy("recording_id", "para_ix").agg(joined().alias("_text"), F.bool_or("_hit").alias("_inside"), F.min("start_s").alias("_start"), F.max("end_s").alias("_end"))
    hits = segment.where("_hit").select("recording_id", "para_ix", "seq", "start_s", "end_s")
    across = paras.where(~F.col("_inside") & F.lower("_text").contains(q)).select("recording_id", "para_ix", F.lit(None).cast("bigint").alias("seq"), F.col("_start").alias("start_s"), F.col("_end").alias("end_s"))
    return hits.unionByName(across)


def split_shares(segments: DataFrame, parts: F.Column) -> DataFrame:
    """Segments cut into parts (an array of texts), which share the time by their length; part counts from 0."""
    rows = segments.withColumn("_parts", parts)
    total = F.aggregate("_parts", F.lit(0), lambda s, p: s + F.length(p))
    rows = rows.withColumn("_total", total).select("*", F.posexplode("_parts").alias("part", "_text"))
    before = F.aggregate(F.slice("_parts", F.lit(1), F.col("part")), F.lit(0), lambda s, p: s + F.length(p))
    length = F.col("end_s") - F.col("start_s")
    at = F.col("start_s") + F.coalesce(F.try_divide(length * before, F.col("_total")), F.lit(0.0))
    to = F.when(F.col("part") == F.size("_parts") - 1, F.col("end_s")).otherwise(F.col("start_s") + F.try_divide(length * (before + F.length("_text")), F.col("_total")))
    return rows.withColumns({"_at": at, "_to": to}).withColumns({"text": F.col("_text"), "start_s": F.col("_at"), "end_s": F.col("_to")}).drop("_parts", "_total", "_text", "_at", "_to")
