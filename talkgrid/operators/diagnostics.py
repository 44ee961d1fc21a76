"""Report tables of a run: what times are shown for each segment and where they come from, and what each live pass showed and committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a segment's text that a report shows.
HEAD = 40
KINDS = ("measured", "heard", "estimate")


def shown_spans(segments: DataFrame, measured: DataFrame, heard: DataFrame, estimated: DataFrame) -> DataFrame:
    """For each segment (recording_id, seq, text, start_s, end_s) which of the three tables of words (recording_id, seq, word_ix, start_s, end_s) its shown times are from,
    the first that has any: kind, the span of these words, and the begin of its text. A segment without words has no kind."""
    key = ["recording_id", "seq"]

    def spans(words: DataFrame, kind: str) -> DataFrame:
        own = words.groupBy(*key).agg(F.min_by("start_s", "word_ix").alias("words_from"), F.max_by("end_s", "word_ix").alias("words_to"))
        return own.select(*key, F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), "words_from", "words_to").alias("s"))

    every = spans(measured, "measured").unionByName(spans(heard, "heard")).unionByName(spans(estimated, "estimate"))
    first = every.groupBy(*key).agg(F.min("s").alias("s")).select(*key, "s.kind", "s.words_from", "s.words_to")
    head = F.when(F.length("text") <= HEAD, F.col("text")).otherwise(F.concat(F.left("text", F.lit(HEAD - 3)), F.lit("…")))
    return segments.select(*key, "start_s", "end_s", head.alias("head")).join(first, key, "left")


def span_lines(spans: DataFrame) -> DataFrame:
    """recording_id, line_ix, line: the report as text, headed by how many segments have measured words."""
    number = lambda c: F.format_string("%.2f", F.col(c))
    words = F.when(F.col("kind").isNull(), "words none").otherwise(F.concat(F.lit("words "), number("words_from"), F.lit("-"), number("words_to")))
    text = F.concat(F.rpad(F.coalesce(F.when(F.col("kind") == "estimate", "ESTIMATE").otherwise(F.col("kind")), F.lit("ESTIMATE")), 8, " "), F.lit(" "), number("start_s"), F.lit("-"), number("end_s"), F.lit(" "), words, F.lit(' "'), F.col("head"), F.lit('"'))
    lines = spans.select("recording_id", F.row_number().over(Window.partitionBy("recording_id").orderBy("seq")).alias("line_ix"), text.alias("line"))
    counts = spans.groupBy("recording_id").agg(F.count_if(F.col("kind") == "measured").alias("m"), F.count("*").alias("n"))
    heads = counts.select("recording_id", F.lit(0).alias("line_ix"), F.format_string("measured %d of %d segments", "m", "n").alias("line"))
    return heads.unionByName(lines)


def session_log(updates: DataFrame) -> DataFrame:
    """Updates of live passes (recording_id, pass_ix, kind, text, start_s, end_s) to a row a pass: what was still provisional, what was committed in it, and all that had been by then."""
    one = F.array_sort(F.collect_list(F.when(F.col("kind") == "committed", F.struct("start_s", "text"))))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.trim(x["text"])), " ")
    rows = updates.groupBy("recording_id", "pass_ix").agg(F.max(F.when(F.col("kind") == "provisional", F.col("text"))).alias("provisional"), one.alias("_new"))
    upto = F.flatten(F.collect_list("_new").over(Window.partitionBy("recording_id").orderBy("pass_ix")))
    return rows.select("recording_id", "pass_ix", F.coalesce("provisional", F.lit("")).alias("provisional"), said("_new").alias("new"), said(upto).alias("committed"))


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text for each recording, its lines in order."""
    ordered = lines.repartition("recording_id").sortWithinPartitions("recording_id", "line_ix")
    ordered.select("recording_id", F.col("line").alias("value")).write.partitionBy("recording_id").text(path)
