"""Queries that find people by tracks and voices, and that correct words at a moment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrid.operators import corrections, folds, paragraphs, tracking
from talkgrid.plans import attribution, sql
from talkgrid.sources.tables import segments, turns, voices

WEEK = 24.0 * 7


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def retimed_here(spark, sf_dir):
    """Of each conversation the one "the" nearest to its middle becomes two words; times come from measured words, of which every fifth segment lacks one."""
    s = segments(spark, sf_dir)
    rules = s.groupBy("recording_id").agg((F.max("end_s") / 2).alias("at_s"))
    rules = rules.select("recording_id", F.lit(0).alias("ord"), F.array(F.lit("the")).alias("wrong"), F.array(F.lit("that"), F.lit("very")).alias("right"), "at_s")
    measured = attribution._timed(spark, sf_dir).where("NOT (seq % 5 = 4 AND word_ix = 1)")
    found = corrections.retimed(corrections.corrected_words(s, rules), measured, s)
    return found.select("recording_id", "seq", "piece_ix", "text", "offset", *_r("start_s", "end_s"))


def _windows(spark, sf_dir):
    """Turns in windows of two weeks with one in common; who speaks in a slot changes from window to window, and in every seventh window two are mixed up."""
    k = F.floor(F.col("start_s") / WEEK)
    rows = turns(spark, sf_dir).withColumn("window_ix", F.explode(F.array(k.cast("int"), (k - 1).cast("int"))))
    rows = rows.withColumn("window_ix", F.col("window_ix") - F.min("window_ix").over(Window.partitionBy("recording_id")))
    who = F.pmod(F.crc32(F.col("speaker").cast("binary")), F.lit(5))
    mixed = F.when((F.col("window_ix") % 7 == 3) & (who == 1), F.lit(2)).otherwise(who)
    spans = rows.select("recording_id", "window_ix", F.pmod(mixed + F.col("window_ix"), F.lit(5)).cast("int").alias("slot"), "start_s", "end_s")
    roster = rows.select("recording_id", "window_ix").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(4))))
    angle = F.pmod(F.crc32(F.col("speaker").cast("binary")), F.lit(5)) * 1.1 + F.col("turn_ix") % 7 * 0.05
    heard = turns(spark, sf_dir).select("recording_id", "start_s", "end_s", F.array(F.cos(angle), F.sin(angle), F.lit(0.2)).alias("embedding"))
    return spans, roster, heard


def tracked_people(spark, sf_dir):
    """Three people at most, by tracks and voices."""
    return tracking.tracked_people(*_windows(spark, sf_dir), people=3).groupBy("recording_id", "window_ix", "slot", "track").agg(F.count("*").alias("n"))


def two_people(spark, sf_dir):
    return tracking.tracked_people(*_windows(spark, sf_dir), people=2).groupBy("recording_id", "window_ix", "slot", "track").agg(F.count("*").alias("n"))


def diarized_turns(spark, sf_dir):
    """Turns of as many people as who talks at once shows."""
    spans, roster, heard = _windows(spark, sf_dir)
    hour = lambda df: df.withColumns({"start_s": F.col("start_s") / 60, "end_s": F.col("end_s") / 60})
    found = tracking.diarized(hour(spans), roster, hour(heard))
    return found.select("recording_id", "number", *_r("start_s", "end_s"))


def voices_like_example(spark, sf_dir):
    """Forty vectors in a row are a recording's voices; those that belong with its first one, where two groups are clear."""
    v = voices(spark, sf_dir).select(F.floor(F.col("vec_id") / 40).alias("recording_id"), F.col("vec_id").alias("voice_ix"), "embedding", (F.col("vec_id") % 40 == 0).alias("example"))
    return folds.split_by_example(v, apart=0.8)


def renamed_by_voice(spark, sf_dir):
    """Who opens a conversation is renamed, with what else sounds like that; every fourth segment has another voice."""
    s = segments(spark, sf_dir)
    other = F.when(F.col("seq") % 4 == 2, F.lit(1.5)).otherwise(0.0) + F.when(F.col("speaker") == "user", 0.0).otherwise(0.6)
    heard = s.select("recording_id", "start_s", "end_s", F.array(F.cos(other), F.sin(other), F.lit(0.1)).alias("embedding"))
    paras = paragraphs.paragraphs(s, longest=300).select("recording_id", "para_ix", "speaker", "start_s", "end_s")
    first = s.groupBy("recording_id").agg(F.min_by("start_s", "seq").alias("start_s"), F.min_by("end_s", "seq").alias("end_s")).withColumn("name", F.lit("Ann"))
    return tracking.rename_by_voice(s, paras, heard, first).select("recording_id", "seq", "speaker")


QUERIES = {f.__name__: f for f in (retimed_here, renamed_by_voice, tracked_people, two_people, diarized_turns, voices_like_example)}

_CORE = r"regexp_extract({0}, '^[^\p{{L}}\p{{Nd}}]*((?:.*[\p{{L}}\p{{Nd}}])?)', 1)"
_OWN = f"CASE WHEN length({_CORE.format('text')}) > 2 AND regexp_matches({_CORE.format('text')}, '[''’]s$') THEN left({_CORE.format('text')}, length({_CORE.format('text')}) - 2) ELSE {_CORE.format('text')} END"

ORACLE_SQL = {
    "retimed_here": rf"""{attribution._TIMED}, c AS (SELECT tw.recording_id, tw.seq, tw.word_ix, tw.text, count(*) OVER (PARTITION BY tw.recording_id, tw.seq) AS n, {_OWN.replace('text', 'tw.text')} AS core, s.start_s AS s, s.end_s AS e, m.d / 2 AS mid FROM tw JOIN v_segments s USING (recording_id, seq) JOIN (SELECT recording_id, max(end_s) AS d FROM v_segments GROUP BY recording_id) m ON m.recording_id = tw.recording_id),
h AS (SELECT recording_id, seq, word_ix FROM c WHERE core IN ('the', 'The') AND mid BETWEEN s - 3 AND e + 3 QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY abs(s + (e - s) * word_ix / n - mid), seq, word_ix) = 1),
p AS (SELECT c.*, 0 AS half, c.word_ix::DOUBLE AS a, c.word_ix + 1.0::DOUBLE AS b, c.text AS t FROM c LEFT JOIN h USING (recording_id, seq, word_ix) WHERE h.word_ix IS NULL
  UNION ALL SELECT c.*, x.half, c.word_ix + x.half * 0.5::DOUBLE, c.word_ix + (x.half + 1) * 0.5::DOUBLE, CASE WHEN x.half = 0 THEN regexp_extract(c.text, '^([^\p{{L}}\p{{Nd}}]*)', 1) || CASE WHEN core = 'The' THEN 'That' ELSE 'that' END ELSE 'very' || substring(c.text, length(regexp_extract(c.text, '^([^\p{{L}}\p{{Nd}}]*)', 1)) + 4) END
  FROM c JOIN h USING (recording_id, seq, word_ix), (SELECT unnest([0, 1]) AS half) x),
m AS (SELECT *, count(*) OVER (PARTITION BY recording_id, seq) AS timed FROM tw WHERE NOT (seq % 5 = 4 AND word_ix = 1)),
r AS (SELECT p.recording_id, p.seq, p.word_ix, half, t, CASE WHEN coalesce(k.timed = p.n, false) THEN m.start_s + (p.a - p.word_ix) * (m.end_s - m.start_s) ELSE s + (e - s) * p.a / n END AS start_s, CASE WHEN coalesce(k.timed = p.n, false) THEN m.start_s + (p.b - p.word_ix) * (m.end_s - m.start_s) ELSE s + (e - s) * p.b / n END AS end_s
  FROM p LEFT JOIN (SELECT DISTINCT recording_id, seq, timed FROM m) k ON k.recording_id = p.recording_id AND k.seq = p.seq LEFT JOIN m ON m.recording_id = p.recording_id AND m.seq = p.seq AND m.word_ix = p.word_ix)
SELECT recording_id, seq, CAST(row_number() OVER w - 1 AS INTEGER) AS piece_ix, t AS text, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY recording_id, seq ORDER BY word_ix, half ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset", round(start_s, 6) AS start_s, round(greatest(start_s, end_s), 6) AS end_s
FROM r WINDOW w AS (PARTITION BY recording_id, seq ORDER BY word_ix, half)""",
}
