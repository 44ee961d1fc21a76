"""Queries over speaker turns: overlaps, unions, best matches, frames and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.operators import frames, intervals, sequence
from talkgrid.plans import sql
from talkgrid.sources.tables import segments, spoken, turns

#: An hour of time stamps is one unit, so a bucket of a day holds a turn or a few.
DAY = 24.0


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments, and the turns to hold them against."""
    items = segments(spark, sf_dir).select("recording_id", F.col("seq").cast("int").alias("turn_ix"), "speaker", "start_s", "end_s")
    return items, spoken(spark, sf_dir)


def speaker_timeline(spark, sf_dir):
    found = intervals.timeline(turns(spark, sf_dir))
    return found.select("recording_id", "speaker", "n_turns", *_r("seconds", "first_s", "longest_s", "share", "crosstalk_s"))


def interval_union(spark, sf_dir):
    return intervals.union(turns(spark, sf_dir)).select("recording_id", *_r("start_s", "end_s"), "n")


def crosstalk_spans(spark, sf_dir):
    return intervals.crosstalk(turns(spark, sf_dir), DAY).select("recording_id", *_r("start_s", "end_s"))


def segment_turn_overlap(spark, sf_dir):
    items, others = _sides(spark, sf_dir)
    return intervals.interval_join(items, others).select("recording_id", "turn_ix", F.col("r_turn_ix").alias("other_ix"), *_r("shared"))


def best_overlap_speaker(spark, sf_dir):
    items, others = _sides(spark, sf_dir)
    return intervals.best_overlap(items, others, "turn_ix").select("recording_id", "turn_ix", "best_speaker", *_r("shared"))


def mark_overlaps(spark, sf_dir):
    items, others = _sides(spark, sf_dir)
    return intervals.mark_overlapped(items, others, "turn_ix").select("recording_id", "turn_ix", *_r("covered"), "overlapped")


def sole_voice(spark, sf_dir):
    items, others = _sides(spark, sf_dir)
    return intervals.sole_voice(items, others, "turn_ix").select("recording_id", "turn_ix", "voice", *_r("held"))


def orphan_segments(spark, sf_dir):
    """Segments that no turn of ten seconds or more overlaps."""
    items, others = _sides(spark, sf_dir)
    return intervals.uncovered(items, others.where("end_s - start_s >= 10"), "turn_ix").select("recording_id", "turn_ix")


def clean_turns_topk(spark, sf_dir):
    return intervals.clean_turns(turns(spark, sf_dir)).select("recording_id", "speaker", "turn_ix", "rank")


def snap_candidates(spark, sf_dir):
    items, others = _sides(spark, sf_dir)
    points = others.select("recording_id", "turn_ix", F.col("start_s").alias("at_s"))
    return intervals.latest_before(points, items, "turn_ix").select("recording_id", "turn_ix", *_r("at_s", "snap_s"))


def contested_coverage(spark, sf_dir):
    """How much of each turn's stretch lies in crosstalk, and whether it is .75 or more."""
    t = turns(spark, sf_dir)
    found = intervals.covered(t, intervals.crosstalk(t, DAY), "turn_ix", DAY)
    return found.select("recording_id", "turn_ix", *_r("covered"), (F.col("covered") >= 0.75).alias("crosstalk"))


def push_forward(spark, sf_dir):
    moved = sequence.push_forward(turns(spark, sf_dir), by="turn_ix")
    return moved.select("recording_id", "turn_ix", *_r("start_s", "end_s"))


def untangle_bounds(spark, sf_dir):
    return sequence.untangle(turns(spark, sf_dir), by="turn_ix").select("recording_id", "turn_ix", *_r("start_s", "end_s"))


def tidy_turns(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("speaker", F.when(F.col("speaker") < "m", "A").otherwise("B"))
    return sequence.tidy(t, 24.0).select("recording_id", "turn_ix", "speaker", *_r("start_s", "end_s"), "n")


def vote_frames(spark, sf_dir):
    return frames.votes(turns(spark, sf_dir), 6.0)


def contested_frames(spark, sf_dir):
    return frames.contested(frames.votes(turns(spark, sf_dir), 6.0))


def contested_spans(spark, sf_dir):
    found = frames.contested(frames.votes(turns(spark, sf_dir), 6.0))
    return frames.runs(found, ["recording_id"]).where("n * 6.0 >= 12.0")


def activity_runs(spark, sf_dir):
    return frames.runs(frames.painted(turns(spark, sf_dir), 6.0), ["recording_id", "speaker"])


def bridged_turns(spark, sf_dir):
    runs = frames.runs(frames.painted(turns(spark, sf_dir), 6.0), ["recording_id", "speaker"])
    runs = runs.select("recording_id", "speaker", (F.col("first_frame") * 6.0).alias("start_s"), ((F.col("last_frame") + 1) * 6.0).alias("end_s"))
    return frames.bridged_turns(runs, bridge=24.0, shortest=12.0)


def frame_confusion(spark, sf_dir):
    items, others = _sides(spark, sf_dir)
    return frames.swept_confusion(items, others, 0.1)


def majority_map(spark, sf_dir):
    """For each label of one side, the label of the other that it shares most frames with."""
    counts = frame_confusion(spark, sf_dir).where("a <> 'quiet' AND b <> 'quiet'")
    best = counts.groupBy("a").agg(F.max(F.struct("frames", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"), F.col("best.frames").alias("frames"))


_V = f"WITH {sql.TURNS}"
_I = f"WITH {sql.SEGMENTS}, {sql.SPOKEN}, {sql.ITEMS}"
_PAINT = "painted AS (SELECT *, unnest(range(CAST(floor(start_s / 6.0::DOUBLE) AS BIGINT), CAST(ceil(end_s / 6.0::DOUBLE) AS BIGINT))) AS frame FROM v_turns)"
_VOTES = f"{_PAINT}, v_votes AS (SELECT recording_id, frame, speaker, count(*) AS votes FROM painted GROUP BY ALL)"
_CONTESTED = f"""{_VOTES}, v_most AS (SELECT *, max(votes) OVER (PARTITION BY recording_id, frame) AS most FROM v_votes),
v_contested AS (SELECT recording_id, frame, count(*) AS tracks FROM v_most WHERE votes >= 0.6 * most GROUP BY ALL HAVING count(*) >= 2)"""


def _runs(source: str, keys: str, name: str) -> str:
    return f"""{name}_m AS (SELECT *, frame - row_number() OVER (PARTITION BY {keys} ORDER BY frame) AS run FROM (SELECT DISTINCT {keys}, frame FROM {source})),
{name} AS (SELECT {keys}, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM {name}_m GROUP BY {keys}, run)"""


def _half(name: str) -> str:
    # Half to even, as the paint rounds.
    rounded = lambda x: f"CAST(round_even({x} / 0.1::DOUBLE, 0) AS BIGINT)"
    return f"(SELECT recording_id, frame, CASE WHEN count(DISTINCT speaker) > 1 THEN '-2' ELSE min(speaker) END AS label FROM (SELECT *, unnest(range({rounded('start_s')}, {rounded('end_s')})) AS frame FROM {name}) GROUP BY ALL)"


_CONFUSION = f"v_confusion AS (SELECT coalesce(x.label, 'quiet') AS a, coalesce(y.label, 'quiet') AS b, count(*) AS frames FROM {_half('v_items')} x FULL JOIN {_half('v_others')} y USING (recording_id, frame) GROUP BY ALL)"

QUERIES = {
    f.__name__: f
    for f in (
        speaker_timeline, interval_union, crosstalk_spans, segment_turn_overlap, best_overlap_speaker, mark_overlaps, sole_voice, orphan_segments, clean_turns_topk, snap_candidates,
        contested_coverage, push_forward, untangle_bounds, tidy_turns, vote_frames, contested_frames, contested_spans, activity_runs, bridged_turns, frame_confusion, majority_map,
    )
}

ORACLE_SQL = {
    "speaker_timeline": f"""{_V}, {sql.CROSSTALK},
c AS (SELECT t.recording_id, t.speaker, sum(CASE WHEN x.start_s IS NULL THEN 0 ELSE {sql.shared("t", "x")} END) AS crosstalk_s FROM v_turns t LEFT JOIN v_cross x ON x.recording_id = t.recording_id AND t.start_s < x.end_s AND t.end_s > x.start_s GROUP BY ALL),
e AS (SELECT recording_id, speaker, count(*) AS n_turns, sum(end_s - start_s) AS seconds, min(start_s) AS first_s, max(end_s - start_s) AS longest_s FROM v_turns GROUP BY ALL)
SELECT e.recording_id, e.speaker, n_turns, round(seconds, 6) AS seconds, round(first_s, 6) AS first_s, round(longest_s, 6) AS longest_s, round(seconds / sum(seconds) OVER (PARTITION BY e.recording_id), 6) AS share, round(crosstalk_s, 6) AS crosstalk_s
FROM e JOIN c ON c.recording_id = e.recording_id AND c.speaker = e.speaker""",
    "interval_union": f"{_V}, {sql.union('v_turns', 'u')} SELECT recording_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, n FROM u",
    "crosstalk_spans": f"{_V}, {sql.CROSSTALK} SELECT recording_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM v_cross",
    "segment_turn_overlap": f"{_I} SELECT i.recording_id, i.turn_ix, o.turn_ix AS other_ix, round({sql.shared('i', 'o')}, 6) AS shared FROM v_items i JOIN v_others o ON i.recording_id = o.recording_id AND i.start_s < o.end_s AND i.end_s > o.start_s",
    "best_overlap_speaker": f"""{_I},
j AS (SELECT i.recording_id, i.turn_ix, o.speaker, {sql.shared('i', 'o')} AS shared, row_number() OVER (PARTITION BY i.recording_id, i.turn_ix ORDER BY {sql.shared('i', 'o')} DESC, o.turn_ix) AS k
      FROM v_items i LEFT JOIN v_others o ON i.recording_id = o.recording_id)
SELECT recording_id, turn_ix, speaker AS best_speaker, CASE WHEN shared > 0 THEN round(shared, 6) END AS shared FROM j WHERE k = 1""",
    "mark_overlaps": f"""{_I}
SELECT i.recording_id, i.turn_ix, round(sum(CASE WHEN o.turn_ix IS NULL THEN 0 ELSE {sql.shared('i', 'o')} END), 6) AS covered, any_value(i.end_s - i.start_s) > 0 AND sum(CASE WHEN o.turn_ix IS NULL THEN 0 ELSE {sql.shared('i', 'o')} END) >= any_value(i.end_s - i.start_s) * 0.5 AS overlapped
FROM v_items i LEFT JOIN v_others o ON i.recording_id = o.recording_id AND i.start_s < o.end_s AND i.end_s > o.start_s GROUP BY i.recording_id, i.turn_ix""",
    "sole_voice": f"""{_I},
b AS (SELECT i.recording_id, i.turn_ix, o.speaker, sum({sql.shared('i', 'o')}) AS held FROM v_items i JOIN v_others o ON i.recording_id = o.recording_id AND i.start_s < o.end_s AND i.end_s > o.start_s GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY recording_id, turn_ix ORDER BY held DESC, speaker DESC) AS k, sum(held) OVER (PARTITION BY recording_id, turn_ix) AS whole FROM b)
SELECT recording_id, turn_ix, speaker AS voice, round(held, 6) AS held FROM t WHERE k = 1 AND held >= 1.0 AND whole - held < 0.5""",
    "orphan_segments": f"{_I} SELECT recording_id, turn_ix FROM v_items i WHERE NOT EXISTS (SELECT 1 FROM v_others o WHERE o.end_s - o.start_s >= 10 AND i.recording_id = o.recording_id AND i.start_s < o.end_s AND i.end_s > o.start_s)",
    "clean_turns_topk": f"""{_V},
c AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY end_s - start_s DESC, turn_ix) AS rank FROM v_turns a WHERE end_s - start_s >= 1.5
  AND NOT EXISTS (SELECT 1 FROM v_turns b WHERE a.recording_id = b.recording_id AND a.speaker <> b.speaker AND a.start_s < b.end_s AND a.end_s > b.start_s))
SELECT recording_id, speaker, turn_ix, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= 5""",
    "snap_candidates": f"{_I} SELECT o.recording_id, o.turn_ix, round(any_value(o.start_s), 6) AS at_s, round(max(i.start_s), 6) AS snap_s FROM v_others o LEFT JOIN v_items i ON i.recording_id = o.recording_id AND i.start_s BETWEEN o.start_s - 0.9::DOUBLE AND o.start_s + 0.2::DOUBLE GROUP BY o.recording_id, o.turn_ix",
    "contested_coverage": f"""{_V}, {sql.CROSSTALK},
c AS (SELECT t.recording_id, t.turn_ix, sum(CASE WHEN x.start_s IS NULL THEN 0 ELSE {sql.shared("t", "x")} END) AS covered FROM v_turns t LEFT JOIN v_cross x ON x.recording_id = t.recording_id AND t.start_s < x.end_s AND t.end_s > x.start_s GROUP BY ALL)
SELECT recording_id, turn_ix, round(covered, 6) AS covered, covered >= 0.75 AS crosstalk FROM c""",
    "push_forward": f"""{_V},
l AS (SELECT *, greatest(0, end_s - start_s) AS len FROM v_turns), s AS (SELECT *, sum(len) OVER w AS upto FROM l WINDOW w AS (PARTITION BY recording_id ORDER BY turn_ix ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, upto + max(start_s - (upto - len)) OVER (PARTITION BY recording_id ORDER BY turn_ix ROWS UNBOUNDED PRECEDING) AS stop FROM s)
SELECT recording_id, turn_ix, round(stop - len, 6) AS start_s, round(stop, 6) AS end_s FROM e""",
    "untangle_bounds": f"{_V} SELECT recording_id, turn_ix, round(start_s, 6) AS start_s, round(CASE WHEN n IS NULL THEN end_s ELSE greatest(start_s, least(end_s, n)) END, 6) AS end_s FROM (SELECT *, lead(start_s) OVER (PARTITION BY recording_id ORDER BY turn_ix) AS n FROM v_turns)",
    "tidy_turns": f"""{_V}, t AS (SELECT * REPLACE (CASE WHEN speaker < 'm' THEN 'A' ELSE 'B' END AS speaker) FROM v_turns),
r AS (SELECT *, sum(CASE WHEN p = speaker THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY turn_ix ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(speaker) OVER (PARTITION BY recording_id ORDER BY turn_ix) AS p FROM t)),
g AS (SELECT *, max(end_s) OVER (PARTITION BY recording_id, run ORDER BY turn_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s - reach >= 24.0::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY turn_ix ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT recording_id, min(turn_ix) AS turn_ix, any_value(speaker) AS speaker, round(arg_min(start_s, turn_ix), 6) AS start_s, round(max(end_s), 6) AS end_s, count(*) AS n FROM k GROUP BY recording_id, island""",
    "vote_frames": f"{_V}, {_VOTES} SELECT * FROM v_votes",
    "contested_frames": f"{_V}, {_CONTESTED} SELECT * FROM v_contested",
    "contested_spans": f"{_V}, {_CONTESTED}, {_runs('v_contested', 'recording_id', 'v_runs')} SELECT * FROM v_runs WHERE n * 6.0 >= 12.0",
    "activity_runs": f"{_V}, {_PAINT}, {_runs('painted', 'recording_id, speaker', 'v_runs')} SELECT * FROM v_runs",
    "bridged_turns": f"""{_V}, {_PAINT}, {_runs('painted', 'recording_id, speaker', 'v_runs')},
s AS (SELECT recording_id, speaker, first_frame * 6.0::DOUBLE AS start_s, (last_frame + 1) * 6.0::DOUBLE AS end_s FROM v_runs),
g AS (SELECT *, start_s - lag(end_s) OVER (PARTITION BY recording_id, speaker ORDER BY start_s) AS gap FROM s),
k AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 24.0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, speaker ORDER BY start_s ROWS UNBOUNDED PRECEDING) AS island FROM g),
t AS (SELECT recording_id, speaker, min(start_s) AS start_s, max(end_s) AS end_s FROM k GROUP BY recording_id, speaker, island HAVING max(end_s) - min(start_s) >= 12.0),
f AS (SELECT *, min(start_s) OVER (PARTITION BY recording_id, speaker) AS first FROM t)
SELECT recording_id, speaker, start_s, end_s, CAST(dense_rank() OVER (PARTITION BY recording_id ORDER BY first, speaker) - 1 AS INTEGER) AS number FROM f""",
    "frame_confusion": f"{_I}, {_CONFUSION} SELECT * FROM v_confusion",
    "majority_map": f"{_I}, {_CONFUSION} SELECT a, b, frames FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY frames DESC, b DESC) AS k FROM v_confusion WHERE a <> 'quiet' AND b <> 'quiet') WHERE k = 1",
}
