"""Queries of the measuring kind: percentiles, drift, thresholds, voices and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.operators import evaluation, sequence
from talkgrid.plans import sql
from talkgrid.sources.tables import segments, turns, voices

SHARES = (0.5, 0.9, 0.95)


def _lengths(spark, sf_dir):
    return turns(spark, sf_dir).withColumn("length", F.col("end_s") - F.col("start_s"))


def _moved(spark, sf_dir):
    t = turns(spark, sf_dir).withColumnRenamed("turn_ix", "seq").withColumn("text", F.col("speaker"))
    return t, sequence.untangle(sequence.push_forward(t))


def upper_median(spark, sf_dir):
    return evaluation.upper_median(_lengths(spark, sf_dir), ["recording_id"], "length").select("recording_id", F.round("median", 6).alias("median"))


def index_percentiles(spark, sf_dir):
    return evaluation.index_percentiles(_lengths(spark, sf_dir), ["recording_id"], "length", SHARES).select("recording_id", "p", F.round("value", 6).alias("value"))


def share_within(spark, sf_dir):
    found = evaluation.within(_lengths(spark, sf_dir), ["recording_id"], "length", (6.0, 12.0, 24.0))
    return found.select("recording_id", "n", *[F.round(c, 6).alias(c) for c in found.columns if c.startswith("within")])


def drift_by_fifth(spark, sf_dir):
    found = evaluation.by_fifth(_lengths(spark, sf_dir), ["recording_id"], "start_s", "length")
    return found.select("recording_id", "part", "n", F.round("mean", 6).alias("mean"), F.round("worst", 6).alias("worst"))


def crowding_report(spark, sf_dir):
    found = evaluation.crowding(*_moved(spark, sf_dir))
    return found.withColumn("worst_shift", F.round("worst_shift", 6))


def top_movers(spark, sf_dir):
    return evaluation.movers(*_moved(spark, sf_dir)).select("recording_id", "seq", F.round("shift", 6).alias("shift"), "rank")


def cosine_pairs(spark, sf_dir):
    """Every voice whose id is divisible by 100 against all others."""
    v = voices(spark, sf_dir)
    found = evaluation.query_pairs(v.where("vec_id % 100 = 0"), v)
    return found.select("a", "b", "same", F.round("distance", 5).alias("distance"))


def recording_pairs(spark, sf_dir):
    """All pairs of a recording's voices; forty vectors in a row are a recording's."""
    found = evaluation.voice_pairs(voices(spark, sf_dir), F.floor(F.col("vec_id") / 40))
    return found.select("recording_id", "a", "b", "same", F.round("distance", 5).alias("distance"))


def same_diff_gap(spark, sf_dir):
    """All pairs, from sums of unit vectors."""
    return same_diff_gap_all(spark, sf_dir)


def best_threshold(spark, sf_dir):
    """All pairs, from counts by distance."""
    return best_threshold_all(spark, sf_dir)


def same_diff_gap_all(spark, sf_dir):
    found = evaluation.mean_gap(voices(spark, sf_dir))
    return found.select(F.round("same", 5).alias("same"), F.round("different", 5).alias("different"), F.round(F.col("different") - F.col("same"), 5).alias("gap"))


def best_threshold_all(spark, sf_dir):
    found = evaluation.threshold_of(evaluation.pair_bins(voices(spark, sf_dir)))
    return found.select(F.round("threshold", 6).alias("threshold"), F.round("error", 6).alias("error"))


def mean_voices(spark, sf_dir):
    means = evaluation.mean_vectors(voices(spark, sf_dir), ["label"], ["vec_id"])
    return means.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


def nearest_voice(spark, sf_dir):
    v = voices(spark, sf_dir)
    found = evaluation.nearest_voice(v.select("vec_id", "embedding"), evaluation.mean_vectors(v, ["label"], ["vec_id"]))
    return found.select("vec_id", "voice", F.round("distance", 5).alias("distance"))


def chunk_windows(spark, sf_dir):
    recordings = segments(spark, sf_dir).groupBy("recording_id").agg(F.max("end_s").alias("duration_s"))
    found = evaluation.windows(recordings, 10.0, 2.0)
    return found.select("recording_id", "window_ix", F.round("start_s", 6).alias("start_s"), F.round("content_s", 6).alias("content_s"), "mostly_padding")


def waveform_peaks(spark, sf_dir):
    """The embeddings read as short recordings of 64 samples."""
    samples = voices(spark, sf_dir).select(F.col("vec_id").alias("recording_id"), F.posexplode("embedding").alias("i", "x"))
    return evaluation.peaks(samples, 10).select("recording_id", "bucket", F.round("peak", 5).alias("peak"))


def count_distinct_speakers(spark, sf_dir):
    return turns(spark, sf_dir).where(F.trim("speaker") != "").groupBy("recording_id").agg(F.count_distinct("speaker").alias("speakers"))


def session_activity(spark, sf_dir):
    """Sessions of a user's events with gaps under two days."""
    from talkgrid.sources.tables import table

    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = e.groupBy("user_id", F.session_window("at", "2 days").alias("w")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    return found.select("user_id", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


_V = f"WITH {sql.TURNS}, l AS (SELECT *, end_s - start_s AS length FROM v_turns)"
_K = f"{_V}, k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY length) - 1 AS rank, count(*) OVER (PARTITION BY recording_id) AS n FROM l)"
_MOVED = f"""{_V},
s AS (SELECT *, sum(greatest(0, length)) OVER (PARTITION BY recording_id ORDER BY turn_ix ROWS UNBOUNDED PRECEDING) AS upto FROM l),
e AS (SELECT *, upto + max(start_s - (upto - greatest(0, length))) OVER (PARTITION BY recording_id ORDER BY turn_ix ROWS UNBOUNDED PRECEDING) AS stop FROM s),
p AS (SELECT *, stop - greatest(0, length) AS ns FROM e), u AS (SELECT *, lead(ns) OVER (PARTITION BY recording_id ORDER BY turn_ix) AS nx FROM p),
m AS (SELECT recording_id, turn_ix AS seq, start_s, end_s, ns, CASE WHEN nx IS NULL THEN stop ELSE greatest(ns, least(stop, nx)) END AS ne FROM u)"""
_U = f"WITH {sql.VOICES}, n AS (SELECT vec_id, label, vec_id // 40 AS g, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS u FROM v_voices)"
_PAIRS = f"{_U}, pairs AS (SELECT a.g AS recording_id, a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, 1 - list_inner_product(a.u, b.u) AS distance FROM n a JOIN n b ON a.g = b.g AND a.vec_id < b.vec_id)"
_ALL_PAIRS = f"{_U}, pairs AS (SELECT a.label = b.label AS same, 1 - list_inner_product(a.u, b.u) AS distance FROM n a JOIN n b ON a.vec_id < b.vec_id)"
_MEANS = f"""{_U}, f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM n),
x AS (SELECT label, i, avg(u[i + 1]) AS x FROM (SELECT label, u, unnest(range(len(u))) AS i FROM f WHERE k <= 8) GROUP BY label, i),
w AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM x)"""

QUERIES = {
    f.__name__: f
    for f in (
        upper_median, index_percentiles, share_within, drift_by_fifth, crowding_report, top_movers, cosine_pairs, recording_pairs, same_diff_gap, best_threshold, same_diff_gap_all, best_threshold_all, mean_voices, nearest_voice, chunk_windows, waveform_peaks,
        count_distinct_speakers, session_activity,
    )
}

ORACLE_SQL = {
    "upper_median": f"{_K} SELECT recording_id, round(length, 6) AS median FROM k WHERE rank = n // 2",
    "index_percentiles": f"{_K} SELECT recording_id, p, round(length, 6) AS value FROM k, (SELECT unnest([0.5, 0.9, 0.95]::DOUBLE[]) AS p) WHERE rank = least(n - 1, CAST(floor(p * n) AS BIGINT))",
    "share_within": f"{_V} SELECT recording_id, count(*) AS n, round(avg(CASE WHEN abs(length) <= 6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_6_0, round(avg(CASE WHEN abs(length) <= 12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_12_0, round(avg(CASE WHEN abs(length) <= 24 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_24_0 FROM l GROUP BY recording_id",
    "drift_by_fifth": f"{_V}, b AS (SELECT *, min(start_s) OVER w AS f, max(start_s) OVER w AS t FROM l WINDOW w AS (PARTITION BY recording_id)), p AS (SELECT *, CAST(floor((start_s - f) * 5 / nullif(t - f, 0)) AS BIGINT) AS part FROM b) SELECT recording_id, part, count(*) AS n, round(avg(length), 6) AS mean, round(max(abs(length)), 6) AS worst FROM p WHERE part BETWEEN 0 AND 4 GROUP BY recording_id, part",
    "crowding_report": f"""{_MOVED}, o AS (SELECT *, CASE WHEN lag(end_s) OVER w - start_s > 0.05 THEN 1 ELSE 0 END AS ob, CASE WHEN lag(ne) OVER w - ns > 0.05 THEN 1 ELSE 0 END AS oa FROM m WINDOW w AS (PARTITION BY recording_id ORDER BY seq))
SELECT recording_id, CAST(sum(ob) AS BIGINT) AS overlaps_before, CAST(sum(oa) AS BIGINT) AS overlaps_after, count(*) FILTER (end_s - start_s > 0 AND ne - ns <= 0) AS swallowed, round(max(abs(ns - start_s)), 6) AS worst_shift FROM o GROUP BY recording_id""",
    "top_movers": f"{_MOVED}, r AS (SELECT recording_id, seq, ns - start_s AS shift, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY abs(ns - start_s) DESC, seq) AS INTEGER) AS rank FROM m) SELECT recording_id, seq, round(shift, 6) AS shift, rank FROM r WHERE rank <= 12",
    "cosine_pairs": f"{_U} SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, round(1 - list_inner_product(a.u, b.u), 5) AS distance FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0",
    "recording_pairs": f"{_PAIRS} SELECT recording_id, a, b, same, round(distance, 5) AS distance FROM pairs",
    "same_diff_gap_all": f"{_ALL_PAIRS} SELECT round(avg(distance) FILTER (same), 5) AS same, round(avg(distance) FILTER (NOT same), 5) AS different, round(avg(distance) FILTER (NOT same) - avg(distance) FILTER (same), 5) AS gap FROM pairs",
    "best_threshold_all": f"""{_ALL_PAIRS}, t AS (SELECT k, round(0.05::DOUBLE + k * 0.01::DOUBLE, 6) AS threshold FROM (SELECT unnest(range(146)) AS k)),
e AS (SELECT threshold, coalesce(count(*) FILTER (same AND NOT ceil((distance - 0.05::DOUBLE) / 0.01::DOUBLE) <= k) / nullif(count(*) FILTER (same), 0), 0) AS missed, coalesce(count(*) FILTER (NOT same AND ceil((distance - 0.05::DOUBLE) / 0.01::DOUBLE) <= k) / nullif(count(*) FILTER (NOT same), 0), 0) AS wrong FROM pairs, t GROUP BY threshold)
SELECT round(threshold, 6) AS threshold, round((missed + wrong) / 2, 6) AS error FROM e ORDER BY (missed + wrong) / 2, threshold LIMIT 1""",
    "mean_voices": f"{_MEANS} SELECT label, CAST(i AS INTEGER) AS i, round(x, 5) AS x FROM w",
    "nearest_voice": f"{_MEANS}, v AS (SELECT label, list(x ORDER BY i) AS m FROM w GROUP BY label), d AS (SELECT vec_id, v.label AS voice, 1 - list_inner_product(u, m) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY 1 - list_inner_product(u, m), v.label) AS k FROM n, v) SELECT vec_id, voice, round(distance, 5) AS distance FROM d WHERE k = 1",
    "chunk_windows": f"WITH {sql.SEGMENTS}, r AS (SELECT recording_id, max(end_s) AS d FROM v_segments GROUP BY recording_id), w AS (SELECT *, unnest(range(CAST(ceil(greatest(d - 10, 0) / 8) AS INTEGER) + 1)) AS k FROM r WHERE d > 0) SELECT recording_id, CAST(k AS INTEGER) AS window_ix, round(k * 8.0::DOUBLE, 6) AS start_s, round(least(10.0::DOUBLE, d - k * 8.0::DOUBLE), 6) AS content_s, least(10.0::DOUBLE, d - k * 8.0::DOUBLE) < 1.0 AS mostly_padding FROM w",
    "waveform_peaks": f"WITH {sql.VOICES}, s AS (SELECT vec_id AS recording_id, i, embedding[i + 1] AS x, len(embedding) AS n FROM (SELECT *, unnest(range(len(embedding))) AS i FROM v_voices)), b AS (SELECT recording_id, i * 10 // n AS bucket, max(abs(x)) AS peak FROM s GROUP BY recording_id, i * 10 // n) SELECT recording_id, bucket, round(CASE WHEN max(peak) OVER (PARTITION BY recording_id) > 1e-6 THEN peak / max(peak) OVER (PARTITION BY recording_id) ELSE peak END, 5) AS peak FROM b",
    "count_distinct_speakers": f"WITH {sql.TURNS} SELECT recording_id, count(DISTINCT speaker) AS speakers FROM v_turns WHERE trim(speaker) <> '' GROUP BY recording_id",
    "session_activity": "WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 DAYS AS new FROM events), i AS (SELECT *, sum(CASE WHEN new IS NULL OR new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM i GROUP BY user_id, s",
}
ORACLE_SQL |= {name: ORACLE_SQL[f"{name}_all"] for name in ("same_diff_gap", "best_threshold")}
