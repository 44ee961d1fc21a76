"""Queries over score arrays, here the embeddings read as scores, samples or log probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgrid.functions import scores as s
from talkgrid.operators import frames
from talkgrid.plans import sql
from talkgrid.sources.tables import voices

#: Token numbers of a made vocabulary.
LANGUAGES = (3, 17, 40, 99)
SETS = s.class_sets(3, 2)


def _numbered(df, column: str, digits: int = 5):
    return df.select("vec_id", F.posexplode(column).alias("i", "x")).select("vec_id", "i", F.round("x", digits).alias("x"))


def log_probabilities(spark, sf_dir):
    return _numbered(voices(spark, sf_dir).withColumn("p", s.log_softmax(F.col("embedding"))), "p")


def token_confidence(spark, sf_dir):
    """The mean log probability of five tokens from a place that may lie outside."""
    v = voices(spark, sf_dir).withColumn("first", (F.col("vec_id") % 70 - 2).cast("int"))
    return v.select("vec_id", F.round(s.mean_run(s.log_softmax(F.col("embedding")), F.col("first"), F.lit(5)), 5).alias("confidence"))


def activity_probability(spark, sf_dir):
    return _numbered(voices(spark, sf_dir).withColumn("p", F.transform("embedding", lambda x: s.sigmoid(x * 8))), "p")


def unit_variance(spark, sf_dir):
    return _numbered(voices(spark, sf_dir).withColumn("p", s.unit_variance(F.col("embedding"))), "p")


def likeliest_language(spark, sf_dir):
    return voices(spark, sf_dir).select("vec_id", s.likeliest(F.col("embedding")).alias("token"), s.likeliest_of(F.col("embedding"), LANGUAGES).alias("language"))


def _active_frames(spark, sf_dir):
    """Every seven numbers of a vector are the class scores of a frame."""
    rows = voices(spark, sf_dir).where(F.size("embedding") >= 7).select(F.col("vec_id").alias("recording_id"), "embedding", F.explode(F.sequence(F.lit(0), F.floor(F.size("embedding") / 7).cast("int") - 1)).alias("frame"))
    return rows.select("recording_id", "frame", s.active(F.slice("embedding", F.col("frame") * 7 + 1, 7), SETS).alias("speakers"))


def active_speakers(spark, sf_dir):
    return _active_frames(spark, sf_dir).select("recording_id", "frame", F.explode("speakers").alias("speaker"))


def overlapped_frames(spark, sf_dir):
    """Runs of frames in which two or more speakers are active."""
    return frames.runs(_active_frames(spark, sf_dir).where(F.size("speakers") >= 2), ["recording_id"])


def opening_prompt(spark, sf_dir):
    v = voices(spark, sf_dir)
    language = F.when(F.col("vec_id") % 3 == 0, -1).otherwise(F.col("label"))
    prior = F.when(F.col("vec_id") % 2 == 0, F.array(F.col("label") + 100, F.col("label") + 101)).otherwise(F.array().cast("array<int>"))
    found = s.prompt(50258, 50359, language, 50259, 50361, prior, 50363)
    return v.select("vec_id", F.array_join(F.transform(found, lambda t: t.cast("string")), " ").alias("tokens"))


def token_times(spark, sf_dir):
    v = voices(spark, sf_dir).withColumn("token", (F.col("vec_id") % 1500 + 50000).cast("int"))
    return v.select("vec_id", F.round(s.token_seconds(F.col("token"), 50364), 6).alias("seconds"))


QUERIES = {f.__name__: f for f in (log_probabilities, token_confidence, activity_probability, unit_variance, likeliest_language, active_speakers, overlapped_frames, opening_prompt, token_times)}

_V = f"WITH {sql.VOICES}, m AS (SELECT vec_id, label, embedding AS e, list_max(embedding) AS top FROM v_voices)"
_P = f"{_V}, p AS (SELECT vec_id, list_transform(e, lambda x: x - top - ln(list_sum(list_transform(e, lambda y: exp(y - top))))) AS p FROM m)"
_EACH = "(SELECT *, unnest(range(len({0}))) AS i FROM {1})"
_ACTIVE = f"""{_V}, f AS (SELECT vec_id AS recording_id, k AS frame, e[k * 7 + 1:k * 7 + 7] AS c FROM (SELECT *, unnest(range(len(e) // 7)) AS k FROM m)),
a AS (SELECT recording_id, frame, CASE list_position(c, list_max(c)) WHEN 1 THEN []::INT[] WHEN 2 THEN [0] WHEN 3 THEN [1] WHEN 4 THEN [2] WHEN 5 THEN [0, 1] WHEN 6 THEN [0, 2] ELSE [1, 2] END AS speakers FROM f)"""

ORACLE_SQL = {
    "log_probabilities": f"{_P} SELECT vec_id, CAST(i AS INTEGER) AS i, round(p[i + 1], 5) AS x FROM {_EACH.format('p', 'p')}",
    "token_confidence": f"{_P}, r AS (SELECT vec_id, CAST(vec_id % 70 - 2 AS INTEGER) AS f, p FROM p) SELECT vec_id, round(CASE WHEN f < 0 OR f >= len(p) THEN 0.0 ELSE list_avg(p[f + 1:f + 5]) END, 5) AS confidence FROM r",
    "activity_probability": f"{_V} SELECT vec_id, CAST(i AS INTEGER) AS i, round(1 / (1 + exp(-8 * e[i + 1])), 5) AS x FROM {_EACH.format('e', 'm')}",
    "unit_variance": f"{_V} SELECT vec_id, CAST(i AS INTEGER) AS i, round((e[i + 1] - list_avg(e)) / sqrt(list_var_pop(e) + 1e-7), 5) AS x FROM {_EACH.format('e', 'm')}",
    "likeliest_language": f"{_V} SELECT vec_id, CAST(list_position(e, top) - 1 AS INTEGER) AS token, [3, 17, 40][list_position([e[4], e[18], e[41]], greatest(e[4], e[18], e[41]))] AS language FROM m",
    "active_speakers": f"{_ACTIVE} SELECT recording_id, CAST(frame AS INTEGER) AS frame, unnest(speakers) AS speaker FROM a",
    "overlapped_frames": f"""{_ACTIVE}, o AS (SELECT recording_id, frame, frame - row_number() OVER (PARTITION BY recording_id ORDER BY frame) AS run FROM a WHERE len(speakers) >= 2)
SELECT recording_id, CAST(min(frame) AS INTEGER) AS first_frame, CAST(max(frame) AS INTEGER) AS last_frame, count(*) AS n FROM o GROUP BY recording_id, run""",
    "opening_prompt": f"""{_V} SELECT vec_id, concat_ws(' ', CASE WHEN vec_id % 2 = 0 THEN '50361 ' || (label + 100) || ' ' || (label + 101) END, '50258', CASE WHEN vec_id % 3 = 0 OR label < 0 THEN 50259 ELSE label END, '50359', '50363') AS tokens FROM m""",
    "token_times": f"{_V} SELECT vec_id, CASE WHEN vec_id % 1500 + 50000 >= 50364 THEN round((vec_id % 1500 + 50000 - 50364) * 0.02::DOUBLE, 6) END AS seconds FROM m",
}
