"""Queries over windows, anchors, agreement and corrections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrid.functions import ordered
from talkgrid.functions import text as t
from talkgrid.operators import diagnostics, evaluation, folds, frames, paragraphs, windows
from talkgrid.plans import sql
from talkgrid.sources.tables import dealt, segments, spoken, turns, voices
from talkgrid.streaming import live

STEP = 0.1
#: A made alphabet: a blank, letters from 5 on, and an apostrophe.
LETTERS, BLANK = ordered.alphabet({"<pad>": 0, "<blank>": 1, "|": 4, **{chr(97 + k): 5 + k for k in range(26)}, "'": 31})


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _recordings(spark, sf_dir):
    return segments(spark, sf_dir).groupBy("recording_id").agg(F.max("end_s").alias("duration_s"))


def sliding_windows(spark, sf_dir):
    return windows.sliding(_recordings(spark, sf_dir)).select("recording_id", "window_ix", *_r("start_s", "available_s"))


def margin_windows(spark, sf_dir):
    """Words of segments by windows of ten seconds with a margin of two: how many a window reads, and how many are its own."""
    s = segments(spark, sf_dir).withColumn("n", F.size(t.words("text")))
    found = windows.with_margins(s, "start_s", 10.0, 2.0)
    return found.groupBy("recording_id", "window_ix").agg(F.sum("n").alias("read"), F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("own"))


def adaptive_windows(spark, sf_dir):
    return windows.adaptive(_recordings(spark, sf_dir), segments(spark, sf_dir)).select("recording_id", "window_ix", *_r("start_s", "content_s"))


def credible_anchors(spark, sf_dir):
    """Segment starts as claims of how many letters are said by then, some of them far off."""
    s = segments(spark, sf_dir).withColumn("letters", F.length(t.letters("text")))
    w = Window.partitionBy("recording_id")
    upto = F.coalesce(F.sum("letters").over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumns({"token": upto, "tokens": F.sum("letters").over(w), "limit_s": F.max("end_s").over(w)})
    second = F.col("start_s") + F.when(F.col("seq") % 5 == 3, 60.0).otherwise(0.0) - F.when(F.col("seq") % 7 == 4, 20.0).otherwise(0.0)
    return windows.credible_anchors(s.withColumn("second", second)).select("recording_id", "seq", "token", *_r("second"))


def anchor_scales(spark, sf_dir):
    r = _recordings(spark, sf_dir)
    late = F.col("duration_s") * (0.9 + (F.col("recording_id") % 7) * 0.25)
    return r.select("recording_id", F.round(windows.anchor_scale(late, F.col("duration_s")), 6).alias("scale"))


def frame_agreement(spark, sf_dir):
    """Who segments name against who turns name, by frames of a tenth of a second, with a made level of sound."""
    heard = lambda s: dealt(s.select("recording_id", "speaker", "start_s", "end_s"), "recording_id")
    left, right = frames.rounded_paint(heard(segments(spark, sf_dir)), STEP), frames.rounded_paint(heard(spoken(spark, sf_dir)), STEP)
    every = dealt(_recordings(spark, sf_dir), "recording_id").select("recording_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration_s") / STEP) - 1)).alias("frame"))
    loud = (F.pmod(F.col("frame") * 37 + F.col("recording_id"), F.lit(101)) + 1) / 128.0
    found = evaluation.agreement(left, right, every.withColumn("power", loud * loud))
    return found.select("recording_id", "quiet", "only_left", "only_right", "tangled", "comparable", "agreed", *[F.round(c, 5).alias(c) for c in ("quiet_level", "left_level", "right_level", "speech_level")])


def _lengths(spark, sf_dir):
    return turns(spark, sf_dir).withColumn("length", F.col("end_s") - F.col("start_s"))


def sweep_percentiles(spark, sf_dir):
    found = evaluation.sweep_percentiles(_lengths(spark, sf_dir), ["recording_id"], "length", (0.05, 0.5, 0.95))
    return found.select("recording_id", "p", *_r("value"))


def share_without_lag(spark, sf_dir):
    found = evaluation.centred_within(_lengths(spark, sf_dir), ["recording_id"], "length", (6.0, 12.0))
    return found.select("recording_id", *_r("bias", "within_6_0", "within_12_0"))


def threshold_sweep(spark, sf_dir):
    """Forty vectors in a row are a recording's voices."""
    from talkgrid.plans.attribution import _stretches

    found = evaluation.threshold_sweep(_stretches(spark, sf_dir), (0.6, 0.8, 0.95))
    return found.select("recording_id", "threshold", "speakers", *_r("largest_share"))


def summed_voices(spark, sf_dir):
    found = evaluation.summed_vectors(voices(spark, sf_dir), ["label"], ["vec_id"])
    return found.select("label", F.posexplode("embedding").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


def run_times(spark, sf_dir):
    """A run's headline, its speed and how many windows it takes, for segments as recordings."""
    s = segments(spark, sf_dir).withColumns({"audio": F.when(F.col("seq") == 0, 0.0).otherwise(F.col("end_s") * 90), "took": F.col("end_s") * 7.3})
    steps = F.array(*[F.struct(F.lit(n).alias("label"), (F.col("took") * x).alias("seconds")) for n, x in (("listening", 0.6), ("naming", 0.02), ("writing", 0.003))])
    speed, all_windows = evaluation.times_real(F.col("audio"), F.col("took")), evaluation.windows_in_all((F.col("seq") + 1), F.col("start_s"), F.col("end_s") * 1.5)
    return s.select("recording_id", "seq", t.described("took", "audio", steps).alias("headline"), F.round(speed, 6).alias("speed"), all_windows.alias("windows"))


def selected_words(spark, sf_dir):
    """The words that a selection touches, somewhere in each segment."""
    first = ((F.col("seq") * 7 + F.col("recording_id") * 3) % 40).cast("int")
    found = t.words_around(F.col("text"), first, first + (F.col("seq") % 9).cast("int"))
    return segments(spark, sf_dir).select("recording_id", "seq", found.alias("w")).select("recording_id", "seq", F.col("w.start").alias("start"), F.col("w.words").alias("words"))


def token_cores(spark, sf_dir):
    """Words in quotes, as possessives and as written, in their parts; and whether a small one would match them."""
    s = segments(spark, sf_dir).select(F.explode(t.words("text")).alias("w")).distinct()
    s = s.select(F.explode(F.array("w", F.concat(F.lit("“"), "w", F.lit("’s”,")), F.concat(F.lit("("), "w", F.lit("'S)")))).alias("token"))
    p = t.token_parts("token")
    return s.select("token", p.getField("prefix").alias("prefix"), p.getField("core").alias("core"), p.getField("suffix").alias("suffix"), t.same_word(F.lower(p.getField("core")), p.getField("core")).alias("same")).distinct()


def correction_places(spark, sf_dir):
    return folds.correction_places(segments(spark, sf_dir), ["the"])


def correction_pairs(spark, sf_dir):
    """Two words that may end one segment and begin the next."""
    return folds.correction_places(segments(spark, sf_dir), ["th", "er"])


def spelled_tokens(spark, sf_dir):
    """The tokens of each segment's words: how many, and where each word's begin; words that can't be spelled are left out."""
    from talkgrid.operators.attribution import words_of

    w = words_of(segments(spark, sf_dir)).withColumn("tokens", ordered.letter_tokens("text", LETTERS))
    before = F.sum(F.size("tokens")).over(Window.partitionBy("recording_id", "seq").orderBy("word_ix").rowsBetween(Window.unboundedPreceding, 0)) - F.size("tokens")
    rows = w.withColumn("first", before).where(F.size("tokens") > 0)
    return rows.select("recording_id", "seq", "word_ix", F.col("first").cast("long").alias("first"), F.size("tokens").cast("long").alias("count"), F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ").alias("tokens"))


def window_conflicts(spark, sf_dir):
    """Speakers that talk in the same week, a quarter of an hour of each at least."""
    rows = turns(spark, sf_dir).withColumn("track", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("speaker")))
    names = rows.select("recording_id", "track", "speaker").distinct()
    found = folds.window_conflicts(rows.withColumns({"window_ix": F.floor(F.col("start_s") / (24.0 * 7)).cast("int"), "slot": F.col("track")}), 0.25)
    for side in ("a", "b"):
        found = found.withColumnRenamed(side, "track").join(names.withColumnRenamed("speaker", f"_{side}"), ["recording_id", "track"]).drop("track")
    return found.select("recording_id", F.col("_a").alias("a"), F.col("_b").alias("b"))


def two_sides(spark, sf_dir):
    """Speakers of a recording as tracks, by the weeks in which they talk at once."""
    rows = turns(spark, sf_dir).withColumn("track", F.dense_rank().over(Window.partitionBy("recording_id").orderBy("speaker")))
    spans = rows.withColumns({"window_ix": F.floor(F.col("start_s") / 24.0).cast("int"), "slot": F.col("track")})
    tracks = rows.groupBy("recording_id", "track").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    return folds.two_sides(tracks, folds.window_conflicts(spans, 6.0))


def readable_text(spark, sf_dir):
    return paragraphs.readable(segments(spark, sf_dir))


def paragraphs_at(spark, sf_dir):
    paras = paragraphs.paragraphs(segments(spark, sf_dir), longest=300)
    times = segments(spark, sf_dir).select("recording_id", "seq", ((F.col("start_s") + F.col("end_s")) / 2).alias("at_s"))
    return paragraphs.at_time(paras.select("recording_id", "para_ix", "start_s", "end_s"), times).select("recording_id", "seq", "para_ix")


def streamed_text(spark, sf_dir):
    """Segments that begin with the last three words of the one before and say six words twice, trimmed of both."""
    before = F.lag("text").over(Window.partitionBy("recording_id").orderBy("seq"))
    s = segments(spark, sf_dir).withColumn("previous", before).where("previous IS NOT NULL")
    last = F.array_join(F.slice(t.words("previous"), -F.least(F.lit(3), F.size(t.words("previous"))), 3), " ")
    s = s.where(F.size(t.words("previous")) > 0).withColumn("doubled", F.concat_ws(" ", last, F.lit("one two three four five six one two three four five six"), "text"))
    return s.select("recording_id", "seq", ordered.streamed_text("previous", "doubled").alias("trimmed"))


def due_passes(spark, sf_dir):
    """Segments as blocks of sound, a thousand samples a second and twenty of them a letter."""
    blocks = segments(spark, sf_dir).select("recording_id", F.col("seq").alias("block_ix"), (F.length("text") * 20 + 100).alias("n"))
    return live.due_passes(blocks, 1000, every=5.0).select("recording_id", "block_ix", *_r("now_s", "window_start_s", "content_s"))


def streamed_windows(spark, sf_dir):
    """Windows of a segment and the last five words of the one before."""
    before = F.lag("text").over(Window.partitionBy("recording_id").orderBy("seq"))
    s = segments(spark, sf_dir).withColumn("previous", F.coalesce(before, F.lit("")))
    tail = F.array_join(F.slice(t.words("previous"), F.greatest(F.lit(1), F.size(t.words("previous")) - 4), 5), " ")
    return live.streamed(s.select("recording_id", F.col("seq").alias("window_ix"), F.concat_ws(" ", tail, "text").alias("text")))


def word_edits(spark, sf_dir):
    before = F.lag("text").over(Window.partitionBy("recording_id").orderBy("seq"))
    rows = segments(spark, sf_dir).withColumn("previous", before).where("previous IS NOT NULL")
    rows = rows.select("recording_id", "seq", ordered.word_edits("previous", "text").alias("c"))
    return rows.select("recording_id", "seq", (F.col("c.replaced") + F.col("c.missing") + F.col("c.added")).alias("edits"), (F.col("c.added") - F.col("c.missing")).alias("longer"))


def shown_spans(spark, sf_dir):
    """Of three segments in a row one has measured words, one heard ones, and one none but an estimate."""
    from talkgrid.plans.attribution import _timed

    words = _timed(spark, sf_dir)
    late = words.withColumns({"start_s": F.col("start_s") + 0.5, "end_s": F.col("end_s") + 0.5})
    found = diagnostics.shown_spans(segments(spark, sf_dir), words.where("seq % 3 = 0"), late.where("seq % 3 <> 2"), words.withColumn("end_s", F.col("end_s") + 1))
    return found.select("recording_id", "seq", "kind", "head", *_r("start_s", "end_s", "words_from", "words_to"))


QUERIES = {
    f.__name__: f
    for f in (
        shown_spans,
        sliding_windows, margin_windows, adaptive_windows, credible_anchors, anchor_scales, frame_agreement, sweep_percentiles, share_without_lag, threshold_sweep, summed_voices, run_times, selected_words, token_cores,
        correction_places, correction_pairs, spelled_tokens, window_conflicts, two_sides, readable_text, paragraphs_at, streamed_text, word_edits, due_passes, streamed_windows,
    )
}

_S = f"WITH RECURSIVE {sql.SEGMENTS}"
_D = f"{_S}, r AS (SELECT recording_id, max(end_s) AS d FROM v_segments GROUP BY recording_id)"
_L = f"WITH {sql.TURNS}, l AS (SELECT *, end_s - start_s AS length FROM v_turns), k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY length) - 1 AS rank, count(*) OVER (PARTITION BY recording_id) AS n FROM l)"


def _clock(s: str) -> str:
    f = f"CAST(round_even(greatest(0, {s}), 0) AS BIGINT)"
    return f"CASE WHEN {f} >= 3600 THEN printf('%d:%02d:%02d', {f} // 3600, ({f} // 60) % 60, {f} % 60) ELSE printf('%d:%02d', {f} // 60, {f} % 60) END"


def _paint(name: str) -> str:
    rounded = lambda x: f"CAST(round_even({x} / 0.1::DOUBLE, 0) AS BIGINT)"
    return f"(SELECT recording_id, frame, CASE WHEN count(DISTINCT speaker) > 1 THEN '-2' ELSE min(speaker) END AS label FROM (SELECT *, unnest(range({rounded('start_s')}, {rounded('end_s')})) AS frame FROM {name}) GROUP BY ALL)"


_CORE = r"regexp_extract(token, '^[^\p{L}\p{Nd}]*((?:.*[\p{L}\p{Nd}])?)', 1)"
_LEVEL = "CASE WHEN count(*) FILTER ({0}) > 0 THEN round(10 * log10(greatest(1e-12, sum(power) FILTER ({0}) / count(*) FILTER ({0}))), 5) END"


def _bare_core(w: str) -> str:
    c = rf"regexp_extract({w}, '^[^\p{{L}}\p{{Nd}}]*((?:.*[\p{{L}}\p{{Nd}}])?)', 1)"
    return rf"CASE WHEN length({c}) > 2 AND regexp_matches({c}, '[''’][sS]$') THEN left({c}, length({c}) - 2) ELSE {c} END"


_CORES = f"{_S}, c AS (SELECT recording_id, seq, k - 1 AS word_ix, {_bare_core('w[k]')} AS core FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM (SELECT recording_id, seq, {sql.words('text')} AS w FROM v_segments)))"

_WEEKS = f"""WITH {sql.TURNS}, w AS (SELECT recording_id, CAST(floor(start_s / 168.0::DOUBLE) AS INTEGER) AS k, speaker, sum(end_s - start_s) AS held FROM v_turns GROUP BY ALL HAVING sum(end_s - start_s) >= 0.25)"""

def _shown_spans() -> str:
    from talkgrid.plans.attribution import _TIMED

    return f"""{_TIMED}, sp AS (SELECT recording_id, seq, arg_min(start_s, word_ix) AS f, arg_max(end_s, word_ix) AS t FROM tw GROUP BY recording_id, seq)
SELECT s.recording_id, s.seq, CASE WHEN sp.seq IS NULL THEN NULL WHEN s.seq % 3 = 0 THEN 'measured' WHEN s.seq % 3 = 1 THEN 'heard' ELSE 'estimate' END AS kind, CASE WHEN length(text) <= 40 THEN text ELSE left(text, 37) || '…' END AS head, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s,
  round(f + CASE WHEN s.seq % 3 = 1 THEN 0.5 ELSE 0 END, 6) AS words_from, round(t + CASE s.seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.5 ELSE 1 END, 6) AS words_to FROM v_segments s LEFT JOIN sp ON sp.recording_id = s.recording_id AND sp.seq = s.seq"""


ORACLE_SQL = {
    "shown_spans": _shown_spans(),
    "due_passes": f"""{_S}, h AS (SELECT recording_id, seq, sum(length(text) * 20 + 100) OVER (PARTITION BY recording_id ORDER BY seq) AS upto, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS k FROM v_segments),
g AS (SELECT recording_id, 0::BIGINT AS k, 0::HUGEINT AS last, false AS due FROM (SELECT DISTINCT recording_id FROM h) UNION ALL SELECT h.recording_id, h.k, CASE WHEN h.upto - g.last >= 5000 THEN h.upto ELSE g.last END, h.upto - g.last >= 5000 FROM g JOIN h ON h.recording_id = g.recording_id AND h.k = g.k + 1)
SELECT h.recording_id, h.seq AS block_ix, round(upto / 1000.0::DOUBLE, 6) AS now_s, round(greatest(0, upto - 30000) / 1000.0::DOUBLE, 6) AS window_start_s, round((upto - greatest(0, upto - 30000)) / 1000.0::DOUBLE, 6) AS content_s FROM h JOIN g ON g.recording_id = h.recording_id AND g.k = h.k WHERE g.due""",
    "window_conflicts": f"{_WEEKS} SELECT DISTINCT a.recording_id, a.speaker AS a, b.speaker AS b FROM w a JOIN w b ON a.recording_id = b.recording_id AND a.k = b.k AND a.speaker < b.speaker",
    "sliding_windows": f"{_D}, w AS (SELECT recording_id, d, unnest(range(CAST(ceil(d / 1.0::DOUBLE) AS BIGINT))) AS k FROM r WHERE d > 0) SELECT recording_id, CAST(k AS INTEGER) AS window_ix, round(k * 1.0::DOUBLE, 6) AS start_s, round(least(10.0::DOUBLE, d - k * 1.0::DOUBLE), 6) AS available_s FROM w WHERE least(10.0::DOUBLE, d - k * 1.0::DOUBLE) >= 2.5",
    "margin_windows": f"""{_S}, n AS (SELECT recording_id, start_s AS x, len({sql.words('text')}) AS n FROM v_segments), w AS (SELECT *, unnest(range(0, CAST(floor((x + 2) / 10) AS BIGINT) + 1)) AS k FROM n)
SELECT recording_id, k AS window_ix, CAST(sum(n) AS BIGINT) AS read, CAST(sum(CASE WHEN floor(x / 10) = k THEN n ELSE 0 END) AS BIGINT) AS own FROM w WHERE x >= k * 10 - 2 AND x < (k + 1) * 10 + 2 GROUP BY recording_id, k""",
    "adaptive_windows": f"""{_D}, g AS (SELECT recording_id, d, 0 AS k, 0.0::DOUBLE AS p FROM r WHERE d > 0 UNION ALL
  SELECT recording_id, d, k + 1, CASE WHEN e IS NOT NULL AND least(e - 2.0, p + least(30.0::DOUBLE, d - p)) > p + 1.0 THEN least(e - 2.0, p + least(30.0::DOUBLE, d - p)) ELSE p + 28.0 END FROM (
    SELECT g.recording_id, g.d, g.k, g.p, CASE WHEN arg_max(s.end_s, s.seq) > 0 THEN arg_max(s.end_s, s.seq) END AS e FROM g LEFT JOIN v_segments s ON s.recording_id = g.recording_id AND s.start_s >= g.p AND s.start_s < g.p + least(30.0::DOUBLE, g.d - g.p) AND least(30.0::DOUBLE, g.d - g.p) >= 1.0
    WHERE g.p + least(30.0::DOUBLE, g.d - g.p) < g.d GROUP BY g.recording_id, g.d, g.k, g.p) WHERE CASE WHEN e IS NOT NULL AND least(e - 2.0, p + least(30.0::DOUBLE, d - p)) > p + 1.0 THEN least(e - 2.0, p + least(30.0::DOUBLE, d - p)) ELSE p + 28.0 END < d)
SELECT recording_id, k AS window_ix, round(p, 6) AS start_s, round(least(30.0::DOUBLE, d - p), 6) AS content_s FROM g""",
    "credible_anchors": rf"""{_S}, l AS (SELECT *, length(regexp_replace(text, '\P{{L}}', '', 'g')) AS n FROM v_segments),
a AS (SELECT recording_id, seq, coalesce(sum(n) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token, sum(n) OVER (PARTITION BY recording_id) AS tokens, max(end_s) OVER (PARTITION BY recording_id) AS lim,
  start_s + CASE WHEN seq % 5 = 3 THEN 60.0 ELSE 0 END - CASE WHEN seq % 7 = 4 THEN 20.0 ELSE 0 END AS second FROM l)
SELECT recording_id, seq, token, round(second, 6) AS second FROM a WHERE tokens - token <= greatest(0, lim - second) * greatest(25.0, tokens / greatest(1.0, lim) * 2.5) AND token <= second * greatest(25.0, tokens / greatest(1.0, lim) * 2.5)""",
    "anchor_scales": f"{_D}, e AS (SELECT recording_id, d, d * (0.9::DOUBLE + (recording_id % 7) * 0.25::DOUBLE) AS late FROM r) SELECT recording_id, round(CASE WHEN late <= d OR d <= 0 THEN 1.0 ELSE greatest(0.5, d / late) END, 6) AS scale FROM e",
    "frame_agreement": f"""{_D}, {sql.SPOKEN}, f AS (SELECT recording_id, unnest(range(CAST(floor(d / 0.1::DOUBLE) AS BIGINT))) AS frame FROM r),
x AS (SELECT f.recording_id, f.frame, a.label AS a, b.label AS b, pow(((f.frame * 37 + f.recording_id) % 101 + 1) / 128.0::DOUBLE, 2) AS power FROM f LEFT JOIN {_paint('v_segments')} a USING (recording_id, frame) LEFT JOIN {_paint('v_spoken')} b USING (recording_id, frame)),
sh AS (SELECT recording_id, a, b, count(*) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY count(*) DESC, a, b) AS k FROM x WHERE a <> '-2' AND b <> '-2' GROUP BY recording_id, a, b),
g AS (SELECT recording_id, 0::BIGINT AS k, []::VARCHAR[] AS ua, []::VARCHAR[] AS ub, 0::BIGINT AS agreed FROM (SELECT DISTINCT recording_id FROM sh) UNION ALL
  SELECT s.recording_id, s.k, CASE WHEN list_contains(ua, s.a) OR list_contains(ub, s.b) THEN ua ELSE list_append(ua, s.a) END, CASE WHEN list_contains(ua, s.a) OR list_contains(ub, s.b) THEN ub ELSE list_append(ub, s.b) END, agreed + CASE WHEN list_contains(ua, s.a) OR list_contains(ub, s.b) THEN 0 ELSE s.n END
  FROM g JOIN sh s ON s.recording_id = g.recording_id AND s.k = g.k + 1),
c AS (SELECT recording_id, max(agreed) AS agreed FROM g GROUP BY recording_id)
SELECT x.recording_id, count(*) FILTER (a IS NULL AND b IS NULL) AS quiet, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS only_left, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS only_right,
  count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (a = '-2' OR b = '-2')) AS tangled, count(*) FILTER (a <> '-2' AND b <> '-2') AS comparable, coalesce(any_value(c.agreed), 0) AS agreed,
  {_LEVEL.format('a IS NULL AND b IS NULL')} AS quiet_level, {_LEVEL.format('a IS NOT NULL AND b IS NULL')} AS left_level, {_LEVEL.format('a IS NULL AND b IS NOT NULL')} AS right_level, {_LEVEL.format('a IS NOT NULL AND b IS NOT NULL')} AS speech_level
FROM x LEFT JOIN c ON c.recording_id = x.recording_id GROUP BY x.recording_id""",
    "sweep_percentiles": f"{_L} SELECT recording_id, p, round(length, 6) AS value FROM k, (SELECT unnest([0.05, 0.5, 0.95]::DOUBLE[]) AS p) WHERE rank = CAST(floor(p * (n - 1)) AS BIGINT)",
    "share_without_lag": f"""{_L}, b AS (SELECT recording_id, length AS bias FROM k WHERE rank = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)))
SELECT recording_id, round(any_value(bias), 6) AS bias, round(avg(CASE WHEN abs(length - bias) <= 6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_6_0, round(avg(CASE WHEN abs(length - bias) <= 12 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_12_0 FROM l JOIN b USING (recording_id) GROUP BY recording_id""",
    "summed_voices": f"WITH {sql.VOICES}, f AS (SELECT label, embedding AS e FROM v_voices QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5) SELECT label, CAST(i AS INTEGER) AS i, round(sum(e[i + 1]), 5) AS x FROM (SELECT label, e, unnest(range(len(e))) AS i FROM f) GROUP BY label, i",
    "run_times": f"""{_S}, x AS (SELECT recording_id, seq, start_s, end_s, CASE WHEN seq = 0 THEN 0.0 ELSE end_s * 90 END AS audio, end_s * 7.3::DOUBLE AS took FROM v_segments),
h AS (SELECT *, 'Done in ' || {_clock('took')} || CASE WHEN audio > 0 THEN ' for ' || {_clock('audio')} || ' of audio.' ELSE '.' END AS head,
  concat_ws(' · ', CASE WHEN took * 0.6::DOUBLE >= 0.5 THEN 'listening ' || {_clock('took * 0.6::DOUBLE')} END, CASE WHEN took * 0.02::DOUBLE >= 0.5 THEN 'naming ' || {_clock('took * 0.02::DOUBLE')} END, CASE WHEN took * 0.003::DOUBLE >= 0.5 THEN 'writing ' || {_clock('took * 0.003::DOUBLE')} END) AS named FROM x)
SELECT recording_id, seq, CASE WHEN named <> '' THEN head || ' ' || named || '.' ELSE head END AS headline, round(audio / greatest(0.001, took), 6) AS speed,
  CASE WHEN start_s >= end_s * 1.5 THEN seq + 1 ELSE seq + 1 + greatest(1, CAST(ceil((end_s * 1.5 - start_s) / greatest(greatest(start_s, 0.001) / (seq + 1), 0.001)) AS BIGINT)) END AS windows FROM h""",
    "selected_words": rf"""{_S}, a AS (SELECT recording_id, seq, text, length(text) AS n, least((seq * 7 + recording_id * 3) % 40, length(text)) AS a, least((seq * 7 + recording_id * 3) % 40 + seq % 9, length(text)) AS b FROM v_segments),
l AS (SELECT recording_id, seq, text, n, CASE WHEN a = b AND a = n AND a > 0 THEN a - 1 ELSE a END AS a, CASE WHEN a = b AND a = n AND a > 0 THEN a - 1 ELSE b END AS b FROM a),
e AS (SELECT recording_id, seq, text, length(regexp_replace(left(text, a), '[^\p{{Z}}\s]+$', '')) AS s, least(n, CASE WHEN a = b THEN a + 1 ELSE b END) AS b FROM l),
p AS (SELECT recording_id, seq, s, substring(text, s + 1, b + length(regexp_extract(substring(text, b + 1), '^([^\p{{Z}}\s]*)', 1)) - s) AS part FROM e),
w AS (SELECT recording_id, seq, s, part, {sql.words('part')} AS w FROM p),
c AS (SELECT recording_id, seq, s + length(regexp_extract(part, '^([\p{{Z}}\s]*)', 1)) + length(regexp_extract(w[1], '^([^\p{{L}}\p{{Nd}}]*)', 1)) AS start, list_transform(w, lambda y: {_bare_core('y')}) AS cores FROM w)
SELECT recording_id, seq, CASE WHEN len(list_filter(cores, lambda y: y <> '')) > 0 THEN CAST(start AS INTEGER) END AS start, CASE WHEN len(list_filter(cores, lambda y: y <> '')) > 0 THEN array_to_string(cores, ' ') END AS words FROM c""",
    "token_cores": rf"""{_S}, w AS (SELECT DISTINCT unnest({sql.words('text')}) AS w FROM v_segments), k AS (SELECT DISTINCT unnest([w, '“' || w || '’s”,', '(' || w || '''S)']) AS token FROM w),
p AS (SELECT token, CASE WHEN {_CORE} = '' THEN token ELSE regexp_extract(token, '^([^\p{{L}}\p{{Nd}}]*)', 1) END AS prefix, {_bare_core('token')} AS core FROM k)
SELECT token, prefix, core, substring(token, length(prefix) + length(core) + 1) AS suffix, lower(core) = core OR (regexp_matches(left(lower(core), 1), '\p{{Ll}}') AND regexp_matches(left(core, 1), '\p{{Lu}}') AND substring(lower(core), 2) = substring(core, 2)) AS same FROM p""",
    "correction_places": f"{_CORES} SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix FROM c WHERE core IN ('the', 'The')",
    "correction_pairs": f"{_CORES}, n AS (SELECT *, lead(core) OVER (PARTITION BY recording_id ORDER BY seq, word_ix) AS nx FROM c) SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix FROM n WHERE core IN ('th', 'Th') AND nx IN ('er', 'Er')",
    "spelled_tokens": rf"""{_S}, w AS (SELECT recording_id, seq, k - 1 AS word_ix, w[k] AS w FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM (SELECT recording_id, seq, {sql.words('text')} AS w FROM v_segments))),
l AS (SELECT recording_id, seq, word_ix, list_transform(list_filter(string_split(regexp_replace(strip_accents(replace(replace(replace(replace(lower(w), 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o'), '’', chr(39))), '[^a-z'']', '', 'g'), ''), lambda x: x <> ''), lambda x: CASE WHEN x = '''' THEN 31 ELSE ascii(x) - 92 END) AS t FROM w),
f AS (SELECT *, sum(len(t)) OVER (PARTITION BY recording_id, seq ORDER BY word_ix) - len(t) AS first FROM l)
SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix, CAST(first AS BIGINT) AS first, len(t) AS count, array_to_string(t, ' ') AS tokens FROM f WHERE len(t) > 0""",
    "readable_text": f"""{_S}, t AS (SELECT recording_id, seq, speaker, {sql.stripped('text')} AS x FROM v_segments), n AS (SELECT *, lag(speaker) OVER (PARTITION BY recording_id ORDER BY seq) AS p FROM t WHERE x <> ''),
i AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY seq) AS isl FROM n),
g AS (SELECT recording_id, isl, CASE WHEN trim(coalesce(min(speaker), '')) <> '' THEN min(speaker) || ':' || chr(10) ELSE '' END || string_agg(x, ' ' ORDER BY seq) AS line FROM i GROUP BY recording_id, isl)
SELECT recording_id, string_agg(line, chr(10) || chr(10) ORDER BY isl) AS text FROM g GROUP BY recording_id""",
    "word_edits": rf"""{_S}, p AS (SELECT recording_id, seq, {sql.bare_words('text')} AS y, lag({sql.bare_words('text')}) OVER (PARTITION BY recording_id ORDER BY seq) AS x FROM v_segments),
r AS (SELECT recording_id, seq, x, y, 0::BIGINT AS i, list_transform(range(0, len(y) + 1), lambda j: j) AS d FROM p WHERE x IS NOT NULL UNION ALL
  SELECT recording_id, seq, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: j - 1 + list_min(list_transform(range(1, j + 1), lambda k: CASE WHEN k = 1 THEN i + 1 ELSE least(d[k - 1] + CASE WHEN y[k - 1] = x[i + 1] THEN 0 ELSE 1 END, d[k] + 1) END - (k - 1)))) FROM r WHERE i < len(x))
SELECT recording_id, seq, d[len(y) + 1] AS edits, len(y) - len(x) AS longer FROM r WHERE i = len(x)""",
}

def _paragraphs_at() -> str:
    from talkgrid.plans import texts

    return texts.ORACLE_SQL["paragraphs"].rsplit(" SELECT recording_id, para_ix, speaker", 1)[0] + " SELECT s.recording_id, s.seq, para.para_ix FROM v_segments s JOIN para ON para.recording_id = s.recording_id AND para.start_s <= (s.start_s + s.end_s) / 2 AND (s.start_s + s.end_s) / 2 < para.end_s"


ORACLE_SQL["paragraphs_at"] = _paragraphs_at()
