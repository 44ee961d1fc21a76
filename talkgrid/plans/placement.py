"""Queries that place words by segment and by recording, and look for them near their times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrid.functions import scores
from talkgrid.functions import text as t
from talkgrid.operators import attribution as a
from talkgrid.operators import placement
from talkgrid.plans import grids, sql
from talkgrid.sources.shared import kept, new_folder
from talkgrid.sources.tables import dealt, segments

#: Seconds of a frame; a letter has three frames, its own in the middle.
STEP = 0.02


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _letters(word):
    return F.filter(F.split(t.letters(word), ""), lambda c: (c >= "a") & (c <= "z"))


def _spelled(spark, sf_dir, token):
    """Words with their tokens and the number of the recording's first letter in them."""
    w = a.words_of(dealt(segments(spark, sf_dir).select("recording_id", "seq", "text"), "recording_id")).withColumn("tokens", F.transform(_letters("text"), token))
    w = w.withColumn("_size", F.size("tokens"))
    by = Window.partitionBy("recording_id").orderBy("seq", "word_ix").rowsBetween(Window.unboundedPreceding, 0)
    return w.withColumn("first", F.sum("_size").over(by) - F.col("_size")).drop("_size", "offset")


def _once(words):
    """Words as a written table: what asks for them ten times doesn't take texts apart ten times."""
    return kept(words, new_folder(words.sparkSession, "spelled"), "words")


def _noisy(alphabet):
    """Scores of each token, with the noise of a frame's own that never outweighs them."""
    return [[(0.0 if i == token else -12.0) - (r + i * 17) % 13 / 16.0 for i in range(alphabet + 1)] for token in range(alphabet + 1) for r in range(13)]


def _number(token, ix):
    """The row of _noisy for a letter's frame."""
    return token * 13 + F.pmod(ix * 31, F.lit(13))


def _grid(words, alphabet, heard=lambda token, ix: token):
    """The letters of a recording one after the other, with a noise of every frame's own that never outweighs them."""
    tokens = words.select("recording_id", "first", F.posexplode("tokens").alias("i", "token")).withColumn("ix", F.col("first") + F.col("i"))
    rows = tokens.select("recording_id", "ix", heard(F.col("token"), F.col("ix")).alias("token"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    own = F.when(F.col("k") == 1, F.col("token")).otherwise(0)
    logp = scores.listed(_noisy(alphabet), _number(own, F.col("ix")))
    return rows.select("recording_id", (F.col("ix") * 3 + F.col("k")).alias("frame"), logp.alias("logp"))


#: Letters that are told apart, and segments in a row that have letters of their own.
KINDS, OWN = 6, 8


def aligned_twice(spark, sf_dir):
    """Every second short segment is stamped nine and a half seconds late: there the narrow window has none of it."""
    w = _spelled(spark, sf_dir, lambda c: (F.ascii(c) - 97) % KINDS + 1)
    w = w.withColumn("tokens", F.transform("tokens", lambda x: (x + KINDS * (F.col("seq") % OWN)).cast("int")))
    each = Window.partitionBy("recording_id", "seq")
    begin, n = F.min("first").over(each), F.sum(F.size("tokens")).over(each)
    late = F.when((F.col("seq") % 2 == 1) & (n < 100), 9.5).otherwise(0.25)
    w = w.withColumns({"start_s": begin * 3 * STEP + late, "end_s": (begin + n) * 3 * STEP + late, "_letters": F.size("tokens")})
    w = _once(w.drop("text"))
    lengths = w.groupBy("recording_id").agg((F.sum("_letters") * 3).alias("length"))
    cut = lambda part, around: grids.windows_of(w, placement.spans_of(part, lengths, STEP, around), _noisy(KINDS * OWN), _number)
    found = placement.place_windows_twice(cut, w.drop("_letters"), STEP)
    return found.select("recording_id", "seq", "word_ix", *_r("start_s", "end_s", "grade"), "wide")


def word_shifts(spark, sf_dir):
    """Words whose times are off by up to three seconds, where every seventh letter is heard as the next one."""
    w = _spelled(spark, sf_dir, lambda c: (F.ascii(c) - 96))
    off = ((F.col("seq") * 5 + F.col("word_ix") * 3) % 13 - 6) * 0.5
    w = w.withColumns({"start_s": (F.col("first") * 3 + 1) * STEP + off, "end_s": (F.col("first") + F.size("tokens")) * 3 * STEP + off})
    heard = lambda token, ix: F.when(ix % 7 == 3, token % 26 + 1).otherwise(token)
    found = placement.locate(_grid(w, 26, heard), w.where("start_s >= 0"), STEP)
    return found.select("recording_id", "seq", "word_ix", "shift_s", *_r("likeness"))


def aligned_trials(spark, sf_dir):
    """Every fifth segment is written twice, and each recording has a last line that nobody said; why lines go, and the times of the rest."""
    s = segments(spark, sf_dir).select("recording_id", (F.col("seq") * 2).alias("seq"), "text")
    copies = s.where("(seq / 2) % 5 = 1").withColumn("seq", F.col("seq") + 1)
    w = _once(_spelled(spark, sf_dir, lambda c: (F.ascii(c) - 96)).withColumn("seq", F.col("seq") * 2))
    grid = grids.rows_of(w, _noisy(26), _number).drop("final")
    each = Window.partitionBy("recording_id", "seq")
    begin = F.min("first").over(each)
    w = w.withColumns({"start_s": begin * 3 * STEP, "end_s": (begin + F.sum(F.size("tokens")).over(each)) * 3 * STEP}).drop("text", "first")
    ends = w.groupBy("recording_id").agg(F.max("end_s").alias("limit"), F.max("seq").alias("seq"))
    unsaid = ends.select("recording_id", (F.col("seq") + 2).alias("seq"), F.lit("quartz jukebox").alias("text"), F.col("limit").alias("start_s"), (F.col("limit") + 40).alias("end_s"))
    words = w.unionByName(w.join(copies.select("recording_id", "seq"), [w.recording_id == copies.recording_id, w.seq + 1 == copies.seq]).select(w.recording_id, copies.seq, "word_ix", "tokens", "start_s", "end_s"))
    more = unsaid.select("recording_id", "seq", F.posexplode(F.split("text", " ")).alias("word_ix", "word"), "start_s", "end_s")
    words = words.unionByName(more.select("recording_id", "seq", "word_ix", F.transform(_letters("word"), lambda c: F.ascii(c) - 96).alias("tokens"), "start_s", "end_s"))
    stamps = w.select("recording_id", "seq", "start_s", "end_s").distinct()
    lines = s.unionByName(copies).withColumn("_at", F.floor(F.col("seq") / 2) * 2)
    stamped = stamps.withColumnRenamed("seq", "_at")
    lines = lines.join(stamped, ["recording_id", "_at"]).drop("_at").unionByName(unsaid)
    times, dropped = placement.align_with_trials(grid, words, lines, STEP)
    kept = times.groupBy("recording_id", "seq").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.lit(None).cast("string").alias("why"))
    gone = dropped.select("recording_id", "seq", F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"), "why")
    return kept.unionByName(gone).select("recording_id", "seq", *_r("start_s", "end_s"), "why")


QUERIES = {f.__name__: f for f in (aligned_twice, word_shifts, aligned_trials)}

_WORDS = rf"""WITH RECURSIVE {sql.SEGMENTS}, x AS (SELECT recording_id, seq, {sql.words('text')} AS w FROM v_segments),
o AS (SELECT recording_id, seq, k - 1 AS word_ix, list_filter(string_split(lower(regexp_replace(w[k], '\P{{L}}', '', 'g')), ''), lambda c: c >= 'a' AND c <= 'z') AS l FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM x)),
g AS (SELECT *, len(l) AS n, sum(len(l)) OVER (PARTITION BY recording_id ORDER BY seq, word_ix) - len(l) AS f, sum(len(l)) OVER (PARTITION BY recording_id, seq) AS m FROM o)"""

ORACLE_SQL = {
    # A segment's letters are its own, so each lies in its frame; a word without letters takes the end of the one before, the first of all the window's begin.
    "aligned_twice": f"""{_WORDS}, b AS (SELECT *, min(f) OVER (PARTITION BY recording_id, seq) AS h, last_value(CASE WHEN n > 0 THEN f + n END IGNORE NULLS) OVER (PARTITION BY recording_id, seq ORDER BY word_ix ROWS UNBOUNDED PRECEDING) AS past FROM g WHERE m > 0),
w AS (SELECT *, seq % 2 = 1 AND m < 100 AS wide, h * 0.06::DOUBLE + CASE WHEN seq % 2 = 1 AND m < 100 THEN -0.5 ELSE -2.75 END AS open FROM b),
e AS (SELECT *, CASE WHEN past IS NULL THEN greatest(0, floor(open / 0.02::DOUBLE + 1e-9)) * 0.02::DOUBLE ELSE ((past - 1) * 3 + 2) * 0.02::DOUBLE END AS stop FROM w)
SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix, round(CASE WHEN n > 0 THEN greatest((f * 3 + 1) * 0.02::DOUBLE, stop - 1.5) ELSE stop END, 6) AS start_s, round(stop, 6) AS end_s, 1.0::DOUBLE AS grade, wide FROM e""",
    "word_shifts": f"""{_WORDS}, c AS (SELECT recording_id, f + i AS ix, ascii(l[i + 1]) - 96 AS token FROM (SELECT *, unnest(range(len(l))) AS i FROM g)),
hl AS (SELECT recording_id, list(CASE WHEN ix % 7 = 3 THEN chr(CAST(97 + token % 26 AS INTEGER)) ELSE chr(CAST(96 + token AS INTEGER)) END ORDER BY ix) AS h FROM c GROUP BY recording_id),
w AS (SELECT recording_id, seq, word_ix, l, n, (f * 3 + 1) * 0.02::DOUBLE + ((seq * 5 + word_ix * 3) % 13 - 6) * 0.5::DOUBLE AS s, (f + n) * 3 * 0.02::DOUBLE + ((seq * 5 + word_ix * 3) % 13 - 6) * 0.5::DOUBLE AS e FROM g WHERE n >= 7),
sh AS (SELECT *, unnest(range(-20, 21)) * 0.25::DOUBLE AS shift FROM w WHERE s >= 0),
y AS (SELECT sh.recording_id, seq, word_ix, shift, l AS x, n, h[CAST(greatest(0, ceil((floor((s + shift) / 0.02::DOUBLE + 1e-9) - 1) / 3)) + 1 AS INTEGER):CAST(ceil((floor((s + shift + (e - s) + 0.25) / 0.02::DOUBLE + 1e-9) - 1) / 3) AS INTEGER)] AS y FROM sh JOIN hl USING (recording_id) WHERE s + shift >= 0),
r AS (SELECT recording_id, seq, word_ix, shift, n, x, y, 0::BIGINT AS i, list_transform(range(0, len(y) + 1), lambda j: 0::BIGINT) AS best FROM y UNION ALL
  SELECT recording_id, seq, word_ix, shift, n, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: greatest(best[j], coalesce(list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND y[k - 1] = x[i + 1] THEN best[k - 1] + 1 ELSE 0 END)), 0))) FROM r WHERE i < n)
SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix, shift AS shift_s, round(best[len(y) + 1] / n::DOUBLE, 6) AS likeness FROM r WHERE i = n AND best[len(y) + 1] / n::DOUBLE > 0.6
QUALIFY row_number() OVER (PARTITION BY recording_id, seq, word_ix ORDER BY best[len(y) + 1] DESC, abs(shift), shift) = 1""",
}
