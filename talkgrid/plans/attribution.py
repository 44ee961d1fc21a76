"""Queries that divide segments and words between speakers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrid.functions import text as t
from talkgrid.operators import alignment, sequence
from talkgrid.operators import attribution as a
from talkgrid.plans import grids, sql
from talkgrid.sources.tables import dealt, segments, spoken, voices

#: A bucket of a minute of speech.
MINUTE = 60.0


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def _timed(spark, sf_dir):
    """The words of segments, timed by their letters; every seventh has no length."""
    s = segments(spark, sf_dir)
    rows = a.words_of(s).join(s.select("recording_id", "seq", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.length("text").alias("_n")), ["recording_id", "seq"])
    at = lambda x: F.col("_s") + (F.col("_e") - F.col("_s")) * x / F.greatest(F.col("_n"), F.lit(1))
    end = F.when((F.col("word_ix") + F.col("seq")) % 7 == 3, at(F.col("offset"))).otherwise(at(F.col("offset") + F.length("text")))
    return rows.select("recording_id", "seq", "word_ix", "text", "offset", at(F.col("offset")).alias("start_s"), end.alias("end_s"))


def word_offsets(spark, sf_dir):
    return a.words_of(segments(spark, sf_dir))


def snapped_turns(spark, sf_dir):
    return a.snap_turns(spoken(spark, sf_dir), segments(spark, sf_dir)).select("recording_id", "turn_ix", "speaker", *_r("start_s", "end_s"))


def split_segments(spark, sf_dir):
    found = a.split_by_turns(segments(spark, sf_dir), spoken(spark, sf_dir))
    return found.select("recording_id", "seq", "piece", "speaker", "text", *_r("start_s", "end_s"))


def word_labels(spark, sf_dir):
    return a.label_words(_timed(spark, sf_dir), spoken(spark, sf_dir)).select("recording_id", "seq", "word_ix", "label")


def worded_pieces(spark, sf_dir):
    """Segments cut by word, none ending after the next begins."""
    found = a.divide_by_words(segments(spark, sf_dir), _timed(spark, sf_dir), spoken(spark, sf_dir))
    found = found.withColumn("place", F.struct("seq", "piece"))
    return sequence.untangle(found, by="place").select("recording_id", "seq", "piece", "speaker", "text", *_r("start_s", "end_s"))


def measured_words(spark, sf_dir):
    """Words with times measured elsewhere; of every fifth segment one word was not."""
    own = a.words_of(segments(spark, sf_dir))
    measured = _timed(spark, sf_dir).where("NOT (seq % 5 = 4 AND word_ix = 1)")
    return a.measured_words(own, measured).select("recording_id", "seq", "word_ix", "text", "offset", *_r("start_s", "end_s"))


def nearest_stretch(spark, sf_dir):
    """Turns go to that of their speaker's three longest segments whose middle is nearest."""
    s = segments(spark, sf_dir)
    w = Window.partitionBy("recording_id", "speaker").orderBy(F.desc(F.length("text")), "seq")
    stretches = s.withColumn("stretch_ix", F.row_number().over(w)).where("stretch_ix <= 3").select("recording_id", "speaker", "stretch_ix", F.col("seq").alias("group"), "start_s", "end_s")
    return a.nearest_middle(spoken(spark, sf_dir), stretches, "turn_ix", ("recording_id", "speaker")).select("recording_id", "turn_ix", "group")


def _stretches(spark, sf_dir):
    """Forty vectors in a row are a recording's voices; every third is short."""
    v = voices(spark, sf_dir).withColumns({"recording_id": F.floor(F.col("vec_id") / 40), "start_s": (F.col("vec_id") % 40) * 2.0})
    length = F.when(F.col("vec_id") % 3 == 0, 0.5).otherwise(1.5)
    return v.select("recording_id", F.col("vec_id").alias("voice_ix"), "embedding", "start_s", (F.col("start_s") + length).alias("end_s"))


def nearest_reliable(spark, sf_dir):
    found = a.nearest_reliable(_stretches(spark, sf_dir), threshold=0.6)
    return found.select("recording_id", "voice_ix", "nearest", F.round("score", 5).alias("score"), "stranger")


def attached_voices(spark, sf_dir):
    return a.attach_short(_stretches(spark, sf_dir), threshold=0.8)


def loudness_words(spark, sf_dir):
    """Words of two phrases over vectors read as seconds of sound, a block of 16 samples each; the second phrase lasts to the end."""
    v = voices(spark, sf_dir)
    blocks = v.select(F.col("vec_id").alias("recording_id"), "embedding", F.explode(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 16) - 1)).alias("k"))
    blocks = blocks.select("recording_id", F.col("k").cast("long").alias("block_ix"), F.slice("embedding", F.col("k").cast("int") * 16 + 1, 16).alias("samples"))
    said = F.array(F.struct(F.lit(0).alias("seq"), F.lit("Well, let us begin the meeting now").alias("text"), F.lit(0.5).alias("s"), F.lit(2.75).alias("e")), F.struct(F.lit(1).alias("seq"), F.lit("  a second  one").alias("text"), F.lit(2.75).alias("s"), (F.size("embedding") / 16.0).alias("e")))
    s = v.select(F.col("vec_id").alias("recording_id"), F.explode(said).alias("x")).select("recording_id", F.col("x.seq").cast("long").alias("seq"), "x.text", F.col("x.s").alias("start_s"), F.col("x.e").alias("end_s"))
    return a.time_words(s, blocks, 16).select("recording_id", "seq", "word_ix", "text", *_r("start_s", "end_s"))


def _recorded(spark, sf_dir, row=250):
    """Whole recordings in made score grids, three frames of .05 s a letter, the letter favoured in the middle one; the segments' stamps run
    ever later than that, and jump about. The grid, so many letters a row, and the words with their tokens."""
    s = dealt(segments(spark, sf_dir).select("recording_id", "seq", "text"), "recording_id")
    letters = F.filter(F.split(t.letters("text"), ""), lambda c: (c >= "a") & (c <= "z"))
    w = a.words_of(s).withColumn("tokens", F.transform(letters, lambda c: (F.ascii(c) - 96)))
    by = Window.partitionBy("recording_id")
    w = w.withColumn("first", F.sum(F.size("tokens")).over(by.orderBy("seq", "word_ix").rowsBetween(Window.unboundedPreceding, 0)) - F.size("tokens"))
    each = Window.partitionBy("recording_id", "seq")
    jump = ((F.col("seq") * 7) % 5 - 2) * 0.2
    start, end = F.min("first").over(each) * 0.15 * 1.1 + jump, F.max(F.col("first") + F.size("tokens")).over(each) * 0.15 * 1.1 + jump
    w = w.withColumns({"start_s": start, "end_s": end})
    favoured = [[0.0 if i == token else -12.0 for i in range(27)] for token in range(27)]
    return grids.rows_of(w, favoured, lambda token, ix: token, row=row), w


def aligned_words(spark, sf_dir):
    return alignment.align_recordings(*_recorded(spark, sf_dir), 0.05).select("recording_id", "seq", "word_ix", *_r("start_s", "end_s"))


QUERIES = {f.__name__: f for f in (aligned_words, word_offsets, snapped_turns, split_segments, word_labels, worded_pieces, measured_words, nearest_stretch, nearest_reliable, attached_voices, loudness_words)}

_S = f"WITH RECURSIVE {sql.SEGMENTS}, {sql.SPOKEN}"
_OFFSETS = rf"""x AS (SELECT recording_id, seq, text, regexp_extract_all(text, '[^\p{{Z}}\s]+') AS w, regexp_extract_all(text, '[\p{{Z}}\s]+') AS g, regexp_matches(text, '^[\p{{Z}}\s]') AS f FROM v_segments),
o AS (SELECT recording_id, seq, k - 1 AS word_ix, w[k] AS text, CAST(coalesce(list_sum(list_transform(w[1:k - 1], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(CASE WHEN f THEN g[1:k] ELSE g[1:k - 1] END, lambda y: length(y))), 0) AS INTEGER) AS off
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM x))"""
_TIMED = f"""{_S}, {_OFFSETS},
tw AS (SELECT o.*, s.start_s + (s.end_s - s.start_s) * o.off / greatest(length(s.text), 1) AS start_s, s.start_s + (s.end_s - s.start_s) * (o.off + CASE WHEN (word_ix + seq) % 7 = 3 THEN 0 ELSE length(o.text) END) / greatest(length(s.text), 1) AS end_s
  FROM o JOIN v_segments s USING (recording_id, seq))"""
_LABELS = f"""{_TIMED}, worth AS (SELECT * FROM v_spoken WHERE end_s - start_s >= 0.5),
tail AS (SELECT recording_id, seq, word_ix, greatest(start_s, end_s - 1.5) AS start_s, end_s FROM tw WHERE end_s > start_s),
pick AS (SELECT t.recording_id, t.seq, t.word_ix, w.speaker, row_number() OVER (PARTITION BY t.recording_id, t.seq, t.word_ix ORDER BY {sql.shared('t', 'w')} DESC, w.turn_ix) AS k FROM tail t JOIN worth w USING (recording_id)),
own AS (SELECT tw.recording_id, tw.seq, tw.word_ix, tw.text, tw.off, tw.start_s, tw.end_s, p.speaker AS label FROM tw LEFT JOIN pick p ON p.k = 1 AND p.recording_id = tw.recording_id AND p.seq = tw.seq AND p.word_ix = tw.word_ix),
lab AS (SELECT recording_id, seq, word_ix, text, off, start_s, end_s, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY recording_id, seq ORDER BY word_ix ROWS UNBOUNDED PRECEDING), first_value(label IGNORE NULLS) OVER (PARTITION BY recording_id, seq ORDER BY word_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS label FROM own)"""
_FINISH = r"regexp_matches({0}, '[.!?…:;][^\p{{L}}\p{{Nd}}.!?…:;]*$')"
def steady(source: str) -> str:
    """Common table expressions that steady the labels (label, by word_ix) of a source's segments; the last is steady."""
    return f"""l0 AS (SELECT recording_id, seq, list(label ORDER BY word_ix) AS l, list(text ORDER BY word_ix) AS w FROM {source} GROUP BY recording_id, seq),
st AS (SELECT recording_id, seq, 2 AS i, l, w FROM l0 UNION ALL
  SELECT recording_id, seq, i + 1, CASE WHEN l[i] <> l[i - 1] AND l[i - 1] = l[i + 1] THEN list_concat(l[1:i - 1], [l[i - 1]], l[i + 1:]) ELSE l END, w FROM st WHERE i < len(l)),
s1 AS (SELECT recording_id, seq, w, CASE WHEN len(l) > 1 THEN list_concat([l[2]], l[2:]) ELSE l END AS l FROM st WHERE i = greatest(2, len(l))),
s2 AS (SELECT *, 1 + coalesce(list_max(list_filter(range(1, len(l)), lambda k: l[k] <> l[k + 1])), 0) AS b FROM s1),
s3 AS (SELECT recording_id, seq, CASE WHEN b > 1 AND len(l) - b + 1 <= 4 AND NOT {_FINISH.format('w[b - 1]')} AND {_FINISH.format('w[len(w)]')} THEN list_concat(l[1:b - 1], list_transform(l[b:], lambda x: l[b - 1])) ELSE l END AS l FROM s2),
steady AS (SELECT recording_id, seq, k - 1 AS word_ix, l[k] AS label FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM s3))"""


_STEADY = f"{_LABELS}, {steady('lab')}"

ORACLE_SQL = {
    "aligned_words": rf"""{_S}, {_OFFSETS}, n AS (SELECT recording_id, seq, word_ix, len(list_filter(string_split(lower(regexp_replace(text, '\P{{L}}', '', 'g')), ''), lambda x: x >= 'a' AND x <= 'z')) AS n FROM o),
g AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY seq, word_ix) - n AS f, sum(n) OVER (PARTITION BY recording_id, seq) AS m FROM n),
b AS (SELECT *, last_value(CASE WHEN n > 0 THEN f + n END IGNORE NULLS) OVER (PARTITION BY recording_id, seq ORDER BY word_ix ROWS UNBOUNDED PRECEDING) AS past, min(f) OVER (PARTITION BY recording_id, seq) AS head FROM g WHERE m > 0)
SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix, round(CASE WHEN n > 0 THEN (f * 3 + 1) * 0.05::DOUBLE WHEN past IS NULL THEN (head * 3 + 1) * 0.05::DOUBLE ELSE ((past - 1) * 3 + 2) * 0.05::DOUBLE END, 6) AS start_s,
  round(CASE WHEN n > 0 THEN ((f + n - 1) * 3 + 2) * 0.05::DOUBLE WHEN past IS NULL THEN (head * 3 + 1) * 0.05::DOUBLE ELSE ((past - 1) * 3 + 2) * 0.05::DOUBLE END, 6) AS end_s FROM b""",
    "word_offsets": f'{_S}, {_OFFSETS} SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix, text, off AS "offset" FROM o',
    "snapped_turns": f"""{_S}, g AS (SELECT recording_id, start_s FROM v_segments QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seq) > 1),
p AS (SELECT recording_id, turn_ix, speaker, start_s, end_s, (SELECT max(g.start_s) FROM g WHERE g.recording_id = t.recording_id AND g.start_s BETWEEN t.start_s - 0.9 AND t.start_s + 0.2) AS snap, row_number() OVER (PARTITION BY recording_id ORDER BY turn_ix) AS k FROM v_spoken t),
r AS (SELECT recording_id, k, start_s AS s, false AS moved FROM p WHERE k = 1 UNION ALL
  SELECT p.recording_id, p.k, CASE WHEN p.snap > r.s AND p.snap < p.end_s THEN p.snap ELSE p.start_s END, coalesce(p.snap > r.s AND p.snap < p.end_s, false) FROM r JOIN p ON p.recording_id = r.recording_id AND p.k = r.k + 1)
SELECT p.recording_id, p.turn_ix, p.speaker, round(r.s, 6) AS start_s, round(CASE WHEN n.moved THEN n.s ELSE p.end_s END, 6) AS end_s FROM p JOIN r USING (recording_id, k) LEFT JOIN r n ON n.recording_id = p.recording_id AND n.k = p.k + 1""",
    "split_segments": rf"""{_S}, m AS (SELECT s.recording_id, s.seq, t.turn_ix, t.speaker, t.start_s, t.end_s FROM v_segments s JOIN v_spoken t ON t.recording_id = s.recording_id AND t.start_s < s.end_s AND t.end_s > s.start_s),
n AS (SELECT s.recording_id, s.seq, s.text, s.speaker, s.start_s, s.end_s, (SELECT count(*) FROM m WHERE m.recording_id = s.recording_id AND m.seq = s.seq) AS turns,
  list_filter(string_split(regexp_replace({sql.stripped('s.text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {sql.stripped('x')} <> '') AS c FROM v_segments s),
q AS (SELECT *, CASE WHEN turns > 1 AND len(c) > 1 THEN c ELSE [text] END AS parts FROM n),
e AS (SELECT recording_id, seq, speaker, turns, parts, k, parts[k] AS part, CASE WHEN len(parts) > 1 THEN start_s + (end_s - start_s) * (list_sum(list_transform(parts[1:k], lambda x: length(x))) - length(parts[k])) / list_sum(list_transform(parts, lambda x: length(x))) ELSE start_s END AS s,
  CASE WHEN len(parts) > 1 THEN start_s + (end_s - start_s) * list_sum(list_transform(parts[1:k], lambda x: length(x))) / list_sum(list_transform(parts, lambda x: length(x))) ELSE end_s END AS e FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM q)),
w AS (SELECT e.recording_id, e.seq, e.k, m.speaker, row_number() OVER (PARTITION BY e.recording_id, e.seq, e.k ORDER BY greatest(0, least(e.e, m.end_s) - greatest(e.s, m.start_s)) DESC, m.start_s, m.turn_ix) AS rk FROM e JOIN m USING (recording_id, seq)),
l AS (SELECT e.recording_id, e.seq, e.k, e.part, e.s, e.e, CASE WHEN e.turns > 0 THEN w.speaker ELSE e.speaker END AS who FROM e LEFT JOIN w ON w.rk = 1 AND w.recording_id = e.recording_id AND w.seq = e.seq AND w.k = e.k),
i AS (SELECT *, sum(CASE WHEN k > 1 AND who IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, seq ORDER BY k) AS island FROM (SELECT *, lag(who) OVER (PARTITION BY recording_id, seq ORDER BY k) AS prev FROM l))
SELECT recording_id, seq, CAST(island - 1 AS BIGINT) AS piece, min(who) AS speaker, string_agg(part, ' ' ORDER BY k) AS text, round(min(s), 6) AS start_s, round(max(e), 6) AS end_s FROM i GROUP BY recording_id, seq, island""",
    "word_labels": f"{_LABELS} SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix, label FROM lab",
    "worded_pieces": f"""{_STEADY}, j AS (SELECT lab.*, steady.label AS who FROM lab JOIN steady ON steady.recording_id = lab.recording_id AND steady.seq = lab.seq AND steady.word_ix = lab.word_ix),
i AS (SELECT *, sum(CASE WHEN word_ix > 0 AND who IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id, seq ORDER BY word_ix) AS island FROM (SELECT *, lag(who) OVER (PARTITION BY recording_id, seq ORDER BY word_ix) AS prev FROM j)),
u AS (SELECT recording_id, seq, island, min(who) AS who, min(off) AS f, arg_min(start_s, word_ix) AS s, greatest(arg_max(end_s, word_ix), arg_min(start_s, word_ix)) AS e FROM i GROUP BY recording_id, seq, island),
v AS (SELECT u.*, lead(f) OVER (PARTITION BY u.recording_id, u.seq ORDER BY island) AS t, count(*) OVER (PARTITION BY u.recording_id, u.seq) AS n, g.text, g.start_s AS gs, g.end_s AS ge FROM u JOIN v_segments g USING (recording_id, seq)),
pc AS (SELECT recording_id, seq, CAST(island - 1 AS BIGINT) AS piece, who AS speaker, CASE WHEN n = 1 THEN text ELSE {sql.stripped('substring(text, f + 1, coalesce(t, length(text)) - f)')} END AS text, CASE WHEN n = 1 THEN gs ELSE s END AS s, CASE WHEN n = 1 THEN ge ELSE e END AS e FROM v)
SELECT recording_id, seq, piece, speaker, text, round(s, 6) AS start_s, round(CASE WHEN nx IS NULL THEN e ELSE greatest(s, least(e, nx)) END, 6) AS end_s FROM (SELECT *, lead(s) OVER (PARTITION BY recording_id ORDER BY seq, piece) AS nx FROM pc)""",
    "measured_words": f"""{_TIMED}, m AS (SELECT *, row_number() OVER (PARTITION BY recording_id, seq ORDER BY word_ix) AS k, count(*) OVER (PARTITION BY recording_id, seq) AS n FROM tw WHERE NOT (seq % 5 = 4 AND word_ix = 1)),
a AS (SELECT *, row_number() OVER (PARTITION BY recording_id, seq ORDER BY word_ix) AS k, count(*) OVER (PARTITION BY recording_id, seq) AS n FROM o)
SELECT a.recording_id, a.seq, CAST(a.word_ix AS INTEGER) AS word_ix, a.text, a.off AS "offset", round(m.start_s, 6) AS start_s, round(m.end_s, 6) AS end_s FROM a JOIN m ON m.recording_id = a.recording_id AND m.seq = a.seq AND m.k = a.k AND m.n = a.n""",
    "nearest_stretch": f"""{_S}, t AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY length(text) DESC, seq) AS ix FROM v_segments QUALIFY ix <= 3),
d AS (SELECT p.recording_id, p.turn_ix, t.seq, row_number() OVER (PARTITION BY p.recording_id, p.turn_ix ORDER BY abs((t.start_s + t.end_s) / 2 - (p.start_s + p.end_s) / 2), t.ix) AS k FROM v_spoken p JOIN t ON t.recording_id = p.recording_id AND t.speaker = p.speaker)
SELECT recording_id, turn_ix, seq AS "group" FROM d WHERE k = 1""",
    "nearest_reliable": f"""WITH {sql.VOICES}, n AS (SELECT vec_id, vec_id // 40 AS r, (vec_id % 40) * 2.0::DOUBLE AS s, (vec_id % 40) * 2.0::DOUBLE + CASE WHEN vec_id % 3 = 0 THEN 0.5 ELSE 1.5 END AS e, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS u FROM v_voices),
d AS (SELECT a.r, a.vec_id, b.vec_id AS o, 1 - list_inner_product(a.u, b.u) AS d, 1 - list_inner_product(a.u, b.u) + 0.02 * greatest(0, b.s - a.e, a.s - b.e) AS score FROM n a JOIN n b ON a.r = b.r AND a.vec_id % 3 = 0 AND b.vec_id % 3 <> 0)
SELECT r AS recording_id, vec_id AS voice_ix, arg_min(o, (score, o)) AS nearest, round(min(score), 5) AS score, min(d) > 0.6 * 1.25 AS stranger FROM d GROUP BY r, vec_id""",
    "loudness_words": f"""WITH {sql.VOICES}, s AS (SELECT vec_id, embedding AS e, unnest([{{'seq': 0, 'w': ['Well,', 'let', 'us', 'begin', 'the', 'meeting', 'now'], 's': 0.5::DOUBLE, 'e': 2.75::DOUBLE}}, {{'seq': 1, 'w': ['a', 'second', 'one'], 's': 2.75::DOUBLE, 'e': len(embedding)::DOUBLE / 16}}]) AS x FROM v_voices),
c AS (SELECT vec_id, x.seq AS seq, x.w AS w, x.s AS s, x.e AS e, list_transform(e[CAST(floor(x.s * 16) AS INTEGER) + 1:CAST(floor(x.e * 16) AS INTEGER)], lambda y: greatest(abs(y), 0.002)) AS r FROM s),
u AS (SELECT *, list_transform(range(0, len(r) + 1), lambda i: coalesce(list_sum(r[1:i]), 0)) AS curve, list_transform(range(0, len(w) + 1), lambda i: coalesce(list_sum(list_transform(w[1:i], lambda y: length(y))), 0)) AS cum FROM c),
p AS (SELECT *, list_transform(cum, lambda q: s + (e - s) * (list_position(list_transform(curve, lambda z: z >= q / cum[len(cum)] * curve[len(curve)]), true) - 1) / len(r)) AS tm FROM u)
SELECT vec_id AS recording_id, CAST(seq AS BIGINT) AS seq, CAST(k AS INTEGER) AS word_ix, w[k + 1] AS text, round(tm[k + 1], 6) AS start_s, round(greatest(tm[k + 1], tm[k + 2]), 6) AS end_s FROM (SELECT *, unnest(range(len(w))) AS k FROM p)""",
}
