"""Queries over segments and texts: predicates, words, paragraphs and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkgrid.functions import text as t
from talkgrid.functions.ordered import likeness, loop_ratio
from talkgrid.operators import paragraphs as p
from talkgrid.operators import sequence
from talkgrid.plans import sql
from talkgrid.sources.tables import segments, texts

#: A word of the test texts, and a phrase that crosses segments.
QUERY = "the"


def _pairs(spark, sf_dir):
    """Each segment's text with that of the one before it."""
    before = F.lag("text").over(Window.partitionBy("recording_id").orderBy("seq"))
    return segments(spark, sf_dir).withColumn("previous", before).where("previous IS NOT NULL")


def paragraphs(spark, sf_dir):
    found = p.paragraphs(segments(spark, sf_dir), longest=300)
    return found.select("recording_id", "para_ix", "speaker", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), "text", "overlapped")


def plain_transcript(spark, sf_dir):
    return p.plain_text(p.paragraphs(segments(spark, sf_dir), longest=300))


def markdown_lines(spark, sf_dir):
    return p.markdown_lines(p.paragraphs(segments(spark, sf_dir), longest=300))


def srt_cues(spark, sf_dir):
    return p.cues(segments(spark, sf_dir))


def speaker_stretches(spark, sf_dir):
    return p.by_speaker(segments(spark, sf_dir))


def full_text(spark, sf_dir):
    return p.full_text(segments(spark, sf_dir))


def match_spans(spark, sf_dir):
    found = p.matching(p.paragraph_numbers(segments(spark, sf_dir), longest=300), QUERY)
    return found.select("recording_id", "para_ix", "seq", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def search_hits(spark, sf_dir):
    counted = segments(spark, sf_dir).groupBy("recording_id").agg(F.sum(t.occurrences("text", QUERY)).cast("long").alias("hits"))
    return counted.where("hits > 0")


def flags(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.select(
        "recording_id", "seq", t.hallucinated("text", "avg_logprob", "no_speech").alias("hallucinated"), t.unformatted("text").alias("unformatted"), ((F.col("avg_logprob") < -1) | (F.col("no_speech") > 0.6)).alias("unsure"),
        t.has_speech("text").alias("speech"), t.ends_paragraph("text").alias("ends_paragraph"), t.ends_sentence("text").alias("ends_sentence"), t.unfinished("text").alias("unfinished"),
        t.continues_sentence("text").alias("continues_sentence"), t.continues_word("text").alias("continues_word"), F.coalesce(F.col("speaker").rlike("^Speaker -?[0-9]+$"), F.lit(False)).alias("automatic"),
    )


def readings(spark, sf_dir):
    """Each text against its predecessor: which reads better, and whether they say the same."""
    s = _pairs(spark, sf_dir)
    return s.select("recording_id", "seq", t.better_reading("previous", "text").alias("better"), t.says_the_same("previous", "text", 0.3).alias("same"))


def normalise_text(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.md5(t.normalised("text").cast("binary")).alias("normalised"), F.md5(t.letters("text").cast("binary")).alias("letters"))


def tokens_per_doc(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.size(t.words("text")).cast("long").alias("words"), F.size(F.array_distinct(t.bare_words("text"))).cast("long").alias("distinct_words"))


def sentence_split(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.posexplode(t.sentences("text")).alias("sentence_ix", "s")).select("doc_id", "sentence_ix", F.md5(F.col("s").cast("binary")).alias("sentence"))


def dialogue_marks(spark, sf_dir):
    """Segments with every full stop read as a dash between speakers, cut at the dashes."""
    s = segments(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit(" - ")))
    found = p.split_shares(s, t.dialogue_parts("text"))
    return found.select("recording_id", "seq", "part", "text", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def char_share_split(spark, sf_dir):
    found = p.split_shares(segments(spark, sf_dir), t.sentences("text"))
    return found.select("recording_id", "seq", "part", "text", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def trimmed_overlap(spark, sf_dir):
    """Segments that begin with the last three words of the one before, trimmed of them again."""
    s = _pairs(spark, sf_dir)
    last = F.array_join(F.slice(t.words("previous"), -F.least(F.lit(3), F.size(t.words("previous"))), 3), " ")
    s = s.where(F.size(t.words("previous")) > 0).withColumn("doubled", F.concat_ws(" ", last, "text"))
    return s.select("recording_id", "seq", t.without_overlap("previous", "doubled").alias("trimmed"))


def clock_format(spark, sf_dir):
    return segments(spark, sf_dir).select("recording_id", "seq", t.clock(F.col("start_s") * 40).alias("clock"), t.rounded_clock("end_s").alias("rounded"), t.cue_time("end_s").alias("cue"))


def decoder_order(spark, sf_dir):
    found = sequence.decoder_order(segments(spark, sf_dir), F.lit(0.0), F.lit(30.0))
    return found.select("recording_id", "seq", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


def carry_speaker(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 2 == 0, F.regexp_replace("text", r"[.?!]+$", "")).otherwise(F.lower("text")))
    return sequence.carry_speaker(s).select("recording_id", "seq", "speaker")


def first_appearance_labels(spark, sf_dir):
    s = segments(spark, sf_dir)
    number = F.when(F.col("speaker") == "user", 7).when(F.col("speaker") == "assistant", 3).otherwise(5)
    named = F.when((F.col("recording_id") % 5 == 0) & (F.col("seq") == 0), F.lit("Ann")).otherwise(F.concat(F.lit("Speaker "), number))
    return sequence.renumber_by_appearance(s.withColumn("speaker", named)).select("recording_id", "seq", "speaker")


def word_error_distance(spark, sf_dir):
    s = _pairs(spark, sf_dir)
    distance = t.word_distance(t.bare_words("previous"), t.bare_words("text"))
    return s.select("recording_id", "seq", distance.cast("long").alias("distance"), F.size(t.bare_words("previous")).cast("long").alias("words"))


def neighbour_containment(spark, sf_dir):
    """Segments whose folded text a neighbour at most two away contains. After every segment its first sentence is said again."""
    said = segments(spark, sf_dir).select("recording_id", (F.col("seq") * 2).alias("seq"), "text")
    again = segments(spark, sf_dir).select("recording_id", (F.col("seq") * 2 + 1).alias("seq"), F.coalesce(F.get(t.sentences("text"), F.lit(0)), F.lit("")).alias("text"))
    s = said.unionByName(again).select("recording_id", "seq", t.normalised("text").alias("folded")).where("folded <> ''")
    near = s.select("recording_id", F.col("folded").alias("other"), F.explode(F.array(*[F.col("seq") + d for d in (-2, -1, 1, 2)])).alias("seq"))
    return s.join(near, ["recording_id", "seq"]).where(F.col("other").contains(F.col("folded"))).select("recording_id", "seq").distinct()


def same_thing(spark, sf_dir):
    """Whether a text with a part of its words left out still says the same."""
    s = segments(spark, sf_dir).withColumn("n", F.size(t.words("text")))
    part = F.array_join(F.filter(t.words("text"), lambda w, i: (i * 7 + F.col("seq")) % 5 < 3 + F.col("seq") % 2), " ")
    return s.select("recording_id", "seq", t.says_the_same(F.col("text"), part).alias("same"))


def guesswork(spark, sf_dir):
    """Segments that are unsure of themselves, or that compress too well to be speech. Every fourth says one phrase over and over."""
    s = segments(spark, sf_dir)
    s = s.withColumn("text", F.when(F.col("seq") % 4 == 3, F.repeat(F.lit("and so on and "), 30)).otherwise(F.col("text")))
    loops = F.coalesce(loop_ratio("text") > 2.4, F.lit(False))
    return s.select("recording_id", "seq", loops.alias("loops"), (loops | (F.col("avg_logprob") < -1) | (F.col("no_speech") > 0.6)).alias("guesswork"))


def markdown_transcript(spark, sf_dir):
    return p.markdown(p.paragraphs(segments(spark, sf_dir), longest=300))


def subtitle_file(spark, sf_dir):
    return p.subtitles(segments(spark, sf_dir))


def word_likeness(spark, sf_dir):
    """The share of each word's letters that the next word has in the same order."""
    w = segments(spark, sf_dir).select("recording_id", "seq", F.posexplode(t.bare_words("text")).alias("i", "a"))
    w = w.withColumn("b", F.lead("a").over(Window.partitionBy("recording_id", "seq").orderBy("i"))).where("b IS NOT NULL").select("a", "b").distinct()
    return w.select("a", "b", F.round(likeness("a", "b"), 6).alias("share"))


def placed_words(spark, sf_dir):
    """Words of which every third has a time; the others lie between."""
    w = segments(spark, sf_dir).select("recording_id", "seq", "start_s", F.posexplode(t.words("text")).alias("word_ix", "text"))
    order = F.row_number().over(Window.partitionBy("recording_id").orderBy("seq", "word_ix"))
    at = F.when((F.col("word_ix") + F.col("seq")) % 3 == 0, F.col("start_s") + F.col("word_ix") * 0.4 - (F.col("word_ix") % 4) * 0.5)
    found = sequence.interpolate(w.withColumns({"k": order, "at_s": at}), by="k")
    return found.select("recording_id", "seq", "word_ix", F.round("at_s", 6).alias("at_s"))


_S = f"WITH RECURSIVE {sql.SEGMENTS}"
_LINES = rf"""
b AS (SELECT *, lag(speaker) OVER w AS ps, lag(end_s) OVER w AS pe, regexp_matches(lag(text) OVER w, '[.?!][\p{{Z}}\s]*$') AS ended, row_number() OVER w AS k, length({sql.stripped('text')}) + 1 AS n
      FROM v_segments WHERE {sql.stripped('text')} <> '' WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
r AS (SELECT recording_id, k, seq, 0 AS para_ix, n AS len FROM b WHERE k = 1
      UNION ALL
      SELECT b.recording_id, b.k, b.seq, CASE WHEN new THEN r.para_ix + 1 ELSE r.para_ix END, CASE WHEN new THEN b.n ELSE r.len + b.n END
      FROM r JOIN b ON b.recording_id = r.recording_id AND b.k = r.k + 1,
      LATERAL (SELECT b.ps IS DISTINCT FROM b.speaker OR (b.start_s - b.pe >= 1.2 AND b.ended) OR (r.len >= 300 AND b.ended) AS new)),
g AS (SELECT b.*, r.para_ix FROM b JOIN r ON b.recording_id = r.recording_id AND b.k = r.k),
para AS (SELECT recording_id, para_ix, arg_min(speaker, seq) AS speaker, arg_min(start_s, seq) AS start_s, arg_max(end_s, seq) AS end_s, string_agg({sql.stripped('text')}, ' ' ORDER BY seq) AS text FROM g GROUP BY recording_id, para_ix)"""
_CLOSE = r"""[\p{Z}\s"'')\]”’]*$"""
_PAIRS = "pairs AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY recording_id ORDER BY seq) AS previous FROM v_segments) WHERE previous IS NOT NULL)"


def _shares(parts: str, source: str) -> str:
    return f"""x AS (SELECT *, list_sum(list_transform(parts, lambda y: length(y))) AS total FROM (SELECT *, {parts} AS parts FROM {source}) WHERE len(parts) > 0),
e AS (SELECT *, unnest(range(len(parts))) AS k FROM x),
f AS (SELECT *, coalesce(list_sum(list_transform(parts[1:k], lambda y: length(y))), 0) AS before FROM e)
SELECT recording_id, seq, CAST(k AS INTEGER) AS part, parts[k + 1] AS text, round(start_s + coalesce((end_s - start_s) * before / nullif(total, 0), 0), 6) AS start_s,
       round(CASE WHEN k = len(parts) - 1 THEN end_s ELSE start_s + (end_s - start_s) * (before + length(parts[k + 1])) / nullif(total, 0) END, 6) AS end_s FROM f"""


# RE2 has no lookbehind: a mark is put after the sentence's end, and the text is cut there.
_SENTENCES = rf"list_filter(string_split(regexp_replace({sql.stripped('text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sql.stripped('s')} <> '')"
_DIALOGUE = f"(CASE WHEN len(list_filter(list_transform(string_split_regex(text, '(^| )- [- ]*'), lambda y: {sql.stripped('y')}), lambda y: y <> '')) > 0 THEN list_filter(list_transform(string_split_regex(text, '(^| )- [- ]*'), lambda y: {sql.stripped('y')}), lambda y: y <> '') ELSE [{sql.stripped('text')}] END)"

QUERIES = {
    f.__name__: f
    for f in (
        paragraphs, plain_transcript, markdown_lines, srt_cues, speaker_stretches, full_text, match_spans, search_hits, flags, readings, normalise_text, tokens_per_doc, sentence_split, dialogue_marks,
        char_share_split, trimmed_overlap, clock_format, decoder_order, carry_speaker, first_appearance_labels, word_error_distance, neighbour_containment, same_thing, guesswork, markdown_transcript, subtitle_file, word_likeness, placed_words,
    )
}

ORACLE_SQL = {
    "paragraphs": f"{_S}, {_LINES} SELECT recording_id, para_ix, speaker, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, text, false AS overlapped FROM para",
    "plain_transcript": f"{_S}, {_LINES} SELECT recording_id, string_agg(CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || text, chr(10) || chr(10) ORDER BY para_ix) AS text FROM para GROUP BY recording_id",
    "markdown_lines": f"{_S}, {_LINES} SELECT recording_id, para_ix, '**[' || {sql.clock('start_s')} || ']** ' || CASE WHEN coalesce(speaker, '') <> '' THEN '**' || speaker || '** ' ELSE '' END || text AS line FROM para",
    "srt_cues": f"WITH {sql.SEGMENTS}, c AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS INTEGER) AS cue FROM v_segments WHERE {sql.stripped('text')} <> '') SELECT recording_id, cue, cue || chr(10) || {sql.cue_time('start_s')} || ' --> ' || {sql.cue_time('end_s')} || chr(10) || CASE WHEN coalesce(speaker, '') <> '' THEN speaker || ': ' ELSE '' END || {sql.stripped('text')} AS line FROM c",
    "speaker_stretches": f"WITH {sql.SEGMENTS}, c AS (SELECT *, lag(speaker) OVER (PARTITION BY recording_id ORDER BY seq) IS NOT DISTINCT FROM speaker AS same, row_number() OVER (PARTITION BY recording_id ORDER BY seq) AS k FROM v_segments WHERE {sql.stripped('text')} <> ''), i AS (SELECT *, sum(CASE WHEN same AND k > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT recording_id, min(seq) AS seq, arg_min(speaker, seq) AS speaker, string_agg({sql.stripped('text')}, ' ' ORDER BY seq) AS text FROM i GROUP BY recording_id, island",
    "full_text": f"WITH {sql.SEGMENTS} SELECT recording_id, coalesce(string_agg({sql.stripped('text')}, ' ' ORDER BY seq) FILTER ({sql.stripped('text')} <> ''), '') AS text FROM v_segments GROUP BY recording_id",
    "match_spans": f"""{_S}, {_LINES}, h AS (SELECT *, contains(lower(text), '{QUERY}') AS hit FROM g),
a AS (SELECT recording_id, para_ix, string_agg({sql.stripped('text')}, ' ' ORDER BY seq) AS whole, bool_or(hit) AS inside, min(start_s) AS start_s, max(end_s) AS end_s FROM h GROUP BY recording_id, para_ix)
SELECT recording_id, para_ix, seq, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM h WHERE hit
UNION ALL SELECT recording_id, para_ix, NULL, round(start_s, 6), round(end_s, 6) FROM a WHERE NOT inside AND contains(lower(whole), '{QUERY}')""",
    "search_hits": f"SELECT * FROM (SELECT conv_id AS recording_id, CAST(sum((length(text) - length(replace(lower(text), '{QUERY}', ''))) // {len(QUERY)}) AS BIGINT) AS hits FROM conversations GROUP BY conv_id) WHERE hits > 0",
    "flags": rf"""WITH {sql.SEGMENTS} SELECT recording_id, seq, no_speech > 0.6 AND avg_logprob < -1 AND {sql.stripped('text')} <> '' AS hallucinated, {sql.unformatted('text')} AS unformatted, avg_logprob < -1 OR no_speech > 0.6 AS unsure,
regexp_matches(text, '[\p{{L}}\p{{Nd}}]') AS speech, regexp_matches(text, '[.?!][\p{{Z}}\s]*$') AS ends_paragraph, regexp_matches(text, '[.!?…:;]{_CLOSE}') OR regexp_matches(text, '^{_CLOSE}') AS ends_sentence,
NOT regexp_matches(text, '[.!?…:;][^\p{{L}}\p{{Nd}}.!?…:;]*$') AS unfinished, regexp_matches(regexp_extract(text, '[\p{{L}}\p{{Nd}}]', 0), '\p{{Ll}}') AS continues_sentence, regexp_matches(regexp_extract(text, '\p{{L}}', 0), '\p{{Ll}}') AS continues_word,
coalesce(regexp_matches(speaker, '^Speaker -?[0-9]+$'), false) AS automatic FROM v_segments""",
    "readings": f"""WITH {sql.SEGMENTS}, {_PAIRS} SELECT recording_id, seq, {sql.unformatted('previous')} AND NOT {sql.unformatted('text')} AND len({sql.words('text')}) >= len({sql.words('previous')}) * 0.9 AS better,
len({sql.bare_words('previous')}) = 0 OR len(list_filter({sql.bare_words('previous')}, lambda v: list_contains({sql.bare_words('text')}, v))) >= len({sql.bare_words('previous')}) * 0.3 AS same FROM pairs""",
    "normalise_text": rf"SELECT doc_id, md5({sql.normalised('text')}) AS normalised, md5(lower(regexp_replace(text, '\P{{L}}', '', 'g'))) AS letters FROM documents",
    "tokens_per_doc": f"SELECT doc_id, len({sql.words('text')}) AS words, len(list_distinct({sql.bare_words('text')})) AS distinct_words FROM documents",
    "sentence_split": f"SELECT doc_id, CAST(k AS INTEGER) AS sentence_ix, md5(s[k + 1]) AS sentence FROM (SELECT doc_id, s, unnest(range(len(s))) AS k FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))",
    "dialogue_marks": f"WITH {sql.SEGMENTS}, m AS (SELECT * REPLACE (replace(text, '. ', ' - ') AS text) FROM v_segments), {_shares(_DIALOGUE, 'm')}",
    "char_share_split": f"WITH {sql.SEGMENTS}, {_shares(_SENTENCES, 'v_segments')}",
    "trimmed_overlap": f"""WITH {sql.SEGMENTS}, {_PAIRS},
d AS (SELECT recording_id, seq, previous, concat_ws(' ', array_to_string({sql.words('previous')}[-3:], ' '), text) AS doubled FROM pairs WHERE len({sql.words('previous')}) > 0),
a AS (SELECT *, list_transform({sql.words('previous')}, lambda v: {sql.bare('v')}) AS x, {sql.words('doubled')} AS w, list_transform({sql.words('doubled')}, lambda v: {sql.bare('v')}) AS y FROM d),
n AS (SELECT *, list_max(list_filter(range(1, least(40, len(x), len(y)) + 1), lambda k: x[len(x) - k + 1:] = y[1:k])) AS n FROM a),
z AS (SELECT *, list_min(list_filter(range(n + 1, len(y) + 1), lambda k: y[k] <> '')) AS first FROM n)
SELECT recording_id, seq, CASE WHEN n IS NULL THEN doubled WHEN first IS NULL THEN '' ELSE array_to_string(w[first:], ' ') END AS trimmed FROM z""",
    "clock_format": f"WITH {sql.SEGMENTS} SELECT recording_id, seq, {sql.clock('start_s * 40')} AS clock, printf('%d:%02d', CAST(round_even(greatest(0, end_s), 0) AS BIGINT) // 60, CAST(round_even(greatest(0, end_s), 0) AS BIGINT) % 60) AS rounded, {sql.cue_time('end_s')} AS cue FROM v_segments",
    "decoder_order": f"""WITH {sql.SEGMENTS},
c AS (SELECT *, CASE WHEN end_s > 30.0 AND start_s >= 30.0 THEN greatest(0.0, least(start_s, 30.0 - greatest(0, end_s - start_s))) ELSE start_s END AS s, least(end_s, 30.0) AS e FROM v_segments),
n AS (SELECT *, min(s) OVER (PARTITION BY recording_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM c)
SELECT recording_id, seq, round(m, 6)::DOUBLE AS start_s, round(CASE WHEN m < s THEN m + greatest(0, e - s) ELSE e END, 6)::DOUBLE AS end_s FROM n""",
    "carry_speaker": rf"""WITH {sql.SEGMENTS},
t AS (SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN regexp_replace(text, '[.?!]+$', '') ELSE lower(text) END AS text) FROM v_segments),
p AS (SELECT *, lag(speaker) OVER w AS ps, lag(end_s) OVER w AS pe, lag(text) OVER w AS pt FROM t WINDOW w AS (PARTITION BY recording_id ORDER BY seq)),
l AS (SELECT *, coalesce(ps IS NOT NULL AND speaker IS NOT NULL AND start_s - pe <= 2.0 AND NOT (regexp_matches(pt, '[.!?…:;]{_CLOSE}') OR regexp_matches(pt, '^{_CLOSE}')) AND regexp_matches(regexp_extract(text, '[\p{{L}}\p{{Nd}}]', 0), '\p{{Ll}}'), false) AS linked FROM p),
i AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY recording_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT recording_id, seq, first_value(speaker) OVER (PARTITION BY recording_id, island ORDER BY seq) AS speaker FROM i""",
    "first_appearance_labels": f"""WITH {sql.SEGMENTS},
n AS (SELECT recording_id, seq, CASE WHEN recording_id % 5 = 0 AND seq = 0 THEN 'Ann' ELSE 'Speaker ' || CASE speaker WHEN 'user' THEN 7 WHEN 'assistant' THEN 3 ELSE 5 END END AS speaker FROM v_segments),
f AS (SELECT *, bool_and(regexp_matches(speaker, '^Speaker -?[0-9]+$')) OVER (PARTITION BY recording_id) AS auto, min(seq) OVER (PARTITION BY recording_id, speaker) AS first FROM n)
SELECT recording_id, seq, CASE WHEN auto THEN 'Speaker ' || dense_rank() OVER (PARTITION BY recording_id ORDER BY first) ELSE speaker END AS speaker FROM f""",
    "word_error_distance": f"""WITH RECURSIVE {sql.SEGMENTS}, {_PAIRS},
a AS (SELECT recording_id, seq, {sql.bare_words('previous')} AS x, {sql.bare_words('text')} AS y FROM pairs),
k AS (SELECT recording_id, seq, x, y, 0 AS i, range(len(y) + 1) AS d FROM a
      UNION ALL
      SELECT recording_id, seq, x, y, i + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda j: [j]), lambda acc, e: list_append(acc, least(acc[-1] + 1, d[e[1] + 1] + 1, d[e[1]] + CASE WHEN x[i + 1] = y[e[1]] THEN 0 ELSE 1 END)), [CAST(i + 1 AS BIGINT)])
      FROM k WHERE i < len(x))
SELECT recording_id, seq, d[-1] AS distance, len(x) AS words FROM k WHERE i = len(x)""",
    "neighbour_containment": f"""WITH {sql.SEGMENTS}, e AS (SELECT recording_id, seq * 2 AS seq, text FROM v_segments UNION ALL SELECT recording_id, seq * 2 + 1, coalesce({_SENTENCES}[1], '') FROM v_segments),
f AS (SELECT recording_id, seq, {sql.normalised('text')} AS folded FROM e WHERE {sql.normalised('text')} <> '') SELECT DISTINCT a.recording_id, a.seq FROM f a JOIN f b ON a.recording_id = b.recording_id AND abs(a.seq - b.seq) BETWEEN 1 AND 2 AND contains(b.folded, a.folded)""",
    "same_thing": f"""WITH {sql.SEGMENTS}, w AS (SELECT recording_id, seq, {sql.bare_words('text')} AS x, {sql.bare_words("array_to_string(list_transform(list_filter(list_zip(" + sql.words('text') + ", range(len(" + sql.words('text') + "))), lambda z: (z[2] * 7 + seq) % 5 < 3 + seq % 2), lambda z: z[1]), ' ')")} AS y FROM v_segments)
SELECT recording_id, seq, len(x) = 0 OR len(list_filter(x, lambda v: list_contains(y, v))) >= len(x) * 0.7 AS same FROM w""",
    "markdown_transcript": f"{_S}, {_LINES} SELECT recording_id, string_agg('**[' || {sql.clock('start_s')} || ']** ' || CASE WHEN coalesce(speaker, '') <> '' THEN '**' || speaker || '** ' ELSE '' END || text, chr(10) || chr(10) ORDER BY para_ix) AS text FROM para GROUP BY recording_id",
    "word_likeness": f"""{_S}, w AS (SELECT recording_id, seq, k, b[k] AS a, b[k + 1] AS b FROM (SELECT *, unnest(range(1, len(b))) AS k FROM (SELECT recording_id, seq, {sql.bare_words('text')} AS b FROM v_segments))),
d AS (SELECT DISTINCT a, b, regexp_extract_all(a, '\\p{{L}}') AS x, regexp_extract_all(b, '.') AS y FROM w),
r AS (SELECT a, b, x, y, 0::BIGINT AS i, list_transform(range(0, len(y) + 1), lambda j: 0::BIGINT) AS best FROM d UNION ALL
  SELECT a, b, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: greatest(best[j], list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND y[k - 1] = x[i + 1] THEN best[k - 1] + 1 ELSE 0 END)))) FROM r WHERE i < len(x))
SELECT a, b, round(CASE WHEN len(x) > 0 THEN best[len(y) + 1] / len(x) ELSE 0 END, 6) AS share FROM r WHERE i = len(x)""",
    "placed_words": f"""WITH {sql.SEGMENTS}, w AS (SELECT recording_id, seq, start_s, k - 1 AS word_ix FROM (SELECT *, unnest(range(1, len(x) + 1)) AS k FROM (SELECT *, {sql.words('text')} AS x FROM v_segments))),
n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY seq, word_ix) AS k, CASE WHEN (word_ix + seq) % 3 = 0 THEN start_s + word_ix * 0.4::DOUBLE - (word_ix % 4) * 0.5::DOUBLE END AS t FROM w),
b AS (SELECT *, last_value(t IGNORE NULLS) OVER u AS ta, last_value(CASE WHEN t IS NOT NULL THEN k END IGNORE NULLS) OVER u AS ka, first_value(t IGNORE NULLS) OVER v AS tb, first_value(CASE WHEN t IS NOT NULL THEN k END IGNORE NULLS) OVER v AS kb FROM n
  WINDOW u AS (PARTITION BY recording_id ORDER BY k ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY recording_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p AS (SELECT *, coalesce(t, ta + (tb - ta) * (k - ka) / nullif(kb - ka, 0), ta, tb) AS x FROM b)
SELECT recording_id, seq, CAST(word_ix AS INTEGER) AS word_ix, round(max(x) OVER (PARTITION BY recording_id ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS at_s FROM p""",
}
ORACLE_SQL["subtitle_file"] = f"SELECT recording_id, string_agg(line, chr(10) || chr(10) ORDER BY cue) AS text FROM ({ORACLE_SQL['srt_cues']}) GROUP BY recording_id"
