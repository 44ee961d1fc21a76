"""SQL of the views that the queries stand on, and of the text functions."""

from __future__ import annotations

SEGMENTS = """v_segments AS (
  SELECT conv_id AS recording_id, turn AS seq, text, start_s, start_s + length(text) / 15.0::DOUBLE AS end_s,
         CAST(-((turn * 7 + conv_id * 3) % 15) AS DOUBLE) / 10 AS avg_logprob, CAST((turn * 5 + conv_id) % 10 AS DOUBLE) / 10 AS no_speech, role AS speaker
  FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 15.0::DOUBLE
         + sum((turn % 3) * 0.7::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start_s FROM conversations))"""

TURNS = """v_turns AS (
  SELECT user_id AS recording_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS turn_ix, event_type AS speaker,
         epoch_us(ts) / 1e6 / 3600 AS start_s, epoch_us(ts) / 1e6 / 3600 + value / 6.0::DOUBLE AS end_s FROM events)"""

SPOKEN = """v_spoken AS (SELECT recording_id, CAST(seq AS INTEGER) AS turn_ix, speaker,
  start_s + ((seq * 5 + recording_id) % 7 - 3) * 0.3::DOUBLE AS start_s, end_s + ((seq * 3 + recording_id) % 5 - 2) * 0.4::DOUBLE AS end_s FROM v_segments)"""

VOICES = "v_voices AS (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"


def bare(w: str) -> str:
    return rf"lower(regexp_replace({w}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"


def normalised(t: str) -> str:
    return rf"trim(regexp_replace(lower({t}), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"


def stripped(t: str) -> str:
    return rf"regexp_replace({t}, '^[\p{{Z}}\s]+|[\p{{Z}}\s]+$', '', 'g')"


def words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '[\p{{Z}}\s]+'), lambda w: w <> '')"


def bare_words(t: str) -> str:
    return f"list_filter(list_transform({words(t)}, lambda w: {bare('w')}), lambda w: w <> '')"


def unformatted(t: str) -> str:
    return rf"({stripped(t)} <> '' AND NOT regexp_matches({t}, '[.,?!;:]') AND NOT regexp_matches({t}, '\p{{Lu}}'))"


def union(source: str, name: str, keys: str = "recording_id") -> str:
    """Common table expressions that unite the intervals of a source; the last has the given name."""
    return f"""{name}_r AS (SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_s, end_s) AS island FROM {name}_r),
{name} AS (SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM {name}_i GROUP BY {keys}, island)"""


CROSSTALK = f"""both_talk AS (SELECT a.recording_id, greatest(a.start_s, b.start_s) AS start_s, least(a.end_s, b.end_s) AS end_s
  FROM v_turns a JOIN v_turns b ON a.recording_id = b.recording_id AND a.turn_ix < b.turn_ix AND a.speaker <> b.speaker AND a.start_s < b.end_s AND a.end_s > b.start_s),
{union("both_talk", "v_cross")}"""


def shared(a: str, b: str) -> str:
    return f"greatest(0, least({a}.end_s, {b}.end_s) - greatest({a}.start_s, {b}.start_s))"


#: Segments as items, and the turns to hold them against.
ITEMS = "v_items AS (SELECT recording_id, CAST(seq AS INTEGER) AS turn_ix, speaker, start_s, end_s FROM v_segments), v_others AS (SELECT * FROM v_spoken)"


def clock(s: str) -> str:
    f = f"CAST(floor(greatest(0, {s})) AS BIGINT)"
    return f"CASE WHEN {f} >= 3600 THEN printf('%d:%02d:%02d', {f} // 3600, ({f} // 60) % 60, {f} % 60) ELSE printf('%d:%02d', {f} // 60, {f} % 60) END"


def cue_time(s: str) -> str:
    ms = f"CAST(floor(floor(greatest(0, {s}) * 1e7) / 1e4) AS BIGINT)"
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"
