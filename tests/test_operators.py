import random

import numpy as np
import pytest

from talkgrid.operators import corrections, evaluation, folds, frames, intervals, paragraphs, sequence

SEGMENT = "recording_id bigint, seq bigint, text string, start_s double, end_s double, avg_logprob double, no_speech double, speaker string"
TURN = "recording_id bigint, turn_ix int, speaker string, start_s double, end_s double"


def segments(spark, *rows):
    return spark.createDataFrame([(1, i, t, float(s), float(e), 0.0, 0.0, w) for i, (t, s, e, w) in enumerate(rows)], SEGMENT)


def turns(spark, *rows):
    return spark.createDataFrame([(1, i, w, float(s), float(e)) for i, (w, s, e) in enumerate(rows)], TURN)


def test_union_merges_touching_intervals(spark):
    found = intervals.union(turns(spark, ("a", 0, 2), ("b", 2, 3), ("a", 5, 6), ("c", 5.5, 5.7))).orderBy("start_s").collect()
    assert [(r.start_s, r.end_s, r.n) for r in found] == [(0, 3, 2), (5, 6, 2)]


def test_interval_join_has_every_pair_once_whatever_the_bucket(spark):
    rng = random.Random(3)
    rows = [("ab"[rng.random() < 0.5], s := rng.uniform(0, 50), s + rng.choice([0, 0.5, 30])) for _ in range(60)]
    t = turns(spark, *rows)
    want = sorted((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[1] < b[2] and a[2] > b[1])
    for bucket in (0.7, 5.0, 1000.0):
        assert sorted((r.turn_ix, r.r_turn_ix) for r in intervals.interval_join(t, t, bucket=bucket).collect()) == want


def test_best_overlap_ties_and_uncovered_items(spark):
    items = turns(spark, ("x", 0, 2), ("x", 90, 91))
    others = turns(spark, ("a", 1, 2), ("b", 0, 1), ("c", 50, 60))
    found = {r.turn_ix: (r.best_speaker, r.shared) for r in intervals.best_overlap(items, others, "turn_ix").collect()}
    assert found == {0: ("a", 1.0), 1: ("a", None)}


def test_closed_forms_match_the_loops(spark):
    rng = random.Random(7)
    rows = [("w", s := rng.uniform(0, 20), s + rng.uniform(0, 4), "a") for _ in range(40)]
    s = segments(spark, *rows)
    start, end = [r[1] for r in rows], [r[2] for r in rows]
    for i in range(1, len(rows)):
        if start[i] < end[i - 1]:
            n = end[i] - start[i]
            start[i], end[i] = end[i - 1], max(end[i], end[i - 1] + n)
    found = sequence.push_forward(s).orderBy("seq").collect()
    assert [r.start_s for r in found] == pytest.approx(start) and [r.end_s for r in found] == pytest.approx(end)
    start, end = [r[1] for r in rows], [r[2] for r in rows]
    for i in range(len(rows) - 2, -1, -1):
        if start[i] > start[i + 1]:
            start[i], end[i] = start[i + 1], start[i + 1] + end[i] - start[i]
    from pyspark.sql import functions as F

    found = sequence.decoder_order(s, F.lit(0.0), F.lit(1000.0)).orderBy("seq").collect()
    assert [r.start_s for r in found] == pytest.approx(start) and [r.end_s for r in found] == pytest.approx(end)


def test_carry_speaker_follows_the_sentence(spark):
    s = segments(spark, ("So we thought", 0, 1, "A"), ("that it would", 1, 2, "B"), ("be fine.", 2, 3, "C"), ("And was it?", 3, 4, "B"))
    assert [r.speaker for r in sequence.carry_speaker(s).orderBy("seq").collect()] == ["A", "A", "A", "B"]


def test_renumbering_is_all_or_nothing(spark):
    s = segments(spark, ("a", 0, 1, "Speaker 4"), ("b", 1, 2, None), ("c", 2, 3, "Speaker 2"), ("d", 3, 4, "Speaker 4"))
    assert [r.speaker for r in sequence.renumber_by_appearance(s).orderBy("seq").collect()] == ["Speaker 1", None, "Speaker 2", "Speaker 1"]
    s = segments(spark, ("a", 0, 1, "Speaker 4"), ("b", 1, 2, "Ann"))
    assert [r.speaker for r in sequence.renumber_by_appearance(s).orderBy("seq").collect()] == ["Speaker 4", "Ann"]


def test_paragraph_length_starts_anew(spark):
    s = segments(spark, *[("Ten chars.", i, i + 1, "A") for i in range(7)])
    found = paragraphs.paragraph_numbers(s, longest=20).orderBy("seq").collect()
    assert [r.para_ix for r in found] == [0, 0, 1, 1, 2, 2, 3]


def test_paragraphs_break_at_speaker_and_pause_only_between_sentences(spark):
    s = segments(spark, ("One", 0, 1, "A"), ("two.", 5, 6, "A"), ("Three.", 9, 10, "A"), ("Four.", 10, 11, "B"), (" ", 11, 12, "C"))
    assert [(r.para_ix, r.text, r.speaker) for r in paragraphs.paragraphs(s).orderBy("para_ix").collect()] == [(0, "One two.", "A"), (1, "Three.", "A"), (2, "Four.", "B")]


def test_search_finds_across_a_join(spark):
    s = segments(spark, ("we ship", 0, 1, "A"), ("on friday", 1, 2, "A"))
    found = paragraphs.matching(paragraphs.paragraph_numbers(s), "SHIP on").collect()
    assert [(r.seq, r.start_s, r.end_s) for r in found] == [(None, 0, 2)]


def chunks(spark, *windows):
    rows = [(1, w, i, t, float(s), float(e), 0.0, 0.0, None) for w, part in enumerate(windows) for i, (t, s, e) in enumerate(part)]
    return spark.createDataFrame(rows, "recording_id bigint, window_ix int, seq bigint, text string, start_s double, end_s double, avg_logprob double, no_speech double, speaker string")


def test_stitch(spark):
    found = folds.stitch(chunks(spark, [("the meeting starts at ten", 0, 3)], [("the meeting starts at ten", 0, 3), ("and runs for an hour", 3, 6)])).orderBy("seq").collect()
    assert [r.text for r in found] == ["the meeting starts at ten", "and runs for an hour"]
    found = folds.stitch(chunks(spark, [("Right, so — we ship on Friday.", 0, 3)], [("right so we ship on friday", 0.5, 3)])).collect()
    assert [r.text for r in found] == ["Right, so — we ship on Friday."]
    found = folds.stitch(chunks(spark, [("We ship on Friday.", 0, 3)], [("on friday. After that we rest", 2, 5)])).orderBy("seq").collect()
    assert [(r.text, r.start_s, r.end_s) for r in found] == [("We ship on Friday.", 0, 3), ("After that we rest", 3, 5)]


def test_stitching_drops_no_word_of_clean_windows(spark):
    words = [f"w{i}" for i in range(90)]
    windows = [[(" ".join(words[a : a + 30]), a, a + 30)] for a in range(0, 61, 28)] + [[(" ".join(words[84:]), 84, 90)]]
    found = folds.stitch(chunks(spark, *windows)).orderBy("seq").collect()
    assert " ".join(r.text for r in found).split() == words


def test_trim_across_segments(spark):
    s = segments(spark, ("a b c d e", 0, 1, "A"), ("a b c d e", 1, 2, "A"), ("f", 2, 3, "A"))
    assert [(r.seq, r.text) for r in folds.trim_across(s).orderBy("seq").collect()] == [(0, "a b c d e"), (2, "f")]


def words(spark, text, labels):
    rows = [(1, 0, i, w, float(i), i + 0.9, x) for i, (w, x) in enumerate(zip(text.split(), labels))]
    return spark.createDataFrame(rows, "recording_id bigint, seq bigint, word_ix int, text string, start_s double, end_s double, label string")


@pytest.mark.parametrize(
    ("text", "labels", "wanted"),
    [("one two three four five six", "AAABBB", "AAABBB"), ("one two three four five", "AABAA", "AAAAA"), ("x y z", "BAA", "AAA"), ("so we went home. now.", "AAAAB", "AAAAB"), ("so we all went home.", "AAABB", "AAAAA"), ("one", "A", "A")],
)
def test_steady_words(spark, text, labels, wanted):
    assert "".join(r.label for r in folds.steady_words(words(spark, text, labels)).orderBy("word_ix").collect()) == wanted


def test_pieces_by_voice(spark):
    found = folds.pieces_by_voice(words(spark, "one two three four five six", "AAABBB")).orderBy("part").collect()
    assert [(r.text, r.start_s, r.end_s) for r in found] == [("one two three", 0, 2.9), ("four five six", 3, 5.9)]


def naive_linkage(x, threshold, most=None, exact=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, parts = 1 - u @ u.T, [[i] for i in range(len(x))]
    while len(parts) > 1 and not (exact is not None and len(parts) <= exact):
        mean, a, b = min((np.mean(d[np.ix_(parts[a], parts[b])]), a, b) for a in range(len(parts)) for b in range(a + 1, len(parts)))
        if mean > threshold and not (exact is not None or (most is not None and len(parts) > most)):
            break
        parts[a] += parts.pop(b)
    out = np.zeros(len(x), int)
    for k, part in enumerate(sorted(parts, key=min)):
        out[part] = k
    return out


@pytest.mark.parametrize("options", [{}, {"most": 3}, {"exact": 4}])
def test_average_linkage_matches_the_definition(options):
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.normal(size=(rng.integers(1, 14), 3))
        assert (folds.average_linkage(x, 0.65, **options) == naive_linkage(x, 0.65, **options)).all()


def test_tracks_cross_over(spark):
    spans = [(1, 0, 0, 0.0, 5.0), (1, 0, 1, 6.0, 10.0), (1, 1, 0, 6.0, 10.0), (1, 1, 1, 1.0, 5.0)]
    schema = "recording_id bigint, window_ix int, slot int, start_s double, end_s double"
    roster = spark.createDataFrame([(1, w, s) for w in (0, 1) for s in (0, 1, 2)], "recording_id bigint, window_ix int, slot int")
    found = {(r.window_ix, r.slot): r.track for r in folds.link_tracks(spark.createDataFrame(spans, schema), roster).collect()}
    assert found == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0, (0, 2): -1, (1, 2): -1}


def test_two_sides(spark):
    conflicts = [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2), (2, 0, 2), (3, 0, 1), (3, 2, 3)]
    tracks = [(r, t, 10.0 * t, 10.0 * t + 9, 9.0 + t) for r, n in ((1, 3), (2, 3), (3, 4), (4, 2)) for t in range(n)]
    # The islands of recording 3 follow each other at the tracks 1 and 2, which should differ.
    tracks[6 + 2] = (3, 2, 20.0, 29.0, 11.0)
    found = folds.two_sides(spark.createDataFrame(tracks, "recording_id bigint, track int, start_s double, end_s double, seconds double"), spark.createDataFrame(conflicts, "recording_id bigint, a int, b int")).collect()
    assert sorted((r.recording_id, r.track, r.side) for r in found) == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (2, 0, 0), (2, 1, 1), (2, 2, 1), (3, 0, 0), (3, 1, 1), (3, 2, 0), (3, 3, 1)]


def plain_sides(tracks, conflicts):
    """Sides of one recording: walk outwards from each earliest track, then let every island vote."""
    tracks = sorted(tracks, key=lambda t: (t[1], t[0]))
    near = {t: {b if a == t else a for a, b in conflicts if t in (a, b)} for t, *_ in tracks}
    away, home = {}, {}
    for t, *_ in tracks:
        edge, step = {t} - home.keys(), 0
        while edge:
            home |= dict.fromkeys(edge, t)
            away |= dict.fromkeys(edge, step)
            edge, step = {y for x in edge for y in near[x]} - home.keys(), step + 1
    side = {t: away[t] % 2 for t in away}
    longest = max(tracks, key=lambda t: t[3])[0]
    turned = dict(side)
    for island in set(home.values()) - {home[longest]}:
        votes = sum(min(a[3], b[3]) * (1 if side[a[0]] == side[b[0]] else -1) for a, b in zip(tracks, tracks[1:]) if home[b[0]] == island != home[a[0]])
        turned |= {t: 1 - side[t] for t in side if home[t] == island and votes > 0}
    return turned if conflicts else {}


def test_two_sides_of_random_conflicts(spark):
    rng = np.random.default_rng(1)
    tracks, conflicts, want = [], [], {}
    for r in range(40):
        n = int(rng.integers(1, 14))
        own = [(t, float(rng.integers(0, 30)), 0.0, float(rng.integers(1, 9))) for t in range(n)]
        pairs = sorted({tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(int(rng.integers(0, n)))}) if n > 1 else []
        tracks += [(r, t, s, s + 1, d) for t, s, _, d in own]
        conflicts += [(r, *p) for p in pairs]
        want |= {(r, t): side for t, side in plain_sides(own, pairs).items()}
    found = folds.two_sides(spark.createDataFrame(tracks, "recording_id bigint, track int, start_s double, end_s double, seconds double"), spark.createDataFrame(conflicts, "recording_id bigint, a int, b int")).collect()
    assert {(x.recording_id, x.track): x.side for x in found} == want


def grid(*favoured):
    out = np.full((len(favoured), 4), -12.0)
    out[np.arange(len(favoured)), favoured] = 0
    return out


def test_alignment_finds_tokens_and_refuses():
    found = folds.align_tokens(grid(*[1] * 20, *[2] * 20, *[3] * 20), [1, 2, 3])
    assert [f[:2] for f in found] == [(0, 19), (20, 39), (40, 59)]
    found = folds.align_tokens(grid(1, 2, 0, 0, 1, 2), [1, 2, 1, 2])
    assert [f[:2] for f in found] == [(0, 0), (1, 1), (4, 4), (5, 5)]
    assert folds.align_tokens(grid(1, 1), [1, 1]) is None
    assert folds.align_tokens(grid(1), []) is None


def test_heard_words_give_times(spark):
    s = segments(spark, ("Well, let's begin.", 10, 12, None), ("Nothing like that here.", 20, 22, None))
    heard = spark.createDataFrame([(1, 0, "well", 10.2), (1, 1, "let's", 10.6), (1, 2, "begin", 11.1)], "recording_id bigint, word_ix int, text string, at_s double")
    found = folds.place_heard(s, heard).orderBy("seq", "word_ix").collect()
    assert [(r.seq, r.text, round(r.start_s, 3)) for r in found] == [(0, "Well,", 10.2), (0, "let's", 10.6), (0, "begin.", 11.1)]


def test_corrections_cross_segments_and_keep_marks(spark):
    s = segments(spark, ("I use meta", 0, 1, None), ("base, daily. Metabase's fine.", 1, 2, None))
    rules = spark.createDataFrame([(0, ["meta", "base"], ["Metabase"]), (1, ["Metabase"], ["Superset"])], "ord int, wrong array<string>, right array<string>")
    assert [r.text for r in corrections.corrected(s, rules).orderBy("seq").collect()] == ["I use Superset,", "daily. Superset's fine."]


def test_confusion_from_borders_is_that_of_frames(spark):
    rng = np.random.default_rng(3)
    sides = [spark.createDataFrame([(int(rng.integers(4)), "xyz"[int(rng.integers(3))], s := float(rng.integers(0, 60)) / 4, s + float(rng.integers(0, 12)) / 4) for _ in range(60)], "recording_id bigint, speaker string, start_s double, end_s double") for _ in range(2)]
    want = frames.confusion(*[frames.rounded_paint(s, 0.5) for s in sides]).collect()
    assert sorted(map(tuple, frames.swept_confusion(*sides, 0.5).collect())) == sorted(map(tuple, want)) and len(want) > 12


def test_frames(spark):
    t = turns(spark, ("a", 0, 1.05), ("b", 0.95, 2), ("a", 2.2, 2.4))
    assert sorted(r.frame for r in frames.votes(t, 0.5).where("speaker = 'a'").collect()) == [0, 1, 2, 4]
    runs = frames.runs(frames.painted(t, 0.5), ["recording_id", "speaker"]).orderBy("speaker", "first_frame").collect()
    assert [(r.speaker, r.first_frame, r.last_frame) for r in runs] == [("a", 0, 2), ("a", 4, 4), ("b", 1, 3)]
    assert {r.frame for r in frames.contested(frames.votes(t, 0.5)).collect()} == {1, 2}


def test_windows_end_with_the_recording(spark):
    r = spark.createDataFrame([(1, 30.0), (2, 30.5), (3, 58.2), (4, 0.0)], "recording_id bigint, duration_s double")
    found = evaluation.windows(r).orderBy("recording_id", "window_ix").collect()
    assert [(r.recording_id, r.window_ix, r.start_s, round(r.content_s, 3)) for r in found] == [(1, 0, 0, 30), (2, 0, 0, 30), (2, 1, 28, 2.5), (3, 0, 0, 30), (3, 1, 28, 30), (3, 2, 56, 2.2)]


def test_empty_tables_give_no_rows(spark):
    s, t = spark.createDataFrame([], SEGMENT), spark.createDataFrame([], TURN)
    for found in (paragraphs.paragraphs(s), paragraphs.cues(s), sequence.push_forward(s), folds.trim_across(s), intervals.union(t), intervals.timeline(t), intervals.crosstalk(t), frames.votes(t, 1.0), intervals.best_overlap(t, t, "turn_ix")):
        assert found.count() == 0


def test_a_turn_that_ends_before_it_begins_is_nobodys_best(spark):
    items = spark.createDataFrame([(1, 0, 10.0, 12.0), (1, 1, 20.0, 22.0)], "recording_id bigint, seq int, start_s double, end_s double")
    turns = spark.createDataFrame([(1, 0, "a", 0.0, 5.0), (1, 1, "b", 11.0, 10.5), (1, 2, "c", 21.0, 23.0)], "recording_id bigint, turn_ix int, speaker string, start_s double, end_s double")
    found = intervals.best_overlap(items, turns, "seq").orderBy("seq").collect()
    assert [(r.best_speaker, r.shared) for r in found] == [("a", None), ("c", 1.0)]


def test_agreement_does_not_broadcast_frames(spark):
    """Painted frames are far more than the rows they come from, which is all that Spark's estimate knows."""
    turns = spark.createDataFrame([(1, "a", 0.0, 2.0), (1, "b", 3.0, 4.0)], "recording_id bigint, speaker string, start_s double, end_s double")
    every = spark.range(50).selectExpr("1L AS recording_id", "id AS frame", "1.0D AS power")
    side = frames.rounded_paint(turns, 0.1)
    found = evaluation.agreement(side, side.where("frame < 35"), every)
    assert "BroadcastHashJoin" not in found.select("quiet", "comparable")._jdf.queryExecution().executedPlan().toString().split("agreed")[0]
    r = found.first()
    assert (r.quiet, r.only_left, r.only_right, r.comparable, r.agreed) == (20, 5, 0, 25, 25)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # that of the agreed frames by recording
