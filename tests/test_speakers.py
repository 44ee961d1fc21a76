import random

import pytest

from talkgrid.operators import evaluation, speakers

TURN = "recording_id bigint, turn_ix int, speaker int, start_s double, end_s double"


def test_distinct_spans(spark):
    rows = [(1, i, float(a), float(b)) for i, (a, b) in enumerate([(0, 10), (1, 9), (8, 12), (20, 21), (20, 21)])]
    found = speakers.distinct_spans(spark.createDataFrame(rows, "recording_id bigint, span_ix int, start_s double, end_s double")).collect()
    assert sorted(r.span_ix for r in found) == [0, 2, 3]


def test_pair_speakers_takes_the_largest_first(spark):
    rows = [(1, "a", "x", 5), (1, "a", "y", 9), (1, "b", "y", 8), (1, "b", "x", 1)]
    found = speakers.pair_speakers(spark.createDataFrame(rows, "recording_id bigint, a string, b string, frames bigint")).collect()
    assert sorted((r.a, r.b) for r in found) == [("a", "y"), ("b", "x")]


def test_merge_to_count(spark):
    rows = [(1, 0, 7, 0.0, 10.0), (1, 1, 4, 10.0, 14.0), (1, 2, 9, 14.0, 15.0), (1, 3, 7, 30.0, 40.0)]
    prints = spark.createDataFrame([(1, 7, [1.0, 0.0]), (1, 4, [0.0, 1.0]), (1, 9, [0.9, 0.1])], "recording_id bigint, speaker int, embedding array<float>")
    turns = spark.createDataFrame(rows, TURN)
    assert [r.speaker for r in speakers.merge_to_count(turns, prints, 2).orderBy("turn_ix").collect()] == [0, 1, 0, 0]
    assert [r.speaker for r in speakers.merge_to_count(turns, prints.limit(0), 2).orderBy("turn_ix").collect()] == [0, 1, 1, 0]


def test_tracks_in_conflict_differ(spark):
    voices = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, [1.0, 0.0])], "recording_id bigint, track int, embedding array<float>")
    conflicts = spark.createDataFrame([(1, 0, 1)], "recording_id bigint, a int, b int")
    found = {r.track: r.person for r in speakers.group_tracks(voices, conflicts, 3).collect()}
    assert found[0] != found[1] and found[3] == found[0] and found[2] not in (found[0], found[1])
    triangle = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 0, 2), (2, 5, 6)], "recording_id bigint, a int, b int")
    assert {r.recording_id: r.people for r in speakers.people_at_least(triangle).collect()} == {1: 3, 2: 2}


def test_votes_keep_who_spoke_before_on_a_tie(spark):
    rows = [(1, 0, "b", 0.0, 3.0), (1, 1, "a", 1.0, 3.0), (1, 2, "a", 3.0, 5.0), (1, 3, "c", 7.0, 8.0)]
    found = speakers.voted_turns(spark.createDataFrame(rows, TURN.replace("speaker int", "speaker string")), 1.0).orderBy("start_s").collect()
    assert [(r.speaker, r.start_s, r.end_s, r.number) for r in found] == [("b", 0, 3, 0), ("a", 3, 5, 1)]


@pytest.mark.parametrize(
    ("parts", "wanted"),
    [
        ([("A", "So we went"), ("B", "home. Then what?")], [("A", "So we went home."), ("B", "Then what?")]),
        ([("A", "It was done. And then"), ("B", "they left at once.")], [("A", "It was done."), ("B", "And then they left at once.")]),
        ([("A", "So we went"), ("B", "yes")], [("A", "So we went yes")]),
        ([("A", "All done."), ("B", "home. Then")], [("A", "All done."), ("B", "home. Then")]),
        ([("A", "So we went"), ("B", "to the big old house there.")], [("A", "So we went"), ("B", "to the big old house there.")]),
    ],
)
def test_sentences_are_finished(spark, parts, wanted):
    rows, at = [], 0.0
    for seq, (who, text) in enumerate(parts):
        for k, w in enumerate(text.split()):
            rows.append((1, seq, k, w, at, at + 0.5, who))
            at += 0.5
    words = spark.createDataFrame(rows, "recording_id bigint, seq bigint, word_ix int, text string, start_s double, end_s double, speaker string")
    found = {}
    for r in speakers.finish_sentences(words).orderBy("seq", "word_ix").collect():
        found.setdefault((r.seq, r.speaker), []).append(r.text)
    assert [(who, " ".join(w)) for (_, who), w in found.items()] == wanted


def test_nearest_voice_in_blocks(spark):
    """More means than are sent to every task give the same as all in one."""
    rng = random.Random(4)
    some = lambda n: [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(n)]
    pieces = spark.createDataFrame(some(60), "vec_id bigint, embedding array<double>")
    means = spark.createDataFrame(some(11), "label int, embedding array<double>")
    at_once = sorted(map(tuple, evaluation.nearest_voice(pieces, means).collect()))
    assert len(at_once) == 60 and len({v for _, v, _ in at_once}) > 3
    for few in (10, 3, 1):
        assert sorted(map(tuple, evaluation.nearest_voice(pieces, means, few=few).collect())) == at_once
