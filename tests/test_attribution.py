"""Dividing segments, timing words, clustering with strangers, and alignment, against literals and plain loops."""

import gzip
import itertools
import random

import numpy as np
import pytest

from talkgrid import plans
from talkgrid.functions import ordered
from talkgrid.operators import alignment, attribution, evaluation, folds
from talkgrid.sources import files
from talkgrid.sources.tables import table
from talkgrid.streaming import live

SF = "/root/testdata/sf0.001"


def test_six_words_of_two_voices(spark):
    text = "one two three four five six"
    segments = spark.createDataFrame([(1, 0, text, 0.0, 6.0), (1, 1, "", 6.0, 7.0), (2, 0, "alone here", 0.0, 2.0)], "recording_id bigint, seq bigint, text string, start_s double, end_s double")
    words = attribution.words_of(segments).selectExpr("*", "cast(word_ix as double) as start_s", "word_ix + 0.9D as end_s")
    turns = spark.createDataFrame([(1, 0, "A", 0.0, 3.0), (1, 1, "B", 3.0, 6.0), (1, 2, "C", 3.0, 3.2), (2, 0, "D", 0.0, 2.0)], "recording_id bigint, turn_ix int, speaker string, start_s double, end_s double")
    found = attribution.divide_by_words(segments, words, turns).collect()
    assert sorted((r.recording_id, r.seq, r.piece, r.speaker, r.text, round(r.start_s, 3), round(r.end_s, 3)) for r in found) == [
        (1, 0, 0, "A", "one two three", 0.0, 2.9), (1, 0, 1, "B", "four five six", 3.0, 5.9), (1, 1, 0, "A", "", 6.0, 7.0), (2, 0, 0, "D", "alone here", 0.0, 2.0),
    ]


def test_silence_divides_evenly(spark):
    segments = spark.createDataFrame([(1, 0, "aa bb cc dd", 0.0, 4.0), (2, 0, "no sound at all", 1.0, 2.0), (1, 1, "", 4.0, 5.0)], "recording_id bigint, seq bigint, text string, start_s double, end_s double")
    blocks = spark.createDataFrame([(1, k, [0.0] * 16) for k in range(4)], "recording_id bigint, block_ix bigint, samples array<double>")
    found = attribution.time_words(segments, blocks, 16).collect()
    words = sorted((r.word_ix, r.start_s, r.end_s) for r in found if r.recording_id == 1)
    assert np.allclose(words, [(i, i, i + 1) for i in range(4)], atol=1 / 16 + 1e-9)  # a frame is a sixteenth
    assert len([r for r in found if r.recording_id == 2]) == 4


def clusters(vectors, threshold):
    """Average linkage by its definition."""
    u = [v / np.linalg.norm(v) for v in vectors]
    groups = [[i] for i in range(len(u))]
    while len(groups) > 1:
        far = {(a, b): np.mean([1 - u[i] @ u[j] for i in groups[a] for j in groups[b]]) for a, b in itertools.combinations(range(len(groups)), 2)}
        a, b = min(far, key=far.get)
        if far[a, b] > threshold:
            break
        groups[a] += groups.pop(b)
    label = {i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    return [label[i] for i in range(len(u))]


def test_clustering_and_short_voices_against_loops(spark):
    rng = np.random.default_rng(3)
    rows, want, sweep = [], {}, {}
    for recording in range(6):
        centres = rng.normal(size=(3, 8))
        x = [centres[rng.integers(3)] + rng.normal(size=8) * 0.4 for _ in range(14)] + [rng.normal(size=8)]
        start = np.arange(15) * 2.0
        end = start + np.where(rng.random(15) < 0.4, 0.5, 1.5)
        rows += [(recording, i, [float(v) for v in x[i]], float(start[i]), float(end[i])) for i in range(15)]
        for threshold in (0.3, 0.6):
            long, short = [i for i in range(15) if end[i] - start[i] >= 0.9], [i for i in range(15) if end[i] - start[i] < 0.9]
            label = dict(zip(long, clusters([x[i] for i in long], threshold)))
            u = [v / np.linalg.norm(v) for v in x]
            strangers = [i for i in short if min(1 - u[i] @ u[j] for j in long) > threshold * 1.25]
            new = max(label.values()) + 1
            for i in short:
                if i not in strangers:
                    label[i] = label[min(long, key=lambda j: 1 - u[i] @ u[j] + 0.02 * max(0, start[j] - end[i], start[i] - end[j]))]
            label |= dict(zip(strangers, [new + k for k in clusters([x[i] for i in strangers], threshold)] if strangers else []))
            want[recording, threshold] = [label[i] for i in range(15)]
            held = {}
            for i in range(15):
                held[label[i]] = held.get(label[i], 0) + end[i] - start[i]
            sweep[recording, threshold] = (len(held), round(max(held.values()) / sum(held.values()), 9))
    voices = spark.createDataFrame(rows, "recording_id bigint, voice_ix bigint, embedding array<double>, start_s double, end_s double")
    for threshold in (0.3, 0.6):
        found = {(r.recording_id, r.voice_ix): r.speaker for r in attribution.attach_short(voices, threshold=threshold).collect()}
        assert all([found[r, i] for i in range(15)] == want[r, threshold] for r in range(6))
        plain = {(r.recording_id, r.voice_ix): r.speaker for r in folds.cluster_voices(voices, threshold=threshold).collect()}
        assert all([plain[r, i] for i in range(15)] == clusters([np.array(x[2]) for x in rows if x[0] == r], threshold) for r in range(6))
    assert {(r.recording_id, r.threshold): (r.speakers, round(r.largest_share, 9)) for r in evaluation.threshold_sweep(voices, (0.3, 0.6)).collect()} == sweep


def test_corridor_agrees_with_the_whole_grid():
    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(1, 9))
        tokens = rng.integers(1, 4, n)
        frames = int(rng.integers(n, 3 * n + 6))
        grid = np.log(rng.dirichlet(np.ones(4), frames))
        whole = folds.align_tokens(grid, tokens.tolist())
        wide = alignment.place_within(grid, tokens, np.zeros(frames, np.int64), 10 * n + 4)
        assert (whole is None) == (wide is None)
        if whole is not None:
            assert [[a, b] for a, b, _ in whole] == wide.tolist()
            middle = np.array([2 * np.searchsorted(wide[:, 0], t, "right") for t in range(frames)])
            narrow = alignment.place_within(grid, tokens, middle, 4)
            assert narrow is None or narrow.tolist() == wide.tolist()


def test_repeated_tokens_do_not_swap():
    grid = np.full((90, 4), -12.0)
    grid[:, 0] = -4
    for k, token in enumerate((1, 2, None, 1, 2)):
        if token:
            grid[18 * k : 18 * k + 18, token] = 0
    tokens = np.array([1, 2, 1, 2])
    centres = alignment.spine(np.arange(90.0), np.array([[0, 0], [90, 4]]), 4)
    assert alignment.place_within(grid, tokens, centres, 6).tolist() == [[0, 17], [18, 35], [54, 71], [72, 89]]
    assert alignment.place_within(grid, tokens, np.zeros(90, np.int64), 2) is None  # the end lies outside


def test_streamed_text_and_edits(spark):
    rows = [("and so it goes on", "goes on and on we went", "and on we went"), ("", "one two three four five one two three four five six", "one two three four five six"), ("all said", "nothing new", "nothing new"), (None, "x", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, previous string, text string, want string")
    assert all(r.got == r.want for r in df.select("want", ordered.streamed_text("previous", "text").alias("got")).collect())
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(7))] for _ in range(2))
        replaced, missing, added, runs = ordered.differences(a, b)
        assert replaced + missing + added == _distance(a, b) and len(a) - missing + added == len(b)
        assert sum(len(x.split()) for x, _ in runs) == replaced + missing and sum(len(y.split()) for _, y in runs) == replaced + added


def _distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    return d[-1]


def test_alphabet():
    letters, blank = ordered.alphabet({"<pad>": 0, "A": 5, "b": 6, "<BLANK>": 2, "<unk>": 3})
    assert (letters, blank) == ({"a": 5, "b": 6}, 2)
    assert ordered.alphabet({"<pad>": 7, "x": 1})[1] == 7 and ordered.alphabet({"x": 1})[1] == 0
    with pytest.raises(ValueError):
        ordered.alphabet({"<pad>": 0})


def test_guesswork(spark):
    segments = {(r.conv_id, r.turn): r.text for r in table(spark, SF, "conversations").collect()}
    for r in plans.QUERIES["guesswork"](spark, SF).collect():
        text = "and so on and " * 30 if r.seq % 4 == 3 else segments[r.recording_id, r.seq]
        loops = len(text) >= 200 and len(text.encode()) / len(gzip.compress(text.encode(), 6)) > 2.4
        logprob, silent = -((r.seq * 7 + r.recording_id * 3) % 15) / 10, (r.seq * 5 + r.recording_id) % 10 / 10
        assert (r.loops, r.guesswork) == (loops, loops or logprob < -1 or silent > 0.6)


def test_raw_floats(spark, tmp_path):
    x = np.arange(7, dtype="<f4") / 3
    (tmp_path / "a.bin").write_bytes(x.tobytes() + b"\x01")
    (tmp_path / "b.bin").write_bytes(b"")
    found = {r.path.rsplit("/", 1)[1]: r["values"] for r in files.read_raw_floats(spark, str(tmp_path)).collect()}
    assert found == {"a.bin": [float(v) for v in x]}


def test_streamed_windows_follow_what_was_shown(spark):
    rows = [(1, 0, "so we begin with the plan"), (1, 1, "with the plan, and then we go"), (1, 2, "and then we go"), (1, 3, "we go home now"), (2, 0, " "), (2, 1, None), (2, 2, "alone")]
    found = live.streamed(spark.createDataFrame(rows, "recording_id bigint, window_ix bigint, text string")).collect()
    assert sorted((r.recording_id, r.window_ix, r.text) for r in found) == [(1, 0, "so we begin with the plan"), (1, 1, "and then we go"), (1, 3, "home now"), (2, 2, "alone")]
