"""Grids with many frames a row: what is made, read, placed and aligned is as with a frame a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from talkgrid.operators import alignment, placement
from talkgrid.plans import grids
from talkgrid.streaming import retiming

STEP, KINDS = 0.02, 9


def number(token, ix):
    return token * 5 + F.pmod(ix * 3, F.lit(5))


TABLE = [[(0.0 if i == token else -12.0) - (r + i * 3) % 5 / 8 for i in range(KINDS + 1)] for token in range(KINDS + 1) for r in range(5)]


@pytest.fixture(scope="module")
def said(spark):
    """Words of two recordings, one longer than some rows of a grid; a segment without letters, and every third stamped late."""
    rows, at = [], {1: 0, 2: 0}
    for r, many in ((1, 40), (2, 3)):
        for seq in range(many):
            own = [[(seq * 7 + k * 5 + i * i) % KINDS + 1 for i in range((seq + k) % 6)] for k in range(5 if seq != 2 else 0)] or [[], []]
            n, late = sum(map(len, own)), 9.5 if seq % 3 == 1 else 0.25
            for k, tokens in enumerate(own):
                first = at[r] + sum(map(len, own[:k]))
                rows.append((r, seq, k, tokens, first, at[r] * 3 * STEP + late, (at[r] + n) * 3 * STEP + late))
            at[r] += n
    words = spark.createDataFrame(rows, "recording_id bigint, seq bigint, word_ix int, tokens array<int>, first bigint, start_s double, end_s double").cache()
    return words, {r: [t for x in rows if x[0] == r for t in x[3]] for r in at}


def frames_of(spark, letters):
    rows = [(r, ix * 3 + k, TABLE[(token if k == 1 else 0) * 5 + ix * 3 % 5]) for r, own in letters.items() for ix, token in enumerate(own) for k in range(3)]
    return spark.createDataFrame(rows, "recording_id bigint, frame bigint, logp array<double>").cache()


def rowed(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_rows_of_many_frames_are_the_frames(spark, said):
    words, letters = said
    rows = grids.rows_of(words, TABLE, number).collect()
    assert max(len(r.logp) for r in rows) <= 3 * grids.ROW and len(rows) > len(letters)
    made = sorted((r.recording_id, r.frame + k, list(x)) for r in rows for k, x in enumerate(r.logp))
    assert made == sorted((r.recording_id, r.frame, list(r.logp)) for r in frames_of(spark, letters).collect())
    assert all(r.final == (r.frame // 3 + len(r.logp) // 3 == len(letters[r.recording_id])) for r in rows)


def test_windows_with_their_own_grids_place_as_frames_do(spark, said):
    words, letters = said
    lengths = words.groupBy("recording_id").agg((F.sum(F.size("tokens")) * 3).alias("length"))
    cut = lambda part, around: grids.windows_of(words, placement.spans_of(part, lengths, STEP, around), TABLE, number)
    found = rowed(placement.place_windows_twice(cut, words, STEP).select("recording_id", "seq", "word_ix", "start_s", "end_s", "grade", "wide"))
    assert found == rowed(placement.place_twice(frames_of(spark, letters), words, STEP).select("recording_id", "seq", "word_ix", "start_s", "end_s", "grade", "wide"))
    assert {r[-1] for r in found} == {False, True}


def test_rows_of_many_frames_are_read_and_aligned_as_frames_are(spark, said):
    words, letters = said
    frames, rows = frames_of(spark, letters), grids.rows_of(words, TABLE, number)
    spans = spark.createDataFrame([(1, s, s * 1.7, s * 1.7 + 0.37 * s) for s in range(30)] + [(2, 0, 0.0, 99.0)], "recording_id bigint, seq bigint, start_s double, end_s double")
    read = lambda df: sorted((x.recording_id, x.seq, list(x.heard)) for x in placement.read_spans(placement.likeliest_tokens(df), spans, STEP).collect())
    assert read(rows) == read(frames) != []
    assert rowed(alignment.align_recordings(rows, words, STEP)) == rowed(alignment.align_recordings(frames, words, STEP)) != []


def test_a_scan_in_rows_of_many_frames_is_timed_as_whole_grids_are(spark, said, tmp_path):
    words, _ = said
    rows = grids.rows_of(words, TABLE, number, row=50)
    timed = retiming.Retimer(words, str(tmp_path), STEP)
    for batch in range(3):
        timed(rows.where(F.floor(F.col("frame") / 300) == batch if batch < 2 else F.col("frame") >= 600), batch)
    found = rowed(retiming.retimed(spark, str(tmp_path)))
    assert found == rowed(alignment.align_recordings(rows, words, STEP)) != []
    frontier = {r.recording_id: r.far for r in spark.read.parquet(f"{tmp_path}/passes").groupBy("recording_id").agg(F.max("frontier_s").alias("far")).collect()}
    length = {r.recording_id: r.n * 3 * STEP for r in words.groupBy("recording_id").agg(F.sum(F.size("tokens")).alias("n")).collect()}
    assert {k: round(v, 6) for k, v in frontier.items()} == {k: round(v, 6) for k, v in length.items()}
