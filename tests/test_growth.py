"""Work that grows with its input and no faster: long texts, recordings and vectors in a time that squares of their length would exceed by far."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from talkgrid.functions import text as t
from talkgrid.operators import alignment, attribution, evaluation, folds, sequence


def within(seconds, work):
    start = time.monotonic()
    found = work()
    assert time.monotonic() - start < seconds
    return found


def test_a_long_text_is_taken_apart_once(spark):
    words = [f"w{i}" for i in range(6000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[::2])), (" ".join(words), " ".join(words[:4200]))], "a string, b string")
    assert [r.same for r in within(20, lambda: df.select(t.says_the_same("a", "b").alias("same")).collect())] == [False, True]


def test_a_long_recording_is_filled_in_one_pass_each_way(spark):
    n = 150_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").alias("word_ix"), F.when(F.col("id").isin(0, n - 1), F.col("id") * 0.5).alias("at_s"))
    found = within(30, lambda: sequence.interpolate(df).agg(F.count("*").alias("n"), F.max(F.abs(F.col("at_s") - F.col("word_ix") * 0.5)).alias("off")).first())
    assert found.n == n and found.off < 1e-6


def test_a_long_vector_is_brought_to_length_one_once(spark):
    rng = np.random.default_rng(4)
    v, m = rng.normal(size=(2, 20_000)), rng.normal(size=(3, 20_000))
    unit = lambda x: x / np.linalg.norm(x)
    pieces = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").localCheckpoint()
    means = spark.createDataFrame([(i, unit(x).tolist()) for i, x in enumerate(m)], "label int, embedding array<double>").localCheckpoint()
    found = within(20, lambda: evaluation.nearest_voice(pieces, means).orderBy("vec_id").collect())
    far = 1 - np.array([[unit(x) @ unit(y) for y in m] for x in v])
    assert [r.voice for r in found] == far.argmin(axis=1).tolist() and np.allclose([r.distance for r in found], far.min(axis=1))


def test_pairs_of_vectors_of_several_lengths(spark):
    rows = [(0, 1, [1.0, 2.0, 3.0]), (1, 1, [0.5, -2.0]), (2, None, [2.0, 1.0, 0.0]), (3, 2, None), (4, 2, [1.0, None, 2.0]), (5, 1, [0.0, 0.0, 0.0]), (6, 2, [])]
    v = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")

    def distance(a, b):
        if a is None or b is None or None in a or None in b:
            return None
        unit = lambda x: np.array(x) / (np.linalg.norm(x) if np.linalg.norm(x) > 1e-12 else 1)
        n = min(len(a), len(b))
        return round(1 - float(unit(a)[:n] @ unit(b)[:n]), 9)

    wanted = {(a, b): (None if x is None or y is None else x == y, distance(p, q)) for a, x, p in rows if a % 2 == 0 for b, y, q in rows if a != b}
    for size in (2, 100):
        found = evaluation.query_pairs(v.where("vec_id % 2 = 0"), v, size, size).collect()
        assert {(r.a, r.b): (r.same, None if r.distance is None else round(r.distance, 9)) for r in found} == wanted and len(found) == len(wanted)


def test_many_small_groups_cost_no_table_each(spark):
    """The words of sixty thousand segments; a table a segment took milliseconds for each."""
    n = 60_000
    rows = spark.range(n * 4).select((F.col("id") / 4 / 6).cast("long").alias("recording_id"), ((F.col("id") / 4).cast("long") % 6).alias("seq"), (F.col("id") % 4).cast("int").alias("word_ix"))
    rows = rows.withColumns({"text": F.concat(F.lit("w"), "word_ix"), "label": F.when(F.col("word_ix") == 2, "B").otherwise("A")}).localCheckpoint()
    found = within(25, lambda: folds.steady_words(rows).agg(F.count("*").alias("n"), F.sum((F.col("label") == "A").cast("int")).alias("a")).first())
    assert (found.n, found.a) == (n * 4, n * 4)


def test_many_short_recordings_are_placed_with_few_calls(spark):
    """Words heard in forty thousand recordings; two tables and a table of lengths for each took milliseconds."""
    n, said = 40_000, " ".join(f"word{k}" for k in range(40))
    segments = spark.range(n).select(F.col("id").alias("recording_id"), F.lit(0).cast("long").alias("seq"), F.lit(said).alias("text"), F.lit(0.0).alias("start_s"), F.lit(40.0).alias("end_s"))
    heard = segments.select("recording_id", F.posexplode(F.split("text", " ")).alias("word_ix", "text")).where("word_ix % 3 <> 1").withColumn("at_s", F.col("word_ix") + 0.5)
    segments, heard = segments.localCheckpoint(), heard.localCheckpoint()
    found = within(30, lambda: folds.place_heard(segments, heard).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("start_s") - F.least("word_ix", F.lit(39)) - 0.5)).alias("off")).first())
    assert found.n == n * 40 and found.off < 1e-6 * n


def test_heard_words_and_segments_with_nulls(spark):
    segments = spark.createDataFrame([(1, 0, "a b c", 0.0, 3.0), (1, 1, None, 3.0, 4.0), (1, 2, "d", None, None), (2, 0, "e", 0.0, 1.0), (3, 0, "", 0.0, 1.0)], "recording_id bigint, seq bigint, text string, start_s double, end_s double")
    heard = spark.createDataFrame([(1, 0, "A", 0.5), (1, 1, "C!", 2.5), (1, 2, "b", None), (3, 0, "x", 0.5), (9, 0, "y", 0.5)], "recording_id bigint, word_ix int, text string, at_s double")
    found = sorted(tuple(x) for x in folds.place_heard(segments, heard).collect())
    assert found == [(1, 0, 0, "a", 0.5, 1.5), (1, 0, 1, "b", 1.5, 2.5), (1, 0, 2, "c", 2.5, 3.0)]


def test_sound_of_segments_beside_others_of_no_sound(spark):
    v = [(r, [float((r * i) % 7 - 3) for i in range(64)]) for r in range(1, 5)]
    blocks = spark.createDataFrame([(r, k, x[k * 16 : k * 16 + 16]) for r, x in v for k in range(4)], "recording_id bigint, block_ix bigint, samples array<double>")
    segments = spark.createDataFrame([(r, s, "one three, fifteen", 0.5 + s, 1.75 + 2 * s) for r in range(1, 6) for s in range(2)] + [(1, 2, None, 0.0, 1.0), (1, 3, "x", 2.0, 1.0)], "recording_id bigint, seq bigint, text string, start_s double, end_s double")
    found = {(x.recording_id, x.seq, x.word_ix): (x.start_s, x.end_s) for x in attribution.time_words(segments, blocks, 16).collect()}
    assert len(found) == 31 and found[1, 3, 0] == (2.0, 2.0)
    for (r, s, k), (start, end) in found.items():
        a, b = int((0.5 + s) * 16), min(64, int((1.75 + 2 * s) * 16))
        sound = np.abs(dict(v).get(r, [0.0] * 64))[a:b] if r < 5 else np.zeros(0)
        if s > 1 or r == 5:
            continue
        curve, weight = np.append(0, np.cumsum(np.maximum(sound, 0.002))), np.cumsum([0, 3, 6, 7])
        at = (0.5 + s) + (1.25 + s) * np.searchsorted(curve, weight / 16 * curve[-1]) / len(sound)
        assert np.allclose((start, end), at[k : k + 2])


def test_windows_of_long_segments_put_their_letters_together_once(spark):
    """Sixteen segments of three thousand words; their letters were put together anew for each frame."""
    from talkgrid.plans import grids

    n = 3000
    words = spark.range(16 * n).select((F.col("id") / n).cast("long").alias("recording_id"), F.lit(0).cast("long").alias("seq"), (F.col("id") % n).cast("int").alias("word_ix"))
    words = words.withColumns({"tokens": F.array(*[(F.col("word_ix") + k) % 3 + 1 for k in range(5)]).cast("array<int>"), "first": F.col("word_ix").cast("long") * 5}).localCheckpoint()
    spans = spark.range(16).select(F.col("id").alias("recording_id"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("first"), F.lit(15 * n).cast("long").alias("count"))
    table = [[float(i == k) for i in range(4)] for k in range(4)]
    made = grids.windows_of(words, spans, table, lambda token, ix: token)
    found = within(12, lambda: made.agg(F.sum(F.size("logp")).alias("n"), F.sum(F.get(F.get("logp", F.lit(1)), F.lit(1))).alias("hit")).first())
    assert (found.n, found.hit) == (16 * 15 * n, 16)


def test_short_recordings_are_aligned_without_tables_of_segments():
    """Six hundred recordings of forty words; grouping their words in tables took twenty milliseconds for each."""
    tokens = np.arange(120) % 3 + 1
    grid = np.full((360, 4), -12.0)
    label = np.zeros(360, int)
    label[1::3] = tokens
    grid[np.arange(360), label] = 0.0
    rows = [(k // 8, k % 8, tokens[3 * k : 3 * k + 3].tolist(), k // 8 * 1.44, k // 8 * 1.44 + 1.44) for k in range(40)]
    own = pd.DataFrame(rows, columns=["seq", "word_ix", "tokens", "start_s", "end_s"])
    found = within(3, lambda: [alignment.word_times(own, grid, 0.06) for _ in range(600)])
    assert np.allclose(found[0]["start_s"], (np.arange(40) * 9 + 1) * 0.06) and np.allclose(found[-1]["end_s"], (np.arange(40) * 9 + 8) * 0.06)
