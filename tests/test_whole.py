"""Queries that leave out nothing of their table."""

import numpy as np

from talkgrid import plans
from talkgrid.operators import evaluation
from talkgrid.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_every_letter_is_aligned_and_read_back(spark):
    letters = {}
    for r in table(spark, SF, "conversations").collect():
        own = [str(ord(c) - 96) for c in r.text.lower() if "a" <= c <= "z"]
        if own:
            letters[r.conv_id, r.turn] = own
    assert max(len(v) for v in letters.values()) > 40 and any(turn for _, turn in letters)
    placed = plans.QUERIES["ctc_place_all"](spark, SF).groupBy("recording_id", "seq").count().collect()
    assert {(r[0], r[1]): r[2] for r in placed} == {k: len(v) for k, v in letters.items()}
    read = plans.QUERIES["read_back_all"](spark, SF).collect()
    assert {(r.recording_id, r.seq): r.tokens.split() for r in read} == letters


def test_all_pairs_of_voices_count_once(spark):
    voices = table(spark, SF, "embeddings").where("vec_id < 90")
    rows = voices.collect()
    u = np.array([r.embedding for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    a, b = np.triu_indices(len(rows), 1)
    distance = 1 - (u @ u.T)[a, b]
    label = np.array([r.label for r in rows])
    same = label[a] == label[b]
    gap = evaluation.mean_gap(voices.withColumn("embedding", voices.embedding.cast("array<double>"))).first()
    assert np.allclose([gap.same, gap.different], [distance[same].mean(), distance[~same].mean()])
    want: dict = {}
    for k, s in zip(np.ceil((distance - 0.05) / 0.01), same):
        want[int(k), bool(s)] = want.get((int(k), bool(s)), 0) + 1
    for block_rows in (8192, 20):
        bins = evaluation.pair_bins(voices.withColumn("embedding", voices.embedding.cast("array<double>")), block_rows=block_rows).collect()
        assert {(r.bin, r.same): r.n for r in bins} == want
