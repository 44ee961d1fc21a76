"""Learned operators against plain definitions of their method, and held-out figures."""

import math
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkgrid.llm import language, quality, registry, toxicity
from talkgrid.llm.tables import table

SF = "/root/testdata/sf0.001"


def grams(text):
    """Letter n-grams of lower-cased words between marks, by n and then by code."""
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    found = Counter()
    marked = "_" + "_".join(spaced.split()) + "_" if spaced.split() else ""
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            if (g := marked[i : i + n]) != "_":
                found[g] += 1
    return found


def packed(gram):
    code = 0
    for c in gram:
        code = (code << 21) | ord(c)
    return code


def ranked(counts, most):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], packed(x[0])))[:most]]


def test_language_against_brute_force(spark):
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    held = lambda d: crc32(str(d).encode()) % 4 == 2
    counts = {}
    for r in rows:
        if r.lang is not None and r.text is not None and not held(r.doc_id):
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c, language.PROFILE))} for lang, c in counts.items()}
    found = {r.doc_id: r for r in registry.QUERIES["op1_language"](spark, SF).collect()}
    for r in rows:
        own = ranked(grams(r.text or ""), language.PROFILE)
        if not own:
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        away = {lang: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        second = min(v for lang, v in away.items() if lang != best)
        assert found[r.doc_id].lang_pred == best and found[r.doc_id].held_out == held(r.doc_id)
        assert math.isclose(found[r.doc_id].score, (second - away[best]) / second, abs_tol=1e-12)


def test_word_vectors_against_a_loop(spark):
    texts = ["One two, two 33!", "one\ttwo", "", "two two one ONE x9"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = quality.word_vectors(docs)
    places, signs = quality.index_vectors()
    total, many = np.zeros((quality.BUCKETS, quality.DIMENSIONS)), np.zeros(quality.BUCKETS)
    for t in texts:
        own = quality.tokens(quality.Words(pa.array([t]), quality.SPACE_WORDS))
        for i, here in enumerate(own):
            for b in here:
                many[b] += 1
            for j in (i - 1, i + 1):
                if 0 <= j < len(own):
                    for b in here:
                        for c in own[j]:
                            for place, sign in zip(places[:, c], signs[:, c]):
                                total[b, place] += sign
    assert np.allclose(found, total / np.maximum(1, many)[:, None])
    pooled = quality.pooled(pa.array(texts), found)
    for t, p in zip(texts, pooled):
        own = quality.tokens(quality.Words(pa.array([t]), quality.SPACE_WORDS))
        assert np.allclose(p, sum(found[b].astype(float) for w in own for b in w) / len(own) if len(own) else 0, atol=1e-6)


def test_risk_falls_as_by_its_formula():
    """The steps lower the non-negative risk as written down, and a model of much capacity is pushed back where its negative part would fall below 0."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    toxic = x[:, 0] + 0.3 * x[:, 1] > 0.8
    known = toxic & (rng.random(400) < 0.5)
    rows, positive, prior = np.vstack([x[known], x]), np.r_[np.ones(known.sum(), bool), np.zeros(400, bool)], float(toxic.mean())

    def risk(w, b):
        p, u = rows[positive] @ w + b, rows[~positive] @ w + b
        loss = lambda f: np.logaddexp(0, -f).mean()
        return prior * loss(p) + max(0.0, loss(-u) - prior * loss(-p))

    before = risk(np.zeros(3), math.log(prior / (1 - prior)))
    after = [risk(*toxicity.nnpu(rows, positive, prior, steps=n)) for n in (20, 100, 300)]
    assert before > after[0] > after[1] >= after[2] - 1e-3
    w, b = toxicity.nnpu(rows, positive, prior, steps=300, decay=0.0)
    by_numbers = np.array([(risk(w + d, b) - risk(w - d, b)) / 2e-3 for d in 1e-3 * np.eye(3)])
    assert np.abs(by_numbers).max() < 0.05
    shuffled = rng.permutation(len(rows))
    w2, b2 = toxicity.nnpu(rows[shuffled], positive[shuffled], prior, steps=300, decay=0.0)
    assert np.allclose(w, w2, atol=1e-3) and abs(b - b2) < 1e-3


def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    _, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.bincount(inverse, rank) / n)[inverse]
    yes = label == 1
    return (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


@pytest.mark.parametrize("name, column, least_area, least_found", [("op4_quality", "quality", 0.97, 0.9), ("op10_toxicity", "toxic", 0.94, 0.7)])
def test_held_out_ranking(spark, name, column, least_area, least_found):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in registry.QUERIES[name](spark, sf).where("held_out").collect()}
    known = duckdb.sql(f"SELECT doc_id, {column} FROM '{sf}/labels.parquet' WHERE {column} IS NOT NULL").fetchall()
    score, called, label = map(np.array, zip(*[(found[d].score, found[d].predicted, y) for d, y in known if d in found]))
    assert area(score, label) >= least_area
    assert called[label == 1].mean() >= least_found and called[label == 0].mean() <= (0.05 if column == "toxic" else 0.35)


def test_labels_teach_only_from_training_rows(spark):
    """Labels of held-out rows turned over change no score."""
    sf = SF
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = []
    for own in (labels, turned):
        model = toxicity.learn(docs.where(~toxicity.held_out()), own.where(~toxicity.held_out()).select("doc_id", "toxic"))
        scores.append({r.doc_id: r.score for r in toxicity.score(docs, model).collect()})
    assert scores[0] == scores[1]
