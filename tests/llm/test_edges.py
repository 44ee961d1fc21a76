"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from talkgrid.llm import decontaminate, language, linededup, mixing, pii, quality, simhash, substrings, toxicity, vectors

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words string, spans string, n_lines string, size string, fp string, _doc string, _row string, _gone string, _key string, _fp string, _bucket string, _other string, _spans string"
LONG = " ".join(f"word{i % 997}" for i in range(120_000))


def docs(spark, *texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, "s" if k % 2 else None, None, 0.5, *["x"] * 13) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, None, "", " \t\n", "One line here.\nOne line here.", "One line here.\nOne line here.", LONG, "é" * 5000, ids=[0, 1, 2, 3, 3, None, 6])


def test_language(spark, odd):
    training = docs(spark, "the cat is in the house and the dog", "der hund ist in dem haus und die katze").withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("de"))
    found = {(r.doc_id, r.lang_pred) for r in language.predict(odd, language.learn(training)).collect()}
    assert {(0, "und"), (1, "und"), (2, "und")} <= found and all(p in ("en", "de", "und") for _, p in found)
    assert {r.lang_pred for r in language.predict(odd, language.learn(odd)).collect()} == {"und"}
    assert language.predict(odd.limit(0), {}).count() == 0


def test_pii(spark, odd):
    found = {r.doc_id: r.spans for r in pii.find(odd).collect()}
    assert len(found) == 6 and found[0] == [] and found[1] == []
    assert pii.find(odd.limit(0)).count() == 0


def test_simhash(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 7 and {r.component_id for r in found if r.doc_id in (0, 1, 2)} == {0} and {r.fp for r in found if r.doc_id in (0, 1, 2)} == {0}
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "6", "None"]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_quality_and_toxicity(spark, odd):
    labels = spark.createDataFrame([(3, 1, 1), (6, 0, 0), (1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    shared = spark.sparkContext.broadcast(quality.word_vectors(odd))
    for scored in (quality.score(odd, shared, quality.learn(odd, labels, shared)), toxicity.score(odd, toxicity.learn(odd, labels))):
        rows = scored.collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in quality.score(odd, shared, quality.learn(odd, none, shared)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(odd, toxicity.learn(odd, none)).collect()} == {0.0}
    assert quality.score(odd.limit(0), shared, quality.Constant(0.5)).count() == 0


def test_substrings(spark, odd):
    rows = substrings.dedup(odd).collect()
    assert len(rows) == 7 and "lang" in rows[0].asDict()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[0] == [(0, 0)] and by[3] == [(6, 0), (6, 0)] and by[None][0][0] == 120_000 and by[None][0][1] == 120_000 - 997 - 19 + 19
    assert substrings.dedup(odd.limit(0)).count() == 0


def test_line_dedup(spark, odd):
    rows = linededup.dedup(odd).collect()
    assert len(rows) == 7 and sorted(r.text for r in rows if r.doc_id == 3) == ["One line here."] * 2
    assert next(r for r in rows if r.doc_id == 0).text is None and next(r for r in rows if r.doc_id == 2).text == " \t\n"
    assert linededup.dedup(odd.limit(0)).count() == 0


def test_decontaminate(spark, odd):
    items = spark.createDataFrame([(1, "one line"), (2, None), (3, "...")], "item_id bigint, text string")
    rows = decontaminate.find(odd, items).collect()
    assert len(rows) == 7 and {r.doc_id: r.n_hit for r in rows}[3] == 4 and {r.doc_id: r["items"] for r in rows}[3] == ["1"]
    assert decontaminate.find(odd, items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find(odd.limit(0), items).count() == 0
    left = decontaminate.remove_spans(decontaminate.find(odd, items))
    assert {r.text for r in left.where("doc_id = 3").collect()} == {" here.\n here."}


def test_mixing(spark, odd):
    rows = mixing.assign(odd).collect()
    assert len(rows) == 7 and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.assign(odd.limit(0)).count() == 0


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (10, [0.0, 1.0]), (None, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(1))
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in vectors.links(v).collect())
    assert found == sorted([("1", 2, "1"), ("2", 2, "1"), ("2", 2, "1"), *[(str(k), 0, str(k)) for k in (3, 4, 5, 6, 7, 8, 9, 10)], ("None", 0, "None")])
    assert vectors.links(v.limit(0)).count() == 0
