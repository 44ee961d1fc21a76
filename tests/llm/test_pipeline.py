"""Every stage of the pipeline on odd rows: nulls in any column, empty and long texts, repeated rows, extra columns, no rows."""

import random

import pytest

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, _key string, n_hit string, _other string"
LONG = " ".join(f"word{i % 997}" for i in range(60_000))
LINE = "This line of seven words stands alone."
ROWS = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n", None, None, 3), (3, LINE, "en", "a", 9), (3, LINE, "en", "a", 9), (4, f"{LINE}\nSome other words that nobody else has ever said.", None, "b", None),
    (5, LONG, "en", None, 1), (None, "A text without any number to its name at all.", "en", "a", 5), (None, None, None, None, None), (6, "é" * 3000, None, "a", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "x", "y", "z") for r in ROWS], SCHEMA)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_odd_rows(spark, odd, name, stage):
    rows = stage(spark, odd, SF).collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    whole = sorted((r[0] is None, r[0] or 0) for r in ROWS)
    if name == "mixing":
        assert {i for _, i in ids} <= {3, 4, 5, 6, 0} and all(r.taken > 0 for r in rows)
    elif name == "line dedup":  # the line's first row stays, its repetition shares its place, and of document 4 the other line stays
        assert ids == whole
        assert next(r.text for r in rows if r.doc_id == 4) == "Some other words that nobody else has ever said."
    elif name == "SimHash near-dedup":  # wordless texts are one group; 3 is there twice; rows without id stay if nothing with one is like them
        assert ids == [(False, 0), (False, 3), (False, 4), (False, 5), (False, 6), (True, 0)]
    else:
        assert ids == whole
    if name != "mixing":
        assert set(rows[0].asDict()) == set(pipeline.COLUMNS)
        untouched = {r[0]: r[1] for r in ROWS if r[0] in (5, 6)}
        assert {r.doc_id: r.text for r in rows if r.doc_id in (5, 6)} == (untouched if name != "line dedup" else {**untouched})


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_no_rows(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_benchmark_passages_go_and_others_stay(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 12]
    rng = random.Random(4)
    own = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    texts = [f"{own(5)} {items[0]} {own(4)}", own(20), items[1]]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = {r.doc_id: r for r in pipeline.remove_benchmark(spark, docs, SF).collect()}
    assert left[1].text == texts[1] and all(len(left[i].text.split()) < len(texts[i].split()) for i in (0, 2)) and len(left[2].text.strip(" .,;:!?")) < 3
    assert left[0].text.split()[:5] == texts[0].split()[:5] and left[0].n_chars == len(left[0].text)


def test_near_dedup_links_by_fingerprint(spark, monkeypatch):
    """Two texts whose fingerprints differ in few bits are one, though their shingles have less than 0.8 in common; so are long near copies."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    close = [w if k % 60 else f"x{k}" for k, w in enumerate(words)]  # 0.85 or so of 5-word shingles
    texts = [" ".join(words), " ".join(close), " ".join(f"y{rng.randrange(10**6)}" for _ in range(30)), "a b c a b c a b c a b c", "a b c a b c a b c a b c a b c d"]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    prints = {r.doc_id: r.component_id for r in pipeline.simhash.near_duplicates(docs).collect()}
    left = {r.doc_id for r in pipeline.remove_near_duplicates(spark, docs, SF).collect()}
    assert left <= {i for i, c in prints.items() if i == c} and {0, 2, 3} <= left and 1 not in left
    alone = {r.doc_id for r in pipeline.nearcopies.one_of_each(docs).collect()}
    assert prints[4] == 3 and 4 in alone and 4 not in left
