"""Near copies against brute force: the pipeline's stage drops what is similar at 0.8 or more, and nothing else."""

import random

import numpy as np

import corpus_pipeline
from talkgrid.llm import nearcopies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, words, times):
    words = list(words)
    for i in rng.sample(range(len(words)), times):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def texts(rng):
    made = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((3, 8, 40, 100, 300)))]
        made.append(words)
        made += [edited(rng, words, min(len(words), t)) for t in (0, 1, 2, 4, 12)]
    return [" ".join(w) for w in made] + ["", "  "]


def components(rows):
    sets = [shingles(t) for t in rows]
    low = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if low[a] != low[b] and similar(sets[a], sets[b]):
                x, y = max(low[a], low[b]), min(low[a], low[b])
                low = [y if v == x else v for v in low]
    return low


def test_one_word_changed_in_a_hundred_is_a_near_copy(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(100)]
    rows = [" ".join(words), *[" ".join(edited(rng, words, 1)) for _ in range(20)], " ".join(edited(rng, words, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()) == [0, 21]


def test_against_brute_force_and_in_blocks(spark):
    rows = texts(random.Random(5))
    want = components(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], SCHEMA).cache()
    for limits in ((), (3, 2), (3, 40)):
        assert {r.doc_id: r.component_id for r in nearcopies.near_duplicates(docs, *limits).collect()} == dict(enumerate(want))
    assert {r.doc_id for r in nearcopies.one_of_each(docs).collect()} == set(want)


def framed(rng, n, copies=True):
    """Texts in one frame of 400 words, each with 130 words of its own; of every tenth there is a near copy."""
    frame = [f"f{k}" for k in range(400)]
    out = []
    for k in range(n):
        own = [f"o{rng.randrange(10**9)}" for _ in range(130)]
        out.append(frame[:200] + own + frame[200:])
        if copies and k % 10 == 0:
            out.append(edited(rng, out[-1], 3))
    return [" ".join(w) for w in out]


def test_texts_that_share_a_frame_do_not_meet(spark, monkeypatch):
    rows = framed(random.Random(7), 200)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], SCHEMA).cache()
    left, real = [], nearcopies._linked_again

    def watched(members, *more):
        out = real(members, *more)
        left.append((members.count(), out.count()))
        return out

    monkeypatch.setattr(nearcopies, "_linked_again", watched)
    found = {r.doc_id: r.component_id for r in nearcopies.near_duplicates(docs, 50, 100).collect()}
    assert found == dict(enumerate(components(rows)))
    assert left == [(220, 40)]


def test_large_groups_of_a_key_are_linked_over_any_number_of_steps():
    rng = random.Random(2)
    chain = [[0] * nearcopies._ALL]
    for _ in range(80):
        chain.append([x if rng.random() < 0.7 else rng.randrange(200) for x in chain[-1]])
    rows = np.array(chain + [[rng.randrange(200) for _ in range(nearcopies._ALL)] for _ in range(40)], np.uint8)
    rows = rows[np.array(rng.sample(range(len(rows)), len(rows)))]
    key, node = np.zeros(len(rows), np.int64), np.arange(len(rows))
    found = [dict(zip(*(x.tolist() for x in nearcopies.agreeing(key, np.hstack([rows, np.zeros((len(rows), 4), np.uint8)]), node, large)))) for large in (8, 1000)]

    def root(links, x):
        while x in links:
            x = links[x]
        return x

    assert [root(found[0], x) for x in node] == [root(found[1], x) for x in node] and len(found[0]) > 60


def test_odd_rows(spark):
    odd = [(0, None), (1, ""), (3, "a b c d e f"), (3, "quite another text than that one"), (None, "a b c d e f"), (None, "none has this"), (9, "A b C d e f"), (9, "A b C d e f")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], SCHEMA)
    kept = nearcopies.one_of_each(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").lower()) for r in kept) == [(False, 0, ""), (False, 3, "a b c d e f"), (False, 3, "quite another text than that one"), (True, 0, "none has this")]
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0
