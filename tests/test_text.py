import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.functions import ordered
from talkgrid.functions import text as t


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("seconds", "clock", "cue"),
    [(0.0, "0:00", "00:00:00,000"), (59.999, "0:59", "00:00:59,999"), (61.0, "1:01", "00:01:01,000"), (3661.5, "1:01:01", "01:01:01,500"), (-5.0, "0:00", "00:00:00,000")],
)
def test_clocks(spark, seconds, clock, cue):
    assert one(spark, t.clock("s"), s=seconds) == clock
    assert one(spark, t.cue_time("s"), s=seconds) == cue


@pytest.mark.parametrize(
    ("text", "a", "b", "unfinished"),
    [("Done.", True, True, False), ("Done.”", False, True, False), ("and then", False, False, True), ("Wait… ", False, True, False), ("", False, True, True), ("this:", False, True, False)],
)
def test_sentence_ends_differ_by_use(spark, text, a, b, unfinished):
    assert one(spark, t.ends_paragraph("s"), s=text) is a
    assert one(spark, t.ends_sentence("s"), s=text) is b
    assert one(spark, t.unfinished("s"), s=text) is unfinished


@pytest.mark.parametrize(("text", "sentence", "word"), [("and so", True, True), ("And so", False, False), ("3 apples", False, True), ("“yes", True, True), ("...", False, False)])
def test_continuations(spark, text, sentence, word):
    assert one(spark, t.continues_sentence("s"), s=text) is sentence
    assert one(spark, t.continues_word("s"), s=text) is word


@pytest.mark.parametrize(
    ("previous", "candidate", "left"),
    [("we ship on friday", "On Friday, we rest", "we rest"), ("one two", "three four", "three four"), ("a b", "A b", ""), ("", "a", "a"), ("so it ends.", "It ends. — And", "And"), ("x x x", "x y", "y")],
)
def test_overlap_is_trimmed(spark, previous, candidate, left):
    assert one(spark, t.without_overlap("p", "c"), p=previous, c=candidate) == left


@pytest.mark.parametrize(
    ("text", "parts"),
    [("- Yes. - No.", ["Yes.", "No."]), ("again-- - I asked", ["again--", "I asked"]), ("well-known fact", ["well-known fact"]), ("", [""]), ("a - - b", ["a", "b"])],
)
def test_dialogue_parts(spark, text, parts):
    assert one(spark, t.dialogue_parts("s"), s=text) == parts


def test_readings(spark):
    assert one(spark, t.better_reading("a", "b"), a="we ship it on friday", b="We ship it on Friday.") is True
    assert one(spark, t.better_reading("a", "b"), a="we ship it on friday then", b="We ship.") is False
    assert one(spark, t.says_the_same("a", "b"), a="one two three", b="Three, two!") is False
    assert one(spark, t.says_the_same("a", "b"), a="", b="x") is True


def test_word_distance(spark):
    assert one(spark, t.word_distance(t.bare_words("a"), t.bare_words("b")), a="The cat sat", b="the dog sat down") == 2
    assert one(spark, t.word_distance(t.bare_words("a"), t.bare_words("b")), a="", b="x y") == 2


def test_occurrences_without_overlap(spark):
    assert one(spark, t.occurrences("s", "aa"), s="Aaaa aA") == 3


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("the meeting starts at ten the meeting starts at ten and runs", "the meeting starts at ten and runs"),
        ("one two three one two three", "one two three one two three"),
        ("A b c d e — a, b c d e f", "A b c d e f"),
        ("", ""),
    ],
)
def test_repeats_are_cut(text, left):
    assert ordered.trimmed_repeats(text) == left


@pytest.mark.parametrize(
    ("text", "left"),
    [("so I went. I don't. I don't. I don't. I don't. I don", "so I went. …"), ("no no no no no no no no", "…"), ("a fine sentence that says one thing only", "a fine sentence that says one thing only"), ("no no no", "no no no")],
)
def test_looped_tails_are_cut(text, left):
    assert ordered.trimmed_tail(text) == left


def test_common_pairs():
    assert ordered.common_pairs(list("abcd"), list("bd")) == [(1, 0), (3, 1)]
    assert ordered.common_pairs([], ["a"]) == []


def test_common_pairs_are_those_of_the_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a, b = (rng.integers(0, 1 + int(rng.integers(1, 6)), rng.integers(0, 20)).tolist() for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
        want, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                want.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1, j] >= best[i, j + 1]:
                i += 1
            else:
                j += 1
        assert ordered.common_pairs(a, b) == want


@pytest.mark.parametrize(("word", "letters"), [("Élan", "elan"), ("Straße", "strasse"), ("don’t", "don't"), ("Ærø", "aero"), ("42", "")])
def test_spelling(word, letters):
    assert ordered.spelled(word) == letters


def test_vectorised_functions_keep_nulls(spark):
    rows = spark.createDataFrame([("a b c d e a b c d e",), (None,), ("",)], "s string")
    assert [r[0] for r in rows.select(ordered.trim_repeats("s")).collect()] == ["a b c d e", None, ""]
    assert [r[0] for r in rows.select(ordered.loop_ratio("s")).collect()] == [None, None, None]
    assert rows.select(ordered.loop_ratio(F.repeat(F.lit("again and again "), 60))).first()[0] > 2.4
    ordered.register(spark)
    assert spark.sql("SELECT word_changes('a b c', 'b c d e').added").first()[0] == 2
