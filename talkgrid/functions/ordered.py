"""Small order-dependent kernels over words, and the vectorised functions made of them."""

from __future__ import annotations

import gzip
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHORTEST, LONGEST = 5, 40


def bare(word: str) -> str:
    return "".join(c for c in word if c.isalpha() or c.isdecimal()).lower()


def repeat_cut(folded: list[str]) -> tuple[int, int] | None:
    """The token range of the second copy of the longest, leftmost run of words that is said twice in a row."""
    at = [i for i, w in enumerate(folded) if w]
    said = np.unique([folded[i] for i in at], return_inverse=True)[1] if at else np.zeros(0, int)
    for n in range(min(LONGEST, len(at) // 2), SHORTEST - 1, -1):
        # Places where a word equals that n words on; n of them in a row are a repeat.
        same = np.append(0, np.cumsum(said[:-n] == said[n:]))
        found = np.flatnonzero(same[n:] - same[:-n] == n)
        if len(found):
            first = int(found[0])
            return at[first + n - 1] + 1, at[first + 2 * n - 1] + 1
    return None


def without_repeats(tokens: list[str], owners: list[int] | None = None) -> tuple[list[str], list[int]]:
    """Tokens after cutting second copies until none is left; owners are cut along."""
    owners = list(owners) if owners is not None else [0] * len(tokens)
    tokens, folded = list(tokens), [bare(t) for t in tokens]
    while cut := repeat_cut(folded):
        for row in (tokens, folded, owners):
            del row[cut[0] : cut[1]]
    return tokens, owners


def trimmed_repeats(text: str) -> str:
    tokens = text.split()
    kept, _ = without_repeats(tokens)
    return text if len(kept) == len(tokens) else " ".join(kept)


def trimmed_tail(text: str, repeats: int = 4, ignored: int = 4, phrase: int = 6) -> str:
    """The text without a phrase looping at its end, an ellipsis in its place."""
    words = text.split()
    if len(words) < 2 * repeats:
        return text
    folded, cut = [bare(w) for w in words], len(words)
    for end in range(len(words), max(0, len(words) - ignored - 1), -1):
        for n in range(1, phrase + 1):
            last, times = folded[end - n : end], 1
            while (times + 1) * n <= end and folded[end - (times + 1) * n : end - times * n] == last:
                times += 1
            if times >= repeats:
                cut = min(cut, end - times * n)
    return text if cut == len(words) else " ".join([*words[:cut], "…"])


def common_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order; of equals the left side moves first. A row of the table of lengths is a number, of which
    bit k is 0 where what is common to the two ends grows with the k-th last of b."""
    places: dict = {}
    for k, x in enumerate(reversed(b)):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    rows = [full] * (len(a) + 1)
    for i in range(len(a) - 1, -1, -1):
        row = rows[i + 1]
        hit = row & places.get(a[i], 0)
        rows[i] = ((row + hit) | (row - hit)) & full
    pairs, i, j, ends = [], 0, 0, full
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j, ends = i + 1, j + 1, ends >> 1
        # What is common without a[i] is as long as what is common without b[j], or longer.
        elif (rows[i + 1] & ends).bit_count() <= (rows[i] & ends >> 1).bit_count() + 1:
            i += 1
        else:
            j, ends = j + 1, ends >> 1
    return pairs


#: Letters that decomposition leaves whole, by the letters they are spelled with. Fixed values.
SPELLED = {"æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "’": "'"}


def spelled(word: str) -> str:
    """A word in the letters a to z and the apostrophe."""
    plain = "".join(SPELLED.get(c, c) for c in word.lower())
    return "".join(c for c in unicodedata.normalize("NFD", plain) if "a" <= c <= "z" or c == "'")


@F.pandas_udf(T.StringType())
def trim_repeats(texts: pd.Series) -> pd.Series:
    return texts.map(trimmed_repeats, na_action="ignore")


@F.pandas_udf(T.StringType())
def trim_looped_tail(texts: pd.Series) -> pd.Series:
    return texts.map(trimmed_tail, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def loop_ratio(texts: pd.Series) -> pd.Series:
    """How many times smaller a text becomes by compression; texts under 200 characters give null."""

    def ratio(t: str) -> float | None:
        data = t.encode()
        return len(data) / len(gzip.compress(data, 6)) if len(t) >= 200 else None

    return texts.map(ratio, na_action="ignore").astype("float64")


@F.pandas_udf(T.StringType())
def spell(words: pd.Series) -> pd.Series:
    return words.map(spelled, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def likeness(texts: pd.Series, heard: pd.Series) -> pd.Series:
    """The share of a text's letters that what was heard has in the same order."""

    def share(t: str, h: str) -> float:
        own = [c for c in t.lower() if c.isalpha()]
        return len(common_pairs(own, list(h))) / len(own) if own and h else 0.0

    return pd.Series([share(t or "", h or "") for t, h in zip(texts, heard)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("lost", T.LongType()), T.StructField("added", T.LongType())]))
def word_changes(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """How many words of the one text the other lacks, in order, and the other way round."""
    rows = []
    for a, b in zip(before, after):
        x, y = ([w for w in map(bare, (t or "").split()) if w] for t in (a, b))
        n = len(common_pairs(x, y))
        rows.append((len(x) - n, len(y) - n))
    return pd.DataFrame(rows, columns=["lost", "added"])


def differences(a: list[str], b: list[str]) -> tuple[int, int, int, list[tuple[str, str]]]:
    """Words replaced, left out and put in on a shortest way from a to b, and the stretches that differ, from the end on; of equal
    ways, read from the end, equal words come before replaced ones, and these before those left out."""
    d = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    d[:, 0], d[0, :] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    code = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([code[w] for w in b], int)
    step = np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        best = np.minimum(d[i - 1, :-1] + (y != code[a[i - 1]]), d[i - 1, 1:] + 1)
        # d[i, j] = min over k <= j of best[k] + (j - k)
        d[i] = np.minimum.accumulate(np.append(i, best) - step) + step
    counts, runs, own, other = [0, 0, 0], [], [], []
    i, j = len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d[i, j] == d[i - 1, j - 1]:
            if own or other:
                runs.append((" ".join(own[::-1]), " ".join(other[::-1])))
                own, other = [], []
            i, j = i - 1, j - 1
            continue
        kind = 0 if i and j and d[i, j] == d[i - 1, j - 1] + 1 else 1 if i and d[i, j] == d[i - 1, j] + 1 else 2
        counts[kind] += 1
        if kind != 2:
            i -= 1
            own.append(a[i])
        if kind != 1:
            j -= 1
            other.append(b[j])
    if own or other:
        runs.append((" ".join(own[::-1]), " ".join(other[::-1])))
    return *counts, runs


_RUN = T.StructType([T.StructField("own", T.StringType()), T.StructField("other", T.StringType())])


@F.pandas_udf(T.StructType([*[T.StructField(c, T.LongType()) for c in ("replaced", "missing", "added")], T.StructField("runs", T.ArrayType(_RUN))]))
def word_edits(before: pd.Series, after: pd.Series) -> pd.DataFrame:
    """Words replaced, missing and added from one text to another, and the stretches that differ, from the end on."""
    rows = []
    for a, b in zip(before, after):
        *counts, runs = differences(*([w for w in map(bare, (t or "").split()) if w] for t in (a, b)))
        rows.append((*counts, [{"own": x, "other": y} for x, y in runs]))
    return pd.DataFrame(rows, columns=["replaced", "missing", "added", "runs"])


@F.pandas_udf(T.StringType())
def streamed_text(previous: pd.Series, text: pd.Series) -> pd.Series:
    """A streamed text without the words that repeat the end of the one before it, nor those it says twice in a row."""
    return pd.Series([trimmed_repeats(after_overlap(p or "", t or "")).strip() for p, t in zip(previous, text)], dtype=object)


def leading_overlap(tail: list[str], head: list[str], most: int = 40) -> int:
    """How many words of the head repeat the end of the tail."""
    for n in range(min(most, len(tail), len(head)), 0, -1):
        if tail[-n:] == head[:n]:
            return n
    return 0


def after_overlap(previous: str, text: str) -> str:
    words = text.split()
    folded = [bare(w) for w in words]
    n = leading_overlap([bare(w) for w in previous.split()], folded)
    if not n:
        return text
    while n < len(words) and not folded[n]:
        n += 1
    return " ".join(words[n:])


def alphabet(entries: dict[str, int]) -> tuple[dict[str, int], int]:
    """The letters of a vocabulary, small, with their tokens, and the blank token: the one named so, else the padding, else 0."""
    letters = {name.lower(): token for name, token in entries.items() if len(name) == 1}
    if not letters:
        raise ValueError("the vocabulary has no letters in it")
    named = {name.lower(): token for name, token in entries.items() if len(name) > 1}
    return letters, named.get("<blank>", named.get("<pad>", 0))


def letter_tokens(words, letters: dict[str, int]):
    """The tokens that spell a column of words in an alphabet, each word's as an array; letters that it lacks are left out."""
    known = F.create_map(*[F.lit(x) for pair in letters.items() for x in pair])
    return F.filter(F.transform(F.filter(F.split(spell(words), ""), lambda c: c != ""), lambda c: F.element_at(known, c)), lambda t: t.isNotNull())


def register(spark) -> None:
    """Make the functions known to SQL."""
    for f in (trim_repeats, trim_looped_tail, loop_ratio, spell, likeness, word_changes, word_edits):
        spark.udf.register(f.__name__, f)
