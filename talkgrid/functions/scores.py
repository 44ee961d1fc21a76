"""Functions of score arrays: log probabilities, likeliest tokens, class sets and levels, as column expressions."""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgrid.functions.text import let

#: Seconds between two time tokens.
TOKEN_STEP = 0.02


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def listed(rows: Sequence[Sequence[float]], number: Column) -> Column:
    """The row of that number (from 0) of a small fixed table; the table is parsed once, when the query is planned."""
    return F.get(F.from_json(F.lit(json.dumps(rows)), "array<array<double>>"), number.cast("int"))


def likeliest(scores: Column) -> Column:
    """The number (from 0) of the largest score, the first of equals."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def likeliest_of(scores: Column, allowed: Sequence[int]) -> Column:
    """The same among the allowed numbers, the first listed of equals; -1 if the scores have none of them."""
    known = F.filter(F.array(*[F.lit(int(k)) for k in allowed]).cast("array<int>"), lambda k: k < F.size(scores))
    each = F.transform(known, lambda k: F.get(scores, k))
    return F.coalesce(F.get(known, (F.array_position(each, F.array_max(each)) - 1).cast("int")), F.lit(-1))


def log_softmax(scores: Column) -> Column:
    """Scores as log probabilities; the largest is taken off first, so that no exponential overflows."""

    def shifted(s: Column) -> Column:
        offset = s.getField("top") + F.log(_sum(F.transform(s.getField("x"), lambda x: F.exp(x - s.getField("top")))))
        return let(offset, lambda o: F.transform(s.getField("x"), lambda x: x - o))

    return let(F.struct(scores.alias("x"), F.array_max(scores).alias("top")), shifted)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mean_run(log_probabilities: Column, first: Column, count: Column) -> Column:
    """The mean over a run of tokens, as far as there are any; 0 where there is nothing to average."""
    n = F.size(log_probabilities)
    inside = (count > 0) & (first >= 0) & (first < n)
    run = F.slice(log_probabilities, F.when(inside, first + 1).otherwise(1), F.when(inside, count).otherwise(1))
    return F.when(inside, _sum(run) / F.size(run)).otherwise(0.0)


def unit_variance(samples: Column) -> Column:
    """Samples at mean zero and variance one."""

    def scaled(s: Column) -> Column:
        x, mean = s.getField("x"), s.getField("mean")
        deviation = F.sqrt(_sum(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x) + 1e-7)
        return let(deviation, lambda d: F.transform(x, lambda v: (v - mean) / d))

    return F.when(F.size(samples) > 0, let(F.struct(samples.alias("x"), (_sum(samples) / F.size(samples)).alias("mean")), scaled)).otherwise(samples)


def level(power: Column, n: Column) -> Column:
    """The level of a sum of n powers below full scale, in decibels; null without any."""
    return F.when(n > 0, 10 * F.log10(F.greatest(F.lit(1e-12), F.try_divide(power, n))))


def class_sets(speakers: int, most: int) -> list[tuple[int, ...]]:
    """The sets of speakers that classes stand for: none, one each, then pairs and so on, in order."""
    return [c for size in range(most + 1) for c in combinations(range(speakers), size)]


def active(scores: Column, sets: Sequence[Sequence[int]]) -> Column:
    """The speakers of the likeliest class."""
    listed = F.array(*[F.array(*[F.lit(int(k)) for k in s]).cast("array<int>") for s in sets])
    return F.get(listed, likeliest(scores))


def prompt(start: int, task: int, language: Column | None = None, default_language: int = -1, before: int = -1, prior: Column | None = None, without_times: int = -1) -> Column:
    """The tokens that open a reading: earlier text after its mark (before), the start, the language, the task, and a
    request for no times; what is negative or empty is left out."""
    one = lambda *tokens: F.array(*[F.lit(t) for t in tokens]).cast("array<int>")
    none = F.array().cast("array<int>")
    parts = []
    if prior is not None and before >= 0:
        parts.append(F.when(F.size(prior) > 0, F.concat(one(before), prior)).otherwise(none))
    parts.append(one(start))
    spoken = F.when(language >= 0, language).otherwise(default_language) if language is not None else F.lit(default_language)
    parts.append(F.filter(F.array(spoken.cast("int")), lambda t: t >= 0))
    parts.append(one(task))
    if without_times >= 0:
        parts.append(one(without_times))
    return F.concat(*parts)


def token_seconds(token: Column, first: int) -> Column:
    """Seconds that a time token stands for; null for other tokens."""
    return F.when(token >= first, (token - first) * TOKEN_STEP)
