"""Corrections of words in order: everywhere, in one recording, or once, at the place nearest to a moment; and times for the corrected words.

Rules are (ord, wrong array<string>, right array<string>, and if there are such columns recording_id, null for all recordings, and at_s, null for
everywhere). Words count without the marks around them; a rule in lower case also stands for the word with a capital. Rules without words or that change nothing are left out.
Matches run over segments; what a rule puts in belongs where its match began. A corrected word keeps the stretch of heard words that it stands for, from_word to
to_word, in fractions where words were shared out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.folds import around, filled

#: Seconds around a segment within which a moment counts as in it.
REACH = 3.0
#: Rules for all recordings are sent to every task, so they must be few.
MOST_RULES = 100_000


def _same(wanted: str, core: str) -> bool:
    if wanted == core:
        return True
    return len(wanted) == len(core) > 0 and _capital_of(core[0], wanted[0]) and wanted[1:] == core[1:]


def _capital_of(capital: str, lower: str) -> bool:
    return lower.islower() and capital.isupper() and capital.lower() == lower


class _Words:
    """The words of a recording in order: text, the stretch of heard words (begin, end), and the line that each belongs to."""

    def __init__(self, texts: list[str]):
        self.all = [[w, float(k), float(k + 1), i] for i, t in enumerate(texts) for k, w in enumerate(t.split())]

    def match(self, k: int, wrong: list[str]) -> bool:
        return k + len(wrong) <= len(self.all) and all(_same(x, around(w[0])[1]) for x, w in zip(wrong, self.all[k:]))

    def put(self, k: int, wrong: list[str], right: list[str]) -> int:
        """Put the right words in place of those from k on; the place behind them."""
        old = self.all[k : k + len(wrong)]
        prefix, core, _ = around(old[0][0])
        suffix = around(old[-1][0])[2]
        line, begin = old[0][3], old[0][1]
        span = [w for w in old if w[3] == line][-1][2] - begin
        new = list(right)
        if core and wrong[0] and new[0] and _capital_of(core[0], wrong[0][0]):
            new[0] = new[0][0].upper() + new[0][1:]
        if not new[0].startswith(prefix):
            new[0] = prefix + new[0]
        if not new[-1].endswith(suffix):
            new[-1] += suffix
        n = len(new)
        self.all[k : k + len(wrong)] = [[w, begin + span * i / n, begin + span * (i + 1) / n, line] for i, w in enumerate(new)]
        return k + n

    def everywhere(self, wrong: list[str], right: list[str]) -> None:
        k = 0
        while k < len(self.all):
            k = self.put(k, wrong, right) if self.match(k, wrong) else k + 1

    def here(self, wrong: list[str], right: list[str], at: float, start: np.ndarray, end: np.ndarray, heard: np.ndarray) -> None:
        best = (np.inf, -1)
        near = set(np.flatnonzero((start - REACH <= at) & (at <= end + REACH)).tolist())
        for k, (_, begin, _, line) in enumerate(self.all):
            if line in near and self.match(k, wrong):
                best = min(best, (abs(start[line] + (end[line] - start[line]) * begin / max(1, heard[line]) - at), k))
        if best[1] >= 0:
            self.put(best[1], wrong, right)


RULE = "struct<ord:int,wrong:array<string>,right:array<string>,at_s:double>"
PIECES = "recording_id bigint, seq bigint, piece_ix int, text string, from_word double, to_word double, heard_words int"


def _rules(rules: DataFrame) -> DataFrame:
    for name, kind in (("recording_id", "bigint"), ("at_s", "double")):
        if name not in rules.columns:
            rules = rules.withColumn(name, F.lit(None).cast(kind))
    good = (F.size("right") > 0) & (F.size("wrong") > 0) & (F.col("wrong") != F.col("right"))
    return rules.where(good).select("recording_id", F.struct(F.col("ord").cast("int").alias("ord"), "wrong", "right", F.col("at_s").cast("double").alias("at_s")).alias("rule"))


def corrected_words(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """The words of segments (recording_id, seq, text, start_s, end_s) as corrected: piece_ix, text, from_word, to_word, and how many words were heard."""
    listed = _rules(rules)
    common = [r["rule"].asDict() for r in listed.where("recording_id IS NULL").limit(MOST_RULES + 1).collect()]
    if len(common) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules for all recordings")

    def fold(key, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = filled(rows, "seq", "text", "start_s", "end_s").sort_values("seq", kind="stable")
        words, start, end = _Words(rows["text"].fillna("").tolist()), rows["start_s"].to_numpy(float), rows["end_s"].to_numpy(float)
        heard = np.array([len(t.split()) for t in rows["text"].fillna("")], np.int64)
        for rule in sorted([*common, *(filled(own, "rule")["rule"].tolist() if len(own) else [])], key=lambda r: r["ord"]):
            wrong, right = [around(w)[1] for w in rule["wrong"]], list(rule["right"])
            if not any(wrong):
                continue
            if rule["at_s"] is None or rule["at_s"] != rule["at_s"]:
                words.everywhere(wrong, right)
            else:
                words.here(wrong, right, rule["at_s"], start, end, heard)
        line = np.array([w[3] for w in words.all], np.int64)
        order = np.argsort(line, kind="stable")
        place = np.empty(len(line), np.int64)
        place[order] = np.arange(len(line)) - np.searchsorted(line[order], line[order])
        text, begin, stop = ([w[k] for w in words.all] for k in range(3))
        return pd.DataFrame({"recording_id": key[0], "seq": rows["seq"].to_numpy()[line], "piece_ix": place, "text": pd.Series(text, dtype=object), "from_word": begin, "to_word": stop, "heard_words": heard[line]})

    left = segments.select("recording_id", "seq", "text", "start_s", "end_s").groupBy("recording_id")
    right = listed.where("recording_id IS NOT NULL").toDF("recording_id", "rule").groupBy("recording_id")
    return left.cogroup(right).applyInPandas(fold, PIECES)


def corrected(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """recording_id, seq, text of all segments, as corrected."""
    pieces = corrected_words(segments, rules).groupBy("recording_id", "seq").agg(F.array_sort(F.collect_list(F.struct("piece_ix", "text"))).alias("_p"))
    out = segments.select("recording_id", "seq").join(pieces, ["recording_id", "seq"], "left")
    return out.select("recording_id", "seq", F.coalesce(F.array_join(F.transform("_p", lambda p: p["text"]), " "), F.lit("")).alias("text"))


def retimed(pieces: DataFrame, words: DataFrame, segments: DataFrame) -> DataFrame:
    """corrected_words() with times and offsets in the corrected text: taken, at the fraction that they stand for, from the words as heard (recording_id, seq, word_ix, start_s,
    end_s), or shares of the segment's span where there aren't as many of these as the segment has words."""
    key = ["recording_id", "seq"]
    # A segment's words meet its pieces in one row: tables of words would be sent and sorted once for each end.
    timed = words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("word_ix", "start_s", "end_s"))).alias("_words"))
    timed = timed.withColumn("_plain", F.transform("_words", lambda x: x["word_ix"].cast("int")) == F.sequence(F.lit(0), F.size("_words") - 1))
    spans = segments.select(*key, F.col("start_s").alias("_s"), F.col("end_s").alias("_e")).join(timed, key, "left")
    rows = pieces.join(spans, key)
    last = F.col("heard_words") - 1
    rows = rows.withColumn("_a", F.least(F.floor("from_word"), last).cast("int")).withColumn("_b", F.greatest(F.lit(0), F.least(F.ceil("to_word") - 1, last)).cast("int"))
    word = lambda n: F.when(F.col("_plain"), F.get("_words", F.col(n))).otherwise(F.get(F.filter("_words", lambda x: x["word_ix"] == F.col(n)), F.lit(0)))
    first, final = word("_a"), word("_b")
    even = lambda x: F.col("_s") + (F.col("_e") - F.col("_s")) * F.col(x) / F.greatest(F.lit(1), F.col("heard_words"))
    known = F.coalesce(F.size("_words") == F.col("heard_words"), F.lit(False))
    start = F.when(known, first["start_s"] + (F.col("from_word") - F.floor("from_word")) * (first["end_s"] - first["start_s"])).otherwise(even("from_word"))
    end = F.when(known, final["start_s"] + (F.col("to_word") - F.col("_b")) * (final["end_s"] - final["start_s"])).otherwise(even("to_word"))
    before = Window.partitionBy(*key).orderBy("piece_ix").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return rows.select(*key, "piece_ix", "text", offset.alias("offset"), start.alias("start_s"), F.greatest(start, end).alias("end_s"))
