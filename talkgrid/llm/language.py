"""Language identification by rank-order n-gram profiles.

A profile is the PROFILE most frequent letter n-grams (n = 1 to 3, words lower-cased and bounded by
one mark) in rank order. A document goes to the language whose profile its own ranks are least out of
place to; an n-gram that a profile lacks counts PROFILE places. The score is the relative lead over
the second language.

Edges: a null text, or one without letters, is `und` with score 0; without training rows all are
`und`; ties go to the language first by name; null languages are not learned; repeated rows count
each in learning; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrid.llm.tables import split_of, table
from talkgrid.llm.textbytes import pieces

PROFILE = 400
MARK = 0x5F
#: Distinct n-grams that a task holds before it hands on its counts.
HELD = 500_000


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def gram_codes(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For n = 1, 2, 3 the n-grams (packed code points) and their documents, and which documents have letters."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    size = pc.utf8_length(lower).to_numpy(zero_copy_only=False)
    text = "".join(lower.to_pylist())
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    letter = _letters()[points]
    points = np.where(letter, points, MARK)
    begins = np.zeros(len(points) + 1, bool)
    begins[np.cumsum(size) - size] = True
    keep = letter | begins[:-1]
    keep[1:] |= letter[:-1]
    # Each document begins and ends with a mark: a letter at its start gets one put before it.
    points, doc, first = points[keep], doc[keep], (begins[:-1] & letter)[keep]
    put = np.flatnonzero(first)
    points, doc = np.insert(points, put, MARK), np.insert(doc, put, doc[put])
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True) & (points != MARK)) + 1 if len(doc) else np.zeros(0, int)
    points, doc = np.insert(points, last, MARK), np.insert(doc, last, doc[last - 1])
    has = np.bincount(doc[points != MARK], minlength=len(size)) > 0
    codes, docs = [], []
    for n in (1, 2, 3):
        m = max(0, len(points) - n + 1)
        code = np.zeros(m, np.int64)
        for k in range(n):
            code = (code << 21) | points[k : k + m]
        good = doc[:m] == doc[n - 1 : n - 1 + m]
        if n == 1:
            good &= points != MARK
        codes.append(code[good])
        docs.append(doc[:m][good])
    return codes, docs, has


def _counter(batches):
    """Rows (text, lang) to (lang, gram, n), summed over what a task has read so far."""
    held: dict[str, list] = {}

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([p[1] for p in parts]), len(grams)).astype(np.int64)

    def out():
        for lang, parts in held.items():
            grams, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for piece in pieces(batches):
        langs, lang_of = np.unique(np.array(piece.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        codes, docs, _ = gram_codes(piece.column("text"))
        for i, lang in enumerate(langs.tolist()):
            own = np.concatenate([c[lang_of[d] == i] for c, d in zip(codes, docs)])
            held[lang] = [summed([*held.get(lang, []), np.unique(own, return_counts=True)])]
        if sum(len(parts[0][0]) for parts in held.values()) > HELD:
            yield from out()
    yield from out()


def learn(training: DataFrame, profile: int = PROFILE) -> dict[str, list[int]]:
    """By language, the packed n-grams of its profile in rank order. The result is bounded: profile rows a language."""
    counts = training.where("lang is not null and text is not null").select("text", "lang").mapInArrow(_counter, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= profile).collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return found


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs."""
    langs = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    ranks = np.full((len(known) + 1, len(langs)), -1, np.int32)
    for j, lang in enumerate(langs):
        ranks[np.searchsorted(known, profiles[lang]), j] = np.arange(len(profiles[lang]))
    shared = docs.sparkSession.sparkContext.broadcast((langs, known, ranks))

    def job(batches):
        langs, known, ranks = shared.value
        for piece in pieces(batches):
            codes, docs_of, has = gram_codes(piece.column("text"))
            cuts = [np.searchsorted(d, np.arange(piece.num_rows + 1)) for d in docs_of]
            pred, score = [], []
            for d in range(piece.num_rows):
                if not has[d] or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                grams, n = np.unique(np.concatenate([c[x[d] : x[d + 1]] for c, x in zip(codes, cuts)]), return_counts=True)
                grams = grams[np.argsort(-n, kind="stable")[:profile]]
                at = np.searchsorted(known, grams)
                at[at == len(known)] = 0
                at = np.where(known[at] == grams, at, len(known))
                own = ranks[at]
                away = np.where(own < 0, profile, np.abs(own - np.arange(len(grams))[:, None])).sum(axis=0)
                best = int(np.argmin(away))
                rest = np.delete(away, best)
                pred.append(langs[best])
                score.append(float((rest.min() - away[best]) / rest.min()) if len(rest) and rest.min() > 0 else float(not len(rest)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(job, "doc_id long, lang_pred string, score double")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = split_of("doc_id", 4) == 2
    profiles = learn(docs.where(~F.coalesce(held_out, F.lit(False))))
    return predict(docs, profiles).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
