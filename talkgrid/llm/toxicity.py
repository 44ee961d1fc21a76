"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents; the unlabelled are drawn from all documents of the labels table, whose labels are then
hidden, so that the prior, the share of toxic ones among the labels, is that of the unlabelled too. Features
are a document's lower-cased words and word beginnings of PREFIXES bytes, hashed into BUCKETS: whether
one is there, and its rate, RATE_WORDS times its share of the words, 1 at most. Counts of documents that
have it, and that have it at a rate of a half or more, choose for both sets the FEATURES buckets, of those that LEAST documents
have, that tell them best apart; a logistic model on these minimises the class-prior-corrected risk
    prior * P[l(f)] + max(0, U[l(-f)] - prior * P[l(-f)]),
with l the logistic loss, so unlabelled toxic documents don't count as clean ones. Learning takes
about MAX_POSITIVE and MAX_UNLABELLED labelled rows at most, chosen by a hash of doc_id; scoring takes all documents.

Edges: null and empty texts get the model's intercept; without positives every score is 0; null
labels teach nothing; repeated rows each get their score; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm.tables import release, split_of, stored, table
from talkgrid.llm.textbytes import ALNUM_WORDS, Words, mix, pieces, span_hashes

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 768
LEAST = 3
#: Bytes of text handled at once; every word gives several features.
PIECE = 1 << 19
RATE_WORDS = 40.0
MAX_POSITIVE = 6000
MAX_UNLABELLED = 18000
THRESHOLD = 0.7
STEPS = 300
RATE = 0.05
DECAY = 1e-4


def feature_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (row numbers) and buckets of all features of a text column, repeats included, and each text's number of words."""
    words = Words(column, ALNUM_WORDS, lower=True)
    size = words.ends - words.starts
    docs, found = [words.doc], [words.hashes()]
    for n in PREFIXES:
        long = size > n
        docs.append(words.doc[long])
        found.append(mix(span_hashes(words.buf, words.starts[long], words.starts[long] + n) + np.uint64(n)))
    return np.concatenate(docs), (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64), words.counts()


def _values(docs: np.ndarray, buckets: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct buckets of each document, and the rate of each."""
    key, many = np.unique(docs * BUCKETS + buckets, return_counts=True)
    docs = key // BUCKETS
    return docs, key % BUCKETS, np.minimum(1.0, many * RATE_WORDS / np.maximum(1, n_words[docs]))


def _counter(batches):
    """Rows (positive, text) to how many documents of either kind have each feature, in blocks of buckets."""
    total = np.zeros((2, 2 * BUCKETS), np.int64)
    for piece in pieces(batches, limit=PIECE):
        docs, buckets, rate = _values(*feature_rows(piece.column("text")))
        kind = piece.column("positive").to_numpy(zero_copy_only=False).astype(np.int64)
        for d, b in ((docs, buckets), (docs[rate >= 0.5], buckets[rate >= 0.5] + BUCKETS)):
            total += np.bincount(kind[d] * 2 * BUCKETS + b, minlength=4 * BUCKETS).reshape(2, 2 * BUCKETS)
    used = np.flatnonzero(total.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[1, used]), pa.array(total[0, used])], names=["bucket", "pos", "unl"])


def _chosen(features: np.ndarray):
    """Rows (positive, text) to (positive, the numbers of the chosen buckets that the text has, their rates)."""

    def job(batches):
        number = np.full(BUCKETS, -1, np.int32)
        number[features] = np.arange(len(features))
        for piece in pieces(batches, limit=PIECE):
            docs, buckets, n_words = feature_rows(piece.column("text"))
            keep = number[buckets] >= 0
            docs, buckets, rate = _values(docs[keep], buckets[keep], n_words)
            cuts = pa.array(np.searchsorted(docs, np.arange(piece.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (number[buckets], rate.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([piece.column("positive"), *lists], names=["positive", "features", "rates"])

    return job


def nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model under the non-negative positive-unlabelled risk."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    k = int(positive.sum())
    xp, xu = (x[:k], x[k:]) if positive[:k].all() else (x[positive], x[~positive])  # without a copy where positives come first
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        v = w[:-1].astype(x.dtype)
        fp, fu = (xp @ v + w[-1]).astype(float), (xu @ v + w[-1]).astype(float)
        # Derivatives of l(f) = log(1 + e^-f) and of l(-f) by f:
        gp, gp_neg, gu_neg = sigmoid(fp) - 1, sigmoid(fp), sigmoid(fu)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:
            up, uu = prior * (gp - gp_neg) / len(fp), gu_neg / len(fu)
        else:  # over-fitted: take the negative part back up
            up, uu = prior * gp_neg / len(fp), -gu_neg / len(fu)
        grad = np.append((up.astype(x.dtype) @ xp).astype(float) + uu.astype(x.dtype) @ xu, up.sum() + uu.sum())
        grad[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, features: int = FEATURES, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray, float] | None:
    """The weights of every bucket (of its presence, and of its rate) and the intercept. docs (doc_id, text) and labels (doc_id, toxic) must be training rows only."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.count("*").alias("all"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    if not n["pos"]:
        return None
    prior = min(0.9, max(1e-3, n["pos"] / n["all"]))
    share = lambda most, of: F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / max(1, of)))
    kinds = F.concat(F.when((F.col("toxic") == 1) & share(max_positive, n["pos"]), F.array(F.lit(True))).otherwise(F.array()), F.when(share(max_unlabelled, n["all"]), F.array(F.lit(False))).otherwise(F.array()))
    ids = known.select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)  # about max_positive and max_unlabelled at most, so small enough to broadcast
    both = stored(docs.join(F.broadcast(ids), "doc_id").select(F.explode("kinds").alias("positive"), "text"))
    counts = both.mapInArrow(_counter, "bucket long, pos long, unl long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    sizes = both.groupBy("positive").count().collect()
    n_pos, n_unl = (next((r["count"] for r in sizes if r["positive"] is k), 0) for k in (True, False))
    if not n_pos or not n_unl:
        release(both)
        return None
    p, u = (F.col("pos") + 0.5) / (n_pos + 1), (F.col("unl") + 0.5) / (n_unl + 1)
    apart = (p - u) * (p - u) / (u * (1.0001 - u))
    best = counts.where(F.col("pos") + F.col("unl") >= LEAST).orderBy(apart.desc(), "bucket").limit(features).select("bucket").collect()
    chosen = np.unique(np.array([r["bucket"] for r in best], np.int64) % BUCKETS)
    rows = both.mapInArrow(_chosen(chosen), "positive boolean, features array<int>, rates array<float>").toArrow()
    release(both)
    positive = rows.column("positive").to_numpy()
    place = np.argsort(np.argsort(~positive, kind="stable"))  # positives first
    x = np.zeros((rows.num_rows, 2 * len(chosen)), np.float32)
    lists = rows.column("features").combine_chunks()
    row, feature = np.repeat(place, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    x[row, feature] = 1
    x[row, feature + len(chosen)] = rows.column("rates").combine_chunks().flatten().to_numpy()
    w, bias = nnpu(x, np.sort(positive)[::-1], prior)
    weights = np.zeros((2, BUCKETS))
    weights[:, chosen] = w.reshape(2, -1)
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """docs with a column score; one of that name is replaced."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def job(batches):
        weights, bias = shared.value
        for piece in pieces(batches, limit=PIECE):
            docs_of, buckets, n_words = feature_rows(piece.column("text"))
            keep = (weights[:, buckets] != 0).any(axis=0)
            d, b, rate = _values(docs_of[keep], buckets[keep], n_words)
            f = np.bincount(d, weights[0, b] + weights[1, b] * rate, piece.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array(1 / (1 + np.exp(-np.clip(f, -40, 40))))], names=[*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(job, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def held_out() -> F.Column:
    return F.coalesce(split_of("doc_id", 3) == 1, F.lit(False))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float] | None:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return learn(docs.select("doc_id", "text").where(~held_out()), labels.where(~held_out()))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
