"""Quality by random indexing and a two-layer network with calibrated probabilities.

Every word (cut at ASCII white space) gives three tokens: its letters (A-Z lower-cased), its shape, the
kinds of its characters with repeats left out, and whether it repeats the word before. A token has an index vector of NONZERO signs in
DIMENSIONS places, both read from its hash. Its word vector is the mean of the index vectors of the
tokens of the words up to REACH away, over all documents; tokens share BUCKETS rows of one table of
whole-number sums, so its size is fixed and its sums don't depend on order. A document is the mean of its tokens'
word vectors. A network with HIDDEN tanh units is trained by Adam on at most about MAX_LABELLED
labelled documents, chosen by a hash of doc_id; a fifth of these is kept for fitting the temperature that
the logits are divided by.

Edges: null and empty texts have a zero vector and get a score like any other; without labels of both
kinds every score is the share of label 1, or 0.5 without any; null labels teach nothing; repeated rows
each get their score; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.tables import split_of, table
from talkgrid.llm.textbytes import LOWER, SPACE_WORDS, Words, mix, pieces, span_hashes

BUCKETS = 1 << 14
DIMENSIONS = 32
NONZERO = 2
REACH = 1
HIDDEN = 32
MAX_LABELLED = 20_000
STEPS = 400
RATE = 0.01
DECAY = 1e-4
SEED = 4
_ROWS = 64  # buckets of one block of the table

#: Byte kinds: upper, lower or non-ASCII, digit; other bytes stand for themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[0x41:0x5B] = 0x41
KIND[0x61:0x7B] = 0x61
KIND[0x80:] = 0x61
KIND[0x30:0x3A] = 0x30


def tokens(words: Words) -> np.ndarray:
    """Buckets of the letter, shape and repetition token of each word, as three columns."""
    kind = KIND[words.buf]
    start = np.zeros(len(kind) + 1, bool)
    start[words.starts] = True

    def hashed(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
        at = np.append(0, np.cumsum(keep))
        return span_hashes(values[keep], at[words.starts], at[words.ends])

    letters = hashed(LOWER[words.buf], kind >= 0x41)
    change = start[:-1].copy()
    if len(kind):
        change[1:] |= kind[1:] != kind[:-1]
    shapes = mix(hashed(kind, change) + np.uint64(1))
    again = np.zeros(len(letters), bool)
    again[1:] = (letters[1:] == letters[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = mix(again.astype(np.uint64) + np.uint64(7))
    return (np.stack([letters, shapes, repeats], axis=1) & np.uint64(BUCKETS - 1)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector, a row for each non-zero entry."""
    places, signs = [], []
    h = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64))
    for _ in range(NONZERO):
        places.append(((h >> np.uint64(1)) % np.uint64(DIMENSIONS)).astype(np.int64))
        signs.append(np.where(h & np.uint64(1), 1.0, -1.0))
        h = mix(h)
    return np.array(places), np.array(signs)


def _context(batches):
    """Texts to blocks of the table: for each bucket the sum of the index vectors around it, and its count."""
    places, signs = index_vectors()
    total, many = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)
    for piece in pieces(batches):
        words = Words(piece.column("text"), SPACE_WORDS)
        if not len(words.starts):
            continue
        own = tokens(words)
        base = [column * DIMENSIONS for column in own.T]
        around = [(place[column], sign[column]) for column in own.T for place, sign in zip(places, signs)]
        for d in range(1, REACH + 1):
            same = np.flatnonzero(words.doc[d:] == words.doc[:-d])
            for here, there in ((same, same + d), (same + d, same)):
                at = [b[here] for b in base]
                for place, sign in around:
                    p, w = place[there], sign[there]
                    for b in at:
                        total += np.bincount(b + p, w, len(total))
        for column in own.T:
            many += np.bincount(column, minlength=BUCKETS)
    table = np.hstack([total.reshape(BUCKETS, DIMENSIONS).astype(np.int64), many[:, None]])
    blocks = table.reshape(-1, _ROWS * (DIMENSIONS + 1))
    used = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([blocks[b].tobytes() for b in used], pa.binary())], names=["block", "sums"])


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
            own = np.frombuffer(sums.as_buffer(), np.int64)
            total[block] = total[block] + own if block in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word vector of each bucket; BUCKETS rows whatever the input."""
    parts = docs.select("text").mapInArrow(_context, "block long, sums binary")
    rows = parts.repartition("block").mapInArrow(_summed, "block long, sums binary").toArrow()
    out = np.zeros((BUCKETS // _ROWS, _ROWS * (DIMENSIONS + 1)), np.int64)
    for block, sums in zip(rows.column("block").to_pylist(), rows.column("sums").to_pylist()):
        out[block] = np.frombuffer(sums, np.int64)
    out = out.reshape(BUCKETS, DIMENSIONS + 1)
    return (out[:, :-1] / np.maximum(1, out[:, -1:])).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    words = Words(column, SPACE_WORDS)
    n = len(words.first) - 1
    total = np.zeros((n, vectors.shape[1]))
    own = tokens(words)
    for d in np.flatnonzero(words.counts()).tolist():
        part = own[words.first[d] : words.first[d + 1]]
        total[d] = vectors.take(part.reshape(-1), axis=0).sum(axis=0) / len(part)
    return total


class Network:
    """tanh layer and logit, inputs standardised, logits divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, keep: np.ndarray):
        """keep: rows for the temperature only."""
        random = np.random.default_rng(SEED)
        self.mean, self.scale = x[~keep].mean(axis=0), x[~keep].std(axis=0) + 1e-6
        z, t = self._standard(x[~keep]), y[~keep]
        d = z.shape[1]
        self.weights = [random.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), random.normal(0, HIDDEN**-0.5, HIDDEN), np.array([np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))])]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, STEPS + 1):
            w1, b1, w2, b2 = self.weights
            h = np.tanh(z @ w1 + b1)
            g = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - t) / len(t)
            back = np.outer(g, w2) * (1 - h * h)
            grads = [z.T @ back + DECAY * w1, back.sum(axis=0), h.T @ g + DECAY * w2, np.array([g.sum()])]
            for k, (w, grad) in enumerate(zip(self.weights, grads)):
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                self.weights[k] = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        if keep.any():
            logits, sign = self.logits(x[keep]), 2 * y[keep] - 1
            tried = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            self.temperature = float(tried[np.argmin([np.logaddexp(0, -sign * logits / t).mean() for t in tried])])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(self._standard(x) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _vectors(shared):
    def job(batches):
        for piece in pieces(batches):
            x = pooled(piece.column("text"), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([piece.column("y"), piece.column("keep"), lists], names=["y", "keep", "x"])

    return job


def learn(docs: DataFrame, labels: DataFrame, shared, max_labelled: int = MAX_LABELLED):
    """A model from training docs (doc_id, text), labels (doc_id, quality) and the broadcast word vectors."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    n = known.count()
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20))
    known = known.where(draw(SEED) < int((1 << 20) * min(1.0, max_labelled / max(1, n))))
    # About max_labelled rows at most, so small enough to broadcast.
    rows = docs.join(F.broadcast(known), "doc_id").select("text", F.col("y").cast("double").alias("y"), (draw(SEED + 1) < (1 << 20) // 5).alias("keep"))
    rows = rows.mapInArrow(_vectors(shared), "y double, keep boolean, x array<double>").toArrow()
    y, keep = rows.column("y").to_numpy(), rows.column("keep").to_numpy()
    if not len(y) or y[~keep].min(initial=1) == y[~keep].max(initial=0):
        return Constant(float(y.mean()) if len(y) else 0.5)
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    order = np.lexsort((*x.T[:4], y))  # the same order of rows in every run
    return Network(x[order], y[order], keep[order])


def score(docs: DataFrame, shared, model) -> DataFrame:
    """docs with a column score; one of that name is replaced."""
    docs = docs.drop("score")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches):
        for piece in pieces(batches):
            found = sent.value.scores(pooled(piece.column("text"), shared.value))
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array(found)], names=[*names, "score"])

    return docs.mapInArrow(job, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out() -> F.Column:
    return F.coalesce(split_of("doc_id", 3) == 1, F.lit(False))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    shared = spark.sparkContext.broadcast(word_vectors(docs))
    model = learn(docs.where(~held_out()), labels.where(~held_out()), shared)
    return score(docs, shared, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
