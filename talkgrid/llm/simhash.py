"""SimHash near-duplicates through covering locality-sensitive hashing.

A fingerprint has 64 bits: A-Z lower-cased, words cut at ASCII white space, XXH64 (seed 42) of every
3-word shingle; a bit is 1 if over half of the shingles have it. For radius r there are 2^(r+1) - 1
masks: bit i is labelled with a vector in {0,1}^(r+1), and mask v keeps the bits whose label has an odd
inner product with v. Any r labels are orthogonal to some v, so two fingerprints within r differing
bits agree wholly under that mask: no pair is missed. Equal fingerprints are one class from the start;
a bucket above BUCKET_ROWS is dealt in blocks, each pair of blocks a group of its own; groups emit a
forest, never all pairs.

Edges: null, empty and wordless texts have fingerprint zero and link like any other; fewer than 3
words make one shingle; repeated rows share a class; rows without doc_id link with equal fingerprints
only, and have no component unless one of these has an id; an empty table gives no rows; further columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.components import components, unite
from talkgrid.llm.tables import cut, packed, table, unpacked
from talkgrid.llm.textbytes import SPACE_WORDS, Words, pieces

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
#: Distinct fingerprints of one bucket that are compared in one group.
BUCKET_ROWS = 2000


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words each followed by one space: bytes, starts and ends."""
    size = words.ends - words.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    total = int(size.sum())
    shift = np.repeat(np.cumsum(size) - size, size)
    inside = np.arange(total) - shift
    out[np.repeat(starts, size) + inside] = words.buf[np.repeat(words.starts, size) + inside]
    return out, starts, ends


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    words = Words(column, SPACE_WORDS, lower=True)
    buf, starts, ends = spaced(words)
    data, hashed = buf.tobytes(), xxhash.xxh64_intdigest
    out = np.zeros(len(words.first) - 1, np.uint64)
    for d in range(len(out)):
        a, b = int(words.first[d]), int(words.first[d + 1])
        if a == b:
            continue
        n = max(1, b - a - shingle + 1)
        s = starts[a : a + n].tolist()
        e = ends[b - n : b].tolist()
        h = np.fromiter((hashed(data[i:j], SEED) for i, j in zip(s, e)), np.uint64, n)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE, name: str = "fp") -> DataFrame:
    """docs with the fingerprint in a column of the given name; one of that name is replaced."""
    docs = docs.drop(name)
    names = docs.columns

    def job(batches):
        for piece in pieces(batches):
            prints = fingerprints_of(piece.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array(prints)], names=[*names, name])

    return docs.mapInArrow(job, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return fingerprinted(docs.select("doc_id", "text"), shingle).drop("text")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks as signed 64-bit numbers."""
    vectors = (1 << (radius + 1)) - 1
    labels = [i % vectors + 1 for i in range(bits)]
    made = [sum(1 << i for i in range(bits) if (labels[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in made]


def linked(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges among rows sorted by key: rows of one key within the radius are joined."""
    n = len(key)
    fp = fp.view(np.uint64)  # of signed numbers, the bits of the absolute value would be counted
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    end = np.repeat(np.append(np.flatnonzero(new)[1:], n), np.diff(np.append(np.flatnonzero(new), n)))
    parent, rows, d = np.arange(n), np.arange(n), 1
    while True:
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        near = np.bitwise_count(fp[rows] ^ fp[rows + d]) <= radius
        if near.any():
            parent = unite(parent, rows[near], rows[near] + d)
        d += 1
    child = np.flatnonzero(parent != np.arange(n))
    return node[child], node[parent[child]]


def _bucket_edges(radius: int):
    def job(batches):
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        made: list = []
        for batch in batches:
            rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "fp", "node"))]
            last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
            held = [r[last:] for r in rows]
            made.append(linked(*[r[:last] for r in rows], radius))
            a, b = made.pop()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        a, b = linked(*held, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return job


def link_edges(classes: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Forest edges (a, b) between the nodes of distinct fingerprints (fp, node) within the radius."""
    keyed = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(masks(radius))])
    rows = classes.select("fp", "node", F.explode(keyed).alias("key"))
    hot = cut(rows.groupBy("key").count().where(F.col("count") > bucket_rows).select("key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("blocks")))
    rows = rows.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    pair = lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j))
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
    rows = rows.select("fp", "node", F.explode(keys).alias("key"))
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.select("key", "fp", "node").mapInArrow(_bucket_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """For each row of docs: doc_id, fp (signed) and component_id."""
    prints = cut(fingerprints(docs, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(link_edges(classes.where("node IS NOT NULL"), radius))
    named = cut(classes.join(found, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id")))
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of every group of near-duplicates, that of its smallest doc_id. Texts move once, by their own
    doc_id, so a group of any size is spread."""
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    found = near_duplicates(docs, shingle, radius)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("_key"), F.col("fp").alias("_fp")).distinct()
    rows = fingerprinted(packed(docs, "doc_id", "text"), shingle, "_fp").withColumn("_key", key)
    return unpacked(rows.join(cut(stay), ["_key", "_fp"], "left_semi").dropDuplicates(["_key", "_fp"]), docs.columns, ("doc_id", "text"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
