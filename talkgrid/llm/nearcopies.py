"""Near copies of documents: Jaccard similarity SIMILARITY or more of their sets of 5-word shingles, checked exactly.

Words are cut and lower-cased as for SimHash. Candidates come from covering masks as there, but over the coordinates of
a min-wise sketch: two texts of similarity J agree in a coordinate with probability J, and at 0.8 the bits of a SimHash
would differ in about 10 of 64 places, for which radius 10 and 2047 masks were needed. Each of SETS groups of 7
coordinates has 7 masks of 4 coordinates; a pair that differs in 2 coordinates of a group at most meets for sure. Pairs that
meet and agree in AGREE of all coordinates are linked to candidate groups; inside a group all pairs not yet
joined are compared by their whole sets. Equal sets are one class from the start; large buckets and groups are dealt in
blocks, each pair of blocks a group of its own.

A page frame or licence that many texts share makes one group of them all, though no two need be near copies. So before any text of a group of
more weight than GROUP moves, its members must meet again: sets of n shingles that are similar share one of the n - ceil(0.8 n) + 1 rarest of
either (by counts of BUCKETS buckets over these members, a table of fixed size), and what a frame alone has in common is not among these. Only
members that share such a shingle and agree in AGREE coordinates stay linked. Groups are weighed by rows and shingles, so that long texts are dealt to more blocks.

The stage has SimHash's masks, covering all places of a sketch that may differ, but not its fingerprint of 64 bits.

Edges: fewer than 5 words make one shingle; texts without words are one class; repeated rows share a class; rows without
doc_id link with equal sets only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.components import components, roots, unite
from talkgrid.llm.linededup import BUCKETS, COUNTS, NO_PLACE, token_counts
from talkgrid.llm.simhash import masks
from talkgrid.llm.tables import cut, packed, unpacked, written
from talkgrid.llm.textbytes import SPACE_WORDS, Words, mix, pieces, span_hashes, window_hashes

SHINGLE = 5
#: Similarity as a fraction of whole numbers, so that the check is exact.
SIMILARITY = (4, 5)
SETS, RADIUS, COORDINATES = 4, 2, 7
#: Coordinates of the 28 that candidates agree in; at similarity 0.8 the mean is 22.4.
AGREE = 14
#: Texts of one bucket that are compared in one group, and the weight of texts of one candidate group: 1 for each, and 1 for so many shingles.
BUCKET_ROWS = 2000
GROUP = 1000
SHINGLES = 1000

_ALL = SETS * COORDINATES
_FACTORS = mix(np.arange(1, _ALL + 1, dtype=np.uint64)) | np.uint64(1)
_WEIGHTS = mix(np.arange(1001, 1001 + _ALL, dtype=np.uint64)) | np.uint64(1)
_MASKS = [[g * COORDINATES + i for i in range(COORDINATES) if m >> i & 1] for g in range(SETS) for m in masks(RADIUS, COORDINATES)]
SKETCH = tuple(f"s{i}" for i in range(SETS))


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles, sorted, and where each text's begin (one more entry than texts)."""
    words = Words(column, SPACE_WORDS, lower=True)
    hashes, count = words.hashes(), words.counts()
    starts, long = window_hashes(hashes, words.first, shingle)
    few = np.flatnonzero((count > 0) & (count < shingle))
    short = span_hashes(hashes, words.first[few], words.first[few + 1], second=True)
    doc, h = np.concatenate([words.doc[starts], few]), np.concatenate([long, short])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def digests(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for each set; 0 for the empty one."""
    return span_hashes(h, first[:-1], first[1:], second=True).view(np.int64)


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The min-wise coordinates of each set; zeros for an empty one."""
    out = np.zeros((len(first) - 1, _ALL), np.uint64)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        for c in range(_ALL):
            out[full, c] = np.minimum.reduceat(h * _FACTORS[c], first[full])
    return out


def bucket_keys(sketch: np.ndarray) -> np.ndarray:
    """A key for each text and mask."""
    mixed = mix(sketch) * _WEIGHTS
    tables = np.arange(1, len(_MASKS) + 1, dtype=np.uint64)
    return mix(np.stack([mixed[:, m].sum(axis=1, dtype=np.uint64) for m in _MASKS], axis=1) + tables).view(np.int64)


def short_sketch(sketch: np.ndarray) -> np.ndarray:
    """A byte of each coordinate, 7 to a signed number."""
    out = np.zeros((len(sketch), SETS, 8), np.uint8)
    out[:, :, :COORDINATES] = (sketch & np.uint64(255)).astype(np.uint8).reshape(-1, SETS, COORDINATES)
    return out.view(np.int64)[:, :, 0]


def _prints(batches):
    for piece in pieces(batches):
        h, first = shingle_sets(piece.column("text"))
        sketch = sketches(h, first)
        keys, bytes_ = bucket_keys(sketch), short_sketch(sketch)
        offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(digests(h, first)), pa.array(np.diff(first)), *[pa.array(bytes_[:, i].copy()) for i in range(SETS)], lists], names=["doc_id", "fp", "size", *SKETCH, "keys"])


def _with_digest(docs: DataFrame, name: str) -> DataFrame:
    names = docs.columns

    def job(batches):
        for piece in pieces(batches):
            found = digests(*shingle_sets(piece.column("text")))
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], pa.array(found)], names=[*names, name])

    return docs.mapInArrow(job, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def in_blocks(rows: DataFrame, limit: int, weight: str | None = None) -> DataFrame:
    """rows (key, node, ...) with a key above limit rows, or weight, dealt in blocks: each pair of blocks has a key of its own."""
    held = F.sum(weight) if weight else F.count("*")
    hot = cut(rows.groupBy("key").agg(held.alias("held")).where(F.col("held") > limit).select("key", F.ceil(F.col("held") / limit).cast("int").alias("blocks")))
    rows = rows.join(hot, "key", "left")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    pair = lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j))
    keys = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))
    return rows.withColumn("key", F.explode(keys)).drop("blocks")


def _linked(sketch: np.ndarray, unused: int) -> np.ndarray:
    """Of one large group the first row that each row is linked with, over any number of links: what is linked already isn't compared again."""
    first, rest = np.arange(len(sketch)), np.arange(len(sketch))
    while len(rest):
        lead, rest, todo = rest[0], rest[1:], [rest[0]]
        while todo and len(rest):
            near = (sketch[rest] == sketch[todo.pop()]).sum(axis=1) - unused >= AGREE
            if near.any():
                first[rest[near]] = lead
                todo += rest[near].tolist()
                rest = rest[~near]
    return first


def agreeing(key: np.ndarray, sketch: np.ndarray, node: np.ndarray, large: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges among rows sorted by key: rows of one key that agree in AGREE coordinates are joined."""
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, n))
    end = np.repeat(begins + sizes, sizes)
    unused = sketch.shape[1] - _ALL
    parent = np.arange(n)
    for a, many in zip(begins[sizes > large].tolist(), sizes[sizes > large].tolist()):
        parent[a : a + many] = a + _linked(sketch[a : a + many], unused)
    rows, d = np.flatnonzero(np.repeat(sizes <= large, sizes)), 1
    while True:
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        near = (sketch[rows] == sketch[rows + d]).sum(axis=1) - unused >= AGREE
        if near.any():
            parent = unite(parent, rows[near], rows[near] + d)
        d += 1
    child = np.flatnonzero(parent != np.arange(n))
    return node[child], node[parent[child]]


def _candidates(batches):
    def edges(rows):
        sketch = np.stack(rows[2:], axis=1).view(np.uint8)
        a, b = agreeing(rows[0], sketch, rows[1])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[np.ndarray] = [np.zeros(0, np.int64)] * (2 + SETS)
    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "node", *SKETCH))]
        last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        held = [r[last:] for r in rows]
        yield from edges([r[:last] for r in rows])
    yield from edges(held)


def similar(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The roots of texts joined by pairs of SIMILARITY or more."""
    size = np.diff(first)
    n = len(size)
    owner, parent = np.repeat(np.arange(n), size), np.arange(n)
    p, q = SIMILARITY
    for x in range(n - 1):
        other = parent != parent[x]
        other[: x + 1] = False
        other &= q * np.minimum(size, size[x]) >= p * np.maximum(size, size[x])
        if not other.any():
            continue
        inside = other[owner]
        own = h[first[x] : first[x + 1]]
        values, at = h[inside], owner[inside]
        common = np.bincount(at[own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values], minlength=n)
        y = np.flatnonzero(other & (q * common >= p * (size + size[x] - common)))
        parent = unite(parent, np.full(len(y), x), y)
    return roots(parent)


def _verified(group: pa.Table) -> pa.Table:
    hashes, bounds, node, fp = [], [np.zeros(1, np.int64)], [], []
    for piece in pieces(group.combine_chunks().to_batches()):
        h, first = shingle_sets(piece.column("text"))
        hashes.append(h)
        bounds.append(first[1:] + bounds[-1][-1])
        node.append(piece.column("node").to_numpy())
        # A doc_id may stand for several texts: only the class's own counts, and of repeated rows one.
        fp.append(np.where(digests(h, first) == piece.column("fp").to_numpy(), piece.column("fp").to_numpy(), 0))
    h, first, node, fp = np.concatenate(hashes), np.concatenate(bounds), np.concatenate(node), np.concatenate(fp)
    rows = np.unique(fp, return_index=True)[1]
    rows = rows[fp[rows] != 0]
    size = np.diff(first)[rows]
    own = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    h = h[np.repeat(first[rows] - own[:-1], size) + np.arange(own[-1])]
    node, parent = node[rows], similar(h, own)
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return pa.table({"a": pa.array(node[child], pa.int64()), "b": pa.array(node[parent[child]], pa.int64())})


def _own_sets(batches):
    """(node, fp, text) to the sets of the texts that are the class's own: node, hashes, where each set's begin."""
    for piece in pieces(batches):
        h, first = shingle_sets(piece.column("text"))
        own = digests(h, first) == piece.column("fp").to_numpy()
        size = np.where(own, np.diff(first), 0)
        yield piece.column("node").to_numpy(), h[np.repeat(own, np.diff(first))], np.concatenate([[0], np.cumsum(size)])


def _counted(buckets: int):
    def job(batches):
        total = np.zeros(buckets, np.int64)
        for _, h, _ in _own_sets(batches):
            total += np.bincount((h & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        blocks = np.minimum(total, NO_PLACE).astype(np.int32).reshape(-1, COUNTS)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([blocks[k].tobytes() for k in used], pa.binary())], names=["block", "counts"])

    return job


def _rarest(shared):
    """The rarest shingles of each set, of which it shares one with every similar set, with its sketch."""
    p, q = SIMILARITY

    def job(batches):
        for node, h, first in _own_sets(batches):
            size = np.diff(first)
            own = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, shared.value[(h & np.uint64(len(shared.value) - 1)).astype(np.int64)], own))
            place = np.arange(len(h)) - first[own]
            chosen = order[place < (size - (p * size + q - 1) // q + 1)[own]]
            bytes_ = short_sketch(sketches(h, first))
            yield pa.RecordBatch.from_arrays([pa.array(h[chosen].view(np.int64)), pa.array(node[own[chosen]]), *[pa.array(bytes_[own[chosen], i].copy()) for i in range(SETS)]], names=["key", "node", *SKETCH])

    return job


def _linked_again(members: DataFrame, texts: DataFrame, bucket_rows: int, buckets: int = BUCKETS) -> DataFrame:
    """members (key, node, fp, size) of large groups with the groups that are left of these when two must share a rare shingle."""
    rows = texts.join(members.select("node", "fp"), "node").select("node", "fp", "text")
    counts = token_counts(rows.mapInArrow(_counted(buckets), "block int, counts binary"), buckets)
    shared = members.sparkSession.sparkContext.broadcast(counts)
    keys = rows.mapInArrow(_rarest(shared), f"key long, node long, {', '.join(f'{s} long' for s in SKETCH)}")
    keys = in_blocks(written(keys), bucket_rows).repartition("key").sortWithinPartitions("key")
    near = components(keys.select("key", "node", *SKETCH).mapInArrow(_candidates, "a long, b long"))
    return members.drop("key").join(near, "node").select(F.col("component").alias("key"), "node", "fp", "size")


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, group: int = GROUP) -> DataFrame:
    """For each row of docs: doc_id, fp (of its set of shingles) and component_id."""
    texts = docs.select("doc_id", "text")
    prints = cut(texts.mapInArrow(_prints, f"doc_id long, fp long, size long, {', '.join(f'{s} long' for s in SKETCH)}, keys array<long>"))
    one = [F.first(c).alias(c) for c in ("size", *SKETCH, "keys")]
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node"), *one))
    rows = classes.where("node IS NOT NULL AND fp <> 0").select("node", *SKETCH, F.explode("keys").alias("key"))
    rows = in_blocks(rows, bucket_rows).repartition("key").sortWithinPartitions("key")
    near = components(rows.select("key", "node", *SKETCH).mapInArrow(_candidates, "a long, b long"))
    members = cut(classes.where("fp <> 0").select("fp", "node", "size").join(near, "node").select(F.col("component").alias("key"), "node", "fp", "size"))
    texts = texts.withColumnRenamed("doc_id", "node")
    weight = 1 + F.col("size") / SHINGLES
    large = cut(members.groupBy("key").agg(F.sum(weight).alias("w")).where(F.col("w") > group).select("key"))
    if not large.isEmpty():
        again = _linked_again(cut(members.join(large, "key", "left_semi")), texts, bucket_rows)
        members = cut(members.join(large, "key", "left_anti").select("key", "node", "fp", "size").unionByName(again))
    members = in_blocks(members.withColumn("weight", weight), group, "weight")
    groups = texts.join(members, "node").select("key", "node", "fp", "text")
    found = components(groups.groupBy("key").applyInArrow(_verified, "a long, b long"))
    named = cut(classes.select("fp", "node").join(found, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id")))
    return prints.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of every group of near copies, that of its smallest doc_id."""
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    found = near_duplicates(docs)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(key.alias("_key"), F.col("fp").alias("_fp")).distinct()
    rows = _with_digest(packed(docs, "doc_id", "text"), "_fp").withColumn("_key", key)
    return unpacked(rows.join(cut(stay), ["_key", "_fp"], "left_semi").dropDuplicates(["_key", "_fp"]), docs.columns, ("doc_id", "text"))
