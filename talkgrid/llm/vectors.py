"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors of cosine c are sqrt(2 - 2c) apart, so cosine COSINE or more is a distance within epsilon.
Vectors are rotated to the principal axes of their first AXIS_WIDTH components, which lengthens no distance, and sorted by length and by the cells of a
grid of width epsilon on the leading axes. The sorted sequence is cut into intervals of BLOCK vectors, across partitions; pairs of
intervals whose bounding boxes are within epsilon are joined, by halving both and skipping halves whose
boxes are further apart. Leaves are screened by a single-precision product and decided in double
precision on the vectors as given. Equal vectors are one class and join once.

Edges: null vectors, zero vectors, those with null or non-finite components and those without an id link
with nothing (component: their own id); vectors of different lengths don't link; rows of one id are one
node; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm.components import components, unite
from talkgrid.llm.equalvectors import by_width, rows_of
from talkgrid.llm.tables import cut, partitions, release, table

COSINE = 0.95
#: Vectors of one interval, and of a leaf of the recursion.
BLOCK = 4096
LEAF = 256
#: Leading axes of the grid, and of these the ones that interval pairs are looked up by.
AXES = 8
LOOKUP = 2
#: Leading components that the axes are found in; a task's sums are of this number squared.
AXIS_WIDTH = 1024
#: Room for rounding in the screening and in the boxes.
SLACK = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes_of(classes: DataFrame, width: int) -> np.ndarray:
    """The principal axes of the first width components as columns, the leading first; sums of width squared numbers go to the driver."""

    def job(batches):
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            for _, rows in by_width(batch):
                x = unit(rows_of(rows.column("embedding")))[:, :width]
                at = np.r_[np.arange(x.shape[1]), width]
                x = np.hstack([x, np.ones((len(x), 1))])
                total[np.ix_(at, at)] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["i", "v"])

    summed = classes.select("embedding").mapInArrow(job, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((width + 1) ** 2)
    total[summed.column("i").to_numpy()] = summed.column("v").to_numpy()
    total = total.reshape(width + 1, width + 1)
    n = max(1.0, total[-1, -1])
    mean = total[-1, :-1] / n
    return np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))[1][:, ::-1]


def rotated(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors on the axes; components that a vector lacks are 0, those beyond the axes' width are left out."""
    width = min(u.shape[1], len(axes))
    return u[:, :width] @ axes[:width]


def placed_on(column: pa.Array, axes: np.ndarray) -> np.ndarray:
    """Vectors of any lengths on the axes, one length after the other."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), axes.shape[1]))
    for width in np.unique(sizes).tolist():
        own = sizes == width
        out[own] = rotated(unit(rows_of(column.filter(pa.array(own)))), axes)
    return out


def _cells(shared, epsilon: float):
    def job(batches):
        for batch in batches:
            cells = np.floor(placed_on(batch.column("embedding"), shared.value[:, :AXES]) / epsilon).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("many"), batch.column("embedding"), lists], names=["node", "many", "embedding", "cells"])

    return job


def _intervals(shared, offsets, block: int):
    """Rows in grid order to rows with the number of their interval, of block rows whatever the partitions are; the first row of a
    batch's part of an interval has that part's bounding box on the leading axes."""

    def job(batches):
        from pyspark import TaskContext

        at = offsets.value[TaskContext.get().partitionId()]
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                rows = batch.slice(a, block - at % block)
                n = rows.num_rows
                y = placed_on(rows.column("embedding"), shared.value[:, :AXES])
                box = [pa.array([b.tolist()] + [None] * (n - 1), pa.list_(pa.float64())) for b in (y.min(axis=0), y.max(axis=0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at // block)), *[rows.column(c) for c in ("node", "many", "embedding")], *box], names=["interval", "node", "many", "embedding", "lo", "hi"])
                a, at = a + n, at + n

    return job


def box_gap(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> float:
    """The squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
    return float(gap @ gap)


def near(x: np.ndarray, u: np.ndarray, y: np.ndarray, a: slice, b: slice, cosine: float):
    """Pairs (i, j) of rows of a and b, with i < j where they are the same rows, of the cosine or more. x: as given, u: unit, y: rotated."""
    stack = [(a.start, a.stop, b.start, b.stop)]
    most = (math.sqrt(2 - 2 * cosine) + SLACK) ** 2
    single = u.astype(np.float32)
    norm = lambda v: math.sqrt(math.fsum((v * v).tolist()))
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        if (a0, a1) != (b0, b1) and box_gap(y[a0:a1].min(axis=0), y[a0:a1].max(axis=0), y[b0:b1].min(axis=0), y[b0:b1].max(axis=0)) > most:
            continue
        if a1 - a0 > LEAF or b1 - b0 > LEAF:
            am, bm = (a0 + a1) // 2, (b0 + b1) // 2
            if (a0, a1) == (b0, b1):
                stack += [(a0, am, a0, am), (a0, am, am, a1), (am, a1, am, a1)]
            elif a1 - a0 >= b1 - b0:
                stack += [(a0, am, b0, b1), (am, a1, b0, b1)]
            else:
                stack += [(a0, a1, b0, bm), (a0, a1, bm, b1)]
            continue
        i, j = np.nonzero(single[a0:a1] @ single[b0:b1].T >= cosine - SLACK)
        i, j = i + a0, j + b0
        if (a0, a1) == (b0, b1):
            i, j = i[i < j], j[i < j]
        sure = np.einsum("ij,ij->i", u[i], u[j])
        close = np.flatnonzero(np.abs(sure - cosine) < 1e-12)
        for k in close.tolist():  # rounding could decide: sum exactly
            sure[k] = math.fsum((x[i[k]] * x[j[k]]).tolist()) / (norm(x[i[k]]) * norm(x[j[k]]))
        ok = sure >= cosine
        if ok.any():
            yield i[ok], j[ok]


FOUND = "node long, links long, other long"


def _join(shared, cosine: float):
    """One pair of intervals to links: (node, links) with the rows linked, and (node, other) forest edges."""

    def job(group: pa.Table) -> pa.Table:
        side = group.column("interval").to_numpy()
        sizes = group.column("embedding").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        order = np.lexsort((side, sizes))
        group, side, sizes = group.take(pa.array(order)), side[order], sizes[order]
        n, last = len(side), side.max()
        whole = side.min() == last
        many, node = group.column("many").to_numpy(), group.column("node").to_numpy()
        links, parent = np.zeros(n, np.int64), np.arange(n)
        begins = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]])
        for start, end in zip(begins.tolist(), [*begins[1:].tolist(), n]):  # vectors of one length
            split = int(np.searchsorted(side[start:end], last))
            if not whole and split in (0, end - start):
                continue
            x = rows_of(group.column("embedding").slice(start, end - start))
            u = unit(x)
            a, b = (slice(0, len(x)), slice(0, len(x))) if whole else (slice(0, split), slice(split, len(x)))
            for i, j in near(x, u, rotated(u, shared.value), a, b, cosine):
                i, j = i + start, j + start
                np.add.at(links, i, many[j])
                np.add.at(links, j, many[i])
                parent = unite(parent, i, j)
        has, child = np.flatnonzero(links), np.flatnonzero(parent != np.arange(n))
        return pa.table({"node": pa.array(np.concatenate([node[has], node[child]])), "links": pa.array(np.concatenate([links[has], np.zeros(len(child), np.int64)])), "other": pa.array(np.concatenate([node[has], node[parent[child]]]))})

    return job


def links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """For each row of vectors (vec_id, embedding): vec_id, n_links and component_id."""
    spark = vectors.sparkSession
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, F.col("embedding").cast("array<double>")).alias("embedding"))
    classes = cut(rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("many")))
    width = min(AXIS_WIDTH, classes.agg(F.max(F.size("embedding")).alias("w")).first()["w"] or 1)
    epsilon = math.sqrt(2 - 2 * cosine) + SLACK
    shared = spark.sparkContext.broadcast(axes_of(classes, width))
    cells = classes.mapInArrow(_cells(shared, epsilon), "node long, many long, embedding array<double>, cells array<int>")
    key = [F.size("embedding"), *[F.get("cells", F.lit(k)) for k in range(min(AXES, width))], F.col("node")]
    ordered = cut(cells.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key).select("node", "many", "embedding"))
    sizes = {r["p"]: r["count"] for r in ordered.groupBy(F.spark_partition_id().alias("p")).count().collect()}  # one number a partition
    begins = np.cumsum([0] + [sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])
    offsets = spark.sparkContext.broadcast([int(x) for x in begins])
    placed = cut(ordered.mapInArrow(_intervals(shared, offsets, block), "interval long, node long, many long, embedding array<double>, lo array<double>, hi array<double>"))
    release(ordered)

    leading = range(min(AXES, width))
    lengths = placed.groupBy("interval").agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most"))
    boxes = placed.where("lo is not null").groupBy("interval").agg(F.array(*[F.min(F.get("lo", F.lit(k))) for k in leading]).alias("lo"), F.array(*[F.max(F.get("hi", F.lit(k))) for k in leading]).alias("hi"))
    boxes = cut(boxes.join(lengths, "interval"))
    axes = range(min(LOOKUP, width))
    cell = lambda c, k: F.floor(F.get(c, F.lit(k)) / epsilon)

    def spread(name: str, margin: int) -> DataFrame:
        out = boxes.select(F.col("interval").alias(name), F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"), F.col("least").alias(f"{name}_least"), F.col("most").alias(f"{name}_most"), *[cell("lo", k).alias(f"f{k}") for k in axes], *[cell("hi", k).alias(f"t{k}") for k in axes])
        for k in axes:
            out = out.withColumn(f"c{k}", F.explode(F.sequence(F.col(f"f{k}") - margin, F.col(f"t{k}") + margin)))
        return out.drop(*[f"{x}{k}" for k in axes for x in "ft"])

    gaps = F.transform(F.sequence(F.lit(0), F.size("a_lo") - 1), lambda k: F.greatest(F.lit(0.0), F.get("a_lo", k) - F.get("b_hi", k), F.get("b_lo", k) - F.get("a_hi", k)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = spread("a", 0).join(spread("b", 1), [f"c{k}" for k in axes]).where("a <= b AND a_least <= b_most AND b_least <= a_most").where(apart <= epsilon * epsilon).select("a", "b").distinct()
    pairs = cut(pairs.unionByName(boxes.select(F.col("interval").alias("a"), F.col("interval").alias("b"))).distinct())
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("interval"))
    found = cut(placed.drop("lo", "hi").join(sides, "interval").groupBy("a", "b").applyInArrow(_join(shared, cosine), FOUND))

    release(placed, boxes, pairs)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    named = components(edges).withColumnRenamed("component", "component_id")
    named = classes.join(counted, "node", "left").join(named, "node", "left")
    named = named.select(F.col("embedding").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    out = rows.join(named, F.col("embedding") == F.col("_v"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT m.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, m.a = component_id AS kept FROM m LEFT JOIN n ON n.a = m.a
"""
