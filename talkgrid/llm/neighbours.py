"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

Vectors get one more component that brings all of one length to the norm of the longest; queries get a zero. The squared distance of a
query is then a constant less twice the inner product. Both halves of a vector are quantised apart, each by CODES centroids fitted
on a bounded sample, and a pair of centroids is a cell. A query visits cells by the sum of its distances to the two centroids, smallest
first, from a heap, until they hold enough vectors; every vector of those cells is scored exactly.

How many vectors are enough is measured: CHECKED queries of each length (those with the smallest hashes) are compared with all vectors, and
the budget is the number that would have reached the cells of RECALL of their true neighbours. On vectors that are alike in all directions
that is a large share of the table; with structure it is small.

Cells of one first centroid are a shelf. A query goes once to a shelf, with its cells there as the bits of a number; the vectors of a
shelf are dealt in chunks of CHUNK, queries in blocks of ASKED, so no group grows with the table. Equal vectors are one class.

Edges: vectors that are null, zero or hold null or non-finite components and rows without an id take no part; vectors of different lengths aren't
compared; lengths with fewer than SMALL different vectors are searched whole; rows of one id and vector are one; rows with the query's
id are not its neighbours; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrid.llm.equalvectors import best, by_width, classes, listed, rows_of, sound
from talkgrid.llm.tables import cut, release, table

TOP, EVERY = 20, 20
#: Centroids of each half; the bits of a long hold the cells of a shelf, so at most 63.
CODES = 32
#: Vectors of each length that centroids are fitted on, and numbers in them.
SAMPLE, SAMPLE_NUMBERS = 16_384, 2_000_000
#: Queries of each length that the budget is measured with, and the share of their neighbours that it must reach.
CHECKED, RECALL = 128, 0.97
#: Different vectors of one length from which on they are indexed.
SMALL = 256
CHUNK, ASKED = 8192, 4096
#: Room for rounding when products of a block are compared.
SLACK = 1e-9


class Index:
    """Of the vectors of one length: their largest norm, centroids of both halves, vectors in each cell, and the budget of a query."""

    def __init__(self, width: int, count: int, norm: float, sample: np.ndarray, codes: int):
        self.width, self.count, self.norm, self.budget, self.half = width, count, norm, count, width // 2
        self.cells = np.full((1, 1), count)
        x = self.lifted(sample) if len(sample) else np.zeros((1, width + 1))
        k = min(codes, max(1, len(sample) // 8))
        self.centroids = [_centroids(x[:, : self.half], k), _centroids(x[:, self.half :], k)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the centroids of both halves, for queries of norm one: their order doesn't depend on it."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = np.hstack([x / np.sqrt((x * x).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))])
        return [_distances(x[:, : self.half], self.centroids[0]), _distances(x[:, self.half :], self.centroids[1])]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.lifted(x)
        return _distances(x[:, : self.half], self.centroids[0]).argmin(axis=1), _distances(x[:, self.half :], self.centroids[1]).argmin(axis=1)

    def visits(self, first: np.ndarray, second: np.ndarray) -> dict[int, int]:
        """Cells of one query, by the sum of two distances, until they hold the budget: the bits of second centroids by first one."""
        a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
        x, y = first[a].tolist(), second[b].tolist()
        heap, reached, found, held = [(x[0] + y[0], 0, 0)], [0] * len(a), {}, 0
        while heap and held < self.budget:
            _, i, j = heapq.heappop(heap)
            if many := self.cells[a[i], b[j]]:
                held += int(many)
                found[a[i]] = found.get(a[i], 0) | 1 << b[j]
            reached[i] = j + 1
            if i + 1 < len(a) and reached[i + 1] == j:  # the cell to the left in the next row is done
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):  # and so is the one above
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        return found


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1))


def _centroids(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; a centroid that loses all rows keeps its place."""
    c = x[np.arange(k) * len(x) // k].copy()
    for _ in range(rounds):
        own = _distances(x, c).argmin(axis=1)
        many = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[many > 0] = sums[many > 0] / many[many > 0, None]
    return c


def _first_by_hash(rows: DataFrame, limit: F.Column) -> DataFrame:
    w = Window.partitionBy("width").orderBy(F.xxhash64("embedding"), "class")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def indexes(found: DataFrame, codes: int, small: int) -> dict[int, Index]:
    """An index for each length of the vectors, without cells and budgets yet. To the driver go a row for each length and the samples."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    stats = found.groupBy("width").agg(F.count("*").alias("n"), F.max(F.least(norm, F.lit(1e308))).alias("norm")).collect()
    fitted = [r["width"] for r in stats if r["n"] >= small]
    limit = F.least(F.lit(SAMPLE), F.greatest(F.lit(small), F.lit(SAMPLE_NUMBERS) / F.col("width")))
    samples = {w: rows_of(part.column("embedding")) for part in _first_by_hash(found.where(F.col("width").isin(fitted)), limit).select("embedding").toArrow().combine_chunks().to_batches() for w, part in by_width(part)}
    return {r["width"]: Index(r["width"], r["n"], r["norm"], samples.get(r["width"], np.zeros((0, r["width"]))), codes) for r in stats}


def _placed(shared):
    def job(batches):
        for batch in batches:
            for width, part in by_width(batch):
                first, second = shared.value[width].codes(rows_of(part.column("embedding")))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("class", "ids", "embedding", "width")], pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))], names=["class", "ids", "embedding", "width", "first", "second"])

    return job


def _truth(shared, top: int):
    """The top classes of a batch for each checked query, with their cells."""

    def job(batches):
        for batch in batches:
            for width, part in by_width(batch):
                if width not in shared.value:
                    continue
                own, queries = shared.value[width]
                node = part.column("class").to_numpy()
                score = queries @ rows_of(part.column("embedding")).T
                score[own[:, None] == node[None, :]] = -np.inf
                at = np.argpartition(-score, min(top, len(node)) - 1, axis=1)[:, :top]
                q = np.repeat(np.arange(len(own)), at.shape[1])
                at = at.ravel()
                s = score[q, at]
                keep = pa.array(s > -np.inf)
                taken = part.take(pa.array(at))
                out = pa.RecordBatch.from_arrays([taken.column("width"), pa.array(q.astype(np.int32)), pa.array(s), *[taken.column(c) for c in ("class", "first", "second")]], names=["width", "q", "score", "class", "first", "second"])
                yield out.filter(keep)

    return job


def _measure(placed: DataFrame, asking: DataFrame, found: dict[int, Index], top: int, checked: int, recall: float) -> None:
    """Fill in the cells and budgets."""
    spark = placed.sparkSession
    for index in found.values():
        index.cells = np.zeros((len(index.centroids[0]), len(index.centroids[1])), np.int64)
    for r in placed.groupBy("width", "first", "second").count().collect():  # CODES squared rows a length at most
        found[r["width"]].cells[r["first"], r["second"]] = r["count"]
    wide = [w for w, index in found.items() if index.cells.size > 1]
    queries = {}
    for part in _first_by_hash(asking.where(F.col("width").isin(wide)), F.lit(checked)).select("class", "embedding").toArrow().combine_chunks().to_batches():
        for width, rows in by_width(part):
            queries[width] = (rows.column("class").to_numpy(), rows_of(rows.column("embedding")))
    if not queries:
        return
    shared = spark.sparkContext.broadcast(queries)
    w = Window.partitionBy("width", "q").orderBy(F.desc("score"), "class")
    truth = placed.mapInArrow(_truth(shared, top), "width int, q int, score double, class long, first int, second int").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    cells: dict[int, list] = {}
    for r in truth.select("width", "q", "first", "second").collect():  # CHECKED times TOP rows a length
        cells.setdefault(r["width"], []).append((r["q"], r["first"], r["second"]))
    for width, own in cells.items():
        index = found[width]
        a, b = index.asked(queries[width][1])
        order = np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(a), -1), axis=1, kind="stable")
        held = np.zeros(order.shape, np.int64)
        np.put_along_axis(held, order, index.cells.ravel()[order].cumsum(axis=1), axis=1)
        q, first, second = np.array(own).T
        needed = np.sort(held[q, first * index.cells.shape[1] + second])
        index.budget = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def _visited(shared):
    def job(batches):
        for batch in batches:
            for width, part in by_width(batch):
                index = shared.value[width]
                a, b = index.asked(rows_of(part.column("embedding")))
                row, shelf, bits = [], [], []
                for k in range(part.num_rows):
                    visited = index.visits(a[k], b[k])
                    row += [k] * len(visited)
                    shelf += visited.keys()
                    bits += visited.values()
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(at) for c in ("class", "embedding", "width")], pa.array(shelf, pa.int32()), pa.array(bits, pa.int64())], names=["class", "embedding", "width", "first", "cells"])

    return job


def _scored(top: int, step: int = 256):
    """A chunk of a shelf and a block of its queries to the first top of each query: class, vec_id, score."""

    def job(entries: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"class": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not (entries.num_rows and queries.num_rows):
            return empty
        x, q = rows_of(entries.column("embedding")), rows_of(queries.column("embedding"))
        second, cells = entries.column("second").to_numpy(), queries.column("cells").to_numpy()
        ids = entries.column("ids").combine_chunks()
        room = SLACK * np.sqrt((x * x).sum(axis=1).max())
        out = []
        for a in range(0, len(q), step):
            part = q[a : a + step]
            score = part @ x.T
            score[(cells[a : a + step, None] >> second[None, :]) & 1 == 0] = -np.inf
            k = min(top, len(x))
            least = np.partition(score, len(x) - k, axis=1)[:, len(x) - k] - room * np.sqrt((part * part).sum(axis=1))
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            exact = np.concatenate([np.cumsum(part[i[c : c + 65_536]] * x[j[c : c + 65_536]], axis=1)[:, -1] for c in range(0, len(i), 65_536)] or [np.zeros(0)])
            out.append(best(i + a, exact, ids.take(pa.array(j)), top))
        query, score, each = (np.concatenate(v) for v in zip(*out))
        return pa.table({"class": queries.column("class").combine_chunks().take(pa.array(query)), "vec_id": pa.array(each), "score": pa.array(score)})

    return job


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, codes: int = CODES, small: int = SMALL, chunk: int = CHUNK, asked: int = ASKED, checked: int = CHECKED, recall: float = RECALL) -> DataFrame:
    """For each row of vectors (vec_id, embedding) whose id is divisible by every, its top neighbours: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    exact = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding") if exact else F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null").where(sound("embedding") & F.exists("embedding", lambda v: v != 0))
    found = classes(rows, top + 1, "embedding").withColumn("width", F.size("embedding"))
    queries = cut(rows.where(F.col("vec_id") % every == 0).join(found.select("class", F.col("embedding").alias("_v")), F.col("embedding") == F.col("_v")).select(F.col("vec_id").alias("query_id"), F.col("class")).distinct())
    index = indexes(found, codes, small)
    shared = spark.sparkContext.broadcast(index)
    vector = rows.schema["embedding"].dataType.simpleString()
    placed = cut(found.mapInArrow(_placed(shared), f"class long, ids array<long>, embedding {vector}, width int, first int, second int"))
    asking = cut(found.join(queries.select("class").distinct(), "class", "left_semi"))
    _measure(placed, asking, index, top, checked, recall)
    shared = spark.sparkContext.broadcast(index)

    # A row a shelf: into how many chunks its vectors, and into how many blocks the queries of that length are dealt.
    many = {r["width"]: r["count"] for r in asking.groupBy("width").count().collect()}
    shelves = spark.createDataFrame([(w, k, -(-int(n) // chunk), -(-many.get(w, 0) // asked)) for w, i in index.items() for k, n in enumerate(i.cells.sum(axis=1).tolist())], "width int, first int, chunks int, blocks int")
    dealt = lambda key, n: F.pmod(F.xxhash64(key, F.lit(7)), n).cast("int")
    numbers = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    key = ["width", "first", "part", "block"]
    entries = placed.join(shelves, ["width", "first"]).withColumn("part", dealt("class", F.col("chunks"))).withColumn("block", numbers(F.col("blocks"))).select(*key, "second", "ids", "embedding")
    visits = asking.mapInArrow(_visited(shared), f"class long, embedding {vector}, width int, first int, cells long")
    visits = visits.join(shelves, ["width", "first"]).withColumn("part", numbers(F.col("chunks"))).withColumn("block", dealt("class", F.col("blocks"))).select(*key, "class", "embedding", "cells")
    scored = entries.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_scored(top + 1), "class long, vec_id long, score double")
    w = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    first = scored.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top + 1)
    lists = cut(first.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("near")))
    release(placed, asking, found)
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    out = queries.join(lists, "class").select("query_id", F.posexplode(others).alias("rank", "near"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("near.vec_id").alias("vec_id"), F.col("near.score").alias("score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
