"""Vectors as classes of equal ones, shared by the searches over vectors.

Of a class only its smallest ids can be among the first few of a ranking by score and then id, so a class keeps as many as are asked
for, however many rows it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.llm.tables import cut


def sound(column: str) -> F.Column:
    """Neither null nor with a null or non-finite component; vectors without components are sound."""
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def classes(rows: DataFrame, keep: int, *key: str) -> DataFrame:
    """rows (vec_id and the key) to one row a key: class, a number; the key; ids, the smallest ids, at most keep. Stored."""
    w = Window.partitionBy(*key).orderBy("vec_id")
    few = rows.select("vec_id", *key).withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= keep)
    grouped = few.groupBy(*key).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return cut(grouped.withColumn("class", F.monotonically_increasing_id()))


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def listed(x: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def by_width(batch: pa.RecordBatch, column: str = "embedding"):
    """Parts of a batch whose vectors have one length, with that length."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes).tolist():
        yield width, batch.filter(pa.array(sizes == width))


def best(query: np.ndarray, score: np.ndarray, ids: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored classes (query, score, their ids) the first most of each query by score, then id, one for each id: query, score, id."""
    lengths = ids.value_lengths().to_numpy(zero_copy_only=False)
    query, score, each = np.repeat(query, lengths), np.repeat(score, lengths), ids.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((each, -score, query))
    query, score, each = query[order], score[order], each[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    kept = place < most
    return query[kept], score[kept], each[kept]
