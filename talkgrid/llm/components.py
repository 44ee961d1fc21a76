"""Connected components: forests inside tasks, large-star and small-star rounds between them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.llm.tables import cut, release, written


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining each a with its b; parent must hold roots, and smaller numbers win."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        low, high = np.minimum(ra, rb)[differ], np.maximum(ra, rb)[differ]
        np.minimum.at(parent, high, low)
        parent = roots(parent)
    return parent


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of long ids: (node, component) of every node of an edge between different
    nodes, component being the smallest node that it reaches.

    Each round's rows are checkpointed, so lineage stays short and lost executors cost little. Minima
    are checkpointed on their own: the joins with them then stand on plain shuffles, which adaptive
    execution splits when a hub has very many links. Rounds go on until one changes nothing; their number grows with the logarithm of
    a component's diameter. The edges of a round are a written table, whose size Spark knows: a checkpoint keeps an estimate of its plan's
    size, which multiplies in each join and after ten rounds is a number of millions of digits.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"))
        # A node with no smaller neighbour keeps its links to the larger ones.
        large = e.withColumnsRenamed({"a": "v", "b": "u"}).join(least.withColumnRenamed("a", "u"), "u", "left")
        large = cut(large.select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b")).distinct())
        nearest = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(nearest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(nearest.select("a", F.col("m").alias("b"))).distinct()
        old, e = (e, least, large, nearest), written(small)
        release(*old)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
