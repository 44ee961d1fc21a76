"""Hard negatives by a pivot table.

Components become the integers floor(256 x). Vectors get one more component that brings all of one length to the norm of the longest,
anchors get a zero: then the squared distance of an anchor and a vector is |anchor|^2 + longest^2 - 2 score, so the score is a matter of
Euclidean distance. The table holds each vector's distances to PIVOTS pivots, sorted by the nearest pivot and the distance to it, in blocks
of BLOCK rows with the least and largest distance to every pivot. By the triangle inequality |d(a,p) - d(x,p)| <= d(a,x) <= d(a,p) + d(x,p),
which brackets the score of a row, and with a block's bounds the scores of a block. Only rows whose bracket meets a range that is asked for are scored, exactly.

Positives and negatives are two searches of this kind, for the best of a range of scores: of the same label with
any score, of other labels with 0.8 to 1 times a positive's score. Each looks into the anchor's own block first, which raises the lower end of
the range, and then into the blocks that can still hold better rows. Equal vectors of a label are one class.

Edges: rows with a null id, label or vector or with null or non-finite components take no part, nor do those whose integer components are too
large for their scores to be longs (a squared norm of 2^60 or more); zero vectors do. Vectors of different lengths aren't compared; rows of one id, label and vector are
one; rows with the anchor's id are not its positives or negatives; ties go to the smaller id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrid.llm.equalvectors import best, by_width, classes, listed, rows_of, sound
from talkgrid.llm.tables import cut, partitions, release, table

EVERY, POSITIVES, NEGATIVES = 100, 5, 5
PIVOTS = 16
#: Rows of each length that pivots are chosen from, and numbers in them; shorter tables have fewer pivots.
SAMPLE, SAMPLE_NUMBERS = 4096, 1_000_000
#: Rows of a block, anchors that meet it at a time, and parts of the range of distances that blocks are looked up by.
BLOCK, ASKED, RINGS = 4096, 1024, 16
#: Scores have less than this size, so that 100 times a score's ratio is still a long.
LARGEST = 1 << 60


class Pivots:
    """Of the integer vectors of one length: the largest squared norm and the pivots, with their last component."""

    def __init__(self, most: float, sample: np.ndarray, pivots: int):
        self.most = most
        last = self.last(sample)
        chosen, gap = [], np.full(len(sample), np.inf)
        for _ in range(min(pivots, len(sample))):  # each the farthest from those before
            k = int(gap.argmax())
            if gap[k] == 0:
                break
            chosen.append(k)
            gap = np.minimum(gap, ((sample - sample[k]) ** 2).sum(axis=1) + (last - last[k]) ** 2)
        self.points, self.lasts = sample[chosen], last[chosen]

    def last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.most - (x * x).sum(axis=1)))

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1) + (last - e) ** 2) for p, e in zip(self.points, self.lasts)], axis=1)


def _pivots(found: DataFrame, pivots: int) -> dict[int, Pivots]:
    most = {r["width"]: float(r["most"]) for r in found.groupBy("width").agg(F.max("norm2").alias("most")).collect()}  # a row for each length
    w = Window.partitionBy("width").orderBy(F.xxhash64("v"), "class")
    limit = F.least(F.lit(SAMPLE), F.greatest(F.lit(pivots), F.lit(SAMPLE_NUMBERS) / F.greatest(F.col("width"), F.lit(1))))
    sample: dict[int, list] = {}
    few = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("v").toArrow().combine_chunks()
    for batch in few.to_batches():
        for width, part in by_width(batch, "v"):
            sample.setdefault(width, []).append(rows_of(part.column("v")))
    return {width: Pivots(most[width], np.concatenate(x), pivots) for width, x in sample.items()}


def _measured(shared):
    """Rows with their distances to the pivots, the nearest pivot, and as an anchor's those with a zero for the last component."""

    def job(batches):
        for batch in batches:
            for width, part in by_width(batch, "v"):
                pivots, x = shared.value[width], rows_of(part.column("v"))
                d = pivots.distances(x, pivots.last(x))
                near = d.argmin(axis=1)
                columns = [part.column(c) for c in ("class", "label", "ids", "v", "width")]
                yield pa.RecordBatch.from_arrays([*columns, listed(d), listed(pivots.distances(x, np.zeros(len(x)))), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])], names=["class", "label", "ids", "v", "width", "dist", "asked", "near", "ring"])

    return job


def _blocks(rows: int):
    """Number the blocks of sorted rows: a new one after so many rows, and where the length of the vectors changes."""

    def job(batches):
        from pyspark import TaskContext

        block, held, width = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            own = np.empty(batch.num_rows, np.int64)
            for k, w in enumerate(batch.column("width").to_pylist()):
                if held == rows or w != width:
                    block, held, width = block + 1, 0, w
                own[k], held = block, held + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "block"])

    return job


FOUND = "class long, r int, vec_id long, score long"


def _checked(shared, same: bool, want: int, step: int = 64):
    """A block and the anchors that ask for it to the first want rows of each range of each anchor: class, r, vec_id, score."""

    def job(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asks.num_rows:
            x, q = rows_of(rows.column("v")), rows_of(asks.column("v"))
            most = shared.value[x.shape[1]].most
            exact = np.int64 if most >= 1 << 53 else np.float64
            near, of = rows_of(rows.column("dist")), rows_of(asks.column("asked"))
            label, own = rows.column("label").to_numpy(), asks.column("label").to_numpy()
            ids, room = rows.column("ids").combine_chunks(), 1 + 1e-9 * most
            lows, highs = asks.column("lo").to_pylist(), asks.column("hi").to_pylist()
            for a in range(0, len(q), step):
                n = min(step, len(q) - a)
                below, above = np.zeros((n, len(x))), np.full((n, len(x)), np.inf)
                for j in range(near.shape[1]):
                    np.maximum(below, np.abs(of[a : a + n, j, None] - near[None, :, j]), out=below)
                    np.minimum(above, of[a : a + n, j, None] + near[None, :, j], out=above)
                base = ((q[a : a + n] ** 2).sum(axis=1) + most)[:, None]
                most_score, least_score = (base - below**2) / 2 + room, (base - above**2) / 2 - room
                ok = (label[None, :] == own[a : a + n, None]) == same
                ok &= (most_score >= np.array([min(v) for v in lows[a : a + n]], float)[:, None]) & (least_score <= np.array([max(v) for v in highs[a : a + n]], float)[:, None])
                if same and len(x) > want:  # no upper end: what is surely behind want rows goes
                    ok &= most_score >= np.partition(np.where(ok, least_score, -np.inf), len(x) - want, axis=1)[:, len(x) - want, None]
                columns = np.flatnonzero(ok.any(axis=0))
                if not len(columns):
                    continue
                score = (q[a : a + n].astype(exact) @ x[columns].astype(exact).T).astype(np.int64)
                ok = ok[:, columns]
                for i in range(n):
                    mine = np.flatnonzero(ok[i])
                    s = score[i, mine]
                    for r, (lo, hi) in enumerate(zip(lows[a + i], highs[a + i])):
                        fit = np.flatnonzero((s >= lo) & (s <= hi))
                        if len(fit) > want:
                            fit = fit[s[fit] >= np.partition(s[fit], len(fit) - want)[len(fit) - want]]
                        out += [(a + i, r, s[fit], columns[mine[fit]])] if len(fit) else []
        if not out:
            return pa.table({"class": pa.array([], pa.int64()), "r": pa.array([], pa.int32()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        group = np.repeat(np.arange(len(out)), [len(o[2]) for o in out])
        group, score, each = best(group, np.concatenate([o[2] for o in out]), ids.take(pa.array(np.concatenate([o[3] for o in out]))), want)
        at, r = np.array([o[0] for o in out]), np.array([o[1] for o in out], np.int32)
        return pa.table({"class": asks.column("class").combine_chunks().take(pa.array(at[group])), "r": pa.array(r[group]), "vec_id": pa.array(each), "score": pa.array(score)})

    return job


def _search(placed: DataFrame, boxes: DataFrame, asks: DataFrame, shared, same: bool, want: int, blocks: int) -> DataFrame:
    """The first want rows of each range of asks (class, width, label, v, asked, block, lo, hi; lo and hi hold the ends of the ranges): class, r, vec_id, score."""
    job = _checked(shared, same, want)
    home = cut(placed.groupBy("block").cogroup(asks.toDF(*asks.columns).groupBy("block")).applyInArrow(job, FOUND))
    full = home.groupBy("class", "r").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= want)
    full = full.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("r", "least"))).alias("least"))
    raised = F.transform("lo", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("least", i), x)))
    tighter = asks.join(full, "class", "left").withColumn("lo", F.when(F.col("least").isNull(), F.col("lo")).otherwise(raised)).drop("least")

    # Distances that the scores asked for stand for: an anchor meets the blocks within them, looked up by rings around the first pivot.
    sizes = spark_map(placed.sparkSession, {w: p.most for w, p in shared.value.items()})
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    room = 2 + 2e-9 * F.col("most")
    reach = tighter.join(sizes, "width").withColumn("_b", norm2 + F.col("most") + room)
    reach = reach.withColumn("far", F.sqrt(F.greatest(F.lit(0.0), F.col("_b") - 2 * F.array_min("lo").cast("double"))))
    reach = reach.withColumn("close", F.sqrt(F.greatest(F.lit(0.0), F.col("_b") - 2 * room - 2 * F.array_max("hi").cast("double"))))
    ring = 2 * F.sqrt(F.greatest(F.lit(1.0), F.col("most"))) / RINGS
    turn = lambda x, most: F.least(F.lit(RINGS), F.greatest(F.lit(0), F.floor(x / most).cast("int")))
    first = F.element_at("asked", 1)
    reach = reach.withColumn("ring", F.explode(F.sequence(turn(first - F.col("far"), ring), turn(first + F.col("far"), ring)))).drop("_b")
    around = boxes.join(sizes, "width").withColumn("ring", F.explode(F.sequence(turn(F.element_at("least", 1), ring), turn(F.element_at("largest", 1), ring)))).select("width", "ring", F.col("block").alias("into"), "least", "largest")
    each = F.sequence(F.lit(1), F.size("asked"))
    gap = F.array_max(F.transform(each, lambda j: F.greatest(F.lit(0.0), F.element_at("asked", j) - F.element_at("largest", j), F.element_at("least", j) - F.element_at("asked", j))))
    span = F.array_min(F.transform(each, lambda j: F.element_at("asked", j) + F.element_at("largest", j)))
    pairs = reach.join(around, ["width", "ring"]).where(F.col("into") != F.col("block")).where((gap <= F.col("far")) & (span >= F.col("close"))).select("class", "into").distinct()
    asking = tighter.drop("block").join(pairs, "class").withColumnRenamed("into", "block").withColumn("part", F.pmod(F.xxhash64("class"), F.lit(blocks)))
    copies = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    away = copies.groupBy("block", "part").cogroup(asking.toDF(*asking.columns).groupBy("block", "part")).applyInArrow(job, FOUND)
    w = Window.partitionBy("class", "r").orderBy(F.desc("score"), "vec_id")
    return home.unionByName(away).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= want)


def spark_map(spark: SparkSession, values: dict[int, float]) -> DataFrame:
    return spark.createDataFrame(sorted(values.items()), "width int, most double")


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, pivots: int = PIVOTS, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """For each anchor (vec_id divisible by every) and positive the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = vectors.where(sound("embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double"))).alias("v"))
    rows = rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = rows.where("vec_id is not null and label is not null").where(F.col("norm2") < float(LARGEST)).withColumn("v", F.col("v").cast("array<int>"))
    found = classes(rows, max(positives + 1, negatives), "label", "v", "norm2").withColumn("width", F.size("v"))
    chosen = _pivots(found, pivots)
    empty = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not chosen:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(chosen)
    measured = found.mapInArrow(_measured(shared), "class long, label long, ids array<long>, v array<int>, width int, dist array<double>, asked array<double>, near int, ring double")
    order = ["width", "near", "ring", "class"]
    ordered = cut(measured.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    placed = cut(ordered.mapInArrow(_blocks(block), f"{_ddl(ordered)}, block long"))
    release(ordered)
    whole = placed.groupBy("block", "width")
    ends = whole.agg(*[f(F.get("dist", F.lit(j))).alias(f"{f.__name__}{j}") for j in range(pivots) for f in (F.min, F.max)])
    ends_of = lambda f: F.filter(F.array(*[f"{f}{j}" for j in range(pivots)]), lambda x: x.isNotNull())
    boxes = cut(ends.select("block", "width", ends_of("min").alias("least"), ends_of("max").alias("largest")))

    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("_l"), F.col("v").alias("_v"))
    anchors = cut(anchors.join(found.select("class", "label", "v"), (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v"))).select("anchor_id", "class").distinct())
    own = cut(placed.join(anchors.select("class").distinct(), "class", "left_semi").select("class", "width", "label", "ids", "v", "asked", "block"))
    blocks = max(1, -(-own.count() // asked))
    wide = F.array(F.lit(-LARGEST).cast("long")), F.array(F.lit(LARGEST).cast("long"))
    good = _search(placed, boxes, own.withColumn("lo", wide[0]).withColumn("hi", wide[1]), shared, True, positives + 1, blocks)
    good = cut(good.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("good")))

    # 80 positive <= 100 negative: from the ceiling of 4/5 of the positive's score on. No negative score of at most a negative one is 4/5 of it.
    alone = F.when(F.size("ids") == 1, F.get("ids", F.lit(0)))  # an anchor without copies is not its own positive
    tops = F.filter("good", lambda g: (g["score"] >= 0) & ~alone.eqNullSafe(g["vec_id"]))
    tops = F.array_sort(F.array_distinct(F.transform(tops, lambda g: g["score"])))
    ranges = cut(own.join(good, "class").withColumn("hi", tops).where(F.size("hi") > 0).drop("good").withColumn("lo", F.expr("transform(hi, s -> s - s div 5)")))
    bad = _search(placed, boxes, ranges, shared, False, negatives, blocks)
    bad = bad.groupBy("class", "r").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("bad"))
    bad = ranges.select("class", F.posexplode("hi").alias("r", "positive_score")).join(bad, ["class", "r"]).drop("r")
    bad = cut(bad.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("positive_score", "bad"))).alias("bad")))
    release(placed, boxes, own, ranges, found)

    others = F.slice(F.filter("good", lambda g: g["vec_id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.join(good.join(bad, "class"), "class").select("anchor_id", "bad", F.explode(others).alias("p"))
    rows = pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(F.try_element_at("bad", F.col("p.score"))).alias("rank", "n"))
    return rows.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
