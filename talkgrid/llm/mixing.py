"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target share of all words, at most MAX_REPEATS times its own size, and a weight
schedule over training time u in [0, 1]: 1 + slope * (2u - 1), with a slope by the source's place.
The schedule's integral, times the target, is the source's cumulative demand; inverting the demand
at a document's place in its source's stream gives its training position.

A source's stream is its documents in hash order, over and over. Whole passes are taken in full; the
last, partial pass takes a document while its middle lies within what is left, so the words taken
differ from the target by less than one document. Prefix sums run in two levels (per hash bucket,
then within a bucket), so a source with a third of all rows is spread over many tasks; the number of buckets grows with the rows. Rows without
an id are hashed by their text. What is windowed in one task is a row a source, and for each source a row a bucket.

Edges: a null text has size 0; a null source is a source of its own, last; sources of no words have
target 0; repeated rows each count, in a stable order; an empty table gives no rows; other columns are carried through by
assign() unless they have a result's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkgrid.llm.tables import cut, packed, table, unpacked

MAX_REPEATS = 3
#: Rows that a bucket may hold on average if all are of one source; at least LEAST_DIGITS hex digits of the order key name a bucket.
BUCKET_ROWS = 1 << 16
LEAST_DIGITS = 3
#: Slopes of the schedules, by the source's place, repeating: later, flat, earlier.
SLOPES = (0.8, 0.0, -0.8)


def source_targets(sizes: DataFrame) -> DataFrame:
    """From rows (source, size): source, source_size, target and slope of each source.

    With all targets t = min(3 * size, level * weight), the level comes from the sources in order of
    3 * size / weight: those whose quotient is below the level that the rest would have are capped.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    each = each.withColumn("place", place).withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("double"))
    cap = (F.col("source_size") * MAX_REPEATS).cast("double")
    each = each.withColumn("cap", cap).withColumn("quotient", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy(F.lit(1))
    before = Window.orderBy("quotient", "place").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    each = each.withColumn("level", level).withColumn("capped", F.col("quotient") < F.col("level"))
    free = F.min(F.when(~F.col("capped"), F.struct("quotient", "place", "level"))).over(whole)
    each = each.withColumn("free", free.getField("level"))
    target = F.when(F.col("capped") | F.col("free").isNull(), F.col("cap")).otherwise(F.col("free") * F.col("weight"))
    slopes = F.array(*[F.lit(float(x)) for x in SLOPES])
    slope = F.element_at(slopes, (F.col("place") - 1) % len(SLOPES) + 1)
    return each.select("source", "source_size", target.alias("target"), slope.alias("slope"))


def bucket_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits that name enough buckets for so many rows."""
    digits = LEAST_DIGITS
    while bucket_rows * 16**digits < rows:
        digits += 1
    return digits


def assign(docs: DataFrame, id_column: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs without text, with size, source_size, target, copies, taken, positions (of each copy, in 0..1) and the first position."""
    digits = bucket_digits(docs.count(), bucket_rows)
    docs = docs.drop("size", "source_size", "target", "copies", "taken", "positions", "position")
    columns, own = [c for c in docs.columns if c != "text"], (id_column, "source", "text")
    docs = packed(docs, *own)
    docs = docs.withColumn("size", F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).cast("long"))
    named = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit(" "), F.col("text")), F.lit(""))
    docs = cut(docs.withColumn("_key", F.md5(named.cast("binary"))).drop("text"))
    docs = docs.withColumn("_bucket", F.substring("_key", 1, digits))
    buckets = docs.groupBy("source", "_bucket").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_from", F.coalesce(F.sum("size").over(ahead), F.lit(0))).drop("size")
    targets = source_targets(buckets.select("source", "size"))
    starts = starts.withColumnsRenamed({"source": "_s", "_bucket": "_b"})
    targets = targets.withColumnRenamed("source", "_s2")
    out = docs.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    out = out.join(targets, F.col("source").eqNullSafe(F.col("_s2"))).drop("_s2")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", id_column, "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("_at", F.col("_from") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - F.col("_passes") * F.col("source_size")
    out = out.withColumn("_passes", passes)
    out = out.withColumn("copies", F.col("_passes") + F.when(F.col("_at") + F.col("size") / 2.0 < rest, 1).otherwise(0))
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    at = lambda k: F.least(F.lit(1.0), (F.col("_at") + k * F.col("source_size") + F.col("size") / 2.0) / F.col("target"))
    positions = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda k: _inverse_demand(at(k), F.col("slope")))
    out = out.withColumn("positions", F.when((F.col("copies") > 0) & (F.col("target") > 0), positions))
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    return unpacked(out, columns, own, "size", "source_size", "target", "copies", "taken", "positions", "position")


def _inverse_demand(share: F.Column, slope: F.Column) -> F.Column:
    """The time u at which u + slope * (u^2 - u), the share of a source's demand met so far, is share."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise(2 * share / (b + F.sqrt(b * b + 4 * slope * share)))


def in_training_order(assigned: DataFrame) -> DataFrame:
    """Rows range-sorted by training position; those not taken last."""
    n = int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return assigned.repartitionByRange(n, *key).sortWithinPartitions(*key)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = assign(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return in_training_order(mixed).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position"))


def sql_for(documents: str) -> str:
    """The mix of a table or subquery with doc_id, source and text."""
    return rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size, md5(coalesce(CAST(doc_id AS VARCHAR), ' ' || text, '')) AS k FROM {documents}),
e AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM e),
w AS (SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM p),
q AS (SELECT *, cap / weight AS quotient, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0)) / (weights - coalesce(sum(weight) OVER b, 0)) AS level FROM q
      WINDOW b AS (ORDER BY quotient, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, (quotient, place)) AS free FROM l WHERE NOT quotient < level),
t AS (SELECT source, source_size, CASE WHEN quotient < level OR free IS NULL THEN cap ELSE free * weight END AS target, [0.8, 0.0, -0.8][CAST((place - 1) % 3 + 1 AS INT)]::DOUBLE AS slope FROM l CROSS JOIN f),
s AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
c AS (SELECT s.*, t.source_size, t.target, t.slope, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, passes + CASE WHEN start + size / 2.0 < target - passes * source_size THEN 1 ELSE 0 END AS copies, least(1.0, (start + size / 2.0) / target)::DOUBLE AS share FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 AND target > 0 THEN round(CASE WHEN slope = 0 THEN share ELSE 2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) END, 9) END AS position
FROM n
"""


SQL = sql_for("documents")
