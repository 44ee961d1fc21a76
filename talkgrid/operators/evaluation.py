"""Measures: index percentiles, drift, shares within limits, thresholds, and distances of voices."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from talkgrid.functions.text import let


def ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows with rank (from 0) and n by group. A group of any size is sorted in one task, so keys must not be too coarse."""
    w = Window.partitionBy(*keys)
    return df.where(F.col(value).isNotNull()).withColumns({"rank": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value at place n div 2 of the sorted values."""
    return ranked(df, keys, value).where("rank = n div 2").select(*keys, F.col(value).alias("median"))


def index_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """For each share p the value at place min(n - 1, floor(p n))."""
    rows = ranked(df, keys, value).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    return rows.where(F.col("rank") == F.least(F.col("n") - 1, F.floor(F.col("p") * F.col("n")))).select(*keys, "p", F.col(value).alias("value"))


def sweep_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """For each share p the value at place floor(p (n - 1)), as sweeps of thresholds read it."""
    rows = ranked(df, keys, value).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    return rows.where(F.col("rank") == F.floor(F.col("p") * (F.col("n") - 1))).select(*keys, "p", F.col(value).alias("value"))


def centred_within(df: DataFrame, keys: Sequence[str], value: str, limits: Sequence[float]) -> DataFrame:
    """The lag, the value at place min(n - 1, n div 2), and the shares of values within each limit of it."""
    bias = ranked(df, keys, value).where(F.col("rank") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.5))).select(*keys, F.col(value).alias("bias"))
    rows = df.where(F.col(value).isNotNull()).join(bias, list(keys)).withColumn("_off", F.col(value) - F.col("bias"))
    shares = [F.avg((F.abs("_off") <= limit).cast("double")).alias(f"within_{str(limit).replace('.', '_')}") for limit in limits]
    return rows.groupBy(*keys).agg(F.first("bias").alias("bias"), *shares)


def agreement(left: DataFrame, right: DataFrame, frames: DataFrame, several: str = "-2") -> DataFrame:
    """By recording, how two labellings by frame (recording_id, frame, label; none where it is quiet) agree over all frames
    (recording_id, frame, power): frames quiet to both, heard by one only, in which either hears several, that can be compared, and of
    these the agreed ones, labels being paired one to one; and the level of the sound under each verdict."""
    from talkgrid.functions.scores import level
    from talkgrid.operators.speakers import pair_speakers

    # The three meet by grouping. In a join Spark would take the size of frames for that of the few rows they were painted from, and broadcast them.
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    key = ["recording_id", "frame"]
    parts = [frames.select(*key, F.col("power").cast("double").alias("power"), none("string", "a"), none("string", "b"), F.lit(True).alias("_known"))]
    parts += [side.select(*key, none("double", "power"), *[F.col("label").alias(c) if c == name else none("string", c) for c in "ab"], none("boolean", "_known")) for side, name in ((left, "a"), (right, "b"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*key).agg(*[F.max(c).alias(c) for c in ("power", "a", "b", "_known")]).where("_known").drop("_known")
    quiet_a, quiet_b = F.col("a").isNull(), F.col("b").isNull()
    tangled = ~quiet_a & ~quiet_b & ((F.col("a") == several) | (F.col("b") == several))
    comparable = ~quiet_a & ~quiet_b & ~tangled
    verdicts = {"quiet": quiet_a & quiet_b, "only_left": ~quiet_a & quiet_b, "only_right": quiet_a & ~quiet_b, "tangled": tangled, "comparable": comparable}
    classes = {"quiet": verdicts["quiet"], "left": verdicts["only_left"], "right": verdicts["only_right"], "speech": ~quiet_a & ~quiet_b}
    by = rows.groupBy("recording_id", "a", "b").agg(F.count("*").alias("frames"), F.sum("power").alias("power"))
    many = lambda v: F.sum(F.when(v, F.col("frames")).otherwise(0))
    counted = by.groupBy("recording_id").agg(*[many(v).alias(k) for k, v in verdicts.items()], *[level(F.sum(F.when(v, F.col("power")).otherwise(0.0)), many(v)).alias(f"{k}_level") for k, v in classes.items()])
    shared = by.where(comparable).select("recording_id", "a", "b", "frames")
    agreed = pair_speakers(shared).groupBy("recording_id").agg(F.sum("frames").alias("agreed"))
    return counted.join(agreed, "recording_id", "left").withColumn("agreed", F.coalesce("agreed", F.lit(0)))


def threshold_sweep(voices: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """For each recording and threshold the number of speakers that clustering its voices (voice_ix, embedding, start_s, end_s) finds, and
    the largest share of speech that one has."""
    from talkgrid.operators.attribution import attach_short

    found = None
    for t in thresholds:
        one = attach_short(voices, threshold=t).withColumn("threshold", F.lit(float(t)))
        found = one if found is None else found.unionByName(one)
    each = found.join(voices.select("recording_id", "voice_ix", (F.col("end_s") - F.col("start_s")).alias("_held")), ["recording_id", "voice_ix"])
    each = each.groupBy("recording_id", "threshold", "speaker").agg(F.sum("_held").alias("_held"))
    return each.groupBy("recording_id", "threshold").agg(F.count("*").alias("speakers"), F.try_divide(F.max("_held"), F.sum("_held")).alias("largest_share"))


def times_real(audio_s: Column, elapsed_s: Column) -> Column:
    """How many times faster than the recording plays it was worked through."""
    return audio_s / F.greatest(F.lit(0.001), elapsed_s)


def windows_in_all(completed: Column, position_s: Column, duration_s: Column) -> Column:
    """How many windows there will have been, at the rate of those completed."""
    each = F.greatest(F.greatest(position_s, F.lit(0.001)) / completed, F.lit(0.001))
    more = F.greatest(F.ceil((duration_s - position_s) / each).cast("long"), F.lit(1))
    return F.when(position_s >= duration_s, completed.cast("long")).otherwise(completed + more)


def summed_vectors(voices: DataFrame, keys: Sequence[str], order: Sequence, most: int = 5) -> DataFrame:
    """The sum of each group's first voices by order, as they are."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = voices.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    parts = rows.select(*keys, F.posexplode("embedding").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy(*keys).agg(F.transform(ordered, lambda s: s.getField("x")).alias("embedding"))


def within(df: DataFrame, keys: Sequence[str], value: str, limits: Sequence[float]) -> DataFrame:
    """The shares of rows with an absolute value up to each limit."""
    shares = [F.avg((F.abs(value) <= limit).cast("double")).alias(f"within_{str(limit).replace('.', '_')}") for limit in limits]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *shares)


def by_fifth(df: DataFrame, keys: Sequence[str], at: str, value: str, parts: int = 5) -> DataFrame:
    """The mean and the largest absolute value in each of equal stretches of time; the last end itself is left out."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_from": F.min(at).over(w), "_to": F.max(at).over(w)})
    part = F.floor(F.try_divide((F.col(at) - F.col("_from")) * parts, F.col("_to") - F.col("_from")))
    rows = rows.withColumn("part", part).where((F.col("part") >= 0) & (F.col("part") < parts))
    return rows.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(F.abs(value)).alias("worst"))


def crowding(before: DataFrame, after: DataFrame, limit: float = 0.05) -> DataFrame:
    """By recording: neighbours that overlap by more than limit before and after a change of times, rows whose length went to
    nothing, and the largest shift. Rows are matched by seq and equal text."""

    def overlaps(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("recording_id").orderBy("seq")
        return df.withColumn("_over", (F.lag("end_s").over(w) - F.col("start_s") > limit).cast("int"))

    a = overlaps(before).select("recording_id", "seq", "text", F.col("start_s").alias("_s"), F.col("_over").alias("_before"), (F.col("end_s") - F.col("start_s")).alias("_len"))
    b = overlaps(after).select("recording_id", "seq", "text", "start_s", "end_s", "_over")
    both = a.join(b, ["recording_id", "seq", "text"])
    gone = (F.col("_len") > 0) & (F.col("end_s") - F.col("start_s") <= 0)
    return both.groupBy("recording_id").agg(
        F.coalesce(F.sum("_before"), F.lit(0)).alias("overlaps_before"), F.coalesce(F.sum("_over"), F.lit(0)).alias("overlaps_after"), F.count_if(gone).alias("swallowed"), F.max(F.abs(F.col("start_s") - F.col("_s"))).alias("worst_shift")
    )


def movers(before: DataFrame, after: DataFrame, most: int = 12) -> DataFrame:
    """The rows of each recording that shifted most."""
    a = before.select("recording_id", "seq", F.col("start_s").alias("_s"))
    rows = after.join(a, ["recording_id", "seq"]).withColumn("shift", F.col("start_s") - F.col("_s")).drop("_s")
    w = Window.partitionBy("recording_id").orderBy(F.desc(F.abs("shift")), "seq")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def unit(v: Column) -> Column:
    """The vector at length one; vectors of almost no length stay as they are."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(norm, lambda n: F.when(n < 1e-12, v).otherwise(F.transform(v, lambda x: x / n)))


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the product of two unit vectors; of vectors of different lengths the shorter counts."""
    n = F.least(F.size(a), F.size(b))
    return 1 - F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def voice_pairs(voices: DataFrame, group: Column) -> DataFrame:
    """Distances of all pairs of voices of one group (a recording's voices, whose number is small)."""
    v = voices.withColumns({"_g": group, "_u": unit(F.col("embedding"))})
    a = v.select("_g", F.col("vec_id").alias("a"), F.col("label").alias("label_a"), F.col("_u").alias("_a"))
    b = v.select("_g", F.col("vec_id").alias("b"), F.col("label").alias("label_b"), F.col("_u").alias("_b"))
    return a.join(b, "_g").where("a < b").select(F.col("_g").alias("recording_id"), "a", "b", (F.col("label_a") == F.col("label_b")).alias("same"), cosine_distance(F.col("_a"), F.col("_b")).alias("distance"))


def query_pairs(queries: DataFrame, voices: DataFrame, block_rows: int = 1000, slice_rows: int = 2_000) -> DataFrame:
    """Distances of every query (vec_id, label, embedding) to all other voices. Queries are dealt in blocks and voices in slices; each block
    meets each slice in a group of its own, so none grows with the tables."""
    side = lambda df, x: df.select(F.col("vec_id").alias(x), F.col("label").alias(f"_l{x}"), unit(F.col("embedding")).alias(f"_u{x}"))
    q, v = side(queries, "a"), side(voices, "b")
    blocks, slices = max(1, -(-q.count() // block_rows)), max(1, -(-v.count() // slice_rows))
    spread = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    label = voices.schema["label"].dataType
    kind = T.StructType([*[T.StructField(x, voices.schema["vec_id"].dataType) for x in "ab"], *[T.StructField(x, label) for x in ("_la", "_lb")], T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(kind)

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for i, a in _by_length(left["_ua"]):
            for j, b in _by_length(right["_ub"]):
                n = min(a.shape[1], b.shape[1])
                x, y = np.repeat(i, len(j)), np.tile(j, len(i))
                known = pa.array((1 - a[:, :n] @ b[:, :n].T).ravel()) if n >= 0 and a.dtype == b.dtype == float else pa.nulls(len(x), pa.float64())
                x, y = pa.array(x), pa.array(y)
                made.append(pa.table([left["a"].take(x), right["b"].take(y), left["_la"].take(x), right["_lb"].take(y), known], schema=arrow))
        found = pa.concat_tables(made) if made else arrow.empty_table()
        return found.filter(pc.not_equal(found["a"], found["b"]))

    left, right = spread(q, "_x", blocks, "_y", slices).groupBy("_x", "_y"), spread(v, "_y", slices, "_x", blocks).groupBy("_x", "_y")
    pairs = left.cogroup(right).applyInArrow(meet, kind)
    return pairs.select("a", "b", (F.col("_la") == F.col("_lb")).alias("same"), "distance")


def _by_length(vectors: pa.ChunkedArray):
    """Places and rows of the vectors of each length; those that are null or hold a null come together, as rows without numbers."""
    lists = vectors.combine_chunks()
    whole = np.array([x is not None and None not in x for x in lists.to_pylist()], bool) if lists.null_count or lists.flatten().null_count else np.ones(len(lists), bool)
    size = np.where(whole, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), -1)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.zeros((len(at), 0), object) if n < 0 else lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), n)


def best_threshold(pairs: DataFrame, first: float = 0.05, last: float = 1.5, step: float = 0.01) -> DataFrame:
    """For each threshold the balanced error of calling pairs below it the same; the least error, the first of equals, wins."""
    # Counts by distance bin come first, so the grid meets a few hundred rows and not all pairs.
    bins = pairs.groupBy((F.ceil((F.col("distance") - first) / step)).alias("bin"), "same").agg(F.count("*").alias("n"))
    return threshold_of(bins, first, last, step)


def threshold_of(bins: DataFrame, first: float = 0.05, last: float = 1.5, step: float = 0.01) -> DataFrame:
    """As best_threshold, from counts n of pairs by distance bin and same."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(round((last - first) / step))), lambda k: F.round(F.lit(first) + k * step, 6)))
    rows = bins.withColumn("threshold", grid).withColumn("k", F.round((F.col("threshold") - first) / step).cast("long"))
    called = F.col("bin") <= F.col("k")
    rates = rows.groupBy("threshold").agg(
        F.try_divide(F.sum(F.when(F.col("same") & ~called, F.col("n")).otherwise(0)), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0))).alias("missed"),
        F.try_divide(F.sum(F.when(~F.col("same") & called, F.col("n")).otherwise(0)), F.sum(F.when(~F.col("same"), F.col("n")).otherwise(0))).alias("false"),
    )
    error = (F.coalesce("missed", F.lit(0.0)) + F.coalesce("false", F.lit(0.0))) / 2
    return rates.withColumn("error", error).orderBy("error", "threshold").limit(1)


def pair_bins(voices: DataFrame, first: float = 0.05, step: float = 0.01, block_rows: int = 8192) -> DataFrame:
    """Counts n of all pairs of labelled voices by distance bin and same. Rows are dealt in blocks and each pair of blocks is a group
    of its own, which sends out counts only; the work is that of all pairs."""
    v = voices.where("label IS NOT NULL").select("vec_id", "label", unit(F.col("embedding")).alias("_u"))
    blocks = max(1, -(-v.count() // block_rows))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    v = v.withColumn("_own", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    v = v.select(F.least("_own", "_j").alias("_a"), F.greatest("_own", "_j").alias("_b"), "_own", "label", "_u")

    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        u, own, label = rows.column("_u").combine_chunks(), rows.column("_own").to_numpy(), rows.column("label").to_numpy()
        size = pc.list_value_length(u).to_numpy()
        flat = np.zeros((len(size), int(size.max(initial=0))))  # of vectors of different lengths the shorter counts
        flat[np.arange(flat.shape[1]) < size[:, None]] = u.flatten().to_numpy()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found: Counter = Counter()
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            bins = np.nan_to_num(np.ceil((1 - flat[part] @ flat[y].T - first) / step), nan=1000).clip(-1000, 1000).astype(np.int64)
            same = label[part][:, None] == label[y]
            once = part[:, None] < y if i == j else np.ones(same.shape, bool)
            counts = np.bincount(((bins + 1000) * 2 + same)[once])
            for k in np.flatnonzero(counts):
                found[int(k) // 2 - 1000, bool(k % 2)] += int(counts[k])
        keys = list(found)
        return pa.table({"bin": pa.array([k for k, _ in keys], pa.int64()), "same": pa.array([s for _, s in keys], pa.bool_()), "n": pa.array([found[k] for k in keys], pa.int64())})

    counted = v.groupBy("_a", "_b").applyInArrow(count, "bin long, same boolean, n long")
    return counted.groupBy("bin", "same").agg(F.sum("n").alias("n"))


def mean_gap(voices: DataFrame) -> DataFrame:
    """The mean distances (same, different) of all pairs of labelled voices, exactly, from sums of unit vectors: the products of
    all pairs of a set add up to half of its sum's square less its own squares."""
    v = voices.where("label IS NOT NULL").select("label", unit(F.col("embedding")).alias("_u"))
    sums = v.select("label", F.posexplode("_u").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("own"))
    whole = sums.groupBy("i").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("all_products"))
    inside = sums.agg(F.sum(F.col("x") * F.col("x")).alias("products"), F.sum("own").alias("own"))
    counts = v.groupBy("label").agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("square"), F.sum("n").cast("double").alias("n"))
    one = whole.crossJoin(inside).crossJoin(counts)
    same = 1 - F.try_divide(F.col("products") - F.col("own"), F.col("square") - F.col("n"))
    different = 1 - F.try_divide(F.col("all_products") - F.col("products"), F.col("n") * F.col("n") - F.col("square"))
    return one.select(same.alias("same"), different.alias("different"))


def mean_vectors(voices: DataFrame, keys: Sequence[str], order: Sequence, most: int = 8) -> DataFrame:
    """The mean of each group's first voices by order, at length one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = voices.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    parts = rows.select(*keys, F.posexplode(unit(F.col("embedding"))).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy(*keys).agg(unit(F.transform(ordered, lambda s: s.getField("x"))).alias("embedding"))


#: Means that are sent to every task at most; more are met in blocks.
FEW = 1 << 12


def nearest_voice(pieces: DataFrame, means: DataFrame, keys: Sequence[str] = (), few: int = FEW) -> DataFrame:
    """Each piece (vec_id, embedding) with the mean (label, embedding) of least distance among those of its group, or without keys among
    all. Without keys the means, one a label, are counted: up to few are sent to every task, more are dealt in blocks of about few,
    and each part of the pieces meets each block."""
    m = means.select(*keys, F.col("label").alias("voice"), F.col("embedding").alias("_m"))
    pieces = pieces.select(*keys, "vec_id", unit(F.col("embedding")).alias("_u"))  # once a piece, not once a pair
    if keys:
        rows = pieces.join(m, list(keys))
    elif (n := m.count()) <= few:
        rows = pieces.withColumn("_block", F.lit(0)).join(F.broadcast(m.withColumn("_block", F.lit(0))), "_block")
    else:
        blocks, parts = -(-n // few), int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = m.withColumn("_block", F.pmod(F.xxhash64("voice"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        own = pieces.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = own.join(dealt, ["_part", "_block"])
    rows = rows.withColumn("distance", cosine_distance(F.col("_u"), F.col("_m")))
    best = rows.groupBy(*keys, "vec_id").agg(F.min(F.struct("distance", "voice")).alias("best"))
    return best.select(*keys, "vec_id", F.col("best.voice").alias("voice"), F.col("best.distance").alias("distance"))


def windows(recordings: DataFrame, length: float = 30.0, overlap: float = 2.0) -> DataFrame:
    """Fixed windows (window_ix, start_s, content_s) over recordings (recording_id, duration_s)."""
    step = length - overlap
    count = F.ceil(F.greatest(F.col("duration_s") - length, F.lit(0.0)) / step).cast("int")
    rows = recordings.where("duration_s > 0").select("recording_id", "duration_s", F.explode(F.sequence(F.lit(0), count)).alias("window_ix"))
    start = F.col("window_ix") * step
    return rows.select("recording_id", "window_ix", start.alias("start_s"), F.least(F.lit(length), F.col("duration_s") - start).alias("content_s")).withColumn("mostly_padding", F.col("content_s") < 1.0)


def peaks(samples: DataFrame, buckets: int) -> DataFrame:
    """The largest absolute sample of each of equal buckets of a recording (recording_id, i, x), relative to the recording's largest."""
    n = F.count("*").over(Window.partitionBy("recording_id"))
    rows = samples.withColumn("_n", n).groupBy("recording_id", F.floor(F.col("i") * buckets / F.col("_n")).alias("bucket")).agg(F.max(F.abs("x")).alias("peak"))
    top = F.max("peak").over(Window.partitionBy("recording_id"))
    return rows.withColumn("_top", top).select("recording_id", "bucket", F.when(F.col("_top") > 1e-6, F.col("peak") / F.col("_top")).otherwise(F.col("peak")).alias("peak"))
