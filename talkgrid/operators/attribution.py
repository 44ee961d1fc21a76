"""Segments divided between speakers, by sentences and by words, and short voices attached to known ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.functions.text import sentences, stripped, word_offsets
from talkgrid.operators.evaluation import cosine_distance, unit
from talkgrid.operators.folds import average_linkage, gathered, ordered_fold, steady_words
from talkgrid.operators.intervals import BUCKET, best_overlap, interval_join, islands, latest_before, overlap
from talkgrid.operators.sequence import fill_labels
from talkgrid.sources.shared import kept, new_folder


def snap_turns(turns: DataFrame, segments: DataFrame, back: float = 0.9, ahead: float = 0.2) -> DataFrame:
    """turns (recording_id, turn_ix, speaker, start_s, end_s) whose borders move to the latest segment start near them, unless
    that is not after the start of the turn before, as moved, or not before the turn's own end; the turn before ends there.
    A recording with one turn or one segment stays as it is."""
    w = Window.partitionBy("recording_id").orderBy("seq")
    later = segments.withColumn("_k", F.row_number().over(w)).where("_k > 1").select("recording_id", "start_s")
    snapped = latest_before(turns.withColumnRenamed("start_s", "at_s"), later, "turn_ix", back, ahead).withColumnRenamed("at_s", "start_s")

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        start, end, snap = (rows[c].to_numpy(float).copy() for c in ("start_s", "end_s", "snap_s"))
        for i in range(1, len(rows)):
            if start[i - 1] < snap[i] < end[i]:
                end[i - 1] = start[i] = snap[i]
        return rows.assign(start_s=start, end_s=end).drop(columns="snap_s")

    return ordered_fold(snapped.select("recording_id", "turn_ix", "speaker", "start_s", "end_s", "snap_s"), ["turn_ix"], fold, "recording_id bigint, turn_ix int, speaker string, start_s double, end_s double")


def nearest_middle(pieces: DataFrame, stretches: DataFrame, piece: str, keys: tuple[str, ...] = ("recording_id", "track")) -> DataFrame:
    """pieces with the group of the stretch (keys, stretch_ix, group, start_s, end_s) of their track whose middle is nearest,
    the first of equals. A track has a dozen stretches at most."""
    s = stretches.select(*keys, F.col("stretch_ix").alias("_ix"), F.col("group").alias("_group"), ((F.col("start_s") + F.col("end_s")) / 2).alias("_middle"))
    rows = pieces.join(s, list(keys)).withColumn("_far", F.abs(F.col("_middle") - (F.col("start_s") + F.col("end_s")) / 2))
    best = rows.groupBy(*keys, piece).agg(F.min(F.struct("_far", "_ix", "_group")).alias("_best"))
    return pieces.join(best.select(*keys, piece, F.col("_best._group").alias("group")), [*keys, piece])


def attach_short(voices: DataFrame, threshold: float = 0.65, reliable: float = 0.9, gap_weight: float = 0.02, margin: float = 1.25, most: int | None = None, exact: int | None = None) -> DataFrame:
    """Speakers for voices (recording_id, voice_ix, embedding, start_s, end_s): the long ones are clustered; a short one joins the
    long one of least distance, seconds between them weighing a little, unless it sounds like none: such strangers are clustered
    among themselves. With fewer than two long ones all are clustered. A recording's voices are one group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["embedding"].tolist(), float)
        start, end = rows["start_s"].to_numpy(), rows["end_s"].to_numpy()
        long = end - start >= reliable
        if long.sum() < 2:
            return rows[["recording_id", "voice_ix"]].assign(speaker=average_linkage(x, threshold, most, exact))
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        u = np.where(norm < 1e-12, x, x / np.where(norm < 1e-12, 1, norm))
        labels = np.full(len(rows), -1)
        labels[long] = average_linkage(x[long], threshold, most, exact)
        short = np.flatnonzero(~long)
        distance = 1 - u[short] @ u[long].T
        gap = np.maximum(start[long][None, :] - end[short][:, None], start[short][:, None] - end[long][None, :]).clip(0)
        nearest = labels[long][(distance + gap_weight * gap).argmin(axis=1)] if len(short) else short
        known = distance.min(axis=1) <= threshold * margin if len(short) else short.astype(bool)
        labels[short[known]] = nearest[known]
        strangers = short[~known]
        labels[strangers] = labels.max() + 1 + average_linkage(x[strangers], threshold)
        return rows[["recording_id", "voice_ix"]].assign(speaker=labels)

    columns = ("recording_id", "voice_ix", "embedding", "start_s", "end_s")
    return ordered_fold(voices.select(*columns), ["voice_ix"], fold, "recording_id bigint, voice_ix bigint, speaker int")


def nearest_reliable(voices: DataFrame, threshold: float = 0.65, reliable: float = 0.9, gap_weight: float = 0.02, margin: float = 1.25) -> DataFrame:
    """For each short voice (recording_id, voice_ix, embedding, start_s, end_s) the reliable one it would join, by distance and, a
    little, seconds between; stranger tells that it sounds like none of them."""
    v = voices.select("recording_id", "voice_ix", unit(F.col("embedding")).alias("u"), "start_s", "end_s")
    long = v.where(F.col("end_s") - F.col("start_s") >= reliable).select("recording_id", *[F.col(c).alias(f"r_{c}") for c in ("voice_ix", "u", "start_s", "end_s")])
    pairs = v.where(F.col("end_s") - F.col("start_s") < reliable).join(long, "recording_id")
    gap = F.greatest(F.lit(0.0), F.col("r_start_s") - F.col("end_s"), F.col("start_s") - F.col("r_end_s"))
    pairs = pairs.withColumn("distance", cosine_distance(F.col("u"), F.col("r_u"))).withColumn("score", F.col("distance") + gap_weight * gap)
    best = pairs.groupBy("recording_id", "voice_ix").agg(F.min(F.struct("score", "r_voice_ix")).alias("best"), F.min("distance").alias("closest"))
    return best.select("recording_id", "voice_ix", F.col("best.r_voice_ix").alias("nearest"), F.col("best.score").alias("score"), (F.col("closest") > threshold * margin).alias("stranger"))


def split_by_turns(segments: DataFrame, turns: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Segments (recording_id, seq, text, start_s, end_s, speaker) by who spoke: one that several turns meet is cut at its sentences,
    which share its time by their characters; each goes to the turn that shares most with it, the earlier of equals, and
    neighbours of one speaker are joined again. One without sentences goes to whoever holds most of it, one without turns stays."""
    met = interval_join(segments.select("recording_id", "seq", "start_s", "end_s"), turns.select("recording_id", "turn_ix", "speaker", "start_s", "end_s"), bucket=bucket)
    near = met.groupBy("recording_id", "seq").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start_s").alias("s"), F.col("r_turn_ix").alias("ix"), F.col("r_end_s").alias("e"), F.col("r_speaker").alias("who")))).alias("near"))
    rows = segments.join(near, ["recording_id", "seq"], "left")
    parts = sentences("text")
    many = (F.size("near") > 1) & (F.size(parts) > 1)
    rows = rows.withColumn("_parts", F.when(F.coalesce(many, F.lit(False)), parts).otherwise(F.array("text"))).select("*", F.posexplode("_parts").alias("_part", "_text"))
    order = Window.partitionBy("recording_id", "seq").orderBy("_part")
    total = F.sum(F.length("_text")).over(Window.partitionBy("recording_id", "seq"))
    upto = F.sum(F.length("_text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_total": F.greatest(total, F.lit(1)), "_upto": upto})
    length = F.col("end_s") - F.col("start_s")
    cut = F.size("_parts") > 1
    rows = rows.withColumns({
        "_s": F.when(cut, F.col("start_s") + length * (F.col("_upto") - F.length("_text")) / F.col("_total")).otherwise(F.col("start_s")),
        "_e": F.when(cut, F.col("start_s") + length * F.col("_upto") / F.col("_total")).otherwise(F.col("end_s")),
    })
    shares = F.transform("near", lambda n, k: F.struct(overlap(F.col("_s"), F.col("_e"), n.getField("s"), n.getField("e")).alias("shared"), (-k).alias("k"), n.getField("who").alias("who")))
    rows = rows.withColumn("_who", F.when(F.size("near") > 0, F.array_max(shares).getField("who")).otherwise(F.col("speaker")))
    rows = islands(rows.withColumn("_same", F.lag("_who").over(order).eqNullSafe(F.col("_who")) & (F.col("_part") > 0)), ["recording_id", "seq"], ["_part"], ~F.col("_same"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_part", "_text"))), lambda x: x.getField("_text"))
    out = rows.groupBy("recording_id", "seq", "island").agg(F.min("_who").alias("speaker"), F.array_join(ordered, " ").alias("text"), F.min("_s").alias("start_s"), F.max("_e").alias("end_s"))
    return out.select("recording_id", "seq", (F.col("island") - 1).alias("piece"), "speaker", "text", "start_s", "end_s")


def words_of(segments: DataFrame) -> DataFrame:
    """The words of segments with their places in the text: recording_id, seq, word_ix, text, offset."""
    rows = segments.select("recording_id", "seq", F.posexplode(word_offsets("text")).alias("word_ix", "w"))
    return rows.select("recording_id", "seq", "word_ix", F.col("w.word").alias("text"), F.col("w.offset").alias("offset"))


def label_words(words: DataFrame, turns: DataFrame, shortest: float = 0.5, longest: float = 1.5, bucket: float = BUCKET) -> DataFrame:
    """Words (recording_id, seq, word_ix, text, start_s, end_s) with label, the speaker of the turn, not under shortest, that shares
    most with the end of the word; the first turn where none meets it. Words without length take their neighbours' label."""
    worth = turns.where(F.col("end_s") - F.col("start_s") >= shortest)
    sounded = words.where("end_s > start_s").withColumns({"_id": F.struct("seq", "word_ix"), "start_s": F.greatest(F.col("start_s"), F.col("end_s") - longest)})
    best = best_overlap(sounded, worth, "_id", bucket).select("recording_id", "seq", "word_ix", F.col("best_speaker").alias("label"))
    return fill_labels(words.join(best, ["recording_id", "seq", "word_ix"], "left"), keys=("recording_id", "seq"))


def divide_by_words(segments: DataFrame, words: DataFrame, turns: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """Segments cut where the voice changes: words (with offset and times) are labelled by turns and steadied, and each run of one
    label is a piece of the text as written. A segment of one voice stays whole, as does one whose pieces would not hold all its words;
    one without words goes to whoever holds most of it."""
    labelled = kept(label_words(words, turns, bucket=bucket), new_folder(words.sparkSession, "labelled"), "words")  # asked for twice
    steady = steady_words(labelled).select("recording_id", "seq", "word_ix", "label")
    rows = labelled.drop("label").join(steady, ["recording_id", "seq", "word_ix"])
    w = Window.partitionBy("recording_id", "seq").orderBy("word_ix")
    rows = islands(rows.withColumn("_same", F.lag("label").over(w).eqNullSafe(F.col("label")) & (F.lag("word_ix").over(w).isNotNull())), ["recording_id", "seq"], ["word_ix"], ~F.col("_same"))
    runs = rows.groupBy("recording_id", "seq", "island").agg(
        F.min("label").alias("label"), F.min("offset").alias("_from"), F.count("*").alias("_n"), F.min_by("start_s", "word_ix").alias("_s"), F.greatest(F.max_by("end_s", "word_ix"), F.min_by("start_s", "word_ix")).alias("_e"),
    )
    own = Window.partitionBy("recording_id", "seq")
    runs = runs.withColumns({"_to": F.lead("_from").over(own.orderBy("island")), "_first": F.first("label").over(own.orderBy("island")), "_runs": F.count("*").over(own)})
    runs = runs.join(segments.select("recording_id", "seq", F.col("text").alias("_text"), F.col("start_s").alias("_ss"), F.col("end_s").alias("_se")), ["recording_id", "seq"])
    piece = stripped(F.substring("_text", F.col("_from") + 1, F.coalesce("_to", F.length("_text")) - F.col("_from")))
    runs = runs.withColumn("_piece", piece).withColumn("_lost", F.sum((F.col("_piece") == "").cast("int")).over(own))
    whole = (F.col("_runs") == 1) | (F.col("_lost") > 0)
    out = runs.where(~whole | (F.col("island") == 1)).select(
        "recording_id", "seq", (F.col("island") - 1).alias("piece"), F.when(whole, F.col("_first")).otherwise(F.col("label")).alias("speaker"),
        F.when(whole, F.col("_text")).otherwise(F.col("_piece")).alias("text"), F.when(whole, F.col("_ss")).otherwise(F.col("_s")).alias("start_s"), F.when(whole, F.col("_se")).otherwise(F.col("_e")).alias("end_s"),
    )
    silent = segments.select("recording_id", "seq", "text", "start_s", "end_s").join(words.select("recording_id", "seq").distinct(), ["recording_id", "seq"], "left_anti")
    silent = best_overlap(silent, turns, "seq", bucket).select("recording_id", "seq", F.lit(0).cast("long").alias("piece"), F.col("best_speaker").alias("speaker"), "text", "start_s", "end_s")
    return out.unionByName(silent)


def time_words(segments: DataFrame, blocks: DataFrame, rate: int, per_second: int = 100, floor: float = 0.002) -> DataFrame:
    """Times for the words of segments by loudness: each word takes a share of the segment's cumulative loudness that goes with its
    length. blocks (recording_id, block_ix, samples) hold equal numbers of samples but for the last; each segment gets only
    the blocks it touches, so a task holds a segment's sound, not a recording's."""
    size = blocks.groupBy("recording_id").agg(F.max(F.size("samples")).alias("_size"), F.sum(F.size("samples")).alias("_all"))
    rows = segments.select("recording_id", "seq", "text", "start_s", "end_s").join(size, "recording_id", "left")
    rows = rows.withColumn("end_s", F.greatest("end_s", "start_s"))
    clamp = lambda x, low: F.least(F.greatest(F.floor(x).cast("long"), low), F.col("_all"))
    rows = rows.withColumn("_a", clamp(F.col("start_s") * rate, F.lit(0))).withColumn("_b", clamp(F.col("end_s") * rate, F.col("_a")))
    touched = F.sequence(F.floor(F.col("_a") / F.col("_size")), F.floor(F.greatest(F.col("_a"), F.col("_b") - 1) / F.col("_size")))
    rows = rows.withColumn("block_ix", F.explode_outer(F.when(F.col("_size").isNotNull(), touched)))
    rows = rows.join(blocks.select("recording_id", "block_ix", "samples"), ["recording_id", "block_ix"], "left")
    frame = max(1, rate // per_second)

    def fold(part: pa.StructArray) -> dict[str, list]:
        one = part[0].as_py()
        words, start, end = (one["text"] or "").split(), one["start_s"], one["end_s"]
        if not words:
            return {"word_ix": [], "text": [], "start_s": [], "end_s": []}
        times = np.array([start, end])
        if len(words) > 1 and end > start:
            sound = part.field("samples").flatten().to_numpy(zero_copy_only=False).astype(float)
            if one["_size"] is not None:
                a = int(one["_a"] - one["block_ix"] * one["_size"])
                sound = sound[a : a + int(one["_b"] - one["_a"])]
            count = max(2, len(sound) // frame)
            squares = np.zeros(count * frame)
            squares[: min(len(sound), count * frame)] = (sound * sound)[: count * frame]
            many = np.clip(len(sound) - np.arange(count) * frame, 0, frame)
            rms = np.sqrt(squares.reshape(count, frame).sum(axis=1) / np.maximum(1, many))
            curve = np.append(0, np.cumsum(np.maximum(rms, floor)))
            weight = np.cumsum([0] + [max(1, len(w)) for w in words])
            times = start + (end - start) * np.minimum(np.searchsorted(curve, weight / weight[-1] * curve[-1]), count) / count
        return {"word_ix": list(range(len(words))), "text": words, "start_s": times[:-1].tolist(), "end_s": np.maximum(times[1:], times[:-1]).tolist()}

    return gathered(rows, ["recording_id", "seq"], ["block_ix"], ["samples", "text", "start_s", "end_s", "_size", "_a", "_b"], fold, "recording_id bigint, seq bigint, word_ix int, text string, start_s double, end_s double")


def measured_words(own: DataFrame, measured: DataFrame) -> DataFrame:
    """own words (recording_id, seq, word_ix, text, offset) with the measured times (recording_id, seq, word_ix, start_s, end_s) of the same
    place; segments whose words are not as many on both sides have no rows."""
    count = lambda df, name: df.groupBy("recording_id", "seq").agg(F.count("*").alias(name))
    equal = count(own, "_n").join(count(measured, "_m"), ["recording_id", "seq"]).where("_n = _m").select("recording_id", "seq")
    w = Window.partitionBy("recording_id", "seq").orderBy("word_ix")
    a = own.withColumn("_k", F.row_number().over(w))
    b = measured.withColumn("_k", F.row_number().over(w)).select("recording_id", "seq", "_k", "start_s", "end_s")
    return a.join(b, ["recording_id", "seq", "_k"]).join(equal, ["recording_id", "seq"], "left_semi").drop("_k")
