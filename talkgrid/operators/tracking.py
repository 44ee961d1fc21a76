"""People from windows in which local speakers were found: tracks linked over windows, divided where they hold two voices, and brought together by voice.

Spans are (recording_id, window_ix, slot, start_s, end_s); tracked spans have a track too. Voices are short stretches with vectors
(recording_id, start_s, end_s, embedding), as a model makes them; a longer stretch has the mean of those whose middle it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators.folds import average_linkage, gathered, link_tracks, split_by_example, two_sides, window_conflicts
from talkgrid.operators.intervals import interval_join, union
from talkgrid.operators.speakers import group_tracks, people_at_least, voted_turns
from talkgrid.sources.shared import kept, new_folder

#: The shortest stretch that a track is judged by, how many of them, the longest first, and the seconds that a second voice must have to be believed.
SHORTEST, STRETCHES, CONVINCING = 1.5, 12, 2.0
#: Spans that a track's voice is made of.
SPANS = 8
THRESHOLD = 0.65
#: Seconds of a vote on who speaks.
STEP = 0.1


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _summed(vectors: Column) -> Column:
    """The sum of a list of vectors of one length."""
    none = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.aggregate(vectors, none, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))


def with_voices(stretches: DataFrame, voices: DataFrame, *ids: str) -> DataFrame:
    """stretches (recording_id, ids, start_s, end_s) that voices lie in, with the mean of their unit vectors."""
    v = voices.select("recording_id", "start_s", "end_s", unit(F.col("embedding").cast("array<double>")).alias("embedding"))
    middle = (F.col("r_start_s") + F.col("r_end_s")) / 2
    pairs = interval_join(stretches.select("recording_id", *ids, "start_s", "end_s"), v).where((middle >= F.col("start_s")) & (middle < F.col("end_s")))
    own = F.array_sort(F.collect_list(F.struct("r_start_s", "r_embedding")))
    found = pairs.groupBy("recording_id", *ids, "start_s", "end_s").agg(F.transform(own, lambda x: x["r_embedding"]).alias("_v"))
    return found.withColumn("embedding", F.transform(_summed(F.col("_v")), lambda x: x / F.size("_v"))).drop("_v")


def split_tracks(tracked: DataFrame, voices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Tracked spans where tracks with two voices are two: a track's longest stretches are clustered among themselves, and where the second voice has CONVINCING
    seconds each of the track's windows goes with the stretch whose middle is nearest. The first voice keeps the number, others get new ones in order of time."""
    key = ["recording_id", "track"]
    longest = Window.partitionBy(*key).orderBy(F.desc(F.col("end_s") - F.col("start_s")), "start_s")
    spoken = tracked.where("track >= 0")
    stretches = union(spoken.select(*key, "start_s", "end_s"), key).where(F.col("end_s") - F.col("start_s") >= SHORTEST)
    stretches = stretches.withColumn("_n", F.row_number().over(longest)).where(F.col("_n") <= STRETCHES)

    def cluster(rows: pa.StructArray) -> dict[str, list]:
        voice = average_linkage(np.array(rows.field("embedding").to_pylist(), float), threshold)
        return {"start_s": rows.field("start_s").to_pylist(), "end_s": rows.field("end_s").to_pylist(), "voice": voice.tolist()}

    heard = gathered(with_voices(stretches, voices, "track"), key, ["start_s"], ["end_s", "embedding"], cluster, "recording_id bigint, track int, start_s double, end_s double, voice int")
    heard = kept(heard, new_folder(tracked.sparkSession, "stretches"), "heard")  # asked for twice
    held = heard.groupBy(*key, "voice").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("held")).groupBy(*key).agg(F.sort_array(F.collect_list("held"), asc=False).alias("held"))
    impure = held.where(F.get("held", F.lit(1)) >= CONVINCING).select(*key)
    pieces = spoken.join(impure, key, "left_semi").groupBy(*key, "window_ix", "slot").agg(((F.min("start_s") + F.max("end_s")) / 2).alias("_at"))
    near = pieces.join(heard.select(*key, "voice", F.col("start_s").alias("_s"), ((F.col("start_s") + F.col("end_s")) / 2).alias("_m")), key)
    near = near.groupBy(*key, "window_ix", "slot").agg(F.min_by("voice", F.struct(F.abs(F.col("_m") - F.col("_at")), F.col("_s"))).alias("voice")).where("voice > 0")
    first = near.groupBy(*key, "voice").agg(F.min(F.struct("window_ix", "slot")).alias("first"))
    most = tracked.groupBy("recording_id").agg(F.max("track").alias("_most"))
    number = F.col("_most") + F.row_number().over(Window.partitionBy("recording_id").orderBy("first"))
    new = near.join(first.join(most, "recording_id").select(*key, "voice", number.cast("int").alias("_new")), [*key, "voice"]).select(*key, "window_ix", "slot", "_new")
    return tracked.join(new, [*key, "window_ix", "slot"], "left").withColumn("track", F.coalesce("_new", "track")).drop("_new").select(*tracked.columns)


def track_voices(tracked: DataFrame, voices: DataFrame) -> DataFrame:
    """recording_id, track, embedding: the direction of the sum of a track's SPANS longest spans."""
    longest = Window.partitionBy("recording_id", "track").orderBy(F.desc(F.col("end_s") - F.col("start_s")), "window_ix", "slot", "start_s")
    best = tracked.where("track >= 0").withColumn("n", F.row_number().over(longest)).where(F.col("n") <= SPANS)
    own = with_voices(best, voices, "track", "n").groupBy("recording_id", "track").agg(F.array_sort(F.collect_list(F.struct("n", unit(F.col("embedding")).alias("u")))).alias("_l"))
    return own.select("recording_id", "track", unit(_summed(F.transform("_l", lambda x: x["u"]))).alias("embedding"))


def merge_tracks(tracked: DataFrame, voices: DataFrame, wanted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Tracked spans with the tracks of each recording brought together to the people wanted there (recording_id, wanted), by voice, never two that talk at once
    in a window as far as that goes. A track that no voice is known of keeps a number of its own; recordings that no number is wanted for, or that have no more tracks, stay as they are."""
    present = tracked.where("track >= 0").groupBy("recording_id").agg(F.countDistinct("track").alias("_n"))
    asked = wanted.join(present, "recording_id").where("_n > wanted").select("recording_id", "wanted")
    known = track_voices(tracked.join(asked, "recording_id", "left_semi"), voices).join(asked, "recording_id")
    enough = F.count("*").over(Window.partitionBy("recording_id")) > F.col("wanted")
    known = known.withColumn("_enough", enough).where("_enough").drop("_enough")
    people = kept(group_tracks(known, window_conflicts(tracked), None, threshold), new_folder(tracked.sparkSession, "people"), "people")  # asked for twice
    tracks = tracked.where("track >= 0").select("recording_id", "track").distinct().join(people.select("recording_id").distinct(), "recording_id", "left_semi")
    named = tracks.join(people, ["recording_id", "track"], "left")
    whole = Window.partitionBy("recording_id")
    spare = F.max("person").over(whole) + F.sum(F.col("person").isNull().cast("int")).over(whole.orderBy("track"))
    named = named.select("recording_id", "track", F.coalesce("person", spare).cast("int").alias("_person"))
    return tracked.join(named, ["recording_id", "track"], "left").withColumn("track", F.coalesce("_person", "track")).drop("_person").select(*tracked.columns)


def tracked_people(spans: DataFrame, roster: DataFrame, voices: DataFrame, people: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Tracked spans from spans: linked over windows, divided by voice, and brought together to so many people at most. Two people are told apart by who talks at once
    where that says enough, without their voices; without a number it is the least that can explain who talks at once."""
    folder = new_folder(spans.sparkSession, "tracks")
    linked = link_tracks(spans, roster)
    tracked = spans.join(linked, ["recording_id", "window_ix", "slot"]).select("recording_id", "window_ix", "slot", "track", "start_s", "end_s")
    tracked = kept(split_tracks(kept(tracked, folder, "linked"), voices, threshold), folder, "split")
    conflicts = kept(window_conflicts(tracked), folder, "conflicts")
    if people is None:
        return merge_tracks(tracked, voices, people_at_least(conflicts).where("people >= 2").select("recording_id", F.col("people").alias("wanted")), threshold)
    wanted = tracked.select("recording_id").distinct().withColumn("wanted", F.lit(people))
    if people != 2:
        return merge_tracks(tracked, voices, wanted, threshold)
    extents = tracked.where("track >= 0").groupBy("recording_id", "track").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    sides = two_sides(extents, conflicts)
    told = sides.select("recording_id").distinct()
    merged = merge_tracks(tracked.join(told, "recording_id", "left_anti"), voices, wanted, threshold)
    by_side = tracked.join(told, "recording_id", "left_semi").join(sides, ["recording_id", "track"], "left").withColumn("track", F.coalesce("side", "track")).select(*tracked.columns)
    return merged.unionByName(by_side)


def diarized(spans: DataFrame, roster: DataFrame, voices: DataFrame, people: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Turns of people (recording_id, speaker, start_s, end_s, number), by votes of the windows on each moment."""
    tracked = tracked_people(spans, roster, voices, people, threshold).where("track >= 0")
    return voted_turns(tracked.select("recording_id", F.col("track").cast("string").alias("speaker"), "start_s", "end_s"), STEP)


#: The shortest paragraph that is compared by voice.
COMPARABLE = 1.0


def rename_by_voice(segments: DataFrame, paragraphs: DataFrame, voices: DataFrame, asks: DataFrame, apart: float = 0.5) -> DataFrame:
    """Segments (recording_id, seq, speaker, start_s, end_s) with speakers renamed: asks (recording_id, start_s, end_s, name, one a recording) point into a paragraph
    (recording_id, para_ix, speaker, start_s, end_s), and all others of its speaker that sound like it get the name too. Where they don't divide into two voices only that paragraph does."""
    folder = new_folder(segments.sparkSession, "renamed")
    a = asks.select("recording_id", F.col("start_s").alias("_from"), F.col("end_s").alias("_to"), "name")
    p = kept(paragraphs.select("recording_id", "para_ix", F.col("speaker").alias("_who"), "start_s", "end_s"), folder, "paragraphs")  # asked for three times
    covers = (F.col("start_s") <= F.col("_from")) & (F.col("end_s") >= F.col("_to"))
    meant = p.join(a, "recording_id").where(covers).groupBy("recording_id", "name").agg(F.min(F.struct("para_ix", "_who")).alias("x"))
    meant = kept(meant.select("recording_id", "name", F.col("x.para_ix").alias("_example"), F.col("x._who").alias("_old")), folder, "meant")  # so is this
    same = p.join(meant, "recording_id").where(F.col("_who").eqNullSafe(F.col("_old"))).withColumn("example", F.col("para_ix") == F.col("_example"))
    same = same.where(F.col("example") | (F.col("end_s") - F.col("start_s") >= COMPARABLE))
    heard = with_voices(same, voices, "para_ix", "example").select("recording_id", F.col("para_ix").cast("bigint").alias("voice_ix"), "example", "embedding")
    known = F.max("example").over(Window.partitionBy("recording_id")) & (F.count("*").over(Window.partitionBy("recording_id")) > 1)
    joined = split_by_example(heard.withColumn("_known", known).where("_known").drop("_known"), apart).where("same").select("recording_id", F.col("voice_ix").alias("para_ix"))
    chosen = joined.unionByName(meant.select("recording_id", F.col("_example").alias("para_ix"))).distinct()
    named = p.join(chosen, ["recording_id", "para_ix"]).join(meant.select("recording_id", "name"), "recording_id")
    # A recording's stretches meet its segments in one row, so that segments are asked for once.
    stretches = named.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "name"))).alias("_named"))
    middle = (F.col("start_s") + F.col("end_s")) / 2
    own = F.get(F.filter("_named", lambda x: middle.between(x["start_s"], x["end_s"])), F.lit(0))["name"]
    return segments.join(stretches, "recording_id", "left").withColumn("speaker", F.coalesce(own, F.col("speaker"))).select(*segments.columns)
