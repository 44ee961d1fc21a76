"""Made score grids of letters, three frames a letter, its own in the middle; as rows of many frames, which are cut from letters where they are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.functions import scores
from talkgrid.functions.text import let
from talkgrid.sources.tables import dealt

#: Letters of a row of a grid, and of a bucket in which words and windows meet.
ROW, BUCKET = 341, 512


def letters_of(words: DataFrame) -> DataFrame:
    """recording_id, letters: the tokens of a recording's words (seq, word_ix, tokens) one after the other."""
    one = F.array_sort(F.collect_list(F.struct("seq", "word_ix", "tokens")))
    return words.groupBy("recording_id").agg(F.flatten(F.transform(one, lambda x: x["tokens"])).alias("letters"))


def rows_of(words: DataFrame, table: list[list[float]], number, row: int = ROW) -> DataFrame:
    """recording_id, frame, logp, final: the grid, so many letters a row, the scores of a frame being the row of the table whose number is number(token or 0 for
    a blank, letter's number)."""
    letters = letters_of(words).where("size(letters) > 0")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size("letters") / row).cast("int") - 1), lambda b: F.struct((b * row).alias("ix"), F.slice("letters", b * row + 1, F.lit(row)).alias("own"), ((b + 1) * row >= F.size("letters")).alias("final")))
    rows = letters.select("recording_id", F.explode(cut).alias("x")).select("recording_id", "x.*")
    return rows.select("recording_id", (F.col("ix").cast("bigint") * 3).alias("frame"), made(F.col("own"), F.col("ix"), F.col("ix") * 3, F.size("own") * 3, table, number).alias("logp"), "final")


def made(letters: Column, ix: Column, first: Column, count: Column, table: list[list[float]], number) -> Column:
    """The scores of count frames (one at least) from the frame first on, made from letters, of which the first is a recording's letter ix."""

    def scored(f: Column) -> Column:
        letter = F.floor(f / 3).cast("int")
        token = F.when(f % 3 == 1, F.get(letters, letter - ix.cast("int"))).otherwise(0)
        return scores.listed(table, number(token, letter))

    return F.transform(F.sequence(first.cast("int"), (first + count).cast("int") - 1), scored)


def windows_of(words: DataFrame, spans: DataFrame, table: list[list[float]], number) -> DataFrame:
    """spans (recording_id, seq, first, count, in frames) with logp, made from the letters of the words (first, tokens) that they touch: only these meet them."""
    own = words.where("size(tokens) > 0").select("recording_id", F.col("first").cast("bigint").alias("_ix"), F.col("tokens").alias("_tokens"))
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor(b / BUCKET)))
    own = own.withColumn("_bucket", bucket(F.col("_ix"), F.col("_ix") + F.size("_tokens") - 1))
    low, high = F.floor(F.col("first") / 3), F.floor((F.col("first") + F.col("count") - 1) / 3)
    cut = spans.select("recording_id", "seq", "first", "count", low.alias("_low"), high.alias("_high")).withColumn("_bucket", bucket(F.col("_low"), F.col("_high")))
    met = cut.join(own, ["recording_id", "_bucket"]).where((F.col("_ix") <= F.col("_high")) & (F.col("_ix") + F.size("_tokens") > F.col("_low")) & (F.col("_bucket") == F.floor(F.greatest("_ix", "_low") / BUCKET)))
    one = F.array_sort(F.collect_list(F.struct("_ix", "_tokens")))
    found = dealt(met, "recording_id", "seq").groupBy("recording_id", "seq").agg(F.first("first").alias("first"), F.first("count").alias("count"), one.alias("_l"))
    found = found.select("recording_id", "seq", "first", "count", F.get("_l", F.lit(0))["_ix"].alias("_ix"), F.flatten(F.transform("_l", lambda x: x["_tokens"])).alias("_letters"))
    # Bound, as the letters would else be put together anew for every frame.
    logp = let(F.col("_letters"), lambda own: made(own, F.col("_ix"), F.col("first"), F.col("count"), table, number))
    return found.withColumn("logp", logp).drop("_ix", "_letters")
