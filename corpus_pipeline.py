"""The corpus pipeline: toxic documents go, then repeated lines, near-duplicates and benchmark passages; what is left is mixed.

Each stage takes the documents that the one before kept. All but the last return the columns of documents,
with n_chars brought up to date where a text has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm import decontaminate, linededup, mixing, nearcopies, simhash, toxicity
from talkgrid.llm.tables import cut, stored, table
from talkgrid.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't train the toxicity model, so no SQL has the pipeline's rows.
ORACLE_SQL = None


def _documents(changed: DataFrame) -> DataFrame:
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go."""
    model = toxicity.trained(ship(spark), docs, sf_dir)
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents whose words were all in such lines."""
    ship(spark)
    kept = linededup.dedup(docs)
    return _documents(kept.where("n_removed < n_lines OR n_lines = 0"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: first of those whose SimHash fingerprints link, as in op3_simhash, then of what is
    left with a similarity of 0.8 or more of 5-word shingles, checked exactly, which fingerprints at that radius miss."""
    ship(spark)
    return nearcopies.one_of_each(cut(simhash.one_of_each(docs.select(*COLUMNS)))).select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts."""
    ship(spark)
    return _documents(decontaminate.find(docs, table(spark, sf_dir, "benchmark"), cut=True))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training plan: each document that the mix takes, how often and from which position on, in order of position."""
    ship(spark)
    mixed = mixing.assign(docs.select("doc_id", "source", "text")).where("taken > 0")
    return mixing.in_training_order(mixed).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "positions", "position")


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_lines),
    ("SimHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
