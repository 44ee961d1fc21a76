"""Substring deduplication by seed and extend.

Words are cut at ASCII white space and unchanged; a window is WINDOW consecutive words of a document.
A word goes if a window over it has a word sequence that also starts earlier (smaller doc_id, or same
document, earlier start). Windows are judged on the input.

Seeds are winnowed anchors: every window picks the least hash among its SEED-word shingles, the last of
equals, so equal windows share their anchor and its place in them. Windows in a row with the same anchor
are that anchor's extension, up to WINDOW words to either side. Anchors that occur once are dropped
(a fixed-size bit table of the repeated ones is broadcast; what it lets through in error is dropped
later). Equal extensions are one class; within an anchor, classes are compared window by window
for the earliest start of each, and windows removed join to maximal repeats over the documents.
Anchors with more than GROUP classes are compared by aggregation over their windows instead, and never gathered.

Edges: null texts have no words; texts under WINDOW words keep all; a null doc_id counts as the largest;
rows with the same doc_id count as one document, and equal windows at the same start of it are not
earlier than each other; an empty table gives no rows; other columns are carried through by dedup().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.bittable import bit_table, holds
from talkgrid.llm.linededup import Recent, grouped
from talkgrid.llm.simhash import spaced
from talkgrid.llm.tables import packed, release, stored, table, unpacked
from talkgrid.llm.textbytes import SPACE_WORDS, Words, pieces, span_hashes, window_hashes

WINDOW = 20
SEED = 8
#: log2 of the bits of the table of repeated anchors.
TABLE_BITS = 26
#: Classes of one anchor that are compared in one group.
GROUP = 2000
SEEN = 1 << 19
_LAST = (1 << 63) - 1


class Runs:
    """Runs of windows that picked the same anchor: anchor, doc (row), begin (word of the text), n (windows)."""

    def __init__(self, words: Words, window: int, seed: int):
        hashes = words.hashes()
        starts, grams = window_hashes(hashes, words.first, seed)
        # Windows begin where all their shingles are in one document.
        at = np.arange(len(starts))
        last = at + window - seed
        fits = last < len(starts)
        fits[fits] = words.doc[starts[last[fits]]] == words.doc[starts[at[fits]]]
        at = at[fits]
        best, place = grams[at], at.copy()
        for k in range(1, window - seed + 1):
            other = grams[at + k]
            less = other <= best
            best = np.where(less, other, best)
            place = np.where(less, at + k, place)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (words.doc[starts[at[1:]]] != words.doc[starts[at[:-1]]])
        head = np.flatnonzero(new)
        self.n = np.diff(np.append(head, len(at)))
        self.anchor = best[head]
        self.word = starts[at[head]]
        self.doc = words.doc[self.word]
        self.begin = self.word - words.first[self.doc]
        self.hashes, self.window = hashes, window

    def classes(self) -> np.ndarray:
        return span_hashes(self.hashes, self.word, self.word + self.n + self.window - 1, second=True)

    def windows(self, which: np.ndarray) -> pa.ListArray:
        n = self.n[which]
        at = np.repeat(self.word[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found = span_hashes(self.hashes, at, at + self.window, second=True).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(found))


def _anchors(window: int, seed: int):
    def job(batches):
        for piece in pieces(batches):
            anchor, n = np.unique(Runs(Words(piece.column("text"), SPACE_WORDS), window, seed).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return job


def _occurrences(shared, window: int, seed: int):
    """Runs of anchors that the table has; a task gives the window hashes of a class once."""

    def job(batches):
        seen = Recent(SEEN)
        for piece in pieces(batches):
            words = Words(piece.column("text"), SPACE_WORDS)
            runs = Runs(words, window, seed)
            use = np.flatnonzero(holds(shared.value, runs.anchor))
            for name in ("anchor", "n", "word", "doc", "begin"):
                setattr(runs, name, getattr(runs, name)[use])
            cls = runs.classes()
            known, one = np.unique(cls, return_index=True)
            tell = np.sort(one[seen.fresh(known.view(np.int64))])
            row = np.full(len(cls), -1, np.int64)
            row[tell] = np.arange(len(tell))
            at = pa.array(runs.doc)
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc").take(at), piece.column("row").take(at), pa.array(runs.begin.astype(np.int32)), pa.array(runs.n.astype(np.int32)), pa.array(runs.anchor.view(np.int64)), pa.array(cls.view(np.int64)), runs.windows(tell).take(pa.array(row, mask=row < 0))],
                names=["doc", "row", "begin", "n", "anchor", "cls", "windows"],
            )

    return job


EARLIEST = "cls long, anchor long, gone int"


def _earliest(batches):
    """Classes sorted by anchor to (cls, anchor, gone: a bit for each window that starts earlier elsewhere)."""
    for rows, _ in grouped(batches, ("key", "cls", "doc", "begin", "windows"), 1 << 40):
        m = len(rows["key"])
        n = np.array([len(w) for w in rows["windows"]])
        own = np.repeat(np.arange(m), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        hashed, anchor = np.concatenate(list(rows["windows"])), rows["key"][own]
        doc, start = rows["doc"][own], rows["begin"][own] + place
        order = np.lexsort((start, doc, hashed, anchor))
        head = np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (anchor[order][1:] != anchor[order][:-1]))
        first = order[head][np.cumsum(head) - 1]
        gone = np.zeros(len(own), bool)
        gone[order] = (doc[order] != doc[first]) | (start[order] != start[first])
        yield pa.RecordBatch.from_arrays([pa.array(rows["cls"]), pa.array(rows["key"]), pa.array(np.bincount(own, gone * (1 << place), m).astype(np.int32))], names=["cls", "anchor", "gone"])


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, table_bits: int = TABLE_BITS, group: int = GROUP) -> DataFrame:
    """For each (doc, row) with repeats, spans: runs of windows that go, as (begin, n, gone bits)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("row"), "text")
    anchors = docs.select("text").mapInArrow(_anchors(window, seed), "anchor long, n long")
    repeated = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    shared = spark.sparkContext.broadcast(bit_table(repeated, table_bits))
    found = stored(docs.mapInArrow(_occurrences(shared, window, seed), "doc long, row long, begin int, n int, anchor long, cls long, windows array<long>"))
    # A class has one anchor, whose hash is of other words' hashes: together 128 bits.
    classes = found.groupBy("cls", "anchor").agg(F.min(F.struct("doc", "begin")).alias("at"), F.first("windows", ignorenulls=True).alias("windows"))
    classes = stored(classes.select("cls", F.col("anchor").alias("key"), "at.doc", "at.begin", "windows"))
    # Counts are combined before they move, so a hot anchor's classes never meet in one task.
    hot = stored(classes.groupBy("key").count().where(F.col("count") > group).select("key"))
    # Stored, as it is small and the windows that were moved for it can go.
    compared = stored(classes.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").select("key", "cls", "doc", "begin", "windows").mapInArrow(_earliest, EARLIEST))
    late = classes.join(hot, "key", "left_semi").select("cls", F.col("key").alias("anchor"), "doc", "begin", F.posexplode("windows").alias("place", "w"))
    late = late.withColumn("start", F.col("begin") + F.col("place"))
    # Stored, so that the joins below stand on plain shuffles: a window, or a class, of very many copies can be split.
    first = stored(late.groupBy("anchor", "w").agg(F.min(F.struct("doc", "start")).alias("first")))
    late = late.join(first, ["anchor", "w"]).withColumn("bit", F.when(F.struct("doc", "start") == F.col("first"), 0).otherwise(F.call_function("shiftleft", F.lit(1), F.col("place"))))
    late = late.groupBy("cls", "anchor").agg(F.bit_or("bit").alias("gone"))
    gone = compared.unionByName(late)
    gone = stored(gone.join(classes.select("cls", F.col("key").alias("anchor"), F.col("doc").alias("_doc"), F.col("begin").alias("_begin")), ["cls", "anchor"]))
    release(classes, hot, compared, first)
    every = F.call_function("shiftleft", F.lit(1), F.col("n")) - 1
    rows = found.select("doc", "row", "begin", "n", "cls", "anchor").join(gone, ["cls", "anchor"])
    bits = F.when((F.col("doc") == F.col("_doc")) & (F.col("begin") == F.col("_begin")), F.col("gone")).otherwise(every)
    rows = rows.select("doc", "row", "begin", bits.alias("gone")).where("gone <> 0")
    return rows.groupBy("doc", "row").agg(F.collect_list(F.struct("begin", "gone")).alias("spans"))


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _cutter(names: list[str], window: int):
    def job(batches):
        for piece in pieces(batches):
            words = Words(piece.column("text"), SPACE_WORDS)
            spans = piece.column("_spans")
            if isinstance(spans, pa.ChunkedArray):
                spans = spans.combine_chunks()
            doc = np.repeat(np.arange(piece.num_rows), np.diff(_offsets(spans)))
            flat = spans.flatten()
            begin, gone = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "gone"))
            change = np.zeros(len(words.starts) + 1, np.int64)
            for bit in range(31):
                has = (gone >> bit) & 1 == 1
                if has.any():
                    at = words.first[doc[has]] + begin[has] + bit
                    np.add.at(change, at, 1)
                    np.add.at(change, at + window, -1)
            keep = np.cumsum(change[:-1]) == 0
            buf, starts, ends = spaced(words)
            left = buf[np.repeat(keep, ends - starts + 1)]
            size = np.append(0, np.cumsum((ends - starts + 1) * keep))
            cuts = size[words.first]
            texts = [left[a : b - 1].tobytes() if b > a else b"" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            counted = np.append(0, np.cumsum(~keep))[words.first]
            n_removed = np.diff(counted)
            made = {
                "n_words": pa.array(words.counts(), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
            if "text" in names:
                old = piece.column("text").to_pylist()
                made["text"] = pa.array([texts[d].decode("utf-8") if n else old[d] for d, n in enumerate(n_removed.tolist())], piece.column("text").type)
            yield pa.RecordBatch.from_arrays([made[n] if n in made else piece.column(n) for n in names], names=names)

    return job


def _offsets(lists: pa.ListArray) -> np.ndarray:
    """Offsets with nulls as empty lists, from 0."""
    return np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))


def dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = True, **limits: int) -> DataFrame:
    """docs with repeats cut out of text (kept words joined by single spaces where any went), n_words, n_removed and
    kept_sha256, which replace columns of those names. limits: table_bits and group of repeats(); they change the work, not the result."""
    docs = docs.drop(*RESULT.names)
    found = repeats(docs, window, **limits).withColumnsRenamed({"doc": "_doc", "row": "_row", "spans": "_spans"})
    rows = packed(docs, "doc_id", "text")
    out = rows.join(found, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left").drop("_doc", "_row")
    schema = T.StructType([f for f in rows.schema.fields if keep_text or f.name != "text"] + RESULT.fields)
    columns = [c for c in docs.columns if keep_text or c != "text"]
    return unpacked(out.mapInArrow(_cutter(schema.names, window), schema), columns, ("doc_id", "text"), *RESULT.names)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
f AS (SELECT seq, min((doc_id, s)) AS first FROM t GROUP BY seq HAVING count(*) > 1),
g AS (SELECT doc_id, s FROM t JOIN f USING (seq) WHERE (doc_id, s) <> first),
x AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM g),
e AS (SELECT doc_id, w, unnest(range(len(w))) AS k FROM d),
z AS (SELECT e.doc_id, count(*) AS n_words, count(x.k) AS n_removed, string_agg(e.w[e.k + 1], ' ' ORDER BY e.k) FILTER (x.k IS NULL) AS kept FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.k = e.k GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)
"""
