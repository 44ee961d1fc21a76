"""Benchmark decontamination with one FM-index per training shard.

Words are lower-cased (A-Z) runs of ASCII letters, digits and any non-ASCII characters. A window is
10 consecutive words of a benchmark item; an item with fewer words is one window. Each task cuts its texts into words
a piece at a time, keeps the runs of words that the benchmark has, at least as long as the shortest window (no other
words can be in an occurrence), and indexes those of a shard together; it finds all windows by backward search, locates them through
sampled positions and merges the spans. Spark cuts the benchmark into words; of each chunk of it, arrays of word numbers,
windows and their items go to the driver and from there to the tasks. Two windows are one only if all their words are the same 64-bit hashes.

Edges: a null or wordless text has no hits; null, empty and wordless items have no windows; repeated
items and documents count each; an item without an id has windows, but is not listed; an empty table of either kind gives rows without hits or no rows;
other columns are carried through, and an input column of a result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.fm_index import FmIndex
from talkgrid.llm.tables import cut as checkpointed
from talkgrid.llm.tables import table
from talkgrid.llm.textbytes import ALNUM_WORDS, Words, pieces, window_hashes

WINDOW = 10
#: Bytes of benchmark text that are broadcast at once; a larger benchmark is taken in several passes,
#: of which CHAIN stand in one job.
CHUNK_BYTES = 16 << 20
CHAIN = 2
#: Text bytes, and words that the benchmark has, of one index.
SHARD_BYTES = 8 << 20
SHARD_WORDS = 1 << 19

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


class Phrases:
    """The windows of some benchmark items, from the items' ids and their words' hashes: vocab (sorted word hashes), the items'
    words as numbers in it, by length the windows' first words, and for each window the items that have it as numbers of names."""

    def __init__(self, item_ids: list, hashes: np.ndarray, first: np.ndarray, window: int):
        self.vocab, symbols = np.unique(hashes, return_inverse=True)
        self.text = (symbols + 1).astype(np.int32)
        self.names = sorted({str(x) for x in item_ids if x is not None})
        number = {x: k for k, x in enumerate(self.names)}
        item = np.array([-1 if x is None else number[str(x)] for x in item_ids], np.int32)
        size = np.diff(first)
        self.starts: dict[int, np.ndarray] = {}
        self.base: dict[int, int] = {}  # the number of the first window of so many words
        bounds, owners = [], []  # of each window where the items that have it begin, and these
        for n in np.unique(np.minimum(size[size > 0], window)).tolist():
            of = np.flatnonzero((size == n) | ((size > n) & (n == window)))
            many = size[of] - n + 1
            at = np.repeat(first[of] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            owner = np.repeat(item[of], many)
            placed, keys = window_hashes(hashes, first, n)
            key = keys[np.searchsorted(placed, at)]
            order = np.argsort(key, kind="stable")
            at, owner, key = at[order], owner[order], key[order]
            new = np.append(True, key[1:] != key[:-1])
            same = at[new][np.cumsum(new) - 1]
            for j in range(n):  # of one hash, but not of the same words: a window of its own
                new |= self.text[at + j] != self.text[same + j]
            self.starts[n] = at[new]
            self.base[n] = sum(map(len, bounds))
            bounds.append(np.flatnonzero(new) + sum(map(len, owners)))
            owners.append(owner)
        self.bounds, self.owner = np.concatenate([*bounds, [sum(map(len, owners))]]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *owners])
        self.shortest = min(self.starts, default=0)
        bits = max(20, int(8 * len(self.vocab)).bit_length())
        self.known = np.zeros(1 << bits, bool)
        self.known[(self.vocab & np.uint64((1 << bits) - 1)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int32)
        maybe = np.flatnonzero(self.known[(hashes & np.uint64(len(self.known) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocab, hashes[maybe])
        at[at == len(self.vocab)] = 0
        same = self.vocab[at] == hashes[maybe] if len(self.vocab) else np.zeros(0, bool)
        out[maybe[same]] = at[same] + 1
        return out

    def runs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The runs of known words that a window may be in, a 0 after each: symbols and, of each, the word it is."""
        symbols, first = self.symbols(words.hashes()), words.first
        n = len(symbols)
        if not n or not self.starts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        run = np.ones(n, bool)  # a run begins
        run[1:] = (symbols[1:] == 0) | (symbols[:-1] == 0)
        run[first[:-1][first[:-1] < n]] = True
        begins = np.flatnonzero(run)
        ends = np.append(begins[1:], n)
        use = (symbols[begins] > 0) & (ends - begins >= self.shortest)
        begins, size = begins[use], (ends - begins)[use]
        put = np.cumsum(size + 1) - size - 1
        text = np.zeros(int(size.sum()) + len(size), np.int32)
        origin = np.zeros(len(text), np.int64)
        at = np.repeat(put - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        origin[at] = np.repeat(begins - put, size) + at
        text[at] = symbols[origin[at]]
        return text, origin

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each occurrence in the runs the place, the length and the number of the window."""
        none = np.zeros(0, np.int64)
        if not len(text):
            return none, none, none
        index = FmIndex(text)
        places, lengths, windows = [none], [none], [none]
        for n, starts in self.starts.items():
            sp, ep = index.search(self.text, starts, n)
            found = np.flatnonzero(ep > sp)
            many = (ep - sp)[found]
            place = index.locate(np.repeat(sp[found] - (np.cumsum(many) - many), many) + np.arange(int(many.sum())))
            places.append(place)
            lengths.append(np.full(len(place), n))
            windows.append(self.base[n] + np.repeat(found, many))
        return tuple(np.concatenate(x) for x in (places, lengths, windows))

    def items_in(self, doc: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and the items that have windows in them, each pair once and in order: a window counts once in a document before its items are looked up."""
        doc, window = np.divmod(np.unique(doc.astype(np.int64) * len(self.bounds) + window), len(self.bounds))
        many = self.bounds[window + 1] - self.bounds[window]
        at = np.repeat(self.bounds[window] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        doc, item, most = np.repeat(doc, many), self.owner[at], max(1, len(self.names))
        named = item >= 0
        return np.divmod(np.unique(doc[named] * most + item[named]), most)


def _item_words(batches):
    """Items to their ids as strings and the hashes of their words."""
    for piece in pieces(batches):
        words = Words(piece.column("text"), ALNUM_WORDS, lower=True)
        lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(words.hashes().view(np.int64)))
        yield pa.RecordBatch.from_arrays([piece.column("item_id"), lists], names=["item_id", "hashes"])


def phrases_of(items: DataFrame, window: int) -> Phrases:
    found = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_item_words, "item_id string, hashes array<long>").toArrow().combine_chunks()
    if not found.num_rows:
        return Phrases([], np.zeros(0, np.uint64), np.zeros(1, np.int64), window)
    lists = found.column("hashes").combine_chunks()
    first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    return Phrases(found.column("item_id").to_pylist(), lists.flatten().to_numpy().view(np.uint64), first, window)


def _without(texts: pa.Array, n_hit: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts with the spans of words cut out."""
    hit = np.flatnonzero(pc.greater(n_hit, 0).to_numpy(zero_copy_only=False))
    if not len(hit):
        return texts
    words = Words(texts.take(pa.array(hit)), ALNUM_WORDS, lower=True)
    new = texts.to_pylist()
    for k, (d, cuts) in enumerate(zip(hit.tolist(), spans.take(pa.array(hit)).to_pylist())):
        at, left = int(words.off[k]), []
        for s in cuts:
            a, b = (int(words.starts[words.first[k] + s["start"]]), int(words.ends[words.first[k] + s["end"] - 1]))
            left.append(words.raw[at:a].tobytes())
            at = b
        left.append(words.raw[at : words.off[k + 1]].tobytes())
        new[d] = b"".join(left).decode("utf-8")
    return pa.array(new, texts.type)


def _shards(batches, phrases: Phrases):
    """Pieces of texts whose runs are indexed together: lists of (piece, number of words by row, runs, row and word in it of each symbol)."""
    held, size, known = [], 0, 0
    for piece in pieces(batches):
        words = Words(piece.column("text"), ALNUM_WORDS, lower=True)
        text, origin = phrases.runs(words)
        doc = words.doc[origin] if len(origin) else origin
        held.append((piece, words.counts(), text, doc, origin - words.first[doc]))
        size, known = size + len(words.raw), known + len(text)
        if size >= SHARD_BYTES or known >= SHARD_WORDS:
            yield held
            held, size, known = [], 0, 0
    if held:
        yield held


def _lists(rows: np.ndarray, n: int, values: pa.Array, kind: pa.DataType) -> pa.Array:
    """Values of ascending rows as a list for each of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values).cast(kind)


def _finder(phrases, schema: pa.Schema, names: list[str], again: bool, cut: bool):
    def job(batches):
        own: Phrases = phrases.value
        for shard in _shards(batches, own):
            rows = np.cumsum([0] + [s[0].num_rows for s in shard])
            doc = np.concatenate([s[3] + r for s, r in zip(shard, rows)])
            word = np.concatenate([s[4] for s in shard])
            place, length, window = own.occurrences(np.concatenate([s[2] for s in shard]))
            d, w, e = doc[place], word[place], word[place] + length
            with_item, item = own.items_in(d, window)
            for k, (piece, counts, *_) in enumerate(shard):
                n, low, high = piece.num_rows, rows[k], rows[k + 1]
                here = (d >= low) & (d < high)
                dd, ww, ee = d[here] - low, w[here], e[here]
                mine = slice(*np.searchsorted(with_item, (low, high)))
                items = _lists(with_item[mine] - low, n, pa.array([own.names[i] for i in item[mine].tolist()], pa.string()), schema.field("items").type)
                if again:
                    old = piece.column("spans")
                    flat = old.flatten()
                    dd = np.concatenate([dd, np.repeat(np.arange(n), old.value_lengths().to_numpy(zero_copy_only=False))])
                    ww, ee = (np.concatenate([x, flat.field(f).to_numpy(zero_copy_only=False)]) for x, f in ((ww, "start"), (ee, "end")))
                    items = pa.array([sorted({*a, *b}) for a, b in zip(items.to_pylist(), piece.column("items").to_pylist())], items.type)
                order = np.lexsort((ww, dd))
                dd, ww, ee = dd[order], ww[order], ee[order]
                upto = np.maximum.accumulate((dd << 32) + ee) if len(dd) else dd
                new = np.ones(len(dd), bool)
                new[1:] = ((dd << 32) + ww)[1:] > upto[:-1]
                last = np.append(new[1:], True)[: len(new)]
                row, start, end = dd[new], ww[new], (upto & ((1 << 32) - 1))[last]
                made = {
                    "n_words": pa.array(counts, pa.int64()),
                    "n_hit": pa.array(np.bincount(row, end - start, n).astype(np.int64)),
                    "items": items,
                    "spans": _lists(row, n, pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["start", "end"]), schema.field("spans").type),
                }
                if cut:
                    made["text"] = _without(piece.column("text"), made["n_hit"], made["spans"])
                yield pa.RecordBatch.from_arrays([made[c] if c in made else piece.column(c) for c in names], names=names)

    return job


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, cut: bool = False) -> DataFrame:
    """docs (with text) and for each row n_words, n_hit, items (ids as strings, sorted) and spans of hit words; with cut
    the spans are cut out of text in the same pass."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = max(1, -(-int(size) // chunk_bytes))
    out = docs.drop(*[f.name for f in RESULT])
    schema = T.StructType(out.schema.fields + RESULT.fields)
    names = [f.name for f in schema]
    arrow = _arrow_schema(schema)
    for i in range(chunks):
        if i and i % CHAIN == 0:
            out = checkpointed(out)
        shared = spark.sparkContext.broadcast(phrases_of(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == i), window))
        out = out.mapInArrow(_finder(shared, arrow, names, again=i > 0, cut=cut and i == chunks - 1), schema)
    return out


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def remove_spans(found: DataFrame) -> DataFrame:
    """The documents with every hit span of words cut out of the text."""
    names = [f.name for f in found.schema if f.name not in RESULT.names]
    schema = T.StructType([f for f in found.schema if f.name in names])

    def cut(batches):
        for batch in batches:
            texts = _without(batch.column("text"), batch.column("n_hit"), batch.column("spans"))
            yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in names], names=names)

    return found.mapInArrow(cut, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS phrase FROM i),
n AS (SELECT DISTINCT n FROM p),
t AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n),
o AS (SELECT t.doc_id, t.s, p.n, p.item FROM t JOIN p ON p.n = t.n AND p.phrase = array_to_string(t.w[t.s:t.s + t.n - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
