"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct words (cut at ASCII white space, A-Z lower-cased), each known by a 64-bit hash. Lines with equal
token sets, by two hashes of 64 bits over different hashes of the words, are one class; between classes the join finds every pair of Jaccard similarity SIMILARITY
or more. A line goes if an earlier line (smaller doc_id, or same document, smaller line number) has
an equal or similar token set; lines are judged on the input, not on what is left.

Tokens are ordered by rarity: by the count (to about an eighth) of their bucket in a table of BUCKETS counts over the whole
corpus (a fixed size, so it can be broadcast), then by hash; any total order keeps the join exact.
A set of n tokens needs its first n - ceil(0.8 n) + 1 tokens as keys. A token whose bucket counts above
HOT is a key only together with each other token of the prefix made one longer, of which similar sets share two.
Within a key, sets meet if length, position and a 128-bit parity sketch of the tokens allow it, unless they have
the same first key, where they meet anyway; these are verified on their whole token sets at their smallest common key. Groups above GROUP are put off,
dealt in blocks, and compared block by block. No pair is ever written: groups emit marks and counts.

Edges: null texts have no lines; blank lines are no duplicates and stay; lines of few words match
only equal sets; a null doc_id counts as the largest; rows with the same doc_id and line number are not
earlier than each other; an empty table gives no rows; other columns are carried through by dedup().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.bittable import bit_table, holds
from talkgrid.llm.tables import cut, packed, partitions, release, stored, table, unpacked
from talkgrid.llm.textbytes import SPACE_WORDS, Words, mix, pieces, word_hashes

#: Similarity as a fraction, 4/5.
SIMILARITY = (4, 5)
BUCKETS = 1 << 20
#: Counts of one packed block.
COUNTS = 1 << 12
#: Sets of up to so many tokens have a sketch of one word, larger ones of two.
SMALL = 64
HOT = 100_000
#: Sets of one key that are compared in one group.
GROUP = 1000
#: log2 of the bits of the table of classes with candidates.
TABLE_BITS = 26
#: Rows of a key from which sets are compared by a matrix product.
DENSE = 64
#: Pairs that are compared at once.
PAIRS = 50_000
#: Classes that a task remembers, so as not to send their copies again; a power of two.
SEEN = 1 << 20
NO_PLACE = (1 << 31) - 1
_LAST = (1 << 63) - 1


class Lines:
    """The lines of some texts: doc and number of each, its distinct tokens (first, tokens), and its token set's two hashes (cls, also).
    With chosen, a function of rows and line numbers, only the lines that it picks have tokens and hashes."""

    def __init__(self, column: pa.Array, chosen=None):
        words = Words(column, SPACE_WORDS, lower=True)
        n = len(words.off) - 1
        breaks = np.flatnonzero(words.raw == 0x0A)
        start = np.concatenate([words.off[:-1], breaks + 1])
        doc = np.concatenate([np.arange(n), np.searchsorted(words.off, breaks, "right") - 1])
        order = np.lexsort((start, doc))
        self.start, self.doc = start[order], doc[order]
        self.number = np.arange(len(self.doc)) - np.searchsorted(self.doc, np.arange(n))[self.doc]
        many = np.diff(np.append(np.searchsorted(words.starts, self.start), len(words.starts)))
        line, starts, ends = np.repeat(np.arange(len(self.start)), many), words.starts, words.ends
        if chosen is not None:
            use = np.repeat(chosen(self.doc, self.number), many)
            line, starts, ends = line[use], starts[use], ends[use]
        hashes = word_hashes(words.buf, starts, ends)
        order = np.argsort((line.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        line, token = line[order], hashes[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
        self.line, self.tokens = line[new], token[new]
        self.first = np.searchsorted(self.line, np.arange(len(self.doc) + 1))
        self.size = np.diff(self.first)
        self.cls = self._summed(mix(self.tokens))
        at = order[new]
        self.also = self._summed(word_hashes(words.buf, starts[at], ends[at], second=True))

    def _summed(self, values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.size.astype(np.uint64)).view(np.int64)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], names=list(columns))


LINE = "doc_id long, row long, line int, cls long, also long, block int, counts binary"


def _scan(buckets: int):
    """(doc_id, row, text) to a row of every line with words, and at the end the counts of token buckets in packed blocks."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("cls", pa.int64()), ("also", pa.int64()), ("block", pa.int32()), ("counts", pa.binary())])

    def job(batches):
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            lines = Lines(piece.column("text"))
            total += np.bincount((lines.tokens & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
            use = np.flatnonzero(lines.size)
            at, none = pa.array(lines.doc[use]), pa.nulls(len(use))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(at), piece.column("row").take(at), pa.array(lines.number[use].astype(np.int32)), pa.array(lines.cls[use]), pa.array(lines.also[use]), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        blocks = np.minimum(total, NO_PLACE).astype(np.int32).reshape(-1, COUNTS)
        used = np.flatnonzero(blocks.any(axis=1))
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(used.astype(np.int32)), pa.array([blocks[k].tobytes() for k in used], pa.binary())], schema=schema)

    return job


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            own = np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
            total[block] = total[block] + own if block in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, NO_PLACE).astype(np.int32).tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])


def token_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all buckets: a table of fixed size."""
    rows = scanned.where("block is not null").select("block", "counts").repartition("block").mapInArrow(_summed, "block int, counts binary").toArrow()
    out = np.zeros((buckets // COUNTS, COUNTS), np.int32)
    for block, counts in zip(rows.column("block").to_pylist(), rows.column("counts").to_pylist()):
        out[block] = np.frombuffer(counts, np.int32)
    return out.reshape(-1)


def _per_line(values: np.ndarray, first: np.ndarray, how) -> np.ndarray:
    return how.reduceat(values, first) if len(first) else values[:0]


def prefix_rows(lines: Lines, use: np.ndarray, counts: np.ndarray, similarity: tuple[int, int], hot: int) -> dict[str, np.ndarray]:
    """The keys of the lines in use (none without tokens), with what the filters need."""
    num, den = similarity
    size = lines.size[use]
    n = int(size.sum())
    at = np.repeat(lines.first[use] - (np.cumsum(size) - size), size) + np.arange(n)
    own, token = np.repeat(np.arange(len(use)), size), lines.tokens[at]
    seen = counts[(token & np.uint64(len(counts) - 1)).astype(np.int64)]
    rank = (seen.astype(np.float32).view(np.int32) >> 20).astype(np.int64)  # counts to about an eighth
    joined = (own << 44) | (rank << 32) | (token >> np.uint64(32)).astype(np.int64)
    order = np.argsort(joined)
    if len(use) >= 1 << 19 or (joined[order][1:] == joined[order][:-1]).any():
        order = np.lexsort((token, rank, own))
    token, common = token[order], seen[order] > hot
    first = np.cumsum(size) - size
    bit = np.uint64(1) << (token & np.uint64(63))
    high = (token >> np.uint64(6)) & np.uint64(1) == 1
    low, high = (_per_line(np.where(high == k, bit, np.uint64(0)), first, np.bitwise_xor) for k in (False, True))
    small = size <= SMALL
    sketch = [np.where(small, low ^ high, low).view(np.int64), np.where(small, np.uint64(0), high).view(np.int64)]
    prefix = size - (num * size + den - 1) // den + 1
    place = np.arange(n) - first[own]
    cold = np.flatnonzero((place < prefix[own]) & ~common)
    hots = np.flatnonzero((place < prefix[own]) & common)
    pair = lambda a, b: mix(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + mix(np.maximum(a, b)))
    wide = np.minimum(prefix + 1, size)
    many = wide[own[hots]]
    t = np.repeat(hots, many)
    u = first[own[t]] + np.arange(len(t)) - np.repeat(np.cumsum(many) - many, many)
    keep = (t != u) & ~(common[u] & (place[u] < prefix[own[u]]) & (u < t))  # two common tokens meet once
    t, u = t[keep], u[keep]
    who = np.concatenate([own[cold], own[t]])
    key = np.concatenate([token[cold], pair(token[t], token[u])]).view(np.int64)
    # The key at place 0 leads; a set whose first token is too common has none in common with others.
    lead = lines.cls[use].copy()
    lead[own[cold[place[cold] == 0]]] = token[cold[place[cold] == 0]].view(np.int64)
    return {
        "key": key,
        "cls": lines.cls[use][who],
        "lead": lead[who],
        "b0": sketch[0][who],
        "b1": sketch[1][who],
        "meta": (size[who] << 32) | np.concatenate([place[cold], np.full(len(t), NO_PLACE)]),
    }


class Recent:
    """The last values seen, in a table of fixed size: one value a slot."""

    def __init__(self, slots: int = SEEN):
        self.values = ~np.arange(slots)

    def fresh(self, values: np.ndarray) -> np.ndarray:
        """Which of the distinct values are not in the table; they are from now on."""
        slot = values & (len(self.values) - 1)
        new = self.values[slot] != values
        self.values[slot[new]] = values[new]
        return new


def _keys(shared, similarity: tuple[int, int], hot: int):
    num, den = similarity
    least = -(-num // (den - num))  # smaller sets match equal ones only

    def job(batches):
        seen = Recent()
        for piece in pieces(batches):
            lines = Lines(piece.column("text"))
            use = np.flatnonzero(lines.size >= least)
            use = use[np.unique(lines.cls[use], return_index=True)[1]]
            use = use[seen.fresh(lines.cls[use])]
            yield _batch(**prefix_rows(lines, use, shared.value, similarity, hot))

    return job


def grouped(batches, columns: tuple[str, ...], limit: int):
    """Rows sorted by key, as whole groups: (arrays, False) for many groups of at most limit rows, (arrays, True) for
    parts of a larger group. No more than a batch and limit rows are held."""
    held = None
    over = None  # the key of a large group that is passing
    for batch in batches:
        rows = {c: batch.column(c) for c in columns}
        rows = {c: v.to_numpy(zero_copy_only=False) if not pa.types.is_list(v.type) else np.array([x.values.to_numpy() for x in v], object) if len(v) else np.zeros(0, object) for c, v in rows.items()}
        if held is not None:
            rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
        key = rows["key"]
        if not len(key):
            held = rows
            continue
        begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(begins, len(key)))
        large = (sizes > limit) | (key[begins] == over)
        open_large = bool(large[-1])
        over = key[-1] if open_large else None
        done = len(key) if open_large else begins[-1]
        of = np.repeat(large, sizes)
        at = np.arange(len(key)) < done
        for which, flag in ((of & at, True), (~of & at, False)):
            if which.any():
                yield {c: v[which] for c, v in rows.items()}, flag
        held = {c: v[done:] for c, v in rows.items()}
    if held is not None and len(held["key"]):
        yield held, bool(held["key"][0] == over)


def neighbours(rows: dict[str, np.ndarray], num: int, den: int):
    """Pairs of rows i < j of one key whose sizes, in ascending order within a key, allow the similarity."""
    key, size = rows["key"], rows["size"]
    n = len(key)
    begins = np.append(True, key[1:] != key[:-1])
    stop = np.repeat(np.append(np.flatnonzero(begins)[1:], n), np.diff(np.append(np.flatnonzero(begins), n)))
    i, d = np.arange(n), 1
    while True:
        i = i[i + d < stop[i]]
        i = i[num * size[i + d] <= den * size[i]]
        if not len(i):
            return
        yield i, i + d
        d += 1


def _candidates(similarity: tuple[int, int], put_off: bool, group: int = GROUP):
    """Key groups to marks: kind 0, a class that has a partner under a key; kind 1, rows of groups put off."""
    num, den = similarity
    names = ("key", "cls", "lead", "b0", "b1", "meta")

    def job(batches):
        for rows, large in grouped(batches, names if put_off else (*names, "of"), group if put_off else 1 << 40):
            if large:
                yield _batch(kind=np.ones(len(rows["key"]), np.int32), **{c: rows[c] for c in names})
                continue
            size = rows["meta"] >> 32
            number = np.cumsum(np.append(False, rows["key"][1:] != rows["key"][:-1]))
            order = np.argsort((number << 31) | size)  # by size within a key; Spark sorts fastest by one column
            rows = {c: v[order] for c, v in rows.items()}
            rows["size"], rows["place"] = size[order].astype(np.int32), (rows["meta"] & NO_PLACE).astype(np.int32)
            alive = np.zeros(len(rows["key"]), bool)
            b0, b1 = rows["b0"].view(np.uint64), rows["b1"].view(np.uint64)
            small, fold = rows["size"] <= SMALL, b0 ^ b1
            need = lambda both: -(-num * both // (num + den))  # noqa: E731, tokens that sets of two sizes together must share
            room = lambda both: both - 2 * need(both)  # noqa: E731, tokens that only one of them may have
            # In a block pair, "of" is the key that the rows have in common.
            key = rows["key"] if put_off else rows["of"]
            for i, j in neighbours(rows, num, den):
                both = rows["size"][i] + rows["size"][j]
                ok = np.bitwise_count(fold[i] ^ fold[j]) <= room(both)
                i, j, both = i[ok], j[ok], both[ok]
                ok = (rows["cls"][i] != rows["cls"][j]) & ((rows["lead"][i] != rows["lead"][j]) | (rows["lead"][i] == key[i]))
                ok &= small[i] | small[j] | (np.bitwise_count(b0[i] ^ b0[j]).astype(np.int32) + np.bitwise_count(b1[i] ^ b1[j]) <= room(both))
                i, j, both = i[ok], j[ok], both[ok]
                si, sj, pi, pj = rows["size"][i], rows["size"][j], rows["place"][i], rows["place"][j]
                best = np.minimum(pi, pj) + np.minimum(si - pi, sj - pj)
                ok = (pi == NO_PLACE) | (pj == NO_PLACE) | (best >= need(both))
                alive[i[ok]] = alive[j[ok]] = True
            marks = np.unique(np.stack([key[alive], rows["cls"][alive]]), axis=1) if alive.any() else np.zeros((2, 0), np.int64)
            none = np.zeros(marks.shape[1], np.int64)
            yield _batch(kind=np.zeros(marks.shape[1], np.int32), key=marks[0], cls=marks[1], lead=none, b0=none, b1=none, meta=none)

    return job


MARK = "kind int, key long, cls long, lead long, b0 long, b1 long, meta long"


def dealt(rows: DataFrame, by: str, group: int = GROUP) -> DataFrame:
    """Rows of large key groups in blocks: of is their key, key one pair of blocks, mine and cross (two blocks) tell which pairs count."""
    counts = cut(rows.groupBy("key").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))).withColumnRenamed("key", "of")
    rows = rows.withColumnRenamed("key", "of").join(counts, "of")
    own = F.pmod(F.xxhash64(by, "of"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.xxhash64("of", F.least(own, j), F.greatest(own, j)).alias("key"), (own != j).alias("cross")))
    rows = rows.select("*", own.alias("mine"), F.explode(pairs).alias("pair"))
    return rows.select("*", "pair.key", "pair.cross").drop("pair", "blocks")


def places(doc: np.ndarray, row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A number for each place of a line."""
    return mix(mix(doc.view(np.uint64)) + mix(row.view(np.uint64) + line.astype(np.uint64))).view(np.int64)


def _places(batches):
    for batch in batches:
        yield _batch(place=places(*[batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row", "line")]))


def _sets(shared):
    """(doc, row, text) to the token sets of the lines whose place is in the table; no other lines are cut into words."""

    def job(batches):
        for piece in pieces(batches):
            doc, row = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row"))
            lines = Lines(piece.column("text"), lambda d, number: holds(shared.value, places(doc[d], row[d], number)))
            use = np.flatnonzero(lines.size > 0)
            tokens = [np.sort(lines.tokens[lines.first[k] : lines.first[k + 1]].view(np.int64)) for k in use.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(lines.cls[use]), pa.array(lines.also[use]), pa.array(tokens, pa.list_(pa.int64()))], names=["cls", "also", "tokens"])

    return job


def _overlap(sets: list[np.ndarray]) -> np.ndarray:
    """A 0/1 matrix of the sets over the values that two or more of them have."""
    size = np.array([len(s) for s in sets])
    values, inverse, many = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1
    x = np.zeros((len(sets), int((many > 1).sum())), np.float32)
    keep = many[inverse] > 1
    x[np.repeat(np.arange(len(sets)), size)[keep], place[inverse[keep]]] = 1
    return x


class _Members:
    """Rows of distinct values, for counting what pairs of rows have in common."""

    def __init__(self, rows: np.ndarray):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.first = np.append(0, np.cumsum(self.size))
        self.values = np.concatenate([*rows, np.zeros(0, np.int64)])
        self.numbers = np.unique(self.values, return_inverse=True)[1]
        self.width = max(1, int(self.numbers.max(initial=0)) + 1)
        self.sorted = np.sort(np.repeat(np.arange(len(rows)), self.size) * self.width + self.numbers)

    def common(self, i: np.ndarray, j: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """How many values rows i and j share, of those below a limit where it is given."""
        n = self.size[i]
        pair = np.repeat(np.arange(len(i)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.first[i][pair]
        if below is not None:
            keep = self.values[at] < below[pair]
            pair, at = pair[keep], at[keep]
        wanted = j[pair] * self.width + self.numbers[at]
        place = np.minimum(np.searchsorted(self.sorted, wanted), max(0, len(self.sorted) - 1))
        hit = self.sorted[place] == wanted if len(self.sorted) else np.zeros(len(wanted), bool)
        return np.bincount(pair[hit], minlength=len(i))


def _verify(similarity: tuple[int, int], put_off: bool, group: int = GROUP):
    """Groups of whole sets to links counted once for each pair: (kind 0, cls, n, doc, line of the earliest partner)
    or, kind 1, rows of groups put off."""
    num, den = similarity
    names = ("key", "cls", "also", "keys", "tokens", "doc", "line")
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("cls", pa.int64()), ("also", pa.int64()), ("keys", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("doc", pa.int64()), ("line", pa.int32()), ("n", pa.int64())])

    def linked(rows: dict[str, np.ndarray], ok: np.ndarray):
        """Links of rows that a matrix allows."""
        who = np.flatnonzero(ok.any(axis=1))
        place = np.lexsort((rows["line"], rows["doc"]))
        rank = np.empty(len(place), np.int64)
        rank[place] = np.arange(len(place))
        best = place[np.where(ok[who], rank[None, :], len(place)).min(axis=1)] if len(who) else who
        return rows["cls"][who], rows["also"][who], rows["doc"][best], rows["line"][best], ok[who].sum(axis=1)

    def dense(rows: dict[str, np.ndarray]):
        tokens = _overlap(list(rows["tokens"]))
        size = np.array([len(t) for t in rows["tokens"]])
        ok = (tokens @ tokens.T) * (num + den) >= num * (size[:, None] + size[None, :])
        ok &= (rows["cls"][:, None] != rows["cls"][None, :]) | (rows["also"][:, None] != rows["also"][None, :])
        if not put_off:
            ok &= (rows["mine"][:, None] != rows["mine"][None, :]) == rows["cross"][:, None]
        if ok.any():  # a pair belongs to its smallest common key
            own = rows["key"] if put_off else rows["of"]
            lower = _overlap([k[k < o] for k, o in zip(rows["keys"], own)])
            ok &= (lower @ lower.T) == 0
        return linked(rows, ok)

    def sparse(rows: dict[str, np.ndarray]):
        """The same for many keys of few rows each."""
        n = len(rows["key"])
        tokens, keys = _Members(rows["tokens"]), _Members(rows["keys"])
        size = tokens.size
        place = np.lexsort((rows["line"], rows["doc"]))
        rank = np.empty(n, np.int64)
        rank[place] = np.arange(n)
        many, best = np.zeros(n, np.int64), np.full(n, n)
        begins = np.append(True, rows["key"][1:] != rows["key"][:-1])
        stop = np.repeat(np.append(np.flatnonzero(begins)[1:], n), np.diff(np.append(np.flatnonzero(begins), n)))
        left, d = np.arange(n), 1
        while True:
            left = left[left + d < stop[left]]
            if not len(left):
                break
            for i in np.split(left, range(PAIRS, len(left), PAIRS)):
                j = i + d
                ok = (num * size[i] <= den * size[j]) & (num * size[j] <= den * size[i])
                if not put_off:
                    ok &= (rows["mine"][i] != rows["mine"][j]) == rows["cross"][i]
                i, j = i[ok], j[ok]
                ok = keys.common(i, j, below=(rows["key"] if put_off else rows["of"])[i]) == 0
                i, j = i[ok], j[ok]
                ok = (tokens.common(i, j) * (num + den) >= num * (size[i] + size[j])) & ((rows["cls"][i] != rows["cls"][j]) | (rows["also"][i] != rows["also"][j]))
                for a, b in ((i[ok], j[ok]), (j[ok], i[ok])):
                    np.add.at(many, a, 1)
                    np.minimum.at(best, a, rank[b])
            d += 1
        who = np.flatnonzero(many)
        at = place[best[who]]
        return rows["cls"][who], rows["also"][who], rows["doc"][at], rows["line"][at], many[who]

    def job(batches):
        for rows, large in grouped(batches, names if put_off else (*names, "of", "mine", "cross"), group if put_off else 1 << 40):
            m = len(rows["key"])
            if large:
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(rows["key"]), pa.array(rows["cls"]), pa.array(rows["also"]), pa.array(list(rows["keys"]), schema.field("keys").type), pa.array(list(rows["tokens"]), schema.field("tokens").type), pa.array(rows["doc"]), pa.array(rows["line"].astype(np.int32)), pa.array(np.zeros(m, np.int64))], schema=schema)
                continue
            once = np.ones(m, bool)  # a class may have come from several tasks
            order = np.lexsort((rows["also"], rows["cls"], rows["key"]))
            once[order[1:]] = np.any([rows[c][order][1:] != rows[c][order][:-1] for c in ("key", "cls", "also")], axis=0)
            rows = {c: v[once] for c, v in rows.items()}
            begins = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
            ends = np.append(begins[1:], len(rows["key"]))
            large = ends - begins > DENSE
            found = [dense({c: v[a:b] for c, v in rows.items()}) for a, b in zip(begins[large].tolist(), ends[large].tolist())]
            small = np.repeat(~large & (ends - begins > 1), ends - begins)
            found.append(sparse({c: v[small] for c, v in rows.items()}))
            cls, also, doc, line, n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(5))
            k = len(cls)
            lists = pa.nulls(k).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.nulls(k).cast(pa.int64()), pa.array(cls), pa.array(also), lists, lists, pa.array(doc), pa.array(line.astype(np.int32)), pa.array(n)], schema=schema)

    return job


FOUND = "kind int, key long, cls long, also long, keys array<long>, tokens array<long>, doc long, line int, n long"
#: Rows that one task sorts and compares, at the most on average.
TASK_ROWS = 1 << 20


def _row() -> F.Column:
    return F.xxhash64("text")


def spread(rows: DataFrame, parts: int) -> DataFrame:
    """rows with those of one key together and sorted, dealt over parts tasks at least."""
    rows = rows.repartition(parts, "key") if parts > partitions(rows.sparkSession) else rows.repartition("key")
    return rows.sortWithinPartitions("key")


def join_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, buckets: int = BUCKETS, hot: int = HOT, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, row, line, cls, also), and classes (cls, also, doc, line of the first, links, other_doc, other_line of the earliest partner)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", _row().alias("row"), "text")
    scanned = stored(docs.mapInArrow(_scan(buckets), LINE))
    lines = scanned.where("block is null").drop("block", "counts").withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))
    counts = token_counts(scanned, buckets)
    shared = spark.sparkContext.broadcast(counts)
    parts = -(-int(counts.sum(dtype=np.int64)) // (4 * TASK_ROWS))  # a fourth of the tokens at most are in prefixes
    first = F.min(F.struct(F.col("doc_id").alias("doc"), "line", "row")).alias("at")
    classes = stored(lines.groupBy("cls", "also").agg(first).select("cls", "also", "at.doc", "at.line", "at.row"))

    rows = docs.select("text").mapInArrow(_keys(shared, similarity, hot), "key long, cls long, lead long, b0 long, b1 long, meta long")
    marks = stored(spread(rows, parts).mapInArrow(_candidates(similarity, True, group), MARK))
    late = spread(dealt(marks.where("kind = 1").drop("kind").distinct(), "cls", group), parts)
    late = late.select("key", "cls", "lead", "b0", "b1", "meta", "of").mapInArrow(_candidates(similarity, False), MARK)
    alive = marks.where("kind = 0").select("cls", "key").unionByName(late.select("cls", "key"))
    alive = alive.groupBy("cls").agg(F.collect_set("key").alias("keys"))
    alive = stored(alive.join(classes, "cls"))
    chosen = spark.sparkContext.broadcast(bit_table(alive.select("doc", "row", "line").mapInArrow(_places, "place long"), TABLE_BITS))
    sets = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "row", "text").mapInArrow(_sets(chosen), "cls long, also long, tokens array<long>").dropDuplicates(["cls", "also"])
    sets = stored(alive.drop("row").join(sets, ["cls", "also"]))
    by_key = spread(sets.select(F.explode("keys").alias("key"), "cls", "also", F.array_sort("keys").alias("keys"), "tokens", "doc", "line"), parts)
    found = stored(by_key.mapInArrow(_verify(similarity, True, group), FOUND))
    late = spread(dealt(found.where("kind = 1").drop("kind", "n").dropDuplicates(["key", "cls", "also"]), "cls", group), parts)
    late = late.select("key", "cls", "also", "keys", "tokens", "doc", "line", "of", "mine", "cross").mapInArrow(_verify(similarity, False), FOUND)
    links = found.where("kind = 0").select("cls", "also", "n", "doc", "line").unionByName(late.select("cls", "also", "n", "doc", "line"))
    links = links.groupBy("cls", "also").agg(F.sum("n").alias("links"), F.min(F.struct("doc", "line")).alias("other"))
    # Stored, so that joins with the lines stand on plain shuffles and a class of very many copies can be split.
    linked = stored(classes.select("cls", "also", "doc", F.col("line").alias("at")).join(links, ["cls", "also"], "left"))
    release(classes, marks, alive, sets, found)
    return lines, linked


def judged(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, **limits: int) -> DataFrame:
    """For each (doc, row): n_lines with words, n_links (other token sets that its lines match), and the numbers of lines that go."""
    lines, classes = join_lines(docs, similarity, **limits)
    each = lines.join(classes, ["cls", "also"])
    here = F.struct(F.col("doc_id").alias("doc"), "line")
    earlier = (F.struct("doc", F.col("at").alias("line")) < here) | F.coalesce(F.col("other") < here, F.lit(False))
    each = each.select("doc_id", "row", F.struct("line", F.coalesce("links", F.lit(0)).alias("links"), earlier.alias("goes")).alias("x"))
    each = each.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("x").alias("x"))  # a set, as rows may repeat
    links = F.aggregate("x", F.lit(0).cast("long"), lambda n, x: n + x.getField("links"))
    gone = F.transform(F.filter("x", lambda x: x.getField("goes")), lambda x: x.getField("line"))
    return each.select("_doc", "_row", F.size("x").alias("n_lines"), links.alias("n_links"), F.size(gone).alias("n_removed"), gone.alias("_gone"))


def _cutter(names: list[str]):
    def job(batches):
        for piece in pieces(batches):
            gone = piece.column("_gone")
            texts = piece.column("text").to_pylist()
            for d, lines in enumerate(gone.to_pylist()):
                if lines:
                    drop = set(lines)
                    texts[d] = "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in drop)
            text = pa.array(texts, piece.column("text").type)
            yield pa.RecordBatch.from_arrays([text if n == "text" else piece.column(n) for n in names], names=names)

    return job


def dedup(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, **limits: int) -> DataFrame:
    """docs with later matches cut out of text, and n_lines, n_links and n_removed (which replace columns of those names).
    limits: buckets, hot and group of join_lines; they change the work, not the result."""
    results = ("n_lines", "n_links", "n_removed")
    docs = docs.drop(*results)
    found = judged(docs.select("doc_id", "text"), similarity, **limits)
    rows = packed(docs, "doc_id", "text")
    out = rows.join(found, (F.coalesce("doc_id", F.lit(_LAST)) == F.col("_doc")) & (F.xxhash64("text") == F.col("_row")), "left")
    out = out.select(*rows.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in results], "_gone")
    schema = T.StructType(out.schema.fields[:-1])
    return unpacked(out.mapInArrow(_cutter(schema.names), schema), docs.columns, ("doc_id", "text"), *results)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_links", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, line, t, list_sort(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w FROM l),
c AS (SELECT w, row_number() OVER (ORDER BY min((doc_id, line))) AS cls, min((doc_id, line)) AS at FROM s WHERE len(w) > 0 GROUP BY w),
u AS (SELECT cls, unnest(w) AS tok FROM c),
f AS (SELECT tok, count(*) AS n FROM u GROUP BY tok),
r AS (SELECT u.cls, u.tok, row_number() OVER (PARTITION BY u.cls ORDER BY f.n, u.tok) AS place, count(*) OVER (PARTITION BY u.cls) AS size FROM u JOIN f USING (tok)),
p AS (SELECT cls, tok, size FROM r WHERE place <= size - (4 * size + 4) // 5 + 1),
k AS (SELECT DISTINCT a.cls AS x, b.cls AS y FROM p a JOIN p b ON a.tok = b.tok AND a.cls < b.cls AND 4 * a.size <= 5 * b.size AND 4 * b.size <= 5 * a.size),
v AS (SELECT x, y, len(list_intersect(cx.w, cy.w)) AS o, len(cx.w) + len(cy.w) AS n, cx.at AS ax, cy.at AS ay FROM k JOIN c cx ON cx.cls = x JOIN c cy ON cy.cls = y),
e AS (SELECT x AS cls, ay AS other FROM v WHERE 9 * o >= 4 * n UNION ALL SELECT y, ax FROM v WHERE 9 * o >= 4 * n),
g AS (SELECT cls, count(*) AS links, min(other) AS other FROM e GROUP BY cls),
j AS (SELECT s.doc_id, s.line, s.t, len(s.w) > 0 AS has, coalesce(g.links, 0) AS links,
             coalesce(c.at < (s.doc_id, s.line), false) OR coalesce(g.other < (s.doc_id, s.line), false) AS goes
      FROM s LEFT JOIN c ON c.w = s.w LEFT JOIN g ON g.cls = c.cls),
z AS (SELECT doc_id, count(*) FILTER (has) AS n_lines, CAST(sum(links) AS BIGINT) AS n_links, count(*) FILTER (goes) AS n_removed, string_agg(t, chr(10) ORDER BY line) FILTER (NOT goes) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_links, 0) AS n_links, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN z USING (doc_id)
"""
