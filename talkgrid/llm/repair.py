"""Conversation structure repair by A* on the edit lattice.

A node of the lattice is how many rows are done and where the role initials `(s?(ua)+)?` stand: at the start, after s, after u, after a. Edges
delete, keep or rerole the next row, or insert one. The heuristic is the sum, over the rows that are left, of what no path avoids: 2 for a row
that must go, and 2 for a truncated row, which is deleted for 2 or left for 5. It is consistent, so that from a queue keyed (cost plus heuristic, audit) each
node comes first with its least cost and, of that, its ASCII-least audit; two different audits that lead to one node at one cost are never the start of one another.

Rows are sorted by conversation and turn over all partitions. A run of at most SEGMENT rows of one conversation is a segment, and is solved by itself:
from the start if it is the whole conversation, else from each of the four states to each of the four; segments of a conversation are then put together in order by the least
(cost, audit). No task holds the texts of a conversation: what meets is a letter a row. The hash of the repaired text runs over sorted rows,
row by row; SHA-256 can't be taken in parts, so one conversation is hashed by one task.

Edges: null conv_ids are one conversation; a null role or text is one space, also in damage keys; null turns come first; rows of one turn are
ordered by role and text; a role may be empty, and then adds nothing to the initials; tables without rows give none; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm.tables import cut, partitions, release, stored, table

#: A power of two: rows of one partition whose positions agree above these bits.
SEGMENT = 2048
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, RESET, INSERT, LEFT = 2, 1, 5, 5
SPACE = " \t\n\x0b\x0c\r"
NO_HASH = hashlib.sha256(b"").hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(conv_id:turn) % 20 stands for."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fate.alias("_f")).where("_f <> 0")
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_f") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("_f") == 3, 2).otherwise(1))).alias("_c")).drop("_c")


def in_order(rows: DataFrame, segment: int) -> DataFrame:
    """Rows with pos, which grows with the turn within a conversation, and seg, the run they are in. Stored.

    Equal rows are told apart by the number of their input row, so that any number of them is dealt over partitions."""
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    spread = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 16), F.substring("text", 1, 64), F.xxhash64("role", "text"), F.col("_n")]
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), *spread[:4], *spread[4:])
    ordered = ranged.sortWithinPartitions("conv_id", "turn", *spread[2:4], spread[4], "_n").drop("_n")
    ordered = ordered.withColumn("pos", F.monotonically_increasing_id())
    return stored(ordered.withColumn("seg", F.floor(F.col("pos") / segment)))


def faults(ordered: DataFrame) -> DataFrame:
    """pos, conv_id, seg, turn and code: the role's initial (s, u, a, - for none, x for others) and the first fault (b, d, t, or . for none)."""
    first = ordered.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    left = F.rtrim("text", F.lit(SPACE))
    fault = F.when(left == "", "b").when(F.col("_first").isNull(), "d").when(~F.right(left, F.lit(1)).isin(".", "!", "?"), "t").otherwise(".")
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).when(initial == "", "-").otherwise("x")
    return ordered.join(first, "pos", "left").select("pos", "conv_id", "seg", "turn", F.concat(initial, fault).alias("code"))


def _next(state: int) -> int:
    """The state after the only role that a new or changed row can have."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, initial: str) -> int | None:
    if initial == "-":
        return state
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == ("a" if state == USER else "u"):
        return _next(state)
    return None


def search(codes: str, start: int, goals: tuple[int, ...]) -> dict[int, tuple[int, str]]:
    """Of rows given as two letters each: the least (cost, audit) from the start to each of the goals, all rows done."""
    rows = [(codes[k], codes[k + 1]) for k in range(0, len(codes), 2)]
    ahead = [0] * (len(rows) + 1)
    for k in range(len(rows) - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if rows[k][1] != "." else 0)
    heap, done, found = [(ahead[0], "", 0, start)], set(), {}
    while heap and len(found) < len(goals):
        key, audit, k, state = heapq.heappop(heap)
        if (k, state) in done:
            continue
        done.add((k, state))
        cost = key - ahead[k]
        heapq.heappush(heap, (key + INSERT, audit + "I", k, _next(state)))
        if k == len(rows):
            if state in goals:
                found[state] = (cost, audit)
            continue
        initial, fault = rows[k]
        cost += ahead[k + 1]
        heapq.heappush(heap, (cost + DELETE, audit + "D", k + 1, state))
        if fault in "bd":
            continue
        cost += LEFT if fault == "t" else 0
        if (kept := _kept(state, initial)) is not None:
            heapq.heappush(heap, (cost, audit + "K", k + 1, kept))
        heapq.heappush(heap, (cost + RESET, audit + "R", k + 1, _next(state)))
    return found


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (conv_id, seg, pos, whole, codes) with the ways through them, and the pairs of initials within that no conversation has."""
    for batch in batches:
        ways, illegal = [], []
        for whole, codes in zip(batch.column("whole").to_pylist(), batch.column("codes").to_pylist()):
            starts, goals = ((START,), (START, ASSISTANT)) if whole else (range(4), tuple(range(4)))
            ways.append([{"start": s, "end": e, "cost": c, "audit": a} for s in starts for e, (c, a) in search(codes, s, goals).items()] if not whole else _cheapest(search(codes, START, goals)))
            initials = codes[::2]
            illegal.append(sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "seg", "pos", "codes")], pa.array(ways, kind), pa.array(illegal, pa.int64())], names=["conv_id", "seg", "pos", "codes", "ways", "illegal"])


def _cheapest(found: dict[int, tuple[int, str]]) -> list[dict]:
    end, (cost, audit) = min(found.items(), key=lambda x: x[1])
    return [{"start": START, "end": end, "cost": cost, "audit": audit}]


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations as lists of solved segments in order, to conv_id, cost, illegal and for each segment (seg, pos, state at its begin, its part of the audit)."""
    for batch in batches:
        costs, bad, parts = [], [], []
        for segments in batch.column("segments").to_pylist():
            best = {START: (0, "", [])}
            for s in segments:
                following: dict[int, tuple] = {}
                for w in s["ways"]:
                    if (before := best.get(w["start"])) is not None:
                        way = (before[0] + w["cost"], before[1] + w["audit"], [*before[2], (w["start"], w["audit"])])
                        following[w["end"]] = min(following.get(w["end"], way), way)
                best = following
            cost, _, path = min(best[e] for e in (START, ASSISTANT) if e in best)
            costs.append(cost)
            bad.append(sum(s["illegal"] for s in segments) + sum(a["codes"][-2] + b["codes"][0] not in ("su", "ua", "au") for a, b in zip(segments, segments[1:])))
            parts.append([{"seg": s["seg"], "pos": s["pos"], "state": state, "audit": audit} for s, (state, audit) in zip(segments, path)])
        kind = pa.list_(pa.struct([("seg", pa.int64()), ("pos", pa.int64()), ("state", pa.int32()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(bad, pa.int64()), pa.array(parts, kind)], names=["conv_id", "cost", "illegal", "parts"])


def fates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of audits to a row for each row that isn't simply deleted: pos, role (its new one; empty: as it was; null: it goes), before and after (initials of rows inserted)."""
    for batch in batches:
        at, roles, before, after = [], [], [], []
        for pos, state, audit, codes in zip(*(batch.column(c).to_pylist() for c in ("pos", "state", "audit", "codes"))):
            k, pending = 0, ""
            for edit in audit:
                if edit == "I":
                    state = _next(state)
                    pending += "ua"[state == ASSISTANT]
                    if 2 * k == len(codes):  # behind the last row
                        after[-1] += pending
                        pending = ""
                    continue
                role = None
                if edit == "K":
                    state, role = _kept(state, codes[2 * k]), ""
                elif edit == "R":
                    state = _next(state)
                    role = "assistant" if state == ASSISTANT else "user"
                at.append(pos + k)
                roles.append(role)
                before.append(pending)
                after.append("")
                k, pending = k + 1, ""
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(roles, pa.string()), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["pos", "new_role", "before", "after"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (conv_id, line), those of a conversation in order and one after the other, to the hash of each conversation."""
    digest, current, begun, kind = None, None, False, None
    for batch in batches:
        ids, hashes = [], []
        kind = batch.schema.field("conv_id").type
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if not begun or conv != current:
                if begun:
                    ids.append(current)
                    hashes.append(digest.hexdigest())
                digest, current, begun = hashlib.sha256(line.encode()), conv, True
            else:
                digest.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def plan(ordered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edits of ordered rows: for each conversation its counts, cost and audit, and for each row pos, new_role, before and after."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    coded = cut(faults(ordered))
    stats = coded.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.substring("code", 2, 1) == k).alias(name) for k, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
        (F.min("seg") == F.max("seg")).alias("whole"),
    )
    stats = cut(stats)
    runs = coded.groupBy("conv_id", "seg").agg(F.min("pos").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"))
    whole = stats.select(F.col("conv_id").alias("_id"), "whole")
    runs = runs.join(whole, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "seg", "pos", "whole", "codes")
    ways = cut(runs.mapInArrow(solved, f"conv_id {kind}, seg long, pos long, codes string, ways array<struct<start int, end int, cost long, audit string>>, illegal long"))
    lists = ways.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "pos", "codes", "ways", "illegal"))).alias("segments"))
    solution = cut(lists.mapInArrow(joined, f"conv_id {kind}, cost long, illegal long, parts array<struct<seg long, pos long, state int, audit string>>"))
    release(coded)
    known = solution.select(F.col("conv_id").alias("_id"), "cost", "illegal", F.array_join(F.transform("parts", lambda p: p["audit"]), "").alias("audit"))
    totals = stats.drop("whole").join(known, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    parts = solution.select(F.explode("parts").alias("p")).select("p.pos", "p.state", "p.audit").join(ways.select("pos", "codes"), "pos")
    return totals, parts.mapInArrow(fates, "pos long, new_role string, before string, after string")


def repaired(ordered: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, pos, n, role, text: the rows that are left, with those inserted, in order of pos and n."""
    inserted = lambda c, at: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x, i: F.struct((i + at).alias("n"), F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("new_role").isNotNull(), F.array(F.struct(F.lit(0).alias("n"), F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role")).alias("role"), "text"))).otherwise(F.array())
    lines = F.concat(inserted("before", -1_000_000), own, inserted("after", 1))
    return ordered.join(rows, "pos").select("conv_id", "pos", F.explode(lines).alias("x")).select("conv_id", "pos", "x.*")


def repair(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Damage conversations (conv_id, turn, role, text) and repair them: a row for each conv_id."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ordered = in_order(damage(conversations), segment)
    totals, rows = plan(ordered)
    lines = repaired(ordered, rows).select("conv_id", "pos", "n", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos", "n").select("conv_id", "line")
    digests = lines.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string").withColumnRenamed("conv_id", "_h")
    out = conversations.select("conv_id").distinct().join(totals.withColumnRenamed("conv_id", "_t"), F.col("conv_id").eqNullSafe(F.col("_t")), "left")
    out = out.join(digests, F.col("conv_id").eqNullSafe(F.col("_h")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NO_HASH)).alias("repaired_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def _least(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"


def _way(state: str, cost: str, edit: str, line: str, when: str = "TRUE") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} END"


def _inserted(source: str) -> str:
    """The source with columns i2, i3: the states after u and after a when rows may have been inserted."""
    new = {2: "'user:' || chr(10)", 3: "'assistant:' || chr(10)"}
    return f"(SELECT *, {_least('s3', _way('i2', '5', 'I', new[3]))} AS i3 FROM (SELECT *, {_least('s2', *[_way(s, '5', 'I', new[2]) for s in ('s0', 's1', 's3')])} AS i2 FROM {source}))"


_ROW, _ANEW = "role || ':' || text || chr(10)", "'{}:' || text || chr(10)"
_STAYS, _LEFT = "f NOT IN ('b', 'd')", "CASE WHEN f = 't' THEN 5 ELSE 0 END"
_STEPS = {
    "s0": [("s0", "2", "D", "''", "TRUE"), ("s0", _LEFT, "K", _ROW, f"{_STAYS} AND i = ''")],
    "s1": [("s1", "2", "D", "''", "TRUE"), ("s1", _LEFT, "K", _ROW, f"{_STAYS} AND i = ''"), ("s0", _LEFT, "K", _ROW, f"{_STAYS} AND i = 's'")],
    "s2": [("i2", "2", "D", "''", "TRUE"), ("i2", _LEFT, "K", _ROW, f"{_STAYS} AND i = ''"), *[x for s in ("s0", "s1", "i3") for x in ((s, _LEFT, "K", _ROW, f"{_STAYS} AND i = 'u'"), (s, f"1 + {_LEFT}", "R", _ANEW.format("user"), _STAYS))]],
    "s3": [("i3", "2", "D", "''", "TRUE"), ("i3", _LEFT, "K", _ROW, f"{_STAYS} AND i = ''"), ("i2", _LEFT, "K", _ROW, f"{_STAYS} AND i = 'a'"), ("i2", f"1 + {_LEFT}", "R", _ANEW.format("assistant"), _STAYS)],
}
#: The same by dynamic programming over rows and states.
SQL = f"""
WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations),
h AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(k, lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM n, z),
g AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS c FROM h WHERE d <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS again,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM p),
r AS (SELECT *, left(role, 1) AS i, CASE WHEN said = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS f, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM o),
s AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL SELECT conv_id, k, {', '.join(f"{_least(*[_way(*w) for w in ways])} AS {name}" for name, ways in _STEPS.items())}
  FROM {_inserted("(SELECT s.conv_id, r.k, role, text, i, f, s0, s1, s2, s3 FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.k = s.k + 1)")}),
e AS (SELECT conv_id, {_least('s0', 'i3')} AS w FROM {_inserted("(SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY conv_id))")}),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(left(w.t, length(w.t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""
