"""Neighbours, hard negatives and repaired conversations against plain definitions, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from talkgrid.llm import hardnegatives, neighbours, repair
from talkgrid.llm.tables import table

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int, score double, class string, width string"
NAN, INF = float("nan"), float("inf")
ODD = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [NAN, 1.0], 1), (5, [INF, 1.0], 1), (6, [], 1), (7, [1.0], 1), (None, [1.0, 0.0], 1), (20, [1.0, 0.5], None)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", "y") for r in rows], VECTORS)


def brute_nearest(rows, every, top):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = set()
    for i, q in good:
        if i % every == 0:
            near = sorted({(-float(np.cumsum(q * x)[-1]), j) for j, x in good if j != i and len(x) == len(q)})[:top]
            out |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(near)}
    return out


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, width))
    return (centres[rng.integers(0, 20, n)] + 0.3 * rng.normal(size=(n, width))) * rng.uniform(0.5, 2, (n, 1))


def test_neighbours_recall(spark):
    x = clustered(3000, 12, 1).astype(np.float32).tolist()
    rows = [(i, v, 0) for i, v in enumerate(x)]
    want = brute_nearest(rows, 20, 20)
    for limits in ({}, {"chunk": 40, "asked": 30, "codes": 8}):
        found = {tuple(r) for r in neighbours.nearest(vectors(spark, rows), **limits).collect()}
        assert len({f[:2] for f in found}) == len(found) == len(want)
        assert len({(f[0], f[2]) for f in found} & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)
        known = {i: np.array(v, float) for i, v, _ in rows}
        assert all(s == np.cumsum(known[q] * known[i])[-1] for q, _, i, s in found)


def test_neighbours_structure_saves_work(spark):
    x = clustered(3000, 12, 1)
    index = neighbours.Index(12, 3000, float(np.linalg.norm(x, axis=1).max()), x, 8)
    first, second = index.codes(x)
    index.cells = np.zeros((8, 8), np.int64)
    np.add.at(index.cells, (first, second), 1)
    index.budget = 300
    a, b = index.asked(x[:50])
    for k in range(50):
        sums = (a[k][:, None] + b[k][None, :]).ravel()
        order = [c for c in np.argsort(sums) if index.cells.ravel()[c]]
        held = np.cumsum(index.cells.ravel()[order])
        want = set(order[: int(np.searchsorted(held, 300)) + 1])
        assert {8 * i + j for i, bits in index.visits(a[k], b[k]).items() for j in range(8) if bits >> j & 1} == want


def test_neighbours_copies_ties_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(3)), float(rng.randrange(3))], 0) for i in range(200)] + [(i, [1.0, 1.0], 0) for i in range(200, 400)] + ODD + [(40, [3.0], 0), (20, [1.0, 0.5], 0)]
    want = brute_nearest(rows, 20, 20)
    for small in (2, 1000):
        assert {tuple(r) for r in neighbours.nearest(vectors(spark, rows), small=small, recall=1.0).collect()} == want
    assert neighbours.nearest(vectors(spark, ODD)).count() == 0
    assert neighbours.nearest(vectors(spark, []).limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.nearest(vectors(spark, []).limit(0)).count() == 0


def brute_negatives(rows):
    good = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(int(np.floor(256 * c)) for c in v)) for i, v, y in rows if None not in (i, v, y) and None not in v and np.isfinite(v).all()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for i, y, v in good:
        if i % 100:
            continue
        near = sorted((-dot(v, w), j, z) for j, z, w in good if j != i and len(w) == len(v))
        for p, j, _ in [n for n in near if n[2] == y][:5]:
            bad = [(s, k) for s, k, z in near if z != y and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out |= {(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(bad)}
    return out


@pytest.mark.parametrize("limits", [{}, {"block": 30, "asked": 2, "pivots": 4}])
def test_hard_negatives(spark, limits):
    x = clustered(900, 6, 2).astype(np.float32).tolist()
    rng = random.Random(3)
    rows = [(i, v, rng.randrange(4)) for i, v in enumerate(x)] + [(i, [0.5, 0.5], rng.randrange(3)) for i in range(1000, 1330)] + [(1400 + i, [rng.random() * (i > 20), 0.3], i % 3) for i in range(60)] + [(1400, [1.0, 0.25], 2), *ODD]
    assert {tuple(r) for r in hardnegatives.mine(vectors(spark, rows), **limits).collect()} == brute_negatives(rows)


def test_hard_negatives_odd_rows(spark):
    huge = [(100, [3e37, 1.0], 1), (101, [1.0, 1.0], 1), (200, [4e6, 1.0], 1), (201, [4e6, 2.0], 1), (202, [4e6, 1.5], 2), (300, [-1.0, 0.0], 1), (301, [1.0, 0.0], 1)]
    assert {tuple(r) for r in hardnegatives.mine(vectors(spark, huge)).collect()} == brute_negatives(huge[1:])
    assert hardnegatives.mine(vectors(spark, ODD)).count() == 0
    assert hardnegatives.mine(vectors(spark, []).limit(0)).count() == 0


SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = ("user" if fate == 4 else " " if role is None else role), (" " if text is None else text)
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {conv: sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for conv, kept in out.items()}


def fault_of(rows):
    seen, faults = set(), ""
    for _, role, text in rows:
        left = text.rstrip(SPACE)
        faults += "b" if not left else "d" if (role, text) in seen else "." if left[-1] in ".!?" else "t"
        seen.add((role, text))
    return faults


def cheapest(rows):
    """All edits of short conversations, one after the other: cost, audit and text."""
    faults, best = fault_of(rows), None
    stack = [(0, "", 0, "", ())]
    while stack:
        cost, audit, k, initials, out = stack.pop()
        if not re.fullmatch("s?(ua)*u?", initials) or cost > 2 * len(rows) or audit.count("I") > 3:
            continue
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best or (cost, audit, out), (cost, audit, out))
        stack += [(cost + 5, audit + "I", k, initials + r[0], (*out, (r, ""))) for r in ("user", "assistant")]
        if k < len(rows):
            _, role, text = rows[k]
            stack.append((cost + 2, audit + "D", k + 1, initials, out))
            if faults[k] not in "bd":
                cost += 5 * (faults[k] == "t")
                stack.append((cost, audit + "K", k + 1, initials + role[:1], (*out, (role, text))))
                stack += [(cost + 1, audit + "R", k + 1, initials + r[0], (*out, (r, text))) for r in ("user", "assistant")]
    return best[0], best[1], "\n".join(f"{r}:{t}" for r, t in best[2])


def by_states(rows):
    """The same over rows and ends of the initials, for longer conversations."""
    faults = fault_of(rows)

    def put(best, end, way):
        if end not in best or way[:2] < best[end][:2]:
            best[end] = way

    def inserted(best):
        for _ in range(3):
            for end, (cost, audit, out) in list(best.items()):
                role = "assistant" if end == "u" else "user"
                put(best, role[0], (cost + 5, audit + "I", (*out, (role, ""))))

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        inserted(best)
        now = {}
        for end, (cost, audit, out) in best.items():
            put(now, end, (cost + 2, audit + "D", out))
            if fault in "bd":
                continue
            cost += 5 * (fault == "t")
            new = "assistant" if end == "u" else "user"
            if role[:1] == new[0] or role[:1] == "" or role[:1] == "s" and end == "":
                put(now, role[:1] or end, (cost, audit + "K", (*out, (role, text))))
            put(now, new[0], (cost + 1, audit + "R", (*out, (new, text))))
        best = now
    inserted(best)
    cost, audit, out = min(best[end] for end in ("", "a") if end in best)
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def expected(rows, solve):
    want = {}
    for conv, kept in damaged(rows).items():
        turns, initials, faults = [t for t, *_ in kept if t is not None], [r[:1] for _, r, _ in kept], fault_of(kept)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, text = solve(kept)
        want[conv] = (gaps, *[faults.count(k) for k in "bdt"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return want


COLUMNS = "conv_id bigint, turn bigint, role string, text string, pos string, cost string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS)


def some_rows(n, convs, seed):
    rng = random.Random(seed)
    return [(rng.choice(convs), rng.choice([None, *range(40)]), rng.choice([None, "", "s", "user", "user", "assistant", "assistant", "system", "tool", "ux"]), rng.choice([None, "", " \x0b", "a.", "b!", "c", "d", "e?\n", f"é {k}.", f"{k}?"])) for k in range(n)]


def test_repair_of_short_conversations(spark):
    rows = some_rows(240, [None, *range(79)], 5)
    want = expected(rows, cheapest)
    assert {r[0]: tuple(r)[1:] for r in repair.repair(conversations(spark, rows)).collect()} == want
    assert want == expected(rows, by_states)


@pytest.mark.parametrize("segment", [4, 2048])
def test_repair_of_long_conversations(spark, segment):
    rows = some_rows(700, [None, 1, 2], 6)
    assert {r[0]: tuple(r)[1:] for r in repair.repair(conversations(spark, rows), segment).collect()} == expected(rows, by_states)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in repair.op13(spark, SF).collect()} == expected(rows, by_states)


def test_repair_of_odd_rows(spark):
    same = [(3, 1, "user", "Hello.")] * 500
    rows = same + [(4, 1, None, None), (5, None, "assistant", "A. " * 100_000)]
    assert {r[0]: tuple(r)[1:] for r in repair.repair(conversations(spark, rows)).collect()} == expected(rows, by_states)
    assert repair.repair(conversations(spark, []).limit(0)).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"9:{k}".encode()) % 20 == 0)
    assert [tuple(r) for r in repair.repair(conversations(spark, [(9, gone, "user", "x")])).collect()] == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_search_takes_the_ascii_least_of_the_cheapest():
    assert repair.search("u.u.a.", repair.START, (repair.START, repair.ASSISTANT))[repair.ASSISTANT] == (2, "DKK")
    assert repair.search("", repair.START, (repair.START,)) == {repair.START: (0, "")}
    assert repair.search("utat", repair.START, (repair.START, repair.ASSISTANT)) [repair.START] == (4, "DD")


def test_rows_without_faults_are_left(spark):
    fine = [k for k in range(200) if zlib.crc32(f"7:{k}".encode()) % 20 > 4][:4]
    found = repair.repair(conversations(spark, [(7, t, "user" if k % 2 == 0 else "assistant", f"{k}.") for k, t in enumerate(fine)])).first()
    assert (found.cost, found.audit, found.illegal) == (0, "KKKK", 0)
    assert found.repaired_sha256 == hashlib.sha256("\n".join(f"{'user' if k % 2 == 0 else 'assistant'}:{k}." for k in range(4)).encode()).hexdigest()
