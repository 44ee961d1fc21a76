"""Corrections at a moment, times for corrected words, and people by tracks and voices, against plain loops."""

import itertools
import random

import numpy as np
import pytest

from talkgrid.operators import corrections, diagnostics, folds, tracking
from talkgrid.operators.folds import around

SEGMENTS = "recording_id bigint, seq bigint, text string, start_s double, end_s double"


def same(wanted, core):
    return wanted == core or bool(wanted) and wanted[1:] == core[1:] and wanted[0].islower() and core[:1] == wanted[0].upper()


def plain_corrections(lines, rules):
    """Words of each line with the heard stretch that they stand for."""
    words = [[(w, float(k), k + 1.0) for k, w in enumerate(t.split())] for _, t, *_ in lines]
    flat = lambda: [(i, k) for i, line in enumerate(words) for k in range(len(line))]

    def put(spot, wrong, right):
        old = [words[i][k] for i, k in spot]
        (i, k), here = spot[0], [s for s in spot if s[0] == spot[0][0]]
        begin, span = old[0][1], words[i][here[-1][1]][2] - old[0][1]
        new = list(right)
        if around(old[0][0])[1][:1].isupper() and wrong[0][0].islower():
            new[0] = new[0][0].upper() + new[0][1:]
        new[0] = new[0] if new[0].startswith(around(old[0][0])[0]) else around(old[0][0])[0] + new[0]
        new[-1] = new[-1] if new[-1].endswith(around(old[-1][0])[2]) else new[-1] + around(old[-1][0])[2]
        for j, m in reversed(spot):
            del words[j][m]
        words[i][k:k] = [(w, begin + span * n / len(new), begin + span * (n + 1) / len(new)) for n, w in enumerate(new)]
        return i, k + len(new)

    def found(at, wrong):
        spots = flat()
        spot = spots[spots.index(at) :][: len(wrong)]
        return spot if len(spot) == len(wrong) and all(same(x, around(words[i][k][0])[1]) for x, (i, k) in zip(wrong, spot)) else None

    for _, wrong, right, at in sorted(rules, key=lambda r: r[0]):
        if not wrong or not right or wrong == right:
            continue
        if at is None:
            place = (0, 0)
            while True:
                spots = [s for s in flat() if s >= place]
                spot = next((f for f in (found(s, wrong) for s in spots) if f), None)
                if spot is None:
                    break
                place = put(spot, wrong, right)
            continue
        best = None
        for i, k in flat():
            _, text, start, end = lines[i]
            if start - 3 <= at <= end + 3 and (spot := found((i, k), wrong)):
                away = abs(start + (end - start) * words[i][k][1] / max(1, len(text.split())) - at)
                if best is None or away < best[0]:
                    best = (away, spot)
        if best:
            put(best[1], wrong, right)
    return words


def test_corrections_against_a_loop(spark):
    rng = random.Random(4)
    vocabulary = ["the", "The", "cat", "(cat)", "Cat's", "sat,", "on", "mat.", "—", "teh", "dog’s", "a"]
    rows, listed, want = [], [], {}
    general = [(5, ["teh"], ["the"], None), (6, ["the", "cat"], ["that", "old", "tom"], None), (7, ["on"], ["on"], None)]
    for r in range(25):
        lines = []
        at = 0.0
        for seq in range(rng.randrange(1, 6)):
            n = rng.randrange(0, 8)
            lines.append((seq, " ".join(rng.choice(vocabulary) for _ in range(n)), at, at + n * 0.7))
            at += n * 0.7 + rng.random()
        own = [(k, [rng.choice(["cat", "the", "sat", "mat", "a"]) for _ in range(rng.randrange(1, 3))], [rng.choice(["dog", "lay", "Rug"]) for _ in range(rng.randrange(1, 4))], rng.choice([None, rng.random() * at, at + 2.5])) for k in range(rng.randrange(0, 4))]
        rows += [(r, *x) for x in lines]
        listed += [(r, *x) for x in own]
        words = plain_corrections(lines, own + general)
        want |= {(r, lines[i][0], k): (w, round(a, 9), round(b, 9)) for i, line in enumerate(words) for k, (w, a, b) in enumerate(line)}
    listed += [(None, *g) for g in general]
    rules = spark.createDataFrame(listed, "recording_id bigint, ord int, wrong array<string>, right array<string>, at_s double")
    found = {(x.recording_id, x.seq, x.piece_ix): (x.text, round(x.from_word, 9), round(x.to_word, 9)) for x in corrections.corrected_words(spark.createDataFrame(rows, SEGMENTS), rules).collect()}
    assert found == want


def test_corrected_words_take_the_times_of_those_heard(spark):
    s = spark.createDataFrame([(1, 0, "my the cat sat", 0.0, 8.0), (1, 1, "the end", 8.0, 10.0)], SEGMENTS)
    rules = spark.createDataFrame([(0, ["the", "cat"], ["one", "two", "three"], None), (1, ["the"], ["an", "other"], 8.5)], "ord int, wrong array<string>, right array<string>, at_s double")
    words = spark.createDataFrame([(1, 0, k, k * 2.0, k * 2.0 + 1) for k in range(4)] + [(1, 1, 0, 8.0, 9.0)], "recording_id bigint, seq bigint, word_ix int, start_s double, end_s double")
    found = corrections.retimed(corrections.corrected_words(s, rules), words, s).orderBy("seq", "piece_ix").collect()
    assert [(x.text, x.offset, round(x.start_s, 4), round(x.end_s, 4)) for x in found] == [
        ("my", 0, 0.0, 1.0), ("one", 3, 2.0, 2.6667), ("two", 7, 2.6667, 4.3333), ("three", 11, 4.3333, 5.0), ("sat", 17, 6.0, 7.0),
        ("an", 0, 8.0, 8.5), ("other", 3, 8.5, 9.0), ("end", 9, 9.0, 10.0),
    ]


def test_words_heard_meet_their_segment_once(spark):
    """Words as rows were sent and sorted three times. A segment that lacks its first word, but has as many as it should, finds the others by their numbers."""
    s = spark.createDataFrame([(1, 0, "one two three", 0.0, 3.0), (1, 1, "four", 3.0, 4.0)], SEGMENTS)
    words = spark.createDataFrame([(1, 0, k, k * 2.0, k * 2.0 + 1) for k in (3, 1, 2)], "recording_id bigint, seq bigint, word_ix int, start_s double, end_s double")
    rules = spark.createDataFrame([(0, ["x"], ["y"])], "ord int, wrong array<string>, right array<string>")
    found = corrections.retimed(corrections.corrected_words(s, rules), words, s)
    assert [(x.text, x.start_s, x.end_s) for x in found.orderBy("seq", "piece_ix").collect()] == [("one", None, None), ("two", 2.0, 3.0), ("three", 4.0, 5.0), ("four", 3.0, 4.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def unit(v):
    return v / np.linalg.norm(v) if np.linalg.norm(v) else v


@pytest.fixture(scope="module")
def meeting(spark):
    """Tracked spans with some tracks that hold two voices, and the voices of every half second."""
    rng = np.random.default_rng(5)
    tracked, voices = [], []
    for r in range(6):
        who = rng.normal(size=(4, 5))
        for w in range(12):
            for slot in range(int(rng.integers(1, 4))):
                at = w * 10 + float(rng.integers(0, 5))
                for _ in range(int(rng.integers(1, 3))):
                    end = at + float(rng.choice([0.5, 1.0, 2.0, 3.5]))
                    tracked.append((r, w, slot, (slot + w // 4) % 5, at, end))
                    at = end + float(rng.choice([0.0, 0.5]))
        speaker = lambda t: (int(t) // 17 + r) % 4
        voices += [(r, k * 0.5, k * 0.5 + 0.5, (who[speaker(k * 0.5)] + rng.normal(size=5) * 0.2).tolist()) for k in range(280) if k % 9]
    t = spark.createDataFrame(tracked, "recording_id bigint, window_ix int, slot int, track int, start_s double, end_s double")
    return tracked, voices, t, spark.createDataFrame(voices, "recording_id bigint, start_s double, end_s double, embedding array<double>")


def voice_of(voices, r, start, end):
    own = [unit(np.array(e)) for q, a, b, e in voices if q == r and start <= (a + b) / 2 < end and a < end and b > start]
    return np.mean(own, axis=0) if own else None


def plain_split(tracked, voices, r):
    own = [x for x in tracked if x[0] == r]
    number = max(x[3] for x in own)
    groups = {}
    for track in {x[3] for x in own}:
        merged = []
        for a, b in sorted((x[4], x[5]) for x in own if x[3] == track):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        best = sorted(sorted((m for m in merged if m[1] - m[0] >= 1.5), key=lambda m: (m[0] - m[1], m[0]))[:12])
        heard = [(m, v) for m in best if (v := voice_of(voices, r, *m)) is not None]
        if len(heard) < 2:
            continue
        labels = folds.average_linkage(np.array([v for _, v in heard]), 0.65)
        held = sorted((sum(m[1] - m[0] for (m, _), x in zip(heard, labels) if x == k) for k in set(labels.tolist())), reverse=True)
        if len(held) > 1 and held[1] >= 2.0:
            groups[track] = [(m, int(x)) for (m, _), x in zip(heard, labels)]
    new, out = {}, {}
    for w, slot in sorted({x[1:3] for x in own}):
        for track in sorted({x[3] for x in own if x[1:3] == (w, slot)}):
            spans = [x for x in own if x[1:4] == (w, slot, track)]
            middle = (min(x[4] for x in spans) + max(x[5] for x in spans)) / 2
            group = min(groups[track], key=lambda g: (abs((g[0][0] + g[0][1]) / 2 - middle), g[0][0]))[1] if track in groups else 0
            if group and (track, group) not in new:
                number += 1
                new[track, group] = number
            out[w, slot, track] = new.get((track, group), track)
    return {(x[1], x[2], x[4], x[5]): out[x[1:4]] for x in own}


def test_tracks_of_two_voices_are_split(meeting):
    tracked, voices, t, v = meeting
    found = {}
    for x in tracking.split_tracks(t, v).collect():
        found.setdefault(x.recording_id, {})[x.window_ix, x.slot, x.start_s, x.end_s] = x.track
    want = {r: plain_split(tracked, voices, r) for r in range(6)}
    assert found == want
    assert any(track > 4 for own in want.values() for track in own.values())


def plain_merge(tracked, voices, r, wanted):
    own = [x for x in tracked if x[0] == r]
    sound = {}
    for track in {x[3] for x in own}:
        best = sorted((x for x in own if x[3] == track), key=lambda x: (x[4] - x[5], x[1], x[2], x[4]))[:8]
        units = [unit(e) for x in best if (e := voice_of(voices, r, x[4], x[5])) is not None]
        if units:
            sound[track] = unit(np.sum(units, axis=0))
    known = sorted(sound)
    if len({x[3] for x in own}) <= wanted or len(known) <= wanted:
        return {t: t for t in {x[3] for x in own}}
    held = {k: sum(x[5] - x[4] for x in own if x[1:4] == k) for k in {x[1:4] for x in own}}
    active = {w: {k[2] for k, s in held.items() if k[0] == w and s >= 0.35} for w in {x[1] for x in own}}
    near = {t: {o for a in active.values() if t in a for o in a if o != t and o in sound} for t in known}
    people, members = {}, {p: [] for p in range(wanted)}
    for t in sorted(known, key=lambda t: (-len(near[t]), t)):
        barred = [people[o] for o in near[t] if o in people]
        legal = [p for p in members if p not in barred]
        far = {p: np.mean([1 - sound[t] @ sound[o] for o in members[p]]) for p in legal if members[p]}
        empty = [p for p in legal if not members[p]]
        if not legal:
            pick = min(members, key=barred.count)
        elif empty and (not far or min(far.values()) > 0.65):
            pick = empty[0]
        else:
            pick = min(far, key=far.get)
        people[t] = pick
        members[pick].append(t)
    order = sorted((p for p in members if members[p]), key=lambda p: -len(members[p]))
    named = {t: order.index(p) for t, p in people.items()}
    spare = itertools.count(max(named.values()) + 1)
    return named | {t: next(spare) for t in sorted({x[3] for x in own} - named.keys())}


@pytest.mark.parametrize("wanted", [2, 3])
def test_tracks_are_merged_by_voice(spark, meeting, wanted):
    tracked, voices, t, v = meeting
    asked = spark.createDataFrame([(r, wanted) for r in range(5)], "recording_id bigint, wanted int")
    found = {}
    for x in tracking.merge_tracks(t, v, asked).collect():
        found.setdefault(x.recording_id, {})[x.window_ix, x.slot, x.start_s, x.end_s] = x.track
    for r in range(6):
        named = plain_merge(tracked, voices, r, wanted) if r < 5 else {k: k for k in range(9)}
        assert found[r] == {(x[1], x[2], x[4], x[5]): named[x[3]] for x in tracked if x[0] == r}


def test_people_end_to_end(spark):
    """Two who take turns, one of them silent for longer than a window: one track too many until they are counted."""
    spans, voices = [], []
    for w in range(8):
        for slot, speaker in ((0, 0), (1, 1)):
            if speaker == 1 and 2 <= w <= 4:
                continue
            at = w * 5.0 + speaker * 2.0
            for k in (0, 1):  # windows of ten seconds with five in common
                spans.append((1, w + k - 1, slot, at, at + 1.8))
            voices.append((1, at, at + 1.8, [1.0, 0.1] if speaker == 0 else [0.1, 1.0]))
    s = spark.createDataFrame([x for x in spans if x[1] >= 0], "recording_id bigint, window_ix int, slot int, start_s double, end_s double")
    roster = spark.createDataFrame([(1, w, k) for w in range(9) for k in (0, 1)], "recording_id bigint, window_ix int, slot int")
    v = spark.createDataFrame(voices, "recording_id bigint, start_s double, end_s double, embedding array<double>")
    linked = folds.link_tracks(s, roster)
    assert linked.where("track >= 0").select("track").distinct().count() == 3
    for people in (2, None):
        found = tracking.tracked_people(s, roster, v, people).collect()
        assert len({x.track for x in found}) == 2
        assert {(x.start_s % 5 >= 2, x.track) for x in found} in ({(False, 0), (True, 1)}, {(False, 1), (True, 0)})
    turns = tracking.diarized(s, roster, v, 2).orderBy("start_s").collect()
    assert len(turns) == 13 and {x.number for x in turns} == {0, 1}


def test_voices_like_an_example(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for r in range(8):
        near = 0.05 if r % 2 else 1.5
        centres = np.eye(4)[:2]
        own = [centres[k % 2] + rng.normal(size=4) * near for k in range(9)]
        example = int(rng.integers(9))
        rows += [(r, k, x.tolist(), k == example) for k, x in enumerate(own)]
        u = [unit(x) for x in own]
        groups = [[k] for k in range(9)]
        while len(groups) > 2:
            a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: np.mean([1 - u[i] @ u[j] for i in groups[p[0]] for j in groups[p[1]]]))
            groups[a] += groups.pop(b)
        mine = next(g for g in groups if example in g)
        other = next(g for g in groups if example not in g)
        clear = np.mean([1 - u[i] @ u[j] for i in mine for j in other]) >= 0.5
        want |= {(r, k): bool(k in mine and clear) for k in range(9)}
    found = folds.split_by_example(spark.createDataFrame(rows, "recording_id bigint, voice_ix bigint, embedding array<double>, example boolean"))
    assert {(x.recording_id, x.voice_ix): x.same for x in found.collect()} == want and {True, False} == set(want.values())


def test_reports_of_a_run(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "one two", 0.0, 1.0), (1, 1, "x" * 50, 1.0, 2.0), (1, 2, "", 2.0, 2.5), (2, 0, "three", 0.0, 1.0)], SEGMENTS)
    kind = "recording_id bigint, seq bigint, word_ix int, start_s double, end_s double"
    measured = spark.createDataFrame([(1, 0, 1, 0.5, 0.9), (1, 0, 0, 0.1, 0.4)], kind)
    heard = spark.createDataFrame([(1, 0, 0, 7.0, 8.0), (2, 0, 0, 0.25, 0.75)], kind)
    estimated = spark.createDataFrame([(1, 1, 0, 1.0, 2.0)], kind)
    spans = diagnostics.shown_spans(s, measured, heard, estimated)
    assert [(x.seq, x.kind, x.words_from, x.words_to, len(x.head)) for x in spans.where("recording_id = 1").orderBy("seq").collect()] == [(0, "measured", 0.1, 0.9, 7), (1, "estimate", 1.0, 2.0, 38), (2, None, None, None, 0)]
    diagnostics.write_lines(diagnostics.span_lines(spans), f"{tmp_path}/spans")
    lines = [x.value for x in spark.read.text(f"{tmp_path}/spans/recording_id=1").collect()]
    assert lines[:2] == ["measured 1 of 3 segments", 'measured 0.00-1.00 words 0.10-0.90 "one two"'] and lines[3] == 'ESTIMATE 2.00-2.50 words none ""'
    updates = spark.createDataFrame([(1, 0, "provisional", " so", 0.0, 1.0), (1, 1, "committed", "so it ", 0.0, 1.0), (1, 1, "committed", "is", 1.0, 2.0), (1, 3, "committed", "done", 2.0, 3.0)], "recording_id bigint, pass_ix int, kind string, text string, start_s double, end_s double")
    log = diagnostics.session_log(updates).orderBy("pass_ix").collect()
    assert [(x.pass_ix, x.provisional, x.new, x.committed) for x in log] == [(0, " so", "", ""), (1, "", "so it is", "so it is"), (3, "", "done", "so it is done")]


def test_renaming_by_voice(spark):
    """Recording 1: two voices under one name; 2: one voice; 3: no other paragraph of that name."""
    rng = np.random.default_rng(1)
    who = {1: "ababab", 2: "aaaaaa", 3: "a"}
    paras, segments, voices = [], [], []
    for r, letters in who.items():
        for k, x in enumerate(letters):
            paras.append((r, k, "S", k * 10.0, k * 10.0 + 8))
            segments += [(r, 2 * k + j, "S", k * 10.0 + 4 * j, k * 10.0 + 4 * j + 3.5) for j in (0, 1)]
            voices += [(r, k * 10.0 + j, k * 10.0 + j + 1, (np.eye(3)[int(x == "b")] + rng.normal(size=3) * 0.1).tolist()) for j in range(8)]
        paras.append((r, 9, "T", 90.0, 99.0))
        segments.append((r, 99, "T", 91.0, 95.0))
    kind = "start_s double, end_s double"
    found = tracking.rename_by_voice(
        spark.createDataFrame(segments, f"recording_id bigint, seq bigint, speaker string, {kind}"), spark.createDataFrame(paras, f"recording_id bigint, para_ix int, speaker string, {kind}"),
        spark.createDataFrame(voices, f"recording_id bigint, {kind}, embedding array<double>"), spark.createDataFrame([(r, 1.0, 5.0, "Ann") for r in who], f"recording_id bigint, {kind}, name string"),
    ).collect()
    named = {(x.recording_id, x.seq) for x in found if x.speaker == "Ann"}
    assert named == {(1, s) for s in (0, 1, 4, 5, 8, 9)} | {(2, 0), (2, 1), (3, 0), (3, 1)}
    assert len(found) == len(segments) and all(x.speaker == "T" for x in found if x.seq == 99)


def test_renaming_asks_for_paragraphs_and_segments_once(spark):
    read = {name: spark.sparkContext.accumulator(0) for name in ("segments", "paragraphs")}

    def counted(name, df):
        def count(batches):
            for batch in batches:
                read[name].add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema)

    kind = "start_s double, end_s double"
    paras = spark.createDataFrame([(r, k, "S", k * 10.0, k * 10.0 + 8) for r in (1, 2) for k in range(4)], f"recording_id bigint, para_ix int, speaker string, {kind}")
    segments = spark.createDataFrame([(r, k, "S", k * 10.0, k * 10.0 + 8) for r in (1, 2, 3) for k in range(4)], f"recording_id bigint, seq bigint, speaker string, {kind}")
    voices = spark.createDataFrame([(r, k * 10.0 + 1, k * 10.0 + 3, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for r in (1, 2) for k in range(4)], f"recording_id bigint, {kind}, embedding array<double>")
    asks = spark.createDataFrame([(1, 10.0, 18.0, "Ann")], f"recording_id bigint, {kind}, name string")
    found = tracking.rename_by_voice(counted("segments", segments), counted("paragraphs", paras), voices, asks)
    assert sorted((x.recording_id, x.seq, x.speaker) for x in found.collect()) == [(r, k, "Ann" if r == 1 and k % 2 else "S") for r in (1, 2, 3) for k in range(4)]
    assert (read["segments"].value, read["paragraphs"].value) == (12, 8)
