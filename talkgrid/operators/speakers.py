"""Who is who: matching, merging and grouping of a recording's speakers, and sentences given back to who began them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgrid.operators import frames
from talkgrid.operators.folds import _finishes, filled, ordered_fold
from talkgrid.operators.intervals import islands


def distinct_spans(spans: DataFrame, share: float = 0.75) -> DataFrame:
    """Spans (recording_id, span_ix, start_s, end_s), longest first, but those that one kept before covers by a share."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        start, end = rows["start_s"].to_numpy(), rows["end_s"].to_numpy()
        kept: list[int] = []
        for i in np.argsort(start - end, kind="stable").tolist():
            both = np.minimum(end[kept], end[i]) - np.maximum(start[kept], start[i])
            if not ((both > 0) & (both >= (end[i] - start[i]) * share)).any():
                kept.append(i)
        return rows.iloc[sorted(kept, key=lambda i: (start[i], i))][["recording_id", "span_ix", "start_s", "end_s"]]

    return ordered_fold(spans.select("recording_id", "span_ix", "start_s", "end_s"), ["span_ix"], fold, "recording_id bigint, span_ix int, start_s double, end_s double")


def pair_speakers(shared: DataFrame) -> DataFrame:
    """Pairs of labels (recording_id, a, b, frames) matched one to one, those with most frames first."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        for i, (a, b) in enumerate(zip(rows["a"], rows["b"])):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                kept.append(i)
        return rows.iloc[kept][["recording_id", "a", "b", "frames"]]

    found = shared.where("frames > 0").withColumn("_least", -F.col("frames"))
    return ordered_fold(found, ["_least", "a", "b"], fold, "recording_id bigint, a string, b string, frames bigint")


def _distance(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - float(a @ b)


def merge_to_count(turns: DataFrame, prints: DataFrame, wanted: int) -> DataFrame:
    """Turns (recording_id, turn_ix, speaker int, start_s, end_s) of at most wanted speakers: the one with least time joins the
    speaker with the nearest print (recording_id, speaker, embedding), or the nearest in time without one."""

    def merge(key, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = filled(known, "speaker", "embedding")
        columns = ["recording_id", "turn_ix", "speaker", "start_s", "end_s"]
        rows = filled(rows, *columns).sort_values("turn_ix", kind="stable").reset_index(drop=True)
        owner = rows["speaker"].to_numpy().copy()
        start, end = rows["start_s"].to_numpy(), rows["end_s"].to_numpy()
        held = rows.assign(n=end - start).groupby("speaker", sort=False)["n"].sum().to_dict()
        voice = {s: np.array(e, float) for s, e in zip(known["speaker"], known["embedding"]) if s in held}
        while len(held) > wanted:
            least = min(held, key=held.get)
            others = [s for s in held if s != least]
            heard = [s for s in others if s in voice]
            if least in voice and heard:
                into = min(heard, key=lambda s: _distance(voice[least], voice[s]))
            else:
                own = owner == least
                gap = np.maximum(start[:, None] - end[own][None, :], start[own][None, :] - end[:, None]).clip(0).min(axis=1)
                into = owner[~own][gap[~own].argmin()]
            owner[owner == least] = into
            held[into] += held.pop(least)
            voice.pop(least, None)
        rows["speaker"] = owner
        rows = rows.sort_values("start_s", kind="stable")
        rows["speaker"] = pd.factorize(rows["speaker"])[0].astype("int32")
        return rows.sort_values(["start_s", "speaker"], kind="stable")[columns]

    left = turns.select("recording_id", "turn_ix", "speaker", "start_s", "end_s").groupBy("recording_id")
    schema = "recording_id bigint, turn_ix int, speaker int, start_s double, end_s double"
    return left.cogroup(prints.select(*[F.col(c).alias(c) for c in ("recording_id", "speaker", "embedding")]).groupBy("recording_id")).applyInPandas(merge, schema)


def _hardest_first(n: int, near: list[set[int]]) -> list[int]:
    return sorted(range(n), key=lambda i: -len(near[i]))


def _graph(voices: pd.DataFrame, conflicts: pd.DataFrame) -> list[set[int]]:
    place = {t: i for i, t in enumerate(voices["track"])}
    near: list[set[int]] = [set() for _ in place]
    for a, b in zip(conflicts["a"], conflicts["b"]):
        if a in place and b in place:
            near[place[a]].add(place[b])
            near[place[b]].add(place[a])
    return near


def group_tracks(voices: DataFrame, conflicts: DataFrame, wanted: int | None, threshold: float = 0.65) -> DataFrame:
    """People for tracks (recording_id, track, embedding, and without a number for all recordings, wanted), such that tracks in conflict (recording_id, a, b) differ where that is
    possible: those with most conflicts first, each to the nearest person allowed, or to a new one if that is far."""

    own = ["recording_id", "track", "embedding", "wanted"]
    voices = voices if wanted is None else voices.withColumn("wanted", F.lit(wanted))

    def group(key, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        wanted = int(rows["wanted"].iloc[0]) if len(rows) else 0
        rows, pairs = filled(rows, *own).sort_values("track").reset_index(drop=True), filled(pairs, "a", "b")
        near, x = _graph(rows, pairs), [np.array(e, float) for e in rows["embedding"]]
        people, members = [-1] * len(rows), [[] for _ in range(wanted)]
        for t in _hardest_first(len(rows), near):
            barred = [people[o] for o in near[t] if people[o] >= 0]
            legal = [p for p in range(wanted) if p not in barred]
            if not legal:
                pick = min(range(wanted), key=lambda p: barred.count(p))
            else:
                far = {p: np.mean([_distance(x[t], x[o]) for o in members[p]]) for p in legal if members[p]}
                empty = next((p for p in legal if not members[p]), None)
                best = min(far, key=far.get) if far else None
                pick = empty if empty is not None and (best is None or far[best] > threshold) else best
            people[t] = pick
            members[pick].append(t)
        order = sorted((p for p in range(wanted) if members[p]), key=lambda p: -len(members[p]))
        return rows[["recording_id", "track"]].assign(person=[order.index(p) for p in people])

    left = voices.select(*own).groupBy("recording_id")
    return left.cogroup(conflicts.select(*[F.col(c).alias(c) for c in ("recording_id", "a", "b")]).groupBy("recording_id")).applyInPandas(group, "recording_id bigint, track int, person int")


def people_at_least(conflicts: DataFrame) -> DataFrame:
    """How many people tracks in conflict (recording_id, a, b) show at least, by colouring the hardest first."""

    def colour(rows: pd.DataFrame) -> pd.DataFrame:
        tracks = pd.DataFrame({"track": sorted({*rows["a"], *rows["b"]})})
        near, colours = _graph(tracks, rows), {}
        for t in _hardest_first(len(tracks), near):
            taken = {colours.get(o) for o in near[t]}
            colours[t] = next(k for k in range(len(tracks) + 1) if k not in taken)
        return pd.DataFrame({"recording_id": [rows["recording_id"].iloc[0]], "people": [max(colours.values()) + 1]})

    return ordered_fold(conflicts.select("recording_id", "a", "b"), ["a", "b"], colour, "recording_id bigint, people int")


def voted_turns(turns: DataFrame, step: float, track: str = "speaker") -> DataFrame:
    """Turns from votes by frame: most votes win, of equals who held the frame before, else the first track; runs of one frame
    go, and speakers are numbered by first appearance."""
    voted = frames.votes(turns, step, track)
    most = F.max("votes").over(Window.partitionBy("recording_id", "frame"))
    tied = voted.withColumn("_most", most).where("votes = _most").groupBy("recording_id", "frame").agg(F.array_sort(F.collect_list(track)).alias("tied"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        held, at, out = None, None, []
        for frame, tied in zip(rows["frame"], rows["tied"]):
            held = held if at == frame - 1 and held in tied else tied[0]
            at = frame
            out.append(held)
        return rows[["recording_id", "frame"]].assign(speaker=out)

    won = ordered_fold(tied, ["frame"], fold, "recording_id bigint, frame bigint, speaker string")
    w = Window.partitionBy("recording_id").orderBy("frame")
    same = (F.lag("frame").over(w) == F.col("frame") - 1) & (F.lag("speaker").over(w) == F.col("speaker"))
    runs = islands(won.withColumn("_same", same), ["recording_id"], ["frame"], ~F.col("_same"))
    runs = runs.groupBy("recording_id", "island").agg(F.min("speaker").alias("speaker"), (F.min("frame") * step).alias("start_s"), ((F.max("frame") + 1) * step).alias("end_s"), F.count("*").alias("n")).where("n > 1")
    first = F.min("start_s").over(Window.partitionBy("recording_id", "speaker"))
    runs = runs.withColumn("_first", first)
    number = F.dense_rank().over(Window.partitionBy("recording_id").orderBy("_first")) - 1
    return runs.withColumn("number", number).drop("island", "n", "_first")


def finish_sentences(words: DataFrame, pause: float = 1.5, most: int = 4, most_open: int = 1) -> DataFrame:
    """Words (recording_id, seq, word_ix, text, start_s, end_s, speaker) with seq and speaker changed where a sentence was cut:
    its last few words go back to who began it, or a short opening goes on to who finishes it."""

    def lower(word: str) -> bool:
        return next((c.islower() for c in word if c.isalpha()), False)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [{"seq": k, "who": g["speaker"].iloc[0], "rows": g.index.tolist()} for k, g in rows.groupby("seq", sort=False)]
        text, start, end = rows["text"].tolist(), rows["start_s"].tolist(), rows["end_s"].tolist()
        i = 1
        while i < len(parts):
            a, b = parts[i - 1], parts[i]
            last = a["rows"][-1]
            if a["who"] and b["who"] and a["who"] != b["who"] and start[b["rows"][0]] - end[last] <= pause and not _finishes(text[last]):
                ended = max((k for k, r in enumerate(a["rows"]) if _finishes(text[r])), default=-1)
                opening = len(a["rows"]) - 1 - ended
                if ended >= 0 and 0 < opening <= most and lower(text[b["rows"][0]]):
                    b["rows"] = a["rows"][ended + 1 :] + b["rows"]
                    a["rows"] = a["rows"][: ended + 1]
                else:
                    stop = next((k + 1 for k, r in enumerate(b["rows"]) if _finishes(text[r])), None)
                    head = stop or len(b["rows"])
                    if head <= (most if stop else most_open):
                        a["rows"], b["rows"] = a["rows"] + b["rows"][:head], b["rows"][head:]
                        if not b["rows"]:
                            del parts[i]
                            continue
            i += 1
        out = rows.loc[[r for p in parts for r in p["rows"]]].copy()
        out["seq"] = [p["seq"] for p in parts for _ in p["rows"]]
        out["speaker"] = [p["who"] for p in parts for _ in p["rows"]]
        out["word_ix"] = [k for p in parts for k in range(len(p["rows"]))]
        return out[["recording_id", "seq", "word_ix", "text", "start_s", "end_s", "speaker"]]

    schema = "recording_id bigint, seq bigint, word_ix int, text string, start_s double, end_s double, speaker string"
    return ordered_fold(words.select("recording_id", "seq", "word_ix", "text", "start_s", "end_s", "speaker"), ["seq", "word_ix"], fold, schema)
