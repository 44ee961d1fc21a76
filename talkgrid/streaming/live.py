"""Live transcription as a stateful stream: passes over a sliding window commit what has settled.

A row is one pass over a recording's window: recording_id, pass_ix, now_s (seconds of audio so far), window_start_s, final,
and segments, an array of (text, start_s, end_s, avg_logprob, no_speech). A segment that ends SETTLE seconds or more before
now is committed, once: what ends within SLACK of the last commit is a repeat, and words that repeat the committed tail are cut.
Later segments are provisional. A formatted reading of the same window is kept against an unformatted later one.
Passes of a recording must arrive in order; one that is older than the last is ignored, and so is all after a final pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from talkgrid.operators.folds import ordered_fold
from talkgrid.functions.ordered import after_overlap, bare, leading_overlap, trimmed_repeats

SETTLE = 8.0
SLACK = 0.4
TAIL = 60

PASSES = "recording_id bigint, pass_ix int, now_s double, window_start_s double, final boolean, segments array<struct<text:string,start_s:double,end_s:double,avg_logprob:double,no_speech:double>>"
UPDATES = "recording_id bigint, pass_ix int, kind string, text string, start_s double, end_s double"
#: last pass, committed through, tail words, start and reading of the best window, whether it is closed.
STATE = "last_pass int, through double, tail string, best_start double, best array<struct<text:string,start_s:double,end_s:double,avg_logprob:double,no_speech:double>>, closed boolean"
START = (-1, 0.0, "", None, None, False)


def _unformatted(text: str) -> bool:
    return bool(text.strip()) and not any(c in ".,?!;:" for c in text) and not any(c.isupper() for c in text)


def _reading(segments: list[dict], start: float, best_start: float | None, best: list[dict] | None) -> tuple[list[dict], float | None, list[dict] | None]:
    text = " ".join(s["text"].strip() for s in segments)
    if not _unformatted(text):
        return segments, start, segments
    if best is None or best_start != start:
        return segments, best_start, best
    old = " ".join(s["text"].strip() for s in best)
    better = not _unformatted(old) and len(old.split()) >= 0.9 * len(text.split())
    return (best if better else segments), best_start, best


def advance(state: tuple, one: dict) -> tuple[tuple, list[tuple]]:
    """The state after a pass, and the updates that it makes (kind, text, start_s, end_s)."""
    last, through, tail, best_start, best, closed = state
    if closed or one["pass_ix"] <= last:
        return state, []
    segments, best_start, best = _reading(one["segments"], one["window_start_s"], best_start, best)
    settled = float("inf") if one["final"] else one["now_s"] - SETTLE
    updates, provisional = [], []
    for s in segments:
        if not s["text"].strip() or (s["no_speech"] > 0.6 and s["avg_logprob"] < -1):
            continue
        if s["end_s"] > settled:
            provisional.append(s["text"].strip())
            continue
        if s["end_s"] <= through + SLACK:
            continue
        words = s["text"].split()
        folded = [bare(w) for w in words]
        n = leading_overlap([bare(w) for w in tail.split()], folded)
        while n and n < len(words) and not folded[n]:
            n += 1
        text = " ".join(words[n:]) if n else s["text"]
        through = max(through, s["end_s"])
        if text.strip():
            updates.append(("committed", text, s["start_s"], s["end_s"]))
            tail = " ".join([*tail.split(), *text.split()][-TAIL:])
    if provisional:
        updates.append(("provisional", " ".join(provisional), one["window_start_s"], one["now_s"]))
    return (one["pass_ix"], through, tail, best_start, best, bool(one["final"])), updates


def _passes(rows: pd.DataFrame) -> Iterator[dict]:
    for r in rows.sort_values("pass_ix", kind="stable").to_dict("records"):
        found = r["segments"] if r["segments"] is not None else []
        yield r | {"segments": [s if isinstance(s, dict) else s.asDict() for s in found]}


def _table(recording, made: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(recording, *m) for m in made], columns=[c.split()[0] for c in UPDATES.split(", ")])


def live(passes: DataFrame) -> DataFrame:
    """Updates of a stream of passes, in append mode."""

    def step(key, batches, state):
        now = tuple(state.get) if state.exists else START
        now = (*now[:4], [s if isinstance(s, dict) else s.asDict() for s in now[4]] if now[4] is not None else None, now[5])
        rows, made = pd.concat(list(batches)), []
        for one in _passes(rows):
            now, updates = advance(now, one)
            made += [(one["pass_ix"], *u) for u in updates]
        state.update((*now[:4], [tuple(s[c] for c in ("text", "start_s", "end_s", "avg_logprob", "no_speech")) for s in now[4]] if now[4] is not None else None, now[5]))
        yield _table(key[0], made)

    return passes.groupBy("recording_id").applyInPandasWithState(step, UPDATES, STATE, "append", "NoTimeout")


def replay(passes: DataFrame) -> DataFrame:
    """The same updates from a table of passes."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        state, made = START, []
        for one in _passes(rows):
            state, updates = advance(state, one)
            made += [(one["pass_ix"], *u) for u in updates]
        return _table(rows["recording_id"].iloc[0], made)

    return ordered_fold(passes, ["pass_ix"], fold, UPDATES)


def committed(updates: DataFrame) -> DataFrame:
    return updates.where("kind = 'committed'").drop("kind")


def due_passes(blocks: DataFrame, rate: int, every: float = 1.0, keep: float = 30.0) -> DataFrame:
    """The passes that blocks of sound (recording_id, block_ix, n samples) set off: one as soon as every seconds have come since the last.
    Each has now_s, what has been heard by then, and the last keep seconds of it as its window (window_start_s, content_s)."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        heard = rows["n"].cumsum().to_numpy()
        due, last = [], 0
        for i, upto in enumerate(heard.tolist()):
            if upto - last >= every * rate:
                due.append(i)
                last = upto
        now = heard[due]
        start = np.maximum(0, now - int(keep * rate))
        return rows.loc[due, ["recording_id", "block_ix"]].assign(now_s=now / rate, window_start_s=start / rate, content_s=(now - start) / rate)

    return ordered_fold(blocks.select("recording_id", "block_ix", "n"), ["block_ix"], fold, "recording_id bigint, block_ix bigint, now_s double, window_start_s double, content_s double")


def streamed(windows: DataFrame) -> DataFrame:
    """Texts of windows (recording_id, window_ix, text) as they are shown while more come: without the words that repeat the end of what was shown
    last, nor those said twice in a row; windows of which nothing is left are not shown."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        shown, kept = "", []
        for i, text in enumerate(rows["text"].fillna("")):
            if now := trimmed_repeats(after_overlap(shown, text)).strip():
                shown = now
                kept.append((i, now))
        return rows.iloc[[i for i, _ in kept]][["recording_id", "window_ix"]].assign(text=[t for _, t in kept])

    return ordered_fold(windows.select("recording_id", "window_ix", "text"), ["window_ix"], fold, "recording_id bigint, window_ix bigint, text string")
