"""Words of a whole recording placed in its score grid at once, within a corridor that the segments' time stamps suggest."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.trellis import best_states, matrix, sure_states, token_frames

#: The least half width of the corridor, in states of which a letter has two, and the seconds of letters to either side of it.
LEAST_HALF, HALF_SECONDS = 900, 36
SLOWEST_SPRINT, SPRINT_FACTOR, SMALLEST_SCALE = 25.0, 2.5, 0.5


def place_within(grid: np.ndarray, tokens: np.ndarray, centres: np.ndarray, half: int, blank: int = 0) -> np.ndarray | None:
    """First and last frame of each token on the best path through a frame by token grid whose state at each frame is at most half away
    from the centre; the corridor never moves back. States are blanks with the tokens between them. None where no path gets through."""
    if not (len(grid) and len(tokens)):
        return None
    states = 2 * len(tokens) + 1
    width = min(states, 2 * half + 1)
    low = np.maximum.accumulate(np.clip(centres - half, 0, states - width))
    path = sure_states(grid, tokens, blank)
    if path is None or (path < low).any() or (path >= low + width).any():
        path = best_states(grid, tokens, low, width, blank)
    return None if path is None else np.stack(token_frames(path, len(tokens)), axis=1)


def spine(times: np.ndarray, anchors: np.ndarray, tokens: int) -> np.ndarray:
    """The state that each time should be near, on lines between anchors (second, token), whose tokens never fall."""
    order = np.argsort(anchors[:, 0], kind="stable")
    second, token = anchors[order, 0], np.maximum.accumulate(anchors[order, 1])
    at = np.maximum(np.searchsorted(second, times, "right") - 1, 0)
    after = np.minimum(at + 1, len(second) - 1)
    span = second[after] - second[at]
    share = np.where(span > 0, (times - second[at]) / np.where(span > 0, span, 1), 0)
    return np.clip((token[at] + np.trunc(share * (token[after] - token[at]))) * 2, 0, 2 * tokens).astype(np.int64)


#: Times of words.
WORDS = pa.schema([("recording_id", pa.int64()), ("seq", pa.int64()), ("word_ix", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])


def word_times(own: pd.DataFrame, scores: np.ndarray, step: float, blank: int = 0) -> pd.DataFrame | None:
    """seq, word_ix, start_s and end_s of a recording's words (seq, word_ix, tokens, start_s, end_s) in its frames' scores, as align_recordings has them; None where no path
    gets through or there is nothing to align."""
    if not (len(scores) and len(own)):
        return None
    place = np.lexsort((own["word_ix"].to_numpy(), own["seq"].to_numpy()))
    seq, word, stamped, until = (own[c].to_numpy()[place] for c in ("seq", "word_ix", "start_s", "end_s"))
    own = own["tokens"].to_numpy()[place]
    size = np.array([len(t) for t in own], np.int64)
    if not size.sum():
        return None
    tokens = np.concatenate([np.asarray(t, np.int64) for t in own])
    limit, first = len(scores) * step, np.cumsum(size) - size
    longest = np.fmax.reduce(until)
    scale = 1.0 if longest <= limit else max(SMALLEST_SCALE, limit / longest)
    # Segments, by their first words; those without tokens are left out.
    line = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
    letters = np.add.reduceat(size, line)
    sounded = np.repeat(letters > 0, np.diff(np.append(line, len(seq))))
    line, letters = line[letters > 0], letters[letters > 0]
    begin = np.clip(stamped[line] * scale, 0, limit)
    end = np.clip(until[line] * scale, begin, limit)
    anchors = np.concatenate([[(0.0, 0.0)], np.stack([begin, first[line]], axis=1), np.stack([end, first[line] + letters], axis=1), [(limit, len(tokens))]])
    sprint = max(SLOWEST_SPRINT, len(tokens) / max(1.0, limit) * SPRINT_FACTOR)
    anchors = anchors[(len(tokens) - anchors[:, 1] <= np.maximum(0, limit - anchors[:, 0]) * sprint) & (anchors[:, 1] <= anchors[:, 0] * sprint)]
    half = max(LEAST_HALF, int(len(tokens) / max(1.0, limit) * HALF_SECONDS) * 2)
    found = place_within(scores, tokens, spine(np.arange(len(scores)) * step, anchors, len(tokens)), half, blank) if len(anchors) else None
    if found is None:
        return None
    opening = np.repeat(found[first[line], 0] * step, np.diff(np.append(np.flatnonzero(np.r_[True, seq[sounded][1:] != seq[sounded][:-1]]), sounded.sum())))
    seq, word, first, size = seq[sounded], word[sounded], first[sounded], size[sounded]
    # A word without tokens ends where the last one of its segment with tokens does; the first of all, where the segment opens.
    last = np.maximum.accumulate(np.where(size > 0, np.arange(len(size)), -1))
    ends = (found[np.maximum(0, first + size - 1), 1] + 1) * step
    known = (last >= 0) & (seq[np.maximum(last, 0)] == seq)
    end = np.where(known, ends[np.maximum(last, 0)], opening)
    start = np.where(size > 0, found[np.minimum(first, len(found) - 1), 0] * step, end)
    return pd.DataFrame({"seq": seq, "word_ix": word, "start_s": start, "end_s": end})


def align_recordings(frames: DataFrame, words: DataFrame, step: float, blank: int = 0) -> DataFrame:
    """Times for words (recording_id, seq, word_ix, tokens array<int>, and their segment's start_s and end_s as stamped) from score grids
    (recording_id, frame, logp; frame k is at k * step; a row may have the scores of frames in a row, frame being the first). Stamps that end after the recording are scaled down, and those that the clock
    doesn't allow are left out. Words without tokens take the time where the word before them ends. A recording is one group, as its alignment
    is one path; where there is none, it has no rows, nor has a segment without tokens."""

    def place(key, grid: pa.Table, own: pa.Table) -> pa.Table:
        found = word_times(own.to_pandas(), matrix(grid.sort_by("frame")["logp"]), step, blank) if len(grid) and len(own) else None
        return WORDS.empty_table() if found is None else pa.Table.from_pandas(found.assign(recording_id=key[0].as_py())[WORDS.names], WORDS, preserve_index=False)

    left = frames.select("recording_id", "frame", "logp").groupBy("recording_id")
    right = words.select(*[F.col(c).alias(c) for c in ("recording_id", "seq", "word_ix", "tokens", "start_s", "end_s")]).groupBy("recording_id")
    return left.cogroup(right).applyInArrow(place, "recording_id bigint, seq bigint, word_ix int, start_s double, end_s double")
