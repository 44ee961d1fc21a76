"""A bounded memory of who has spoken, as a stream of frames with given speaker probabilities goes by.

Frames come in chunks of CHUNK. The newest QUEUE frames stay as they are; older ones move on, at least LEAVING at a time, to a store of STORE
frames. When that overflows, only the frames stay that show one speaker best: each speaker has a block, in order of channels, its frames in order of time, and a
frame of silence at its end. A frame's worth for a speaker is how sure the speaker is and how quiet all others are, and none where the speaker is less likely than not
to talk; who has enough clear frames has no unclear ones. The best STRONG and then WEAK frames of every speaker are raised, so that none
is crowded out, and the newest frames are a little ahead. Ties go to the earlier place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkgrid.operators.folds import ordered_fold
from talkgrid.streaming.stateful import by_value, floats, in_order

# Fixed values of the model that reads the memory.
SPEAKERS, CHUNK, STORE, QUEUE, LEAVING = 8, 340, 264, 40, 300
EACH = STORE // SPEAKERS - 1
CLEAR, STRONG, WEAK = EACH // 2, EACH * 3 // 4, EACH * 3 // 2
FLOOR, NEWER = 0.25, 0.05
LOG_2 = float(np.log(2))

#: The number of a frame of silence.
SILENCE = -1
#: The number that comes after all frames.
ENDED = 2**62


def worth(p: np.ndarray) -> np.ndarray:
    """Speakers by frames: how good an example of each speaker each frame is, from frames by speakers of probabilities."""
    p = p.astype(np.float64).T
    hushed = np.log(np.maximum(1 - p, FLOOR))
    score = np.where(p > 0.5, np.log(np.maximum(p, FLOOR)) - hushed + hushed.sum(axis=0) + LOG_2, -np.inf)
    enough = (score > 0).sum(axis=1, keepdims=True) >= CLEAR
    return np.where(enough & ~(score > 0), -np.inf, score)


def chosen(p: np.ndarray) -> np.ndarray:
    """Which of the frames stay, in order of the memory's places; SILENCE where a place has none."""
    n = len(p)
    score = worth(p)
    score[:, STORE:] += NEWER
    for many, extra in ((STRONG, 2 * LOG_2), (WEAK, LOG_2)):
        top = np.argsort(-score, axis=1, kind="stable")[:, :many]
        np.put_along_axis(score, top, np.take_along_axis(score, top, axis=1) + extra, axis=1)
    ends = np.hstack([score, np.full((len(score), 1), np.inf)]).ravel()  # each speaker's silence is always kept
    places = np.argsort(-ends, kind="stable")[:STORE]
    earned = np.sort(places[ends[places] > -np.inf])
    frames = earned % (n + 1)
    return np.r_[np.where(frames == n, SILENCE, frames), np.full(STORE - len(earned), SILENCE)]


@dataclass
class Memory:
    """Frames stored and queued: their numbers, vectors and probabilities. Silence has a vector of its own and no probability."""

    silence: np.ndarray
    stored: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    queued: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    selected: bool = False

    def _none(self, like: tuple) -> tuple:
        return tuple(x[:0] for x in like)

    def context(self) -> np.ndarray:
        """Numbers of the frames to be read before the next chunk."""
        return np.concatenate([x[0] for x in (self.stored, self.queued) if x is not None] or [np.zeros(0, np.int64)])

    def take(self, number: np.ndarray, vectors: np.ndarray, p: np.ndarray, fresh: np.ndarray | None = None) -> None:
        """Take in a chunk. fresh: probabilities of the frames of context() as they are seen now; those of a store that was selected stay as they were."""
        chunk = (number, vectors, p)
        stored = self.stored if self.stored is not None else self._none(chunk)
        queued = self.queued if self.queued is not None else self._none(chunk)
        if fresh is not None:
            held = len(stored[0])
            stored = stored if self.selected else (*stored[:2], fresh[:held])
            queued = (*queued[:2], fresh[held : held + len(queued[0])])
        line = tuple(np.concatenate([a, b]) for a, b in zip(queued, chunk))
        n = len(line[0])
        leaving = min(max(LEAVING, n - QUEUE), n) if n > QUEUE else 0
        stored = tuple(np.concatenate([a, b[:leaving]]) for a, b in zip(stored, line))
        self.queued = tuple(x[leaving:] for x in line)
        if leaving and len(stored[0]) > STORE:
            kept, self.selected = chosen(stored[2]), True
            quiet = kept == SILENCE
            stored = (np.where(quiet, SILENCE, stored[0][kept]), np.where(quiet[:, None], self.silence, stored[1][kept]), np.where(quiet[:, None], np.float32(0), stored[2][kept]))
        self.stored = stored


STEPS = "{key}, step bigint, frames array<bigint>"


@dataclass
class Listener:
    """A memory that gathers frames to chunks, and the context after each. A row has one frame or some in a row, frame being the first: their vectors and their
    SPEAKERS probabilities stand one after the other, and final is said of the last. Nothing is heard of a recording behind its end."""

    memory: Memory
    step: int = 0
    last: int = -1
    waiting: list = field(default_factory=list)  # numbers, vectors and probabilities of frames in a row

    @property
    def ended(self) -> bool:
        return self.last == ENDED

    def hear(self, rows: pd.DataFrame) -> list[tuple[int, np.ndarray]]:
        steps = []
        for frame, vectors, p, final in zip(rows["frame"], rows["embedding"], rows["probs"], rows["final"]):
            p = floats(p).reshape(-1, SPEAKERS)
            own = (int(frame) + np.arange(len(p)), floats(vectors).reshape(len(p), -1), p)
            heard = min(len(p), max(0, self.last + 1 - int(frame)))
            if heard == len(p):
                continue
            self.last = int(frame) + len(p) - 1
            self.waiting.append(tuple(x[heard:] for x in own))
            while (n := sum(len(w[0]) for w in self.waiting)) >= CHUNK or (final and n):
                line = tuple(np.concatenate(x) for x in zip(*self.waiting))
                self.memory.take(*(x[:CHUNK] for x in line))
                steps.append((self.step, self.memory.context()))
                self.step, self.waiting = self.step + 1, [tuple(x[CHUNK:] for x in line)] if n > CHUNK else []
            if final:
                self.last = ENDED
        return steps


class _Remember(StatefulProcessor):
    """Frames stored, queued and waiting are entries of three lists; a value has the rest, which is all that is kept of a recording that has ended."""

    ENTRY = "frame long, embedding array<float>, probs array<float>"

    def __init__(self, key: str, silence: list[float]):
        self.key, self.silence = key, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "step long, last long, selected boolean")
        self.lists = {name: handle.getListState(name, self.ENTRY) for name in ("stored", "queued", "waiting")}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        listener = Listener(Memory(np.asarray(self.silence, np.float32)))
        begun = self.place.exists()
        if begun:
            step, last, selected = self.place.get()
            if last == ENDED:
                return
            entries = {name: [(int(f), floats(v), floats(p)) for f, v, p in state.get()] for name, state in self.lists.items()}
            arrays = {name: (np.array([e[0] for e in own]), np.stack([e[1] for e in own]), np.stack([e[2] for e in own])) if own else None for name, own in entries.items()}
            waiting = [arrays["waiting"]] if arrays["waiting"] else []
            listener = Listener(Memory(listener.memory.silence, arrays["stored"], arrays["queued"], bool(selected)), int(step), int(last), waiting)
        steps = listener.hear(in_order(rows, "frame"))
        self.place.update((listener.step, listener.last, listener.memory.selected))
        if listener.ended:
            for state in self.lists.values() if begun else ():
                state.clear()
        else:
            for name, own in (("stored", [listener.memory.stored]), ("queued", [listener.memory.queued]), ("waiting", listener.waiting)):
                entries = [(int(f), v.tolist(), p.tolist()) for part in own if part is not None for f, v, p in zip(*part)]
                self.lists[name].put(entries) if entries else self.lists[name].clear()
        if steps:
            yield pd.DataFrame([(key[0], *s) for s in steps], columns=[self.key, "step", "frames"])

    def close(self) -> None:
        pass


def _schema(frames: DataFrame, key: str) -> str:
    return STEPS.format(key=f"{key} {frames.schema[key].dataType.simpleString()}")


def remembered(frames: DataFrame, silence: list[float], key: str = "recording_id") -> DataFrame:
    """For a stream of frames (key, frame, embedding, probs, final; a row may have frames in a row, see Listener), after each chunk the numbers of the frames remembered, SILENCE between them.
    Frames of a recording come in order; repeats are ignored. Its query must be started within stateful.rocks()."""
    needed = frames.select(key, "frame", "embedding", "probs", "final")
    with by_value(__name__):
        return needed.groupBy(key).transformWithStateInPandas(_Remember(key, silence), _schema(frames, key), "Append", "None")


def remembered_of(frames: DataFrame, silence: list[float], key: str = "recording_id") -> DataFrame:
    """The same from a table of frames."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        steps = Listener(Memory(np.asarray(silence, np.float32))).hear(rows)
        return pd.DataFrame([(rows[key].iloc[0], *s) for s in steps], columns=[key, "step", "frames"])

    return ordered_fold(frames.select(key, "frame", "embedding", "probs", "final"), ["frame"], fold, _schema(frames, key), key)
