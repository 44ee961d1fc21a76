"""Blocks of sound as a stream, and the passes over the last seconds of it that they set off.

The source `talk_blocks` follows a folder of growing recordings: files of 16 bit mono samples (.pcm), each read in whole blocks, and to its last sample once a file of the
same name with the ending .end lies beside it. Offsets are bytes by file, so any batch can be read again alike, and recordings may begin at any time.
With the option `frontier` the source admits no more than aheadSeconds of a recording beyond what another stream has noted there (note_frontier): so
a quick stream waits for a slow one instead of running away from it.

buffered() keeps the last seconds of each recording in state. A pass is due as soon as enough sound has come since the last one, and at the end; it carries
the window's samples. Blocks of a recording come in order; one that is not newer than the last is a repeat and is ignored, as is all that comes behind the end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from talkgrid.operators.folds import ordered_fold
from talkgrid.streaming.stateful import by_value, floats, in_order

FORMAT = "talk_blocks"
BLOCKS = "recording string, block_ix bigint, at_s double, samples array<float>, final boolean"
SOUND, END, NOTES = ".pcm", ".end", ".json"
WIDTH = 2  # bytes of a sample


@dataclass
class Span(InputPartition):
    path: str
    begin: int
    end: int
    ended: bool


class _Blocks:
    """What the batch and the stream reader share: sizes of recordings, and rows of a span of bytes."""

    def __init__(self, options: dict):
        self.path, self.rate = options["path"], int(options.get("rate", 16000))
        self.block = WIDTH * int(round(self.rate * float(options.get("blockseconds", options.get("blockSeconds", 0.2)))))
        self.frontier = options.get("frontier")
        self.ahead = float(options.get("aheadseconds", options.get("aheadSeconds", 60)))

    def sizes(self) -> dict[str, tuple[int, bool]]:
        """Bytes that can be read of each recording, and whether that is all of it."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = {f.path: f.size for f in system.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
        done = {p.removesuffix(END) + SOUND for p in found if p.endswith(END)}
        whole = {p: (n // WIDTH * WIDTH, p in done) for p, n in found.items() if p.endswith(SOUND)}
        return {p: (n, True) if ended else (n // self.block * self.block, False) for p, (n, ended) in whole.items()}

    def admitted(self, sizes: dict[str, tuple[int, bool]]) -> dict[str, tuple[int, bool]]:
        if not self.frontier:
            return sizes
        noted = frontier(self.frontier)
        out = {}
        for path, (n, ended) in sizes.items():
            most = int((noted.get(_name(path), 0.0) + self.ahead) * self.rate) * WIDTH // self.block * self.block
            out[path] = (n, ended) if n <= most else (most, False)
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as f:
            for at in range(partition.begin, partition.end, self.block):
                samples = np.frombuffer(f.read_at(min(self.block, partition.end - at), at), "<i2").astype(np.float32) / 32768
                last = partition.ended and at + self.block >= partition.end
                yield pa.RecordBatch.from_pydict({"recording": [_name(partition.path)], "block_ix": [at // self.block], "at_s": [at / WIDTH / self.rate], "samples": pa.array([samples], pa.list_(pa.float32())), "final": [last]})


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(SOUND)


class BlockReader(_Blocks, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [Span(p, 0, n, ended) for p, (n, ended) in sorted(self.sizes().items()) if n]


class BlockStream(_Blocks, DataSourceStreamReader):
    """Offsets: {file: [bytes, whether that is all of it]}."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {p: [n, ended] for p, (n, ended) in sorted(self.admitted(self.sizes()).items())}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        begun = {p: n for p, (n, _) in start.items()}
        return [Span(p, begun.get(p, 0), n, ended) for p, (n, ended) in sorted(end.items()) if n > begun.get(p, 0)]

    def commit(self, end: dict) -> None:
        pass


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> BlockReader:
        return BlockReader(dict(self.options))

    def streamReader(self, schema) -> BlockStream:
        return BlockStream(dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(BlockSource)
    return spark


def note_frontier(folder: str, reached: dict[str, float]) -> None:
    """Note how many seconds of recordings are done with; a later note of a recording takes the place of the one before."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    for name, seconds in reached.items():
        new = f"{root}/_{uuid.uuid4().hex}"
        with system.open_output_stream(new) as out:
            out.write(json.dumps({"seconds": seconds}).encode())
        system.move(new, f"{root}/{name}{NOTES}")


def frontier(folder: str) -> dict[str, float]:
    system, root = fs.FileSystem.from_uri(folder)
    notes = {}
    for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.path.endswith(NOTES):
            with system.open_input_stream(f.path) as note:
                notes[f.base_name.removesuffix(NOTES)] = json.loads(note.read())["seconds"]
    return notes


#: The number that comes after all blocks.
ENDED = 2**62

PASSES = "{key}, block_ix bigint, now_s double, window_start_s double, content_s double, final boolean, samples array<float>"


@dataclass
class Ear:
    """What is remembered of a recording: samples heard in all and since the last pass, the last block, and the window."""

    heard: int = 0
    since: int = 0
    last: int = -1
    window: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def hear(self, block_ix: int, samples: np.ndarray, final: bool, rate: int, every: float, keep: float) -> tuple | None:
        """The pass that a block sets off: block_ix, now_s, window_start_s, content_s, final, samples."""
        if block_ix <= self.last:
            return None
        size = int(keep * rate)
        self.last, self.heard, self.since = ENDED if final else block_ix, self.heard + len(samples), self.since + len(samples)
        joined = np.concatenate([self.window, samples])
        self.window = joined[max(0, len(joined) - size) :]
        if not final and self.since < every * rate or not len(self.window):
            return None
        self.since = 0
        return block_ix, self.heard / rate, (self.heard - len(self.window)) / rate, len(self.window) / rate, final, self.window


def _each(rows: pd.DataFrame) -> Iterator[tuple]:
    """Blocks one by one: where samples are a list of lists, a row has blocks in a row, block_ix being the first and final said of the last."""
    for b, samples, final in zip(rows["block_ix"], rows["samples"], rows["final"]):
        own = samples if samples is not None and len(samples) and (samples[0] is None or np.ndim(samples[0])) else [samples]
        for k, s in enumerate(own):
            yield int(b) + k, s, bool(final) and k == len(own) - 1


def _hear_all(ear: Ear, rows: pd.DataFrame, rate: int, every: float, keep: float) -> pd.DataFrame:
    passes = [p for b, s, f in _each(rows) if (p := ear.hear(b, floats(s), f, rate, every, keep))]
    return pd.DataFrame(passes, columns=["block_ix", "now_s", "window_start_s", "content_s", "final", "samples"])


class _Buffer(StatefulProcessor):
    def __init__(self, key: str, rate: int, every: float, keep: float):
        self.key, self.how = key, (rate, every, keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "heard long, since long, last long")
        self.window = handle.getListState("window", "samples array<float>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ear = Ear()
        begun = self.clock.exists()
        if begun:
            clock = self.clock.get()
            if clock[2] == ENDED:
                return
            ear = Ear(*(int(v) for v in clock), np.concatenate([np.zeros(0, np.float32), *[floats(s) for (s,) in self.window.get()]]))
        passes = _hear_all(ear, in_order(rows, "block_ix"), *self.how)
        self.clock.update((ear.heard, ear.since, ear.last))
        step = max(1, self.how[0])  # a second an entry
        if ear.last == ENDED:  # all that is kept of a recording that has ended is its clock
            if begun:
                self.window.clear()
        elif len(ear.window):
            self.window.put([(ear.window[a : a + step].tolist(),) for a in range(0, len(ear.window), step)])
        if len(passes):
            passes.insert(0, self.key, key[0])
            yield passes

    def close(self) -> None:
        pass


def _schema(blocks: DataFrame, key: str) -> str:
    return PASSES.format(key=f"{key} {blocks.schema[key].dataType.simpleString()}")


def buffered(blocks: DataFrame, rate: int, every: float = 1.0, keep: float = 30.0, key: str = "recording_id") -> DataFrame:
    """The passes of a stream of blocks (key, block_ix, samples, final; a row may have blocks in a row, see _each). Its query must be started within stateful.rocks()."""
    needed = blocks.select(key, "block_ix", "samples", "final")
    with by_value(__name__):
        return needed.groupBy(key).transformWithStateInPandas(_Buffer(key, rate, every, keep), _schema(blocks, key), "Append", "None")


def passes_of(blocks: DataFrame, rate: int, every: float = 1.0, keep: float = 30.0, key: str = "recording_id") -> DataFrame:
    """The same passes from a table of blocks."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        passes = _hear_all(Ear(), rows, rate, every, keep)
        passes.insert(0, key, rows[key].iloc[0])
        return passes

    return ordered_fold(blocks.select(key, "block_ix", "samples", "final"), ["block_ix"], fold, _schema(blocks, key), key)
