"""Bit tables of fixed size: which 64-bit hashes may be in a set of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the bits of one block of a table.
BLOCK = 16


def _blocks(batches):
    """Sorted slots to the blocks of the table that have any."""
    bits, now = None, None

    def made():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        slots = batch.column("slot").to_numpy()
        for block in np.unique(slots >> BLOCK).tolist():
            if block != now:
                if bits is not None:
                    yield made()
                bits, now = np.zeros(1 << BLOCK, bool), block
            bits[slots[slots >> BLOCK == block] & ((1 << BLOCK) - 1)] = True
    if bits is not None:
        yield made()


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """A packed table of 2^bits bits with those of all hashes (one column of longs) set."""
    h = F.col(hashes.columns[0])
    slots = hashes.select(F.pmod(h, F.lit(1 << bits)).alias("slot"), F.pmod(F.shiftright(h, BLOCK), F.lit(1 << (bits - BLOCK))).alias("block"))
    found = slots.repartition("block").sortWithinPartitions("slot").select("slot").mapInArrow(_blocks, "block long, bits binary").toArrow()
    out = np.zeros((1 << (bits - BLOCK), 1 << (BLOCK - 3)), np.uint8)
    for block, data in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
        out[block] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def holds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set: all that went in, and some others."""
    slot = (hashes.view(np.uint64) & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
