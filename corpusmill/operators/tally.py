"""Counts of hashes by bucket, in a table of fixed size: what can be known of billions of keys in a few megabytes.

A key whose bucket was never counted is surely absent, one in a bucket counted once surely alone. Tables are broadcast; their size
doesn't depend on the data. When keys are many more than buckets, they tell less, but never anything wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.runtime import ship

#: Number of buckets, as a power of two.
BITS = 23
#: The highest count of each level.
LEVELS = np.unique(np.concatenate([np.arange(0, 24), np.ceil(24 * 1.2 ** np.arange(0, 103)).astype("int64")]))[:127]


class Tally:
    """How often hashes fall into each of 2 ** BITS buckets, as levels of a byte; a level's count is at least the true one."""

    def __init__(self, levels: np.ndarray, total: int):
        self.levels, self.total = levels, total

    def level(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[hashes & ((1 << BITS) - 1)]


def _tally_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, offsets, counts) of what one task holds; the column is of hashes or of lists of them."""
    counts = np.zeros(1 << BITS, "uint32")
    for batch in batches:
        column = batch.column(0)
        hashes = (column.flatten() if pa.types.is_list(column.type) else column).to_numpy(zero_copy_only=False)
        np.add.at(counts, hashes & ((1 << BITS) - 1), np.uint32(1))
    width = 1 << (BITS - 10)
    block, offsets, found = [], [], []
    for k in range(1 << 10):
        part = counts[k * width : (k + 1) * width]
        if len(at := np.flatnonzero(part)):
            block.append(k)
            offsets.append(at.astype("uint16").tobytes())
            found.append(part[at].tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(offsets, pa.binary()), pa.array(found, pa.binary())], ["block", "offsets", "counts"])


def _tally_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, offsets, counts in zip(*(c.to_pylist() for c in batch.columns)):
            part = sums.setdefault(block, np.zeros(1 << (BITS - 10), "int64"))
            part[np.frombuffer(offsets, "uint16")] += np.frombuffer(counts, "uint32")
    levels = [np.minimum(np.searchsorted(LEVELS, s), len(LEVELS) - 1).astype("uint8").tobytes() for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary()), pa.array([int(s.sum()) for s in sums.values()], pa.int64())], ["block", "levels", "total"])


def tally(hashes: DataFrame) -> Tally:
    """Count the one column of `hashes` by bucket. 2 ** BITS bytes come to the driver, however many hashes there are."""
    ship(hashes.sparkSession)
    parts = hashes.mapInArrow(_tally_parts, "block int, offsets binary, counts binary").repartition("block")
    levels, total = np.zeros(1 << BITS, "uint8"), 0
    width = 1 << (BITS - 10)
    for row in parts.mapInArrow(_tally_sums, "block int, levels binary, total long").collect():
        levels[row.block * width : (row.block + 1) * width] = np.frombuffer(row.levels, "uint8")
        total += row.total
    return Tally(levels, total)
