"""Filling containers of fixed capacity with documents measured in tokens.

Documents are projected from hashed token vectors to three dimensions and laid along a Hilbert curve, so that neighbours on the
curve share vocabulary. The curve is cut into ranges; in each range, blocks of neighbours are packed best fit, longest first,
and the containers that still have room stay open for the next block of the range.

Defined cases
    Null and empty texts measure 0 tokens and are put into a container like any other. An item longer than the capacity is cut
    into pieces of full capacity and a remainder; no other item is cut. A null or non-positive capacity is no container. Repeated
    documents are items of their own, as their ids differ; equal rows of one id count once. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.bpe import VOCABULARY, encoder, share
from corpusmill.runtime import cut, ship

DIMENSIONS, BITS = 3, 10
#: Tokens of a range of the curve: enough that its last, half-filled containers don't count.
RANGE_TOKENS = 4_000_000
#: Neighbouring pieces that are sorted by length and packed together, and containers that stay open.
BLOCK, OPEN = 8192, 4096


class _Slots(dict):
    """Maps a piece of text to a row of two arrays: its number of tokens, and its hashed vector projected to few dimensions."""

    def __init__(self, vocabulary: str):
        self.encoder = encoder(vocabulary)
        self.tokens, self.vectors = np.zeros(1 << 16, "int64"), np.zeros((1 << 16, DIMENSIONS), "float32")

    def __missing__(self, piece: str) -> int:
        row = len(self)
        if row == len(self.tokens):
            self.tokens, self.vectors = np.concatenate([self.tokens] * 2), np.concatenate([self.vectors] * 2)
        ids = self.encoder[piece]
        self.tokens[row] = len(ids)
        mixed = (np.array(ids, "uint64")[:, None] + np.uint64(1)) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "uint64")[:DIMENSIONS]
        self.vectors[row] = (((mixed >> np.uint64(40)).astype("float32") / (1 << 24)) * 2 - 1).sum(0)
        self[piece] = row
        return row


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates below 2 ** bits, by the published transpose algorithm."""
    x = cells.astype("int64").T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measure(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (item, tokens, curve): each document's number of tokens and its place on the curve."""
    ship(df.sparkSession)
    share(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(vocabulary)
        for batch in batches:
            tokens, points = np.zeros(batch.num_rows, "int64"), np.zeros((batch.num_rows, DIMENSIONS))
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    at = np.fromiter(map(slots.__getitem__, slots.encoder.split(text)), "int64")
                    tokens[row] = slots.tokens[at].sum()
                    v = slots.vectors[at].sum(0)
                    points[row] = v / max(float(np.sqrt((v * v).sum())), 1e-9)
            if len(slots) > 300_000:
                slots = _Slots(vocabulary)
            cells = np.clip((points + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(hilbert_key(cells))], ["item", "tokens", "curve"])

    return df.select(F.col(id_col).alias("item"), text_col).mapInArrow(run, f"item {dict(df.dtypes)[id_col]}, tokens long, curve long")


class _Packer:
    """Containers of one capacity in one range of the curve."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.made = capacity, [], 0  # room: (free, container), sorted

    def place(self, size: int) -> int:
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            free, box = self.room.pop(at)
        else:
            free, box = self.capacity, self.made
            self.made += 1
        if free > size:
            insort(self.room, (free - size, box))
        return box

    def close(self) -> None:
        """Keep the roomiest containers open."""
        if len(self.room) > OPEN:
            del self.room[: len(self.room) - OPEN]


def pack(items: DataFrame, capacities: list[tuple[str, int]], range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Rows (container_name, container_id, item, piece_no, first_token, n_tokens) for each kind of container.

    items: (item, tokens, curve), of which any number can lie on one place of the curve: ties are spread by a hash of the item.
    Of several rows of an item the one of most tokens counts; rows without an item are none.
    """
    ship(items.sparkSession)
    items = cut(items.where(F.col("item").isNotNull()).groupBy("item").agg(F.max(F.struct("tokens", "curve")).alias("r")).select("item", "r.tokens", "r.curve"))
    total = items.agg(F.sum("tokens")).first()[0] or 0
    ranges = int(max(1, -(-total // range_tokens)))
    kinds = [(n, int(c)) for n, c in capacities if n is not None and c is not None and c > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers, base = [_Packer(c) for _, c in kinds], TaskContext.get().partitionId() << 32

        def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(rows)
            n = table["tokens"].to_numpy()
            for (name, capacity), packer in zip(kinds, packers):
                whole, rest = n // capacity, n % capacity
                pieces = np.maximum(1, whole + (rest > 0))
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(capacity, n[row] - piece * capacity)
                order = np.argsort(-size, kind="stable")
                box = np.empty(len(row), "int64")
                box[order] = [packer.place(s) for s in size[order].tolist()]
                packer.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(row), pa.string()), pa.array(box + base), table["item"].take(pa.array(row)).combine_chunks(), pa.array(piece.astype("int32")), pa.array((piece * capacity).astype("int64")), pa.array(size.astype("int64"))],
                    ["container_name", "container_id", "item", "piece_no", "first_token", "n_tokens"],
                )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield from block(held)
                    held = []
        if held:
            yield from block(held)

    along = items.withColumn("tie", F.xxhash64("item")).repartitionByRange(ranges, "curve", "tie").sortWithinPartitions("curve", "tie").select("item", "tokens")
    return along.mapInArrow(run, f"container_name string, container_id long, item {dict(items.dtypes)['item']}, piece_no int, first_token long, n_tokens long")
