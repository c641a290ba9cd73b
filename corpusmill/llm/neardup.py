"""Records that say nearly the same: an exact set-similarity join over word n-grams, by prefix trees.

Each text is the set of its n-grams, hashed. Texts with equal sets are one representative with members. The grams of
all representatives get one global order, rare ones first: a gram's place is the count of its bucket in a table of fixed size,
then its hash, so no gram has to be looked up by a join. Two sets can only be similar enough if they share a gram in the
first part of their ordered grams, and a set that shares its p-th gram first can only be similar to sets up to a size that
follows from p. So (gram, set, size, place) are moved first, and sets without a partner of fitting size and place in a gram's
group are left out. For the others, only the grams behind the group's gram are moved. In a group these tails are stored in a
trie in global order; a set walks the trie, sharing the overlap counted so far with all sets below a node, and leaves subtrees
whose length bounds can no longer reach the threshold. The group of a pair's first common gram counts its whole overlap.

A group that may have more than `BLOCK` sets is cut into blocks, and each pair of blocks is a group of its own: nothing is capped
or dropped. Joins are shuffled; only tables of fixed size are broadcast, whatever the size of the corpus.

Defined cases
    Null texts and texts of fewer than n words have no gram and are in no pair. Repeated rows of a key count once. Texts with
    equal sets are similar to degree 1. Empty table: no rows. Only the key and text columns are read. Whole texts are used.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.operators.tally import LEVELS, Tally, tally
from corpusmill.runtime import cut, partitions_for, ship

WORDS, SIMILARITY, BLOCK = 5, 0.8, 1500
#: Copies of one set in a block of members, when pairs of records are written out.
COPIES = 1024
#: Bits of a gram's hash that are kept; the bits above hold the level of its count.
HASH_BITS = 56
_word = re.compile(r"[^\W_]+").findall


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def gram_hashes(text: str | None, n: int, words: dict[str, int]) -> np.ndarray:
    """The distinct n-grams of a text as sorted 64-bit hashes; words are runs of letters and digits in lower case."""
    found = _word(text.lower()) if text else []
    if len(found) < n:
        return np.empty(0, "int64")
    h = np.fromiter(map(words.__getitem__, found), "uint64", len(found))
    out = np.zeros(len(h) - n + 1, "uint64")
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out & np.uint64((1 << HASH_BITS) - 1)).view("int64")


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHash()
        for batch in batches:
            sets = [gram_hashes(t, n, words) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(s) for s in sets], "int32")
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.concatenate(sets) if sets else np.empty(0, "int64")
            grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), grams, pa.array(sizes)], ["key", "grams", "size"])

    return run


def _ordered(lists: pa.ListArray, often: Tally) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a batch of sets in global order, with the sets' offsets. A gram's level stands above its hash, so the order is that of numbers."""
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    offsets = (offsets - offsets[0]).astype("int64")
    keys = (often.level(flat).astype("int64") << HASH_BITS) | flat
    return keys[np.lexsort((keys, np.repeat(np.arange(len(lists)), np.diff(offsets))))], offsets


def _leading(keys: np.ndarray, offsets: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, gram) of the leading grams that a second set can have: those of a level of 1 can't be common."""
    sizes = np.diff(offsets)
    lead = sizes - -(-sizes * t.numerator // t.denominator) + 1
    row = np.repeat(np.arange(len(sizes)), lead)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lead) - lead, lead)
    gram = keys[offsets[row] + place]
    keep = gram >> HASH_BITS > 1
    return row[keep], place[keep], gram[keep]


def _lead_lists(t: Fraction, often):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_leading(*_ordered(batch.column(0), often.value), t)[2])], ["h"])

    return run


def _places(t: Fraction, often, leads):
    """Rows (gram, cell, id, size, place); a cell is a pair of blocks and the side in its lowest bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, offsets = _ordered(batch.column(1), often.value)
            row, place, gram = _leading(keys, offsets, t)
            level = leads.value.level(gram)
            row, place, gram, level = (x[level > 1] for x in (row, place, gram, level))
            blocks = -(-LEVELS[level] // BLOCK)
            ids = batch.column(0).to_numpy()
            own = ((ids.view("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype("int64")[row] % blocks
            at = np.repeat(np.arange(len(row)), blocks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            own = own[at]
            cell = (np.minimum(own, other) << 33) | (np.maximum(own, other) << 1) | (own > other)
            yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(cell), pa.array(ids[row[at]]), pa.array(np.diff(offsets)[row[at]].astype("int32")), pa.array(place[at].astype("int32"))], ["gram", "cell", "id", "size", "place"])

    return run


def _partnered(t: Fraction):
    """Leave out the sets that have no partner of fitting size and place in their cell; rows come sorted by gram and cell.

    x and y, which first share the grams at places p and q, can reach the threshold only if y's size is at most
    (|x| - p) * (1 + t) / t - |x|, and x's size at most the same of y.
    """
    num, both = t.numerator, t.numerator + t.denominator

    def keep(gram, cell, size, place) -> np.ndarray:
        pair = cell >> 1
        starts = np.concatenate([[0], np.flatnonzero((gram[1:] != gram[:-1]) | (pair[1:] != pair[:-1])) + 1])
        group = np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), len(gram)]))
        most = both * (size - place).astype("int64") // num - size
        out = np.zeros(len(gram), bool)
        # by size within each group: x needs a y among those up to its `most` whose own `most` is at least x's size
        order = np.lexsort((size, group))
        g, s, m = group[order], size[order].astype("int64"), most[order]
        span = int(max(s.max(), m.max())) + 2
        scale = g * span
        upto = np.searchsorted(scale + s, scale + np.minimum(m, span - 1), "right")  # the sets of the group up to this place
        high = np.maximum.accumulate(scale + m)  # highest `most` so far, groups one above the other
        rank = np.arange(len(g))
        first = starts[g]
        # the highest of those before the set itself, and, for sets after it, of all up to the bound
        before = np.where(rank > first, high[np.maximum(rank - 1, 0)] - scale, -1)
        out_before = np.where(rank > first, np.where(upto > rank, before, np.where(upto > first, high[np.maximum(upto - 1, 0)] - scale, -1)), -1) >= s
        # a set after it is at least as large as x, so it fits if its size is within x's bound and its `most` reaches x's size: the next sets
        late = np.zeros(len(g), bool)
        open_ = np.flatnonzero(upto > rank + 1)
        step = 1
        while len(open_):
            late[open_] |= m[open_ + step] >= s[open_]
            step += 1
            open_ = open_[(upto[open_] > open_ + step) & ~late[open_]]
        out[order] = out_before | late
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            gram, cell, size, place = (table[c].to_numpy() for c in ("gram", "cell", "size", "place"))
            same = (gram == gram[-1]) & (cell >> 1 == cell[-1] >> 1)
            done = len(gram) - int(same.sum())
            held = table.slice(done)
            if done:
                yield from table.slice(0, done).filter(pa.array(keep(gram[:done], cell[:done], size[:done], place[:done]))).to_batches()
        if held is not None:
            yield from held.filter(pa.array(keep(*(held[c].to_numpy() for c in ("gram", "cell", "size", "place"))))).to_batches()

    return run


def _in_order(often, seen):
    """Sets in global order of those representatives (id, grams, h) whose h may be in the tally `seen`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(seen.value.level(batch.column(2).to_numpy()) > 0))
            keys, offsets = _ordered(batch.column(1), often.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(keys))], ["id", "grams"])

    return run


class _Node:
    """A trie node; bounds hold for the sets below it: the smallest whole set, and the most grams from here on."""

    __slots__ = ("children", "here", "least", "deepest")

    def __init__(self):
        self.children: dict[int, _Node | int] = {}  # a number is a set of which nothing is shared from here on
        self.here: list[int] = []
        self.least, self.deepest = 1 << 60, 0


class _Trie:
    def __init__(self, tails: list[list[int]], sizes: list[int]):
        self.tails, self.sizes, self.root = tails, sizes, _Node()

    def insert(self, i: int) -> None:
        tail, node, at = self.tails[i], self.root, 0
        while True:
            node.least, node.deepest = min(node.least, self.sizes[i]), max(node.deepest, len(tail) - at)
            if at == len(tail):
                node.here.append(i)
                return
            below = node.children.get(tail[at])
            if below is None:
                node.children[tail[at]] = i
                return
            if isinstance(below, int):
                j, below = below, _Node()
                rest = self.tails[j][at + 1 :]
                below.least, below.deepest = self.sizes[j], len(rest)
                if rest:
                    below.children[rest[0]] = j
                else:
                    below.here.append(j)
                node.children[tail[at]] = below
            node, at = below, at + 1

    def probe(self, own: list[int], size: int, t: Fraction) -> list[tuple[int, int]]:
        """Sets of the trie that overlap enough with `own`, with the overlap; one gram is common to all beforehand.

        Grams come in global order along a path, so what `own` can still share below a node is what it has behind the node's gram.
        """
        num, both = t.numerator, t.numerator + t.denominator
        held, n = set(own), len(own)
        out, stack = [], [(self.root, 1, 0)]
        while stack:
            node, overlap, at = stack.pop()
            for i in node.here:
                if overlap * both >= num * (size + self.sizes[i]):
                    out.append((i, overlap))
            for gram, below in node.children.items():
                if isinstance(below, int):
                    if (overlap + min(n - at, len(self.tails[below]))) * both >= num * (size + self.sizes[below]):
                        if (full := 1 + len(held.intersection(self.tails[below]))) * both >= num * (size + self.sizes[below]):
                            out.append((below, full))
                    continue
                behind = bisect_left(own, gram, at)
                hit = behind < n and own[behind] == gram
                if (overlap + hit + min(below.deepest, n - behind - hit)) * both >= num * (size + below.least):
                    stack.append((below, overlap + hit, behind + hit))
        return out


def _join(similarity: str):
    t = Fraction(similarity)

    def group(ids: list[int], sides: list[int], sizes: list[int], tails: list[list[int]], inner: bool) -> Iterator[tuple[int, int, int, int, int]]:
        trie = _Trie(tails, sizes)
        for i in sorted(range(len(ids)), key=lambda i: (sides[i], sizes[i], ids[i])):
            if inner or sides[i]:
                for j, overlap in trie.probe(tails[i], sizes[i], t):
                    yield (ids[i], ids[j], overlap, sizes[i], sizes[j]) if ids[i] < ids[j] else (ids[j], ids[i], overlap, sizes[j], sizes[i])
            if inner or not sides[i]:
                trie.insert(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (gram, cell, id, size, tail), sorted by gram and cell."""
        key, ids, sides, sizes, tails = None, [], [], [], []
        found: list[tuple[int, int, int, int, int]] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [[]] * 5
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id_a", "id_b", "overlap", "size_a", "size_b"])

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                for pair in group(ids, sides, sizes, tails, key[1] >> 32 == key[1] & 0xFFFFFFFF):
                    found.append(pair)
                    if len(found) >= 50_000:
                        yield batch_of()

        for batch in batches:
            flat, offsets = batch.column(4).values.to_numpy(), batch.column(4).offsets.to_numpy()
            gram, cell, id_, size = (batch.column(c).to_numpy().tolist() for c in range(4))
            for r in range(batch.num_rows):
                if (now := (gram[r], cell[r] >> 1)) != key:
                    yield from close()
                    key, ids, sides, sizes, tails = now, [], [], [], []
                ids.append(id_[r])
                sides.append(cell[r] & 1)
                sizes.append(size[r])
                tails.append(flat[offsets[r] : offsets[r + 1]].tolist())
        yield from close()
        yield batch_of()

    return run


def gram_sets(df: DataFrame, key: str, text: str, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Representatives (id, rep, grams, size) of the distinct sets, and members (id, key)."""
    ship(df.sparkSession)
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    sets = rows.mapInArrow(_sets(words), f"key {dict(df.dtypes)[key]}, grams array<bigint>, size int").where("size > 0")
    sets = cut(sets.withColumn("s1", F.xxhash64("grams")).withColumn("s2", F.xxhash64(F.lit(7), F.col("grams"))))
    reps = sets.groupBy("s1", "s2", "size").agg(F.min("key").alias("rep"), F.any_value("grams").alias("grams"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
    members = sets.select("s1", "s2", "size", "key").distinct().join(reps.select("s1", "s2", "size", "id").hint("merge"), ["s1", "s2", "size"]).select("id", "key")
    return reps.select("id", "rep", "grams", "size"), members


def similar_sets(reps: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (id_a, id_b, overlap, size_a, size_b), once for each pair of sets whose Jaccard similarity reaches the threshold."""
    t = Fraction(str(similarity))
    spark = reps.sparkSession
    broadcast = spark.sparkContext.broadcast  # tallies only, which have a fixed size
    often = broadcast(tally(reps.select("grams")))
    leads = broadcast(tally(reps.select("grams").mapInArrow(_lead_lists(t, often), "h long")))
    places = reps.select("id", "grams").mapInArrow(_places(t, often, leads), "gram long, cell long, id long, size int, place int")
    places = places.repartition(partitions_for(spark, leads.value.total * 40), "gram", F.shiftright("cell", 1)).sortWithinPartitions("gram", "cell")
    places = cut(places.mapInArrow(_partnered(t), "gram long, cell long, id long, size int, place int"))
    # cells of the same sets give the same pairs: the first in global order stands for all, as it holds each pair's first common gram
    side = F.when(F.shiftright("cell", 33) == F.shiftright("cell", 1).bitwiseAND(F.lit(0xFFFFFFFF)), -1).otherwise(F.col("cell").bitwiseAND(F.lit(1)))
    cells = places.groupBy("gram", F.shiftright("cell", 1).alias("pair")).agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id", side)).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), F.col("id"), side)).alias("x2"))
    cells = cells.groupBy("m", "x1", "x2").agg(F.min(F.struct("gram", "pair")).alias("c")).select("c.gram", "c.pair")
    places = cut(places.withColumn("pair", F.shiftright("cell", 1)).join(cells.hint("merge"), ["gram", "pair"]).drop("pair"))
    seen = broadcast(tally(places.select(F.xxhash64("id").alias("h"))))
    sets = reps.select("id", "grams", F.xxhash64("id").alias("h")).mapInArrow(_in_order(often, seen), "id long, grams array<bigint>")
    tails = places.join(sets.hint("merge"), "id").select("gram", "cell", "id", "size", F.expr("slice(grams, place + 2, greatest(size - place - 1, 0))").alias("tail"))
    moved = places.agg(F.coalesce(F.sum(8 * (F.col("size") - F.col("place")) + 40), F.lit(0))).first()[0]
    work = tails.repartition(partitions_for(spark, moved), "gram", F.shiftright("cell", 1)).sortWithinPartitions("gram", "cell")
    pairs = work.mapInArrow(_join(str(similarity)), "id_a long, id_b long, overlap long, size_a long, size_b long")
    # the group of a later common gram can give a pair again, with less of its overlap
    return pairs.groupBy("id_a", "id_b", "size_a", "size_b").agg(F.max("overlap").alias("overlap")).select("id_a", "id_b", "overlap", "size_a", "size_b")


def similar_records(df: DataFrame, key: str, text: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (key_a, key_b, similarity) with key_a < key_b for all pairs of records, members of equal sets included.

    Members of a set with many copies are taken in blocks, so that no task holds all of them.
    """
    reps, members = gram_sets(df, key, text, words)
    members = cut(members)
    copies = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    blocks = cut(copies.select("id", F.ceil(F.col("copies") / COPIES).cast("int").alias("k")))
    pairs = similar_sets(reps, similarity).select("id_a", "id_b", (F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))).alias("similarity"))
    pairs = pairs.unionByName(blocks.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity")))
    members = members.join(blocks.where("k > 1").hint("merge"), "id", "left").select("id", "key", F.pmod(F.xxhash64("key"), F.coalesce("k", F.lit(1))).cast("int").alias("b"))
    for x in ("a", "b"):
        large = blocks.where("k > 1").select(F.col("id").alias(f"id_{x}"), "k").hint("merge")
        pairs = pairs.join(large, f"id_{x}", "left").withColumn(f"b_{x}", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    for x in ("a", "b"):
        pairs = pairs.join(members.select(F.col("id").alias(f"id_{x}"), F.col("b").alias(f"b_{x}"), F.col("key").alias(f"key_{x}")).hint("merge"), [f"id_{x}", f"b_{x}"])
    pairs = pairs.where((F.col("id_a") != F.col("id_b")) | (F.col("key_a") < F.col("key_b")))
    return pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "similarity")


def similar_groups(df: DataFrame, key: str, text: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Rows (key, group_key, copies, links), one for each record with a gram: its group is that of all records linked to it, directly
    or through others, named by its smallest key. links: similar sets of the record's set. Groups come from label propagation
    with pointer jumping on representatives; labels are written to the shared checkpoint folder in each round."""
    reps, members = gram_sets(df, key, text, words)
    pairs = similar_sets(reps, similarity).select("id_a", "id_b")
    edges = cut(pairs.select(F.explode(F.array(F.struct(F.col("id_a").alias("u"), F.col("id_b").alias("v")), F.struct(F.col("id_b").alias("u"), F.col("id_a").alias("v")))).alias("e")).select("e.*"))
    labels = cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("c").alias("d")).hint("merge"), "v").groupBy("u").agg(F.min("d").alias("d"))
        lower = labels.join(near.hint("merge"), "u").select("u", F.least("c", "d").alias("n"), F.col("c").alias("was"))
        jump = lower.select(F.col("u").alias("n"), F.col("n").alias("nn"))
        new = cut(lower.join(jump.hint("merge"), "n", "left").select("u", F.least("n", F.coalesce("nn", "n")).alias("c"), "was"))
        labels = new.select("u", "c")
        if new.where("c <> was").isEmpty():
            break
    links = edges.groupBy("u").agg(F.count(F.lit(1)).alias("links"))
    named = reps.select("id", "rep").join(labels.withColumnRenamed("u", "id").hint("merge"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    names = named.groupBy("c").agg(F.min("rep").alias("group_key"))
    copies = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    out = named.join(names.hint("merge"), "c").join(copies.hint("merge"), "id").join(links.withColumnRenamed("u", "id").hint("merge"), "id", "left")
    return members.join(out.select("id", "group_key", "copies", F.coalesce("links", F.lit(0)).alias("links")).hint("merge"), "id").select("key", "group_key", "copies", "links")
