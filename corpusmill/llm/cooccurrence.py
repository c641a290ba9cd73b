"""How often items appear together in a record, and how far that exceeds chance.

Pairs of dense item numbers are packed into 64-bit codes. Tasks sort runs of codes and write each run as codes with counts;
Spark's shuffle sorts these runs externally, spilling and merging them by code, and a streaming pass adds up the counts of equal
codes across batches. Only then are pairs scored, by lift and by the odds ratio with continuity correction.

Nothing is dropped that can matter: an item in fewer records than a pair needs, or in so many that no pair with it can reach the
lift, cannot be in any result, and is left out before pairs are made. A record with more items than `BLOCK` is cut into blocks
of items and every pair of blocks is a unit of work of its own, so no task holds more than BLOCK * BLOCK pairs.

Defined cases
    Null records and null items make no pair; a record with only null items still counts in N. Repeated rows count once. An
    empty table gives no rows. Only the two columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.runtime import cut, partitions_for, ship

BLOCK = 1024
#: Bytes of a row (h, g, i, j, side, code) that is moved.
ROW_BYTES = 48
#: Codes that a task sorts as one run.
RUN = 1 << 21


def item_numbers(items: DataFrame, top: int) -> DataFrame:
    """Add `code`, below 2 ** 31: the item itself where all are such numbers, otherwise its place in key order."""
    if dict(items.dtypes)["item"] in ("bigint", "int", "smallint", "tinyint") and 0 <= top < 1 << 31:
        return items.withColumn("code", F.col("item").cast("long"))
    ordered = cut(items.repartitionByRange("item").sortWithinPartitions("item").withColumn("code", F.monotonically_increasing_id()))
    sizes = ordered.groupBy(F.shiftright("code", 33).alias("part")).count().orderBy("part").collect()  # one row for each partition
    starts = dict(zip([r[0] for r in sizes], np.cumsum([0] + [r[1] for r in sizes]).tolist()))
    start = F.element_at(F.create_map(*[F.lit(x) for p in starts.items() for x in p]), F.shiftright("code", 33)) if starts else F.lit(0)
    return ordered.withColumn("code", F.col("code") - F.shiftleft(F.shiftright("code", 33), 33) + start)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, g, i, j, side, code) sorted by record, two hashes of it, and by i and j: pairs inside block i (i = j) or between blocks i and j."""
    held: list[np.ndarray] = []
    n = 0

    def flush() -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(codes.astype("int64")), pa.array(counts.astype("int64"))], ["pair", "n"])

    def pairs(group: np.ndarray, side: np.ndarray, inner: bool) -> np.ndarray:
        if inner:
            a, b = np.triu_indices(len(group), 1)
            x, y = group[a], group[b]
        else:
            one, two = group[side == 0], group[side == 1]
            x, y = np.repeat(one, len(two)), np.tile(two, len(one))
        return (np.minimum(x, y) << 32) | np.maximum(x, y)

    carry: pa.Table | None = None

    def groups(table: pa.Table, last: bool):
        rec, rec2, i, j = (table[c].to_numpy() for c in ("h", "g", "i", "j"))
        new = np.flatnonzero((rec[1:] != rec[:-1]) | (rec2[1:] != rec2[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts = np.concatenate([[0], new])
        ends = np.concatenate([new, [len(rec)]])
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        code, side = table["code"].to_numpy(), table["side"].to_numpy()
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 1:
                yield pairs(code[a:b], side[a:b], i[a] == j[a])
        return None

    def tail(table: pa.Table) -> pa.Table:
        rec, rec2, i, j = (table[c].to_numpy() for c in ("h", "g", "i", "j"))
        same = (rec == rec[-1]) & (rec2 == rec2[-1]) & (i == i[-1]) & (j == j[-1])
        return table.slice(len(rec) - int(same.sum()))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carry is not None:
            table = pa.concat_tables([carry, table])
        table = table.combine_chunks()
        for codes in groups(table, False):
            held.append(codes)
            n += len(codes)
            if n >= RUN:
                yield flush()
                n = 0
        carry = tail(table)
    if carry is not None:
        held.extend(groups(carry, True))
    if held:
        yield flush()


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Run-length counts over codes that come in order; the last code of a batch may go on in the next."""
        code, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pair, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1])
            keys, sums = pair[starts], np.add.reduceat(n, starts)
            if code is not None:
                if keys[0] == code:
                    sums[0] += count
                else:
                    keys, sums = np.concatenate([[code], keys]), np.concatenate([[count], sums])
            code, count = int(keys[-1]), int(sums[-1])
            keep = sums[:-1] >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][keep]), pa.array(sums[:-1][keep])], ["pair", "shared"])
        if code is not None and count >= least:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], ["pair", "shared"])

    return run


def item_pairs(df: DataFrame, record: str, item: str, least_shared: int = 1, least_lift: float = 0.0) -> DataFrame:
    """Rows (item_a, item_b, shared, n_a, n_b, n_records, lift, odds_ratio) with item_a < item_b.

    Pairs in at least `least_shared` records for which shared * N >= least_lift * n_a * n_b.
    """
    spark = df.sparkSession
    ship(spark)
    n_records = df.agg(F.count_distinct(record)).first()[0]
    rows = df.where(F.col(record).isNotNull() & F.col(item).isNotNull()).select(F.xxhash64(record).alias("h"), F.xxhash64(F.lit(7), F.col(record)).alias("g"), F.col(item).alias("item")).distinct()
    rows = cut(rows)  # a record is two hashes of 64 bits from here on
    counted = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    useful = counted.where((F.col("n") >= least_shared) & (F.col("n") * F.lit(float(least_lift)) <= n_records))
    top = useful.agg(F.min("item"), F.max("item")).first() if dict(df.dtypes)[item] in ("bigint", "int", "smallint", "tinyint") else (None, None)
    items = cut(item_numbers(useful, -1 if top[0] is None or top[0] < 0 else top[1]))
    # items in more records than the lift allows are few, at most least_lift times the mean number of items in a record
    hot = [r[0] for r in counted.where(F.col("n") * F.lit(float(least_lift)) > n_records).select("item").collect()] if least_lift > 1 else []
    slim = (rows.where(~F.col("item").isin(hot)) if hot else rows).join(items.select("item", "code").hint("merge"), "item").select("h", "g", "code")

    sizes = slim.groupBy("h", "g").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > BLOCK).select("h", "g", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    cells = slim.join(large.hint("merge"), ["h", "g"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("code"), F.col("k")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))))
    cells = cells.select("h", "g", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"), "code")
    tasks = partitions_for(spark, rows.count() * ROW_BYTES)
    work = cells.repartition(tasks, "h", "g", "i", "j").sortWithinPartitions("h", "g", "i", "j")
    runs = work.mapInArrow(_runs, "pair long, n long")
    shared = runs.repartition(tasks, "pair").sortWithinPartitions("pair").mapInArrow(_merge(least_shared), "pair long, shared long")
    coded = shared.select(F.shiftright("pair", 32).alias("code_a"), (F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).alias("code_b"), "shared")
    side = lambda x: items.select(F.col("code").alias(f"code_{x}"), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
    out = coded.join(side("a").hint("merge"), "code_a").join(side("b").hint("merge"), "code_b").withColumn("n_records", F.lit(n_records).cast("long"))
    out = out.where(F.col("shared") * F.col("n_records") >= F.lit(float(least_lift)) * F.col("n_a") * F.col("n_b"))
    s, a, b, n = (F.col(c).cast("double") for c in ("shared", "n_a", "n_b", "n_records"))
    odds = ((s + 0.5) * (n - a - b + s + 0.5)) / ((a - s + 0.5) * (b - s + 0.5))
    first, second = F.least("item_a", "item_b"), F.greatest("item_a", "item_b")
    swapped = F.col("item_a") > F.col("item_b")
    return out.select(
        first.alias("item_a"), second.alias("item_b"), "shared", F.when(swapped, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swapped, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), "n_records",
        (s * n / (a * b)).alias("lift"), odds.alias("odds_ratio"),
    )
