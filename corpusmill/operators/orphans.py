"""References to records that do not exist, by table and period.

Keys of parents and references become codes of 128 bits (integers stand for themselves) and are put into ranges of code order,
together. In each range the parents are held as sorted arrays and the references are probed in batches by binary search. Both sides
are reduced before they are moved: references to distinct ones, so that a key that holds a third of them is a few rows, and
parents to those whose code is in a tally of the references' codes. Ranges are sized by what is left of both sides.

Defined cases
    Null keys on either side are ignored. Keys are compared as written. Repeated references count once; `refs` says how many
    rows were delivered for one. A reference with a null period exists if any period has the key and is `missing` otherwise. Empty tables
    give no rows, or make every reference `missing`. Only the key and period columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.operators.tally import tally
from corpusmill.runtime import cut, partitions_for, ship

#: Bytes of a range, and of one of its rows.
RANGE_BYTES, ROW_BYTES = 16 << 20, 48
#: Stands for "no period" among the parents' periods.
ALWAYS = -(1 << 62)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of codes: rows (c1, c2, period, tag, label, key, refs), the parents with refs null."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    c1, c2 = table["c1"].to_numpy(), table["c2"].to_numpy()
    # one number for each code, in their order
    order = np.lexsort((c2, c1))
    new = np.ones(len(order), bool)
    new[1:] = (c1[order[1:]] != c1[order[:-1]]) | (c2[order[1:]] != c2[order[:-1]])
    key = np.empty(len(order), "int64")
    key[order] = np.cumsum(new)
    period = table["period"].fill_null(ALWAYS).to_numpy()
    parent = table["refs"].is_null().to_numpy()
    pk, pp = key[parent], period[parent]
    order = np.lexsort((pp, pk))
    pk, pp = pk[order], pp[order]
    probes = np.flatnonzero(~parent)
    for at in range(0, len(probes), 1 << 16):
        rows = probes[at : at + (1 << 16)]
        k, p = key[rows], period[rows]
        lo, hi = np.searchsorted(pk, k, "left"), np.searchsorted(pk, k, "right")
        known = hi > lo
        first, last = np.full(len(k), ALWAYS), np.full(len(k), ALWAYS)
        first[known], last[known] = pp[lo[known]], pp[hi[known] - 1]
        there = known & ((p == ALWAYS) | (first == ALWAYS))
        # binary search for the period inside each key's run of parent rows
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) // 2
            less = np.zeros(len(k), bool)
            less[open_] = pp[mid[open_]] < p[open_]
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        hit = known & (a < hi)
        hit[hit] = pp[a[hit]] == p[hit]
        missed = ~(there | hit)
        reason = np.where(known & (first < p), "deleted", np.where(known & (last > p), "late", "missing"))
        out = table.select(["tag", "label", "key", "refs"]).take(pa.array(rows[missed])).append_column("reason", pa.array(reason[missed].tolist(), pa.string()))
        yield from out.select(["tag", "label", "key", "reason", "refs"]).to_batches()


def _wanted(seen) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parents (c1, c2, period) whose code may be referred to; repeated ones of a batch come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(seen.value.level(batch.column(3).to_numpy()) > 0)).select(["c1", "c2", "period"])
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).select(batch.schema.names).to_batches()

    return run


def orphan_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows (table_name, ref_period, ref_key, reason, refs), one for each table, period and key without a parent.

    references: (tag STRING, label STRING, period BIGINT, key); parents: (key, period BIGINT), a null period meaning always.
    A key that the parents have in another period is `deleted` (an earlier one) or `late` (a later one), otherwise `missing`.
    """
    spark = references.sparkSession
    ship(spark)
    integral = {"bigint", "int", "smallint", "tinyint"}
    if dict(parents.dtypes)["key"] in integral and dict(references.dtypes)["key"] in integral:
        codes = F.col("key").cast("long").alias("c1"), F.lit(0).cast("long").alias("c2")
    else:
        codes = F.xxhash64(F.col("key").cast("string")).alias("c1"), F.xxhash64(F.lit(7), F.col("key").cast("string")).alias("c2")
    probes = references.where(F.col("key").isNotNull()).groupBy("tag", "label", "period", "key").agg(F.count(F.lit(1)).alias("refs"))
    probes = cut(probes.select(*codes, "period", "tag", "label", F.col("key").cast("string").alias("key"), "refs"))
    seen = spark.sparkContext.broadcast(tally(probes.select(F.xxhash64("c1", "c2").alias("h"))))  # of fixed size
    known = parents.where(F.col("key").isNotNull()).select(*codes, F.col("period").cast("long").alias("period"))
    known = cut(known.select("c1", "c2", "period", F.xxhash64("c1", "c2").alias("h")).mapInArrow(_wanted(seen), "c1 long, c2 long, period long"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("tag", "string"), ("label", "string"), ("key", "string"), ("refs", "long"))]
    ranges = partitions_for(spark, (seen.value.total + known.count()) * ROW_BYTES, RANGE_BYTES)
    out = probes.unionByName(known.select("c1", "c2", "period", *none)).repartitionByRange(ranges, "c1", "c2")
    out = out.mapInArrow(_probe, "tag string, label string, key string, reason string, refs long")
    return out.select(F.col("tag").alias("table_name"), F.col("label").alias("ref_period"), F.col("key").alias("ref_key"), "reason", "refs")


def references(df: DataFrame, table: str, key: str, label: Column, period: Column | None = None) -> DataFrame:
    return df.select(F.lit(table).alias("tag"), label.cast("string").alias("label"), (F.lit(None) if period is None else period).cast("long").alias("period"), F.col(key).alias("key"))


def corpus_orphans(links: DataFrame, pages: DataFrame, samples: DataFrame, labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Orphans of the link table against the pages of its own snapshot, and of the two label tables against the chunks."""
    number = F.col("snapshot_no")
    by_page = orphan_keys(
        references(links, "entity_links", "target_page_id", number, number),
        pages.select(F.col("pageid").alias("key"), number.cast("long").alias("period")),
    )
    by_chunk = orphan_keys(
        references(samples, "adversarial_sample", "chunk_id", F.substring("drawn_at", 1, 7)).unionByName(references(labels, "manual_labels", "chunk_id", F.substring("labeled_at", 1, 7))),
        chunks.select(F.col("chunk_id").alias("key"), F.lit(None).cast("long").alias("period")),
    )
    return by_page.unionByName(by_chunk)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Distinct keys without a parent by table, period and reason."""
    return orphans.groupBy("table_name", "ref_period", "reason").agg(F.count(F.lit(1)).alias("orphan_keys"))
