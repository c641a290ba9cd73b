"""What changed between consecutive full snapshots of a table.

Rows are reduced to one version for each (snapshot, key) by a partial aggregation. What is compared then is compact: keys are
hashed into buckets, each bucket holds for each snapshot a sorted array of keys and one of row hashes, and consecutive
snapshots are compared with binary searches in numpy. Full values are fetched only for the keys that differ.

Defined cases
    Null key or null snapshot: the row is ignored. Repeated rows: count once. Several rows of a key in a snapshot: the highest
    `version` counts, a null version being lowest; among equal versions the highest non-null `compare` values. A value that is
    null on one side is no difference for the columns in `null_is_unknown`, and is one for the other columns. Empty table: no
    rows. A table with one snapshot: no rows. Only the named columns are read, so further columns can have any name.
    Two versions with equal 64-bit row hashes are taken as the same. Keys that aren't integers are told apart by 128-bit codes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.runtime import partitions_for, ship

#: What a bucket should hold, and the compact bytes of one row in it: snapshot, code of two words and row hash.
BUCKET_BYTES, ROW_BYTES = 16 << 20, 32
KINDS = ("added", "removed", "changed")


def latest_versions(df: DataFrame, key: str, snapshot: str, version: str, compare: Sequence[str]) -> DataFrame:
    """One row (s, k, v, c0, c1, ...) for each snapshot and key: the row of the highest version."""
    values = [F.col(c).alias(f"c{i}") for i, c in enumerate(compare)]
    rows = df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(snapshot).cast("long").alias("s"), F.col(key).alias("k"), F.struct(F.col(version).alias("v"), *values).alias("r")
    )
    return rows.groupBy("s", "k").agg(F.max("r").alias("r")).select("s", "k", "r.*")


def _differing(snapshots: list[int]):
    """Compare the snapshots of one bucket; rows come sorted by snapshot and key."""

    def compare(table: pa.Table) -> pa.Table:
        s, h = table["s"].to_numpy(), table["h"].to_numpy()
        c1, c2 = table["c1"].to_numpy(), table["c2"].to_numpy()
        # one number for each code, in their order
        order = np.lexsort((c2, c1))
        new = np.ones(len(order), bool)
        new[1:] = (c1[order[1:]] != c1[order[:-1]]) | (c2[order[1:]] != c2[order[:-1]])
        k = np.empty(len(order), "int64")
        k[order] = np.cumsum(new) - 1
        c1, c2 = c1[order[new]], c2[order[new]]
        order = np.lexsort((k, s))
        s, k, h = s[order], k[order], h[order]
        out_s, out_k, out_kind = [], [], []
        bounds = {n: (np.searchsorted(s, n, "left"), np.searchsorted(s, n, "right")) for n in snapshots}
        for before, now in zip(snapshots, snapshots[1:]):
            (a, b), (c, d) = bounds[before], bounds[now]
            old, new = k[a:b], k[c:d]
            at = np.searchsorted(old, new)
            in_old = at < len(old)
            in_old[in_old] = old[at[in_old]] == new[in_old]
            back = np.searchsorted(new, old)
            in_new = back < len(new)
            in_new[in_new] = new[back[in_new]] == old[in_new]
            differs = np.zeros(len(new), bool)
            differs[in_old] = h[a:b][at[in_old]] != h[c:d][in_old]
            for kind, keys in enumerate((new[~in_old], old[~in_new], new[differs])):
                out_s.append(np.full(len(keys), now, "int64"))
                out_k.append(keys)
                out_kind.append(np.full(len(keys), kind, "int8"))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        k = cat(out_k, "int64")
        return pa.table({"s": cat(out_s, "int64"), "c1": c1[k], "c2": c2[k], "kind": cat(out_kind, "int8")})

    return compare


def snapshot_changes(
    df: DataFrame, key: str, snapshot: str, version: str, compare: Sequence[str] = (), null_is_unknown: Sequence[str] = ()
) -> DataFrame:
    """Rows (snapshot_no, key, change_kind, old_version, new_version): added, removed and changed keys of each snapshot.

    A key is changed when its version differs or one of the `compare` columns does. Keys are integers, or of any type that can
    be hashed; a hashed key is carried along and compared again when its values are fetched.
    """
    ship(df.sparkSession)
    numbers = sorted(r[0] for r in df.select(F.col(snapshot).cast("long")).where(F.col(snapshot).isNotNull()).distinct().collect())  # one row a delivery
    integral = dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint")
    codes = (F.col("k").cast("long") if integral else F.xxhash64("k")).alias("c1"), (F.lit(0).cast("long") if integral else F.xxhash64(F.lit(7), "k")).alias("c2")
    latest = latest_versions(df, key, snapshot, version, compare)
    hard = [f"c{i}" for i, c in enumerate(compare)]
    buckets = partitions_for(df.sparkSession, df.count() * ROW_BYTES, BUCKET_BYTES)
    compact = latest.select("s", *codes, F.xxhash64("v", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in hard]).alias("h"))
    bucket = F.pmod(F.xxhash64("c1", "c2"), F.lit(buckets)).cast("int")
    found = compact.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_differing(numbers), "s long, c1 long, c2 long, kind byte")

    both = latest.select(*codes, "s", "k", F.struct("v", *hard).alias("r"))
    previous = dict(zip(numbers[1:], numbers))
    if not previous:
        return both.where("false").select(F.col("s").alias("snapshot_no"), F.col("k").alias("key"), F.lit("").alias("change_kind"), F.col("r.v").alias("old_version"), F.col("r.v").alias("new_version"))
    # each differing key needs its row in this snapshot and in the one before: fetched by one join on (key, snapshot)
    wanted = found.select("c1", "c2", F.col("s").alias("now"), "kind", F.explode(F.array(F.col("s"), F.element_at(F.create_map(*[F.lit(x) for p in previous.items() for x in p]), F.col("s")))).alias("s"))
    rows = wanted.join(both.hint("merge"), ["c1", "c2", "s"]).groupBy("k", "now", "kind").agg(
        F.max(F.when(F.col("s") == F.col("now"), F.col("r"))).alias("new"), F.max(F.when(F.col("s") != F.col("now"), F.col("r"))).alias("old")
    )
    same = F.col("old.v").eqNullSafe(F.col("new.v"))
    for i, c in enumerate(compare):
        a, b = F.col(f"old.c{i}"), F.col(f"new.c{i}")
        same &= (a.isNull() | b.isNull() | (a == b)) if c in null_is_unknown else a.eqNullSafe(b)
    kinds = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return rows.where((F.col("kind") != 2) | ~same).select(
        F.col("now").alias("snapshot_no"), F.col("k").alias("key"), kinds.alias("change_kind"), F.col("old.v").alias("old_version"), F.col("new.v").alias("new_version")
    )


def page_changes(pages: DataFrame) -> DataFrame:
    """Changes of wiki pages by `revid` and by the instant that `rev_timestamp` denotes, however it is written."""
    rows = pages.select("snapshot_no", "pageid", "revid", F.expr("try_cast(rev_timestamp as timestamp)").alias("instant"))
    out = snapshot_changes(rows, "pageid", "snapshot_no", "revid", ["instant"], null_is_unknown=["instant"])
    return out.withColumnRenamed("key", "pageid")

