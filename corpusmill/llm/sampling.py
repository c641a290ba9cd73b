"""A sample whose classes follow target shares, with a minimum from small classes and a report of those that fall short.

Every row has a priority, a hash of its key; a class's reservoir of size k holds the k rows of lowest priority, which is a uniform
sample and merges by union. Each task makes the reservoirs of its rows in one pass, no larger than the class's quota can become
by the rows delivered, with the numbers of rows that it saw. The union of the tasks' reservoirs is written once to the shared folder, by class
and priority level; the final counts then fix the feasible quotas, and each class is trimmed: whole levels below one, and of
that level, a 4096th of the class, the rows of lowest priority. The table is read once for sample and report.

Defined cases
    Null keys are no rows; repeated keys count once. Classes compare by level and by kind, trimmed and in lower case; rows of no
    target class count in the total only. A class with fewer rows than its quota is taken whole and reported. Targets named
    twice count once, with the larger of their quotas. An empty table gives an empty sample and quotas of `min_rows`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from corpusmill.runtime import cut, ship

LEVEL_DIGITS = 3
#: Rows of a task's reservoirs that are held before they are trimmed.
HELD = 1 << 18


def _reservoirs(most: dict[tuple[int, str], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (k, level, kind, priority, seen): the reservoirs of a task, and rows without a key for the numbers of rows seen, classes of no target together."""
    classes = list(most)
    number = {c: i for i, c in enumerate(classes)}
    quota = np.array([most[c] for c in classes], "int64")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(classes) + 1, "int64")
        keys, priorities, of = [], [], []

        def trim() -> None:
            """Of each class the rows of lowest priority, equal ones of the last place included."""
            p, c = pa.chunked_array(priorities).combine_chunks(), np.concatenate(of)
            first = np.array([int(x[:15], 16) for x in p.to_pylist()], "int64")
            order = np.lexsort((first, c))
            place = np.arange(len(c)) - np.searchsorted(c[order], c[order])
            last = np.full(len(classes), 1 << 62)
            inside = place == quota[c[order]] - 1
            last[c[order][inside]] = first[order][inside]
            keep = pa.array((first <= last[c]) & (quota[c] > 0))
            keys[:], priorities[:], of[:] = [pa.chunked_array(keys).combine_chunks().filter(keep)], [p.filter(keep)], [c[keep.to_numpy(zero_copy_only=False)]]

        held = 0
        for batch in batches:
            c = np.array([number.get(x, len(classes)) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], "int64")
            seen += np.bincount(c, minlength=len(classes) + 1)
            mine = pa.array(c < len(classes))
            keys.append(batch.column(0).filter(mine))
            priorities.append(batch.column(3).filter(mine))
            of.append(c[c < len(classes)])
            held += len(of[-1])
            if held > HELD:
                trim()
                held = len(of[0]) // 2  # a reservoir that can't be trimmed is held whole, as it is the task's own rows
        if of:
            trim()
            c = of[0]
            level, kind = [classes[i][0] for i in c.tolist()], [classes[i][1] for i in c.tolist()]
            yield pa.RecordBatch.from_arrays([keys[0], pa.array(level, pa.int64()), pa.array(kind, pa.string()), priorities[0], pa.array([0] * len(c), pa.int64())], ["k", "level", "kind", "priority", "seen"])
            level, kind = [*(c[0] for c in classes), None], [*(c[1] for c in classes), None]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(seen), keys[0].type), pa.array(level, pa.int64()), pa.array(kind, pa.string()), pa.nulls(len(seen), pa.string()), pa.array(seen)], ["k", "level", "kind", "priority", "seen"])

    return run


def reservoirs(df: DataFrame, targets: DataFrame, key: str, level: str, kind: str, share: float = 0.1, seed: str = "sample") -> tuple[DataFrame, DataFrame]:
    """The reservoirs of the target classes with the numbers of rows seen, written to the shared folder, and the report
    (level, kind, available, needed, drawn, shortfall, below, edge, within).

    below: the highest priority level that is taken whole; edge and within: the level of which only some rows are, and how many.
    """
    spark = df.sparkSession
    ship(spark)
    wanted = targets.where(F.col("book_level").isNotNull() & F.col("chunk_type").isNotNull()).groupBy(F.col("book_level").cast("long").alias("level"), F.lower(F.trim("chunk_type")).alias("kind"))
    wanted = wanted.agg(F.collect_set(F.struct(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)).alias("least"), F.coalesce("target_permille", F.lit(0)).cast("long").alias("permille"))).alias("terms"))
    terms = {(r.level, r.kind): [(t.least, t.permille) for t in r.terms] for r in wanted.collect()}  # a row for each target class

    def quotas(rows: int) -> dict[tuple[int, str], int]:
        size = int(rows * share + 1e-9)
        return {c: max(max(least, permille * size // 1000) for least, permille in ts) for c, ts in terms.items()}

    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.struct(F.col(level).cast("long").alias("level"), F.lower(F.trim(F.col(kind))).alias("kind"))).alias("c"))
    rows = rows.select("k", "c.level", "c.kind", F.md5(F.concat(F.lit(seed + ":"), F.col("k").cast("string"))).alias("priority"))
    most = quotas(df.count())  # the rows delivered are at least as many as the distinct ones
    held = cut(rows.mapInArrow(_reservoirs(most), f"k {dict(df.dtypes)[key]}, level long, kind string, priority string, seen long"))
    counts = {(r.level, r.kind): r.n for r in held.where("k IS NULL").groupBy("level", "kind").agg(F.sum("seen").alias("n")).collect()}  # a row for each target class
    needed = quotas(sum(counts.values()))
    classes = spark.createDataFrame([(*c, counts.get(c, 0), n) for c, n in needed.items()], "level long, kind string, available long, needed long")
    filled = held.where("k IS NOT NULL").groupBy("level", "kind", F.substring("priority", 1, LEVEL_DIGITS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = classes.join(filled, ["level", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bins = bins.withColumn("upto", F.sum("n").over(W.partitionBy("level", "kind").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))  # 4096 rows of a class
    whole = F.col("upto") <= F.col("needed")
    report = bins.groupBy("level", "kind", "available", "needed").agg(F.max(F.when(whole, F.col("bin"))).alias("below"), F.min(F.when(~whole, F.col("bin"))).alias("edge"), F.max(F.when(whole, F.col("upto")).otherwise(0)).alias("taken"))
    drawn = F.least("available", "needed")
    return held, report.select("level", "kind", "available", "needed", drawn.alias("drawn"), F.greatest(F.lit(0), F.col("needed") - F.col("available")).alias("shortfall"), F.coalesce("below", F.lit("")).alias("below"), "edge", (drawn - F.col("taken")).alias("within"))


def quota_report(*args, **kwargs) -> DataFrame:
    """Rows (level, kind, available, needed, drawn, shortfall) of the target classes; arguments as of `reservoirs`."""
    return reservoirs(*args, **kwargs)[1].drop("below", "edge", "within")


def draw(*args, **kwargs) -> DataFrame:
    """Rows (k, level, kind) of the sample; arguments as of `reservoirs`."""
    held, report = reservoirs(*args, **kwargs)
    rows = held.where("k IS NOT NULL").join(F.broadcast(report.select("level", "kind", "below", "edge", "within")), ["level", "kind"])  # a row for each target class
    bin_ = F.substring("priority", 1, LEVEL_DIGITS)
    edge = rows.where((bin_ == F.col("edge")) & (F.col("within") > 0))
    edge = edge.withColumn("r", F.row_number().over(W.partitionBy("level", "kind").orderBy("priority", "k"))).where(F.col("r") <= F.col("within"))
    return rows.where(bin_ <= F.col("below")).select("k", "level", "kind").unionByName(edge.select("k", "level", "kind"))
