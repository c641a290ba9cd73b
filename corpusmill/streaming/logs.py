"""Streams: the append-only label log with the last record winning, windowed counts with late data, and incremental changes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.runtime import scratch


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data directory, a file or a folder of files, as a stream of files."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def last_wins(stream: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The newest record of each key so far; state is one record for each key."""
    newest = stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("r"))
    return newest.select(key, *[F.col(f"r.{v}").alias(v) for v in values])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str, late: str) -> DataFrame:
    """Counts and sums by event-time window and group; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


def drain(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result, which the tasks write to the shared folder, as a table."""
    path = scratch(df.sparkSession, name)

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    q: StreamingQuery = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows (key, change): added, removed, changed or same, by a stable key and a content hash."""
    a = old.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(digest).alias("_a"))
    b = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(digest).alias("_b"))
    both = a.withColumn("_o", F.lit(True)).join(b.withColumn("_n", F.lit(True)), key, "full")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return both.select(key, kind.alias("change"))
