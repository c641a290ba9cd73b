"""Scores of labelers and of retrieval: accuracy, recall, intervals, confusion, gates, ranks, hit rates and reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import ship

#: Bytes of query vectors that are sent to all tasks at once; more queries go in blocks.
QUERY_BYTES = 32 << 20


def score_pairs(pairs: DataFrame, level: int = 2) -> DataFrame:
    """One row (n, correct, accuracy, low, high, positives, caught, recall) of (actual, predicted); recall of `level` counts higher predictions as caught. Nothing scores 0."""
    n, right = F.count(F.lit(1)), F.count_if(F.col("actual") == F.col("predicted"))
    of, caught = F.count_if(F.col("actual") == level), F.count_if((F.col("actual") == level) & (F.col("predicted") >= level))
    low, high = T.wilson(F.col("correct"), F.col("n"))
    rows = pairs.agg(n.alias("n"), right.alias("correct"), of.alias("positives"), caught.alias("caught"))
    return rows.select("n", "correct", F.round(T.ratio(F.col("correct"), F.col("n")), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), "positives", "caught", F.round(T.ratio(F.col("caught"), F.col("positives")), 6).alias("recall"))


def confusion_matrix(pairs: DataFrame, levels: list[int]) -> DataFrame:
    """Rows (actual, predicted, n) of all combinations of the levels, empty ones included."""
    dim = pairs.sparkSession.createDataFrame([(a, p) for a in levels for p in levels], "actual int, predicted int")
    counts = pairs.groupBy(F.col("actual").cast("int").alias("actual"), F.col("predicted").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gate(recall: DataFrame, refined: DataFrame, least_recall: float = 0.80, least_accuracy: float = 0.90) -> DataFrame:
    """One row (recall, accuracy, passed): both thresholds must hold."""
    both = recall.select("recall").crossJoin(refined.select("accuracy"))  # two single rows
    return both.withColumn("passed", (F.col("recall") >= least_recall) & (F.col("accuracy") >= least_accuracy))


def lost_targets(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The queries whose target isn't in the corpus."""
    return queries.join(corpus.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_anti")


def target_ranks(queries: DataFrame, corpus: DataFrame, digits: int = 9) -> DataFrame:
    """Rows (query_id, rank): 1 and the number of corpus vectors strictly more similar to the query than its target.

    queries: (query_id, vector, target_id); corpus: (id, vector). Ties rank equal. Similarity is the dot product, rounded to `digits`.
    Queries are held in blocks of a checked size; the corpus streams past each block once and only counts are shuffled. A query whose
    target isn't in the corpus is an error, as scores over fewer queries would look better than they are.
    """
    spark = queries.sparkSession
    ship(spark)
    lost = [r[0] for r in lost_targets(queries, corpus).select("query_id").orderBy("query_id").limit(5).collect()]
    if lost:
        raise ValueError(f"queries without their target in the corpus: {', '.join(map(str, lost))}")
    queries = queries.join(corpus.select(F.col("id").alias("target_id"), F.col("vector").alias("target")), "target_id").select("query_id", "vector", "target")
    size = queries.agg(F.coalesce(F.sum(F.size("vector") * 16), F.lit(0))).first()[0]
    blocks = int(max(1, -(-size // QUERY_BYTES)))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect() if blocks > 1 else queries.collect()  # a block within QUERY_BYTES
        if not rows:
            continue
        q = np.array([r.vector for r in rows], "float64")
        own = np.round((q * np.array([r.target for r in rows], "float64")).sum(1), digits)
        held = spark.sparkContext.broadcast((q, own, np.array([r.query_id for r in rows], "int64")))

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, own, ids = held.value
            better = np.zeros(len(ids), "int64")
            for batch in batches:
                v = batch.column(0)
                m = v.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(v), -1)
                better += (np.round(m @ q.T, digits) > own).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(better)], ["query_id", "better"])

        part = corpus.where(F.col("vector").isNotNull()).select("vector").mapInArrow(count, "query_id long, better long").groupBy("query_id").agg((F.sum("better") + 1).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank long")


def retrieval_scores(ranks: DataFrame, strata: list[str] = (), ks: tuple[int, ...] = (1, 3, 5, 10), cutoff: int = 10) -> DataFrame:
    """Rows (stratum, value, n, hit_1, ..., mrr): overall and for each value of each stratum, to 4 digits; nothing scores 0."""
    hit = [F.round(F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)), 4).alias(f"hit_{k}") for k in ks]
    mrr = F.round(F.coalesce(F.avg(F.when(F.col("rank") <= cutoff, 1.0 / F.col("rank")).otherwise(0.0)), F.lit(0.0)), 4).alias("mrr")
    grains = [ranks.agg(F.count(F.lit(1)).alias("n"), *hit, mrr).select(F.lit("overall").alias("stratum"), F.lit("").alias("value"), "*")]
    for s in strata:
        grains.append(ranks.groupBy(F.col(s).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"), *hit, mrr).select(F.lit(s).alias("stratum"), "*"))
    out = grains[0]
    for g in grains[1:]:
        out = out.unionByName(g)
    return out
