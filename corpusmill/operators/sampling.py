"""Reproducible draws: quotas over a hash order that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W


def order_key(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def lowest(df: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """The n rows of lowest hash; Spark keeps n rows for each task."""
    return df.orderBy(order_key(seed, key), key).limit(n)


def two_strata(frame: DataFrame, keyword: Column, key: str = "chunk_id", size: int = 80, target: int = 48, seed: str = "sample") -> DataFrame:
    """Rows (key, stratum, matched_keyword): at most `target` rows with a keyword, and others up to `size`; a short pool of keywords is filled up with others."""
    rows = frame.select(key, keyword.alias("matched_keyword"))
    cluster = lowest(rows.where("matched_keyword IS NOT NULL"), seed, key, target).withColumn("stratum", F.lit("cluster"))
    drawn = cluster.agg(F.count(F.lit(1)).alias("drawn"))
    others = lowest(rows.where("matched_keyword IS NULL"), seed, key, size).withColumn("r", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(order_key(seed, key), key)))  # at most `size` rows
    random = others.crossJoin(F.broadcast(drawn)).where(F.col("r") <= size - F.col("drawn")).withColumn("stratum", F.lit("random"))
    return cluster.unionByName(random.select(*cluster.columns)).select(key, "stratum", "matched_keyword")


def floor_draw(pool: DataFrame, levels: dict[int, int | None], floors: dict[str, int], fill: str, key: str = "chunk_id", level: str = "book_level", kind: str = "chunk_type", seed: str = "draw") -> DataFrame:
    """Rows (key, level, kind): for each level with a target the floors of the small kinds, and the kind `fill` up to the target; a level without a target gives all its rows.

    The counts of the cells fix their quotas; each cell's rows of lowest hash are then taken by a top-n that keeps a quota's rows for each task.
    """
    rows = pool.where(F.col(level).isin(list(levels)) & F.col(kind).isin([*floors, fill])).select(key, level, kind)
    n = {(r[0], r[1]): r.n for r in rows.groupBy(level, kind).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
    out = rows.where(F.col(level).isin([x for x, target in levels.items() if target is None]))
    for x, target in levels.items():
        if target is None:
            continue
        quota = {k: min(f, n.get((x, k), 0)) for k, f in floors.items()}
        quota[fill] = max(target - sum(quota.values()), 0)
        for k, q in quota.items():
            if q and n.get((x, k)):
                out = out.unionByName(lowest(rows.where((F.col(level) == x) & (F.col(kind) == k)), seed, key, q))
    return out


def ordered(drawn: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A draw in the order of its keys, so that two runs of one seed write equal files."""
    return drawn.orderBy(key)


def draw_stats(frame: DataFrame, keyword: Column, size: int = 80, target: int = 48) -> DataFrame:
    """Rows (stat, name, n): the frame, the pools with and without a keyword, hits of each keyword, what is drawn of both pools and the shortfall."""
    hits = frame.select(keyword.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    with_, without = F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0))
    pools = hits.agg(with_.alias("c"), without.alias("r"))
    cluster = F.least("c", F.lit(target))
    random = F.least("r", F.lit(size) - cluster)
    stats = [("frame", F.col("c") + F.col("r")), ("cluster pool", F.col("c")), ("random pool", F.col("r")), ("cluster drawn", cluster), ("random drawn", random), ("shortfall", F.lit(size) - cluster - random)]
    rows = pools.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.lit("").alias("name"), n.cast("long").alias("n")) for s, n in stats])).alias("x")).select("x.*")
    return rows.unionByName(hits.where("k IS NOT NULL").select(F.lit("keyword").alias("stat"), F.col("k").alias("name"), "n"))


def contained(drawn: DataFrame, frame: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The drawn keys that the frame doesn't hold; a frozen draw is sound if there is none."""
    return drawn.select(key).distinct().join(frame.select(key).distinct(), key, "left_anti")


def disjoint(a: DataFrame, b: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The keys that both hold; none if they are disjoint."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def require_contained(drawn: DataFrame, frame: DataFrame, key: str = "chunk_id") -> None:
    """Raise, naming some keys, unless the frame holds all drawn ones."""
    lost = [r[0] for r in contained(drawn, frame, key).orderBy(key).limit(5).collect()]
    if lost:
        raise ValueError(f"not in the frame: {', '.join(map(str, lost))}")


def shuffled(df: DataFrame, seed: str, key: str) -> DataFrame:
    """The same rows in a display order that depends on seed and key alone."""
    return df.orderBy(order_key(seed, key), key)
