"""Labels of chunks: the deterministic cascade, model records and their assembly, the manual log, costs, and audit tiers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import ship


class ContractError(ValueError):
    """Two tables that must hold the same keys don't."""


def level_of(codes: Column | str, levels: dict[str, int]) -> Column:
    """The highest level of the recognized codes; null if none is."""
    table = F.create_map(*[F.lit(x) for p in levels.items() for x in p])
    return F.array_max(F.filter(F.transform(F.array_distinct(T.col(codes)), lambda c: F.try_element_at(table, c)), lambda x: x.isNotNull()))


def cascade(chunks: DataFrame, gold: str, codes: str, levels: dict[str, int]) -> DataFrame:
    """Add level and provenance: the page's gold level, otherwise the highest cited level of the chunk itself, otherwise null."""
    cited = level_of(codes, levels)
    return chunks.withColumn("level", F.coalesce(F.col(gold), cited)).withColumn("provenance", F.when(F.col(gold).isNotNull(), "gold").when(cited.isNotNull(), "citation"))


def conservative(records: DataFrame, highest: int = 3) -> DataFrame:
    """A low confidence gives the highest level; the raw level is kept and the override flagged."""
    low = F.coalesce(F.col("confidence") == "low", F.lit(False))
    return records.withColumn("overridden", low).withColumn("book_level", F.when(low, highest).otherwise(F.col("book_level_raw")))


def contract(frame: DataFrame, records: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row (missing, unexpected): keys of the frame without a record, and of records without a row of the frame."""
    a, b = frame.select(key).distinct(), records.select(key).distinct()
    return a.join(b, key, "left_anti").agg(F.count(F.lit(1)).alias("missing")).crossJoin(b.join(a, key, "left_anti").agg(F.count(F.lit(1)).alias("unexpected")))  # two single rows


def assemble(chunks: DataFrame, records: DataFrame, checked: bool = True) -> DataFrame:
    """Chunks with the records' levels where they have none; other rows pass unchanged. Raises unless both hold the same keys."""
    if checked:
        gap = contract(chunks.where("label_provenance IS NULL"), records).first()
        if gap.missing or gap.unexpected:
            raise ContractError(f"{gap.missing} chunks have no record, {gap.unexpected} records have no chunk")
    mine = records.select("chunk_id", F.col("book_level").alias("_l"), F.col("book_level_raw").alias("_r"), F.col("confidence").alias("_c"))
    open_ = F.col("label_provenance").isNull() & F.col("_l").isNotNull()
    out = chunks.join(mine, "chunk_id", "left")
    return out.withColumn("book_level_raw", F.when(open_, F.col("_r"))).withColumn("label_confidence", F.when(open_, F.col("_c"))).withColumn("book_level", F.when(open_, F.col("_l")).otherwise(F.col("book_level"))).withColumn("label_provenance", F.when(open_, "llm").otherwise(F.col("label_provenance"))).drop("_l", "_r", "_c")


def require_labelled(before: DataFrame, after: DataFrame, key: str = "chunk_id", level: str = "book_level") -> None:
    """Raise unless an assembly has as many rows as before, no key twice and no row without a level."""
    facts = after.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), F.count_if(F.col(level).isNull()).alias("open")).first()
    n = before.count()
    problems = [f"{facts.n} rows instead of {n}"] * (facts.n != n) + [f"{facts.n - facts['keys']} repeated keys"] * (facts["keys"] != facts.n) + [f"{facts['open']} rows without a level"] * (facts["open"] > 0)
    if problems:
        raise ContractError("; ".join(problems))


def label_by_hand(todo: Iterable[dict], ask: Callable[[str], str], show: Callable[[str], None], clock: Callable[[], float], now: Callable[[], str], answers: Sequence[str] = ("1", "2", "3", "u"), stop: str = "q") -> Iterator[dict]:
    """Records (chunk_id, manual_book_level, seconds_spent, labeled_at) of a person's answers, one for each row of `todo`, as they are given.

    An answer that isn't known is asked for again; `stop` ends the session. What was labelled before is left out by `to_do`, so a session can be taken up again.
    """
    for row in todo:
        show(row["text"])
        began = clock()
        while (answer := ask(f"[{'/'.join(answers)}/{stop}] ").strip().lower()) not in answers:
            if answer == stop:
                return
        yield {"chunk_id": row["chunk_id"], "manual_book_level": answer, "seconds_spent": round(clock() - began, 1), "labeled_at": now()}


def artifact_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (rows, artifact_hash): a hash of all rows that doesn't depend on their order or on how they are spread over files."""
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    digest = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    both = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("s"))
    return both.select("rows", F.sha2(F.concat_ws(":", "rows", "s"), 256).alias("artifact_hash"))


def last_wins(log: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last record of each key of an append-only log; a partial aggregation, so a key of any number of records is no burden."""
    newest = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("r"))
    return newest.select(key, *[F.col(f"r.{v}").alias(v) for v in values])


def to_do(sample: DataFrame, log: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the sample without a label yet."""
    return sample.join(log.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def costs(usage: DataFrame, fresh: float, cached: float, output: float) -> DataFrame:
    """One row (input_tokens, cached_tokens, output_tokens, cost, cache_rate); rates are prices of a million tokens."""
    total = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens")])
    i, c, o = (F.col(x) for x in ("input_tokens", "cached_tokens", "output_tokens"))
    return total.withColumn("cost", F.round(((i - c) * fresh + c * cached + o * output) / 1e6, 4)).withColumn("cache_rate", F.round(T.ratio(c, i), 4))


def estimate(messages: DataFrame, text: str, instructions: int, output: int, price_in: float, price_out: float, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row (calls, input_tokens, output_tokens, cost) of a dry run; the token counter is pluggable, by default 4 tokens for 3 words."""
    count = tokens or (lambda c: F.ceil(T.word_count(c) * 4 / 3))
    rows = messages.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum(count(F.col(text)) + instructions), F.lit(0)).cast("long").alias("input_tokens"))
    rows = rows.withColumn("output_tokens", F.col("calls") * output)
    return rows.withColumn("cost", F.round((F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6, 4))


def call_model(rows: DataFrame, client: Callable[[], Callable[[str], dict]], key: str, message: str, result: str, tries: int = 3, backoff: float = 2.0, accept: Callable[[dict], bool] | None = None, content_tries: int = 1) -> DataFrame:
    """Rows (key, fields of `result`) of a model called once for each row, in batches, one client for each task.

    A call that fails is tried again after backoff * attempt seconds and raises, naming the row, after `tries`. A result that
    `accept` refuses is asked for again, `content_tries` times at most; the last one is kept. Fields named *_tokens are summed
    over all calls of a row. Tasks can run twice, so callers write results by key.
    """
    ship(rows.sparkSession)
    names = [f.split()[0] for f in result.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            out = []
            for k, m in zip(batch[key], batch[message]):
                spent: dict[str, int] = {}
                for _ in range(max(1, content_tries)):
                    for attempt in range(1, tries + 1):
                        try:
                            got = ask(m)
                            break
                        except Exception as e:
                            if attempt == tries:
                                raise RuntimeError(f"gave up on {k}: {e}") from e
                            time.sleep(backoff * attempt)
                    for n, v in got.items():
                        if n.endswith("_tokens"):
                            spent[n] = spent.get(n, 0) + v
                    if accept is None or accept(got):
                        break
                out.append({key: k, **got, **spent})
            yield pd.DataFrame(out, columns=[key, *names])

    return rows.select(key, message).mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, {result}")


def audit_tier(tiers: list[tuple[str, Column]]) -> Column:
    """The name of the first tier whose list of matched codes isn't empty, otherwise "none"."""
    out = F.lit("none")
    for name, found in reversed(tiers):
        out = F.when(F.size(F.coalesce(found, F.array())) > 0, F.lit(name)).otherwise(out)
    return out


def breakdown(df: DataFrame, column: str, null: str = "null") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(null)).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def fixed_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row with a count for each of the given values, 0 for absent ones."""
    return df.agg(*[F.count_if(F.coalesce(F.col(column) == v, F.lit(False))).alias(v) for v in values])
