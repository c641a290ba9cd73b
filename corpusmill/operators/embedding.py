"""Vectors of texts from pluggable models, and the comparison of models by the ranks that their vectors give.

Models are made once for each task by a factory, so that a session or a client is never shipped. Vectors come out with length 1;
zero vectors stay zero. Rows are embedded in batches of exactly the model's size, across Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as T
from corpusmill.operators import evaluation as ev
from corpusmill.runtime import cut, ship

#: Texts of a request to a remote model and of a batch of a local one; tokens of a text that a local model reads.
REMOTE_BATCH, LOCAL_BATCH, MAX_TOKENS = 100, 32, 512
POOLINGS = ("cls", "mean")


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors * vectors).sum(-1, keepdims=True)), 1e-30)


def pooled(hidden: np.ndarray, mask: np.ndarray, pooling: str) -> np.ndarray:
    """One vector for each text of states (text, token, dimension): the first token's, or the mean over the tokens of the mask."""
    if pooling not in POOLINGS:
        raise ValueError(f"pooling must be one of {', '.join(POOLINGS)}")
    if pooling == "cls":
        return hidden[:, 0]
    weight = mask[..., None].astype(hidden.dtype)
    return (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


class LocalModel:
    """A model run in the task: `tokenize(texts, most)` gives (ids, mask), `run(ids, mask)` the states of all tokens."""

    def __init__(self, tokenize: Callable, run: Callable, pooling: str, most: int = MAX_TOKENS):
        if pooling not in POOLINGS:
            raise ValueError(f"pooling must be one of {', '.join(POOLINGS)}")
        self.tokenize, self.run, self.pooling, self.most = tokenize, run, pooling, most

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, int]:
        ids, mask = self.tokenize(texts, self.most)
        ids, mask = ids[:, : self.most], mask[:, : self.most]
        return pooled(self.run(ids, mask), mask, self.pooling), int(mask.sum())


def embedded(df: DataFrame, key: str, text: str, model: Callable[[], Callable[[list[str]], tuple[np.ndarray, int]]], batch: int = REMOTE_BATCH) -> DataFrame:
    """Rows (key, vector, tokens). `model()` gives a function of at most `batch` texts that returns their vectors and the tokens used;
    a batch's tokens stand in its first row, so their sum is the whole use. Null texts are embedded as empty ones."""
    ship(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = model()
        held: list[tuple] = []

        def made(rows: list[tuple]) -> pd.DataFrame:
            vectors, tokens = embed([t or "" for _, t in rows])
            if len(vectors) != len(rows):
                raise ValueError(f"{len(vectors)} vectors for {len(rows)} texts")
            return pd.DataFrame({key: [k for k, _ in rows], "vector": list(unit(np.asarray(vectors, "float64"))), "tokens": [tokens] + [0] * (len(rows) - 1)})

        for frame in frames:
            held += zip(frame[key], frame[text])
            while len(held) >= batch:
                yield made(held[:batch])
                held = held[batch:]
        if held:
            yield made(held)

    return df.select(key, text).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, vector array<double>, tokens long")


def prefixed(text: Column | str, prefix: str) -> Column:
    """What models with different sides want before a question, and never before a text of the corpus."""
    return F.concat(F.lit(prefix), T.col(text))


def bakeoff(corpus: DataFrame, questions: DataFrame, candidates: dict[str, tuple[Callable, int, str]], strata: list[str] = (), ks: tuple[int, ...] = (1, 3, 5, 10), digits: int = 9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same corpus and questions under several models: scores, ranks and use of tokens, each with a column `model`.

    corpus: (id BIGINT, text); questions: (query_id BIGINT, question, target_id BIGINT, strata). candidates: name to (model factory, batch, question prefix).
    Raises if a target isn't in the corpus.
    """
    scores = ranks = used = None
    for name, (model, batch, prefix) in candidates.items():
        texts = cut(embedded(corpus, "id", "text", model, batch))
        asked = cut(embedded(questions.select("query_id", prefixed("question", prefix).alias("question")), "query_id", "question", model, batch))
        mine = ev.target_ranks(asked.join(questions.select("query_id", "target_id"), "query_id").select("query_id", "vector", "target_id"), texts.select("id", "vector"), digits)
        mine = mine.join(questions.select("query_id", *strata), "query_id")
        named = lambda df, name=name: df.select(F.lit(name).alias("model"), "*")
        parts = named(ev.retrieval_scores(mine, list(strata), ks)), named(mine), named(texts.select("tokens").unionByName(asked.select("tokens")).agg(F.sum("tokens").alias("tokens")))
        scores, ranks, used = parts if scores is None else tuple(a.unionByName(b) for a, b in zip((scores, ranks, used), parts))
    return scores, ranks, used


def report(scores: DataFrame, used: DataFrame, prices: dict[str, float], title: str = "Comparison of models") -> str:
    """Markdown: the overall scores of each model, those by stratum, and what a run costs; prices are those of a million tokens."""
    rows = scores.collect()  # a row for each model and stratum
    marks = [c for c in scores.columns if c.startswith("hit_")] + ["mrr"]
    table = lambda head, lines: "\n".join(["| " + " | ".join(map(str, x)) + " |" for x in (head, ["-"] * len(head), *lines)])
    parts = [f"# {title}", "## Overall", table(["model", "n", *marks], [[r.model, r.n, *(f"{r[m]:.4f}" for m in marks)] for r in rows if r.stratum == "overall"])]
    for s in dict.fromkeys(r.stratum for r in rows if r.stratum != "overall"):
        parts += [f"## By {s}", table(["model", s, "n", *marks], [[r.model, r.value, r.n, *(f"{r[m]:.4f}" for m in marks)] for r in sorted((r for r in rows if r.stratum == s), key=lambda r: (str(r.value), r.model))])]
    parts += ["## Cost", table(["model", "tokens", "cost"], [[r.model, r.tokens, f"{r.tokens * prices.get(r.model, 0.0) / 1e6:.4f}"] for r in used.collect()])]
    return "\n\n".join(parts) + "\n"


def dry_run(corpus: DataFrame, questions: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Rows (model, texts, tokens, cost) of what a comparison would take, at 4 tokens for 3 words, without calling a model."""
    count = lambda df, c: df.agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.ceil(T.word_count(c) * 4 / 3)), F.lit(0)).cast("long").alias("tokens"))
    both = count(corpus, "text").unionByName(count(questions, "question")).agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    names = corpus.sparkSession.createDataFrame([(m, float(p)) for m, p in prices.items()], "model string, price double")
    return names.crossJoin(both).select("model", "texts", "tokens", F.round(F.col("tokens") * F.col("price") / 1e6, 4).alias("cost"))  # a single row on the right
