"""Questions about chunks from a pluggable model: the pool, the prompt, the gate on what a question may refer to, and the records."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.functions import text as T
from corpusmill.operators.labeling import call_model

# Words by which a question gives away the form of its source, and the nouns of "according to the ...".
BARE = ["infobox", "listed", "stated", "section"]
NOUNS = ["wiki", "page", "article", "chapter", "entry", "infobox", "section", "speculation", "text", "list"]
RECORD = "question string, input_tokens long, cached_tokens long, output_tokens long"
CONTENT_TRIES = 4


def banned_reference(question: Column | str, bare: list[str] = BARE, nouns: list[str] = NOUNS) -> Column:
    """The first bare word that a question holds, otherwise its "according to the" and a structural noun, in lower case; null for none."""
    q = F.lower(T.col(question))
    phrase = F.regexp_extract(q, rf"\b(according to the (?:{'|'.join(nouns)}))\b", 1)
    out = F.when(phrase != "", phrase)
    for word in reversed(bare):
        out = F.when(F.coalesce(q.rlike(rf"\b{word}\b"), F.lit(False)), F.lit(word)).otherwise(out)
    return out


def refers_to_source(question: str, bare: list[str] = BARE, nouns: list[str] = NOUNS) -> str | None:
    """The same for one string, as the gate between two calls of a model."""
    low = question.lower()
    for word in bare:
        if re.search(rf"\b{word}\b", low):
            return word
    m = re.search(rf"\baccording to the (?:{'|'.join(nouns)})\b", low)
    return m.group() if m else None


def violations(questions: DataFrame, question: str = "question") -> DataFrame:
    """The questions that refer to their source, with what they refer to."""
    return questions.withColumn("banned_reference", banned_reference(question)).where("banned_reference IS NOT NULL")


def schema_violations(records: DataFrame, allowed: dict[str, list], required: list[str] = ()) -> DataFrame:
    """Rows with a first violation of an output schema: a required field that is null or blank, or a value outside the allowed ones."""
    out = F.lit(None).cast("string")
    for c, values in reversed(list(allowed.items())):
        out = F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), F.lit(c)).otherwise(out)
    for c in reversed(list(required)):
        out = F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)).otherwise(out)
    return records.withColumn("violation", out).where("violation IS NOT NULL")


def parsed(answers: DataFrame, answer: str, schema: str, allowed: dict[str, list], required: list[str] = ()) -> DataFrame:
    """JSON answers as columns of `schema`, with `violation`: "json" where it doesn't parse, or the first field that breaks the schema."""
    fields = [f.split()[0] for f in schema.split(", ")]
    rows = answers.withColumn("_r", F.from_json(answer, schema)).select(*answers.columns, *[F.col(f"_r.{f}").alias(f) for f in fields], F.col("_r").isNull().alias("_bad"))
    out = F.when(F.col("_bad") | F.coalesce(F.forall(F.array(*[F.col(f).isNull() for f in fields]), lambda x: x), F.lit(True)), "json")
    for c in required:
        out = out.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", c)
    for c, values in allowed.items():
        out = out.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), c)
    return rows.withColumn("violation", out).drop("_bad")


def questions(chunks: DataFrame, client: Callable[[], Callable[[str], dict]], accept: Callable[[str], str | None] = refers_to_source, content_tries: int = CONTENT_TRIES, **calls) -> DataFrame:
    """Rows (chunk_id, book_level, chunk_type, question, tokens, banned_reference) of one question for each chunk.

    A question that refers to its source is asked for again, `content_tries` times in all; the last is kept and marked. Tokens are summed over
    all calls of a chunk. The client answers a prompt with the fields of `RECORD`.
    """
    asked = chunks.select("chunk_id", "book_level", "chunk_type", T.prompt_fields("page_title", "section_heading", "chunk_type", "text").alias("prompt"))
    made = call_model(asked.where("prompt IS NOT NULL"), client, "chunk_id", "prompt", RECORD, accept=lambda got: accept(got["question"]) is None, content_tries=content_tries, **calls)
    return asked.drop("prompt").join(made, "chunk_id").withColumn("banned_reference", banned_reference("question"))
