"""Reading and writing tables: JSON Lines, last-wins logs, frozen inputs, atomic files, manifests and reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Schemas of the project's tables.
PAGES = "pageid BIGINT, ns INT, title STRING, revid BIGINT, rev_timestamp STRING, wikitext STRING, fetched_at STRING"
CHUNKS = "chunk_id STRING, page_id BIGINT, page_title STRING, page_url STRING, ns INT, revid BIGINT, section_heading STRING, chunk_type STRING, text STRING, content_hash STRING, book_level INT, label_provenance STRING, citation_codes ARRAY<STRING>, is_speculation BOOLEAN, quality_flags ARRAY<STRING>, categories ARRAY<STRING>, word_count INT"
CHUNKS_LABELED = CHUNKS + ", book_level_raw INT, label_confidence STRING"
LABEL_RECORDS = "chunk_id STRING, book_level INT, book_level_raw INT, confidence STRING, rationale STRING, overridden BOOLEAN, model STRING, input_tokens BIGINT, cached_tokens BIGINT, output_tokens BIGINT"
SAMPLE = "chunk_id STRING, stratum STRING, matched_keyword STRING"
MANUAL_LABELS = "chunk_id STRING, manual_book_level STRING, seconds_spent DOUBLE, labeled_at STRING"
LINKS = "chunk_id STRING, source_page_id BIGINT, target_page_id BIGINT, target_page_title STRING, direction STRING, match_type STRING"
QUESTIONS = "question STRING, chunk_id STRING, book_level INT, chunk_type STRING"


class InputError(ValueError):
    """An input that can't be used as it is."""


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with a fixed schema; blank lines are skipped, absent fields are null."""
    return spark.read.schema(schema).json(path)


def read_jsonl_strict(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """The same, but a malformed line, a missing required field or no record at all is an error that says where."""
    fields = StructType.fromDDL(schema).add(StructField("_bad", StringType()))
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("_file", F.input_file_name())
    wrong = F.col("_bad").isNotNull()
    for c in required:
        wrong |= F.col(c).isNull()
    first = rows.select("*", wrong.alias("_wrong")).where("_wrong").take(1)
    if first:
        raise InputError(f"{first[0]['_file']}: {first[0]['_bad'] or 'missing ' + ', '.join(c for c in required if first[0][c] is None)}")
    if rows.isEmpty():
        raise InputError(f"{path}: no records")
    return rows.drop("_bad", "_file")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Rows (from, to) of a file that holds one JSON object; an absent file gives none."""
    if not Path(path).exists():
        return spark.createDataFrame([], "`from` string, `to` string")
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("from", "to"))


def frozen(spark: SparkSession, path: str, prefix: str) -> str:
    """The sha256 of a file; an error unless it begins with the pinned prefix."""
    digest = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if not digest.startswith(prefix):
        raise InputError(f"{path}: sha256 {digest[:12]} doesn't begin with {prefix}")
    return digest


def write_atomic(path: str, text: str) -> None:
    """Write a small file by a rename, so that readers see all of it or the one before."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_jsonl(df: DataFrame, path: str, order: list[str], optional: list[str] = ()) -> None:
    """JSON Lines in a global order, in as many files as Spark makes; null fields are kept but for the optional ones."""
    fields = [c for c in df.columns if c not in optional]
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if optional:
        extra = F.to_json(F.struct(*optional))
        line = F.when(extra == "{}", line).otherwise(F.concat(F.regexp_replace(line, r"\}$", ","), F.regexp_replace(extra, r"^\{", "")))
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(df: DataFrame, path: str, **extra) -> dict:
    """A one-row DataFrame as a JSON file next to its table."""
    record = json.loads(df.toJSON().first()) | extra
    write_atomic(path, json.dumps(record, indent=2, ensure_ascii=False, sort_keys=True) + "\n")
    return record


def markdown_table(df: DataFrame, title: str) -> str:
    """An aggregate as a table of a report, with all its rows."""
    rows = df.collect()
    cell = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def ignored(folder: str) -> None:
    """Keep an output folder out of version control."""
    path = Path(folder, ".gitignore")
    if not path.exists():
        write_atomic(str(path), "*\n")
