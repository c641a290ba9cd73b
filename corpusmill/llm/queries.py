"""Queries p2 to p10 of this subpackage, and the SQL that states those results which SQL can state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.functions import wikitext
from corpusmill.llm import bpe, cooccurrence, markup, neardup, packing, residue, sampling, splitting
from corpusmill.runtime import read, ship


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.item_pairs(read(spark, sf_dir, "entity_links"), "chunk_id", "target_page_id", 5, 4.0)
    return pairs.select(F.col("item_a").alias("page_a"), F.col("item_b").alias("page_b"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.item_pairs(read(spark, sf_dir, "entity_links"), "chunk_id", "target_page_id", 5, 4.0)
    return pairs.withColumn("lift", F.round("lift", 6)).withColumn("odds_ratio", F.round("odds_ratio", 4)).withColumnsRenamed({"item_a": "page_a", "item_b": "page_b"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.residue_blocks(read(spark, sf_dir, "chunks"), "chunk_id", "text")
    return found.where("chunk_id IS NOT NULL").select("chunk_id").distinct()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "chunks").select(F.lit("chunk").alias("source"), F.col("chunk_id").alias("record"), "text")
    pages = read(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.concat_ws(":", "snapshot_no", "pageid", "revid").alias("record"), F.col("wikitext").alias("text"))
    return markup.clean_texts(chunks.unionByName(pages), ["source", "record"], "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.similar_records(read(spark, sf_dir, "chunks"), "chunk_id", "text", 3, 0.6)
    return pairs.select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(read(spark, sf_dir, "chunks"), "chunk_id", "text", 5, 0.8).withColumnRenamed("key", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(read(spark, sf_dir, "chunks"), ["chunk_id"], "text", oversized_only=True).where("chunk_id IS NOT NULL").select("chunk_id").distinct()


def page_sections(pages: DataFrame) -> DataFrame:
    """Rows (snapshot_no, pageid, revid, section_seq, section_heading, body) of the sections of each page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, seq, path, body = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for s in wikitext.sections(text):
                    row.append(i)
                    seq.append(s.seq)
                    path.append(s.path)
                    body.append(s.body)
            kept = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq, pa.int32()), pa.array(path, pa.string()), pa.array(body, pa.string())], ["snapshot_no", "pageid", "revid", "section_seq", "section_heading", "body"])

    rows = pages.where("wikitext IS NOT NULL").select("snapshot_no", "pageid", "revid", "wikitext")
    return rows.mapInArrow(run, "snapshot_no int, pageid long, revid long, section_seq int, section_heading string, body string")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "chunks").select(F.lit("chunk").alias("source"), F.col("chunk_id").alias("record"), "section_heading", "text")
    sections = page_sections(read(spark, sf_dir, "pages")).select(
        F.lit("page section").alias("source"), F.concat_ws(":", "snapshot_no", "pageid", "revid", "section_seq").alias("record"), "section_heading", F.col("body").alias("text")
    )
    out = splitting.split_texts(chunks.unionByName(sections), ["source", "record", "section_heading"], "text", oversized_only=True)
    return out.dropDuplicates(["source", "record", "piece_no", "piece"])


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str, str, str]:
    return read(spark, sf_dir, "chunks"), read(spark, sf_dir, "sample_targets"), "chunk_id", "book_level", "chunk_type"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_report(*_classes(spark, sf_dir)).where("shortfall > 0").select(F.col("level").alias("book_level"), F.col("kind").alias("chunk_type"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_report(*_classes(spark, sf_dir)).select(F.col("level").alias("book_level"), F.col("kind").alias("chunk_type"), "available", "needed", "drawn", "shortfall")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(*_classes(spark, sf_dir)).select(F.col("k").alias("chunk_id"), F.col("level").alias("book_level"), F.col("kind").alias("chunk_type"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(r[0], r[1]) for r in read(spark, sf_dir, "containers").select("container_name", "capacity_tokens").distinct().collect()]  # one row for each kind of container
    items = packing.measure(read(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(items, sorted(kinds, key=str)).withColumnRenamed("item", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue.residue_documents(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.where("doc_id IS NOT NULL").select("doc_id").distinct()


QUERIES = {
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_report": p6_report, "p6_sample": p6_sample,
    "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found,
}

_PAIRS = """
WITH l AS (SELECT DISTINCT chunk_id, target_page_id::BIGINT p FROM entity_links WHERE chunk_id IS NOT NULL AND target_page_id IS NOT NULL),
t AS (SELECT count(DISTINCT chunk_id) n FROM entity_links), c AS (SELECT p, count(*) n FROM l GROUP BY 1),
s AS (SELECT a.p pa, b.p pb, count(*) shared FROM l a JOIN l b ON a.chunk_id = b.chunk_id AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT pa AS page_a, pb AS page_b, shared, ca.n AS n_a, cb.n AS n_b, t.n AS n_records FROM s JOIN c ca ON ca.p = pa JOIN c cb ON cb.p = pb CROSS JOIN t WHERE shared * t.n >= 4 * ca.n * cb.n)
"""
_SIMILAR = r"""
WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL), w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM c),
g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - %d + 2), lambda i: array_to_string(w[i:i + %d - 1], ' '))) g FROM w),
n AS (SELECT chunk_id, count(*) n FROM g GROUP BY 1), o AS (SELECT a.chunk_id ka, b.chunk_id kb, count(*) o FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
p AS (SELECT ka, kb, o, na.n na, nb.n nb FROM o JOIN n na ON na.chunk_id = ka JOIN n nb ON nb.chunk_id = kb WHERE o * %d >= %d * (na.n + nb.n - o))
"""
_SHARES = """
WITH c AS (SELECT chunk_id, book_level, lower(trim(chunk_type)) kind FROM (SELECT DISTINCT chunk_id, book_level, chunk_type FROM chunks WHERE chunk_id IS NOT NULL)),
z AS (SELECT floor(count(*) / 10)::BIGINT n FROM c),
w AS (SELECT book_level::BIGINT AS book_level, lower(trim(chunk_type)) AS chunk_type, max(greatest(min_rows, target_permille * n // 1000))::BIGINT AS needed FROM sample_targets, z GROUP BY 1, 2),
r AS (SELECT w.*, count(c.chunk_id) AS available FROM w LEFT JOIN c ON c.book_level = w.book_level AND c.kind = w.chunk_type GROUP BY ALL)
"""
#: White space as Unicode and the standard string splitting have it.
_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ORACLE = {
    "p2_found": _PAIRS + "SELECT page_a, page_b FROM f",
    "p2_pairs": _PAIRS + """SELECT page_a, page_b, shared, n_a, n_b, n_records, round(shared * n_records / (n_a * n_b)::DOUBLE, 6) AS lift,
 round(((shared + 0.5::DOUBLE) * (n_records - n_a - n_b + shared + 0.5::DOUBLE)) / ((n_a - shared + 0.5::DOUBLE) * (n_b - shared + 0.5::DOUBLE)), 4) AS odds_ratio FROM f""",
    "p4_found": _SIMILAR % (3, 3, 5, 3) + "SELECT ka AS chunk_id_a, kb AS chunk_id_b FROM p",
    "p4_groups": _SIMILAR % (5, 5, 5, 4) + """, e AS (SELECT ka a, kb b, o = na AND o = nb same FROM p UNION ALL SELECT kb, ka, o = na AND o = nb FROM p),
 r(k, m) AS (SELECT chunk_id, chunk_id FROM n UNION SELECT r.k, e.b FROM r JOIN e ON r.m = e.a), s AS (SELECT n.chunk_id, least(n.chunk_id, coalesce(min(e.b), n.chunk_id)) rep, 1 + count(e.b) copies FROM n LEFT JOIN e ON e.a = n.chunk_id AND e.same GROUP BY n.chunk_id),
 k AS (SELECT e.a, count(DISTINCT s.rep) links FROM e JOIN s ON s.chunk_id = e.b WHERE NOT e.same GROUP BY 1), gk AS (SELECT k, min(m) group_key FROM r GROUP BY 1)
 SELECT s.chunk_id, gk.group_key, s.copies, coalesce(k.links, 0) AS links FROM s JOIN gk ON gk.k = s.chunk_id LEFT JOIN k ON k.a = s.chunk_id""",
    "p5_found": rf"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '')) > 380",
    "p6_found": _SHARES + "SELECT book_level, chunk_type FROM r WHERE available < needed",
    "p6_report": _SHARES + "SELECT book_level, chunk_type, available, needed, least(available, needed) AS drawn, greatest(0, needed - available) AS shortfall FROM r",
    "p6_sample": _SHARES + """SELECT chunk_id, book_level, chunk_type FROM (SELECT c.chunk_id, r.book_level, r.chunk_type, r.needed,
 row_number() OVER (PARTITION BY r.book_level, r.chunk_type ORDER BY md5('sample:' || c.chunk_id), c.chunk_id) k FROM c JOIN r ON c.book_level = r.book_level AND c.kind = r.chunk_type) WHERE k <= needed""",
}
