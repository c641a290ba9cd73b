"""Queries p1 and p7: the general operations on snapshots and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.orphans import corpus_orphans, orphan_report
from corpusmill.operators.snapshot_diff import page_changes
from corpusmill.runtime import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_changes(read(spark, sf_dir, "pages")).select("snapshot_no", "pageid", "change_kind")


def p1_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_changes(read(spark, sf_dir, "pages"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_orphans(*(read(spark, sf_dir, t) for t in ("entity_links", "pages", "adversarial_sample", "manual_labels", "chunks")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("table_name", "ref_period", "ref_key", "reason")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_versions": p1_versions, "p7_found": p7_found, "p7_report": p7_report}

_CHANGES = """
WITH v AS (SELECT CAST(snapshot_no AS BIGINT) s, pageid, revid, TRY_CAST(rev_timestamp AS TIMESTAMPTZ) t FROM pages WHERE pageid IS NOT NULL AND snapshot_no IS NOT NULL),
r AS (SELECT s, pageid, revid, t, row_number() OVER (PARTITION BY s, pageid ORDER BY revid DESC NULLS LAST, t DESC NULLS LAST) k FROM v),
w AS (SELECT s, pageid, revid, t FROM r WHERE k = 1),
n AS (SELECT s, lag(s) OVER (ORDER BY s) b FROM (SELECT DISTINCT s FROM w)),
now AS (SELECT w.*, n.b FROM w JOIN n USING (s) WHERE n.b IS NOT NULL),
was AS (SELECT n.s, w.pageid, w.revid, w.t FROM w JOIN n ON n.b = w.s),
c AS (SELECT coalesce(now.s, was.s) AS snapshot_no, coalesce(now.pageid, was.pageid) AS pageid,
 CASE WHEN was.pageid IS NULL THEN 'added' WHEN now.pageid IS NULL THEN 'removed'
      WHEN now.revid IS DISTINCT FROM was.revid OR now.t <> was.t THEN 'changed' END AS change_kind, was.revid AS old_version, now.revid AS new_version
 FROM now FULL JOIN was ON now.s = was.s AND now.pageid = was.pageid)
"""
_ORPHANS = """
WITH l AS (SELECT snapshot_no, target_page_id k FROM entity_links WHERE target_page_id IS NOT NULL),
p AS (SELECT DISTINCT pageid, snapshot_no FROM pages),
m AS (SELECT pageid, min(snapshot_no) a, max(snapshot_no) z FROM p GROUP BY 1),
o AS (SELECT 'entity_links' AS table_name, CAST(l.snapshot_no AS VARCHAR) AS ref_period, CAST(l.k AS BIGINT)::VARCHAR AS ref_key,
 CASE WHEN m.a < l.snapshot_no THEN 'deleted' WHEN m.z > l.snapshot_no THEN 'late' ELSE 'missing' END AS reason
 FROM l LEFT JOIN p ON p.pageid = l.k AND p.snapshot_no = l.snapshot_no LEFT JOIN m ON m.pageid = l.k WHERE p.pageid IS NULL
 UNION ALL SELECT 'adversarial_sample', substr(drawn_at, 1, 7), chunk_id, 'missing' FROM adversarial_sample WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)
 UNION ALL SELECT 'manual_labels', substr(labeled_at, 1, 7), chunk_id, 'missing' FROM manual_labels WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL))
"""
ORACLE = {
    "p1_found": _CHANGES + "SELECT snapshot_no, pageid, change_kind FROM c WHERE change_kind IS NOT NULL",
    "p1_versions": _CHANGES + "SELECT snapshot_no, pageid, change_kind, old_version, new_version FROM c WHERE change_kind IS NOT NULL",
    "p7_found": _ORPHANS + "SELECT DISTINCT table_name, ref_period, ref_key, reason FROM o",
    "p7_report": _ORPHANS + "SELECT table_name, ref_period, reason, count(DISTINCT ref_key) AS orphan_keys FROM o GROUP BY 1, 2, 3",
}
