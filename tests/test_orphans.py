"""Orphan references: reasons, dirt and hot keys."""

import random

from pyspark.sql import functions as F

from corpusmill.operators.orphans import orphan_keys, orphan_report, references

REFS, PARENTS = "tag string, label string, period long, key long", "key long, period long"


def run(spark, refs, parents):
    return {tuple(r)[:4] for r in orphan_keys(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()}


def test_reasons(spark):
    parents = [(1, 0), (2, 2), (3, 1), (3, 1), (4, None), (None, 1)]
    refs = [("t", "1", 1, 1), ("t", "1", 1, 2), ("t", "1", 1, 3), ("t", "1", 1, 9), ("t", "1", 1, 9), ("t", "1", 1, None), ("t", "1", 1, 4), ("t", None, None, 2), ("t", None, None, 8)]
    assert run(spark, refs, parents) == {("t", "1", "1", "deleted"), ("t", "1", "2", "late"), ("t", "1", "9", "missing"), ("t", None, "8", "missing")}


def test_brute_force_with_a_hot_key(spark):
    rng = random.Random(2)
    parents = [(rng.randrange(80), rng.randrange(5)) for _ in range(120)]
    refs = [("a", str(p), p, rng.choice([5, 5, rng.randrange(120)])) for p in (rng.randrange(5) for _ in range(600))]
    have = set(parents)
    want = set()
    for t, label, p, k in refs:
        if (k, p) not in have:
            at = [q for key, q in have if key == k]
            want.add((t, label, str(k), "deleted" if any(q < p for q in at) else "late" if any(q > p for q in at) else "missing"))
    assert run(spark, refs, parents) == want


def test_strings_and_empty_tables(spark):
    refs = spark.createDataFrame([("1:a:0", "2026-05-03T00:00:00Z"), (" 1:a:0", "2026-05-03T00:00:00Z"), ("", "2026-06-03T00:00:00Z"), (None, "2026-06-03T00:00:00Z")], "chunk_id string, drawn_at string")
    refs = references(refs, "s", "chunk_id", F.substring("drawn_at", 1, 7))
    parents = spark.createDataFrame([("1:a:0", None)], "key string, period long")
    out = orphan_keys(refs, parents)
    assert {tuple(r)[:4] for r in out.collect()} == {("s", "2026-05", " 1:a:0", "missing"), ("s", "2026-06", "", "missing")}
    assert orphan_report(orphan_keys(refs.limit(0), parents)).count() == 0
    assert orphan_keys(refs, parents.limit(0)).count() == 3


def test_many_parents_are_reduced_before_they_move(spark, monkeypatch):
    """Ranges are sized by what is left of both sides, and that is little for few references."""
    from corpusmill.operators import orphans

    sizes = []
    sized = orphans.partitions_for
    monkeypatch.setattr(orphans, "partitions_for", lambda s, n, task: sizes.append(n) or sized(s, n, task))
    parents = spark.range(300_000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(None).cast("long").alias("period"))
    refs = spark.createDataFrame([("t", "1", None, k) for k in ("k5", "k299999", "gone", "k300000")], "tag string, label string, period long, key string")
    assert {r.ref_key for r in orphan_keys(refs, parents).collect()} == {"gone", "k300000"}
    assert sizes[0] < 100 * orphans.ROW_BYTES


def test_tally_levels_are_upper_bounds(spark):
    from corpusmill.operators.tally import BITS, LEVELS, tally

    df = spark.range(1000).selectExpr("explode(array_repeat(id, cast(id % 50 as int))) AS h")
    t = tally(df)
    import numpy as np

    ids = np.arange(1000)
    held = LEVELS[t.level(ids)]
    assert t.total == sum(i % 50 for i in range(1000)) and (held >= ids % 50).all() and (held[ids % 50 < 20] == ids[ids % 50 < 20] % 50).all()
    assert t.level(np.array([1 << (BITS - 1)]))[0] == 0 and tally(df.limit(0)).total == 0


def test_checkpoints_off_local_mode_need_a_shared_folder(spark, monkeypatch):
    import pytest

    from corpusmill import runtime

    assert runtime.is_local("local") and runtime.is_local("local[4]") and not runtime.is_local("local-cluster[2,1,512]")
    runtime.cut(spark.range(3))
    assert runtime.scratch(spark, "x") != runtime.scratch(spark, "x")

    class NoFolder:
        def isEmpty(self):
            return True

    class Context:
        master = "yarn"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(NoFolder)})

        def getConf(self):
            return {}

    fake = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime._shared_folder(fake)
