"""Snapshot comparison against a brute-force version, and its defined cases."""

import random

from corpusmill.operators.snapshot_diff import page_changes, snapshot_changes

SCHEMA = "snapshot_no int, pageid long, revid long, rev_timestamp string, key string, s string"


def brute(rows):
    best = {}
    for no, page, rev, at, *_ in rows:
        if no is None or page is None:
            continue
        old = best.get((no, page))
        new = (rev is not None, rev or 0, at is not None, at or "")
        if old is None or new > old[0]:
            best[no, page] = (new, rev, at)
    numbers = sorted({no for no, _ in best})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        for page in {p for n, p in best if n in (a, b)}:
            old, new = best.get((a, page)), best.get((b, page))
            if old is None:
                out.add((b, page, "added"))
            elif new is None:
                out.add((b, page, "removed"))
            elif old[1] != new[1] or (old[2] and new[2] and old[2] != new[2]):
                out.add((b, page, "changed"))
    return out


def found(df):
    return {tuple(r) for r in df.select("snapshot_no", "pageid", "change_kind").collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.choice([7, 7, 7, *range(60)]), rng.choice([None, 1, 2, 3]), rng.choice([None, "2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"]), "x", "y") for _ in range(300)]
    rows += rows[:40] + [(None, 1, 1, None, "", ""), (1, None, 1, None, "", "")]
    assert found(page_changes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_one_instant_in_several_notations_is_no_change(spark):
    rows = [(0, 1, 5, "2026-03-31T22:33:30Z", "", ""), (1, 1, 5, "2026-03-31 22:33:30Z", "", ""), (2, 1, 5, "2026-04-01T00:33:30.000+02:00", "", ""), (3, 1, 5, None, "", ""), (4, 1, 5, "not a time", "", "")]
    assert found(page_changes(spark.createDataFrame(rows, SCHEMA))) == set()


def test_empty_and_single_snapshot(spark):
    assert found(page_changes(spark.createDataFrame([], SCHEMA))) == set()
    assert found(page_changes(spark.createDataFrame([(3, 1, 1, None, "", "")], SCHEMA))) == set()


def test_string_keys_and_plain_comparison(spark):
    rows = [(0, 1, 1, "a", "k1", ""), (1, 1, 1, None, "k1", ""), (1, 1, 1, "b", "k2", "")]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "key", "snapshot_no", "revid", ["rev_timestamp"])
    assert {tuple(r)[:3] for r in got.collect()} == {(1, "k1", "changed"), (1, "k2", "added")}
