import datetime as dt

from tessera.operators import snapshot_diff
from tessera.operators.orphans import apply_deltas, existence_deltas, orphan_keys, orphan_rows, reference_deltas
from tessera.operators.snapshot_diff import snapshot_changes
from pyspark.sql import functions as F

FILES = "snapshot_id string, path string, git_blob_sha string, content_sha256 string, loaded_at timestamp, pair long"
SNAPS = "snapshot_id string, repository_id long, release_line long, captured_at timestamp, loaded_at timestamp, path string"
T = lambda n: dt.datetime(2024, 1, n)


def _tables(spark):
    snaps = [("s1", 1, 1, T(1), T(1), "x"), ("s2", 1, 1, T(2), T(2), "x"), ("s2", 1, 1, T(2), T(9), "x"), ("s3", 1, 1, T(3), T(3), "x"), ("s4", None, 1, T(4), T(4), "x"), ("t1", 1, 2, T(1), T(1), "x"), ("e", 1, 1, T(2), T(2), "x")]
    files = [
        (" S1 ", "./a//b.py", "x", "H1", T(1), 1), ("s1", "c", "b1", None, T(1), 1), ("s1", "d", "b", "h", T(1), 1), ("s1", "d", "b", "old", T(1), 1),
        ("s2", "a\\b.py", "y", "h1", T(2), 1), ("s2", "c", "b2", "zz", T(2), 1), ("s2", "n", None, None, T(2), 1), ("s2", "n", None, None, T(2), 1),
        ("s3", "n", None, None, T(3), 1), ("s3", "c", "B2", None, T(3), 1), ("s3", "a/b.py", "q", "old", T(1), 1), ("s3", "a/b.py", "q", "h2", T(3), 1),
        (None, "z", "b", "h", T(1), 1), ("s3", None, "b", "h", T(1), 1), ("t1", "a", "b", "h", T(1), 1), ("ghost", "a", "b", "h", T(1), 1),
    ]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(snaps, SNAPS)


WANT = [("s1", "s2", "c", "changed"), ("s1", "s2", "d", "removed"), ("s1", "s2", "n", "added"), ("s2", "s3", "a/b.py", "changed")]


def test_changes(spark, rows):
    files, snaps = _tables(spark)
    assert rows(snapshot_changes(files, snaps)) == WANT


def test_changes_without_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(snapshot_diff, "BROADCAST_BYTES", 0)
    files, snaps = _tables(spark)
    assert rows(snapshot_changes(files, snaps)) == WANT


def test_changes_of_empty_tables(spark, rows):
    files, snaps = _tables(spark)
    assert rows(snapshot_changes(files.limit(0), snaps)) == [] == rows(snapshot_changes(files, snaps.limit(0)))


def test_orphans_mend_when_the_parent_arrives(spark, rows):
    children = spark.createDataFrame([("c1", "p1"), ("c2", "p1"), ("c3", "p2"), ("c4", None), ("c1", "p1")], "child string, parent string")
    parents = spark.createDataFrame([("p2", None), ("p3", None)], "id string, x string")
    state = apply_deltas(None, reference_deltas(children, "r", F.col("parent")), existence_deltas(parents, "r", F.col("id")))
    assert rows(orphan_keys(state)) == [("r", "p1", 3)]
    hit = orphan_rows(children.select(F.lit("r").alias("relation"), F.col("parent").alias("key"), "child"), orphan_keys(state))
    assert rows(hit.select("child").distinct()) == [("c1",), ("c2",)]
    late = existence_deltas(spark.createDataFrame([("p1",)], "id string"), "r", F.col("id"))
    gone = existence_deltas(spark.createDataFrame([("p2",)], "id string"), "r", F.col("id"), -1)
    assert rows(orphan_keys(apply_deltas(state, late, gone))) == [("r", "p2", 1)]
    assert rows(orphan_keys(apply_deltas(state.limit(0)))) == []


def test_orphan_rows_without_broadcast(spark, rows, monkeypatch):
    from tessera.operators import orphans

    monkeypatch.setattr(orphans, "BROADCAST_BYTES", -1)
    children = spark.createDataFrame([("r", "k" if i % 2 else "ok", i) for i in range(50)], "relation string, key string, child long")
    keys = spark.createDataFrame([("r", "k", 25)], "relation string, key string, refs long")
    assert len(rows(orphan_rows(children, keys))) == 25
