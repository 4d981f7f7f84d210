"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import canonical_path, snapshot_key, stripped
from tessera.operators.sequence import next_in_sequence
from tessera.operators.skew import fragment_replicate_join
from tessera.sources.tables import cut_lineage

#: Snapshot roles may be broadcast below this many bytes, by their counted rows.
BROADCAST_BYTES = 32 << 20
_ROLE_BYTES = 192


def file_rows(files: DataFrame) -> DataFrame:
    """``sid, path, row``: canonical keys and a comparable row per file row.

    ``row`` is (loaded_at, content, blob) with 64-bit hashes of the content and
    the blob hash, each trimmed and in lower case first; both are kept, as a
    null content on either side of a comparison makes the blob decide.  Rows
    with a null snapshot_id or path are in no snapshot and are left out.
    """

    def short(name: str):
        text = F.lower(stripped(name))
        return F.when(text != "", F.xxhash64(text))

    return files.where(F.col("snapshot_id").isNotNull() & F.col("path").isNotNull()).select(
        snapshot_key("snapshot_id").alias("sid"),
        canonical_path("path").alias("path"),
        F.struct(F.col("loaded_at").alias("at"), short("content_sha256").alias("content"), short("git_blob_sha").alias("blob")).alias("row"),
    )


def consecutive_snapshots(snapshots: DataFrame, present: DataFrame) -> DataFrame:
    """``pair, old_sid, new_sid, old_snapshot_id, new_snapshot_id`` of neighbours.

    A snapshot counts if it has a repository_id and a row in ``present(sid)``.
    One delivered twice counts once, with its latest loaded row.  Neighbours of
    one (repository, line) are ordered by captured_at, then by id.  ``pair`` is
    a number; the result is written to the checkpoint folder, so it stays.
    """
    rows = snapshots.where(F.col("repository_id").isNotNull() & F.col("snapshot_id").isNotNull())
    one = rows.groupBy(snapshot_key("snapshot_id").alias("sid")).agg(
        F.max(F.struct("loaded_at", "captured_at", "repository_id", "release_line", "snapshot_id")).alias("row")
    )
    one = one.select("sid", "row.captured_at", "row.repository_id", "row.release_line", "row.snapshot_id")
    one = one.join(present, "sid", "left_semi").withColumn("ids", F.struct("sid", "snapshot_id"))
    after = next_in_sequence(one, ["repository_id", "release_line"], ["captured_at", "sid"], "ids", "after")
    pairs = after.where(F.col("after").isNotNull()).select(
        F.monotonically_increasing_id().alias("pair"),
        F.col("sid").alias("old_sid"),
        F.col("after.sid").alias("new_sid"),
        F.col("snapshot_id").alias("old_snapshot_id"),
        F.col("after.snapshot_id").alias("new_snapshot_id"),
    )
    return cut_lineage(pairs)


def _with_role(rows: DataFrame, roles: DataFrame, n_roles: int) -> DataFrame:
    if n_roles * _ROLE_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(roles), "sid")
    # One snapshot may hold a third of all files.
    return fragment_replicate_join(rows, roles, "sid")


def snapshot_changes(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``old_snapshot_id, new_snapshot_id, path, change_kind`` of every change.

    Full outer join of the old and the new side of each pair on (pair, path):
    a missing side makes ``added`` or ``removed``, unequal hashes ``changed``.
    Of several rows of one file the latest loaded counts; at the same time the
    one with the greatest hashes, null times come before all others.  Both
    hashes null on both sides is no change.  The sides are reduced to one row
    per file under the join's own partitioning, so a file row is shuffled once
    per side; the key holds the path, so a snapshot with a tenth of all rows is
    spread over all tasks.  Empty tables and lone snapshots give no rows.
    """
    # Snapshots with any file; combined before the shuffle.
    present = files.where(F.col("path").isNotNull() & F.col("snapshot_id").isNotNull()).select(snapshot_key("snapshot_id").alias("sid")).distinct()
    pairs = consecutive_snapshots(snapshots, present)
    n_pairs = pairs.count()
    rows = file_rows(files)

    def side(name: str) -> DataFrame:
        roles = pairs.select(F.col(f"{name}_sid").alias("sid"), "pair")
        return _with_role(rows, roles, n_pairs).groupBy("pair", "path").agg(F.max("row").alias(name))

    both = side("old").join(side("new"), ["pair", "path"], "full_outer")
    by_blob = F.col("old.content").isNull() | F.col("new.content").isNull()
    differs = F.when(by_blob, ~F.col("old.blob").eqNullSafe(F.col("new.blob"))).otherwise(F.col("old.content") != F.col("new.content"))
    kind = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("removed")).when(differs, F.lit("changed"))
    changes = both.select("pair", "path", kind.alias("change_kind")).where(F.col("change_kind").isNotNull())
    return changes.join(pairs.select("pair", "old_snapshot_id", "new_snapshot_id"), "pair").select(
        "old_snapshot_id", "new_snapshot_id", "path", "change_kind"
    )
