"""Queries p3 to p6 and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import author_key, snapshot_key
from tessera.operators.delimited import infer_delimiters, mask_fields, split_fields
from tessera.operators.orphans import apply_deltas, existence_deltas, orphan_keys, orphan_rows
from tessera.operators.skew import balanced_aggregate, dominating_keys, fragment_replicate_join, task_loads
from tessera.operators.snapshot_diff import snapshot_changes
from tessera.sources.tables import table

#: (table, id, field) of the packed fields.
PACKED = (("repositories", "repository_id", "topics"), ("source_files", "file_id", "model_ids"), ("snapshot_checks", "check_id", "models"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t)
        .select(F.lit(t).alias("source_field"), F.col(k).cast("long").alias("record_id"), F.col(f).alias("field_text"))
        .where(F.col("record_id").isNotNull() & F.col("field_text").isNotNull())
        for t, k, f in PACKED
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("source_field", "record_id").agg(F.max("field_text").alias("field_text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return split_fields(_packed(spark, d)).select(F.col("source_field").alias("table_name"), "record_id", "item_pos", "item_value")


def p3_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """The inferred delimiter per source."""
    out = infer_delimiters(mask_fields(_packed(spark, d)))
    return out.select(F.col("source_field").alias("table_name"), "delimiter", F.round("score", 6).alias("score"))


def _per_repository(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "snapshots").select(F.col("repository_id").cast("string").alias("key_value"))
    return balanced_aggregate(rows, "key_value", {"n_rows": None}, scan=True)


def _per_author(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "author_interfaces").select(author_key("model_author").alias("key_value"), "binding_count")
    return balanced_aggregate(rows, "key_value", {"n_rows": None, "binding_count": "binding_count"}, scan=True)


def p4_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows and binding_count per key of both tables (null: no such column)."""
    a = _per_repository(spark, d).select(F.lit("snapshots").alias("table_name"), "key_value", "n_rows", F.lit(None).cast("long").alias("binding_count"))
    b = _per_author(spark, d).select(F.lit("author_interfaces").alias("table_name"), "key_value", "n_rows", "binding_count")
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    a = dominating_keys(_per_repository(spark, d), "key_value", "n_rows").select(F.lit("snapshots").alias("table_name"), "key_value")
    b = dominating_keys(_per_author(spark, d), "key_value", "n_rows").select(F.lit("author_interfaces").alias("table_name"), "key_value")
    return a.unionByName(b)


def p4_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Rows and keys per task of both tables, as placed by estimated load."""
    a = table(spark, d, "snapshots").select(F.col("repository_id").cast("string").alias("key_value"))
    b = table(spark, d, "author_interfaces").select(author_key("model_author").alias("key_value"))
    parts = [task_loads(rows, "key_value", scan=True).withColumn("table_name", F.lit(name)) for name, rows in (("snapshots", a), ("author_interfaces", b))]
    return parts[0].unionByName(parts[1]).select("table_name", "task", "n_rows", "n_keys")


def p4_joined(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots per repository name and line: fragment-replicate join."""
    names = table(spark, d, "repositories").where(F.col("deleted_at").isNull()).groupBy("repository_id").agg(F.max("name").alias("name"))
    snaps = table(spark, d, "snapshots").select("repository_id", "release_line", "snapshot_id")
    return (
        fragment_replicate_join(snaps, names, "repository_id")
        .groupBy("name", "release_line")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("snapshot_id").alias("n_snapshots"))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "files"), table(spark, d, "snapshots"))


def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    """Changes per pair and kind."""
    return p5_found(spark, d).groupBy("old_snapshot_id", "new_snapshot_id", "change_kind").agg(F.count(F.lit(1)).alias("n_paths"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Every reference: relation (the child table), key, child_key, loaded_at."""
    spec = (
        ("snapshots", F.col("snapshot_id"), F.col("repository_id").cast("string")),
        ("releases", F.col("release_id"), snapshot_key("snapshot_id")),
        ("files", F.col("path"), snapshot_key("snapshot_id")),
    )
    parts = [
        table(spark, d, t).select(F.lit(t).alias("relation"), key.alias("key"), child.alias("child_key"), "loaded_at").where(F.col("key").isNotNull())
        for t, child, key in spec
    ]
    return reduce(DataFrame.unionByName, parts)


def _orphan_state(spark: SparkSession, d: str) -> DataFrame:
    references = _references(spark, d)
    repos = table(spark, d, "repositories")
    snaps = table(spark, d, "snapshots")
    # A repository row is an appearance; one that was deleted also a departure.
    born = existence_deltas(repos, "snapshots", F.col("repository_id").cast("string"))
    gone = existence_deltas(repos.where(F.col("deleted_at").isNotNull()), "snapshots", F.col("repository_id").cast("string"), -1)
    there = [existence_deltas(snaps, t, snapshot_key("snapshot_id")) for t in ("releases", "files")]
    refs = references.select("relation", "key", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("lives"))
    return apply_deltas(None, refs, born, gone, *there)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    hit = orphan_rows(_references(spark, d), orphan_keys(_orphan_state(spark, d)))
    return hit.select(F.col("relation").alias("child_table"), "child_key", F.col("key").alias("parent_key")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references and their parents per table and month of loaded_at."""
    hit = orphan_rows(_references(spark, d), orphan_keys(_orphan_state(spark, d)))
    return hit.groupBy(F.col("relation").alias("child_table"), F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("key").alias("n_parents")
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_delimiters, p4_found, p4_per_key, p4_tasks, p4_joined, p5_found, p5_summary, p6_found, p6_report)}
