"""Windows over sequences without one task per sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import cut_lineage


def next_in_sequence(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, *, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: ``value`` of the next row by ``order`` within ``keys``.

    Rows are range-partitioned by keys and order, so that a key with a third of
    all rows lies in many partitions; the window runs within (partition, key),
    and the first row of each later piece of a key is handed to the last row of
    the piece before.  Those pieces number at most partitions plus keys.  Null
    keys form a sequence of their own; the last row of a sequence gets null.
    """
    n = partitions or max(4, df.sparkSession.sparkContext.defaultParallelism)
    # Written once: sampled range borders may differ from one evaluation to the next.
    ranged = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part", *keys).orderBy(*order)
    inside = ranged.withColumn("__next", F.lead(F.struct(F.col(value).alias("v"))).over(w))
    first = ranged.groupBy("__part", *keys).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__first"))
    # At most one row per range partition within a key.
    after = first.withColumn("__after", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__part"))).drop("__first")
    same = [F.col(f"i.{k}").eqNullSafe(F.col(f"a.{k}")) for k in ["__part", *keys]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return inside.alias("i").join(after.alias("a"), cond, "left").select(
        *[F.col(f"i.{c}") for c in df.columns], F.coalesce(F.col("i.__next"), F.col("a.__after"))["v"].alias(out)
    )


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, *, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the last value that is not null up to and with a row.

    Partitioned by range like ``next_in_sequence``: the window runs within
    (partition, key), and each piece of a key gets what the pieces before it
    carried.  ``order`` should be unique within a key.
    """
    n = partitions or max(4, df.sparkSession.sparkContext.defaultParallelism)
    # Written once: sampled range borders may differ from one evaluation to the next.
    ranged = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = ranged.withColumn("__in", F.last(value, ignorenulls=True).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    pieces = ranged.groupBy("__part", *keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__v"))
    # Pieces number at most partitions plus keys.
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = pieces.withColumn("__before", F.last("__v", ignorenulls=True).over(before)).drop("__v")
    cond = F.col("i.__part") == F.col("s.__part")
    for k in keys:
        cond = cond & F.col(f"i.{k}").eqNullSafe(F.col(f"s.{k}"))
    return inside.alias("i").join(spans.alias("s"), cond, "left").select(*[F.col(f"i.{c}") for c in df.columns], F.coalesce("i.__in", "s.__before").alias(out))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, *, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows before and with a row.

    Partitioned by range like ``next_in_sequence``: sums run within (partition,
    key), and each piece of a key starts from the total of the pieces before it.
    ``order`` should be unique within a key; null values add nothing.  Without
    keys the whole table is one sequence.
    """
    n = partitions or max(4, df.sparkSession.sparkContext.defaultParallelism)
    # Written once: sampled range borders may differ from one evaluation to the next.
    ranged = cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))
    inside = ranged.withColumn("__in", F.sum(value).over(Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = ranged.groupBy("__part", *keys).agg(F.sum(value).alias("__t"))
    # Pieces number at most partitions plus keys.
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.withColumn("__before", F.sum("__t").over(before)).drop("__t")
    cond = F.col("i.__part") == F.col("s.__part")
    for k in keys:
        cond = cond & F.col(f"i.{k}").eqNullSafe(F.col(f"s.{k}"))
    return inside.alias("i").join(spans.alias("s"), cond, "left").select(*[F.col(f"i.{c}") for c in df.columns], (F.coalesce("i.__in", F.lit(0)) + F.coalesce("s.__before", F.lit(0))).alias(out))


def with_ordinal(df: DataFrame, order: list[str], out: str, pattern: str) -> DataFrame:
    """``df`` with ids made by ``pattern`` (``item_%05d``) from 1 in ``order``, which should be unique."""
    counted = running_sum(df.withColumn("__one", F.lit(1).cast("long")), [], order, "__one", "__n")
    return counted.drop("__one").withColumn(out, F.format_string(pattern, "__n")).drop("__n")
