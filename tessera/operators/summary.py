"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` rounded to six places; null where the whole is zero."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def group_summary(df: DataFrame, keys: list[str], *, entity: str, flag: Column) -> DataFrame:
    """Per key: rows, share of all rows, distinct entities and their share, rows
    with the flag and their share.

    Totals are scalar subqueries over the same rows; everything is combined
    before the shuffle.  Null keys are a group, null entities are not counted,
    a null flag is false.  No rows give no groups.
    """
    totals = df.agg(F.count(F.lit(1)).alias("rows")), df.agg(F.countDistinct(entity).alias("entities"))
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("n_entities"), F.count_if(flag).alias("n_flagged"))
        .withColumn("row_share", share(F.col("n_rows"), totals[0].scalar()))
        .withColumn("entity_share", share(F.col("n_entities"), totals[1].scalar()))
        .withColumn("flagged_share", share(F.col("n_flagged"), F.col("n_rows")))
    )


def share_within(df: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """Rows per (parent, child) and their share of the parent's rows.

    The parent total comes from the counts, not from the rows, so a window sees
    one row per child.
    """

    counts = df.groupBy(*parent, *child).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("share", share(F.col("n_rows"), F.sum("n_rows").over(Window.partitionBy(*parent))))


def joined_sets(df: DataFrame, key: str, sets: dict[str, str], sep: str = " | ") -> DataFrame:
    """Per key: sorted distinct values of columns joined by ``sep``; nulls left out.

    Distinct values are found before they are collected, so a hot key brings
    each value once.
    """
    out = None
    for name, column in sets.items():
        one = df.select(key, column).distinct().groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(column)), sep).alias(name))
        out = one if out is None else out.join(one, key)
    return out


def labelled_counts(df: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Rows per label, labels may overlap; labels without rows count zero."""
    counts = df.agg(*[F.count_if(c).alias(k) for k, c in labels.items()])
    return counts.select(F.explode(F.create_map(*[x for k in labels for x in (F.lit(k), F.col(k))])).alias("label", "n_rows"))


def spine_counts(df: DataFrame, row: str, rows: list[str], column: str, columns: list[str]) -> DataFrame:
    """Counts of ``rows`` x ``columns`` with zeroes for missing combinations."""
    spark = df.sparkSession
    counted = df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(c) for c in columns])
    spine = spark.createDataFrame([(r,) for r in rows], f"{row} string")
    return spine.join(counted, row, "left").select(row, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns])


def frequencies(df: DataFrame, case: str, code: str, *, least_share: float = 0.1, other: str = "Other") -> DataFrame:
    """Cases per code; codes of under ``least_share`` of all cases become ``other``.

    A case may have several codes.  The merged code counts its cases anew, not
    as a sum, as one case may have several rare codes.
    """
    rows = df.select(case, code).where(F.col(case).isNotNull() & F.col(code).isNotNull()).distinct()
    total = rows.agg(F.countDistinct(case)).scalar()
    rare = rows.groupBy(code).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") < F.lit(least_share) * total).select(code, F.lit(True).alias("__rare"))
    merged = rows.join(rare, code, "left").select(case, F.when(F.col("__rare"), F.lit(other)).otherwise(F.col(code)).alias(code))
    return merged.groupBy(code).agg(F.countDistinct(case).alias("n_cases")).withColumn("share", share(F.col("n_cases"), total))
