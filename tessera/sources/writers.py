"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean_cells(df: DataFrame) -> DataFrame:
    """Text columns without zero bytes, carriage returns written as ``\\r``."""
    return df.select(
        *[F.regexp_replace(F.regexp_replace(F.col(f"`{c}`"), "\\x00", ""), "\r", r"\\r").alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def write_csv(df: DataFrame, folder: str, *, quote_all: bool = False, exclusive: bool = False, order: list[str] | None = None) -> None:
    """CSV with a header, in as many files as the data has parts.

    ``exclusive`` refuses a folder that exists; ``order`` sorts globally, so the
    files in name order are sorted.  The job's commit makes it all or nothing.
    """
    out = clean_cells(df)
    if order:
        out = out.orderBy(*order)
    out.write.mode("errorifexists" if exclusive else "overwrite").csv(folder, header=True, quoteAll=quote_all, escape='"', emptyValue="")


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts under the union of their columns, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_parts(df: DataFrame, folder: str, by: list[str]) -> None:
    """Parquet in one folder per value of ``by``; only those folders are replaced.

    Rows are spread by ``by`` and a salt over the cluster's parts, so one value
    with most rows is written by several tasks.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(8)))
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        salted.repartition(n, *by, "__salt").drop("__salt").write.mode("overwrite").partitionBy(*by).parquet(folder)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def summary_row(**frames: DataFrame) -> DataFrame:
    """One row of JSON: the number of rows of each frame, by name, sorted."""
    names = sorted(frames)
    counts = [frames[n].agg(F.count(F.lit(1))).scalar().alias(n) for n in names]
    return frames[names[0]].sparkSession.range(1).select(F.to_json(F.struct(*counts)).alias("summary"))


def with_header(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order and types.

    Columns that it lacks are null, others are refused.
    """
    extra = set(df.columns) - set(schema.names)
    if extra:
        raise ValueError(f"columns without a place: {sorted(extra)}")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_run(frames: dict[str, DataFrame], folder: str, *, repository: str, commit: str) -> None:
    """Each frame under its name, in the folder of one repository and commit; other runs' stay."""
    for name, df in frames.items():
        write_parts(df.withColumn("repository", F.lit(repository)).withColumn("commit", F.lit(commit)), f"{folder}/{name}", ["repository", "commit"])


def write_transitions(rows: DataFrame, folder: str) -> None:
    """Distinct (old, new, category) rows as sorted CSV."""
    columns = ["old", "new", "category"]
    write_csv(rows.select(*columns).distinct(), folder, order=columns)
