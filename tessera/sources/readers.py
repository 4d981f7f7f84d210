"""Readers of the study's input files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directories that hold no source of the project.
SKIPPED_DIRS = (".git", ".hg", ".svn", ".mypy_cache", ".pytest_cache", ".ruff_cache", "__pycache__", ".venv", "venv", "env", "envs", "site-packages", "dist-packages")


def read_csv(spark: SparkSession, path: str, columns: list[str], *, missing_ok: bool = False) -> DataFrame:
    """A CSV file with a header, every column text, quoted line breaks kept.

    A byte-order mark is dropped from the first name, ``.gz`` is read as it is.
    A header that differs from ``columns`` is an error; a missing file gives an
    empty table if ``missing_ok``.
    """
    try:
        df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    except Exception as e:
        if missing_ok and "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        raise
    names = [c.lstrip(chr(0xFEFF)) for c in df.columns]
    if names != columns:
        raise ValueError(f"header of {path} is {names}, not {columns}")
    return df.toDF(*names)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, blank ones skipped; lines that do not fit keep ``_corrupt``."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(with_corrupt).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")


def read_sources(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """``path, size_bytes, git_blob_sha, text`` of source files below a folder.

    Text is UTF-8 with replacement; the blob hash is that of version control
    (of ``blob``, the length, a zero byte and the content).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    parts = F.split("path", "/")
    kept = raw.where(~F.exists(parts, lambda p: p.isin(*SKIPPED_DIRS)))
    head = F.concat(F.lit("blob "), F.col("length").cast("string")).cast("binary")
    blob = F.sha1(F.concat(head, F.unhex(F.lit("00")), F.col("content")))
    return kept.select("path", F.col("length").alias("size_bytes"), blob.alias("git_blob_sha"), F.decode(F.col("content"), "UTF-8").alias("text"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, or null in part; no rows mean a true key."""
    some_null = F.exists(F.array(*[F.col(k).isNull() for k in keys]), lambda x: x)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where((F.col("n_rows") > 1) | some_null)


def truthy(c: Column | str) -> Column:
    """``1, true, yes, y`` in any case, else false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "y"), F.lit(False))


def lenient_long(c: Column | str) -> Column:
    """The number that a text holds, cut to an integer; 0 for anything else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c).try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def rule_rows(rules: DataFrame, required: list[str], *, loader: str, arguments: str) -> DataFrame:
    """Rules with ``argument_names``: blank loaders are left out, the rest is trimmed
    and distinct, arguments are split at commas, semicolons, bars and blanks, their
    defaults (``name=value``) dropped.

    Columns that are missing are an error.
    """
    missing = [c for c in required if c not in rules.columns]
    if missing:
        raise ValueError(f"columns that rules lack: {missing}")
    rows = rules.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in required]).where(F.coalesce(F.col(f"`{loader}`"), F.lit("")) != "").distinct()
    names = F.transform(F.split(F.coalesce(F.col(f"`{arguments}`"), F.lit("")), r"[,;|\s]+"), lambda x: F.substring_index(x, "=", 1))
    return rows.withColumn("argument_names", F.array_distinct(F.filter(names, lambda x: x != "")))
