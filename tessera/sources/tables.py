"""Table scans shared by all queries."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet``; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one is set
    only where the session names none (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so
    that lost executors cost no recomputation and loops keep short plans."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows to drop may be broadcast up to this many (24 bytes each).
BROADCAST_ROWS = 1_000_000


def distinct_texts(scan: DataFrame, keys: list[str], text: str, columns: list[str]) -> DataFrame:
    """``columns`` of a table scan, one row for each (``keys``, ``text``).

    Rows are told apart by their place in their file, which stays when a task
    runs again.  Only keys, hashes and places are shuffled; texts stay where they
    are scanned while the rows to drop are few enough to broadcast.
    """
    place = F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    ids = [*keys, "__h", "__n"]
    known = scan.select(*keys, F.xxhash64(text).alias("__h"), F.length(text).alias("__n"), *place)
    twice = known.groupBy(*ids).agg(F.min(F.struct("__file", "__row")).alias("__kept"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ids]
    dropped = known.alias("k").join(twice.alias("t"), reduce(lambda a, b: a & b, same)).where(F.struct("k.__file", "k.__row") != F.col("t.__kept")).select("k.__file", "k.__row")
    dropped = cut_lineage(dropped)
    rows = scan.select(*columns, *place)
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, ["__file", "__row"], "left_anti").drop("__file", "__row")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many parts as the session has cores.

    For work that costs far more than moving the rows (parsing, lexing): one
    file of one row group would otherwise be one task.  Scans that have enough
    parts already are left as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
