"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.orphans import apply_deltas
from tessera.sources.tables import checkpoint_folder


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A file stream over ``folder/name.parquet``, a file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/{name}.parquet*")


def windowed_counts(events: DataFrame, *, size: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """Events and value per window and type, with a watermark for late rows."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
        .select(F.col("window.start").alias("start"), "event_type", "n_events", "cents")
    )


def run_to_end(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream over what is there and return its final rows.

    Each batch writes the rows that it changed to the shared folder under its
    number; the last row of a key counts.  Writing a batch again overwrites it,
    so a batch repeated after a failure changes nothing.
    """
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query: StreamingQuery = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r"))
    return last.select(*keys, "r.*")


def read_counts(spark: SparkSession, folder: str, *, upto: int | None = None) -> DataFrame:
    """The counts that ``maintain_counts`` keeps in ``folder``, after batch ``upto`` or the last."""

    def part(name: str, number: str) -> DataFrame | None:
        try:
            rows = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return rows if upto is None else rows.where(F.col(number) <= upto)

    base, deltas = part("base", "compacted"), part("deltas", "batch")
    last = base.agg(F.max("compacted")).first()[0] if base is not None else None
    if last is None:
        return apply_deltas(None, deltas.drop("batch"))
    kept = base.where(F.col("compacted") == last).drop("compacted")
    return apply_deltas(kept, deltas.where(F.col("batch") > last).drop("batch")) if deltas is not None else kept


def maintain_counts(deltas: DataFrame, folder: str, log_folder: str, *, compact_every: int = 16) -> StreamingQuery:
    """Keep the reference and existence counts of ``operators.orphans`` up to date.

    ``deltas`` streams (relation, key, refs, lives).  A batch writes the sums of
    its own deltas under its number, so its cost follows the batch and not the
    state; every ``compact_every`` batches all sums are added up into a new base.
    A batch run twice writes the same rows again.  ``read_counts`` reads the state.
    """
    spark = deltas.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        apply_deltas(None, batch).write.mode("overwrite").parquet(f"{folder}/deltas/batch={number}")
        if (number + 1) % compact_every == 0:
            # Up to the batch before this one and with it; a repeated run gives the same base.
            before = read_counts(spark, folder, upto=number)
            before.write.mode("overwrite").parquet(f"{folder}/base/compacted={number}")

    return deltas.writeStream.foreachBatch(add).option("checkpointLocation", log_folder).trigger(availableNow=True).start()
