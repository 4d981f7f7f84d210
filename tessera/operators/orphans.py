"""References to records that do not exist, kept up from change deltas.

For every (relation, key) two signed counts are kept: how many rows refer to
the key and how many live rows carry it.  A delta adds +1 or -1 to one of them;
states and deltas add up in any order, so a parent that arrives after its child
mends the report by itself.  Keys with a positive reference count and no
existence are the orphans of the moment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.skew import fragment_replicate_join
from tessera.sources.tables import cut_lineage

#: Orphan keys may be broadcast below this many bytes, by their counted size.
BROADCAST_BYTES = 8 << 20


def reference_deltas(child: DataFrame, relation: str, key: Column, sign: int = 1) -> DataFrame:
    """Deltas of rows that refer to ``key``; a null key refers to nothing."""
    return child.select(F.lit(relation).alias("relation"), key.alias("key"), F.lit(sign).cast("long").alias("refs"), F.lit(0).cast("long").alias("lives")).where(
        F.col("key").isNotNull()
    )


def existence_deltas(parent: DataFrame, relation: str, key: Column, lives: Column | int = 1) -> DataFrame:
    """Deltas of rows that carry ``key``: +1 when it appears, -1 when deleted."""
    lives = F.lit(lives) if isinstance(lives, int) else lives
    return parent.select(F.lit(relation).alias("relation"), key.alias("key"), F.lit(0).cast("long").alias("refs"), lives.cast("long").alias("lives")).where(
        F.col("key").isNotNull()
    )


def apply_deltas(state: DataFrame | None, *deltas: DataFrame) -> DataFrame:
    """The counts ``relation, key, refs, lives`` after ``deltas``.

    Sums are combined before the shuffle, so a key with a third of all rows
    costs one row per map task.  Counts that return to zero are dropped.
    """
    rows = reduce(DataFrame.unionByName, [*([state] if state is not None else []), *deltas])
    total = rows.groupBy("relation", "key").agg(F.sum("refs").alias("refs"), F.sum("lives").alias("lives"))
    return total.where((F.col("refs") != 0) | (F.col("lives") != 0))


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with references and no live record: ``relation, key, refs``."""
    return state.where((F.col("refs") > 0) & (F.col("lives") <= 0)).select("relation", "key", "refs")


def orphan_rows(children: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``children(relation, key, ...)`` whose key is an orphan.

    The keys are broadcast when they measure under BROADCAST_BYTES, else the
    join fragments heavy keys, as one missing parent may have a third of all
    children.
    """
    keys = cut_lineage(keys)  # measured, then joined
    size = keys.agg(F.sum(F.length("key") + F.length("relation") + 24)).first()[0] or 0
    hit = keys.select("relation", "key")
    if size <= BROADCAST_BYTES:
        return children.join(F.broadcast(hit), ["relation", "key"], "left_semi")
    both = lambda df: df.withColumn("rk", F.concat_ws(chr(1), "relation", "key"))
    return fragment_replicate_join(both(children), both(hit).select("rk"), "rk", how="left_semi").drop("rk")
