"""One-to-one matching in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.tables import cut_lineage


def staged_matches(old: DataFrame, new: DataFrame, pair: str, item: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """``pair, old_item, new_item, stage`` by keys of falling strength.

    In each stage a key matches if it has exactly one remaining old and one
    remaining new item within the pair; matched items leave before the next
    stage.  Null keys match nothing.  ``(pair, item)`` is unique on each side.
    Counts are combined before the shuffle, so a key that a third of all items
    share costs one row per task; each stage is written to the checkpoint
    folder, so plans stay short.
    """
    names = [n for n, _ in stages]
    rows = lambda df, side: df.select(F.col(pair), F.col(item), F.lit(side).alias("side"), *[k.cast("string").alias(n) for n, k in stages])
    rest = rows(old, "old").unionByName(rows(new, "new"))
    out: list[DataFrame] = []
    for name in names:
        one = (
            rest.where(F.col(name).isNotNull())
            .groupBy(pair, name)
            .agg(
                F.count_if(F.col("side") == "old").alias("n_old"),
                F.count_if(F.col("side") == "new").alias("n_new"),
                F.min(F.when(F.col("side") == "old", F.col(item))).alias("old_item"),
                F.min(F.when(F.col("side") == "new", F.col(item))).alias("new_item"),
            )
            .where((F.col("n_old") == 1) & (F.col("n_new") == 1))
            .select(pair, "old_item", "new_item", F.lit(name).alias("stage"))
        )
        one = cut_lineage(one)
        out.append(one)
        if name != names[-1]:
            used = one.select(pair, F.col("old_item").alias(item), F.lit("old").alias("side")).unionByName(one.select(pair, F.col("new_item").alias(item), F.lit("new").alias("side")))
            rest = rest.join(used, [pair, item, "side"], "left_anti")
    matched = out[0]
    for one in out[1:]:
        matched = matched.unionByName(one)
    return matched


def unmatched(old: DataFrame, new: DataFrame, matches: DataFrame, pair: str, item: str) -> DataFrame:
    """``pair, side, item`` of items in no match."""
    o = old.select(pair, item).join(matches.select(pair, F.col("old_item").alias(item)), [pair, item], "left_anti").withColumn("side", F.lit("old"))
    n = new.select(pair, item).join(matches.select(pair, F.col("new_item").alias(item)), [pair, item], "left_anti").withColumn("side", F.lit("new"))
    return o.unionByName(n)


def conservation(old: DataFrame, new: DataFrame, matches: DataFrame, rest: DataFrame, pair: str, item: str) -> DataFrame:
    """Violations: items that matches and rest do not hold exactly once."""
    want = old.select(pair, item).withColumn("side", F.lit("old")).unionByName(new.select(pair, item).withColumn("side", F.lit("new")))
    have = (
        matches.select(pair, F.col("old_item").alias(item), F.lit("old").alias("side"))
        .unionByName(matches.select(pair, F.col("new_item").alias(item), F.lit("new").alias("side")))
        .unionByName(rest.select(pair, item, "side"))
    )
    return want.exceptAll(have).withColumn("what", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("what", F.lit("extra")))


def turnover_groups(rest: DataFrame, pair: str, key: Column) -> DataFrame:
    """``pair, key, n_old, n_new``: keys left over on both sides of a pair.

    ``rest`` is the result of ``unmatched``.  Such items were neither added nor
    removed for certain; null keys form no group.
    """
    keyed = rest.select(F.col(pair), key.alias("key"), "side").where(F.col("key").isNotNull())
    counts = keyed.groupBy(pair, "key").agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new"))
    return counts.where((F.col("n_old") > 0) & (F.col("n_new") > 0))
