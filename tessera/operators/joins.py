"""Joins that equality alone does not express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import suffixes
from tessera.operators.sequence import carry_forward


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, *, tolerance: float) -> DataFrame:
    """``left`` with ``near_value`` and ``near_distance``: the row of ``right`` of
    the same keys whose ``right_at`` is nearest to ``at`` within ``tolerance``.

    Positions are cut into cells as wide as the tolerance; each left row meets
    its own and the two neighbouring cells only, so the join is on equality and
    no key's rows meet all at once.  Ties go to the smaller position, then the
    smaller value.  Left rows without a partner keep nulls; an exact hit has
    distance 0.  ``left`` needs a unique ``row_id``.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    l = left.select("row_id", *keys, F.col(at).alias("__at"), F.explode(F.array(cell(at) - 1, cell(at), cell(at) + 1)).alias("__cell"))
    r = right.select(*keys, F.col(right_at).alias("__to"), F.col(value).alias("__value"), cell(right_at).alias("__cell"))
    distance = F.abs(F.col("__at") - F.col("__to"))
    best = (
        l.join(r, [*keys, "__cell"])
        .where(distance <= tolerance)
        .groupBy("row_id")
        .agg(F.min(F.struct(distance.alias("d"), F.col("__to").alias("to"), F.col("__value").alias("v"))).alias("__b"))
    )
    return left.join(best, "row_id", "left").withColumn("near_value", F.col("__b.v")).withColumn("near_distance", F.col("__b.d")).drop("__b")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, *, order: str) -> DataFrame:
    """``left`` with ``before_value``: ``value`` of the latest row of ``right`` of
    the same keys at or before ``at``.

    Both sides are merged and the last value is carried forward over range
    partitions, so no pair is built and a key with a third of all rows lies in
    many tasks.  Of right rows at one time the greatest value counts.
    Left rows keep their columns; ``order`` is a unique column of ``left``.
    """
    r = right.groupBy(*keys, F.col(right_at).alias("__t")).agg(F.max(value).alias("__v"))
    both = left.withColumn("__t", F.col(at)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))
    both = both.unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    carried = carry_forward(both, keys, ["__t", "__side", order], "__v", "before_value")
    return carried.where(F.col("__side") == 1).drop("__t", "__v", "__side")


def innermost_interval(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, name: str, *, cell: int) -> DataFrame:
    """``points`` with ``inside``: the narrowest interval [start, end] that holds
    ``at``; ties go to the smaller name.

    Intervals are registered in every cell of width ``cell`` that they touch and
    met there by equality.  ``points`` needs a unique ``row_id``.
    """
    lo, hi = F.floor(F.col(start) / cell), F.floor(F.col(end) / cell)
    spread = intervals.where(F.col(end) >= F.col(start)).select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(name).alias("__n"), F.explode(F.sequence(lo, hi)).alias("__cell"))
    met = (
        points.select("row_id", *keys, F.col(at).alias("__at"), F.floor(F.col(at) / cell).alias("__cell"))
        .join(spread, [*keys, "__cell"])
        .where(F.col("__at").between(F.col("__s"), F.col("__e")))
        .groupBy("row_id")
        .agg(F.min(F.struct((F.col("__e") - F.col("__s")).alias("w"), F.col("__n").alias("n"))).alias("__b"))
    )
    return points.join(met, "row_id", "left").withColumn("inside", F.col("__b.n")).drop("__b")


def suffix_join(chains: DataFrame, rules: DataFrame, chain: str, suffix: str) -> DataFrame:
    """Chains with the rules that they end with on a component border.

    Every suffix of a chain becomes a row and meets the rules by equality, in
    place of a comparison of all chains with all rules.  A chain without a rule
    falls back to rules whose last component is its own; ``by`` says which.
    Chains without either are left out.
    """
    one = chains.select(chain).where(F.col(chain).isNotNull()).distinct()
    keyed = rules.select(F.col(suffix).alias("__rule")).distinct()
    direct = one.select(chain, F.explode(suffixes(F.col(chain))).alias("__rule")).join(keyed, "__rule").select(chain, F.col("__rule").alias("rule"), F.lit("suffix").alias("by"))
    last = lambda c: F.element_at(F.split(F.col(c), "[.]"), -1)
    rest = one.join(direct.select(chain).distinct(), chain, "left_anti").withColumn("__last", last(chain))
    fallback = rest.join(keyed.withColumn("__last", last("__rule")), "__last").select(chain, F.col("__rule").alias("rule"), F.lit("terminal").alias("by"))
    return direct.unionByName(fallback)


def suffix_counts(chains: DataFrame, rules: DataFrame, chain: str, suffix: str) -> DataFrame:
    """``rule, by, n_chains``: how many chains ``suffix_join`` gives each rule.

    Chains that fall back are counted per last component before they meet the
    rules, so no pair of a chain and a rule of one component is built.
    """
    one = chains.select(chain).where(F.col(chain).isNotNull()).distinct()
    keyed = rules.select(F.col(suffix).alias("rule")).distinct()
    direct = one.select(chain, F.explode(suffixes(F.col(chain))).alias("rule")).join(keyed, "rule")
    last = lambda c: F.element_at(F.split(F.col(c), "[.]"), -1)
    rest = one.join(direct.select(chain).distinct(), chain, "left_anti").groupBy(last(chain).alias("__last")).agg(F.count(F.lit(1)).alias("n_chains"))
    fallback = rest.join(keyed.withColumn("__last", last("rule")), "__last").select("rule", F.lit("terminal").alias("by"), "n_chains")
    return direct.groupBy("rule", F.lit("suffix").alias("by")).agg(F.count(F.lit(1)).alias("n_chains")).unionByName(fallback)


def unique_suffixes(names: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys, alias, name``: suffixes that belong to exactly one name of their keys."""
    spread = names.select(*keys, name).distinct().select(*keys, name, F.explode(suffixes(F.col(name))).alias("alias"))
    owned = spread.groupBy(*keys, "alias").agg(F.count(F.lit(1)).alias("__n"), F.min(name).alias(name))
    return owned.where(F.col("__n") == 1).drop("__n")


def presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two key sets with ``in_left`` and ``in_right``."""
    l = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_left", F.lit(True))
    r = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("in_right", F.lit(True))
    out = l.join(r, key, "full_outer")
    return out.select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def set_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side``; no rows mean equal sets."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def quoted_tokens(text: Column) -> Column:
    """Contents of all single- and double-quoted spans on one line; a quote may
    close one span and open the next, as unpaired ones (apostrophes) do."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"""(?=("[^"'\n]+"|'[^"'\n]+'))"""), F.lit(1)), lambda s: F.substring(s, F.lit(2), F.length(s) - 2))
