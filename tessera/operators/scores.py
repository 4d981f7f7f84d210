"""Scores of predictions, and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import running_sum
from tessera.operators.skew import default_tasks


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def confusion(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1; nulls count as false, empty
    denominators give 0."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(predicted, F.lit(False))
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn")
    )
    return (
        counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    )


def any_per(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Per key: whether any row has the flag."""
    return df.groupBy(key).agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def poisson_weight(draw: Column, key: Column) -> Column:
    """How often a cluster is drawn: a Poisson(1) number from a hash of (draw, cluster).

    The usual stand-in for drawing with replacement that needs no order and no
    driver; draws do not depend on where rows lie.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", draw.cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    steps, p, total = [], 0.36787944117144233, 0.0
    for k in range(9):
        total += p
        steps.append(total)
        p /= k + 1
    return F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= u))


def paired_gains(per_cluster: DataFrame, key: str, n: str, first: str, second: str, *, draws: int) -> DataFrame:
    """``draw, gain``: how much the share ``first / n`` exceeds ``second / n`` over
    resampled clusters, both from the same draw.

    One row per cluster comes in; weights are applied and summed per draw before
    the shuffle, so ``draws`` rows leave each task.
    """
    # A handful of rows makes many: they are dealt to all cores first.
    drawn = per_cluster.repartition(default_tasks(per_cluster), key).select(key, n, first, second, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("w", poisson_weight(F.col("draw"), F.col(key)))
    sums = drawn.where("w > 0").groupBy("draw").agg(F.sum(F.col("w") * F.col(n)).alias("n"), F.sum(F.col("w") * (F.col(first) - F.col(second))).alias("d"))
    return sums.select("draw", F.try_divide("d", "n").alias("gain"))


def exact_quantile(df: DataFrame, by: str, value: str, q: float) -> DataFrame:
    """``by, quantile``: the value at share ``q``, interpolated between neighbours.

    Equal values are counted first; ranks come from running sums over range
    partitions, so a group with a third of all rows lies in many tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = running_sum(counted, [by], ["v"], "c", "upto")
    total = counted.groupBy(by).agg(F.sum("c").alias("n")).select(F.col(by).alias("__by"), ((F.col("n") - 1) * F.lit(q)).alias("at"))
    both = ranked.join(total, F.col(by).eqNullSafe(F.col("__by")))
    holds = lambda p: (F.col("upto") - F.col("c") <= p) & (p < F.col("upto"))
    ends = both.groupBy(by).agg(F.max(F.when(holds(F.floor("at")), F.col("v"))).alias("lo"), F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("hi"), F.first("at").alias("at"))
    return ends.select(by, (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("quantile"))


def runtime_summary(df: DataFrame, by: str, seconds: str) -> DataFrame:
    """Rows, least, median and greatest seconds per group, and the sum as h:mm:ss."""
    total = F.floor(F.sum(seconds)).cast("long")
    rest = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.min(seconds), 6).alias("least"),
        F.round(F.max(seconds), 6).alias("greatest"),
        F.format_string("%d:%02d:%02d", F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60).alias("total"),
    )
    middle = exact_quantile(df, by, seconds, 0.5).select(F.col(by).alias("__by"), F.round("quantile", 6).alias("median"))
    return rest.join(middle, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")
