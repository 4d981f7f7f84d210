"""Joins on ranges and prefixes, and choices among ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import running_sum


def range_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, *, cell: int) -> DataFrame:
    """Every pair of a point and an interval [start, end] of the same keys that holds it.

    Intervals are registered in every cell of width ``cell`` that they touch and
    met there by equality, so a pair comes up once.  Columns of one name on both
    sides, other than the keys, are refused.
    """
    clash = ({c.lower() for c in points.columns} & {c.lower() for c in intervals.columns}) - {k.lower() for k in keys}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    lo, hi = F.floor(F.col(start) / cell), F.floor(F.col(end) / cell)
    spread = intervals.where(F.col(end) >= F.col(start)).withColumn("__cell", F.explode(F.sequence(lo, hi)))
    met = points.withColumn("__cell", F.floor(F.col(at) / cell)).join(spread, [*keys, "__cell"])
    return met.where(F.col(at).between(F.col(start), F.col(end))).drop("__cell")


def ranked_within(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str, *, tolerance: float, exact_last: bool = False) -> DataFrame:
    """``row_id, rank, value, distance``: all rows of ``right`` of the same keys within
    ``tolerance`` of a left row, nearest first.

    Cells as wide as the tolerance are met by equality.  Ties go to the smaller
    position, then the smaller value; equal (position, value) count once.
    ``exact_last`` puts hits at distance 0 last.  Ranks are running sums over
    range partitions, so a left row may have any number of partners.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    l = left.select("row_id", *keys, F.col(at).alias("__at"), F.explode(F.array(cell(at) - 1, cell(at), cell(at) + 1)).alias("__cell"))
    r = right.select(*keys, F.col(right_at).alias("__to"), F.col(value).alias("value"), cell(right_at).alias("__cell")).distinct()
    d = F.abs(F.col("__at") - F.col("__to"))
    near = l.join(r, [*keys, "__cell"]).where(d <= tolerance)
    late = (d == 0) if exact_last else F.lit(False)
    near = near.select("row_id", late.alias("__late"), d.alias("distance"), F.col("__to"), "value", F.lit(1).cast("long").alias("__one"))
    ranked = running_sum(near, ["row_id"], ["__late", "distance", "__to", "value"], "__one", "rank")
    return ranked.select("row_id", "rank", "value", "distance")


def longest_prefix(names: DataFrame, prefixes: DataFrame, keys: list[str], name: str, prefix: str, value: str, *, mark: str) -> DataFrame:
    """``names`` with ``prefix_found`` and ``value_found``: the longest of the same keys'
    prefixes that a name starts with on a component border.

    Each prefix of a name becomes a row and meets the others by equality; only
    the longest is kept, by a maximum that combines before the shuffle.  Of
    several values of one prefix the least counts.  ``names`` has a unique ``row_id``.
    """
    parts = F.split(F.col(name), f"[{mark}]")
    each = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), mark))
    rows = names.where(F.col(name).isNotNull()).select("row_id", *keys, F.explode(each).alias("__p"))
    known = prefixes.groupBy(*keys, F.col(prefix).alias("__p")).agg(F.min(value).alias("__v"))
    best = rows.join(known, [*keys, "__p"]).groupBy("row_id").agg(F.max(F.struct(F.length("__p").alias("n"), F.col("__p").alias("p"), F.col("__v").alias("v"))).alias("__b"))
    return names.join(best, "row_id", "left").withColumn("prefix_found", F.col("__b.p")).withColumn("value_found", F.col("__b.v")).drop("__b")


def state_rank(state: Column, states: list[str]) -> Column:
    """Place of a state in ``states``; those not listed come after all."""
    at = F.array_position(F.array(*map(F.lit, states)), state)
    return F.when(at > 0, at).otherwise(F.lit(len(states) + 1))


def first_by_state(df: DataFrame, keys: list[str], state: str, states: list[str], order: list[str], value: str) -> DataFrame:
    """``keys, value, state``: per key the value of the best state, then the first by ``order``."""
    rank = F.struct(state_rank(F.col(state), states).alias("r"), *order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v"), F.col(state).alias("s")), rank).alias("b")).select(*keys, F.col("b.v").alias(value), F.col("b.s").alias(state))


def replace_rows(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``fresh``, and the rows of ``rows`` whose keys it does not hold."""
    return rows.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def greedy_units(events: DataFrame, capacity: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``events`` with ``taken``: events of a key take its units one by one in ``order``.

    ``capacity`` has ``keys, units``.  A key without units gives none.
    """
    counted = running_sum(events.withColumn("__one", F.lit(1).cast("long")), keys, order, "__one", "__n").drop("__one")
    room = capacity.groupBy(*keys).agg(F.sum("units").alias("__u"))
    return counted.join(room, keys, "left").withColumn("taken", F.coalesce(F.col("__n") <= F.col("__u"), F.lit(False))).drop("__n", "__u")
