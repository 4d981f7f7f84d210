"""Per-key work without a few tasks doing most of it.

Fragment and replicate by estimated load: a bounded sample of the keys gives
estimated loads, light keys fall into a fixed number of hash bins, bins are
packed into tasks by load, a heavy key is cut into shards in proportion to its
load, and the shards are packed like bins.  Every row then goes to the task of
its bin or shard; in a join the matching side of a heavy key goes to the tasks
that hold its shards and to no other.  The sample decides where rows go, never
which rows count.

What reaches the driver is bounded by parameters: ``BINS_PER_TASK * tasks`` bin
loads and at most ``HEAVY_PARTS * tasks`` heavy keys, as each of them holds more
than ``1 / (HEAVY_PARTS * tasks)`` of the sample.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS_PER_TASK = 16
HEAVY_PARTS = 4
#: Rows per task from which loads are estimated; all rows of smaller tables.
SAMPLE_PER_TASK = 1024


@dataclass(frozen=True)
class LoadPlan:
    """Where keys go: tasks of each light bin, and of each heavy key's shards."""

    tasks: int
    bin_tasks: list[int]
    heavy: DataFrame  # heavy_key, shard_tasks array<int>; at most HEAVY_PARTS * tasks rows
    loads: list[int]  # sampled rows per task


def _bin(key: Column, bins: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bins)).cast("int")


def plan_loads(df: DataFrame, key: str, tasks: int) -> LoadPlan:
    """Estimate the keys' loads from a sample and pack them.

    Null keys are packed like any other key.  An empty table gives a plan with
    no heavy key.
    """
    bins = BINS_PER_TASK * tasks
    spark = df.sparkSession
    n, wanted = df.count(), SAMPLE_PER_TASK * tasks
    sample = df.select(F.col(key).alias("heavy_key"))
    if n > 2 * wanted:
        sample, n = sample.sample(wanted / n, seed=42), wanted
    limit = max(1, n // (HEAVY_PARTS * tasks))
    heavy_load = F.col("load") > limit
    per_key = sample.groupBy("heavy_key").agg(F.count(F.lit(1)).alias("load")).select(
        _bin(F.col("heavy_key"), bins).alias("b"), heavy_load.alias("heavy"), F.when(heavy_load, F.col("heavy_key")).alias("heavy_key"), "load"
    )
    loads_of = per_key.groupBy("b", "heavy", "heavy_key").agg(F.sum("load").alias("load")).collect()
    in_bin = {r["b"]: r["load"] for r in loads_of if not r["heavy"]}
    heavy = [r for r in loads_of if r["heavy"]]
    loads = [0] * tasks
    heap = [(0, t) for t in range(tasks)]
    items: list[tuple[int, str, object]] = [(n, "bin", b) for b, n in in_bin.items()]
    for i, r in enumerate(heavy):
        shards = -(-r["load"] // limit)
        items += [(-(-r["load"] // shards), "key", i)] * shards
    bin_tasks, shard_tasks = [b % tasks for b in range(bins)], [[] for _ in heavy]
    for load, kind, name in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        taken, t = heapq.heappop(heap)
        heapq.heappush(heap, (taken + load, t))
        loads[t] = taken + load
        if kind == "bin":
            bin_tasks[name] = t
        else:
            shard_tasks[name].append(t)
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField("heavy_key", key_type), T.StructField("shard_tasks", T.ArrayType(T.IntegerType()))])
    table = spark.createDataFrame([(r["heavy_key"], shard_tasks[i]) for i, r in enumerate(heavy)], schema)
    return LoadPlan(tasks, bin_tasks, table, loads)


def _placed(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """``df`` with ``shard_tasks`` of a heavy key, else null, and ``light_task``."""
    taken = {c.lower() for c in df.columns} & {"heavy_key", "shard_tasks", "light_task"}
    if taken:
        raise ValueError(f"columns of reserved names: {sorted(taken)}")
    bins = F.array(*[F.lit(t) for t in plan.bin_tasks])
    # The heavy table has at most HEAVY_PARTS * tasks rows.
    return (
        df.join(F.broadcast(plan.heavy), F.col(key).eqNullSafe(F.col("heavy_key")), "left")
        .withColumn("light_task", F.element_at(bins, _bin(F.col(key), len(plan.bin_tasks)) + 1))
        .drop("heavy_key")
    )


def fragment(df: DataFrame, key: str, plan: LoadPlan, *, deal: Column | None = None) -> DataFrame:
    """``df`` with ``task``: rows of a heavy key are dealt to its shards.

    They are dealt by a hash of the whole row, or of ``deal``, so that a task
    that runs again deals its rows as before.
    """
    dealt = deal if deal is not None else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != key] or [F.lit(0)])
    turn = F.pmod(F.xxhash64(dealt, F.lit(7919)), F.size("shard_tasks")).cast("int")
    task = F.when(F.col("shard_tasks").isNotNull(), F.element_at("shard_tasks", turn + 1)).otherwise(F.col("light_task"))
    return _placed(df, key, plan).withColumn("task", task).drop("shard_tasks", "light_task")


def replicate(df: DataFrame, key: str, plan: LoadPlan) -> DataFrame:
    """``df`` with ``task``: one copy for each task that holds a shard of its key."""
    to = F.when(F.col("shard_tasks").isNotNull(), F.array_distinct("shard_tasks")).otherwise(F.array("light_task"))
    return _placed(df, key, plan).withColumn("task", F.explode(to)).drop("shard_tasks", "light_task")


def default_tasks(df: DataFrame) -> int:
    """Three tasks per core that the session has, at least 12."""
    return max(12, 3 * df.sparkSession.sparkContext.defaultParallelism)


def placed_rows(df: DataFrame, key: str, *, tasks: int | None = None, scan: bool = False) -> DataFrame:
    """``df`` with ``task``, each row in the partition of that number.

    ``scan`` says that ``df`` is a table scan: its rows have fixed places, by
    which they are dealt, so that even copies of one row go to many shards.
    """
    n = tasks or default_tasks(df)
    plan = plan_loads(df.select(f"`{key}`"), key, n)
    deal = F.monotonically_increasing_id() if scan else None
    return fragment(df, key, plan, deal=deal).repartitionById(n, F.col("task"))


def balanced_aggregate(df: DataFrame, key: str, sums: dict[str, str | None], *, tasks: int | None = None, scan: bool = False) -> DataFrame:
    """Per-key sums without imbalance: ``key`` and one long column per entry.

    ``sums`` names result column -> summed column, or None to count rows.  Rows
    go to the task that their bin or shard is packed into and are added up
    there; then the few partial rows of a key are.  A null key is a key; null
    values add nothing (a key of only null values sums to null).  Repeated rows
    count each time; an empty table gives an empty result.  Only the columns
    named are read, so others cannot clash.  ``scan``: see ``placed_rows``;
    else copies of one row share a shard.
    """
    needed = list(dict.fromkeys([key, *[c for c in sums.values() if c]]))
    placed = placed_rows(df.select(*[F.col(f"`{c}`") for c in needed]), key, tasks=tasks, scan=scan)
    first = [(F.count(F.lit(1)) if c is None else F.sum(f"`{c}`")).alias(f"__{name}") for name, c in sums.items()]
    partial = placed.groupBy("task", key).agg(*first)
    return partial.groupBy(key).agg(*[F.sum(f"__{name}").cast("long").alias(name) for name in sums])


def task_loads(df: DataFrame, key: str, *, tasks: int | None = None, scan: bool = False) -> DataFrame:
    """``task, n_rows, n_keys``: what each task of ``balanced_aggregate`` holds."""
    placed = placed_rows(df.select(f"`{key}`"), key, tasks=tasks, scan=scan)
    per_key = placed.groupBy("task", key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("task").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


def fragment_replicate_join(
    large: DataFrame, small: DataFrame, key: str, *, how: str = "inner", tasks: int | None = None
) -> DataFrame:
    """Equi-join on ``key`` (of both sides) whose heavy keys are spread.

    ``large`` is fragmented by its own loads; each row of ``small`` is sent to
    the tasks that hold its key.  ``how`` is ``inner``, ``left``, ``left_semi``
    or ``left_anti``, seen from ``large``.  Null keys match nothing.  Columns of
    one name on both sides, other than the key, are refused, as the result
    could not name them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if how in ("inner", "left"):
        clash = ({c.lower() for c in large.columns} & {c.lower() for c in small.columns}) - {key.lower()}
        if clash:
            raise ValueError(f"columns on both sides: {sorted(clash)}")
    n = tasks or default_tasks(large)
    plan = plan_loads(large.select(key), key, n)
    left = fragment(large, key, plan).repartitionById(n, F.col("task"))
    right = replicate(small.where(F.col(key).isNotNull()), key, plan).repartitionById(n, F.col("task"))
    return left.join(right.hint("merge"), ["task", key], how).drop("task")


def dominating_keys(per_key: DataFrame, key: str, load: str, *, share: float = 0.05) -> DataFrame:
    """Keys that hold at least ``share`` of all rows with a non-null key.

    There are at most ``1 / share`` of them.  ``per_key`` is the result of
    ``balanced_aggregate``.
    """
    held = per_key.where(F.col(key).isNotNull())
    return held.where(F.col(load) >= F.lit(share) * held.agg(F.sum(load)).scalar())
