from collections import Counter

from tessera.operators.sequence import carry_forward, next_in_sequence, running_sum, with_ordinal
from tessera.operators.skew import balanced_aggregate, dominating_keys, fragment, fragment_replicate_join, plan_loads, task_loads


def _skewed(spark, n=3000):
    data = [("hot" if i % 3 else ("null" if i % 6 else f"k{i % 50}"), i, i % 7) for i in range(n)]
    return spark.createDataFrame([(None if k == "null" else k, i, v) for k, i, v in data], "k string, i long, v long").repartition(4)


def test_sums_match_and_load_is_even(spark, rows):
    df = _skewed(spark)
    want = Counter(), Counter()
    for r in df.collect():
        want[0][r.k] += 1
        want[1][r.k] += r.v
    got = balanced_aggregate(df, "k", {"n": None, "s": "v"}, tasks=6)
    assert {r.k: (r.n, r.s) for r in got.collect()} == {k: (want[0][k], want[1][k]) for k in want[0]}
    plan = plan_loads(df, "k", 6)
    placed = Counter(r.task for r in fragment(df, "k", plan).select("task").collect())
    assert max(placed.values()) < 1.6 * 3000 / 6


def test_dominating_keys_ignore_null(spark, rows):
    per = balanced_aggregate(_skewed(spark), "k", {"n": None})
    assert rows(dominating_keys(per, "k", "n").select("k")) == [("hot",)]
    assert rows(dominating_keys(per.limit(0), "k", "n")) == []


def test_join_equals_plain_join(spark, rows):
    left, right = _skewed(spark), spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("zz", 4), (None, 5)], "k string, w long")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = fragment_replicate_join(left, right, "k", how=how, tasks=5)
        assert rows(got.select(sorted(got.columns))) == rows(left.join(right, "k", how).select(sorted(got.columns))), how


def test_join_runs_without_another_shuffle_of_the_large_side(spark):
    left, right = _skewed(spark), spark.createDataFrame([("hot", 1)], "k string, w long")
    plan = fragment_replicate_join(left, right, "k", tasks=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 3, plan


def test_empty_and_clash(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert balanced_aggregate(df, "k", {"n": None}).count() == 0
    assert fragment_replicate_join(df, df.select("k"), "k").count() == 0
    try:
        fragment_replicate_join(df, df, "k")
        raise AssertionError("clash accepted")
    except ValueError:
        pass


def test_next_in_sequence(spark, rows):
    data = [(i % 2 if i % 5 else None, i, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(data, "g long, o long, v string")
    got = {(r.g, r.o): r.nxt for r in next_in_sequence(df, ["g"], ["o"], "v", "nxt", partitions=7).collect()}
    for g in (0, 1, None):
        seq = [x for x in data if x[0] == g]
        for a, b in zip(seq, [*seq[1:], (None, None, None)]):
            assert got[g, a[1]] == b[2]


def test_carry_forward(spark):
    data = [(i % 2 if i % 5 else None, i, f"v{i}" if i % 11 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(data, "g long, o long, v string")
    got = {(r.g, r.o): r.c for r in carry_forward(df, ["g"], ["o"], "v", "c", partitions=9).collect()}
    for g in (0, 1, None):
        last = None
        for _, o, v in [x for x in data if x[0] == g]:
            last = v or last
            assert got[g, o] == last
    assert len(got) == 300


def test_sequences_of_many_rows(spark):
    """More rows than the borders are sampled from."""
    n = 60000
    df = spark.range(n).selectExpr("id % 3 AS g", "id AS o", "CASE WHEN id % 1000 < 3 THEN id END AS v", "'x' AS extra").repartition(7)
    bad = next_in_sequence(df, ["g"], ["o"], "o", "nxt", partitions=11).where(f"NOT (nxt <=> CASE WHEN o + 3 < {n} THEN o + 3 END)")
    assert bad.count() == 0
    bad = carry_forward(df, ["g"], ["o"], "v", "c", partitions=11).where("NOT (c <=> CASE WHEN (o - g) % 1 = 0 THEN o - o % 1000 + pmod(g - (o - o % 1000) % 3, 3) END) AND o % 1000 >= 3")
    assert bad.count() == 0


def test_tasks_hold_like_loads(spark):
    """A third of all rows under one key, all copies of one row: no task is far above the median."""
    from statistics import median

    folder = "hot"
    df = spark.range(240_000, numPartitions=8).selectExpr(f"CASE WHEN id % 3 = 0 THEN '{folder}' ELSE concat('k', id % 40000) END AS k")
    loads = sorted(r.n_rows for r in task_loads(df, "k", tasks=12, scan=True).collect())
    assert sum(loads) == 240_000 and len(loads) == 12
    assert loads[-1] <= 1.5 * median(loads)


def test_rows_are_added_up_where_they_are_placed(spark):
    plan = balanced_aggregate(_skewed(spark), "k", {"n": None}, tasks=6)._jdf.queryExecution().executedPlan().toString()
    assert "directpassthrough" in plan.lower() or "shufflepartitionid" in plan.lower(), plan
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 4, plan


def test_running_sums_and_ordinals(spark):
    data = [(i % 2 if i % 5 else None, i, i % 7 if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(data, "g long, o long, v long").repartition(3)
    got = {(r.g, r.o): r.s for r in running_sum(df, ["g"], ["o"], "v", "s", partitions=9).collect()}
    for g in (0, 1, None):
        total = 0
        for _, o, v in [x for x in data if x[0] == g]:
            total += v or 0
            assert got[g, o] == total
    ids = {r.o: r.id for r in with_ordinal(df, ["o"], "id", "item_%05d").collect()}
    assert ids == {i: f"item_{i + 1:05d}" for i in range(300)} and with_ordinal(df.limit(0), ["o"], "id", "%d").count() == 0
