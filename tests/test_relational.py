import random
import itertools

from pyspark.sql import functions as F

from tessera.operators.flow_allocation import allocate_replacements, allocate_units, max_flow_events, max_flow_units
from tessera.operators.graph import connected_components, distances, spread_sets
from tessera.operators.joins import innermost_interval, latest_before, nearest_join, presence, set_differences, suffix_counts, suffix_join, unique_suffixes
from tessera.operators.matching import conservation, staged_matches, unmatched
from tessera.operators.scores import confusion, exact_quantile, paired_gains, poisson_weight
from tessera.operators.summary import group_summary, labelled_counts, share_within, spine_counts


def test_nearest_with_ties_and_tolerance(spark, rows):
    left = spark.createDataFrame([(1, "a", 10.0), (2, "a", 100.0), (3, "b", 5.0)], "row_id long, k string, at double")
    right = spark.createDataFrame([("a", 8.0, "lo"), ("a", 12.0, "hi"), ("a", 10.0 + 95, "far"), ("b", 5.0, "hit")], "k string, to double, v string")
    got = nearest_join(left, right, ["k"], "at", "to", "v", tolerance=4.0)
    assert rows(got, "row_id", "near_value", "near_distance") == [(1, "lo", 2.0), (2, None, None), (3, "hit", 0.0)]


def test_latest_before(spark, rows):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "i long, k string, at long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 3, "z"), ("a", 7, "w")], "k string, t long, v string")
    assert rows(latest_before(left, right, ["k"], "at", "t", "v", order="i"), "i", "before_value") == [(1, "y"), (2, None), (3, None)]


def test_innermost_interval(spark, rows):
    p = spark.createDataFrame([(1, "k", 15), (2, "k", 95), (3, "k", 500)], "row_id long, k string, at long")
    i = spark.createDataFrame([("k", 0, 100, "wide"), ("k", 10, 20, "tight"), ("k", 90, 90, "no")], "k string, s long, e long, n string")
    assert rows(innermost_interval(p, i, ["k"], "at", "s", "e", "n", cell=16), "row_id", "inside") == [(1, "tight"), (2, "wide"), (3, None)]


def test_suffix_join_and_aliases(spark, rows):
    c = spark.createDataFrame([("a.b.call",), ("x.call",), ("q.other",), (None,)], "chain string")
    r = spark.createDataFrame([("b.call",), ("z.call",)], "rule string")
    assert rows(suffix_join(c, r, "chain", "rule")) == [("a.b.call", "b.call", "suffix"), ("x.call", "b.call", "terminal"), ("x.call", "z.call", "terminal")]
    m = spark.createDataFrame([(1, "a.b"), (1, "c.b"), (2, "a.b")], "g long, m string")
    assert rows(unique_suffixes(m, ["g"], "m"), "g", "alias", "m") == [(1, "a.b", "a.b"), (1, "c.b", "c.b"), (2, "a.b", "a.b"), (2, "b", "a.b")]


def test_presence_and_differences(spark, rows):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert rows(presence(a, b, "k")) == [("x", True, False), ("y", True, True), ("z", False, True)]
    assert rows(set_differences(a.dropna(), b, ["k"])) == [("x", "left"), ("z", "right")]


def test_staged_matches_conserve(spark, rows):
    old = spark.createDataFrame([("p", "o1", "h1", "n"), ("p", "o2", "h2", "n"), ("p", "o3", "h3", "m"), ("p", "o4", None, None)], "pair string, item string, h string, n string")
    new = spark.createDataFrame([("p", "n1", "h1", "q"), ("p", "n2", "h9", "n"), ("p", "n3", "h8", "m"), ("p", "n4", "h8", "m")], "pair string, item string, h string, n string")
    m = staged_matches(old, new, "pair", "item", [("h", F.col("h")), ("n", F.col("n"))])
    assert rows(m) == [("p", "o1", "n1", "h"), ("p", "o2", "n2", "n")]
    rest = unmatched(old, new, m, "pair", "item")
    assert rows(conservation(old, new, m, rest, "pair", "item")) == []
    assert len(rows(conservation(old, new, m, rest.limit(0), "pair", "item"))) == 4


def _union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200)]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {x.node: x.component for x in connected_components(df, "a", "b").collect()}
    assert got == _union_find(edges)


def test_distances_and_sets(spark, rows):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8), (None, 3)], "a long, b long")
    s = spark.createDataFrame([(1,), (None,)], "n long")
    assert rows(distances(e, s, "a", "b", "n", max_depth=9)) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    seeds = spark.createDataFrame([(1, "u"), (3, "v")], "n long, t string")
    assert rows(spread_sets(e.dropna(), seeds, "a", "b", "n", "t")) == sorted([(n, t) for n in (1, 2, 3, 4) for t in "uv"])


def _brute_flow(events, down, up):
    for k in range(len(events), 0, -1):
        for some in itertools.combinations(events, k):
            if all(sum(e[1] == o for e in some) <= down.get(o, 0) for o in {e[1] for e in some}) and all(sum(e[2] == n for e in some) <= up.get(n, 0) for n in {e[2] for e in some}):
                return k
    return 0


def test_max_flow_against_brute_force():
    r = random.Random(5)
    for _ in range(150):
        events = [(f"e{i}", r.choice("abc"), r.choice("xyz")) for i in range(r.randint(0, 7))]
        down, up = {o: r.randint(0, 2) for o in "abc"}, {n: r.randint(0, 2) for n in "xyz"}
        got = max_flow_events(events, down, up)
        assert len(got) == _brute_flow(events, down, up)
        for side, cap, at in ((down, down, 1), (up, up, 2)):
            for k in side:
                assert sum(e[at] == k for e in events if e[0] in got) <= cap[k]


def test_allocation_per_pair(spark, rows):
    events = spark.createDataFrame([("p", "e1", "a", "x"), ("p", "e2", "a", "y"), ("q", "e1", "a", "x")], "pair string, event string, old_id string, new_id string")
    counts = spark.createDataFrame([("p", "a", 2, 1), ("p", "x", 0, 0), ("p", "y", 0, 1)], "pair string, id string, n_old long, n_new long")
    assert rows(allocate_replacements(events, counts, "pair")) == [("p", "e1", False), ("p", "e2", True), ("q", "e1", False)]


def test_scores_and_summaries(spark, rows):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, None)], "g boolean, p boolean")
    assert rows(confusion(df, "g", "p")) == [(1, 1, 1, 1, 0.5, 0.5, 0.5)]
    assert rows(confusion(df.limit(0), "g", "p", ["g"])) == []
    t = spark.createDataFrame([("a", 1, True), ("a", 2, False), (None, 1, None)], "k string, e long, f boolean")
    assert rows(group_summary(t, ["k"], entity="e", flag=F.col("f"))) == [("a", 2, 2, 1, 0.666667, 1.0, 0.5), (None, 1, 1, 0, 0.333333, 0.5, 0.0)]
    assert rows(labelled_counts(t, {"x": F.col("f"), "y": F.col("e") == 1})) == [("x", 1), ("y", 2)]
    assert rows(spine_counts(t, "k", ["a", "b"], "e", ["1"])) == [("a", 1), ("b", 0)]
    assert rows(share_within(t, ["k"], ["e"]), "k", "e", "share") == [("a", 1, 0.5), ("a", 2, 0.5), (None, 1, 1.0)]


def test_draws_are_poisson_and_paired(spark):
    w = spark.range(50).crossJoin(spark.range(100).toDF("draw")).select(poisson_weight(F.col("draw"), F.col("id")).alias("w"))
    n, total, squares = w.agg(F.count("w"), F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
    assert abs(total / n - 1) < 0.06 and abs(squares / n - 2) < 0.2
    per = spark.createDataFrame([(i, 10, 6 + i % 3, 5) for i in range(30)] + [(99, 0, 0, 0)], "k long, n long, a long, b long")
    gains = [r.gain for r in paired_gains(per, "k", "n", "a", "b", draws=400).collect()]
    assert len(gains) == 400 and abs(sum(gains) / 400 - 0.2) < 0.01 and min(gains) >= 0.1 and max(gains) <= 0.3
    assert paired_gains(per.limit(0), "k", "n", "a", "b", draws=9).count() == 0


def test_exact_quantiles(spark):
    import numpy as np

    r = random.Random(8)
    data = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *map(float, range(40))])) for _ in range(800)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {x.k: x.quantile for x in exact_quantile(df, "k", "v", q).collect()}
        want = {k: float(np.quantile([v for j, v in data if j == k and v is not None], q)) for k in ("a", "b", None, "one")}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_units_against_events():
    r = random.Random(6)
    for _ in range(200):
        edges = [(o, n, r.randint(0, 3)) for o in "abc" for n in "xyz" if r.random() < 0.6]
        down, up = {o: r.randint(0, 4) for o in "abc"}, {n: r.randint(0, 4) for n in "xyz"}
        events = [(f"{o}{n}{i}", o, n) for o, n, c in edges for i in range(c)]
        got = max_flow_units(edges, down, up)
        assert sum(got.values()) == len(max_flow_events(events, down, up))
        room = {(o, n): c for o, n, c in edges}
        assert all(0 < f <= room[e] for e, f in got.items())
        assert all(sum(f for (o, _), f in got.items() if o == i) <= down[i] for i in down) and all(sum(f for (_, n), f in got.items() if n == i) <= up[i] for i in up)


def test_units_per_pair(spark, rows):
    edges = spark.createDataFrame([("p", "a", "x", 5), ("p", "a", "y", 2), ("p", "a", "y", 1), ("q", "a", "x", 1)], "pair string, old_id string, new_id string, capacity long")
    counts = spark.createDataFrame([("p", "a", 4, 0), ("p", "x", 0, 1), ("p", "y", 0, 9)], "pair string, id string, n_old long, n_new long")
    assert rows(allocate_units(edges, counts, "pair")) == [("p", "a", "x", 5, 1), ("p", "a", "y", 3, 3), ("q", "a", "x", 1, 0)]


def test_suffix_counts_equal_pairs(spark, rows):
    chains = spark.createDataFrame([("a.b.c",), ("x.c",), ("y.c",), ("q",), (None,), ("x.c",)], "chain string")
    rules = spark.createDataFrame([("b.c",), ("z.c",), ("w.c",), ("k",)], "rule string")
    pairs = suffix_join(chains, rules, "chain", "rule").groupBy("rule", "by").agg(F.count(F.lit(1)).alias("n"))
    assert rows(pairs) == rows(suffix_counts(chains, rules, "chain", "rule"))


def test_quoted_tokens_after_an_unpaired_quote(spark):
    from tessera.operators.joins import quoted_tokens

    lines = [("# it's 'org/model'",), ("x = 'a/b', \"c/d\"",)]
    got = [r[0] for r in spark.createDataFrame(lines, "t string").select(quoted_tokens(F.col("t"))).collect()]
    assert "org/model" in got[0] and {"a/b", "c/d"} <= {*got[1]}
