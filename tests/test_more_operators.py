from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.graph import shortest_paths
from tessera.operators.matching import turnover_groups
from tessera.operators.summary import frequencies, joined_sets
from tessera.operators.syntax_context import annotated_literals, classify_positions, context_spans, literal_roles
from tessera.operators.graph import connected_components, distances
from tessera.sources import tables
from tessera.sources.tables import distinct_texts, spread


def test_shortest_paths_with_ties_and_cycles(spark, rows):
    e = spark.createDataFrame([("a", "b", "x"), ("a", "c", "y"), ("b", "d", "z"), ("c", "d", "w"), ("d", "a", "v"), ("q", "r", "u"), (None, "a", "n")], "s string, t string, k string")
    got = shortest_paths(e, spark.createDataFrame([("a",), (None,)], "n string"), "s", "t", "n", "k")
    assert [(r.node, r.path, r.kinds) for r in got.orderBy("node").collect()] == [("a", ["a"], []), ("b", ["a", "b"], ["x"]), ("c", ["a", "c"], ["y"]), ("d", ["a", "b", "d"], ["x", "z"])]


def test_merged_frequencies_count_cases_anew(spark, rows):
    df = spark.createDataFrame([(i, "big") for i in range(30)] + [(1, "r1"), (1, "r2"), (2, "r2"), (2, "r2"), (None, "big"), (3, None)], "c long, k string")
    assert rows(frequencies(df, "c", "k")) == [("Other", 2, 0.066667), ("big", 30, 1.0)]
    assert rows(frequencies(df.limit(0), "c", "k")) == []


def test_turnover_and_sets(spark, rows):
    rest = spark.createDataFrame([("p", "old", "a.py"), ("p", "new", "b.py"), ("p", "new", "c.js"), ("q", "old", "a.py")], "pair string, side string, item string")
    assert rows(turnover_groups(rest, "pair", F.regexp_extract("item", r"\.(\w+)$", 1))) == [("p", "py", 1, 1)]
    df = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", "b"), ("k", None)], "k string, v string")
    assert rows(joined_sets(df, "k", {"vs": "v"})) == [("k", "a | b")]


def test_keywords_and_counts(spark, rows):
    df = spark.createDataFrame([("A model, remodel; TOKEN2 token",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.keyword_hits(F.col("t"), ("token", "model", "del"))).collect()] == [["token", "model"], [], []]
    c = spark.createDataFrame([("aaaa.b",)], "t string")
    assert rows(c.select(X.overlapping_count(F.col("t"), "aa"), X.overlapping_count(F.col("t"), "."), X.overlapping_count(F.col("t"), "^"))) == [(3, 1, 0)]


def test_contexts(spark, rows):
    text = '"""Doc\nmore."""\nx = 1  # note\n\ndef f():\n    "inner"\n    return "# no", f"a{x}b"\n'
    last = 10**9
    spans = context_spans(text)
    assert spans[3] == [(7, 13, 1)] and (0, last, 0) in spans[1] and (0, last, 0) in spans[2] and (0, last, 0) in spans[6] and spans[7][0] == (11, 17, 2)
    files = spark.createDataFrame([(1, text), (2, "# c\nx = 'a'\ndef (:\n  '''open\n"), (3, None)], "file_id long, text string")
    points = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (1, 3, 12), (1, 7, 13), (1, 7, 5), (2, 1, 3), (2, 2, 6), (2, 4, 9), (3, 1, 1), (None, 1, 1)], "file_id long, line int, column int")
    want = ["docstring", "code_or_unknown", "comment", "string_literal", "code_or_unknown", "comment", "string_literal", "code_or_unknown", "code_or_unknown", "code_or_unknown"]
    got = {(r.file_id, r.line, r.column): r.context for r in classify_positions(files, points).collect()}
    assert [got[tuple(p)] for p in points.collect()] == want


def test_roles_of_literals(spark):
    text = 'a = "assign"\nb = ["item"]\nf("pos", k="kw")\nd = {"key": "val"}\ndef g(x="dflt"):\n    return "ret"\nassert a != "cmp"\nd["sub"]\n"alone"\n'
    files = spark.createDataFrame([(1, text), (2, "def (:"), (None, "x"), (3, None)], "file_id long, text string")
    got = {r.literal: (r.role, r.name) for r in literal_roles(files).collect()}
    assert got == {
        "assign": ("assignment", "a"), "item": ("collection_item", "b"), "pos": ("positional_argument", "f"), "kw": ("keyword_argument", "k"), "key": ("mapping_key", None), "val": ("mapping_value", "key"),
        "dflt": ("parameter_default", None), "ret": ("return", None), "cmp": ("comparison", "a"), "sub": ("subscript", "d"), "alone": ("standalone", None),
    }
    assert annotated_literals("Optional[Literal['a', 'b'] | t.Literal['c']]") == ["a", "b", "c"] and annotated_literals("x[") == [] == annotated_literals("int")


def test_spread(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() >= 4 and spread(one).count() == 100
    wide = spark.range(100).repartition(9)
    assert spread(wide) is wide


def test_distinct_texts(spark, rows, tmp_path, monkeypatch):
    data = [(1, "a", "x.py"), (1, "a", "x.py"), (1, "b", "x.py"), (2, "a", "y.py"), (None, "a", "z.py"), (None, "a", "z.py"), (3, None, "q.py"), (3, None, "q.py")] * 2
    spark.createDataFrame(data, "i long, t string, p string").repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    scan = spark.read.parquet(f"{tmp_path}/t.parquet")
    for limit in (1_000_000, 0):
        monkeypatch.setattr(tables, "BROADCAST_ROWS", limit)
        assert rows(distinct_texts(scan, ["i"], "t", ["i", "t"])) == rows(scan.select("i", "t").distinct())
        assert rows(distinct_texts(scan.where("p = 'x.py'"), ["i"], "t", ["i", "t"])) == [(1, "a"), (1, "b")]
    assert distinct_texts(scan.where("false"), ["i"], "t", ["i"]).count() == 0


def test_long_chains_have_no_bound(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    s = spark.createDataFrame([(0,)], "n long")
    assert distances(e, s, "a", "b", "n").count() == 13 and distances(e, s, "a", "b", "n", max_depth=3).count() == 4


def test_hub_components(spark, monkeypatch):
    from tessera.operators import graph

    monkeypatch.setattr(graph, "BROADCAST_BYTES", -1)
    e = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(5)] + [(200, 200), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(60)}, **{100 + i: 100 for i in range(6)}, 200: 200}
