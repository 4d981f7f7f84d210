"""Written forms, range and prefix joins, and choices among ranked rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import forms as W
from tessera.operators.ranges import first_by_state, greedy_units, longest_prefix, range_join, ranked_within, replace_rows
from tessera.sources.readers import rule_rows
from tessera.sources.writers import with_header, write_run, write_transitions


def _one(spark, f, value):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


def test_forms(spark):
    got = [(r.form, r.quote, r.literal) for r in _one(spark, W.search_forms, "o/m-1")]
    assert got == [("full", "double", '"o/m-1"'), ("full", "single", "'o/m-1'"), ("namespace_free", "double", '"m-1"'), ("namespace_free", "single", "'m-1'")]
    assert _one(spark, lambda c: W.query_text(c, F.lit(1), F.lit(9)), '"a\\b"') == '"\\"a\\\\b\\"" size:1..9'
    sha = "0123456789abcdef0123456789abcdef01234567"
    url = _one(spark, lambda c: W.location_url(F.lit("https://g.example/o/r"), c, F.lit("a%20b.py"), F.lit(3)), sha)
    assert url == f"https://g.example/o/r/blob/{sha}/a%20b.py#L3" and tuple(_one(spark, W.url_parts, url)) == ("o/r", sha, "a b.py")
    assert tuple(_one(spark, W.url_parts, "https://g.example/o/r/blob/main/a.py")) == (None, None, None) == tuple(_one(spark, W.url_parts, None))
    assert _one(spark, W.argument_value, " https://hub.example/models/o/m?x=1#y") == "o/m" and _one(spark, W.argument_value, "m") == "m"
    assert _one(spark, W.plain_values, '["o/m", null, true, 3, "<id>", "{x}", ""]') == ["o/m"] and _one(spark, W.plain_values, "no list") is None
    assert _one(spark, W.sanitized_terms, "The Model of-x AB") == ["model", "ab"]
    keys = {"a = 1": "a", '"b": 2': "b", "c['k'] = 3": "k", "d == 4": None, "": None, "x.y = 1": "x.y", None: None}
    assert {t: _one(spark, W.setting_key, t) for t in keys} == keys
    assert _one(spark, lambda c: W.keyword_value(c, ("model", "engine")), 'f(engine = "m-1")') == "m-1" and _one(spark, lambda c: W.keyword_value(c, ("model",)), 'f(my_model="x")') is None
    assert _one(spark, W.slug, " A/B c_") == "a-b-c" and _one(spark, W.plain_markup, "<b>A</b> &lt;i&gt;&amp;lt; <br>x") == "A <i>&lt; x"
    html = '<ul><li class="group absolute">a<b>1</b></li><li class="other">b</li><li id="x" class="absolute group">c\n</li></ul>'
    assert _one(spark, lambda c: W.list_items(c, "group"), html) == ["a<b>1</b>", "c\n"]
    paths = {"./a": True, "/a": True, "~/m": True, "C:\\m": True, "w.safetensors": True, "o/m-1.5": False, "o/m": False}
    assert {p: _one(spark, W.local_path, p) for p in paths} == paths
    lines = {"x = load(a)": True, "# load(a)": False, "def load(a):": False, "class load:": False, "other()": False}
    assert {t: _one(spark, lambda c: W.reference_line(c, F.lit("load")), t) for t in lines} == lines
    assert spark.sql("select timestamp'2024-01-02 03:04:05' as t").select(W.compact_time(F.col("t"))).first()[0] == "20240102030405"


def test_range_join_against_brute_force(spark, rows):
    r = random.Random(3)
    pts = [(i, r.choice("ab"), r.randint(0, 300)) for i in range(120)]
    spans = [(j, r.choice("ab"), *sorted((r.randint(0, 300), r.randint(0, 300)))) for j in range(40)] + [(99, "a", 10, 5)]
    got = range_join(spark.createDataFrame(pts, "i long, k string, at long"), spark.createDataFrame(spans, "j long, k string, s long, e long"), ["k"], "at", "s", "e", cell=32)
    assert {(x.i, x.j) for x in got.collect()} == {(i, j) for i, k, a in pts for j, k2, s, e in spans if k == k2 and s <= a <= e} and got.count() == len({(x.i, x.j) for x in got.collect()})
    with pytest.raises(ValueError):
        range_join(got, got, ["k"], "at", "s", "e", cell=3)


def test_ranks_within_a_tolerance(spark, rows):
    left = spark.createDataFrame([(1, "k", 10.0), (2, "k", 500.0)], "row_id long, k string, at double")
    right = spark.createDataFrame([("k", 8.0, "b"), ("k", 12.0, "a"), ("k", 12.0, "a"), ("k", 10.0, "hit"), ("k", 15.1, "far"), ("q", 10.0, "no")], "k string, t double, v string")
    get = lambda **kw: rows(ranked_within(left, right, ["k"], "at", "t", "v", tolerance=5.0, **kw), "row_id", "rank", "value", "distance")
    assert get() == [(1, 1, "hit", 0.0), (1, 2, "b", 2.0), (1, 3, "a", 2.0)]
    assert get(exact_last=True) == [(1, 1, "b", 2.0), (1, 2, "a", 2.0), (1, 3, "hit", 0.0)]


def test_longest_prefixes(spark, rows):
    names = spark.createDataFrame([(1, "p", "a.b.c"), (2, "p", "a.bc"), (3, "q", "a.b"), (4, "p", None)], "row_id long, k string, n string")
    known = spark.createDataFrame([("p", "a", "x"), ("p", "a.b", "z"), ("p", "a.b", "y"), ("q", "b", "w")], "k string, pre string, v string")
    assert rows(longest_prefix(names, known, ["k"], "n", "pre", "v", mark="."), "row_id", "prefix_found", "value_found") == [(1, "a.b", "y"), (2, "a", "x"), (3, None, None), (4, None, None)]


def test_choices(spark, rows):
    df = spark.createDataFrame([("a", "bad", 1), ("a", "good", 3), ("a", "good", 2), ("b", "odd", 9), ("b", "bad", 10)], "k string, s string, i long")
    assert rows(first_by_state(df, ["k"], "s", ["good", "bad"], ["i"], "i"), "k", "i", "s") == [("a", 2, "good"), ("b", 10, "bad")]
    assert rows(replace_rows(df.where("k = 'b'"), spark.createDataFrame([("b", "new", 9)], "k string, s string, i long"), ["k", "i"]), "k", "s", "i") == [("b", "bad", 10), ("b", "new", 9)]
    ev = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1), (None, 1)], "k string, o long")
    cap = spark.createDataFrame([("a", 1), ("a", 2), ("c", 9)], "k string, units long")
    assert rows(greedy_units(ev, cap, ["k"], ["o"]), "k", "o", "taken") == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("b", 1, False), (None, 1, False)]


def test_rules_and_writers(spark, rows, tmp_path):
    rules = spark.createDataFrame([(" sdk ", " load ", "model, name=3;x"), ("sdk", "load", "model, name=3;x"), ("sdk", " ", "m"), ("sdk", None, "m"), ("sdk", "get", None)], "origin string, loader string, args string")
    got = [(r.origin, r.loader, r.argument_names) for r in rule_rows(rules, ["origin", "loader", "args"], loader="loader", arguments="args").orderBy("loader").collect()]
    assert got == [("sdk", "get", []), ("sdk", "load", ["model", "name", "x"])]
    with pytest.raises(ValueError):
        rule_rows(rules, ["none"], loader="loader", arguments="args")
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    assert with_header(spark.createDataFrame([("7",)], "a string"), schema).collect() == [(None, 7)]
    with pytest.raises(ValueError):
        with_header(rules, schema)
    frame = spark.createDataFrame([(1,), (2,)], "x long")
    for commit, part in (("c1", frame), ("c2", frame), ("c1", frame.limit(1))):
        write_run({"traces": part}, str(tmp_path / "run"), repository="o/r", commit=commit)
    assert {r["commit"]: r["count"] for r in spark.read.parquet(str(tmp_path / "run/traces")).groupBy("commit").count().collect()} == {"c1": 1, "c2": 2}
    write_transitions(spark.createDataFrame([("b", "c", "x"), ("a", "z", "y"), ("b", "c", "x")], "old string, new string, category string"), str(tmp_path / "t"))
    assert rows(spark.read.csv(str(tmp_path / "t"), header=True)) == [("a", "z", "y"), ("b", "c", "x")]
