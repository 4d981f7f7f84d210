import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions.keys import author_key, canonical_path, snapshot_key
from tessera.sources.readers import duplicate_keys, lenient_long, read_csv, read_json_lines, read_sources, truthy
from tessera.sources.writers import clean_cells, summary_row, union_all, write_csv, write_parts
from tessera.streaming.incremental import maintain_counts, read_counts


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c"))).first()[0]


def test_keys(spark):
    nbsp = chr(0xA0)
    assert one(spark, snapshot_key, f" {nbsp}Snap-A1 ") == "snap-a1"
    assert one(spark, canonical_path, "./a\\b//c/../d") == "a/b/c/../d" and one(spark, canonical_path, "//x") == "x" and one(spark, canonical_path, ".github/x") == ".github/x"
    assert one(spark, author_key, " ~Acme ") == "acme" and one(spark, author_key, None) is None


def test_text_functions(spark):
    assert one(spark, X.words, "parseHTTPReply_v2") == ["parse", "httpreply", "v2"]
    assert one(spark, X.terms, "a-B/a.c") == ["a", "b", "c"]
    assert one(spark, X.module_name, "src/a/b/__init__.py") == "a.b"
    assert one(spark, X.path_signal, "lib/vendor/x.py") == "third_party_or_vendored_code" and one(spark, X.path_signal, "my_demo/x.py") == "example_or_demo_code" and one(spark, X.path_signal, "a/b.py") is None
    assert [one(spark, X.tag_category, t) for t in ("v1.2.3", "release-1.2", "nightly")] == ["strict", "lenient", "other"]
    assert one(spark, X.human_number, "12.5K tokens") == 12500.0 and one(spark, X.human_number, "none") is None
    assert one(spark, X.unquote, "'a'b'") == "a'b" and one(spark, X.unquote, "'a\"") == "'a\""
    assert one(spark, X.suffixes, "a.b.c") == ["a.b.c", "b.c", "c"]
    assert one(spark, X.dotted, "  My Name--x ") == "my.name.x"
    assert str(one(spark, X.utc_time, "2024-01-02")) == "2024-01-02 00:00:00" and one(spark, X.utc_time, "n/a") is None


def test_csv_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 'x "y", z'), ("b", "two\nlines"), ("c", "cr\rnul\0")], "k string, v string")
    write_csv(df, str(tmp_path / "o"), quote_all=True, order=["k"])
    got = read_csv(spark, str(tmp_path / "o"), ["k", "v"])
    assert rows(got) == [("a", 'x "y", z'), ("b", "two\nlines"), ("c", "cr\\rnul")] == rows(clean_cells(df))
    with pytest.raises(Exception):
        write_csv(df, str(tmp_path / "o"), exclusive=True)
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "o"), ["k", "w"])
    assert read_csv(spark, str(tmp_path / "none"), ["k"], missing_ok=True).count() == 0
    (tmp_path / "bom.csv").write_text(chr(0xFEFF) + "k,v\n1,2\n", encoding="utf-8")
    assert rows(read_csv(spark, str(tmp_path / "bom.csv"), ["k", "v"])) == [("1", "2")]


def test_json_sources_and_keys(spark, tmp_path, rows):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": "x"\n')
    got = read_json_lines(spark, str(tmp_path / "a.jsonl"), T.StructType([T.StructField("k", T.LongType())]))
    assert sorted(r.k is None for r in got.collect()) == [False, True]
    (tmp_path / "r" / "site-packages").mkdir(parents=True)
    (tmp_path / "r" / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "r" / "site-packages" / "b.py").write_bytes(b"y")
    src = read_sources(spark, str(tmp_path / "r")).collect()
    assert [(r.size_bytes, r.text) for r in src] == [(6, "x = 1\n")]
    import hashlib

    assert src[0].git_blob_sha == hashlib.sha1(b"blob 6\0x = 1\n").hexdigest()
    assert rows(duplicate_keys(spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"), ["k"])) == [(1, 2), (None, 1)]
    v = spark.createDataFrame([("Yes",), ("0",), (None,), ("3.9",)], "v string").select(truthy("v"), lenient_long("v"))
    assert rows(v) == [(False, 0), (False, 0), (False, 3), (True, 0)]


def test_writers(spark, tmp_path, rows):
    a, b = spark.createDataFrame([(1, "x")], "i long, p string"), spark.createDataFrame([(2, "y", True)], "i long, p string, z boolean")
    both = union_all(a, b)
    write_parts(both, str(tmp_path / "parts"), ["p"])
    write_parts(spark.createDataFrame([(3, "x", None)], "i long, p string, z boolean"), str(tmp_path / "parts"), ["p"])
    assert rows(spark.read.parquet(str(tmp_path / "parts")), "i", "p") == [(2, "y"), (3, "x")]
    assert rows(summary_row(b=both, a=a)) == [('{"a":1,"b":2}',)]


def test_streamed_counts(spark, tmp_path, rows):
    schema = "relation string, key string, refs long, lives long"
    src, state, log = (str(tmp_path / n) for n in ("deltas", "state", "log"))
    deltas = [[("r", "k", 1, 0), ("r", "l", 1, 0)], [("r", "k", 0, 1)], [("r", "m", 2, 0)], [("r", "l", -1, 0)], [("r", "k", 1, 0)]]
    for n, some in enumerate(deltas):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(src)
        maintain_counts(spark.readStream.schema(schema).parquet(src), state, log, compact_every=2).awaitTermination()
        want = {}
        for _, k, refs, lives in (d for part in deltas[: n + 1] for d in part):
            a, b = want.get(k, (0, 0))
            want[k] = (a + refs, b + lives)
        assert rows(read_counts(spark, state)) == sorted(("r", k, *v) for k, v in want.items() if v != (0, 0))
    assert rows(read_counts(spark, state, upto=1)) == [("r", "k", 1, 1), ("r", "l", 1, 0)]
    assert sorted(p.name for p in (tmp_path / "state" / "base").iterdir()) == ["compacted=1", "compacted=3"]
