import re

import pytest

from tessera.operators.delimited import CANDIDATES, infer_delimiters, mask_fields, split_fields, split_values

S = "record_id long, field_text string, extra string"
CASES = {
    "a|b|c": ["a", "b", "c"],
    "a, b ,c": ["a", "b", "c"],
    "a;b;;a": ["a", "b", "a"],
    "a\nb\nc": ["a", "b", "c"],
    "a\tb": ["a", "b"],
    "a b  c": ["a", "b", "c"],
    '"x, y"|b': ["x, y", "b"],
    '"the ""small"" one";b': ['the "small" one', "b"],
    '["a", "b c"]': ["a", "b c"],
    "['a', 'b, c']": ["a", "b, c"],
    "[]": [],
    " ": [],
    "": [],
    "|": [],
    "a|b,c;d": ["a", "b", "c", "d"],
    '" padded "|b': ["padded", "b"],
    "solo": ["solo"],
    '"open|b': None,  # a quote that is never closed: any split, no crash
}


def test_values_and_positions(spark, rows):
    texts = list(CASES)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], S)
    got = {}
    for _, i, pos, value in rows(split_values(df, source_field="f", record_id="record_id", field="field_text")):
        got.setdefault(i, {})[pos] = value
    for i, t in enumerate(texts):
        if CASES[t] is not None:
            assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == CASES[t], t
            assert sorted(got.get(i, {})) == list(range(1, len(CASES[t]) + 1))


def test_nulls_repeats_and_empty(spark, rows):
    df = spark.createDataFrame([(1, "a|b", "x"), (1, "a|b", "y"), (None, "a", "x"), (2, None, "x")], S)
    assert rows(split_values(df, source_field="f", record_id="record_id", field="field_text")) == [("f", 1, 1, "a"), ("f", 1, 2, "b")]
    assert rows(split_values(df.limit(0), source_field="f", record_id="record_id", field="field_text")) == []


def test_long_field_and_clashing_columns(spark):
    long = "|".join(f"v{i}" for i in range(20000))
    df = spark.createDataFrame([(1, long, "x")], "delimiter long, item_value string, masked_text string")
    out = split_values(df, source_field="f", record_id="delimiter", field="item_value")
    assert out.count() == 20000
    quotes = '"' + '""' * 20000 + '"'
    assert split_values(spark.createDataFrame([(1, quotes, "x")], S), source_field="f", record_id="record_id", field="field_text").count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_tokens(spark, rows, seed):
    import random

    r = random.Random(seed)
    data = []
    for i in range(300):
        words = [r.choice(["ab", "c-d", "x1", '"p q"', '"m,n"']) for _ in range(r.randint(0, 6))]
        data.append(("s", i, r.choice(["|", ", ", ";", "\n", " "]).join(words)))
    got = rows(split_fields(spark.createDataFrame(data, "source_field string, record_id long, field_text string")))
    want = []
    for s, i, t in data:
        for k, v in enumerate(re.findall(r'"[^"]*"|[^\s,;|"]+', t), 1):
            want.append((s, i, k, v.strip('"')))
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


F = "source_field string, record_id long, field_text string"


def test_inference_beats_a_fixed_split(spark, rows):
    """One separator class for all sources would cut phrases or miss blanks."""
    places = ["New York, LA", "San Jose, New York, Rome", "LA, Rome", "Rome, New York"]
    data = [("places", i, t) for i, t in enumerate(places)] + [("tags", i, t) for i, t in enumerate(["c++ node.js", "py-3 c++ x", "node.js", "x y-1"])]
    data += [("mixed", i, t) for i, t in enumerate(["a/b-1|c/d", "a/b-1;c/d,e/f", "c/d", "a/b-1 c/d"])] + [("paths", i, t) for i, t in enumerate(["C:/a b/c;D:/x y", "D:/x y", "/usr/my lib;/opt/x"])]
    df = spark.createDataFrame(data, F)
    chosen = {r.source_field: r.delimiter for r in infer_delimiters(mask_fields(df)).collect()}
    assert chosen["places"] == "comma" and chosen["tags"] == "space" and chosen["mixed"] == "bar+semicolon+comma+space"
    got = {}
    for s, i, pos, v in rows(split_fields(df)):
        got.setdefault((s, i), {})[pos] = v
    assert [list(got["places", i].values()) for i in range(4)] == [t.split(", ") for t in places]
    assert list(got["tags", 1].values()) == ["py-3", "c++", "x"] and list(got["mixed", 1].values()) == ["a/b-1", "c/d", "e/f"]


def test_scores_against_brute_force(spark):
    import random

    r = random.Random(5)
    kinds = [("numbers", r"[-+]?[0-9]+(?:[.][0-9]+)?"), ("names", r"[A-Za-z0-9_.~@+-]+(?:[/:][A-Za-z0-9_.~@+-]+)*|[A-Za-z0-9_.~@+#-]+"), ("phrases", r"[A-Za-z]+(?: [A-Za-z]+)*")]
    for n in range(4):
        atoms = [["ab", "cd", "x y"], ["1", "2.5", "-3"], ["a/b", "c-1", "d"], ["ab", "7", "=?"]][n]
        texts = [r.choice(["|", ",", ";", "\n"][: n + 1]).join(r.choice(atoms) for _ in range(r.randint(1, 5))) for _ in range(60)]
        best = None
        for i, (name, chars) in enumerate(CANDIDATES):
            cut = "[" + re.escape(chars) + "]+"
            pieces = [[p.strip(" ") for p in re.split(cut, t) if p.strip(" ")] for t in texts]
            flat = [p for ps in pieces for p in ps]
            mean = len(flat) / len(texts)
            spread = (sum(len(p) ** 2 for p in pieces) / len(texts) - mean**2) ** 0.5
            regular = round(max(sum(bool(re.fullmatch(k, p)) for p in flat) for _, k in kinds) / len(flat), 9)
            key = (-regular, 0.02 * (name.count("+") + 1) - round(mean / (mean + spread), 9), i, name)
            best = min(best or key, key)
        df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], F)
        assert [r.delimiter for r in infer_delimiters(mask_fields(df)).collect()] == [best[3]]
