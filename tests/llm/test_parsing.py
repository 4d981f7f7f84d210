import json
import random

from tessera.llm.parsing import _deep_json, check_syntax, judge, one_per_file, syntax_rates

CASES = [
    ("a.py", "x = 1\n", True, "valid"), ("a.py", "", True, "valid"), ("a.py", "def f(:\n", False, "corrupt"), ("a.py", "print 'x'\n", False, "corrupt"),
    ("a.py", "<<<<<<< ours\nx = 1\n=======\nx = 2\n>>>>>>> theirs\n", False, "merge_conflict"), ("a.py", 'N = """\n<<<<<<< ours\n"""\n', True, "valid"),
    ("a.py", "[tool.x]\n\"a b\" = 1\n", False, "wrong_extension"), ("a.py", "[tool.x]\na = 1\n", True, "valid"), ("A.PY", "x = \x00", False, "corrupt"), ("a.py", chr(0xFEFF) + "x = 1\n", True, "valid"),
    ("a.json", '{"a": [1, 2.5e3, null]}', True, "valid"), ("a.json", "{'a': 1}", False, "wrong_extension"), ("a.json", "", False, "wrong_extension"), ("a.json", '{"a": NaN}', False, None),
    ("a.json", '{"a": 1', False, "corrupt"), ("a.json", "[" + "9" * 9000 + "]", True, "valid"), ("a.json", "[" * 200000, False, None),
    ("a.toml", 'a = 1\n[b]\nc = "d"\n', True, "valid"), ("a.toml", "a = \n", False, "corrupt"), ("a.toml", "a = 1\na = 2\n", False, None),
    ("a.xml", "<a><b/></a>", True, "valid"), ("a.xml", "<a><b></a>", False, "corrupt"), ("a.xml", '<?xml version="1.0" encoding="latin-1"?><a>' + chr(0xE9) + "</a>", True, "valid"), ("a.xml", '{"a": 1}', False, "wrong_extension"),
]


def test_cases():
    for path, text, valid, cause in CASES:
        got = judge(path, text)
        assert got[1] is valid, (path, text[:30], got)
        assert cause is None or got[4] == cause, (path, text[:30], got)
    assert judge("a.yaml", "a: 1")[1] is None and judge(None, "x")[1] is None and judge("a.py", None)[1] is None and judge("py", "x = (")[1] is None


def test_columns_and_rates(spark, rows):
    data = [(i, 1, p, t, "e") for i, (p, t, _, _) in enumerate(CASES)] + [(90, 1, None, None, None), (91, None, "z.py", "x = (", None), (91, None, "z.py", "x = (", None)]
    df = spark.createDataFrame(data, "file_id long, repo long, rel_path string, text string, valid string")
    out = check_syntax(df, keys=["file_id", "repo"])
    assert {(r.file_id, r.valid) for r in out.collect() if r.file_id < 90} == {(i, c[2]) for i, c in enumerate(CASES)}
    rate = {(r.repo, r.grammar): (r.n_files, r.n_invalid) for r in syntax_rates(out.distinct(), ["repo", "grammar"]).collect()}
    assert rate[None, "python"] == (1, 1) and rate[1, "xml"] == (4, 2)
    assert check_syntax(df.limit(0), keys=["file_id"]).count() == 0


def test_marks_and_depth():
    bom = chr(0xFEFF)
    assert judge("a.json", bom + "{}")[3:] == ("json", "valid") and judge("a.toml", bom + "a = 1\n")[1] is True
    deep = "[" * 150_000 + "1" + "]" * 150_000
    assert judge("a.json", deep)[1] is True and judge("a.json", deep[:-1])[1] is False and judge("a.json", deep + "x")[1] is False
    got = judge("a.py", "x = " + "-" * 300_000 + "1\n")
    assert got[1] is None and got[4] == "undecided"
    long = judge("a.py", "x = (" + "\n" * 50 + '"' + "y" * 500 + "\n")
    assert long[1] is False


def test_deep_reader_against_the_plain_one():
    r = random.Random(2)
    bits = ["{", "}", "[", "]", ",", ":", '"a"', "1", " ", "null", "-0.5e3", '"\\u00e9"', "01", '"\n"']
    for _ in range(20_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        try:
            json.loads(t)
            want = True
        except ValueError:
            want = False
        try:
            _deep_json(t)
            got = True
        except ValueError:
            got = False
        assert got is want, t


def test_one_row_per_file(spark):
    data = [(1, "a.py", "x = 1"), (1, "a.py", "x = ("), (2, "a.py", "y"), (2, "a.py", "y"), (None, "a.py", "("), (None, "a.py", "z"), (3, "a.md", "z")]
    out = one_per_file(check_syntax(spark.createDataFrame(data, "file_id long, rel_path string, text string"), keys=["file_id"]), "file_id")
    assert sorted((r.file_id, r.valid) for r in out.collect()) == [(1, False), (2, True), (3, None)]
