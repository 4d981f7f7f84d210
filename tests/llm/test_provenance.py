import random
import time

import pytest

from tessera.llm import provenance
from tessera.llm.provenance import composition_origin, copies_elsewhere, file_origins, header_origin, line_hashes, path_origin

HAND = 'import os\n\ndef load(path, retries=3):\n    """Read settings."""\n    with open(path) as handle:\n        data = handle.read()\n    if not data:\n        raise ValueError(path)\n    return data\n'
GEN = "import struct\n\n" + "\n".join(f"class Msg{i:04d}(object):\n    __slots__ = ('a_{i}', 'b')\n    _serial = {1000 + i}" for i in range(20)) + "\n"


def test_paths():
    assert path_origin("web/node_modules/x/a.js") == path_origin("a/_vendor/b/c.py") == "vendored" and path_origin("ui/package-lock.json") == "lock"
    assert path_origin("src/vendor_portal.py") is None and path_origin("app/min_size.py") is None and path_origin("") is None


def test_headers():
    assert header_origin("a.py", "o/r", "# Code generated by foogen v1.8. DO NOT EDIT.\nx = 1\n") == "generated"
    assert header_origin("a.xml", "o/r", "<!-- Dieses Modul wurde automatisch erzeugt (gen). -->\n<a/>") == "generated"
    assert header_origin("a.py", "o/r", "# Taken unchanged from abcutils 2.1 (src/x.py).\nimport os\n") == "vendored"
    assert header_origin("a.py", "o/r", "# This file is part of abcutils.\nimport os\n") == "vendored"
    assert header_origin("src/abcutils/a.py", "o/r", "# This file is part of abcutils.\nimport os\n") is None
    assert header_origin("a.py", "o/abcutils", "# Copyright (c) 2020 the abcutils authors.\nimport os\n") is None
    assert header_origin("a.py", "o/r", '"""Review files marked DO NOT EDIT."""\nBANNERS = ["@generated"]\n') is None
    assert header_origin("a.py", "o/r", "import os\n# generated by hand later\n") is None


def test_marks_below_long_headers_and_at_the_end():
    licence = "# Licensed under the terms below.\n" * 14
    assert header_origin("a.py", "o/r", licence + "#\n# Code generated by foogen v1.8. DO NOT EDIT.\nx = 1\n") == "generated"
    assert header_origin("a.xml", "o/r", '<?xml version="1.0"?>\n<!-- Code generated by foogen. -->\n<a/>') == "generated"
    assert header_origin("a.c", "o/r", "/*\n   Some words.\n\n   Code generated by foogen.\n*/\nint x;\n") == "generated"
    assert header_origin("a.html", "o/r", "<!--\nTaken unchanged from abcutils 2.1.\n-->\n<a/>") == "vendored"
    assert header_origin("a.yaml", "o/r", "a: 1\n" * 30 + "# Code generated by foogen. DO NOT EDIT.\n\n") == "generated"
    assert header_origin("a.css", "o/r", "a { b: c }\n" * 30 + "/*\n  Taken unchanged\n  from abcutils.\n\n  Taken unchanged from abcutils 2.1\n*/\n") == "vendored"
    assert header_origin("a.c", "o/r", "int x;\nint y; /* the tool's file is\n generated by foogen */\n") is None
    assert header_origin("a.c", "o/r", "/* a */\nint x = 1;\n// code generated by foogen\nint y;\n") is None
    assert header_origin("a.py", "o/r", "") is None and header_origin("a.c", "o/r", "/*\n" * 5) is None and header_origin("a.c", "o/r", "x\n*/") is None


def test_composition():
    r = random.Random(1)
    blob = 'DATA = (\n' + "\n".join('    "' + "".join(r.choice("abcdefgXYZ0123456789+/") for _ in range(76)) + '"' for _ in range(12)) + "\n)\n"
    table = "TABLE = [\n" + "\n".join("    " + " ".join(f"0x{r.randrange(256):02x}," for _ in range(14)) for _ in range(12)) + "\n]\n"
    mini = "".join(f"function {a}(b){{return b&&b.x||{i}}}if(Y>{a}){{Y={a}}}else {a}++;" for i, a in enumerate("abcdefghij"))
    prompts = 'PROMPTS = [' + ", ".join('"one two three four five"' for _ in range(20)) + "]\n" + HAND
    lock = '{\n  "lockfileVersion": 3,\n  "packages": {\n' + ",\n".join(f'    "node_modules/p{i}": {{\n      "version": "1.{i}.0",\n      "integrity": "sha512-abc{i}"\n    }}' for i in range(6)) + "\n  }\n}\n"
    assert composition_origin("a.py", blob) == composition_origin("a.py", table) == "data" and composition_origin("a.js", mini) == "minified"
    assert composition_origin("a.py", GEN) == "generated" and composition_origin("x.json", lock) == "lock"
    assert composition_origin("a.py", HAND) is None and composition_origin("a.py", prompts) is None and composition_origin("a.py", "") is None
    assert composition_origin("c.json", '{\n' + ",\n".join(f'  "k{i:04d}": "v"' for i in range(40)) + "\n}") is None


def _lines(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(4, 8)))
    return [f"{word()} = {word()}.{word()}({word()})" for _ in range(n)]


S = "file_id long, repository_id long, repository string, rel_path string, text string, origin string"


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_edited_copies_are_found(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(provenance, "BROADCAST_BYTES", limit)
    lib = _lines(0, 40)
    common = ["import logging as log_module", "logger = log_module.getLogger(__name__)"]
    text = lambda ls: "\n".join(common + ls) + "\n"
    data = [(1, 1, "a/a", "vendor/lib/x.py", text(lib), None), (2, 2, "b/b", "src/x.py", text(lib[:30] + _lines(1, 8)), None), (3, 3, "c/c", "src/y.py", text(_lines(2, 40)), None), (4, 3, "c/c", "src/z.py", text(_lines(3, 30) + lib[:6]), None)]
    data += [(10 + i, 10 + i, f"r/{i}", "app/copy.py", text(lib), None) for i in range(5)] + [(30, 30, "s/s", "own.py", text(_lines(4, 30)), None), (31, 31, "t/t", "theirs.py", text(_lines(4, 30)), None)]
    data += [(60 + i, 60 + i, "f/f", "fill.py", text(_lines(60 + i, 20)), None) for i in range(12)]
    data += [(50, None, None, None, None, None), (None, 1, "a/a", "q.py", "x", None), (3, 3, "c/c", "src/y.py", text(_lines(2, 40)), None), (51, 1, "a/a", "e.py", "", None), (52, 1, "a/a", "gen.py", GEN, None)]
    df = spark.createDataFrame(data, S)
    got = rows(file_origins(df))
    want = [(1, "vendored", "path"), (2, "vendored", "containment"), (31, "vendored", "containment"), (52, "generated", "composition")] + [(10 + i, "vendored", "containment") for i in range(5)]
    assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))
    assert file_origins(df.limit(0)).count() == 0


def test_containment_against_brute_force(spark):
    r = random.Random(9)
    base = [_lines(i, 20) for i in range(4)]
    files = [(i, i % 7, r.sample(base[i % 4], r.randint(5, 20)) + _lines(100 + i, r.randint(0, 9))) for i in range(40)]
    df = spark.createDataFrame([(i, g, "\n".join(ls)) for i, g, ls in files], "file long, repo long, text string")
    got = {x.file: (x.partner, x.shared) for x in copies_elsewhere(line_hashes(df)).collect()}
    sets = {i: set(ls) for i, _, ls in files}
    for f, (p, n) in got.items():
        assert len(sets[f] & sets[p]) == n and f % 7 != p % 7 and n >= 0.6 * len(sets[f])


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_every_holder_is_counted(spark, monkeypatch, limit):
    monkeypatch.setattr(provenance, "BROADCAST_BYTES", limit)
    r = random.Random(3)
    base = [_lines(i, 24) for i in range(3)]
    files = [(i, r.randrange(9), None if r.random() < 0.7 else r.choice(["vendored", "generated"]), r.sample(base[i % 3], r.randint(6, 24)) + _lines(200 + i, r.randint(0, 6))) for i in range(80)]
    files += [(100 + i, i, None, files[i][3]) for i in range(12)]
    hashed = line_hashes(spark.createDataFrame([(i, g, "\n".join(ls)) for i, g, _, ls in files], "file long, repo long, text string"))
    got = {(x.file, x.origin, x.partner, x.shared) for x in copies_elsewhere(hashed.join(spark.createDataFrame([(i, o) for i, _, o, _ in files], "file long, origin string"), "file")).collect()}
    want = set()
    for f, g, o, ls in files:
        held = [(g2, f2, o2, len({*ls} & {*l2})) for f2, g2, o2, l2 in files if o is None and f2 != f and len({*ls} & {*l2}) >= 0.6 * len({*ls})]
        for kind in (None, "vendored", "generated"):
            of = [h for h in held if h[2] == kind] + ([(g, f, o, 0)] if kind is None and o is None else [])
            want |= {(f, kind, h[1], h[3]) for h in (min(of), max(of)) if h[0] != g} if of else set()
    # The first and last holders of a repository may be several files.
    by = lambda rows: {(f, o, {i: g for i, g, _, _ in files}[p]) for f, o, p, _ in rows}
    assert by(got) == by(want) and all(n == len({*dict((i, ls) for i, _, _, ls in files)[f]} & {*dict((i, ls) for i, _, _, ls in files)[p]}) for f, _, p, n in got)


def test_copies_over_many_smaller_repositories(spark, rows):
    lib = _lines(0, 40)
    fill = [(60 + i, 60 + i, "f/f", "fill.py", "\n".join(_lines(60 + i, 20)), None) for i in range(12)]
    parts = [(1 + i, 1 + i, f"p/{i}", "part.py", "\n".join(lib[5 * i : 5 * i + 5] + _lines(20 + i, 30)), None) for i in range(8)]
    spread = [*parts, (20, 20, "a/a", "whole.py", "\n".join(lib), None), (21, 21, "b/b", "copy.py", "\n".join(lib[:38] + _lines(50, 3)), None)]
    assert (21, "vendored", "containment") in rows(file_origins(spark.createDataFrame(spread + fill, S)))
    between = [(1, 1, "a/a", "copy.py", "\n".join(lib), None), (2, 2, "b/b", "vendor/lib.py", "\n".join(lib), None), (3, 3, "c/c", "copy.py", "\n".join(lib), None)]
    assert rows(file_origins(spark.createDataFrame(between + fill, S))) == [(1, "vendored", "containment"), (2, "vendored", "path"), (3, "vendored", "containment")]


def test_tokens():
    made = provenance.Composition("x = [1, 2, 3, 4, 5, 6, 7, 8]  # a1234\n\ny = 'a b' + name0123\n", "hash")
    assert made.lines == 2 and made.numbered == 1 and made.literal == 22 and made.dense == 0
    assert provenance.Composition("/* a1234\n b1234 */ int x;\n// c1234", "slash").numbered == 0
    cut = "TABLE = [\n" + "    0x1f, 0x2e,\n" * 20 + "    0x"
    assert composition_origin("a.py", cut) == "data"
    assert header_origin("a.py", "o/r", "# This file " + "really " * 40 + "was produced with foogen\nx = 1\n") == "generated"


def test_hot_holder_and_boilerplate(spark, rows, monkeypatch):
    """A third of all files hold one library; another third share a licence text."""
    lib, licence = _lines(0, 30), _lines(1, 12)
    data = [(1, 1, "a/a", "vendor/x.py", "\n".join(lib), None)]
    data += [(100 + i, 2 + i, "b/b", "x.py", "\n".join(lib[: 24 + i % 6] + _lines(500 + i, 4)), None) for i in range(60)]
    data += [(300 + i, 2 + i, "c/c", "y.py", "\n".join(licence + _lines(900 + i, 5)), None) for i in range(60)]
    data += [(500 + i, 2 + i, "d/d", "z.py", "\n".join(_lines(2000 + i, 12)), None) for i in range(60)]
    want = {100 + i for i in range(60)} | {1}
    df = spark.createDataFrame(data, S)
    for limit in (32 << 20, -1):
        monkeypatch.setattr(provenance, "BROADCAST_BYTES", limit)
        hashed = line_hashes(df.selectExpr("file_id AS file", "repository_id AS repo", "text"))
        found = {r.file for r in copies_elsewhere(hashed, rare_files=61).collect()}
        assert want - {1} <= found
        bound = {r.file for r in copies_elsewhere(hashed, rare_files=59).collect()}
        assert not bound & {300 + i for i in range(60)}
    assert want <= {r.file_id for r in file_origins(df).collect()}


def test_hand_written_texts_are_not_lexed(monkeypatch):
    def refuse(*_):
        raise AssertionError("lexed")

    monkeypatch.setattr(provenance, "Composition", refuse)
    long_doc = 'def f(a):\n    """Add up.\n\n    Item a1234 has 1 2 3 4 5 6 7 8 parts.\n    """\n    return a\n'
    for text in (HAND * 3, HAND + long_doc, HAND + "KEY = 'aB3+" + "q" * 40 + "'\n", HAND + f"x = [{', '.join('abcdefghij')}]  # {'long ' * 50}\n" + HAND * 4, HAND + "model0412 = 1\n", ""):
        assert composition_origin("a.py", text) is None
    assert composition_origin("a.js", "/**\n * Use `this`.\n */\nfunction f(a) {\n  return a;\n}\n") is None and composition_origin("a.html", "<p>\n<!-- one\n two -->\n</p>\n") is None


@pytest.mark.parametrize("text", ["/*\n" * 60_000 + "*/ x", "/*/\n" * 50_000, "<!--\n" * 40_000 + "--> x", '"""\n' * 50_000])
def test_time_of_comments_over_lines(text):
    for name in ("a.js", "a.html", "a.py"):
        began = time.process_time()
        composition_origin(name, text)
        assert time.process_time() - began < 20


@pytest.mark.parametrize("seed", range(3))
def test_bounds_rule_out_nothing_that_tokens_show(monkeypatch, seed):
    parts = ["0x1f, ", "12 ", "1.5 + ", "-3,", "7\n", "1e-5 ", "a123 ", "name0123 = 1\n", "x²12\n", "٣٤٥ ", "0x1٣,", "1 2 3 4 5 6 7 ", '"""', "'''", '"', "'", "`", "/*", "*/", "//", "#", "--", "<!--", "-->", "\\", "\\\n", "\n", "    ", "\r\n", "\x1c"]
    parts += ["return x\n", '    """Go over\n lines 12 a123\n"""  \n', "\n/* one\n * `two` */\n", " <!-- a\n b -->\n", "'" + "aB3+" * 9 + "'", '"' + "q1/_" * 12 + '=="', "'" + "\\x1f" * 9 + "'", "if(a){b();}else{c?d:e}" * 9, "x=1;" * 60]
    r = random.Random(seed)
    texts = []
    for _ in range(3000):
        few = r.sample(parts, r.choice((2, 3, 5)))
        path = r.choice(("a/", "generated/")) + "f." + r.choice(("py", "js", "sql", "html", "min.js", "pb.go", "x"))
        texts.append((path, "".join(r.choice(few if r.random() < 0.9 else parts) for _ in range(r.randint(1, 40)))))
    bound = [composition_origin(*t) for t in texts]
    monkeypatch.setattr(provenance, "_hand_written", lambda *_: False)
    assert bound == [composition_origin(*t) for t in texts] and {*bound} == {None, "data", "minified", "generated"}
