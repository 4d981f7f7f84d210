from tessera.operators.value_flow import file_facts, syntax_facts, trace_literals

FILES = [
    (1, "p", "pkg/consts.py", 'NAME = "acme/big-1"\n\ndef pick(kind="acme/small-2"):\n    return kind\n'),
    (2, "p", "app.py", "from pkg.consts import NAME, pick\n\nclient.create(model=NAME)\nother(model=pick())\n"),
    (3, "p", "local.py", 'import x\n\ndef run(m):\n    return x.ask(model=m)\n\nrun("big-1")\ncfg = {"model": "acme/big-1"}\nsend(**cfg)\nunused = "acme/big-1"\nself_model = "acme/big-1" if a else None\ncall(model_name=self_model)\n'),
    (4, "p", "broken.py", "def (:\n"),
    (5, "q", "app.py", "from pkg.consts import NAME\nclient.create(model=NAME)\n"),
    (6, "p", "klass.py", 'class A:\n    def __init__(self):\n        self.m = "acme/big-1"\n    def go(self):\n        return ask(model=self.m)\n'),
]


def test_traces(spark, rows):
    files = spark.createDataFrame([*FILES, (None, "p", "z.py", "x"), (7, "p", None, None)], "file_id long, project string, rel_path string, text string")
    ids = spark.createDataFrame([("acme/big-1",), ("acme/small-2",)], "model_id string")
    got = rows(trace_literals(files, ids), "file_id", "line", "literal", "sink_file", "sink_line", "locality")
    assert got == [
        (1, 1, "acme/big-1", 2, 3, "non_local"),
        (1, 3, "acme/small-2", 2, 4, "non_local"),
        (3, 10, "acme/big-1", 3, 11, "local"),
        (3, 6, "big-1", 3, 4, "local"),
        (3, 7, "acme/big-1", 3, 8, "local"),
        (6, 3, "acme/big-1", 6, 5, "local"),
    ]


PACKAGE = [
    (1, "p", "src/pkg/config.py", 'NAME = "acme/big-1"\n\ndef load(m):\n    return ask(model=m)\n\nclass Box:\n    def __init__(self, m):\n        ask(model=m)\n'),
    (2, "p", "src/pkg/__init__.py", "from .config import NAME as TOP, load\nfrom . import sub\nfrom .ring import around\n"),
    (3, "p", "src/pkg/sub/__init__.py", "from ..config import *\n"),
    (4, "p", "src/pkg/sub/deep.py", "from ..config import NAME\nask(model=NAME)\n"),
    (5, "p", "a.py", "import pkg.config\nask(model=pkg.config.NAME)\n"),
    (6, "p", "b.py", "from pkg import config\nask(model=config.NAME)\n"),
    (7, "p", "c.py", 'from pkg import load, TOP\nload("acme/small-2")\nask(model=TOP)\n'),
    (8, "p", "d.py", 'import pkg as k\nk.load("acme/small-2")\nask(model=k.sub.NAME)\nk.config.Box("acme/small-2")\n'),
    (9, "p", "src/pkg/ring.py", "from . import around\naround(NAME)\n"),
    (10, "p", "e.py", 'from .... import above\nfrom pkg.sub import load\nload("acme/small-2")\n'),
]


def test_packages(spark, rows):
    files = spark.createDataFrame(PACKAGE, "file_id long, project string, rel_path string, text string")
    ids = spark.createDataFrame([("acme/big-1",), ("acme/small-2",)], "model_id string")
    got = rows(trace_literals(files, ids), "file_id", "line", "sink_file", "sink_line")
    assert got == sorted([(1, 1, 4, 2), (1, 1, 5, 2), (1, 1, 6, 2), (1, 1, 7, 3), (1, 1, 8, 3), (7, 2, 1, 4), (8, 2, 1, 4), (8, 4, 1, 8), (8, 4, 8, 4), (10, 3, 1, 4)], key=lambda t: tuple((x is None, str(x)) for x in t))


def test_facts(spark):
    kinds = [r[1:4] for r in file_facts(1, 'import os as o\nclass A(B):\n    pass\ndef f(a, b):\n    return g(a, k=1)\nx = "s"\n')]
    assert ("import", "os", "o") in kinds and ("definition", "A", "B") in kinds and ("definition", "f", "a,b") in kinds
    assert ("call", "g", "k") in kinds and ("assignment", "x", "Constant") in kinds and ("string", "s", "4") in kinds
    assert file_facts(1, "def (:")[0][3] == "SyntaxError" and len(file_facts(1, "")) == 1
    files = spark.createDataFrame([(1, "x = 1\n"), (None, "y"), (2, None)], "file_id long, text string")
    assert syntax_facts(files).where("kind = 'file'").count() == 1


FLOWS = [
    (1, "p", "pos.py", 'm = AutoModel.from_pretrained("acme/big-1")\n'),
    (2, "p", "loop.py", 'for name in ["acme/big-1", "other"]:\n    ask(llm=name)\n'),
    (3, "p", "get.py", 'cfg = {"model": "acme/big-1", "x": 1}\nask(deployment=cfg.get("model"))\nask(engine=cfg["model"].strip())\n'),
    (4, "p", "cls.py", 'class Base:\n    NAME = "acme/big-1"\n\nclass Sub(Base):\n    def go(self):\n        return ask(model=self.NAME)\n'),
    (5, "p", "env.py", 'import os\nNAME = os.getenv("M", "acme/big-1")\nask(chat_model=NAME)\n'),
    (6, "p", "pay.py", 'body = {}\nbody["model"] = "acme/big-1"\npost("/v1", json=body)\n'),
    (7, "p", "ret.py", 'def make():\n    return {"model": "acme/big-1"}\n\nextra = make()\nask(**extra)\n'),
    (8, "p", "obj.py", 'class Client:\n    def __init__(self, m):\n        self.m = m\n    @property\n    def name(self):\n        return self.m\n    def run(self):\n        return ask(model=self.name)\n\nc = Client("acme/big-1")\n'),
    (9, "p", "list.py", 'rows = []\nrows.append({"model": "acme/big-1"})\nfor r in rows:\n    send(json=r)\n'),
    (10, "p", "near.py", 'def outer():\n    name = "acme/big-1"\n    def inner():\n        return ask(model=name)\n    return inner\n'),
    (11, "p", "no.py", 'print("acme/big-1")\nx = {"other": "acme/big-1"}\nsend(json=x)\nassert y != "acme/big-1"\n'),
    (12, "p", "far.py", "from cls import Base\nask(model=Base.NAME)\n"),
    (13, "p", "farpay.py", "from ret import make\npost(json=make())\n"),
]
WANT = [(1, 1, 1, 1), (2, 1, 2, 2), (3, 1, 3, 2), (3, 1, 3, 3), (4, 2, 4, 6), (5, 2, 5, 3), (6, 2, 6, 3), (7, 2, 7, 5), (8, 10, 8, 8), (8, 10, 8, 10), (9, 2, 9, 4), (10, 2, 10, 4), (4, 2, 12, 2), (7, 2, 13, 2)]


def test_kinds_of_flow(spark, rows):
    from tessera.operators.value_flow import trace_paths

    files = spark.createDataFrame(FLOWS, "file_id long, project string, rel_path string, text string")
    ids = spark.createDataFrame([("acme/big-1",)], "model_id string")
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert rows(trace_literals(files, ids), "file_id", "line", "sink_file", "sink_line") == sorted(WANT, key=key)
    paths = trace_paths(files, ids)
    assert rows(paths, "file_id", "line", "sink_file", "sink_line") == sorted(WANT, key=key)
    got = {(r.file_id, r.sink_file, r.sink_line): r for r in paths.collect()}
    assert got[3, 3, 2].kinds == ["mapping_literal_item", "mapping_get_literal_key_value", "loader_model_sink"] and not got[3, 3, 2].interfile
    assert got[4, 12, 2].interfile and got[4, 12, 2].locality == "non_local" and got[7, 7, 5].interprocedural
    assert all(len(r.steps) == len(r.kinds) + 1 for r in got.values()) and sorted(r.trace_id for r in got.values()) == [f"trace_{i:05d}" for i in range(1, len(WANT) + 1)]
    first = trace_paths(files, ids, mode="shortest").collect()
    assert len(first) == len({w[:2] for w in WANT}) and {(r.file_id, r.sink_file, r.sink_line) for r in first if r.file_id in (3, 8)} == {(3, 3, 2), (8, 8, 10)}
    assert trace_paths(files.limit(0), ids).count() == 0 == trace_literals(files, ids.limit(0)).count()


def test_candidates_by_origin(spark, rows):
    from tessera.operators.value_flow import call_origins, loader_candidates

    files = spark.createDataFrame([
        (1, "import acme_sdk as a\nfrom other.x import Thing\nclient = a.Client()\nsession = client.session\nsession.chat.create(model=m)\nThing('m')\nclient.close()\nfree(model=m)\n"),
        (2, "from acme_sdk import Client, load_model\nc = Client('m-1')\nload_model('x')\nc.ask(llm='x', n=1)\n"),
        (3, "from . import acme_sdk\nacme_sdk.Client('x')\n"),
    ], "file_id long, text string")
    facts = syntax_facts(files)
    known = rows(call_origins(facts))
    assert (1, "session", "acme_sdk") in known and (2, "c", "acme_sdk.Client") in known and not [k for k in known if k[0] == 3]
    rules = spark.createDataFrame([("acme_sdk",), ("acme_sdk",), (None,)], "import_origin string")
    got = rows(loader_candidates(facts, rules), "candidate_id", "file_id", "line", "chain", "origin", "binds")
    assert got == [
        ("loader_candidate_00001", 1, 5, "session.chat.create", "acme_sdk", "keyword"),
        ("loader_candidate_00002", 2, 2, "Client", "acme_sdk.Client", "positional"),
        ("loader_candidate_00003", 2, 3, "load_model", "acme_sdk.load_model", "positional"),
        ("loader_candidate_00004", 2, 4, "c.ask", "acme_sdk.Client", "keyword"),
    ]
