"""Syntax facts of Python sources, and tracing of literals to the calls that use them.

Each file is parsed once inside its task and gives flat rows; everything that
joins files (imports, calls of functions elsewhere, reachability) is done by
Spark over those rows.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import module_name
from tessera.operators.graph import paths_per_source, spread_sets
from tessera.operators.ranges import longest_prefix
from tessera.operators.sequence import with_ordinal
from tessera.sources.tables import cut_lineage, spread

# Names of arguments that take a model identifier.
MODEL_ARGS = {"model", "model_name", "model_id", "deployment", "deployment_id", "deployment_name", "engine", "llm", "chat_model", "embedding_model", "small_model"}
# Keys of mappings that hold a model identifier.
MODEL_KEYS = {"model", "model_name", "model_id", "deployment", "deployment_name", "engine", "embedding_model", "small_model"}
# Names of arguments that take a mapping with a model in it.
PAYLOAD_ARGS = {"body", "data", "json", "config", "configs", "configuration", "settings", "options", "params", "parameters", "kwargs"}
# Methods that give back their text.
PRESERVING = {"casefold", "copy", "decode", "encode", "lower", "strip", "upper"}
# Callees whose first argument is a model, besides capitalised ones and *_model.
SELECTORS = {"get_model", "load_model", "from_pretrained"}
# The names of edges below are fixed values as well.
FACTS = "file_id long, kind string, name string, detail string, line int, extra string"
FLOWS = "file_id long, kind string, src string, dst string, edge_type string, line int, name string, module string"


def dotted_name(node: ast.AST) -> str | None:
    """``a.b.c`` of names, attributes and calls; None for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = dotted_name(node.value)
        return f"{base}.{node.attr}" if base else None
    if isinstance(node, ast.Call):
        return dotted_name(node.func)
    return None


def _parse(text: str) -> tuple[ast.Module | None, str | None]:
    try:
        return ast.parse(text), None
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return None, type(e).__name__


def file_facts(file_id: int, text: str) -> list[tuple]:
    """(file_id, kind, name, detail, line, extra) rows of one file."""
    tree, error = _parse(text)
    rows = [(file_id, "file", hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), error, len(text.splitlines()), None)]
    if tree is None:
        return rows
    for node in ast.walk(tree):
        line = getattr(node, "lineno", 0)
        if isinstance(node, ast.Import):
            rows += [(file_id, "import", a.name, a.asname, line, "import") for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            rows += [(file_id, "import", "." * node.level + (node.module or ""), a.asname or a.name, line, a.name) for a in node.names]
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]]
            rows.append((file_id, "definition", node.name, ",".join(args), line, "function"))
        elif isinstance(node, ast.ClassDef):
            rows.append((file_id, "definition", node.name, ",".join(filter(None, map(dotted_name, node.bases))), line, "class"))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if name := dotted_name(t):
                    rows.append((file_id, "assignment", name, type(node.value).__name__ if node.value else None, line, dotted_name(node.value) if node.value else None))
        elif isinstance(node, ast.Call):
            if chain := dotted_name(node.func):
                rows.append((file_id, "call", chain, ",".join(k.arg for k in node.keywords if k.arg), line, str(len(node.args))))
        elif isinstance(node, ast.Return) and node.value is not None:
            rows.append((file_id, "return", type(node.value).__name__, None, line, None))
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            rows.append((file_id, "string", node.value, str(node.col_offset), line, None))
    return rows


def syntax_facts(files: DataFrame) -> DataFrame:
    """Facts of ``files(file_id, text)``; see FACTS for the columns.

    A file that does not parse gives its ``file`` row with the error; null texts
    and ids give nothing.  Repeated files repeat their facts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for i, t in zip(b["file_id"], b["text"]) for r in file_facts(i, t)]
            yield pd.DataFrame(rows, columns=["file_id", "kind", "name", "detail", "line", "extra"])

    return files.select("file_id", "text").where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, FACTS)


class _Flow(ast.NodeVisitor):
    """Value-flow rows of one file.

    Nodes are texts of a kind and a place: values (``var``, ``field``, ``item``,
    ``attr``, ``call``, ``ret``, ``lit``) and, with ``pay:`` before them, the models
    inside a mapping or collection that stands there.
    """

    def __init__(self, file_id: int):
        self.f = file_id
        self.scope: list[str] = []
        self.owner: list[str] = []
        self.locals: list[set[str]] = [set()]
        self.functions: dict[str, list[str]] = {}
        self.classes: dict[str, list[str]] = {}
        self.types: dict[str, str] = {}
        self.bound: dict[ast.AST, set[str]] = {}
        self.imported: set[str] = set()
        self.rows: list[tuple] = []

    def emit(self, kind, src, dst, edge, line, name=None, module=None):
        self.rows.append((self.f, kind, src, dst, edge, line, name, module))

    def var(self, name: str) -> str:
        """The variable that a name stands for, from the innermost scope outwards."""
        depth = next((k for k in range(len(self.locals) - 1, 0, -1) if name in self.locals[k]), 0)
        return f"var|{self.f}|{'.'.join(self.scope[:depth])}|{name}"

    def outer(self, chain: str) -> bool:
        """Whether a dotted name may stand for something imported."""
        return "*" in self.imported or chain.split(".")[0] in self.imported

    def fields(self, owner: str, name: str) -> list[str]:
        """A field of a class, and of those it is derived from."""
        out, todo = [], [owner]
        while todo:
            c = todo.pop(0)
            if c not in out:
                out.append(c)
                todo += self.classes.get(c, [])
        return [f"field|{self.f}|{c}|{name}" for c in out]

    def class_of(self, e: ast.AST) -> str | None:
        """The class of this file whose object or name an expression is."""
        if isinstance(e, ast.Name):
            if e.id in ("self", "cls") and self.owner:
                return self.owner[-1]
            return self.types.get(self.var(e.id)) or (e.id if e.id in self.classes else None)
        if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id in self.classes:
            return e.func.id
        return None

    def values(self, e: ast.AST | None) -> list[str]:
        """Nodes whose value may become the value of an expression."""
        if isinstance(e, ast.Constant):
            if not isinstance(e.value, str) or not e.value:
                return []
            node = f"lit|{self.f}|{e.lineno}|{e.col_offset}"
            self.emit("literal", node, None, None, e.lineno, e.value)
            return [node]
        if isinstance(e, ast.Name):
            return [self.var(e.id)]
        if isinstance(e, ast.Attribute):
            if owner := self.class_of(e.value):
                return self.fields(owner, e.attr)
            name = dotted_name(e)
            if name and self.outer(name):
                self.emit("attribute", f"attr|{self.f}|{name}", None, None, e.lineno, name)
            return [f"attr|{self.f}|{name}"] if name else []
        if isinstance(e, ast.Subscript):
            base = self.place(e.value)
            key = e.slice.value if isinstance(e.slice, ast.Constant) and isinstance(e.slice.value, str) else "*"
            return [f"item|{base}|{key}"] if base else []
        if isinstance(e, ast.Call):
            return [f"call|{self.f}|{e.lineno}|{e.col_offset}"]
        if isinstance(e, ast.IfExp):
            return self.values(e.body) + self.values(e.orelse)
        if isinstance(e, ast.BoolOp):
            return [v for x in e.values for v in self.values(x)]
        if isinstance(e, ast.JoinedStr):
            return [v for x in e.values if isinstance(x, ast.FormattedValue) for v in self.values(x.value)]
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
            return self.values(e.left) + self.values(e.right)
        if isinstance(e, (ast.Await, ast.NamedExpr)):
            return self.values(e.value)
        return []

    def place(self, e: ast.AST) -> str | None:
        """The one node of a name, field or attribute that may hold a mapping."""
        nodes = self.values(e) if isinstance(e, (ast.Name, ast.Attribute, ast.Subscript)) else []
        return nodes[0] if nodes else None

    def payloads(self, e: ast.AST | None) -> list[str]:
        """Nodes of the models inside the mapping or collection that an expression is."""
        if isinstance(e, ast.Dict):
            held = [v for k, x in zip(e.keys, e.values) if isinstance(k, ast.Constant) and k.value in MODEL_KEYS for v in self.values(x)]
            return held + [v for k, x in zip(e.keys, e.values) if k is None or isinstance(x, (ast.Dict, ast.List, ast.Tuple)) for v in self.payloads(x)]
        if isinstance(e, (ast.List, ast.Tuple, ast.Set)):
            return [v for x in e.elts for v in self.payloads(x)]
        if isinstance(e, ast.Call):
            chain = dotted_name(e.func) or ""
            if chain == "dict":
                return [v for k in e.keywords for v in (self.values(k.value) if k.arg in MODEL_KEYS else self.payloads(k.value) if k.arg is None else [])]
            if chain.endswith("json.dumps") or chain == "dumps":
                return [v for x in e.args[:1] for v in self.payloads(x)]
            if isinstance(e.func, ast.Attribute) and e.func.attr in ("copy", "items", "values"):
                return self.payloads(e.func.value)
            return [f"pay:call|{self.f}|{e.lineno}|{e.col_offset}"]
        if isinstance(e, (ast.Name, ast.Attribute, ast.Subscript)):
            return [f"pay:{v}" for v in self.values(e)]
        if isinstance(e, ast.IfExp):
            return self.payloads(e.body) + self.payloads(e.orelse)
        if isinstance(e, ast.BoolOp):
            return [v for x in e.values for v in self.payloads(x)]
        return self.payloads(e.value) if isinstance(e, (ast.Await, ast.NamedExpr)) else []

    def flow(self, e: ast.AST | None, dst: str, edge: str, line: int):
        for v in self.values(e):
            self.emit("edge", v, dst, edge, line)

    def carry(self, e: ast.AST | None, dst: str, edge: str, line: int):
        """What is inside ``e`` goes inside what stands at ``dst``."""
        for v in self.payloads(e):
            self.emit("edge", v, f"pay:{dst}", edge, line)

    def entries(self, e: ast.AST | None, base: str, line: int):
        """Entries of a dict display or dict() call under a named mapping."""
        pairs = []
        if isinstance(e, ast.Dict):
            pairs = [(k.value, v) for k, v in zip(e.keys, e.values) if isinstance(k, ast.Constant) and isinstance(k.value, str)]
        elif isinstance(e, ast.Call) and dotted_name(e.func) == "dict":
            pairs = [(k.arg, k.value) for k in e.keywords if k.arg]
        for key, v in pairs:
            self.entry(v, base, key, "mapping_literal_item", line)

    def entry(self, v: ast.AST, base: str, key: str, edge: str, line: int):
        for k in {key, "*"}:  # a read by an unknown key sees all
            self.flow(v, f"item|{base}|{k}", edge, line)
        if key in MODEL_KEYS:
            for x in self.values(v):
                self.emit("edge", x, f"pay:{base}", "mapping_subscript_model_payload" if edge != "mapping_literal_item" else "dict_model_payload", line)
        self.carry(v, base, "mapping_subscript_nested_model_payload", line)

    def assigned(self, node: ast.AST) -> set[str]:
        """Names that a function binds itself; those of functions within it are theirs."""
        if node in self.bound:
            return self.bound[node]
        out, foreign, todo = set(), set(), list(ast.iter_child_nodes(node))
        while todo:
            x = todo.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.add(x.name)
                continue
            if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                out.add(x.id)
            elif isinstance(x, (ast.Global, ast.Nonlocal)):
                foreign |= set(x.names)
            todo += ast.iter_child_nodes(x)
        self.bound[node] = out - foreign
        return self.bound[node]

    def visit_FunctionDef(self, node):
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        names = [a.arg for a in args]
        defaults = dict(zip([a.arg for a in [*node.args.posonlyargs, *node.args.args]][::-1], node.args.defaults[::-1]))
        defaults |= {a.arg: d for a, d in zip(node.args.kwonlyargs, node.args.kw_defaults) if d is not None}
        assigned = self.assigned(node)
        symbol = ".".join([*self.scope, node.name])
        plain = [n for n in names if n not in ("self", "cls")]
        self.functions[symbol] = plain
        self.emit("definition", f"ret|{self.f}|{symbol}", None, None, node.lineno, symbol, ",".join(plain))
        for name, d in defaults.items():
            self.flow(d, f"var|{self.f}|{symbol}|{name}", "function_default", node.lineno)
            self.carry(d, f"var|{self.f}|{symbol}|{name}", "function_default_payload", node.lineno)
        if self.owner and any(dotted_name(d) in ("property", "cached_property", "functools.cached_property") for d in node.decorator_list):
            for p, edge in (("", "same_class_property_value"), ("pay:", "same_class_property_payload")):
                self.emit("edge", f"{p}ret|{self.f}|{symbol}", f"{p}field|{self.f}|{self.owner[-1]}|{node.name}", edge, node.lineno)
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(node.name)
        self.locals.append({*names, *assigned, *(x.arg for x in (node.args.vararg, node.args.kwarg) if x)})
        for x in node.body:
            self.visit(x)
        self.locals.pop()
        self.scope.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self.classes[node.name] = [b.id for b in node.bases if isinstance(b, ast.Name)]
        self.owner.append(node.name)
        self.scope.append(node.name)
        self.locals.append(set())
        for x in node.body:
            targets = x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) and x.value is not None else []
            for t in targets:
                if isinstance(t, ast.Name):
                    self.store(f"field|{self.f}|{node.name}|{t.id}", x.value, "class_attribute_reference", x.lineno)
            self.visit(x.value if targets else x)
        self.locals.pop()
        self.scope.pop()
        self.owner.pop()

    def visit_Assign(self, node):
        self.assign(node.targets, node.value, node.lineno)

    def visit_AnnAssign(self, node):
        self.assign([node.target], node.value, node.lineno)

    def visit_NamedExpr(self, node):
        self.assign([node.target], node.value, node.lineno)

    def visit_AugAssign(self, node):
        for dst in self.values(node.target)[:1]:
            self.carry(node.value, dst, "payload_assignment", node.lineno)
        self.visit(node.value)

    def store(self, dst: str, v: ast.AST | None, edge: str, line: int):
        """A value, what is inside it, and its entries go to one node."""
        self.flow(v, dst, edge, line)
        self.carry(v, dst, "payload_assignment", line)
        self.entries(v, dst, line)

    def assign(self, targets, value, line):
        for t in targets:
            pairs = zip(t.elts, value.elts) if isinstance(t, ast.Tuple) and isinstance(value, ast.Tuple) and len(t.elts) == len(value.elts) else [(t, value)]
            for target, v in pairs:
                if isinstance(target, ast.Subscript):
                    base = self.place(target.value)
                    key = target.slice.value if isinstance(target.slice, ast.Constant) and isinstance(target.slice.value, str) else "*"
                    if base and v is not None:
                        self.entry(v, base, key, "mapping_subscript_model_item", line)
                    continue
                for dst in self.values(target)[:1]:
                    self.store(dst, v, "assignment", line)
                    if isinstance(target, ast.Name) and isinstance(v, ast.Call) and (made := self.class_of(v)):
                        self.types[self.var(target.id)] = made
        if value is not None:
            self.visit(value)

    def visit_For(self, node):
        targets = node.target.elts if isinstance(node.target, ast.Tuple) else [node.target]
        rows = node.iter.elts if isinstance(node.iter, (ast.List, ast.Tuple, ast.Set)) else []
        for k, t in enumerate(targets):
            for dst in self.values(t)[:1]:
                for row in rows:
                    parts = row.elts if isinstance(row, (ast.List, ast.Tuple)) and len(targets) > 1 else [row]
                    if k < len(parts):
                        self.flow(parts[k], dst, "for_loop_value_unpack", node.lineno)
                        self.carry(parts[k], dst, "for_loop_model_payload_unpack", node.lineno)
                if not rows:
                    self.carry(node.iter, dst, "for_loop_model_payload_unpack", node.lineno)
                    base = self.place(node.iter)
                    if base:
                        self.emit("edge", f"item|{base}|*", dst, "for_loop_value_unpack", node.lineno)
        self.generic_visit(node)

    visit_AsyncFor = visit_For

    def visit_With(self, node):
        for x in node.items:
            for dst in self.values(x.optional_vars)[:1]:
                self.store(dst, x.context_expr, "assignment", node.lineno)
        self.generic_visit(node)

    visit_AsyncWith = visit_With

    def visit_Return(self, node):
        if self.scope:
            symbol = f"ret|{self.f}|{'.'.join(self.scope)}"
            self.flow(node.value, symbol, "return_value", node.lineno)
            self.carry(node.value, symbol, "return_payload", node.lineno)
        self.generic_visit(node)

    def visit_Import(self, node):
        for a in node.names:
            parts = a.name.split(".")
            bound = [(a.asname, a.name)] if a.asname else [(m, m) for m in (".".join(parts[:n]) for n in range(1, len(parts) + 1))]
            for alias, module in bound:
                self.imported.add(alias)
                self.emit("module", None, f"var|{self.f}||{alias}", None, node.lineno, alias, module)

    def visit_ImportFrom(self, node):
        for a in node.names:
            alias = a.asname or a.name
            self.imported.add(alias)
            self.emit("import", None, f"var|{self.f}||{alias}", "project_import_value", node.lineno, a.name, "." * node.level + (node.module or ""))

    def visit_Call(self, node):
        chain, line = dotted_name(node.func), node.lineno
        here = f"call|{self.f}|{line}|{node.col_offset}"
        self.sink(node, chain, line)
        self.reads(node, chain or "", here, line)
        symbol = self.local_symbol(node, chain)
        if symbol:
            params = self.functions[symbol]
            for p, a in [*zip(params, node.args), *[(k.arg, k.value) for k in node.keywords if k.arg in params]]:
                self.flow(a, f"var|{self.f}|{symbol}|{p}", "call_arg_to_param", line)
                self.carry(a, f"var|{self.f}|{symbol}|{p}", "call_arg_to_param_payload", line)
            for k in node.keywords:
                for p in params if k.arg is None else ():
                    if base := self.place(k.value):
                        self.emit("edge", f"item|{base}|{p}", f"var|{self.f}|{symbol}|{p}", "call_kwargs_payload_to_param", line)
            self.emit("edge", f"ret|{self.f}|{symbol}", here, "call_return_value", line)
            self.emit("edge", f"pay:ret|{self.f}|{symbol}", f"pay:{here}", "return_payload_alias", line)
        elif chain and self.outer(chain):
            slots = [*((str(n), a, "call_arg_to_param") for n, a in enumerate(node.args)), *((k.arg, k.value, "call_keyword_to_param") for k in node.keywords if k.arg)]
            for slot, a, edge in slots:
                for v in self.values(a):
                    self.emit("outer_argument", v, slot, edge, line, chain)
                for v in self.payloads(a):
                    self.emit("outer_argument", v, slot, f"{edge}_payload", line, chain)
            self.emit("outer_result", here, None, "call_return_value", line, chain)
        self.generic_visit(node)

    def local_symbol(self, node: ast.Call, chain: str | None) -> str | None:
        """The function of this file that a call runs."""
        tried = []
        if isinstance(node.func, ast.Attribute) and (owner := self.class_of(node.func.value)):
            tried += [f"{n.split('|')[2]}.{node.func.attr}" for n in self.fields(owner, node.func.attr)]
        if chain:
            tried += [".".join([*self.scope[:k], chain]) for k in range(len(self.scope), -1, -1)] + [f"{chain}.__init__"]
        return next((s for s in tried if s in self.functions), None)

    def sink(self, node: ast.Call, chain: str | None, line: int):
        """Arguments by which a call takes a model."""
        at, found = f"sink|{self.f}|{line}|{node.col_offset}", []
        for k in node.keywords:
            if k.arg in MODEL_ARGS:
                found += self.values(k.value) + self.payloads(k.value)
            elif k.arg is None or k.arg in PAYLOAD_ARGS:
                found += self.payloads(k.value)
        last = (chain or "").split(".")[-1]
        selector = last[:1].isupper() or last.lower() in SELECTORS or last.lower().endswith("_model")
        if not found and selector:
            found = [v for a in node.args for v in self.values(a) + self.payloads(a)]
        if last == "dict":  # makes a mapping
            return
        if found:
            self.emit("sink", at, None, None, line, chain)
        for v in found:
            self.emit("edge", v, at, "loader_model_sink", line)

    def reads(self, node: ast.Call, chain: str, here: str, line: int):
        """Calls that give back what they are called on, or a default."""
        name = node.func.attr if isinstance(node.func, ast.Attribute) else chain
        base = self.place(node.func.value) if isinstance(node.func, ast.Attribute) else None
        if name in PRESERVING and isinstance(node.func, ast.Attribute):
            self.flow(node.func.value, here, "value_preserving_method_call", line)
            self.carry(node.func.value, here, "payload_preserving_method_call", line)
        elif name == "getenv" or chain.endswith("environ.get"):
            for d in [*node.args[1:2], *(k.value for k in node.keywords if k.arg == "default")]:
                self.flow(d, here, "env_get_default_value", line)
        elif name in ("get", "pop", "setdefault") and node.args and base:
            key = node.args[0].value if isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str) else "*"
            self.emit("edge", f"item|{base}|{key}", here, "mapping_get_dynamic_key_value" if key == "*" else "mapping_get_literal_key_value", line)
            for d in [*node.args[1:2], *(k.value for k in node.keywords if k.arg == "default")]:
                self.flow(d, here, "mapping_get_default_value", line)
                self.carry(d, here, "mapping_get_default_payload", line)
        elif name == "getattr" and len(node.args) > 1 and isinstance(node.args[1], ast.Constant) and (owner := self.class_of(node.args[0])):
            for v in self.fields(owner, str(node.args[1].value)):
                self.emit("edge", v, here, "scoped_getattr_config_field", line)
        elif name in ("append", "add", "extend", "update") and base:
            for a in node.args:
                self.carry(a, base, f"collection_{name}_model_payload", line)
                self.entries(a, base, line)
                if name in ("append", "add"):
                    self.flow(a, f"item|{base}|*", f"collection_{name}_model_payload", line)
            for k in node.keywords:
                if k.arg and name == "update":
                    self.entry(k.value, base, k.arg, "mapping_subscript_model_item", line)


def flow_rows(file_id: int, text: str) -> list[tuple]:
    """Value-flow rows of one file; none if it does not parse."""
    tree, _ = _parse(text)
    if tree is None:
        return []
    flow = _Flow(file_id)
    for _ in range(2):  # calls may come before the definitions they name
        flow.rows = []
        flow.visit(tree)
    return list(dict.fromkeys(flow.rows))


def value_flows(files: DataFrame) -> DataFrame:
    """Value-flow rows of ``files(file_id, text)``; see FLOWS."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for i, t in zip(b["file_id"], b["text"]) for r in flow_rows(i, t)]
            yield pd.DataFrame(rows, columns=["file_id", "kind", "src", "dst", "edge_type", "line", "name", "module"])

    return files.select("file_id", "text").where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, FLOWS)


def _absolute(own: Column, is_package: Column, module: Column) -> Column:
    """A module named in an import, leading dots resolved; null above the root."""
    dots = F.length(F.regexp_extract(module, r"^([.]*)", 1))
    parts = F.filter(F.split(own, "[.]"), lambda x: x != "")
    kept = F.size(parts) - dots + is_package.cast("int")
    base = F.concat_ws(".", F.slice(parts, F.lit(1), F.greatest(kept, F.lit(0))), F.nullif(F.regexp_replace(module, r"^[.]+", ""), F.lit("")))
    return F.when(dots == 0, module).when(kept >= 0, base)


def _dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *[F.nullif(p, F.lit("")) for p in parts])


def _splits(chain: str) -> Column:
    """Structs ``head, tail`` of a dotted name cut before or behind any component."""
    parts = F.split(chain, "[.]")
    cut = lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), ".").alias("head"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("tail"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), cut)


def _star_names(names: DataFrame, flows: DataFrame, max_rounds: int) -> DataFrame:
    """``names`` with one row per name in place of ``import *``."""
    stars = cut_lineage(names.where(F.col("name") == "*").select("file_id", "target_file").distinct())
    plain = names.where(F.col("name") != "*")
    if not stars.limit(1).count():
        return plain
    top = r"^var[|]-?[0-9]+[|][|](.+)$"
    public = flows.where(F.col("kind").isin("edge", "import")).select("file_id", F.regexp_extract("dst", top, 1).alias("name"))
    public = public.unionByName(flows.where(F.col("kind") == "definition").select("file_id", "name"))
    known = public.where((F.col("name") != "") & (F.col("name") != "*") & ~F.col("name").rlike("^_|[.]")).distinct()
    known = new = cut_lineage(known)
    for _ in range(max_rounds):
        passed = stars.join(new.select(F.col("file_id").alias("target_file"), "name"), "target_file").select("file_id", "name").distinct()
        new = cut_lineage(passed.join(known, ["file_id", "name"], "left_anti"))
        if not new.limit(1).count():
            break
        known = known.unionByName(new)
    else:
        raise RuntimeError("names of star imports did not settle")
    starred = stars.join(known.select(F.col("file_id").alias("target_file"), "name"), "target_file")
    return plain.unionByName(starred.select("file_id", "target_file", F.col("name").alias("alias"), "name")).distinct()


def _targets(uses: DataFrame, names: DataFrame, aliases: DataFrame, modules: DataFrame, max_rounds: int) -> DataFrame:
    """``file_id, chain, target_file, target``: what dotted names stand for.

    Names are followed from file to file, through any number of re-exports, as
    imported names (with attributes behind them) and as modules.  Names of a
    cycle of imports are seen once.
    """
    start = uses.groupBy("file_id", "chain").agg(F.max("file_id").alias("target_file"), F.max("chain").alias("target"))
    found = new = cut_lineage(start)
    keys = ["file_id", "chain", "target_file", "target"]
    names = names.select(F.col("file_id").alias("target_file"), F.col("alias").alias("head"), F.col("target_file").alias("next_file"), "name")
    aliases = aliases.select(F.col("file_id").alias("target_file"), F.col("alias").alias("head"), "project", F.col("module").alias("base"))
    modules = modules.select("project", "module", F.col("target_file").alias("next_file"))
    for _ in range(max_rounds):
        cuts = new.select("file_id", "chain", "target_file", F.explode(_splits("target")).alias("c")).select("file_id", "chain", "target_file", "c.head", "c.tail").where("head <> ''")
        named = cuts.join(names, ["target_file", "head"]).select("file_id", "chain", F.col("next_file").alias("target_file"), _dotted(F.col("name"), F.col("tail")).alias("target"))
        inner = cuts.where("tail <> ''").join(aliases, ["target_file", "head"]).select("file_id", "chain", "project", "base", F.explode(_splits("tail")).alias("c")).where("c.tail <> ''")
        inner = inner.select("file_id", "chain", "project", _dotted(F.col("base"), F.col("c.head")).alias("module"), F.col("c.tail").alias("target"))
        entered = inner.join(modules, ["project", "module"]).select("file_id", "chain", F.col("next_file").alias("target_file"), "target")
        new = named.unionByName(entered).distinct().join(found, keys, "left_anti")
        # The expression hides the union's partitioning, which checkpoints can't carry over.
        new = cut_lineage(new.select("file_id", "chain", "target_file", F.concat("target", F.lit("")).alias("target")))
        if not new.limit(1).count():
            return found
        found = found.unionByName(new)
    raise RuntimeError("re-exports did not settle")


def _field(file: Column, target: Column) -> Column:
    """The field node of ``Class.name``."""
    parts = F.split(target, "[.]")
    return F.concat_ws("|", F.lit("field"), file.cast("string"), F.get(parts, 0), F.get(parts, 1))


def project_edges(files: DataFrame, flows: DataFrame, *, max_rounds: int = 40) -> DataFrame:
    """``src, dst, edge_type`` within and across the files of a project.

    ``files`` has ``file_id, project, rel_path``.  Imports, relative ones too,
    meet modules of their project by equality on (project, module); attributes
    of modules meet the module's names, and arguments of imported functions the
    parameters of the definition, however often it is re-exported.
    """
    own = files.select("file_id", "project", F.when(F.col("rel_path") == "__init__.py", "").otherwise(module_name(F.col("rel_path"))).alias("own"), F.col("rel_path").rlike(r"(^|/)__init__[.]py$").alias("is_package")).distinct()
    modules = own.select("project", F.col("file_id").alias("target_file"), F.col("own").alias("module"))
    inside = flows.where(F.col("kind") == "edge").select("src", "dst", "edge_type")
    imports = (
        flows.where(F.col("kind") == "import")
        .join(own, "file_id")
        .select("file_id", "project", _absolute(F.col("own"), F.col("is_package"), F.col("module")).alias("module"), "name", F.element_at(F.split("dst", "[|]"), -1).alias("alias"))
        .where(F.col("module").isNotNull())
    )
    names = imports.join(modules, ["project", "module"]).select("file_id", "target_file", "alias", "name").distinct()
    names = cut_lineage(_star_names(names, flows, max_rounds))
    plain = flows.where(F.col("kind") == "module").join(own, "file_id").select("file_id", "project", F.col("name").alias("alias"), "module")
    aliases = cut_lineage(plain.unionByName(imports.where(F.col("name") != "*").select("file_id", "project", "alias", _dotted(F.col("module"), F.col("name")).alias("module"))).distinct())
    variable = lambda file, name: F.concat_ws("|", F.lit("var"), F.col(file).cast("string"), F.lit(""), name)
    values = names.select(variable("target_file", "name").alias("src"), variable("file_id", "alias").alias("dst"), F.lit("project_import_value").alias("edge_type"))
    uses = flows.where(F.col("kind").isin("attribute", "outer_argument", "outer_result")).select("file_id", F.col("name").alias("chain"))
    targets = _targets(uses, names, aliases, modules, max_rounds)
    attributes = (
        flows.where(F.col("kind") == "attribute")
        .select("file_id", F.col("name").alias("chain"), F.col("src").alias("dst"))
        .distinct()
        .join(targets.where(F.size(F.split("target", "[.]")) <= 2), ["file_id", "chain"])
        .select(F.when(F.col("target").contains("."), _field(F.col("target_file"), F.col("target"))).otherwise(variable("target_file", "target")).alias("src"), "dst", F.lit("project_import_value").alias("edge_type"))
    )
    definitions = flows.where(F.col("kind") == "definition").select(
        F.col("file_id").alias("target_file"), F.regexp_replace("name", r"[.]__init__$", "").alias("target"), F.col("name").alias("symbol"), F.split("module", ",").alias("params"), F.col("src").alias("ret")
    )
    resolved = targets.join(definitions, ["target_file", "target"])
    arguments = flows.where(F.col("kind") == "outer_argument").select("file_id", F.col("name").alias("chain"), "src", F.col("dst").alias("slot"), "edge_type")
    param = F.when(F.col("slot").rlike(r"^\d+$"), F.get("params", F.col("slot").try_cast("int"))).otherwise(
        F.when(F.array_contains("params", F.col("slot")), F.col("slot"))
    )
    passed = (
        arguments.join(resolved, ["file_id", "chain"])
        .withColumn("param", param)
        .where(F.col("param").isNotNull())
        .select("src", F.concat_ws("|", F.when(F.col("edge_type").endswith("payload"), "pay:var").otherwise("var"), F.col("target_file").cast("string"), "symbol", "param").alias("dst"), "edge_type")
    )
    results = (
        flows.where(F.col("kind") == "outer_result")
        .select("file_id", F.col("name").alias("chain"), F.col("src").alias("here"))
        .join(resolved, ["file_id", "chain"])
        .select(F.col("ret").alias("src"), F.col("here").alias("dst"), F.lit("call_return_value").alias("edge_type"))
    )
    inner = lambda c: F.concat(F.lit("pay:"), F.col(c)).alias(c)
    given = results.select(inner("src"), inner("dst"), F.lit("return_payload_alias").alias("edge_type"))
    held = values.unionByName(attributes).select(inner("src"), inner("dst"), F.lit("payload_assignment").alias("edge_type"))
    parts = [inside, values, attributes, passed, results, given, held]
    return reduce(DataFrame.unionByName, parts).distinct()


def _sources_and_sinks(files: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, literals of the vocabulary and sinks; of different texts under one id the greatest hash counts."""
    rows = files.where(F.col("file_id").isNotNull() & F.col("text").isNotNull()).withColumn("__h", F.xxhash64("text", "rel_path", "project"))
    one = rows.select("file_id", "__h").groupBy("file_id").agg(F.max("__h").alias("__h"))
    kept = rows.join(one, ["file_id", "__h"])
    flows = cut_lineage(value_flows(spread(kept)).distinct())
    names = vocabulary.select(F.explode(F.array("model_id", F.element_at(F.split("model_id", "/"), -1))).alias("name")).distinct()
    literals = flows.where(F.col("kind") == "literal").join(names, "name", "left_semi").select(F.col("src").alias("node"), "file_id", "line", F.col("name").alias("literal")).distinct()
    places = rows.join(one, ["file_id", "__h"]).select("file_id", "project", "rel_path").distinct()
    edges = cut_lineage(project_edges(places, flows))
    sinks = flows.where(F.col("kind") == "sink").select(F.col("src").alias("node"), F.col("file_id").alias("sink_file"), F.col("line").alias("sink_line"), F.col("name").alias("callee")).distinct()
    return edges, cut_lineage(literals), sinks


def trace_literals(files: DataFrame, vocabulary: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """``file_id, line, literal, sink_file, sink_line, callee, locality``.

    Literals equal to an entry of ``vocabulary(model_id)`` (whole, or without
    its namespace) are followed along value-flow edges to calls that take a
    model; ``locality`` is ``non_local`` when the call lies in another file.
    ``files`` has ``file_id, project, rel_path, text``.
    """
    edges, literals, sinks = _sources_and_sinks(files, vocabulary)
    reached = spread_sets(edges.select("src", "dst"), literals.select("node", F.col("node").alias("value")), "src", "dst", "node", "value", max_rounds=max_rounds)
    hits = reached.join(sinks, "node").drop("node")
    return hits.join(literals.withColumnRenamed("node", "value"), "value").select(
        "file_id", "line", "literal", "sink_file", "sink_line", "callee", F.when(F.col("file_id") == F.col("sink_file"), "local").otherwise("non_local").alias("locality")
    )


def trace_paths(files: DataFrame, vocabulary: DataFrame, *, mode: str = "all", max_rounds: int = 200) -> DataFrame:
    """``trace_literals`` with the way: ``steps array<string>``, ``kinds array<string>``,
    ``interprocedural``, ``interfile`` and ``trace_id``.

    One fewest-edges path per literal and sink, the smallest of equally long
    ones.  ``mode`` ``all`` gives every sink of a literal, ``shortest`` the one
    with the fewest edges, then by file, line and callee.
    """
    if mode not in ("all", "shortest"):
        raise ValueError(f"unknown mode {mode}")
    edges, literals, sinks = _sources_and_sinks(files, vocabulary)
    reached = paths_per_source(edges, literals.select("node"), "src", "dst", "edge_type", "node", max_rounds=max_rounds)
    hits = reached.join(sinks, "node").join(literals.withColumnRenamed("node", "source"), "source")
    if mode == "shortest":
        order = F.struct(F.size("path").alias("n"), "sink_file", "sink_line", F.coalesce("callee", F.lit("")).alias("c"), "node")
        rest = [c for c in hits.columns if c != "source"]
        hits = hits.groupBy("source").agg(F.min_by(F.struct(*rest), order).alias("b")).select("source", "b.*")
    files_of = F.array_distinct(F.transform("path", lambda n: F.regexp_extract(n, "[|](-?[0-9]+)[|]", 1)))
    out = hits.select(
        "source", "file_id", "line", "literal", "sink_file", "sink_line", "callee", F.col("path").alias("steps"), "kinds",
        F.exists("kinds", lambda k: k.rlike("param|return|call_")).alias("interprocedural"), (F.size(files_of) > 1).alias("interfile"),
        F.when(F.col("file_id") == F.col("sink_file"), "local").otherwise("non_local").alias("locality"), F.col("node").alias("sink"),
    )
    return with_ordinal(out, ["file_id", "line", "source", "sink"], "trace_id", "trace_%05d").drop("source", "sink")


def call_origins(facts: DataFrame, *, max_rounds: int = 200) -> DataFrame:
    """``file_id, alias, origin``: imports that names of a file stand for.

    Imported names and modules are origins of themselves; a name that is
    assigned from a call or attribute of such a name has its origin too, through
    any number of assignments.  ``facts`` is the result of ``syntax_facts``.
    """
    imports = facts.where(F.col("kind") == "import")
    plain = F.col("extra") == "import"
    alias = F.when(plain, F.coalesce("detail", "name")).otherwise(F.col("detail"))
    origin = F.when(plain, F.col("name")).otherwise(F.concat_ws(".", "name", "extra"))
    node = lambda name: F.concat_ws("|", F.col("file_id").cast("string"), name)
    seeds = imports.select(node(F.element_at(F.split(alias, "[.]"), 1)).alias("node"), origin.alias("origin")).where(~F.col("origin").startswith("."))
    moves = facts.where((F.col("kind") == "assignment") & F.col("extra").isNotNull())
    edges = moves.select(node(F.split("extra", "[.]")[0]).alias("src"), node(F.col("name")).alias("dst"))
    known = spread_sets(edges, seeds, "src", "dst", "node", "origin", max_rounds=max_rounds)
    parts = F.split("node", "[|]")
    return known.select(parts[0].cast("long").alias("file_id"), parts[1].alias("alias"), F.col("value").alias("origin"))


def loader_candidates(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """``candidate_id, file_id, line, chain, origin, rule_origin, binds``: calls on names of
    known origin that take a model.

    The longest prefix of a call's dotted name that has an origin decides; rules
    ``(import_origin)`` meet the origin's first component.  ``binds`` says how the
    call takes a model: ``keyword`` or ``positional``; calls that do neither are
    left out.
    """
    calls = facts.where(F.col("kind") == "call").select(
        "file_id", "line", F.col("name").alias("chain"), F.coalesce(F.split("detail", ","), F.array().cast("array<string>")).alias("keywords"), F.col("extra").cast("int").alias("n_args")
    ).distinct()
    last = F.element_at(F.split("chain", "[.]"), -1)
    selector = last.rlike("^[A-Z]") | F.lower(last).isin(*SELECTORS) | F.lower(last).endswith("_model")
    binds = F.when(F.arrays_overlap("keywords", F.array(*map(F.lit, sorted(MODEL_ARGS)))), "keyword").when(selector & (F.col("n_args") > 0), "positional")
    rows = calls.withColumn("binds", binds).where(F.col("binds").isNotNull())
    rows = rows.withColumn("row_id", F.concat_ws("|", F.col("file_id").cast("string"), F.col("line").cast("string"), "chain", F.array_join("keywords", ","), F.col("n_args").cast("string")))
    found = longest_prefix(cut_lineage(rows), call_origins(facts), ["file_id"], "chain", "alias", "origin", mark=".").where(F.col("value_found").isNotNull())
    origins = rules.select(F.col("import_origin").alias("rule_origin")).where("rule_origin is not null").distinct()
    met = found.withColumn("rule_origin", F.split("value_found", "[.]")[0]).join(origins, "rule_origin")
    out = met.select("file_id", "line", "chain", F.col("value_found").alias("origin"), "rule_origin", "binds", "row_id")
    return with_ordinal(out, ["file_id", "line", "chain", "row_id"], "candidate_id", "loader_candidate_%05d").drop("row_id")
