"""What lies around a place in a source text: lexical and syntactic contexts."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.value_flow import dotted_name

#: Contexts of a place, the stronger first; all else is code, or lies behind damage.
LEXICAL = ("docstring", "comment", "string_literal")
_STRINGS = {tokenize.STRING, *(getattr(tokenize, n) for n in ("FSTRING_MIDDLE", "TSTRING_MIDDLE") if hasattr(tokenize, n))}
_LAST = 10**9


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def context_spans(text: str) -> dict[int, list[tuple[int, int, int]]]:
    """line -> (first column from 0, column behind the last, place in LEXICAL) of docstrings,
    comments and strings; those before a damaged place stay."""
    out: dict[int, list[tuple[int, int, int]]] = {}

    def add(rank: int, start: tuple[int, int], end: tuple[int, int]):
        for line in range(start[0], end[0] + 1):
            out.setdefault(line, []).append((start[1] if line == start[0] else 0, end[1] if line == end[0] else _LAST, rank))

    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                add(1, t.start, t.end)
            elif t.type in _STRINGS:
                add(2, t.start, t.end)
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    tree = _tree(text)
    for node in ast.walk(tree) if tree else ():
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body:
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                add(0, (first.lineno, 0), (first.end_lineno or first.lineno, _LAST))
    return out


def classify_positions(files: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with ``context``: docstring, comment, string_literal or code_or_unknown.

    ``points`` has ``file_id, line, column`` (column from 1).  A text gives one
    row per line that has spans, so a point meets them by equality on (file,
    line).  Of a file with several texts, and of spans that overlap, the stronger
    context counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, line, *(list(x) for x in zip(*spans))) for i, t in zip(b["file_id"], b["text"]) for line, spans in context_spans(t).items()]
            yield pd.DataFrame(rows, columns=["file_id", "line", "first", "behind", "rank"])

    texts = files.select("file_id", "text").where(F.col("file_id").isNotNull() & F.col("text").isNotNull())
    spans = texts.mapInPandas(run, "file_id long, line int, first array<int>, behind array<int>, rank array<int>")
    known = spans.select("file_id", "line", F.arrays_zip("first", "behind", "rank").alias("__s"))
    at = F.col("column") - 1
    held = F.array_min(F.transform(F.filter("__s", lambda x: (x["first"] <= at) & (at < x["behind"])), lambda x: x["rank"]))
    places = points.select("file_id", "line", "column").distinct()
    met = places.join(known, ["file_id", "line"]).withColumn("__r", held).groupBy("file_id", "line", "column").agg(F.min("__r").alias("__r"))
    label = F.coalesce(F.get(F.array(*map(F.lit, LEXICAL)), F.col("__r")), F.lit("code_or_unknown"))
    return points.join(met, ["file_id", "line", "column"], "left").withColumn("context", label).drop("__r")


def _role(node: ast.AST, parents: dict[ast.AST, ast.AST]) -> tuple[str, str | None]:
    """(role, name) of a literal by what holds it."""
    child, up = node, parents.get(node)
    inside = None
    while up is not None:
        if isinstance(up, ast.Dict):
            if child in up.values:
                key = up.keys[up.values.index(child)]
                return "mapping_value", key.value if isinstance(key, ast.Constant) and isinstance(key.value, str) else None
            return "mapping_key", None
        if isinstance(up, ast.keyword):
            return "keyword_argument", up.arg
        if isinstance(up, ast.arguments):
            return "parameter_default", None
        if isinstance(up, ast.Compare):
            return "comparison", dotted_name(up.left)
        if isinstance(up, ast.Subscript) and child is up.slice:
            return "subscript", dotted_name(up.value)
        if isinstance(up, ast.Call):
            return ("positional_argument", dotted_name(up.func)) if child in up.args else ("callee", None)
        if isinstance(up, (ast.List, ast.Tuple, ast.Set)):
            inside = "collection_item"
        elif isinstance(up, (ast.Assign, ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
            target = up.targets[0] if isinstance(up, ast.Assign) else up.target
            return inside or "assignment", dotted_name(target)
        elif isinstance(up, ast.Return):
            return inside or "return", None
        elif isinstance(up, ast.stmt):
            return inside or ("standalone" if isinstance(up, ast.Expr) else "other"), None
        child, up = up, parents.get(up)
    return "other", None


def literal_roles(files: DataFrame) -> DataFrame:
    """``file_id, line, column, literal, role, name`` of every text literal of files that parse.

    ``name`` is the key, argument, callee or target that goes with the role.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["file_id"], b["text"]):
                tree = _tree(t)
                nodes = list(ast.walk(tree)) if tree else []
                parents = {c: n for n in nodes for c in ast.iter_child_nodes(n)}
                texts = [n for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, str)]
                rows += [(i, n.lineno, n.col_offset + 1, n.value, *_role(n, parents)) for n in texts]
            yield pd.DataFrame(rows, columns=["file_id", "line", "column", "literal", "role", "name"])

    texts = files.select("file_id", "text").where(F.col("file_id").isNotNull() & F.col("text").isNotNull())
    return texts.mapInPandas(run, "file_id long, line int, column int, literal string, role string, name string")


def annotated_literals(annotation: str) -> list[str]:
    """Texts of ``Literal[...]`` in an annotation, also within unions."""
    try:
        tree = ast.parse(annotation, mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Subscript) and (dotted_name(n.value) or "").split(".")[-1] == "Literal":
            items = n.slice.elts if isinstance(n.slice, ast.Tuple) else [n.slice]
            out += [x.value for x in items if isinstance(x, ast.Constant) and isinstance(x.value, str)]
    return out
