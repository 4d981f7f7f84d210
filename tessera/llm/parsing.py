"""Source files that do not parse.

Each file is parsed against all supported grammars, in the order in which its
tokens make them likely.  The grammar of its extension decides validity; where
that fails, a successful foreign parse names a wrong extension, and failure of
all grammars means corruption (truncation, merge conflict, other damage).
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
import xml.parsers.expat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = {".py": "python", ".json": "json", ".toml": "toml", ".xml": "xml"}
_BOM = chr(0xFEFF)


def _python(text: str) -> None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        compile(text.removeprefix(_BOM), "<file>", "exec", flags=ast.PyCF_ONLY_AST, dont_inherit=True)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


def _json(text: str) -> None:
    try:
        json.loads(text.removeprefix(_BOM), parse_constant=_no_constant, parse_int=len, parse_float=len)
    except RecursionError:
        _deep_json(text.removeprefix(_BOM))


_JSON_LEAF = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null')
_JSON_KEY = re.compile(r'[ \t\r\n]*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")[ \t\r\n]*:')
_JSON_SPACE = re.compile(r"[ \t\r\n]*")


def _deep_json(text: str) -> None:
    """JSON nested more deeply than the parser's stack, without a stack of calls."""
    closers, at, value = [], 0, True
    while True:
        at = _JSON_SPACE.match(text, at).end()
        sign = text[at : at + 1]
        if value and sign in ("{", "["):
            closers.append("}" if sign == "{" else "]")
            at = _JSON_SPACE.match(text, at + 1).end()
            if text[at : at + 1] == closers[-1]:
                closers.pop()
                at, value = at + 1, False
        elif value:
            if not (m := _JSON_LEAF.match(text, at)):
                raise ValueError(f"no value at {at}")
            at, value = m.end(), False
        elif not closers:
            if sign:
                raise ValueError(f"extra text at {at}")
            return
        elif sign == closers[-1]:
            closers.pop()
            at += 1
        elif sign == ",":
            at, value = at + 1, True
        else:
            raise ValueError(f"no separator at {at}")
        if value and closers and closers[-1] == "}":
            if not (m := _JSON_KEY.match(text, at)):
                raise ValueError(f"no key at {at}")
            at = m.end()


def _toml(text: str) -> None:
    tomllib.loads(text.removeprefix(_BOM))


def _xml(text: str) -> None:
    parser = xml.parsers.expat.ParserCreate("utf-8")
    parser.Parse(text.removeprefix(_BOM).encode("utf-8", "surrogatepass"), True)


GRAMMARS = {"python": _python, "json": _json, "toml": _toml, "xml": _xml}
#: Tokens that speak for a grammar.
_EVIDENCE = {
    "python": re.compile(r"^[ \t]*(?:def|class|import|from|return|if|for|while|try|with|assert|@\w)\b.*|^[ \t]*#", re.M),
    "json": re.compile(r'^[ \t]*(?:[{}\[\]],?|"[^"\n]*"[ \t]*:.*)[ \t]*$', re.M),
    "toml": re.compile(r"^[ \t]*(?:\[{1,2}[\w.\" -]+\]{1,2}|[\w.\"-]+[ \t]*=[ \t]*\S.*)[ \t]*$", re.M),
    "xml": re.compile(r"<(?:/?[A-Za-z_][\w.:-]*|\?xml|!--)", re.M),
}
_CONFLICT = re.compile(r"^(?:<{7} .*|={7}|>{7} .*)$", re.M)


def ranked_grammars(text: str) -> list[str]:
    """Grammars by the number of tokens in the text that look like them."""
    return sorted(_EVIDENCE, key=lambda g: (-len(_EVIDENCE[g].findall(text)), g))


class Undecided(Exception):
    """The parser's stack or memory ended before the text did."""


def parse_error(grammar: str, text: str) -> str | None:
    """None if ``text`` is valid, else the reason; Undecided if the parser can't tell."""
    try:
        GRAMMARS[grammar](text)
        return None
    except (RecursionError, MemoryError) as e:
        raise Undecided(type(e).__name__) from e
    except (SyntaxError, ValueError, xml.parsers.expat.ExpatError) as e:
        return f"{type(e).__name__}: {e}"


def judge(path: str | None, text: str | None) -> tuple[str | None, bool | None, str | None, str | None, str | None]:
    """(grammar of the extension, valid, error, grammar that parses, cause)."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1].lower()
    own = EXTENSIONS.get(name[name.rfind(".") :]) if "." in name else None
    if text is None:
        return own, None, None, None, "no_text"
    errors: dict[str, str | None] = {}
    undecided = None
    for g in ranked_grammars(text):
        try:
            errors[g] = parse_error(g, text)
        except Undecided as e:
            errors[g] = str(e)
            undecided = str(e) if g == own else undecided
    # The rank decides among several that parse; own grammar first.
    parsed = own if own and errors[own] is None else next((g for g, e in errors.items() if e is None), None)
    if own is None:
        return None, None, None, parsed, "no_grammar"
    if undecided:
        return own, None, undecided, parsed, "undecided"
    if errors[own] is None:
        return own, True, None, own, "valid"
    if parsed:
        cause = "wrong_extension"
    elif _CONFLICT.search(text):
        cause = "merge_conflict"
    else:
        cause = "corrupt"
    return own, False, errors[own], parsed, cause


JUDGED = T.StructType(
    [T.StructField("grammar", T.StringType()), T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("parsed_as", T.StringType()), T.StructField("cause", T.StringType())]
)


@F.pandas_udf(JUDGED)
def _judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for paths, texts in batches:
        rows = [judge(p if isinstance(p, str) else None, t if isinstance(t, str) else None) for p, t in zip(paths, texts)]
        yield pd.DataFrame(rows, columns=JUDGED.names)


def check_syntax(files: DataFrame, *, keys: list[str], path: str = "rel_path", text: str = "text") -> DataFrame:
    """``keys`` with ``grammar, valid, error, parsed_as, cause`` per row.

    ``valid`` is null for a null text, for extensions without a grammar and where
    the parser's stack or memory ended first (cause ``undecided``).  The empty text is valid Python and TOML, not JSON or XML.  Repeated rows give
    repeated results; columns other than those named are not read.
    """
    return files.select(*keys, _judge(F.col(path), F.col(text)).alias("__j")).select(*keys, "__j.*")


def one_per_file(judged: DataFrame, file_id: str) -> DataFrame:
    """One row per file: of different texts under one id an invalid one counts,
    then the greatest row.  Rows with a null id are left out."""
    rows = judged.where(F.col(file_id).isNotNull())
    rest = [c for c in rows.columns if c != file_id]
    best = F.max(F.struct((~F.coalesce("valid", F.lit(True))).alias("invalid"), F.col("valid").isNotNull().alias("known"), *rest)).alias("__b")
    return rows.groupBy(file_id).agg(best).select(file_id, *[f"__b.{c}" for c in rest])


def syntax_rates(judged: DataFrame, by: list[str]) -> DataFrame:
    """Files with a grammar, invalid files and their rate per ``by``."""
    rows = judged.where(F.col("valid").isNotNull())
    return (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"))
        .withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )
