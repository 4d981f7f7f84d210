"""Credentials embedded in source code and configuration.

Texts are cut into lexical tokens (strings, names, punctuation).  A literal is
flagged when it is assigned or passed to a credential-named identifier and is
neither a placeholder nor a reference nor an ordinary word; pieces that are
joined count as one literal, encoded ones are decoded, fallbacks of look-ups are
seen through.  Self-identifying credentials (issuer prefixes, signed tokens,
private keys, logins in URLs and commands) are flagged wherever they stand.
Redaction overwrites the contents character by character and keeps delimiters,
escapes and line ends, so that lengths and the code around stay as they were.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Last words of names that hold a password, or a key or token.
PASSWORD_WORDS = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode"}
TOKEN_WORDS = {"token", "secret", "authorization", "auth", "bearer", "credential", "credentials", "apikey", "authtoken", "secretkey", "accesskey", "privatekey", "pat", "jwt"}
KEY_WORDS = {"key", "pem"}
# Words before "key" or "token" that make it no secret.
HARMLESS_BEFORE = {"public", "verify", "verification", "primary", "foreign", "cache", "sort", "partition", "group", "row", "column", "map", "dict", "lookup", "index", "object", "field", "next", "page", "csrf", "pad", "mask", "unk", "bos", "eos", "sep", "cls", "stop"}
# issuers' marks at the start of keys.
_ISSUED = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,}|sk-(?:proj-|ant-|live-)?[A-Za-z0-9_-]{20,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|hf_[A-Za-z0-9]{24,}|xox[abeprs]-[A-Za-z0-9-]{16,}|gsk_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35}|ya29\.[A-Za-z0-9_-]{20,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{20,}|dop_v1_[0-9a-f]{40,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
#: Any short lower-case mark before a long mixed run is taken for an issuer's.
_MARKED = r"[a-z]{2,6}(?:[-_][a-z]{2,6}){0,2}[-_][A-Za-z0-9]{20,}"
_TOKEN = re.compile(rf"(?<![A-Za-z0-9_+/=.-])(?:{_ISSUED}|{_MARKED})(?![A-Za-z0-9_])={{0,2}}")
_ISSUED_ONLY = re.compile(_ISSUED)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>.*?)(?=-----END|[\"'`<]|\Z)", re.S)
_URL = re.compile(r"(?<=[A-Za-z0-9+.-])://(?P<user>[^\s:/@\"'`<>]*):(?P<login>[^\s/@\"'`<>]+)@(?=[\w\[.$-])")
_COMMAND_USER = re.compile(r"(?:(?<![\w-])-u|--user|--proxy-user)(?:\s+|=)[\"']?(?P<user>[^\s:\"'`]+):(?P<login>[^\s\"'`]+)")
_COMMAND_FLAG = re.compile(r"(?<![\w-])--(?P<name>[A-Za-z][\w-]*+)(?:\s+|=)(?P<login>[^\s\"'`-][^\s\"'`]*)")
# Searches of lower-cased text that decide whether the costly patterns run; each
# finds all that the patterns behind it find.
_NAMES = "|".join(sorted(PASSWORD_WORDS | TOKEN_WORDS | KEY_WORDS))
_MARK_TEXT = r"akia|asia|aiza|eyj|ya29|sg\.|sk-|xox|pypi-|glpat-|github_pat|[-_][a-z0-9]{16}"
_HINT = re.compile(rf"{_NAMES}|://|-u[\s=]|-user|{_MARK_TEXT}")
_MARK = re.compile(_MARK_TEXT)
_PROSE = re.compile(r"(?:key|secret|token|passw(?:or)?d|pwd)\s*(?:is|was)?\s*[:=]")
#: A credential word at the end of a name (only letters and digits count there,
#: and numbers are stripped), and something that binds or passes it.
_BINDS = re.compile(rf"(?:{_NAMES})[^a-z=:,(]*[=:,(]")
#: Two literals in a row, the first of which may begin an issuer's key.
_ISSUER = re.compile(
    r"[\"'`](?:[AghrsxyanpSde][\w.-]*[\"'`]{1,3}\s*(?:\+\s*)?|[\"'`]{1,3}(?:\s*\+\s*|\s+)|(?<=\")\"(?=')|(?<=')'(?=\"))(?:[rbufRBUF]{1,2})?[\"'`]{1,3}[\w.=-]"
)

_LEX = re.compile(
    r"(?P<str>(?P<pre>\b[rRbBuUfF]{1,2})?(?:\"\"\"(?P<d3>(?:[^\\\"]|\\.|\"(?!\"\"))*)\"\"\"|'''(?P<s3>(?:[^\\']|\\.|'(?!''))*)'''"
    r"|\"(?P<d1>(?:[^\"\\\n]|\\.)*)\"|'(?P<s1>(?:[^'\\\n]|\\.)*)'|`(?P<b1>[^`\\]*)`))"
    r"|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<op>\|\||\?\?|[=!<>]=|:=|=>|->|\S)",
    re.S,
)
_BARE = re.compile(r"^[ \t]*(?:[#;]+[ \t]*|//[ \t]*)?(?:export[ \t]+|-[ \t]+|set[ \t]+)?(?P<name>[A-Za-z_][\w.-]*)[ \t]*[=:][ \t]*(?P<value>[^\s\"'`(\[{<][^\n]*)$", re.M)
_NAMED_PROSE = re.compile(r"(?i)\b(?:api[ _-]?key|access[ _-]?key|secret|token|password|passwd|pwd|key)\b(?:[ \t]+(?:is|was))?[ \t]*[:=][ \t]*(?P<value>[^\s\"'`,;<>]{6,})")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>(?P<value>[^<>]*)</(?P=name)\s*>")
_PROPERTY = re.compile(r"<[A-Za-z_][\w.:-]*\s[^<>]*?\b(?:name|key)\s*=\s*[\"'](?P<name>[^\"'<>]+)[\"'][^<>]*?\bvalue\s*=\s*(?P<q>[\"'])(?P<value>.*?)(?P=q)", re.S)
_CODE = re.compile(r"^[ \t]*(?:def |class |import |from \w+ import|return\b|function\b|const |let |export )", re.M)
_PLACEHOLDER = re.compile(
    r"<[^>]*>|\$\{|\{\{|\$\(|%\(|^\$\w+$|^%\w+%$|\.\.\.|(.)\1{5,}|^\*+$"
    r"|(?i:(?:^|[\W_])(?:your|yours|replace|replaceme|change|changeme|placeholder|example|sample|dummy|todo|fixme|redacted|insert|none|null|undefined|true|false|xxx+)(?:$|[\W_]))|EXAMPLE"
)
_WORDS = re.compile(r"^[A-Za-z]+(?:[ _./:-][A-Za-z]+)*$")
_ORDINARY = re.compile(r"^(?:[A-Z]?[a-z]{3,})+$")
_MODEL = re.compile(r"^(?:[a-z][a-z0-9-]*/)?[a-z]+-\d+(?:\.\d+)?(?:-[a-z0-9]+)*(?::[a-z]+)?$")
_ROOTED = re.compile(r"(?:\.{0,2}/|~/|[A-Za-z]:\\)")
_SPLIT = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_READERS = {"get", "load", "read", "fetch", "find", "lookup", "require", "resolve", "has", "is", "delete", "remove", "pop", "prompt", "ask"}
_GETTERS = ("getenv", "get", "env", "config", "load_secret", "getproperty", "setting", "secret", "getsecret", "get_secret", "pop", "setdefault", "getattr", "lookup")


def name_kind(name: str) -> str | None:
    """``password``, ``token`` or None, by the last word of an identifier."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return None
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    if last in PASSWORD_WORDS:
        return "password"
    if last in TOKEN_WORDS or last in KEY_WORDS:
        return None if before in HARMLESS_BEFORE else "token"
    return None


def _mixed(value: str) -> bool:
    """Looks random: a run of letters and digits that no word has."""
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return kinds >= 2 and bool(re.search("[0-9]", value)) and len(set(value)) >= min(10, len(value) // 2) or _scrambled(value)


def _scrambled(value: str) -> bool:
    """Letters of both cases in an order that no joined words have."""
    if len(value) < 8 or not re.search("[a-z]", value) or not re.search("[A-Z]", value):
        return False
    pieces = _SPLIT.findall(value)
    return sum(map(len, pieces)) <= 3.2 * len(pieces) and len(pieces) >= 3


def _pathlike(value: str) -> bool:
    """A path from a root, or one of plain parts that ends in an extension."""
    if _ROOTED.match(value):
        return True
    return "/" in value[1:] and not re.search(r"[^\w./-]|//", value) and re.search(r"[\w-]\.\w{1,5}$", value) is not None


def _modellike(value: str) -> bool:
    """A model's id, none of whose parts looks random."""
    return _MODEL.match(value) is not None and not any(len(p) >= 16 and _mixed(p) for p in re.split("[-/:]", value))


def is_secret(value: str, kind: str, encoded: bool = False) -> bool:
    """Whether a literal bound to a name of ``kind`` gives access."""
    value = re.sub(r"^(?i:bearer|basic|token)\s+", "", value.strip())
    if encoded:
        try:
            value = base64.b64decode(re.sub(r"\s", "", value), validate=True).decode("utf-8")
        except (binascii.Error, ValueError):
            return False
    if len(value) < 6 or _PLACEHOLDER.search(value):
        return False
    if len(parts := value.split()) > 1:  # a pass phrase, if no part is a plain word or number
        return kind == "password" and all(re.search("[A-Za-z]", p) and re.search(r"[0-9]|[^\w./:,;-]", p) for p in parts)
    if _WORDS.match(value):
        return value.isalpha() and _scrambled(value) and not _ORDINARY.match(value) or bool(_ISSUED_ONLY.fullmatch(value))
    if _ISSUED_ONLY.match(value):
        return True
    if value.startswith(("http://", "https://", "vault:", "arn:", "projects/", "secret/")) or _pathlike(value):
        return False
    if kind == "password":
        return not _modellike(value) and bool(re.search("[A-Za-z]", value)) and bool(re.search(r"[0-9]|[^\w\s./:-]", value))
    if _modellike(value):
        return False
    if re.fullmatch(r"[A-Za-z0-9+/=_.~!@#$%^&*:-]{16,}", value):
        return _mixed(value)
    return False


class _Tokens(list):
    """Tokens of a text, with the opening bracket of each closing one and what
    earlier walks back from a place found."""

    def __init__(self, tokens: list[tuple]):
        super().__init__(tokens)
        self.found: dict[int, tuple[str | None, bool]] = {}
        self.opening: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(tokens):
            if t[0] == "op" and t[1] in ("(", "["):
                stack.append(i)
            elif t[0] == "op" and t[1] in (")", "]"):
                self.opening[i] = stack.pop() if stack else 0


def _words_before(tokens: _Tokens, i: int, end: int) -> tuple[str | None, bool]:
    """The name that string token ``i`` is bound to, and if it is encoded; its pieces go to ``end``."""
    name, encoded = _bound_before(tokens, i)
    if name is None and (end >= len(tokens) or tokens[end][1] == ")") and i >= 2:
        # The last literal of a call of a credential-named function, or behind a name.
        j = i - 1
        if tokens[j][1] == "," and j >= 3 and tokens[j - 1][0] == "str" and tokens[j - 2][1] == "(" and tokens[j - 3][0] == "name":
            if name_kind(tokens[j - 1][3]):
                return tokens[j - 1][3], encoded
            j -= 2
        if tokens[j][1] == "(" and tokens[j - 1][0] == "name":
            callee = tokens[j - 1][1].split(".")[-1]
            if _SPLIT.findall(callee)[:1] and _SPLIT.findall(callee)[0].lower() not in _READERS:
                return callee, encoded
    return name, encoded


def _bound_before(tokens: _Tokens, i: int) -> tuple[str | None, bool]:
    """The name that string token ``i`` is assigned to, and if it is encoded."""
    way: list[tuple[int, bool]] = []  # places walked over, and whether a decoder stands there
    j, got = i - 1, (None, False)
    while j >= 0:
        if j in tokens.found:
            got = tokens.found[j]
            break
        before, decoder, name = _step(tokens, j)
        way.append((j, decoder))
        if before is None:
            got = (name, False)
            break
        j = before
    for j, decoder in reversed(way):
        got = tokens.found[j] = (got[0], got[1] or decoder)
    return got


def _step(tokens: _Tokens, j: int) -> tuple[int | None, bool, str | None]:
    """From the token before a value: (where to go on, or None; a decoder; the name found)."""
    kind, text = tokens[j][0], tokens[j][1]
    if text in ("(", "[", "{"):
        if text == "(" and j >= 1 and tokens[j - 1][0] == "name":
            callee = tokens[j - 1][1].lower()
            return j - 2, "b64decode" in callee or callee.endswith(("atob", "base64.decode")), None
        return j - 1, False, None
    if text in ("or", "||", "??"):
        j -= 1
        if j >= 0 and tokens[j][1] in (")", "]") and tokens[j][0] == "op":
            j = tokens.opening[j] - 1
        return (j - 1 if j >= 0 and tokens[j][0] == "name" else j), False, None
    if text == "," and j >= 3 and tokens[j - 1][0] == "str" and tokens[j - 2][1] == "(" and tokens[j - 3][0] == "name":
        if tokens[j - 3][1].lower().split(".")[-1] not in _GETTERS:
            return None, False, None
        return (None, False, tokens[j - 1][3]) if name_kind(tokens[j - 1][3]) else (j - 4, False, None)
    if text in ("=", ":", ":=", "=>"):
        k = j - 1
        if k < 0:
            return None, False, None
        if tokens[k][1] == "]" and k >= 1 and tokens[k - 1][0] == "str":
            return None, False, tokens[k - 1][3]
        if tokens[k][0] == "str":
            return None, False, tokens[k][3]
        if tokens[k][0] == "name":
            name = tokens[k][1]
            if name.lower() == "default" and k >= 1 and tokens[k - 1][1] == ",":  # default=... of a look-up
                return k - 1, False, None
            if not name_kind(name) and text == "=" and k >= 2 and tokens[k - 1][1] == ":" and tokens[k - 2][0] == "name":
                return None, False, tokens[k - 2][1]  # name: type = value
            return None, False, name
        return None, False, None
    if kind == "name" and text.lower() in ("await", "return", "new", "const", "let", "var"):
        return j - 1, False, None
    return None, False, None


def _lex(text: str) -> list[tuple]:
    """(kind, text, start of contents, contents, is raw/f prefix)."""
    out = []
    for m in _LEX.finditer(text):
        if m.lastgroup == "name" or m.group("name"):
            out.append(("name", m.group("name"), m.start(), None, ""))
        elif m.group("str"):
            for g in ("d3", "s3", "d1", "s1", "b1"):
                if m.group(g) is not None:
                    out.append(("str", m.group("str"), m.start(g), m.group(g), (m.group("pre") or "").lower()))
                    break
        else:
            out.append(("op", m.group("op"), m.start(), None, ""))
    return out


def _scan(text: str, code: bool, nested: bool = False) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of credentials' contents.

    Literals are scanned in turn; each level lacks one kind of quote or has
    fewer escapes, so there are few levels."""
    spans: list[tuple[int, int, str]] = []
    low = text.lower()
    for m in _PEM.finditer(text) if "PRIVATE KEY" in text else ():
        body = m.group("body").replace("\\n", "")
        if re.search(r"[^\sx.*]", body) and not _PLACEHOLDER.search(body) or not body.strip():
            spans.append((m.start(), m.end("body"), "private_key"))
    for m in _URL.finditer(text) if "://" in text else ():
        p = m.group("login")
        if not _PLACEHOLDER.search(p) and "{" not in p and not p.startswith("$") and p.lower() not in PASSWORD_WORDS | {"secret", "token"} and p != m.group("user"):
            spans.append((m.start("login"), m.end("login"), "url_login"))
    for m in _COMMAND_USER.finditer(text) if "-u" in text else ():
        p = m.group("login")
        if not _PLACEHOLDER.search(p) and "{" not in p and not p.startswith("$") and p.lower() not in PASSWORD_WORDS:
            spans.append((m.start("login"), m.end("login"), "command_login"))
    for m in _COMMAND_FLAG.finditer(text) if "--" in text else ():
        if (kind := name_kind(m.group("name"))) and is_secret(m.group("login"), kind):
            spans.append((m.start("login"), m.end("login"), "command_login"))
    for m in _TOKEN.finditer(text) if _MARK.search(low) else ():
        v = m.group()
        if not _PLACEHOLDER.search(v) and (_ISSUED_ONLY.match(v) and (_mixed(v) or v.startswith(("AKIA", "ASIA"))) or _mixed(re.split("[-_]", v)[-1].rstrip("=")) and re.search("[A-Z]", v) and re.search("[a-z]", re.split("[-_]", v)[-1])):
            spans.append((m.start(), m.end(), "issued"))
    # Lexing costs most; it is needed only where a name may bind a literal, or
    # where an issuer's mark starts a literal of several pieces.
    tokens = _Tokens(_lex(text) if _BINDS.search(low) or _ISSUER.search(text) else [])
    i = 0
    while i < len(tokens):
        kind, _, start, body, prefix = tokens[i]
        if kind != "str":
            i += 1
            continue
        pieces, k = [(start, body)], i + 1  # "a" "b" and "a" + "b" are one literal
        while k < len(tokens):
            if tokens[k][0] == "str":
                pieces.append((tokens[k][2], tokens[k][3]))
                k += 1
            elif tokens[k][1] == "+" and k + 1 < len(tokens) and tokens[k + 1][0] == "str":
                pieces.append((tokens[k + 1][2], tokens[k + 1][3]))
                k += 2
            else:
                break
        name, encoded = _words_before(tokens, i, k)
        bound = name_kind(name) if name else None
        whole = "".join(b for _, b in pieces)
        literal = "f" not in prefix or "{" not in whole
        if bound and literal and "PRIVATE KEY-----" not in whole and "\n" not in whole and is_secret(whole, bound, encoded):
            spans += [(s, s + len(b), "literal" if n == 0 else "piece") for n, (s, b) in enumerate(pieces)]
        elif len(pieces) > 1 and literal and (m := _TOKEN.match(whole)) and m.end() == len(whole) and _ISSUED_ONLY.match(whole):
            spans += [(s, s + len(b), "literal" if n == 0 else "piece") for n, (s, b) in enumerate(pieces)]
        else:
            for s, b in pieces:
                if _BINDS.search(b.lower()) or _ISSUER.search(b):
                    spans += [(s + x, s + y, z) for x, y, z in _scan(b, True, True) if z in ("literal", "piece")]
        i = k
    for pattern, kinds, there in ((_ELEMENT, None, "</" in text), (_PROPERTY, None, "<" in text and "value" in low), (_NAMED_PROSE, "token", _PROSE.search(low))):
        for m in pattern.finditer(text) if there else ():
            kind = kinds or name_kind(m.group("name"))
            if kind and is_secret(m.group("value"), kind):
                spans.append((m.start("value"), m.end("value"), "literal"))
    if not nested and _BINDS.search(low):
        for m in _BARE.finditer(text):
            kind = name_kind(m.group("name"))
            value = m.group("value").rstrip()
            if kind and not (code and re.fullmatch(r"[A-Za-z_]\w*", value)) and not re.search(r"[({\[]", value) and is_secret(value, kind):
                spans.append((m.start("value"), m.start("value") + len(value), "literal"))
    return spans


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """Disjoint spans of credentials in text order; ``piece`` continues the
    credential before it."""
    if not _HINT.search(text.lower()) and not _ISSUER.search(text):
        return []
    spans = sorted(_scan(text, bool(_CODE.search(text))), key=lambda s: (s[0], -s[1], s[2]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if out and s[0] < out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2])
            if out[-1][2] != "piece" and s[2] == "piece":
                out[-1] = (*out[-1][:2], "piece")
            continue
        out.append(s)
    return out


_KEPT = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)|\s|-----[A-Z ]+-----|=+(?=$)|^(?i:bearer|basic|token)\s+", re.S)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with the spans' contents overwritten; its length stays."""
    out, at = [], 0
    for start, end, _ in spans:
        out.append(text[at:start])
        body, p = text[start:end], 0
        for m in _KEPT.finditer(body):
            out += ["x" * (m.start() - p), m.group()]
            p = m.end()
        out.append("x" * (len(body) - p))
        at = end
    return "".join(out) + text[at:]


SCANNED = T.StructType(
    [
        T.StructField("cases", T.ArrayType(T.StructType([T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType())]))),
        T.StructField("redacted", T.StringType()),
    ]
)


def scan_text(text: str | None) -> tuple[list[tuple[int, str]] | None, str | None]:
    """Lines on which credentials begin, and the text without them."""
    if text is None:
        return None, None
    spans = find_secrets(text)
    if not spans:
        return [], text
    ends = [m.start() for m in re.finditer("\n", text)]
    lines = {}
    for start, _, kind in spans:
        if kind != "piece":
            lines.setdefault(bisect_right(ends, start - 1) + 1 if start else 1, kind)
    return sorted(lines.items()), redact(text, spans)


@F.pandas_udf(SCANNED)
def _scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        codes, distinct = pd.factorize(texts)
        rows = [scan_text(t) for t in distinct] + [(None, None)]
        yield pd.DataFrame([rows[c] for c in codes], columns=["cases", "redacted"])


def scan_secrets(df: DataFrame, *, keys: list[str], text: str) -> DataFrame:
    """``keys`` with ``cases array<struct<line_no, kind>>`` and ``redacted``.

    Lines are those between line feeds, from 1.  Null text gives nulls, text
    without credentials comes out unchanged; redacting twice changes nothing.
    Repeated rows give repeated results; other columns are not read.
    """
    return df.select(*keys, _scanned(F.col(text)).alias("__s")).select(*keys, "__s.cases", "__s.redacted")
