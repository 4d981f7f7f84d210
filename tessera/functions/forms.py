"""Written forms of identifiers, addresses and settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import terms

# File endings and starts that make a text a local path.
LOCAL_ENDINGS = ("bin", "ckpt", "gguf", "h5", "json", "model", "onnx", "pb", "pkl", "pt", "pth", "safetensors", "tar", "txt", "yaml", "yml", "zip")
# Words that say nothing about what a name stands for.
STOP_WORDS = ("a", "an", "and", "for", "from", "in", "of", "on", "or", "the", "to", "with")
# Entities of mark-up, and what they stand for.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def search_forms(model_id: Column) -> Column:
    """Structs ``form, quote, literal``: full and bare, each in both quotes."""
    bare = F.element_at(F.split(model_id, "/"), -1)
    quoted = lambda form, name, text, sign: F.struct(F.lit(form).alias("form"), F.lit(name).alias("quote"), F.concat(F.lit(sign), text, F.lit(sign)).alias("literal"))
    return F.array(*[quoted(form, name, text, sign) for form, text in (("full", model_id), ("namespace_free", bare)) for name, sign in (("double", '"'), ("single", "'"))])


def query_text(literal: Column, size_min: Column, size_max: Column) -> Column:
    """The literal as JSON text with a range of sizes behind it."""
    escaped = F.regexp_replace(F.regexp_replace(literal, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), escaped, F.lit('" size:'), size_min.cast("string"), F.lit(".."), size_max.cast("string"))


def location_url(base: Column, commit: Column, path: Column, line: Column) -> Column:
    """Address of a line of a file at a commit."""
    return F.concat(base, F.lit("/blob/"), commit, F.lit("/"), path, F.lit("#L"), line.cast("string"))


def url_parts(url: Column) -> Column:
    """Struct ``repository, commit, path``; nulls where the address names no file at a full commit."""
    of = lambda k: F.nullif(F.regexp_extract(url, r"^https?://[^/]+/([^/]+/[^/]+)/blob/([0-9a-f]{40})/([^?#]+)", k), F.lit(""))
    return F.struct(of(1).alias("repository"), of(2).alias("commit"), F.try_url_decode(of(3)).alias("path"))


def argument_value(value: Column) -> Column:
    """A model argument without address, query, fragment and ``models/``."""
    bare = F.regexp_replace(F.trim(value), r"^https?://[^/]+/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^models/", "")


def plain_values(params: Column) -> Column:
    """Texts of a JSON list without nulls, truth values, numbers and placeholders; null if it is none."""
    values = F.from_json(params, "array<string>")
    return F.filter(values, lambda v: v.isNotNull() & ~v.rlike(r"^(?:true|false|null|-?[0-9]+(?:\.[0-9]+)?|<[^>]*>|\{[^}]*\}|\s*)$"))


def sanitized_terms(c: Column) -> Column:
    """Terms of at least two letters that are no stop-words."""
    return F.filter(terms(c), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def setting_key(line: Column) -> Column:
    """The key that a line sets (``key = ...``, ``"key": ...``, ``cfg['key'] = ...``), else null."""
    item = F.regexp_extract(line, r"^\s*[A-Za-z_][\w.]*\[[\"']([\w.-]+)[\"']\]\s*=[^=]", 1)
    name = F.regexp_extract(line, r"^\s*[\"']?([A-Za-z_][\w.-]*)[\"']?\s*(?::|=)[^=]", 1)
    return F.coalesce(F.nullif(item, F.lit("")), F.nullif(name, F.lit("")))


def keyword_value(line: Column, names: tuple[str, ...]) -> Column:
    """The quoted value of the first keyword or key of ``names`` on a line, else null."""
    some = "|".join(names)
    return F.nullif(F.regexp_extract(line, rf"(?:^|[^A-Za-z0-9_])[\"']?(?:{some})[\"']?\s*[=:]\s*[\"']([^\"']+)[\"']", 1), F.lit(""))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one ``-``."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain_markup(c: Column) -> Column:
    """Text of mark-up: tags become blanks, entities their characters, blanks single."""
    out = F.regexp_replace(c, r"<[^<>]*>", " ")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def list_items(html: Column, css_class: str) -> Column:
    """Contents of the list items of a class, in order."""
    return F.regexp_extract_all(html, F.lit(rf'(?s)<li\b[^>]*\bclass="[^"]*\b{css_class}\b[^"]*"[^>]*>(.*?)</li>'), F.lit(1))


def compact_time(ts: Column) -> Column:
    """A time as fourteen digits, UTC."""
    return F.date_format(ts, "yyyyMMddHHmmss")


def local_path(value: Column) -> Column:
    """Whether a value names a file of the machine rather than a model."""
    endings = "|".join(LOCAL_ENDINGS)
    return value.rlike(rf"^(?:\.{{1,2}}/|/|~|[A-Za-z]:[\\/])|\.(?:{endings})$")


def reference_line(line: Column, name: Column) -> Column:
    """Whether a line may call ``name``: it holds it and is no comment, class line or its definition."""
    return F.contains(line, name) & ~line.rlike(r"^\s*(?:#|class\b)") & ~F.regexp_like(line, F.concat(F.lit(r"^\s*(?:async\s+)?def\s+"), name, F.lit(r"\b")))
