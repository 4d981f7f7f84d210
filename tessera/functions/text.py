"""Scalar text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path words that mark a role, in the order in which they count.
EXAMPLE_WORDS = ("example", "examples", "demo", "demos", "tutorial", "tutorials", "sample", "samples")
THIRD_PARTY_WORDS = (".venv", "venv", "env", "envs", "environment", "environments", "site-packages", "dist-packages", "vendor", "vendored", "third_party", "third-party")
# Fixed value: a word that marks a role as a directory only.
DIRECTORY_ONLY = "sample"


def words(c: Column) -> Column:
    """Lower-case words of an identifier: camel case and other marks split."""
    spaced = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.filter(F.split(F.lower(F.trim(spaced)), " +"), lambda w: w != "")


def terms(c: Column) -> Column:
    """Distinct lower-case terms between marks, in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))


def dotted(c: Column) -> Column:
    """Lower-case dotted form: runs of other marks become one dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]+", "."), r"^\.+|\.+$", "")


def module_name(path: Column) -> Column:
    """Dotted module of a Python path: ``src`` roots and ``__init__`` dropped."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(?:src|lib|python)/", ""), r"(?:/__init__)?\.py$", "")
    return F.regexp_replace(bare, "/", ".")


def path_words(part: Column) -> Column:
    """A component of a path and its words, lower case."""
    low = F.lower(part)
    return F.concat(F.array(low), F.split(low, r"[_\-.]"))


def path_signal(path: Column) -> Column:
    """``example_or_demo_code``, ``third_party_or_vendored_code`` or null by path words."""
    parts = F.split(path, "/")
    folders = F.flatten(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), path_words))
    name = path_words(F.element_at(parts, -1))
    of = lambda words: F.array(*map(F.lit, words))
    named = tuple(w for w in EXAMPLE_WORDS if w != DIRECTORY_ONLY)
    example = F.arrays_overlap(folders, of(EXAMPLE_WORDS)) | F.arrays_overlap(name, of(named))
    foreign = F.arrays_overlap(F.concat(folders, name), of(THIRD_PARTY_WORDS))
    return F.when(example, F.lit("example_or_demo_code")).when(foreign, F.lit("third_party_or_vendored_code"))


def tag_category(tag: Column) -> Column:
    """``strict`` or ``lenient`` version tag, else ``other``."""
    t = F.trim(tag)
    return (
        F.when(t.rlike(r"^v?\d+\.\d+\.\d+$"), F.lit("strict"))
        .when(t.rlike(r"^(?:[A-Za-z]+[-_]?)?v?\d+(?:\.\d+)*(?:[-.]?(?:rc|a|b|alpha|beta|post|dev)\.?\d*)?$"), F.lit("lenient"))
        .otherwise(F.lit("other"))
    )


def version_parts(tag: Column) -> Column:
    """The numbers of a version tag, as longs."""
    return F.transform(F.regexp_extract_all(tag, F.lit(r"(\d{1,18})"), F.lit(1)), lambda x: x.cast("long"))


def human_number(c: Column) -> Column:
    """``12.5K`` to 12500.0; null where no number starts the text."""
    number = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*([KMBTkmbt]?)", 1)
    unit = F.upper(F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\s*([KMBTkmbt]?)", 2))
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    return F.when(number != "", number.cast("double") * scale)


def unquote(c: Column) -> Column:
    """Text without one matching pair of quotes around it."""
    return F.regexp_replace(c, r"""(?s)^(["'])(.*)\1$""", "$2")


def utc_time(c: Column) -> Column:
    """ISO text to a timestamp (date only counts as midnight UTC); else null."""
    t = F.trim(c)
    return F.coalesce(F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")))


def fingerprint(pairs: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys and string values."""
    parts = []
    for k in sorted(pairs):
        value = F.regexp_replace(F.regexp_replace(pairs[k].cast("string"), r"\\", r"\\\\"), '"', r'\\"')
        parts.append(F.concat(F.lit(f'"{k}":'), F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256))


def suffixes(chain: Column, mark: str = ".") -> Column:
    """All suffixes of a dotted chain on component borders, longest first."""
    parts = F.split(chain, "[.]" if mark == "." else mark)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), mark))


def keyword_hits(c: Column, keywords: tuple[str, ...]) -> Column:
    """The keywords that stand in a text as whole words, in the order given."""
    low = F.lower(c)
    return F.filter(F.array(*[F.when(low.rlike(rf"(?<![a-z0-9]){k}(?![a-z0-9])"), F.lit(k)) for k in keywords]), lambda x: x.isNotNull())


def overlapping_count(c: Column, needle: Column | str) -> Column:
    """How often a needle occurs, overlapping occurrences included."""
    quoted = F.regexp_replace(F.lit(needle) if isinstance(needle, str) else needle, r"([^A-Za-z0-9_])", r"\\$1")
    return F.regexp_count(c, F.concat(F.lit("(?="), quoted, F.lit(")")))
