"""Canonical forms of keys, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space around a key: Java's \s lacks the no-break spaces.
_EDGE = r"^[\s\x{A0}\x{2007}\x{202F}\x{FEFF}]+|[\s\x{A0}\x{2007}\x{202F}\x{FEFF}]+$"


def stripped(c: Column | str) -> Column:
    """Text without surrounding white space of any kind; null stays null."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, _EDGE, "")


def snapshot_key(c: Column | str) -> Column:
    """Snapshot ids: without surrounding white space, in lower case."""
    return F.lower(stripped(c))


def canonical_path(c: Column | str) -> Column:
    """Single forward slashes, no leading ``./`` or ``/``; ``../`` stays."""
    c = F.col(c) if isinstance(c, str) else c
    slashes = F.regexp_replace(F.regexp_replace(c, r"\\", "/"), "/{2,}", "/")
    return F.regexp_replace(slashes, r"^(?:\./|/)+", "")


def author_key(c: Column | str) -> Column:
    """Model authors: lower case, no surrounding blanks, no leading ``~``."""
    return F.lower(stripped(F.regexp_replace(stripped(c), "^~+", "")))
