"""Visually identical text with different characters: one consistent form.

Compatibility normalisation to composed form, mapped white space, removal of
default-ignorable characters, look-alike letters mapped within mixed words, and
full case folding for comparison.  ASCII text is in that form already but for
case; other text is worked on once per distinct run of non-space characters in
a batch, so cost follows the number of distinct odd words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones.
CYRILLIC_LIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "Ӏ": "I", "ё": "ë", "ї": "ï",
}
GREEK_LIKE = {
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "ε": "e", "γ": "y", "η": "n", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
}
_LIKE = str.maketrans(CYRILLIC_LIKE | GREEK_LIKE)
# Spaces that become an ordinary one (tab and newline stay).
_SPACES = "".join(map(chr, [0xB, 0xC, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Default-ignorable code points as ranges.
_IGNORABLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
_IGNORABLE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _IGNORABLE_RANGES)
#: Those that report a text as odd: zero-width, soft hyphen, byte-order mark,
#: direction marks.  Variation selectors are removed without being reported.
_INVISIBLE = "".join(f"{chr(a)}-{chr(b)}" for a, b in _IGNORABLE_RANGES if (a, b) not in ((0xFE00, 0xFE0F), (0xE0000, 0xE0FFF), (0x180B, 0x180F)))
_ZWJ, _VS16, _KEEP, _KEEP_VS = chr(0x200D), chr(0xFE0F), chr(0xE000), chr(0xE001)  # the last two: stand-ins while ignorables go
_HYPHEN, _NB_HYPHEN = chr(0x2010), chr(0x2011)


def _class(*ranges: tuple[int, int]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


_EMOJI = _class((0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x24C2, 0x24C2), (0x25A0, 0x27BF),
                (0x2934, 0x2935), (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF))
_JOINED = re.compile(f"(?:(?<=[{_EMOJI}])|(?<=[{_EMOJI}]{_VS16})){_ZWJ}(?=[{_EMOJI}])")
_PRESENTED = re.compile(f"(?<=[{_EMOJI}#*0-9]){_VS16}")
_IGNORE = re.compile(f"[{_IGNORABLE}]")
_SEEN_INVISIBLE = re.compile(f"[{_INVISIBLE}]")
_SPACE = re.compile(f"[{_SPACES}]")
_ODD_RUN = re.compile(r"[!-~]*[^\x00-\x7f\s][^\s]*")
_MARKS = _class((0x300, 0x36F), (0x483, 0x487), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F))
_MARKED = re.compile(rf"[^\W\d_][{_MARKS}]+")
_WIDE = re.compile(f"[{_class((0xFF01, 0xFF5E), (0xFF5F, 0xFF60), (0xFFE0, 0xFFE6), (0xFB00, 0xFB06), (0xFB13, 0xFB17))}]")
_WORD = re.compile(rf"(?:[^\W_]|[{_MARKS}])+")
_OTHER = re.compile(f"[{_class((0x370, 0x3FF), (0x1F00, 0x1FFF), (0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))}]")
_LATIN = re.compile(f"[A-Za-z{_class((0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF))}]")
WORDS = re.compile(r"[^\W_]+")

CLASSES = ("wide", "decomposed", "invisible", "space", "hyphen", "mixed_script")


def _mixed(m: re.Match) -> str:
    w = m.group()
    return w.translate(_LIKE) if _OTHER.search(w) and _LATIN.search(w) else w


def _odd_form(run: str) -> str:
    """The form of one run of non-space characters."""
    t = _JOINED.sub(_KEEP, run.replace(_KEEP, "").replace(_KEEP_VS, ""))
    t = _PRESENTED.sub(_KEEP_VS, t)
    t = _IGNORE.sub("", t).replace(_NB_HYPHEN, "-")
    t = unicodedata.normalize("NFKC", t).replace(_HYPHEN, "-")
    if _OTHER.search(t):
        t = _WORD.sub(_mixed, t)
    return unicodedata.normalize("NFC", t).replace(_KEEP, _ZWJ).replace(_KEEP_VS, _VS16)


def consistent(text: str, cache: dict[str, str] | None = None) -> str:
    """The consistent form of a text, case kept."""
    if text.isascii():
        return _SPACE.sub(" ", text)
    cache = {} if cache is None else cache

    def one(m: re.Match) -> str:
        run = m.group()
        got = cache.get(run)
        if got is None:
            if len(cache) > 200_000:
                cache.clear()
            got = cache[run] = _odd_form(run)
        return got

    return _ODD_RUN.sub(one, _SPACE.sub(" ", text))


def folded(form: str) -> str:
    """Full case folding of a consistent form, composed again."""
    return unicodedata.normalize("NFKC", form.casefold()) if not form.isascii() else form.lower()


def oddities(text: str) -> list[str]:
    """Which classes of odd characters a text holds."""
    if text.isascii():
        return ["space"] if _SPACE.search(text) else []
    found = []
    if _WIDE.search(text):
        found.append("wide")
    if any(len(unicodedata.normalize("NFC", m)) < len(m) for m in _MARKED.findall(text)):
        found.append("decomposed")
    if _SEEN_INVISIBLE.search(text) and _SEEN_INVISIBLE.search(_JOINED.sub("", text)):
        found.append("invisible")
    if _SPACE.search(text):
        found.append("space")
    if _NB_HYPHEN in text:
        found.append("hyphen")
    if _OTHER.search(text) and any(_OTHER.search(w) and _LATIN.search(w) for w in _WORD.findall(text)):
        found.append("mixed_script")
    return found


UNIFIED = T.StructType([T.StructField("form", T.StringType()), T.StructField("folded", T.StringType()), T.StructField("oddities", T.ArrayType(T.StringType()))])


@F.pandas_udf(UNIFIED)
def _unify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    cache: dict[str, str] = {}
    for texts in batches:
        codes, distinct = pd.factorize(texts)
        forms = [consistent(t, cache) for t in distinct]
        # A text in the consistent form holds nothing odd.
        rows = [(f, folded(f), oddities(t) if f != t else []) for t, f in zip(distinct, forms)] + [(None, None, None)]
        yield pd.DataFrame([rows[c] for c in codes], columns=["form", "folded", "oddities"])


def canonical_words(text: str, cache: dict[str, str] | None = None) -> str:
    """Words of the folded form, joined by single spaces."""
    return " ".join(WORDS.findall(folded(consistent(text, cache))))


@F.pandas_udf(T.StringType())
def words_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Column form of ``canonical_words``; null stays null."""
    cache: dict[str, str] = {}
    for texts in batches:
        codes, distinct = pd.factorize(texts)
        done = [canonical_words(t, cache) for t in distinct] + [None]
        yield pd.Series([done[c] for c in codes], dtype=object)


def unify(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``form``, ``folded`` and ``oddities`` of column ``text``.

    Null text gives nulls and the empty text itself with no oddity.  Existing
    columns of those names are refused.  The form is idempotent.
    """
    clash = {c.lower() for c in df.columns} & {"form", "folded", "oddities"}
    if clash:
        raise ValueError(f"columns of reserved names: {sorted(clash)}")
    return df.withColumn("__u", _unify(F.col(text))).select("*", "__u.form", "__u.folded", "__u.oddities").drop("__u")
