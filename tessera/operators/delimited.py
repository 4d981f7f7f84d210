"""Fields that hold several values in one text.

The delimiter is inferred per source; a source is named by the data (a field of
a table, or who wrote it), never by the row's own separators.  A delimiter is a
class of separators, as one field may be fed by several writers.  Every class is
scored over all rows of the source by

* piece types: each piece outside quotes is a number, word, identifier, path,
  phrase (words with single blanks between them) or none of these; regularity is
  the share of pieces in the family of types that holds most of them, and
* piece counts: consistency is one less the relative spread of the rows' counts.

Regularity decides, as a piece of no type is wrong for certain; among classes
that are equal there consistency counts, less a small charge for each separator,
so that a class holds no separator which nothing speaks for.  Rows enter the
scoring as shapes (separators and one letter for each piece's type), counted per
source before the classes are tried, so the cost follows the number of distinct
shapes.  All of it is Catalyst expressions: no Python runs per row.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import stripped
from tessera.operators.skew import fragment_replicate_join
from tessera.sources.tables import cut_lineage

#: Separators as (name, characters).
SEPARATORS = (("bar", "|"), ("semicolon", ";"), ("comma", ","), ("newline", "\n\r"), ("tab", "\t"), ("space", " \x0b\x0c"))
#: Every class of separators as (names, characters); 63 of them.
CANDIDATES = tuple(
    ("+".join(n for n, _ in some), "".join(c for _, c in some)) for k in range(1, len(SEPARATORS) + 1) for some in combinations(SEPARATORS, k)
)
#: What one more separator in a class costs, in units of consistency.
SEPARATOR_CHARGE = 0.02
_CUT = chr(1)
#: Separators and their stand-ins while they are inside quotes (private use).
_PLAIN = ",;| \t\n\r"
_MASK = "".join(chr(0xE000 + i) for i in range(len(_PLAIN)))
#: A double-quoted run (two of them where a quote is doubled), a single-quoted one
#: in a list, or a run of other text.
_SEGMENT = r"""(?s)"[^"]*"|[^"]+|["]"""
_LIST_SEGMENT = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[^"']+|["']"""


def masked(field: Column) -> Column:
    """The field without list brackets, quoted separators replaced by stand-ins."""
    text = stripped(field)
    listed = text.startswith("[") & text.endswith("]")
    body = F.when(listed, F.regexp_replace(text, r"(?s)^\[(.*)\]$", "$1")).otherwise(text)

    def mask(pattern: str, quotes: tuple[str, ...]) -> Column:
        def one(s: Column) -> Column:
            quoted = reduce(lambda a, b: a | b, [s.startswith(q) & (F.length(s) > 1) & s.endswith(q) for q in quotes])
            return F.when(quoted, F.translate(s, _PLAIN, _MASK)).otherwise(s)

        return F.array_join(F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), one), "")

    # Most fields hold no quote and need no masking.
    return F.when(listed, mask(_LIST_SEGMENT, ('"', "'"))).when(text.contains('"'), mask(_SEGMENT, ('"',))).otherwise(text)


def unquoted(piece: Column, listed: Column) -> Column:
    """One piece without quoting and surrounding white space."""
    p = stripped(piece)
    double = p.startswith('"') & p.endswith('"') & (F.length(p) > 1)
    single = listed & p.startswith("'") & p.endswith("'") & (F.length(p) > 1)
    inner = F.substring(p, F.lit(2), F.greatest(F.length(p) - 2, F.lit(0)))
    escaped = lambda c: F.when(listed, F.regexp_replace(c, r"""\\(["'\\/])""", "$1")).otherwise(c)
    plain = (
        F.when(double, escaped(F.regexp_replace(inner, '""', '"')))
        .when(single, escaped(F.regexp_replace(inner, "''", "'")))
        .otherwise(p)
    )
    return stripped(F.translate(plain, _MASK, _PLAIN))


#: Types of pieces as (letter of the shape, regular expression), tried in turn.
_ALONE, _END = r"(?<![^\s,;|])", r"(?![^\s,;|])"
_TYPES = (
    ("number", chr(0xE010), r"[-+]?[0-9]++(?:[.][0-9]++)?"),
    ("word", chr(0xE011), r"\p{L}++"),
    ("quoted", chr(0xE012), r"\"(?:[^\"\s,;|]|\"\")*+\"|'[^'\s,;|]*+'"),
    ("path", chr(0xE013), r"[\p{L}\p{N}_.~@+-]++(?:[/:][\p{L}\p{N}_.~@+-]++)++"),
    ("name", chr(0xE014), r"[\p{L}\p{N}_.~@+#-]++"),
)
_OTHER = chr(0xE015)
_WORD = _TYPES[1][1]


def shape(masked_text: Column) -> Column:
    """Separators of a masked field, and a letter for the type of each run between them."""
    kept = "".join(letter for _, letter, _ in _TYPES)
    out = reduce(lambda t, x: F.regexp_replace(t, f"{_ALONE}(?:{x[2]}){_END}", x[1]), _TYPES, masked_text)
    out = F.regexp_replace(out, rf"{_ALONE}[^\s,;|{kept}][^\s,;|]*+|{_ALONE}[{kept}][^\s,;|]++", _OTHER)
    # Padding around other separators says nothing.
    return F.regexp_replace(F.regexp_replace(out, r"[\r\n]+", "\n"), r"[ \x0b\x0c]*([|;,\n\t])[ \x0b\x0c]*", "$1")


def infer_delimiters(rows: DataFrame) -> DataFrame:
    """The delimiter of each source: ``source_field, delimiter, chars, score``.

    ``rows`` has ``source_field`` and ``masked_text``.  ``delimiter`` names the
    class of separators, ``chars`` holds their characters, ``score`` is regularity
    plus consistency less charges.  All rows count; they are combined to shapes
    before the shuffle.
    """
    counted = rows.groupBy("source_field", shape(F.col("masked_text")).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    tried = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("delimiter"), F.lit(c).alias("chars"), F.lit(_CUT * len(c)).alias("cuts")) for i, (n, c) in enumerate(CANDIDATES)])
    each = counted.select("source_field", "s", "n", F.explode(tried).alias("c")).select("source_field", "n", "c.*", F.split(F.expr("translate(s, c.chars, c.cuts)"), f"{_CUT}+").alias("raw"))
    each = each.withColumn("p", F.filter(F.transform("raw", lambda x: F.trim(x)), lambda x: x != ""))
    of = lambda letters: F.size(F.filter("p", lambda x: x.rlike(f"^[{letters}]$")))
    letter = {name: sign for name, sign, _ in _TYPES}
    weigh = lambda c: F.sum(c.cast("double") * F.col("n"))
    size = F.size("p")
    stats = each.groupBy("source_field", "rank", "delimiter", "chars").agg(
        F.sum("n").alias("n"),
        weigh(size).alias("pieces"),
        weigh(size * size).alias("squares"),
        weigh(of(letter["quoted"])).alias("quoted"),
        weigh(of(letter["number"])).alias("numbers"),
        weigh(of(letter["number"] + letter["word"] + letter["path"] + letter["name"])).alias("names"),
        weigh(F.size(F.filter("p", lambda x: x.rlike(f"^{_WORD}(?: {_WORD})*$")))).alias("phrases"),
    )
    mean = F.col("pieces") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    regularity = F.round(F.when(F.col("pieces") > 0, (F.col("quoted") + F.greatest("numbers", "names", "phrases")) / F.col("pieces")).otherwise(1.0), 9)
    consistency = F.round(F.when(mean > 0, mean / (mean + spread)).otherwise(1.0), 9)
    charge = SEPARATOR_CHARGE * (F.length(F.regexp_replace("delimiter", "[^+]", "")) + 1)
    ranked = stats.select("source_field", F.struct((-regularity).alias("r"), (charge - consistency).alias("c"), "rank", "delimiter", "chars").alias("b"))
    best = ranked.groupBy("source_field").agg(F.min("b").alias("b"))
    return best.select("source_field", "b.delimiter", "b.chars", (-F.col("b.r") - F.col("b.c")).alias("score"))


def split_values(df: DataFrame, *, source_field: str, record_id: str, field: str) -> DataFrame:
    """One row per value of ``field``: ``source_field, record_id, item_pos, item_value``.

    ``record_id`` is the id column; several rows of one id with the same text
    count once (with different texts: the greatest text counts).  Null, blank
    and separator-only fields and ``[]`` give no rows.  Empty values are left
    out, ``item_pos`` counts the rest from 1, repeated values stay.  A quote
    that is never closed is an ordinary character.  An empty table gives an
    empty result; further columns of ``df`` are not read.
    """
    rows = (
        df.select(F.col(record_id).alias("record_id"), F.col(field).alias("field_text"))
        .where(F.col("record_id").isNotNull())
        .groupBy("record_id")
        .agg(F.max("field_text").alias("field_text"))
        .where(F.col("field_text").isNotNull())
        .withColumn("source_field", F.lit(source_field))
    )
    return split_fields(rows)


def mask_fields(rows: DataFrame) -> DataFrame:
    """``rows`` with ``listed`` and ``masked_text``, written once, as they are
    read for the inference and for the split."""
    text = stripped(F.col("field_text"))
    return cut_lineage(rows.withColumn("listed", text.startswith("[") & text.endswith("]")).withColumn("masked_text", masked(F.col("field_text"))))


#: Sources may be broadcast up to this many; beyond it they are joined.
BROADCAST_SOURCES = 100_000


def split_fields(rows: DataFrame) -> DataFrame:
    """As ``split_values`` over rows ``(source_field, record_id, field_text)``."""
    rows = mask_fields(rows)
    delimiters = cut_lineage(infer_delimiters(rows).select("source_field", "chars"))
    small = delimiters.count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(delimiters), "source_field") if small else fragment_replicate_join(rows, delimiters, "source_field")
    cut = F.expr(f"translate(masked_text, chars, repeat('{_CUT}', length(chars)))")
    values = F.filter(F.transform(F.split(cut, f"{_CUT}+"), lambda p: unquoted(p, F.col("listed"))), lambda v: v != "")
    return joined.select("source_field", "record_id", F.posexplode(values).alias("at", "item_value")).select(
        "source_field", "record_id", (F.col("at") + 1).cast("long").alias("item_pos"), "item_value"
    )
