"""Queries of the text problems, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.leakage import leaked_passages
from tessera.llm.packing import container_use, pack_documents
from tessera.llm.parsing import check_syntax, one_per_file, syntax_rates
from tessera.llm.provenance import file_origins
from tessera.llm.credentials import scan_secrets
from tessera.llm.unify import unify
from tessera.sources.tables import spread, table


def _judged(spark: SparkSession, d: str) -> DataFrame:
    files = spread(table(spark, d, "source_files").select("file_id", "repository_id", "rel_path", "text", "parse_error"))
    return check_syntax(files, keys=["file_id", "repository_id", "parse_error"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where(~F.col("valid") & F.col("file_id").isNotNull()).select("file_id").distinct()


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Invalid files per repository and language."""
    one = one_per_file(_judged(spark, d), "file_id")
    return syntax_rates(one, ["repository_id", "grammar"])


def p1_causes(spark: SparkSession, d: str) -> DataFrame:
    """Files per grammar, cause and grammar that parses; and how many of them
    an earlier run's parse_error had right."""
    one = one_per_file(_judged(spark, d), "file_id")
    said = F.coalesce(F.trim("parse_error"), F.lit("")) != ""
    return one.where(F.col("valid").isNotNull()).groupBy("grammar", "cause", "parsed_as").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(said == ~F.col("valid")).alias("n_recorded_right")
    )


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    files = scan_secrets(spread(table(spark, d, "source_files").select("file_id", "text")), keys=["file_id"], text="text")
    lines = scan_secrets(table(spark, d, "model_id_occurrences").select("occurrence_id", "line_text"), keys=["occurrence_id"], text="line_text")
    a = files.select(F.lit("source_files").alias("table_name"), F.col("file_id").alias("record_id"), "cases", "redacted")
    b = lines.select(F.lit("model_id_occurrences").alias("table_name"), F.col("occurrence_id").alias("record_id"), "cases", "redacted")
    return a.unionByName(b).where(F.col("record_id").isNotNull())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select("table_name", "record_id", F.explode("cases.line_no").alias("line_no")).distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text without its credentials, and how many it held."""
    one = _scanned(spark, d).select("table_name", "record_id", F.size("cases").alias("n_cases"), "redacted")
    # Texts delivered twice agree; of texts that differ the one with more cases counts.
    return one.groupBy("table_name", "record_id").agg(F.max(F.struct("n_cases", "redacted")).alias("r")).select("table_name", "record_id", "r.n_cases", "r.redacted")


def p7_origins(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not hand-written, by origin and evidence."""
    return file_origins(spread(table(spark, d, "source_files").select("file_id", "repository_id", "repository", "rel_path", "text")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_origins(spark, d).select("file_id").distinct()


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents").select("doc_id", "text"))


def p8_use(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their fill, and the fewest that could hold the same."""
    return container_use(p8_packed(spark, d), size="n_tokens", capacity=2048)


def p9_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All verified pairs, also those with edits."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    items = table(spark, d, "eval_items").select("item_id", "text")
    return leaked_passages(docs, items)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_pairs(spark, d).where("exact").select("doc_id", "item_id")


def p10_unified(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every document."""
    return unify(spread(table(spark, d, "documents").select("doc_id", "text")), "text").drop("text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text").where(F.col("doc_id").isNotNull()))
    # The form decides; the classes then leave out forms that only look alike in part (a raised 2).
    return unify(docs, "text").where((F.col("form") != F.col("text")) & (F.size("oddities") > 0)).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p1_causes, p2_found, p2_redacted, p7_found, p7_origins, p8_packed, p8_use, p9_found, p9_pairs, p10_found, p10_unified)}
ORACLES: dict[str, str] = {
    "p10_found": r"""SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND (
        regexp_matches(text, '[\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}]')
        OR (regexp_matches(text, '\pL\pM') AND length(nfc_normalize(text)) < length(text))
        OR regexp_matches(regexp_replace(text, '([\x{2190}-\x{27BF}\x{1F000}-\x{1FAFF}]\x{FE0F}?)\x{200D}([\x{2190}-\x{27BF}\x{1F000}-\x{1FAFF}])', '\1\2', 'g'),
            '[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}]')
        OR regexp_matches(text, '[\x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{2011}]')
        OR regexp_matches(text, '\p{Latin}[\pL\pN]*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}][\pL\pN]*\p{Latin}'))""",
}
