"""Queries over written forms, locations, ranges and ranked evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import forms as W
from tessera.functions import text as X
from tessera.functions.keys import author_key, canonical_path, snapshot_key, stripped
from tessera.operators.graph import connected_components
from tessera.operators.joins import latest_before
from tessera.operators.ranges import first_by_state, greedy_units, longest_prefix, range_join, ranked_within, replace_rows
from tessera.operators.scores import exact_quantile
from tessera.operators.sequence import carry_forward, next_in_sequence, running_sum, with_ordinal
from tessera.operators.skew import fragment_replicate_join
from tessera.operators.snapshot_diff import snapshot_changes
from tessera.plans.bindings import CHECK_STATES, _rename_sides
from tessera.sources.tables import cut_lineage, distinct_texts, table

# Names of arguments that take a model.
MODEL_ARGUMENTS = ("model", "model_name", "model_id", "deployment", "deployment_id", "deployment_name", "engine", "llm", "chat_model", "embedding_model", "small_model")


def _occurrences(spark, d, *columns: str) -> DataFrame:
    return table(spark, d, "model_id_occurrences").select("occurrence_id", *columns).distinct()


def _with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Join with the distinct model ids' forms; broadcast by their count, else spread."""
    return rows.join(F.broadcast(ids), key) if ids.count() * 192 <= 32 << 20 else fragment_replicate_join(rows, ids, key)


def _model_ids(spark, d) -> DataFrame:
    return table(spark, d, "model_id_occurrences").select(F.trim("canonical_model_id").alias("model_id")).where("model_id <> ''").distinct()


def search_queries(spark, d):
    """Four search texts per model, over the sizes of the files that hold it."""
    sizes = table(spark, d, "source_files").select("file_id", F.length("text").alias("n")).distinct()
    per = _occurrences(spark, d, "file_id", F.trim("canonical_model_id").alias("model_id")).where("model_id <> ''").join(sizes, "file_id").groupBy("model_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    forms = per.select("model_id", "lo", "hi", F.explode(W.search_forms(F.col("model_id"))).alias("f"))
    return forms.select("model_id", "f.form", "f.quote", W.query_text(F.col("f.literal"), F.col("lo"), F.col("hi")).alias("query"))


def root_ranges(spark, d):
    """Repositories whose files span all sizes at which a model is found; one root is unique."""
    files = table(spark, d, "source_files").select("file_id", "repository_id", F.length("text").alias("n")).distinct()
    rows = _occurrences(spark, d, "file_id", F.col("canonical_model_id").alias("model_id")).join(files, "file_id")
    per = rows.groupBy("model_id", "repository_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    whole = per.groupBy("model_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    roots = per.join(whole, ["model_id", "lo", "hi"]).groupBy("model_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n_roots"), F.min("repository_id").alias("root"))
    return roots.select("model_id", "lo", "hi", "n_roots", "root")


def vocabulary_ids(spark, d):
    """Model ids without blanks, numbered by first appearance."""
    rows = table(spark, d, "model_id_occurrences").select("occurrence_id", F.trim("canonical_model_id").alias("model_id")).where("model_id <> ''")
    seen = rows.groupBy("model_id").agg(F.min("occurrence_id").alias("first_id"), F.max("occurrence_id").alias("last_id"))
    return with_ordinal(seen, ["first_id", "model_id"], "ordinal_id", "model_%05d")


def first_last_paths(spark, d):
    """Where a stored file was seen first and last."""
    rows = table(spark, d, "snapshot_checks").where("stored_file_sha <> ''")
    return rows.groupBy("stored_file_sha").agg(F.min_by("file_path", "check_id").alias("first_path"), F.max_by("file_path", "check_id").alias("last_path"))


def file_addresses(spark, d):
    """Addresses of collected files taken apart and put together again."""
    rows = table(spark, d, "source_files").select("file_id", "repository", "commit_sha", "rel_path", "url").distinct()
    p = W.url_parts(F.col("url")).alias("p")
    built = W.location_url(F.concat(F.lit("https://git.example/"), "repository"), F.col("commit_sha"), canonical_path("rel_path"), F.lit(1))
    return rows.select("file_id", p, "commit_sha", built.alias("line_url")).select("file_id", "p.repository", "p.commit", "p.path", (F.col("p.commit") == F.col("commit_sha")).alias("same_commit"), "line_url")


def argument_matches(spark, d):
    """Quoted model arguments on lines that name a known model, whole or bare."""
    rows = _occurrences(spark, d, "line_text").select("occurrence_id", W.argument_value(W.keyword_value(F.col("line_text"), MODEL_ARGUMENTS)).alias("value")).where("value is not null")
    forms = _model_ids(spark, d).select("model_id", F.explode(F.array(F.struct(F.col("model_id").alias("value"), F.lit("full").alias("form")), F.struct(F.element_at(F.split("model_id", "/"), -1).alias("value"), F.lit("namespace_free").alias("form")))).alias("f")).select("model_id", "f.*").distinct()
    return _with_ids(rows, forms, "value").select("occurrence_id", "value", "model_id", "form")


def listed_values(spark, d):
    """Values of fields that hold a JSON list, without placeholders."""
    rows = table(spark, d, "source_files").select("file_id", F.trim("model_ids").alias("m")).where("m like '[%' and not contains(m, chr(39))").distinct()
    return rows.select("file_id", F.explode(W.plain_values(F.col("m"))).alias("value")).groupBy("value").agg(F.countDistinct("file_id").alias("n_files"))


def setting_keys(spark, d):
    """Keys that lines with a model set."""
    rows = _occurrences(spark, d, "line_text").select(W.setting_key(F.col("line_text")).alias("key"))
    return rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_lines"))


def author_terms(spark, d):
    """Terms of the models of each author, without stop-words."""
    ids = _model_ids(spark, d).select(author_key(F.split("model_id", "/")[0]).alias("author"), F.explode(W.sanitized_terms(F.element_at(F.split("model_id", "/"), -1))).alias("term"))
    return ids.groupBy("author", "term").agg(F.count(F.lit(1)).alias("n_models"))


def repository_slugs(spark, d):
    rows = table(spark, d, "repositories").select("repository_id", "name", "description").distinct()
    return rows.select("repository_id", W.slug(F.col("name")).alias("slug"), W.plain_markup(F.col("description")).alias("words")).distinct()


def ranked_captures(spark, d):
    """Captures of each repository within three days of each week's start, nearest first."""
    s = table(spark, d, "snapshots").where("repository_id is not null and captured_at is not null").select("repository_id", "snapshot_id", F.col("captured_at").alias("ts"), (F.unix_micros(F.col("captured_at").cast("timestamp")) / F.lit(1e6)).alias("seen"))
    spans = s.groupBy("repository_id").agg(F.date_trunc("week", F.min("ts")).alias("a"), F.date_trunc("week", F.max("ts")).alias("z"))
    targets = spans.select("repository_id", F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("t")).withColumn("row_id", F.concat_ws("@", F.col("repository_id").cast("string"), W.compact_time(F.col("t"))))
    targets = targets.withColumn("at", (F.unix_micros(F.col("t").cast("timestamp")) / F.lit(1e6)))
    out = ranked_within(targets, s, ["repository_id"], "at", "seen", "snapshot_id", tolerance=3 * 86400.0, exact_last=True)
    return out.select(F.col("row_id").alias("target"), "rank", F.col("value").alias("snapshot_id"), F.round("distance", 3).alias("distance"))


def nearest_folders(spark, d):
    """Listed files by the deepest folder above them that holds a collected file."""
    held = table(spark, d, "source_files").select(snapshot_key("snapshot_id").alias("sid"), F.regexp_replace(canonical_path("rel_path"), "/[^/]*$", "").alias("folder")).where("sid is not null").distinct()
    listed = table(spark, d, "files").select(snapshot_key("snapshot_id").alias("sid"), canonical_path("path").alias("path")).distinct().join(held.select("sid").distinct(), "sid", "left_semi")
    named = listed.where("path is not null").withColumn("row_id", F.concat_ws(":", "sid", "path"))
    found = longest_prefix(named, held, ["sid"], "path", "folder", "folder", mark="/")
    return found.groupBy("sid", F.coalesce("value_found", F.lit("")).alias("folder")).agg(F.count(F.lit(1)).alias("n_paths"))


def _python_lines(spark, d) -> DataFrame:
    files = distinct_texts(table(spark, d, "source_files").where("file_id is not null and text is not null").where(F.col("rel_path").endswith(".py")), ["file_id"], "text", ["file_id", "text"])
    return files.select("file_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("file_id", (F.col("at") + 1).alias("line_number"), "line")


def earlier_assignments(spark, d):
    """For each assignment: the last plain one of its name before, and branch ones since."""
    of = lambda k: F.regexp_extract("line", r"^([ ]*)([A-Za-z_][A-Za-z0-9_]*) = [^=]", k)
    rows = _python_lines(spark, d).select("file_id", "line_number", of(2).alias("name"), F.length(of(1)).alias("indent")).where("name <> ''")
    rows = cut_lineage(rows.withColumn("plain", F.when(F.col("indent") <= 4, F.col("line_number"))).withColumn("branch", (F.col("indent") > 4).cast("long")))
    keys, order = ["file_id", "name"], ["line_number"]
    counted = running_sum(rows, keys, order, "branch", "n_branches").withColumn("mark", F.when(F.col("plain").isNotNull(), F.struct(F.col("plain").alias("line"), F.col("n_branches").alias("n"))))
    carried = carry_forward(counted, keys, order, "mark", "last")
    # The row's own mark does not count: the row before it has what stood there.
    before = next_in_sequence(carried.withColumn("descending", -F.col("line_number")), keys, ["descending"], "last", "earlier")
    own = F.col("n_branches") - F.col("branch") - F.col("earlier.n")
    return before.where("earlier is not null").select("file_id", "name", "line_number", F.col("earlier.line").alias("plain_line"), own.alias("n_branches"))


def seed_ladder(spark, d):
    """Definitions that occurrences lie in: on the line, around it, or the module only."""
    defs = _python_lines(spark, d).select("file_id", "line_number", F.regexp_extract("line", r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)", 1).alias("name")).where("name <> ''")
    defs = defs.select("file_id", "line_number", F.struct("line_number", "name").alias("found"))
    occ = _occurrences(spark, d, "file_id", "line_number")
    known = table(spark, d, "source_files").where(F.col("rel_path").endswith(".py")).select("file_id").distinct()
    met = latest_before(occ.join(known, "file_id", "left_semi"), defs, ["file_id"], "line_number", "line_number", "found", order="occurrence_id")
    step = F.when(F.col("before_value.line_number") == F.col("line_number"), "line").when(F.col("before_value").isNotNull(), "span").otherwise("module")
    return met.select("occurrence_id", step.alias("step"), F.col("before_value.name").alias("name"))


def verified_contents(spark, d):
    """Collected texts against their listed row: size, content hash and blob hash."""
    f = table(spark, d, "source_files").where("text is not null").select(
        "file_id", snapshot_key("snapshot_id").alias("sid"), canonical_path("rel_path").alias("path"), F.octet_length("text").alias("n"), F.sha2("text", 256).alias("content"), "blob_sha"
    ).distinct()
    listed = table(spark, d, "files").groupBy(snapshot_key("snapshot_id").alias("sid"), canonical_path("path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.struct("loaded_at", "size_bytes", F.lower(stripped("content_sha256")).alias("c"), F.lower(stripped("git_blob_sha")).alias("b"))).alias("r"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return f.join(listed, ["sid", "path"], "left").select(
        "file_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), same(F.col("n"), F.col("r.size_bytes")).alias("same_size"), same(F.col("content"), F.col("r.c")).alias("same_content"), same(F.lower("blob_sha"), F.col("r.b")).alias("same_blob")
    )


def _pairs(spark, d) -> DataFrame:
    s = table(spark, d, "snapshots").where("repository_id is not null").groupBy(snapshot_key("snapshot_id").alias("sid")).agg(F.max(F.struct("loaded_at", "captured_at", "repository_id", "release_line")).alias("r")).select("sid", "r.*")
    return next_in_sequence(s, ["repository_id", "release_line"], ["captured_at", "sid"], "sid", "new_sid").where("new_sid is not null").select(F.col("sid").alias("old_sid"), "new_sid")


def pair_counts(spark, d):
    """Whether the models of two consecutive snapshots occur equally often."""
    files = table(spark, d, "source_files").select("file_id", snapshot_key("snapshot_id").alias("sid")).distinct()
    per = cut_lineage(_occurrences(spark, d, "file_id", F.col("canonical_model_id").alias("model_id")).join(files, "file_id").groupBy("sid", "model_id").agg(F.count(F.lit(1)).alias("n")))
    pairs = cut_lineage(_pairs(spark, d))
    side = lambda s: pairs.join(per.withColumnRenamed("sid", f"{s}_sid"), f"{s}_sid").withColumnRenamed("n", s)
    both = side("old").join(side("new"), ["old_sid", "new_sid", "model_id"], "full_outer")
    return both.groupBy("old_sid", "new_sid").agg(F.count(F.lit(1)).alias("n_models"), F.bool_or(~F.col("old").eqNullSafe(F.col("new"))).alias("differs"))


def _locations(spark, d) -> DataFrame:
    ch = snapshot_changes(table(spark, d, "files"), table(spark, d, "snapshots")).withColumn("top", F.split("path", "/")[0])
    kind = lambda *k: F.max(F.col("change_kind").isin(*k))
    per = ch.groupBy("old_snapshot_id", "new_snapshot_id", "top").agg(kind("removed", "changed").alias("o"), kind("added", "changed").alias("n"), kind("changed").alias("a"))
    return per.groupBy("old_snapshot_id", "new_snapshot_id").agg(F.count(F.lit(1)).alias("n_union"), F.count_if("o").alias("n_old"), F.count_if("n").alias("n_new"), F.count_if("a").alias("n_affected"))


def location_unions(spark, d):
    """Directories touched per pair of snapshots, in the old one, the new one, and in both."""
    return _locations(spark, d)


def breadth_summary(spark, d):
    """Pooled and median share of touched directories, over pairs."""
    per = cut_lineage(_locations(spark, d).withColumn("one", F.lit(1)).withColumn("share", F.col("n_affected") / F.col("n_union")).withColumn("affected", F.col("n_affected").cast("double")))
    some = F.when(F.col("n_old") > 0, F.col("n_affected"))
    out = per.agg(F.round(F.sum("n_affected") / F.sum("n_union"), 6).alias("pooled"), F.min(some).alias("least"), F.max(some).alias("greatest"), F.count_if(F.col("n_affected") >= 2).alias("n_several"), F.count_if(F.col("n_affected") == 0).alias("n_none"), F.count_if(F.col("n_old") == 0).alias("n_not_applicable"))
    middle = lambda c: exact_quantile(per, "one", c, 0.5).select(F.round("quantile", 6)).scalar()
    return out.withColumn("median_affected", middle("affected")).withColumn("median_share", middle("share"))


def collection_funnel(spark, d):
    """Distinct counts along the collection."""
    files, occ, rel = table(spark, d, "source_files"), table(spark, d, "model_id_occurrences"), table(spark, d, "releases")
    kept = files.join(occ.where("occurrence_decision = 'include'").select("file_id"), "file_id", "left_semi")
    steps = [
        ("repositories", table(spark, d, "repositories").select("repository_id")), ("snapshots", table(spark, d, "snapshots").select(snapshot_key("snapshot_id"))), ("releases", rel.select("release_id")),
        ("listed blobs", table(spark, d, "files").select(F.lower(stripped("git_blob_sha")))), ("collected files", files.select("file_id")), ("collected repositories", files.select("repository_id")),
        ("models", occ.select("canonical_model_id")), ("occurrences", occ.select("occurrence_id")), ("included files", kept.select("file_id")), ("included repositories", kept.select("repository_id")),
    ]
    return reduce(DataFrame.unionByName, [df.toDF("k").agg(F.countDistinct("k").alias("n")).select(F.lit(name).alias("step"), "n") for name, df in steps])


def retrieval_scores(spark, d):
    """Per model: files with an included occurrence against files that path words let through."""
    rows = _occurrences(spark, d, "file_id", "file_path", "occurrence_decision", F.col("canonical_model_id").alias("model_id"))
    per = rows.groupBy("model_id", "file_id").agg(F.bool_or(F.col("occurrence_decision") == "include").alias("gold"), F.bool_and(X.path_signal(canonical_path("file_path")).isNull()).alias("got"))
    case = cut_lineage(per.groupBy("model_id").agg(F.count_if("gold").alias("gold"), F.count_if("got").cast("double").alias("got"), F.count_if(F.col("gold") & F.col("got")).alias("both")).where("gold > 0").withColumn("one", F.lit(1)))
    out = case.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("both") > 0).alias("n_hit"), F.count_if(F.col("both") == F.col("gold")).alias("n_all"), F.round(F.avg(F.col("both") / F.col("gold")), 6).alias("mean_recall"))
    return out.withColumn("median_files", exact_quantile(case, "one", "got", 0.5).select("quantile").scalar())


def evidence_matches(spark, d):
    """The first occurrence on each line: full forms, then the leftmost."""
    rows = _occurrences(spark, d, "file_id", "line_number", "variant_form", "column_start", "canonical_model_id")
    order = F.struct((F.col("variant_form") != "full").alias("f"), "column_start", "occurrence_id")
    return rows.groupBy("file_id", "line_number").agg(F.min_by(F.struct("occurrence_id", "canonical_model_id"), order).alias("b"), F.count(F.lit(1)).alias("n")).select("file_id", "line_number", "b.occurrence_id", "b.canonical_model_id", "n")


def selected_checks(spark, d):
    """The check of the best state per repository."""
    rows = table(spark, d, "snapshot_checks").withColumn("repository", F.lower("repository_full_name")).where("repository is not null")
    return first_by_state(rows, ["repository"], "latest_snapshot_status", CHECK_STATES, ["check_id"], "check_id")


def case_results(spark, d):
    """Files and folders of each repository's checks, and how they ended."""
    rows = table(spark, d, "snapshot_checks").withColumn("repository", F.lower("repository_full_name")).where("repository is not null")
    s = F.col("latest_snapshot_status")
    per = rows.groupBy("repository").agg(
        F.countDistinct("file_path").alias("n_files"), F.countDistinct(F.split("file_path", "/")[0]).alias("n_folders"), F.min("check_id").alias("first_check"),
        F.bool_or(s == CHECK_STATES[0]).alias("kept"), F.bool_or(s == CHECK_STATES[1]).alias("changed"),
    )
    return per.select("repository", "n_files", "n_folders", "first_check", F.when(F.col("kept"), "kept").when(F.col("changed"), "changed").otherwise("gone").alias("status"))


def change_events(spark, d):
    """One event per pair and directory that lost and gained files, with a fixed id."""
    ch = snapshot_changes(table(spark, d, "files"), table(spark, d, "snapshots")).where("change_kind <> 'changed'")
    side = lambda k: F.min(F.when(F.col("change_kind") == k, F.col("path")))
    n = lambda k: F.count_if(F.col("change_kind") == k)
    per = ch.groupBy("old_snapshot_id", "new_snapshot_id", F.split("path", "/")[0].alias("top")).agg(side("removed").alias("old_path"), side("added").alias("new_path"), n("removed").alias("n_old"), n("added").alias("n_new"))
    per = per.where("n_old > 0 and n_new > 0")
    return per.withColumn("event_id", F.sha2(F.concat_ws("|", "old_snapshot_id", "new_snapshot_id", "top", "old_path", "new_path"), 256))


def location_order(spark, d):
    """Places of a model in the order of their texts, in which ``a:10`` comes before ``a:9``."""
    rows = _occurrences(spark, d, F.col("canonical_model_id").alias("model_id"), F.concat_ws(":", canonical_path("file_path"), F.col("line_number").cast("string")).alias("place")).where("model_id is not null")
    places = rows.select("model_id", "place").distinct().withColumn("one", F.lit(1).cast("long"))
    return running_sum(places, ["model_id"], ["place"], "one", "rank").select("model_id", "place", "rank")


def replaced_signals(spark, d):
    """Recorded path signals, with those that are missing worked out anew."""
    rows = _occurrences(spark, d, "file_path", "path_signal")
    blank = F.coalesce(stripped("path_signal"), F.lit("")) == ""
    fresh = rows.where(blank).select("occurrence_id", F.coalesce(X.path_signal(canonical_path("file_path")), F.lit("none")).alias("signal"), F.lit("computed").alias("source"))
    kept = rows.select("occurrence_id", F.col("path_signal").alias("signal"), F.lit("recorded").alias("source"))
    return replace_rows(kept, fresh, ["occurrence_id"]).groupBy("signal", "source").agg(F.count(F.lit(1)).alias("n_rows"))


def seed_rows(spark, d):
    """Occurrences and imports of known interfaces in one shape."""
    occ = _occurrences(spark, d, "file_id", "line_number", "canonical_model_id", "variant_form").select(F.lit("model").alias("kind"), "file_id", "line_number", F.col("canonical_model_id").alias("primary_name"), F.col("variant_form").alias("secondary_name"))
    root = F.regexp_extract("line", r"^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    lines = _python_lines(spark, d).select("file_id", "line_number", root.alias("primary_name"), F.regexp_extract("line", r"\bimport\s+([A-Za-z_][A-Za-z0-9_.]*)", 1).alias("secondary_name")).where("primary_name <> ''")
    origins = table(spark, d, "author_interfaces").select(F.col("interface_origin").alias("primary_name")).distinct()
    own = table(spark, d, "source_files").where(F.col("rel_path").endswith(".py")).select("file_id", F.split(X.module_name(canonical_path("rel_path")), "[.]")[0].alias("primary_name")).distinct()
    known = lines.join(origins, "primary_name", "left_semi").join(own, ["file_id", "primary_name"], "left_anti").select(F.lit("import").alias("kind"), "file_id", "line_number", "primary_name", "secondary_name")
    details = F.to_json(F.struct(F.col("primary_name").alias("primary"), F.col("secondary_name").alias("secondary"))).alias("details")
    return occ.unionByName(known).select("kind", "file_id", "line_number", details)


def greedy_additions(spark, d):
    """Added files that take the places of removed ones of their kind, in path order."""
    old, new = _rename_sides(spark, d)
    kind = F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("kind")
    units = old.select("pair", kind).groupBy("pair", "kind").agg(F.count(F.lit(1)).alias("units"))
    out = greedy_units(new.select("pair", kind, "path"), units, ["pair", "kind"], ["path"])
    return out.select("pair", "path", "taken")


def different_contents(spark, d):
    """Files that are alone in their folder on both sides of a pair and differ in content."""
    old, new = _rename_sides(spark, d)
    folder = F.regexp_replace("path", "[^/]*$", "")
    alone = lambda df, s: df.groupBy("pair", folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias(f"{s}_path"), F.min("c").alias(f"{s}_c")).where("n = 1").drop("n")
    return alone(old, "old").join(alone(new, "new"), ["pair", "folder"]).where("old_c <> new_c").select("pair", "old_path", "new_path")


def block_occurrences(spark, d):
    """Blocks of lines between empty lines that hold occurrences, and how many."""
    files = distinct_texts(table(spark, d, "source_files").where("file_id is not null and text is not null"), ["file_id"], "text", ["file_id", "text"])
    parts = files.select("file_id", F.posexplode(F.split("text", "\n\n")).alias("block", "part")).select("file_id", "block", (F.regexp_count("part", F.lit("\n")) + 2).cast("long").alias("n"))
    spans = running_sum(parts, ["file_id"], ["block"], "n", "upto").select("file_id", "block", (F.col("upto") - F.col("n") + 1).alias("first_line"), (F.col("upto") - 1).alias("last_line"))
    met = range_join(_occurrences(spark, d, "file_id", F.col("line_number").cast("long").alias("line_number")), spans, ["file_id"], "line_number", "first_line", "last_line", cell=64)
    return met.groupBy("file_id", "block", "first_line", "last_line").agg(F.count(F.lit(1)).alias("n_occurrences"), (F.count(F.lit(1)) == 1).alias("alone"))


def line_predicates(spark, d):
    """Occurrences by what their value, path and line look like."""
    rows = _occurrences(spark, d, "matched_text", "file_path", "line_text")
    callee = F.regexp_extract("line_text", r"([A-Za-z_][A-Za-z0-9_]*)\(", 1)
    low = F.lower("file_path")
    foreign = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in X.THIRD_PARTY_WORDS])
    flags = rows.select(W.local_path(F.col("matched_text")).alias("local_value"), F.coalesce(foreign, F.lit(False)).alias("foreign_path"), (F.coalesce(W.reference_line(F.col("line_text"), callee), F.lit(False)) & (callee != "")).alias("call_line"))
    return flags.groupBy("local_value", "foreign_path", "call_line").agg(F.count(F.lit(1)).alias("n_occurrences"))


def occurrence_exclusions(spark, d):
    """Occurrences left out by path or context, worked out and as recorded."""
    rows = _occurrences(spark, d, "file_path", "source_context", "excluded_from_main_queue")
    out = X.path_signal(canonical_path("file_path")).isNotNull() | F.col("source_context").isin("comment", "docstring")
    return rows.groupBy(F.coalesce(out, F.lit(False)).alias("excluded"), F.col("excluded_from_main_queue").alias("recorded")).agg(F.count(F.lit(1)).alias("n_occurrences"))


def candidate_components(spark, d):
    """Removed and added files of a pair that hang together by content, name or folder.

    Files and what they share are nodes, so no pair of files is built."""
    old, new = _rename_sides(spark, d)
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "[^/]*$", "")
    relation = lambda n, v: F.struct(F.lit(n).alias("relation"), v.alias("v"))
    rows = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new"))).withColumn("node", F.concat_ws("|", "pair", "side", "path"))
    keys = rows.select("pair", "side", "node", F.explode(F.array(relation("content", F.col("c")), relation("name", name), relation("folder", folder))).alias("k")).where("k.v is not null")
    edges = cut_lineage(keys.select("pair", "side", "node", F.concat_ws("|", F.lit("="), "pair", "k.relation", "k.v").alias("key")))
    comp = connected_components(edges, "node", "key")
    met = edges.select("pair", "side", "node").distinct().join(comp, "node").groupBy("pair", "component").agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new"))
    return met.where("n_old > 0 and n_new > 0").groupBy("pair", "n_old", "n_new").agg(F.count(F.lit(1)).alias("n_components"))


QUERIES = {
    f.__name__: f
    for f in (
        search_queries, root_ranges, vocabulary_ids, first_last_paths, file_addresses, argument_matches, listed_values, setting_keys, author_terms, repository_slugs, ranked_captures,
        nearest_folders, earlier_assignments, seed_ladder, verified_contents, pair_counts, location_unions, breadth_summary, collection_funnel, retrieval_scores, evidence_matches,
        selected_checks, case_results, change_events, location_order, replaced_signals, seed_rows, greedy_additions, different_contents, block_occurrences, line_predicates, occurrence_exclusions, candidate_components,
    )
}
