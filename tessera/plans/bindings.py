"""Queries over bindings, releases and repositories: the analytics core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.keys import author_key, canonical_path, snapshot_key, stripped
from tessera.operators.delimited import split_values
from tessera.operators.flow_allocation import allocate_units
from tessera.operators.graph import connected_components, distances, shortest_paths, spread_sets
from tessera.operators.joins import innermost_interval, latest_before, nearest_join, presence, quoted_tokens, set_differences, suffix_counts, unique_suffixes
from tessera.operators.matching import conservation, staged_matches, turnover_groups, unmatched
from tessera.operators.scores import any_per, confusion, paired_gains, runtime_summary
from tessera.operators.sequence import next_in_sequence
from tessera.operators.skew import fragment_replicate_join
from tessera.operators.snapshot_diff import snapshot_changes
from tessera.operators.summary import frequencies, group_summary, joined_sets, labelled_counts, share_within, spine_counts
from tessera.operators.syntax_context import classify_positions, literal_roles
from tessera.operators.value_flow import call_origins, loader_candidates, syntax_facts, trace_literals, trace_paths
from tessera.sources.tables import cut_lineage, distinct_texts, spread, table


def _interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Interface bindings, one row per id, with the canonical author."""
    return table(spark, d, "author_interfaces").distinct().withColumn("author", author_key("model_author"))


def interface_summary(spark, d):
    rows = _interfaces(spark, d)
    return group_summary(rows, ["author", "family_id"], entity="repository_id", flag=F.col("non_local_binding_count") > 0)


def origin_shares(spark, d):
    return share_within(_interfaces(spark, d), ["interface_origin"], ["author"])


def author_variety(spark, d):
    return _interfaces(spark, d).groupBy("author").agg(
        F.countDistinct("family_id").alias("n_families"), F.countDistinct("interface_origin").alias("n_origins"), F.sum("binding_count").cast("long").alias("n_bindings")
    )


def repository_rollup(spark, d):
    rows = _interfaces(spark, d).where(F.col("repository_id").isNotNull())
    sets = joined_sets(rows.where(F.col("author").isNotNull()), "repository_id", {"authors": "author", "families": "family_id"})
    per = rows.groupBy("repository_id").agg(F.sum("binding_count").cast("long").alias("n_bindings"), F.max(F.col("non_local_binding_count") > 0).alias("has_non_local"))
    return per.join(sets, "repository_id", "left")


def locality_labels(spark, d):
    local, other = F.col("local_binding_count") > 0, F.col("non_local_binding_count") > 0
    return labelled_counts(_interfaces(spark, d), {"local_only": local & ~other, "non_local_only": ~local & other, "both": local & other, "neither": ~local & ~other, "any_non_local": other})


def integration_scalars(spark, d):
    rows = _interfaces(spark, d)
    families = rows.where("repository_id is not null").groupBy("repository_id").agg(F.countDistinct("family_id").alias("n"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("repository_id").alias("n_repositories"),
        F.countDistinct(F.when(F.col("non_local_binding_count") > 0, F.col("repository_id"))).alias("n_with_non_local"),
        F.sum("binding_count").cast("long").alias("n_bindings"),
    ).withColumn("n_several_families", families.agg(F.count_if(F.col("n") > 1)).scalar())


def context_counts(spark, d):
    rows = table(spark, d, "model_id_occurrences").distinct()
    return rows.groupBy(F.coalesce("source_context", F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


CHECK_STATES = ["matches_latest_snapshot", "changed_at_latest_snapshot", "missing_at_latest_snapshot"]
SOURCE_STATES = ["matches_source_snapshot", "source_snapshot_mismatch", "source_snapshot_missing"]


def check_states(spark, d):
    rows = table(spark, d, "snapshot_checks").distinct()
    return spine_counts(rows, "source_snapshot_status", SOURCE_STATES, "latest_snapshot_status", CHECK_STATES)


def collapsed_checks(spark, d):
    rows = table(spark, d, "snapshot_checks").distinct().withColumn("repository", F.lower("repository_full_name"))
    same = (F.col("latest_snapshot_file_sha") == F.col("stored_file_sha")) & (F.col("latest_snapshot_status") != "missing_at_latest_snapshot")
    return rows.groupBy("repository").agg(
        F.bool_and(F.coalesce(same, F.lit(False))).alias("unchanged"), F.countDistinct("latest_snapshot_commit_sha").alias("n_commits"), F.count(F.lit(1)).alias("n_checks")
    )


def _repositories(spark, d):
    """One row per repository: the latest collected (unreadable times first)."""
    rows = table(spark, d, "repositories")
    order = F.struct(F.coalesce(X.utc_time(F.col("metadata_collected_at")), F.to_timestamp(F.lit("1970-01-01 00:00:00"))), F.coalesce("stars", F.lit(-1)), F.coalesce("forks", F.lit(-1)))
    return rows.groupBy("repository_id").agg(F.max_by(F.struct("name", "language", "stars", "forks", "deleted_at"), order).alias("r")).select("repository_id", "r.*")


def binding_records(spark, d):
    occ = table(spark, d, "model_id_occurrences").select("occurrence_id", "file_id", "canonical_model_id", "line_number").distinct()
    files = table(spark, d, "source_files").select("file_id", "repository_id", "snapshot_id", "rel_path").distinct()
    snaps = table(spark, d, "snapshots").select(snapshot_key("snapshot_id").alias("sid"), "release_line").distinct()
    names = table(spark, d, "repositories").groupBy("repository_id").agg(F.max("name").alias("name"))
    return (
        occ.join(files, "file_id")
        .join(names, "repository_id")
        .join(snaps, snapshot_key("snapshot_id") == F.col("sid"))
        .select("occurrence_id", "canonical_model_id", "name", "release_line", "rel_path", "line_number")
    )


def confirmed_repositories(spark, d):
    names = table(spark, d, "repositories").select("repository_id").distinct()
    occ = table(spark, d, "model_id_occurrences").where("occurrence_decision = 'include'").select("file_id")
    used = table(spark, d, "source_files").select("file_id", "repository_id").join(occ, "file_id", "left_semi")
    yes = names.join(used, "repository_id", "left_semi").withColumn("confirmed", F.lit(True))
    return yes.unionByName(names.join(used, "repository_id", "left_anti").withColumn("confirmed", F.lit(False)))


def discovered_authors(spark, d):
    a = _interfaces(spark, d).select("author")
    b = table(spark, d, "model_id_occurrences").select(author_key(F.split("canonical_model_id", "/")[0]).alias("author"))
    return presence(a, b, "author")


def listing_differences(spark, d):
    """Files of the collection without a row in the listings, and their texts' ids."""
    a = table(spark, d, "source_files").select(snapshot_key("snapshot_id").alias("sid"), canonical_path("rel_path").alias("path"))
    b = table(spark, d, "files").select(snapshot_key("snapshot_id").alias("sid"), canonical_path("path").alias("path")).join(a.select("sid").distinct(), "sid", "left_semi")
    return set_differences(a, b, ["sid", "path"]).groupBy("sid", "side").agg(F.count(F.lit(1)).alias("n_paths"))


def _modules(spark, d):
    files = table(spark, d, "source_files").where(F.col("rel_path").endswith(".py"))
    return files.select("repository_id", X.module_name(F.col("rel_path")).alias("module")).distinct()


def module_aliases(spark, d):
    return unique_suffixes(_modules(spark, d), ["repository_id"], "module")


def module_rules(spark, d):
    """Modules of the listings under the two-part endings of collected modules."""
    listed = table(spark, d, "files").where(F.col("path").endswith(".py")).select(X.module_name(canonical_path("path")).alias("chain"))
    parts = F.split("module", "[.]")
    rules = _modules(spark, d).where(F.size(parts) >= 2).select(F.array_join(F.slice(parts, -2, 2), ".").alias("rule")).distinct()
    return suffix_counts(listed, rules, "chain", "rule").withColumnRenamed("by", "met_by")


def _events(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))


def nearest_views(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("row_id"), "user_id", "at")
    right = e.where("event_type = 'view'").select("user_id", F.col("at").alias("seen_at"), "event_id")
    out = nearest_join(left, right, ["user_id"], "at", "seen_at", "event_id", tolerance=6 * 3600.0)
    return out.select("row_id", F.col("near_value").alias("view_id"), F.round("near_distance", 3).alias("distance"))


def latest_views(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'view'").select("user_id", F.col("at").alias("seen_at"), F.col("event_id").alias("view_id"))
    return latest_before(left, right, ["user_id"], "at", "seen_at", "view_id", order="event_id").select("event_id", F.col("before_value").alias("view_id"))


def innermost_priority(spark, d):
    """The priority whose span of order dates encloses an order most tightly."""
    o = table(spark, d, "orders").withColumn("day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")))
    spans = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("day").alias("s"), F.max("day").alias("e"))
    points = o.select(F.col("o_orderkey").alias("row_id"), "o_custkey", "day")
    return innermost_interval(points, spans, ["o_custkey"], "day", "s", "e", "o_orderpriority", cell=365).select("row_id", F.col("inside").alias("priority"))


def needle_lines(spark, d):
    """Quoted model ids on source lines, met by equality with the vocabulary."""
    ids = table(spark, d, "model_id_occurrences").select(F.col("canonical_model_id").alias("model_id")).where("model_id is not null").distinct()
    needles = ids.select("model_id", F.explode(F.array(F.struct(F.col("model_id").alias("needle"), F.lit("full").alias("form")), F.struct(F.element_at(F.split("model_id", "/"), -1).alias("needle"), F.lit("namespace_free").alias("form")))).alias("n")).select("model_id", "n.*").distinct()
    files = distinct_texts(table(spark, d, "source_files").where("file_id is not null and text is not null"), ["file_id"], "text", ["file_id", "text"])
    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike("[\"']"))
    tokens = lines.select("file_id", (F.col("at") + 1).alias("line_number"), F.explode(quoted_tokens(F.col("line"))).alias("needle"))
    # A few models are named on most lines: broadcast the counted vocabulary, or spread them.
    small = needles.count() * 96 <= 32 << 20
    met = tokens.join(F.broadcast(needles), "needle") if small else fragment_replicate_join(tokens, needles, "needle")
    return met.groupBy("file_id", "line_number", "model_id", "form").agg(F.count(F.lit(1)).alias("n_hits"))


def release_gaps(spark, d):
    """Stable releases per line: number, span and median gap in whole days."""
    rel = table(spark, d, "releases").groupBy("release_id").agg(F.max(F.struct("loaded_at", "snapshot_id", "published_at", "tag")).alias("r")).select("release_id", "r.*")
    snaps = table(spark, d, "snapshots").select(snapshot_key("snapshot_id").alias("sid"), "repository_id", "release_line").distinct()
    rows = rel.withColumn("at", X.utc_time(F.col("published_at"))).where(F.col("at").isNotNull() & ~F.lower("tag").rlike("rc|alpha|beta")).join(snaps, snapshot_key("snapshot_id") == F.col("sid"))
    rows = rows.select("repository_id", "release_line", "at", "release_id")
    gaps = next_in_sequence(rows, ["repository_id", "release_line"], ["at", "release_id"], "at", "next_at").withColumn("gap", F.floor((F.unix_seconds("next_at") - F.unix_seconds("at")) / 86400))
    return gaps.groupBy("repository_id", "release_line").agg(
        F.count(F.lit(1)).alias("n_releases"), F.floor((F.unix_seconds(F.max("at")) - F.unix_seconds(F.min("at"))) / 86400).alias("span_days"), F.percentile("gap", F.lit(0.5)).alias("median_gap")
    )


def tag_kinds(spark, d):
    rel = table(spark, d, "releases").select("release_id", "tag").distinct()
    return rel.select("release_id", "tag", X.tag_category(F.col("tag")).alias("category"), F.array_join(F.transform(X.version_parts(F.col("tag")), lambda x: x.cast("string")), ".").alias("version"))


def adjacent_snapshots(spark, d):
    s = table(spark, d, "snapshots").where("repository_id is not null").groupBy("snapshot_id").agg(F.max(F.struct("loaded_at", "captured_at", "repository_id", "release_line")).alias("r")).select("snapshot_id", "r.*")
    out = next_in_sequence(s, ["repository_id", "release_line"], ["captured_at", "snapshot_id"], "snapshot_id", "next_snapshot_id")
    return out.select("repository_id", "release_line", "snapshot_id", "next_snapshot_id")


def latest_commits(spark, d):
    s = table(spark, d, "snapshots").where("repository_id is not null")
    latest = s.groupBy("repository_id").agg(F.max("captured_at").alias("captured_at"))
    return s.join(latest, ["repository_id", "captured_at"]).groupBy("repository_id").agg(F.min("commit_sha").alias("commit_sha"))


def _weeks(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("week", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))


def weekly_shares(spark, d):
    """Mean weekly share of value per type over all weeks; absent weeks count 0."""
    e = _weeks(spark, d)
    per = e.groupBy("week", "event_type").agg(F.sum("value").alias("v"))
    # An absent week adds nothing, so the sum over all weeks is the spine's mean.
    rows = per.withColumn("s", F.try_divide("v", F.sum("v").over(Window.partitionBy("week"))))
    weeks = e.agg(F.countDistinct("week")).scalar()
    return rows.groupBy("event_type").agg(F.round(F.sum("s") / weeks, 6).alias("mean_share"), F.count_if(F.col("v") > 0).alias("observed_weeks"))


def user_ranking(spark, d):
    """Users seen in every week, ranked by their value."""
    e = _weeks(spark, d)
    weeks = e.agg(F.countDistinct("week")).scalar()
    per = e.groupBy("user_id").agg(F.countDistinct("week").alias("w"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    full = per.where(F.col("w") == weeks)
    top = full.orderBy(F.desc("cents"), "user_id").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cents"), "user_id"))).select("rank", "user_id", "cents")


def line_offsets(spark, d):
    """Character offset at which each line of a source file starts."""
    files = distinct_texts(table(spark, d, "source_files").where("file_id is not null and text is not null"), ["file_id"], "text", ["file_id", "text"])
    # Only lengths are shuffled; a window holds the lines of one file.
    lengths = files.select("file_id", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.length(x) + 1)).alias("at", "n"))
    before = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select("file_id", (F.col("at") + 1).alias("line_number"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("offset"))


def saturating_changes(spark, d):
    """Increases and decreases of event counts from each week to the next."""
    counts = _weeks(spark, d).groupBy("week", "event_type").agg(F.count(F.lit(1)).alias("n"))
    later = counts.select(F.date_format(F.date_add(F.to_date("week"), -7), "yyyy-MM-dd").alias("week"), "event_type", F.col("n").alias("n_next"))
    both = counts.join(later, ["week", "event_type"], "full_outer")
    a, b = F.coalesce("n", F.lit(0)), F.coalesce("n_next", F.lit(0))
    return both.select("week", "event_type", F.greatest(b - a, F.lit(0)).alias("increase"), F.greatest(a - b, F.lit(0)).alias("decrease"))


def path_signals(spark, d):
    rows = table(spark, d, "files").select(canonical_path("path").alias("path")).distinct()
    return rows.groupBy(F.coalesce(X.path_signal(F.col("path")), F.lit("none")).alias("signal")).agg(F.count(F.lit(1)).alias("n_paths"))


def identifier_words(spark, d):
    rows = table(spark, d, "model_id_occurrences").select("canonical_model_id").distinct()
    return rows.select(F.explode(X.terms(F.col("canonical_model_id"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_ids"))


def snapshot_fingerprints(spark, d):
    rows = table(spark, d, "snapshots").select("snapshot_id", "repository_id", "commit_sha").distinct()
    return rows.select("snapshot_id", X.fingerprint({"repository_id": F.col("repository_id"), "commit_sha": F.col("commit_sha")}).alias("fingerprint"))


def _renames(spark, d):
    """Removed (old) and added (new) files per snapshot pair, with their hashes."""
    changes = snapshot_changes(table(spark, d, "files"), table(spark, d, "snapshots")).where("change_kind <> 'changed'")
    files = table(spark, d, "files").groupBy(snapshot_key("snapshot_id").alias("sid"), canonical_path("path").alias("path")).agg(
        F.max(F.struct("loaded_at", F.lower(stripped("content_sha256")).alias("c"), "size_bytes")).alias("r")
    )
    rows = changes.withColumn("sid", F.when(F.col("change_kind") == "removed", F.col("old_snapshot_id")).otherwise(F.col("new_snapshot_id")))
    rows = rows.join(files, ["sid", "path"]).select(
        F.concat_ws(">", "old_snapshot_id", "new_snapshot_id").alias("pair"), "path", "change_kind", F.col("r.c").alias("c"), F.col("r.size_bytes").alias("size")
    )
    return cut_lineage(rows)


def _rename_stages():
    name = F.element_at(F.split("path", "/"), -1)
    return [("content", F.col("c")), ("name_size", F.concat_ws(":", name, F.col("size").cast("string"))), ("name", name)]


def _rename_sides(spark, d):
    rows = _renames(spark, d)
    return rows.where("change_kind = 'removed'"), rows.where("change_kind = 'added'")


def renamed_files(spark, d):
    old, new = _rename_sides(spark, d)
    return staged_matches(old, new, "pair", "path", _rename_stages())


def rename_conservation(spark, d):
    """Removed and added files that matches and the rest do not hold exactly once."""
    old, new = _rename_sides(spark, d)
    matches = staged_matches(old, new, "pair", "path", _rename_stages())
    return conservation(old, new, matches, unmatched(old, new, matches, "pair", "path"), "pair", "path").select("pair", "path", "side", "what")


def replaced_extensions(spark, d):
    """Renames per pair taken as replacements of one kind of file by another
    directory's: how many fit into the units that each directory lost and gained."""
    old, new = _rename_sides(spark, d)
    kind = F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("k")
    top = F.split("path", "/")[0].alias("id")
    of = lambda df, n: df.groupBy("pair", kind, top).agg(F.count(F.lit(1)).alias(n))
    o, n = cut_lineage(of(old, "n_old")), cut_lineage(of(new, "n_new"))
    zero = lambda c: F.lit(0).cast("long").alias(c)
    counts = o.select("pair", "id", "n_old", zero("n_new")).unionByName(n.select("pair", "id", zero("n_old"), "n_new")).groupBy("pair", "id").agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
    # Files are counted per directory first, so two directories of a kind make one edge.
    edges = o.withColumnRenamed("id", "old_id").join(n.withColumnRenamed("id", "new_id"), ["pair", "k"]).where("old_id <> new_id")
    out = allocate_units(edges.select("pair", "old_id", "new_id", (F.col("n_old") * F.col("n_new")).alias("capacity")), counts, "pair")
    return out.groupBy("pair").agg(F.sum("capacity").alias("n_events"), F.sum("units").alias("n_allocated"))


def shared_commits(spark, d):
    """Components of commits and stored blobs that occur in one check."""
    rows = table(spark, d, "snapshot_checks").select("source_snapshot_commit_sha", "stored_file_sha").where("stored_file_sha <> '' and source_snapshot_commit_sha <> ''")
    return connected_components(rows, "source_snapshot_commit_sha", "stored_file_sha")


def _tree(spark, d):
    """Edges of the directory trees of collected files: parent -> child."""
    paths = table(spark, d, "source_files").select(F.concat_ws("/", F.col("repository_id").cast("string"), canonical_path("rel_path")).alias("p")).where("repository_id is not null").distinct()
    parts = F.split("p", "/")
    steps = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i - 1), "/").alias("up"), F.array_join(F.slice(parts, 1, i), "/").alias("down")))
    return paths.select(F.explode(steps).alias("s")).select("s.up", "s.down").distinct()


def tree_depths(spark, d):
    edges = _tree(spark, d)
    roots = edges.select(F.split("up", "/")[0].alias("node")).distinct()
    return distances(edges, roots, "up", "down", "node").groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


def model_directories(spark, d):
    """Directories above files with an occurrence, by the models below them."""
    files = table(spark, d, "source_files").select("file_id", F.concat_ws("/", F.col("repository_id").cast("string"), canonical_path("rel_path")).alias("p")).where("repository_id is not null").distinct()
    occ = table(spark, d, "model_id_occurrences").select("file_id", "canonical_model_id").distinct()
    seeds = files.join(occ, "file_id").select("p", F.split("canonical_model_id", "/")[0].alias("author"))
    return spread_sets(_tree(spark, d), seeds, "down", "up", "p", "author").groupBy(F.col("node").alias("directory")).agg(F.count(F.lit(1)).alias("n_authors"))


def signal_scores(spark, d):
    """The recorded path signal against the one by path words, overall and per repository."""
    occ = table(spark, d, "model_id_occurrences").select("occurrence_id", "file_id", "file_path", "path_signal").distinct()
    files = table(spark, d, "source_files").select("file_id", "repository_id").distinct()
    rows = occ.join(files, "file_id").select("repository_id", X.path_signal(canonical_path("file_path")).isNotNull().alias("gold"), (F.coalesce(stripped("path_signal"), F.lit("")) != "").alias("predicted"))
    one = confusion(rows, "gold", "predicted").withColumn("level", F.lit("occurrence"))
    return one.unionByName(confusion(any_per(rows, "repository_id", ["gold", "predicted"]), "gold", "predicted").withColumn("level", F.lit("repository")))


def resampled_shares(spark, d):
    """How much better path words agree with the decisions than the recorded flag,
    over 10,000 resamples of repositories."""
    occ = table(spark, d, "model_id_occurrences").select("occurrence_id", "file_id", "file_path", "excluded_from_main_queue", "occurrence_decision").distinct()
    files = table(spark, d, "source_files").select("file_id", "repository_id").distinct()
    gold = F.coalesce(F.col("occurrence_decision") == "exclude", F.lit(False))
    words, flag = X.path_signal(canonical_path("file_path")).isNotNull(), F.coalesce("excluded_from_main_queue", F.lit(False))
    per = occ.join(files, "file_id").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(words == gold).alias("a"), F.count_if(flag == gold).alias("b"))
    gains = paired_gains(per, "repository_id", "n", "a", "b", draws=10_000)
    q = F.percentile("gain", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q")
    return gains.agg(F.count(F.lit(1)).alias("n_draws"), q).select("n_draws", F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("middle"), F.round(F.col("q")[2], 6).alias("high"))


def event_runtimes(spark, d):
    return runtime_summary(table(spark, d, "events"), "event_type", "value")


def cutoff_counts(spark, d):
    """Snapshots with at most so many files."""
    per = table(spark, d, "files").groupBy(snapshot_key("snapshot_id").alias("sid")).agg(F.countDistinct(canonical_path("path")).alias("n"))
    bounds = F.explode(F.array(*[F.lit(b) for b in (5, 10, 25, 100)])).alias("bound")
    return per.select("n", bounds).groupBy("bound").agg(F.count_if(F.col("n") <= F.col("bound")).alias("n_snapshots"))


def path_breadth(spark, d):
    """Added, removed and kept directories per snapshot pair with changes."""
    ch = snapshot_changes(table(spark, d, "files"), table(spark, d, "snapshots"))
    top = ch.select("old_snapshot_id", "new_snapshot_id", "change_kind", F.split("path", "/")[0].alias("top")).distinct()
    sets = top.groupBy("old_snapshot_id", "new_snapshot_id").agg(*[F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "removed", "changed")], F.countDistinct("top").alias("n_tops"))
    kind = F.when((F.col("added") > 0) & (F.col("removed") > 0), "moved").when(F.col("added") > 0, "grown").when(F.col("removed") > 0, "shrunk").otherwise("edited")
    return sets.withColumn("surface", kind)


def _python_texts(spark, d):
    return distinct_texts(table(spark, d, "source_files").where(F.col("rel_path").endswith(".py")), ["file_id"], "text", ["file_id", "text"])


def fact_counts(spark, d):
    """Syntax facts of the collected Python files."""
    files = spread(_python_texts(spark, d))
    return syntax_facts(files).groupBy("kind").agg(F.count(F.lit(1)).alias("n_facts"), F.countDistinct("file_id").alias("n_files"))


def import_counts(spark, d):
    files = spread(_python_texts(spark, d))
    return syntax_facts(files).where("kind = 'import'").groupBy("name").agg(F.count(F.lit(1)).alias("n_imports"))


def _project_files(spark, d):
    files = table(spark, d, "source_files").where(F.col("rel_path").endswith(".py"))
    files = files.select("file_id", F.concat_ws("@", F.col("repository_id").cast("string"), snapshot_key("snapshot_id")).alias("project"), canonical_path("rel_path").alias("rel_path"), "text")
    ids = table(spark, d, "model_id_occurrences").select(F.col("canonical_model_id").alias("model_id")).where("model_id is not null").distinct()
    return files, ids


def traced_bindings(spark, d):
    """Model literals followed to the calls that use them."""
    return trace_literals(*_project_files(spark, d))


def traced_paths(spark, d):
    """The way of each model literal to each call that uses it."""
    out = trace_paths(*_project_files(spark, d))
    return out.withColumn("steps", F.array_join("steps", " > ")).withColumn("kinds", F.array_join("kinds", " > "))


def traced_primary(spark, d):
    """The nearest call of each model literal, by what lies on the way."""
    out = trace_paths(*_project_files(spark, d), mode="shortest")
    return out.groupBy("locality", "interprocedural", F.size("kinds").alias("n_edges")).agg(F.count(F.lit(1)).alias("n_traces"))


def trace_steps(spark, d):
    """Edges on the ways of model literals, by kind and place on the way."""
    steps = trace_paths(*_project_files(spark, d)).select("trace_id", F.posexplode("kinds").alias("at", "edge_type"))
    return steps.groupBy((F.col("at") + 1).alias("step"), "edge_type").agg(F.count(F.lit(1)).alias("n_traces"))


def candidate_calls(spark, d):
    """Calls on imports of known interfaces that take a model."""
    rules = table(spark, d, "author_interfaces").select(F.col("interface_origin").alias("import_origin"))
    return loader_candidates(cut_lineage(syntax_facts(spread(_python_texts(spark, d)))), rules)


def rename_turnover(spark, d):
    """Kinds of files left over on both sides of a snapshot pair."""
    old, new = _rename_sides(spark, d)
    rest = unmatched(old, new, staged_matches(old, new, "pair", "path", _rename_stages()), "pair", "path")
    return turnover_groups(rest, "pair", F.regexp_extract("path", r"(\.[^./]*)$", 1))


def tree_paths(spark, d):
    """Fewest-edges paths from repositories to entries, by length and edge kinds."""
    edges = _tree(spark, d).withColumn("kind", F.when(F.col("down").rlike(r"[.][^./]*$"), "file").otherwise("folder"))
    roots = edges.select(F.split("up", "/")[0].alias("node")).distinct()
    paths = shortest_paths(edges, roots, "up", "down", "node", "kind")
    return paths.groupBy(F.size("path").alias("length"), F.exists("kinds", lambda k: k == "file").alias("to_file")).agg(F.count(F.lit(1)).alias("n_nodes"))


def topic_frequencies(spark, d):
    """Repositories per topic, rare topics merged."""
    topics = split_values(table(spark, d, "repositories"), source_field="topics", record_id="repository_id", field="topics")
    return frequencies(topics, "record_id", "item_value")


def document_keywords(spark, d):
    """Documents of each kind that name a model author, as whole words."""
    authors = table(spark, d, "author_interfaces").select(author_key("model_author").alias("keyword")).where("keyword is not null").distinct()
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9][a-z0-9-]*)"), F.lit(1)))
    docs = table(spark, d, "documents").select("doc_id", "doc_kind", F.explode(words).alias("keyword"))
    met = docs.join(F.broadcast(authors), "keyword") if authors.count() * 96 <= 32 << 20 else fragment_replicate_join(docs, authors, "keyword")
    return met.groupBy("doc_kind", "keyword").agg(F.count(F.lit(1)).alias("n_documents"))


def literal_counts(spark, d):
    """How often a document holds its repository's bare name, overlapping ones included."""
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null and source is not null")
    needle = F.element_at(F.split("source", "/"), -1)
    return docs.select("doc_id", X.overlapping_count(F.col("text"), needle).alias("n_hits"))


def occurrence_contexts(spark, d):
    """Recorded and found context of model occurrences in Python files."""
    occ = table(spark, d, "model_id_occurrences").select("occurrence_id", "file_id", F.col("line_number").alias("line"), F.col("column_start").alias("column"), "source_context").distinct()
    files = _python_texts(spark, d)
    found = classify_positions(files, occ.join(files.select("file_id"), "file_id", "left_semi"))
    return found.groupBy("source_context", "context").agg(F.count(F.lit(1)).alias("n_occurrences"))


def model_literals(spark, d):
    """Literals that are model ids, by what holds them."""
    ids = table(spark, d, "model_id_occurrences").select(F.col("canonical_model_id").alias("m")).where("m is not null").distinct()
    names = ids.select(F.explode(F.array("m", F.element_at(F.split("m", "/"), -1))).alias("literal")).distinct()
    rows = literal_roles(spread(_python_texts(spark, d)))
    met = rows.join(F.broadcast(names), "literal", "left_semi") if names.count() * 96 <= 32 << 20 else fragment_replicate_join(rows, names, "literal", how="left_semi")
    return met.groupBy("role", "name").agg(F.count(F.lit(1)).alias("n_literals"), F.countDistinct("file_id").alias("n_files"))


def interface_names(spark, d):
    """Names of files that stand for known interfaces, by interface."""
    origins = call_origins(cut_lineage(syntax_facts(spread(_python_texts(spark, d)))))
    rules = table(spark, d, "author_interfaces").select(F.col("interface_origin").alias("root")).distinct()
    met = origins.withColumn("root", F.split("origin", "[.]")[0]).join(rules, "root", "left_semi")
    return met.groupBy("root").agg(F.countDistinct("file_id").alias("n_files"), F.count(F.lit(1)).alias("n_names"))


def pricing_summary(spark, d):
    l = table(spark, d, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price) / 1000, 2).alias("revenue_k"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n_lines")
    )


def nation_revenue(spark, d):
    """Revenue per nation of customers and region; joins from small to large."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(places, c["c_nationkey"] == places["n_nationkey"])
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000, 1).alias("revenue_k"), F.count(F.lit(1)).alias("n_lines"))


def repository_states(spark, d):
    """Repositories by language and whether they are still there."""
    rows = _repositories(spark, d)
    return rows.groupBy(F.coalesce(F.lower("language"), F.lit("unknown")).alias("language"), F.col("deleted_at").isNull().alias("there")).agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("stars").cast("long").alias("stars"))


QUERIES = {
    f.__name__: f
    for f in (
        interface_summary, origin_shares, author_variety, repository_rollup, locality_labels, integration_scalars, context_counts, check_states, collapsed_checks,
        binding_records, confirmed_repositories, discovered_authors, listing_differences, module_aliases, module_rules, nearest_views, latest_views, innermost_priority,
        needle_lines, release_gaps, tag_kinds, adjacent_snapshots, latest_commits, weekly_shares, user_ranking, line_offsets, saturating_changes, path_signals,
        identifier_words, snapshot_fingerprints, renamed_files, rename_conservation, replaced_extensions, shared_commits, tree_depths, model_directories, signal_scores,
        resampled_shares, event_runtimes, cutoff_counts, path_breadth, fact_counts, import_counts, traced_bindings, traced_paths, traced_primary, trace_steps, candidate_calls, model_literals, interface_names, rename_turnover, tree_paths, topic_frequencies, document_keywords, literal_counts, occurrence_contexts, pricing_summary, nation_revenue, repository_states,
    )
}
