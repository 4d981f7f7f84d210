"""SQL of the analytics queries, for a second engine over the same tables.

Queries without an entry run Python per file or a fix-point over keys; tests
compare those with brute force.
"""

from math import factorial

from tessera.plans.problems_sql import _P3_VALUES

_AUTHOR = "lower(trim(regexp_replace(trim({c}), '^~+', '')))"
_SID = "lower(trim(snapshot_id))"
_PATH = r"regexp_replace(regexp_replace(replace({c}, '\', '/'), '/{{2,}}', '/', 'g'), '^(\./|/)+', '')"
_MODULE = r"replace(regexp_replace(regexp_replace({c}, '^(src|lib|python)/', ''), '(/__init__)?\.py$', ''), '/', '.')"
_FOLDERS = r"flatten(list_transform(string_split({c}, '/')[:-2], lambda x: list_concat([lower(x)], string_split_regex(lower(x), '[_\-.]'))))"
_FILE = r"list_concat([lower(string_split({c}, '/')[-1])], string_split_regex(lower(string_split({c}, '/')[-1]), '[_\-.]'))"
_SIGNAL = rf"""CASE
  WHEN list_has_any({_FOLDERS}, ['example','examples','demo','demos','tutorial','tutorials','sample','samples']) OR list_has_any({_FILE}, ['example','examples','demo','demos','tutorial','tutorials','samples'])
    THEN 'example_or_demo_code'
  WHEN list_has_any(list_concat({_FOLDERS}, {_FILE}), ['.venv','venv','env','envs','environment','environments','site-packages','dist-packages','vendor','vendored','third_party','third-party'])
    THEN 'third_party_or_vendored_code' END"""
_TIME = "coalesce(try_strptime(trim(published_at), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(trim(published_at), '%Y-%m-%d'))"
_A = f"SELECT DISTINCT *, {_AUTHOR.format(c='model_author')} AS author FROM author_interfaces"
#: Shares of Poisson(1) numbers up to 0, 1, 2, ...
_POISSON = [sum(0.36787944117144233 / factorial(i) for i in range(k + 1)) for k in range(9)]
_WEEK = "strftime(date_trunc('week', ts), '%Y-%m-%d')"

_CHANGES = rf"""
latest AS (
  SELECT {_SID} AS sid, {_PATH.format(c='path')} AS path, lower(trim(content_sha256)) AS c, lower(trim(git_blob_sha)) AS b, size_bytes
  FROM files WHERE snapshot_id IS NOT NULL AND path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sid, {_PATH.format(c='path')}
    ORDER BY loaded_at DESC, lower(trim(content_sha256)) DESC NULLS LAST, lower(trim(git_blob_sha)) DESC NULLS LAST, size_bytes DESC) = 1),
snaps AS (
  SELECT {_SID} AS sid, snapshot_id, repository_id, release_line, captured_at FROM snapshots
  WHERE repository_id IS NOT NULL AND {_SID} IN (SELECT sid FROM latest)
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY loaded_at DESC, captured_at DESC) = 1),
pairs AS (
  SELECT sid AS old_sid, snapshot_id AS old_snapshot_id, lead(sid) OVER w AS new_sid, lead(snapshot_id) OVER w AS new_snapshot_id
  FROM snaps WINDOW w AS (PARTITION BY repository_id, release_line ORDER BY captured_at, sid)),
o AS (SELECT p.*, l.path, l.c, l.b, l.size_bytes FROM pairs p JOIN latest l ON l.sid = p.old_sid WHERE p.new_sid IS NOT NULL),
n AS (SELECT p.*, l.path, l.c, l.b, l.size_bytes FROM pairs p JOIN latest l ON l.sid = p.new_sid),
changes AS (
  SELECT coalesce(o.old_snapshot_id, n.old_snapshot_id) AS old_snapshot_id, coalesce(o.new_snapshot_id, n.new_snapshot_id) AS new_snapshot_id,
    coalesce(o.path, n.path) AS path, coalesce(o.c, n.c) AS c, coalesce(o.size_bytes, n.size_bytes) AS size_bytes,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM o FULL JOIN n ON o.old_sid = n.old_sid AND o.path = n.path
  WHERE o.path IS NULL OR n.path IS NULL OR CASE WHEN o.c IS NULL OR n.c IS NULL THEN o.b IS DISTINCT FROM n.b ELSE o.c <> n.c END)
"""

_STAGE = """
s{i} AS (SELECT pair, {key} AS k, min(path) FILTER (side = 'old') AS old_item, min(path) FILTER (side = 'new') AS new_item
  FROM r{i} WHERE {key} IS NOT NULL GROUP BY pair, k
  HAVING count(*) FILTER (side = 'old') = 1 AND count(*) FILTER (side = 'new') = 1),
r{j} AS (SELECT * FROM r{i} WHERE NOT EXISTS (SELECT 1 FROM s{i} WHERE s{i}.pair = r{i}.pair AND
  ((side = 'old' AND old_item = path) OR (side = 'new' AND new_item = path))))
"""
_RENAMES = f"""{_CHANGES},
r1 AS (SELECT concat(old_snapshot_id, '>', new_snapshot_id) AS pair, path, CASE change_kind WHEN 'removed' THEN 'old' ELSE 'new' END AS side,
  c, concat(string_split(path, '/')[-1], ':', CAST(size_bytes AS VARCHAR)) AS name_size, string_split(path, '/')[-1] AS name
  FROM changes WHERE change_kind <> 'changed'),
{_STAGE.format(i=1, j=2, key='c')}, {_STAGE.format(i=2, j=3, key='name_size')}, {_STAGE.format(i=3, j=4, key='name')}
"""

_COMPONENTS = """
e AS (SELECT DISTINCT source_snapshot_commit_sha AS a, stored_file_sha AS b FROM snapshot_checks WHERE stored_file_sha <> '' AND source_snapshot_commit_sha <> ''),
both_ways AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
reach(node, other) AS (SELECT u, u FROM both_ways UNION SELECT r.node, w.v FROM reach r JOIN both_ways w ON w.u = r.other)
"""

ORACLES = {
    "interface_summary": f"""WITH a AS ({_A}) SELECT author, family_id, count(*) AS n_rows, count(DISTINCT repository_id) AS n_entities,
        count(*) FILTER (non_local_binding_count > 0) AS n_flagged, round(count(*) / (SELECT count(*) FROM a), 6) AS row_share,
        round(count(DISTINCT repository_id) / (SELECT count(DISTINCT repository_id) FROM a), 6) AS entity_share,
        round(count(*) FILTER (non_local_binding_count > 0) / count(*), 6) AS flagged_share FROM a GROUP BY author, family_id""",
    "origin_shares": f"""WITH a AS ({_A}), n AS (SELECT interface_origin, author, count(*) AS n_rows FROM a GROUP BY ALL)
        SELECT *, round(n_rows / sum(n_rows) OVER (PARTITION BY interface_origin), 6) AS share FROM n""",
    "author_variety": f"""WITH a AS ({_A}) SELECT author, count(DISTINCT family_id) AS n_families, count(DISTINCT interface_origin) AS n_origins,
        CAST(sum(binding_count) AS BIGINT) AS n_bindings FROM a GROUP BY author""",
    "repository_rollup": f"""WITH a AS ({_A}) SELECT repository_id, CAST(sum(binding_count) AS BIGINT) AS n_bindings, bool_or(non_local_binding_count > 0) AS has_non_local,
        string_agg(DISTINCT author, ' | ' ORDER BY author) AS authors, string_agg(DISTINCT family_id, ' | ' ORDER BY family_id) FILTER (author IS NOT NULL) AS families
        FROM a WHERE repository_id IS NOT NULL GROUP BY repository_id""",
    "locality_labels": f"""WITH a AS ({_A}), f AS (SELECT coalesce(local_binding_count > 0, false) AS l, coalesce(non_local_binding_count > 0, false) AS o FROM a)
        SELECT 'local_only' AS label, count(*) FILTER (l AND NOT o) AS n_rows FROM f UNION ALL SELECT 'non_local_only', count(*) FILTER (o AND NOT l) FROM f
        UNION ALL SELECT 'both', count(*) FILTER (l AND o) FROM f UNION ALL SELECT 'neither', count(*) FILTER (NOT l AND NOT o) FROM f
        UNION ALL SELECT 'any_non_local', count(*) FILTER (o) FROM f""",
    "integration_scalars": f"""WITH a AS ({_A}), f AS (SELECT DISTINCT repository_id, family_id FROM a WHERE repository_id IS NOT NULL)
        SELECT count(*) AS n_rows, count(DISTINCT repository_id) AS n_repositories, count(DISTINCT CASE WHEN non_local_binding_count > 0 THEN repository_id END) AS n_with_non_local,
        CAST(sum(binding_count) AS BIGINT) AS n_bindings, (SELECT count(*) FROM (SELECT repository_id FROM f WHERE family_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)) AS n_several_families FROM a""",
    "context_counts": "SELECT coalesce(source_context, '') AS value, count(*) AS n_rows FROM (SELECT DISTINCT * FROM model_id_occurrences) GROUP BY 1",
    "check_states": """WITH c AS (SELECT DISTINCT * FROM snapshot_checks), s(source_snapshot_status) AS (VALUES ('matches_source_snapshot'), ('source_snapshot_mismatch'), ('source_snapshot_missing'))
        SELECT s.source_snapshot_status, count(*) FILTER (latest_snapshot_status = 'matches_latest_snapshot') AS matches_latest_snapshot,
        count(*) FILTER (latest_snapshot_status = 'changed_at_latest_snapshot') AS changed_at_latest_snapshot,
        count(*) FILTER (latest_snapshot_status = 'missing_at_latest_snapshot') AS missing_at_latest_snapshot
        FROM s LEFT JOIN c ON c.source_snapshot_status = s.source_snapshot_status GROUP BY 1""",
    "collapsed_checks": """SELECT lower(repository_full_name) AS repository,
        bool_and(coalesce(latest_snapshot_file_sha = stored_file_sha AND latest_snapshot_status <> 'missing_at_latest_snapshot', false)) AS unchanged,
        count(DISTINCT latest_snapshot_commit_sha) AS n_commits, count(*) AS n_checks FROM (SELECT DISTINCT * FROM snapshot_checks) GROUP BY 1""",
    "binding_records": f"""SELECT occurrence_id, canonical_model_id, name, release_line, rel_path, line_number
        FROM (SELECT DISTINCT occurrence_id, file_id, canonical_model_id, line_number FROM model_id_occurrences)
        JOIN (SELECT DISTINCT file_id, repository_id, {_SID} AS sid, rel_path FROM source_files) USING (file_id)
        JOIN (SELECT repository_id, max(name) AS name FROM repositories GROUP BY 1) USING (repository_id)
        JOIN (SELECT DISTINCT {_SID} AS sid, release_line FROM snapshots) USING (sid)""",
    "confirmed_repositories": """SELECT DISTINCT repository_id, repository_id IN (SELECT f.repository_id FROM source_files f JOIN model_id_occurrences o USING (file_id)
        WHERE o.occurrence_decision = 'include' AND f.repository_id IS NOT NULL) AS confirmed FROM repositories""",
    "discovered_authors": f"""WITH a AS (SELECT DISTINCT author FROM ({_A}) WHERE author IS NOT NULL),
        b AS (SELECT DISTINCT {_AUTHOR.format(c="string_split(canonical_model_id, '/')[1]")} AS author FROM model_id_occurrences WHERE canonical_model_id IS NOT NULL)
        SELECT author, a.author IS NOT NULL AS in_left, b.author IS NOT NULL AS in_right FROM a FULL JOIN b USING (author)""",
    "listing_differences": f"""WITH a AS (SELECT DISTINCT {_SID} AS sid, {_PATH.format(c='rel_path')} AS path FROM source_files),
        b AS (SELECT DISTINCT {_SID} AS sid, {_PATH.format(c='path')} AS path FROM files WHERE {_SID} IN (SELECT sid FROM a))
        SELECT sid, side, count(*) AS n_paths FROM (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY sid, side""",
    "module_aliases": f"""WITH m AS (SELECT DISTINCT repository_id, {_MODULE.format(c='rel_path')} AS module FROM source_files WHERE rel_path LIKE '%.py'),
        p AS (SELECT *, string_split(module, '.') AS parts FROM m), s AS (SELECT repository_id, module, array_to_string(parts[i:], '.') AS alias
        FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p))
        SELECT repository_id, alias, min(module) AS module FROM s GROUP BY repository_id, alias HAVING count(*) = 1""",
    "module_rules": f"""WITH c AS (SELECT DISTINCT {_MODULE.format(c=_PATH.format(c='path'))} AS chain FROM files WHERE path LIKE '%.py'),
        m AS (SELECT DISTINCT string_split({_MODULE.format(c='rel_path')}, '.') AS parts FROM source_files WHERE rel_path LIKE '%.py'),
        r AS (SELECT DISTINCT array_to_string(parts[-2:], '.') AS rule FROM m WHERE len(parts) >= 2),
        s AS (SELECT chain, array_to_string(p[i:], '.') AS rule FROM (SELECT chain, string_split(chain, '.') AS p, unnest(range(1, len(string_split(chain, '.')) + 1)) AS i FROM c)),
        d AS (SELECT chain, rule, 'suffix' AS met_by FROM s JOIN r USING (rule)),
        t AS (SELECT c.chain, r.rule, 'terminal' AS met_by FROM c JOIN r ON string_split(c.chain, '.')[-1] = string_split(r.rule, '.')[-1] WHERE c.chain NOT IN (SELECT chain FROM d))
        SELECT rule, met_by, count(*) AS n_chains FROM (SELECT * FROM d UNION ALL SELECT * FROM t) GROUP BY rule, met_by""",
    "nearest_views": """WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS at FROM events),
        j AS (SELECT p.event_id AS row_id, v.event_id AS view_id, abs(p.at - v.at) AS distance, v.at AS seen_at FROM e p JOIN e v USING (user_id)
        WHERE p.event_type = 'purchase' AND v.event_type = 'view' AND abs(p.at - v.at) <= 21600),
        b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, seen_at, view_id) = 1)
        SELECT p.event_id AS row_id, b.view_id, round(b.distance, 3) AS distance FROM e p LEFT JOIN b ON b.row_id = p.event_id WHERE p.event_type = 'purchase'""",
    "latest_views": """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
        SELECT p.event_id, v.view_id FROM events p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.event_type = 'purchase'""",
    "innermost_priority": """WITH s AS (SELECT o_custkey, o_orderpriority, min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders GROUP BY ALL)
        SELECT o.o_orderkey AS row_id, arg_min(s.o_orderpriority, (s.e - s.s, s.o_orderpriority)) AS priority FROM orders o JOIN s
        ON s.o_custkey = o.o_custkey AND o.o_orderdate::DATE BETWEEN s.s AND s.e GROUP BY o.o_orderkey""",
    "needle_lines": r"""WITH ids AS (SELECT DISTINCT canonical_model_id AS model_id FROM model_id_occurrences WHERE canonical_model_id IS NOT NULL),
        n AS (SELECT model_id, model_id AS needle, 'full' AS form FROM ids UNION SELECT model_id, string_split(model_id, '/')[-1], 'namespace_free' FROM ids),
        l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number
          FROM (SELECT DISTINCT file_id, text FROM source_files WHERE file_id IS NOT NULL AND text IS NOT NULL)),
        t AS (SELECT file_id, line_number, unnest(list_transform(regexp_extract_all(line, '("[^"''\n]+"|''[^"''\n]+'')'), lambda x: x[2:-2])) AS needle FROM l)
        SELECT file_id, CAST(line_number AS INTEGER) AS line_number, model_id, form, count(*) AS n_hits FROM t JOIN n USING (needle) GROUP BY ALL""",
    "release_gaps": f"""WITH rel AS (SELECT release_id, max(struct_pack(l := loaded_at, s := snapshot_id, p := published_at, t := tag)) AS r FROM releases GROUP BY release_id),
        flat AS (SELECT release_id, r.s AS snapshot_id, r.p AS published_at, r.t AS tag FROM rel),
        rows_ AS (SELECT f.release_id, s.repository_id, s.release_line, {_TIME} AS tm FROM flat f
          JOIN (SELECT DISTINCT {_SID} AS sid, repository_id, release_line FROM snapshots) s ON lower(trim(f.snapshot_id)) = s.sid
          WHERE {_TIME} IS NOT NULL AND NOT regexp_matches(lower(tag), 'rc|alpha|beta')),
        g AS (SELECT *, floor((epoch(tm) - epoch(lag(tm) OVER (PARTITION BY repository_id, release_line ORDER BY tm, release_id))) / 86400) AS gap FROM rows_)
        SELECT repository_id, release_line, count(*) AS n_releases, CAST(floor((epoch(max(tm)) - epoch(min(tm))) / 86400) AS BIGINT) AS span_days, median(gap) AS median_gap
        FROM g GROUP BY repository_id, release_line""",
    "tag_kinds": r"""SELECT DISTINCT release_id, tag, CASE WHEN regexp_full_match(trim(tag), 'v?\d+\.\d+\.\d+') THEN 'strict'
        WHEN regexp_full_match(trim(tag), '(?:[A-Za-z]+[-_]?)?v?\d+(?:\.\d+)*(?:[-.]?(?:rc|a|b|alpha|beta|post|dev)\.?\d*)?') THEN 'lenient' ELSE 'other' END AS category,
        array_to_string(list_transform(regexp_extract_all(tag, '\d{1,18}'), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), '.') AS version FROM releases""",
    "adjacent_snapshots": """WITH s AS (SELECT snapshot_id, max(struct_pack(l := loaded_at, c := captured_at, r := repository_id, n := release_line)) AS r FROM snapshots
        WHERE repository_id IS NOT NULL GROUP BY snapshot_id)
        SELECT r.r AS repository_id, r.n AS release_line, snapshot_id, lead(snapshot_id) OVER (PARTITION BY r.r, r.n ORDER BY r.c, snapshot_id) AS next_snapshot_id FROM s""",
    "latest_commits": """SELECT repository_id, arg_min(commit_sha, commit_sha) AS commit_sha FROM (SELECT * FROM snapshots WHERE repository_id IS NOT NULL
        QUALIFY captured_at = max(captured_at) OVER (PARTITION BY repository_id)) GROUP BY repository_id""",
    "weekly_shares": f"""WITH p AS (SELECT {_WEEK} AS week, event_type, sum(value) AS v FROM events GROUP BY ALL),
        t AS (SELECT week, sum(v) AS total FROM p GROUP BY week), s AS (SELECT t.week, e.event_type, coalesce(p.v / t.total, 0) AS s, coalesce(p.v, 0) AS v
        FROM t CROSS JOIN (SELECT DISTINCT event_type FROM events) e LEFT JOIN p ON p.week = t.week AND p.event_type = e.event_type)
        SELECT event_type, round(avg(s), 6) AS mean_share, count(*) FILTER (v > 0) AS observed_weeks FROM s GROUP BY event_type""",
    "user_ranking": f"""WITH p AS (SELECT user_id, count(DISTINCT {_WEEK}) AS w, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY user_id)
        SELECT CAST(row_number() OVER (ORDER BY cents DESC, user_id) AS INTEGER) AS rank, user_id, cents FROM p
        WHERE w = (SELECT count(DISTINCT {_WEEK}) FROM events) ORDER BY cents DESC, user_id LIMIT 20""",
    "line_offsets": """WITH f AS (SELECT DISTINCT file_id, text FROM source_files WHERE file_id IS NOT NULL AND text IS NOT NULL),
        l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM f)
        SELECT file_id, CAST(n AS INTEGER) AS line_number, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS "offset" FROM l""",
    "saturating_changes": f"""WITH c AS (SELECT date_trunc('week', ts)::DATE AS w, event_type, count(*) AS n FROM events GROUP BY ALL),
        l AS (SELECT w - 7 AS w, event_type, n AS m FROM c)
        SELECT strftime(w, '%Y-%m-%d') AS week, event_type, greatest(coalesce(m, 0) - coalesce(n, 0), 0) AS increase, greatest(coalesce(n, 0) - coalesce(m, 0), 0) AS decrease
        FROM c FULL JOIN l USING (w, event_type)""",
    "path_signals": f"""WITH p AS (SELECT DISTINCT {_PATH.format(c='path')} AS path FROM files)
        SELECT coalesce({_SIGNAL.format(c='path')}, 'none') AS signal, count(*) AS n_paths FROM p GROUP BY 1""",
    "identifier_words": """WITH i AS (SELECT DISTINCT canonical_model_id AS m FROM model_id_occurrences WHERE canonical_model_id IS NOT NULL)
        SELECT term, count(*) AS n_ids FROM (SELECT DISTINCT m, unnest(string_split_regex(lower(m), '[^a-z0-9]+')) AS term FROM i) WHERE term <> '' GROUP BY term""",
    "snapshot_fingerprints": """SELECT DISTINCT snapshot_id, concat('sha256:', sha256(concat('{"commit_sha":', coalesce('"' || commit_sha || '"', 'null'), ',"repository_id":',
        coalesce('"' || CAST(repository_id AS VARCHAR) || '"', 'null'), '}'))) AS fingerprint FROM snapshots""",
    "renamed_files": f"""WITH {_RENAMES} SELECT pair, old_item, new_item, 'content' AS stage FROM s1 UNION ALL SELECT pair, old_item, new_item, 'name_size' FROM s2
        UNION ALL SELECT pair, old_item, new_item, 'name' FROM s3""",
    "rename_conservation": f"""WITH {_RENAMES} SELECT pair, path, side, 'missing' AS what FROM r1 WHERE NOT EXISTS (SELECT 1 FROM r4 WHERE r4.pair = r1.pair AND r4.path = r1.path AND r4.side = r1.side)
        AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3) s WHERE s.pair = r1.pair AND r1.path IN (s.old_item, s.new_item))""",
    "rename_turnover": rf"""WITH {_RENAMES} SELECT pair, regexp_extract(path, '(\.[^./]*)$', 1) AS key, count(*) FILTER (side = 'old') AS n_old, count(*) FILTER (side = 'new') AS n_new
        FROM r4 GROUP BY 1, 2 HAVING count(*) FILTER (side = 'old') > 0 AND count(*) FILTER (side = 'new') > 0""",
    "tree_paths": rf"""WITH p AS (SELECT DISTINCT string_split(concat(CAST(repository_id AS VARCHAR), '/', {_PATH.format(c='rel_path')}), '/') AS parts FROM source_files WHERE repository_id IS NOT NULL),
        n AS (SELECT DISTINCT parts[1:i] AS node FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p))
        SELECT CAST(len(node) AS INTEGER) AS length, len(list_filter(node[2:], lambda x: contains(x, '.'))) > 0 AS to_file, count(*) AS n_nodes FROM n GROUP BY 1, 2""",
    "topic_frequencies": f"""WITH {_P3_VALUES}, r AS (SELECT DISTINCT record_id, item_value FROM vals WHERE table_name = 'repositories'),
        t AS (SELECT count(DISTINCT record_id) AS n FROM r), c AS (SELECT item_value AS k, count(*) AS m FROM r GROUP BY 1),
        g AS (SELECT record_id, CASE WHEN m < 0.1 * t.n THEN 'Other' ELSE item_value END AS item_value FROM r JOIN c ON c.k = r.item_value CROSS JOIN t)
        SELECT item_value, count(DISTINCT record_id) AS n_cases, round(count(DISTINCT record_id) / (SELECT n FROM t), 6) AS share FROM g GROUP BY item_value""",
    "document_keywords": f"""WITH k AS (SELECT DISTINCT {_AUTHOR.format(c='model_author')} AS keyword FROM author_interfaces WHERE model_author IS NOT NULL),
        w AS (SELECT doc_id, doc_kind, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]*'))) AS keyword FROM documents)
        SELECT doc_kind, keyword, count(*) AS n_documents FROM w JOIN k USING (keyword) GROUP BY ALL""",
    "literal_counts": """SELECT doc_id, CAST((length(text) - length(replace(text, string_split(source, '/')[-1], ''))) // length(string_split(source, '/')[-1]) AS INTEGER) AS n_hits
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL""",
    "resampled_shares": f"""WITH r AS (SELECT f.repository_id, {_SIGNAL.format(c=_PATH.format(c='file_path'))} IS NOT NULL AS a, coalesce(excluded_from_main_queue, false) AS b, coalesce(occurrence_decision = 'exclude', false) AS g
          FROM (SELECT DISTINCT occurrence_id, file_id, file_path, excluded_from_main_queue, occurrence_decision FROM model_id_occurrences) JOIN (SELECT DISTINCT file_id, repository_id FROM source_files) f USING (file_id)),
        p AS (SELECT repository_id, count(*) AS n, count(*) FILTER (a = g) AS a, count(*) FILTER (b = g) AS b FROM r GROUP BY 1),
        u AS (SELECT *, CAST(('0x' || md5(concat_ws(':', draw, repository_id))[1:8]) AS BIGINT) / 4294967296.0 AS u FROM p, (SELECT unnest(range(10000)) AS draw)),
        w AS (SELECT *, {' + '.join(f'(u >= {s!r})::INT' for s in _POISSON)} AS w FROM u),
        g AS (SELECT draw, sum(w * (a - b)) / sum(w * n) AS gain FROM w WHERE w > 0 GROUP BY draw)
        SELECT count(*) AS n_draws, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.5), 6) AS middle, round(quantile_cont(gain, 0.975), 6) AS high FROM g""",
    "shared_commits": f"WITH RECURSIVE {_COMPONENTS} SELECT node, min(other) AS component FROM reach GROUP BY node",
    "tree_depths": f"""WITH p AS (SELECT DISTINCT string_split(concat(CAST(repository_id AS VARCHAR), '/', {_PATH.format(c='rel_path')}), '/') AS parts FROM source_files WHERE repository_id IS NOT NULL),
        n AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS node, i - 1 AS depth FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p))
        SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n_nodes FROM n GROUP BY depth""",
    "model_directories": f"""WITH f AS (SELECT DISTINCT file_id, string_split(concat(CAST(repository_id AS VARCHAR), '/', {_PATH.format(c='rel_path')}), '/') AS parts FROM source_files WHERE repository_id IS NOT NULL),
        o AS (SELECT DISTINCT file_id, string_split(canonical_model_id, '/')[1] AS author FROM model_id_occurrences)
        SELECT array_to_string(parts[1:i], '/') AS directory, count(DISTINCT author) AS n_authors FROM (SELECT parts, author, unnest(range(1, len(parts) + 1)) AS i FROM f JOIN o USING (file_id)) GROUP BY 1""",
    "signal_scores": f"""WITH r AS (SELECT f.repository_id, coalesce({_SIGNAL.format(c=_PATH.format(c='file_path'))}, '') <> '' AS g, coalesce(trim(path_signal), '') <> '' AS p
          FROM (SELECT DISTINCT occurrence_id, file_id, file_path, path_signal FROM model_id_occurrences) JOIN (SELECT DISTINCT file_id, repository_id FROM source_files) f USING (file_id)),
        a AS (SELECT 'occurrence' AS level, g, p FROM r UNION ALL SELECT 'repository', bool_or(g), bool_or(p) FROM r GROUP BY repository_id),
        c AS (SELECT level, count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM a GROUP BY level)
        SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "event_runtimes": """WITH s AS (SELECT event_type, count(*) AS n, min(value) AS a, median(value) AS m, max(value) AS z, CAST(floor(sum(value)) AS BIGINT) AS t FROM events GROUP BY event_type)
        SELECT event_type, n AS n_rows, round(a, 6) AS least, round(m, 6) AS median, round(z, 6) AS greatest, printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) AS total FROM s""",
    "cutoff_counts": f"""WITH p AS (SELECT {_SID} AS sid, count(DISTINCT {_PATH.format(c='path')}) AS n FROM files GROUP BY 1)
        SELECT b AS bound, count(*) FILTER (n <= b) AS n_snapshots FROM p CROSS JOIN (VALUES (5), (10), (25), (100)) t(b) GROUP BY b""",
    "path_breadth": f"""WITH {_CHANGES}, t AS (SELECT DISTINCT old_snapshot_id, new_snapshot_id, change_kind, string_split(path, '/')[1] AS top FROM changes),
        s AS (SELECT old_snapshot_id, new_snapshot_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed,
        count(*) FILTER (change_kind = 'changed') AS changed, count(DISTINCT top) AS n_tops FROM t GROUP BY 1, 2)
        SELECT *, CASE WHEN added > 0 AND removed > 0 THEN 'moved' WHEN added > 0 THEN 'grown' WHEN removed > 0 THEN 'shrunk' ELSE 'edited' END AS surface FROM s""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)) / 1000, 2) AS revenue_k,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "nation_revenue": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)) / 1000, 1) AS revenue_k, count(*) AS n_lines FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "repository_states": """WITH r AS (SELECT * FROM repositories QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY
        coalesce(try_strptime(trim(metadata_collected_at), '%Y-%m-%dT%H:%M:%SZ'), try_strptime(trim(metadata_collected_at), '%Y-%m-%d'), TIMESTAMP '1970-01-01') DESC, coalesce(stars, -1) DESC, coalesce(forks, -1) DESC) = 1)
        SELECT coalesce(lower(language), 'unknown') AS language, deleted_at IS NULL AS there, count(*) AS n_repositories, CAST(sum(stars) AS BIGINT) AS stars FROM r GROUP BY 1, 2""",
}
