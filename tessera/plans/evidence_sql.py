"""SQL of the evidence queries, for a second engine over the same tables."""

from tessera.plans.bindings_sql import _AUTHOR, _CHANGES, _MODULE, _PATH, _RENAMES, _SID, _SIGNAL

_ARGS = "model|model_name|model_id|deployment|deployment_id|deployment_name|engine|llm|chat_model|embedding_model|small_model"
_IDS = "ids AS (SELECT DISTINCT trim(canonical_model_id) AS model_id FROM model_id_occurrences WHERE trim(canonical_model_id) <> '')"
_LINES = """t AS (SELECT DISTINCT file_id, text FROM source_files WHERE file_id IS NOT NULL AND text IS NOT NULL AND rel_path LIKE '%.py'),
l AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line_number FROM t)"""
_LOCATIONS = f"""{_CHANGES}, tops AS (SELECT old_snapshot_id, new_snapshot_id, string_split(path, '/')[1] AS top, bool_or(change_kind IN ('removed', 'changed')) AS o,
  bool_or(change_kind IN ('added', 'changed')) AS n, bool_or(change_kind = 'changed') AS a FROM changes GROUP BY ALL),
locations AS (SELECT old_snapshot_id, new_snapshot_id, count(*) AS n_union, count(*) FILTER (o) AS n_old, count(*) FILTER (n) AS n_new, count(*) FILTER (a) AS n_affected FROM tops GROUP BY ALL)"""


def _occurrences(columns: str) -> str:
    return f"(SELECT DISTINCT occurrence_id, {columns} FROM model_id_occurrences)"


def _file(column: str) -> str:
    return f"(SELECT DISTINCT file_id, {column} FROM source_files)"


ORACLES = {
    "search_queries": f"""WITH p AS (SELECT model_id, min(n) AS lo, max(n) AS hi FROM (SELECT DISTINCT occurrence_id, file_id, trim(canonical_model_id) AS model_id FROM model_id_occurrences) JOIN {_file('length(text) AS n')} USING (file_id)
          WHERE model_id <> '' GROUP BY 1),
        f AS (SELECT model_id, lo, hi, 'full' AS form, model_id AS t FROM p UNION ALL SELECT model_id, lo, hi, 'namespace_free', string_split(model_id, '/')[-1] FROM p),
        q AS (SELECT *, 'double' AS quote, chr(34) AS s FROM f UNION ALL SELECT *, 'single', chr(39) FROM f)
        SELECT model_id, form, quote, concat(chr(34), replace(replace(concat(s, t, s), '\\', '\\\\'), chr(34), '\\' || chr(34)), chr(34), ' size:', lo, '..', hi) AS query FROM q""".replace("\\\\\\\\", "\\\\"),
    "root_ranges": f"""WITH r AS (SELECT model_id, repository_id, min(n) AS lo, max(n) AS hi FROM {_occurrences('file_id, canonical_model_id AS model_id')} JOIN {_file('repository_id, length(text) AS n')} USING (file_id) GROUP BY 1, 2),
        w AS (SELECT model_id, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY 1)
        SELECT model_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, count(*) AS n_roots, min(repository_id) AS root FROM r JOIN w USING (model_id, lo, hi) GROUP BY ALL""",
    "vocabulary_ids": """WITH s AS (SELECT trim(canonical_model_id) AS model_id, min(occurrence_id) AS first_id, max(occurrence_id) AS last_id FROM model_id_occurrences WHERE trim(canonical_model_id) <> '' GROUP BY 1)
        SELECT *, printf('model_%05d', row_number() OVER (ORDER BY first_id, model_id)) AS ordinal_id FROM s""",
    "first_last_paths": "SELECT stored_file_sha, arg_min(file_path, check_id) AS first_path, arg_max(file_path, check_id) AS last_path FROM snapshot_checks WHERE stored_file_sha <> '' GROUP BY 1",
    "file_addresses": rf"""WITH f AS (SELECT DISTINCT file_id, repository, commit_sha, rel_path, url FROM source_files),
        p AS (SELECT *, '^https?://[^/]+/([^/]+/[^/]+)/blob/([0-9a-f]{{40}})/([^?#]+)' AS r FROM f)
        SELECT file_id, nullif(regexp_extract(url, r, 1), '') AS repository, nullif(regexp_extract(url, r, 2), '') AS "commit", url_decode(nullif(regexp_extract(url, r, 3), '')) AS path,
        nullif(regexp_extract(url, r, 2), '') = commit_sha AS same_commit, concat('https://git.example/', p.repository, '/blob/', commit_sha, '/', {_PATH.format(c='rel_path')}, '#L1') AS line_url FROM p""",
    "argument_matches": rf"""WITH {_IDS}, o AS (SELECT occurrence_id, nullif(regexp_extract(line_text, '(^|[^A-Za-z0-9_])["'']?({_ARGS})["'']?\s*[=:]\s*["'']([^"'']+)["'']', 3), '') AS v FROM {_occurrences('line_text')}),
        v AS (SELECT occurrence_id, regexp_replace(regexp_replace(regexp_replace(trim(v), '^https?://[^/]+/', ''), '[?#].*$', ''), '^models/', '') AS value FROM o WHERE v IS NOT NULL),
        f AS (SELECT model_id, model_id AS value, 'full' AS form FROM ids UNION SELECT model_id, string_split(model_id, '/')[-1], 'namespace_free' FROM ids)
        SELECT occurrence_id, value, model_id, form FROM v JOIN f USING (value)""",
    "listed_values": r"""WITH m AS (SELECT DISTINCT file_id, trim(model_ids) AS m FROM source_files WHERE trim(model_ids) LIKE '[%' AND NOT contains(model_ids, chr(39))),
        v AS (SELECT file_id, unnest(regexp_extract_all(m, '"([^"]*)"', 1)) AS value FROM m)
        SELECT value, count(DISTINCT file_id) AS n_files FROM v WHERE NOT regexp_matches(value, '^(true|false|null|-?[0-9]+(\.[0-9]+)?|<[^>]*>|\{[^}]*\}|\s*)$') GROUP BY 1""",
    "setting_keys": rf"""WITH k AS (SELECT coalesce(nullif(regexp_extract(line_text, '^\s*[A-Za-z_][\w.]*\[["'']([\w.-]+)["'']\]\s*=[^=]', 1), ''),
          nullif(regexp_extract(line_text, '^\s*["'']?([A-Za-z_][\w.-]*)["'']?\s*(:|=)[^=]', 1), '')) AS key FROM {_occurrences('line_text')}) SELECT key, count(*) AS n_lines FROM k WHERE key IS NOT NULL GROUP BY 1""",
    "author_terms": f"""WITH {_IDS}, w AS (SELECT DISTINCT model_id, {_AUTHOR.format(c="string_split(model_id, '/')[1]")} AS author, unnest(list_distinct(string_split_regex(lower(string_split(model_id, '/')[-1]), '[^a-z0-9]+'))) AS term FROM ids)
        SELECT author, term, count(*) AS n_models FROM w WHERE length(term) > 1 AND term NOT IN ('a','an','and','for','from','in','of','on','or','the','to','with') GROUP BY 1, 2""",
    "repository_slugs": r"""SELECT DISTINCT repository_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
        trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(description, '<[^<>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS words FROM repositories""",
    "ranked_captures": """WITH s AS (SELECT DISTINCT repository_id, snapshot_id, captured_at AS ts FROM snapshots WHERE repository_id IS NOT NULL AND captured_at IS NOT NULL),
        g AS (SELECT repository_id, unnest(generate_series(date_trunc('week', min(ts))::TIMESTAMP, date_trunc('week', max(ts))::TIMESTAMP, INTERVAL 7 DAY)) AS t FROM s GROUP BY 1),
        j AS (SELECT concat(g.repository_id, '@', strftime(t, '%Y%m%d%H%M%S')) AS target, snapshot_id, ts, abs(epoch_us(ts) / 1e6 - epoch_us(t) / 1e6) AS d FROM g JOIN s USING (repository_id) WHERE abs(epoch_us(ts) / 1e6 - epoch_us(t) / 1e6) <= 259200)
        SELECT target, row_number() OVER (PARTITION BY target ORDER BY d = 0, d, ts, snapshot_id) AS rank, snapshot_id, round(d, 3) AS distance FROM j""",
    "nearest_folders": rf"""WITH h AS (SELECT DISTINCT {_SID} AS sid, regexp_replace({_PATH.format(c='rel_path')}, '/[^/]*$', '') AS folder FROM source_files WHERE snapshot_id IS NOT NULL),
        n AS (SELECT DISTINCT {_SID} AS sid, {_PATH.format(c='path')} AS path FROM files WHERE path IS NOT NULL AND {_SID} IN (SELECT sid FROM h)),
        e AS (SELECT sid, path, array_to_string(p[1:i], '/') AS folder, i FROM (SELECT sid, path, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM n)),
        b AS (SELECT sid, path, arg_max(folder, i) AS folder FROM e JOIN h USING (sid, folder) GROUP BY 1, 2)
        SELECT n.sid, coalesce(b.folder, '') AS folder, count(*) AS n_paths FROM n LEFT JOIN b ON b.sid = n.sid AND b.path = n.path GROUP BY 1, 2""",
    "earlier_assignments": rf"""WITH {_LINES}, a AS (SELECT file_id, line_number, regexp_extract(line, '^([ ]*)([A-Za-z_][A-Za-z0-9_]*) = [^=]', 2) AS name, length(regexp_extract(line, '^([ ]*)([A-Za-z_][A-Za-z0-9_]*) = [^=]', 1)) AS indent FROM l),
        k AS (SELECT * FROM a WHERE name <> ''), p AS (SELECT x.file_id, x.name, x.line_number, max(y.line_number) AS plain_line FROM k x JOIN k y ON y.file_id = x.file_id AND y.name = x.name AND y.line_number < x.line_number AND y.indent <= 4 GROUP BY 1, 2, 3)
        SELECT p.file_id, p.name, p.line_number, p.plain_line, (SELECT count(*) FROM k b WHERE b.file_id = p.file_id AND b.name = p.name AND b.indent > 4 AND b.line_number > p.plain_line AND b.line_number < p.line_number) AS n_branches FROM p""",
    "seed_ladder": rf"""WITH {_LINES}, f AS (SELECT file_id, line_number, regexp_extract(line, '^\s*(async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)', 2) AS name FROM l),
        k AS (SELECT DISTINCT file_id, line_number, name FROM f WHERE name <> ''), o AS (SELECT * FROM {_occurrences('file_id, line_number')} WHERE file_id IN (SELECT file_id FROM source_files WHERE rel_path LIKE '%.py'))
        SELECT o.occurrence_id, CASE WHEN k.line_number = o.line_number THEN 'line' WHEN k.name IS NOT NULL THEN 'span' ELSE 'module' END AS step, k.name FROM o ASOF LEFT JOIN k ON o.file_id = k.file_id AND o.line_number >= k.line_number""",
    "verified_contents": f"""WITH f AS (SELECT DISTINCT file_id, {_SID} AS sid, {_PATH.format(c='rel_path')} AS path, octet_length(encode(text)) AS n, sha256(text) AS content, lower(blob_sha) AS b FROM source_files WHERE text IS NOT NULL),
        x AS (SELECT {_SID} AS sid, {_PATH.format(c='path')} AS path, loaded_at, size_bytes, lower(trim(content_sha256)) AS c, lower(trim(git_blob_sha)) AS b FROM files),
        r AS (SELECT sid, path, count(*) AS n_rows FROM x GROUP BY 1, 2), g AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY sid, path ORDER BY loaded_at DESC NULLS LAST, size_bytes DESC NULLS LAST, c DESC NULLS LAST, b DESC NULLS LAST) = 1)
        SELECT file_id, coalesce(n_rows, 0) AS n_rows, coalesce(n = size_bytes, false) AS same_size, coalesce(content = c, false) AS same_content, coalesce(f.b = g.b, false) AS same_blob
        FROM f LEFT JOIN r ON r.sid = f.sid AND r.path = f.path LEFT JOIN g ON g.sid = f.sid AND g.path = f.path""",
    "pair_counts": f"""WITH s AS (SELECT {_SID} AS sid, repository_id, release_line, captured_at FROM snapshots WHERE repository_id IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY {_SID} ORDER BY loaded_at DESC, captured_at DESC) = 1),
        p AS (SELECT sid AS old_sid, lead(sid) OVER (PARTITION BY repository_id, release_line ORDER BY captured_at, sid) AS new_sid FROM s),
        c AS (SELECT sid, model_id, count(*) AS n FROM {_occurrences('file_id, canonical_model_id AS model_id')} JOIN (SELECT DISTINCT file_id, {_SID} AS sid FROM source_files) USING (file_id) GROUP BY 1, 2),
        o AS (SELECT old_sid, new_sid, model_id, n FROM p JOIN c ON c.sid = old_sid WHERE new_sid IS NOT NULL), n AS (SELECT old_sid, new_sid, model_id, n FROM p JOIN c ON c.sid = new_sid)
        SELECT coalesce(o.old_sid, n.old_sid) AS old_sid, coalesce(o.new_sid, n.new_sid) AS new_sid, count(*) AS n_models, bool_or(o.n IS DISTINCT FROM n.n) AS differs
        FROM o FULL JOIN n ON o.old_sid = n.old_sid AND o.new_sid = n.new_sid AND o.model_id = n.model_id GROUP BY 1, 2""",
    "location_unions": f"WITH {_LOCATIONS} SELECT * FROM locations",
    "breadth_summary": f"""WITH {_LOCATIONS} SELECT round(sum(n_affected) / sum(n_union), 6) AS pooled, min(n_affected) FILTER (n_old > 0) AS least, max(n_affected) FILTER (n_old > 0) AS greatest, count(*) FILTER (n_affected >= 2) AS n_several,
        count(*) FILTER (n_affected = 0) AS n_none, count(*) FILTER (n_old = 0) AS n_not_applicable, round(median(CAST(n_affected AS DOUBLE)), 6) AS median_affected, round(median(n_affected / n_union), 6) AS median_share FROM locations""",
    "collection_funnel": f"""WITH k AS (SELECT * FROM source_files WHERE file_id IN (SELECT file_id FROM model_id_occurrences WHERE occurrence_decision = 'include'))
        SELECT 'repositories' AS step, count(DISTINCT repository_id) AS n FROM repositories UNION ALL SELECT 'snapshots', count(DISTINCT {_SID}) FROM snapshots UNION ALL SELECT 'releases', count(DISTINCT release_id) FROM releases
        UNION ALL SELECT 'listed blobs', count(DISTINCT lower(trim(git_blob_sha))) FROM files UNION ALL SELECT 'collected files', count(DISTINCT file_id) FROM source_files UNION ALL SELECT 'collected repositories', count(DISTINCT repository_id) FROM source_files
        UNION ALL SELECT 'models', count(DISTINCT canonical_model_id) FROM model_id_occurrences UNION ALL SELECT 'occurrences', count(DISTINCT occurrence_id) FROM model_id_occurrences
        UNION ALL SELECT 'included files', count(DISTINCT file_id) FROM k UNION ALL SELECT 'included repositories', count(DISTINCT repository_id) FROM k""",
    "retrieval_scores": f"""WITH p AS (SELECT canonical_model_id AS model_id, file_id, bool_or(occurrence_decision = 'include') AS gold, bool_and({_SIGNAL.format(c=_PATH.format(c='file_path'))} IS NULL) AS got
          FROM {_occurrences('file_id, file_path, occurrence_decision, canonical_model_id')} GROUP BY 1, 2),
        c AS (SELECT model_id, count(*) FILTER (gold) AS gold, count(*) FILTER (got) AS got, count(*) FILTER (gold AND got) AS both_n FROM p GROUP BY 1 HAVING count(*) FILTER (gold) > 0)
        SELECT count(*) AS n_cases, count(*) FILTER (both_n > 0) AS n_hit, count(*) FILTER (both_n = gold) AS n_all, round(avg(both_n / gold), 6) AS mean_recall, median(CAST(got AS DOUBLE)) AS median_files FROM c""",
    "evidence_matches": f"""SELECT file_id, line_number, occurrence_id, canonical_model_id, count(*) OVER (PARTITION BY file_id, line_number) AS n FROM {_occurrences('file_id, line_number, variant_form, column_start, canonical_model_id')}
        QUALIFY row_number() OVER (PARTITION BY file_id, line_number ORDER BY variant_form <> 'full', column_start, occurrence_id) = 1""",
    "selected_checks": """SELECT lower(repository_full_name) AS repository, check_id, latest_snapshot_status FROM snapshot_checks WHERE repository_full_name IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY lower(repository_full_name) ORDER BY CASE latest_snapshot_status WHEN 'matches_latest_snapshot' THEN 1 WHEN 'changed_at_latest_snapshot' THEN 2 WHEN 'missing_at_latest_snapshot' THEN 3 ELSE 4 END, check_id) = 1""",
    "case_results": """SELECT lower(repository_full_name) AS repository, count(DISTINCT file_path) AS n_files, count(DISTINCT string_split(file_path, '/')[1]) AS n_folders, min(check_id) AS first_check,
        CASE WHEN bool_or(latest_snapshot_status = 'matches_latest_snapshot') THEN 'kept' WHEN bool_or(latest_snapshot_status = 'changed_at_latest_snapshot') THEN 'changed' ELSE 'gone' END AS status
        FROM snapshot_checks WHERE repository_full_name IS NOT NULL GROUP BY 1""",
    "change_events": f"""WITH {_CHANGES}, e AS (SELECT old_snapshot_id, new_snapshot_id, string_split(path, '/')[1] AS top, min(path) FILTER (change_kind = 'removed') AS old_path, min(path) FILTER (change_kind = 'added') AS new_path,
          count(*) FILTER (change_kind = 'removed') AS n_old, count(*) FILTER (change_kind = 'added') AS n_new FROM changes WHERE change_kind <> 'changed' GROUP BY 1, 2, 3)
        SELECT *, sha256(concat_ws('|', old_snapshot_id, new_snapshot_id, top, old_path, new_path)) AS event_id FROM e WHERE n_old > 0 AND n_new > 0""",
    "location_order": f"""WITH p AS (SELECT DISTINCT canonical_model_id AS model_id, concat_ws(':', {_PATH.format(c='file_path')}, line_number) AS place FROM model_id_occurrences WHERE canonical_model_id IS NOT NULL)
        SELECT model_id, place, row_number() OVER (PARTITION BY model_id ORDER BY place) AS rank FROM p""",
    "replaced_signals": f"""WITH o AS (SELECT * FROM {_occurrences('file_path, path_signal')}),
        s AS (SELECT CASE WHEN coalesce(trim(path_signal), '') = '' THEN coalesce({_SIGNAL.format(c=_PATH.format(c='file_path'))}, 'none') ELSE path_signal END AS signal, CASE WHEN coalesce(trim(path_signal), '') = '' THEN 'computed' ELSE 'recorded' END AS source FROM o)
        SELECT signal, source, count(*) AS n_rows FROM s GROUP BY 1, 2""",
    "seed_rows": rf"""WITH {_LINES}, i AS (SELECT file_id, line_number, regexp_extract(line, '^\s*(from|import)\s+([A-Za-z_][A-Za-z0-9_]*)', 2) AS p, regexp_extract(line, '\bimport\s+([A-Za-z_][A-Za-z0-9_.]*)', 1) AS s FROM l),
        own AS (SELECT DISTINCT file_id, string_split({_MODULE.format(c=_PATH.format(c='rel_path'))}, '.')[1] AS p FROM source_files WHERE rel_path LIKE '%.py')
        SELECT 'model' AS kind, file_id, line_number, concat('{{"primary":"', canonical_model_id, '","secondary":"', variant_form, '"}}') AS details FROM {_occurrences('file_id, line_number, canonical_model_id, variant_form')}
        UNION ALL SELECT 'import', file_id, line_number, concat('{{"primary":"', p, '","secondary":"', s, '"}}') FROM i WHERE p <> '' AND p IN (SELECT interface_origin FROM author_interfaces) AND (file_id, p) NOT IN (SELECT file_id, p FROM own)""",
    "greedy_additions": rf"""WITH {_RENAMES}, un AS (SELECT pair, regexp_extract(path, '(\.[^./]*)$', 1) AS kind, count(*) AS units FROM r1 WHERE side = 'old' GROUP BY 1, 2),
        ad AS (SELECT pair, path, regexp_extract(path, '(\.[^./]*)$', 1) AS kind, row_number() OVER (PARTITION BY pair, regexp_extract(path, '(\.[^./]*)$', 1) ORDER BY path) AS k FROM r1 WHERE side = 'new')
        SELECT ad.pair, ad.path, coalesce(ad.k <= un.units, false) AS taken FROM ad LEFT JOIN un ON un.pair = ad.pair AND un.kind = ad.kind""",
    "different_contents": f"""WITH {_RENAMES}, g AS (SELECT pair, regexp_replace(path, '[^/]*$', '') AS folder, side, min(path) AS path, min(c) AS c FROM r1 GROUP BY 1, 2, 3 HAVING count(*) = 1)
        SELECT a.pair, a.path AS old_path, b.path AS new_path FROM g a JOIN g b ON a.pair = b.pair AND a.folder = b.folder AND a.side = 'old' AND b.side = 'new' WHERE a.c <> b.c""",
    "block_occurrences": """WITH t AS (SELECT DISTINCT file_id, text FROM source_files WHERE file_id IS NOT NULL AND text IS NOT NULL),
        p AS (SELECT file_id, unnest(string_split(text, chr(10) || chr(10))) AS part, CAST(unnest(range(len(string_split(text, chr(10) || chr(10))))) AS INTEGER) AS block FROM t),
        n AS (SELECT file_id, block, length(part) - length(replace(part, chr(10), '')) + 2 AS n FROM p),
        s AS (SELECT file_id, block, CAST(sum(n) OVER w - n + 1 AS BIGINT) AS first_line, CAST(sum(n) OVER w - 1 AS BIGINT) AS last_line FROM n WINDOW w AS (PARTITION BY file_id ORDER BY block))
        SELECT s.*, count(*) AS n_occurrences, count(*) = 1 AS alone FROM s JOIN (SELECT DISTINCT occurrence_id, file_id, line_number FROM model_id_occurrences) o ON o.file_id = s.file_id AND o.line_number BETWEEN first_line AND last_line GROUP BY ALL""",
    "line_predicates": rf"""WITH o AS (SELECT *, regexp_extract(line_text, '([A-Za-z_][A-Za-z0-9_]*)\(', 1) AS callee FROM {_occurrences('matched_text, file_path, line_text')}),
        f AS (SELECT regexp_matches(matched_text, '^(\.{{1,2}}/|/|~|[A-Za-z]:[\\/])|\.(bin|ckpt|gguf|h5|json|model|onnx|pb|pkl|pt|pth|safetensors|tar|txt|yaml|yml|zip)$') AS local_value,
          regexp_matches(lower(file_path), '\.venv|venv|env|envs|environment|environments|site-packages|dist-packages|vendor|vendored|third_party|third-party') AS foreign_path,
          callee <> '' AND NOT regexp_matches(line_text, '^\s*(#|class\b)') AND NOT regexp_matches(line_text, concat('^\s*(async\s+)?def\s+', callee, '\b')) AS call_line FROM o)
        SELECT local_value, foreign_path, call_line, count(*) AS n_occurrences FROM f GROUP BY ALL""",
    "occurrence_exclusions": f"""SELECT coalesce({_SIGNAL.format(c=_PATH.format(c='file_path'))} IS NOT NULL OR source_context IN ('comment', 'docstring'), false) AS excluded, excluded_from_main_queue AS recorded, count(*) AS n_occurrences
        FROM {_occurrences('file_path, source_context, excluded_from_main_queue')} GROUP BY 1, 2""",
    "candidate_components": f"""WITH RECURSIVE {_RENAMES}, it AS (SELECT *, concat_ws('|', pair, side, path) AS node FROM r1),
        ke AS (SELECT node, concat_ws('|', '=', pair, 'content', c) AS v FROM it WHERE c IS NOT NULL UNION SELECT node, concat_ws('|', '=', pair, 'name', name) FROM it UNION SELECT node, concat_ws('|', '=', pair, 'folder', regexp_replace(path, '[^/]*$', '')) FROM it),
        ne AS (SELECT DISTINCT a.node AS a, b.node AS b FROM ke a JOIN ke b USING (v)),
        re(a, b) AS (SELECT a, b FROM ne UNION SELECT re.a, ne.b FROM re JOIN ne ON ne.a = re.b),
        la AS (SELECT a AS node, min(b) AS component FROM re GROUP BY a),
        co AS (SELECT pair, component, count(*) FILTER (side = 'old') AS n_old, count(*) FILTER (side = 'new') AS n_new FROM it JOIN la USING (node) GROUP BY 1, 2)
        SELECT pair, n_old, n_new, count(*) AS n_components FROM co WHERE n_old > 0 AND n_new > 0 GROUP BY 1, 2, 3""",
}
