"""SQL of queries p3 to p6, for a second engine over the same tables."""

_SID = "lower(trim(snapshot_id))"
_PATH = r"regexp_replace(regexp_replace(replace(path, '\', '/'), '/{2,}', '/', 'g'), '^(\./|/)+', '')"

_P3_VALUES = r"""
fields AS (
  SELECT 'repositories' AS table_name, repository_id AS record_id, max(topics) AS field FROM repositories GROUP BY repository_id
  UNION ALL SELECT 'source_files', file_id, max(model_ids) FROM source_files GROUP BY file_id
  UNION ALL SELECT 'snapshot_checks', check_id, max(models) FROM snapshot_checks GROUP BY check_id),
trimmed AS (SELECT table_name, record_id, regexp_replace(field, '^\s+|\s+$', '', 'g') AS f FROM fields WHERE field IS NOT NULL),
tokens AS (
  SELECT table_name, record_id, f LIKE '[%' AND f LIKE '%]' AS listed, CASE
    WHEN f LIKE '[%' AND f LIKE '%]' THEN regexp_extract_all(f[2:-2], '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|[^\s,;|"'']+')
    ELSE regexp_extract_all(f, '"(?:[^"]|"")*"|[^\s,;|"]+') END AS t
  FROM trimmed),
plain AS (
  SELECT table_name, record_id, list_filter(list_transform(t, lambda x: trim(CASE
    WHEN x LIKE '"%"' AND length(x) > 1 AND listed THEN replace(x[2:-2], '\"', '"')
    WHEN x LIKE '"%"' AND length(x) > 1 THEN replace(x[2:-2], '""', '"')
    WHEN x LIKE '''%''' AND length(x) > 1 THEN x[2:-2] ELSE x END)), lambda x: x <> '') AS v
  FROM tokens),
vals AS (
  SELECT table_name, record_id, unnest(range(1, len(v) + 1)) AS item_pos, unnest(v) AS item_value FROM plain)
"""

_P4_KEYS = r"""
keys AS (
  SELECT 'snapshots' AS table_name, CAST(repository_id AS VARCHAR) AS key_value, CAST(NULL AS BIGINT) AS binding_count FROM snapshots
  UNION ALL
  SELECT 'author_interfaces', lower(trim(regexp_replace(trim(model_author), '^~+', ''))), binding_count FROM author_interfaces)
"""

_P5_CHANGES = rf"""
latest AS (
  SELECT {_SID} AS sid, {_PATH} AS path, lower(trim(content_sha256)) AS c, lower(trim(git_blob_sha)) AS b
  FROM files WHERE snapshot_id IS NOT NULL AND path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_SID}, {_PATH}
    ORDER BY loaded_at DESC, lower(trim(content_sha256)) DESC NULLS LAST, lower(trim(git_blob_sha)) DESC NULLS LAST) = 1),
snaps AS (
  SELECT {_SID} AS sid, snapshot_id, repository_id, release_line, captured_at FROM snapshots
  WHERE repository_id IS NOT NULL AND {_SID} IN (SELECT sid FROM latest)
  QUALIFY row_number() OVER (PARTITION BY {_SID} ORDER BY loaded_at DESC, captured_at DESC) = 1),
pairs AS (
  SELECT sid AS old_sid, snapshot_id AS old_snapshot_id,
    lead(sid) OVER w AS new_sid, lead(snapshot_id) OVER w AS new_snapshot_id
  FROM snaps WINDOW w AS (PARTITION BY repository_id, release_line ORDER BY captured_at, sid)),
o AS (SELECT p.*, l.path, l.c, l.b FROM pairs p JOIN latest l ON l.sid = p.old_sid WHERE p.new_sid IS NOT NULL),
n AS (SELECT p.*, l.path, l.c, l.b FROM pairs p JOIN latest l ON l.sid = p.new_sid),
changes AS (
  SELECT coalesce(o.old_snapshot_id, n.old_snapshot_id) AS old_snapshot_id,
    coalesce(o.new_snapshot_id, n.new_snapshot_id) AS new_snapshot_id, coalesce(o.path, n.path) AS path,
    CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM o FULL JOIN n ON o.old_sid = n.old_sid AND o.path = n.path
  WHERE o.path IS NULL OR n.path IS NULL OR
    CASE WHEN o.c IS NULL OR n.c IS NULL THEN o.b IS DISTINCT FROM n.b ELSE o.c <> n.c END)
"""

_P6_ORPHANS = rf"""
orphans AS (
  SELECT 'snapshots' AS child_table, snapshot_id AS child_key, CAST(repository_id AS VARCHAR) AS parent_key, loaded_at FROM snapshots s
  WHERE repository_id IS NOT NULL AND NOT EXISTS
    (SELECT 1 FROM repositories r WHERE r.repository_id = s.repository_id AND r.deleted_at IS NULL)
  UNION ALL
  SELECT 'releases', release_id, {_SID}, loaded_at FROM releases
  WHERE snapshot_id IS NOT NULL AND {_SID} NOT IN (SELECT {_SID} FROM snapshots WHERE snapshot_id IS NOT NULL)
  UNION ALL
  SELECT 'files', path, {_SID}, loaded_at FROM files
  WHERE snapshot_id IS NOT NULL AND {_SID} NOT IN (SELECT {_SID} FROM snapshots WHERE snapshot_id IS NOT NULL))
"""

ORACLES = {
    "p3_found": f"WITH {_P3_VALUES} SELECT table_name, record_id, CAST(item_pos AS BIGINT) AS item_pos, item_value FROM vals",
    "p4_found": f"""WITH {_P4_KEYS},
        n AS (SELECT table_name, key_value, count(*) AS n FROM keys WHERE key_value IS NOT NULL GROUP BY ALL)
        SELECT table_name, key_value FROM n QUALIFY n >= 0.05 * sum(n) OVER (PARTITION BY table_name)""",
    "p4_per_key": f"""WITH {_P4_KEYS} SELECT table_name, key_value, count(*) AS n_rows, CAST(sum(binding_count) AS BIGINT) AS binding_count
        FROM keys GROUP BY table_name, key_value""",
    "p4_joined": """SELECT r.name, s.release_line, count(*) AS n_rows, count(DISTINCT s.snapshot_id) AS n_snapshots
        FROM snapshots s JOIN (SELECT repository_id, max(name) AS name FROM repositories WHERE deleted_at IS NULL GROUP BY repository_id) r
        USING (repository_id) GROUP BY r.name, s.release_line""",
    "p5_found": f"WITH {_P5_CHANGES} SELECT old_snapshot_id, new_snapshot_id, path, change_kind FROM changes",
    "p5_summary": f"WITH {_P5_CHANGES} SELECT old_snapshot_id, new_snapshot_id, change_kind, count(*) AS n_paths FROM changes GROUP BY ALL",
    "p6_found": f"WITH {_P6_ORPHANS} SELECT DISTINCT child_table, child_key, parent_key FROM orphans",
    "p6_report": f"""WITH {_P6_ORPHANS} SELECT child_table, strftime(loaded_at, '%Y-%m') AS month, count(*) AS n_rows,
        count(DISTINCT parent_key) AS n_parents FROM orphans GROUP BY child_table, month""",
}
