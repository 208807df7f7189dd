"""Queries of the training-data problems that are not about text, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kasane.operators import badrows, drift, hierarchy, history, snapshots
from kasane.runtime import table


def _p1_found(spark, d):
    return snapshots.record_changes(table(spark, d, "storage_record"))


def _p1_summary(spark, d):
    return snapshots.release_summary(table(spark, d, "storage_record"), table(spark, d, "pmgs_release"))


def _p2_found(spark, d):
    return hierarchy.revision_depths(table(spark, d, "revision_relation"), table(spark, d, "concept_revision"))


def _p2_paths(spark, d):
    return hierarchy.revision_paths(table(spark, d, "revision_relation"), table(spark, d, "concept_revision"))


def _p2_descendants(spark, d):
    return hierarchy.revision_descendants(table(spark, d, "revision_relation"), table(spark, d, "concept_revision")).select(
        "revision_id", "root_revision_id", "n_descendants"
    )


def _p2_records(spark, d):
    return hierarchy.record_depths(table(spark, d, "storage_record"))


def _p2_descendant_list(spark, d):
    return hierarchy.revision_descendant_list(table(spark, d, "revision_relation"), table(spark, d, "concept_revision"))


def _p2_revisions(spark, d):
    return hierarchy.revision_hierarchy(table(spark, d, "revision_relation"), table(spark, d, "concept_revision"))


def _p2_releases(spark, d):
    return hierarchy.record_hierarchy(table(spark, d, "storage_record")).select(
        "release_id", "record", "root_record", "depth", "path", (F.col("tout") - F.col("tin")).alias("n_descendants")
    )


def _p2_release_spans(spark, d):
    return hierarchy.record_hierarchy(table(spark, d, "storage_record"))


def _p4_found(spark, d):
    return history.record_history(table(spark, d, "storage_record"), min_periods=2).select(
        "scheme", "edition", "normalized_code", "version", "first_release_id", "last_release_id"
    )


def _p4_periods(spark, d):
    return history.record_history(table(spark, d, "storage_record"))


def _p3_found(spark, d):
    return drift.field_changes(table(spark, d, "source_record"), table(spark, d, "source_file"))


def _p3_schema(spark, d):
    return drift.Drift(table(spark, d, "source_record"), table(spark, d, "source_file")).schema()


def _p3_unified(spark, d):
    return drift.unified_rows(table(spark, d, "source_record"), table(spark, d, "source_file"))


def _p6_found(spark, d):
    _, bad = badrows.split_rows(table(spark, d, "raw_record"), table(spark, d, "source_file"))
    return bad.select("file_id", "line_number", "reason")


def _p6_loaded(spark, d):
    good, _ = badrows.split_rows(table(spark, d, "raw_record"), table(spark, d, "source_file"))
    return good.select("file_id", "line_number", "data_group", "cells")


QUERIES = {
    "p3_found": _p3_found,
    "p3_unified": _p3_unified,
    "p3_schema": _p3_schema,
    "p6_found": _p6_found,
    "p6_loaded": _p6_loaded,
    "p1_found": _p1_found,
    "p1_summary": _p1_summary,
    "p2_found": _p2_found,
    "p2_paths": _p2_paths,
    "p2_descendants": _p2_descendants,
    "p2_descendant_list": _p2_descendant_list,
    "p2_records": _p2_records,
    "p2_revisions": _p2_revisions,
    "p2_releases": _p2_releases,
    "p2_release_spans": _p2_release_spans,
    "p4_found": _p4_found,
    "p4_periods": _p4_periods,
}

_STATE = r"""
WITH clean AS (
  SELECT release_id, coalesce(scheme, '') AS scheme, coalesce(edition, '') AS edition,
         upper(regexp_replace(normalized_code, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g')) AS normalized_code,
         record_status,
         regexp_replace(coalesce(version, ''), '[()（）\s]', '', 'g') AS version,
         replace(trim(coalesce(valid_from, '')), '-', '') AS valid_from,
         CASE WHEN replace(trim(coalesce(valid_to, '')), '-', '') = '99991231' THEN ''
              ELSE replace(trim(coalesce(valid_to, '')), '-', '') END AS valid_to,
         to_json(list_sort(list_distinct(list_transform(labels, lambda x: concat_ws('|', coalesce(x.kind, ''), coalesce(x.language, ''), coalesce(x.text, '')))))) AS labels,
         to_json(list_sort(list_distinct(list_transform(relations, lambda x: concat_ws('|', coalesce(x.type, ''), coalesce(x.scheme, ''), coalesce(x.code, ''), coalesce(x.edition, '')))))) AS relations,
         loaded_at
  FROM storage_record),
one AS (
  SELECT *, dense_rank() OVER (ORDER BY release_id) AS pos FROM clean
  QUALIFY row_number() OVER (PARTITION BY release_id, scheme, edition, normalized_code ORDER BY loaded_at DESC) = 1)
"""

_CHANGES = _STATE + """,
rel AS (SELECT DISTINCT release_id, pos FROM one),
diff AS (
  SELECT coalesce(n.pos, o.pos + 1) AS pos, coalesce(n.scheme, o.scheme) AS scheme, coalesce(n.edition, o.edition) AS edition,
         coalesce(n.normalized_code, o.normalized_code) AS normalized_code,
         CASE WHEN o.pos IS NULL THEN 'added' WHEN n.pos IS NULL THEN 'removed'
              WHEN (o.record_status, o.version, o.valid_from, o.valid_to, o.labels, o.relations)
                   IS DISTINCT FROM (n.record_status, n.version, n.valid_from, n.valid_to, n.labels, n.relations) THEN 'changed' END AS change
  FROM one n FULL JOIN one o
    ON n.pos = o.pos + 1 AND n.scheme = o.scheme AND n.edition = o.edition AND n.normalized_code = o.normalized_code),
found AS (
  SELECT release_id, scheme, edition, normalized_code, change FROM diff JOIN rel USING (pos) WHERE change IS NOT NULL AND pos > 1)
"""

_PERIODS = _STATE + """,
marked AS (
  SELECT *, CASE WHEN lag(pos) OVER w = pos - 1 AND lag(version) OVER w = version AND lag(valid_from) OVER w = valid_from
                  AND lag(valid_to) OVER w = valid_to THEN 0 ELSE 1 END AS fresh
  FROM one WINDOW w AS (PARTITION BY scheme, edition, normalized_code ORDER BY pos)),
runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY scheme, edition, normalized_code ORDER BY pos) AS run FROM marked),
periods AS (
  SELECT scheme, edition, normalized_code, version, valid_from, valid_to,
         min(release_id) AS first_release_id, max(release_id) AS last_release_id
  FROM runs GROUP BY scheme, edition, normalized_code, run, version, valid_from, valid_to)
"""

_LINKS = """
WITH RECURSIVE link AS (
  SELECT v, min(p) AS p FROM (
    SELECT CASE WHEN lower(trim(kind)) = 'parent' THEN from_revision_id ELSE to_revision_id END AS v,
           CASE WHEN lower(trim(kind)) = 'parent' THEN to_revision_id ELSE from_revision_id END AS p
    FROM revision_relation WHERE lower(trim(kind)) IN ('parent', 'child'))
  WHERE v IN (SELECT revision_id FROM concept_revision) AND p IN (SELECT revision_id FROM concept_revision)
  GROUP BY v),
walk AS (
  SELECT v, p AS cur, [v, p] AS path, v = p AS looped FROM link
  UNION ALL
  SELECT w.v, l.p, list_append(w.path, l.p), list_contains(w.path, l.p) FROM walk w JOIN link l ON l.v = w.cur WHERE NOT w.looped),
ended AS (SELECT v, cur, path, looped FROM walk w WHERE looped OR NOT EXISTS (SELECT 1 FROM link l WHERE l.v = w.cur))
"""

_RELEASE_LINKS = _STATE.replace("WITH clean", "WITH RECURSIVE clean").replace("loaded_at\n", "loaded_at, relations AS rel\n") + """,
node AS (SELECT release_id, concat_ws('|', scheme, edition, normalized_code) AS v, rel FROM one),
link AS (
  SELECT release_id, v, min(p) AS p FROM (
    SELECT release_id, v, concat_ws('|', coalesce(r.scheme, ''), coalesce(r.edition, ''), upper(regexp_replace(r.code, '\\s', '', 'g'))) AS p
    FROM (SELECT release_id, v, unnest(rel) AS r FROM node) WHERE lower(trim(r.type)) = 'parent')
  WHERE (release_id, p) IN (SELECT release_id, v FROM node) GROUP BY release_id, v),
walk AS (
  SELECT release_id, v, v AS cur, [v] AS path, false AS looped FROM node
  UNION ALL
  SELECT w.release_id, w.v, l.p, list_append(w.path, l.p), list_contains(w.path, l.p)
  FROM walk w JOIN link l ON l.release_id = w.release_id AND l.v = w.cur WHERE NOT w.looped),
ended AS (
  SELECT release_id, v, cur, path, looped FROM walk w
  WHERE looped OR NOT EXISTS (SELECT 1 FROM link l WHERE l.release_id = w.release_id AND l.v = w.cur)),
below AS (SELECT release_id, u, count(*) - 1 AS n FROM (SELECT release_id, unnest(path) AS u FROM ended WHERE NOT looped) GROUP BY release_id, u)
"""

SQL = {
    "p2_releases": _RELEASE_LINKS
    + """SELECT e.release_id, e.v AS record,
       CASE WHEN looped THEN list_min(list_slice(path, list_position(path, cur), len(path))) ELSE cur END AS root_record,
       CAST(CASE WHEN NOT looped THEN len(path) - 1 WHEN cur = e.v THEN -1 ELSE -2 END AS BIGINT) AS depth,
       CASE WHEN NOT looped THEN list_reverse(path) END AS path, n AS n_descendants
FROM ended e LEFT JOIN below b ON b.release_id = e.release_id AND b.u = e.v""",
    "p1_found": _CHANGES + "SELECT * FROM found",
    "p1_summary": _CHANGES
    + """SELECT r.release_id,
       coalesce(r.source_manifest_sha256 = lag(r.source_manifest_sha256) OVER (ORDER BY r.release_id), false) AS same_manifest,
       coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, coalesce(n_changed, 0) AS n_changed
FROM pmgs_release r LEFT JOIN (
  SELECT release_id, count(*) FILTER (change = 'added') AS n_added, count(*) FILTER (change = 'removed') AS n_removed,
         count(*) FILTER (change = 'changed') AS n_changed FROM found GROUP BY release_id) USING (release_id)""",
    "p2_found": _LINKS
    + """SELECT v AS revision_id,
       CASE WHEN looped THEN list_min(list_slice(path, list_position(path, cur), len(path))) ELSE cur END AS root_revision_id,
       CAST(CASE WHEN NOT looped THEN len(path) - 1 WHEN cur = v THEN -1 ELSE -2 END AS BIGINT) AS depth
FROM ended""",
    "p2_paths": _LINKS
    + "SELECT v AS revision_id, array_to_string(list_reverse(path), '/') AS path FROM ended WHERE NOT looped",
    "p2_descendants": _LINKS
    + """SELECT u AS revision_id, root AS root_revision_id, count(*) - 1 AS n_descendants
FROM (SELECT unnest(path) AS u, cur AS root FROM ended WHERE NOT looped
      UNION ALL SELECT DISTINCT cur, cur FROM ended WHERE NOT looped)
GROUP BY u, root""",
    "p2_descendant_list": _LINKS + "SELECT * FROM (SELECT unnest(path) AS revision_id, v AS descendant_id FROM ended WHERE NOT looped) WHERE revision_id <> descendant_id",
    "p4_found": _PERIODS
    + """SELECT scheme, edition, normalized_code, version, first_release_id, last_release_id FROM periods
QUALIFY count(*) OVER (PARTITION BY scheme, edition, normalized_code) > 1""",
    "p4_periods": _PERIODS + "SELECT * FROM periods",
}

SQL["p2_records"] = f"SELECT release_id, record, root_record, depth FROM ({SQL['p2_releases']})"

# -- rows that fail to parse ---------------------------------------------------
_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _cell(i: int) -> str:
    return f"regexp_replace(coalesce(cells[{i + 1}], ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _day(i: int) -> str:
    return f"try_strptime(CASE WHEN regexp_full_match({_cell(i)}, '[0-9]{{8}}') THEN {_cell(i)} END, '%Y%m%d')"


def _whole(*at: int) -> str:
    return " AND ".join(f"regexp_full_match({_cell(i)}, '0*[1-9][0-9]*')" for i in at)


_CHECKED = rf"""
WITH rows AS (
  SELECT file_id, line_number, lower(regexp_replace(coalesce(data_group, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS g,
         regexp_replace(coalesce(raw_line, ''), '^\x{{feff}}|\r$', '', 'g') AS line
  FROM raw_record JOIN source_file USING (file_id) WHERE lower(trim(parser)) = 'python-csv'),
cut AS (
  SELECT *, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*') AS quoted,
    list_transform(regexp_extract_all(',' || line, ',({_FIELD})', 1),
      lambda c: CASE WHEN starts_with(c, '"') THEN replace(c[2:length(c) - 1], '""', '"') ELSE c END) AS cells
  FROM rows),
tested AS (
  SELECT *, len(cells) AS n,
    CASE g WHEN 'fi/fi' THEN len(cells) = 5 WHEN 'fi/fi_text' THEN len(cells) = 7 WHEN 'fi/fi_hb' THEN len(cells) = 5 WHEN 'ipc/ipc8u_text' THEN len(cells) = 11
      WHEN 'concordance' THEN len(cells) = 4 WHEN 'fterm/fterm' THEN len(cells) >= 5 WHEN 'fi/fi_kaisei_link' THEN len(cells) >= 2 ELSE true END AS count_ok,
    CASE g
      WHEN 'fi/fi' THEN {_cell(0)} <> '' AND {_whole(1)} AND regexp_full_match({_cell(4)}, '[0-9]+')
      WHEN 'fi/fi_text' THEN {_cell(0)} <> '' AND {_whole(1, 2)}
      WHEN 'fi/fi_hb' THEN {_cell(0)} <> '' AND {_whole(1)}
      WHEN 'ipc/ipc8u_text' THEN {_cell(0)} <> '' AND regexp_full_match({_cell(1)}, '\([0-9]{{4}}\.(0[1-9]|1[0-2])\)') AND {_whole(2, 3)} AND regexp_full_match({_cell(4)}, '[0-9]+')
        AND coalesce({_day(7)} <= {_day(8)}, false)
      WHEN 'concordance' THEN {_cell(1)} <> '' AND {_cell(3)} <> '' AND {_cell(0)} IN ('1', '4', '5', '6', '7', '8') AND {_cell(2)} IN ('1', '4', '5', '6', '7', '8')
      WHEN 'fterm/fterm' THEN {_cell(0)} <> '' AND {_whole(1)} AND regexp_full_match({_cell(2)}, '[0-9]+')
      WHEN 'fi/fi_kaisei_link' THEN {_cell(0)} <> ''
      ELSE true END AS value_ok
  FROM cut)
"""
SQL["p6_found"] = _CHECKED + """
SELECT file_id, line_number, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT count_ok THEN 'column_count' ELSE 'value' END AS reason
FROM tested WHERE NOT (quoted AND count_ok AND value_ok)"""
SQL["p6_loaded"] = _CHECKED + "SELECT file_id, line_number, g AS data_group, cells FROM tested WHERE quoted AND count_ok AND value_ok"
