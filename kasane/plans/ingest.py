"""Queries of the package adapters over the well-quoted raw rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kasane.operators import badrows
from kasane.plans.core import _CHECKED, _SPACE
from kasane.runtime import table
from kasane.sources import adapters

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn

    return keep


def _emitted(spark, d, kind: str, *stages, columns: tuple[str, ...]):
    """What the adapters emit over all raw rows that could be cut into cells."""
    files = table(spark, d, "source_file")
    rows = badrows.check_rows(table(spark, d, "raw_record"), files).where("cells is not null").select(
        "file_id", F.upper("data_group").alias("data_group"), F.col("line_number").alias("record_number"), "cells"
    )
    out = adapters.Emissions(files)
    for stage in stages:
        stage(out, rows)
    return adapters.union(getattr(out, kind)).select(*columns)


def _norm(c: str) -> str:
    return f"upper(regexp_replace({c}, '{_SPACE}', '', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _int(c: str) -> str:
    return f"TRY_CAST(CASE WHEN regexp_full_match({_strip(c)}, '-?[0-9]+') THEN {_strip(c)} END AS BIGINT)"


def _text(c: str) -> str:
    return _strip(f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')")


def _date(c: str) -> str:
    return f"CAST(coalesce(try_strptime(CASE WHEN regexp_full_match({_strip(c)}, '[0-9]{{8}}') THEN {_strip(c)} END, '%Y%m%d'), try_strptime(CASE WHEN regexp_full_match({_strip(c)}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {_strip(c)} END, '%Y-%m-%d')) AS DATE)"


def _type(scheme: str, code: str, level: str = "NULL") -> str:
    return (
        f"CASE WHEN {scheme} = 'fterm' THEN CASE length({code}) WHEN 5 THEN 'theme' WHEN 7 THEN 'aspect' ELSE 'term' END WHEN length({code}) = 1 THEN 'section' "
        f"WHEN length({code}) = 3 THEN 'class' WHEN length({code}) = 4 OR coalesce({level} <= 4, false) THEN 'subclass' ELSE 'group' END"
    )


_INNER = f"regexp_replace({_strip('version_raw')}, '[()]', '', 'g')"
_ROWS = _CHECKED + rf"""
, l AS (SELECT file_id, line_number AS record_number, upper(g) AS grp, list_transform(list_resize(cells, greatest(len(cells), 12), ''), lambda c: coalesce(c, '')) AS c, cells, len(cells) AS n FROM tested WHERE quoted),
fi AS (SELECT *, {_norm('c[1]')} AS key, {_int('c[5]')} AS level, {_int('c[2]')} AS seq FROM l WHERE grp = 'FI/FI' AND n = 5),
ft AS (SELECT *, {_norm('c[1]')} AS key, {_int('c[3]')} AS depth, {_int('c[2]')} AS seq FROM l WHERE grp = 'FTERM/FTERM' AND n >= 5 AND length({_norm('c[1]')}) >= 9 AND {_int('c[3]')} IS NOT NULL),
ip0 AS (SELECT file_id, record_number, {_norm('c[1]')} AS key, c[1] AS code, CASE WHEN n = 11 THEN c[2] ELSE '' END AS version_raw, {_int('CASE WHEN n = 11 THEN c[3] ELSE c[2] END')} AS seq,
   {_strip('CASE WHEN n = 11 THEN c[4] ELSE c[3] END')} AS kind, {_int('CASE WHEN n = 11 THEN c[5] ELSE c[4] END')} AS level, CASE WHEN n = 11 THEN c[11] ELSE c[6] END AS text,
   CASE WHEN n = 11 THEN c[8] ELSE '' END AS f, CASE WHEN n = 11 THEN c[9] ELSE '' END AS t FROM l WHERE grp = 'IPC/IPC8U_TEXT' AND n IN (6, 11)),
ip1 AS (SELECT *, CASE WHEN {_strip('version_raw')} = '' THEN '' WHEN regexp_full_match({_strip('version_raw')}, '\([^()]*\)|[^()]*')
   THEN CASE WHEN regexp_full_match({_INNER}, '[0-9]{{4}}\.[0-9]{{2}}') THEN {_INNER} WHEN {_INNER} = '' THEN '' END END AS version FROM ip0),
ip AS (SELECT * FROM ip1 WHERE seq > 0 AND version IS NOT NULL),
co AS (SELECT *, CASE WHEN {_strip('c[1]')} = '1' THEN 'fi' ELSE 'ipc' END AS s1, CASE {_strip('c[1]')} WHEN '1' THEN '' WHEN '8' THEN '8U' ELSE {_strip('c[1]')} END AS e1,
   CASE WHEN {_strip('c[3]')} = '1' THEN 'fi' ELSE 'ipc' END AS s2, CASE {_strip('c[3]')} WHEN '1' THEN '' WHEN '8' THEN '8U' ELSE {_strip('c[3]')} END AS e2 FROM l WHERE grp = 'CONCORDANCE' AND n = 4),
ka AS (SELECT *, {_norm('c[1]')} AS key FROM l WHERE grp = 'FI/FI_KAISEI_LINK' AND n >= 2)
"""
_CONCEPT = ("scheme", "edition", "code", "normalized_code", "concept_type", "record_status", "version", "valid_from", "valid_to", "level", "sequence_number", "file_id", "record_number")


def _concept(scheme: str, edition: str, code: str, kind: str, status: str, source: str, version: str = "''", f: str = "CAST(NULL AS DATE)", t: str = "CAST(NULL AS DATE)", level: str = "CAST(NULL AS BIGINT)", seq: str = "CAST(NULL AS BIGINT)") -> str:
    return (
        f"SELECT {scheme} AS scheme, {edition} AS edition, {code} AS code, {_norm(code)} AS normalized_code, {kind} AS concept_type, '{status}' AS record_status, {version} AS version, "
        f"{f} AS valid_from, {t} AS valid_to, {level} AS level, {seq} AS sequence_number, file_id, record_number FROM {source} WHERE {_norm(code)} <> ''"
    )


@query("ingest_fi_codes", _ROWS + _concept("'fi'", "''", "c[1]", _type("'fi'", "key", "level"), "canonical", "fi", level="level", seq="seq"))
def _fi(spark, d):
    return _emitted(spark, d, "concepts", adapters.fi_codes, columns=_CONCEPT)


@query("ingest_fterms", _ROWS + " UNION ALL ".join((
    _concept("'fterm'", "''", "left(key, 5)", "'theme'", "canonical", "ft", level="0::BIGINT"), _concept("'fterm'", "''", "left(key, 7)", "'aspect'", "canonical", "ft", level="1::BIGINT"),
    _concept("'fterm'", "''", "key", "'term'", "canonical", "ft", level="depth + 2", seq="seq"))))
def _ft(spark, d):
    return _emitted(spark, d, "concepts", adapters.fterms, columns=_CONCEPT)


@query("ingest_ipc", _ROWS + _concept("'ipc'", "'8U'", "code", _type("'ipc'", "key", "level"), "canonical", "ip", "version", _date("f"), _date("t"), "level"))
def _ipc(spark, d):
    return _emitted(spark, d, "concepts", adapters.ipc, columns=_CONCEPT)


@query("ingest_references", _ROWS + " UNION ALL ".join((
    _concept("s1", "e1", "c[2]", _type("s1", _norm("c[2]")), "reference_only", "co"), _concept("s2", "e2", "c[4]", _type("s2", _norm("c[4]")), "reference_only", "co"),
    _concept("'fi'", "''", "c[1]", _type("'fi'", "key"), "reference_only", "ka"))))
def _refs(spark, d):
    return _emitted(spark, d, "concepts", adapters.concordance, adapters.amendment_index, columns=_CONCEPT)


_TEXT = ("scheme", "edition", "normalized_code", "version", "language", "kind", "sequence_number", "text", "file_id", "record_number")


@query("ingest_texts", _ROWS + f"""
SELECT * FROM (
  SELECT 'fi' AS scheme, '' AS edition, {_norm('c[1]')} AS normalized_code, '' AS version, 'ja' AS language, 'fi_text_type_' || coalesce(nullif({_strip('c[3]')}, ''), 'unknown') AS kind,
    coalesce({_int('c[2]')}, 1) AS sequence_number, {_text('c[7]')} AS text, file_id, record_number FROM l WHERE grp = 'FI/FI_TEXT' AND n = 7
  UNION ALL SELECT 'fterm', '', key, '', 'ja', 'label', 1, {_text("array_to_string(cells[4:n - 1], ',')")}, file_id, record_number FROM ft
  UNION ALL SELECT 'ipc', '8U', key, version, 'ja', 'ipc_text_type_' || coalesce(nullif(kind, ''), 'unknown'), seq, {_text('text')}, file_id, record_number FROM ip)
WHERE text <> '' AND text <> '(Not Translated)'""")
def _texts(spark, d):
    return _emitted(spark, d, "texts", adapters.fi_texts, adapters.fterms, adapters.ipc, columns=_TEXT)


@query("ingest_properties", _ROWS + f"""
, first AS (SELECT * FROM fi WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY file_id, record_number) = 1)
SELECT * FROM (SELECT 'fi' AS scheme, key AS normalized_code, 'fi_marker' AS name, {_text('c[3]')} AS value, file_id, record_number FROM first
  UNION ALL SELECT 'fi', key, 'fi_status', {_text('c[4]')}, file_id, record_number FROM first
  UNION ALL SELECT 'fterm', key, 'fi_scope', {_text('coalesce(cells[-1], %s)' % "''")}, file_id, record_number FROM ft) WHERE value <> ''""")
def _props(spark, d):
    return _emitted(spark, d, "properties", adapters.fi_codes, adapters.fterms, columns=("scheme", "normalized_code", "name", "value", "file_id", "record_number")).where("name in ('fi_marker', 'fi_status', 'fi_scope')")


def _nearest(source: str, depth: str, extra: str = "") -> str:
    return f"(SELECT p.key FROM {source} p WHERE p.file_id = r.file_id {extra} AND p.{depth} < r.{depth} AND p.record_number < r.record_number ORDER BY p.record_number DESC LIMIT 1)"


@query("ingest_relations", _ROWS + f"""
, fresh AS (SELECT * FROM fi WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY file_id, record_number) = 1),
lf AS (SELECT * FROM fresh WHERE level IS NOT NULL), li AS (SELECT * FROM ip WHERE level IS NOT NULL AND key <> ''),
fa AS (SELECT *, left(key, 7) AS aspect, CASE WHEN lag(left(key, 7)) OVER w IS NOT DISTINCT FROM left(key, 7) AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS opens FROM ft WINDOW w AS (PARTITION BY file_id ORDER BY record_number)),
fr AS (SELECT *, sum(opens) OVER (PARTITION BY file_id ORDER BY record_number) AS island FROM fa)
SELECT * FROM (
  SELECT 'fi' AS from_scheme, '' AS from_edition, key AS from_code, 'fi' AS to_scheme, '' AS to_edition, {_nearest('lf', 'level')} AS to_code, 'parent' AS kind, file_id, record_number FROM lf r
  UNION ALL SELECT 'ipc', '8U', key, 'ipc', '8U', {_nearest('li', 'level')}, 'parent', file_id, record_number FROM li r
  UNION ALL SELECT 'fterm', '', left(key, 7), 'fterm', '', left(key, 5), 'parent', file_id, record_number FROM ft
  UNION ALL SELECT 'fterm', '', key, 'fterm', '', coalesce({_nearest('fr', 'depth', 'AND p.island = r.island')}, aspect), 'parent', file_id, record_number FROM fr r
  UNION ALL SELECT s1, e1, {_norm('c[2]')}, s2, e2, {_norm('c[4]')}, 'concordance', file_id, record_number FROM co)
WHERE from_code <> '' AND to_code <> ''""")
def _relations(spark, d):
    columns = ("from_scheme", "from_edition", "from_code", "to_scheme", "to_edition", "to_code", "kind", "file_id", "record_number")
    return _emitted(spark, d, "relations", adapters.fi_codes, adapters.fterms, adapters.ipc, adapters.concordance, columns=columns)


@query("ingest_segments", _ROWS + f"""
SELECT file_id, record_number AS sequence_number, 'row:' || record_number AS locator, {_norm('c[1]')} AS heading, {_text('c[5]')} AS text FROM l
WHERE grp = 'FI/FI_HB' AND n = 5 AND {_text('c[5]')} NOT IN ('', '(Not Translated)')""")
def _segments(spark, d):
    return _emitted(spark, d, "segments", adapters.documents, columns=("file_id", "sequence_number", "locator", "heading", "text"))


@query("ingest_entries", _ROWS + """
SELECT 'fi_amendment_index' AS category, key, 'ja' AS language, array_to_string(cells[2:], ',') AS value, file_id, 'row:' || record_number AS locator FROM ka""")
def _entries(spark, d):
    return _emitted(spark, d, "entries", adapters.amendment_index, columns=("category", "key", "language", "value", "file_id", "locator"))


@query("ingest_issues", _ROWS + f"""
SELECT code, file_id, 'row:' || record_number AS locator FROM (
  SELECT 'FI_COLUMN_COUNT' AS code, file_id, record_number FROM l WHERE grp = 'FI/FI' AND n <> 5
  UNION ALL SELECT 'FI_TEXT_COLUMN_COUNT', file_id, record_number FROM l WHERE grp = 'FI/FI_TEXT' AND n <> 7
  UNION ALL SELECT 'DOCUMENT_COLUMN_COUNT', file_id, record_number FROM l WHERE grp = 'FI/FI_HB' AND n <> 5
  UNION ALL SELECT 'CONCORDANCE_COLUMN_COUNT', file_id, record_number FROM l WHERE grp = 'CONCORDANCE' AND n <> 4
  UNION ALL SELECT 'FI_AMENDMENT_LINK_COLUMN_COUNT', file_id, record_number FROM l WHERE grp = 'FI/FI_KAISEI_LINK' AND n < 2
  UNION ALL SELECT 'IPC_COLUMN_COUNT', file_id, record_number FROM l WHERE grp = 'IPC/IPC8U_TEXT' AND n NOT IN (6, 11)
  UNION ALL SELECT 'IPC_SEQUENCE_INVALID', file_id, record_number FROM ip0 WHERE NOT coalesce(seq > 0, false)
  UNION ALL SELECT 'IPC_VERSION_INVALID', file_id, record_number FROM ip1 WHERE seq > 0 AND version IS NULL
  UNION ALL SELECT 'FTERM_SHAPE', file_id, record_number FROM l WHERE grp = 'FTERM/FTERM' AND NOT (n >= 5 AND length({_norm('c[1]')}) >= 9 AND {_int('c[3]')} IS NOT NULL)
  UNION ALL SELECT 'FI_AMENDMENT_DOCUMENT_MISSING', file_id, record_number FROM ka WHERE 'FI/FI_KAISEI_DOC/' || key || '.xml' NOT IN (SELECT relative_path FROM source_file WHERE data_group = 'FI/FI_KAISEI_DOC' AND file_type = 'xml'))""")
def _issues(spark, d):
    stages = (adapters.fi_codes, adapters.fi_texts, adapters.documents, adapters.concordance, adapters.amendment_index, adapters.ipc, adapters.fterms)
    return _emitted(spark, d, "issues", *stages, columns=("code", "file_id", "locator"))
