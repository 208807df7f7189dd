"""Queries of the store's own operators with their SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kasane.functions import text as tx
from kasane.operators import edges, publish, quality, search, temporal
from kasane.runtime import table

AS_OF = "2025-10-01"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORM = f"upper(regexp_replace(code, '{_WS}', '', 'g'))"


# -- filters and lookups ---------------------------------------------------
@query("point_lookup", "SELECT concept_id, scheme, edition, code, normalized_code, concept_type, record_status FROM concept WHERE scheme = 'ipc' AND edition = '8U' AND normalized_code = 'G06F3/00'")
def _point(spark, d):
    c = table(spark, d, "concept")
    return c.where((F.col("scheme") == "ipc") & (F.col("edition") == "8U") & (F.col("normalized_code") == "G06F3/00")).select(
        "concept_id", "scheme", "edition", "code", "normalized_code", "concept_type", "record_status"
    )


@query("validity_active", f"SELECT revision_id, concept_id, version_indicator FROM concept_revision WHERE (valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}')")
def _active(spark, d):
    return table(spark, d, "concept_revision").where(temporal.active_at(AS_OF)).select("revision_id", "concept_id", "version_indicator")


@query("validity_ambiguous", f"SELECT concept_id, count(*) AS n_active FROM concept_revision WHERE (valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}') GROUP BY concept_id HAVING count(*) > 1")
def _ambiguous(spark, d):
    return temporal.ambiguous(table(spark, d, "concept_revision"), AS_OF)


@query("pick_revision", f"""
WITH r AS (SELECT concept_id, count(*) AS n, count(*) FILTER (act) AS a, min(revision_id) FILTER (act) AS active, min(revision_id) AS only_one
  FROM (SELECT *, (valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}') AS act FROM concept_revision) GROUP BY concept_id)
SELECT c.concept_id, CASE WHEN a = 1 THEN active WHEN a = 0 AND n = 1 AND c.scheme <> 'ipc' THEN only_one END AS revision_id,
  CASE WHEN n IS NULL THEN 'not_found' WHEN a > 1 THEN 'ambiguous' WHEN a = 1 OR (n = 1 AND c.scheme <> 'ipc') THEN 'exact' ELSE 'not_valid_at_release' END AS match_status
FROM concept c LEFT JOIN r USING (concept_id)""")
def _pick(spark, d):
    return temporal.pick_revision(table(spark, d, "concept_revision"), table(spark, d, "concept"), AS_OF)


@query("available_versions", "SELECT concept_id, string_agg(version_indicator || '|' || coalesce(valid_from, '') || '|' || coalesce(valid_to, ''), ',' ORDER BY version_indicator, coalesce(valid_from, ''), revision_id) AS versions FROM concept_revision GROUP BY concept_id")
def _versions(spark, d):
    v = temporal.available_versions(table(spark, d, "concept_revision"))
    return v.select("concept_id", F.array_join(F.transform("versions", lambda s: F.concat_ws("|", s["version"], *(F.coalesce(s[k], F.lit("")) for k in ("valid_from", "valid_to")))), ",").alias("versions"))


@query("edition_priority", """
SELECT normalized_code, edition, concept_id FROM concept WHERE scheme = 'ipc'
QUALIFY row_number() OVER (PARTITION BY normalized_code ORDER BY coalesce(list_position(['8U','8B','7','7E','6','5','4'], edition), 8), edition, concept_id) = 1""")
def _edition(spark, d):
    return temporal.latest_edition(table(spark, d, "concept").where("scheme = 'ipc'").select("normalized_code", "edition", "concept_id"))


@query("record_shape", """
SELECT c.scheme, nullif(c.edition, '') AS edition, c.normalized_code, c.record_status, r.revision_id, nullif(r.version_indicator, '') AS version, r.valid_from, r.valid_to, coalesce(r.level, -1) AS level
FROM concept c LEFT JOIN concept_revision r USING (concept_id)""")
def _shape(spark, d):
    none = lambda c: F.nullif(c, F.lit(""))
    r = table(spark, d, "concept_revision").select("concept_id", "revision_id", none("version_indicator").alias("version"), "valid_from", "valid_to", "level")
    return table(spark, d, "concept").join(r, "concept_id", "left").select(
        "scheme", none("edition").alias("edition"), "normalized_code", "record_status", "revision_id", "version", "valid_from", "valid_to", F.coalesce("level", F.lit(-1)).alias("level")
    )


# -- scalars ---------------------------------------------------------------
@query("normalize_code", f"SELECT DISTINCT code, {_NORM} AS normalized FROM storage_record")
def _norm(spark, d):
    return table(spark, d, "storage_record").select("code").distinct().select("code", tx.norm_code(F.col("code")).alias("normalized"))


@query("group_key", f"SELECT DISTINCT scheme, {_NORM} AS normalized, CASE WHEN scheme = 'fterm' THEN left({_NORM}, 5) ELSE split_part({_NORM}, '/', 1) END AS group_key FROM storage_record")
def _group(spark, d):
    n = tx.norm_code(F.col("code"))
    return table(spark, d, "storage_record").select("scheme", n.alias("normalized")).distinct().withColumn("group_key", tx.group_key(F.col("scheme"), F.col("normalized")))


@query("lookup_key", "SELECT concept_id, concat_ws(chr(31), scheme, edition, normalized_code) AS lookup_key FROM concept")
def _key(spark, d):
    return table(spark, d, "concept").select("concept_id", tx.lookup_key(F.col("scheme"), F.col("edition"), F.col("normalized_code")).alias("lookup_key"))


@query("concept_type_case", """
SELECT concept_id, CASE WHEN scheme = 'fterm' THEN CASE length(normalized_code) WHEN 5 THEN 'theme' WHEN 7 THEN 'aspect' ELSE 'term' END
  ELSE CASE length(normalized_code) WHEN 1 THEN 'section' WHEN 3 THEN 'class' WHEN 4 THEN 'subclass' ELSE 'group' END END AS derived_type FROM concept""")
def _ctype(spark, d):
    return table(spark, d, "concept").select("concept_id", tx.concept_type(F.col("scheme"), F.col("normalized_code")).alias("derived_type"))


@query("iso_date_parse", """
SELECT DISTINCT valid_from AS raw, CAST(coalesce(try_strptime(CASE WHEN regexp_full_match(trim(valid_from), '\\d{8}') THEN trim(valid_from) END, '%Y%m%d'),
  try_strptime(CASE WHEN regexp_full_match(trim(valid_from), '\\d{4}-\\d{2}-\\d{2}') THEN trim(valid_from) END, '%Y-%m-%d')) AS DATE) AS day FROM storage_record""")
def _date(spark, d):
    return table(spark, d, "storage_record").select(F.col("valid_from").alias("raw")).distinct().withColumn("day", tx.iso_date(F.col("raw")))


@query("version_parse", """
SELECT DISTINCT version AS raw, CASE WHEN version IS NULL OR trim(version) = '' THEN '' WHEN regexp_full_match(trim(version), '\\(\\d{4}\\.\\d{2}\\)|\\d{4}\\.\\d{2}')
  THEN regexp_replace(trim(version), '[()]', '', 'g') END AS version FROM storage_record""")
def _version(spark, d):
    return table(spark, d, "storage_record").select(F.col("version").alias("raw")).distinct().withColumn("version", tx.version_indicator(F.col("raw")))


@query("int_parse", "SELECT revision_id, TRY_CAST(CASE WHEN regexp_full_match(split_part(source_locator, ':', 2), '-?[0-9]+') THEN split_part(source_locator, ':', 2) END AS BIGINT) AS row_no FROM concept_revision")
def _int(spark, d):
    return table(spark, d, "concept_revision").select("revision_id", tx.to_int(F.split_part("source_locator", F.lit(":"), F.lit(2))).alias("row_no"))


@query("percent_encode", "SELECT DISTINCT relative_path, replace(url_encode(relative_path), '%7E', '~') AS segment FROM source_file")
def _percent(spark, d):
    return table(spark, d, "source_file").select("relative_path").distinct().withColumn("segment", tx.path_segment(F.col("relative_path")))


@query("fragment_id", """
SELECT DISTINCT normalized_code, replace(replace(replace(replace(url_encode(normalized_code), '_', '_5F'), '.', '_2E'), '~', '_7E'), '%', '_') AS fragment FROM concept""")
def _fragment(spark, d):
    return table(spark, d, "concept").select("normalized_code").distinct().withColumn("fragment", tx.fragment_id(F.col("normalized_code")))


@query("sha_identity", """
SELECT file_id, 'src-' || left(sha256(relative_path || chr(0) || upper(sha256)), 24) AS made_id, upper(sha256(relative_path)) AS path_sha FROM source_file""")
def _sha(spark, d):
    return table(spark, d, "source_file").select("file_id", tx.source_id(F.col("relative_path"), F.col("sha256")).alias("made_id"), tx.sha_upper(F.col("relative_path")).alias("path_sha"))


@query("basename", "SELECT DISTINCT relative_path, list_extract(string_split(relative_path, '/'), -1) AS title FROM source_file")
def _base(spark, d):
    return table(spark, d, "source_file").select("relative_path").distinct().withColumn("title", F.element_at(F.split("relative_path", "/"), -1))


@query("json_extract", "SELECT file_id, record_number, json_extract_string(payload_json, '$.code') AS code FROM source_record")
def _json(spark, d):
    return table(spark, d, "source_record").select("file_id", "record_number", F.get_json_object("payload_json", "$.code").alias("code"))


@query("html_escape", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents")
def _escape(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.html_escape(F.col("text")).alias("escaped"))


@query("excerpt", """
WITH m AS (SELECT doc_id, text, greatest(position('sensor' IN lower(text)) - 81, 0) AS s FROM documents WHERE contains(lower(text), 'sensor'))
SELECT doc_id, CASE WHEN s > 0 THEN '… ' ELSE '' END || substring(text, s + 1, 240) || CASE WHEN s + 240 < length(text) THEN ' …' ELSE '' END AS excerpt FROM m""")
def _excerpt(spark, d):
    return table(spark, d, "documents").where(F.lower("text").contains("sensor")).select("doc_id", tx.excerpt(F.col("text"), "sensor").alias("excerpt"))


@query("leak_scan", r"""
SELECT doc_id, regexp_matches(text, '(?i)(?:\b[a-z]:[\\/]|\\\\[a-z0-9._-]+\\|[\\/](?:home|users|root|tmp|mnt)[\\/])') AS local_path,
  regexp_matches(text, '(?i)(?:api[_-]?key|secret|passw(?:or)?d|access[_-]?token)\s*[:=]\s*[^\s,;]+') AS secret FROM documents""")
def _leak(spark, d):
    return publish.leaks(table(spark, d, "documents"), "doc_id", "text")


@query("query_encode", "SELECT DISTINCT relative_path, replace(url_encode(relative_path), '%20', '+') AS value FROM source_file")
def _query_encode(spark, d):
    return table(spark, d, "source_file").select("relative_path").distinct().withColumn("value", tx.query_value(F.col("relative_path")))


# -- search ----------------------------------------------------------------
_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("like_literal_search", f"SELECT doc_id FROM documents WHERE contains({_FOLD}, 'an') AND contains({_FOLD}, 'brake') ORDER BY doc_id LIMIT 20")
def _like(spark, d):
    t = table(spark, d, "documents")
    page, _ = search.search_page(t, "text", "an brake", ["doc_id"], ["doc_id"], 20)
    return page.orderBy("doc_id").limit(20).select("doc_id")


_BM25 = """
WITH base AS (SELECT doc_id, group_key, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM documents),
st AS (SELECT count(*) AS n, avg(len) AS d, count(*) FILTER (contains(t, 'sensor')) AS a, count(*) FILTER (contains(t, 'polymer')) AS b FROM base),
tf AS (SELECT doc_id, group_key, (length(t) - length(replace(t, 'sensor', ''))) / 6.0 AS fa, (length(t) - length(replace(t, 'polymer', ''))) / 7.0 AS fb, len FROM base WHERE contains(t, 'sensor') AND contains(t, 'polymer')),
ranked AS (SELECT doc_id, group_key, -(CASE WHEN ln((n - a + 0.5) / (a + 0.5)) > 0 THEN ln((n - a + 0.5) / (a + 0.5)) ELSE 1e-6 END * fa * 2.2 / (fa + 1.2 * (0.25 + 0.75 * len / d))
  + CASE WHEN ln((n - b + 0.5) / (b + 0.5)) > 0 THEN ln((n - b + 0.5) / (b + 0.5)) ELSE 1e-6 END * fb * 2.2 / (fb + 1.2 * (0.25 + 0.75 * len / d))) AS rank FROM tf, st)
"""


@query("bm25_search", _BM25 + "SELECT doc_id, round(rank, 9) AS rank FROM ranked ORDER BY round(rank, 9), doc_id LIMIT 20")
def _bm25(spark, d):
    found = search.hits(table(spark, d, "documents"), "text", "sensor polymer").select("doc_id", F.round("rank", 9).alias("rank"))
    return edges.page(found, ["rank", "doc_id"], 20)


@query("bm25_page2", _BM25 + "SELECT doc_id, round(rank, 9) AS rank FROM ranked ORDER BY round(rank, 9), doc_id LIMIT 20 OFFSET 20")
def _bm25_2(spark, d):
    found = search.hits(table(spark, d, "documents"), "text", "sensor polymer").select("doc_id", F.round("rank", 9).alias("rank"))
    return edges.page(found, ["rank", "doc_id"], 20, 20)


@query("search_distinct_parent", _BM25 + """, one AS (SELECT group_key, doc_id, round(rank, 9) AS rank FROM ranked
QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY round(rank, 9), doc_id) = 1) SELECT * FROM one ORDER BY rank, group_key LIMIT 25""")
def _distinct(spark, d):
    found = search.hits(table(spark, d, "documents"), "text", "sensor polymer").select("group_key", "doc_id", F.round("rank", 9).alias("rank"))
    return edges.page(search.best_per(found, ["group_key"], ["rank", "doc_id"]), ["rank", "group_key"], 25)


@query("composite_search", """
SELECT DISTINCT 'classification' AS hit_type, normalized_code AS hit FROM (SELECT normalized_code, unnest(labels) AS l FROM storage_record) WHERE contains(lower(l.text), 'gypsum board')
UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR) FROM documents WHERE contains(lower(text), 'gypsum board')""")
def _composite(spark, d):
    labels = table(spark, d, "storage_record").select("normalized_code", F.explode("labels").alias("l")).select("normalized_code", "l.text")
    a = search.hits(labels, "text", "gypsum board").where(F.lower("text").contains("gypsum board")).select(F.lit("classification").alias("hit_type"), F.col("normalized_code").alias("hit")).distinct()
    b = search.hits(table(spark, d, "documents"), "text", "gypsum board").where(F.lower("text").contains("gypsum board"))
    return a.unionByName(b.select(F.lit("document").alias("hit_type"), F.col("doc_id").cast("string").alias("hit")))


@query("trigram_postings", "SELECT DISTINCT gram, doc_id FROM (SELECT doc_id, unnest([substring(lower(text), CAST(i AS INT), 3) FOR i IN range(1, length(text) - 1)]) AS gram FROM documents WHERE length(text) >= 3)")
def _grams(spark, d):
    return search.trigrams(table(spark, d, "documents"), "doc_id", "text")


@query("posting_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'memory bank')")
def _posting(spark, d):
    t = table(spark, d, "documents")
    return search.by_postings(search.trigrams(t, "doc_id", "text"), t, "doc_id", "text", "memory bank").select("doc_id")


@query("page_selector", "SELECT group_key, doc_id, total FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY group_key) AS total FROM documents) WHERE n <= 5")
def _selector(spark, d):
    return edges.with_totals(table(spark, d, "documents").select("group_key", "doc_id"), ["group_key"], ["doc_id"], 5).select("group_key", "doc_id", "total")


# -- relations and hierarchy ----------------------------------------------
_BOTH = """
WITH clean AS (SELECT from_revision_id AS f, to_revision_id AS t, lower(trim(kind)) AS k, source_file_id, source_locator FROM revision_relation),
view AS (SELECT f AS src, t AS dst, k AS kind, source_file_id, source_locator FROM clean
  UNION ALL SELECT t, f, CASE k WHEN 'parent' THEN 'child' WHEN 'child' THEN 'parent' WHEN 'amended_to' THEN 'amended_from' ELSE k END, source_file_id, source_locator FROM clean)
"""


@query("relation_union_dedup", _BOTH + "SELECT src, dst, kind, source_file_id, source_locator FROM view QUALIFY row_number() OVER (PARTITION BY src, dst, kind ORDER BY source_file_id, source_locator) = 1")
def _dedup(spark, d):
    view = edges.both_ways(table(spark, d, "revision_relation"), "from_revision_id", "to_revision_id", lineage=("source_file_id", "source_locator"))
    return edges.least_lineage(view, ["src", "dst", "kind"])


def _hop(direction: str, kind: str):
    sql = _BOTH + f"SELECT DISTINCT v.src, v.dst, r.concept_id, r.version_indicator FROM view v JOIN concept_revision r ON r.revision_id = v.dst WHERE v.kind = '{kind}'"

    @query(f"hierarchy_{direction}", sql)
    def run(spark, d):
        hop = edges.one_hop(table(spark, d, "revision_relation"), table(spark, d, "concept_revision"), "revision_id", direction)
        return hop.select("src", "dst", "concept_id", "version_indicator")


_hop("children", "child")
_hop("parents", "parent")


@query("hierarchy_page", _BOTH + """, kids AS (SELECT DISTINCT src, dst FROM view WHERE kind = 'child' AND dst IN (SELECT revision_id FROM concept_revision)),
n AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS r, count(*) OVER (PARTITION BY src) AS total FROM kids)
SELECT src, dst, total, total > 3 AS truncated, CASE WHEN total > 3 THEN 3 END AS next_offset FROM n WHERE r <= 3""")
def _hpage(spark, d):
    hop = edges.one_hop(table(spark, d, "revision_relation"), table(spark, d, "concept_revision"), "revision_id", "children").select("src", "dst")
    return edges.with_totals(hop, ["src"], ["dst"], 3)


@query("stack_parent", """
SELECT r.revision_id, (SELECT p.revision_id FROM concept_revision p WHERE p.source_file_id = r.source_file_id AND p.level < r.level
   AND (p.sequence_number, p.revision_id) < (r.sequence_number, r.revision_id) AND p.sequence_number IS NOT NULL ORDER BY p.sequence_number DESC, p.revision_id DESC LIMIT 1) AS parent
FROM concept_revision r WHERE r.sequence_number IS NOT NULL""")
def _stack(spark, d):
    rows = table(spark, d, "concept_revision").where("sequence_number is not null").select("revision_id", "source_file_id", "sequence_number", "level")
    return temporal.stack_parent(rows, ["source_file_id"], ["sequence_number", "revision_id"], "level", "revision_id").select("revision_id", "parent")


@query("run_islands", """
WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f""")
def _islands(spark, d):
    return temporal.island_ids(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "island")


# -- upserts ---------------------------------------------------------------
_SR = f"SELECT scheme, coalesce(edition, '') AS edition, upper(regexp_replace(normalized_code, '{_WS}', '', 'g')) AS normalized_code, record_status, coalesce(version, '') AS version, release_id, loaded_at, code FROM storage_record"


def _sr(spark, d):
    return table(spark, d, "storage_record").select(
        "scheme", F.coalesce("edition", F.lit("")).alias("edition"), tx.norm_code(F.col("normalized_code")).alias("normalized_code"),
        "record_status", F.coalesce("version", F.lit("")).alias("version"), "release_id", "loaded_at", "code",
    )


@query("first_writer_wins", f"""
SELECT scheme, edition, normalized_code, record_status, release_id FROM ({_SR})
QUALIFY row_number() OVER (PARTITION BY scheme, edition, normalized_code ORDER BY CASE WHEN record_status = 'canonical' THEN 0 ELSE 1 END, release_id, loaded_at, code, record_status) = 1""")
def _first(spark, d):
    rows = _sr(spark, d).drop("version")
    won = temporal.first_writer(rows, ["scheme", "edition", "normalized_code"], ["release_id", "loaded_at", "code", "record_status"], F.col("record_status") == "canonical")
    return won.select("scheme", "edition", "normalized_code", "record_status", "release_id")


@query("upsert_conflict", f"""
WITH s AS ({_SR}), w AS (SELECT scheme, edition, normalized_code, version AS v FROM s
  QUALIFY row_number() OVER (PARTITION BY scheme, edition, normalized_code ORDER BY release_id, loaded_at, code, version) = 1)
SELECT s.scheme, s.edition, s.normalized_code, count(*) AS n_conflicts FROM s JOIN w USING (scheme, edition, normalized_code) WHERE s.version <> w.v GROUP BY ALL""")
def _conflict(spark, d):
    keys = ["scheme", "edition", "normalized_code"]
    return temporal.conflicts(_sr(spark, d), keys, ["release_id", "loaded_at", "code", "version"], ["version"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_conflicts"))


@query("parent_conflict", _BOTH + "SELECT src, kind, count(DISTINCT dst) AS n_ends, min(dst) AS kept FROM view GROUP BY src, kind HAVING count(DISTINCT dst) > 1")
def _pconf(spark, d):
    view = edges.both_ways(table(spark, d, "revision_relation"), "from_revision_id", "to_revision_id").distinct()
    return view.groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n_ends"), F.min("dst").alias("kept")).where("n_ends > 1")


# -- aggregates ------------------------------------------------------------
@query("coverage_counts", "SELECT scheme, edition, count(*) AS n, count(*) FILTER (record_status = 'canonical') AS n_canonical, count(*) FILTER (record_status <> 'canonical') AS n_reference FROM concept GROUP BY ALL")
def _coverage(spark, d):
    canon = F.col("record_status") == "canonical"
    return table(spark, d, "concept").groupBy("scheme", "edition").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(canon, 1)).alias("n_canonical"), F.count(F.when(~canon, 1)).alias("n_reference")
    )


@query("release_counts", """
SELECT r.release_id, r.reference_date, coalesce(f.n, 0) AS n_files, coalesce(f.bytes, 0) AS n_bytes, coalesce(s.n, 0) AS n_records
FROM pmgs_release r LEFT JOIN (SELECT release_id, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM source_file GROUP BY 1) f USING (release_id)
LEFT JOIN (SELECT release_id, count(*) AS n FROM storage_record GROUP BY 1) s USING (release_id)""")
def _release(spark, d):
    f = table(spark, d, "source_file").groupBy("release_id").agg(F.count(F.lit(1)).alias("f"), F.sum("size_bytes").alias("b"))
    s = table(spark, d, "storage_record").groupBy("release_id").agg(F.count(F.lit(1)).alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return table(spark, d, "pmgs_release").join(f, "release_id", "left").join(s, "release_id", "left").select(
        "release_id", "reference_date", zero("f").alias("n_files"), zero("b").alias("n_bytes"), zero("s").alias("n_records")
    )


@query("document_counts", "SELECT kind, coalesce(lower(trim(lang)), 'und') AS language, count(*) AS n FROM documents GROUP BY ALL")
def _docs(spark, d):
    return table(spark, d, "documents").groupBy("kind", F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("lineage_union", "SELECT concept_id, string_agg(f, ',' ORDER BY f) AS sources FROM (SELECT concept_id, source_file_id AS f FROM concept UNION SELECT concept_id, source_file_id FROM concept_revision) GROUP BY concept_id")
def _lineage(spark, d):
    both = table(spark, d, "concept").select("concept_id", "source_file_id").unionByName(table(spark, d, "concept_revision").select("concept_id", "source_file_id"))
    return both.groupBy("concept_id").agg(F.array_join(F.sort_array(F.collect_set("source_file_id")).cast("array<string>"), ",").alias("sources"))


@query("size_percentiles", "SELECT data_type AS file_type, quantile_disc(size_bytes, 0.5) AS p50, quantile_disc(size_bytes, 0.95) AS p95, max(size_bytes) AS largest FROM (SELECT file_type AS data_type, size_bytes FROM source_file) GROUP BY 1")
def _percentiles(spark, d):
    return table(spark, d, "source_file").groupBy("file_type").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size_bytes)").cast("long").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY size_bytes)").cast("long").alias("p95"), F.max("size_bytes").alias("largest"),
    )


@query("inventory_summary", """
SELECT 'status' AS dimension, status AS value, count(*) AS n FROM source_file GROUP BY 2 UNION ALL SELECT 'file_type', file_type, count(*) FROM source_file GROUP BY 2
UNION ALL SELECT 'data_group', upper(trim(data_group)), count(*) FROM source_file GROUP BY 2""")
def _inventory(spark, d):
    return quality.inventory_summary(table(spark, d, "source_file"))


@query("group_index", """
WITH g AS (SELECT scheme, edition, CASE WHEN scheme = 'fterm' THEN left(normalized_code, 5) ELSE split_part(normalized_code, '/', 1) END AS group_key, count(*) AS n_concepts, min(concept_id) AS first_id FROM concept GROUP BY ALL),
top AS (SELECT min(coalesce(list_position(['8U','8B','7','7E','6','5','4'], edition), 8)) AS r FROM concept WHERE scheme = 'ipc')
SELECT scheme AS kind, edition, group_key, n_concepts, first_id FROM g
UNION ALL SELECT 'ipc-current', '', group_key, n_concepts, first_id FROM g, top WHERE scheme = 'ipc' AND coalesce(list_position(['8U','8B','7','7E','6','5','4'], edition), 8) = r""")
def _gindex(spark, d):
    return publish.group_index(table(spark, d, "concept"))


@query("several_versions_none_active", f"""
SELECT concept_id, count(*) AS n FROM concept_revision GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER ((valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}')) = 0""")
def _dormant(spark, d):
    return temporal.dormant(table(spark, d, "concept_revision"), AS_OF)


# -- joins, sets, quality --------------------------------------------------
@query("semi_exists", "SELECT concept_id FROM concept c WHERE EXISTS (SELECT 1 FROM concept_revision r WHERE r.concept_id = c.concept_id AND r.version_indicator <> '')")
def _semi(spark, d):
    r = table(spark, d, "concept_revision").where("version_indicator <> ''").select("concept_id")
    return table(spark, d, "concept").join(r, "concept_id", "left_semi").select("concept_id")


@query("anti_not_exists", f"SELECT concept_id FROM concept c WHERE NOT EXISTS (SELECT 1 FROM concept_revision r WHERE r.concept_id = c.concept_id AND (valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}'))")
def _anti(spark, d):
    r = table(spark, d, "concept_revision").where(temporal.active_at(AS_OF)).select("concept_id")
    return table(spark, d, "concept").join(r, "concept_id", "left_anti").select("concept_id")


@query("left_parity", """
SELECT coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN b.file_id IS NULL THEN 'missing' WHEN a.file_id IS NULL THEN 'extra' ELSE 'differs' END AS issue
FROM (SELECT file_id, record_count FROM source_file) a FULL JOIN (SELECT file_id, count(*) AS record_count FROM source_record GROUP BY 1) b USING (file_id)
WHERE a.record_count IS DISTINCT FROM b.record_count""")
def _parity(spark, d):
    b = table(spark, d, "source_record").groupBy("file_id").agg(F.count(F.lit(1)).alias("record_count"))
    return quality.parity(table(spark, d, "source_file").select("file_id", "record_count"), b, ["file_id"], ["record_count"])


@query("symmetric_difference", """
WITH a AS (SELECT DISTINCT scheme, edition, normalized_code, version_indicator AS version FROM concept JOIN concept_revision USING (concept_id)), b AS (SELECT DISTINCT scheme, edition, normalized_code, version FROM (""" + _SR + """))
(SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) UNION ALL (SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a))""")
def _symm(spark, d):
    keys = ["scheme", "edition", "normalized_code", "version"]
    known = table(spark, d, "concept").join(table(spark, d, "concept_revision").select("concept_id", F.col("version_indicator").alias("version")), "concept_id")
    return quality.symmetric_difference(known.select(*keys), _sr(spark, d).select(*keys))


@query("intersect_groups", f"SELECT DISTINCT group_key FROM documents INTERSECT SELECT CASE WHEN scheme = 'fterm' THEN left(normalized_code, 5) ELSE split_part(normalized_code, '/', 1) END FROM concept")
def _intersect(spark, d):
    return table(spark, d, "documents").select("group_key").intersect(table(spark, d, "concept").select(tx.group_key(F.col("scheme"), F.col("normalized_code")).alias("group_key")))


@query("fk_orphans", "SELECT revision_relation_id, 'from' AS side, from_revision_id AS revision_id FROM revision_relation WHERE from_revision_id IS NOT NULL AND from_revision_id NOT IN (SELECT revision_id FROM concept_revision) UNION ALL SELECT revision_relation_id, 'to', to_revision_id FROM revision_relation WHERE to_revision_id IS NOT NULL AND to_revision_id NOT IN (SELECT revision_id FROM concept_revision)")
def _orphans(spark, d):
    links, nodes = table(spark, d, "revision_relation"), table(spark, d, "concept_revision")
    ends = [quality.orphans(links, f"{s}_revision_id", nodes, "revision_id").select("revision_relation_id", F.lit(s).alias("side"), F.col(f"{s}_revision_id").alias("revision_id")) for s in ("from", "to")]
    return ends[0].unionByName(ends[1])


@query("record_count_check", """
SELECT release_id AS file_id, source_file_count AS declared, coalesce(n, 0) AS actual FROM pmgs_release LEFT JOIN (SELECT release_id, count(*) AS n FROM source_file GROUP BY 1) USING (release_id) WHERE source_file_count <> coalesce(n, 0)
UNION ALL SELECT CAST(file_id AS VARCHAR), record_count, coalesce(n, 0) FROM source_file LEFT JOIN (
  SELECT file_id, count(*) AS n FROM (SELECT file_id FROM source_record UNION ALL SELECT file_id FROM raw_record) GROUP BY 1) USING (file_id) WHERE record_count <> coalesce(n, 0)""")
def _rcount(spark, d):
    files = table(spark, d, "source_file")
    packages = quality.record_counts(table(spark, d, "pmgs_release").select(F.col("release_id").alias("file_id"), F.col("source_file_count").alias("record_count")), [files.select(F.col("release_id").alias("file_id"))])
    rows = quality.record_counts(files, [table(spark, d, "source_record"), table(spark, d, "raw_record")])
    return packages.unionByName(rows.withColumn("file_id", F.col("file_id").cast("string")))


_RULES = (
    ("concept.source_file", "FROM concept WHERE source_file_id IS NOT NULL AND source_file_id NOT IN (SELECT file_id FROM source_file)"),
    ("concept.release", "FROM concept WHERE release_id IS NOT NULL AND release_id NOT IN (SELECT release_id FROM pmgs_release)"),
    ("concept_revision.concept", "FROM concept_revision WHERE concept_id IS NOT NULL AND concept_id NOT IN (SELECT concept_id FROM concept)"),
    ("revision_relation.from", "FROM revision_relation WHERE from_revision_id IS NOT NULL AND from_revision_id NOT IN (SELECT revision_id FROM concept_revision)"),
    ("revision_relation.to", "FROM revision_relation WHERE to_revision_id IS NOT NULL AND to_revision_id NOT IN (SELECT revision_id FROM concept_revision)"),
    ("revision_relation.self", "FROM revision_relation WHERE from_revision_id = to_revision_id"),
    ("source_file.record_count", "FROM source_file LEFT JOIN (SELECT file_id, count(*) AS n FROM (SELECT file_id FROM source_record UNION ALL SELECT file_id FROM raw_record) GROUP BY 1) USING (file_id) WHERE record_count <> coalesce(n, 0)"),
    ("concept.key", "FROM (SELECT 1 FROM concept GROUP BY scheme, edition, normalized_code HAVING count(*) > 1)"),
    ("concept_revision.key", "FROM (SELECT 1 FROM concept_revision GROUP BY concept_id, version_indicator HAVING count(*) > 1)"),
    ("concept_revision.order", "FROM concept_revision WHERE valid_from > valid_to"),
    ("concept_revision.base", "FROM concept WHERE NOT (scheme = 'ipc' AND edition = '8U') AND concept_id NOT IN (SELECT concept_id FROM concept_revision WHERE version_indicator = '')"),
    ("ipc.sequence", "FROM concept_revision JOIN concept USING (concept_id) WHERE sequence_number IS NOT NULL AND scheme = 'ipc'"),
    ("concept.lineage", "FROM concept WHERE source_file_id IS NULL OR trim(coalesce(source_locator, '')) = ''"),
    ("concept_revision.lineage", "FROM concept_revision WHERE source_file_id IS NULL OR trim(coalesce(source_locator, '')) = ''"),
    ("revision_relation.lineage", "FROM revision_relation WHERE source_file_id IS NULL OR trim(coalesce(source_locator, '')) = ''"),
)


@query("store_checks", " UNION ALL ".join(f"SELECT '{name}' AS name, 0::BIGINT AS expected, count(*) AS actual, count(*) = 0 AS match {rows}" for name, rows in _RULES))
def _checks(spark, d):
    names = {"release": "pmgs_release"} | {n: n for n in ("source_file", "source_record", "raw_record", "concept", "concept_revision", "revision_relation")}
    return quality.store_checks({k: table(spark, d, v) for k, v in names.items()})


@query("two_key_join", """
SELECT r.revision_relation_id, c.concept_id FROM revision_relation r JOIN concept c ON c.source_file_id = r.source_file_id AND c.source_locator = r.source_locator""")
def _two(spark, d):
    c = table(spark, d, "concept").select("concept_id", "source_file_id", "source_locator")
    return table(spark, d, "revision_relation").join(c, ["source_file_id", "source_locator"]).select("revision_relation_id", "concept_id")


# -- publication -----------------------------------------------------------
@query("chunk_pack", """
WITH RECURSIVE o AS (SELECT doc_id, group_key, n_chars, row_number() OVER (PARTITION BY group_key ORDER BY doc_id) AS r FROM documents),
f AS (SELECT doc_id, group_key, r, n_chars AS used, CAST(1 AS BIGINT) AS chunk FROM o WHERE r = 1
  UNION ALL SELECT o.doc_id, o.group_key, o.r, CASE WHEN f.used > 0 AND f.used + o.n_chars > 4096 THEN o.n_chars ELSE f.used + o.n_chars END,
    CASE WHEN f.used > 0 AND f.used + o.n_chars > 4096 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN o ON o.group_key = f.group_key AND o.r = f.r + 1)
SELECT doc_id, group_key, chunk FROM f""")
def _pack(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "group_key", "n_chars")
    return publish.pack(rows, "group_key", ["doc_id"], "n_chars", 4096).select("doc_id", "group_key", "chunk")


@query("chunk_nav", SQL["chunk_pack"].replace("SELECT doc_id, group_key, chunk FROM f", """,
c AS (SELECT f.group_key, chunk, min(doc_id) AS first_key, max(doc_id) AS last_key, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM f JOIN documents USING (doc_id) GROUP BY ALL)
SELECT group_key, chunk, first_key, last_key, n, bytes, lag(chunk) OVER (PARTITION BY group_key ORDER BY chunk) AS prev_chunk, lead(chunk) OVER (PARTITION BY group_key ORDER BY chunk) AS next_chunk FROM c"""))
def _nav(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "group_key", "n_chars")
    return publish.directory(publish.pack(rows, "group_key", ["doc_id"], "n_chars", 4096), "group_key", "doc_id", "n_chars")


@query("range_directory_lookup", """
WITH o AS (SELECT o_orderkey, o_orderpriority, (o_orderkey // 1000) AS chunk FROM orders),
c AS (SELECT o_orderpriority, chunk, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM o GROUP BY ALL)
SELECT o.o_orderkey, c.chunk FROM orders o JOIN c ON c.o_orderpriority = o.o_orderpriority AND o.o_orderkey BETWEEN c.lo AND c.hi""")
def _range(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.floor(F.col("o_orderkey") / 1000).cast("long").alias("chunk"), F.lit(1).alias("size"))
    listing = publish.directory(rows, "o_orderpriority", "o_orderkey", "size")
    return publish.find_chunk(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), listing, "o_orderpriority", "o_orderkey").select("o_orderkey", "chunk")


@query("sitemap_shards", """
WITH u AS (SELECT DISTINCT relative_path AS url FROM source_file), n AS (SELECT url, row_number() OVER (ORDER BY url) AS r FROM u)
SELECT (r - 1) // 50 AS shard, count(*) AS n, min(url) AS first_url, max(url) AS last_url FROM n GROUP BY 1""")
def _sitemap(spark, d):
    return publish.sitemap(table(spark, d, "source_file").select(F.col("relative_path").alias("url")), shard=50)


@query("table_digest", """
WITH r AS (SELECT sha256('{"concept_id":' || concept_id || ',"edition":' || coalesce(to_json(edition)::VARCHAR, 'null') || ',"normalized_code":' || coalesce(to_json(normalized_code)::VARCHAR, 'null')
  || ',"record_status":' || coalesce(to_json(record_status)::VARCHAR, 'null') || ',"scheme":' || coalesce(to_json(scheme)::VARCHAR, 'null') || '}') AS r FROM concept),
b AS (SELECT left(r, 4) AS b, sha256(string_agg(r, '' ORDER BY r)) AS h, count(*) AS k FROM r GROUP BY 1)
SELECT upper(sha256(string_agg(h, '' ORDER BY b))) AS digest, CAST(sum(k) AS BIGINT) AS n FROM b""")
def _digest(spark, d):
    return publish.table_digest(table(spark, d, "concept"), ["concept_id", "scheme", "edition", "normalized_code", "record_status"])


@query("manifest_digest", """
SELECT release_id, upper(sha256(string_agg('{"relative_path":' || to_json(relative_path)::VARCHAR || ',"sha256":' || to_json(sha256)::VARCHAR || ',"size_bytes":' || size_bytes || '}', chr(10) ORDER BY relative_path) || chr(10))) AS digest
FROM source_file GROUP BY release_id""")
def _mdigest(spark, d):
    return publish.manifest_digest(table(spark, d, "source_file"))


@query("record_bundle", _BOTH + """
SELECT DISTINCT c.concept_id, r.revision_id, r.version_indicator, k.kind, k.dst FROM concept c JOIN concept_revision r USING (concept_id) LEFT JOIN view k ON k.src = r.revision_id""")
def _bundle(spark, d):
    view = edges.both_ways(table(spark, d, "revision_relation"), "from_revision_id", "to_revision_id").distinct()
    rev = table(spark, d, "concept_revision").select("concept_id", "revision_id", "version_indicator")
    return table(spark, d, "concept").select("concept_id").join(rev, "concept_id").join(view.withColumnRenamed("src", "revision_id"), "revision_id", "left").select(
        "concept_id", "revision_id", "version_indicator", "kind", "dst"
    )


@query("language_projection", """
SELECT release_id, code, loaded_at, l.kind, l.language, l.text FROM (SELECT release_id, code, loaded_at, unnest(labels) AS l FROM storage_record) WHERE l.language = 'en'""")
def _language(spark, d):
    kept = F.filter("labels", lambda x: x["language"] == "en")
    return table(spark, d, "storage_record").select("release_id", "code", "loaded_at", F.explode(kept).alias("l")).select("release_id", "code", "loaded_at", "l.kind", "l.language", "l.text")
