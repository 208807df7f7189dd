"""Queries of the record operators (the API's own) over store tables made from the test data, with their SQL.

Relations of concepts are the cleaned parent and child links, those of
revisions the amendments; texts are the labels of all deliveries; documents
are linked to the main group of their group key.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kasane.functions import text as tx
from kasane.operators import edges, records
from kasane.plans.core import _SPACE
from kasane.plans.reference import AS_OF
from kasane.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn

    return keep


def tables(spark, d) -> dict:
    load = lambda name: table(spark, d, name)
    concept, revision, links, docs = load("concept"), load("concept_revision"), load("revision_relation"), load("documents")
    kind = F.lower(tx.strip_white(F.col("kind")))
    end = lambda side: revision.select(F.col("revision_id").alias(f"{side}_revision_id"), F.col("concept_id").alias(f"{side}_concept_id"))
    tree = links.withColumn("kind", kind).where("kind in ('parent', 'child')").join(end("from"), "from_revision_id").join(end("to"), "to_revision_id")
    up, down = F.col("from_concept_id"), F.col("to_concept_id")
    swap = F.col("kind") == "child"
    relation = tree.select(F.when(swap, down).otherwise(up).alias("from_concept_id"), F.when(swap, up).otherwise(down).alias("to_concept_id"), F.lit("parent").alias("kind"), "source_file_id", "source_locator")
    owner = concept.join(revision.drop("source_file_id", "source_locator"), "concept_id").select("revision_id", "scheme", "edition", "normalized_code", "version_indicator", "source_file_id", "source_locator")
    label = (
        load("storage_record")
        .select("scheme", F.coalesce("edition", F.lit("")).alias("edition"), tx.norm_code(F.col("normalized_code")).alias("normalized_code"), tx.version_text(F.col("version")).alias("version_indicator"), F.explode("labels").alias("l"))
        .select("scheme", "edition", "normalized_code", "version_indicator", "l.*").distinct()
        .join(owner, ["scheme", "edition", "normalized_code", "version_indicator"])
    )
    order = Window.partitionBy("revision_id", "language", "kind").orderBy("text")
    text = label.withColumn("sequence_number", F.row_number().over(order).cast("long")).withColumn("text_id", F.col("sequence_number"))
    main = concept.where("scheme = 'fi'").select(F.col("normalized_code").alias("main"), "concept_id", "source_file_id", "source_locator")
    document_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    document = docs.select(document_id.alias("document_id"), "kind", F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("language"), F.col("group_key").alias("title"), "release_id", F.lit(None).cast("long").alias("page_count"), F.lit(1).cast("long").alias("source_file_id"))
    return {
        "release": load("pmgs_release"), "source_file": load("source_file"), "concept": concept, "concept_revision": revision, "relation": relation,
        "revision_relation": links.withColumn("kind", kind).where("kind = 'amended_to'"), "concept_text": text,
        "concept_property": revision.where("level is not null").select("revision_id", F.lit("level").alias("name"), F.col("revision_id").alias("property_id"), F.col("level").cast("string").alias("value"), F.lit(None).cast("string").alias("language"), "source_file_id", "source_locator"),
        "document": document,
        "document_text": docs.select(document_id.alias("document_id"), F.col("doc_id").alias("document_text_id"), F.lit(1).cast("long").alias("sequence_number"), F.lit("page:1").alias("locator"), F.lit(None).cast("string").alias("heading"), "text", F.lit("page:1").alias("source_locator")),
        "document_link": docs.select(document_id.alias("document_id"), F.concat("group_key", F.lit("/00")).alias("main"), "kind").join(main, "main").select("document_id", "concept_id", "kind", "source_file_id", "source_locator"),
        "document_revision_link": spark.createDataFrame([], "document_id string, revision_id long, kind string, source_file_id long, source_locator string"),
    }


def _heads(t):
    return records.heads(t, t["concept"], AS_OF)


_LIVE = f"(valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}')"
_T = rf"""
WITH clean AS (SELECT *, lower(trim(kind)) AS k FROM revision_relation),
rel AS (SELECT CASE k WHEN 'child' THEN b.concept_id ELSE a.concept_id END AS f, CASE k WHEN 'child' THEN a.concept_id ELSE b.concept_id END AS t, c.source_file_id, c.source_locator
  FROM clean c JOIN concept_revision a ON a.revision_id = c.from_revision_id JOIN concept_revision b ON b.revision_id = c.to_revision_id WHERE k IN ('parent', 'child')),
stat AS (SELECT concept_id, count(*) AS n, count(*) FILTER ({_LIVE}) AS live, min(revision_id) FILTER ({_LIVE}) AS one, min(revision_id) AS sole FROM concept_revision GROUP BY 1),
head AS (SELECT c.*, CASE WHEN n IS NULL THEN 'not_found' WHEN live > 1 THEN 'ambiguous' WHEN live = 1 OR (live = 0 AND n = 1 AND scheme <> 'ipc') THEN 'exact' ELSE 'not_valid_at_release' END AS match_status,
  CASE WHEN live = 1 THEN one WHEN live = 0 AND n = 1 AND scheme <> 'ipc' THEN sole END AS revision_id FROM concept c LEFT JOIN stat USING (concept_id)),
lab AS (SELECT DISTINCT scheme, coalesce(edition, '') AS edition, upper(regexp_replace(normalized_code, '{_SPACE}', '', 'g')) AS normalized_code, regexp_replace(coalesce(version, ''), '[()（）\s]', '', 'g') AS version_indicator,
  unnest(labels).kind AS kind, unnest(labels).language AS language, unnest(labels).text AS text FROM storage_record),
txt AS (SELECT r.revision_id, l.kind, l.language, l.text, c.source_file_id, c.source_locator, c.scheme, c.edition, c.code, c.normalized_code, c.record_status, r.version_indicator, r.valid_from, r.valid_to, c.concept_id,
  row_number() OVER (PARTITION BY r.revision_id, l.language, l.kind ORDER BY l.text) AS sequence_number
  FROM lab l JOIN concept c USING (scheme, edition, normalized_code) JOIN concept_revision r ON r.concept_id = c.concept_id AND r.version_indicator = l.version_indicator),
docl AS (SELECT 'doc-' || doc_id AS document_id, c.concept_id, d.kind, c.source_file_id, c.source_locator FROM documents d JOIN concept c ON c.scheme = 'fi' AND c.normalized_code = d.group_key || '/00')
"""


@query("lookup_heads", _T + """
, v AS (SELECT concept_id, string_agg(version_indicator || '|' || coalesce(valid_from, '') || '|' || coalesce(valid_to, ''), ';' ORDER BY version_indicator, coalesce(valid_from, ''), revision_id) AS versions FROM concept_revision GROUP BY 1)
SELECT h.concept_id, h.scheme, h.edition, h.normalized_code, h.record_status, h.match_status, h.revision_id, nullif(r.version_indicator, '') AS version, r.valid_from, r.valid_to, r.level, v.versions
FROM head h LEFT JOIN concept_revision r USING (revision_id) LEFT JOIN v ON v.concept_id = h.concept_id""")
def _lookup(spark, d):
    said = F.transform("available_versions", lambda v: F.concat_ws("|", v["version"], F.coalesce(v["valid_from"], F.lit("")), F.coalesce(v["valid_to"], F.lit(""))))
    return _heads(tables(spark, d)).select(
        "concept_id", "scheme", "edition", "normalized_code", "record_status", "match_status", "revision_id", "version", "valid_from", "valid_to", "level", F.array_join(said, ";").alias("versions")
    )


@query("lookup_texts", _T + "SELECT h.concept_id, t.kind, t.language, t.sequence_number, t.text FROM head h JOIN txt t USING (revision_id) WHERE t.language = 'ja'")
def _texts(spark, d):
    t = tables(spark, d)
    return records.texts(t, _heads(t), "ja").select("concept_id", "kind", "language", "sequence_number", "text")


@query("lookup_properties", _T + "SELECT h.concept_id, 'level' AS name, CAST(r.level AS VARCHAR) AS value FROM head h JOIN concept_revision r USING (revision_id) WHERE r.level IS NOT NULL")
def _properties(spark, d):
    t = tables(spark, d)
    return records.properties(t, _heads(t), "ja").select("concept_id", "name", "value")


_REL = _T + """
, ends AS (SELECT f AS src, 'parent' AS type, t AS dst, '' AS version, source_file_id, source_locator FROM rel UNION ALL SELECT t, 'child', f, '', source_file_id, source_locator FROM rel
  UNION ALL SELECT h.concept_id, 'amended_to', b.concept_id, b.version_indicator, c.source_file_id, c.source_locator FROM clean c JOIN head h ON h.revision_id = c.from_revision_id JOIN concept_revision b ON b.revision_id = c.to_revision_id WHERE k = 'amended_to'
  UNION ALL SELECT h.concept_id, 'amended_from', b.concept_id, b.version_indicator, c.source_file_id, c.source_locator FROM clean c JOIN head h ON h.revision_id = c.to_revision_id JOIN concept_revision b ON b.revision_id = c.from_revision_id WHERE k = 'amended_to'),
seen AS (SELECT src AS concept_id, type, e.scheme, e.edition, e.normalized_code, version, b.source_file_id, b.source_locator FROM ends b JOIN concept e ON e.concept_id = b.dst
  QUALIFY row_number() OVER (PARTITION BY src, type, e.scheme, e.edition, e.normalized_code, version ORDER BY b.source_file_id, b.source_locator) = 1)
"""


@query("lookup_relations", _REL + "SELECT * FROM seen")
def _relations(spark, d):
    t = tables(spark, d)
    return records.relations(t, _heads(t)).drop("code")


@query("lookup_relation_page", _REL + """SELECT concept_id, type, scheme, edition, normalized_code, version, total, total > 5 AS truncated, CASE WHEN total > 5 THEN 5 END AS next_offset
FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY type, scheme, edition, normalized_code, version) AS n, count(*) OVER (PARTITION BY concept_id) AS total FROM seen) WHERE n <= 5""")
def _relation_page(spark, d):
    t = tables(spark, d)
    rows = records.relations(t, _heads(t)).select("concept_id", *records.RELATION_ORDER)
    return edges.with_totals(rows, ["concept_id"], list(records.RELATION_ORDER), 5)


@query("lookup_documents", _T + """
SELECT l.concept_id, l.document_id, l.kind AS link_type, coalesce(lower(trim(lang)), 'und') AS language, d.group_key AS title, min(l.source_file_id) AS source_file_id
FROM docl l JOIN documents d ON l.document_id = 'doc-' || d.doc_id GROUP BY ALL""")
def _documents(spark, d):
    t = tables(spark, d)
    return records.documents(t, _heads(t)).select("concept_id", "document_id", "link_type", "language", "title", "source_file_id")


@query("lookup_sources", _T + """
SELECT DISTINCT concept_id, source_id, sha256 FROM (SELECT concept_id, source_file_id AS file_id FROM head UNION SELECT h.concept_id, r.source_file_id FROM head h JOIN concept_revision r USING (revision_id)
  UNION SELECT h.concept_id, t.source_file_id FROM head h JOIN txt t USING (revision_id)) JOIN source_file USING (file_id)""")
def _sources(spark, d):
    t = tables(spark, d)
    heads = _heads(t)
    return records.sources(t, heads, records.texts(t, heads)).select("concept_id", "source_id", "sha256")


def _neighbours(direction: str, mine: str, theirs: str):
    sql = _T + f"""
, live AS (SELECT concept_id, revision_id, version_indicator AS version FROM concept_revision WHERE {_LIVE}),
first AS (SELECT revision_id, text AS label FROM txt WHERE kind = 'label' AND language = 'ja' AND sequence_number = 1)
SELECT DISTINCT r.{mine} AS concept_id, o.concept_id AS other_id, o.normalized_code, o.record_status, l.version, x.label
FROM rel r JOIN concept o ON o.concept_id = r.{theirs} LEFT JOIN live l ON l.concept_id = o.concept_id LEFT JOIN first x ON x.revision_id = l.revision_id"""

    @query(f"lookup_{direction}", sql)
    def run(spark, d):
        t = tables(spark, d)
        return records.neighbours(t, t["concept"], direction, AS_OF, "ja").select("concept_id", "other_id", "normalized_code", "record_status", "version", "label")


_neighbours("parents", "f", "t")
_neighbours("children", "t", "f")


@query("ambiguous_neighbours", _T + f"""
SELECT concept_id, count(*) AS n FROM concept_revision WHERE {_LIVE} AND concept_id IN (SELECT f FROM rel UNION SELECT t FROM rel) GROUP BY 1 HAVING count(*) > 1""")
def _ambiguous(spark, d):
    t = tables(spark, d)
    ends = t["relation"].select(F.explode(F.array("from_concept_id", "to_concept_id")).alias("concept_id"))
    return records.ambiguous_ends(t, ends, AS_OF)


@query("search_records", _T + f"""
, st AS (SELECT count(*) AS n, avg(greatest(length(text) - 2, 0)) AS d, count(*) FILTER (contains(lower(text), 'touch')) AS a FROM txt),
hit AS (SELECT scheme, edition, normalized_code, version_indicator AS version, code, kind, sequence_number,
  round(-(CASE WHEN ln((n - a + 0.5) / (a + 0.5)) > 0 THEN ln((n - a + 0.5) / (a + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * greatest(length(text) - 2, 0) / d))), 6) AS rank
  FROM (SELECT *, (length(text) - length(replace(lower(text), 'touch', ''))) / 5.0 AS f FROM txt WHERE contains(lower(text), 'touch') AND language = 'en' AND record_status = 'canonical' AND {_LIVE}), st)
SELECT scheme, edition, normalized_code, version, rank FROM hit QUALIFY row_number() OVER (PARTITION BY scheme, edition, normalized_code, version ORDER BY rank, kind, sequence_number) = 1""")
def _search(spark, d):
    return records.found_concepts(tables(spark, d), "touch", ("fi", "fterm", "ipc"), AS_OF, "en").select("scheme", "edition", "normalized_code", "version", F.round("rank", 6).alias("rank"))


@query("search_document_records", """
SELECT 'doc-' || doc_id AS document_id, kind AS document_kind, group_key AS title FROM documents
WHERE release_id = (SELECT max(release_id) FROM pmgs_release) AND coalesce(lower(trim(lang)), 'und') IN ('en', 'und') AND contains(lower(text), 'sensor') AND contains(lower(text), 'array')""")
def _search_documents(spark, d):
    t = tables(spark, d)
    newest = t["release"].agg(F.max("release_id")).first()[0]
    return records.found_documents(t, "sensor array", newest, "en").select("document_id", "document_kind", "title")


@query("document_segments", "SELECT 'doc-' || doc_id AS document_id, 1 AS sequence_number, 'page:1' AS locator, 1 AS page, text FROM documents WHERE kind = (SELECT min(kind) FROM documents)")
def _segments(spark, d):
    t = tables(spark, d)
    kind = t["document"].agg(F.min("kind")).first()[0]
    return records.segments(t, t["document"].where(F.col("kind") == kind)).select("document_id", F.col("sequence_number").cast("int"), "locator", F.col("page").cast("int"), "text")


@query("document_concepts", _T + "SELECT DISTINCT document_id, scheme, edition, normalized_code, l.kind FROM docl l JOIN concept USING (concept_id)")
def _document_concepts(spark, d):
    t = tables(spark, d)
    return records.related_concepts(t, t["document"])
