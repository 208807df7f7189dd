"""Records assembled in set form: one plan for any number of concepts.

``t`` is a dict of the store's tables. Every function takes the concepts it is
asked for as a frame, so a single lookup, a batch of keys and the whole table
run the same joins; a filter on the keys reaches the scans. Results are flat
rows, so a concept with very many relations or documents never becomes one
huge value; the driver nests a page of them where one record is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasane.operators import edges, search
from kasane.operators.temporal import active_at, available_versions, pick_revision

Tables = Mapping[str, DataFrame]
LINEAGE = ("source_file_id", "source_locator")


def _of(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")


def heads(t: Tables, concepts: DataFrame, date: str, version: str | None = None) -> DataFrame:
    """(concept columns, revision_id, match_status, version, valid_from, valid_to, level, available_versions).

    With ``version`` the revision of that indicator is taken whatever its dates
    (``version_not_found`` without one), else the one in force at ``date``.
    """
    cols = ["concept_id", "scheme", "edition", "code", "normalized_code", "concept_type", "record_status", *LINEAGE]
    c = concepts.select(*cols)
    revisions = _of(t["concept_revision"], c, "concept_id")
    if version is None:
        picked = pick_revision(revisions, c, date)
    else:
        hit = revisions.where(F.col("version_indicator") == version).groupBy("concept_id").agg(F.min("revision_id").alias("revision_id"))
        picked = c.select("concept_id").join(hit, "concept_id", "left").withColumn("match_status", F.when(F.col("revision_id").isNull(), "version_not_found").otherwise("exact"))
    mine = revisions.select(
        "revision_id", F.nullif("version_indicator", F.lit("")).alias("version"), "valid_from", "valid_to", "level",
        F.col("source_file_id").alias("revision_file_id"),
    )
    return c.join(picked, "concept_id").join(mine, "revision_id", "left").join(available_versions(revisions).withColumnRenamed("versions", "available_versions"), "concept_id", "left")


def texts(t: Tables, heads: DataFrame, language: str | None = None) -> DataFrame:
    """(concept_id, kind, language, sequence_number, text_id, text, lineage) of the chosen revisions."""
    rows = t["concept_text"] if language is None else t["concept_text"].where(F.col("language") == language)
    cols = ["kind", "language", "sequence_number", "text_id", "text", *LINEAGE]
    return rows.select("revision_id", *cols).join(heads.select("concept_id", "revision_id"), "revision_id").select("concept_id", *cols)


def linked_texts(t: Tables, heads: DataFrame, language: str | None = None) -> DataFrame:
    """(concept_id, kind, language, document_id, sequence_number, text, lineage): document segments that stand at the place of the link."""
    docs = t["document"] if language is None else t["document"].where(F.col("language").isin(language, "und"))
    return (
        _links(t, heads).select("concept_id", "document_id", "source_locator").distinct()
        .join(t["document_text"].select("document_id", "source_locator", "sequence_number", "text"), ["document_id", "source_locator"])
        .join(docs.select("document_id", "kind", "language", "source_file_id"), "document_id")
        .select("concept_id", "kind", "language", "document_id", "sequence_number", "text", *LINEAGE)
    )


def properties(t: Tables, heads: DataFrame, language: str | None = None) -> DataFrame:
    """(concept_id, name, property_id, value, language, lineage); properties without a language belong to all."""
    rows = t["concept_property"]
    if language is not None:
        rows = rows.where(F.col("language").isNull() | (F.col("language") == language))
    cols = ["name", "property_id", "value", "language", *LINEAGE]
    return rows.select("revision_id", *cols).join(heads.select("concept_id", "revision_id"), "revision_id").select("concept_id", *cols)


def relations(t: Tables, heads: DataFrame) -> DataFrame:
    """(concept_id, type, scheme, edition, normalized_code, version, code, lineage): concept and revision relations from both ends, each once with its least lineage."""
    ends = t["concept"].select(F.col("concept_id").alias("dst"), "scheme", "edition", "normalized_code", "code")
    plain = edges.both_ways(t["relation"], "from_concept_id", "to_concept_id", lineage=LINEAGE)
    plain = plain.join(heads.select(F.col("concept_id").alias("src")), "src").select(F.col("src").alias("concept_id"), "kind", "dst", F.lit("").alias("version"), *LINEAGE)
    revs = t["concept_revision"].select(F.col("revision_id").alias("dst"), F.col("concept_id").alias("to"), F.col("version_indicator").alias("version"))
    dated = edges.both_ways(t["revision_relation"], "from_revision_id", "to_revision_id", lineage=LINEAGE)
    dated = dated.join(heads.select("concept_id", F.col("revision_id").alias("src")), "src").join(revs, "dst").select("concept_id", "kind", F.col("to").alias("dst"), "version", *LINEAGE)
    seen = plain.unionByName(dated).join(ends, "dst").withColumnRenamed("kind", "type")
    return edges.least_lineage(seen, ["concept_id", "type", "scheme", "edition", "normalized_code", "version", "code"])


RELATION_ORDER = ("type", "scheme", "edition", "normalized_code", "version")


def _links(t: Tables, heads: DataFrame) -> DataFrame:
    own = t["document_link"].select("concept_id", "document_id", "kind", *LINEAGE).join(heads.select("concept_id"), "concept_id")
    dated = t["document_revision_link"].select("revision_id", "document_id", "kind", *LINEAGE).join(heads.select("concept_id", "revision_id"), "revision_id")
    return own.select("concept_id", "document_id", F.col("kind").alias("link_type"), *LINEAGE).unionByName(dated.select("concept_id", "document_id", F.col("kind").alias("link_type"), *LINEAGE))


def documents(t: Tables, heads: DataFrame) -> DataFrame:
    """(concept_id, document_id, link_type, kind, language, title, page_count, lineage) once per document and link type."""
    once = edges.least_lineage(_links(t, heads), ["concept_id", "document_id", "link_type"])
    return once.join(t["document"].select("document_id", "kind", "language", "title", "page_count"), "document_id")


def sources(t: Tables, heads: DataFrame, *parts: DataFrame) -> DataFrame:
    """(concept_id, source_id, relative_path, sha256): every file the parts of a record come from."""
    ids = heads.select("concept_id", "source_file_id").unionByName(heads.select("concept_id", F.col("revision_file_id").alias("source_file_id")))
    for part in parts:
        ids = ids.unionByName(part.select("concept_id", "source_file_id"))
    files = t["source_file"].select(F.col("file_id").alias("source_file_id"), "source_id", "relative_path", "sha256")
    return ids.where("source_file_id is not null").distinct().join(files, "source_file_id").select("concept_id", "source_id", "relative_path", "sha256")


def ambiguous_ends(t: Tables, ends: DataFrame, date: str) -> DataFrame:
    """Concepts of ``ends`` with more than one revision in force."""
    live = _of(t["concept_revision"].where(active_at(date)), ends, "concept_id")
    return live.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def neighbours(t: Tables, concepts: DataFrame, direction: str, date: str, language: str) -> DataFrame:
    """(concept_id, other_id, scheme, edition, code, normalized_code, record_status, version, label): one hop to parents or children."""
    mine, theirs = ("from_concept_id", "to_concept_id") if direction == "parents" else ("to_concept_id", "from_concept_id")
    ends = t["relation"].where(F.lower(F.trim("kind")) == "parent").select(F.col(mine).alias("concept_id"), F.col(theirs).alias("other_id")).join(concepts.select("concept_id"), "concept_id").distinct()
    live = t["concept_revision"].where(active_at(date)).select(F.col("concept_id").alias("other_id"), "revision_id", F.col("version_indicator").alias("version"))
    label = t["concept_text"].where((F.col("kind") == "label") & (F.col("language") == language))
    first = label.groupBy("revision_id").agg(F.min_by("text", F.struct("sequence_number", "text_id")).alias("label"))
    other = t["concept"].select(F.col("concept_id").alias("other_id"), "scheme", "edition", "code", "normalized_code", "record_status")
    return ends.join(other, "other_id").join(live, "other_id", "left").join(first, "revision_id", "left").select(
        "concept_id", "other_id", "scheme", "edition", "code", "normalized_code", "record_status", "version", "label"
    )


HIERARCHY_ORDER = ("scheme", "edition", "normalized_code", "version")


def found_concepts(t: Tables, query: str, schemes: tuple[str, ...], date: str, language: str) -> DataFrame:
    """Canonical concepts with a revision in force whose text matches: the best hit per code and version."""
    rev = t["concept_revision"].where(active_at(date)).select("revision_id", "concept_id", F.col("version_indicator").alias("version"))
    con = t["concept"].where((F.col("record_status") == "canonical") & F.col("scheme").isin(*schemes)).select("concept_id", "scheme", "edition", "code", "normalized_code")
    hits = search.hits(t["concept_text"], "text", query).where(F.col("language") == language).select("revision_id", "rank", "kind", "text_id", "excerpt").join(rev, "revision_id").join(con, "concept_id")
    owner = ["scheme", "edition", "normalized_code", "version"]
    return search.best_per(hits.select(*owner, "code", "rank", "kind", "text_id", "excerpt"), owner, ["rank", "kind", "text_id"])


def found_documents(t: Tables, query: str, release_id: str, language: str) -> DataFrame:
    """Documents of a release in the language (or none) whose text matches: the best segment each."""
    doc = t["document"].where((F.col("release_id") == release_id) & F.col("language").isin(language, "und")).select("document_id", F.col("kind").alias("document_kind"), "title")
    hits = search.hits(t["document_text"], "text", query).select("document_id", "rank", "sequence_number", "document_text_id", "locator", "excerpt").join(doc, "document_id")
    return search.best_per(hits.select("document_id", "document_kind", "title", "rank", "sequence_number", "document_text_id", "locator", "excerpt"), ["document_id"], ["rank", "sequence_number", "document_text_id"])


def related_concepts(t: Tables, documents: DataFrame) -> DataFrame:
    """(document_id, scheme, edition, normalized_code, kind): concepts a document is linked to, itself or through a revision."""
    own = _of(t["document_link"], documents, "document_id").select("document_id", "concept_id", "kind")
    dated = _of(t["document_revision_link"], documents, "document_id").join(t["concept_revision"].select("revision_id", "concept_id"), "revision_id").select("document_id", "concept_id", "kind")
    return own.unionByName(dated).distinct().join(t["concept"].select("concept_id", "scheme", "edition", "normalized_code"), "concept_id").select("document_id", "scheme", "edition", "normalized_code", "kind")


def segments(t: Tables, documents: DataFrame, keep: Column | None = None) -> DataFrame:
    """(document_id, sequence_number, locator, page, heading, text); ``page`` is the number of a ``page:N`` locator."""
    parts = _of(t["document_text"], documents, "document_id")
    page = F.regexp_extract("locator", r"^page:([0-9]+)$", 1).try_cast("bigint")
    return (parts if keep is None else parts.where(keep)).select("document_id", "sequence_number", "locator", page.alias("page"), "heading", "text")
