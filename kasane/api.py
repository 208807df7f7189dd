"""Read-only queries over a table store."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasane.errors import QueryError
from kasane.functions import text as tx
from kasane.operators import records as rec
from kasane.operators import search as se
from kasane.operators.temporal import EDITIONS
from kasane.sources.build import TABLES, resolve

SCHEMES, LANGUAGES = ("fi", "fterm", "ipc"), ("ja", "en")
PAGE, RELATIONS, SEGMENTS = 100, 200, 200
CONTENT = ("classification", "document")
MOST_BYTES = 4 * 1024 * 1024


def _version(version: str | None, scheme: str) -> str | None:
    if version is None:
        return None
    if scheme.strip().lower() != "ipc":
        raise QueryError("INVALID_VERSION", "only ipc has versions")
    v = version.strip()
    v = v[1:-1].strip() if v.startswith("(") and v.endswith(")") else v
    if not re.fullmatch(r"[0-9]{4}\.(0[1-9]|1[0-2])", v):
        raise QueryError("INVALID_VERSION", "a version is YYYY.MM")
    return v


def _bounded(answer: dict) -> dict:
    """The answer, unless its JSON takes more bytes than a response may have."""
    if len(json.dumps(answer, ensure_ascii=False, default=str, separators=(",", ":")).encode()) > MOST_BYTES:
        raise QueryError("RESPONSE_TOO_LARGE", f"more than {MOST_BYTES} bytes")
    return answer


def _one_of(value: str, allowed: tuple[str, ...], code: str) -> str:
    v = (value or "").strip().lower()
    if v not in allowed:
        raise QueryError(code, f"one of {', '.join(allowed)}")
    return v


class Store:
    """Lazy tables and the query methods; results are DataFrames or plain dicts."""

    def __init__(self, spark: SparkSession, path: str | None = None, data_dir: str | None = None):
        self.spark = spark
        base = resolve(path, data_dir)
        missing = [t for t in TABLES if not os.path.isdir(os.path.join(base, f"{t}.parquet"))]
        if missing:
            raise QueryError("INVALID_STORE", f"missing tables: {missing}")
        self.t = {name: spark.read.parquet(os.path.join(base, f"{name}.parquet")) for name in TABLES}

    @classmethod
    def of(cls, spark: SparkSession, tables: dict[str, DataFrame]) -> Store:
        """A store over tables at hand instead of a folder."""
        made = cls.__new__(cls)
        made.spark, made.t = spark, tables
        return made

    # -- resolution -------------------------------------------------------
    def release(self, release: str = "current") -> dict:
        r = self.t["release"]
        row = r.orderBy(F.desc("release_id")).first() if release == "current" else r.where(F.col("release_id") == release).first()
        if row is None:
            raise QueryError("RELEASE_NOT_FOUND", release)
        return row.asDict()

    def release_info(self, release: str = "current") -> dict:
        info = self.release(release)
        kinds = self.t["concept"].groupBy("scheme", "edition").count().orderBy("scheme", "edition").collect()
        docs = self.t["document"].groupBy("kind", "language").count().orderBy("kind", "language").collect()
        return info | {"concepts": [r.asDict() for r in kinds], "documents": [r.asDict() for r in docs], "attribution": self.t["release_source"].first().attribution}

    def _concept(self, release: dict, scheme: str, code: str, edition: str | None) -> tuple[str, str, DataFrame | None]:
        s = _one_of(scheme, SCHEMES, "INVALID_SCHEME")
        n = "".join((code or "").split()).upper()
        if not 1 <= len(n) <= 128:
            raise QueryError("INVALID_CODE", "a code has 1 to 128 characters")
        if s != "ipc" and edition:
            raise QueryError("INVALID_EDITION", "only ipc has editions")
        c = self.t["concept"].where((F.col("release_id") == release["release_id"]) & (F.col("scheme") == s))
        e = ""
        if s == "ipc":
            have = [r.edition for r in c.select("edition").distinct().collect()]
            if edition:
                e = edition.strip().upper()
                if e not in have:
                    raise QueryError("INVALID_EDITION", e)
            else:
                e = next((x for x in EDITIONS if x in have), max(have, default=""))
        row = c.where((F.col("edition") == e) & (F.col("normalized_code") == n))
        return n, e, None if row.isEmpty() else row

    # -- public queries ---------------------------------------------------
    def lookup(self, scheme: str, code: str, release: str = "current", edition: str | None = None, language: str = "ja", *, version: str | None = None, relation_limit: int = 50, relation_offset: int = 0) -> dict:
        """The exact record, or an empty one with the reason."""
        lang = _one_of(language, LANGUAGES, "INVALID_LANGUAGE")
        if not 1 <= relation_limit <= RELATIONS:
            raise QueryError("INVALID_RELATION_LIMIT", f"relation_limit is 1 to {RELATIONS}")
        if relation_offset < 0:
            raise QueryError("INVALID_RELATION_OFFSET", "relation_offset is not negative")
        wanted = _version(version, scheme)
        rel = self.release(release)
        n, e, concept = self._concept(rel, scheme, code, edition)
        record = {
            "schema_version": rel["schema_version"], "release_id": rel["release_id"], "reference_date": rel["reference_date"],
            "scheme": scheme.strip().lower(), "edition": e or None, "code": n, "normalized_code": n, "concept_type": None, "record_status": None, "match_status": "not_found",
            "version": None, "valid_from": None, "valid_to": None, "level": None, "available_versions": [], "labels": [], "texts": [], "properties": [],
            "relation_count": 0, "relation_offset": relation_offset, "relation_limit": relation_limit, "relations_truncated": False, "next_relation_offset": None,
            "relations": [], "documents": [], "sources": [], "canonical_url": None,
        }
        if concept is None:
            return _bounded(record)
        head = rec.heads(self.t, concept, rel["reference_date"], wanted)
        top = head.first().asDict(recursive=True)
        if top["match_status"] == "ambiguous":
            raise QueryError("MULTIPLE_ACTIVE_REVISIONS", n)
        for v in top["available_versions"] or []:
            record["available_versions"].append(v | {"version": v["version"] or None})
        record |= {"concept_type": top["concept_type"], "record_status": top["record_status"], "match_status": top["match_status"] if top["revision_id"] is None or code == n else "normalized_exact"}
        if top["revision_id"] is None:
            return _bounded(record)
        record |= {k: top[k] for k in ("version", "valid_from", "valid_to", "level")}
        texts, linked, props = rec.texts(self.t, head, lang), rec.linked_texts(self.t, head, lang), rec.properties(self.t, head, lang)
        relations, documents = rec.relations(self.t, head), rec.documents(self.t, head)
        files = {r.file_id: r.source_id for r in self.t["source_file"].select("file_id", "source_id").collect()}  # at most 10,000 files a package
        official = lambda row, *keys: {k: row[k] for k in keys} | {"provenance": "official", "source_id": files.get(row["source_file_id"]), "locator": row["source_locator"]}
        for r in texts.orderBy("kind", "sequence_number", "text_id").collect():
            record["labels" if r.kind == "label" else "texts"].append(official(r, "kind", "language", "text"))
        record["texts"] += [official(r, "kind", "language", "text") for r in linked.orderBy("kind", "document_id", "sequence_number").collect()]
        record["properties"] = [official(r, "name", "value", "language") for r in props.orderBy("name", "property_id").collect()]
        total = relations.count()
        page = relations.orderBy(*rec.RELATION_ORDER).offset(relation_offset).limit(relation_limit).collect()
        record["relations"] = [official(r, *rec.RELATION_ORDER, "code") for r in page]
        end = relation_offset + len(page)
        record |= {"relation_count": total, "relations_truncated": len(page) < total, "next_relation_offset": end if end < total else None}
        record["documents"] = [official(r, "document_id", "link_type", "kind", "language", "title", "page_count") for r in documents.orderBy("kind", "document_id", "link_type").collect()]
        shown = self.spark.createDataFrame([(top["concept_id"], r.source_file_id) for r in page], "concept_id long, source_file_id long")
        record["sources"] = [r.asDict() for r in rec.sources(self.t, head, texts, linked, props, documents, shown).drop("concept_id").orderBy("source_id").collect()]
        return _bounded(record)

    def search(self, query: str, schemes: list[str] | None = None, release: str = "current", language: str = "ja", limit: int = 20, *, offset: int = 0) -> dict:
        """Canonical concepts with a revision in force, one hit per code and version."""
        lang = _one_of(language, LANGUAGES, "INVALID_LANGUAGE")
        if schemes is not None and not schemes:
            raise QueryError("INVALID_SCHEME", "at least one scheme is required")
        keep = tuple(_one_of(s, SCHEMES, "INVALID_SCHEME") for s in (schemes or SCHEMES))
        se.check_page(limit, offset, PAGE)
        rel = self.release(release)
        one = rec.found_concepts(self.t, query, keep, rel["reference_date"], lang)
        rows = one.orderBy("rank", "scheme", F.desc("edition"), "normalized_code", "version", "kind", "text_id").offset(offset).limit(limit + 1).collect()
        return self._page(query, rows, limit, offset)

    def search_documents(self, query: str, release: str = "current", language: str = "ja", limit: int = 20, *, offset: int = 0) -> dict:
        lang = _one_of(language, LANGUAGES, "INVALID_LANGUAGE")
        se.check_page(limit, offset, PAGE)
        one = rec.found_documents(self.t, query, self.release(release)["release_id"], lang)
        return self._page(query, one.orderBy("rank", "document_id", "sequence_number").offset(offset).limit(limit + 1).collect(), limit, offset)

    @staticmethod
    def _page(query: str, rows: list, limit: int, offset: int) -> dict:
        more = len(rows) > limit
        return _bounded({"search_mode": se.mode_of(se.clean_query(query)), "hits": [r.asDict() for r in rows[:limit]], "has_more": more, "next_offset": offset + limit if more else None})

    def search_all(self, query: str, schemes: list[str] | None = None, release: str = "current", language: str = "ja", limit: int = 20, *, content_types: list[str] | None = None, classification_offset: int = 0, document_offset: int = 0) -> dict:
        """Classifications and documents (or the wanted ones), each with its own page."""
        wanted = CONTENT if content_types is None else tuple(content_types)
        if not wanted or set(wanted) - set(CONTENT):
            raise QueryError("INVALID_CONTENT_TYPE", f"some of {', '.join(CONTENT)}")
        none = {"search_mode": None, "hits": [], "has_more": False, "next_offset": None}
        a = self.search(query, schemes, release, language, limit, offset=classification_offset) if "classification" in wanted else none
        b = self.search_documents(query, release, language, limit, offset=document_offset) if "document" in wanted else none
        flat = [h | {"content_type": "classification"} for h in a["hits"]] + [h | {"content_type": "document"} for h in b["hits"]]
        modes = {x["search_mode"] for x in (a, b) if x["search_mode"]}
        return _bounded({"search_mode": modes.pop() if len(modes) == 1 else "mixed_lexical", "classifications": a, "documents": b, "hits": flat})

    def hierarchy(self, direction: str, scheme: str, code: str, release: str = "current", edition: str | None = None, language: str = "ja", *, limit: int | None = 50, offset: int = 0) -> dict:
        """One hop to parents or children with the label of each revision in force; the full list where ``limit`` is None."""
        lang = _one_of(language, LANGUAGES, "INVALID_LANGUAGE")
        if direction not in ("parents", "children"):
            raise QueryError("INVALID_HIERARCHY_DIRECTION", "parents or children")
        se.check_page(RELATIONS if limit is None else limit, offset, RELATIONS)
        rel = self.release(release)
        _, _, concept = self._concept(rel, scheme, code, edition)
        if concept is None:
            return {"items": [], "total": 0, "truncated": False, "next_offset": None}
        rows = rec.neighbours(self.t, concept, direction, rel["reference_date"], lang)
        ends = rows.select(F.col("other_id").alias("concept_id"))
        if not rec.ambiguous_ends(self.t, ends, rel["reference_date"]).isEmpty():
            raise QueryError("MULTIPLE_ACTIVE_REVISIONS", direction)
        total = rows.count()
        page = rows.orderBy(*rec.HIERARCHY_ORDER[:3], F.coalesce("version", F.lit(""))).offset(offset)
        page = (page if limit is None else page.limit(limit)).drop("concept_id", "other_id").collect()
        end = offset + len(page)
        return _bounded({"items": [r.asDict() for r in page], "total": total, "truncated": len(page) < total, "next_offset": end if end < total else None})

    def parents(self, scheme: str, code: str, **how) -> list[dict] | dict:
        """All parents; one page with its totals where ``limit`` is given."""
        return self._hop("parents", scheme, code, how)

    def children(self, scheme: str, code: str, **how) -> list[dict] | dict:
        """All children; one page with its totals where ``limit`` is given."""
        return self._hop("children", scheme, code, how)

    def _hop(self, direction: str, scheme: str, code: str, how: dict) -> list[dict] | dict:
        if "limit" in how or "offset" in how:
            return self.hierarchy(direction, scheme, code, **how)
        return self.hierarchy(direction, scheme, code, **how, limit=None)["items"]

    def get_document(self, document_id: str, page: int | None = None, section: str | None = None) -> dict:
        if not re.fullmatch(r"doc-[0-9A-Za-z]{1,64}", document_id or ""):
            raise QueryError("INVALID_DOCUMENT_ID", "not a document identifier")
        if page is not None and section is not None:
            raise QueryError("INVALID_DOCUMENT_SELECTOR", "page and section exclude each other")
        if page is not None and page < 1:
            raise QueryError("INVALID_PAGE", "pages start at 1")
        if section is not None and not section.strip():
            raise QueryError("INVALID_SECTION", "a section is not empty")
        wanted = self.t["document"].where(F.col("document_id") == document_id)
        doc = wanted.first()
        if doc is None:
            raise QueryError("DOCUMENT_NOT_FOUND", document_id)
        keep = F.col("locator") == f"page:{page}" if page is not None else (F.col("locator") == section) | (F.col("heading") == section) if section is not None else None
        parts, links = rec.segments(self.t, wanted, keep).drop("document_id"), rec.related_concepts(self.t, wanted).drop("document_id")
        total, n_links = parts.count(), links.count()
        shown = parts.orderBy("sequence_number").limit(SEGMENTS).collect()
        related = links.orderBy("scheme", "edition", "normalized_code", "kind").limit(RELATIONS).collect()
        return _bounded(doc.asDict() | {"segments": [r.asDict() for r in shown], "segment_count": total, "segments_truncated": len(shown) < total, "related": [r.asDict() for r in related], "related_count": n_links, "related_truncated": n_links > RELATIONS})

    def groups(self) -> DataFrame:
        """Record bundles by publication group: (group_key, scheme, edition, record_json) of canonical concepts."""
        c = self.t["concept"].where("record_status = 'canonical'")
        labels = self.t["concept_text"].groupBy("revision_id").agg(F.sort_array(F.collect_list(F.struct("kind", "language", "sequence_number", "text"))).alias("texts"))
        revs = self.t["concept_revision"].join(labels, "revision_id", "left").groupBy("concept_id").agg(F.sort_array(F.collect_list(F.struct(F.col("version_indicator").alias("version"), "valid_from", "valid_to", "texts"))).alias("revisions"))
        return c.join(revs, "concept_id").select(
            tx.group_key(F.col("scheme"), F.col("normalized_code")).alias("group_key"), "scheme", "edition", "normalized_code",
            F.to_json(F.struct("code", "edition", "normalized_code", "revisions", "scheme"), {"ignoreNullFields": "false"}).alias("record_json"),
        )
