"""Package to table store: upserts, identities, gates, exclusive promotion."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kasane.operators import publish
from kasane.operators.temporal import conflicts, first_writer, latest_edition
from kasane.runtime import Scratch
from kasane.sources import adapters, package

KEY = ["scheme", "edition", "normalized_code"]
ORDER = list(adapters.ORDER)
TABLES = (
    "release", "source_file", "source_record", "release_source", "concept", "concept_revision", "concept_text", "concept_property", "relation",
    "revision_relation", "document", "document_text", "document_link", "document_revision_link", "reference_entry", "build_issue",
)


class BuildError(RuntimeError):
    """The package cannot become a store."""


def _ids(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    return publish.global_index(rows, order, name)


class Build:
    """All sixteen tables of one package as DataFrames."""

    def __init__(self, spark: SparkSession, root: str, release_id: str):
        self.spark, self.root = spark, root
        self.scratch = Scratch(spark, "build")
        self.files = self.scratch.save(package.inventory(spark, root, release_id))
        package.check_limits(self.files)
        if not self.files.where("status = 'failed'").isEmpty():
            raise BuildError("a source file failed")
        self.date = package.reference_date(self.files)
        self.release_id = release_id
        csv_rows = self.scratch.save(package.csv_rows(spark, root, self.files))
        xml = self.scratch.save(package.xml_rows(spark, root, self.files))
        html = self.scratch.save(package.html_rows(spark, root, self.files))
        out = adapters.Emissions(self.files)
        for stage in adapters.CSV_STAGES:
            stage(out, csv_rows)
        adapters.amendments(out, xml)
        adapters.html_tables(out, html)
        adapters.definitions(out, self.files, package.pdf_pages(spark, root, self.files))
        adapters.unhandled(out, self.files)
        self.tables = self._tables(out, csv_rows, xml, html)

    def _tables(self, out: adapters.Emissions, csv_rows: DataFrame, xml: DataFrame, html: DataFrame) -> dict[str, DataFrame]:
        save, union = self.scratch.save, adapters.union
        emitted = save(union(out.concepts))
        # identity by first emission; content by the first canonical one
        seen = emitted.groupBy(*KEY).agg(F.min(F.struct(*ORDER)).alias("__first"))
        content = first_writer(emitted.select(*KEY, "code", "concept_type", "record_status", "locator", *ORDER), KEY, ORDER, F.col("record_status") == "canonical")
        concept = content.join(seen, KEY).select(*KEY, "code", "concept_type", "record_status", F.col("file_id").alias("source_file_id"), F.col("locator").alias("source_locator"), "__first.*")
        concept = save(_ids(concept, "concept_id", ORDER).drop(*ORDER).withColumn("release_id", F.lit(self.release_id)))
        known = concept.select(*KEY, "concept_id", "record_status")
        # a versioned edition has a base revision only for concepts nothing but references know
        rkey = [*KEY, "version"]
        revs = emitted.where("not (edition = '8U' and record_status = 'canonical' and version = '')")
        canon = emitted.where("record_status = 'canonical'").select(*KEY).distinct()
        revs = revs.where("record_status = 'canonical'").unionByName(
            revs.where("record_status <> 'canonical'").join(canon.where("edition = '8U'"), KEY, "left_anti")
        )
        attrs = ["valid_from", "valid_to", "level", "sequence_number"]
        slim = revs.select(*rkey, *attrs, "record_status", "locator", *ORDER)
        first = first_writer(slim, rkey, ORDER, F.col("record_status") == "canonical")
        clash = conflicts(slim.where("record_status = 'canonical'"), rkey, ORDER, attrs)
        issues = [clash.select(F.lit("error").alias("severity"), F.lit("REVISION_CONFLICT").alias("code"), F.lit("a later row differs from the revision").alias("message"), "file_id", "locator")]
        revision = save(
            _ids(first.join(known.drop("record_status"), KEY), "revision_id", ORDER).select(
                "revision_id", "concept_id", F.col("version").alias("version_indicator"), F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"),
                "level", "sequence_number", F.col("file_id").alias("source_file_id"), F.col("locator").alias("source_locator"),
            )
        )
        of = known.drop("record_status").join(revision.select("concept_id", "revision_id", F.col("version_indicator").alias("version")), "concept_id")

        def attach(rows: DataFrame, code: str) -> DataFrame:
            hit = rows.join(of, rkey, "left")
            issues.append(hit.where("revision_id is null").select(F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit("no such concept").alias("message"), "file_id", "locator"))
            return hit.where("revision_id is not null").withColumnRenamed("file_id", "source_file_id").withColumnRenamed("locator", "source_locator")

        line = ["stage", "source_file_id", "record_number"]
        text = _ids(attach(union(out.texts), "TEXT_CONCEPT_MISSING"), "text_id", [*line, "kind", "language"]).select(
            "text_id", "revision_id", "language", "kind", "sequence_number", "text", F.lit("original").alias("translation_status"), "source_file_id", "source_locator"
        )
        prop = _ids(attach(union(out.properties), "PROPERTY_CONCEPT_MISSING"), "property_id", [*line, "name"]).select("property_id", "revision_id", "name", "value", "language", "source_file_id", "source_locator")
        side = lambda p: known.select(F.col("scheme").alias(f"{p}_scheme"), F.col("edition").alias(f"{p}_edition"), F.col("normalized_code").alias(f"{p}_code"), F.col("concept_id").alias(f"{p}_concept_id"))
        rel = union(out.relations).join(side("from"), ["from_scheme", "from_edition", "from_code"], "left").join(side("to"), ["to_scheme", "to_edition", "to_code"], "left")
        lost = F.col("from_concept_id").isNull() | F.col("to_concept_id").isNull()
        issues.append(rel.where(lost).select(F.lit("warning").alias("severity"), F.lit("RELATION_UNRESOLVED").alias("code"), F.lit("an end of the relation is unknown").alias("message"), "file_id", "locator"))
        made = rel.where(~lost).select("from_concept_id", "to_concept_id", "kind", "file_id", "locator", "stage", "record_number")
        once = first_writer(made, ["from_concept_id", "to_concept_id", "kind"], ["stage", "file_id", "record_number"])
        w = Window.partitionBy("from_concept_id", "kind").orderBy("stage", "file_id", "record_number", "to_concept_id")
        ranked = once.withColumn("__r", F.row_number().over(w))
        extra = (F.col("kind") == "parent") & (F.col("__r") > 1)
        issues.append(ranked.where(extra).select(F.lit("error").alias("severity"), F.lit("HIERARCHY_PARENT_CONFLICT").alias("code"), F.lit("a concept has a second parent").alias("message"), "file_id", "locator"))
        relation = _ids(ranked.where(~extra), "relation_id", ["stage", "file_id", "record_number", "kind", "to_concept_id"]).select("relation_id", "from_concept_id", "to_concept_id", "kind", F.col("file_id").alias("source_file_id"), F.col("locator").alias("source_locator"))
        vers = of.where("scheme = 'ipc' and version <> ''").select("normalized_code", "version", "revision_id")
        end = lambda p: vers.select(F.col("normalized_code").alias(f"{p}_code"), F.col("version").alias(f"{p}_version"), F.col("revision_id").alias(f"{p}_revision_id"))
        rr = union(out.revision_relations).join(end("from"), ["from_code", "from_version"], "left").join(end("to"), ["to_code", "to_version"], "left")
        open_end = F.col("from_revision_id").isNull() | F.col("to_revision_id").isNull()
        own = F.col("from_revision_id") == F.col("to_revision_id")
        say = lambda rows, code, msg: issues.append(rows.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), F.lit(msg).alias("message"), "file_id", "locator"))
        say(rr.where(open_end), "IPC_AMENDMENT_ENDPOINT_UNRESOLVED", "an end of the amendment is unknown")
        say(rr.where(~open_end & own), "REVISION_RELATION_SELF", "a revision cannot follow itself")
        rr = first_writer(rr.where(~open_end & ~own).select("from_revision_id", "to_revision_id", "kind", "file_id", "record_number", "locator"), ["from_revision_id", "to_revision_id", "kind"], ["file_id", "record_number"])
        revision_relation = _ids(rr, "revision_relation_id", ["file_id", "record_number"]).select("revision_relation_id", "from_revision_id", "to_revision_id", "kind", F.col("file_id").alias("source_file_id"), F.col("locator").alias("source_locator"))
        named = self.files.select("file_id", F.concat(F.lit("doc-"), F.substring("source_id", 5, 24)).alias("document_id"), "relative_path")
        document = union(out.documents).join(named, "file_id").select("document_id", F.lit(self.release_id).alias("release_id"), "kind", "language", F.coalesce(F.nullif("title", F.lit("")), "relative_path").alias("title"), F.lit(None).cast("long").alias("page_count"), F.col("file_id").alias("source_file_id"), F.lit("{}").alias("metadata_json"))
        doc = named.drop("relative_path")
        segment = _ids(union(out.segments).join(doc, "file_id"), "document_text_id", ["file_id", "sequence_number"]).select("document_text_id", "document_id", "sequence_number", "locator", "heading", "text", F.col("locator").alias("source_locator"))
        newest = latest_edition(known.where("scheme = 'ipc'"), ["scheme", "normalized_code"]).select(*KEY).withColumnRenamed("edition", "newest")
        stated = union(out.links).join(doc, "file_id").join(newest, ["scheme", "normalized_code"], "left")
        link = stated.withColumn("edition", F.when(F.col("edition") == "*", F.col("newest")).otherwise(F.col("edition"))).drop("newest").join(known, KEY, "left")
        issues.append(link.where("concept_id is null").select(F.lit("warning").alias("severity"), F.lit("DOCUMENT_CONCEPT_MISSING").alias("code"), F.lit("linked concept is unknown").alias("message"), "file_id", "locator"))
        document_link = link.where("concept_id is not null").groupBy("document_id", "concept_id", "kind").agg(F.min(F.struct(F.col("file_id").alias("source_file_id"), F.col("locator").alias("source_locator"))).alias("l")).select("document_id", "concept_id", "kind", "l.*")
        amend = document.where("kind = 'ipc_amendment'").select("document_id", F.col("source_file_id"))
        both = revision_relation.select(F.explode(F.array("from_revision_id", "to_revision_id")).alias("revision_id"), "source_file_id", "source_locator")
        document_revision_link = both.join(amend, "source_file_id").select("document_id", "revision_id", F.lit("ipc_amendment").alias("kind"), "source_file_id", "source_locator").distinct()
        entry = _ids(union(out.entries), "reference_entry_id", ["file_id", "locator", "key"]).select("reference_entry_id", "category", "key", "language", "value", F.col("file_id").alias("source_file_id"), F.col("locator").alias("source_locator"))
        record = (
            csv_rows.select("file_id", "record_number", F.lit("csv-row").alias("record_kind"), F.to_json("cells").alias("payload_json"))
            .unionByName(xml.select("file_id", "record_number", F.lit("xml-element").alias("record_kind"), publish.canonical_json(code=F.col("code"), translated=F.col("translated"), xml=F.col("xml")).alias("payload_json")))
            .unionByName(html.select("file_id", "record_number", F.col("kind").alias("record_kind"), F.to_json("cells").alias("payload_json")))
        )
        record = save(record)
        counts = record.groupBy("file_id").agg(F.count(F.lit(1)).alias("record_count"))
        source_file = self.files.join(counts, "file_id", "left").withColumn("record_count", F.coalesce("record_count", F.lit(0)))
        digest = publish.manifest_digest(self.files)
        release = self.files.groupBy("release_id").agg(F.count(F.lit(1)).alias("source_file_count"), F.sum("size_bytes").alias("source_total_bytes")).join(digest, "release_id").select(
            "release_id", F.lit("2.0").alias("schema_version"), F.lit(self.date).alias("reference_date"), F.col("digest").alias("source_manifest_sha256"), "source_file_count", "source_total_bytes"
        )
        notice = self.files.where("upper(relative_path) = 'COPYRGHT' or upper(relative_path) like '%/COPYRGHT'").select(
            "release_id", F.lit(package.attribution(self.spark, self.root)).alias("attribution"), F.col("file_id").alias("source_file_id"), F.lit("file").alias("source_locator")
        )
        issue = _ids(union([*out.issues, *issues]).select("severity", "code", "message", F.col("file_id").alias("source_file_id"), F.col("locator").alias("source_locator")), "issue_id", ["source_file_id", "source_locator", "code"])
        return {
            "release": release, "source_file": source_file, "source_record": record, "release_source": notice, "concept": concept, "concept_revision": revision,
            "concept_text": text, "concept_property": prop, "relation": relation, "revision_relation": revision_relation, "document": document, "document_text": segment,
            "document_link": document_link, "document_revision_link": document_revision_link, "reference_entry": entry, "build_issue": issue,
        }

    def write(self, out: str, allow_issues: bool = False) -> str:
        """Writes every table beside the target and moves the whole into place; an existing target is never replaced."""
        if os.path.exists(out):
            raise FileExistsError(out)
        part = f"{out}.{uuid.uuid4().hex}.part"
        try:
            for name in TABLES:
                self.tables[name].write.parquet(f"{part}/{name}.parquet")
            bad = self.spark.read.parquet(f"{part}/build_issue.parquet").where("severity = 'error'")
            if not allow_issues and not bad.isEmpty():
                raise BuildError(f"errors in the package: {[r.code for r in bad.select('code').distinct().limit(20).collect()]}")
            again = publish.manifest_digest(package.inventory(self.spark, self.root, self.release_id)).first().digest
            if again != self.spark.read.parquet(f"{part}/release.parquet").first().source_manifest_sha256:
                raise BuildError("the package changed while it was read")
            os.rename(part, out) if not os.path.exists(out) else (_ for _ in ()).throw(FileExistsError(out))
        finally:
            shutil.rmtree(part, ignore_errors=True)
        return out


def build_store(spark: SparkSession, root: str, release_id: str, out: str, allow_issues: bool = False) -> str:
    return Build(spark, root, release_id).write(out, allow_issues)


def activate(data_dir: str, store: str) -> None:
    """Points ``current.json`` of a data directory at a store inside it."""
    rel = os.path.relpath(os.path.realpath(store), os.path.realpath(data_dir))
    if rel.startswith(".."):
        raise ValueError("the store must lie inside the data directory")
    package.write_json(os.path.join(data_dir, "current.json"), {"schema_version": "2.0", "store": rel})


def resolve(path: str | None = None, data_dir: str | None = None) -> str:
    """Explicit path, else the pointer of data_dir (or KASANE_DATA_DIR); the two exclude each other."""
    import json

    if path and data_dir:
        raise ValueError("give a path or a data directory, not both")
    if path:
        return path
    base = data_dir or os.environ.get("KASANE_DATA_DIR")
    if not base:
        raise ValueError("no store given")
    with open(os.path.join(base, "current.json"), encoding="utf-8") as f:
        store = os.path.realpath(os.path.join(base, json.load(f)["store"]))
    if os.path.commonpath([store, os.path.realpath(base)]) != os.path.realpath(base):
        raise ValueError("the pointer leaves the data directory")
    return store
