"""Data quality rules as rows (name, expected, actual, match)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasane.operators.temporal import ambiguous


def check(name: str, expected: int | Column, actual: DataFrame, value: str) -> DataFrame:
    """One check row from a one-row frame."""
    e = F.lit(expected) if isinstance(expected, int) else expected
    return actual.select(F.lit(name).alias("name"), e.cast("long").alias("expected"), F.col(value).cast("long").alias("actual")).withColumn(
        "match", F.col("expected") == F.col("actual")
    )


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key no parent has."""
    ids = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(ids, key, "left_anti")


def record_counts(files: DataFrame, records: Iterable[DataFrame]) -> DataFrame:
    """(file_id, declared, actual) of files whose declared row count is wrong."""
    actual = None
    for r in records:
        one = r.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
        actual = one if actual is None else actual.unionByName(one)
    total = actual.groupBy("file_id").agg(F.sum("n").alias("actual"))
    return (
        files.select("file_id", F.col("record_count").alias("declared"))
        .join(total, "file_id", "left")
        .withColumn("actual", F.coalesce("actual", F.lit(0)))
        .where("declared <> actual")
    )


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in only one of two tables, with their side."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def parity(a: DataFrame, b: DataFrame, key: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """(key, issue) with issue missing, extra or differs, null equal to null."""
    left = a.select(*key, F.struct(*compared).alias("__a"))
    right = b.select(*key, F.struct(*compared).alias("__b"))
    issue = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return left.join(right, list(key), "full").select(*key, issue.alias("issue")).where("issue is not null")


def store_checks(t: dict[str, DataFrame]) -> DataFrame:
    """The rule table over release, source_file, source_record, concept, concept_revision and revision_relation."""
    n = F.count(F.lit(1)).alias("n")
    rows = [
        check("concept.source_file", 0, orphans(t["concept"], "source_file_id", t["source_file"], "file_id").agg(n), "n"),
        check("concept.release", 0, orphans(t["concept"], "release_id", t["release"], "release_id").agg(n), "n"),
        check("concept_revision.concept", 0, orphans(t["concept_revision"], "concept_id", t["concept"], "concept_id").agg(n), "n"),
        check("revision_relation.from", 0, orphans(t["revision_relation"], "from_revision_id", t["concept_revision"], "revision_id").agg(n), "n"),
        check("revision_relation.to", 0, orphans(t["revision_relation"], "to_revision_id", t["concept_revision"], "revision_id").agg(n), "n"),
        check("revision_relation.self", 0, t["revision_relation"].where("from_revision_id = to_revision_id").agg(n), "n"),
        check("source_file.record_count", 0, record_counts(t["source_file"], [t["source_record"], *([t["raw_record"]] if "raw_record" in t else [])]).agg(n), "n"),
        check("concept.key", 0, t["concept"].groupBy("scheme", "edition", "normalized_code").agg(n).where("n > 1").agg(n), "n"),
        check("concept_revision.key", 0, t["concept_revision"].groupBy("concept_id", "version_indicator").agg(n).where("n > 1").agg(n), "n"),
        check("concept_revision.order", 0, t["concept_revision"].where("valid_from > valid_to").agg(n), "n"),
        check(
            "concept_revision.base", 0,
            t["concept"].where("not (scheme = 'ipc' and edition = '8U')")
            .join(t["concept_revision"].where("version_indicator = ''").select("concept_id"), "concept_id", "left_anti").agg(n), "n",
        ),
        check("ipc.sequence", 0, t["concept_revision"].where("sequence_number is not null").join(t["concept"].where("scheme = 'ipc'").select("concept_id"), "concept_id", "left_semi").agg(n), "n"),
    ]
    for name in ("concept", "concept_revision", "revision_relation"):
        rows.append(check(f"{name}.lineage", 0, t[name].where("source_file_id is null or trim(coalesce(source_locator, '')) = ''").agg(n), "n"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def amendment_coverage(t: dict[str, DataFrame]) -> DataFrame:
    """Rules that every amendment of the sources is a relation and a document link, and none is made up: rows in only one of the two, per kind.

    Table amendments name two (code, version) ends per row; element amendments
    name two codes. Rows whose ends are unknown are build issues, not relations.
    """
    files = t["source_file"].select("file_id", "data_group")
    rev = t["concept_revision"].select("revision_id", "concept_id").join(t["concept"].select("concept_id"), "concept_id")
    rows = t["source_record"].join(files, "file_id")
    lost = t["build_issue"].select(F.col("source_file_id").alias("file_id"), F.col("source_locator").alias("locator")).distinct()
    table_rows = rows.where("data_group = 'IPC_KAISEI' and record_kind = 'html-table-row'").select("file_id", F.concat(F.lit("table-row:"), F.col("record_number").cast("string")).alias("locator")).join(lost, ["file_id", "locator"], "left_anti")
    made = t["revision_relation"].where("kind = 'amended_to'").select(F.col("source_file_id").alias("file_id"), F.col("source_locator").alias("locator"))
    links = t["document_revision_link"].join(rev, "revision_id").select(F.col("source_file_id").alias("file_id"), F.col("source_locator").alias("locator"))
    elements = rows.where("data_group = 'FI/FI_KAISEI_DOC' and record_kind = 'xml-element'").select(
        "file_id", F.concat(F.lit("element:infor["), F.col("record_number").cast("string"), F.lit("]")).alias("locator"),
        F.get_json_object("payload_json", "$.code").alias("code"), F.get_json_object("payload_json", "$.translated").alias("to"),
    )
    moved = elements.where("trim(code) <> '' and trim(to) <> ''").select("file_id", "locator")
    group = files.where("data_group = 'FI/FI_KAISEI_DOC'").select("file_id")
    relations = t["relation"].where("kind = 'amended_to'").select(F.col("source_file_id").alias("file_id"), F.col("source_locator").alias("locator")).join(group, "file_id", "left_semi")
    named = elements.where("trim(code) <> ''").select("file_id").distinct()
    linked = t["document_link"].where("kind = 'fi_amendment'").select(F.col("source_file_id").alias("file_id")).distinct()
    pairs = {"amendment.table.relation": (table_rows, made), "amendment.table.link": (table_rows, links), "amendment.element.relation": (moved, relations), "amendment.element.link": (named, linked)}
    out = None
    for name, (want, have) in pairs.items():
        one = check(name, 0, symmetric_difference(want, have).agg(F.count(F.lit(1)).alias("n")), "n")
        out = one if out is None else out.unionByName(one)
    return out


LINEAGE_TABLES = ("release_source", "concept", "concept_revision", "concept_text", "concept_property", "relation", "revision_relation", "document_link", "document_revision_link", "reference_entry")


def package_checks(t: dict[str, DataFrame], date: str, required: Sequence[str], golden: dict[str, int] | None = None) -> DataFrame:
    """Rules over a whole store: required tables, lineage of every table, one revision in force at most, amendments, row counts a caller expects."""
    n = F.count(F.lit(1)).alias("n")
    spark = t["concept"].sparkSession
    missing = [name for name in required if name not in t]
    rows = [check("tables.required", 0, spark.createDataFrame([(len(missing),)], "n long"), "n")]
    for name in LINEAGE_TABLES:
        if name in t:
            rows.append(check(f"{name}.lineage", 0, t[name].where("source_file_id is null or trim(coalesce(source_locator, '')) = ''").agg(n), "n"))
    rows.append(check("concept_revision.active", 0, ambiguous(t["concept_revision"], date).agg(n), "n"))
    for name, count in (golden or {}).items():
        rows.append(check(f"{name}.rows", count, t[name].agg(n), "n"))
    out = amendment_coverage(t)
    for r in rows:
        out = out.unionByName(r)
    return out


def inventory_summary(files: DataFrame) -> DataFrame:
    """(dimension, value, n) by status, file type and data group: one pass over grouping sets."""
    g = files.select(F.col("status").alias("a"), F.col("file_type").alias("b"), F.upper(F.trim("data_group")).alias("c"))
    counted = g.groupingSets([["a"], ["b"], ["c"]], "a", "b", "c").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "file_type").otherwise("data_group")
    return counted.select(dim.alias("dimension"), F.coalesce("a", "b", "c").alias("value"), "n")
