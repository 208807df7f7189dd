"""Editions, revisions and validity at a date."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Editions from the newest to the oldest (fixed values).
EDITIONS = ("8U", "8B", "7", "7E", "6", "5", "4")


def active_at(date: str | Column, valid_from: Column | None = None, valid_to: Column | None = None) -> Column:
    """Closed interval with null as an open end; dates are ISO text or DATE on both sides."""
    d = F.lit(date) if isinstance(date, str) else date
    lo, hi = (F.col("valid_from") if valid_from is None else valid_from), (F.col("valid_to") if valid_to is None else valid_to)
    return (lo.isNull() | (lo <= d)) & (hi.isNull() | (hi >= d))


def edition_rank(edition: Column, order: Sequence[str] = EDITIONS) -> Column:
    """Place in the priority list, unknown editions after it."""
    at = F.array_position(F.array(*map(F.lit, order)), edition)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(len(order) + 1))


def latest_edition(concepts: DataFrame, keys: Sequence[str] = ("normalized_code",)) -> DataFrame:
    """Per key the row of the edition first in priority (ties: edition, concept_id)."""
    cols = [c for c in concepts.columns if c not in keys]
    rank = F.struct(edition_rank(F.col("edition")).alias("r"), F.col("edition").alias("e"), F.col("concept_id").alias("i"))
    best = concepts.groupBy(*keys).agg(F.min_by(F.struct(*cols), rank).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in cols))


def ambiguous(revisions: DataFrame, date: str) -> DataFrame:
    """(concept_id, n_active) of concepts with more than one revision in force."""
    return revisions.where(active_at(date)).groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_active")).where("n_active > 1")


def dormant(revisions: DataFrame, date: str) -> DataFrame:
    """(concept_id, n) of concepts with several revisions of which none is in force."""
    per = revisions.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(active_at(date), 1)).alias("live"))
    return per.where("n > 1 and live = 0").drop("live")


def pick_revision(revisions: DataFrame, concepts: DataFrame, date: str) -> DataFrame:
    """(concept_id, revision_id, match_status) for every concept.

    The unique revision in force; without one, the only revision of a concept
    outside ipc counts as exact. More than one in force: ``ambiguous``. None:
    ``not_valid_at_release``. Concepts without revisions: ``not_found``.
    """
    per = revisions.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(active_at(date), 1)).alias("n_active"),
        F.min(F.when(active_at(date), F.col("revision_id"))).alias("active"),
        F.min("revision_id").alias("only"),
    )
    lone = (F.col("n_active") == 0) & (F.col("n") == 1) & (F.col("scheme") != "ipc")
    status = (
        F.when(F.col("n").isNull(), "not_found")
        .when(F.col("n_active") > 1, "ambiguous")
        .when((F.col("n_active") == 1) | lone, "exact")
        .otherwise("not_valid_at_release")
    )
    chosen = F.when(F.col("n_active") == 1, F.col("active")).when(lone, F.col("only"))
    return concepts.select("concept_id", "scheme").join(per, "concept_id", "left").select(
        "concept_id", chosen.alias("revision_id"), status.alias("match_status")
    )


def available_versions(revisions: DataFrame) -> DataFrame:
    """(concept_id, versions): version, valid_from, valid_to in order of version, valid_from, revision_id."""
    item = F.struct("version_indicator", F.coalesce("valid_from", F.lit("")).alias("valid_from"), "revision_id", "valid_to")
    return revisions.groupBy("concept_id").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda s: F.struct(s["version_indicator"].alias("version"), F.nullif(s["valid_from"], F.lit("")).alias("valid_from"), s["valid_to"].alias("valid_to"))).alias("versions")
    )


def island_ids(rows: DataFrame, part: Sequence[str], order: Sequence[str], value: str, name: str = "island") -> DataFrame:
    """Numbers the runs of equal consecutive values (null equals null) within a part, from 1."""
    w = Window.partitionBy(*part).orderBy(*order)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return rows.withColumn("__f", fresh).withColumn(name, F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__f")


def stack_parent(rows: DataFrame, part: Sequence[str], order: Sequence[str], level: str, ident: str) -> DataFrame:
    """Adds ``parent``: the nearest earlier row of the part with a smaller level.

    Any level counts, negative ones too. Rows with a null level get none and are
    nobody's parent. The rule depends on all rows before, so a part is folded in
    order in one streaming pass over sorted rows; memory holds the open levels
    only, whatever the part's size.
    """
    kind = rows.schema[ident].dataType
    schema = StructType([*rows.schema.fields, StructField("parent", kind)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = object(), []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in part)))
            out = []
            for key, depth, name in zip(keys, batch.column(level).to_pylist(), batch.column(ident).to_pylist()):
                if key != at:
                    at, stack = key, []
                if depth is None:
                    out.append(None)
                    continue
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                out.append(stack[-1][1] if stack else None)
                stack.append((depth, name))
            column = pa.array(out, batch.schema.field(ident).type)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "parent"])

    return rows.repartition(*part).sortWithinPartitions(*part, *order).mapInArrow(fold, schema)


def first_writer(rows: DataFrame, keys: Sequence[str], order: Sequence[str], canonical: Column | None = None) -> DataFrame:
    """One row per key: the first in order; canonical rows go before others when given."""
    cols = [c for c in rows.columns if c not in keys]
    rank = [F.when(canonical, 0).otherwise(1).alias("__c")] if canonical is not None else []
    won = rows.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*rank, *order)).alias("__w"))
    return won.select(*keys, *(F.col(f"__w.{c}").alias(c) for c in cols))


def conflicts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Rows after the first of their key that differ from it in a compared column."""
    head = first_writer(rows, keys, order).select(*keys, F.struct(*compared).alias("__first"))
    return rows.join(head, list(keys)).where(~F.struct(*compared).eqNullSafe(F.col("__first"))).drop("__first")
