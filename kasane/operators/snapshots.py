"""What changed between full snapshots (content-defined chunks).

Each snapshot is laid out key-sorted inside hash buckets of the key. A key
whose hash falls on the cut mask opens a new chunk, so chunk borders depend
on content only and stay put when neighbours come and go. A chunk whose digest
equals that of the chunk with the same opening key one snapshot earlier holds
no change and is thrown away whole; only the rows of the other chunks are
joined by key and classified.

One shuffle: dedup, chunking, digest comparison and the final join all work on
the bucket's partition. The row content crosses it as one 64-bit digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kasane.functions.text import date_key, end_key, norm_code, version_text
from kasane.runtime import shuffle_width


def set_digest(array: Column, fields: Sequence[str]) -> Column:
    """Digest of an array of structs read as a set; null fields equal ''; null array equals []."""
    members = F.transform(array, lambda m: F.xxhash64(*(F.coalesce(m[f], F.lit("")) for f in fields)))
    return F.coalesce(F.xxhash64(F.sort_array(F.array_distinct(members))), F.xxhash64(F.array().cast("array<bigint>")))


def release_order(rows: DataFrame, release_col: str) -> DataFrame:
    """(release, __ord) by name order. One row per delivery, so it is small whatever the row count."""
    spark = rows.sparkSession
    names = sorted(r[0] for r in rows.select(release_col).where(F.col(release_col).isNotNull()).distinct().collect())
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{release_col}` string, __ord int"), len(names)


def snapshot_changes(
    rows: DataFrame,
    release_col: str,
    keys: Sequence[str],
    digest_col: str,
    latest_col: str,
    mean_chunk: int = 64,
    buckets: int | None = None,
) -> DataFrame:
    """Rows (release, *keys, change) with change in added / removed / changed.

    ``rows`` holds one or more rows per release and key; the one with the
    greatest ``latest_col`` counts (null is oldest, equal ones must agree).
    ``digest_col`` is a bigint over the compared content. Null keys are keys of
    their own. Rows with a null release belong to no snapshot and are ignored.
    The first snapshot yields nothing; an empty table yields an empty result.
    Extra columns are ignored.
    """
    if mean_chunk < 1:
        raise ValueError("mean_chunk must be positive")
    order, n_rel = release_order(rows, release_col)
    buckets = buckets or max(64, 8 * shuffle_width(rows.sparkSession))
    key_hash = F.xxhash64(*keys)
    kept = (
        rows.join(F.broadcast(order), release_col)
        .select(
            "__ord",
            *keys,
            F.col(digest_col).alias("__d"),
            F.coalesce(F.col(latest_col).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp")).alias("__at"),
            F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(buckets)).cast("int").alias("__b"),
        )
        .repartition("__b")
        .groupBy("__b", "__ord", *keys)
        .agg(F.max_by("__d", "__at").alias("__d"))
        .withColumn("__h", key_hash)
    )
    run = Window.partitionBy("__b", "__ord").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.pmod(F.col("__h"), F.lit(mean_chunk)) == 0, F.col("__h")), ignorenulls=True)
    chunks = (
        kept.withColumn("__start", opened.over(run))
        .groupBy("__b", "__ord", "__start")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.bit_xor(F.xxhash64("__h", "__d")).alias("__x"),
            F.bit_xor(F.xxhash64("__d", "__h", F.lit(1))).alias("__y"),
            F.collect_list(F.struct(*keys, "__d")).alias("__rows"),
        )
    )
    across = Window.partitionBy("__b", "__start").orderBy("__ord")
    sign = F.struct("__n", "__x", "__y")
    before, after = F.lag(F.struct("__ord", sign.alias("s"))), F.lead(F.struct("__ord", sign.alias("s")))
    open_chunks = (
        chunks.withColumn("__p", before.over(across))
        .withColumn("__q", after.over(across))
        .withColumn(
            "__pairs",
            F.array_compact(
                F.array(
                    F.when(
                        (F.col("__ord") > 0)
                        & ~F.coalesce((F.col("__p.__ord") == F.col("__ord") - 1) & (F.col("__p.s") == sign), F.lit(False)),
                        F.struct(F.col("__ord").alias("pair"), F.lit(True).alias("now")),
                    ),
                    F.when(
                        (F.col("__ord") < n_rel - 1)
                        & ~F.coalesce((F.col("__q.__ord") == F.col("__ord") + 1) & (F.col("__q.s") == sign), F.lit(False)),
                        F.struct((F.col("__ord") + 1).alias("pair"), F.lit(False).alias("now")),
                    ),
                )
            ),
        )
        .where(F.size("__pairs") > 0)
    )
    sides = open_chunks.select("__b", F.explode("__pairs").alias("__p"), "__rows").select(
        "__b", F.col("__p.pair").alias("__ord"), F.col("__p.now").alias("__now"), F.explode("__rows").alias("__r")
    )
    joined = (
        sides.select("__b", "__ord", "__now", "__r.*")
        .groupBy("__b", "__ord", *keys)
        .agg(F.max(F.when(F.col("__now"), F.col("__d"))).alias("__new"), F.max(F.when(~F.col("__now"), F.col("__d"))).alias("__old"))
    )
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("__new").isNull(), "removed")
        .when(F.col("__old") != F.col("__new"), "changed")
    )
    return (
        joined.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .join(F.broadcast(order), "__ord")
        .select(release_col, *keys, "change")
    )


def record_rows(records: DataFrame) -> DataFrame:
    """storage_record in comparable form: key, content digest, load time.

    Codes lose all white space and case, edition null is '', versions lose
    parentheses, dates become calendar dates, an open end has one spelling.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.select(
        "release_id",
        text("scheme").alias("scheme"),
        text("edition").alias("edition"),
        F.coalesce(norm_code(F.col("normalized_code")), F.lit("")).alias("normalized_code"),
        F.xxhash64(
            text("record_status"),
            version_text(F.col("version")),
            date_key(F.col("valid_from")),
            end_key(F.col("valid_to")),
            set_digest(F.col("labels"), ("kind", "language", "text")),
            set_digest(F.col("relations"), ("type", "scheme", "code", "edition")),
        ).alias("content"),
        "loaded_at",
    )


def record_changes(records: DataFrame, **how: int) -> DataFrame:
    """(release_id, scheme, edition, normalized_code, change) over storage_record."""
    return snapshot_changes(
        record_rows(records), "release_id", ("scheme", "edition", "normalized_code"), "content", "loaded_at", **how
    )


def release_summary(records: DataFrame, releases: DataFrame) -> DataFrame:
    """Per release: counts of changes, and whether its manifest digest is the predecessor's.

    A repeated digest does not skip the comparison: packages that declare the
    same manifest need not hold the same rows.
    """
    counts = (
        record_changes(records)
        .groupBy("release_id")
        .agg(*(F.count(F.when(F.col("change") == c, 1)).alias(f"n_{c}") for c in ("added", "removed", "changed")))
    )
    w = Window.orderBy("release_id")  # one row per delivery
    named = releases.select(
        "release_id",
        F.coalesce(F.col("source_manifest_sha256") == F.lag("source_manifest_sha256").over(w), F.lit(False)).alias("same_manifest"),
    )
    zero = [F.coalesce(F.col(f"n_{c}"), F.lit(0)).alias(f"n_{c}") for c in ("added", "removed", "changed")]
    return named.join(counts, "release_id", "left").select("release_id", "same_manifest", *zero)
