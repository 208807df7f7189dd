"""History of changing attributes as checkpoints and patches.

``delta_log`` keeps, per entity, a full version every ``every`` changes (and
after each absence), a patch with only the changed attributes for the changes
between, and a ``gone`` mark where the entity is missing. ``fold`` rebuilds
the validity periods: the state after an entry is, per attribute, the last
value written since the nearest full version, so a fold never looks further
back than ``every`` entries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kasane.functions.text import date_key, end_key, norm_code, version_text
from kasane.operators.snapshots import release_order


def delta_log(
    rows: DataFrame,
    release_col: str,
    keys: Sequence[str],
    attrs: Sequence[str],
    latest_col: str,
    every: int = 8,
) -> tuple[DataFrame, DataFrame, int]:
    """(log, release order, number of releases).

    Log columns: keys, ``__ord`` (release position), ``__kind`` full / patch /
    gone, and one patch column per attribute (null: unchanged). Attributes must
    be non-null text. Of several rows per release and key the latest counts
    (null ``latest_col`` is oldest; ties must agree, else the greatest wins).
    Rows with a null release are ignored.
    """
    if every < 1:
        raise ValueError("every must be positive")
    order, n_rel = release_order(rows, release_col)
    at = F.coalesce(F.col(latest_col).cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    seen = (
        rows.join(F.broadcast(order), release_col)
        .select("__ord", *keys, *attrs, at.alias("__at"))
        .repartition(*keys)
    )
    newest = Window.partitionBy(*keys, "__ord").orderBy(F.desc("__at"), *(F.desc(a) for a in attrs))
    by_key = Window.partitionBy(*keys).orderBy("__ord")
    one = seen.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn", "__at")
    prev = one.withColumn("__po", F.lag("__ord").over(by_key)).withColumn("__no", F.lead("__ord").over(by_key))
    for a in attrs:
        prev = prev.withColumn(f"__p_{a}", F.lag(a).over(by_key))
    fresh = F.col("__po").isNull() | (F.col("__po") != F.col("__ord") - 1)
    differs = [F.col(a) != F.col(f"__p_{a}") for a in attrs]
    anydiff = differs[0]
    for d in differs[1:]:
        anydiff = anydiff | d
    marked = (
        prev.withColumn("__fresh", fresh)
        .withColumn("__change", F.col("__fresh") | anydiff)
        .withColumn("__gone", (F.col("__ord") < n_rel - 1) & (F.col("__no").isNull() | (F.col("__no") > F.col("__ord") + 1)))
        .where("__change or __gone")
    )
    # position since the last fresh start decides where the full versions stand
    start = F.last(F.when(F.col("__fresh"), F.col("__ord")), ignorenulls=True)
    numbered = marked.withColumn("__s", start.over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    by_run = Window.partitionBy(*keys, "__s").orderBy("__ord").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("__i", F.count(F.when(F.col("__change"), 1)).over(by_run) - 1)
    full = F.pmod(F.col("__i"), F.lit(every)) == 0
    patch = [F.when(full | d, F.col(a)).alias(a) for a, d in zip(attrs, differs)]
    entry = F.when(
        F.col("__change"), F.struct(F.col("__ord").alias("__ord"), F.when(full, "full").otherwise("patch").alias("__kind"), *patch)
    )
    gone = F.when(
        F.col("__gone"),
        F.struct((F.col("__ord") + 1).alias("__ord"), F.lit("gone").alias("__kind"), *(F.lit(None).cast("string").alias(a) for a in attrs)),
    )
    log = numbered.select(*keys, F.explode(F.array_compact(F.array(entry, gone))).alias("__e")).select(*keys, "__e.*")
    return log, order, n_rel


def fold(log: DataFrame, keys: Sequence[str], attrs: Sequence[str], n_rel: int) -> DataFrame:
    """Periods (keys, attrs, __ord, __last) from a delta log."""
    by_key = Window.partitionBy(*keys).orderBy("__ord")
    cp = F.count(F.when(F.col("__kind") == "full", 1)).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
    out = log.withColumn("__cp", cp).withColumn("__next", F.lead("__ord").over(by_key))
    since = Window.partitionBy(*keys, "__cp").orderBy("__ord").rowsBetween(Window.unboundedPreceding, 0)
    for a in attrs:
        out = out.withColumn(a, F.last(a, ignorenulls=True).over(since))
    return (
        out.withColumn("__last", F.coalesce(F.col("__next") - 1, F.lit(n_rel - 1)))
        .where(F.col("__kind") != "gone")
        .select(*keys, *attrs, "__ord", "__last")
    )


def validity_periods(
    rows: DataFrame,
    release_col: str,
    keys: Sequence[str],
    attrs: Sequence[str],
    latest_col: str,
    min_periods: int = 1,
    every: int = 8,
) -> DataFrame:
    """One row per longest run of consecutive releases with the same attributes.

    Columns: keys, attrs, first_release_id, last_release_id. An absence ends a
    period even when the same state returns. ``min_periods`` keeps entities
    with at least that many periods. An empty table gives an empty result.
    """
    log, order, n_rel = delta_log(rows, release_col, keys, attrs, latest_col, every)
    out = fold(log, keys, attrs, n_rel)
    if min_periods > 1:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        out = out.withColumn("__k", n).where(F.col("__k") >= min_periods)
    first = order.select(F.col("__ord"), F.col(release_col).alias("first_release_id"))
    last = order.select(F.col("__ord").alias("__last"), F.col(release_col).alias("last_release_id"))
    return (
        out.join(F.broadcast(first), "__ord")
        .join(F.broadcast(last), "__last")
        .select(*keys, *attrs, "first_release_id", "last_release_id")
    )


_KEYS = ("scheme", "edition", "normalized_code")
_ATTRS = ("version", "valid_from", "valid_to")


def record_states(records: DataFrame) -> DataFrame:
    """storage_record with comparable keys, version and validity."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.select(
        "release_id",
        text("scheme").alias("scheme"),
        text("edition").alias("edition"),
        F.coalesce(norm_code(F.col("normalized_code")), F.lit("")).alias("normalized_code"),
        version_text(F.col("version")).alias("version"),
        date_key(F.col("valid_from")).alias("valid_from"),
        end_key(F.col("valid_to")).alias("valid_to"),
        "loaded_at",
    )


def record_history(records: DataFrame, min_periods: int = 1) -> DataFrame:
    """Validity periods of storage_record with all three attributes."""
    return validity_periods(record_states(records), "release_id", _KEYS, _ATTRS, "loaded_at", min_periods)


def record_log(records: DataFrame, every: int = 8) -> DataFrame:
    """The stored form: one row per full version, patch or absence."""
    log, order, _ = delta_log(record_states(records), "release_id", _KEYS, _ATTRS, "loaded_at", every)
    return log.join(F.broadcast(order), "__ord").select(
        *_KEYS, "release_id", F.col("__kind").alias("entry"), *(F.col(a).alias(f"set_{a}") for a in _ATTRS)
    )


def state_at(records: DataFrame, release_id: str) -> DataFrame:
    """The states in force at one release, rebuilt from the history."""
    return record_history(records).where(
        (F.col("first_release_id") <= release_id) & (F.col("last_release_id") >= release_id)
    ).select(*_KEYS, *_ATTRS)
