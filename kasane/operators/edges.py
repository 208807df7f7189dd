"""Relations between revisions: views, duplicates, one hop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kasane.functions.text import strip_white

#: Kind seen from the other end (fixed values).
INVERSE = {"parent": "child", "child": "parent", "amended_to": "amended_from"}


def both_ways(links: DataFrame, src: str, dst: str, kind: str = "kind", lineage: Sequence[str] = ()) -> DataFrame:
    """(src, dst, kind, lineage): every link and its view from the other end; unknown kinds keep their name."""
    k = F.lower(strip_white(F.col(kind)))
    other: Column = k
    for a, b in INVERSE.items():
        other = F.when(k == a, b).otherwise(other)
    out = links.select(F.col(src).alias("src"), F.col(dst).alias("dst"), k.alias("kind"), *lineage)
    back = links.select(F.col(dst).alias("src"), F.col(src).alias("dst"), other.alias("kind"), *lineage)
    return out.unionByName(back)


def least_lineage(rows: DataFrame, keys: Sequence[str], lineage: Sequence[str] = ("source_file_id", "source_locator")) -> DataFrame:
    """One row per key with its smallest lineage (locators in text order)."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*lineage)).alias("__l")).select(*keys, "__l.*")


def one_hop(links: DataFrame, nodes: DataFrame, node_id: str, direction: str) -> DataFrame:
    """(src, kind, other node columns) for parents or children, links counted once."""
    kind = {"parents": "parent", "children": "child"}[direction]
    view = both_ways(links, "from_revision_id", "to_revision_id").where(F.col("kind") == kind).distinct()
    return view.join(nodes.withColumnRenamed(node_id, "dst"), "dst")


def page(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit in a total order (top-k, no full sort)."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_totals(rows: DataFrame, part: Sequence[str], order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """Per part one page with total, truncated and next_offset columns."""
    w = Window.partitionBy(*part)
    n = F.row_number().over(w.orderBy(*order))
    total = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("total"))
    some = rows.withColumn("__n", n).where((F.col("__n") > offset) & (F.col("__n") <= offset + limit))
    more = F.col("total") > offset + limit
    return some.join(total, list(part)).select(
        *rows.columns, "total", (F.least(F.col("total") - offset, F.lit(limit)) < F.col("total")).alias("truncated"),
        F.when(more, F.lit(offset + limit)).alias("next_offset"),
    )
