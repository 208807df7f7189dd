"""Grouping, byte-bounded chunks, directories, digests and leak checks for publication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kasane.functions.text import group_key, html_escape
from kasane.operators.temporal import edition_rank
from kasane.runtime import Scratch, shuffle_width

#: Local paths and secrets that must not be published (fixed values).
LOCAL_PATH = r"(?i)(?:\b[a-z]:[\\/]|\\\\[a-z0-9._-]+\\|[\\/](?:home|users|root|tmp|mnt)[\\/])"
SECRET = r"(?i)(?:api[_-]?key|secret|passw(?:or)?d|access[_-]?token)\s*[:=]\s*[^\s,;]+"


def canonical_json(**cols: Column) -> Column:
    """Compact JSON with sorted keys, nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(cols.items()))), {"ignoreNullFields": "false"})


def group_index(concepts: DataFrame) -> DataFrame:
    """(kind, edition, group_key, n_concepts, first_id): the edition's own group, and the current one for the newest ipc edition."""
    base = concepts.groupBy("scheme", "edition", group_key(F.col("scheme"), F.col("normalized_code")).alias("group_key")).agg(
        F.count(F.lit(1)).alias("n_concepts"), F.min("concept_id").alias("first_id")
    )
    newest = base.where("scheme = 'ipc'").groupBy("scheme").agg(F.min(edition_rank(F.col("edition"))).alias("__new"))
    ranked = base.join(newest, "scheme", "left")
    own = F.struct(F.col("scheme").alias("kind"), F.col("edition").alias("edition"))
    current = F.when((F.col("scheme") == "ipc") & (edition_rank(F.col("edition")) == F.col("__new")), F.struct(F.lit("ipc-current").alias("kind"), F.lit("").alias("edition")))
    return ranked.select(F.explode(F.array_compact(F.array(own, current))).alias("g"), "group_key", "n_concepts", "first_id").select("g.*", "group_key", "n_concepts", "first_id")


def pack(rows: DataFrame, group: str, order: Sequence[str], size: str, limit: int) -> DataFrame:
    """Adds ``chunk`` (from 1): a row opens a new chunk when it would take a non-empty one over ``limit``.

    Greedy packing depends on the row before, so a group is folded in order; the
    fold streams over sorted rows and holds one counter, whatever the group's
    size. Null sizes count 0; a row larger than the limit has a chunk alone.
    """
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",chunk:bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used, chunk = object(), 0, 0
        for pdf in batches:
            out = []
            for g, n in zip(pdf[group].tolist(), pdf[size].fillna(0).astype("int64").tolist()):
                g = None if pd.isna(g) else g
                if g != at:
                    at, used, chunk = g, n, 1
                elif used and used + n > limit:
                    used, chunk = n, chunk + 1
                else:
                    used += n
                out.append(chunk)
            yield pdf.assign(chunk=out)

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInPandas(fold, schema)


def directory(packed: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """(group, chunk, first_key, last_key, n, bytes, prev_chunk, next_chunk)."""
    d = packed.groupBy(group, "chunk").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    w = Window.partitionBy(group).orderBy("chunk")
    return d.withColumn("prev_chunk", F.lag("chunk").over(w)).withColumn("next_chunk", F.lead("chunk").over(w))


def _ends(ranges: DataFrame, *keep: str) -> DataFrame:
    """Two rows per range, ``__at`` and ``__kind``: its start (0) and its end (2), so that a key (1) at either lies between."""
    both = [F.struct(F.col(c).alias("__at"), F.lit(kind).alias("__kind")) for c, kind in (("first_key", 0), ("last_key", 2))]
    return ranges.select(*keep, F.explode(F.array(*both)).alias("__end")).select(*keep, "__end.*")


def _spans(listing: DataFrame, group: str) -> DataFrame:
    """The ranges with the blocks of cells whose keys they hold. Cell n of a group lies between its n-th end and the next."""
    ranges = listing.select(group, "chunk", "first_key", "last_key").where(F.col(group).isNotNull() & (F.col("first_key") <= F.col("last_key")))
    w = Window.partitionBy(group)
    numbered = ranges.withColumn("__i", F.row_number().over(w.orderBy("first_key")))
    ends = _ends(numbered, group, "chunk", "first_key", "last_key", "__i").withColumn("__n", F.row_number().over(w.orderBy("__at", "__kind")).cast("long"))
    cells = ends.groupBy(group, "__i").agg(*(F.first(c).alias(c) for c in ("chunk", "first_key", "last_key")), F.min("__n").alias("__from"), F.max("__n").alias("__to"))
    return cells.select(group, "chunk", "first_key", "last_key", _blocks().alias("__blocks"))


def _blocks() -> Column:
    """The fewest blocks (``__level``, ``__block``) of 2^level cells that make up the cells from ``__from`` to before ``__to``: two per level at most, one for a range that overlaps no other."""
    shift = lambda x, h: F.call_function("shiftright", x, h)
    size = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h)
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("__to") - F.col("__from"))) - 1)
    bounds = F.transform(levels, lambda h: F.struct(h.alias("h"), shift(F.col("__from") + size(h) - 1, h).alias("a"), shift(F.col("__to"), h).alias("b")))
    block = lambda x, odd, at: F.when(odd % 2 == 1, F.struct(x["h"].alias("__level"), at.alias("__block")))
    return F.array_compact(F.flatten(F.transform(F.filter(bounds, lambda x: x["a"] < x["b"]), lambda x: F.array(block(x, x["a"], x["a"]), block(x, x["b"], x["b"] - 1)))))


def find_chunk(keys: DataFrame, listing: DataFrame, group: str, key: str) -> DataFrame:
    """Joins keys to every chunk whose range holds them, inside one group.

    No key meets a range that does not hold it: the ends of a group's ranges, in
    order, divide it into cells, sorting keys among the ends gives each its cell,
    and ranges are joined by equality on blocks of cells. So the work grows with
    keys, ranges and rows returned (times the logarithm of the ranges where they
    overlap). A group's keys are sorted in several parts, each with a copy of the
    ends; the copies stay below a quarter of the keys.
    """
    spark = keys.sparkSession
    spans = Scratch(spark, "lookup").save(_spans(listing, group))
    parts = max(1, min(2 * shuffle_width(spark), keys.count() // (8 * max(1, spans.count()))))
    levels = [r[0] for r in spans.select(F.explode("__blocks.__level")).distinct().collect()] or [0]
    hashed = [c for c, kind in keys.dtypes if "map" not in kind and "variant" not in kind]
    part = F.pmod(F.xxhash64(*hashed), F.lit(parts)).cast("int")
    asked = keys.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select("*", F.col(key).alias("__at"), F.lit(1).alias("__kind"), part.alias("__part"))
    ends = _ends(spans, group).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    w = Window.partitionBy(group, "__part").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = asked.unionByName(ends, allowMissingColumns=True).withColumn("__cell", F.count(F.when(F.col("__kind") != 1, 1)).over(w)).where("__kind = 1")
    probes = [F.struct(F.lit(h).alias("__level"), F.call_function("shiftright", F.col("__cell"), F.lit(h)).alias("__block")) for h in levels]
    probed = cells.select(*keys.columns, F.explode(F.array(*probes)).alias("__p")).select(*keys.columns, "__p.*")
    blocks = spans.select(group, "chunk", "first_key", "last_key", F.explode("__blocks").alias("__p")).select(group, "chunk", "first_key", "last_key", "__p.*")
    return probed.join(blocks, [group, "__level", "__block"]).drop("__level", "__block")


def global_index(rows: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """Dense global row number from 1 without a one-task window: range partitions, then offsets per partition."""
    scratch = Scratch(rows.sparkSession, "index")
    parts = scratch.save(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__k"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = sizes.select("__p", F.coalesce(F.sum("__k").over(w), F.lit(0)).alias("__o"))
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.withColumn("__i", inside).join(F.broadcast(base), "__p").withColumn(name, F.col("__i") + F.col("__o")).drop("__p", "__i", "__o")


def sitemap(urls: DataFrame, url: str = "url", shard: int = 45_000) -> DataFrame:
    """(shard, n, first_url, last_url) over the distinct sorted URLs."""
    numbered = global_index(urls.select(url).where(F.col(url).isNotNull()).distinct(), [url])
    return numbered.groupBy(F.floor((F.col("n") - 1) / shard).cast("long").alias("shard")).agg(
        F.count(F.lit(1)).alias("n"), F.min(url).alias("first_url"), F.max(url).alias("last_url")
    )


def sitemap_xml(urls: DataFrame, url: str = "url", shard: int = 45_000) -> DataFrame:
    """(shard, content): one XML document of bounded size per shard."""
    numbered = global_index(urls.select(url).where(F.col(url).isNotNull()).distinct(), [url])
    entry = F.concat(F.lit("<url><loc>"), html_escape(F.col("u")), F.lit("</loc></url>"))
    grouped = numbered.groupBy(F.floor((F.col("n") - 1) / shard).cast("long").alias("shard")).agg(F.sort_array(F.collect_list(url)).alias("us"))
    body = F.array_join(F.transform("us", lambda u: F.concat(F.lit("<url><loc>"), html_escape(u), F.lit("</loc></url>"))), "")
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return grouped.select("shard", F.concat(F.lit(head), body, F.lit("</urlset>")).alias("content"))


def sitemap_index(shards: DataFrame, base: str) -> DataFrame:
    """(content): the index document that names the shards (shard, content) below ``base``; one row per 45,000 URLs."""
    entry = F.concat(F.lit(f"<sitemap><loc>{base}/"), F.lpad(F.col("shard").cast("string"), 3, "0"), F.lit(".xml</loc></sitemap>"))
    head = '<?xml version="1.0" encoding="UTF-8"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return shards.agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</sitemapindex>")).alias("content"))


def table_digest(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(digest, n): hash of ordered bucket hashes, each over its sorted row hashes; equal tables give equal digests."""
    row = F.sha2(canonical_json(**{c: F.col(c) for c in cols}), 256)
    per = (
        rows.select(row.alias("r"))
        .groupBy(F.substring("r", 1, 4).alias("b"))
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("r")), ""), 256).alias("h"), F.count(F.lit(1)).alias("k"))
    )
    return per.agg(F.upper(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256)).alias("digest"), F.sum("k").alias("n"))


def manifest_digest(files: DataFrame) -> DataFrame:
    """(release_id, digest): upper SHA-256 over the canonical lines of a release's files in path order (a package has at most 10,000 files)."""
    line = canonical_json(relative_path=F.col("relative_path"), size_bytes=F.col("size_bytes"), sha256=F.col("sha256"))
    listed = F.sort_array(F.collect_list(F.struct("relative_path", line.alias("line"))))
    return files.groupBy("release_id").agg(F.upper(F.sha2(F.concat(F.array_join(F.transform(listed, lambda s: s["line"]), "\n"), F.lit("\n")), 256)).alias("digest"))


def leaks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, local_path, secret) flags."""
    return rows.select(key, F.coalesce(F.col(text).rlike(LOCAL_PATH), F.lit(False)).alias("local_path"), F.coalesce(F.col(text).rlike(SECRET), F.lit(False)).alias("secret"))


def record_markdown(code: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("## "), code, F.lit("\n\n**"), F.coalesce(label, F.lit("")), F.lit("**\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def record_html(code: Column, label: Column, text: Column) -> Column:
    esc = lambda c: html_escape(F.coalesce(c, F.lit("")))
    return F.concat(F.lit("<article><h2>"), esc(code), F.lit("</h2><p>"), esc(label), F.lit("</p><p>"), esc(text), F.lit("</p></article>"))
