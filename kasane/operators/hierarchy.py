"""Parent-child links to full hierarchies (heavy-path decomposition).

1. Cycle separation. Pointers of length 2^k are doubled; a node whose pointer
   runs off its tree is acyclic. Doubling the rest until the image is stable
   leaves exactly the nodes on circles, and a minimum carried along names each.
2. Subtree sizes come from the same doubling: the nodes at distance 2^k add the
   part of their subtree counted so far.
3. Each inner node continues the chain of its largest inner child; a node with
   another place opens a chain. Chain pointers are doubled to the chain's head.
4. A root path crosses at most log2(n) chains, so root, depth, path segments
   and intervals are handed from chain to chain in that many rounds.

Only nodes with children take part in the rounds; leaves are attached at the
end. Sums per parent are partially aggregated, joins on the parent are split by
adaptive execution, and sibling offsets use a two-level prefix sum, so one
parent may hold any share of the rows. Every round is written to the shared
folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kasane.functions.text import norm_code, strip_white
from kasane.runtime import Scratch

SALT = 64


def clean_links(links: DataFrame, nodes: DataFrame, node_id: str, src: str, dst: str, kind: str) -> DataFrame:
    """(v, p): one parent per child.

    ``kind`` without case and outer blanks: ``parent`` runs from child to
    parent, ``child`` the other way, others (and null) do not count. Links with
    a null end or an end missing from ``nodes`` do not count either. Repeated
    links count once; of several parents the smallest id is kept.
    """
    k = F.lower(strip_white(F.col(kind)))
    a, b = F.col(src), F.col(dst)
    ids = nodes.select(F.col(node_id).alias("__id")).where("__id is not null").distinct()
    pairs = (
        links.where(k.isin("parent", "child"))
        .select(F.when(k == "parent", a).otherwise(b).alias("v"), F.when(k == "parent", b).otherwise(a).alias("p"))
        .where("v is not null and p is not null")
        .distinct()
    )
    pairs = pairs.join(ids.withColumnRenamed("__id", "v"), "v", "left_semi")
    pairs = pairs.join(ids.withColumnRenamed("__id", "p"), "p", "left_semi")
    return pairs.groupBy("v").agg(F.min("p").alias("p"))


class Forest:
    """The decomposition of one (v, p) table; results are DataFrames over written tables."""

    def __init__(self, links: DataFrame, intervals: bool = False):
        self.spark = links.sparkSession
        self.scratch = Scratch(self.spark, "forest")
        self.intervals = intervals
        self.links = self.scratch.save(links.select("v", "p"))
        self._build()

    # -- rounds -----------------------------------------------------------
    def _build(self) -> None:
        save, links = self.scratch.save, self.links
        inner = links.select(F.col("p").alias("v")).distinct()
        weight = links.join(inner, "v", "left_anti").groupBy("p").agg(F.count(F.lit(1)).alias("leaves"))
        self.inner = save(
            inner.join(links, "v", "left")
            .join(weight.withColumnRenamed("p", "v"), "v", "left")
            .select("v", "p", (F.lit(1) + F.coalesce("leaves", F.lit(0))).cast("long").alias("w"))
        )
        sized = self._double_sizes()
        self.loops = self._circles(sized)
        acyclic = self.scratch.save(sized.where("j is null").join(self.inner.select("v", "p"), "v").select("v", "p", "f"))
        self.scratch.drop(sized)
        self._chains(acyclic)

    def _double_sizes(self) -> DataFrame:
        cur = self.scratch.save(self.inner.select("v", F.col("p").alias("j"), F.col("w").alias("f")))
        left = cur.where("j is not null").count()
        while left:
            hop = cur.select(F.col("v").alias("j"), F.col("j").alias("jj"))
            add = cur.where("j is not null").groupBy("j").agg(F.sum("f").alias("add")).withColumnRenamed("j", "v")
            step = (
                cur.join(hop, "j", "left")
                .join(add, "v", "left")
                .select("v", F.col("jj").alias("j"), (F.col("f") + F.coalesce("add", F.lit(0))).alias("f"))
            )
            nxt = self.scratch.save(step)
            self.scratch.drop(cur)
            cur, now = nxt, nxt.where("j is not null").count()
            if now == left:  # no node ended its walk in this round: the rest never will
                break
            left = now
        return cur

    def _circles(self, sized: DataFrame) -> DataFrame:
        """(v, on_circle, circle) for inner nodes on or below a circle."""
        stuck = sized.where("j is not null").select("v").join(self.inner.select("v", "p"), "v")
        cur = self.scratch.save(stuck.select("v", F.col("p").alias("g"), F.col("v").alias("m")))
        image, total = -1, cur.count()
        while total:
            hop = cur.select(F.col("v").alias("g"), F.col("g").alias("gg"), F.col("m").alias("mm"))
            nxt = self.scratch.save(
                cur.join(hop, "g").select(
                    "v", F.col("gg").alias("g"), F.least("m", "mm").alias("m"), (F.col("mm") < F.col("m")).alias("moved")
                )
            )
            self.scratch.drop(cur)
            cur = nxt
            seen = cur.agg(F.countDistinct("g").alias("n"), F.count(F.when(F.col("moved"), 1)).alias("moved")).first()
            if seen.n == image and seen.moved == 0:
                break
            image = seen.n
        on = cur.select(F.col("g").alias("v")).distinct().withColumn("on_circle", F.lit(True))
        name = cur.select(F.col("v").alias("g"), F.col("m").alias("circle"))
        return self.scratch.save(
            cur.select("v", "g").join(name, "g").join(on, "v", "left").select(
                "v", F.coalesce("on_circle", F.lit(False)).alias("on_circle"), "circle"
            )
        )

    def _chains(self, acyclic: DataFrame) -> None:
        save = self.scratch.save
        heavy = acyclic.where("p is not null").groupBy("p").agg(
            F.min_by("v", F.struct((-F.col("f")).alias("a"), F.col("v").alias("b"))).alias("h")
        )
        stays = F.coalesce(F.col("h") == F.col("v"), F.lit(False))
        cur = save(
            acyclic.join(heavy, "p", "left").select(
                "v", F.when(stays, F.col("p")).otherwise(F.col("v")).alias("t"), stays.cast("long").alias("o")
            )
        )
        while True:
            hop = cur.select(F.col("v").alias("t"), F.col("t").alias("tt"), F.col("o").alias("oo"))
            nxt = save(cur.join(hop, "t").select("v", F.col("tt").alias("t"), (F.col("o") + F.col("oo")).alias("o"), (F.col("oo") > 0).alias("more")))
            self.scratch.drop(cur)
            cur = nxt
            if cur.where("more").isEmpty():
                break
        # node -> chain head and place on the chain
        self.place = save(
            cur.select("v", F.col("t").alias("head"), F.col("o").alias("off")).join(acyclic.select("v", "p", "f"), "v")
        )
        self.scratch.drop(cur)
        shift = self._offsets() if self.intervals else None
        heads = self.place.where("off = 0").select("head", F.col("p").alias("at"))
        at = self.place.select(F.col("v").alias("at"), F.col("head").alias("up"), F.col("off").alias("at_off"))
        waiting = heads.join(at, "at", "left")
        if shift is not None:
            waiting = waiting.join(shift.withColumnRenamed("v", "head"), "head", "left")
        else:
            waiting = waiting.withColumn("shift", F.lit(None).cast("long"))
        waiting = save(waiting.select("head", "up", "at_off", "shift"))
        seg = "array<struct<head:{0},n:bigint>>".format(self.links.schema["v"].dataType.simpleString())
        done = save(
            waiting.where("up is null").select(
                "head", F.col("head").alias("root"), F.lit(0).cast("long").alias("depth"),
                F.lit(1).cast("long").alias("tin"), F.array().cast(seg).alias("segs"),
            )
        )
        levels = [done]
        while True:
            up = done.select(F.col("head").alias("up"), "root", "depth", "tin", "segs")
            done = save(
                waiting.join(up, "up").select(
                    "head", "root",
                    (F.col("depth") + F.col("at_off") + 1).alias("depth"),
                    (F.col("tin") + F.col("at_off") + F.col("shift")).alias("tin"),
                    F.concat("segs", F.array(F.struct(F.col("up").alias("head"), (F.col("at_off") + 1).alias("n")))).alias("segs"),
                )
            )
            if done.isEmpty():
                break
            levels.append(done)
        chains = levels[0]
        for more in levels[1:]:
            chains = chains.unionByName(more)
        self.chains = chains

    def _offsets(self) -> DataFrame:
        """(v, shift): distance in the numbering from a node's parent to the node, for chain heads and leaves.

        The chain goes first, then the other inner children, then the leaves.
        """
        inner = self.place.select("v", "p", "f", "off").where("p is not null")
        chain = inner.where("off > 0").groupBy("p").agg(F.max("f").alias("first"))
        light = inner.where("off = 0").select("v", "p", "f", F.lit(0).alias("rank"))
        leaves = self.leaves().select("v", "p", F.lit(1).cast("long").alias("f"), F.lit(1).alias("rank"))
        sib = light.unionByName(leaves)
        part = F.col("rank") * SALT + F.pmod(F.xxhash64("v"), F.lit(SALT))
        sib = sib.withColumn("part", part)
        within = Window.partitionBy("p", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        sib = sib.withColumn("inpart", F.coalesce(F.sum("f").over(within), F.lit(0)))
        totals = sib.groupBy("p", "part").agg(F.sum("f").alias("tot"))
        over = Window.partitionBy("p").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * SALT rows
        totals = totals.withColumn("base", F.coalesce(F.sum("tot").over(over), F.lit(0))).drop("tot")
        return self.scratch.save(
            sib.join(totals, ["p", "part"])
            .join(chain, "p", "left")
            .select("v", (F.lit(1) + F.coalesce("first", F.lit(0)) + F.col("base") + F.col("inpart")).alias("shift"))
        )

    # -- results ----------------------------------------------------------
    def leaves(self) -> DataFrame:
        """(v, p) of nodes without children whose parent is acyclic."""
        return self.links.join(self.inner.select("v"), "v", "left_anti").join(
            self.place.select(F.col("v").alias("p")), "p", "left_semi"
        ).select("v", "p")

    def _inner_full(self) -> DataFrame:
        return self.place.join(self.chains, "head").select(
            "v", "p", "root", (F.col("depth") + F.col("off")).alias("depth"), "head", "off", "segs",
            (F.col("tin") + F.col("off")).alias("tin"), F.col("f").alias("size"),
        )

    def nodes(self) -> DataFrame:
        """(v, root, depth) of every node with a parent; depth -1 on a circle, -2 below one."""
        inner = self._inner_full().select("v", "p", "root", "depth")
        bad = self.loops.select("v", F.col("circle").alias("root"), F.when(F.col("on_circle"), -1).otherwise(-2).cast("long").alias("depth"))
        known = inner.select("v", "root", (F.col("depth") + 1).alias("depth")).unionByName(
            bad.select("v", "root", F.lit(-2).cast("long").alias("depth"))
        )
        leaf = (
            self.links.join(self.inner.select("v"), "v", "left_anti")
            .join(known.withColumnRenamed("v", "p"), "p")
            .select("v", "root", "depth")
        )
        return inner.where("p is not null").select("v", "root", "depth").unionByName(bad).unionByName(leaf)

    def spans(self) -> DataFrame:
        """(v, root, tin, tout): the descendants of v are the nodes of its root with tin in (tin, tout]."""
        if not self.intervals:
            raise ValueError("built without intervals")
        full = self._inner_full().select("v", "root", "tin", "size")
        shift = self._offsets()
        leaf = (
            self.leaves()
            .join(shift, "v")
            .join(full.select(F.col("v").alias("p"), "root", "tin"), "p")
            .select("v", "root", (F.col("tin") + F.col("shift")).alias("tin"), F.lit(1).cast("long").alias("size"))
        )
        both = full.unionByName(leaf)
        return both.select("v", "root", "tin", (F.col("tin") + F.col("size") - 1).alias("tout"))

    def paths(self) -> DataFrame:
        """(v, path): node ids from the root down to v, for acyclic nodes with a parent.

        Chain segments are joined by head and concatenated in order.
        """
        chain_nodes = self.place.groupBy("head").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("off", "v"))), lambda s: s["v"]).alias("ids")
        )
        heads = (
            self.chains.select("head", F.posexplode("segs").alias("i", "s"))
            .select(F.col("head").alias("h0"), "i", F.col("s.head").alias("head"), F.col("s.n").alias("n"))
            .join(chain_nodes, "head")
            .groupBy("h0")
            .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", F.slice("ids", F.lit(1), F.col("n").cast("int")).alias("part")))), lambda s: s["part"])).alias("prefix"))
            .withColumnRenamed("h0", "head")
        )
        inner = (
            self.place.join(chain_nodes, "head")
            .join(heads, "head", "left")
            .select("v", "p", F.concat(F.coalesce("prefix", F.slice("ids", 1, 0)), F.slice("ids", F.lit(1), (F.col("off") + 1).cast("int"))).alias("path"))
        )
        leaf = self.leaves().join(inner.select(F.col("v").alias("p"), "path"), "p").select("v", F.concat("path", F.array("v")).alias("path"))
        return inner.where("p is not null").select("v", "path").unionByName(leaf)


def _whole(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(v, root, depth, path, tin, tout) of every id, those without links included; no path and interval on or below circles."""
    made = Forest(links, intervals=True)
    spans = made.spans().select("v", "tin", "tout")
    lone = F.col("depth").isNull()
    return (
        ids.join(made.nodes(), "v", "left").join(made.paths(), "v", "left").join(spans, "v", "left")
        .select(
            "v", F.coalesce("root", "v").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
            F.when(lone, F.array("v")).otherwise(F.col("path")).alias("path"),
            *(F.when(lone, F.coalesce(c, F.lit(1).cast("long"))).otherwise(F.col(c)).alias(c) for c in ("tin", "tout")),
        )
    )


def revision_links(relations: DataFrame, revisions: DataFrame) -> DataFrame:
    return clean_links(relations, revisions, "revision_id", "from_revision_id", "to_revision_id", "kind")


def revision_depths(relations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(revision_id, root_revision_id, depth) of every revision with a parent."""
    out = Forest(revision_links(relations, revisions)).nodes()
    return out.select(F.col("v").alias("revision_id"), F.col("root").alias("root_revision_id"), "depth")


def revision_paths(relations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(revision_id, path): ids from the root down, joined by '/'."""
    out = Forest(revision_links(relations, revisions)).paths()
    return out.select(F.col("v").alias("revision_id"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def revision_descendant_list(relations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(revision_id, descendant_id): every pair of an acyclic revision and one below it, as many rows as the paths have steps."""
    out = Forest(revision_links(relations, revisions)).paths()
    above = F.slice("path", F.lit(1), F.size("path") - 1)
    return out.select(F.explode(above).alias("revision_id"), F.col("v").alias("descendant_id"))


def revision_descendants(relations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(revision_id, root_revision_id, tin, tout, n_descendants): descendants as intervals of the numbering."""
    out = Forest(revision_links(relations, revisions), intervals=True).spans()
    return out.select(
        F.col("v").alias("revision_id"), F.col("root").alias("root_revision_id"), "tin", "tout",
        (F.col("tout") - F.col("tin")).alias("n_descendants"),
    )


def revision_hierarchy(relations: DataFrame, revisions: DataFrame) -> DataFrame:
    """(revision_id, root_revision_id, depth, path, tin, tout): every revision, roots and those without links included."""
    ids = revisions.select(F.col("revision_id").alias("v")).where("v is not null").distinct()
    out = _whole(ids, revision_links(relations, revisions))
    return out.select(F.col("v").alias("revision_id"), F.col("root").alias("root_revision_id"), "depth", "path", "tin", "tout")


def _record_parents(records: DataFrame, prefix: Column | None = None) -> DataFrame:
    """(v, up): one row per record, the latest loaded, with the keys of its parents in order."""
    head = [] if prefix is None else [prefix]
    key = lambda s, e, c: F.concat_ws("|", *head, F.coalesce(s, F.lit("")), F.coalesce(e, F.lit("")), F.coalesce(norm_code(c), F.lit("")))
    at = F.coalesce(F.col("loaded_at").cast("timestamp"), F.lit("0001-01-01 00:00:00").cast("timestamp"))
    up = F.transform(
        F.filter("relations", lambda r: F.lower(strip_white(r["type"])) == "parent"), lambda r: key(r["scheme"], r["edition"], r["code"])
    )
    return (
        records.select(key(F.col("scheme"), F.col("edition"), F.col("normalized_code")).alias("v"), at.alias("at"), F.sort_array(F.coalesce(up, F.array().cast("array<string>"))).alias("up"))
        .groupBy("v")
        .agg(F.max_by("up", F.struct("at", "up")).alias("up"))
    )


def _parent_links(one: DataFrame) -> DataFrame:
    pairs = one.select("v", F.explode("up").alias("p"))
    return pairs.join(one.select(F.col("v").alias("p")), "p", "left_semi").groupBy("v").agg(F.min("p").alias("p"))


def record_links(records: DataFrame, release_id: str | None = None) -> DataFrame:
    """(v, p) over the records of one release (the last one unless named), keys as scheme|edition|code.

    Of several rows of a record the latest loaded counts. Parents come from the
    ``parent`` members of ``relations``; those that are no record of the
    release do not count, of several the smallest key does.
    """
    if release_id is None:
        release_id = records.agg(F.max("release_id").alias("r")).first().r
    return _parent_links(_record_parents(records.where(F.col("release_id").eqNullSafe(F.lit(release_id)))))


def record_depths(records: DataFrame) -> DataFrame:
    """(release_id, record, root_record, depth): as ``record_hierarchy``, without the work for paths and intervals."""
    one = Scratch(records.sparkSession, "releases").save(_record_parents(records, F.coalesce("release_id", F.lit(""))))
    made = Forest(_parent_links(one)).nodes()
    return one.select("v").join(made, "v", "left").select(
        F.substring_index("v", "|", 1).alias("release_id"), _bare("v").alias("record"), _bare(F.coalesce("root", "v")).alias("root_record"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def record_hierarchy(records: DataFrame) -> DataFrame:
    """(release_id, record, root_record, depth, path, tin, tout): every record of every release, roots included.

    Each release is a forest of its own; links as in ``record_links``. ``path``
    is the array of records from the root down. Depth -1 is on a circle, -2
    below one, both with the circle's smallest record as root and without path
    and interval. The descendants of a record are the records of its release
    and root with tin in (tin, tout].
    """
    spark = records.sparkSession
    one = Scratch(spark, "releases").save(_record_parents(records, F.coalesce("release_id", F.lit(""))))
    return _whole(one.select("v"), _parent_links(one)).select(
        F.substring_index("v", "|", 1).alias("release_id"), _bare("v").alias("record"), _bare("root").alias("root_record"),
        "depth", F.transform("path", _bare).alias("path"), "tin", "tout",
    )


def _bare(key: Column | str) -> Column:
    """scheme|edition|code of release|scheme|edition|code; codes may hold the separator, releases may not."""
    return F.regexp_replace(key, r"^[^|]*\|", "")
