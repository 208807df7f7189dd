"""Publication tree of a store: byte-bounded objects, directories, manifest, validation, comparison.

Objects are rows (key, content) until the last step; tasks write them below the
target and return size and digest, so the driver only sees the manifest's rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasane.api import Store
from kasane.functions import text as tx
from kasane.operators import publish
from kasane.runtime import Scratch
from kasane.sources.package import write_json

CHUNK_BYTES = 256 * 1024
SAFE_KEY = r"^[A-Za-z0-9._~%-]+(?:/[A-Za-z0-9._~%-]+)*$"
SUFFIXES = (".json", ".html", ".md", ".xml", ".txt", ".css")
#: Gates of a publication policy (fixed values).
MUST = ("public_delivery", "redistribution", "attribution_required", "notices_reviewed", "evidence_recorded")
MUST_NOT = ("personal_data", "access_restricted", "embargoed")
_ACTIVE = re.compile(
    r"<\s*(?:script|iframe|object|embed|applet|base|form|frame|portal)\b|<[^>]*\son[a-z]+\s*=|(?:javascript|vbscript|data)\s*:(?!image/)[^\s\"'>]|<\s*meta[^>]*http-equiv\s*=\s*[\"']?refresh"
    r"|@import\b|url\(\s*[\"']?\s*(?:https?:)?//|(?:src|data|action|formaction|poster|background|manifest)\s*=\s*[\"']?\s*(?:https?:)?//",
    re.I,
)


class ExportError(RuntimeError):
    """The tree must not be published."""


def load_policy(path: str, release_id: str) -> dict:
    """One source, all required flags true, all forbidden ones false, notices in both languages."""
    import yaml

    with open(path, encoding="utf-8") as f:
        policy = yaml.safe_load(f)
    sources = policy.get("sources") or []
    if policy.get("release_id") != release_id or len(sources) != 1:
        raise ExportError("the policy names another release or not exactly one source")
    flags = sources[0].get("flags") or {}
    if not all(flags.get(k) is True for k in MUST) or not all(flags.get(k) is False for k in MUST_NOT):
        raise ExportError("a gate of the policy is closed")
    if not all((sources[0].get("notices") or {}).get(x, "").strip() for x in ("ja", "en")):
        raise ExportError("a notice is missing")
    return policy


def check_policy(policy: dict, store: Store) -> None:
    """The policy's attribution is the one notice of the store, or nothing is published."""
    notices = {r.attribution.strip() for r in store.t["release_source"].select("attribution").distinct().limit(2).collect()}
    if len(notices) != 1 or policy["sources"][0].get("attribution", "").strip() not in notices:
        raise ExportError("the attribution of the policy is not the notice of the store")


def document_objects(store: Store, limit: int = CHUNK_BYTES) -> DataFrame:
    """(key, content) of every document: its segments in order, packed to chunks, with the document's head in each."""
    head = store.t["document"].select("document_id", F.to_json(F.struct("document_id", "kind", "language", "title")).alias("head"))
    rows = store.t["document_text"].select(
        "document_id", "sequence_number", F.to_json(F.struct("sequence_number", "locator", "heading", "text"), {"ignoreNullFields": "false"}).alias("j"),
    ).withColumn("bytes", F.octet_length("j") + 1)
    packed = publish.pack(rows, "document_id", ["sequence_number"], "bytes", limit)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence_number", "j"))), lambda s: s["j"]), ",")  # bounded by the limit, or one segment
    chunk = packed.groupBy("document_id", "chunk").agg(body.alias("body")).join(head, "document_id")
    name = F.concat(F.lit("documents/"), tx.path_segment(F.col("document_id")), F.when(F.col("chunk") > 1, F.concat(F.lit("-"), F.lpad(F.col("chunk").cast("string"), 3, "0"))).otherwise(""), F.lit(".json"))
    return chunk.select(name.alias("key"), F.concat(F.lit('{"document":'), "head", F.lit(',"segments":['), "body", F.lit("]}")).alias("content"))


def record_objects(store: Store, limit: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(objects, directory): JSON, HTML and Markdown per chunk of a group, chunks packed in lookup order."""
    rows = store.groups().select(
        F.concat_ws("/", "scheme", F.coalesce(tx.blank_to_null(F.col("edition")), F.lit("-")), tx.path_segment(F.col("group_key"))).alias("grp"),
        tx.lookup_key(F.col("scheme"), F.col("edition"), F.col("normalized_code")).alias("lookup_key"), "normalized_code", "record_json",
    ).withColumn("bytes", F.octet_length("record_json") + 1)
    if not rows.where(F.col("bytes") > limit).isEmpty():
        raise ExportError(f"a record exceeds {limit} bytes")
    packed = Scratch(store.spark, "export").save(publish.pack(rows, "grp", ["lookup_key"], "bytes", limit))
    listing = publish.directory(packed, "grp", "lookup_key", "bytes")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("lookup_key", F.col(c).alias("x")))), lambda s: s["x"])
    page = packed.withColumn("html", publish.record_html(F.col("normalized_code"), F.lit(""), F.col("record_json"))).withColumn("md", publish.record_markdown(F.col("normalized_code"), F.lit(""), F.col("record_json")))
    chunk = page.groupBy("grp", "chunk").agg(F.array_join(ordered("record_json"), ",").alias("j"), F.array_join(ordered("html"), "").alias("h"), F.array_join(ordered("md"), "\n").alias("m"))
    name = F.concat("grp", F.lit("/"), F.lpad(F.col("chunk").cast("string"), 3, "0"))
    kinds = F.array(
        F.struct(F.concat(F.lit("records/"), name, F.lit(".json")).alias("key"), F.concat(F.lit('{"records":['), "j", F.lit("]}")).alias("content")),
        F.struct(F.concat(F.lit("site/"), name, F.lit(".html")).alias("key"), F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"></head><body>'), "h", F.lit("</body></html>")).alias("content")),
        F.struct(F.concat(F.lit("site/"), name, F.lit(".md")).alias("key"), F.col("m").alias("content")),
    )
    return chunk.select(F.explode(kinds).alias("o")).select("o.*"), listing


def write_objects(objects: DataFrame, target: str) -> DataFrame:
    """Writes (key, content) below target; returns (key, bytes, sha256). Keys must be safe and unique."""
    if not objects.where(~F.col("key").rlike(SAFE_KEY) | F.col("key").contains("..")).isEmpty():
        raise ExportError("unsafe key")
    if not objects.groupBy("key").count().where("count > 1").isEmpty():
        raise ExportError("repeated key")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, content in zip(pdf["key"], pdf["content"]):
                raw = content.encode("utf-8")
                path = os.path.join(target, key)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{os.getpid()}.part"  # a repeated task writes the same bytes
                with open(part, "wb") as f:
                    f.write(raw)
                os.replace(part, path)
                out.append((key, len(raw), hashlib.sha256(raw).hexdigest()))
            yield pd.DataFrame(out, columns=["key", "bytes", "sha256"])

    return Scratch(objects.sparkSession, "put").save(objects.mapInPandas(put, "key string, bytes long, sha256 string"))


def tree_digest(rows: DataFrame) -> str:
    """Digest over (bytes, key, sha256) in key order, in two levels."""
    return publish.table_digest(rows, ["bytes", "key", "sha256"]).first().digest


def export(store: Store, target: str, policy: str, base_url: str = "https://example.invalid") -> dict:
    """Writes the tree and its manifest where the policy file allows it; the target must not exist."""
    if os.path.exists(target):
        raise FileExistsError(target)
    if not re.fullmatch(r"https?://[^/?#@\s]+", base_url):
        raise ExportError("the base URL is an origin only")
    check_policy(load_policy(policy, store.release()["release_id"]), store)
    objects, listing = record_objects(store)
    urls = objects.where(F.col("key").endswith(".html")).select(F.concat(F.lit(base_url + "/"), "key").alias("url"))
    shards = publish.sitemap_xml(urls)
    index = publish.sitemap_index(shards, f"{base_url}/sitemaps").select(F.lit("sitemap.xml").alias("key"), "content")
    maps = shards.select(F.concat(F.lit("sitemaps/"), F.lpad(F.col("shard").cast("string"), 3, "0"), F.lit(".xml")).alias("key"), "content")
    groups = listing.groupBy("grp").agg(F.to_json(F.sort_array(F.collect_list(F.struct("chunk", "first_key", "last_key", "n", "bytes")))).alias("content"))
    dirs = groups.select(F.concat(F.lit("groups/"), "grp", F.lit(".json")).alias("key"), "content")
    written = write_objects(objects.unionByName(maps).unionByName(dirs).unionByName(index).unionByName(document_objects(store)), target)
    total = written.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()
    written.write.parquet(os.path.join(target, "objects.parquet"))
    canonical = store.t["concept"].where("record_status = 'canonical'").count()
    manifest = {
        "release_id": store.release()["release_id"], "objects": total.n, "bytes": total.b, "tree_sha256": tree_digest(written), "canonical_concepts": canonical,
        "exported_records": listing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n, "attribution": store.t["release_source"].first().attribution,
    }
    write_json(os.path.join(target, "manifest.json"), manifest)
    if manifest["canonical_concepts"] != manifest["exported_records"]:
        raise ExportError("not every canonical concept was exported")
    return manifest


def issues(spark: SparkSession, target: str) -> DataFrame:
    """(key, issue) over the files of a tree: missing, extra, size, digest, suffix, parse, active, leak."""
    base = os.path.abspath(target)
    for folder, dirs, files in os.walk(base):
        if any(os.path.islink(os.path.join(folder, x)) for x in (*dirs, *files)):
            raise ExportError("link in the tree")
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        .select(F.substring("path", F.lit(len("file:" + base) + 2), F.length("path")).alias("raw"), "content", F.col("length").alias("size"))
        .select(F.url_decode(F.replace("raw", F.lit("+"), F.lit("%2B"))).alias("path_key"), "raw", "content", "size")
        .where(~F.col("raw").startswith("objects.parquet/") & (F.col("raw") != "manifest.json"))
    )

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leak = re.compile(publish.LOCAL_PATH + "|" + publish.SECRET.replace("(?i)", "", 1))
        for pdf in batches:
            out = []
            for raw_key, raw in zip(pdf["raw"], pdf["content"]):
                bad = []
                if not raw_key.endswith(SUFFIXES):
                    bad.append("suffix")
                try:
                    text = raw.decode("utf-8")
                    if raw_key.endswith(".json"):
                        json.loads(text)
                    if raw_key.endswith(".html") and _ACTIVE.search(text):
                        bad.append("active")
                    if leak.search(text):
                        bad.append("leak")
                except ValueError:
                    bad.append("parse")
                out.append((raw_key, len(raw), hashlib.sha256(raw).hexdigest(), bad))
            yield pd.DataFrame(out, columns=["key", "size", "sha", "bad"])

    seen = found.mapInPandas(look, "key string, size long, sha string, bad array<string>")
    listed = spark.read.parquet(os.path.join(base, "objects.parquet"))
    both = listed.join(seen, "key", "full")
    flags = F.array_compact(
        F.array(
            F.when(F.col("size").isNull(), "missing"), F.when(F.col("bytes").isNull(), "extra"),
            F.when(F.col("bytes") != F.col("size"), "size"), F.when(F.col("sha256") != F.col("sha"), "digest"),
        )
    )
    return both.select("key", F.explode(F.concat(flags, F.coalesce("bad", F.array().cast("array<string>")))).alias("issue"))


def validate(spark: SparkSession, target: str) -> dict:
    with open(os.path.join(target, "manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    found = issues(spark, target)
    counts = {r.issue: r["count"] for r in found.groupBy("issue").count().collect()}
    digest = tree_digest(spark.read.parquet(os.path.join(target, "objects.parquet")))
    return {"valid": not counts and digest == manifest["tree_sha256"], "issues": counts, "tree_match": digest == manifest["tree_sha256"]}


def audit(spark: SparkSession, a: str, b: str) -> dict:
    """Are two trees the same? Counts of objects only in one, or different."""
    left, right = (spark.read.parquet(os.path.join(x, "objects.parquet")) for x in (a, b))
    diff = left.join(right.select("key", F.col("sha256").alias("other")), "key", "full").where(~F.col("sha256").eqNullSafe(F.col("other")))
    return {"equal": diff.isEmpty(), "different": diff.count(), "a": tree_digest(left), "b": tree_digest(right)}


def find_object(spark: SparkSession, target: str, scheme: str, edition: str, code: str) -> dict | None:
    """Two reads: the group's directory, then the chunk whose key range holds the code."""
    import urllib.parse

    n = "".join(code.split()).upper()
    group = n[:5] if scheme == "fterm" else n.split("/", 1)[0]
    path = f"{scheme}/{edition or '-'}/{urllib.parse.quote(group, safe='-._~')}"
    listing = os.path.join(target, "groups", f"{path}.json")
    if not os.path.exists(listing):
        return None
    key = "\x1f".join((scheme, edition, n))
    with open(listing, encoding="utf-8") as f:
        hit = next((c for c in json.load(f) if c["first_key"] <= key <= c["last_key"]), None)
    if hit is None:
        return None
    with open(os.path.join(target, "records", path, f"{hit['chunk']:03d}.json"), encoding="utf-8") as f:
        return next((r for r in json.load(f)["records"] if r["normalized_code"] == n), None)
