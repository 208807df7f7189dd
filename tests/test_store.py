import json
import os

import pytest
from pyspark.sql import functions as F

import package_fixture
from kasane import cli
from kasane.api import Store
from kasane.errors import QueryError
from kasane.operators.quality import store_checks
from kasane.sources import build, package


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return package_fixture.write(tmp_path_factory.mktemp("package"))


@pytest.fixture(scope="module")
def store_path(spark, root, tmp_path_factory):
    return build.build_store(spark, root, "JPPM2026001", str(tmp_path_factory.mktemp("data") / "store"), allow_issues=True)


@pytest.fixture(scope="module")
def store(spark, store_path):
    return Store(spark, store_path)


def test_inventory(spark, root, tmp_path):
    files = package.inventory(spark, root, "R")
    rows = {r.relative_path: r for r in files.collect()}
    assert len(rows) == len(package_fixture.FILES)
    assert [r.relative_path for r in files.orderBy("file_id").collect()] == sorted(rows)
    assert rows["FI/FI_TEXT/fiText_B_20260101.csv"].encoding == "cp932"
    assert rows["FTERM/THEME/theme_20260101.csv"].encoding == "utf-8-sig"
    assert rows["FI/FI_KAISEI_DOC/fi.xsl"].status == "retained" and rows["COPYRGHT"].data_group == "COPYRGHT"
    assert package.reference_date(files) == "2026-01-01"
    package.write_inventory(files, str(tmp_path))
    lines = (tmp_path / "source-manifest.jsonl").read_text().splitlines()
    assert [json.loads(x)["relative_path"] for x in lines] == sorted(rows)
    assert json.loads((tmp_path / "summary.json").read_text())["status"]["retained"] == 2


def test_bad_files_stay_visible(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<open>")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    (tmp_path / "c.csv").write_bytes(b"\x81")
    rows = {r.relative_path: r for r in package.inventory(spark, str(tmp_path), "R").collect()}
    assert {r.status for r in rows.values()} == {"failed"} and all(r.error for r in rows.values())
    os.symlink(tmp_path / "a.xml", tmp_path / "l.xml")
    with pytest.raises(ValueError):
        package.reject_links(str(tmp_path))


def ids_of(store, scheme, edition, code):
    return store.t["concept"].where(f"scheme = '{scheme}' and edition = '{edition}' and normalized_code = '{code}'").first().concept_id


def test_tables(store):
    concepts = {(r.scheme, r.edition, r.normalized_code): r for r in store.t["concept"].collect()}
    assert concepts["fi", "", "B01D8/00"].record_status == "reference_only"
    assert concepts["fi", "", "B01D10/00"].record_status == "canonical"
    assert concepts["fterm", "", "9Z001AA"].concept_type == "aspect"
    assert sorted(r.concept_id for r in concepts.values()) == list(range(1, len(concepts) + 1))
    ids = {r.concept_id: k for k, r in concepts.items()}
    parents = {(ids[r.from_concept_id][2], ids[r.to_concept_id][2]) for r in store.t["relation"].where("kind = 'parent'").collect() if ids[r.from_concept_id][0] == "fi"}
    assert parents == {("B01D", "B01"), ("B01D10/00", "B01D"), ("B01D10/02", "B01D10/00"), ("B01D10/04", "B01D10/00"), ("B01D12/00", "B01D")}
    terms = {(ids[r.from_concept_id][2], ids[r.to_concept_id][2]) for r in store.t["relation"].where("kind = 'parent'").collect() if ids[r.from_concept_id][0] == "fterm"}
    assert {("9Z001AA02", "9Z001AA01"), ("9Z001AA03", "9Z001AA01"), ("9Z001BB01", "9Z001BB"), ("9Z001AA", "9Z001")} <= terms
    texts = {r.text for r in store.t["concept_text"].collect()}
    assert "二行\nの説明, 記号入り" in texts and "枝,つづき" in texts and "(Not Translated)" not in texts
    issues = {r.code for r in store.t["build_issue"].collect()}
    assert {"FI_COLUMN_COUNT", "REVISION_CONFLICT", "IPC_SEQUENCE_INVALID", "IPC_AMENDMENT_ENDPOINT_UNRESOLVED", "THEME_TRANSLATION_CONCEPT_MISSING", "THEME_TRANSLATION_SEQUENCE_MISMATCH",
            "FTERM_TRANSLATION_SEQUENCE_MISMATCH", "FTERM_TRANSLATION_DEPTH_MISMATCH", "TEXT_CONCEPT_MISSING", "RELATION_UNRESOLVED"} <= issues
    assert store.t["revision_relation"].count() == 1
    ipc = ids_of(store, "ipc", "8U", "B01D10/00")
    assert [(r.kind, r.concept_id) for r in store.t["document_link"].where("kind = 'ipc_definition'").collect()] == [("ipc_definition", ipc)]
    assert "PDF_READER_MISSING" in issues or store.t["document_text"].where("locator = 'page:1'").count() == 1
    assert store.t["source_file"].where("relative_path like '%Kaisei.html'").first().record_count == 5


def test_checks(store):
    failed = [r.name for r in store_checks(store.t).collect() if not r.match]
    assert failed == []


def test_package_checks(store):
    from kasane.operators import quality

    rows = {r.name: r for r in quality.package_checks(store.t, "2026-01-01", build.TABLES, {"revision_relation": 1}).collect()}
    assert all(r.match for r in rows.values()) and len(rows) == 17 and rows["amendment.table.relation"].match
    less = dict(store.t) | {"revision_relation": store.t["revision_relation"].limit(0), "concept_text": store.t["concept_text"].withColumn("source_locator", F.lit(" "))}
    failed = {r.name for r in quality.package_checks(less, "2026-01-01", [*build.TABLES, "more"]).collect() if not r.match}
    assert failed == {"amendment.table.relation", "concept_text.lineage", "tables.required"}


def test_leak_rules(spark):
    from kasane.operators import publish

    rows = ["C:/data/x", "see d:\\y", "\\\\host\\share", "in /home/me/", "passwd: abc", "client_secret=1", "api-key = k", "http://a/b and 1/2", "the secret of it", None]
    got = [(r.local_path, r.secret) for r in publish.leaks(spark.createDataFrame(list(enumerate(rows)), "k int, t string"), "k", "t").orderBy("k").collect()]
    assert got == [(True, False)] * 4 + [(False, True)] * 3 + [(False, False)] * 3


def test_find_chunk(spark):
    """Overlapping, nested, repeated, empty and open ranges, and keys in several parts, against all pairs; no join tests a range."""
    from kasane.operators import publish

    ranges = [("a", 10 * i, 10 * i + 7) for i in range(8)] + [("a", 7, 10), ("a", 0, 75), ("a", 0, 75), ("a", 3, 3), ("a", 9, 4), ("a", None, 5), ("b", 0, 99), (None, 0, 99)]
    ranges = [(g, n % 11 or None, a, b) for n, (g, a, b) in enumerate(ranges)]
    keys = [(n, "abc"[n % 3] if n % 50 else None, n % 83 - 2 if n % 40 else None) for n in range(1000)]
    for kind, of in (("int", lambda x: x), ("string", lambda x: None if x is None else f"{x + 9:03d}")):
        k = spark.createDataFrame([(n, g, of(x)) for n, g, x in keys], f"n int, g string, k {kind}")
        for some in (ranges, []) if kind == "int" else (ranges[:8],):
            found = publish.find_chunk(k, spark.createDataFrame([(g, c, of(a), of(b)) for g, c, a, b in some], f"g string, chunk int, first_key {kind}, last_key {kind}"), "g", "k")
            want = [(g, n, of(x), c, of(a), of(b)) for n, g, x in keys for h, c, a, b in some if g is not None and g == h and None not in (x, a, b) and a <= x <= b]
            assert found.columns == ["g", "n", "k", "chunk", "first_key", "last_key"]
            assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
            joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
            assert not any(">=" in line or "<=" in line for line in joins)


def test_gates(spark, root, store_path, tmp_path):
    with pytest.raises(build.BuildError):
        build.build_store(spark, root, "R", str(tmp_path / "x"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(FileExistsError):
        build.build_store(spark, root, "R", store_path)
    base = os.path.dirname(store_path)
    build.activate(base, store_path)
    assert build.resolve(data_dir=base) == os.path.realpath(store_path)
    with pytest.raises(ValueError):
        build.activate(str(tmp_path), store_path)


def test_lookup(store):
    r = store.lookup("fi", "b01d 10/00")
    assert r["match_status"] == "normalized_exact" and r["documents"][0]["link_type"] == "fi_handbook"
    assert {(x["type"], x["normalized_code"]) for x in r["relations"]} >= {("parent", "B01D"), ("child", "B01D10/02"), ("amended_from", "B01D8/00"), ("fterm_theme", "9Z001"), ("concordance", "B01D10/00")}
    assert store.lookup("fi", "B01D10/00", language="en")["texts"][0]["text"] == "Filter vessels"
    page = store.lookup("fi", "B01D10/00", relation_limit=2, relation_offset=1)
    assert len(page["relations"]) == 2 and page["relations_truncated"] and page["next_relation_offset"] == 3
    new = store.lookup("ipc", "B01D10/00")
    assert new["edition"] == "8U" and new["version"] == "2016.01" and len(new["available_versions"]) == 2
    assert store.lookup("ipc", "B01D10/00", version="2006.01")["valid_to"] == "2015-12-31"
    assert store.lookup("ipc", "B01D10/00", version="1999.01")["match_status"] == "version_not_found"
    assert {x["relative_path"] for x in r["sources"]} >= {"FI/FI/fi_B_20260101.csv", "FI/FI_HB/fiHB_B_20260101.csv"} and r["texts"][-1]["text"] == "手引きの本文"
    assert r["release_id"] == "JPPM2026001" and r["relations"][0]["source_id"].startswith("src-")
    assert store.lookup("ipc", "B01D10/00", edition="8b")["version"] is None
    assert store.lookup("fi", "Z99Z1/00")["match_status"] == "not_found"
    for bad in (("xx", "A", {}), ("fi", "", {}), ("fi", "A", {"edition": "8U"}), ("fi", "A", {"language": "fr"}), ("fi", "A", {"relation_limit": 0})):
        with pytest.raises(QueryError):
            store.lookup(bad[0], bad[1], **bad[2])


def test_search_and_documents(store):
    found = store.search("濾過器")
    assert [h["normalized_code"] for h in found["hits"]] == ["B01D10/00"] and found["search_mode"] == "ranked"
    assert store.search("題")["search_mode"] == "literal"
    assert {h["version"] for h in store.search("題", ["ipc"])["hits"]} == {"2016.01", "2006.01", ""}
    first = store.search("題", ["ipc"], limit=2)
    second = store.search("題", ["ipc"], limit=2, offset=2)
    assert first["has_more"] and len(first["hits"] + second["hits"]) == 3
    docs = store.search_documents("手引き")
    one = store.get_document(docs["hits"][0]["document_id"])
    assert one["segment_count"] == 1 and one["related_count"] == 2
    assert store.get_document(one["document_id"], section="B01D10/00")["segment_count"] == 1
    assert store.search_all("手引きの")["hits"][0]["content_type"] == "document"
    for code, ask in {
        "DOCUMENT_NOT_FOUND": lambda: store.get_document("doc-none"), "INVALID_DOCUMENT_ID": lambda: store.get_document("x/y"), "INVALID_PAGE": lambda: store.get_document("doc-1", page=0),
        "INVALID_SECTION": lambda: store.get_document("doc-1", section=" "), "INVALID_DOCUMENT_SELECTOR": lambda: store.get_document("doc-1", 1, "x"),
        "INVALID_VERSION": lambda: store.lookup("fi", "A", version="2006.01"), "INVALID_RELATION_LIMIT": lambda: store.lookup("fi", "A", relation_limit=201),
        "INVALID_RELATION_OFFSET": lambda: store.lookup("fi", "A", relation_offset=-1), "INVALID_CONTENT_TYPE": lambda: store.search_all("x", content_types=["page"]),
        "INVALID_HIERARCHY_DIRECTION": lambda: store.hierarchy("down", "fi", "A"), "RESPONSE_TOO_LARGE": lambda: __import__("kasane.api").api._bounded({"x": "y" * (4 << 20)}),
    }.items():
        with pytest.raises(QueryError) as bad:
            ask()
        assert bad.value.code == code
    assert [h["content_type"] for h in store.search_all("題", content_types=["classification"])["hits"]] == ["classification"] * 4
    with pytest.raises(QueryError):
        store.search("\x00")


def test_hierarchy(store):
    kids = store.children("fi", "B01D10/00", limit=1)
    assert kids["total"] == 2 and kids["truncated"] and kids["next_offset"] == 1
    assert [p["normalized_code"] for p in store.parents("fi", "B01D10/02")] == ["B01D10/00"]
    assert store.children("fi", "none") == [] and len(store.children("fi", "B01D10/00")) == 2
    assert store.release_info()["reference_date"] == "2026-01-01"
    assert store.groups().where("group_key = 'B01D10'").count() > 0


def test_cli(spark, store_path, capsys):
    assert cli.main(["lookup", store_path, "fi", "B01D10/00"]) == 0
    assert json.loads(capsys.readouterr().out)["match_status"] == "exact"
    assert cli.main(["lookup", store_path, "fi", "nope"]) == 1
    assert cli.main(["validate", store_path]) == 0
    capsys.readouterr()
    assert cli.main(["children", store_path, "fi", "B01D10/00"]) == 0 and len(json.loads(capsys.readouterr().out)) == 2
    assert cli.main(["doctor", store_path]) == 0 and cli.main(["doctor", store_path + "x"]) == 1


def test_export(spark, store, tmp_path):
    from kasane.sources import export

    import yaml

    a, b, policy = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "policy.yaml")
    flags = {k: True for k in export.MUST} | {k: False for k in export.MUST_NOT}
    said = {"release_id": "JPPM2026001", "sources": [{"flags": flags, "notices": {"ja": "x", "en": "y"}, "attribution": "Made-up notice for tests."}]}
    for change in ({"attribution": "another"}, {"flags": flags | {export.MUST[0]: False}}):
        with open(policy, "w") as f:
            yaml.safe_dump(said | {"sources": [said["sources"][0] | change]}, f)
        with pytest.raises(export.ExportError):
            export.export(store, a, policy)
        assert not os.path.exists(a)
    with open(policy, "w") as f:
        yaml.safe_dump(said, f)
    manifest = export.export(store, a, policy)
    hand = store.t["document"].where("kind = 'fi_handbook'").first().document_id
    assert json.loads((tmp_path / "a" / "documents" / f"{hand}.json").read_text())["segments"][0]["text"] == "手引きの本文"
    assert "<sitemapindex" in (tmp_path / "a" / "sitemap.xml").read_text()
    assert manifest["canonical_concepts"] == manifest["exported_records"] > 0
    assert export.export(store, b, policy)["tree_sha256"] == manifest["tree_sha256"]
    assert export.audit(spark, a, b)["equal"] and export.validate(spark, a)["valid"]
    record = export.find_object(spark, a, "ipc", "8U", "B01D 10/00")
    assert [r["version"] for r in record["revisions"]] == ["2006.01", "2016.01"]
    assert export.find_object(spark, a, "fi", "", "B99Z1/00") is None
    page = next(p for p in (tmp_path / "a" / "site").rglob("*.html"))
    page.write_text(page.read_text() + "<script>")
    (tmp_path / "a" / "site" / "more.exe").write_text("x")
    assert {"digest", "size", "active", "extra", "suffix"} <= set(export.validate(spark, a)["issues"])
    with pytest.raises(FileExistsError):
        export.export(store, b, policy)
    with pytest.raises(export.ExportError):
        export.export(store, str(tmp_path / "c"), policy, "https://x/y")
    with pytest.raises(export.ExportError):
        export.write_objects(spark.createDataFrame([("../x", "y")], "key string, content string"), a)


def test_policy(tmp_path):
    import yaml

    from kasane.sources import export

    good = {"release_id": "R", "sources": [{"flags": {k: True for k in export.MUST} | {k: False for k in export.MUST_NOT}, "notices": {"ja": "x", "en": "y"}}]}
    path = tmp_path / "p.yaml"
    path.write_text(yaml.safe_dump(good))
    assert export.load_policy(str(path), "R")["release_id"] == "R"
    good["sources"][0]["flags"]["embargoed"] = True
    path.write_text(yaml.safe_dump(good))
    with pytest.raises(export.ExportError):
        export.load_policy(str(path), "R")


def test_stack_parent_at_any_level(spark):
    from kasane.operators.temporal import stack_parent

    rows = [(1, k, v, 10 + k) for k, v in enumerate([5, 70, 71, None, 70, -2, -1, -2, 1000])] + [(2, 0, 3, 50), (None, 1, 4, 60), (None, 2, 5, 61)]
    df = spark.createDataFrame(rows, "part long, n int, level int, id long").withColumnRenamed("part", "f")
    got = {r.id: r.parent for r in stack_parent(df, ["f"], ["n"], "level", "id").collect()}
    assert got == {10: None, 11: 10, 12: 11, 13: None, 14: 10, 15: None, 16: 15, 17: None, 18: 17, 50: None, 60: None, 61: 60}
    assert stack_parent(df.limit(0), ["f"], ["n"], "level", "id").count() == 0


def test_queries_without_an_optional_package(tmp_path):
    """The core queries load where a package of the text operators is missing."""
    import subprocess
    import sys

    code = "import sys; sys.modules['tiktoken'] = None; sys.modules['kasane.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p7_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_no_local_scratch_on_a_cluster():
    from kasane import runtime

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session)
