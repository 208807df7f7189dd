import datetime
import hashlib
import sqlite3
import urllib.parse

import pytest
from pyspark.sql import functions as F

from kasane.errors import QueryError
from kasane.functions import text as tx
from kasane.operators import edges, publish, quality, search, temporal
from kasane.plans import reference

AWKWARD = ["a01b 1/00", "Ａ01Ｂ　1/00", "\x1c\x85x y", "", None, "ß/ıé", "a+b*c~d_e.f-g h", "​z"]


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_text_functions(spark):
    assert column(spark, AWKWARD, tx.norm_code) == [None if v is None else "".join(v.split()).upper() for v in AWKWARD]
    assert column(spark, AWKWARD, tx.strip_white) == [None if v is None else v.strip() for v in AWKWARD]
    assert column(spark, AWKWARD, tx.path_segment) == [None if v is None else urllib.parse.quote(v, safe="-._~") for v in AWKWARD]
    assert column(spark, ["a.b_c d", "é"], tx.fragment_id) == ["a_2Eb_5Fc_20d", "_C3_A9"]
    assert column(spark, ["\r\n a\rb\n "], tx.norm_text) == ["a\nb"]
    assert column(spark, ["(2006.01)", "2006.01", "(2006.01", "x", "", None, " "], tx.version_indicator) == ["2006.01", "2006.01", None, None, "", "", ""]
    assert column(spark, ["20260101", "2026-01-01", "2026-1-1", "20261301", "", None, "99991231"], tx.iso_date) == [
        datetime.date(2026, 1, 1), datetime.date(2026, 1, 1), None, None, None, None, datetime.date(9999, 12, 31)]
    assert column(spark, [" 12 ", "-3", "1.0", "", None, "１"], tx.to_int) == [12, -3, None, None, None, None]
    assert column(spark, ["20200101", "2020-1-1", "2020/01/01", "", None, "soon"], tx.date_key) == ["20200101"] * 3 + ["", "", "soon"]
    assert column(spark, ["9999-12-31", "99991231", None, ""], tx.end_key) == [""] * 4
    assert column(spark, ["A01B_1-00", "a01b1-02-"], tx.file_code) == ["A01B1/00", "A01B1/02"]
    assert column(spark, ["École"], tx.ascii_fold) == ["École".replace("É", "É").translate({i: i + 32 for i in range(65, 91)})]
    path, sha = "a/b", "00ff"
    want = "src-" + hashlib.sha256(path.encode() + b"\0" + sha.upper().encode()).hexdigest()[:24]
    assert column(spark, [path], lambda c: tx.source_id(c, F.lit(sha))) == [want]
    long = "x" * 300 + "Needle" + "y" * 300
    assert column(spark, [long, "needle"], lambda c: tx.excerpt(c, "needle")) == ["… " + long[220:460] + " …", "needle"]


def test_ranked_search_equals_fts5(spark):
    texts = ["The sensor SENSOR array", "no match here", "sensors and polymers in a sensor", "École polymer sensor", "", None, "sensor polymer " * 40, "ab"]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram tokenizer")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i, t or "") for i, t in enumerate(texts)])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    for query in ("sensor", "sensor polymer", "école"):
        want = con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", [" AND ".join(f'"{q}"' for q in query.split())]).fetchall()
        got = search.hits(df, "text", query).select("id", "rank").collect()
        assert {r.id for r in got} == {i for i, _ in want}
        assert all(abs(r.rank - dict(want)[r.id]) < 1e-9 for r in got)
    assert [r.id for r in search.hits(df, "text", "AB").where("search_mode = 'literal'").select("id", "search_mode").collect()] == [7]
    assert search.hits(df, "text", "éc").count() == 0 or search.mode_of(["éc"]) == "literal"
    postings = search.trigrams(df, "id", "text")
    assert search.posting_parity(postings, df, "id", "text").count() == 0
    assert search.posting_parity(postings.where("gram <> 'sen'"), df, "id", "text").select("side").distinct().collect()[0].side == "missing"
    for bad in ("", "x" * 501, "a\x00"):
        with pytest.raises(QueryError):
            search.clean_query(bad)


def test_stack_islands_writers(spark):
    rows = spark.createDataFrame([("f", i, lv) for i, lv in enumerate([1, 2, 3, 3, None, 2, 1, 5, 4])], "f string, id int, level int")
    got = {r.id: r.parent for r in temporal.stack_parent(rows, ["f"], ["id"], "level", "id").collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 1, 4: None, 5: 0, 6: None, 7: 6, 8: 6}
    runs = spark.createDataFrame([("u", i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "u string, i int, v string")
    assert [r.island for r in temporal.island_ids(runs, ["u"], ["i"], "v").orderBy("i").collect()] == [1, 1, 2, 2, 3]
    w = spark.createDataFrame([("k", 2, "ref", "x"), ("k", 1, "ref", "y"), ("k", 3, "canonical", "z"), (None, 1, "ref", None)], "k string, o int, s string, v string")
    assert {tuple(r) for r in temporal.first_writer(w, ["k"], ["o"], F.col("s") == "canonical").collect()} == {("k", 3, "canonical", "z"), (None, 1, "ref", None)}
    assert temporal.conflicts(w.where("k is not null"), ["k"], ["o"], ["v"]).count() == 2


def test_pack_and_index(spark):
    sizes = [5, 5, 11, 1, None, 9, 1]
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)] + [(None, 0, 3)], "g string, i int, n int")
    got = {(r.g, r.i): r.chunk for r in publish.pack(rows, "g", ["i"], "n", 10).collect()}
    assert [got["g", i] for i in range(7)] == [1, 1, 2, 3, 3, 3, 4] and got[None, 0] == 1
    many = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert {(r.x, r.n) for r in publish.global_index(many, ["x"]).collect()} == {(i, i + 1) for i in range(1000)}
    urls = spark.createDataFrame([("u1",), ("u2",), ("u1",), (None,)], "url string")
    assert [tuple(r) for r in publish.sitemap(urls, shard=1).orderBy("shard").collect()] == [(0, 1, "u1", "u1"), (1, 1, "u2", "u2")]
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert publish.table_digest(a, ["k", "v"]).first() == publish.table_digest(a.orderBy(F.desc("k")).repartition(3), ["v", "k"]).first()
    assert publish.table_digest(a, ["k", "v"]).first().digest != publish.table_digest(a.na.fill(""), ["k", "v"]).first().digest


def test_quality_and_pages(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert {tuple(r) for r in quality.parity(a, b, ["k"], ["v"]).collect()} == {(2, "differs"), (3, "missing"), (4, "extra")}
    assert quality.symmetric_difference(a, b).count() == 4
    kids = spark.createDataFrame([("p", i) for i in range(805)], "p string, c int")
    page = edges.with_totals(kids, ["p"], ["c"], 200, 800).collect()
    assert len(page) == 5 and page[0].total == 805 and page[0].next_offset is None and page[0].truncated
    assert edges.page(kids, ["c"], 2, 3).collect()[0].c == 3


def test_stack_parent_query_has_no_level_bound(spark, tmp_path):
    rows = [(i, 1, i, level) for i, level in enumerate([-3, 40, 41, 90, 41, 41, 12])]
    spark.createDataFrame(rows, "revision_id long, source_file_id long, sequence_number int, level int").write.parquet(f"{tmp_path}/concept_revision.parquet")
    got = {r.revision_id: r.parent for r in reference.QUERIES["stack_parent"](spark, str(tmp_path)).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 0}
