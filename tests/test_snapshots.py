import random

from kasane.operators import history, snapshots

COLS = "release string, k string, v string, at timestamp, change string, __d string"
REC = "release_id string, scheme string, edition string, normalized_code string, record_status string, version string, valid_from string, valid_to string, labels array<struct<kind:string,language:string,text:string>>, relations array<struct<type:string,scheme:string,code:string,edition:string>>, loaded_at timestamp, change string"


def states(seed, keys=300, releases=5):
    rnd, out = random.Random(seed), {}
    for r in range(releases):
        out[r] = {}
        for k in range(keys):
            prev = out.get(r - 1, {}).get(k)
            if rnd.random() < 0.05:
                continue
            out[r][k] = str(rnd.randint(0, 3)) if prev is None or rnd.random() < 0.1 else prev
    return out


def diff(out):
    want = set()
    for r in list(out)[1:]:
        a, b = out[r - 1], out[r]
        want |= {(f"r{r}", f"k{k}", "added") for k in b.keys() - a.keys()} | {(f"r{r}", f"k{k}", "removed") for k in a.keys() - b.keys()}
        want |= {(f"r{r}", f"k{k}", "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return want


def test_changes_equal_brute_force(spark):
    from pyspark.sql import functions as F

    out = states(1)
    rows = [(f"r{r}", f"k{k}", v, None, "x", "x") for r, s in out.items() for k, v in s.items()] + [(None, "k1", "9", None, None, None)]
    df = spark.createDataFrame(rows, COLS).withColumn("digest", F.xxhash64("v"))
    for how in ({}, {"mean_chunk": 1}, {"mean_chunk": 7, "buckets": 1}, {"mean_chunk": 1000, "buckets": 3}):
        got = {tuple(r) for r in snapshots.snapshot_changes(df, "release", ["k"], "digest", "at", **how).collect()}
        assert got == diff(out)


def record(release, code, at=1, **kw):
    import datetime

    base = dict(scheme="fi", edition=None, status="canonical", version=None, f=None, t=None, labels=[("label", "ja", "x")], relations=[])
    base.update(kw)
    return (release, base["scheme"], base["edition"], code, base["status"], base["version"], base["f"], base["t"], base["labels"], base["relations"], datetime.datetime(2024, 1, at), "clash")


def test_spellings_are_no_changes(spark):
    a = [("label", "ja", "x"), ("label", "en", None)]
    rows = [
        record("R1", "a01b 1/00", edition="", version="(2020.01)", f="20200101", t="9999-12-31", labels=a), record("R1", "A01B1/00", at=2, version="2020.01", f="2020-01-01", labels=a[::-1] + a[:1]),
        record("R2", "A01B　1/00", version="2020.01", f="2020-01-01", t="", labels=[a[1], a[0]]), record("R2", "B1", labels=None), record("R3", "A01B1/00", version="2020.01", f="2020-01-01", labels=[("label", "en", ""), a[0]]),
        record("R3", "B1", labels=[]), record("R3", None),
    ]
    got = {tuple(r) for r in snapshots.record_changes(spark.createDataFrame(rows, REC)).collect()}
    assert got == {("R2", "fi", "", "B1", "added"), ("R3", "fi", "", "", "added")}


def test_latest_load_counts(spark):
    rows = [record("R1", "A", at=5, version="1"), record("R1", "A", at=3, version="2"), record("R2", "A", at=1, version="2"), record("R2", "A", at=4, version="1")]
    assert snapshots.record_changes(spark.createDataFrame(rows, REC)).count() == 0


def test_history_equals_brute_force(spark):
    out = states(2, keys=120, releases=8)
    rows = [(f"r{r}", f"k{k}", v, None, "x", "x") for r, s in out.items() for k, v in s.items()]
    df = spark.createDataFrame(rows, COLS).withColumnRenamed("v", "attr")
    want = set()
    for k in range(120):
        open_at = None
        for r in range(9):
            v = out.get(r, {}).get(k)
            if open_at is not None and v != open_at[1]:
                want.add((f"k{k}", open_at[1], f"r{open_at[0]}", f"r{r - 1}"))
                open_at = None
            if v is not None and open_at is None:
                open_at = (r, v)
    for every in (1, 2, 8):
        got = {tuple(r) for r in history.validity_periods(df, "release", ["k"], ["attr"], "at", every=every).collect()}
        assert got == want


def test_log_and_state(spark):
    rows = [record("R1", "A", version="1"), record("R2", "A", version="2"), record("R3", "B"), record("R4", "A", version="2", t="99991231")]
    df = spark.createDataFrame(rows, REC)
    log = [(r.normalized_code, r.release_id, r.entry, r.set_version) for r in history.record_log(df).orderBy("normalized_code", "release_id").collect()]
    assert log == [("A", "R1", "full", "1"), ("A", "R2", "patch", "2"), ("A", "R3", "gone", None), ("A", "R4", "full", "2"), ("B", "R3", "full", ""), ("B", "R4", "gone", None)]
    assert [r.version for r in history.state_at(df, "R2").collect()] == ["2"]
    assert history.record_history(df, 2).count() == 3


def test_empty(spark):
    none = spark.createDataFrame([], REC)
    assert snapshots.record_changes(none).count() == 0 and history.record_history(none).count() == 0
