import collections
import json
import re

import numpy as np
import pandas as pd

from kasane.operators import drift
from kasane.runtime import table

SOURCE = "file_id long, release_id string, relative_path string, data_group string, parser string"
RECORD = "file_id long, record_number long, payload_json string, extra string"
KINDS = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}


def brute(files, records):
    """Field by field comparison of neighbouring files in plain Python."""
    series, rows = collections.defaultdict(list), collections.defaultdict(list)
    for f, _, payload in records:
        rows[f].append(json.loads(payload))
    for f, release, path, group in files:
        if f in rows:
            stem = re.sub(r"[_-]?(\d{8}|\d{4}[-_]\d{2}([-_]\d{2})?)\.\w+$", "", path.lower().split("/")[-1])
            series[group.lower().strip(), stem].append((release, f))

    def codes(r):
        return " ".join(sorted(c for v in r.values() if isinstance(v, str) and re.match(drift.CODE, c := "".join(v.split()).upper())))

    out = set()
    for chain in series.values():
        chain.sort()
        for (_, a), (_, b) in zip(chain, chain[1:]):
            ta = {k: KINDS[type(v)] for r in rows[a] for k, v in r.items() if v is not None}
            tb = {k: KINDS[type(v)] for r in rows[b] for k, v in r.items() if v is not None}
            gone, new = set(ta) - set(tb), set(tb) - set(ta)
            for g in sorted(gone):
                for n in sorted(new):
                    seen = collections.defaultdict(set)
                    for r in rows[a]:
                        if r.get(g) is not None:
                            seen[codes(r)].add(json.dumps(r[g]))
                    hits = [json.dumps(r[n]) in seen[codes(r)] for r in rows[b] if r.get(n) is not None and codes(r) in seen]
                    if hits and sum(hits) > 0.5 * len(hits) and g in gone and n in new:
                        gone.discard(g), new.discard(n), out.add((b, "renamed", g, n))
            out |= {(b, "removed", g, "") for g in gone} | {(b, "added", "", n) for n in new}
            out |= {(b, "retyped", k, k) for k in ta if k in tb and ta[k] != tb[k]}
    return out


def test_same_as_brute_force(spark, sf_dir, duck):
    files = duck.execute("SELECT file_id, release_id, relative_path, data_group FROM source_file").fetchall()
    records = duck.execute("SELECT file_id, record_number, payload_json FROM source_record").fetchall()
    got = drift.field_changes(table(spark, sf_dir, "source_record"), table(spark, sf_dir, "source_file"))
    assert {tuple(r) for r in got.collect()} == brute(files, records)


def two_files(spark, first, second):
    files = spark.createDataFrame(
        [(1, "R1", "FI/X/x_A_000001_20230101.csv", "FI/X", "p"), (2, "R2", "FI/X/X_A_000001_2023-04.CSV", "fi/x", "p")], SOURCE
    )
    data = [(f, i, p, "clash") for f, rows in ((1, first), (2, second)) for i, p in enumerate(rows)]
    return drift.Drift(spark.createDataFrame(data, RECORD), files)


def test_rename_retype_and_null_fields(spark):
    a = [json.dumps({"code": f"A01B{i}/00", "label": f"t{i}", "n": i, "gone": None}) for i in range(1, 9)]
    b = [json.dumps({"class": f"A01B{i}/00", "見出し": f"t{i}" if i > 2 else "damaged", "n": [i], "x": True}) for i in range(1, 9)]
    made = two_files(spark, a + [None, "no json", "[1]", "{}"], b + [b[0]])
    assert {tuple(r) for r in made.changes().collect()} == {
        (2, "renamed", "code", "class"), (2, "renamed", "label", "見出し"), (2, "retyped", "n", "n"), (2, "added", "", "x"),
    }
    unified = {(r.file_id, r.record_number): r.row_json and json.loads(r.row_json) for r in made.unified().collect()}
    assert unified[2, 4] == {"code": "A01B5/00", "label": "t5", "n": 5, "x": True}
    assert unified[1, 8] is None and len(unified) == 21


def test_arrays_and_objects_stay_whole(spark):
    a = [json.dumps({"code": f"A01B{i}/00", "t": "x y z"}) for i in range(1, 4)]
    kept = [["x", "y", "z"], ["x y", "z"], [1, 2], [], [None], ["x", None], [["x", "y"]], ["x"], {"value": "x"}, {"n": 3, "value": "x y"}, {"n": 4, "value": "x y"}, {"value": "x", "unit": "mm"}, {"value": None}]
    b = [json.dumps({"code": f"A01B{i}/00", "t": v}) for i, v in enumerate(kept, 1)]
    got = {(r.file_id, r.record_number): json.loads(r.row_json)["t"] for r in two_files(spark, a, b).unified().collect()}
    assert [got[2, i] for i in range(len(kept))] == [
        "x y z", '["x y","z"]', "[1,2]", "[]", "[null]", '["x",null]', '["x","y"]', "x", "x", "x y", '{"n":4,"value":"x y"}', '{"unit":"mm","value":"x"}', '{"value":null}',
    ]


def test_no_element_is_lost(spark, sf_dir, duck):
    """Every text element of the table is in the unified table, a row's elements in its row."""
    made = drift.unified_rows(table(spark, sf_dir, "source_record"), table(spark, sf_dir, "source_file")).collect()
    unified = {(r.file_id, r.record_number): set(json.loads(r.row_json).values()) for r in made if r.row_json}
    for f, n, payload in duck.execute("SELECT file_id, record_number, payload_json FROM source_record").fetchall():
        for v in json.loads(payload).values():
            if isinstance(v, list):
                assert " ".join(v) in unified[f, n]
            elif isinstance(v, dict):
                assert v["value"] in unified[f, n] if v["n"] == len(v["value"]) else v in [json.loads(x) for x in unified[f, n] if isinstance(x, str) and x[:1] == "{"]


def test_empty(spark):
    empty = spark.createDataFrame([], RECORD), spark.createDataFrame([], SOURCE)
    assert drift.field_changes(*empty).count() == 0
    assert drift.unified_rows(*empty).count() == 0


def test_flooding_prefers_agreeing_values():
    score = drift.flood(
        [("a", "string", "STRING"), ("b", "string", "STRING")], [("c", "string", "STRING"), ("d", "string", "STRING")], np.array([[0.0, 0.9], [0.95, 0.1]])
    )
    assert score[0, 1] > score[0, 0] and score[1, 0] > score[1, 1]


def test_a_name_that_comes_back(spark):
    """a, then b for a, then both: the second a is a field of its own."""
    files = spark.createDataFrame([(k, f"R{k}", f"FI/X/x_A_2023010{k}.csv", "FI/X", "p") for k in (1, 2, 3, 4)], SOURCE)
    rows = []
    for i in range(8):
        code = f"A01B{i}/00"
        rows += [(1, i, {"code": code, "a": f"t{i}"}), (2, i, {"code": code, "b": f"t{i}"}), (3, i, {"code": code, "a": i, "b": f"t{i}"}), (4, i, {"code": code, "a": str(i), "b": f"t{i}"})]
    made = drift.Drift(spark.createDataFrame([(f, n, json.dumps(p), "clash") for f, n, p in rows], RECORD), files)
    assert {tuple(r) for r in made.changes().collect()} == {(2, "renamed", "a", "b"), (3, "added", "", "a"), (4, "retyped", "a", "a")}
    got = {(r.file_id, r.record_number): json.loads(r.row_json) for r in made.unified().collect()}
    assert got[2, 5] == {"code": "A01B5/00", "a": "t5"}
    assert got[3, 5] == got[4, 5] == {"code": "A01B5/00", "a": "t5", "a_2": 5}
    assert {(r.field, r.type) for r in made.schema().collect()} == {("code", "string"), ("a", "string"), ("a_2", "number")}


def test_flooded_scores_decide(spark, monkeypatch):
    a = [json.dumps({"code": f"A01B{i}/00", "label": f"t{i}"}) for i in range(8)]
    b = [json.dumps({"code": f"A01B{i}/00", "text": f"t{i}"}) for i in range(8)]
    frame = {"prev": [("code", "string", "STRING"), ("label", "string", "STRING")], "cur": [("code", "string", "STRING"), ("text", "string", "STRING")]}
    prev, cur = (pd.DataFrame(frame[k], columns=["field", "type", "shape"]) for k in ("prev", "cur"))
    assert drift._match(prev, cur, {("label", "text"): 1.0}) == [("label", "text")]
    monkeypatch.setattr(drift, "flood", lambda x, y, share: np.zeros((len(x), len(y))))
    assert drift._match(prev, cur, {("label", "text"): 1.0}) == []


def test_neighbours_carry_scores():
    """Values alone leave a tie; the nested members of the fields decide it."""
    before = [("p", "object", "OBJECT<unit: STRING, size: BIGINT>")]
    after = [("q", "object", "OBJECT<unit: STRING, size: BIGINT>"), ("r", "object", "OBJECT<left: STRING>")]
    score = drift.flood(before, after, np.array([[0.5, 0.5]]))
    assert score[0, 0] > score[0, 1] + 0.02
    assert drift.members("OBJECT<a: ARRAY<OBJECT<b: STRING>>, c: BIGINT>") == [(".a", "ARRAY"), (".a[]", "OBJECT"), (".a[].b", "STRING"), (".c", "BIGINT")]
