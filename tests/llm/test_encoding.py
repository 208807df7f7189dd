import json

import pytest

from kasane.llm import encoding

SCHEMA = "file_id long, record_number long, payload_json string, encoding string"
CLEAN = ["濾過器の駆動軸を冷却する。", "「導光板」とは、鋼線を充填したポンプ室をいう。", "乾燥の前に樹脂を処理し、34秒に保つ。", "切刃", "Means for cooling at 20 °C, café-type", "ﾊﾟﾈﾙと①を含む。"]
WAYS = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "latin-1"), ("cp932", "cp1252"), ("euc_jp", "cp932"), ("utf-8", "cp932")]


def garble(text, right, wrong):
    return encoding.reader(wrong).read(text.encode(right))


def payload(i, text):
    return json.dumps({"code": f"A01B{i}/00", "text": text, "n": i}, ensure_ascii=False)


def corpus():
    """Every text in six files; some files read wrongly."""
    rows, bad = [], set()
    for copy in range(12):
        for i in range(40):
            text = CLEAN[i % 4] + CLEAN[(i * 7) % 3] if i % 5 else CLEAN[i // 5 % 6]
            if copy % 4 == 3 and i % 3 == 0:
                right, wrong = WAYS[(i // 3 + copy) % len(WAYS)]
                try:
                    made = garble(text, right, wrong)
                except UnicodeEncodeError:
                    made = text
                if made != text:
                    bad.add((copy, i))
                    text = made
            rows.append((copy, i, payload(i, text), "clash"))
    return rows, bad


def test_planted(spark):
    rows, bad = corpus()
    made = encoding.Garbled(spark.createDataFrame(rows, SCHEMA))
    got = {(r.file_id, r.record_number) for r in made.rows().collect()}
    assert got == bad
    original = {i: json.loads(p)["text"] for c, i, p, _ in rows if c == 0}
    wrong = [r for r in made.values().collect() if r.restored is not None and r.restored != original[r.record_number]]
    assert not wrong


def test_no_payload_and_empty(spark):
    assert encoding.garbled_rows(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = [(1, 1, None, None), (1, 2, "no json", None), (1, 3, "[]", None), (1, 4, '{"a":null,"b":""}', None), (1, 5, '{"a":"abc"}', None)]
    assert encoding.garbled_rows(spark.createDataFrame(odd, SCHEMA)).count() == 0


@pytest.mark.parametrize("right,wrong", WAYS)
def test_alignment_names_the_reading(right, wrong):
    clean = "A47J1/00 の濾過器の駆動軸を冷却し 12 mm に保つ"
    data = clean.encode(right)
    if encoding.reader(wrong).single or right == "utf-8":
        made = encoding.reader(wrong).read(data)
        found = encoding.explain(clean, made)
        assert found is not None and encoding.reader(found[1]).read(clean.encode(found[0])) == made


def test_escapes():
    assert encoding.unescape("\\u6fc3x") == "濃x" and encoding.unescape("plain") == "plain"


@pytest.mark.parametrize("right,wrong", [("utf-8", "cp850"), ("cp932", "cp866"), ("iso2022_jp", "latin-1"), ("utf-16-le", "latin-1"), ("euc_jp", "mac_cyrillic")])
def test_any_reading_of_the_runtime(spark, right, wrong):
    """Readings no list names are learned from twins and undone, seven-bit text without its escapes too."""
    rows, bad = [], {}
    for copy in range(6):
        for i in range(20):
            text = CLEAN[i % 3] + CLEAN[(i * 7) % 3]
            if copy == 5 and i % 2:
                made = encoding.reader(wrong).read(text.encode(right))
                bad[copy, i], text = text, made.replace("\x1b", "") if i % 4 == 1 else made
            rows.append((copy, i, payload(i, text), "clash"))
    made = encoding.Garbled(spark.createDataFrame(rows, SCHEMA))
    got = {(r.file_id, r.record_number): r.restored for r in made.values().collect()}
    assert set(got) == set(bad) and sum(got[k] == bad[k] for k in bad) >= 0.9 * len(bad)


def test_unknown_table_is_learned(spark):
    """A codec the runtime does not have: its byte table is learned from aligned characters."""
    table = {b: chr(0x2500 + (b * 37) % 128) for b in range(128, 256)}
    rows, bad = [], {}
    for copy in range(6):
        for i in range(40):
            text = CLEAN[i % 3] + CLEAN[(i * 7) % 3] + CLEAN[(i // 3) % 3]
            if copy == 5 and i % 2:
                bad[copy, i], text = text, "".join(table.get(b, chr(b)) for b in text.encode("utf-8"))
            rows.append((copy, i, payload(i, text), "clash"))
    made = encoding.Garbled(spark.createDataFrame(rows, SCHEMA))
    got = {(r.file_id, r.record_number): r.restored for r in made.values().collect()}
    assert set(got) == set(bad) and sum(got[k] == bad[k] for k in bad) >= 0.9 * len(bad)
