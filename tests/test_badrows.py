import datetime
import re

from kasane.operators import badrows
from kasane.plans import core
from kasane.runtime import table

COUNTS = {"fi/fi": 5, "fi/fi_text": 7, "fi/fi_hb": 5, "ipc/ipc8u_text": 11, "concordance": 4, "fterm/fterm": -5, "fi/fi_kaisei_link": -2}


def split(line):
    """Character-wise reading of one row; None for broken quoting."""
    cells, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            cell, i = line[i:j], j
            if '"' in cell:
                return None
        cells.append(cell)
        if i >= len(line):
            return cells
        i += 1


def reason(group, line):
    line = (line or "").removeprefix("﻿")
    line = line.removesuffix("\r")
    cells = split(line)
    if cells is None:
        return "quoting"
    n = COUNTS.get(group)
    if n is None:
        return None
    if (len(cells) < -n) if n < 0 else (len(cells) != n):
        return "column_count"
    c = [x.strip() for x in cells]
    pos = lambda *at: all(re.fullmatch("[0-9]+", c[i]) and int(c[i]) > 0 for i in at)
    nat = lambda *at: all(re.fullmatch("[0-9]+", c[i]) for i in at)

    def day(x):
        try:
            return datetime.datetime.strptime(x, "%Y%m%d") if re.fullmatch("[0-9]{8}", x) else None
        except ValueError:
            return None

    ok = all(c[i] for i in ((1, 3) if group == "concordance" else (0,)))
    if group == "fi/fi":
        ok = ok and pos(1) and nat(4)
    elif group == "fi/fi_text":
        ok = ok and pos(1, 2)
    elif group == "fi/fi_hb":
        ok = ok and pos(1)
    elif group == "fterm/fterm":
        ok = ok and pos(1) and nat(2)
    elif group == "concordance":
        ok = ok and c[0] in set("145678") and c[2] in set("145678")
    elif group == "ipc/ipc8u_text":
        m = re.fullmatch(r"\(([0-9]{4})\.([0-9]{2})\)", c[1])
        a, b = day(c[7]), day(c[8])
        ok = ok and bool(m) and 1 <= int(m[2]) <= 12 and pos(2, 3) and nat(4) and bool(a and b and a <= b)
    return None if ok else "value"


def test_same_as_character_reader(spark, sf_dir, duck):
    want = {
        (f, n): reason(g.lower().strip(), line)
        for f, n, g, line in duck.execute(
            "SELECT file_id, line_number, data_group, raw_line FROM raw_record JOIN source_file USING (file_id) WHERE parser = 'python-csv'"
        ).fetchall()
    }
    good, bad = badrows.split_rows(table(spark, sf_dir, "raw_record"), table(spark, sf_dir, "source_file"))
    got = {(r.file_id, r.line_number): r.reason for r in bad.collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert good.count() == sum(v is None for v in want.values())


def rows(spark, lines, group="FI/FI"):
    raw = spark.createDataFrame([(1, i, x, "clash") for i, x in enumerate(lines)], "file_id long, line_number long, raw_line string, status string")
    files = spark.createDataFrame([(1, group, "python-csv", "failed")], "file_id long, data_group string, parser string, status string")
    return badrows.check_rows(raw, files)


def test_awkward_lines(spark):
    lines = [
        "A,1,,x,0", "﻿A,1,,x,0\r", '"A,""q""\nB",1,,,2', '"A"x,1,,,2', 'A",1,,,2', "", None, ",1,,,0", "A,0,,,0", "A,１,,,0",
        "A, 1 ,,, 0 ", "A,1,,,", "A,1,,0", "," * 4, 'A,1,,"' + 'y""' * 50000 + '",3', "A,1," + "z" * 500000 + ",,3",
    ]
    got = {r.line_number: r.errors[:1] for r in rows(spark, lines).collect()}
    want = {i: ([x] if (x := reason("fi/fi", line)) else []) for i, line in enumerate(lines)}
    assert got == want


def test_empty_and_unknown_group(spark):
    assert rows(spark, []).count() == 0
    assert [r.errors for r in rows(spark, ["a,b", '"a'], "NEW/GROUP").orderBy("line_number").collect()] == [[], ["quoting"]]
    assert rows(spark, ["a,b"], None).first().data_group == ""


def test_repeated_rows_are_kept(spark):
    raw = spark.createDataFrame([(1, 1, '"a'), (1, 1, '"a')], "file_id long, line_number long, raw_line string")
    files = spark.createDataFrame([(1, "FI/FI", " Python-CSV ")], "file_id long, data_group string, parser string")
    _, bad = badrows.split_rows(raw, files)
    assert bad.count() == 2


def test_loaded_query_returns_the_cells(spark, sf_dir, duck):
    want = {
        (f, n): split((line or "").removeprefix("﻿").removesuffix("\r"))
        for f, n, g, line in duck.execute(
            "SELECT file_id, line_number, data_group, raw_line FROM raw_record JOIN source_file USING (file_id) WHERE parser = 'python-csv'"
        ).fetchall()
        if reason(g.lower().strip(), line) is None
    }
    got = {(r.file_id, r.line_number): r.cells for r in core.QUERIES["p6_loaded"](spark, sf_dir).collect()}
    assert got == want
