"""Rows that fail to parse: load as text, test with column rules, split by empty error arrays.

A row is cut into cells by one possessive regular expression, every cell stays
nullable text, and a layout's rules become one array expression that holds the
name of each rule the row breaks. No Python runs and nothing is shuffled but
the small file table (joined by size); a row's verdict depends on the row alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasane.functions.text import strip_white

_CELL = r'(?:"(?:[^"]++|"")*+"|[^",][^",]*+|)'
_LINE = rf"^{_CELL}(?:,{_CELL})*+$"


def cut(line: Column) -> Column:
    """Cells of a well-quoted row as an array of text (quotes removed, inner ones undoubled)."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f",({_CELL})"), F.lit(1))
    bare = lambda c: F.when(
        c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(c)
    return F.transform(raw, bare)


def clean_line(line: Column) -> Column:
    """Without a byte-order mark at the start and a carriage return at the end."""
    return F.regexp_replace(line, "^﻿|\r$", "")


def _cell(cells: Column, i: int) -> Column:
    return F.coalesce(strip_white(F.get(cells, F.lit(i))), F.lit(""))


def filled(*at: int) -> Callable[[Column], Column]:
    return lambda cells: _every([_cell(cells, i) != "" for i in at])


def positive(*at: int) -> Callable[[Column], Column]:
    return lambda cells: _every([_cell(cells, i).rlike(r"^0*[1-9][0-9]*$") for i in at])


def natural(*at: int) -> Callable[[Column], Column]:
    return lambda cells: _every([_cell(cells, i).rlike(r"^[0-9]+$") for i in at])


def one_of(values: tuple[str, ...], *at: int) -> Callable[[Column], Column]:
    return lambda cells: _every([_cell(cells, i).isin(*values) for i in at])


def month(at: int) -> Callable[[Column], Column]:
    return lambda cells: _cell(cells, at).rlike(r"^\([0-9]{4}\.(0[1-9]|1[0-2])\)$")


def _day(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd"))


def span(first: int, last: int) -> Callable[[Column], Column]:
    """Real calendar days in order; null cast results fail."""
    return lambda cells: F.coalesce(_day(_cell(cells, first)) <= _day(_cell(cells, last)), F.lit(False))


def _every(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


@dataclass(frozen=True)
class Layout:
    """Column count (``open_ended``: at least so many) and value rules of one data group."""

    columns: int
    open_ended: bool = False
    rules: tuple[Callable[[Column], Column], ...] = field(default_factory=tuple)


#: Layouts by data group in lower case (fixed values).
LAYOUTS = {
    "fi/fi": Layout(5, rules=(filled(0), positive(1), natural(4))),
    "fi/fi_text": Layout(7, rules=(filled(0), positive(1, 2))),
    "fi/fi_hb": Layout(5, rules=(filled(0), positive(1))),
    "ipc/ipc8u_text": Layout(11, rules=(filled(0), month(1), positive(2, 3), natural(4), span(7, 8))),
    "concordance": Layout(4, rules=(filled(1, 3), one_of(("1", "4", "5", "6", "7", "8"), 0, 2))),
    "fterm/fterm": Layout(5, True, (filled(0), positive(1), natural(2))),
    "fi/fi_kaisei_link": Layout(2, True, (filled(0),)),
}


def check_rows(raw: DataFrame, files: DataFrame, layouts: dict[str, Layout] | None = None) -> DataFrame:
    """(file_id, line_number, data_group, cells, errors) for the rows of python-csv files.

    ``errors`` lists the broken rules in order quoting, column_count, value; an
    empty array marks a good row. Cells of a badly quoted row are null. A null
    or empty line is one empty cell. A data group without a layout is checked
    for quoting only. Status and error of the file are not looked at. Repeated
    rows are all kept; other columns of the inputs are ignored.
    """
    layouts = LAYOUTS if layouts is None else layouts
    group = F.lower(strip_white(F.coalesce("data_group", F.lit(""))))
    named = files.where(F.lower(strip_white(F.col("parser"))) == "python-csv").select("file_id", group.alias("data_group"))
    line = clean_line(F.coalesce("raw_line", F.lit("")))
    rows = (
        raw.select("file_id", "line_number", line.alias("line"))
        .join(named, "file_id")
        .withColumn("cells", F.when(F.col("line").rlike(_LINE), cut(F.col("line"))))
    )
    n, cells = F.size("cells"), F.col("cells")
    count_ok, value_ok = F.lit(True), F.lit(True)
    for name, lay in layouts.items():
        here = F.col("data_group") == name
        count_ok = F.when(here, (n >= lay.columns) if lay.open_ended else (n == lay.columns)).otherwise(count_ok)
        value_ok = F.when(here, _every([r(cells) for r in lay.rules]) if lay.rules else F.lit(True)).otherwise(value_ok)
    quoted = cells.isNotNull()
    errors = F.array_compact(
        F.array(
            F.when(~quoted, "quoting"),
            F.when(quoted & ~count_ok, "column_count"),
            F.when(quoted & ~value_ok, "value"),
        )
    )
    return rows.withColumn("errors", errors).select("file_id", "line_number", "data_group", "cells", "errors")


def split_rows(raw: DataFrame, files: DataFrame, layouts: dict[str, Layout] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good has the cells, bad the first reason and all errors."""
    checked = check_rows(raw, files, layouts)
    good = checked.where(F.size("errors") == 0).drop("errors")
    bad = checked.where(F.size("errors") > 0).select(
        "file_id", "line_number", F.col("errors")[0].alias("reason"), "errors"
    )
    return good, bad
