"""Schemas that drift between files (similarity flooding).

Values are profiled in Spark: per file and field the JSON type, and for fields
that vanish or appear between neighbouring files of a series the share of rows
with the same classification code that carry the same value. What is left per
series is its schema graphs, a few rows per file whatever the row counts. For
each pair of neighbours the graphs are matched: a pair of fields starts with
the likeness of names, types and values, scores flow along the edges
field - type and field - parent until they settle, and the best consistent
correspondences above the value majority become renames.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kasane.functions.text import norm_code, strip_white
from kasane.runtime import Scratch, shuffle_width

#: Classification codes by which rows of two files are paired (fixed value).
CODE = r"^(?:[A-H][0-9]{2}[A-Z][0-9]+/[0-9]+|[0-9][A-Z][0-9]{3}(?:[A-Z]{2}[0-9]+)?)$"
_DATED = r"^(.*?)[_-]?(?:[0-9]{8}|[0-9]{4}[-_][0-9]{2}(?:[-_][0-9]{2})?)\.[a-z0-9]+$"


def series_files(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, series, pos, prev): files with rows, ordered within their series.

    Series: data group and file name up to the date, both lower case (the whole
    name where there is no date). Order: release_id, then file_id.
    """
    name = F.element_at(F.split(F.lower(F.coalesce("relative_path", F.lit(""))), "/"), -1)
    stem = F.regexp_extract(name, _DATED, 1)
    series = F.concat_ws(
        "|", F.lower(strip_white(F.coalesce("data_group", F.lit("")))), F.when(stem == "", name).otherwise(stem)
    )
    used = records.select("file_id").where("file_id is not null").distinct()
    w = Window.partitionBy("series").orderBy("release_id", "file_id")
    return (
        files.select("file_id", "release_id", series.alias("series"))
        .join(used, "file_id", "left_semi")
        .withColumn("pos", F.row_number().over(w))
        .withColumn("prev", F.lag("file_id").over(w))
        .drop("release_id")
    )


NUMBER = r"^-?(?:0|[1-9][0-9]{0,17})(?:\.[0-9]+)?$"


def _kind(shape: Column) -> Column:
    return (
        F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("number")
    )


def _entries(payload: Column) -> Column:
    """The non-null fields of a JSON object as structs (field, shape, value), null for other payloads."""
    every = F.transform(
        F.map_entries(F.from_json(payload, "map<string,variant>")),
        lambda e: F.struct(
            e["key"].alias("field"), F.schema_of_variant(e["value"]).alias("shape"),
            F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.to_json(e["value"])).alias("value"),
        ),
    )
    return F.filter(every, lambda e: e["shape"] != "VOID")


def fields(records: DataFrame) -> DataFrame:
    """(file_id, code, field, type, shape, value), one row per non-null field.

    ``code`` joins the row's code-like values (any order of fields), '' without
    one. ``value`` is text; nested values as JSON. Rows that are no JSON object
    have no fields.
    """
    live = records.select("file_id", _entries(F.col("payload_json")).alias("live"))
    codes = F.array_sort(
        F.filter(F.transform("live", lambda e: F.when(e["shape"] == "STRING", norm_code(e["value"]))), lambda c: c.rlike(CODE))
    )
    return live.select("file_id", F.array_join(codes, " ").alias("code"), F.explode("live").alias("e")).select(
        "file_id", "code", "e.field", _kind(F.col("e.shape")).alias("type"), "e.shape", "e.value"
    )


def profiles(long: DataFrame) -> DataFrame:
    """(file_id, field, type, shape, n, n_number, n_boolean): the commonest type of each field per file, and how many values read as what."""
    counted = long.groupBy("file_id", "field", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("shape").alias("shape"),
        F.count(F.when(F.col("reads") == "number", 1)).alias("n_number"), F.count(F.when(F.col("reads") == "boolean", 1)).alias("n_boolean"),
    )
    return counted.groupBy("file_id", "field").agg(
        F.max_by(F.struct("type", "shape"), F.struct("n", "type")).alias("t"), *(F.sum(c).alias(c) for c in ("n", "n_number", "n_boolean"))
    ).select("file_id", "field", "t.type", "t.shape", "n", "n_number", "n_boolean")


def agreements(long: DataFrame, chain: DataFrame, profile: DataFrame) -> DataFrame:
    """(series, pos, old, new, same, all): rows of the later file whose code occurs before, and those with the same value."""
    have = profile.join(chain, "file_id").select("series", "pos", "file_id", "field")
    nxt = have.select("series", (F.col("pos") - 1).alias("pos"), "field")
    prv = have.select("series", (F.col("pos") + 1).alias("pos"), "field")
    last = chain.groupBy("series").agg(F.max("pos").alias("last"))
    gone = (
        have.join(nxt, ["series", "pos", "field"], "left_anti").join(last, "series").where("pos < last")
        .select("file_id", "field", "series", (F.col("pos") + 1).alias("at"), F.lit(True).alias("old"))
    )
    new = have.join(prv, ["series", "pos", "field"], "left_anti").where("pos > 1").select(
        "file_id", "field", "series", F.col("pos").alias("at"), F.lit(False).alias("old")
    )
    both = gone.unionByName(new)
    counted = (
        long.select("file_id", "field", "code", "v")
        .join(both, ["file_id", "field"])
        .groupBy("series", "at", "old", "field", "code", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left = counted.where("old").select("series", "at", F.col("field").alias("of"), "code", "v")
    right = counted.where("not old").select("series", "at", F.col("field").alias("nf"), "code", "v", "n")
    seen = right.join(left.select("series", "at", "of", "code").distinct(), ["series", "at", "code"])
    total = seen.groupBy("series", "at", "of", "nf").agg(F.sum("n").alias("all"))
    same = right.join(left, ["series", "at", "code", "v"]).groupBy("series", "at", "of", "nf").agg(F.sum("n").alias("same"))
    return total.join(same, ["series", "at", "of", "nf"], "left").select(
        "series", F.col("at").alias("pos"), F.col("of").alias("old"), F.col("nf").alias("new"),
        F.coalesce("same", F.lit(0)).cast("long").alias("same"), F.col("all").cast("long").alias("all"),
    )


@lru_cache(maxsize=1 << 16)
def _likeness(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a.lower().replace("_", ""), b.lower().replace("_", "")).ratio()


def members(shape: str) -> list[tuple[str, str]]:
    """(path, kind) of the nested members of a variant's shape; array elements have the path ``[]``."""
    out: list[tuple[str, str]] = []

    def walk(text: str, path: str) -> None:
        if text.startswith("ARRAY<"):
            out.append((path + "[]", text[6:-1].split("<")[0]))
            walk(text[6:-1], path + "[]")
        elif text.startswith("OBJECT<"):
            depth, start, body = 0, 0, text[7:-1]
            for i, ch in enumerate(body + ","):
                depth += (ch == "<") - (ch == ">")
                if ch == "," and depth == 0:
                    name, _, kind = body[start:i].partition(":")
                    start = i + 1
                    if kind:
                        name, kind = name.strip(" `"), kind.strip()
                        out.append((f"{path}.{name}", kind.split("<")[0]))
                        walk(kind, f"{path}.{name}")

    walk(shape, "")
    return out


class _Graph:
    """Schema graph of one file: root, fields and nested members (each under its parent) with their types."""

    def __init__(self, fields: list[tuple[str, str, str]]):
        self.names, up, kinds = [""], [-1], [""]
        self.top = []
        for name, kind, shape in fields:
            at = {"": len(self.names)}
            self.top.append(at[""])
            self.names.append(name), up.append(0), kinds.append(kind)
            for path, inner in members(shape):
                above = path[:-2] if path.endswith("[]") else path.rpartition(".")[0]
                at[path] = len(self.names)
                self.names.append(path.rpartition(".")[2]), up.append(at.get(above, at[""])), kinds.append(inner)
        n = len(self.names)
        self.parent = np.zeros((n, n))
        for i, u in enumerate(up):
            if u >= 0:
                self.parent[i, u] = 1
        self.kinds = sorted(set(kinds))
        self.typed = np.array([[k == x for x in self.kinds] for k in kinds], float)
        self.children = self.parent.sum(0)


def flood(before: list[tuple[str, str, str]], after: list[tuple[str, str, str]], value_share: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Scores (0 to 1) of field pairs after similarity flooding.

    ``before`` and ``after`` are (name, type, shape); ``value_share`` the share
    of agreeing values per pair (0 where unknown). A pair of nodes starts with
    the likeness of names and values; each round it receives a quarter of its
    score from the pairs its edges lead to (parents, members, types) and keeps
    the rest of its start score, until nothing moves.
    """
    a, b = _Graph(before), _Graph(after)
    name = np.array([[_likeness(x, y) if i and j else float(i == j) for j, y in enumerate(b.names)] for i, x in enumerate(a.names)])
    start = 0.2 * name
    start[np.ix_(a.top, b.top)] += 0.8 * value_share
    for i in range(1, len(a.names)):  # members have no values of their own: the name is all there is
        for j in range(1, len(b.names)):
            if i not in a.top and j not in b.top:
                start[i, j] = name[i, j]
    start[0, 0] = 1.0
    kind0 = np.array([[float(x == y) for y in b.kinds] for x in a.kinds])
    score, kind = start.copy(), kind0.copy()
    fan = np.maximum(np.maximum(a.children[:, None], b.children[None, :]), 1)
    inner = (a.children[:, None] > 0) | (b.children[None, :] > 0)
    spread = np.maximum(np.maximum(a.typed.sum(0)[:, None], b.typed.sum(0)[None, :]), 1)
    for _ in range(rounds):
        near = a.parent @ score @ b.parent.T + (a.parent.T @ score @ b.parent) / fan + a.typed @ kind @ b.typed.T
        new = 0.75 * start + 0.25 * near / (2 + inner)
        new[0, 0] = 1.0
        kind = 0.5 * kind0 + 0.5 * np.minimum(a.typed.T @ score @ b.typed / spread, 1)
        moved = np.abs(new - score).max()
        score = new
        if moved < 1e-4:
            break
    return score[np.ix_(a.top, b.top)]


#: Flooded score from which two fields correspond: between a majority of agreeing values and likeness of names and types alone.
LEVEL = 0.55


def _match(prev: pd.DataFrame, cur: pd.DataFrame, share: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Consistent correspondences of vanished and new fields: the best flooded scores first, each field once."""
    a = list(prev[["field", "type", "shape"]].itertuples(index=False, name=None))
    b = list(cur[["field", "type", "shape"]].itertuples(index=False, name=None))
    names_a, names_b = {f[0] for f in a}, {f[0] for f in b}
    if not (names_a - names_b) or not (names_b - names_a):
        return []
    values = np.array([[share.get((x[0], y[0]), 1.0 if x[0] == y[0] else 0.0) for y in b] for x in a])
    score = flood(a, b, values)
    pairs = sorted(
        ((score[i, j], x[0], y[0]) for i, x in enumerate(a) for j, y in enumerate(b)
         if x[0] not in names_b and y[0] not in names_a and score[i, j] > LEVEL),
        key=lambda p: (-p[0], p[1], p[2]),
    )
    used_a, used_b, out = set(), set(), []
    for _, x, y in pairs:
        if x not in used_a and y not in used_b:
            used_a.add(x), used_b.add(y), out.append((x, y))
    return out


_EVENT = "series string, pos int, file_id long, change string, old_field string, new_field string, root string, cast string"


def _common(kept: list[tuple]) -> dict[str, str]:
    """Consistent name to the type all its values can be cast to."""
    seen: dict[str, list] = {}
    for name, kind, n, number, boolean in kept:
        s = seen.setdefault(name, [set(), 0, 0, 0])
        s[0].add(kind)
        s[1], s[2], s[3] = s[1] + n, s[2] + number, s[3] + boolean
    return {
        name: "number" if "number" in kinds and number == n else "boolean" if "boolean" in kinds and boolean == n
        else "json" if kinds <= {"array", "object"} else "string"
        for name, (kinds, n, number, boolean) in seen.items()
    }


def _series_events(pdf: pd.DataFrame) -> pd.DataFrame:
    """Events of one series; ``keep`` rows carry the consistent name and common type of every field of every file."""
    prof = pdf[pdf["kind"] == "field"]
    share: dict[int, dict[tuple[str, str], float]] = {}
    for r in pdf[pdf["kind"] == "share"].itertuples(index=False):
        share.setdefault(r.pos, {})[(r.field, r.other)] = r.same / r.all
    out, kept, prev = [], [], None
    live: dict[str, str] = {}  # field to consistent name
    for pos, cur in sorted(prof.groupby("pos"), key=lambda g: g[0]):
        cur = cur.sort_values("field")
        fid, series = int(cur["file_id"].iloc[0]), cur["series"].iloc[0]
        say = lambda *x: out.append((series, int(pos), fid, *x))
        new = set(cur["field"])
        renamed, old, types = [], set(), {}
        if prev is not None:
            renamed = _match(prev, cur, share.get(pos, {}))
            types = dict(zip(prev["field"], prev["type"]))
            old = set(prev["field"])
        for x, y in renamed:
            say("renamed", x, y, "", "")
        moved = {y: live[x] for x, y in renamed}
        for x in sorted(old - new):
            live.pop(x)
            if x not in {p[0] for p in renamed}:
                say("removed", x, "", "", "")
        live.update(moved)
        for y in sorted(new - old - set(moved)):
            if prev is not None:
                say("added", "", y, "", "")
            taken, k = set(live.values()), 1
            while (y if k == 1 else f"{y}_{k}") in taken:  # a name that comes back while its former field lives on
                k += 1
            live[y] = y if k == 1 else f"{y}_{k}"
        for r in cur.itertuples(index=False):
            if r.field in types and types[r.field] != r.type:
                say("retyped", r.field, r.field, "", "")
            kept.append((live[r.field], r.type, r.same, r.n_number, r.n_boolean))
            say("keep", r.field, r.field, live[r.field], "")
        prev = cur
    common = _common(kept)
    rows = [(*r[:-1], common[r[-2]]) if r[3] == "keep" else r for r in out]
    return pd.DataFrame(rows, columns=["series", "pos", "file_id", "change", "old_field", "new_field", "root", "cast"])


def _reading(shape: Column, value: Column) -> Column:
    """The text of a value, unwrapped where the wrapper can be told from the text.

    Arrays: the element of a one-element array; several words without white
    space are joined by blanks. Objects: ``value`` where it is the only member,
    or where the only other one is ``n`` and counts its characters.
    """
    words = F.from_json(value, "array<string>")
    inner = F.get_json_object(value, "$.value")
    counted = (shape == "OBJECT<n: BIGINT, value: STRING>") & (F.get_json_object(value, "$.n") == F.length(inner).cast("string"))
    return F.coalesce(
        F.when(
            shape.startswith("ARRAY") & (shape != "ARRAY<VOID>"),
            F.when(F.json_array_length(value) == 1, F.get_json_object(value, "$[0]")).when(
                (shape == "ARRAY<STRING>") & (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(r"^\S+$")), F.array_join(words, " ")
            ),
        ),
        F.when(shape.startswith("OBJECT") & ((F.json_object_keys(value) == F.array(F.lit("value"))) | counted), inner),
        value,
    )


class Drift:
    """Field profiles and events of all series, written once."""

    def __init__(self, records: DataFrame, files: DataFrame):
        self.scratch = Scratch(records.sparkSession, "drift")
        self.records = records
        chain = self.scratch.save(series_files(files, records))
        # parsed once: a value travels on as its hash and what it reads as
        reading = _reading(F.col("shape"), F.col("value"))
        reads = F.when(reading.rlike(NUMBER), "number").when(reading.isin("true", "false"), "boolean")
        long = self.scratch.save(fields(records).select("file_id", "code", "field", "type", "shape", F.xxhash64("value").alias("v"), reads.alias("reads")))
        profile = self.scratch.save(profiles(long))
        share = agreements(long, chain, profile)
        none = F.lit(0).cast("long")
        rows = profile.join(chain, "file_id").select(
            "series", "pos", F.lit("field").alias("kind"), "file_id", "field", F.lit("").alias("other"), "type", "shape",
            F.col("n").alias("same"), F.lit(1).cast("long").alias("all"), "n_number", "n_boolean",
        ).unionByName(
            share.select(
                "series", "pos", F.lit("share").alias("kind"), none.alias("file_id"),
                F.col("old").alias("field"), F.col("new").alias("other"), F.lit("").alias("type"), F.lit("").alias("shape"), "same", "all",
                none.alias("n_number"), none.alias("n_boolean"),
            )
        )
        width = max(shuffle_width(records.sparkSession), records.sparkSession.sparkContext.defaultParallelism)
        spread = rows.repartition(width, "series")  # few bytes, much work: not to be coalesced by size
        self.events = self.scratch.save(spread.groupBy("series").applyInPandas(_series_events, _EVENT))
        self.scratch.drop(long, profile)

    def changes(self) -> DataFrame:
        """(file_id, change, old_field, new_field) at the file where a change first shows."""
        return self.events.where("change <> 'keep'").select("file_id", "change", "old_field", "new_field")

    def schema(self) -> DataFrame:
        """(series, field, type, n_files): the consistent fields of each series and their common type."""
        return self.events.where("change = 'keep'").groupBy("series", F.col("root").alias("field"), F.col("cast").alias("type")).agg(F.count(F.lit(1)).alias("n_files"))

    def unified(self) -> DataFrame:
        """(file_id, record_number, series, row_json): the union of all rows, one name and one type per field of a series.

        Renamed fields carry their first name in the series (a name that comes
        back beside it is numbered). Values are cast to the type that holds all
        values of the field: number or boolean where every value reads as one,
        else text. A wrapped value is unwrapped so that a retyped field keeps one
        reading, but only where nothing is lost by it (see ``_reading``); fields
        that are arrays or objects everywhere stay JSON. Rows that are no JSON
        object have a null row_json. Rows are rewritten where they lie: only the
        names of a file, a few rows, are joined.
        """
        names = self.events.where("change = 'keep'").groupBy("file_id", "series").agg(
            F.map_from_entries(F.collect_list(F.struct("old_field", F.struct("root", "cast")))).alias("names")
        )
        quoted = lambda text: F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)

        def typed(e: Column) -> Column:
            to, text = F.element_at("names", e["field"]), _reading(e["shape"], e["value"])
            value = F.when(to["cast"] == "json", e["value"]).when(to["cast"].isin("number", "boolean"), text).otherwise(quoted(text))
            return F.struct(to["root"].alias("root"), F.concat(quoted(to["root"]), F.lit(":"), value).alias("v"))

        body = F.array_join(F.transform(F.array_sort(F.transform("live", typed)), lambda x: x["v"]), ",")
        return (
            self.records.select("file_id", "record_number", _entries(F.col("payload_json")).alias("live"))
            .join(names, "file_id", "left")
            .select("file_id", "record_number", "series", F.concat(F.lit("{"), body, F.lit("}")).alias("row_json"))
        )


def field_changes(records: DataFrame, files: DataFrame) -> DataFrame:
    return Drift(records, files).changes()


def unified_rows(records: DataFrame, files: DataFrame) -> DataFrame:
    return Drift(records, files).unified()
