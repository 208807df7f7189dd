"""Rows of a package to typed emissions, stage by stage, as DataFrames.

Every emission carries its order (stage, file_id, record_number, emit), from
which identities and first-writer rules follow, and its lineage (file_id,
locator). Nothing depends on the order in which tasks run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasane.functions import text as tx
from kasane.operators.temporal import island_ids, stack_parent

CONCEPT = ("scheme", "edition", "code", "normalized_code", "concept_type", "record_status", "version", "valid_from", "valid_to", "level", "sequence_number")
ORDER = ("stage", "file_id", "record_number", "emit")
#: Editions by data group (fixed values).
IPC_GROUPS = {"IPC/IPC8U_TEXT": "8U", "IPC/IPC8B_TEXT": "8B", "IPC/IPC7_TEXT": "7", "IPC/IPC7E_TEXT": "7E", "IPC/IPC6_TEXT": "6", "IPC/IPC5_TEXT": "5", "IPC/IPC4_TEXT": "4"}


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _c(i: int) -> Column:
    return F.coalesce(F.get("cells", F.lit(i)), F.lit(""))


class Emissions:
    """Collects concepts, texts, properties, relations, documents, links, entries and issues."""

    KINDS = ("concepts", "texts", "properties", "relations", "documents", "segments", "links", "entries", "issues", "revision_relations")

    def __init__(self, files: DataFrame):
        self.files = files
        for kind in self.KINDS:
            setattr(self, kind, [])

    def issue(self, rows: DataFrame, severity: str, code: str, message: str) -> None:
        self.issues.append(rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(message).alias("message"), "file_id", "locator"))

    def concept(self, rows: DataFrame, stage: int, emit: int, scheme, edition, code: Column, ctype: Column | None = None, status: str = "canonical", version=None, vfrom=None, vto=None, level=None, seq=None) -> None:
        s = F.lit(scheme) if isinstance(scheme, str) else scheme
        e = F.lit(edition) if isinstance(edition, str) else edition
        n, none = tx.norm_code(code), F.lit(None)
        self.concepts.append(
            rows.select(
                s.alias("scheme"), e.alias("edition"), code.alias("code"), n.alias("normalized_code"),
                (tx.concept_type(s, n) if ctype is None else ctype).alias("concept_type"), F.lit(status).alias("record_status"),
                (F.lit("") if version is None else version).alias("version"), (none if vfrom is None else vfrom).cast("date").alias("valid_from"), (none if vto is None else vto).cast("date").alias("valid_to"),
                (none if level is None else level).cast("long").alias("level"), (none if seq is None else seq).cast("long").alias("sequence_number"),
                F.lit(stage).alias("stage"), "file_id", "record_number", F.lit(emit).alias("emit"), "locator",
            ).where("normalized_code <> ''")
        )

    def text(self, rows: DataFrame, stage: int, scheme, edition, code: Column, version: Column | None, language, kind: Column, seq: Column, text: Column) -> None:
        """Empty texts are dropped; an untranslated mark becomes a property."""
        base = rows.select(
            (F.lit(scheme) if isinstance(scheme, str) else scheme).alias("scheme"), (F.lit(edition) if isinstance(edition, str) else edition).alias("edition"),
            tx.norm_code(code).alias("normalized_code"), (F.lit("") if version is None else version).alias("version"),
            (F.lit(language) if isinstance(language, str) else language).alias("language"), kind.alias("kind"), seq.cast("long").alias("sequence_number"),
            tx.norm_text(text).alias("text"), F.lit(stage).alias("stage"), "file_id", "record_number", "locator",
        )
        mark = F.col("text") == "(Not Translated)"
        self.texts.append(base.where((F.col("text") != "") & ~mark))
        self.properties.append(base.where(mark).select("scheme", "edition", "normalized_code", "version", F.concat("kind", F.lit("_translation_status")).alias("name"), F.lit("not_translated").alias("value"), "language", "stage", "file_id", "record_number", "locator"))

    def prop(self, rows: DataFrame, stage: int, scheme: str, code: Column, name: str, value: Column, language: str | None) -> None:
        self.properties.append(
            rows.select(
                F.lit(scheme).alias("scheme"), F.lit("").alias("edition"), tx.norm_code(code).alias("normalized_code"), F.lit("").alias("version"), F.lit(name).alias("name"),
                tx.norm_text(value).alias("value"), F.lit(language).cast("string").alias("language"), F.lit(stage).alias("stage"), "file_id", "record_number", "locator",
            ).where("value <> ''")
        )

    def relation(self, rows: DataFrame, stage: int, a: tuple, b: tuple, kind: str) -> None:
        col = lambda x: F.lit(x) if isinstance(x, str) else x
        self.relations.append(
            rows.select(
                col(a[0]).alias("from_scheme"), col(a[1]).alias("from_edition"), tx.norm_code(a[2]).alias("from_code"),
                col(b[0]).alias("to_scheme"), col(b[1]).alias("to_edition"), tx.norm_code(b[2]).alias("to_code"),
                F.lit(kind).alias("kind"), F.lit(stage).alias("stage"), "file_id", "record_number", "locator",
            ).where("from_code <> '' and to_code <> ''")
        )


def _group(rows: DataFrame, *groups: str) -> DataFrame:
    return rows.where(F.col("data_group").isin(*groups)).withColumn("locator", F.concat(F.lit("row:"), F.col("record_number").cast("string")))


def _shaped(out: Emissions, rows: DataFrame, ok: Column, code: str, message: str) -> DataFrame:
    out.issue(rows.where(~ok), "error", code, message)
    return rows.where(ok)


def _first(rows: DataFrame, key: str = "key") -> DataFrame:
    """The first row of each key in file and row order."""
    best = rows.groupBy(key).agg(F.min(F.struct("file_id", "record_number")).alias("__m"))
    return rows.join(best.select(key, "__m.*"), [key, "file_id", "record_number"], "left_semi")


def fi_codes(out: Emissions, rows: DataFrame) -> None:
    r = _shaped(out, _group(rows, "FI/FI"), F.size("cells") == 5, "FI_COLUMN_COUNT", "expected 5 columns")
    level = tx.to_int(_c(4))
    out.concept(r, 1, 0, "fi", "", _c(0), tx.concept_type(F.lit("fi"), tx.norm_code(_c(0)), level), level=level, seq=tx.to_int(_c(1)))
    fresh = _first(r.withColumn("key", tx.norm_code(_c(0))).withColumn("level", level).where("key <> ''"))
    up = stack_parent(fresh.where("level is not null"), ["file_id"], ["record_number"], "level", "key").where("parent is not null")
    out.relation(up, 1, ("fi", "", F.col("key")), ("fi", "", F.col("parent")), "parent")
    out.prop(fresh, 1, "fi", F.col("key"), "fi_marker", _c(2), None)
    out.prop(fresh, 1, "fi", F.col("key"), "fi_status", _c(3), None)


def themes(out: Emissions, rows: DataFrame) -> None:
    code = tx.norm_code(_c(0))
    good = {}
    for stage, group, lang in ((2, "FTERM/THEME", "ja"), (3, "FTERM/THEME_E", "en")):
        r = _shaped(out, _group(rows, group), F.size("cells") == 8, "THEME_COLUMN_COUNT", "expected 8 columns").where(code.rlike("^[0-9][A-Z][0-9]{3}$"))
        if lang == "en":
            known = good["ja"].select(code.alias("key"), tx.to_int(_c(1)).alias("ja_seq")).groupBy("key").agg(F.min("ja_seq").alias("ja_seq"), F.lit(True).alias("known"))
            r = r.withColumn("key", code).join(known, "key", "left")
            out.issue(r.where("known is null"), "error", "THEME_TRANSLATION_CONCEPT_MISSING", "English theme has no Japanese concept")
            r = r.where("known")
            out.issue(r.where(~F.col("ja_seq").eqNullSafe(tx.to_int(_c(1)))), "warning", "THEME_TRANSLATION_SEQUENCE_MISMATCH", "English theme sequence differs")
        else:
            out.concept(r, stage, 0, "fterm", "", code, F.lit("theme"), level=F.lit(0), seq=tx.to_int(_c(1)))
        good[lang] = r
        out.text(r, stage, "fterm", "", code, None, lang, F.lit("label"), F.lit(1), _c(6))
        out.prop(r, stage, "fterm", code, "fi_scope", _c(5), lang)
        out.prop(r, stage, "fterm", code, "remarks", _c(7), lang)


def fterms(out: Emissions, rows: DataFrame) -> None:
    code, depth, seq = tx.norm_code(_c(0)), tx.to_int(_c(2)), tx.to_int(_c(1))
    label = F.array_join(F.slice("cells", 4, F.greatest(F.size("cells") - 4, F.lit(0))), ",")
    scope = F.coalesce(F.element_at("cells", -1), F.lit(""))
    ja = None
    for stage, group, lang in ((4, "FTERM/FTERM", "ja"), (5, "FTERM/FTERM_E", "en")):
        r = _shaped(out, _group(rows, group), (F.size("cells") >= 5) & (F.length(code) >= 9) & depth.isNotNull(), "FTERM_SHAPE", "expected at least 5 columns, a code of 9 and a depth")
        r = r.withColumn("key", code).withColumn("depth", depth).withColumn("seq", seq).withColumn("aspect", F.substring("key", 1, 7)).withColumn("theme", F.substring("key", 1, 5))
        if lang == "en":
            known = ja.groupBy("key").agg(F.min("depth").alias("ja_depth"), F.min("seq").alias("ja_seq"), F.lit(True).alias("known"))
            r = r.join(known, "key", "left")
            out.issue(r.where("known is null"), "error", "FTERM_TRANSLATION_CONCEPT_MISSING", "English term has no Japanese concept")
            bad = F.col("known") & ~F.col("ja_seq").eqNullSafe(F.col("seq"))
            out.issue(r.where(bad), "error", "FTERM_TRANSLATION_SEQUENCE_MISMATCH", "English term sequence differs")
            r = r.where(F.col("known") & ~bad)
            out.issue(r.where("depth <> ja_depth"), "warning", "FTERM_TRANSLATION_DEPTH_MISMATCH", "English term depth differs")
        else:
            ja = r
            out.concept(r, stage, 0, "fterm", "", F.col("theme"), F.lit("theme"), level=F.lit(0))
            out.concept(r, stage, 1, "fterm", "", F.col("aspect"), F.lit("aspect"), level=F.lit(1))
            out.concept(r, stage, 2, "fterm", "", F.col("key"), F.lit("term"), level=F.col("depth") + 2, seq=F.col("seq"))
            out.relation(r, stage, ("fterm", "", F.col("aspect")), ("fterm", "", F.col("theme")), "parent")
            runs = island_ids(r, ["file_id"], ["record_number"], "aspect")
            up = stack_parent(runs, ["file_id", "island"], ["record_number"], "depth", "key")
            out.relation(up, stage, ("fterm", "", F.col("key")), ("fterm", "", F.coalesce("parent", "aspect")), "parent")
        out.text(r, stage, "fterm", "", F.col("key"), None, lang, F.lit("label"), F.lit(1), label)
        out.prop(r, stage, "fterm", F.col("key"), "fi_scope", scope, lang)


def ipc(out: Emissions, rows: DataFrame) -> None:
    r = _group(rows, *IPC_GROUPS)
    n, g = F.size("cells"), F.col("data_group")
    shape = F.when((g == "IPC/IPC8U_TEXT") & (n == 11), "u").when((g == "IPC/IPC8B_TEXT") & (n == 9), "b").when(n == 6, "o")
    r = r.withColumn("shape", shape)
    r = _shaped(out, r, F.col("shape").isNotNull(), "IPC_COLUMN_COUNT", "unsupported IPC row")
    pick = lambda u, b, o: F.when(F.col("shape") == "u", u).when(F.col("shape") == "b", b).otherwise(o)
    none = F.lit("")
    edition = F.create_map(*[F.lit(x) for kv in IPC_GROUPS.items() for x in kv])[g]
    r = r.select(
        "file_id", "record_number", "locator", edition.alias("edition"), _c(0).alias("code"), pick(_c(1), none, none).alias("raw_version"),
        tx.to_int(pick(_c(2), _c(2), _c(1))).alias("seq"), tx.strip_white(pick(_c(3), _c(3), _c(2))).alias("kind"), tx.to_int(pick(_c(4), _c(4), _c(3))).alias("level"),
        pick(_c(10), _c(8), _c(5)).alias("text"), pick(_c(7), none, none).alias("f"), pick(_c(8), none, none).alias("t"),
    )
    r = _shaped(out, r, F.coalesce(F.col("seq") > 0, F.lit(False)), "IPC_SEQUENCE_INVALID", "text sequence must be positive")
    r = r.withColumn("version", F.when(F.col("edition") == "8U", tx.version_indicator(F.col("raw_version"))).otherwise(""))
    r = _shaped(out, r, F.col("version").isNotNull(), "IPC_VERSION_INVALID", "version must be YYYY.MM")
    r = r.withColumn("key", tx.norm_code(F.col("code")))
    out.concept(r, 6, 0, "ipc", F.col("edition"), F.col("code"), tx.concept_type(F.lit("ipc"), F.col("key"), F.col("level")), version=F.col("version"), vfrom=tx.iso_date(F.col("f")), vto=tx.iso_date(F.col("t")), level=F.col("level"))
    up = stack_parent(r.where("level is not null and key <> ''"), ["file_id"], ["record_number"], "level", "key").where("parent is not null")
    out.relation(up, 6, ("ipc", F.col("edition"), F.col("key")), ("ipc", F.col("edition"), F.col("parent")), "parent")
    out.text(r, 6, "ipc", F.col("edition"), F.col("code"), F.col("version"), F.when(F.col("edition").endswith("E"), "en").otherwise("ja"), F.concat(F.lit("ipc_text_type_"), F.coalesce(tx.blank_to_null(F.col("kind")), F.lit("unknown"))), F.col("seq"), F.col("text"))


def fi_texts(out: Emissions, rows: DataFrame) -> None:
    for group, lang in (("FI/FI_TEXT", "ja"), ("FI/FI_TEXT_E", "en")):
        r = _shaped(out, _group(rows, group), F.size("cells") == 7, "FI_TEXT_COLUMN_COUNT", "expected 7 columns")
        kind = F.concat(F.lit("fi_text_type_"), F.coalesce(tx.blank_to_null(tx.strip_white(_c(2))), F.lit("unknown")))
        out.text(r, 7, "fi", "", _c(0), None, lang, kind, F.coalesce(tx.to_int(_c(1)), F.lit(1)), _c(6))


def documents(out: Emissions, rows: DataFrame) -> None:
    """Handbooks and explanations: one document per file, one segment per row, linked to its concept."""
    specs = (("FI/FI_HB", "fi", "fi_handbook", 5, 4, "ja"), ("FI/FI_HB_E", "fi", "fi_handbook", 5, 4, "en"), ("FTERM/FTERM_KAISETSU", "fterm", "fterm_explanation", 4, 3, "ja"), ("FTERM/FTERM_KAISETSU_E", "fterm", "fterm_explanation", 4, 3, "en"))
    for group, scheme, kind, width, at, lang in specs:
        r = _shaped(out, _group(rows, group), F.size("cells") == width, "DOCUMENT_COLUMN_COUNT", f"expected {width} columns")
        code, text = tx.norm_code(_c(0)), tx.norm_text(_c(at))
        out.documents.append(out.files.where((F.col("data_group") == group) & (F.col("status") == "parsed")).select("file_id", F.lit(kind).alias("kind"), F.lit(lang).alias("language"), F.element_at(F.split("relative_path", "/"), -1).alias("title")))
        out.segments.append(r.select("file_id", F.col("record_number").alias("sequence_number"), "locator", code.alias("heading"), text.alias("text")).where("text <> '' and text <> '(Not Translated)'"))
        out.links.append(r.select("file_id", F.lit(scheme).alias("scheme"), F.lit("").alias("edition"), code.alias("normalized_code"), F.lit(kind).alias("kind"), "locator").where("normalized_code <> ''"))
        if scheme == "fterm":
            out.concept(r, 9, 0, scheme, "", _c(0), status="reference_only")
            out.prop(r.where(text == "(Not Translated)"), 9, scheme, _c(0), f"{kind}_translation_status", F.lit("not_translated"), lang)


def fi_themes(out: Emissions, rows: DataFrame) -> None:
    r = _shaped(out, _group(rows, "FI/FI_THEME"), F.size("cells") == 5, "FI_THEME_COLUMN_COUNT", "expected 5 columns")
    out.relation(r, 10, ("fi", "", _c(0)), ("fterm", "", F.concat(_c(2), _c(3))), "fterm_theme")


def concordance(out: Emissions, rows: DataFrame) -> None:
    r = _shaped(out, _group(rows, "CONCORDANCE"), F.size("cells") == 4, "CONCORDANCE_COLUMN_COUNT", "expected 4 columns")
    scheme = lambda v: F.when(tx.strip_white(v) == "1", "fi").otherwise("ipc")
    edition = lambda v: F.when(tx.strip_white(v) == "1", "").when(tx.strip_white(v) == "8", "8U").otherwise(tx.strip_white(v))
    for emit, v, c in ((0, 0, 1), (1, 2, 3)):
        out.concept(r, 11, emit, scheme(_c(v)), edition(_c(v)), _c(c), status="reference_only")
    out.relation(r, 11, (scheme(_c(0)), edition(_c(0)), _c(1)), (scheme(_c(2)), edition(_c(2)), _c(3)), "concordance")


def judge(out: Emissions, rows: DataFrame) -> None:
    r = _shaped(out, _group(rows, "JUDGE"), F.size("cells") == 2, "JUDGE_COLUMN_COUNT", "expected 2 columns")
    out.entries.append(r.select(F.lit("judge").alias("category"), _c(0).alias("key"), F.lit("ja").alias("language"), _c(1).alias("value"), "file_id", "locator"))


def amendments(out: Emissions, rows: DataFrame) -> None:
    """XML amendments: a segment per element, both ends kept as references, amended_to between them."""
    r = rows.withColumn("locator", F.concat(F.lit("element:infor["), F.col("record_number").cast("string"), F.lit("]")))
    a, b = tx.norm_code(F.col("code")), tx.norm_code(F.col("translated"))
    out.documents.append(r.select("file_id", F.lit("fi_amendment").alias("kind"), F.lit("ja").alias("language"), F.concat(F.lit("FI amendment "), F.col("target")).alias("title")).distinct())
    out.segments.append(r.select("file_id", F.col("record_number").alias("sequence_number"), "locator", tx.blank_to_null(a).alias("heading"), "text").where("text <> ''"))
    out.links.append(r.select("file_id", F.lit("fi").alias("scheme"), F.lit("").alias("edition"), a.alias("normalized_code"), F.lit("fi_amendment").alias("kind"), "locator").where("normalized_code <> ''"))
    out.concept(r, 13, 0, "fi", "", F.col("code"), status="reference_only")
    out.concept(r, 13, 1, "fi", "", F.col("translated"), status="reference_only")
    out.relation(r, 13, ("fi", "", a), ("fi", "", b), "amended_to")


def html_tables(out: Emissions, rows: DataFrame) -> None:
    """Amendment tables relate two revisions by (code, version); code lists link a document to its theme."""
    r = rows.withColumn("locator", F.concat(F.lit("table-row:"), F.col("record_number").cast("string")))
    ipc_rows, add = r.where(F.col("data_group").startswith("IPC_KAISEI")), r.where(F.col("data_group").startswith("FTERM/ADD_CODE"))
    for part, kind in ((ipc_rows, "ipc_amendment"), (add, "fterm_add_code")):
        out.documents.append(part.select("file_id", F.lit(kind).alias("kind"), F.lit("ja").alias("language"), "title").distinct())
        out.segments.append(part.where("kind not in ('html-empty-row')").select("file_id", F.col("record_number").alias("sequence_number"), "locator", F.lit(None).cast("string").alias("heading"), F.array_join("cells", "\t").alias("text")).where("text <> ''"))
    data = ipc_rows.where(F.col("kind") == "html-table-row")
    data = _shaped(out, data, F.size("cells") == 4, "IPC_AMENDMENT_SHAPE", "expected 4 cells")
    out.revision_relations.append(data.select("file_id", "record_number", "locator", tx.norm_code(_c(0)).alias("from_code"), tx.version_indicator(_c(1)).alias("from_version"), tx.norm_code(_c(2)).alias("to_code"), tx.version_indicator(_c(3)).alias("to_version"), F.lit("amended_to").alias("kind")))
    theme = tx.norm_code(_c(0))
    out.links.append(add.where(F.col("kind") == "html-table-row").where(theme.rlike("^[0-9][A-Z][0-9]{3}$")).select("file_id", F.lit("fterm").alias("scheme"), F.lit("").alias("edition"), theme.alias("normalized_code"), F.lit("fterm_add_code").alias("kind"), "locator"))


def amendment_index(out: Emissions, rows: DataFrame) -> None:
    r = _shaped(out, _group(rows, "FI/FI_KAISEI_LINK"), F.size("cells") >= 2, "FI_AMENDMENT_LINK_COLUMN_COUNT", "expected 2 or more columns")
    rest = F.array_join(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), ",")
    out.entries.append(r.select(F.lit("fi_amendment_index").alias("category"), tx.norm_code(_c(0)).alias("key"), F.lit("ja").alias("language"), rest.alias("value"), "file_id", "locator"))
    out.concept(r, 16, 0, "fi", "", _c(0), status="reference_only")
    docs = out.files.where("data_group = 'FI/FI_KAISEI_DOC' and file_type = 'xml'").select(F.col("file_id").alias("doc_file"), "relative_path")
    target = F.concat(F.lit("FI/FI_KAISEI_DOC/"), tx.norm_code(_c(0)), F.lit(".xml"))
    hit = r.withColumn("relative_path", target).join(docs, "relative_path", "left")
    out.issue(hit.where("doc_file is null"), "error", "FI_AMENDMENT_DOCUMENT_MISSING", "indexed amendment document is missing")
    out.links.append(hit.where("doc_file is not null").select(F.col("doc_file").alias("file_id"), F.lit("fi").alias("scheme"), F.lit("").alias("edition"), tx.norm_code(_c(0)).alias("normalized_code"), F.lit("fi_amendment_index").alias("kind"), "locator"))


def definitions(out: Emissions, files: DataFrame, pages: DataFrame | None) -> None:
    """PDF definitions: a document per file, a segment per page, linked to the newest edition of the code in the file name.

    ``pages`` is None where no PDF reader is installed: every file then has an issue row.
    """
    pdf = files.where("file_type = 'pdf' and status = 'parsed'").withColumn("locator", F.lit("file"))
    code = tx.file_code(F.regexp_extract("relative_path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    out.documents.append(pdf.select("file_id", F.lit("ipc_definition").alias("kind"), F.lit("ja").alias("language"), F.concat(F.lit("IPC definition "), code).alias("title")))
    out.links.append(pdf.select("file_id", F.lit("ipc").alias("scheme"), F.lit("*").alias("edition"), code.alias("normalized_code"), F.lit("ipc_definition").alias("kind"), "locator").where("normalized_code <> ''"))
    if pages is None:
        out.issue(pdf, "warning", "PDF_READER_MISSING", "no PDF reader is installed; the text was not read")
        return
    r = pages.join(pdf.select("file_id", code.alias("code")), "file_id").withColumn("locator", F.concat(F.lit("page:"), F.col("page").cast("string")))
    empty = F.coalesce(tx.norm_text(F.col("text")), F.lit("")) == ""
    out.issue(r.where(empty), "warning", "PDF_EMPTY_PAGE", "a page has no text")
    out.segments.append(r.where(~empty).select("file_id", F.col("page").alias("sequence_number"), "locator", F.concat("code", F.lit(" page "), F.col("page").cast("string")).alias("heading"), tx.norm_text(F.col("text")).alias("text")))


CSV_STAGES = (fi_codes, themes, fterms, ipc, fi_texts, documents, fi_themes, concordance, judge, amendment_index)
HANDLED = ("FI/FI", "FI/FI_TEXT", "FI/FI_TEXT_E", "FI/FI_HB", "FI/FI_HB_E", "FI/FI_THEME", "FI/FI_KAISEI_LINK", "FI/FI_KAISEI_DOC", "FTERM/THEME", "FTERM/THEME_E", "FTERM/FTERM", "FTERM/FTERM_E", "FTERM/FTERM_KAISETSU", "FTERM/FTERM_KAISETSU_E", "FTERM/ADD_CODE", "FTERM/ADD_CODE_E", *IPC_GROUPS, "IPC_KAISEI", "CONCORDANCE", "JUDGE", "REFERENCE/IPC_TEIGI", "COPYRGHT")


def unhandled(out: Emissions, files: DataFrame) -> None:
    out.issue(files.where(~F.col("data_group").isin(*HANDLED)).withColumn("locator", F.lit("file")), "error", "UNHANDLED_SOURCE", "no adapter reads this file")
