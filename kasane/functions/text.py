"""Scalar text functions as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java regex class for what Python calls white space (fixed value).
WHITE = r"(?U)[\s\x1c-\x1f]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def norm_code(code: Column) -> Column:
    """Code without any Unicode white space, upper case; null stays null."""
    return F.upper(F.regexp_replace(code, WHITE + "+", ""))


def strip_white(value: Column) -> Column:
    """Unicode strip (plain ``trim`` only knows the ASCII blank)."""
    return F.regexp_replace(value, rf"^{WHITE}+|{WHITE}+$", "")


def norm_text(value: Column) -> Column:
    """CRLF and CR become LF, then Unicode strip."""
    return strip_white(F.regexp_replace(value, "\r\n?", "\n"))


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def group_key(scheme: Column, code: Column) -> Column:
    """Five characters for fterm, else the part before the first slash."""
    return F.when(scheme == "fterm", F.substring(code, 1, 5)).otherwise(F.substring_index(code, "/", 1))


def lookup_key(scheme: Column, edition: Column, code: Column) -> Column:
    """scheme, edition and code joined by U+001F; null parts count as ''."""
    return F.concat_ws("\x1f", *(F.coalesce(c, F.lit("")) for c in (scheme, edition, code)))


def ascii_fold(value: Column) -> Column:
    """Lower-cases A-Z only (literal search folds nothing else)."""
    return F.translate(value, _UPPER, _UPPER.lower())


def path_segment(value: Column) -> Column:
    """Percent-encoding that leaves only letters, digits and ``-._~``."""
    encoded = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def query_value(value: Column) -> Column:
    """Percent-encoding of a query value: blanks become ``+``, letters, digits and ``-._~`` stay."""
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def fragment_id(value: Column) -> Column:
    """Byte escapes ``_XX`` for everything but letters, digits and ``-``."""
    out = F.url_encode(value)
    for old, new in (("_", "_5F"), (".", "_2E"), ("*", "_2A"), ("+", "_20"), ("%", "_")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def html_escape(value: Column) -> Column:
    out = value
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def version_text(value: Column) -> Column:
    """Version without parentheses and blanks; null becomes ''."""
    return F.coalesce(F.regexp_replace(value, r"(?U)[()（）\s]", ""), F.lit(""))


def version_indicator(value: Column) -> Column:
    """``YYYY.MM`` with balanced or no parentheses, '' for nothing, null where malformed."""
    bare = F.regexp_extract(strip_white(value), r"^(?:\(([^()]*)\)|([^()]*))$", 0)
    inner = F.regexp_replace(bare, r"[()]", "")
    return (
        F.when(value.isNull() | (strip_white(value) == ""), F.lit(""))
        .when(bare == "", F.lit(None))
        .when(inner.rlike(r"^[0-9]{4}\.[0-9]{2}$"), inner)
        .when(inner == "", F.lit(""))
    )


def date_key(value: Column) -> Column:
    """Calendar date as eight digits; '' for null or blank; else the trimmed text."""
    text = strip_white(F.coalesce(value, F.lit("")))
    digits = F.translate(text, "-/.", "")
    parts = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
    padded = F.concat(
        F.regexp_extract(text, parts, 1),
        F.lpad(F.regexp_extract(text, parts, 2), 2, "0"),
        F.lpad(F.regexp_extract(text, parts, 3), 2, "0"),
    )
    return F.when(F.length(digits) == 8, digits).when(text.rlike(parts), padded).otherwise(text)


def end_key(value: Column) -> Column:
    """As date_key, with the far end 9999-12-31 read as open ('')."""
    key = date_key(value)
    return F.when(key == "99991231", F.lit("")).otherwise(key)


def iso_date(value: Column) -> Column:
    """DATE from ``YYYYMMDD`` or ``YYYY-MM-DD``; null for anything else."""
    text = strip_white(value)
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")).when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")
    )


def to_int(value: Column) -> Column:
    """BIGINT from an optionally signed run of ASCII digits after strip, else null."""
    text = strip_white(value)
    return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("bigint"))


def concept_type(scheme: Column, code: Column, level: Column | None = None) -> Column:
    """theme / aspect / term for fterm, section / class / subclass / group otherwise."""
    n = F.length(code)
    shallow = (n == 4) if level is None else ((n == 4) | F.coalesce(level <= 4, F.lit(False)))
    return (
        F.when(scheme == "fterm", F.when(n == 5, "theme").when(n == 7, "aspect").otherwise("term"))
        .when(n == 1, "section")
        .when(n == 3, "class")
        .when(shallow, "subclass")
        .otherwise("group")
    )


def file_code(stem: Column) -> Column:
    """Classification code spelled in a file stem: ``_`` dropped, ``-`` is the slash."""
    return norm_code(F.rtrim(F.replace(F.replace(stem, F.lit("_")), F.lit("-"), F.lit("/")), F.lit("/")))


def sha_upper(value: Column) -> Column:
    return F.upper(F.sha2(value.cast("binary"), 256))


def source_id(path: Column, content_sha: Column) -> Column:
    """``src-`` and 24 hex digits over path, NUL and the upper-case content digest."""
    joined = F.concat(path.cast("binary"), F.unhex(F.lit("00")), F.upper(content_sha).cast("binary"))
    return F.concat(F.lit("src-"), F.substring(F.sha2(joined, 256), 1, 24))


def excerpt(text: Column, term: str, before: int = 80, width: int = 240) -> Column:
    """A window around the first occurrence of term; markers only where text was cut."""
    at = F.locate(term.lower(), F.lower(text))
    start = F.greatest(at - 1 - before, F.lit(0))
    body = F.substring(text, start + 1, F.lit(width))
    return F.concat(
        F.when(start > 0, F.lit("… ")).otherwise(""),
        body,
        F.when(start + width < F.length(text), F.lit(" …")).otherwise(""),
    )
