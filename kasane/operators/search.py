"""Text search: trigram semantics, BM25 or literal, one hit per owner before paging."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasane.errors import QueryError
from kasane.functions.text import ascii_fold, excerpt

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def clean_query(query: str) -> list[str]:
    """Terms of a query of 1 to 500 printable characters."""
    if re.search(r"[\x00-\x1f\x7f]", query or ""):
        raise QueryError("INVALID_QUERY", "control characters are not allowed")
    text = " ".join((query or "").split())
    if not 1 <= len(text) <= 500:
        raise QueryError("INVALID_QUERY", "a query has 1 to 500 characters")
    return text.split(" ")


def check_page(limit: int, offset: int, most: int = 100) -> None:
    if not 1 <= limit <= most:
        raise QueryError("INVALID_LIMIT", f"limit is 1 to {most}")
    if not 0 <= offset < 2**63:
        raise QueryError("INVALID_OFFSET", "offset is not negative")


def mode_of(terms: Sequence[str]) -> str:
    """Ranked search needs three characters in every term."""
    return "ranked" if all(len(t) >= 3 for t in terms) else "literal"


def literal_match(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & ascii_fold(text).contains(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return out


def ranked_match(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.lower(text).contains(t.lower())
    return out


def bm25(index: DataFrame, text: str, terms: Sequence[str]) -> Column:
    """Rank (more negative is better) with the statistics of the whole index: one aggregate, one row to the driver."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    size = F.greatest(F.length(body) - 2, F.lit(0))
    stat = index.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(size), F.lit(0.0)).alias("d"),
        *(F.count(F.when(body.contains(t.lower()), 1)).alias(f"t{i}") for i, t in enumerate(terms)),
    ).first()
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        import math

        idf = math.log((stat.n - stat[f"t{i}"] + 0.5) / (stat[f"t{i}"] + 0.5))
        idf = idf if idf > 0 else LEAST_IDF
        tf = F.regexp_count(body, F.lit("(?=" + re.escape(t.lower()) + ")")).cast("double")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(stat.d or 1.0)))
    return -score


def hits(index: DataFrame, text: str, query: str, keep: Column | None = None) -> DataFrame:
    """Matching rows with ``rank``, ``search_mode`` and ``excerpt``; statistics ignore ``keep``."""
    terms = clean_query(query)
    mode = mode_of(terms)
    match = ranked_match(F.col(text), terms) if mode == "ranked" else literal_match(F.col(text), terms)
    rank = bm25(index, text, terms) if mode == "ranked" else F.lit(0.0)
    rows = index.where(match) if keep is None else index.where(match & keep)
    return rows.withColumn("rank", rank).withColumn("search_mode", F.lit(mode)).withColumn("excerpt", excerpt(F.col(text), terms[0]))


def best_per(rows: DataFrame, owner: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per owner, the first in order (before any limit)."""
    cols = [c for c in rows.columns if c not in owner]
    best = rows.groupBy(*owner).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__b"))
    return best.select(*owner, *(F.col(f"__b.{c}").alias(c) for c in cols))


def search_page(index: DataFrame, text: str, query: str, owner: Sequence[str], order: Sequence[str], limit: int, offset: int = 0, keep: Column | None = None) -> tuple[DataFrame, str]:
    """(page with one row more than limit when there is more, search mode)."""
    check_page(limit, offset)
    found = hits(index, text, query, keep)
    one = best_per(found, owner, ["rank", *order])
    return one.orderBy("rank", *order).offset(offset).limit(limit + 1), mode_of(clean_query(query))


def trigrams(index: DataFrame, key: str, text: str) -> DataFrame:
    """Posting table (gram, key), each pair once."""
    chars = F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?s)."), F.lit(0))  # once: a substring by position walks the text again
    rows = index.where(F.length(F.col(text)) >= 3).select(F.col(key), chars.alias("__c"))
    at = lambda i, k: F.get("__c", i + k)
    grams = F.transform(F.sequence(F.lit(0), F.size("__c") - 3), lambda i: F.concat(at(i, 0), at(i, 1), at(i, 2)))
    return rows.select(F.explode(F.array_distinct(grams)).alias("gram"), key)


def by_postings(postings: DataFrame, index: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """Rows containing the term: posting lists intersected, then verified on the text."""
    low = term.lower()
    if len(low) < 3:
        raise QueryError("INVALID_QUERY", "the posting table needs three characters")
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    keys = postings.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return index.join(keys.select(key), key, "left_semi").where(F.lower(F.col(text)).contains(low))


def posting_parity(postings: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs in only one of the posting table and a fresh one (empty: the index is sound)."""
    fresh = trigrams(index, key, text)
    return postings.exceptAll(fresh).withColumn("side", F.lit("stale")).unionByName(fresh.exceptAll(postings).withColumn("side", F.lit("missing")))
