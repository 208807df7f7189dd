"""Mixing sources to target weights (subset-sum budget fitting).

Per source the distinct texts are counted by exact token length. Whole passes
over the source come first; a bounded knapsack over the length counts fits the
rest of its budget to the greatest reachable sum (large budgets: after the same
fraction of each length). Documents of a length are picked in the order of a seeded
hash. Only length histograms enter the fitting (one group per source, its size
bounded by the longest text); documents are ranked within hash buckets, so a
source with any share of the rows is spread.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kasane.runtime import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of byte-level BPE (fixed value of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 256


def token_counter(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, digest, n_tokens); the source in lower case without outer blanks, null texts have 0 tokens.

    Texts leave the pipeline here: only their digest travels on.
    """
    source = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    rows = documents.select("doc_id", source.alias("source"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = token_counter(path)
        for pdf in batches:
            pdf["n_tokens"] = [sum(len(enc.encode_ordinary(p)) for p in blocks(t)) if t else 0 for t in pdf["text"]]
            yield pdf[["doc_id", "source", "digest", "n_tokens"]]

    return rows.mapInPandas(count, "doc_id long, source string, digest string, n_tokens long")


_BREAK = re.compile(r"(?<=\S)(?=\s\S)")


def blocks(text: str, size: int = 50_000) -> Iterator[str]:
    """Cuts a long text before a single blank, where no token can span."""
    at = 0
    while len(text) - at > size:
        m = _BREAK.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def fit(counts: dict[int, int], budget: int, whole: int = 1 << 14) -> dict[int, int]:
    """How many texts of each length to take so that the sum is the greatest reachable one up to budget.

    Up to ``whole`` tokens the knapsack runs over the whole budget. Above, the
    same fraction of each length is taken first and the knapsack fits a window
    of the rest; the window doubles until the sum meets the bound (budget
    rounded down to a multiple of the lengths' common divisor, which no sum can
    exceed) or covers the whole budget. Either way no sum is nearer.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    if budget <= 0 or not counts:
        return {}
    unit = math.gcd(*counts)
    bound = budget - budget % unit
    window = max(whole, 4 * max(counts))
    while window < budget:
        take, rest = _leave(counts, bound, total, window)
        chosen = knapsack({n: counts[n] - take[n] for n in counts}, rest)
        if sum(n * k for n, k in chosen.items()) == rest:
            return {n: k for n in counts if (k := take[n] + chosen.get(n, 0))}
        window *= 2
    return knapsack(counts, bound)


def _leave(counts: dict[int, int], budget: int, total: int, window: int) -> tuple[dict[int, int], int]:
    """The same fraction of each length, so that about ``window`` tokens are left to fit, and what is left."""
    aim = budget - window
    take = {n: max(0, aim) * c // total for n, c in counts.items()}
    rest = budget - sum(n * k for n, k in take.items())
    for n in sorted(counts, reverse=True):  # what rounding left, down to the window
        more = min(counts[n] - take[n], max(0, rest - window) // n)
        take[n] += more
        rest -= more * n
    return take, rest


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded subset sum: counts per length whose sum is the greatest reachable one up to budget.

    Reachable sums are the bits of one integer. Each sum remembers the stage
    that first reached it, so one small array is enough to read the choice back.
    """
    full = (1 << (budget + 1)) - 1
    reach, stages = 1, []
    first = np.zeros(budget + 1, np.int32)
    for n in sorted(counts, reverse=True):
        c = min(counts[n], budget // n) if n <= budget else 0
        part = 1
        while c > 0:
            k = min(part, c)
            wide = (reach | (reach << (n * k))) & full
            fresh = wide & ~reach
            stages.append((n, k))
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(stages)
            reach = wide
            c -= k
            part *= 2
        if reach >> budget & 1:
            break
    left = reach.bit_length() - 1
    out: dict[int, int] = {}
    while left:
        n, k = stages[first[left] - 1]
        out[n] = out.get(n, 0) + k
        left -= n * k
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(pdf["n_tokens"].astype(int), pdf["n"].astype(int)))
    budget, cap = int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0])
    total = sum(n * c for n, c in counts.items())
    passes = min(cap, budget // total) if total else 0
    extra = fit(counts, budget - passes * total) if passes < cap else {}
    rows = [(pdf["source"].iloc[0], n, passes, extra.get(n, 0)) for n in counts]
    return pd.DataFrame(rows, columns=["source", "n_tokens", "passes", "extra"])


class Mixture:
    """The mixture of one document table and one target table.

    Targets with a null or non-positive share or cap take no part. Sources
    without texts cannot be filled: they are reported with 0 and their share is
    spread over the others in proportion. A text under several ids is one text
    and belongs to the source of its smallest id. Texts without tokens and
    sources without a target stay out. ``total`` is the wanted number of tokens;
    unset, it is the largest total at which every source reaches its share.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER):
        spark = documents.sparkSession
        self.scratch = Scratch(spark, "mixing")
        self.targets = (
            targets.select(F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")).alias("source"), "target_share", "max_repeats")
            .where("source is not null and target_share > 0 and max_repeats > 0")
            .groupBy("source")
            .agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("long").alias("max_repeats"))
        )
        counted = with_tokens(documents, tokenizer).join(self.targets.select("source"), "source").where("n_tokens > 0")
        self.texts = self.scratch.save(
            counted.groupBy("digest")
            .agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("t"))
            .select("t.doc_id", "t.source", "t.n_tokens", F.xxhash64(F.lit(seed), "t.doc_id").alias("h"))
            .withColumn("bucket", F.pmod(F.shiftright("h", 40), F.lit(BUCKETS)).cast("int"))
        )
        self.shares = self._budgets(total)
        lengths = self.texts.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
        self.plan = self.scratch.save(
            lengths.join(self.shares, "source")
            .groupBy("source")
            .applyInPandas(_plan, "source string, n_tokens long, passes long, extra long")
        )

    def _budgets(self, total: int | None) -> DataFrame:
        """(source, target_share, max_repeats, tokens, budget); one row per target."""
        have = self.texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
        rows = self.targets.join(have, "source", "left").collect()
        live = [r for r in rows if r.tokens]
        whole = sum(r.target_share for r in live)
        if total is None:
            total = int(min((r.tokens * r.max_repeats * whole / r.target_share for r in live), default=0))
        out = [
            (r.source, r.target_share, r.max_repeats, r.tokens or 0, int(total * r.target_share / whole) if r.tokens else 0)
            for r in rows
        ]
        return self.texts.sparkSession.createDataFrame(
            out, "source string, target_share double, max_repeats long, tokens long, budget long"
        )

    def mixture(self) -> DataFrame:
        """(doc_id, source, n_tokens, copies), copies at least 1 and at most max_repeats."""
        by = ["source", "n_tokens"]
        sized = self.texts.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("k"))
        over = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
        base = sized.withColumn("base", F.coalesce(F.sum("k").over(over), F.lit(0))).drop("k")
        rank = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("h", "doc_id"))
        return (
            self.texts.withColumn("r", rank)
            .join(base.join(self.plan, by), [*by, "bucket"])
            .withColumn("copies", F.col("passes") + (F.col("base") + F.col("r") <= F.col("extra")).cast("long"))
            .where("copies > 0")
            .select("doc_id", "source", "n_tokens", "copies")
        )

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, budget, tokens, texts, most_copies) per target."""
        used = self.mixture().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("copies").alias("most_copies")
        )
        zero = lambda c: F.coalesce(c, F.lit(0))
        one = self.shares.drop("tokens").join(used, "source", "left").withColumn("tokens", zero(F.col("tokens")))
        whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
        return one.withColumn("whole", whole).select(
            "source", "target_share", zero(F.try_divide(F.col("tokens"), F.col("whole"))).alias("actual_share"), "budget", "tokens",
            zero(F.col("texts")).alias("texts"), zero(F.col("most_copies")).alias("most_copies"),
        )


def mix(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    return Mixture(documents, targets, **how).mixture()


def mix_report(documents: DataFrame, targets: DataFrame, **how) -> DataFrame:
    return Mixture(documents, targets, **how).report()
