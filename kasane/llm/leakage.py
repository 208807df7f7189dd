"""Evaluation texts leaking into training text (pigeonhole edit matching).

Texts are compared as the bare stream of their letters and digits (markup,
width, case, punctuation and spacing gone). Every run of two fifths of a
passage has an error budget of e changed places; the passage is split on a grid
into pieces so short that any such run holds e + 1 whole ones, so one of them
stands in the document unchanged (pigeonhole). Exact piece hits name the
candidates (document, passage); a count of shared grams that every true
repetition must reach (the q-gram lemma) drops the chance ones; what is left
is aligned, the gaps measured with Myers' bit-parallel distance, and the
longest run within the error rate decides.

Documents are read once, where they lie: no shuffle, no pairs. Piece and gram
hits are found for a whole batch of documents at a time with rolling hashes.
The held-out items are the stated query set; they are broadcast in blocks of
bounded size. No piece is left out for being common: identical passages form
one class, and every item of the class is reported.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<[/!]?[A-Za-z][^<>]*>")
_BARE = re.compile(r"[\W_]+")
_SPLIT = re.compile(r"(?<=[.?!。？！:：])\s*")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_WORD = re.compile(r"\S+")


def bare(text: str | None) -> str:
    """Letters and digits only, width and case folded; null is ''."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    return _BARE.sub("", unicodedata.normalize("NFKC", text).casefold())


def distance(pattern: str, text: str) -> int:
    """Edit distance by Myers' bit vectors (one Python integer per column)."""
    m = len(pattern)
    if not m or not text:
        return m or len(text)
    peq: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        peq[ch] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for ch in text:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph, mh = (ph << 1) | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
    return score


# -- question frames ---------------------------------------------------------
DEEP = 3  # sentences of a frame looked at on each side


def _sentences(text: str | None) -> list[str]:
    return [p for p in _SPLIT.split(text or "") if bare(p)]


def _grams(text: str, n: int = 4) -> set[str]:
    return {text[i : i + n] for i in range(max(1, len(text) - n + 1))}


def unlike(contexts: list[str], more: list[str], most: int) -> list[str]:
    """Adds texts to a list of mutually unlike ones (under half of the grams shared) until it holds ``most``."""
    for c in more:
        if len(contexts) >= most:
            break
        g = _grams(c)
        if all(2 * len(g & o) < min(len(g), len(o)) for o in map(_grams, contexts)):
            contexts.append(c)
    return contexts


def frame_sentences(items: DataFrame, shared: int) -> set[tuple[int, str]]:
    """(side, bare sentence) of the question frames, learned over all items.

    A sentence near the start (end) belongs to the frame where the sentences
    after (before) it are of ``shared`` mutually unlike kinds: a question put to
    different passages. Several questions on one passage, or on variants of it,
    always show the same continuation and make no frame of it. Contexts are
    reduced per task to ``shared`` unlike ones before the shuffle.
    """

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, str], list[str]] = defaultdict(list)
        for pdf in batches:
            for text in pdf["text"]:
                parts = [bare(p) for p in _sentences(text)]
                for side, row in ((0, parts), (1, parts[::-1])):
                    for k, s in enumerate(row[:DEEP]):
                        if k + 1 < len(row):  # two sentences: the next may be a label of the same frame
                            unlike(seen[side, s], ["".join(row[k + 1 : k + 3])], shared)
        rows = [(side, s, c) for (side, s), cs in seen.items() for c in cs]
        yield pd.DataFrame(rows, columns=["side", "sentence", "context"])

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(unlike([], sorted(pdf["context"]), shared))
        return pdf[["side", "sentence"]].head(1 if n >= shared else 0)

    found = (
        items.select("text")
        .mapInPandas(contexts, "side int, sentence string, context string")
        .groupBy("side", "sentence")
        .applyInPandas(decide, "side int, sentence string")
    )
    return {(r.side, r.sentence) for r in found.collect()}  # at most two sentences per ``shared`` items


def passage(text: str | None, frames: set[tuple[int, str]], most: float = 0.5) -> list[str]:
    """The words (outside Japanese: by blanks) of the passage in bare form, frame sentences cut.

    At most the share ``most`` of an item is cut; an item that is all frame stays whole.
    """
    parts = _sentences(text)
    room = most * sum(len(bare(p)) for p in parts)
    for side in (0, 1):
        for _ in range(DEEP):
            at = -1 if side else 0
            size = len(bare(parts[at])) if parts else 0
            if len(parts) < 2 or (side, bare(parts[at])) not in frames or size > room:
                break
            room -= size
            del parts[at]
    return [w for p in parts for t in _WORD.findall(_TAG.sub("", html.unescape(p))) if (w := bare(t))]


# -- rolling hashes ----------------------------------------------------------
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24)


def rolled(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` characters (by doubling, wrapping at 64 bits)."""
    have, width, shift = codes.astype(np.uint64), 1, 1
    out, done = None, 0
    with np.errstate(over="ignore"):
        power = _BASE
        left = size
        while left:
            if left & 1:
                if out is None:
                    out, done = have, width
                else:
                    n = len(codes) - done - width + 1
                    if n <= 0:
                        return np.zeros(0, np.uint64)
                    out = out[:n] * power + have[done : done + n]
                    done += width
            left >>= 1
            if left:
                n = len(have) - width
                if n <= 0:
                    return np.zeros(0, np.uint64)
                have = have[:n] * power + have[width : width + n]
                width *= 2
                power = power * power
        out = out * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Lookup:
    """Places of hashes in a sorted list, by a bit table first."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.bits = max(10, min(24, int(len(self.keys)).bit_length() + 4))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, indexes of their keys)."""
        at = np.flatnonzero(self.table[(hashes & self.mask).astype(np.int64)])
        where = np.searchsorted(self.keys, hashes[at])
        where[where == len(self.keys)] = 0
        right = self.keys[where] == hashes[at]
        return at[right], where[right]


class Matcher:
    """Pieces, grams and verification for one block of items."""

    GRAM = ((6, 12), (4, 7))  # shared grams counted: running Latin, Japanese
    REACH = 48  # characters a run may grow beyond its outer literal blocks
    BLOCK = (12, 6)  # literal blocks that verification starts from

    def __init__(self, items: list[tuple[int, list[str]]], part: float, rates: tuple[float, float]):
        self.part, self.rates = part, rates
        self.floor = part - 0.02  # two fifths may be counted in words or characters: the room for that
        classes: dict[str, list[int]] = defaultdict(list)
        words: dict[str, list[str]] = {}
        for i, w in items:
            text = "".join(w)
            if text:
                classes[text].append(i)
                words[text] = w
        self.text = sorted(classes)
        self.items = [classes[t] for t in self.text]
        self.wide = [len(_CJK.findall(t)) * 3 > len(t) for t in self.text]
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)  # size: (class, offset)
        self.run, self.need = [], []
        for c, t in enumerate(self.text):
            rate = rates[self.wide[c]]
            starts, budget = self._pieces(t, words[t], rate)
            for a, b in zip(starts, starts[1:]):
                size = max(s for s in SIZES if s <= b - a)
                seeds[size].append((c, a))
            run = max(1, int(self.floor * len(t)))
            self.run.append(run)
            self.need.append([run - g + 1 - budget * (g - 1) - int(rate * run + 1) for g in self.GRAM[self.wide[c]]])
        self.seeds = {}
        for size, spots in seeds.items():
            h = np.array([rolled(codes_of(self.text[c][a : a + size]), size)[0] for c, a in spots], np.uint64)
            look = Lookup(h)
            key = np.searchsorted(look.keys, h)
            order = np.argsort(key, kind="stable")
            owner = np.array([spots[k][0] for k in order], np.int64)
            first = np.searchsorted(key[order], np.arange(len(look.keys) + 1))
            self.seeds[size] = (look, first, owner)
        self.grams = {}
        self.row = np.zeros(len(self.text), np.int64)
        self.least: dict[bool, np.ndarray] = {}
        for w in set(self.wide):
            mine = [c for c in range(len(self.text)) if self.wide[c] == w]
            self.row[mine] = np.arange(len(mine))
            self.least[w] = np.array([self.need[c][1] for c in mine])
            for k in (0, 1):
                per = [rolled(codes_of(self.text[c]), self.GRAM[w][k]) for c in mine]
                look = Lookup(np.concatenate([*per, np.zeros(1, np.uint64)]))
                table = np.full((len(mine), max(map(len, per))), len(look.keys), np.int32)  # padded with a gram no document has
                for r, h in enumerate(per):
                    table[r, : len(h)] = np.searchsorted(look.keys, h)
                self.grams[w, k] = (look, table)
        self.spots: dict[int, dict[str, list[int]]] = {}

    def _pieces(self, text: str, words: list[str], rate: float) -> tuple[list[int], int]:
        """Borders of the pieces and the error budget of a run.

        Units are words, in Japanese characters. A run of u units with at most
        e changed ones holds (u + 1) // w - 1 whole pieces of w units; w is the
        largest size for which that is e + 1 or more.
        """
        if len(_CJK.findall(text)) * 3 > len(text):
            ends = list(range(len(text) + 1))
        else:
            ends = [0]
            for w in words:
                ends.append(ends[-1] + len(w))
        run = max(1, int(self.floor * (len(ends) - 1)))
        budget = int(rate * run) + 1
        step = max(1, (run + 1) // (budget + 2))
        return ends[::step] if len(ends) > step else [0, ends[-1]], budget  # whole pieces only

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        """Per document the items it repeats."""
        bares = [bare(t) for t in texts]
        out: list[list[int]] = [[] for _ in texts]
        if not self.text:
            return out
        joined = "\0".join(bares) + "\0"
        codes = codes_of(joined)
        start = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bares])])
        found = []
        for size, (look, first, owner) in self.seeds.items():
            at, key = look.find(rolled(codes, size))
            doc = np.searchsorted(start, at, "right") - 1
            n = first[key + 1] - first[key]
            pair = np.repeat(doc, n) * len(self.text)
            jump = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.unique(pair + owner[np.repeat(first[key], n) + jump]))
        pairs = np.unique(np.concatenate(found))
        docs, classes = pairs // len(self.text), pairs % len(self.text)
        self.seen = len(pairs)
        hits = {}
        for (w, k), (look, _) in self.grams.items():
            at, key = look.find(rolled(codes, self.GRAM[w][k]))
            hits[w, k] = (np.searchsorted(at, start), key, np.zeros(len(look.keys) + 1, bool))
        self.kept = 0
        wide = np.array(self.wide)[classes]
        edges = np.flatnonzero(np.diff(docs, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d = int(docs[lo])
            for edge, key, flag in hits.values():
                flag[key[edge[d] : edge[d + 1]]] = True
            for w in self.least:
                some = classes[lo:hi][wide[lo:hi] == w]
                if not len(some):
                    continue
                rows = self.row[some]  # all candidates of the document in one gather
                shared = hits[w, 1][2][self.grams[w, 1][1][rows]].sum(1)
                for c in some[shared >= self.least[w][rows]].tolist():
                    if all(self._shares(c, k, hits[w, k][2]) for k in (1, 0)):
                        self.kept += 1
                        if self.repeats(c, bares[d]):
                            out[d] += self.items[c]
            for edge, key, flag in hits.values():
                flag[key[edge[d] : edge[d + 1]]] = False
        return out

    def _shares(self, c: int, k: int, flag: np.ndarray) -> bool:
        """Has any run of the passage as many grams in the document as the allowed changes must leave?"""
        w, need = self.wide[c], self.need[c][k]
        if need <= 0:
            return True
        have = flag[self.grams[w, k][1][self.row[c]]]
        span = self.run[c] - self.GRAM[w][k] + 1
        if np.count_nonzero(have) < need:
            return False
        if len(have) <= span:
            return True
        total = np.cumsum(have, dtype=np.int32)
        return int((total[span:] - total[:-span]).max(initial=0)) >= need or int(total[span - 1]) >= need

    # -- verification ------------------------------------------------------
    def repeats(self, c: int, doc: str) -> bool:
        """Does the document hold a run of the passage within the error rate?"""
        passage, rate = self.text[c], self.rates[self.wide[c]]
        n = min(self.BLOCK[self.wide[c]], len(passage))
        spots = self.spots.get(c)
        if spots is None:
            spots = defaultdict(list)
            for p in range(len(passage) - n + 1):
                spots[passage[p : p + n]].append(p)
            self.spots[c] = spots
        hits = [(d, p, n) for d in range(len(doc) - n + 1) for p in spots.get(doc[d : d + n], ())]
        want = self.floor * len(passage)
        for chain in self._chains(hits, len(passage)):
            if chain[-1][3] - chain[0][2] + 2 * self.REACH < want:
                break  # chains come in falling order of span
            if self._run(passage, doc, chain, rate, want):
                return True
        return False

    @staticmethod
    def _chains(hits: list[tuple[int, int, int]], whole: int) -> Iterator[list[list[int]]]:
        """Hits joined to blocks (doc start, doc end, passage start, passage end), chained along rising positions."""
        blocks: dict[int, list[list[int]]] = defaultdict(list)
        for d, p, n in sorted(hits):
            lane = blocks[d - p]
            if lane and d <= lane[-1][1]:
                lane[-1][1], lane[-1][3] = d + n, p + n
            else:
                lane.append([d, d + n, p, p + n])
        flat = sorted((b for lane in blocks.values() for b in lane), key=lambda b: (b[0], b[2]))
        chains: list[list[list[int]]] = []
        for b in flat:
            for c in reversed(chains):
                last = c[-1]
                gap_d, gap_p = b[0] - last[1], b[2] - last[3]
                over = max(0, -min(gap_d, gap_p))
                if b[1] > last[1] and b[3] > last[3] and over < b[1] - b[0] and gap_d <= whole // 3 + 40 and abs(gap_d - gap_p) <= 30 + whole // 8:
                    c.append([b[0] + over, b[1], b[2] + over, b[3]])
                    break
            else:
                chains.append([b])
        return iter(sorted(chains, key=lambda c: -(c[-1][3] - c[0][2])))

    @staticmethod
    def _gap(want: str, have: str, rate: float) -> float:
        """Cost of a gap; in running Latin text a replaced word costs a word, however long its substitute."""
        cost = distance(want, have)
        if rate < 0.1:
            return cost
        return min(cost, max(len(want), 6) + max(0, len(have) - len(want) - 14))

    def _run(self, passage: str, text: str, chain: list[list[int]], rate: float, want: float) -> bool:
        """Is a run of blocks, its ends grown, within the error rate and as long as wanted?"""
        n = len(chain)
        total = [0.0] * n  # errors up to block k
        for k in range(1, n):
            a, b = chain[k - 1], chain[k]
            total[k] = total[k - 1] + self._gap(passage[a[3] : b[2]], text[a[1] : b[0]], rate)
        for i in range(n):
            for j in range(n - 1, i - 1, -1):
                size = chain[j][3] - chain[i][2]
                if size + min(self.REACH, chain[i][2]) + min(self.REACH, len(passage) - chain[j][3]) < want:
                    if size + 2 * self.REACH < want:
                        break
                    continue
                errors = total[j] - total[i]
                if errors <= rate * size + 1:
                    if size >= want or self._extend(passage, text, chain[i], chain[j], size, errors, rate, self.REACH) >= want:
                        return True
                    break
        return False

    @staticmethod
    def _extend(passage: str, text: str, first: list[int], last: list[int], size: int, errors: float, rate: float, reach: int) -> int:
        """Grows the run over changed ends while the error rate holds."""
        for side in (0, 1):
            if side:
                p, t = passage[last[3] : last[3] + reach], text[last[1] : last[1] + reach + 12]
            else:
                p, t = passage[max(0, first[2] - reach) : first[2]][::-1], text[max(0, first[0] - reach - 12) : first[0]][::-1]
            row = list(range(len(t) + 1))
            gain, spent = 0, 0
            for x, ch in enumerate(p, 1):
                nxt, last_, slant = [x], x, row[0]
                for above, other in zip(row[1:], t):
                    cost = slant if ch == other else slant + 1
                    if above < cost:
                        cost = above + 1
                    if last_ < cost:
                        cost = last_ + 1
                    nxt.append(cost)
                    last_, slant = cost, above
                row, low = nxt, min(nxt)
                if errors + low > rate * (size + len(p)) + 1:
                    break  # costs only rise
                # the grown end must itself be mostly repeated text
                if low <= 0.5 * x and errors + low <= rate * (size + x) + 1:
                    gain, spent = x, low
            size, errors = size + gain, errors + spent
        return size


def leaked(
    documents: DataFrame,
    items: DataFrame,
    part: float = 0.4,
    rates: tuple[float, float] = (0.13, 0.07),
    shared: int = 6,
    block: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id) where the document repeats at least ``part`` of the item's passage.

    ``rates``: changed share of a run allowed in running (Latin, Japanese)
    text: one word in ten and one character in twenty, with room for words
    longer than average; the piece length follows from it. ``shared``: unlike
    passages a question sentence must be put to. ``block``: items handed to the
    executors at a time (all their statistics are those of all items, so the
    rows do not depend on it); each block reads the documents once. Null and
    empty texts match nothing; repeated items and documents are each reported
    under their own id; extra columns are ignored.
    """
    spark = documents.sparkSession
    held = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    frames = frame_sentences(held, shared)

    def scan_with(some: list[tuple[int, list[str]]]) -> DataFrame:
        index = spark.sparkContext.broadcast((some, part, rates))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(*index.value)
            for pdf in batches:
                texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
                for at, to in slices(texts):
                    rows = [(d, i) for d, found in zip(ids[at:to], matcher.batch(texts[at:to])) for i in found]
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        return documents.select("doc_id", "text").mapInPandas(scan, "doc_id long, item_id long")

    out, some = None, []
    for row in held.toLocalIterator():  # the driver holds one block
        some.append((row.item_id, passage(row.text, frames)))
        if len(some) == block:
            one, some = scan_with(some), []
            out = one if out is None else out.unionByName(one)
    if some or out is None:
        one = scan_with(some)
        out = one if out is None else out.unionByName(one)
    return out


def slices(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded total length (a longer text stands alone)."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
