"""Template residue and error-page text (fixed-depth prefix tree).

Sentences become masked token lists. A prefix tree of fixed depth (token count,
first tokens, then the likest template of the same verdict) mines message
templates in each task; a sentence has the verdict of its template, and
templates merge only where the verdict stays what it was for each sentence, so
it never depends on what else the corpus holds. The verdict comes from a linear
classifier (ridge regression in the dual) over words, word stems, word pairs
and Japanese character runs, fitted on a labelled sample of bounded size: an
unseen wording is judged by the words it shares with both sides.
Unfilled slots inside ordinary sentences are found separately by a grammar of
mirrored brackets; notations ordinary text uses too count for field names only,
those of the sample and those the corpus shows in several notations.

The corpus is read once. What is written are templates, slot names and the few
marked documents; slot names and documents meet in a join.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasane.llm import samples
from kasane.runtime import Scratch, shuffle_width

WILD = "<*>"
DEPTH = 3
LIKE = 0.55
SAMPLE = 5_000  # labelled sentences at most
LIMIT = 0.2  # score from which a sentence is residue
SHORT = (9.0, 0.6, 0.35)  # the same for no, one or two words (three Japanese characters count as one)

_INVISIBLE = re.compile("[​‌‍⁠﻿­]")
_TAG = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|div|span|center|b|i|em|strong|br|hr|a|ul|li|noscript)\b[^<>]*>", re.I)
_WRAP = re.compile(r"(?<=[a-z0-9,;°%])\n(?=[a-z]|[0-9]+ [a-z°%µ])(?![a-z]+ ?:)")
_PIECE = re.compile(r"(?<=[。!?！？])\s*|(?<=[a-z0-9)]\.)\s+|\n+|\s+[–|—]\s+|　+", re.I)
_TOKEN = re.compile(r"\x00|[0-9]+|[a-z'’_-]+|[ァ-ヶー]+|[぀-ゟ]+|[一-鿿々]+|[^\s]", re.I)
_CODE = re.compile(r"[a-h][0-9]{2}[a-z]\s*[0-9]+/[0-9]+|[0-9][a-z][0-9]{3}[a-z]{2}[0-9]+", re.I)
_ID = re.compile(r"\b(?=[0-9a-f]*[0-9])[0-9a-f]{6,}\b", re.I)
_DIGITS = re.compile(r"0?1234567890?")
_CJK = re.compile(r"[぀-ヿ一-鿿々]")
_AGAIN = re.compile(r"(.{1,5}?)\1{2,}")

# -- slots -------------------------------------------------------------------
_NAME = r"[A-Za-z぀-ヿ一-鿿][\w .-]{0,30}?|[0-9]{1,2}"
_SLOT = re.compile(rf"(\{{\{{\s*[#/]?|[$#]\{{|\{{[$%]?|<%=?|<<?|&lt;|%\(|%%?|@@?|\[\[?|__|\$|【|[○〇●◯]{{2,}}[（(])\s*({_NAME})\s*(\}}\}}|%?\}}|%>|>>?|&gt;|\)[sdrif]|%%?|@@?|\]\]?|__|\$|】|名?[）)][○〇●◯]{{2,}})")
_MIRROR = {"{{": "}}", "${": "}", "#{": "}", "{$": "}", "{%": "%}", "{": "}", "<%": "%>", "<%=": "%>", "<<": ">>", "<": ">", "&lt;": "&gt;", "%%": "%%", "%": "%", "@@": "@@", "@": "@", "[[": "]]", "[": "]", "__": "__", "$": "$", "【": "】"}
_WEAK = {"{", "<", "&lt;", "%", "@", "[[", "[", "__", "$", "【"}
_ASKED = re.compile(r"^(?:insert|enter|add|type|fill in|your)\s+(.+?)(?:\s+here)?$|^(.+?)\s+(?:to be (?:supplied|added|filled in|inserted|completed)|goes here|here|tbd)$|^(.+?)[をの]?(?:記入|入力|挿入)(?:する)?$", re.I)
_MARKED = re.compile(r"(?<![A-Za-z])X{3,}[-_ ]([A-Za-z]\w{0,30}?)[-_ ]X{3,}(?![A-Za-z])")
_QUOTED = re.compile(r"(?:\b(?:like|such as|e\.g\.,?|for example|called|named|written)|例：|例えば|例:|[「『“\"'‘`])\s*$", re.I)
_SUM = re.compile(r"[=∈+^_,]\s*$")


def fold(text: str | None) -> str:
    """Width folded, invisible characters gone; null is ''."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)) if text else ""


def sentences(text: str) -> list[str]:
    return [p for s in _PIECE.split(_TAG.sub("\n", _WRAP.sub(" ", text))) if s and (p := s.strip())]


def mask(sentence: str) -> list[str]:
    """Tokens with codes as NUL, numbers and identifiers as wild cards, a row of all digits as a word."""
    s = _DIGITS.sub(" digitrow ", sentence.lower())
    s = _ID.sub("0", _CODE.sub("\x00", s))
    return [WILD if t[0].isdigit() else t for t in _TOKEN.findall(s)]


def _grams(run: str) -> list[str]:
    """Character runs of a Japanese stretch."""
    r = f"^{run}$"
    out = [r[i : i + n] for n in (2, 3, 4) for i in range(len(r) - n + 1)]
    return [*out, "#again"] if _AGAIN.search(run) else out


def features(tokens: Sequence[str]) -> list:
    """Words and their stems, pairs of neighbours, Japanese character runs, and words said three times in a row."""
    out: list = []
    run, before, same = "", "^", 1
    for t in tokens:
        if t == before and t[0].isalpha():
            same += 1
            if same == 3:
                out.append("#again")
        else:
            same = 1
        if t[0] > "\u3000" and _CJK.match(t):
            run, before = run + t, "j"
            continue
        if run:
            out += _grams(run)
            run = ""
        if len(t) > 1 or t.isalnum() or t == "\x00":
            out.append(("w", t))
            if len(t) > 5:
                out.append(("p", t[:5]))
            out.append((before, t, "b"))
        before = t
    return out + _grams(run) if run else out


class Classifier:
    """Ridge regression on the labelled sample; the score is about 1 for residue and -1 for ordinary text."""

    def __init__(self, residue: Sequence[str], ordinary: Sequence[str], strength: float = 0.3, bias: float = 0.1):
        rows = [features(mask(fold(s))) for s in (*residue, *ordinary)]
        if len(rows) > SAMPLE:
            raise ValueError(f"more than {SAMPLE} labelled sentences")
        place: dict[str, int] = {}
        for r in rows:
            for f in r:
                place.setdefault(f, len(place))
        x = np.zeros((len(rows), len(place)))
        for i, r in enumerate(rows):
            np.add.at(x[i], [place[f] for f in r], 1 / max(4, len(r)) ** 0.5)
        y = np.array([1.0] * len(residue) + [-1.0] * len(ordinary))
        size = np.where(y > 0, 2 * len(residue), 2 * len(ordinary)) / len(y)  # both sides weigh the same
        dual = np.linalg.solve(x @ x.T + bias + np.diag(strength * size), y)
        self.weight = dict(zip(place, (x.T @ dual).tolist()))
        self.bias = float(bias * dual.sum())

        self.words: dict[str, tuple[float, int, bool, bool]] = {}

    def _word(self, t: str) -> tuple[float, int, bool, bool]:
        """(weight, features, Japanese, can repeat) of a token by itself."""
        if t[0] > "\u3000" and _CJK.match(t):
            out = (0.0, 0, True, t[0].isalpha())
        elif len(t) > 1 or t.isalnum() or t == "\x00":
            stem = len(t) > 5
            out = (self.weight.get(("w", t), 0.0) + (self.weight.get(("p", t[:5]), 0.0) if stem else 0.0), 1 + stem, False, t[0].isalpha())
        else:
            out = (0.0, 0, False, t[0].isalpha())
        if len(self.words) < 1 << 18:  # a cache, no limit of the vocabulary
            self.words[t] = out
        return out

    def score(self, tokens: Sequence[str]) -> float:
        """The weights of ``features(tokens)`` over the root of their number, without building them."""
        weight, words = self.weight.get, self.words
        total, n, run, before, same = 0.0, 0, "", "^", 1
        for t in tokens:
            own, count, wide, letter = words.get(t) or self._word(t)
            if t == before and letter:
                same += 1
                if same == 3:
                    total, n = total + weight("#again", 0.0), n + 1
            else:
                same = 1
            if wide:
                run, before = run + t, "j"
                continue
            if run:
                grams = _grams(run)
                total, n, run = total + sum([weight(g, 0.0) for g in grams]), n + len(grams), ""
            if count:
                total, n = total + own + weight((before, t, "b"), 0.0), n + count + 1
            before = t
        if run:
            grams = _grams(run)
            total, n = total + sum([weight(g, 0.0) for g in grams]), n + len(grams)
        return total / max(4, n) ** 0.5 + self.bias


@lru_cache(maxsize=1)
def classifier() -> Classifier:
    return Classifier(samples.lines(samples.RESIDUE), samples.lines(samples.ORDINARY))


@lru_cache(maxsize=1 << 15)
def judged(tokens: tuple[str, ...]) -> bool:
    """The verdict on masked tokens."""
    words = [t for t in tokens if t != WILD and len(t) > 1]
    size = len(words) + sum(len(t) // 3 for t in words if _CJK.match(t))
    return size > 0 and classifier().score(tokens) >= (SHORT[size] if size < len(SHORT) else LIMIT)


class Tree:
    """Message templates in a prefix tree of fixed depth."""

    def __init__(self) -> None:
        self.leaves: dict[tuple, list[list]] = defaultdict(list)  # entries: template, count, verdict

    @staticmethod
    def leaf(tokens: list[str]) -> tuple:
        head = tuple(WILD if t == WILD or any(c.isdigit() for c in t) else t for t in tokens[: DEPTH - 1])
        return (len(tokens), *head)

    def add(self, tokens: list[str], n: int = 1) -> bool:
        """The verdict of the sentence. Merges only what has one verdict, before and after; the rest gets an entry of its own."""
        leaf, verdict = self.leaves[self.leaf(tokens)], judged(tuple(tokens))
        best, at = 0.0, None
        for entry in leaf:
            if entry[2] == verdict:
                same = sum(a == b for a, b in zip(entry[0], tokens)) / len(tokens)
                if same > best:
                    best, at = same, entry
        if at is not None and best >= LIKE:
            merged = at[0] if best == 1 else [a if a == b else WILD for a, b in zip(at[0], tokens)]
            if merged == at[0] or judged(tuple(merged)) == verdict:
                at[0] = merged
                at[1] += n
                return verdict
        leaf.append([list(tokens), n, verdict])
        return verdict


def slots(text: str) -> Iterator[tuple[str, str, bool, int, int]]:
    """(notation, name, needs a known name, start, end) of the slots that are not spoken about.

    A slot is a name between mirrored bracket runs. Runs of one sign, double
    square brackets and double underscores occur in ordinary text and need a
    known name, unless the bracket asks for an entry (``[insert date here]``).
    """
    for m in _SLOT.finditer(text):
        opened, name, closed = m[1].rstrip(), m[2], m[3]
        opened = opened.rstrip("#/") if opened.startswith("{{") else opened
        circles = opened[0] in "○〇●◯"
        if not circles and (closed[:1] != ")" or closed[1:] not in tuple("sdrif") if opened == "%(" else _MIRROR.get(opened) != closed):
            continue
        before = text[max(0, m.start() - 16) : m.start()]
        if _QUOTED.search(before):
            continue
        asked = _ASKED.match(name) if opened in ("[", "【", "<", "{", "&lt;", "[[") else None
        weak = opened in _WEAK and asked is None
        if name.isdigit():
            weak = opened not in ("{", "{{", "${") or bool(_SUM.search(before))
            if weak:
                continue
        elif weak and opened == "<" and not (name.isupper() and len(name) > 2 or " " in name):
            continue  # a tag
        if asked:
            name = next(g for g in asked.groups() if g)
        yield ("circles" if circles else opened), re.sub(r"[\s_]+", "_", name.strip().lower()), weak, m.start(), m.end()
    for m in _MARKED.finditer(text):
        yield "marked", m[1].lower(), False, m.start(), m.end()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass: marked documents as they come, this task's templates and slot names at the end."""
    tree, names = Tree(), Counter()
    columns = ["kind", "doc_id", "text", "name", "size", "head", "n"]
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            whole = fold(text)
            found = list(slots(whole)) if not whole.isalnum() else []
            names.update({(kind, name) for kind, name, *_ in found})
            if any(not weak for _, _, weak, *_ in found):
                rows.append(("slot", doc, None, None, 0, "", 1))
            rows += [("weak", doc, None, name, 0, "", 1) for name in {name for _, name, weak, *_ in found if weak}]
            for *_, a, b in reversed(found):
                whole = whole[:a] + " " + whole[b:]
            hit = False
            for s in sentences(whole):
                tokens = mask(s)
                if tokens:
                    hit |= tree.add(tokens)
            if hit:
                rows.append(("template", doc, None, None, 0, "", 1))
        yield pd.DataFrame(rows, columns=columns)
    rows = [("mined", None, _JOIN.join(t), str(v), len(t), " ".join(leaf[1:]), n) for leaf, ts in tree.leaves.items() for t, n, v in ts]
    rows += [("name", None, kind, name, 0, "", n) for (kind, name), n in names.items()]
    yield pd.DataFrame(rows, columns=columns)


_JOIN = "\x1f"


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Templates of whole leaves, the commonest first, to merged ones."""
    tree = Tree()
    for pdf in batches:
        for text, n in zip(pdf["text"], pdf["n"]):
            tree.add(text.split(_JOIN), n)
    rows = [(_JOIN.join(t), n, verdict) for ts in tree.leaves.values() for t, n, verdict in ts]
    yield pd.DataFrame(rows, columns=["template", "n", "residue"])


class Residue:
    """Templates, verdicts and marked documents of one corpus."""

    def __init__(self, documents: DataFrame):
        self.scratch = Scratch(documents.sparkSession, "residue")
        self.width = max(shuffle_width(documents.sparkSession), documents.sparkSession.sparkContext.defaultParallelism)
        self.found = self.scratch.save(
            documents.select("doc_id", "text").mapInPandas(_scan, "kind string, doc_id long, text string, name string, size int, head string, n long")
        )

    def templates(self) -> DataFrame:
        """(template, n, residue): the message templates of the corpus, their sentences counted."""
        local = self.found.where("kind = 'mined'").groupBy("text", "size", "head").agg(F.sum("n").alias("n"))
        leaves = local.repartition(self.width, "size", "head").sortWithinPartitions(F.desc("n"), "text")  # whole leaves per task
        return leaves.mapInPandas(_merge, "template string, n long, residue boolean")

    def reasons(self) -> DataFrame:
        """(doc_id, reason) with reason template or slot; one row per document and reason."""
        used = self.found.where("kind = 'name'").groupBy("name").agg(F.countDistinct("text").alias("kinds")).where("kinds >= 3").select("name")
        known = used.unionByName(used.sparkSession.createDataFrame([(n,) for n in samples.SLOT_NAMES], "name string")).distinct()
        weak = self.found.where("kind = 'weak'").join(known, "name", "left_semi").select("doc_id", F.lit("slot").alias("reason"))
        sure = self.found.where("kind in ('slot', 'template')").select("doc_id", F.col("kind").alias("reason"))
        return sure.unionByName(weak).distinct()


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of documents with unfilled fields, filler, error messages or script notices.

    Null and empty texts hold none; repeated texts are reported under each id;
    an empty table gives an empty result; extra columns are ignored.
    """
    return Residue(documents).reasons().select("doc_id").distinct()


def clean_documents(documents: DataFrame) -> DataFrame:
    """The documents without residue, all columns kept."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")
