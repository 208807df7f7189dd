"""Garbled text from wrong character encoding.

1. Twins. Texts of one place (same record text once non-ASCII characters are
   stripped, or same pure-ASCII values around the field) are grouped; the
   commonest text of a place stands for it and every other text of the place
   is paired with it: one pair per text, never all pairs of a group.
2. Alignment. The pair is aligned from both ends, and the bytes of the clean
   middle, in each encoding texts are kept in, with the characters of the
   garbled one. The byte - character mapping names the codec of the runtime
   that agrees with it; a mapping none agrees with is itself learned, byte by
   byte, from all pairs. The readings that explain pairs are the learned
   transformations, with their support, and the characters they leave behind
   that clean texts never hold are the learned damage marks.
3. Application. Every distinct text is searched for stretches that a learned
   transformation turns back into characters known from clean texts; texts with
   damage marks that no longer turn back are reported without an original.

Work is per distinct text. Only the learned tables (readings, characters: both
bounded by the code tables, not by the data) reach the driver.
"""

from __future__ import annotations

import codecs
import encodings.aliases
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasane.runtime import Scratch, shuffle_width

#: Encodings texts are kept in (fixed values).
RIGHT = ("utf-8", "cp932", "euc_jp", "iso2022_jp", "utf-16-le", "utf-16-be")
#: Valid multi-byte stretches of each encoding, as Latin-1 text (fixed values).
_VALID = {
    "utf-8": re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})+"),
    "cp932": re.compile("(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])+"),
    "euc_jp": re.compile("(?:[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf])+"),
    "iso2022_jp": re.compile("(?:\x1b?\\$[@B](?:[!-~]{2})+\x1b?\\([BJ])+"),
    "utf-16-le": re.compile("^(?:[\x00-\xff][\x00-\xff])+$", re.S),
    "utf-16-be": re.compile("^(?:[\x00-\xff][\x00-\xff])+$", re.S),
}
_BARE_ESCAPE = re.compile(r"(?<!\x1b)(?=\$[@B](?:[!-~]{2})+\x1b?\([BJ])|(?<!\x1b)(?=\([BJ])")
#: ASCII text that can be garbled: Japanese in seven bits (fixed value).
SEVEN = r"\$[@B]([!-~]{2})+\x1b?\([BJ]"
_SEVEN = re.compile(SEVEN)
#: Runtime codecs that are no character encodings of files or depend on marks (fixed values).
_LEFT_OUT = {"utf_7", "utf_16", "utf_32", "utf_16_be", "utf_16_le", "utf_32_be", "utf_32_le", "idna", "punycode", "mbcs", "oem", "ascii", "tactis", "utf_8", "utf_8_sig", "hz"}
#: Names tried first where several agree on the bytes seen (fixed values).
_FIRST = ("latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "cp1251", "cp1250", "cp932", "gb18030", "euc_jp", "cp949", "cp950", "utf-8")


@lru_cache(maxsize=1)
def runtime_codecs() -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(single-byte, multi-byte) codecs of the runtime by which texts can have been read."""
    names = {n for n in encodings.aliases.aliases.values() if n not in _LEFT_OUT and not n.startswith("iso2022")}
    ascii_, one, many = "".join(map(chr, range(32, 127))), [], []
    for name in [*_FIRST, *sorted(names - {codecs.lookup(n).name.replace("-", "_") for n in _FIRST} - {"latin_1", "iso8859_1"})]:
        try:
            read = lambda data: data.decode(name, "replace")  # noqa: B023, E731
            if not codecs.lookup(name)._is_text_encoding or read(ascii_.encode()) != ascii_:
                continue
            single = all(len(read(bytes([b, 65]))) == 2 and len(read(bytes([b, b]))) == 2 for b in range(128, 256))
        except (LookupError, ValueError):
            continue
        (one if single and name != "utf-8" else many).append(name)
    return tuple(one), tuple(many)


def encode(text: str, right: str) -> bytes | None:
    try:
        return text.encode(right)
    except UnicodeEncodeError:
        return None


def decode(data: bytes, right: str) -> str | None:
    """The text of the bytes; lost escapes of seven-bit text are put back."""
    try:
        if right == "iso2022_jp":
            data = _BARE_ESCAPE.sub("\x1b", data.decode("latin-1")).encode("latin-1")
        return data.decode(right)
    except UnicodeDecodeError:
        return None


_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")


def unescape(text: str) -> str:
    """Literal backslash-u escapes left in a text become their characters."""
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "\\u" in text else text


def _nul(error: UnicodeError) -> tuple[bytes, int]:
    return b"\x00" * (error.end - error.start), error.end


codecs.register_error("kasane.nul", _nul)


class _Table(dict):
    def __missing__(self, key: int) -> str:
        return "\x00"


class Reader:
    """Characters to bytes and back for one codec, single bytes without a character kept as themselves.

    A learned table (byte to character) stands for a codec the runtime does not know.
    """

    def __init__(self, codec: str, learned: dict[int, str] | None = None):
        self.codec = codec
        self.table: dict[str, bytes | None] = {}
        self.chars: list[str] | None = None
        if learned is not None or codec in runtime_codecs()[0]:
            self.chars = []
            for b in range(256):
                if learned is not None:
                    ch = learned.get(b, chr(b) if b < 128 else "\x00")
                else:
                    try:
                        ch = bytes([b]).decode(codec)
                    except UnicodeDecodeError:
                        ch = chr(b)
                self.chars.append(ch)
                self.table.setdefault(ch, bytes([b]))
            self.flat = _Table({ord(ch): chr(b[0]) for ch, b in self.table.items()})

    @property
    def single(self) -> bool:
        return self.chars is not None

    def read(self, data: bytes) -> str:
        """What a lossy decoder makes of the bytes."""
        if self.chars is not None:
            return "".join(self.chars[b] for b in data)
        return data.decode(self.codec, "replace")

    def one(self, ch: str) -> bytes | None:
        try:
            return self.table[ch]
        except KeyError:
            try:
                out = ch.encode(self.codec) if self.chars is None else None
            except UnicodeEncodeError:
                out = None
            self.table[ch] = out
            return out

    def bytes_of(self, text: str) -> str:
        """Bytes as Latin-1 text; characters the codec lacks become NUL."""
        if self.chars is not None:
            return text.translate(self.flat)
        return text.encode(self.codec, "kasane.nul").decode("latin-1")

    def unread(self, text: str) -> tuple[str, list[int]]:
        """The same with the start of each character."""
        parts, at, n = [], [], 0
        for ch in text:
            b = self.one(ch) or b"\x00"
            at.append(n)
            n += len(b)
            parts.append(b)
        at.append(n)
        return b"".join(parts).decode("latin-1"), at


@lru_cache(maxsize=None)
def reader(codec: str) -> Reader:
    return Reader(codec)


@lru_cache(maxsize=1)
def _agreeing() -> dict[tuple[int, str], int]:
    """(byte, character) to the single-byte codecs that read it so, as bits in order of preference."""
    out: dict[tuple[int, str], int] = defaultdict(int)
    for k, name in enumerate(runtime_codecs()[0]):
        for b, ch in enumerate(reader(name).chars):
            out[b, ch] |= 1 << k
    return out


def middles(clean: str, garbled: str) -> Iterator[tuple[str, str]]:
    """The differing middle of an aligned pair, then with a little context."""
    n, top = 0, min(len(clean), len(garbled))
    while n < top and clean[n] == garbled[n]:
        n += 1
    m = 0
    while m < top - n and clean[-1 - m] == garbled[-1 - m]:
        m += 1
    for more in (0, 1, 2):
        a, b = max(0, n - more), max(0, m - more)
        yield clean[a : len(clean) - b], garbled[a : len(garbled) - b]


def aligned(data: bytes, text: str) -> dict[int, str] | None:
    """Byte to character where the text has one character a byte and reads equal bytes alike, ASCII as itself; lost ones left out."""
    if len(data) != len(text) or 2 * text.count("�") > len(text):
        return None
    out: dict[int, str] = {}
    for b, ch in zip(data, text):
        if ch == "�":
            continue
        if out.setdefault(b, ch) != ch or (31 < b < 127 and ch != chr(b)):
            return None
    return out


def explain(clean: str, garbled: str) -> tuple[str, str, dict[int, str] | None] | None:
    """(right, wrong, bytes): how the clean middle became the garbled one.

    The bytes of the clean middle in each encoding are aligned with the garbled
    characters. One character a byte: the mapping names every runtime codec
    that agrees with it, the preferred one is taken; where none agrees the
    mapping itself is the evidence (``wrong`` is ''). Otherwise the multi-byte
    codecs are tried, lost bytes dropped or marked.
    """
    one, many = runtime_codecs()
    for a, b in middles(clean, garbled):
        if not a or not b or a.isascii():
            continue
        tables = []
        for right in RIGHT:
            data = encode(a, right)
            if data is None:
                continue
            if right == "iso2022_jp":
                if b.replace("\x1b", "") == data.decode("latin-1").replace("\x1b", ""):
                    return right, "latin-1", None
                continue
            table = aligned(data, b)
            if table is not None:
                which = -1
                for pair in table.items():
                    which &= _agreeing().get(pair, 0)
                    if not which:
                        break
                if which > 0:
                    return right, one[(which & -which).bit_length() - 1], None
                if len(table) < len(data) and len(set(table.values())) == len(table) >= 3:
                    tables.append((right, "", table))
            size = len(data)
            if right.startswith("utf-16") or not size // 4 <= len(b) <= size:
                continue
            for wrong in many:
                if wrong == right:
                    continue
                made = data.decode(wrong, "replace")
                bare = made.replace("�", "")
                if made == b or (len(bare) > 1 and 2 * len(bare) >= len(b) and bare == b.replace("�", "")):
                    return right, wrong, None
        if tables:
            return tables[0]
    return None


def _marks(text: str) -> set[str]:
    """Characters no writer types: replacement, C1 controls, private use, unassigned."""
    return {c for c in text if c == "�" or (ord(c) > 126 and unicodedata.category(c) in ("Cc", "Co", "Cn"))}


class Model:
    """Learned readings, damage marks and the character counts of clean texts."""

    def __init__(self, readings: list[tuple[str, str]], marks: set[str], chars: dict[str, int], seen: set[str] = frozenset(), learned: dict[str, dict[int, str]] | None = None):
        self.readings, self.marks, self.chars, self.learned = readings, marks, chars, learned or {}
        self.readers: dict[str, Reader] = {}
        # characters of clean texts that no explained wrong reading ever made: text of these alone is sound
        self.sound = {c for c, n in chars.items() if n >= 5 and c not in seen}
        self.total = max(1, sum(chars.values()))

    def reader(self, wrong: str) -> Reader:
        if wrong not in self.readers:
            self.readers[wrong] = Reader(wrong, self.learned[wrong]) if wrong in self.learned else reader(wrong)
        return self.readers[wrong]

    def score(self, text: str) -> float:
        wide = [c for c in text if ord(c) > 127]
        return sum(math.log10((self.chars.get(c, 0) + 0.05) / self.total) for c in wide) / len(wide) if wide else 0.0

    def undo(self, text: str, right: str, wrong: str, loose: bool = False) -> tuple[str, int]:
        """(text with the accepted stretches turned back, characters turned back)."""
        flat = self.reader(wrong).bytes_of(text)
        if not any(m.end() - m.start() > 1 for m in _VALID[right].finditer(flat)):
            return text, 0
        flat, at = self.reader(wrong).unread(text)
        out, done, turned = [], 0, 0
        starts = None
        for m in _VALID[right].finditer(flat):
            if m.end() - m.start() < 2:
                continue
            back = decode(m[0].encode("latin-1"), right)
            if back is None:
                continue
            if starts is None:
                starts = {b: i for i, b in enumerate(at)}
            i = starts.get(m.start())
            j = starts.get(m.end())
            ragged = (i is None) + (j is None)
            if i is None:
                i = next(k for k, b in enumerate(at) if b > m.start()) - 1
            if j is None:
                j = next(k for k, b in enumerate(at) if b > m.end())
            if not loose and not self._accept(text, i, j, back, right, wrong, ragged):
                continue
            out += [text[done:i], back]
            done, turned = j, turned + len(back)
        return "".join(out) + text[done:], turned

    def _accept(self, text: str, i: int, j: int, back: str, right: str, wrong: str, ragged: int) -> bool:
        old = text[i:j]
        wide = [c for c in back if ord(c) > 127]
        if not wide or back == old or _marks(back) - set(old):
            return False
        strong = [c for c in wide if self.chars.get(c, 0) > 0]
        if len(strong) < 0.7 * len(wide):
            return False
        if right in ("iso2022_jp", "utf-16-le", "utf-16-be"):
            return not ragged and (right == "iso2022_jp" or len(strong) > 1)
        if right == "utf-8" and self.reader(wrong).single:
            return True  # multi-byte sequences of known characters do not arise in text of single letters
        if right == "utf-8":
            rest = [c for c in text[:i] + text[j:] if ord(c) > 127]
            least = 1 if not rest and not ragged else 3
        else:
            two = sum(1 for c in wide if not "｡" <= c <= "ﾟ")
            if two < 0.6 * len(wide):
                return False
            least = 2
        gain = self.score(back) - self.score(old)
        return len(wide) >= least and gain > (0.3 if len(wide) >= 4 else 0.6)

    def judge(self, text: str) -> tuple[str | None, str] | None:
        """None for a sound text, else (original or None, reading)."""
        plain = unescape(text)
        if plain.isascii():
            if not (_SEVEN.search(plain) or "\x00" in plain):
                return None
        elif "\x00" not in plain and all(c in self.sound for c in plain if c > "\x7f"):
            return None
        best, name = None, ""
        for right, wrong in self.readings:
            back, n = self.undo(plain, right, wrong)
            if n and (best is None or (self.score(back), n) > best[:2]):
                best, name = (self.score(back), n, back), f"{right} read as {wrong}"
        if best is not None:
            back = best[2]
            again = self.judge(back)  # what is left may be another stretch, or text read wrongly twice
            if again is not None and again[0] is not None:
                back = again[0]
            return (None if _marks(back) else back), name
        twice = self._twice(plain)
        if twice is not None:
            return twice
        return (None, "lost") if _marks(plain) & self.marks else None

    def _twice(self, text: str) -> tuple[str | None, str] | None:
        """Text whose bytes were read wrongly two or three times over one single-byte codec."""
        for right, wrong in self.readings:
            if right != "utf-8" or not self.reader(wrong).single:
                continue
            back, n = self.undo(text, right, wrong, loose=True)
            if n and back != text:
                inner = self.judge(back)
                if inner is not None and inner[1] != "lost":
                    return inner[0], f"{right} read as {wrong} repeatedly"
        return None


def text_leaves(records: DataFrame) -> DataFrame:
    """(file_id, record_number, place, text) of the values that can be garbled.

    Values are read from the JSON object (nested ones as JSON text); of pure
    ASCII ones only those with literal escapes, NULs or seven-bit Japanese can
    be garbled, the rest is left out. ``place``
    holds two keys: the record stripped of non-ASCII characters, and its pure
    ASCII values, each with the field name. Rows that are no JSON object give
    nothing.
    """
    parsed = records.select(
        "file_id", "record_number", F.xxhash64(F.regexp_replace("payload_json", r"[^\x00-\x7F]+|\\\\+u[0-9a-fA-F]{4}", "")).alias("bare"),
        F.from_json("payload_json", "map<string,variant>").alias("m"),
    )
    entries = F.transform(
        F.map_entries("m"),
        lambda e: F.struct(e["key"].alias("field"), F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.to_json(e["value"])).alias("text")),
    )
    odd = r"[^\x01-\x7F]|\\u[0-9a-fA-F]{4}|" + SEVEN
    return (
        parsed.withColumn("e", entries)
        .withColumn("ascii", F.xxhash64(F.array_sort(F.filter(F.transform("e", lambda x: x["text"]), lambda t: ~t.rlike(odd)))))
        .select("file_id", "record_number", "bare", "ascii", F.explode(F.filter("e", lambda x: x["text"].rlike(odd))).alias("x"))
        .select(
            "file_id", "record_number",
            F.array(F.xxhash64(F.lit(1), "bare", "x.field"), F.xxhash64(F.lit(2), "ascii", "x.field")).alias("place"),
            F.col("x.text").alias("text"),
        )
    )


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (clean, garbled) to readings, marks and restored twins."""
    for pdf in batches:
        out, marks, seen = [], Counter(), set()
        for clean, garbled in zip(pdf["clean"], pdf["garbled"]):
            c, g = unescape(clean), unescape(garbled)
            if c == g:
                continue
            found = explain(c, g)
            if found and not found[1]:
                out += [("byte", f"{b:02x}", ch, found[0], garbled) for b, ch in found[2].items() if b > 126]
            elif found:
                out.append(("twin", garbled, c, found[0], found[1]))
                marks.update(_marks(g) - _marks(c))
                seen.update(ch for ch in set(g) - set(c) if ord(ch) > 127)
        out += [("mark", ch, None, None, None) for ch in marks]
        out += [("seen", ch, None, None, None) for ch in seen]
        yield pd.DataFrame(out, columns=["kind", "text", "restored", "right", "wrong"])


def _count_chars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            total.update(c for c in unescape(text) if ord(c) > 127)
    yield pd.DataFrame({"ch": [f"{ord(c):x}" for c in total], "n": list(total.values())})


class Garbled:
    """Verdicts on every distinct text of a source_record table."""

    def __init__(self, records: DataFrame, support: int = 2):
        self.spark = records.sparkSession
        self.scratch = Scratch(self.spark, "garbled")
        self.width = max(shuffle_width(self.spark), self.spark.sparkContext.defaultParallelism)
        self.leaves = self.scratch.save(text_leaves(records))
        self._learn(support)
        self.verdicts = self.scratch.save(self._apply())

    def _learn(self, support: int) -> None:
        placed = self.leaves.select(F.explode("place").alias("place"), "text").groupBy("place", "text").agg(F.count(F.lit(1)).alias("n"))
        stands = placed.groupBy("place").agg(
            F.max_by("text", F.struct("n", "text")).alias("clean"), F.max("n").alias("top"), F.sum("n").alias("of")
        )
        pairs = (
            placed.select("place", F.col("text").alias("garbled"))
            .join(stands.where("of > top"), "place")
            .where("garbled <> clean")
            .select("clean", "garbled")
            .distinct()
            .repartition(self.width, "garbled")  # few bytes, much work: not to be coalesced by size
        )
        self.learnt = self.scratch.save(pairs.mapInPandas(_learn, "kind string, text string, restored string, right string, wrong string"))
        readings = self.learnt.where("kind = 'twin'").groupBy("right", "wrong").agg(F.count(F.lit(1)).alias("n")).collect()
        self.readings = sorted(((r.n, r.right, r.wrong) for r in readings if r.n >= support), reverse=True)
        learned = self._tables(support)
        self.readings += [(support, right, name) for name, right in learned.keys()]
        marks = {r.text for r in self.learnt.where("kind = 'mark'").select("text").distinct().collect()}
        seen = {r.text for r in self.learnt.where("kind = 'seen'").select("text").distinct().collect()}
        sound = stands.where("of >= 3 and top * 2 > of").select(F.col("clean").alias("text")).distinct()
        counted = sound.mapInPandas(_count_chars, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n")).collect()
        chars = {chr(int(r.ch, 16)): r.n for r in counted}
        self.model = Model([(a, b) for _, a, b in self.readings], marks, {c: n for c, n in chars.items() if c not in marks}, seen, {name: table for (name, _), table in learned.items()})

    def _tables(self, support: int) -> dict[tuple[str, str], dict[int, str]]:
        """Byte tables of codecs the runtime does not know: per encoding and byte the character most pairs show (at most 256 rows each)."""
        votes = self.learnt.where("kind = 'byte'").groupBy("right", "text", "restored").agg(F.countDistinct("wrong").alias("n"))
        best = votes.groupBy("right", "text").agg(F.max_by("restored", F.struct("n", "restored")).alias("ch"), F.max("n").alias("n"), F.sum("n").alias("of"))
        out: dict[tuple[str, str], dict[int, str]] = {}
        for r in best.where(f"n >= {support} and 2 * n > of").collect():
            out.setdefault((f"learned table of {r.right}", r.right), {})[int(r.text, 16)] = r.ch
        return out

    def _apply(self) -> DataFrame:
        model = self.model

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(t, *v) for t in pdf["text"] if (v := model.judge(t)) is not None]
                yield pd.DataFrame(rows, columns=["text", "restored", "reading"])

        texts = self.leaves.select("text").distinct().repartition(self.width)  # few bytes, much work
        found = texts.mapInPandas(judge, "text string, restored string, reading string")

        def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Twins whose clean side is clean: the commonest text of a place may be the garbled one."""
            for pdf in batches:
                yield pdf[[model.judge(t) is None for t in pdf["restored"]]]

        pairs = self.learnt.where("kind = 'twin'").select("text", "restored", F.concat_ws(" read as ", "right", "wrong").alias("reading"))
        twins = pairs.repartition(self.width).mapInPandas(sound, "text string, restored string, reading string").withColumn("rank", F.lit(0))
        return (
            found.withColumn("rank", F.lit(1))
            .unionByName(twins)
            .groupBy("text")
            .agg(F.min_by(F.struct("restored", "reading"), F.struct("rank", "restored")).alias("v"))
            .select("text", "v.restored", "v.reading")
        )

    def values(self) -> DataFrame:
        """(file_id, record_number, text, restored, reading); restored is null where bytes are lost."""
        return self.leaves.select("file_id", "record_number", "text").join(self.verdicts, "text").select(
            "file_id", "record_number", "text", "restored", "reading"
        )

    def rows(self) -> DataFrame:
        """(file_id, record_number), once each."""
        return self.values().select("file_id", "record_number").distinct()


def garbled_rows(records: DataFrame) -> DataFrame:
    """Rows with at least one garbled value.

    Null or broken payloads and empty texts are sound; repeated rows are
    reported under each record number; extra columns are ignored.
    """
    return Garbled(records).rows()


def restored_values(records: DataFrame) -> DataFrame:
    return Garbled(records).values()
