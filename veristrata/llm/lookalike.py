"""One form for texts that look the same.

Look-alikes are classes of strings and code points, made by union-find from pairs that a
reader cannot tell apart: width and compatibility forms of a letter, composed and separate
accents, letters of other scripts with the same shape by Unicode's own table of confusables
(of the ICU library that Spark brings along), kinds of hyphens, kinds of blanks. The classes
are transitive, so full-width Cyrillic-like forms meet their Latin twin through any chain of
pairs. Only code points that the corpus uses are looked at, no more than Unicode has. The
representative of a class is the member that the corpus uses most (ties: the shortest, then
the lowest), so texts change as little as possible. Texts are composed and then rewritten
greedily, leftmost longest match first: single code points by a translation table, members of
several code points by an Aho-Corasick automaton, in passes until nothing changes. That comes
to an end: representatives are composed and stay as they are, a pass turns members into
representatives, and only composing them with a following accent, which uses the accent up,
can make a new member. Invisible characters go, runs of blanks become one, blanks at the ends
go.

Upper and lower case, digits and letters, different punctuation and traditional and
simplified characters stay apart, as a reader tells them apart.

Defined results: null stays null; a text of nothing visible becomes empty; very long texts
are rewritten whole; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.tables import cut

#: Signs, and letters of other scripts, that have the shape of a Latin one; the basis where no table of confusables is at hand (fixed values).
SAME_SHAPE = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "G": "Ԍ", "Q": "Ԛ", "W": "Ԝ",
    "ä": "ӓ", "ë": "ё", "ï": "ї", "ö": "ӧ", "Ä": "Ӓ", "Ë": "Ё", "Ï": "Ї", "Ö": "Ӧ",
    "-": "‐‑⁃", "·": "‧・᛫•∙⋅ꞏ", "/": "⁄∕", ":": "∶ː꞉", "~": "∼", "|": "∣ǀ", "'": "ʹ", ";": ";", "°": "˚",
}
#: Characters without a shape besides those of the categories Cf, Mn-invisible and Cc (fixed values).
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
_COMPAT = re.compile(r"^<(wide|narrow|font|noBreak|compat)> ")


class Classes:
    """Union-find over strings; a code point is a string of length one."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x], x = root, p
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up.setdefault(a, a)
            self.up[b] = a

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return {k: v for k, v in out.items() if len(v) > 1}


def confusables(spark: SparkSession, codes: list[int]) -> dict[str, str]:
    """Of the given code points those that look like another letter, and that letter.

    Skeletons of the ICU library, all in one call. As a reader tells them apart, digits do not
    meet letters, capitals no small letters, and Chinese characters no Chinese characters; the
    skeleton of I and l is one, so a capital means I and a small letter l. Signs are left to
    ``SAME_SHAPE``; scripts from right to left are left alone.
    """
    letters = [chr(c) for c in codes if c >= 0x80 and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and unicodedata.bidirectional(chr(c)) == "L" and not 0xAC00 <= c < 0xD7A4]
    if not letters:
        return {}
    icu = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    plain = [chr(c) for c in [*range(65, 91), *range(97, 123)]]
    shapes = icu.getSkeleton("\n".join(letters + plain)).split("\n")
    if len(shapes) != len(letters) + len(plain):
        return {}
    whole = [unicodedata.normalize("NFC", x) for x in shapes]
    of_plain = {x: c for c, x in zip(plain, whole[len(letters) :]) if c not in "Il"}
    out = {}
    for c, shape in zip(letters, whole):
        kind = unicodedata.category(c)
        twin = of_plain.get(shape, shape)
        if shape == "l":
            twin = {"Lu": "I", "Ll": "l"}.get(kind, "")
        if len(twin) != 1 or twin == c or not twin.isalpha() or (kind != "Lo" and unicodedata.category(twin) not in (kind, "Lo")) or (_is_han(c) and _is_han(twin)):
            continue
        out[c] = twin
    return out


def _is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿" or 0x20000 <= ord(c) < 0x32000


def classes(used: Iterable[str], shapes: dict[str, str]) -> list[list[str]]:
    """The classes among the code points that are used, their decompositions, and what they look like."""
    c = Classes()
    for base, others in SAME_SHAPE.items():
        for o in others:
            c.union(base, o)
    for x, y in shapes.items():
        c.union(y, x)
    for ch in used:
        if ch < "\x80" or "\ud800" <= ch < "\ue000" or "가" <= ch < "\ud7a4":
            continue
        d = unicodedata.decomposition(ch)
        if not d or unicodedata.category(ch) in ("Cf", "Zs", "Cn"):
            continue
        if d[0] != "<":  # a second code point of the same character
            c.union(unicodedata.normalize("NFC", ch), ch)
        elif _COMPAT.match(d):
            plain = unicodedata.normalize("NFKC", ch)
            letters = all(x.isalnum() for x in plain)
            if not plain.strip() or any(x.isspace() for x in plain) or (d.startswith("<compat>") and not letters):
                continue
            if ch.isalpha() or not letters or len(plain) == 1:
                c.union(plain, ch)
    return [sorted(g) for g in c.groups().values()]


def frequencies(texts: DataFrame) -> dict[str, int]:
    """How often the corpus uses each code point, texts composed; no more entries than Unicode has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            text = unicodedata.normalize("NFC", "\n".join(t for t in b.column(0).to_pylist() if t))
            part = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
            total[: len(part)] += part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    rows = texts.mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {chr(r["code"]): r["n"] for r in rows}


#: Code points that go, and that are blanks.
GONE = frozenset(i for i in range(0x110000) if unicodedata.category(chr(i)) == "Cf" or 0xFE00 <= i < 0xFE10 or 0xE0100 <= i < 0xE01F0) | {ord(x) for x in INVISIBLE}
BLANKS = frozenset(i for i in range(0x3001) if chr(i).isspace() or unicodedata.category(chr(i)) == "Zs")
_compiled: dict[int, Rewriter] = {}


class Rewriter:
    def __init__(self, used: dict[str, int], shapes: dict[str, str] | None = None):
        self.used, self.shapes = used, shapes or {}

    def compile(self) -> Rewriter:
        """Ready to rewrite; built once in a worker."""
        tag = hash((frozenset(self.used.items()), frozenset(self.shapes.items())))
        if tag not in _compiled:
            _compiled.clear()
            _compiled[tag] = self._compile()
        return _compiled[tag]

    def _compile(self) -> Rewriter:
        single: dict[int, str] = {}
        several: dict[str, str] = {}
        n = lambda x: self.used.get(x, 0) if len(x) == 1 else min(self.used.get(y, 0) for y in x)
        for group in classes(self.used, self.shapes):
            composed = [x for x in group if unicodedata.normalize("NFC", x) == x]
            best = max(composed, key=lambda x: (n(x), -len(x), [-ord(y) for y in x]))
            for x in composed:
                if x != best:
                    if len(x) == 1:
                        single[ord(x)] = best
                    else:
                        several[x] = best
        self.single = single | dict.fromkeys(GONE, "") | dict.fromkeys(BLANKS, " ")
        self.several = several
        self.firsts = re.compile("[" + "".join(sorted({re.escape(x[0]) for x in several})) + "]") if several else None
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for x, y in several.items():
            self.automaton.add_word(x, (len(x), y))
        self.automaton.make_automaton()
        for table in (self.single, several):
            for x, y in table.items():
                if len(y) > 1:  # of members that have others in their place
                    table[x] = self._settled(y)
        self.automaton = ahocorasick.Automaton()
        for x, y in several.items():
            self.automaton.add_word(x, (len(x), y))
        self.automaton.make_automaton()
        self.plain = not any(x.isascii() for x in several) and all(i >= 0x80 or not chr(i).isprintable() or i == 0x20 for i in self.single)
        return self

    def _greedy(self, s: str) -> str:
        if not self.several:
            return s
        out, at = [], 0
        for end, (length, best) in self.automaton.iter_long(s):
            begin = end - length + 1
            out += (s[at:begin], best)
            at = end + 1
        return "".join((*out, s[at:])) if at else s

    def _settled(self, s: str) -> str:
        before = None
        while s != before:
            before = s
            s = self._greedy(unicodedata.normalize("NFC", s).translate(self.single))
        return s

    def __call__(self, s: str) -> str:
        if not (self.plain and s.isascii() and s.isprintable()):
            while True:
                s = unicodedata.normalize("NFC", s).translate(self.single)
                t = self._greedy(s) if self.firsts and self.firsts.search(s) else s
                # what is written in place of members holds none, so only new members of several code points or accents to compose call for another pass
                if t == s and unicodedata.is_normalized("NFC", s):
                    break
                s = t
        return re.sub("  +", " ", s).strip(" ") if "  " in s or s[:1] == " " or s[-1:] == " " else s


def rewriter(texts: DataFrame) -> Rewriter:
    used = frequencies(texts)
    shapes = confusables(texts.sparkSession, [ord(c) for c in used])
    kept = {c: n for c, n in used.items() if c < "\x80" or unicodedata.decomposition(c) or c in shapes or c in shapes.values() or c in _SHAPED}
    return Rewriter(kept, shapes)


_SHAPED = set(SAME_SHAPE) | {o for others in SAME_SHAPE.values() for o in others}

_KEYED = pa.schema([("tab", pa.string()), ("row_id", pa.int64()), ("key", pa.binary()), ("raw", pa.int64())])


def keyed(rows: DataFrame, rewrite: Rewriter) -> DataFrame:
    """rows(tab, row_id, text) to (tab, row_id, key of the consistent form, key of the text as it is)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rewrite.compile()
        for b in batches:
            texts = b.column(2).to_pylist()
            keys, raws = [], []
            for t in texts:
                s = own(t)
                keys.append(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() if s else None)
                raws.append(struct.unpack("<q", hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest())[0])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(raws, pa.int64())], schema=_KEYED)

    return rows.where("text is not null and row_id is not null").select("tab", "row_id", "text").mapInArrow(run, "tab string, row_id bigint, key binary, raw bigint")


def consistent(rows: DataFrame, rewrite: Rewriter) -> DataFrame:
    """rows(tab, row_id, text) with each text in its one form, as ``form``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rewrite.compile()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if t is None else own(t) for t in b.column(2).to_pylist()], pa.string())], names=["tab", "row_id", "form"])

    return rows.select("tab", "row_id", "text").mapInArrow(run, "tab string, row_id bigint, form string")


#: Rows of a class that one task pairs with all others; larger classes are parted.
PAIRED = 4_096


def classed(rows: DataFrame, rewrite: Rewriter) -> DataFrame:
    """One row for each row of rows(tab, row_id, text): its class, as ``class_id``, how many rows and spellings the class has, and with how many of its rows it is linked, as they look the same but differ in code points.

    Copies of a text count as rows of the class; only hashes are shuffled, and counts combine on the map side.
    """
    k = cut(keyed(rows, rewrite).where("key is not null").dropDuplicates(["tab", "row_id", "raw"]))
    spelt = k.groupBy("tab", "key", "raw").agg(F.count("*").alias("same"))
    whole = spelt.groupBy("tab", "key").agg(F.sum("same").alias("n_rows"), F.count("*").alias("n_spellings"))
    return k.join(spelt, ["tab", "key", "raw"]).join(whole, ["tab", "key"]).select("tab", "row_id", F.lower(F.hex("key")).alias("class_id"), "raw", "n_rows", "n_spellings", (F.col("n_rows") - F.col("same")).alias("n_links"))


def twins(rows: DataFrame, rewrite: Rewriter) -> DataFrame:
    """Distinct (tab, id_a, id_b), id_a < id_b, of rows that look the same but differ in code points: the classes' links, written out.

    Copies of a text under many keys reach the join only if the text has another spelling; a
    class of more than ``PAIRED`` rows is parted, so no class is paired in one task.
    """
    k = cut(keyed(rows, rewrite).where("key is not null"))
    mixed = k.groupBy("tab", "key").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("tab", "key", F.ceil(F.col("n") / PAIRED).cast("int").alias("parts"))
    own = k.join(mixed, ["tab", "key"]).dropDuplicates(["tab", "row_id", "raw"])
    a = own.select("tab", "key", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int").alias("part"), F.col("row_id").alias("id_a"), F.col("raw").alias("raw_a"))
    b = own.select("tab", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("row_id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["tab", "key", "part"]).where("id_a < id_b and raw_a <> raw_b").select("tab", "id_a", "id_b").distinct()
