"""Spellings of names, as people type them, linked to the entries they mean.

Latin names are token sets. A symmetric-delete index holds every token of the known names
with each of its characters left out; a typed token with each of its characters left out
meets there every token within one insertion, deletion, substitution or swap. Candidates so
found are aligned token by token at least cost (optimal assignment), where a typed token may
also be an initial, an abbreviation, a nickname, several initials at once or two halves of a
token. Order does not count. One typing error is allowed in all. An error that turns one
well-formed word into another is *doubtful*: a place made of syllables that the known names
use, a surname made of parts that several known surnames use, a word that many names hold, or one with another first letter, where people rarely err.
A doubtful spelling links only where it is rare beside its entry, as a name of its own would
not be; others link however often they are written.

Chinese names use the same index over the whole name, with the place and the kind of
institution as its two tokens: the kind may be shortened to some of its characters unless
that is a kind of its own; the place may be swapped, or carry a character that no known name
uses, but a known character in its stead makes it another place. Names of persons in Chinese
allow no error at all. A spelling that fits several entries equally well links to none.

What is known of names in general, kinds of institutions, characters and syllables of places,
parts of surnames, is learnt once, from all known names: beyond ``MODEL_NAMES`` it is counted
where the names lie, with the same result, and only what passed its threshold is brought
together. The lookup goes over the known names in blocks of
``NAME_BLOCK``; every block gives its best entries with their costs and the best of all blocks
wins, so the blocks do not change the links. Every distinct spelling is resolved once, over
counts that combine on the map side. Rows then join their spelling; AQE splits a spelling
that is hot.

Defined results: null and blank values link to nothing; a value identical to the full name is
left out; values with more words or characters than any known name could take up link to
nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veristrata.tables import cut

#: Names in a block of the lookup, and names up to which the driver learns the model itself.
NAME_BLOCK, MODEL_NAMES = 20_000, 200_000
EXACT, NICK, ABBR, INITIAL, TYPO, DOUBT, ABSENT = 0.0, 0.1, 0.2, 0.3, 1.0, 0.5, 0.05
MOST_COST = 2.7
#: Most frequency of a doubtful spelling, as a share of its entry's spellings without an error.
RARE = 0.2
#: Names that must share an ending to make it a kind, a word to make it common, or a part of a surname with others to make it productive; a word is common from this share on in large tables.
SHARED, COMMON, WIDE = 3, 0.001, 24
#: Traditional characters and their simplified forms, of words in names of institutions (fixed values).
_SIMPLE = dict(zip("學術業職經財師範醫橋灣鷺嶠嵐嶺嶼葦瀾澤霽硯彎陽龍雲興圖書館會創開發實驗電機動車農藝樂體衛藥護鐵軍黨團聯協際語譯傳聞報頻視網絡訊軟製質檢測計劃設築環資產銀貿稅險證賽獎優島蕪潯滄漢遼寧鄭濟慶蘇貴長門頭縣鄉區鎮號樓層單員東華國廣滬濱", "学术业职经财师范医桥湾鹭峤岚岭屿苇澜泽霁砚弯阳龙云兴图书馆会创开发实验电机动车农艺乐体卫药护铁军党团联协际语译传闻报频视网络讯软制质检测计划设筑环资产银贸税险证赛奖优岛芜浔沧汉辽宁郑济庆苏贵长门头县乡区镇号楼层单员东华国广沪滨"))
_SIMPLE_TABLE = str.maketrans(_SIMPLE)
#: Short forms of given names (fixed values).
NICKNAMES = {
    "alexandra": "alex sasha sandra lexi", "benjamin": "ben benny benji", "elizabeth": "liz beth betty lizzie eliza bess", "frederick": "fred freddie fritz rick", "isidore": "izzy isy dory", "josephine": "jo josie", "katherine": "kate kathy kit katie kat", "leopold": "leo poldi", "margaret": "peggy maggie meg marge greta", "nathaniel": "nate nat nathan", "philippa": "pip pippa", "rebecca": "becky becca bex", "rosalind": "roz rosie ros", "samuel": "sam sammy", "theodore": "ted theo teddy", "victoria": "vicky tori vic", "william": "bill will billy liam", "zachary": "zach zack zac",
    "robert": "bob rob bobby", "richard": "dick rick rich", "james": "jim jimmy", "john": "jack johnny", "edward": "ed eddie ned", "charles": "charlie chuck", "thomas": "tom tommy", "michael": "mike mick", "daniel": "dan danny", "matthew": "matt", "anthony": "tony", "andrew": "andy drew", "joseph": "joe joey", "christopher": "chris kit", "patricia": "pat patty trish", "jennifer": "jen jenny", "susan": "sue susie", "catherine": "cathy kate", "dorothy": "dot dolly", "helen": "nell nellie", "henry": "harry hank", "steven": "steve", "gregory": "greg", "timothy": "tim", "nicholas": "nick", "jonathan": "jon", "peter": "pete", "david": "dave",
}
#: Abbreviations that are no beginnings of their word (fixed values).
ABBREVIATIONS = {"fdn": "foundation", "fndn": "foundation", "dept": "department", "intl": "international", "natl": "national", "assn": "association", "ctr": "centre", "lab": "laboratory", "mfg": "manufacturing", "govt": "government", "mgmt": "management", "tech": "technology", "technical": "technology", "limited": "ltd", "company": "co", "poly": "polytechnic", "inst": "institute", "univ": "university", "coll": "college"}
_STOP = set("the of for and at in de la".split())
_OPTIONAL = {"co", "ltd", "inc", "limited", "company"}
_TITLE_LATIN = set("prof professor dr mr mrs ms miss sir dame phd md".split())
_TITLE_ZH = re.compile(r"(?:副?教授|老师|先生|女士|博士|导师|院士|主任|同学)$")
_BRACKET = re.compile(r"[（(【\[]([^（）()【】\[\]]*)[）)】\]]")
_HAN = re.compile(r"[㐀-鿿]")
_SYLLABLE = re.compile(r"(?:zh|ch|sh|[bpmfdtnlgkhjqxrzcsyw])?(?:iang|iong|uang|ang|eng|ing|ong|ian|iao|uai|uan|ai|ei|ao|ou|an|en|in|un|ia|ie|iu|ua|ui|uo|ue|er|a|e|i|o|u|v)")


def deletes(word: str) -> set[str]:
    """The word and the word without each one of its characters."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a: str, b: str) -> bool:
    """True if one insertion, deletion, substitution or swap of neighbours makes a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def splits(word: str) -> list[tuple[str, str]]:
    """The ways to read a word as two syllables."""
    return [(word[:i], word[i:]) for i in range(1, len(word)) if _SYLLABLE.fullmatch(word[:i]) and _SYLLABLE.fullmatch(word[i:])]


def _subsequence(short: str, full: str) -> bool:
    it = iter(full)
    return all(c in it for c in short)


def plain(value: str) -> str:
    s = unicodedata.normalize("NFKC", value).translate(_SIMPLE_TABLE)
    return re.sub(r"\s+", " ", "".join(c for c in s if unicodedata.category(c) != "Cf")).strip()


def latin_words(full: str, latin: str | None) -> list[str]:
    return [t for t in tokens(latin or (full if not _HAN.search(full) else "")) if t not in _STOP]


def tokens(s: str) -> list[str]:
    """The words of a Latin name in lower case; dotted letters become single ones, hyphens join."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return [t for t in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])['’-](?=[a-z])", "", s))]


class Model:
    """What names have in common, learnt from the known ones."""

    def __init__(self, rows: list[tuple[int, str, str, str]]):
        suffix: dict[str, int] = {}
        held: dict[str, int] = {}
        orgs: list[tuple[str, list[str]]] = []
        heads: dict[str, set[str]] = {}
        tails: dict[str, set[str]] = {}
        self.most_words, self.most_chars = 1, 1
        for _, kind, full, latin in rows:
            f = plain(full)
            words = latin_words(full, latin)
            self.most_words, self.most_chars = max(self.most_words, len(words)), max(self.most_chars, len(f))
            for w in set(words):
                held[w] = held.get(w, 0) + 1
            if kind == "org" and _HAN.search(f):
                orgs.append((f, words))
                for k in range(1, len(f)):
                    suffix[f[k:]] = suffix.get(f[k:], 0) + 1
            elif kind == "person" and words and not _HAN.search(f):
                for k in range(2, len(words[-1]) - 1):
                    heads.setdefault(words[-1][:k], set()).add(words[-1][k:])
                    tails.setdefault(words[-1][k:], set()).add(words[-1][:k])
        self.endings = {x for x, n in suffix.items() if n >= SHARED}
        self.common = {w for w, n in held.items() if n >= max(SHARED, COMMON * len(rows))}
        self.wide = {w for w, n in held.items() if n > max(WIDE, len(rows) / 12)}
        self.heads = {x for x, others in heads.items() if len(others) >= SHARED}
        self.tails = {x for x, others in tails.items() if len(others) >= SHARED}
        self.kinds: set[str] = set()
        self.pool: set[str] = set()
        votes: dict[tuple[str, str], int] = {}
        for f, words in orgs:
            p, t = self.parts(f)
            self.kinds.add(t)
            self.pool |= set(p)
            for w in words:
                for x, y in splits(w) if len(p) == 2 else ():
                    for z in ((p[0], x), (p[1], y)):
                        votes[z] = votes.get(z, 0) + 1
        best: dict[str, tuple[int, str]] = {}
        for (c, syllable), n in votes.items():
            best[c] = max(best.get(c, (0, "")), (n, syllable))
        self.syllables = {x for _, x in best.values()}

    @classmethod
    def of_all(cls, names: DataFrame, n: int) -> tuple[Model, DataFrame]:
        """The model of n names(name_id, kind, full_name, latin_name), counted where they lie, and the names with the length of their place, which stands for the endings."""
        model = cls([])
        spelt = cut(names.withColumn("name_id", F.col("name_id").cast("bigint")).mapInArrow(_plained, "name_id bigint, kind string, full_name string, latin_name string, f string"))
        counted = cut(spelt.mapInArrow(_features, "what string, a string, b string, n bigint").groupBy("what", "a", "b").agg(F.sum("n").alias("n"), F.max("n").alias("most")))
        own = lambda what: counted.where(F.col("what") == what)
        most = {r["a"]: r["most"] for r in own("most").collect()}
        model.most_words, model.most_chars = max(1, most.get("words", 1)), max(1, most.get("chars", 1))
        common, wide = max(SHARED, COMMON * n), max(WIDE, n / 12)
        held = own("word").where(F.col("n") >= min(common, wide)).collect()
        model.common, model.wide = {r["a"] for r in held if r["n"] >= common}, {r["a"] for r in held if r["n"] > wide}
        model.heads, model.tails = ({r[0] for r in own("surname").groupBy(x).count().where(F.col("count") >= SHARED).select(x).collect()} for x in ("a", "b"))
        orgs = own("org").select(F.col("a").alias("f"), F.col("b").alias("words"), "n")
        of_name = orgs.groupBy("f").agg(F.sum("n").alias("n"))
        ends = of_name.where("char_length(f) > 1").selectExpr("f", "n", "posexplode(transform(sequence(1, char_length(f) - 1), k -> substring(f, k + 1))) as (p, ending)")
        shared = ends.groupBy("ending").agg(F.sum("n").alias("n")).where(F.col("n") >= SHARED).select("ending")
        longest = ends.where("p > 0").join(shared, "ending", "left_semi").groupBy("f").agg((F.min("p") + 1).alias("k"))
        places = cut(of_name.select("f").join(longest, "f", "left").selectExpr("f", "coalesce(k, least(2, char_length(f))) as place"))
        model.kinds = {r[0] for r in places.selectExpr("substring(f, place + 1) as t").distinct().collect()}
        model.pool = {r[0] for r in places.selectExpr("explode(transform(sequence(1, place), i -> substring(f, i, 1))) as c").distinct().collect()}
        votes = orgs.where("words <> ''").join(places.where("place = 2"), "f").select("f", "words", "n").mapInArrow(_votes, "c string, syllable string, n bigint").groupBy("c", "syllable").agg(F.sum("n").alias("n"))
        model.syllables = {r[0] for r in votes.groupBy("c").agg(F.max(F.struct("n", "syllable")).alias("x")).select("x.syllable").distinct().collect()}
        return model, cut(spelt.join(places, "f", "left").select("name_id", "kind", "full_name", "latin_name", "place"))

    def tag(self) -> int:
        return hash((self.most_words, self.most_chars, *(frozenset(x) for x in (self.endings, self.common, self.wide, self.heads, self.tails, self.kinds, self.pool, self.syllables))))

    def parts(self, f: str) -> tuple[str, str]:
        """Place and kind of an institution: the kind is the longest ending that several names share and that leaves a place of two characters or more."""
        k = next((k for k in range(2, len(f)) if f[k:] in self.endings), min(2, len(f)))
        return f[:k], f[k:]

    def doubtful(self, typed: str, kind: str, first: bool) -> bool:
        """True if a token with an error is a well-formed word of its own."""
        if kind == "org":
            return typed in self.common or first and any(a in self.syllables and b in self.syllables for a, b in splits(typed))
        return any(typed[:k] in self.heads and typed[k:] in self.tails for k in range(2, len(typed) - 1))


def _plained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([plain(x) for x in b.column(2).to_pylist()], pa.string())], names=[*b.schema.names, "f"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``Model`` counts of names: (what, a, b, n)."""
    for b in batches:
        found: Counter[tuple[str, str, str]] = Counter()
        most = {"words": 1, "chars": 1}
        for kind, full, latin, f in zip(*(c.to_pylist() for c in b.columns[1:])):
            words = latin_words(full, latin)
            most = {"words": max(most["words"], len(words)), "chars": max(most["chars"], len(f))}
            found.update(("word", w, "") for w in set(words))
            if kind == "org" and _HAN.search(f):
                found["org", f, " ".join(words)] += 1
            elif kind == "person" and words and not _HAN.search(f):
                found.update(("surname", words[-1][:k], words[-1][k:]) for k in range(2, len(words[-1]) - 1))
        rows = [*(("most", k, "", n) for k, n in most.items()), *((*k, n) for k, n in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["what", "a", "b", "n"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The syllables that the two characters of a place may stand for: (c, syllable, n)."""
    for b in batches:
        found: Counter[tuple[str, str]] = Counter()
        for f, words, n in zip(*(c.to_pylist() for c in b.columns)):
            for w in words.split(" "):
                for x, y in splits(w):
                    found[f[0], x] += n
                    found[f[1], y] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array(list(found.values()), pa.int64())], names=["c", "syllable", "n"])


class Index:
    """Known names, ready to be asked, with the model of all of them; a row may tell the length of its place."""

    def __init__(self, rows: list[tuple], model: Model | None = None):
        self.rows, self.model = rows, model or Model(rows)

    def compile(self) -> Index:
        self.kinds, self.pool = self.model.kinds, self.model.pool
        self.kinds_by_first: dict[str, list[str]] = {}
        for t in self.kinds:
            self.kinds_by_first.setdefault(t[:1], []).append(t)
        cuts: dict[str, int] = {}
        self.exact: dict[tuple[str, str], set[int]] = {}
        self.near_zh: dict[str, set[str]] = {}
        self.zh: dict[str, set[int]] = {}
        self.entries: dict[int, tuple[str, list[str]]] = {}
        self.by_token: dict[str, set[int]] = {}
        self.place: dict[str, tuple[str, str]] = {}
        self.by_place: dict[str, list[str]] = {}
        self.by_first: dict[str, list[str]] = {}
        for name_id, kind, full, latin, *place in self.rows:
            f = plain(full)
            self.exact.setdefault((kind, f.replace(" ", "") if _HAN.search(f) else f.lower()), set()).add(name_id)
            words = latin_words(full, latin)
            if words:
                self.entries[name_id] = (kind, words)
                for w in set(words):
                    self.by_token.setdefault(w, set()).add(name_id)
            if kind == "org" and _HAN.search(f):
                self.zh.setdefault(f, set()).add(name_id)
                if place:
                    cuts[f] = place[0]
        for f in self.zh:
            p, _ = self.place[f] = (f[: cuts[f]], f[cuts[f] :]) if f in cuts else self.model.parts(f)
            for d in deletes(f):
                self.near_zh.setdefault(d, set()).add(f)
            self.by_place.setdefault(p, []).append(f)
            self.by_first.setdefault(p[0], []).append(f)
        self.near: dict[str, set[str]] = {}
        self.begins: dict[str, set[str]] = {}
        for w in self.by_token:
            for d in deletes(w):
                self.near.setdefault(d, set()).add(w)
            for k in range(2, len(w)):
                self.begins.setdefault(w[:k], set()).add(w)
        self.nicks: dict[str, set[str]] = {}
        for w, ns in NICKNAMES.items():
            for n in ns.split():
                self.nicks.setdefault(n, set()).add(w)
        return self

    @staticmethod
    def _cost(typed: str, known: str, nicks: dict[str, set[str]], kind: str) -> float | None:
        if typed == known:
            return EXACT
        if known in nicks.get(typed, ()):
            return NICK
        if ABBREVIATIONS.get(typed) == known or (len(typed) >= 2 and len(known) >= len(typed) + 2 and known.startswith(typed) and kind == "org"):
            return ABBR
        if len(typed) == 1 and known[0] == typed:
            return INITIAL
        if kind == "person" and len(typed) == 2 and any(a[0] + b[0] == typed for a, b in splits(known)):
            return INITIAL
        if len(typed) >= 2 and len(known) >= 2 and (len(known) >= 3 or len(typed) >= 3) and one_edit(typed, known):
            return TYPO
        return None

    def _align(self, typed: list[str], name_id: int) -> float | None:
        """The least cost of giving every typed token a known one of its own, with one typing error in all."""
        kind, known = self.entries[name_id]
        n = len(known)
        state: dict[tuple[int, int], float] = {(0, 0): 0.0}  # known tokens used, typing errors
        for t in typed:
            new: dict[tuple[int, int], float] = {}
            options = []
            for j, k in enumerate(known):
                c = self._cost(t, k, self.nicks, kind)
                if c is not None:
                    options.append((1 << j, c + DOUBT * (c == TYPO and (t[0] != k[0] or self.model.doubtful(t, kind, j == 0))), c == TYPO))
            if kind == "org" and 2 <= len(t) <= 4:  # initials of several words in a row
                for j in range(n - len(t) + 1):
                    if all(known[j + x][0] == t[x] for x in range(len(t))):
                        options.append((((1 << len(t)) - 1) << j, INITIAL, False))
            for (mask, errors), cost in state.items():
                for bits, c, typo in options:
                    if not mask & bits and errors + typo <= 1:
                        key = mask | bits, errors + typo
                        new[key] = min(new.get(key, 99.0), cost + c)
            if not new:
                return None
            state = new
        best = None
        for (mask, _), cost in state.items():
            left = [k for j, k in enumerate(known) if not mask >> j & 1]
            if all(k in _OPTIONAL for k in left):
                cost += ABSENT * len(left)
                best = cost if best is None else min(best, cost)
        return best

    def _latin(self, s: str, kind: str) -> tuple[float, set[int]]:
        words = [t for t in tokens(s) if t not in _STOP and not (kind == "person" and t in _TITLE_LATIN)]
        if not words or len(words) > 2 * self.model.most_words:  # every word takes up a known one or half of one
            return 99.0, set()
        forms = [words] + [words[:i] + [a + b] + words[i + 2 :] for i, (a, b) in enumerate(pairwise(words)) if len(a) <= 6 and len(b) <= 6]
        if kind == "org":
            if "polytechnic" in words and "college" in words:
                forms.append([w for w in words if w != "college"])
            if words[-1] == "tech" and len(words) == 2:
                forms.append([words[0], "university", "technology"])
        cost, found = 99.0, set()
        for common in (False, True):
            for form in forms:
                for i in self._candidates(form, kind, common):
                    if self.entries[i][0] == kind and (c := self._align(form, i)) is not None:
                        if c < cost - 1e-9:
                            cost, found = c, {i}
                        elif c < cost + 1e-9:
                            found.add(i)
            if cost < TYPO:
                break
        return cost, found

    def _candidates(self, form: list[str], kind: str, common: bool) -> set[int]:
        """Entries with a token within one error of a typed one; the words that a good part of the names hold, and beginnings of words, are asked only where no other one gives an entry without an error."""
        asked: set[int] = set()
        for t in form:
            if len(t) >= 2:
                near = {t} | self.nicks.get(t, set()) | {x for d in deletes(t) for x in self.near.get(d, ())}
                if common and kind == "org":
                    near |= self.begins.get(t, set())
                for w in near:
                    if common or w not in self.model.wide:
                        asked |= self.by_token.get(w, set())
        return asked

    def _chinese_org(self, s: str) -> tuple[float, set[int]]:
        s = s.replace(" ", "")
        if s in self.zh:
            return EXACT, self.zh[s]
        if len(s) > self.model.most_chars + 1:
            return 99.0, set()
        found: dict[str, float] = {}
        kind = next((s[k:] for k in range(1, len(s) + 1) if s[k:] in self.kinds), None)
        for f in {f for d in deletes(s) for f in self.near_zh.get(d, ())}:
            if not one_edit(s, f):
                continue
            p, t = self.place[f]
            if kind and kind != t and len(s) - len(kind) >= len(p):
                continue  # another kind of institution
            if len(s) == len(f) and sum(a != b for a, b in zip(s, f)) == 1:
                i = next(i for i, (a, b) in enumerate(zip(s, f)) if a != b)
                if i < len(p) and s[i] in self.pool:
                    continue  # another place
            elif len(s) < len(f) and not s.startswith(p) and s[: len(p)] != p and kind == t and len(s) - len(t) < len(p):
                found[f] = TYPO + 0.2  # a character of the place is missing
                continue
            elif len(s) > len(f) and not s.startswith(p) and s[: len(p) + 1] not in {p[: k + 1] + p[k:] for k in range(len(p))} and any(c in self.pool for c in s[: len(p) + 1] if c not in p):
                continue
            found[f] = TYPO
        for f in self.by_place.get(s[:2], ()):
            p, t = self.place[f]
            r = s[len(p) :]
            if s.startswith(p) and r and r != t and r not in self.kinds and len(r) < len(t) and _subsequence(r, t) and self._shortens(r, t):
                found[f] = min(found.get(f, 9.0), ABBR)
        if not found:
            for f in self.by_first.get(s[:1], ()):
                p, t = self.place[f]
                r = s[1:]
                if r and len(r) < len(t) + 1 and r not in self.kinds and _subsequence(r, t) and self._shortens(r, t) and r[0] not in self.pool - set(t):
                    found[f] = INITIAL
        cost = min(found.values(), default=99.0)
        return cost, {i for f, c in found.items() if c == cost for i in self.zh[f]}

    def _shortens(self, short: str, full: str) -> bool:
        """The short form names the kind by its first characters, or by its ending as no other kind does."""
        if short[0] == full[0]:
            return True
        return not any(k != full and len(short) < len(k) and _subsequence(short, k) for k in self.kinds_by_first.get(short[0], ())) and full.endswith(short)

    def fits(self, value: str, kind: str) -> list[tuple[int, float, int]]:
        """(stage, cost, entry) of all entries that fit a spelling best: by what stands outside of brackets, and by what stands in them."""
        s = plain(value)
        inside = [x.strip() for x in _BRACKET.findall(s)]
        outside = re.sub(r"\s+", " ", _BRACKET.sub(" ", s)).strip(" ,，·")
        forms = [outside] + ([_BRACKET.sub(r"\1", s)] if inside and _HAN.search(outside) else [])
        out: list[tuple[int, float, int]] = []
        for form in dict.fromkeys(forms):
            if not form:
                continue
            if _HAN.search(form):
                if kind == "person":
                    name = _TITLE_ZH.sub("", form.replace(" ", "").replace("·", ""))
                    ids = self.exact.get((kind, name), set())
                    c = EXACT if ids else 99.0
                else:
                    c, ids = self._chinese_org(form)
            else:
                c, ids = self._latin(form, kind)
            out += [(0, c, i) for i in ids if c <= MOST_COST]
        for x in inside:  # the other language stands in brackets
            c, ids = (self._chinese_org(x) if kind == "org" else (99.0, set())) if _HAN.search(x) else self._latin(x, kind)
            out += [(1, c, i) for i in ids if c <= TYPO]
        return out

    def resolve(self, value: str, kind: str) -> tuple[float, int | None]:
        """The cost and the entry a spelling means, if one fits best."""
        return best(self.fits(value, kind))


def best(fits: list[tuple[int, float, int]]) -> tuple[float, int | None]:
    """Of the fits of a spelling: the one outside of brackets, or the one that those in brackets leave."""
    stages = []
    for stage in (0, 1):
        own = [(c, i) for s, c, i in fits if s == stage]
        least = min((c for c, _ in own), default=99.0)
        stages.append((least, {i for c, i in own if c < least + 1e-9}))
    (c0, out), (c1, inner) = stages
    if len(out) == 1:
        return c0, next(iter(out))
    both = inner if not out else inner & out
    return (c1, next(iter(both))) if len(inner) == 1 and both else (99.0, None)


_indexes: dict[tuple[int, int], Index] = {}
_OUT = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64()), ("stage", pa.int32()), ("cost", pa.float64()), ("name_id", pa.int64())])


def _resolver(rows: list[tuple], model: Broadcast[Model], model_tag: int):
    tag = model_tag, hash(tuple(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _indexes:
            _indexes.clear()
            _indexes[tag] = Index(rows, model.value).compile()
        index = _indexes[tag]
        for b in batches:
            got = [(i, *f) for i, (k, v) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for f in index.fits(v, k)]
            at = pa.array([g[0] for g in got], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), *(pa.array([g[i] for g in got], _OUT.field(i + 2).type) for i in (1, 2, 3))], schema=_OUT)

    return run


def _chosen(fits: DataFrame) -> DataFrame:
    """(kind, value, n, cost, name_id): what ``best`` says, over the fits of all blocks."""
    least = F.min("cost").over(W.partitionBy("kind", "value", "stage"))
    near = fits.withColumn("least", least).where("cost < least + 1e-9")
    ids = near.groupBy("kind", "value", "n", "name_id").agg(F.min(F.when(F.col("stage") == 0, F.col("cost"))).alias("c0"), F.min(F.when(F.col("stage") == 1, F.col("cost"))).alias("c1"))
    out, inner = F.col("c0").isNotNull(), F.col("c1").isNotNull()
    one = ids.groupBy("kind", "value", "n").agg(
        F.count_if(out).alias("n0"), F.count_if(inner).alias("n1"), F.count_if(out & inner).alias("both"), F.max(F.when(out, F.struct("name_id", F.col("c0").alias("cost")))).alias("out"),
        F.max(F.when(inner, F.struct("name_id", F.col("c1").alias("cost")))).alias("inner"),
    )
    pick = F.when(F.col("n0") == 1, F.col("out")).when((F.col("n1") == 1) & ((F.col("n0") == 0) | (F.col("both") == 1)), F.col("inner"))
    return one.select("kind", "value", "n", pick.alias("x")).where("x is not null").select("kind", "value", "n", "x.cost", "x.name_id")


def link(values: DataFrame, known: DataFrame, block: int = NAME_BLOCK) -> DataFrame:
    """(tab, row_id, field, name_id) of values(tab, row_id, field, kind, value) and known(name_id, kind, full_name, latin_name)."""
    known = known.where("name_id is not null and full_name is not null")
    names = known.select("name_id", "kind", "full_name", "latin_name")
    n = names.count()
    if n <= MODEL_NAMES:
        model = Model([tuple(r) for r in names.collect()])
    else:
        model, names = Model.of_all(names, n)
    sent, tag = names.sparkSession.sparkContext.broadcast(model), model.tag()  # once, for all blocks
    blocks = 1 if n <= block else 2 * -(-n // block)
    source = values.where("row_id is not null and trim(value) <> ''").select("tab", "row_id", "field", "kind", "value")
    spellings = source.groupBy("kind", "value").agg(F.count("*").alias("n"))
    parts = []
    for b in range(blocks):
        own = names.where(F.pmod(F.xxhash64("name_id"), F.lit(blocks)) == b).orderBy("name_id").collect()
        parts.append(spellings.mapInArrow(_resolver([tuple(r) for r in own], sent, tag), "kind string, value string, n bigint, stage int, cost double, name_id bigint"))
    fits = cut(_chosen(reduce(DataFrame.unionByName, parts)))
    # a doubtful spelling is rarer than the entry without an error; one as frequent is another name
    sure = fits.where(F.col("cost") < TYPO).groupBy("name_id").agg(F.sum("n").alias("sure"))
    fits = fits.join(sure, "name_id", "left").where((F.col("cost") < TYPO + DOUBT) | (F.col("n") <= RARE * F.coalesce("sure", F.lit(0))))
    fits = fits.join(known.select("name_id", "full_name"), "name_id").where("value <> full_name").select("kind", "value", "name_id")
    return source.join(fits, ["kind", "value"]).select("tab", "row_id", "field", "name_id").distinct()
