"""Keyed surrogates for personal items: same entity same surrogate, different entities different ones.

An item is first brought to the *entity* it spells: width, case, blanks, separators, country
prefixes of mainland numbers and written-out signs of addresses make no difference, so all
spellings of an item share one surrogate (coreference). The surrogate of an entity is drawn
from a keyed hash, in the entity's kind, script, format and, where a name tells it, gender:

* names keep their parts (surname and given name, initials, compound surnames); one surname
  has one surrogate under a key, so relatives stay relatives;
* e-mail addresses keep the shape of their local part and the public endings of their host,
  and one host has one surrogate;
* telephone numbers keep country code, trunk prefix, kind (mobile or fixed) and grouping;
* numbers of identity cards get a valid date, keep the parity that tells the sex, and carry
  the check digit of their new number; passports keep their letters' count, social security
  numbers a valid area;
* addresses get other places, streets and numbers; one place name has one surrogate.

Collisions are checked in rounds: of the entities that drew one surrogate the first keeps it;
the others, and those that drew an entity of the corpus, draw again from a space that grows
with the round, against all surrogates taken so far, until none is left. What is shuffled are
distinct entities; a surrogate is drawn by few of them, as the spaces are large.

The surrogate is then written in the form of each spelling: digits in its grouping, signs
written out as they were, capitals where it had capitals.

Defined results: no items give no surrogates; null kinds or items are left out; an item that
is found in many rows is one item; an unknown kind keeps its shape, letters and digits drawn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.llm.personal import _AT, _DOT, COMPOUND, FEMALE, MALE, View
from veristrata.tables import cut

#: Characters and words that surrogates are made of (fixed values).
_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许邓冯韩曹曾彭肖蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷黎史龙陶贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_GIVEN = "安柏晨岱恩枫歌涵可铭宁沛清然思桐彦泽知舟文以若言景书一承远航乐天佑启明星河山川原野林溪谷雨雪云岚朗朔禾禹尧舜念初心怀谦和正平易简朴素真诚信义仁礼智"
_GIVEN_F, _GIVEN_M = "婷芳娜丽娟敏静秀霞燕艳玲萍红莉莹雅琳倩洁妍嫣婉瑶琴蓉梅菊兰莲薇", "伟强军勇涛刚磊鹏杰斌超峰辉健彪雄武虎龙豪威浩海坚钢铁柱栋梁魁"
_NEUTRAL = "Alex Robin Sam Kim Jordan Taylor Casey Jamie Morgan Riley Avery Quinn Rowan Sasha Noa Charlie Dana Lee Ariel Nico Toni Sidney Blair Jules Remy Skyler Emery Finley Harley Kai".split()
_ONSET, _VOWEL, _END = "b br c d dr f g gr h k l m n p r s st t tr v w".split(), "a e i o u ea".split(), "bury den dale ford ham land ley low man mere mont more nard ric son stead ton vale wick worth".split()
_PLACE = "云石松柳梅竹枫桂荷莲溪泉湖河江海山岭峰岩林原野谷川湾港桥塘洲滨泽南北东西中上下新古长宽高平安宁康乐福寿星月日晨曦霞虹金银玉珠翠青蓝红紫白"
_UNITS = "号院 号楼 号 院 弄 栋 幢 座 楼 单元 层 室 户".split()
_ZH_PART = re.compile(r"(.{1,8}?)(自治区|大道|胡同|小区|公寓|大厦|花园|新村|家园|[省市区县路街巷道弄里苑园庭府城村寓])")
_KEEP = set("road street lane avenue row close court drive causeway wharf way place square terrace hill mews crescent boulevard gardens walk parade quay rd st ave blvd ln dr unit flat apt apartment suite floor room north south east west no old new".split())
_PUBLIC = set("com org net edu ac gov co cn uk de fr example test invalid io info mail".split())
_PROVINCES = (11, 12, 13, 14, 15, 21, 22, 23, 31, 32, 33, 34, 35, 36, 37, 41, 42, 43, 44, 45, 46, 50, 51, 52, 53, 54, 61, 62, 63, 64, 65)
_AT_SIGN, _DOT_SIGN = re.compile(rf"(?:{_AT}|\s?@\s?| at )", re.I), re.compile(rf"(?:{_DOT}| dot )", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


class Draw:
    """Numbers from a keyed hash of what is named."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.more, self.left = key[:64], "\0".join(map(str, what)), 0, 0
        self._fill()

    def _fill(self) -> None:
        h = hashlib.blake2b(f"{self.more}\0{self.what}".encode("utf-8", "surrogatepass"), key=self.key, digest_size=64)
        self.seed, self.left, self.more = int.from_bytes(h.digest(), "big"), 480, self.more + 1

    def __call__(self, n: int) -> int:
        self.left -= n.bit_length()
        if self.left < 0:
            self._fill()
        self.seed, r = divmod(self.seed, n)
        return r

    def other(self, pool, than: str):
        """One of the pool that is not ``than``."""
        x = pool[self(len(pool))]
        while x == than:
            x = pool[self(len(pool))]
        return x

    def digits(self, n: int, first: str = "0123456789") -> str:
        return "".join((first if i == 0 else "0123456789")[self(len(first) if i == 0 else 10)] for i in range(n))

    def word(self) -> str:
        return _ONSET[self(len(_ONSET))] + _VOWEL[self(len(_VOWEL))] + _ONSET[self(len(_ONSET))] + _VOWEL[self(5)] + _END[self(len(_END))]


def entity(kind: str, item: str) -> str:
    """The entity an item spells."""
    s = re.sub(r"\s+", " ", View(item).text).strip()
    if kind == "email":
        return _DOT_SIGN.sub(".", _AT_SIGN.sub("@", s)).replace(" ", "").lower()
    if kind == "phone":
        plus, d = "+" if s.lstrip("(（").startswith("+") else "", "".join(c for c in s if c.isdigit())
        if len(d) in (13, 15) and re.fullmatch(r"(?:00)?86(1[3-9]\d{9})", d):
            return d[-11:]
        if plus:  # the code of the country stands apart
            code = re.match(r"\D*(\d{1,3})", s)[1]
            code = code if len(code) < len(d) and re.match(rf"\D*{code}\D", s) else "1" if d[0] == "1" else "7" if d[0] == "7" else d[:2]
            return f"+{code} {d[len(code):]}"
        return d
    if kind == "id_number":
        return re.sub(r"[\s-]", "", s).upper() if not re.fullmatch(r"\d{3}-\d{2}-\d{4}", s) else s
    if kind == "address":
        return s.replace(" ", "") if re.search("[一-鿿]", s) else s.lower()
    return s.casefold()


def _check_digit(body: str) -> str:
    """Of an identity card: weights 2^(17-i) modulo 11."""
    total = sum(int(c) * pow(2, 17 - i, 11) for i, c in enumerate(body)) % 11
    return "10X98765432"[total]


def _day(draw: Draw, y: str) -> date:
    return date(int(y), 1, 1) + timedelta(days=draw(365))


def _gender(given: str) -> str:
    if given.isascii():
        return "f" if given.title() in FEMALE else "m" if given.title() in MALE else ""
    f, m = sum(c in _GIVEN_F for c in given), sum(c in _GIVEN_M for c in given)
    return "f" if f > m else "m" if m > f else ""


def _name(key: bytes, who: str, draw: Draw, again: int) -> str:
    if "一" <= who[0] <= "鿿":
        k = 2 if who[:2] in COMPOUND and len(who) > 2 else 1
        surname, given = who[:k], who[k:]
        family = Draw(key, "surname", surname, again if again > 1 else 0)
        out = family.other(COMPOUND if k == 2 else _SURNAMES, surname)
        pool = {"f": _GIVEN_F + _GIVEN, "m": _GIVEN_M + _GIVEN}.get(_gender(given), _GIVEN)
        n = max(len(given), 1) + (again + 1) // 2
        return out + "".join(draw.other(pool, given[i] if i < len(given) else "") for i in range(n))
    words = who.split(" ")
    first, last = words[0], words[-1]
    given = draw.other({"f": FEMALE, "m": MALE}.get(_gender(first), _NEUTRAL), first.title())
    given = f"{chr(97 + draw(26))}." if first.endswith(".") else given.lower()
    family = Draw(key, "surname", last, again if again > 1 else 0)
    surname = "-".join(family.word() for _ in last.split("-"))
    middle = [f"{chr(97 + draw(26))}." for w in words[1:-1]] + [f"{chr(97 + draw(26))}." for _ in range(again)]
    return " ".join([given, *middle, surname])


def _email(key: bytes, who: str, draw: Draw, again: int) -> str:
    local, _, host = who.partition("@")
    out = "".join(str(draw(10)) if c.isdigit() else chr(97 + draw(26)) if c.isalpha() else c for c in local) + "".join(chr(97 + draw(26)) for _ in range(again))
    labels = host.split(".")
    at_host = Draw(key, "host", host)
    labels = [x if x in _PUBLIC and i else "".join(chr(97 + at_host(26)) if c.isalpha() else str(at_host(10)) if c.isdigit() else c for c in x) for i, x in enumerate(labels[:-1])] + labels[-1:]
    return f"{out}@{'.'.join(labels)}"


def _phone(who: str, draw: Draw, again: int) -> str:
    code, _, d = who.rpartition(" ")
    more = draw.digits(max(again - 2, 0))
    if not code and re.fullmatch(r"1[3-9]\d{9}", d):
        return "1" + "3456789"[draw(7)] + draw.digits(9) + more
    if not code and d.startswith("0"):
        return "0" + draw.digits(1, "123456789") + draw.digits(len(d) - 2) + more
    return (code + " " if code else "") + draw.digits(len(d), "23456789") + more


def _id(who: str, draw: Draw, again: int) -> str:
    more = draw.digits(max(again - 2, 0))
    if re.fullmatch(r"\d{17}[\dX]", who):
        sex = int(who[16]) % 2
        body = f"{_PROVINCES[draw(len(_PROVINCES))]}{draw.digits(4)}{_day(draw, str(min(max(int(who[6:10]) - 5 + draw(11), 1800), 2099))):%Y%m%d}{draw.digits(2)}{draw(5) * 2 + sex}"
        return body + _check_digit(body) + more
    if re.fullmatch(r"\d{15}", who):
        return f"{_PROVINCES[draw(len(_PROVINCES))]}{draw.digits(4)}{_day(draw, str(1900 + int(who[6:8]))):%y%m%d}{draw.digits(2)}{draw(5) * 2 + int(who[14]) % 2}{more}"
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", who):
        return f"{1 + draw(665):03d}-{1 + draw(99):02d}-{1 + draw(9999):04d}{more}"
    return "".join(str(draw(10)) if c.isdigit() else chr(65 + draw(26)) if c.isalpha() else c for c in who) + more


def _number(draw: Draw, old: str, again: int) -> str:
    x = draw.digits(len(old) + max(again - 1, 0), "123456789")
    while x == old:
        x = draw.digits(len(old), "123456789")
    return x


def place_parts(address: str) -> list[str]:
    """The words of an address that name a place."""
    if not re.search("[一-鿿]", address):
        return [w for w in _LETTERS.findall(address.lower()) if w not in _KEEP and len(w) > 1]
    out = []
    for run in re.findall(r"[^\d\s-]+", address):
        for u in _UNITS:
            if run.startswith(u):
                run = run[len(u) :]
                break
        out += [m[1] for m in _ZH_PART.finditer(run)]
    return out


def _address(key: bytes, who: str, draw: Draw, again: int) -> str:
    if not re.search("[一-鿿]", who):

        def english(m: re.Match) -> str:
            w = m[0]
            if w.isdigit():
                return _number(draw, w, again)
            if w in _KEEP:
                return w
            if len(w) <= 2:
                return "".join(chr(97 + draw(26)) for _ in w)
            d = Draw(key, "place", w)
            x = d.word()
            while x == w:
                x = d.word()
            return x

        return re.sub(r"\d+|[^\W\d_]+", english, who)

    def part(m: re.Match) -> str:
        d = Draw(key, "place", m[1], m[2])
        return "".join(d.other(_PLACE, c) for c in m[1]) + m[2]

    def chinese(m: re.Match) -> str:
        run = m[0]
        if run.isdigit():
            return _number(draw, run, again)
        unit = next((u for u in _UNITS if run.startswith(u)), "")
        return unit + _ZH_PART.sub(part, run[len(unit) :])

    return re.sub(r"\d+|[^\d\s-]+", chinese, who)


def draw_surrogate(kind: str, who: str, key: bytes, again: int = 0) -> str:
    """The surrogate of an entity in the given round, itself in the form of an entity and never the entity."""
    more = 0
    while True:
        draw = Draw(key, kind, who, again, more)
        if kind == "name":
            x = _name(key, who, draw, again)
        elif kind == "email":
            x = _email(key, who, draw, again)
        elif kind == "phone":
            x = _phone(who, draw, again)
        elif kind == "id_number":
            x = _id(who, draw, again)
        elif kind == "address":
            x = _address(key, who, draw, again)
        else:
            x = "".join(str(draw(10)) if c.isdigit() else chr(97 + draw(26)) if c.isalpha() else c for c in who) + draw.digits(again)
        if x != who:
            return x
        more += 1


def render(kind: str, item: str, new: str) -> str:
    """The surrogate in the form of the spelling it replaces."""
    s = re.sub(r"\s+", " ", View(item).text).strip()
    if kind == "name":
        if not new.isascii():
            return new
        return new.upper() if s.isupper() else re.sub(r"[^\W\d_]+", lambda m: m[0][0].upper() + m[0][1:], new)
    if kind == "email":
        at = _AT_SIGN.search(s)
        dot = _DOT_SIGN.search(s)
        local, _, host = new.partition("@")
        x = local + (at[0] if at else "@") + (host.replace(".", dot[0]) if dot else host)
        return x.upper() if s.isupper() else x
    if kind == "address":
        if not re.search("[一-鿿]", s):
            return re.sub(r"[^\W\d_]+", lambda m: m[0].upper() if len(m[0]) <= 2 and m[0] not in _KEEP else m[0][0].upper() + m[0][1:], new) if not s.isupper() else new.upper()
        return new
    # digits and letters take the places that the spelling had them in
    fresh = [c for c in new if c.isalnum()]
    old = sum(c.isalnum() for c in s)
    if kind == "phone" and old > len(fresh):  # a country prefix that all spellings share
        head, lead = 0, old - len(fresh)
        while lead:
            lead -= s[head].isalnum()
            head += 1
        while not s[head].isalnum():
            head += 1
        return s[:head] + render("", s[head:], new)
    it = iter(fresh)
    body = "".join(next(it, "") if c.isalnum() else c for c in s)
    return body + "".join(it)


_DRAWN = pa.schema([("kind", pa.string()), ("entity", pa.string()), ("form", pa.string())])


def _draws(key: bytes, again: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [draw_surrogate(k, e, key, again) for k, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], schema=_DRAWN)

    return run


def assigned(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, form): one surrogate for each of the distinct (kind, entity), no two alike and none an entity itself."""
    entities = cut(entities)
    real = entities.select("kind", F.col("entity").alias("form"), F.lit(True).alias("real"))
    taken, waiting, again = None, entities, 0
    while True:
        drawn = waiting.select("kind", "entity").mapInArrow(_draws(key, again), "kind string, entity string, form string").join(real, ["kind", "form"], "left")
        if taken is not None:
            drawn = drawn.join(taken.select("kind", "form", F.lit(True).alias("used")), ["kind", "form"], "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("boolean"))
        first = F.row_number().over(W.partitionBy("kind", "form").orderBy("entity")) == 1
        drawn = cut(drawn.select("kind", "entity", "form", (first & F.col("real").isNull() & F.col("used").isNull()).alias("won")))
        won = drawn.where("won").select("kind", "entity", "form")
        taken = won if taken is None else taken.unionByName(won)
        waiting = drawn.where("not won").select("kind", "entity")
        if waiting.isEmpty():
            return taken
        again += 1


_SPELT = pa.schema([("kind", pa.string()), ("found_text", pa.string()), ("entity", pa.string())])


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([entity(k, t) for k, t in zip(kinds, texts)], pa.string())], schema=_SPELT)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [render(k, t, f) for k, t, f in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(got, pa.string())], names=["kind", "found_text", "entity", "surrogate"])


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, found_text, entity, surrogate) for the items of found(kind, found_text, ...)."""
    spelt = found.where("kind is not null and found_text is not null").select("kind", "found_text").distinct().mapInArrow(_entities, "kind string, found_text string, entity string")
    spelt = cut(spelt)
    given = assigned(spelt.select("kind", "entity").distinct(), key)
    return spelt.join(given, ["kind", "entity"]).select("kind", "found_text", "entity", "form").mapInArrow(_render, "kind string, found_text string, entity string, surrogate string")


def kept(kind: str, item: str, surrogate: str) -> bool:
    """True if a surrogate still tells the item: the same entity, or a place, surname, host or number of it."""
    a, b = entity(kind, item), entity(kind, surrogate)
    if a == b:
        return True
    if kind == "address":
        return bool({p for p in place_parts(a) if len(p) > 1} & set(place_parts(b)))
    if kind == "email":
        return a.partition("@")[0] == b.partition("@")[0]
    if kind == "name":
        return a.split(" ")[-1] == b.split(" ")[-1] if a.isascii() else a[1:] == b[1:]
    return False


def checks(done: DataFrame) -> DataFrame:
    """One row: surrogates that stand for several entities, entities with several surrogates' entities, surrogates that tell their item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, t, e, s = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([entity(*x) for x in zip(k, s)], pa.string()), b.column(3), pa.array([kept(*x) for x in zip(k, t, s)], pa.bool_())], names=["kind", "entity", "form", "surrogate", "kept"])

    seen = done.select("kind", "found_text", "entity", "surrogate").mapInArrow(run, "kind string, entity string, form string, surrogate string, kept boolean")
    shared = seen.groupBy("kind", "surrogate").agg(F.count_distinct("entity").alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared"))
    parted = seen.groupBy("kind", "entity").agg(F.count_distinct("form").alias("n")).agg(F.count_if(F.col("n") > 1).alias("parted"))
    return shared.join(parted).join(seen.agg(F.count_if("kept").alias("kept")))


__all__ = ["assigned", "checks", "draw_surrogate", "entity", "kept", "place_parts", "render", "surrogates"]
