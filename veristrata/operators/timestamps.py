"""Timestamps of many notations, precisions and zones brought to one form.

Every value is read in all valid ways; the readings of a value are an array. Within each
source the readings are chosen by Viterbi over the source's record order: changing the
notation, stepping back in time and readings that the source's clock speaks against cost, so
03/04/2020 between 15/03/2020 and 20/04/2020 is read day first, and EST on a site in Sydney
is Australian. A record with one reading cuts the chain, so only runs of undecided records
are solved, each between its decided neighbours.

Rows are placed by (source, block of ``BLOCK`` consecutive record numbers) and sorted inside
their partition, so a source with a third of all rows spreads over the cluster. Blocks do not
cut a chain: a run that reaches over the edge of a block is kept apart, each block sums it up
as the costs between its first and last states (a min-plus matrix), the sums of a source are
solved in order, a few numbers a block, and every part of the run is then finished from the
states it was given. The choice is the same whatever the size of the blocks.

Defined results: null, blank and unreadable values, non-existing dates and relative words
give no row; a record delivered twice counts once; an unknown or null source has no zone, so
its zoneless times of day are unreadable; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536
#: Costs of another notation than the record before, of an earlier time, and of a reading that the source's clock speaks against.
SWITCH_COST, BACK_COST, HINT_COST = 10_000_000_000, 6_000_000_000, 20_000_000_000

_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
#: Offsets in hours that zone abbreviations stand for; several where the abbreviation is shared.
_ABBR = {"UTC": [0], "GMT": [0], "Z": [0], "WET": [0], "WEST": [1], "CET": [1], "CEST": [2], "EET": [2], "EEST": [3], "MSK": [3], "BST": [1, 6], "IST": [5.5, 2, 1], "CST": [8, -6], "CDT": [-5], "EST": [-5, 10], "EDT": [-4, 11], "MST": [-7, 8], "MDT": [-6], "PST": [-8, 8], "PDT": [-7], "JST": [9], "KST": [9], "HKT": [8], "SGT": [8], "AEST": [10], "AEDT": [11], "ACST": [9.5], "AWST": [8], "NZST": [12], "NZDT": [13]}
_ZH_DIGIT = {c: str(i) for i, c in enumerate("〇一二三四五六七八九")} | {"零": "0", "○": "0"}
_LABEL = re.compile(r"^(?:[一-鿿]{2,8}\s*[:：]\s*|(?:published|updated|posted|accessed|retrieved|date|on)\b\s*(?:on|at)?\s*[:：]?\s*)", re.I)
_BEIJING = re.compile(r"^(?:北京时间|中国标准时间)\s*[:：]?\s*")
_TIME = r"(\d{1,2})[:：](\d{2})(?:[:：](\d{2})(?:[.,]\d+)?)?"
_ZONE = r"\s*(?:\(?(Z|UTC|GMT)?\s*([+-]\d{1,2}:?\d{2}|[+-]\d{1,2})?(?:\s*\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?|\(?([A-Z]{2,5})|([A-Z][A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+))\)?"
_YMD_TIME = re.compile(rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:\s*T\s*|\s+|,\s*){_TIME}\s*([AaPp]\.?[Mm]\.?)?{_ZONE}")
_ZH = re.compile(r"(\d{4})\s*年(?:\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*[日号](?:\s*(凌晨|早上|上午|中午|下午|晚上|傍晚)?\s*(\d{1,2})(?:[:：]|时|点)(\d{2})?分?(?:[:：]?(\d{2})秒?(?:[.,]\d+)?)?)?)?)?")
_EN_DM = re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}\s*([AaPp]\.?[Mm]\.?)?{_ZONE})?")
_EN_MD = re.compile(rf"(?:[A-Za-z]{{3,9}},\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TIME}\s*([AaPp]\.?[Mm]\.?)?{_ZONE})?")
_EN_MY = re.compile(r"([A-Za-z]{3,9})\.?,?\s+(\d{4})")
_COMPACT = re.compile(r"(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?\s*(Z|[+-]\d{2}:?\d{2})?")
_YMD_ZH = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})\s*((?:凌晨|早上|上午|中午|下午|晚上|傍晚)\s*\d{1,2}.*)")
_YMD = re.compile(r"(\d{4})([-/.])(\d{1,2})(?:\2(\d{1,2}))?")
_DMY = re.compile(rf"(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:,?\s+{_TIME}\s*([AaPp]\.?[Mm]\.?)?{_ZONE})?")
_MY = re.compile(r"(\d{1,2})[-/.](\d{4})")
_SPAN = re.compile(r"(.{4,}?)\s*(?:-|–|—|―|−|~|～|〜|至|到|\bto\b)+\s*(.+)")
_NOW = re.compile(r"^(?:至\s*)?(?:至今|现在|今|present|now|ongoing|current)$", re.I)


def _zh_numerals(s: str) -> str:
    """Dates in Chinese numerals to digits: the year digit by digit, month and day as numbers to 31."""

    def number(m: re.Match) -> str:
        x = m.group(1)
        if "十" in x:
            a, _, b = x.partition("十")
            return f"{int(_ZH_DIGIT.get(a, '1')) * 10 + int(_ZH_DIGIT.get(b, '0'))}{m.group(2)}"
        return "".join(_ZH_DIGIT[c] for c in x) + m.group(2)

    return re.sub(r"([〇零○一二三四五六七八九十]+)(年|月|日|号)", number, s)


def _offset(text: str) -> timezone | None:
    t = text.replace(":", "")
    h, m = int(t[1:3] if len(t) > 2 else t[1:]), int(t[3:5] or 0)
    if h > 18 or m > 59:
        return None
    return timezone((timedelta(hours=h, minutes=m)) * (-1 if t[0] == "-" else 1))


_zones: dict[str, ZoneInfo | None] = {}


def _zone(name: str | None) -> ZoneInfo | None:
    if name not in _zones:
        try:
            _zones[name] = ZoneInfo(name) if name else None
        except Exception:  # noqa: BLE001 - an unknown name is simply no zone
            _zones[name] = None
    return _zones[name]


def _instant(y: int, mo: int, d: int, h: int, mi: int, s: int, tz) -> tuple[str, float] | None:
    """Wall clock to UTC; fold 0 takes the earlier of two instants and moves a skipped time forward."""
    try:
        t = datetime(y, mo, d, h, mi, s, tzinfo=tz).astimezone(timezone.utc)
    except (ValueError, OverflowError):
        return None
    return f"{t:%Y-%m-%dT%H:%M:%SZ}".rjust(20, "0"), t.timestamp()


def _day(y: int, m: int, d: int) -> tuple[str, float] | None:
    try:
        x = date(y, m, d)
    except ValueError:
        return None
    return f"{y:04d}-{m:02d}-{d:02d}", (x.toordinal() - 719163) * 86400.0


def _month(y: int, m: int) -> tuple[str, float] | None:
    x = _day(y, m, 1) if y >= 1000 else None
    return x and (x[0][:7], x[1])


def _timed(ymd: tuple[int, int, int], time: tuple, zone: tuple, site_tz: str | None, fmt: str) -> list[tuple]:
    h, mi, s, half = time
    h, mi, s = int(h), int(mi or 0), int(s or 0)
    if half:
        if not 1 <= h <= 12:
            return []
        h = h % 12 + 12 * (half[0] in "pP")
    z0, off, region, abbr, region2 = zone
    if off:
        tzs = [_offset(off)]
    elif z0 or abbr:
        name = z0 or abbr
        tzs = [timezone(timedelta(hours=x)) for x in _ABBR.get(name, [])]
        if len(tzs) > 1:  # the usual meaning, but rather the one that the site's own clock has at that time
            there = None
            if home := _zone(site_tz):
                try:
                    there = datetime(*ymd, h, mi, s, tzinfo=home).utcoffset()
                except ValueError:
                    return []
            at_home = [z.utcoffset(None) == there for z in tzs]
            costs = [HINT_COST * (not x) for x in at_home] if any(at_home) else [HINT_COST * (i > 0) for i in range(len(tzs))]
            out = [(_instant(*ymd, h, mi, s, z), c) for z, c in zip(tzs, costs)]
            return [(*x, fmt, c) for x, c in out if x]
    else:
        tzs = [_zone(region or region2 or site_tz)]
    out = [_instant(*ymd, h, mi, s, z) for z in tzs if z is not None]
    return [(*x, fmt, 0) for x in out if x]


def readings(value: str | None, site_tz: str | None = None) -> list[tuple[str, float, str, int]]:
    """All valid readings of a value: (normal form, seconds since 1970 for ordering, notation, cost of what speaks against it)."""
    if value is None:
        return []
    s = value if value.isascii() else unicodedata.normalize("NFKC", value)
    s = re.sub(r"[​-‏⁠﻿­]", "", s).strip()
    if not s:
        return []
    if s.isdigit() and s.isascii():
        return _bare(s)
    if m := _YMD_TIME.fullmatch(s):
        return _timed((int(m[1]), int(m[3]), int(m[4])), m.group(5, 6, 7, 8), m.group(9, 10, 11, 12, 13), site_tz, "ymd" + m[2])
    if m := _YMD.fullmatch(s):
        x = _day(int(m[1]), int(m[3]), int(m[4])) if m[4] else _month(int(m[1]), int(m[3]))
        return [(*x, "ymd" + m[2], 0)] if x else []
    if "T" in s and (m := _COMPACT.fullmatch(s)):
        return _timed((int(m[1]), int(m[2]), int(m[3])), (m[4], m[5], m[6], None), (None, None if m[7] == "Z" else m[7], "UTC" if m[7] == "Z" else None, None, None), site_tz, "compact")
    if m := _YMD_ZH.fullmatch(s):
        s = f"{m[1]}年{m[3]}月{m[4]}日 {m[5]}"
    zone_hint = None
    if m := _BEIJING.match(s):
        s, zone_hint = s[m.end() :], "Asia/Shanghai"
    elif m := _LABEL.match(s):
        s = s[m.end() :]
    if zone_hint or m:
        inner = readings(s, zone_hint or site_tz)
        return [(n, t, "label " + f, c) for n, t, f, c in inner]
    if re.search(r"[〇零○一二三四五六七八九十]+[年月]", s):
        s = _zh_numerals(s)
    if m := _ZH.fullmatch(s):
        y, mo, d, half, h, mi, sec = m.groups()
        if h is not None:
            h = int(h)
            if h > 24 or (half and h > 12 and half not in ("下午", "晚上", "傍晚", "中午")):
                return []
            if half in ("下午", "晚上", "傍晚") and h < 12 or half == "中午" and h < 11:
                h += 12
            elif half in ("凌晨", "早上", "上午") and h == 12:
                h = 0
            x = _instant(int(y), int(mo), int(d), h, int(mi or 0), int(sec or 0), z) if (z := _zone(site_tz)) else None
        else:
            x = _day(int(y), int(mo), int(d)) if d else _month(int(y), int(mo)) if mo else _year(y)
        return [(*x, "zh", 0)] if x else []
    if m := _EN_DM.fullmatch(s):
        d, name, y, *rest = m.groups()
        return _english(y, name, d, rest, site_tz, "d mon y")
    if m := _EN_MD.fullmatch(s):
        name, d, y, *rest = m.groups()
        return _english(y, name, d, rest, site_tz, "mon d, y")
    if (m := _EN_MY.fullmatch(s)) and (mo := _month_name(m[1])):
        x = _month(int(m[2]), mo)
        return [(*x, "mon y", 0)] if x else []
    if m := _DMY.fullmatch(s):
        a, sep, b, y, *rest = m.groups()
        out = []
        for d, mo, fmt in ((a, b, "dmy"), (b, a, "mdy")):
            ymd = int(y), int(mo), int(d)
            if x := _day(*ymd):
                found = _timed(ymd, rest[:4], rest[4:], site_tz, fmt + sep) if rest[0] else [(*x, fmt + sep, 0)]
                out += [f for f in found if f[0] not in {o[0] for o in out}]
        return out
    if m := _MY.fullmatch(s):
        x = _month(int(m[2]), int(m[1]))
        return [(*x, "my", 0)] if x else []
    if m := _SPAN.fullmatch(s):
        a, b = readings(m[1].strip()), m[2].strip()
        if len(a) == 1 and len(a[0][0]) == 7:
            if _NOW.match(b):
                return [(a[0][0] + "/..", a[0][1], "span", 0)]
            z = readings(b)
            if len(z) == 1 and len(z[0][0]) == 7:
                return [(f"{a[0][0]}/{z[0][0]}", a[0][1], "span", 0)]
    return []


def _year(y: str) -> tuple[str, float] | None:
    return (y, _day(int(y), 1, 1)[1]) if 1000 <= int(y) <= 2999 else None


def _bare(s: str) -> list[tuple]:
    """A bare number by its length: year, month, day, day with time, or Unix time."""
    x, n = None, len(s)
    if n == 4:
        x = _year(s)
    elif n == 6:
        x = _month(int(s[:4]), int(s[4:]))
    elif n == 8:
        x = _day(int(s[:4]), int(s[4:6]), int(s[6:]))
    elif n in (10, 13, 16):
        t = int(s) // 10 ** (n - 10)
        x = (f"{datetime.fromtimestamp(t, timezone.utc):%Y-%m-%dT%H:%M:%SZ}", float(t))
    return [(*x, f"bare {n}", 0)] if x else []


def _month_name(name: str) -> int | None:
    full = "january february march april may june july august september october november december sept".split()
    n = name.lower()
    return _MONTHS.get(n[:3]) if len(n) == 3 or n in full else None


def _english(y: str, name: str, d: str, rest: list, site_tz: str | None, fmt: str) -> list[tuple]:
    if not (mo := _month_name(name)) or not (x := _day(int(y), mo, int(d))):
        return []
    return _timed((int(y), mo, int(d)), rest[:4], rest[4:], site_tz, fmt) if rest[0] else [(*x, fmt, 0)]


def step_cost(a: tuple, b: tuple) -> int:
    """Of reading a record as b after the one before was read as a."""
    return SWITCH_COST * (a[2] != b[2]) + BACK_COST * (b[1] < a[1])


def own_costs(found: list[tuple], row_id: int = 0) -> list[int]:
    """Of each reading of a record by itself; a little more for later ones, by the record's number, so that no two ways cost the same."""
    return [r[3] + k * (1000 + row_id % 997) for k, r in enumerate(found)]


def _forward(chain: list[list[tuple]], own: list[list[int]], cost: list[float]) -> tuple[list[float], list[list[int]]]:
    """Least costs of the states of the last record, from those of the first, and where each came from."""
    back = []
    for before, now, mine in zip(chain, chain[1:], own[1:]):
        new, came = [], []
        for b, m in zip(now, mine):
            c, k = min((cost[i] + step_cost(a, b), i) for i, a in enumerate(before))
            new.append(c + m)
            came.append(k)
        cost, back = new, [*back, came]
    return cost, back


def viterbi(chain: list[list[tuple]], row_ids: list[int] | None = None, first: int | None = None, last: int | None = None) -> list[int]:
    """The cheapest choice of readings along a chain of records; its ends may be given."""
    if not chain:
        return []
    own = [own_costs(f, i) for f, i in zip(chain, row_ids or [0] * len(chain))]
    cost, back = _forward(chain, own, [c if first in (None, i) else float("inf") for i, c in enumerate(own[0])])
    k = last if last is not None else min(range(len(cost)), key=lambda i: (cost[i], i))
    path = [k]
    for came in reversed(back):
        path.append(k := came[k])
    return path[::-1]


def matrix(chain: list[list[tuple]], row_ids: list[int]) -> list[list[float]]:
    """The least cost from each state of the first record to each of the last, both included."""
    own = [own_costs(f, i) for f, i in zip(chain, row_ids)]
    return [_forward(chain, own, [c if i == k else float("inf") for k, c in enumerate(own[0])])[0] for i in range(len(chain[0]))]


_OUT = pa.schema([("tab", pa.string()), ("row_id", pa.int64()), ("field", pa.string()), ("normal", pa.string()), ("n_readings", pa.int32()), ("notation", pa.string())])
_READING = pa.struct([("normal", pa.string()), ("t", pa.float64()), ("notation", pa.string()), ("cost", pa.int64())])
_EDGE = pa.schema([("chain", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("tab", pa.string()), ("row_id", pa.int64()), ("field", pa.string()), ("found", pa.list_(_READING)), ("first", pa.list_(_READING)), ("last", pa.list_(_READING)), ("cost", pa.list_(pa.float64()))])
_EDGE_SQL = "chain string, block bigint, part int, tab string, row_id bigint, field string, found array<struct<normal:string,t:double,notation:string,cost:bigint>>, first array<struct<normal:string,t:double,notation:string,cost:bigint>>, last array<struct<normal:string,t:double,notation:string,cost:bigint>>, cost array<double>"


class _Memo:
    """Readings of short values, which repeat; an hour among them depends on the zone."""

    def __init__(self) -> None:
        self.kept: dict[tuple[str, str | None], list] = {}

    def __call__(self, value: str, tz: str | None) -> list[tuple]:
        found = self.kept.get((value, tz))
        if found is None:
            found = readings(value, tz)
            if len(value) <= 12 and ":" not in value:
                if len(self.kept) > 50_000:
                    self.kept.clear()
                self.kept[value, tz] = found
        return found


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition in, the chosen reading of each record out, but for runs that reach the edge of a block."""
    last_key, chain_key = None, None
    prev: list[tuple] | None = None  # the decided record before the open run
    run: list[tuple] = []  # undecided records: (tab, row_id, field, readings)
    read = _Memo()
    out: list[tuple] = []

    def close(after: list[tuple]) -> None:
        if run and prev:
            picks = viterbi([prev, *(r[3] for r in run), after], [0, *(r[1] for r in run), 0])[1:-1]
            out.extend((t, i, f, c[k][0], len(c), c[k][2]) for (t, i, f, c), k in zip(run, picks))
        run.clear()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[] for _ in _OUT]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)

    for batch in batches:
        for tab, row_id, field, source, block, tz, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (tab, field, row_id) == last_key:
                continue
            last_key = tab, field, row_id
            key = tab, source, block, field
            if key != chain_key:
                run.clear()
                prev, chain_key = None, key
            found = read(value, tz)
            if not found:
                continue
            if len(found) == 1:
                if run:
                    close(found)
                prev = found
                x = found[0]
                out.append((tab, row_id, field, x[0], 1, x[2]))
            else:
                run.append((tab, row_id, field, found))
        yield flush()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chain in each block: its undecided records before the first and after the last decided one, and what each of the two parts sums up to.

    Values are read from both ends only until one is decided.
    """
    read = _Memo()
    held: list[tuple] = []  # the records of the chain in its block, at most BLOCK
    out: list[tuple] = []

    def close(key: tuple) -> None:
        tab, source, block, field = key
        chain = json.dumps([tab, source, field])

        def upto(rows) -> list[tuple[int, list[tuple]]]:
            got = []
            for row_id, tz, value in rows:
                if found := read(value, tz):
                    got.append((row_id, found))
                    if len(found) == 1:
                        break
            return got

        lead = upto(held)
        parts = [lead]
        if lead and len(lead[-1][1]) == 1:
            parts.append(upto(reversed(held))[::-1])
        for part, got in enumerate(parts):
            if not got:
                continue
            states = [[dict(zip(("normal", "t", "notation", "cost"), r)) for r in f] for _, f in got]
            for (row_id, found), s in zip(got, states):
                if len(found) > 1:
                    out.append((chain, block, part, tab, row_id, field, s, None, None, None))
            m = matrix([f for _, f in got], [i if len(f) > 1 else 0 for i, f in got])
            out.append((chain, block, part, None, None, None, None, states[0], states[-1], [x for r in m for x in r]))

    chain_key, last_id = None, None
    for batch in batches:
        for tab, row_id, field, source, block, tz, value in zip(*(c.to_pylist() for c in batch.columns)):
            key = tab, source, block, field
            if key != chain_key:
                if held:
                    close(chain_key)
                held, chain_key, last_id = [], key, None
            if row_id != last_id:
                held.append((row_id, tz, value))
                last_id = row_id
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _EDGE)], schema=_EDGE)
            out = []
    if held:
        close(chain_key)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _EDGE)], schema=_EDGE)


def _tuples(found) -> list[tuple]:
    return [(r["normal"], r["t"], r["notation"], int(r["cost"])) for r in found]


def ends(sums: list[tuple]) -> dict[tuple[int, int], tuple[int, int]]:
    """The parts of one chain, (block, part, first, last, matrix) in order, to the first and last state of each on the cheapest way through all of them."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    run: list[tuple] = []  # (block, part, where each first state was entered from, and each last one)

    def close(cost: list[float]) -> None:
        j = min(range(len(cost)), key=lambda i: (cost[i], i))
        for block, part, came, through in reversed(run):
            i = through[j]
            out[block, part] = i, j
            j = came[i]
        run.clear()

    before: tuple[list[float], list[tuple]] | None = None  # costs and states of the last record so far
    for block, part, first, last, flat in sums:
        m = [list(flat[i * len(last) : (i + 1) * len(last)]) for i in range(len(first))]
        if part == 1 and run:  # behind a decided record
            close(before[0])
            before = None
        enter, came = [0.0] * len(first), [0] * len(first)
        if before:
            for k, b in enumerate(first):
                enter[k], came[k] = min((before[0][i] + step_cost(a, b), i) for i, a in enumerate(before[1]))
        through = [min(range(len(first)), key=lambda i: (enter[i] + m[i][j], i)) for j in range(len(last))]
        cost = [enter[through[j]] + m[through[j]][j] for j in range(len(last))]
        run.append((block, part, came, through))
        before = cost, last
    if run:
        close(before[0])
    return out


_GIVEN = pa.schema([*list(_EDGE)[:9], ("first_state", pa.int32()), ("last_state", pa.int32())])
_GIVEN_SQL = _EDGE_SQL.rpartition(",")[0] + ", first_state int, last_state int"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains in order, the sums of each before its undecided records: these, as a stream, with the ends of their part. Only sums are held, a few numbers a block."""
    now, sums, given = None, [], None
    for b in batches:
        chains, blocks, parts, ids = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
        keep, states = [], []
        cols = None
        for i, (chain, block, part, row_id) in enumerate(zip(chains, blocks, parts, ids)):
            if chain != now:
                now, sums, given = chain, [], None
            if row_id is None:
                sums.append((block, part, b.column(7)[i], b.column(8)[i], b.column(9)[i]))
                continue
            if given is None:
                read = {(x[0], x[1]): (_tuples(x[2].as_py()), _tuples(x[3].as_py())) for x in sums}
                given = ends([(x[0], x[1], *read[x[0], x[1]], x[4].as_py()) for x in sums])
                edge = {(x[0], x[1]): (x[2].as_py(), x[3].as_py()) for x in sums}
            keep.append(i)
            states.append((*edge[block, part], *given[block, part]))
        cols = [b.column(i).take(pa.array(keep, pa.int32())) for i in range(7)]
        more = list(zip(*states)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array(m, f.type) for m, f in zip(more, list(_GIVEN)[7:]))], schema=_GIVEN)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each part, at most BLOCK, between its given ends."""
    now, held = None, []

    def close() -> list[tuple]:
        before, after = (_tuples(held[0][c]) for c in (7, 8))
        head, tail = len(before) == 1, len(after) == 1  # the part begins or ends with its decided record
        chain, ids = [_tuples(h[6]) for h in held], [h[4] for h in held]
        picks = viterbi([before] * head + chain + [after] * tail, [0] * head + ids + [0] * tail, held[0][9], held[0][10])[head : head + len(chain)]
        return [(h[3], h[4], h[5], c[k][0], len(c), c[k][2]) for h, c, k in zip(held, chain, picks)]

    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:3] != now:
                if held:
                    out += close()
                now, held = row[:3], []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*close()), _OUT)], schema=_OUT)


def normalise(values: DataFrame, block: int = BLOCK) -> DataFrame:
    """Readings chosen for values(tab string, row_id bigint, field string, source string, tz string, value string).

    Gives tab, row_id, field, normal, n_readings (how many different readings the value had) and
    notation; no row for what cannot be read.
    """
    rows = values.where("value is not null and row_id is not null").select("tab", "row_id", "field", "source", F.floor(F.col("row_id") / block).alias("block"), "tz", "value")
    placed = rows.repartition("tab", "source", "block").sortWithinPartitions("tab", "source", "block", "field", "row_id")
    out = "tab string, row_id bigint, field string, normal string, n_readings int, notation string"
    edges = placed.mapInArrow(_edges, _EDGE_SQL).repartition("chain").sortWithinPartitions("chain", F.col("row_id").isNotNull(), "block", "part")
    given = edges.mapInArrow(_solve, _GIVEN_SQL).repartition("chain", "block", "part").sortWithinPartitions("chain", "block", "part", "row_id")
    finished = given.mapInArrow(_finish, out)
    return placed.mapInArrow(_decide, out).unionByName(finished)
