"""Keyword-stuffed and link-list pages, by recurrence gaps and positional autocorrelation.

A page is read as terms: Latin words, single Chinese characters, links (one term each,
whatever their address) and numbers (one term). For every pair of neighbouring terms the gaps
between its occurrences are taken. Prose repeats its phrases at long, irregular gaps; stuffed
text repeats a few phrases inside a short lag window again and again. A place is *regular* if
its pair recurs within ``LAG`` terms and stands in the page three times or more.

Units of a page are its lines; long lines fall into sentences or stretches of ``UNIT_TERMS``.
A unit is stuffed if it is
  a link with its label, in brackets or beside it, of any length, but without a sentence or the parts and numbers of an entry;
  regular in most of its places without anything new (pairs that stand only once in the page,
  as the names in a roster or an author list do), more strictly so where it has the function
  words of a sentence;
  a priced offer, one of several, with regular places;
  a list of nouns without function words whose items recur, or that are marked as tags;
  in step: the positional autocorrelation of the unit, the largest share of its places whose
  next occurrence lies exactly one lag on, and the one after that as far again, is high within
  ``BEATS`` terms, and it has no function words. Prose that recurs does so at many lags.
A page is found where stuffed units make more than half of it.

The autocorrelation of the whole page and the spread of its gaps come out beside the verdict.

All documents of a batch are treated at once as arrays; a document is one row and stays in
its task, so nothing is shuffled and no group can grow hot. Only numbers leave the task.

Defined results: null and empty texts, and texts without terms, are no cases; texts of any
other length are judged, and read whole; repeated rows give one row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LAG = 48
#: Lags that the autocorrelation looks at, and the share of a unit's places on one of them that makes it in step.
BEATS, IN_STEP = 16 * LAG, 0.5
#: Items of a list behind a word for tags; an abstract names fewer.
TAGS = 9
UNIT_TERMS = 40
#: Least share of regular places, and most of new pairs, for a unit without and with function words.
LOOSE, STRICT, NEW, PROSE, PROSE_ZH = 0.45, 0.75, 0.2, 0.16, 0.05
#: Least share of recurring items in a short and in a long list, or of recurring single terms, in a list of nouns; of regular places in a priced offer.
ITEMS, SOME, SINGLE, OFFER = 0.65, 0.35, 0.75, 0.3
#: Most weight of a link where links are fewer than other units, as in an article.
LINK_CHARS = 24
BATCH_CHARS = 2_000_000
#: Frequent words that prose cannot do without (fixed values).
FUNCTION = "the of and to in a an for on with that by is was are were be at as it its from or this which who their has have had not but after before while when once into than then each about she he they we our".split()
#: What stands beside the number of a price (fixed values).
PRICE = ["元", "块", "折", "¥", "￥", "$", "€", "£", "usd", "eur", "gbp", "rmb", "cny", "off"]
FUNCTION_ZH = "的了在是与和为并由从到有将于其者所被及或把对就都也不未以等"

#: What a list of tags is announced by (fixed values).
_TAGS = re.compile(r"^[ \t]*(?:标签|关键词|热搜|热词|tags?|keywords|labels)[ \t]*[:：]|#(?=[^\W\d])", re.I | re.M)
_LINK = re.compile(r"\[([^\[\]\n]*)\]\(\s*(?:https?://|www\.)[^)\s]*\)|(?:https?://|www\.)[^\s<>()\[\]，。；、]+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|net|org|cn|top|xyz|info|shop|site|invalid|test|example)\b(?:/\S*)?")
_LINKISH = re.compile(r"://|www\.|\.(?:com|net|org|cn|top|xyz|info|shop|site|invalid|test|example)\b")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FAR = np.int64(1 << 40)
_MARKS = dict.fromkeys((1, 2, 3, 4, 5), " ")
# kinds of characters
_WORD, _DIGIT, _HAN, _LINK_MARK, _LINE, _STOP, _PART, _DOC = 1, 2, 3, 4, 5, 6, 7, 8


def _kinds() -> np.ndarray:
    k = np.zeros(0x110000, np.uint8)
    for a, b in ((0x3007, 0x3008), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        k[a:b] = _HAN
    k[[i for i in range(0x600) if chr(i).isalpha()]] = _WORD
    k[0x1E00:0x1F00] = k[0x300:0x370] = _WORD
    k[[ord(x) for x in "¥￥$€£"]] = _HAN
    k[[i for i in range(0x30, 0x3A)]] = k[0xFF10:0xFF1A] = _DIGIT
    k[[ord(x) for x in "。！？!?."]] = _STOP
    k[[ord(x) for x in ",，、;；|<>#·/\t：:（）()[]【】"]] = _PART
    k[1], k[2], k[10] = _DOC, _LINK_MARK, _LINE
    return k


_kind_of = None
_powers = np.ones(1, np.uint64)


def _hashes(chars: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number for each run of characters [at, last]."""
    global _powers
    n = last - at + 1
    if n.max(initial=0) > len(_powers):
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(int(n.max()) + 64, _BASE)], dtype=np.uint64)
    owner = np.repeat(np.arange(len(at)), n)
    first = np.r_[0, np.cumsum(n)[:-1]]
    inside = np.arange(len(owner)) - first[owner]
    code = (chars[at[owner] + inside].astype(np.uint64) + np.uint64(0x5BD1)) * _powers[inside]
    h = np.add.reduceat(code, first) if len(at) else np.zeros(0, np.uint64)
    return (h ^ (h >> np.uint64(31))) * _MIX


def _plain(text: str) -> tuple[str, list[int]]:
    text = text.lower().translate(_MARKS)
    if "#" in text or ":" in text or "：" in text:
        text = _TAGS.sub(lambda m: m[0] + "\x05", text)
    links: list[int] = []
    if _LINKISH.search(text):

        def one(m: re.Match) -> str:
            links.append(len(m[0]) - len(m[1] or ""))
            # the label stands between marks; a point behind an address ends its sentence
            return f" \x03{m[1]}\x04 \x02 " if m[1] else f" \x02 {'.' if m[0][-1] in '.!?' else ''}"

        text = _LINK.sub(one, text)
    return text, links


def _hash_words(words: list[str]) -> np.ndarray:
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    n = np.array([len(w) for w in words])
    at = np.r_[0, np.cumsum(n)[:-1]]
    return _hashes(chars, at, at + n - 1)


_OUT = pa.schema([("doc_id", pa.int64()), ("stuffed", pa.float64()), ("regular", pa.float64()), ("autocorrelation", pa.float64()), ("gap_spread", pa.float64()), ("function_share", pa.float64()), ("n_terms", pa.int32())])


def _recur(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place: the gap to the next place with the same key, to the nearest of both sides, and how many there are."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << int(len(key)).bit_length()) - 1)
    ranked = np.sort((key & ~low) | np.arange(len(key), dtype=np.uint64))  # by key, then place
    order, top = (ranked & low).astype(np.int64), ranked & ~low
    same = np.r_[False, top[1:] == top[:-1]]
    back = np.where(same, np.r_[0, np.diff(order)], _FAR)
    ahead = np.r_[back[1:], [_FAR]]
    run = np.cumsum(~same) - 1
    times = np.bincount(run)[run]
    nxt, near, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    nxt[order], near[order], count[order] = ahead, np.minimum(back, ahead), times
    return nxt, near, count


def by_unit_at(marks: np.ndarray, at: np.ndarray, unit: np.ndarray, m: int) -> np.ndarray:
    """How many marks stand before the terms of each unit, behind the term before."""
    upto = np.cumsum(marks)[at]
    return np.bincount(unit, weights=np.diff(np.r_[0, upto]), minlength=m)


def _measure(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    global _kind_of
    if _kind_of is None:
        _kind_of = _kinds()
    plain, link_sizes = [], []
    for t in texts:
        p, links = _plain(t)
        plain.append(p)
        link_sizes += links
    n_docs = len(texts)
    chars = np.frombuffer("\x01".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kind_of[chars]
    before = np.r_[np.uint8(0), kind[:-1]]
    # a point inside a number or a word ends nothing
    after = np.r_[kind[1:], np.uint8(0)]
    kind = np.where((chars == 46) & (after != 0) & (after != _LINE) & (after != _DOC) & (after != _LINK_MARK), 0, kind)
    starts = (kind >= _HAN) | ((kind > 0) & (kind != before))
    at = np.flatnonzero(starts & (kind > 0))
    k = kind[at]
    run_end = np.flatnonzero((kind > 0) & (np.r_[kind[1:], np.uint8(0)] != kind) | (kind >= _HAN))
    last = run_end
    size = last - at + 1
    doc = np.cumsum(k == _DOC)
    ends = (k == _LINE) | (k == _DOC)
    real = np.flatnonzero((k >= _WORD) & (k <= _LINK_MARK))
    out_empty = pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _OUT], schema=_OUT)
    if not len(real):
        return out_empty
    rk, td, ts = k[real], doc[real], size[real].astype(float)
    ts[rk == _LINK_MARK] = link_sizes[: int((rk == _LINK_MARK).sum())]
    h = _hashes(chars, at[real], last[real])
    h[rk == _DIGIT], h[rk == _LINK_MARK] = 5, 7
    word = (rk == _WORD) | (rk == _HAN)
    label = (np.cumsum(chars == 3) > np.cumsum(chars == 4))[at[real]]
    fn = np.isin(h, _hash_words(FUNCTION + list(FUNCTION_ZH))) & word
    fn &= ~np.r_[(rk[1:] == _DIGIT) & (at[real][1:] == last[real][:-1] + 1), [False]]  # as in A4
    mark = np.isin(h, _hash_words(PRICE)) & word
    number = rk == _DIGIT
    salt = (td.astype(np.uint64) + np.uint64(1)) * _BASE
    place = np.arange(len(real))
    new_doc = np.r_[True, td[1:] != td[:-1]]
    # units
    line = np.cumsum(ends)[real]
    stop = np.cumsum(ends | (k == _STOP))[real]
    line_fresh = np.r_[True, line[1:] != line[:-1]]
    line_no = np.cumsum(line_fresh) - 1
    long_line = np.bincount(line_no)[line_no] > UNIT_TERMS
    fresh = line_fresh | (long_line & np.r_[True, stop[1:] != stop[:-1]])
    first = np.maximum.accumulate(np.where(fresh, place, 0))
    fresh |= (place - first) % UNIT_TERMS == 0
    unit = np.cumsum(fresh) - 1
    m = unit[-1] + 1
    # pairs of neighbours
    pair = (h * _MIX + np.r_[h[1:], np.zeros(1, np.uint64)]) ^ salt
    pair[np.r_[new_doc[1:], [True]]] = place[np.r_[new_doc[1:], [True]]].astype(np.uint64)
    nxt, near, count = _recur(pair)
    soft = ~word
    close = (near <= LAG) & (count >= 3) & ~(soft & np.r_[soft[1:], [True]])
    regular = close | np.r_[False, close[:-1] & ~new_doc[1:]]
    new = (count == 1) & ~np.r_[fresh[1:], [True]]
    # items between separators, single terms
    parted = np.cumsum(ends | (k == _STOP) | (k == _PART))[real]
    item_fresh = np.r_[True, parted[1:] != parted[:-1]]
    item = np.cumsum(item_fresh) - 1
    item_at = np.flatnonzero(item_fresh)
    item_hash = np.add.reduceat(h * _powers_for(place - item_at[item]), item_at) ^ salt[item_at]
    _, _, item_times = _recur(item_hash)
    blank = np.r_[True, at[real][1:] - last[real][:-1] > 1] | item_fresh
    token = np.cumsum(blank) - 1
    token_at = np.flatnonzero(blank)
    _, _, token_times = _recur(np.add.reduceat(h * _powers_for(place - token_at[token]), token_at) ^ salt[token_at])
    _, word_near, word_times = _recur(h ^ salt)
    recurring = (word_near <= 4 * LAG) & (word_times >= 2) & word
    by_doc = lambda x, to: np.bincount(to, weights=x, minlength=n_docs)
    by_unit = lambda w: np.bincount(unit, weights=w, minlength=m)
    w = word.astype(float)
    words, total, links = by_unit(w), by_unit(np.ones(len(real))), by_unit((rk == _LINK_MARK).astype(float))
    cover, fns = by_unit(regular * w), by_unit(fn.astype(float))
    news = by_unit(new.astype(float)) / np.maximum(total - 1, 1)
    item_share = by_unit((item_times[item] >= 2) * w) / np.maximum(words, 1)
    token_share = by_unit((token_times[token] >= 2) * w) / np.maximum(words, 1)
    n_tokens = by_unit(blank.astype(float))
    single = by_unit(recurring.astype(float)) / np.maximum(words, 1)
    n_items = by_unit(item_fresh.astype(float))
    digits = by_unit((rk == _DIGIT).astype(float))
    share, fshare = cover / np.maximum(words, 1), fns / np.maximum(words, 1)
    sizes = by_unit(ts)
    unit_doc = td[np.flatnonzero(fresh)]
    # places in step: the most of a unit's places whose next occurrence lies at one lag
    near_by = np.flatnonzero((nxt <= BEATS) & word)
    near_by = near_by[nxt[near_by + nxt[near_by]] == nxt[near_by]]  # and the one after that as far again
    lags, times = np.unique(unit[near_by] * (BEATS + 1) + nxt[near_by], return_counts=True)
    step = np.zeros(m)
    np.maximum.at(step, lags // (BEATS + 1), times)
    step /= np.maximum(total, 1)
    tagged = by_unit_at(chars == 5, at[real], unit, m)
    price = np.r_[False, number[:-1]] & mark | np.r_[number[1:], [False]] & mark
    prices = by_unit((price & np.r_[False, ~fresh[1:]]).astype(float))
    han = by_unit((rk == _HAN).astype(float)) > 0.5 * words  # Chinese prose has fewer function words
    no_prose = fshare < np.where(han, PROSE_ZH, PROSE)
    beside = by_unit((word & ~label).astype(float))
    stop_at = np.searchsorted(real, np.flatnonzero(k == _STOP)) - 1
    stops = np.bincount(unit[stop_at[stop_at >= 0]], minlength=m)
    bare = by_unit((number & ~label).astype(float)) == 0
    link_only = (links > 0) & ((beside <= 3) | ((words <= 6) & (share >= LOOSE) & (news <= NEW)) | bare & (stops == 0) & (n_items <= 2 * links) & (no_prose | (by_unit(ts * (rk == _LINK_MARK)) >= 0.5 * sizes)))
    dense = (words > 0) & (share >= np.where(no_prose, LOOSE, STRICT)) & (news <= NEW)
    offers = (prices > 0) & no_prose & (share >= OFFER)
    nouns = (fshare < 0.04) & (words >= 6) & (digits <= 0.12 * total) & (bare | (links == 0))  # an entry with its number or year and a link is no list of nouns
    item_list = nouns & (n_items >= 4) & ((item_share >= ITEMS) | (share >= 0.55) & (single >= 0.8) | (n_items >= 6) & (item_share >= SOME))
    term_list = nouns & (n_items <= 3) & (words >= 10) & ((single >= SINGLE) & (share >= 0.3) | (n_tokens >= 8) & (token_share >= 0.5))
    offers &= by_doc(offers.astype(float), unit_doc)[unit_doc] >= 3
    # an article has no more links than sentences; elsewhere a link weighs its whole length
    few = by_doc(link_only.astype(float), unit_doc) <= by_doc(((links == 0) & (words > 3)).astype(float), unit_doc)
    sizes = by_unit(np.where((rk == _LINK_MARK) & few[td], np.minimum(ts, LINK_CHARS), ts))
    in_step = no_prose & (step >= IN_STEP) & (words >= 4) & (news <= NEW)
    tag_list = (fshare < 0.04) & (words >= 6) & ((tagged >= 3) | (tagged > 0) & (n_items >= TAGS))
    bad = link_only | dense | offers | item_list | term_list | in_step | tag_list
    stuffed = by_doc(sizes * bad, unit_doc) / np.maximum(by_doc(sizes, unit_doc), 1)
    n = np.bincount(td, minlength=n_docs)
    near_by = np.flatnonzero(nxt <= BEATS)
    gd, gg = td[near_by], nxt[near_by].astype(float)
    seen, times = np.unique(gd * 1024 + nxt[near_by], return_counts=True)
    top = np.zeros(n_docs)
    np.maximum.at(top, seen // 1024, times)
    g = np.maximum(by_doc(np.ones(len(gd)), gd), 1)
    mean = by_doc(gg, gd) / g
    spread = np.sqrt(np.maximum(by_doc(gg * gg, gd) / g - mean * mean, 0)) / np.maximum(mean, 1)
    keep = np.flatnonzero(n > 0)
    each = np.maximum(by_doc(w, td), 1)
    cols = [np.array(ids, np.int64), stuffed, by_doc(regular * w, td) / each, top / np.maximum(n, 1), spread, by_doc(fn.astype(float), td) / each, n.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], schema=_OUT)


def _powers_for(inside: np.ndarray) -> np.ndarray:
    global _powers
    if inside.max(initial=0) >= len(_powers):
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(int(inside.max()) + 64, _BASE)], dtype=np.uint64)
    return _powers[inside]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids: list[int] = []
        texts: list[str] = []
        size = 0
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= BATCH_CHARS:
                yield _measure(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield _measure(ids, texts)


def measures(docs: DataFrame) -> DataFrame:
    """Per document(doc_id, text): the stuffed share and what it rests on."""
    rows = docs.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    return rows.mapInArrow(_run, "doc_id bigint, stuffed double, regular double, autocorrelation double, gap_spread double, function_share double, n_terms int")


def found(docs: DataFrame) -> DataFrame:
    return measures(docs).where("stuffed > 0.5").select("doc_id").distinct()
