"""Evaluation passages inside documents, by a distributed positional inverted index.

The corpus is indexed once: segments of bounded size (``SEGMENT_CHARS``) that lie where the
documents lie turn their texts into words and write the postings of all of them, for each term
its positions, as gaps, in rows by (bucket of terms, segment) of ``ROW_POSTINGS`` postings at
most, with a row a segment that tells which document is where. Batches between Spark and Python
are counted in rows, so rows of bounded size bound what a task holds, however many segments it
reads. The index is a table in the shared folder and serves any number of
test sets; the texts are not read again. A search reads the buckets that hold its terms, keeps
the postings of these terms alone and brings those of a segment together; every window of
``n`` consecutive words of an item is looked up from its rarest term in that segment: the
term's positions, less its offset, are the candidates, and the lists of the other terms, each
moved by its own offset, are intersected with them until the run they have in common is
known. No group of documents meets in one task beyond a segment.

Words are told by 64 bit hashes; a false hit needs a window of them to collide in order.
Items are searched in blocks of at most ``ITEM_CHARS`` characters by a check of their length,
so any number of items makes several reads of their own terms' postings instead of one large
broadcast.

Defined results: null and empty texts, on either side, match nothing; an item shorter than
its window matches nothing; repeated rows of a document give one row; a text longer than a
segment is a segment of its own, never cut; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.tables import shared_path

SEGMENT_CHARS = 3_000_000
ITEM_CHARS = 4_000_000
#: Characters whose words are made at a time; a longer text is still taken whole.
PIECE_CHARS = 250_000
#: Most postings in a row of the index, and in a row that a search sends on.
ROW_POSTINGS = 512
#: Parts that terms are put into by their hash; a search reads only the parts of its terms.
BUCKETS = 64
#: Bytes of a row group of the index, which a task that writes or reads it holds at once.
ROW_GROUP_BYTES = 16 << 20
#: Pairs of a place in a segment and one in the items that are looked at together.
PAIRS = 1_000_000
#: Consecutive words that make a leak, by the item's language; others count as Latin.
WINDOW = {"zh": 20, "en": 12}

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BREAK = "\x01"
_classes: np.ndarray | None = None
_powers = np.ones(1, np.uint64)


def _char_classes() -> np.ndarray:
    """0 parts words, 1 is a Latin letter or digit, 2 a character that is a word itself, 3 parts documents."""
    global _classes
    if _classes is None:
        c = np.zeros(0x110000, np.uint8)
        for a, b in ((0x3007, 0x3008), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
            c[a:b] = 2
        c[[i for i in range(0x250) if chr(i).isalnum()]] = 1
        c[0x1E00:0x1F00] = 1
        c[0x300:0x370] = 1  # a separate accent belongs to its letter
        c[1] = 3
        _classes = c
    return _classes


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).lower().replace("­", "").replace("​", "").replace("‌", "").replace("‍", "").replace("⁠", "").replace("﻿", "")


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts in order, and the number of the text each word is in; 0 stands between texts."""
    global _powers
    chars = np.frombuffer(_BREAK.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _char_classes()[chars]
    before = np.empty_like(kind)
    before[:1], before[1:] = 0, kind[:-1]
    first = (kind >= 2) | ((kind == 1) & (before != 1))
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.flatnonzero(kind > 0)
    word = np.cumsum(first)[keep] - 1
    inside = keep - at[word]
    if inside.max() >= len(_powers):
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(int(inside.max()) + 64, _BASE)], dtype=np.uint64)
    code = (chars[keep].astype(np.uint64) + np.uint64(0x5BD1)) * _powers[inside]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    h = np.add.reduceat(code, starts)
    h ^= h >> np.uint64(29)
    breaks = kind[at] == 3
    h[breaks] = 0
    return h, np.cumsum(breaks)


def words_by_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What ``words`` says, made of some texts at a time."""
    hashes, owners = [], []
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_CHARS or i == len(texts) - 1:
            h, doc = words(texts[begin : i + 1])
            gap = 1 if begin else 0  # the 0 between two texts
            hashes.append(np.r_[np.zeros(gap, np.uint64), h])
            owners.append(np.r_[np.full(gap, begin, np.int64), doc + begin])
            begin, size = i + 1, 0
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Items:
    """The test items of a block: their words as numbers of one vocabulary, and their windows."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.rows = [(i, lang or "", t) for i, lang, t in rows if t]

    def compile(self) -> Items:
        hashes, owner = words([_plain(t) for _, _, t in self.rows])
        self.vocab = np.unique(hashes[hashes != 0])
        self.terms = np.searchsorted(self.vocab, hashes).astype(np.int32)
        self.terms[hashes == 0] = -2
        self.ids = np.array([r[0] for r in self.rows], np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
        n = np.array([WINDOW["zh" if r[1].lower().startswith("zh") else "en"] for r in self.rows], np.int32)
        self.need = n[owner] if len(owner) else np.zeros(0, np.int32)
        self.owner = owner
        return self

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each hash in the vocabulary, and the places of those that have one."""
        if not len(self.vocab) or not len(hashes):
            return np.full(len(hashes), -1, np.int32), np.zeros(0, np.int64)
        k = np.searchsorted(self.vocab, hashes)
        k[k == len(self.vocab)] = 0
        term = np.where(self.vocab[k] == hashes, k, -1).astype(np.int32)
        return term, np.flatnonzero(term >= 0)


class Segment:
    """The positional index of some documents, for the terms of the vocabulary of the items.

    ``term``, ``at``: the postings, sorted by term, then position; ``starts``: the first position
    of each document; ``n``: how many words there are.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, n: int, term: np.ndarray, at: np.ndarray, n_terms: int):
        self.ids, self.postings = ids, at
        self.term_at = np.full(n, -1, np.int32)
        self.term_at[at] = term
        self.doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        self.df = np.bincount(term, minlength=n_terms)
        self.begin = np.r_[0, np.cumsum(self.df)]

    @classmethod
    def of_texts(cls, ids: list[int], texts: list[str], items: Items) -> Segment:
        h, doc = words([_plain(t).replace(_BREAK, " ") for t in texts])
        starts = np.searchsorted(doc, np.arange(len(ids)))
        term, known = items.numbers(h)
        order = np.argsort(term[known], kind="stable")
        return cls(np.array(ids, np.int64), starts, len(h), term[known][order], known[order], len(items.vocab))

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.begin[term] : self.begin[term + 1]]


def anchors(items: Items, df: np.ndarray) -> np.ndarray:
    """Places in the items so that each window holds one: the rarest term of the window."""
    rare = np.where(items.terms >= 0, df[np.maximum(items.terms, 0)], 1 << 40)
    chosen = []
    for n in np.unique(items.need):
        if len(rare) < n:
            continue
        at = np.arange(len(rare) - n + 1)
        whole = (items.need[at] == n) & (items.owner[at] == items.owner[at + n - 1]) & (items.terms[at] >= 0)
        at = at[whole]
        view = np.lib.stride_tricks.sliding_window_view(rare, n)[at]
        best = view.argmin(axis=1)
        found = view[np.arange(len(at)), best] > 0  # a term that the segment lacks ends the window
        chosen.append((at + best)[found])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def exact(segment: Segment, items: Items) -> set[tuple[int, int]]:
    """(document, item) where a whole window of the item stands in the document."""
    places = anchors(items, segment.df)
    if not len(places):
        return set()
    end_p, end_q = len(segment.term_at), len(items.terms)
    out: set[tuple[int, int]] = set()
    pairs = np.cumsum(segment.df[items.terms[places]]) // PAIRS
    for some in np.split(places, np.flatnonzero(np.diff(pairs)) + 1):
        lists = [segment.positions(items.terms[x]) for x in some]
        p = np.concatenate(lists)
        q = np.repeat(some, [len(x) for x in lists])
        run = np.ones(len(p), np.int32)
        for step in (1, -1):
            live = np.arange(len(p))
            for k in range(1, int(items.need.max())):
                a, b = p[live] + step * k, q[live] + step * k
                ok = (a >= 0) & (a < end_p) & (b >= 0) & (b < end_q)
                ok[ok] = (segment.term_at[a[ok]] == items.terms[b[ok]]) & (items.terms[b[ok]] >= 0)
                live = live[ok]
                if not len(live):
                    break
                run[live] += 1
        hit = run >= items.need[q]
        out |= set(zip(segment.ids[segment.doc[p[hit]]].tolist(), items.ids[q[hit]].tolist()))
    return out


def near_anchors(items: Items, df: np.ndarray, missing: int) -> np.ndarray:
    """Places in the items so that each window with ``missing`` words changed still holds one: its ``missing`` + 1 rarest words, of those the ones that the segment holds."""
    rare = np.where(items.terms >= 0, df[np.maximum(items.terms, 0)], 1 << 40)
    chosen = []
    for n in np.unique(items.need):
        if len(rare) < n:
            continue
        at = np.arange(len(rare) - n + 1)
        at = at[(items.need[at] == n) & (items.owner[at] == items.owner[at + n - 1]) & (items.terms[at] >= 0)]
        view = np.lib.stride_tricks.sliding_window_view(rare, n)[at]
        best = view.argsort(axis=1, kind="stable")[:, : missing + 1]
        chosen.append((at[:, None] + best)[np.take_along_axis(view, best, axis=1) > 0])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def near(segment: Segment, items: Items, slop: int, missing: int) -> set[tuple[int, int]]:
    """(document, item) where all but ``missing`` words of a window stand near their place, moved by up to ``slop`` words, one of them exactly there."""
    places = near_anchors(items, segment.df, missing)
    if not len(places):
        return set()
    end_p, end_q = len(segment.term_at), len(items.terms)

    def stands(p: np.ndarray, q: np.ndarray, k: int, moves: range) -> np.ndarray:
        """Where the item's word k places from q stands in q's document, k places from p or moved from there."""
        b = q + k
        ok = (b >= 0) & (b < end_q)
        ok &= items.owner[np.where(ok, b, q)] == items.owner[q]
        term = np.where(ok, items.terms[np.where(ok, b, q)], -3)
        got = np.zeros(len(p), bool)
        for s in moves:
            a = p + k + s
            inside = (a >= 0) & (a < end_p)
            got |= inside & (segment.term_at[np.where(inside, a, 0)] == term)
        return got

    out: set[tuple[int, int]] = set()
    pairs = np.cumsum(segment.df[items.terms[places]]) // PAIRS
    for some in np.split(places, np.flatnonzero(np.diff(pairs)) + 1):
        lists = [segment.positions(items.terms[x]) for x in some]
        all_p, all_q = np.concatenate(lists), np.repeat(some, [len(x) for x in lists])
        for n in np.unique(items.need[some]):
            live = items.need[all_q] == n
            p, q = all_p[live], all_q[live]
            # a window reaches half of its length from its anchor on one side at least
            lost = np.zeros((2, len(p)), np.int32)
            for k in range(1, n // 2 + 1):
                for side, step in enumerate((k, -k)):
                    lost[side] += ~stands(p, q, step, range(-2 * slop, 2 * slop + 1))
                on = lost.min(axis=0) <= missing
                p, q, lost = p[on], q[on], lost[:, on]
            if not len(p):
                continue
            # the anchor itself may be moved: every place of the window that it allows is tried
            doc = segment.doc[p]
            for move in range(-slop, slop + 1):
                got, there = np.zeros((len(p), 2 * n - 1), bool), np.zeros((len(p), 2 * n - 1), bool)
                for k in range(-n + 1, n):
                    for s in range(-slop, slop + 1):
                        a = p + move + k + s
                        own = (a >= 0) & (a < end_p)
                        own &= segment.doc[np.where(own, a, 0)] == doc
                        hit = own & stands(p + move, q, k, range(s, s + 1))
                        got[:, k + n - 1] |= hit
                        if s == 0:
                            there[:, k + n - 1] = hit
                near_by, exactly = (np.cumsum(np.c_[np.zeros(len(p), int), x], axis=1) for x in (got, there))
                hit = ((near_by[:, n:] - near_by[:, :-n] >= n - missing) & (exactly[:, n:] > exactly[:, :-n])).any(axis=1)
                out |= set(zip(segment.ids[doc[hit]].tolist(), items.ids[q[hit]].tolist()))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
#: Rows of the stored index: postings of a bucket of terms in a segment, each term's first position in the row and the gaps behind it, or, with bucket -1, its documents and their first positions.
_INDEX = pa.schema([("bucket", pa.int32()), ("segment", pa.int64()), ("n_words", pa.int32()), ("terms", _LONGS), ("counts", _INTS), ("gaps", _INTS)])
_INDEX_SQL = "bucket int, segment bigint, n_words int, terms array<bigint>, counts array<int>, gaps array<int>"


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """The values as lists that begin at the starts."""
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), pa.array(values))


def _parted(group: np.ndarray) -> np.ndarray:
    """Where rows begin, for values with the number of their group in order: with each group, and after ``ROW_POSTINGS`` values in one."""
    if not len(group):
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    inside = np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
    return np.flatnonzero(inside % ROW_POSTINGS == 0)


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1 ... of every span of n places, one span after the other."""
    return np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())


def _rows(segment: int, ids: list[int], texts: list[str]) -> Iterator[pa.RecordBatch]:
    h, doc = words_by_pieces(texts)
    starts = np.searchsorted(doc, np.arange(len(ids))).astype(np.int32)
    one = np.zeros(1, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([segment], pa.int64()), pa.array([len(h)], pa.int32()), _lists(one, np.array(ids, np.int64)), _lists(one, np.zeros(0, np.int32)), _lists(one, starts)], schema=_INDEX)
    place = np.flatnonzero(h)
    if not len(place):
        return
    part = (h[place] % np.uint64(BUCKETS)).astype(np.int32)
    order = np.lexsort((h[place], part))  # stable: positions stay in order
    at, term, part = place[order], h[place][order], part[order]
    row = _parted(part)
    new = np.r_[True, term[1:] != term[:-1]]
    new[row] = True
    first = np.flatnonzero(new)
    gaps = np.diff(at, prepend=0)
    gaps[first] = at[first]
    in_row = np.searchsorted(first, row)
    counts = np.diff(np.r_[first, len(at)])
    yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(np.full(len(row), segment, np.int64)), pa.array(np.full(len(row), len(h), np.int32)), _lists(in_row, term[first].view(np.int64)), _lists(in_row, counts.astype(np.int32)), _lists(row, gaps.astype(np.int32))], schema=_INDEX)


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    segment = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t:
                ids.append(i)
                texts.append(_plain(t).replace(_BREAK, " "))
                size += len(t)
                if size >= SEGMENT_CHARS:
                    yield from _rows(segment, ids, texts)
                    ids, texts, size, segment = [], [], 0, segment + 1
    if ids:
        yield from _rows(segment, ids, texts)


def write_index(docs: DataFrame, path: str) -> None:
    """The positional index of documents(doc_id, text), as a table at a path that all executors share."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null")
    rows.mapInArrow(_indexer, _INDEX_SQL).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX_SQL).parquet(path)


_KEPT = pa.schema([("segment", pa.int64()), ("n_words", pa.int32()), ("ids", _LONGS), ("starts", _INTS), ("term", _INTS), ("at", _INTS)])
_KEPT_SQL = "segment bigint, n_words int, ids array<bigint>, starts array<int>, term array<int>, at array<int>"
_compiled: dict[int, Items] = {}


def _of(items: Items) -> Items:
    """The items of a block, compiled once in a worker."""
    tag = hash(tuple(items.rows))
    if tag not in _compiled:
        _compiled.clear()
        _compiled[tag] = items.compile()
    return _compiled[tag]


def _keeper(items: Items):
    """Index rows to the postings of the items' terms alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(items)
        for b in batches:
            whole = b.column(0).to_numpy() < 0
            if whole.any():
                d = b.filter(pa.array(whole))
                none = _lists(np.zeros(len(d), np.int64), np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([d.column(1), d.column(2), d.column(3), d.column(5), none, none], schema=_KEPT)
                b = b.filter(pa.array(~whole))
            terms, counts, gaps = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4, 5))
            number, known = own.numbers(terms.view(np.uint64))
            if not len(known):
                continue
            n = counts[known].astype(np.int64)
            begin = np.r_[0, np.cumsum(counts, dtype=np.int64)[:-1]]
            at = np.cumsum(gaps[_spans(begin[known], n)], dtype=np.int64)
            at -= np.repeat(np.r_[0, at[np.cumsum(n)[:-1] - 1]], n)
            row = np.repeat(np.repeat(np.arange(len(b)), b.column(3).value_lengths().to_numpy())[known], n)
            segment = b.column(1).to_numpy()[row]
            rows = _parted(segment)
            none = np.zeros(len(rows), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(segment[rows]), b.column(2).take(pa.array(row[rows])), _lists(none, np.zeros(0, np.int64)), _lists(none, np.zeros(0, np.int32)), _lists(rows, np.repeat(number[known], n)), _lists(rows, at.astype(np.int32))], schema=_KEPT)

    return run


def _searcher(items: Items, search):
    """Sorted rows of whole segments to the leaks in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _of(items)
        now, n = None, 0
        pools: list[list[np.ndarray]] = [[] for _ in range(4)]

        def flush() -> pa.RecordBatch:
            ids, starts, term, at = (np.concatenate(x) for x in pools)
            found: list[tuple[int, int]] = []
            if len(term) and len(ids):
                order = np.lexsort((at, term))
                found = sorted(search(Segment(ids, starts, n, term[order], at[order], len(own.vocab)), own))
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=_OUT)

        for b in batches:
            segments = b.column(0).to_numpy()
            begin = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]]) if len(b) else np.zeros(0, np.int64)
            for i, end in zip(begin.tolist(), [*begin[1:].tolist(), len(b)]):
                if segments[i] != now:
                    if now is not None:
                        yield flush()
                    now, n, pools = segments[i], b.column(1)[i].as_py(), [[] for _ in range(4)]
                for pool, c in zip(pools, (2, 3, 4, 5)):
                    pool.append(b.column(c).slice(i, end - i).flatten().to_numpy(zero_copy_only=False))
        if now is not None:
            yield flush()

    return run


def search(index: DataFrame, items: DataFrame, how=exact) -> DataFrame:
    """Distinct (doc_id, item_id) of the documents of an index that hold a window of items(item_id, lang, text)."""
    own = items.where("item_id is not null and text is not null").select("item_id", "lang", "text")
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // ITEM_CHARS) * (1 if chars <= ITEM_CHARS else 2) or 1
    parts = []
    for b in range(blocks):
        block = Items([tuple(r) for r in own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()])
        buckets = sorted({int(x % BUCKETS) for x in words([_plain(t) for _, _, t in block.rows])[0] if x}) if block.rows else []
        kept = index.where(F.col("bucket").isin([-1, *buckets])).mapInArrow(_keeper(block), _KEPT_SQL)
        parts.append(kept.repartition("segment").sortWithinPartitions("segment").mapInArrow(_searcher(block, how), "doc_id bigint, item_id bigint"))
    return reduce(DataFrame.unionByName, parts).distinct()


def find(docs: DataFrame, items: DataFrame, how=exact) -> DataFrame:
    """Distinct (doc_id, item_id) of documents(doc_id, text) that hold a window of items(item_id, lang, text): indexed in the shared folder, then searched."""
    path = shared_path(docs.sparkSession, "postings")
    write_index(docs, path)
    return search(read_index(docs.sparkSession, path), items, how)


def proximity(docs: DataFrame, items: DataFrame, slop: int = 2, missing: int = 2) -> DataFrame:
    return find(docs, items, near_search(slop, missing))


def near_search(slop: int = 2, missing: int = 2):
    return lambda s, i: near(s, i, slop, missing)
