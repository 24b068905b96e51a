"""Scans of pages hold a piece of a batch as objects, not all of it; pieces and parts change no result."""

import tracemalloc

import pyarrow as pa
import pytest
from test_llm import SITE, got, rows, site, want

from veristrata.llm import boilerplate, residue
from veristrata.llm import lines as L

PAGE = [f"Line {i % 7} of the page, read aloud in the hall today." for i in range(40)] + ["Please enable JavaScript."]


def batch(n, nested):
    """n pages as the scan gets them."""
    text = pa.array([PAGE] * n, pa.list_(pa.string())) if nested else pa.array(["\n".join(PAGE)] * n)
    return pa.RecordBatch.from_arrays([pa.array(["t"] * n), pa.array(range(n), pa.int64()), pa.array(["h"] * n), pa.array(["T"] * n), text], names=["tab", "row_id", "host", "title", "text"])


def most(scan, b):
    for _ in scan(iter([b])):
        pass  # what is kept for lines met before is there
    tracemalloc.start()
    for _ in scan(iter([b])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


@pytest.mark.parametrize("scan, nested", [(boilerplate._nodes, True), (residue._scan, False), (residue._keys, False)])
def test_memory_does_not_grow_with_the_batch(scan, nested):
    if scan is residue._keys:
        reorder = lambda b: b.select(["tab", "row_id", "host", "text"])
    else:
        reorder = lambda b: b
    assert most(scan, reorder(batch(4_000, nested))) < 2 * most(scan, reorder(batch(500, nested)))


def test_pieces_are_of_bounded_size_and_whole(monkeypatch):
    b = pa.RecordBatch.from_arrays([pa.array(range(1_200)), pa.array(["x" * 20_000] * 1_200)], names=["i", "text"])
    cut = list(L.pieces(iter([b, b.slice(0, 0)])))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([b])) and max(p.num_rows for p in cut) <= L.PIECE_BYTES // 20_000
    assert max(p.num_rows for p in L.pieces(iter([b.select(["i"])]))) == L.PIECE_ROWS


def test_pieces_and_parts_change_no_result(spark, monkeypatch):
    data = [*site(60), ("t", 90, "h", None, []), ("t", 91, "h", None, [None, ""]), ("t", 92, None, None, [None, "Quiet corner"])]
    df = rows(spark, data, SITE)
    whole = got(boilerplate.remove(df))
    assert [r for r in whole if r[1] < 60] == want(60)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*site(8))], names=["tab", "row_id", "host", "title", "lines"])]
    monkeypatch.setattr(boilerplate, "ROW_LINES", 3)
    monkeypatch.setattr(L, "PIECE_ROWS", 2)
    parts = [r for b in boilerplate._nodes(iter(batches)) for r in b.to_pylist()]
    assert all(len(r["lines"]) <= 3 for r in parts) and sorted(r["row_id"] for r in parts if not r["part"]) == list(range(8))
    assert {(r["row_id"], x["line_no"]) for r in parts for x in r["lines"]} == {(i, j) for _, i, _, _, p in site(8) for j in range(len(p))}
