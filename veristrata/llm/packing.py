"""Texts into containers of fixed capacity by minimum bin slack.

Containers depend on lengths alone, so the plan is made on the histogram of lengths, which
has no more than ``capacity`` entries whatever the corpus holds. The longest length left
opens a container; a subset-sum table over bits, one shift per length and power of two,
tells which fillings are possible with the lengths left, the largest is taken and its counts
are traced back. The same filling is used as often as its lengths last, so each step uses up
a length and the number of fillings stays near the number of lengths.

Texts then take their places by their rank among the texts of the same length. Ranks are
made in two levels, inside (length, bucket) and by the counts of the buckets before, so that
a length with a third of all texts is no single group.

Defined results: a text longer than a container is cut into full containers and a rest;
null or empty texts have no tokens and go in turns behind the last text of each container; equal texts under several ids
are several items; rows that repeat an id are one item each; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.tables import cut

CAPACITY = 2048
BUCKETS = 1024
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_encoders: dict[str, object] = {}


def encoder(path: str):
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of documents(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for b in batches:
            n = [len(own.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], schema=_COUNTED)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def best_filling(room: int, left: dict[int, int]) -> dict[int, int]:
    """How many of each length left fill ``room`` closest, with the counts traced back through the bit table."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        copies, part = min(left[length], room // length), 1
        while copies > 0:
            k = min(part, copies)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            copies -= k
            part *= 2
        if reach >> room & 1:
            break
    total, counts = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            counts[length] = counts.get(length, 0) + k
            total -= length * k
    return counts


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, how many, per container, first container, first position), and the number of containers."""
    left = {x: n for x, n in histogram.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows, container = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = best_filling(capacity - longest, {x: n for x, n in left.items() if n})
        left[longest] += 1
        counts = dict(rest)
        counts[longest] = counts.get(longest, 0) + 1
        times, position = min(left[x] // k for x, k in counts.items()), 0
        for x in sorted(counts, reverse=True):
            k = counts[x]
            rows.append((x, used[x], times * k, k, container, position))
            used[x] += times * k
            left[x] -= times * k
            position += k
            if not left[x]:
                del left[x]
        container += times
    return rows, container


def pack(counted: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, position, doc_id, piece, token_start, n_tokens) for counted(doc_id, n_tokens)."""
    counted = cut(counted.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n_tokens")))
    number = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1))
    pieces = counted.select(
        "doc_id", F.explode(F.sequence(F.lit(0), number - 1)).alias("piece"), F.col("n_tokens").alias("_all")
    ).select("doc_id", "piece", (F.col("piece") * F.lit(capacity)).cast("bigint").alias("token_start"), F.least(F.lit(capacity), F.col("_all") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    sizes = pieces.groupBy("n_tokens", "_b").count()
    before = sizes.select("n_tokens", "_b", (F.sum("count").over(W.partitionBy("n_tokens").orderBy("_b")) - F.col("count")).alias("_before"))
    histogram = {r[0]: r[1] for r in sizes.groupBy("n_tokens").agg(F.sum("count")).collect()}  # at most ``capacity`` rows
    histogram.pop(0, None)
    rows, containers = plan(histogram, capacity)
    ranked = pieces.withColumn("_rank", F.row_number().over(W.partitionBy("n_tokens", "_b").orderBy("doc_id", "piece")) - 1).join(before, ["n_tokens", "_b"])
    ranked = ranked.select("doc_id", "piece", "token_start", "n_tokens", (F.col("_rank") + F.col("_before")).alias("rank"))
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    filled: dict[int, int] = {0: 0}  # first container of each filling, and its texts
    for _, _, _, per, first, position in rows:
        filled[first] = max(filled.get(first, 0), position + per)
    starts, texts = (np.array(x, np.int64) for x in zip(*sorted(filled.items())))
    out = pa.schema([("container", pa.int64()), ("position", pa.int32()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int32())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            turn, c = np.divmod(rank, max(containers, 1))
            position = texts[np.searchsorted(starts, c, side="right") - 1] + turn
            some = np.flatnonzero(length > 0)
            r = table[np.searchsorted(key, length[some] << 44 | rank[some], side="right") - 1]
            inside, per = rank[some] - r[:, 1], r[:, 3]
            c[some], position[some] = r[:, 4] + inside // per, r[:, 5] + inside % per
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(position.astype(np.int32)), *(b.column(i).cast(f.type) for i, f in zip(range(4), list(out)[2:]))], schema=out)

    return ranked.mapInArrow(place, "container bigint, position int, doc_id bigint, piece int, token_start bigint, n_tokens int")
