"""Top-k per group, interleaving across buckets, retention and admission by budget.

Row numbers come from windows on (group, order); a final id makes each order total, so ties
have one result. Groups of any size sort by spilling; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top(df: DataFrame, group: list[str], order: list[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps no more than k of a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def interleave(df: DataFrame, group: str, bucket: str, order: list[Column | str], tie: list[Column | str], budget: int) -> DataFrame:
    """Rows of a group read in turns: the first of each bucket, then the second, up to a budget."""
    # no bucket can give more than the budget, so Spark keeps few rows of each before the second window
    turn = df.withColumn("turn", F.row_number().over(W.partitionBy(group, bucket).orderBy(*order))).where(F.col("turn") <= budget)
    return turn.withColumn("read_no", F.row_number().over(W.partitionBy(group).orderBy("turn", *tie))).where(F.col("read_no") <= budget)


def relevance(blob: Column, name: Column, entities: Column, elements: Column) -> Column:
    """How much of a statement a text shows: parts of the name count 3, what the statement names 2, its elements 1, a word of announcements 1; values of one character tell nothing."""
    seen = lambda v: (F.length(v) >= 2) & F.contains(blob, v)
    count = lambda a: F.size(F.filter(a, lambda v: F.coalesce(seen(v), F.lit(False))))
    names = F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+")
    named = F.array(*[F.element_at(entities, F.lit(k)) for k in ("org", "award", "contest", "dept", "role", "title")])
    values = F.transform(F.coalesce(elements, F.array().cast("array<string>")), lambda e: F.when(F.instr(e, "=") > 0, F.substring(e, F.instr(e, "=") + 1, F.length(e))).otherwise(e))
    word = F.when(blob.rlike("公示|名单|获奖|通知|公告|录取|授予|表彰"), 1).otherwise(0)
    return (count(names) * 3 + F.when(entities.isNull(), 0).otherwise(count(named)) * 2 + count(values) + word).cast("bigint")


def keyed_first_place_last_value(df: DataFrame, keys: list[str], ordinal: str, values: list[str]) -> DataFrame:
    """Of rows with one key, the first position with the last values."""
    return df.groupBy(*keys).agg(F.min(ordinal).alias("first_place"), *[F.max_by(v, ordinal).alias(v) for v in values])


def admit(df: DataFrame, key: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """Sliding limiter: an event passes if fewer than ``limit`` passed in the ``seconds`` before it; only passed ones count.

    Each key is read in order from a sorted partition with ``limit`` times in memory, so a hot key
    is one stream through one task, never a collected group. Adds ``admitted``.
    """
    schema = f"{key} bigint, {tie} bigint, {at} timestamp, admitted boolean"
    out = pa.schema([(key, pa.int64()), (tie, pa.int64()), (at, pa.timestamp("us", tz="UTC")), ("admitted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, passed = None, deque()
        for b in batches:
            keys, times = b.column(0).to_pylist(), b.column(2).cast(pa.int64()).to_pylist()
            flags = []
            for k, t in zip(keys, times):
                if k != last:
                    last, passed = k, deque()
                while passed and t - passed[0] >= seconds * 1_000_000:
                    passed.popleft()
                flags.append(ok := len(passed) < limit)
                if ok:
                    passed.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(out.field(2).type), pa.array(flags)], schema=out)

    rows = df.select(F.col(key).cast("bigint"), F.col(tie).cast("bigint"), F.col(at).cast("timestamp")).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, at, tie).mapInArrow(run, schema)
