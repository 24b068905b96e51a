"""Rows of tables and of recognised text put in order: merged cells carried on, observations to lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.8


def carried(rows: DataFrame, table: list[str], order: list[str], value: str) -> DataFrame:
    """Rows of tables whose merged cells (null or empty) take the value of the row above in their table; ``carried`` tells which; rows before any value are left out."""
    own = F.nullif(F.trim(value), F.lit(""))
    w = W.partitionBy(*table).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_own", own).withColumn("carried", F.col("_own").isNull()).withColumn(value, F.last("_own", ignorenulls=True).over(w))
    return out.drop("_own").where(F.col(value).isNotNull())


_LINES = pa.schema([("page", pa.int64()), ("line_no", pa.int32()), ("line", pa.string())])


def observed_lines(rows: DataFrame) -> DataFrame:
    """(page, line_no, line) of observations(page, top, left, height, confidence, text).

    Observations are read from the top; one joins the line before if it begins within half of its
    height of that line's first one. Repeats at one place and uncertain ones are left out. A page
    is read in order from a sorted partition, one line in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, n, top, line, seen = None, 0, 0.0, [], set()

        def close(out: list) -> None:
            nonlocal n
            if line:
                out.append((page, n, " | ".join(t for _, t in sorted(line, key=lambda x: x[0]))))
                n += 1
                line.clear()

        for b in batches:
            out: list[tuple] = []
            for p, t, left, height, text in zip(*(c.to_pylist() for c in b.columns)):
                if p != page:
                    close(out)
                    page, n, seen = p, 0, set()
                key = text, round(t, 3), round(left, 2)
                if key in seen:
                    continue
                seen.add(key)
                if line and abs(t - top) > max(0.002, height * 0.5):
                    close(out)
                if not line:
                    top = t
                line.append((left, text))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_LINES)], schema=_LINES)
        out = []
        close(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(_LINES)], schema=_LINES)

    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    own = rows.where(F.col("confidence") >= LEAST_CONFIDENCE).select(F.col("page").cast("bigint"), zero("top"), zero("left"), zero("height"), F.trim("text").alias("text")).where("text <> '' and page is not null")
    return own.repartition("page").sortWithinPartitions("page", "top", "left", "text").mapInArrow(run, "page bigint, line_no int, line string")
