"""Sinks: reports as documents, append with retention, and upsert by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_documents(df: DataFrame, column: str, path: str) -> None:
    """One text a row."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_by_day(df: DataFrame, day: str, path: str) -> None:
    """Parquet by day; a day that is written again replaces that day alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def retained(old: DataFrame, new: DataFrame, key: str, order: Column, keep: int) -> DataFrame:
    """Old and new rows, the newest of each key alone."""
    both = old.unionByName(new)
    return both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_n") <= keep).drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)
