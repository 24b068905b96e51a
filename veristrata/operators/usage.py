"""Usage analytics: sums that null poisons, calendars without holes, conditional and distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def poisoned_sum(c: Column | str) -> Column:
    """The sum, or null if any of its values is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def calendar(spark: SparkSession, first: str, days: int) -> DataFrame:
    return spark.range(days).select(F.date_format(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))


def usage_log(events: DataFrame) -> DataFrame:
    """Events as a log of usage: day, ok, and a cost that is unknown for some."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id", "user_id", F.col("event_type").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.col("event_type") != "error").alias("ok"), F.when(k % 7 == 0, None).otherwise(F.round(F.col("value") * 100).cast("bigint")).alias("cost"), k.alias("k"),
    )


def daily(log: DataFrame, days: DataFrame) -> DataFrame:
    """Every day of the calendar: runs, failures and cost; a day without rows costs 0, one with an unknown cost is unknown."""
    per = log.groupBy("day").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"), poisoned_sum("cost").alias("cost"))
    zero = F.lit(0).cast("bigint")
    return days.join(per, "day", "left").select("day", F.coalesce("runs", zero).alias("runs"), F.coalesce("failed", zero).alias("failed"), F.when(F.col("runs").isNull(), zero).otherwise(F.col("cost")).alias("cost"))


def by_user(users: DataFrame, log: DataFrame, since: str) -> DataFrame:
    """Every user with the rows since a day; the day is part of the join, so users without rows stay."""
    l = log.where(F.col("day") >= since)  # noqa: E741 - before the join the filter reaches the scan
    per = l.groupBy("user_id").agg(F.count("*").alias("runs"), poisoned_sum("cost").alias("cost"), F.max("event_id").alias("last_event"))
    zero = F.lit(0).cast("bigint")
    return users.join(per, "user_id", "left").select("user_id", F.coalesce("runs", zero).alias("runs"), F.when(F.col("runs").isNull(), zero).otherwise(F.col("cost")).alias("cost"), "last_event")


def sessions(log: DataFrame, minutes: int) -> DataFrame:
    """Sessions of a user: rows without a longer pause between them."""
    w = W.partitionBy("user_id").orderBy("at", "event_id")
    new = F.when(F.lag("at").over(w).isNull() | (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.lag("at").over(w).cast("timestamp")) > minutes * 60_000_000), 1).otherwise(0)
    s = log.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
