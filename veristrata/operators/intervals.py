"""Continuous periods and gaps of overlapping time intervals.

Starts and ends are ranked independently per entity. A gap follows rank i where the
(i+1)-th start exceeds the i-th end by more than one day; each period runs from the start
after one gap to the end before the next. As ranks only matter where the number of starts so
far equals the number of ends so far, both sorts are kept as histograms over days: a group
by (entity, day), which combines on the map side, then a running rank of each. An entity that holds a
third of all rows therefore reaches the window with one row per calendar day at most.

Defined results: a null, malformed, non-existent or reversed bound leaves its row out; a
null entity is an entity of its own; repeated rows change nothing (a start and an end are
added alike); touching days join; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Blanks of any kind at the ends of a bound.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def _whole(c: Column) -> Column:
    """The trimmed text where it has the shape of an ISO day, month or year, else null."""
    t = F.btrim(c, F.lit(_BLANKS))
    return F.when(F.length(t).isin(4, 7, 10) & t.rlike(r"^[0-9]{4}(-[0-9]{2}){0,2}$") & (F.substring(t, 1, 4) != "0000"), t)


def first_day(c: Column) -> Column:
    """The day an ISO day, month or year starts on; null if it does not exist."""
    t = _whole(c)
    return F.try_to_date(F.concat(t, F.substring(F.lit("-01-01"), F.length(t) - 3, F.lit(6))), "yyyy-MM-dd")


def last_day(c: Column) -> Column:
    """The day an ISO day, month or year ends on; null if it does not exist."""
    t, d = _whole(c), first_day(c)
    return F.when(F.length(t) == 4, F.add_months(d, 12) - F.expr("interval 1 day")).when(F.length(t) == 7, F.last_day(d)).otherwise(d).cast("date")


def spans(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Rows (entity, span_kind ``period`` or ``gap``, first_day, last_day as dates) of the entity's intervals."""
    days = (
        df.select(F.col(entity).alias("_entity"), first_day(F.col(start)).alias("_s"), last_day(F.col(end)).alias("_e"))
        .where("_s <= _e")
        .select("_entity", F.explode(F.array(F.struct(F.col("_s").alias("day"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("_e").alias("day"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("x"))
        .groupBy("_entity", F.col("x.day").alias("day"))
        .agg(F.sum("x.s").alias("starts"), F.sum("x.e").alias("ends"))
    )
    w = W.partitionBy("_entity").orderBy("day")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    # the rank that starts, and that ends, have come to by each day; where they are one the next-ranked start is the next day there is
    rank = lambda c: F.sum(c).over(upto)
    ranked = days.select("_entity", "day", (rank("starts") - rank("ends")).alias("open"), F.lead("day").over(w).alias("next"), F.lag("day").over(w).alias("before"))
    ranked = ranked.withColumn("closed_before", F.lag("open").over(w))
    ends = (F.col("open") == 0) & (F.col("next").isNull() | (F.datediff("next", "day") > 1))
    starts = F.col("before").isNull() | ((F.col("closed_before") == 0) & (F.datediff("day", "before") > 1))
    bounds = ranked.select("_entity", "day", "next", ends.alias("is_end"), F.max(F.when(starts, F.col("day"))).over(upto).alias("began")).where("is_end")
    return bounds.select(
        F.col("_entity").alias(entity),
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("k"), F.col("began").alias("a"), F.col("day").alias("b")),
                    F.struct(F.lit("gap").alias("k"), F.date_add("day", 1).alias("a"), F.date_sub("next", 1).alias("b")),
                ),
                lambda x: x["b"].isNotNull(),
            )
        ).alias("x"),
    ).select(entity, F.col("x.k").alias("span_kind"), F.col("x.a").alias("first_day"), F.col("x.b").alias("last_day"))
