"""The core queries by name, each a function of (spark, folder), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.operators import intervals, timestamps
from veristrata.tables import broadcast_if_small, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    s = intervals.spans(table(spark, folder, "claims"), "report_id", "date_start", "date_end")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return s.where("report_id is not null").select("report_id", "span_kind", day("first_day"), day("last_day"))


def p1_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per report: periods, gaps, covered days and the longest gap."""
    s = intervals.spans(table(spark, folder, "claims"), "report_id", "date_start", "date_end").where("report_id is not null")
    days = F.datediff("last_day", "first_day") + 1
    gap = F.when(F.col("span_kind") == "gap", days)
    return s.groupBy("report_id").agg(
        F.count_if(F.col("span_kind") == "period").alias("periods"), F.count_if(F.col("span_kind") == "gap").alias("gaps"),
        F.sum(F.when(F.col("span_kind") == "period", days)).cast("bigint").alias("covered_days"), F.coalesce(F.max(gap), F.lit(0)).cast("bigint").alias("longest_gap"),
    )


def p4_values(spark: SparkSession, folder: str) -> DataFrame:
    """The values of problem 4, one row each, with the record order and clock of their source."""
    ev, sites = table(spark, folder, "evidence"), table(spark, folder, "sites").select("site", "tz")
    cell = lambda f: F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))
    e = ev.join(broadcast_if_small(sites), "site", "left").select(F.lit("evidence").alias("tab"), F.col("evidence_id").alias("row_id"), F.col("site").alias("source"), "tz", F.explode(F.array(cell("published_at"), cell("accessed_at"))).alias("x"))
    c = table(spark, folder, "claims").select(F.lit("claims").alias("tab"), F.col("claim_key").alias("row_id"), F.col("report_id").cast("string").alias("source"), F.lit(None).cast("string").alias("tz"), cell("date_label").alias("x"))
    return e.unionByName(c).select("tab", "row_id", "source", "tz", "x.field", "x.value")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.normalise(p4_values(spark, folder)).where("n_readings = 1 or not notation rlike '^(label )?(dmy|mdy)'").select("tab", "row_id", "field", "normal")


def p4_chosen(spark: SparkSession, folder: str) -> DataFrame:
    """Also the values that can mean two days, read as their source's neighbours suggest."""
    return timestamps.normalise(p4_values(spark, folder)).where("n_readings > 1")


QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage, "p4_found": p4_found, "p4_chosen": p4_chosen}

_P1_SPANS = r"""
WITH t AS (
  SELECT claim_key, report_id, trim(date_start) AS s, trim(date_end) AS e FROM claims WHERE report_id IS NOT NULL
), d AS (
  SELECT DISTINCT report_id,
    CASE WHEN regexp_full_match(s, '[0-9]{4}(-[0-9]{2}){0,2}') AND s[1:4] <> '0000' THEN TRY_CAST(s || substr('-01-01', length(s) - 3) AS DATE) END AS a,
    CASE WHEN regexp_full_match(e, '[0-9]{4}') THEN TRY_CAST(e || '-12-31' AS DATE)
         WHEN regexp_full_match(e, '[0-9]{4}-[0-9]{2}') THEN last_day(TRY_CAST(e || '-01' AS DATE))
         WHEN regexp_full_match(e, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(e AS DATE) END AS b
  FROM t
), v AS (
  SELECT report_id, a, b, max(b) OVER (PARTITION BY report_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM d WHERE a <= b
), g AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY report_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM v
), p AS (
  SELECT report_id, k, min(a) AS a, max(b) AS b FROM g GROUP BY ALL
), n AS (
  SELECT *, lead(a) OVER (PARTITION BY report_id ORDER BY k) AS nxt FROM p
), spans AS (
  SELECT report_id, 'period' AS span_kind, a AS first_day, b AS last_day FROM n
  UNION ALL
  SELECT report_id, 'gap', b + 1, nxt - 1 FROM n WHERE nxt IS NOT NULL
)
"""

ORACLE = {
    "p1_found": _P1_SPANS + "SELECT report_id, span_kind, strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day FROM spans",
    "p1_coverage": _P1_SPANS
    + """SELECT report_id, count(*) FILTER (span_kind = 'period') AS periods, count(*) FILTER (span_kind = 'gap') AS gaps,
  CAST(sum(CASE WHEN span_kind = 'period' THEN last_day - first_day + 1 END) AS BIGINT) AS covered_days,
  CAST(coalesce(max(CASE WHEN span_kind = 'gap' THEN last_day - first_day + 1 END), 0) AS BIGINT) AS longest_gap
FROM spans GROUP BY report_id""",
}
