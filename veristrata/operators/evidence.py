"""Evidence algebra: recomputed scores, copies of one origin, verdicts and coverage.

Everything is grouped by claim, whose evidence is spread by hash; aggregates combine on the
map side. Arrays of one row stay arrays and are never exploded only to be put together again.

Defined results: null arrays count as empty; rows without a claim are left out where claims
are judged; ties between copies go to the lower ordinal, then the lower id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points of a signal; a conflict takes five (fixed values).
WEIGHTS = {"学校一致": 2, "任职单位一致": 2, "时间吻合": 1, "发布方为相关机构": 1, "学院一致": 2, "专业一致": 1, "年级一致": 1, "队友或合作者一致": 2, "具体经历一致": 2, "英文作者联合关联": 3, "候选人自提供该链接": 2, "账号由候选人提供": 2}
WEAK = ["时间吻合", "发布方为相关机构"]
CONFLICT = 5
STATUSES = ["ok", "part", "ask", "none", "who"]


def once(df: DataFrame, key: str, arrival: str = "ingested_at") -> DataFrame:
    """Each key once; rows delivered again differ in their arrival alone."""
    return df.drop(arrival).where(F.col(key).isNotNull()).dropDuplicates([key])


def points(signals: Column) -> Column:
    """Sum of the points of signals, repeats counted again, unknown ones nothing."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.aggregate(F.coalesce(signals, F.array().cast("array<string>")), F.lit(0), lambda a, s: a + F.coalesce(F.element_at(weight, s), F.lit(0)))


def score(signals: Column, conflicts: Column) -> Column:
    return points(signals) - CONFLICT * F.greatest(F.size(F.coalesce(conflicts, F.array().cast("array<string>"))), F.lit(0))


def scored(evidence: DataFrame) -> DataFrame:
    """Evidence with ``score``, ``identity`` (self, human or who), ``anchor`` and ``valid``."""
    s = evidence.withColumn("score", score(F.col("identity_signals"), F.col("identity_conflicts")))
    clash = F.size(F.coalesce("identity_conflicts", F.array().cast("array<string>"))) > 0
    content = points(F.array_except(F.coalesce("identity_signals", F.array().cast("array<string>")), F.array(*map(F.lit, WEAK))))
    return (
        s.withColumn("identity", F.when(clash, "who").when(F.col("score") >= 4, "self").when(F.col("score") >= 2, "human").otherwise("who"))
        .withColumn("anchor", (content >= 2) | (F.col("score") >= 4))
        .withColumn("valid", (F.col("score") >= 2) & ~clash)
    )


def origin_key(origin: Column, url: Column) -> Column:
    """The origin, or the address where there is none; null, which never merges, where it is blank."""
    return F.nullif(F.trim(F.when(origin.isNull() | (origin == ""), url).otherwise(origin)), F.lit(""))


def best_copy(evidence: DataFrame) -> DataFrame:
    """Of the rows of a claim with one origin, that of the best tier, then the highest score; needs ``scored``."""
    key = F.coalesce(F.concat(F.lit("u"), origin_key(F.col("origin_url"), F.col("url"))), F.concat(F.lit("e"), F.col("evidence_id").cast("string")))
    w = W.partitionBy("claim_key", "_key").orderBy(F.col("source_tier").asc_nulls_last(), F.desc("score"), "ordinal", "evidence_id")
    return evidence.where("claim_key is not null").withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def judged(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per claim: status, best tier, proved elements, the open ones as a list, and whether a person must look."""
    empty = F.array().cast("array<string>")
    e = best_copy(scored(evidence))
    gather = lambda c, cond: F.array_distinct(F.flatten(F.collect_list(F.when(cond, F.coalesce(c, empty)))))
    valid = F.col("valid")
    per = e.groupBy("claim_key").agg(
        F.count("*").alias("n_evidence"), F.count_if(valid).alias("n_valid"),
        F.bool_or(valid & (F.size(F.coalesce("contradicts", empty)) > 0)).alias("against"),
        gather(F.col("supports"), valid).alias("sup"), gather(F.col("supports"), valid & (F.col("extraction_method") == "text")).alias("sup_text"),
        F.min(F.when(valid, F.col("source_tier"))).alias("tier_valid"), F.min("source_tier").alias("tier_all"),
        F.bool_or(valid & F.col("anchor")).alias("anchored"), F.bool_or((F.col("extraction_method") != "text") | F.col("score").between(2, 3)).alias("doubt"),
    )
    j = claims.select("claim_key", "report_id", F.coalesce("elements", empty).alias("elements")).join(per, "claim_key", "left")
    whole = lambda c: F.size(F.array_except("elements", F.coalesce(F.col(c), empty))) == 0
    status = (
        F.when(F.col("n_evidence").isNull(), "none").when(F.col("n_valid") == 0, "who").when(F.col("against"), "ask").when(F.size("sup") == 0, "none")
        .when(whole("sup") & F.col("tier_valid").isin("A", "B") & F.col("anchored") & whole("sup_text"), "ok").otherwise("part")
    )
    proved = F.filter("elements", lambda x: F.array_contains(F.coalesce(F.col("sup"), empty), x))
    return j.select(
        "claim_key", "report_id", status.alias("status"), F.coalesce("tier_valid", "tier_all").alias("best_tier"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.size("elements").alias("n_elements"), F.size(proved).alias("n_proved"),
        F.filter("elements", lambda x: ~F.array_contains(F.coalesce(F.col("sup"), empty), x)).alias("open"), (status.isin("ask", "who") | F.coalesce("doubt", F.lit(False))).alias("needs_human"),
    )


def verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``judged`` with the open elements as one text."""
    j = judged(claims, evidence)
    return j.select(*[F.array_join("open", "；").alias("unproved") if c == "open" else c for c in j.columns])
