"""Search plans: forms filled from claims, one query per identity, cut at a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import text as T

#: name, template, kind, round, weight: the forms a claim is searched by.
FORMS = [
    ("official", '"{name}" {award}', "official", 1, 30),
    ("organiser", "{org} {award}", "organiser", 1, 20),
    ("person", '"{name}" {org}', "person", 2, 25),
    ("role", '"{name}" {role}', "person", 2, 15),
    ("year", "{org} {award} {year}", "official", 3, 10),
]


def context(claims: DataFrame, reports: DataFrame) -> DataFrame:
    """Claims with a map of what templates may name: entities first, elements where they are missing."""
    def of(entity: str, field: str):
        hit = F.filter("elements", lambda e: T.element_field(e) == field)
        return F.coalesce(F.nullif(F.trim(F.col("entities")[entity]), F.lit("")), F.nullif(F.trim(T.element_value(F.try_element_at(hit, F.lit(1)))), F.lit("")))

    c = claims.join(reports.select("report_id", "candidate_name"), "report_id")
    pairs = {"name": F.trim("candidate_name"), "org": of("org", "单位"), "role": of("role", "职务"), "award": of("award", "奖项"), "year": T.first_year(F.col("date_label")).cast("string")}
    return c.select("claim_key", F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).alias("ctx"))


def plan(ctx: DataFrame, budget: int) -> DataFrame:
    """(claim_key, query_no, form, kind, query_text): distinct queries of a claim in order, up to the budget."""
    forms = F.array(*[F.struct(F.lit(n).alias("form"), F.lit(k).alias("kind"), F.lit(r).alias("round"), F.lit(w).alias("weight"), F.lit(i).alias("ordinal"), T.fill(t, F.col("ctx")).alias("query_text")) for i, (n, t, k, r, w) in enumerate(FORMS)])
    q = ctx.select("claim_key", F.inline(F.filter(forms, lambda f: f["query_text"].isNotNull())))
    once = q.withColumn("_n", F.row_number().over(W.partitionBy("claim_key", "query_text", "kind").orderBy("ordinal"))).where("_n = 1")
    ranked = once.withColumn("query_no", F.row_number().over(W.partitionBy("claim_key").orderBy("round", F.desc("weight"), "ordinal")))
    return ranked.where(F.col("query_no") <= budget).select("claim_key", "query_no", "form", "kind", "query_text")
