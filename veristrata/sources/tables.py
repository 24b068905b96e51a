"""Named sources: the tables of a folder, nested report documents, and search results behind one contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "report_id bigint, report_no string, candidate_name string, claims array<struct<claim_key:bigint,claim_no:string,status:string,best_tier:string,elements:array<string>>>"


def reports_json(spark: SparkSession, path: str) -> DataFrame:
    """Report documents, one a line, read with their schema; a broken line is a row with a null id."""
    return spark.read.schema(REPORT).json(path)


def fallback(first: DataFrame, second: DataFrame, key: str, failed: DataFrame | None = None) -> DataFrame:
    """Rows of the first source, and of the second for keys that the first has none of, or that failed there."""
    need = second.join(first.select(key).distinct(), key, "left_anti")
    if failed is not None:
        need = need.join(failed.select(key).distinct(), key, "left_semi")
    return first.unionByName(need)


def once_per_query(requests: DataFrame) -> DataFrame:
    """Each (query, site) of a report asked once."""
    return requests.dropDuplicates(["report_id", "query_text", "site"])


def dimension(spark: SparkSession, path: str, schema: str, checks: dict[str, str]) -> DataFrame:
    """A JSON dimension with its constraints counted first; a violated one raises an error with its name."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    bad = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in checks.items()]).first()
    wrong = {n: bad[n] for n in checks if bad[n]}
    if wrong:
        raise ValueError(f"constraints violated: {wrong}")
    return df
