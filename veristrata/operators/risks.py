"""Lines of text that try to steer a reader's tool: found by pattern, shown and taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns in order, the first that fits a line names its risk (fixed values).
PATTERNS = [
    ("忽略(之前|上述|以上|前面)的?(指令|规则|要求|提示)", "忽略既有指令"),
    (r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions?", "ignore previous instructions"),
    (r"disregard\s+(all\s+)?(previous|prior|above)", "disregard previous"),
    (r"system\s*prompt", "system prompt"),
    ("你现在是", "角色改写"),
    ("(从现在开始|从此以后)你(是|要|必须)", "角色改写"),
    ("(把|将)(所有|全部)(条目|经历|陈述).{0,8}(标记|标注|判定)为", "要求直接改写结论"),
    ("(标记|判定|输出)为(已证实|真实|通过)", "要求直接改写结论"),
    ("</?(untrusted_data|system|assistant)>", "标签闭合攻击"),
]
PLACEHOLDER = "[removed]"


def risk(line: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """The name of the first pattern a line fits, else null."""
    out = F.when(line.rlike("(?i)" + patterns[0][0]), patterns[0][1])
    for p, name in patterns[1:]:
        out = out.when(line.rlike("(?i)" + p), name)
    return out


def scan(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]] = PATTERNS) -> DataFrame:
    """(key, line_no from 1, detail, excerpt of 120 characters) of the lines at risk."""
    lines = texts.where(F.col(text).rlike("(?i)" + "|".join(p for p, _ in patterns))).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return lines.withColumn("detail", risk(F.col("line"), patterns)).where("detail is not null").select(key, (F.col("i") + 1).alias("line_no"), "detail", F.substring(F.trim("line"), 1, 120).alias("excerpt"))


def scrub(text: Column, patterns: list[tuple[str, str]] = PATTERNS) -> Column:
    """The text with its lines at risk replaced."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda l: F.when(risk(l, patterns).isNotNull(), PLACEHOLDER).otherwise(l)), "\n")
