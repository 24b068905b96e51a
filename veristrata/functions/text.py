"""Expressions on text, lists and elements; all of them stay in the JVM unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def first_year(c: Column) -> Column:
    """The first year 1900-2099 in a text as an int, else null."""
    return F.nullif(F.regexp_extract(c, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def element_field(e: Column) -> Column:
    """The part of ``field=value`` before the first ``=``; the whole text where there is none."""
    return F.substring_index(e, "=", 1)


def element_value(e: Column) -> Column:
    """The part after the first ``=``; null where there is none."""
    at = F.instr(e, "=")
    return F.when(at > 0, F.substring(e, at + 1, F.length(e)))


def squeeze(c: Column) -> Column:
    """Runs of blanks become one, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def compact_letters(c: Column) -> Column:
    """A comparison key: letters and digits of any script in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def compact_blanks(c: Column) -> Column:
    """A comparison key: the text without blanks."""
    return F.regexp_replace(c, r"(?U)\s+", "")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark has no function for; Arrow batches."""
    return s.str.normalize("NFKC")


def compact_nfkc(c: Column) -> Column:
    """A comparison key: NFKC, lower case, without blanks and punctuation."""
    return compact_letters(nfkc(c))


def bracket_alias(c: Column) -> Column:
    """The name before a bracket and the alias inside it, as an array without blanks or repeats."""
    outside = squeeze(F.regexp_replace(c, r"[（(][^（）()]*[）)]", " "))
    inside = F.transform(F.regexp_extract_all(c, F.lit(r"[（(]([^（）()]{2,})[）)]"), 1), lambda x: F.trim(x))
    return F.array_distinct(F.filter(F.concat(F.array(outside), inside), lambda x: F.length(x) > 0))


def fill(template: str, context: Column) -> Column:
    """A template with ``{name}`` places filled from a map; null where a place has no value."""
    import re

    names = re.findall(r"\{([a-z_]+)\}", template)
    out, missing = F.lit(template), F.lit(False)
    for n in dict.fromkeys(names):
        v = F.element_at(context, F.lit(n))
        missing = missing | v.isNull() | (F.trim(v) == "")
        out = F.replace(out, F.lit("{" + n + "}"), F.coalesce(v, F.lit("")))
    return F.when(~missing, squeeze(out))


def contains_in_order(text: Column, parts: Column) -> Column:
    """True if every part occurs in the text, each after the one before, blanks ignored."""
    plain = compact_blanks(text)

    def step(at: Column, part: Column) -> Column:
        found = F.call_function("locate", part, plain, at)
        return F.when((at > 0) & (found > 0), found + F.length(part)).otherwise(F.lit(0))

    return F.aggregate(F.transform(parts, compact_blanks), F.lit(1), step) > 0


def redact_secrets(c: Column) -> Column:
    """Key-like parameters and credentials in addresses and texts become ``[redacted]``; at most 500 characters."""
    x = F.regexp_replace(c, r"(?i)([?&;](?:api[_-]?key|key|token|access_token|secret|sign|signature|password|passwd|pwd|auth)=)[^&#\s]*", "$1[redacted]")
    x = F.regexp_replace(x, r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[:=]\s*)[^\s,;&]+", "$1[redacted]")
    return F.substring(F.regexp_replace(x, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@\s]*@", "$1"), 1, 500)


def masked(c: Column) -> Column:
    """A secret as dots with its last four characters and its length."""
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(F.concat(F.lit("••••••••"), F.right(c, F.lit(4)), F.lit(" ("), F.length(c).cast("string"), F.lit(")")))


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring; Arrow batches, linear in both texts by a suffix automaton."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        if len(x) > len(y):
            x, y = y, x
        ways: list[dict[str, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in x:
            now = len(ways)
            ways.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in ways[p]:
                ways[p][c] = now
                p = link[p]
            if p != -1:
                q = ways[p][c]
                if size[p] + 1 == size[q]:
                    link[now] = q
                else:
                    twin = len(ways)
                    ways.append(dict(ways[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p != -1 and ways[p].get(c) == q:
                        ways[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        best = at = n = 0
        for c in y:
            while at and c not in ways[at]:
                at = link[at]
                n = size[at]
            if c in ways[at]:
                at, n = ways[at][c], n + 1
                best = max(best, n)
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def json_map(c: Column) -> Column:
    """A JSON object as a map of strings; an empty map for anything else."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
