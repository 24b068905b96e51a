"""Joins that a plain equality does not say: domain suffixes, intervals, longest names, unique hints.

Theta conditions become equalities first (all suffixes of a host, all months of a bounded
range), so that Spark joins by hash or sort and no nested loop over both sides is planned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.functions import urls
from veristrata.tables import BROADCAST_ROWS


def in_domain(pages: DataFrame, url: str, domains: DataFrame, domain: str) -> DataFrame:
    """Pages with the domains their host lies in, by an equi-join on the suffixes of the host."""
    keyed = pages.withColumn("_d", F.explode(urls.suffixes(urls.host(F.col(url)))))
    return keyed.join(domains.withColumn("_d", F.lower(domain)), "_d").drop("_d")


def outside_domains(pages: DataFrame, url: str, domains: DataFrame, domain: str, key: str) -> DataFrame:
    """Pages whose host lies in none of the domains."""
    hit = in_domain(pages.select(key, url), url, domains.select(domain), domain).select(key).distinct()
    return pages.join(hit, key, "left_anti")


def month(c: Column) -> Column:
    """Months since the first of year 0."""
    return F.year(c) * 12 + F.month(c) - 1


def calendar_parts(a: Column, b: Column) -> tuple[Column, Column]:
    """The months a to b as the years they hold whole, and the months besides, 22 at most; a span of a century is a hundred rows, not twelve hundred."""
    first, last = F.ceil(a / 12).cast("int"), F.floor((b + 1) / 12).cast("int") - 1
    none = F.array().cast("array<int>")
    seq = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(none)
    whole = F.when(a <= b, seq(first, last)).otherwise(none)
    beside = F.when(a > b, none).when(first > last, seq(a, b)).otherwise(F.concat(seq(a, first * 12 - 1), seq(last * 12 + 12, b)))
    return whole, beside


def _keys(kind: str, items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit(kind).alias("k"), x.cast("int").alias("n")))


def only_value_meeting(left: DataFrame, right: DataFrame, on: str, key: str, value: str) -> DataFrame:
    """(key, value): for left spans [a, b] the value of the right spans [c, d] they share a month with, if it is one alone; an open end (null) lasts to the last month of either side.

    The right side is first brought to a row a whole year, a month besides and a year touched, with
    the least and the greatest value, so no pairs of spans are made, however many a group holds.
    """
    end = lambda df, x, y: df.agg(F.max(F.greatest(month(F.col(x)), F.coalesce(month(F.col(y)), month(F.col(x)))))).first()[0]
    last = F.lit(max(end(left, "a", "b") or 0, end(right, "c", "d") or 0))
    rw, rm = calendar_parts(month(F.col("c")), F.coalesce(month(F.col("d")), last))
    years = lambda m: F.array_distinct(F.transform(m, lambda x: F.floor(x / 12).cast("int")))
    r = right.select(on, value, F.explode(F.concat(_keys("whole", rw), _keys("month", rm), _keys("touched", F.array_union(rw, years(rm))))).alias("x"))
    r = r.groupBy(on, "x").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    lw, lm = calendar_parts(month(F.col("a")), F.coalesce(month(F.col("b")), last))
    l = left.select(on, key, F.explode(F.concat(_keys("touched", lw), _keys("month", lm), _keys("whole", years(lm)))).alias("x"))  # noqa: E741
    g = l.join(r, [on, "x"]).groupBy(key).agg(F.min("_lo").alias(value), F.max("_hi").alias("_hi"))
    return g.where(F.col(value) == F.col("_hi")).drop("_hi")


def only_one(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key where all rows agree on it; keys with several values are left out."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_max"))
    return g.where(F.col(value) == F.col("_max")).drop("_max")


def longest_name(texts: DataFrame, key: str, text: str, names: DataFrame, name_id: str, name: str) -> DataFrame:
    """(key, name_id, name): the longest name a text holds; null ties between different entries are left out.

    The names go to the workers as an automaton, which reads each text once whatever their number;
    more than ``BROADCAST_ROWS`` names go in blocks by their hash, and the longest of all blocks
    wins. Names of one text are in one block, so different entries with one name meet there.
    """
    own = names.select(F.col(name_id).cast("bigint").alias(name_id), name).where(F.length(name) >= 2)
    n = own.count()
    blocks = 1 if n <= BROADCAST_ROWS else 2 * -(-n // BROADCAST_ROWS)
    parts = [_longest(texts, key, text, sorted((r[1], r[0]) for r in own.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == b).collect()), name_id, name) for b in range(blocks)]
    both = reduce(DataFrame.unionByName, parts)
    if blocks == 1:
        return both.where(F.col(name_id).isNotNull())
    most = both.groupBy(key).agg(F.max(F.length(name)).alias("_n")).withColumnRenamed(key, "_key")
    best = both.join(most, (F.col(key) == F.col("_key")) & (F.length(name) == F.col("_n"))).groupBy(key).agg(F.max(name_id).alias(name_id), F.max(name).alias(name), F.count("*").alias("_c"), F.count_if(F.col(name_id).isNull()).alias("_tie"))
    return best.where("_c = 1 and _tie = 0").drop("_c", "_tie")


def _longest(texts: DataFrame, key: str, text: str, pairs: list[tuple[str, int]], name_id: str, name: str) -> DataFrame:
    """The longest name of a block that each text holds; its id is null where it does not tell one entry."""
    out = pa.schema([(key, pa.int64()), (name_id, pa.int64()), (name, pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, set[int]] = {}
        for n, i in pairs:
            ids.setdefault(n, set()).add(i)
        a = ahocorasick.Automaton()
        for n in ids:
            a.add_word(n, n)
        if ids:
            a.make_automaton()
        for b in batches:
            got: list[tuple[int, int, str]] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {n for _, n in a.iter(t)} if ids else set()
                if found:
                    most = max(map(len, found))
                    best = [n for n in found if len(n) == most]
                    one = len(best) == 1 and len(ids[best[0]]) == 1
                    got.append((k, next(iter(ids[best[0]])) if one else None, best[0]))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(out)], schema=out)

    return texts.select(F.col(key).cast("bigint"), text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} bigint, {name_id} bigint, {name} string")


def levels(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, level) of a graph of dependencies edges(src, dst): the longest way to each node; a cycle raises an error.

    A way without a cycle has fewer steps than there are nodes, so a longer one tells a cycle,
    whatever the depth of the graph.
    """
    from veristrata.tables import cut

    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    most = nodes.count()
    level = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(0))
    out = level
    if not most:
        return out
    for i in range(1, most + 1):
        level = cut(edges.join(level, edges.src == level.node).select(F.col("dst").alias("node")).distinct().withColumn("level", F.lit(i)))
        if level.isEmpty():
            found = out.groupBy("node").agg(F.max("level").alias("level"))
            if found.count() < most:
                break
            return found
        out = out.unionByName(level)
    raise ValueError("the dependencies have a cycle")


def route_match(claims: DataFrame, named: DataFrame, general: DataFrame) -> DataFrame:
    """Distinct (claim_key, route_id) of claims(claim_key, category, k): routes of a category for an institution, by its key k, and routes for all of a category."""
    a = claims.join(named, ["category", "k"]).select("claim_key", "route_id")
    return a.unionByName(claims.join(general, "category").select("claim_key", "route_id")).distinct()


def containing_one(left: DataFrame, right: DataFrame, on: list[str], key: str, value: str) -> DataFrame:
    """(key, value) of left spans [a, b] that lie in right spans [ea, eb] of one value alone; equality on the keys comes first, so only spans of one owner meet."""
    r = right.select(*on, F.col(value).alias("_v"), "ea", "eb").distinct()
    g = left.join(r, on).where("ea <= a and b <= eb").groupBy(key).agg(F.min("_v").alias(value), F.max("_v").alias("_hi"))
    return g.where(F.col(value) == F.col("_hi")).drop("_hi")


def selection(known: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """All known rows with ``selected``; a selection that is empty or names an unknown key raises an error."""
    ids = ids.select(key).distinct()
    if ids.isEmpty() or not ids.join(known.select(key), key, "left_anti").isEmpty():
        raise ValueError("the selection is empty or names unknown keys")
    return known.join(ids.withColumn("selected", F.lit(True)), key, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def followed(start: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(page, step) of pages(page) followed over edges(src, dst), each page at the first step that reaches it; as many joins as steps."""
    from veristrata.tables import cut

    seen = front = start.select("page").distinct().withColumn("step", F.lit(0))
    for i in range(1, steps + 1):
        ahead = front.join(edges, front.page == edges.src).select(F.col("dst").alias("page")).distinct()
        front = cut(ahead.join(seen.select("page"), "page", "left_anti").withColumn("step", F.lit(i)))
        seen = seen.unionByName(front)
    return seen


def profiles(owners: DataFrame, rules: list[tuple[str, list[str], list[str]]], fallback: str = "fallback") -> DataFrame:
    """Owners(…, cats array<string>) with their profiles in order: each rule's two lists of categories must meet the owner's, ``*`` meets any; more conditions come first, then the order of the rules; the fallback where no rule fits."""
    def fits(want: list[str]) -> Column:
        return F.lit(True) if want == ["*"] else F.arrays_overlap("cats", F.array(*[F.lit(x) for x in want]))

    hits = [F.when(fits(a) & fits(b), F.struct(F.lit(-((a != ["*"]) + (b != ["*"]))).alias("w"), F.lit(i).alias("o"), F.lit(n).alias("profile"))) for i, (n, a, b) in enumerate(rules)]
    found = F.array_sort(F.filter(F.array(*hits), lambda x: x.isNotNull()))
    names = F.transform(found, lambda x: x["profile"])
    out = owners.select("*", F.posexplode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(fallback)))).alias("_i", "profile"))
    return out.withColumn("place", F.col("_i") + 1).drop("_i", "cats")
