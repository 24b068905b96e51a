"""Queries of the verification engine itself, each over whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristrata.functions import text as T
from veristrata.functions import urls as U
from veristrata.operators import evidence as E
from veristrata.operators import joins as J
from veristrata.operators import ranking as R
from veristrata.operators import risks as X
from veristrata.operators import usage as G
from veristrata.plans import search as P
from veristrata.tables import broadcast_if_small, table

EMPTY = "cast(array() as array<string>)"
#: Lines that steer a reader in other words, besides the fixed patterns: rules to be dropped, checks to be left out, a verdict asked for, a person vouched for.
STEERING = [
    *X.PATTERNS,
    (r"(forget|drop|override|bypass)\s+(all\s+|the\s+|your\s+|any\s+)*(earlier|previous|prior|above|former|existing)?\s*(rules|instructions|guidelines|prompts)|(无视|忽视|忘记|不要理会|跳过)(先前|之前|以上|此前|上述|所有)?的?(规定|规则|指令|要求|提示)", "forget rules"),
    (r"(skip|omit|leave out)\s+(all\s+|the\s+|any\s+)*(checks?|verification|review)|(候选人|申请人|本人|该生)(已|已经)?(由|经)[^。，]{0,8}(核实|验证|确认|认证)", "skip checks"),
    (r"(rate|mark|grade|score|label)\s+(this|the)\s+(file|document|report|candidate|r.sum.|entry)\s+as\s+\w+|(请|直接)?(输出|给出|写成)(最佳|最好|最高|满分|通过)的?(结论|评价|评分)", "rewrite verdict"),
]


def _evidence(s: SparkSession, d: str) -> DataFrame:
    return E.once(table(s, d, "evidence"), "evidence_id")


def _claims(s: SparkSession, d: str) -> DataFrame:
    return E.once(table(s, d, "claims"), "claim_key")


def _hits(s: SparkSession, d: str) -> DataFrame:
    return E.once(table(s, d, "search_hits"), "hit_id", "fetched_at")


def _reports(s: SparkSession, d: str) -> DataFrame:
    return E.once(table(s, d, "reports"), "report_id")


def _log(s: SparkSession, d: str) -> DataFrame:
    return G.usage_log(table(s, d, "events"))


def evidence_score(s, d):
    return E.scored(_evidence(s, d)).select("evidence_id", "score", "identity", "anchor", "valid")


def evidence_best_copy(s, d):
    return E.best_copy(E.scored(_evidence(s, d))).select("claim_key", "evidence_id", "source_tier", "score")


def _verdicts(s, d):
    return E.verdicts(_claims(s, d), _evidence(s, d))


def claim_verdict(s, d):
    return _verdicts(s, d)


def status_counts(s, d):
    named = s.createDataFrame([(x,) for x in E.STATUSES], "status string")
    return named.join(_verdicts(s, d).groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def coverage(s, d):
    """Per report: claims, those with evidence, fully proved, needing a person, and elements proved."""
    n = lambda c: F.count_if(c)
    return _verdicts(s, d).where("report_id is not null").groupBy("report_id").agg(
        F.count("*").alias("claims"), n(F.col("n_evidence") > 0).alias("with_evidence"), n(F.col("status") == "ok").alias("proved"), n(F.col("needs_human")).alias("human"),
        F.sum("n_elements").cast("bigint").alias("elements"), F.sum("n_proved").cast("bigint").alias("elements_proved"),
    )


def element_pairs(s, d):
    e = _claims(s, d).select("claim_key", F.explode("elements").alias("e"))
    return e.groupBy(T.element_field(F.col("e")).alias("field"), T.element_value(F.col("e")).alias("value")).agg(F.count("*").alias("n"))


def supports_verbatim(s, d):
    """Evidence whose supported values stand in the snippet, blanks ignored."""
    v = F.transform("supports", T.element_value)
    own = T.compact_blanks(F.coalesce("snippet", F.lit("")))
    hit = F.filter(v, lambda x: x.isNotNull() & (T.compact_blanks(x) != "") & F.contains(own, T.compact_blanks(x)))
    return _evidence(s, d).where(F.size(F.coalesce("supports", F.expr(EMPTY))) > 0).select("evidence_id", F.size("supports").cast("bigint").alias("n_supports"), F.size(hit).cast("bigint").alias("n_verbatim"))


def url_keys(s, d):
    return _hits(s, d).select("hit_id", U.url_key(F.col("url")).alias("url_key"), U.page_key(F.col("url")).alias("page_key"))


def hit_identity(s, d):
    """Of hits with one canonical address the best-ranked; copies counted."""
    h = _hits(s, d).withColumn("url_key", U.url_key(F.col("url")))
    return h.groupBy("url_key").agg(F.min_by("hit_id", F.struct("hit_rank", "hit_id")).alias("hit_id"), F.count("*").alias("copies"))


def host_counts(s, d):
    h = _evidence(s, d).select(U.host(F.col("url")).alias("host"), "claim_key")
    return h.groupBy("host", U.base_domain(F.col("host")).alias("domain")).agg(F.count("*").alias("n"), F.count_distinct("claim_key").alias("claims"))


def domain_join(s, d):
    """Hits on a host of an institution's domain."""
    routes = table(s, d, "contact_routes").where("school_domain is not null").select("route_id", F.col("school_domain").alias("domain"))
    return J.in_domain(_hits(s, d).select("hit_id", "url"), "url", broadcast_if_small(routes), "domain").select("hit_id", "route_id").distinct()


def source_exclusion(s, d):
    """Evidence outside the excluded domains: here those of sites whose language is German."""
    blocked = table(s, d, "sites").where("lang = 'de'").select(F.col("site").alias("domain"))
    return J.outside_domains(_evidence(s, d), "url", broadcast_if_small(blocked), "domain", "evidence_id").select("evidence_id", "site")


def unique_domain_vote(s, d):
    """The domain of a publisher where all its pages agree on one."""
    v = _evidence(s, d).where("trim(publisher) <> ''").select("publisher", U.base_domain(U.host(F.col("url"))).alias("domain"))
    return J.only_one(v, ["publisher"], "domain")


def _relevance():
    filled = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 1).otherwise(0)
    return (filled("official_url") * 6 + filled("publisher") * 2 + filled("content") * 3 + F.when(F.col("publication_type") == "article", 2).otherwise(0) - F.least(F.col("hit_rank"), F.lit(10))).cast("bigint")


def hits_top3(s, d):
    h = _hits(s, d).withColumn("relevance", _relevance())
    return R.top(h, ["query_text"], [F.desc("relevance"), "hit_rank", "hit_id"], 3).select("query_text", "rank", "hit_id", "relevance")


def read_allocation(s, d):
    """Reads of a site given out in turns over its queries, up to eight."""
    h = _hits(s, d).withColumn("relevance", _relevance())
    return R.interleave(h, "site", "query_text", [F.desc("relevance"), "hit_id"], [F.desc("relevance"), "hit_id"], 8).select("site", "read_no", "hit_id")


def report_retention(s, d):
    return R.top(_reports(s, d), ["target_position"], [F.desc("report_id")], 10).select("target_position", "rank", "report_id")


def reports_newest(s, d):
    return _reports(s, d).orderBy(F.desc("report_id")).limit(10).select("report_id", "report_no")


def education_overlap(s, d):
    """Claims of a report that share a month with education at one institution alone."""
    from veristrata.operators.intervals import first_day, last_day

    c = _claims(s, d).select("claim_key", "report_id", "category", F.col("entities")["org"].alias("org"), first_day(F.col("date_start")).alias("a"), last_day(F.col("date_end")).alias("b"))
    left = c.where("category <> '学历' and a is not null").select("claim_key", "report_id", "a", "b")
    right = c.where("category = '学历' and a is not null and trim(org) <> ''").select("report_id", F.col("a").alias("c"), F.col("b").alias("d"), "org")
    return J.only_value_meeting(left, right, "report_id", "claim_key", "org")


def admission_hint(s, d):
    """For education, the one institution that an earlier education ended with in the year this one began."""
    y = lambda c: F.substring(F.trim(c), 1, 4)
    ok = lambda c: F.trim(c).rlike("^[0-9]{4}")
    e = _claims(s, d).where("category = '学历' and trim(entities['org']) <> ''").select("claim_key", "report_id", F.col("entities")["org"].alias("org"), F.when(ok("date_start"), y("date_start")).alias("start_year"), F.when(ok("date_end"), y("date_end")).alias("end_year"))
    o = e.where("start_year < end_year").groupBy("report_id", F.col("end_year").alias("start_year")).agg(F.min("org").alias("lo"), F.max("org").alias("hi"), F.count_distinct("org").alias("n"))
    other = F.when((F.col("n") == 1) & (F.col("lo") != F.col("org")), F.col("lo")).when((F.col("n") == 2) & (F.col("lo") == F.col("org")), F.col("hi")).when((F.col("n") == 2) & (F.col("hi") == F.col("org")), F.col("lo"))
    return e.join(o, ["report_id", "start_year"]).withColumn("hint", other).where("hint is not null").select("claim_key", "hint")


def institution_named(s, d):
    """The longest known institution that a hit's text names."""
    names = table(s, d, "known_names").where("kind = 'org'").select("name_id", F.col("full_name"))
    return J.longest_name(_hits(s, d).select("hit_id", F.col("content")), "hit_id", "content", names, "name_id", "full_name")


def registry_merge(s, d):
    """Entries of two registries for one work put together; authors of both in one list."""
    h = _hits(s, d).where("trim(official_url) <> ''").select(F.col("official_url").alias("work"), "authors", "pub_year", F.explode("registry_sources").alias("registry"))
    side = lambda r, p: h.where(F.col("registry") == r).groupBy("work").agg(F.max("pub_year").alias(f"{p}_year"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("authors")))).alias(f"{p}_authors"))
    a, b = side("registry-a", "a"), side("registry-b", "b")
    j = a.join(b, "work", "full_outer")
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("a_authors", F.expr(EMPTY)), F.coalesce("b_authors", F.expr(EMPTY)))))
    return j.select("work", F.coalesce("a_year", "b_year").alias("pub_year"), (F.col("a_year").isNotNull() & F.col("b_year").isNotNull()).alias("in_both"), F.size(both).cast("bigint").alias("n_authors"), F.array_join(both, "、").alias("authors"))


def contacts_flat(s, d):
    """Contacts of an institution, each value once, the first twelve."""
    c = table(s, d, "contact_routes").select("route_id", "institution", F.posexplode("contacts").alias("i", "c")).select("route_id", "institution", "i", "c.contact_type", "c.contact_value", T.compact_letters(F.col("c.contact_value")).alias("key"))
    once = R.top(c, ["institution", "contact_type", "key"], ["route_id", "i"], 1, "_n")
    return R.top(once, ["institution"], ["route_id", "i"], 12, "place").select("institution", "place", "contact_type", "contact_value")


def publisher_keys(s, d):
    p = _evidence(s, d).where("publisher is not null").groupBy("publisher").agg(F.count("*").alias("n"))
    return p.select("publisher", T.compact_letters(F.col("publisher")).alias("key"), F.array_join(T.bracket_alias(F.col("publisher")), " | ").alias("aliases"), "n")


def claim_years(s, d):
    return _claims(s, d).groupBy(T.first_year(F.col("raw_text")).cast("bigint").alias("year"), "category").agg(F.count("*").alias("n"))


def search_plan(s, d):
    return P.plan(P.context(_claims(s, d), _reports(s, d)), 3)


def risk_lines(s, d):
    return X.scan(E.once(table(s, d, "input_risks"), "risk_id"), "risk_id", "excerpt", STEERING).select("risk_id", "line_no", "detail", "excerpt")


def risk_scrubbed(s, d):
    r = E.once(table(s, d, "input_risks"), "risk_id").where("excerpt is not null")
    return r.select("risk_id", X.scrub(F.col("excerpt"), STEERING).alias("scrubbed"))


def usage_daily(s, d):
    return G.daily(_log(s, d), G.calendar(s, "2023-12-28", 40))


def usage_by_user(s, d):
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return G.by_user(users, _log(s, d), "2024-01-15")


def usage_by_kind(s, d):
    """Conditional sums and the counts kept in JSON."""
    l = _log(s, d)  # noqa: E741
    return l.groupBy("user_id").agg(F.count_if((F.col("kind") == "purchase") & F.col("ok")).alias("purchases"), F.count_if(~F.col("ok")).alias("errors"), G.poisoned_sum("cost").alias("cost"), F.coalesce(F.sum(F.when(F.col("k") >= 0, F.col("k"))), F.lit(0)).cast("bigint").alias("tools"))


def access_summary(s, d):
    l = _log(s, d)  # noqa: E741
    return l.groupBy("day").agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("visitors"), F.count_if(F.col("kind").ilike("%I%")).alias("api"), F.count_if(~F.col("kind").ilike("%I%")).alias("pages"))


def user_sessions(s, d):
    return G.sessions(_log(s, d), 30 * 60)


def quota_admission(s, d):
    """The first five purchases of a user pass."""
    p = _log(s, d).where("kind = 'purchase'")
    return R.top(p, ["user_id"], ["at", "event_id"], 5, "take").select("user_id", "take", "event_id")


def rate_limited(s, d):
    """At most two events of a user in any twelve hours pass; refused ones do not count."""
    return R.admit(table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", 2, 12 * 3600).select("event_id", "admitted")


def last_setting(s, d):
    """The last value of each key; an empty one deletes it."""
    l = _log(s, d)  # noqa: E741
    return l.groupBy("user_id").agg(F.max_by("kind", F.struct("at", "event_id")).alias("kind")).where("kind <> 'error'")


def first_decision(s, d):
    return _log(s, d).where("kind in ('purchase', 'error')").groupBy("user_id").agg(F.min_by("kind", F.struct("at", "event_id")).alias("decision"), F.count("*").alias("attempts"))


def report_markdown(s, d):
    """A report as Markdown: its head and a line for each claim in order."""
    v = _verdicts(s, d).select("claim_key", "status")
    c = _claims(s, d).select("claim_key", "report_id", "claim_no", "raw_text").join(v, "claim_key")
    lines = c.groupBy("report_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_key", F.concat_ws("", F.lit("- "), "claim_no", F.lit(" ["), "status", F.lit("] "), "raw_text").alias("line")))), lambda x: x["line"]).alias("lines"))
    return _reports(s, d).join(lines, "report_id").select("report_id", F.concat(F.lit("# "), "report_no", F.lit("\n"), F.array_join("lines", "\n")).alias("markdown"))


def report_json(s, d):
    """A report with its claims nested, as JSON."""
    v = _verdicts(s, d).select("claim_key", "status", "best_tier")
    c = _claims(s, d).select("claim_key", "report_id", "claim_no", "elements").join(v, "claim_key").groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("claim_key", "claim_no", "status", "best_tier", "elements"))).alias("claims"))
    r = _reports(s, d).join(c, "report_id", "left")
    return r.select("report_id", F.to_json(F.struct("report_id", "report_no", "candidate_name", "claims")).alias("document"))


def snapshot_blocks(s, d):
    """Blocks of a page by kind, copies of the block before left out."""
    b = E.once(table(s, d, "homepage_snapshots"), "snapshot_id", "fetched_at").select("snapshot_id", F.posexplode("blocks").alias("i", "b")).select("snapshot_id", "i", "b.t", "b.text")
    again = F.lag("text").over(W.partitionBy("snapshot_id").orderBy("i")) == F.col("text")
    return b.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").groupBy("snapshot_id", "t").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def research_ids(s, d):
    """Identifiers of works in statements and documents: DOI and arXiv."""
    texts = _claims(s, d).select(F.lit("claims").alias("tab"), F.col("claim_key").alias("row_id"), F.col("raw_text").alias("t")).unionByName(table(s, d, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_id"), F.col("text").alias("t")))
    found = F.concat(F.regexp_extract_all("t", F.lit(r"\b(10\.[0-9]{4,9}/[A-Za-z0-9._()/-]*[A-Za-z0-9])"), 1), F.regexp_extract_all("t", F.lit(r"\barXiv:([0-9]{4}\.[0-9]{4,5})"), 1))
    return texts.where("t is not null").select("tab", "row_id", F.explode(F.array_distinct(found)).alias("work_id"))


def labelled_fields(s, d):
    """``label: value`` lines of the excerpts of contact routes."""
    lines = table(s, d, "contact_routes").select("route_id", F.posexplode(F.split("excerpt", "\n")).alias("i", "line"))
    pattern = r"^\s*([^:：]{1,12})\s*[:：]\s*(\S.*)$"
    return lines.where(F.col("line").rlike(pattern)).select("route_id", (F.col("i") + 1).alias("line_no"), F.trim(F.regexp_extract("line", pattern, 1)).alias("label"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))


def event_ledger(s, d):
    """The first eighty events of a user in order, and whether there were more; longer lists never leave the tasks."""
    first = R.top(_log(s, d), ["user_id"], ["at", "event_id"], 81, "seq")
    g = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event_id"))).alias("l"))
    return g.select("user_id", (F.size("l") > 80).alias("truncated"), F.array_join(F.transform(F.slice("l", 1, 80), lambda x: x["event_id"].cast("string")), ",").alias("events"))


def search_budget(s, d):
    """Searches of a site in order of arrival against a budget of a dozen: how many ran, and whether it was used up."""
    n = table(s, d, "search_hits").where("hit_id is not null").select("hit_id", "site").distinct().groupBy("site").agg(F.count("*").alias("n"))
    return n.select("site", F.least("n", F.lit(12).cast("bigint")).alias("ran"), (F.col("n") > 12).alias("exhausted"))


def repost_groups(s, d):
    """Pages that repeat one origin: how many rows, claims and sites."""
    e = _evidence(s, d).where("origin_url is not null").select(E.origin_key(F.col("origin_url"), F.col("url")).alias("origin"), "claim_key", "site").where("origin is not null")
    return e.groupBy("origin").agg(F.count("*").alias("n"), F.count_distinct("claim_key").alias("claims"), F.count_distinct("site").alias("sites"))


def time_fit(s, d):
    """Evidence whose year of publication lies within a year of its claim's span."""
    e = _evidence(s, d).select("evidence_id", "claim_key", T.first_year(F.col("published_at")).alias("y"))
    c = _claims(s, d).select("claim_key", T.first_year(F.col("date_start")).alias("a"), T.first_year(F.col("date_end")).alias("b"))
    return e.join(c, "claim_key").where("y between a - 1 and coalesce(b, a) + 1").select("evidence_id", F.col("y").cast("bigint").alias("year"))


def publisher_is_party(s, d):
    """Evidence published by the institution its claim names, by the compact form of both."""
    e = _evidence(s, d).where("trim(publisher) <> ''").select("evidence_id", "claim_key", T.compact_letters(F.col("publisher")).alias("k"))
    c = _claims(s, d).select("claim_key", T.compact_letters(F.col("entities")["org"]).alias("k")).where("k <> ''")
    return e.join(c, ["claim_key", "k"]).select("evidence_id", "claim_key")


def element_gaps(s, d):
    """By category and field: elements stated, and those no valid evidence proves."""
    v = E.judged(_claims(s, d), _evidence(s, d)).select("claim_key", "open")
    c = _claims(s, d).select("claim_key", "category", "elements").join(v, "claim_key").select("category", "open", F.explode("elements").alias("e"))
    return c.groupBy("category", T.element_field(F.col("e")).alias("field")).agg(F.count("*").alias("stated"), F.count_if(F.array_contains("open", F.col("e"))).alias("open"))


def report_context(s, d):
    """What all claims of a report may be read with: its institutions and the years of its education."""
    c = _claims(s, d).where("report_id is not null")
    g = c.groupBy("report_id").agg(F.array_sort(F.collect_set(F.when(F.trim(F.col("entities")["org"]) != "", F.col("entities")["org"]))).alias("o"), F.array_sort(F.collect_set(F.when(F.col("category") == "学历", T.first_year(F.col("date_start")).cast("string")))).alias("y"))
    return g.select("report_id", F.array_join("o", "；").alias("institutions"), F.array_join("y", ",").alias("education_years"))


QUERIES = {f.__name__: f for f in (evidence_score, evidence_best_copy, claim_verdict, status_counts, coverage, element_pairs, supports_verbatim, url_keys, hit_identity, host_counts, domain_join, source_exclusion, unique_domain_vote, hits_top3, read_allocation, report_retention, reports_newest, education_overlap, admission_hint, institution_named, registry_merge, contacts_flat, publisher_keys, claim_years, search_plan, risk_lines, risk_scrubbed, usage_daily, usage_by_user, usage_by_kind, access_summary, user_sessions, quota_admission, rate_limited, last_setting, first_decision, report_markdown, report_json, snapshot_blocks, research_ids, labelled_fields, event_ledger, search_budget, repost_groups, time_fit, publisher_is_party, element_gaps, report_context)}

# ---------------------------------------------------------------- SQL

_ONCE = """
c1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY claim_key ORDER BY ingested_at) AS rn FROM claims WHERE claim_key IS NOT NULL) WHERE rn = 1),
e1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY ingested_at) AS rn FROM evidence WHERE evidence_id IS NOT NULL) WHERE rn = 1),
h1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY fetched_at) AS rn FROM search_hits WHERE hit_id IS NOT NULL) WHERE rn = 1),
r1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY ingested_at) AS rn FROM reports WHERE report_id IS NOT NULL) WHERE rn = 1)
"""
_POINTS = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in E.WEIGHTS.items()) + " ELSE 0 END"
_SCORED = f"""
sc AS (SELECT *, CAST(coalesce(list_sum(list_transform(identity_signals, lambda x: {_POINTS})), 0) - 5 * len(coalesce(identity_conflicts, [])) AS INTEGER) AS score,
  coalesce(list_sum(list_transform(list_filter(list_distinct(identity_signals), lambda x: x NOT IN ('时间吻合', '发布方为相关机构')), lambda x: {_POINTS})), 0) AS content,
  len(coalesce(identity_conflicts, [])) > 0 AS clash FROM e1),
sv AS (SELECT *, CASE WHEN clash THEN 'who' WHEN score >= 4 THEN 'self' WHEN score >= 2 THEN 'human' ELSE 'who' END AS identity, (content >= 2 OR score >= 4) AS anchor, (score >= 2 AND NOT clash) AS valid FROM sc),
bc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_key, coalesce('u' || nullif(trim(CASE WHEN origin_url IS NULL OR origin_url = '' THEN url ELSE origin_url END), ''), 'e' || evidence_id) ORDER BY source_tier NULLS LAST, score DESC, ordinal, evidence_id) AS n FROM sv WHERE claim_key IS NOT NULL) WHERE n = 1)
"""
_VERDICT = f"""
pc AS (SELECT claim_key, count(*) AS n_evidence, count(*) FILTER (valid) AS n_valid, bool_or(valid AND len(coalesce(contradicts, [])) > 0) AS against,
  coalesce(list_distinct(flatten(list(supports) FILTER (valid AND supports IS NOT NULL))), []) AS sup, coalesce(list_distinct(flatten(list(supports) FILTER (valid AND extraction_method = 'text' AND supports IS NOT NULL))), []) AS sup_text,
  min(source_tier) FILTER (valid) AS tier_valid, min(source_tier) AS tier_all, bool_or(valid AND anchor) AS anchored, bool_or(extraction_method <> 'text' OR score BETWEEN 2 AND 3) AS doubt FROM bc GROUP BY claim_key),
jj AS (SELECT c1.claim_key, report_id, coalesce(elements, []) AS elements, pc.* EXCLUDE (claim_key) FROM c1 LEFT JOIN pc USING (claim_key)),
vd AS (SELECT claim_key, report_id, CASE WHEN n_evidence IS NULL THEN 'none' WHEN n_valid = 0 THEN 'who' WHEN against THEN 'ask' WHEN len(sup) = 0 THEN 'none'
  WHEN list_has_all(sup, elements) AND tier_valid IN ('A', 'B') AND anchored AND list_has_all(sup_text, elements) THEN 'ok' ELSE 'part' END AS status,
  coalesce(tier_valid, tier_all) AS best_tier, coalesce(n_evidence, 0) AS n_evidence, CAST(len(elements) AS INTEGER) AS n_elements, CAST(len(list_filter(elements, lambda x: list_contains(coalesce(sup, []), x))) AS INTEGER) AS n_proved,
  array_to_string(list_filter(elements, lambda x: NOT list_contains(coalesce(sup, []), x)), '；') AS unproved, doubt FROM jj),
vv AS (SELECT * EXCLUDE (doubt), (status IN ('ask', 'who') OR coalesce(doubt, false)) AS needs_human FROM vd)
"""
_LOG = "lg AS (SELECT event_id, user_id, event_type AS kind, ts AS moment, strftime(ts, '%Y-%m-%d') AS day, event_type <> 'error' AS ok, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 = 0 THEN NULL ELSE CAST(round(value * 100) AS BIGINT) END AS cost FROM events)"
_POISON = "CASE WHEN count(*) FILTER (cost IS NULL) = 0 THEN CAST(sum(cost) AS BIGINT) END"
_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':\d*$', ''), '^\.+|\.+$', '', 'g')"
_BASE = "CASE WHEN array_to_string(list_slice(string_split(regexp_replace(h, '^www\\.', ''), '.'), -2, -1), '.') IN (" + ", ".join(f"'{x}'" for x in U.SECOND_LEVEL) + ") THEN array_to_string(list_slice(string_split(regexp_replace(h, '^www\\.', ''), '.'), -3, -1), '.') ELSE array_to_string(list_slice(string_split(regexp_replace(h, '^www\\.', ''), '.'), -2, -1), '.') END"
_URLKEY = r"""CASE WHEN net = '' THEN trim(url) ELSE lower(scheme) || '://' || lower(net) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END"""
_URLPARTS = r"up AS (SELECT *, regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme, regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS net, regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))), '&') AS q FROM h1)"
_FILLED = "CASE WHEN trim(coalesce({0}, '')) <> '' THEN 1 ELSE 0 END"
_REL = f"CAST({_FILLED.format('official_url')} * 6 + {_FILLED.format('publisher')} * 2 + {_FILLED.format('content')} * 3 + CASE WHEN publication_type = 'article' THEN 2 ELSE 0 END - least(hit_rank, 10) AS BIGINT)"
_COMPACT = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_RISK = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{n}'" for p, n in STEERING) + " END"
_DAY = r"CASE WHEN regexp_full_match(trim({0}), '[0-9]{{4}}(-[0-9]{{2}}){{0,2}}') AND substr(trim({0}), 1, 4) <> '0000' THEN TRY_CAST(trim({0}) || substr('-01-01', length(trim({0})) - 3) AS DATE) END"
_END = r"CASE WHEN regexp_full_match(trim({0}), '[0-9]{{4}}') THEN TRY_CAST(trim({0}) || '-12-31' AS DATE) WHEN regexp_full_match(trim({0}), '[0-9]{{4}}-[0-9]{{2}}') THEN last_day(TRY_CAST(trim({0}) || '-01' AS DATE)) WHEN regexp_full_match(trim({0}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(trim({0}) AS DATE) END"


_YEAR = "CAST(nullif(regexp_extract({0}, '((?:19|20)[0-9]{{2}})', 1), '') AS INTEGER)"


def _elem(entity: str, field: str) -> str:
    return f"coalesce(nullif(trim(entities['{entity}']), ''), nullif(trim(substr(list_filter(elements, lambda e: string_split(e, '=')[1] = '{field}')[1], {len(field) + 2})), ''))"


def _form_sql() -> str:
    rows = []
    for i, (name, tpl, kind, rnd, weight) in enumerate(P.FORMS):
        import re

        expr, needs = f"'{tpl}'", []
        for n in dict.fromkeys(re.findall(r"\{([a-z_]+)\}", tpl)):
            expr = f"replace({expr}, '{{{n}}}', coalesce({n}, ''))"
            needs.append(f"coalesce(trim({n}), '') <> ''")
        rows.append(f"SELECT claim_key, '{name}' AS form, '{kind}' AS kind, {rnd} AS round, {weight} AS weight, {i} AS ordinal, trim(regexp_replace({expr}, '\\s+', ' ', 'g')) AS query_text FROM ctx WHERE {' AND '.join(needs)}")
    return " UNION ALL ".join(rows)


_W = f"WITH {_ONCE}"
_WE = f"WITH {_ONCE}, {_SCORED}"
_WV = f"WITH {_ONCE}, {_SCORED}, {_VERDICT}"
_K1 = "k1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY risk_id ORDER BY ingested_at) AS rn FROM input_risks WHERE risk_id IS NOT NULL) WHERE rn = 1)"

ORACLE = {
    "evidence_score": _WE + "SELECT evidence_id, score, identity, anchor, valid FROM sv",
    "evidence_best_copy": _WE + "SELECT claim_key, evidence_id, source_tier, score FROM bc",
    "claim_verdict": _WV + "SELECT claim_key, report_id, status, best_tier, n_evidence, n_elements, n_proved, unproved, needs_human FROM vv",
    "status_counts": _WV + "SELECT s.status, coalesce(n, 0) AS n FROM (SELECT unnest(['ok', 'part', 'ask', 'none', 'who']) AS status) s LEFT JOIN (SELECT status, count(*) AS n FROM vv GROUP BY 1) USING (status)",
    "coverage": _WV + "SELECT report_id, count(*) AS claims, count(*) FILTER (n_evidence > 0) AS with_evidence, count(*) FILTER (status = 'ok') AS proved, count(*) FILTER (needs_human) AS human, CAST(sum(n_elements) AS BIGINT) AS elements, CAST(sum(n_proved) AS BIGINT) AS elements_proved FROM vv WHERE report_id IS NOT NULL GROUP BY 1",
    "element_pairs": _W + "SELECT string_split(e, '=')[1] AS field, CASE WHEN strpos(e, '=') > 0 THEN substr(e, strpos(e, '=') + 1) END AS value, count(*) AS n FROM (SELECT unnest(elements) AS e FROM c1) GROUP BY 1, 2",
    "supports_verbatim": _W + r"SELECT evidence_id, len(supports) AS n_supports, len(list_filter(supports, lambda x: strpos(x, '=') > 0 AND regexp_replace(substr(x, strpos(x, '=') + 1), '[\s\p{Z}]+', '', 'g') <> '' AND contains(regexp_replace(coalesce(snippet, ''), '[\s\p{Z}]+', '', 'g'), regexp_replace(substr(x, strpos(x, '=') + 1), '[\s\p{Z}]+', '', 'g')))) AS n_verbatim FROM e1 WHERE len(coalesce(supports, [])) > 0",
    "url_keys": f"WITH {_ONCE}, {_URLPARTS} SELECT hit_id, {_URLKEY} AS url_key, " + r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^https?://(www\.)?', '', 'i'), '#.*$', ''), '/+$', ''), '/(index|default|main)\.(s?html?|jsp|php|aspx?)$', '', 'i') AS page_key FROM up",
    "hit_identity": f"WITH {_ONCE}, {_URLPARTS} SELECT {_URLKEY} AS url_key, arg_min(hit_id, {{'a': hit_rank, 'b': hit_id}}) AS hit_id, count(*) AS copies FROM up GROUP BY 1",
    "host_counts": _W + f"SELECT h AS host, {_BASE} AS domain, count(*) AS n, count(DISTINCT claim_key) AS claims FROM (SELECT {_HOST} AS h, claim_key FROM e1) GROUP BY 1, 2",
    "domain_join": _W + f"SELECT DISTINCT hit_id, route_id FROM (SELECT hit_id, {_HOST} AS h FROM h1) x JOIN contact_routes r ON x.h = lower(r.school_domain) OR ends_with(x.h, '.' || lower(r.school_domain))",
    "source_exclusion": _W + f"SELECT evidence_id, site FROM (SELECT evidence_id, site, {_HOST} AS h FROM e1) x WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.lang = 'de' AND (x.h = s.site OR ends_with(x.h, '.' || s.site)))",
    "unique_domain_vote": _W + f"SELECT publisher, min(domain) AS domain FROM (SELECT publisher, {_BASE} AS domain FROM (SELECT publisher, {_HOST} AS h FROM e1 WHERE trim(publisher) <> '')) GROUP BY 1 HAVING count(DISTINCT domain) = 1",
    "hits_top3": _W + f"SELECT query_text, CAST(rank AS INTEGER) AS rank, hit_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY relevance DESC, hit_rank, hit_id) AS rank FROM (SELECT *, {_REL} AS relevance FROM h1)) WHERE rank <= 3",
    "read_allocation": _W + f"SELECT site, CAST(read_no AS INTEGER) AS read_no, hit_id FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY turn, relevance DESC, hit_id) AS read_no FROM (SELECT *, row_number() OVER (PARTITION BY site, query_text ORDER BY relevance DESC, hit_id) AS turn FROM (SELECT *, {_REL} AS relevance FROM h1))) WHERE read_no <= 8",
    "report_retention": _W + "SELECT target_position, CAST(rank AS INTEGER) AS rank, report_id FROM (SELECT *, row_number() OVER (PARTITION BY target_position ORDER BY report_id DESC) AS rank FROM r1) WHERE rank <= 10",
    "reports_newest": _W + "SELECT report_id, report_no FROM r1 ORDER BY report_id DESC LIMIT 10",
    "education_overlap": _W + f", p AS (SELECT claim_key, report_id, category, entities['org'] AS org, {_DAY.format('date_start')} AS a0, {_END.format('date_end')} AS b0 FROM c1), q AS (SELECT *, greatest(year(a0) * 12 + month(a0), 22801) AS a, least(coalesce(year(b0) * 12 + month(b0), 25212), 25212) AS b FROM p WHERE a0 IS NOT NULL) SELECT l.claim_key, min(r.org) AS org FROM q l JOIN q r USING (report_id) WHERE l.category <> '学历' AND r.category = '学历' AND trim(r.org) <> '' AND greatest(l.a, r.a) <= least(l.b, r.b) GROUP BY 1 HAVING count(DISTINCT r.org) = 1",
    "admission_hint": _W + ", e AS (SELECT claim_key, report_id, entities['org'] AS org, CASE WHEN regexp_matches(trim(date_start), '^[0-9]{4}') THEN substr(trim(date_start), 1, 4) END AS sy, CASE WHEN regexp_matches(trim(date_end), '^[0-9]{4}') THEN substr(trim(date_end), 1, 4) END AS ey FROM c1 WHERE category = '学历' AND trim(entities['org']) <> '') SELECT e.claim_key, min(o.org) AS hint FROM e JOIN e o ON e.report_id = o.report_id AND o.ey = e.sy AND o.sy < e.sy AND o.org <> e.org GROUP BY 1 HAVING count(DISTINCT o.org) = 1",
    "institution_named": _W + ", m AS (SELECT hit_id, name_id, full_name, rank() OVER (PARTITION BY hit_id ORDER BY length(full_name) DESC) AS r FROM h1 JOIN known_names n ON n.kind = 'org' AND length(n.full_name) >= 2 AND contains(h1.content, n.full_name)) SELECT hit_id, min(name_id) AS name_id, min(full_name) AS full_name FROM m WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT name_id) = 1",
    "registry_merge": _W + ", x AS (SELECT official_url AS work, authors, pub_year, unnest(registry_sources) AS registry FROM h1 WHERE trim(official_url) <> ''), g AS (SELECT work, registry, max(pub_year) AS y, list_distinct(flatten(list(authors))) AS au FROM x WHERE registry IN ('registry-a', 'registry-b') GROUP BY 1, 2), a AS (SELECT * FROM g WHERE registry = 'registry-a'), b AS (SELECT * FROM g WHERE registry = 'registry-b'), j AS (SELECT coalesce(a.work, b.work) AS work, coalesce(a.y, b.y) AS pub_year, (a.y IS NOT NULL AND b.y IS NOT NULL) AS in_both, list_sort(list_distinct(list_concat(coalesce(a.au, []), coalesce(b.au, [])))) AS au FROM a FULL JOIN b ON a.work = b.work) SELECT work, pub_year, in_both, len(au) AS n_authors, array_to_string(au, '、') AS authors FROM j",
    "contacts_flat": f"WITH x AS (SELECT route_id, institution, generate_subscripts(contacts, 1) AS i, unnest(contacts) AS c FROM contact_routes), y AS (SELECT *, row_number() OVER (PARTITION BY institution, c.contact_type, {_COMPACT.format('c.contact_value')} ORDER BY route_id, i) AS n FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY institution ORDER BY route_id, i) AS place FROM y WHERE n = 1) SELECT institution, CAST(place AS INTEGER) AS place, c.contact_type AS contact_type, c.contact_value AS contact_value FROM z WHERE place <= 12",
    "claim_years": _W + "SELECT CAST(nullif(regexp_extract(raw_text, '((?:19|20)[0-9]{2})', 1), '') AS BIGINT) AS year, category, count(*) AS n FROM c1 GROUP BY 1, 2",
    "search_plan": _W + f", ctx AS (SELECT claim_key, trim(candidate_name) AS name, {_elem('org', '单位')} AS org, {_elem('role', '职务')} AS role, {_elem('award', '奖项')} AS award, nullif(regexp_extract(date_label, '((?:19|20)[0-9]{{2}})', 1), '') AS year FROM c1 JOIN (SELECT report_id, candidate_name FROM r1) USING (report_id)), q AS ({_form_sql()}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_key, query_text, kind ORDER BY ordinal) AS n FROM q) WHERE n = 1), k AS (SELECT *, row_number() OVER (PARTITION BY claim_key ORDER BY round, weight DESC, ordinal) AS query_no FROM o) SELECT claim_key, CAST(query_no AS INTEGER) AS query_no, form, kind, query_text FROM k WHERE query_no <= 3",
    "risk_lines": f"WITH {_K1}, l AS (SELECT risk_id, unnest(string_split(excerpt, chr(10))) AS line, generate_subscripts(string_split(excerpt, chr(10)), 1) AS line_no FROM k1), m AS (SELECT *, {_RISK} AS detail FROM l) SELECT risk_id, CAST(line_no AS INTEGER) AS line_no, detail, substr(trim(line), 1, 120) AS excerpt FROM m WHERE detail IS NOT NULL",
    "risk_scrubbed": f"WITH {_K1} SELECT risk_id, array_to_string(list_transform(string_split(excerpt, chr(10)), lambda line: CASE WHEN {_RISK} IS NOT NULL THEN '[removed]' ELSE line END), chr(10)) AS scrubbed FROM k1 WHERE excerpt IS NOT NULL",
    "usage_daily": f"WITH {_LOG}, cal AS (SELECT strftime(DATE '2023-12-28' + CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(40) t(i)), p AS (SELECT day, count(*) AS runs, count(*) FILTER (NOT ok) AS failed, {_POISON} AS cost FROM lg GROUP BY 1) SELECT cal.day, coalesce(runs, 0) AS runs, coalesce(failed, 0) AS failed, CASE WHEN runs IS NULL THEN 0 ELSE cost END AS cost FROM cal LEFT JOIN p USING (day)",
    "usage_by_user": f"WITH {_LOG} SELECT c_custkey AS user_id, count(event_id) AS runs, CASE WHEN count(event_id) = 0 THEN 0 WHEN count(event_id) = count(cost) THEN CAST(sum(cost) AS BIGINT) END AS cost, max(event_id) AS last_event FROM customer LEFT JOIN lg ON lg.user_id = c_custkey AND day >= '2024-01-15' GROUP BY 1",
    "usage_by_kind": f"WITH {_LOG} SELECT user_id, count(*) FILTER (kind = 'purchase' AND ok) AS purchases, count(*) FILTER (NOT ok) AS errors, {_POISON} AS cost, CAST(coalesce(sum(k) FILTER (k >= 0), 0) AS BIGINT) AS tools FROM lg GROUP BY 1",
    "access_summary": f"WITH {_LOG} SELECT day, count(*) AS total, count(DISTINCT user_id) AS visitors, count(*) FILTER (kind ILIKE '%I%') AS api, count(*) FILTER (kind NOT ILIKE '%I%') AS pages FROM lg GROUP BY 1",
    "user_sessions": f"WITH {_LOG}, n AS (SELECT *, CASE WHEN lag(moment) OVER w IS NULL OR moment - lag(moment) OVER w > INTERVAL 30 HOUR THEN 1 ELSE 0 END AS new FROM lg WINDOW w AS (PARTITION BY user_id ORDER BY moment, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY moment, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM n) SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM s GROUP BY 1, 2",
    "quota_admission": f"WITH {_LOG} SELECT user_id, CAST(take AS INTEGER) AS take, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, event_id) AS take FROM lg WHERE kind = 'purchase') WHERE take <= 5",
    "last_setting": f"WITH {_LOG} SELECT user_id, kind FROM (SELECT user_id, arg_max(kind, {{'a': moment, 'b': event_id}}) AS kind FROM lg GROUP BY 1) WHERE kind <> 'error'",
    "first_decision": f"WITH {_LOG} SELECT user_id, arg_min(kind, {{'a': moment, 'b': event_id}}) AS decision, count(*) AS attempts FROM lg WHERE kind IN ('purchase', 'error') GROUP BY 1",
    "report_markdown": _WV + ", l AS (SELECT c1.report_id, string_agg('- ' || coalesce(claim_no, '') || ' [' || status || '] ' || coalesce(raw_text, ''), chr(10) ORDER BY c1.claim_key) AS body FROM c1 JOIN vv USING (claim_key) GROUP BY 1) SELECT r1.report_id, '# ' || report_no || chr(10) || body AS markdown FROM r1 JOIN l USING (report_id)",
    "snapshot_blocks": "WITH s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY fetched_at) AS rn FROM homepage_snapshots WHERE snapshot_id IS NOT NULL) WHERE rn = 1), b AS (SELECT snapshot_id, generate_subscripts(blocks, 1) AS i, unnest(blocks) AS b FROM s), x AS (SELECT snapshot_id, b.t AS t, b.text AS text, coalesce(lag(b.text) OVER (PARTITION BY snapshot_id ORDER BY i) = b.text, false) AS again FROM b) SELECT snapshot_id, t, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM x WHERE NOT again GROUP BY 1, 2",
    "research_ids": _W + r", t AS (SELECT 'claims' AS tab, claim_key AS row_id, raw_text AS t FROM c1 UNION ALL SELECT 'documents', doc_id, text FROM documents) SELECT DISTINCT tab, row_id, unnest(list_concat(regexp_extract_all(t, '\b(10\.[0-9]{4,9}/[A-Za-z0-9._()/-]*[A-Za-z0-9])', 1), regexp_extract_all(t, '\barXiv:([0-9]{4}\.[0-9]{4,5})', 1))) AS work_id FROM t WHERE t IS NOT NULL",
    "labelled_fields": r"WITH l AS (SELECT route_id, unnest(string_split(excerpt, chr(10))) AS line, generate_subscripts(string_split(excerpt, chr(10)), 1) AS line_no FROM contact_routes) SELECT route_id, CAST(line_no AS INTEGER) AS line_no, trim(regexp_extract(line, '^\s*([^:：]{1,12})\s*[:：]\s*(\S.*)$', 1)) AS label, trim(regexp_extract(line, '^\s*([^:：]{1,12})\s*[:：]\s*(\S.*)$', 2)) AS value FROM l WHERE regexp_matches(line, '^\s*([^:：]{1,12})\s*[:：]\s*(\S.*)$')",
    "event_ledger": f"WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY moment, event_id) AS seq FROM lg) SELECT user_id, count(*) > 80 AS truncated, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY seq) FILTER (seq <= 80) AS events FROM n GROUP BY 1",
    "publisher_keys": _W + rf""", p AS (SELECT publisher, count(*) AS n FROM e1 WHERE publisher IS NOT NULL GROUP BY 1), a AS (SELECT publisher, list_concat([trim(regexp_replace(regexp_replace(publisher, '[（(][^（）()]*[)）]', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))], list_transform(regexp_extract_all(publisher, '[（(]([^（）()]{{2,}})[)）]', 1), lambda x: trim(x))) AS l FROM p),
x AS (SELECT publisher, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM a), y AS (SELECT publisher, v, min(i) AS i FROM x WHERE v <> '' GROUP BY 1, 2) SELECT p.publisher, {_COMPACT.format('p.publisher')} AS key, coalesce(vs, '') AS aliases, n FROM p LEFT JOIN (SELECT publisher, string_agg(v, ' | ' ORDER BY i) AS vs FROM y GROUP BY 1) USING (publisher)""",
    "rate_limited": r"""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, n, event_id, TRUE AS admitted, CAST(NULL AS TIMESTAMP) AS p1, ts AS p2 FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.event_id, r.p1 IS NULL OR e.ts - r.p1 >= INTERVAL 12 HOUR, CASE WHEN r.p1 IS NULL OR e.ts - r.p1 >= INTERVAL 12 HOUR THEN r.p2 ELSE r.p1 END, CASE WHEN r.p1 IS NULL OR e.ts - r.p1 >= INTERVAL 12 HOUR THEN e.ts ELSE r.p2 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) SELECT event_id, admitted FROM r""",
    "report_json": _WV + r""", c AS (SELECT c1.report_id, '[' || string_agg('{"claim_key":' || c1.claim_key || CASE WHEN claim_no IS NULL THEN '' ELSE ',"claim_no":' || to_json(claim_no) END || ',"status":' || to_json(vv.status) || CASE WHEN vv.best_tier IS NULL THEN '' ELSE ',"best_tier":' || to_json(vv.best_tier) END || CASE WHEN c1.elements IS NULL THEN '' ELSE ',"elements":' || to_json(c1.elements) END || '}', ',' ORDER BY c1.claim_key) || ']' AS claims FROM c1 JOIN vv USING (claim_key) GROUP BY 1)
SELECT r1.report_id, '{"report_id":' || r1.report_id || CASE WHEN report_no IS NULL THEN '' ELSE ',"report_no":' || to_json(report_no) END || CASE WHEN candidate_name IS NULL THEN '' ELSE ',"candidate_name":' || to_json(candidate_name) END || CASE WHEN claims IS NULL THEN '' ELSE ',"claims":' || claims END || '}' AS document FROM r1 LEFT JOIN c USING (report_id)""",
    "search_budget": "WITH h AS (SELECT hit_id, site, min(fetched_at) AS first FROM search_hits WHERE hit_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY first, hit_id) AS n FROM h) SELECT site, count(*) FILTER (n <= 12) AS ran, count(*) > 12 AS exhausted FROM n GROUP BY 1",
    "repost_groups": _W + ", o AS (SELECT nullif(trim(CASE WHEN origin_url = '' THEN url ELSE origin_url END), '') AS origin, claim_key, site FROM e1 WHERE origin_url IS NOT NULL) SELECT origin, count(*) AS n, count(DISTINCT claim_key) AS claims, count(DISTINCT site) AS sites FROM o WHERE origin IS NOT NULL GROUP BY 1",
    "time_fit": _W + f", e AS (SELECT evidence_id, claim_key, {_YEAR.format('published_at')} AS y FROM e1), c AS (SELECT claim_key, {_YEAR.format('date_start')} AS a, {_YEAR.format('date_end')} AS b FROM c1) SELECT evidence_id, CAST(y AS BIGINT) AS year FROM e JOIN c USING (claim_key) WHERE y BETWEEN a - 1 AND coalesce(b, a) + 1",
    "publisher_is_party": _W + f"SELECT evidence_id, e1.claim_key FROM e1 JOIN c1 ON e1.claim_key = c1.claim_key AND {_COMPACT.format('e1.publisher')} = {_COMPACT.format("entities['org']")} WHERE trim(publisher) <> '' AND {_COMPACT.format('e1.publisher')} <> ''",
    "element_gaps": _WV + ", x AS (SELECT category, vv.unproved, unnest(c1.elements) AS e FROM c1 JOIN vv USING (claim_key)) SELECT category, string_split(e, '=')[1] AS field, count(*) AS stated, count(*) FILTER (list_contains(string_split(unproved, '；'), e)) AS open FROM x GROUP BY 1, 2",
    "report_context": _W + f"SELECT report_id, array_to_string(list_sort(coalesce(list(DISTINCT entities['org']) FILTER (trim(entities['org']) <> ''), [])), '；') AS institutions, array_to_string(list_sort(coalesce(list(DISTINCT CAST({_YEAR.format('date_start')} AS VARCHAR)) FILTER (category = '学历' AND {_YEAR.format('date_start')} IS NOT NULL), [])), ',') AS education_years FROM c1 WHERE report_id IS NOT NULL GROUP BY 1",
}
