"""Queries on accounts, sessions, requests, settings, links, tables and statements, and the SQL that checks them.

The test data has no accounts. Where a query needs a table it does not hold, a stand-in with
the columns of the operator is made from whole TPC-H-like tables; its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.catalog import _COMPACT, _W, _claims, _evidence, _hits, _reports
from veristrata.functions import parsing as P
from veristrata.functions import text as T
from veristrata.functions import urls as U
from veristrata.operators import accounts as A
from veristrata.operators import joins as J
from veristrata.operators import layout as L
from veristrata.operators import ranking as R
from veristrata.sources import documents as D
from veristrata.tables import broadcast_if_small, table

NOW = "1999-06-05 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def users(s: SparkSession, d: str) -> DataFrame:
    """Stand-in from ``customer``: user_id, login, role, enabled, quota_total (-1 without a limit), quota_used."""
    return table(s, d, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("login"), F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"), (F.col("c_acctbal") >= 0).alias("enabled"),
        F.when(F.col("c_acctbal") > 9000, F.lit(-1)).otherwise(F.floor(F.abs("c_acctbal") / 500)).cast("bigint").alias("quota_total"), (F.col("c_custkey") % 7).alias("quota_used"),
    )


def sessions(s: SparkSession, d: str) -> DataFrame:
    """Stand-in from ``orders``: token, user_id, created_at, expires_at."""
    at = F.col("o_orderdate").cast("timestamp_ntz")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"), at.alias("created_at"), A.expiry(at).alias("expires_at"))


def requests(s: SparkSession, d: str) -> DataFrame:
    """Stand-in from ``orders``: request_id, user_id, amount, status, created_at."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    return table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.floor(F.col("o_totalprice") / 100000).cast("bigint").alias("amount"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))


def users_admins_first(s, d):
    return A.admins_first(users(s, d)).select("user_id", "role")


def quota_raised(s, d):
    """Quotas after all approved requests; unlimited ones stay so."""
    more = requests(s, d).where("status = 'approved'").groupBy("user_id").agg(F.sum("amount").alias("more"))
    return users(s, d).join(more, "user_id", "left").select("user_id", A.raised(F.col("quota_total"), F.coalesce("more", F.lit(0).cast("bigint"))).cast("bigint").alias("quota_total"))


def quota_after(s, d):
    """Takes that pass, and what is used after them and the refunds of rejected ones."""
    zero = F.lit(0).cast("bigint")
    n = requests(s, d).groupBy("user_id").agg(F.count("*").alias("asked"), F.count_if(F.col("status") == "rejected").alias("back"))
    u = users(s, d).join(n, "user_id", "left").withColumn("passed", A.taken(F.col("quota_total"), F.col("quota_used"), F.coalesce("asked", zero)))
    return u.select("user_id", F.col("passed").cast("bigint").alias("passed"), A.refunded(F.col("quota_used") + F.col("passed"), F.coalesce("back", zero)).cast("bigint").alias("used_after"))


def session_users(s, d):
    return A.signed_in(sessions(s, d), users(s, d), _now()).select("token", "user_id", "login")


def session_purge(s, d):
    return A.to_purge(sessions(s, d), users(s, d), _now())


def open_counts(s, d):
    """Live sessions and pending requests, one row."""
    a = A.live(sessions(s, d), _now()).agg(F.count("*").alias("live_sessions"))
    return a.join(requests(s, d).agg(F.count_if(F.col("status") == "pending").alias("pending")))


def pending_guard(s, d):
    return A.one_pending(requests(s, d))


def requests_pending(s, d):
    return A.newest_requests(requests(s, d), users(s, d), "pending").select("request_id", "user_id", "user_name", "amount")


def requests_mine(s, d):
    return A.newest_of_user(requests(s, d)).select("user_id", "rank", "request_id", "status")


SETTINGS, SECRETS = ["click_0", "click_1", "view_0", "view_1", "purchase_0", "purchase_1"], ["click_0", "view_1", "purchase_1"]


def settings_shown(s, d):
    """Stand-in writes from ``events``: key by type and parity, some empty or unknown; secrets masked."""
    k = F.get_json_object("props", "$.k").cast("int")
    w = table(s, d, "events").select(F.concat_ws("_", "event_type", (F.col("event_id") % 2).cast("string")).alias("key"), F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("value-"), k.cast("string"))).alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return A.public_settings(A.current_settings(w, SETTINGS), SECRETS)


def access_kept(s, d):
    """Accesses of the last ten days before a moment, by day; stand-in from ``events``."""
    log = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("at"))
    return A.kept_since(log, "at", F.lit("2024-01-20 15:30:00").cast("timestamp_ntz"), 10).groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def cache_fresh(s, d):
    """Entries that still hold: successes 20 days, failures 3; stand-in from ``events``."""
    e = table(s, d, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("checked_at"), (F.col("event_type") != "error").alias("ok"))
    return A.fresh(e, "checked_at", "ok", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), 20, 3).groupBy("event_type").agg(F.count("*").alias("n"))


def login_found(s, d):
    """Logins typed in capitals; stand-in from ``customer``."""
    return A.by_login(table(s, d, "customer").select(F.upper("c_name").alias("typed")), users(s, d)).select("typed", "user_id")


def first_enabled(s, d):
    """Of each nation the first enabled account; stand-in from ``customer``."""
    return table(s, d, "customer").where("c_acctbal >= 0").groupBy("c_nationkey").agg(F.min_by("c_name", "c_custkey").alias("login"))


def user_search_key(s, d):
    """The first filled of an account's own key, its segment and a default; stand-in from ``customer``."""
    own = F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).when(F.col("c_custkey") % 3 == 1, F.lit("")).otherwise(F.col("c_name"))
    return table(s, d, "customer").select("c_custkey", A.first_filled(own, F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.lit("default")).alias("key"))


def access_paths(s, d):
    """Paths of addresses as an access log holds them, at most 300 characters."""
    p = F.substring(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), 1, 300)
    return _hits(s, d).groupBy(p.alias("path")).agg(F.count("*").alias("n"))


def qualified_units(s, d):
    e = F.col("entities")
    return _claims(s, d).groupBy(P.qualified(e["org"], e["dept"]).alias("unit")).agg(F.count("*").alias("n"))


def query_variants(s, d):
    q = table(s, d, "search_hits").groupBy("query_text").agg(F.max("venue").alias("extra"))
    return q.where("query_text is not null").select("query_text", F.array_join(P.rephrased(F.col("query_text"), F.col("extra")), " | ").alias("variants"))


def candidate_forms(s, d):
    return _reports(s, d).select("report_id", F.array_join(P.name_forms(F.col("candidate_name")), " | ").alias("forms"))


def repository_links(s, d):
    """Addresses of a code host taken apart; the addresses are made of ``part``, some of other hosts or broken."""
    k = F.col("p_partkey").cast("string")
    base = F.concat(F.lit("https://github.com/owner-"), k)
    forms = F.array(base, F.concat(base, F.lit("/tool.git")), F.concat(base, F.lit("/tool/pull/"), k, F.lit("/files")), F.concat(base, F.lit("/tool/commit/abcdef"), F.lpad(k, 6, "0"), F.lit("；")), F.concat(base, F.lit("/tool/issues/"), k), F.concat(F.lit("https://example.org/owner/"), k))
    return table(s, d, "part").select("p_partkey", P.repository(F.element_at(forms, (F.col("p_partkey") % 6 + 1).cast("int"))).alias("r")).where("r is not null").select("p_partkey", "r.kind", "r.repo", "r.id")


def header_values(s, d):
    return _evidence(s, d).where("publisher is not null").groupBy(P.fits_latin1(F.col("publisher")).alias("fits")).agg(F.count("*").alias("n"))


def numerals(s, d):
    """Numbers of events in Chinese numerals."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(s, d, "events").groupBy(P.chinese_number(k).alias("numeral")).agg(F.count("*").alias("n"), F.min(k).alias("least"))


def autumn_claims(s, d):
    """Claims that begin in the autumn before their report's first year of education."""
    c = _claims(s, d).where("report_id is not null")
    y = c.where("category = '学历'").groupBy("report_id").agg(F.min(T.first_year(F.col("date_start"))).alias("y")).where("y is not null")
    a, b = P.target_window(F.col("y"), -1, 9, 12)
    return c.join(y, "report_id").where((F.trim("date_start") >= a) & (F.trim("date_start") <= b)).select("claim_key", "y")


def model_json(s, d):
    """JSON out of texts as a model writes them; the texts are made of ``events``."""
    p, n = F.col("props"), F.col("event_id") % 4
    text = F.when(n == 0, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n```\nDone."))).when(n == 1, F.concat(F.lit("The answer is "), p, F.lit(" as asked."))).when(n == 2, p).otherwise(F.lit("no answer {"))
    j = P.json_in(text)
    return table(s, d, "events").select("event_type", F.get_json_object(j, "$.k").cast("int").alias("k"), j.isNotNull().alias("found")).groupBy("event_type", "found").agg(F.count("*").alias("n"), F.sum("k").cast("bigint").alias("k"))


def archive_pages(s, d):
    """The first three pages of each site's archive, forward, moved by one, or counted from the last."""
    n = F.length("site") % 3
    a = table(s, d, "sites").select("site", F.concat(F.lit("https://"), "site", F.lit("/list.htm")).alias("first"), F.concat(F.lit("https://"), "site", F.lit("/list{page}.htm")).alias("template"), F.when(n == 2, "reverse").otherwise("forward").alias("order"), F.when(n == 1, -1).otherwise(0).alias("offset"), (F.length("site") + 10).alias("total"))
    return a.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page")).select("site", "page", P.page_url(F.col("first"), F.col("template"), F.col("page"), F.col("order"), F.col("offset"), F.col("total")).alias("url"))


def page_totals(s, d):
    """What list pages state about their number of pages, in five wordings; the pages are made of ``part``."""
    n = F.col("p_partkey").cast("string")
    html = F.element_at(F.array(F.concat(F.lit("<i>共&nbsp;"), n, F.lit(" 页</i>")), F.concat(F.lit("共89条，分"), n, F.lit("页")), F.concat(F.lit("共71条，"), n, F.lit("页，当前第 1 页")), F.concat(F.lit("共55条 1/"), n), F.concat(F.lit("all_pages=\"x\">"), n, F.lit("<")), F.lit("第 3 篇")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", P.declared_pages(html).alias("pages"))


def company_named(s, d):
    """The organisation of a claim where its text names it."""
    unit = T.element_value(F.try_element_at(F.filter("elements", lambda e: T.element_field(e) == "单位"), F.lit(1)))
    c = _claims(s, d).select("claim_key", P.named_in_text([F.col("entities")["org"], unit], F.col("raw_text")).alias("company"))
    return c.where("company is not null")


def claim_schools(s, d):
    """The school a claim names itself, or its organisation where that is a known name."""
    known = table(s, d, "known_names").where("kind = 'org'").select(F.col("full_name").alias("org")).distinct()
    e = F.col("entities")
    c = _claims(s, d).select("claim_key", F.trim(e["org"]).alias("org"), e["school"].alias("school"), e["university"].alias("university"))
    j = c.join(broadcast_if_small(known.withColumn("named", F.col("org"))), "org", "left")
    return j.select("claim_key", P.school_of([F.col("school"), F.col("university")], F.col("named")).alias("school")).where("school is not null")


def wrapped_risks(s, d):
    return table(s, d, "input_risks").where("excerpt is not null").select("risk_id", P.wrapped(F.col("excerpt")).alias("text")).distinct()


def venue_sites(s, d):
    return _hits(s, d).groupBy(P.publication_site(F.col("venue")).alias("archive")).agg(F.count("*").alias("n"))


def contacts_valid(s, d):
    c = table(s, d, "contact_routes").select("route_id", "source_url", "excerpt", F.posexplode("contacts").alias("i", "c"))
    return c.select("route_id", "i", F.col("c.contact_type").alias("kind"), P.valid_contact(F.col("c.contact_type"), F.col("c.contact_value"), F.col("excerpt"), U.is_public(F.col("source_url"))).alias("valid"))


def claim_routes(s, d):
    """Routes that fit a claim: its category, and its institution where the route names some."""
    c = _claims(s, d).select("claim_key", "category", T.compact_letters(F.col("entities")["org"]).alias("k"))
    r = table(s, d, "contact_routes").select("route_id", F.explode("categories").alias("category"), F.transform("institution_names", T.compact_letters).alias("names"))
    named = r.where("names is not null and size(names) > 0").select("route_id", "category", F.explode("names").alias("k")).distinct()
    return J.route_match(c, named, r.where("names is null or size(names) = 0").select("route_id", "category").distinct())


def award_stage(s, d):
    """For awards the one level of education of their report whose years hold all of theirs."""
    y = lambda c: T.first_year(c)
    c = _claims(s, d).where("report_id is not null").select("claim_key", "report_id", "category", F.trim(F.col("entities")["org"]).alias("org"), F.col("entities")["level"].alias("level"), y(F.col("date_start")).alias("a"), F.coalesce(y(F.col("date_end")), y(F.col("date_start"))).alias("b"))
    edu = c.where("category = '学历' and level is not null and a < b").select("report_id", "level", F.col("a").alias("ea"), F.col("b").alias("eb"))
    return J.containing_one(c.where("category in ('竞赛', '奖学金', '校内荣誉') and a is not null").drop("level"), edu, ["report_id"], "claim_key", "level")


def merged_cells(s, d):
    """Award tables whose merged cells take the value above; the tables are made of ``lineitem``."""
    t = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).when(F.col("l_linenumber") % 3 == 2, F.lit(" ")).alias("award"))
    return L.carried(t, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "award").groupBy("award", "carried").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("bigint").alias("s"))


def claims_selected(s, d):
    """Claims of a selection, here those that have evidence; the others are skipped, none is unknown."""
    ids = _evidence(s, d).where("claim_key is not null").select("claim_key").distinct()
    known = _claims(s, d)
    return J.selection(known, ids.join(known.select("claim_key"), "claim_key", "left_semi"), "claim_key").select("claim_key", "selected")


def pages_followed(s, d):
    """Pages reached from evidence of the first tier over the origins that evidence names, in two steps at most, each at its first step."""
    start = _evidence(s, d).where("source_tier = 'A'").select(F.col("url").alias("page")).where("page is not null").distinct()
    edges = _evidence(s, d).where("origin_url is not null and trim(origin_url) <> ''").select(F.col("url").alias("src"), F.col("origin_url").alias("dst")).distinct()
    return J.followed(start, edges, 2).groupBy("step").agg(F.count("*").alias("n"))


PROFILES = [("student", ["学历", "竞赛", "奖学金"], ["实习"]), ("researcher", ["论文", "著作"], ["*"]), ("worker", ["任职"], ["*"]), ("maker", ["开源项目", "专利"], ["项目"])]


def profiles_matched(s, d):
    """Profiles whose conditions the categories of a report meet, the most specific first; a fallback where none does."""
    cats = _claims(s, d).where("report_id is not null").groupBy("report_id").agg(F.collect_set("category").alias("cats"))
    return J.profiles(cats, PROFILES).select("report_id", "place", "profile")


def domain_specs(s, d):
    """For each institution of the routes its first two domains with weighted searches."""
    r = table(s, d, "contact_routes").where("school_domain is not null").groupBy("institution", F.col("school_domain").alias("domain")).agg(F.min("route_id").alias("first"))
    two = R.top(r, ["institution"], ["first", "domain"], 2, "place")
    specs = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight")) for k, w in (("notice", 30), ("roster", 20), ("people", 10))])
    return two.select("institution", "domain", F.inline(specs), "place").select("institution", "domain", "kind", (F.col("weight") - F.col("place") + 1).cast("bigint").alias("weight"))


def links_scored(s, d):
    """Of each host the three titles most like a list of names, by their words and year."""
    t = F.coalesce(F.col("title"), F.lit(""))
    one = lambda p, w: F.when(t.rlike(p), w).otherwise(0)
    score = one("名单|公示", 8) + one("获奖|awards?", 5) + one("通知|notice", 2) - one("细则|办法", 6) + F.when(T.first_year(t).isNotNull(), 3).otherwise(0)
    h = _hits(s, d).withColumn("score", score.cast("bigint")).where("score > 0")
    return R.top(h, ["site"], [F.desc("score"), "hit_id"], 3).select("site", "rank", "hit_id", "score")


def notices_located(s, d):
    """Hits of a span of days whose title has one of the words."""
    h = table(s, d, "search_hits").where("hit_id is not null").groupBy("hit_id", "site", "title").agg(F.min("fetched_at").alias("first"))
    day = F.date_format("first", "yyyy-MM-dd")
    return h.where(day.between("2020-01-01", "2026-12-31") & F.col("title").rlike("公示|名单|获奖")).groupBy("site", day.alias("day")).agg(F.count("*").alias("n"))


def columns_ranked(s, d):
    """The title of a host that names its notices best: by the rank of the word, then how exact it is."""
    words = ["公示", "名单", "综述"]
    t = F.coalesce(F.col("title"), F.lit(""))
    rank = F.when(F.contains(t, F.lit(words[0])), 0).when(F.contains(t, F.lit(words[1])), 1).when(F.contains(t, F.lit(words[2])), 2)
    h = _hits(s, d).withColumn("place", (rank * 10 + F.least(F.length(t), F.lit(9))).cast("bigint")).where("place is not null")
    return R.top(h, ["site"], ["place", "title", "hit_id"], 1).select("site", "title", "place")


SOURCES = [("论文", "papers"), ("著作", "books"), ("竞赛", "contests"), ("学历", "schools"), ("任职", "firms")]


def query_sources(s, d):
    """The source that claims of a category are asked at; the general web for others; skipped categories are none."""
    routes = s.createDataFrame(SOURCES, "category string, source string")
    c = _claims(s, d).where("category is null or category not in ('实习', '开源项目')")
    return c.join(F.broadcast(routes), "category", "left").groupBy("category", F.coalesce("source", F.lit("web")).alias("source")).agg(F.count("*").alias("n"))


def routes_markdown(s, d):
    """A catalogue as Markdown by category: how many routes it has, and those that are verified."""
    r = table(s, d, "contact_routes").select("route_id", F.explode("categories").alias("category"), (F.trim(F.coalesce("verified_at", F.lit(""))) != "").alias("ok"))
    g = r.groupBy("category").agg(F.count("*").alias("n"), F.count_if("ok").alias("v"), F.array_sort(F.collect_list("route_id")).alias("ids"))
    return g.select("category", F.concat(F.lit("## "), "category", F.lit(" ("), F.col("v").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(")\n"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("- route "), i.cast("string"))), "\n")).alias("markdown"))


def batch_report(s, d):
    """A run over all hits: how many gave text, and why the others did not."""
    why = F.when(F.col("content").isNull(), "no content").when(F.trim("content") == "", "blank").when(F.length("content") < 40, "short").otherwise("ok")
    return _hits(s, d).groupBy("registry_sources", why.alias("outcome")).agg(F.count("*").alias("n")).groupBy("outcome").agg(F.sum("n").cast("bigint").alias("n"))


def file_kinds(s, d):
    """Files by their path and what it points at; the paths are made of ``part``."""
    paths = ["docs/a.md", "src/api/main.go", "tests/test_x.py", "a/Dockerfile", "web/components/x.vue", "train/loop.py", "img/a.png", "core/db/table.rs", "ci/run.sh", "scheduler/run.java", "a/b.spec.ts"]
    p = F.element_at(F.array(*[F.lit(x) for x in paths]), (F.col("p_partkey") % len(paths) + 1).cast("int"))
    return table(s, d, "part").select(p.alias("path")).groupBy("path", P.file_kind(F.col("path")).alias("kind"), P.path_hint(F.col("path")).alias("hint")).agg(F.count("*").alias("n"))


def registry_links(s, d):
    """Entries of company registers among addresses; the addresses are made of ``part``."""
    k = F.col("p_partkey").cast("string")
    forms = F.array(F.concat(F.lit("https://www.qcc.com/firm/a"), k, F.lit(".html")), F.concat(F.lit("http://www.qcc.com/firm/a"), k, F.lit(".html")), F.concat(F.lit("https://m.tianyancha.com/company/"), k, F.lit("/sifa")), F.concat(F.lit("https://qcc.com.evil.example/firm/"), k, F.lit(".html")))
    return table(s, d, "part").select("p_partkey", P.registry_of(F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int"))).alias("registry"))


SLUGS = [("awards", 0), ("news", 1), ("people", 2), ("list", 3), ("p", 9)]


def slugs_ranked(s, d):
    """Addresses by the rank of their last known path part; the parts are made of the names of hits' hosts."""
    url = F.concat(F.lit("https://a.example/"), F.substring_index("site", ".", 1), F.lit("/list"), F.col("hit_id").cast("string"), F.when(F.col("hit_id") % 2 == 0, F.lit("/")).otherwise(F.lit("x.htm")))
    return _hits(s, d).groupBy(P.slug_rank(url, SLUGS).alias("place")).agg(F.count("*").alias("n"))


def evidence_relevance(s, d):
    """How much of its claim a piece of evidence shows: the candidate's name, what the claim names, its elements, and words of announcements."""
    c = _claims(s, d).join(_reports(s, d).select("report_id", "candidate_name"), "report_id", "left").select("claim_key", "candidate_name", "entities", "elements")
    e = _evidence(s, d).select("evidence_id", "claim_key", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))).alias("blob"))
    return e.join(c, "claim_key").select("evidence_id", R.relevance(F.col("blob"), F.col("candidate_name"), F.col("entities"), F.col("elements")).alias("score"))


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _snapshot_pages(s, d) -> DataFrame:
    """Snapshots as HTML again: blocks by kind, some in small print, and hidden texts in three ways."""
    p = table(s, d, "homepage_snapshots").where("snapshot_id is not null").dropDuplicates(["snapshot_id"])
    tag = lambda t: F.when(t == "h", "h2").when(t == "li", "li").otherwise("p")
    shown = F.transform("blocks", lambda b, i: F.concat(F.lit("<"), tag(b["t"]), F.when(i % 2 == 0, F.lit(' style="font-size:0.9em; opacity:0.5">')).otherwise(F.lit(">")), _escaped(F.coalesce(b["text"], F.lit(""))), F.lit("</"), tag(b["t"]), F.lit(">")))
    how = F.array(*[F.lit(x) for x in ("font-size: 0px", "display:none", "position:absolute;left:-9999px")])
    hidden = F.transform(F.coalesce("hidden_texts", F.array().cast("array<string>")), lambda h, i: F.concat(F.lit('<div style="'), F.element_at(how, (i % 3 + 1).cast("int")), F.lit('">'), _escaped(h), F.lit("</div>")))
    return p.select(F.col("snapshot_id").alias("page_id"), F.concat(F.lit("<html><head><title>t</title></head><body>"), F.array_join(shown, ""), F.array_join(hidden, ""), F.lit("</body></html>")).alias("html"), F.lit("https://a.example/").alias("base"))


def html_blocks(s, d):
    """Blocks read from pages, by kind, whole, and hidden texts apart from them."""
    b = D.page_blocks(_snapshot_pages(s, d))
    return b.groupBy("page_id", "t").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def html_items(s, d):
    """Dated entries read from list pages, one page a host; the pages are made of hits."""
    h = table(s, d, "search_hits").where("hit_id is not null and title is not null").groupBy("hit_id", "site", "title").agg(F.min("fetched_at").alias("first"))
    item = F.concat(F.lit('<li><a href="/p/'), F.col("hit_id").cast("string"), F.lit('.htm">'), _escaped(F.col("title")), F.lit('</a> <a href="#">更多</a><span>'), F.date_format("first", "yyyy-MM-dd"), F.lit("</span></li>"))
    pages = h.select(F.col("hit_id").alias("page_id"), F.concat(F.lit("<ul>"), item, F.lit("</ul>")).alias("html"), F.concat(F.lit("https://"), "site", F.lit("/list.htm")).alias("base"))
    return D.page_items(pages)


def documents_focused(s, d):
    """Long documents cut to their head and the passages round the words of their first line."""
    t = table(s, d, "documents").where("text is not null").select("doc_id", "text", F.split(F.substring_index("text", "\n", 1), r"[\s，。；、]+").alias("terms"))
    return t.select("doc_id", F.length(P.focus(F.col("text"), F.col("terms"))).alias("chars")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        users_admins_first, quota_raised, quota_after, session_users, session_purge, open_counts, pending_guard, requests_pending, requests_mine, settings_shown, access_kept, cache_fresh, login_found, first_enabled, user_search_key, access_paths, qualified_units, query_variants, candidate_forms, repository_links,
        header_values, numerals, autumn_claims, model_json, archive_pages, page_totals, company_named, claim_schools, wrapped_risks, venue_sites, contacts_valid, claim_routes, award_stage, merged_cells, claims_selected, pages_followed, file_kinds, registry_links, slugs_ranked, evidence_relevance, html_blocks, html_items, profiles_matched, domain_specs, links_scored, notices_located, columns_ranked, query_sources, routes_markdown, batch_report, documents_focused,
    )
}

# ---------------------------------------------------------------- SQL

_USERS = "u AS (SELECT c_custkey AS user_id, c_name AS login, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role, c_acctbal >= 0 AS enabled, CAST(CASE WHEN c_acctbal > 9000 THEN -1 ELSE floor(abs(c_acctbal) / 500) END AS BIGINT) AS quota_total, c_custkey % 7 AS quota_used FROM customer)"
_SESS = "s AS (SELECT o_orderkey AS token, o_custkey AS user_id, o_orderdate AS created_at, o_orderdate + INTERVAL 7 DAY AS expires_at FROM orders)"
_REQ = "r AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, CAST(floor(o_totalprice / 100000) AS BIGINT) AS amount, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_orderdate AS created_at FROM orders)"
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_T = f"TIMESTAMP '{NOW}'"
_SAME = r"lower(translate(regexp_replace({0}, '[\s\p{{Z}}]+', '', 'g'), '()', '（）'))"
_OK = r"(length(trim({0})) BETWEEN 2 AND 160 AND NOT regexp_matches({0}, '[<>\n]|https?://') AND contains(own, " + _SAME + "))"
_YR = "CAST(nullif(regexp_extract({0}, '((?:19|20)[0-9]{{2}})', 1), '') AS INTEGER)"
_NUM = "CASE WHEN k < 1 OR k >= 100 THEN CAST(k AS VARCHAR) WHEN k < 10 THEN dg[k + 1] ELSE (CASE WHEN k >= 20 THEN dg[k // 10 + 1] ELSE '' END) || '十' || (CASE WHEN k % 10 <> 0 THEN dg[k % 10 + 1] ELSE '' END) END"
_PUBLIC = r"(lower(regexp_extract(source_url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) IN ('http', 'https') AND length(source_url) <= 2000 AND NOT contains(regexp_extract(source_url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@'))"
_WEB = "(SELECT DISTINCT url AS page FROM e1 WHERE url IS NOT NULL AND source_tier = 'A')"

ORACLE = {
    "users_admins_first": f"WITH {_USERS} SELECT user_id, role FROM u",
    "quota_raised": f"WITH {_USERS}, {_REQ}, m AS (SELECT user_id, CAST(sum(amount) AS BIGINT) AS more FROM r WHERE status = 'approved' GROUP BY 1) SELECT user_id, CASE WHEN quota_total < 0 THEN -1 ELSE quota_total + coalesce(more, 0) END AS quota_total FROM u LEFT JOIN m USING (user_id)",
    "quota_after": f"WITH {_USERS}, {_REQ}, m AS (SELECT user_id, count(*) AS asked, count(*) FILTER (status = 'rejected') AS back FROM r GROUP BY 1), x AS (SELECT *, CASE WHEN quota_total < 0 THEN coalesce(asked, 0) ELSE greatest(0, least(coalesce(asked, 0), quota_total - quota_used)) END AS passed FROM u LEFT JOIN m USING (user_id)) SELECT user_id, CAST(passed AS BIGINT) AS passed, CAST(greatest(0, quota_used + passed - coalesce(back, 0)) AS BIGINT) AS used_after FROM x",
    "session_users": f"WITH {_USERS}, {_SESS} SELECT token, user_id, login FROM s JOIN u USING (user_id) WHERE expires_at > {_T} AND enabled",
    "session_purge": f"WITH {_USERS}, {_SESS} SELECT token, CASE WHEN expires_at <= {_T} THEN 'expired' ELSE 'disabled' END AS reason FROM s JOIN u USING (user_id) WHERE expires_at <= {_T} OR NOT enabled",
    "open_counts": f"WITH {_SESS}, {_REQ} SELECT (SELECT count(*) FROM s WHERE expires_at > {_T}) AS live_sessions, (SELECT count(*) FROM r WHERE status = 'pending') AS pending",
    "pending_guard": f"WITH {_REQ} SELECT request_id, first_value(request_id) OVER (PARTITION BY user_id ORDER BY created_at, request_id) AS effective_id FROM r WHERE status = 'pending'",
    "requests_pending": f"WITH {_USERS}, {_REQ}, l AS (SELECT * FROM r WHERE status = 'pending' ORDER BY created_at DESC, request_id DESC LIMIT 200) SELECT request_id, user_id, login AS user_name, amount FROM l LEFT JOIN u USING (user_id)",
    "requests_mine": f"WITH {_REQ} SELECT user_id, CAST(n AS INTEGER) AS rank, request_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, request_id DESC) AS n FROM r) WHERE n <= 20",
    "settings_shown": f"WITH w AS (SELECT event_type || '_' || (event_id % 2) AS key, CASE WHEN {_K} % 5 = 0 THEN '' ELSE 'value-' || {_K} END AS value, ts, event_id FROM events), l AS (SELECT key, arg_max(value, {{'a': ts, 'b': event_id}}) AS value FROM w WHERE key IN ({', '.join(repr(x) for x in SETTINGS)}) GROUP BY 1) SELECT key, CASE WHEN key IN ({', '.join(repr(x) for x in SECRETS)}) THEN '••••••••' || right(value, 4) || ' (' || length(value) || ')' ELSE value END AS shown FROM l WHERE value <> ''",
    "access_kept": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1",
    "cache_fresh": "SELECT event_type, count(*) AS n FROM events WHERE ts + CASE WHEN event_type = 'error' THEN INTERVAL 3 DAY ELSE INTERVAL 20 DAY END > TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1",
    "login_found": f"WITH {_USERS} SELECT upper(c_name) AS typed, user_id FROM customer JOIN u ON lower(login) = lower(upper(c_name)) WHERE enabled",
    "first_enabled": "SELECT c_nationkey, arg_min(c_name, c_custkey) AS login FROM customer WHERE c_acctbal >= 0 GROUP BY 1",
    "user_search_key": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN c_name WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'default' END AS key FROM customer",
    "access_paths": _W + r" SELECT substr(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), 1, 300) AS path, count(*) AS n FROM h1 GROUP BY 1",
    "qualified_units": _W + ", x AS (SELECT trim(coalesce(entities['org'], '')) AS o, trim(coalesce(entities['dept'], '')) AS d FROM c1) SELECT CASE WHEN d = '' THEN o WHEN o = '' THEN d WHEN contains(o, d) THEN o WHEN contains(d, o) THEN d ELSE o || d END AS unit, count(*) AS n FROM x GROUP BY 1",
    "query_variants": r"""WITH q AS (SELECT query_text, max(venue) AS e0 FROM search_hits WHERE query_text IS NOT NULL GROUP BY 1), t AS (SELECT query_text, trim(coalesce(e0, '')) AS e, list_filter(regexp_split_to_array(trim(query_text), '\s+'), lambda x: x <> '') AS t FROM q),
b AS (SELECT *, list_transform(t, lambda x: trim(trim(x, '"'), '''')) AS b FROM t),
v AS (SELECT query_text, [CASE WHEN len(t) >= 2 THEN array_to_string(list_filter(list_concat(t[2:], t[1:1]), lambda x: x <> ''), ' ') END, CASE WHEN len(t) >= 2 THEN array_to_string(list_filter(list_concat(b[2:], b[1:1]), lambda x: x <> ''), ' ') END, array_to_string(list_filter(b, lambda x: x <> ''), ' '), CASE WHEN e <> '' AND NOT list_contains(t, e) THEN array_to_string(list_append(t, e), ' ') END] AS v FROM b),
x AS (SELECT query_text, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM v), y AS (SELECT query_text, v, min(i) AS i FROM x WHERE v IS NOT NULL AND v <> '' AND v <> query_text GROUP BY 1, 2)
SELECT query_text, coalesce(vs, '') AS variants FROM q LEFT JOIN (SELECT query_text, string_agg(v, ' | ' ORDER BY i) AS vs FROM y GROUP BY 1) USING (query_text)""",
    "candidate_forms": _W + r""", x AS (SELECT report_id, trim(coalesce(candidate_name, '')) AS v FROM r1), y AS (SELECT *, array_to_string(regexp_extract_all(v, '[\x{3400}-\x{9fff}]{2,}'), '') AS zh, trim(trim(regexp_replace(array_to_string(regexp_extract_all(v, '[A-Za-z][A-Za-z.''-]*(?:\s+[A-Za-z][A-Za-z.''-]*)*'), ' '), '\s+', ' ', 'g')), ' ./|') AS la FROM x) SELECT report_id, CASE WHEN v = '' THEN '' WHEN zh <> '' AND la <> '' THEN zh || ' | ' || la ELSE v END AS forms FROM y""",
    "repository_links": "SELECT p_partkey, ['account', 'repo', 'pr', 'commit'][p_partkey % 6 + 1] AS kind, CASE WHEN p_partkey % 6 > 0 THEN 'tool' END AS repo, CASE p_partkey % 6 WHEN 2 THEN CAST(p_partkey AS VARCHAR) WHEN 3 THEN 'abcdef' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') END AS id FROM part WHERE p_partkey % 6 < 4",
    "header_values": _W + r" SELECT NOT regexp_matches(publisher, '[^\x00-\x{FF}]') AS fits, count(*) AS n FROM e1 WHERE publisher IS NOT NULL GROUP BY 1",
    "numerals": f"WITH x AS (SELECT {_K} AS k, ['零', '一', '二', '三', '四', '五', '六', '七', '八', '九'] AS dg FROM events) SELECT {_NUM} AS numeral, count(*) AS n, min(k) AS least FROM x GROUP BY 1",
    "autumn_claims": _W + f", y AS (SELECT report_id, min({_YR.format('date_start')}) AS y FROM c1 WHERE category = '学历' AND report_id IS NOT NULL GROUP BY 1) SELECT claim_key, y FROM c1 JOIN y USING (report_id) WHERE y IS NOT NULL AND trim(date_start) >= lpad(CAST(y - 1 AS VARCHAR), 4, '0') || '-09-01' AND trim(date_start) <= lpad(CAST(y - 1 AS VARCHAR), 4, '0') || '-12-31'",
    "model_json": f"SELECT event_type, event_id % 4 <> 3 AS found, count(*) AS n, CAST(sum(CASE WHEN event_id % 4 <> 3 THEN {_K} END) AS BIGINT) AS k FROM events GROUP BY 1, 2",
    "archive_pages": "SELECT site, p AS page, CASE WHEN p = 1 THEN 'https://' || site || '/list.htm' ELSE 'https://' || site || '/list' || CASE length(site) % 3 WHEN 2 THEN length(site) + 10 - p + 1 WHEN 1 THEN p - 1 ELSE p END || '.htm' END AS url FROM sites, (SELECT unnest([1, 2, 3]) AS p)",
    "page_totals": "SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 OR p_partkey = 0 OR p_partkey >= 5000 THEN NULL ELSE CAST(p_partkey AS INTEGER) END AS pages FROM part",
    "company_named": _W + f", x AS (SELECT claim_key, entities['org'] AS a, CASE WHEN contains(el, '=') THEN substr(el, instr(el, '=') + 1) END AS b, {_SAME.format('raw_text')} AS own FROM (SELECT *, list_filter(elements, lambda e: string_split(e, '=')[1] = '单位')[1] AS el FROM c1)) SELECT claim_key, CASE WHEN {_OK.format('a')} THEN trim(a) WHEN {_OK.format('b')} THEN trim(b) END AS company FROM x WHERE {_OK.format('a')} OR {_OK.format('b')}",
    "claim_schools": _W + " SELECT claim_key, trim(entities['org']) AS school FROM c1 WHERE trim(entities['org']) IN (SELECT full_name FROM known_names WHERE kind = 'org')",
    "wrapped_risks": f"SELECT DISTINCT risk_id, '{P.BEFORE}' || excerpt || '{P.AFTER}' AS text FROM input_risks WHERE excerpt IS NOT NULL",
    "venue_sites": _W + r""", x AS (SELECT lower(trim(regexp_replace(coalesce(venue, ''), '\s+', ' ', 'g'))) AS v FROM h1) SELECT CASE WHEN regexp_matches(v, '\b(?:neurips|nips)\b|neural information processing systems') THEN 'proceedings.neurips.cc' WHEN regexp_matches(v, '\b(?:naacl|emnlp|acl)\b|association for computational linguistics') THEN 'aclanthology.org' WHEN regexp_matches(v, '\bicml\b|international conference on machine learning') THEN 'proceedings.mlr.press' END AS archive, count(*) AS n FROM x GROUP BY 1""",
    "contacts_valid": rf"""WITH c AS (SELECT route_id, source_url, coalesce(excerpt, '') AS shown, unnest(contacts) AS c, generate_subscripts(contacts, 1) - 1 AS i FROM contact_routes), x AS (SELECT *, c.contact_type AS kind, trim(coalesce(c.contact_value, '')) AS v FROM c), y AS (SELECT *, regexp_replace(v, '\D', '', 'g') AS dg FROM x)
SELECT route_id, CAST(i AS INTEGER) AS i, kind, coalesce({_PUBLIC} AND (contains(shown, v) OR (kind = 'phone' AND length(dg) >= 8 AND contains(regexp_replace(shown, '\D', '', 'g'), ltrim(dg, '0')))) AND CASE kind WHEN 'email' THEN regexp_full_match(v, '[\w.+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') WHEN 'phone' THEN regexp_full_match(v, '[+\d() -]{{8,32}}') AND length(dg) BETWEEN 8 AND 15 ELSE FALSE END, FALSE) AS valid FROM y""",
    "claim_routes": _W + f", r AS (SELECT route_id, unnest(categories) AS category, list_transform(institution_names, lambda x: {_COMPACT.format('x')}) AS names FROM contact_routes) SELECT DISTINCT claim_key, route_id FROM c1 JOIN r ON c1.category = r.category WHERE names IS NULL OR len(names) = 0 OR list_contains(names, {_COMPACT.format(chr(39).join(['entities[', 'org', ']']))})",
    "award_stage": _W + f", x AS (SELECT claim_key, report_id, category, trim(entities['org']) AS org, entities['level'] AS level, {_YR.format('date_start')} AS a, coalesce({_YR.format('date_end')}, {_YR.format('date_start')}) AS b FROM c1 WHERE report_id IS NOT NULL), e AS (SELECT * FROM x WHERE category = '学历' AND level IS NOT NULL AND a < b), w AS (SELECT * FROM x WHERE category IN ('竞赛', '奖学金', '校内荣誉') AND a IS NOT NULL) SELECT w.claim_key, min(e.level) AS level FROM w JOIN e ON w.report_id = e.report_id AND e.a <= w.a AND w.b <= e.b GROUP BY 1 HAVING count(DISTINCT e.level) = 1",
    "merged_cells": "WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag END AS a FROM lineitem), f AS (SELECT l_linenumber, a IS NULL AS carried, last_value(a IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS award FROM t) SELECT award, carried, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM f WHERE award IS NOT NULL GROUP BY 1, 2",
    "claims_selected": _W + " SELECT claim_key, claim_key IN (SELECT claim_key FROM e1 WHERE claim_key IS NOT NULL) AS selected FROM c1",
    "pages_followed": _W + f", g AS (SELECT DISTINCT url AS src, origin_url AS dst FROM e1 WHERE origin_url IS NOT NULL AND trim(origin_url) <> ''), s0 AS {_WEB}, s1 AS (SELECT DISTINCT dst AS page FROM s0 JOIN g ON page = src WHERE dst NOT IN (SELECT page FROM s0)), s2 AS (SELECT DISTINCT dst AS page FROM s1 JOIN g ON page = src WHERE dst NOT IN (SELECT page FROM s0) AND dst NOT IN (SELECT page FROM s1)) SELECT step, n FROM (SELECT 0 AS step, count(*) AS n FROM s0 UNION ALL SELECT 1, count(*) FROM s1 UNION ALL SELECT 2, count(*) FROM s2) WHERE n > 0",
    "file_kinds": f"WITH t(o, path, kind, hint) AS (VALUES (0, 'docs/a.md', '{P.DOCUMENT}', '文档/说明材料'), (1, 'src/api/main.go', '{P.CODE}', '服务/接口命名路径（具体职责须结合 diff 复核）'), (2, 'tests/test_x.py', '{P.TEST}', '仅凭路径不能确认技术领域'), (3, 'a/Dockerfile', '{P.BUILD}', '构建或配置路径'), (4, 'web/components/x.vue', '{P.CODE}', '界面相关命名路径（具体职责须结合 diff 复核）'), (5, 'train/loop.py', '{P.CODE}', '训练相关命名路径（具体职责须结合 diff 复核）'), (6, 'img/a.png', '{P.OTHER}', '仅凭路径不能确认技术领域'), (7, 'core/db/table.rs', '{P.CODE}', '存储/数据库命名路径（具体职责须结合 diff 复核）'), (8, 'ci/run.sh', '{P.BUILD}', '构建或配置路径'), (9, 'scheduler/run.java', '{P.CODE}', '运行时/调度/推理命名路径（具体职责须结合 diff 复核）'), (10, 'a/b.spec.ts', '{P.TEST}', '仅凭路径不能确认技术领域')) SELECT path, kind, hint, count(*) AS n FROM part JOIN t ON p_partkey % 11 = o GROUP BY 1, 2, 3",
    "registry_links": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '企查查' WHEN 2 THEN '天眼查' ELSE '' END AS registry FROM part",
    "slugs_ranked": _W + r", x AS (SELECT list_transform(list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '\.(?:s?html?|jsp|php|aspx?)$', ''), '\d+$', '')) AS p FROM (SELECT 'https://a.example/' || string_split(site, '.')[1] || '/list' || hit_id || CASE WHEN hit_id % 2 = 0 THEN '/' ELSE 'x.htm' END AS url FROM h1)), m AS (SELECT MAP {'awards': 0, 'news': 1, 'people': 2, 'list': 3, 'p': 9} AS m) SELECT coalesce(m[p[len(p)]], CASE WHEN len(p) > 1 THEN m[p[len(p) - 1]] END) AS place, count(*) AS n FROM x, m GROUP BY 1",
    "evidence_relevance": _W + r""", x AS (SELECT evidence_id, coalesce(e1.title, '') || ' ' || coalesce(snippet, '') AS blob, candidate_name, entities, c1.elements FROM e1 JOIN c1 USING (claim_key) LEFT JOIN (SELECT report_id, candidate_name FROM r1) USING (report_id))
SELECT evidence_id, CAST(3 * len(list_filter(regexp_split_to_array(trim(coalesce(candidate_name, '')), '\s+'), lambda w: length(w) >= 2 AND contains(blob, w))) + 2 * len(list_filter(['org', 'award', 'contest', 'dept', 'role', 'title'], lambda k: length(entities[k]) >= 2 AND contains(blob, entities[k])))
 + len(list_filter(coalesce(elements, []), lambda e: length(CASE WHEN contains(e, '=') THEN substr(e, instr(e, '=') + 1) ELSE e END) >= 2 AND contains(blob, CASE WHEN contains(e, '=') THEN substr(e, instr(e, '=') + 1) ELSE e END))) + CASE WHEN regexp_matches(blob, '公示|名单|获奖|通知|公告|录取|授予|表彰') THEN 1 ELSE 0 END AS BIGINT) AS score FROM x""",
    "html_blocks": r"""WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY fetched_at) AS rn FROM homepage_snapshots WHERE snapshot_id IS NOT NULL) WHERE rn = 1), b AS (SELECT snapshot_id, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS i FROM p),
x AS (SELECT snapshot_id, i, CASE WHEN b.t IN ('h', 'li') THEN b.t ELSE 'p' END AS t, trim(regexp_replace(coalesce(b.text, ''), '[\s\p{Z}]+', ' ', 'g')) AS text FROM b), y AS (SELECT *, lag({'t': t, 'x': text}) OVER (PARTITION BY snapshot_id ORDER BY i) AS before FROM x WHERE text <> ''),
h AS (SELECT snapshot_id, unnest(hidden_texts) AS text FROM p), z AS (SELECT snapshot_id, t, text FROM y WHERE before IS NULL OR before <> {'t': t, 'x': text} UNION ALL SELECT snapshot_id, 'hidden', trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) FROM h WHERE trim(text) <> '')
SELECT snapshot_id AS page_id, t, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM z GROUP BY 1, 2""",
    "html_items": _W + r" SELECT hit_id AS page_id, 'https://' || site || '/p/' || hit_id || '.htm' AS url, trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')) AS title, strftime(fetched_at, '%Y-%m-%d') AS day FROM h1 WHERE length(trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g'))) >= 6 AND fetched_at IS NOT NULL AND site IS NOT NULL",
    "profiles_matched": _W + """, c AS (SELECT report_id, list(DISTINCT category) AS cats FROM c1 WHERE report_id IS NOT NULL GROUP BY 1), p AS (SELECT * FROM (VALUES ('student', ['学历', '竞赛', '奖学金'], ['实习'], 2, 0), ('researcher', ['论文', '著作'], ['*'], 1, 1), ('worker', ['任职'], ['*'], 1, 2), ('maker', ['开源项目', '专利'], ['项目'], 2, 3)) t(profile, a, b, w, o)),
m AS (SELECT report_id, profile, row_number() OVER (PARTITION BY report_id ORDER BY w DESC, o) AS place FROM c, p WHERE list_has_any(cats, a) AND (b[1] = '*' OR list_has_any(cats, b)))
SELECT report_id, CAST(place AS INTEGER) AS place, profile FROM m UNION ALL SELECT report_id, 1, 'fallback' FROM c WHERE report_id NOT IN (SELECT report_id FROM m)""",
    "domain_specs": "WITH r AS (SELECT institution, school_domain AS domain, min(route_id) AS f FROM contact_routes WHERE school_domain IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY institution ORDER BY f, domain) AS place FROM r) SELECT institution, domain, kind, CAST(weight - place + 1 AS BIGINT) AS weight FROM t, (VALUES ('notice', 30), ('roster', 20), ('people', 10)) s(kind, weight) WHERE place <= 2",
    "links_scored": _W + ", x AS (SELECT *, coalesce(title, '') AS t FROM h1), y AS (SELECT *, CAST(CASE WHEN regexp_matches(t, '名单|公示') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(t, '获奖|awards?') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(t, '通知|notice') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(t, '细则|办法') THEN 6 ELSE 0 END + CASE WHEN regexp_matches(t, '(19|20)[0-9]{2}') THEN 3 ELSE 0 END AS BIGINT) AS score FROM x) SELECT site, CAST(n AS INTEGER) AS rank, hit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, hit_id) AS n FROM y WHERE score > 0) WHERE n <= 3",
    "notices_located": _W + " SELECT site, strftime(fetched_at, '%Y-%m-%d') AS day, count(*) AS n FROM h1 WHERE strftime(fetched_at, '%Y-%m-%d') BETWEEN '2020-01-01' AND '2026-12-31' AND regexp_matches(title, '公示|名单|获奖') GROUP BY 1, 2",
    "columns_ranked": _W + ", x AS (SELECT *, coalesce(title, '') AS t FROM h1), y AS (SELECT *, CAST(CASE WHEN contains(t, '公示') THEN 0 WHEN contains(t, '名单') THEN 10 WHEN contains(t, '综述') THEN 20 END + least(length(t), 9) AS BIGINT) AS place FROM x) SELECT site, title, place FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place, title, hit_id) AS n FROM y WHERE place IS NOT NULL) WHERE n = 1",
    "query_sources": _W + ", s AS (SELECT * FROM (VALUES ('论文', 'papers'), ('著作', 'books'), ('竞赛', 'contests'), ('学历', 'schools'), ('任职', 'firms')) t(category, source)) SELECT c1.category, coalesce(source, 'web') AS source, count(*) AS n FROM c1 LEFT JOIN s ON c1.category = s.category WHERE c1.category IS NULL OR c1.category NOT IN ('实习', '开源项目') GROUP BY 1, 2",
    "routes_markdown": "WITH r AS (SELECT route_id, unnest(categories) AS category, trim(coalesce(verified_at, '')) <> '' AS ok FROM contact_routes) SELECT category, '## ' || category || ' (' || count(*) FILTER (ok) || '/' || count(*) || ')' || chr(10) || string_agg('- route ' || route_id, chr(10) ORDER BY route_id) AS markdown FROM r GROUP BY category",
    "batch_report": _W + " SELECT CASE WHEN content IS NULL THEN 'no content' WHEN trim(content) = '' THEN 'blank' WHEN length(content) < 40 THEN 'short' ELSE 'ok' END AS outcome, count(*) AS n FROM h1 GROUP BY 1",
}
