"""The queries on text for training data, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristrata.llm import boilerplate, leaks, lookalike, names, packing, personal, residue, stuffing, surrogates
from veristrata.tables import cut, table


def _texts(spark: SparkSession, folder: str, **fields: tuple[str, str]) -> DataFrame:
    """(tab, row_id, text) of the named tables: ``table=(key, field)``."""
    parts = [table(spark, folder, t).select(F.lit(t).alias("tab"), F.col(k).alias("row_id"), F.col(f).alias("text")) for t, (k, f) in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, claims=("claim_key", "raw_text"), evidence=("evidence_id", "snippet"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _statements(spark, folder)
    return lookalike.twins(rows, lookalike.rewriter(rows.select("text")))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each text with its class of texts that look the same."""
    rows = _statements(spark, folder)
    return lookalike.classed(rows, lookalike.rewriter(rows.select("text"))).select("tab", "row_id", "class_id", "n_rows", "n_spellings", "n_links").distinct()


def p2_form(spark: SparkSession, folder: str) -> DataFrame:
    """Each text in its one form."""
    rows = _statements(spark, folder)
    formed = lookalike.consistent(rows, lookalike.rewriter(rows.select("text")))
    return formed.where("form is not null").groupBy("tab", "row_id").agg(F.max("form").alias("form"))


def _contents(spark: SparkSession, folder: str) -> DataFrame:
    """(tab, row_id, host, title, text) of search_hits."""
    return table(spark, folder, "search_hits").select(F.lit("search_hits").alias("tab"), F.col("hit_id").alias("row_id"), F.col("site").alias("host"), "title", F.col("content").alias("text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    ev = table(spark, folder, "evidence").select(F.lit("evidence").alias("tab"), F.col("evidence_id").alias("row_id"), F.col("site").alias("host"), F.lit(None).cast("string").alias("title"), F.col("snippet").alias("text"))
    return residue.exclude(_contents(spark, folder).unionByName(ev))


def _personal_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder, claims=("claim_key", "raw_text"), evidence=("evidence_id", "snippet"), input_risks=("risk_id", "excerpt"))


def surrogate_key(spark: SparkSession) -> bytes:
    """The key of the surrogates: ``spark.veristrata.surrogate.key`` of the session; the default is for trials alone."""
    return spark.conf.get("spark.veristrata.surrogate.key", "no secret: trials alone").encode()


def _replaced_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each item of a row with the surrogate that replaces it."""
    found = cut(personal.items(_personal_texts(spark, folder)))
    return found.join(surrogates.surrogates(found, surrogate_key(spark)), ["kind", "found_text"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _replaced_items(spark, folder).select("tab", "row_id", "kind", "found_text")


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that had items, with placeholders."""
    done = personal.redacted(_personal_texts(spark, folder))
    return done.where("redacted rlike '\\\\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\\\\]'").groupBy("tab", "row_id").agg(F.max("redacted").alias("redacted"))


def p5_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """The keyed replacement of each distinct spelling of an item, and the entity it spells."""
    return surrogates.surrogates(personal.items(_personal_texts(spark, folder)), surrogate_key(spark))


def p5_surrogate_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Surrogates that stand for several entities, entities with several, and surrogates that still tell their item: none of each."""
    return surrogates.checks(cut(p5_surrogates(spark, folder)))


def p5_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that had items, with surrogates in their places."""
    texts = _personal_texts(spark, folder)
    return personal.written(texts, p5_surrogates(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = _contents(spark, folder)
    gone = residue.exclude(hits)
    pages = hits.where("text is not null").select("tab", "row_id", "host", "title", F.split("text", "\n").alias("lines"))
    snaps = table(spark, folder, "homepage_snapshots").select(F.lit("homepage_snapshots").alias("tab"), F.col("snapshot_id").alias("row_id"), F.lower(F.regexp_extract(F.coalesce("final_url", "url"), "^[a-z]+://([^/:?#]+)", 1)).alias("host"), "title", F.col("blocks.text").alias("lines"))
    return boilerplate.remove(pages.unionByName(snaps)).join(gone, ["tab", "row_id"], "left_anti").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    cell = lambda field, kind, value: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), value.alias("value"))
    c = table(spark, folder, "claims").select(F.lit("claims").alias("tab"), F.col("claim_key").alias("row_id"), F.explode(F.array(cell("org", "org", F.col("entities")["org"]), cell("advisor", "person", F.col("entities")["advisor"]))).alias("x"))
    e = table(spark, folder, "evidence").select(F.lit("evidence").alias("tab"), F.col("evidence_id").alias("row_id"), cell("publisher", "org", F.col("publisher")).alias("x"))
    r = table(spark, folder, "contact_routes").select(F.lit("contact_routes").alias("tab"), F.col("route_id").alias("row_id"), F.explode("institution_names").alias("name")).select("tab", "row_id", cell("institution_names", "org", F.col("name")).alias("x"))
    return names.link(c.unionByName(e).unionByName(r).select("tab", "row_id", "x.field", "x.kind", "x.value"), table(spark, folder, "known_names"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.count_tokens(table(spark, folder, "documents")))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row: containers over capacity, texts not placed whole, texts split that would fit, places taken twice, and containers beyond the least that the tokens need."""
    counted = cut(packing.count_tokens(table(spark, folder, "documents")))
    packed = cut(packing.pack(counted))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.count_distinct("position").alias("p"))
    a = full.agg(F.count_if(F.col("t") > packing.CAPACITY).alias("overfull"), F.count_if(F.col("n") != F.col("p")).alias("clashes"), (F.count("*") - F.ceil(F.sum("t") / packing.CAPACITY)).cast("bigint").alias("beyond_least"))
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("pieces"))
    once = counted.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("most"), F.count("*").alias("rows"))
    b = once.join(whole, "doc_id", "left").agg(F.count_if(F.coalesce("t", F.lit(-1)) != F.col("n_tokens")).alias("incomplete"), F.count_if((F.col("most") <= packing.CAPACITY) & (F.col("pieces") > F.col("rows"))).alias("split"))
    return a.join(b)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))


def p9_proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Also passages with a word or two changed, added or left out."""
    return leaks.proximity(table(spark, folder, "documents"), table(spark, folder, "benchmark_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.found(table(spark, folder, "documents"))


def p10_measures(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.measures(table(spark, folder, "documents"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_form": p2_form, "p3_found": p3_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p5_surrogates": p5_surrogates, "p5_surrogate_checks": p5_surrogate_checks, "p5_replaced": p5_replaced, "p6_found": p6_found, "p7_found": p7_found, "p8_packed": p8_packed, "p8_checks": p8_checks, "p9_found": p9_found, "p9_proximity": p9_proximity, "p10_found": p10_found, "p10_measures": p10_measures}

ORACLE: dict[str, str] = {
    "p5_surrogate_checks": "SELECT CAST(0 AS BIGINT) AS shared, CAST(0 AS BIGINT) AS parted, CAST(0 AS BIGINT) AS kept",
    "p8_checks": "SELECT CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS clashes, CAST(0 AS BIGINT) AS beyond_least, CAST(0 AS BIGINT) AS incomplete, CAST(0 AS BIGINT) AS split",
    # all windows of words of both sides as texts, joined
    "p9_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(lower(regexp_replace(text, '[\x{ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g')), '０１２３４５６７８９ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', '0123456789abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+|[\x{3400}-\x{9fff}]') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, CASE WHEN lang = 'zh' THEN 20 ELSE 12 END AS n, regexp_extract_all(lower(text), '[a-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+|[\x{3400}-\x{9fff}]') AS w FROM benchmark_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT DISTINCT doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT unnest([12, 20]) AS n)))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (n, k)""",
}
