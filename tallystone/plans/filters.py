"""Projections, filters and predicates: inventory PF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.functions import urls as U
from tallystone.operators.search import canonical_query, cleaned_query, query_problem
from tallystone.plans.registry import query
from tallystone.plans.views import CUTOFF_2Y, CUTOFF_30D, STATES, Views

c = F.col


def _in(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join(f"'{x}'" for x in values)


@query("pf01_projection", "SELECT merchant_id AS merchantId, name AS canonicalName, city AS city FROM merchants")
def _(v: Views) -> DataFrame:
    return v.merchants.select(c("merchant_id").alias("merchantId"), c("name").alias("canonicalName"), "city")


@query("pf02_public_fields", "SELECT merchant_id, list_transform(list_sort(list(struct_pack(i := evidence_id, t := claim_type))), lambda x: x.t) AS types FROM evidence GROUP BY merchant_id")
def _(v: Views) -> DataFrame:
    whole = v.evidence.groupBy("merchant_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "claim_type", "confidence", "quoted_excerpt"))).alias("items"))
    return whole.select("merchant_id", F.transform("items", lambda x: x["claim_type"]).alias("types"))


@query("pf03_comparisons", "SELECT evidence_id, confidence FROM evidence WHERE independent = 1 AND confidence >= 0.7 AND claim_type <> 'other'")
def _(v: Views) -> DataFrame:
    return v.evidence.where((c("independent") == 1) & (c("confidence") >= 0.7) & (c("claim_type") != "other")).select("evidence_id", "confidence")


@query("pf04_null_tests", "SELECT evidence_id FROM evidence WHERE duplicate_of IS NULL AND published_at IS NOT NULL AND NOT (published_at < TIMESTAMP '2024-01-01')")
def _(v: Views) -> DataFrame:
    return v.evidence.where(c("duplicate_of").isNull() & c("published_at").isNotNull() & ~(c("published_at") < F.lit("2024-01-01").cast("timestamp_ntz"))).select("evidence_id")


@query("pf05_domain_check", f"SELECT merchant_id, state FROM merchants WHERE state NOT IN ({_in(STATES[:5])})")
def _(v: Views) -> DataFrame:
    return v.merchants.where(~c("state").isin(*STATES[:5])).select("merchant_id", "state")


@query("pf06_not_in_subquery", "SELECT merchant_id FROM merchants WHERE merchant_id NOT IN (SELECT DISTINCT merchant_id FROM analyses WHERE round_no = 6 AND internal_state = 'OFFICIAL_WARNING')")
def _(v: Views) -> DataFrame:
    seen = v.analyses.where("round_no = 6 and internal_state = 'OFFICIAL_WARNING'").select("merchant_id").distinct()
    return v.merchants.select("merchant_id").join(seen, "merchant_id", "left_anti")


@query("pf07_exists", "SELECT merchant_id FROM merchants m WHERE EXISTS (SELECT 1 FROM identifiers i WHERE i.merchant_id = m.merchant_id AND i.kind = 'facebook' AND i.confidence > 0.5) AND NOT EXISTS (SELECT 1 FROM links l WHERE l.left_id = m.merchant_id AND l.relation = 'branch_of')")
def _(v: Views) -> DataFrame:
    has = v.identifiers.where("kind = 'facebook' and confidence > 0.5").select("merchant_id")
    branch = v.links.where("relation = 'branch_of'").select(c("left_id").alias("merchant_id"))
    return v.merchants.select("merchant_id").join(has, "merchant_id", "left_semi").join(branch, "merchant_id", "left_anti")


@query("pf08_scalar_subquery", "SELECT merchant_id FROM merchants m WHERE (SELECT count(*) FROM identifiers i WHERE i.merchant_id = m.merchant_id AND i.kind = 'phone') <> 1")
def _(v: Views) -> DataFrame:
    n = v.identifiers.where("kind = 'phone'").groupBy("merchant_id").agg(F.count("*").alias("n"))
    return v.merchants.join(n, "merchant_id", "left").where(F.coalesce("n", F.lit(0)) != 1).select("merchant_id")


@query("pf09_prefix_match", "SELECT alias_id, alias FROM aliases WHERE lower(alias) LIKE 'blue\\_%' ESCAPE '\\' OR starts_with(lower(alias), 'red w')")
def _(v: Views) -> DataFrame:
    return v.aliases.where(c("alias").ilike("blue\\_%") | F.lower("alias").startswith("red w")).select("alias_id", "alias")


@query("pf10_non_ascii", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[^ -~\\n]')")
def _(v: Views) -> DataFrame:
    return v.table("documents").where(c("text").rlike("[^ -~\\n]")).select("doc_id")


@query("pf11_blank_fields", "SELECT task_id FROM tasks WHERE trim(title) = ''")
def _(v: Views) -> DataFrame:
    return v.tasks.where(F.trim("title") == "").select("task_id")


@query("pf12_placeholders", "SELECT source_id, regexp_matches(url, '(?i)(\\bTODO\\b)|(\\bFIXME\\b)|(example\\.com)|(\\blorem\\s+ipsum\\b)') OR regexp_matches(url, '(?i)^\\s*(n/?a|todo|tbd|placeholder|unknown|-+|\\.+)\\s*$') AS placeholder FROM sources")
def _(v: Views) -> DataFrame:
    return v.sources.select("source_id", T.has_placeholder(c("url")).alias("placeholder"))


@query("pf13_placeholder_summary", "SELECT evidence_id, trim(summary) = '' OR lower(trim(summary)) = 'source-only reference' AS placeholder FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("evidence_id", T.is_placeholder_summary(c("summary")).alias("placeholder"))


@query("pf14_meaningful", "SELECT evidence_id, duplicate_of IS NULL AND (trim(summary) <> '' OR trim(quoted_excerpt) <> '') AS meaningful FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("evidence_id", (c("duplicate_of").isNull() & (~T.is_placeholder_summary(c("summary")) | (F.trim("quoted_excerpt") != ""))).alias("meaningful"))


@query("pf15_case_order", "SELECT task_id, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM tasks")
def _(v: Views) -> DataFrame:
    return v.tasks.select("task_id", F.when(c("priority") == "critical", 0).when(c("priority") == "high", 1).when(c("priority") == "medium", 2).otherwise(3).alias("rank"))


@query("pf16_distinct", "SELECT DISTINCT e.merchant_id, s.host FROM evidence e JOIN sources s USING (source_id)")
def _(v: Views) -> DataFrame:
    return v.evidence.join(v.sources, "source_id").select("merchant_id", "host").distinct()


@query("pf17_staleness", f"SELECT evidence_id, coalesce(published_at < TIMESTAMP '{CUTOFF_2Y}', false) AS stale_metric, coalesce(published_at < TIMESTAMP '{CUTOFF_30D}', true) AS stale_check FROM evidence")
def _(v: Views) -> DataFrame:
    from tallystone.functions.values import is_stale

    return v.evidence.select("evidence_id", is_stale(c("published_at"), CUTOFF_2Y, missing=False).alias("stale_metric"), is_stale(c("published_at"), CUTOFF_30D, missing=True).alias("stale_check"))


@query("pf18_directory_filter", "SELECT m.merchant_id FROM merchants m WHERE governorate = 'ASIA' AND contains(lower(name), 'supplier') AND contains(lower(city), 'nation_1') AND (SELECT count(DISTINCT normalized) FROM identifiers i WHERE i.merchant_id = m.merchant_id AND kind = 'address') >= 1")
def _(v: Views) -> DataFrame:
    from tallystone.operators.directory import matching

    places = v.identifiers.where("kind = 'address'").groupBy("merchant_id").agg(F.count_distinct("normalized").alias("location_count"))
    rows = v.merchants.join(places, "merchant_id", "left").withColumn("tokens", F.split(F.lower(F.concat_ws(" ", "name", "city")), " "))
    return matching(rows, governorate="ASIA", least_locations=1, query="supplier nation_1").select("merchant_id")


@query(
    "pf19_query_validation",
    "SELECT event_id, CASE WHEN event_id % 5 = 1 OR event_id % 170 > 160 THEN 'query' WHEN event_id % 7 = 2 OR event_id % 7 = 3 THEN 'page' WHEN event_id % 3 = 2 THEN 'view' END AS wrong, CASE WHEN NOT (event_id % 5 = 1 OR event_id % 170 > 160 OR event_id % 7 = 2 OR event_id % 7 = 3 OR event_id % 3 = 2) THEN concat(repeat('x', CAST(event_id % 170 AS INTEGER)), CASE WHEN event_id % 170 > 0 THEN '' ELSE 'shop' END) END AS query FROM events",
)
def _(v: Views) -> DataFrame:
    """Parameters of each event's directory request: lengths at the limit, control characters, pages and views."""
    k = c("event_id")
    long = F.repeat(F.lit("X"), (k % 170).cast("int"))
    text = F.when(k % 5 == 1, F.concat(long, F.lit("\u0007"))).when(k % 170 == 0, F.lit(" Shop ")).otherwise(long)
    page = F.when(k % 7 == 2, "0").when(k % 7 == 3, "1.5").otherwise((k + 1).cast("string"))
    view = F.when(k % 3 == 2, "other").when(k % 3 == 1, "positive")
    problem = query_problem(text, page, view)
    return v.table("events").select("event_id", problem.alias("wrong"), F.when(problem.isNull(), cleaned_query(text)).alias("query"))


@query("pf20_cache_key", "SELECT merchant_id, concat('[\"', lower(trim(name)), '\",\"', city, '\",', CAST(merchant_id % 5 + 1 AS VARCHAR), ']') AS cache_key FROM merchants")
def _(v: Views) -> DataFrame:
    return v.merchants.select("merchant_id", canonical_query(c("name"), c("city"), c("merchant_id") % 5 + 1).alias("cache_key"))


_HOST = "regexp_replace(lower(regexp_extract(normalized, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(normalized, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SEARCHABLE = f"""(CASE WHEN kind IN ('website', 'marketplace') AND {_HOST} IN ('cpa.gov.eg', 'shakwa.cpa-mobile.com', 'support.apple.com') THEN false
  WHEN kind IN ('phone', 'whatsapp') THEN normalized LIKE '+20%' AND regexp_matches(regexp_replace(normalized, '[^0-9]', '', 'g'), '^20(1[0125][0-9]{{8}}|[2-9][0-9]{{8}})$')
  WHEN kind = 'website' THEN contains({_HOST}, '.') WHEN kind IN ('marketplace', 'facebook', 'instagram', 'tiktok', 'google_maps') THEN contains({_HOST}, '.') AND NOT ({_HOST} IN ('facebook.com', 'instagram.com', 'tiktok.com', 'g.page', 'goo.gl', 'maps.app.goo.gl', 'maps.google.com', 'google.com', 'play.google.com', 'apps.apple.com') AND {_PATH} IN ('', '/'))
  WHEN kind = 'email' THEN contains(normalized, '@') AND contains(normalized, '.') ELSE true END)"""


@query("pf21_identifier_policy", f"SELECT identifier_id, {SEARCHABLE} AS searchable FROM identifiers")
def _(v: Views) -> DataFrame:
    return v.identifiers.select("identifier_id", U.is_searchable_identifier(c("kind"), c("normalized")).alias("searchable"))


@query("pf22_forbidden_labels", "SELECT doc_id, list_has_any(regexp_split_to_array(lower(text), '\\s+'), ['scammer', 'scam', 'fraudster', 'criminal', 'thief', 'scum']) AS rejected FROM documents")
def _(v: Views) -> DataFrame:
    words = F.split(F.lower("text"), "\\s+")
    return v.table("documents").select("doc_id", (T.has_forbidden_label(c("text")) | F.array_contains(words, "scum")).alias("rejected"))


@query("pf23_executable_tasks", "SELECT task_id FROM tasks WHERE trim(title) <> '' OR trim(instruction) <> ''")
def _(v: Views) -> DataFrame:
    return v.tasks.where((F.trim("title") != "") | (F.trim("instruction") != "")).select("task_id")


@query("pf24_provenance_guard", "SELECT user_id, CAST(count(*) FILTER (WHERE event_id % 3 <> 2) AS INTEGER) AS n_kept FROM events GROUP BY user_id")
def _(v: Views) -> DataFrame:
    link = F.concat(F.lit("https://x.example/"), c("event_id").cast("string"))
    item = F.struct(F.when(c("event_id") % 3 == 0, link).alias("source_url"), F.when(c("event_id") % 3 == 1, link).alias("url"), F.lit(None).cast("string").alias("link"))
    rows = v.table("events").groupBy("user_id").agg(F.collect_list(item).alias("items"))
    return rows.select("user_id", F.size(F.filter("items", lambda x: F.coalesce(x["source_url"], x["url"], x["link"]).isNotNull())).alias("n_kept"))


@query(
    "pf25_blocked_targets",
    "SELECT event_id, CASE event_id % 10 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN event_id % 256 BETWEEN 16 AND 31 WHEN 4 THEN event_id % 256 = 168 WHEN 5 THEN true WHEN 6 THEN false WHEN 7 THEN false WHEN 8 THEN true ELSE event_id % 256 = 0 OR event_id % 256 = 10 OR event_id % 256 = 127 OR event_id % 256 >= 240 OR event_id % 256 BETWEEN 224 AND 239 AND false END AS blocked FROM events",
)
def _(v: Views) -> DataFrame:
    """Loopback, private, link-local and reserved ranges at and beyond their borders, names and numbers."""
    octet = (c("event_id") % 256).cast("string")
    parts = ("http://127.0.0.{0}/x", "http://10.{0}.3.4/", "https://localhost:80{0}/a", "http://172.{0}.0.9/", "http://192.{0}.1.1/", "http://169.254.{0}.1/", "https://shop{0}.example.com/", "http://8.8.{0}.8/dns", "http://host{0}/", "http://{0}.20.30.40/")
    made = [F.concat(F.lit(a), octet, F.lit(b)) for a, b in (p.split("{0}") for p in parts)]
    url = F.element_at(F.array(*made), (c("event_id") % 10 + 1).cast("int"))
    return v.table("events").select("event_id", U.is_blocked_target(url).alias("blocked"))
