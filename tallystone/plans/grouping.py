"""Aggregations: inventory AG."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions import values as V
from tallystone.operators import audit, dedupe, directory
from tallystone.plans.filters import SEARCHABLE
from tallystone.plans.registry import query
from tallystone.plans.views import CUTOFF_2Y, Views

c = F.col
COVERAGE_SQL = """SELECT merchant_id, count(*) AS total, count(*) FILTER (WHERE duplicate_of IS NULL) AS non_duplicate, count(DISTINCT CASE WHEN duplicate_of IS NULL THEN source_id END) AS sources, count(*) FILTER (WHERE duplicate_of IS NULL AND verified = 1) AS reviewed,
  count(*) FILTER (WHERE duplicate_of IS NULL AND published_at IS NULL) AS undated, max(CASE WHEN duplicate_of IS NULL THEN published_at END) AS latest_published, max(CASE WHEN duplicate_of IS NULL THEN captured_at END) AS latest_captured,
  CASE WHEN count(DISTINCT CASE WHEN duplicate_of IS NULL THEN source_id END) = 0 THEN 'none' WHEN count(DISTINCT CASE WHEN duplicate_of IS NULL THEN source_id END) <= 2 THEN 'limited' WHEN count(DISTINCT CASE WHEN duplicate_of IS NULL THEN source_id END) <= 5 THEN 'moderate' ELSE 'broad' END AS coverage FROM evidence GROUP BY merchant_id"""
SENTIMENT_SQL = "SELECT merchant_id, count(*) FILTER (WHERE duplicate_of IS NULL AND sentiment = 'positive') AS positive, count(*) FILTER (WHERE duplicate_of IS NULL AND sentiment = 'negative') AS negative, count(*) FILTER (WHERE duplicate_of IS NULL AND sentiment = 'neutral') AS neutral, count(*) FILTER (WHERE duplicate_of IS NOT NULL) AS duplicates FROM evidence GROUP BY merchant_id"


@query("flagship_directory", f"WITH cov AS ({COVERAGE_SQL}), sen AS ({SENTIMENT_SQL}) SELECT m.merchant_id, m.name, m.city, m.governorate, coalesce(cov.sources, 0) AS sources, coalesce(cov.coverage, 'none') AS coverage, coalesce(sen.positive, 0) AS positive, coalesce(sen.negative, 0) AS negative FROM merchants m LEFT JOIN cov USING (merchant_id) LEFT JOIN sen USING (merchant_id)")
def _(v: Views) -> DataFrame:
    rows = v.merchants.join(directory.coverage(v.evidence), "merchant_id", "left").join(directory.sentiments(v.evidence), "merchant_id", "left")
    n = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return rows.select("merchant_id", "name", "city", "governorate", n("sources"), F.coalesce("coverage", F.lit("none")).alias("coverage"), n("positive"), n("negative")).orderBy("name", "merchant_id")


@query("ag01_counts", "SELECT (SELECT count(*) FROM evidence) AS n_rows, (SELECT count(*) FROM evidence WHERE independent = 1) AS independent, (SELECT count(*) FROM evidence WHERE duplicate_of IS NOT NULL) AS duplicates")
def _(v: Views) -> DataFrame:
    return v.evidence.agg(F.count("*").alias("n_rows"), F.count_if(c("independent") == 1).alias("independent"), F.count("duplicate_of").alias("duplicates"))


@query("ag02_count_distinct", "SELECT merchant_id, count(DISTINCT source_id) AS n_sources, count(DISTINCT claim_type) AS n_types FROM evidence GROUP BY merchant_id")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id").agg(F.count_distinct("source_id").alias("n_sources"), F.count_distinct("claim_type").alias("n_types"))


@query("ag03_having", "SELECT normalized_alias, count(*) AS n FROM aliases GROUP BY 1 HAVING count(*) > 80")
def _(v: Views) -> DataFrame:
    return v.aliases.groupBy("normalized_alias").agg(F.count("*").alias("n")).where("n > 80")


@query("ag04_distribution", "SELECT state, count(*) AS n FROM merchants GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.merchants.groupBy("state").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state")


@query(
    "ag05_quality_metrics",
    f"""SELECT (SELECT count(*) FROM merchants) AS merchants, (SELECT count(*) FROM evidence) AS evidence, count(*) AS primary_rows, round((SELECT count(*) FILTER (WHERE duplicate_of IS NOT NULL) / greatest(count(*), 1) FROM evidence), 6) AS duplicate_rate,
      round((SELECT count(*) FILTER (WHERE identity_confidence >= 0.45) / greatest(count(*), 1) FROM merchants), 6) AS identity_resolution, round(count(*) FILTER (WHERE sentiment = 'positive') / greatest(count(*), 1), 6) AS positive_ratio, round(count(*) FILTER (WHERE sentiment = 'negative') / greatest(count(*), 1), 6) AS negative_ratio,
      round(count(*) FILTER (WHERE sentiment = 'neutral') / greatest(count(*), 1), 6) AS neutral_ratio, round(count(*) FILTER (WHERE band IN ('strong', 'very_strong')) / greatest(count(*), 1), 6) AS high_ratio, round(count(*) FILTER (WHERE band = 'medium') / greatest(count(*), 1), 6) AS medium_ratio,
      round(count(*) FILTER (WHERE published_at < TIMESTAMP '{CUTOFF_2Y}') / greatest(count(*), 1), 6) AS stale_ratio, round((SELECT count(*) FROM (SELECT merchant_id FROM evidence WHERE independent = 1 GROUP BY 1 HAVING count(DISTINCT source_id) >= 2)) / greatest((SELECT count(*) FROM merchants), 1), 6) AS multi_source_ratio,
      (SELECT count(DISTINCT nullif(trim(city), '')) FROM merchants) AS cities, (SELECT count(DISTINCT nullif(trim(category), '')) FROM merchants) AS categories, (SELECT count(DISTINCT nullif(trim(platform), '')) FROM sources) AS platforms, (SELECT count(*) FROM tasks WHERE status IN ('pending', 'unresolved', 'in_progress')) AS pending_tasks FROM evidence WHERE independent = 1""",
)
def _(v: Views) -> DataFrame:
    return audit.quality_metrics(v.merchants, v.evidence, v.sources, v.tasks, CUTOFF_2Y)


@query("ag06_multi_source", "SELECT count(*) FILTER (WHERE n >= 2) AS multi, count(*) AS n_merchants FROM (SELECT merchant_id, count(DISTINCT source_id) AS n FROM evidence WHERE independent = 1 GROUP BY 1)")
def _(v: Views) -> DataFrame:
    n = v.evidence.where("independent = 1").groupBy("merchant_id").agg(F.count_distinct("source_id").alias("n"))
    return n.agg(F.count_if(c("n") >= 2).alias("multi"), F.count("*").alias("n_merchants"))


@query("ag07_distinct_trimmed", "SELECT count(DISTINCT nullif(trim(city), '')) AS cities, count(DISTINCT nullif(trim(category), '')) AS categories FROM merchants")
def _(v: Views) -> DataFrame:
    n = lambda x: F.count_distinct(F.nullif(F.trim(x), F.lit("")))
    return v.merchants.agg(n("city").alias("cities"), n("category").alias("categories"))


@query("ag08_coverage", COVERAGE_SQL)
def _(v: Views) -> DataFrame:
    return directory.coverage(v.evidence)


@query("ag09_sentiment_pivot", SENTIMENT_SQL)
def _(v: Views) -> DataFrame:
    return directory.sentiments(v.evidence)


_OK = "independent = 1 AND duplicate_of IS NULL"
_POS = f"{_OK} AND sentiment = 'positive'"
RANK_SQL = f"""SELECT merchant_id, count(DISTINCT CASE WHEN {_POS} AND author_type = 'customer' THEN url END) AS customer_sources, count(DISTINCT CASE WHEN {_POS} AND verified = 1 THEN url END) AS verified_sources, count(DISTINCT CASE WHEN {_POS} AND band IN ('strong', 'very_strong') THEN url END) AS strong_sources,
  count(DISTINCT CASE WHEN {_POS} THEN url END) AS positive_sources, count(DISTINCT CASE WHEN {_OK} THEN url END) AS all_sources, max(CASE WHEN {_POS} THEN coalesce(published_at, captured_at) END) AS newest_positive FROM evidence JOIN (SELECT source_id, regexp_replace(regexp_replace(url, '^(https?://)www\\.', '\\1'), '#.*$', '') AS url FROM sources) USING (source_id) GROUP BY merchant_id"""


@query("ag10_positive_rank", RANK_SQL)
def _(v: Views) -> DataFrame:
    keyed = v.evidence.join(v.sources.select("source_id", F.regexp_replace(F.regexp_replace("url", "^(https?://)www\\.", "$1"), "#.*$", "").alias("source_key")), "source_id")
    return directory.positive_rank(keyed)


@query(
    "ag11_claim_rollup",
    """SELECT merchant_id, claim_type, count(*) AS mention_count, count(DISTINCT CASE WHEN independent = 1 THEN source_id END) AS independent_source_count, first(evidence_id ORDER BY independent DESC, verified DESC, confidence DESC, evidence_id) AS representative FROM evidence GROUP BY merchant_id, claim_type""",
)
def _(v: Views) -> DataFrame:
    return dedupe.claims(v.evidence, ["merchant_id", "claim_type"])


@query("ag12_publication_coverage", "SELECT count(*) AS total, count(*) FILTER (WHERE published_at IS NULL) AS missing, min(published_at) AS first, max(published_at) AS last, count(DISTINCT CASE WHEN published_at IS NULL THEN merchant_id END) AS merchants_without FROM evidence")
def _(v: Views) -> DataFrame:
    gone = c("published_at").isNull()
    return v.evidence.agg(F.count("*").alias("total"), F.count_if(gone).alias("missing"), F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.count_distinct(F.when(gone, c("merchant_id"))).alias("merchants_without"))


@query("ag13_histogram", "SELECT CASE WHEN confidence < 0.25 THEN '0.00-0.25' WHEN confidence < 0.5 THEN '0.25-0.50' WHEN confidence < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END AS band, count(*) AS n FROM evidence GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy(V.width_band(c("confidence")).alias("band")).agg(F.count("*").alias("n"))


@query("ag14_string_agg", "SELECT kind, normalized, string_agg(DISTINCT CAST(merchant_id AS VARCHAR), ',' ORDER BY CAST(merchant_id AS VARCHAR)) AS owners FROM identifiers GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return v.identifiers.groupBy("kind", "normalized").agg(F.array_join(F.sort_array(F.collect_set(c("merchant_id").cast("string"))), ",").alias("owners"))


@query("ag15_text_volume", "SELECT m.merchant_id, CAST(coalesce((SELECT sum(length(summary)) FROM evidence e WHERE e.merchant_id = m.merchant_id), 0) + coalesce((SELECT sum(length(alias)) FROM aliases a WHERE a.merchant_id = m.merchant_id), 0) + coalesce((SELECT sum(length(title)) FROM tasks t WHERE t.merchant_id = m.merchant_id), 0) AS BIGINT) AS volume FROM merchants m")
def _(v: Views) -> DataFrame:
    size = lambda df, x, name: df.groupBy("merchant_id").agg(F.sum(F.length(x)).alias(name))
    out = v.merchants.select("merchant_id").join(size(v.evidence, "summary", "a"), "merchant_id", "left").join(size(v.aliases, "alias", "b"), "merchant_id", "left").join(size(v.tasks, "title", "d"), "merchant_id", "left").na.fill(0)
    return out.select("merchant_id", (c("a") + c("b") + c("d")).alias("volume"))


@query("ag16_member_extremes", "SELECT merchant_id, max(confidence) AS confidence, min(captured_at) AS first_seen, min(evidence_id) AS first_id FROM evidence GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id").agg(F.max("confidence").alias("confidence"), F.min("captured_at").alias("first_seen"), F.min("evidence_id").alias("first_id"))


@query("ag17_next_round", "SELECT m.merchant_id, coalesce(max(a.round_no), 0) + 1 AS next_round FROM merchants m LEFT JOIN analyses a ON a.merchant_id = m.merchant_id GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.merchants.join(v.analyses, "merchant_id", "left").groupBy("merchant_id").agg((F.coalesce(F.max("round_no"), F.lit(0)) + 1).alias("next_round"))


@query("ag18_argmax", "SELECT merchant_id, first(evidence_id ORDER BY independent DESC, confidence DESC, evidence_id) AS best FROM evidence GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id").agg(F.max_by("evidence_id", F.struct("independent", "confidence", -c("evidence_id"))).alias("best"))


@query("ag19_collected_sets", "SELECT source_id, CAST(len(list_distinct(list(claim_type))) AS INTEGER) AS n_types, list_sort(list_filter(list_distinct(list(claim_type)), x -> x NOT IN ('other', 'identity_mismatch'))) AS kept FROM evidence GROUP BY 1".replace("x -> x", "lambda x: x"))
def _(v: Views) -> DataFrame:
    types = F.collect_set("claim_type")
    return v.evidence.groupBy("source_id").agg(F.size(types).alias("n_types"), F.sort_array(F.array_except(types, F.array(F.lit("other"), F.lit("identity_mismatch")))).alias("kept"))


@query("ag20_ordered_lists", "SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.table("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))


@query("ag21_inverted_index", "SELECT token, CAST(p_partkey // 1000 AS BIGINT) AS part, list_sort(list(p_partkey)) AS ids FROM (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    from tallystone.operators.search import posting_lists, postings

    return posting_lists(postings(v.table("part"), "p_partkey", "p_name"), "p_partkey", 1000)


@query("ag21_trigram_index", "SELECT DISTINCT unnest(list_transform(range(1, length(token) + 2), lambda i: substr(concat('  ', token, ' '), CAST(i AS INTEGER), 3))) AS trigram, token FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part)")
def _(v: Views) -> DataFrame:
    from tallystone.operators.search import postings, trigram_postings

    return trigram_postings(postings(v.table("part"), "p_partkey", "p_name")).select("trigram", "token")


@query("ag21_owners", "SELECT kind AS way, lower(normalized) AS form, merchant_id, min(normalized) AS value FROM identifiers WHERE kind IN ('phone', 'whatsapp', 'email') AND " + SEARCHABLE + " GROUP BY ALL")
def _(v: Views) -> DataFrame:
    from tallystone.operators.search import owners

    return owners(v.identifiers.where("kind in ('phone', 'whatsapp', 'email')"))


@query("ag22_set_hash", "SELECT merchant_id, substr(sha256(string_agg(concat(CAST(evidence_id AS VARCHAR), '|', claim_type, '|', sentiment), ',' ORDER BY evidence_id)), 1, 32) AS set_hash FROM evidence GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id").agg(dedupe.set_hash("evidence_id", ["evidence_id", "claim_type", "sentiment"]).alias("set_hash"))


@query("ag23_percentile", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.table("events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99"))


@query("ag24_usage", "SELECT user_id, round(sum(value), 4) AS cost, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, arg_max(event_type, CASE WHEN event_type <> 'error' THEN event_id END) AS last_model FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    named = F.when(c("event_type") != "error", c("event_id"))
    return v.table("events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("cost"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens"), F.max_by("event_type", named).alias("last_model"))


@query("ag25_breakdown", "SELECT platform, source_type, count(*) AS n FROM sources GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return v.sources.groupBy("platform", "source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "platform", "source_type")


@query("ag26_status_counts", "SELECT coalesce(k.status, 'not_checked') AS status, count(*) AS n FROM (SELECT DISTINCT source_id FROM evidence) s LEFT JOIN (SELECT source_id, arg_max(status, check_id) AS status FROM checks GROUP BY 1) k USING (source_id) GROUP BY 1")
def _(v: Views) -> DataFrame:
    latest = v.checks.groupBy("source_id").agg(F.max_by("status", "check_id").alias("status"))
    return v.evidence.select("source_id").distinct().join(latest, "source_id", "left").groupBy(F.coalesce("status", F.lit("not_checked")).alias("status")).agg(F.count("*").alias("n"))


@query("ag27_success_ratio", "SELECT user_id, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS ratio, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) >= 0.8 AS ok FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    share = F.avg((c("event_type") != "error").cast("double"))
    return v.table("events").groupBy("user_id").agg(F.round(share, 6).alias("ratio"), (share >= 0.8).alias("ok"))


@query(
    "ag28_dependents",
    "SELECT m.merchant_id, (SELECT count(*) FROM evidence e WHERE e.merchant_id = m.merchant_id) AS evidence, (SELECT count(*) FROM identifiers e WHERE e.merchant_id = m.merchant_id) AS identifiers, (SELECT count(*) FROM aliases e WHERE e.merchant_id = m.merchant_id) AS aliases, (SELECT count(*) FROM tasks e WHERE e.merchant_id = m.merchant_id) AS tasks, (SELECT count(*) FROM analyses e WHERE e.merchant_id = m.merchant_id) AS analyses, (SELECT count(*) FROM links e WHERE e.left_id = m.merchant_id OR e.right_id = m.merchant_id) AS links, (SELECT count(DISTINCT source_id) FROM evidence e WHERE e.merchant_id = m.merchant_id) AS sources FROM merchants m",
)
def _(v: Views) -> DataFrame:
    out = v.merchants.select("merchant_id")
    for name in ("evidence", "identifiers", "aliases", "tasks", "analyses"):
        out = out.join(v.view(name).groupBy("merchant_id").agg(F.count("*").alias(name)), "merchant_id", "left")
    ends = v.links.select(F.explode(F.array_distinct(F.array("left_id", "right_id"))).alias("merchant_id")).groupBy("merchant_id").agg(F.count("*").alias("links"))
    sources = v.evidence.groupBy("merchant_id").agg(F.count_distinct("source_id").alias("sources"))
    return out.join(ends, "merchant_id", "left").join(sources, "merchant_id", "left").na.fill(0)


@query("ag29_any_every", "SELECT merchant_id, bool_or(sentiment = 'negative' AND author_type <> 'merchant') AS adverse, bool_and(independent = 1) AS all_independent FROM evidence GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id").agg(F.bool_or((c("sentiment") == "negative") & (c("author_type") != "merchant")).alias("adverse"), F.bool_and(c("independent") == 1).alias("all_independent"))


@query("ag30_locations", "SELECT merchant_id, count(DISTINCT CASE WHEN kind = 'address' AND trim(normalized) <> '' THEN normalized END) AS location_count FROM identifiers GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.identifiers.groupBy("merchant_id").agg(F.count_distinct(F.when((c("kind") == "address") & (F.trim("normalized") != ""), c("normalized"))).alias("location_count"))


