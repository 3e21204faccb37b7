"""Sorts, limits, pages and facets: inventory SO."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.operators import directory, ranking, search
from tallystone.operators.numbering import numbered
from tallystone.plans.grouping import RANK_SQL
from tallystone.plans.registry import query
from tallystone.plans.views import Views

c = F.col


def _numbered(rows: DataFrame, key: str, *order: object, by: str | None = None) -> DataFrame:
    """The rows with their place in an order (within a group), so that it can be compared."""
    if by is None:
        return numbered(rows, "place", *order).select(key, "place")
    return rows.select(by, key, F.row_number().over(Window.partitionBy(by).orderBy(*order)).alias("place"))


@query("so01_nulls_last", "SELECT merchant_id, evidence_id, row_number() OVER (PARTITION BY merchant_id ORDER BY published_at DESC NULLS LAST, captured_at DESC, evidence_id) AS place FROM evidence")
def _(v: Views) -> DataFrame:
    return _numbered(v.evidence, "evidence_id", c("published_at").desc_nulls_last(), c("captured_at").desc(), "evidence_id", by="merchant_id")


@query("so02_boolean_order", "SELECT evidence_id, row_number() OVER (ORDER BY (published_at IS NULL) DESC, published_at, evidence_id) AS place FROM evidence")
def _(v: Views) -> DataFrame:
    return _numbered(v.evidence, "evidence_id", c("published_at").isNull().desc(), "published_at", "evidence_id")


@query("so03_priority_queue", "SELECT task_id, row_number() OVER (ORDER BY CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, task_id) AS place FROM tasks WHERE status = 'pending'")
def _(v: Views) -> DataFrame:
    return _numbered(v.tasks.where("status = 'pending'"), "task_id", ranking.priority_rank(c("priority")), "task_id")


@query(
    "so04_search_order",
    f"""WITH q AS (SELECT DISTINCT p_brand AS query_id, string_split(lower(first(p_name ORDER BY p_partkey)), ' ') AS asked FROM part GROUP BY p_brand), k AS (SELECT DISTINCT merchant_id, alias, list_filter(regexp_split_to_array(lower(regexp_replace(alias, '[#]', ' ', 'g')), '\\s+'), lambda t: t <> '') AS tokens FROM aliases),
      h AS (SELECT query_id, merchant_id, len(list_filter(list_distinct(asked), lambda t: NOT list_contains(tokens, t))) AS fuzzy, greatest(0, len(tokens) - len(list_distinct(asked))) AS extra FROM q, k WHERE len(list_filter(list_distinct(asked), lambda t: len(list_filter(tokens, lambda x: contains(x, t))) > 0)) = len(list_distinct(asked))),
      b AS (SELECT query_id, merchant_id, identity_confidence, min((fuzzy, extra)) AS best FROM h JOIN merchants USING (merchant_id) GROUP BY ALL)
    SELECT query_id, merchant_id, row_number() OVER (PARTITION BY query_id ORDER BY best, identity_confidence DESC, merchant_id) AS place FROM b""",
)
def _(v: Views) -> DataFrame:
    """Hits of one alias's words of each brand among all aliases, best first."""
    asked = v.table("part").groupBy(c("p_brand").alias("query_id")).agg(F.min_by("p_name", "p_partkey").alias("query"))
    nothing = v.evidence.where("false")
    index = search.build_index(v.merchants.select("merchant_id", F.lit("").alias("name"), F.lit("").alias("category"), c("identity_confidence").alias("confidence")), v.identifiers.where("false").select("merchant_id", "kind", "normalized"), v.aliases.select("merchant_id", "alias").distinct(), nothing.select("merchant_id", "summary"), nothing.select("merchant_id", "summary", "quoted_excerpt"), nothing.select("merchant_id", F.lit("").alias("url"), F.lit("").alias("label")))
    text = asked.select("query_id", F.array_distinct(search.T.tokens(search.T.loose_name(c("query")))).alias("asked"))
    return search.ranked(search.by_part(text, index).join(index.entities, "merchant_id"), "merchant_id").select("query_id", "merchant_id", c("rank").alias("place"))


@query("so05_name_order", "SELECT merchant_id, row_number() OVER (ORDER BY name, merchant_id) AS place FROM merchants")
def _(v: Views) -> DataFrame:
    return _numbered(v.merchants, "merchant_id", "name", "merchant_id")


@query("so06_positive_order", f"WITH k AS ({RANK_SQL}) SELECT merchant_id, row_number() OVER (ORDER BY customer_sources DESC, verified_sources DESC, strong_sources DESC, positive_sources DESC, all_sources DESC, newest_positive DESC NULLS LAST, name, merchant_id) AS place FROM k JOIN merchants USING (merchant_id)")
def _(v: Views) -> DataFrame:
    keyed = v.evidence.join(v.sources.select("source_id", F.regexp_replace(F.regexp_replace("url", "^(https?://)www\\.", "$1"), "#.*$", "").alias("source_key")), "source_id")
    return _numbered(directory.positive_rank(keyed).join(v.merchants, "merchant_id"), "merchant_id", *directory.positive_order())


@query(
    "so07_highlight",
    "SELECT merchant_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY author_type = 'customer' DESC, verified DESC, band IN ('strong', 'very_strong') DESC, transaction_evidence DESC, confidence DESC, coalesce(published_at, captured_at) DESC, evidence_id) AS r FROM evidence WHERE duplicate_of IS NULL AND sentiment = 'positive') WHERE r = 1",
)
def _(v: Views) -> DataFrame:
    return ranking.highlights(v.evidence).select("merchant_id", "evidence_id")


_CLAIMS = "SELECT merchant_id, claim_type, count(*) AS mentions, count(DISTINCT CASE WHEN independent = 1 THEN source_id END) AS independent, max(coalesce(published_at, captured_at)) AS latest FROM evidence GROUP BY 1, 2"


def _claims(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id", "claim_type").agg(F.count("*").alias("mentions"), F.count_distinct(F.when(c("independent") == 1, c("source_id"))).alias("independent"), F.max(F.coalesce("published_at", "captured_at")).alias("latest"))


@query("so08_claim_order", f"SELECT merchant_id, claim_type, row_number() OVER (PARTITION BY merchant_id ORDER BY independent DESC, mentions DESC, claim_type) AS place FROM ({_CLAIMS})")
def _(v: Views) -> DataFrame:
    return _numbered(_claims(v), "claim_type", c("independent").desc(), c("mentions").desc(), "claim_type", by="merchant_id")


@query(
    "so09_important_claims",
    f"SELECT merchant_id, claim_type, place FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY CASE WHEN claim_type IN ('official_warning') THEN 0 WHEN claim_type IN ('identity_mismatch', 'counterfeit_product_allegation', 'account_page_disappearance') THEN 1 ELSE 2 END, latest DESC, independent DESC, claim_type) AS place FROM ({_CLAIMS})) WHERE place <= 6",
)
def _(v: Views) -> DataFrame:
    return ranking.important_claims(_claims(v)).select("merchant_id", "claim_type", "place")


@query("so10_page", "WITH k AS (SELECT *, row_number() OVER (ORDER BY name, merchant_id) AS position, count(*) OVER () AS total FROM merchants) SELECT merchant_id, position, total, CAST(ceil(total / 20.0) AS BIGINT) AS total_pages FROM k WHERE position > 40 AND position <= 60")
def _(v: Views) -> DataFrame:
    return directory.page(v.merchants, 3, [c("name"), c("merchant_id")]).select("merchant_id", "position", "total", "total_pages")


@query("so11_sentinel_limit", "SELECT check_id FROM checks ORDER BY checked_at, check_id LIMIT 25")
def _(v: Views) -> DataFrame:
    return ranking.limited(v.checks.orderBy("checked_at", "check_id"), 25).select("check_id").unionByName(ranking.limited(v.checks.where("false").select("check_id"), -1))


@query("so12_most_recent", "SELECT evidence_id, captured_at FROM evidence ORDER BY captured_at DESC, evidence_id LIMIT 15")
def _(v: Views) -> DataFrame:
    return v.evidence.orderBy(c("captured_at").desc(), "evidence_id").limit(15).select("evidence_id", "captured_at")


@query("so13_facets", "SELECT 'city' AS facet, city AS value FROM (SELECT DISTINCT city FROM merchants) UNION ALL SELECT 'state', state FROM (SELECT DISTINCT state FROM merchants)")
def _(v: Views) -> DataFrame:
    return directory.facets(v.merchants, "city").withColumn("facet", F.lit("city")).unionByName(directory.facets(v.merchants, "state").withColumn("facet", F.lit("state")))


@query("so14_bin_packing")
def _(v: Views) -> DataFrame:
    volume = v.evidence.groupBy("merchant_id").agg(F.sum(F.length("summary")).alias("size"))
    return ranking.packed(volume, "merchant_id", "size", 4)


@query("so15_round_robin", "SELECT merchant_id, governorate FROM (SELECT *, row_number() OVER (PARTITION BY governorate ORDER BY merchant_id) AS turn FROM merchants) ORDER BY turn, governorate LIMIT 30")
def _(v: Views) -> DataFrame:
    return ranking.balanced(v.merchants, "governorate", "merchant_id", 30).select("merchant_id", "governorate")


@query("so16_modulo", "SELECT task_id, CAST((row_number() OVER (ORDER BY task_id) - 1) % 7 AS INTEGER) AS agent FROM tasks WHERE status = 'in_progress'")
def _(v: Views) -> DataFrame:
    return ranking.dealt(v.tasks.where("status = 'in_progress'"), "task_id", 7).select("task_id", "agent")


@query("so17_chunks", "SELECT source_id, CAST((row_number() OVER (ORDER BY source_id) - 1) // 12 AS INTEGER) AS chunk FROM sources")
def _(v: Views) -> DataFrame:
    return ranking.chunked(v.sources, "source_id", 12).select("source_id", "chunk")


@query("so18_priority_list", "SELECT DISTINCT platform, CASE platform WHEN 'news site' THEN 1 WHEN 'marketplace' THEN 2 ELSE 0 END AS listed FROM sources")
def _(v: Views) -> DataFrame:
    return v.sources.select("platform").distinct().select("platform", F.array_position(F.array(F.lit("news site"), F.lit("marketplace")), c("platform")).cast("int").alias("listed"))


@query("so19_ordered_distinct", "SELECT conv_id, list(role ORDER BY f) AS roles FROM (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.table("conversations").groupBy("conv_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("roles"))


@query("so20_ambiguity", "SELECT DISTINCT normalized_alias, count(*) FILTER (WHERE weight = least_weight) OVER (PARTITION BY normalized_alias) > 1 AS ambiguous FROM (SELECT *, min(weight) OVER (PARTITION BY normalized_alias) AS least_weight FROM aliases)")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("normalized_alias")
    rows = v.aliases.withColumn("least_weight", F.min("weight").over(w))
    return rows.select("normalized_alias", (F.count_if(c("weight") == c("least_weight")).over(w) > 1).alias("ambiguous")).distinct()


