"""Window-like operators: inventory W."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.operators import dedupe, dml
from tallystone.plans.registry import query
from tallystone.plans.texts import CONTENT_SQL, EXACT_SQL
from tallystone.plans.views import NOW, Views

c = F.col


@query("w01_latest_row", "SELECT merchant_id, analysis_id, internal_state FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY round_no DESC, analysis_id DESC) AS r FROM analyses) WHERE r = 1")
def _(v: Views) -> DataFrame:
    return dml.last_per_key(v.analyses, ["merchant_id"], c("round_no").desc(), c("analysis_id").desc()).select("merchant_id", "analysis_id", "internal_state")


@query("w02_top_20", "SELECT merchant_id, evidence_id, r FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY independent DESC, captured_at DESC, evidence_id) AS r FROM evidence) WHERE r <= 20")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("merchant_id").orderBy(c("independent").desc(), c("captured_at").desc(), "evidence_id")
    return v.evidence.withColumn("r", F.row_number().over(w)).where("r <= 20").select("merchant_id", "evidence_id", "r")


@query(
    "w03_keeper_by_url",
    "SELECT evidence_id, CASE WHEN trim(host) <> '' AND root <> evidence_id THEN root END AS root, CASE WHEN trim(host) <> '' AND root <> evidence_id THEN 0 ELSE independent END AS kept FROM (SELECT e.*, host, first_value(evidence_id) OVER (PARTITION BY merchant_id, host ORDER BY independent DESC, confidence DESC, captured_at, evidence_id) AS root FROM evidence e JOIN sources USING (source_id))",
)
def _(v: Views) -> DataFrame:
    rows = v.evidence.join(v.sources.select("source_id", c("host").alias("url")), "source_id")
    return dedupe.keepers_by_url(rows).select("evidence_id", "root", "kept")


@query("w04_first_three", "SELECT merchant_id, alias_id FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY alias_id) AS r FROM aliases) WHERE r <= 3")
def _(v: Views) -> DataFrame:
    return v.aliases.withColumn("r", F.row_number().over(Window.partitionBy("merchant_id").orderBy("alias_id"))).where("r <= 3").select("merchant_id", "alias_id")


_KEYS = f"SELECT evidence_id, e.merchant_id, captured_at, independent, duplicate_of, {CONTENT_SQL} AS content, {EXACT_SQL} AS exact FROM evidence e JOIN merchants m ON m.merchant_id = e.merchant_id JOIN sources s ON s.source_id = e.source_id"


def _keyed(v: Views) -> DataFrame:
    """Evidence with the two fingerprints of its entity's name, claim type, whole text and link."""
    rows = v.evidence.join(v.merchants.select("merchant_id", "name"), "merchant_id").join(v.sources.select("source_id", "host"), "source_id")
    content, exact = T.content_fingerprint(c("name"), c("claim_type"), c("summary"), c("quoted_excerpt")), T.exact_fingerprint(c("name"), c("claim_type"), c("host"), c("summary"))
    return rows.select("evidence_id", "merchant_id", "captured_at", "independent", "duplicate_of", content.alias("content"), exact.alias("exact"))


@query(
    "w05_duplicate_components",
    f"""WITH RECURSIVE k AS ({_KEYS}), e AS (SELECT a.evidence_id AS x, b.evidence_id AS y FROM k a JOIN k b ON a.merchant_id = b.merchant_id AND (a.content = b.content OR a.exact = b.exact)), r AS (SELECT evidence_id AS x, evidence_id AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
    SELECT x AS evidence_id, min(y) AS component FROM r GROUP BY x""",
)
def _(v: Views) -> DataFrame:
    return dedupe.content_components(_keyed(v), "merchant_id", ["content", "exact"], "evidence_id").select("evidence_id", "component")


@query("w06_streaks", "SELECT user_id, event_id, prev, CAST(sum(CASE WHEN prev IS NULL OR value >= prev THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)")
def _(v: Views) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = v.table("events").withColumn("prev", F.lag("value").over(w))
    fresh = F.when(c("prev").isNull() | (c("value") >= c("prev")), 1).otherwise(0)
    return rows.select("user_id", "event_id", "prev", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


@query("w07_oldest_warning", f"SELECT merchant_id, first(evidence_id ORDER BY published_at, evidence_id) AS oldest, max(CAST(floor(epoch_ms(TIMESTAMP '{NOW}' - published_at) / 86400000.0 + 0.5) AS BIGINT)) AS age_days FROM evidence WHERE claim_type = 'official_warning' AND published_at IS NOT NULL GROUP BY 1".replace(f"epoch_ms(TIMESTAMP '{NOW}' - published_at)", f"(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(published_at))"))
def _(v: Views) -> DataFrame:
    from tallystone.functions.values import age_days

    rows = v.evidence.where("claim_type = 'official_warning' and published_at is not null")
    return rows.groupBy("merchant_id").agg(F.min_by("evidence_id", F.struct("published_at", "evidence_id")).alias("oldest"), F.max(age_days(c("published_at"), NOW, whole=False)).alias("age_days"))


@query("w08_latest_linked", "SELECT merchant_id, claim_type, evidence_id, max(coalesce(published_at, captured_at)) OVER (PARTITION BY merchant_id, claim_type) AS latest FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("merchant_id", "claim_type", "evidence_id", F.max(F.coalesce("published_at", "captured_at")).over(Window.partitionBy("merchant_id", "claim_type")).alias("latest"))


@query(
    "w09_diverse_three",
    "WITH a AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, sentiment ORDER BY confidence DESC, evidence_id) AS turn FROM evidence WHERE duplicate_of IS NULL), b AS (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY CASE WHEN turn = 1 THEN 0 ELSE 1 END, confidence DESC, evidence_id) AS place FROM a) SELECT merchant_id, evidence_id, place FROM b WHERE place <= 3",
)
def _(v: Views) -> DataFrame:
    own = Window.partitionBy("merchant_id", "sentiment").orderBy(c("confidence").desc(), "evidence_id")
    rows = v.evidence.where("duplicate_of is null").withColumn("turn", F.row_number().over(own))
    all_ = Window.partitionBy("merchant_id").orderBy(F.when(c("turn") == 1, 0).otherwise(1), c("confidence").desc(), "evidence_id")
    return rows.withColumn("place", F.row_number().over(all_)).where("place <= 3").select("merchant_id", "evidence_id", "place")


@query("w10_running_counters", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS attempts FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("user_id", "event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("attempts"))


