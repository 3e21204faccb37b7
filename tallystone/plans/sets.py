"""Set operations, graphs and merges: inventory ST and GR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.operators import dedupe, resolve
from tallystone.plans.quality import merge_tables
from tallystone.plans.registry import query
from tallystone.plans.views import Views
from tallystone.plans.windowing import _KEYS, _keyed

c = F.col
_MOVED = "CASE WHEN {0} % 10 = 9 THEN {0} - 9 ELSE {0} END"


def _mapping(v: Views) -> DataFrame:
    return v.merchants.where("merchant_id % 10 = 9").select(c("merchant_id").alias("old"), (c("merchant_id") - 9).alias("new"))


@query("st01_bag_union", "SELECT 'evidence' AS t, evidence_id AS id FROM evidence WHERE confidence > 0.9 UNION ALL SELECT 'identifier', identifier_id FROM identifiers WHERE confidence > 0.9")
def _(v: Views) -> DataFrame:
    return v.evidence.where("confidence > 0.9").select(F.lit("evidence").alias("t"), c("evidence_id").alias("id")).unionByName(v.identifiers.where("confidence > 0.9").select(F.lit("identifier").alias("t"), c("identifier_id").alias("id")))


@query("st02_set_union", f"SELECT {_MOVED.format('merchant_id')} AS merchant_id, normalized_alias FROM aliases UNION SELECT merchant_id - 9, lower(name) FROM merchants WHERE merchant_id % 10 = 9")
def _(v: Views) -> DataFrame:
    return resolve.merged(v.merchants, v.aliases, _mapping(v))[1]


@query("st03_set_difference", "SELECT 'missing' AS problem, merchant_id FROM (SELECT merchant_id FROM merchants EXCEPT SELECT merchant_id FROM analyses WHERE round_no = 3 AND internal_state = 'MIXED_REPUTATION') UNION ALL SELECT 'unexpected', merchant_id FROM (SELECT DISTINCT merchant_id FROM analyses WHERE round_no = 3 AND internal_state = 'MIXED_REPUTATION' EXCEPT SELECT merchant_id FROM merchants WHERE state <> 'IDENTITY_UNCERTAIN')")
def _(v: Views) -> DataFrame:
    asked, got = v.merchants.select("merchant_id"), v.analyses.where("round_no = 3 and internal_state = 'MIXED_REPUTATION'").select("merchant_id")
    missing = asked.subtract(got).select(F.lit("missing").alias("problem"), "merchant_id")
    return missing.unionByName(got.subtract(v.merchants.where("state <> 'IDENTITY_UNCERTAIN'").select("merchant_id")).select(F.lit("unexpected").alias("problem"), "merchant_id"))


@query("st04_intersection", "SELECT merchant_id FROM evidence WHERE claim_type = 'refund_issue' INTERSECT SELECT merchant_id FROM evidence WHERE sentiment = 'positive'")
def _(v: Views) -> DataFrame:
    return v.evidence.where("claim_type = 'refund_issue'").select("merchant_id").intersect(v.evidence.where("sentiment = 'positive'").select("merchant_id"))


@query("st05_equality_proof", "SELECT 'after' AS side, source_id, 'changed' AS platform FROM sources WHERE source_id % 50 = 0 UNION ALL SELECT 'before', source_id, platform FROM sources WHERE source_id % 50 = 0")
def _(v: Views) -> DataFrame:
    before = v.sources.select("source_id", "platform")
    after = before.withColumn("platform", F.when(c("source_id") % 50 == 0, "changed").otherwise(c("platform")))
    return after.exceptAll(before).withColumn("side", F.lit("after")).unionByName(before.exceptAll(after).withColumn("side", F.lit("before")))


@query(
    "gr01_pointer_chase",
    "WITH RECURSIVE w AS (SELECT evidence_id AS id, evidence_id AS cur, duplicate_of AS nxt, 0 AS d FROM evidence UNION ALL SELECT w.id, e.evidence_id, e.duplicate_of, w.d + 1 FROM w JOIN evidence e ON e.evidence_id = w.nxt WHERE w.d < 5000) SELECT id, cur AS root FROM w WHERE nxt IS NULL",
)
def _(v: Views) -> DataFrame:
    return dedupe.chased(v.evidence, "evidence_id", "duplicate_of").select("id", "root")


_COMP = f"WITH RECURSIVE k AS ({_KEYS}), e AS (SELECT a.evidence_id AS x, b.evidence_id AS y FROM k a JOIN k b ON a.merchant_id = b.merchant_id AND (a.content = b.content OR a.exact = b.exact)), r AS (SELECT evidence_id AS x, evidence_id AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y), g AS (SELECT x AS evidence_id, min(y) AS component FROM r GROUP BY x)"


@query("gr02_components", f"{_COMP} SELECT k.merchant_id, component, count(*) AS n FROM g JOIN k USING (evidence_id) GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return dedupe.content_components(_keyed(v), "merchant_id", ["exact", "content"], "evidence_id").groupBy("merchant_id", "component").agg(F.count("*").alias("n"))


@query(
    "gr03_roots",
    f"{_COMP}, o AS (SELECT k.*, component, first_value(evidence_id) OVER (PARTITION BY k.merchant_id, component ORDER BY CASE WHEN independent = 1 AND duplicate_of IS NULL THEN 0 ELSE 1 END, captured_at NULLS LAST, evidence_id) AS root FROM g JOIN k USING (evidence_id)) SELECT evidence_id, CASE WHEN root <> evidence_id THEN root END AS new_duplicate_of, CASE WHEN root = evidence_id THEN 1 ELSE 0 END AS new_independent FROM o",
)
def _(v: Views) -> DataFrame:
    grouped = dedupe.content_components(_keyed(v), "merchant_id", ["content", "exact"], "evidence_id")
    return dedupe.rooted(grouped, "merchant_id", "evidence_id").select("evidence_id", "new_duplicate_of", "new_independent")


@query(
    "gr04_reviewed_merge",
    f"""WITH m AS (SELECT {_MOVED.format('merchant_id')} AS id, * FROM merchants), i AS (SELECT DISTINCT {_MOVED.format('merchant_id')} AS id, kind, normalized FROM identifiers), l AS (SELECT DISTINCT least({_MOVED.format('left_id')}, {_MOVED.format('right_id')}), greatest({_MOVED.format('left_id')}, {_MOVED.format('right_id')}), relation FROM links WHERE {_MOVED.format('left_id')} <> {_MOVED.format('right_id')})
    SELECT 'merchants' AS table_name, count(DISTINCT id) AS n FROM m UNION ALL SELECT 'aliases', count(*) FROM (SELECT {_MOVED.format('merchant_id')}, normalized_alias FROM aliases UNION SELECT merchant_id - 9, lower(name) FROM merchants WHERE merchant_id % 10 = 9) UNION ALL SELECT 'identifiers', count(*) FROM i UNION ALL SELECT 'links', count(*) FROM l
    UNION ALL SELECT 'claims', count(*) FROM (SELECT DISTINCT {_MOVED.format('merchant_id')}, claim_type FROM claims) UNION ALL SELECT 'evidence', count(*) FROM stated UNION ALL SELECT 'claim_evidence', count(*) FROM stated UNION ALL SELECT 'sources', count(*) FROM sources""",
)
def _(v: Views) -> DataFrame:
    """The manifest of the version that a reviewed merge publishes, once its preflight and postconditions hold."""
    return resolve.reviewed_merge(merge_tables(v), _mapping(v), apply=True)


@query(
    "gr04_merged_evidence",
    f"SELECT evidence_id, {_MOVED.format('merchant_id')} AS merchant_id, min(claim_id) OVER (PARTITION BY {_MOVED.format('merchant_id')}, claim_type) AS claim_id, root AS duplicate_of FROM stated JOIN (WITH RECURSIVE w AS (SELECT evidence_id AS id, evidence_id AS cur, duplicate_of AS nxt FROM stated UNION ALL SELECT w.id, e.evidence_id, e.duplicate_of FROM w JOIN stated e ON e.evidence_id = w.nxt) SELECT id, CASE WHEN cur <> id THEN cur END AS root FROM w WHERE nxt IS NULL) ON id = evidence_id",
)
def _(v: Views) -> DataFrame:
    return resolve.merge_tables(merge_tables(v), _mapping(v))["evidence"].select("evidence_id", "merchant_id", "claim_id", "duplicate_of")


@query("gr04_merged_entities", f"SELECT {_MOVED.format('merchant_id')} AS merchant_id, max(identity_confidence) AS identity_confidence, min(name) AS name FROM merchants GROUP BY 1")
def _(v: Views) -> DataFrame:
    return resolve.merged(v.merchants, v.aliases, _mapping(v))[0]
