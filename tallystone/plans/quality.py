"""Constraints, gates and audits: inventory DQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators import audit, contracts, dedupe, dml, resolve
from tallystone.plans.filters import SEARCHABLE
from tallystone.plans.registry import query
from tallystone.plans.views import AUTHORS, BANDS, CLAIM_TYPES, CUTOFF_2Y, LINK_STATUS, STATES, Views
from tallystone.sources import exports

c = F.col


@query("dq01_key_constraints", "SELECT 'merchants' AS t, count(*) - count(DISTINCT merchant_id) AS repeated, CAST(count(*) FILTER (WHERE name IS NULL) AS BIGINT) AS nulls FROM merchants UNION ALL SELECT 'identifiers', count(*) - count(DISTINCT (merchant_id, kind, normalized)), count(*) FILTER (WHERE normalized IS NULL) FROM identifiers")
def _(v: Views) -> DataFrame:
    n = lambda df, t, keys, x: df.agg((F.count("*") - F.count_distinct(*keys)).alias("repeated"), F.count_if(c(x).isNull()).alias("nulls")).withColumn("t", F.lit(t))
    return n(v.merchants, "merchants", ["merchant_id"], "name").unionByName(n(v.identifiers, "identifiers", ["merchant_id", "kind", "normalized"], "normalized"))


_METRICS = "SELECT (SELECT count(*) FROM merchants) AS merchants, (SELECT count(*) FILTER (WHERE sentiment = 'negative') / count(*) FROM evidence WHERE independent = 1) AS negative_ratio, (SELECT count(DISTINCT platform) FROM sources) AS platforms, (SELECT count(DISTINCT category) FROM merchants) AS categories"


@query("dq02_gates", f"WITH k AS ({_METRICS}) SELECT * FROM (SELECT 'negative_ratio' AS gate, round(negative_ratio, 6) AS value, CAST(0.1 AS DOUBLE) AS bound FROM k UNION ALL SELECT 'merchants', CAST(merchants AS DOUBLE), 80.0 FROM k UNION ALL SELECT 'platforms', CAST(platforms AS DOUBLE), 4.0 FROM k UNION ALL SELECT 'categories', CAST(categories AS DOUBLE), 6.0 FROM k) WHERE value < bound")
def _(v: Views) -> DataFrame:
    metrics = audit.quality_metrics(v.merchants, v.evidence, v.sources, v.tasks, CUTOFF_2Y)
    return audit.gate_failures(metrics).where(c("gate").isin("negative_ratio", "merchants", "platforms", "categories"))


@query("dq03_hard_validator", "SELECT count(*) FILTER (WHERE n < 3) AS below_quota, count(*) AS n_merchants, CASE WHEN count(*) FILTER (WHERE n < 3) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT m.merchant_id, count(DISTINCT e.source_id) AS n FROM merchants m LEFT JOIN evidence e ON e.merchant_id = m.merchant_id AND e.independent = 1 GROUP BY 1)")
def _(v: Views) -> DataFrame:
    n = v.merchants.join(v.evidence.where("independent = 1"), "merchant_id", "left").groupBy("merchant_id").agg(F.count_distinct("source_id").alias("n"))
    return n.agg(F.count_if(c("n") < 3).alias("below_quota"), F.count("*").alias("n_merchants")).withColumn("verdict", F.when(c("below_quota") == 0, "PASS").otherwise("FAIL"))


@query(
    "dq04_structure",
    "SELECT 'missing column' AS problem, 'sources' AS t, 'web_url' AS x UNION ALL SELECT 'missing column', 'stated', 'raw_json' UNION ALL SELECT 'missing table', 'agent_runs', '' UNION ALL SELECT 'schema version', 'meta', CAST(max(o_orderkey % 3) + 1 AS VARCHAR) FROM orders HAVING max(o_orderkey % 3) + 1 < 4 UNION ALL SELECT 'repeated key', 'identifiers', '' FROM (SELECT kind, normalized FROM identifiers GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0",
)
def _(v: Views) -> DataFrame:
    """Tables and columns that a reader needs, the version that the data say, and keys that must not repeat."""
    wanted = {"sources": ("source_id", "url", "web_url"), "stated": ("evidence_id", "merchant_id", "raw_json"), "agent_runs": ("id",), "claims": ("claim_id",)}
    version = v.analyses.agg((F.max(c("analysis_id") % 3) + 1).alias("version"))
    have = {t: v.view(t) for t in ("sources", "stated", "claims", "identifiers")}
    return audit.structure(have, wanted, version, least=4, keys={"identifiers": ("kind", "normalized"), "claims": ("claim_id",)}).withColumnRenamed("table_name", "t").withColumnRenamed("detail", "x")


def _flawed(v: Views) -> dict[str, DataFrame]:
    """All tables, with owners that are gone and claims of others."""
    claim = F.when(c("evidence_id") % 97 == 3, c("claim_id") + 100).when(c("evidence_id") % 101 != 7, c("claim_id"))
    evidence = v.stated.withColumn("claim_id", claim).withColumn("merchant_id", F.when(c("evidence_id") % 41 == 2, c("merchant_id") + 1).otherwise(c("merchant_id")))
    joined = v.stated.select("claim_id", F.when(c("evidence_id") % 89 == 5, c("evidence_id") + 100000000).otherwise(c("evidence_id")).alias("evidence_id"))
    return {
        "merchants": v.merchants.where("state <> 'REQUIRES_MANUAL_REVIEW'"), "sources": v.sources.where("platform <> 'forum thread'"), "claims": v.claims.where("claim_type <> 'other'"), "evidence": evidence, "claim_evidence": joined,
        "identifiers": v.identifiers, "aliases": v.aliases, "links": v.links, "checks": v.checks, "briefs": v.briefs,
    }


_FLAWED = """p_m AS (SELECT * FROM merchants WHERE state <> 'REQUIRES_MANUAL_REVIEW'), p_s AS (SELECT * FROM sources WHERE platform <> 'forum thread'), p_c AS (SELECT * FROM claims WHERE claim_type <> 'other'),
  p_e AS (SELECT evidence_id, CASE WHEN evidence_id % 41 = 2 THEN merchant_id + 1 ELSE merchant_id END AS merchant_id, source_id, CASE WHEN evidence_id % 97 = 3 THEN claim_id + 100 WHEN evidence_id % 101 <> 7 THEN claim_id END AS claim_id, duplicate_of FROM stated), p_j AS (SELECT claim_id, CASE WHEN evidence_id % 89 = 5 THEN evidence_id + 100000000 ELSE evidence_id END AS evidence_id FROM stated)"""
_SHORT = {"evidence": "p_e", "merchants": "p_m", "sources": "p_s", "claims": "p_c", "claim_evidence": "p_j"}


def _orphans_sql() -> str:
    parts = [f"SELECT '{t}.{x} without {o}' AS check_name, 'fatal' AS severity, count(*) AS n FROM {_SHORT.get(t, t)} WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {k} FROM {_SHORT.get(o, o)})" for t, _, x, o, k in audit.REFERENCES]
    return f"WITH {_FLAWED} " + " UNION ALL ".join(parts)


@query("dq05_orphans", _orphans_sql())
def _(v: Views) -> DataFrame:
    return audit.counted(audit.reference_violations(_flawed(v)), all_=True)


@query(
    "dq05_owners",
    f"WITH {_FLAWED} SELECT 'evidence and claim owners differ' AS check_name, count(*) AS n FROM p_e JOIN p_c USING (claim_id) WHERE p_e.merchant_id <> p_c.merchant_id UNION ALL SELECT 'claim_evidence owners differ', count(*) FROM p_j JOIN p_c ON p_c.claim_id = p_j.claim_id JOIN p_e ON p_e.evidence_id = p_j.evidence_id WHERE p_e.merchant_id <> p_c.merchant_id "
    "UNION ALL SELECT 'duplicate root of another seller', count(*) FROM p_e a JOIN p_e r ON a.duplicate_of = r.evidence_id WHERE a.merchant_id <> r.merchant_id UNION ALL SELECT 'self link', count(*) FROM links WHERE left_id = right_id",
)
def _(v: Views) -> DataFrame:
    return audit.counted(audit.owner_violations(_flawed(v)), all_=True).drop("severity")


@query(
    "dq06_duplicate_chains",
    "WITH p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey = 55 THEN 1000 WHEN s_suppkey IN (71, 72) THEN 143 - s_suppkey WHEN s_suppkey = 73 THEN 72 ELSE s_suppkey - 1 END AS parent FROM supplier) SELECT id, CASE WHEN id BETWEEN 71 AND 79 THEN 'cycle' WHEN id BETWEEN 55 AND 59 THEN 'missing' END AS problem FROM p WHERE id BETWEEN 71 AND 79 OR id BETWEEN 55 AND 59",
)
def _(v: Views) -> DataFrame:
    """Chains of ten rows, with a cycle and a pointer to a row that isn't there, however many rows there are."""
    k = c("s_suppkey")
    p = v.table("supplier").select(k.alias("id"), F.when(k % 10 == 0, None).when(k == 55, -1).when(k.isin(71, 72), 143 - k).when(k == 73, 72).otherwise(k - 1).alias("parent"))
    return dedupe.chased(p, "id", "parent").where("problem is not null").select("id", "problem")


_VOCABULARY = {"merchants.state": ("fatal", STATES[:7]), "evidence.band": ("fatal", BANDS[1:]), "evidence.author_type": ("warn", AUTHORS[:6]), "evidence.claim_type": ("warn", CLAIM_TYPES[:24]), "checks.status": ("fatal", LINK_STATUS[:6])}


def _vocabulary_sql() -> str:
    names = {"evidence": "stated"}
    parts = [f"SELECT 'unknown {w}' AS check_name, '{s}' AS severity, count(*) AS n FROM {names.get(w.split('.')[0], w.split('.')[0])} WHERE {w.split('.')[1]} NOT IN ({', '.join(repr(x) for x in values)})" for w, (s, values) in _VOCABULARY.items()]
    parts += ["SELECT 'blank name', 'fatal', count(*) FROM merchants WHERE trim(name) = ''", "SELECT 'blank source', 'fatal', count(*) FROM sources WHERE trim(url) = '' OR trim(CASE WHEN source_type = 'video' THEN '' ELSE source_type END) = ''"]
    parts += ["SELECT 'evidence.confidence outside of 0 to 1', 'fatal', count(*) FROM (SELECT CASE WHEN evidence_id % 31 = 4 THEN NULL ELSE confidence * 1.02 END AS x FROM stated) WHERE x IS NULL OR x > 1 OR x < 0", "SELECT 'merchants.identity_confidence outside of 0 to 1', 'fatal', count(*) FROM merchants WHERE identity_confidence - 0.05 < 0"]
    parts += ["SELECT 'identifiers.confidence outside of 0 to 1', 'fatal', count(*) FROM identifiers WHERE confidence > 1", "SELECT 'links.confidence outside of 0 to 1', 'fatal', count(*) FROM links WHERE confidence > 1"]
    return " UNION ALL ".join(parts)


@query("dq07_vocabulary", _vocabulary_sql())
def _(v: Views) -> DataFrame:
    """Enumerated values, blank fields and ranges; some values are made wrong, so that all checks find rows."""
    wrong = v.stated.withColumn("confidence", F.when(c("evidence_id") % 31 != 4, c("confidence") * 1.02))
    tables = {"evidence": wrong, "merchants": v.merchants.withColumn("identity_confidence", c("identity_confidence") - 0.05), "identifiers": v.identifiers, "links": v.links, "checks": v.checks, "sources": v.sources.withColumn("source_type", F.when(c("source_type") != "video", c("source_type")).otherwise(""))}
    return audit.counted(audit.vocabulary_violations(tables, _VOCABULARY), all_=True)


@query(
    "dq07_analyses",
    """WITH a AS (SELECT analysis_id, merchant_id, round_no, internal_state, CASE WHEN analysis_id % 19 = 0 THEN '{broken' ELSE payload END AS payload FROM analyses WHERE internal_state <> 'OFFICIAL_WARNING' OR merchant_id % 3 <> 1), l AS (SELECT merchant_id, arg_max(internal_state, (round_no, analysis_id)) AS latest FROM a GROUP BY 1)
    SELECT 'payload is no JSON' AS check_name, count(*) FILTER (WHERE NOT json_valid(payload)) AS n FROM a UNION ALL SELECT 'payload of another version', count(*) FROM a WHERE json_valid(payload) AND analysis_id % 3 + 1 <> 1 UNION ALL SELECT 'state differs from the latest analysis', count(*) FROM merchants JOIN l USING (merchant_id) WHERE state <> latest UNION ALL SELECT 'state without analysis', count(*) FROM merchants WHERE state <> 'INSUFFICIENT_DATA' AND merchant_id NOT IN (SELECT merchant_id FROM a)""",
)
def _(v: Views) -> DataFrame:
    rows = v.analyses.where("internal_state <> 'OFFICIAL_WARNING' or merchant_id % 3 <> 1").withColumn("payload", F.when(c("analysis_id") % 19 == 0, "{broken").otherwise(c("payload")))
    return audit.counted(audit.analysis_violations(v.merchants, rows), all_=True).drop("severity")


_WEB = "CASE source_id % 6 WHEN 0 THEN '' WHEN 1 THEN replace(url, '://', ':/') ELSE url END"


@query(
    "dq08_surfaces",
    f"""WITH s AS (SELECT source_id, CASE WHEN source_id % 9 = 4 THEN concat('ftp', url) ELSE url END AS url, {_WEB} AS web_url, CASE WHEN source_id % 6 IN (0, 5) THEN 'offline' ELSE 'web' END AS access_kind FROM sources)
    SELECT 'malformed identifier' AS check_name, 'warn' AS severity, count(*) AS n FROM identifiers WHERE kind IN ('phone', 'whatsapp') AND NOT {SEARCHABLE} UNION ALL SELECT 'shared identifier', 'warn', count(*) FROM (SELECT kind, normalized FROM identifiers GROUP BY ALL HAVING count(DISTINCT merchant_id) > 1)
    UNION ALL SELECT 'unsupported source scheme', 'warn', count(*) FROM s WHERE lower(split_part(url, ':', 1)) NOT IN ('http', 'https', 'whois') UNION ALL SELECT 'malformed web link', 'fatal', count(*) FROM s WHERE source_id % 6 = 1 UNION ALL SELECT 'web link and access differ', 'fatal', count(*) FROM s WHERE (access_kind = 'web') <> (web_url <> '')
    UNION ALL SELECT 'brief without digest', 'fatal', count(*) FROM briefs WHERE evidence_set_hash = '' UNION ALL SELECT 'unresolved identity link', 'warn', count(*) FROM links WHERE relation IN ('identifier_collision', 'name_identifier_conflict')""",
)
def _(v: Views) -> DataFrame:
    k = c("source_id") % 6
    web = F.when(k == 0, "").when(k == 1, F.replace("url", F.lit("://"), F.lit(":/"))).otherwise(c("url"))
    sources = v.sources.select("source_id", F.when(c("source_id") % 9 == 4, F.concat(F.lit("ftp"), "url")).otherwise(c("url")).alias("url"), web.alias("web_url"), F.when(k.isin(0, 5), "offline").otherwise("web").alias("access_kind"))
    return audit.counted(audit.surface_violations({"identifiers": v.identifiers, "sources": sources, "briefs": v.briefs, "links": v.links}), all_=True)


@query("dq08_identifier_audit", "SELECT kind, count(*) FILTER (WHERE owners > 1) AS shared, count(*) FILTER (WHERE NOT regexp_matches(normalized, '^(https://|[+]20|LEGAL-|[a-z0-9]+@|[0-9]+ )')) AS malformed FROM (SELECT kind, normalized, count(DISTINCT merchant_id) AS owners FROM identifiers GROUP BY 1, 2) GROUP BY 1")
def _(v: Views) -> DataFrame:
    own = v.identifiers.groupBy("kind", "normalized").agg(F.count_distinct("merchant_id").alias("owners"))
    return own.groupBy("kind").agg(F.count_if(c("owners") > 1).alias("shared"), F.count_if(~c("normalized").rlike("^(https://|[+]20|LEGAL-|[a-z0-9]+@|[0-9]+ )")).alias("malformed"))


@query(
    "dq09_name_groups",
    "SELECT 'name of several entities' AS kind, lower(split_part(name, '#', 1)) AS label, count(*) AS n FROM (SELECT CASE WHEN merchant_id % 4 = 0 THEN concat('Trading Co. ', city) ELSE concat('Store ', CAST(merchant_id AS VARCHAR)) END AS name FROM merchants) GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'alias of several entities', normalized_alias, count(DISTINCT merchant_id) FROM aliases GROUP BY ALL HAVING count(DISTINCT merchant_id) > 1".replace("lower(split_part(name, '#', 1))", "lower(replace(replace(name, 'Trading Co. ', ''), 'Store ', ''))"),
)
def _(v: Views) -> DataFrame:
    named = v.merchants.select("merchant_id", F.when(c("merchant_id") % 4 == 0, F.concat(F.lit("Trading Co. "), "city")).otherwise(F.concat(F.lit("Store "), c("merchant_id").cast("string"))).alias("name"))
    found = audit.group_violations(named, v.aliases)
    return found[0][3].withColumn("kind", F.lit(found[0][0])).unionByName(found[1][3].withColumn("kind", F.lit(found[1][0]))).select("kind", "label", "n")


@query(
    "dq10_report",
    "WITH b AS (SELECT evidence_id, row_number() OVER (ORDER BY evidence_id) AS r, count(*) OVER () AS n FROM evidence WHERE trim(summary) = '') SELECT 'blank summary' AS check_name, 'warn' AS severity, max(n) AS n, concat(string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY evidence_id) FILTER (WHERE r <= 15), CASE WHEN max(n) > 15 THEN concat(' … +', CAST(max(n) - 15 AS VARCHAR), ' more') ELSE '' END) AS samples FROM b",
)
def _(v: Views) -> DataFrame:
    return audit.report([audit.finding(v.evidence.where(F.trim("summary") == ""), "blank summary", "warn", "evidence_id"), audit.finding(v.evidence.where("confidence > 1"), "range", "fatal", "evidence_id")])


@query(
    "dq11_preflight",
    "SELECT merchant_id + 1000000 AS old, 'missing' AS problem FROM merchants WHERE merchant_id % 10 = 3 UNION ALL SELECT m.merchant_id, 'target retired' FROM merchants m JOIN merchants r ON r.merchant_id = m.merchant_id + 9 WHERE m.merchant_id % 10 = 0 UNION ALL SELECT merchant_id, 'repeated' FROM merchants WHERE merchant_id % 10 = 5",
)
def _(v: Views) -> DataFrame:
    """A mapping that is sound for one entity in ten, and wrong in each way for others."""
    m, k = v.merchants.select("merchant_id"), c("merchant_id") % 10
    to = lambda rows, old, new: rows.select(old.cast("bigint").alias("old"), new.cast("bigint").alias("new"))
    retired = m.where(k == 9).select((c("merchant_id") - 9).alias("merchant_id"))
    mapping = to(m.where(k == 9), c("merchant_id"), c("merchant_id") - 8).unionByName(to(m.where(k == 3), c("merchant_id") + 1000000, c("merchant_id")))
    mapping = mapping.unionByName(to(m.join(retired, "merchant_id", "left_semi"), c("merchant_id"), c("merchant_id") + 9))
    twice = to(m.where(k == 5), c("merchant_id"), c("merchant_id") + 1).unionByName(to(m.where(k == 5), c("merchant_id"), c("merchant_id") + 2))
    return resolve.preflight(mapping.unionByName(twice), v.merchants)


def merge_tables(v: Views) -> dict[str, DataFrame]:
    """The data set that reviewed merges work on."""
    names = v.merchants.select("merchant_id", "name", "identity_confidence", "category")
    return {"merchants": names, "aliases": v.aliases.select("merchant_id", "normalized_alias"), "links": v.links, "identifiers": v.identifiers, "claims": v.claims, "evidence": v.stated, "claim_evidence": v.stated.select("claim_id", "evidence_id"), "sources": v.sources}


@query(
    "dq12_postconditions",
    """WITH r AS (SELECT merchant_id AS old, merchant_id - 9 AS new FROM merchants WHERE merchant_id % 10 = 9), e AS (SELECT evidence_id, coalesce(new, merchant_id) AS merchant_id, merchant_id AS was, source_id, claim_id, duplicate_of FROM stated LEFT JOIN r ON merchant_id = old)
    SELECT 'merchants lost or made' AS check_name, 5 AS n UNION ALL SELECT 'sources lost or made', 0 UNION ALL SELECT 'evidence lost or made', 0 UNION ALL SELECT 'retired merchants remain', (SELECT count(*) FROM r) UNION ALL SELECT 'evidence lacks a claim', (SELECT count(*) FROM e WHERE evidence_id % 7 = 3)
    UNION ALL SELECT 'evidence lacks one claim_evidence row', (SELECT count(*) FROM e WHERE evidence_id % 11 = 4) UNION ALL SELECT 'evidence and claim owners differ', (SELECT count(*) FROM e WHERE was <> merchant_id AND evidence_id % 7 <> 3) UNION ALL SELECT 'claim_evidence owners differ', (SELECT count(*) FROM e WHERE was <> merchant_id AND evidence_id % 11 <> 4)
    UNION ALL SELECT 'duplicate roots cross sellers', (SELECT count(*) FROM e a JOIN e b ON a.duplicate_of = b.evidence_id WHERE a.merchant_id <> b.merchant_id) UNION ALL SELECT 'duplicate chains remain', (SELECT count(*) FROM e a JOIN e b ON a.duplicate_of = b.evidence_id WHERE b.duplicate_of IS NOT NULL)
    UNION ALL SELECT 'self links remain', (SELECT count(*) FROM links WHERE left_id = right_id) UNION ALL SELECT 'names repeat', (SELECT count(*) FROM (SELECT category FROM merchants GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'sources have no evidence', 0""".replace("SELECT 'merchants lost or made' AS check_name, 5 AS n", "SELECT 'merchants lost or made' AS check_name, -(SELECT count(*) FROM r) AS n"),
)
def _(v: Views) -> DataFrame:
    """What the postconditions say of a merge that only rewrote the owners of observations."""
    mapping = v.merchants.where("merchant_id % 10 = 9").select(c("merchant_id").alias("old"), (c("merchant_id") - 9).alias("new"))
    before = merge_tables(v)
    half = dml.rewritten_keys(v.stated, mapping, "merchant_id").withColumn("claim_id", F.when(c("evidence_id") % 7 != 3, c("claim_id")))
    after = before | {"evidence": half, "claim_evidence": v.stated.where("evidence_id % 11 <> 4").select("claim_id", "evidence_id"), "merchants": before["merchants"].withColumn("name", c("category"))}
    return resolve.postconditions(before, after, mapping)


@query(
    "dq13_brief_validator",
    """WITH r AS (SELECT merchant_id, (SELECT min(evidence_id) FROM stated s WHERE s.merchant_id = m.merchant_id AND duplicate_of IS NULL) AS root FROM merchants m), b AS (SELECT merchant_id AS b, merchant_id % 12 AS k, CASE merchant_id % 3 WHEN 0 THEN 'identified' WHEN 1 THEN 'partial' ELSE 'unverified' END AS bound, root FROM r WHERE root IS NOT NULL)
    SELECT b AS brief_id, v.violation FROM b, LATERAL (SELECT unnest(CASE k WHEN 0 THEN [] WHEN 1 THEN ['payload must be a JSON object'] WHEN 2 THEN ['identity_message must be an object', 'unknowns must be a list of objects'] WHEN 3 THEN ['bullets must contain at most 6 items, got 7'] WHEN 4 THEN ['reputation_message.text contains a score or percentage', 'bullets[0].text contains a score or percentage'] WHEN 5 THEN ['reputation_message.text contains the verdict word موثوق', 'reputation_message.text contains the verdict word غير موثوق']
      WHEN 6 THEN ['identity_message cites evidence that is no root: x9'] WHEN 7 THEN ['identity_message.certainty is unknown'] WHEN 8 THEN CASE WHEN bound = 'partial' THEN [] ELSE ['identity_message.certainty is not the boundary'] END WHEN 9 THEN ['reputation_message.evidence_ids must not be empty', 'bullets[0].evidence_ids must be a list of strings'] WHEN 10 THEN ['identity_message.text must be a non-empty string', 'unknowns[0].text must be a non-empty string'] ELSE [] END) AS violation) v""",
)
def _(v: Views) -> DataFrame:
    """Briefs with every kind of fault, and some without; each cites the first root of its entity."""
    roots = v.stated.where("duplicate_of is null").select("merchant_id", "evidence_id")
    k = c("merchant_id") % 12
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    part = lambda text, ids, more="": F.concat(F.lit('{"text": '), text, F.lit(', "evidence_ids": '), ids, more if isinstance(more, Column) else F.lit(more), F.lit("}"))
    own = F.concat(F.lit('["'), c("root").cast("string"), F.lit('"]'))
    bound = F.when(c("merchant_id") % 3 == 0, "identified").when(c("merchant_id") % 3 == 1, "partial").otherwise("unverified")
    roles = F.when(c("merchant_id") % 3 == 0, F.array(F.lit("contact"), F.lit("registration"), F.lit("location"))).when(c("merchant_id") % 3 == 1, F.array(F.lit("location"), F.lit("marketplace_profile"))).otherwise(F.array(F.lit("location")))
    says = F.when(k == 7, "sure").when(k == 8, "partial").otherwise(bound)
    certainty = F.concat(F.lit(', "certainty": '), quoted(says))
    identity = F.when(k == 2, F.lit('"none"')).otherwise(part(F.when(k == 10, F.lit('"  "')).otherwise(F.lit('"The shop is known."')), F.when(k == 6, F.concat(F.lit('["'), c("root").cast("string"), F.lit('", "x9"]'))).otherwise(own), certainty))
    told = F.when(k == 4, F.lit('"Rated 8 / 10 by 30 buyers"')).when(k == 5, F.lit('"غير موثوق"')).otherwise(F.lit('"Reports agree about 30 of 40 orders."'))
    reputation = part(told, F.when(k == 9, F.lit("[]")).otherwise(own))
    bullet = part(F.when(k == 4, F.lit('"about 90 % late"')).otherwise(F.lit('"Late at times."')), F.when(k == 9, F.lit("[3]")).otherwise(own))
    bullets = F.concat(F.lit("["), F.array_join(F.array_repeat(bullet, F.when(k == 3, 7).otherwise(2)), ", "), F.lit("]"))
    bullets = F.when(k == 9, F.concat(F.lit("["), bullet, F.lit("]"))).when(k == 4, F.concat(F.lit("["), bullet, F.lit("]"))).otherwise(bullets)
    unknowns = F.when(k == 2, F.lit('["who"]')).when(k == 10, F.lit('[{"text": 5, "evidence_ids": []}]')).otherwise(F.lit('[{"text": "Who owns it?", "evidence_ids": []}]'))
    payload = F.concat(F.lit('{"identity_message": '), identity, F.lit(', "reputation_message": '), reputation, F.lit(', "bullets": '), bullets, F.lit(', "unknowns": '), unknowns, F.lit("}"))
    first = roots.groupBy("merchant_id").agg(F.min("evidence_id").alias("root"))
    briefs = v.merchants.join(first, "merchant_id").select(c("merchant_id").alias("brief_id"), "merchant_id", F.when(k == 1, F.lit("[1, 2]")).otherwise(payload).alias("payload"), roles.alias("roles"))
    return contracts.brief_violations(briefs, roots)


@query(
    "dq14_bilingual",
    """WITH t AS (SELECT evidence_id, coalesce(summary, '') AS summary, CASE WHEN evidence_id % 11 = 0 THEN NULL WHEN evidence_id % 11 = 1 THEN '' WHEN evidence_id % 11 = 2 THEN concat('متجر', CAST(evidence_id AS VARCHAR)) WHEN evidence_id % 11 = 3 THEN summary ELSE concat('EN ', summary, ' ', CAST(evidence_id + 1000 AS VARCHAR)) END AS content FROM evidence)
    SELECT 'missing translation' AS check_name, count(*) FILTER (WHERE content IS NULL OR trim(content) = '') AS n FROM t UNION ALL SELECT 'Arabic script in English', count(*) FILTER (WHERE evidence_id % 11 = 2) FROM t UNION ALL SELECT 'numbers lost', count(*) FILTER (WHERE evidence_id % 11 IN (2) AND len(list_filter(list_distinct(regexp_extract_all(summary, '[0-9]{3,}')), lambda x: NOT list_contains(regexp_extract_all(content, '[0-9]{3,}'), x))) > 0) FROM t UNION ALL SELECT 'untranslated', count(*) FILTER (WHERE content = summary AND trim(summary) <> '') FROM t UNION ALL SELECT 'rows', count(*) FROM t""",
)
def _(v: Views) -> DataFrame:
    """Translations that are missing, blank, in the wrong script, unchanged, or without numbers of the text."""
    k = c("evidence_id") % 11
    content = F.when(k == 0, None).when(k == 1, "").when(k == 2, F.concat(F.lit("متجر"), c("evidence_id").cast("string"))).when(k == 3, c("summary")).otherwise(F.concat(F.lit("EN "), "summary", F.lit(" "), (c("evidence_id") + 1000).cast("string")))
    return audit.translation_checks(v.evidence.select("evidence_id", "summary", content.alias("content")))


@query("dq15_manifest_equality", "SELECT 'sources' AS table_name, (SELECT count(*) FROM sources) AS n UNION ALL SELECT 'evidence', (SELECT count(*) FROM evidence)")
def _(v: Views) -> DataFrame:
    tables = {"sources": v.sources, "evidence": v.evidence}
    return exports.verified(exports.counted(tables), tables)


@query("dq16_batch_contract", "SELECT CAST(merchant_id AS VARCHAR) AS merchant_id, CASE WHEN merchant_id % 9 = 0 THEN 'missing' WHEN merchant_id % 9 = 1 THEN 'repeated' END AS problem FROM merchants WHERE merchant_id % 9 < 2 UNION ALL SELECT CAST(merchant_id + 1000000 AS VARCHAR), 'not asked for' FROM merchants WHERE merchant_id % 7 = 3 UNION ALL SELECT 'pending', 'blank' FROM merchants HAVING count(*) > 0")
def _(v: Views) -> DataFrame:
    """Results with some missing, repeated, of ids that nobody asked for, and one that has no id yet."""
    asked = v.merchants.select(c("merchant_id").cast("string").alias("merchant_id"))
    k = c("merchant_id").cast("bigint")
    got = asked.where(k % 9 != 0).select(F.concat(F.lit(" "), "merchant_id").alias("merchant_id")).unionByName(asked.where(k % 9 == 1)).unionByName(asked.where(k % 7 == 3).select((k + 1000000).cast("string").alias("merchant_id")))
    return contracts.batch_problems(asked, got.unionByName(asked.agg(F.count("*")).select(F.lit("pending").alias("merchant_id"))), "merchant_id")


@query("dq16_targeted_batch", "SELECT CAST(merchant_id AS VARCHAR) AS merchant_id, identity_confidence, concat('round of ', name) AS notes, coalesce((SELECT max(round_no) FROM analyses a WHERE a.merchant_id = m.merchant_id), 0) + 1 AS round_no FROM merchants m")
def _(v: Views) -> DataFrame:
    """A batch that holds: what the results say of curated confidence doesn't count."""
    rounds = v.analyses.groupBy("merchant_id").agg(F.max("round_no").alias("round_no"))
    stored = v.merchants.join(rounds, "merchant_id", "left").select("merchant_id", "identity_confidence", "round_no")
    results = v.merchants.select(F.concat(c("merchant_id").cast("string"), F.lit(" ")).alias("merchant_id"), F.lit(0.99).alias("identity_confidence"), F.concat(F.lit("round of "), "name").alias("notes"))
    return contracts.targeted_batch(stored, v.merchants.select("merchant_id"), results, "merchant_id", {"identity_confidence": "identity_confidence"})


@query(
    "dq17_ingest_contract",
    """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'verdict word' WHEN 1 THEN 'no link' WHEN 2 THEN 'no JSON object' END AS refused, CASE WHEN event_id % 9 > 2 THEN concat('https://x.example/', event_id) END AS source_url, CASE event_id % 9 WHEN 3 THEN 'web' WHEN 4 THEN 'forum' WHEN 5 THEN 'news' WHEN 6 THEN 'web' WHEN 7 THEN 'web' WHEN 8 THEN 'web' END AS source_platform,
      CASE event_id % 9 WHEN 3 THEN 'fine' WHEN 4 THEN 'told so' WHEN 5 THEN '' WHEN 6 THEN '' WHEN 7 THEN 'fine' WHEN 8 THEN 'fine' END AS summary, CASE event_id % 9 WHEN 3 THEN 'negative' WHEN 4 THEN 'neutral' WHEN 5 THEN 'positive' WHEN 6 THEN 'neutral' WHEN 7 THEN 'neutral' WHEN 8 THEN 'neutral' END AS sentiment, CASE event_id % 9 WHEN 3 THEN 'refund_issue' WHEN 4 THEN 'other' WHEN 5 THEN 'other' WHEN 6 THEN 'other' WHEN 7 THEN 'other' WHEN 8 THEN 'other' END AS claim_type,
      CASE event_id % 9 WHEN 3 THEN 1.0 WHEN 4 THEN 0.5 WHEN 5 THEN 0.0 WHEN 6 THEN 0.0 WHEN 7 THEN 0.8 WHEN 8 THEN 0.2 END AS confidence, CASE event_id % 9 WHEN 3 THEN 'very_strong' WHEN 4 THEN 'medium' WHEN 5 THEN 'strong' WHEN 6 THEN 'weak' WHEN 7 THEN 'strong' WHEN 8 THEN 'medium' END AS band, CASE WHEN event_id % 9 > 2 THEN event_id % 9 IN (6, 8) END AS source_only,
      CASE WHEN event_id % 9 = 7 THEN 'https://a.example/1' WHEN event_id % 9 > 2 THEN '' END AS urls, CASE event_id % 9 WHEN 7 THEN 'seen|javascript:x' WHEN 4 THEN 'alone' ELSE CASE WHEN event_id % 9 > 2 THEN '' END END AS notes FROM events""",
)
def _(v: Views) -> DataFrame:
    """Lines under all names of fields: aliases, enumerations, placeholders, bands and artifacts, and what is refused."""
    url = F.concat(F.lit('https://x.example/'), c("event_id").cast("string"))
    shapes = (
        '{"url": "%", "summary": "he is a thief"}', '{"summary": "fine", "confidence": 1}', '{"url": "%", "summary', '{"source_url": " % ", "claim": "fine", "sentiment": "Negative", "claim_type": "REFUND_ISSUE", "confidence": "7", "reliability": "moderate"}',
        '{"link": "%", "platform": "forum", "description": "told so", "tone": "mixed", "type": "rumour", "confidence": 0.5, "supporting_artifacts": "alone"}', '{"url": "%", "source_type": "news", "summary": "Source-only reference", "quote": "well", "tone": "positive", "confidence": "x", "reliability_band": "high"}',
        '{"url": "%", "summary": "  ", "confidence": -3}', '{"url": "%", "text": "fine", "confidence": 0.8, "supporting_artifacts": ["seen", "https://a.example/1", "javascript:x"]}', '{"url": "%", "text": "fine", "confidence": 0.2, "reliability_band": "moderate", "source_only": true}',
    )
    made = F.replace(F.element_at(F.array(*map(F.lit, shapes)), (c("event_id") % 9 + 1).cast("int")), F.lit("%"), url)
    out = contracts.ingested(v.table("events").select("event_id", made.alias("line")), "line", CLAIM_TYPES, AUTHORS)
    fields = [c(f"item.{x}") for x in ("source_url", "source_platform", "summary", "sentiment", "claim_type", "confidence")]
    return out.select("event_id", "refused", *fields, c("item.reliability_band").alias("band"), "item.source_only", F.array_join("item.supporting_urls", "|").alias("urls"), F.array_join("item.supporting_notes", "|").alias("notes"))


