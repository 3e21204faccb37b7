"""Rule tables: inventory R."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions import urls as U
from tallystone.functions.values import age_days
from tallystone.operators import assess, directory, resolve, taxonomy
from tallystone.plans.filters import SEARCHABLE
from tallystone.plans.registry import query
from tallystone.plans.views import NOW, Views

c = F.col


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in values)


#: A searchable identifier's role, by the rules of pf21.
_ROLE = "CASE kind WHEN 'phone' THEN 'contact' WHEN 'whatsapp' THEN 'contact' WHEN 'email' THEN 'contact' WHEN 'website' THEN 'owned_site' WHEN 'facebook' THEN 'social_profile' WHEN 'instagram' THEN 'social_profile' WHEN 'tiktok' THEN 'social_profile' WHEN 'marketplace' THEN 'marketplace_profile' WHEN 'google_maps' THEN 'location' WHEN 'address' THEN 'location' WHEN 'commercial_register' THEN 'registration' END"
IDENTITY_SQL = f"""SELECT merchant_id, CASE WHEN state = 'IDENTITY_UNCERTAIN' OR merchant_id IN (SELECT left_id FROM links WHERE relation = 'name_identifier_conflict' UNION SELECT right_id FROM links WHERE relation = 'name_identifier_conflict') THEN 'uncertain' WHEN coalesce(high, 0) >= 2 THEN 'established' WHEN coalesce(high, 0) >= 1 OR coalesce(some_n, 0) >= 2 THEN 'supported' ELSE 'uncertain' END AS identity
  FROM merchants LEFT JOIN (SELECT merchant_id, count(DISTINCT role) FILTER (WHERE role IN ('contact', 'owned_site', 'social_profile', 'registration')) AS high, count(DISTINCT role) FILTER (WHERE role IN ('marketplace_profile', 'location')) AS some_n FROM (SELECT merchant_id, {_ROLE} AS role FROM identifiers WHERE {SEARCHABLE}) GROUP BY 1) USING (merchant_id)"""


@query("r01_identity", IDENTITY_SQL)
def _(v: Views) -> DataFrame:
    return assess.identity(v.merchants, v.identifiers, v.links)


_WARN = f"(author_type <> 'merchant' AND (claim_type = 'official_warning' OR (author_type = 'regulator' AND claim_type IN ({_in(assess.NEGATIVE)}))))"
_RISK = f"(claim_type IN ({_in(assess.RISK)}) AND author_type <> 'merchant')"
_NEG = f"(claim_type IN ({_in(assess.NEGATIVE)}) OR sentiment = 'negative')"
_POS = f"(NOT {_NEG} AND (claim_type IN ({_in(assess.POSITIVE)}) OR sentiment = 'positive'))"


@query("r02_warnings_and_risks", f"SELECT evidence_id, {_WARN} AS warning, {_RISK} AS risk FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("evidence_id", assess.is_warning().alias("warning"), assess.is_risk().alias("risk"))


@query("r03_directions", f"SELECT merchant_id, count(*) FILTER (WHERE {_NEG}) AS negative, count(*) FILTER (WHERE {_POS}) AS positive FROM evidence WHERE duplicate_of IS NULL GROUP BY 1")
def _(v: Views) -> DataFrame:
    d = assess.direction()
    return v.evidence.where("duplicate_of is null").groupBy("merchant_id").agg(F.count_if(d == "negative").alias("negative"), F.count_if(d == "positive").alias("positive"))


_LIVE = "duplicate_of IS NULL"


_NOTABLE = "(verified = 1 OR transaction_evidence = 1)"
_REPUTATION = f"""n AS (SELECT merchant_id, count(*) AS k, count(*) FILTER (WHERE {_WARN}) AS warnings, max(age) FILTER (WHERE {_WARN}) AS oldest_warning_days, arg_min(evidence_id, (-age, evidence_id)) FILTER (WHERE {_WARN} AND age IS NOT NULL) AS oldest_warning,
      count(*) FILTER (WHERE {_RISK}) AS risks, count(*) FILTER (WHERE {_NEG}) AS negative, count(*) FILTER (WHERE {_POS}) AS positive, count(*) FILTER (WHERE {_NOTABLE}) AS notable FROM (SELECT *, CASE WHEN published_at IS NOT NULL THEN greatest(0, CAST(round((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(published_at)) / 86400000.0) AS BIGINT)) END AS age FROM evidence WHERE {_LIVE}) GROUP BY 1),
    h AS (SELECT merchant_id, warnings, oldest_warning_days, oldest_warning, negative, positive, risks, notable, CASE WHEN state = 'IDENTITY_UNCERTAIN' THEN 'identity_uncertain' WHEN coalesce(k, 0) = 0 THEN 'no_evidence' WHEN warnings > 0 AND coalesce(oldest_warning_days, 0) > 730 THEN 'dated_warning' WHEN warnings > 0 THEN 'warning' WHEN state = 'OFFICIAL_WARNING' THEN 'state_without_evidence'
      WHEN risks > 0 THEN 'risk' WHEN negative > 0 AND positive > 0 THEN 'conflicting' WHEN negative > 0 THEN 'negative' WHEN positive > 0 THEN 'positive' ELSE 'neutral' END AS headline FROM merchants LEFT JOIN n USING (merchant_id))"""


@query(
    "r04_reputation",
    f"""WITH {_REPUTATION} SELECT merchant_id, headline, CASE headline WHEN 'identity_uncertain' THEN 'IDENTITY_UNCERTAIN' WHEN 'no_evidence' THEN 'INSUFFICIENT_DATA' WHEN 'neutral' THEN 'INSUFFICIENT_DATA' WHEN 'dated_warning' THEN 'OFFICIAL_WARNING' WHEN 'warning' THEN 'OFFICIAL_WARNING' WHEN 'state_without_evidence' THEN 'REQUIRES_MANUAL_REVIEW' WHEN 'risk' THEN 'HIGH_RISK_SIGNALS' ELSE 'MIXED_REPUTATION' END AS kind,
      coalesce(warnings, 0) AS warnings, oldest_warning_days, oldest_warning, coalesce(negative, 0) AS negative, coalesce(positive, 0) AS positive, coalesce(CASE headline WHEN 'identity_uncertain' THEN notable WHEN 'conflicting' THEN notable WHEN 'neutral' THEN notable WHEN 'dated_warning' THEN warnings WHEN 'warning' THEN warnings WHEN 'risk' THEN risks WHEN 'negative' THEN negative WHEN 'positive' THEN positive END, 0) AS n_evidence,
      headline NOT IN ('no_evidence', 'positive') AND (headline <> 'neutral' OR notable > 0) AS caveat FROM h""",
)
def _(v: Views) -> DataFrame:
    return assess.reputation(v.merchants, v.evidence, NOW)


@query(
    "r04_reputation_evidence",
    f"WITH {_REPUTATION} SELECT merchant_id, evidence_id FROM evidence JOIN h USING (merchant_id) WHERE {_LIVE} AND CASE headline WHEN 'identity_uncertain' THEN {_NOTABLE} WHEN 'conflicting' THEN {_NOTABLE} WHEN 'neutral' THEN {_NOTABLE} WHEN 'dated_warning' THEN {_WARN} WHEN 'warning' THEN {_WARN} WHEN 'risk' THEN {_RISK} WHEN 'negative' THEN {_NEG} WHEN 'positive' THEN {_POS} ELSE false END",
)
def _(v: Views) -> DataFrame:
    return assess.reputation_evidence(assess.reputation(v.merchants, v.evidence, NOW), v.evidence)


@query(
    "r05_positive_eligible",
    f"""WITH i AS ({{IDENTITY}}), n AS (SELECT merchant_id, count(DISTINCT CASE WHEN independent = 1 AND duplicate_of IS NULL AND sentiment = 'positive' THEN url END) AS k, bool_or((author_type <> 'merchant' AND {_NEG}) OR {_WARN} OR {_RISK}) AS adverse FROM evidence JOIN sources USING (source_id) GROUP BY 1)
    SELECT merchant_id, coalesce(k, 0) AS sources, coalesce(adverse, false) AS adverse, state IN ('VERIFIED_HIGH_CONFIDENCE', 'VERIFIED_MODERATE_CONFIDENCE') AND identity <> 'uncertain' AND coalesce(k, 0) >= 2 AND NOT coalesce(adverse, false) AS eligible FROM merchants JOIN i USING (merchant_id) LEFT JOIN n USING (merchant_id)""".replace("{IDENTITY}", IDENTITY_SQL),
)
def _(v: Views) -> DataFrame:
    keyed = v.evidence.join(v.sources.select("source_id", c("url").alias("source_key")), "source_id")
    return assess.positive_eligibility(v.merchants, keyed, assess.identity(v.merchants, v.identifiers, v.links))


@query("r06_category_tags", "SELECT merchant_id, CASE category WHEN 'Mobile phones' THEN ['mobile_telecom'] WHEN 'home_appliances store' THEN ['home_appliances'] WHEN 'Computer repair' THEN ['computers_it', 'repair_services'] WHEN 'Grocery wholesale' THEN ['grocery_retail'] WHEN 'Gaming consoles' THEN ['gaming'] WHEN 'Car security gates' THEN ['automotive', 'security_smart_home'] ELSE ['other'] END AS tags FROM merchants")
def _(v: Views) -> DataFrame:
    return v.merchants.select("merchant_id", taxonomy.category_tags(c("category")).alias("tags"))


@query("r07_governorates", "SELECT merchant_id, CASE merchant_id % 4 WHEN 0 THEN 'cairo' WHEN 1 THEN 'port_said' WHEN 2 THEN 'giza' END AS key FROM merchants")
def _(v: Views) -> DataFrame:
    k = c("merchant_id") % 4
    return v.merchants.select("merchant_id", taxonomy.governorate(F.when(k == 0, "New Cairo City").when(k == 1, " PORT SAID ").when(k == 2, "محافظة الجيزة").otherwise(c("governorate"))).alias("key"))


@query(
    "r08_source_category",
    "SELECT evidence_id, CASE WHEN platform = 'facebook_group' THEN 'forum_community' WHEN author_type IN ('regulator', 'registry') THEN 'public_authority' WHEN author_type = 'merchant' THEN 'merchant_owned' WHEN author_type = 'customer' THEN 'customer_report' WHEN author_type = 'journalist' THEN 'news' WHEN source_type = 'official website' THEN 'merchant_site' WHEN source_type = 'app store' THEN 'marketplace' WHEN source_type = 'business directory' THEN 'directory' WHEN source_type = 'community forum' THEN 'forum_community' WHEN source_type = 'video' THEN 'social' WHEN source_type = 'news article' THEN 'news' ELSE 'other' END AS category FROM evidence JOIN sources USING (source_id)",
)
def _(v: Views) -> DataFrame:
    return v.evidence.join(v.sources, "source_id").select("evidence_id", taxonomy.source_category(c("url"), c("platform"), c("author_type"), c("source_type")).alias("category"))


@query("r09_link_status", "SELECT check_id, CASE WHEN check_id % 11 = 0 THEN 'redirected' WHEN http_status IS NULL THEN 'network_error' WHEN http_status = 200 AND check_id % 5 = 0 THEN 'access_limited' WHEN http_status = 200 AND check_id % 7 = 0 THEN 'redirected' WHEN http_status = 200 THEN 'reachable' WHEN http_status = 404 THEN 'not_found' WHEN http_status = 403 THEN 'access_limited' WHEN http_status = 301 THEN CASE WHEN check_id % 7 = 0 THEN 'redirected' ELSE 'reachable' END ELSE 'server_error' END AS status FROM checks")
def _(v: Views) -> DataFrame:
    k = c("check_id")
    return v.checks.select("check_id", assess.link_status(c("http_status"), k % 7 == 0, F.when(k % 7 == 0, 1).otherwise(0), k % 11 == 0, F.when(k % 5 == 0, "Are you a ROBOT?").otherwise("hello")).alias("status"))


@query("r10_redirects", "SELECT p_partkey, CASE WHEN p_partkey % 50 < 4 THEN p_partkey - p_partkey % 50 ELSE p_partkey - 3 END AS final, CAST(least(p_partkey % 50, 3) AS INTEGER) AS n_hops, p_partkey % 50 > 3 AS exhausted FROM part")
def _(v: Views) -> DataFrame:
    """Chains of up to 49 redirects."""
    hops = v.table("part").select(c("p_partkey").alias("url"), F.when(c("p_partkey") % 50 > 0, c("p_partkey") - 1).alias("target"))
    return assess.followed(hops).select(c("url").alias("p_partkey"), "final", "n_hops", "exhausted")


@query(
    "r11_deep_resolution",
    """WITH e AS (SELECT source_id, bool_or(claim_type NOT IN ('verified_business_information', 'physical_presence', 'contact_information', 'store_identity', 'official_warning', 'company_profile')) AS more FROM evidence GROUP BY 1),
      k AS (SELECT source_id, source_id % 9 AS k, CAST(source_id AS VARCHAR) AS i, coalesce(more, false) AS more, source_id % 4 = 3 AS noted FROM sources LEFT JOIN e USING (source_id)), t AS (SELECT source_id AS other FROM sources WHERE source_id % 9 = 5)
    SELECT source_id, CASE k WHEN 4 THEN concat('https://shop', i, '.example/a/b/c') WHEN 5 THEN concat('https://shop', i, '.example/a/b') WHEN 6 THEN concat('https://shop', CAST(source_id - 1 AS VARCHAR), '.example/a/b') WHEN 7 THEN concat('https://www.facebook.com/shop.', i) WHEN 8 THEN concat('https://shop', i, '.example/a') WHEN 3 THEN concat('https://shop', i, '.example/a/b') ELSE concat('https://shop', i, '.example/a/b') END AS web_url,
      CASE WHEN k = 4 THEN concat('https://shop', i, '.example/a/b/c') WHEN k = 6 AND NOT EXISTS (SELECT 1 FROM t WHERE other = source_id - 1) THEN concat('https://shop', CAST(source_id - 1 AS VARCHAR), '.example/a/b') WHEN k = 6 THEN concat('https://old', i, '.example') WHEN k = 7 THEN concat('https://facebook.com/shop.', i) WHEN k = 8 THEN concat('https://shop', i, '.example/a') ELSE concat('https://shop', i, '.example/a/b') END AS canonical_url,
      CASE WHEN noted THEN 'seen by hand' WHEN k IN (0, 1) THEN 'Original post no longer reachable' WHEN k IN (2, 3) THEN 'Redirect resolved to site root; original path kept' WHEN k = 7 AND more THEN 'Vendor page — the specific post is not publicly linkable' ELSE '' END AS locator_note,
      CASE WHEN k = 7 AND more THEN 'Vendor page' ELSE '' END AS source_label, k IN (0, 1) AND NOT noted AS dead, k IN (2, 3) AND NOT noted AS sent_home, k IN (4, 6) AS upgraded, k = 7 AND more AS vendor_page, k IN (6, 7, 8) AND NOT more AS identity_skipped FROM k""",
)
def _(v: Views) -> DataFrame:
    """By source: dead, refused, sent to a home page and to that of a language, upgraded, left alone, upgraded to an
    address that its neighbour has, a page of an account, a page that isn't deep; every fourth has a note already."""
    k, i = c("source_id") % 9, c("source_id").cast("string")
    site = lambda name, way: F.concat(F.lit(f"https://{name}"), i, F.lit(f".example{way}"))
    url = F.when(k == 6, site("old", "")).when(k == 7, F.concat(F.lit("https://www.facebook.com/shop."), i)).when(k == 8, site("shop", "/a")).otherwise(site("shop", "/a/b"))
    sources = v.sources.select("source_id", url.alias("web_url"), U.canonical_url(url).alias("canonical_url"), F.when(c("source_id") % 4 == 3, "seen by hand").alias("locator_note"), F.lit(None).cast("string").alias("source_label"))
    taken = F.concat(F.lit("https://shop"), (c("source_id") - 1).cast("string"), F.lit(".example/a/b"))
    final = F.when(k == 2, site("shop", "/")).when(k == 3, site("shop", "/ar-EG")).when(k == 4, site("shop", "/a/b/c")).when(k == 6, taken)
    status = F.when(k == 0, "not_found").when(k == 1, "access_limited").when(k.isin(2, 3, 4, 6), "redirected").otherwise("reachable")
    checks = v.sources.select("source_id", status.alias("status"), final.alias("final_url"))
    return assess.deep_resolution(sources, checks, v.evidence.select("source_id", "claim_type"))


@query("r12_community_clamp", "SELECT evidence_id, least(confidence, 0.8) AS confidence, CASE WHEN band = 'strong' THEN 'medium' ELSE band END AS band FROM evidence")
def _(v: Views) -> DataFrame:
    score, band = assess.community_clamped(c("confidence"), c("band"))
    return v.evidence.select("evidence_id", score.alias("confidence"), band.alias("band"))


@query("r13_location_label", "SELECT merchant_id, CASE merchant_id % 3 WHEN 0 THEN concat(city, '، ', governorate) WHEN 1 THEN governorate ELSE 'Egypt' END AS label FROM merchants")
def _(v: Views) -> DataFrame:
    k = c("merchant_id") % 3
    return v.merchants.select("merchant_id", directory.location_label(F.when(k == 0, c("city")).when(k == 1, c("governorate")).otherwise(""), F.when(k < 2, c("governorate")).otherwise(""), F.lit("")).alias("label"))


@query(
    "r14_caveats",
    f"SELECT merchant_id, list_filter([CASE WHEN sources <= 2 THEN 'limited_coverage' END, CASE WHEN age > 730 THEN 'stale_data' END, CASE WHEN source_only > 0 THEN 'source_only' END], lambda x: x IS NOT NULL) AS caveats FROM (SELECT merchant_id, count(DISTINCT source_id) FILTER (WHERE duplicate_of IS NULL) AS sources, CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(max(published_at) FILTER (WHERE duplicate_of IS NULL))) / 86400000.0 + 0.5) AS BIGINT) AS age, count(*) FILTER (WHERE trim(summary) = '' AND trim(quoted_excerpt) = '') AS source_only FROM evidence GROUP BY 1)",
)
def _(v: Views) -> DataFrame:
    own = directory.coverage(v.evidence)
    bare = v.evidence.groupBy("merchant_id").agg(F.count_if((F.trim("summary") == "") & (F.trim("quoted_excerpt") == "")).alias("source_only"))
    return own.join(bare, "merchant_id").select("merchant_id", assess.caveats(c("coverage"), age_days(c("latest_published"), NOW, whole=False), c("source_only")).alias("caveats"))


@query("r15_resolved_findings", "SELECT task_id, CASE WHEN status <> 'unresolved' AND coalesce(n, 0) > 0 AND (task_id % 3 = 0 OR task_id % 5 = 0) THEN 'done' ELSE 'unresolved' END AS status FROM tasks LEFT JOIN (SELECT merchant_id, count(*) AS n FROM evidence WHERE verified = 1 GROUP BY 1) USING (merchant_id)")
def _(v: Views) -> DataFrame:
    """A finding of each task: what it supports or contradicts is known for some, and its entity's verified rows are its evidence."""
    found = v.evidence.where("verified = 1").groupBy("merchant_id").agg(F.count("*").alias("n"))
    supported, contradicted = F.when(c("task_id") % 3 == 0, c("task_id") % 2 == 0), F.when(c("task_id") % 5 == 0, c("task_id") % 2 == 1)
    settled = assess.is_resolved(c("status") == "unresolved", F.coalesce("n", F.lit(0)), supported, contradicted)
    return v.tasks.join(found, "merchant_id", "left").select("task_id", F.when(settled, "done").otherwise("unresolved").alias("status"))


@query("r16_attachment", "SELECT analysis_id, CASE WHEN analysis_id % 3 = 0 THEN m.merchant_id WHEN analysis_id % 3 = 1 THEN n.by_name END AS attached FROM analyses a LEFT JOIN merchants m ON m.merchant_id = a.merchant_id LEFT JOIN (SELECT lower(name) AS low, min(merchant_id) AS by_name FROM merchants GROUP BY 1) n ON n.low = lower(concat('SUPPLIER#', lpad(CAST(a.merchant_id AS VARCHAR), 9, '0')))")
def _(v: Views) -> DataFrame:
    k = c("analysis_id") % 3
    given = v.analyses.select("analysis_id", F.when(k == 0, c("merchant_id")).alias("id"), F.when(k == 1, F.concat(F.lit("SUPPLIER#"), F.lpad(c("merchant_id").cast("string"), 9, "0"))).otherwise("no such name").alias("name"))
    return resolve.attached(given, v.merchants).select("analysis_id", "attached")


@query(
    "r17_session_outcome",
    "SELECT conv_id, turn, CASE WHEN conv_id % 6 IN (0, 1) THEN 'QUOTA' WHEN conv_id % 6 = 2 THEN 'error' WHEN conv_id % 6 = 3 THEN 'empty' WHEN conv_id % 6 = 5 OR trim(text) <> '' THEN 'drafted' ELSE 'empty' END AS outcome FROM conversations",
)
def _(v: Views) -> DataFrame:
    """Errors of each kind with and without a text, and texts that speak of quotas without an error."""
    k = c("conv_id") % 6
    error = F.when(k == 0, "HTTP 429 from the provider").when(k == 1, "RESOURCE_EXHAUSTED: try later").when(k == 2, "Connection reset").when(k == 4, "")
    return v.table("conversations").select("conv_id", "turn", assess.outcome(error, F.when(k == 3, " \n").when(k == 5, F.concat("text", F.lit(" the rate limit is 429"))).otherwise(c("text"))).alias("outcome"))
