"""Assessments of an entity by fixed rules: identity, warnings, reputation, eligibility, locators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.urls import identifier_role, is_searchable_identifier

# Claim types by what they say.
RISK = ("identity_mismatch", "counterfeit_product_allegation", "account_page_disappearance")
NEGATIVE = ("refund_issue", "delayed_delivery", "complaint_unresolved", "communication_issue", "pricing_issue", "product_quality", "warranty_issue", "identity_mismatch", "counterfeit_product_allegation", "account_page_disappearance")
POSITIVE = ("successful_purchase", "refund_issued", "complaint_resolved", "warranty_honored", "long_business_history", "verified_business_information", "repeated_recommendation", "physical_presence", "merchant_response", "after_sales_support")
# Limits, states, and what pages that keep robots out say.
STALE_DAYS = 730
VERIFIED_STATES = ("VERIFIED_HIGH_CONFIDENCE", "VERIFIED_MODERATE_CONFIDENCE")
ANTI_BOT = ("captcha", "recaptcha", "cf-browser-verification", "enable javascript and cookies to continue", "access denied", "are you a robot", "unusual traffic")
HEAD_REFUSED = (405, 501, 403)
# Roles that establish an identity and that support one, claims that a page as a whole may carry, notes
# on links, and words of errors that tell of a spent quota.
HIGH_ROLES, SUPPORTING_ROLES = ("contact", "owned_site", "social_profile", "registration"), ("marketplace_profile", "location")
IDENTITY_CLAIMS = ("verified_business_information", "physical_presence", "contact_information", "store_identity", "official_warning", "company_profile")
NOTES = {"dead": "Original post no longer reachable", "sent_home": "Redirect resolved to site root; original path kept", "vendor_page": "Vendor page — the specific post is not publicly linkable"}
VENDOR_LABEL = "Vendor page"
QUOTA_MARKERS = ("provider rate limit", "usage limit", "usage_limit", "resource_exhausted", "rate limit", "429")


def is_warning() -> Column:
    """A warning that somebody other than the entity gave."""
    by_office = (F.col("author_type") == "regulator") & F.col("claim_type").isin(*NEGATIVE)
    return (F.col("author_type") != "merchant") & ((F.col("claim_type") == "official_warning") | by_office)


def is_risk() -> Column:
    return F.col("claim_type").isin(*RISK) & (F.col("author_type") != "merchant")


def direction() -> Column:
    """negative, positive or neutral: negative claim types and sentiments count first."""
    bad = F.col("claim_type").isin(*NEGATIVE) | (F.col("sentiment") == "negative")
    return F.when(bad, "negative").when(F.col("claim_type").isin(*POSITIVE) | (F.col("sentiment") == "positive"), "positive").otherwise("neutral")


def identity(merchants: DataFrame, identifiers: DataFrame, links: DataFrame) -> DataFrame:
    """(merchant_id, identity): established, supported or uncertain by the distinct roles of its searchable
    identifiers; uncertain by its state, or by a link that tells of a name with another's identifier."""
    kind, value = F.col("kind"), F.col("normalized")
    shown = identifiers.where(is_searchable_identifier(kind, value)).withColumn("role", identifier_role(kind, value))
    n = lambda roles: F.count_distinct(F.when(F.col("role").isin(*roles), F.col("role")))
    roles = shown.groupBy("merchant_id").agg(n(HIGH_ROLES).alias("high"), n(SUPPORTING_ROLES).alias("some"))
    torn = links.where("relation = 'name_identifier_conflict'").select(F.explode(F.array("left_id", "right_id")).alias("merchant_id")).distinct().withColumn("torn", F.lit(True))
    high, some = F.coalesce("high", F.lit(0)), F.coalesce("some", F.lit(0))
    level = F.when((F.col("state") == "IDENTITY_UNCERTAIN") | F.col("torn").isNotNull(), "uncertain").when(high >= 2, "established").when((high >= 1) | (some >= 2), "supported").otherwise("uncertain")
    return merchants.join(roles, "merchant_id", "left").join(torn, "merchant_id", "left").select("merchant_id", level.alias("identity"))


#: Headlines in order of precedence, the state that each shows, and the rows that it stands on.
HEADLINES = {
    "identity_uncertain": ("IDENTITY_UNCERTAIN", "notable"),
    "no_evidence": ("INSUFFICIENT_DATA", None),
    "dated_warning": ("OFFICIAL_WARNING", "warning"),
    "warning": ("OFFICIAL_WARNING", "warning"),
    "state_without_evidence": ("REQUIRES_MANUAL_REVIEW", None),
    "risk": ("HIGH_RISK_SIGNALS", "risk"),
    "conflicting": ("MIXED_REPUTATION", "notable"),
    "negative": ("MIXED_REPUTATION", "negative"),
    "positive": ("MIXED_REPUTATION", "positive"),
    "neutral": ("INSUFFICIENT_DATA", "notable"),
}


def _signals() -> dict[str, Column]:
    """Which rows each headline may stand on."""
    return {"notable": (F.col("verified") == 1) | (F.col("transaction_evidence") == 1), "warning": is_warning(), "risk": is_risk(), "negative": direction() == "negative", "positive": direction() == "positive"}


def reputation(merchants: DataFrame, evidence: DataFrame, now: str) -> DataFrame:
    """(merchant_id, kind, headline, warnings, oldest_warning_days, oldest_warning, negative, positive, n_evidence,
    caveat) by the rules' precedence, over rows that are no duplicates."""
    signals = _signals()
    age = F.greatest(F.lit(0), F.round((F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("published_at").cast("timestamp"))) / F.lit(86400000.0)).cast("long"))
    age = F.when(F.col("published_at").isNotNull(), age)
    dated = evidence.where("duplicate_of is null").withColumns(signals).withColumn("_age", F.when(F.col("warning"), age))
    n = dated.groupBy("merchant_id").agg(
        F.count("*").alias("rows"),
        F.max("_age").alias("oldest_warning_days"),
        F.min_by("evidence_id", F.when(F.col("_age").isNotNull(), F.struct(-F.col("_age"), F.col("evidence_id")))).alias("oldest_warning"),
        *[F.count_if(F.col(x)).alias(f"n_{x}") for x in signals],
    )
    m = merchants.join(n, "merchant_id", "left").na.fill(0, ["rows", *[f"n_{x}" for x in signals]])
    tests = {
        "identity_uncertain": F.col("state") == "IDENTITY_UNCERTAIN",
        "no_evidence": F.col("rows") == 0,
        "dated_warning": (F.col("n_warning") > 0) & (F.coalesce("oldest_warning_days", F.lit(0)) > STALE_DAYS),
        "warning": F.col("n_warning") > 0,
        "state_without_evidence": F.col("state") == "OFFICIAL_WARNING",
        "risk": F.col("n_risk") > 0,
        "conflicting": (F.col("n_negative") > 0) & (F.col("n_positive") > 0),
        "negative": F.col("n_negative") > 0,
        "positive": F.col("n_positive") > 0,
        "neutral": F.lit(True),
    }
    headline = F.coalesce(*[F.when(t, name) for name, t in tests.items()])
    of = lambda at: F.create_map(*[x for name, pair in HEADLINES.items() for x in (F.lit(name), F.lit(pair[at]))])
    counts = F.create_map(*[x for name in signals for x in (F.lit(name), F.col(f"n_{name}"))])
    m = m.withColumn("headline", headline).withColumns({"kind": of(0)[F.col("headline")], "stands_on": of(1)[F.col("headline")]})
    caveat = ~F.col("headline").isin("no_evidence", "positive") & ((F.col("headline") != "neutral") | (F.col("n_notable") > 0))
    return m.select("merchant_id", "kind", "headline", F.col("n_warning").alias("warnings"), "oldest_warning_days", "oldest_warning", F.col("n_negative").alias("negative"), F.col("n_positive").alias("positive"), F.coalesce(counts[F.col("stands_on")], F.lit(0)).alias("n_evidence"), caveat.alias("caveat"))


def reputation_evidence(assessed: DataFrame, evidence: DataFrame) -> DataFrame:
    """(merchant_id, evidence_id): the rows that each entity's headline (of ``reputation``) stands on."""
    of = F.create_map(*[x for name, pair in HEADLINES.items() for x in (F.lit(name), F.lit(pair[1]))])
    signals = _signals()
    held = F.create_map(*[x for name, test in signals.items() for x in (F.lit(name), test)])
    rows = evidence.where("duplicate_of is null").withColumn("held", held)
    return rows.join(assessed.select("merchant_id", of[F.col("headline")].alias("stands_on")), "merchant_id").where(F.try_element_at("held", F.col("stands_on"))).select("merchant_id", "evidence_id")


def positive_eligibility(merchants: DataFrame, evidence: DataFrame, identities: DataFrame) -> DataFrame:
    """(merchant_id, sources, adverse, eligible): verified, identified entities with two positive sources and no
    adverse row at all, duplicates included. ``evidence`` has a column ``source_key``."""
    ok = (F.col("independent") == 1) & F.col("duplicate_of").isNull() & (F.col("sentiment") == "positive")
    adverse = (F.col("author_type") != "merchant") & (direction() == "negative") | is_warning() | is_risk()
    n = evidence.groupBy("merchant_id").agg(F.count_distinct(F.when(ok, F.col("source_key"))).alias("sources"), F.bool_or(adverse).alias("adverse"))
    rows = merchants.join(identities, "merchant_id").join(n, "merchant_id", "left").na.fill({"sources": 0, "adverse": False})
    sound = F.col("state").isin(*VERIFIED_STATES) & (F.col("identity") != "uncertain")
    return rows.select("merchant_id", "sources", "adverse", (sound & (F.col("sources") >= 2) & ~F.col("adverse")).alias("eligible"))


def link_status(status: Column, final_differs: Column, hops: Column, exhausted: Column, excerpt: Column) -> Column:
    """What a recorded probe of a link shows, in order of precedence."""
    wall = F.exists(F.array(*map(F.lit, ANTI_BOT)), lambda m: F.contains(F.lower(F.coalesce(excerpt, F.lit(""))), m))
    fine = status.between(200, 299)
    return (
        F.when(exhausted, "redirected")
        .when(status.isNull(), "network_error")
        .when(fine & wall, "access_limited")
        .when(fine & (hops > 0) & final_differs, "redirected")
        .when(fine, "reachable")
        .when(status.isin(404, 410), "not_found")
        .when(status.isin(401, 403, 429), "access_limited")
        .when(status.between(300, 399), F.when(final_differs, "redirected").otherwise("reachable"))
        .when(status >= 500, "server_error")
        .otherwise("access_limited")
    )


def followed(hops: DataFrame, most: int = 3) -> DataFrame:
    """(url, final, n_hops, exhausted) over recorded redirects (url, target): up to ``most`` of them are followed."""
    state = hops.select("url", F.col("target").alias("final"), F.when(F.col("target").isNull(), 0).otherwise(1).alias("n_hops"))
    state = state.withColumn("final", F.coalesce("final", "url"))
    nxt = hops.where("target is not null").select(F.col("url").alias("final"), F.col("target").alias("then"))
    for _ in range(most - 1):
        state = state.join(nxt, "final", "left").select("url", F.coalesce("then", "final").alias("final"), (F.col("n_hops") + F.when(F.col("then").isNotNull(), 1).otherwise(0)).alias("n_hops"))
    last = state.join(nxt, "final", "left")
    return last.select("url", "final", "n_hops", F.col("then").isNotNull().alias("exhausted"))


def deep_resolution(sources: DataFrame, checks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each source (source_id, web_url, canonical_url, locator_note, source_label) after its link check
    (source_id, status, final_url), with what was done: dead, sent_home, upgraded, vendor_page, identity_skipped.

    Notes are only written where there is none. An upgraded link takes the deeper address; it takes its canonical
    form too unless a source has that already or one of smaller id is upgraded to it.
    """
    from tallystone.functions.urls import canonical_url, depth, is_deeper_url, is_redirect_to_home, is_social_host, is_vendor_page

    url, final, status, no = F.col("web_url"), F.col("final_url"), F.col("status"), F.lit(False)
    claims = evidence.groupBy("source_id").agg(F.bool_or(~F.col("claim_type").isin(*IDENTITY_CLAIMS)).alias("says_more"))
    rows = sources.where("trim(web_url) <> ''").join(checks.select("source_id", "status", "final_url"), "source_id", "left").join(claims, "source_id", "left")
    free = F.trim(F.coalesce("locator_note", F.lit(""))) == ""
    moved = F.coalesce((status == "redirected") & (final != url), no)
    rows = rows.withColumns(
        {
            "dead": F.coalesce(status.isin("not_found", "dead", "access_limited"), no) & free,
            "sent_home": moved & is_redirect_to_home(url, final) & free,
            "upgraded": moved & ~is_redirect_to_home(url, final) & is_deeper_url(url, final),
            "identity_skipped": (depth(url) <= 1) & ~F.coalesce("says_more", no),
            "page": is_social_host(url) & F.coalesce("says_more", no) & is_vendor_page(url),
        }
    )
    wanted = rows.where("upgraded").select("source_id", canonical_url(final).alias("wanted"))
    held = sources.select(F.col("canonical_url").alias("wanted"), F.col("source_id").alias("holder"))
    first = wanted.groupBy("wanted").agg(F.min("source_id").alias("source_id"))
    granted = first.join(held, "wanted", "left").where("holder is null or holder = source_id").select("source_id", F.col("wanted").alias("new_canonical"))
    rows = rows.join(granted, "source_id", "left")
    note = F.when(free & F.col("dead"), NOTES["dead"]).when(free & F.col("sent_home"), NOTES["sent_home"]).when(free & F.col("page"), NOTES["vendor_page"]).otherwise(F.trim(F.coalesce("locator_note", F.lit(""))))
    named = F.trim(F.coalesce("source_label", F.lit("")))
    label = F.when(F.col("page") & (named == ""), VENDOR_LABEL).otherwise(named)
    untold = free & ~F.col("dead") & ~F.col("sent_home")
    return rows.select(
        "source_id",
        F.when(F.col("upgraded"), final).otherwise(url).alias("web_url"),
        F.coalesce("new_canonical", "canonical_url").alias("canonical_url"),
        note.alias("locator_note"),
        label.alias("source_label"),
        "dead",
        (F.col("sent_home") & ~F.col("dead")).alias("sent_home"),
        "upgraded",
        (F.col("page") & (untold | (named == ""))).alias("vendor_page"),
        "identity_skipped",
    )


def outcome(error: Column, text: Column) -> Column:
    """How a drafting session ended, by the error field and the text of its last message."""
    low = F.lower(F.coalesce(error, F.lit("")))
    spent = reduce(or_, [F.contains(low, F.lit(w)) for w in QUOTA_MARKERS])
    return F.when(low != "", F.when(spent, "QUOTA").otherwise("error")).when(F.coalesce(text, F.lit("")).rlike("\\S"), "drafted").otherwise("empty")


def is_resolved(still_unresolved: Column, n_evidence: Column, supported: Column, contradicted: Column) -> Column:
    """Whether a finding settles its task: it isn't open, has evidence, and says whether it supports or contradicts."""
    return ~still_unresolved & (n_evidence > 0) & (supported.isNotNull() | contradicted.isNotNull())


def caveats(coverage: Column, age_days: Column, source_only: Column) -> Column:
    """Names of the notes that a page of an entity carries, in order."""
    notes = F.array(F.when(coverage.isin("none", "limited"), "limited_coverage"), F.when(age_days > STALE_DAYS, "stale_data"), F.when(source_only > 0, "source_only"))
    return F.filter(notes, lambda x: x.isNotNull())


def community_clamped(confidence: Column, band: Column) -> tuple[Column, Column]:
    """Confidence and band of community posts: 0.8 at most, and medium for strong."""
    return F.least(confidence, F.lit(0.8)), F.when(band == "strong", "medium").otherwise(band)
