"""Entity views over the star schema: one SQL text for Spark and for DuckDB.

The text keeps to what both dialects share. ``Views`` gives the views as DataFrames; ``duck`` puts those that a
query names in front of it as CTEs.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The time that queries treat as now, and cutoffs before it.
NOW = "2024-02-01 00:00:00"
CUTOFF_2Y, CUTOFF_30D, CUTOFF_7D = "2022-02-01 00:00:00", "2024-01-02 00:00:00", "2024-01-25 00:00:00"

# Enumerated values of the data model.
STATES = ("VERIFIED_HIGH_CONFIDENCE", "VERIFIED_MODERATE_CONFIDENCE", "MIXED_REPUTATION", "INSUFFICIENT_DATA", "IDENTITY_UNCERTAIN", "HIGH_RISK_SIGNALS", "OFFICIAL_WARNING", "REQUIRES_MANUAL_REVIEW")
CLAIM_TYPES = (
    "successful_purchase",
    "product_quality",
    "counterfeit_product_allegation",
    "non_delivery",
    "delayed_delivery",
    "refund_issue",
    "warranty_issue",
    "after_sales_support",
    "incorrect_product",
    "pricing_issue",
    "payment_dispute",
    "communication_issue",
    "repeated_recommendation",
    "official_warning",
    "verified_business_information",
    "identity_mismatch",
    "suspicious_page_changes",
    "account_page_disappearance",
    "merchant_response",
    "complaint_resolved",
    "complaint_unresolved",
    "physical_presence",
    "warranty_honored",
    "refund_issued",
    "long_business_history",
    "other",
)
AUTHORS = ("customer", "merchant", "journalist", "regulator", "registry", "anonymous", "unknown")
BANDS = ("weak", "medium", "strong", "very_strong")
KINDS = ("phone", "whatsapp", "email", "website", "facebook", "instagram", "tiktok", "google_maps", "marketplace", "commercial_register", "address")
CATEGORIES = ("Mobile phones", "home_appliances store", "Computer repair", "Grocery wholesale", "Gaming consoles", "General trade", "Car security gates")
LINK_STATUS = ("reachable", "redirected", "not_found", "access_limited", "server_error", "network_error", "not_checked")


def _pick(values: tuple[str, ...] | list[str], index: str) -> str:
    return f"split_part('{','.join(values)}', ',', CAST({index} + 1 AS INT))"


VIEWS: dict[str, str] = {
    "merchants": f"""SELECT s_suppkey AS merchant_id, s_name AS name, n_name AS city, r_name AS governorate, {_pick(CATEGORIES, "s_suppkey % 7")} AS category,
      {_pick(STATES, "s_suppkey % 8")} AS state, CAST(s_suppkey % 101 AS DOUBLE) / 100 AS identity_confidence, s_acctbal AS balance
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sources": """SELECT page_id AS source_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, split_part('web,facebook_group,marketplace,news site,forum thread', ',', CAST(page_id % 5 + 1 AS INT)) AS platform,
      split_part('official website,app store,business directory,news article,community forum,video', ',', CAST(page_id % 6 + 1 AS INT)) AS source_type FROM pages""",
    "evidence": f"""SELECT d.doc_id AS evidence_id, d.doc_id % (SELECT count(*) FROM supplier) AS merchant_id, d.doc_id % (SELECT count(*) FROM pages) AS source_id,
      {_pick(CLAIM_TYPES, "d.doc_id % 26")} AS claim_type, CASE l.quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
      {_pick(AUTHORS, "d.doc_id % 7")} AS author_type, CAST(n_chars % 101 AS DOUBLE) / 100 AS confidence, {_pick(BANDS, "n_chars % 4")} AS band,
      CASE WHEN d.doc_id % 5 = 4 THEN 0 ELSE 1 END AS independent, CASE WHEN d.doc_id % 6 = 1 THEN 1 ELSE 0 END AS verified, CASE WHEN d.doc_id % 9 = 2 THEN 1 ELSE 0 END AS transaction_evidence,
      CASE WHEN d.doc_id % 10 = 7 AND d.doc_id >= (SELECT count(*) FROM supplier) THEN d.doc_id - (SELECT count(*) FROM supplier) END AS duplicate_of,
      CASE WHEN d.doc_id % 13 = 5 THEN '' WHEN d.doc_id % 3 = 1 THEN substr(d.text, 1, CAST(floor(length(d.text) / 2) AS INT)) ELSE d.text END AS summary, CASE WHEN d.doc_id % 13 = 5 THEN d.text WHEN d.doc_id % 3 = 1 THEN substr(d.text, CAST(floor(length(d.text) / 2) AS INT) + 1) ELSE '' END AS quoted_excerpt,
      e.ts AS captured_at, CASE WHEN d.doc_id % 3 = 0 THEN NULL WHEN d.doc_id % 7 = 3 THEN e.ts - INTERVAL '800' DAY ELSE e.ts END AS published_at, d.lang
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events e ON e.event_id = d.doc_id""",
    "identifiers": f"""SELECT c_custkey AS identifier_id, c_custkey % (SELECT count(*) FROM supplier) AS merchant_id, {_pick(KINDS, "c_custkey % 11")} AS kind,
      CASE WHEN c_custkey % 11 IN (0, 1) THEN concat('+2010', lpad(CAST(c_custkey % 297 AS VARCHAR(20)), 8, '0')) WHEN c_custkey % 11 = 2 THEN concat('sales', CAST(c_custkey % 211 AS VARCHAR(20)), '@example.com')
        WHEN c_custkey % 11 = 10 THEN concat(CAST(c_custkey % 90 AS VARCHAR(20)), ' Main Street') WHEN c_custkey % 11 = 9 THEN concat('LEGAL-', CAST(c_custkey AS VARCHAR(20)))
        WHEN c_custkey % 11 IN (3, 8) AND c_custkey % 13 = 4 THEN concat('https://www.cpa.gov.eg/page', CAST(c_custkey % 5 AS VARCHAR(20))) WHEN c_custkey % 11 IN (3, 8) AND c_custkey % 13 = 5 THEN 'https://support.apple.com/' WHEN c_custkey % 11 IN (4, 5, 6) AND c_custkey % 17 = 3 THEN concat('https://', {_pick(["", "", "", "", "facebook.com", "www.instagram.com", "tiktok.com"], "c_custkey % 11")}, '/')
        ELSE concat('https://', {_pick(["", "", "", "shop.example.com", "facebook.com", "instagram.com", "tiktok.com", "maps.google.com", "play.google.com"], "c_custkey % 11")}, '/', {_pick(["acct", "", "Item"], "c_custkey % 3")}, CAST(c_custkey % 173 AS VARCHAR(20))) END AS normalized,
      CAST(c_nationkey AS DOUBLE) / 25 AS confidence FROM customer""",
    "links": """SELECT o_orderkey AS link_id, least(o_custkey % (SELECT count(*) FROM supplier), (o_custkey * 7 + 3) % (SELECT count(*) FROM supplier)) AS left_id, greatest(o_custkey % (SELECT count(*) FROM supplier), (o_custkey * 7 + 3) % (SELECT count(*) FROM supplier)) AS right_id,
      CASE WHEN o_orderkey % 1501 = 7 THEN 'name_identifier_conflict' ELSE split_part('branch_of,same_owner,identifier_collision', ',', CAST(o_orderkey % 3 + 1 AS INT)) END AS relation, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence FROM orders""",
    "tasks": """SELECT o_orderkey AS task_id, o_custkey % (SELECT count(*) FROM supplier) AS merchant_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_progress' ELSE 'unresolved' END AS status,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority, o_orderdate AS created_at, o_custkey AS owner, o_orderkey % 4 AS attempts,
      CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE concat('check ', o_orderpriority) END AS title, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS instruction, o_totalprice AS cost FROM orders""",
    "checks": f"""SELECT event_id AS check_id, user_id AS source_id, {_pick(LINK_STATUS, "event_id % 7")} AS status, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 403 WHEN 4 THEN 503 END AS http_status, ts AS checked_at, value FROM events""",
    "aliases": "SELECT p_partkey AS alias_id, p_partkey % (SELECT count(*) FROM supplier) AS merchant_id, concat(p_name, ' ', p_brand) AS alias, lower(p_name) AS normalized_alias, p_size AS weight FROM part",
    "analyses": f"""SELECT o_orderkey AS analysis_id, o_custkey % (SELECT count(*) FROM supplier) AS merchant_id, o_orderkey % 7 AS round_no, {_pick(STATES, "(o_orderkey + o_custkey) % 8")} AS internal_state,
      concat('{{"version":', CAST(o_orderkey % 3 + 1 AS VARCHAR(20)), ',"certainty":"', o_orderpriority, '","n":', CAST(o_custkey AS VARCHAR(20)), '}}') AS payload FROM orders""",
    "stated": f"""SELECT doc_id AS evidence_id, doc_id % (SELECT count(*) FROM supplier) AS merchant_id, doc_id % (SELECT count(*) FROM pages) AS source_id, doc_id % (SELECT count(*) FROM supplier) * 100 + doc_id % 26 AS claim_id, {_pick(CLAIM_TYPES, "doc_id % 26")} AS claim_type,
      CASE WHEN doc_id % 10 = 7 AND doc_id >= (SELECT count(*) FROM supplier) THEN doc_id - (SELECT count(*) FROM supplier) END AS duplicate_of, CAST(n_chars % 101 AS DOUBLE) / 100 AS confidence, {_pick(BANDS, "n_chars % 4")} AS band, {_pick(AUTHORS, "doc_id % 7")} AS author_type FROM documents""",
    "claims": f"""SELECT DISTINCT merchant_id * 100 + k AS claim_id, merchant_id, {_pick(CLAIM_TYPES, "k")} AS claim_type FROM (SELECT doc_id % (SELECT count(*) FROM supplier) AS merchant_id, doc_id % 26 AS k FROM documents)""",
    "briefs": "SELECT s_suppkey AS brief_id, CASE WHEN s_suppkey % 10 = 3 THEN s_suppkey + 100000000 ELSE s_suppkey END AS merchant_id, CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE s_name END AS evidence_set_hash FROM supplier",
    "translations": "SELECT doc_id AS record_id, 'evidence' AS table_name, 'summary' AS field, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE 'ar' END AS lang, concat('EN ', text) AS content FROM documents",
}
_NAMES = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def duck(body: str) -> str:
    """``body`` (a SELECT, or CTEs and a SELECT) with the views it names in front."""
    named = [v for v in VIEWS if v in set(_NAMES.findall(body))]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in named)
    body = body.strip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) else ""
    rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else None
    if not ctes:
        return body
    return f"WITH {recursive}{ctes}, {rest}" if rest else f"WITH {ctes} {body}"


class Views:
    """The tables of one directory and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stamp(self, name: str) -> tuple[int, int]:
        """Bytes and last change of a table's file or folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files.getContentSummary(path).getLength(), files.getFileStatus(path).getModificationTime()

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {t: self.table(t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
        text = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(text, **used)

    merchants = cached_property(lambda self: self.view("merchants"))
    sources = cached_property(lambda self: self.view("sources"))
    evidence = cached_property(lambda self: self.view("evidence"))
    identifiers = cached_property(lambda self: self.view("identifiers"))
    links = cached_property(lambda self: self.view("links"))
    tasks = cached_property(lambda self: self.view("tasks"))
    checks = cached_property(lambda self: self.view("checks"))
    aliases = cached_property(lambda self: self.view("aliases"))
    analyses = cached_property(lambda self: self.view("analyses"))
    stated = cached_property(lambda self: self.view("stated"))
    claims = cached_property(lambda self: self.view("claims"))
    briefs = cached_property(lambda self: self.view("briefs"))
    translations = cached_property(lambda self: self.view("translations"))
