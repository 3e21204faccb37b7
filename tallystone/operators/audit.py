"""Metrics, gates and audits of a dataset."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions.text import canonical_name
from tallystone.functions.urls import is_http_url, is_searchable_identifier
from tallystone.functions.values import ratio

# Limits of the quality gates; "least" and "most" say which way.
GATES = {
    "merchants": ("least", 80.0),
    "identity_resolution": ("least", 0.45),
    "multi_source_ratio": ("least", 0.30),
    "positive_ratio": ("least", 0.20),
    "negative_ratio": ("least", 0.10),
    "neutral_ratio": ("least", 0.05),
    "high_or_medium_ratio": ("least", 0.40),
    "duplicate_rate": ("most", 0.45),
    "stale_ratio": ("most", 0.50),
    "cities": ("least", 4.0),
    "categories": ("least", 6.0),
    "platforms": ("least", 4.0),
}


def quality_metrics(merchants: DataFrame, evidence: DataFrame, sources: DataFrame, tasks: DataFrame, cutoff: str) -> DataFrame:
    """One row of counts and ratios; each table is read once."""
    n = F.count("*")
    share = lambda cond: F.round(ratio(F.count_if(cond), n), 6)
    filled = lambda x: F.count_distinct(F.nullif(F.trim(x), F.lit("")))
    m = merchants.agg(n.alias("merchants"), share(F.col("identity_confidence") >= 0.45).alias("identity_resolution"), filled("city").alias("cities"), filled("category").alias("categories"))
    one = F.col("independent") == 1
    tests = {f"{s}_ratio": F.col("sentiment") == s for s in ("positive", "negative", "neutral")}
    tests |= {"high_ratio": F.col("band").isin("strong", "very_strong"), "medium_ratio": F.col("band") == "medium", "stale_ratio": F.coalesce(F.col("published_at") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))}
    # counts by entity first, so that entities of several sources need no second pass
    own = evidence.groupBy("merchant_id").agg(n.alias("rows"), F.count_if(one).alias("primary"), F.count("duplicate_of").alias("dup"), F.count_distinct(F.when(one, F.col("source_id"))).alias("sources"), *[F.count_if(one & t).alias(name) for name, t in tests.items()])
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    shares = [F.round(ratio(total(name), total("primary")), 6).alias(name) for name in tests]
    e = own.agg(total("rows").alias("evidence"), F.round(ratio(total("dup"), total("rows")), 6).alias("duplicate_rate"), total("primary").alias("primary_rows"), F.count_if(F.col("sources") >= 2).alias("multi"), *shares)
    s = sources.agg(filled("platform").alias("platforms"))
    t = tasks.agg(F.count_if(F.col("status").isin("pending", "unresolved", "in_progress")).alias("pending_tasks"))
    out = m
    for part in (e, s, t):
        out = out.join(F.broadcast(part))  # one row each
    return out.withColumn("multi_source_ratio", F.round(ratio(F.col("multi"), F.col("merchants")), 6)).drop("multi")


def gate_failures(metrics: DataFrame) -> DataFrame:
    """(gate, value, bound) of every gate that the metrics fail."""
    m = metrics.withColumn("high_or_medium_ratio", F.col("high_ratio") + F.col("medium_ratio"))
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.lit(way).alias("way"), F.lit(bound).alias("bound")) for g, (way, bound) in GATES.items()])
    gates = m.select(F.explode(rows).alias("g")).select("g.*")
    return gates.where(F.when(F.col("way") == "least", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))).select("gate", "value", "bound")


def finding(rows: DataFrame, check: str, severity: str, sample: str, most: int = 15) -> DataFrame:
    """(check_name, severity, n, samples) of the rows that violate a check; samples are the least ones."""
    cell = F.col(sample).cast("string")
    top = rows.orderBy(F.col(sample)).limit(most).agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("k"), cell.alias("s"))))["s"], ",").alias("shown"))
    n = rows.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.col("shown"), F.lit(" … +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.col("shown"))
    return n.join(F.broadcast(top)).select(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), "n", more.alias("samples"))


def report(findings: list[DataFrame]) -> DataFrame:
    """All findings of at least one row."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.where("n > 0")


# ---------------------------------------------------------------- audits of whole data sets

#: Which column of which table names rows of which other table: (table, its id, column, table named, its id).
REFERENCES = (
    ("evidence", "evidence_id", "merchant_id", "merchants", "merchant_id"),
    ("evidence", "evidence_id", "source_id", "sources", "source_id"),
    ("evidence", "evidence_id", "claim_id", "claims", "claim_id"),
    ("claims", "claim_id", "merchant_id", "merchants", "merchant_id"),
    ("identifiers", "identifier_id", "merchant_id", "merchants", "merchant_id"),
    ("aliases", "alias_id", "merchant_id", "merchants", "merchant_id"),
    ("links", "link_id", "left_id", "merchants", "merchant_id"),
    ("links", "link_id", "right_id", "merchants", "merchant_id"),
    ("claim_evidence", "evidence_id", "claim_id", "claims", "claim_id"),
    ("claim_evidence", "claim_id", "evidence_id", "evidence", "evidence_id"),
    ("checks", "check_id", "source_id", "sources", "source_id"),
    ("briefs", "brief_id", "merchant_id", "merchants", "merchant_id"),
)
# Links that await review, and schemes of sources.
UNSAFE_RELATIONS = ("identifier_collision", "name_identifier_conflict")
SOURCE_SCHEMES = ("http", "https", "whois")


def structure(tables: dict[str, DataFrame], wanted: dict[str, tuple[str, ...]], version: DataFrame, *, least: int, keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """(problem, table_name, detail): tables and columns that are missing, a schema version (one row: version) below
    the least, and tables whose key repeats."""
    gone = [("missing table", t, "") for t in wanted if t not in tables]
    gone += [("missing column", t, x) for t, names in wanted.items() if t in tables for x in names if x not in tables[t].columns]
    row = lambda problem, t, detail: (F.lit(problem).alias("problem"), F.lit(t).alias("table_name"), detail.alias("detail"))
    old = version.where(F.col("version") < least).select(*row("schema version", "meta", F.col("version").cast("string")))
    out = old.unionByName(version.sparkSession.createDataFrame(gone, "problem string, table_name string, detail string"))
    for t, key in keys.items():
        twice = tables[t].groupBy(*key).count().where("count > 1").limit(1)
        out = out.unionByName(twice.select(*row("repeated key", t, F.lit(""))))
    return out


Violations = list[tuple[str, str, str, DataFrame]]  # (check, severity, column of samples, rows)


def reference_violations(tables: dict[str, DataFrame]) -> Violations:
    """Rows that name a row which isn't there, for the tables at hand; a null names nothing."""
    out: Violations = []
    for table, own_id, column, other, key in REFERENCES:
        if table in tables and other in tables:
            known = tables[other].select(F.col(key).alias(column))
            gone = tables[table].where(F.col(column).isNotNull()).join(known, column, "left_anti")
            out.append((f"{table}.{column} without {other}", "fatal", own_id, gone))
    return out


def owner_violations(tables: dict[str, DataFrame]) -> Violations:
    """Observations and claims of different entities that belong together, and entities linked to themselves."""
    claims, evidence = tables["claims"].select("claim_id", F.col("merchant_id").alias("owner")), tables["evidence"].select("evidence_id", F.col("merchant_id").alias("own"))
    of_claim = tables["evidence"].join(claims, "claim_id").where("merchant_id <> owner")
    joined = tables["claim_evidence"].join(claims, "claim_id").join(evidence, "evidence_id").where("owner <> own")
    roots = evidence.select(F.col("evidence_id").alias("duplicate_of"), F.col("own").alias("root_owner"))
    crossed = tables["evidence"].join(roots, "duplicate_of").where("merchant_id <> root_owner")
    return [
        ("evidence and claim owners differ", "fatal", "evidence_id", of_claim),
        ("claim_evidence owners differ", "fatal", "evidence_id", joined),
        ("duplicate root of another seller", "fatal", "evidence_id", crossed),
        ("self link", "fatal", "link_id", tables["links"].where("left_id = right_id")),
    ]


def vocabulary_violations(tables: dict[str, DataFrame], words: dict[str, tuple[str, tuple[str, ...]]]) -> Violations:
    """Values outside of ``words`` ("table.column" -> (severity, values)), blank names and links, and confidences
    outside of 0 to 1 (of observations, none either)."""
    out: Violations = []
    ids = {"evidence": "evidence_id", "merchants": "merchant_id", "sources": "source_id", "identifiers": "identifier_id", "links": "link_id", "claims": "claim_id", "checks": "check_id"}
    for where, (severity, values) in words.items():
        table, column = where.split(".")
        out.append((f"unknown {where}", severity, ids[table], tables[table].where(~F.col(column).isin(*values))))
    blank = lambda *cs: reduce(or_, [F.trim(x) == "" for x in cs])
    out.append(("blank name", "fatal", "merchant_id", tables["merchants"].where(blank("name"))))
    out.append(("blank source", "fatal", "source_id", tables["sources"].where(blank("url", "source_type"))))
    for table, column in (("evidence", "confidence"), ("merchants", "identity_confidence"), ("identifiers", "confidence"), ("links", "confidence")):
        wrong = ~F.col(column).between(0, 1)
        out.append((f"{table}.{column} outside of 0 to 1", "fatal", ids[table], tables[table].where(F.coalesce(wrong, F.lit(table == "evidence")))))
    return out


def analysis_violations(merchants: DataFrame, analyses: DataFrame, version: int = 1) -> Violations:
    """Payloads that are no JSON object or of another version, states that differ from the latest analysis, and
    states other than that of too little data without any analysis."""
    payload = F.try_parse_json("payload")
    held = F.try_variant_get(payload, "$.version", "bigint")
    latest = analyses.groupBy("merchant_id").agg(F.max_by("internal_state", F.struct("round_no", "analysis_id")).alias("latest"))
    unlike = merchants.join(latest, "merchant_id").where("state <> latest")
    without = merchants.where("state <> 'INSUFFICIENT_DATA'").join(analyses.select("merchant_id"), "merchant_id", "left_anti")
    return [
        ("payload is no JSON", "fatal", "analysis_id", analyses.where(payload.isNull())),
        ("payload of another version", "fatal", "analysis_id", analyses.where(payload.isNotNull() & ~held.eqNullSafe(F.lit(version)))),
        ("state differs from the latest analysis", "fatal", "merchant_id", unlike),
        ("state without analysis", "fatal", "merchant_id", without),
    ]


def surface_violations(tables: dict[str, DataFrame]) -> Violations:
    """Identifiers, links and briefs: phones of no Egyptian shape, values of several owners, schemes, web links that
    are none or disagree with how a source is reached, briefs without a digest."""
    phones = tables["identifiers"].where(F.col("kind").isin("phone", "whatsapp") & ~is_searchable_identifier(F.col("kind"), F.col("normalized")))
    shared = tables["identifiers"].groupBy("kind", "normalized").agg(F.count_distinct("merchant_id").alias("n"), F.min("identifier_id").alias("identifier_id")).where("n > 1")
    sources = tables["sources"]
    scheme = F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = F.coalesce("web_url", F.lit("")) != ""
    return [
        ("malformed identifier", "warn", "identifier_id", phones),
        ("shared identifier", "warn", "identifier_id", shared),
        ("unsupported source scheme", "warn", "source_id", sources.where(~scheme.isin(*SOURCE_SCHEMES))),
        ("malformed web link", "fatal", "source_id", sources.where(web & ~is_http_url(F.col("web_url")))),
        ("web link and access differ", "fatal", "source_id", sources.where((F.col("access_kind") == "web") != web)),
        ("brief without digest", "fatal", "brief_id", tables["briefs"].where(F.coalesce("evidence_set_hash", F.lit("")) == "")),
        ("unresolved identity link", "warn", "link_id", tables["links"].where(F.col("relation").isin(*UNSAFE_RELATIONS))),
    ]


def group_violations(merchants: DataFrame, aliases: DataFrame) -> Violations:
    """Names of several entities, by the normalised name and by aliases."""
    names = merchants.groupBy(canonical_name(F.col("name")).alias("label")).agg(F.count("*").alias("n")).where("n > 1")
    shared = aliases.groupBy(F.col("normalized_alias").alias("label")).agg(F.count_distinct("merchant_id").alias("n")).where("n > 1")
    return [("name of several entities", "warn", "label", names), ("alias of several entities", "warn", "label", shared)]


def counted(violations: Violations, *, all_: bool = False) -> DataFrame:
    """(check_name, severity, n) of each check that found something, or of all of them."""
    out = None
    for check, severity, _, rows in violations:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(check).alias("check_name"), F.lit(severity).alias("severity"), "n")
        out = one if out is None else out.unionByName(one)
    return out if all_ else out.where("n > 0")


def audited(violations: Violations) -> DataFrame:
    """The report: (check_name, severity, n, samples)."""
    return report([finding(rows, check, severity, sample) for check, severity, sample, rows in violations])


def translation_checks(rows: DataFrame) -> DataFrame:
    """(check_name, n) over texts (summary) and their English translations (content): missing ones, Arabic letters in
    them, numbers of three or more digits of a text that its translation lacks, texts left as they were, and all rows."""
    content, summary = F.coalesce("content", F.lit("")), F.coalesce("summary", F.lit(""))
    there = F.trim(content) != ""
    numbers = lambda x: F.regexp_extract_all(x, F.lit("[0-9]{3,}"), F.lit(0))
    tests = {
        "missing translation": ~there,
        "Arabic script in English": there & content.rlike("[\\x{0600}-\\x{06FF}]"),
        "numbers lost": there & (F.size(F.array_except(numbers(summary), numbers(content))) > 0),
        "untranslated": there & (content == summary),
        "rows": F.lit(True),
    }
    one = rows.agg(*[F.count_if(t).alias(name) for name, t in tests.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(f"`{name}`").alias("n")) for name in tests])).alias("r")).select("r.*")
