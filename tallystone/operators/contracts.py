"""Contracts of documents that others write: briefs against the evidence they cite, and lines to ingest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import values as V
from tallystone.functions.text import has_forbidden_label, is_placeholder_summary
from tallystone.operators.assess import HIGH_ROLES, SUPPORTING_ROLES

# The most bullets of a brief, words and forms of a verdict, and degrees of certainty.
MOST_BULLETS = 6
VERDICT_WORDS = ("مضمون", "موثوق", "غير موثوق")
SCORES = ("\\d+\\s*%", "\\b\\d+\\s*/\\s*(?:10|100)\\b", "\\b\\d+\\s*من\\s*(?:10|100)\\b")
CERTAINTIES = ("identified", "partial", "unverified")


def certainty_boundary(roles: Column) -> Column:
    """What an array of identifier roles allows to say of an identity."""
    n = lambda of: F.size(F.array_intersect(roles, F.array(*map(F.lit, of))))
    return F.when(n(HIGH_ROLES) >= 2, "identified").when((n(HIGH_ROLES) >= 1) | (n(SUPPORTING_ROLES) >= 2), "partial").otherwise("unverified")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a variant; null for what isn't there."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


_SECTION = "array<struct<name: string, v: variant, may_be_empty: boolean>>"


def _section(name: Column, value: Column, may_be_empty: bool) -> Column:
    return F.struct(name.alias("name"), value.alias("v"), F.lit(may_be_empty).alias("may_be_empty"))


def _numbered(name: str, may_be_empty: bool) -> Callable[[Column, Column], Column]:
    return lambda x, i: _section(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")), x, may_be_empty)


def brief_violations(briefs: DataFrame, roots: DataFrame) -> DataFrame:
    """(brief_id, violation): what keeps a brief (brief_id, merchant_id, payload: JSON, roles) from being published.

    ``roots``: merchant_id, evidence_id of the observations that may be cited. Each message, bullet and unknown has a
    text without verdicts and scores and cites root evidence of its entity; unknowns may cite none; the certainty is
    the one that the roles allow. A brief without violations has no row.
    """
    at = lambda path: F.try_variant_get("p", path, "variant")
    parsed = briefs.withColumn("p", F.try_parse_json("payload"))
    is_object = F.coalesce(_kind(F.col("p")) == "OBJECT", F.lit(False))
    rows = parsed.where(is_object)
    found = parsed.where(~is_object).select("brief_id", F.lit("payload must be a JSON object").alias("violation"))

    def told(cond: Column, violation: Column | str) -> DataFrame:
        return rows.where(F.coalesce(cond, F.lit(False))).select("brief_id", F.lit(violation).alias("violation") if isinstance(violation, str) else violation.alias("violation"))

    none = F.array().cast(_SECTION)
    sections = none
    for name in ("identity_message", "reputation_message"):
        good = _kind(at(f"$.{name}")) == "OBJECT"
        found = found.unionByName(told(~F.coalesce(good, F.lit(False)), f"{name} must be an object"))
        sections = F.concat(sections, F.when(good, F.array(_section(F.lit(name), at(f"$.{name}"), False))).otherwise(none))
    for name, empty in (("bullets", False), ("unknowns", True)):
        items = F.try_variant_get("p", f"$.{name}", "array<variant>")
        good = (_kind(at(f"$.{name}")) == "ARRAY") & F.forall(items, lambda x: _kind(x) == "OBJECT")
        found = found.unionByName(told(~F.coalesce(good, F.lit(False)), f"{name} must be a list of objects"))
        each = F.transform(items, _numbered(name, empty))
        sections = F.concat(sections, F.when(F.coalesce(good, F.lit(False)), each).otherwise(none))
        if name == "bullets":
            found = found.unionByName(told(good & (F.size(items) > MOST_BULLETS), F.concat(F.lit(f"bullets must contain at most {MOST_BULLETS} items, got "), F.size(items).cast("string"))))
    says = F.try_variant_get("p", "$.identity_message.certainty", "string")
    known = says.isin(*CERTAINTIES)
    has_identity = _kind(at("$.identity_message")) == "OBJECT"
    found = found.unionByName(told(has_identity & ~F.coalesce(known, F.lit(False)), "identity_message.certainty is unknown"))
    found = found.unionByName(told(has_identity & known & (says != certainty_boundary(F.col("roles"))), "identity_message.certainty is not the boundary"))

    parts = rows.select("brief_id", "merchant_id", F.explode(sections).alias("s")).select("brief_id", "merchant_id", "s.name", "s.may_be_empty", F.try_variant_get("s.v", "$.text", "variant").alias("t"), F.try_variant_get("s.v", "$.evidence_ids", "variant").alias("e"))
    parts = parts.withColumn("text", F.when(_kind(F.col("t")) == "STRING", F.try_variant_get("t", "$", "string")))
    listed = (_kind(F.col("e")) == "ARRAY") & F.forall(F.try_variant_get("e", "$", "array<variant>"), lambda x: _kind(x) == "STRING")
    parts = parts.withColumn("ids", F.when(F.coalesce(listed, F.lit(False)), F.try_variant_get("e", "$", "array<string>")))
    blank = ~F.coalesce(F.col("text").rlike("\\S"), F.lit(False))
    tests = [(blank, ".text must be a non-empty string")]
    tests += [(~blank & F.contains("text", F.lit(w)), f".text contains the verdict word {w}") for w in VERDICT_WORDS]
    tests += [(~blank & reduce(or_, [F.col("text").rlike(p) for p in SCORES]), ".text contains a score or percentage")]
    tests += [(F.col("ids").isNull(), ".evidence_ids must be a list of strings"), ((F.size("ids") == 0) & ~F.col("may_be_empty"), ".evidence_ids must not be empty")]
    for cond, what in tests:
        found = found.unionByName(parts.where(F.coalesce(cond, F.lit(False))).select("brief_id", F.concat("name", F.lit(what)).alias("violation")))
    cited = parts.select("brief_id", "merchant_id", "name", F.explode("ids").alias("id"))
    strange = cited.join(roots.select("merchant_id", F.col("evidence_id").cast("string").alias("id")), ["merchant_id", "id"], "left_anti")
    return found.unionByName(strange.select("brief_id", F.concat("name", F.lit(" cites evidence that is no root: "), "id").alias("violation")))


class BatchRefused(ValueError):
    """A batch of results that isn't one for each requested id; nothing of it has been taken over."""


def batch_problems(requested: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, problem): requested ids without a result or with several, and results of ids that are blank or weren't
    asked for. Ids are compared without the white space around them."""
    asked = requested.select(F.trim(F.col(key).cast("string")).alias(key)).distinct()
    got = results.select(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias(key)).groupBy(key).agg(F.count("*").alias("n"))
    both = asked.withColumn("asked", F.lit(True)).join(got, key, "full")
    problem = F.when(F.col(key).isin("", "pending"), "blank").when(F.col("asked").isNull(), "not asked for").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def targeted_batch(stored: DataFrame, requested: DataFrame, results: DataFrame, key: str, curated: dict[str, str]) -> DataFrame:
    """The results of a batch as they may be stored: one for each requested id, or the whole batch is refused. Fields
    that are curated (field -> column of ``stored``) come from there, whatever a result says; rounds go on by one."""
    if found := batch_problems(requested, results, key).limit(20).collect():
        raise BatchRefused("; ".join(f"{r[key]}: {r['problem']}" for r in found))
    own = stored.select(F.col(key).cast("string").alias(key), *[F.col(c).alias(f"_own_{f}") for f, c in curated.items()], F.col("round_no").alias("_last"))
    rows = results.withColumn(key, F.trim(F.col(key).cast("string"))).join(own, key, "left")
    return rows.withColumns({**{f: F.col(f"_own_{f}") for f in curated}, "round_no": F.coalesce("_last", F.lit(0)) + 1}).drop("_last", *[f"_own_{f}" for f in curated])


def ingested(lines: DataFrame, line: str, claim_types: tuple[str, ...], authors: tuple[str, ...]) -> DataFrame:
    """``lines`` with the fields of an observation (column ``item``) or why it is refused (``refused``).

    Fields come under any of their names; unknown values of enumerations fall back; confidence is cut to 0 to 1 and
    raises its band; a summary that is a placeholder is empty, and an observation without summary and quote tells of
    its source only. Refused: lines that are no JSON object, observations without a link, and verdict words.
    """
    v = F.try_parse_json(line)
    text = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("_v", f"$.{n}", "string"), F.lit("")) for n in names], F.lit(""))
    known = lambda x, values, other: F.when(F.lower(x).isin(*values), F.lower(x)).otherwise(other)
    rows = lines.withColumn("_v", v)
    summary, quote = text("summary", "claim", "description", "text"), text("raw_quote", "quote")
    summary = F.when(is_placeholder_summary(summary), "").otherwise(summary)
    confidence = V.confidence(text("confidence"))
    band = V.coerced(text("reliability_band", "reliability"), V.BANDS, V.BAND_ALIASES, "weak")
    band = V.promoted_band(band, confidence)
    artifacts = F.coalesce(F.try_variant_get("_v", "$.supporting_artifacts", "array<string>"), F.when(text("supporting_artifacts") != "", F.array(text("supporting_artifacts"))), F.array().cast("array<string>"))
    is_link = lambda x: F.coalesce(x.rlike("^(?i)https?://[^/\\s]+\\S*$"), F.lit(False))
    url = F.trim(text("source_url", "url", "link"))
    item = F.struct(
        url.alias("source_url"),
        F.coalesce(F.nullif(text("source_platform", "platform", "source_type"), F.lit("")), F.lit("web")).alias("source_platform"),
        summary.alias("summary"),
        quote.alias("raw_quote"),
        known(text("sentiment", "tone"), V.SENTIMENTS, "neutral").alias("sentiment"),
        known(text("claim_type", "type"), claim_types, "other").alias("claim_type"),
        known(text("author_type"), authors, "unknown").alias("author_type"),
        confidence.alias("confidence"),
        band.alias("reliability_band"),
        (F.coalesce(F.try_variant_get("_v", "$.source_only", "boolean"), F.lit(False)) | ((F.trim(summary) == "") & (F.trim(quote) == ""))).alias("source_only"),
        F.filter(artifacts, is_link).alias("supporting_urls"),
        F.filter(artifacts, lambda x: ~is_link(x)).alias("supporting_notes"),
    )
    refused = F.when(~F.coalesce(_kind(F.col("_v")) == "OBJECT", F.lit(False)), "no JSON object").when(url == "", "no link").when(has_forbidden_label(summary), "verdict word")
    return rows.withColumn("refused", refused).withColumn("item", F.when(F.col("refused").isNull(), item)).drop("_v")
