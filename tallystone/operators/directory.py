"""The directory: coverage, rank vectors, filters, facets and pages over one row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.urls import canonical_url, is_http_url
from tallystone.operators.numbering import numbered

COVERAGE = ("none", "limited", "moderate", "broad")
PAGE_SIZE = 20


def coverage_level(sources: Column) -> Column:
    """Bands of distinct non-duplicate sources."""
    return F.when(sources == 0, "none").when(sources <= 2, "limited").when(sources <= 5, "moderate").otherwise("broad")


def coverage(evidence: DataFrame, key: str = "merchant_id") -> DataFrame:
    """Per entity: rows, non-duplicate rows, distinct sources, verified and undated rows, latest times, band."""
    live = F.col("duplicate_of").isNull()
    n = evidence.groupBy(key).agg(
        F.count("*").alias("total"),
        F.count_if(live).alias("non_duplicate"),
        F.count_distinct(F.when(live, F.col("source_id"))).alias("sources"),
        F.count_if(live & (F.col("verified") == 1)).alias("reviewed"),
        F.count_if(live & F.col("published_at").isNull()).alias("undated"),
        F.max(F.when(live, F.col("published_at"))).alias("latest_published"),
        F.max(F.when(live, F.col("captured_at"))).alias("latest_captured"),
    )
    return n.withColumn("coverage", coverage_level(F.col("sources")))


def sentiments(evidence: DataFrame, key: str = "merchant_id") -> DataFrame:
    """Per entity: positive, negative and neutral non-duplicate rows, and duplicates."""
    live = F.col("duplicate_of").isNull()
    counts = [F.count_if(live & (F.col("sentiment") == s)).alias(s) for s in ("positive", "negative", "neutral")]
    return evidence.groupBy(key).agg(*counts, F.count_if(~live).alias("duplicates"))


def source_key(url: Column) -> Column:
    """What counts as one source: the canonical link; null for what is no web link."""
    return F.when(is_http_url(url), F.regexp_replace(canonical_url(url), "#.*$", ""))


def positive_rank(evidence: DataFrame, key: str = "merchant_id") -> DataFrame:
    """Per entity: distinct sources of independent rows by five conditions, and the newest positive time.
    ``evidence`` has a column ``source_key``."""
    ok = (F.col("independent") == 1) & F.col("duplicate_of").isNull() & F.col("source_key").isNotNull()
    positive = ok & (F.col("sentiment") == "positive")
    n = lambda cond: F.count_distinct(F.when(cond, F.col("source_key")))
    when = F.coalesce("published_at", "captured_at")
    return evidence.groupBy(key).agg(
        n(positive & (F.col("author_type") == "customer")).alias("customer_sources"),
        n(positive & (F.col("verified") == 1)).alias("verified_sources"),
        n(positive & F.col("band").isin("strong", "very_strong")).alias("strong_sources"),
        n(positive).alias("positive_sources"),
        n(ok).alias("all_sources"),
        F.max(F.when(positive, when)).alias("newest_positive"),
    )


def positive_order() -> list[Column]:
    """Six descending factors, then name and id."""
    down = [F.col(x).desc() for x in ("customer_sources", "verified_sources", "strong_sources", "positive_sources", "all_sources")]
    return [*down, F.col("newest_positive").desc_nulls_last(), F.col("name").asc(), F.col("merchant_id").asc()]


def matching(rows: DataFrame, *, tag: str | None = None, governorate: str | None = None, coverage: str | None = None, least_locations: int = 0, query: str = "") -> DataFrame:
    """Directory rows under all of the given conditions; each word of ``query`` is part of some token."""
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    if governorate:
        rows = rows.where(F.col("governorate") == governorate)
    if coverage:
        rows = rows.where(F.col("coverage") == coverage)
    if least_locations:
        rows = rows.where(F.coalesce("location_count", F.lit(0)) >= least_locations)
    words = F.array(*[F.lit(w) for w in query.lower().split()])
    return rows.where(F.forall(words, lambda w: F.exists("tokens", lambda t: F.contains(t, w)))) if query.strip() else rows


def page(rows: DataFrame, number: int, order: list[Column], size: int = PAGE_SIZE) -> DataFrame:
    """The rows of one page with the totals of all; a page beyond the last has no rows."""
    total = rows.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("long"))
    on = numbered(rows, "position", *order).where(F.col("position").between((number - 1) * size + 1, number * size))
    return on.join(F.broadcast(total))  # one row


def facets(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column or of the elements of an array column, over all rows of a view."""
    kind = rows.schema[column].dataType.typeName()
    values = rows.select(F.explode(column).alias("value") if kind == "array" else F.col(column).alias("value"))
    return values.where("value is not null").distinct()


def location_label(city: Column, governorate: Column, address: Column, default: str = "Egypt") -> Column:
    """City, and governorate if it differs; else the first address; else the default."""
    same = F.lower(city) == F.lower(governorate)
    both = F.concat_ws("، ", F.nullif(city, F.lit("")), F.when(~F.coalesce(same, F.lit(False)), F.nullif(governorate, F.lit(""))))
    return F.coalesce(F.nullif(both, F.lit("")), F.nullif(address, F.lit("")), F.lit(default))
