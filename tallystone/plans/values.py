"""Dates, numbers, arrays, maps and JSON: inventory D, M, A, MP and JS."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions import values as V
from tallystone.plans.registry import query
from tallystone.plans.views import NOW, Views

c = F.col


@query("d01_iso_utc", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'no date' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM events")
def _(v: Views) -> DataFrame:
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = c("event_id") % 3
    return v.table("events").select("event_id", V.iso_utc(F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, base).otherwise("no date")).alias("iso"))


_MS = f"(epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts))"


@query("d02_age_days", f"SELECT event_id, CAST(floor({_MS} / 86400000.0) AS BIGINT) AS whole, CAST(round({_MS} / 86400000.0) AS BIGINT) AS nearest FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", V.age_days(c("ts"), NOW, whole=True).alias("whole"), V.age_days(c("ts"), NOW, whole=False).alias("nearest"))


@query("d03_cutoffs", f"SELECT event_id, ts < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AS old30, ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS old7 FROM events")
def _(v: Views) -> DataFrame:
    before = lambda n: c("ts") < F.expr(f"timestamp_ntz'{NOW}' - interval {n} days")
    return v.table("events").select("event_id", before(30).alias("old30"), before(7).alias("old7"))


@query("d04_iso_format", "SELECT event_id, event_id % 3 <> 2 AS ok FROM events")
def _(v: Views) -> DataFrame:
    k = c("event_id") % 3
    cell = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return v.table("events").select("event_id", cell.rlike(V.ISO_UTC).alias("ok"))


@query("d05_effective_time", "SELECT evidence_id, coalesce(epoch_us(coalesce(published_at, captured_at)) // 1000, 0) AS millis FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("evidence_id", V.effective_millis(c("published_at"), c("captured_at")).alias("millis"))


@query("m01_clamp", "SELECT event_id, coalesce(least(1.0, greatest(0.0, TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(value / 10 - 0.5 AS VARCHAR) END AS DOUBLE))), 0.0) AS confidence FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", V.confidence(F.when(c("event_id") % 4 == 0, "x").otherwise((c("value") / 10 - 0.5).cast("string"))).alias("confidence"))


@query("m02_band_promotion", "SELECT evidence_id, CASE WHEN confidence >= 0.92 THEN 'very_strong' WHEN confidence >= 0.75 THEN 'strong' WHEN band = 'weak' AND confidence > 0.39 THEN 'medium' ELSE band END AS band FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("evidence_id", V.promoted_band(c("band"), c("confidence")).alias("band"))


@query("m03_identity_confidence", "SELECT merchant_id, CAST(round(least(0.95, 0.15 + 0.15 * least(count(DISTINCT kind), 5)), 6) AS DOUBLE) AS confidence FROM identifiers GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.identifiers.groupBy("merchant_id").agg(F.round(V.identity_confidence(F.count_distinct("kind")), 6).alias("confidence"))


@query("m04_ratios", "SELECT user_id, round(count(*) FILTER (WHERE event_type = 'purchase') / greatest(count(*) FILTER (WHERE event_type = 'view'), 1), 6) AS ratio, CAST(ceil(count(*) / 7.0) AS BIGINT) AS pages, least(60.0, 0.5 * pow(2, user_id % 10)) AS wait FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    n = lambda t: F.count_if(c("event_type") == t)
    return v.table("events").groupBy("user_id").agg(F.round(V.ratio(n("purchase"), n("view")), 6).alias("ratio"), F.ceil(F.count("*") / 7).cast("bigint").alias("pages")).withColumn("wait", V.backoff(c("user_id") % 10 + 1, 0.5, 60.0))


@query("m05_source_confidence", "SELECT merchant_id, round(least(1.0, count(DISTINCT source_id) / 3.0), 6) AS confidence FROM evidence GROUP BY 1")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id").agg(F.round(F.least(F.lit(1.0), F.count_distinct("source_id") / F.lit(3.0)), 6).alias("confidence"))


@query("m06_long_floats")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", (c("value") / 3).cast("string").rlike("0\\.\\d{10,}$").alias("artifact"))


_DOC = "string_split(text, ' ')"


@query("a01_arrays", f"SELECT doc_id, len(list_filter({_DOC}, lambda w: length(w) > 6)) > 0 AS any_long, len(list_filter({_DOC}, lambda w: length(w) > 0)) = len({_DOC}) AS all_filled, list_slice({_DOC}, 1, 2) AS head, list_contains({_DOC}, 'the') AS has_the FROM documents")
def _(v: Views) -> DataFrame:
    w = F.split("text", " ")
    return v.table("documents").select("doc_id", F.exists(w, lambda x: F.length(x) > 6).alias("any_long"), F.forall(w, lambda x: F.length(x) > 0).alias("all_filled"), F.slice(w, 1, 2).alias("head"), F.array_contains(w, "the").alias("has_the"))


@query("a02_artifacts", "SELECT page_id, [url] AS urls, ['seen offline'] AS notes FROM pages")
def _(v: Views) -> DataFrame:
    a = F.array("url", F.lit("seen offline"))
    return v.table("pages").select("page_id", F.filter(a, lambda x: x.rlike("^https?://")).alias("urls"), F.filter(a, lambda x: ~x.rlike("^https?://")).alias("notes"))


@query("a03_string_lists", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['single'] ELSE [] END AS items FROM events")
def _(v: Views) -> DataFrame:
    k = c("event_id") % 4
    raw = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, '["a","b"]').when(k == 2, "single").otherwise("[broken")
    return v.table("events").select("event_id", V.string_list(raw).alias("items"))


@query("a04_fidelity", "SELECT doc_id, doc_id % 2 = 0 AS kept FROM documents")
def _(v: Views) -> DataFrame:
    src, dst = F.concat(F.lit("price 1500 and "), (c("doc_id") + 1000).cast("string")), F.concat(F.lit("costs 1500, "), F.when(c("doc_id") % 2 == 0, (c("doc_id") + 1000).cast("string")).otherwise("none"))
    numbers = lambda x: F.regexp_extract_all(x, F.lit("[0-9]{3,}"), F.lit(0))
    return v.table("documents").select("doc_id", (F.size(F.array_except(numbers(src), numbers(dst))) == 0).alias("kept"))


@query("mp1_key_aliases", "SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS url FROM events")
def _(v: Views) -> DataFrame:
    k = c("event_id") % 3
    doc = F.when(k == 0, F.to_json(F.struct(c("event_id").alias("source_url")))).when(k == 1, F.to_json(F.struct(c("event_id").alias("link")))).otherwise("{}")
    return v.table("events").select("event_id", V.first_key(doc, "source_url", "url", "link").alias("url"))


@query("mp2_enum_coercion", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'medium' WHEN 1 THEN 'strong' WHEN 2 THEN 'very_strong' ELSE 'weak' END AS band FROM events")
def _(v: Views) -> DataFrame:
    k = c("event_id") % 4
    return v.table("events").select("event_id", V.coerced(F.when(k == 0, "Moderate").when(k == 1, " strong ").when(k == 2, "very strong").otherwise("???"), V.BANDS, V.BAND_ALIASES, "weak").alias("band"))


@query("js1_guarded_json", "SELECT analysis_id, CASE WHEN analysis_id % 3 <> 2 THEN payload END AS payload FROM analyses")
def _(v: Views) -> DataFrame:
    return v.analyses.select("analysis_id", V.guarded_payload(c("payload"), (1, 2)).alias("payload"))


@query("js2_typed_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '' AS name FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.name"), F.lit("")).alias("name"))


@query("js3_id_lists", "SELECT user_id, list_sort(list(DISTINCT event_id // 2)) AS ids FROM events GROUP BY 1")
def _(v: Views) -> DataFrame:
    e = v.table("events")
    lists = e.groupBy("user_id").agg(F.to_json(F.collect_list("event_id")).alias("ids"))
    mapping = e.select(c("event_id").alias("old"), F.floor(c("event_id") / 2).cast("bigint").alias("new"))
    out = lists.select("user_id", F.explode(F.from_json("ids", "array<bigint>")).alias("old")).join(mapping, "old", "left")
    return out.groupBy("user_id").agg(F.sort_array(F.collect_set(F.coalesce("new", "old"))).alias("ids"))


@query("js4_canonical_json", "SELECT merchant_id, concat('{\"city\":\"', city, '\",\"merchant_id\":', CAST(merchant_id AS VARCHAR), ',\"name\":\"', name, '\"}') AS doc FROM merchants")
def _(v: Views) -> DataFrame:
    return v.merchants.select("merchant_id", F.to_json(F.struct(*sorted(["name", "merchant_id", "city"]))).alias("doc"))


@query("js5_bullets", "SELECT merchant_id, CASE WHEN merchant_id % 3 = 0 THEN [name] WHEN merchant_id % 3 = 1 THEN [name, city] ELSE [] END AS bullets FROM merchants")
def _(v: Views) -> DataFrame:
    k = c("merchant_id") % 3
    doc = F.when(k == 0, F.to_json(F.struct(F.array(F.struct(c("name").alias("text"))).alias("bullets")))).when(k == 1, F.to_json(F.struct(F.array("name", "city").alias("points")))).otherwise("{}")
    new = F.transform(F.from_json(doc, "bullets array<struct<text: string>>")["bullets"], lambda b: b["text"])
    return v.merchants.select("merchant_id", F.coalesce(new, F.from_json(doc, "points array<string>")["points"], F.array().cast("array<string>")).alias("bullets"))


