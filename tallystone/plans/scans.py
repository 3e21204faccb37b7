"""Sources and sinks: inventory SC and SK."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.operators import dml
from tallystone.plans.registry import query
from tallystone.plans.views import Views
from tallystone.sources import exports, readers

c = F.col


@query("sc01_full_scan", "SELECT * FROM merchants")
def _(v: Views) -> DataFrame:
    return v.merchants.orderBy("merchant_id")


@query("sc02_point_lookup", "SELECT * FROM sources WHERE source_id = 17")
def _(v: Views) -> DataFrame:
    return v.sources.where(c("source_id") == 17)


@query("sc03_in_list", "SELECT evidence_id, merchant_id, claim_type FROM evidence WHERE merchant_id IN (3, 5, 8, 13, 21)")
def _(v: Views) -> DataFrame:
    return v.evidence.where(c("merchant_id").isin(3, 5, 8, 13, 21)).select("evidence_id", "merchant_id", "claim_type")


@query("sc04_jsonl_dispatch", "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN event_id % 50 = 0 THEN 'bad' WHEN event_id % 2 = 0 THEN 'evidence' ELSE 'merchant' END AS kind FROM events WHERE event_id % 40 <> 1) GROUP BY kind")
def _(v: Views) -> DataFrame:
    lines = v.table("events").select(
        F.when(c("event_id") % 40 == 1, "  ").when(c("event_id") % 50 == 0, '{"kind": broken').when(c("event_id") % 2 == 0, F.to_json(F.struct(F.lit("evidence").alias("kind"), "event_id"))).otherwise(F.to_json(F.struct(F.lit("merchant").alias("kind"), "event_id"))).alias("value")
    )
    return readers.dispatched(lines).groupBy("kind").agg(F.count("*").alias("n"))


@query("sc05_json_documents", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, false AS broken FROM conversations")
def _(v: Views) -> DataFrame:
    """Documents of one array each, over many lines, written by ranges of conversations and read back whole."""
    where = exports.shared_folder(v.spark)
    item = F.concat(F.lit("{\n  "), F.substring(F.to_json(F.struct("conv_id", "turn", "role")), 2, 1_000_000))
    files = v.table("conversations").groupBy(F.floor(c("conv_id") / 1000).alias("file")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(item), ",\n"), F.lit("\n]")).alias("value"))
    files.write.partitionBy("file").text(where)
    return readers.multi_line(v.spark, f"{where}/*", "conv_id bigint, turn bigint, role string").select("conv_id", "turn", "role", c("broken").isNotNull().alias("broken"))


@query("sc05_json_cells", "SELECT conv_id, CAST(turn AS BIGINT) AS turn, role FROM conversations")
def _(v: Views) -> DataFrame:
    whole = v.table("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role"))).alias("doc"))
    return readers.exploded(whole, "doc", "array<struct<turn: bigint, role: string>>").select("conv_id", "item.turn", "item.role")


@query("sc06_exclusion_list", "SELECT merchant_id, name FROM merchants WHERE merchant_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 300)")
def _(v: Views) -> DataFrame:
    lines = v.table("events").where((c("event_type") == "error") & (c("value") > 300)).select(F.concat(F.lit(" "), c("user_id").cast("string"), F.lit(" ")).alias("value"))
    return readers.without_ids(v.merchants.select("merchant_id", "name"), "merchant_id", lines)


@query(
    "sc08_event_log",
    "SELECT user_id AS session_id, CAST(sum(k) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS bad_lines FROM (SELECT user_id, event_id % 97 = 0 AS bad, CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events) GROUP BY user_id",
)
def _(v: Views) -> DataFrame:
    raw = v.table("events").select(c("user_id").alias("session_id"), F.when(c("event_id") % 97 == 0, "{oops").when(c("event_id") % 2 == 0, F.regexp_replace("props", '"k"', '"input"')).otherwise(c("props")).alias("line"))
    return readers.event_usage(raw, "session_id", "line", ("input", "k"))


@query(
    "sc08_agent_runs",
    """WITH k AS (SELECT user_id, event_id, event_id % 8 AS k, CAST(event_id AS VARCHAR) AS i FROM events)
    SELECT user_id, max(CASE WHEN k = 0 THEN concat('s', i) WHEN k = 5 THEN concat('t', i) END ORDER BY event_id) AS unused, last(CASE k WHEN 0 THEN concat('s', i) WHEN 5 THEN concat('t', i) END ORDER BY event_id) FILTER (WHERE k IN (0, 5)) AS session_id,
      coalesce(string_agg(CASE k WHEN 1 THEN concat('done ', i) WHEN 2 THEN concat('part ', i) WHEN 3 THEN concat('a', i, 'b') WHEN 4 THEN concat('one ', i, chr(10), chr(10), 'two') END, concat(chr(10), chr(10)) ORDER BY event_id) FILTER (WHERE k IN (1, 2, 3, 4)), '') AS text,
      CAST(sum(CASE k WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 3 THEN 7 ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE k WHEN 1 THEN 2 WHEN 5 THEN 4 ELSE 0 END) AS BIGINT) AS output_tokens, round(sum(CASE k WHEN 3 THEN 0.25 ELSE 0 END), 6) AS cost, count(*) FILTER (WHERE k NOT IN (6, 7)) AS events, count(*) FILTER (WHERE k = 6) AS bad_lines FROM k GROUP BY 1""".replace("max(CASE WHEN k = 0 THEN concat('s', i) WHEN k = 5 THEN concat('t', i) END ORDER BY event_id) AS unused, ", ""),
)
def _(v: Views) -> DataFrame:
    """Each user's events as a log: sessions, messages, deltas, parts, ends of agents, lines that are broken or no object."""
    shapes = (
        '{"type": "session_start", "id": "s%"}', '{"type": "message_end", "message": {"role": "assistant", "content": "done %", "usage": {"input": 3, "output": 2}}}', '{"event": "text_delta", "delta": "part %", "usage": {"prompt_tokens": 5}}',
        '{"type": "message", "data": {"content": [{"type": "text", "text": "a%"}, "b", {"type": "image"}]}, "usageStats": {"tokens": {"input": 7}, "total_cost": 0.25}}', '{"type": "agent_end", "messages": [{"role": "user", "content": "no"}, "one %", {"text": "two"}]}', '{"type": "tool", "sessionId": "t%", "usage": {"completion_tokens": "4"}}', '{"type": "message', "[1, 2]",
    )
    made = F.replace(F.element_at(F.array(*map(F.lit, shapes)), (c("event_id") % 8 + 1).cast("int")), F.lit("%"), c("event_id").cast("string"))
    out = readers.agent_runs(v.table("events").select("user_id", "event_id", made.alias("line")), "user_id", "event_id", "line")
    return out.select("user_id", "session_id", "text", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"), "events", "bad_lines")


@query("sc09_messy_json")
def _(v: Views) -> DataFrame:
    raw = v.table("events").select("event_id", F.concat(F.lit("Here you are:\n```json\n"), F.regexp_replace("props", "}", ",}"), F.lit("\n```\nDone {not json")).alias("text"))
    return raw.select("event_id", readers.extracted_json("text").alias("json"))


@query("sc10_html_islands", "SELECT page_id, list_slice(list_distinct(regexp_extract_all(html, 'track\\(([0-9]+)\\)', 1)), 1, 5) AS ids FROM pages")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", readers.islands("html", "track\\(([0-9]+)\\)", 5).alias("ids"))


@query("sc11_text_islands")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", readers.text_near("html", F.concat(F.lit("track("), c("page_id").cast("string"))).alias("text"))


@query("sc12_html_links", "SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS INTEGER) AS n_links FROM pages")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.size(readers.links("html", 1000)).alias("n_links"))


@query("sc13_api_flatten", "SELECT user_id, CAST(event_id AS BIGINT) AS event_id, event_type FROM events")
def _(v: Views) -> DataFrame:
    response = v.table("events").groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.struct("event_id", "event_type").alias("data"))).alias("children")).alias("data"))).alias("body"))
    parsed = response.select("user_id", F.from_json("body", "data struct<children: array<struct<data: struct<event_id: bigint, event_type: string>>>>").alias("r"))
    return parsed.select("user_id", F.explode("r.data.children.data").alias("d")).select("user_id", "d.event_id", "d.event_type")


@query("sc14_login_wall", "SELECT page_id, (contains(lower(html), 'track(1') OR contains(lower(html), 'class=\"ad\"') OR contains(lower(html), 'log in to continue')) AS walled FROM pages")
def _(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", readers.has_marker("html", ("track(1", 'class="ad"', "log in to continue")).alias("walled"))


@query("sc15_manifest", "SELECT 'merchants' AS table_name, (SELECT count(*) FROM merchants) AS n UNION ALL SELECT 'evidence', (SELECT count(*) FROM evidence) UNION ALL SELECT 'sources', (SELECT count(*) FROM sources)")
def _(v: Views) -> DataFrame:
    return exports.counted({"merchants": v.merchants, "evidence": v.evidence, "sources": v.sources})


@query("sc17_rebuilt_view", "SELECT merchant_id, name, city FROM merchants")
def _(v: Views) -> DataFrame:
    stored = v.merchants.select(F.to_json(F.struct("merchant_id", "name", "city")).alias("payload"))
    return stored.select(F.from_json("payload", "merchant_id bigint, name string, city string").alias("m")).select("m.*")


@query("sc18_tolerant_read", "SELECT source_id, url, CAST(NULL AS VARCHAR) AS web_url FROM sources")
def _(v: Views) -> DataFrame:
    return readers.with_columns(v.sources, {"source_id": "bigint", "url": "string", "web_url": "string"})


@query("sk01_nested_export", "SELECT m.merchant_id, CAST(count(e.evidence_id) AS INTEGER) AS n_items FROM merchants m LEFT JOIN evidence e USING (merchant_id) GROUP BY m.merchant_id")
def _(v: Views) -> DataFrame:
    nested = exports.nested(v.merchants, v.evidence)
    return nested.select("merchant_id", F.coalesce(F.json_array_length(F.get_json_object("doc", "$.evidence")), F.lit(0)).alias("n_items"))


@query("sk02_jsonl_export", "SELECT evidence_id, summary FROM evidence")
def _(v: Views) -> DataFrame:
    lines = exports.json_lines(v.evidence, internal=False)
    return lines.select(F.get_json_object("value", "$.evidence_id").cast("bigint").alias("evidence_id"), F.get_json_object("value", "$.summary").alias("summary"))


@query("sk03_csv_neutralised", "SELECT event_id, CASE WHEN regexp_matches(cell, '^[=+\\-@\\t\\r]') THEN concat('''', cell) ELSE cell END AS cell FROM (SELECT event_id, concat(CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END, event_type) AS cell FROM events)")
def _(v: Views) -> DataFrame:
    cell = F.concat(F.when(c("event_id") % 5 == 0, "=").when(c("event_id") % 5 == 1, "-").when(c("event_id") % 5 == 2, "@").otherwise(""), c("event_type"))
    return v.table("events").select("event_id", T.neutralised(cell).alias("cell"))


@query("sk04_sanitised", "SELECT evidence_id, merchant_id, source_id, claim_type, confidence FROM evidence")
def _(v: Views) -> DataFrame:
    return exports.sanitised(v.evidence).select("evidence_id", "merchant_id", "source_id", "claim_type", "confidence")


@query("sk05_atomic_write", "SELECT merchant_id, name FROM merchants")
def _(v: Views) -> DataFrame:
    return exports.round_trip(v.merchants.select("merchant_id", "name"), "parquet")


@query("sk06_snapshot", "SELECT 'merchants' AS table_name, (SELECT count(*) FROM merchants) AS n UNION ALL SELECT 'links', (SELECT count(*) FROM links)")
def _(v: Views) -> DataFrame:
    return exports.published(v.spark, {"merchants": v.merchants, "links": v.links})


@query("sk07_shards", "SELECT city, CAST(count(*) AS BIGINT) AS n FROM merchants GROUP BY city")
def _(v: Views) -> DataFrame:
    return exports.round_trip(v.merchants.select("merchant_id", "name", "city"), "json", "city").groupBy("city").agg(F.count("*").alias("n"))


@query("sk08_sitemap", "SELECT concat('/', lang, '/merchant/', CAST(merchant_id AS VARCHAR)) AS url FROM merchants, (SELECT unnest(['ar', 'en']) AS lang)")
def _(v: Views) -> DataFrame:
    return v.merchants.select(F.explode(F.array(F.lit("ar"), F.lit("en"))).alias("lang"), "merchant_id").select(F.concat(F.lit("/"), "lang", F.lit("/merchant/"), c("merchant_id").cast("string")).alias("url"))


_LATEST = "SELECT source_id, check_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY check_id DESC) AS r FROM checks) WHERE r = 1"


@query("sk09_upsert", _LATEST)
def _(v: Views) -> DataFrame:
    log = v.checks.select("source_id", "check_id", "status")
    return dml.upsert(log.where("check_id % 2 = 0"), log.where("check_id % 2 = 1"), ["source_id"], "check_id")


@query("sk10_conditional_upsert", "SELECT merchant_id, kind, max(confidence) AS confidence, arg_max(identifier_id, struct_pack(a := confidence, b := -identifier_id)) AS identifier_id FROM identifiers GROUP BY merchant_id, kind")
def _(v: Views) -> DataFrame:
    i = v.identifiers.select("merchant_id", "kind", "identifier_id", "confidence")
    return dml.keep_best(i, ["merchant_id", "kind"], "confidence", "identifier_id", ["identifier_id"]).select("merchant_id", "kind", "confidence", "identifier_id")


@query("sk11_insert_or_ignore", "SELECT source_id, min(check_id) AS check_id FROM checks GROUP BY source_id")
def _(v: Views) -> DataFrame:
    log = v.checks.select("source_id", "check_id")
    return dml.insert_or_ignore(log.where("check_id < 100").groupBy("source_id").agg(F.min("check_id").alias("check_id")), log.where("check_id >= 100"), ["source_id"], "check_id")


@query("sk12_insert_or_replace", "SELECT concat('run:', CAST(user_id AS VARCHAR), ':', event_type) AS run_id, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def _(v: Views) -> DataFrame:
    e = v.table("events").select(F.concat(F.lit("run:"), c("user_id").cast("string"), F.lit(":"), "event_type").alias("run_id"), "event_id")
    return dml.upsert(e.where("event_id < 5000"), e.where("event_id >= 5000"), ["run_id"], "event_id")


@query("sk13_fill_only", "SELECT s.source_id, coalesce(nullif(CASE WHEN s.source_id % 3 = 0 THEN '' ELSE s.platform END, ''), i.platform) AS platform FROM sources s LEFT JOIN (SELECT source_id, 'filled' AS platform FROM sources WHERE source_id % 2 = 0) i USING (source_id)")
def _(v: Views) -> DataFrame:
    held = v.sources.select("source_id", F.when(c("source_id") % 3 == 0, "").otherwise(c("platform")).alias("platform"))
    return dml.fill_only(held, v.sources.where("source_id % 2 = 0").select("source_id", F.lit("filled").alias("platform")), ["source_id"], ["platform"])


@query("sk14_counters", "SELECT merchant_id, claim_type, count(*) AS mention_count, count(DISTINCT CASE WHEN independent = 1 THEN source_id END) AS independent_source_count FROM evidence GROUP BY merchant_id, claim_type")
def _(v: Views) -> DataFrame:
    return v.evidence.groupBy("merchant_id", "claim_type").agg(F.count("*").alias("mention_count"), F.count_distinct(F.when(c("independent") == 1, c("source_id"))).alias("independent_source_count"))


@query("sk15_delete_not_in", "SELECT evidence_id FROM evidence WHERE NOT (merchant_id IN (1, 2, 3) AND evidence_id NOT IN (SELECT duplicate_of FROM evidence WHERE duplicate_of IS NOT NULL))")
def _(v: Views) -> DataFrame:
    e = v.evidence
    kept = e.where("duplicate_of is not null").select(c("duplicate_of").alias("evidence_id")).distinct()
    gone = e.where(c("merchant_id").isin(1, 2, 3)).join(kept, "evidence_id", "left_anti").select("evidence_id")
    return e.select("evidence_id").join(gone, "evidence_id", "left_anti")


@query("sk16_append", "SELECT status, CAST(2 * count(*) AS BIGINT) AS n FROM checks GROUP BY status")
def _(v: Views) -> DataFrame:
    return exports.appended([v.checks.select("status"), v.checks.select("status")]).groupBy("status").agg(F.count("*").alias("n"))


@query("sk17_migration", "SELECT evidence_id, coalesce(duplicate_of, evidence_id) AS canonical_id, CAST(5 AS INTEGER) AS schema_version FROM evidence")
def _(v: Views) -> DataFrame:
    return dml.migrated(v.evidence.select("evidence_id", "duplicate_of"), 4)


@query("sk19_dry_run", "SELECT merchant_id, lower(name) AS name, CAST(false AS BOOLEAN) AS applied FROM merchants")
def _(v: Views) -> DataFrame:
    return exports.maybe_apply(v.merchants.select("merchant_id", F.lower("name").alias("name")), apply=False)

