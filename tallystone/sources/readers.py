"""Readers of line-based, nested and messy inputs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def dispatched(lines: DataFrame) -> DataFrame:
    """JSON lines by ``kind``; blank lines go, lines that are no object have the kind "bad"."""
    cell = F.trim("value")
    kind = F.when(F.try_parse_json(cell).isNull() | ~cell.startswith("{"), "bad").otherwise(F.coalesce(F.get_json_object("value", "$.kind"), F.lit("bad")))
    return lines.where(cell != "").select(kind.alias("kind"), "value")


def multi_line(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files that hold one array of objects each, over any number of lines; what is no such object has
    nulls throughout and its text in ``broken``."""
    return spark.read.schema(f"{schema}, broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "broken").json(path)


def exploded(documents: DataFrame, column: str, schema: str) -> DataFrame:
    """One row per element of a JSON array held in one cell."""
    return documents.withColumn("item", F.explode(F.from_json(column, schema)))


def without_ids(rows: DataFrame, key: str, lines: DataFrame) -> DataFrame:
    """Rows whose key isn't listed in a text file of ids."""
    listed = lines.select(F.trim("value").try_cast("bigint").alias(key)).where(F.col(key).isNotNull()).distinct()
    return rows.join(listed, key, "left_anti")


def event_usage(lines: DataFrame, session: str, line: str, spellings: tuple[str, ...]) -> DataFrame:
    """Per session: usage summed over its lines under any spelling of the key, and lines that can't be parsed."""
    good = F.try_parse_json(line).isNotNull()
    usage = F.coalesce(*[F.get_json_object(line, f"$.{s}").try_cast("bigint") for s in spellings], F.lit(0))
    return lines.groupBy(session).agg(F.sum(F.when(good, usage).otherwise(0)).alias("total"), F.count("*").alias("n"), F.count_if(~good).alias("bad_lines"))


# Names under which events of agents give their usage, their kind, and the session that they belong to.
USAGE_KEYS = ("usage", "usage_stats", "usageStats")
USAGE = {
    "input_tokens": ("input", "input_tokens", "prompt_tokens", "tokens.input", "tokens.prompt"),
    "output_tokens": ("output", "output_tokens", "completion_tokens", "tokens.output", "tokens.completion"),
    "cached_tokens": ("cacheRead", "cache_read", "cached_tokens", "tokens.cached", "tokens.cacheRead"),
    "cost": ("cost", "total_cost", "totalCost"),
}
MESSAGE_EVENTS, DELTA_EVENTS, SESSION_EVENTS = ("message_end", "turn_end", "message", "assistant", "output"), ("message_update", "text_delta"), ("session", "session_start", "session_created")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _said(message: Column) -> Column:
    """The text of a message: the message itself, its content, its text, or the texts of its parts."""
    content = _at(message, "content")
    part = lambda x: F.when(_is(x, "STRING"), F.try_variant_get(x, "$", "string")).otherwise(F.coalesce(_at(x, "text", "string"), F.lit("")))
    parts = F.array_join(F.transform(_at(message, "content", "array<variant>"), part), "")
    text = F.when(_is(message, "STRING"), F.try_variant_get(message, "$", "string")).when(_is(content, "STRING"), _at(message, "content", "string")).when(_is(_at(message, "text"), "STRING"), _at(message, "text", "string")).otherwise(parts)
    return F.coalesce(text, F.lit(""))


def agent_runs(lines: DataFrame, run: str, order: str, line: str) -> DataFrame:
    """One row per run of lines of events: its session (the last one named), what the assistant said (messages and
    deltas in order, blank ones left out), usage summed over events and messages, the last model, events and lines that
    can't be parsed. Lines that are JSON but no object are passed over."""
    v, e = F.try_parse_json(line), F.col("_v")
    rows = lines.where(F.trim(line) != "").withColumn("_v", v)
    rows = rows.withColumn("_event", _is(e, "OBJECT")).withColumn("_type", F.lower(F.coalesce(F.nullif(_at(e, "type", "string"), F.lit("")), _at(e, "event", "string"), F.lit(""))))
    kind = F.col("_type")
    whole = F.coalesce(*[F.when(_is(_at(e, k), "OBJECT") | _is(_at(e, k), "STRING"), _at(e, k)) for k in ("message", "data")], e)
    nothing = F.array().cast("array<variant>")
    ended = F.coalesce(_at(e, "messages", "array<variant>"), _at(e, "data.messages", "array<variant>"), nothing)
    messages = F.when(kind.isin(*MESSAGE_EVENTS), F.array(whole)).when(kind == "agent_end", ended).otherwise(nothing)
    own = F.filter(messages, lambda m: ~_is(m, "OBJECT") | _at(m, "role", "string").isNull() | (_at(m, "role", "string") == "assistant"))
    delta = F.coalesce(*[F.when(_is(_at(e, k), "STRING"), F.nullif(_at(e, k, "string"), F.lit(""))) for k in ("delta", "text")])
    said = F.when(kind.isin(*DELTA_EVENTS), F.array(delta)).otherwise(F.transform(own, _said))
    told = F.filter(F.array(*[_at(e, k) for k in USAGE_KEYS]), lambda u: _is(u, "OBJECT"))
    again = F.when(kind.isin(*DELTA_EVENTS), F.filter(F.array(_at(e, "usage")), lambda u: _is(u, "OBJECT"))).otherwise(nothing)
    usage = F.concat(told, again, F.filter(F.transform(own, lambda m: _at(m, "usage")), lambda u: _is(u, "OBJECT")))
    session = F.coalesce(*[F.nullif(_at(e, k, "string"), F.lit("")) for k in ("session_id", "sessionId")], F.when(kind.isin(*SESSION_EVENTS), F.nullif(_at(e, "id", "string"), F.lit(""))))
    rows = rows.select(run, order, "_event", e.isNull().alias("_bad"), F.when(F.col("_event"), session).alias("session"), F.when(F.col("_event"), F.filter(said, lambda t: F.coalesce(t != "", F.lit(False)))).alias("said"), F.when(F.col("_event"), usage).alias("usage"))
    number = lambda u, names: F.coalesce(*[F.nullif(_at(u, n, "double"), F.lit(0.0)) for n in names], F.lit(0.0))
    sums = {name: F.aggregate(F.coalesce("usage", nothing), F.lit(0.0), _adding(number, names)) for name, names in USAGE.items()}
    model = F.element_at(F.filter(F.transform(F.coalesce("usage", nothing), lambda u: F.coalesce(*[F.nullif(_at(u, n, "string"), F.lit("")) for n in ("model", "model_id", "modelId")], F.lit(""))), lambda m: m != ""), -1)
    rows = rows.withColumns(sums).withColumn("model", F.when(F.size(F.filter("usage", lambda u: F.coalesce(_at(u, "model", "string"), _at(u, "model_id", "string"), _at(u, "modelId", "string")).isNotNull())) > 0, model))
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("said") > 0, F.struct(F.col(order).alias("at"), F.col("said"))))), lambda x: x["said"]))
    return rows.groupBy(run).agg(
        F.max_by("session", F.when(F.col("session").isNotNull(), F.col(order))).alias("session_id"),
        F.trim(F.array_join(texts, "\n\n")).alias("text"),
        *[F.sum(name).cast("double" if name == "cost" else "long").alias(name) for name in USAGE],
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col(order))).alias("model"),
        F.count_if("_event").alias("events"),
        F.count_if("_bad").alias("bad_lines"),
    )


def _adding(number: Callable[[Column, tuple[str, ...]], Column], names: tuple[str, ...]) -> Callable[[Column, Column], Column]:
    return lambda total, u: total + number(u, names)


def _balanced(text: str) -> str | None:
    """The last balanced object or array in a text."""
    best, depth, start, quoted, skip = None, 0, 0, False, False
    for i, ch in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"' and depth:
            quoted = True
        elif ch in "{[":
            if not depth:
                start = i
            depth += 1
        elif ch in "}]" and depth:
            depth -= 1
            if not depth:
                best = text[start : i + 1]
    return best


def find_json(text: str | None) -> str | None:
    """An object or array in a text: fenced blocks first, then the last balanced span, then the whole text."""
    if not text:
        return None
    for raw in [*re.findall(r"```(?:json)?\s*\n(.*?)```", text, re.S), _balanced(text), text]:
        for tried in (raw, re.sub(r",(\s*[}\]])", r"\1", raw or "")):
            try:
                found = json.loads(tried or "")
            except ValueError:
                continue
            if isinstance(found, (dict, list)):
                return json.dumps(found, sort_keys=True, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def extracted_json(texts: pd.Series) -> pd.Series:
    return texts.map(find_json)


def islands(html: str, pattern: str, most: int) -> Column:
    """Distinct first groups of a pattern, in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), 1, most)


def links(html: str, most: int) -> Column:
    """Distinct link targets, percent-decoded where that is possible."""
    found = F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.coalesce(F.try_url_decode(x), x))), 1, most)


@F.pandas_udf(StringType())
def text_near(pages: pd.Series, marks: pd.Series) -> pd.Series:
    """The first six texts of 25 characters or more within 30,000 characters of a mark, joined by line ends."""

    def near(page: str | None, mark: str | None) -> str | None:
        at = (page or "").find(mark or "\0")
        if at < 0:
            return None
        found = re.findall(r">([^<>]{25,})<", page[max(0, at - 30_000) : at + 30_000])
        return "\n".join(list(dict.fromkeys(t.strip() for t in found))[:6])

    return pd.Series([near(p, m) for p, m in zip(pages, marks, strict=True)])


def has_marker(html: str, markers: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(F.col(html), F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))


def with_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns; those that the table lacks are null."""
    return rows.select(*[F.col(n).cast(t).alias(n) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in wanted.items()])
