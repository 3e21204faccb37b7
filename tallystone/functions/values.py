"""Dates, numbers, arrays, maps and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Aliases of enumerated values in incoming payloads.
BAND_ALIASES = {"moderate": "medium", "high": "strong", "low": "weak", "very_high": "very_strong", "very strong": "very_strong"}
SENTIMENT_ALIASES = {"mixed": "neutral", "pos": "positive", "neg": "negative"}
BANDS = ("weak", "medium", "strong", "very_strong")
SENTIMENTS = ("positive", "negative", "neutral")
ISO_UTC = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+]00:00)$"


def iso_utc(text: Column) -> Column:
    """A timestamp as ISO text with +00:00; text that is no timestamp stays."""
    t = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.coalesce(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx"), text)


def age_days(then: Column, now: str, *, whole: bool) -> Column:
    """Days since a time: whole days passed, or rounded to the nearest."""
    days = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(then.cast("timestamp"))) / F.lit(86400000.0)
    return (F.floor(days) if whole else F.round(days)).cast("long")


def is_stale(then: Column, cutoff: str, *, missing: bool) -> Column:
    """Older than the cutoff; ``missing`` says what a missing time means (link checks and metrics differ)."""
    return F.coalesce(then < F.lit(cutoff).cast("timestamp_ntz"), F.lit(missing))


def effective_millis(published: Column, captured: Column) -> Column:
    return F.coalesce(F.unix_millis(F.coalesce(published, captured).cast("timestamp")), F.lit(0).cast("long"))


def confidence(value: Column) -> Column:
    """A number clamped to [0, 1]; anything else is 0."""
    number = value.try_cast("double")
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(~F.isnan(number), number))), F.lit(0.0))


def promoted_band(band: Column, score: Column) -> Column:
    """Band after promotion by confidence; the later rule wins."""
    first = F.when((band == "weak") & (score > 0.39), "medium").otherwise(band)
    return F.when(score >= 0.92, "very_strong").when(score >= 0.75, "strong").otherwise(first)


def identity_confidence(n_identifiers: Column) -> Column:
    return F.least(F.lit(0.95), F.lit(0.15) + F.lit(0.15) * F.least(n_identifiers, F.lit(5)))


def ratio(part: Column, whole: Column) -> Column:
    """Zero-safe share."""
    return part / F.greatest(whole, F.lit(1))


def coerced(value: Column, allowed: tuple[str, ...], aliases: dict[str, str], default: str) -> Column:
    """An enumerated value: as it is, by alias, or the default."""
    low = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.when(low.isin(*allowed), low), F.try_element_at(known, low), F.lit(default))


def first_key(json: Column, *names: str) -> Column:
    """The first of several spellings of a key that has a value."""
    return F.coalesce(*[F.get_json_object(json, f"$.{n}") for n in names])


def string_list(json: Column) -> Column:
    """A list of strings from a JSON array, a scalar, or null."""
    cell = F.trim(json)
    return F.when(cell.isNull() | (cell == "") | (cell == "null"), F.array().cast("array<string>")).when(cell.startswith("["), F.coalesce(F.from_json(cell, F.lit("array<string>")), F.array().cast("array<string>"))).otherwise(F.array(F.regexp_replace(cell, '^"|"$', "")))


def guarded_payload(json: Column, versions: tuple[int, ...]) -> Column:
    """The text of a JSON object of a supported version; null for anything else."""
    version = F.get_json_object(json, "$.version").try_cast("int")
    return F.when(F.trim(json).startswith("{") & F.try_parse_json(json).isNotNull() & version.isin(*versions), json)


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def width_band(value: Column) -> Column:
    """Four half-open bands of [0, 1], the last closed."""
    return F.when(value < 0.25, "0.00-0.25").when(value < 0.5, "0.25-0.50").when(value < 0.75, "0.50-0.75").otherwise("0.75-1.00")
