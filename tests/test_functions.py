"""Scalar functions on hand-made inputs, Arabic among them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.functions import urls as U
from tallystone.functions import values as V
from tallystone.operators import taxonomy
from tallystone.sources.readers import find_json


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  Nile Trading Co., LTD ", "nile"), ("شركة النور للتجارة", "النور"), (None, ""), ("A—B   store!", "a b"), ("Storefront", "storefront")],
)
def test_canonical_name(spark, raw, want):
    assert one(spark, raw, T.canonical_name) == want
    assert one(spark, raw, lambda c: T.canonical_name(c, normalise=True)) == want


def test_full_width_needs_normalising(spark):
    assert one(spark, "ＡＢＣ ltd", lambda c: T.canonical_name(c, normalise=True)) == "abc"


@pytest.mark.parametrize(("raw", "want"), [("Read https://a.b/c?d=e NOW!!", "read now"), ("Straße​", "strasse"), ("", ""), (None, "")])
def test_claim_text(spark, raw, want):
    assert one(spark, raw, T.claim_text) == want


@pytest.mark.parametrize(
    ("raw", "strict", "loose"),
    [("مكتبة النُّور", "مكتبة النور", "مكتبه نور"), ("بـيـت", "بيت", "بيت"), ("أحمد إلى آخر", "احمد الي اخر", "احمد ي اخر"), ("B-Tech (Egypt) 🙂 ٢٠", "b tech egypt 20", "b tech egypt 20")],
)
def test_names(spark, raw, strict, loose):
    assert one(spark, raw, T.strict_name) == strict
    assert one(spark, raw, T.loose_name) == loose


def test_conjunction_variants(spark):
    got = one(spark, "وبي تك", lambda c: T.conjunction_variants(c, F.array().cast("array<string>")))
    assert got == ["بي تك"]
    assert one(spark, "وبي", lambda c: T.conjunction_variants(c, F.array().cast("array<string>"))) == []
    assert one(spark, "وبي", lambda c: T.conjunction_variants(c, F.array(F.lit("بي")))) == ["بي"]


def test_trigrams(spark):
    assert one(spark, "ab", T.trigrams) == ["  a", " ab", "ab "]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTPS://WWW.Shop.com/A/?utm_source=x&b=2&a=1#top", "https://shop.com/A?a=1&b=2"),
        ("shop.com", "https://shop.com"),
        ("http://x.y/p?ref=1", "http://x.y/p"),
        ("http://x.y/?flag", "http://x.y?flag="),
        ("  ", ""),
        (None, ""),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, raw, U.canonical_url) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("whois://example.com", (None, "example.com", "whois")),
        ("https://a.b/c", ("https://a.b/c", None, "web")),
        ("https://a.b/c (cached)", ("https://a.b/c", "(cached)", "web")),
        ("javascript:alert(1)", (None, "javascript:alert(1)", "unknown")),
        (None, (None, None, "unknown")),
    ],
)
def test_locator(spark, raw, want):
    assert tuple(one(spark, raw, U.locator)) == want


@pytest.mark.parametrize(
    ("raw", "write", "read"),
    [
        ("010 1234 5678", "+201012345678", "+201012345678"),
        ("+20 10 1234 5678", "+201012345678", "+201012345678"),
        ("0020 2 2345 6789", "+20223456789", "+20223456789"),
        ("1012345678", None, None),
        ("٠١٠١٢٣٤٥٦٧٨", None, "+201012345678"),
        ("+1 212 555 0100", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_phones(spark, raw, write, read):
    got = one(spark, raw, U.pipeline_phone)
    assert got == write or raw and raw[0] == "٠"
    assert one(spark, raw, U.query_phone) == read


@pytest.mark.parametrize(("raw", "want"), [("a@b.co", "email"), ("@handle", "name"), ("www.x.y", "url"), ("facebook.com/x", "url"), ("+20 (10) 123-45678", "phone"), ("12345", "name"), ("", "name"), ("متجر", "name")])
def test_input_kind(spark, raw, want):
    assert one(spark, raw, U.input_kind) == want


@pytest.mark.parametrize(
    ("raw", "kind", "keys"),
    [
        ("https://m.facebook.com/profile.php?id=77&x=1", "facebook", ["facebook.com/profile.php?id=77"]),
        ("facebook.com/profile.php", "facebook", ["facebook.com/profile.php"]),
        ("https://FACEBOOK.com/Groups/12/", "facebook", ["facebook.com/groups/12"]),
        ("http://www.facebook.com/My.Shop/posts/5", "facebook", ["facebook.com/my.shop", "facebook.com/my.shop/posts/5"]),
        ("https://facebook.com/", "website", ["facebook.com"]),
        ("instagram.com/Some.One", "instagram", ["instagram.com/some.one"]),
        ("https://www.tiktok.com/@X", "tiktok", ["tiktok.com/@x"]),
        ("https://goo.gl/maps/abc", "google_maps", ["goo.gl/maps/abc"]),
        ("https://goo.gl/abc", "website", ["goo.gl/abc", "goo.gl"]),
        ("https://maps.google.com/place/A/", "google_maps", ["maps.google.com/place/a"]),
        ("https://play.google.com/store/apps/details?hl=en&id=a.B", "marketplace", ["play.google.com/store/apps/details?id=a.b"]),
        ("https://play.google.com/", "website", ["play.google.com"]),
        ("https://apps.apple.com/us/app/x/id12?l=ar", "marketplace", ["apps.apple.com/us/app/x/id12"]),
        ("https://shop.example/a/?utm_source=x&id=4", "website", ["shop.example/a?id=4", "shop.example"]),
        ("WWW.Shop.Example:8080", "website", ["shop.example"]),
        ("shop.example/١۲", "website", ["shop.example/12", "shop.example"]),
        ("not a link at all", None, None),
        ("nodots", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_query_url(raw, kind, keys):
    got = U.link_keys(raw)
    assert (got and got["kind"], got and got["path_keys"]) == (kind, keys)


@pytest.mark.parametrize("name", ["", "claim:1", "متجر ٣", "x" * 300])
def test_name_based_ids(spark, name):
    import uuid

    assert one(spark, name, T.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_offices_are_no_identity():
    assert U.link_keys("https://www.cpa.gov.eg/x")["external"] and not U.link_keys("https://play.google.com/x")["external"]


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("website", "https://cpa.gov.eg/a", ("external_reference", False)),
        ("marketplace", "https://play.google.com/store/apps/details", ("marketplace_profile", True)),
        ("marketplace", "https://play.google.com/", ("marketplace_profile", False)),
        ("facebook", "https://facebook.com", ("social_profile", False)),
        ("phone", "+201012345678", ("contact", True)),
        ("phone", "+201312345678", ("contact", False)),
        ("google_maps", "https://maps.app.goo.gl/x", ("location", True)),
        ("commercial_register", "CR 12", ("registration", True)),
        ("email", "a@b", ("contact", False)),
        ("website", "no link", ("owned_site", False)),
    ],
)
def test_identifier_policy(spark, kind, value, want):
    df = spark.createDataFrame([(kind, value)], "k string, v string")
    r = df.select(U.identifier_role(F.col("k"), F.col("v")).alias("role"), U.is_searchable_identifier(F.col("k"), F.col("v")).alias("ok")).first()
    assert (r["role"], r["ok"]) == want


def test_scrub(spark):
    got = one(spark, "see facebook.com/joe.doe, @someone_1, 01012345678 and 12345678901234", T.scrubbed)
    assert "joe" not in got and "someone" not in got and "0101" not in got and "1234567" not in got
    assert one(spark, "facebook.com/groups/42 stays", T.scrubbed) == "facebook.com/groups/42 stays"


def test_redacted(spark):
    assert one(spark, "x api_key=abc y", T.redacted) == "x api_key=[redacted] y"
    assert one(spark, "GET\thttps://a:b@c.example:1/p?q=1#f  HTTP://d.example failed", T.redacted) == "GET https://c.example:1/p http://d.example/ failed"
    assert len(one(spark, "x" * 999, T.redacted)) == 300


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Confidence in this shop is high.", "Confidence in this shop is high."),
        ("confidence=0.9; the shop answers", "the shop answers"),
        ("rated reliability_band: strong by us", "rated by us"),
        ("see {'score': 0.4, \"verdict\": 'x; y'} here", "see {} here"),
        ("good (sentiment: positive, ) shop", "good shop"),
        ("source_type web; ; fine", "fine"),
        (None, ""),
        ("", ""),
        ("a; ok", "ok"),
    ],
)
def test_public_text(spark, raw, want):
    assert one(spark, raw, taxonomy.public_text) == want


@pytest.mark.parametrize(("raw", "want"), [("=1+1", "'=1+1"), ("-x", "'-x"), ("plain", "plain"), ("\tx", "'\tx")])
def test_neutralised(spark, raw, want):
    assert one(spark, raw, T.neutralised) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Mobile phones & tablets", ["mobile_telecom"]), ("computer-repair", ["computers_it", "repair_services"]), ("carpets", ["other"]), ("", ["other"]), ("صيدلية", ["pharmacy_health"])],
)
def test_category_tags(spark, raw, want):
    assert one(spark, raw, taxonomy.category_tags) == want


@pytest.mark.parametrize(("raw", "want"), [("Greater Cairo", "cairo"), ("القاهرة", "cairo"), ("Paris", None), ("beni suef", "beni_suef")])
def test_governorate(spark, raw, want):
    assert one(spark, raw, taxonomy.governorate) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [('text ```json\n{"a": 1,}\n``` more {"b": 2}', '{"a": 1}'), ('noise {"a": [1, 2]} and {"b": "}"} end', '{"b": "}"}'), ("[1, 2]", "[1, 2]"), ("nothing", None), ("7", None), (None, None)],
)
def test_find_json(raw, want):
    assert find_json(raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2024-01-01T10:00:00Z", "2024-01-01T10:00:00+00:00"), ("2024-01-01T12:00:00+02:00", "2024-01-01T10:00:00+00:00"), ("soon", "soon"), (None, None)])
def test_iso_utc(spark, raw, want):
    assert one(spark, raw, V.iso_utc) == want


@pytest.mark.parametrize(("raw", "want"), [("0.4", 0.4), ("7", 1.0), ("-1", 0.0), ("x", 0.0), (None, 0.0), ("NaN", 0.0)])
def test_confidence(spark, raw, want):
    assert one(spark, raw, V.confidence) == want
