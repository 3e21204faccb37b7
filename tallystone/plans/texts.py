"""Scalar functions on text, links, phones and hashes: inventory F."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions import text as T
from tallystone.functions import urls as U
from tallystone.operators import taxonomy
from tallystone.plans.registry import query
from tallystone.plans.views import Views

c = F.col
_NOT_WORD = "[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}]+"
_COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_NAME = _COLLAPSE.format(f"regexp_replace(regexp_replace(lower(trim({{0}})), '\\b(llc|ltd|inc|co|company|store|shop|stores|trading|electronics)\\b', ' ', 'g'), '{_NOT_WORD}', ' ', 'g')")
_CLAIM = _COLLAPSE.format(f"regexp_replace(regexp_replace(replace(lower({{0}}), 'ß', 'ss'), 'https?://\\S+', ' ', 'g'), '{_NOT_WORD}', ' ', 'g')")


def _f(text: str, *args: str) -> str:
    for i, a in enumerate(args):
        text = text.replace(f"{{{i}}}", a)
    return text


def _pages(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", "url")


@query("f01_plain", "SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS plain FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(T.plain(c("text"))).alias("plain"))


@query("f02_canonical_name", f"SELECT s_suppkey, {_f(_NAME, 'n')} AS name FROM (SELECT s_suppkey, concat('  The ', s_name, ' Trading Co., Ltd - Store ') AS n FROM supplier)")
def _(v: Views) -> DataFrame:
    return v.table("supplier").select("s_suppkey", T.canonical_name(F.concat(F.lit("  The "), "s_name", F.lit(" Trading Co., Ltd - Store "))).alias("name"))


@query("f03_claim_text", f"SELECT doc_id, md5({_f(_CLAIM, 't')}) AS claim FROM (SELECT doc_id, concat(text, ' https://a.example/x?y ') AS t FROM documents)")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(T.claim_text(F.concat("text", F.lit(" https://a.example/x?y ")))).alias("claim"))


_CLAIM_S, _CLAIM_SQ = _f(_CLAIM, "summary"), _f(_CLAIM, "concat(summary, ' ', quoted_excerpt)")


CONTENT_SQL = f"sha256(concat({_f(_NAME, 'name')}, '|', claim_type, '|', sha256({_CLAIM_SQ})))"
EXACT_SQL = f"sha256(concat({_f(_NAME, 'name')}, '|', claim_type, '|', host, '|', sha256({_CLAIM_S})))"


@query("f04_fingerprints", f"SELECT evidence_id, {CONTENT_SQL} AS content, {EXACT_SQL} AS exact FROM evidence JOIN merchants USING (merchant_id) JOIN sources USING (source_id)")
def _(v: Views) -> DataFrame:
    rows = v.evidence.join(v.merchants, "merchant_id").join(v.sources, "source_id")
    return rows.select("evidence_id", T.content_fingerprint(c("name"), c("claim_type"), c("summary"), c("quoted_excerpt")).alias("content"), T.exact_fingerprint(c("name"), c("claim_type"), c("host"), c("summary")).alias("exact"))


@query("f05_nul_fingerprint", "SELECT evidence_id, sha256(concat(CAST(merchant_id AS VARCHAR), chr(0), claim_type, chr(0), summary, chr(0))) AS fp FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("evidence_id", T.nul_fingerprint(c("merchant_id"), c("claim_type"), c("summary")).alias("fp"))


@query("f06_ids", "SELECT task_id, concat('task-', substr(sha1(concat(title, '|', priority)), 1, 16)) AS hashed FROM tasks")
def _(v: Views) -> DataFrame:
    return v.tasks.select("task_id", T.task_id(c("title"), c("priority")).alias("hashed"))


_H = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat('claim:', CAST(merchant_id AS VARCHAR))))"


@query("f06_name_based_ids", f"SELECT merchant_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 18, 3), '-', substr(h, 21, 12)) AS claim_id FROM (SELECT merchant_id, {_H} AS h FROM merchants)")
def _(v: Views) -> DataFrame:
    return v.merchants.select("merchant_id", T.uuid5(F.concat(F.lit("claim:"), c("merchant_id").cast("string"))).alias("claim_id"))


@query(
    "f07_canonical_url",
    """SELECT page_id, concat(lower(regexp_extract(url, '^([^:]+)://', 1)), '://', regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', ''), regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''),
      CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS canonical FROM (SELECT page_id, url, array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'igshid', 'si', 'ref')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE concat(p, '=') END)), '&') AS q FROM pages)""",
)
def _(v: Views) -> DataFrame:
    return _pages(v).select("page_id", U.canonical_url(c("url")).alias("canonical"))


@query("f08_lossy_url", "SELECT page_id, split_part(split_part(regexp_replace(lower(regexp_replace(trim(url), '/+$', '')), '^https?://', ''), '?', 1), '#', 1) AS lossy FROM pages")
def _(v: Views) -> DataFrame:
    return _pages(v).select("page_id", U.lossy_url(c("url")).alias("lossy"))


_RAW = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat(url, ' (archived copy)') WHEN 2 THEN concat('whois://', host) WHEN 3 THEN 'javascript:alert(1)' ELSE '  ' END"


def _locators(v: Views) -> DataFrame:
    k = c("source_id") % 5
    raw = F.when(k == 0, c("url")).when(k == 1, F.concat("url", F.lit(" (archived copy)"))).when(k == 2, F.concat(F.lit("whois://"), "host")).when(k == 3, "javascript:alert(1)").otherwise("  ")
    return v.sources.select("source_id", raw.alias("raw"))


@query("f09_http_check", "SELECT source_id, regexp_matches(raw, '^(?i)https?://[^/\\s]+\\S*$') AS ok FROM (SELECT source_id, " + _RAW.replace("page_id", "source_id") + " AS raw FROM sources)")
def _(v: Views) -> DataFrame:
    return _locators(v).select("source_id", U.is_http_url(c("raw")).alias("ok"))


@query("f10_locators", "SELECT source_id, CASE source_id % 5 WHEN 0 THEN url WHEN 1 THEN url END AS web_url, CASE source_id % 5 WHEN 1 THEN '(archived copy)' WHEN 2 THEN host WHEN 3 THEN 'javascript:alert(1)' END AS note, CASE source_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'web' WHEN 2 THEN 'whois' ELSE 'unknown' END AS access_kind FROM sources")
def _(v: Views) -> DataFrame:
    return _locators(v).select("source_id", U.locator(c("raw")).alias("l")).select("source_id", "l.*")


_ID, _U = "CAST(page_id AS VARCHAR)", "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '')"
_WAY = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"


@query(
    "f11_query_url",
    f"""WITH k AS (SELECT page_id % 14 AS k, page_id, {_ID} AS i, {_U} AS h, {_WAY} AS way FROM pages)
    SELECT page_id, CASE WHEN k IN (1, 2, 3, 4) THEN 'facebook' WHEN k = 5 THEN 'instagram' WHEN k = 6 THEN 'tiktok' WHEN k IN (7, 8) THEN 'google_maps' WHEN k IN (9, 10) THEN 'marketplace' WHEN k = 13 THEN NULL ELSE 'website' END AS kind,
      CASE k WHEN 1 THEN concat('https://facebook.com/Shop.', i) WHEN 2 THEN concat('https://facebook.com/profile.php?id=', i) WHEN 3 THEN concat('https://facebook.com/Pages/Shop/', i) WHEN 4 THEN concat('https://facebook.com/shop', i) WHEN 5 THEN concat('https://instagram.com/shop.', i) WHEN 6 THEN concat('https://tiktok.com/@Shop', i) WHEN 7 THEN concat('https://g.page/Shop', i) WHEN 8 THEN concat('https://maps.app.goo.gl/maps/X', i) WHEN 9 THEN concat('https://play.google.com/store/apps/details?id=com.Shop', i) WHEN 10 THEN concat('https://apps.apple.com/eg/app/shop/id', i) WHEN 11 THEN concat('https://shop', i, '.example') WHEN 12 THEN concat('https://support.apple.com/HT', i) WHEN 13 THEN NULL ELSE concat('https://', h, way) END AS normalized,
      CASE k WHEN 1 THEN concat('facebook.com/shop.', i, '|facebook.com/shop.', i, '/posts/9') WHEN 2 THEN concat('facebook.com/profile.php?id=', i) WHEN 3 THEN concat('facebook.com/pages/shop/', i) WHEN 4 THEN concat('facebook.com/shop', i) WHEN 5 THEN concat('instagram.com/shop.', i) WHEN 6 THEN concat('tiktok.com/@shop', i, '|tiktok.com/shop', i, '/video/1') WHEN 7 THEN concat('g.page/shop', i) WHEN 8 THEN concat('maps.app.goo.gl/maps/x', i) WHEN 9 THEN concat('play.google.com/store/apps/details?id=com.shop', i) WHEN 10 THEN concat('apps.apple.com/eg/app/shop/id', i) WHEN 11 THEN concat('shop', i, '.example') WHEN 12 THEN concat('support.apple.com/ht', i, '|support.apple.com') WHEN 13 THEN NULL ELSE CASE WHEN way = '' THEN h ELSE concat(lower(concat(h, way)), '|', h) END END AS path_keys,
      CASE WHEN k = 11 THEN concat('shop', i, '.example') WHEN k = 12 THEN 'support.apple.com' WHEN k = 0 THEN h END AS origin_key, CASE WHEN k <> 13 THEN k = 12 END AS external FROM k""",
)
def _(v: Views) -> DataFrame:
    """The pages' own links, and accounts, numbered profiles, reserved segments, places, apps, bare hosts, offices."""
    shapes = (
        None, "https://m.facebook.com/Shop.{}/posts/9?ref=x", "facebook.com/profile.php?id={}&sk=about", "http://www.facebook.com/Pages/Shop/{}/", "https://ar-ar.facebook.com/shop{}#top", "https://www.instagram.com/Shop.{}/?hl=en", "https://www.tiktok.com/Shop{}/video/1",
        "https://g.page/Shop{}", "https://maps.app.goo.gl/maps/X{}", "https://play.google.com/store/apps/details?id=com.Shop{}&hl=ar", "https://apps.apple.com/eg/app/shop/id{}", " www.shop{}.example ", "https://support.apple.com/HT{}", "no link number {}",
    )
    made = [c("url") if x is None else F.concat(F.lit(x.split("{}")[0]), c("page_id").cast("string"), F.lit(x.split("{}")[1])) for x in shapes]
    url = F.element_at(F.array(*made), (c("page_id") % 14 + 1).cast("int"))
    return _pages(v).select("page_id", U.query_url(url).alias("k")).select("page_id", "k.kind", "k.normalized", F.array_join("k.path_keys", "|").alias("path_keys"), "k.origin_key", "k.external")


_SEGMENTS = "CAST(len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) AS INTEGER)"


@query(
    "f12_url_depth",
    f"SELECT page_id, depth, CASE page_id % 5 WHEN 4 THEN false ELSE depth > 1 END AS sent_home, CASE page_id % 5 WHEN 2 THEN depth < 1 WHEN 4 THEN depth < 3 ELSE false END AS deeper FROM (SELECT page_id, {_SEGMENTS} AS depth FROM pages)",
)
def _(v: Views) -> DataFrame:
    """Redirects to the root, to roots by language, to one segment of another site, and to a page three segments deep."""
    final = F.element_at(F.array(*map(F.lit, ("https://shop.example", "https://shop.example/ar-EG/", "https://other.example/a", "https://shop.example/EN?x=1", "https://shop.example/a/b/c"))), (c("page_id") % 5 + 1).cast("int"))
    return _pages(v).select("page_id", U.depth(c("url")).alias("depth"), U.is_redirect_to_home(c("url"), final).alias("sent_home"), U.is_deeper_url(c("url"), final).alias("deeper"))


@query("f13_vendor_page", "SELECT event_id, event_id % 12 IN (0, 1, 2, 3, 4, 5, 6, 7) AS vendor FROM events")
def _(v: Views) -> DataFrame:
    """Roots, mentions, photos, plugins, people, short paths, references; then posts, reels with one, groups, other hosts."""
    shapes = ("https://www.facebook.com/shop.{}", "https://m.facebook.com/shop{}/mentions/", "https://facebook.com/shop/photos/{}", "https://www.facebook.com/plugins/page{}/x", "https://fb.com/p/shop/{}", "https://facebook.com/people/shop/{}", "https://facebook.com/shop/about_details/{}", "https://facebook.com/groups/{}/?REF=share", "https://facebook.com/shop/posts/{}?ref=x", "https://facebook.com/shop/reel/{}", "https://facebook.com/groups/{}", "https://notfacebook.com/shop{}")
    made = [F.concat(F.lit(a), c("event_id").cast("string"), F.lit(b)) for a, b in (x.split("{}") for x in shapes)]
    return v.table("events").select("event_id", U.is_vendor_page(F.element_at(F.array(*made), (c("event_id") % 12 + 1).cast("int"))).alias("vendor"))


def _phones(v: Views) -> Column:
    n = F.lpad((c("event_id") % 100000000).cast("string"), 8, "0")
    k = c("event_id") % 6
    return F.when(k == 0, F.concat(F.lit("010"), n)).when(k == 1, F.concat(F.lit("+20 10-"), n)).when(k == 2, F.concat(F.lit("002011"), n)).when(k == 3, F.concat(F.lit("02"), n)).when(k == 4, F.concat(F.lit("+1 555 "), n)).otherwise(F.concat(F.lit("10"), n))


_N = "lpad(CAST(event_id % 100000000 AS VARCHAR), 8, '0')"


@query("f14_pipeline_phone", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('+2010', {_N}) WHEN 1 THEN concat('+2010', {_N}) WHEN 2 THEN concat('+2011', {_N}) WHEN 3 THEN concat('+202', {_N}) END AS phone FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", U.pipeline_phone(_phones(v)).alias("phone"))


@query("f15_query_phone", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('+2010', {_N}) WHEN 1 THEN concat('+2010', {_N}) WHEN 2 THEN concat('+2011', {_N}) WHEN 3 THEN concat('+202', {_N}) END AS phone FROM events")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", U.query_phone(_phones(v)).alias("phone"))


@query("f16_input_kind", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'url' WHEN 2 THEN 'phone' WHEN 3 THEN 'name' ELSE 'url' END AS kind FROM events")
def _(v: Views) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("a@b.example", "https://x.example/1", "+20 (10) 1234-5678", "Blue Widget", "shop.example.com/p?q=1"))), (c("event_id") % 5 + 1).cast("int"))
    return v.table("events").select("event_id", U.input_kind(text).alias("kind"))


@query("f17_fold_digits", "SELECT doc_id, translate(concat('٠١٢٣۹۸', CAST(doc_id AS VARCHAR)), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS folded FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.fold_digits(F.concat(F.lit("٠١٢٣۹۸"), c("doc_id").cast("string"))).alias("folded"))


_PUNCT = "regexp_replace(lower(p_name), '[._\\-/,()|;%*+<>=?!~@#$^&\\[\\]{}]', ' ', 'g')"


@query("f18_strict_name", f"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(concat({_PUNCT}, ' كتاب الى'), '\\s+'), lambda t: t <> ''), ' ') AS strict FROM part".replace("كتاب الى", "كتاب الي"))
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.strict_name(F.concat("p_name", F.lit("  كِتـاب الى"))).alias("strict"))


@query("f19_loose_name", f"SELECT p_partkey, concat({_PUNCT}, ' شركه نور') AS loose FROM part")
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.loose_name(F.concat("p_name", F.lit(" شركة النور"))).alias("loose"))


@query(
    "f20_conjunction_variants",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [concat('بيت ', p_name)] WHEN 1 THEN ['تك'] WHEN 2 THEN [] ELSE ['لد ولي', 'ولد لي'] END AS variants FROM part",
)
def _(v: Views) -> DataFrame:
    """U4: with other words, a short rest that is a known token, one that isn't, and two words that begin alike."""
    k = c("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("وبيت "), "p_name")).when(k == 1, "وتك").when(k == 2, "ولي").otherwise("ولد ولي")
    known = F.when(k == 1, F.array(F.lit("تك"))).otherwise(F.array().cast("array<string>"))
    return v.table("part").select("p_partkey", T.conjunction_variants(text, known).alias("variants"))


@query("f21_tokens", "SELECT p_partkey, list_filter(regexp_split_to_array(concat(' ', p_name, '  ', p_type), '\\s+'), lambda t: t <> '') AS tokens FROM part")
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", T.tokens(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type")).alias("tokens"))


@query("f22_trigrams", "SELECT DISTINCT p_type, list_transform(range(1, length(p_type) + 2), lambda i: substr(concat('  ', p_type, ' '), CAST(i AS INTEGER), 3)) AS trigrams FROM part")
def _(v: Views) -> DataFrame:
    return v.table("part").select("p_type").distinct().select("p_type", T.trigrams(c("p_type")).alias("trigrams"))


@query("f23_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 1")
def _(v: Views) -> DataFrame:
    n = v.table("nation")
    pairs = n.alias("x").join(n.alias("y"), (c("x.n_regionkey") == c("y.n_regionkey")) & (c("x.n_nationkey") < c("y.n_nationkey")))
    return pairs.select(c("x.n_name").alias("a"), c("y.n_name").alias("b"), F.levenshtein(c("x.n_name"), c("y.n_name"), 1).alias("d")).where("d >= 0")


@query("f24_similarity")
def _(v: Views) -> DataFrame:
    return v.aliases.select("alias_id", T.similarity(c("alias"), c("normalized_alias")).alias("ratio"))


@query("f25_scrub")
def _(v: Views) -> DataFrame:
    text = F.concat(F.lit("call 01012345678 or @some_user or https://facebook.com/joe.doe "), "text")
    return v.table("documents").select("doc_id", T.scrubbed(text).alias("scrubbed"))


_E = "CAST(event_id AS VARCHAR)"


@query(
    "f26_redact",
    f"SELECT event_id, substr(concat('failed https://x.example/p/', {_E}, ' then http://y.example:80/ and key=[redacted]&n=', {_E}, ' ', event_type, CASE WHEN event_id % 4 = 0 THEN repeat(' long', 80) ELSE '' END), 1, 300) AS detail FROM events",
)
def _(v: Views) -> DataFrame:
    """Users and passwords in links, queries, fragments, links without a path, secrets outside of links, long texts."""
    n = c("event_id").cast("string")
    raw = F.concat(F.lit(" failed\n HTTPS://me:pw@x.example/p/"), n, F.lit("?token=t&a="), n, F.lit("  then http://y.example:80#frag and key=s"), n, F.lit("&n="), n, F.lit(" "), c("event_type"), F.when(c("event_id") % 4 == 0, F.repeat(F.lit(" long"), 80)).otherwise(""))
    return v.table("events").select("event_id", T.redacted(raw).alias("detail"))


def _internal_sql() -> str:
    """The passes of public_text for DuckDB, whose patterns have no look-ahead: there the bracket is put back."""
    out = "t"
    for pattern, instead in taxonomy.INTERNAL:
        flags = "gi" if pattern.startswith("(?iU)") else "g"
        plain = pattern.replace("(?iU)", "").replace("(?U)", "").replace("(?=[)\\]}])", "([)\\]}])").replace("'", "''")
        out = f"regexp_replace({out}, '{plain}', '{instead if '([)' not in plain else chr(92) + '1'}', '{flags}')"
    edges, key = (x.replace("(?iU)", "").replace("(?U)", "").replace("'", "''") for x in (taxonomy.SEGMENT_EDGES, taxonomy.SEGMENT_KEY))
    parts = f"list_transform(string_split({out}, ';'), lambda p: regexp_replace(p, '{edges}', '', 'g'))"
    return f"trim(regexp_replace(array_to_string(list_filter({parts}, lambda p: length(p) > 1 AND NOT regexp_matches(p, '{key}', 'i')), '; '), '\\s{{2,}}', ' ', 'g'))"


_LEGACY = "concat('{{''verdict'': ''fine; really'', \"score\": 0.', CAST(evidence_id AS VARCHAR), '}}; source_type web; sentiment=', sentiment, ' (confidence: 0.9, ); ', claim_type, ' with Reliability_band: strong, good; freshness = old; ', summary)"


@query("f27_public_text", f"SELECT evidence_id, md5({_internal_sql()}) AS text FROM (SELECT evidence_id, {_LEGACY.replace('{{', '{').replace('}}', '}')} AS t FROM evidence)")
def _(v: Views) -> DataFrame:
    """Pairs of quoted keys, strict keys in every form, soft keys with values, brackets left empty, and whole texts."""
    text = F.concat(
        F.lit("{'verdict': 'fine; really', \"score\": 0."), c("evidence_id").cast("string"), F.lit("}; source_type web; sentiment="), c("sentiment"), F.lit(" (confidence: 0.9, ); "), c("claim_type"), F.lit(" with Reliability_band: strong, good; freshness = old; "), c("summary")
    )
    return v.evidence.select("evidence_id", F.md5(taxonomy.public_text(text)).alias("text"))


@query("f28_stringify")
def _(v: Views) -> DataFrame:
    return v.table("events").select("event_id", T.stringified(c("props")).alias("text"))


@query("f29_clip", "SELECT doc_id, CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 39), '…') ELSE text END AS clipped FROM documents")
def _(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.clip(c("text"), 40).alias("clipped"))


@query("f30_safe_component", "SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) AS safe FROM pages")
def _(v: Views) -> DataFrame:
    return _pages(v).select("page_id", T.safe_component(c("url")).alias("safe"))


@query("f31_group_slug", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('group.', CAST(page_id AS VARCHAR)) END AS slug FROM pages")
def _(v: Views) -> DataFrame:
    url = F.when(c("page_id") % 2 == 0, F.concat(F.lit("https://www.Facebook.com/groups/Group."), c("page_id").cast("string"), F.lit("/?ref=share"))).otherwise(c("url"))
    return _pages(v).select("page_id", U.group_slug(url).alias("slug"))


@query("f32_script", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'en' END AS target FROM documents")
def _(v: Views) -> DataFrame:
    k = c("doc_id") % 3
    return v.table("documents").select("doc_id", T.target_language(F.when(k == 0, "plain text 1").when(k == 1, "متجر ٢").otherwise("store متجر")).alias("target"))


@query("f33_keyword_match", "SELECT merchant_id, category IN ('Mobile phones', 'home_appliances store') AS hit FROM merchants")
def _(v: Views) -> DataFrame:
    return v.merchants.select("merchant_id", taxonomy.matches(taxonomy.tokenised(c("category")), ("phone", "appliance")).alias("hit"))


@query("f34_city_hints", "SELECT merchant_id, [city, governorate] AS hints FROM merchants")
def _(v: Views) -> DataFrame:
    return v.merchants.select("merchant_id", taxonomy.district_hints(F.concat(F.lit("Giza ("), "city", F.lit(" / "), "governorate", F.lit(")"))).alias("hints"))


@query("f35_labels", "SELECT evidence_id, CASE claim_type WHEN 'other' THEN 'Other reports' WHEN 'refund_issue' THEN 'Refund problem' ELSE replace(claim_type, '_', ' ') END AS label FROM evidence")
def _(v: Views) -> DataFrame:
    return v.evidence.select("evidence_id", T.label(c("claim_type"), {"other": "Other reports", "refund_issue": "Refund problem"}).alias("label"))
