"""Text normalisation, fingerprints and tokens as column expressions."""

from __future__ import annotations

import difflib
import json
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Whole words that a company name is compared without.
COMPANY_WORDS = ("llc", "ltd", "inc", "co", "company", "store", "shop", "stores", "trading", "electronics", "شركة", "متجر", "محل", "للتجارة", "الكترونيات")
# Characters that names and claims are compared without, and digits that are folded.
NOT_WORD = "[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}]+"
ZERO_WIDTH = "[\\x{200B}-\\x{200F}\\x{FEFF}]"
NAME_PUNCTUATION = "[._\\-/,()|'\"`;%*+<>=?!~@#$^&\\[\\]{}]"
CONTROL_AND_BIDI = "[\\x{0000}-\\x{001F}\\x{007F}-\\x{009F}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{FEFF}\\x{200B}]"
PICTOGRAPHS = "[\\x{00A9}\\x{00AE}\\x{203C}\\x{2049}\\x{2122}\\x{2139}\\x{2194}-\\x{21AA}\\x{231A}-\\x{23FF}\\x{25AA}-\\x{27BF}\\x{2934}\\x{2935}\\x{2B05}-\\x{2B55}\\x{3030}\\x{303D}\\x{3297}\\x{3299}\\x{1F000}-\\x{1FAFF}]"
DIACRITICS_AND_TATWEEL = "[\\x{064B}-\\x{0652}\\x{0670}\\x{0640}]"
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
# Names of secrets in queries, beginnings of formulas, words and cells that are refused or blank.
SECRET_KEYS = ("token", "access_token", "api_key", "apikey", "key", "secret", "password", "passwd", "auth", "sig", "signature", "session")
FORMULA_START = "^[=+\\-@\\t\\r]"
FORBIDDEN_LABELS = ("scammer", "scam", "fraudster", "criminal", "thief")
PLACEHOLDER_TOKENS = "(?i)(\\bTODO\\b)|(\\bFIXME\\b)|(example\\.com)|(\\blorem\\s+ipsum\\b)"
BARE_PLACEHOLDER = "(?i)^\\s*(n/?a|todo|tbd|placeholder|unknown|-+|\\.+)\\s*$"
PLACEHOLDER_SUMMARY = "source-only reference"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC form."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC form."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    """NFKC form with full case folding."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts; 0 if one is empty or null."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def uuid5(name: Column) -> Column:
    """Name-based identifiers (version 5) in the URL namespace: the SHA-1 of namespace and name, with version and
    variant put in."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.NAMESPACE_URL.hex)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


@F.pandas_udf(StringType())
def stringified(values: pd.Series) -> pd.Series:
    """A JSON value as text: objects as "k=v; ...", arrays joined by "; "."""

    def text(v: object) -> str:
        if isinstance(v, dict):
            return "; ".join(f"{k}={x}" for k, x in v.items())
        if isinstance(v, list):
            return "; ".join(map(text, v))
        return v if isinstance(v, str) else str(v)

    def one(raw: str) -> str:
        try:
            return text(json.loads(raw))
        except ValueError:
            return raw

    return values.map(one, na_action="ignore")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def plain(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def canonical_name(name: Column, *, normalise: bool = False) -> Column:
    """Company name without legal forms and punctuation; ``normalise`` adds NFKC for other than NFC input."""
    text = F.lower(F.trim(nfkc(F.coalesce(name, F.lit(""))) if normalise else F.coalesce(name, F.lit(""))))
    text = F.regexp_replace(text, f"(?U)\\b({'|'.join(COMPANY_WORDS)})\\b", " ")
    return collapse(F.regexp_replace(text, NOT_WORD, " "))


def claim_text(text: Column, *, normalise: bool = False) -> Column:
    """Prose without links, zero-width characters and punctuation, case folded."""
    raw = F.coalesce(text, F.lit(""))
    folded = casefold(raw) if normalise else F.replace(F.lower(raw), F.lit("ß"), F.lit("ss"))
    folded = F.regexp_replace(F.regexp_replace(folded, "https?://\\S+", " "), ZERO_WIDTH, "")
    return collapse(F.regexp_replace(folded, NOT_WORD, " "))


def text_hash(text: Column, *, normalise: bool = False) -> Column:
    return F.sha2(claim_text(text, normalise=normalise), 256)


def content_fingerprint(name: Column, claim_type: Column, summary: Column, quote: Column) -> Column:
    """Equal for the same claim about the same name, wherever it was published."""
    return F.sha2(F.concat_ws("|", canonical_name(name), claim_type, text_hash(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.coalesce(quote, F.lit(""))))), 256)


def exact_fingerprint(name: Column, claim_type: Column, url: Column, summary: Column) -> Column:
    """Equal for the same claim about the same name at the same (canonical) place."""
    return F.sha2(F.concat_ws("|", canonical_name(name), claim_type, url, text_hash(summary)), 256)


def nul_fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a zero byte."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.char(F.lit(0))) for p in parts]), 256)


def task_id(*parts: Column) -> Column:
    return F.concat(F.lit("task-"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def fold_digits(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM, DIGITS_TO)


def _staged(text: Column, normalise: bool) -> Column:
    out = F.lower(fold_digits(nfc(text) if normalise else text))
    for pattern in (CONTROL_AND_BIDI, PICTOGRAPHS, NAME_PUNCTUATION):
        out = F.regexp_replace(out, pattern, " ")
    return F.translate(F.regexp_replace(out, DIACRITICS_AND_TATWEEL, ""), "\u0622\u0623\u0625\u0671\u0649", "\u0627\u0627\u0627\u0627\u064a")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda t: t != "")


def strict_name(name: Column, *, normalise: bool = False) -> Column:
    """Name for exact lookups."""
    return F.array_join(tokens(_staged(name, normalise)), " ")


def loose_name(name: Column, *, normalise: bool = False) -> Column:
    """Name for recall: also folds a final letter form and drops the article of each token."""
    folded = F.transform(tokens(_staged(name, normalise)), lambda t: F.regexp_replace(F.translate(t, "\u0629", "\u0647"), "^\u0627\u0644", ""))
    return F.array_join(F.filter(folded, lambda t: t != ""), " ")


def trigrams(token: Column) -> Column:
    """Character trigrams of a token with two spaces before and one after it."""
    padded = F.concat(F.lit("  "), token, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def conjunction_variants(query: Column, known: Column) -> Column:
    """The query with one leading conjunction letter dropped, for each token where that is plausible: the rest
    has three letters, another token has two, or the rest is in the array ``known``."""
    t = tokens(query)
    rest = lambda x: F.substring(x, 2, 1000)
    others = lambda i: F.exists(F.transform(t, lambda y, j: (j != i) & (F.length(y) >= 2)), lambda b: b)
    made = F.transform(
        t,
        lambda x, i: F.when(
            x.startswith("\u0648") & (F.length(x) > 1) & ((F.length(x) >= 4) | others(i) | F.array_contains(known, rest(x))),
            F.array_join(F.transform(t, lambda y, j: F.when(j == i, rest(y)).otherwise(y)), " "),
        ),
    )
    return F.filter(made, lambda v: v.isNotNull())


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters, an ellipsis in the last place if something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def safe_component(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, 80)


def redacted(text: Column, most: int = 300) -> Column:
    """A diagnostic on one line: links keep scheme, host and path only, secret parameters are masked, bounded."""
    line = F.trim(F.regexp_replace(text, "\\s+", " "))
    low = F.regexp_replace(F.regexp_replace(line, "(?i)\\bhttps://", "https://"), "(?i)\\bhttp://", "http://")
    bare = F.regexp_replace(low, "\\b(https?)://(?:[^\\s/?#]*@)?([^\\s/?#]*)([^\\s?#]*)(?:[?#]\\S*)?", "$1://$2$3")
    rooted = F.regexp_replace(bare, "\\b(https?://[^\\s/]+)(?=\\s|$)", "$1/")
    return F.substring(F.regexp_replace(rooted, f"(?i)\\b({'|'.join(SECRET_KEYS)})=([^&\\s\"']+)", "$1=[redacted]"), 1, most)


def neutralised(text: Column) -> Column:
    """A cell that a spreadsheet would run as a formula, made literal."""
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def has_placeholder(text: Column) -> Column:
    return text.rlike(PLACEHOLDER_TOKENS) | text.rlike(BARE_PLACEHOLDER)


def is_placeholder_summary(text: Column) -> Column:
    cell = F.trim(F.coalesce(text, F.lit("")))
    return (cell == "") | (F.lower(cell) == PLACEHOLDER_SUMMARY)


def has_forbidden_label(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), "\\s+"), F.array(*map(F.lit, FORBIDDEN_LABELS)))


def target_language(text: Column) -> Column:
    """The language that a text of one script still needs; null for mixed and for neither."""
    arabic, latin = text.rlike("[\\x{0600}-\\x{06FF}]"), text.rlike("[A-Za-z]")
    return F.when(arabic & ~latin, "en").when(latin & ~arabic, "ar")


def label(key: Column, labels: dict[str, str]) -> Column:
    """The label of a key, or else the key with spaces for underscores."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(names, key), F.replace(key, F.lit("_"), F.lit(" ")))


# Site paths of the social network that are no user names.
RESERVED_PATHS = "groups|marketplace|watch|reels?|photos?|story|events|pages|videos?|posts?|share|hashtag|gaming|bookmarks|messages|notifications|search|business|help|policies|terms|login|settings|fundraisers|friends|permalink\\.php|story\\.php"
PROFILE_HOST = "(?<![\\w.-])(?:https?://)?(?:[a-z0-9-]+\\.)*facebook\\.com"
# What is scrubbed and what stands in its place, in this order.
SCRUBBED = (
    (PROFILE_HOST + "/(?:profile\\.php\\?id=\\d+|people/[^\"\\s>]+|(?!(?:" + RESERVED_PATHS + ")(?:[/?\"\\s>]|$))[A-Za-z0-9.][A-Za-z0-9._-]*)", "[community member]"),
    ("(?i)fb://(?:profile|native_post|permalink\\.php|story|page)[^\\s\"'>]*", "[community member]"),
    ("(?<![\\d+])(?:\\+20|0)1[0125]\\d{8}(?!\\d)|(?<![\\d+])(?:\\+20|0)[2-9]\\d{7,8}(?!\\d)", "[redacted phone]"),
    ("(?<!\\d)(?:\\+?20[\\s.-]*)?0?1[0125](?:[\\s.-]*\\d){8}(?!\\d)|(?<!\\d)(?:\\+?20[\\s.-]*)?0?[2-9](?:[\\s.-]*\\d){7,8}(?!\\d)", "[redacted phone]"),
    ("\\b\\d{11,}\\b", "[redacted phone]"),
    ("(?<![\\w.])@[A-Za-z0-9_.]{3,}\\b", "[community member]"),
)


def scrubbed(text: Column) -> Column:
    """Text without profile links, phone numbers, long digit runs and handles."""
    for pattern, mark in SCRUBBED:
        text = F.regexp_replace(text, pattern, mark)
    return text
