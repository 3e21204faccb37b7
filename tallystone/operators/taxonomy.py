"""Categories, governorates, kinds of sources, and text for public views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of category tags, in order of priority.
CATEGORY_KEYWORDS: dict[str, tuple[str, ...]] = {
    "pharmacy_health": ("pharmacy", "pharmacist", "drugstore", "health", "healthcare", "healthtech", "telehealth", "medical", "صيدلية", "صيدليات", "صحة"),
    "automotive": ("automotive", "dealership", "tire", "car", "سيارات"),
    "grocery_retail": ("grocery", "supermarket", "hypermarket", "wholesale", "delicatessen", "gourmet", "department store", "سوبر ماركت", "هايبر", "بقالة"),
    "gaming": ("gaming", "game", "console", "playstation", "xbox", "esport", "gpu", "graphics card", "ألعاب"),
    "mobile_telecom": ("mobile", "phone", "smartphone", "tablet", "telecom", "telecommunication", "iphone", "ipad", "teleshopping", "موبايل", "هاتف", "هواتف", "اتصالات"),
    "computers_it": ("computer", "laptop", "macbook", "apple", "pc", "workstation", "hardware", "software", "printer", "copier", "monitor", "networking", "component", "tech", "technology", "robotics", "it", "كمبيوتر", "لابتوب"),
    "home_appliances": ("appliance", "refrigerator", "refrigeration", "freezer", "washer", "cooker", "air conditioning", "air conditioner", "kitchen", "electrical appliance", "lighting", "heating", "أجهزة منزلية", "أجهزة كهربائية"),
    "repair_services": ("repair", "maintenance", "servicing", "refurbish", "refurbishing", "service center", "service provider", "service network", "installation", "صيانة", "إصلاح"),
    "security_smart_home": ("security", "surveillance", "smart home", "smart lock", "automation", "access control", "cctv", "gate", "أمن", "أنظمة أمنية", "كاميرات مراقبة"),
    "consumer_electronics": ("electronics", "electronic", "camera", "photography", "drone", "gadget", "audio", "إلكترونيات", "كاميرات"),
    "marketplace_online": ("marketplace", "ecommerce", "e commerce", "online", "classifieds", "digital products", "متجر إلكتروني", "منصة إلكترونية"),
}
# Governorates by key, as they are written in English and Arabic.
GOVERNORATES = {
    "cairo": ("cairo", "القاهرة"),
    "giza": ("giza", "الجيزة"),
    "alexandria": ("alexandria", "الإسكندرية"),
    "qalyubia": ("qalyubia", "القليوبية"),
    "sharqia": ("sharqia", "الشرقية"),
    "dakahlia": ("dakahlia", "الدقهلية"),
    "gharbia": ("gharbia", "الغربية"),
    "beheira": ("beheira", "البحيرة"),
    "minya": ("minya", "المنيا"),
    "sohag": ("sohag", "سوهاج"),
    "assiut": ("assiut", "أسيوط"),
    "qena": ("qena", "قنا"),
    "beni_suef": ("beni suef", "بني سويف"),
    "ismailia": ("ismailia", "الإسماعيلية"),
    "port_said": ("port said", "بورسعيد"),
    "suez": ("suez", "السويس"),
    "damietta": ("damietta", "دمياط"),
}
# Keywords of kinds of sources, in order of precedence.
SOURCE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "government_registry": ("government", "gov", "registry", "regulatory", "regulator", "gafi", "ministry", "tax authority"),
    "merchant_site": (
        "merchant", "official website", "official site", "official page", "official store", "official portal", "official profile", "official post", "official blog", "official channel", "official locator", "official locations", "official brand", "official corporate", "official api", "official service",
        "official program", "official announcement", "official terms", "official policy", "official contact", "official business", "corporate", "own domain", "product page", "about page", "contact page", "business page", "company portal", "company profile", "store locator", "storefront", "catalog",
    ),
    "marketplace": ("marketplace", "ecommerce", "e commerce", "app store", "app listing", "app reviews", "play store"),
    "directory": ("directory",),
    "forum_community": ("forum", "reddit", "community", "thread", "facebook_group", "group"),
    "social": ("social", "facebook", "instagram", "tiktok", "youtube", "twitter", "video"),
    "news": ("news", "press", "journalistic", "journalism", "journal", "investigative", "publication", "outlet", "article"),
}
AUTHOR_CATEGORIES = {"regulator": "public_authority", "registry": "public_authority", "merchant": "merchant_owned", "customer": "customer_report", "journalist": "news"}
# Keys that are internal in any form, and words that are internal only where they are keys.
STRICT_KEYS = ("source_reliability", "entity_certainty", "reliability_band", "identity_confidence", "source_type", "duplicate_of", "package_labels", "independent_source_count")
SOFT_KEYS = ("evaluation", "confidence", "sentiment", "reliability", "validity", "ambiguity", "corroboration", "contradictions", "freshness", "strength", "severity", "verdict", "score")
_STRICT, _ANY = "|".join(STRICT_KEYS), "|".join((*STRICT_KEYS, *SOFT_KEYS))
_QUOTED = "\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'"
# What is cut out of public text, and what stands in its place, in this order: pairs of quoted keys,
# strict keys in any form, other keys with a value, and what punctuation is left behind.
INTERNAL = (
    (f"(?iU)['\"](?:{_ANY})['\"]\\s*[:=]\\s*(?:{_QUOTED}|[^;,{{}}]*)", " "),
    (f"(?iU)['\"]?(?:{_STRICT})['\"]?(?:\\s*[:=]\\s*(?:{_QUOTED}|\\S+)|\\s+\\S+)?", " "),
    (f"(?iU)['\"]?(?:{'|'.join(SOFT_KEYS)})['\"]?\\s*[:=]\\s*(?:{_QUOTED}|[^;,)\\]}}\\s]+)", " "),
    ("(?U)\\s*[,;]\\s*(?=[)\\]}])", ""),
    ("(?U)\\(\\s*[,;]?\\s*\\)", ""),
    ("(?U)[,;]\\s*[,;]", ";"),
)
SEGMENT_EDGES = "(?U)^[,{}\\[\\]\\s'\"\\\\/:]+|[,{}\\[\\]\\s'\"\\\\/:]+$"
SEGMENT_KEY = f"(?iU)^\\s*[\"']?(?:{_ANY})[\"']?\\s*[=:]"


def tokenised(text: Column) -> Column:
    """Tokens of a category or source type: separators are boundaries, an Arabic article is dropped."""
    words = F.split(F.regexp_replace(F.lower(text), "[_\\-+,/]+", " "), "[^\\p{L}\\p{N}]+")
    return F.filter(F.transform(words, lambda t: F.regexp_replace(t, "^ل?ال(?=[^\\p{L}]|$)|^لل", "")), lambda t: t != "")


def matches(tokens: Column, keywords: tuple[str, ...]) -> Column:
    """Whether some keyword occurs as a run of tokens, each of which may have a plural ending."""
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return line.rlike(" (" + "|".join(" ".join(f"{w}(?:s|es)?" for w in k.split(" ")) for k in keywords) + ") ") if keywords else F.lit(False)


def category_tags(category: Column) -> Column:
    """All tags of a category in order of priority; "other" if there is none."""
    tokens = tokenised(category)
    tags = F.filter(F.array(*[F.when(matches(tokens, words), tag) for tag, words in CATEGORY_KEYWORDS.items()]), lambda t: t.isNotNull())
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("other")))


def governorate(raw: Column) -> Column:
    """The key of a governorate: the first one whose English or Arabic name is part of the text; else null."""
    text = F.lower(F.trim(raw))
    return F.coalesce(*[F.when(F.contains(text, F.lit(en)) | F.contains(text, F.lit(ar)), key) for key, (en, ar) in GOVERNORATES.items()])


def source_category(url: Column, platform: Column, author: Column, source_type: Column) -> Column:
    """Registry record, community group, author, and words of the source type, in this order."""
    out = F.lit("other")
    tokens = tokenised(source_type)
    for name, words in reversed(SOURCE_KEYWORDS.items()):
        out = F.when(matches(tokens, words), name).otherwise(out)
    for who, name in AUTHOR_CATEGORIES.items():
        out = F.when(author == who, name).otherwise(out)
    return F.when(F.lower(F.trim(url)).startswith("whois://"), "technical_registry").when(platform == "facebook_group", "forum_community").otherwise(out)


def district_hints(city: Column) -> Column:
    """Parts in brackets, or else parts between slashes."""
    trimmed = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    inside = trimmed(F.flatten(F.transform(F.regexp_extract_all(city, F.lit("\\(([^)]*)\\)"), F.lit(1)), lambda p: F.split(p, "/"))))
    return F.when(F.size(inside) > 0, inside).when(F.contains(city, F.lit("/")), trimmed(F.split(city, "/"))).otherwise(inside)


def public_text(text: Column) -> Column:
    """Analysis text without internal keys and their values; segments that begin with one go. Null: empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, instead in INTERNAL:
        out = F.regexp_replace(out, pattern, instead)
    parts = F.transform(F.split(out, ";"), lambda p: F.regexp_replace(p, SEGMENT_EDGES, ""))
    kept = F.filter(parts, lambda p: (F.length(p) > 1) & ~p.rlike(SEGMENT_KEY))
    return F.trim(F.regexp_replace(F.array_join(kept, "; "), "(?U)\\s{2,}", " "))
