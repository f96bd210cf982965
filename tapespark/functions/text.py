"""Text functions: displayed numbers and durations, keys, classification. All are expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_number(text: Column) -> Column:
    """A number as pages show it, with a currency sign, separators, or a suffix for a multiple, as a double; null if it isn't one."""
    pattern = r"^\s*[~<>]?\$?\s*(-?[0-9][0-9,]*\.?[0-9]*|-?\.[0-9]+)\s*([kKmMbB%]?)\s*$"
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    suffix = F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    return F.when(text.rlike(pattern), F.nullif(digits, F.lit("")).try_cast("double") * factor)


_UNIT = r"([0-9]+(?:\.[0-9]+)?)\s*(ms|mo|[smhdwy])"
# Seconds of each unit.
_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "mo": 2_592_000, "y": 31_536_000}


def display_duration(text: Column) -> Column:
    """A length of time as pages show it, amounts each with a unit, in seconds; null if anything is left over."""
    low = F.lower(F.trim(text))
    amounts, units = F.regexp_extract_all(low, F.lit(_UNIT), F.lit(1)), F.regexp_extract_all(low, F.lit(_UNIT), F.lit(2))
    factor = F.create_map(*(x for k, v in _SECONDS.items() for x in (F.lit(k), F.lit(float(v)))))
    total = F.aggregate(F.zip_with(amounts, units, lambda a, u: a.cast("double") * F.element_at(factor, u)), F.lit(0.0), lambda s, x: s + x)
    rest = F.regexp_replace(F.regexp_replace(low, _UNIT, ""), r"[\s,]+", "")
    return F.when((F.size(amounts) > 0) & (rest == ""), total)


def normal(text: Column) -> Column:
    """Escapes undone, white space collapsed, trimmed, lower case."""
    plain = text
    for escape, char in (("\\n", " "), ("\\t", " "), ('\\"', '"')):
        plain = F.replace(plain, F.lit(escape), F.lit(char))
    return F.lower(F.trim(F.regexp_replace(plain, r"[\t\n\x0B\f\r]\s*| \s+", " ")))  # a single space stays


def name_key(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def url_key(url: Column) -> Column:
    """Lower-case scheme and host without www, no fragment, no slash at the end."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1), "/+$", "")
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, rest)).otherwise(F.regexp_replace(bare, "/+$", ""))


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www\.", "")


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 16 hex digits of the sha256 of the parts, joined by 0x1f, null as empty."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 16))


def categories(text: Column, patterns: dict[str, str]) -> Column:
    """Array of (category, matched): the first match of each category's pattern, case ignored."""
    found = [F.struct(F.lit(k).alias("category"), F.regexp_extract(text, f"(?i)({p})", 1).alias("matched")) for k, p in patterns.items()]
    return F.filter(F.array(*found), lambda x: x["matched"] != "")


def keywords(text: Column, generic: list[str], least: int = 4) -> Column:
    """Distinct words of at least ``least`` characters, in order, that are neither generic nor digits."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= least) & ~w.rlike("^[0-9]+$")))
    return F.array_except(words, F.array(*map(F.lit, generic))) if generic else words


def post_author(url: Column) -> Column:
    """Handle of a post's author."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)(?:x|twitter)\.com/([A-Za-z0-9_]{1,15})/status/", 1)), F.lit(""))


def link_kind(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.rlike(r"(x|twitter)\.com/[^/]+/status/"), "post").when(low.rlike(r"(x|twitter)\.com/i/communities/"), "community").when(low.rlike(r"(x|twitter)\.com/[a-z0-9_]+/?$"), "profile").when(low == "", "none").otherwise("other")


def symbol_base(symbol: Column) -> Column:
    """(base, multiplier) of symbols such as 1000X, 1MX or kX."""
    multiple = F.when(symbol.rlike("^1000000[A-Z]|^1M[A-Z]"), 1_000_000).when(symbol.rlike("^1000[A-Z]|^k[A-Z]"), 1000).otherwise(1)
    return F.struct(F.regexp_replace(symbol, "^(1000000|1000|1M|k)(?=[A-Z])", "").alias("base"), multiple.cast("long").alias("multiple"))


def error_class(text: Column, blocked: list[str]) -> Column:
    """blocked if one of the marks occurs in the error, else error; null without an error."""
    low = F.lower(text)
    return F.when(text.isNull(), None).when(F.exists(F.array(*map(F.lit, blocked)), lambda m: F.contains(low, m)), "blocked").otherwise("error")
