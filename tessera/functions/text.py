"""Text expressions: terms, character shares, normal forms, extraction. All are native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it.

    A column expression is a tree: what Python names once stands in it at every use, and in a lambda is computed anew at each.
    Spark takes two lambdas that differ in variables of outer ones alone for equal (and ``~a & b`` of such for false); bind a struct there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cjk_ratio(text: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, f"[^{CJK}]", "")) / n).otherwise(F.lit(0.0))


def looks_garbled(text: str) -> Column:
    """Long enough, no CJK, and fewer than 0.55 ASCII letters a character."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return (F.length(F.trim(text)) >= 20) & (cjk_ratio(text) == 0) & (letters / F.length(text) < 0.55)


def lexical_terms(text: Column) -> Column:
    """Distinct terms in order: Latin tokens of two characters or more in lower case; CJK runs of up to 8 whole, and bigrams."""
    tokens = F.regexp_extract_all(text, F.lit("([A-Za-z0-9][A-Za-z0-9._/-]+)"), 1)
    # one string is lowered, not each token
    latin = F.array_remove(F.split(F.lower(F.array_join(tokens, " ")), " "), "")
    runs = F.regexp_extract_all(text, F.lit(f"([{CJK}]+)"), 1)
    whole = F.filter(runs, lambda x: F.length(x) <= 8)
    grams = F.flatten(F.transform(F.filter(runs, lambda x: F.length(x) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.when(text.rlike(f"[{CJK}]"), F.concat(latin, whole, grams)).otherwise(latin))


def designation_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[^0-9a-z{CJK}]", "")


def squeezed(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), "\\s+", "")


def basename(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(path, "\\\\", "/"), "/"), -1))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(\\d+(?:\\.\\d+)?)"), 1))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def error_class(message: Column) -> Column:
    """provider_timeout, provider_rate_limit or provider_error; null where there is no message."""
    m = F.lower(message)
    kind = F.when(m.rlike("timeout|timed out|deadline|超时"), "provider_timeout").when(m.rlike("rate limit|rate_limit|429|限流|too many requests"), "provider_rate_limit").otherwise("provider_error")
    return F.when(F.length(message) > 0, kind)


def first_heading(text: Column) -> Column:
    """The first ``#`` heading within twenty lines, without its marks."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.ltrim(x).startswith("#"))
    return F.trim(F.regexp_replace(F.ltrim(F.get(lines, F.lit(0))), "^#+", ""))


def json_object(text: Column) -> Column:
    """The widest ``{...}`` in a reply, or null."""
    return F.nullif(F.regexp_extract(text, "(?s)(\\{.*\\})", 1), F.lit(""))


def cylinder_ml(diameter_mm: Column, height_mm: Column) -> Column:
    valid = (diameter_mm > 0) & (height_mm > 0)
    return F.when(valid, F.round(F.pi() * diameter_mm * diameter_mm / 4 * height_mm / 1000, 3))


#: What models append to answers (fixed values).
CONTROL, TAG = "(?i)(?:\\s*[.。]?\\s*(?:\\.calc|\\.analysis|\\.final|\\.answer|\\.summary|\\.end))+\\s*$", "(?i)(?:\\s*</?(?:answer|response|output|final)>\\s*)+\\s*$"


def sanitised(answer: Column) -> Column:
    """struct(text, rules): an answer without control tokens, tags and white space at its end, and the rules that changed it."""
    raw = F.coalesce(answer, F.lit(""))
    one = F.regexp_replace(raw, CONTROL, "")
    two = F.regexp_replace(one, TAG, "")
    three = F.regexp_replace(two, "\\s+$", "")
    rules = F.filter(F.array(F.when(one != raw, "remove_trailing_control_token"), F.when(two != one, "remove_trailing_tag"), F.when(three != two, "rstrip_trailing_whitespace")), lambda x: x.isNotNull())
    return F.struct(three.alias("text"), rules.alias("rules"))


def percent(value: Column) -> Column:
    """A share as a percentage with one place; a dash where there is none."""
    return F.when(value.isNotNull(), F.format_string("%.1f%%", 100 * value)).otherwise("—")


def slug(name: Column) -> Column:
    """Lower case with single hyphens for all that is not a letter, digit, dot or underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9._]+", "-"), "^-+|-+$", "")


def local_deadline(total: Column, reserved: Column, now: Column) -> Column:
    """When local work must end so that ``reserved`` seconds stay before the total deadline, but not before now."""
    return F.greatest(now, total - F.greatest(F.lit(0.0), reserved))


def composite_id(*parts: Column) -> Column:
    """Sixteen hex digits of the hash of several values."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)
