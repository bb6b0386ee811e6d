"""Value classification and report arithmetic as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of personal data, in one spelling that Java, Python and RE2 read alike.  A host name has 127 labels at
# most, as in its standard, since Java recurses once for each repeat of a group
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{0,4}\b"
#: Full and compressed IPv6 addresses, and not clock times or MAC addresses.
IPV6_STRICT = r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})?|::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6}))(?![0-9A-Za-z:])"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
FQDN = r"\b(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,}\b"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
USER_NOUN_SEARCH = r"(?i)\b(?:user|username|account)\b\s*(?:name\s*)?[:=]\s*[A-Za-z0-9_.@%+=-]{2,64}"
USER_AUTH_SEARCH = r"(?i)\b(?:login|logon|sign[- ]?in|authenticat(?:e|ed|ion))\b\s+(?:as|for|by)\s+(?:\buser\b\s+)?[A-Za-z0-9_.@%+=-]{2,64}\b"
FREE_TEXT_NAME = r"(?i)original|\.message$|\.log$|raw|payload|details|description|text|event\.name"

UNMEASURABLE, COMPLETE, PARTIAL, SPARSE, NEVER = "unmeasurable", "complete", "partial", "sparse", "never"
#: Percentage points beyond which coverage is said to have drifted.
DRIFT = 20.0


def re2(pattern: str) -> str:
    """A pattern for SQL engines on RE2, which bounds the product of nested repeats and needs no bound on recursion."""
    return pattern.replace("{1,126}", "+")


def java(pattern: str) -> str:
    """An equal pattern for Spark that reads a long run of one alphabet a bounded number of times.

    All places of a run of address characters match or none does, so only its first word boundary counts: what stands
    before that is short, or all of one kind.  A host name is not looked for behind a label: it would have started there.
    """
    if pattern == EMAIL:
        own = "[A-Za-z0-9._%+-]"
        return pattern.replace(f"\\b{own}+", rf"\b(?:(?<!{own}{{32}})|(?<=[.%+-]{{32}})|(?<=[A-Za-z0-9_]{{32}})){own}++", 1)
    if pattern == FQDN:
        label = r"\b[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
        return f"(?>(?<!\\.)|(?<!{label}\\.)){pattern}"
    return pattern


def unicode(pattern: str) -> str:
    """A pattern for Spark whose \\w and \\b are Unicode, as they are in Python."""
    return "(?U)" + java(pattern)


def value_kind(value: Column) -> Column:
    """EMAIL, IP_ADDRESS or HOSTNAME when the whole stripped value is one; else null."""
    v = F.trim(value)
    whole = lambda p: v.rlike(rf"^(?:{p})$")
    return F.when(whole(EMAIL), "EMAIL").when(whole(IPV4) | whole(IPV6), "IP_ADDRESS").when(whole(FQDN) & ~v.contains("://"), "HOSTNAME")


def embeds_personal_data(value: Column) -> Column:
    patterns = (IPV4, IPV6, EMAIL, USER_AUTH_SEARCH, USER_NOUN_SEARCH)
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(java(p))
    return F.coalesce(found, F.lit(False))


def percent(docs: Column, total: Column) -> Column:
    """A share in percent; null where there is nothing to divide by, which is not the same as 0."""
    return F.when(docs.isNotNull() & (total > 0), 100.0 * docs / total)


def percent_label(docs: Column, total: Column) -> Column:
    """A share as text that never rounds to a whole: 100.0% only when complete, 0.0% only when empty, - when not measurable."""
    p = percent(docs, total)
    return (
        F.when(p.isNull(), "-")
        .when(docs == total, "100.0%")
        .when(p >= 99.95, "99.9%")
        .when((p > 0) & (p < 0.05), "<0.1%")
        .otherwise(F.format_string("%.1f%%", p))
    )


def plain_percent(docs: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%%", 100.0 * docs / total)).otherwise("-")


def drift(window_pct: Column, total_pct: Column) -> Column:
    return window_pct - total_pct


def drift_label(points: Column) -> Column:
    return F.when(points.isNull(), "-").when(F.abs(points) < 0.05, "+0.0pp").otherwise(F.format_string("%+.1fpp", points))


def coverage_category(measurable: Column, pct: Column) -> Column:
    return (
        F.when(~measurable | pct.isNull(), UNMEASURABLE)
        .when(pct >= 99, COMPLETE)
        .when(pct >= 50, PARTIAL)
        .when(pct > 0, SPARSE)
        .otherwise(NEVER)
    )
