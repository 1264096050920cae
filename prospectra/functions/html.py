"""Column expressions over the HTML of one page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .columns import ColumnOrName, any_of, col, contains_any, first_of, format_ten

# Patterns.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:\+?1[ \t\n.\-]?)?\(?[0-9]{3}\)?[ \t\n.\-]?[0-9]{3}[ \t\n.\-]?[0-9]{4}"
MAILTO = "(?i)mailto:([^\"'?> \t\n]+)"
YEAR = r"(?i)(?:©|&copy;|copyright)[ \t\n]*(?:[0-9, \t\n\-]*?)(20[0-2][0-9])"
PROFILE_LINK = r'(?i)href="[^"]*/(?:agent|agents|team|our-team|associates?)/([a-z0-9][a-z0-9\-_]{1,60})/?["#?]'
LICENCE = r"(?i)(?:dre|calbre|lic|license|bre)[ \t\n]*#?[ \t\n]*([0-9]{6,8})"
GENERATOR = "(?i)<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"']([^\"']+)"
VIEWPORT = "(?i)<meta[^>]+name=[\"']viewport[\"']"
HEAD = 50_000
BODY_CASED = 200_000
BODY_DEEP = 300_000


def every(text: ColumnOrName, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(pattern), F.lit(group))


def emails(text: ColumnOrName) -> Column:
    """What EMAIL matches; a local part begins where its run of characters does, or where
    the last match ended, so no other place is tried."""
    local = r"[A-Za-z0-9._%+\-]"
    return every(text, EMAIL.replace(f"{local}+@", rf"(?:\G|(?<!{local})){local}++@"))


def title(html: ColumnOrName, version: int = 2) -> Column:
    """v1: a title without attributes, 100 characters; v2: any, spaces collapsed, 200."""
    if version == 1:
        found = F.trim(F.regexp_extract(col(html), "(?i)<title>([^<]+)</title>", 1))
        return F.substring(found, 1, 100)
    found = F.regexp_extract(col(html), "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(F.trim(F.regexp_replace(found, "[ \t\n\r]+", " ")), 1, 200)


def mobile_viewport(html: ColumnOrName, version: int = 2) -> Column:
    if version == 1:
        return F.contains(F.lower(F.substring(col(html), 1, HEAD)), F.lit('name="viewport"')).cast("int")
    return col(html).rlike(VIEWPORT).cast("int")


def generator(html: ColumnOrName) -> Column:
    return F.nullif(F.substring(F.regexp_extract(col(html), GENERATOR, 1), 1, 80), F.lit(""))


def builder_v1(html: ColumnOrName) -> Column:
    head = F.lower(F.substring(col(html), 1, HEAD))
    return F.coalesce(first_of((contains_any(head, needles), name) for name, needles in V.BUILDERS_LOWER), F.lit(""))


def builder_v2(html: ColumnOrName, headers: Column | None = None) -> Column:
    body = F.substring(col(html), 1, BODY_CASED)
    more = headers if headers is not None else F.lit("")
    return first_of((contains_any(body, n) | contains_any(more, n), name) for name, n in V.BUILDERS_CASED)


def builder_deep(html: ColumnOrName, headers: Column | None = None) -> Column:
    """Also a hit if the generator meta names the builder."""
    body = F.substring(col(html), 1, BODY_DEEP)
    more = headers if headers is not None else F.lit("")
    made_by = F.lower(F.coalesce(generator(html), F.lit("")))
    return first_of(
        (F.contains(made_by, F.lit(name.lower())) | contains_any(body, n) | contains_any(more, n), name) for name, n in V.BUILDERS_DEEP
    )


def has_analytics(html: ColumnOrName) -> Column:
    return contains_any(F.lower(col(html)), V.ANALYTICS).cast("int")


def copyright_year(html: ColumnOrName, as_of_year: int) -> Column:
    years = F.transform(every(html, YEAR, 1), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: (y >= 2000) & (y <= as_of_year)))


def raw_emails(html: ColumnOrName) -> Column:
    """mailto targets, then addresses in the text, lower case, each once, unfit ones out."""
    targets = F.flatten(F.transform(every(html, MAILTO, 1), emails))
    both = F.transform(F.concat(targets, emails(html)), F.lower)

    def fit(e: Column) -> Column:
        domain = F.element_at(F.split(e, "@"), -1)
        junk = any_of((domain == d) | domain.endswith(f".{d}") for d in V.AUDIT_JUNK_DOMAINS)
        return ~any_of(e.endswith(s) for s in V.ASSET_SUFFIXES) & ~junk & (F.length(e) <= 60)

    return F.array_distinct(F.filter(both, fit))


def contact_emails(html: ColumnOrName) -> Column:
    return F.array_join(F.slice(raw_emails(html), 1, 5), "|")


def raw_phones(html: ColumnOrName) -> Column:
    def digits(m: Column) -> Column:
        d = F.regexp_replace(m, "[^0-9]", "")
        return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)

    ten = F.filter(F.transform(every(html, PHONE), digits), lambda d: (F.length(d) == 10) & ~F.substring(d, 1, 1).isin("0", "1"))
    return F.array_distinct(F.transform(ten, format_ten))


def contact_phones(html: ColumnOrName) -> Column:
    return F.array_join(F.slice(raw_phones(html), 1, 5), "|")


def visible_text(html: ColumnOrName) -> Column:
    return F.regexp_replace(F.regexp_replace(col(html), "<[^>]+>", " "), r"\s+", " ")
