"""Column expressions over names, web addresses, phones and e-mail."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filled(c: ColumnOrName) -> Column:
    """The value without outer spaces, null if nothing is left."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def present(c: ColumnOrName) -> Column:
    return F.coalesce(F.length(F.trim(col(c))) > 0, F.lit(False))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(n)) for n in needles)


def first_of(pairs: Iterable[tuple[Column, str]]) -> Column:
    """The value of the first true condition; null if there is none."""
    return F.coalesce(F.lit(None).cast("string"), *[F.when(c, F.lit(v)) for c, v in pairs])


def matches_any(text: Column, needles: Iterable[str]) -> Column:
    """As contains_any, in one pass of a pattern."""
    import re

    return text.rlike("|".join(re.escape(n) for n in needles))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with the named columns worked out once: the optimiser puts a filter on them
    after this point instead of writing their expressions out in it, again and again."""
    have = [c for c in names if c in df.columns]
    rest = [c for c in df.columns if c not in have]
    return df.select(*rest, F.inline(F.array(F.struct(*have)))).select(*df.columns) if have else df


def host(url: ColumnOrName) -> Column:
    """Lower-case host without user and port; '' if there is none."""
    authority = F.regexp_extract(F.trim(col(url)), r"^(?:[^:/?#]+://|(?!.*://))([^/?#]*)", 1)
    return F.coalesce(F.lower(F.regexp_replace(authority, r"^[^@]*@|:[0-9]*$", "")), F.lit(""))


def site_host(url: ColumnOrName) -> Column:
    """Lower-case authority (port kept) without a leading www.; '' if there is none."""
    authority = F.regexp_extract(F.trim(col(url)), r"^(?:(?i)https?://)?([^/?#]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(authority), r"^www\.", ""), F.lit(""))


def registrable(h: ColumnOrName) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(col(h), r"([^.]*\.)?[^.]*$", 0)


def on_domain(h: Column, domain: str) -> Column:
    """Equality or a dot boundary: fedex.com is not on x.com."""
    return (h == domain) | h.endswith(f".{domain}")


def listed_domain(h: Column, domains: Iterable[str]) -> Column:
    """The listed domain a host equals or lies under; null if none. Domains of two labels
    are looked up by the host's last two, longer ones first and one by one."""
    longer = [d for d in domains if d.count(".") > 1]
    short = [d for d in domains if d.count(".") == 1]
    by_label = F.when(registrable(h).isin(*short), registrable(h))
    return F.coalesce(first_of((on_domain(h, d), d) for d in longer), by_label) if longer else by_label


def weak_domain(url: ColumnOrName, domains: Iterable[str] = V.WEAK_DOMAINS) -> Column:
    """The listed domain a web address is on; 'no website' for none; else null."""
    return F.when(~present(url), F.lit("no website")).otherwise(listed_domain(host(url), domains))


def weak_substring(url: ColumnOrName, patterns: Iterable[str] = V.WEAK_SUBSTRINGS) -> Column:
    return F.coalesce(matches_any(F.lower(col(url)), patterns), F.lit(False))


def name_key(name: ColumnOrName) -> Column:
    """Letters and digits without legal and trade words."""
    spaced = F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9 ]+", " ")
    words = r"\b(" + "|".join(V.NAME_NOISE) + r")\b"
    return F.regexp_replace(F.regexp_replace(spaced, words, " "), " +", "")


def name_key_plain(name: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9]+", "")


def name_tokens(name: ColumnOrName) -> Column:
    """Words of more than two letters or digits."""
    return F.filter(F.split(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def _ten_digits(phone: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(phone, "[^0-9]", ""), "^1([0-9]{10})$", "$1")


def format_ten(d: Column) -> Column:
    return F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))


def phone_fmt(phone: ColumnOrName) -> Column:
    p = F.nullif(col(phone), F.lit(""))
    d = _ten_digits(p)
    return F.when(d.rlike("^[0-9]{10}$"), F.regexp_replace(d, "^([0-9]{3})([0-9]{3})([0-9]{4})$", "($1) $2-$3")).otherwise(p)


def area_code(phone: ColumnOrName) -> Column:
    d = _ten_digits(F.nullif(col(phone), F.lit("")))
    return F.when(F.length(d) >= 3, F.substring(d, 1, 3))


def social_platforms(socials: ColumnOrName, loose: bool = True) -> Column:
    """Platforms of `|`-joined addresses in order, each once; null if none.

    ``loose`` also takes a host that merely ends in a domain's letters (netflix.com
    counts as x.com), as the rule has always done.
    """

    def of(h: Column) -> Column:
        ends = lambda d: h.endswith(d) if loose else on_domain(h, d)
        return F.array_compact(F.array(*[F.when(ends(d), F.lit(label)) for d, label in V.SOCIAL_DOMAINS.items()]))

    hosts = F.transform(F.split(col(socials), r"\|"), site_host)
    found = F.array_distinct(F.flatten(F.transform(hosts, of)))
    return F.nullif(F.array_join(found, "|"), F.lit(""))


def email_domain(email: ColumnOrName) -> Column:
    return F.lower(F.element_at(F.split(col(email), "@"), -1))


def email_owned(email: ColumnOrName, website: ColumnOrName) -> Column:
    own = registrable(email_domain(email))
    same = present(email) & (F.length(col(website)) > 0) & (own != "") & (own == registrable(site_host(website)))
    return F.coalesce(same, F.lit(False)).cast("int")


def best_contact(phone: ColumnOrName, email: ColumnOrName, platforms: ColumnOrName) -> Column:
    return (
        F.when(present(phone), "phone").when(present(email), "email").when(col(platforms).isNotNull(), "social").otherwise("none")
    )


def good_email(email: ColumnOrName) -> Column:
    e = col(email)
    low = F.lower(e)
    domain = F.element_at(F.split(e, "@"), -1)
    shape = e.rlike(r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$")
    junk = any_of(low.startswith(p) for p in V.JUNK_PREFIXES)
    return F.coalesce(shape & ~junk & ~domain.isin(*V.JUNK_DOMAINS), F.lit(False))


def fingerprint(name: ColumnOrName, website: ColumnOrName, phone: ColumnOrName, city: ColumnOrName) -> Column:
    """12 hex digits that identify a lead over runs."""
    parts = [F.lower(F.coalesce(F.trim(col(c)), F.lit(""))) for c in (name, website, phone, city)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
