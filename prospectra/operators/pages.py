"""Jobs over captured pages: crawl(lead_id, page_ord, url, final_url, status, load_ms, html).

Signals are read from each page before anything is shuffled; only the small results,
never the HTML, travel to the lead they belong to.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import scoring as S
from ..functions import values as V
from ..functions.columns import any_of, contains_any, host, listed_domain, name_key, name_tokens, settled
from .joins import first_per_key
from .shared import cut


def select_pages(crawl: DataFrame, cap: int = 4, least: int = 500) -> DataFrame:
    """The homepage (first in order) if it answered, and the first ``cap`` further pages
    that answered with more than ``least`` characters; by keys, without their HTML."""
    firsts = crawl.groupBy("lead_id").agg(F.min("page_ord").alias("_home"))
    return _selected(crawl.select("lead_id", "page_ord", "status", F.length("html").alias("size")), firsts, cap, least)


def _selected(pages: DataFrame, firsts: DataFrame, cap: int, least: int) -> DataFrame:
    keys = pages.select("lead_id", "page_ord", (F.col("status").between(1, 399)).alias("_ok"), F.col("size").alias("_size")).join(firsts, "lead_id")
    home = F.col("page_ord") == F.col("_home")
    good = keys.withColumn("is_home", home).filter(F.col("_ok") & (F.col("is_home") | (F.col("_size") > least)))
    order = Window.partitionBy("lead_id", "is_home").orderBy("page_ord")
    return good.withColumn("_k", F.row_number().over(order)).filter(F.col("is_home") | (F.col("_k") <= cap)).select("lead_id", "page_ord", "is_home")


# Signals are exploded with their empty lists, whose null is dropped afterwards: before a
# plain explode Spark would test the list, and work it out from the page again for that.


def _max_distinct(pages: DataFrame, signal: str, name: str) -> DataFrame:
    """(lead_id, name): number of different values over a lead's pages."""
    each = pages.select("lead_id", F.explode_outer(signal).alias("v")).filter("v is not null").distinct()
    return each.groupBy("lead_id").agg(F.count("*").alias(name))


def roster_size(pages: DataFrame, card_patterns=V.CARD_PATTERNS, cap: int = 1000) -> DataFrame:
    """(lead_id, agent_count): profile links or licence numbers, whichever has more
    different ones; with fewer than two, the most cards of one kind on a page counts."""
    return _roster(pages.select("lead_id", "html", F.lower("html").alias("_low")).select("lead_id", *_roster_signals("html", "_low", card_patterns)), cap)


def _roster_signals(html: str, low: str, card_patterns) -> list[Column]:
    """cards, slugs and licences of one page, given also in lower case."""
    found = lambda p: F.array_distinct(F.transform(H.every(html, p, 1), F.lower))
    cards = F.greatest(*[F.size(H.every(low, p)) for p in card_patterns])
    return [cards.alias("cards"), found(H.PROFILE_LINK).alias("slugs"), found(H.LICENCE).alias("licences")]


def _roster(pages: DataFrame, cap: int) -> DataFrame:
    base = pages.groupBy("lead_id").agg(F.max("cards").alias("cards"))
    slugs = _max_distinct(pages, "slugs", "slugs")
    licences = _max_distinct(pages, "licences", "licences")
    best = F.greatest(F.coalesce("slugs", F.lit(0)), F.coalesce("licences", F.lit(0)))
    joined = base.join(slugs, "lead_id", "left").join(licences, "lead_id", "left").withColumn("best", best)
    count = F.when(F.col("best") < 2, F.greatest("best", "cards")).otherwise(F.col("best"))
    return joined.select("lead_id", F.least(count, F.lit(cap)).cast("int").alias("agent_count"))


def roster_size_v0(pages: DataFrame, cap: int = 500) -> DataFrame:
    """(lead_id, agent_count): raw counts on one page, the largest."""
    low = F.lower("html")
    counts = [F.regexp_count(low, F.lit(p)) for p in ('href="[^"]*/agents?/', r"dre[ \t\n]*#|license[ \t\n]*#|lic[ \t\n]*#", "mailto:")]
    return pages.groupBy("lead_id").agg(F.least(F.max(F.greatest(*counts)), F.lit(cap)).alias("agent_count"))


def phrases_found(pages: DataFrame, phrases=V.HIRING_PHRASES + V.IN_HOUSE_PHRASES) -> DataFrame:
    """(lead_id, phrases): those found on any page, in the list's order."""
    flags = pages.groupBy("lead_id").agg(*[F.max(F.contains(F.lower("html"), F.lit(p)).cast("int")).alias(f"p{k}") for k, p in enumerate(phrases)])
    return flags.select("lead_id", F.array_compact(F.array(*[F.when(F.col(f"p{k}") == 1, F.lit(p)) for k, p in enumerate(phrases)])).alias("phrases"))


def coordination_gap(leads: DataFrame, pages: DataFrame, hiring=V.HIRING_PHRASES, in_house=V.IN_HOUSE_PHRASES, software=None) -> DataFrame:
    """``leads`` with gap, software and evidence: hiring, in_house, software or open by
    the first hit in that order; unknown without a site or without a page."""
    tools = software or V.COORDINATION_SOFTWARE
    return _gap(leads, pages.select("lead_id", F.lower("html").alias("_low")).select("lead_id", *_first_needles("_low", hiring, in_house, tools)), hiring, in_house, tools)


def _first_needles(low: str, hiring, in_house, tools) -> list[Column]:
    """hire, own and tool: the place of the first text of each list that a column of lower
    case holds, null if it holds none."""
    first = lambda texts: F.coalesce(F.lit(None).cast("int"), *[F.when(F.contains(low, F.lit(p)), F.lit(k)) for k, p in enumerate(texts)])
    return [first(texts).alias(name) for name, texts in (("hire", hiring), ("own", in_house), ("tool", tools))]


def _gap(leads: DataFrame, pages: DataFrame, hiring, in_house, tools: dict[str, str]) -> DataFrame:
    found = pages.groupBy(F.col("lead_id").alias("id")).agg(F.lit(True).alias("_read"), *[F.min(c).alias(f"_{c}") for c in ("hire", "own", "tool")])
    named = lambda k, texts: F.get(F.array(*[F.lit(t) for t in texts]), k) if len(texts) else F.lit(None).cast("string")
    readable = F.coalesce(F.length("website") > 0, F.lit(False)) & F.coalesce("_read", F.lit(False))
    gap = F.when(~readable, "unknown").when(F.col("_hire").isNotNull(), "hiring").when(F.col("_own").isNotNull(), "in_house").when(F.col("_tool").isNotNull(), "software").otherwise("open")
    out = leads.join(found, "id", "left").withColumn("gap", gap)
    out = out.withColumn("software", F.when(F.col("gap") == "software", named(F.col("_tool"), list(tools.values()))))
    evidence = F.when(F.col("gap") == "hiring", named(F.col("_hire"), hiring)).when(F.col("gap") == "in_house", named(F.col("_own"), in_house)).otherwise(F.col("software"))
    return out.withColumn("evidence", evidence).drop("_read", "_hire", "_own", "_tool")


def coordination(leads: DataFrame, crawl: DataFrame, hiring, in_house, software: dict[str, str], card_patterns, titles, noise=V.NON_NAME_WORDS) -> DataFrame:
    """``leads`` with gap, software, evidence, agent_count, decision_maker and dm_title.
    The pages are read once; what was found in each is stored without its HTML."""
    texts = crawl.select("lead_id", "page_ord", "html", F.lower("html").alias("_low"), H.visible_text("html").alias("_text"))
    seen = cut(
        texts.select(
            "lead_id", "page_ord", *_first_needles("_low", hiring, in_house, software), *_roster_signals("html", "_low", card_patterns),
            _titled("_text", titles).alias("people"),
        )
    )
    out = _gap(leads, seen, hiring, in_house, software)
    size = _roster(seen, 1000).withColumnRenamed("lead_id", "id")
    who = _senior(seen, titles, noise).withColumnRenamed("lead_id", "id")
    return out.join(size, "id", "left").join(who, "id", "left")


# Patterns.
_NAME = r"[A-Za-z][a-zA-Z'’\-]+(?:\s+[A-Za-z][a-zA-Z'’\-]+){1,2}"
_BETWEEN = r"\s*[,–—\-:|]\s*"
_IN_NAME = r"[a-zA-Z'’\-]"


def _clean_name(raw: Column, noise) -> Column:
    """The last two or three words of a plausible name, null else."""
    noisy = lambda w: F.lower(w).isin(*noise)
    upper = lambda w: F.substring(w, 1, 1).rlike(r"^\p{Lu}")

    def own(words: Column) -> Column:
        lead = F.aggregate(
            words,
            F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda s, w: F.struct((s["n"] + (s["on"] & noisy(w)).cast("int")).alias("n"), (s["on"] & noisy(w)).alias("on")),
            lambda s: s["n"],
        )
        return F.slice(words, lead + 1, F.size(words))

    def plausible(kept: Column) -> Column:
        ok = F.size(kept).between(2, 3) & ~F.exists(kept, noisy) & F.forall(kept, upper)
        return F.when(ok, F.array_join(kept, " "))

    words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    last = lambda kept: F.when(F.size(kept) > 3, F.slice(kept, -3, 3)).otherwise(kept)
    # steps over a list of one, each worked out once
    return F.get(F.transform(F.transform(F.transform(F.array(words), own), last), plausible), 0)


def decision_maker(pages: DataFrame, titles=V.BROKERAGE_TITLES, noise=V.NON_NAME_WORDS) -> DataFrame:
    """(lead_id, decision_maker, dm_title): "Name, Title" or "Title: Name" in the visible
    text; the most senior title wins, the first page, form and place on a tie."""
    texts = pages.select("lead_id", "page_ord", H.visible_text("html").alias("_text"))
    return _senior(texts.select("lead_id", "page_ord", _titled("_text", titles).alias("people")), titles, noise)


def _title_patterns(titles) -> tuple[str, str, str]:
    """What a text with "Name, Title" holds at least; "Name, Title" with groups 1 and 2;
    "Title: Name" with 2 and 1. The last two match what ``_NAME``, ``_BETWEEN`` and any of
    the titles match, but fail fast: a name begins at the first letter of its word, its words
    but the last are whole, and the last ends with its word or before a hyphen, so no other
    place is tried. Titles that are no plain texts are tried at every word."""
    alternatives = "|".join(sorted(titles, key=len, reverse=True))
    plain = all(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9 /&'\-]*", t) for t in titles)
    begin = f"(?=[{''.join(sorted({t[0].lower() for t in titles}))}])" if plain and titles else ""
    whole, ended = rf"[A-Za-z]{_IN_NAME}++", r"(?=\s*+[,–—\-:|])"
    cut_off = rf"[A-Za-z](?=[a-zA-Z'’]*+-){_IN_NAME}+(?=-)"
    name = rf"{whole}\s++(?:{whole}(?:\s++(?:{whole}{ended}|{cut_off})|{ended})|{cut_off})"
    return (
        rf"(?i)[,–—\-:|]\s*(?:{alternatives})\b",
        rf"(?i)(?:\G|(?<!{_IN_NAME}))['’\-]*+({name}){_BETWEEN}({alternatives})\b",
        rf"(?i)\b{begin}({alternatives})\s*+[,–—\-:|]\s*+({_NAME})",
    )


def _titled(text: str, titles) -> Column:
    """Names with a title in a column of visible text: (form, at, name, title). A text is
    matched once for each form; the matches are taken apart by themselves."""
    least, named, titled = _title_patterns(titles)
    every = lambda p: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))
    first = F.when(F.col(text).rlike(least), every(named)).otherwise(F.array().cast("array<string>"))
    # a match that is read again by itself ends where its title does
    alone = named.removesuffix(r"\b") + r"(?:\b|\z)"
    return F.concat(F.transform(first, _tagged(0, alone, 1, 2)), F.transform(every(titled), _tagged(1, titled, 2, 1)))


def _senior(pages: DataFrame, titles, noise) -> DataFrame:
    """The person of the most senior title among (lead_id, page_ord, people)."""
    hits = pages.select("lead_id", "page_ord", F.explode_outer("people").alias("m"))
    ranks = F.create_map(*[F.lit(v) for k, title in enumerate(titles) for v in (title, k)])
    title = F.trim(F.regexp_replace(F.col("m.title"), r"^[ .,\-—–]+|[ .,\-—–]+$", ""))
    named = hits.select(
        "lead_id", "page_ord", F.col("m.form").alias("form"), F.col("m.at").alias("at"), title.alias("dm_title"), _clean_name(F.col("m.name"), noise).alias("decision_maker")
    )
    named = settled(named, "decision_maker").filter("decision_maker is not null")
    ranked = named.withColumn("rank", F.coalesce(F.try_element_at(ranks, F.lower("dm_title")), F.lit(len(titles))))
    return first_per_key(ranked, "lead_id", F.col("rank"), F.col("page_ord"), F.col("form"), F.col("at")).select("lead_id", "decision_maker", "dm_title")


def _tagged(form: int, pattern: str, name: int, title: int):
    part = lambda m, group: F.regexp_extract(m, pattern, group)
    return lambda m, at: F.struct(F.lit(form).alias("form"), at.alias("at"), part(m, name).alias("name"), part(m, title).alias("title"))


def _first_values(pages: DataFrame, values: Column, name: str, limit: int = 5) -> DataFrame:
    """(lead_id, name): the first different values over a lead's pages, `|`-joined. Values
    are taken from a page before anything is shuffled."""
    each = pages.select("lead_id", "page_ord", F.posexplode(values).alias("at", "v"))
    first = each.groupBy("lead_id", "v").agg(F.min(F.struct("page_ord", "at")).alias("o"))
    rows = Window.partitionBy("lead_id").orderBy("o")
    few = first.withColumn("k", F.row_number().over(rows)).filter(F.col("k") <= limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]), "|")
    return few.groupBy("lead_id").agg(joined.alias(name))


def contact_emails(pages: DataFrame) -> DataFrame:
    """(lead_id, emails): mailto targets of all pages first, then the text of all."""
    return _first_emails(pages.select("lead_id", "page_ord", _addresses("html").alias("mails")))


def _addresses(html: str) -> Column:
    """(kind, e): mailto targets of a page (kind 0), then addresses in its text (1)."""
    targets = F.flatten(F.transform(H.every(html, H.MAILTO, 1), H.emails))
    kind = lambda n: lambda e: F.struct(F.lit(n).alias("kind"), F.lower(e).alias("e"))
    return F.concat(F.transform(targets, kind(0)), F.transform(H.emails(html), kind(1)))


def _first_emails(pages: DataFrame) -> DataFrame:
    each = pages.select("lead_id", "page_ord", F.posexplode_outer("mails").alias("at", "m")).select("lead_id", "m.kind", "page_ord", "at", F.col("m.e").alias("v"))
    domain = F.element_at(F.split("v", "@"), -1)
    junk = any_of((domain == d) | domain.endswith(f".{d}") for d in V.AUDIT_JUNK_DOMAINS)
    good = each.filter(~any_of(F.col("v").endswith(s) for s in V.ASSET_SUFFIXES) & ~junk & (F.length("v") <= 60))
    first = good.groupBy("lead_id", "v").agg(F.min(F.struct("kind", "page_ord", "at")).alias("o"))
    few = first.withColumn("k", F.row_number().over(Window.partitionBy("lead_id").orderBy("o"))).filter("k <= 5")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]), "|")
    return few.groupBy("lead_id").agg(joined.alias("emails"))


def best_email(pages: DataFrame) -> DataFrame:
    """(lead_id, email) from the first page with a usable one: a general mailbox first,
    then the shortest, then by letters."""
    from ..functions.columns import good_email

    found = F.transform(F.concat(H.every("html", r"(?i)href=[\"']mailto:([^\"'?>]+)", 1), H.emails("html")), lambda e: F.lower(F.trim(e)))
    each = pages.select("lead_id", "page_ord", F.explode(F.array_distinct(F.filter(found, good_email))).alias("email"))
    general = F.element_at(F.split("email", "@"), 1).isin(*V.GENERIC_LOCAL_PARTS)
    order = [F.col("page_ord"), F.when(general, 0).otherwise(1), F.length("email"), F.col("email")]
    return first_per_key(each, "lead_id", *order).select("lead_id", "email")


def contact_phones(pages: DataFrame) -> DataFrame:
    return _first_values(pages, H.raw_phones("html"), "phones_found")


def copyright_stale(pages: DataFrame, as_of_year: int) -> DataFrame:
    """(lead_id, copyright_year, stale)."""
    out = pages.groupBy("lead_id").agg(F.max(H.copyright_year("html", as_of_year)).alias("copyright_year"))
    return out.withColumn("stale", F.coalesce(F.col("copyright_year") <= as_of_year - 3, F.lit(False)).cast("int"))


def page_signals(crawl: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Titles, viewport, builders and more of each page, without its HTML."""
    return crawl.select(
        "lead_id", "page_ord",
        H.title("html", 1).alias("title_v1"), H.title("html", 2).alias("title"),
        H.mobile_viewport("html", 1).alias("mobile_v1"), H.mobile_viewport("html", 2).alias("mobile"),
        H.builder_v1("html").alias("builder_v1"), H.builder_v2("html").alias("builder_v2"), H.builder_deep("html").alias("builder_live"),
        H.generator("html").alias("generator"), H.has_analytics("html").alias("has_analytics"), H.copyright_year("html", as_of_year).alias("copyright_year"),
    )


# Patterns.
_CLIENT = (
    r"[—–-]\s*[A-Z][\w.&'\- ]{2,40},\s*([A-Z][\w.&'\- ]{2,50})",
    r"alt=\"([A-Z][\w.&'\- ]{2,50})\"",
    r"(?:<cite[^>]*>|client[-_ ]?name[^>]*>)\s*([A-Z][\w.&'\- ]{2,50})",
)


def _unescaped(text: Column) -> Column:
    for entity, char in (("&mdash;", "—"), ("&ndash;", "–"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def client_names(pages: DataFrame) -> DataFrame:
    """(label, name, name_key) from competitors' pages (label, html): authors of quotes,
    image texts and attributions without words that are no names."""
    text = _unescaped(F.coalesce("html", F.lit("")))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in _CLIENT])
    each = pages.select("label", F.explode(F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, r"^[ .,\-]+|[ .,\-]+$", "")))).alias("name"))
    good = each.filter((F.length("name") >= 3) & ~contains_any(F.lower("name"), V.CLIENT_JUNK)).distinct()
    return good.withColumn("name_key", name_key("name"))


def pick_site(leads: DataFrame, serp: DataFrame, directories=V.DIRECTORY_DOMAINS, first: int = 10) -> DataFrame:
    """(lead_id, site, verdict) by the search results (lead_id, rank, url) of each lead.

    Among the first results whose host is no directory, one whose host matches a word of
    the name wins, else the first. throttled: no results were captured; unknown: no name.
    """
    target = F.coalesce(F.try_url_decode(F.nullif(F.regexp_extract("url", "uddg=([^&]+)", 1), F.lit(""))), F.col("url"))
    hits = serp.filter(F.col("rank") <= first).withColumn("site", target).withColumn("h", host("site"))
    own = hits.filter((F.col("h") != "") & listed_domain(F.col("h"), directories).isNull())
    core = F.split(F.replace(F.col("h"), F.lit("www."), F.lit("")), "[.]")[0]
    named = own.join(leads.select(F.col("id").alias("lead_id"), name_tokens("name").alias("tokens")), "lead_id").withColumn("core", core)
    by_name = F.exists("tokens", lambda t: F.contains(F.col("core"), t) | F.contains(t, F.col("core")))
    best = first_per_key(named.withColumn("miss", F.when(by_name, 0).otherwise(1)), "lead_id", F.col("miss"), F.col("rank")).select("lead_id", "site")
    seen = serp.select("lead_id").distinct().withColumn("_seen", F.lit(True))
    asked = leads.select(F.col("id").alias("lead_id"), (F.length(F.trim(F.concat_ws(" ", "name", "city", "state"))) > 0).alias("_asked"))
    out = asked.join(seen, "lead_id", "left").join(best, "lead_id", "left")
    verdict = F.when(~F.col("_asked"), "unknown").when(F.col("_seen").isNull(), "throttled").when(F.col("site").isNotNull(), "has_site").otherwise("no_site_found")
    return out.select("lead_id", "site", verdict.alias("verdict"))


def outbound_site(listings: DataFrame, own_domain: str = "yelp.com") -> DataFrame:
    """(lead_id, site): a listing's redirect target, else its structured data, else a link
    that says website; addresses on the listing's own domain do not count."""
    def fit(u: Column) -> Column:
        return F.when(u.startswith("http") & ~F.contains(u, F.lit(own_domain)), u)

    bare = lambda u: F.rtrim(F.split(u, r"\?")[0], F.lit("/"))
    one = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    redirect = bare(fit(F.try_url_decode(one(r'href="[^"]*(?:biz_redir|redirect_url)[^"]*[?&;]url=([^&"]+)'))))
    data = one(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>')
    linked = F.rtrim(F.coalesce(*[fit(F.get_json_object(data, p)) for p in ("$.url", "$.sameAs", "$.sameAs[0]")]), F.lit("/"))
    anchor = bare(fit(one(r'(?is)<a[^>]*href="(http[^"]+)"[^>]*>[^<]*(?:website|visit site|business site)[^<]*</a>')))
    return listings.select("lead_id", F.coalesce(redirect, linked, anchor).alias("site"))


def listing_count(pages: DataFrame, pattern: str = r'(?i)href="[^"]*/(?:listing|property)/') -> DataFrame:
    return pages.groupBy("lead_id").agg(F.max(F.regexp_count("html", F.lit(pattern))).alias("active_listings"))


def audit_basic(crawl: DataFrame) -> DataFrame:
    """One row a page: reachable, https by the final address, size, title, builder, notes."""
    a = crawl.select(
        "lead_id", "page_ord", ((F.col("status") > 0) & (F.col("status") < 400)).cast("int").alias("reachable"),
        F.lower("final_url").startswith("https://").cast("int").alias("https"), "load_ms",
        F.bround(F.octet_length("html") / 1024, 1).alias("size_kb"), H.title("html", 1).alias("title"),
        H.mobile_viewport("html", 1).alias("mobile"), H.builder_v1("html").alias("builder"),
    )
    return a.withColumn("notes", F.array_join(S.audit_notes("load_ms", "mobile", "https", "builder"), "; "))


def audit_ci(crawl: DataFrame) -> DataFrame:
    """The ten-field audit of each lead's homepage (its first page)."""
    homes = crawl.groupBy("lead_id").agg(F.min("page_ord").alias("page_ord"))
    page = crawl.select(
        "lead_id", "page_ord", F.col("status").alias("http_status"), F.lower("final_url").startswith("https://").cast("int").alias("https"),
        H.mobile_viewport("html").alias("mobile"), "load_ms", H.builder_v2("html").alias("builder_live"), H.title("html").alias("title"),
    )
    return page.join(homes, ["lead_id", "page_ord"], "left_semi").withColumn("audit_grade", S.audit_grade_v1("http_status", "https", "mobile", "load_ms")).drop("page_ord")


def _front(as_of_year: int) -> list[Column]:
    """What an audit tells of one page, beside its keys."""
    return [
        F.col("url").alias("input_url"), F.col("final_url"), F.col("status").alias("http_status"), F.lower("final_url").startswith("https://").cast("int").alias("https"),
        H.mobile_viewport("html").alias("mobile"), F.col("load_ms"), F.bround(F.octet_length("html") / 1024, 1).alias("size_kb"), H.builder_deep("html").alias("builder_live"),
        H.generator("html").alias("generator"), H.title("html").alias("title"), H.has_analytics("html").alias("has_analytics"), H.copyright_year("html", as_of_year).alias("copyright_year"),
    ]


def _graded(front: DataFrame, as_of_year: int) -> DataFrame:
    front = front.withColumn("stale", F.coalesce(F.col("copyright_year") <= as_of_year - 3, F.lit(False)).cast("int"))
    front = front.withColumn("site_quality", S.site_quality("http_status", "https", "mobile", "load_ms", "builder_live", "stale", "has_analytics"))
    return front.withColumn("audit_grade", S.site_grade("http_status", "site_quality"))


def audit_fronts(crawl: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Signals, quality and grade of each lead's homepage, its first page."""
    homes = crawl.groupBy("lead_id").agg(F.min("page_ord").alias("page_ord"))
    front = crawl.select("lead_id", "page_ord", *_front(as_of_year)).join(homes, ["lead_id", "page_ord"], "left_semi")
    return _graded(front.drop("page_ord"), as_of_year)


def audit_sites(crawl: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """The deep audit of each lead: homepage signals, contacts over its chosen pages,
    quality and grade. The pages are read once; what was found in each is stored without
    its HTML, and the rest works on that table."""
    seen = cut(
        crawl.withColumn("_text", H.visible_text("html")).select(
            "lead_id", "page_ord", "status", F.length("html").alias("size"), *_front(as_of_year),
            _addresses("html").alias("mails"), H.raw_phones("html").alias("phones"), _titled("_text", V.GENERAL_TITLES).alias("people"),
        )
    )
    homes = seen.groupBy("lead_id").agg(F.min("page_ord").alias("page_ord"))
    chosen = _selected(seen, homes.withColumnRenamed("page_ord", "_home"), 4, 400)
    front = seen.drop("status", "size", "mails", "phones", "people").join(homes, ["lead_id", "page_ord"], "left_semi").drop("page_ord")
    pages = seen.select("lead_id", "page_ord", "mails", "phones", "people").join(chosen.select("lead_id", "page_ord"), ["lead_id", "page_ord"], "left_semi")
    made = (
        _graded(front, as_of_year).join(chosen.groupBy("lead_id").agg(F.count("*").cast("int").alias("pages_crawled")), "lead_id", "left")
        .join(_first_emails(pages), "lead_id", "left").join(_first_values(pages, F.col("phones"), "phones_found"), "lead_id", "left")
        .join(_senior(pages, V.GENERAL_TITLES, V.GENERAL_NON_NAME_WORDS), "lead_id", "left")
    )
    blank = {c: F.coalesce(c, F.lit("")) for c in ("emails", "phones_found", "decision_maker", "dm_title")}
    return made.withColumns({**blank, "pages_crawled": F.coalesce("pages_crawled", F.lit(0))})


#: Lead ids (some 100 bytes each in memory) up to which they are broadcast.
BROADCAST_LEADS = 500_000


def discover_sites(leads: DataFrame, serp: DataFrame, crawl: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Leads without a site: what the search found, with its audit if it was captured;
    no_site or unknown else. Only pages of leads for which a site was found are audited,
    as long as those are few enough to be broadcast; else all are, which shuffles no HTML."""
    none = leads.filter(F.coalesce(F.length(F.trim("website")), F.lit(0)) == 0)
    picked = cut(pick_site(none, serp))
    ids = picked.filter("site is not null").select("lead_id").distinct()
    if ids.count() <= BROADCAST_LEADS:
        crawl = crawl.join(F.broadcast(ids), "lead_id", "left_semi")
    audits = audit_fronts(crawl, as_of_year).select("lead_id", "http_status", "site_quality", "audit_grade")
    found = picked.filter("site is not null").join(audits, "lead_id", "left").select(
        "lead_id", F.col("site").alias("discovered_site"), F.col("verdict").alias("discovery_verdict"),
        F.coalesce("site_quality", F.lit(0)).alias("site_quality"), F.coalesce("audit_grade", F.lit("broken")).alias("audit_grade"),
    )
    rest = picked.filter("site is null").select(
        "lead_id", F.lit(None).cast("string").alias("discovered_site"), F.col("verdict").alias("discovery_verdict"), F.lit(0).alias("site_quality"), S.no_site_grade("verdict").alias("audit_grade")
    )
    return found.unionByName(rest)
