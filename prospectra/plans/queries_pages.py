"""Queries over captured pages, search results and whole profile runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import scoring as S
from ..functions import values as V
from ..functions.columns import host, name_key
from ..operators import aggregates as A
from ..operators import dedupe, pages
from ..operators.shared import fresh_path
from ..sources import readers
from . import oracle as O
from . import profiles
from .registry import Tables, query

YEAR = 2026


def re_lit(pattern: str) -> str:
    return O.lit(pattern)


CHOSEN = """SELECT lead_id, page_ord, home AS is_home FROM (
 SELECT lead_id, page_ord, home, row_number() OVER (PARTITION BY lead_id, home ORDER BY page_ord) AS k FROM (
  SELECT lead_id, page_ord, status, length(html) AS size, page_ord = min(page_ord) OVER (PARTITION BY lead_id) AS home FROM crawl_v)
 WHERE status BETWEEN 1 AND 399 AND (home OR size > 500)) WHERE home OR k <= 4"""


@query(CHOSEN)
def page_selection(t: Tables) -> DataFrame:
    return pages.select_pages(t.crawl)


def _all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {re_lit(pattern)}, {group})"


_CARDS = "greatest(" + ", ".join(f"len({_all('lower(html)', p)})" for p in V.CARD_PATTERNS) + ")"


@query(f"""WITH b AS (SELECT lead_id, max({_CARDS}) AS cards FROM crawl_v GROUP BY lead_id),
 s AS (SELECT lead_id, count(DISTINCT lower(v)) AS n FROM (SELECT lead_id, unnest({_all('html', H.PROFILE_LINK, 1)}) AS v FROM crawl_v) GROUP BY lead_id),
 l AS (SELECT lead_id, count(DISTINCT v) AS n FROM (SELECT lead_id, unnest({_all('html', H.LICENCE, 1)}) AS v FROM crawl_v) GROUP BY lead_id),
 j AS (SELECT b.lead_id, b.cards, greatest(coalesce(s.n, 0), coalesce(l.n, 0)) AS best FROM b LEFT JOIN s USING (lead_id) LEFT JOIN l USING (lead_id))
 SELECT lead_id, cast(least(CASE WHEN best < 2 THEN greatest(best, cards) ELSE best END, 1000) AS int) AS agent_count FROM j""")
def roster_size(t: Tables) -> DataFrame:
    return pages.roster_size(t.crawl)


@query(f"""SELECT lead_id, cast(least(max(greatest(len({_all('lower(html)', 'href="[^"]*/agents?/')}), len({_all('lower(html)', 'dre[ \\t\\n]*#|license[ \\t\\n]*#|lic[ \\t\\n]*#')}), len({_all('lower(html)', 'mailto:')}))), 500) AS int) AS agent_count FROM crawl_v GROUP BY lead_id""")
def roster_size_v0(t: Tables) -> DataFrame:
    return pages.roster_size_v0(t.crawl)


_PHRASES = V.HIRING_PHRASES + V.IN_HOUSE_PHRASES
_BLOBS = "SELECT lead_id, lower(string_agg(html, chr(10) ORDER BY page_ord)) AS blob FROM crawl_v GROUP BY lead_id"


@query(f"SELECT lead_id, array_to_string(list_filter([{', '.join(O.lit(p) for p in _PHRASES)}], lambda p: contains(blob, p)), '|') AS phrases FROM ({_BLOBS})")
def phrases_found(t: Tables) -> DataFrame:
    return pages.phrases_found(t.crawl).withColumn("phrases", F.array_join("phrases", "|"))


def _first_in(blob: str, needles) -> str:
    return "CASE " + " ".join(f"WHEN contains({blob}, {O.lit(n)}) THEN {O.lit(v)}" for n, v in needles) + " END"


_GAP = f"""SELECT p.id, CASE WHEN coalesce(p.website, '') = '' OR b.blob IS NULL THEN 'unknown' WHEN hire IS NOT NULL THEN 'hiring' WHEN own IS NOT NULL THEN 'in_house' WHEN tool IS NOT NULL THEN 'software' ELSE 'open' END AS gap, hire, own, tool
 FROM places_v p LEFT JOIN (SELECT lead_id, blob, {_first_in('blob', [(p, p) for p in V.HIRING_PHRASES])} AS hire, {_first_in('blob', [(p, p) for p in V.IN_HOUSE_PHRASES])} AS own, {_first_in('blob', V.COORDINATION_SOFTWARE.items())} AS tool FROM ({_BLOBS})) b ON b.lead_id = p.id"""


@query(f"SELECT id, gap, CASE WHEN gap = 'software' THEN tool END AS software, CASE gap WHEN 'hiring' THEN hire WHEN 'in_house' THEN own WHEN 'software' THEN tool END AS evidence FROM ({_GAP})")
def coordination_gap(t: Tables) -> DataFrame:
    return pages.coordination_gap(t.places, t.crawl).select("id", "gap", "software", "evidence")


_JUNK = " OR ".join(O.on_domain("string_split(e, '@')[-1]", d) for d in V.AUDIT_JUNK_DOMAINS)
_ASSET = " OR ".join(f"ends_with(e, {O.lit(s)})" for s in V.ASSET_SUFFIXES)


@query(f"""WITH m AS (SELECT lead_id, 0 AS kind, page_ord, unnest(list_reduce(list_prepend(cast([] AS varchar[]), list_transform({_all('html', H.MAILTO, 1)}, lambda x: regexp_extract_all(x, {re_lit(H.EMAIL)}))), lambda a, b: list_concat(a, b))) AS e FROM crawl_v
 UNION ALL SELECT lead_id, 1, page_ord, unnest({_all('html', H.EMAIL)}) FROM crawl_v),
 g AS (SELECT lead_id, e, min(kind * 1000000 + page_ord) AS o FROM (SELECT lead_id, kind, page_ord, lower(e) AS e FROM m) WHERE NOT ({_ASSET}) AND NOT ({_JUNK}) AND length(e) <= 60 GROUP BY lead_id, e)
 SELECT lead_id, array_to_string(list_slice(list(e ORDER BY o, e), 1, 5), '|') AS emails FROM g GROUP BY lead_id""")
def contact_emails(t: Tables) -> DataFrame:
    return pages.contact_emails(t.crawl)


_PHONES = f"list_filter(list_transform({_all('html', H.PHONE)}, lambda x: {O.ten_digits('x')}), lambda d: length(d) = 10 AND substr(d, 1, 1) NOT IN ('0', '1'))"


_DOC_PHONES = f"list_distinct(list_transform({_PHONES.replace('html', 'text')}, lambda d: {O.format_ten('d')}))"


@query(f"SELECT doc_id, array_to_string(list_sort({_DOC_PHONES}), '|') AS phones FROM documents WHERE len({_DOC_PHONES}) > 0")
def document_phones(t: Tables) -> DataFrame:
    found = t.read("documents").select("doc_id", H.raw_phones("text").alias("p"))
    return found.filter(F.size("p") > 0).select("doc_id", F.array_join(F.array_sort("p"), "|").alias("phones"))


@query(f"SELECT doc_id, unnest({_DOC_PHONES}) AS phone FROM documents")
def document_phone_rows(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", F.explode(H.raw_phones("text")).alias("phone"))


@query(f"""WITH f AS (SELECT lead_id, page_ord, unnest(list_transform({_PHONES}, lambda d: {O.format_ten('d')})) AS v FROM crawl_v),
 g AS (SELECT lead_id, v, min(page_ord) AS o FROM f GROUP BY lead_id, v) SELECT lead_id, count(*) AS phones FROM g GROUP BY lead_id""")
def lead_phone_counts(t: Tables) -> DataFrame:
    each = t.crawl.select("lead_id", F.explode(H.raw_phones("html")).alias("v")).distinct()
    return each.groupBy("lead_id").agg(F.count("*").alias("phones"))


_LEAD_PHONES = f"""SELECT lead_id, array_to_string(list_slice(list(v ORDER BY o), 1, 5), '|') AS phones_found FROM (
 SELECT lead_id, v, min(page_ord * 1000000 + pos) AS o FROM (SELECT lead_id, page_ord, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM (
  SELECT lead_id, page_ord, list_transform({_PHONES}, lambda d: {O.format_ten('d')}) AS l FROM CRAWL)) GROUP BY lead_id, v) GROUP BY lead_id"""


@query(_LEAD_PHONES.replace("CRAWL", "crawl_v"))
def contact_phones(t: Tables) -> DataFrame:
    return pages.contact_phones(t.crawl)


@query(f"""WITH m AS (SELECT lead_id, page_ord, unnest({_all('html', H.EMAIL)}) AS e FROM crawl_v),
 g AS (SELECT DISTINCT lead_id, page_ord, lower(e) AS e FROM m)
 SELECT lead_id, e AS email FROM (SELECT lead_id, e, row_number() OVER (PARTITION BY lead_id ORDER BY page_ord, CASE WHEN string_split(e, '@')[1] IN {O.in_list(V.GENERIC_LOCAL_PARTS)} THEN 0 ELSE 1 END, length(e), e) AS r FROM g
  WHERE regexp_matches(e, '^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}$') AND NOT ({' OR '.join(f"starts_with(e, {O.lit(p)})" for p in V.JUNK_PREFIXES)}) AND string_split(e, '@')[-1] NOT IN {O.in_list(V.JUNK_DOMAINS)}) WHERE r = 1""")
def best_email(t: Tables) -> DataFrame:
    return pages.best_email(t.crawl)


_YEARS = f"list_max(list_filter(list_transform({_all('html', H.YEAR, 1)}, lambda y: cast(y AS int)), lambda y: y >= 2000 AND y <= {YEAR}))"


@query(f"SELECT lead_id, max({_YEARS}) AS copyright_year, cast(coalesce(max({_YEARS}) <= {YEAR - 3}, false) AS int) AS stale FROM crawl_v GROUP BY lead_id")
def copyright_stale(t: Tables) -> DataFrame:
    return pages.copyright_stale(t.crawl, YEAR)


_V1 = "CASE " + " ".join(f"WHEN {O.has_any('lower(substr(html, 1, 50000))', n)} THEN {O.lit(b)}" for b, n in V.BUILDERS_LOWER) + " ELSE '' END"
_GEN = f"nullif(substr(regexp_extract(html, {re_lit(H.GENERATOR)}, 1), 1, 80), '')"
_DEEP = "CASE " + " ".join(f"WHEN contains(lower(coalesce({_GEN}, '')), {O.lit(b.lower())}) OR {O.has_any('substr(html, 1, 300000)', n)} THEN {O.lit(b)}" for b, n in V.BUILDERS_DEEP) + " END"
_T1 = "substr(trim(regexp_extract(html, '(?i)<title>([^<]+)</title>', 1)), 1, 100)"
_T2 = "substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')), 1, 200)"
_M1 = "cast(contains(lower(substr(html, 1, 50000)), 'name=\"viewport\"') AS int)"


@query(f"""SELECT lead_id, page_ord, {_T1} AS title_v1, {_T2} AS title, {_M1} AS mobile_v1, cast(regexp_matches(html, {O.VIEWPORT}) AS int) AS mobile, {_V1} AS builder_v1,
 {O.cased_builder('html', V.BUILDERS_CASED, 200000)} AS builder_v2, {_DEEP} AS builder_live, {_GEN} AS generator, cast({O.has_any('lower(html)', V.ANALYTICS)} AS int) AS has_analytics, {_YEARS} AS copyright_year FROM crawl_v""")
def page_signals(t: Tables) -> DataFrame:
    return pages.page_signals(t.crawl, YEAR)


@query(f"""SELECT lead_id, page_ord, cast(status > 0 AND status < 400 AS int) AS reachable, cast(starts_with(lower(final_url), 'https://') AS int) AS https, load_ms, round_even(strlen(html) / 1024.0::double, 1) AS size_kb,
 {_T1} AS title, {_M1} AS mobile, {_V1} AS builder, concat_ws('; ', CASE WHEN load_ms > 4000 THEN 'Slow load (' || load_ms || 'ms)' END, CASE WHEN {_M1} = 0 THEN 'No mobile viewport' END,
 CASE WHEN NOT starts_with(lower(final_url), 'https://') THEN 'No HTTPS' END, CASE WHEN {_V1} IN {O.in_list(V.DIY_BASIC)} THEN 'DIY-builder (' || {_V1} || ')' END) AS notes FROM crawl_v""")
def basic_audit(t: Tables) -> DataFrame:
    return pages.audit_basic(t.crawl)


@query("SELECT lead_id, http_status, https, mobile, load_ms, builder_live, title, audit_grade FROM audit_v")
def ci_audit(t: Tables) -> DataFrame:
    return t.audit


_FRONT = f"""SELECT lead_id, status, cast(starts_with(lower(final_url), 'https://') AS int) AS https, cast(regexp_matches(html, {O.VIEWPORT}) AS int) AS mobile, load_ms, {_DEEP} AS builder_live,
 cast({O.has_any('lower(html)', V.ANALYTICS)} AS int) AS has_analytics, cast(coalesce({_YEARS} <= {YEAR - 3}, false) AS int) AS stale FROM crawl_v c WHERE page_ord = (SELECT min(page_ord) FROM crawl_v d WHERE d.lead_id = c.lead_id)"""
_QUALITY = f"""SELECT *, CASE WHEN status = 0 OR status >= 400 THEN 0 ELSE {O.clamp(f"100 - CASE WHEN https = 1 THEN 0 ELSE 25 END - CASE WHEN mobile = 1 THEN 0 ELSE 20 END - CASE WHEN load_ms > 8000 THEN 25 WHEN load_ms > 4000 THEN 12 ELSE 0 END - CASE WHEN builder_live IN {O.in_list(V.DIY_DEEP)} THEN 15 ELSE 0 END - CASE WHEN stale = 1 THEN 15 ELSE 0 END - CASE WHEN has_analytics = 1 THEN 0 ELSE 5 END")} END AS site_quality FROM ({_FRONT})"""


@query(f"SELECT lead_id, builder_live, stale, has_analytics, site_quality, CASE WHEN status = 0 OR status >= 400 THEN 'broken' WHEN site_quality >= 75 THEN 'good' WHEN site_quality >= 45 THEN 'weak' ELSE 'neglected' END AS audit_grade FROM ({_QUALITY})")
def site_quality(t: Tables) -> DataFrame:
    return pages.audit_fronts(t.crawl, YEAR).select("lead_id", "builder_live", "stale", "has_analytics", "site_quality", "audit_grade")


def _people(crawl: str, titles, noise) -> str:
    """The most senior person of each lead over the pages of a table."""
    text = "regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')"
    forms = []
    any_title = "|".join(sorted(titles, key=len, reverse=True))
    for form, (pattern, n, t) in enumerate(((rf"(?i)({pages._NAME}){pages._BETWEEN}({any_title})\b", 1, 2), (rf"(?i)\b({any_title}){pages._BETWEEN}({pages._NAME})", 2, 1))):
        found = f"regexp_extract_all({text}, {O.lit(pattern)}, "
        forms.append(f"SELECT lead_id, page_ord, {form} AS form, unnest({found}{n})) AS raw, unnest({found}{t})) AS title, generate_subscripts({found}{n}), 1) AS pos FROM {crawl}")
    noisy = f"lower(w) IN {O.in_list(noise)}"
    first = f"coalesce(list_position(list_transform(ws, lambda w: {noisy}), false), len(ws) + 1)"
    rank = "CASE lower(title) " + " ".join(f"WHEN {O.lit(x)} THEN {k}" for k, x in enumerate(titles)) + f" ELSE {len(titles)} END"
    return f"""SELECT lead_id, first(who ORDER BY rank, page_ord, form, pos) AS decision_maker, first(title ORDER BY rank, page_ord, form, pos) AS dm_title FROM (
 SELECT *, {rank} AS rank, array_to_string(kept, ' ') AS who FROM (
  SELECT lead_id, page_ord, form, pos, trim(regexp_replace(title, '^[ .,\\-—–]+|[ .,\\-—–]+$', '', 'g')) AS title, CASE WHEN len(own) > 3 THEN own[-3:] ELSE own END AS kept FROM (
   SELECT *, ws[{first}:] AS own FROM (SELECT *, list_filter(string_split_regex(raw, '\\s+'), lambda w: w <> '') AS ws FROM ({' UNION ALL '.join(forms)}))))
 WHERE len(kept) BETWEEN 2 AND 3 AND NOT coalesce(list_bool_or(list_transform(kept, lambda w: {noisy})), false)
  AND list_bool_and(list_transform(kept, lambda w: regexp_matches(w, '^\\p{{Lu}}')))) GROUP BY lead_id"""


_MADE = """SELECT lead_id, page_ord, html || '<p>Jane Doe, Broker/Owner</p> <p>Owner: Team Al ' || upper(substr(regexp_replace(lead_id, '[0-9]', 'x', 'g'), 1, 1)) || substr(regexp_replace(lead_id, '[0-9]', 'x', 'g'), 2) || ' Smith</p>' AS html FROM crawl_v"""
_PICKED = """SELECT c.* FROM crawl_v c JOIN (SELECT lead_id, page_ord FROM (
 SELECT lead_id, page_ord, home, row_number() OVER (PARTITION BY lead_id, home ORDER BY page_ord) AS k FROM (
  SELECT lead_id, page_ord, status, length(html) AS size, page_ord = min(page_ord) OVER (PARTITION BY lead_id) AS home FROM crawl_v)
 WHERE status BETWEEN 1 AND 399 AND (home OR size > 400)) WHERE home OR k <= 4) k USING (lead_id, page_ord)"""


def _emails(crawl: str) -> str:
    return f"""SELECT lead_id, array_to_string(list_slice(list(e ORDER BY o), 1, 5), '|') AS emails FROM (
 SELECT lead_id, e, min(o) AS o FROM (
  SELECT lead_id, 0 + page_ord * 1000000 + pos AS o, lower(e) AS e FROM (SELECT lead_id, page_ord, unnest(l) AS e, generate_subscripts(l, 1) AS pos FROM (
   SELECT lead_id, page_ord, list_reduce(list_prepend(cast([] AS varchar[]), list_transform({_all('html', H.MAILTO, 1)}, lambda x: regexp_extract_all(x, {re_lit(H.EMAIL)}))), lambda a, b: list_concat(a, b)) AS l FROM {crawl}))
  UNION ALL SELECT lead_id, 1000000000000000 + page_ord * 1000000 + pos, lower(e) FROM (SELECT lead_id, page_ord, unnest(l) AS e, generate_subscripts(l, 1) AS pos FROM (SELECT lead_id, page_ord, {_all('html', H.EMAIL)} AS l FROM {crawl})))
 WHERE NOT ({_ASSET}) AND NOT ({_JUNK}) AND length(e) <= 60 GROUP BY lead_id, e) GROUP BY lead_id"""


@query(f"""WITH picked AS ({_PICKED}), mails AS ({_emails('picked')}), phones AS ({_LEAD_PHONES.replace('CRAWL', 'picked')}), people AS ({_people('picked', V.GENERAL_TITLES, V.GENERAL_NON_NAME_WORDS)}),
 f AS (SELECT lead_id, url AS input_url, final_url, status, cast(starts_with(lower(final_url), 'https://') AS int) AS https, cast(regexp_matches(html, {O.VIEWPORT}) AS int) AS mobile, load_ms, round_even(strlen(html) / 1024.0::double, 1) AS size_kb,
  {_DEEP} AS builder_live, {_GEN} AS generator, {_T2} AS title, cast({O.has_any('lower(html)', V.ANALYTICS)} AS int) AS has_analytics, {_YEARS} AS copyright_year FROM crawl_v c WHERE page_ord = (SELECT min(page_ord) FROM crawl_v d WHERE d.lead_id = c.lead_id)),
 q AS (SELECT lead_id, stale, site_quality, CASE WHEN status = 0 OR status >= 400 THEN 'broken' WHEN site_quality >= 75 THEN 'good' WHEN site_quality >= 45 THEN 'weak' ELSE 'neglected' END AS audit_grade FROM ({_QUALITY}))
 SELECT lead_id, input_url, final_url, status AS http_status, https, mobile, load_ms, size_kb, builder_live, generator, title, has_analytics, copyright_year, stale, site_quality, audit_grade,
  cast(coalesce((SELECT count(*) FROM picked WHERE picked.lead_id = f.lead_id), 0) AS int) AS pages_crawled, coalesce(emails, '') AS emails, coalesce(phones_found, '') AS phones_found, coalesce(decision_maker, '') AS decision_maker, coalesce(dm_title, '') AS dm_title
 FROM f JOIN q USING (lead_id) LEFT JOIN mails USING (lead_id) LEFT JOIN phones USING (lead_id) LEFT JOIN people USING (lead_id)""")
def full_site_audit(t: Tables) -> DataFrame:
    return pages.audit_sites(t.crawl, YEAR)


@query(f"WITH made AS ({_MADE}) {_people('made', V.BROKERAGE_TITLES, V.NON_NAME_WORDS)}")
def decision_makers(t: Tables) -> DataFrame:
    who = F.concat(F.lit("<p>Jane Doe, Broker/Owner</p> <p>Owner: Team Al "), F.initcap(F.regexp_replace("lead_id", "[0-9]", "x")), F.lit(" Smith</p>"))
    return pages.decision_maker(t.crawl.withColumn("html", F.concat("html", who)))


def _clients() -> str:
    text = "html"
    for entity, char in (("&mdash;", "—"), ("&ndash;", "–"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, {O.lit(entity)}, {O.lit(char)})"
    lists = ", ".join(f"regexp_extract_all(t, {O.lit(p)}, 1)" for p in pages._CLIENT)
    return f"""SELECT DISTINCT label, name, {O.name_key('name')} AS name_key FROM (
 SELECT label, regexp_replace(unnest(flatten([{lists}])), '^[ .,\\-]+|[ .,\\-]+$', '', 'g') AS name FROM (
  SELECT label, {text} AS t FROM (SELECT source AS label, '<img alt="' || name || '"> "Great" - Jo Poe, ' || name || ' <cite>client logo</cite>' AS html FROM places_v)))
 WHERE length(name) >= 3 AND NOT {O.has_any('lower(name)', V.CLIENT_JUNK)}"""


@query(_clients())
def competitor_clients(t: Tables) -> DataFrame:
    noted = t.places.select(F.col("source").alias("label"), F.concat(F.lit('<img alt="'), "name", F.lit('"> "Great" - Jo Poe, '), "name", F.lit(" <cite>client logo</cite>")).alias("html"))
    return pages.client_names(noted)


_H = O.host("url")
_SERP = f"""SELECT s.lead_id, s.rank, s.url, {_H} AS h FROM serp_v s WHERE s.rank <= 10"""
_OWN = f"SELECT * FROM ({_SERP}) WHERE h <> '' AND NOT ({' OR '.join(O.on_domain('h', d) for d in V.DIRECTORY_DOMAINS)})"
_TOKENS = "list_filter(string_split_regex(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda x: length(x) > 2)"
_PICK = f"""SELECT l.id AS lead_id, b.url AS site, CASE WHEN s.lead_id IS NULL THEN 'throttled' WHEN b.url IS NOT NULL THEN 'has_site' ELSE 'no_site_found' END AS verdict
 FROM (SELECT * FROM leads_v WHERE coalesce(trim(website), '') = '') l LEFT JOIN (SELECT DISTINCT lead_id FROM serp_v) s ON s.lead_id = l.id
 LEFT JOIN (SELECT lead_id, url FROM (SELECT o.lead_id, o.url, row_number() OVER (PARTITION BY o.lead_id ORDER BY CASE WHEN list_bool_or(list_transform({_TOKENS}, lambda k: contains(string_split(replace(o.h, 'www.', ''), '.')[1], k) OR contains(k, string_split(replace(o.h, 'www.', ''), '.')[1]))) THEN 0 ELSE 1 END, o.rank) AS r
  FROM ({_OWN}) o JOIN leads_v v ON v.id = o.lead_id) WHERE r = 1) b ON b.lead_id = l.id"""


def _unsited(t: Tables) -> DataFrame:
    return t.leads.filter(F.coalesce(F.length(F.trim("website")), F.lit(0)) == 0)


@query(_PICK)
def search_result_pick(t: Tables) -> DataFrame:
    return pages.pick_site(_unsited(t), t.serp)


@query(f"SELECT count(*) FILTER (WHERE verdict = 'has_site') AS false_positives, count(*) FILTER (WHERE verdict = 'throttled') AS throttled, count(*) AS checked FROM ({_PICK})")
def verify_outcome(t: Tables) -> DataFrame:
    return A.verify_outcome(A.verify_notes(pages.pick_site(_unsited(t), t.serp)))


@query(f"SELECT lead_id, site AS discovered_site, verdict AS discovery_verdict, CASE WHEN site IS NOT NULL THEN coalesce(q.grade, 'broken') WHEN verdict = 'no_site_found' THEN 'no_site' ELSE 'unknown' END AS audit_grade FROM ({_PICK}) LEFT JOIN (SELECT lead_id AS l, CASE WHEN status = 0 OR status >= 400 THEN 'broken' WHEN site_quality >= 75 THEN 'good' WHEN site_quality >= 45 THEN 'weak' ELSE 'neglected' END AS grade FROM ({_QUALITY})) q ON q.l = lead_id")
def site_discovery(t: Tables) -> DataFrame:
    return pages.discover_sites(t.leads, t.serp, t.crawl, YEAR).select("lead_id", "discovered_site", "discovery_verdict", "audit_grade")


@query("SELECT lead_id, max(len(regexp_extract_all(html, '(?i)href=\"[^\"]*/(?:agents|property)/'))) AS active_listings FROM crawl_v GROUP BY lead_id")
def listing_count(t: Tables) -> DataFrame:
    return pages.listing_count(t.crawl, r'(?i)href="[^"]*/(?:agents|property)/').select("lead_id", F.col("active_listings").cast("long").alias("active_listings"))


@query("SELECT 'c' || page_id AS lead_id, CASE page_id % 3 WHEN 0 THEN 'https://a' || page_id || '.com/x' WHEN 1 THEN 'https://b' || page_id || '.com' END AS site FROM pages")
def outbound_site(t: Tables) -> DataFrame:
    k = F.col("page_id").cast("string")
    redirect = F.concat(F.lit('<a href="/biz_redir?x=1&url=https%3A%2F%2Fa'), k, F.lit('.com%2Fx%3Fq">go</a>'))
    data = F.concat(F.lit('<script type="application/ld+json">{"sameAs": ["https://b'), k, F.lit('.com/"]}</script>'))
    html = F.when(F.col("page_id") % 3 == 0, redirect).when(F.col("page_id") % 3 == 1, data).otherwise('<a href="https://www.yelp.com/z">website</a>')
    return pages.outbound_site(t.read("pages").select(F.concat(F.lit("c"), k).alias("lead_id"), html.alias("html")))


@query("SELECT p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'https://www.yelp.com/biz/' || p_partkey ELSE 'https://x.com/' || p_partkey END AS url, '707' AS phone, p_brand || ', Town' AS address FROM part")
def directory_listings(t: Tables) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    rows = t.read("part").select(
        F.to_json(
            F.struct(
                F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("/biz/"), k)).otherwise(F.concat(F.lit("https://x.com/"), k)).alias("url"), F.lit("707").alias("telephone"),
                F.struct(F.col("p_brand").alias("streetAddress"), F.lit("Town").alias("addressLocality")).alias("address"),
            )
        ).alias("json")
    )
    return readers.normalize_listings(rows)


@query("SELECT p_partkey AS id, cast(trunc((p_partkey % 100) / 100.0::double * 100) AS int) AS site_score, CASE WHEN p_partkey % 4000 = 0 THEN '' ELSE cast(round_even((p_partkey % 4000) / 1000.0::double, 1) AS varchar) || 's' END AS lcp, CASE WHEN p_partkey % 2 = 0 THEN 'B | A' ELSE 'A' END AS opportunities FROM part")
def pagespeed(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    metric = F.struct((k % 4000).cast("double").alias("largestContentfulPaint"))
    opp = lambda title, ms: F.struct(F.lit(0.5).alias("score"), F.lit(title).alias("title"), F.struct(F.lit("opportunity").alias("type"), F.lit(ms).alias("overallSavingsMs"), F.lit(None).cast("array<struct<largestContentfulPaint:double>>").alias("items")).alias("details"))
    metrics = F.struct(F.lit(None).cast("double").alias("score"), F.lit("m").alias("title"), F.struct(F.lit("debug").alias("type"), F.lit(0.0).alias("overallSavingsMs"), F.array(metric).alias("items")).alias("details"))
    audits = F.when(k % 2 == 0, F.create_map(F.lit("metrics"), metrics, F.lit("a"), opp("A", 10.0), F.lit("b"), opp("B", 20.0))).otherwise(F.create_map(F.lit("metrics"), metrics, F.lit("a"), opp("A", 10.0)))
    body = F.struct(F.struct(F.struct(F.struct(((k % 100) / 100.0).alias("score")).alias("performance")).alias("categories"), audits.alias("audits")).alias("lighthouseResult"))
    return readers.flatten_pagespeed(t.read("part").select(k.alias("id"), F.to_json(body).alias("json"))).select("id", "site_score", "lcp", "opportunities")


_KEYED = f"""SELECT {O.name_key('name')} AS name_key, arg_min(id, seq) AS id, min(seq) AS seq, coalesce(first(website ORDER BY seq) FILTER (WHERE website <> ''), first(website ORDER BY seq)) AS website,
 coalesce(first(phone ORDER BY seq) FILTER (WHERE phone <> ''), first(phone ORDER BY seq)) AS phone, first(coalesce(brand, '') ORDER BY seq) AS brand FROM places_v GROUP BY 1"""
_WEAK = O.weak_domain("website")
_NEED_SQL = f"""SELECT id, website, phone, CASE WHEN coalesce(website, '') = '' THEN 60 WHEN {_WEAK} IS NOT NULL THEN 40 WHEN coalesce(reachable, 0) = 0 THEN 50
  ELSE CASE WHEN https = 1 THEN 0 ELSE 18 END + CASE WHEN mobile = 1 THEN 0 ELSE 14 END + CASE WHEN load_ms > 4000 THEN 10 ELSE 0 END + CASE WHEN builder IN {O.in_list(V.DIY_BASIC)} THEN 12 ELSE 0 END END AS base,
 CASE WHEN coalesce(website, '') = '' OR {_WEAK} IS NOT NULL OR coalesce(reachable, 0) = 0 THEN 'A' WHEN https = 0 OR mobile = 0 OR load_ms > 4000 OR builder IN {O.in_list(V.DIY_BASIC)} THEN 'B' ELSE 'C' END AS tier
 FROM ({_KEYED}) k LEFT JOIN (SELECT lead_id, cast(status > 0 AND status < 400 AS int) AS reachable, cast(starts_with(lower(final_url), 'https://') AS int) AS https, {_M1} AS mobile, load_ms, {_V1} AS builder
  FROM crawl_v c WHERE page_ord = (SELECT min(page_ord) FROM crawl_v d WHERE d.lead_id = c.lead_id)) a ON a.lead_id = k.id WHERE name_key <> '' AND brand = ''"""


@query(f"SELECT id, cast(base + CASE WHEN phone <> '' THEN 4 ELSE 0 END AS int) AS score, tier FROM ({_NEED_SQL})")
def run_web_design(t: Tables) -> DataFrame:
    return profiles.run(profiles.get("web_design"), t.places, t.crawl).select("id", "score", "tier")


_GAPS = {"hiring": "is hiring a coordinator", "open": "no coordinator found", "in_house": "signs of a coordinator in house", "confirmed": "a competitor's client"}


def _coordination(w: dict, known: str | None = None, clients: str | None = None, cap: int | None = None) -> str:
    """The coordination run: dedupe, known names out, pages of the first leads, score."""
    crawl = "crawl_v" if cap is None else "pages_of"
    blobs = f"SELECT lead_id, lower(string_agg(html, chr(10) ORDER BY page_ord)) AS blob FROM {crawl} GROUP BY lead_id"
    tool = _first_in("blob", V.COORDINATION_SOFTWARE.items())
    most = "greatest(coalesce(s.n, 0), coalesce(l.n, 0))"
    roster = f"""SELECT b.lead_id, least(CASE WHEN {most} < 2 THEN greatest({most}, cards) ELSE {most} END, 1000) AS n
 FROM (SELECT lead_id, max({_CARDS}) AS cards FROM {crawl} GROUP BY lead_id) b
 LEFT JOIN (SELECT lead_id, count(DISTINCT lower(v)) AS n FROM (SELECT lead_id, unnest({_all('html', H.PROFILE_LINK, 1)}) AS v FROM {crawl}) GROUP BY lead_id) s USING (lead_id)
 LEFT JOIN (SELECT lead_id, count(DISTINCT v) AS n FROM (SELECT lead_id, unnest({_all('html', H.LICENCE, 1)}) AS v FROM {crawl}) GROUP BY lead_id) l USING (lead_id)"""
    volume = f"CASE WHEN agent_count > 0 THEN least(cast(trunc(agent_count * {float(w['per_agent'])}::double) AS int), {w['volume_cap']}) ELSE 0 END"
    need = f"CASE gap WHEN 'hiring' THEN {w['hiring']} WHEN 'open' THEN {w['open']} WHEN 'software' THEN {w['software']} WHEN 'in_house' THEN {w['in_house']} ELSE 0 END"
    score = f"{volume} + {need} + CASE WHEN phone <> '' THEN {w['phone']} ELSE 0 END + CASE WHEN decision_maker <> '' THEN {w['contact']} ELSE 0 END + CASE WHEN label IS NOT NULL THEN {w['suppressed']} ELSE 0 END"
    tool_name = "coalesce(nullif(trim(software), ''), 'coordination software')"
    told = " ".join(f"WHEN '{k}' THEN {O.lit(v)}" for k, v in _GAPS.items())
    first = f"SELECT * FROM ({_KEYED}) WHERE name_key <> ''" + (f" AND name_key NOT IN ({known})" if known else "")
    of_pages = "" if cap is None else f" pages_of AS (SELECT * FROM crawl_v WHERE lead_id IN (SELECT id FROM (SELECT id FROM k ORDER BY seq LIMIT {cap}))),"
    return f"""WITH k AS ({first}),{of_pages}
 g AS (SELECT k.*, CASE WHEN coalesce(k.website, '') = '' OR blob IS NULL THEN 'unknown' WHEN {O.has_any('blob', V.HIRING_PHRASES)} THEN 'hiring' WHEN {O.has_any('blob', V.IN_HOUSE_PHRASES)} THEN 'in_house' WHEN {tool} IS NOT NULL THEN 'software' ELSE 'open' END AS gap, {tool} AS tool
  FROM k LEFT JOIN ({blobs}) b ON b.lead_id = k.id),
 f AS (SELECT g.id, g.phone, g.gap, CASE WHEN gap = 'software' THEN tool END AS software, cast(CASE WHEN gap = 'unknown' THEN 0 ELSE coalesce(r.n, 0) END AS int) AS agent_count, CASE WHEN gap <> 'unknown' THEN p.decision_maker END AS decision_maker, c.label
  FROM g LEFT JOIN ({roster}) r ON r.lead_id = g.id LEFT JOIN ({_people(crawl, V.BROKERAGE_TITLES, V.NON_NAME_WORDS)}) p ON p.lead_id = g.id
  LEFT JOIN ({clients or "SELECT cast(NULL AS varchar) AS name_key, cast(NULL AS varchar) AS label"}) c ON c.name_key = g.name_key)
 SELECT id, gap, agent_count, score, CASE WHEN score >= {w['tier_a']} THEN 'A' WHEN score >= {w['tier_b']} THEN 'B' ELSE 'C' END AS tier, why, opener FROM (SELECT *, cast({score} AS int) AS score,
  concat_ws('; ', CASE WHEN agent_count > 0 THEN agent_count || ' agents, size points ' || ({volume}) ELSE 'size not known' END, CASE gap {told} WHEN 'software' THEN 'uses ' || {tool_name} ELSE 'coordination unknown' END,
   CASE WHEN phone <> '' THEN 'phone' END, CASE WHEN decision_maker <> '' THEN 'ask for ' || decision_maker END, CASE WHEN label IS NOT NULL THEN 'client of ' || label END) AS why,
  CASE WHEN label IS NOT NULL THEN 'Served by ' || label || ': call again when that ends.' ELSE CASE WHEN agent_count > 0 THEN agent_count || ' agents. ' ELSE '' END || CASE gap WHEN 'hiring' THEN 'They want to hire a coordinator: offer the work by the file instead.'
   WHEN 'open' THEN 'Nobody seems to coordinate: ask who does the paperwork up to closing.' WHEN 'software' THEN 'They run ' || {tool_name} || ': ask who works it for each file.' WHEN 'in_house' THEN 'They coordinate in house: offer cover for busy weeks.' ELSE 'Ask how they coordinate.' END END AS opener FROM f)"""


_RUN = ("id", "gap", "agent_count", "score", "tier", "why", "opener")


@query(_coordination(V.COORDINATOR_WEIGHTS))
def run_coordination(t: Tables) -> DataFrame:
    return profiles.run(profiles.get("coordination"), t.places, t.crawl).select(*_RUN)


_OWN_WEIGHTS = {**V.COORDINATOR_WEIGHTS, "hiring": 33, "tier_b": 20}


@query(
    _coordination(
        _OWN_WEIGHTS, f"SELECT {O.name_key('name')} FROM places_v WHERE seq % 9 = 0",
        f"SELECT name_key, arg_min(label, seq) AS label FROM (SELECT {O.name_key('name')} AS name_key, source AS label, seq FROM places_v WHERE seq % 4 < 2) WHERE name_key <> '' GROUP BY name_key", 60,
    )
)
def run_with_options(t: Tables) -> DataFrame:
    """Known names left out, clients of competitors told, only the first leads' pages read,
    own weights over the profile's."""
    keyed = t.places.withColumn("name_key", name_key("name"))
    clients = dedupe.first_label(keyed.filter("seq % 4 < 2").select("name_key", F.col("source").alias("label"), F.col("seq").alias("seed_ord")))
    out = profiles.run(profiles.get("coordination"), t.places, t.crawl, keyed.filter("seq % 9 = 0"), clients, 60, {"weights": _OWN_WEIGHTS})
    return out.select(*_RUN)


@query(CHOSEN)
def crawl_snapshot(t: Tables) -> DataFrame:
    """Pages stored as a snapshot and read back as the crawl source."""
    path = fresh_path(t.spark, "crawl")
    t.crawl.write.parquet(path)
    return pages.select_pages(readers.read_crawl(t.spark, path))


@query(f"SELECT page_id, {O.host('url')} AS host FROM pages")
def page_hosts(t: Tables) -> DataFrame:
    return t.read("pages").select("page_id", host("url").alias("host"))


@query("SELECT id, cast(CASE WHEN coalesce(website, '') = '' THEN 'No site yet: offer one page for ' || concat_ws(' in ', nullif(trim(category), ''), nullif(trim(city), '')) WHEN contains(lower(website), 'facebook') OR contains(lower(website), 'instagram') THEN 'Only a social page: offer a site that searches can find.' WHEN starts_with(lower(website), 'http://') THEN 'Plain HTTP, marked as not secure by browsers: offer a rebuild with a certificate.' ELSE 'Has a site: look at its quality first.' END AS varchar) AS opener FROM places_v")
def opener_lines(t: Tables) -> DataFrame:
    return t.places.select("id", S.site_need_opener("website", "category", "city").alias("opener"))


_AGENTS = "SELECT id, cast(seq % 60 AS int) AS n, CASE seq % 5 WHEN 1 THEN 'open' WHEN 2 THEN 'software' WHEN 3 THEN 'in_house' ELSE 'unknown' END AS gap, website, category, city, CASE WHEN seq % 3 = 0 THEN 'Dotloop' END AS tool FROM places_v"


@query(f"""SELECT id, CASE WHEN coalesce(website, '') = '' THEN 'No site: offer one page that is found for ''' || trim(concat_ws(' ', lower(coalesce(nullif(trim(category), ''), 'business')), nullif(trim(city), ''))) || ''' and rings on a tap.'
 WHEN contains(lower(website), 'yelp') THEN 'Only a directory listing: offer a domain of their own.' WHEN contains(lower(website), 'facebook') OR contains(lower(website), 'instagram') THEN 'Only social pages: offer a site beside them.'
 WHEN starts_with(lower(website), 'http://') THEN 'No certificate, so browsers warn: offer a rebuild that has one.' ELSE 'Has a site: see what it is worth first.' END AS site_opener,
 CASE WHEN n > 0 THEN n || '-agent ' ELSE '' END || CASE gap WHEN 'open' THEN 'brokerage without coordination tools: ask who does the files now.' WHEN 'software' THEN 'brokerage with ' || coalesce(tool, 'coordination software') || ': ask who works it.'
  WHEN 'in_house' THEN 'brokerage with a coordinator of its own: offer to step in when files pile up.' ELSE 'brokerage: ask how files are coordinated.' END AS coordinator_opener FROM ({_AGENTS})""")
def opener_lines_v0(t: Tables) -> DataFrame:
    k = F.col("seq") % 5
    gap = F.when(k == 1, "open").when(k == 2, "software").when(k == 3, "in_house").otherwise("unknown")
    rows = t.places.withColumns({"n": (F.col("seq") % 60).cast("int"), "gap": gap, "tool": F.when(F.col("seq") % 3 == 0, "Dotloop")})
    return rows.select("id", S.site_need_opener_v0("website", "category", "city").alias("site_opener"), S.coordinator_opener_v0("n", "gap", "tool").alias("coordinator_opener"))
