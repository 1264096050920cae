"""DuckDB SQL of the base tables that the query twins share, written from the rules."""

from __future__ import annotations

from ..functions import values as V
from .views import VIEWS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def has_any(text: str, needles) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(n)})" for n in needles) + ")"


def full(c: str) -> str:
    """Not blank."""
    return f"(length(trim(coalesce({c}, ''))) > 0)"


def some(c: str) -> str:
    """Not empty."""
    return f"(coalesce({c}, '') <> '')"


def host(u: str) -> str:
    scheme = f"(CASE WHEN contains(trim({u}), '://') THEN trim({u}) ELSE 'http://' || trim({u}) END)"
    authority = f"regexp_extract({scheme}, '^[^:/?#]+://([^/?#]*)', 1)"
    return f"coalesce(lower(regexp_replace(regexp_replace({authority}, '^[^@]*@', ''), ':[0-9]*$', '')), '')"


def site_host(u: str) -> str:
    scheme = f"(CASE WHEN regexp_matches(trim({u}), '(?i)^https?://') THEN trim({u}) ELSE 'http://' || trim({u}) END)"
    return f"coalesce(regexp_replace(lower(regexp_extract({scheme}, '^[^:/?#]+://([^/?#]*)', 1)), '^www\\.', ''), '')"


def registrable(h: str) -> str:
    return f"(CASE WHEN contains({h}, '.') THEN regexp_extract({h}, '([^.]*\\.[^.]*)$', 1) ELSE {h} END)"


def on_domain(h: str, d: str) -> str:
    return f"({h} = {lit(d)} OR ends_with({h}, {lit('.' + d)}))"


def weak_domain(u: str, domains=V.WEAK_DOMAINS) -> str:
    cases = " ".join(f"WHEN {on_domain(host(u), d)} THEN {lit(d)}" for d in domains)
    return f"(CASE WHEN NOT {full(u)} THEN 'no website' {cases} END)"


def ten_digits(p: str) -> str:
    d = f"regexp_replace({p}, '[^0-9]', '', 'g')"
    return f"(CASE WHEN length({d}) = 11 AND {d} LIKE '1%' THEN substr({d}, 2) ELSE {d} END)"


def format_ten(d: str) -> str:
    return f"('(' || substr({d}, 1, 3) || ') ' || substr({d}, 4, 3) || '-' || substr({d}, 7, 4))"


def name_key(n: str) -> str:
    spaced = f"regexp_replace(lower(coalesce({n}, '')), '[^a-z0-9 ]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({spaced}, '\\b({'|'.join(V.NAME_NOISE)})\\b', ' ', 'g'), ' +', '', 'g')"


def name_key_plain(n: str) -> str:
    return f"regexp_replace(lower(coalesce({n}, '')), '[^a-z0-9]+', '', 'g')"


def half_even(x: str, digits: int = 0) -> str:
    return f"round_even({x}, {digits})"


def clamp(x: str) -> str:
    return f"cast(greatest(0, least(100, {x})) AS int)"


def _listing(h: str) -> str:
    return "(" + " OR ".join(f"{on_domain(h, d)} OR reg = {lit(d)}" for d in V.LISTING_DOMAINS) + ")"


def _builder(h: str) -> str:
    return "CASE " + " ".join(f"WHEN {on_domain(h, d)} OR reg = {lit(d)} THEN {lit(n)}" for d, n in V.BUILDER_DOMAINS.items()) + " END"


def _social(part: str) -> str:
    h = site_host(part)
    checks = ", ".join(f"CASE WHEN {registrable(h)} = {lit(d)} OR ends_with({h}, {lit(d)}) THEN {lit(n)} END" for d, n in V.SOCIAL_DOMAINS.items())
    return f"list_filter([{checks}], lambda z: z IS NOT NULL)"


PITCH = """CASE WHEN tier = 'A' THEN 'Hello ' || who || ': people in ' || place || ' who look for a ' || trade || ' online cannot find a site of yours. May I show you a draft?'
 WHEN tier = 'B' THEN 'Hello ' || who || ': your page runs on ' || coalesce(nullif(trim(builder), ''), 'a site kit') || '. A custom site would load faster and rank better. May I show you one?'
 ELSE 'Hello ' || who || ': shall I check how fast, mobile-friendly and findable your site is, free of charge?' END"""

TABLES: dict[str, str] = dict(VIEWS)
TABLES["flagged_v"] = f"""
SELECT p.*, ({some('brand')} OR n.n >= {V.CHAIN_THRESHOLD}) AS is_chain
FROM places_v p JOIN (SELECT name, count(*) AS n FROM places_v GROUP BY name) n ON p.name = n.name"""
TABLES["clean_v"] = f"""
SELECT id, seq, name, category, brand, website, phone, email, socials, address, city, state, confidence, lat, lon, source, 0 AS is_chain,
 CASE WHEN NOT {some('website')} OR {has_any('lower(website)', V.WEAK_SUBSTRINGS)} THEN 'A' ELSE 'C' END AS tier,
 CASE WHEN NOT {some('website')} THEN 'No website' WHEN {has_any('lower(website)', V.WEAK_SUBSTRINGS)} THEN 'Social/listing only - no owned site'
  ELSE 'Has a website - audit quality before pitching' END AS tier_reason
FROM flagged_v WHERE NOT is_chain AND (category IS NULL OR category NOT IN {in_list(V.NON_BUSINESS)})"""
TABLES["hosts_v"] = f"""
SELECT c.* EXCLUDE (tier, tier_reason), {site_host('website')} AS h, {registrable(site_host('website'))} AS reg FROM clean_v c"""
TABLES["tiers_v"] = f"""
SELECT *, CASE WHEN {full('website')} AND NOT {_listing('h')} THEN {_builder('h')} END AS builder,
 {full('website')} AND {_listing('h')} AS listed FROM hosts_v"""
TABLES["enriched_v"] = f"""
SELECT *, CASE WHEN NOT {full('website')} OR listed THEN 'A' WHEN builder IS NOT NULL THEN 'B' ELSE 'C' END AS tier,
 CASE WHEN NOT {full('website')} THEN 'No website' WHEN listed THEN 'Social/listing only - no owned site'
  WHEN builder IS NOT NULL THEN 'DIY builder site (' || builder || ') - upsell to custom' ELSE 'Has a real website - audit quality before pitching' END AS tier_reason,
 CASE WHEN length({ten_digits('phone')}) = 10 THEN {format_ten(ten_digits('phone'))} ELSE nullif(phone, '') END AS phone_fmt,
 CASE WHEN length({ten_digits('phone')}) >= 3 THEN substr({ten_digits('phone')}, 1, 3) END AS area_code,
 nullif(array_to_string(list_reduce(list_prepend(cast([] AS varchar[]), list_transform(string_split(socials, '|'), lambda y: {_social('y')})), lambda a, b: list_concat(a, list_filter(b, lambda q: NOT list_contains(a, q)))), '|'), '') AS social_platforms,
 cast(CASE WHEN {full('email')} AND {some('website')} AND {registrable("lower(string_split(email, '@')[-1])")} <> '' AND {registrable("lower(string_split(email, '@')[-1])")} = reg THEN 1 ELSE 0 END AS int) AS email_owned,
 cast({half_even(f"100.0 * ({full('name')}::int + {full('phone')}::int + {full('email')}::int + ({full('website')} OR (NOT {some('website')} AND {full('socials')}))::int + {full('address')}::int + {full('category')}::int) / 6")} AS int) AS completeness
FROM tiers_v"""
TABLES["scored_v"] = f"""
SELECT * EXCLUDE (h, reg, listed),
 {clamp(f"CASE tier WHEN 'A' THEN 50 WHEN 'B' THEN 35 ELSE 10 END + CASE WHEN {full('phone')} THEN 25 ELSE 0 END + CASE WHEN {full('email')} THEN 15 ELSE 0 END + cast({half_even('coalesce(confidence, 0) * 10')} AS int)")} AS score,
 CASE WHEN {full('phone')} THEN 'phone' WHEN {full('email')} THEN 'email' WHEN social_platforms IS NOT NULL THEN 'social' ELSE 'none' END AS best_contact,
 coalesce(nullif(trim(name), ''), 'your business') AS who, coalesce(nullif(trim(city), ''), 'your area') AS place,
 coalesce(replace(nullif(trim(category), ''), '_', ' '), 'local business') AS trade,
 CASE WHEN coalesce(category, '') = '' THEN 'medium' WHEN {has_any('lower(category)', V.LOW_FIT)} THEN 'low' WHEN {has_any('lower(category)', V.HIGH_FIT)} THEN 'high' ELSE 'medium' END AS industry_fit
FROM enriched_v"""
TABLES["leads_v"] = f"""
SELECT * EXCLUDE (who, place, trade), {PITCH} AS pitch,
 CASE WHEN {full('phone')} THEN {clamp(f"CASE tier WHEN 'A' THEN 50 WHEN 'B' THEN 42 ELSE 14 END + CASE industry_fit WHEN 'high' THEN 28 WHEN 'low' THEN -25 ELSE 8 END + 12 + CASE WHEN {full('email')} THEN 8 ELSE 0 END + CASE WHEN {full('socials')} THEN 3 ELSE 0 END + cast(trunc(completeness * 0.08) AS int) + cast({half_even('coalesce(confidence, 0) * 4')} AS int)")} ELSE 0 END AS outreach_score,
 concat_ws('; ', CASE tier WHEN 'A' THEN 'No real website' WHEN 'B' THEN 'DIY site (' || coalesce(nullif(trim(builder), ''), 'builder') || ') - upsell' ELSE 'Has a site' END,
  CASE WHEN industry_fit = 'high' THEN 'high-fit niche' END, CASE WHEN {full('email')} THEN 'has phone + email' ELSE 'has phone' END) AS why_warm
FROM scored_v"""
TABLES["crm_v"] = f"""
SELECT lead_id, coalesce(last(status ORDER BY ts, event_id) FILTER (WHERE status IN {in_list(V.STATUSES)}), 'New') AS status,
 last(notes ORDER BY ts, event_id) FILTER (WHERE notes IS NOT NULL) AS notes, cast(NULL AS varchar) AS last_contacted,
 coalesce(last(favorite ORDER BY ts, event_id) FILTER (WHERE favorite IS NOT NULL), 0) AS favorite, max(ts) AS updated_at
FROM crm_patch_v WHERE lead_id IN (SELECT id FROM leads_v) GROUP BY lead_id"""


def cased_builder(html: str, rules, chars: int) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(f'substr({html}, 1, {chars})', needles)} THEN {lit(name)}" for name, needles in rules) + " END"


VIEWPORT = "'(?i)<meta[^>]+name=[\"'']viewport[\"'']'"
TABLES["audit_v"] = f"""
SELECT lead_id, status AS http_status, cast(starts_with(lower(final_url), 'https://') AS int) AS https, cast(regexp_matches(html, {VIEWPORT}) AS int) AS mobile, load_ms,
 {cased_builder('html', V.BUILDERS_CASED, 200000)} AS builder_live,
 substr(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')), 1, 200) AS title,
 CASE WHEN status = 0 OR status >= 400 THEN 'broken' WHEN starts_with(lower(final_url), 'https://') AND regexp_matches(html, {VIEWPORT}) AND (CASE WHEN load_ms = 0 THEN 9999 ELSE load_ms END) < 4000 THEN 'good' ELSE 'weak' END AS audit_grade
FROM crawl_v c WHERE page_ord = (SELECT min(page_ord) FROM crawl_v d WHERE d.lead_id = c.lead_id)"""
TABLES["view_v"] = """
SELECT l.*, coalesce(c.status, 'New') AS status, c.notes, c.last_contacted, coalesce(c.favorite, 0) AS favorite, c.updated_at,
 a.http_status AS audit_status, a.https AS audit_https, a.mobile AS audit_mobile, a.load_ms AS audit_load_ms, a.builder_live AS audit_builder, a.audit_grade
FROM leads_v l LEFT JOIN crm_v c ON c.lead_id = l.id LEFT JOIN audit_v a ON a.lead_id = l.id"""
TABLES["warm_v"] = "SELECT * FROM leads_v WHERE outreach_score > 0 AND industry_fit <> 'low'"


def with_tables(sql: str) -> str:
    """``sql`` behind the tables it names, directly or through others."""
    need: list[str] = []

    def visit(text: str) -> None:
        import re

        for name in TABLES:
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                if name not in need:
                    need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n].strip()})" for n in need)
    head = f"WITH {ctes}"
    rest = sql.strip()
    return f"{head},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"{head}\n{rest}"
