"""Queries over the joined lead view: filters, sorting, reports, state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import aggregates as A
from ..operators import joins, paging, serving, state
from ..operators.shared import fresh_path
from ..sources import sinks
from . import oracle as O
from .registry import Tables, query

AS_OF = "2024-01-31"
_TEXT = "string_split_regex(lower(concat_ws(' ', name, category, city, address)), '[^a-z0-9]+')"


def _search_sql(*tokens: str) -> str:
    return " AND ".join(f"list_bool_or(list_transform({_TEXT}, lambda w: starts_with(w, '{x}')))" for x in tokens)


@query("SELECT id, name, tier, status, favorite, audit_status, audit_https, audit_grade, notes FROM view_v")
def lead_view(t: Tables) -> DataFrame:
    return t.view.select("id", "name", "tier", "status", "favorite", "audit_status", "audit_https", "audit_grade", "notes")


FILTERS = {
    "q": ({"q": "customer salon"}, _search_sql("customer", "salon")),
    "city_category": ({"city": "NATION_10", "category": "beauty_salon"}, "city = 'NATION_10' AND category = 'beauty_salon'"),
    "tier": ({"tier": "A"}, "tier = 'A'"),
    "status": ({"status": "New"}, "status = 'New'"),
    "no_website": ({"hasWebsite": "no"}, "coalesce(website, '') = ''"),
    "website_phone_email": ({"hasWebsite": "yes", "hasPhone": "yes", "hasEmail": "yes"}, "website <> '' AND phone <> '' AND email <> ''"),
    "builder_score": ({"builder": "Wix", "minScore": "60"}, "builder = 'Wix' AND score >= 60"),
    "favorite": ({"favorite": "1"}, "favorite = 1"),
    "audit_bad": ({"audit": "bad"}, "audit_grade IN ('weak', 'broken')"),
    "audit_broken": ({"audit": "broken"}, "audit_grade = 'broken'"),
    "audit_weak": ({"audit": "weak"}, "audit_grade = 'weak'"),
    "audit_good": ({"audit": "good"}, "audit_grade = 'good'"),
    "audited": ({"audit": "yes"}, "audit_grade IS NOT NULL"),
    "not_audited": ({"audit": "no"}, "audit_grade IS NULL"),
    "call_list": ({"callList": "1"}, "phone <> '' AND (tier IN ('A', 'B') OR coalesce(audit_grade IN ('weak', 'broken'), false))"),
}


def _filter(params: dict):
    return lambda t: serving.filter_leads(t.view, params).select("id", "name", "score", "status")


for _name, (_params, _where) in FILTERS.items():
    query(f"SELECT id, name, score, status FROM view_v WHERE {_where}", name=f"filter_{_name}")(_filter(_params))


@query(f"SELECT id, name FROM leads_v WHERE {_search_sql('beauty', 'main')}")
def text_search(t: Tables) -> DataFrame:
    return joins.search(t.leads, "Beauty main").select("id", "name")


@query(f"SELECT id, name FROM leads_v WHERE {_search_sql('rest', '1')}")
def text_search_by_tokens(t: Tables) -> DataFrame:
    return joins.search_semi(t.leads, joins.search_tokens(t.leads), "rest 1").select("id", "name")


@query("SELECT id, state FROM leads_v WHERE lower(state) = 'europe' AND tier = 'A' AND contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(category, ''), coalesce(city, ''), coalesce(phone, ''), coalesce(website, ''))), '707')")
def browse(t: Tables) -> DataFrame:
    return serving.browse(t.leads.withColumn("county", F.col("state")), "707", "Europe", "a").select("id", "state")


@query(f"SELECT id, {O.full('phone')} AND tier IN ('A', 'B') AND industry_fit IN ('high', 'medium') AS warm FROM leads_v")
def warm_flag(t: Tables) -> DataFrame:
    return t.leads.select("id", A.is_warm().alias("warm"))


@query("SELECT id, tier, score FROM leads_v WHERE tier IN ('B', 'C') AND coalesce(trim(website), '') <> '' AND id NOT IN (SELECT lead_id FROM audit_v) ORDER BY score DESC NULLS LAST, id LIMIT 40")
def audit_targets(t: Tables) -> DataFrame:
    return serving.audit_targets(t.leads, t.audit, limit=40).select("id", "tier", "score")


@query("SELECT id, coalesce(length(trim(website)) > 0, false) AS has_site FROM leads_v ORDER BY coalesce(length(trim(website)) > 0, false) DESC, seq LIMIT 120")
def audit_budget(t: Tables) -> DataFrame:
    return joins.split_budget(t.leads, 120).select("id", "has_site")


SITES = "SELECT id, email, CASE WHEN seq % 3 = 0 THEN NULL ELSE cast(seq % 101 AS int) END AS site_score FROM places_v"


def sites(t: Tables) -> DataFrame:
    return t.places.select("id", "email", F.when(F.col("seq") % 3 != 0, (F.col("seq") % 101).cast("int")).alias("site_score"))


@query(f"SELECT id, site_score FROM ({SITES}) WHERE site_score IS NULL OR site_score < 70")
def qualified_sites(t: Tables) -> DataFrame:
    return serving.qualify(sites(t)).select("id", "site_score")


@query(f"SELECT round_even(avg(site_score), 1) AS mean_site_score, count(*) FILTER (WHERE email <> '') AS emails_found FROM ({SITES})")
def scraper_summary(t: Tables) -> DataFrame:
    return A.scraper_summary(sites(t))


@query(f"SELECT id, site_score FROM ({SITES}) ORDER BY site_score NULLS LAST, id LIMIT 60")
def worst_first(t: Tables) -> DataFrame:
    return serving.worst_first(sites(t), 60).select("id", "site_score")


@query("SELECT * FROM (SELECT 'city' AS facet, city AS value, count(*) AS n FROM leads_v WHERE city <> '' GROUP BY city ORDER BY n DESC, city LIMIT 300) UNION ALL SELECT * FROM (SELECT 'category', category, count(*) AS n FROM leads_v WHERE category <> '' GROUP BY category ORDER BY n DESC, category LIMIT 300) UNION ALL SELECT 'builder', builder, count(*) FROM leads_v WHERE builder <> '' GROUP BY builder")
def facets(t: Tables) -> DataFrame:
    return A.facet_rows(t.leads)


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE tier = 'A') AS tier_a, count(*) FILTER (WHERE tier = 'B') AS tier_b, count(*) FILTER (WHERE tier = 'C') AS tier_c,
 count(*) FILTER (WHERE phone <> '') AS with_phone, round(avg(score), 1) AS avg_score, (SELECT count(*) FROM audit_v) AS audited,
 (SELECT count(*) FROM audit_v WHERE audit_grade IN ('weak', 'broken')) AS bad_sites, (SELECT count(*) FROM crm_v WHERE favorite = 1) AS favorites FROM leads_v""")
def stats(t: Tables) -> DataFrame:
    return A.stats(t.lead_core, t.core_crm, t.audit)


@query(f"SELECT s.status, count(v.id) AS n FROM (VALUES {', '.join(f'({O.lit(s)})' for s in V.STATUSES)}) s(status) LEFT JOIN view_v v ON v.status = s.status GROUP BY s.status")
def status_counts(t: Tables) -> DataFrame:
    return A.status_counts(t.leads, t.crm)


@query("SELECT category, count(*) AS n FROM leads_v WHERE category <> '' GROUP BY category")
def niche_counts(t: Tables) -> DataFrame:
    return A.counts_by(t.leads, "category")


@query("SELECT city, count(*) AS n FROM leads_v WHERE city <> '' GROUP BY city")
def city_counts(t: Tables) -> DataFrame:
    return A.counts_by(t.leads, "city")


_FILL = ("name", "category", "phone", "email", "website", "builder", "social_platforms", "score")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, cast(round_even(100.0 * count(*) FILTER (WHERE length(trim(cast({c} AS varchar))) > 0) / count(*), 0) AS int) AS fill_pct FROM leads_v" for c in _FILL))
def fill_rates(t: Tables) -> DataFrame:
    return A.fill_rates(t.leads, _FILL)


@query("SELECT tier, count(*) AS n FROM leads_v GROUP BY tier")
def tier_distribution(t: Tables) -> DataFrame:
    return A.distribution(t.leads, "tier")


@query("SELECT industry_fit, count(*) AS n FROM leads_v GROUP BY industry_fit")
def fit_distribution(t: Tables) -> DataFrame:
    return A.distribution(t.leads, "industry_fit")


def _gap_sql(by: str, label: str, blank: str) -> str:
    return f"""SELECT coalesce(nullif(trim({by}), ''), '{blank}') AS {label}, count(*) AS total, count(*) FILTER (WHERE tier = 'A') AS no_website,
 round_even(100.0 * count(*) FILTER (WHERE tier = 'A') / count(*), 1) AS no_website_pct,
 count(*) FILTER (WHERE {O.full('phone')} AND tier IN ('A', 'B') AND industry_fit IN ('high', 'medium')) AS warm_leads, count(*) FILTER (WHERE {O.full('phone')}) AS with_phone,
 round_even(cast(sum(outreach_score) AS double) / count(*), 1) AS avg_outreach_score FROM leads_v GROUP BY 1"""


@query(_gap_sql("category", "niche", "(uncategorized)"))
def market_gap_by_niche(t: Tables) -> DataFrame:
    return A.market_gap(t.leads, "category")


@query(_gap_sql("city", "city", "(unknown)"))
def market_gap_by_city(t: Tables) -> DataFrame:
    return A.market_gap(t.leads, "city")


_CELLS = "SELECT coalesce(nullif(trim(category), ''), '(uncategorized)') AS niche, coalesce(nullif(trim(city), ''), '(unknown)') AS city, count(*) AS n FROM leads_v WHERE tier = 'A' GROUP BY 1, 2"


@query(f"SELECT * FROM ({_CELLS}) WHERE n >= 2")
def opportunity_matrix(t: Tables) -> DataFrame:
    return A.opportunity_matrix(t.leads)


@query(f"SELECT * FROM ({_CELLS}) ORDER BY n DESC, niche, city LIMIT 30")
def hottest_cells(t: Tables) -> DataFrame:
    return A.opportunity_matrix(t.leads, 1).orderBy(F.desc("n"), "niche", "city").limit(30)


@query(f"SELECT * FROM ({_gap_sql('category', 'niche', '(uncategorized)')}) ORDER BY warm_leads DESC, niche LIMIT 25")
def market_gap_top_niches(t: Tables) -> DataFrame:
    return A.market_gap(t.leads, "category").orderBy(F.desc("warm_leads"), "niche").limit(25)


_CITY_ROWS = f"SELECT * FROM ({_gap_sql('city', 'city', '(unknown)')}) ORDER BY warm_leads DESC, city LIMIT 20"
_NICHE_ROWS = f"SELECT * FROM ({_gap_sql('category', 'niche', '(uncategorized)')}) ORDER BY warm_leads DESC, niche LIMIT 25"


@query(f"""SELECT 'niche' AS part, niche AS item, cast(NULL AS varchar) AS city, warm_leads, no_website AS n FROM ({_NICHE_ROWS})
 UNION ALL SELECT 'city', NULL, city, warm_leads, no_website FROM ({_CITY_ROWS}) UNION ALL SELECT 'cell', niche, city, NULL, n FROM (SELECT * FROM ({_CELLS}) ORDER BY n DESC, niche, city LIMIT 30)""")
def market_gap_report(t: Tables) -> DataFrame:
    parts = A.market_gap_report(t.leads)
    none = F.lit(None).cast("string")
    niches = parts["top_niches"].select(F.lit("niche").alias("part"), F.col("niche").alias("item"), none.alias("city"), "warm_leads", F.col("no_website").alias("n"))
    cities = parts["top_cities"].select(F.lit("city").alias("part"), none.alias("item"), "city", "warm_leads", F.col("no_website").alias("n"))
    cells = parts["hottest_cells"].select(F.lit("cell").alias("part"), F.col("niche").alias("item"), "city", F.lit(None).cast("long").alias("warm_leads"), "n")
    return niches.unionByName(cities).unionByName(cells)


_HAVE = [c for c in V.FULL_EXPORT_FIELDS if c not in ("alt_categories", "phones_all", "websites_all", "zip", "country", "source_dataset", "source_id")]


@query(" UNION ALL ".join([
    "SELECT 'size' AS part, 'businesses' AS item, count(*) AS n, '' AS text FROM leads_v", "SELECT 'size', 'niches', count(DISTINCT nullif(category, '')), '' FROM leads_v", "SELECT 'size', 'cities', count(DISTINCT nullif(city, '')), '' FROM leads_v",
    *[f"SELECT 'column', '{c}', cast(round_even(100.0 * count(*) FILTER (WHERE length(trim(cast({c} AS varchar))) > 0) / count(*), 0) AS bigint), {O.lit(V.COLUMN_TEXTS[c])} FROM leads_v" for c in _HAVE],
    "SELECT 'tier', tier, count(*), '' FROM leads_v GROUP BY tier", "SELECT 'fit', industry_fit, count(*), '' FROM leads_v GROUP BY industry_fit",
    "SELECT 'niche', category, n, '' FROM (SELECT category, count(*) AS n FROM leads_v WHERE category <> '' GROUP BY category ORDER BY n DESC, category LIMIT 25)",
]))
def data_dictionary(t: Tables) -> DataFrame:
    parts = A.data_dictionary(t.leads)
    row = lambda df, part, item, n, text="''": df.select(F.lit(part).alias("part"), F.expr(item).alias("item"), F.expr(n).cast("long").alias("n"), F.expr(text).alias("text"))
    size = parts["size"].unpivot([], ["businesses", "niches", "cities"], "item", "n")
    out = row(size, "size", "item", "n").unionByName(row(parts["columns"], "column", "column_name", "fill_pct", "text"))
    for part, name, item in (("tier", "tiers", "tier"), ("fit", "fits", "industry_fit"), ("niche", "top_niches", "category")):
        out = out.unionByName(row(parts[name], part, item, "n"))
    return out


@query("SELECT id, name, category, website, city FROM leads_v")
def json_lines(t: Tables) -> DataFrame:
    """Leads written as JSON lines and read back: nulls and other letters stay."""
    path = fresh_path(t.spark, "json-lines")
    rows = t.leads.select("id", "name", "category", "website", "city")
    sinks.write_jsonl(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("SELECT trim(replace(coalesce(nullif(category, ''), 'business'), '_', ' ')) AS niche, count(*) AS warm_leads, round_even(cast(sum(outreach_score) AS double) / count(*), 1) AS avg_score, count(*) FILTER (WHERE tier = 'A') AS tier_a FROM warm_v GROUP BY 1 ORDER BY warm_leads DESC, niche LIMIT 40")
def warm_by_niche(t: Tables) -> DataFrame:
    return A.warm_by_niche(serving.callable_warm(t.leads))


_RANKED = "SELECT id, name, outreach_score, row_number() OVER (ORDER BY outreach_score DESC, coalesce(category, ''), coalesce(name, ''), id) AS rank, tier FROM warm_v"


@query(f"SELECT id, name, outreach_score, rank, CASE WHEN outreach_score >= 80 THEN 'hot' WHEN outreach_score >= 65 THEN 'warm' ELSE '' END AS band FROM ({_RANKED}) WHERE rank <= 300")
def top_calls(t: Tables) -> DataFrame:
    return serving.top_calls(serving.callable_warm(t.leads)).select("id", "name", "outreach_score", "rank", "band")


@query("SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY outreach_score DESC, coalesce(category, ''), coalesce(name, ''), id) AS rank FROM warm_v WHERE tier = 'B') WHERE rank <= 200")
def top_calls_tier_b(t: Tables) -> DataFrame:
    return serving.call_sheet(serving.callable_warm(t.leads))["tier_b"].select("id", "rank")


@query(f"SELECT id, rank FROM ({_RANKED})")
def full_rank(t: Tables) -> DataFrame:
    from ..operators.catalogue import rank_rows

    return rank_rows(serving.callable_warm(t.leads), *serving.call_order()).select("id", "rank")


@query("SELECT id, score FROM leads_v ORDER BY score DESC, seq LIMIT 100")
def score_sort(t: Tables) -> DataFrame:
    return t.leads.orderBy(F.col("score").desc(), "seq").limit(100).select("id", "score")


_SORTS = {
    "tier": ("asc", "tier NULLS FIRST, name NULLS FIRST, id"), "name": ("desc", "name DESC NULLS LAST, name, id"), "city": ("asc", "city NULLS FIRST, name, id"),
    "category": ("desc", "category DESC NULLS LAST, name, id"), "score": ("desc", "score DESC NULLS LAST, name, id"), "updated": ("desc", "updated_at DESC NULLS LAST, id"),
}


def _page(sort: str, order: str):
    return lambda t: serving.page(t.view, 3, 20, sort, order)[0].select("id", "name")


for _name, (_order, _by) in _SORTS.items():
    query(f"SELECT id, name FROM view_v ORDER BY {_by} LIMIT 20 OFFSET 40", name=f"page_by_{_name}")(_page(_name, _order))


@query("SELECT count(*) AS total, cast(ceil(count(*) / 20.0) AS bigint) AS pages FROM view_v WHERE tier = 'A'")
def page_totals(t: Tables) -> DataFrame:
    return serving.page(serving.filter_leads(t.view, {"tier": "A"}), 1, 20)[1]


@query("SELECT id, score FROM view_v WHERE score < 75 OR (score = 75 AND name > 'Customer#000000500') ORDER BY score DESC, name, id LIMIT 50")
def page_by_keyset(t: Tables) -> DataFrame:
    return paging.next_page(t.view, {"score": 75, "name": "Customer#000000500", "id": "zzzz"}, 50, "score", "desc").select("id", "score")


@query("SELECT id, seq <= (SELECT max(seq) FROM (SELECT seq FROM leads_v ORDER BY seq LIMIT 70)) AS enrich FROM leads_v")
def enrich_cap(t: Tables) -> DataFrame:
    return joins.cap_enrich(t.leads, 70, F.col("seq")).select("id", "enrich")


@query("SELECT audit_grade, count(*) AS n FROM (SELECT CASE WHEN load_ms % 5 = 0 THEN '(none)' ELSE audit_grade END AS audit_grade FROM audit_v) GROUP BY audit_grade")
def grade_histogram(t: Tables) -> DataFrame:
    return A.grade_histogram(t.audit.withColumn("audit_grade", F.when(F.col("load_ms") % 5 != 0, F.col("audit_grade"))))


@query("SELECT count(*) FILTER (WHERE tier = 'A') AS tier_a, count(*) FILTER (WHERE tier = 'B') AS tier_b, count(*) FILTER (WHERE tier = 'C') AS tier_c FROM leads_v")
def run_tier_counts(t: Tables) -> DataFrame:
    return A.tier_counts(t.leads)


@query("SELECT 'county' AS facet, state AS value, count(*) AS n FROM leads_v GROUP BY state UNION ALL SELECT 'tier', tier, count(*) FROM leads_v GROUP BY tier UNION ALL SELECT 'total', NULL, count(*) FROM leads_v")
def browse_facets(t: Tables) -> DataFrame:
    return A.browse_facets(t.leads.withColumn("county", F.col("state")))


@query("SELECT coalesce(state, 'TOTAL') AS county, count(*) AS businesses, count(*) FILTER (WHERE tier = 'A') AS tier_a, count(*) FILTER (WHERE phone <> '') AS with_phone FROM leads_v GROUP BY ROLLUP (state)")
def region_summary(t: Tables) -> DataFrame:
    return A.region_summary(t.leads.withColumn("county", F.col("state")))


CALLED = "SELECT lead_id AS id, CASE WHEN updated_at >= TIMESTAMP '2024-01-30 12:00:00' THEN '2024-01-31' ELSE strftime(updated_at, '%Y-%m-%d') END AS last_contacted FROM crm_v"


def called(t: Tables) -> DataFrame:
    day = F.when(F.col("updated_at") >= "2024-01-30 12:00:00", AS_OF).otherwise(F.date_format("updated_at", "yyyy-MM-dd"))
    return t.crm.select(F.col("lead_id").alias("id"), day.alias("last_contacted"))


@query(f"SELECT id, last_contacted FROM ({CALLED}) WHERE last_contacted IS DISTINCT FROM '{AS_OF}'")
def hide_called(t: Tables) -> DataFrame:
    return serving.hide_called(called(t), AS_OF)


@query(f"SELECT count(*) FILTER (WHERE last_contacted = '{AS_OF}') AS done_today, cast(least(100, round(100.0 * count(*) FILTER (WHERE last_contacted = '{AS_OF}') / 200, 0)) AS int) AS pct_of_target FROM ({CALLED})")
def call_progress(t: Tables) -> DataFrame:
    return A.call_progress(called(t), AS_OF, 200)


@query("""SELECT id, CASE WHEN audit_grade = 'broken' THEN 'Site is broken' WHEN audit_grade = 'weak' THEN 'Weak site (no HTTPS / not mobile / slow)' WHEN tier = 'A' THEN 'No real website'
 WHEN tier = 'B' THEN 'DIY site' || coalesce(' (' || nullif(trim(builder), '') || ')', '') ELSE 'Worth a look' END AS reason FROM view_v""")
def call_reason(t: Tables) -> DataFrame:
    return serving.call_reasons(t.view).select("id", "reason")


@query("SELECT name, category, phone_fmt, tier, builder, score, audit_grade, status, favorite, id FROM view_v WHERE phone <> ''")
def filtered_export(t: Tables) -> DataFrame:
    return serving.export_view(t.view, {"hasPhone": "yes"}).select("name", "category", "phone_fmt", "tier", "builder", "score", "audit_grade", "status", "favorite", "id")


_FULL = [c for c in V.FULL_EXPORT_FIELDS if c not in ("alt_categories", "phones_all", "websites_all", "zip", "country", "source_dataset", "source_id")]


@query(f"SELECT {', '.join(_FULL)} FROM leads_v")
def full_export(t: Tables) -> DataFrame:
    return serving.export_full(t.leads)


@query("SELECT coalesce(name, '') AS \"Name\", coalesce(cast(score AS varchar), '') AS \"Score\", '' AS \"Nothing\" FROM leads_v")
def declared_csv_columns(t: Tables) -> DataFrame:
    return sinks.declared(t.leads, [("Name", "name"), ("Score", "score"), ("Nothing", "nowhere")])


@query("SELECT lead_id, status, notes, favorite, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated FROM crm_v")
def crm_patches(t: Tables) -> DataFrame:
    return t.crm.select("lead_id", "status", "notes", "favorite", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("""SELECT 'c' || user_id AS lead_id, last(CASE event_type WHEN 'purchase' THEN 'Won' ELSE 'Lost' END ORDER BY ts, event_id) AS status, strftime(max(ts), '%Y-%m-%d') AS last_contacted
 FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id""")
def logged_outcomes(t: Tables) -> DataFrame:
    events = t.read("events").filter("event_type in ('purchase', 'error')").select(
        "event_id", "ts", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("lead_id"), F.when(F.col("event_type") == "purchase", "Won").otherwise("Lost").alias("outcome")
    )
    return state.fold_patches(state.log_outcome(events)).select("lead_id", F.col("status.v").alias("status"), F.col("last_contacted.v").alias("last_contacted"))


ROWS = "SELECT 'c' || user_id AS lead_id, event_id AS checked_at, event_type AS audit_grade FROM events"


def audit_rows(t: Tables) -> DataFrame:
    return t.read("events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("lead_id"), F.col("event_id").alias("checked_at"), F.col("event_type").alias("audit_grade"))


@query(f"SELECT lead_id, max(checked_at) AS checked_at, arg_max(audit_grade, checked_at) AS audit_grade FROM ({ROWS}) GROUP BY lead_id")
def audit_upsert(t: Tables) -> DataFrame:
    rows = audit_rows(t)
    return state.upsert_audit(rows.filter("checked_at % 2 = 0"), rows.filter("checked_at % 2 = 1")).select("lead_id", "checked_at", "audit_grade")


@query("SELECT lead_id, status FROM crm_v WHERE lead_id IN (SELECT id FROM leads_v WHERE tier <> 'C')")
def rebuild_state(t: Tables) -> DataFrame:
    return state.rebuild_catalogue(t.leads.filter("tier <> 'C'"), t.crm, t.audit)[1].select("lead_id", "status")


@query(f"SELECT lead_id, checked_at FROM ({ROWS}) WHERE lead_id IN (SELECT id FROM leads_v)")
def orphan_prune(t: Tables) -> DataFrame:
    return joins.prune_orphans(audit_rows(t), t.leads).select("lead_id", "checked_at")


@query(f"SELECT accepted, count(*) AS n FROM (SELECT r.lead_id IN (SELECT id FROM leads_v) AS accepted FROM ({ROWS}) r) GROUP BY accepted")
def accepted_rows(t: Tables) -> DataFrame:
    return joins.accept_known(audit_rows(t).withColumnRenamed("lead_id", "id"), t.leads).groupBy("accepted").agg(F.count("*").alias("n"))


@query("SELECT id FROM leads_v WHERE id NOT IN (SELECT lead_id FROM audit_v)")
def skip_done(t: Tables) -> DataFrame:
    return joins.skip_done(t.leads, t.audit, "id", "lead_id").select("id")


@query(f"SELECT lead_id, checked_at FROM ({ROWS}) WHERE lead_id NOT IN (SELECT lead_id FROM audit_v WHERE audit_grade = 'weak')")
def resumed_audit(t: Tables) -> DataFrame:
    return state.first_audits(audit_rows(t), t.audit.filter("audit_grade = 'weak'")).select("lead_id", "checked_at")


@query("""SELECT id, CASE WHEN http_status > 0 AND http_status < 400 THEN 'Yes' WHEN website <> '' THEN 'No' ELSE '' END AS reachable,
 CASE WHEN https = 1 THEN 'Yes' WHEN website <> '' THEN 'No' ELSE '' END AS https, CASE WHEN mobile = 1 THEN 'Yes' WHEN website <> '' THEN 'No' ELSE '' END AS mobile
 FROM leads_v l LEFT JOIN audit_v a ON a.lead_id = l.id""")
def attached_audit(t: Tables) -> DataFrame:
    return joins.attach_audit(t.leads, t.audit).select("id", "reachable", "https", "mobile")


ACTIVITY = "SELECT event_id, 'a' || (user_id % 7) AS account_id, 'c' || user_id AS lead_id, event_type AS kind, ts AS created_at FROM events"


def activity(t: Tables) -> DataFrame:
    e = t.read("events")
    return e.select("event_id", F.concat(F.lit("a"), (F.col("user_id") % 7).cast("string")).alias("account_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("lead_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("created_at"))


@query(f"SELECT account_id, kind, strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(*) AS n FROM ({ACTIVITY}) GROUP BY 1, 2, 3")
def account_usage(t: Tables) -> DataFrame:
    return A.usage(activity(t)).select("account_id", "kind", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n")


@query(f"SELECT event_id, kind FROM ({ACTIVITY}) WHERE lead_id = 'c7' ORDER BY created_at DESC, event_id DESC")
def lead_timeline(t: Tables) -> DataFrame:
    return state.timeline(activity(t), "c7").select("event_id", "kind")


@query("""SELECT l.id, coalesce(s.status, 'New') AS status, coalesce(s.favorite, 0) AS favorite FROM leads_v l
 LEFT JOIN (SELECT * FROM crm_v WHERE cast(substr(lead_id, 2) AS int) % 3 = 1) s ON s.lead_id = l.id""")
def tenant_view(t: Tables) -> DataFrame:
    account = F.concat(F.lit("t"), (F.substring("lead_id", 2, 12).cast("int") % 3).cast("string"))
    return joins.tenant_view(t.leads, t.crm.withColumn("account_id", account), "t1").select("id", "status", "favorite")


@query("SELECT id FROM leads_v WHERE seq % 4 IN (0, 2)")
def visible_rows(t: Tables) -> DataFrame:
    owner = F.when(F.col("seq") % 4 == 1, "other").when(F.col("seq") % 4 == 2, "me").when(F.col("seq") % 4 == 3, "third")
    return joins.visible_rows(t.leads.withColumn("account_id", owner), "me").select("id")


@query("SELECT id FROM view_v WHERE tier = 'A' AND phone <> ''")
def saved_list(t: Tables) -> DataFrame:
    return serving.run_saved_list(t.view, '{"tier": "A", "hasPhone": "yes"}').select("id")


@query("""SELECT lead_id, cast(http_status AS int) AS http_status, cast(load_ms AS int) AS load_ms, nullif(trim(title), '') AS title FROM
 (SELECT 'c' || event_id AS lead_id, CASE WHEN event_id % 3 = 0 THEN 200.0 WHEN event_id % 3 = 1 THEN 404.0 END AS http_status, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS load_ms, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END AS title FROM events)""")
def audit_coercion(t: Tables) -> DataFrame:
    k = F.col("event_id")
    rows = t.read("events").select(
        F.concat(F.lit("c"), k.cast("string")).alias("lead_id"), F.when(k % 3 == 0, " 200.0 ").when(k % 3 == 1, "404").otherwise("n/a").alias("http_status"),
        F.when(k % 4 == 0, "").otherwise(k.cast("string")).alias("load_ms"), F.when(k % 5 == 0, " ").otherwise(F.col("event_type")).alias("title"),
    )
    return state.coerce_audit(rows, ("http_status", "load_ms"))


