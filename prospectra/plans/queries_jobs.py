"""Queries over what jobs store: guarded runs, files by header, releases, state, indexes."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bucketed, guard, pages, paging, search
from ..operators.shared import fresh_path, stored
from ..sources import readers
from ..sources.releases import ReleaseStore
from ..streaming import jobs
from . import profiles
from . import queries_serving as S
from .queries_pages import _NEED_SQL
from .registry import Tables, query

#: Pages whose number it divides break the hook below.
_ODD = 89


def page_number(page: dict) -> dict:
    """A hook that reads the number in a page's address and cannot do with some of them."""
    number = int(re.search(r"/(\d+)", page["url"])[1])
    if number % _ODD == 0:
        raise ValueError(f"odd page {number}")
    return {"number": number}


def _guarded() -> profiles.Profile:
    return replace(
        profiles.get("web_design"),
        page_hook=lambda c: guard.RowHook(page_number, ("url",), "number long"),
        attempts=lambda c: {"dialled": guard.to_number(F.col("phone"), "bigint")},
    )


_NUMBERS = "SELECT lead_id, page_ord, cast(regexp_extract(url, '/([0-9]+)', 1) AS bigint) AS k FROM crawl_v"
_DIALLED = "try_cast(nullif(trim(phone), '') AS bigint)"


@query(f"""SELECT n.id, cast(base + CASE WHEN phone <> '' THEN 4 ELSE 0 END AS int) AS score, tier, number, {_DIALLED} AS dialled,
 nullif(concat_ws('; ', odd, CASE WHEN nullif(trim(phone), '') IS NOT NULL AND {_DIALLED} IS NULL THEN 'dialled: no number: ' || trim(phone) END), '') AS enrich_error
 FROM ({_NEED_SQL}) n LEFT JOIN (SELECT lead_id, arg_min(k, page_ord) FILTER (WHERE k % {_ODD} <> 0) AS number, 'odd page ' || arg_min(k, page_ord) FILTER (WHERE k % {_ODD} = 0) AS odd
  FROM ({_NUMBERS}) GROUP BY lead_id) p ON p.lead_id = n.id""")
def run_guarded(t: Tables) -> DataFrame:
    """A run in which some pages break a hook and some phones are no numbers."""
    return profiles.run(_guarded(), t.places, t.crawl).select("id", "score", "tier", "number", "dialled", "enrich_error")


@query(f"SELECT lead_id, page_ord, 'odd page ' || k AS enrich_error, 'first' AS run FROM ({_NUMBERS}) WHERE k % {_ODD} = 0")
def quarantined_pages(t: Tables) -> DataFrame:
    """The pages on which the hook of a run failed, as the run stored them."""
    path = fresh_path(t.spark, "quarantine")
    for _ in range(2):  # a run that is repeated replaces its own rows
        profiles.run(_guarded(), t.places, t.crawl, quarantine=path, run_name="first")
    return guard.quarantined(t.spark, path, "lead_id string, page_ord long, enrich_error string")


@query("""SELECT id, CASE WHEN seq % 4 < 3 THEN coalesce(name, '') || CASE WHEN seq % 8 = 1 THEN chr(10) || 'second "line", of it' ELSE '' END ELSE '' END AS name,
 CASE WHEN seq % 4 IN (0, 2) THEN coalesce(website, '') ELSE '' END AS website, CASE WHEN seq % 4 > 0 THEN coalesce(city, '') ELSE '' END AS city, CASE WHEN seq % 4 = 1 THEN coalesce(phone, '') ELSE '' END AS phone,
 CASE seq % 4 WHEN 0 THEN 'Sonoma' WHEN 1 THEN 'Napa' WHEN 2 THEN 'San Benito' ELSE 'Lake' END AS county FROM places_v""")
def county_headers(t: Tables) -> DataFrame:
    """Lead files of four counties whose headers differ in number and order of columns, with
    line breaks, quotes and commas in values."""
    base = fresh_path(t.spark, "county-headers")
    part = F.col("seq") % 4
    name = F.concat(F.coalesce("name", F.lit("")), F.when(F.col("seq") % 8 == 1, '\nsecond "line", of it').otherwise(""))
    rows = t.places.select("id", name.alias("name"), "website", "city", "phone", part.alias("part"))
    headers = {"sonoma": ("id", "name", "website"), "napa": ("id", "city", "name", "phone"), "san_benito": ("website", "name", "city", "id"), "lake": ("city", "id")}
    for k, (county, columns) in enumerate(headers.items()):
        rows.filter(F.col("part") == k).select(*columns).write.option("header", True).option("escape", '"').csv(f"{base}/{county}_leads_full.csv")
    paths = [f"{base}/{county}_leads_full.csv" for county in headers]
    return readers.read_counties(t.spark, paths, ("id", "name", "website", "city", "phone"))


@query("SELECT lead_id, status, notes, favorite, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated FROM crm_v")
def crm_buckets(t: Tables) -> DataFrame:
    """CRM state after three micro-batches of patches, in the order of their times."""
    table = jobs.CrmTable(t.spark, fresh_path(t.spark, "crm"), 16)
    patches = stored(jobs.state.as_patches(t.patch_rows), "patches")
    leads = stored(t.leads.select("id"), "lead-ids")
    first, last = patches.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    for k in range(3):
        rows = patches.filter((F.col("ts") >= first + k * third) & ((F.col("ts") < first + (k + 1) * third) | F.lit(k == 2)))
        for _ in range(2):  # a batch that is run again changes nothing
            table.merge(rows, k, leads)
    return table.read().select("lead_id", "status", "notes", "favorite", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


_AUDITED = "SELECT lead_id, http_status, audit_grade FROM audit_v WHERE lead_id IN (SELECT id FROM places_v WHERE website <> '')"
_AUDIT = "lead_id string, http_status int, audit_grade string"


@query(_AUDITED)
def audit_log(t: Tables) -> DataFrame:
    """An audit that was stopped after some of its parts and started again."""
    log = jobs.AuditLog(t.spark, fresh_path(t.spark, "audit-log"), _AUDIT)
    targets = t.places.filter("website <> ''").select(F.col("id").alias("lead_id"))
    audit = lambda left: pages.audit_ci(t.crawl.join(left, "lead_id", "left_semi")).select("lead_id", "http_status", "audit_grade")
    log.audit(targets.filter(F.pmod(F.xxhash64("lead_id"), F.lit(3)) == 1), audit, "run", 1)
    log.audit_all(targets, audit, "run", 3)
    log.audit_all(targets, audit, "again", 2)  # finds nothing left
    log.compact("all")
    return log.read()


@query("SELECT id, name, lat, lon, state AS region, '2024-03-01' AS release FROM places_v WHERE seq % 7 <> 0 AND state IN ('ASIA', 'EUROPE') AND lat BETWEEN 37.7 AND 39.5 AND lon BETWEEN -123.5 AND -122.0")
def release_scan(t: Tables) -> DataFrame:
    """A box of two regions from the newest published release of three that were written."""
    store = ReleaseStore(t.spark, fresh_path(t.spark, "places"))
    rows = t.places.select("id", "name", "lat", "lon", "state", "seq")
    store.publish(rows.filter("seq % 5 = 0"), "2024-01-15", "state")
    store.publish(rows.filter("seq % 7 <> 0"), "2024-03-01", "state")
    # a release that is written but not published
    rows.filter("seq % 2 = 0").withColumnRenamed("state", "region").write.partitionBy("region").parquet(f"{store.folder.path}/release=2024-04-01")
    return store.in_box((37.7, -123.5, 39.5, -122.0), ("ASIA", "EUROPE")).select("id", "name", "lat", "lon", "region", "release")


def _indexed(q: str):
    def run(t: Tables) -> DataFrame:
        leads = stored(t.leads.select("id", "name", "category", "city", "address"), "searched")
        index = search.TokenIndex(t.spark, fresh_path(t.spark, "tokens"))
        index.build(leads)
        return index.search(leads, q).select("id", "name")

    return run


query(f"SELECT id, name FROM leads_v WHERE {S._search_sql('beauty', 'main')}", name="indexed_search")(_indexed("Beauty main"))
query(f"SELECT id, name FROM leads_v WHERE {S._search_sql('customer', '1', 'nation')}", name="indexed_search_prefixes")(_indexed("Customer 1, nation"))


def _walked(sort: str, order: str):
    def run(t: Tables) -> DataFrame:
        view = stored(t.view.select("id", "name", "tier", "city", "category", "score", "updated_at"), "listed")
        row = None
        for _ in range(3):  # the row at which the third page ends
            row = paging.next_page(view, row, 19, sort, order).tail(1)[0].asDict()
        return paging.next_page(view, row, 20, sort, order).select("id", "name")

    return run


for _name, (_order, _by) in S._SORTS.items():
    query(f"SELECT id, name FROM view_v ORDER BY {_by} LIMIT 20 OFFSET 57", name=f"walk_by_{_name}")(_walked(_name, _order))


@query("SELECT id, name FROM view_v ORDER BY city NULLS FIRST, name, id LIMIT 30 OFFSET 120")
def stored_page(t: Tables) -> DataFrame:
    """A deep page from the stored ranges of the list."""
    listed = paging.SortedPages(t.spark, fresh_path(t.spark, "listed"))
    listed.build(t.view.select("id", "name", "city"), "city")
    return listed.page(5, 30, "city").select("id", "name")


@query(f"SELECT event_id, account_id, lead_id, kind, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM ({S.ACTIVITY}) WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-21' AND lead_id IN ('c1', 'c2', 'c3')")
def activity_days(t: Tables) -> DataFrame:
    """Some leads' events of eleven days, from batches that share and repeat events."""
    store, rows = jobs.ActivityStore(t.spark, fresh_path(t.spark, "activity")), S.activity(t)
    for k in (0, 1, 2, 1):
        store.append(rows.filter(F.col("event_id") % 5 >= k), f"b{k}")
    store.compact("all")
    found = store.read("2024-01-10", "2024-01-20").filter(F.col("lead_id").isin("c1", "c2", "c3"))
    return found.select("event_id", "account_id", "lead_id", "kind", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT id, name, tier, status, favorite, audit_status, audit_https, audit_grade, notes FROM view_v")
def bucketed_view(t: Tables) -> DataFrame:
    """The joined view over tables in buckets of one id."""
    path = fresh_path(t.spark, "serving")
    tables = bucketed.ServingTables(t.spark, path, "s" + path.rpartition("-")[2], 8)
    tables.build(leads=t.leads.select("id", "name", "tier"), crm=t.crm, audit=t.audit)
    return tables.view().select("id", "name", "tier", "status", "favorite", "audit_status", "audit_https", "audit_grade", "notes")
