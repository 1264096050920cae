"""Counts and reports over leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.columns import present
from .shared import cut


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def counts_by(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(column, n) of non-empty values, most frequent first, ties by value."""
    out = df.filter(F.length(column) > 0).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(limit) if limit else out


def facets(leads: DataFrame, limit: int = 300) -> dict[str, DataFrame]:
    return {"city": counts_by(leads, "city", limit), "category": counts_by(leads, "category", limit), "builder": counts_by(leads, "builder")}


def facet_rows(leads: DataFrame, limit: int = 300) -> DataFrame:
    """All facets in one table (facet, value, n)."""
    parts = [d.select(F.lit(k).alias("facet"), F.col(k).alias("value"), "n") for k, d in facets(leads, limit).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stats(leads: DataFrame, crm: DataFrame, audit: DataFrame) -> DataFrame:
    """One row; each table is reduced to one row before they meet."""
    a = leads.agg(
        F.count("*").alias("total"),
        *[_count(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in "ABC"],
        _count(F.length("phone") > 0).alias("with_phone"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.lit(0).alias("_one"),
    )
    b = audit.agg(F.count("*").alias("audited"), _count(F.col("audit_grade").isin("weak", "broken")).alias("bad_sites"), F.lit(0).alias("_one"))
    c = crm.agg(_count(F.col("favorite") == 1).alias("favorites"), F.lit(0).alias("_one"))
    return a.join(b, "_one").join(c, "_one").drop("_one")


def status_counts(leads: DataFrame, crm: DataFrame) -> DataFrame:
    """The five statuses with their number of leads; a lead without a row is New."""
    joined = leads.select("id").join(crm.select(F.col("lead_id").alias("id"), "status"), "id", "left")
    found = joined.groupBy(F.coalesce("status", F.lit("New")).alias("status")).agg(F.count("*").alias("n"))
    order = leads.sparkSession.createDataFrame([(s,) for s in V.STATUSES], "status string")
    return order.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def _filled(columns) -> list[Column]:
    """How many rows fill each column, under the column's name with an underscore."""
    return [_count(present(F.col(c).cast("string"))).alias(f"_{c}") for c in columns]


def _rates(total: DataFrame, columns, n: str = "_n") -> DataFrame:
    """(column, fill_pct) from one row of _filled() and the number of rows; null without any."""
    return total.select(*[F.bround(100 * F.col(f"_{c}") / F.nullif(F.col(n), F.lit(0)), 0).cast("int").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "fill_pct")


def fill_rates(leads: DataFrame, columns) -> DataFrame:
    """(column, fill_pct): one pass over the leads, then one row a column."""
    return _rates(leads.agg(F.count("*").alias("_n"), *_filled(columns)), columns)


def distribution(leads: DataFrame, column: str) -> DataFrame:
    return leads.groupBy(column).agg(F.count("*").alias("n"))


def is_warm() -> Column:
    """Callable, in need, and in a niche that buys."""
    return present("phone") & F.upper("tier").isin("A", "B") & F.col("industry_fit").isin("high", "medium")


_GAP_KEYS = {"category": ("niche", "(uncategorized)"), "city": ("city", "(unknown)")}


def _gap_key(by: str) -> Column:
    label, blank = _GAP_KEYS[by]
    return F.coalesce(F.nullif(F.trim(by), F.lit("")), F.lit(blank)).alias(label)


def _gap_sums() -> list[Column]:
    return [
        F.count("*").alias("total"), _count(F.upper("tier") == "A").alias("no_website"), _count(is_warm()).alias("warm_leads"),
        _count(present("phone")).alias("with_phone"), F.sum(F.coalesce("outreach_score", F.lit(0))).alias("_score"),
    ]


def _gap_rows(sums: DataFrame, label: str) -> DataFrame:
    return sums.select(
        label, "total", "no_website", F.bround(100 * F.col("no_website") / F.col("total"), 1).alias("no_website_pct"), "warm_leads", "with_phone",
        F.bround(F.col("_score") / F.col("total"), 1).alias("avg_outreach_score"),
    )


def market_gap(leads: DataFrame, by: str = "category") -> DataFrame:
    """Size, need and warmth of each niche or city, in one conditional aggregate."""
    return _gap_rows(leads.groupBy(_gap_key(by)).agg(*_gap_sums()), _GAP_KEYS[by][0])


def market_gap_report(leads: DataFrame) -> dict[str, DataFrame]:
    """The 25 niches and 20 cities with the most warm leads, and the 30 cells of niche and
    city with the most leads without a site; ties go by name. The leads are read once, by
    grouping sets whose sums are stored: a row a niche, a city and a cell."""
    keyed = leads.select(_gap_key("category"), _gap_key("city").alias("_city"), "tier", "phone", "industry_fit", "outreach_score").withColumnRenamed("_city", "city")
    sums = cut(keyed.groupingSets([["niche"], ["city"], ["niche", "city"]], "niche", "city").agg(F.grouping_id().alias("_set"), *_gap_sums()))
    of = lambda k: sums.filter(F.col("_set") == k)  # noqa: E731  bits: niche, city left out
    return {
        "top_niches": _gap_rows(of(1), "niche").orderBy(F.desc("warm_leads"), "niche").limit(25),
        "top_cities": _gap_rows(of(2), "city").orderBy(F.desc("warm_leads"), "city").limit(20),
        "hottest_cells": of(0).filter("no_website > 0").select("niche", "city", F.col("no_website").alias("n")).orderBy(F.desc("n"), "niche", "city").limit(30),
    }


def data_dictionary(leads: DataFrame, columns=V.FULL_EXPORT_FIELDS, docs: dict[str, str] | None = None, top: int = 25) -> dict[str, DataFrame]:
    """What an export of leads holds: size (rows, niches and cities), columns (with fill
    rate and text) that exist, in order, tiers, fits, and the niches with the most rows. The
    leads are read once, by grouping sets whose counts are stored."""
    docs = V.COLUMN_TEXTS if docs is None else docs
    have = [c for c in columns if c in leads.columns]
    told = leads.sparkSession.createDataFrame([(k, c, docs.get(c, "")) for k, c in enumerate(have)], "ord int, column_name string, text string")
    keys = ("tier", "industry_fit", "category", "city")
    named = leads.select(*[F.col(c).alias(f"_by_{c}") for c in keys], *have)
    sums = cut(named.groupingSets([*[[f"_by_{c}"] for c in keys], []], *[f"_by_{c}" for c in keys]).agg(F.grouping_id().alias("_set"), F.count("*").alias("_n"), *_filled(have)))

    def by(c: str) -> DataFrame:
        left_out = (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - keys.index(c)))
        return sums.filter(F.col("_set") == left_out).select(F.col(f"_by_{c}").alias(c), F.col("_n").alias("n"))

    # an aggregate, as no set has a row if there are no leads
    total = sums.filter(F.col("_set") == (1 << len(keys)) - 1).agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_n"), *[F.max(f"_{c}").alias(f"_{c}") for c in have])
    filled = lambda c: by(c).filter(F.length(c) > 0)
    # one row each
    size = total.select(F.col("_n").alias("businesses")).crossJoin(filled("category").agg(F.count("*").alias("niches"))).crossJoin(filled("city").agg(F.count("*").alias("cities")))
    return {
        "size": size,
        "columns": told.join(F.broadcast(_rates(total, have)), "column_name").select("ord", "column_name", "fill_pct", "text"),
        "tiers": by("tier"),
        "fits": by("industry_fit"),
        "top_niches": filled("category").orderBy(F.desc("n"), "category").limit(top),
    }


def opportunity_matrix(leads: DataFrame, least: int = 2) -> DataFrame:
    """(niche, city, n) of leads without a site, in cells of ``least`` or more."""
    niche = F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("(uncategorized)")).alias("niche")
    city = F.coalesce(F.nullif(F.trim("city"), F.lit("")), F.lit("(unknown)")).alias("city")
    cells = leads.filter(F.upper("tier") == "A").groupBy(niche, city).agg(F.count("*").alias("n"))
    return cells.filter(F.col("n") >= least)


def warm_by_niche(warm: DataFrame, top: int = 40) -> DataFrame:
    niche = F.trim(F.replace(F.coalesce(F.nullif("category", F.lit("")), F.lit("business")), F.lit("_"), F.lit(" "))).alias("niche")
    out = warm.groupBy(niche).agg(
        F.count("*").alias("warm_leads"), F.bround(F.sum("outreach_score") / F.count("*"), 1).alias("avg_score"), _count(F.col("tier") == "A").alias("tier_a")
    )
    return out.orderBy(F.desc("warm_leads"), "niche").limit(top)


def grade_histogram(audit: DataFrame) -> DataFrame:
    return audit.groupBy(F.coalesce("audit_grade", F.lit("(none)")).alias("audit_grade")).agg(F.count("*").alias("n"))


def build_summary(raw: DataFrame, leads: DataFrame, crm: DataFrame) -> DataFrame:
    one = F.lit(0).alias("_one")
    a = raw.agg(F.count("*").alias("raw"), one)
    b = leads.agg(F.count("*").alias("clean"), _count(F.col("tier") == "A").alias("tier_a"), _count(F.length("phone") > 0).alias("with_phone"), one)
    c = crm.agg(F.count("*").alias("crm_kept"), one)
    return a.join(b, "_one").join(c, "_one").drop("_one")


def tier_counts(leads: DataFrame) -> DataFrame:
    return leads.agg(*[_count(F.col("tier") == t).alias(f"tier_{t.lower()}") for t in "ABC"])


def browse_facets(leads: DataFrame) -> DataFrame:
    """(facet, value, n) of counties, tiers and the total."""
    part = lambda c: leads.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
    total = leads.agg(F.count("*").alias("n")).select(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value"), "n")
    return part("county").unionByName(part("tier")).unionByName(total)


def region_summary(leads: DataFrame) -> DataFrame:
    """Businesses, tier A and phones of each county, and a TOTAL row."""
    out = leads.rollup("county").agg(
        F.count("*").alias("businesses"), _count(F.col("tier") == "A").alias("tier_a"), _count(F.length("phone") > 0).alias("with_phone"), F.grouping("county").alias("_all")
    )
    return out.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("county")).alias("county"), "businesses", "tier_a", "with_phone")


def suppression_counts(clients: DataFrame) -> DataFrame:
    """(label, names) of each competitor, and the number of different names in all."""
    each = clients.filter(F.length("name_key") > 0).select("label", "name_key").distinct()
    by_label = each.groupBy("label").agg(F.count("*").alias("names"))
    total = each.select("name_key").distinct().agg(F.count("*").alias("names")).select(F.lit("(all)").alias("label"), "names")
    return by_label.unionByName(total)


def call_progress(view: DataFrame, as_of: str, target: int) -> DataFrame:
    done = _count(F.col("last_contacted") == as_of)
    return view.agg(done.alias("done_today"), F.least(F.lit(100), F.round(100 * done / max(1, target), 0).cast("int")).alias("pct_of_target"))


def scraper_summary(leads: DataFrame) -> DataFrame:
    return leads.agg(F.bround(F.avg("site_score"), 1).alias("mean_site_score"), _count(F.length("email") > 0).alias("emails_found"))


def usage(activity: DataFrame, window: str = "1 day") -> DataFrame:
    """Events of each account and kind in each window."""
    return activity.groupBy("account_id", "kind", F.window("created_at", window)["start"].alias("window_start")).agg(F.count("*").alias("n"))


def handoff_snapshot(leads: DataFrame) -> DataFrame:
    """(facet, value, n) of grade, fit, reach and need."""
    parts = [
        leads.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
        for c in ("grade", "industry_fit", "reach_channel", "need")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verify_notes(verdicts: DataFrame) -> DataFrame:
    note = (
        F.when(F.col("verdict") == "has_site", F.concat(F.lit("may have a site: "), F.coalesce("site", F.lit(""))))
        .when(F.col("verdict") == "no_site_found", "no own site among the results")
        .when(F.col("verdict") == "throttled", "no results were served - check by hand").otherwise("not checked")
    )
    return verdicts.withColumn("verify_note", note)


def verify_outcome(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(_count(F.col("verdict") == "has_site").alias("false_positives"), _count(F.col("verdict") == "throttled").alias("throttled"), F.count("*").alias("checked"))
