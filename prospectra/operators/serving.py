"""Filtering, sorting and paging of the joined lead view."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import values as V
from ..functions.columns import present, settled
from . import catalogue, joins
from .aggregates import is_warm

_ON = ("1", 1, True)


def filter_leads(view: DataFrame, params: dict) -> DataFrame:
    """All given parameters at once; unknown and empty ones are ignored."""
    p = {k: v for k, v in params.items() if v not in (None, "")}
    full = lambda c: F.length(c) > 0
    tests: list[Column] = [F.col(k) == p[k] for k in ("city", "category", "tier", "builder") if k in p]
    if "status" in p:
        tests.append(F.coalesce("status", F.lit("New")) == p["status"])
    if p.get("hasWebsite") == "yes":
        tests.append(full("website"))
    if p.get("hasWebsite") == "no":
        tests.append(F.coalesce(F.length("website"), F.lit(0)) == 0)
    if p.get("hasPhone") == "yes":
        tests.append(full("phone"))
    if p.get("hasEmail") == "yes":
        tests.append(full("email"))
    try:
        tests.append(F.col("score") >= int(p["minScore"]))
    except (KeyError, ValueError):
        pass
    if p.get("favorite") in _ON:
        tests.append(F.coalesce("favorite", F.lit(0)) == 1)
    grade = F.col("audit_grade")
    tests += {
        "bad": [grade.isin("weak", "broken")], "broken": [grade == "broken"], "weak": [grade == "weak"], "good": [grade == "good"],
        "yes": [grade.isNotNull()], "no": [grade.isNull()],
    }.get(p.get("audit"), [])
    if p.get("callList") in _ON:
        tests += [full("phone"), F.col("tier").isin("A", "B") | F.coalesce(grade.isin("weak", "broken"), F.lit(False))]
    for t in tests:
        view = view.filter(t)
    return joins.search(view, p["q"]) if "q" in p else view


def browse(leads: DataFrame, q: str | None = None, county: str | None = None, tier: str | None = None) -> DataFrame:
    """County and tier regardless of case; q anywhere in five joined fields."""
    if county:
        leads = leads.filter(F.lower("county") == county.lower())
    if tier:
        leads = leads.filter(F.upper("tier") == tier.upper())
    if q:
        text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("name", "category", "city", "phone", "website")]))
        leads = leads.filter(F.contains(text, F.lit(q.lower())))
    return leads


SORTS = {"tier": "tier", "name": "name", "city": "city", "category": "category", "score": "score", "updated": "updated_at"}


def sort_order(sort: str | None = None, order: str = "asc") -> list[Column]:
    """Order columns of a list; nulls last for score and update, first else as ascending
    text has it in the serving store; name and id settle ties."""
    c = F.col(SORTS.get(sort or "", "tier"))
    down = str(order).lower() == "desc"
    if sort in ("score", "updated"):
        first = c.desc_nulls_last() if down else c.asc_nulls_last()
    else:
        first = c.desc_nulls_last() if down else c.asc_nulls_first()
    rest = [] if sort == "updated" else [F.col("name").asc_nulls_first()]
    return [first, *rest, F.col("id").asc()]


def sort_leads(view: DataFrame, sort: str | None = None, order: str = "asc") -> DataFrame:
    return view.orderBy(*sort_order(sort, order))


def page(view: DataFrame, number: int = 1, size: int = 50, sort: str | None = None, order: str = "asc", most: int = 200, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row with total and pages)."""
    number, size = max(1, number), min(most, max(least, size))
    rows = sort_leads(view, sort, order).offset((number - 1) * size).limit(size)
    total = view.agg(F.count("*").alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))
    return rows, total


def run_saved_list(view: DataFrame, filter_json: str) -> DataFrame:
    """Evaluate the stored parameters of a smart list."""
    return filter_leads(view, json.loads(filter_json))


def audit_targets(leads: DataFrame, audit: DataFrame, tiers=("B", "C"), limit: int | None = None, redo: bool = False) -> DataFrame:
    """Leads with a site in the tiers and not audited yet, best score first."""
    wanted = leads.filter(F.upper("tier").isin(*tiers) & present("website"))
    if not redo:
        wanted = joins.skip_done(wanted, audit, "id", "lead_id")
    wanted = wanted.orderBy(F.col("score").desc_nulls_last(), "id")
    return wanted.limit(limit) if limit else wanted


def qualify(df: DataFrame, threshold: int = 70) -> DataFrame:
    return df.filter(F.col("site_score").isNull() | (F.col("site_score") < threshold))


def worst_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Lowest site score first, unscored sites last; id settles ties."""
    rows = df.orderBy(F.col("site_score").asc_nulls_last(), "id")
    return rows.limit(limit) if limit else rows


def hide_called(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(~F.col("last_contacted").eqNullSafe(F.lit(as_of)))


def warm_leads(leads: DataFrame) -> DataFrame:
    return leads.filter(is_warm())


def callable_warm(leads: DataFrame) -> DataFrame:
    scored = settled(leads, "outreach_score", "industry_fit")
    return scored.filter((F.col("outreach_score") > 0) & (F.col("industry_fit") != "low"))


def call_order() -> list[Column]:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return [F.col("outreach_score").desc(), blank("category").asc(), blank("name").asc(), F.col("id").asc()]


def top_calls(warm: DataFrame, n: int = 300) -> DataFrame:
    """The first n warm leads with rank and band."""
    band = F.when(F.col("outreach_score") >= 80, "hot").when(F.col("outreach_score") >= 65, "warm").otherwise("")
    return catalogue.rank_rows(warm, *call_order(), head=n).withColumn("band", band)


def call_sheet(warm: DataFrame, top: int = 300) -> dict[str, DataFrame]:
    from .aggregates import warm_by_niche

    return {"top_calls": top_calls(warm, top), "tier_b": top_calls(warm.filter("tier = 'B'"), 200), "by_niche": warm_by_niche(warm, 40)}


def call_reasons(view: DataFrame) -> DataFrame:
    return view.withColumn("reason", scoring.call_reason("audit_grade", "tier", "builder"))


def export_view(view: DataFrame, params: dict) -> DataFrame:
    """All filtered rows in the export's fields, best score first."""
    fields = [F.col(c) if c in view.columns else F.lit(None).cast("string").alias(c) for c in V.EXPORT_VIEW_FIELDS]
    return filter_leads(view, params).orderBy(F.col("score").desc_nulls_last(), F.col("name").asc(), "id").select(*fields)


def export_full(leads: DataFrame) -> DataFrame:
    """The export fields that exist, by the best score that exists, category, name."""
    score = next((c for c in ("outreach_score", "score") if c in leads.columns), None)
    order = ([F.col(score).desc_nulls_last()] if score else []) + [F.col("category").asc_nulls_first(), F.col("name").asc_nulls_first(), F.col("id").asc()]
    return leads.orderBy(*order).select(*[c for c in V.FULL_EXPORT_FIELDS if c in leads.columns])
