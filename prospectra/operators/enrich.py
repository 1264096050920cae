"""Offline enrichment and call scoring of a whole catalogue, one projection each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scoring as S


def enrich_offline(leads: DataFrame) -> DataFrame:
    """Tier, builder, contact and completeness columns; running it again changes nothing."""
    a = S.tiers(leads).withColumns(
        {
            "phone_fmt": C.phone_fmt("phone"),
            "area_code": C.area_code("phone"),
            "social_platforms": C.social_platforms("socials"),
            "email_owned": C.email_owned("email", "website"),
            "completeness": S.completeness("name", "phone", "email", "website", "socials", "address", "category"),
        }
    )
    return a.withColumns(
        {
            "score": S.lead_score("tier", "phone", "email", "confidence"),
            "best_contact": C.best_contact("phone", "email", "social_platforms"),
            "pitch": S.pitch("name", "tier", "builder", "city", "category"),
        }
    )


def score_calls(leads: DataFrame) -> DataFrame:
    """industry_fit, outreach_score and why_warm on each lead."""
    a = leads.withColumn("industry_fit", S.industry_fit("category"))
    return a.withColumns(
        {
            "outreach_score": S.outreach_score("tier", "industry_fit", "phone", "email", "socials", "completeness", "confidence"),
            "why_warm": S.why_warm("tier", "industry_fit", "builder", "email"),
        }
    )


def demote_verified(leads: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Leads for which a search found a site fall to tier C; their score stays."""
    found = verdicts.filter("verdict = 'has_site'").select(F.col("lead_id").alias("id"), F.lit(True).alias("_found"))
    hit = F.coalesce("_found", F.lit(False))
    return (
        leads.join(found, "id", "left")
        .withColumns({"tier_reason": F.when(hit, F.concat("tier_reason", F.lit("; site found via web search"))).otherwise(F.col("tier_reason")), "tier": F.when(hit, "C").otherwise(F.col("tier"))})
        .drop("_found")
    )


def handoff(leads: DataFrame) -> DataFrame:
    """need, reach_channel, handoff_score, grade and recommended_action."""
    need = F.when(F.col("tier") == "A", "no_site").when(F.col("tier") == "B", "weak").otherwise("good")
    a = leads.withColumns({"need": need, "reach_channel": S.reach_channel("phone", "email")})
    owner = F.col("email_owned") == 1
    a = a.withColumn("handoff_score", S.handoff_score("need", "industry_fit", "reach_channel", owner, F.lit(False), F.col("social_platforms").isNotNull()))
    action = F.concat(
        F.when(F.col("reach_channel").isin("email+phone", "phone"), "Call").when(F.col("reach_channel") == "email", "Write").otherwise("Find a contact"),
        F.lit(" - "), F.col("need"), F.lit(", "), F.col("industry_fit"), F.lit(" fit"),
    )
    return a.withColumns({"grade": S.handoff_grade("handoff_score"), "recommended_action": action})
