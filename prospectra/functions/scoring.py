"""Tiers, scores, grades and short texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V
from .columns import ColumnOrName, any_of, col, contains_any, filled, listed_domain, matches_any, present, registrable, site_host, weak_domain, weak_substring

# Reasons of a tier.
NO_SITE = "No website"
LISTING = "Social/listing only - no owned site"
AUDIT_FIRST = "Has a website - audit quality before pitching"
REAL_SITE = "Has a real website - audit quality before pitching"


def _points(value: Column, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, points in table.items():
        out = F.when(value == key, F.lit(points)).otherwise(out)
    return out


def _when(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def tier_v1(website: ColumnOrName) -> Column:
    return F.when(~(F.length(F.coalesce(col(website), F.lit(""))) > 0) | weak_substring(website), "A").otherwise("C")


def tier_v1_reason(website: ColumnOrName) -> Column:
    missing = F.coalesce(F.length(col(website)), F.lit(0)) == 0
    return F.when(missing, NO_SITE).when(weak_substring(website), LISTING).otherwise(AUDIT_FIRST)


def tiers(df: DataFrame, website: str = "website") -> DataFrame:
    """builder, tier and tier_reason by the host of the website: blank or on a social or
    listing page is A, on a builder's domain B, else C. Host and domain are worked out
    once for all of them."""
    h = df.withColumn("_host", site_host(website)).withColumn("_reg", registrable("_host"))
    listed = listed_domain(F.col("_host"), V.LISTING_DOMAINS).isNotNull()
    names = F.create_map(*[F.lit(x) for pair in V.BUILDER_DOMAINS.items() for x in pair])
    h = h.withColumn("_listed", present(website) & listed)
    h = h.withColumn("builder", F.when(present(website) & ~F.col("_listed"), F.try_element_at(names, F.col("_reg"))))
    on_builder = F.concat(F.lit("DIY builder site ("), F.col("builder"), F.lit(") - upsell to custom"))
    missing, made = ~present(website), F.col("builder").isNotNull()
    return h.withColumns(
        {
            "tier": F.when(missing | F.col("_listed"), "A").when(made, "B").otherwise("C"),
            "tier_reason": F.when(missing, NO_SITE).when(F.col("_listed"), LISTING).when(made, on_builder).otherwise(REAL_SITE),
        }
    ).drop("_host", "_reg", "_listed")


def _half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def lead_score(tier: ColumnOrName, phone: ColumnOrName, email: ColumnOrName, confidence: ColumnOrName) -> Column:
    need = _points(col(tier), {"A": 50, "B": 35, "C": 10}, 10)
    reach = _when(present(phone), 25) + _when(present(email), 15)
    return _clamp(need + reach + _half_even(F.coalesce(col(confidence), F.lit(0.0)) * 10))


def completeness(name, phone, email, website, socials, address, category) -> Column:
    fields = [present(name), present(phone), present(email), present(F.when(F.length(col(website)) > 0, col(website)).otherwise(col(socials))), present(address), present(category)]
    return _half_even(sum((f.cast("int") for f in fields), F.lit(0)) * 100 / 6)


def industry_fit(category: ColumnOrName) -> Column:
    c = F.lower(F.coalesce(col(category), F.lit("")))
    return F.when(c == "", "medium").when(matches_any(c, V.LOW_FIT), "low").when(matches_any(c, V.HIGH_FIT), "high").otherwise("medium")


def outreach_score(tier, fit, phone, email, socials, complete, confidence) -> Column:
    need = _points(col(tier), {"A": 50, "B": 42, "C": 14}, 14)
    niche = _points(col(fit), {"high": 28, "medium": 8, "low": -25}, 8)
    reach = F.lit(12) + _when(present(email), 8) + _when(present(socials), 3)
    extra = (F.coalesce(col(complete), F.lit(0)) * 0.08).cast("int") + _half_even(F.coalesce(col(confidence), F.lit(0.0)) * 4)
    return F.when(present(phone), _clamp(need + niche + reach + extra)).otherwise(F.lit(0))


def why_warm(tier, fit, builder_name, email) -> Column:
    t = col(tier)
    site = F.when(t == "A", "No real website").when(
        t == "B", F.concat(F.lit("DIY site ("), F.coalesce(filled(builder_name), F.lit("builder")), F.lit(") - upsell"))
    ).otherwise("Has a site")
    return F.concat_ws(
        "; ", site, F.when(col(fit) == "high", "high-fit niche"), F.when(present(email), "has phone + email").otherwise("has phone")
    )


def pitch(name, tier, builder_name, city, category) -> Column:
    """One line to open a call with, by tier (own wording)."""
    who = F.coalesce(filled(name), F.lit("your business"))
    place = F.coalesce(filled(city), F.lit("your area"))
    trade = F.coalesce(F.replace(filled(category), F.lit("_"), F.lit(" ")), F.lit("local business"))
    t = col(tier)
    none = F.concat(F.lit("Hello "), who, F.lit(": people in "), place, F.lit(" who look for a "), trade, F.lit(" online cannot find a site of yours. May I show you a draft?"))
    diy = F.concat(F.lit("Hello "), who, F.lit(": your page runs on "), F.coalesce(filled(builder_name), F.lit("a site kit")), F.lit(". A custom site would load faster and rank better. May I show you one?"))
    real = F.concat(F.lit("Hello "), who, F.lit(": shall I check how fast, mobile-friendly and findable your site is, free of charge?"))
    return F.when(t == "A", none).when(t == "B", diy).otherwise(real)


# --- profiles ---------------------------------------------------------------------


def site_need(website, reachable, https, mobile, load_ms, site_builder, phone) -> tuple[Column, Column, Column]:
    """(score, tier, why) of the web-design profile. A site without an audit row counts
    as unreachable."""
    missing = F.coalesce(F.length(col(website)), F.lit(0)) == 0
    weak = F.when(missing, F.lit(None)).otherwise(weak_domain(website))
    up = F.coalesce(col(reachable).cast("boolean"), F.lit(False))
    issues = [
        (~F.coalesce(col(https).cast("boolean"), F.lit(False)), 18, F.lit("no HTTPS")),
        (~F.coalesce(col(mobile).cast("boolean"), F.lit(False)), 14, F.lit("not mobile-friendly")),
        (F.coalesce(col(load_ms), F.lit(0)) > 4000, 10, F.concat(F.lit("slow ("), col(load_ms).cast("string"), F.lit("ms)"))),
        (F.coalesce(col(site_builder).isin(*V.DIY_BASIC), F.lit(False)), 12, F.concat(F.lit("DIY ("), col(site_builder), F.lit(")"))),
    ]
    any_issue = any_of(c for c, _, _ in issues)
    points = sum((_when(c, p) for c, p, _ in issues), F.lit(0))
    base = F.when(missing, 60).when(weak.isNotNull(), 40).when(~up, 50).otherwise(points)
    tier = F.when(missing | weak.isNotNull() | ~up, "A").when(any_issue, "B").otherwise("C")
    texts = F.concat_ws("; ", *[F.when(c, t) for c, _, t in issues])
    why = (
        F.when(missing, "NO WEBSITE")
        .when(weak.isNotNull(), F.concat(F.lit("non-site link ("), weak, F.lit(")")))
        .when(~up, "site unreachable").when(any_issue, texts).otherwise("real site, no obvious issues")
    )
    has_phone = F.coalesce(F.length(col(phone)) > 0, F.lit(False))
    why = F.concat(why, F.when(has_phone, "; phone listed").otherwise(""))
    return (base + _when(has_phone, 4)).cast("int"), tier, why


def site_need_opener(website, category, city) -> Column:
    site = F.lower(F.coalesce(col(website), F.lit("")))
    return (
        F.when(site == "", F.concat(F.lit("No site yet: offer one page for "), F.concat_ws(" in ", filled(category), filled(city))))
        .when(contains_any(site, ("facebook", "instagram")), "Only a social page: offer a site that searches can find.")
        .when(site.startswith("http://"), "Plain HTTP, marked as not secure by browsers: offer a rebuild with a certificate.")
        .otherwise("Has a site: look at its quality first.")
    )


def site_need_opener_v0(website, niche, city) -> Column:
    """The older line, which knows listing-only leads but no category words (own wording)."""
    site = F.lower(F.coalesce(col(website), F.lit("")))
    search = F.trim(F.concat_ws(" ", F.lower(F.coalesce(filled(niche), F.lit("business"))), filled(city)))
    return (
        F.when(site == "", F.concat(F.lit("No site: offer one page that is found for '"), search, F.lit("' and rings on a tap.")))
        .when(F.contains(site, F.lit("yelp")), "Only a directory listing: offer a domain of their own.")
        .when(contains_any(site, ("facebook", "instagram")), "Only social pages: offer a site beside them.")
        .when(site.startswith("http://"), "No certificate, so browsers warn: offer a rebuild that has one.")
        .otherwise("Has a site: see what it is worth first.")
    )


def coordinator_opener_v0(agents, gap, software) -> Column:
    """The older line, without suppression and hiring (own wording)."""
    n = F.coalesce(col(agents), F.lit(0))
    size = F.when(n > 0, F.concat(n.cast("string"), F.lit("-agent "))).otherwise("")
    rest = (
        F.when(col(gap) == "open", "brokerage without coordination tools: ask who does the files now.")
        .when(col(gap) == "software", F.concat(F.lit("brokerage with "), F.coalesce(filled(software), F.lit("coordination software")), F.lit(": ask who works it.")))
        .when(col(gap) == "in_house", "brokerage with a coordinator of its own: offer to step in when files pile up.")
        .otherwise("brokerage: ask how files are coordinated.")
    )
    return F.concat(size, rest)


def coordinator_fit(agents, gap, phone, contact, suppressed, suppressed_by, software, weights=None) -> tuple[Column, Column, Column]:
    """(score, tier, why) of the transaction-coordination profile."""
    w = weights or V.COORDINATOR_WEIGHTS
    n = F.coalesce(col(agents), F.lit(0))
    volume = F.when(n > 0, F.least((n * F.lit(float(w["per_agent"]))).cast("int"), F.lit(w["volume_cap"]))).otherwise(0)
    need = _points(F.coalesce(col(gap), F.lit("unknown")), {k: w[k] for k in ("hiring", "open", "software", "in_house", "confirmed")}, 0)
    has_phone, has_contact = (F.coalesce(F.length(col(c)) > 0, F.lit(False)) for c in (phone, contact))
    taken = F.coalesce(col(suppressed).cast("boolean"), F.lit(False))
    score = (volume + need + _when(has_phone, w["phone"]) + _when(has_contact, w["contact"]) + _when(taken, w["suppressed"])).cast("int")
    tier = F.when(score >= w["tier_a"], "A").when(score >= w["tier_b"], "B").otherwise("C")
    g = F.coalesce(col(gap), F.lit("unknown"))
    why = F.concat_ws(
        "; ",
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" agents, size points "), volume.cast("string"))).otherwise("size not known"),
        F.when(g == "hiring", "is hiring a coordinator").when(g == "open", "no coordinator found")
        .when(g == "software", F.concat(F.lit("uses "), F.coalesce(filled(software), F.lit("coordination software"))))
        .when(g == "in_house", "signs of a coordinator in house").when(g == "confirmed", "a competitor's client").otherwise("coordination unknown"),
        F.when(has_phone, "phone"),
        F.when(has_contact, F.concat(F.lit("ask for "), col(contact))),
        F.when(taken, F.concat(F.lit("client of "), F.coalesce(filled(suppressed_by), F.lit("a competitor")))),
    )
    return score, tier, why


def coordinator_opener(agents, gap, software, suppressed, suppressed_by) -> Column:
    n = F.coalesce(col(agents), F.lit(0))
    size = F.when(n > 0, F.concat(n.cast("string"), F.lit(" agents. "))).otherwise("")
    g = F.coalesce(col(gap), F.lit("unknown"))
    text = (
        F.when(g == "hiring", "They want to hire a coordinator: offer the work by the file instead.")
        .when(g == "open", "Nobody seems to coordinate: ask who does the paperwork up to closing.")
        .when(g == "software", F.concat(F.lit("They run "), F.coalesce(filled(software), F.lit("coordination software")), F.lit(": ask who works it for each file.")))
        .when(g == "in_house", "They coordinate in house: offer cover for busy weeks.")
        .otherwise("Ask how they coordinate.")
    )
    taken = F.concat(F.lit("Served by "), F.coalesce(filled(suppressed_by), F.lit("a competitor")), F.lit(": call again when that ends."))
    return F.when(F.coalesce(col(suppressed).cast("boolean"), F.lit(False)), taken).otherwise(F.concat(size, text))


# --- audits -----------------------------------------------------------------------


def call_reason(grade, tier, builder_name) -> Column:
    diy = F.concat(F.lit("DIY site"), F.coalesce(F.concat(F.lit(" ("), filled(builder_name), F.lit(")")), F.lit("")))
    return (
        F.when(col(grade) == "broken", "Site is broken").when(col(grade) == "weak", "Weak site (no HTTPS / not mobile / slow)")
        .when(col(tier) == "A", "No real website").when(col(tier) == "B", diy).otherwise("Worth a look")
    )


def audit_grade_v1(status, https, mobile, load_ms) -> Column:
    s = F.coalesce(col(status), F.lit(0))
    load = F.when(F.coalesce(col(load_ms), F.lit(0)) == 0, 9999).otherwise(col(load_ms))
    return F.when((s == 0) | (s >= 400), "broken").when((col(https) == 1) & (col(mobile) == 1) & (load < 4000), "good").otherwise("weak")


def site_quality(status, https, mobile, load_ms, site_builder, stale, analytics) -> Column:
    s, load = F.coalesce(col(status), F.lit(0)), F.coalesce(col(load_ms), F.lit(0))
    flag = lambda c: F.coalesce(col(c), F.lit(0)) == 1
    q = (
        F.lit(100) - _when(~flag(https), 25) - _when(~flag(mobile), 20)
        - F.when(load > 8000, 25).when(load > 4000, 12).otherwise(0)
        - _when(F.coalesce(col(site_builder).isin(*V.DIY_DEEP), F.lit(False)), 15) - _when(flag(stale), 15) - _when(~flag(analytics), 5)
    )
    return F.when((s == 0) | (s >= 400), F.lit(0)).otherwise(_clamp(q))


def site_grade(status, quality) -> Column:
    s, q = F.coalesce(col(status), F.lit(0)), col(quality)
    return F.when((s == 0) | (s >= 400), "broken").when(q >= 75, "good").when(q >= 45, "weak").otherwise("neglected")


def no_site_grade(verdict) -> Column:
    return F.when(col(verdict) == "no_site_found", "no_site").otherwise("unknown")


def audit_notes(load_ms, mobile, https, site_builder) -> Column:
    flag = lambda c: F.coalesce(col(c), F.lit(0)) == 1
    return F.array_compact(
        F.array(
            F.when(col(load_ms) > 4000, F.concat(F.lit("Slow load ("), col(load_ms).cast("string"), F.lit("ms)"))),
            F.when(~flag(mobile), "No mobile viewport"),
            F.when(~flag(https), "No HTTPS"),
            F.when(col(site_builder).isin(*V.DIY_BASIC), F.concat(F.lit("DIY-builder ("), col(site_builder), F.lit(")"))),
        )
    )


#: Own defaults for the hand-off score, whose tables are published only in part.
HANDOFF_NEED = {"no_site": 40, "dead": 39, "thin": 34, "weak": 30, "good": 10}
HANDOFF_VALUE = {"high": 30, "medium": 15, "low": 7}
HANDOFF_REACH = {"email+phone": 22, "email": 17, "phone": 12, "none": 0}


def reach_channel(phone, email) -> Column:
    return F.when(present(phone) & present(email), "email+phone").when(present(email), "email").when(present(phone), "phone").otherwise("none")


def handoff_score(need, fit, channel, owner_email, owner_name, social) -> Column:
    base = _points(col(need), HANDOFF_NEED, 10) + _points(col(fit), HANDOFF_VALUE, 15) + _points(col(channel), HANDOFF_REACH, 0)
    return _clamp(base + F.least(F.lit(8), _when(col(owner_email), 5) + _when(col(owner_name), 2) + _when(col(social), 3)))


def handoff_grade(score) -> Column:
    return F.when(col(score) >= 85, "A").when(col(score) >= 70, "B").when(col(score) >= 55, "C").otherwise("D")
