"""Joins between leads and their state, name lists, domains and tenants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of

#: CRM and audit columns of the joined view, by their names there.
AUDIT_COLUMNS = {
    "http_status": "audit_status", "https": "audit_https", "mobile": "audit_mobile", "load_ms": "audit_load_ms",
    "builder_live": "audit_builder", "audit_grade": "audit_grade", "error": "audit_error", "checked_at": "audit_checked_at",
}


def lead_view(leads: DataFrame, crm: DataFrame, audit: DataFrame) -> DataFrame:
    """Leads with their CRM and audit state, one row a lead, defaults filled in."""
    state = crm.select(F.col("lead_id").alias("id"), "status", "notes", "last_contacted", "favorite", "updated_at")
    seen = audit.select(F.col("lead_id").alias("id"), *[F.col(c).alias(a) for c, a in AUDIT_COLUMNS.items() if c in audit.columns])
    view = leads.join(state, "id", "left").join(seen, "id", "left")
    return view.withColumns({"status": F.coalesce("status", F.lit("New")), "favorite": F.coalesce("favorite", F.lit(0))})


def exclude_known(leads: DataFrame, names: DataFrame, key: str = "name_key") -> DataFrame:
    return leads.join(names.select(key).distinct(), key, "left_anti")


def skip_done(targets: DataFrame, done: DataFrame, target_id: str = "id", done_id: str = "id") -> DataFrame:
    """An anti-join, which a null among the done ids does not empty as NOT IN would."""
    return targets.join(done.select(F.col(done_id).alias(target_id)).distinct(), target_id, "left_anti")


def merge_source(primary: DataFrame, secondary: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """All of the primary, and of the secondary the first row of each key it lacks."""
    new = secondary.filter(F.length(key) > 0).join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(first_per_key(new, key, F.col(seq)), allowMissingColumns=True)


def first_per_key(df: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row a key: the first in an order. An aggregate of structs combines on the map
    side, so a key with very many rows never gathers in one task."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    ranked = [o.alias(f"_o{k}") for k, o in enumerate(order)]
    whole = df.select(*keys, F.struct(*[F.col(c) for c in rest]).alias("_row"), F.struct(*ranked).alias("_order"))
    best = whole.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def apply_suppression(leads: DataFrame, suppressed: DataFrame, key: str = "name_key") -> DataFrame:
    """suppressed and suppressed_by from a table (key, label) of one row a key."""
    return leads.join(suppressed.select(key, F.col("label").alias("suppressed_by")), key, "left").withColumn(
        "suppressed", F.col("suppressed_by").isNotNull()
    )


def prune_orphans(state: DataFrame, leads: DataFrame, state_id: str = "lead_id") -> DataFrame:
    return state.join(leads.select(F.col("id").alias(state_id)), state_id, "left_semi")


def accept_known(rows: DataFrame, leads: DataFrame, row_id: str = "id") -> DataFrame:
    """Rows with `accepted`: whether their id is a lead's."""
    known = leads.select(F.col("id").alias(row_id), F.lit(True).alias("accepted")).distinct()
    return rows.join(known, row_id, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def attach_audit(leads: DataFrame, audit: DataFrame) -> DataFrame:
    """reachable, https and mobile as Yes / No, blank where there is no website."""
    shown = leads.join(audit.select(F.col("lead_id").alias("id"), "http_status", "https", "mobile"), "id", "left")
    has_site = F.coalesce(F.length("website") > 0, F.lit(False))
    told = lambda c: F.when(F.coalesce(c, F.lit(False)), "Yes").when(has_site, "No").otherwise("")
    return shown.withColumns(
        {
            "reachable": told((F.col("http_status") > 0) & (F.col("http_status") < 400)),
            "https": told(F.col("https") == 1),
            "mobile": told(F.col("mobile") == 1),
        }
    ).drop("http_status")


def match_domain(df: DataFrame, host: str, domains: DataFrame, row_id: str = "id") -> DataFrame:
    """Columns of ``df`` with matched: the listed domain of the lowest rank that the host
    equals or lies under. Suffixes of the host meet the list in an equi-join."""
    labels = F.split(F.col(host), "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hits = df.select(row_id, F.explode(suffixes).alias("domain")).join(domains, "domain")
    best = hits.groupBy(row_id).agg(F.min_by("domain", "rank").alias("matched"))
    return df.join(best, row_id, "left")


def tenant_view(leads: DataFrame, state: DataFrame, account: str) -> DataFrame:
    """Leads with one account's state. The account comes from the session, not a query."""
    own = state.filter(F.col("account_id") == account).select(F.col("lead_id").alias("id"), "status", "favorite", "notes")
    view = leads.join(own, "id", "left")
    return view.withColumns({"status": F.coalesce("status", F.lit("New")), "favorite": F.coalesce("favorite", F.lit(0))})


def visible_rows(leads: DataFrame, account: str) -> DataFrame:
    return leads.filter(F.col("account_id").isNull() | (F.col("account_id") == account))


def search_tokens(leads: DataFrame, fields=("name", "category", "city", "address")) -> DataFrame:
    """(id, token): the searchable words of each lead, the table to bucket by token."""
    words = F.split(F.lower(F.concat_ws(" ", *fields)), "[^a-z0-9]+")
    return leads.select("id", F.explode(F.array_distinct(F.filter(words, lambda t: t != ""))).alias("token"))


def query_tokens(q: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", q.lower())


def search(leads: DataFrame, q: str, fields=("name", "category", "city", "address")) -> DataFrame:
    """Each word of the query begins a word of the lead. Without a word, all leads."""
    words = F.split(F.lower(F.concat_ws(" ", *fields)), "[^a-z0-9]+")
    for t in query_tokens(q):
        leads = leads.filter(F.exists(words, _begins(t)))
    return leads


def _begins(prefix: str):
    return lambda word: F.startswith(word, F.lit(prefix))


def search_semi(leads: DataFrame, tokens: DataFrame, q: str) -> DataFrame:
    """The same over a token table: matching tokens only are read and counted."""
    wanted = query_tokens(q)
    if not wanted:
        return leads
    flags = [F.max(F.startswith("token", F.lit(t)).cast("int")).alias(f"t{k}") for k, t in enumerate(wanted)]
    hits = tokens.filter(any_of(F.startswith("token", F.lit(t)) for t in wanted)).groupBy("id").agg(*flags)
    for k in range(len(wanted)):
        hits = hits.filter(F.col(f"t{k}") == 1)
    return leads.join(hits.select("id"), "id", "left_semi")


def cap_enrich(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """enrich: true for the first n rows in the order (a bounded top-k), false else."""
    first = df.orderBy(*order).limit(n).select("id", F.lit(True).alias("enrich"))
    return df.join(first, "id", "left").withColumn("enrich", F.coalesce("enrich", F.lit(False)))


def split_budget(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows, those with a site before those without, each by seq."""
    has_site = F.coalesce(F.length(F.trim("website")) > 0, F.lit(False))
    return df.withColumn("has_site", has_site).orderBy(F.col("has_site").desc(), "seq").limit(limit)
