"""Keyed state that outlives a rebuild: CRM rows, audits, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from .joins import first_per_key, prune_orphans

#: Columns a patch may hold; a patch is a map from these to text, so that an absent key
#: and an explicit null differ.
PATCHED = ("status", "notes", "last_contacted", "favorite")


def as_patches(rows: DataFrame) -> DataFrame:
    """(event_id, ts, lead_id, patch map) from columns in which null means absent."""
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c), F.col(c).cast("string"))) for c in PATCHED if c in rows.columns]
    return rows.select("event_id", "ts", "lead_id", F.map_from_entries(F.array_compact(F.array(*pairs))).alias("patch"))


def fold_patches(patches: DataFrame) -> DataFrame:
    """One row a lead: the last valid value of each column, and whether it was given.

    Each is a max_by over (ts, event_id): it combines on the map side, so a lead with
    very many patches is folded wherever they are. A status outside the five, an empty
    one too, counts as not given.
    """
    at = F.struct("ts", "event_id")
    out = []
    for c in PATCHED:
        given = F.map_contains_key("patch", F.lit(c))
        value = F.try_element_at("patch", F.lit(c))
        if c == "status":
            given = given & (value.isNull() | value.isin(*V.STATUSES))
        when = F.when(given, at)
        out += [F.max_by(F.struct(value.alias("v")), when).alias(c), F.max(when).isNotNull().alias(f"has_{c}")]
    return patches.groupBy("lead_id").agg(*out, F.max("ts").alias("updated_at"))


def apply_crm_patches(crm: DataFrame, patches: DataFrame, leads: DataFrame) -> DataFrame:
    """CRM rows after the patches: only given columns change, unknown leads are rejected,
    favorite becomes 0 or 1, updated_at is the last patch's time."""
    return patch_crm(crm, prune_orphans(fold_patches(patches), leads))


def patch_crm(crm: DataFrame, known: DataFrame) -> DataFrame:
    """CRM rows after patches of fold_patches(), of leads that are known."""
    # a value column is a struct, so that a given null is told from no value
    new = known.select(
        "lead_id",
        *[F.col(f"{c}.v").alias(f"_{c}") for c in PATCHED],
        *[F.col(f"has_{c}").alias(f"_has_{c}") for c in PATCHED],
        F.col("updated_at").alias("_updated_at"),
    )
    both = crm.join(new, "lead_id", "full_outer")
    pick = lambda c, default: F.when(F.coalesce(f"_has_{c}", F.lit(False)), F.col(f"_{c}")).otherwise(default)
    flag = F.when(F.lower("_favorite").isin("1", "true"), 1).otherwise(0)
    return both.select(
        "lead_id",
        pick("status", F.coalesce("status", F.lit("New"))).alias("status"),
        pick("notes", F.col("notes")).alias("notes"),
        pick("last_contacted", F.col("last_contacted")).alias("last_contacted"),
        F.when(F.coalesce("_has_favorite", F.lit(False)), flag).otherwise(F.coalesce("favorite", F.lit(0))).alias("favorite"),
        F.coalesce("_updated_at", "updated_at").alias("updated_at"),
    )


def empty_crm(spark) -> DataFrame:
    return spark.createDataFrame([], "lead_id string, status string, notes string, last_contacted string, favorite int, updated_at timestamp")


def upsert_audit(audit: DataFrame, new: DataFrame, seq: str = "checked_at") -> DataFrame:
    """The newest row of each lead; a new row wins over an old one of the same time."""
    both = audit.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c != "lead_id"]
    best = both.groupBy("lead_id").agg(F.max_by(F.struct(*rest), F.struct(F.col(seq), F.col("_new"))).alias("_row"))
    return best.select("lead_id", *[F.col(f"_row.{c}").alias(c) for c in rest if c != "_new"])


def rebuild_catalogue(new_leads: DataFrame, crm: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new leads, and the state rows whose lead is still there."""
    return new_leads, prune_orphans(crm, new_leads), prune_orphans(audit, new_leads)


def log_outcome(events: DataFrame) -> DataFrame:
    """(event_id, ts, lead_id, outcome) -> patches of status and last_contacted."""
    patch = F.create_map(F.lit("status"), F.col("outcome"), F.lit("last_contacted"), F.date_format("ts", "yyyy-MM-dd"))
    return events.select("event_id", "ts", "lead_id", patch.alias("patch"))


def timeline(activity: DataFrame, lead_id: str | None = None) -> DataFrame:
    """Activity, newest first."""
    if lead_id:
        activity = activity.filter(F.col("lead_id") == lead_id)
    return activity.orderBy(F.col("created_at").desc(), F.col("event_id").desc())


def coerce_audit(rows: DataFrame, ints=("http_status", "https", "mobile", "load_ms")) -> DataFrame:
    """Text columns of an audit file: '' becomes null, numbers whole or null."""
    out = {c: F.nullif(F.trim(c), F.lit("")) for c, t in rows.dtypes if t == "string"}
    for c in ints:
        if c in rows.columns:
            out[c] = F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("double").try_cast("int")
    return rows.withColumns(out)


def first_audits(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Targets without an audit row yet."""
    return targets.join(done.select("lead_id").distinct(), "lead_id", "left_anti")


__all__ = [
    "PATCHED", "apply_crm_patches", "as_patches", "coerce_audit", "empty_crm", "first_audits", "first_per_key", "fold_patches",
    "log_outcome", "patch_crm", "rebuild_catalogue", "timeline", "upsert_audit",
]
