"""One row for each business: by name key, id or label, with a stated winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import first_per_key


def dedupe_fill(leads: DataFrame, key: str = "name_key", seq: str = "seq", fill=("website", "phone")) -> DataFrame:
    """The first row of each key; its empty ``fill`` columns take the first non-empty
    later value. Rows with an empty key go. All are aggregates that combine on the map
    side."""
    rows = leads.filter(F.length(key) > 0)
    whole = F.struct(*[F.col(c) for c in leads.columns if c != key])
    found = {c: F.min_by(F.when(F.length(c) > 0, F.col(c)), F.when(F.length(c) > 0, F.col(seq))).alias(f"_{c}") for c in fill}
    best = rows.groupBy(key).agg(F.min_by(whole, seq).alias("_row"), *found.values())

    def value(c: str) -> Column:
        if c == key:
            return F.col(c)
        own = F.col(f"_row.{c}")
        return F.coalesce(F.col(f"_{c}"), own).alias(c) if c in fill else own.alias(c)

    return best.select(*[value(c) for c in leads.columns])


def dedupe_last(rows: DataFrame, key: str = "id", file: str = "file", seq: str = "seq") -> DataFrame:
    """The row of the last file, and there the last row."""
    whole = F.struct(*[F.col(c) for c in rows.columns if c != key])
    best = rows.groupBy(key).agg(F.max_by(whole, F.struct(file, seq)).alias("_row"))
    return best.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def dedupe_first(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return first_per_key(rows, key, F.col(seq))


def dedupe_merge_label(rows: DataFrame, key: str = "id", label: str = "niche", seq: str = "seq") -> DataFrame:
    """The first row of each key; its label takes up, by " / ", each later label that it
    does not contain yet. Distinct labels of a key are few, rows may be many. Rows with a
    null key share it."""
    firsts = rows.groupBy(key, label).agg(F.min(seq).alias("_at"))
    ordered = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_at"), F.col(label).alias("l")))).alias("_labels"))
    merged = F.aggregate(
        F.col("_labels"),
        F.lit("").cast("string"),
        lambda s, x: F.when(s == "", x["l"]).when(F.contains(s, x["l"]), s).otherwise(F.concat(s, F.lit(" / "), x["l"])),
    )
    labels = ordered.select(F.col(key).alias("_key"), merged.alias(label))
    return first_per_key(rows, key, F.col(seq)).drop(label).join(labels, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def assign_primary(rows: DataFrame, priority: DataFrame, key: str = "id") -> DataFrame:
    """The row of each key whose county has the lowest rank in (county, rank)."""
    ranked = rows.join(priority, "county", "left").withColumn("rank", F.coalesce("rank", F.lit(1 << 30)))
    return first_per_key(ranked, key, F.col("rank"), F.col("county")).drop("rank")


def populated(columns) -> Column:
    return sum((F.coalesce(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(False)).cast("int") for c in columns), F.lit(0))


def dedupe_richest(rows: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The row with the most non-empty fields; the earlier one on a tie."""
    fields = [c for c in rows.columns if c not in (key, seq)]
    ranked = rows.withColumn("populated", populated(fields))
    return first_per_key(ranked, key, -F.col("populated"), F.col(seq))


def first_label(clients: DataFrame, key: str = "name_key", seed: str = "seed_ord") -> DataFrame:
    """(key, label): the label of the first seed that named a client."""
    return clients.filter(F.length(key) > 0).groupBy(key).agg(F.min_by("label", seed).alias("label"))
