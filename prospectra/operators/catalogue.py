"""Flattening, cleaning and first tiers of a business catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import values as V
from ..functions.columns import any_of, present, weak_domain, weak_substring
from .shared import cut


def in_bbox(df: DataFrame, south: float, west: float, north: float, east: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Both ends included; on nested columns the bounds reach the Parquet scan."""
    return df.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))


def category_any(df: DataFrame, substrings: Iterable[str], category: str = "category") -> DataFrame:
    return df.filter(any_of(F.contains(F.lower(category), F.lit(s.lower())) for s in substrings))


def filter_niche_city(df: DataFrame, category: str | None = None, city: str | None = None, limit: int | None = None) -> DataFrame:
    """Leads without a website first, then by name; id settles ties."""
    for name, part in (("category", category), ("city", city)):
        if part:
            df = df.filter(F.contains(F.lower(name), F.lit(part.lower())))
    missing = F.coalesce(F.length("website"), F.lit(0)) == 0
    df = df.orderBy(missing.desc(), F.col("name").asc_nulls_last(), "id")
    return df.limit(limit) if limit else df


#: Array column of the raw catalogue -> (column of its first value, column of all).
ARRAYS = {
    "websites": ("website", "websites_all"),
    "phones": ("phone", "phones_all"),
    "emails": ("email", None),
    "socials": (None, "socials"),
    "category_alt": (None, "alt_categories"),
}


def flatten_arrays(df: DataFrame) -> DataFrame:
    """First value of an array (null if empty) and all values joined by `|`."""
    for array, (first, every) in ARRAYS.items():
        if array not in df.columns:
            continue
        values = F.col(array)
        new = {}
        if first:
            new[first] = F.get(values, F.lit(0))
        if every:
            new[every] = F.array_join(values, "|")
        df = df.withColumns(new)
        if every != array:
            df = df.drop(array)
    return df


def drop_non_business(df: DataFrame, keep_null: bool = True, category: str = "category") -> DataFrame:
    """Rows without a category are kept or dropped as asked."""
    keep = ~F.col(category).isin(*V.NON_BUSINESS)
    return df.filter(F.col(category).isNull() | keep) if keep_null else df.filter(keep)


def drop_branded(df: DataFrame, keep_chains: bool) -> DataFrame:
    return df if keep_chains else df.filter(F.coalesce(F.length("brand"), F.lit(0)) == 0)


def flag_franchise(df: DataFrame) -> DataFrame:
    """Label branded offices instead of dropping them."""
    return df.withColumn("is_franchise", F.coalesce(F.length("brand") > 0, F.lit(False)))


def name_counts(df: DataFrame, name: str = "name") -> DataFrame:
    return df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def join_name_counts(df: DataFrame, name: str = "name") -> DataFrame:
    """Each row with n, how often its name occurs; null for a row without a name. Counts
    are pre-aggregated and cut off, so that the join has a plain exchange on either side
    and Spark can split a very common name's rows."""
    return df.join(cut(name_counts(df, name)), name, "left")


def flag_chains(df: DataFrame, threshold: int = V.CHAIN_THRESHOLD) -> DataFrame:
    """is_chain: a brand is given, or the exact name occurs ``threshold`` times or more.
    Only the frequent names are joined, of which there are at most rows / threshold and
    as a rule very few: Spark broadcasts them once it knows their size. Where they are too
    many, the hash beside the name asks for an exchange of its own above the aggregate, so
    that both sides have a plain one and Spark can split a very common name's rows."""
    frequent = name_counts(df).filter(F.col("n") >= threshold).select("name", F.xxhash64("name").alias("_hash"), F.lit(True).alias("_often"))
    branded = F.coalesce(F.length("brand") > 0, F.lit(False))
    found = df.withColumn("_hash", F.xxhash64("name")).join(frequent, ["name", "_hash"], "left")
    return found.withColumn("is_chain", branded | F.coalesce("_often", F.lit(False))).select(*df.columns, "is_chain")


def exclusion_counts(flagged: DataFrame) -> DataFrame:
    """One row: chains dropped, and non-chain rows that are no business."""
    other = F.coalesce(F.col("category").isin(*V.NON_BUSINESS), F.lit(False))
    return flagged.agg(
        F.count(F.when(F.col("is_chain"), 1)).alias("chains_dropped"),
        F.count(F.when(~F.col("is_chain") & other, 1)).alias("non_business_dropped"),
    )


def clean_catalogue(flat: DataFrame, threshold: int = V.CHAIN_THRESHOLD) -> DataFrame:
    """Named rows that are neither chains nor non-businesses, with the first tier."""
    kept = drop_non_business(flag_chains(flat.filter("name is not null"), threshold).filter("not is_chain"))
    return kept.withColumns({"is_chain": F.lit(0), "tier": scoring.tier_v1("website"), "tier_reason": scoring.tier_v1_reason("website")})


def build_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("tier").asc_nulls_last(), F.col("city").asc_nulls_last(), F.col("name").asc_nulls_last(), "id")


def limit_source(df: DataFrame, n: int) -> DataFrame:
    """The first n by id, so that a limit always takes the same rows."""
    return df.orderBy("id").limit(n)


def weak_url(df: DataFrame, domains: Iterable[str] = V.WEAK_DOMAINS, url: str = "website") -> DataFrame:
    found = weak_domain(url, domains)
    return df.withColumns({"is_weak": found.isNotNull(), "matched": F.coalesce(found, F.lit(""))})


def weak_url_like(df: DataFrame, patterns: Iterable[str] = V.WEAK_SUBSTRINGS, url: str = "website") -> DataFrame:
    return df.withColumn("is_weak", weak_substring(url, patterns))


#: Levels of the cells below: those of level k are 360 / 2 ** k degrees wide.
FINEST = 22
#: A box is covered by cells of at most this part of its longer side.
PARTS = 8


def _cell(degrees: Column, level: Column) -> Column:
    """Number of the cell of a level in which a longitude or latitude lies."""
    return F.floor((degrees + 180) * F.pow(F.lit(2.0), level) / 360).cast("long")


def cover(markets: DataFrame) -> DataFrame:
    """``markets`` with _level, _y and _x of each cell that touches the box. The level goes
    by the longer side, so a box of any size has some hundred cells at most; boxes without
    a bound or turned over have none."""
    side = F.greatest(F.col("north") - F.col("south"), F.col("east") - F.col("west"))
    level = F.when(side > 0, F.ceil(F.log2(360 * PARTS / side))).otherwise(FINEST)
    placed = markets.filter("south <= north AND west <= east").withColumn("_level", F.greatest(F.lit(0), F.least(F.lit(FINEST), level)).cast("int"))
    cells = lambda low, high: F.explode(F.sequence(_cell(F.col(low), F.col("_level")), _cell(F.col(high), F.col("_level"))))
    return placed.withColumn("_y", cells("south", "north")).withColumn("_x", cells("west", "east"))


def assign_market(places: DataFrame, markets: DataFrame) -> DataFrame:
    """Rows with each market (market, south, west, north, east) whose box holds them.

    Boxes overlap, so a row may come back more than once. Points and boxes meet in the
    cells of the levels that boxes need, of which there are FINEST at most: an equi-join,
    whatever the number and the sizes of the boxes. Boxes are not aggregated, so Spark can
    split the points of a crowded cell. A row without a place is in no market.
    """
    boxes = cover(markets)
    levels = sorted(r[0] for r in boxes.select("_level").distinct().collect())
    points = places.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    points = points.withColumns({"_y": _cell(F.col("lat"), F.col("_level")), "_x": _cell(F.col("lon"), F.col("_level"))})
    inside = F.col("lat").between(F.col("south"), F.col("north")) & F.col("lon").between(F.col("west"), F.col("east"))
    return points.join(boxes, ["_level", "_y", "_x"]).filter(inside).drop("_level", "_y", "_x", "south", "west", "north", "east")


def office_counts(df: DataFrame, key: str = "name_key") -> DataFrame:
    """Each row with offices, how many rows share its key; null for a row without a key.
    Counts are cut off as for names."""
    counts = cut(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("offices")))
    return df.join(counts, key, "left")


def fill_in(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Trim the columns; empty text becomes null."""
    return df.withColumns({c: F.when(present(c), F.trim(c)) for c in columns})


def rank_rows(df: DataFrame, *order, name: str = "rank", head: int | None = None) -> DataFrame:
    """1..n in an order that must be total.

    Rows are range-partitioned by the order, sorted within partitions and numbered by
    their places there. That table is stored once, so that counts and numbers come from
    one partitioning; the offset of each partition is the sum of the earlier counts, a
    table of one row a partition. With ``head`` only the first rows are needed, which a
    top-k takes without a sort.
    """
    if head is not None:
        top = df.orderBy(*order).limit(head)
        return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    # the upper bits are the partition, the lower 33 the place in it
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(before), "_part")  # one row a partition
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_at", "_before")
