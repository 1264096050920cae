"""Readers that bring outside data into the tables of the library."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.columns import any_of, filled, name_key

# Release taken where no path names one.
FALLBACK_RELEASE = "2026-05-20.0"

#: Fields of a lead file: id and name are required.
LEAD_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "name", "category", "website", "phone", "email", "socials", "address", "city", "state", "zip", "brand", "source_dataset", "source_id")]
    + [T.StructField(c, T.DoubleType()) for c in ("confidence", "lat", "lon")]
)


def read_places(raw: DataFrame, bbox: tuple[float, float, float, float], categories: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
    """Nested place records -> flat leads: those in (south, west, north, east) with a
    name and, if asked, a category that contains one of the words. Bounds and name reach
    the Parquet scan, which reads only the nested fields that are named here."""
    south, west, north, east = bbox
    df = raw.filter(F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north) & F.col("names.primary").isNotNull())
    if categories:
        df = df.filter(any_of(F.contains(F.lower("categories.primary"), F.lit(c.lower())) for c in categories))
    first = lambda c: F.get(F.col(c), F.lit(0))
    address = first("addresses")
    out = df.select(
        "id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"),
        first("websites").alias("website"), first("phones").alias("phone"), first("emails").alias("email"),
        address["freeform"].alias("address"), address["locality"].alias("city"), address["region"].alias("state"), address["postcode"].alias("zip"),
        F.col("brand.names.primary").alias("brand"), F.col("bbox.xmin").alias("lon"), F.col("bbox.ymin").alias("lat"),
        F.lit("overture").alias("source"), F.lit("").alias("source_url"),
    )
    return out.orderBy("id").limit(limit) if limit else out


def pull_region(raw: DataFrame, bbox: tuple[float, float, float, float]) -> DataFrame:
    """Every record in the box with its arrays, 19 columns."""
    south, west, north, east = bbox
    address, source = F.get("addresses", F.lit(0)), F.get("sources", F.lit(0))
    return raw.filter(F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north)).select(
        "id", F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), F.col("categories.alternate").alias("category_alt"),
        "confidence", "websites", "socials", "emails", "phones", F.col("brand.names.primary").alias("brand"),
        address["freeform"].alias("address"), address["locality"].alias("city"), address["region"].alias("state"), address["postcode"].alias("zip"), address["country"].alias("country"),
        F.col("bbox.xmin").alias("lon"), F.col("bbox.ymin").alias("lat"), source["dataset"].alias("source_dataset"), source["record_id"].alias("source_id"),
    )


def latest_release(paths: DataFrame, fallback: str = FALLBACK_RELEASE, path: str = "path") -> DataFrame:
    """One row: the newest release token in paths like .../release/<token>/..."""
    token = F.nullif(F.regexp_extract(path, "release/([^/]+)/", 1), F.lit(""))
    return paths.agg(F.coalesce(F.max(token), F.lit(fallback)).alias("release"))


_OSM_TAGS = ("website", "phone", "email")


def _tag(key: str):
    return F.nullif(F.try_element_at("tags", F.lit(key)), F.lit(""))


def _osm_columns():
    name = F.coalesce(_tag("name"), _tag("operator"))
    contact = {k: F.trim(F.coalesce(_tag(k), _tag(f"contact:{k}"), F.lit(""))) for k in _OSM_TAGS}
    line = F.concat_ws(" ", _tag("addr:housenumber"), _tag("addr:street"))
    return name, contact, line


def match_tags(elements: DataFrame, tags: Iterable[str]) -> DataFrame:
    """Elements with any `key=value`; filters without `=` are ignored."""
    pairs = [t.split("=", 1) for t in tags if "=" in t]
    return elements.filter(any_of(F.coalesce(F.try_element_at("tags", F.lit(k)) == v, F.lit(False)) for k, v in pairs))


def read_osm(elements: DataFrame, osm_tags: Iterable[str]) -> DataFrame:
    """Map elements (type, id, lat, lon, center, tags) -> flat leads. Unnamed ones go;
    the category is the first well-formed filter of the profile."""
    name, contact, line = _osm_columns()
    category = next((t for t in osm_tags if "=" in t), "")
    text = lambda k: F.coalesce(_tag(k), F.lit(""))
    return elements.filter(name.isNotNull()).select(
        F.trim(name).alias("name"), F.lit(category).alias("category"), *[c.alias(k) for k, c in contact.items()],
        F.concat_ws(", ", F.nullif(line, F.lit("")), _tag("addr:city")).alias("address"),
        text("addr:city").alias("city"), text("addr:state").alias("state"), text("addr:postcode").alias("zip"), text("brand").alias("brand"),
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
        F.lit("osm").alias("source"), F.concat(F.lit("https://www.openstreetmap.org/"), F.col("type"), F.lit("/"), F.col("id").cast("string")).alias("source_url"),
    )


def read_osm_niches(elements: DataFrame, niches: DataFrame) -> DataFrame:
    """Independent named elements with the niche of one of their tags; ``niches`` is
    (tag, value, niche). An element with tags of several niches comes back for each."""
    name, contact, line = _osm_columns()
    tail = F.nullif(F.trim(F.concat_ws(" ", _tag("addr:state"), _tag("addr:postcode"))), F.lit(""))
    own = elements.filter(name.isNotNull() & _tag("brand").isNull() & _tag("brand:wikidata").isNull())
    each = own.withColumns({"_name": F.trim(name), "_line": line, "_tail": tail, **{f"_{k}": c for k, c in contact.items()}, "_city": _tag("addr:city")})
    each = each.select("*", F.explode("tags").alias("tag", "value")).join(niches, ["tag", "value"])
    return each.select(
        F.concat(F.substring("type", 1, 1), F.col("id").cast("string")).alias("slug"), F.col("_name").alias("name"), F.col("_website").alias("website"), F.col("_phone").alias("phone"),
        F.concat_ws(", ", F.nullif("_line", F.lit("")), "_city", "_tail").alias("address"), F.coalesce("_city", F.lit("")).alias("city"), "niche",
        F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"),
    ).distinct()


def accept_leads(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads, rejects): text trimmed, '' as null; rows without id or name are rejected."""
    clean = rows.withColumns({c: filled(c) for c, t in rows.dtypes if t == "string"})
    ok = F.col("id").isNotNull() & F.col("name").isNotNull()
    return clean.filter(ok), clean.filter(~ok)


def read_leads(spark: SparkSession, path: str, schema: T.StructType = LEAD_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """accept_leads() of a CSV file with a header, or of JSON lines."""
    if path.rstrip("/").endswith((".json", ".jsonl", ".ndjson")):
        rows = spark.read.schema(schema).json(path)
    else:
        rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
        rows = rows.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
    return accept_leads(rows)


def county_of(path: str = "path"):
    """County named by a file like napa_leads_full.csv, or by such a folder of files."""
    return F.initcap(F.replace(F.regexp_extract(path, r"([a-z_]+)_leads_full\.[a-z]+(?:/[^/]*)?$", 1), F.lit("_"), F.lit(" ")))


def _headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """{first line: files that begin with it}, from the first block of each file alone."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    # one row a file; Spark's driver lists the files anyway
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file_path")).alias("files")).orderBy("header")
    return {r.header.lstrip("\ufeff"): r.files for r in found.collect()}


def read_by_header(spark: SparkSession, paths: str | list[str], columns: Iterable[str] | None = None) -> DataFrame:
    """CSV files whose columns may differ in number and order, with a column ``file``.

    Files with one header are one scan, and the scans are united by name, so each value
    stands under the name that its own file gives it. ``columns`` picks names; without it
    all names come back in the order in which headers, sorted, give them. Names that differ
    in case alone are one. A missing column or value is ''; of a name that a header has
    twice the last column counts; values may hold line breaks, commas and quotes in quotes.
    Files without a line give no rows. A header with a line break in quotes is an error.
    """
    parts, names = [], {c.lower(): c for c in columns or ()}
    for header, files in _headers(spark, paths).items():
        if header.count('"') % 2:
            raise ValueError(f"the header of {files[0]} has a line break in quotes")
        have = next(csv.reader([header]), [])
        if columns is None:
            for c in have:
                names.setdefault(c.lower(), c)
        schema = T.StructType([T.StructField(f"_{k}", T.StringType()) for k in range(max(1, len(have)))])
        rows = spark.read.schema(schema).csv([unquote(f) for f in files], header=True, escape='"', multiLine=True)
        place = {c.lower(): f"_{k}" for k, c in enumerate(have)}  # the last of a name stays
        parts.append(rows.select(F.col("_metadata.file_path").alias("file"), *[F.coalesce(F.col(i), F.lit("")).alias(f"_{c}") for c, i in place.items()]))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in ("file", *names.values())]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    have = set(out.columns)
    return out.select(F.col("file"), *[F.coalesce(F.col(f"`_{k}`"), F.lit("")).alias(c) if f"_{k}" in have else F.lit("").alias(c) for k, c in names.items()])


def read_counties(spark: SparkSession, paths: str | list[str], columns: Iterable[str] | None = None) -> DataFrame:
    """Lead files of several counties, with duplicates, each row with its county; columns as
    read_by_header() gives them."""
    rows = read_by_header(spark, paths, columns)
    return rows.withColumn("county", county_of("file")).drop("file")


def read_export(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """First non-empty of several header spellings for each field; headers regardless of
    case; a field without any of its headers is ''."""
    have = {c.lower().strip(): c for c in df.columns}
    value = lambda names: F.coalesce(*[F.nullif(F.col(f"`{have[n.lower()]}`").cast("string"), F.lit("")) for n in names if n.lower() in have], F.lit(""))
    return df.select(*[value(names).alias(field) for field, names in aliases.items()])


def read_crm_names(df: DataFrame) -> DataFrame:
    """(name_key) of a client export: from the leftmost column with a known header, else
    from the first column."""
    pick = next((c for c in df.columns if c.strip().lower() in V.CRM_NAME_HEADERS), df.columns[0])
    return df.select(name_key(F.col(f"`{pick}`")).alias("name_key")).filter("name_key <> ''").distinct()


_LISTING = "name string, businessUrl string, url string, phone string, telephone string, address string, location string"
_ADDRESS = "streetAddress string, addressLocality string, addressRegion string"


def normalize_listings(df: DataFrame, column: str = "json", site: str = "https://www.yelp.com") -> DataFrame:
    """JSON objects of a directory -> name, url, phone, address."""
    j = F.from_json(column, _LISTING)
    some = lambda *names: F.coalesce(*[F.nullif(j[n], F.lit("")) for n in names], F.lit(""))
    raw = some("address", "location")
    parts = F.from_json(raw, _ADDRESS)
    joined = F.concat_ws(", ", *[F.nullif(parts[n], F.lit("")) for n in ("streetAddress", "addressLocality", "addressRegion")])
    url = some("businessUrl", "url")
    return df.select(
        F.trim(F.coalesce(j["name"], F.lit(""))).alias("name"),
        F.when((url != "") & ~url.startswith("http"), F.concat(F.lit(site), url)).otherwise(url).alias("url"),
        some("phone", "telephone").alias("phone"),
        F.when(raw.startswith("{"), joined).otherwise(raw).alias("address"),
    )


#: Fields of a captured page.
CRAWL_SCHEMA = "lead_id string, page_ord bigint, url string, final_url string, status int, load_ms int, html string"


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: one row a fetched page. A field that the files lack is null."""
    return spark.read.schema(CRAWL_SCHEMA).parquet(path)


_PAGESPEED = T.StructType(
    [
        T.StructField("lighthouseResult", T.StructType([
            T.StructField("categories", T.StructType([T.StructField("performance", T.StructType([T.StructField("score", T.DoubleType())]))])),
            T.StructField("audits", T.MapType(T.StringType(), T.StructType([
                T.StructField("score", T.DoubleType()), T.StructField("title", T.StringType()),
                T.StructField("details", T.StructType([
                    T.StructField("type", T.StringType()), T.StructField("overallSavingsMs", T.DoubleType()),
                    T.StructField("items", T.ArrayType(T.StructType([T.StructField(k, T.DoubleType()) for k in ("largestContentfulPaint", "firstContentfulPaint", "totalBlockingTime", "cumulativeLayoutShift")]))),
                ])),
            ]))),
        ])),
    ]
)


def flatten_pagespeed(df: DataFrame, column: str = "json") -> DataFrame:
    """PageSpeed responses -> site_score (truncated), four paint times and the four
    opportunities that save most."""
    r = F.from_json(column, _PAGESPEED)["lighthouseResult"]
    audits = r["audits"]
    m = F.get(F.try_element_at(audits, F.lit("metrics"))["details"]["items"], F.lit(0))
    seconds = lambda k: F.when(F.coalesce(m[k], F.lit(0.0)) != 0, F.concat(F.bround(m[k] / 1000, 1).cast("string"), F.lit("s"))).otherwise("")
    open_ = F.filter(F.map_values(audits), lambda a: (a["score"] < 0.9) & (a["details"]["type"] == "opportunity") & (F.length(a["title"]) > 0))
    best = F.slice(F.sort_array(F.transform(open_, lambda a: F.struct(F.coalesce(a["details"]["overallSavingsMs"], F.lit(0.0)).alias("s"), a["title"].alias("t"))), asc=False), 1, 4)
    return df.select(
        *[c for c in df.columns if c != column],
        (r["categories"]["performance"]["score"] * 100).cast("int").alias("site_score"),
        seconds("largestContentfulPaint").alias("lcp"), seconds("firstContentfulPaint").alias("fcp"), seconds("totalBlockingTime").alias("tbt"),
        F.coalesce(m["cumulativeLayoutShift"].cast("string"), F.lit("")).alias("cls"),
        F.coalesce(F.array_join(F.transform(best, lambda x: x["t"]), " | "), F.lit("")).alias("opportunities"),
    )
