"""Queries over the catalogue: sources, cleaning, scalar rules, dedupe, joins, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scoring as S
from ..functions import values as V
from ..operators import aggregates as A
from ..operators import catalogue, dedupe, enrich, joins
from ..operators.shared import fresh_path
from ..sources import readers
from . import oracle as O
from .profiles import union_sources
from .registry import Tables, query

BOX = (38.0, -123.8, 39.5, -122.2)
IN_BOX = "lon BETWEEN -123.8 AND -122.2 AND lat BETWEEN 38.0 AND 39.5"


def raw_places(t: Tables) -> DataFrame:
    """The catalogue in the nested shape of a place snapshot."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(F.array().cast("array<string>"))
    return t.places.select(
        "id", F.struct(F.col("name").alias("primary")).alias("names"),
        F.struct(F.col("category").alias("primary"), F.array(F.lit("shop"), F.col("source")).alias("alternate")).alias("categories"), "confidence",
        F.array_compact(F.array("website", F.when(F.col("seq") % 2 == 0, F.lit("https://second.example")))).alias("websites"),
        F.when(F.col("socials").isNotNull(), F.split("socials", r"\|")).alias("socials"), one("email").alias("emails"), one("phone").alias("phones"),
        F.struct(F.struct(F.col("brand").alias("primary")).alias("names")).alias("brand"),
        F.array(F.struct(F.col("address").alias("freeform"), F.col("city").alias("locality"), F.col("state").alias("region"), F.lit("95401").alias("postcode"), F.lit("US").alias("country"))).alias("addresses"),
        F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin")).alias("bbox"),
        F.array(F.struct(F.col("source").alias("dataset"), F.col("id").alias("record_id"))).alias("sources"),
    )


@query(f"""SELECT id, name, category, coalesce(website, CASE WHEN seq % 2 = 0 THEN 'https://second.example' END) AS website, phone, email, address, city, state, '95401' AS zip, brand, lon, lat,
 'overture' AS source, '' AS source_url FROM places_v WHERE {IN_BOX} AND name IS NOT NULL AND (contains(lower(category), 'rest') OR contains(lower(category), 'salon'))""")
def places_scan(t: Tables) -> DataFrame:
    return readers.read_places(raw_places(t), BOX, ["rest", "Salon"])


@query(f"""SELECT id, name, category, 'shop|' || source AS category_alt, confidence,
 array_to_string(list_filter([website, CASE WHEN seq % 2 = 0 THEN 'https://second.example' END], lambda x: x IS NOT NULL), '|') AS websites, socials,
 coalesce(email, '') AS emails, coalesce(phone, '') AS phones, brand, address, city, state, '95401' AS zip, 'US' AS country, lon, lat, source AS source_dataset, id AS source_id
 FROM places_v WHERE {IN_BOX}""")
def region_pull(t: Tables) -> DataFrame:
    df = readers.pull_region(raw_places(t), BOX)
    return df.withColumns({c: F.array_join(c, "|") for c in ("category_alt", "websites", "socials", "emails", "phones")})


@query("SELECT max('2024-' || lpad(cast(extract(month FROM ts) AS varchar), 2, '0') || '-' || lpad(cast(extract(day FROM ts) AS varchar), 2, '0')) AS release FROM events")
def latest_release(t: Tables) -> DataFrame:
    paths = t.read("events").select(F.concat(F.lit("s/release/"), F.date_format("ts", "yyyy-MM-dd"), F.lit("/theme=places/part-0")).alias("path"))
    return readers.latest_release(paths)


def elements(t: Tables) -> DataFrame:
    """The catalogue as map elements."""
    tags = {"name": "name", "contact:phone": "phone", "website": "website", "addr:city": "city", "addr:street": "address"}
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("k"), F.col(c).alias("v"))) for k, c in tags.items()]
    kind = F.when(F.col("seq") % 2 == 0, F.lit("plumber")).otherwise(F.lit("roofer"))
    extra = [F.struct(F.lit("craft").alias("k"), kind.alias("v")), F.when((F.col("seq") % 17 == 0) & F.col("brand").isNotNull(), F.struct(F.lit("brand").alias("k"), F.col("brand").alias("v")))]
    return t.places.select(
        F.lit("node").alias("type"), F.col("seq").alias("id"), F.when(F.col("seq") % 3 > 0, F.col("lat")).alias("lat"), F.when(F.col("seq") % 3 > 0, F.col("lon")).alias("lon"),
        F.struct("lat", "lon").alias("center"), F.map_from_entries(F.array_compact(F.array(*pairs, *extra))).alias("tags"),
    )


@query("""SELECT trim(name) AS name, 'craft=plumber' AS category, trim(coalesce(website, '')) AS website, trim(coalesce(phone, '')) AS phone, '' AS email,
 concat_ws(', ', nullif(address, ''), nullif(city, '')) AS address, coalesce(city, '') AS city, '' AS state, '' AS zip, CASE WHEN seq % 17 = 0 THEN coalesce(brand, '') ELSE '' END AS brand, lat, lon,
 'osm' AS source, 'https://www.openstreetmap.org/node/' || seq AS source_url FROM places_v""")
def osm_normalise(t: Tables) -> DataFrame:
    return readers.read_osm(elements(t), ["nofilter", "craft=plumber"])


@query("""SELECT 'n' || seq AS slug, trim(name) AS name, trim(coalesce(website, '')) AS website, trim(coalesce(phone, '')) AS phone, concat_ws(', ', nullif(address, ''), nullif(city, '')) AS address,
 coalesce(city, '') AS city, CASE WHEN seq % 2 = 0 THEN 'Plumbers' ELSE 'Roofers' END AS niche, lat, lon FROM places_v WHERE NOT (seq % 17 = 0)""")
def osm_niches(t: Tables) -> DataFrame:
    niches = t.spark.createDataFrame([("craft", "plumber", "Plumbers"), ("craft", "roofer", "Roofers")], "tag string, value string, niche string")
    return readers.read_osm_niches(elements(t), niches)


@query("SELECT seq AS id FROM places_v WHERE seq % 2 = 0 OR city = 'FRANCE'")
def osm_tag_match(t: Tables) -> DataFrame:
    return readers.match_tags(elements(t), ["craft=plumber", "addr:city=FRANCE", "broken"]).select("id")


@query("SELECT id, trim(name) AS name, nullif(trim(website), '') AS website, nullif(trim(email), '') AS email FROM places_v WHERE seq % 29 <> 0")
def lead_contract(t: Tables) -> DataFrame:
    rows = t.places.select("id", F.when(F.col("seq") % 29 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "name")).alias("name"), "website", "email")
    return readers.accept_leads(rows)[0]


@query("SELECT id, state AS county_file, 'Santa ' || array_to_string(list_transform(string_split(lower(state), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS county FROM places_v")
def county_union(t: Tables) -> DataFrame:
    name = F.replace(F.lower("state"), F.lit(" "), F.lit("_"))
    rows = t.places.select("id", F.col("state").alias("county_file"), F.concat(F.lit("x/santa_"), name, F.lit("_leads_full.csv")).alias("path"))
    return rows.select("id", "county_file", readers.county_of("path").alias("county"))


@query("SELECT id, state AS county_file, 'Santa ' || array_to_string(list_transform(string_split(lower(state), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS county FROM places_v")
def county_union_all(t: Tables) -> DataFrame:
    """The same from files: one folder of files a state, read together."""
    base = fresh_path(t.spark, "counties")
    rows = t.places.select("id", F.col("state").alias("county_file"))
    for r in t.read("region").select("r_name").distinct().collect():  # a handful
        name = r[0].lower().replace(" ", "_")
        rows.filter(F.col("county_file") == r[0]).write.option("header", True).csv(f"{base}/santa_{name}_leads_full.csv")
    return readers.read_counties(t.spark, f"{base}/*_leads_full.csv", ("id", "county_file"))


@query("""SELECT id, name, nullif(website, '') AS website, 'Santa ' || array_to_string(list_transform(string_split(lower(state), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS county FROM places_v
 UNION ALL SELECT id, name, nullif(website, ''), 'North' FROM places_v WHERE seq % 5 = 0""")
def county_files(t: Tables) -> DataFrame:
    """Lead files of each state, and of one more county that shares rows with them."""
    base = fresh_path(t.spark, "counties")
    rows = t.places.select("id", F.coalesce("name", F.lit("")).alias("name"), "website", "state", "seq")
    states = [r.state for r in t.read("region").select(F.col("r_name").alias("state")).distinct().collect()]  # a handful
    parts = {f"santa_{s.lower().replace(' ', '_')}": rows.filter(F.col("state") == s) for s in states} | {"north": rows.filter("seq % 5 = 0")}
    paths = [f"{base}/{name}_leads_full.csv" for name in parts]
    for path, part in zip(paths, parts.values(), strict=True):
        part.select("id", "name", "website").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_counties(t.spark, paths).select("id", "name", F.nullif("website", F.lit("")).alias("website"), "county")


@query("SELECT coalesce(nullif(name, ''), '') AS name, coalesce(nullif(category, ''), '') AS category, coalesce(nullif(website, ''), '') AS website, '' AS phone FROM places_v")
def alias_headers(t: Tables) -> DataFrame:
    rows = t.places.select(F.col("name").alias("Business"), F.col("category").alias("Niche"), F.col("website").alias("WebSite"))
    return readers.read_export(rows, {"name": ("Business", "name"), "category": ("Niche", "category"), "website": ("Website", "website"), "phone": ("Phone",)})


@query(f"SELECT DISTINCT {O.name_key('name')} AS name_key FROM places_v WHERE {O.name_key('name')} <> ''")
def crm_name_list(t: Tables) -> DataFrame:
    return readers.read_crm_names(t.places.select(F.col("city").alias("Town"), F.col("name").alias("Account Name"), F.col("category").alias("Name")))


@query(f"SELECT * FROM places_v WHERE {IN_BOX}")
def bbox_filter(t: Tables) -> DataFrame:
    return catalogue.in_bbox(t.places, *BOX)


@query("SELECT id, category FROM places_v WHERE contains(lower(category), 'rest') OR contains(lower(category), 'union')")
def category_filter(t: Tables) -> DataFrame:
    return catalogue.category_any(t.places, ["REST", "union"]).select("id", "category")


@query("SELECT id, name, website FROM places_v WHERE contains(lower(category), 'plumb') AND contains(lower(city), 'a') ORDER BY coalesce(website, '') = '' DESC, name, id LIMIT 25")
def niche_city_filter(t: Tables) -> DataFrame:
    return catalogue.filter_niche_city(t.places, "plumb", "a", 25).select("id", "name", "website")


@query("""SELECT id, coalesce(website, CASE WHEN seq % 2 = 0 THEN 'https://second.example' END) AS website,
 array_to_string(list_filter([website, CASE WHEN seq % 2 = 0 THEN 'https://second.example' END], lambda x: x IS NOT NULL), '|') AS websites_all,
 phone, coalesce(phone, '') AS phones_all, email, socials, 'shop|' || source AS alt_categories FROM places_v""")
def array_flatten(t: Tables) -> DataFrame:
    raw = raw_places(t).select("id", "websites", "phones", "emails", "socials", F.col("categories.alternate").alias("category_alt"))
    return catalogue.flatten_arrays(raw)


@query(f"SELECT id, category FROM places_v WHERE category IS NULL OR category NOT IN {O.in_list(V.NON_BUSINESS)}")
def non_business_keep_null(t: Tables) -> DataFrame:
    return catalogue.drop_non_business(t.places, True).select("id", "category")


@query(f"SELECT id, category FROM places_v WHERE category NOT IN {O.in_list(V.NON_BUSINESS)}")
def non_business_drop_null(t: Tables) -> DataFrame:
    return catalogue.drop_non_business(t.places, False).select("id", "category")


@query("SELECT id, brand FROM places_v WHERE coalesce(brand, '') = ''")
def branded_drop(t: Tables) -> DataFrame:
    return catalogue.drop_branded(t.places, False).select("id", "brand")


@query("SELECT id, brand, coalesce(brand, '') <> '' AS is_franchise FROM places_v")
def franchise_label(t: Tables) -> DataFrame:
    return catalogue.flag_franchise(t.places).select("id", "brand", "is_franchise")


@query("SELECT id, name, is_chain FROM flagged_v")
def chain_flag(t: Tables) -> DataFrame:
    return t.flagged.select("id", "name", "is_chain")


@query(f"""SELECT count(*) FILTER (WHERE is_chain) AS chains_dropped, count(*) FILTER (WHERE NOT is_chain AND category IN {O.in_list(V.NON_BUSINESS)}) AS non_business_dropped FROM flagged_v""")
def exclusion_counts(t: Tables) -> DataFrame:
    return catalogue.exclusion_counts(t.flagged)


@query("SELECT name, count(*) AS n FROM places_v WHERE name IS NOT NULL GROUP BY name")
def name_frequency(t: Tables) -> DataFrame:
    return catalogue.name_counts(t.places)


@query("SELECT p_name AS name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name")
def part_name_frequency(t: Tables) -> DataFrame:
    return catalogue.name_counts(t.read("part").withColumnRenamed("p_name", "name"))


@query("SELECT p.id, p.name, n.n FROM places_v p JOIN (SELECT name, count(*) AS n FROM places_v GROUP BY name) n ON p.name = n.name")
def name_count_join(t: Tables) -> DataFrame:
    return catalogue.join_name_counts(t.places).select("id", "name", "n")


@query("SELECT id, name, category, website, tier, tier_reason, is_chain FROM clean_v")
def clean_catalogue(t: Tables) -> DataFrame:
    return t.clean.select("id", "name", "category", "website", "tier", "tier_reason", "is_chain")


@query("SELECT id, tier, city, name FROM clean_v ORDER BY tier NULLS LAST, city NULLS LAST, name NULLS LAST, id LIMIT 100")
def build_order(t: Tables) -> DataFrame:
    return catalogue.build_sort(t.clean).limit(100).select("id", "tier", "city", "name")


@query("SELECT id, name FROM places_v ORDER BY id LIMIT 50")
def source_limit(t: Tables) -> DataFrame:
    return catalogue.limit_source(t.places, 50).select("id", "name")


@query(f"SELECT id, website, {O.weak_domain('website')} IS NOT NULL AS is_weak, coalesce({O.weak_domain('website')}, '') AS matched FROM places_v")
def weak_url(t: Tables) -> DataFrame:
    return catalogue.weak_url(t.places).select("id", "website", "is_weak", "matched")


@query(f"SELECT id, coalesce({O.has_any('lower(website)', V.WEAK_SUBSTRINGS)}, false) AS is_weak FROM places_v")
def weak_url_substring(t: Tables) -> DataFrame:
    return catalogue.weak_url_like(t.places).select("id", "is_weak")


@query(f"""SELECT id, {O.host('website')} AS host, CASE WHEN website IS NULL THEN '' ELSE {O.site_host('website')} END AS site_host,
 CASE WHEN website IS NULL THEN '' ELSE {O.registrable(O.site_host('website'))} END AS registrable FROM places_v""")
def hosts(t: Tables) -> DataFrame:
    return t.places.select("id", C.host("website").alias("host"), C.site_host("website").alias("site_host"), C.registrable(C.site_host("website")).alias("registrable"))


@query(f"""SELECT id, {O.name_key('name')} AS name_key, {O.name_key_plain('name')} AS name_key_plain,
 array_to_string(list_filter(string_split_regex(lower(coalesce(name, '')), '[^a-z0-9]+'), lambda x: length(x) > 2), ' ') AS name_tokens FROM places_v""")
def name_keys(t: Tables) -> DataFrame:
    return t.places.select("id", C.name_key("name").alias("name_key"), C.name_key_plain("name").alias("name_key_plain"), F.array_join(C.name_tokens("name"), " ").alias("name_tokens"))


@query("SELECT id, phone, phone_fmt, area_code FROM enriched_v")
def phone_format(t: Tables) -> DataFrame:
    return t.leads.select("id", "phone", "phone_fmt", "area_code")


@query("SELECT id, socials, social_platforms FROM enriched_v")
def social_platforms(t: Tables) -> DataFrame:
    return t.leads.select("id", "socials", "social_platforms")


@query("SELECT id, email, website, email_owned FROM enriched_v")
def email_owned(t: Tables) -> DataFrame:
    return t.leads.select("id", "email", "website", "email_owned")


@query("SELECT id, best_contact, completeness FROM leads_v")
def contact_and_completeness(t: Tables) -> DataFrame:
    return t.leads.select("id", "best_contact", "completeness")


@query("SELECT id, website, tier, tier_reason, builder FROM enriched_v")
def tier_second_rule(t: Tables) -> DataFrame:
    return t.leads.select("id", "website", "tier", "tier_reason", "builder")


@query("SELECT id, score, industry_fit, outreach_score, why_warm FROM leads_v")
def lead_scores(t: Tables) -> DataFrame:
    return t.leads.select("id", "score", "industry_fit", "outreach_score", "why_warm")


@query("SELECT id, tier, tier_reason, builder, score, phone_fmt, area_code, social_platforms, email_owned, completeness, best_contact, pitch FROM leads_v")
def offline_enrichment(t: Tables) -> DataFrame:
    return enrich.enrich_offline(t.clean).select("id", "tier", "tier_reason", "builder", "score", "phone_fmt", "area_code", "social_platforms", "email_owned", "completeness", "best_contact", "pitch")


@query("SELECT id, category, outreach_score, industry_fit FROM warm_v")
def call_scoring(t: Tables) -> DataFrame:
    from ..operators.serving import callable_warm

    return callable_warm(enrich.score_calls(enrich.enrich_offline(t.clean))).select("id", "category", "outreach_score", "industry_fit")


@query(f"""SELECT id, e, coalesce(regexp_matches(e, '^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{{2,}}$')
 AND NOT ({' OR '.join(f"starts_with(lower(e), {O.lit(p)})" for p in V.JUNK_PREFIXES)}) AND string_split(e, '@')[-1] NOT IN {O.in_list(V.JUNK_DOMAINS)}, false) AS good
 FROM (SELECT id, CASE seq % 6 WHEN 0 THEN 'noreply@' || seq || '.com' WHEN 1 THEN 'a@example.com' WHEN 2 THEN 'bad@x' ELSE email END AS e FROM places_v)""")
def email_acceptability(t: Tables) -> DataFrame:
    seq = F.col("seq")
    e = F.when(seq % 6 == 0, F.concat(F.lit("noreply@"), seq.cast("string"), F.lit(".com"))).when(seq % 6 == 1, "a@example.com").when(seq % 6 == 2, "bad@x").otherwise(F.col("email"))
    return t.places.select("id", e.alias("e")).withColumn("good", C.good_email("e"))


@query("SELECT id, substr(sha256(concat_ws('|', lower(trim(coalesce(name, ''))), lower(trim(coalesce(website, ''))), lower(trim(coalesce(phone, ''))), lower(trim(coalesce(city, ''))))), 1, 12) AS fingerprint FROM places_v")
def record_fingerprint(t: Tables) -> DataFrame:
    return t.places.select("id", C.fingerprint("name", "website", "phone", "city").alias("fingerprint"))


def keyed(t: Tables) -> DataFrame:
    return t.places.withColumn("name_key", C.name_key("name"))


KEYED = f"SELECT *, {O.name_key('name')} AS name_key FROM places_v"


@query(f"""SELECT name_key, arg_min(id, seq) AS id, coalesce(first(website ORDER BY seq) FILTER (WHERE website <> ''), first(website ORDER BY seq)) AS website,
 coalesce(first(phone ORDER BY seq) FILTER (WHERE phone <> ''), first(phone ORDER BY seq)) AS phone FROM ({KEYED}) WHERE name_key <> '' GROUP BY name_key""")
def dedupe_backfill(t: Tables) -> DataFrame:
    return dedupe.dedupe_fill(keyed(t)).select("name_key", "id", "website", "phone")


@query("SELECT id, city, file FROM (SELECT 'k' || (seq % 400) AS id, city, seq, state AS file, row_number() OVER (PARTITION BY seq % 400 ORDER BY state DESC, seq DESC) AS r FROM places_v) WHERE r = 1")
def dedupe_last(t: Tables) -> DataFrame:
    rows = t.places.select(F.concat(F.lit("k"), (F.col("seq") % 400).cast("string")).alias("id"), "city", "seq", F.col("state").alias("file"))
    return dedupe.dedupe_last(rows).select("id", "city", "file")


@query("""WITH r AS (SELECT 'k' || (seq % 300) AS id, seq, coalesce(category, 'other') AS niche FROM places_v),
 f AS (SELECT id, niche, min(seq) AS first_at FROM r GROUP BY id, niche),
 l AS (SELECT id, list(niche ORDER BY first_at) AS ls FROM f GROUP BY id)
 SELECT id, (SELECT min(seq) FROM r WHERE r.id = l.id) AS seq, list_reduce(ls, lambda s, x: CASE WHEN contains(s, x) THEN s ELSE s || ' / ' || x END) AS niche FROM l""")
def dedupe_merge_labels(t: Tables) -> DataFrame:
    rows = t.places.select(F.concat(F.lit("k"), (F.col("seq") % 300).cast("string")).alias("id"), "seq", F.coalesce("category", F.lit("other")).alias("niche"))
    return dedupe.dedupe_merge_label(rows)


@query("SELECT lower_name, id FROM (SELECT lower(name) AS lower_name, id, row_number() OVER (PARTITION BY lower(name) ORDER BY seq) AS r FROM places_v) WHERE r = 1")
def dedupe_first(t: Tables) -> DataFrame:
    return dedupe.dedupe_first(t.places.withColumn("lower_name", F.lower("name")), "lower_name").select("lower_name", "id")


@query("""SELECT id, county FROM (SELECT b.id, m.county, row_number() OVER (PARTITION BY b.id ORDER BY m.rank, m.county) AS r FROM (SELECT 'k' || (seq % 500) AS id, CASE seq % 4 WHEN 0 THEN 'napa' WHEN 1 THEN 'sonoma' WHEN 2 THEN 'lake' ELSE 'marin' END AS c FROM places_v) b
 JOIN (VALUES ('sonoma', 0), ('napa', 1), ('marin', 2), ('mendocino', 3), ('lake', 4), ('solano', 5)) m(county, rank) ON b.c = m.county) WHERE r = 1""")
def primary_county(t: Tables) -> DataFrame:
    k = F.col("seq") % 4
    county = F.when(k == 0, "napa").when(k == 1, "sonoma").when(k == 2, "lake").otherwise("marin")
    rows = t.places.select(F.concat(F.lit("k"), (F.col("seq") % 500).cast("string")).alias("id"), county.alias("county"))
    order = t.spark.createDataFrame([(c, k) for k, c in enumerate(V.COUNTY_PRIORITY)], "county string, rank int")
    return dedupe.assign_primary(rows, order)


@query("""SELECT id, name, website, phone, cast(populated AS int) AS populated FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY populated DESC, seq) AS r FROM (
 SELECT 'k' || (seq % 350) AS id, seq, name, website, phone, (length(trim(coalesce(name, ''))) > 0)::int + (length(trim(coalesce(website, ''))) > 0)::int + (length(trim(coalesce(phone, ''))) > 0)::int AS populated FROM places_v)) WHERE r = 1""")
def richest_record(t: Tables) -> DataFrame:
    rows = t.places.select(F.concat(F.lit("k"), (F.col("seq") % 350).cast("string")).alias("id"), "seq", "name", "website", "phone")
    return dedupe.dedupe_richest(rows).select("id", "name", "website", "phone", "populated")


CLIENTS = f"SELECT {O.name_key('name')} AS name_key, source AS label, seq AS seed_ord FROM places_v WHERE seq % 3 < 2"


def clients(t: Tables) -> DataFrame:
    return t.places.filter("seq % 3 < 2").select(C.name_key("name").alias("name_key"), F.col("source").alias("label"), F.col("seq").alias("seed_ord"))


@query(f"SELECT name_key, arg_min(label, seed_ord) AS label FROM ({CLIENTS}) WHERE name_key <> '' GROUP BY name_key")
def suppression_set(t: Tables) -> DataFrame:
    return dedupe.first_label(clients(t))


@query(f"SELECT label, count(DISTINCT name_key) AS names FROM ({CLIENTS}) WHERE name_key <> '' GROUP BY label UNION ALL SELECT '(all)', count(DISTINCT name_key) FROM ({CLIENTS}) WHERE name_key <> ''")
def suppression_counts(t: Tables) -> DataFrame:
    return A.suppression_counts(clients(t))


@query(f"SELECT k.id, s.label IS NOT NULL AS suppressed, s.label AS suppressed_by FROM ({KEYED}) k LEFT JOIN (SELECT name_key, arg_min(label, seed_ord) AS label FROM ({CLIENTS}) WHERE name_key <> '' GROUP BY name_key) s ON k.name_key = s.name_key")
def suppression_lookup(t: Tables) -> DataFrame:
    return joins.apply_suppression(keyed(t), dedupe.first_label(clients(t))).select("id", "suppressed", "suppressed_by")


@query(f"SELECT id, name FROM ({KEYED}) WHERE name_key NOT IN (SELECT {O.name_key('name')} FROM places_v WHERE seq % 9 = 0)")
def exclude_known(t: Tables) -> DataFrame:
    return joins.exclude_known(keyed(t), keyed(t).filter("seq % 9 = 0")).select("id", "name")


@query(f"""WITH k AS (SELECT *, {O.name_key_plain('name')} AS key FROM places_v)
 SELECT id, key, source FROM k WHERE source = 'overture'
 UNION ALL SELECT id, key, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM k WHERE source = 'osm' AND key <> '' AND key NOT IN (SELECT key FROM k WHERE source = 'overture')) WHERE r = 1""")
def merge_sources(t: Tables) -> DataFrame:
    k = t.places.withColumn("key", C.name_key_plain("name"))
    return joins.merge_source(k.filter("source = 'overture'"), k.filter("source = 'osm'"), "key").select("id", "key", "source")


@query("SELECT id, source FROM places_v UNION ALL SELECT id, 'copy' FROM places_v WHERE seq % 5 = 0")
def source_union(t: Tables) -> DataFrame:
    extra = t.places.filter("seq % 5 = 0").select("id", F.lit("copy").alias("source"))
    return union_sources(t.places, extra).select("id", "source")


@query("""SELECT p.id, m.market FROM places_v p JOIN (VALUES {boxes}) m(market, south, west, north, east) ON p.lon BETWEEN m.west AND m.east AND p.lat BETWEEN m.south AND m.north""".replace(
    "{boxes}", ", ".join(f"('{k}', {s}, {w}, {n}, {e})" for k, _, s, w, n, e in V.MARKETS)
))
def market_assignment(t: Tables) -> DataFrame:
    boxes = t.spark.createDataFrame([(k, s, w, n, e) for k, _, s, w, n, e in V.MARKETS], "market string, south double, west double, north double, east double")
    return catalogue.assign_market(t.places, boxes).select("id", "market")


@query(f"SELECT id, {O.host('website')} AS h, CASE " + " ".join(f"WHEN {O.on_domain(O.host('website'), d)} THEN {O.lit(d)}" for d in V.LISTING_DOMAINS) + " END AS matched FROM places_v")
def domain_match(t: Tables) -> DataFrame:
    domains = t.spark.createDataFrame([(d, k) for k, d in enumerate(V.LISTING_DOMAINS)], "domain string, rank int")
    return joins.match_domain(t.places.select("id", C.host("website").alias("h")), "h", domains)


@query(f"SELECT k.id, n.offices FROM ({KEYED}) k JOIN (SELECT name_key, count(*) AS offices FROM ({KEYED}) GROUP BY name_key) n ON k.name_key = n.name_key")
def office_counts(t: Tables) -> DataFrame:
    return catalogue.office_counts(keyed(t)).select("id", "offices")


@query("SELECT (SELECT count(*) FROM places_v) AS raw, (SELECT count(*) FROM leads_v) AS clean, (SELECT count(*) FROM leads_v WHERE tier = 'A') AS tier_a, (SELECT count(*) FROM leads_v WHERE phone <> '') AS with_phone, (SELECT count(*) FROM crm_v) AS crm_kept")
def build_summary(t: Tables) -> DataFrame:
    return A.build_summary(t.places, t.lead_core, t.core_crm)


FIT = f"""SELECT id, cast(seq % 60 AS int) AS agents, CASE seq % 5 WHEN 0 THEN 'hiring' WHEN 1 THEN 'open' WHEN 2 THEN 'software' WHEN 3 THEN 'in_house' ELSE 'unknown' END AS gap, phone,
 CASE WHEN seq % 4 = 0 THEN 'Jane Doe' END AS contact, seq % 7 = 0 AS taken FROM places_v"""


def _fit_sql(w: dict) -> str:
    volume = f"CASE WHEN agents > 0 THEN least(cast(trunc(agents * {float(w['per_agent'])}::double) AS int), {w['volume_cap']}) ELSE 0 END"
    score = f"cast({volume} + CASE gap WHEN 'hiring' THEN {w['hiring']} WHEN 'open' THEN {w['open']} WHEN 'software' THEN {w['software']} WHEN 'in_house' THEN {w['in_house']} ELSE 0 END + CASE WHEN phone <> '' THEN {w['phone']} ELSE 0 END + CASE WHEN contact <> '' THEN {w['contact']} ELSE 0 END + CASE WHEN taken THEN {w['suppressed']} ELSE 0 END AS int)"
    return f"SELECT id, score, CASE WHEN score >= {w['tier_a']} THEN 'A' WHEN score >= {w['tier_b']} THEN 'B' ELSE 'C' END AS tier FROM (SELECT id, {score} AS score FROM ({FIT}))"


def _fit(t: Tables, weights: dict) -> DataFrame:
    k = F.col("seq") % 5
    rows = t.places.select(
        "id", (F.col("seq") % 60).cast("int").alias("agents"), F.when(k == 0, "hiring").when(k == 1, "open").when(k == 2, "software").when(k == 3, "in_house").otherwise("unknown").alias("gap"), "phone",
        F.when(F.col("seq") % 4 == 0, "Jane Doe").alias("contact"), (F.col("seq") % 7 == 0).alias("taken"), F.lit("x").alias("by"), F.lit("Dotloop").alias("tool"),
    )
    score, tier, _ = S.coordinator_fit("agents", "gap", "phone", "contact", "taken", "by", "tool", weights)
    return rows.select("id", score.alias("score"), tier.alias("tier"))


@query(_fit_sql(V.COORDINATOR_WEIGHTS))
def coordinator_fit(t: Tables) -> DataFrame:
    return _fit(t, V.COORDINATOR_WEIGHTS)


@query(_fit_sql(V.COORDINATOR_WEIGHTS_V0))
def coordinator_fit_v0(t: Tables) -> DataFrame:
    return _fit(t, V.COORDINATOR_WEIGHTS_V0)


@query(f"""SELECT id, tier, CASE WHEN verdict = 'has_site' THEN 'C' ELSE tier END AS new_tier FROM leads_v l LEFT JOIN (SELECT 'c' || c_custkey AS lead_id, 'has_site' AS verdict FROM customer WHERE c_custkey % 6 = 0) v ON v.lead_id = l.id""")
def verified_demotion(t: Tables) -> DataFrame:
    verdicts = t.read("customer").filter("c_custkey % 6 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("lead_id"), F.lit("has_site").alias("verdict"))
    out = enrich.demote_verified(t.leads.withColumn("old", F.col("tier")), verdicts)
    return out.select("id", F.col("old").alias("tier"), F.col("tier").alias("new_tier"))


_NEED = "CASE tier WHEN 'A' THEN 'no_site' WHEN 'B' THEN 'weak' ELSE 'good' END"
_REACH = f"CASE WHEN {O.full('phone')} AND {O.full('email')} THEN 'email+phone' WHEN {O.full('email')} THEN 'email' WHEN {O.full('phone')} THEN 'phone' ELSE 'none' END"
HANDOFF = f"""SELECT *, CASE WHEN handoff_score >= 85 THEN 'A' WHEN handoff_score >= 70 THEN 'B' WHEN handoff_score >= 55 THEN 'C' ELSE 'D' END AS grade FROM (
 SELECT id, industry_fit, {_NEED} AS need, {_REACH} AS reach_channel, {O.clamp(f"CASE {_NEED} WHEN 'no_site' THEN 40 WHEN 'weak' THEN 30 ELSE 10 END + CASE industry_fit WHEN 'high' THEN 30 WHEN 'low' THEN 7 ELSE 15 END + CASE {_REACH} WHEN 'email+phone' THEN 22 WHEN 'email' THEN 17 WHEN 'phone' THEN 12 ELSE 0 END + least(8, CASE WHEN email_owned = 1 THEN 5 ELSE 0 END + CASE WHEN social_platforms IS NOT NULL THEN 3 ELSE 0 END)")} AS handoff_score FROM leads_v)"""


@query(f"SELECT id, need, reach_channel, handoff_score, grade FROM ({HANDOFF})")
def handoff_scores(t: Tables) -> DataFrame:
    return enrich.handoff(t.leads).select("id", "need", "reach_channel", "handoff_score", "grade")


@query(" UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM ({HANDOFF}) GROUP BY {c}" for c in ("grade", "industry_fit", "reach_channel", "need")))
def handoff_snapshot(t: Tables) -> DataFrame:
    return A.handoff_snapshot(enrich.handoff(t.leads))
