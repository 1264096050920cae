"""Portable views: a business catalogue, a crawl, CRM patches and search results made
from the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "nation", "region", "pages", "events", "orders", "part", "supplier", "lineitem")

PLACES_V = r"""
SELECT 'c' || cast(c_custkey as string) AS id, c_custkey AS seq,
 CASE WHEN c_custkey % 10 < 3 THEN 'Outlet ' || cast(c_custkey % 7 as string)
      WHEN c_custkey % 10 = 3 THEN 'Acme ' || cast(cast(floor(c_custkey / 10) as bigint) as string) || ' Realty, LLC'
      WHEN c_custkey % 10 = 4 THEN 'The Acme ' || cast(cast(floor(c_custkey / 10) as bigint) as string) || ' Group'
      ELSE c_name END AS name,
 CASE c_custkey % 13 WHEN 0 THEN 'beauty_salon' WHEN 1 THEN 'restaurant' WHEN 2 THEN 'plumber' WHEN 3 THEN 'church'
   WHEN 4 THEN 'park' WHEN 6 THEN 'real_estate_agent' WHEN 7 THEN 'winery' WHEN 8 THEN 'law_firm'
   WHEN 9 THEN 'post_office' WHEN 10 THEN 'credit_union' WHEN 11 THEN 'professional_services' END AS category,
 CASE c_custkey % 17 WHEN 0 THEN 'MegaCorp' WHEN 1 THEN '' END AS brand,
 CASE c_custkey % 11 WHEN 1 THEN '' WHEN 2 THEN 'https://www.facebook.com/p' || cast(c_custkey as string)
   WHEN 3 THEN 'http://shop' || cast(c_custkey as string) || '.wixsite.com' WHEN 4 THEN 'https://fedex.com'
   WHEN 5 THEN 'http://www.biz' || cast(c_custkey as string) || '.com' WHEN 6 THEN 'biz' || cast(c_custkey as string) || '.net/home'
   WHEN 7 THEN 'https://business.google.com/x' WHEN 8 THEN 'https://biz' || cast(c_custkey as string) || '.org' WHEN 9 THEN 'https://corp' || cast(c_custkey as string) || '.com/a?b=c' WHEN 10 THEN 'https://www.weebly.com/q' END AS website,
 CASE c_custkey % 7 WHEN 1 THEN '' WHEN 2 THEN '555-12' WHEN 3 THEN '+1 (707) 555-' || lpad(cast(c_custkey % 10000 as string), 4, '0')
   WHEN 4 THEN '707555' || lpad(cast(c_custkey % 10000 as string), 4, '0') WHEN 5 THEN '415.555.' || lpad(cast(c_custkey % 10000 as string), 4, '0')
   WHEN 6 THEN '707-555-' || lpad(cast(c_custkey % 10000 as string), 4, '0') END AS phone,
 CASE c_custkey % 4 WHEN 1 THEN 'info@biz' || cast(c_custkey as string) || '.com' WHEN 2 THEN 'owner' || cast(c_custkey as string) || '@gmail.com' WHEN 3 THEN '' END AS email,
 CASE c_custkey % 5 WHEN 1 THEN 'https://www.instagram.com/a|https://facebook.com/b' WHEN 2 THEN 'https://netflix.com/z' WHEN 3 THEN '' WHEN 4 THEN 'http://m.yelp.com/biz' END AS socials,
 CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE cast(c_custkey as string) || ' Main St' END AS address,
 CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE n_name END AS city, r_name AS state,
 cast(c_custkey % 101 as double) / 100 AS confidence,
 37.5 + cast(c_custkey % 300 as double) / 100 AS lat, -124.0 + cast(c_custkey % 250 as double) / 100 AS lon,
 CASE WHEN c_custkey % 3 = 0 THEN 'osm' ELSE 'overture' END AS source
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

CRAWL_V = r"""
SELECT 'c' || cast(page_id % 150 as string) AS lead_id, page_id AS page_ord, url, url AS final_url,
 cast(CASE page_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 0 ELSE 200 END as int) AS status,
 cast((page_id * 37) % 9500 as int) AS load_ms,
 html
   || CASE WHEN page_id % 3 = 0 OR page_id % 5 = 2 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END
   || CASE page_id % 5 WHEN 0 THEN '<script src="https://static.wixstatic.com/wix.com"></script>' WHEN 1 THEN '<link href="/wp-content/x.css">' ELSE '' END
   || CASE page_id % 4 WHEN 0 THEN '<footer>Copyright 2015-2023</footer>' WHEN 1 THEN '<footer>&copy; 2024</footer>' ELSE '' END
   || CASE page_id % 6 WHEN 0 THEN '<a href="mailto:Info@Biz' || cast(page_id as string) || '.com">mail</a> (707) 555-' || lpad(cast(page_id % 10000 as string), 4, '0') ELSE '' END
   || CASE page_id % 7 WHEN 0 THEN '<a href="/agents/jane-smith/">Jane</a><a href="/agents/jane-smith/">x</a><a href="/agents/bob-lee/">Bob</a> DRE #01234567' WHEN 1 THEN 'we are hiring a transaction coordinator' WHEN 2 THEN 'our transaction coordinator' WHEN 3 THEN 'Listings in Dotloop' ELSE '' END
   AS html
FROM pages
"""

CRM_PATCH_V = r"""
SELECT event_id, ts, 'c' || cast(user_id as string) AS lead_id,
 CASE event_type WHEN 'signup' THEN 'Contacted' WHEN 'purchase' THEN 'Won' WHEN 'error' THEN 'Bogus' WHEN 'click' THEN 'Quoted' END AS status,
 CASE WHEN event_id % 5 = 0 THEN 'note ' || cast(event_id as string) END AS notes,
 CASE WHEN event_id % 4 = 0 THEN cast(floor(event_id / 4) % 2 as int) END AS favorite
FROM events
"""

SERP_V = r"""
SELECT 'c' || cast(c_custkey as string) AS lead_id, cast(k as int) AS rank,
 CASE (c_custkey + k) % 5 WHEN 0 THEN 'https://www.yelp.com/biz/x' WHEN 1 THEN 'https://outlet' || cast(c_custkey % 7 as string) || '.com/'
  WHEN 2 THEN 'https://random-blog.net/p' WHEN 3 THEN 'https://m.facebook.com/q' ELSE 'https://mapquest.com/z' END AS url
FROM customer CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) t
WHERE c_custkey % 11 IN (0, 1)
"""

VIEWS = {"places_v": PLACES_V, "crawl_v": CRAWL_V, "crm_patch_v": CRM_PATCH_V, "serp_v": SERP_V}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the Parquet tables of a folder."""
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", VIEWS[name])]
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "places_v")


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "crawl_v")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "crm_patch_v")


def serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "serp_v")
