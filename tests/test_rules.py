"""Rules on single rows, edge cases and properties."""

import json
import random
import time

import numpy as np
import pytest
from prospectra.functions import columns as C
from prospectra.functions import scoring as S
from prospectra.functions import values as V
from prospectra.operators import aggregates, catalogue, dedupe, joins, pages, serving, state
from prospectra.plans import profiles, registry
from prospectra.sources import readers, sinks
from prospectra.streaming import jobs
from pyspark.sql import functions as F


def one(spark, expression, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))
    return df.select(expression.alias("x")).first().x


def test_name_keys_meet(spark):
    key = lambda n: one(spark, C.name_key("n"), n=n)
    assert key("Acme Realty, LLC") == key("Acme Real Estate Group") == "acme"
    assert key("The Group") == "" and key(None) == ""


@pytest.mark.parametrize(
    ("url", "host", "site"),
    [("https://www.Biz.com:80/x?y=http://z", "www.biz.com", "biz.com:80"), ("biz.net/home", "biz.net", "biz.net"), (None, "", ""), ("", "", ""), ("http://u:p@h.org", "h.org", "u:p@h.org")],
)
def test_hosts(spark, url, host, site):
    assert (one(spark, C.host("u"), u=url), one(spark, C.site_host("u"), u=url)) == (host, site)


def test_weak_domains_match_at_a_dot(spark):
    weak = lambda u: one(spark, C.weak_domain("u"), u=u)
    assert weak("https://fedex.com") is None and weak("http://m.x.com/a") == "x.com" and weak("") == "no website"


def test_phone_shapes(spark):
    shape = lambda p: (one(spark, C.phone_fmt("p"), p=p), one(spark, C.area_code("p"), p=p))
    assert shape("+1 (707) 555-0101") == ("(707) 555-0101", "707")
    assert shape("555-12") == ("555-12", "555") and shape("12") == ("12", None) and shape("") == (None, None)


def test_social_platforms_loose_and_strict(spark):
    assert one(spark, C.social_platforms("s"), s="https://netflix.com/z|http://facebook.com/a|facebook.com/b") == "twitter|facebook"
    assert one(spark, C.social_platforms("s", loose=False), s="https://netflix.com/z") is None


def fit(spark, weights=None, **row):
    row = {"agents": 25, "gap": "open", "phone": "1", "contact": "J D", "taken": False, "by": "", "tool": ""} | row
    score, tier, _ = S.coordinator_fit("agents", "gap", "phone", "contact", "taken", "by", "tool", weights)
    return one(spark, F.struct(score.alias("s"), tier.alias("t")), **row)


def test_coordinator_fit_numbers(spark):
    assert tuple(fit(spark)) == (78, "A")
    taken = fit(spark, agents=40, taken=True)
    assert taken.s < 0 and taken.t == "C"
    assert fit(spark, V.COORDINATOR_WEIGHTS_V0, gap="software").s == 25 + 20 + 5 + 5


def test_site_need_without_audit_counts_as_unreachable(spark):
    score, tier, why = S.site_need("w", "up", "https", "mobile", "ms", "b", "p")
    row = one(spark, F.struct(score.alias("s"), tier.alias("t"), why.alias("y")), w="https://own.com", up=None, https=None, mobile=None, ms=None, b=None, p="")
    assert tuple(row) == (50, "A", "site unreachable")


def crawl(spark, *html):
    return spark.createDataFrame([("c1", k, "http://x", "http://x", 200, 100, h) for k, h in enumerate(html)], "lead_id string, page_ord int, url string, final_url string, status int, load_ms int, html string")


def test_roster_counts_a_profile_once(spark):
    links = "".join(f'<a href="/agents/{n}/">x</a><a href="/agents/{n}/"><img></a>' for n in ("jane-doe", "bob-lee", "Ann-Poe"))
    assert pages.roster_size(crawl(spark, links, links)).first().agent_count == 3
    assert pages.roster_size(crawl(spark, '<div class="agent-card"></div>' * 4)).first().agent_count == 4


def test_decision_maker_prefers_seniority(spark):
    html = "<p>Bob Lee, Office Manager</p><p>Broker/Owner: Jane Quinn Doe.</p><p>Our Team - Owner</p>"
    row = pages.decision_maker(crawl(spark, html)).first()
    assert (row.decision_maker, row.dm_title.lower()) == ("Jane Quinn Doe", "broker/owner")
    assert pages.decision_maker(crawl(spark, "<p>contact us, owner</p>")).count() == 0


def test_titles_are_those_of_the_plain_patterns(spark):
    pick = random.Random(3).choice
    parts = ["Bob", "lee", "O'Brien", "’Ann", "-Jo", "Al-Owner", "x", "9Zed", "é", "owner", "Owner", "broker/owner", "CEO", "v.p.", ",", " ", " ", " ", "-", " - ", ": ", "|", "—", "\n", ".", "'"]
    texts = spark.createDataFrame([("".join(pick(parts) for _ in range(40)),) for _ in range(3000)], "t string")
    titles = ("owner", "broker/owner", "co-owner", "ceo", "v.p.")
    either = "|".join(sorted(titles, key=len, reverse=True))
    plain = (rf"(?i)({pages._NAME}){pages._BETWEEN}({either})\b", 1, 2), (rf"(?i)\b({either}){pages._BETWEEN}({pages._NAME})", 2, 1)
    want = [F.regexp_extract_all("t", F.lit(p), F.lit(g)) for p, n, t in plain for g in (n, t)]
    people = lambda k, part: F.transform(F.filter("people", lambda m: m["form"] == k), lambda m: m[part])
    got = texts.select("t", pages._titled("t", titles).alias("people"), *want).select("*", *[people(k, part) for k in (0, 1) for part in ("name", "title")])
    rows = [tuple(r) for r in got.collect()]
    assert all(r[2:6] == r[6:] for r in rows) and sum(len(r[2]) for r in rows) > 100 and sum(len(r[4]) for r in rows) > 100


def test_titles_in_long_runs_take_no_square_of_time(spark):
    html = "".join(f"{run} <p>" for run in ("a" * 150_000, "a'" * 75_000, "a-" * 75_000, "x." * 75_000)) + "Bob Lee, Owner"
    began = time.time()
    assert pages.decision_maker(crawl(spark, html)).first().decision_maker == "Bob Lee"
    assert pages.contact_emails(crawl(spark, html + " bob@lee.example")).first().emails == "bob@lee.example"
    assert time.time() - began < 30


def test_page_texts_are_made_once(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    page = crawl(spark, "x").coalesce(1)
    assert plan(pages.decision_maker(page)).count("<[^>]+>") == 1
    assert plan(pages.roster_size(page)).count("associates?") == 1 and plan(pages.contact_emails(page)).count("mailto:") == 1
    leads = spark.createDataFrame([("c1", "http://x")], "id string, website string")
    assert plan(pages.coordination_gap(leads, page)).count("lower(html") == 1


def test_client_names_without_junk(spark):
    html = '"Super" — Jane Doe, Acme Realty <img alt="Hill &amp; Dale Homes"> <img alt="Company Logo"> <cite>Bay Group</cite>'
    found = pages.client_names(spark.createDataFrame([("rival", html)], "label string, html string"))
    assert {r.name for r in found.collect()} == {"Acme Realty", "Hill & Dale Homes", "Bay Group"}


def test_gap_order(spark):
    leads = spark.createDataFrame([("c1", "http://x"), ("c2", "http://y"), ("c3", "")], "id string, website string")
    page = crawl(spark, "Our Transaction Coordinator", "we use DotLoop; hiring a transaction coordinator")
    got = {r.id: (r.gap, r.software) for r in pages.coordination_gap(leads, page).collect()}
    assert got == {"c1": ("hiring", None), "c2": ("unknown", None), "c3": ("unknown", None)}


def test_profiles(spark):
    assert profiles.names() == ["coordination", "web_design"]
    with pytest.raises(KeyError, match="coordination, web_design"):
        profiles.get("nope")
    p = profiles.get("coordination")
    q = profiles.with_override(p, {"seeds": ["https://a.com/x", " "]})
    assert p.config["seeds"] == {} and q.suppression(q.config) == {"a.com": "https://a.com/x"}


def test_failing_source_is_left_out(spark):
    def bad():
        raise OSError("gone")

    union, failed = profiles.union_each({"a": lambda: spark.range(2), "b": bad})
    assert union.count() == 2 and failed == {"b": "gone"}


def test_run_end_to_end(spark):
    leads = spark.createDataFrame(
        [("1", 1, "Acme Realty", "http://acme.com", "1", "", "c", "t", "", "osm"), ("2", 2, "ACME Group", None, "2", "", "c", "t", "", "osm"), ("3", 3, "Bay Homes", None, None, "", "c", "t", "Big", "osm"), ("4", 4, "Known", None, None, "", "c", "t", "", "osm")],
        "id string, seq int, name string, website string, phone string, email string, category string, city string, brand string, source string",
    )
    page = spark.createDataFrame([("1", 0, "u", "https://u", 200, 100, "we are hiring a transaction coordinator")], "lead_id string, page_ord int, url string, final_url string, status int, load_ms int, html string")
    known = spark.createDataFrame([("known",)], "name_key string")
    rival = spark.createDataFrame([("bayhomes", "rival")], "name_key string, label string")
    out = profiles.run(profiles.get("coordination"), leads, page, known, rival).collect()
    assert [(r.id, r.gap, r.suppressed) for r in out] == [("1", "hiring", False), ("3", "unknown", True)]
    assert out[0].phone == "1" and out[1].score < 0
    web = profiles.run(profiles.get("web_design"), leads, page, known).collect()
    assert [r.id for r in web] == ["1"] and web[0].tier == "B"
    header = sinks.declared(profiles.run(profiles.get("web_design"), leads, page), profiles.get("web_design").columns)
    assert header.columns[:3] == ["Tier", "Score", "Business"]


def test_dedupe_is_idempotent_and_fills(spark):
    rows = spark.createDataFrame([(1, "k", None, "p"), (2, "k", "w", "q"), (3, "", "w", "q"), (4, "z", "", None)], "seq int, name_key string, website string, phone string")
    first = dedupe.dedupe_fill(rows)
    assert sorted(map(tuple, first.select("seq", "website", "phone").collect())) == [(1, "w", "p"), (4, "", None)]
    assert sorted(map(tuple, dedupe.dedupe_fill(first).collect())) == sorted(map(tuple, first.collect()))


def test_label_merge_skips_contained(spark):
    rows = spark.createDataFrame([("a", 1, "Bars / Pubs"), ("a", 2, "Bars"), ("a", 3, "Cafes"), ("b", 4, "Bars")], "id string, seq int, niche string")
    assert {r.id: r.niche for r in dedupe.dedupe_merge_label(rows).collect()} == {"a": "Bars / Pubs / Cafes", "b": "Bars"}


def test_semi_and_anti_are_the_whole(spark):
    leads, done = spark.range(50).selectExpr("cast(id as string) id"), spark.createDataFrame([("3",), (None,), ("7",)], "lead_id string")
    assert joins.skip_done(leads, done, "id", "lead_id").count() + 2 == 50


def test_patch_tells_absent_from_null(spark):
    at = "timestamp'2024-01-01'"
    patches = spark.sql(
        f"""SELECT 1 AS event_id, {at} AS ts, 'a' AS lead_id, map('status', 'Won', 'notes', 'x', 'favorite', 'true') AS patch
        UNION ALL SELECT 2, {at}, 'a', map('status', '', 'notes', cast(null AS string)) UNION ALL SELECT 3, {at}, 'zz', map('status', 'Won')"""
    )
    leads = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = state.apply_crm_patches(state.empty_crm(spark), patches, leads).collect()
    assert [(r.lead_id, r.status, r.notes, r.favorite) for r in rows] == [("a", "Won", None, 1)]


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = lambda df: df.select("event_id", "ts", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("lead_id"), F.create_map(F.lit("status"), F.when(F.col("value") > 50, "Won").otherwise("Lost")).alias("patch"))
    leads = events.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("id")).distinct()
    table = jobs.CrmTable(spark, str(tmp_path / "crm"))
    jobs.stream_patches(rows(stream()), table, leads, str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted((r.lead_id, r.updated_at) for r in df.collect())
    assert key(table.read()) and {r.lead_id for r in table.read().collect()} == {r.id for r in leads.collect()}
    act = lambda df: df.select(F.lit("a").alias("account_id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"))
    q = jobs.usage_stream(act(stream()), late="60 days").writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = aggregates.usage(act(events))
    assert sorted(map(tuple, spark.table("usage").collect())) == sorted(map(tuple, batch.select("account_id", "kind", "window_start", "n").collect()))


def test_sinks_write_what_is_declared(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string").coalesce(1)
    sinks.write_jsonl(df, str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("part*")).read_text()
    assert json.loads(text) == {"a": "é", "b": None} and "é" in text
    sinks.write_crm_csv(df, [("A", "a"), ("None", "zz")], str(tmp_path / "c"))
    assert next((tmp_path / "c").glob("part*")).read_text().splitlines() == ["A,None", "é,"]


def test_lead_files_reject_without_id(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name,website\n1, Joe ,\n,Nameless,x\n2,,y\n")
    good, bad = readers.read_leads(spark, str(tmp_path / "x.csv"))
    assert [(r.id, r.name, r.website) for r in good.collect()] == [("1", "Joe", None)] and bad.count() == 2


def test_scan_pushes_bounds_and_prunes_fields(spark, tmp_path):
    raw = spark.sql("""SELECT '1' AS id, struct('n' AS primary) AS names, struct('cafe' AS primary, array('x') AS alternate) AS categories, 0.5D AS confidence, array('w') AS websites, array('s') AS socials,
     array('e') AS emails, array('p') AS phones, struct(struct('b' AS primary) AS names) AS brand, array(struct('f' AS freeform, 'l' AS locality, 'r' AS region, 'z' AS postcode, 'US' AS country)) AS addresses,
     struct(1.0D AS xmin, 2.0D AS ymin, 3.0D AS xmax) AS bbox, array(struct('d' AS dataset, 'i' AS record_id)) AS sources""")
    raw.write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    df = readers.read_places(spark.read.parquet(str(tmp_path / "p")), (0, 0, 5, 5), ["caf"])
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(bbox.xmin,0.0)" in plan and "xmax" not in plan.rpartition("ReadSchema")[2]
    assert df.first().city == "l"


def test_rank_equals_a_global_window(spark):
    rows = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101)
    got = catalogue.rank_rows(rows, F.col("v").desc(), F.col("id").asc())
    assert [r.rank for r in got.orderBy(F.col("v").desc(), "id").collect()] == list(range(1, 1001))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_of_many_wide_rows(spark, adaptive):
    """Columns that are pruned later, several partitions: no rank is lost or given twice."""
    rows = spark.range(200_000).withColumns({"v": F.col("id") * 7919 % 1009, "wide": F.repeat(F.lit("x"), 200)}).repartition(7)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = catalogue.rank_rows(rows, F.col("v").desc(), F.col("id").asc()).select("id", "v", "rank")
        assert got._jdf.queryExecution().toString().count("rangepartitioning") == 0  # stored once
        found = np.array([tuple(r) for r in got.collect()])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = np.lexsort((found[:, 0], -found[:, 1]))
    assert len(found) == 200_000 and (found[order, 2] == np.arange(1, 200_001)).all()


def test_hot_names_split(spark, tmp_path):
    """With nine tenths of the rows under one name, the join's tasks stay even."""
    rows = spark.range(400_000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN 'hot' ELSE concat('n', id) END AS name", "'' AS brand", "repeat(cast(id AS string), 4) AS wide").repartition(8)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for k, df in enumerate((catalogue.join_name_counts(rows), catalogue.office_counts(rows, "name"), catalogue.flag_chains(rows))):
            df.write.parquet(str(tmp_path / str(k)))
            sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / str(k))).groupBy(F.input_file_name()).count().collect()]
            assert sum(sizes) == 400_000 and max(sizes) <= 2 * 400_000 / len(sizes) and len(sizes) >= 4, sizes
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_audits_read_pages_once_and_shuffle_no_html(spark):
    crawl = registry.Tables(spark, "/root/testdata/sf0.001").crawl
    for df in (pages.audit_sites(crawl), pages.audit_fronts(crawl), pages.contact_phones(crawl), pages.decision_maker(crawl)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange" in x and "html" in x]
    assert "pages.parquet" not in pages.audit_sites(crawl)._jdf.queryExecution().executedPlan().toString()


def test_call_scores_are_worked_out_once(spark):
    """The filter stands above the scores instead of repeating what they are made of."""
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    plan = serving.callable_warm(t.leads).select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000


def test_crm_goes_on_after_a_restart(spark, tmp_path):
    leads = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    patch = lambda n, lead: spark.sql(f"SELECT {n} AS event_id, timestamp'2024-01-0{n}' AS ts, '{lead}' AS lead_id, map('status', 'Won', 'notes', 'n{n}') AS patch")
    for n, lead in enumerate("abcab", 1):
        jobs.CrmTable(spark, str(tmp_path)).merge(patch(n, lead), n, leads)  # each time a new object
    (tmp_path / "data" / "batch=9" / "bucket=0").mkdir(parents=True)  # a batch that was never finished
    jobs.CrmTable(spark, str(tmp_path)).merge(patch(5, "b"), 5, leads)  # a batch that runs again
    every = patch(1, "a")
    for n, lead in enumerate("bcab", 2):
        every = every.unionByName(patch(n, lead))
    want = state.apply_crm_patches(state.empty_crm(spark), every, leads)
    assert sorted(map(str, jobs.CrmTable(spark, str(tmp_path)).read().collect())) == sorted(map(str, want.select(*state.empty_crm(spark).columns).collect()))
    assert len(list(tmp_path.glob("manifests/[0-9]*"))) == jobs.CrmTable.KEPT


def test_targets_and_sessions_of_streams(spark, tmp_path):
    rows = spark.sql("""SELECT 'a' AS lead_id, 'x' AS account_id, timestamp'2024-01-01 10:00:00' AS at UNION ALL SELECT 'a', 'x', timestamp'2024-01-01 10:10:00'
     UNION ALL SELECT 'b', 'x', timestamp'2024-01-01 11:00:00' UNION ALL SELECT 'c', 'y', timestamp'2024-01-01 10:00:00'""")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("targets", jobs.new_targets_stream(stream()), "append"), ("sittings", jobs.session_counts_stream(stream().withColumnRenamed("at", "created_at")), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.lead_id for r in spark.table("targets").collect()) == ["a", "b", "c"]
    assert sorted((r.account_id, r.n) for r in spark.table("sittings").collect()) == [("x", 1), ("x", 2), ("y", 1)]


def test_seeds_are_labelled_by_host():
    label = profiles.seed_labels
    assert label(None) == {} and label({"a": "u"}) == {"a": "u"}
    assert label(["https://Me@One.com:80/x", " ", "two.com", "http://one.com/y"]) == {"one.com": "http://one.com/y", "competitor_2": "two.com"}


def test_county_of_a_file_or_folder(spark):
    rows = spark.createDataFrame([("/x/santa_clara_leads_full.csv",), ("file:/x/napa_leads_full.csv/part-0.csv",), ("/x/other.csv",)], "path string")
    assert [r[0] for r in rows.select(readers.county_of("path")).collect()] == ["Santa Clara", "Napa", ""]


def test_market_boxes_overlap(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("b", 1.0, 1.0, 3.0, 3.0)], "market string, south double, west double, north double, east double")
    places = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.0, 0.0), (3, 9.0, 9.0), (4, None, 1.0)], "id int, lat double, lon double")
    assert sorted((r.id, r.market) for r in catalogue.assign_market(places, boxes).collect()) == [(1, "a"), (1, "b"), (2, "a")]


def test_outbound_site_ignores_the_listing(spark):
    rows = [("a", '<a href="/biz_redir?url=https%3A%2F%2Fown.com%2F%3Fq">x</a>'), ("b", '<a href="https://www.yelp.com/x">Website</a>'), ("c", '<a class="z" href="https://own.org/?a=1">Visit site</a>')]
    got = {r.lead_id: r.site for r in pages.outbound_site(spark.createDataFrame(rows, "lead_id string, html string")).collect()}
    assert got == {"a": "https://own.com", "b": None, "c": "https://own.org"}
