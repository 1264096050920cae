"""Plans of reports, markets and joined views: what is read, how often, and how it spreads."""

import random

import pytest
from prospectra.operators import aggregates, bucketed, catalogue, dedupe, joins, state
from prospectra.plans import registry
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return registry.Tables(spark, "/root/testdata/sf0.001")


def test_reports_read_the_leads_once(tables):
    for parts in (aggregates.data_dictionary(tables.leads), aggregates.market_gap_report(tables.leads)):
        for df in parts.values():
            assert "customer.parquet" not in plan_of(df)
    for df in (aggregates.stats(tables.lead_core, tables.core_crm, tables.audit), aggregates.build_summary(tables.clean.sparkSession.range(1), tables.lead_core, tables.core_crm)):
        assert "customer.parquet" not in plan_of(df)


def test_sums_of_sets_equal_single_reports(tables):
    leads = tables.leads.filter("seq % 3 > 0")
    both = aggregates.market_gap_report(leads)
    for by, part in (("category", "top_niches"), ("city", "top_cities")):
        label = both[part].columns[0]
        want = aggregates.market_gap(leads, by).orderBy(F.desc("warm_leads"), label).limit(25 if by == "category" else 20)
        assert both[part].collect() == want.select(*both[part].columns).collect()
    assert both["hottest_cells"].collect() == aggregates.opportunity_matrix(leads, 1).orderBy(F.desc("n"), "niche", "city").limit(30).collect()
    told = aggregates.data_dictionary(leads)
    assert sorted(map(str, told["tiers"].collect())) == sorted(map(str, aggregates.distribution(leads, "tier").collect()))
    assert told["top_niches"].collect() == aggregates.counts_by(leads, "category", 25).collect()
    empty = aggregates.data_dictionary(leads.limit(0))
    assert [tuple(r) for r in empty["size"].collect()] == [(0, 0, 0)] and empty["tiers"].collect() == []


def test_boxes_of_any_size_have_few_cells(spark):
    boxes = [("country", 24.0, -125.0, 50.0, -66.0), ("city", 38.4, -122.8, 38.5, -122.6), ("point", 10.0, 10.0, 10.0, 10.0), ("world", -90.0, -180.0, 90.0, 180.0), ("strip", 0.0, -170.0, 0.001, 170.0), ("turned", 5.0, 5.0, 4.0, 6.0), ("none", None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(boxes, "market string, south double, west double, north double, east double")
    cells = {r.market: r["count"] for r in catalogue.cover(df).groupBy("market").count().collect()}
    assert set(cells) == {"country", "city", "point", "world", "strip"} and max(cells.values()) <= 300 and cells["point"] == 1


def test_markets_equal_a_look_at_every_box(spark):
    rng = random.Random(4)
    boxes = []
    for k in range(60):
        s, w, h = rng.uniform(-80, 70), rng.uniform(-170, 150), 10 ** rng.uniform(-3, 1)
        boxes.append((k, s, w, s + h * rng.random(), w + h * rng.random()))
    boxes.append((99, -90.0, -180.0, 90.0, 180.0))
    points = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(300)]
    points += [(1000 + k, b[1], b[2]) for k, b in enumerate(boxes)] + [(2000 + k, b[3], b[4]) for k, b in enumerate(boxes)] + [(3000, None, 1.0)]
    got = catalogue.assign_market(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(boxes, "market int, south double, west double, north double, east double"))
    want = sorted((i, m) for i, lat, lon in points if lat is not None for m, s, w, n, e in boxes if s <= lat <= n and w <= lon <= e)
    assert sorted((r.id, r.market) for r in got.collect()) == want and got.columns == ["id", "lat", "lon", "market"]
    none = spark.createDataFrame([], "market int, south double, west double, north double, east double")
    assert catalogue.assign_market(spark.createDataFrame(points, "id int, lat double, lon double"), none).collect() == []


def test_a_crowded_city_spreads_over_tasks(spark, tmp_path):
    points = spark.range(400_000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN 38.44 ELSE (id % 150) - 75.0D END AS lat", "CASE WHEN id % 10 > 0 THEN -122.71 ELSE (id % 300) - 150.0D END AS lon", "repeat(cast(id AS string), 4) AS wide").repartition(8)
    boxes = spark.createDataFrame([("city", 38.0, -123.0, 39.0, -122.0), ("all", -90.0, -180.0, 90.0, 180.0)], "market string, south double, west double, north double, east double")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        catalogue.assign_market(points, boxes).write.parquet(str(tmp_path / "m"))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "m")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 760_000 and len(sizes) >= 8 and max(sizes) <= 2.5 * sum(sizes) / len(sizes), sizes


def test_rows_without_a_key_stay(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1), (2, None, "y", 2), (3, "a", "z", 3), (4, None, "w", 4)], "id int, name string, niche string, seq int")
    assert sorted((r.id, r.n) for r in catalogue.join_name_counts(rows).collect()) == [(1, 2), (2, None), (3, 2), (4, None)]
    assert sorted((r.id, r.offices) for r in catalogue.office_counts(rows, "name").collect()) == [(1, 2), (2, None), (3, 2), (4, None)]
    assert sorted(((r.name, r.niche) for r in dedupe.dedupe_merge_label(rows, "name").collect()), key=str) == [("a", "x / z"), (None, "y / w")]
    flagged = catalogue.flag_chains(rows.withColumn("brand", F.lit("")), 2)
    assert sorted((r.id, r.is_chain) for r in flagged.collect()) == [(1, True), (2, False), (3, True), (4, False)]


def test_a_view_of_bucketed_tables_shuffles_nothing(spark, tables, tmp_path):
    stored = bucketed.ServingTables(spark, str(tmp_path), "plans_test", 4)
    stored.build(leads=tables.leads.select("id", "name", "tier"), crm=tables.crm, audit=tables.audit)
    want = joins.lead_view(tables.leads.select("id", "name", "tier"), tables.crm, tables.audit)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            view = stored.view()
            assert "Exchange" not in plan_of(view) and "SortMergeJoin" in plan_of(view)
            assert sorted(map(str, view.collect())) == sorted(map(str, want.collect()))
            for part in stored.KEYS:  # as in a session that does not know them
                spark.sql(f"DROP TABLE plans_test_{part}")
            stored.open()
        stored.build(crm=state.empty_crm(spark))
        assert {r.status for r in stored.view().collect()} == {"New"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
