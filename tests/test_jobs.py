"""Jobs that store: guarded hooks, files by header, releases, state in buckets, resumable
audits, search index, deep pages, activity."""

import random

import pytest
from prospectra.operators import guard, joins, paging, search, serving, shared, state
from prospectra.plans import registry
from prospectra.sources import readers
from prospectra.sources.releases import ReleaseStore
from prospectra.streaming import jobs
from pyspark.sql import functions as F


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- guarded hooks


def test_one_row_in_a_thousand_breaks_a_hook(spark):
    def hook(row):
        if row["n"] % 1000 == 7:
            raise KeyError(row["n"])
        if row["n"] == 8:
            raise ValueError
        if row["n"] == 9:
            return {"half": "no number", "text": "lost with it"}
        return {"half": row["n"] // 2, "text": f"t{row['n']}"} if row["n"] % 2 == 0 else None

    rows = spark.range(20_000).select("id", F.col("id").alias("n"), F.repeat(F.lit("x"), 5).alias("wide"))
    tried, failed = guard.split_failed(guard.try_rows(rows, guard.RowHook(hook, ("n",), "half int, text string"), ("id",)))
    got = {r.id: r for r in tried.collect()}
    assert len(got) == 20_000 and tried.columns == ["id", "half", "text", "enrich_error"]
    for k, r in got.items():
        if k % 1000 == 7:
            assert r.enrich_error == str(k) and r.half is None
        elif k in (8, 9):
            assert (r.enrich_error == "ValueError") if k == 8 else ("no number" in r.enrich_error and r.text is None)
        else:
            assert r.enrich_error is None and r.half == (k // 2 if k % 2 == 0 else None)
    assert failed.count() == 22
    assert [tuple(r) for r in guard.error_counts(failed).filter("enrich_error = '7'").collect()] == [("7", 1)]


def test_a_repeated_run_replaces_its_own_failed_rows(spark, tmp_path):
    failed = lambda *k: spark.createDataFrame([(i, "e") for i in k], "id long, enrich_error string")
    path = str(tmp_path / "q")
    guard.add_quarantined(spark, failed(0).limit(0), path, "a")
    assert guard.quarantined(spark, path, "id long, enrich_error string").collect() == []
    guard.add_quarantined(spark, failed(1, 2), path, "a")
    guard.add_quarantined(spark, failed(3), path, "b")
    guard.add_quarantined(spark, failed(4), path, "a")
    assert rows_of(spark.read.parquet(path).select("id", "run")) == ["(3, 'b')", "(4, 'a')"]


def test_columns_that_would_stop_the_job(spark):
    rows = spark.createDataFrame([(1, "12", 0, None), (2, "x1", 4, None), (3, None, None, "before"), (4, " ", 5, None), (5, "9" * 30, 2, None)], "id int, t string, d int, enrich_error string")
    attempts = {
        "n": guard.to_number(F.col("t")),
        "q": guard.Attempt(F.lit(20) / F.col("d"), F.when(F.col("d") == 0, "division by zero")),
        "must": guard.required(F.col("d"), "no d"),
        "cast": guard.Attempt(F.col("t").cast("int"), F.when(~F.coalesce(F.col("t").rlike("^[0-9]{1,9}$"), F.lit(True)), "not whole")),
    }
    out = {r.id: r for r in guard.try_columns(rows, attempts).collect()}
    assert out[1].n == 12 and out[1].q is None and out[1].enrich_error == "q: division by zero"
    assert out[2].enrich_error == "n: no number: x1; cast: not whole" and out[2].q == 5.0
    assert out[3].enrich_error == "before; must: no d"
    assert out[4].enrich_error == "cast: not whole" and out[5].enrich_error.startswith("n: no number: 999")


def test_values_of_a_lead_come_from_its_first_good_page(spark):
    hook = guard.RowHook(dict, (), "a int, b string")
    tried = spark.createDataFrame([("x", 2, 5, None, None), ("x", 1, None, "p", "e1"), ("x", 3, 6, "q", "e3"), ("y", 1, None, None, None)], "lead_id string, page_ord int, a int, b string, enrich_error string")
    assert rows_of(guard.by_lead(tried, hook)) == ["('x', 5, 'p', 'e1')", "('y', None, None, None)"]


# --- files by header


def test_files_with_headers_of_their_own(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    put("napa_leads_full.csv", 'id,name,website,city\n1,"A, ""x""\nlines",w1,c1\n5,,,\n')
    put("santa_cruz_leads_full.csv", "id,city,name,phone\n2,Marin,Bolt,555\n")
    put("marin_leads_full.csv", "﻿id,Name,name\n3,a,b\n")
    put("A b%20C.csv", "id,name,website,city\n6,n,w,c\n")
    put("lake_leads_full.csv", "")
    put("solano_leads_full.csv", "id,zip\n")
    got = readers.read_counties(spark, str(tmp_path), ("id", "name", "website", "city", "phone", "none"))
    assert got.columns == ["id", "name", "website", "city", "phone", "none", "county"]
    assert rows_of(got.drop("none")) == sorted(map(str, [
        ("1", 'A, "x"\nlines', "w1", "c1", "", "Napa"), ("5", "", "", "", "", "Napa"), ("2", "Bolt", "", "Marin", "555", "Santa Cruz"), ("3", "b", "", "", "", "Marin"), ("6", "n", "w", "c", "", ""),
    ]))
    every = readers.read_counties(spark, str(tmp_path))
    assert sorted(c.lower() for c in every.columns) == ["city", "county", "id", "name", "phone", "website", "zip"] and every.count() == 5
    (tmp_path / "none").mkdir()
    put("none/e.csv", "")
    assert readers.read_by_header(spark, str(tmp_path / "none"), ("id",)).collect() == []
    put("none/f.csv", '"id\nx",name\n1,2\n')
    with pytest.raises(ValueError, match="line break"):
        readers.read_by_header(spark, str(tmp_path / "none"))


# --- CRM in buckets


def patch(spark, n, lead, text=None):
    return spark.sql(f"SELECT {n} AS event_id, timestamp'2024-01-01' + make_dt_interval({n}) AS ts, '{lead}' AS lead_id, map('status', 'Won', 'notes', '{text or n}') AS patch")


def test_a_patch_rewrites_its_buckets_only(spark, tmp_path):
    leads = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"))
    all_of_them = leads.select(F.lit(1).alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("id").alias("lead_id"), F.create_map(F.lit("notes"), F.repeat(F.sha2("id", 256), 3)).alias("patch"))
    table = jobs.CrmTable(spark, str(tmp_path), 32)
    table.merge(all_of_them, 0, leads)
    whole = table.folder.size("data/batch=0")
    table.merge(patch(spark, 2, "c77").unionByName(patch(spark, 3, "unknown")), 1, leads)
    assert table.folder.size("data/batch=1") < whole / 16
    assert len(table.folder.names("data/batch=1/bucket=*")) == 1
    assert table.read().count() == 20_000
    found = table.lookup(["c77", "c78", "nobody"])
    assert {r.lead_id: r.status for r in found.collect()} == {"c77": "Won", "c78": "New"}
    assert len(found.inputFiles()) < 4
    with_two = table.manifest()
    assert sorted(set(with_two["at"].values())) == [0, 1] and len(with_two["at"]) == 32


def test_a_batch_that_stops_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    leads = spark.createDataFrame([("a",), ("b",)], "id string")
    jobs.CrmTable(spark, str(tmp_path), 4).merge(patch(spark, 1, "a"), 1, leads)
    before = rows_of(jobs.CrmTable(spark, str(tmp_path)).read())

    def stop(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(jobs.Folder, "write", stop)
    with pytest.raises(RuntimeError, match="killed"):
        jobs.CrmTable(spark, str(tmp_path)).merge(patch(spark, 2, "a", "new"), 2, leads)
    monkeypatch.undo()
    assert rows_of(jobs.CrmTable(spark, str(tmp_path)).read()) == before
    jobs.CrmTable(spark, str(tmp_path)).merge(patch(spark, 2, "a", "new"), 2, leads)
    assert [r.notes for r in jobs.CrmTable(spark, str(tmp_path)).read().collect()] == ["new"]
    for n in range(3, 9):
        jobs.CrmTable(spark, str(tmp_path)).merge(patch(spark, n, "ab"[n % 2], f"n{n}"), n, leads)
    table = jobs.CrmTable(spark, str(tmp_path))
    assert len(table.folder.names("manifests/*")) == table.KEPT
    assert {r.lead_id: r.notes for r in table.read().collect()} == {"a": "n8", "b": "n7"}
    assert {r.lead_id: r.notes for r in table.read(8).collect()} == {"a": "n6", "b": "n7"}
    assert len(table.folder.names("data/batch=*/bucket=*")) <= 2 * table.KEPT


# --- resumable audits

AUDIT = "lead_id string, grade string"


def grade(fail=()):
    def run(targets):
        bad = targets.filter(F.col("lead_id").isin(*fail)) if fail else targets.limit(0)
        if bad.count():
            raise RuntimeError("killed")
        return targets.select("lead_id", F.concat(F.lit("g"), "lead_id").alias("grade"))

    return run


def test_an_audit_that_is_killed_goes_on(spark, tmp_path):
    targets = spark.range(200).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("lead_id"), F.lit(1).alias("x"))
    targets = targets.unionByName(targets.limit(20))
    log = jobs.AuditLog(spark, str(tmp_path / "log"), AUDIT)
    with pytest.raises(RuntimeError, match="killed"):
        log.audit_all(targets, grade(fail=("c50",)), "first", 8)
    done = log.read().count()
    assert 0 <= done < 200
    jobs.AuditLog(spark, str(tmp_path / "log"), AUDIT).audit_all(targets, grade(), "first", 8)
    want = sorted(f"c{k}" for k in range(200))
    assert sorted(r.lead_id for r in log.read().collect()) == want
    log.audit_all(targets.unionByName(targets.limit(1).withColumn("lead_id", F.lit("new"))), grade(), "second", 2)
    assert sorted(r.lead_id for r in log.read().collect()) == sorted([*want, "new"])
    log.compact("one")
    assert log.parts() == ["compact=one"] and log.read().count() == 201
    with pytest.raises(ValueError, match="already"):
        log.compact("one")


def test_a_compaction_that_stops_halfway_counts_no_row_twice(spark, tmp_path, monkeypatch):
    targets = spark.createDataFrame([("a",), ("b",), ("c",)], "lead_id string")
    log = jobs.AuditLog(spark, str(tmp_path), AUDIT)
    log.audit_all(targets, grade(), "j", 3)
    kept = jobs.Folder.remove
    monkeypatch.setattr(jobs.Folder, "remove", lambda self, name="": None if name.startswith("job=") else kept(self, name))
    log.compact("x")  # the old parts are still there
    monkeypatch.undo()
    assert sorted(r.lead_id for r in log.read().collect()) == ["a", "b", "c"]
    log.audit_all(spark.createDataFrame([("d",)], "lead_id string"), grade(), "k", 1)
    log.compact("y")
    assert sorted(r.lead_id for r in log.read().collect()) == ["a", "b", "c", "d"]


def test_a_stream_of_targets_equals_one_run(spark, tmp_path):
    targets = spark.range(90).select(F.concat(F.lit("c"), (F.col("id") % 60).cast("string")).alias("lead_id"))
    targets.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("lead_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = jobs.AuditLog(spark, str(tmp_path / "log"), AUDIT)
    failing = jobs.stream_audits(stream(), log, grade(fail=("c30",)), str(tmp_path / "cp"))
    with pytest.raises(Exception, match="killed"):
        failing.awaitTermination()
    assert log.read().count() < 60
    jobs.stream_audits(stream(), log, grade(), str(tmp_path / "cp")).awaitTermination()
    want = sorted(f"c{k}" for k in range(60))
    assert sorted(r.lead_id for r in log.read().collect()) == want
    # a new checkpoint reads all files again and finds nothing left
    jobs.stream_audits(stream(), log, grade(), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r.lead_id for r in log.read().collect()) == want


# --- releases


def test_one_release_and_its_regions_are_read(spark, tmp_path):
    store = ReleaseStore(spark, str(tmp_path))
    with pytest.raises(LookupError):
        store.read()
    rows = spark.createDataFrame([(k, k * 1.0, -k * 1.0, ("01", "west", None)[k % 3]) for k in range(30)], "id int, lat double, lon double, region string")
    store.publish(rows, "2024-01-05")
    store.publish(rows.filter("id < 20"), "2024-02-05")
    rows.write.partitionBy("region").parquet(str(tmp_path / "release=2024-03-05"))
    assert store.releases() == ["2024-01-05", "2024-02-05"] and store.newest() == "2024-02-05"
    found = store.in_box((3, -100, 12, 100), ("01",))
    assert sorted((r.id, r.region, r.release) for r in found.collect()) == [(k, "01", "2024-02-05") for k in (3, 6, 9, 12)]
    assert {p.split("release=")[1].split("/")[0] for p in found.inputFiles()} == {"2024-02-05"}
    plan = plan_of(found)
    assert "PartitionFilters: [" in plan and "region" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(lat" in plan
    assert store.read().count() == 20 and store.read(release="2024-01-05").filter("region is null").count() == 10
    with pytest.raises(ValueError, match="already"):
        store.publish(rows, "2024-02-05")
    store.publish(rows, "2024-03-05")
    assert store.read().count() == 30
    store.prune(1)
    assert store.releases() == ["2024-03-05"]


# --- search index


def test_prefixes_are_ranges_of_the_scan(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abz09") for _ in range(rng.randint(1, 4)))
    leads = spark.createDataFrame([(str(k), " ".join(word() for _ in range(3)), word(), None if k % 9 == 0 else word(), f"{k} Main-St.") for k in range(400)], "id string, name string, category string, city string, address string")
    index = search.TokenIndex(spark, str(tmp_path))
    index.build(leads)
    for q in ("a", "ab z", "main 1", "z z9 0", "MAIN st", "zzzzz", "  ", "b b b", "Main 1 nothing"):
        assert rows_of(index.search(leads, q)) == rows_of(joins.search(leads, q)), q
    plan = plan_of(index.ids("ab"))
    assert "GreaterThanOrEqual(token,ab)" in plan and "LessThan(token,ab{)" in plan
    assert index.frequencies(["main", "zzzzz"]) == {"main": 400, "zzzzz": 0}
    index.build(leads.limit(0))
    assert index.search(leads, "a").count() == 0


# --- pages


@pytest.fixture(scope="module")
def listed(spark):
    rng = random.Random(2)
    some = lambda *v: rng.choice((None, *v))
    rows = [(f"{k:03d}", some("n1", "n2", "n3"), some("A", "B"), some("x", "y", ""), some("p", "q"), some(1, 2, 50), some("2024-01-01", "2024-01-02")) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, name string, tier string, city string, category string, score int, up string")
    return df.withColumn("updated_at", F.col("up").cast("timestamp")).drop("up").repartition(3).cache()


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("sort", [*serving.SORTS])
def test_all_pages_together_are_the_full_sort(spark, listed, sort, order):
    want = [r.id for r in serving.sort_leads(listed, sort, order).collect()]
    got, row = [], None
    while part := paging.next_page(listed, row, 33, sort, order).collect():
        got += [r.id for r in part]
        row = part[-1].asDict()
    assert got == want
    back = paging.next_page(listed, row, 33, sort, order, back=True).collect()
    assert [r.id for r in back] == want[-34:-1]
    first = paging.next_page(listed, {**row, "id": want[3], **listed.filter(F.col("id") == want[3]).first().asDict()}, 10, sort, order, back=True)
    assert [r.id for r in first.collect()] == want[:3]


def test_stored_pages(spark, listed, tmp_path):
    pages = paging.SortedPages(spark, str(tmp_path))
    pages.build(listed, "score", "desc", 5)
    want = [r.id for r in serving.sort_leads(listed, "score", "desc").collect()]
    assert pages.total() == 120 and len(pages.counts()) > 1
    for k in range(1, 9):
        assert [r.id for r in pages.page(k, 17, "score", "desc").collect()] == want[(k - 1) * 17 : k * 17]
    plan = plan_of(pages.page(1, 5, "score", "desc"))
    assert "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pages.build(listed.limit(0))
    assert pages.total() == 0 and pages.page(1).collect() == []


# --- activity


def events(spark, *rows):
    return spark.createDataFrame(rows, "event_id long, account_id string, lead_id string, kind string, at string").withColumn("created_at", F.col("at").cast("timestamp")).drop("at")


def test_late_and_repeated_events_count_once(spark, tmp_path):
    store = jobs.ActivityStore(spark, str(tmp_path))
    assert store.read().collect() == []
    store.append(events(spark, (1, "a", "x", "call", "2024-01-01 10:00:00"), (2, "a", "x", "note", "2024-01-02 10:00:00")), "1")
    store.append(events(spark, (3, "a", "x", "call", "2024-01-01 09:00:00"), (2, "a", "x", "note", "2024-01-02 10:00:00"), (4, "b", "y", "call", "2024-01-03 00:00:00")), "2")
    store.append(events(spark, (3, "a", "x", "call", "2024-01-01 09:00:00"), (2, "a", "x", "note", "2024-01-02 10:00:00"), (4, "b", "y", "call", "2024-01-03 00:00:00")), "2")
    assert [r.event_id for r in store.timeline("x").collect()] == [2, 1, 3]
    some = store.timeline("x", "2024-01-01", "2024-01-01")
    assert [r.event_id for r in some.collect()] == [1, 3]
    assert "day" in plan_of(some).split("PartitionFilters: [")[1].split("]")[0]
    before = rows_of(store.read())
    store.compact("all")
    assert rows_of(store.read()) == before and store.folder.names("batch=*") == ["batch=all"]


def test_a_stream_of_activity(spark, tmp_path):
    rows = events(spark, *[(k % 40, "a", f"l{k % 40 % 7}", "call", f"2024-01-{1 + k % 40 % 9:02d} 10:00:00") for k in range(60)])
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    store = jobs.ActivityStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.stream_activity(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert rows_of(store.read()) == rows_of(rows.distinct())


# --- scratch folders


def test_cleared_folders_are_gone(spark):
    since = shared.marked()
    t = registry.Tables(spark, "/root/testdata/sf0.001")
    df = joins.lead_view(t.leads, state.empty_crm(spark), t.audit)
    assert shared.cut(df.select("id")).count() == df.count()
    written = list(shared._written.paths[since:])
    assert written
    shared.clear(spark, since)
    assert not any(shared.Folder(spark, p).has() for p in written) and shared.marked() == since
