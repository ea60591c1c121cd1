import pytest
from pyspark.sql import functions as F

from salesflow.operators import gates, merge
from salesflow.sources import feeds, sinks


def test_upsert_and_insert_absent_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (None, "m"), (None, "m")], "k int, v string")
    assert sorted((r["k"] or 0, r["v"]) for r in merge.upsert(old, new, ["k"]).collect()) == [(0, "m"), (0, "m"), (0, "n"), (1, "b"), (2, "c")]
    assert [(r["k"], r["v"]) for r in merge.insert_absent(old, new, ["k"], [F.col("v")]).collect()] == [(2, "c")]
    none = old.limit(0)
    assert merge.insert_absent(none, new, ["k"], [F.col("v")]).filter("k IS NULL").count() == 1


def test_scd2_three_loads_do_not_overlap(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "id int, a string")
    h = merge.empty_history(rows((0, "")), ["id"], ["a"], "key")
    h = merge.scd2(h, rows((1, "x"), (2, "y")), ["id"], ["a"], "2020-01-01 00:00:00", "key")
    keys = {r["id"]: r["key"] for r in h.collect()}
    h = merge.scd2(h, rows((1, "x2"), (3, None)), ["id"], ["a"], "2021-01-01 00:00:00", "key")
    again = merge.scd2(h, rows((1, "x2"), (3, None)), ["id"], ["a"], "2021-01-01 00:00:00", "key")
    assert sorted(map(tuple, h.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    got = sorted((r["id"], r["a"], r["version_number"], r["is_current"], str(r["effective_from"])[:4], str(r["effective_to"])[:4]) for r in h.filter("id < 3").collect())
    assert got == [(1, "x", 1, False, "1900", "2021"), (1, "x2", 2, True, "2021", "9999"), (2, "y", 1, True, "1900", "9999")]
    assert h.select("key").distinct().count() == h.count() and {r["id"]: r["key"] for r in h.filter("version_number = 1 AND id < 3").collect()} == keys


def test_point_in_time_misses_are_zero(spark):
    h = spark.sql("SELECT 7L AS key, 1 AS id, timestamp'2020-01-01' AS effective_from, timestamp'2021-01-01' AS effective_to")
    facts = spark.sql("SELECT 1 AS id, explode(array(timestamp'2019-12-31', timestamp'2020-01-01', timestamp'2021-01-01')) AS at")
    assert [r["key"] for r in merge.point_in_time(facts, h, "id", "at", "key").orderBy("at").collect()] == [0, 7, 0]


def test_numbering_is_dense(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS k")
    out = merge.numbered(rows, ["k"], "n", 10)
    assert sorted(r["n"] for r in out.collect()) == list(range(11, 1011))
    assert out.filter("n != k + 11").count() == 0


def test_load_modes_and_transaction(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *x: spark.createDataFrame(list(x), "k int, v string")
    assert sinks.load(rows((1, "a")), path, "fail") == 1
    with pytest.raises(FileExistsError):
        sinks.load(rows((1, "a")), path, "fail")
    sinks.load(rows((2, "b")), path, "append")
    sinks.load(rows((2, "c"), (3, "d")), path, "merge", ["k"])
    t = sinks.Transaction(spark, path)
    t.insert(rows((4, "e")))
    t.update("k = 1", v="'z'")
    t.delete("k = 3")
    assert {(r["k"], r["v"]) for r in sinks.published(spark, path).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    t.commit()
    assert {(r["k"], r["v"]) for r in sinks.published(spark, path).collect()} == {(1, "z"), (2, "c"), (4, "e")}


def test_snapshot_gate(spark, tmp_path):
    path, staged = str(tmp_path / "s"), spark.range(3).selectExpr("id")
    good = spark.createDataFrame([("a", 0.0, True)], "check_name string, actual double, passed boolean")
    bad = good.withColumn("passed", F.lit(False))
    with pytest.raises(gates.QualityError):
        sinks.publish_snapshot(staged, path, bad, 3, 3, 1)
    with pytest.raises(gates.QualityError):
        sinks.publish_snapshot(staged, path, good, 4, 3, 1)
    with pytest.raises(gates.QualityError):
        sinks.publish_snapshot(staged, path, good, 3, 3, 2)
    assert sinks.published(spark, path) is None
    assert sinks.publish_snapshot(staged, path, good, 3, 3, 1) == 3
    assert sinks.publish_snapshot(staged.limit(0), path, bad, 0, 0, 1) == 0
    assert sinks.published(spark, path).count() == 3


def test_partition_overwrite_keeps_other_leaves(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.overwrite_partitions(spark.range(4).selectExpr("id", "id % 2 AS part"), path, ["part"])
    sinks.overwrite_partitions(spark.sql("SELECT 9L AS id, 1L AS part"), path, ["part"])
    assert {(r["id"], r["part"]) for r in spark.read.parquet(path).collect()} == {(0, 0), (2, 0), (9, 1)}


def test_artifact_needs_markers(spark, tmp_path):
    staging, target = str(tmp_path / "a/staging"), str(tmp_path / "a/done")
    with pytest.raises(FileNotFoundError):
        sinks.publish_artifact(spark, staging, target)
    spark.range(1).write.parquet(f"{staging}/minutes")
    with pytest.raises(gates.QualityError):
        sinks.publish_artifact(spark, staging, target)
    spark.range(1).write.parquet(f"{staging}/statuses")
    assert sinks.publish_artifact(spark, staging, target) == "published"
    assert sinks.publish_artifact(spark, staging, target) == "already"
    spark.range(1).write.parquet(f"{staging}/minutes")
    with pytest.raises(FileExistsError):
        sinks.publish_artifact(spark, staging, target)


def test_check_store_replaces_results(spark):
    checks = spark.createDataFrame([("a", 1.0, False)], "check_name string, actual double, passed boolean")
    store = gates.record(checks.withColumn("run_id", F.lit("r")).limit(0), "r", checks)
    store = gates.record(store, "r", checks.withColumn("passed", F.lit(True)))
    assert [(r["run_id"], r["check_name"], r["passed"]) for r in store.collect()] == [("r", "a", True)]


def test_pages_and_snapshot(spark, tmp_path):
    record = '{"promotion_id": "p%d", "product_id": "1", "discount_type": "fixed", "discount_value": 2, "version": 1}'
    (tmp_path / "pages").mkdir()
    for k, more in ((1, "true"), (2, "false")):
        (tmp_path / f"pages/{k}.json").write_text('{"data": [%s], "pagination": {"page": %d, "has_next": %s}}' % (record % k, k, more))
    rows = feeds.read_pages(spark, str(tmp_path / "pages"))
    assert sorted(r["promotion_id"] for r in rows.collect()) == ["p1", "p2"]
    with pytest.raises(feeds.FeedError):
        feeds.read_pages(spark, str(tmp_path / "pages"), page_cap=1)
    (tmp_path / "pages/3.json").write_text('{"data": null}')
    with pytest.raises(feeds.FeedError):
        feeds.read_pages(spark, str(tmp_path / "pages"))
    manifest = feeds.snapshot(spark, str(tmp_path / "batch"), {"a": spark.range(3), "b": spark.range(5)})
    assert {r["source"]: r["rows"] for r in manifest.collect()} == {"a": 3, "b": 5}
    assert feeds.replay(spark, str(tmp_path / "batch"))["b"].count() == 5


def test_soap(spark):
    body = "<soap:Envelope><soap:Body><ns:Promotion><ns:promotion_id>p1</ns:promotion_id><ns:version>2</ns:version></ns:Promotion></soap:Body></soap:Envelope>"
    rows = feeds.from_soap(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r["promotion_id"], r["version"]) for r in rows] == [("p1", "2")]
    with pytest.raises(feeds.FeedError):
        feeds.from_soap(spark.createDataFrame([("<soap:Fault>no</soap:Fault>",)], "body string"))


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    feeds.write_jdbc(spark.range(50).selectExpr("id AS k", "cast(id AS string) AS v"), url, "stage", driver=driver)
    rows = feeds.read_jdbc(spark, url, "stage", '"k"', driver=driver)
    assert rows.rdd.getNumPartitions() == 4 and sorted(r["k"] for r in rows.collect()) == list(range(50))


def test_a_crash_before_the_commit_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.load(spark.range(3).selectExpr("id"), path, "replace")
    add = sinks.Commits.add
    monkeypatch.setattr(sinks.Commits, "add", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.load(spark.range(9).selectExpr("id"), path, "append")
    assert sinks.published(spark, path).count() == 3
    monkeypatch.setattr(sinks.Commits, "add", add)
    for n in (5, 7, 9):
        sinks.load(spark.range(2).selectExpr("id"), path, "append")
        assert sinks.published(spark, path).count() == n
    assert len(sinks.Commits(spark, f"{path}/commits").numbers()) == 3


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    from salesflow.sources.commits import Conflict

    path = str(tmp_path / "t")
    sinks.load(spark.range(3).selectExpr("id"), path, "replace")
    one, two = sinks.Published(spark, path), sinks.Published(spark, path)
    one.append(spark.range(3, 5).selectExpr("id"))
    two.append(spark.range(10, 20).selectExpr("id"))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert sorted(r["id"] for r in sinks.published(spark, path).collect()) == [0, 1, 2, 3, 4]
    work = sinks.Transaction(spark, path)
    work.delete("id = 0")
    sinks.load(spark.range(7, 8).selectExpr("id"), path, "append")
    with pytest.raises(Conflict):
        work.commit()
    assert sinks.published(spark, path).count() == 6


def test_a_stale_writer_fails_after_its_number_was_dropped(spark, tmp_path):
    from salesflow.sources.commits import Conflict

    path = str(tmp_path / "t")
    sinks.load(spark.range(3).selectExpr("id"), path, "replace")
    stale = sinks.Published(spark, path)
    stale.append(spark.range(50).selectExpr("id"))
    for n in range(6):
        sinks.load(spark.range(1).selectExpr("id"), path, "append")
    with pytest.raises(Conflict):
        stale.commit()
    assert sinks.published(spark, path).count() == 9


def test_many_writers_publish_one_version_each(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from salesflow.sources.commits import Commits, Conflict

    log = Commits(spark, str(tmp_path / "c"))

    def add(k):
        try:
            log.add(7, {"writer": k})
            return k
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [k for k in pool.map(add, range(16)) if k is not None]
    assert len(won) == 1 and log.last() == (7, {"writer": won[0]})


def files_of(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_a_window_writes_its_partitions_only(spark, tmp_path):
    """A thousand closed 5-minute windows are there; one more run writes the files of its own window."""
    report = sinks.WindowReport(spark, str(tmp_path / "r"), "at", pattern="yyyyMMddHHmm")
    good = spark.createDataFrame([(str(k), True) for k in range(8)], "check_name string, passed boolean")
    rows = lambda a, n: spark.range(a, a + n).selectExpr("timestamp'2026-07-01' + make_interval(0,0,0,0,0,cast(id * 5 as int),0) AS at", "id")
    assert report.publish("all", "2026-07-01 00:00", "2026-07-04 11:20", {"x": rows(0, 1000)}, {"x": 1000}, good) == "published"
    before = files_of(tmp_path / "r/data/x")
    assert report.publish("one", "2026-07-02 00:00", "2026-07-02 00:05", {"x": rows(288, 1).withColumn("id", F.lit(-1))}, {"x": 1}, good) == "published"
    new = files_of(tmp_path / "r/data/x") - before
    assert len(new) == 1 and all("_slot=202607020000" in f for f in new)
    assert report.read("x").agg(F.count("id"), F.sum("id")).first() == (1000, 999 * 500 - 288 - 1)
    state = sinks.Published(spark, str(tmp_path / "r")).state["tables"]["x"]["folders"]
    assert len(state) == 1000


def test_append_merge_and_dml_keep_untouched_folders(spark, tmp_path):
    path, at = str(tmp_path / "t"), tmp_path / "t/data/rows"
    rows = spark.range(40).selectExpr("id", "concat('p +%', id % 4) AS part", "'old' AS v")
    sinks.load(rows, path, "replace", by=["part"])
    first = files_of(at)
    sinks.load(spark.range(100, 104).selectExpr("id", "'p +%1' AS part", "'new' AS v"), path, "append")
    second = files_of(at)
    assert first < second and len({f.split("/")[1] for f in second - first}) == 1
    sinks.load(spark.range(2, 3).selectExpr("id", "'p +%2' AS part", "'merged' AS v"), path, "merge", ["id"])
    state = set(sinks.Published(spark, path).folders())
    assert sum(f.rsplit("/", 1)[0] in state for f in first) == len([f for f in first if not f.split("/")[1].endswith("2")])
    work = sinks.Transaction(spark, path)
    work.update("id = 3", v="'changed'")
    work.delete("v = 'changed' OR id = 103")
    work.insert(spark.range(7, 8).selectExpr("-id AS id", "'p +%0' AS part", "'new' AS v"))
    work.update("id = -7", v="'late'")
    work.commit()
    now = set(sinks.Published(spark, path).folders())
    assert any(f.endswith("0") for f in now & state)  # the partition of -7 keeps its old folder
    got = {r["id"]: r["v"] for r in sinks.published(spark, path).collect()}
    assert got == {**{k: "old" for k in range(40) if k not in (2, 3)}, **{k: "new" for k in range(100, 103)}, 2: "merged", -7: "late"}


def test_old_versions_are_cleaned(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(8):
        sinks.load(spark.range(n + 1).selectExpr("id"), path, "replace")
    assert len(list((tmp_path / "t/data/rows").iterdir())) == 3 and sinks.published(spark, path).count() == 8
    for n in range(40):
        sinks.Published(spark, path).append(spark.range(1).selectExpr("id"))  # never committed: stays out of sight
    assert sinks.published(spark, path).count() == 8


def test_many_appends_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_FOLDERS", 3)
    path = str(tmp_path / "t")
    for n in range(9):
        sinks.load(spark.range(n, n + 1).selectExpr("id"), path, "append")
    assert len(sinks.Published(spark, path).folders()) <= 4 and sorted(r["id"] for r in sinks.published(spark, path).collect()) == list(range(9))


def test_numbers_are_dense_under_adaptive_coalescing(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2000")
    try:
        rows = spark.range(4000).selectExpr("concat('k', id * 7919 % 4000) AS k").repartition(7)
        got = [(r["n"], r["k"]) for r in merge.numbered(rows, ["k"], "n", 0).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got) == list(enumerate(sorted(f"k{i}" for i in range(4000)), 1))


def test_an_emptied_batch_leaves_nothing(spark, tmp_path):
    path, by = str(tmp_path / "b"), ["year", "batch"]
    rows = spark.range(6).selectExpr("id", "2020 + id % 3 AS year", "'b1' AS batch")
    sinks.replace_batch(rows, path, by, {"batch": "b1"})
    sinks.replace_batch(rows.withColumn("batch", F.lit("b2")), path, by, {"batch": "b2"})
    sinks.replace_batch(rows.filter("year = 2021"), path, by, {"batch": "b1"})
    assert spark.read.parquet(path).groupBy("batch").count().orderBy("batch").collect() == [("b1", 2), ("b2", 6)]
    sinks.replace_batch(rows.limit(0), path, by, {"batch": "b1"})
    assert spark.read.parquet(path).count() == 6


def test_window_report_publishes_all_tables_at_once(spark, tmp_path):
    report, column = sinks.WindowReport(spark, str(tmp_path / "r"), "at"), "at"
    rows = lambda *hours: spark.createDataFrame([(h,) for h in hours], "h int").selectExpr("timestamp'2026-07-01' + make_interval(0,0,0,0,h,0,0) AS at", "h")
    good = spark.createDataFrame([(str(k), True) for k in range(8)], "check_name string, passed boolean")
    window = lambda run, a, b, hours, n=None, checks=good: report.publish(run, f"2026-07-01 {a:02}:00", f"2026-07-01 {b:02}:00", {"x": rows(*hours), "y": rows(*hours)}, {"x": len(hours) if n is None else n, "y": len(hours)}, checks)
    with pytest.raises(gates.QualityError):
        window("a", 0, 4, [1, 2], n=3)
    with pytest.raises(gates.QualityError):
        window("a", 0, 4, [1, 2], checks=good.limit(7))
    assert report.read("x") is None
    assert window("a", 0, 4, [1, 2]) == "published" and window("a", 0, 4, [3]) == "already"
    assert window("b", 4, 6, [5, 5]) == "published" and str(report.watermark())[11:13] == "06"
    assert window("c", 0, 4, [0]) == "published" and window("d", 9, 11, [10]) == "published"
    assert sorted(r["h"] for r in report.read("y").collect()) == [0, 5, 5, 10] and report.read("runs").count() == 4
    assert str(report.watermark())[11:13] == "06"  # an old window and one beyond a gap leave it


def test_markers(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/s/minutes")
    n = sinks.markers(spark, f"{tmp_path}/s")
    assert n == 1 and not gates.artifact_gate(spark, n).first()["passed"] and gates.artifact_gate(spark, 2).first()["passed"]


def test_reports_and_their_marker(spark, tmp_path):
    path = str(tmp_path / "report")
    sinks.write_report(spark.range(3), path)
    assert spark.read.json(f"{path}/report").count() == 3 and spark.read.json(f"{path}/run_status").first()["run_status"] == "complete"
    sinks.clear_reports(spark, path)
    assert not sinks.exists(spark, f"{path}/report") and not sinks.exists(spark, f"{path}/run_status")
