"""Data sources, JDBC, keyed state, listeners, pruning, plans, statistics, signatures."""

import json
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from salesflow.operators import inspection
from salesflow.plans import mechanism_queries, registry
from salesflow.sources import feeds, pages, runs, sinks
from salesflow.streaming import progress, service_logs


def write_pages(folder, bodies):
    folder.mkdir(exist_ok=True)
    for n, body in bodies.items():
        (folder / f"p{n}.json").write_text(json.dumps(body))


def page(n, more, *ids):
    return {"data": [{"promotion_id": i, "version": 1} for i in ids], "pagination": {"page": n, "has_next": more}}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9])
def test_a_page_is_a_partition(spark, tmp_path, n):
    pages.register(spark)
    write_pages(tmp_path / "f", {k: page(k, k < n, f"a{k}", f"b{k}") for k in range(1, n + 1)})
    rows = spark.read.format("salesflow_pages").option("url", f"{tmp_path}/f/p{{page}}.json").load()
    assert rows.rdd.getNumPartitions() == n
    assert sorted((r["page"], r["record_index"], r["promotion_id"], r["version"]) for r in rows.collect()) == sorted((k, i, f"{c}{k}", "1") for k in range(1, n + 1) for i, c in enumerate("ab"))


@pytest.mark.parametrize("broken, said", [({2: {"data": None}}, "lacks data"), ({2: page(7, True)}, "lacks data"), ({2: page(2, False)}, "wrongly|missing"), ({3: page(3, True)}, "wrongly|missing|more than")])
def test_pages_that_break_the_contract(spark, tmp_path, broken, said):
    pages.register(spark)
    write_pages(tmp_path / "f", {k: page(k, k < 3) for k in (1, 2, 3)} | broken)
    with pytest.raises(Exception, match=said):
        spark.read.format("salesflow_pages").option("url", f"{tmp_path}/f/p{{page}}.json").option("pages", 3).load().collect()
    with pytest.raises(Exception, match="more than 2"):
        write_pages(tmp_path / "g", {k: page(k, k < 5) for k in range(1, 6)})
        spark.read.format("salesflow_pages").option("url", f"{tmp_path}/g/p{{page}}.json").option("cap", 2).load().collect()


DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_text_key_predicates_split_a_table(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/keys;create=true"
    keys = ["", "a", "zz", "p1", "P-9_x", "é", " ", *(f"p{i}" for i in range(300)), *(f"{i:x}-key" for i in range(100))]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "K string, N int")
    feeds.write_jdbc(rows, url, "KEYS", "overwrite", createTableColumnTypes="K VARCHAR(40)", **DERBY)
    feeds.in_transaction(spark, url, [f'INSERT INTO KEYS VALUES (NULL, {len(keys)})'])
    found = feeds.read_jdbc(spark, url, "KEYS", "K", 4, "derby", **DERBY)
    parts = found.withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r["N"] for r in parts) == list(range(len(keys) + 1))  # complete, and disjoint
    assert len(Counter(r["p"] for r in parts)) == 4 and max(Counter(r["p"] for r in parts).values()) < 0.5 * len(keys)


def test_a_swap_is_all_or_nothing(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/swap;create=true"
    rows = spark.range(5).select(F.col("id").alias("ID"))
    feeds.write_jdbc(rows, url, "T", "overwrite", **DERBY)
    feeds.write_jdbc(rows.filter("ID < 2"), url, "S", "overwrite", **DERBY)
    with pytest.raises(feeds.FeedError):
        feeds.swap_staged(spark, url, "T", "S", 3)  # one row of staging is missing
    count = lambda t: spark.read.jdbc(url, t, properties=DERBY).count()
    assert (count("T"), count("S")) == (5, 2)
    feeds.swap_staged(spark, url, "T", "S", 2)
    assert (count("T"), count("S")) == (2, 0)


@pytest.mark.parametrize(
    "body, within, wanted",
    [
        ("<s:Envelope xmlns:s='u' xmlns:n='v'><s:Body><n:Promotion id='7'><n:promotion_id><![CDATA[p<1>&]]></n:promotion_id><!-- <n:Promotion> --><n:version t='i'>2</n:version></n:Promotion></s:Body></s:Envelope>", ("Body",), [("p<1>&", "2")]),
        ("<Envelope><Body><List><Promotion><promotion_id>a</promotion_id></Promotion><Promotion><promotion_id>b</promotion_id></Promotion></List></Body></Envelope>", ("Body", "List"), [("a", None), ("b", None)]),
        ("<Envelope><Body></Body></Envelope>", ("Body",), []),
    ],
)
def test_soap_is_read_as_xml(spark, body, within, wanted):
    rows = feeds.from_soap(spark.createDataFrame([(body,)], "body string"), within=within).collect()
    assert [(r["promotion_id"], r["version"]) for r in rows] == wanted


@pytest.mark.parametrize("body", ["<Envelope><Body><Fault><faultstring>down</faultstring></Fault></Body></Envelope>", "no <xml", "<Other/>"])
def test_soap_faults(spark, body):
    with pytest.raises(feeds.FeedError):
        feeds.from_soap(spark.createDataFrame([(body,)], "body string"))


def test_variants_keep_what_is_no_json_apart(spark):
    rows = spark.createDataFrame([('{"promotion_id": "a", "discount_value": 2.50, "status": null}',), ("not json",), (None,)], "payload string")
    got = feeds.promotion_fields(feeds.as_variant(rows)).collect()
    assert [(r["promotion_id"], r["discount_value"], r["status"]) for r in got] == [("a", "2.5", None), (None, None, None), (None, None, None)]


def test_dedup_state_is_bounded_by_the_watermark(spark, tmp_path):
    """Ten hours of events in ten batches: the ids of passed hours leave the state."""
    jobs, base = [], tmp_path / "in"
    for hour in range(10):
        rows = spark.range(200).selectExpr(f"concat('e', {hour}, '-', id % 100) AS event_id", f"timestamp'2026-07-01' + make_interval(0,0,0,0,{hour},0,0) AS event_time")
        rows.coalesce(1).write.parquet(f"{base}/{hour}")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/*")
        job = service_logs.deduplicated(source, "10 minutes").writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        job.awaitTermination()
        jobs.append(max(p.stateOperators[0].numRowsTotal for p in job.recentProgress))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1000 and max(jobs) <= 300


def test_a_failed_query_is_reported(spark, tmp_path):
    heard = progress.ProgressLog(spark, f"{tmp_path}/p")
    spark.streams.addListener(heard)
    try:
        spark.range(3).write.parquet(f"{tmp_path}/in")

        def fail(batch, epoch):
            raise RuntimeError("x" * 9000)

        job = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.foreachBatch(fail).queryName("broken").trigger(availableNow=True).start()
        with pytest.raises(Exception):
            job.awaitTermination()
        heard.settled([job])
    finally:
        spark.streams.removeListener(heard)
    row = heard.rows().filter("status = 'failed'").first()
    assert row["query"] == "broken" and len(row["failure"]) == 4000


def test_a_stream_reads_a_folder_table(spark, sf_dir, tmp_path):
    """A table is one file, or a folder of part files as on a cluster."""
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one, many = (sorted(map(tuple, registry.QUERIES["t5_stream_append_report"](spark, d).collect())) for d in (sf_dir, str(tmp_path)))
    assert one == many and len(one) > 100


def test_a_scalar_subquery_prunes_folders(spark, sf_dir):
    rows = mechanism_queries.p5_partition_pruning(spark, sf_dir)
    rows.collect()
    scans = [r for r in inspection.plan_rows(rows).collect() if r["kind"] == "scan" and r["partition_filters"] not in (None, "[]")]
    assert len(scans) == 1 and "ubquery" in scans[0]["partition_filters"]
    years = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.year("o_orderdate")).distinct().count()
    assert 1 <= scans[0]["files"] < years


#: Shuffles of headline queries as planned; one more is a regression.
SHUFFLES = {"a5_global_totals": 4, "a6_filter_group": 5, "a16_requests_per_minute": 1, "m1_discounted_sales": 5, "j1_revenue_by_nation": 5, "a18_status_counts": 1}


def test_headline_plans_gain_no_shuffle(spark, sf_dir):
    found = {}
    for name in SHUFFLES:
        plan = inspection.plan_rows(registry.QUERIES[name](spark, sf_dir)).collect()
        found[name] = sum(r["kind"] == "shuffle" for r in plan)
        assert not any(r["kind"] == "python" for r in plan)
    assert all(found[n] <= SHUFFLES[n] for n in SHUFFLES), found


def test_statistics_change_the_broadcast_side(spark):
    """Without statistics a filtered table looks as large as its files; with histograms the optimizer sees that few rows stay."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.cbo.enabled", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.cbo.enabled", "true")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
        big = spark.range(60_000).selectExpr("id AS k", "IF(id < 59990, id % 10, id) AS v", "id % 3 AS part")
        sinks.save_table(big, "stat_big", ["part"])
        sinks.save_table(spark.range(60_000).selectExpr("id AS k2", "id AS w"), "stat_other")
        join = lambda: spark.table("stat_other").join(spark.table("stat_big").filter("v > 100"), F.col("k") == F.col("k2"))
        before, count = [r["node"] for r in inspection.plan_rows(join()).collect()], join().count()
        for t in ("stat_big", "stat_other"):
            sinks.analyze(spark, t, histograms=True)
        after = [r["node"] for r in inspection.plan_rows(join()).collect()]
        assert "SortMergeJoin" in before and "BroadcastHashJoin" in after and join().count() == count == 10
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
        for t in ("stat_big", "stat_other"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_signatures_have_no_order(spark):
    rows = spark.range(500).selectExpr("id", "IF(id % 7 = 0, NULL, id) AS v")
    sign = lambda df: tuple(inspection.signature(df).first())
    assert sign(rows) == sign(rows.repartition(7).orderBy(F.desc("id")).select("v", "id"))
    assert sign(rows) != sign(rows.unionByName(rows.limit(1))) and sign(rows) != sign(rows.fillna(0)) and sign(rows.limit(0))[0] == 0


def test_the_run_log_survives_retries(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "runs"))
    assert log.start("p", "r1") == 1
    log.end("p", "r1", 1, failure="y" * 5000)
    assert log.start("p", "r1") == 2
    log.end("p", "r1", 2, rows=7)
    log.end("p", "r1", 2, failure="too late")
    assert tuple(log.states().select("status", "attempt", "rows").first()) == ("success", 2, 7)
    assert log.events().agg(F.max(F.length("failure"))).first()[0] == 4000 and log.events().count() == 5


def test_a_hot_leaf_is_split(spark, tmp_path):
    """Nine tenths of the rows are of one leaf: its files are several."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
        rows = spark.range(200_000).repartition(8).selectExpr("id", "sha2(string(id), 256) AS text", "IF(id % 10 = 0, id % 50, 1) AS leaf")
        sinks.overwrite_partitions(rows, f"{tmp_path}/t", ["leaf"])
        hot = list((tmp_path / "t/leaf=1").glob("*.parquet"))
        assert len(hot) >= 4 and spark.read.parquet(f"{tmp_path}/t").count() == 200_000
        assert spark.conf.get("spark.sql.adaptive.coalescePartitions.minPartitionSize") == keep["spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
        shutil.rmtree(tmp_path / "t", True)
