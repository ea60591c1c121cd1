"""Queries that rest on a mechanism of Spark: data sources, JDBC, keyed state, listeners, pruning, plans, variants."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.functions.rules import all_reasons, promotion_rules
from salesflow.operators import gates, inspection, sales
from salesflow.operators import logs as log_ops
from salesflow.plans import domain
from salesflow.plans.analytics import _SALES_SQL, _curated, _sales
from salesflow.plans.domain import CUSTOMERS, LOGS, PROMOTIONS, money, query, table
from salesflow.plans.feed_queries import _DISCOUNT, _FIRST, _LATEST, _REASONS, _SALES, _discounted, _records
from salesflow.plans.source_queries import PAGE, _count, _orders, _pages
from salesflow.session import shared_place
from salesflow.sources import feeds, files, pages, runs, sinks
from salesflow.streaming import progress, service_logs

# ---------------------------------------------------------------- feeds and databases


@query(f"""WITH {PROMOTIONS} SELECT CAST(product_id // {PAGE} AS BIGINT) AS page, row_number() OVER (PARTITION BY product_id // {PAGE} ORDER BY promotion_id, version) - 1 AS record_index, promotion_id, CAST(version AS BIGINT) AS version, CAST(discount_value AS DOUBLE) AS discount_value FROM promotions""")
def s13_page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a feed through the data source: a task fetches one page and checks it."""
    place, landed = shared_place(spark, "pages"), _pages(spark, sf_dir)
    ends = landed.agg(F.coalesce(F.max("page"), F.lit(0)).alias("last"))
    body = F.to_json(F.struct("data", F.struct("page", (F.col("page") < F.col("last")).alias("has_next")).alias("pagination")))
    landed.crossJoin(ends).select(body.alias("value"), F.col("page").alias("number")).repartition("number").write.partitionBy("number").text(place)
    pages.register(spark)
    rows = spark.read.format("salesflow_pages").option("url", place + "/number={page}").option("first", 0).option("cap", 1_000_000).load()
    return rows.select(F.col("page").cast("long"), F.col("record_index").cast("long"), "promotion_id", F.col("version").cast("long"), F.col("discount_value").cast("double"))


@query(f"WITH {PROMOTIONS} SELECT promotion_id, CAST(version AS BIGINT) AS version, status, CAST(discount_value AS DOUBLE) AS discount_value FROM promotions WHERE version = 1 OR product_id % 2 = 0")
def s8_jdbc_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions staged in a database and put in place in one transaction, twice; read back by hashes of their text key, and
    published. The database is embedded, so all tasks must share the driver's process."""
    url = f"jdbc:derby:{tempfile.mkdtemp(prefix='salesflow-derby-')}/db;create=true"
    own = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "createTableColumnTypes": "PROMOTION_ID VARCHAR(64), STATUS VARCHAR(16)"}
    rows = domain.promotions(spark, sf_dir).select(F.col("promotion_id").alias("PROMOTION_ID"), F.col("version").alias("VERSION"), F.col("status").alias("STATUS"), F.col("discount_value").alias("DISCOUNT_VALUE"))
    key = F.regexp_extract("PROMOTION_ID", "[0-9]+", 0).cast("long")
    feeds.write_jdbc(rows.limit(0), url, "PROMOTIONS", "overwrite", **own)
    for part in (rows.filter("VERSION = 1"), rows.filter((F.col("VERSION") == 1) | (key % 2 == 0))):
        feeds.write_jdbc(part, url, "STAGED", "overwrite", **own)
        feeds.swap_staged(spark, url, "PROMOTIONS", "STAGED", part.count())
    found = feeds.read_jdbc(spark, url, "PROMOTIONS", "PROMOTION_ID", 4, "derby", driver=own["driver"])
    place = shared_place(spark, "jdbc")
    sinks.publish(found.select(*(F.col(c).alias(c.lower()) for c in found.columns)), place)
    return sinks.published(spark, place).select("promotion_id", F.col("version").cast("long"), "status", F.col("discount_value").cast("double"))


@query(f"SELECT {_REASONS} AS reason, count(*) AS rows, CAST(sum(k) AS BIGINT) AS products, count(*) FILTER (WHERE k % 23 <> 0) AS with_status FROM (SELECT p_partkey AS k FROM part) GROUP BY 1")
def f6_variant_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw promotion payloads kept as VARIANT, their ten fields extracted and judged. Numbers come as JSON numbers."""
    rows, names = _records(spark, sf_dir).filter("page = 1"), pages.FIELDS
    number = F.coalesce(F.get_json_object("raw", "$.discount_value").try_cast("int").isNotNull(), F.lit(False))
    payload = F.when(number, F.regexp_replace("raw", r'"discount_value":"(-?\d+)"', r'"discount_value":$1')).otherwise(F.col("raw"))
    raw = rows.select("record_index", F.to_json(F.struct(*names)).alias("raw")).select("record_index", payload.alias("payload"))
    place = shared_place(spark, "payloads")
    feeds.as_variant(raw).select("record_index", "v").write.parquet(place)
    found = feeds.promotion_fields(spark.read.parquet(place)).withColumn("reason", all_reasons(promotion_rules(2)))
    return found.groupBy("reason").agg(_count("rows"), F.sum(F.col("product_id").cast("long")).alias("products"), F.count("status").alias("with_status"))


# ---------------------------------------------------------------- streams


def _landed(spark: SparkSession, rows: DataFrame, place: str, name: str) -> None:
    rows.write.parquet(f"{place}/{name}")


@query("SELECT count(*) AS rows, partition AS source_partition, CAST(min(k) AS BIGINT) AS first_offset, CAST(max(k) AS BIGINT) AS last_offset, count(*) FILTER (WHERE k % 11 = 0) AS unreadable FROM (SELECT event_id AS k, CAST(event_id % 4 AS INT) AS partition FROM events) GROUP BY partition")
def s9_queue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue's messages with their place, from files that have the queue's columns."""
    base = shared_place(spark, "queue")
    _landed(spark, domain.raw_logs(spark, sf_dir), base, "in/first")
    source = log_ops.with_source(feeds.log_stream(spark, f"{base}/in/*"))
    source.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy("source_partition").agg(_count("rows"), F.min("source_offset").alias("first_offset"), F.max("source_offset").alias("last_offset"), F.count_if(F.col("raw_json") == "not-json").alias("unreadable"))


@query(f"WITH {LOGS} SELECT service, count(*) AS requests, count(DISTINCT event_id) AS events, CAST(sum(latency_ms) AS BIGINT) AS latency FROM logs GROUP BY 1")
def t16_live_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event counts once though a third of them comes again, in its own batch or in a later one."""
    base, rows = shared_place(spark, "dedup"), domain.logs(spark, sf_dir).select("event_id", "event_time", "service", "latency_ms")
    first, again = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 3 = 0")
    out = service_logs.deduplicated
    for name, batch in (("a", first.unionByName(again.filter("event_id % 2 = 0"))), ("b", rows.filter("event_id % 2 = 1").unionByName(again))):
        _landed(spark, batch, base, f"in/{name}")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in/*")
        job = out(source, "3650 days").writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        job.awaitTermination()
    kept = spark.read.schema(rows.schema).parquet(f"{base}/out")
    return kept.groupBy("service").agg(_count("requests"), F.countDistinct("event_id").alias("events"), F.sum("latency_ms").alias("latency"))


@query(f"""WITH e AS (SELECT {_FIRST} AS reason FROM (SELECT event_id AS k FROM events)), n AS (SELECT count(*) AS n, count(reason) AS bad FROM e)
SELECT 'processed' AS figure, n AS rows FROM n UNION ALL SELECT 'accepted', n - bad FROM n UNION ALL SELECT 'quarantined', bad FROM n UNION ALL SELECT 'read by metrics', n FROM n UNION ALL SELECT 'read by quarantine', n FROM n UNION ALL SELECT 'read by report', n FROM n UNION ALL SELECT 'ends reported', 6 FROM n""")
def t9_three_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report, quarantine and epoch metrics over one source in two landings, with what a listener heard of them."""
    base, rows = shared_place(spark, "three"), domain.raw_logs(spark, sf_dir)
    heard = progress.ProgressLog(spark, f"{base}/progress")
    spark.streams.addListener(heard)
    try:
        for part in (0, 1):
            _landed(spark, rows.filter(F.col("offset") % 2 == part), base, f"in/{part}")
            jobs = service_logs.start_three(feeds.log_stream(spark, f"{base}/in/*"), base, duration="1 day")
            service_logs.run_until_done(jobs)
            heard.settled(jobs)
    finally:
        spark.streams.removeListener(heard)
    metrics = spark.read.parquet(f"{base}/metrics/*").agg(F.sum("processed_records").alias("processed"), F.sum("accepted_records").alias("accepted"))
    figures = metrics.select(F.inline(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).alias("rows")) for c in metrics.columns))))
    held = spark.read.parquet(f"{base}/quarantine").agg(_count("rows")).select(F.lit("quarantined").alias("figure"), "rows")
    reports = heard.rows()
    read = reports.filter("status = 'success'").groupBy(F.concat(F.lit("read by "), F.split_part("query", F.lit("_"), F.lit(2))).alias("figure")).agg(F.sum("input_rows").alias("rows"))
    ends = reports.filter("status = 'ended'").agg(_count("rows")).select(F.lit("ends reported").alias("figure"), "rows")
    return reduce(DataFrame.unionByName, (figures, held, read, ends))


# ---------------------------------------------------------------- plans, pruning, signatures


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS order_year, o_orderstatus AS order_status, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1, 2")
def p5_partition_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year of orders written by year: the scan reads the folder that a scalar subquery names while it runs."""
    place, rows = shared_place(spark, "years"), _orders(spark, sf_dir).withColumn("order_year", F.year("order_date"))
    sinks.write_partitioned(rows, place, ["order_year"], ("parquet",))
    written = spark.read.parquet(f"{place}/parquet")
    last = rows.select(F.max("order_year")).scalar()
    return written.filter(F.col("order_year") == last).groupBy(F.col("order_year").cast("long").alias("order_year"), "order_status").agg(_count("rows"), F.sum("total").cast("double").alias("total"))


def workloads(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Three workloads whose plans are watched: a full scan, a filter with a group, a join of two large sides with a group."""
    o, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return {
        "full scan": o.agg(_count("rows"), F.sum(money("o_totalprice")).alias("total")),
        "filter and group": o.filter("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(_count("rows")),
        "join and group": items.select("l_orderkey", "l_quantity").join(o.select("o_orderkey", "o_custkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.sum("l_quantity").alias("units")),
    }


@query("SELECT * FROM (VALUES ('full scan', 1, 1, 0, 0), ('filter and group', 1, 1, 0, 1), ('join and group', 2, 2, 1, 2)) t(workload, scans, shuffles, joins, pushed)")
def x4_plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans of three workloads as rows: scans, shuffles, joins, scans with pushed filters. The group on the join's key needs no
    shuffle of its own."""
    return inspection.plan_counts(workloads(spark, sf_dir))


_SIGNED = """h AS (SELECT {label}, sha256(concat_ws('|', {cells})) AS h FROM {rows}), g AS (SELECT {label}, substr(h, 1, 3) AS g, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
SELECT {label}, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(d, '' ORDER BY d)) AS signature FROM g GROUP BY {label}"""


@query("WITH f AS (SELECT unnest(['csv', 'parquet', 'orc']) AS format), " + _SIGNED.format(label="format", cells="order_date, order_id, order_status, total", rows="(SELECT format, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderkey AS order_id, o_orderstatus AS order_status, CAST(o_totalprice AS DECIMAL(12,2)) AS total FROM orders, f)"))
def q15_result_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows written in three formats have one signature when read back."""
    place, rows = shared_place(spark, "signed"), _orders(spark, sf_dir).drop("priority")
    sinks.write_formats(rows, place)
    parts = [inspection.signature(files.read_format(spark, f, f"{place}/{f}", rows.schema)).withColumn("format", F.lit(f)) for f in ("csv", "parquet", "orc")]
    return reduce(DataFrame.unionByName, parts)


_GROSS = "SELECT form, p_type AS product_category, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) + CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS gross FROM lineitem JOIN part ON l_partkey = p_partkey, f GROUP BY ALL"


@query("WITH f AS (SELECT unnest(['dataframe', 'sql', 'rdd']) AS form), " + _SIGNED.format(label="form", cells="gross, lines, product_category", rows=f"({_GROSS})"))
def a3_three_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category summary as DataFrame, SQL and partition sums with reduceByKey: one signature."""
    rows = _curated(spark, sf_dir, "products")
    forms = {"dataframe": sales.category_summary, "sql": sales.category_summary_sql, "rdd": sales.category_summary_rdd}
    return reduce(DataFrame.unionByName, (inspection.signature(form(rows)).withColumn("form", F.lit(name)) for name, form in forms.items()))


# ---------------------------------------------------------------- runs, rejects, summaries, gates


@query("""WITH e AS (SELECT event_type AS pipeline, 'r' || user_id AS run_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'success' ELSE 'running' END AS status, CAST(event_id % 4 + 1 AS INT) AS attempt, CASE WHEN event_id % 3 = 0 THEN least(4000, 50 + event_id % 9000) END AS kept FROM events),
s AS (SELECT pipeline, run_id, max(attempt) AS attempt, arg_max(status, (status = 'success')::INT * 10000000000000 + seq) AS status FROM e GROUP BY 1, 2)
SELECT pipeline, s.status, count(*) AS runs, CAST(sum(s.attempt) AS BIGINT) AS attempts, CAST(sum(k.kept) AS BIGINT) AS failure_chars FROM s JOIN (SELECT pipeline, run_id, coalesce(sum(kept), 0) AS kept FROM e GROUP BY 1, 2) k USING (pipeline, run_id) GROUP BY 1, 2""")
def c5_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events appended in three batches, with failures' texts of at most 4,000 characters; the states of the runs."""
    k = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pipeline"), F.concat(F.lit("r"), F.col("user_id")).alias("run_id"), k.alias("seq"), F.when(k % 3 == 0, "failed").when(k % 7 == 0, "success").otherwise("running").alias("status"), (k % 4 + 1).cast("int").alias("attempt"), k.alias("rows"),
        F.when(k % 3 == 0, F.repeat(F.lit("x"), (50 + k % 9000).cast("int"))).alias("failure"), F.col("ts").alias("at"),
    )
    log = runs.RunLog(spark, shared_place(spark, "runs"))
    for part in range(3):
        log.add(events.filter(k % 5 % 3 == part))
    kept = log.events().groupBy("pipeline", "run_id").agg(F.coalesce(F.sum(F.length("failure")), F.lit(0)).alias("kept"))
    return log.states().join(kept, ["pipeline", "run_id"]).groupBy("pipeline", "status").agg(_count("runs"), F.sum("attempt").alias("attempts"), F.sum("kept").alias("failure_chars"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem), e AS (SELECT concat_ws('; ', CASE WHEN k % 9 = 0 THEN 'quantity must be greater than 0' END, CASE WHEN k % 10 = 0 THEN 'region is required' END) AS reason FROM (SELECT DISTINCT k, CAST(q AS INT) AS q FROM r)) SELECT count(*) AS rejected FROM e WHERE reason <> ''""")
def k6_rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected sales as a dataset of its own, read back."""
    k = F.col("l_orderkey")
    raw = table(spark, sf_dir, "lineitem").select(
        k.cast("string").alias("order_id"), F.lit("2026-06-01").alias("order_date"), F.lit("c").alias("customer_id"), F.lit("n").alias("customer_name"), F.lit("p").alias("product_id"), F.lit("m").alias("product_name"), F.lit("t").alias("category"),
        F.when(k % 9 == 0, F.concat(F.lit("-"), F.col("l_quantity").cast("int"))).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"), F.lit("1.50").alias("unit_price"), F.when(k % 10 != 0, "here").alias("region"),
    )
    _, rejected = sales.split_sales(raw)
    return sinks.write_rejected(rejected, shared_place(spark, "rejected")).filter("rejection_reason <> ''").agg(_count("rejected"))


_SUMMARY = """SELECT '{name}' AS by_what, {column} AS member, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(line_amount) AS DOUBLE) AS revenue, CAST(floor(sum(line_amount) * 100 / count(*) + 0.5) / 100 AS DOUBLE) AS average_line_amount FROM met GROUP BY {column}"""


@query(f"WITH {_SALES_SQL}, {CUSTOMERS}, met AS (SELECT sale.*, region, strftime(order_date, '%Y-%m-%d') AS day FROM sale JOIN customers USING (customer_id)) " + " UNION ALL ".join(_SUMMARY.format(name=n, column=c) for n, c in (("category", "category"), ("region", "region"), ("day", "day"))))
def a1_sales_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five sales metrics, the mean too, by category, region and day."""
    rows = _sales(spark, sf_dir).join(domain.customers(spark, sf_dir).select("customer_id", "region"), "customer_id").withColumn("day", F.col("order_date").cast("string"))
    parts = [sales.sales_summary(rows, c).withColumnRenamed(c, "member").withColumn("by_what", F.lit(c)) for c in ("category", "region", "day")]
    return reduce(DataFrame.unionByName, parts).select("by_what", "member", "orders", "customers", "units_sold", F.col("revenue").cast("double"), F.col("average_line_amount").cast("double"))


@query(f"WITH {_SALES_SQL} SELECT w.part, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units_sold, CAST(coalesce(sum(line_amount), 0) AS DOUBLE) AS revenue FROM (VALUES ('all'), ('none')) w(part) LEFT JOIN sale ON part = 'all' GROUP BY 1")
def a2_sales_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all sales, and of none: zeros."""
    rows = _sales(spark, sf_dir)
    parts = (sales.sales_totals(rows).withColumn("part", F.lit("all")), sales.sales_totals(rows.filter("quantity < 0")).withColumn("part", F.lit("none")))
    return reduce(DataFrame.unionByName, parts).withColumn("revenue", F.col("revenue").cast("double"))


@query("SELECT 'order' AS key, count(*) > count(DISTINCT o_orderkey) AS repeated FROM orders UNION ALL SELECT 'customer', count(*) > count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'customer and day', count(*) > count(DISTINCT (o_custkey, CAST(o_orderdate AS DATE))) FROM orders")
def a11_duplicate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether keys are repeated; each probe ends at the first repeat."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    found = [(name, sales.has_duplicate_key(o, keys)) for name, keys in (("order", ["o_orderkey"]), ("customer", ["o_custkey"]), ("customer and day", ["o_custkey", "day"]))]
    return spark.createDataFrame(found, "key string, repeated boolean")


@query("SELECT CAST(greatest(1, ceil(floor(1073741824 * 1.08) / floor(n * (mean + 42)))) AS BIGINT) AS copies FROM (SELECT count(*) AS n, avg(length(concat_ws(',', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority))) + 1 AS mean FROM orders)")
def a25_copies_for_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many copies of the orders make a gibibyte, from their mean row size."""
    n = sales.copies_for(_orders(spark, sf_dir).select("order_id", "order_status", "priority"), 1 << 30)
    return spark.createDataFrame([(n,)], "copies long")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d') AS ingest_date, strftime(ts, '%H') AS ingest_hour, strftime(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC', '%Y%m%dT%H%MZ') AS rotation_5m, count(*) AS events FROM events GROUP BY 1, 2, 3""")
def t13_rotation_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw hierarchy's day, hour and 5-minute slot of every event, by its arrival."""
    rows = log_ops.classify_v2(domain.raw_logs(spark, sf_dir), 120, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return rows.groupBy("ingest_date", "ingest_hour", "rotation_5m").agg(_count("events"))


@query(f"SELECT service, CAST(greatest(0, epoch(TIMESTAMP '2024-02-01') - floor(epoch(min(ts)))) AS BIGINT) AS lag_seconds FROM (SELECT ts, 'svc' || user_id % 3 AS service, {_FIRST} AS reason FROM (SELECT ts, user_id, event_id AS k FROM events)) WHERE reason IS NULL GROUP BY 1")
def t14_ingestion_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from the oldest valid event of each service to a commit."""
    rows, at = log_ops.classify_v1(domain.raw_logs(spark, sf_dir)), F.lit("2024-02-01").cast("timestamp")
    lags = [log_ops.ingestion_lag(log_ops.batch_stats(rows.filter(F.col("service") == s)), at).select(F.lit(s).alias("service"), F.col("lag_seconds").cast("long")) for s in ("svc0", "svc1", "svc2")]
    return reduce(DataFrame.unionByName, lags)


@query("SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, true AS sizes_agree, 'absent' AS missing FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def s16_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a dataset that has one for each status, and the tables that a base lacks."""
    place, rows = shared_place(spark, "metrics"), _orders(spark, sf_dir)
    rows.repartition("order_status").write.partitionBy("order_status").parquet(f"{place}/orders")
    met = files.file_metrics(spark, f"{place}/orders")
    lacking = ",".join(files.missing_tables(spark, place, ["orders", "absent"]))
    total = spark.read.parquet(f"{place}/orders").agg(_count("rows"))
    agree = (F.col("smallest") > 0) & (F.col("smallest") <= F.col("largest")) & (F.col("bytes") >= F.col("largest")) & (F.col("bytes") <= F.col("largest") * F.col("files"))
    return met.crossJoin(total).select("files", "rows", agree.alias("sizes_agree"), F.lit(lacking).alias("missing"))


@query(f"""SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute_start, service, count(*) AS request_count FROM (SELECT ts, 'svc' || user_id % 3 AS service, event_id AS k, {_FIRST} AS reason FROM (SELECT ts, user_id, event_id, event_id AS k FROM events)) WHERE reason IS NULL AND k % 3 <> 0 GROUP BY date_trunc('minute', ts), service""")
def t12_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of one query: the second starts its own lineage, the third goes on with it; the live report
    counts the last two."""
    dense = F.timestamp_seconds(F.unix_micros("timestamp") / 60e6)
    base, raw = shared_place(spark, "generations"), domain.raw_logs(spark, sf_dir).withColumn("timestamp", dense)
    for k, (generation, epoch) in enumerate((("g1", 0), ("g2", 0), ("g3", 1))):
        service_logs.epoch_writer(spark, base, generation, max_delay_seconds=100 * 366 * 86_400)(raw.filter(F.col("offset") % 3 == k), epoch)
    return service_logs.live_report(spark, base).select(F.date_format("minute_start", "yyyy-MM-dd HH:mm").alias("minute_start"), "service", "request_count")


@query("WITH r AS (SELECT o_orderkey % 500 AS a, o_orderdate AS b, o_custkey % 3 AS c, o_orderstatus AS d, o_orderpriority AS e FROM orders UNION ALL SELECT o_orderkey % 500, o_orderdate, o_custkey % 3, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 4 = 0) SELECT count(*) AS source_rows, count(DISTINCT (a, b, c, d, e)) AS kept FROM r")
def a13_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in all ten source columns count once; a column of another name does not tell rows apart."""
    k, o = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    cells = {"order_id": k % 500, "order_date": F.col("o_orderdate"), "customer_id": F.col("o_custkey") % 3, "customer_name": F.col("o_custkey") % 3, "product_id": F.col("o_orderstatus"), "product_name": F.col("o_orderstatus"), "category": F.col("o_orderpriority"), "quantity": F.lit(1), "unit_price": F.lit(2), "region": F.lit(None).cast("string"), "file": k}
    rows = o.select(*(c.cast("string").alias(n) for n, c in cells.items()))
    both = rows.unionByName(rows.filter(F.col("file").cast("long") % 4 == 0))
    return both.agg(_count("source_rows")).crossJoin(sales.drop_copies(both).agg(_count("kept")))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 10 = 0) AS bad, count(*) FILTER (WHERE p_partkey % 100 = 1) AS early, count(*) FILTER (WHERE p_partkey % 50 = 3) AS paused FROM part),
v AS (SELECT 'DQ01_audit_reconciliation' AS check_name, ((n - bad - 1) + bad - (n + 2))::DOUBLE AS actual FROM c UNION ALL SELECT 'DQ02_raw_storage_reconciliation', n - (n + 2) FROM c UNION ALL SELECT 'DQ03_validity_reconciliation', abs((n - bad) - (n - bad - 1)) + abs(bad - bad) FROM c
UNION ALL SELECT 'DQ05_incremental_window', early FROM c UNION ALL SELECT 'DQ06_operational_fields', paused FROM c) SELECT check_name, actual, actual = 0 AS passed FROM v UNION ALL SELECT 'DQ04_invalid_rate', bad::DOUBLE / (n + 2), bad::DOUBLE / (n + 2) <= 0.05 FROM c""")
def q8_raw_gate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw gate where every check finds a fault: an audit that lost rows, a low threshold, rows out of the window or paused."""
    k = F.col("product_id")
    raw = domain.products(spark, sf_dir).select((k % 10 != 0).alias("is_valid"), F.when(k % 50 != 3, "active").otherwise("paused").alias("status"), F.when(k % 100 == 1, F.lit("1999-01-01").cast("timestamp")).otherwise(F.lit("1996-06-01").cast("timestamp")).alias("updated_at"))
    audit = raw.agg((F.count(F.lit(1)) + 2).alias("raw_count"), (F.count_if(F.col("is_valid")) - 1).alias("accepted_count"), F.count_if(~F.col("is_valid")).alias("rejected_count"))
    return gates.raw_gate(raw, audit, "1996-01-01", "1997-01-01", 0.05)


@query(f"""WITH {_SALES}, {_LATEST}, d AS (SELECT order_id, item_price, freight_value, {_DISCOUNT} AS discount FROM sale s LEFT JOIN live p ON s.product_id = p.product_id AND purchase_date BETWEEN starts_on AND ends_on) SELECT check_name, actual::DOUBLE AS actual, actual = 0 AS passed FROM (
SELECT 'DQ07_curated_audit_reconciliation' AS check_name, count(*) - (count(*) + 3) AS actual FROM d UNION ALL SELECT 'DQ09_nonnegative_discount', count(*) FILTER (WHERE CASE WHEN order_id % 20 = 1 THEN -1 ELSE discount END < 0) FROM d
UNION ALL SELECT 'DQ10_net_amount_floor', count(*) FILTER (WHERE CASE WHEN order_id % 15 = 3 THEN freight_value - 1 ELSE item_price + freight_value - discount END < freight_value) FROM d UNION ALL SELECT 'DQ11_snapshot_completeness', count(*) - (count(*) - 5) FROM d
UNION ALL SELECT 'DQ08_unique_curated_grain', count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) FROM lineitem)""")
def q9_curated_gate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated gate over an audit and a source of other sizes, negative discounts and net amounts under the freight."""
    k = F.col("order_id")
    curated = _discounted(spark, sf_dir).withColumns({"promotion_id": F.col("product_id").cast("string"), "promotion_version": F.lit(1), "discount_amount": F.when(k % 20 == 1, -1).otherwise(F.col("discount_amount")), "net_amount": F.when(k % 15 == 3, F.col("freight_value") - 1).otherwise(F.col("net_amount"))})
    n = F.col("n")
    return gates.curated_gate(curated, n + 3, n - 5)
