"""Promotions, service logs, streams and run control over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.functions.rules import all_reasons, promotion_rules
from salesflow.operators import control, gates, merge, promotions
from salesflow.operators import logs as log_ops
from salesflow.plans import domain
from salesflow.plans.domain import LOGS, PROMOTIONS, query, table
from salesflow.session import shared_place
from salesflow.sources.sinks import replace_window

big = lambda c: F.col(c).cast("long").alias(c)
text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)

_SALES = """sale AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS purchase_date, CAST(l_extendedprice AS DECIMAL(12,2)) AS item_price,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS freight_value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_LATEST = f"{PROMOTIONS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY version DESC) AS r FROM promotions) WHERE r = 1), live AS (SELECT * FROM newest WHERE status = 'active')"
_DISCOUNT = """CASE WHEN discount_type = 'percentage' THEN LEAST(item_price, CAST(ROUND(CAST(item_price AS DECIMAL(14,4)) * CAST(discount_value * 0.01 AS DECIMAL(14,4)), 2) AS DECIMAL(12,2))) WHEN discount_type = 'fixed' THEN CAST(LEAST(item_price, discount_value) AS DECIMAL(12,2)) ELSE 0 END"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.to_date("o_orderdate").alias("purchase_date"))
    return domain.items(spark, sf_dir).select("order_id", "item_number", "product_id", F.col("price").alias("item_price"), "freight_value").join(o, "order_id")


def _discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return promotions.apply_promotions(_sales(spark, sf_dir), promotions.latest_active(domain.promotions(spark, sf_dir)))


@query(f"WITH {_SALES}, {_LATEST} SELECT coalesce(promotion_id, 'NO_PROMOTION') = 'NO_PROMOTION' AS without_promotion, count(*) AS lines, count(DISTINCT promotion_id) AS promotions FROM sale s LEFT JOIN live p ON s.product_id = p.product_id AND purchase_date BETWEEN starts_on AND ends_on GROUP BY 1")
def j7_promotion_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi and inclusive date-interval join."""
    rows = _discounted(spark, sf_dir)
    none = F.col("promotion_id") == "NO_PROMOTION"
    return rows.groupBy(none.alias("without_promotion")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct(F.when(~none, F.col("promotion_id"))).alias("promotions"))


@query(f"WITH {_SALES}, {_LATEST}, d AS (SELECT coalesce(discount_type, 'none') AS discount_type, item_price, freight_value, {_DISCOUNT} AS discount_amount FROM sale s LEFT JOIN live p ON s.product_id = p.product_id AND purchase_date BETWEEN starts_on AND ends_on) SELECT discount_type, count(*) AS lines, CAST(sum(discount_amount) AS DOUBLE) AS discount, CAST(sum(item_price + freight_value) AS DOUBLE) AS gross, CAST(sum(item_price + freight_value - discount_amount) AS DOUBLE) AS net FROM d GROUP BY 1")
def m1_discounted_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions applied: discount, gross and net by type."""
    return _discounted(spark, sf_dir).groupBy("discount_type").agg(F.count(F.lit(1)).alias("lines"), F.sum("discount_amount").cast("double").alias("discount"), F.sum("gross_amount").cast("double").alias("gross"), F.sum("net_amount").cast("double").alias("net"))


@query(f"WITH {_LATEST} SELECT p_brand AS brand, count(*) AS products, count(promotion_id) AS promoted, CAST(sum(discount_value) AS DOUBLE) AS value FROM part LEFT JOIN newest ON p_partkey = product_id AND product_id % 3 <> 1 GROUP BY 1")
def m2_product_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and their promotions without a date rule, by brand."""
    some = domain.promotions(spark, sf_dir).filter("product_id % 3 <> 1")
    rows = promotions.product_report(domain.products(spark, sf_dir), some)
    return rows.groupBy("brand").agg(F.count(F.lit(1)).alias("products"), F.count_if(F.col("promotion_id") != "NO_PROMOTION").alias("promoted"), F.sum("discount_value").cast("double").alias("value"))


@query(f"WITH {PROMOTIONS} SELECT promotion_id, CAST(version AS BIGINT) AS version, status FROM (SELECT *, row_number() OVER (PARTITION BY promotion_id ORDER BY version DESC) AS r FROM promotions) WHERE r = 1")
def w3_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each promotion."""
    return promotions.latest_version(domain.promotions(spark, sf_dir)).select("promotion_id", big("version"), "status")


@query(f"WITH {_LATEST} SELECT promotion_id, CAST(version AS BIGINT) AS version FROM live")
def w4_latest_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record if active."""
    return promotions.latest_active(domain.promotions(spark, sf_dir)).select("promotion_id", big("version"))


@query(f"WITH {PROMOTIONS} SELECT CAST(version AS BIGINT) AS version, count(*) AS rows FROM promotions WHERE updated_at >= TIMESTAMP '1996-01-05' AND updated_at < TIMESTAMP '1996-01-20' GROUP BY 1")
def m5_incremental_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a half-open window of updates."""
    return promotions.window_of(domain.promotions(spark, sf_dir), "1996-01-05", "1996-01-20").groupBy(big("version")).agg(F.count(F.lit(1)).alias("rows"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion records as text, broken by key, every 29th again on a second page."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("record_index"), F.when(k % 31 != 0, F.concat(F.lit("p"), k)).alias("promotion_id"), k.cast("string").alias("product_id"), F.lit("sale").alias("promotion_name"), F.when(k % 7 == 0, "gift").otherwise("percentage").alias("discount_type"),
        F.when(k % 11 == 0, "150").when(k % 13 == 0, "-5").when(k % 17 == 0, "ten").otherwise("10").alias("discount_value"), F.lit("2026-01-01T00:00:00Z").alias("starts_at"), F.when(k % 19 == 0, "2025-01-01T00:00:00Z").otherwise("2026-02-01T00:00:00Z").alias("ends_at"),
        F.when(k % 23 != 0, "active").alias("status"), F.lit("1").alias("version"), F.lit("2026-01-01T00:00:00Z").alias("updated_at"),
    )
    first, again = rows.withColumn("page", F.lit(1)), rows.filter("record_index % 29 = 0").withColumn("page", F.lit(2))
    return first.unionByName(again)


_REASONS = """concat_ws('; ', CASE WHEN k % 31 = 0 THEN 'promotion_id is required' END, CASE WHEN k % 7 = 0 THEN 'discount_type is unknown' END, CASE WHEN k % 13 = 0 AND k % 11 <> 0 THEN 'discount_value is negative' END, CASE WHEN k % 11 = 0 AND k % 7 <> 0 THEN 'percentage is over 100' END,
  CASE WHEN k % 17 = 0 AND k % 11 <> 0 AND k % 13 <> 0 THEN 'discount_value is not a number' END, CASE WHEN k % 19 = 0 THEN 'starts_at is after ends_at' END, CASE WHEN k % 23 = 0 THEN 'status is required' END)"""


@query(f"SELECT {_REASONS} AS reason, count(*) AS rows FROM (SELECT p_partkey AS k FROM part) GROUP BY 1")
def q2_promotion_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of the promotion contract."""
    rows = _records(spark, sf_dir).filter("page = 1").withColumn("reason", all_reasons(promotion_rules(2)))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query(f"""WITH r AS (SELECT p_partkey AS k, 1 AS nth FROM part UNION ALL SELECT p_partkey, 2 FROM part WHERE p_partkey % 29 = 0), e AS (SELECT nth, {_REASONS} AS reason FROM r) SELECT count(*) AS raw_rows, count(*) FILTER (WHERE reason = '' AND nth = 1) AS accepted, count(*) FILTER (WHERE NOT (reason = '' AND nth = 1)) AS rejected, count(*) FILTER (WHERE nth = 2) AS repeated FROM e""")
def m6_raw_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ingest: errors and payloads repeated in the batch."""
    rows = promotions.classify_batch(_records(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(F.col("is_valid")).alias("accepted"), F.count_if(~F.col("is_valid")).alias("rejected"), F.count_if(F.col("validation_error").contains("duplicate payload")).alias("repeated"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 10 = 0) AS bad FROM part) SELECT * FROM (SELECT 'DQ01_audit_reconciliation' AS check_name, 0::DOUBLE AS actual, true AS passed UNION ALL SELECT 'DQ02_raw_storage_reconciliation', 0, true UNION ALL SELECT 'DQ03_validity_reconciliation', 0, true
UNION ALL SELECT 'DQ04_invalid_rate', bad::DOUBLE / n, bad::DOUBLE / n <= 0.2 FROM c UNION ALL SELECT 'DQ05_incremental_window', count(*)::DOUBLE, count(*) = 0 FROM part WHERE p_partkey % 100 = 1 UNION ALL SELECT 'DQ06_operational_fields', count(*)::DOUBLE, count(*) = 0 FROM part WHERE p_partkey % 50 = 3)""")
def q8_raw_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw gate over promotions with planted faults."""
    k = F.col("product_id")
    raw = domain.products(spark, sf_dir).select((k % 10 != 0).alias("is_valid"), F.when(k % 50 != 3, "active").otherwise("paused").alias("status"), F.when(k % 100 == 1, F.lit("1999-01-01").cast("timestamp")).otherwise(F.lit("1996-06-01").cast("timestamp")).alias("updated_at"))
    audit = raw.agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(F.col("is_valid")).alias("accepted_count"), F.count_if(~F.col("is_valid")).alias("rejected_count"))
    return gates.raw_gate(raw, audit, "1996-01-01", "1997-01-01", 0.2)


@query("""WITH n AS (SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated FROM lineitem) SELECT 'DQ07_curated_audit_reconciliation' AS check_name, 0::DOUBLE AS actual, true AS passed UNION ALL SELECT 'DQ09_nonnegative_discount', 0, true UNION ALL SELECT 'DQ10_net_amount_floor', 0, true UNION ALL SELECT 'DQ11_snapshot_completeness', 0, true
UNION ALL SELECT 'DQ08_unique_curated_grain', repeated, repeated = 0 FROM (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS repeated FROM lineitem)""")
def q9_curated_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated gate over discounted sales whose grain is not unique."""
    curated = _discounted(spark, sf_dir).withColumn("promotion_id", F.col("product_id").cast("string"))
    n = table(spark, sf_dir, "lineitem").count()
    return gates.curated_gate(curated.withColumn("promotion_version", F.lit(1)), n, n)


@query(f"WITH {LOGS} SELECT strftime(date_trunc('minute', event_time), '%Y-%m-%d %H:%M') AS minute_start, service, count(*) AS request_count, round(sum(latency_ms)::DOUBLE / count(*), 3) AS avg_latency_ms, CAST(max(latency_ms) AS BIGINT) AS max_latency_ms FROM logs GROUP BY 1, 2")
def a16_requests_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by minute and service."""
    return log_ops.minute_report(domain.logs(spark, sf_dir)).select(text("minute_start"), "service", "request_count", "avg_latency_ms", big("max_latency_ms"))


@query(f"WITH {LOGS} SELECT strftime(date_trunc('minute', event_time), '%Y-%m-%d %H:%M') AS minute_start, service, count(*) AS request_count, round(sum(latency_ms)::DOUBLE / count(*), 3) AS avg_latency_ms, CAST(max(latency_ms) AS BIGINT) AS max_latency_ms FROM logs GROUP BY 1, 2")
def a17_live_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four epochs' partials, of one that was written twice the last attempt, merged: as one pass over all events."""
    tries = F.when(F.col("event_id") % 4 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    events = domain.logs(spark, sf_dir).withColumns({"epoch": F.col("event_id") % 4, "attempt": F.explode(tries)})
    parts = log_ops.partials(events, "epoch", "attempt")
    held = parts.groupBy("epoch", "minute_start", "service").agg(F.max_by(F.struct(*log_ops.PARTIAL), "attempt").alias("p")).select("epoch", "minute_start", "service", "p.*")
    return log_ops.live_view(held).select(text("minute_start"), "service", "request_count", "avg_latency_ms", big("max_latency_ms"))


@query(f"WITH {LOGS} SELECT strftime(date_trunc('minute', event_time), '%Y-%m-%d %H:%M') AS minute_start, service, CAST(status_code AS BIGINT) AS status_code, count(*) AS request_count FROM logs GROUP BY 1, 2, 3")
def a18_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by minute, service and status."""
    return log_ops.status_report(domain.logs(spark, sf_dir)).select(text("minute_start"), "service", big("status_code"), "request_count")


@query(f"WITH {LOGS}, c AS (SELECT date_trunc('day', event_time) AS d, service, status_code, count(*) AS n FROM logs GROUP BY 1, 2, 3) SELECT strftime(d, '%Y-%m-%d %H:%M') AS minute_start, service, CAST(status_code AS BIGINT) AS status_code, round(CAST(n * 100.0 AS DOUBLE) / sum(n) OVER (PARTITION BY d, service), 3) AS percentage FROM c")
def w5_status_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each status' share of its day and service."""
    days = domain.logs(spark, sf_dir).withColumn("event_time", F.date_trunc("day", "event_time"))
    return log_ops.status_report(days).select(text("minute_start"), "service", big("status_code"), "percentage")


_FIRST = "CASE WHEN k % 11 = 0 THEN 'malformed_json' WHEN k % 13 = 0 THEN 'invalid_or_missing_ts' WHEN k % 23 = 0 THEN 'missing_path' WHEN k % 17 = 0 THEN 'invalid_status_code' WHEN k % 19 = 0 THEN 'invalid_latency_ms' END"
_ALL = """CASE WHEN k % 11 = 0 THEN 'event_id is required; event_time is invalid; service is required; method is invalid; path is required; status_code is invalid; latency_ms is required' ELSE
  concat_ws('; ', CASE WHEN k % 13 = 0 THEN 'event_time is invalid' END, CASE WHEN k % 23 = 0 THEN 'path is required' END, CASE WHEN k % 17 = 0 THEN 'status_code is invalid' END, CASE WHEN k % 19 = 0 THEN 'latency_ms is negative' END, CASE WHEN k % 13 <> 0 AND ts < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 120 SECOND THEN 'event is later than allowed' END) END"""


@query(f"SELECT coalesce({_FIRST}, '') AS reason, count(*) AS rows FROM (SELECT event_id AS k FROM events) GROUP BY 1")
def t1_classify_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First log contract: one prioritised reason."""
    return log_ops.classify_v1(domain.raw_logs(spark, sf_dir)).groupBy(F.coalesce("rejection_reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"SELECT {_ALL} AS reason, count(*) AS rows FROM (SELECT event_id AS k, ts FROM events) GROUP BY 1")
def t2_classify_all_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second log contract: every reason, and lateness."""
    rows = log_ops.classify_v2(domain.raw_logs(spark, sf_dir), 120, F.lit("2024-01-05 00:00:00").cast("timestamp"))
    return rows.groupBy(F.col("validation_error").alias("reason")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"""SELECT count(*) AS processed_records, count(*) FILTER (WHERE reason IS NULL) AS accepted_records, count(*) FILTER (WHERE reason IS NOT NULL) AS rejected_records, round(count(*) FILTER (WHERE reason IS NOT NULL)::DOUBLE / count(*), 6) AS rejection_ratio FROM (SELECT {_FIRST} AS reason FROM (SELECT event_id AS k FROM events))""")
def a20_accept_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, rejected and their ratio."""
    return log_ops.acceptance(log_ops.classify_v1(domain.raw_logs(spark, sf_dir)))


_WINDOW = """SELECT strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M') AS window_start, service, CAST(status_code AS BIGINT) AS status_code, count(*) AS requests, CAST(max(latency_ms) AS BIGINT) AS max_latency_ms, status_code >= 500 AS is_error FROM logs"""


@query(f"WITH {LOGS} {_WINDOW} GROUP BY date_trunc('hour', event_time), service, logs.status_code")
def t4_window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows by service and status."""
    rows = log_ops.window_report(domain.logs(spark, sf_dir), "1 hour")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("window_start"), "service", big("status_code"), "requests", big("max_latency_ms"), "is_error")


@query(f"""WITH {LOGS}, closed AS (SELECT date_trunc('minute', max(event_time) - INTERVAL 60 SECOND) AS mark, max(event_time) - INTERVAL 60 SECOND AS watermark FROM logs)
SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d %H:%M') AS window_start, service, CAST(status_code AS BIGINT) AS status_code, count(*) AS requests FROM logs WHERE date_trunc('day', event_time) + INTERVAL 1 DAY <= (SELECT watermark FROM closed) GROUP BY 1, 2, 3""")
def t5_stream_append_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's windowed report in append mode: windows that the watermark has passed. The files of the events table are a
    stream, all available once, and the emitted windows are read back."""
    from salesflow.streaming.service_logs import windowed

    base, source = shared_place(spark, "stream"), domain.table_stream(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "error", 500).when(kind == "signup", 201).when(kind == "click", 302).otherwise(200)
    typed = source.select(F.col("ts").cast("timestamp").alias("event_time"), F.concat(F.lit("svc"), F.col("user_id") % 3).alias("service"), status.alias("status_code"), F.floor(F.abs("value")).cast("int").alias("latency_ms"), F.lit(True).alias("is_valid"), F.lit(None).cast("string").alias("rejection_reason"))
    job = windowed(typed, "60 seconds", "1 day").writeStream.format("parquet").outputMode("append").option("path", f"{base}/report").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    rows = spark.read.schema("window_start timestamp, window_end timestamp, service string, status_code int, requests long, avg_latency_ms double, max_latency_ms int, is_error boolean").parquet(f"{base}/report")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "service", big("status_code"), "requests")


@query(f"""WITH {LOGS}, minutes AS (SELECT date_trunc('minute', event_time) AS m, service, count(*) AS n FROM logs GROUP BY 1, 2), statuses AS (SELECT date_trunc('minute', event_time) AS m, service, status_code, count(*) AS n FROM logs GROUP BY 1, 2, 3),
audit AS (SELECT (SELECT count(*) FROM logs) + 1 AS source_count, (SELECT count(*) FROM minutes) AS minute_count, (SELECT count(*) FROM statuses) AS status_count),
shares AS (SELECT m, service, sum(round(100.0 * s.n / g.n, 3)) AS p FROM statuses s JOIN minutes g USING (m, service) GROUP BY 1, 2),
v AS (SELECT 'LOG_DQ01_minute_audit' AS check_name, (SELECT count(*) FROM minutes) - minute_count AS actual FROM audit
UNION ALL SELECT 'LOG_DQ02_status_audit', (SELECT count(*) FROM statuses) - status_count FROM audit
UNION ALL SELECT 'LOG_DQ03_request_reconciliation', (SELECT sum(n) FROM minutes) - source_count FROM audit
UNION ALL SELECT 'LOG_DQ04_status_reconciliation', (SELECT sum(n) FROM statuses) - source_count FROM audit
UNION ALL SELECT 'LOG_DQ05_unique_grain', (SELECT count(*) - count(DISTINCT (m, service)) FROM minutes) + (SELECT count(*) - count(DISTINCT (m, service, status_code)) FROM statuses)
UNION ALL SELECT 'LOG_DQ06_valid_domain', (SELECT count(*) FROM minutes WHERE m < TIMESTAMP '2024-01-02' OR m >= TIMESTAMP '2030-01-01') + (SELECT count(*) FROM statuses WHERE status_code NOT BETWEEN 100 AND 599)
UNION ALL SELECT 'LOG_DQ07_status_percentage', (SELECT count(*) FROM shares WHERE abs(p - 100) > 0.01))
SELECT check_name, actual::DOUBLE AS actual, actual = 0 AS passed FROM v""")
def q11_log_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log gate: the audit counts one event too many, and the window starts a day late."""
    events = domain.logs(spark, sf_dir)
    minutes, statuses = log_ops.minute_report(events), log_ops.status_report(events)
    audit = events.agg((F.count(F.lit(1)) + 1).alias("source_count")).crossJoin(minutes.agg(F.count(F.lit(1)).alias("minute_count"))).crossJoin(statuses.agg(F.count(F.lit(1)).alias("status_count")))
    return gates.log_gate(minutes, statuses, audit, "2024-01-02", "2030-01-01")


@query(f"WITH {LOGS} SELECT count(*) AS minutes, (SELECT count(*) FROM (SELECT m, service, sum(n) AS t FROM (SELECT date_trunc('minute', event_time) AS m, service, status_code, count(*) AS n FROM logs GROUP BY 1, 2, 3) GROUP BY 1, 2) x JOIN (SELECT date_trunc('minute', event_time) AS m, service, count(*) AS t FROM logs GROUP BY 1, 2) y USING (m, service) WHERE x.t <> y.t) AS differing FROM (SELECT DISTINCT date_trunc('minute', event_time), service FROM logs)")
def a27_report_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of two reports agree."""
    events = domain.logs(spark, sf_dir)
    minutes = log_ops.minute_report(events)
    off = log_ops.reconcile(minutes, log_ops.status_report(events)).agg(F.count(F.lit(1)).alias("differing"))
    return minutes.agg(F.count(F.lit(1)).alias("minutes")).crossJoin(off)


@query("""SELECT CAST(o_orderkey AS BIGINT) AS order_id, CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'staged' ELSE 'old' END AS state FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 2 = 0)""")
def k17_window_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed window replaced by staged rows (the odd orders); rows staged outside the window do not enter."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderdate", F.lit("old").alias("state"))
    staged = old.filter("order_id % 2 = 1").withColumn("state", F.lit("staged"))
    return replace_window(old, staged, "o_orderdate", "1997-01-01", "1998-01-01").select("order_id", "state")


@query(f"""WITH {LOGS}, kept AS (SELECT date_trunc('minute', event_time) AS m, service, count(*) AS n FROM logs GROUP BY 1, 2), bounds AS (SELECT date_trunc('day', min(event_time)) AS a, date_trunc('day', min(event_time)) + INTERVAL 10 DAY AS b, date_trunc('day', max(event_time)) + INTERVAL 1 DAY AS c FROM logs)
SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute_start, service, n AS request_count, 'published already published' AS outcomes, strftime(c, '%Y-%m-%d %H:%M') AS watermark FROM kept, bounds""")
def k17_window_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both log reports published window by window, the first window twice: its second run changes nothing."""
    from salesflow.sources.sinks import WindowReport

    logs, report = domain.logs(spark, sf_dir), WindowReport(spark, shared_place(spark, "windows"), "minute_start", pattern="yyyyMMdd")
    first, last = _span(logs)
    middle = spark.range(1).select(F.date_format(F.lit(first).cast("timestamp") + F.expr("INTERVAL 10 DAY"), "yyyy-MM-dd HH:mm:ss").alias("t")).first()["t"]
    outcomes = []
    for run, start, end in (("a", first, middle), ("a", first, middle), ("b", middle, last)):
        own = logs.filter((F.col("event_time") >= F.lit(start).cast("timestamp")) & (F.col("event_time") < F.lit(end).cast("timestamp")))
        staged = {"minutes": log_ops.minute_report(own), "statuses": log_ops.status_report(own)}
        audited = {part: rows.count() for part, rows in staged.items()}
        audit = own.agg(F.count(F.lit(1)).alias("source_count")).select("source_count", F.lit(audited["minutes"]).alias("minute_count"), F.lit(audited["statuses"]).alias("status_count"))
        checks = gates.log_gate(staged["minutes"], staged["statuses"], audit, start, end).unionByName(gates.artifact_gate(spark, 2))
        outcomes.append(report.publish(run, start, end, staged, audited, checks))
    mark = F.lit(report.watermark()).cast("timestamp")
    return report.read("minutes").select(text("minute_start"), "service", "request_count", F.lit(" ".join(outcomes)).alias("outcomes"), F.date_format(mark, "yyyy-MM-dd HH:mm").alias("watermark"))


def _span(logs: DataFrame) -> tuple[str, str]:
    """The first day of some logs, and the day after the last one."""
    day = logs.agg(F.date_trunc("day", F.min("event_time")).alias("a"), (F.date_trunc("day", F.max("event_time")) + F.expr("INTERVAL 1 DAY")).alias("b"))
    return tuple(day.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("a", "b"))).first())


@query("""WITH runs AS (SELECT event_type AS pipeline, event_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 'running' WHEN event_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status, ts AS started_at, CASE WHEN event_id % 5 <> 0 THEN ts + to_seconds(CAST(event_id % 600 AS INT)) END AS finished_at, CAST(event_id AS BIGINT) AS rows FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) AS r FROM runs WHERE status <> 'running') WHERE r = 1)
SELECT t.pipeline, running, last_success_at, CASE WHEN l.status = 'success' THEN 1 ELSE 0 END::BIGINT AS last_run_success, CAST(floor(epoch(l.finished_at)) - floor(epoch(l.started_at)) AS BIGINT) AS duration_seconds, l.rows, CASE WHEN l.run_id % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS failed_checks
FROM (SELECT pipeline, count(*) FILTER (WHERE status = 'running') AS running, CAST(max(floor(epoch(finished_at))) FILTER (WHERE status = 'success') AS BIGINT) AS last_success_at FROM runs GROUP BY 1) t JOIN last l USING (pipeline)""")
def c6_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each pipeline: running, last success, and duration, rows and failed checks of its last ended run."""
    k, events = F.col("event_id"), table(spark, sf_dir, "events")
    finished = F.when(k % 5 != 0, F.col("ts") + F.make_interval(secs=(k % 600).cast("decimal(18,6)")))
    runs = events.select(F.col("event_type").alias("pipeline"), k.alias("run_id"), F.when(k % 5 == 0, "running").when(k % 3 == 0, "failed").otherwise("success").alias("status"), F.col("ts").alias("started_at"), finished.alias("finished_at"), k.alias("rows"))
    checks = events.select(k.alias("run_id"), F.explode(F.array((k % 4 != 0), F.lit(True))).alias("passed"))
    return control.run_metrics(runs, checks, F.current_timestamp())


@query("SELECT CASE WHEN event_id % 3 <> 0 AND event_id % 4 = 0 THEN 'quality_failed' WHEN event_id % 3 = 0 THEN 'success' ELSE 'running' END AS status, count(*) AS runs FROM events GROUP BY 1")
def q12_quality_failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose checks failed leave the running state; a success stays."""
    k, events = F.col("event_id"), table(spark, sf_dir, "events")
    runs = events.select(k.alias("run_id"), F.when(k % 3 == 0, "success").otherwise("running").alias("status"))
    return control.quality_failed(runs, events.select(k.alias("run_id"), (k % 4 != 0).alias("passed"))).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


_HOURS = "SELECT event_type AS pipeline, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end FROM events GROUP BY ALL"


@query(f"""WITH w AS ({_HOURS}), m AS (SELECT event_type AS pipeline, TIMESTAMP '2024-01-10' AS watermark FROM events WHERE event_type <> 'click' GROUP BY 1), due AS (SELECT w.pipeline, max(window_end) AS reached FROM w LEFT JOIN m USING (pipeline) WHERE m.watermark IS NULL OR window_start <= m.watermark GROUP BY 1)
SELECT pipeline, strftime(greatest(watermark, reached), '%Y-%m-%d %H:%M') AS watermark FROM m FULL JOIN due USING (pipeline)""")
def c4_watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks move forward over windows that start at or before them."""
    day = F.date_trunc("day", "ts")
    windows = table(spark, sf_dir, "events").select(F.col("event_type").alias("pipeline"), day.alias("window_start"), (day + F.expr("INTERVAL 1 DAY")).alias("window_end")).distinct().withColumn("run_id", F.lit("r"))
    marks = table(spark, sf_dir, "events").filter("event_type <> 'click'").select(F.col("event_type").alias("pipeline"), F.lit("2024-01-10").cast("timestamp").alias("watermark")).distinct()
    return control.advance_watermarks(marks, windows).select("pipeline", text("watermark"))


_RUNS = """runs AS (SELECT event_type AS pipeline, user_id AS run_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 7 = 0 THEN 'success' ELSE 'running' END AS status, CAST(event_id % 4 + 1 AS INT) AS attempt, CAST(event_id AS BIGINT) AS rows FROM events)"""


def _run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("pipeline"), F.col("user_id").alias("run_id"), k.alias("seq"), F.when(k % 3 == 0, "failed").when(k % 7 == 0, "success").otherwise("running").alias("status"), (k % 4 + 1).cast("int").alias("attempt"), k.alias("rows"))


@query(f"""WITH {_RUNS}, s AS (SELECT *, row_number() OVER (PARTITION BY pipeline, run_id ORDER BY CASE WHEN status = 'success' THEN 1 ELSE 0 END DESC, seq DESC) AS r FROM runs) SELECT pipeline, run_id, status, (SELECT CAST(max(attempt) AS BIGINT) FROM runs x WHERE x.pipeline = s.pipeline AND x.run_id = s.run_id) AS attempt, rows FROM s WHERE r = 1""")
def c5_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run states from events: a failure never overrides a success."""
    return control.run_states(_run_events(spark, sf_dir)).select("pipeline", "run_id", "status", big("attempt"), "rows")


@query(f"""WITH {_RUNS}, s AS (SELECT *, row_number() OVER (PARTITION BY pipeline, run_id ORDER BY CASE WHEN status = 'success' THEN 1 ELSE 0 END DESC, seq DESC) AS r FROM runs) SELECT pipeline, status, count(*) AS runs, CAST(sum(rows) AS BIGINT) AS rows FROM s WHERE r = 1 GROUP BY 1, 2""")
def c6_pipeline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by pipeline and state."""
    return control.pipeline_metrics(control.run_states(_run_events(spark, sf_dir)))


@query("""WITH m AS (SELECT event_type || user_id AS pipeline, count(*) FILTER (WHERE event_id % 3 = 0) AS failed_checks, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_at, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1), n AS (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) AS now FROM events)
SELECT pipeline, 'PipelineDataQualityFailed' AS alert FROM m WHERE failed_checks > 0 UNION ALL SELECT pipeline, 'PipelineStale' FROM m, n WHERE now - last_at > 93600 UNION ALL SELECT pipeline, 'LogStreamStopped' FROM m, n WHERE now - last_at > 75 UNION ALL SELECT pipeline, 'LogReportStale' FROM m, n WHERE now - last_at > 420
UNION ALL SELECT pipeline, 'LogIngestionDelayExceeded' FROM m WHERE n > 60 UNION ALL SELECT pipeline, 'PipelineLastRunFailed' FROM m WHERE n % 2 = 0""")
def c9_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as rows of conditions that hold; times are whole Unix seconds, fractions cut."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.unix_seconds(F.max("ts")).alias("now"))
    at = F.unix_seconds(F.max("ts"))
    m = events.groupBy(F.concat("event_type", "user_id").alias("pipeline")).agg(F.count_if(F.col("event_id") % 3 == 0).alias("failed_checks"), at.alias("last_success_at"), at.alias("last_batch_at"), at.alias("last_report_at"), F.count(F.lit(1)).alias("lag_seconds"), (F.count(F.lit(1)) % 2).alias("last_run_success"), F.lit(0).alias("invalid_records"))
    return control.alerts(m.crossJoin(F.broadcast(now)))


@query("""WITH b AS (SELECT event_type || user_id AS query, event_id, ts, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), n AS (SELECT date_trunc('second', max(ts)) AS now FROM events)
SELECT query, CASE WHEN event_id % 3 = 0 AND floor(epoch(now))::BIGINT - floor(epoch(ts))::BIGINT > 120 THEN 'stuck' WHEN event_id % 3 = 1 THEN 'failed' WHEN floor(epoch(now))::BIGINT - floor(epoch(ts))::BIGINT > 90 THEN 'stopped' WHEN event_id % 100 > 60 THEN 'lagging' ELSE 'healthy' END AS verdict FROM b, n WHERE r = 1""")
def c8_stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each query's last batch."""
    events = table(spark, sf_dir, "events")
    now = events.select(F.date_trunc("second", F.max("ts"))).scalar()
    k = F.col("event_id")
    batches = events.select(F.concat("event_type", "user_id").alias("query"), k.alias("batch_id"), F.col("ts").alias("updated_at"), F.when(k % 3 == 0, "running").when(k % 3 == 1, "failed").otherwise("success").alias("status"), (k % 100).alias("lag_seconds"))
    return control.stream_health(batches, now)


@query("""WITH g AS (SELECT user_id AS query, event_id AS generation, event_type = 'click' AS is_active, event_id % 50 - 1 AS last_success FROM events), r AS (SELECT *, max(is_active::INT) OVER (PARTITION BY query) = 1 AS any_active, row_number() OVER (PARTITION BY query ORDER BY is_active DESC, generation DESC) AS n, row_number() OVER (PARTITION BY query ORDER BY last_success DESC, generation DESC) AS f FROM g)
SELECT query, generation FROM r WHERE CASE WHEN any_active THEN n = 1 ELSE f = 1 AND last_success >= 0 END""")
def w7_generation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One active generation for each query."""
    g = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("generation"), (F.col("event_type") == "click").alias("is_active"), (F.col("event_id") % 50 - 1).alias("last_success"), F.lit(None).cast("timestamp").alias("updated_at"))
    return control.repair_generations(g).filter("is_active").select("query", "generation")


@query("""SELECT event_type AS pipeline, last(user_id ORDER BY ts, event_id) AS run FROM events GROUP BY 1""")
def w8_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run of each pipeline."""
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("pipeline"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.col("user_id").alias("run"))
    return control.latest_runs(runs).select("pipeline", "run")


@query("""SELECT f.format, s.rows, s.value FROM (SELECT unnest(['csv', 'parquet', 'orc']) AS format) f, (SELECT count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value FROM orders) s""")
def q15_format_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows written as CSV, Parquet and ORC read back alike."""
    from salesflow.sources.sinks import write_formats

    path, schema = shared_place(spark, "formats"), "order_id long, total decimal(12,2), order_year int"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), domain.money("o_totalprice").alias("total"), F.year("o_orderdate").alias("order_year"))
    write_formats(rows.repartition("order_year"), path, ["order_year"])
    out = None
    for fmt in ("csv", "parquet", "orc"):
        own = spark.read.schema(schema).option("header", True).format(fmt).load(f"{path}/{fmt}")
        part = own.agg(F.count(F.lit(1)).alias("rows"), F.sum("total").cast("double").alias("value")).select(F.lit(fmt).alias("format"), "rows", "value")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH ok AS (SELECT date_trunc('minute', ts) AS m, 'svc' || user_id % 3 AS service, CAST(floor(abs(value)) AS INT) AS latency_ms FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0)
SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute_start, service, count(*) AS request_count, round(sum(latency_ms)::DOUBLE / count(*), 3) AS avg_latency_ms, CAST(max(latency_ms) AS BIGINT) AS max_latency_ms FROM ok GROUP BY m, service""")
def t10_epoch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs, the second of which breaks after its raw write and is tried again, and a replay: each event counts once."""
    from salesflow.streaming.service_logs import epoch_writer, live_report

    # events keep their order and distances of arrival, sixty times as dense: a month falls into 144 leaves of five minutes
    dense = F.timestamp_seconds(F.unix_micros("timestamp") / 60e6)
    base, raw = shared_place(spark, "epochs"), domain.raw_logs(spark, sf_dir).withColumn("timestamp", dense)
    broken = []

    def fail(step: str, epoch: int) -> None:
        if step == "raw" and epoch == 1 and not broken:
            broken.append(epoch)
            raise RuntimeError("lost after the raw write")

    process = epoch_writer(spark, base, "g1", max_delay_seconds=100 * 366 * 86_400, fail=fail)
    for epoch in (0, 1, 1, 1):
        try:
            process(raw.filter(F.col("offset") % 2 == epoch), epoch)
        except RuntimeError:
            pass
    return live_report(spark, base).select(text("minute_start"), "service", "request_count", "avg_latency_ms", big("max_latency_ms"))


@query(f"""WITH {LOGS}, minutes AS (SELECT date_trunc('minute', event_time) AS m, service, count(*) AS request_count, max(latency_ms) AS max_latency_ms FROM logs GROUP BY 1, 2)
SELECT strftime(m, '%Y-%m-%d %H:%M') AS minute_start, service, request_count, CAST(max_latency_ms AS BIGINT) AS max_latency_ms, 'published already' AS outcomes FROM minutes""")
def k18_atomic_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both log reports of all events, staged and published by one rename; a second try finds it done. The published minutes."""
    from salesflow.sources.sinks import publish_artifact

    base, logs = shared_place(spark, "artifact"), domain.logs(spark, sf_dir)
    log_ops.minute_report(logs).write.parquet(f"{base}/staging/minutes")
    log_ops.status_report(logs).write.parquet(f"{base}/staging/statuses")
    outcomes = " ".join(publish_artifact(spark, f"{base}/staging", f"{base}/published/run") for _ in range(2))
    rows = spark.read.parquet(f"{base}/published/run/minutes")
    return rows.select(text("minute_start"), "service", "request_count", big("max_latency_ms"), F.lit(outcomes).alias("outcomes"))


_GENERATIONS = "generations AS (SELECT DISTINCT user_id AS generation, user_id % 10 AS lineage, user_id = 7 AS is_active FROM events)"


@query(f"""WITH {_GENERATIONS}, {LOGS} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS minute_start, count(*) AS request_count FROM events WHERE user_id IN (SELECT generation FROM generations WHERE lineage IN (SELECT lineage FROM generations WHERE is_active)) GROUP BY date_trunc('day', ts)""")
def j12_active_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of every generation in the lineage of the active one."""
    events = table(spark, sf_dir, "events")
    u = F.col("user_id")
    generations = events.select(u.alias("generation"), (u % 10).alias("lineage"), (u == 7).alias("is_active")).distinct()
    rows = events.groupBy(u.alias("generation"), F.date_trunc("day", "ts").alias("minute_start")).agg(F.count(F.lit(1)).alias("n"))
    return control.active_contributions(rows, generations).groupBy(text("minute_start")).agg(F.sum("n").alias("request_count"))


@query(f"""SELECT count(*) AS raw_count, count(*) FILTER (WHERE reason IS NULL) AS valid_count, strftime(max(ts) FILTER (WHERE k % 11 <> 0 AND k % 13 <> 0), '%Y-%m-%d %H:%M') AS max_event_time, strftime(min(ts) FILTER (WHERE reason IS NULL), '%Y-%m-%d %H:%M') AS oldest_valid_event FROM (SELECT ts, k, {_FIRST} AS reason FROM (SELECT ts, event_id AS k FROM events))""")
def a19_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and valid counts, latest event, oldest valid event."""
    rows = log_ops.batch_stats(log_ops.classify_v1(domain.raw_logs(spark, sf_dir)))
    return rows.select("raw_count", "valid_count", text("max_event_time"), text("oldest_valid_event"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def w6_duplicate_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of duplicates, the lowest id stays."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return merge.latest(rows, ["user_id", "event_type"], [F.col("event_id")])


@query("""WITH b AS (SELECT event_type AS query, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type <> 'view'), q AS (SELECT DISTINCT event_type AS query FROM events)
SELECT q.query, coalesce(event_id % 100, 0) AS lag_seconds, coalesce(CAST(floor(epoch(ts)) AS BIGINT), 0) AS last_batch_at, coalesce(CAST(event_id % 2 = 0 AS BIGINT), 0) AS last_batch_success, coalesce(event_id % 7, 0) AS invalid_records FROM q LEFT JOIN b ON q.query = b.query AND r = 1""")
def c7_stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-batch figures of each query, 0 for one that never ran."""
    events, k = table(spark, sf_dir, "events"), F.col("event_id")
    batches = events.filter("event_type <> 'view'").select(F.col("event_type").alias("query"), k.alias("batch_id"), F.col("ts").alias("updated_at"), (k % 100).alias("lag_seconds"), F.when(k % 2 == 0, "success").otherwise("failed").alias("status"), (k % 7).alias("invalid"))
    return control.stream_metrics(batches, events.select(F.col("event_type").alias("query")).distinct())


@query("SELECT event_type, count(*) AS events FROM events WHERE ts < TIMESTAMP '2024-01-10 10:05:00' GROUP BY 1")
def c3_settled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before the settled 5-minute slot."""
    return control.settled(table(spark, sf_dir, "events"), "ts", "2024-01-10 10:09:59").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("SELECT count(*) AS source_rows, count(DISTINCT (o_custkey, o_orderpriority)) AS kept FROM orders")
def a13_copies_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in all source columns count once."""
    from salesflow.operators.sales import drop_copies

    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("category"))
    return rows.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(drop_copies(rows).agg(F.count(F.lit(1)).alias("kept")))


@query("""WITH e AS (SELECT event_id % 400 AS event_id, 'svc' || user_id % 3 AS service, date_trunc('hour', ts) AS h FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09') SELECT count(DISTINCT event_id) AS request_count FROM e""")
def t16_closed_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed window counts each event_id once."""
    rows = domain.logs(spark, sf_dir).withColumns({"event_id": F.col("event_id") % 400, "is_valid": F.lit(True)})
    return log_ops.closed_window(rows, "2024-01-03", "2024-01-09").agg(F.count(F.lit(1)).alias("request_count"))
