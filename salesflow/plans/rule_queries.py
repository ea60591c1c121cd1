"""Rules whose every branch is met: keys without members, status flags, HAVING with a mean, row hashes, run windows, statistics."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.functions.scalar import canonical_hash
from salesflow.operators import control, merge, star
from salesflow.plans import domain
from salesflow.plans.domain import money, query, table
from salesflow.sources import sinks

_NAMED = "CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'canceled' WHEN o_orderkey % 3 = 0 THEN 'unavailable' ELSE 'shipped' END"


@query(f"""WITH o AS (SELECT {_NAMED} AS s FROM orders) SELECT CASE WHEN s = 'delivered' THEN 'completed' WHEN s IN ('canceled', 'unavailable') THEN 'failed' ELSE 'in progress' END AS status_group,
count(DISTINCT s) AS statuses, count(*) AS orders, count(*) FILTER (WHERE s = 'delivered') AS completed, count(*) FILTER (WHERE s = 'canceled') AS cancelled FROM o GROUP BY 1""")
def d3_status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the group and flags of their status, where each group and flag occurs."""
    rows = table(spark, sf_dir, "orders").select(F.expr(_NAMED).alias("order_status"))
    met = rows.join(star.dim_status(rows), "order_status")
    return met.groupBy("status_group").agg(F.countDistinct("order_status").alias("statuses"), F.count(F.lit(1)).alias("orders"), F.count_if("is_completed").alias("completed"), F.count_if("is_cancelled").alias("cancelled"))


@query("""SELECT count(*) FILTER (WHERE o_orderkey % 6 = 0) AS shipping_limit_date_key, count(*) FILTER (WHERE o_custkey % 8 = 0) AS customer_key, count(*) FILTER (WHERE o_custkey % 10 = 0) AS location_key,
count(*) FILTER (WHERE l_partkey % 7 = 0) AS product_key, count(*) FILTER (WHERE l_suppkey % 9 = 0) AS seller_key, count(*) FILTER (WHERE o_orderstatus = 'P') AS status_key, 0::BIGINT AS purchase_date_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def d11_keys_without_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key of the sales fact is UNKNOWN when every dimension lacks members and some dates are missing."""
    o, customers = domain.orders(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_nationkey") + 1).cast("long").alias("location_key"))
    limit = F.when(F.col("order_id") % 6 != 0, F.col("estimated_at")).alias("shipping_limit_at")
    keyed = lambda rows, natural, key: merge.numbered(rows.select(natural).distinct(), [natural], key, 0)
    fact = star.fact_sales(
        domain.items(spark, sf_dir).join(o.select("order_id", limit), "order_id"), o, customers=keyed(customers.filter("customer_id % 8 <> 0"), "customer_id", "customer_key"), locations=customers.filter("customer_id % 10 <> 0"),
        products=keyed(domain.products(spark, sf_dir).filter("product_id % 7 <> 0"), "product_id", "product_key"), sellers=keyed(domain.sellers(spark, sf_dir).filter("seller_id % 9 <> 0"), "seller_id", "seller_key"), statuses=keyed(o.filter("order_status <> 'P'"), "order_status", "status_key"),
    )
    return star.unknown_keys(fact, ["purchase_date_key", "shipping_limit_date_key", "customer_key", "location_key", "product_key", "seller_key", "status_key"])


@query("""WITH m AS (SELECT p_brand AS brand, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT brand, CAST(sum(price) AS DOUBLE) AS revenue, count(DISTINCT l_orderkey) AS orders, CAST(floor(sum(price) * 100 / count(*) + 0.5) / 100 AS DOUBLE) AS average_price
FROM m GROUP BY 1 HAVING sum(price) >= 100000 AND sum(price) >= 1000 * count(*)""")
def a7_having_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of at least 100,000 revenue whose mean price is at least 1,000: revenue, distinct orders, mean price."""
    rows = domain.items(spark, sf_dir).select("order_id", "product_id", "price").join(domain.products(spark, sf_dir).select("product_id", "brand"), "product_id")
    # orders of a brand are made distinct by a group of their own, which sums prices as well: rows are not expanded
    by_order = rows.groupBy("brand", "order_id").agg(F.sum("price").alias("price"), F.count(F.lit(1)).alias("n"))
    brands = by_order.groupBy("brand").agg(F.sum("price").alias("revenue"), F.count(F.lit(1)).alias("orders"), F.sum("n").alias("n"))
    mean = F.round(F.col("revenue") / F.col("n"), 2).cast("double").alias("average_price")
    return brands.filter("revenue >= 100000 AND revenue >= 1000 * n").select("brand", F.col("revenue").cast("double"), "orders", mean)


@query("""SELECT o_orderkey AS order_id, sha256('{"note":' || CASE WHEN o_orderkey % 2 = 0 THEN '"even"' ELSE 'null' END || ',"order_id":' || o_orderkey || ',"status":"' || o_orderstatus || '","total":"' || CAST(o_totalprice AS DECIMAL(12,2)) || '"}') AS hash, true AS order_free FROM orders""")
def f7_row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical hash of every order: totals as text of two decimals, NULLs kept, whatever the order of the columns."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("order_id"), F.col("o_orderstatus").alias("status"), money("o_totalprice").cast("string").alias("total"), F.when(k % 2 == 0, "even").alias("note"))
    one, other = canonical_hash("order_id", "status", "total", "note"), canonical_hash("note", "total", "status", "order_id")
    return rows.select("order_id", one.alias("hash"), (one == other).alias("order_free"))


@query("""WITH e AS (SELECT user_id % 200 AS k, ts FROM events), r AS (SELECT DISTINCT k, TIMESTAMP '2024-01-12' + to_days(CAST(k % 5 AS INT)) AS a, TIMESTAMP '2024-01-13' + to_days(CAST(k % 5 AS INT)) AS b, k % 4 <> 0 AS scheduled, CASE WHEN k % 3 <> 0 THEN TIMESTAMP '2024-01-05' + to_days(CAST(k % 13 AS INT)) END AS mark FROM e),
p AS (SELECT k, b, CASE WHEN scheduled AND mark IS NOT NULL THEN mark ELSE a END AS a, CASE WHEN NOT scheduled OR mark IS NULL THEN NULL WHEN mark >= b THEN 'no new window' WHEN b - mark > INTERVAL 7 DAY THEN 'gap too long' END AS error FROM r)
SELECT k AS pipeline, coalesce(error, '') AS error, strftime(CASE WHEN error IS NULL THEN a END, '%Y-%m-%d') AS window_start, (SELECT count(*) FROM e WHERE e.k = p.k AND p.error IS NULL AND ts >= p.a AND ts < p.b) AS events FROM p""")
def c2_incremental_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pipeline's window by its watermark, and the events read for it: scheduled runs fill gaps, backfills keep their window,
    runs without a new window or with too long a gap read nothing."""
    k = F.col("pipeline")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("pipeline"), "ts")
    day = lambda first, n: F.lit(first).cast("timestamp") + F.make_dt_interval(n.cast("int"))
    pipelines = events.select("pipeline").distinct()
    requests = pipelines.select("pipeline", day("2024-01-12", k % 5).alias("window_start"), day("2024-01-13", k % 5).alias("window_end"), (k % 4 != 0).alias("scheduled"))
    marks = pipelines.filter(k % 3 != 0).select("pipeline", day("2024-01-05", k % 13).alias("watermark"))
    planned = control.planned_windows(requests, marks, control.LONGEST_GAP["logs"])
    read = control.rows_due(events, planned, "ts").groupBy("pipeline").agg(F.count(F.lit(1)).alias("events"))
    return planned.join(read, "pipeline", "left").select("pipeline", F.coalesce("error", F.lit("")).alias("error"), F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), F.coalesce("events", F.lit(0)).alias("events"))


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey, o_orderpriority FROM orders) SELECT 'order_id' AS column_name, count(*) AS rows, count(*) - count(o_orderkey) AS nulls, min(o_orderkey)::DOUBLE AS least, max(o_orderkey)::DOUBLE AS greatest FROM o
UNION ALL SELECT 'customer_id', count(*), count(*) - count(o_custkey), min(o_custkey), max(o_custkey) FROM o UNION ALL SELECT 'priority', count(*), count(*) - count(o_orderpriority), NULL, NULL FROM o""")
def x5_column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimizer's statistics of a saved and analyzed table, column by column."""
    k, name = F.col("o_custkey"), f"orders_{uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(k % 10 != 0, k).alias("customer_id"), F.col("o_orderpriority").alias("priority"))
    try:
        sinks.save_table(rows, name)
        sinks.analyze(spark, name)
        return sinks.column_statistics(spark, name).withColumns({c: F.col(c).try_cast("double") for c in ("least", "greatest")})
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
