"""The given tables as the retail domain's tables: a DataFrame and the same as a SQL common table expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.sources.commits import fs_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its zone-less times are read as UTC."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    times = [f.name for f in rows.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else rows


def table_stream(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """A given table's files as a stream, be it one file or a folder of part files; zone-less times are read as UTC."""
    place = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(place).schema
    fs, at = fs_of(spark, place)
    reader = spark.readStream.schema(schema).options(**options)
    rows = reader.parquet(place) if fs.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    times = [f.name for f in schema if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in times}) if times else rows


def money(column: str):
    return F.col(column).cast("decimal(12,2)")


# ---------------------------------------------------------------- order items

ITEMS = """items AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_number,
  l_partkey AS product_id, l_suppkey AS seller_id, CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS freight_value FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """Order items; the item number (unique in its order) is made only where asked, as it needs a shuffle."""
    rows = table(spark, sf_dir, "lineitem")
    own = [F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"), F.col("l_quantity").cast("int").alias("quantity"), money("l_extendedprice").alias("price"), (money("l_extendedprice") * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(12,2)").alias("freight_value")]
    if not numbered:
        return rows.select(*own, F.col("l_linenumber").alias("item_number"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    # numbered before columns are renamed: each column moves once, and a filter of orders is applied before the shuffle
    return rows.withColumn("item_number", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).select(*own, "item_number")


ORDERS = """retail_orders AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status, o_orderdate AS purchased_at,
  o_orderdate + to_hours(CAST(o_orderkey % 48 AS INT)) AS approved_at, o_orderdate + to_hours(CAST(o_orderkey % 48 AS INT)) + to_days(CAST(o_orderkey % 5 AS INT)) AS carrier_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_hours(CAST(o_orderkey % 48 AS INT)) + to_days(CAST(o_orderkey % 5 + o_orderkey % 20 AS INT)) END AS delivered_at, o_orderdate + to_days(15) AS estimated_at,
  CAST(o_totalprice AS DECIMAL(12,2)) AS total, o_orderpriority AS priority FROM orders)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the five dates of their life."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    hours = F.make_interval(hours=(k % 48).cast("int"))
    approved = at + hours
    return table(spark, sf_dir, "orders").select(
        k.alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), at.alias("purchased_at"), approved.alias("approved_at"),
        (approved + F.make_interval(days=(k % 5).cast("int"))).alias("carrier_at"),
        F.when(F.col("o_orderstatus") != "O", approved + F.make_interval(days=(k % 5 + k % 20).cast("int"))).alias("delivered_at"),
        (at + F.make_interval(days=F.lit(15))).alias("estimated_at"), money("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
    )


PAYMENTS = """payments AS (SELECT o_orderkey AS order_id, 1 AS payment_sequential, CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'debit_card' WHEN '3-MEDIUM' THEN 'boleto' ELSE 'voucher' END AS payment_type,
  CAST(1 + o_orderkey % 6 AS INT) AS payment_installments, CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value FROM orders
  UNION ALL SELECT o_orderkey, 2, 'voucher', 1, CAST(0 AS DECIMAL(12,2)) FROM orders WHERE o_orderkey % 11 = 0)"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payment for each order, and an empty second one for some."""
    o = orders(spark, sf_dir)
    kind = F.when(F.col("priority") == "1-URGENT", "credit_card").when(F.col("priority") == "2-HIGH", "debit_card").when(F.col("priority") == "3-MEDIUM", "boleto").otherwise("voucher")
    first = o.select("order_id", F.lit(1).alias("payment_sequential"), kind.alias("payment_type"), (1 + F.col("order_id") % 6).cast("int").alias("payment_installments"), F.col("total").alias("payment_value"))
    second = o.filter(F.col("order_id") % 11 == 0).select("order_id", F.lit(2).alias("payment_sequential"), F.lit("voucher").alias("payment_type"), F.lit(1).alias("payment_installments"), F.lit(0).cast("decimal(12,2)").alias("payment_value"))
    return first.unionByName(second)


REVIEWS = """reviews AS (SELECT 'r' || o_orderkey AS review_id, o_orderkey AS order_id, CAST(1 + o_orderkey % 5 AS INT) AS review_score, o_orderdate + to_days(CAST(o_orderkey % 10 AS INT)) AS created_at,
  o_orderdate + to_days(CAST(o_orderkey % 10 AS INT)) + to_hours(CAST(o_orderkey % 72 AS INT)) AS answered_at, CASE WHEN o_orderkey % 4 <> 0 THEN 'title' END AS title, CASE WHEN o_orderkey % 7 <> 0 THEN 'message' END AS message FROM orders WHERE o_orderkey % 3 = 0)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of a third of the orders."""
    k = F.col("order_id")
    created = F.col("purchased_at") + F.make_interval(days=(k % 10).cast("int"))
    return orders(spark, sf_dir).filter(k % 3 == 0).select(
        F.concat(F.lit("r"), k).alias("review_id"), "order_id", (1 + k % 5).cast("int").alias("review_score"), created.alias("created_at"), (created + F.make_interval(hours=(k % 72).cast("int"))).alias("answered_at"),
        F.when(k % 4 != 0, "title").alias("title"), F.when(k % 7 != 0, "message").alias("message"),
    )


CUSTOMERS = "customers AS (SELECT c_custkey AS customer_id, n_name AS customer_state, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
PRODUCTS = "products AS (SELECT p_partkey AS product_id, p_type AS product_category, p_brand AS brand FROM part)"
SELLERS = "sellers AS (SELECT s_suppkey AS seller_id, n_name AS seller_state FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("customer_state"), F.col("r_name").alias("region"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("product_category"), F.col("p_brand").alias("brand"))


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("seller_id"), F.col("n_name").alias("seller_state"))


# ---------------------------------------------------------------- promotions

PROMOTIONS = """promotions AS (
  SELECT 'p' || p_partkey AS promotion_id, p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN 'fixed' ELSE 'percentage' END AS discount_type,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 + p_partkey % 9 ELSE 5 + p_partkey % 21 END AS DECIMAL(12,2)) AS discount_value,
    DATE '1996-01-01' + CAST(p_partkey % 700 AS INT) AS starts_on, DATE '1996-01-01' + CAST(p_partkey % 700 + 200 + p_partkey % 400 AS INT) AS ends_on,
    CASE WHEN p_partkey % 7 = 0 AND v.version = 1 + CAST(p_partkey % 5 = 0 AS INT) THEN 'inactive' ELSE 'active' END AS status, v.version AS version,
    TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(p_partkey % 30 + v.version AS INT)) AS updated_at
  FROM part JOIN (SELECT 1 AS version UNION ALL SELECT 2) v ON v.version = 1 OR p_partkey % 5 = 0)"""


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A promotion for each product; every fifth has a second version, every seventh ends inactive."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey").withColumn("version", F.explode(F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    fixed, base = k % 3 == 0, F.lit("1996-01-01").cast("date")
    start = F.date_add(base, (k % 700).cast("int"))
    return rows.select(
        F.concat(F.lit("p"), k).alias("promotion_id"), k.alias("product_id"), F.when(fixed, "fixed").otherwise("percentage").alias("discount_type"), F.when(fixed, 2 + k % 9).otherwise(5 + k % 21).cast("decimal(12,2)").alias("discount_value"),
        start.alias("starts_at"), F.date_add(start, (200 + k % 400).cast("int")).alias("ends_at"), F.when((k % 7 == 0) & (F.col("version") == 1 + (k % 5 == 0).cast("int")), "inactive").otherwise("active").alias("status"), "version",
        (F.lit("1996-01-01").cast("timestamp") + F.make_interval(days=(k % 30 + F.col("version")).cast("int"))).alias("updated_at"),
    )


# ---------------------------------------------------------------- service logs

LOGS = """logs AS (SELECT event_id, ts AS event_time, 'svc' || user_id % 3 AS service, CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method, '/' || event_type AS path,
  CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 WHEN 'click' THEN 302 ELSE 200 END AS status_code, CAST(floor(abs(value)) AS INT) AS latency_ms FROM events)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed log events from the events table."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("event_time"), F.concat(F.lit("svc"), F.col("user_id") % 3).alias("service"),
        F.when(kind == "purchase", "POST").when(kind == "signup", "PUT").when(kind == "error", "DELETE").otherwise("GET").alias("method"), F.concat(F.lit("/"), kind).alias("path"),
        F.when(kind == "error", 500).when(kind == "signup", 201).when(kind == "click", 302).otherwise(200).alias("status_code"), F.floor(F.abs("value")).cast("int").alias("latency_ms"),
    )


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON events as a message queue gives them, broken by event_id: every 11th is no JSON, every 13th has a bad time, every
    17th status 700, every 19th latency -1, every 23rd no path."""
    k = F.col("event_id")
    rows = logs(spark, sf_dir)
    when = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.to_json(F.struct(
        F.concat(F.lit("e"), k).alias("event_id"), F.when(k % 13 == 0, "yesterday").otherwise(when).alias("ts"), F.when(k % 13 == 0, "yesterday").otherwise(when).alias("event_time"), "service",
        F.concat(F.lit(" "), F.lower("method"), F.lit(" ")).alias("method"), F.when(k % 23 != 0, F.col("path")).alias("path"), F.when(k % 17 == 0, 700).otherwise(F.col("status_code")).alias("status_code"),
        F.when(k % 19 == 0, -1).otherwise(F.col("latency_ms")).alias("latency_ms"), F.lit("host").alias("host"),
    ))
    return rows.select(F.when(k % 11 == 0, F.lit("not-json")).otherwise(body).cast("binary").alias("value"), F.lit("logs").alias("topic"), (k % 4).cast("int").alias("partition"), k.alias("offset"), F.col("event_time").alias("timestamp"))
