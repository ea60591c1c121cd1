"""Joins, aggregates, windows, set operations and functions over the retail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesflow.functions.scalar import canonical_hash, days_between, hours_between, status_group
from salesflow.operators import sales, star
from salesflow.operators.merge import change_audit
from salesflow.plans import domain
from salesflow.plans.domain import CUSTOMERS, ITEMS, PRODUCTS, SELLERS, query, table

# Item prices without item numbers: no window is needed.
_FACT = """fact AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS freight_value, CAST(l_quantity AS INT) AS quantity FROM lineitem)"""
dbl = lambda c: F.col(c).cast("double").alias(c)
big = lambda c: F.col(c).cast("long").alias(c)


def _curated(spark: SparkSession, sf_dir: str, *dimensions: str) -> DataFrame:
    """The curated fact with the named dimensions only, or with all."""
    d = domain
    rows = {"orders": lambda: d.orders(spark, sf_dir).select("order_id", "customer_id", "order_status", "purchased_at"), "customers": lambda: d.customers(spark, sf_dir), "products": lambda: d.products(spark, sf_dir), "sellers": lambda: d.sellers(spark, sf_dir)}
    return star.curated(star.star_join(d.items(spark, sf_dir), **{n: rows[n]() for n in dimensions or rows}))


@query(f"""WITH {_FACT}, {CUSTOMERS} SELECT customer_state AS nation, count(*) AS lines, CAST(sum(price) AS DOUBLE) AS revenue
FROM fact f JOIN orders o ON f.order_id = o.o_orderkey JOIN customers c ON o.o_custkey = c.customer_id GROUP BY 1""")
def j1_revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins: revenue by the customer's nation."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    rows = domain.items(spark, sf_dir).select("order_id", "price").join(o, "order_id").join(domain.customers(spark, sf_dir), "customer_id")
    return rows.groupBy(F.col("customer_state").alias("nation")).agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("double").alias("revenue"))


@query("SELECT o_orderkey AS order_id, o_orderstatus AS order_status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2 HAVING count(l_orderkey) = 0")
def j2_orders_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join and count = 0, as an anti join."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("order_status")).join(own, "order_id", "left_anti")


@query("SELECT o_orderstatus AS order_status, count(*) AS rows, count(l_orderkey) AS items FROM lineitem RIGHT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def j3_status_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right join that keeps all orders."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "right")
    return rows.groupBy(F.col("o_orderstatus").alias("order_status")).agg(F.count(F.lit(1)).alias("rows"), F.count("l_orderkey").alias("items"))


@query("""WITH sold AS (SELECT l_suppkey AS k, count(*) AS items FROM lineitem WHERE l_suppkey % 10 <> 0 GROUP BY 1), known AS (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey % 10 <> 1)
SELECT coalesce(a.k, b.k) AS seller_id, s_name AS seller_name, items FROM sold a FULL JOIN known b ON a.k = b.k""")
def j4_supplier_full_recon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full join with a coalesced key; both sides lack a part."""
    sold = table(spark, sf_dir, "lineitem").filter("l_suppkey % 10 <> 0").groupBy(F.col("l_suppkey").alias("a")).agg(F.count(F.lit(1)).alias("items"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 1").select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("seller_name"))
    return sold.join(known, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("seller_id"), "seller_name", "items")


@query(f"""WITH {_FACT}, {CUSTOMERS}, {PRODUCTS}, {SELLERS} SELECT customer_state, CAST(year(o_orderdate) AS BIGINT) AS purchase_year, CAST(month(o_orderdate) AS BIGINT) AS purchase_month, count(*) AS lines, CAST(sum(price + freight_value) AS DOUBLE) AS gross
FROM fact f LEFT JOIN orders o ON f.order_id = o.o_orderkey LEFT JOIN customers c ON o.o_custkey = c.customer_id LEFT JOIN products USING (product_id) LEFT JOIN sellers USING (seller_id) GROUP BY ALL""")
def j5_curated_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curated star join, summed by state and month."""
    return _curated(spark, sf_dir, "orders", "customers").groupBy("customer_state", F.col("purchase_year").cast("long").alias("purchase_year"), F.col("purchase_month").cast("long").alias("purchase_month")).agg(F.count(F.lit(1)).alias("lines"), F.sum("gross_amount").cast("double").alias("gross"))


@query("""SELECT CAST(r AS BIGINT) AS replica_id, count(*) AS rows, count(DISTINCT r || ':' || l_orderkey || ':' || l_linenumber) AS ids FROM lineitem, (SELECT unnest(range(0, 3)) AS r) GROUP BY 1""")
def j6_expand_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controlled expansion by replicas."""
    rows = sales.expand_copies(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), 3, ["l_orderkey", "l_linenumber"])
    return rows.groupBy(F.col("replica_id").cast("long").alias("replica_id")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("synthetic_id").alias("ids"))


@query("SELECT count(*) AS orphans, coalesce(sum(l_orderkey), 0)::BIGINT AS key_sum FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 5 <> 0)")
def j10_antijoin_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose order is missing from a partial orders table."""
    parents = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return star.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), parents, ["l_orderkey"]).agg(F.count(F.lit(1)).alias("orphans"), F.coalesce(F.sum("l_orderkey"), F.lit(0)).alias("key_sum"))


_SALES_SQL = """sale AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, p_type AS category, CAST(l_quantity AS INT) AS quantity, CAST(CAST(CAST(l_quantity AS INT) AS DECIMAL(20,2)) * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(20,2)) AS line_amount, CAST(o_orderdate AS DATE) AS order_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity").cast("int")
    return rows.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("p_type").alias("category"), q.alias("quantity"), (q.cast("decimal(20,2)") * domain.money("p_retailprice")).cast("decimal(20,2)").alias("line_amount"), F.to_date("o_orderdate").alias("order_date"))


@query(f"WITH {_SALES_SQL} SELECT category, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, CAST(sum(quantity) AS BIGINT) AS units_sold, CAST(sum(line_amount) AS DOUBLE) AS revenue FROM sale GROUP BY 1")
def a1_sales_metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sales metrics by category (the mean is revenue over lines and checked in tests)."""
    return sales.sales_summary(_sales(spark, sf_dir), "category").select("category", "orders", "customers", "units_sold", dbl("revenue"))


@query(f"WITH {_FACT}, {PRODUCTS} SELECT product_category, count(*) AS lines, CAST(sum(price + freight_value) AS DOUBLE) AS gross FROM fact JOIN products USING (product_id) GROUP BY 1")
def a3_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category summary through SQL; the DataFrame and RDD forms are compared with it in tests."""
    return sales.category_summary_sql(_curated(spark, sf_dir, "products")).select("product_category", "lines", dbl("gross"))


@query(f"""WITH {_FACT} SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS lines, count(DISTINCT (product_id, seller_id)) AS items, CAST(sum(price) AS DOUBLE) AS item_value, CAST(sum(freight_value) AS DOUBLE) AS freight, CAST(sum(price + freight_value) AS DOUBLE) AS gross
FROM fact JOIN orders ON order_id = o_orderkey GROUP BY 1""")
def a4_monthly_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, distinct items and values by month."""
    rows = _curated(spark, sf_dir, "orders")
    return rows.groupBy(F.date_format("purchased_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct(F.struct("product_id", "seller_id")).alias("items"), F.sum("price").cast("double").alias("item_value"), F.sum("freight_value").cast("double").alias("freight"), F.sum("gross_amount").cast("double").alias("gross"))


@query(f"WITH {_FACT} SELECT count(*) AS lines, CAST(sum(price) AS DOUBLE) AS item_value, CAST(sum(freight_value) AS DOUBLE) AS freight, CAST(sum(quantity) AS BIGINT) AS units, count(DISTINCT product_id) AS products FROM fact")
def a5_global_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-scan aggregate."""
    rows = domain.items(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("double").alias("item_value"), F.sum("freight_value").cast("double").alias("freight"), F.sum("quantity").cast("long").alias("units"), F.countDistinct("product_id").alias("products"))


@query(f"""WITH {_FACT}, {CUSTOMERS}, {PRODUCTS} SELECT customer_state, product_category, count(*) AS lines, CAST(sum(price + freight_value) AS DOUBLE) AS gross FROM fact JOIN orders ON order_id = o_orderkey JOIN customers ON o_custkey = customer_id JOIN products USING (product_id)
WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1, 2""")
def a6_filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last year by state and category."""
    # a scalar subquery: nothing runs while the query is built, and the scan of orders can use its value
    first_day = table(spark, sf_dir, "orders").select(F.date_trunc("year", F.max("o_orderdate"))).scalar()
    rows = _curated(spark, sf_dir, "orders", "customers", "products").filter(F.col("purchased_at") >= first_day)
    return rows.groupBy("customer_state", "product_category").agg(F.count(F.lit(1)).alias("lines"), F.sum("gross_amount").cast("double").alias("gross"))


@query("""SELECT p_brand AS brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING sum(CAST(l_extendedprice AS DECIMAL(12,2))) >= 100000""")
def a7_having_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at least 100,000 revenue."""
    rows = domain.items(spark, sf_dir).select("order_id", "product_id", "price").join(domain.products(spark, sf_dir), "product_id")
    return rows.groupBy("brand").agg(F.sum("price").cast("double").alias("revenue"), F.countDistinct("order_id").alias("orders")).filter("revenue >= 100000")


@query("""WITH t AS (SELECT n_name AS nation, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT nation, revenue FROM t WHERE revenue > (SELECT avg(revenue) FROM t)""")
def a8_above_average_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups above the average group, by a scalar subquery."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id"), domain.money("o_totalprice").alias("total"))
    t = o.join(domain.customers(spark, sf_dir), "customer_id").groupBy(F.col("customer_state").alias("nation")).agg(F.sum("total").cast("double").alias("revenue"))
    return spark.sql("SELECT nation, revenue FROM {t} WHERE revenue > (SELECT avg(revenue) FROM {t})", t=t)


@query("""SELECT o_orderpriority AS priority, count(*) AS orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders GROUP BY 1""")
def a9_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.sum(F.when(F.col("o_totalprice") > 200000, 1).otherwise(0)).alias("large"))


@query("SELECT count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_keys FROM lineitem")
def a10_grain_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus rows of a grain; NULL members count."""
    return sales.key_check(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT o_custkey AS customer_id, (array_agg(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC))[1] AS last_order FROM orders GROUP BY 1""")
def a21_latest_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of an ordered aggregate."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query(f"WITH {_FACT} SELECT product_id, count(*) AS items, CAST(sum(price + freight_value) AS DOUBLE) AS gross FROM fact GROUP BY 1")
def a22_product_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and gross value of each product."""
    return domain.items(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("price") + F.col("freight_value")).cast("double").alias("gross"))


@query(f"""WITH {_FACT}, {CUSTOMERS}, {PRODUCTS} SELECT region, product_category, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units, CAST(sum(price + freight_value) AS DOUBLE) AS gross FROM fact JOIN orders ON order_id = o_orderkey JOIN customers ON o_custkey = customer_id JOIN products USING (product_id) GROUP BY 1, 2""")
def a23_region_category_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region x category mart."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    rows = domain.items(spark, sf_dir).join(o, "order_id").join(domain.customers(spark, sf_dir), "customer_id").join(domain.products(spark, sf_dir), "product_id")
    return rows.groupBy("region", "product_category").agg(F.countDistinct("order_id").alias("orders"), F.sum("quantity").cast("long").alias("units"), F.sum(F.col("price") + F.col("freight_value")).cast("double").alias("gross"))


@query("SELECT o_orderstatus AS order_status, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders WHERE o_totalprice >= 50000 GROUP BY 1")
def a24_status_totals(spark: SparkSession, sf_dir: str, least: float = 50_000) -> DataFrame:
    """Counts and sums by status from a parameter on."""
    return table(spark, sf_dir, "orders").filter(F.col("o_totalprice") >= least).groupBy(F.col("o_orderstatus").alias("order_status")).agg(F.count(F.lit(1)).alias("orders"), F.sum(domain.money("o_totalprice")).cast("double").alias("total"))


@query("SELECT o_custkey AS customer_id, count(*) AS orders FROM orders GROUP BY 1 ORDER BY orders DESC, customer_id LIMIT 10")
def a26_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest groups."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "customer_id").limit(10)


@query("""WITH t AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, p_brand AS brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT * FROM (SELECT *, rank() OVER (PARTITION BY year ORDER BY revenue DESC) AS place FROM t) WHERE place <= 5""")
def w1_top5_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best brands of each year by RANK."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.year("o_orderdate").cast("long").alias("year"))
    rows = domain.items(spark, sf_dir).select("order_id", "product_id", "price").join(o, "order_id").join(domain.products(spark, sf_dir), "product_id")
    sums = rows.groupBy("year", "brand").agg(F.sum("price").cast("double").alias("revenue"))
    return sums.withColumn("place", F.rank().over(Window.partitionBy("year").orderBy(F.desc("revenue"))).cast("long")).filter("place <= 5")


@query("""WITH seen AS (SELECT c_nationkey AS prefix, c_mktsegment AS place FROM customer UNION ALL SELECT s_nationkey, 'SUPPLIER' FROM supplier), n AS (SELECT prefix, place, count(*) AS n FROM seen GROUP BY 1, 2)
SELECT CAST(prefix AS BIGINT) AS prefix, place, n FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, place) AS r FROM n) WHERE r = 1""")
def w2_mode_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each key."""
    seen = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("prefix"), F.col("c_mktsegment").alias("place")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("prefix"), F.lit("SUPPLIER").alias("place")))
    return sales.mode_by_key(seen, "prefix", "place").select(big("prefix"), "place", "n")


@query("""WITH t AS (SELECT 'purchase' AS role, CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT 'ship', CAST(l_shipdate AS DATE) FROM lineitem)
SELECT role, count(*) AS rows, count(DISTINCT d) AS days, strftime(min(d), '%Y-%m-%d') AS first_day, strftime(max(d), '%Y-%m-%d') AS last_day FROM t GROUP BY 1""")
def u1_date_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date roles by UNION ALL."""
    a = table(spark, sf_dir, "orders").select(F.lit("purchase").alias("role"), F.to_date("o_orderdate").alias("d"))
    b = table(spark, sf_dir, "lineitem").select(F.lit("ship").alias("role"), F.to_date("l_shipdate").alias("d"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return a.unionByName(b).groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("d").alias("days"), day(F.min("d")).alias("first_day"), day(F.max("d")).alias("last_day"))


@query("SELECT p_type AS name FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT o_orderpriority FROM orders")
def u2_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNION of names."""
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("name")).distinct() for t, c in (("part", "p_type"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("""WITH a AS (SELECT p_partkey, p_brand FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'changed' ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 97 <> 0)
SELECT p_partkey, p_brand, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT p_partkey, p_brand, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def u3_symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one of two pipelines has."""
    a = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    b = a.filter("p_partkey % 97 <> 0").withColumn("p_brand", F.when(F.col("p_partkey") % 50 == 0, "changed").otherwise(F.col("p_brand")))
    return sales.symmetric_difference(a, b)


_CALENDAR = """days AS (SELECT CAST(unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM orders)"""


@query(f"""WITH {_CALENDAR} SELECT CAST(strftime(d, '%Y%m%d') AS BIGINT) AS date_key, strftime(d, '%Y-%m-%d') AS full_date, isodow(d)::BIGINT AS day_of_week, dayname(d) AS day_name, week(d)::BIGINT AS week_of_year, monthname(d) AS month_name, quarter(d)::BIGINT AS quarter, isodow(d) >= 6 AS is_weekend FROM days""")
def f2_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar attributes of every day between the first and the last order."""
    c = star.calendar(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")))
    return c.select(big("date_key"), F.date_format("full_date", "yyyy-MM-dd").alias("full_date"), big("day_of_week"), "day_name", big("week_of_year"), "month_name", big("quarter"), "is_weekend")


@query("""SELECT l_orderkey AS order_id, round((epoch_us(max(l_shipdate)) - epoch_us(min(o_orderdate))) / 3.6e9, 2)::DOUBLE AS hours, round((epoch_us(max(l_shipdate)) - epoch_us(min(o_orderdate))) / 8.64e10, 2)::DOUBLE AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def f3_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed hours and days from the order to its last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").alias("shipped"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderdate").join(last, "order_id")
    return rows.select("order_id", hours_between(F.col("o_orderdate"), F.col("shipped")).cast("double").alias("hours"), days_between(F.col("o_orderdate"), F.col("shipped")).cast("double").alias("days"))


@query("""SELECT CASE CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'canceled' ELSE 'created' END WHEN 'delivered' THEN 'completed' WHEN 'canceled' THEN 'failed' ELSE 'in progress' END AS status_group, count(*) AS orders FROM orders GROUP BY 1""")
def f5_status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses in groups."""
    s = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "canceled").otherwise("created")
    return table(spark, sf_dir, "orders").groupBy(status_group(s).alias("status_group")).agg(F.count(F.lit(1)).alias("orders"))


@query("""SELECT event_type, count(*) AS events, count(CAST(props::JSON->>'k' AS BIGINT)) AS with_k, CAST(sum(CAST(props::JSON->>'k' AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def f6_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON."""
    k = F.from_json("props", "k long").getField("k")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count(k).alias("with_k"), F.sum(k).alias("k_sum"))


@query("""SELECT n_nationkey::BIGINT AS n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"note":null}') AS hash FROM nation""")
def f7_canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical hashes: sorted names, NULLs kept."""
    return table(spark, sf_dir, "nation").withColumn("note", F.lit(None).cast("string")).select(big("n_nationkey"), canonical_hash("n_nationkey", "n_name", "note").alias("hash"))


_CHANGED = "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'NEW' ELSE c_mktsegment END"


@query(f"SELECT c_custkey AS customer_id, c_mktsegment AS old_value, {_CHANGED} AS new_value FROM customer WHERE c_mktsegment IS DISTINCT FROM {_CHANGED}")
def p6_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null-safe changes between two snapshots."""
    before = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), "c_mktsegment")
    k = F.col("customer_id")
    after = before.withColumn("c_mktsegment", F.when(k % 10 == 0, F.lit(None)).when(k % 7 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    return change_audit(before, after, "customer_id", "c_mktsegment")


@query("""SELECT o_orderkey AS order_id, o_orderstatus AS old_value, CASE WHEN o_orderkey % 9 = 0 THEN 'F' ELSE o_orderstatus END AS new_value FROM orders WHERE o_orderkey % 9 = 0 AND o_orderstatus <> 'F'""")
def x2_change_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each real status change."""
    before = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), "o_orderstatus")
    after = before.withColumn("o_orderstatus", F.when(F.col("order_id") % 9 == 0, "F").otherwise(F.col("o_orderstatus")))
    return change_audit(before, after, "order_id", "o_orderstatus")


@query(f"WITH {_FACT} SELECT count(*) AS lines, CAST(sum(price) AS DOUBLE) AS item_value FROM fact JOIN orders ON order_id = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01'")
def p3_half_open_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open time filter."""
    at = F.col("o_orderdate")
    o = table(spark, sf_dir, "orders").filter((at >= F.lit("1997-03-01").cast("timestamp")) & (at < F.lit("1997-06-01").cast("timestamp"))).select(F.col("o_orderkey").alias("order_id"))
    return domain.items(spark, sf_dir).select("order_id", "price").join(o, "order_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("double").alias("item_value"))


@query("SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def o2_latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest orders."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select(F.col("o_orderkey").alias("order_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


@query("""SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE orders))::INT AS columns, CAST(6 * count(*) - count(o_orderkey) - count(o_custkey) - count(o_orderstatus) - count(o_totalprice) - count(o_orderdate) - count(o_orderpriority) AS BIGINT) AS missing_cells FROM orders""")
def q13_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and missing cells."""
    return sales.profile(table(spark, sf_dir, "orders"))


@query(f"WITH {ITEMS} SELECT count(*) AS items, count(DISTINCT (order_id, item_number)) AS keys, CAST(max(item_number) AS BIGINT) AS most FROM items")
def d11_item_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item numbers make the grain unique."""
    rows = domain.items(spark, sf_dir, numbered=True)
    return rows.agg(F.count(F.lit(1)).alias("items"), F.countDistinct(F.struct("order_id", "item_number")).alias("keys"), F.max("item_number").cast("long").alias("most"))


