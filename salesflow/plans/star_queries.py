"""Dimensions, facts, merges and constraints over the retail tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.functions.rules import all_reasons, sales_rules
from salesflow.functions.scalar import BEGINNING
from salesflow.operators import gates, merge, sales, star
from salesflow.plans import domain
from salesflow.plans.domain import ORDERS, PAYMENTS, PRODUCTS, REVIEWS, query, table

big = lambda c: F.col(c).cast("long").alias(c)
LOAD_TIME = "1998-01-01 00:00:00"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of the product dimension: the second changes a tenth of the brands and drops a few products."""
    first = domain.products(spark, sf_dir)
    none = merge.empty_history(first, ["product_id"], ["product_category", "brand"], "product_key")
    one = merge.scd2(none, first, ["product_id"], ["product_category", "brand"], BEGINNING, "product_key")
    second = first.filter("product_id % 101 <> 0").withColumn("brand", F.when(F.col("product_id") % 10 == 0, "Brand#new").otherwise(F.col("brand")))
    return merge.scd2(one, second, ["product_id"], ["product_category", "brand"], LOAD_TIME, "product_key")


_HISTORY = f"""{PRODUCTS}, history AS (
  SELECT product_id, brand, TIMESTAMP '1900-01-01' AS effective_from, CASE WHEN product_id % 10 = 0 AND product_id % 101 <> 0 THEN TIMESTAMP '{LOAD_TIME}' ELSE TIMESTAMP '9999-12-31' END AS effective_to, NOT (product_id % 10 = 0 AND product_id % 101 <> 0) AS is_current, 1 AS version_number FROM products
  UNION ALL SELECT product_id, 'Brand#new', TIMESTAMP '{LOAD_TIME}', TIMESTAMP '9999-12-31', true, 2 FROM products WHERE product_id % 10 = 0 AND product_id % 101 <> 0)"""


@query(f"WITH {_HISTORY} SELECT product_id, brand, strftime(effective_from, '%Y-%m-%d') AS valid_from, strftime(effective_to, '%Y-%m-%d') AS valid_to, is_current, CAST(version_number AS BIGINT) AS version_number FROM history")
def d8_scd2_two_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product history after two loads."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return _history(spark, sf_dir).select("product_id", "brand", day("effective_from").alias("valid_from"), day("effective_to").alias("valid_to"), "is_current", big("version_number"))


@query(f"""WITH {_HISTORY} SELECT CAST(coalesce(h.version_number, 0) AS BIGINT) AS version_number, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN history h ON l_partkey = h.product_id AND o_orderdate >= effective_from AND o_orderdate < effective_to GROUP BY 1""")
def j8_scd2_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by the version valid at their time."""
    history = _history(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("purchased_at"))
    rows = merge.point_in_time(domain.items(spark, sf_dir).join(o, "order_id"), history, "product_id", "purchased_at", "product_key", ("version_number",))
    return rows.groupBy(F.coalesce("version_number", F.lit(0)).cast("long").alias("version_number")).agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("double").alias("revenue"))


@query(f"WITH {_HISTORY} SELECT count(*) AS products, CAST(sum(versions) AS BIGINT) AS versions, count(*) FILTER (WHERE current_versions <> 1) AS broken FROM (SELECT product_id, count(*) AS versions, count(*) FILTER (WHERE is_current) AS current_versions FROM history GROUP BY 1)")
def d17_single_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product has one current version."""
    h = _history(spark, sf_dir)
    broken = star.single_current(h, "product_id").agg(F.count(F.lit(1)).alias("broken"))
    return h.agg(F.countDistinct("product_id").alias("products"), F.count(F.lit(1)).alias("versions")).crossJoin(broken)


@query("""WITH seen AS (SELECT n_nationkey AS prefix, c_mktsegment AS place FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, 'SUPPLIER' FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT prefix, place, count(*) AS n FROM seen GROUP BY 1, 2), m AS (SELECT prefix, place, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, place) AS r FROM n),
centre AS (SELECT c_nationkey AS prefix, sum(CAST(c_acctbal AS DECIMAL(12,2)))::DOUBLE / count(*) AS lat FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1)
SELECT CAST(m.prefix AS BIGINT) AS prefix, place, round(lat, 3) AS lat FROM m LEFT JOIN centre USING (prefix) WHERE r = 1""")
def d1_canonical_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical place of each prefix with its mean coordinate, if known."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    seen = c.select(F.col("c_nationkey").alias("prefix"), F.col("c_mktsegment").alias("place")).unionByName(s.select(F.col("s_nationkey").alias("prefix"), F.lit("SUPPLIER").alias("place")))
    centre = c.filter("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("prefix"), domain.money("c_acctbal").alias("lat"), domain.money("c_acctbal").alias("lng"))
    rows = star.location_dimension(seen, centre.groupBy("prefix").agg((F.sum("lat").cast("double") / F.count(F.lit(1))).alias("lat"), F.lit(0.0).alias("lng")), sales.mode_by_key(seen, "prefix", "place"))
    return rows.select(big("prefix"), "place", F.round("lat", 3).alias("lat"))


@query("SELECT count(*) AS places, count(DISTINCT customer_id) AS persons FROM (SELECT DISTINCT c_custkey AS customer_id, c_nationkey AS prefix FROM customer JOIN orders ON o_custkey = c_custkey)")
def d2_customer_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (person, prefix) addresses of customers with orders, met by a two-key join."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("prefix"))
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer_id")).join(people, "customer_id")
    addresses = people.join(known.distinct(), ["customer_id", "prefix"], "left_semi").distinct()
    return addresses.agg(F.count(F.lit(1)).alias("places"), F.countDistinct("customer_id").alias("persons"))


@query("""WITH c AS (SELECT p_type AS name, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS translation FROM part) SELECT name, max(translation) AS translation FROM c GROUP BY 1""")
def d3_category_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with their greatest translation."""
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).alias("translation"))
    return rows.groupBy("name").agg(F.max("translation").alias("translation"))


@query(f"""WITH {ORDERS}, r AS (SELECT CAST(purchased_at AS DATE) AS d FROM retail_orders UNION ALL SELECT CAST(approved_at AS DATE) FROM retail_orders UNION ALL SELECT CAST(carrier_at AS DATE) FROM retail_orders UNION ALL SELECT CAST(delivered_at AS DATE) FROM retail_orders UNION ALL SELECT CAST(estimated_at AS DATE) FROM retail_orders)
SELECT CAST(year(d) AS BIGINT) AS year, count(*) AS days, count(*) FILTER (WHERE isodow(d) >= 6) AS weekend_days, CAST(sum(CAST(strftime(d, '%Y%m%d') AS BIGINT)) AS BIGINT) AS key_sum FROM (SELECT CAST(unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM r) GROUP BY 1""")
def d4_dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date dimension over five date roles, summed by year."""
    roles = star.date_roles(domain.orders(spark, sf_dir), ["purchased_at", "approved_at", "carrier_at", "delivered_at", "estimated_at"])
    return star.calendar(roles).groupBy(big("year")).agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("is_weekend")).alias("weekend_days"), F.sum("date_key").alias("key_sum"))


@query("SELECT DISTINCT o_orderstatus AS order_status, CASE o_orderstatus WHEN 'P' THEN 'renamed' ELSE 'first' END AS label FROM orders UNION ALL SELECT 'UNKNOWN', NULL")
def d6_scd1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status dimension after a second load renames one label; keys stay; key 0 is UNKNOWN."""
    first = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("order_status")).distinct().withColumn("label", F.lit("first"))
    keyed = merge.numbered(first, ["order_status"], "status_key", 0)
    second = first.filter("order_status = 'P'").withColumn("label", F.lit("renamed"))
    return merge.with_unknown(merge.scd1(keyed, second, ["order_status"], "status_key"), "status_key", order_status="UNKNOWN").select("order_status", "label")


@query("WITH old AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) SELECT count(*) AS customers, CAST(count(*) AS BIGINT) AS top_key, count(DISTINCT c_custkey) AS keys FROM customer")
def d7_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insert-only dimension: old keys stay, new customers get the next dense keys."""
    all_rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    old = merge.numbered(all_rows.filter("customer_id % 3 <> 0"), ["customer_id"], "customer_key", 0)
    both = merge.scd1(old, all_rows, ["customer_id"], "customer_key")
    return both.agg(F.count(F.lit(1)).alias("customers"), F.max("customer_key").alias("top_key"), F.countDistinct("customer_key").alias("keys"))


@query(f"""WITH {_HISTORY} SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS date_key, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def d11_fact_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales fact with its product version and date keys, summed by day."""
    o = domain.orders(spark, sf_dir).select("order_id", "purchased_at")
    facts = merge.point_in_time(domain.items(spark, sf_dir).join(o, "order_id"), _history(spark, sf_dir), "product_id", "purchased_at", "product_key")
    key = (F.year("purchased_at") * 10000 + F.month("purchased_at") * 100 + F.dayofmonth("purchased_at")).cast("long")
    return facts.groupBy(key.alias("date_key")).agg(F.count(F.lit(1)).alias("lines"), F.sum("price").cast("double").alias("price"))


_DENSE = "c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS customer_key, c_nationkey + 1 AS location_key FROM customer), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS seller_key FROM supplier WHERE s_suppkey % 9 <> 0), t AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS status_key FROM (SELECT DISTINCT o_orderstatus FROM orders))"
_DAY_KEY = lambda c: f"CAST(strftime({c}, '%Y%m%d') AS BIGINT)"


def _fact(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """The sales fact; every ninth seller has no member, prices of the products that _history drops stay with version 1."""
    d = domain
    o = d.orders(spark, sf_dir)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), (F.col("c_nationkey") + 1).cast("long").alias("location_key"))
    items = d.items(spark, sf_dir, numbered).join(o.select("order_id", F.col("estimated_at").alias("shipping_limit_at")), "order_id")
    return star.fact_sales(
        items, o, customers=merge.numbered(customers.select("customer_id"), ["customer_id"], "customer_key", 0), products=_history(spark, sf_dir), locations=customers,
        sellers=merge.numbered(d.sellers(spark, sf_dir).filter("seller_id % 9 <> 0").select("seller_id"), ["seller_id"], "seller_key", 0), statuses=merge.numbered(star.dim_status(o).select("order_status"), ["order_status"], "status_key", 0),
    )


@query(f"""WITH {_DENSE} SELECT {_DAY_KEY('o_orderdate')} AS purchase_date_key, {_DAY_KEY('o_orderdate + to_days(15)')} AS shipping_limit_date_key, CAST(sum(customer_key) AS BIGINT) AS customer_keys, CAST(sum(location_key) AS BIGINT) AS location_keys, CAST(sum(coalesce(seller_key, 0)) AS BIGINT) AS seller_keys,
count(*) FILTER (WHERE seller_key IS NULL) AS unknown_sellers, CAST(0 * count(*) AS BIGINT) AS unknown_products, CAST(sum(status_key) AS BIGINT) AS status_keys, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS price
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey LEFT JOIN s ON l_suppkey = s_suppkey JOIN t USING (o_orderstatus) GROUP BY 1, 2""")
def d11_fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven keys of the sales fact, summed by day."""
    total = lambda c: F.sum(c).cast("long").alias(f"{c}s")
    missing = lambda c, name: F.count_if(F.col(c) == 0).alias(name)
    return _fact(spark, sf_dir).groupBy(big("purchase_date_key"), big("shipping_limit_date_key")).agg(total("customer_key"), total("location_key"), total("seller_key"), missing("seller_key", "unknown_sellers"), missing("product_key", "unknown_products"), total("status_key"), F.sum("price").cast("double").alias("price"))


@query("""SELECT count(*) AS items, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) + CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def d11_fact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second load of every fourth order, with dearer items, replaces their rows."""
    fact = _fact(spark, sf_dir, numbered=True)
    again = fact.filter("order_id % 4 = 0").withColumn("price", (F.col("price") + 1).cast("decimal(12,2)"))
    return star.load_fact_sales(fact, again).agg(F.count(F.lit(1)).alias("items"), F.sum("price").cast("double").alias("price"))


@query("""SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS purchase_date, count(*) AS items, CAST(sum(l_partkey) AS BIGINT) AS product_ids, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS item_price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 9 <> 0 GROUP BY 1""")
def m4_curated_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales that promotions apply to, without the items of the UNKNOWN product; every ninth product has no member."""
    from salesflow.operators.promotions import curated_extract

    members = merge.numbered(domain.products(spark, sf_dir).filter("product_id % 9 <> 0").select("product_id"), ["product_id"], "product_key", 0)
    o = domain.orders(spark, sf_dir)
    key = F.date_format("purchased_at", "yyyyMMdd").cast("int").alias("purchase_date_key")
    fact = domain.items(spark, sf_dir).join(o.select("order_id", key), "order_id").join(members, "product_id", "left").drop("product_id").withColumn("product_key", F.coalesce("product_key", F.lit(0)))
    rows = curated_extract(fact, merge.with_unknown(members, "product_key", product_id=0), star.calendar(star.date_roles(o, ["purchased_at"])))
    return rows.groupBy(F.date_format("purchase_date", "yyyy-MM-dd").alias("purchase_date")).agg(F.count(F.lit(1)).alias("items"), F.sum("product_id").cast("long").alias("product_ids"), F.sum("item_price").cast("double").alias("item_price"))


@query(f"WITH {PAYMENTS} SELECT 'status' AS dimension, o_orderstatus AS member, CASE WHEN o_orderstatus = 'delivered' THEN 1 ELSE 0 END AS flag FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'payment', payment_type, CASE WHEN payment_type IN ('credit_card', 'debit_card') THEN 1 ELSE 0 END FROM payments GROUP BY payment_type")
def d3_small_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the status and payment dimensions, with a flag of each."""
    status = star.dim_status(domain.orders(spark, sf_dir)).select(F.lit("status").alias("dimension"), F.col("order_status").alias("member"), F.col("is_completed").cast("int").alias("flag"))
    kinds = star.dim_payment(domain.payments(spark, sf_dir)).select(F.lit("payment").alias("dimension"), F.col("payment_type").alias("member"), (F.col("payment_group") == "card").cast("int").alias("flag"))
    return status.unionByName(kinds)


@query(f"WITH {PAYMENTS} SELECT CASE WHEN payment_type IN ('credit_card', 'debit_card') THEN 'card' WHEN payment_type = 'boleto' THEN 'payment slip' ELSE 'voucher' END AS payment_group, count(*) AS payments, CAST(sum(payment_value) AS DOUBLE) AS value, CAST(sum(payment_installments) AS BIGINT) AS installments FROM payments GROUP BY 1")
def d12_fact_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments fact, summed by payment group."""
    f = star.fact_payments(domain.payments(spark, sf_dir), domain.orders(spark, sf_dir))
    return f.groupBy("payment_group").agg(F.count(F.lit(1)).alias("payments"), F.sum("payment_value").cast("double").alias("value"), F.sum("payment_installments").cast("long").alias("installments"))


_KEY = lambda c: f"coalesce(CAST(strftime({c}, '%Y%m%d') AS BIGINT), 0)"
_DAYS = lambda a, b: f"CAST(round((epoch_us({b}) - epoch_us({a})) / 8.64e10, 2) AS DOUBLE)"


@query(f"WITH {ORDERS} SELECT order_id, {_KEY('purchased_at')} AS purchase_key, {_KEY('delivered_at')} AS delivered_key, CAST(round((epoch_us(approved_at) - epoch_us(purchased_at)) / 3.6e9, 2) AS DOUBLE) AS approval_hours, {_DAYS('purchased_at', 'delivered_at')} AS delivery_days, {_DAYS('estimated_at', 'delivered_at')} AS variance_days FROM retail_orders")
def d13_order_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle fact."""
    f = star.fact_lifecycle(domain.orders(spark, sf_dir))
    return f.select("order_id", big("purchase_key"), big("delivered_key"), *(F.col(c).cast("double").alias(c) for c in ("approval_hours", "delivery_days", "variance_days")))


@query(f"WITH {REVIEWS} SELECT CAST(review_score AS BIGINT) AS review_score, count(*) AS reviews, CAST(sum(CAST(round((epoch_us(answered_at) - epoch_us(created_at)) / 3.6e9, 2) AS DECIMAL(18,2))) AS DOUBLE) AS hours, count(title) AS titles, count(message) AS messages FROM reviews GROUP BY 1")
def d14_fact_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews fact, summed by score."""
    f = star.fact_reviews(domain.reviews(spark, sf_dir))
    return f.groupBy(big("review_score")).agg(F.count(F.lit(1)).alias("reviews"), F.sum("response_hours").cast("double").alias("hours"), F.count_if(F.col("has_title")).alias("titles"), F.count_if(F.col("has_message")).alias("messages"))


@query(f"WITH {ORDERS} SELECT count(*) AS delivered_orders, round(avg({_DAYS('purchased_at', 'delivered_at')}), 4) AS average_days, count(*) FILTER (WHERE {_DAYS('estimated_at', 'delivered_at')} <= 0) AS on_time_orders FROM retail_orders WHERE delivered_at IS NOT NULL")
def d15_delivery_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery figures of the lifecycle fact."""
    return star.delivery_kpis(star.fact_lifecycle(domain.orders(spark, sf_dir)))


@query("SELECT 'orders' AS name, count(*) AS fact_rows, count(*) AS source_rows FROM orders UNION ALL SELECT 'reviews', count(*), count(*) FROM orders WHERE o_orderkey % 3 = 0")
def d16_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact rows against source rows."""
    pairs = {"orders": (star.fact_lifecycle(domain.orders(spark, sf_dir)), table(spark, sf_dir, "orders")), "reviews": (star.fact_reviews(domain.reviews(spark, sf_dir)), table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0"))}
    parts = [f.agg(F.count(F.lit(1)).alias("fact_rows")).crossJoin(s.agg(F.count(F.lit(1)).alias("source_rows"))).select(F.lit(n).alias("name"), "fact_rows", "source_rows") for n, (f, s) in pairs.items()]
    return parts[0].unionByName(parts[1])


@query(f"WITH {ORDERS} SELECT count(*) FILTER (WHERE purchased_at IS NULL) AS purchase_key, count(*) FILTER (WHERE approved_at IS NULL) AS approved_key, count(*) FILTER (WHERE carrier_at IS NULL) AS carrier_key, count(*) FILTER (WHERE delivered_at IS NULL) AS delivered_key FROM retail_orders")
def d18_unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UNKNOWN keys of the lifecycle fact: only the delivery may be missing."""
    return star.unknown_keys(star.fact_lifecycle(domain.orders(spark, sf_dir)), ["purchase_key", "approved_key", "carrier_key", "delivered_key"])


@query("SELECT p_partkey AS product_id, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_brand END AS brand FROM part UNION ALL SELECT -p_partkey, 'new' FROM part WHERE p_partkey % 8 = 0")
def k13_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace on key, add new keys."""
    old = domain.products(spark, sf_dir).select("product_id", "brand")
    changed = old.filter("product_id % 4 = 0").withColumn("brand", F.lit("new"))
    added = old.filter("product_id % 8 = 0").select((-F.col("product_id")).alias("product_id"), F.lit("new").alias("brand"))
    return merge.upsert(old, changed.unionByName(added), ["product_id"])


@query("""WITH n AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS k FROM orders), d AS (SELECT DISTINCT k FROM n) SELECT (SELECT count(*) FROM n) AS source_rows, count(*) FILTER (WHERE k IS NULL OR k % 2 = 1) AS inserted, (SELECT count(*) FROM n) - count(*) FILTER (WHERE k IS NULL OR k % 2 = 1) AS duplicates FROM d""")
def k14_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert if absent, NULL keys equal: inserted against duplicates."""
    new = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k"), "o_orderkey")
    old = new.filter("k % 2 = 0").select("k").distinct()
    added = merge.insert_absent(old, new, ["k"], [F.col("o_orderkey")])
    return new.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(added.agg(F.count(F.lit(1)).alias("inserted"))).withColumn("duplicates", F.col("source_rows") - F.col("inserted"))


def _raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw text sales, broken by key."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 31 == 0, " ").otherwise(k.cast("string")).alias("order_id"), F.when(k % 13 == 0, "2026-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("order_date"), F.when(k % 37 != 0, F.col("o_custkey").cast("string")).alias("customer_id"),
        F.lit("name").alias("customer_name"), F.lit("7").alias("product_id"), F.lit("thing").alias("product_name"), F.col("o_orderpriority").alias("category"), F.when(k % 11 == 0, "none").when(k % 17 == 0, "0").otherwise("2").alias("quantity"),
        F.when(k % 19 == 0, "-1").otherwise("9.99").alias("unit_price"), F.when(k % 23 == 0, "").otherwise("east").alias("region"), k.alias("key"),
    )


@query("""SELECT concat_ws('; ', CASE WHEN k % 31 = 0 THEN 'order_id is empty' END, CASE WHEN k % 13 = 0 THEN 'order_date is not yyyy-MM-dd' END, CASE WHEN k % 37 = 0 THEN 'customer_id is empty' END, CASE WHEN k % 11 = 0 OR k % 17 = 0 THEN 'quantity must be > 0' END,
  CASE WHEN k % 19 = 0 THEN 'unit_price must be >= 0' END, CASE WHEN k % 23 = 0 THEN 'region is empty' END) AS reason, count(*) AS rows FROM (SELECT o_orderkey AS k FROM orders) GROUP BY 1""")
def q1_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reject reasons of raw sales, all in order."""
    rows = sales.typed_sales(_raw_sales(spark, sf_dir)).withColumn("reason", all_reasons(sales_rules(None)))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE k % 31 = 0 OR k % 13 = 0 OR k % 37 = 0 OR k % 11 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0) AS bad FROM (SELECT o_orderkey AS k FROM orders)), t AS (SELECT count(*) AS twice FROM orders WHERE o_orderkey % 5 = 0)
SELECT n + twice AS source_rows, twice AS duplicates, n - bad AS valid_rows, bad AS rejected_rows FROM c, t""")
def q1_row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source = duplicates + valid + rejected, with a fifth of the rows repeated."""
    raw = _raw_sales(spark, sf_dir).withColumn("product_name", F.col("key").cast("string"))
    return sales.row_identity(raw.unionByName(raw.filter("key % 5 = 0")).drop("key"))


@query("""SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS order_orphans, count(*) FILTER (WHERE c_custkey IS NULL) AS customer_orphans, count(*) FILTER (WHERE p_partkey IS NULL) AS product_orphans, count(*) FILTER (WHERE s_suppkey IS NULL) AS seller_orphans
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 7 <> 0 LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey AND p_partkey % 9 <> 0 LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def q5_join_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of each dimension of a star join with missing members."""
    d = domain
    joined = star.star_join(d.items(spark, sf_dir), d.orders(spark, sf_dir).filter("order_id % 7 <> 0").select("order_id", "customer_id"), d.customers(spark, sf_dir), d.products(spark, sf_dir).filter("product_id % 9 <> 0"), d.sellers(spark, sf_dir))
    return star.join_coverage(joined)


@query("""SELECT 'orders_customers' AS relation, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 0)
UNION ALL SELECT 'items_orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
UNION ALL SELECT 'items_products', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 30 <> 0)
UNION ALL SELECT 'items_sellers', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 20 <> 0)
UNION ALL SELECT 'payments_orders', count(*) FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
UNION ALL SELECT 'reviews_orders', count(*) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 50 = 0""")
def q6_orphan_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of six foreign keys over dimensions with missing members."""
    d = domain
    o, items = d.orders(spark, sf_dir), d.items(spark, sf_dir)
    some = o.filter("order_id % 50 <> 0")
    return star.orphan_counts({
        "orders_customers": (o, d.customers(spark, sf_dir).filter("customer_id % 40 <> 0"), "customer_id", "customer_id"),
        "items_orders": (items, some, "order_id", "order_id"),
        "items_products": (items, d.products(spark, sf_dir).filter("product_id % 30 <> 0"), "product_id", "product_id"),
        "items_sellers": (items, d.sellers(spark, sf_dir).filter("seller_id % 20 <> 0"), "seller_id", "seller_id"),
        "payments_orders": (d.payments(spark, sf_dir), some, "order_id", "order_id"),
        "reviews_orders": (d.reviews(spark, sf_dir), some, "order_id", "order_id"),
    })


@query("""SELECT 'quantity_positive' AS check_name, count(*) FILTER (WHERE NOT l_quantity > 0) AS violations FROM lineitem UNION ALL SELECT 'discount_below_5', count(*) FILTER (WHERE NOT l_discount < 0.05) FROM lineitem UNION ALL SELECT 'flag_is_letter', count(*) FILTER (WHERE NOT regexp_full_match(l_returnflag, '[A-Z]')) FROM lineitem""")
def q7_check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column constraints in one pass."""
    return gates.check_constraints(table(spark, sf_dir, "lineitem"), {"quantity_positive": F.col("l_quantity") > 0, "discount_below_5": F.col("l_discount") < 0.05, "flag_is_letter": F.col("l_returnflag").rlike("^[A-Z]$")})
