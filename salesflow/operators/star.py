"""Star join of order items, dimensions and facts of the retail star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.functions.scalar import date_key, days_between, hours_between, payment_group, status_group
from salesflow.operators.merge import point_in_time, upsert

def star_join(items: DataFrame, orders: DataFrame | None = None, customers: DataFrame | None = None, products: DataFrame | None = None, sellers: DataFrame | None = None) -> DataFrame:
    """Items with those of their order, customer (by the order), product and seller that are given, by left joins;
    `_found` flags show orphans. Spark picks broadcast or shuffle for each dimension by its size; a left join that no column
    is read of is not dropped by it, so give only the dimensions that are used."""
    dimensions = [(rows, key, flag) for rows, key, flag in ((orders, "order_id", "order_found"), (products, "product_id", "product_found"), (sellers, "seller_id", "seller_found")) if rows is not None]
    joined = items
    for rows, key, flag in dimensions:
        rows = rows.withColumn(flag, F.lit(True))
        if key == "order_id" and customers is not None:  # orders are fewer than items, which then move once for both
            rows = rows.join(customers.withColumn("customer_found", F.lit(True)), "customer_id", "left")
        joined = joined.join(rows, key, "left")
    if orders is None and customers is not None:
        joined = joined.join(customers.withColumn("customer_found", F.lit(True)), "customer_id", "left")
    return joined


def join_coverage(joined: DataFrame) -> DataFrame:
    """Rows and orphans of each dimension of a star join."""
    orphan = lambda flag: F.count_if(F.col(flag).isNull()).alias(flag.replace("found", "orphans"))
    return joined.agg(F.count(F.lit(1)).alias("rows"), *(orphan(f) for f in ("order_found", "customer_found", "product_found", "seller_found")))


def curated(joined: DataFrame) -> DataFrame:
    """The wide fact of the joined dimensions: defaults for orphans, gross amount, purchase date parts."""
    held = [c for c in ("order_id", "item_number", "product_id", "seller_id", "customer_id", "purchased_at", "price", "freight_value") if c in joined.columns]
    texts = [F.coalesce(F.col(c), F.lit("UNKNOWN")).alias(c) for c in ("order_status", "customer_state", "product_category", "seller_state") if c in joined.columns]
    parts = [F.year("purchased_at").alias("purchase_year"), F.month("purchased_at").alias("purchase_month")] if "purchased_at" in held else []
    return joined.select(*held, *texts, (F.col("price") + F.col("freight_value")).cast("decimal(18,2)").alias("gross_amount"), *parts)


def calendar(roles: DataFrame, column: str = "day") -> DataFrame:
    """The contiguous calendar from the first to the last day of all roles, with UNKNOWN under key 0 left to with_unknown."""
    ends = roles.agg(F.min(column).alias("a"), F.max(column).alias("b")).filter("a IS NOT NULL")
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    d = F.col("full_date")
    return days.select(
        date_key(d).cast("int").alias("date_key"), d.alias("full_date"), F.dayofmonth(d).alias("day_of_month"), (F.weekday(d) + 1).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_number"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter"), F.year(d).alias("year"), (F.weekday(d) >= 5).alias("is_weekend"),
    )


def date_roles(orders: DataFrame, columns: list[str]) -> DataFrame:
    """role, day of every date of the given roles."""
    parts = [orders.select(F.lit(c).alias("role"), F.to_date(c).alias("day")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("day IS NOT NULL")


def dim_status(orders: DataFrame) -> DataFrame:
    """Statuses with their group and flags."""
    s = F.col("order_status")
    return orders.select("order_status").distinct().select("order_status", status_group(s).alias("status_group"), (s == "delivered").alias("is_completed"), (s == "canceled").alias("is_cancelled"))


def dim_payment(payments: DataFrame) -> DataFrame:
    """Payment types with their group."""
    return payments.select("payment_type").distinct().withColumn("payment_group", payment_group(F.col("payment_type")))


def fact_lifecycle(orders: DataFrame) -> DataFrame:
    """One row for each order: five date roles (0 when missing), approval hours, delivery days, variance to the estimate."""
    key = lambda c: F.coalesce(date_key(F.to_date(c)), F.lit(0)).cast("int")
    t = F.col
    return orders.select(
        "order_id", key("purchased_at").alias("purchase_key"), key("approved_at").alias("approved_key"), key("carrier_at").alias("carrier_key"), key("delivered_at").alias("delivered_key"), key("estimated_at").alias("estimated_key"),
        hours_between(t("purchased_at"), t("approved_at")).alias("approval_hours"), days_between(t("purchased_at"), t("delivered_at")).alias("delivery_days"), days_between(t("estimated_at"), t("delivered_at")).alias("variance_days"),
    )


def fact_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """One row for each order and payment, with the order's date key and the payment group."""
    day = orders.select("order_id", date_key(F.to_date("purchased_at")).cast("int").alias("purchase_key"))
    return payments.join(day, "order_id", "left").select("order_id", "payment_sequential", F.coalesce("purchase_key", F.lit(0)).alias("purchase_key"), "payment_type", payment_group(F.col("payment_type")).alias("payment_group"), "payment_installments", "payment_value")


def fact_reviews(reviews: DataFrame) -> DataFrame:
    """One row for each review and order: score, response hours, has title, has message."""
    return reviews.select("review_id", "order_id", "review_score", hours_between(F.col("created_at"), F.col("answered_at")).alias("response_hours"), F.col("title").isNotNull().alias("has_title"), F.col("message").isNotNull().alias("has_message"))


def delivery_kpis(lifecycle: DataFrame) -> DataFrame:
    """delivered_orders, average days, on-time orders (variance <= 0)."""
    return lifecycle.filter("delivered_key > 0").agg(F.count(F.lit(1)).alias("delivered_orders"), F.round(F.avg(F.col("delivery_days").cast("double")), 4).alias("average_days"), F.count_if(F.col("variance_days") <= 0).alias("on_time_orders"))


def single_current(history: DataFrame, natural: str) -> DataFrame:
    """Natural keys that do not have exactly one current version."""
    return history.groupBy(natural).agg(F.count_if(F.col("is_current")).alias("current_versions")).filter("current_versions != 1")


def unknown_keys(fact: DataFrame, columns: list[str]) -> DataFrame:
    """How often each key column points at the UNKNOWN member."""
    return fact.agg(*(F.count_if(F.col(c) == 0).alias(c) for c in columns))


def location_dimension(observations: DataFrame, coordinates: DataFrame, modes: DataFrame) -> DataFrame:
    """Each postal prefix with its most frequent place and mean coordinates, if known."""
    centre = coordinates.groupBy("prefix").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))
    return modes.join(centre, "prefix", "left")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(*keys), keys, "left_anti")


def orphan_counts(relations: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """relation, orphans for each named foreign key (child, parent, child's column, parent's column); a NULL key is an orphan."""
    counts = [orphans(child.select(F.col(own).alias("k")), parent.select(F.col(other).alias("k")), ["k"]).agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("orphans")) for name, (child, parent, own, other) in relations.items()]
    return reduce(DataFrame.unionByName, counts)


def _with_key(rows: DataFrame, dimension: DataFrame, natural: str, key: str) -> DataFrame:
    """Rows with a dimension's key, 0 where it has no member; of one with validity the version at the purchase."""
    if "effective_from" in dimension.columns:
        return point_in_time(rows, dimension, natural, "purchased_at", key)
    return rows.join(dimension.select(natural, key), natural, "left").withColumn(key, F.coalesce(key, F.lit(0).cast("long")))


def fact_sales(items: DataFrame, orders: DataFrame, *, customers: DataFrame, products: DataFrame, sellers: DataFrame, locations: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row for each item with its seven keys, 0 where a dimension has no member: purchase and shipping dates, customer,
    location (customer_id, location_key), product and seller versions valid at the purchase, order status.

    Dimensions hold a natural key and their key; those with effective_from and effective_to are looked up at the purchase.
    """
    found = orders.select("order_id", "customer_id", "order_status", "purchased_at")
    # what hangs on the order is looked up for orders, which are fewer than items
    for dimension, natural, key in ((customers, "customer_id", "customer_key"), (locations, "customer_id", "location_key"), (statuses, "order_status", "status_key")):
        found = _with_key(found, dimension, natural, key)
    rows = items.join(found.drop("customer_id", "order_status"), "order_id")
    for dimension, natural, key in ((products, "product_id", "product_key"), (sellers, "seller_id", "seller_key")):
        rows = _with_key(rows, dimension, natural, key)
    day = lambda c: F.coalesce(date_key(F.to_date(c)), F.lit(0)).cast("int")
    return rows.select("order_id", "item_number", day("purchased_at").alias("purchase_date_key"), day("shipping_limit_at").alias("shipping_limit_date_key"), "customer_key", "location_key", "product_key", "seller_key", "status_key", "price", "freight_value")


def load_fact_sales(old: DataFrame | None, fact: DataFrame) -> DataFrame:
    """The fact table after a load: an item loaded again replaces its row."""
    return fact if old is None else upsert(old, fact, ["order_id", "item_number"])


