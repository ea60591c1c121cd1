"""What star joins and numbered items send through shuffles."""

import re

from pyspark.sql import functions as F

from salesflow.operators import star
from salesflow.plans import domain


def below(plan: str, wanted: str) -> list[str]:
    """The parts of a plan's tree under the nodes that hold a text."""
    lines = plan.split("\n")
    depth = [re.match(r"[ :+\-]*", x).end() for x in lines]
    parts = []
    for i, line in enumerate(lines):
        if wanted in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            parts.append("\n".join(lines[i + 1 : end]))
    return parts


def test_customers_are_met_by_orders_not_by_items(spark):
    items = spark.range(40).select((F.col("id") % 12).alias("order_id"))
    orders = spark.range(10).select(F.col("id").alias("order_id"), (F.col("id") % 6).alias("customer_id")).unionByName(spark.range(1).select(F.lit(3).cast("long").alias("order_id"), F.lit(99).cast("long").alias("customer_id")))
    customers = spark.range(5).select(F.col("id").alias("customer_id"))
    joined = star.star_join(items, orders.hint("merge"), customers.hint("merge"))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert any("Range (0, 5," in p and "Range (0, 40," not in p for p in below(plan, "Join LeftOuter"))
    rows = joined.agg(F.count(F.lit(1)), F.count("order_found"), F.count("customer_found")).first()
    # orders 10 and 11 are missing, order 3 is there twice, customers 5 and 99 are missing
    assert tuple(rows) == (44, 38, 31)


def test_a_filter_of_orders_comes_before_items_are_numbered(spark, sf_dir):
    plan = domain.items(spark, sf_dir, numbered=True).filter("order_id % 4 = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Filter")
