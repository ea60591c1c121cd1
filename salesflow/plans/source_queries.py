"""Scans, sinks and publishing over the given tables: each query writes whole tables to the shared folder and reads them back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from salesflow.operators import gates
from salesflow.plans import domain
from salesflow.plans.domain import PROMOTIONS, money, query, table
from salesflow.plans.feed_queries import _DISCOUNT, _LATEST, _SALES, _discounted
from salesflow.session import shared_place
from salesflow.sources import feeds, files, sinks


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_orderpriority").alias("priority"), money("o_totalprice").alias("total"), F.to_date("o_orderdate").alias("order_date"))


# ---------------------------------------------------------------- scans


@query("SELECT o_orderkey AS order_id, o_orderstatus AS order_status, o_orderkey % 7 = 0 AS is_corrupt FROM orders")
def s2_permissive_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text rows after a header check; lines with a surplus cell (every seventh) are kept and marked."""
    place, names = shared_place(spark, "csv"), ["order_id", "order_status", "priority"]
    line = F.concat_ws(",", *names, F.when(F.col("order_id") % 7 == 0, "surplus"))
    _orders(spark, sf_dir).select(line.alias(",".join(names))).write.option("header", True).option("sep", "|").csv(place)
    rows = files.read_permissive_csv(spark, place, names)
    return rows.select(F.col("order_id").cast("long"), "order_status", F.col("_corrupt_record").isNotNull().alias("is_corrupt"))


@query("SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders")
def s3_typed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed rows of CSV after a header check."""
    place = shared_place(spark, "csv")
    _orders(spark, sf_dir).select("order_id", "total", "order_date").write.option("header", True).csv(place)
    rows = files.read_typed_csv(spark, place, StructType.fromDDL("order_id long, total decimal(12,2), order_date date"))
    return rows.select("order_id", F.col("total").cast("double"), F.col("order_date").cast("string"))


@query("""SELECT CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_linenumber AS BIGINT) END AS item_number, count(*) AS rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS price, count(*) FILTER (WHERE l_orderkey % 7 <> 0) AS shipped FROM lineitem GROUP BY 1""")
def s4_clean_typed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells by the roles of their columns; cells that cannot be read become NULL."""
    place, k = shared_place(spark, "csv"), F.col("l_orderkey")
    raw = table(spark, sf_dir, "lineitem").select(
        k.alias("order_id"), F.when(k % 5 == 0, "many").otherwise(F.format_string("%d.0", F.col("l_linenumber").cast("long"))).alias("item_no"), money("l_extendedprice").alias("price"),
        F.when(k % 7 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("shipped_at"),
    )
    raw.write.option("header", True).csv(place)
    spec = files.TableSpec(("order_id",), integers=("item_number",), decimals=("price",), timestamps=("shipped_at",), renames={"item_no": "item_number"})
    rows = files.clean_table(files.read_format(spark, "csv", place), spec)
    return rows.groupBy(F.col("item_number").cast("long").alias("item_number")).agg(_count("rows"), F.sum("price").cast("double").alias("price"), F.count("shipped_at").alias("shipped"))


@query("SELECT o_orderkey AS order_id, o_orderstatus AS order_status FROM orders ORDER BY o_orderkey LIMIT 100")
def s5_head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred orders."""
    return files.sample_head(_orders(spark, sf_dir).select("order_id", "order_status").orderBy("order_id"), 100)


@query("""SELECT f.format, order_status, rows, total FROM (SELECT unnest(['csv', 'parquet', 'orc']) AS format) f, (SELECT o_orderstatus AS order_status, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY 1) s""")
def s6_format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows out of three formats, read by name."""
    place, rows = shared_place(spark, "formats"), _orders(spark, sf_dir)
    sinks.write_formats(rows, place)
    parts = [files.read_format(spark, f, f"{place}/{f}", rows.schema).groupBy("order_status").agg(_count("rows"), F.sum("total").cast("double").alias("total")).withColumn("format", F.lit(f)) for f in ("csv", "parquet", "orc")]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum, CAST(max(user_id) AS BIGINT) AS last_user FROM events GROUP BY 1")
def s7_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of inferred types."""
    place = shared_place(spark, "json")
    table(spark, sf_dir, "events").select("event_id", "event_type", "user_id").write.json(place)
    return files.read_json_lines(spark, place).groupBy("event_type").agg(_count("events"), F.sum("event_id").alias("id_sum"), F.max("user_id").alias("last_user"))


@query("SELECT c_mktsegment AS segment, count(*) AS customers, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer GROUP BY 1")
def s7_inferred_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV of inferred types."""
    place = shared_place(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.option("header", True).csv(place)
    return files.read_csv_inferred(spark, place).groupBy(F.col("c_mktsegment").alias("segment")).agg(_count("customers"), F.sum("c_custkey").alias("key_sum"))


@query("SELECT o_orderstatus AS order_status, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS with_priority FROM orders GROUP BY 1")
def s11_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned and a flat layout as one table; the first has no priority."""
    place, rows = shared_place(spark, "layouts"), _orders(spark, sf_dir)
    rows.filter("order_id % 2 = 0").select("order_id", "order_status").repartition("order_status").write.partitionBy("order_status").parquet(f"{place}/new")
    rows.filter("order_id % 2 = 1").select("order_id", "order_status", "priority").write.parquet(f"{place}/old")
    both = files.read_layouts(spark, place, ["new/order_status=*", "old", "older"])
    return both.groupBy("order_status").agg(_count("rows"), F.count("priority").alias("with_priority"))


@query("SELECT 'orders' AS source, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders UNION ALL SELECT 'items', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem")
def s12_frozen_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources frozen under one batch with a manifest, and replayed by it."""
    place = shared_place(spark, "batch")
    manifest = feeds.snapshot(spark, place, {"orders": _orders(spark, sf_dir), "items": domain.items(spark, sf_dir)})
    sums = [rows.agg(F.sum("order_id").alias("key_sum")).withColumn("source", F.lit(name)) for name, rows in feeds.replay(spark, place).items()]
    return manifest.drop("path").join(reduce(DataFrame.unionByName, sums), "source")


#: Products of a landed page.
PAGE = 500


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, data: the promotions of PAGE products each, as records of text."""
    names = [c.split()[0] for c in feeds.PROMOTION.split(", ")]
    rows = domain.promotions(spark, sf_dir).withColumn("promotion_name", F.col("promotion_id"))
    page = F.floor(F.col("product_id") / PAGE).cast("int")
    record = F.struct(*(F.col(c).cast("string").alias(c) for c in names))
    return rows.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("promotion_id", "version", record.alias("record")))).alias("sorted")).select("page", F.col("sorted.record").alias("data"))


@query(f"""WITH {PROMOTIONS} SELECT CAST(product_id // {PAGE} AS BIGINT) AS page, row_number() OVER (PARTITION BY product_id // {PAGE} ORDER BY promotion_id, version) - 1 AS record_index, promotion_id, CAST(version AS BIGINT) AS version, CAST(discount_value AS DOUBLE) AS discount_value FROM promotions""")
def s13_paged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages of a feed, one file each, with the place of every record."""
    place, pages = shared_place(spark, "pages"), _pages(spark, sf_dir)
    last = pages.agg(F.max("page")).first()[0] or 0
    body = F.to_json(F.struct("data", F.struct("page", (F.col("page") < last).alias("has_next")).alias("pagination")))
    pages.select(body.alias("value"), F.col("page").alias("number")).repartition("number").write.partitionBy("number").text(place)
    rows = feeds.read_pages(spark, place, page_cap=last + 1)
    return rows.select(F.col("page").cast("long"), F.col("record_index").cast("long"), "promotion_id", F.col("version").cast("long"), F.col("discount_value").cast("double"))


@query(f"WITH {PROMOTIONS} SELECT promotion_id, CAST(version AS BIGINT) AS version, status, CAST(discount_value AS DOUBLE) AS discount_value FROM promotions")
def s14_soap_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions out of SOAP responses."""
    names = [c.split()[0] for c in feeds.PROMOTION.split(", ")]
    cells = lambda r: F.concat(*(F.concat(F.lit(f"<ns:{c}>"), r[c], F.lit(f"</ns:{c}>")) for c in names))
    records = F.array_join(F.transform("data", lambda r: F.concat(F.lit("<ns:Promotion>"), cells(r), F.lit("</ns:Promotion>"))), "")
    body = F.concat(F.lit("<soap:Envelope><soap:Body>"), records, F.lit("</soap:Body></soap:Envelope>"))
    rows = feeds.from_soap(_pages(spark, sf_dir).select(body.alias("body")))
    return rows.select("promotion_id", F.col("version").cast("long"), "status", F.col("discount_value").cast("double"))


# ---------------------------------------------------------------- sinks


@query("SELECT f.format, CAST(year(o_orderdate) AS BIGINT) AS order_year, o_orderstatus AS order_status, count(*) AS rows FROM orders, (SELECT unnest(['parquet', 'orc']) AS format) f GROUP BY 1, 2, 3")
def k1_partitioned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet and ORC by two columns, their rows counted after the write."""
    place, rows = shared_place(spark, "files"), _orders(spark, sf_dir).withColumn("order_year", F.year("order_date"))
    sinks.write_partitioned(rows, place, ["order_year", "order_status"])
    sinks.read_back(spark, place, rows.count())
    parts = [files.read_format(spark, f, f"{place}/{f}").groupBy(F.col("order_year").cast("long").alias("order_year"), "order_status").agg(_count("rows")).withColumn("format", F.lit(f)) for f in ("parquet", "orc")]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT o_orderstatus AS order_status, count(*) AS orders, 'complete' AS run_status FROM orders GROUP BY 1")
def k3_one_file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in one file and its completion marker; a stale one is dropped first."""
    place, report = shared_place(spark, "report"), _orders(spark, sf_dir).groupBy("order_status").agg(_count("orders"))
    sinks.write_report(report.filter("orders < 0"), place)
    sinks.clear_reports(spark, place)
    sinks.write_report(report, place)
    status = files.read_json_lines(spark, f"{place}/run_status", "run_status string").first()["run_status"]
    return files.read_json_lines(spark, f"{place}/report", "order_status string, orders long").withColumn("run_status", F.lit(status))


@query("SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'merged' ELSE o_orderstatus END AS order_status FROM orders")
def k8_load_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is replaced, appended to and merged into."""
    place, rows = shared_place(spark, "modes"), _orders(spark, sf_dir).select("order_id", "order_status")
    sinks.load(rows.filter("order_id % 5 = 0"), place, "fail")
    sinks.load(rows.filter("order_id % 2 = 0"), place, "replace")
    sinks.load(rows.filter("order_id % 2 = 1"), place, "append")
    sinks.load(rows.filter("order_id % 3 = 0").withColumn("order_status", F.lit("merged")), place, "merge", ["order_id"])
    return sinks.published(spark, place)


@query("SELECT CAST(o_orderkey % 2 AS BIGINT) AS batch, o_orderstatus AS order_status, count(*) AS rows FROM orders WHERE o_orderkey % 2 = 1 OR (o_orderkey % 10 = 0 AND o_orderstatus <> 'F') GROUP BY 1, 2")
def k15_shrunk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that comes again with fewer rows and leaves replaces all that it wrote; the other batch stays."""
    place, rows, by = shared_place(spark, "batches"), _orders(spark, sf_dir).selectExpr("order_id", "order_status", "order_id % 2 AS batch"), ["batch", "order_status"]
    for batch in (0, 1):
        sinks.replace_batch(rows.filter(f"batch = {batch}"), place, by, {"batch": batch})
    sinks.replace_batch(rows.filter("batch = 0 AND order_id % 10 = 0 AND order_status <> 'F'"), place, by, {"batch": 0})
    return spark.read.parquet(place).groupBy(F.col("batch").cast("long").alias("batch"), "order_status").agg(_count("rows"))


@query("SELECT o_orderkey AS order_id, o_orderstatus AS order_status FROM orders")
def k16_gated_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that replaces the table once its checks have passed; a run that accepted nothing changes nothing."""
    place, rows = shared_place(spark, "snapshot"), _orders(spark, sf_dir).select("order_id", "order_status")
    figures = rows.agg(_count("n"), F.countDistinct("order_id").alias("keys"), F.count_if(F.col("order_id").isNull()).alias("nulls"))
    checks = gates.as_checks(figures, [gates.zero("unique_key", F.col("n") - F.col("keys")), gates.zero("no_null_key", F.col("nulls"))])
    n = rows.count()
    sinks.publish_snapshot(rows, place, checks, n, n, 2)
    sinks.publish_snapshot(rows.filter("order_id % 2 = 0"), place, checks, n, 0, 2)
    return sinks.published(spark, place)


# ---------------------------------------------------------------- tables and gates


@query("""WITH w AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders UNION ALL SELECT -o_orderkey, 'N' FROM orders WHERE o_orderkey % 4 = 0)
SELECT k AS order_id, CASE WHEN k % 5 = 0 THEN 'U' ELSE s END AS order_status FROM w WHERE k % 7 <> 0""")
def x1_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update and delete that one commit publishes; a second transaction is rolled back by not being committed."""
    place, rows = shared_place(spark, "dml"), _orders(spark, sf_dir).select("order_id", "order_status")
    sinks.publish(rows, place)
    work = sinks.Transaction(spark, place)
    work.insert(rows.filter("order_id % 4 = 0").select((-F.col("order_id")).alias("order_id"), F.lit("N").alias("order_status")))
    work.update("order_id % 5 = 0", order_status="'U'")
    work.delete("order_id % 7 = 0")
    work.commit()
    sinks.Transaction(spark, place).delete("order_id > 0")
    return sinks.published(spark, place)


@query("SELECT o_orderpriority AS priority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def x3_refreshed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary table that a second run replaces."""
    place, rows = shared_place(spark, "summary"), _orders(spark, sf_dir)
    for part in (rows.filter("order_id % 2 = 0"), rows):
        sinks.load(part.groupBy("priority").agg(_count("orders"), F.sum("total").cast("double").alias("total")), place, "replace")
    return sinks.published(spark, place)


@query(f"""WITH {_SALES}, {_LATEST}, d AS (SELECT item_price, freight_value, {_DISCOUNT} AS discount FROM sale s LEFT JOIN live p ON s.product_id = p.product_id AND purchase_date BETWEEN starts_on AND ends_on),
f AS (SELECT 'nonnegative_discount' AS check_name, count(*) FILTER (WHERE discount < 0) AS n FROM d UNION ALL SELECT 'discount_within_price', count(*) FILTER (WHERE discount > item_price) FROM d UNION ALL SELECT 'nonnegative_net', count(*) FILTER (WHERE item_price + freight_value - discount < 0) FROM d
  UNION ALL SELECT 'unique_grain', count(*) - count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) FROM lineitem UNION ALL SELECT 'accepted_rows', -count(*) FILTER (WHERE p_partkey % 10 = 0) FROM part)
SELECT check_name, CAST(n AS DOUBLE) AS actual, n = 0 AS passed FROM f""")
def q10_v1_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pipeline's gate over discounted sales, with a tenth of the raw promotions invalid but counted as accepted."""
    curated = _discounted(spark, sf_dir).withColumns({"promotion_id": F.col("product_id").cast("string"), "promotion_version": F.lit(1)})
    raw = domain.products(spark, sf_dir).select((F.col("product_id") % 10 != 0).alias("is_valid"))
    return gates.v1_gate(curated, raw, raw.count())
