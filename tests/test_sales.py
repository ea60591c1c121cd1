from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from salesflow.operators import sales
from salesflow.operators.sales import SALES_COLUMNS
from salesflow.sources import files

LINES = """1,2026-06-01,101,An,501,Laptop,Electronics,1,1200.00,Ha Noi
2,2026-06-01,102,Binh,502,Keyboard,Electronics,2,45.50,Da Nang
3,2026-06-02,103,Chi,503,Desk,Furniture,1,180.00,Ho Chi Minh
4,2026-06-03,101,An,504,Chair,Furniture,4,75.00,Ha Noi
5,2026-06-04,104,Dung,505,Notebook,Office,10,2.50,Can Tho
6,2026-06-04,105,Ha,501,Laptop,Electronics,1,1195.00,Da Nang
7,2026-06-05,106,Long,506,Monitor,Electronics,2,220.00,Ho Chi Minh
8,2026-06-05,102,Binh,507,Mouse,Electronics,3,18.00,Da Nang
9,2026-06-06,107,Minh,508,Pen,Office,20,1.20,Ha Noi
10,2026-06-07,108,Trang,503,Desk,Furniture,1,175.00,Can Tho"""


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sales") / "sales.csv"
    path.write_text(",".join(SALES_COLUMNS) + "\n" + LINES + "\n")
    return files.read_permissive_csv(spark, str(path), SALES_COLUMNS)


def test_golden_totals(raw):
    valid, rejected = sales.split_sales(raw)
    assert tuple(sales.sales_totals(valid).first()) == (10, 8, 45, Decimal("3684.00"))
    assert rejected.count() == 0
    assert tuple(sales.row_identity(raw).select("source_rows", "duplicates", "valid_rows", "rejected_rows").first()) == (10, 0, 10, 0)


def test_golden_groups(raw):
    valid, _ = sales.split_sales(raw)
    by = {r["category"]: (r["orders"], r["customers"], r["units_sold"], str(r["revenue"]), str(r["average_line_amount"])) for r in sales.sales_summary(valid, "category").collect()}
    assert by == {"Electronics": (5, 4, 9, "2980.00", "596.00"), "Furniture": (3, 3, 6, "655.00", "218.33"), "Office": (2, 2, 30, "49.00", "24.50")}
    by = {r["region"]: str(r["revenue"]) for r in sales.sales_summary(valid, "region").collect()}
    assert by == {"Ha Noi": "1524.00", "Da Nang": "1340.00", "Ho Chi Minh": "620.00", "Can Tho": "200.00"}


def test_reject_copy_and_corrupt_rows(spark, tmp_path):
    row = "1,2026-06-01,101,An,501,Laptop,Electronics,2,10.00,Ha Noi"
    (tmp_path / "s.csv").write_text("\n".join([",".join(SALES_COLUMNS), row, row, row.replace("2,10.00", "0,10.00"), "2,2026-13-01,,x,,y,,none,-1,", "short,row"]) + "\n")
    rows = files.read_permissive_csv(spark, str(tmp_path / "s.csv"), SALES_COLUMNS)
    valid, rejected = sales.split_sales(rows)
    assert [str(r["line_amount"]) for r in valid.collect()] == ["20.00"]
    reasons = sorted(r["rejection_reason"] for r in rejected.collect())
    assert len(reasons) == 3
    assert any(x.startswith("malformed row") for x in reasons)
    assert "order_date is not yyyy-MM-dd; customer_id is empty; product_id is empty; category is empty; quantity must be > 0; unit_price must be >= 0; region is empty" in reasons
    assert sales.row_identity(rows).first()["duplicates"] == 1


def test_white_space_variants_survive_dedup(spark):
    rows = spark.createDataFrame([("1",), (" 1",)], "order_id string")
    for c in SALES_COLUMNS[1:]:
        rows = rows.withColumn(c, F.lit("x"))
    assert sales.drop_copies(rows).count() == 2


def test_header_check_sees_duplicates(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,a,b\n1,2,3\n")
    with pytest.raises(ValueError, match="duplicate columns \\['a'\\]"):
        files.validate_header(spark, str(tmp_path / "h.csv"), ["a"])
    with pytest.raises(ValueError, match="missing columns \\['c'\\]"):
        files.validate_header(spark, str(tmp_path / "h.csv"), ["b", "c"])


def test_three_forms_of_the_category_summary_agree(spark, sf_dir):
    from salesflow.plans.analytics import _curated

    curated = _curated(spark, sf_dir).cache()
    forms = [f(curated).select("product_category", "lines", "gross") for f in (sales.category_summary, sales.category_summary_sql, sales.category_summary_rdd)]
    assert sales.equivalent(forms[0], forms[1]) and sales.equivalent(forms[0], forms[2])
    curated.unpersist()


def test_clean_table_reads_bad_cells_as_null(spark):
    raw = spark.createDataFrame([(" p1 ", "nan", "12.345", "x"), ("p2", "3.0", "1", "2020-01-01 00:00:00")], "product_id string, n string, v string, t string")
    spec = files.TableSpec(("product_id",), integers=("n",), decimals=("v",), timestamps=("t",))
    rows = {r["product_id"]: r for r in files.clean_table(raw, spec).collect()}
    assert rows["p1"]["n"] is None and str(rows["p1"]["v"]) == "12.35" and rows["p1"]["t"] is None
    assert rows["p2"]["n"] == 3 and rows["p2"]["t"] is not None


def test_share_of_total_is_100(spark):
    counts = spark.range(50).selectExpr("id % 5 AS k", "id AS n").filter("n > 0")
    worst = sales.share_of_total(counts, ["k"], "n").groupBy("k").agg(F.sum("percentage").alias("p")).agg(F.max(F.abs(F.col("p") - 100))).first()[0]
    assert worst < 0.01


def test_expand_and_copies_for(spark):
    rows = spark.range(3).selectExpr("id AS a", "id + 1 AS b")
    out = sales.expand_copies(rows, 4, ["a", "b"])
    assert out.count() == 12 and out.select("synthetic_id").distinct().count() == 12
    assert sales.copies_for(rows, 10_000) > 1


def test_plan_prunes_and_pushes(spark, tmp_path):
    from salesflow.sources.sinks import plan_text, read_back, write_partitioned

    rows = spark.range(100).selectExpr("id", "id % 4 AS order_year", "id % 3 AS order_month", "cast(id as string) AS note")
    write_partitioned(rows, str(tmp_path / "out"), ["order_year", "order_month"])
    read_back(spark, str(tmp_path / "out"), 100)
    frame = spark.read.parquet(str(tmp_path / "out/parquet")).filter("order_year = 3 AND id > 50").select("id")
    frame.collect()
    text = plan_text(frame)
    assert "PartitionFilters: [isnotnull(order_year" in text and "GreaterThan(id,50)" in text and "note" not in text


def test_file_metrics_skip_markers(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "m"))
    row = files.file_metrics(spark, str(tmp_path / "m")).first()
    assert row["files"] == 1 and row["bytes"] > 0


def test_layouts_are_united(spark, tmp_path):
    spark.range(2).selectExpr("id", "'x' AS d").write.partitionBy("d").parquet(str(tmp_path / "raw/new"))
    spark.range(3).selectExpr("id", "id AS extra").write.parquet(str(tmp_path / "raw/old"))
    rows = files.read_layouts(spark, str(tmp_path / "raw"), ["new/d=*", "old", "absent"])
    assert rows.count() == 5 and "extra" in rows.columns
    with pytest.raises(FileNotFoundError):
        files.read_layouts(spark, str(tmp_path / "raw"), ["absent"])


def test_corrupt_lines_are_seen_whatever_columns_are_read(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b,c\n1,2,3\n4,5,6,7\n8,9\n")
    rows = files.read_permissive_csv(spark, str(tmp_path / "c.csv"), ["a", "b", "c"])
    found = {r["a"]: r["bad"] for r in rows.select("a", F.col("_corrupt_record").isNotNull().alias("bad")).collect()}
    assert found == {"1": False, "4": True, "8": True}
    assert {r["b"] for r in rows.select("b").collect()} == {"2", "5", "9"}


def test_small_source_helpers(spark, tmp_path):
    from salesflow.operators.sales import has_duplicate_key
    from salesflow.session import build_session
    from salesflow.sources import feeds, sinks

    assert build_session("tests", spark__sql__ansi__enabled="true").conf.get("spark.sql.session.timeZone") == "UTC"
    assert feeds.kafka_options("h:1", "logs", "earliest", False) == {"kafka.bootstrap.servers": "h:1", "subscribe": "logs", "startingOffsets": "earliest", "failOnDataLoss": "false"}
    days = spark.range(1).select(feeds.day_range("2024-02-28", "2024-03-01").alias("d")).collect()
    assert [str(r["d"]) for r in days] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert files.sample_head(rows, None).count() == 3 and files.sample_head(rows, 2).count() == 2
    rows.write.parquet(str(tmp_path / "there"))
    assert files.missing_tables(spark, str(tmp_path), ["there", "absent"]) == ["absent"]
    rows.write.saveAsTable("analyzed")
    sinks.analyze(spark, "analyzed")
    assert "3 rows" in {r["col_name"]: r["data_type"] for r in spark.sql("DESCRIBE EXTENDED analyzed").collect()}["Statistics"]
    assert files.missing_tables(spark, str(tmp_path), ["analyzed"]) == []
    with pytest.raises(FileExistsError):
        for _ in range(2):
            sinks.load(rows, str(tmp_path / "table"), "fail")
    assert has_duplicate_key(rows, ["k"]) and not has_duplicate_key(rows, ["k", "v"])
