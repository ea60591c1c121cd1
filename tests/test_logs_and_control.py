from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from salesflow.functions.rules import all_reasons, promotion_rules
from salesflow.functions.scalar import canonical_hash, discount, floor_minutes
from salesflow.operators import control, logs, promotions
from salesflow.streaming import service_logs

EVENT = '{"ts":"2026-07-01T10:00:00Z","service":" api ","method":" get ","path":"/x","status_code":200,"latency_ms":%s}'


def raw(spark, *values):
    return spark.createDataFrame([(v.encode() if v else None,) for v in values], "value binary")


def test_v1_reasons(spark):
    rows = raw(spark, EVENT % 5, EVENT % -5, EVENT.replace('" get "', "null") % 5, "not-json")
    got = [(r["rejection_reason"], r["method"]) for r in logs.classify_v1(rows).collect()]
    assert got == [(None, "GET"), ("invalid_latency_ms", "GET"), ("invalid_method", None), ("malformed_json", None)]
    ratio = logs.acceptance(logs.classify_v1(rows)).first()
    assert (ratio["processed_records"], ratio["accepted_records"], ratio["rejection_ratio"]) == (4, 1, 0.75)
    assert logs.acceptance(logs.classify_v1(rows.limit(0))).first()["rejection_ratio"] == 0.0
    assert logs.quarantine(logs.classify_v1(rows)).count() == 3


def test_v2_marks_late_events_but_keeps_them(spark):
    body = '{"event_id":"e1","event_time":"2026-07-01T%s+00:00","service":"a","method":"HEAD","path":"/","status_code":204,"latency_ms":1}'
    rows = logs.classify_v2(raw(spark, body % "10:00:00", body % "09:57:59"), 120, F.lit("2026-07-01 10:00:00").cast("timestamp")).collect()
    assert [(r["is_valid"], r["validation_error"], r["rotation_5m"]) for r in rows] == [(True, "", "20260701T1000Z"), (False, "event is later than allowed", "20260701T0955Z")]


def test_lag_and_rotation(spark):
    stats = spark.sql("SELECT timestamp'2026-07-01 09:58:30' AS oldest_valid_event")
    lag = lambda at: logs.ingestion_lag(stats, F.lit(at).cast("timestamp")).first()["lag_seconds"]
    assert (lag("2026-07-01 10:00:00"), lag("2026-07-01 09:00:00")) == (90, 0)
    slot = spark.sql("SELECT explode(array(timestamp'2026-07-01 10:04:59', timestamp'2026-07-01 10:05:00')) AS t").select(floor_minutes(F.col("t"), 5).alias("s"))
    assert [str(r["s"])[11:16] for r in slot.collect()] == ["10:00", "10:05"]


def test_discounts_and_hashes(spark):
    rows = spark.createDataFrame([(100, "percentage", 10), (7, "fixed", 20), (100, "none", 50)], "p int, k string, v int")
    amounts = rows.select(discount(F.col("p").cast("decimal(12,2)"), F.col("k"), F.col("v").cast("decimal(12,2)")).alias("d")).collect()
    assert [float(r["d"]) for r in amounts] == [10.0, 7.0, 0.0]
    both = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b").select(canonical_hash("a", "b"), canonical_hash("b", "a"), canonical_hash("a")).first()
    assert both[0] == both[1] != both[2]


def test_overlapping_promotions_fan_out(spark):
    sales = spark.sql("SELECT 'o' AS order_id, 1 AS item_number, 'x' AS product_id, date'2026-01-02' AS purchase_date, CAST(10 AS DECIMAL(12,2)) AS item_price, CAST(1 AS DECIMAL(12,2)) AS freight_value")
    p = spark.sql("SELECT explode(array('a', 'b')) AS promotion_id, 'x' AS product_id, 1 AS version, 'fixed' AS discount_type, CAST(20 AS DECIMAL(12,2)) AS discount_value, '2026-01-02' AS starts_at, '2026-01-02' AS ends_at")
    rows = promotions.apply_promotions(sales, p).collect()
    assert len(rows) == 2 and all(float(r["net_amount"]) == 1.0 for r in rows)


def test_inactive_newest_removes_the_promotion(spark):
    p = spark.sql("SELECT 'a' AS promotion_id, v AS version, IF(v = 2, 'inactive', 'active') AS status, timestamp'2026-01-01' + make_interval(0, 0, 0, v) AS updated_at FROM VALUES (1), (2) t(v)")
    assert promotions.latest_active(p).count() == 0 and promotions.latest_version(p).first()["version"] == 2


def test_promotion_reasons(spark):
    fields = {"promotion_id": "p", "product_id": "1", "discount_type": "percentage", "discount_value": "150", "starts_at": "2026-02-01", "ends_at": "2026-01-01", "version": "0", "status": "gone", "updated_at": ""}
    row = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields)).select(all_reasons(promotion_rules()).alias("r")).first()["r"]
    assert row == "percentage is over 100; starts_at is after ends_at; version must be >= 1; status must be active or inactive; updated_at is required"


def test_windows_and_watermarks(spark):
    at = lambda h: datetime(2026, 7, 1, h, tzinfo=timezone.utc)
    day = timedelta(days=1)
    assert control.next_window(at(5), at(6), at(3), True, day) == (at(3), at(6))
    assert control.next_window(at(5), at(6), at(3), False, day) == (at(5), at(6))
    for mark in (at(6), at(1) - 40 * day):
        with pytest.raises(control.ContractError):
            control.next_window(at(5), at(6), mark, True, day)
    assert control.settled_until(datetime(2026, 7, 1, 10, 9, 59, tzinfo=timezone.utc)) == datetime(2026, 7, 1, 10, 5, tzinfo=timezone.utc)
    with pytest.raises(control.ContractError):
        control.settled_until(at(1), settlement=100)
    marks = spark.sql("SELECT 'p' AS pipeline, timestamp'2026-07-01' AS watermark")
    window = lambda a, b: spark.sql(f"SELECT 'p' AS pipeline, timestamp'{a}' AS window_start, timestamp'{b}' AS window_end, 'r' AS run_id")
    after = lambda w: str(control.advance_watermarks(marks, w).first()["watermark"])[:10]
    assert [after(window(*w)) for w in (("2026-06-30", "2026-07-02"), ("2026-06-01", "2026-06-02"), ("2026-07-02", "2026-07-03"))] == ["2026-07-02", "2026-07-01", "2026-07-01"]


def test_epochs_and_lineage():
    assert control.epoch_action(64, 63) == "process" and control.epoch_action(7, -1) == "process"
    assert control.epoch_action(63, 63, "success") == "replay"
    for bad in ((0, 63, None), (63, 63, "failed"), (65, 63, None)):
        with pytest.raises(control.ContractError):
            control.epoch_action(*bad)
    assert control.lineage_of("new", 64, 63, "old") == "old" and control.lineage_of("new", 0, 63, "old") == "new"
    with pytest.raises(control.ContractError):
        control.check_generation({"g": {"query": "q", "checkpoint": "c"}}, "g", "q", "other")
    with pytest.raises(control.ContractError):
        control.check_generation({"g": {"query": "q", "checkpoint": "c", "status": "superseded"}}, "g", "q", "c")


def test_failure_does_not_override_success(spark):
    events = spark.createDataFrame([("p", "r", 1, "success", 1, 5), ("p", "r", 2, "failed", 2, 0)], "pipeline string, run_id string, seq int, status string, attempt int, rows int")
    row = control.run_states(events).first()
    assert (row["status"], row["attempt"], row["rows"]) == ("success", 2, 5) and control.next_attempt(events, "r") == 3 and control.next_attempt(events, "new") == 1


def stream_rows(spark, path, *values):
    rows = [(v.encode(), "logs", 0, i, None) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "value binary, topic string, partition int, offset long, timestamp timestamp").coalesce(1).write.mode("append").parquet(path)


def test_three_queries_on_one_stream(spark, tmp_path):
    from salesflow.sources.feeds import log_stream

    landed, base = str(tmp_path / "in"), str(tmp_path / "out")
    late = EVENT.replace("10:00:00", "10:30:00")
    stream_rows(spark, landed, EVENT % 250, EVENT.replace("200", "500") % 250, "not-json", late % 1)
    service_logs.run_until_done(service_logs.start_three(log_stream(spark, landed), base))
    rows = spark.read.parquet(f"{base}/report").collect()
    assert sorted((r["status_code"], r["requests"], r["avg_latency_ms"], r["is_error"]) for r in rows) == [(200, 1, 250.0, False), (500, 1, 250.0, True)]
    assert spark.read.parquet(f"{base}/quarantine").first()["rejection_reason"] == "malformed_json"
    assert spark.read.parquet(f"{base}/metrics/*").agg(F.sum("processed_records")).first()[0] == 4
    service_logs.run_until_done(service_logs.start_three(log_stream(spark, landed), base))
    assert spark.read.parquet(f"{base}/report").count() == 2


def test_epoch_stream_resumes(spark, tmp_path):
    from salesflow.sources.feeds import log_stream

    body = '{"event_id":"e%d","event_time":"2026-07-01T10:00:00Z","service":"a","method":"GET","path":"/","status_code":200,"latency_ms":10}'
    landed, base = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        stream_rows(spark, landed, body % k)
        service_logs.start_epochs(log_stream(spark, landed), base, "g", max_delay_seconds=10**9).awaitTermination()
    row = service_logs.live_report(spark, base, ["g"]).first()
    assert (row["request_count"], row["avg_latency_ms"]) == (2, 10.0)


def epoch_batch(spark, *times):
    body = '{"event_id":"e%d","event_time":"%s","service":"a","method":"GET","path":"/","status_code":200,"latency_ms":10}'
    return spark.createDataFrame([((body % (k, t)).encode(),) for k, t in enumerate(times)], "value binary")


def test_a_retry_judges_events_by_the_first_attempt(spark, tmp_path, monkeypatch):
    base, now = str(tmp_path), datetime(2026, 7, 1, 10, 0, 30, tzinfo=timezone.utc)

    class Clock(datetime):
        at = None

        @classmethod
        def now(cls, tz=None):
            return cls.at

    Clock.at = now
    monkeypatch.setattr(service_logs, "datetime", Clock)
    broken = []

    def fail(step, epoch):
        if step == "contributions" and not broken:
            broken.append(step)
            raise RuntimeError

    process = service_logs.epoch_writer(spark, base, "g", max_delay_seconds=40, fail=fail)
    batch = epoch_batch(spark, "2026-07-01T10:00:00Z", "yesterday")  # no queue time: a bad time falls into the leaf of the landing time
    with pytest.raises(RuntimeError):
        process(batch, 0)
    Clock.at = now + timedelta(minutes=7)
    process(batch, 0)
    assert [(r["request_count"], r["avg_latency_ms"]) for r in service_logs.live_report(spark, base).collect()] == [(1, 10.0)]
    record = service_logs.Control(spark, f"{base}/control").record("g", 0)
    assert (record["status"], record["raw_count"], record["valid_count"]) == ("success", 2, 1) and record["lag_seconds"] > 0
    assert spark.read.parquet(f"{base}/raw").count() == 2


def test_generations_are_registered_and_superseded(spark, tmp_path):
    base = str(tmp_path)
    times = [f"2026-07-01T10:0{k}:00Z" for k in range(4)]
    late = {"max_delay_seconds": 10**9}
    first = service_logs.epoch_writer(spark, base, "g1", **late)
    first(epoch_batch(spark, times[0]), 0)
    with pytest.raises(control.ContractError):  # a generation is bound to its checkpoint
        service_logs.epoch_writer(spark, base, "g1", checkpoint="elsewhere", **late)(epoch_batch(spark, times[1]), 1)
    service_logs.epoch_writer(spark, base, "g2", **late)(epoch_batch(spark, times[1]), 1)  # goes on: same lineage
    assert service_logs.live_report(spark, base).count() == 2
    with pytest.raises(control.ContractError):  # superseded
        first(epoch_batch(spark, times[2]), 1)
    service_logs.epoch_writer(spark, base, "g3", **late)(epoch_batch(spark, times[3]), 0)  # starts anew
    assert [str(r["minute_start"])[11:16] for r in service_logs.live_report(spark, base).collect()] == ["10:03"]


class Killed(BaseException):
    """The process ends: nothing after it runs."""


@pytest.mark.parametrize("step", ["start", "reserved", "raw", "contributions", "succeeded"])
@pytest.mark.parametrize("first", [True, False])
def test_a_kill_between_any_two_writes_leaves_a_whole_report(spark, tmp_path, step, first):
    """A new generation that starts its own lineage, or goes on with the old one, is killed in its first epoch."""
    base, times, late = str(tmp_path), [f"2026-07-01T10:0{k}:00Z" for k in range(3)], {"max_delay_seconds": 10**9}
    service_logs.epoch_writer(spark, base, "g1", **late)(epoch_batch(spark, times[0]), 0)
    epoch, killed = 0 if first else 1, []

    def fail(at, number):
        if at == step and not killed:
            killed.append(at)
            raise Killed

    minutes = lambda: sorted(str(r["minute_start"])[14:16] for r in service_logs.live_report(spark, base).collect())
    wanted = ["01"] if first else ["00", "01"]
    with pytest.raises(Killed):
        service_logs.epoch_writer(spark, base, "g2", fail=fail, **late)(epoch_batch(spark, times[1]), epoch)
    assert minutes() == (wanted if step == "succeeded" else ["00"])
    again = service_logs.epoch_writer(spark, base, "g2", **late)
    again(epoch_batch(spark, times[1]), epoch)
    assert minutes() == wanted
    again(epoch_batch(spark, times[2]), epoch + 1)
    assert minutes() == [*wanted, "02"]
    states = service_logs.Control(spark, f"{base}/control").state()["generations"]
    assert [g for g, v in states.items() if v["is_active"]] == ["g2"]


def test_records_are_compacted_and_no_step_lists_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(service_logs, "RECENT", 3)
    control = service_logs.Control(spark, str(tmp_path / "control"))
    for epoch in range(20):
        control.reserve("g", epoch)
        control.succeed("g", "q", "c", epoch, {"raw_count": epoch})
    rows = control.records()
    assert sorted((r["epoch"], r["raw_count"], r["status"]) for r in rows.collect()) == [(k, k, "success") for k in range(20)]
    state = control.state()
    assert len(state["recent"]) < 6 and control.last_success("g") == 19 and len(state["files"]) >= 4
    monkeypatch.setattr(type(spark), "read", property(lambda self: pytest.fail("a step reads files of records")))
    assert control.last_success("g") == 19 and control.record("g", 19)["raw_count"] == 19
    control.reserve("g", 20)
    assert len(control.commits.numbers()) <= 3


def test_two_queries_share_a_control(spark, tmp_path):
    """Both race for the same commit; the loser makes its change again."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "control")

    def run(query):
        control = service_logs.Control(spark, path)
        for epoch in range(6):
            control.reserve(query, epoch)
            control.succeed(query, query, "c" + query, epoch, {"raw_count": 1})

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(run, ["a", "b", "c"]))
    state = service_logs.Control(spark, path).state()
    assert {g: v["last"] for g, v in state["generations"].items()} == {"a": 5, "b": 5, "c": 5} and len(state["recent"]) == 18


def test_planned_windows_follow_the_rule_for_one_run(spark):
    at = lambda d, h=0: datetime(2026, 1, d, h, tzinfo=timezone.utc)
    longest, runs = timedelta(days=7), []
    for k, (mark, scheduled) in enumerate((m, s) for m in (None, at(1), at(4, 23), at(5), at(11), at(12), at(13)) for s in (True, False)):
        runs.append((f"p{k}", at(11), at(12), scheduled, mark))
    requests = spark.createDataFrame([r[:4] for r in runs], "pipeline string, window_start timestamp, window_end timestamp, scheduled boolean")
    marks = spark.createDataFrame([(r[0], r[4]) for r in runs if r[4]], "pipeline string, watermark timestamp")
    planned = control.planned_windows(requests, marks, longest)
    got = {r.pipeline: r for r in planned.select("pipeline", F.unix_seconds("window_start").alias("a"), F.unix_seconds("window_end").alias("b"), "error").collect()}
    assert len(got) == len(runs)
    for name, start, end, scheduled, mark in runs:
        try:
            a, b = control.next_window(start, end, mark, scheduled, longest)
            assert (got[name].a, got[name].b, got[name].error) == (int(a.timestamp()), int(b.timestamp()), None)
        except control.ContractError as broken:
            assert got[name].a is None and got[name].b is None
            assert got[name].error == ("no new window" if "no new window" in str(broken) else "gap too long")


def test_rows_due_are_half_open_and_none_of_a_broken_run(spark):
    planned = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-02', NULL), ('b', NULL, NULL, 'gap too long') t(pipeline, window_start, window_end, error)")
    source = spark.sql("SELECT p AS pipeline, t AS at FROM VALUES ('a'), ('b'), ('c') x(p), VALUES (TIMESTAMP '2025-12-31 23:59:59'), (TIMESTAMP '2026-01-01'), (TIMESTAMP '2026-01-01 23:59:59'), (TIMESTAMP '2026-01-02') y(t)")
    rows = control.rows_due(source, planned, "at")
    assert rows.columns == ["pipeline", "at"]
    assert sorted((r.pipeline, r.at.day, r.at.hour) for r in rows.collect()) == [("a", 1, 0), ("a", 1, 23)]


def test_column_statistics_of_odd_columns(spark):
    from salesflow.sources import sinks

    try:
        sinks.save_table(spark.sql("SELECT id, CAST(NULL AS INT) AS `none at all`, IF(id % 2 = 0, 'x', NULL) AS t FROM range(10)"), "odd_columns")
        sinks.analyze(spark, "odd_columns")
        rows = {r.column_name: (r.rows, r.nulls, r.least, r.greatest) for r in sinks.column_statistics(spark, "odd_columns").collect()}
        assert rows == {"id": (10, 0, "0", "9"), "none at all": (10, 10, None, None), "t": (10, 5, None, None)}
    finally:
        spark.sql("DROP TABLE IF EXISTS odd_columns")


def test_alerts_take_whole_seconds(spark, tmp_path):
    """A last event 75.1 seconds before now is not over 75 whole seconds, though both round to 76 apart."""
    import duckdb
    from parity import assert_parity, connect

    from salesflow.plans.registry import ORACLE_SQL, QUERIES

    duckdb.sql(f"""COPY (SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-01 00:01:15.6', 1, 'view'), (2, TIMESTAMP '2024-01-01 00:00:00.4', 2, 'view'), (3, TIMESTAMP '2023-12-31 23:59:59.9', 3, 'view'))
        t(event_id, ts, user_id, event_type)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")  # fmt: skip
    found = {tuple(r) for r in QUERIES["c9_alerts"](spark, str(tmp_path)).collect()}
    assert ("view2", "LogStreamStopped") not in found and ("view3", "LogStreamStopped") in found
    assert_parity(spark, connect(str(tmp_path)), QUERIES["c9_alerts"], ORACLE_SQL["c9_alerts"], str(tmp_path))


def test_a_message_is_parsed_once(spark):
    rows = raw(spark, EVENT % 5, "not-json", None)
    for classified in (logs.classify_v1(rows), logs.classify_v2(rows)):
        for part in (classified.filter("is_valid"), classified.filter("NOT is_valid")):
            assert part._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
        assert classified.count() == 3
    assert [r["is_valid"] for r in logs.classify_v1(rows).collect()] == [True, False, False]
