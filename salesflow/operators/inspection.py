"""Plans and results as rows: what a query's physical plan holds, and a signature of a result that has no order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAN = "id int, parent int, depth int, node string, kind string, join_kind string, pushed_filters string, partition_filters string, files long"


def _kind(node: str) -> str:
    if "Scan" in node:
        return "scan"
    if node == "BroadcastExchange":
        return "broadcast"
    if node == "Exchange":
        return "shuffle"
    for part, kind in (("Join", "join"), ("Product", "join"), ("Aggregate", "aggregate"), ("Sort", "sort"), ("Window", "window"), ("Python", "python"), ("Arrow", "python"), ("Pandas", "python")):
        if part in node:
            return kind
    return "other"


def plan_rows(frame: DataFrame) -> DataFrame:
    """A row for each node of the physical plan, as it stands: before a run as planned, after one as it ran, with the files that
    its scans read. A plan has few nodes; they are read on the driver."""
    found: list[tuple] = []

    def said(node, name: str) -> str | None:
        cell = node.metadata().get(name)
        return cell.get() if cell.isDefined() else None

    def visit(node, parent: int | None, depth: int) -> None:
        name = node.nodeName()
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ResultQueryStage": "plan", "TableCacheQueryStage": "plan"}.get(name)
        if inner:  # wrappers of adaptive execution
            return visit(getattr(node, inner)(), parent, depth)
        if name.startswith("WholeStageCodegen") or name == "InputAdapter":
            return visit(node.children().apply(0), parent, depth)
        kind, own = _kind(name), len(found)
        scan = kind == "scan" and node.getClass().getSimpleName() == "FileSourceScanExec"
        files = node.metrics().get("numFiles").get().value() if scan and node.metrics().contains("numFiles") else None
        found.append((own, parent, depth, name, kind, node.joinType().toString() if kind == "join" else None, said(node, "PushedFilters") if scan else None, said(node, "PartitionFilters") if scan else None, files))
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i), own, depth + 1)

    visit(frame._jdf.queryExecution().executedPlan(), None, 0)
    return frame.sparkSession.createDataFrame(found, PLAN)


def plan_counts(plans: dict[str, DataFrame]) -> DataFrame:
    """workload, scans, shuffles, joins, pushed (scans with pushed filters) of some queries' plans."""
    parts = [plan_rows(frame).withColumn("workload", F.lit(name)) for name, frame in plans.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    is_ = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.groupBy("workload").agg(is_("scan").alias("scans"), is_("shuffle").alias("shuffles"), is_("join").alias("joins"), F.count_if(F.length("pushed_filters") > 2).alias("pushed"))


def signature(rows: DataFrame) -> DataFrame:
    """n_rows, signature: SHA-256 over the sorted SHA-256s of the rows, whatever order and partitions they have. Rows are their
    columns by name as text, joined by '|', null as the sign for the empty set. Hashes meet in 4096 groups first, so the last step sees 4096 digests at most."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("∅")) for c in sorted(rows.columns)]
    hashed = rows.select(F.sha2(F.concat_ws("|", *cells), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    groups = hashed.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.count(F.lit(1)).alias("n"), joined("h").alias("d"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), joined("d").alias("signature"))
