"""Exact top-k inner products by best-first search over M-trees.

Inner product becomes nearest neighbour: with B the largest norm, x' = (x, sqrt(B^2 - |x|^2)) and
q' = (q, 0), |q' - x'|^2 = |q|^2 + B^2 - 2 q.x, and Euclidean distance is a metric on them.

Plan: equal vectors are folded first (only their k+1 smallest ids can matter), so a hot vector is one
object. The index is one paged tree. Its upper pages are rows: a group of more than CELL objects draws up to
FANS of them by hash as routing objects, its objects go to the nearest one, and the page holds each
one's covering radius; groups split until none is over CELL. Each last group is one row with an M-tree of its
own: pages of routing objects with covering radii and distances to their parent.

Search works on blocks of queries: pages and the queries that visit them are streamed together, so distances are
matrix products. Queries first descend to their nearest last group, which bounds their k-th score; then they descend
to every page that the bound and the covering balls cannot rule out, and only those visits are sent on. In a group's
tree a block takes pages from a heap by their lower bound; a page or object whose stored distance to its
parent already rules it out by the triangle inequality is skipped without computing its distance.

Scores are exact: floats are, while dim * max^2 stays below 2^53; beyond it floats with their error bounds only choose
candidates, whose scores are computed in whole numbers. Distance bounds leave a margin for rounding.

Defined results: vectors that are null, hold null or non-finite components, or differ in length from
the commonest length take no part; a null vec_id takes no part; of repeated rows of a vec_id the smallest vector
counts; extra columns are ignored; no queries give no rows. A scaled component, or a score among the results, that
does not fit 64 bits is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship

#: Objects of a last group, routing objects of an upper page.
CELL, FANS = 4096, 512
#: Objects of a leaf page and routing objects of an inner page of a group's tree; queries of a block.
LEAF, FANOUT, BLOCK = 128, 16, 256
#: Rows that one copy of a page meets in one task.
MET = 32_768
#: Relative margin of stored distances for rounding.
SLACK = 1e-9


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each usable vector."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    part = lambda c: F.when(F.abs(c * scale) >= F.lit(2.0**62), F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("long")).otherwise(F.floor(c * F.lit(float(scale))))
    rows = x.filter(fine).select("vec_id", F.transform("x", part).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def folded(rows: DataFrame, keep: int) -> DataFrame:
    """v, ids: each distinct vector with its `keep` smallest ids, ascending."""
    hot = Window.partitionBy("v").orderBy("vec_id")  # the limit below is applied in each task before the shuffle
    few = rows.withColumn("n", F.row_number().over(hot)).filter(F.col("n") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Lift:
    """The lifted space: its largest squared norm, and what rounding can do to distances from a query."""

    def __init__(self, dim: int, norm2: float, largest: int):
        self.dim, self.norm2 = dim, norm2
        self.exact = dim * largest * largest < 1 << 53

    def reach(self, q: np.ndarray) -> np.ndarray:
        """|q|^2 + B^2, so a distance d means the inner product (reach - d^2) / 2."""
        return (q * q).sum(1) + self.norm2

    def margin(self, reach: np.ndarray) -> np.ndarray:
        """Beyond what rounding can add to or take from a computed distance and a bound."""
        return 3 * np.sqrt(self.dim * 2.0**-48 * reach) + SLACK

    def distances(self, q: np.ndarray, reach: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, reach[:, None] - 2.0 * (q @ x.T)))

    def limit(self, reach: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Distances beyond it cannot lead into the k best; equal scores can, by a smaller id."""
        return np.sqrt(np.maximum(0.0, reach - 2.0 * np.where(np.isfinite(kth), kth, -np.inf))) * (1 + SLACK) + self.margin(reach)


class Tree:
    """An M-tree over lifted objects, as arrays: pages in order, the root first."""

    def __init__(self, points: np.ndarray):
        self.order: list[int] = []
        # of each page: first and last of its objects (leaf) or child pages, centre, radius, distance to parent
        self.pages: list[list] = []
        self.points = points
        self.to_parent = np.zeros(len(points))
        self._grow(points)

    def _grow(self, points: np.ndarray) -> None:
        centre = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
        self.pages.append([np.arange(len(points)), centre, 0.0])
        at = 0
        while at < len(self.pages):
            members, centre, _ = self.pages[at]
            near = np.sqrt(((points[members] - points[centre]) ** 2).sum(1))
            page = self.pages[at]
            page.append(float(near.max()) if len(near) else 0.0)
            if len(members) <= LEAF:
                self.to_parent[members] = near
                page.append(())
            else:
                seeds = self._seeds(points, members, centre, near)
                apart = np.stack([((points[members] - points[s]) ** 2).sum(1) for s in seeds], 1)
                own = apart.argmin(1)
                if np.bincount(own, minlength=len(seeds)).max() == len(members):
                    own = np.arange(len(members)) % len(seeds)
                children = []
                for k, s in enumerate(seeds):
                    if (own == k).any():
                        children.append(len(self.pages))
                        self.pages.append([members[own == k], s, float(np.sqrt(((points[s] - points[centre]) ** 2).sum()))])
                page.append(tuple(children))
            at += 1

    @staticmethod
    def _seeds(points: np.ndarray, members: np.ndarray, centre: int, near: np.ndarray) -> list[int]:
        """Routing objects: the farthest from those already taken."""
        seeds, best = [], near.copy()
        for _ in range(FANOUT):
            seeds.append(int(members[int(best.argmax())]))
            best = np.minimum(best, np.sqrt(((points[members] - points[seeds[-1]]) ** 2).sum(1)))
        return list(dict.fromkeys(seeds))


class Cell:
    """A stored tree, ready to be searched."""

    def __init__(self, row: dict, lift: Lift):
        n = row["n"]
        self.lift = lift
        self.v = np.frombuffer(row["tree"], "<i8").reshape(n, lift.dim)
        self.x = self.v.astype(np.float64)
        self.norms = np.sqrt((self.x * self.x).sum(1))
        self.ids = row["ids"]
        self.first_id = np.array([i[0] for i in self.ids], np.int64)
        self.alone = np.array([len(i) == 1 for i in self.ids])
        self.to_parent = np.frombuffer(row["to_parent"], "<f8")
        self.centre = np.array(row["centre"], np.int64)
        self.radius, self.page_parent = np.array(row["radius"]), np.array(row["page_parent"])
        self.first, self.last = np.array(row["first"], np.int64), np.array(row["last"], np.int64)
        self.child_first, self.child_last = np.array(row["child_first"], np.int64), np.array(row["child_last"], np.int64)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
        """The (query, vec_id, score) of this tree that may be among each query's k best, and how many distances
        were computed. q: whole numbers; own: the queries' ids, which do not find themselves; floor: a score that k known
        objects reach, -inf if none is known."""
        lift, x = self.lift, q.astype(np.float64)
        reach, norms = lift.reach(x), np.sqrt((x * x).sum(1))
        best = np.repeat(floor[:, None], k, 1).astype(np.float64)
        kth, found, computed, turn = floor.astype(np.float64).copy(), [], len(q), 0
        heap = [(0.0, 0, 0, np.arange(len(q)), lift.distances(x, reach, self.x[self.centre[:1]])[:, 0])]
        while heap:
            _, _, page, act, near = heapq.heappop(heap)
            bound = lift.limit(reach[act], kth[act])
            able = near - self.radius[page] <= bound
            act, near, bound = act[able], near[able], bound[able]
            if not len(act):
                continue
            a, b = self.child_first[page], self.child_last[page]
            if b > a:
                kids = np.arange(a, b)
                open_ = np.abs(near[:, None] - self.page_parent[None, kids]) - self.radius[None, kids] <= bound[:, None]
                kids, open_ = kids[open_.any(0)], open_[:, open_.any(0)]
                if len(kids):
                    d = lift.distances(x[act], reach[act], self.x[self.centre[kids]])
                    computed += d.size
                    low = d - self.radius[None, kids]
                    open_ &= low <= bound[:, None]
                    for j in np.flatnonzero(open_.any(0)).tolist():
                        own_rows, turn = open_[:, j], turn + 1
                        heapq.heappush(heap, (max(0.0, float(low[own_rows, j].min())), turn, int(kids[j]), act[own_rows], d[own_rows, j]))
                continue
            a, b = self.first[page], self.last[page]
            open_ = np.abs(near[:, None] - self.to_parent[None, a:b]) <= bound[:, None]
            at, act = a + np.flatnonzero(open_.any(0)), act[open_.any(1)]
            if not len(at):
                continue
            s = x[act] @ self.x[at].T
            computed += s.size
            error = 0.0 if lift.exact else lift.dim * 2.0**-50 * norms[act][:, None] * self.norms[None, at]
            sure, likely = s - error, s + error
            itself = (self.first_id[at][None, :] == own[act][:, None]) & self.alone[at][None, :]
            sure[itself] = likely[itself] = -np.inf
            top = np.partition(sure, -k, 1)[:, -k:] if len(at) > k else sure
            best[act] = np.partition(np.concatenate([best[act], top], 1), -k, 1)[:, -k:]
            kth[act] = best[act].min(1)
            i, j = np.nonzero((likely >= kth[act][:, None]) & np.isfinite(likely))
            found.append((act[i], at[j], likely[i, j]))
        if not found:
            return [], computed
        of, at, likely = (np.concatenate(c) for c in zip(*found))
        keep = likely >= kth[of]
        of, at = of[keep], at[keep]
        # whole numbers: Python's where 64 bits may not do
        score = (q[of] * self.v[at]).sum(1) if lift.exact else (q[of].astype(object) * self.v[at].astype(object)).sum(1)
        out: list[tuple[int, int, int]] = []
        taken: dict[int, int] = {}
        for o, s_, r in sorted(zip(of.tolist(), score.tolist(), at.tolist()), key=lambda t: (t[0], -t[1], self.first_id[t[2]])):
            # the k best ids lie in the k best objects, and one more if a query's own id comes first
            if (n := taken.get(o, 0)) <= k:
                taken[o] = n + 1
                out += [(int(own[o]), i, s_) for i in self.ids[r] if i != own[o]]
        return out, computed


_CELL = "cell long, n int, tree binary, ids array<array<long>>, to_parent binary, centre array<long>, radius array<double>, page_parent array<double>, first array<long>, last array<long>, child_first array<long>, child_last array<long>"


def _plant(norm2: float):
    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One cell's tree: at most a few CELL objects."""
        rows = rows.sort_values("h", kind="stable")
        v = np.array(rows["v"].to_list(), np.int64)
        lift = np.sqrt(np.maximum(0.0, norm2 - (v * v).sum(1)))
        tree = Tree(np.concatenate([v.astype(np.float64), lift[:, None]], 1))
        leaves = [(i, p) for i, p in enumerate(tree.pages) if not p[4]]
        order = np.concatenate([p[0] for _, p in leaves])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        first, last = np.zeros(len(tree.pages), np.int64), np.zeros(len(tree.pages), np.int64)
        at = 0
        for i, p in leaves:
            first[i], last[i] = at, at + len(p[0])
            at = last[i]
        kids = [p[4] for p in tree.pages]
        ids = rows["ids"].to_list()
        return pd.DataFrame(
            [(int(key[0]), len(v), v[order].astype("<i8").tobytes(), [list(ids[i]) for i in order], tree.to_parent[order].astype("<f8").tobytes(),
              [int(place[p[1]]) for p in tree.pages], [p[3] * (1 + SLACK) for p in tree.pages], [p[2] for p in tree.pages], first.tolist(), last.tolist(),
              [k[0] if k else 0 for k in kids], [k[-1] + 1 if k else 0 for k in kids])],
            columns=[c.split()[0] for c in _CELL.split(", ")],
        )

    return grow


def _streamed(pages: DataFrame, rows: DataFrame, run, out: str) -> DataFrame:
    """run over rows sorted by `cell`, the page of that cell first: a page that many rows visit is copied, and its rows
    are dealt to the copies by `turn`."""
    copies = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MET).cast("int").alias("copies"))
    own = pages.join(copies, "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    dealt = rows.join(copies, "cell").withColumn("copy", F.pmod("turn", F.col("copies")).cast("int")).drop("copies")
    both = own.withColumn("is_page", F.lit(True)).unionByName(dealt.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
    return both.repartition("cell", "copy").sortWithinPartitions("cell", "copy", F.desc("is_page")).mapInArrow(run, out)


def _by_page(batches: Iterator[pa.RecordBatch], opened, block: int) -> Iterator[tuple]:
    """(opened page, rows) for rows that follow their page, in record batches of up to `block` rows."""
    page = None
    for batch in batches:
        flags = np.array(batch.column("is_page").to_pylist(), bool)
        starts = np.flatnonzero(flags).tolist()
        for a, b in zip([0, *(s + 1 for s in starts)], [*starts, batch.num_rows]):
            if a and flags[a - 1]:
                page = opened({c: batch.column(c)[a - 1].as_py() for c in batch.schema.names})
            for i in range(a, b, block):
                yield page, batch.slice(i, min(block, b - i))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dim)


def _assign(lift: Lift):
    """The nearest routing object of each object in its page, and the distance to it."""

    def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(row["centres"], np.float64)
        return x, np.sqrt(np.maximum(0.0, lift.norm2 - (x * x).sum(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (centres, lifts), rows in _by_page(batches, opened, 1024):
            x = _vectors(rows, lift.dim).astype(np.float64)
            up = np.sqrt(np.maximum(0.0, lift.norm2 - (x * x).sum(1)))
            at = np.argmin((centres * centres).sum(1) / 2 - x @ centres.T + (lifts * lifts) / 2 - up[:, None] * lifts, 1)
            d = np.sqrt(((x - centres[at]) ** 2).sum(1) + (up - lifts[at]) ** 2)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("cell", "v", "ids", "h")), pa.array(at.astype(np.int64)), pa.array(d)], ["cell", "v", "ids", "h", "at", "d"])

    return run


def build(objects: DataFrame, lift: Lift) -> tuple[DataFrame, list[DataFrame]]:
    """The written index: a row for each last group (its tree), and the upper pages of each level, root first."""
    rows, pages = objects.withColumn("cell", F.lit(0).cast("long")), []
    while True:
        sizes = saved(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL))
        if sizes.isEmpty():
            break
        level = len(pages)
        full, rest = rows.join(sizes, "cell"), rows.join(sizes, "cell", "left_anti")
        # a few objects of each full group, by hash; each task sends on no more than these
        turn = Window.partitionBy("cell").orderBy(F.xxhash64("h", F.lit(level)), "h")
        wanted = F.least(F.lit(FANS), F.greatest(F.lit(2), F.ceil(F.col("n") * 2 / CELL)))
        drawn = full.withColumn("r", F.row_number().over(turn)).filter((F.col("r") <= FANS) & (F.col("r") <= wanted))
        centres = saved(drawn.groupBy("cell").agg(F.collect_list("v").alias("centres")))
        dealt = saved(_streamed(centres, full.select("cell", "v", "ids", "h", F.col("h").alias("turn")), _assign(lift), "cell long, v array<long>, ids array<long>, h long, at long, d double"))
        child = F.xxhash64("cell", "at", F.lit(level)).alias("child")
        balls = dealt.groupBy("cell", "at", child).agg((F.max("d") * (1 + SLACK)).alias("radius"))
        balls = balls.join(centres, "cell").select("cell", F.struct("child", "radius", F.get("centres", F.col("at").cast("int")).alias("centre")).alias("ball"))
        pages.append(saved(balls.groupBy("cell").agg(F.collect_list("ball").alias("balls"))))
        rows = saved(rest.unionByName(dealt.select("v", "ids", "h", child.alias("cell"))))
    return saved(rows.groupBy("cell").applyInPandas(_plant(lift.norm2), _CELL)), pages


def _descend(lift: Lift, nearest: bool):
    """(query_id, v, floor, cell) of the children that each query of a page visits next: the nearest one, or all
    that its floor and their covering balls cannot rule out."""

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        return tuple(np.array([b[c] for b in row["balls"]]) for c in ("child", "radius", "centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (child, radius, centres), rows in _by_page(batches, opened, BLOCK):
            q = _vectors(rows, lift.dim).astype(np.float64)
            reach = lift.reach(q)
            d = lift.distances(q, reach, centres.astype(np.float64))
            if nearest:
                of, to = np.arange(len(q)), d.argmin(1)
            else:
                floor = rows.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                of, to = np.nonzero(d - radius[None, :] <= lift.limit(reach, floor)[:, None])
            yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(of)) for c in ("query_id", "v", "floor")), pa.array(child[to].astype(np.int64))], ["query_id", "v", "floor", "cell"])

    return run


def _visits(queries: DataFrame, pages: list[DataFrame], lift: Lift, nearest: bool) -> DataFrame:
    """(query_id, v, floor, cell): the last groups that queries visit, found page by page from the root."""
    now, done = queries.withColumn("cell", F.lit(0).cast("long")), None
    for page in pages:
        inner = now.join(page.select("cell"), "cell", "left_semi")
        rest = now.join(page.select("cell"), "cell", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        now = _streamed(page, inner.withColumn("turn", F.xxhash64("query_id")), _descend(lift, nearest), "query_id long, v array<long>, floor long, cell long")
        now = saved(now)
    return now if done is None else done.unionByName(now)


def _search(lift: Lift, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _by_page(batches, lambda row: Cell(row, lift), BLOCK):
            own = rows.column("query_id").to_numpy()
            floor = rows.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            out, computed = cell.search(_vectors(rows, lift.dim), own, k, floor) if len(own) else ([], 0)
            names = ["query_id", "vec_id", "score"]
            try:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 3)], names)
            except OverflowError as error:
                raise ValueError("a score does not fit 64 bits") from error

    return run


def _visit(index: DataFrame, visits: DataFrame, lift: Lift, k: int) -> DataFrame:
    """Search each visited tree."""
    return _streamed(index, visits.withColumn("turn", F.xxhash64("query_id")), _search(lift, k), "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score over rows (vec_id, v) for queries (vec_id, v) of the same ids."""
    spark = rows.sparkSession
    ship(spark)
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = common["dim"]
    rows, queries = rows.filter(F.size("v") == dim), queries.filter(F.size("v") == dim)
    objects = saved(folded(rows, k + 1).withColumn("h", F.xxhash64("v")))
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    norm2, largest = objects.agg(F.max(square), F.max(F.array_max(F.transform("v", F.abs)))).first()
    lift = Lift(dim, float(norm2), int(largest))
    index, pages = build(objects, lift)
    asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("long").alias("floor"))
    home = saved(_visits(asked, pages, lift, True))
    first = saved(_visit(index, home, lift, k))
    if not pages:
        return _top(first, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    floors = _top(first, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).select("query_id", F.when(F.col("n") >= k, F.col("s")).alias("floor"))
    known = saved(asked.drop("floor").join(floors, "query_id", "left").select("query_id", "v", "floor"))
    rest = _visits(known, pages, lift, False).join(home.select("query_id", "cell"), ["query_id", "cell"], "left_anti")
    second = _visit(index, rest.select("query_id", "v", "floor", "cell"), lift, k)
    return _top(first.unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k highest integer inner products of each row whose vec_id is divisible by `every`."""
    rows = saved(scaled(vectors, scale))
    return search(rows, rows.filter(F.pmod("vec_id", F.lit(every)) == 0), k)
