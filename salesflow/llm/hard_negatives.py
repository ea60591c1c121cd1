"""Hard negatives by exact matrix products in a residue number system.

Anchors (a stated set of rows) meet all rows in blocks. A block's scores are exact integers out of float32: both matrices
are reduced modulo several primes below 512, centred, and multiplied in slabs of 256 components, whose sums stay
below 2^24, where float32 is exact; the Chinese remainder theorem puts the residues of a score together again. As many
primes are taken as the largest squared norm asks for (no score is larger, by Cauchy and Schwarz).

Plan: vectors are dealt by ranges of their label and packed into blocks; anchors likewise. A unit of work is one block of
anchors and one group of row blocks, which stream past it while it keeps the best found; units are spread by key, so
that a hot label is many units. The first pass finds positives and skips pairs of blocks that share no label; the second
has each anchor's positives and keeps, for each of them, the best rows of other labels inside its window of
scores. Only the few best of a unit leave it; the driver holds one number for each block of anchors.

Defined results: a null vec_id or label, a null or empty vector, one with null or non-finite components, or of another length than
the commonest takes no part; of repeated rows of a vec_id the smallest vector (then label) counts, once; equal scores go by
the smaller vec_id; extra columns are ignored; no anchors, or anchors without positives, give no rows. A scaled component
or a returned score that does not fit 64 bits is an error; scores beyond 2^54 are computed in whole numbers of any size.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship

#: Rows of a packed block, anchors of one, row blocks of a group, and the groups that even few blocks make.
BLOCK, ANCHORS, GROUP, GROUPS = 1024, 2048, 32, 16
#: Anchors multiplied at once; components whose products are summed in float32.
SLICE, SLAB = 512, 256


def _primes(below: int = 512) -> list[int]:
    return [p for p in range(below - 1, 2, -1) if all(p % d for d in range(2, int(p**0.5) + 1))]


def basis(bound: int) -> list[int]:
    """Primes whose product exceeds twice the bound, so that every signed score up to it has residues of its own."""
    out, product = [], 1
    for p in _primes():
        if product > 2 * bound + 1:
            break
        out.append(p)
        product *= p
    if product <= 2 * bound + 1:
        raise ValueError("the vectors are too long for the primes below 512")
    return out


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """A whole-number matrix modulo p, centred about 0, as float32."""
    r = np.mod(m, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def product(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """a @ b.T exactly: int64, or Python's whole numbers where the range of the primes is wider."""
    total, held, range_ = None, 1, int(np.prod([int(p) for p in primes], dtype=object))
    for p in primes:
        x, y = residues(a, p), residues(b, p)
        r = np.zeros((len(a), len(b)), np.int64)
        for i in range(0, a.shape[1], SLAB):
            r += (x[:, i : i + SLAB] @ y[:, i : i + SLAB].T).astype(np.int64)
        r %= p
        if total is None:
            total = r if range_ < 1 << 62 else r.astype(object)
        else:
            digit = (r - total) % p * pow(held, -1, p) % p
            total = total + digit * held
        held *= p
    return np.where(total > range_ // 2, total - range_, total)


def leading(scores: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest kept scores of each row, equal ones by the smaller column."""
    if scores.dtype != object and scores.shape[1] > k:
        low = np.iinfo(np.int64).min
        s = np.where(keep, scores, low)
        kth = np.partition(s, -k, 1)[:, -k]
        keep = keep & (s >= kth[:, None])
    row, col = np.nonzero(keep)
    return _first(row, col, scores[row, col], k)[:2]


def _first(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each `of` by falling score, then rising id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(of)), key=lambda t: (of[t], -scores[t], ids[t])), np.int64)
    else:
        order = np.lexsort((ids, -scores, of))
    of, ids, scores = of[order], ids[order], scores[order]
    start = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
    at = np.arange(len(of))
    take = at - np.maximum.accumulate(np.where(start, at, 0)) < k
    return of[take], ids[take], scores[take]


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, v: floor(scale * x) of each row that takes part, one for each vec_id."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    part = lambda c: F.when(F.abs(c * scale) >= F.lit(2.0**62), F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("long")).otherwise(F.floor(c * F.lit(float(scale))))
    rows = x.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0").filter(fine).select("vec_id", "label", F.transform("x", part).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select("vec_id", "r.label", "r.v")


_PACKED = "block long, labels array<long>, ids binary, tags binary, v binary, of array<long>, positives array<long>, scores array<long>"


def _pack(size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(n: int) -> pa.RecordBatch:
            nonlocal held
            rows = pa.Table.from_batches(held).combine_chunks()
            own, rest = rows.slice(0, n), rows.slice(n)
            held = rest.to_batches() if rest.num_rows else []
            own = own.sort_by("vec_id").combine_chunks()
            ids, tags = own["vec_id"].to_numpy(), own["label"].to_numpy()
            v = own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            found = own["found"].to_pylist() if "found" in own.schema.names else [[]] * len(ids)
            of = [i for i, f in enumerate(found) for _ in f or []]
            each = [p for f in found for p in f or []]
            cells = [int(ids[0]), np.unique(tags).tolist(), ids.astype("<i8").tobytes(), tags.astype("<i8").tobytes(), v.astype(kind).tobytes(), of, [p["vec_id"] for p in each], [p["score"] for p in each]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], [c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                yield block(size)
        while held and sum(b.num_rows for b in held):
            yield block(size)

    return run


def packed(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Blocks of up to `size` rows of near labels."""
    dealt = rows.repartitionByRange("label", F.xxhash64("vec_id")).sortWithinPartitions("label", "vec_id")
    return saved(dealt.mapInArrow(_pack(size, kind), _PACKED))


class Block:
    """A packed block, opened."""

    def __init__(self, row: dict, dim: int, kind: str):
        self.ids, self.tags = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["tags"], "<i8")
        self.v = np.frombuffer(row["v"], kind).reshape(-1, dim).astype(np.int64)
        self.of, self.positives = np.array(row["of"], np.int64), np.array(row["positives"], np.int64)
        self.scores = np.array(row["scores"], np.int64)


def _positives(anchors: Block, rows: Block, scores: np.ndarray, at: slice, k: int) -> list[tuple]:
    keep = (anchors.tags[at, None] == rows.tags[None, :]) & (anchors.ids[at, None] != rows.ids[None, :])
    i, j = leading(scores, keep, k)
    return [(i + at.start, rows.ids[j], scores[i, j])]


def _negatives(anchors: Block, rows: Block, scores: np.ndarray, at: slice, k: int, low: int, high: int) -> list[tuple]:
    """low and high: hundredths of the positive's score."""
    other = anchors.tags[at, None] != rows.tags[None, :]
    mine = np.flatnonzero((anchors.of >= at.start) & (anchors.of < at.stop))
    turn = mine - np.searchsorted(anchors.of, anchors.of[mine])  # the n-th positive of its anchor
    out = []
    for n in range(int(turn.max()) + 1 if len(turn) else 0):
        of = mine[turn == n]
        i, p = anchors.of[of] - at.start, anchors.scores[of].astype(scores.dtype)
        s = scores[i]
        a, b = -((-low * p) // 100), (high * p) // 100
        x, y = leading(s, other[i] & (s >= a[:, None]) & (s <= b[:, None]), k)
        out.append((of[x], rows.ids[y], s[x, y]))
    return out


_OUT = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def _meet(dim: int, kind: str, primes: list[int], k: int, find):
    """Stream the row blocks of each unit past its anchors; the best k of each anchor (or positive) leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, anchors, best = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if anchors is None or best is None or not len(best[0]):
                return
            of, ids, scores = best
            pairs = find is not _positives
            owner = anchors.of[of] if pairs else of
            none = pa.nulls(len(of), pa.int64())
            cells = [pa.array(anchors.ids[owner]), pa.array(anchors.positives[of]) if pairs else none, pa.array(anchors.scores[of]) if pairs else none, pa.array(ids)]
            try:
                score = pa.array(scores.tolist(), pa.int64())
            except OverflowError as error:
                raise ValueError("a score does not fit 64 bits") from error
            yield pa.RecordBatch.from_arrays([*cells, score], [c.split()[0] for c in _OUT.split(", ")])

        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                if (own := (row["anchor_block"], row["part"])) != unit:
                    yield from done()
                    unit, anchors, best = own, None, None
                if row["is_anchor"]:
                    anchors = Block(row, dim, kind)
                    continue
                rows, found = Block(row, dim, kind), [best] if best is not None else []
                for a in range(0, len(anchors.ids), SLICE):
                    at = slice(a, min(a + SLICE, len(anchors.ids)))
                    found += find(anchors, rows, product(anchors.v[at], rows.v, primes), at, k)
                if found:
                    best = _first(*(np.concatenate(c) for c in zip(*found)), k)
        yield from done()

    return run


def _units(anchors: DataFrame, blocks: DataFrame, visits: DataFrame, parts: int, n_anchors: int, run) -> DataFrame:
    """run over units: (anchor_block, part), its anchors first, then the row blocks that visit it."""
    left = anchors.withColumns({"anchor_block": F.col("block"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "is_anchor": F.lit(True)})
    right = blocks.join(visits, "block").withColumns({"part": _part(parts), "is_anchor": F.lit(False)})
    both = left.unionByName(right)
    return both.repartition(min(4096, max(1, parts * n_anchors)), "anchor_block", "part").sortWithinPartitions("anchor_block", "part", F.desc("is_anchor"), "block").mapInArrow(run, _OUT)


def _part(parts: int):
    return F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")


def _best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row whose vec_id is divisible by
    `every` and each of its best `positives` rows of the same label, the best `negatives` rows of other labels whose score lies
    between `low` and `high` hundredths of the positive's."""
    spark = vectors.sparkSession
    ship(spark)
    rows = saved(usable(vectors, scale))
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return nothing
    dim = common["dim"]
    rows = rows.filter(F.size("v") == dim)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    norm2, largest = rows.agg(F.max(square), F.max(F.array_max(F.transform("v", F.abs)))).first()
    primes = basis(int(norm2 * (1 + 1e-9)) + 1 if norm2 < 2**50 else 256 * int(norm2))
    kind = "<i2" if largest < 1 << 15 else "<i8"
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    blocks, anchors = packed(rows, BLOCK, kind), packed(asked, ANCHORS, kind)
    names = sorted(r["block"] for r in anchors.select("block").collect())  # one for each ANCHORS * every rows
    if not names:
        return nothing
    n = blocks.count()
    parts = max(-(-n // GROUP), min(n, GROUPS))
    tagged = lambda df: df.select(F.col("block"), F.explode("labels").alias("label"))
    near = tagged(blocks).join(tagged(anchors).withColumnRenamed("block", "anchor_block"), "label").select("block", "anchor_block").distinct()
    found = _units(anchors, blocks, near, parts, len(names), _meet(dim, kind, primes, positives, _positives))
    best = _best(found.select("anchor_id", "vec_id", "score"), ["anchor_id"], positives)
    each = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found")).withColumnRenamed("anchor_id", "vec_id")
    anchors = packed(asked.join(each, "vec_id"), ANCHORS, kind)
    names = sorted(r["block"] for r in anchors.select("block").collect())
    if not names:
        return nothing
    everywhere = blocks.select("block", F.explode(F.from_json(F.lit(json.dumps(names)), "array<bigint>")).alias("anchor_block"))

    def inside(a: Block, r: Block, s: np.ndarray, at: slice, k: int) -> list[tuple]:
        return _negatives(a, r, s, at, k, low, high)

    found = _units(anchors, blocks, everywhere, parts, len(names), _meet(dim, kind, primes, negatives, inside))
    best = _best(found, ["anchor_id", "positive_id"], negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
