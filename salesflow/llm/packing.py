"""Best-fit packing of documents into sequences of at most `capacity` tokens.

Bulk-synchronous best fit. Documents longer than a sequence are cut into full pieces and a rest.
Equal pieces and equal gaps are held as runs (size, how many), so the tables of the rounds have a size
that depends on `capacity` and not on the corpus. A round takes the pieces of one class of lengths,
longest class first (each class reaches down to half of the one before), and

1. sorts the pieces and the open gaps into ranges of sizes;
2. sweeps every range by itself: longest first, each run of pieces takes its successor, the smallest run
   of gaps that holds it; a conflict is resolved by rank, the r-th piece taking the r-th place of the run;
3. sends what a range leaves, pieces without a successor and gaps without pieces, to a sweep over that range and its
   neighbours, and so on until one sweep sees all; pieces that are left there open sequences;
4. updates the gaps, which a written table hands to the next round.

A piece thus takes the smallest gap open in its range, else in a wider one, and opens a sequence only where
no gap at all holds it. Counting lengths, ranking the pieces of a length (a hot length is counted per task first, so that no task
gathers it) and placing every piece by its rank are Spark jobs over all pieces.

Defined results: null text is empty (its end id alone); repeated rows are packed each; extra columns
are ignored; pieces of equal length are alike, and which of them takes which place is by the order in which tasks hold them; a null
doc_id is an id like others; a very long text is encoded whole in its task and cut; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship, slices, whole_text
from salesflow.llm.encode import encoder

_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]

#: Words that a worker remembers: it may run the other stages of a pipeline beside them.
WORDS = 150_000

#: Ranges of sizes that are swept by themselves, and how many of them the next sweep joins.
RANGES = 16
JOINED = 4

#: Rows of a round. pieces: ranks first to last of a length; gaps: sequences first to last with that much room; runs: the ranks
#: first to last of a length, placed from sequence on, each of them at a time, from offset on; next: the next new sequence.
_STATE = "range long, kind string, size long, first long, last long, sequence long, each long, offset long"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _cut(tokenizer: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part, seen = encoder(tokenizer, WORDS), TaskContext.get().partitionId(), {}
        for batch in batches:
            for first, last in slices(batch):
                rows, out = batch.slice(first, last - first), []
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    ids = library.encode(text) + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        rank = seen[length] = seen.get(length, -1) + 1
                        out.append((doc, piece, at // 4, length, zlib.crc32(own), part, rank))
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], _PIECE)

    return run


def sweep(pieces: list[tuple[int, int, int]], open_gaps: list[tuple[int, int, int]], capacity: int, sequences: int | None = None):
    """Best fit of runs of pieces (length, first rank, last rank + 1), longest first, into runs of gaps (size, first
    sequence, last + 1). Pieces that no gap holds open sequences from number `sequences` on, or are left if that is None.

    Returns runs (length, first rank, last rank + 1, first sequence, pieces a sequence, offset), the pieces and the gaps left,
    and the next number.
    """
    sizes: list[int] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size: runs of sequences
    runs, left = [], []

    def leave(size: int, first: int, last: int) -> None:
        if size and first < last:
            if size not in gaps:
                insort(sizes, size)
            gaps.setdefault(size, []).append((first, last))

    for gap in sorted(open_gaps):
        leave(*gap)
    for length, rank, end in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while rank < end:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, last = gaps[size].pop()
                if not gaps[size]:
                    del gaps[size], sizes[at]
            elif sequences is None:
                left.append((length, rank, end))
                break
            else:
                size, first = capacity, sequences
                last = sequences = first - (rank - end) // (capacity // length)
            each = size // length
            full = min(last - first, (end - rank) // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - size))
                leave(size - each * length, first, first + full)
                rank, first = rank + full * each, first + full
            if first < last and rank < end:  # fewer pieces than the next gap holds
                runs.append((length, rank, end, first, each, capacity - size))
                leave(size - (end - rank) * length, first, first + 1)
                rank, first = end, first + 1
            leave(size, first, last)
    return runs, left, [(size, *run) for size in sizes for run in gaps[size]], sequences


def best_fit_runs(lengths: dict[int, int], capacity: int) -> np.ndarray:
    """The runs of one sweep over all pieces at once: plain best fit, longest first."""
    runs, *_ = sweep([(length, 0, n) for length, n in lengths.items()], [], capacity, 0)
    return np.array(runs, np.int64).reshape(-1, 6)


def _sweep_group(capacity: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = {kind: list(part[["size", "first", "last"]].itertuples(index=False, name=None)) for kind, part in rows.groupby("kind")}
        number = max((n[1] for n in own.get("next", [])), default=0)
        runs, pieces, gaps, number = sweep(own.get("piece", []), own.get("gap", []), capacity, number if last else None)
        at = int(rows["range"].iloc[0])
        out = [(at, "run", *r) for r in runs]
        out += [(at, kind, *r, 0, 0, 0) for kind, part in (("piece", pieces), ("gap", gaps)) for r in part]
        if last:
            out.append((at, "next", 0, number, 0, 0, 0, 0))
        kept = rows[rows["kind"].isin(["run"] if last else ["run", "next"])]
        return pd.concat([kept, pd.DataFrame(out, columns=_NAMES)], ignore_index=True)[_NAMES]

    return run


def class_bounds(capacity: int) -> list[tuple[int, int]]:
    """(least, most) length of every class, longest first."""
    out, most = [], capacity
    while most:
        out.append((most // 2 + 1, most))
        most //= 2
    return out


def best_fit_rounds(lengths: DataFrame, capacity: int) -> DataFrame:
    """Rows (length, first, last, sequence, each, offset) that place the pieces of each length by rank; lengths: rows (length, n)."""
    pieces = lengths.select(F.lit(0).cast("long").alias("range"), F.lit("piece").alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").alias("last"), *(F.lit(0).cast("long").alias(c) for c in ("sequence", "each", "offset")))
    bounds = class_bounds(capacity)
    held = lengths.agg(*(F.coalesce(F.max(F.col("length").between(*b)), F.lit(False)).alias(str(k)) for k, b in enumerate(bounds))).first()
    state, runs = None, []
    for k, (least, most) in enumerate(bounds):
        if not held[k]:
            continue
        rows = pieces.filter(F.col("size").between(least, most))
        if state is not None:
            rows = rows.unionByName(state.filter("kind IN ('gap', 'next')"))
        # smaller gaps than this class stay with the first range, where nothing fits them
        spread = F.greatest(F.lit(0), F.col("size") - least) * RANGES / (capacity - least + 1)
        rows, ranges = rows.withColumn("range", F.when(F.col("kind") == "next", 0).otherwise(F.floor(spread)).cast("long")), RANGES
        while True:
            rows = rows.groupBy("range").applyInPandas(_sweep_group(capacity, ranges == 1), _STATE)
            if ranges == 1:
                break
            rows, ranges = rows.withColumn("range", F.floor(F.col("range") / JOINED)), -(-ranges // JOINED)
        state = saved(rows)
        runs.append(state.filter("kind = 'run'"))
    if not runs:
        return pieces.limit(0).select(F.col("size").alias("length"), *_NAMES[3:])
    return reduce(DataFrame.unionAll, runs).select(F.col("size").alias("length"), *_NAMES[3:])


def _place(runs: np.ndarray):
    top = int(runs[:, 2].max()) + 1 if len(runs) else 1
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] * top + runs[:, 1]  # fits: at most capacity times the pieces of a length
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * top + rank, "right") - 1
            place = rank - runs[at, 1]
            sequence = runs[at, 3] + place // runs[at, 4]
            offset = runs[at, 5] + place % runs[at, 4] * length
            own = [batch.column(c) for c in _PIECE[:5]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], [*_PIECE[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    pieces = saved(rows.mapInArrow(_cut(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"))
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    lengths = saved(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    # a few rows for each length up to `capacity`
    runs = np.array([tuple(r) for r in best_fit_rounds(lengths, capacity).collect()], np.int64).reshape(-1, 6)
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).select(*_PIECE)
    return ranked.mapInArrow(_place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
