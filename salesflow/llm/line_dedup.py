"""Line deduplication by sharded minimal perfect hashes over repeated line keys.

Lines are cut at \\n; a line's key is the line stripped of white space, A-Z lower-cased. Keys of at
least `min_chars` code points found in two or more documents keep their lines only in the
smallest doc_id holding them.

Plan: one pass counts keys (pre-aggregated in each task, then by Spark); keys of two or more
documents go to shards by hash; each shard is a minimal perfect hash with arrays of
fingerprints, document counts and first documents; documents then probe the arrays. An index
whose measured size is under `broadcast_bytes` is read by every task; a larger one stays
sharded and documents' hashes are routed to the shards, one row per document and shard.

Defined results: null text is one empty line, which stays; repeated rows of a doc_id are one
document; a null doc_id counts as larger than all others; of rows that hold a line the smallest doc_id keeps it, with all its
copies inside that row; a very long text is split in its task, its lines' hashes leave it in one row for each shard; extra
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import WHITE, saved, ship, slices, whole_text

#: Keys in a shard, on average.
SHARD_KEYS = 50_000
#: Stands for a null doc_id, larger than any real one.
NO_ID = 2**63 - 1
#: Lines whose hash a task remembers at once before it passes counts on.
HELD_KEYS = 200_000
_LEVELS = 48


def line_hash(line: str, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key; None if the key is too short to count."""
    import xxhash

    key = line.strip(WHITE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _mixed(pairs: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each (h1, h2) for a level."""
    with np.errstate(over="ignore"):
        x = pairs[:, 0] ^ (pairs[:, 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0..n-1 for n distinct keys: each level gives a slot to keys that are alone at their
    place, the others go on; a slot's number is its rank among taken places."""

    def __init__(self, sizes: list[int], taken: np.ndarray):
        self.sizes, self.taken = sizes, taken
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(taken, dtype=np.int64) - taken

    @classmethod
    def build(cls, pairs: np.ndarray) -> "PerfectHash":
        sizes, parts, rest = [], [], pairs
        for level in range(_LEVELS):
            if not len(rest):
                break
            size = 2 * len(rest) + 1
            place = (_mixed(rest, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            rest = rest[~alone[place]]
        if len(rest):
            raise ValueError("keys are not distinct")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that are not in the set, any slot for others."""
        out = np.full(len(pairs), -1, np.int64)
        todo = np.arange(len(pairs))
        for level, size in enumerate(self.sizes):
            place = (_mixed(pairs[todo], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.taken[place]
            out[todo[hit]] = self.rank[place[hit]]
            todo = todo[~hit]
        return out


_INDEX_TYPE = "shard int, n_keys long, sizes array<long>, taken binary, fingerprints binary, counts binary, firsts binary"


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (h1 % np.uint64(shards)).astype(np.int64)


def _build_shard(table: pa.Table) -> pa.Table:
    """One shard's arrays: bounded by SHARD_KEYS, for keys are distinct and dealt by hash."""
    pairs = np.stack([table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")], 1)
    index = PerfectHash.build(pairs)
    slot = index.slots(pairs)
    prints, counts, firsts = np.zeros(len(slot), "<u8"), np.zeros(len(slot), "<u4"), np.zeros(len(slot), "<i8")
    prints[slot] = pairs[:, 1]
    counts[slot] = np.minimum(table.column("n_docs").to_numpy(), 2**32 - 1)
    firsts[slot] = table.column("first_doc").to_numpy()
    return pa.table(
        {
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
            "n_keys": pa.array([len(slot)], pa.int64()),
            "sizes": pa.array([index.sizes], pa.list_(pa.int64())),
            "taken": pa.array([np.packbits(index.taken).tobytes()], pa.binary()),
            "fingerprints": pa.array([prints.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "firsts": pa.array([firsts.tobytes()], pa.binary()),
        }
    )


class Shard:
    """A shard's arrays, ready to be probed."""

    def __init__(self, row: dict):
        taken = np.unpackbits(np.frombuffer(row["taken"], np.uint8), count=sum(row["sizes"])).astype(bool)
        self.index = PerfectHash(list(row["sizes"]), taken)
        self.prints = np.frombuffer(row["fingerprints"], "<u8")
        self.counts = np.frombuffer(row["counts"], "<u4")
        self.firsts = np.frombuffer(row["firsts"], "<i8")

    def first_docs(self, pairs: np.ndarray) -> np.ndarray:
        """The first document of each repeated key; -1 for other keys."""
        slot = self.index.slots(pairs)
        out = np.full(len(slot), -1, np.int64)
        at = slot >= 0
        at[at] = self.prints[slot[at]] == pairs[at, 1]
        out[at] = self.firsts[slot[at]]
        return out


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _count_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: dict) -> pa.RecordBatch:
            pairs = _pairs(list(held)).view(np.int64)
            rest = np.array(list(held.values()), np.int64).reshape(-1, 3)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (pairs[:, 0], pairs[:, 1], *rest.T)], ["h1", "h2", "first_doc", "last_doc", "n_docs"])

        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for first, last in slices(batch):
                part = batch.slice(first, last - first)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    for h in {line_hash(x, min_chars) for x in text.split("\n")}:
                        if h is None:
                            continue
                        if (x := held.get(h)) is None:
                            held[h] = [doc, doc, 1]
                        else:
                            x[0], x[1], x[2] = min(x[0], doc), max(x[1], doc), x[2] + 1
                if len(held) >= HELD_KEYS:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    return run


def repeated_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """h1, h2, first_doc, n_docs of each key found in two or more documents."""
    rows = _rows(docs)
    return (
        rows.mapInArrow(_count_keys(min_chars), "h1 long, h2 long, first_doc long, last_doc long, n_docs long")
        .groupBy("h1", "h2")
        .agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum("n_docs").alias("n_docs"))
        .filter("first_doc < last_doc")
        .drop("last_doc")
    )


def _rows(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), whole_text().alias("text"))


def line_index(docs: DataFrame, min_chars: int = 10) -> tuple[DataFrame, int]:
    """The written index, a row per shard, and its number of shards."""
    keys = saved(repeated_keys(docs, min_chars))
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    # as in _shard_of: the unsigned remainder of h1
    high, low = F.shiftrightunsigned("h1", 1), F.col("h1").bitwiseAND(1)
    keys = keys.withColumn("shard", F.pmod(F.pmod(high, F.lit(shards)) * 2 + low, F.lit(shards)).cast("int"))
    return saved(keys.groupBy("shard").applyInArrow(_build_shard, _INDEX_TYPE)), shards


def _kept(doc: int | None, text: str, digests: list[bytes | None], drop: set[bytes], with_text: bool) -> tuple:
    lines = text.split("\n")
    kept = [x for x, h in zip(lines, digests) if h not in drop] if drop else lines
    joined = text if len(kept) == len(lines) else "\n".join(kept)
    row = (None if doc == NO_ID else doc, len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode()).hexdigest())
    return (*row, joined) if with_text else row


_OUT = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]


def _out_batch(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    fields = _OUT + [("kept_text", pa.string())] * with_text
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _probe_all(index_rows: list[dict], shards: int, min_chars: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {row["shard"]: Shard(row) for row in index_rows}
        for batch in batches:
            for first, last in slices(batch):
                part = batch.slice(first, last - first)
                docs, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                hashes = [[line_hash(x, min_chars) for x in t.split("\n")] for t in texts]
                digests = list({h for own in hashes for h in own if h is not None})
                pairs = _pairs(digests)
                shard = _shard_of(pairs[:, 0], shards)
                firsts = np.full(len(digests), -1, np.int64)
                for k in np.unique(shard):
                    if int(k) in ready:
                        at = np.flatnonzero(shard == k)
                        firsts[at] = ready[int(k)].first_docs(pairs[at])
                found = {digests[i]: int(firsts[i]) for i in np.flatnonzero(firsts >= 0)}
                rows = []
                for doc, text, own in zip(docs, texts, hashes):
                    drop = {h for h in own if h is not None and found.get(h, doc) != doc}
                    rows.append(_kept(doc, text, own, drop, with_text))
                yield _out_batch(rows, with_text)

    return run


def _ask(shards: int, min_chars: int):
    """One row per document and shard: the hashes that the shard has to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch):
                part, asks = batch.slice(first, last - first), ([], [], [])
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    digests = list({line_hash(x, min_chars) for x in text.split("\n")} - {None})
                    shard = _shard_of(_pairs(digests)[:, 0], shards)
                    for k in np.unique(shard):
                        asks[0].append(int(k))
                        asks[1].append(doc)
                        asks[2].append(b"".join(digests[i] for i in np.flatnonzero(shard == k)))
                yield pa.RecordBatch.from_arrays([pa.array(asks[0], pa.int32()), pa.array(asks[1], pa.int64()), pa.array(asks[2], pa.binary())], ["shard", "doc_id", "asked"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a partition each shard's row comes first, then the documents that ask it."""
    at, ready = None, None
    for batch in batches:
        docs, drops = [], []
        for row in batch.to_pylist():
            if row["doc_id"] is None:
                at, ready = row["shard"], Shard(row)
            elif row["shard"] == at:
                pairs = _pairs([row["asked"]])
                firsts = ready.first_docs(pairs)
                lost = np.flatnonzero((firsts >= 0) & (firsts != row["doc_id"]))
                if len(lost):
                    docs.append(row["doc_id"])
                    drops.append(pairs[lost].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(drops, pa.binary())], ["doc_id", "drops"])


def _apply(min_chars: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, drops in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "drops"))):
                drop = {d[i : i + 16] for d in drops or () for i in range(0, len(d), 16)}
                rows.append(_kept(doc, text, [line_hash(x, min_chars) for x in text.split("\n")] if drop else [], drop, with_text))
            yield _out_batch(rows, with_text)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 10, with_text: bool = True, broadcast_bytes: int = 16_000_000) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, if asked, kept_text of every document."""
    index, shards = line_index(docs, min_chars)
    rows = _rows(docs)
    out = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text
    arrays = [F.length(c) for c in ("taken", "fingerprints", "counts", "firsts")]
    size = index.agg(F.sum(sum(arrays[1:], arrays[0])).alias("size")).first()["size"] or 0
    if size <= broadcast_bytes:
        held = [r.asDict() for r in index.collect()]
        return rows.mapInArrow(_probe_all(held, shards, min_chars, with_text), out)
    asks = rows.mapInArrow(_ask(shards, min_chars), "shard int, doc_id long, asked binary")
    asked = index.unionByName(asks, allowMissingColumns=True).repartition(shards, "shard")
    drops = asked.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first()).mapInArrow(_answer, "doc_id long, drops binary")
    drops = drops.groupBy("doc_id").agg(F.collect_list("drops").alias("drops"))  # bounded by a document's lines
    return rows.join(drops, "doc_id", "left").mapInArrow(_apply(min_chars, with_text), out)
