"""Token-id output: per-document zstandard frames under one shared dictionary.

Format (two Parquet tables under a folder, written and read by Spark alone):
- `dictionary`: one row with the dictionary's bytes and their SHA-256.
- `segments`: rows of up to SEGMENT_BYTES of frames: `part` (range of doc_id, ascending), `segment`,
  `first_token` (ids before it in its part), `n_tokens`, `doc_ids`, `counts` (ids of each
  document), `offsets` (n+1 byte offsets), `payload` (the frames), `dictionary_sha256`, and
  `first_doc` and `last_doc`, by which readers skip segments.
A frame is one document's ids, little-endian, 16 bits each if the vocabulary's ids fit, else 32.
A document is read by its offset without touching its neighbours (`read_documents`).

The dictionary is trained on the first SAMPLE_BYTES of the serialized ids of `dictionary_docs` documents, those of
smallest hashed doc_id: a documented, bounded fit that changes sizes only, never what is read back.

Defined results: null text is empty (its end id alone); a null doc_id comes first; repeated rows are
written each, in the order of their text's hash; a very long text is encoded whole in its task and is one frame; extra columns
are ignored; without rows there are no segments.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesflow.llm.common import ship, slices, whole_text
from salesflow.llm.encode import encoder

SEGMENT_BYTES = 1 << 20
SEGMENT_DOCS = 4096
#: Bytes of a document's ids that the dictionary is trained on.
SAMPLE_BYTES = 32_768

_SEGMENT = pa.schema(
    [("part", pa.int64()), ("segment", pa.int64()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary()), ("width", pa.int32()), ("dictionary_sha256", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64())]
)
_SEGMENT_DDL = "part long, segment long, first_token long, n_tokens long, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary, width int, dictionary_sha256 string, first_doc long, last_doc long"


def train_dictionary(docs: DataFrame, tokenizer: str, dictionary_docs: int, dictionary_bytes: int, width: int, end_id: int) -> bytes:
    """A zstandard dictionary; empty when there is too little to train on."""
    import zstandard

    # numbers first, then the few texts: no task sends more than it must
    ids = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(dictionary_docs)
    texts = docs.select(F.xxhash64("doc_id").alias("h"), whole_text().alias("text")).join(F.broadcast(ids.distinct()), "h")
    # at most dictionary_docs rows of SAMPLE_BYTES reach the driver
    picked = texts.mapInArrow(_samples(tokenizer, width, end_id), "h long, sample binary").orderBy("h", "sample").limit(dictionary_docs).collect()
    samples = [bytes(r["sample"]) for r in picked]
    try:
        return zstandard.train_dictionary(dictionary_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _samples(tokenizer: str, width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        for batch in batches:
            own = [_narrow(library.encode(t), end_id, width)[0][:SAMPLE_BYTES] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(own, pa.binary())], ["h", "sample"])

    return run


def _narrow(ids: bytes, end_id: int, width: int) -> tuple[bytes, int]:
    """Serialized ids with the end id, and their number."""
    x = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
    return x.astype("<u2" if width == 2 else "<u4").tobytes(), len(x)


def _zdict(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _write(tokenizer: str, dictionary: bytes, width: int, end_id: int, level: int):
    sha = hashlib.sha256(dictionary).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        library, part = encoder(tokenizer), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=level, dict_data=_zdict(dictionary), write_checksum=False, write_content_size=True, write_dict_id=False)
        segment = before = size = 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []

        def cut() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            known = [i for i in ids if i is not None]
            row = [part, segment, before, sum(counts), ids, counts, offsets, b"".join(frames), width, sha, min(known, default=None), max(known, default=None)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SEGMENT)], schema=_SEGMENT)

        for batch in batches:
            for first, last in slices(batch):
                rows = batch.slice(first, last - first)
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    data, n = _narrow(library.encode(text), end_id, width)
                    ids.append(doc)
                    counts.append(n)
                    frames.append(press.compress(data))
                    size += len(frames[-1])
                    if size >= SEGMENT_BYTES or len(frames) >= SEGMENT_DOCS:
                        yield cut()
                        segment, before, size, ids, counts, frames = segment + 1, before + sum(counts), 0, [], [], []
        if frames:
            yield cut()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, dictionary_docs: int = 400, dictionary_bytes: int = 65_536, level: int = 3) -> None:
    """Encode every whole text and write the tables of the format under `path`, in doc_id order."""
    spark = docs.sparkSession
    ship(spark)
    width = 2 if max(encoder(tokenizer).largest_id, end_id) < 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, dictionary_docs, dictionary_bytes, width, end_id)
    spark.createDataFrame([(dictionary, hashlib.sha256(dictionary).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(_write(tokenizer, dictionary, width, end_id, level), _SEGMENT_DDL).write.option("compression", "none").parquet(f"{path}/segments")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary of {path} does not match its hash")
    return spark.read.schema(_SEGMENT_DDL).parquet(f"{path}/segments"), dictionary, row["sha256"]


def _read(dictionary: bytes, sha: str, bases: dict[int, int], wanted: frozenset | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, first, width, own = (row.column(c)[0].as_py() for c in ("part", "first_token", "width", "dictionary_sha256"))
                if own != sha:
                    raise ValueError("a segment was written with another dictionary")
                docs, counts, offsets = (row.column(c)[0].as_py() for c in ("doc_ids", "counts", "offsets"))
                payload = memoryview(row.column("payload")[0].as_buffer())
                starts = bases[part] + first + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                out: list[tuple] = []
                for k, doc in enumerate(docs):
                    if wanted is not None and doc not in wanted:
                        continue
                    ids = np.frombuffer(unpress.decompress(payload[offsets[k] : offsets[k + 1]]), "<u2" if width == 2 else "<u4").astype("<u4")
                    if len(ids) != counts[k]:
                        raise ValueError(f"document {doc}: {len(ids)} ids read, {counts[k]} written")
                    out.append((doc, int(starts[k]), len(ids), zlib.crc32(ids.tobytes())) + ((ids.astype(np.int64),) if with_ids else ()))
                names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
                types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[] for _ in names], types)], names)

    return run


def read_tokens(spark: SparkSession, path: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of the written documents, or of those wanted."""
    ship(spark)
    segments, dictionary, sha = _opened(spark, path)
    # one number for each written part: as many as there were tasks
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, before = {}, 0
    for r in totals:
        bases[r["part"]], before = before, before + r["n"]
    if wanted is not None:
        # plain comparisons that Parquet's statistics can answer: other segments are not read
        inside = [(F.col("first_doc") <= w) & (F.col("last_doc") >= w) for w in wanted]
        segments = segments.filter(reduce(lambda a, b: a | b, inside, F.lit(False)))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return segments.mapInArrow(_read(dictionary, sha, bases, None if wanted is None else frozenset(wanted), with_ids), out)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents, by offset: other documents' frames are not decompressed."""
    return read_tokens(spark, path, doc_ids, with_ids=True)
