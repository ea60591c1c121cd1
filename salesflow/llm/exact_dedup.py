"""Exact deduplication by composable polynomial fingerprints.

A text's bytes are cut into chunks (one row each); a chunk's hash is a polynomial of its bytes under
two primes, and hashes combine by length-shifted arithmetic: H(xy) = H(x) * B^|y| + H(y). So the
chunks of a huge document are dealt to many tasks, hashed in parallel, and only hashes meet. Documents with equal
fingerprint and length are then compared with their group's largest doc_id chunk by chunk; those
that differ (a collision) are grouped anew until none is left.

Defined results: null text is empty text; the largest doc_id of equal texts stays; a null doc_id is
smaller than all others; rows repeated with the same doc_id and text are one output row, counted
in group_size; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship, whole_text

#: Bytes of a chunk: one row, compared at once.
CHUNK = 1 << 20
#: Members of a group that meet one copy of their representative's chunk.
SALT_ROWS = 256
#: Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)

_STEP = 1 << 15
_POWERS: dict[int, np.ndarray] = {}


def _powers(k: int) -> np.ndarray:
    """B^(_STEP-1), ..., B, 1 modulo the k-th prime."""
    if k not in _POWERS:
        out = [1]
        for _ in range(_STEP - 1):
            out.append(out[-1] * BASES[k] % PRIMES[k])
        _POWERS[k] = np.array(out[::-1], np.float64)
    return _POWERS[k]


def chunk_hash(data: bytes) -> tuple[int, int, int, int]:
    """A chunk's two hashes and the two shifts B^|chunk| by which what stands before it moves."""
    x = np.frombuffer(data, np.uint8)
    out, shift = [], []
    for k in (0, 1):
        p, powers = PRIMES[k], _powers(k)
        whole, step = 0, pow(BASES[k], _STEP, p)
        head = len(x) % _STEP
        # below 2^8 * 2^31 * 2^15 / 2: doubles are exact up to 2^53, so blocks are summed in halves
        for block in ([x[:head]] if head else []) + [x[i : i + _STEP] for i in range(head, len(x), _STEP)]:
            part = sum(int(b.astype(np.float64) @ w) for b, w in _halves(block, powers[_STEP - len(block) :]))
            whole = (whole * (step if len(block) == _STEP else pow(BASES[k], len(block), p)) + part) % p
        out.append(whole)
        shift.append(pow(BASES[k], len(x), p))
    return (*out, *shift)


def _halves(block: np.ndarray, weights: np.ndarray):
    for i in range(0, len(block), 1 << 13):
        yield block[i : i + (1 << 13)], weights[i : i + (1 << 13)]


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = batch.column("chunk")
        hashes = np.array([chunk_hash(x.as_buffer()) for x in data], np.int64).reshape(-1, 4)
        keep = [i for i, n in enumerate(batch.schema.names) if n != "chunk"]
        columns = [batch.column(i) for i in keep] + [pa.array(np.ascontiguousarray(c)) for c in hashes.T]
        yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in keep] + ["f1", "f2", "s1", "s2"])


def _chunks(docs: DataFrame, *carried: Column | str, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each text; an empty text has one empty chunk."""
    rows = docs.select(*carried, F.encode(whole_text(), "UTF-8").alias("bytes"))
    last = F.floor((F.greatest(F.length("bytes"), F.lit(1)) - 1) / chunk).cast("int")
    names = [c for c in rows.columns if c != "bytes"]
    at = rows.select(*names, "bytes", F.explode(F.sequence(F.lit(0), last)).alias("c"))
    return at.select(*names, "c", F.length("bytes").cast("long").alias("n_bytes"), F.substring("bytes", F.col("c") * chunk + 1, F.lit(chunk)).alias("chunk"))


def fingerprints(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, sha, n_bytes, f1, f2 of each row of documents; sha: SHA-256 of the text, binary."""
    ship(docs.sparkSession)
    rows = docs.withColumns({"_sha": F.unhex(F.sha2(F.encode(whole_text(), "UTF-8"), 256)), "_row": F.monotonically_increasing_id()})
    carried, form = (F.col("doc_id").cast("long").alias("doc_id"), F.col("_sha").alias("sha"), F.col("_row").alias("row")), "doc_id long, sha binary, row long, c int, n_bytes long, f1 long, f2 long, s1 long, s2 long"
    long = F.octet_length(whole_text()) > chunk
    # a short text is hashed where it is read; chunks of long ones are dealt out first, to be hashed side by side
    dealt = _chunks(rows.filter(long), *carried, chunk=chunk).repartition("row", "c")
    hashed = _chunks(rows.filter(~long), *carried, chunk=chunk).mapInArrow(_hash_chunks, form).unionByName(dealt.mapInArrow(_hash_chunks, form))
    parts = hashed.groupBy("row", "doc_id", "sha", "n_bytes").agg(F.sort_array(F.collect_list(F.struct("c", "f1", "s1", "f2", "s2"))).alias("parts"))

    def combined(k: int) -> Column:
        return F.aggregate("parts", F.lit(0).cast("long"), lambda h, x: F.pmod(h * x[f"s{k}"] + x[f"f{k}"], F.lit(PRIMES[k - 1]).cast("long"))).alias(f"f{k}")

    return parts.select("doc_id", "sha", "n_bytes", combined(1), combined(2))


def _compare(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """same: whether each member's text equals its representative's, chunk by chunk."""
    named = members.select("doc_id", "sha", "rep_doc", "rep_sha", "salts", "n_bytes", "f1", "f2")
    sha = F.unhex(F.sha2(F.encode(whole_text(), "UTF-8"), 256))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), sha.alias("s"), whole_text().alias("text"))
    own = texts.join(named, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("sha")))
    rows = saved(_chunks(own, "doc_id", "sha", "rep_doc", "rep_sha", "salts", "f1", "f2", chunk=chunk))
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("sha") == F.col("rep_sha"))
    # repeated rows of a representative are one, so that a member's chunks meet one each
    reps = rows.filter(is_rep).dropDuplicates(["rep_doc", "rep_sha", "c"]).select(F.col("rep_doc").alias("r"), F.col("rep_sha").alias("rs"), F.col("c").alias("rc"), F.col("chunk").alias("rep_chunk"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("rsalt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), F.col("salts")).cast("int"))
    met = salted.join(reps, F.col("rep_doc").eqNullSafe(F.col("r")) & (F.col("rep_sha") == F.col("rs")) & (F.col("c") == F.col("rc")) & (F.col("salt") == F.col("rsalt")))
    return met.groupBy("doc_id", "sha", "rep_doc", "rep_sha", "n_bytes", "f1", "f2").agg(F.bool_and(F.col("chunk") == F.col("rep_chunk")).alias("same"))


def dedup_exact(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each distinct (doc_id, text)."""
    prints = fingerprints(docs, chunk).groupBy("doc_id", "sha", "n_bytes", "f1", "f2").agg(F.count(F.lit(1)).alias("n_rows"))
    prints = saved(prints)
    key = ["n_bytes", "f1", "f2"]
    open_rows, settled = prints, None
    while True:
        groups = open_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "sha")).alias("rep")).filter("n > 1")
        salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
        members = open_rows.join(groups, key).select("doc_id", "sha", *key, F.col("rep.doc_id").alias("rep_doc"), F.col("rep.sha").alias("rep_sha"), salts.alias("salts"))
        compared = saved(_compare(docs, members, chunk))
        same = compared.filter("same").select("doc_id", "sha", "rep_doc", "rep_sha")
        settled = same if settled is None else settled.unionByName(same)
        open_rows = compared.filter("NOT same").select("doc_id", "sha", *key)
        if open_rows.isEmpty():
            break
    found = settled.withColumnsRenamed({"doc_id": "d", "sha": "s"})
    rows = prints.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sha") == F.col("s")), "left")
    alone = F.col("s").isNull()
    rows = rows.select("doc_id", "sha", "n_rows", F.when(alone, F.col("doc_id")).otherwise(F.col("rep_doc")).alias("keep_id"), F.coalesce("rep_sha", "sha").alias("rep_sha"))
    # sizes: partial counts first, so that a hot group never meets in one task
    sizes = rows.groupBy("keep_id", "rep_sha").agg(F.sum("n_rows").alias("group_size")).withColumnsRenamed({"keep_id": "k", "rep_sha": "ks"})
    single = rows.join(sizes, F.col("keep_id").eqNullSafe(F.col("k")) & (F.col("rep_sha") == F.col("ks")))
    return single.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
