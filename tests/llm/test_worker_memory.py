"""What a Python worker, and the executor beside it, hold at once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from salesflow.llm import common, encode, jaccard_join, packing, queries


def test_packing_leaves_few_words_in_its_workers(spark):
    """Words that are remembered stay in the worker while it runs other stages."""
    path, many = queries.vocabulary("word_bpe_49k.json"), 2 * packing.WORDS
    common.ship(spark)

    def remembered(batches):
        for batch in packing._cut(path, 2048, 0)(batches):
            pass
        yield pa.RecordBatch.from_arrays([pa.array([max(len(e.words) for key, e in encode._ENCODERS.items() if path in key)], pa.int64())], ["words"])

    letters = F.translate(F.lpad(F.conv(F.col("id"), 10, 20), 6, "0"), "0123456789", "klmnopqrst")
    docs = spark.range(0, many, 1, 1).groupBy(F.expr("id div 1000").alias("doc_id")).agg(F.concat_ws(" ", F.collect_list(letters)).alias("text")).coalesce(1)
    found = docs.mapInArrow(remembered, "words long").collect()
    assert [r["words"] for r in found] == [packing.WORDS]


def test_an_encoder_that_remembers_little_gives_the_same_ids():
    path, text = queries.vocabulary("byte_bpe_50k.json"), "some words, and other words; some once more"
    few = encode.encoder(path, 3)
    assert few.encode(text) == few.encode(text) == few.whole(text) and len(few.words) == 3


def test_tasks_of_the_near_join_send_bounded_batches():
    """An executor holds a batch that it is sent whole, outside its heap."""
    r = np.random.default_rng(5)
    words = r.integers(0, 10**9, 3 * common.SENT_ROWS).astype(str)
    texts = pa.array([" ".join(w) for w in np.array_split(words, 30)])
    sets = list(jaccard_join.shingle_sets(texts))
    rule = jaccard_join.Rule(75, 100)
    sent = list(jaccard_join._send(rule, 5)(iter([pa.RecordBatch.from_arrays([texts], ["text"])])))
    assert max(b.num_rows for b in sent) <= common.SENT_ROWS
    assert sorted(x for b in sent for x in b.column("h").to_pylist()) == sorted(x for own in sets for x in own[: rule.prefix(len(own))].view(np.int64).tolist())
    ids = pa.array(range(len(sets)), pa.int64())
    stored = pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets]), ids], ["cid", "n", "hashes", "component"])
    told = list(jaccard_join._explode(iter([stored, stored.slice(0, 0)])))
    assert max(b.num_rows for b in told) <= common.SENT_ROWS
    pairs = [p for b in told for p in zip(b.column("cid").to_pylist(), b.column("h").to_pylist())]
    assert pairs == [(k, h) for k, own in enumerate(sets) for h in own.view(np.int64).tolist()]
