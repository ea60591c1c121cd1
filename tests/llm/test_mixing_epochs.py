"""Epochs of a mix as permutations of blocks, and what the mix reached."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from salesflow.llm import mixing


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    old, mixing.BLOCK_DOCS = mixing.BLOCK_DOCS, 8  # many blocks over few documents
    try:
        docs = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 20 == 0, "small").when(F.col("id") % 20 == 1, F.lit(None)).otherwise("large").alias("source"), F.lit("own").alias("epoch"))
        place = str(tmp_path_factory.mktemp("mixed"))
        mixing.mix(docs, target_entropy=0.98, max_repeats=3.0, budget_share=0.5, fill=True).write.parquet(f"{place}/m")
        return spark.read.parquet(f"{place}/m")
    finally:
        mixing.BLOCK_DOCS = old


def test_each_epoch_permutes_whole_blocks(mixed):
    rows = mixing.epoch_rows(mixed).collect()
    assert len(rows) == mixed.agg(F.sum("copies")).first()[0]
    taken, orders = defaultdict(set), defaultdict(list)
    for r in sorted(rows, key=lambda r: (str(r.source), r.epoch, r.turn, r.draw)):
        key, block = (r.source, r.epoch), r.draw >> 32
        assert r.doc_id not in taken[key], "a document once in an epoch"
        taken[key].add(r.doc_id)
        if not orders[key] or orders[key][-1] != block:
            orders[key].append(block)
    for order in orders.values():
        assert len(order) == len(set(order)), "a block is read as a whole"
    repeated = [s for s, e in orders if e == 1]
    assert repeated
    for source in repeated:
        first, second = orders[source, 0], orders[source, 1]
        assert set(second) <= set(first) and taken[source, 1] <= taken[source, 0]
        if len(second) > 3:
            assert [b for b in first if b in set(second)] != second, "epochs differ in their order"
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    assert all(sum(d in taken[k] for k in taken) == n for d, n in copies.items())


def test_epochs_are_the_same_again_and_another_seed_permutes_otherwise(mixed):
    order = lambda seed: [(r.doc_id, r.epoch) for r in mixing.epoch_rows(mixed, seed).orderBy("source", "epoch", "turn", "draw").collect()]
    assert order(17) == order(17)
    assert order(17) != order(18) and sorted(order(17)) == sorted(order(18))


def test_reached_shares_and_entropy_against_plain_sums(mixed):
    rows = mixed.collect()
    tokens, drawn = defaultdict(int), defaultdict(int)
    for r in rows:
        tokens[r.source] += r.n_tokens
        drawn[r.source] += r.n_tokens * r.copies
    whole = sum(drawn.values())
    entropy = -sum(n / whole * math.log(n / whole) for n in drawn.values() if n) / math.log(len(tokens))
    got = {r.source: r for r in mixing.reached(mixed).collect()}
    assert set(got) == set(tokens) == {"small", "large", None}
    for s, r in got.items():
        assert (r.tokens, r.drawn) == (tokens[s], drawn[s])
        assert math.isclose(r.share, drawn[s] / whole) and math.isclose(r.passes, drawn[s] / tokens[s]) and math.isclose(r.entropy, entropy)
    longest = max(r.n_tokens for r in rows)
    assert all(n <= 3 * tokens[s] + longest for s, n in drawn.items())


@pytest.mark.parametrize("fill", [False, True])
def test_without_clipping_the_target_entropy_is_reached(spark, fill):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("source"))
    got = mixing.reached(mixing.mix(docs, target_entropy=0.95, max_repeats=5.0, budget_share=0.5, fill=fill)).collect()
    assert len(got) == 3 and all(abs(r.entropy - 0.95) < 0.005 for r in got)
    assert all(abs(r.share - r.weight) < 0.005 for r in got)


def test_no_rows_empty_texts_and_a_single_source(spark):
    schema = "doc_id long, text string, source string"
    none = mixing.mix(spark.createDataFrame([], schema))
    assert mixing.epoch_rows(none).count() == 0 and mixing.reached(none).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema))
    assert sorted((r.doc_id, r.epoch) for r in mixing.epoch_rows(empty).collect()) == [(1, 0), (2, 0)]
    assert mixing.reached(empty).count() == 0
    one = mixing.reached(mixing.mix(spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], schema))).collect()
    assert [(r.tokens, r.drawn, r.share, r.entropy) for r in one] == [(4, 4, 1.0, 1.0)]
