"""Tables whose rows are repeated many times: the same results, and work that grows with the rows, not with their square."""

import random

import pytest
from pyspark.sql import functions as F

from salesflow.llm import common, components, exact_dedup, jaccard_join, quality, substring_dedup
from salesflow.llm.common import made
from salesflow.llm.jaccard_join import near_duplicates

TEXT = " ".join(f"w{i * 7 % 101}" for i in range(90))


def repeated(spark, times):
    rows = spark.createDataFrame([(1, TEXT), (2, TEXT + " end"), (3, TEXT)], "doc_id long, text string")
    return rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("i")


@pytest.fixture
def met(monkeypatch):
    """Rows that the operators' saved tables and comparisons hold."""
    seen = {}

    def watch(module, name, count):
        real = getattr(module, name)

        def watched(*args):
            out = real(*args)
            seen[name] = seen.get(name, 0) + count(args, out)
            return out

        monkeypatch.setattr(module, name, watched)

    return seen, watch


def test_jaccard_join_keeps_one_set_for_each_class(spark, met):
    seen, watch = met
    watch(jaccard_join, "_verified", lambda args, out: args[1].count())
    results = []
    for times in (1, 200):
        seen.clear()
        results.append((sorted(set(map(tuple, jaccard_join.near_duplicates(repeated(spark, times)).collect()))), dict(seen)))
    assert results[0] == results[1] and [r[2] for r in results[0][0]] == [1, 1, 1]


def test_exact_dedup_meets_one_representative(spark, monkeypatch):
    counts = []

    def compare(docs, members, chunk, real=exact_dedup._compare):
        out = real(docs, members, chunk)
        plan = out._jdf.queryExecution().analyzed().toString()
        assert "Deduplicate" in plan
        counts.append(out.count())
        return out

    monkeypatch.setattr(exact_dedup, "_compare", compare)
    rows = exact_dedup.dedup_exact(repeated(spark, 200)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows} == {(1, 3, 400), (3, 3, 400), (2, 2, 200)} and max(counts) <= 3


def test_substring_dedup_aligns_a_chain_once(spark, monkeypatch):
    once = sorted(map(tuple, substring_dedup.repeated_passages(repeated(spark, 1)).collect()))
    many = sorted(map(tuple, substring_dedup.repeated_passages(repeated(spark, 200)).collect()))
    assert once == many and {r[0] for r in once} == {2, 3}
    two = repeated(spark, 1).unionByName(spark.createDataFrame([(3, "zz other text")], "doc_id long, text string"))
    assert sorted(map(tuple, substring_dedup.repeated_passages(two).collect())) == once  # the smallest text of doc 3 counts


def test_the_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 4)], "doc_id long, quality int")
    sample = quality.labelled_sample(repeated(spark, 200), labels, "quality", 10**6, 0, 2)
    assert sample.count() == 2


@pytest.mark.parametrize("every, words, recall", [(20, 100, 0.9), (50, 100, 0.9), (33, 60, 0.8)])
def test_recall_of_changed_passages(spark, every, words, recall):
    """Planted pairs with one word changed every `every` words find as many as the operator says."""
    import random

    rng, rows = random.Random(every), []
    filler = lambda n: [f"f{rng.randint(0, 10**7)}" for _ in range(n)]
    for n in range(40):
        run = [f"p{rng.randint(0, 10**6)}" for _ in range(words)]
        other = [f"c{rng.randint(0, 10**6)}" if i % every == every // 2 else w for i, w in enumerate(run)]
        rows += [(2 * n, " ".join(filler(70) + run + filler(40))), (2 * n + 1, " ".join(filler(30) + other + filler(90)))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    good = {r["doc_id"] for r in found if r["source_doc"] == r["doc_id"] - 1 and min(r["end_word"], 30 + words) - max(r["start_word"], 30) >= 0.9 * words}
    assert len(good) >= recall * 40


def test_long_near_copies_cost_in_proportion():
    """Two near copies of 200,000 words, with words changed, dropped and added, are aligned in seconds."""
    import random
    import time

    import numpy as np

    rng = random.Random(2)
    x = np.array([rng.getrandbits(63) for _ in range(200_000)], np.uint64)
    kept, y, places = [], [], []
    for i, w in enumerate(x.tolist()):
        if i % 97 == 50:
            if i % 3 == 0:
                continue
            y.append(rng.getrandbits(63))
            if i % 3 == 1:
                y.append(w)
                kept.append(i)
        else:
            if i % 97 == 0:
                places.append((i, len(y)))
            y.append(w)
            kept.append(i)
    xs, ys = (np.array(c, np.int64) for c in zip(*places))
    start = time.monotonic()
    ax, bx, _, _, same = substring_dedup.align(x, np.array(y, np.uint64), xs, ys)
    assert time.monotonic() - start < 20 and same == sum(ax <= i < bx for i in kept)


def test_calibration_interpolates_between_steps(spark):
    import numpy as np

    from salesflow.llm.toxicity import _between

    at, value = [-2.0, -1.0, -1.0, 0.5, 3.0], [0.1, 0.1, 0.4, 0.7, 0.9]
    xs = [-9.0, -2.0, -1.5, -1.0, -0.2, 0.5, 2.0, 3.0, 8.0]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(_between(F.col("x"), at, value).alias("y")).collect()]
    want = [0.1 if x <= -1.0 else float(np.interp(x, at[2:], value[2:])) for x in xs]
    assert np.allclose(got, want)


def test_near_duplicates_leave_three_tables(spark):
    """Only the tables that the result reads stay in the shared folder: documents' sets, classes, components."""
    text = lambda *w: " ".join(f"w{k}" for k in range(30) if k not in w)
    rows = [(1, text()), (2, text(29)), (3, text(0)), (4, "a b c d e f"), (5, "a b c d e f g"), (6, None), (7, text())]
    with made() as tables:
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        fs = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in tables]
        left = [p for p in fs if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)]
    assert len(tables) > 10 and len(left) == 3
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 1)]


def test_components_write_one_table_for_each_round(spark, monkeypatch):
    """Links that are stars already are seen to be settled after one round; nothing else is written."""
    written = []
    monkeypatch.setattr(components, "saved", lambda df: written.append(1) or common.saved(df))
    stars = spark.createDataFrame([(x, 10 * (x // 10)) for x in range(1000)], "a long, b long")
    assert {tuple(x) for x in components.components(stars).collect()} == {(x, 10 * (x // 10)) for x in range(1000) if x % 10}
    assert len(written) == 1


def test_components_of_chains_loops_and_repeated_links(spark):
    r = random.Random(3)
    links = [(x, x + 1) for x in range(0, 40)] + [(x, x) for x in range(50, 60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(200)] * 2
    least = {x: x for pair in links for x in pair}
    for _ in range(60):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((x, c) for x, c in least.items() if x != c)
