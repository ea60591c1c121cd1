"""Operators 11 to 13 against plain forms."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesflow.llm import conversation_repair as repair
from salesflow.llm import hard_negatives as mining
from salesflow.llm import queries
from salesflow.llm import winnowing as winnow

# ---------------------------------------------------------------- 11


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def cheapest(conv, rows):
    """The contract's row by search in the order of (cost, audit)."""
    turns = [r[0] for r in rows if r[0] is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        ink = [c for c in text if not (c == " " or "\t" <= c <= "\r")]
        faults.append("b" if not ink else "d" if (role, text) in seen else "" if ink[-1] in ".!?" else "t")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    go = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}
    heap, done = [(0, "", 0, "0", ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in "0A":
            gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            return (conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        edits = [("I", 2, i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if faults[i] in ("", "t"):
                more = int(faults[i] == "t")
                edits += [("K", more, i + 1, role, f"{role}:{text}")] + [("R", 2 + more, i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for letter, price, at, role, line in edits:
            if to := go.get((state, role[:1])):
                heapq.heappush(heap, (cost + price, audit + letter, at, to, (*lines, line)))


def assert_repaired(df):
    first = lambda r: (r[0] is not None, r[0] or 0)
    got = sorted((tuple(r) for r in repair.report(repair.damage(df), df).collect()), key=first)
    rows = sorted((tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()), key=first)
    assert got == [cheapest(c, damaged(list(own))) for c, own in itertools.groupby(rows, key=lambda r: r[0])]


def test_conversations_of_the_table(spark, sf_dir):
    assert_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@pytest.mark.parametrize("least", [64, 2])
def test_odd_and_long_conversations(spark, monkeypatch, least):
    """Nulls, ties, repeated rows, roles out of the pattern, empty and long texts; with small blocks walks cross many checkpoints."""
    monkeypatch.setattr(repair, "LEAST", least)
    rng, rows = random.Random(least), []
    for c in [None, *range(20)]:
        for k in range(rng.choice([1, 2, 3, 9, 80, 300])):
            turn = rng.choice([None, *range(50)]) if c and c % 2 else k
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(["a.", "b!", "c", "  ", "", " é?\n", None, "w " * 30_000 + "end.", f"x{k}.", f"y{k}"]), "x"))
    assert_repaired(spark.createDataFrame(rows + rows[:9] * 3, "conv_id long, turn long, role string, text string, sha string"))


def test_a_repeated_row_is_folded_and_an_empty_table_is_empty(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi."), (1, 1, "assistant", "yes.")], "conv_id long, turn long, role string, text string")
    many = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("i")
    assert repair.flagged(many).count() == 2
    row = repair.report(many, many).first()
    assert (row["duplicate"], row["cost"], row["audit"]) == (998, 998 * 3, "K" + "D" * 499 + "K" + "D" * 499)
    assert repair.report(rows.limit(0), rows.limit(0)).count() == 0
    assert repair.report(rows.limit(0), rows).first()["audit"] == ""  # all its rows were dropped


# ---------------------------------------------------------------- 12


@pytest.mark.parametrize("largest", [3, 300, 40_000, 1 << 40])
def test_products_are_exact(largest):
    rng = random.Random(largest)
    a, b = (np.array([[rng.randint(-largest, largest) for _ in range(600)] for _ in range(n)]) for n in (5, 7))
    want = a.astype(object) @ b.astype(object).T
    assert (mining.product(a, b, mining.basis(600 * largest**2)) == want).all()


def mined(rows, every=100):
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = ([int(np.floor(256.0 * float(np.float32(x)))) for x in v], label)
        good[i] = min(good.get(i, w), w)
    score = lambda a, b: sum(x * y for x, y in zip(good[a][0], good[b][0]))
    out = []
    for a in (i for i in good if i % every == 0):
        same = sorted((-score(a, i), i) for i in good if i != a and good[i][1] == good[a][1])[:5]
        other = sorted((-score(a, i), i) for i in good if good[i][1] != good[a][1])
        for s, p in same:
            fits = [(-n, i) for n, i in other if -30 * s <= -100 * n <= -90 * s][:10]
            out += [(a, p, rank, i, -s, n) for rank, (n, i) in enumerate(fits, 1)]
    return sorted(out)


_VECTORS = "vec_id long, embedding array<float>, label int, block string, score int"


def test_mining_meets_brute_force(spark, monkeypatch):
    """A hot label and a hot vector, ties, nulls, repeated rows, columns of clashing names; small blocks make many units."""
    for name, size in (("BLOCK", 16), ("ANCHORS", 4), ("GROUP", 3), ("SLICE", 3)):
        monkeypatch.setattr(mining, name, size)
    rng = random.Random(12)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.1, 0.7]) for _ in range(4)] if i % 3 else [0.5, 0.5, 0.25, 0.1], 1 if i % 3 == 0 else rng.randint(0, 4)) for i in range(260)]
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (310, [1.0, None, 1.0, 1.0], 1), (320, [float("nan")] * 4, 1), (330, [float("inf")] * 4, 1), (340, [0.5] * 4, None), (0, [0.7] * 4, 2), (0, [0.7] * 4, 2)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], _VECTORS)
    assert sorted(map(tuple, mining.mine(df, every=10).collect())) == mined(rows, 10)


def test_large_components_and_no_anchors(spark):
    big = [(i, [float(np.float32(1e6 * (1 + i % 5))), -1.0], i % 2) for i in range(0, 400, 10)]
    df = spark.createDataFrame([(*r, "x", 7) for r in big], _VECTORS)
    with pytest.raises(Exception, match="64 bits"):  # the scores do not fit
        mining.mine(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e8))).collect()
    assert sorted(map(tuple, mining.mine(df).collect())) == mined(big)
    assert mining.mine(df.filter("vec_id % 100 <> 0")).count() == 0 and mining.mine(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 13


def chosen(hashes, window):
    """(position) of each window's least hash modulo the prime, rightmost on ties."""
    keys = [h % winnow.PRIME for h in hashes]
    out = set()
    for a in range(max(1, len(keys) - window + 1) if keys else 0):
        own = range(a, min(a + window, len(keys)))
        out.add(max(i for i in own if keys[i] == min(keys[j] for j in own)))
    return sorted(out)


def words_of(text):
    return [w for w in re.split("[ \t\n\x0b\x0c\r]+", text.lower()) if w]


@pytest.mark.parametrize("k, window", [(5, 6), (1, 1), (3, 4), (8, 13)])
def test_winnowing_chooses_least_hashes(spark, sf_dir, k, window):
    odd = ["", " \n", "one", "a b c d", " a  b\tc\nd e ", "x " * 50, "É é É é É é", "a b " * 9 + "c"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("text").unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    rows = docs.select("text", winnow.fingerprint(F.col("text"), k, window).alias("f")).collect()
    bits = {w: h for w, h in spark.createDataFrame([(w,) for w in {w for r in rows for w in words_of(r["text"])}], "w string").select("w", F.xxhash64("w")).collect()}
    for r in rows:
        h = [bits[w] & ((1 << winnow.WORD_BITS) - 1) for w in words_of(r["text"])]
        h += [0] * (k - len(h) if 0 < len(h) < k else 0)
        sums = [sum(x * pow(winnow.BASE, k - 1 - j, winnow.PRIME) for j, x in enumerate(h[i : i + k])) for i in range(len(h) - k + 1)]
        assert r["f"]["positions"] == chosen(sums, window) and r["f"]["hashes"] == [sums[p] for p in r["f"]["positions"]]


def test_shared_runs_are_matched_in_place(spark):
    rng, rows = random.Random(3), []
    for n in range(40):
        run = [f"s{n}x{rng.randint(0, 30)}" for _ in range(10)]  # window + k - 1 words
        filler = lambda m: [f"w{rng.randint(0, 10**6)}" for _ in range(m)]
        a, b = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((" ".join(filler(a) + run + filler(9)), " ".join(filler(b) + run + filler(20)), a, b))
    out = spark.createDataFrame(rows, "x string, y string, a int, b int").select("a", "b", winnow.matches(winnow.fingerprint(F.col("x")), winnow.fingerprint(F.col("y"))).alias("m")).collect()
    assert all(any(r["a"] <= m["at"] <= r["a"] + 5 and m["at"] - r["a"] == m["in"] - r["b"] for m in r["m"]) for r in out)


def test_edited_texts_and_successors(spark):
    """Null and repeated doc_ids, empty and very long texts, columns of clashing names, several buckets."""
    rng = random.Random(5)
    texts = ["", None, "é" * 7, "the end", "w " * 150_000] + [" ".join(rng.choice("abcdefg") * 3 for _ in range(rng.randint(1, 90))) for _ in range(60)]
    rows = [(rng.choice([None, -(2**63), 2**63 - 1, *range(-20, 40)]), t, "x", 1) for t in texts] + [(5, "same", "y", 2)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, o string, bucket int")
    got = winnow.with_next(df, rows=8).collect()
    assert len(got) == len(rows)
    place = lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0))
    key = {t: h for t, h in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    order = sorted(got, key=lambda r: (place(r), key[r["text"]], r["text"]))
    pairs = sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in got)
    assert pairs == sorted((str(a["doc_id"]), a["text"], b["text"]) for a, b in zip(order, order[1:] + order[:1]))
    for r in winnow.digest(winnow.compare(df)).collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert winnow.with_next(df.limit(0)).count() == 0
    one = winnow.with_next(df.filter("text = 'the end'")).first()
    assert one["next_text"] == "the end"


def test_fingerprint_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.op13_fingerprints(spark, sf_dir).collect()}
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    order, prints = sorted(text, reverse=True), {}
    for a, b in zip(order, order[1:] + order[:1]):
        half = len(text[a]) // 2
        changed = text[a][: len(text[a]) - half] + text[b][:half]
        assert (rows[a]["n_chars"], rows[a]["edited_sha256"]) == (len(text[a]), hashlib.sha256(changed.encode()).hexdigest())
        assert prints.setdefault(text[a], rows[a]["fingerprint"]) == rows[a]["fingerprint"]
        x, y = ({c.split("@")[0] for c in rows[d]["fingerprint"].split()} for d in (a, b))
        assert rows[a]["near_next"] == (len(x & y) / len(x | y) if x | y else 1.0)
    assert len(set(prints.values())) > 0.97 * len(prints) and sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)


def test_fingerprints_run_no_python(spark, sf_dir):
    plan = queries.op13_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|RDD", plan.replace("FileScan", ""))
    assert plan.count("Exchange hashpartitioning") == 1  # texts are shuffled once
