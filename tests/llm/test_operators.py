"""Training-data operators against SQL, brute force, round trips and held-out labels; and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from parity import assert_parity, connect
from pyspark.sql import functions as F

from salesflow.llm import encode, exact_dedup, jaccard_join, line_dedup, mixing, mtree, packing, quality, queries, shingles, substring_dedup, token_output, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, copies, near copies and columns with clashing names."""
    a, b = prose(1, 120), prose(2, 90)
    words = a.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    rows = [(0, None, "en", "s0", 1), (1, "", "en", None, None), (2, a, None, "s0", 3), (3, a, "en", "s0", 3), (3, a, "en", "s0", 3), (4, near, "en", "s1", 3), (5, "one two", "en", "s1", 3), (6, "ONE  two\n", "de", "s1", 3), (7, b + "\n" + a[:200], "en", "s2", 0), (None, b, "en", "s2", 9), (8, " \t\n", "en", "s2", 9), (9, prose(3, 30_000), "en", "s0", 9), (10, b + " tail", "en", "s2", 9), (11, "A line that is long\nshort\nA LINE that is long  ", "fr", "s1", 1), (12, "a line that is long", "fr", "s1", 1)]
    docs = spark.createDataFrame(rows, DOC)
    clashing = {c: F.lit("x") for c in ("h", "n", "kept", "row", "cid", "component_id", "n_tokens", "copies", "draw", "weight", "key", "chunk", "sha", "s", "d", "x", "part")}
    return docs.withColumns(clashing)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_parity(spark, connect(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir)


# ---------------------------------------------------------------- 1 substring dedup


def test_passages_cover_all_exact_repeats(spark, sf_dir):
    rows = queries.op1_substring_dedup(spark, sf_dir).collect()
    covered = defaultdict(list)
    for r in rows:
        covered[r["doc_id"]].append((r["start_word"], r["end_word"]))
        assert r["source_doc"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50 and r["identity"] >= 0.8
    texts = {r["doc_id"]: r["text"].encode().lower().split() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    first, missed, total = {}, 0, 0
    for d in sorted(texts):
        for i in range(len(texts[d]) - 49):
            if first.setdefault(tuple(texts[d][i : i + 50]), d) != d:
                total += 1
                missed += not any(a <= i and i + 50 <= b for a, b in covered[d])
    assert total and missed <= 0.001 * total


def test_passages_edges(odd):
    rows = substring_dedup.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["source_doc"]) for r in rows} >= {(3, 2), (4, 2), (10, 7)}
    assert substring_dedup.repeated_passages(odd.limit(0)).count() == 0


def _found(spark, *texts):
    """The passages of documents 1, 2, ... as (doc_id, start, end, source_doc)."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts, 1)], "doc_id long, text string")
    return [(r["doc_id"], r["start_word"], r["end_word"], r["source_doc"]) for r in substring_dedup.repeated_passages(docs).collect()]


def test_passages_with_other_words_between_are_all_found(spark):
    for k, (head, body, foot) in enumerate([(60, 100, 60), (50, 150, 55), (80, 300, 50), (60, 30, 60)]):
        top, end = prose(900 + k, head), prose(950 + k, foot)
        found = _found(spark, f"{top} {prose(1000 + k, body)} {end}", f"{top} {prose(1100 + k, body)} {end}")
        for a, b in ((0, head), (head + body, head + body + foot)):
            assert any(d == 2 and start <= a and b <= stop for d, start, stop, _ in found), (k, found)


def test_passages_repeated_inside_a_document_are_all_found(spark):
    text, line = prose(800, 60), prose(801, 10)
    found = _found(spark, f"{prose(810, 30)} {text}", " ".join(f"{prose(820 + k, 40)} {text}" for k in range(12)))
    for k in range(12):
        a = 100 * k + 40
        assert any(d == 2 and start <= a and a + 60 <= b for d, start, b, _ in found), k
    periodic = " ".join([line] * 10)  # a period shorter than a passage
    assert any(d == 2 and b - a >= 95 for d, a, b, _ in _found(spark, periodic, f"{periodic} {prose(802, 50)}"))


def test_passages_whose_parts_first_occur_elsewhere_are_found(spark):
    for k, (m, n) in enumerate([(30, 30), (35, 29), (40, 40), (20, 45)]):
        x, y = prose(700 + k, m), prose(720 + k, n)
        own = [prose(740 + 10 * k + j, 40) for j in range(8)]
        found = _found(spark, f"{own[0]} {x} {own[1]}", f"{own[2]} {y} {own[3]}", f"{own[4]} {x} {y} {own[5]}", f"{own[6]} {x} {y} {own[7]}")
        assert any(d == 4 and source == 3 and a <= 40 and 40 + m + n <= b for d, a, b, source in found), (k, found)


def test_shortest_exact_runs_whose_parts_first_occur_elsewhere_are_found(spark):
    for k, (m, n) in enumerate([(25, 25), (27, 24), (26, 30)]):
        parts = [prose(600 + 10 * k, m), prose(601 + 10 * k, n)]
        x, y = parts
        own = [prose(2000 + 20 * k + j, 40) for j in range(10)]
        # every part, and every overlap short of the run, is held by an earlier document
        words = f"{x} {y}".split()
        pieces = [f"{own[8]} {' '.join(words[:-1])} {own[9]}", f"{own[9]} {' '.join(words[1:])} {own[8]}"] if m + n == 50 else []
        found = _found(spark, f"{own[0]} {x} {own[1]}", f"{own[2]} {y} {own[3]}", *pieces, f"{own[4]} {x} {y} {own[5]}", f"{own[6]} {x} {y} {own[7]}")
        last = 4 + len(pieces)
        assert any(d == last and a <= 40 and 40 + m + n <= b for d, a, b, _ in found), (k, found)


def test_exact_runs_inside_a_found_passage_are_not_told_again(spark):
    x, y = prose(2300, 300), prose(2301, 60)
    found = _found(spark, f"{prose(2302, 40)} {x} {prose(2303, 40)}", f"{prose(2304, 40)} {y} {prose(2305, 40)}", f"{prose(2306, 40)} {x} {prose(2307, 40)} {y} {prose(2308, 40)}")
    assert sorted((a, b) for d, a, b, _ in found if d == 3) == [(40, 340), (380, 440)], found


def test_every_run_of_the_least_length_holds_a_long_seed():
    r = np.random.default_rng(9)
    for shared in (r.integers(0, 2**63, 50).astype(np.uint64), np.tile(r.integers(0, 2**63, 3).astype(np.uint64), 17)[:50]):
        for _ in range(100):
            both = []
            for _ in range(2):
                before = int(r.integers(0, 40))
                words = np.concatenate([r.integers(0, 2**63, before), shared, r.integers(0, 2**63, int(r.integers(0, 40)))]).astype(np.uint64)
                h, at = substring_dedup.long_seeds(words, 50)
                both.append(set(zip(h.tolist(), (at - before).tolist())))
            assert both[0] & both[1]


def test_every_long_exact_run_holds_a_long_seed():
    r = np.random.default_rng(8)
    shared = r.integers(0, 2**63, 57).astype(np.uint64)
    for _ in range(200):
        both = []
        for _ in range(2):
            before = int(r.integers(0, 40))
            words = np.concatenate([r.integers(0, 2**63, before), shared, r.integers(0, 2**63, int(r.integers(0, 40)))]).astype(np.uint64)
            h, at = substring_dedup.long_seeds(words, 50)
            both.append(set(zip(h.tolist(), (at - before).tolist())))
        assert both[0] & both[1]


def test_word_hashes_tell_words_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(shingles, "PIECE", 16)
    r = random.Random(4)
    pool = ["a", "b", "ab", "ba", "aB", "A", "", " ", "\n", "\t", "\x0b", "é", "\u00a0", "日本", "x" * 40, "\x00", "-"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(9))) for _ in range(3000)]
    array = pa.array([*texts, "", "tail"]).slice(1, 3000)
    own, seen = texts[1:] + [""], {}
    for text, words in zip(own, shingles.each_text(array)):
        plain = text.encode().lower().split()
        assert len(plain) == len(words)
        assert all(seen.setdefault(w, h) == h for w, h in zip(plain, words.tolist()))
    assert len(set(seen.values())) == len(seen) > 500
    for large, text in ((True, ["x y", None, "y  x"]), (False, [])):
        array = pa.array(text, pa.large_string() if large else pa.string()).fill_null("")
        assert [len(w) for w in shingles.each_text(array)] == [len((t or "").split()) for t in text]


def test_winnowing_chooses_the_first_smallest():
    r = np.random.default_rng(3)
    for n, wide in ((1, 12), (5, 12), (12, 12), (200, 12), (200, 8), (90, 1)):
        grams = r.integers(0, 50, n).astype(np.uint64) << np.uint64(40)
        view = np.lib.stride_tricks.sliding_window_view(grams, min(wide, n))
        assert shingles.winnowed(grams, wide).tolist() == np.unique(view.argmin(1) + np.arange(len(view))).tolist()


def test_chain_is_the_best_ordered_one():
    r = random.Random(5)
    for _ in range(30):
        anchors = sorted({(r.randrange(60), r.randrange(60)) for _ in range(14)})
        pos, rpos = (np.array(c) for c in zip(*anchors))
        best = [substring_dedup.SEED_GAIN] * len(anchors)
        for i, (x, y) in enumerate(anchors):
            for j, (u, v) in enumerate(anchors):
                if u < x and v < y:
                    best[i] = max(best[i], best[j] + substring_dedup.SEED_GAIN - substring_dedup.GAP_COST * (x - u + y - v - 2))
        x0, x1, y0, y1 = substring_dedup.chain(pos, rpos, 0)[0]
        assert math.isclose(max(best), best[anchors.index((x1, y1))]) and x0 <= x1 and y0 <= y1


def test_common_words():
    r = np.random.default_rng(1)
    for _ in range(20):
        x, y = r.integers(0, 6, 30).astype(np.uint64), r.integers(0, 6, 25).astype(np.uint64)
        t = np.zeros((31, 26), int)
        for i in range(30):
            for j in range(25):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        assert substring_dedup.common_words(x, y) == t[-1, -1]


# ---------------------------------------------------------------- 2 n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def test_jaccard_join_against_brute_force(spark):
    r = random.Random(9)
    rows = []
    for base in range(12):
        n = r.choice([3, 5, 6, 7, 8, 9, 11, 14, 20, 60])
        text = prose(base, n).split()
        for _ in range(9):
            own = list(text)
            for _ in range(r.randrange(0, 1 + max(1, n // 9))):
                own[r.randrange(len(own))] = r.choice(WORDS)
            if r.random() < 0.3:
                own = own[: max(1, len(own) - r.randrange(3))]
            rows.append((len(rows), " ".join(own)))
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_keeps_a_group_of_near_copies_whole(spark):
    text = prose(77, 80).split()
    rows = [(0, " ".join(text))]
    for k in range(1, 150):
        own = list(text)
        for j in range(1 + k % 4):
            own[(7 * k + 23 * j) % 80] = f"edit{k}x{j}"
        rows.append((k, " ".join(own)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_of_a_large_group_around_the_limit(spark, monkeypatch):
    # copies with random edits lie on both sides of the limit; blocks of few sets make many meetings
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 16)
    r, text, rows = random.Random(31), prose(78, 100).split(), []
    for k in range(260):
        own = list(text)
        for at in r.sample(range(100), 2 + k % 3):
            own[at] = f"new{k}x{at}"
        rows.append((k, " ".join(own)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = brute_components(rows)
    assert got == wanted and 20 < len({c for _, c in wanted.values()}) < 250


def test_spanning_links_join_what_links_join():
    r, rule = np.random.default_rng(5), jaccard_join.Rule()
    base = [np.unique(r.integers(0, 2**63, 40).astype(np.uint64)) for _ in range(6)]
    sets = []
    for k in range(80):
        own = base[k % 6].copy()
        own[r.choice(len(own), int(r.integers(0, 9)), replace=False)] = r.integers(0, 2**63, 1).astype(np.uint64)
        sets.append(np.unique(own))
    ids, both = np.arange(80), np.ones(80, bool)
    for component in (ids, ids // 3):
        found = jaccard_join.spanning_links(rule, 4, ids, component, sets, both, both)
        wanted = [(a, b) for a in range(80) for b in range(a) if component[a] != component[b] and rule.links(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])))]

        def classes(links):
            label = component.copy()
            for a, b in links:
                label[label == label[a]] = label[b]
            return {tuple(np.flatnonzero(label == x)) for x in label}

        assert classes(found) == classes(wanted) and len(found) < len(set(component.tolist())) and wanted


def test_jaccard_join_edges(odd):
    rows = [(x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard_join.near_duplicates(odd).collect()]
    got = {d: (n, c) for d, n, c in rows}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[8] == (0, 8) and got[None] == (86, None)
    assert got[3][1] == got[4][1] == got[2][1] == 2 and got[6] == (1, 5) and len(rows) == 14
    assert jaccard_join.near_duplicates(odd.limit(0)).count() == 0


def test_boundary_grows_with_list_length():
    rule = jaccard_join.Rule()
    few, many = (jaccard_join.choose_boundary({s: 10 for s in range(1, 13)}, x, rule) for x in (1.0, 500.0))
    assert few < many <= jaccard_join.LIGHT_MOST


# ---------------------------------------------------------------- 3 line dedup


def test_line_dedup_edges_and_both_routes(odd):
    held = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect()}
    routed = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd, broadcast_bytes=-1).collect()}
    assert held == routed
    assert (held[0]["n_lines"], held[0]["n_dropped"], held[0]["kept_text"]) == (1, 0, "")
    assert held[11]["n_dropped"] == 0 and held[12]["n_dropped"] == 1 and held[12]["kept_text"] == ""
    assert held[3]["n_dropped"] == 1 and held[None]["n_dropped"] == 1 and held[2]["n_dropped"] == 0
    assert held[2]["kept_sha256"] == hashlib.sha256(held[2]["kept_text"].encode()).hexdigest()
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    pairs = np.random.default_rng(3).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    index = line_dedup.PerfectHash.build(pairs)
    assert sorted(index.slots(pairs).tolist()) == list(range(5000))
    others = np.random.default_rng(4).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    assert index.slots(others).max() < 5000


# ---------------------------------------------------------------- 4 mixing


def test_mixing_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = mixing.mix(docs, target_entropy=0.97, max_repeats=1.0).collect()
    assert len(rows) == docs.count()
    tokens, weight, drawn = Counter(), {}, Counter()
    for r in rows:
        n = len((r["text"] or "").encode().split())
        assert n == r["n_tokens"]
        tokens[r["source"]] += n
        weight[r["source"]] = r["weight"]
        drawn[r["source"]] += n * r["copies"]
    whole = sum(tokens.values())
    entropy = -sum(w * math.log(w) for w in weight.values())
    assert math.isclose(sum(weight.values()), 1, rel_tol=1e-9) and entropy >= 0.97 * math.log(len(weight)) - 1e-9
    low, high = 0.0, 1.0
    for _ in range(60):  # plain bisection
        a = (low + high) / 2
        u = {s: (t / whole) ** a for s, t in tokens.items()}
        z = sum(u.values())
        low, high = (a, high) if -sum(x / z * math.log(x / z) for x in u.values()) >= 0.97 * math.log(len(u)) else (low, a)
    u = {s: (t / whole) ** low for s, t in tokens.items()}
    z = sum(u.values())
    assert all(math.isclose(weight[s], u[s] / z, rel_tol=1e-3) for s in u)
    budget = whole * min(1.0, 1 / max(u[s] / z * whole / tokens[s] for s in u))
    largest = max(r["n_tokens"] for r in rows)
    assert all(budget * weight[s] * 0.999 - 1 <= drawn[s] <= budget * weight[s] * 1.001 + largest for s in u)


def test_mixing_repeats_and_limit(spark):
    rows = [(i, "a b c d", "big" if i < 900 else "small") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, target_entropy=None, max_repeats=3.0)
    by = {r["source"]: r["copies"] for r in out.groupBy("source").agg(F.sum("copies").alias("copies")).collect()}
    assert 280 <= by["small"] <= 301 and 690 <= by["big"] <= 725
    assert out.filter("source = 'small'").agg(F.max("copies")).first()[0] == 3


@pytest.mark.parametrize("share, repeats", [(1.0, 2.0), (1.0, 1.0), (0.5, 1.0)])
def test_a_tiny_or_null_source_lowers_no_other(spark, share, repeats):
    even = [(i, "a b c d", f"s{i % 10}" if i < 1000 else "hot") for i in range(1600)]
    tiny = [*even, (5000, "a b", "tiny"), (5001, "a", None), (5002, "a b c", None)]
    drawn = []
    for rows in (even, tiny):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = mixing.mix(docs, target_entropy=0.98, max_repeats=repeats, budget_share=share, fill=True)
        drawn.append({r["source"]: (r["n"], r["most"]) for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n"), F.max("copies").alias("most")).collect()})
    assert all(most <= repeats for _, most in drawn[1].values())
    wanted = share * sum(len(t.split()) for _, t, _ in tiny)
    assert abs(sum(n for n, _ in drawn[1].values()) - wanted) <= 4 * 13
    small = {s: n for s, (n, _) in drawn[1].items() if s in ("tiny", None)}
    assert small == {"tiny": 2 * repeats, None: 4 * repeats}
    # another exponent reaches the entropy of more sources; all in all the others lose what the small ones have
    others = [sum(n for s, (n, _) in d.items() if s not in small) for d in drawn]
    assert others[1] >= others[0] - 100


def test_blocks_in_super_blocks_draw_the_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    monkeypatch.setattr(mixing, "SUPER_BLOCKS", 4)
    rows = [(i, " ".join("w" * (1 + i % 5)), ("hot" if i % 3 else f"s{i % 4}")) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, target_entropy=0.9, max_repeats=1.0, budget_share=0.5, fill=True).collect()
    for source in {r["source"] for r in got}:
        own = sorted((r for r in got if r["source"] == source), key=lambda r: r["draw"])
        assert len({r["draw"] for r in own}) == len(own)
        taken = [r["copies"] for r in own]
        assert taken == sorted(taken, reverse=True)  # a prefix of the permuted order
    drawn = sum(r["copies"] * r["n_tokens"] for r in got)
    assert abs(drawn - 0.5 * sum(r["n_tokens"] for r in got)) <= 5 * 5


def test_exponent_is_bisected_to_the_float(spark):
    totals = spark.createDataFrame([("a", 5, 900_000), ("b", 5, 90_000), ("c", 5, 10_000)], "source string, docs long, tokens long")
    found, _ = mixing.find_exponent(totals, target_entropy=0.8, max_repeats=100.0, budget=1e6)
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        u = [x**a for x in (0.9, 0.09, 0.01)]
        h = -sum(x / sum(u) * math.log(x / sum(u)) for x in u)
        low, high = (a, high) if h >= 0.8 * math.log(3) else (low, a)
    assert abs(found - low) < 1e-10


def test_mixing_edges(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r["copies"] == 1 for r in rows if r["n_tokens"] == 0)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- 5 exact dedup


def test_exact_dedup_edges(odd):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_exact(odd).collect()), key=str)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 14 and by[0] == (1, 2, False) and by[1] == (1, 2, True) and by[2] == (3, 3, False) and by[3] == (3, 3, True) and by[None] == (None, 1, True)
    assert exact_dedup.dedup_exact(odd.limit(0)).count() == 0


def test_chunk_hashes_compose():
    data = random.Random(2).randbytes(200_000)
    whole = exact_dedup.chunk_hash(data)
    for cut in (0, 1, 99_999, 200_000):
        a, b = exact_dedup.chunk_hash(data[:cut]), exact_dedup.chunk_hash(data[cut:])
        for k in (0, 1):
            assert (a[k] * b[k + 2] + b[k]) % exact_dedup.PRIMES[k] == whole[k]
    slow = 0
    for byte in data[:5000]:
        slow = (slow * exact_dedup.BASES[0] + byte) % exact_dedup.PRIMES[0]
    assert exact_dedup.chunk_hash(data[:5000])[0] == slow


def test_chunks_of_one_long_text_are_hashed_in_several_tasks(spark):
    text = "abcdefghij" * 5000
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[:-1] + "x"), (4, "short"), (4, "short")], "doc_id long, text string").coalesce(1)
    assert "REPARTITION_BY_COL" in exact_dedup.fingerprints(docs, 1000)._jdf.queryExecution().toString()
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_exact(docs, chunk=1000).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 2, True)}


def test_exact_dedup_in_small_chunks_and_under_collisions(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = sorted(map(tuple, exact_dedup.dedup_exact(docs).collect()))
    assert sorted(map(tuple, exact_dedup.dedup_exact(docs, chunk=1000).collect())) == wanted
    same = exact_dedup.fingerprints
    # every fingerprint collides within a length class: the comparison must part them
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d, c: same(d, c).withColumns({"f1": F.lit(1).cast("long"), "f2": F.col("f2") % 2, "n_bytes": F.lit(7).cast("long")}))
    some = docs.filter("doc_id < 40").unionByName(docs.filter("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.dedup_exact(some).collect()}
    texts = defaultdict(list)
    for r in some.collect():
        texts[r["text"]].append(r["doc_id"])
    assert got == {d: (max(ids), len(ids)) for ids in texts.values() for d in ids}


# ---------------------------------------------------------------- 6 toxicity, 10 quality


@pytest.mark.parametrize("name,label,least", [("op6_toxicity", "toxic", 0.93), ("op10_quality", "quality", 0.97)])
def test_classifier_on_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES[name](spark, sf).join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r[label] for r in rows]) >= least
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_held_out_rows_by_crc(spark):
    rows = spark.range(200).select("id", quality.held_out(5, 0, "id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_lexicon_features_against_a_plain_count(monkeypatch):
    lexicon = {b"grobian": 5.0, b"4:zwie": 3.0, b"5:klotz": 2.5, b"lump": 4.5}
    r = random.Random(12)
    pool = ["Grobian", "gr0b1an", "zwiebel", "ZWIELICHT", "klotzig", "klotz", "lump", "l*ump", "LUMP!", "you", "your", "Dir", "plain", "word,", "caf\u00e9", "x9", "end.", "why?", "\n", "a;b:c", "12", "SHOUT"]
    texts = ["", " ", "you", *(" ".join(r.choices(pool, k=r.randrange(1, 80))) for _ in range(120))]

    def odds(word):
        return max([lexicon.get(word, 0.0), *(lexicon.get(b"%d:" % n + word[:n], 0.0) for n in (4, 5) if len(word) > n)])

    def plain(text):
        data = text.encode()
        words, run = [], b""
        for byte in [*data.lower(), 32]:
            if chr(byte).isascii() and not chr(byte).isalnum():
                words += [run] if run else []
                run = b""
            else:
                run += bytes([byte])
        many, size, raw = len(words) or 1, len(data) or 1, data.split()
        hits = [(i, odds(w)) for i, w in enumerate(words) if odds(w)]
        second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
        mixed = hidden = 0
        for token in data.lower().split():
            inner = [k for k in range(1, len(token) - 1) if token[k : k + 1] in [bytes([b]) for b in b"0123456789@$!|*"]]
            letters = [k for k in range(len(token)) if chr(token[k]).isascii() and chr(token[k]).isalpha()]
            if any(a + 1 < b and all(k in inner for k in range(a + 1, b)) for a in letters for b in letters if a < b):
                shown = token.translate(bytes.maketrans(b"013457@$!|", b"oieastasil")).replace(b"*", b"")
                if shown.isalpha():
                    mixed += 1
                    hidden += odds(shown) > 0
        share = lambda found, of: found / of
        return [
            len(hits), share(len(hits), many), share(sum(o > 4 for _, o in hits), many), share(sum(words[i] not in lexicon for i, _ in hits), many), share(hidden, many),
            min(60, sum(o for _, o in hits)), max((o for _, o in hits), default=0), share(len(second), many),
            share(sum(any(abs(i - k) <= toxicity.NEAR for k in second) for i, _ in hits), many), share(sum(65 <= b <= 90 for b in data), size),
            share(sum(len(w) > 2 and w.isupper() for w in raw), len(raw) or 1), share(sum(b in b"!?" for b in data), size), share(sum(b in b".,;:" for b in data), size), share(mixed, many), math.log(1 + len(words)),
        ]

    for remembered in (300_000, 0):
        monkeypatch.setattr(toxicity, "REMEMBERED", remembered)
        memory = {}
        for text in texts:
            got = toxicity.features(text, lexicon, memory)
            assert len(got) == len(toxicity.FEATURES) and np.allclose(got, plain(text)), text


def test_calibration_is_interpolated(spark):
    at, value = [-2.0, -0.5, 0.0, 3.0], [0.1, 0.1, 0.6, 0.9]
    xs = [-9.0, -2.0, -1.0, -0.5, -0.2, 0.0, 1.5, 3.0, 8.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", toxicity._between(F.col("x"), at, value).alias("y")).collect()
    assert all(math.isclose(r["y"], np.interp(r["x"], at, value)) for r in rows)


def test_boosting_steps_are_the_best_cuts():
    r = np.random.default_rng(21)
    worth = lambda g, h: g * g / (h + 1)
    for n in (1, 2, 3, 7, 12):
        g, h = r.normal(size=n), r.uniform(0.6, 2, size=n)
        spans = [(0, n)]
        for _ in range(2):  # greedy: the cut of most gain, in any span
            cuts = [(worth(g[a:k].sum(), h[a:k].sum()) + worth(g[k:b].sum(), h[k:b].sum()) - worth(g[a:b].sum(), h[a:b].sum()), a, k, b) for a, b in spans for k in range(a + 1, b)]
            if not cuts or max(cuts)[0] <= 1e-9:
                break
            _, a, k, b = max(cuts)
            spans = [s for s in spans if s != (a, b)] + [(a, k), (k, b)]
        wanted = np.zeros(n)
        for a, b in spans:
            wanted[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
        assert np.allclose(quality._table_step(g, h), wanted)
    for shape in ((2, 2), (3, 5), (6, 4)):
        g, h = r.normal(size=shape), r.uniform(0.6, 2, size=shape)
        quads = lambda i, j: [(rows, cols) for rows in (slice(0, i), slice(i, None)) for cols in (slice(0, j), slice(j, None))]
        gain, i, j = max((sum(worth(g[q].sum(), h[q].sum()) for q in quads(i, j)), i, j) for i in range(1, shape[0]) for j in range(1, shape[1]))
        wanted = np.zeros(shape)
        for q in quads(i, j):
            wanted[q] = g[q].sum() / (h[q].sum() + 1)
        step, got = quality._pair_step(g, h)
        assert np.allclose(step, wanted) and math.isclose(got, gain)


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(9)
    edges, coarse = [np.sort(r.normal(size=n)) for n in (3, 5, 1)], [np.sort(r.normal(size=2)) for _ in range(3)]
    tables, double = [r.normal(size=len(e) + 1) for e in edges], {(0, 2): r.normal(size=(3, 3)), (1, 2): r.normal(size=(3, 3))}
    x = np.concatenate([r.normal(size=(40, 3)), [[edges[0][1], edges[1][0], coarse[2][0]]]])  # one row lies on edges
    bin_ = lambda cuts, v: sum(1 for c in cuts if c <= v)
    got = quality.Model(edges, coarse, 0.3, tables, double).scores(x)
    for row, score in zip(x, got):
        total = 0.3 + sum(t[bin_(e, v)] for t, e, v in zip(tables, edges, row))
        total += sum(t[bin_(coarse[a], row[a]), bin_(coarse[b], row[b])] for (a, b), t in double.items())
        assert math.isclose(score, 1 / (1 + math.exp(-total)))


@pytest.mark.parametrize("classify", [quality.classify, toxicity.classify])
def test_classifier_edges(odd, labels, classify):
    for own in (labels, labels.limit(0)):
        rows = classify(odd, own).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert classify(odd.limit(0), labels).count() == 0


def test_quality_filter_keeps_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("x", F.lit(1))
    kept = quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


# ---------------------------------------------------------------- 7 packing, 9 token output


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary(name))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_against_the_library(spark, sf_dir):
    rows = queries.op7_best_fit_packing(spark, sf_dir).collect()
    encode_ = library("word_bpe_49k.json")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    wanted, lengths = {}, []
    for d, t in texts.items():
        ids = encode_(t)
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            wanted[d, k] = (a, len(part), crc(part))
            lengths.append(len(part))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == wanted
    check_sequences(rows, lengths)


def check_sequences(rows, lengths):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    gaps = []  # best fit, longest first, one by one
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(2048 - n)
    assert len(sequences) == len(gaps)


def test_runs_are_best_fit():
    r = random.Random(4)
    for _ in range(40):
        lengths = [r.randrange(1, 60) for _ in range(300)]
        runs = packing.best_fit_runs(Counter(lengths), 64)
        assert sum(b - a for _, a, b, *_ in runs) == 300
        gaps = []
        for n in sorted(lengths, reverse=True):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(64 - n)
        assert 1 + max(s + (b - a - 1) // e for _, a, b, s, e, _ in runs) == len(gaps)


def best_fit_gaps(lengths, capacity):
    """The gaps that best fit leaves, longest first, piece by piece."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return gaps


@pytest.mark.parametrize("most, hot", [(100, 0), (40, 0), (9, 500), (100, 500)])
def test_rounds_of_range_sweeps_are_best_fit(spark, most, hot):
    r = random.Random(most + hot)
    lengths = [r.randrange(1, most + 1) for _ in range(400)] + [most // 3] * hot
    counts = spark.createDataFrame(sorted(Counter(lengths).items()), "length long, n long")
    runs = packing.best_fit_rounds(counts, 100).collect()
    ranks, places = defaultdict(list), defaultdict(list)
    for length, first, last, sequence, each, offset in runs:
        for rank in range(first, last):
            ranks[length].append(rank)
            at = rank - first
            places[sequence + at // each].append((offset + at % each * length, length))
    assert {n: sorted(k) for n, k in ranks.items()} == {n: list(range(k)) for n, k in Counter(lengths).items()}
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    assert len(places) == len(best_fit_gaps(lengths, 100))
    assert sorted(places) == list(range(len(places)))


def test_a_sweep_leaves_what_has_no_successor():
    runs, pieces, gaps, number = packing.sweep([(9, 0, 2), (5, 0, 5)], [(6, 0, 1), (10, 1, 3)], 20)
    assert pieces == [(5, 1, 5)] and number is None
    assert sorted(runs) == [(5, 0, 1, 0, 1, 14), (9, 0, 2, 1, 1, 10)]
    assert sorted(gaps) == [(1, 0, 1), (1, 1, 3)]
    assert packing.class_bounds(2048)[:2] == [(1025, 2048), (513, 1024)] and packing.class_bounds(5) == [(3, 5), (2, 2), (1, 1)]


def test_packing_edges(odd):
    rows = packing.pack(odd, queries.vocabulary("word_bpe_49k.json")).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
    check_sequences(rows, [r["length"] for r in rows])
    assert packing.pack(odd.limit(0), queries.vocabulary("word_bpe_49k.json")).count() == 0


def test_token_output_round_trip(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    token_output.write_tokens(docs, str(tmp_path / "out"), queries.vocabulary("byte_bpe_50k.json"))
    encode_, at, wanted = library("byte_bpe_50k.json"), 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = encode_(r["text"])
        wanted[r["doc_id"]] = (at, len(ids), crc(ids))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(spark, str(tmp_path / "out")).collect()}
    assert got == wanted
    few = token_output.read_documents(spark, str(tmp_path / "out"), [3, 77]).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in few} == {d: encode_(docs.filter(F.col("doc_id") == d).first()["text"]) for d in (3, 77)}


def test_token_output_edges(odd, spark, tmp_path):
    token_output.write_tokens(odd, str(tmp_path / "a"), queries.vocabulary("byte_bpe_50k.json"))
    rows = token_output.read_tokens(spark, str(tmp_path / "a")).collect()
    assert len(rows) == odd.count() and min(r["start"] for r in rows) == 0 and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    token_output.write_tokens(odd.limit(0), str(tmp_path / "b"), queries.vocabulary("byte_bpe_50k.json"))
    assert token_output.read_tokens(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoding_by_words_equals_the_library(name):
    from tokenizers import Tokenizer

    e, r, fresh = encode.PieceEncoder(queries.vocabulary(name)), random.Random(6), Tokenizer.from_file(queries.vocabulary(name))
    assert e.cut and list(np.frombuffer(e.encode("a <|endoftext|> b"), "<u4")) == fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids
    pool = ["the", "Straße", "it's", "we'LL", "don't", "x'd", " ", "  ", "\n", "\t", " \n ", "!!", "...", "12345", "½²", "É", "naïve", "µ", "ª", "日本", "é", " ", "\u0085", "<|endoftext|>", "İ", "Σς", "-", "'", "a_b", "😀", "\x1f", "\x00", "¿", "ﬁ"]
    for _ in range(3000):
        text = "".join(r.choice(pool) for _ in range(r.randrange(12)))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoding_under_another_form_goes_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(queries.vocabulary("byte_bpe_50k.json"), encoding="utf-8") as file:
        told = json.load(file)
    told["pre_tokenizer"]["add_prefix_space"] = True
    (path := tmp_path / "other.json").write_text(json.dumps(told))
    e = encode.PieceEncoder(str(path))
    assert e.cut is None and np.frombuffer(e.encode("the cat"), "<u4").tolist() == Tokenizer.from_file(str(path)).encode("the cat", add_special_tokens=False).ids


def test_tokens_of_documents_with_added_tokens(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|>", "plain", "<|startoftext|>x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encode_, at, wanted = library("byte_bpe_50k.json"), 0, {}
    for d, t in enumerate(texts):
        wanted[d] = (at, len(encode_(t)), crc(encode_(t)))
        at += len(encode_(t))
    token_output.write_tokens(docs, str(tmp_path / "x"), queries.vocabulary("byte_bpe_50k.json"))
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.read_tokens(spark, str(tmp_path / "x")).collect()} == wanted
    encode_ = library("word_bpe_49k.json")
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs, queries.vocabulary("word_bpe_49k.json")).collect()} == {d: (len(encode_(t)), crc(encode_(t))) for d, t in enumerate(texts)}


# ---------------------------------------------------------------- 8 exact top-k


def test_top_k_edges(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=6).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(40)] + [(1, [9.0] * 6)][:0]
    rows += [(2000, None), (2050, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (None, [1.0] * 6), (2200, [1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in mtree.top_k(docs).collect())
    own = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows[:340]}
    wanted = []
    for q in sorted(i for i in own if i % 50 == 0):
        best = sorted(((-int(own[q] @ v), i) for i, v in own.items() if i != q))[:5]
        wanted += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(wanted)
    assert mtree.top_k(docs.limit(0)).count() == 0
    assert mtree.top_k(docs.filter("vec_id = 50")).count() == 0


def _wanted(rows, k=5):
    """Brute force in Python's whole numbers."""
    own, out = {i: [math.floor(256 * x) for x in v] for i, v in rows}, []
    for q in (i for i in own if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def _answers(spark, rows):
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in mtree.top_k(docs).collect())


def test_top_k_of_large_components_is_exact(spark):
    r = np.random.default_rng(18)
    rows = [(i, r.normal(size=6)) for i in range(160)]
    rows[7] = (7, np.array([2e6, 1, -3, 0.5, 2, 1]))
    assert _answers(spark, rows) == _wanted(rows)
    rows = [(i, r.normal(size=6) * 3e5) for i in range(160)]  # beyond 2^53
    assert _answers(spark, rows) == _wanted(rows)
    with pytest.raises(Exception, match="64 bits"):
        _answers(spark, [(0, [1e300]), (1, [1.0])])
    with pytest.raises(Exception, match="64 bits"):
        _answers(spark, [(0, [1e12, 1.0]), (1, [1e12, 2.0])])


def test_top_k_over_many_pages(spark, monkeypatch):
    for name, value in (("CELL", 24), ("FANS", 5), ("LEAF", 4), ("MET", 7)):
        monkeypatch.setattr(mtree, name, value)
    r = np.random.default_rng(28)
    rows = [(i, r.normal(r.integers(0, 3) * 4, 1, size=4)) for i in range(900)]
    rows += [(900 + i, rows[i % 7][1]) for i in range(150)]  # equal vectors and ties
    assert _answers(spark, rows) == _wanted(rows)


def test_tree_bounds_hold_and_save_work():
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(c, 3, size=(300, 5)) for c in (0, 60, -60)]).round().astype(np.int64)
    lift = mtree.Lift(5, float((v * v).sum(1).max()), int(abs(v).max()))
    import pandas as pd

    frame = pd.DataFrame({"v": v.tolist(), "ids": [[i] for i in range(900)], "h": range(900)})
    cell = mtree.Cell(mtree._plant(lift.norm2)((1,), frame).iloc[0].to_dict(), lift)
    own, work = np.arange(0, 900, 90), 0
    for block in (own, *own[:, None]):
        out, computed = cell.search(v[block], block, 5, np.full(len(block), -np.inf))
        work += computed
        for q in block.tolist():
            wanted = sorted(((int(v[q] @ v[i]), -i) for i in range(900) if i != q), reverse=True)[:5]
            assert sorted(((s, -i) for o, i, s in out if o == q), reverse=True)[:5] == wanted
    assert work < 2 * 9 * 900


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        seen.append((name, docs.count(), out.count()))
        if name == "exact":
            assert out.count() == docs.select("text").distinct().count()
        if name == "near":
            groups = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
            assert {r["doc_id"] for r in out.collect()} == {c for _, c in groups.values()}
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            check_sequences(out.collect(), [r["length"] for r in out.collect()])
        else:
            assert out.columns == docs.columns
        docs = out
    assert [s[0] for s in seen] == ["quality", "exact", "near", "mixing", "packing"] and all(b > 0 for _, _, b in seen)


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        pieces = corpus_pipeline.packing(spark, docs, "").collect()
        assert sorted({str(r["doc_id"]) for r in pieces}) == sorted({str(r["doc_id"]) for r in docs.select("doc_id").collect()})
        check_sequences(pieces, [r["length"] for r in pieces])
    exact = [r["doc_id"] for r in corpus_pipeline.exact(spark, odd, "").collect()]
    assert sorted(exact, key=str) == sorted([1, 3, 4, 5, 6, 7, None, 8, 9, 10, 11, 12], key=str)


def test_the_mixing_stage_draws_its_budgets(spark):
    """Kept tokens of each source are its budget within one document; large sources lose documents, small ones come twice."""
    import corpus_pipeline as p

    rows = [(i, "w " * (1 + i % 7), "hot" if i % 3 == 0 else f"s{i % 23}") for i in range(3000)] + [(9000 + i, "w w", "tiny") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = p.mixing(spark, docs, "").collect()
    size: dict = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    whole = sum(size.values())

    def weights(a):
        u = {s: (n / whole) ** a for s, n in size.items()}
        return {s: x / sum(u.values()) for s, x in u.items()}

    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    low, high = 0.0, 1.0
    for _ in range(80):
        a = (low + high) / 2
        low, high = (a, high) if entropy(weights(a)) >= p.TARGET_ENTROPY * math.log(len(size)) else (low, a)
    share, clipped = weights(low), set()
    while True:  # sources over their passes are clipped, the others share what is freed
        free = p.BUDGET_SHARE * whole - sum(p.MAX_REPEATS * size[s] for s in clipped)
        rest = sum(w for s, w in share.items() if s not in clipped)
        budget = {s: p.MAX_REPEATS * size[s] if s in clipped else free * w / rest for s, w in share.items()}
        if not (over := {s for s in budget if budget[s] > p.MAX_REPEATS * size[s]}):
            break
        clipped |= over
    drawn = {s: sum(len(r["text"].split()) for r in out if r["source"] == s) for s in size}
    assert all(abs(drawn[s] - budget[s]) <= 7 + 1 for s in size)
    times = {}
    for r in out:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert drawn["tiny"] == 2 * size["tiny"] and max(times.values()) == 2
    assert len({r["doc_id"] for r in out if r["source"] == "hot"}) < 0.8 * sum(s == "hot" for _, _, s in rows)
