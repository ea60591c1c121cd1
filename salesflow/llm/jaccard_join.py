"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a size-aware heavy-light join.

Exact: two documents link when 100 * |A & B| >= 75 * |A | B| (both numbers are parameters). Sets are of
64-bit shingle hashes. Documents with equal sets form one class; classes are joined.

Filter. Two linked sets share many of their smallest hashes, so each set sends its `prefix` of them,
and only classes with enough prefix hashes that another class holds can link: the rest, most of a
corpus, leave. Each task combines the classes of a hash before the shuffle (two witnesses a hash),
so that a very common shingle stays small.

Join of what is left. Light sets (up to a boundary) enumerate their fixed-size subsets: sets that may
link share a subset as large as their intersection, and of all that hold a subset the smallest
set links first. Heavy sets scan inverted lists of their rarest shingles. The boundary is the size
at which enumeration costs more than scanning, from the measured sizes and list lengths. Before
the lists are scanned, verified links to the pivots of min-hash groups merge copies into
components. Lists that begin with the same set are scanned together, in blocks of bounded size: there
each heavy set counts what it shares with the sets of other components, and a block sends on only
verified links that join components, fewer than its sets, so a group of near copies is never expanded into
pairs, and no link between different components is lost. Blocks of one component do not meet.

Defined results: null or empty text has an empty set and no link; rows repeated under one doc_id with the
same set are one document, with other sets one for each set; a null doc_id links with nothing and has a
null component; equal sizes and scores need no order, as every link counts; a very long text is one set in its task, of as many
hashes as it has shingles; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm.common import drop, in_parts, made, saved, settled, ship, slices, whole_text
from salesflow.llm.components import components
from salesflow.llm.shingles import mixed, shingle_sets

#: Shingles that a task combines before it sends them on.
HELD = 1_500_000
#: Fewest partitions of the prefix hashes.
LEAST_PARTITIONS = 96
#: Min-hashes of a round that merges copies; another round follows while one finds links for this part of the sets.
PIVOT_HASHES, WORTHWHILE = 6, 0.01
#: Sets, and hashes, of a block: two of them meet at once.
BLOCK_SETS, BLOCK_HASHES = 1024, 1 << 20
#: Bits of a set's parity map.
MAP_BITS = 1024
#: Largest size that the choice of the boundary considers.
LIGHT_MOST = 12


class Rule:
    """num * |A | B| <= den * |A & B|, and what follows from it."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den

    def least(self, size):
        """The smallest overlap, and the smallest size, of any set linked to one of this size."""
        return -(-self.num * size // self.den)

    def links(self, a, b, both):
        return self.den * both >= self.num * (a + b - both)

    def marks(self, size):
        """Prefix hashes by which a set must be known to others."""
        return 1 + size // 8

    def prefix(self, size):
        return size - self.least(size) + self.marks(size)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(own.tobytes())
    return tuple(np.frombuffer(d, "<i8").tolist())


def _sets(k: int, with_set: bool):
    """doc_id, n, s1, s2 (and the set's bytes) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch):
                rows, out = batch.slice(first, last - first), []
                for doc, own in zip(rows.column("doc_id").to_pylist(), shingle_sets(rows.column("text"), k)):
                    out.append((doc, len(own), *_fingerprint(own)) + ((own.tobytes(),) if with_set else ()))
                names = ["doc_id", "n", "s1", "s2"] + ["hashes"] * with_set
                types = [pa.int64()] * 4 + [pa.binary()] * with_set
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def _combined(groups: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (h, g, credit): each distinct hash keeps two witnesses at most; groups that met another
    one here get credits (credit > 0, sent to the partition of the group's own number)."""
    order = np.lexsort((groups, hashes))
    h, g = hashes[order], groups[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    h, g = h[fresh], g[fresh]
    start = np.ones(len(h), bool)
    start[1:] = h[1:] != h[:-1]
    end = np.ones(len(h), bool)
    end[:-1] = start[1:]
    own, credit = np.unique(g[~(start & end)], return_counts=True)
    # a witness of a hash that is shared here was credited here: it is sent as known
    send = start | end
    known = (~(start & end))[send]
    rows_h = np.concatenate([h[send], own])
    rows_g = np.concatenate([g[send], own])
    return rows_h, rows_g, np.concatenate([np.where(known, -1, 0), credit])


def _send(rule: Rule, k: int):
    """(h, g, credit) of the prefixes of the texts' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def told() -> pa.RecordBatch:
            h, g, c = _combined(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            return pa.RecordBatch.from_arrays([_signed(h), _signed(g), pa.array(c.astype(np.int64))], ["h", "g", "credit"])

        for own in _text_sets(batches, k):
            group = _fingerprint(own)[0]
            part = own[: rule.prefix(len(own))]
            held.append((np.full(len(part), group, np.int64).view(np.uint64), part))
            many += len(part)
            if many >= HELD:
                yield from in_parts(told())
                held, many = [], 0
        if held:
            yield from in_parts(told())

    return run


def _text_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for first, last in slices(batch):
            for own in shingle_sets(batch.slice(first, last - first).column("text"), k):
                if len(own):
                    yield own


def _credit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, g): a group not yet credited gets one for each hash that another group holds."""
    tail: np.ndarray | None = None
    count: dict[int, int] = {}

    def settle(x: np.ndarray, last: bool) -> np.ndarray:
        """Credits of whole runs; returns the open run's rows (two of them are enough)."""
        cut = len(x) if last else int(np.searchsorted(x[:, 0], x[-1, 0], "left"))
        done = x[:cut]
        if len(done):
            h, g, c = done.T
            start = np.ones(len(h), bool)
            start[1:] = h[1:] != h[:-1]
            run = np.cumsum(start) - 1
            low = g[start]
            high = g[np.append(np.flatnonzero(start)[1:] - 1, len(g) - 1)]
            shared = (low != high)[run]
            # a group may come from several tasks: credit it once for a hash, and not if a task did
            same = np.zeros(len(h), bool)
            same[1:] = ~start[1:] & (g[1:] == g[:-1])
            begin = ~same
            piece = np.cumsum(begin) - 1
            done_before = np.zeros(piece[-1] + 1, bool)
            np.logical_or.at(done_before, piece, c == -1)
            for group in g[begin & shared & ~done_before[piece]].tolist():
                count[group] = count.get(group, 0) + 1
        return x[cut:]

    for batch in batches:
        x = np.stack([batch.column(c).to_numpy() for c in ("h", "g", "credit")], 1)
        given = x[:, 2] > 0
        for group, credit in x[given][:, 1:].tolist():
            count[group] = count.get(group, 0) + credit
        x = x[~given]
        if len(x):
            tail = settle(x if tail is None or not len(tail) else np.concatenate([tail, x]), False)
        if len(count) > 100_000:
            yield _counts(count)
            count = {}
    if tail is not None and len(tail):
        settle(tail, True)
    if count:
        yield _counts(count)


def _counts(count: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], ["g", "known"])


def _known(texts: DataFrame, rule: Rule, k: int) -> DataFrame:
    """g, known: how many of a class's prefix hashes another class holds too, or more: a class whose
    copies lie in several tasks may be credited in each, which lets in more and loses none."""
    sent = texts.mapInArrow(_send(rule, k), "h long, g long, credit long")
    # more, smaller partitions than usual: each holds the sorted rows of many hashes
    parts = max(LEAST_PARTITIONS, 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = sent.repartition(parts, "h").sortWithinPartitions("h", "g")
    return runs.mapInArrow(_credit, "g long, known long").groupBy("g").agg(F.sum("known").alias("known"))


def _verify(rule: Rule):
    """The pairs (a, b) whose stored sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("a_set"), batch.column("b_set"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if rule.least(max(len(x), len(y))) > min(len(x), len(y)):
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                good[i] = rule.links(len(x), len(y), int((x[at] == y).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of set numbers, read with both sets and compared; b may be hot: Spark splits its join."""
    own = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("a_set"))
    other = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("b_set"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", "a_set", "b_set").mapInArrow(_verify(rule), "a long, b long")


def _min_hashes(seeds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [[int(mixed(np.frombuffer(x.as_buffer(), np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (r + 1) % 2**64)).min().view(np.int64)) for r in seeds] for x in batch.column("hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("component"), pa.array(keys, pa.list_(pa.int64()))], ["cid", "component", "keys"])

    return run


def _pivot_links(sets: DataFrame, rule: Rule, seeds: list[int]) -> DataFrame:
    """Verified links between components of one min-hash group: each component sends one set, and meets the
    group's first and last one in an order drawn for the round, so the pairs are twice the sets at most.
    The ends of a group are combined in each task first, and Spark splits the join of a hot one."""
    keys = sets.mapInArrow(_min_hashes(seeds), "cid long, component long, keys array<long>").select("cid", "component", F.posexplode("keys").alias("r", "m"))
    turn = F.struct(F.xxhash64("cid", F.lit(seeds[0])).alias("turn"), F.col("cid"))
    one = keys.groupBy("r", "m", "component").agg(F.min(turn).alias("own"))
    one = saved(one.select("r", "m", "component", "own"))
    ends = one.groupBy("r", "m").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo != hi")
    met = one.join(ends, ["r", "m"]).select(F.col("own.cid").alias("a"), F.explode(F.array("lo.cid", "hi.cid")).alias("b"))
    pairs = met.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return _verified(pairs, sets, rule)


def _subsets(rule: Rule, most: int):
    """(key, t, size, cid): every subset of a light set that it may share with a linked one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[tuple] = []
            for cid, data in zip(batch.column("cid").to_pylist(), batch.column("hashes")):
                own = [data.as_py()[i : i + 8] for i in range(0, len(data.as_py()), 8)]
                if len(own) > most:
                    continue
                for t in range(rule.least(len(own)), len(own) + 1):
                    out += [(xxhash.xxh3_64_intdigest(b"".join(c)) - 2**63, t, len(own), cid) for c in combinations(own, t)]
            names, types = ["key", "t", "size", "cid"], [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names)

    return run


def _light_links(sets: DataFrame, rule: Rule, most: int) -> DataFrame:
    """Links among light sets: of all that hold a subset, the smallest set links first, so a star is enough."""
    rows = sets.filter(F.col("n") <= most).mapInArrow(_subsets(rule, most), "key long, t long, size long, cid long")
    rows = saved(rows)
    least = rows.groupBy("key", "t").agg(F.min(F.struct("size", "cid")).alias("m"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", "t", "m.size", "m.cid").withColumnsRenamed({"size": "m_size", "cid": "b"})
    met = rows.join(least, ["key", "t"]).filter("cid != b").filter(F.lit(rule.den) * F.col("t") >= F.lit(rule.num) * (F.col("size") + F.col("m_size") - F.col("t")))
    return met.select(F.col("cid").alias("a"), "b").distinct()


def choose_boundary(sizes: dict[int, int], list_length: float, rule: Rule) -> int:
    """The size up to which enumerating subsets costs no more than scanning lists."""
    best, boundary, gained = 0.0, 0, 0.0
    for s in range(1, LIGHT_MOST + 1):
        enumerate_cost = sum(math.comb(s, t) for t in range(rule.least(s), s + 1))
        scan_cost = (s - rule.least(s) + 1) * max(1.0, list_length)
        gained += sizes.get(s, 0) * (scan_cost - enumerate_cost)
        if gained >= best:
            best, boundary = gained, s
    return boundary


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last in slices(batch, "hashes"):
            rows = batch.slice(first, last - first)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("hashes")]
            many = [len(x) for x in sets]
            rest = [pa.array(np.repeat(rows.column(c).to_numpy(), many)) for c in ("cid", "n", "component")]
            yield from in_parts(pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), *rest], ["h", "cid", "n", "component"]))


def _index(sets: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """The inverted lists (h, cid, n, component) of each set's rarest shingles: two linked sets of different
    components share one of them."""
    def shared() -> DataFrame:
        elements = saved(sets.filter(F.col("n") >= rule.least(boundary + 1)).mapInArrow(_explode, "h long, cid long, n long, component long"))
        # a shingle of one component only pairs nothing
        lists = elements.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("h", "df")
        per_set = Window.partitionBy("cid")
        ranked = elements.join(lists, "h").withColumns({"at": F.row_number().over(per_set.orderBy("df", "h")), "c": F.count(F.lit(1)).over(per_set)})
        # of its n shingles a set shares at most these c with other components: fewer than any partner needs, and it
        # leaves; of n - least + 1 shingles in an order that puts the others first, c - least + 1 are shared
        return ranked.filter(F.col("at") <= F.col("c") - F.ceil(F.col("n") * rule.num / rule.den) + 1).select("h", "cid", "n", "component")

    return settled(shared)


def _units(index: DataFrame) -> DataFrame:
    """(unit, cid, n, component): the lists that begin with one set (the unit) are scanned together, so that a
    set goes there once, not once for each list."""
    firsts = index.groupBy("h").agg(F.min("cid").alias("unit"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("h", "unit")
    return saved(index.join(firsts, "h").select("unit", "cid", "n", "component").distinct())


def _meetings(units: DataFrame) -> DataFrame:
    """(unit, i, j, own, cid): the blocks of each unit that meet, and the sets in them. A component that fills half a
    block has blocks of its own, which do not meet each other; other components share mixed blocks."""
    weight = F.greatest(F.lit(1.0 / BLOCK_SETS), F.col("n") / F.lit(float(BLOCK_HASHES)))
    loads = units.groupBy("unit", "component").agg(F.sum(weight).alias("w")).withColumn("home", F.when(F.col("w") > 0.5, F.col("component").cast("string")).otherwise(F.lit("mixed")))
    homes = saved(loads.groupBy("unit", "home").agg(F.ceil(F.sum("w")).cast("int").alias("many")))
    placed = units.join(loads.drop("w"), ["unit", "component"]).join(homes, ["unit", "home"])
    part = F.pmod(F.when(F.col("home") == "mixed", F.xxhash64("component")).otherwise(F.xxhash64("cid")), F.col("many"))
    placed = placed.select("unit", "cid", "home", F.concat_ws("/", "home", part).alias("own"))
    blocks = homes.select("unit", F.col("home").alias("to"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("k")).select("unit", "to", F.concat_ws("/", "to", "k").alias("other"))
    met = placed.join(blocks, "unit").filter((F.col("home") != F.col("to")) | (F.col("home") == "mixed"))
    return met.select("unit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid")


def _list_links(sets: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Verified links between components, found by scanning inverted lists."""
    met = _meetings(_units(_index(sets, rule, boundary))).join(sets.select("cid", "component", "hashes"), "cid")
    runs = met.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "cid")
    return runs.mapInArrow(_scan(rule, boundary), "a long, b long").distinct()


def _parity_maps(sets: list[np.ndarray]) -> np.ndarray:
    """The parity of each set's hashes in MAP_BITS places: two maps differ in no more places than the sets in elements."""
    maps = [np.packbits(np.bincount((x % np.uint64(MAP_BITS)).astype(np.int64), minlength=MAP_BITS) & 1 == 1) for x in sets]
    return np.stack(maps).view(np.uint64)


def spanning_links(rule: Rule, boundary: int, cid: np.ndarray, component: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Verified links from sets marked left to sets marked right, enough to join all components that such links
    join: fewer than there are sets.

    A set with partners that sizes and parity maps allow scans the lists of its shingles once, which counts what it
    shares with every set; components that a link joined are not compared again.
    """
    n = np.array([len(x) for x in sets])
    _, parent = np.unique(component, return_inverse=True)
    # sizes alone part most small meetings
    ok = (rule.den * np.minimum(n[:, None], n[None, :]) >= rule.num * np.maximum(n[:, None], n[None, :])) & (np.maximum(n[:, None], n[None, :]) > boundary)
    ok &= (parent[:, None] != parent[None, :]) & left[:, None] & right[None, :]
    if not ok.any():
        return []
    maps = _parity_maps(sets)
    whole = np.concatenate(sets)
    order = np.argsort(whole, kind="stable")
    owner, ranked = np.repeat(np.arange(len(sets)), n)[order], whole[order]
    found = []
    for x in np.flatnonzero(ok.any(1)).tolist():
        y = np.flatnonzero(ok[x] & (parent != parent[x]))
        # |A ^ B| = a + b - 2 |A & B|, and a link needs |A & B| >= num (a + b) / (den + num)
        y = y[np.bitwise_count(maps[y] ^ maps[x]).sum(1) * (rule.den + rule.num) <= (n[y] + n[x]) * (rule.den - rule.num)]
        if not len(y):
            continue
        if len(y) <= 4:
            shared = np.array([np.isin(sets[k], sets[x], assume_unique=True).sum() for k in y])
        else:
            first, last = np.searchsorted(ranked, sets[x], "left"), np.searchsorted(ranked, sets[x], "right")
            many = last - first
            lists = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
            shared = np.bincount(owner[lists], minlength=len(sets))[y]
        for k in y[rule.links(n[x], n[y], shared)].tolist():
            if parent[k] != parent[x]:
                found.append((int(cid[x]), int(cid[k])))
                parent[parent == parent[k]] = parent[x]
    return found


def _scan(rule: Rule, boundary: int):
    """Rows come sorted by (unit, i, j): the spanning links of each meeting of two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def settled() -> list[tuple[int, int]]:
            cid, component, own, data = zip(*held)
            own = np.array(own)
            left, right = own == key[1], own == key[2]
            return spanning_links(rule, boundary, np.array(cid), np.array(component), [np.frombuffer(x, np.uint64) for x in data], left, right) if len(held) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            rows = [batch.column(c).to_pylist() for c in ("unit", "i", "j", "own", "cid", "component", "hashes")]
            for unit, i, j, *row in zip(*rows):
                if (unit, i, j) != key:
                    if held:
                        out += settled()
                    held, key = [], (unit, i, j)
                own, cid, component, data = row
                held.append((cid, component, own, data))
            yield _pairs(out)
        if held:
            yield _pairs(settled())

    return run


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _prefixes(rule: Rule):
    """Distinct (h, component) of a task's prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("hashes")]
            if sets:
                sets = [x[: rule.prefix(len(x))] for x in sets]
                rows = np.stack([np.concatenate(sets), np.repeat(batch.column("component").to_numpy(), [len(x) for x in sets])], 1)
                rows = np.unique(rows, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), pa.array(np.ascontiguousarray(rows[:, 1]))], ["h", "component"])

    return run


def _reached(merged: DataFrame, rule: Rule) -> tuple[DataFrame, float]:
    """The sets of components that may link to another component, and the mean length of the lists
    of shingles that components share."""
    with made() as tables:
        rows = saved(merged.mapInArrow(_prefixes(rule), "h long, component long").distinct())
        lists = saved(rows.groupBy("h").agg(F.count(F.lit(1)).alias("comps")).filter("comps > 1"))
        known = rows.join(lists, "h").groupBy("component").agg(F.count(F.lit(1)).alias("known"))
        wanted = merged.groupBy("component").agg(F.min(_least_known(rule)).alias("wanted"))
        open_ones = known.join(wanted, "component").filter("known >= wanted").select("component")
        length = lists.agg(F.coalesce(F.avg("comps"), F.lit(1.0))).first()[0]
        reached = saved(merged.join(open_ones, "component").select("cid", "n", "hashes", "component"))
    drop(merged.sparkSession, tables, reached)
    return reached, length


def _least_known(rule: Rule):
    """Prefix hashes of a set of n that any set linked to it must know: see Rule.marks."""
    return F.floor(F.ceil(F.col("n") * rule.num / rule.den) / 8) + 1


def _labelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """The sets with their components; found: node, component of those that have a link."""
    return sets.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))


def _classes_joined(rows: DataFrame, classes: DataFrame, repeated: bool, rule: Rule, k: int) -> DataFrame:
    """node, component of the linked classes. A step's tables are deleted as soon as the next one is written."""
    spark = rows.sparkSession
    # classes that can link: enough of their prefix is known to others
    known = _known(rows.select("text"), rule, k)
    able = classes.join(known, F.col("s1") == F.col("g")).filter(F.col("known") >= _least_known(rule)).select("cid")
    texts = rows.join(able, F.col("doc_id") == F.col("cid")).select("doc_id", "text")
    sets = texts.mapInArrow(_sets(k, True), "doc_id long, n long, s1 long, s2 long, hashes binary")
    # repeated rows of a doc_id are alike here or belong to another class
    sets_of_rows = sets.join(classes.select(F.col("cid"), F.col("s1").alias("c1"), F.col("s2").alias("c2")), (F.col("doc_id") == F.col("cid")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))).select("cid", "n", "hashes")
    # repeated rows: one set for each class
    with made() as own:
        sets = settled(lambda: saved(sets_of_rows).dropDuplicates(["cid"])) if repeated else saved(sets_of_rows)
    sizes = {r["n"]: r["c"] for r in sets.filter(F.col("n") <= LIGHT_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    merged, links, n_sets, r = sets.withColumn("component", F.col("cid")), None, sets.count(), 0
    held: list[str] = []  # the tables of links and merged
    while True:
        with made() as tables:
            fresh = settled(lambda: _pivot_links(merged, rule, list(range(r * PIVOT_HASHES, (r + 1) * PIVOT_HASHES))))
        n = fresh.count()
        both = fresh if links is None else links.unionByName(fresh)
        if n < max(1, WORTHWHILE * n_sets):  # too few for another labelling: the last step joins them
            links, held = both, held + tables
            break
        with made() as stars:
            found = components(both)
            merged = saved(_labelled(sets, found))
        # each set's link to its component stands for all links so far
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        drop(spark, held + tables)
        r, held = r + 1, stars
    reached, list_length = _reached(merged, rule)
    boundary = choose_boundary(sizes, list_length, rule)
    light = settled(lambda: _light_links(merged, rule, boundary))
    drop(spark, own + held, links)
    links = links.unionByName(light).unionByName(settled(lambda: _list_links(reached, rule, boundary)))
    return components(links)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    ship(docs.sparkSession)
    rule = Rule(num, den)
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = every.filter("doc_id IS NOT NULL")
    own = saved(every.mapInArrow(_sets(k, False), "doc_id long, n long, s1 long, s2 long").groupBy("doc_id", "n", "s1", "s2").agg(F.count(F.lit(1)).alias("n_rows")))
    classes = saved(own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("cid"), F.max("n").alias("n")))
    repeated = not own.filter("n_rows > 1 AND doc_id IS NOT NULL").isEmpty()
    found = settled(lambda: _classes_joined(rows, classes, repeated, rule, k))
    labels = classes.join(found, F.col("cid") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "cid").alias("component_id"))
    labelled = own.join(labels, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
