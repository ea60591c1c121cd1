"""Fuzzy repeated passages across documents, by collinear chaining of shared seeds.

Seeds are k-word windows chosen by winnowing, so that any exact run of k + window - 1 words holds one;
the n-th occurrence of a seed in a document is a seed of its own, so repetitive passages keep
their order, and also anchors to the source's first occurrence, so that further copies of a passage
inside a document are found. Each seed's first holder (smallest doc_id) is its source: every other holder gets one
anchor to it, never one for every pair of holders. A document's anchors with one source are
chained: the best order-preserving chain under gap costs linear in the skipped words of both
sides, with a Fenwick tree for prefix maxima. Chains long enough are aligned word by word: ends are
extended, and the longest common subsequence of both sides gives their identity. A chain under the wanted
identity is split at its largest gap, and each part is aligned by itself.

Parts of a passage may first occur in different documents, so exact runs have a second step. Probes are windows of a little over half
of `min_words`, winnowed so that any run of min_words words holds one. Around shared probes whose surroundings no found
passage covers, every run of min_words words meets its own first holder, and runs that touch on a diagonal are one passage.

Bounds: pre-aggregation leaves one row for a seed and task before the shuffle; anchors of a document
are at most two for each of its seeds; the second step's runs are at most its words; texts are shuffled twice, compressed; a source asked for many passages is read once for ASKED of them.

Recall of changed passages, measured by a test over planted pairs (one word changed every k words): at least 0.9 from identity
0.95 at 100 words on; at 60 words 35 of 40 at 0.97; below that seeds thin out (0.90: about half at 100 words, a quarter at 60), and with
a word changed every 8 words or fewer none is found. `identity` is the least that a found passage must have, not one
from which all are found. Exact runs of min_words words are found surely, by a first holder or inside a found passage.

Defined results: null or short texts have no passage; rows repeated under one doc_id are one document, of different texts the
smallest; of equal chains the one met first in (source, position) order counts; a very long text is cut where it is read, and a
passage costs work in proportion to its words; a null doc_id takes no part; extra columns are ignored; no rows give no rows. Words are runs without
ASCII white space, A-Z lower-cased; positions count words from 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship, slices, whole_text
from salesflow.llm.shingles import each_text, mixed, powers, windows, winnowed

#: Words of a seed, and windows of which one seed is chosen.
SEED_WORDS, WINDOW = 8, 12
#: Words of a bucket in which passages and probes meet.
BUCKET = 1024
#: Gain of a seed in a chain, and cost of each word skipped on either side.
SEED_GAIN, GAP_COST = 8.0, 0.1
#: Passages that one copy of a source's text answers.
ASKED = 64
#: Words around a chain in which its ends are extended.
MARGIN = 40
#: Words of a piece that is aligned at once.
PIECE = 2048
#: Seeds that a task combines before it sends them on.
HELD = 1_000_000


def seeds(words: np.ndarray, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's seeds; with `every`, a later occurrence also under its first's hash."""
    grams = windows(words, SEED_WORDS)
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    wide, at = min(WINDOW, len(grams)), winnowed(grams, WINDOW)
    chosen = grams[at]
    # inside a run of one repeated seed, one in `wide` is enough
    keep = np.ones(len(at), bool)
    same = np.flatnonzero(chosen[1:] == chosen[:-1]) + 1
    last = {}
    for i in same.tolist():
        before = last.get(i - 1, at[i - 1])
        keep[i] = at[i] - before >= wide
        last[i] = at[i] if keep[i] else before
    at = at[keep]
    chosen = grams[at]
    order = np.argsort(chosen, kind="stable")
    ranked = chosen[order]
    start = np.ones(len(ranked), bool)
    start[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(start)
    nth = np.empty(len(at), np.uint64)
    nth[order] = (np.arange(len(ranked)) - begin[np.cumsum(start) - 1]).astype(np.uint64)
    h = mixed(chosen + nth * np.uint64(0x9E3779B97F4A7C15))
    if every and (later := nth > 0).any():
        return np.concatenate([h, mixed(chosen[later])]), np.concatenate([at, at[later]])
    return h, at


def grams_of(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of `length` words, in order, at the same cost for every length."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, back = powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * back[:n] ^ np.uint64(length))


def probe_words(min_words: int) -> int:
    """Words of a probe; one is chosen of each min_words - probe_words + 1."""
    return min(min_words, max(SEED_WORDS + 1, min_words // 2 + 2))


def long_seeds(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the probes: each run of `min_words` words holds one, the same wherever it occurs."""
    if len(words) < min_words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = probe_words(min_words)
    grams = grams_of(words, length)
    at = winnowed(grams, min_words - length + 1)
    return grams[at], at


def _seed_rows(combine: bool, length: int):
    """(h, doc, at) of seeds and probes, at: four times the place of the first word, one more for a probe;
    combined: each hash once for what a task holds, at its first place, two more if another document there has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def told() -> pa.RecordBatch:
            h, doc, at = (np.concatenate(x) for x in zip(*held))
            if combine:
                order = np.lexsort((at, doc, h))
                h, doc, at = h[order], doc[order], at[order]
                start = np.ones(len(h), bool)
                start[1:] = h[1:] != h[:-1]
                ends = np.append(np.flatnonzero(start)[1:] - 1, len(h) - 1)
                shared = doc[ends] != doc[start]
                h, doc, at = h[start], doc[start], at[start] + 2 * shared
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (h.view(np.int64), doc, at)], ["h", "doc", "at"])

        for batch in batches:
            for first, end in slices(batch):
                part = batch.slice(first, end - first)
                for doc, words in zip(part.column("doc_id").to_pylist(), each_text(part.column("text"))):
                    (h, at), (wide, start) = seeds(words, not combine), long_seeds(words, length)
                    if len(h):
                        h, at = np.concatenate([h, wide]), np.concatenate([4 * at, 4 * start + 1])
                        held.append((h, np.full(len(h), doc, np.int64), at.astype(np.int64)))
                        many += len(h)
                if many >= HELD:
                    yield told()
                    held, many = [], 0
        if held:
            yield told()

    return run


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (h, doc, at): the first document and place of each hash that another document has too."""
    held: np.ndarray | None = None  # the first row of the open run, and whether it is shared

    def settled(rows: np.ndarray) -> pa.RecordBatch:
        good = rows[rows[:, 3] > 0]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (good[:, 0], good[:, 1], good[:, 2] >> 2)], ["h", "source", "rpos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h, doc, at = (batch.column(c).to_numpy() for c in ("h", "doc", "at"))
        rows = np.stack([h, doc, at, at >> 1 & 1], 1)
        if held is not None:
            rows = np.concatenate([held, rows])
        start = np.ones(len(rows), bool)
        start[1:] = rows[1:, 0] != rows[:-1, 0]
        begin = np.flatnonzero(start)
        first = rows[begin]
        other = rows[:, 1] != first[np.cumsum(start) - 1, 1]
        first[:, 3] = np.maximum(np.maximum.reduceat(rows[:, 3], begin), np.maximum.reduceat(other, begin))
        held = first[-1:]
        yield settled(first[:-1])
    if held is not None:
        yield settled(held)


def chain(pos: np.ndarray, rpos: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """The chains of anchors sorted by (pos, rpos), best first, as (first pos, last pos, first rpos, last rpos)."""
    return [(x[0], x[-1], y[0], y[-1]) for x, y in linked(pos, rpos, least)]


def linked(pos: np.ndarray, rpos: np.ndarray, least: int) -> list[tuple[list[int], list[int]]]:
    """The chains of anchors sorted by (pos, rpos), best first, as the places of their anchors on both sides.

    f(i) = SEED_GAIN + max(0, max over j before i on both sides of f(j) - GAP_COST * skipped words); as the
    cost is linear, f(j) + GAP_COST * (pos_j + rpos_j) in a Fenwick tree over rpos gives the maximum.
    """
    n = len(pos)
    x, y = pos.tolist(), rpos.tolist()
    places = np.unique(rpos)
    slot = (np.searchsorted(places, rpos) + 1).tolist()
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(places) + 1)
    size = len(tree)
    score, before = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        stop = i
        while stop < n and x[stop] == x[i]:  # anchors at one place do not follow each other
            k, best = slot[stop] - 1, (-1e18, -1)
            while k > 0:
                if tree[k] > best:
                    best = tree[k]
                k -= k & -k
            gained = best[0] - GAP_COST * (x[stop] + y[stop] - 2)
            score[stop] = SEED_GAIN + max(0.0, gained)
            before[stop] = best[1] if gained > 0 else -1
            stop += 1
        for j in range(i, stop):
            item, k = (score[j] + GAP_COST * (x[j] + y[j]), j), slot[j]
            while k < size:
                if item > tree[k]:
                    tree[k] = item
                k += k & -k
        i = stop
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda j: (-score[j], j)):
        if used[end]:
            continue
        j, members = end, []
        while j >= 0 and not used[j]:
            used[j] = True
            members.append(j)
            j = before[j]
        if x[end] + SEED_WORDS - x[members[-1]] >= least:
            members.reverse()
            out.append(([x[j] for j in members], [y[j] for j in members]))
    return out


def _chains(least: int):
    """Rows come sorted by (doc, source, pos, rpos): chains of each (doc, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: np.ndarray | None = None

        def settled(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
            cuts = [*np.flatnonzero(new).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:]):
                group = rows[a:b]
                fresh = np.ones(len(group), bool)  # keys of two kinds may give one anchor
                fresh[1:] = (group[1:] != group[:-1]).any(1)
                group = group[fresh]
                if group[-1, 2] + SEED_WORDS - group[0, 2] >= least:
                    for xs, ys in linked(group[:, 2], group[:, 3], least):
                        out.append((int(group[0, 0]), int(group[0, 1]), xs[0], xs[-1], ys[0], ys[-1], np.array([xs, ys], np.int64).tobytes()))
            names, types = ["doc", "source", "a0", "a1", "b0", "b1", "anchors"], [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("doc", "source", "pos", "rpos")], 1)
            if tail is not None:
                rows = np.concatenate([tail, rows])
            if len(rows):
                open_from = int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))[-1]) + 1 if (rows[:, :2] != rows[-1, :2]).any() else 0
                tail = rows[open_from:]
                if open_from:
                    yield from settled(rows[:open_from])
        if tail is not None and len(tail):
            yield from settled(tail)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: compressed, as they are most of what is shuffled."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for start, end in slices(batch):
            part = batch.slice(start, end - start)
            raw = [x.as_buffer() for x in part.column("text").cast(pa.large_binary())]
            packed = pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("target"), packed, pa.array([x.size for x in raw], pa.int64())], ["target", "packed", "size"])


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, dict]]:
    """The word hashes of each packed text, and its other columns."""
    codec = pa.Codec("zstd")
    for row in batch.to_pylist():
        text = codec.decompress(row["packed"], row["size"], asbytes=True) if row["size"] else b""
        array = pa.Array.from_buffers(pa.large_string(), 1, pa.array([text], pa.large_binary()).buffers())
        yield next(each_text(array)), row


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes that each request asks of its text, with MARGIN words around them."""
    names, types = ["chain", "side", "lo", "words"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        for words, row in _asked(batch):
            for r in row["asks"]:
                lo, hi = max(0, r["first"] - MARGIN), min(len(words), r["last"] + SEED_WORDS + MARGIN)
                out.append((r["chain"], r["side"], lo, words[lo:hi].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names)


def _around(min_words: int):
    """(w, doc, pos): the runs of `min_words` words that hold one of the probes asked of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = min_words - probe_words(min_words)
        for batch in batches:
            for words, row in _asked(batch):
                h, at = long_seeds(words, min_words)
                at = at[np.isin(h.view(np.int64), np.array(row["asks"], np.int64))]
                grams = grams_of(words, min_words)
                pos = np.unique((at[:, None] - np.arange(back + 1)).ravel())
                pos = pos[(pos >= 0) & (pos < len(grams))]
                doc = np.full(len(pos), row["target"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(grams[pos].view(np.int64)), pa.array(doc), pa.array(pos.astype(np.int64))], ["w", "doc", "pos"])

    return run


def common_words(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of x."""
    if np.array_equal(x, y):
        return len(x)
    at: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(x)) - 1
    row = full
    for w in y.tolist():
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(x) - bin(row).count("1")


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How far equal words, with few unequal ones between, lead on from the start of both sides."""
    n = min(len(x), len(y))
    if not n:
        return 0
    score = np.cumsum(np.where(x[:n] == y[:n], 1, -2))
    dropped = np.flatnonzero(score < np.maximum.accumulate(np.maximum(score, 0)) - 6)
    if len(dropped):
        score = score[: dropped[0]]
    return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0


def align(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int, int, int]:
    """Extend the core from the first to the last anchor at both ends; returns it and its common words. A core of
    more than PIECE words is cut at anchors about PIECE words apart, whose words are common anyway, and its pieces
    are compared each: the work grows with the passage, not with its square."""
    ax, bx, ay, by = int(xs[0]), int(xs[-1]) + SEED_WORDS, int(ys[0]), int(ys[-1]) + SEED_WORDS
    left, right = _reach(x[:ax][::-1], y[:ay][::-1]), _reach(x[bx:], y[by:])
    ax, ay, bx, by = ax - left, ay - left, bx + right, by + right
    cuts = [(ax, ay)]
    for i, j in zip(xs.tolist(), ys.tolist()):
        if i - cuts[-1][0] >= PIECE and j > cuts[-1][1]:
            cuts.append((i, j))
    cuts.append((bx, by))
    return ax, bx, ay, by, sum(common_words(x[a:b], y[c:d]) for (a, c), (b, d) in zip(cuts, cuts[1:]))


def passages(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, min_words: int, identity: float) -> Iterator[tuple[int, int, int, int, int]]:
    """The passages of a chain with anchors at xs and ys: the whole chain if it holds the identity, otherwise
    those of its two parts beside its largest gap."""
    parts = [(0, len(xs))]
    while parts:
        i, j = parts.pop()
        ax, bx, ay, by, same = found = align(x, y, xs[i:j], ys[i:j])
        if bx - ax < min_words:  # parts reach no farther than the whole, but for ends that align elsewhere
            if j - i == 1 or same >= identity * max(bx - ax, by - ay):
                continue
        elif same >= identity * max(bx - ax, by - ay):
            yield found
            continue
        if j - i > 1:
            gap = np.maximum(np.diff(xs[i:j]), np.diff(ys[i:j]))
            cut = i + 1 + int(gap.argmax())
            parts += [(i, cut), (cut, j)]


def _align(min_words: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start_word", "end_word", "source_doc", "source_start", "source_end", "identity"]
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                doc, source, xlo, ylo = (batch.column(c)[i].as_py() for c in ("doc", "source", "x_lo", "y_lo"))
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("x", "y"))
                xs, ys = np.frombuffer(batch.column("anchors")[i].as_buffer(), np.int64).reshape(2, -1)
                for ax, bx, ay, by, same in passages(x, y, xs - xlo, ys - ylo, min_words, identity):
                    out.append((doc, ax + xlo, bx + xlo, source, ay + ylo, by + ylo, same / max(bx - ax, by - ay)))
            types = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names)

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """doc_id, start_word, end_word, source_doc, source_start, source_end, identity of each passage of at
    least `min_words` words that an earlier document (by doc_id) holds too. Of the rows of a repeated doc_id the one with the
    smallest text counts, once."""
    ship(docs.sparkSession)
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = saved(rows.groupBy("doc_id").agg(F.min("text").alias("text")))
    form = "h long, doc long, at long"
    # a hash has one row for each HELD seeds of a task
    dealt = rows.mapInArrow(_seed_rows(True, min_words), form).repartition("h").sortWithinPartitions("h", "doc", "at")
    sources = dealt.mapInArrow(_sources, "h long, source long, rpos long")
    # a very common seed has many holders: Spark splits its side of this join, as both sides are shuffled for it
    met = saved(rows.mapInArrow(_seed_rows(False, min_words), form).join(sources, "h").filter("doc != source"))
    anchors = met.filter("at % 2 = 0").select("doc", "source", F.shiftright("at", 2).alias("pos"), "rpos")
    dealt = anchors.repartition("doc").sortWithinPartitions("doc", "source", "pos", "rpos")
    least = min_words - 2 * (WINDOW - 1)
    chains = dealt.mapInArrow(_chains(least), "doc long, source long, a0 long, a1 long, b0 long, b1 long, anchors binary").distinct()
    chains = saved(chains.withColumn("chain", F.xxhash64("doc", "source", "a0", "a1", "b0", "b1", "anchors")))
    asks = chains.select(F.col("doc").alias("target"), "chain", F.lit(0).alias("side"), F.col("a0").alias("first"), F.col("a1").alias("last")).unionByName(
        chains.select(F.col("source").alias("target"), "chain", F.lit(1).alias("side"), F.col("b0").alias("first"), F.col("b1").alias("last"))
    )
    parts = asks.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("parts"))
    dealt = asks.join(parts, "target").withColumn("part", F.pmod(F.xxhash64("chain", "side"), F.col("parts")))
    grouped = dealt.groupBy("target", "part").agg(F.collect_list(F.struct("chain", "side", "first", "last")).alias("asks"))
    one = rows.withColumnRenamed("doc_id", "target").mapInArrow(_packed, "target long, packed binary, size long")
    cut = saved(one.join(grouped, "target").select("packed", "size", "asks").mapInArrow(_slice, "chain long, side int, lo long, words binary"))
    x = cut.filter("side = 0").select("chain", F.col("lo").alias("x_lo"), F.col("words").alias("x"))
    y = cut.filter("side = 1").select("chain", F.col("lo").alias("y_lo"), F.col("words").alias("y"))
    both = chains.join(x, "chain").join(y, "chain")
    found = both.mapInArrow(_align(min_words, identity), "doc_id long, start_word long, end_word long, source_doc long, source_start long, source_end long, identity double")
    found = saved(found.distinct())
    return found.unionByName(_exact_runs(one, met, found, min_words)).distinct()


def _exact_runs(texts: DataFrame, met: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """The exact runs of `min_words` words or more that no passage found so far covers, whatever documents their parts first
    occur in: all runs of that length around the probes whose surroundings are not covered are met by their first holder."""
    back = min_words - probe_words(min_words)
    held = met.filter("at % 2 = 1").select("h", "doc", "source", F.shiftright("at", 2).alias("pos"))
    first = F.greatest(F.col("pos") - back, F.lit(0))
    bucket = lambda x: F.floor(x / BUCKET)
    spans = found.select(F.col("doc_id").alias("doc"), "start_word", "end_word", F.col("source_doc").alias("of"), F.col("source_start").alias("since"), F.col("source_end").alias("until"), F.explode(F.sequence(bucket(F.col("start_word")), bucket(F.col("end_word")))).alias("bucket"))
    covered = (F.col("start_word") <= F.col("first")) & (F.col("end_word") >= F.col("pos") + min_words)
    left = held.select("h", "doc", "pos", first.alias("first"), bucket(F.col("pos")).alias("bucket"))
    spans = spans.withColumnsRenamed({"doc": "to", "bucket": "at"})
    left = left.join(spans, (F.col("doc") == F.col("to")) & (F.col("bucket") == F.col("at")) & covered, "left_anti")
    wanted = held.join(left.select("h").distinct(), "h")
    asks = wanted.select(F.col("doc").alias("target"), "h").unionByName(wanted.select(F.col("source").alias("target"), "h"))
    grouped = asks.groupBy("target").agg(F.collect_set("h").alias("asks"))
    runs = saved(texts.join(grouped, "target").mapInArrow(_around(min_words), "w long, doc long, pos long"))
    holders = runs.groupBy("w").agg(F.min(F.struct("doc", "pos")).alias("lo"), F.max("doc").alias("last")).filter("lo.doc < last")
    hits = runs.join(holders.select("w", "lo"), "w").filter("doc != lo.doc").select("doc", F.col("lo.doc").alias("source"), "pos", F.col("lo.pos").alias("rpos"))
    hits = hits.repartition("doc").withColumn("diagonal", F.col("pos") - F.col("rpos")).sortWithinPartitions("doc", "source", "diagonal", "pos")
    joined = hits.mapInArrow(_joined(min_words), "doc_id long, start_word long, end_word long, source_doc long, source_start long, source_end long, identity double")
    # a run inside a passage with the same source, on both sides, says nothing new
    inside = (F.col("start_word") <= F.col("first")) & (F.col("end_word") >= F.col("last")) & (F.col("since") <= F.col("source_start")) & (F.col("until") >= F.col("source_end"))
    fresh = joined.withColumnsRenamed({"start_word": "first", "end_word": "last"}).withColumn("bucket", bucket(F.col("first")))
    fresh = fresh.join(spans, (F.col("doc_id") == F.col("to")) & (F.col("source_doc") == F.col("of")) & (F.col("bucket") == F.col("at")) & inside, "left_anti")
    return fresh.drop("bucket").withColumnsRenamed({"first": "start_word", "last": "end_word"})


def _joined(min_words: int):
    """Rows come sorted by (doc, source, diagonal, pos): runs that touch on a diagonal are one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start_word", "end_word", "source_doc", "source_start", "source_end", "identity"]

        def told(firsts: np.ndarray, lasts: np.ndarray) -> pa.RecordBatch:
            doc, source, diagonal, start = firsts.T
            end = lasts[:, 3] + min_words
            columns = [doc, start, end, source, start - diagonal, end - diagonal, np.ones(len(doc))]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

        held: np.ndarray | None = None  # the first and last row of the open passage
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("doc", "source", "diagonal", "pos")], 1)
            if not len(rows):
                continue
            if held is not None:
                rows = np.concatenate([held, rows])
            fresh = np.ones(len(rows), bool)
            fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1) | (rows[1:, 3] - rows[:-1, 3] > min_words)
            if held is not None:
                fresh[1] = False  # the open passage, however long
            begin = np.flatnonzero(fresh)
            firsts, lasts = rows[begin], rows[np.append(begin[1:] - 1, len(rows) - 1)]
            held = np.stack([firsts[-1], lasts[-1]])
            yield told(firsts[:-1], lasts[:-1])
        if held is not None:
            yield told(held[:1], held[1:])

    return run
