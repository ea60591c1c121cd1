"""Quality classifier: a generalised additive model with pairwise interactions.

Dense features of a text are binned; cyclic boosting of shallow trees (one feature at a time, in
turn) learns a lookup table per feature, then tables for the strongest pairs of features. A score
is the sum of a document's bins through a logistic function, computed for whole batches by
vectorised additions.

Fitting uses at most `train_rows` labelled rows, those of smallest hashed doc_id among the rows
allowed (a documented bound); `bags` models are fitted side by side on Spark, each on its own part
of these rows with the rest held out to stop early, and their tables are averaged. Every
document is scored from its whole text; labels, lang, source and doc_id are no inputs.

Defined results: null text scores as empty text; without labels of both kinds every score is the
smoothed share of label 1; rows with a null doc_id are scored and held out; repeated rows are scored
each, and count once in the sample; equal hashes of the sample go by doc_id; a very long text is scored whole in its task; no
rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship, slices, whole_text

FEATURES = ["log_words", "mean_word", "upper", "digit", "stop_punct", "symbols", "bars", "marks", "distinct", "top_word", "repeats", "line_chars", "repeated_lines", "short_words", "foreign", "other_bytes", "ends", "periods"]

#: Byte classes: lower-case, upper-case, digit, plain punctuation, symbols, !?, white space, non-ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 4
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 7
_CLASS[ord("|")] = 8
_CLASS[128:] = 9


def features(text: str) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    data = text.encode()
    n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=10) if data else np.zeros(10, np.int64)
    size = max(1, len(data))
    letters = max(1, int(n[1] + n[2] + n[9]))
    words = data.lower().split()
    many = max(1, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x]
    same = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(len(words)),
        min(40.0, (size - int(n[7])) / many),
        n[2] / letters,
        n[3] / size,
        n[4] / size,
        n[5] / size,
        n[8] / size,
        n[6] / size,
        len(counts) / many,
        max(counts.values(), default=0) / many,
        same / many,
        min(2000.0, size / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for w in words if len(w) < 3) / many,
        n[9] / size,
        n[0] / size,
        sum(1 for x in lines if x[-1:] in b".!?") / max(1, len(lines)),
        data.count(b".") / many,
    ]


def _featured(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch):
                part = batch.slice(first, last - first)
                x = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    return run


def held_out(modulus: int, remainder: int, doc_id: str = "doc_id") -> Column:
    """Whether labels of a row must not be learnt from; a null doc_id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, train_rows: int) -> DataFrame:
    """At most `train_rows` rows (h, y, text) to learn from: smallest hashed doc_id first; of repeated rows of a doc_id the smallest
    text, once."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(modulus, remainder)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    picked = usable.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(17))).orderBy("h", "doc_id").limit(train_rows)
    # at most train_rows rows of three numbers: a proven bound
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text")).select("h", "y", "text")


# ---------------------------------------------------------------- fitting


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    cuts = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)
    return cuts


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _table_step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over ordered bins: the step for each bin."""
    out, spans = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, 0)
        for lo, hi in spans:
            if hi - lo < 2:
                continue
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            gain[(ch[:-1] < 0.5) | (ch[-1] - ch[:-1] < 0.5)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (lo, hi), lo + k + 1)
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    for lo, hi in spans:
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of both features into four quadrants: the step for each cell, and its gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        row, col, whole = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        quads.append((a, row - a, col - a, whole - row - col + a))
    gain = sum(_gain(x, y) for x, y in zip(*quads))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for k, (rows, cols) in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = _leaf(quads[0][k][i, j], quads[1][k][i, j])
    return out, float(gain[i, j])


def fit(x: np.ndarray, y: np.ndarray, hold: np.ndarray, edges: list[np.ndarray], coarse: list[np.ndarray], rounds: int, pairs: int, rate: float) -> tuple[list[np.ndarray], dict[tuple[int, int], np.ndarray], float]:
    """Tables of features, tables of pairs of coarse bins, and the intercept."""
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score, tables = np.full(len(y), base), [np.zeros(len(e) + 1) for e in edges]
    double: dict[tuple[int, int], np.ndarray] = {}
    learn = ~hold

    def loss() -> float:
        own = hold if hold.any() else learn
        return float(np.logaddexp(0, np.where(y[own] == 1, -score[own], score[own])).mean())

    def grad() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return np.where(learn, y - p, 0), np.where(learn, p * (1 - p), 0)

    best, wait = loss(), 0
    for _ in range(rounds):
        for f, own in enumerate(bins):
            g, h = grad()
            m = len(tables[f])
            step = rate * np.clip(_table_step(np.bincount(own, g, m), np.bincount(own, h, m)), -4, 4)
            tables[f] += step
            score += step[own]
        now = loss()
        best, wait = (now, 0) if now < best - 1e-5 else (best, wait + 1)
        if wait >= 8:
            break

    def cells(a: int, b: int, v: np.ndarray) -> np.ndarray:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(rough[a] * shape[1] + rough[b], v, shape[0] * shape[1]).reshape(shape)

    g, h = grad()
    able = [f for f in range(len(coarse)) if len(coarse[f])]
    ranked = sorted(((-_pair_step(cells(a, b, g), cells(a, b, h))[1], a, b) for i, a in enumerate(able) for b in able[i + 1 :]))
    for _, a, b in ranked[:pairs]:
        double[a, b] = np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))
    best, wait = loss(), 0
    for _ in range(rounds // 2):
        for (a, b), table in double.items():
            g, h = grad()
            step = rate * np.clip(_pair_step(cells(a, b, g), cells(a, b, h))[0], -4, 4)
            table += step
            score += step[rough[a], rough[b]]
        now = loss()
        best, wait = (now, 0) if now < best - 1e-5 else (best, wait + 1)
        if wait >= 5:
            break
    return tables, double, base


class Model:
    """Averaged lookup tables."""

    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray], base: float, tables: list[np.ndarray], double: dict[tuple[int, int], np.ndarray]):
        self.edges, self.coarse, self.base, self.tables, self.double = edges, coarse, base, tables, double

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (a, b), table in self.double.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 3, remainder: int = 1, train_rows: int = 12_000, bags: int = 4, bins: int = 32, rounds: int = 120, pairs: int = 6, rate: float = 0.15) -> Model:
    """Fit on Spark: one task for each bag of the bounded sample."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, modulus, remainder, train_rows)
    rows = saved(sample.mapInArrow(_featured(["h", "y"]), "h long, y int, x array<double>"))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = math.log((ones + 1) / (n - ones + 1))
    if not 0 < ones < n:
        return Model([], [], prior, [], {})

    def one_bag(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "y"])
        x, y = np.array(rows["x"].to_list()), rows["y"].to_numpy()
        hold = ((rows["h"].to_numpy() >> 8) % 8) == key[0] % 8
        edges, coarse = [_edges(x[:, f], bins) for f in range(x.shape[1])], [_edges(x[:, f], 8) for f in range(x.shape[1])]
        tables, double, base = fit(x, y, hold, edges, coarse, rounds, pairs, rate)
        out = [("edges", f, -1, edges[f]) for f in range(len(edges))] + [("coarse", f, -1, coarse[f]) for f in range(len(edges))]
        out += [("table", f, -1, t) for f, t in enumerate(tables)] + [("pair", a, b, t.ravel()) for (a, b), t in double.items()] + [("base", 0, 0, np.array([base]))]
        return pd.DataFrame([(key[0], kind, a, b, list(map(float, v))) for kind, a, b, v in out], columns=["bag", "kind", "a", "b", "v"])

    # every bag holds the whole bounded sample
    bagged = rows.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).groupBy("bag").applyInPandas(one_bag, "bag int, kind string, a int, b int, v array<double>")
    parts = bagged.collect()  # tables: bounded by features and bins
    by = lambda kind: {(r["bag"], r["a"], r["b"]): np.array(r["v"]) for r in parts if r["kind"] == kind}
    edges = [by("edges")[0, f, -1] for f in range(len(FEATURES))]
    coarse = [by("coarse")[0, f, -1] for f in range(len(FEATURES))]
    tables = [sum(by("table")[k, f, -1] for k in range(bags)) / bags for f in range(len(FEATURES))]
    double: dict[tuple[int, int], np.ndarray] = {}
    for (_, a, b), v in by("pair").items():
        double[a, b] = double.get((a, b), 0) + v.reshape(len(coarse[a]) + 1, len(coarse[b]) + 1) / bags
    return Model(edges, coarse, float(np.mean([v[0] for v in by("base").values()])), tables, double)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch):
                rows = batch.slice(first, last - first)
                score = model.scores(np.array([features(t) for t in rows.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "held_out")), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 3, remainder: int = 1, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels, label=label, modulus=modulus, remainder=remainder, **fitting)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), whole_text().alias("text"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def _filter(model: Model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in slices(batch):
                rows = batch.slice(first, last - first)
                texts = ["" if t is None else t for t in rows.column("text").to_pylist()]
                yield rows.filter(pa.array(model.scores(np.array([features(t) for t in texts])) >= 0.5)).select(columns)

    return run


def keep_good(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns; scored where they lie."""
    model = train(docs, labels, **fitting)
    return docs.mapInArrow(_filter(model, docs.columns), docs.schema)
