"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learnt lexicon (words and word beginnings, plain and after
undoing common look-alike spellings), how close second-person words stand to lexicon words,
capitals, punctuation and obfuscation rates. The trees are Spark ML's; an isotonic regression on
rows that the trees have not seen maps their margins to probabilities.

Fitting uses at most `train_rows` labelled rows (those of smallest hashed doc_id among the rows
allowed: a documented bound), dealt by hash of the text into two folds and a calibration part; trees see each fold through the
lexicon learnt from the other one. Every
document is scored from its whole text; labels, lang, source and doc_id are no inputs.

Defined results: null text scores as empty text; without labels of both kinds every score is the
smoothed share of label 1; rows with a null doc_id are scored and held out; repeated rows are scored
each, and count once in the sample; equal hashes of the sample go by doc_id; a very long text is scored whole in its task; no
rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesflow.llm.common import saved, ship, slices, whole_text
from salesflow.llm.quality import held_out, labelled_sample

FEATURES = ["hits", "hit_density", "strong_density", "begin_density", "hidden_density", "odds_sum", "odds_top", "second_person", "near_second_person", "capitals", "shouted_words", "marks", "punctuation", "obfuscated", "log_words"]

#: Second-person words of the corpus languages; look-alike characters.
SECOND_PERSON = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi vous votre ton ta tes vos usted ustedes ti tus vosotros os".split())
LOOK_ALIKE = bytes.maketrans(b"013457@$!|", b"oieastasil")
#: Words around a lexicon word in which a second-person word counts as near.
NEAR = 4
#: Lengths of word beginnings that the lexicon may hold.
BEGINNINGS = (4, 5)

#: Words whose odds a task remembers.
REMEMBERED = 300_000

_UPPER = bytes(range(65, 91))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_MIXED = re.compile(rb"[a-z][0-9@$!|*]+[a-z]")


def keys(word: bytes) -> list[bytes]:
    """What the lexicon may know of a word: itself, and its beginnings (marked by their length)."""
    return [word] + [b"%d:" % n + word[:n] for n in BEGINNINGS if len(word) > n]


def _hidden(token: bytes) -> bytes | None:
    """A token's plain spelling, if it hides one."""
    if _MIXED.search(token):
        plain = token.translate(LOOK_ALIKE).replace(b"*", b"")
        return plain if plain.isalpha() else None
    return None


def features(text: str, lexicon: dict[bytes, float], memory: dict[bytes, float]) -> list[float]:
    """The dense features of one whole text. memory: the best odds of words seen so far, 0 if none."""
    data = text.encode()
    low = data.lower()
    words = _WORD.findall(low)
    many = max(1, len(words))

    def odds(word: bytes) -> float:
        if (known := memory.get(word)) is None:
            known = max((lexicon.get(k, 0.0) for k in keys(word)), default=0.0)
            if len(memory) < REMEMBERED:
                memory[word] = known
        return known

    look = memory.get
    at = [i for i, w in enumerate(words) if (look(w) or (look(w) is None and odds(w)))]
    found = [memory.get(words[i]) or odds(words[i]) for i in at]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near, j = 0, 0
    for i in at:
        while j < len(second) and second[j] < i - NEAR:
            j += 1
        near += j < len(second) and second[j] <= i + NEAR
    begun = sum(1 for i in at if words[i] not in lexicon)
    hidden = mixed = 0
    if _MIXED.search(low):
        for token in low.split():
            if (plain := _hidden(token)) is not None:
                mixed += 1
                hidden += odds(plain) > 0
    size = max(1, len(data))
    raw = data.split()
    shouted = sum(1 for w in raw if len(w) > 2 and w.isupper())
    upper = size - len(data.translate(None, _UPPER)) if data else 0
    return [
        float(len(at)),
        len(at) / many,
        sum(1 for o in found if o > 4) / many,
        begun / many,
        hidden / many,
        min(60.0, sum(found)),
        max(found, default=0.0),
        len(second) / many,
        near / many,
        upper / size,
        shouted / max(1, len(raw)),
        (data.count(b"!") + data.count(b"?")) / size,
        (data.count(b".") + data.count(b",") + data.count(b";") + data.count(b":")) / size,
        mixed / many,
        math.log1p(len(words)),
    ]


def _featured(columns: list[str], lexicon: dict[bytes, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, float] = {}
        for batch in batches:
            for first, last in slices(batch):
                rows = batch.slice(first, last - first)
                x = [features(t, lexicon, memory) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(x, pa.list_(pa.float64()))], [*columns, "x"])

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, folds, labels = [], [], []
        for fold, y, text in zip(*(batch.column(c).to_pylist() for c in ("fold", "y", "text"))):
            own = {k for w in set(_WORD.findall(text.encode().lower())) for k in keys(w)}
            found += own
            folds += [fold] * len(own)
            labels += [y] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(folds, pa.int64()), pa.array(labels, pa.int64())], ["k", "fold", "y"])


def learn_lexicons(sample: DataFrame, size: int, least_docs: int, least_odds: float) -> list[dict[bytes, float]]:
    """Words and beginnings much likelier in toxic documents, with their log odds, at most `size`: learnt
    from fold 0, from fold 1 and from both."""
    texts = sample.groupBy("text", "fold").agg(F.max("y").alias("y"))  # copies count once
    n = {(r["fold"], r["y"]): r["n"] for r in texts.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = [F.sum(F.when(F.col("fold") == f, F.col("y")).otherwise(0)).alias(f"toxic{f}") for f in (0, 1)]
    clean = [F.sum(F.when(F.col("fold") == f, 1 - F.col("y")).otherwise(0)).alias(f"clean{f}") for f in (0, 1)]
    counts = texts.mapInArrow(_occurrences, "k binary, fold long, y long").groupBy("k").agg(*toxic, *clean).filter(F.col("toxic0") + F.col("toxic1") >= least_docs)
    counts = saved(counts)
    out = []
    for folds in ((0,), (1,), (0, 1)):
        total = lambda kind: sum((F.col(f"{kind}{f}") for f in folds), F.lit(0))  # noqa: E731, B023
        ones, zeros = (sum(n.get((f, y), 0) for f in folds) for y in (1, 0))
        odds = F.log(((total("toxic") + 0.1) / (ones + 0.2)) / ((total("clean") + 0.1) / (zeros + 0.2)))
        top = counts.select("k", total("toxic").alias("toxic"), odds.alias("odds")).filter((F.col("toxic") >= least_docs) & (F.col("odds") >= least_odds))
        out.append({bytes(r["k"]): float(r["odds"]) for r in top.orderBy(F.desc("toxic"), F.desc("odds"), "k").limit(size).collect()})
    return out


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 5, remainder: int = 0, train_rows: int = 12_000, lexicon_size: int = 2_000, least_docs: int = 2, least_odds: float = 2.5, trees: int = 16, depth: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), whole_text().alias("text"))
    sample = saved(labelled_sample(docs, labels, label, modulus, remainder, train_rows).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(5))).withColumn("fold", F.floor(F.col("part") / 2)))
    counts = {(r["part"], r["y"]): r["n"] for r in sample.groupBy("part", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, ones = sum(counts.values()), sum(v for (_, y), v in counts.items() if y == 1)
    prior = (ones + 1) / (n + 2)
    both = all(any(counts.get((p, y)) for p in part) for part in ((0, 1), (2, 3), (4,)) for y in (0, 1))
    if not both:  # too few rows of a kind to learn from
        score: Column = F.lit(prior)
        return rows.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    lexicons = learn_lexicons(sample.filter("part < 4"), lexicon_size, least_docs, least_odds)
    # trees learn from each fold with the lexicon of the other; calibration and scoring use the whole lexicon
    parts = [sample.filter(F.col("fold") == fold).mapInArrow(_featured(["part", "y"], lexicons[use]), "part long, y int, x array<double>") for fold, use in ((0, 1), (1, 0), (2, 2))]
    numbers = saved(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    vectors = numbers.select("part", F.col("y").cast("double").alias("label"), array_to_vector("x").alias("features"))
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=17)
    model = gbt.fit(vectors.filter("part < 4"))
    margin = vector_to_array("rawPrediction")[1]
    seen = model.transform(vectors.filter("part = 4")).select("label", margin.alias("margin"), F.lit(1.0).alias("weight"))
    # two light rows beyond either end keep the calibrated scores inside (0, 1)
    ends = docs.sparkSession.createDataFrame([(0.0, 1e3, 0.02), (1.0, -1e3, 0.02)], "label double, margin double, weight double")
    iso = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(seen.unionByName(ends))
    lows, ps = [float(v) for v in iso.boundaries.toArray()], [float(v) for v in iso.predictions.toArray()]
    x = rows.mapInArrow(_featured(["doc_id", "held_out"], lexicons[2]), "doc_id long, held_out boolean, x array<double>")
    scored = model.transform(x.select("doc_id", "held_out", array_to_vector("x").alias("features"))).select("doc_id", "held_out", margin.alias("margin"))
    calibrated = _between(F.col("margin"), lows, ps)
    # margins break ties inside a calibrated step without crossing it
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.998 * calibrated + 0.002 / (1 + F.exp(-F.col("margin")))))
    return scored.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _between(x: Column, at: list[float], value: list[float]) -> Column:
    """Linear interpolation between the steps of the calibration; the ends stay flat. The step is found by counting the
    boundaries below x, in one array."""
    slope = [(value[k + 1] - value[k]) / (at[k + 1] - at[k]) if at[k + 1] > at[k] else 0.0 for k in range(len(at) - 1)] + [0.0]
    below = F.size(F.filter(F.lit(at), lambda b: b < x))
    k = F.greatest(F.lit(1), below)
    inside = F.element_at(F.lit(value), k) + (x - F.element_at(F.lit(at), k)) * F.element_at(F.lit(slope), k)
    return F.when(below == 0, F.lit(value[0])).otherwise(inside)
