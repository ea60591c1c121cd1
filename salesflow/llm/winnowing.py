"""Document fingerprints by winnowing, in column expressions alone.

Text is lower-cased and split at white space. Each word becomes 30 bits of its hash; a k-gram of words has the
polynomial sum h0 b^(k-1) + ... + h(k-1), with the powers of b reduced modulo a prime: modulo that prime it is the rolling
(Karp-Rabin) hash, by which windows choose; the sum itself, 62 bits, is what a fingerprint keeps. Of each window of `window`
successive k-grams the least hash is chosen, the rightmost on ties, with its position. Minima of windows are found by
doubling: of two neighbours, of four, and so on. So every run of window + k - 1 words that two texts share leaves
a common hash, and the positions tell where it stands in each.

Defined results: a null text counts as empty and, like one without words, has no hashes; fewer than k words are one gram;
fewer k-grams than a window are one window. Two fingerprints without hashes are alike by 1. Words in unusual scripts
without spaces are long words. A text of any length is one array of words in its task (about 60 bytes a word).

Successors: rows are put in descending doc_id order, null last, ties by hash of the text and then by text; the row after the
last is the first, so a single row follows itself. Repeated rows follow each other. Empty tables give none; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm.common import WHITE, whole_text

#: The prime and the base of the rolling hash, bits of a word's hash.
PRIME, BASE, WORD_BITS = (1 << 30) - 35, 1_000_003, 30
#: Rows of a bucket of successive documents, and the most buckets there are.
ROWS, BUCKETS = 512, 1 << 16

_LAST = 0xFFFFFFFF


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a name inside lambdas would be expanded, and computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """Lower-case words of a text that is not null."""
    split = lambda bare: F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WHITE}]+"))
    return let(F.trim(F.lower(text), F.lit(WHITE)), split)


def _hashes(text: Column, k: int) -> Column:
    """30-bit hashes of words; fewer than k are filled up with zeros, so that they make one gram."""
    own = F.transform(words(text), lambda w: F.xxhash64(w).bitwiseAND((1 << WORD_BITS) - 1))
    filled = lambda h: F.when((F.size(h) == 0) | (F.size(h) >= k), h).otherwise(F.concat(h, F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size(h))))
    return let(own, filled)


def _gram(h: Column, at: Column, k: int, first: Column | None = None) -> Column:
    """The polynomial sum of the k-gram at a position; below 2^63 for k up to 8."""
    out = None
    for j in range(k):
        part = (first if j == 0 and first is not None else F.get(h, at + j)) * pow(BASE, k - 1 - j, PRIME)
        out = part if out is None else out + part
    return out


def _shortened(a: Column, by: int | Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - by))


def _least(keys: Column, window: int, done: int = 1) -> Column:
    """The least of each window's keys, from the least of `done` neighbours."""
    if done == window:
        return F.array_distinct(keys)
    step = min(done, window - done)
    return let(F.transform(_shortened(keys, step), lambda x, i: F.least(x, F.get(keys, i + step))), lambda wider: _least(wider, window, done + step))


def fingerprint(text: Column, k: int = 5, window: int = 6) -> Column:
    """struct<positions array<int>, hashes array<long>> of a text that is not null: the chosen k-grams, in order, by their first
    word's place."""
    if not 1 <= k <= 8 or window < 1:
        raise ValueError("k must be 1 to 8, and a window holds at least one k-gram")
    grams = lambda h: F.transform(_shortened(h, k - 1), lambda x, i: _gram(h, i, k, x))
    # hash above, place below: the least key is the least hash, and of equal ones the rightmost
    key = lambda g: F.transform(g, lambda x, i: F.shiftleft(x % PRIME, 32) + (F.lit(_LAST) - i))
    chosen = lambda m: F.when(F.size(m) > window, _least(m, window)).when(F.size(m) == 0, m).otherwise(F.array(F.array_min(m)))
    places = lambda c: F.transform(c, lambda s: (F.lit(_LAST) - s.bitwiseAND(_LAST)).cast("int"))
    kept = lambda g: let(places(let(key(g), chosen)), lambda p: F.struct(p.alias("positions"), F.transform(p, lambda at: F.get(g, at)).alias("hashes")))
    return let(let(_hashes(text, k), grams), kept)


def as_text(print_: Column) -> Column:
    """A fingerprint as text: HASH@position in hexadecimal and decimal digits, in order."""
    return F.array_join(F.transform(print_["hashes"], lambda h, i: F.concat(F.hex(h), F.lit("@"), F.get(print_["positions"], i).cast("string"))), " ")


def likeness(x: Column, y: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints' hashes, 0 to 1."""
    both = F.size(F.array_intersect(x, y)).cast("double")
    return let(F.size(F.array_union(x, y)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(both / n))


def matches(a: Column, b: Column) -> Column:
    """array<struct<hash, at, in>>: each chosen k-gram of the first fingerprint that the second holds, with both places
    (the first one in the second)."""
    place = lambda h: F.get(b["positions"], (F.array_position(b["hashes"], h) - 1).cast("int"))
    other = F.map_from_entries(F.transform(F.array_intersect(b["hashes"], a["hashes"]), lambda h: F.struct(h, place(h))))
    found = lambda m: F.transform(a["hashes"], lambda h, i: F.struct(h.alias("hash"), F.get(a["positions"], i).alias("at"), F.try_element_at(m, h).alias("in")))
    return let(other, lambda m: F.filter(found(m), lambda c: c["in"].isNotNull()))


def _order(doc_id: Column, text: Column) -> Column:
    """Ascending in this struct is descending in doc_id, null last; ~x falls as x grows and cannot overflow."""
    return F.struct(doc_id.isNull().alias("n"), F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("d"), F.xxhash64(text).alias("h"))


def with_next(docs: DataFrame, add: dict[str, Column] | None = None, rows: int = ROWS) -> DataFrame:
    """doc_id, text, the columns to add, and of all but doc_id the value of the row that follows in descending doc_id order,
    named next_<name>.

    The order is cut into buckets of about `rows` rows (more from 2^16 buckets on) by the first row of each, small facts that the
    driver holds. A bucket's first row also visits the bucket before it, so that a window over one bucket sees every
    successor, and texts are shuffled once."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("o", _order(F.col("doc_id"), F.col("text")))
    keys = own.select("o")
    parts = max(1, min(BUCKETS, -(-keys.count() // rows)))
    firsts = sorted(tuple(r["o"]) for r in keys.repartitionByRange(parts, "o").groupBy(F.spark_partition_id()).agg(F.min("o").alias("o")).collect())
    width = max(1, round(len(firsts) ** 0.5))
    groups = [firsts[i : i + width] for i in range(0, len(firsts), width)]
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    said, kind = [[dict(zip("ndh", f)) for f in g] for g in groups], "array<struct<n: boolean, d: bigint, h: bigint>>"
    coarse, fine = literal([g[0] for g in said], kind), literal(said, f"array<{kind}>")
    o = F.col("o")
    upto = lambda among: F.size(F.filter(among, lambda s: s <= o))
    group = F.greatest(F.lit(1), upto(coarse)) - 1
    inside = lambda g: let(F.get(fine, g), lambda f: F.struct((g * width + F.greatest(F.lit(1), upto(f)) - 1).alias("bucket"), F.array_contains(f, o).alias("first")))
    names = ["text", *(add or {})]
    placed = own.withColumns({**(add or {}), "at": let(group, inside)}).select("doc_id", *names, "o", "at.bucket", "at.first")
    before = F.pmod(F.col("bucket") - 1, F.lit(max(1, len(firsts))))
    visit = lambda b, guest: F.struct(b.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    visits = F.when(F.col("first"), F.array(visit(F.col("bucket"), False), visit(before, True))).otherwise(F.array(visit(F.col("bucket"), False)))
    spread = placed.select("doc_id", *names, "o", F.inline(visits))
    order = Window.partitionBy("bucket").orderBy("guest", "o", "text")
    return spread.withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).filter("NOT guest").drop("o", "bucket", "guest")


def edited(text: Column, other: Column) -> Column:
    """A text whose last half of code points (rounded down) is replaced by the first as many of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def compare(docs: DataFrame, k: int = 5, window: int = 6) -> DataFrame:
    """doc_id, n_chars, edited (text) and the fingerprints own and changed of each row and its edited text, next_hashes of
    its successor. A fingerprint is made before the shuffle and sent along with its text."""
    own = fingerprint(F.col("text"), k, window)
    rows = with_next(docs, {"own": own}).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", "own", fingerprint(F.col("edited"), k, window).alias("changed"), F.col("next_own.hashes").alias("next_hashes"))


def digest(compared: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compared.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own.hashes"), F.col("changed.hashes")).alias("near_edited"), likeness(F.col("own.hashes"), F.col("next_hashes")).alias("near_next"),
    )
