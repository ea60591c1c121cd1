"""Mixing sources to target weights by temperature.

A source's weight is its token share to a power, normalised; the exponent lies in [0, 1] (1: natural
shares, 0: equal ones). With `target_entropy` (a part of the entropy of equal shares) it is the
largest that reaches it; otherwise it is the smallest that keeps every source within `max_repeats`
passes of its own tokens at the wanted budget. It is bisected until its bracket is as narrow as a float: each Spark
aggregation over the table of sources evaluates the ends of five halvings at once, so sources never come to
the driver. Where the weights found would pass a source more than `max_repeats` times, either (`fill`) that source
is clipped at `max_repeats` passes and the others share the freed budget by their weights, so that a small source
never lowers another's documents, or the whole budget is lowered until no source passes the limit, so that the
drawn tokens keep the weights. With `fill`, one pass and the whole corpus as budget, everything is drawn.

The weights are realised exactly, with a token budget per source, as block permutations: a
source's documents lie in blocks by keyed hash; whole epochs give whole copies, and the last, partial epoch
takes documents along the permuted order while the source's remaining budget is not used up (the document that
crosses the budget is taken). `epoch_rows` deals the copies to epochs, each with a permutation of the blocks of its
own; `reached` says what shares, passes and entropy the drawn tokens have.
Blocks lie in super-blocks: running sums go over a source's super-blocks, over the blocks of one, then inside a
block, so that no task sees a whole source.

Defined results: a null source is a source of its own; null or empty text counts no tokens and is
kept once; repeated rows count each; extra columns are kept, those named as added ones are replaced; no rows
give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesflow.llm.common import as_row, saved, whole_text

#: Documents of a block, and blocks of a super-block, on average.
BLOCK_DOCS, SUPER_BLOCKS = 2048, 1024
#: Columns that `mix` adds; columns of these names are replaced.
ADDED = ["n_tokens", "weight", "copies", "draw"]
#: Parts of the bracket that one aggregation tells apart: five halvings. It is narrowed to the spacing of floats below 1.
GRID, NARROWEST = 32, 2.0**-53


def n_tokens(column: str = "text") -> Column:
    """Words of a text: runs without the six ASCII white-space characters."""
    return F.regexp_count(whole_text(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_totals(sized: DataFrame) -> DataFrame:
    """source, docs, tokens; hot sources are summed in each task first."""
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")).filter("tokens > 0")


def _evaluate(totals: DataFrame, exponents: list[float], budget: float, whole: int) -> list[dict]:
    """For each exponent: entropy of the weights and the largest number of passes over a source."""
    share = F.col("tokens") / F.lit(float(whole))
    grid = totals.select("tokens", share.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("u", F.pow("p", "a"))
    sums = grid.groupBy("a").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("ulogu"), F.max(F.col("u") / F.col("tokens")).alias("top"))
    rows = sums.select("a", (F.log("z") - F.col("ulogu") / F.col("z")).alias("entropy"), (F.col("top") * budget / F.col("z")).alias("passes"))
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["a"])  # GRID + 1 rows


def find_exponent(totals: DataFrame, *, target_entropy: float | None, max_repeats: float, budget: float) -> tuple[float, float]:
    """The exponent and the budget that hold both limits; see the module's text."""
    whole, sources = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not whole or sources < 2:
        return 1.0, min(budget, max_repeats * (whole or 0))
    if target_entropy is None:
        wanted = lambda r: r["passes"] > max_repeats * (1 + 1e-12)  # noqa: E731  as the exponent falls, passes grow
    else:
        goal = target_entropy * math.log(sources)
        wanted = lambda r: r["entropy"] >= goal - 1e-12  # noqa: E731  as the exponent falls, entropy grows
    low, high = 0.0, 1.0
    while high - low > NARROWEST:
        step = (high - low) / GRID
        rows = _evaluate(totals, sorted({*(low + step * k for k in range(GRID)), high}), budget, whole)
        last = max((k for k, r in enumerate(rows) if wanted(r)), default=None)
        if last is None or last == len(rows) - 1:  # only at the ends of [0, 1]
            low = high = rows[last or 0]["a"]
            break
        low, high = rows[last]["a"], rows[last + 1]["a"]
    exponent = high if target_entropy is None else low
    [r] = _evaluate(totals, [exponent], budget, whole)
    return exponent, budget * min(1.0, max_repeats / r["passes"])


def filled_level(totals: DataFrame, u: Column, *, max_repeats: float, budget: float) -> float:
    """The level at which sources of min(max_repeats * tokens, level * u) tokens use up the budget.

    Newton's steps on a sum that is concave and piecewise linear rise to it and end after finitely many, each one
    aggregation over the sources.
    """
    cap, level = F.col("tokens") * F.lit(float(max_repeats)), 0.0
    while True:
        over = u * F.lit(level) >= cap
        free, taken = totals.agg(F.sum(F.when(~over, u)), F.sum(F.when(over, cap))).first()
        if not free:  # every source is clipped
            return math.inf
        risen = (budget - (taken or 0.0)) / free
        if risen <= level * (1 + 1e-12):
            return level
        level = risen


def mix(docs: DataFrame, *, target_entropy: float | None = 0.98, max_repeats: float = 1.0, budget_share: float = 1.0, seed: int = 17, fill: bool = False) -> DataFrame:
    """Every document with n_tokens, weight (of its source), copies (0 or more) and draw (its place
    among its source's permuted blocks, for the last, partial epoch).

    budget_share: tokens wanted, as a part of all tokens. fill: clip sources over the limit, see the module's text.
    """
    rows = docs.select(as_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens().alias("n_tokens"), F.xxhash64("doc_id", whole_text(), F.lit(seed)).alias("key"))
    small = saved(rows.select("source", F.col("key").alias("_key"), "n_tokens", "doc_id"))
    drawn = draw(small, target_entropy=target_entropy, max_repeats=max_repeats, budget_share=budget_share, seed=seed, fill=fill)
    # repeated rows are alike in both columns and share one decision
    found = drawn.groupBy(F.col("doc_id").alias("d"), F.col("_key").alias("k"), F.col("source").alias("s")).agg(*(F.min(c).alias(c) for c in ("weight", "copies", "draw")))
    met = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & rows["source"].eqNullSafe(F.col("s")))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return met.select(*kept, *ADDED)


def draw(sized: DataFrame, *, target_entropy: float | None, max_repeats: float, budget_share: float, seed: int, fill: bool = False) -> DataFrame:
    """The decisions over rows (doc_id, source, n_tokens, _key): adds weight, copies, draw."""
    totals = saved(source_totals(sized))
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    exponent, budget = find_exponent(totals, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget_share * whole)
    u = F.pow(F.col("tokens") / F.lit(float(whole or 1)), F.lit(exponent))
    z = totals.agg(F.sum(u)).first()[0] or 1.0
    share = F.lit(budget) * u / F.lit(z)
    if fill:
        cap, level = F.col("tokens") * F.lit(float(max_repeats)), filled_level(totals, u, max_repeats=max_repeats, budget=float(budget_share * whole))
        share = cap if math.isinf(level) else F.least(cap, F.lit(level) * u)
    quota = F.floor(share + F.lit(1e-6)).cast("long")
    plan = totals.select(F.col("source").alias("_s"), (u / F.lit(z)).alias("weight"), F.floor(quota / F.col("tokens")).cast("int").alias("epochs"), (quota % F.col("tokens")).alias("left"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("int").alias("blocks"))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("_key", F.lit(1)), F.coalesce("blocks", F.lit(1))).cast("int"))
    # the permutation of the last epoch: super-blocks by keyed hash, then their blocks, then documents of a block
    supers = F.ceil(F.coalesce(F.max("blocks"), F.lit(1)) / SUPER_BLOCKS)
    blocks = saved(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), supers.alias("supers")).withColumns({"super": F.pmod(F.xxhash64("block", F.lit(seed), F.lit(3)), "supers"), "turn": F.xxhash64("source", "block", F.lit(seed), F.lit(2))}))
    whole_ones = blocks.groupBy("source", "super").agg(F.sum("block_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    in_source = Window.partitionBy("source").orderBy(F.xxhash64("source", "super", F.lit(seed), F.lit(4)), "super").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole_ones.select(F.col("source").alias("_ss"), F.col("super").alias("_sb"), F.coalesce(F.sum("t").over(in_source), F.lit(0)).alias("t"), F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("n"))
    in_super = Window.partitionBy("source", "super").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"before": F.coalesce(F.sum("block_tokens").over(in_super), F.lit(0)), "place": F.count(F.lit(1)).over(in_super)})
    blocks = blocks.join(bases, F.col("source").eqNullSafe(F.col("_ss")) & (F.col("super") == F.col("_sb")))
    blocks = blocks.select(F.col("source").alias("_bs"), F.col("block").alias("_b"), (F.col("t") + F.col("before")).alias("block_before"), (F.col("n") + F.col("place")).alias("block_place"))
    inside = Window.partitionBy("source", "block").orderBy("_key", "doc_id")
    before = F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = rows.withColumns({"_before": before, "_place": F.row_number().over(inside)})
    met = inner.drop("blocks").join(blocks, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("block") == F.col("_b")))
    partial = (F.col("block_before") + F.col("_before") < F.col("left")).cast("int")
    copies = F.when(F.col("n_tokens") == 0, F.lit(1)).otherwise(F.coalesce(F.col("epochs") + partial, F.lit(0)))
    return met.select("doc_id", "source", "n_tokens", "_key", F.coalesce("weight", F.lit(0.0)).alias("weight"), copies.cast("int").alias("copies"), (F.col("block_place") * (1 << 32) + F.col("_place")).alias("draw"))


def mixed_documents(docs: DataFrame, **limits) -> DataFrame:
    """The drawn documents with the columns of `docs`: a row for each copy."""
    held = docs.select(as_row(docs), "doc_id", "text", "source")
    drawn = mix(held, **limits).filter("copies > 0")
    times = drawn.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return times.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def epoch_rows(mixed: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of `mix`, one for each copy, with epoch (from 0) and turn: along (epoch, turn, draw) each epoch of a source reads
    its blocks in a permutation of its own, and each block as a whole. Rows without copies go; columns of these names are replaced.

    A keyed hash of the block and the epoch is the turn, so no window or shuffle is needed to permute.
    """
    rows = mixed.drop("epoch", "turn").filter("copies > 0")
    copies = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    block = F.shiftright(F.col("draw"), 32)  # the block's place in the order of `draw`
    return copies.withColumn("turn", F.xxhash64("source", block, "epoch", F.lit(seed)))


def reached(mixed: DataFrame) -> DataFrame:
    """What was drawn, a row for each source with tokens: source, weight, tokens, drawn, passes (drawn by tokens), share (of all
    drawn tokens) and entropy (of all shares, as a part of that of equal ones; the same in each row, 1 for a single source).

    With `fill` and clipped sources the entropy may miss the target; here it is what came of it. Nothing drawn: share and entropy NULL.
    """
    sums = mixed.groupBy("source").agg(F.max("weight").alias("weight"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn")).filter("tokens > 0")
    # -sum(p log p) over p = d / D is log D - sum(d log d) / D: one aggregation over the sources
    d = F.col("drawn").cast("double")
    part = F.when(d > 0, d * F.log(F.when(d > 0, d))).otherwise(0.0)
    whole = sums.agg(F.sum(d).alias("_all"), F.sum(part).alias("_part"), F.count(F.lit(1)).alias("_n"))
    found = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.try_divide(F.log("_all") - F.try_divide("_part", "_all"), F.log("_n")))
    entropy = F.when(F.col("_all") > 0, found)
    return sums.crossJoin(whole).select("source", "weight", "tokens", "drawn", (d / F.col("tokens")).alias("passes"), F.try_divide(d, F.col("_all")).alias("share"), entropy.alias("entropy"))
