"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document gets a rate between 0 and 2 (how often the mix takes it). Among all rates that bring each
source's words to its target, those nearest to 1 in the entropy of the interval (0, 2) are wanted; the
dual of that problem is convex with one unknown per source, and its rates are tilted exponentially:
rate = 2 / (1 + exp(-lambda * size / scale)). Newton steps on the dual need two sums per source; they run
as aggregations over a histogram of (source, size), which is all that a rate depends on, and are kept
inside a shrinking bracket. Sources whose target is twice their size take every document twice.

Rounding: copies = floor(rate + u + shift) within 0..2, u a uniform hash of the document. The words taken
grow with the shift, so each source's shift is found by a search on whole numbers: first for documents
that alone are more than 1/LARGE of the target, then for the others, which make up what the large ones miss.

What is per source (total, target, lambda, shifts) is a table, never a list on the driver; it is broadcast
only if it has few rows. Aggregations combine within tasks first, so a source with a third of all rows is
no hot spot, and texts are never shuffled.

Edge cases: a null text has size 0; null is a source of its own, last in order; documents without words
are taken by the rule but add nothing; a source without words has target 0; repeated rows are decided
alike; other columns are not read by plan() and are kept by copies(); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerproof.session import broadcast_if_small, materialise

WEIGHTS = (3, 1, 2)
# The mix's words per hundred words of the input.
SHARE = 150
# A document takes part at most so often.
MOST = 2
LARGE = 64
# Newton steps between two looks at the largest error, looks at most, and the relative error that is enough.
STEPS, LOOKS, ENOUGH = 4, 8, 1e-9
# Each pass of a shift's search cuts the interval into so many pieces.
PIECES, PASSES = 16, 4

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sources_of(cells: DataFrame) -> DataFrame:
    """source, place, source_size, target: one row per source, targets by filling up to MOST times the size."""
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"))
    every = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("place") - 1) % len(WEIGHTS) + 1)).withColumn("top", F.col("source_size") * float(MOST))
    ranked = ranked.withColumn("wanted", F.sum("source_size").over(every) * (SHARE / 100)).withColumn("weights", F.sum("weight").over(every))
    # In order of top / weight, a source is full if the level reached with all sources before it full is above its top.
    before = Window.orderBy(F.col("top") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("wanted") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("full", level * F.col("weight") >= F.col("top"))
    full_top, full_weight = (F.coalesce(F.sum(F.when(F.col("full"), F.col(c))).over(every), F.lit(0.0)) for c in ("top", "weight"))
    final = (F.col("wanted") - full_top) / (F.col("weights") - full_weight)
    target = F.when(F.col("full"), F.col("top")).otherwise(F.least("top", final * F.col("weight")))
    scale = F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(1.0)
    return ranked.select("source", "place", "source_size", "full", target.alias("target"), scale.alias("scale"))


def rate(lam: Column, size: Column, scale: Column, full: Column) -> Column:
    return F.when(full, F.lit(float(MOST))).otherwise(F.round(MOST / (1 + F.exp(-lam * size / scale)), 9))


def newton(cells: DataFrame, state: DataFrame, small: int) -> DataFrame:
    """One step for every source: lambda, and the bracket low..high it moves in."""
    x, c = F.col("size") / F.col("scale"), F.col("size") * F.col("n")
    s = 1 / (1 + F.exp(-F.col("lam") * x))
    own = [F.first(k).alias(k) for k in ("target", "scale", "full", "lam", "low", "high")]
    next_ = cells.join(broadcast_if_small(state.drop("error"), small), "place").groupBy("place").agg(F.sum(MOST * c * s).alias("got"), F.sum(MOST * c * x * s * (1 - s)).alias("slope"), *own)
    over = F.col("got") > F.col("target")
    low, high = F.when(over, F.col("low")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("high"))
    step = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
    inside = (F.col("slope") > 0) & (step > low) & (step < high)
    error = F.when(F.col("full") | (F.col("target") <= 0), 0.0).otherwise(F.abs(F.col("got") / F.col("target") - 1))
    lam = F.when(error <= ENOUGH, F.col("lam")).when(inside, step).otherwise((low + high) / 2)
    return next_.select("place", "target", "scale", "full", lam.alias("lam"), low.alias("low"), high.alias("high"), error.alias("error"))


def solve(cells: DataFrame, sources: DataFrame, small: int) -> DataFrame:
    """place, lam of every source."""
    state = sources.select("place", "target", "scale", "full", F.lit(0.0).alias("lam"), F.lit(-2000.0).alias("low"), F.lit(2000.0).alias("high"), F.lit(1.0).alias("error"))
    for _ in range(LOOKS):
        for _ in range(STEPS):
            state = newton(cells, state, small)
        state = materialise(state, "dual")
        if (state.agg(F.max("error")).first()[0] or 0.0) <= ENOUGH:
            break
    return state.select("place", F.round("lam", 10).alias("lam"))


def rounded(shift: str) -> str:
    return f"cast(least(greatest(floor(rate + u + {shift}), 0), {MOST}) as bigint)"


def shifts(rows: DataFrame, wanted: DataFrame, small: int, name: str) -> DataFrame:
    """place, shift: per source with rows the shift with which the words of `rows` (place, size, rate, u) come nearest to `wanted`."""
    state = wanted.selectExpr("place", "words", "-1D as low", "1D as high")
    at = [f"(low + (high - low) * {k} / {PIECES})" for k in range(PIECES + 1)]
    for i in range(PASSES):
        sums = [F.expr(f"sum(size * {rounded(t)})").alias(f"sum_{k}") for k, t in enumerate(at)]
        own = [F.first(k).alias(k) for k in ("words", "low", "high")]
        state = rows.join(broadcast_if_small(state, small), "place").groupBy("place").agg(*sums, *own)
        if i < PASSES - 1:
            below = " + ".join(f"int(sum_{k} <= words)" for k in range(1, PIECES))
            state = state.selectExpr("place", "words", f"low + (high - low) / {PIECES} * ({below}) as start", f"(high - low) / {PIECES} as width")
            state = state.selectExpr("place", "words", "start as low", "start + width as high")
    nearest = ", ".join(f"struct(abs(sum_{k} - words) as miss, abs({t}) as near, {t} as shift)" for k, t in enumerate(at))
    return materialise(state.selectExpr("place", f"array_min(array({nearest})).shift as shift"), name)


def prepared(rows: DataFrame, sources: DataFrame, small: int) -> DataFrame:
    """doc_id, source and size joined with their source's row; rate and u added."""
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("size")), F.lit(1 << 53)) / float(1 << 53)
    own = sources.withColumnRenamed("source", "__mix_source")
    joined = rows.join(broadcast_if_small(own, small), F.col("source").eqNullSafe(F.col("__mix_source"))).drop("__mix_source")
    return joined.withColumns({"rate": rate(F.col("lam"), F.col("size"), F.col("scale"), F.col("full")), "u": u})


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Sized rows (doc_id, source, size), the sources with what decides their documents' copies, and their number."""
    sized = materialise(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "sizes")
    cells = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = materialise(sources_of(cells), "sources")
    small = sources.count()
    own = sources.select(F.col("source").alias("__mix_source"), "place")
    cells = materialise(cells.join(broadcast_if_small(own, small), F.col("source").eqNullSafe(F.col("__mix_source"))).select("place", "size", "n"), "cells")
    sources = materialise(sources.join(solve(cells, sources, small), "place"), "tilted")
    rows = prepared(sized, sources, small).select("place", "size", "rate", "u", "target")
    is_large = F.col("size") * LARGE > F.col("target")
    large = materialise(rows.filter(is_large), "large")
    expected = large.groupBy("place").agg(F.sum(F.col("size") * F.col("rate")).alias("words"))
    first = shifts(large, expected, small, "shift_large")
    taken = large.join(broadcast_if_small(first, small), "place").groupBy("place").agg(F.expr(f"sum(size * {rounded('shift')})").alias("taken"))
    left = sources.join(taken, "place", "left").select("place", (F.col("target") - F.coalesce(F.col("taken"), F.lit(0))).alias("words"))
    second = shifts(rows.filter(~is_large), left, small, "shift_small")
    both = sources.join(first.withColumnRenamed("shift", "shift_large"), "place", "left").join(second.withColumnRenamed("shift", "shift_small"), "place", "left")
    return sized, materialise(both.fillna(0.0, ["shift_large", "shift_small"]), "mix"), small


def decide(rows: DataFrame, sources: DataFrame, small: int) -> DataFrame:
    """rows (doc_id, source, size and any others) with source_size, target, rate, copies."""
    out = prepared(rows, sources, small)
    shift = f"(case when size * {LARGE} > target then shift_large else shift_small end)"
    copies = F.expr(f"case when full then {MOST}L else {rounded(shift)} end")
    return out.withColumn("copies", copies).drop("u", "place", "scale", "full", "lam", "shift_large", "shift_small")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every document."""
    sized, sources, small = plan(docs)
    return decide(sized, sources, small).withColumn("taken", F.col("size") * F.col("copies"))


def copies(docs: DataFrame) -> DataFrame:
    """The mix: every row of docs as often as it is taken, with its own columns. Texts are not shuffled."""
    _, sources, small = plan(docs)
    whole = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row"))
    taken = decide(whole, sources, small).filter("copies > 0")
    return taken.select("__mix_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__mix_copy")).select("__mix_row.*")
