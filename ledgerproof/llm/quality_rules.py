"""Quality rules whose cutoffs keep the share of good documents they reject under control.

Base rules are fixed. Further statistics of a text (RULES) get a cutoff each, per stratum (a band of the
number of words), from labelled rows that pass the base rules:

1. Half of the labelled rows proposes: for each LEVEL, every rule's cutoff is the point that at most this
   share of the half's good documents exceed, read off a histogram of fixed bins over all of them.
2. The other half certifies, going from the mildest level to the strictest: a level is accepted if, were
   the true share of rejected good documents above RISK, so few rejections as seen would have a probability
   of at most CONFIDENCE / number of strata (exact binomial tail; the division corrects for the strata, and
   a fixed order that stops at the first failure needs no further correction). Of the accepted levels the
   last holds; without one, the stratum's rules reject nothing.

So with probability 1 - CONFIDENCE no stratum's rules reject more than RISK of its good documents. Counts
come from all labelled rows; what reaches the driver is a table of strata x rules x bins.

Edge cases: a null text has no words and fails the base rules; a null doc_id has no label; repeated labels
count once, and so do repeated doc_ids in a stratum; other columns are not read by judged() and are kept by keep_good(); an empty table, or
no labels, gives base rules only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.llm.parts import byte_slices, give_back, then_give_back
from ledgerproof.llm.ship import ship
from ledgerproof.session import materialise

# Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED_PER_CENT, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# Lower ends of the strata, in words.
STRATA = (20, 100, 400)
# Statistics and the value of their last bin's lower edge.
RULES = {"symbol_share": 1.0, "capital_share": 1.0, "mark_share": 1.0, "repeat_share": 1.0, "dup_line_share": 1.0, "word_length": 64.0, "commonest_share": 1.0}
BINS = 512
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005)
RISK, CONFIDENCE = 0.02, 0.05

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{r} double" for r in RULES)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more. Windows are numbered by doubling: pairs, pairs of pairs, ..."""
    n = len(words)
    if n <= window:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    if len(number) == n:
        return 0
    codes = np.fromiter(map(number.__getitem__, words), np.int64, n)
    width = 1
    while width < window:
        step = min(width, window - width)
        joined = codes[: len(codes) - step] * np.int64(len(codes) + 1) + codes[step:]
        distinct, codes = np.unique(joined, return_inverse=True)
        width += step
        if len(distinct) == len(codes):
            return 0
    starts = np.flatnonzero(np.bincount(codes)[codes] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def measure(text: str) -> tuple:
    """COUNTS and RULES of a text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    lines = dups = 0
    for line in text.split("\n") if "\n" in text else (text,):
        if line.strip(BLANKS):
            lines += 1
            dups += line in seen
            seen.add(line)
    repeated = repeated_words(words)
    if not n:
        return (0, 0, symbols, dups, 0, *[0.0] * len(RULES))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    commonest = max(Counter(words).values())
    return (n, chars, symbols, dups, repeated, symbols / chars, capitals / chars, text.count("!") / chars, repeated / n, dups / lines, chars / n, commonest / n)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and RULES of every whole text."""
    ship(docs.sparkSession)
    names = [f.split()[0] for f in MEASURED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in byte_slices(batches):
            columns = list(zip(*map(measure, texts), strict=True))
            arrays = [pa.array(c, pa.int64() if i < len(COUNTS) else pa.float64()) for i, c in enumerate(columns)]
            yield pa.record_batch([batch.column("doc_id"), *arrays], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(then_give_back(run), MEASURED)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PER_CENT * F.col("n_words"))


def stratum() -> F.Column:
    out = F.lit(0)
    for i, start in enumerate(STRATA[1:], 1):
        out = F.when(F.col("n_words") >= start, i).otherwise(out)
    return out


def bin_of(rule: str) -> F.Column:
    return F.least(F.floor(F.col(rule) / RULES[rule] * BINS), F.lit(BINS - 1)).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) with probability p each; 1.0 for a k above the mean, where it is about a half or more.

    Terms are added from the largest on, until they no longer count."""
    if k >= n or k > p * n:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = 0.0
    for i in range(k, -1, -1):
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        if term < 1e-18 * total:
            break
    return min(1.0, total)


def exceeds(cutoffs: dict[int, dict[str, int]]) -> F.Column:
    """Does any rule's bin lie above its stratum's cutoff?"""
    out = F.lit(False)
    for s, own in cutoffs.items():
        for rule, cutoff in own.items():
            out = out | ((stratum() == s) & (bin_of(rule) > cutoff))
    return out


def cutoffs(measured: DataFrame, labels: DataFrame) -> dict[int, dict[str, int]]:
    """Per stratum the certified cutoffs, as bins; a stratum without a certified level is missing."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    labelled = measured.filter(~base_failed()).join(good, "doc_id").withColumn("stratum", stratum())
    # A doc_id is one document of a stratum, however often it stands there.
    bins = F.struct(*[bin_of(r) for r in RULES])
    labelled = labelled.groupBy("doc_id", "stratum").agg(*[F.min_by(c, bins).alias(c) for c in ("n_words", *RULES)])
    labelled = labelled.withColumns({"proposes": F.pmod(F.crc32(F.concat(F.lit("half "), F.col("doc_id").cast("string"))), F.lit(2)) == 0})
    labelled = materialise(labelled, "labelled")
    # stack: one row per rule
    rules = ", ".join(f"'{r}', cast(least(floor({r} / {RULES[r]} * {BINS}), {BINS - 1}) as int)" for r in RULES)
    histogram = labelled.filter("proposes").selectExpr("stratum", f"stack({len(RULES)}, {rules}) as (rule, bin)").groupBy("stratum", "rule", "bin").count().collect()
    proposals: dict[int, list[dict[str, int]]] = {}
    for s in range(len(STRATA)):
        own: dict[str, np.ndarray] = {r: np.zeros(BINS, np.int64) for r in RULES}
        for row in histogram:
            if row["stratum"] == s:
                own[row["rule"]][row["bin"]] = row["count"]
        proposals[s] = []
        for level in LEVELS:
            # above[b]: good documents beyond bin b
            above = {r: h.sum() - np.cumsum(h) for r, h in own.items()}
            proposals[s].append({r: int(np.flatnonzero(a <= level * own[r].sum())[0]) for r, a in above.items()})
    tests = [F.sum(exceeds({s: proposals[s][i] for s in proposals}).cast("long")).alias(f"level_{i}") for i in range(len(LEVELS))]
    seen = {r["stratum"]: r for r in labelled.filter("not proposes").groupBy("stratum").agg(F.count("*").alias("n"), *tests).collect()}
    out = {}
    for s, row in seen.items():
        for i in range(len(LEVELS)):
            if binomial_tail(row[f"level_{i}"], row["n"], RISK) > CONFIDENCE / len(STRATA):
                break
            out[s] = proposals[s][i]
    return out


def verdicts(measured: DataFrame, certified: dict[int, dict[str, int]]) -> DataFrame:
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~exceeds(certified))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, RULES, base_failed, kept of every row."""
    measured = materialise(measures(docs), "measures")
    return verdicts(measured, cutoffs(measured, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns; texts are measured in place and not shuffled."""
    certified = cutoffs(materialise(measures(docs), "measures"), labels)
    ship(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], ["text"])
        out = pa.array([passes(measure(t), certified) for _, own in byte_slices([batch]) for t in own], pa.bool_())
        give_back()
        return out

    # Only the verdicts come back from Python; the rows wait in the JVM.
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return docs.filter(F.arrow_udf(run, "boolean")("text"))


def passes(measured: tuple, certified: dict[int, dict[str, int]]) -> bool:
    """The verdict on one measured text, as verdicts() gives it."""
    n, repeated = measured[0], measured[4]
    if n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PER_CENT * n:
        return False
    own = certified.get(max(i for i, start in enumerate(STRATA) if n >= start), {})
    values = dict(zip(RULES, measured[len(COUNTS) :], strict=True))
    return all(min(math.floor(values[r] / RULES[r] * BINS), BINS - 1) <= cutoff for r, cutoff in own.items())
