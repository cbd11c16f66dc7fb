"""Spelling variants by permuterm rotations.

Words are the maximal runs of Latin letters of all texts (`counted`). Two are near if one inserted, deleted or
replaced code point turns one into the other. Every word is closed with a mark and rotated at every place; what
stands before a place then stands last. Leaving the last character of a rotation out skips one character of the word,
so

* two words that differ in a replaced character agree, rotated behind it, in all but the last character;
* a word that has one character more than another agrees, without it, with a whole rotation of the other.

So a group of equal prefixes holds at most one whole rotation (it names its word) and one cut one per letter of the
alphabet: no group has more than LETTERS + 1 members, whatever the corpus. Groups come together by a sorted shuffle,
and each member leaves with the number of its partners and the best of them; pairs are not written out. A pair is
met once: a deletion inside a run of equal letters counts at the run's first letter only.

`roots` follows forms by pointer doubling: what a word points to takes over what that one points to, so a chain of
any length is followed in logarithmically many joins.

Edge cases: a null or empty text has no words; a null doc_id reads as an empty string in the checksum; repeated rows
count as often as they stand there; ties go to the first word in code-point order; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.llm.parts import text_slices
from ledgerproof.llm.ship import ship
from ledgerproof.session import materialise

# The letters of a word, and which runs lose one.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGED = 97
MARK = "$"
LETTERS = 26 + 64  # A-Z are in lower case
SHORTEST, LEAST_COUNT, LEAST_RATIO = 5, 3, 2
# Words that a task counts before it hands them on.
HELD = 300_000


def runs(doc_id: object, text: str) -> Iterator[tuple[str, int]]:
    """The runs of a text, each once with its count, some of them a letter short."""
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def counted(docs: DataFrame) -> DataFrame:
    """word, n of every word of at least SHORTEST code points that stands LEAST_COUNT times or more in all texts."""
    ship(docs.sparkSession)

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch, texts in text_slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                for word, n in runs(doc_id, text):
                    if len(word) >= SHORTEST:
                        counts[word] += n
                if len(counts) > HELD:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    words = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


# What a rotation is: the whole word, or one without the character that stood last; of a run of equal letters only the
# first may be left out against a shorter word.
WHOLE, CUT, CUT_FIRST = 0, 1, 2


def rotations(words: DataFrame) -> DataFrame:
    """key, word, n, kind: all whole and all cut rotations of words (word, n)."""
    whole = f"transform(sequence(0, size), i -> struct(concat(substr(word, i + 1), '{MARK}', substr(word, 1, i)) AS key, {WHOLE} AS kind))"
    first = "i = 0 OR substr(word, i + 1, 1) <> substr(word, i, 1)"
    cut = f"transform(sequence(0, size - 1), i -> struct(concat(substr(word, i + 2), '{MARK}', substr(word, 1, i)) AS key, if({first}, {CUT_FIRST}, {CUT}) AS kind))"
    return words.withColumn("size", F.length("word")).selectExpr("word", "n", f"inline(concat({whole}, {cut}))")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (more: its n below zero; word): partners of every word that has one."""
    groups = rotations(words).groupBy("key").agg(F.collect_list(F.struct((-F.col("n")).alias("less"), "word", "kind")).alias("members")).filter("size(members) > 1")
    met = f"o.word <> m.word AND (least(o.kind, m.kind) >= {CUT} OR greatest(o.kind, m.kind) = {CUT_FIRST})"
    partners = f"transform(filter(members, o -> {met}), o -> struct(o.less, o.word))"
    found = groups.select(F.expr(f"inline(transform(members, m -> struct(m.word AS word, {partners} AS partners)))"))
    found = found.filter("size(partners) > 0").select("word", F.size("partners").cast("long").alias("n_near"), F.array_min("partners").alias("best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form), which must not lead in a circle."""
    here = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = here.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = here.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = materialise(moved, "roots")
        here = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return here


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word: its near words counted, and the one it is a variant of, the
    most frequent of them if that stands at least LEAST_RATIO times as often."""
    words = materialise(counted(docs), "words")
    rows = words.join(neighbours(words), "word", "left")
    form_n = -F.col("best.less")
    is_form = F.col("best").isNotNull() & (form_n >= LEAST_RATIO * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, form_n).alias("form_n"))
    rows = materialise(rows, "forms")
    found = roots(rows.filter("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
