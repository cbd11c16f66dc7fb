"""Token-id output: files of concatenated ids with Elias-Fano coded document boundaries.

One row of the file is a shard: documents in ascending doc_id order, their ids (little-endian,
2 bytes each where the vocabulary has at most 65,536 ids, else 4) in one array, and the boundaries
0 = b0 <= b1 <= ... <= bn as an Elias-Fano code: each value's low bits packed, the high bits as
unary gaps in a bit vector, whose select structure holds the place of every SAMPLE-th one. A lookup
reads one sample, a bounded stretch of the bit vector and one low part; there is no table of 64-bit
offsets. doc_ids of a shard are stored the same way, as distances from the first. Shards are rows of
a columnar table, so that any storage Spark writes to will do, and Spark's commit makes the write
whole or absent when executors are lost.

Order over all shards comes from a range partitioning on doc_id before encoding; a shard's first
offset is the sum of the ids of the shards before it.

Edge cases: a null text counts as empty (only the end id); a null doc_id goes first and stays null;
repeated doc_ids stay, in the order of their texts; other columns are not read; an empty table
gives a file without shards. Ids of a document never straddle shards; a very long document makes
one large shard of its own.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerproof.llm.parts import WordEncoder, text_slices
from ledgerproof.llm.ship import ship
from ledgerproof.session import broadcast_if_small

# Ids of a shard are at most so many, unless one document alone has more.
SHARD_IDS = 4_000_000
# Every so many set bits have their place stored.
SAMPLE = 64

SHARDS = "partition int, shard int, n_docs long, n_ids long, width int, ids binary, bounds binary, first_doc_id long, n_null_ids long, doc_ids binary"


# -- Elias-Fano


def ef_encode(values: np.ndarray) -> bytes:
    """Code of ascending values >= 0: counts, the select samples, the low parts, the high bit vector."""
    v = np.asarray(values, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = v & np.uint64((1 << low_bits) - 1)
    ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    planes = (low[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    low_bytes, high_bytes = np.packbits(planes.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    samples = ones[::SAMPLE].astype("<u4").tobytes()
    return np.array([n, low_bits, len(low_bytes), len(high_bytes)], "<u4").tobytes() + samples + low_bytes + high_bytes


class EliasFano:
    """Random access to the values of a code."""

    def __init__(self, code: bytes):
        self.n, self.low_bits, n_low, n_high = (int(x) for x in np.frombuffer(code, "<u4", 4))
        at = 16
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(code, "<u4", n_samples, at)
        at += 4 * n_samples
        self.low = np.frombuffer(code, np.uint8, n_low, at)
        self.high = np.frombuffer(code, np.uint8, n_high, at + n_low)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """select1(i): from the nearest sample before it, then the value's low part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = 8 * byte + (bits & -bits).bit_length() - 1
        start = i * self.low_bits
        window = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little")
        return (place - i) << self.low_bits | window >> (start & 7) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1, dtype=np.int64)


# -- writing


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    tokenize, letters = tokenizer.model.tokenize, byte_letters()

    def merge(piece: str) -> bytes:
        """The library's model on one piece, in the letters its byte-level pre-tokenizer writes bytes with."""
        return array("I", [t.id for t in tokenize(piece.encode().decode("latin-1").translate(letters))]).tobytes()

    def whole(text: str) -> bytes:
        return array("I", tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    return WordEncoder(merge, whole)


def byte_letters() -> dict[int, str]:
    """Byte -> letter: printable bytes are themselves, the others follow from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def id_width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def shard_row(partition: int, shard: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> tuple:
    """ids: uint32 of each document."""
    bounds = np.concatenate([[0], np.cumsum([len(x) >> 2 for x in ids])])
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    flat = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    return (partition, shard, len(ids), int(bounds[-1]), width, flat, ef_encode(bounds), first, len(doc_ids) - len(known), ef_encode(known - first))


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, partitions: int | None = None) -> None:
    """Encode every whole text, append end_id, and write the shards to the folder `out`, ordered by doc_id.

    tokenizer: a file of the tokenizers library that every executor has.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in SHARDS.split(", ")]
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, size = TaskContext.get().partitionId(), 0, 0
        encode, width, end = encoder(tokenizer), id_width(tokenizer), np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        schema = pa.schema([("partition", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()), ("first_doc_id", pa.int64()), ("n_null_ids", pa.int64()), ("doc_ids", pa.binary())])

        def flush() -> pa.RecordBatch:
            row = shard_row(part, shard, doc_ids, ids, width)
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], names)

        for batch, texts in text_slices(batches):
            for doc_id, code in zip(batch.column("doc_id").to_pylist(), map(encode.encode, texts), strict=True):
                code += end
                if ids and size + (len(code) >> 2) > SHARD_IDS:
                    yield flush()
                    shard, size, doc_ids, ids = shard + 1, 0, [], []
                doc_ids.append(doc_id)
                ids.append(code)
                size += len(code) >> 2
        if ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first())
    # Ids compress poorly beyond their width: a fast codec will do.
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(out)


# -- reading


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Shards with the offset of their first id. The running sum is over one row of numbers per shard (SHARD_IDS ids)."""
    order = Window.orderBy("partition", "shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(path).select("partition", "shard", "n_ids").select("partition", "shard", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("shard_start"))


DOCUMENTS = "doc_id long, start long, n_tokens long, token_ids binary"


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, token_ids (little-endian uint32) of every document in the shards of a folder."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bounds = EliasFano(row["bounds"]).values()
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                known = EliasFano(row["doc_ids"]).values() + row["first_doc_id"]
                doc_ids = pa.array([None] * row["n_null_ids"] + known.tolist(), pa.int64())
                cut = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch([doc_ids, pa.array(row["shard_start"] + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "token_ids"])

    shards = spark.read.parquet(path)
    # Three numbers per shard; without the hint the ids would be shuffled to meet them.
    starts = broadcast_if_small(shard_starts(spark, path), shards.count())
    shards = shards.join(starts, ["partition", "shard"])
    return shards.mapInArrow(run, DOCUMENTS)


