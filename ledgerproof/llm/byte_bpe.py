"""Byte-level BPE encoding and decoding with a rank file.

Every match of the splitting pattern is a row of byte ids. Rows are bucketed by length and padded
to one width, and each round merges in every row its leftmost pair of lowest rank, found in a table
of rank values kept beside the ids; ranks of pairs come from a hashed table. Rows without a pair
left are taken out (compaction). A match longer than LONG_PIECE bytes would make a round as wide as
itself; those use a heap with the same order of merges.

Edge cases: a null text counts as empty (no ids, no bytes); a null doc_id stays null; repeated rows
give repeated results; other columns of the input, whatever their names, are not read; an empty
table gives an empty result. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerproof.llm.parts import PartEncoder, byte_slices, text_slices, then_give_back
from ledgerproof.llm.ship import ship

LONG_PIECE = 256
# Widths of the padded matrices.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, LONG_PIECE)
# Parts, and pieces, whose ids a worker keeps (about 200 bytes each).
KEPT = 200_000
# Rows of one matrix.
MATRIX_ROWS = 5_000
NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)

ENCODED = "doc_id long, token_ids binary, decoded binary"
CHECKED = "doc_id long, token_ids binary, decoded_equal boolean"


class PairTable:
    """Open addressing: (left id, right id) -> rank of the merged token."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, EMPTY, np.uint64), np.full(size, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self.slot(keys)
        while len(keys):
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays, the others go on
            placed = self.keys[at] == keys
            self.ranks[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) & (size - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NONE where the pair doesn't merge or a side is padding (negative)."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).astype(np.uint64)
        at = self.slot(keys)
        seen = self.keys[at]
        out = np.where(seen == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != EMPTY))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.keys) - 1)
            seen = self.keys[at]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            more = ~hit & (seen != EMPTY)
            open_, at = open_[more], at[more]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = ranks
        self.pattern = regex.compile(pattern)
        self.pair_ranks = {
            (ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.pairs = PairTable(self.pair_ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_id = sorted((r, t) for t, r in ranks.items())
        top = by_id[-1][0] + 1
        self.lengths = np.zeros(top, np.int64)
        for r, t in by_id:
            self.lengths[r] = len(t)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drop the caches of parts."""
        self.parts = PartEncoder(self.encode_matches, self.encode_strings, KEPT)

    # -- encoding

    def merge_matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        """Ids of rows of at most `width` bytes."""
        n = len(rows)
        length = np.fromiter(map(len, rows), np.int64, n)
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(n, width)
        column = np.arange(width)
        ids = np.where(column < length[:, None], self.single[raw], -1).astype(np.int32)
        ranks = np.full((n, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        where, out = np.arange(n), [b""] * n
        while len(where):
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            best = ranks[np.arange(len(at)), at]
            done = best == NONE
            if done.any():
                ended = np.flatnonzero(done)
                step = 4 * ids.shape[1]
                flat = ids[ended].astype("<u4").tobytes()
                for k, (i, n_ids) in enumerate(zip(where[ended].tolist(), (4 * length[ended]).tolist(), strict=True)):
                    out[i] = flat[k * step : k * step + n_ids]
                live = ~done
                where, ids, ranks, length, at, best = where[live], ids[live], ranks[live], length[live], at[live], best[live]
                if not len(where):
                    break
                ids, ranks = ids[:, : length.max()], ranks[:, : length.max()]
            row = np.arange(len(at))
            after = np.arange(ids.shape[1] - 1) > at[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[row, at] = best
            length = length - 1
            ids[row, length] = -1
            ranks[:, :-1] = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            right = np.where(at + 1 < ids.shape[1], ids[row, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            ranks[row, at] = self.pairs.find(best, right)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.find(ids[left, at[left] - 1], best[left])
        return out

    def merge_heap(self, piece: bytes) -> bytes:
        """Ids of one long piece: neighbours in a linked list, candidates in a heap by (rank, place)."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.pair_ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in pairs:
                    heapq.heappush(heap, (pairs[p], x, *p))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids (uint32) of each piece."""
        rows = sorted(pieces, key=len)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        ends = [0, *np.searchsorted(sizes, WIDTHS, "right").tolist()]
        out = {p: self.merge_heap(p) for p in rows[ends[-1] :]}
        for width, start, end in zip(WIDTHS, ends, ends[1:]):
            for i in range(start, end, MATRIX_ROWS):
                bucket = rows[i : min(end, i + MATRIX_ROWS)]
                out.update(zip(bucket, self.merge_matrix(bucket, width), strict=True))
        return out

    def encode_matches(self, matches: list[str]) -> list[bytes]:
        """Ids (uint32) of strings that are one match of the pattern each."""
        data = [m.encode() for m in matches]
        ids = self.encode_pieces(data)
        return [ids[d] for d in data]

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        """Ids of each string, each match of the pattern by itself; equal matches are merged once."""
        found = [self.pattern.findall(s) for s in strings]
        pieces = list(set().union(*found))
        get = dict(zip(pieces, self.encode_matches(pieces), strict=True)).__getitem__
        return [b"".join(map(get, f)) for f in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.parts.encode(texts)

    # -- decoding

    def decode(self, ids: bytes) -> bytes:
        """Bytes of little-endian uint32 ids."""
        i = np.frombuffer(ids, "<u4")
        n = self.lengths[i]
        end = np.cumsum(n)
        if not len(i):
            return b""
        return self.flat[np.repeat(self.starts[i] - end + n, n) + np.arange(end[-1])].tobytes()


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids (little-endian uint32), decoded: the ids of each whole text, and the bytes decoded from them.

    `path` is a rank file that every executor has (a tokenizer's file, not data).
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch, texts in text_slices(batches):
            ids = bpe.encode(texts)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "token_ids": pa.array(ids, pa.binary()), "decoded": pa.array(map(bpe.decode, ids), pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def encode_checked(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids, decoded_equal (the ids, decoded again, give the text; null: empty). Texts don't leave Python again."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch, texts in byte_slices(batches):
            ids = bpe.encode(texts)
            equal = [bpe.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "token_ids": pa.array(ids, pa.binary()), "decoded_equal": pa.array(equal, pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(then_give_back(run, lambda: load(path, pattern).forget()), CHECKED)
