"""Token counts of every prefix of a text, by dynamic programming over prefixes.

For a word-end BPE the encoding of a prefix is found from shorter ones: it is the encoding of the
prefix without its last token, followed by that token, and a candidate for the last token is right
exactly if it and the token before it stay apart when merged together. So one pass over a word gives
the last token and the count of each of its prefixes, with and without the word's end there. A text's
counts are stored as one signed byte per character, the change of the count at that character; any
question about truncation or a budget is then a cumulative sum, without encoding again.

Edge cases: a null text counts as empty (0 tokens, an empty store); a null doc_id stays null; repeated
rows give repeated results; other columns of the input are not read; an empty table gives an empty
result. A character that changes the count by more than a byte holds makes that text's store 4 bytes
per character. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ledgerproof.llm.parts import MARKS, WHITE, Kept, text_slices
from ledgerproof.llm.ship import ship
from ledgerproof.llm.token_file import byte_letters

COUNTED = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix binary"
WORD_END = "</w>"


class WideStep(Exception):
    """A step that one signed byte can't hold."""


class PrefixCounter:
    """Counts for a tokenizers file: a normalizer, a splitting pattern, a BPE model with word ends, and special strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        (pattern,) = (s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        self.find = regex.compile(pattern).findall
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = regex.compile("|".join(map(regex.escape, special)))
        self.has_special = self.special.search
        letter = {c: b for b, c in byte_letters().items()}
        vocabulary = spec["model"]["vocab"]
        # A node: its children by byte, and the tokens that end there, within a word and at its end, plus 1 (0: none).
        self.trie: list = [{}, 0, 0]
        self.longest = 0
        skip = set(special)
        for token, i in vocabulary.items():
            if token in skip:
                continue
            kind, body = (2, token[: -len(WORD_END)]) if token.endswith(WORD_END) else (1, token)
            node = self.trie
            for c in body:
                node = node[0].setdefault(letter[c], [{}, 0, 0])
            node[kind] = i + 1
            self.longest = max(self.longest, len(body))
        # rule: pair -> rank of its merge; made: token -> (rank, left, right)
        self.rule: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocabulary[left], vocabulary[right]
            self.rule[a, b] = rank
            self.made[vocabulary[left + right]] = (rank, a, b)
        self.apart = Kept(lambda key: self.stay_apart(key >> 20, key & 0xFFFFF), 300_000)
        self.pieces, self.parts = Kept(self.piece_steps), Kept(self.part_steps)

    def stay_apart(self, a: int, b: int) -> bool:
        """Does the text of a followed by that of b encode to [a, b]?

        Walk back in time from the finished tokens. At each moment the boundary has one token on its left
        (on a's right edge) and one on its right (on b's left edge); a rule for the two that comes before
        either of them is merged further would have joined them.
        """
        left_until = right_until = len(self.rule) + 1
        made = self.made.get
        while True:
            rank = self.rule.get((a, b))
            # Of equal rules the one further left comes first: the inner one on the left, this one before b's.
            if rank is not None and rank < left_until and rank <= right_until:
                return False
            x, y = made(a), made(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and x[0] > y[0]):
                left_until, a = x[0], x[2]
            else:
                right_until, b = y[0], y[1]

    def extend(self, data: bytes, last: list[int], count: list[int], ends: list[int], start: int) -> None:
        """Fill the entries beyond `start`; those up to it are known. Entry i is of data[:i]: its last
        token plus 1 (0: none) and number of tokens if the word goes on, its number of tokens if it ends there."""
        n, apart, root = len(data), self.apart, self.trie[0]
        for j in range(max(0, start - self.longest), n):
            children, before, c, i = root, (last[j] - 1) << 20, count[j] + 1, j
            for byte in data[j:]:
                node = children.get(byte)
                if node is None:
                    break
                children, within, at_end = node
                i += 1
                if i <= start:
                    continue
                if within and not last[i] and (before < 0 or apart[before + within - 1]):
                    last[i], count[i] = within, c
                if at_end and not ends[i] and (before < 0 or apart[before + at_end - 1]):
                    ends[i] = c

    def prefix_counts(self, piece: str) -> tuple[bytes, list[int], list[int], list[int]]:
        data = piece.encode()
        n = len(data)
        last, count, ends = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        self.extend(data, last, count, ends, 0)
        return data, last, count, ends

    def piece_counts(self, piece: str) -> list[int]:
        """Counts after each character of one match of the pattern, were the text to end there."""
        if piece[0] == "'" and len(piece) == 3 and piece[1:].isalpha():  # its first two characters are no match of their own
            return [self.total("'"), self.total("'") + self.total(piece[1]), self.prefix_counts(piece)[3][-1]]
        ends, out, at = self.prefix_counts(piece)[3], [], 0
        if piece.isascii():
            return ends[1:]
        for c in piece:
            at += len(c.encode())
            out.append(ends[at])
        return out

    def total(self, normalized: str) -> int:
        return sum(self.piece_counts(p)[-1] for p in self.find(normalized))

    def piece_steps(self, piece: str) -> bytes:
        return steps(self.piece_counts(piece))

    def changed_counts(self, chunk: str) -> list[int]:
        """Counts after each character of a chunk that normalizing changes in more than letter case.

        Segments are the shortest stretches that are normalized apart from each other. Ends of segments
        are read off the whole normalized chunk; inside one, the word before it is extended by what the
        beginning of the segment becomes.
        """
        segments: list[str] = []
        for c in chunk:
            s = segments[-1] if segments else ""
            if s and (unicodedata.combining(c) or unicodedata.normalize("NFC", s + c) != unicodedata.normalize("NFC", s) + unicodedata.normalize("NFC", c)):
                segments[-1] += c
            else:
                segments.append(c)
        normal = [self.normalize(s) for s in segments]
        pieces, states, before, at_char = self.find("".join(normal)), {}, {}, 0
        plain: list[int] = []
        for k, p in enumerate(pieces):
            for i in range(len(p)):
                before[at_char + i] = (k, i)
            at_char += len(p)
            base = plain[-1] if plain else 0
            plain += [base + c for c in self.piece_counts(p)]
        out, at = [], 0
        for s, norm in zip(segments, normal, strict=True):
            for i in range(1, len(s)):
                out.append(self.inside(pieces, plain, before, states, at, self.normalize(s[:i])))
            at += len(norm)
            out.append(plain[at - 1] if at else 0)
        return out

    def inside(self, pieces: list[str], plain: list[int], before: dict, states: dict, at: int, added: str) -> int:
        """Count of the first `at` characters followed by `added`."""
        if not at:
            return self.total(added)
        k, i = before[at - 1]
        close = "".join(pieces[max(0, k - 1) : k]) + pieces[k][: i + 1]
        if "'" in close[-4:]:  # what is there might match otherwise with what follows
            return self.total("".join(pieces[:k]) + pieces[k][: i + 1] + added)
        base = plain[at - 1]
        start = pieces[k][: i + 1] if i < 3 else pieces[k][i : i + 1]
        match = self.find(start + added)
        if len(match[0]) <= len(start) or match[0][: len(start)] != start:
            return base - self.total(start) + self.total(start + added) if i < 3 else base + self.total(added)
        if k not in states:
            states.clear()
            states[k] = self.prefix_counts(pieces[k])
        data, last, count, ends = states[k]
        p = len(pieces[k][: i + 1].encode())
        low = max(0, p - 2 * self.longest)
        window = data[low:p] + match[0][len(start) :].encode()
        n = len(window) - (p - low)
        w_last, w_count, w_ends = last[low : p + 1] + [0] * n, count[low : p + 1] + [0] * n, ends[low : p + 1] + [0] * n
        self.extend(window, w_last, w_count, w_ends, p - low)
        return base - ends[p] + w_ends[-1] + sum(self.total(m) for m in match[1:])

    def chunk_counts(self, chunk: str) -> list[int]:
        """Counts after each character of a stretch without white space."""
        if m := self.has_special(chunk):
            # Until its last character a special string is ordinary text; then it is one token.
            before = self.ordinary_counts(chunk[: m.end() - 1])
            base = (self.ordinary_counts(chunk[: m.start()])[-1] if m.start() else 0) + 1
            rest = chunk[m.end() :]
            return before + [base] + ([base + c for c in self.chunk_counts(rest)] if rest else [])
        return self.ordinary_counts(chunk)

    def ordinary_counts(self, chunk: str) -> list[int]:
        if not chunk:
            return []
        lower = chunk.lower() if chunk.isascii() else self.normalize(chunk)
        if len(lower) != len(chunk) or not unicodedata.is_normalized("NFC", chunk):
            return self.changed_counts(chunk)
        out: list[int] = []
        for p in self.find(lower):
            base = out[-1] if out else 0
            out += [base + c for c in self.piece_counts(p)]
        return out

    def text_counts(self, text: str) -> list[int]:
        """Counts after each character of any text; white space adds nothing."""
        out: list[int] = []
        for run in CHUNKS.findall(text):
            base = out[-1] if out else 0
            out += [base] * len(run) if run[0] in WHITE else [base + c for c in self.chunk_counts(run)]
        return out

    def part_steps(self, part: str) -> bytes:
        """Steps of what stands between two spaces: as a rule letters, marks behind them, line feeds between such words."""
        found: list[bytes] = []
        for word in part.split("\n"):
            core = word.rstrip(MARKS)
            lower = core.lower()
            if not lower.isalpha() or not (core.isascii() or (len(lower) == len(core) and "\u03a3" not in core and unicodedata.is_normalized("NFC", core))):
                return steps(self.text_counts(part))
            if found:
                found.append(b"\0")
            found.append(self.pieces[lower])
            if len(core) < len(word):
                found.append(self.pieces[word[len(core) :]])
        return b"".join(found)

    def store(self, text: str) -> bytes:
        """The prefix store: its first byte is the width of a step in bytes."""
        try:
            return b"\1" + b"\0".join(map(self.parts.__getitem__, text.split(" ")))
        except WideStep:
            counts = np.array(self.text_counts(text), np.int64)
            return b"\4" + np.diff(counts, prepend=0).astype("<i4").tobytes()


CHUNKS = regex.compile(f"[{WHITE}]+|[^{WHITE}]+")


def steps(counts: list[int]) -> bytes:
    try:
        return bytes([(c - b) & 0xFF if -128 <= c - b < 128 else 256 for b, c in zip([0, *counts], counts)])
    except ValueError:
        raise WideStep from None


# -- questions to a store


def counts_of(store: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2, ... characters."""
    change = np.frombuffer(store, "<i4" if store[0] == 4 else np.int8, offset=1)
    return np.concatenate([[0], np.cumsum(change, dtype=np.int64)])


def total_of(store: bytes) -> int:
    return int(np.frombuffer(store, "<i4" if store[0] == 4 else np.int8, offset=1).sum(dtype=np.int64))


def longest_within(store: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most `budget` tokens."""
    return int(np.flatnonzero(counts_of(store) <= budget)[-1])


@lru_cache(maxsize=1)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_chars, n_tokens, prefix (the store) of every whole text.

    tokenizer: a tokenizers file that every executor has.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch, texts in text_slices(batches):
            stores = [c.store(t) if t else b"\1" for t in texts]
            columns = [pa.array(map(f, x), pa.int64()) for f, x in ((lambda t: len(t.encode()), texts), (len, texts), (total_of, stores))]
            yield pa.record_batch([batch.column("doc_id"), *columns, pa.array(stores, pa.binary())], ["doc_id", "n_bytes", "n_chars", "n_tokens", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, COUNTED)


def truncate(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, kept_chars: the longest prefix of each text within the budget, from its store alone."""
    ship(counted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [longest_within(s, budget) for s in batch.column("prefix").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(kept, pa.int64())], ["doc_id", "kept_chars"])

    return counted.select("doc_id", "prefix").mapInArrow(run, "doc_id long, kept_chars long")
