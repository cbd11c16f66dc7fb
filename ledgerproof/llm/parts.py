"""Helpers shared by the text operators: batches of rows, and caches of what one word gives.

A text is taken apart at each U+0020. For both byte-level splitting patterns a space followed by a
character that is not white space always begins a new piece, so parts can be encoded one by one
and what a part gives can be kept. At a fixed number of entries a cache drops all but what is in use, so a worker's memory
doesn't grow with the corpus.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

# Entries of a cache of words before it is thinned out (about 200 bytes each).
CACHE_ENTRIES = 500_000
# Characters of text handled at once; a longer text is handled alone.
SLICE_CHARS = 3_000_000

# The characters of Unicode's White_Space property, as in a pattern's \s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# ASCII marks that no alternative of the patterns treats in a special way.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class BoundedCache(dict):
    """A dict that drops all but what is in use when it would grow over its bound."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.entries = entries

    def missing(self, used: set) -> set:
        """Those of `used` that have no entry yet; afterwards there is room for them."""
        new = used.difference(self)
        if self and len(self) + len(new) > self.entries:
            kept = {k: self[k] for k in used if k in self}
            self.clear()
            self.update(kept)
        return new


class Kept(dict):
    """make(key), kept for as long as the key stays in use: at `entries` keys the present generation becomes
    the old one, from which a key is taken over when it is asked for again."""

    def __init__(self, make: Callable[[str], bytes], entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches with at most SLICE_CHARS characters (or one row), and their texts; null reads as empty."""
    for batch in batches:
        texts = [x or "" for x in batch.column(column).to_pylist()]
        start = total = 0
        for i, text in enumerate(texts):
            if total and total + len(text) > SLICE_CHARS:
                yield batch.slice(start, i - start), texts[start:i]
                start, total = i, 0
            total += len(text)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def byte_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same by bytes; only the texts of one part at a time are turned into strings."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate([*sizes, most + 1]):
            if i > start and total + size > most:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in part.column(column).to_pylist()]
                start, total = i, 0
            total += size


def give_back() -> None:
    """Hand memory that is free to the system: a Python worker stays for later stages, and what it keeps they lack."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def then_give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], forget: Callable[[], None] | None = None):
    """run, and after its last batch forget() and give_back()."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        if forget:
            forget()
        give_back()

    return whole


class WordEncoder:
    """Ids of whole texts, put together from the ids of their parts, each found when it is first met.

    `merge` gives the ids (little-endian bytes) of one piece; `whole` of any string.
    """

    def __init__(self, merge: Callable[[str], bytes], whole: Callable[[str], bytes], entries: int = CACHE_ENTRIES):
        self.whole, self.white = whole, frozenset(WHITE)
        self.pieces, self.parts = Kept(merge, entries), Kept(self.encode_part, entries)

    def encode_part(self, part: str) -> bytes:
        """Ids of a part and the space before it. Letters are one piece, with the space if there is one, so are
        the marks that follow them, and so is a line feed between two such words; anything else goes to `whole`."""
        if not part or part[0] in self.white:
            raise RunOfWhite  # it belongs to a longer run of white space
        pieces, found, before = self.pieces, [], " "
        for word in part.split("\n"):
            core = word.rstrip(MARKS)
            if not core.isalpha():
                return self.whole(" " + part)
            if before == "":
                found.append(pieces["\n"])
            found.append(pieces[before + core])
            if len(core) < len(word):
                found.append(pieces[word[len(core) :]])
            before = ""
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        head, *parts = text.split(" ")
        try:
            return (self.whole(head) if head else b"") + b"".join(map(self.parts.__getitem__, parts))
        except RunOfWhite:
            return self.whole(text)


class RunOfWhite(Exception):
    pass


class PartEncoder:
    """The same for a `merge` and a `whole` that take many strings at once.

    Ids of whole texts, put together from the ids of their parts.

    `merge` gives the ids (little-endian bytes) of single pieces; `whole` of any string.
    """

    def __init__(self, merge: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.merge, self.whole = merge, whole
        self.parts, self.pieces = BoundedCache(entries), BoundedCache(entries)
        self.white = frozenset(WHITE)

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with the space before it. Letters after a space are one piece, and so are the
        marks that end a part; anything else goes to `whole`."""
        cores = [p.rstrip(MARKS) for p in parts]
        regular = [c.isalpha() for c in cores]
        words = {" " + c for c, ok in zip(cores, regular, strict=True) if ok}
        words.update(p[len(c) :] for p, c, ok in zip(parts, cores, regular, strict=True) if ok and len(c) < len(p))
        new = list(self.pieces.missing(words))
        self.pieces.update(zip(new, self.merge(new), strict=True))
        piece, rest = self.pieces, [i for i, ok in enumerate(regular) if not ok]
        out = [b"" if not ok else piece[" " + c] if len(c) == len(p) else piece[" " + c] + piece[p[len(c) :]] for p, c, ok in zip(parts, cores, regular, strict=True)]
        for i, ids in zip(rest, self.whole([" " + parts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        used: set[str] = set()
        for parts in split:
            used.update(parts[1:])
        # A part that is empty or begins with white space belongs to a longer run of white space.
        plain = [p for p in self.parts.missing(used) if p and p[0] not in self.white]
        self.parts.update(zip(plain, self.encode_parts(plain), strict=True))
        get, out, run = self.parts.get, [b""] * len(texts), []
        for i, parts in enumerate(split):
            try:
                out[i] = b"".join(map(get, parts[1:]))
            except TypeError:  # a part that can't stand alone
                run.append(i)
        skip = set(run)
        heads = [i for i, parts in enumerate(split) if parts[0] and i not in skip]
        for i, ids in zip(heads, self.whole([split[i][0] for i in heads]), strict=True):
            out[i] = ids + out[i]
        for i, ids in zip(run, self.whole([texts[i] for i in run]), strict=True):
            out[i] = ids
        return out
