"""URL filtering with a trie over reversed host labels and path segments.

A rule is (action, host, path). The trie's upper levels are host labels from the right; every node of a host
holds a second trie of the path's segments, each closed by a slash, and what a rule's path has after its last
slash as an open end. Of all rules that fit a url the one with the most host labels decides, of those the one
with the longest path: the last one met on the way down. The trie is broadcast; rules are a list that someone
maintains, so it is bounded by MAX_RULES, and a longer list is refused.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and gets the default
verdict; a rule with an empty host fits every host; of equal rules with both actions, block decides; repeated
rows give repeated results; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerproof.llm.ship import ship

MAX_RULES = 1_000_000

URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

JUDGED = "page_id long, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    m = URL.search(url or "")
    return (m[1].translate(UPPER), m[2]) if m else ("", "")


class HostNode:
    __slots__ = ("children", "paths")

    def __init__(self):
        self.children: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


class PathNode:
    __slots__ = ("children", "ends")

    def __init__(self):
        self.children: dict[str, PathNode] = {}
        # Beginnings of the next segment, "" for a rule that ends with this node's slash -> (rule, action).
        self.ends: dict[str, tuple[str, str]] = {}


class UrlTrie:
    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        self.root = HostNode()
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.children.setdefault(label, HostNode())
            node.paths = place = node.paths or PathNode()
            *closed, end = path.split("/")
            for segment in closed:
                place = place.children.setdefault(segment, PathNode())
            if place.ends.get(end, ("", ""))[1] != "block":
                place.ends[end] = (host + path, action)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest match."""
        segments, best = path.split("/"), None
        node = self.root
        for label in [None, *(reversed(host.split(".")) if host else ())]:
            if label is not None:
                node = node.children.get(label)
                if node is None:
                    break
            if node.paths and (found := self.find_path(node.paths, segments)):
                best = found
        return best

    def find_path(self, node: PathNode, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for i, segment in enumerate(segments):
            ends = [e for e in node.ends if segment.startswith(e)]
            if ends:
                best = node.ends[max(ends, key=len)]
            if i == len(segments) - 1:  # not closed by a slash
                break
            node = node.children.get(segment)
            if node is None:
                break
        return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row; the verdict is `default` where no rule fits."""
    trie = pages.sparkSession.sparkContext.broadcast(rules)
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UrlTrie(trie.value)
        for batch in batches:
            split = [split_url(u) for u in batch.column("url").to_pylist()]
            found = [own.find(*s) for s in split]
            columns = ([s[0] for s in split], [s[1] for s in split], [f and f[0] for f in found], [f[1] if f else default for f in found])
            yield pa.record_batch([batch.column("page_id"), *[pa.array(c, pa.string()) for c in columns]], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(run, JUDGED)
