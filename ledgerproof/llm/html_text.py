"""Main text of web pages by equivalence classes of page tokens.

1. A page is read as a tree of block elements. A token is an element, told apart by the path of elements, classes and
   roles that leads to it (`Page`), or a run of text at such a place. How often a token stands on each page of its host is its
   occurrence vector; a sum of hashes over (page, count) stands for the vector, so it is an aggregate with a combining step
   and a host with a third of all pages is no task of its own.
2. Tokens of a host with one vector are an equivalence class. A class is valid if its tokens stand in one order, as often as
   the class repeats, on every page (`ordered`). Only tokens on at least a SUPPORT of the host's pages can be template;
   there are at most 1 / SUPPORT times as many as an average page has.
3. `deduce` nests the elements of valid classes by their paths into the host's template, and finds among its nodes the one
   whose slots hold the text: an `article` or `main` that stands once on a page, else the innermost container that
   still holds DESCENT of all unlinked text. Nodes marked as boilerplate, by tag or by a word of their class, id or role,
   are left out unless they hold most of the text. Runs of text that every page of a host shows once are template too, if it
   has TEXT_PAGES different pages.
4. `main_text` reads pages again with their host's template and returns what stands in the slots, block by block.

Pages are not shuffled by host: templates meet them in a join, broadcast while they are few.

Edge cases: null or empty html gives an empty text; a null url is a host of its own; a page without the template's node
falls back on its own articles, then on all that isn't boilerplate; repeated rows give repeated results; markup that is
not closed, not opened or cut off is repaired as browsers do; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerproof.llm.parts import text_slices
from ledgerproof.llm.ship import ship
from ledgerproof.session import broadcast_if_small, materialise

# Share of a host's pages that a token of its template is on.
SUPPORT = 0.5
# Share of the unlinked text that a container must hold to be gone into, and share of the text that makes a marked node content.
DESCENT, MOST = 0.9, 0.5
# Different pages a host must have before a shared run of text is template.
TEXT_PAGES = 20
# Share of linked text from which a block outside an article is a menu.
LINKED = 0.6

# Names of HTML elements by what they do, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output picture progress q rb rp rt ruby s samp small "
    "span strike strong sub sup time tt u var area br img input source wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu "
    "nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What an opening tag closes, and the elements beyond which it doesn't look.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table tbody thead tfoot tr select html body article section div aside nav main header footer form".split())
CONTAINERS = frozenset("html body div section center table tbody tr td main article".split())
ARTICLES = frozenset(["article", "main"])
SPAN_ENDS = frozenset("p div td li article section".split())
UNSEEN = frozenset("head title script style noscript template textarea".split())
DROPPED = frozenset("aside audio button canvas dialog embed footer form head iframe menu nav noscript object script select style svg template textarea title video".split())
MARKED_EXACTLY = frozenset("ad ads adv bar cc nav rss tags toc".split())
MARKED = tuple(
    "advert banner breadcrumb comment consent cookie dialog disqus footer header login masthead menu modal navigation navbar newsletter notice notif pagination "
    "pager popup promo related search share sharing sidebar signup social sponsor subscri toolbar widget complementary contentinfo".split()
)

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>[^'\">]*(?:(?:\"[^\"]*\"|'[^']*')[^'\">]*)*>|[^>]*(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
SEED = 13


def described(name: str, attributes: str) -> tuple[str, bool]:
    """The element with its classes and role, and whether these or its id mark it as boilerplate."""
    if len(attributes) < 5:
        return name, False
    kept, words = [], []
    for key, *values in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "role", "id"):
            value = html.unescape("".join(values))
            words += NAME_PARTS.findall(value)
            if key != "id":
                kept += sorted({re.sub(r"\d+", "0", w) for w in value.split()})
    marked = any((w := word.lower()) in MARKED_EXACTLY or w.startswith(MARKED) for word in words)
    return ".".join([name, *kept]), marked and name not in ("html", "body", "main")


class Page:
    """The elements and runs of text of one page, in page order.

    `ids`, `parents`, `names`, `marks` describe the distinct element tokens, `above` the place of the token around each
    in these lists; `order` lists the places of all elements; `runs` are (block number, text, place around it, linked).
    """

    def __init__(self, source: str):
        self.ids: list[int] = []
        self.parents: list[int] = []
        self.names: list[str] = []
        self.marks: list[bool] = []
        self.above: list[int] = []
        self.order: list[int] = []
        self.runs: list[tuple[int, str, int, bool]] = []
        self.place: dict[tuple[int, str], int] = {}
        self.stack: list[tuple[str, int]] = []
        self.open: Counter = Counter()
        self.block, self.linked = 0, False
        self.read(source)

    def push(self, name: str, attributes: str) -> None:
        component, mark = described(name, attributes)
        above = self.stack[-1][1] if self.stack else -1
        at = self.place.get((above, component))
        if at is None:
            at = self.place[above, component] = len(self.ids)
            parent = self.ids[above] if above >= 0 else 0
            self.ids.append(xxhash.xxh64_intdigest(f"{parent} {component}", SEED) - 2**63)
            self.parents.append(parent)
            self.names.append(component)
            self.marks.append(mark)
            self.above.append(above)
        self.order.append(at)
        self.stack.append((name, at))
        self.open[name] += 1

    def pop(self, names: tuple[str, ...], bounds: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of these names, and what is open in it."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in names:
                self.open.subtract(n for n, _ in self.stack[i:])
                del self.stack[i:]
                return
            if name in bounds:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in INLINE:
            if name == "a":
                self.linked = True
            elif name == "br":
                self.text(" ")
            elif name == "span" and described(name, attributes)[1]:
                self.push(name, attributes)
            return
        self.block += 1
        if name in VOID:
            if name == "hr":
                self.pop(("p",), HOLDS)
            return
        if name in ("html", "body", "head") and self.open[name]:
            return
        if name == "body":
            self.pop(("head",))
        if name in CLOSES_P:
            self.pop(("p",), HOLDS)
        if name in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.pop((self.stack[-1][0],))
        if name in ENDS:
            self.pop(ENDS[name], HOLDS - frozenset(ENDS[name]))
        self.linked = False
        self.push(name, attributes)

    def end(self, name: str) -> None:
        if name == "a":
            self.linked = False
        if name == "span":
            self.pop((name,), SPAN_ENDS)
        elif name not in INLINE:
            self.block += 1
            self.pop((name,))

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TAG.search(source, at)
            stop = found.start() if found else end
            if stop > at:
                self.text(source[at:stop])
            if not found:
                return
            at = found.end()
            name = found["name"]
            if name is None:
                if found["data"]:
                    self.text(html.escape(found["data"], quote=False))
                continue
            name = name.lower()
            if found["end"]:
                self.end(name)
                continue
            self.start(name, found["attributes"])
            if name in RAW:
                close = RAW_END[name].search(source, at)
                if name == "title":
                    self.text(source[at : close.start() if close else end])
                at = close.end() if close else end
                self.end(name)

    def text(self, piece: str) -> None:
        piece = html.unescape(piece) if "&" in piece else piece
        if piece:
            self.runs.append((self.block, piece, self.stack[-1][1] if self.stack else -1, self.linked))

    def id_at(self, place: int) -> int:
        return self.ids[place] if place >= 0 else 0

    def inherited(self, own: list[bool]) -> list[bool]:
        """Of each distinct element, whether it or one around it is in own. (An element comes after those around it.)"""
        out: list[bool] = []
        for mine, above in zip(own, self.above, strict=True):
            out.append(mine or (above >= 0 and out[above]))
        return out

    def dropped(self, spared: frozenset[int] = frozenset()) -> list[bool]:
        """Of each distinct element, whether it or one around it is boilerplate; headers of articles are not."""
        tags = [n.split(".", 1)[0] for n in self.names]
        article = self.inherited([t in ARTICLES or ".main" in n for t, n in zip(tags, self.names, strict=True)])
        own = []
        for tag, mark, above, id_ in zip(tags, self.marks, self.above, self.ids, strict=True):
            header = tag == "header"
            own.append(id_ not in spared and (tag in DROPPED or (mark or header if not (header and above >= 0 and article[above]) else False)))
        return self.inherited(own)


def one_line(text: str) -> str:
    return " ".join(text.split())


def run_id(token: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{token} {one_line(text)}", SEED) - 2**63


# -- what a page hands over to its host


TOKENS = "host string, row long, ids array<long>, parents array<long>, names array<string>, marks array<boolean>, counts array<long>, chars array<long>, linked array<long>, sequence array<int>, runs array<long>, run_counts array<long>"


def handed_over(page: Page) -> tuple:
    """ids .. run_counts of TOKENS; chars and linked are those of an element's whole content, scripts and the like apart."""
    counts, chars, linked = ([0] * len(page.ids) for _ in range(3))
    for i in page.order:
        counts[i] += 1
    hard = page.inherited([n.split(".", 1)[0] in UNSEEN for n in page.names])
    runs: Counter = Counter()
    for _, text, at, link in page.runs:
        n = len(one_line(text))
        if n and not (at >= 0 and hard[at]):
            if at >= 0:
                chars[at] += n
                linked[at] += n * link
            runs[run_id(page.id_at(at), text)] += 1
    for at in range(len(page.ids) - 1, -1, -1):
        if page.above[at] >= 0:
            chars[page.above[at]] += chars[at]
            linked[page.above[at]] += linked[at]
    return page.ids, page.parents, page.names, page.marks, counts, chars, linked, page.order, list(runs.keys()), list(runs.values())


def tokens(pages: DataFrame) -> DataFrame:
    """TOKENS of every page; row is unique."""
    ship(pages.sparkSession)
    fields = [f.split() for f in TOKENS.split(", ")]
    kinds = {"array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_()), "array<int>": pa.list_(pa.int32())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "html"):
            columns = list(zip(*(handed_over(Page(t)) for t in texts), strict=True))
            arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields[2:], strict=True)]
            yield pa.record_batch([batch.column("host"), batch.column("row"), *arrays], [name for name, _ in fields])

    rows = pages.select(host_of().alias("host"), F.monotonically_increasing_id().alias("row"), "html")
    return materialise(rows.mapInArrow(run, TOKENS), "page_tokens")


def host_of() -> F.Column:
    return F.lower(F.regexp_extract("url", "(?s)://([^/?#]*)", 1))


# -- classes and templates


def vector(*columns: str) -> F.Column:
    """A number for how often a token stands on which pages (a sum, so pages that agree do not cancel out)."""
    return F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))


def candidates(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, id, parent, name, mark, on (pages), times, chars, linked, vector of element tokens on a SUPPORT of the host's pages."""
    each = pages.select("host", "row", F.explode(F.arrays_zip("ids", "parents", "names", "marks", "counts", "chars", "linked")).alias("t")).select("host", "row", "t.*")
    found = each.groupBy("host", F.col("ids").alias("id")).agg(
        F.any_value("parents").alias("parent"), F.any_value("names").alias("name"), F.any_value("marks").alias("mark"), F.count("*").alias("on"),
        F.sum("counts").alias("times"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), vector("row", "counts").alias("vector"),
    )
    sizes = sizes.select(F.col("host").alias("of"), "n_pages")
    return found.join(sizes, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("on") >= SUPPORT * F.col("n_pages")).drop("of")


def shared_runs(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, run of the runs of text that stand once on every page of a host with TEXT_PAGES different pages."""
    each = pages.select("host", F.explode(F.arrays_zip("runs", "run_counts")).alias("t")).select("host", F.col("t.runs").alias("run"), F.col("t.run_counts").alias("n"))
    found = each.groupBy("host", "run").agg(F.count("*").alias("on"), F.sum("n").alias("times")).filter("on = times")
    wide = sizes.filter(F.col("n_different") >= TEXT_PAGES).select(F.col("host").alias("of"), "n_pages")
    return found.join(wide, F.col("host").eqNullSafe(F.col("of")) & (F.col("on") == F.col("n_pages"))).select("host", "run")


def by_host(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """rows with the row of their host; table has one row a host, n in all."""
    own = table.withColumnRenamed("host", "__host")
    return rows.join(broadcast_if_small(own, n), F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")


def ordered(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, class of the classes among found whose tokens stand on every page in one order, again and again."""
    classes = materialise(found.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("id", "class"))).alias("classes")), "page_classes")
    rows = by_host(pages.select("host", "ids", "sequence"), classes, classes.count()).filter("classes is not null")
    # Each distinct token's class, then the tokens of each class as they follow on the page.
    rows = rows.withColumn("of", F.expr("transform(ids, i -> classes[i])"))
    seen = rows.selectExpr("host", "inline(transform(array_distinct(filter(of, c -> c is not null)), c -> struct(c AS class, transform(filter(sequence, s -> of[s] <=> c), s -> ids[s]) AS tokens)))")
    width = F.size(F.array_distinct("tokens"))
    head = F.slice("tokens", 1, width)
    repeats = F.expr("forall(sequence(0, size(tokens) - 1), i -> tokens[i] = tokens[i % size(array_distinct(tokens))])")
    seen = seen.select("host", "class", F.xxhash64(head).alias("head"), repeats.alias("repeats"))
    return seen.groupBy("host", "class").agg(F.bool_and("repeats").alias("ok"), F.min("head").alias("least"), F.max("head").alias("most")).filter("ok and least = most").select("host", "class")


TEMPLATE = "host string, main long, spared array<long>, menus array<long>"


def chosen(rows: list[dict]) -> tuple[int | None, list[int], list[int]]:
    """main, spared, menus of one host, from its template's elements."""
    by_id = {r["id"]: r for r in rows}
    below: dict[int, list[dict]] = defaultdict(list)
    for r in rows:
        below[r["parent"]].append(r)
    whole = max((r["chars"] for r in rows), default=0)
    tag = {r["id"]: r["name"].split(".", 1)[0] for r in rows}
    once = {r["id"] for r in rows if r["times"] == r["on"]}
    spared = [r["id"] for r in rows if (r["mark"] or tag[r["id"]] in ("form", "aside", "header")) and r["chars"] > MOST * whole > 0]
    kept = set(spared)

    def boilerplate(r: dict | None) -> bool:
        inside = False
        while r is not None:
            t = tag[r["id"]]
            if (t in DROPPED or t == "header" or r["mark"]) and r["id"] not in kept:
                inside = True
            r = by_id.get(r["parent"])
        return inside

    articles = [r for r in rows if r["id"] in once and (tag[r["id"]] in ARTICLES or ".main" in r["name"]) and r["chars"] and not boilerplate(r)]
    if articles:
        best = max(articles, key=lambda r: (tag[r["id"]] == "article", r["chars"], r["id"]))
        return best["id"], spared, []
    plain = lambda r: r["chars"] - r["linked"] - sum(x["chars"] - x["linked"] for x in below[r["id"]] if boilerplate(x))
    at = next((r for r in rows if r["parent"] == 0 and tag[r["id"]] == "html"), None)
    while at is not None:
        inner = [r for r in below[at["id"]] if r["id"] in once and tag[r["id"]] in CONTAINERS and not boilerplate(r)]
        inner = max(inner, key=lambda r: (plain(r), r["id"]), default=None)
        if inner is None or plain(inner) < DESCENT * plain(at) or not plain(inner):
            break
        at = inner
    menus = [r["id"] for r in rows if r["chars"] and r["linked"] >= LINKED * r["chars"]]
    return (at["id"] if at is not None else None), spared, menus


def deduce(found: DataFrame) -> DataFrame:
    """TEMPLATE of every host of found (the elements of its valid classes): at most 1 / SUPPORT times the tokens of an average page are a group."""
    ship(found.sparkSession)
    names = [f.split()[0] for f in TEMPLATE.split(", ")]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        main, spared, menus = chosen(table.to_pylist())
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array([x], kind) for x, kind in zip((key[0].as_py(), main, spared, menus), kinds, strict=True)], names)

    return found.select("host", "id", "parent", "name", "mark", "on", "times", "chars", "linked").groupBy("host").applyInArrow(run, TEMPLATE)


def templates(pages: DataFrame) -> DataFrame:
    """TEMPLATE and runs (shared runs of text) of every host of pages (TOKENS)."""
    sizes = pages.groupBy("host", F.xxhash64("runs").alias("body")).agg(F.count("*").alias("n"))
    sizes = materialise(sizes.groupBy("host").agg(F.sum("n").alias("n_pages"), F.count("*").alias("n_different")), "page_hosts")
    found = candidates(pages, sizes).withColumn("class", F.xxhash64("host", "vector", "on", "times"))
    found = materialise(found, "page_candidates")
    valid = ordered(pages, found).select(F.col("host").alias("of"), F.col("class").alias("ok"))
    kept = found.join(valid, F.col("host").eqNullSafe(F.col("of")) & (F.col("class") == F.col("ok")), "left_semi")
    runs = shared_runs(pages, sizes).groupBy("host").agg(F.collect_list("run").alias("runs")).withColumnRenamed("host", "of")
    return materialise(deduce(kept).join(runs, F.col("host").eqNullSafe(F.col("of")), "left").drop("of"), "page_templates")


# -- extraction


def extracted(source: str, main: int | None, spared: list[int], menus: list[int], runs: list[int]) -> str:
    """What stands in the slots of the template on this page."""
    page = Page(source)
    gone = page.dropped(frozenset(spared))
    place = {id_: i for i, id_ in enumerate(page.ids)}
    every = range(len(page.ids))
    if main in place:
        within = page.inherited([i == place[main] for i in every])
        out = page.inherited([page.ids[i] in menus for i in every])
        gone = [a or b or not c for a, b, c in zip(gone, out, within, strict=True)]
    else:  # not made by the template: its own articles, if it has any
        within = page.inherited([page.names[i].split(".", 1)[0] in ARTICLES and not gone[i] for i in every])
        if any(within):
            gone = [a or not b for a, b in zip(gone, within, strict=True)]
    bare = main not in place and not any(page.names[i].split(".", 1)[0] in ARTICLES and not gone[i] for i in every)
    template, blocks, last = frozenset(runs), [], None
    for block, text, at, _ in page.runs:
        if (gone[at] if at >= 0 else not bare) or (template and run_id(page.id_at(at), text) in template):
            continue
        if block != last:
            blocks.append([])
            last = block
        blocks[-1].append(text)
    return "\n\n".join(x for x in (one_line("".join(b)) for b in blocks) if x)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    found = templates(tokens(pages))
    rows = by_host(pages.select("page_id", "url", host_of().alias("host"), "html"), found, found.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "html"):
            template = zip(*(batch.column(c).to_pylist() for c in ("main", "spared", "menus", "runs")), strict=True)
            out = [extracted(t, main, spared or [], menus or [], runs or []) for t, (main, spared, menus, runs) in zip(texts, template, strict=True)]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "main", "spared", "menus", "runs")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
