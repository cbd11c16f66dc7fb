"""Spelling variants, conversation repair and page texts against brute force, and on awkward rows."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerproof.llm import conversations as C
from ledgerproof.llm import html_text as H
from ledgerproof.llm import spelling

DOCS = "doc_id long, text string, word string, n long, key string"


# -- 11


def plain_variants(rows):
    """Every deletion of every word in a table; words meet there or differ in the character that is gone."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(set)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) > 1:
            continue
        if len(a) == len(b):
            ok = sum(x != y for x, y in zip(a, b, strict=True)) == 1
        else:
            long, short = sorted((a, b), key=len, reverse=True)
            ok = any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
        if ok:
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def test_spelling(spark):
    rnd = random.Random(5)
    bases = ["reading", "straße", "aabbaa", "ÀéÀéÀé", "letters", "lettter"]
    pool = []
    for word in bases:
        for _ in range(25):
            w = list(word)
            for _ in range(rnd.randrange(3)):
                i = rnd.randrange(len(w) + 1)
                how = rnd.randrange(3)
                if how == 0:
                    w.insert(i, rnd.choice("aeßÿt"))
                elif i < len(w) and how == 1:
                    del w[i]
                elif i < len(w):
                    w[i] = rnd.choice("aeé÷")
            pool.append("".join(w))
    texts = [" ".join(rnd.choice(pool) for _ in range(40)) + rnd.choice(["", ". READING-Reading", "\n42letters中letters"]) for _ in range(60)]
    texts += ["", None, "a b c", "reading " * 5000, texts[0]]
    rows = [*enumerate(texts), (3, texts[3]), (None, "letters reading")]
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], DOCS).repartition(3)
    out = spelling.variants(docs)
    assert Counter(tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()) == plain_variants(rows)
    assert any(r.form is not None and r.root != r.form for r in out.collect())
    assert spelling.variants(docs.limit(0)).count() == 0


def test_rotation_groups_are_bounded(spark):
    words = spark.createDataFrame([("".join(w), 3) for w in itertools.product("abc", repeat=5)], "word string, n long")
    assert spelling.rotations(words).groupBy("key").count().agg(F.max("count")).first()[0] <= spelling.LETTERS + 1
    assert {r.n_near for r in spelling.neighbours(words).collect()} == {10}


# -- 12

CONV = "conv_id long, turn long, role string, text string, code string, at string"
INKED = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain_repair(rows):
    """A table of cheapest strings (cost, letters, lines), state by state; letters compare as strings."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def relax(table, state, item):
        if state not in table or item[:2] < table[state][:2]:
            table[state] = item

    def insertions(table):
        for _ in range(4):
            for state, (cost, letters, lines) in list(table.items()):
                for nxt in legal[state].replace("s", ""):
                    relax(table, nxt, (cost + 3, letters + "I", [*lines, {"u": "user:", "a": "assistant:"}[nxt]]))
        return table

    best = insertions(best)
    for (role, text), fault in rows:
        new = {}
        for state, (cost, letters, lines) in best.items():
            relax(new, state, (cost + 4, letters + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            if role[:1] and role[0] in legal[state]:
                relax(new, role[0], (cost + extra, letters + "K", [*lines, f"{role}:{text}"]))
            for nxt in legal[state].replace("s", ""):
                name = {"u": "user", "a": "assistant"}[nxt]
                relax(new, nxt, (cost + extra + 3, letters + "R", [*lines, f"{name}:{text}"]))
        best = insertions(new)
    return min(best[s] for s in ("", "a") if s in best)


def plain_conversations(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in rows}:
        own, seen, faults = by[conv], set(), []
        for _, _, role, text in own:
            ink = INKED.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, letters, lines = plain_repair([((r[2], r[3]), f) for r, f in zip(own, faults, strict=True)])
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, digest)
    return out


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(8)
    texts = ["Yes.", "No!", "So it is", "", " \n", "Why?  ", "Because é.", None, "x\x0b", "same.", "same."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randrange(1, 14)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rnd.choice([turn, turn, turn, 2 * turn, None]), role, rnd.choice(texts)))
    rows += [(60, t, ("system", "user", "assistant")[min(t, 1) + (t % 2 == 0) * (t > 0)], f"long talk {t % 50}.") for t in range(300)]
    rows += [(61, None, "user", "a."), (61, None, "user", "a."), (62, -5, "assistant", "b" * 50_000 + ".")]
    # A single row that the damage drops.
    lost = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (lost, 0, "user", "gone.")]


def rows_of(out):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out.collect()}


def test_repair(spark, talk):
    table = spark.createDataFrame([(*r, "c", "a") for r in talk], CONV).repartition(3)
    want = plain_conversations(talk)
    assert rows_of(C.repaired(table)) == want
    assert C.repaired(table.limit(0)).count() == 0


def test_repair_in_blocks(spark, talk):
    table = spark.createDataFrame([(*r, "c", "a") for r in talk], CONV).repartition(3)
    want = plain_conversations(talk)
    assert rows_of(C.repaired(table, hot_rows=6, block_rows=4)) == want
    assert rows_of(C.repaired(table, hot_rows=100, hot_bytes=1000, block_rows=50)) == want


def test_checkpoints_agree_with_all_vectors():
    rnd = random.Random(2)
    for n in [0, 1, 2, 3, 10, 50, 400]:
        codes = bytes(rnd.randrange(16) & (15 if rnd.random() < 0.3 else 7) for _ in range(n))
        cost, letters = C.repair(codes)
        more, state = C.walk(codes, C.inserted(C.END), C.EMPTY_STATE)
        assert letters == more + C.closing(state)[0]
        assert cost == C.vectors(codes, C.inserted(C.END))[0][C.EMPTY_STATE]


# -- 13

PAGES = "page_id long, url string, html string, host string, text string"


def page(title, body, extra="", nav=("Home", "News"), close="</body></html>"):
    links = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in nav)
    return (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head><body>'
        f'<header><p>Site name</p></header><nav><ul>{links}</ul></nav><div class="cookie-notice">We use cookies.</div>{extra}'
        f'<article><h1>{title}</h1>{body}<section id="comments"><p>First!</p></section></article>'
        f'<aside><p>Read also</p></aside><form><label>Mail</label><input></form><footer>&copy; me</footer>{close}'
    )


def test_pages(spark):
    rows, want = [], {}

    def add(url, source, text):
        rows.append((len(rows), url, source, "h", "t"))
        want[len(rows) - 1] = text

    for i in range(8):
        add(f"http://a.example/{i}", page(f"T{i}", f"<p>one &amp; two {i}\n  three<p><b>open <i>bold<br>line</p><ul><li>x{i}<li>y</ul>"), f"T{i}\n\none & two {i} three\n\nopen bold line\n\nx{i}\n\ny".replace("boldline", "bold line"))
    # No semantic element: the innermost container with nearly all text.
    for i in range(5):
        add(f"http://b.example/{i}", f'<html><body><div class=top><a href=/>Home</a> <a href=/x>More</a></div><div id=wrap><div class="text"><h2>H{i}</h2><p>{"words here " * 20}</p></div></div><div class=sidebar>Side</div></body></html>', f"H{i}\n\n" + ("words here " * 20).strip())
    add("http://c.example/", page("Alone", "<p>only page &lt;b&gt; &#233;&nbsp;x</p>", close=""), "Alone\n\nonly page <b> é x")
    add(None, "just text", "just text")
    add(None, None, "")
    add("no scheme", "", "")
    add("http://d.example/", "<p>a<!-- <p>hidden --><p>b<div>c</div></div></span>d<table><tr><td>e<td>f</table><div class='ad", "a\n\nb\n\nc\n\nd\n\ne\n\nf")
    add("http://e.example/", "<div>" * 3000 + "deep" + "</div>" * 2000, "deep")
    add("http://f.example/", "<article>" + "<p>long text</p>" * 20000 + "</article>", "\n\n".join(["long text"] * 20000))
    rows.append((*rows[0][:3], "h", "t"))
    table = spark.createDataFrame(rows, PAGES).repartition(3)
    got = H.main_text(table)
    assert got.count() == len(rows)
    for r in got.collect():
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert H.main_text(table.limit(0)).count() == 0


def test_template_text_and_order(spark):
    """A run that stands on every page of a large host is template; classes in varying order are not valid."""
    rows = [(i, "http://a.example/", f"<html><body><article><p>Share this page now</p><p>text {i}</p></article></body></html>", "h", "t") for i in range(25)]
    rows += [(100 + i, "http://s.example/", f"<html><body>{'<main><p>x</p></main><hr><section>y</section>' if i % 2 else '<section>y</section><hr><main><p>x</p></main>'}</body></html>", "h", "t") for i in range(4)]
    table = spark.createDataFrame(rows, PAGES)
    assert {r.page_id: r.text for r in H.main_text(table).collect()} == {**{i: f"text {i}" for i in range(25)}, **{100 + i: "x" for i in range(4)}}
    tokens = H.tokens(table)
    sizes = tokens.groupBy("host").agg(F.count("*").alias("n_pages"))
    found = H.candidates(tokens, sizes).withColumn("class", F.xxhash64("host", "vector", "on", "times"))
    valid = {r.host for r in H.ordered(tokens, found).collect()}
    assert valid == {"a.example"}


def test_pages_of_the_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in H.main_text(table).join(table.select("page_id", "html"), "page_id").collect():
        parts = re.split("</?(?:p|h1)>", re.search("<article>(.*)</article>", r.html, re.S)[1])
        lines = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in parts)
        assert r.text == "\n\n".join(x for x in lines if x)
