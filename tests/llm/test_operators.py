"""The corpus operators against libraries and brute force, and on awkward rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tiktoken, tokenizers, xxhash = (pytest.importorskip(x) for x in ("tiktoken", "tokenizers", "xxhash"))

import corpus_pipeline  # noqa: E402
from ledgerproof.llm import byte_bpe, components, dedup, gam, labelled, mixing, quality_rules, queries, simhash, token_counts, token_file, toxicity, url_rules  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, n_words string"
WORDS = "the of and idiot house tree under blue seven river Über señal ça 中文 don't it's 42 !! end.\nStart a-b".split(" ")


def make_rows(seed=1, n=60):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 90))) for _ in range(n)]
    texts += [None, "", "   \n\t ", "x", "word " * 3000, "a" * 3000, "no spaces" + "中" * 500, "double  space", " lead", "trail ", "tab\tand\x85odd\x1c", texts[3], texts[3] + " ", texts[3], texts[5].replace(" ", "  ")]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, "no id at all", None, "s0", 12, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], i % 5 != 0, int("idiot" in (r[1] or ""))) for i, r in enumerate(rows)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic")


def found(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# -- 1


def library(name):
    return tokenizers.Tokenizer.from_file(P.path(name))


def test_prefix_counts_at_every_prefix():
    lib, own = library("word_bpe_49k.json"), token_counts.counter(P.path("word_bpe_49k.json"))
    rnd = random.Random(4)
    pieces = ["a", "th", "The", "ing", " ", "\n", "é", "e\u0301", "İ", "Σ", "한", "🙂", "1", "!!", "'s", "'ll", "'", "<|endoftext|>", "<|end", "\x85", "\x1c", "\u0327"]
    for text in ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(18))) for _ in range(150)]:
        want = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        store = own.store(text)
        assert token_counts.counts_of(store).tolist() == want, text
        assert token_counts.longest_within(store, 3) == max(k for k, c in enumerate(want) if c <= 3)


def test_wide_steps():
    counts = [0, 300, 1]
    with pytest.raises(token_counts.WideStep):
        token_counts.steps(counts)
    store = b"\4" + np.diff(counts, prepend=0).astype("<i4").tobytes()
    assert token_counts.counts_of(store).tolist() == [0, *counts] and token_counts.total_of(store) == 1


def test_token_counts(docs, rows, empty):
    lib = library("word_bpe_49k.json")
    out = token_counts.prefix_counts(docs, P.path("word_bpe_49k.json"))
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert found(out, "doc_id", "n_bytes", "n_tokens") == want
    kept = {r.doc_id: r.kept_chars for r in token_counts.truncate(out, 10).collect()}
    assert kept[60] == 0 and 0 < kept[64] < 15000
    assert token_counts.prefix_counts(empty, P.path("word_bpe_49k.json")).count() == 0


# -- 7, 9


def rank_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows, empty):
    lib = rank_encoding()
    out = byte_bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = Counter((i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows)
    assert Counter((r.doc_id, bytes(r.token_ids), bytes(r.decoded)) for r in out.collect()) == want
    assert byte_bpe.encode_decode(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_long_matches_and_random_strings():
    lib, own = rank_encoding(), byte_bpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab '\n\t  éß中🙂1.,<|>\x85\r") for _ in range(rnd.randrange(50))) for _ in range(2000)] + ["a" * 5000, "ab" * 700, "中文" * 400, " " * 600]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [lib.encode_ordinary(t) for t in texts]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [0, 0, 0], [0, 5, 5, 9, 10**9], np.sort(rng.integers(0, 10**7, 1000)), np.arange(700)):
        code = token_file.EliasFano(token_file.ef_encode(np.array(values)))
        assert code.values().tolist() == list(values) == [code[i] for i in range(len(code))]
    with pytest.raises(IndexError):
        code[700]


def test_token_file(spark, docs, rows, empty, tmp_path, monkeypatch):
    lib = library("byte_bpe_50k.json")
    path = str(tmp_path / "file")
    token_file.write(docs, path, P.path("byte_bpe_50k.json"), 2)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, bytes(r.token_ids)) for r in token_file.read(spark, path).collect())
    start, want = 0, []
    for i, t in sorted((-1 if r[0] is None else r[0], r[1] or "") for r in rows):
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    token_file.write(empty, str(tmp_path / "none"), P.path("byte_bpe_50k.json"), 2)
    assert token_file.read(spark, str(tmp_path / "none")).count() == 0


# -- 2, 4


def test_toxicity(spark, docs, labels, empty):
    out = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(out) == 76 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    rnd = random.Random(3)
    texts = [" ".join([*(rnd.choice("blue house tree seven river under".split()) for _ in range(40)), *["worthless"] * bad]) for bad in [0, 1] * 100]
    model = toxicity.fit(texts, [0, 1] * 100)
    distances = toxicity.Distances(model.ordinary, model.toxic)
    scores = model.score(np.array([distances.counts(t) for t in ["the house of worthless trees", "the house of blue trees", ""]]))
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5
    assert toxicity.scored(empty, labels).count() == 0
    assert max(r.score for r in toxicity.scored(docs, labels.limit(0)).collect()) < 1e-9


def test_learns_only_from_its_fold(labels):
    ids = [r.doc_id for r in labelled.sample(labels, "toxic", {1: 1000, 0: 1000}).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_gam(docs, labels, empty):
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85  # only a pair explains it
    one = model.start + sum(t[np.searchsorted(e, v, "right")] for t, e, v in zip(model.tables, model.edges, x[7]))
    one += sum(t[np.searchsorted(model.coarse[i], x[7, i], "right"), np.searchsorted(model.coarse[j], x[7, j], "right")] for (i, j), t in model.pairs.items())
    assert model.score(x[7:8])[0] == pytest.approx(1 / (1 + math.exp(-one)))
    out = gam.scored(docs, labels).collect()
    assert len(out) == 77 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert gam.scored(empty, labels).count() == 0
    assert {r.score for r in gam.scored(docs, labels.limit(0)).collect()} == {0.5}


# -- 5


def plain_measures(text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_rules(docs, rows, labels, empty):
    rnd = random.Random(8)
    for _ in range(300):
        text = " ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) + rnd.choice(["", "\na\nb\na\n\n \n", "#$ <|>"])
        assert quality_rules.measure(text)[:5] == plain_measures(text)
    out = quality_rules.judged(docs, labels)
    assert found(out, "doc_id", *quality_rules.COUNTS) == Counter((r[0], *plain_measures(r[1])) for r in rows)
    verdict = {(r.doc_id, r.n_words, r.kept) for r in out.collect()}
    kept = found(quality_rules.keep_good(docs, labels), *docs.columns)
    assert sum(kept.values()) == sum(r.kept for r in out.collect()) and {r[0] for r in kept} == {i for i, _, k in verdict if k}
    assert all(not k or n >= 20 for _, n, k in verdict)
    assert quality_rules.judged(empty, labels).count() == 0 == quality_rules.keep_good(empty, labels).count()


def test_binomial_tail_and_verdicts(docs):
    assert quality_rules.binomial_tail(1, 4, 0.25) == pytest.approx(0.75**4 + 4 * 0.25 * 0.75**3)
    certified = {0: {"symbol_share": 3, "word_length": 40}, 1: {"capital_share": 0}}
    measured = quality_rules.measures(docs)
    got = found(quality_rules.verdicts(measured, certified), "doc_id", "kept")
    want = Counter((r[0], quality_rules.passes(tuple(r[1:]), certified)) for r in measured.collect())
    assert got == want


def test_cutoffs_spare_good_documents(spark):
    rnd = random.Random(5)
    good = [" ".join(rnd.choice(WORDS[:10]) + rnd.choice("abcdefgh") for _ in range(rnd.randrange(25, 95))) for _ in range(2500)]
    bad = [t.replace(" ", "$$ ") for t in good[:200]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2500)) for i in range(2700)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    fine = [i for i in range(2500) if not out[i].base_failed]
    assert sum(not out[i].kept for i in fine) <= quality_rules.RISK * len(fine)
    assert not any(out[i].kept for i in range(2500, 2700))


# -- 6


def test_url_rules(spark):
    rnd = random.Random(6)
    hosts = ["net", "a.net", "example.net", "EXAMPLE.net", "b.example.net", "xnet", "example.com", "org", "w.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/5", "/de/", "/de/x/y", "/fr/", "/en//z"]
    urls = [None, "", "nothing", "http://", *[f"https://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?a=/en/', '#/en/', '?x://y'])}" for _ in range(200)]]
    rules = [*queries.URL_RULES, ("allow", "net", "/en"), ("block", "", "/de/x/"), ("block", "a.net", "/"), ("allow", "a.net", "/")]
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")

    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url[url.index("://") + 3 :]
            cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [(0 if not h else h.count(".") + 1, len(p), a == "block", h + p, a) for a, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[3:] if fit else (None, "allow")))

    assert found(url_rules.judge(pages, rules), "page_id", "host", "path", "rule", "verdict") == Counter((i, *plain(u)) for i, u in enumerate(urls))
    assert url_rules.judge(pages.limit(0), rules).count() == 0


# -- 8


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_simhash(docs, rows, empty):
    got = found(simhash.near_groups(docs), "doc_id", "fp", "component_id")
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    links = [(a, b) for _, a in fps for _, b in fps if (a ^ b).bit_count() <= 4]
    root = plain_components({f for _, f in fps}, links)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f - (1 << 64) * (f >> 63), least.get(root[f])) for i, f in fps)
    stay = simhash.drop_near(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == {None, *least.values()}
    assert simhash.near_groups(empty).count() == 0 == simhash.drop_near(empty).count()


@pytest.mark.parametrize("block", [4_000_000, 3_000])
def test_meeting_loses_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = random.Random(7)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:  # crowds
        for _ in range(6):
            fps.add(f ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 6))))
    fps = sorted(fps)
    meeting = simhash.Meeting(np.array(fps, np.uint64), 4)
    meeting.meet(np.arange(len(fps)), np.full(len(fps), 2), 64)
    root = plain_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert meeting.label.tolist() == [root[i] for i in range(len(fps))]
    signed = [(f - (1 << 64) * (f >> 63),) for f in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long")).collect()
    index = {s: i for i, (s,) in enumerate(signed)}
    assert plain_components(range(len(fps)), [(index[r.a], index[r.b]) for r in links]) == root


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(40)] + [(600, 600 + i) for i in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = plain_components({x for p in links for x in p}, links)
    assert {n: got.get(n, n) for n in root} == root


# -- 10, 3


def test_exact_dedup(docs, rows, empty, monkeypatch):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i is None, i))
    want = Counter()
    for text, own in groups.items():
        keep = min(own)[2]
        want.update((i, keep, len(own), i == keep, hashlib.sha256(text.encode()).hexdigest()) for _, _, i in own)
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert found(dedup.exact_groups(docs), *columns) == want
    stay = dedup.drop_repeats(docs)
    assert stay.columns == docs.columns and Counter(r.doc_id for r in stay.collect()) == Counter(min(own)[2] for own in groups.values())
    assert dedup.exact_groups(empty).count() == 0 == dedup.drop_repeats(empty).count()
    monkeypatch.setattr(dedup, "BROADCAST_BITMAPS", -1)  # the way for filters that are too large to broadcast
    assert found(dedup.exact_groups(docs), *columns) == want


def test_single_rows_are_not_grouped(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = dedup.with_test(*(lambda d: (d, dedup.repeated_bits(d, 98304), 98304))(dedup.with_digest(docs)))
    assert rows.filter(dedup.MAYBE).count() < 250


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    wanted, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = wanted - sum(2 * sizes[s] for s in full)
        weights = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / weights for s in order}
        above = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def test_mixing(spark, docs, rows, empty):
    out = mixing.mix(docs).collect()
    size = {(r[0], r[1]): plain_measures(r[1])[0] for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size[r[0], r[1]]
    target = plain_targets(sizes)
    taken = Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies <= 2 * r.size
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, n) for (i, _), n in [((r[0], r[1]), size[r[0], r[1]]) for r in rows])
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= max(0.03 * target[s], 0.6 * largest) for s in sizes)
    assert found(mixing.mix(docs), "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in out)  # again
    copies = mixing.copies(docs)
    assert copies.columns == docs.columns and Counter(r.doc_id for r in copies.collect()) == sum((Counter({r.doc_id: r.copies}) for r in out), Counter())
    assert mixing.mix(empty).count() == 0 == mixing.copies(empty).count()


def test_mix_comes_near_many_targets(spark):
    rnd = random.Random(11)
    rows = [(i, "w " * int(rnd.lognormvariate(4, 1)), "abcdefg"[min(int(rnd.expovariate(0.7)), 6)]) for i in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"))
    assert all(abs(r.taken / r.target - 1) < 0.01 for r in out.collect())


# -- the pipeline


def plain_stage(i, rows, labels):
    """The multiset that stage i keeps of rows."""
    if i == 0:
        certified = plain_cutoffs(rows, labels)
        return Counter(r for r in rows if plain_verdict(r[1], certified))
    if i == 1:
        groups = defaultdict(list)
        for r in rows:
            groups["".join((r[1] or "").translate(str.maketrans("", "", " \t\n\x0b\x0c\r")))].append(r)
        return Counter(min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values())
    if i == 2:
        words = [(r[1] or "").encode().lower().split() for r in rows]
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
        fps, root = [simhash.fingerprint(r[1] or "") for r in rows], list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 4 or words[a] == words[b]:
                    root = [root[b] if x == root[a] else x for x in root]
        groups = defaultdict(list)
        for r, x in zip(rows, root, strict=True):
            groups[x].append(r)
        return Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    return MIXED


class Mixed:
    """What a mix may be: any multiset of rows, each at most twice (the words it takes are tested with the operator)."""

    def __eq__(self, other):
        return all(n <= 2 for n in other.values())


MIXED = Mixed()


def plain_cutoffs(rows, labels):
    """Certified cutoffs in bins, by the plain measures and exact sums of binomial terms."""
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    halves, out = {}, {}
    for r in rows:
        m = quality_rules.measure(r[1] or "")
        if r[0] in good and m[0] >= 20 and 100 * m[4] <= 30 * m[0]:
            stratum = sum(m[0] >= s for s in quality_rules.STRATA[1:])
            bins = {name: min(int(v / top * quality_rules.BINS), quality_rules.BINS - 1) for (name, top), v in zip(quality_rules.RULES.items(), m[5:], strict=True)}
            proposes = zlib.crc32(f"half {r[0]}".encode()) % 2 == 0
            halves.setdefault((stratum, proposes), {})[r[0]] = min(halves.get((stratum, proposes), {}).get(r[0], (tuple(bins.values()), bins)), (tuple(bins.values()), bins))
    for stratum in range(len(quality_rules.STRATA)):
        proposing, testing = ([b for _, b in halves.get((stratum, p), {}).values()] for p in (True, False))
        for level in quality_rules.LEVELS if testing else ():
            cut = {name: next(b for b in range(quality_rules.BINS) if sum(x[name] > b for x in proposing) <= level * len(proposing)) for name in quality_rules.RULES}
            k, n = sum(any(x[r] > cut[r] for r in cut) for x in testing), len(testing)
            if sum(math.comb(n, j) * quality_rules.RISK**j * (1 - quality_rules.RISK) ** (n - j) for j in range(k + 1)) > quality_rules.CONFIDENCE / len(quality_rules.STRATA):
                break
            out[stratum] = cut
    return out


def plain_verdict(text, certified):
    m = quality_rules.measure(text or "")
    if m[0] < 20 or 100 * m[4] > 30 * m[0]:
        return False
    cut = certified.get(sum(m[0] >= s for s in quality_rules.STRATA[1:]), {})
    return all(min(int(v / top * quality_rules.BINS), quality_rules.BINS - 1) <= cut.get(name, quality_rules.BINS) for (name, top), v in zip(quality_rules.RULES.items(), m[5:], strict=True))


def test_pipeline(spark, docs, rows, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_dedup", "mixing", "byte_bpe"]
    stage, kept, inputs = spark.read.parquet(str(tmp_path / "documents.parquet")), [], []
    for _, f in corpus_pipeline.STAGES[:4]:
        inputs.append([tuple(r) for r in stage.collect()])
        stage = spark.createDataFrame(f(spark, stage, str(tmp_path)).collect(), SCHEMA)
        kept.append(found(stage, *docs.columns))
        assert set(kept[-1]) <= set(inputs[-1]) and stage.columns == docs.columns
    assert kept[:4] == [plain_stage(i, x, labels.collect()) for i, x in enumerate(inputs)]
    texts = ["".join((r[1] or "").split()) for r in kept[1]]
    assert len(texts) == len(set(texts)) and max(kept[2].values()) == 1 and max(kept[3].values()) <= 2
    lib = rank_encoding()
    text_of = {(r[0], r[1]) for r in rows}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert last and all(r.decoded_equal for r in last)
    known = {(i, np.array(lib.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in text_of}
    assert all((r.doc_id, bytes(r.token_ids)) in known for r in last)
    assert len(last) == sum(kept[3].values())


def test_pipeline_on_an_empty_table(spark, empty, labels, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "token_ids", "decoded_equal"]
