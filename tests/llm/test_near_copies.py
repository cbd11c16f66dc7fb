"""The pipeline's near copies against brute force: SimHash's links and all that share 0.8 of their five-word shingles."""

import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from ledgerproof.llm import near_copies, simhash  # noqa: E402


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("few", [0, 10**9])
def test_reaches_four_fifths(spark, monkeypatch, few):
    monkeypatch.setattr(near_copies, "PAIRS_PER_MEMBER", few)
    rnd = random.Random(12)
    texts = [None, "", "one two", "One  TWO", "one two three"]
    for edits in (1, 2, 2, 3, 4, 5):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        for _ in range(6):
            copy = list(words)
            for at in rnd.sample(range(120), edits):
                copy[at] = f"x{rnd.randrange(5000)}"
            texts.append(" ".join(copy))
    sets, fps = [plain_set(t) for t in texts], [simhash.fingerprint(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 4:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(docs).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(texts) - 5
    stay = corpus_pipeline.near(spark, docs, "")
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == set(root)
    assert near_copies.drop_near(docs.limit(0)).count() == 0


def test_rows_that_share_a_doc_id(spark):
    """A text is never lost because another row with its doc_id goes."""
    rnd = random.Random(4)
    a, b, c = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(60)) for _ in range(3))
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (5, b.upper(), "t"), (None, c, "s"), (None, b, "s"), (9, c + " more", "s"), (None, None, "s"), (1, "", "s"), (7, a, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    want = sorted([(3, a), (5, b.upper()), (9, c + " more"), (1, "")])
    for drop in (near_copies.drop_near, simhash.drop_near):
        stay = drop(docs)
        assert stay.columns == docs.columns
        assert sorted((r.doc_id, r.text) for r in stay.collect()) == want


def test_meeting_pairs_miss_no_similar_pair(spark):
    """Random sets around a few cores, one root of many members among them, against all pairs."""
    rnd = random.Random(9)
    cores = [rnd.sample(range(400), size) for size in (4, 9, 30, 31, 60)]
    rows = []
    for node in range(160):
        core = cores[node % 5]
        kept = [x for x in core if rnd.random() > rnd.choice([0, 0.05, 0.1])] or core[:1]
        rows.append((node, sorted({*kept, *rnd.sample(range(400), rnd.randrange(1 + len(core) // 8))}), 0 if node % 3 else node))
    sets = spark.createDataFrame([r[:2] for r in rows], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(r[0], r[2]) for r in rows], "node long, root long")
    got = {(r.a, r.b) for r in near_copies.meeting_pairs(sets, nodes).collect()}
    apart = [(x, y) for x in rows for y in rows if x[0] < y[0] and x[2] != y[2]]
    similar = set()
    for (a, x, _), (b, y, _) in apart:
        both = len(set(x) & set(y))
        if 10 * both >= 8 * (len(x) + len(y) - both):
            similar.add((a, b))
    assert len(similar) > 200 and similar <= got <= {(x[0], y[0]) for x, y in apart}
    assert near_copies.meeting_pairs(sets, nodes.limit(0)).count() == 0


def test_a_crowd_below_the_similarity_meets_rarely(spark):
    """Texts that share three fifths of their shingles are not tried pair by pair."""
    rnd = random.Random(5)
    common = list(range(60))
    rows = [(node, common + [1000 + rnd.randrange(2000) for _ in range(40)]) for node in range(300)]
    sets = spark.createDataFrame([(n, sorted(set(s))) for n, s in rows], "node long, shingles array<long>")
    nodes = spark.createDataFrame([(n, n) for n, _ in rows], "node long, root long")
    held = Counter(x for _, own in rows for x in set(own))
    ranked = {n: sorted(set(own), key=lambda x: (held[x], x)) for n, own in rows}
    taken = {n: {x: len(r) - at for at, x in enumerate(r[: len(r) * 2 // 10 + 1])} for n, r in ranked.items()}
    want = set()
    for b in range(300):
        for a in range(b):
            left = [min(taken[a][x], taken[b][x]) for x in taken[a].keys() & taken[b].keys()]
            if left and 18 * max(left) >= 8 * (len(ranked[a]) + len(ranked[b])):
                want.add((a, b))
    got = {(r.a, r.b) for r in near_copies.meeting_pairs(sets, nodes).collect()}
    assert got == want and 0 < len(want) < 300 * 299 / 2 / 5
