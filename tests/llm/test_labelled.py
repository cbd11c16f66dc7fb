"""The classifiers' fits where the sample holds the labels in other shares than the table."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from ledgerproof.llm import gam, labelled, toxicity  # noqa: E402


def test_capped_class_keeps_its_share():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (9000, 1)).astype(float)
    y = (rng.random(9000) < np.where(x[:, 0] > 0, 0.2, 0.02)).astype(float)
    few = np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y == 0)[: int(2 * y.sum())]])
    counts = {0: int((y == 0).sum()), 1: int((y == 1).sum())}
    at = np.array([[0.0], [1.0]])
    assert gam.fit(x[few], y[few], counts).score(at) == pytest.approx(gam.fit(x, y).score(at), abs=0.03)
    full, part = (np.column_stack([np.ones(len(k)), x[k]]) for k in (np.arange(9000), few))
    w = labelled.logistic(part, y[few], weight=labelled.weights(y[few], counts))
    assert w == pytest.approx(labelled.logistic(full, y), abs=0.2)


def test_score_of_a_weak_hit_does_not_depend_on_the_caps():
    texts = ["blue house tree"] * 400 + ["blue house worthless"] * 40 + ["blue tree worthless"] * 60
    label = [0] * 440 + [1] * 60
    few = [*range(100), *range(400, 410), *range(440, 500)]
    got = []
    for chosen, counts in ((range(500), None), (few, {0: 440, 1: 60})):
        model = toxicity.fit([texts[i] for i in chosen], [label[i] for i in chosen], counts)
        distances = toxicity.Distances(model.ordinary, model.toxic)
        got.append(model.score(np.array([distances.counts("blue tree worthless")]))[0])
    assert got[0] == pytest.approx(got[1], abs=0.05)


def test_counts_of_what_may_be_learned(spark):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    docs = spark.range(200).withColumnRenamed("id", "doc_id")
    want = {v: sum(int(i % 3 == 0) == v and not held for i, held in ids) for v in (0, 1)} if (ids := [(r.doc_id, r.h) for r in docs.select("doc_id", labelled.held_out().alias("h")).collect()]) else {}
    assert labelled.learnable(docs, labels, "toxic") == want
