"""Classes of near duplicates by fingerprints against all pairs, wherever they stand in the corpus."""

import random

import pytest

from corpuslab.llm import editprint

VOCAB = [f"word{k}" for k in range(800)]


@pytest.mark.parametrize("most", [editprint.CELL_MOST, 4])
def test_classes_equal_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(editprint, "CELL_MOST", most)
    rng = random.Random(8)
    texts = [None, "", "a", "a short one"]
    for _ in range(30):
        base = [rng.choice(VOCAB) for _ in range(rng.randint(100, 500))]
        texts.append(" ".join(base))
        for edits in (0, 1, 3):
            other = list(base)
            for at in rng.sample(range(len(base)), edits):
                other[at] = rng.choice(VOCAB)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    got = editprint.near_classes(docs).collect()
    assert len(got) == len(texts) + 1
    prints = {r["doc_id"]: editprint.parse(r["fingerprint"]) for r in got if r["doc_id"] is not None}
    part = {d: d for d in prints}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    n_pairs = 0
    for a in prints:
        for b in prints:
            if a < b and editprint.likeness(prints[a], prints[b]) >= 0.8:
                n_pairs += 1
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    assert n_pairs > 60
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == {d: root(d) for d in prints}
    assert editprint.near_classes(docs.limit(0)).count() == 0
