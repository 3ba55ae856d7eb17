"""Near copies against all pairs, on planted copies of a known similarity and on a large group of them."""

import random

from corpuslab.llm import near_copies

KNOWN = [f"w{k}" for k in range(5000)]


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_components_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PARTNERS", 5)
    rng = random.Random(5)
    texts = [None, "", "one", "ONE", "two words"]
    for _ in range(60):  # copies of similarity 0.7 to 0.95
        base = [rng.choice(KNOWN) for _ in range(300)]
        texts.append(" ".join(base))
        for edits in (2, 4, 6, 8, 10):
            other = list(base)
            for at in rng.sample(range(300), edits):
                other[at] = rng.choice(KNOWN)
            texts.append(" ".join(other))
    base = [rng.choice(KNOWN) for _ in range(300)]
    texts += [" ".join([*base[: 300 - 2 * k], *(rng.choice(KNOWN) for _ in range(2 * k))]) for k in range(60)]  # a group with a far end
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(order[k], t) for k, t in enumerate(texts)]
    sets = {d: shingles(t) for d, t in rows}
    part = {d: d for d in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    n_pairs = 0
    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                n_pairs += 1
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    assert n_pairs > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {d: root(d) for d in sets}
    for most in (near_copies.CELL_MOST, 8):
        monkeypatch.setattr(near_copies, "CELL_MOST", most)
        got = {r["doc_id"]: r["component_id"] for r in near_copies.components(docs).collect()}
        assert got == want
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == set(want.values())


def test_rows_without_or_with_repeated_ids_stay_once(spark):
    t = " ".join(KNOWN[:40])
    docs = spark.createDataFrame([(1, t, "a"), (1, t, "a"), (2, t + " end", "b"), (None, t, "c"), (3, None, "d")], "doc_id long, text string, lang string")
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert near_copies.keep_one(docs.limit(0)).count() == 0
