import random

import numpy as np

from corpusloom.llm import decontamination as D
from corpusloom.llm.textkit import words_of


def similarity(a, b, n):
    """Weighted Jaccard of word shingles; a shingle weighs its bytes."""
    from collections import Counter

    n = min(n, len(b))
    sh = lambda w: Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))
    x, y = sh(a), sh(b)
    weigh = lambda s: len("".join(s).encode())
    lo = sum(min(x[s], y[s]) * weigh(s) for s in x)
    hi = sum(max(x[s], y[s]) * weigh(s) for s in set(x) | set(y))
    return lo / hi


def brute(docs, items, n, t):
    out = {}
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            if w and v:
                best = max(similarity(w[k : k + len(v)], v, n) for k in range(max(1, len(w) - len(v) + 1)))
                if best >= t:
                    out[d, i] = best
    return out


def leaky(make, seed=1):
    rng = random.Random(seed)
    items = [(i, make(rng, "en", rng.randint(8, 40))) for i in range(25)] + [(100, "two words"), (101, "one"), (102, None), (103, "")]
    docs = []
    for d in range(80):
        text = make(rng, "en", rng.randint(5, 150))
        if d % 2:
            w = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, len(w) // 6)):
                w[rng.randrange(len(w))] = make(rng, "en", 1)
            text += " " + ("! ".join(w) if d % 4 == 1 else " ".join(w).upper()) + " " + make(rng, "en", 20)
        docs.append((d, text))
    return docs, items


def test_finds_what_brute_force_finds(spark, make):
    docs, items = leaky(make)
    got = {(r.doc_id, r.item_id): r.similarity for r in D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items, 3, 0.6)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) > 15
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got if want[k] > 0.85)


def test_passes_give_the_same(spark, make, monkeypatch):
    docs, items = leaky(make, 2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, D.find(d, b).collect()))
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 7)
    assert sorted(map(tuple, D.find(d, b).collect())) == once
    gone = {r[0] for r in once}
    assert {r.doc_id for r in D.clean(d, b).collect()} == {i for i, _ in docs} - gone


def test_blocks_hold_every_item_in_the_radius():
    rng = np.random.default_rng(0)
    index = D.Index([(i, " ".join(map(str, rng.integers(0, 50, 12)))) for i in range(60)], 3, 9)
    kind = next(iter(index.classes.values()))
    probes = kind["prints"].copy()
    for k in range(len(probes)):
        for bit in rng.choice(64, int(rng.integers(0, 15)), replace=False):
            probes[k] ^= np.uint64(1 << int(bit))
    win, item, far = index.within(kind, probes)
    dist = np.bitwise_count(probes[:, None] ^ kind["prints"][None])
    assert set(zip(win.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(dist <= 9))))


def test_odd_documents(spark, odd, none):
    base = odd.where("doc_id = 1").first().text
    items = spark.createDataFrame([(1, base), (1, base), (2, None), (3, ""), (4, "word"), (None, base)], "item_id long, text string")
    got = D.find(odd, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in got if r.item_id in (1, None)) == sorted([(d, i) for d in (0, 1, 2, 2) for i in (0, 1, 1)])
    assert {r.doc_id for r in got if r.item_id == 4} == {8, 9}
    kept = D.clean(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 10, 11, 12, 13}
    assert D.find(none, items).collect() == [] and D.find(odd, items.limit(0)).collect() == [] and D.clean(odd, items.limit(0)).count() == odd.count()


def test_weighted_jaccard_counts_repeats():
    a, b = np.array([1, 1, 2], np.uint64), np.array([1, 2, 2], np.uint64)
    assert D.weighted_jaccard(a, np.array([5, 5, 1]), b, np.array([5, 1, 1])) == 6 / (11 + 7 - 6)
