import random

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as J
from corpusloom.llm.textkit import words_of


def sets(text, n):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, t):
    """class and number of links of each linked id; rows have different ids, or one text an id."""
    s = sorted({(i, x): (i, sets(x, n)) for i, x in rows if i is not None}.values(), key=lambda x: x[0])
    up, count = {i: i for i, _ in s}, {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(s):
        for j, b in s[k + 1 :]:
            if a and b and len(a & b) / len(a | b) >= t:
                count[i], count[j] = count.get(i, 0) + 1, count.get(j, 0) + 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (root(i), c) for i, c in count.items()}


def linked(docs, *args, **options):
    return {r.doc_id: (r.class_id, r.n_links) for r in J.links(docs, *args, **options).collect()}


def family(make, seed, n_docs, size):
    rng = random.Random(seed)
    base = [make(rng, rng.choice(["en", "fr"]), rng.randint(1, size)).split() for _ in range(n_docs // 4)]
    rows = []
    for i in range(n_docs):
        w = list(rng.choice(base))
        for _ in range(int(len(w) * rng.choice([0, 0, 0.02, 0.05, 0.1, 0.3]))):
            w[rng.randrange(len(w))] = make(rng, "en", 1)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,t,n,size", [(1, 0.7, 3, 150), (3, 0.6, 3, 8), (4, 0.9, 1, 400), (5, 0.5, 2, 60)])
def test_all_links_and_no_others(spark, make, monkeypatch, seed, t, n, size):
    monkeypatch.setattr(J, "BUCKET_SIGNATURES", 500)  # several buckets a band
    rows = family(make, seed, 160, size)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, n, t)
    assert len(want) > 20 and linked(docs, n, t) == want
    if t < 0.9:
        assert linked(docs, n, t, hot=3, block=5, grams=600) == want  # chained groups, and components in several cells


@pytest.mark.parametrize("t", [0.5, 0.7, 0.85, 1.0])
def test_bands_and_bounds(t):
    table = [x for x in J._bands(1 << 16, t) if x[0] <= 5000][:200]
    assert table[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(table, table[1:]))
    for tag, (low, high) in enumerate(table):
        n1, n2, k2 = J.plan(high, t)
        k = int(2 * high * (1 - t) / (1 + t) + 1e-9)
        assert n1 * (k2 + 1) > k and k2 < n2 and J.least_matches(np.array(k), n1, n2, k2) > 0
        # any partner of a set lies in its band or the next
        assert J.tags_of(np.array([int(high / t + 1e-9)]), t)[0] <= tag + 1


def test_subsets_are_enumerated_at_the_registered_threshold():
    for low, high in J._bands(300_000, 0.7):
        if high >= 12:
            n1, n2, k2 = J.plan(high, 0.7)
            assert k2 >= 1 and n2 > k2 + 1, (high, n1, n2, k2)


@pytest.mark.parametrize("n1,n2,k2", [(4, 3, 1), (2, 5, 2), (6, 1, 0), (3, 4, 1)])
def test_least_matches_by_trial(n1, n2, k2):
    rng = random.Random(1)
    for d in range(n1 * (k2 + 1)):
        seen = []
        for _ in range(400):
            bad = {(rng.randrange(n1), rng.randrange(n2)) for _ in range(d)}
            seen.append(sum(all((p, s) not in bad for s in c) for p in range(n1) for c in J.combinations(range(n2), n2 - k2)))
        assert min(seen) >= int(J.least_matches(np.array(d), n1, n2, k2)) > 0


def test_signatures_meet_as_often_as_a_pair_needs():
    rng = np.random.default_rng(0)
    tried = 0
    for trial in range(300):
        t = [0.6, 0.7, 0.8][trial % 3]
        size = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 2**64, size, np.uint64))
        keep = a[rng.random(len(a)) > (1 - t) * rng.random()]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(0, 4)), np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if not len(b) or shared == len(a) == len(b) or shared / (len(a) + len(b) - shared) < t:
            continue
        tried += 1
        h, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        sizes = np.diff(first)
        tags = J.tags_of(sizes, t)
        own = {(tag, step): docs.tolist() for tag, step, docs in J.signers(sizes, t)}
        tag = int(tags.max())
        assert all(k in own.get((tag, int(tag > tags[k])), []) for k in (0, 1))
        sig, owner, omitted = J.sign(h, first, np.array([0, 1]), tag, t)
        known = np.zeros(2, J._ENTRY)
        known["id"], known["size"], known["omitted"], known["tag"] = [1, 2], sizes, omitted, 2 * tag + (tags < tag)
        x, y, n, need, _ = J.candidates(known, (sig >> np.uint64(32)).astype(np.uint32), owner.astype(np.uint32), t, 32)
        assert (x.tolist(), y.tolist()) == ([1], [2]) and n[0] >= need[0] >= 1
        _, y, hot, sure, _ = J.candidates(known, (sig >> np.uint64(32)).astype(np.uint32), owner.astype(np.uint32), t, 1)
        assert set(y.tolist()) == {1, 2} and set(hot.tolist()) == {-n[0]} and all(1 <= x <= n[0] for x in sure)
    assert tried > 150


def test_a_large_cluster_and_many_copies(spark, make):
    rng = random.Random(9)
    base = make(rng, "en", 120).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(len(w))] = make(rng, "fr", 1)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(40)] + [(2000 + i, make(rng, "de", 100)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs) == linked(docs, hot=10, block=50, grams=5000) == brute(rows, 3, 0.7)
    assert {r.doc_id for r in J.one_of_each_group(docs).collect()} == {0, *range(2000, 2040)}


def test_odd_documents(spark, odd, none):
    assert linked(odd) == {1: (1, 1), 2: (1, 1), 8: (8, 1), 9: (8, 1)}
    kept = J.one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13]
    assert J.links(none).collect() == [] and J.one_of_each_group(none).collect() == []
    clash = odd.select("*", *[odd["size"].alias(c) for c in ("gone", "gone_", "__gone", "doc", "hi", "lo", "rep")])
    assert J.one_of_each_group(clash).count() == 12
    with pytest.raises(ValueError):
        J.links(odd, threshold=0)


def test_an_id_with_several_texts_joins_their_classes(spark):
    rows = [(1, "a b c d e"), (2, "f g h i j"), (2, "k l m n o"), (3, "k l m n o"), (4, "a b c d e"), (5, "f g h i j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked(docs) == {1: (1, 1), 4: (1, 1), 2: (2, 2), 3: (2, 1), 5: (2, 1)}
    assert sorted(r.doc_id for r in J.one_of_each_group(docs).collect()) == [1, 2, 2]
