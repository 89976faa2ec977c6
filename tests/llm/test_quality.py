import random
from collections import Counter, defaultdict
from math import exp, log

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality as Q


def slow_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    common = {c: i + 1 for i, (c, _) in enumerate(sorted(Counter("".join(t.lower() for t in texts)).items(), key=lambda x: (-x[1], ord(x[0])))[: Q.PLAIN - 1])}
    sym = lambda c: common[c] if c in common else Q.PLAIN + int(Q.mix(Q.np.array([ord(c)], Q.np.uint64))[0]) % 63
    seqs = [[0] * 4 + [sym(c) for c in t.lower()] for t in texts]
    counts = {5: Counter(tuple(s[i - 4 : i + 1]) for s in seqs for i in range(4, len(s)))}
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: Q.discount(*[sum(1 for v in c.values() if v == i) for i in range(1, 5)]) for k, c in counts.items()}
    total, off = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            off[k, g[:-1]] += d[k][min(n, 3) - 1]
    v = len(counts[1]) + 1

    def p(g):
        if not g:
            return 1 / v
        k, h = len(g), g[:-1]
        if not total[k, h]:
            return p(g[1:])
        n = counts[k][g]
        return (max(n - d[k][min(n, 3) - 1], 0) if n else 0) / total[k, h] + off[k, h] / total[k, h] * p(g[1:])

    def perplexity(t):
        s = [0] * 4 + [sym(c) for c in t.lower()]
        return exp(-sum(log(p(tuple(s[i - 4 : i + 1]))) for i in range(4, len(s))) / (len(s) - 4))

    return perplexity


@pytest.fixture(scope="module")
def texts(make):
    rng = random.Random(8)
    rows = [(i, make(rng, k, rng.randint(20, 60)), k) for i in range(60) for k in [("en", "fr")[i % 2]]]
    rows += [(900, "zq%% xx## kk@@ " * 20, "en"), (901, make(rng, "de", 30), "de"), (902, None, "en"), (903, "", "fr"), (904, "déjà 日本 x", "fr"), (None, rows[0][1], "en"), (5, rows[5][1], "fr")]
    return rows


@pytest.mark.parametrize("by_join", [False, True])
def test_perplexity_equals_the_slow_model(spark, texts, by_join):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60) if i % 4 < 2] + [(None,), (902,), (0,)], "doc_id long")
    got = Q.classify(docs, trusted, by_join=by_join).collect()
    assert len(got) == len(texts)
    held = {r.doc_id for r in trusted.where(F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(Q.HELD_OUT)) == 0).collect()}
    ids = {i for i in range(60) if i % 4 < 2} - held
    assert 0 < len(held) < 15
    model = {k: slow_model([t for i, t, lang in texts if i in ids and lang == k and t]) for k in ("en", "fr")}
    for r in got:
        t = next(t for i, t, k in texts if i == r.doc_id and k == r.lang)
        if r.lang == "de" or not t:
            assert r.perplexity is None and r.keep
        else:
            assert r.perplexity == pytest.approx(model[r.lang](t), rel=1e-3)
    keep = {r.doc_id: r.keep for r in got}
    assert not keep[900] and sum(keep[i] for i in range(60)) >= 54


def test_odd_documents(spark, odd, none):
    trusted = odd.select("doc_id").where("doc_id in (1, 6)")
    got = Q.classify(odd, trusted).collect()
    assert len(got) == odd.count() and {r.lang for r in got if r.perplexity is not None} == {"en"}
    assert all(r.keep for r in Q.classify(odd, trusted.limit(0)).collect())
    assert Q.classify(none, trusted).collect() == []


@pytest.mark.parametrize("by_join", [False, True])
def test_languages_whose_trusted_texts_are_all_held_out(spark, make, by_join):
    rng = random.Random(3)
    ids = spark.range(200).select(F.col("id").alias("doc_id"))
    out = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(Q.HELD_OUT)) == 0
    held, free = ([r.doc_id for r in ids.where(c).collect()] for c in (out, ~out))
    rows = [(i, make(rng, "en", 40), "en") for i in free[:20] + held[:3]] + [(held[5], make(rng, "fr", 40), "fr"), (held[6], make(rng, "fr", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.classify(docs, docs, by_join=by_join).collect()}
    assert len(got) == len(rows) and got[held[5]].perplexity is None and got[held[5]].keep and got[held[6]].keep
    assert got[free[0]].perplexity > 1 and got[free[0]].threshold is not None  # by the few of all languages
    none = Q.classify(docs.where(F.col("doc_id") == held[5]), docs, by_join=by_join).collect()
    assert len(none) == 1 and none[0].perplexity is None and none[0].keep
    only = docs.where(F.col("lang") == "fr")
    assert [r.keep for r in Q.classify(only, only, by_join=by_join).collect()] == [True]


def test_other_scripts_have_symbols_of_their_own(spark):
    rng = random.Random(4)
    hindi = ["".join(chr(rng.choice([0x915, 0x93E, 0x928, 0x940, 0x930, 0x947, 0x20])) for _ in range(200)) for _ in range(60)]
    odd = "".join(chr(rng.randint(0x900, 0x97F)) for _ in range(200))
    docs = spark.createDataFrame([(i, t, "hi") for i, t in enumerate(hindi)] + [(100, odd, "hi")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.classify(docs, docs.where("doc_id < 60")).collect()}
    assert not got[100].keep and sum(got[i].keep for i in range(60)) >= 58


def test_more_languages_than_one_group(spark, make, monkeypatch):
    monkeypatch.setattr(Q, "GROUP", 2)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, make(rng, "en", 30), f"l{i % 5}") for i in range(40)], "doc_id long, text string, lang string")
    got = Q.classify(docs, docs).collect()
    assert len(got) == 40 and all(r.perplexity > 1 for r in got)


def test_keys_are_of_whole_characters():
    known = Q.np.array([97, 98, (1 << 21) | 233], Q.np.uint64), Q.np.array([7, 8, 9], Q.np.uint64)
    key, n = Q.keys_of(pa.array(["ab", None, "É"]), Q.np.array([0, 0, 1]), known)
    assert n.tolist() == [2, 0, 1] and key.tolist() == [7, (7 << 11) | 8, 9]
