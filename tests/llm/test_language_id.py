import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import language_id as L


LIMITS = {"min_share": 0.4, "min_confidence": 0.5, "min_coverage": 0.5, "min_text": 0.75, "keep": None}


@pytest.fixture(scope="module")
def model(make):
    rng = random.Random(1)
    return L.train([(make(rng, k, 80), k) for k in ("en", "fr", "de") for _ in range(40)])


def slow_marginals(emit, a):
    n, k = emit.shape
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    s = np.full(k, 1 / k)
    for t in range(n):
        s = alpha[t] = (s @ a) * emit[t]
        s = alpha[t] = s / s.sum()
    for t in range(n - 2, -1, -1):
        beta[t] = a @ (emit[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    g = alpha * beta
    return g / g.sum(1, keepdims=True)


def test_blocks_give_forward_backward():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 31, 32, 33, 200, 0, 64, 5])
    emit = np.exp(rng.normal(size=(int(counts.sum()), 4))).astype(np.float32)
    tr = rng.normal(size=(4, 4)).astype(np.float32)
    got, at = L.marginals(emit, tr, counts), 0
    for c in counts:
        if c:
            assert np.allclose(got[at : at + c], slow_marginals(emit[at : at + c].astype(float), np.exp(tr - tr.max())), atol=2e-3)
        at += c


def test_held_out_words_of_switched_texts(model, make):
    rng = random.Random(2)
    texts, truth = [], []
    for _ in range(60):
        parts = [(make(rng, k, n), k, n) for k, n in ((rng.choice(["en", "fr", "de"]), rng.randint(8, 40)) for _ in range(4))]
        texts.append(" ".join(p[0] for p in parts))
        truth.append([k for _, k, n in parts for _ in range(n)])
    right = total = 0
    for r, want in zip(L.label(pa.array(texts), model, **LIMITS).to_pylist(), truth):
        got = [s["lang"] for s in r["spans"] for _ in range(s["n"])]
        assert r["n_words"] == len(want) == len(got)
        right += sum(a == b for a, b in zip(got, want))
        total += len(want)
    assert right > 0.93 * total


def test_table(spark, model, odd, none):
    got = {(r.doc_id, r.lang): r for r in L.identify(odd, model).collect()}
    assert L.identify(odd, model).count() == odd.count()
    assert got[3, None].spans == [] and not got[7, None].accepted and got[10, "fr"].accepted and got[6, "en"].n_words == 30_000
    kept = L.accepted(odd, model)
    assert kept.columns == odd.columns and {3, 4, 5, 7}.isdisjoint(r.doc_id for r in kept.collect()) and {1, 2, 6, 10, 11} <= {r.doc_id for r in kept.collect()}
    assert {r.doc_id for r in L.accepted(odd, model, keep=["fr"]).collect()} <= {10, 12, 8, 9, 13}
    assert L.identify(none, model).collect() == [] and L.accepted(none, model).collect() == []


def test_other_scripts_and_texts_of_symbols_are_rejected(model, make):
    rng = random.Random(3)
    clean = [make(rng, k, n) for k in ("en", "fr", "de") for n in (5, 60, 3000)]
    cyrillic = ["".join(chr(rng.randint(0x430, 0x44F)) if rng.random() < 0.8 else " " for _ in range(400)) for _ in range(5)]
    symbols = [" ".join(w + rng.choice(["###", "***", "%%%"]) for w in make(rng, "en", 60).split()) for _ in range(5)]
    got = [x["accepted"] for x in L.label(pa.array(clean + cyrillic + symbols), model, **LIMITS).to_pylist()]
    assert got == [True] * 9 + [False] * 10
    one = L.train([(make(rng, "en", 80), "en") for _ in range(20)])  # the posteriors of one language say nothing
    assert [x["accepted"] for x in L.label(pa.array([make(rng, "en", 50), cyrillic[0]]), one, **LIMITS).to_pylist()] == [True, False]


def test_affixes_of_one_to_four_bytes():
    words = L.Words(pa.array(["abcdef", "ab"]))
    feats, per = L.features(words, np.array([0, 1]))
    ends = np.cumsum(per)
    affixes = [set(feats[e - 8 : e].tolist()) for e in ends]
    assert len(affixes[0]) == 8 and min(map(min, affixes)) >= 65536 + L.TRI
    other = L.Words(pa.array(["abcxyz", "zzcdef"]))
    feats, per = L.features(other, np.array([0, 1]))
    same = [len(affixes[0] & set(feats[e - 8 : e].tolist())) for e in np.cumsum(per)]
    assert same == [3, 4]  # a, ab, abc; f, ef, def, cdef


def test_many_languages_are_all_kept():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k}": ["".join(rng.choice(letters) for _ in range(5)) for _ in range(12)] for k in range(70)}
    model = L.train([(" ".join(rng.choice(w) for _ in range(60)), k) for k, w in words.items() for _ in range(3)])
    assert len(model.langs) == 70 and model.lex_rows.shape[1] == 70
    got = L.label(pa.array([" ".join(rng.choice(w) for _ in range(30)) for w in words.values()]), model, **LIMITS).to_pylist()
    assert sum(x["lang"] == k for x, k in zip(got, words)) >= 68


def test_without_labels_nothing_is_judged(spark, odd, none):
    empty = L.fit(none)
    assert empty.langs == [] and L.identify(none, empty).collect() == [] and L.accepted(none, empty).collect() == []
    blank = odd.withColumn("lang", L.F.lit(None).cast("string"))
    model = L.fit(blank)
    got = L.identify(blank, model).collect()
    assert len(got) == odd.count() and {(r.lang, r.confidence, tuple(r.spans)) for r in got} == {(None, 0.0, ())}
    assert all(r.accepted == (r.n_words > 0) for r in got)
    assert L.train([("...", "en"), (None, "fr")]).langs == []
    assert set(L.fit(odd, per_language=3).langs) == {"en", "fr", "de", "ja"}


def test_the_sample_is_the_same_however_rows_are_dealt(spark, make):
    rng = random.Random(5)
    rows = [(make(rng, k, 5), k) for k in ("en", "fr") for _ in range(300)] + [("copy of one text", "en")] * 500
    docs = spark.createDataFrame(rows, "text string, lang string")
    a, b = (L.training_sample(d, 40) for d in (docs.repartition(2), docs.repartition(7)))
    assert a == b and len(a) == len(set(a)) == 80
