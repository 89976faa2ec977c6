import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import weighting
from corpusloom.operators import bags, lm
from corpusloom.operators import corpus as co
from corpusloom.operators import ngrams as ng
from corpusloom.operators.corpus import Corpus
from corpusloom.plans import Pipeline
from corpusloom.plans.spec import NgramSpec
from corpusloom.plans.shipped import step

WORDS = {"sequence": [step("split", pattern=r"\s+")]}


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the cat ran fast"), (3, "a dog ran ran")], "doc_id long, text string")
    return Corpus(docs, Pipeline(WORDS))


def one(df, *cols):
    return {tuple(r[c] for c in cols[:-1]) if len(cols) > 2 else r[cols[0]]: r[cols[-1]] for r in df.collect()}


def test_vocabulary(small):
    v = small.vocabulary
    assert one(v, "token", "term_id") == {"the": 0, "cat": 1, "sat": 2, "ran": 3, "fast": 4, "a": 5, "dog": 6}
    assert one(v, "token", "ttf")["ran"] == 3 and one(v, "token", "df") == {"the": 2, "cat": 2, "ran": 2, "sat": 1, "fast": 1, "a": 1, "dog": 1}
    assert tuple(small.stats.first()) == (3, 11)
    order = [r.token for r in co.reduce_ids(v).orderBy("term_id").collect()]
    assert order == ["ran", "the", "cat", "sat", "fast", "a", "dog"]


def test_ngram_stats_by_length(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b a"), (3, "a"), (4, ""), (5, None)], "doc_id long, text string")
    got = Corpus(docs, Pipeline({**WORDS, "ngrams": {"n": [1, 2]}})).ngram_stats
    assert got.columns == ["n", "token", "ttf", "df"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", 4, 3), (1, "b", 3, 2), (2, "a b", 2, 1), (2, "b a", 2, 2)]


def test_tfidf_and_query(small):
    w = {r.token: r.w for r in small.tfidf().where("doc_id = 1").collect()}
    assert w == pytest.approx({"the": 0.486240, "cat": 0.486240, "sat": 0.726044}, abs=1e-6)
    q = [(r.doc_id, r.score) for r in small.query("cat ran zebra", 3).collect()]
    assert [d for d, _ in q] == [2, 3, 1] and [s for _, s in q] == pytest.approx([0.618417, 0.424471, 0.343824], abs=1e-6)
    assert [tuple(r) for r in small.query("zebra", 2).collect()] == [(1, 0.0), (2, 0.0)]


def test_encode_and_decode(small):
    ids = small.encoded()
    back = co.sequences(co.decode(ids, small.vocabulary)).collect()
    assert {r.doc_id: r.tokens for r in back}[3] == ["a", "dog", "ran", "ran"]
    cut = co.drop_terms(small.vocabulary, small.vocabulary.where("token = 'ran'"))
    assert co.decode(ids, cut).where("token is null").count() == 3 and co.decode(ids, cut, filter_missing=True).count() == 8
    with pytest.raises(Exception, match="not in the vocabulary"):
        co.encode(small.tokens, cut, oov="error").collect()
    assert one(cut, "token", "term_id")["dog"] == 6


def test_extreme_terms(small):
    v = small.vocabulary
    high = lambda **k: sorted(r.token for r in co.extreme_terms(v, "df", **k).collect())
    assert high(limit=1) == ["cat", "ran", "the"] and high(limit=0.7, total=3) == [] and high(limit=1, high=False) == ["a", "dog", "fast", "sat"]
    assert high(count=2) == ["cat", "the"] and high(count=2, high=False) == ["fast", "sat"]
    with pytest.raises(ValueError):
        co.extreme_terms(v, "df")


def test_head(spark):
    d = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.05, 0.4, 0.1, 0.3, 0.15])], "g int, i int, p double")
    got = lambda **k: {r.i for r in co.head(d, "p", ["g"], **k).collect()}
    assert got(p=0.8) == {1, 3, 4} and got(n=2) == {1, 3} and got(eps=0.12) == {1, 3, 4} and got() == {0, 1, 2, 3, 4}


def test_bags(spark):
    a = spark.createDataFrame([("x", 3), ("y", 1)], "token string, cnt long")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("z", 2)], "token string, cnt long")
    assert one(bags.add(a, b, ["token"]), "token", "cnt") == {"x": 4, "y": 6, "z": 2}
    assert one(bags.subtract(a, b, ["token"]), "token", "cnt") == {"x": 2}
    assert one(bags.drop(a, b.where("token = 'x'"), ["token"]), "token", "cnt") == {"y": 1}
    assert bags.total(a).first().total == 4
    assert bags.as_map(a.withColumn("d", F.lit(1)), ["d"]).first().bag == {"x": 3, "y": 1}


def arrays(spark, tokens, f):
    return spark.createDataFrame([(tokens,)], "t array<string>").select(f(F.col("t"))).first()[0]


def test_windows(spark):
    abc = ["a", "b", "c"]
    assert arrays(spark, abc, lambda t: ng.windows(t, 2)) == [["a", "b"], ["b", "c"]]
    assert arrays(spark, ["a"], lambda t: ng.windows(t, 2)) == [] and arrays(spark, [], lambda t: ng.windows(t, 1)) == []
    assert arrays(spark, abc, lambda t: ng.windows(t, 2, "<", ">")) == [["<", "a"], ["a", "b"], ["b", "c"], ["c", ">"]]
    assert arrays(spark, abc, lambda t: ng.windows(t, 1, "<", ">")) == [["<"], ["a"], ["b"], ["c"], [">"]]
    assert arrays(spark, abc, lambda t: ng.windows(t, 3, head=True)) == [["a"], ["a", "b"], ["a", "b", "c"]]
    spec = NgramSpec((1, 2), 1, 0.5, "_", None, "END")
    assert arrays(spark, ["the", "of", "cat"], lambda t: ng.ngrams(t, spec, ("the", "of"))) == ["cat", "END", "of_cat", "cat_END"]
    assert arrays(spark, ["x", "y"], lambda t: ng.ngrams(t, NgramSpec((2,), end="END"), (), legacy_padding=True)) == ["x y"]


def test_collocations(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("new york city is big".split())], "doc_id long, pos int, token string")
    pairs = spark.createDataFrame([("new", "york"), ("york", "city")], "first string, second string")
    assert [r.token for r in ng.join_collocations(t, pairs).orderBy("pos").collect()] == ["new_york_city", "is", "big"]


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([(1, "a b a b c a".split())], "doc_id long, tokens array<string>")


def test_trie(abc):
    c = lm.ngram_counts(abc, 2)
    assert one(c.where("n = 2").select(F.concat_ws("", "context", F.array("token")).alias("g"), "total"), "g", "total") == {"ab": 2, "ba": 1, "bc": 1, "ca": 1}
    assert one(c.where("n = 1"), "token", "total") == {"a": 2, "b": 2, "c": 1}
    assert {r.prefix[0]: r.distinct_ngrams for r in lm.distinct_below(c, 2).where("n = 1").collect()} == {"a": 1, "b": 2, "c": 1}
    assert {r.suffix[0]: r.contexts for r in lm.left_contexts(c, 2).collect()} == {"a": 2, "b": 1, "c": 1}
    assert lm.merge(c, c).where("n = 1 and token = 'a'").first().total == 4
    r = lm.reversed_counts(c).where("n = 2 and first = 'c'").first()
    assert r.rest == ["b"]


def test_smoothing(spark, abc):
    counts = lm.ngram_counts(abc, 2)
    g = spark.createDataFrame([(["a"], "b"), (["b"], "c"), (["zzz"], "a")], "context array<string>, token string")
    p = {(r.context[0], r.token): r.p for r in lm.additive(g, counts, 0.1).collect()}
    assert p["a", "b"] == pytest.approx(0.913043, abs=1e-6)
    p = {(r.context[0], r.token): r.p for r in lm.interpolated(g, counts, 0.1).collect()}
    assert p["a", "b"] == pytest.approx(0.946) and p["b", "c"] == pytest.approx(0.478)
    assert p["zzz", "a"] == pytest.approx(0.9 / 3 + 0.1 * (0.9 * 2 / 5 + 0.1))


@pytest.mark.parametrize("name", ["additive", "absolute discount", "kneser ney", "linear interpolation", "laplace"])
def test_distributions_sum_to_one(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    lists = Corpus(docs, Pipeline({"sequence": ["lower", *WORDS["sequence"]]})).token_lists
    counts = lm.all_ngrams(lists, 2).cache()
    context = counts.where("n = 2").groupBy("context").agg(F.sum("total").alias("t")).orderBy(F.desc("t"), "context").limit(2).select("context")
    grams = context.crossJoin(counts.where("n = 1").select("token"))
    kwargs = {"proper": True} if name == "linear interpolation" else {}
    for r in lm.SMOOTHING[name](grams, counts, **kwargs).groupBy("context").agg(F.sum("p").alias("s")).collect():
        assert r.s == pytest.approx(1.0, abs=1e-9)


def test_generation(abc):
    counts = lm.ngram_counts(abc, 2)
    a = [r.tokens for r in lm.generate(counts, 2, 5, 8, seed=3, begin=["a"]).orderBy("text_id").collect()]
    assert a == [r.tokens for r in lm.generate(counts, 2, 5, 8, seed=3, begin=["a"]).orderBy("text_id").collect()]
    assert all(t[0] == "a" and len(t) == 8 and set(zip(t, t[1:])) <= {("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")} for t in a)


def test_norms_are_one(spark, sf):
    c = Corpus(spark.read.parquet(f"{sf}/documents.parquet").limit(50), Pipeline(WORDS))
    r = weighting.norms(c.tfidf(sublinear=True)).agg(F.min("norm"), F.max("norm")).first()
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(1)
    s = c.term_stats.agg(F.sum("ttf"), F.sum("df")).first()
    assert s[0] == c.stats.first().total_tokens and s[1] <= s[0]


def test_maps_and_search(spark):
    from corpusloom.operators import lookup

    kv = lambda rows: spark.createDataFrame(rows, "key string, value string")
    pairs = lambda df: {(r.key, r.value) for r in df.collect()}
    first, subs = kv([("a", "1"), ("b", "2"), ("c", "3")]), kv([("a", "x"), ("b", "y"), ("c", "y"), ("z", "q")])
    assert pairs(lookup.substitute_keys(first, subs, check=True)) == {("x", "1"), ("y", "3")}
    assert pairs(lookup.compose_maps(first, kv([("1", "I"), ("2", "II"), ("3", "III")]), check=True)) == {("a", "I"), ("b", "II"), ("c", "III")}
    short = kv([("1", "I")])
    with pytest.raises(ValueError):
        lookup.compose_maps(first, short, check=True)
    with pytest.raises(Exception, match="the map has no"):
        lookup.compose_maps(first, short).collect()
    rng = random.Random(2)
    lists = {k: sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for k in range(6)}
    asked = [(k, float(x)) for k in range(7) for x in range(-1, 33, 2)] + [(0, 5.0)]
    rows = [(k, float(v), i) for k, vs in lists.items() for i, v in enumerate(vs)]
    got = lookup.first_reaching(spark.createDataFrame(rows, "k int, v double, place int"), spark.createDataFrame(asked, "k int, x double"), "v", ["k"], "place").collect()
    want = [(k, x, next((i for i, v in enumerate(lists.get(k, [])) if v >= x), None)) for k, x in asked]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_a_stream_that_starts_with_one_term(spark, tmp_path):
    from corpusloom.streaming import incremental

    p, root = Pipeline({"sequence": ["lower", {"op": "split", "args": {"pattern": r"\s+"}}]}), f"file://{tmp_path}"
    for i, text in enumerate(["one one", "two one", "three two", None]):
        spark.createDataFrame([(i, text)], "doc_id long, text string").write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{root}/in")
        incremental.maintain_vocabulary(stream, p, f"{root}/state", f"{root}/checkpoint")
    got = incremental.Versions(spark, f"{root}/state").latest().collect()
    assert sorted((r.term_id, r.token) for r in got) == [(0, "one"), (1, "two"), (2, "three")]


def test_counts_by_place(spark):
    """Places carry their neighbours, not the whole text, each counts once, and few n-grams are looked up without a shuffle of all counts."""
    rows = [(1, "a b a b".split()), (2, ["c"]), (3, []), (4, None), (5, "a b".split())]
    lists = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    for n in (1, 2, 3):
        want, places = {}, []
        for d, t in rows:
            for i, x in enumerate(t or []):
                places.append((d, i, t[max(0, i - n + 1) : i], x))
                for k in range(1, n + 1):
                    if i + k <= len(t):
                        g = (k, tuple(t[i : i + k - 1]), t[i + k - 1])
                        want[g] = want.get(g, 0) + 1
        assert {(r.n, tuple(r.context), r.token): r.total for r in lm.all_ngrams(lists, n).collect()} == want
        assert sorted(map(tuple, lm.positions(lists, n).collect())) == sorted(places)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert all("transform(" not in plan(df).split("Generate")[-1] for df in (lm.positions(lists, 2), lm.all_ngrams(lists, 2)))
    counts = lm.train(lists, 2)
    p = lm.additive(spark.createDataFrame([(["a"], "b"), (["z"], "b")], "context array<string>, token string"), counts)
    assert plan(p).count("LeftSemi") == 2 and {tuple(r.context): round(r.p, 6) for r in p.collect()} == {("a",): round(3.1 / 3.3, 6), ("z",): round(0.1 / 0.3, 6)}


def test_language_counts_without_postings(spark, sf):
    from corpusloom.queries import stats

    plan = stats._by_lang(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan and "Generate" not in plan  # texts are read once, by no document
