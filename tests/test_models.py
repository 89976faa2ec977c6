import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classify, cluster, evaluate
from corpusloom.operators import timeseries as ts
from corpusloom.operators.topics import TopicModel
from corpusloom.sources import documents, exports, tables
from corpusloom.streaming import incremental
from corpusloom.plans import Pipeline
from corpusloom.plans.shipped import step

WORDS = Pipeline({"sequence": [step("split", pattern=r"\s+")]})


def test_precision_recall(spark):
    rows = spark.createDataFrame([(i, t, p) for i, (t, p) in enumerate(zip([0, 1, 0, 1, 1], [0.1, 0.4, 0.35, 0.8, 0.2]))], "pos int, truth int, pred double")
    got = evaluate.pr_curve(rows).orderBy("i").collect()
    assert [r.precision for r in got] == pytest.approx([0, 0.75, 2 / 3, 1, 1, 1]) and [r.recall for r in got] == pytest.approx([1, 1, 2 / 3, 2 / 3, 1 / 3, 0])


@pytest.mark.parametrize("n,k,want", [(10, 3, [3, 3, 4]), (7, 4, [1, 2, 2, 2])])
def test_folds(spark, n, k, want):
    folds = evaluate.k_folds(spark.range(n).withColumnRenamed("id", "key"), "key", k).collect()
    assert [sum(r.fold == i for r in folds) for i in range(k)] == want and len({r.key for r in folds}) == n


def test_paired_t(spark):
    rows = [("a", i, x) for i, x in enumerate([0.9, 0.8, 0.85, 0.7])] + [("b", i, x) for i, x in enumerate([0.7, 0.75, 0.8, 0.72])]
    r = evaluate.paired_t(spark.createDataFrame(rows, "classifier string, fold int, f1 double")).first()
    d = np.array([0.2, 0.05, 0.05, -0.02])
    assert r.better == "a" and r.t == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and r.dof == 3 and 0 < r.p_value < 1


def test_nearest_neighbours(spark):
    text = {1: "red apple sweet", 2: "red cherry sweet", 3: "fast car wheel", 4: "slow car engine", 5: "red sweet pear", 6: "nothing known"}
    p = spark.createDataFrame([(d, w, 1) for d, t in text.items() for w in t.split()], "doc_id long, token string, cnt long")
    labels = spark.createDataFrame([(1, "f"), (2, "f"), (3, "c"), (4, "c")], "doc_id long, cls string")
    knn = classify.NearestNeighbours(p, labels, k=2)
    got = {r.query_id: (r.cls, r.confidence) for r in knn.classify(p.where("doc_id > 4")).collect()}
    assert got == {5: ("f", 1.0), 6: (None, None)}
    assert {r.bucket for r in classify.NearestNeighbours(p, labels, planes=3).buckets(knn.train).collect()} <= set(range(8))


def test_bayes(spark):
    lists = spark.createDataFrame([(1, "a b a b".split()), (2, "b c b c".split()), (3, "a b".split()), (4, "b c".split())], "doc_id long, tokens array<string>")
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, cls string")
    counts, priors = classify.train_bayes(lists, labels)
    got = {r.doc_id: r.cls for r in classify.bayes_classify(classify.bayes_scores(lists, counts, priors)).collect()}
    assert got == {1: "x", 2: "y", 3: "x", 4: "y"}


@pytest.mark.parametrize("how", ["samples", "plusplus", "uniform"])
def test_spherical_kmeans(spark, how):
    rng = np.random.default_rng(0)
    v = np.vstack([np.eye(4)[i % 3] + 0.05 * rng.normal(size=4) for i in range(60)])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    fit = cluster.fit(df, 3, how=how, restarts=2, max_rounds=6)
    assert fit.objective > (55 if how == "plusplus" else 30) and np.allclose(np.linalg.norm(fit.centroids, axis=1), 1)


def test_topics_rest_on_all_documents(spark):
    """Each document has a word of its own, which comes to the topics only if the document is read."""
    postings = spark.createDataFrame([(d, t, n) for d in range(100) for t, n in ((d, 50), (100 + d % 2, 20))], "doc_id long, term_id long, cnt long")
    vocabulary = spark.createDataFrame([(t, f"w{t}") for t in range(102)], "term_id long, token string")
    weights = TopicModel(2).fit(postings, vocabulary).model.topicsMatrix().toArray().sum(1)
    assert weights[:100].min() > 5  # of 50 counted; only the random first topics are left of an unread word, about 1


def test_time_buckets(spark):
    t = spark.createDataFrame([(dt.datetime(2024, 1, 6, 13),)], "t timestamp_ntz")
    got = lambda f: t.select(f(F.col("t"))).first()[0]
    assert got(ts.num_days(7)) == dt.datetime(2024, 1, 4) and got(ts.month) == dt.datetime(2024, 1, 1) and got(ts.year) == dt.datetime(2024, 1, 1) and got(ts.day) == dt.datetime(2024, 1, 6)
    assert dt.datetime(2024, 1, 1) <= got(ts.year_fraction(52)) <= dt.datetime(2024, 1, 6, 13)


def test_series_are_shares_of_all_tokens(spark):
    d = dt.datetime
    rows = spark.createDataFrame([(d(2024, 1, 1, 5), "a", 2, 1), (d(2024, 1, 1, 9), "b", 2, 2), (d(2024, 1, 3), "a", 1, 2), (None, "a", 9, 1)], "time timestamp_ntz, token string, cnt long, doc int")
    s = ts.TokenSeries(rows)
    assert [tuple(r) for r in s.series(["a"], normalize=True).collect()] == [("a", d(2024, 1, 1), 0.5), ("a", d(2024, 1, 3), 1.0)]
    assert [r.value for r in s.series(["a"], doc_filter=F.col("doc") == 1, normalize=True).collect()] == [0.5]
    assert s.series(["a"], min_time=d(2024, 1, 2)).count() == 1


@pytest.mark.parametrize("n,low,most,want", [(2500, 1000, 100, 1250), (250_000, 1000, 100, 2500), (10, 1000, 100, 10)])
def test_slices(n, low, most, want):
    assert exports.slice_width(n, low, most) == want


def test_exports(spark, tmp_path):
    lists = spark.createDataFrame([(1, "en", ["a", "b"])], "doc_id long, lang string, tokens array<string>")
    exports.write_mallet(lists, "lang", f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").first().value == "1 en a b"
    p = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "a", 3)], "doc_id long, token string, cnt long")
    dates = spark.createDataFrame([(1, dt.date(2024, 2, 1)), (2, dt.date(2024, 1, 1)), (3, None)], "doc_id long, date date")
    f = exports.DynamicTopicFiles(p, dates, 1, 10)
    assert [r.value for r in f.mult().orderBy("line").collect()] == ["1 0:3", "2 0:1 1:2"] and [r.value for r in f.seq().orderBy("line").collect()] == ["2", "1", "1"]
    f.write(f"{tmp_path}/dtm")
    assert [r.value for r in spark.read.text(f"{tmp_path}/dtm-voc.dat").collect()] == ["a", "b"]


def test_sources(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"Reviews": [{"id": 1, "text": "a"}, {"id": 2, "text": "b"}]}')
    (tmp_path / "y.txt").write_text("one\n\ntwo")
    assert documents.read_nested_json(spark, f"{tmp_path}/x.json", "Reviews").count() == 2
    got = documents.read_records(spark, str(tmp_path), lambda b: [{"t": x} for x in b.decode().split("\n\n")], "t string", extensions=[".txt"])
    assert sorted(r.t for r in got.collect()) == ["one", "two"]
    assert documents.read_documents(spark, str(tmp_path), "text", extensions=[".txt"]).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        documents.read_documents(spark, f"{tmp_path}/none")
    assert [r.doc_id for r in documents.with_ids(spark.createDataFrame([("b",), ("a",)], "t string"), order="t").orderBy("t").collect()] == [0, 1]


def test_ids_of_equal_urls(spark):
    rows = [(p, None if p % 7 == 0 else f"u{p % 5}") for p in range(40)]
    want = {p: i for i, (p, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0])))}
    for parts in (1, 5):
        d = spark.createDataFrame(rows[::-1], "page_id long, url string").repartition(parts)
        assert {r.page_id: r.id for r in documents.with_ids(d, "id", "url").collect()} == want


def test_keyed_tables(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double")
    new = spark.createDataFrame([(2, "B", None, 1), (3, "c", 3.0, 2), (2, None, 9.0, 3)], "k int, s string, x double, seq int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(tables.update(old, new, ["k"], seq="seq")) == [(1, "a", 1.0), (2, "B", 9.0), (3, "c", 3.0)]
    assert rows(tables.update(old, new, ["k"], add_new=False, seq="seq")) == [(1, "a", 1.0), (2, "B", 9.0)]
    assert rows(tables.insert(old, new, ["k"], "ignore", "seq"))[-1] == (3, "c", 3.0)
    assert tables.insert(old, new, ["k"], "replace", "seq").where("k = 2").first().x == 9.0
    for how in ("abort", "fail", "rollback"):
        with pytest.raises(ValueError):
            tables.insert(old, new, ["k"], how, "seq")
    with pytest.raises(KeyError):
        tables.update(old, new.drop("k"), ["k"])
    spec = tables.TableSpec.read("t", {"schema": [["k", "INTEGER"], ["s", "TEXT"]], "keys": ["k"], "indices": ["s"]})
    assert spec.index == ("s",) and tables.evolve(old.drop("s"), spec).columns == ["k", "x", "s"]
    for bad in ({"schema": [["k", "ODD"]]}, {"schema": [["k", "TEXT"]], "keys": ["z"]}):
        with pytest.raises(ValueError):
            tables.TableSpec.read("t", bad)
    assert list(tables.batches(range(5), 2)) == [[0, 1], [2, 3], [4]]


def test_streams_equal_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w{i}") for i in range(20)], "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    from corpusloom.operators.corpus import Corpus

    incremental.maintain_stats(read(), WORDS, f"file://{tmp_path}/stats", f"{tmp_path}/c1")
    got = {tuple(r) for r in incremental.Versions(spark, f"file://{tmp_path}/stats").latest().select("token", "ttf", "df").collect()}
    assert got == {tuple(r) for r in Corpus(docs, WORDS).term_stats.select("token", "ttf", "df").collect()}
    incremental.maintain_vocabulary(read(), WORDS, f"file://{tmp_path}/vocab", f"{tmp_path}/c2")
    v = incremental.Versions(spark, f"file://{tmp_path}/vocab")
    ids = {r.token: r.term_id for r in v.latest().collect()}
    assert sorted(ids.values()) == list(range(20)) and len(v.numbers()) == 4
    assert all(ids[r.token] == r.term_id for n in v.numbers() for r in v.before(n + 1).collect())
    incremental.maintain_table(read(), f"file://{tmp_path}/table", f"{tmp_path}/c3", ["doc_id"])
    assert incremental.Versions(spark, f"file://{tmp_path}/table").latest().count() == 20
    q = incremental.term_stats(read(), WORDS).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("live").select("token", "ttf", "df").collect()} == got


def test_measures_of_all_pairs(spark, monkeypatch):
    """Blocks give what the expressions give for each pair, on odd vectors too, and no pair crosses a join."""
    from corpusloom.functions import vectors as vec
    from corpusloom.operators import pairs

    monkeypatch.setattr(pairs, "LEAST", 4)
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=5) * 1000]) for i in range(40)]
    rows += [(40, 0, rows[0][2]), (41, 0, [x + 1e-4 for x in rows[0][2]]), (42, 1, [0.0] * 5), (43, None, [1.0] * 5), (43, 1, [1.0] * 5), (43, 1, [2.0] * 5)]
    odd = [(50, 0, None), (51, 0, [1.0]), (52, 0, [1.0, None, 0.0, 0.0, 0.0]), (53, 0, []), (54, 2, [2.0] * 5)]
    e = spark.createDataFrame(rows + odd, "id long, label int, x array<double>")
    for measure, plain in ((pairs.vmf(2.0), lambda a, b: vec.vmf_kernel(a, b, 2.0)), (pairs.euclidean, vec.euclidean)):
        a, b = (e.select(F.col("id").alias(n), "label", F.col("x").alias(v)) for n, v in (("a", "x"), ("b", "y")))
        want = a.join(b, "label").where("a < b").select("a", "b", plain(F.col("x"), F.col("y")).alias("value"))
        key = lambda df: sorted((r.a, r.b, -1e9 if r.value is None else r.value) for r in df.collect())
        got, want = key(pairs.measured_pairs(e, measure, plain)), key(want)
        assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], rtol=0, atol=1e-6)
    import __spark_entry__

    plan = __spark_entry__.queries()["vec_cosine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "(a#" not in plan


def test_restarts_share_their_passes(spark):
    e = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(np.random.default_rng(2).normal(size=(80, 4)))], "vec_id long, embedding array<double>")
    sc = spark.sparkContext
    sc.setJobGroup("restarts", "")
    fit = cluster.fit(e, 4, how="plusplus", restarts=5, max_rounds=8, eps=0.0)
    sc.setJobGroup("other", "")
    assert fit.rounds == 8 and len(sc.statusTracker().getJobIdsForGroup("restarts")) < 40  # not some for each round of each restart


@pytest.mark.parametrize("rows", [1000, 6, 0])
def test_bayes_scores_by_weight(spark, monkeypatch, rows):
    """Counts held by all tasks, only the heaviest of them, or none: the same scores, also after unseen words and contexts."""
    monkeypatch.setattr(classify, "BROADCAST_ROWS", rows)
    text = {1: "a b a b c a b", 2: "b c b c", 3: "a b z c", 4: "q r", 5: "", 6: "a"}
    lists = spark.createDataFrame([(d, t.split()) for d, t in text.items()], "doc_id long, tokens array<string>")
    counts, priors = classify.train_bayes(lists, spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "doc_id long, cls string"))
    got = {(r.doc_id, r.cls): r.logp for r in classify.bayes_scores(lists, counts, priors).collect()}
    want = {}
    for cls, docs in (("x", [1]), ("y", [2, 3])):
        uni, bi, ctx = {}, {}, {}
        for t in (text[d].split() for d in docs):
            for i, w in enumerate(t):
                uni[w] = uni.get(w, 0) + 1
                if i:
                    bi[t[i - 1], w] = bi.get((t[i - 1], w), 0) + 1
                    ctx[t[i - 1]] = ctx.get(t[i - 1], 0) + 1
        v, n = len(uni) * 0.1, sum(uni.values())
        for d, t in ((d, t.split()) for d, t in text.items() if t):
            p = [(bi.get((t[i - 1], w), 0) + 0.1) / (ctx.get(t[i - 1], 0) + v) if i else (uni.get(w, 0) + 0.1) / (n + v) for i, w in enumerate(t)]
            want[d, cls] = float(np.log(len(docs) / 3) + np.log(p).sum())
    assert got == pytest.approx(want)


@pytest.mark.parametrize("planes", [0, 2])
def test_nearest_neighbours_by_blocks(spark, monkeypatch, planes):
    """Slices, blocks and waves of any size give the neighbours of a whole search, ties by id, and no pair crosses a shuffle."""
    from corpusloom.operators import nearest

    for name, size in {"WAVE": 60, "BLOCK": 3, "SLICE": 4, "DENSE": 2, "MATCHES": 5}.items():
        monkeypatch.setattr(nearest, name, size)
    rng = np.random.default_rng(4)
    words = {d: {f"w{int(x)}" for x in rng.zipf(1.4, 8) if x < 40} | ({f"own{d}"} if d % 4 else set()) for d in range(40)}
    words[39] = words[38] = words[37]
    p = spark.createDataFrame([(d, w, 1) for d, ws in words.items() for w in ws], "doc_id long, token string, cnt long")
    knn = classify.NearestNeighbours(p, None, k=3, planes=planes)
    out = knn.query(p.where("doc_id % 3 = 0"))
    v, bucket = {}, {r.doc_id: r.bucket for r in knn.buckets(knn.train).collect()}
    for r in knn.train.collect():
        v.setdefault(r.doc_id, {})[r.token] = r.w
    want = set()
    for q in (d for d in v if d % 3 == 0):
        s = [(-round(sum(x * v[d].get(t, 0) for t, x in v[q].items()), 9), d) for d in v if d != q and bucket[d] == bucket[q] and v[d].keys() & v[q].keys()]
        want |= {(q, d, i + 1) for i, (_, d) in enumerate(sorted(s)[:3])}
    assert {(r.query_id, r.neighbour, r["rank"]) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
