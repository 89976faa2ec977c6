import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import components, decontamination, jaccard_join, language_id, secret_scan


def test_every_operator_has_a_query():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages_against_the_operators(spark, sf, tmp_path):
    """Each stage's rows, by another way: its operator's full report on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        if k < 4:
            assert out.columns == columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()} if k < 4 else {}
        if name == "language_id":
            want = {r.doc_id for r in language_id.identify(docs, language_id.fit(docs)).collect() if r.accepted}
            assert set(after) == want and len(want) > 0.95 * len(before)
        elif name == "ngram_jaccard_join":
            linked = {r.doc_id: r.class_id for r in jaccard_join.links(docs).collect()}
            assert set(after) == {i for i in before if linked.get(i, i) == i} and len(after) < len(before)
        elif name == "benchmark_decontamination":
            gone = {r.doc_id for r in decontamination.find(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - gone
        elif name == "secret_scan":
            hit = {r.doc_id for r in secret_scan.find(docs).collect()}
            assert set(after) == set(before) and {i for i in before if before[i].text != after[i].text} == hit
            assert all(after[i].n_chars == len(after[i].text) for i in hit)
        else:
            texts = {i for i, r in before.items() if r.text}
            assert {r.doc_id for r in out.collect()} == texts
        docs = out
    assert len(corpus_pipeline.run(spark, sf).columns) == len(docs.columns)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, None), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {i: root(i) for i in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
