"""Classifiers, clusters, topics, evaluation and time series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..operators import classify, cluster, evaluate
from ..operators import timeseries as ts
from ..checkpoints import written
from ..operators.corpus import reduce_ids
from ..operators.topics import TopicModel
from ..plans import Pipeline
from . import query
from .common import PLAIN, corpus, ctes, six, table, tokens_sql


#: Searches take every document whose id is divisible by this as a query, against all documents.
_EVERY = 50


def _queries_and_all(spark, sf):
    p = corpus(spark, sf).kept_postings
    return p.where(F.pmod("doc_id", F.lit(_EVERY)) == 0), p


def _knn_sql(train: str) -> str:
    return ctes() + f""", tr as (select p.* from p {train}), te as (select p.* from p where doc_id % {_EVERY} = 0),
f as (select token, count(*) as df from tr group by token), nn as (select count(distinct doc_id) as n from tr),
x as (select doc_id, token, ln(cnt + 1) * (1 + ln((select n from nn) / df)) as w from tr join f using (token)), xs as (select doc_id, token, w / sqrt(sum(w * w) over (partition by doc_id)) as w from x),
y as (select doc_id, token, ln(cnt + 1) * (1 + ln((select n from nn) / df)) as w from te join f using (token)), ys as (select doc_id, token, w / sqrt(sum(w * w) over (partition by doc_id)) as w from y)
"""


_PLANES = 3


def _bucket(name: str) -> str:
    sides = " + ".join(f"(case when round(sum(w * case when substr(md5('0:{i}:' || token), 1, 1) < '8' then 1.0 else -1.0 end), 9) >= 0 then {1 << i} else 0 end)" for i in range(_PLANES))
    return f"(select doc_id, {sides} as bucket from {name} group by doc_id)"


def _near(buckets: bool) -> str:
    where = f"join {_bucket('ys')} yb on yb.doc_id = ys.doc_id join {_bucket('xs')} xb on xb.doc_id = xs.doc_id and xb.bucket = yb.bucket" if buckets else ""
    return f""", s as (select ys.doc_id as query_id, xs.doc_id as neighbour, sum(xs.w * ys.w) as score from ys join xs on xs.token = ys.token {where} where xs.doc_id <> ys.doc_id group by all),
k as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, neighbour) as integer) as rank from s qualify rank <= 5)
"""


def _neighbours(name, planes):
    @query(name, _knn_sql("") + _near(planes > 0) + "select query_id, neighbour, round(score, 6) as score, rank from k")
    def run(spark, sf):
        queries, all_ = _queries_and_all(spark, sf)
        return classify.NearestNeighbours(all_, None, k=5, planes=planes).query(queries).select("query_id", "neighbour", six("score").alias("score"), "rank")


_neighbours("knn_exact", 0)
_neighbours("knn_lsh", _PLANES)


@query("knn_classify", _knn_sql("join labels using (doc_id)") + _near(False) + """, vo as (select query_id, quality as cls, count(*) as v from k join labels on labels.doc_id = k.neighbour group by all),
b as (select query_id, cls, v / sum(v) over (partition by query_id) as c, row_number() over (partition by query_id order by v desc, cls) as r from vo)
select q.query_id, b.cls, round(b.c, 6) as confidence from (select distinct doc_id as query_id from te) q left join b on b.query_id = q.query_id and r = 1""")
def knn_classify(spark, sf):
    queries, all_ = _queries_and_all(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("cls"))
    return classify.NearestNeighbours(all_, labels, k=5).classify(queries).withColumn("confidence", six("confidence"))


#: Trained on all labelled documents; all documents are classified.
_BAYES = ctes() + """, te as (select doc_id, pos, token, lag(token) over (partition by doc_id order by pos) as before from t), tr as (select te.*, quality as cls from te join labels using (doc_id)),
u as (select cls, token, count(*) as c from tr group by all), ut as (select cls, sum(c) as ct, count(*) as v from u group by cls),
bi as (select cls, before, token, count(*) as c from tr where before is not null group by all), bt as (select cls, before, sum(c) as ct from bi group by all),
pr as (select quality as cls, ln(count(*) / (select count(*) from labels join documents using (doc_id))) as lp from labels join documents using (doc_id) group by quality),
sc as (select te.doc_id, ut.cls, sum(ln(case when te.before is null then (coalesce(u.c, 0) + 0.1) / (ut.ct + ut.v * 0.1) else (coalesce(bi.c, 0) + 0.1) / (coalesce(bt.ct, 0) + ut.v * 0.1) end)) as s
 from te cross join ut left join u on u.cls = ut.cls and u.token = te.token left join bi on bi.cls = ut.cls and bi.before = te.before and bi.token = te.token left join bt on bt.cls = ut.cls and bt.before = te.before group by all)
"""


def _bayes(spark, sf):
    toks = corpus(spark, sf).kept_lists.select("doc_id", "tokens")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("cls"))
    counts, priors = classify.train_bayes(toks, labels, 2)
    return classify.bayes_scores(toks, counts, priors, 2, 0.1)


@query("bayes_ngram", _BAYES + "select doc_id, cls, round(s + lp, 4) as logp from sc join pr using (cls)")
def bayes_ngram(spark, sf):
    return _bayes(spark, sf).withColumn("logp", F.round("logp", 4))


@query("bayes_classify", _BAYES + "select doc_id, cls from (select doc_id, cls, row_number() over (partition by doc_id order by round(s + lp, 6) desc, cls) as r from sc join pr using (cls)) where r = 1")
def bayes_classify(spark, sf):
    return classify.bayes_classify(_bayes(spark, sf)).select("doc_id", "cls")


@query("kmeans_assign", "with e as (select vec_id, cast(embedding as double[]) as x from embeddings), c as (select row_number() over (order by vec_id) - 1 as cluster, x as y from e where vec_id in (select vec_id from e order by vec_id limit 8)), s as (select e.vec_id, c.cluster, round(list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(x, lambda z: z * z)) * list_sum(list_transform(y, lambda z: z * z))), 6) as cosine from e cross join c) select vec_id, cast(cluster as integer) as cluster, cosine from (select *, row_number() over (partition by vec_id order by cosine desc, cluster) as r from s) where r = 1")
def kmeans_assign(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", unit(F.col("embedding")).alias("v"))
    first = np.array([r.v for r in e.orderBy("vec_id").limit(8).collect()])
    return cluster.assign(e, first).select("vec_id", "cluster", six("cosine").alias("cosine"))


@query("spherical_kmeans")
def spherical_kmeans(spark, sf):
    e = table(spark, sf, "embeddings")
    fitted = cluster.fit(e, 8, how="plusplus", seed=3)
    v = e.select("vec_id", unit(F.col("embedding")).alias("v"))
    return cluster.assign(v, fitted.centroids).select("vec_id", "cluster", six("cosine").alias("cosine"))


def _topics(spark, sf):
    """A model of five topics over all terms, and the postings by id."""
    c = corpus(spark, sf)
    terms = written(reduce_ids(c.vocabulary).select("term_id", "token"), "vocabulary")
    p = written(c.kept_postings.join(terms, "token").select("doc_id", "term_id", "cnt"), "ids")
    return TopicModel(5).fit(p, terms), p


@query("lda_topics")
def lda_topics(spark, sf):
    return _topics(spark, sf)[0].topic_words(10)


@query("lda_labels")
def lda_labels(spark, sf):
    return _topics(spark, sf)[0].labels(5)


@query("lda_doc_topics")
def lda_doc_topics(spark, sf):
    model, p = _topics(spark, sf)
    return model.doc_topics(p, p=0.9)


def _scores(spark, sf):
    """Labels with a score: the share of letters among the characters."""
    d = table(spark, sf, "documents").select("doc_id", F.round(F.length(F.regexp_replace("text", "[^a-z]", "")) / F.col("n_chars"), 9).alias("pred"))
    return d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("quality").alias("truth"), "pred")


_SCORES = "with s as (select doc_id, quality as truth, round(cast(length(regexp_replace(text, '[^a-z]', '', 'g')) as double) / n_chars, 9) as pred from documents join labels using (doc_id))\n"


@query("pr_curve", _SCORES + """, r as (select *, row_number() over (order by pred, doc_id) as i, sum(truth) over (order by pred, doc_id rows unbounded preceding) as fn, sum(truth) over () as p, count(*) over () as n from s)
select 0 as i, cast(null as double) as threshold, 0.0::double as precision, 1.0::double as recall union all
select i, pred, round(case when i = n then 1.0 else (p - fn) / nullif(n - i, 0) end, 6), round((p - fn) / p, 6) from r""")
def pr_curve(spark, sf):
    return evaluate.pr_curve(_scores(spark, sf), "doc_id").select("i", "threshold", six("precision").alias("precision"), six("recall").alias("recall"))


@query("kfold_split", "with r as (select doc_id, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from labels), b as (select doc_id, r, n from r) select doc_id, cast((select max(i) from range(7) t(i) where r >= floor(round(i * n / 7.0, 8))) as integer) as fold from b")
def kfold_split(spark, sf):
    return evaluate.k_folds(table(spark, sf, "labels"), "doc_id", 7, order=[F.col("doc_id")])


_FOLDS = _SCORES + """, f as (select doc_id, truth, pred, row_number() over (order by doc_id) - 1 as r, count(*) over () as n from s),
g as (select *, (select max(i) from range(5) t(i) where r >= floor(round(i * n / 5.0, 8))) as fold from f),
c as (select 'half' as classifier, fold, truth, case when pred > 0.7 then 1 else 0 end as y from g union all select 'most', fold, truth, case when pred > 0.3 then 1 else 0 end from g),
m as (select classifier, fold, sum(truth * y) as tp, sum((1 - truth) * y) as fp, sum(truth * (1 - y)) as fn, sum((1 - truth) * (1 - y)) as tn from c group by all),
e as (select classifier, fold, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, (tp + tn) / (tp + tn + fp + fn) as accuracy from m)
"""


def _validated(spark, sf):
    s = _scores(spark, sf)
    folds = s.join(evaluate.k_folds(s, "doc_id", 5, order=[F.col("doc_id")]), "doc_id")

    def above(limit):
        return lambda train, test: test.join(s, "doc_id").select("doc_id", (F.col("pred") > limit).cast("int").alias("pred"))

    return evaluate.cross_validate(folds.select("doc_id", "fold", "truth"), {"half": above(0.7), "most": above(0.3)})


@query("cv_metrics", _FOLDS + "select classifier, cast(fold as integer) as fold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, round(accuracy, 6) as accuracy from e")
def cv_metrics(spark, sf):
    return _validated(spark, sf).select("classifier", "fold", *[six(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query("paired_t", _FOLDS + ", d as (select avg(a.accuracy - b.accuracy) as m, stddev_samp(a.accuracy - b.accuracy) as s, count(*) as n from e a join e b using (fold) where a.classifier = 'half' and b.classifier = 'most') select case when m >= 0 then 'half' else 'most' end as better, case when m >= 0 then 'most' else 'half' end as worse, round(abs(m / (s / sqrt(n))), 5) as t, n - 1 as dof, round(1 - sin(atan(abs(m / (s / sqrt(n))) / 2)) * (1 + pow(cos(atan(abs(m / (s / sqrt(n))) / 2)), 2) / 2), 6) as p_value from d")
def paired_t(spark, sf):
    return evaluate.paired_t(_validated(spark, sf), "accuracy").select("better", "worse", F.round("t", 5).alias("t"), "dof", six("p_value").alias("p_value"))


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("ts").alias("time"), F.col("event_type").alias("token"), F.lit(1).cast("long").alias("cnt"))


@query("ts_token_series", "with e as (select date_trunc('day', ts)::timestamp as bucket, event_type as token from events), c as (select token, bucket, count(*) as c from e group by all), n as (select bucket, count(*) as n from e group by bucket) select token, bucket, round(c / n, 6) as value from c join n using (bucket)")
def ts_token_series(spark, sf):
    e = _events(spark, sf)
    kinds = sorted(r[0] for r in e.select("token").distinct().collect())
    return ts.TokenSeries(e, "day").series(kinds, normalize=True).withColumn("value", six("value"))


@query("ts_range", "select event_type as token, date_trunc('day', ts)::timestamp as bucket, count(*) as value from events where date_trunc('day', ts) between timestamp '2024-01-05' and timestamp '2024-01-12' group by all")
def ts_range(spark, sf):
    import datetime

    e = _events(spark, sf)
    kinds = sorted(r[0] for r in e.select("token").distinct().collect())
    return ts.TokenSeries(e, "day").series(kinds, min_time=datetime.datetime(2024, 1, 5), max_time=datetime.datetime(2024, 1, 12))


def _totals(name, converter, expr):
    @query(name, f"select {expr} as bucket, count(*) as total from events group by all")
    def run(spark, sf):
        return ts.TokenSeries(_events(spark, sf), converter).totals()


_totals("ts_totals", "day", "date_trunc('day', ts)::timestamp")
_totals("ts_bucket_month", "month", "date_trunc('month', ts)::timestamp")
_totals("ts_bucket_year", "year", "date_trunc('year', ts)::timestamp")
_totals("ts_bucket_7d", "7d", "time_bucket(interval '7 days', ts, timestamp '1970-01-01')")
_YEAR = "date_trunc('year', ts)::timestamp"
_LENGTH = f"(epoch_us({_YEAR} + interval 1 year) - epoch_us({_YEAR}))"
_totals("ts_bucket_yearfrac", "yearfrac", f"make_timestamp(epoch_us({_YEAR}) + ((epoch_us(ts) - epoch_us({_YEAR})) * 52 // {_LENGTH}) * {_LENGTH} // 52)")


@query("ts_documents", f"select token, date_trunc('month', timestamp '2020-01-01' + to_days(cast(doc_id as integer)))::timestamp as bucket, count(*) as value from (select doc_id, unnest({tokens_sql()}) as token from documents) where token in ('the', 'de', 'und') group by all")
def ts_documents(spark, sf):
    d = table(spark, sf, "documents").select((F.lit("2020-01-01").cast("date") + F.col("doc_id").cast("int")).cast("timestamp_ntz").alias("time"), F.explode(Pipeline(PLAIN).tokens(F.col("text"))).alias("token"))
    return ts.TokenSeries(d.withColumn("cnt", F.lit(1).cast("long")), "month").series(["the", "de", "und"])
