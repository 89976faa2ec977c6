"""Bags, vocabularies, corpus statistics, retrieval, vectors, information theory, compositions, tables, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import fresh_path, written
from ..functions import compositional as comp
from ..functions import infotheory as it
from ..functions import vectors as vec
from ..functions import weighting
from ..operators import bags, pairs
from ..operators import corpus as co
from ..plans import Pipeline
from ..sources import tables
from ..streaming import incremental
from . import query
from .common import PLAIN, corpus, ctes, six, table, tokens_sql


def _halves(spark, sf):
    p = corpus(spark, sf).postings
    half = lambda k: p.where(F.pmod("doc_id", F.lit(2)) == k).groupBy("token").agg(F.sum("cnt").alias("cnt"))
    return half(0), half(1)


_HALVES = ctes() + ", a as (select token, sum(cnt) as cnt from p where doc_id % 2 = 0 group by token), b as (select token, sum(cnt) as cnt from p where doc_id % 2 = 1 group by token)\n"


@query("bow_counts", ctes() + "select * from p")
def bow_counts(spark, sf):
    return bags.bag(corpus(spark, sf).tokens, ["doc_id"])


@query("bow_sum", _HALVES + "select token, cast(sum(cnt) as bigint) as cnt from (select * from a union all select * from b) group by token")
def bow_sum(spark, sf):
    return bags.add(*_halves(spark, sf), ["token"])


@query("bow_subtract", _HALVES + "select a.token, cast(a.cnt - coalesce(b.cnt, 0) as bigint) as cnt from a left join b using (token) where a.cnt > coalesce(b.cnt, 0)")
def bow_subtract(spark, sf):
    return bags.subtract(*_halves(spark, sf), ["token"])


@query("bow_drop", _HALVES + "select token, cast(cnt as bigint) as cnt from a where token not in (select token from b)")
def bow_drop(spark, sf):
    return bags.drop(*_halves(spark, sf), ["token"])


@query("bong_totals", ctes() + "select n, cast(sum(c) as bigint) as total_ngrams, count(*) as distinct_ngrams from (select 1 as n, token as g, count(*) as c from t group by all union all select 2, token || ' ' || b, count(*) from (select token, lead(token) over (partition by doc_id order by pos) as b from t) where b is not null group by all) group by n")
def bong_totals(spark, sf):
    from ..operators import ngrams as ng

    d = corpus(spark, sf).token_lists
    parts = [d.select(F.lit(n).alias("n"), F.explode(ng.joined(ng.windows(F.col("tokens"), n), " ")).alias("token")) for n in (1, 2)]
    return bags.totals_by_length(parts[0].union(parts[1]).groupBy("n", "token").agg(F.count("*").alias("cnt")))


_IDS = ", ids as (select token, row_number() over (order by d0, p0) - 1 as term_id from (select token, min(doc_id) as d0, arg_min(pos, (doc_id, pos)) as p0 from t group by token))\n"


@query("vocab_ids", ctes() + _IDS + "select term_id, token, ttf, df from ids join v using (token)")
def vocab_ids(spark, sf):
    return corpus(spark, sf).vocabulary


@query("vocab_drop", ctes() + _IDS + "select term_id, token, ttf, df from ids join v using (token) where df > 1")
def vocab_drop(spark, sf):
    v = corpus(spark, sf).vocabulary
    return co.drop_terms(v, v.where("df <= 1")).select("term_id", "token", "ttf", "df")


@query("vocab_reduce_ids", ctes() + _IDS + "select row_number() over (order by ttf desc, term_id) - 1 as term_id, term_id as old_id, token, ttf, df from ids join v using (token)")
def vocab_reduce_ids(spark, sf):
    return co.reduce_ids(corpus(spark, sf).vocabulary)


@query("corpus_ttf_df", ctes() + "select * from v")
def corpus_ttf_df(spark, sf):
    return corpus(spark, sf).term_stats


@query("corpus_stats", f"select count(*) as doc_count, cast(sum(len({tokens_sql()})) as bigint) as total_tokens from documents")
def corpus_stats(spark, sf):
    return corpus(spark, sf).stats


@query("encode_ids", ctes() + _IDS + "select doc_id, cast(pos as integer) as pos, term_id from t join ids using (token)")
def encode_ids(spark, sf):
    return corpus(spark, sf).encoded()


@query("decode_tokens", ctes() + "select doc_id, cast(pos as integer) as pos, case when df > 2 then token end as token from t join v using (token)")
def decode_tokens(spark, sf):
    c = corpus(spark, sf)
    return co.decode(c.encoded(), c.vocabulary.where("df > 2"))


@query("doc_sequences", ctes() + "select doc_id, string_agg(token, ' ' order by pos) as tokens from t group by doc_id")
def doc_sequences(spark, sf):
    s = co.sequences(corpus(spark, sf).tokens)
    return s.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("remove_terms", ctes() + "select p.* from p join v using (token) where df > 1 and length(token) > 2")
def remove_terms(spark, sf):
    c = corpus(spark, sf)
    p = c.kept_postings
    kept = co.drop_terms(c.term_stats, c.term_stats.where("df <= 1 or length(token) <= 2"))
    return co.prune(p, kept)


def _terms(name, column, sql, **args):
    @query(name, ctes() + _IDS + ", x as (select term_id, token, ttf, df from ids join v using (token))\n" + sql)
    def run(spark, sf):
        c = corpus(spark, sf)
        total = None
        if args.get("limit") is not None and args["limit"] < 1:
            total = c.stats.first()["doc_count" if column == "df" else "total_tokens"]
        return co.extreme_terms(c.vocabulary, column, total=total, **args)


_terms("terms_high_df", "df", "select * from x where df > floor(0.1 * (select n from n))", limit=0.1, high=True)
_terms("terms_low_df", "df", "select * from x where df <= 2", limit=2, high=False)
_terms("terms_high_ttf", "ttf", "select * from x where ttf > floor(0.001 * (select count(*) from t))", limit=0.001, high=True)
_terms("terms_low_ttf", "ttf", "select * from x where ttf <= 3", limit=3, high=False)
_terms("terms_top_df", "df", "select * from x order by df desc, term_id limit 50", count=50, high=True)
_terms("terms_top_ttf", "ttf", "select * from x order by ttf desc, term_id limit 50", count=50, high=True)
_terms("terms_bottom_df", "df", "select * from x order by df, term_id limit 50", count=50, high=False)
_terms("terms_bottom_ttf", "ttf", "select * from x order by ttf, term_id limit 50", count=50, high=False)


def _queries(spark, sf):
    toks = Pipeline(PLAIN).tokens(F.col("text"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(toks).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("cnt"))


_COSINE = f""", w as (select doc_id, token, ln(cnt + 1) * (1 + ln((select n from n) / df)) as w from p join v using (token)),
wn as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
qt as (select item_id as query_id, unnest({tokens_sql()}) as token from benchmark),
q as (select query_id, token, ln(count(*) + 1) * (1 + ln((select n from n) / any_value(df))) as w from qt join v using (token) group by query_id, token),
qn as (select query_id, sqrt(sum(w * w)) as norm from q group by query_id),
s as (select query_id, doc_id, round(dot / (wn.norm * qn.norm), 6) as score from (select query_id, doc_id, sum(w.w * q.w) as dot from w join q using (token) group by all) join wn using (doc_id) join qn using (query_id))
"""


@query("query_topk", ctes() + _COSINE + "select query_id, doc_id, score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as integer) as rank from s) where rank <= 10")
def query_topk(spark, sf):
    c = corpus(spark, sf)
    s = weighting.rank(_queries(spark, sf), c.kept_postings, c.term_stats.select("token", "df"), c.docs.agg(F.count("*").alias("n")))
    return weighting.top_per_query(s.withColumn("score", six("score")), 10).select("query_id", "doc_id", "score", "rank")


@query("cosine_pairs", ctes() + _COSINE + "select query_id, doc_id, score from s")
def cosine_pairs(spark, sf):
    c = corpus(spark, sf)
    s = weighting.rank(_queries(spark, sf), c.kept_postings, c.term_stats.select("token", "df"), c.docs.agg(F.count("*").alias("n")))
    return s.select("query_id", "doc_id", six("score").alias("score"))


_DIST = ctes() + ", x as (select doc_id, token, cnt, sum(cnt) over (partition by doc_id) as s, rank() over (partition by doc_id order by cnt desc) as r, sum(cnt) over (partition by doc_id order by cnt) as c from p)\n"


def _head(name, sql, **args):
    @query(name, _DIST + sql)
    def run(spark, sf):
        return co.head(corpus(spark, sf).postings, "cnt", ["doc_id"], **args)


_head("dist_head_n", "select doc_id, token, cnt from x where r <= 5", n=5)
_head("dist_head_eps", "select doc_id, token, cnt from x where cnt > 0.01 * s", eps=0.01)
_head("dist_head_p", "select doc_id, token, cnt from (select *, min(case when c > (1 - 0.75) * s then cnt end) over (partition by doc_id) as k from x) where cnt >= k", p=0.75)


def _tfidf(name, tf, sublinear):
    sql = ctes() + f", w as (select doc_id, token, {tf} * (1 + ln((select n from n) / df)) as w from p join v using (token))\nselect doc_id, token, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as w from w"

    @query(name, sql)
    def run(spark, sf):
        return corpus(spark, sf).tfidf(sublinear=sublinear).withColumn("w", six("w"))


_tfidf("tfidf_vectors", "cnt", False)
_tfidf("tfidf_sublinear", "ln(cnt + 1)", True)


@query("vec_normalize", "select vec_id, k - 1 as k, round(e[k] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) as x from (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 3) as e, unnest(range(1, len(embedding) + 1)) as k from embeddings)")
def vec_normalize(spark, sf):
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3)
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(vec.unit(v)).alias("k", "x")).select("vec_id", F.col("k").cast("long").alias("k"), six("x").alias("x"))


_PAIR = "from (select cast(a.embedding as double[]) as x, cast(b.embedding as double[]) as y, a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id)"
_DOT = "list_sum(list_transform(list_zip(x, y), lambda z: z[1] * z[2]))"
_N = "sqrt(list_sum(list_transform({0}, lambda z: z * z)))"
_COS = f"{_DOT} / ({_N.format('x')} * {_N.format('y')})"
_SQ = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _vector(name, measure, plain, expr):
    @query(name, f"select a, b, round({expr}, 6) as value {_PAIR}")
    def run(spark, sf):
        e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("x"))
        return pairs.measured_pairs(e, measure, plain)


_vector("vec_cosine", pairs.cosine, vec.cosine, _COS)
_vector("vec_euclid", pairs.euclidean, vec.euclidean, f"sqrt({_SQ})")
_vector("vec_gauss", pairs.gauss(2.0), lambda a, b: vec.gauss_kernel(a, b, 2.0), f"exp(-{_SQ} / 4.0)")
_vector("vec_vmf", pairs.vmf(2.0), lambda a, b: vec.vmf_kernel(a, b, 2.0), f"exp(2.0 * {_COS})")


_LANG = ctes() + ", l as (select lang, token, cnt from p join documents using (doc_id)), lt as (select lang, token, sum(cnt) as c from l group by all), q as (select token, ttf / (select sum(ttf) from v) as q from v)\n"


def _by_lang(spark, sf):
    # counted by language where the texts are read: no posting crosses a shuffle, and all languages together give a term's count
    d = corpus(spark, sf).docs.select("lang", F.explode(Pipeline(PLAIN).tokens(F.col("text"))).alias("token"))
    lang = written(d.groupBy("lang", "token").agg(F.count("*").alias("p")), "languages")
    return lang.join(lang.groupBy("token").agg(F.sum("p").alias("q")), "token")


@query("it_kl", _LANG + "select lang, round(sum(pp * log2(pp / (q2 / sq))), 6) as kl from (select lang, c / sum(c) over (partition by lang) as pp, q as q2, sum(q) over (partition by lang) as sq from lt join q using (token)) group by lang")
def it_kl(spark, sf):
    return it.kl(_by_lang(spark, sf), "p", "q", ["lang"]).withColumn("kl", six("kl"))


@query("it_entropy", _LANG + "select lang, round(-sum(pp * log2(pp)), 6) as h from (select lang, c / sum(c) over (partition by lang) as pp from lt) group by lang")
def it_entropy(spark, sf):
    return it.entropy(_by_lang(spark, sf), "p", ["lang"]).withColumn("h", six("h"))


@query("it_cross_entropy", _LANG + "select lang, round(-sum(pp * log2(q2 / sq)), 6) as h from (select lang, c / sum(c) over (partition by lang) as pp, q as q2, sum(q) over (partition by lang) as sq from lt join q using (token)) group by lang")
def it_cross_entropy(spark, sf):
    return it.entropy(_by_lang(spark, sf), "p", ["lang"], q="q").withColumn("h", six("h"))


def _joint_sql(s: float) -> str:
    return f"""with c as (select lang as a, source as b, count(*) as c from documents group by all),
g as (select x.a, y.b, coalesce(c.c, 0) + {s} as c from (select distinct a from c) x cross join (select distinct b from c) y left join c on c.a = x.a and c.b = y.b),
j as (select a, b, cast(c as double) / sum(c) over () as p, cast(sum(c) over (partition by a) as double) / sum(c) over () as pa, cast(sum(c) over (partition by b) as double) / sum(c) over () as pb from g)
"""


@query("it_joint_smoothed", _joint_sql(1.0) + "select a, b, round(p, 6) as p, round(pa, 6) as pa, round(pb, 6) as pb from j")
def it_joint_smoothed(spark, sf):
    return it.joint(table(spark, sf, "documents"), "lang", "source", 1.0).select("a", "b", six("p").alias("p"), six("pa").alias("pa"), six("pb").alias("pb"))


_MI = "select round(mi, 6) as mi, round(h1, 6) as h1, round(h2, 6) as h2, round(2 * mi / (h1 + h2), 6) as nmi from (select sum(case when p > 0 then p * log2(p / (pa * pb)) else 0 end) as mi from j), (select -sum(pa * log2(pa)) as h1 from (select a, any_value(pa) as pa from j group by a)), (select -sum(pb * log2(pb)) as h2 from (select b, any_value(pb) as pb from j group by b))"


def _mi(name, s):
    @query(name, _joint_sql(s) + _MI)
    def run(spark, sf):
        return it.mutual_information(table(spark, sf, "documents"), "lang", "source", s).select(*[six(c).alias(c) for c in ("mi", "h1", "h2", "nmi")])


_mi("it_mi", 0.0)
_mi("it_nmi_smoothed", 1.0)


def _table(spark, sf):
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return it.contingency(j, "quality", "source")


_FS = "with c as (select quality as cls, source as feature, count(*) as c from documents join labels using (doc_id) group by all), g as (select x.cls, y.feature, cast(coalesce(c.c, 0) as double) as cnt from (select distinct cls from c) x cross join (select distinct feature from c) y left join c on c.cls = x.cls and c.feature = y.feature)\n"


@query("fs_contingency", _FS + "select cls, feature, cnt from g")
def fs_contingency(spark, sf):
    return _table(spark, sf)


@query("fs_ig", _FS + "select round((select -sum(p * ln(p)) from (select sum(cnt) / (select sum(cnt) from g) as p from g group by cls)) - sum(f / (select sum(cnt) from g) * h), 6) as ig from (select feature, any_value(f) as f, sum(case when cnt > 0 then -cnt / f * ln(cnt / f) else 0 end) as h from (select *, sum(cnt) over (partition by feature) as f from g) group by feature)")
def fs_ig(spark, sf):
    return it.information_gain(_table(spark, sf)).select(six("ig").alias("ig"))


@query("fs_chi2_stat", _FS + "select round(sum((cnt - e) * (cnt - e) / e), 6) as chi2, (count(distinct cls) - 1) * (count(distinct feature) - 1) as dof from (select *, sum(cnt) over (partition by cls) * sum(cnt) over (partition by feature) / sum(cnt) over () as e from g)")
def fs_chi2_stat(spark, sf):
    return it.chi_squared(_table(spark, sf)).select(six("chi2").alias("chi2"), "dof")


@query("fs_chi2_p")
def fs_chi2_p(spark, sf):
    return it.chi_squared(_table(spark, sf))



def _parts(spark, sf):
    """Counts of each user's events by type, plus one, in order of the type."""
    e = table(spark, sf, "events")
    kinds = e.select("event_type").distinct()
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("c"))
    full = e.select("user_id").distinct().crossJoin(F.broadcast(kinds)).join(c, ["user_id", "event_type"], "left")
    s = full.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", (F.coalesce("c", F.lit(0)) + 1).cast("double").alias("x")))).alias("s"))
    return s.select("user_id", F.col("s.x").alias("parts"))


_PARTS = """with c as (select user_id, event_type, count(*) as c from events group by all),
g as (select u.user_id, k.event_type, cast(coalesce(c.c, 0) + 1 as double) as x from (select distinct user_id from events) u cross join (select distinct event_type from events) k left join c on c.user_id = u.user_id and c.event_type = k.event_type),
r as (select user_id, row_number() over (partition by user_id order by event_type) - 1 as k, x from g)
"""


def _composition(name, f, sql):
    @query(name, _PARTS + sql)
    def run(spark, sf):
        return _parts(spark, sf).select("user_id", F.posexplode(f(F.col("parts"))).alias("k", "x")).select("user_id", F.col("k").cast("long").alias("k"), six("x").alias("x"))


_composition("comp_closure", comp.closure, "select user_id, k, round(x / sum(x) over (partition by user_id), 6) as x from r")
_composition("comp_clr", comp.clr, "select user_id, k, round(ln(x) - avg(ln(x)) over (partition by user_id), 6) as x from r")
_composition("comp_softmax", lambda v: comp.softmax(comp.closure(v)), "select user_id, k, round(exp(y) / sum(exp(y)) over (partition by user_id), 6) as x from (select user_id, k, x / sum(x) over (partition by user_id) as y from r)")


@query("comp_center", _PARTS + "select k, round(exp(m) / sum(exp(m)) over (), 6) as center from (select k, avg(y) as m from (select k, ln(x) - avg(ln(x)) over (partition by user_id) as y from r) group by k)")
def comp_center(spark, sf):
    return comp.center(_parts(spark, sf), "parts").select(F.col("k").cast("long").alias("k"), six("center").alias("center"))


# Keyed tables.

_OLD = "old as (select c_custkey, c_name, c_acctbal from customer where c_custkey % 3 <> 0), new as (select c_custkey, 'new ' || c_name as c_name, case when c_custkey % 2 = 0 then c_acctbal + 1 end as c_acctbal from customer where c_custkey % 5 = 0)"


def _old_new(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    old = c.where(F.pmod("c_custkey", F.lit(3)) != 0)
    new = c.where(F.pmod("c_custkey", F.lit(5)) == 0).select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    return old, new


@query("upsert_replace", f"with {_OLD} select * from new union all select * from old where c_custkey not in (select c_custkey from new)")
def upsert_replace(spark, sf):
    return tables.insert(*_old_new(spark, sf), ["c_custkey"], "replace")


@query("upsert_ignore", f"with {_OLD} select * from old union all select * from new where c_custkey not in (select c_custkey from old)")
def upsert_ignore(spark, sf):
    return tables.insert(*_old_new(spark, sf), ["c_custkey"], "ignore")


@query("upsert_update", f"with {_OLD} select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(n.c_name, o.c_name) as c_name, coalesce(n.c_acctbal, o.c_acctbal) as c_acctbal from old o full join new n on o.c_custkey = n.c_custkey")
def upsert_update(spark, sf):
    return tables.update(*_old_new(spark, sf), ["c_custkey"])


@query("upsert_batched", "select o_custkey, max(o_orderdate) as last_date, arg_max(o_totalprice, case when o_orderkey % 2 = 0 then o_orderkey end) as price from orders group by o_custkey")
def upsert_batched(spark, sf):
    o = table(spark, sf, "orders")
    latest = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_date"))
    rows = o.select("o_custkey", "o_orderkey", F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.col("o_totalprice")).alias("price"))
    base = latest.withColumn("price", F.lit(None).cast("double"))
    return tables.update(base, rows, ["o_custkey"], seq="o_orderkey")


# Streams, run to the end of what is there.


@query("stream_ttf_df", ctes() + "select * from v")
def stream_ttf_df(spark, sf):
    docs = table(spark, sf, "documents")
    root = _folder(spark)
    # a file source reads folders: the documents come as the files of one
    docs.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    incremental.maintain_stats(stream, Pipeline(PLAIN), f"{root}/state", f"{root}/checkpoint")
    return incremental.Versions(spark, f"{root}/state").latest()


@query("stream_token_series", "select time_bucket(interval '7 days', ts, timestamp '1970-01-01') as bucket, event_type as token, count(*) as value from events group by all")
def stream_token_series(spark, sf):
    events = table(spark, sf, "events")
    root = _folder(spark)
    events.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
    series = incremental.token_series(stream, "ts", "event_type")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{root}/out/version={number}")

    # complete output: the last batch has all windows
    query_ = series.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query_.awaitTermination()
    out = incremental.Versions(spark, f"{root}/out").latest()
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "token", "value")


def _folder(spark) -> str:
    return fresh_path(spark, "stream")


@query("filter_documents", ctes() + "select doc_id from p group by doc_id having count(*) >= 100")
def filter_documents(spark, sf):
    from ..sources.documents import filter_documents as f

    c = corpus(spark, sf)
    return f(c.docs, c.postings, min_features=100).select("doc_id")


@query("corpus_set_attributes", "select doc_id, lang, source, n_chars, case when lang = 'en' then 1 end as flag from documents")
def corpus_set_attributes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.when(F.col("lang") == "en", 1).alias("flag"))


