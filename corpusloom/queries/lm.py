"""Language-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lm
from ..plans import Pipeline
from . import query
from .common import PLAIN, corpus, ctes, six, table, tokens_sql

#: c: all n-grams of one or two tokens as (n, context, token, total), the context as text.
_C = ctes() + """, b as (select doc_id, pos, token, lag(token) over (partition by doc_id order by pos) as before, lead(token) over (partition by doc_id order by pos) as after from t),
u as (select token, count(*) as total from t group by token),
bi as (select before as context, token, count(*) as total from b where before is not null group by all),
bt as (select context, sum(total) as ct, count(*) as kinds from bi group by context),
vv as (select count(*) as v, (select count(*) from t) as n1 from u)
"""


def _lists(spark, sf):
    return corpus(spark, sf).token_lists


def _text(df):
    return df.withColumn("context", F.array_join("context", " "))


@query("lm_ngram_counts", _C + """select 1 as n, '' as context, token, count(*) as total from (select token from b where after is not null) group by token
union all select 2, context, token, total from bi""")
def lm_ngram_counts(spark, sf):
    return _text(lm.ngram_counts(_lists(spark, sf), 2)).select("n", "context", "token", "total")


@query("lm_ngram_counts_all", _C + "select 1 as n, '' as context, token, total from u union all select 2, context, token, total from bi")
def lm_ngram_counts_all(spark, sf):
    return _text(lm.all_ngrams(_lists(spark, sf), 2)).select("n", "context", "token", "total")


@query("lm_prefix_totals", _C + "select 2 as n, context, cast(ct as bigint) as total, kinds as distinct_next from bt")
def lm_prefix_totals(spark, sf):
    return _text(lm.prefix_totals(lm.all_ngrams(_lists(spark, sf), 2).where("n = 2"))).select("n", "context", "total", "distinct_next")


@query("lm_distinct", _C + "select 1 as n, context as prefix, kinds as distinct_ngrams from bt union all select 2, context || ' ' || token, 1 from bi")
def lm_distinct(spark, sf):
    x = lm.distinct_below(lm.all_ngrams(_lists(spark, sf), 2), 2)
    return x.select("n", F.array_join("prefix", " ").alias("prefix"), "distinct_ngrams")


@query("lm_contexts", _C + "select token as suffix, count(*) as contexts from bi group by token")
def lm_contexts(spark, sf):
    x = lm.left_contexts(lm.all_ngrams(_lists(spark, sf), 2), 2)
    return x.select(F.array_join("suffix", " ").alias("suffix"), "contexts")


@query("lm_reversed", _C + "select token as first, context as rest, total from bi")
def lm_reversed(spark, sf):
    x = lm.reversed_counts(lm.all_ngrams(_lists(spark, sf), 2).where("n = 2"))
    return x.select("first", F.array_join("rest", " ").alias("rest"), "total")


@query("lm_merge", _C + "select 1 as n, '' as context, token, total from u union all select 2, context, token, total from bi")
def lm_merge(spark, sf):
    d = _lists(spark, sf)
    half = lambda k: lm.all_ngrams(d.where(F.pmod("doc_id", F.lit(2)) == k), 2)
    return _text(lm.merge(half(0), half(1)))


#: The n-grams that are judged: bigrams of the benchmark's texts.
_G = f""", e as (select item_id, unnest(toks) as token, generate_subscripts(toks, 1) - 1 as pos from (select item_id, {tokens_sql()} as toks from benchmark)),
eb as (select item_id, pos, token, lag(token) over (partition by item_id order by pos) as before from e),
g as (select distinct before as context, token from eb where before is not null),
gc as (select g.context, g.token, coalesce(bi.total, 0) as c, coalesce(bt.ct, 0) as ct, coalesce(bt.kinds, 0) as kinds, coalesce(u.total, 0) as c1
  from g left join bi on bi.context = g.context and bi.token = g.token left join bt on bt.context = g.context left join u on u.token = g.token)
"""


def _items(spark, sf):
    toks = Pipeline(PLAIN).tokens(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", toks.alias("tokens"))


def _grams(spark, sf):
    return lm.positions(_items(spark, sf), 2, "item_id").where(F.size("context") == 1).select("context", "token").distinct()


def _smoothed(name, f, expr):
    @query(name, _C + _G + f"select context, token, round({expr}, 6) as p from gc, vv")
    def run(spark, sf):
        p = f(_grams(spark, sf), lm.train(_lists(spark, sf), 2))
        return _text(p).withColumn("p", six("p")).select("context", "token", "p")


_smoothed("lm_additive", lambda g, c: lm.additive(g, c, 0.1), "(c + 0.1) / (ct + v * 0.1)")
_LOWER = "(0.9 * c1 / n1 + 0.1 * {0})"
_OWN = "case when ct > 0 then 0.9 * c / nullif(ct, 0) else 0.9 / v end"
_smoothed("lm_interpolated", lambda g, c: lm.interpolated(g, c, 0.1), f"{_OWN} + 0.1 * {_LOWER.format('1.0')}")
_smoothed("lm_interpolated_proper", lambda g, c: lm.interpolated(g, c, 0.1, proper=True), f"{_OWN} + 0.1 * {_LOWER.format('1.0 / v')}")
_D1 = "(greatest(c1 - 0.1, 0) / n1 + 0.1 * v / n1 / v)"
_smoothed("lm_absdisc", lambda g, c: lm.absolute_discount(g, c, 0.1), f"case when ct > 0 then greatest(c - 0.1, 0) / nullif(ct, 0) + 0.1 * kinds / nullif(ct, 0) * {_D1} else {_D1} end")


@query("lm_kn", _C + _G + """, k as (select token, count(*) as k from bi group by token), kt as (select sum(k) as kt, count(*) as kk from k),
x as (select gc.context, gc.token, c, ct, kinds, greatest(coalesce(k.k, 0) - 0.75, 0) / kt + 0.75 * kk / kt / v as low from gc left join k on k.token = gc.token, kt, vv)
select context, token, round(case when ct > 0 then greatest(c - 0.75, 0) / nullif(ct, 0) + 0.75 * kinds / nullif(ct, 0) * low else low end, 6) as p from x""")
def lm_kn(spark, sf):
    p = lm.kneser_ney(_grams(spark, sf), lm.train(_lists(spark, sf), 2))
    return _text(p).withColumn("p", six("p")).select("context", "token", "p")


_P = """, lp as (select item_id, count(*) as n_tokens, sum(ln(case when before is null then (coalesce(u.total, 0) + 0.1) / (n1 + v * 0.1) else (coalesce(bi.total, 0) + 0.1) / (coalesce(bt.ct, 0) + v * 0.1) end)) as logp
from eb left join u on u.token = eb.token left join bi on bi.context = eb.before and bi.token = eb.token left join bt on bt.context = eb.before, vv group by item_id)
"""


@query("lm_logp", _C + _G + _P + "select item_id, n_tokens, round(logp, 6) as logp from lp")
def lm_logp(spark, sf):
    x = lm.log_prob(_items(spark, sf), lm.train(_lists(spark, sf), 2), 2, "additive", "item_id", delta=0.1)
    return x.select("item_id", "n_tokens", six("logp").alias("logp"))


@query("lm_perplexity", _C + _G + _P + "select item_id, round(exp(-logp / n_tokens), 4) as perplexity from lp")
def lm_perplexity(spark, sf):
    x = lm.log_prob(_items(spark, sf), lm.train(_lists(spark, sf), 2), 2, "additive", "item_id", delta=0.1)
    return x.select("item_id", F.round("perplexity", 4).alias("perplexity"))


@query("lm_top_tokens", _C + """select context, rank, token, round(p, 6) as p from (select context, token, p, cast(row_number() over (partition by context order by p desc, token) as integer) as rank from
(select w.context, u.token, (coalesce(bi.total, 0) + 0.1) / (bt.ct + v * 0.1) as p from (values ('the'), ('of'), ('de')) w(context) cross join u join bt on bt.context = w.context left join bi on bi.context = w.context and bi.token = u.token, vv)) where rank <= 10""")
def lm_top_tokens(spark, sf):
    contexts = spark.createDataFrame([(["the"],), (["of"],), (["de"],)], "context array<string>")
    x = lm.top_tokens(contexts, lm.train(_lists(spark, sf), 2), 10, "additive", delta=0.1)
    return _text(x).select("context", "rank", "token", six("p").alias("p"))


@query("lm_cumulative", _C + "select context, token, round((h - total) / s, 6) as low, round(h / s, 6) as high from (select context, token, total, sum(total) over (partition by context order by token) as h, sum(total) over (partition by context) as s from bi)")
def lm_cumulative(spark, sf):
    x = lm.cumulative(lm.all_ngrams(_lists(spark, sf), 2).where("n = 2"))
    return _text(x).select("context", "token", six("low").alias("low"), six("high").alias("high"))


@query("lm_top_interpolated", _C + """, w as (select context from (values ('the'), ('of'), ('de')) w(context)),
x as (select w.context, u.token, case when ct > 0 then 0.9 * coalesce(bi.total, 0) / ct else 0.9 / v end + 0.1 * (0.9 * u.total / n1 + 0.1 / v) as p from w cross join u left join bt on bt.context = w.context left join bi on bi.context = w.context and bi.token = u.token, vv)
select context, rank, token, round(p, 6) as p from (select *, cast(row_number() over (partition by context order by p desc, token) as integer) as rank from x) where rank <= 10""")
def lm_top_interpolated(spark, sf):
    contexts = spark.createDataFrame([(["the"],), (["of"],), (["de"],)], "context array<string>")
    x = lm.top_tokens(contexts, lm.train(_lists(spark, sf), 2), 10, "linear interpolation", lam=0.1, proper=True)
    return _text(x).select("context", "rank", "token", six("p").alias("p"))


@query("lm_node", _C + "select 2 as n, 'the' as context, token, total, (select count(*) from (select 1 from (select token, before, lag(before) over (partition by doc_id order by pos) as b2 from b) where b2 = 'the' and before = 'of' group by token)) as distinct_next, (select count(*) from (select token, before, lag(before) over (partition by doc_id order by pos) as b2 from b) where b2 = 'the' and before = 'of') as total_next from bi where context = 'the' and token = 'of'")
def lm_node(spark, sf):
    return _text(lm.node(lm.train(_lists(spark, sf), 3), "the", "of"))


@query("lm_generate")
def lm_generate(spark, sf):
    return lm.generate(lm.all_ngrams(_lists(spark, sf), 2), 2, 20, 15, seed=1).select("text_id", F.array_join("tokens", " ").alias("text"))
