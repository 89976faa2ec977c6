"""Preprocessing, n-grams, sources and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.codec import compressed, decompressed
from ..operators import ngrams as ng
from ..operators.corpus import Corpus
from ..plans import Pipeline, PipelineSpec, builtin, builtin_names
from ..plans.spec import NgramSpec, Op
from ..plans.shipped import step
from ..sources import exports
from . import query
from .common import ENGLISH, PAIRS, PLAIN, corpus, ctes, quoted, table, tokens_sql


def _sub(pattern, repl):
    return step("replace", pattern=pattern, repl=repl)


def _joined(spec, sep="|", name="documents", key="doc_id"):
    def run(spark, sf):
        return table(spark, sf, name).select(key, F.array_join(Pipeline(spec).tokens(F.col("text")), sep).alias("tokens"))

    return run


@query("pre_lower_upper", r"select doc_id, lower(text) as lowered, upper(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) as uppered from documents")
def pre_lower_upper(spark, sf):
    low = Pipeline({"sequence": ["lower"]})
    up = Pipeline({"sequence": [_sub("[^a-zA-Z ]", ""), "upper"]})
    one = lambda p: F.array_join(p.tokens(F.col("text")), "")
    return table(spark, sf, "documents").select("doc_id", one(low).alias("lowered"), one(up).alias("uppered"))


@query("pre_case_matched", rf"select doc_id, array_to_string(list_transform({tokens_sql()}, lambda x: case when regexp_full_match(x, '[a-m].*') then upper(x) else x end), ' ') as tokens from documents")
def pre_case_matched(spark, sf):
    spec = PipelineSpec.read(PLAIN).append(Op("upper", {"pattern": "[a-m].*", "match": "full"}))
    return _joined(spec, " ")(spark, sf)


query("pre_replace_chain", f"select doc_id, array_to_string({tokens_sql()}, ' ') as tokens from documents")(_joined(PLAIN, " "))


def _squeezed(x: str, letters: str) -> str:
    for c in letters:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c}{c}', 'g')"
    return x


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
query("pre_repeat_squeeze", f"select doc_id, array_to_string(list_filter(string_split_regex({_squeezed('''regexp_replace(lower(text), '[^a-z]', ' ', 'g')''', _LETTERS)}, '\\s+'), lambda x: x <> ''), ' ') as tokens from documents")(
    _joined({"sequence": ["lower", _sub("[^a-z]", " "), _sub(r"([a-z])\1{2,}", r"\1\1"), step("split", pattern=r"\s+")]}, " ")
)
query("pre_split_keep", "select doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(text), '([.!?])', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)), lambda x: x <> ''), '|') as tokens from documents")(
    _joined({"sequence": ["lower", step("split", pattern="[.!?]", keep=True)]})
)
query("pre_strip", "select doc_id, trim(text, ' .,' || chr(10)) as tokens from documents")(_joined({"sequence": [step("strip", chars=" .,\n")]}))
query("pre_filter_retain", f"select doc_id, array_to_string(list_filter({tokens_sql()}, lambda x: not regexp_full_match(x, '.{{1,2}}') and regexp_matches(x, 'i[no]')), '|') as tokens from documents")(
    _joined({"sequence": [*PLAIN["sequence"], step("filter", pattern=".{1,2}"), step("keep", pattern="i[no]", match="partial")]})
)
query("pre_stopwords", f"select doc_id, array_to_string(list_filter({tokens_sql()}, lambda x: x not in ({quoted(ENGLISH)})), '|') as tokens from documents")(
    _joined({"sequence": [*PLAIN["sequence"], "stopwords"], "stopwords": "english"})
)


@query("pre_tokenize_gaps", r"select conv_id, turn, role, array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), '|') as tokens from conversations")
def pre_tokenize_gaps(spark, sf):
    p = Pipeline({"sequence": ["lower", step("tokenize", name="RegexpTokenizer", kwargs=dict(pattern=r"\s+", gaps=True, discard_empty=True))]})
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.array_join(p.tokens(F.col("text")), "|").alias("tokens"))


def _middle(stop: bool) -> str:
    x = "lower(text)"
    for p, r in [("\\s+[0-9]{4}(''s\\s|\\s+)", " _year_ "), ("[0-9]+(\\.[0-9]*)?", " _num_ "), ("_num_\\s*%", " _percent_ "), ("\\$\\s*_num_", " _currency_ "), ("''*\\s+''*", " "), ("[^A-Za-z_'']", " ")]:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    toks = f"list_transform(string_split_regex({x}, '\\s+'), lambda x: {_squeezed('x', _LETTERS + '_')})".replace("lambda x: ", "lambda w: ").replace("regexp_replace(x, 'a{3,}'", "regexp_replace(w, 'a{3,}'")
    toks = f"list_filter({toks}, lambda x: x <> ''" + (f" and x not in ({quoted(ENGLISH)}))" if stop else ")")
    return f"select doc_id, array_to_string({toks}, ' ') as tokens from documents"


def _world(stop: bool) -> str:
    from ..plans.spec import load_stopwords

    toks = r"string_split_regex(regexp_replace(regexp_replace(text, '[^\pL\pN_]', ' ', 'g'), '[0-9]', '#', 'g'), '\s+')"
    words = load_stopwords(["english", "spanish", "french", "arabic"], ["_num_", "_percent_"])
    toks = f"list_filter({toks}, lambda x: x <> ''" + (f" and x not in ({quoted(words)}))" if stop else ")")
    return f"select doc_id, array_to_string({toks}, ' ') as tokens from documents"


def _twice(w: str, i: str = "i") -> str:
    """The word with runs of three or more of a character cut to two."""
    return f"array_to_string(list_transform(range(1, length({w}) + 1), lambda {i}: case when {i} > 2 and {w}[{i}] = {w}[{i} - 1] and {w}[{i}] = {w}[{i} - 2] then '' else {w}[{i}] end), '')"


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    for p, r in pairs:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


_NUM = "[0-9]+(\\.[0-9]*)?"


def _news() -> str:
    x = _replaced("text", ("_", ""), ("[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+", " _email_ "), ("@[A-Za-z0-9_-]+", " _username_ "))
    x = _squeezed(_squeezed(x, _LETTERS), _LETTERS.upper())
    x = _replaced(f"lower({x})", ("(^|\\s)(talk|soc|sci|rec|misc|comp|alt)[^\\sA-Aa-z0-9][a-z.-]+", " _group_ "), (_NUM, " _num_ "), ("''*\\s+''*", " "), ("[^A-Za-z_'']", " "))
    return f"select doc_id, array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda x: x <> ''), ' ') as tokens from documents"


def _world_full(stop: bool) -> str:
    from ..plans.spec import load_stopwords

    money = "$£¥₠-₾"
    x = _replaced("lower(text)", ("\\s+[0-9]{4}(''s\\s|\\s+)", " _year_ "), (_NUM, " _num_ "), ("_num_\\s*%", " _percent_ "), (f"([{money}])\\s*_num_", " _\\1_ "), ("''*\\s+''*", " "), (f"[^\\pL\\pN_''{money}]+", " "))
    toks = f"list_transform(string_split_regex({x}, '\\s+'), lambda w: {_twice('w')})"
    words = load_stopwords(["english", "spanish", "french", "arabic"], ["_num_", "_percent_"])
    toks = f"list_filter({toks}, lambda x: x <> ''" + (f" and x not in ({quoted(words)}))" if stop else ")")
    return f"select doc_id, array_to_string({toks}, ' ') as tokens from documents"


#: m: tokens of the middle pipeline as lists, g: their n-grams of one and two, at most half of them stop words, with END after the last.
_MIDDLE_GRAMS = f"""with m as (select doc_id, case when tokens = '' then [] else string_split(tokens, ' ') end as w from ({_middle(False)})),
b as (select doc_id, w, list_concat(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]), case when len(w) > 0 then [[w[len(w)], 'END']] else [] end) as pairs from m),
g as (select doc_id, list_concat(list_append(list_filter(w, lambda x: x not in ({quoted(ENGLISH)})), 'END'), list_transform(list_filter(pairs, lambda p: len(list_filter(p, lambda x: x in ({quoted(ENGLISH)}))) <= 1), lambda p: array_to_string(p, '_'))) as grams from b)
"""
_PIPELINE_SQL = {
    "intermediate_unigrams": _middle(True), "intermediate_unigrams_no_stopwords": _middle(False), "intermediate_unigrams+bigrams": _MIDDLE_GRAMS + "select doc_id, array_to_string(grams, ' ') as tokens from g",
    "multilingual_unigrams_basic_keep_stopwords": _world(False), "multilingual_unigrams_basic_remove_stopwords": _world(True),
    "multilingual_unigrams_keep_stopwords": _world_full(False), "multilingual_unigrams_remove_stopwords": _world_full(True),
    "20_newsgroups": _news(), "no_punctuation_keep_stopwords": _news(),
}


def _shipped(name: str):
    """The tokens of a shipped pipeline, or its n-grams where it is made for those."""
    spec = builtin(name)
    if name != "intermediate_unigrams+bigrams":
        return _joined(spec, " ")

    def run(spark, sf):
        p = Pipeline(spec)
        d = table(spark, sf, "documents").select("doc_id", p.tokens(F.col("text")).alias("w"))  # a column of its own, or each window would tokenise anew
        return d.select("doc_id", F.array_join(p.ngrams(F.col("w")), " ").alias("tokens"))

    return run


for _name in builtin_names():
    query("pre_pipeline_" + _name.replace("+", "_"), _PIPELINE_SQL.get(_name))(_shipped(_name))


@query("split_sentences")
def split_sentences(spark, sf):
    toks = Pipeline(builtin("split_sentences")).tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(toks).alias("pos", "sentence"))


@query("pre_pipeline_bigrams_counts", _MIDDLE_GRAMS + "select token, count(*) as cnt from (select unnest(grams) as token from g) group by token")
def pipeline_bigrams(spark, sf):
    p = Pipeline(builtin("intermediate_unigrams+bigrams"))
    d = table(spark, sf, "documents").select("doc_id", p.tokens(F.col("text")).alias("tokens"))
    g = d.select("doc_id", F.explode(p.ngrams(F.col("tokens"))).alias("token"))
    return g.groupBy("token").agg(F.count("*").alias("cnt"))


@query("corpus_ngram_stats", _MIDDLE_GRAMS.split("\ng as")[0].rstrip(",\n") + f""", x as (select doc_id, 1 as n, unnest(list_append(list_filter(w, lambda x: x not in ({quoted(ENGLISH)})), 'END')) as token from b
union all select doc_id, 2, unnest(list_transform(list_filter(pairs, lambda p: len(list_filter(p, lambda x: x in ({quoted(ENGLISH)}))) <= 1), lambda p: array_to_string(p, '_'))) from b)
select n, token, count(*) as ttf, count(distinct doc_id) as df from x group by all""")
def corpus_ngram_stats(spark, sf):
    return Corpus(table(spark, sf, "documents"), Pipeline(builtin("intermediate_unigrams+bigrams"))).ngram_stats


@query("pre_debug_stages", rf"select item_id, lower(text) as s0, regexp_replace(lower(text), '[^a-z]', ' ', 'g') as s1, array_to_string(string_split_regex(regexp_replace(lower(text), '[^a-z]', ' ', 'g'), '\s+'), '|') as s2 from benchmark")
def pre_debug_stages(spark, sf):
    x = Pipeline(PLAIN).debug(table(spark, sf, "benchmark"))
    return x.select("item_id", F.array_join("stage_0", "|").alias("s0"), F.array_join("stage_1", "|").alias("s1"), F.array_join("stage_2", "|").alias("s2"))


@query("pre_compose", f"select item_id, array_to_string(list_transform({tokens_sql('''replace(text, 'e', 'o')''')}, lambda x: reverse(x)), ' ') as tokens from benchmark")
def pre_compose(spark, sf):
    spec = PipelineSpec.read(PLAIN).prepend(lambda c: F.replace(c, F.lit("e"), F.lit("o"))).append(F.reverse)
    return _joined(spec, " ", "benchmark", "item_id")(spark, sf)


@query("pre_compose_sum", f"select item_id, array_to_string(list_transform({tokens_sql()}, lambda x: upper(x)), ' ') as tokens from benchmark")
def pre_compose_sum(spark, sf):
    return _joined(PipelineSpec.read(PLAIN) + PipelineSpec.read({"ops": ["uppercase"]}), " ", "benchmark", "item_id")(spark, sf)


@query("pre_stem")
def pre_stem(spark, sf):
    spec = {"sequence": [*PLAIN["sequence"], step("stem", name="SnowballStemmer", kwargs=dict(language="english"))]}
    toks = Pipeline(spec).tokens(F.col("text"))
    return table(spark, sf, "documents").select(F.explode(toks).alias("stem")).groupBy("stem").agg(F.count("*").alias("cnt"))


_TAG, _NOT_TEXT = "<[^>]*>", "[^a-z]"


@query("html_strip_tokens", f"select page_id, token, count(*) as cnt from (select page_id, unnest(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(html), '{_TAG}', ' ', 'g'), '{_NOT_TEXT}', ' ', 'g'), '\\s+'), lambda x: x <> '')) as token from pages) group by all")
def html_strip_tokens(spark, sf):
    p = Pipeline({"sequence": ["lower", _sub(_TAG, " "), _sub(_NOT_TEXT, " "), step("split", pattern=r"\s+")]})
    return table(spark, sf, "pages").select("page_id", F.explode(p.tokens(F.col("html"))).alias("token")).groupBy("page_id", "token").agg(F.count("*").alias("cnt"))


def _ngram_sql(n: int) -> str:
    leads = ", ".join(f"lead(token, {i}) over w as t{i}" for i in range(1, n))
    gram = " || '_' || ".join(["token", *[f"t{i}" for i in range(1, n)]])
    return ctes() + f"select {gram} as gram, count(*) as cnt from (select token, {leads} from t window w as (partition by doc_id order by pos)) where t{n - 1} is not null group by all"


def _ngrams(n):
    def run(spark, sf):
        t = corpus(spark, sf).token_lists.select(F.explode(ng.joined(ng.windows(F.col("tokens"), n), "_")).alias("gram"))
        return t.groupBy("gram").agg(F.count("*").alias("cnt"))

    return run


query("ng_bigrams", _ngram_sql(2))(_ngrams(2))
query("ng_trigrams", _ngram_sql(3))(_ngrams(3))


@query("ng_char3", ctes() + "select substr(token, i, 3) as gram, count(*) as cnt from (select token, unnest(range(1, length(token) - 1)) as i from t where length(token) >= 3) group by all")
def ng_char3(spark, sf):
    t = corpus(spark, sf).tokens.select(F.explode(ng.char_windows(F.col("token"), 3)).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("cnt"))


@query("ng_padded", ctes() + """select a || '_' || b as gram, count(*) as cnt from (
select '<s>' as a, token as b from t where pos = 0
union all select token, 'END' from (select *, max(pos) over (partition by doc_id) as m from t) where pos = m
union all select token, b from (select token, lead(token) over (partition by doc_id order by pos) as b from t) where b is not null) group by all""")
def ng_padded(spark, sf):
    g = ng.joined(ng.windows(F.col("tokens"), 2, "<s>", "END"), "_")
    return corpus(spark, sf).token_lists.select(F.explode(g).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))


@query("ng_stop_limited", ctes() + f"""select token || '_' || b as gram, count(*) as cnt from (select token, lead(token) over (partition by doc_id order by pos) as b from t)
where b is not null and (case when token in ({quoted(ENGLISH)}) then 1 else 0 end) + (case when b in ({quoted(ENGLISH)}) then 1 else 0 end) <= 1 group by all""")
def ng_stop_limited(spark, sf):
    g = ng.ngrams(F.col("tokens"), NgramSpec((2,), 1, 0.5, "_"), ENGLISH)
    return corpus(spark, sf).token_lists.select(F.explode(g).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))


@query("ng_rollsum", ctes() + f"""select doc_id, pos, cast(s as bigint) as roll_sum from (select doc_id, pos, sum(case when token in ({quoted(ENGLISH)}) then 1 else 0 end) over w as s, count(*) over w as c
from t window w as (partition by doc_id order by pos rows between 4 preceding and current row)) where c = 5""")
def ng_rollsum(spark, sf):
    t = corpus(spark, sf).tokens.select("doc_id", "pos", F.col("token").isin(list(ENGLISH)).cast("long").alias("hit"))
    return ng.rolling_sum(t, "hit", 5, ["doc_id"], ["pos"]).select("doc_id", F.col("pos").cast("long").alias("pos"), "roll_sum")


@query("ng_join_collocations", ctes() + f"""select doc_id, part - 1 as pos, string_agg(token, '_' order by pos) as token from (
select *, sum(case when (before, token) in ({", ".join(f"('{a}', '{b}')" for a, b in PAIRS)}) then 0 else 1 end) over (partition by doc_id order by pos) as part
from (select *, coalesce(lag(token) over (partition by doc_id order by pos), '') as before from t)) group by doc_id, part""")
def ng_join_collocations(spark, sf):
    pairs = spark.createDataFrame(PAIRS, "first string, second string")
    return ng.join_collocations(corpus(spark, sf).tokens, pairs).select("doc_id", F.col("pos").cast("decimal(38,0)").alias("pos"), "token")


@query("sink_mallet", f"select doc_id || ' ' || lang || ' ' || array_to_string({tokens_sql()}, ' ') as value from documents")
def sink_mallet(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", Pipeline(PLAIN).tokens(F.col("text")).alias("tokens"))
    return exports.mallet_lines(d, "lang")


_DTM = ctes() + """, o as (select doc_id, timestamp '2020-01-01' + to_days(cast(doc_id % 97 as integer)) as date from d where doc_id in (select doc_id from p)),
i as (select doc_id, date, row_number() over (order by date, doc_id) - 1 as idx, (select count(*) from o) as n from o),
w as (select *, cast(floor(idx / (case when n < 100 then greatest(n, 1) when ceil(n / 100.0) > 20 then n / 20.0 else n / floor(n / 100.0) end)) as bigint) as slice from i),
ids as (select token, row_number() over (order by token) - 1 as id from v)
"""


def _dtm(part, sql):
    def run(spark, sf):
        d = table(spark, sf, "documents").select("doc_id", (F.lit("2020-01-01").cast("date") + F.pmod("doc_id", F.lit(97)).cast("int")).alias("date"))
        x = getattr(exports.DynamicTopicFiles(corpus(spark, sf).postings, d, 100, 20), part)()
        return x.select(F.col("line").cast("long").alias("line"), "value")

    return query(f"sink_dtm_{part}", _DTM + sql)(run)


_dtm("voc", "select id as line, token as value from ids")
_dtm("mult", "select idx as line, count(*) || ' ' || string_agg(id || ':' || cnt, ' ' order by id) as value from p join ids using (token) join w using (doc_id) group by idx")
_dtm("seq", "select slice + 1 as line, cast(count(*) as varchar) as value from w group by slice union all select 0, cast(count(distinct slice) as varchar) from w")
_dtm("dates", "select slice as line, strftime(min(date), '%Y-%m-%d') || ' ' || strftime(max(date), '%Y-%m-%d') as value from w group by slice")


def _code_sql(x: str) -> str:
    """Hexadecimal digits of a number's code: digits of base 127, least first, the first as its negative less one."""
    parts = [f"printf('%02x', 255 - ({x}) % 127)"]
    for k in range(1, 6):
        parts.append(f"case when ({x}) >= {127**k} then printf('%02x', (({x}) // {127**k}) % 127) else '' end")
    return " || ".join(parts)


@query("codec_roundtrip", f"select doc_id, {_code_sql('n_chars')} || {_code_sql('doc_id')} || '{'ff'}' as code, true as same from documents")
def codec_roundtrip(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.array("n_chars", "doc_id", F.lit(0).cast("long")).alias("a"))
    x = x.withColumn("b", compressed(F.col("a")))
    return x.select("doc_id", F.lower(F.hex("b")).alias("code"), (decompressed(F.col("b")) == F.col("a")).alias("same"))
