import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem
from corpusloom.plans import Pipeline, PipelineSpec, builtin, builtin_names, stop_list
from corpusloom.plans import regexlate, spec
from corpusloom.plans.spec import Op
from corpusloom.plans.shipped import step


def tokens(spark, p, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select("i", (p if isinstance(p, Pipeline) else Pipeline(p)).tokens(F.col("text")).alias("t")).orderBy("i").collect()
    return [r.t for r in rows]


def by_re(spec_, text):
    """The pipeline with Python's own regular expressions."""
    state = [text]
    for op in spec_.steps:
        a = op.args
        if op.name == "replace":
            state = [re.sub(a["pattern"], a["repl"], x) for x in state]
        elif op.name == "split":
            state = [y for x in state for y in re.split(f"({a['pattern']})" if a.get("keep") else a["pattern"], x) if y is not None]
        elif op.name == "strip":
            state = [x.strip(a.get("chars")) for x in state]
        elif op.name in ("filter", "retain"):
            test = re.fullmatch if a.get("match", "full") == "full" else re.search
            state = [x for x in state if bool(test(a["pattern"], x)) == (op.name == "retain")]
        elif op.name == "lower":
            state = [x.lower() for x in state]
        elif op.name == "stopwords":
            stops = set(spec_.stopwords) | set(a.get("words", ()))
            state = [x for x in state if x not in stops]
        elif op.name == "tokenize":
            if a["name"] != "RegexpTokenizer":
                return None
            state = [y for x in state for y in re.split(a["kwargs"]["pattern"], x) if y]
        elif op.name == "stem":
            keep = set(stop_list("english"))
            state = [x if x in keep else stem(x) for x in state]
    return [x for x in state if x]


TEXTS = [
    "Wow!!! Costs $12.50, it's 30% off...   sooooo good in 1999 ok",
    "Mail me@x-y.org or @someone_1; see comp.lang.misc and alt.folk   'quoted words' here",
    "Dr. Smith met Mrs. Jones. They left. J. Doe? Yes!! No... Well",
    "École à Paris: déjà 25 € — naïve  ß Straße\tx\ny", "", "   ", ":-) sad :( ;) a_b _c_", "1999's 2000 2001  5,000.25%", "$5 £7.5 ₤9 ¥ 100", "a\rb c d",
]


@pytest.mark.parametrize("name", builtin_names())
def test_shipped_pipelines_equal_python(spark, name):
    p = builtin(name)
    want = [by_re(p, t) for t in TEXTS]
    if want[0] is not None:
        assert tokens(spark, Pipeline(p), *TEXTS) == want


@pytest.mark.parametrize("name", ["intermediate_unigrams", "20_newsgroups", "multilingual_unigrams_remove_stopwords", "split_sentences", "unigrams_social_media"])
def test_documents_equal_python(spark, sf, name):
    p = builtin(name)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for r in docs.select("text", Pipeline(p).tokens(F.col("text")).alias("t")).collect():
        assert r.t == by_re(p, r.text)


def test_golden_chain(spark):
    got = tokens(spark, Pipeline(builtin("intermediate_unigrams_no_stopwords")), TEXTS[0])[0]
    assert " ".join(got) == "wow costs _currency_ it's _percent_ off soo good in _year_ ok"


def test_thirteen_pipelines():
    assert len(builtin_names()) == 13


def test_tweets(spark):
    p = Pipeline(builtin("multilingual_twitter_unigrams_keep_stopwords"))
    got = tokens(spark, p, "@bob check https://mail.google.com/x?y=1 sooooo cool :) #win on 12/31/2020 it's $5")[0]
    assert "@bob" not in got and "#win" in got and "soo" in got and ":)" in got and "<date>" in got and "it's" in got


def test_split_keeps_separators_and_groups(spark):
    assert tokens(spark, {"sequence": [step("split", pattern="[,;]", keep=True)]}, "a,b;c")[0] == ["a", ",", "b", ";", "c"]
    assert tokens(spark, {"sequence": [step("split", pattern="-(x)-")]}, "a-x-b")[0] == ["a", "x", "b"]
    assert tokens(spark, {"sequence": [step("split", pattern=r"\s+")]}, " a  b ")[0] == ["a", "b"]


def test_case_and_filters(spark):
    words = step("split", pattern=" ")
    assert tokens(spark, {"sequence": [words, step("upper", pattern="a.*")]}, "ab ba")[0] == ["AB", "ba"]
    assert tokens(spark, {"sequence": [words, step("upper", pattern="a.*", exclude=True)]}, "ab ba")[0] == ["ab", "BA"]
    assert tokens(spark, {"sequence": [words, step("filter", pattern="a", match="partial")]}, "ab c")[0] == ["c"]
    assert tokens(spark, {"sequence": [words, step("keep", pattern="a")]}, "ab a a\n")[0] == ["a"]
    assert tokens(spark, {"sequence": ["lower"]}, None)[0] is None


def test_names_have_synonyms(spark):
    a = {"operations": [{"function": "sub", "parameters": {"regex": "a", "replacement": "b"}}], "N-grams": {"Max Stopwords": 1}}
    b = {"sequence": [step("replace", pattern="a", repl="b")], "ngrams": {"max_stopwords": 1}}
    assert PipelineSpec.read(a) == PipelineSpec.read(b)
    for bad in ({"sequence": ["fly"]}, {}, {"sequence": ["replace"]}, {"sequence": [step("lower", what=1)]}, {"sequence": ["lower"], "ops": ["lower"]}):
        with pytest.raises(ValueError):
            PipelineSpec.read(bad)


def test_composition(spark):
    s = PipelineSpec.read({"sequence": ["lower"]})
    assert tokens(spark, Pipeline(s + PipelineSpec.read({"sequence": [step("split", pattern=" ")]})), "A B")[0] == ["a", "b"]
    assert tokens(spark, Pipeline(s.prepend(F.reverse).append(Op("upper"))), "ab")[0] == ["BA"]
    x = Pipeline({"sequence": ["lower", step("split", pattern=" ")]}).debug(spark.createDataFrame([("A B",)], "text string")).first()
    assert x.stage_0 == ["a b"] and x.stage_1 == ["a", "b"]


def test_files(tmp_path):
    (tmp_path / "a.yml").write_text("sequence: [lower]\nstopwords: my.stop\n")
    (tmp_path / "b.json").write_text('{"sequence": ["upper"], "stopwords": {"files": ["my.stop"], "words": ["x"]}}')
    (tmp_path / "c.py").write_text("sequence = []")
    (tmp_path / "my.stop").write_text("und\n oder \n\n")
    assert PipelineSpec.load(tmp_path / "a.yml").stopwords == ("und", "oder")
    assert set(PipelineSpec.load(tmp_path / "b.json").stopwords) == {"und", "oder", "x"}
    assert set(spec.read_config_dir(tmp_path)) == {"a", "b"}
    with pytest.raises(ValueError):
        spec.read_config(tmp_path / "c.py")
    assert PipelineSpec.read({"sequence": ["lower"], "stopwords": ["a"]}, stopwords=("b",)).stopwords == ("b",)


@pytest.mark.parametrize("p,r,text", [(r"(a)(b)", r"\2$\1", "xabx"), (r"[[&a]", "-", "a[&b"), (r"(?P<n>a)(?P=n)", r"\g<n>", "aa"), (r"a{,2}b", "_", "aab"), (r"x\Z", "!", "ax"), (r"\w+", "W", "Straße é1"), (r"a.b", "_", "a\rb a\nb"), (r"c", "\\\\n\\n", "abc")])
def test_translation(spark, p, r, text):
    got = spark.createDataFrame([(text,)], "t string").select(F.regexp_replace("t", F.lit(regexlate.pattern(p)), F.lit(regexlate.replacement(r)))).first()[0]
    assert got == re.sub(p, r, text)


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("running", "run"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("skies", "sky"), ("national", "nation"), ("happiness", "happi"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("knightly", "knight"), ("agreed", "agre"), ("vietnamization", "vietnam"), ("conformably", "conform"), ("succeeding", "succeed"), ("yelling", "yell"), ("by", "by"), ("consolation", "consol"), ("knack", "knack")])
def test_stems(word, want):
    assert stem(word) == want


def test_stop_lists_of_a_folder(spark, tmp_path):
    (tmp_path / "english.stop").write_text("alpha\n beta \n\n", encoding="utf-8")
    spec = builtin("intermediate_unigrams", tmp_path)
    assert set(spec.stopwords) == {"alpha", "beta"} and "the" in builtin("intermediate_unigrams").stopwords
    docs = spark.createDataFrame([("Alpha the beta gamma",)], "text string")
    assert docs.select(Pipeline(spec).tokens(F.col("text")).alias("t")).first().t == ["the", "gamma"]
    for k in ("spanish", "french", "arabic"):
        (tmp_path / f"{k}.stop").write_text(f"{k}\n", encoding="utf-8")
    words = next(s.args["words"] for s in builtin("multilingual_unigrams_remove_stopwords", tmp_path).steps if s.name == "stopwords")
    assert set(words) == {"alpha", "beta", "spanish", "french", "arabic", "_num_", "_percent_"}
