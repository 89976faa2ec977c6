"""What queries and their SQL share: tables, the plain token chain, and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import Corpus
from ..plans import Pipeline, stop_list
from ..plans.shipped import step

PLAIN = {"sequence": ["lower", step("replace", pattern="[^a-z]", repl=" "), step("split", pattern=r"\s+")]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, name: str = "documents", doc_id: str = "doc_id") -> Corpus:
    return Corpus(table(spark, sf_dir, name), Pipeline(PLAIN), doc_id=doc_id)


def tokens_sql(column: str = "text") -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({column}), '[^a-z]', ' ', 'g'), '\s+'), lambda x: x <> '')"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def ctes(source: str = "documents", doc_id: str = "doc_id") -> str:
    """d: token lists; t: tokens by position; p: postings; v: term statistics; n: documents."""
    return f"""with d as (select {doc_id} as doc_id, {tokens_sql()} as toks from {source}),
t as (select doc_id, unnest(toks) as token, generate_subscripts(toks, 1) - 1 as pos from d),
p as (select doc_id, token, count(*) as cnt from t group by all),
v as (select token, cast(sum(cnt) as bigint) as ttf, count(*) as df from p group by token),
n as (select count(*) as n from {source})
"""


ENGLISH = stop_list("english")
#: Pairs that the collocation query joins.
PAIRS = [("of", "the"), ("in", "the"), ("to", "the"), ("the", "and"), ("and", "the"), ("de", "la"), ("the", "of")]


def six(c):
    return F.round(c, 6)
