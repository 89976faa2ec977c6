"""A corpus as a small star of tables: tokens, postings, vocabulary, statistics."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut, spread, written
from ..functions import weighting
from ..plans.pipeline import Pipeline


class Corpus:
    """Documents under a pipeline.

    ``docs`` has unique ids; ``order`` (the id by default) is the order in which
    words are first seen.  The token lists and the postings are tokenised once, when
    something first needs them twice, and written to the shared folder; the other
    tables are plans, computed when used.  Nothing is collected but single numbers.
    """

    def __init__(self, docs: DataFrame, pipeline: Pipeline, *, doc_id: str = "doc_id", text: str = "text", order: str | None = None, ngrams: bool = False):
        self.docs, self.pipeline, self.doc_id, self.text = spread(docs), pipeline, doc_id, text
        self.order, self.with_ngrams = order or doc_id, ngrams

    @cached_property
    def token_lists(self) -> DataFrame:
        """(doc_id, seq, tokens)"""
        toks = self.pipeline.tokens(F.col(self.text))
        if self.with_ngrams:
            toks = self.pipeline.ngrams(toks)
        return self.docs.select(F.col(self.doc_id).alias("doc_id"), F.col(self.order).alias("seq"), toks.alias("tokens"))

    @cached_property
    def kept_lists(self) -> DataFrame:
        """The token lists, written."""
        return written(self.token_lists, "tokens")

    @cached_property
    def kept_postings(self) -> DataFrame:
        """The postings, written."""
        return written(self.postings, "postings")

    @cached_property
    def tokens(self) -> DataFrame:
        """(doc_id, seq, pos, token)"""
        return self.token_lists.select("doc_id", "seq", F.posexplode("tokens").alias("pos", "token"))

    @cached_property
    def postings(self) -> DataFrame:
        """(doc_id, token, cnt)"""
        return self.token_lists.select("doc_id", F.explode("tokens").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("cnt"))

    @cached_property
    def term_stats(self) -> DataFrame:
        """(token, ttf, df)"""
        p = self.__dict__.get("kept_postings", self.postings)
        return p.groupBy("token").agg(F.sum("cnt").alias("ttf"), F.count("*").alias("df"))

    @cached_property
    def stats(self) -> DataFrame:
        """(doc_count, total_tokens): one row."""
        return self.token_lists.agg(F.count("*").alias("doc_count"), F.coalesce(F.sum(F.size(F.coalesce("tokens", F.array().cast("array<string>")))), F.lit(0)).cast("long").alias("total_tokens"))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """(term_id, token, ttf, df): ids dense from 0 in order of first appearance."""
        # one pass: the first place and the count of each token in each document, then of each token
        t = self.tokens.groupBy("doc_id", "token").agg(F.min(F.struct("seq", "pos")).alias("first"), F.count("*").alias("cnt"))
        terms = t.groupBy("token").agg(F.min("first").alias("first"), F.sum("cnt").alias("ttf"), F.count("*").alias("df"))
        return dense_ids(terms.select("token", "first", "ttf", "df"), [F.col("first.seq"), F.col("first.pos")])

    @cached_property
    def ngram_stats(self) -> DataFrame:
        """(n, token, ttf, df): the pipeline's n-grams by their length, each length with statistics of its own."""
        d = self.docs.select(F.col(self.doc_id).alias("doc_id"), self.pipeline.tokens(F.col(self.text)).alias("tokens"))

        def of_length(n: int) -> Column:
            # a function of one argument: transform gives a second one the gram's place in the array
            return F.transform(self.pipeline.ngrams(F.col("tokens"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("token")))

        each = [of_length(n) for n in self.pipeline.spec.ngrams.n]
        p = d.select("doc_id", F.explode(F.concat(*each)).alias("x")).groupBy("doc_id", "x.n", "x.token").agg(F.count("*").alias("cnt"))
        return p.groupBy("n", "token").agg(F.sum("cnt").alias("ttf"), F.count("*").alias("df"))

    def ids(self) -> DataFrame:
        """(doc_id) of all documents."""
        return self.docs.select(F.col(self.doc_id).alias("doc_id"))

    def document(self, *ids) -> DataFrame:
        """(doc_id, seq, tokens) of the documents with these ids; unknown ids have no row."""
        return self.token_lists.where(F.col("doc_id").isin(list(ids)))

    def encoded(self) -> DataFrame:
        """(doc_id, pos, term_id)"""
        return encode(self.tokens, self.vocabulary)

    def tfidf(self, sublinear: bool = False, normalize: bool = True) -> DataFrame:
        return weighting.tfidf(self.kept_postings, self.term_stats.select("token", "df"), self.docs.select(F.count("*").alias("n")), sublinear=sublinear, normalize=normalize)

    def query(self, text: str, n: int) -> DataFrame:
        """The n documents nearest to a text: (doc_id, score), by score and then id. The text goes through the pipeline."""
        one = self.docs.sparkSession.createDataFrame([(text,)], "text string").select(F.lit(0).alias("query_id"), self.pipeline.tokens(F.col("text")).alias("tokens"))
        bags = one.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("cnt"))
        scores = weighting.rank(bags, self.kept_postings, self.term_stats.select("token", "df"), self.docs.select(F.count("*").alias("n")))
        all_docs = self.docs.select(F.col(self.doc_id).alias("doc_id"))
        return all_docs.join(scores.drop("query_id"), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc_id").limit(n)


def ranked(rows: DataFrame, order: list[Column], value: str | None = None, ties: list[Column] | None = None) -> DataFrame:
    """The rows with __rank, from 1 in ``order``, and with ``value`` also __run, its sum up to and with the row.

    Rows are ranked inside range partitions and shifted by what the partitions
    before hold, so no single task orders them all; ``order`` must leave no ties but
    those that ``ties`` settle, which needn't be sampled for the partitions.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("__part").orderBy(*order, *(ties or []))
    x = parts.withColumn("__rank", F.row_number().over(w).cast("long"))
    x = x.withColumn("__run", (F.sum(value) if value else F.sum(F.lit(0).cast("long"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = x.groupBy("__part").agg(F.max("__rank").alias("__size"), F.max_by("__run", "__rank").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    shift = ends.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("__size", "__shift"), ("__sum", "__base"))])
    out = x.join(F.broadcast(shift), F.col("__part") == F.col("__p"))
    more = [(F.col("__run") + F.col("__base")).alias("__run")] if value else []
    return out.select(*rows.columns, (F.col("__rank") + F.col("__shift")).cast("long").alias("__rank"), *more)


def dense_ids(terms: DataFrame, order: list[Column], ties: list[Column] | None = None) -> DataFrame:
    """``terms`` with term_id dense from 0 in ``order``."""
    names = [c for c in terms.columns if c != "first"]
    return ranked(terms, order, ties=ties).select((F.col("__rank") - 1).alias("term_id"), *names)


def reduce_ids(vocabulary: DataFrame) -> DataFrame:
    """(term_id, old_id, token, ttf, df): ids anew, by falling ttf and then old id."""
    return dense_ids(vocabulary.withColumnRenamed("term_id", "old_id"), [F.desc("ttf"), F.col("old_id")])


def drop_terms(vocabulary: DataFrame, gone: DataFrame) -> DataFrame:
    """The vocabulary without some tokens; the ids of the others stay, with gaps."""
    return vocabulary.join(gone.select("token").distinct(), "token", "left_anti")


def prune(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Postings of terms that the vocabulary still has. Corpus totals are kept as they were, by design."""
    return postings.join(vocabulary.select("token"), "token", "left_semi")


def encode(tokens: DataFrame, vocabulary: DataFrame, oov: str = "drop") -> DataFrame:
    """(doc_id, pos, term_id) of (doc_id, pos, token); unknown tokens are dropped, null or an error.

    A document's places of one token cross the shuffle as one row, so a token that
    is everywhere costs as many rows as documents have it, not as often as it comes.
    """
    how = "inner" if oov == "drop" else "left"
    places = tokens.groupBy("doc_id", "token").agg(F.collect_list("pos").alias("places"))
    out = places.join(vocabulary.select("token", "term_id"), "token", how).select("doc_id", F.explode("places").alias("pos"), "term_id")
    if oov == "error":
        out = out.withColumn("term_id", F.coalesce("term_id", F.raise_error(F.lit("token is not in the vocabulary")).cast("long")))
    return out


def decode(ids: DataFrame, vocabulary: DataFrame, filter_missing: bool = False) -> DataFrame:
    """(doc_id, pos, token) of (doc_id, pos, term_id); a document's places of one id cross the shuffle as one row."""
    places = ids.groupBy("doc_id", "term_id").agg(F.collect_list("pos").alias("places"))
    out = places.join(vocabulary.select("term_id", "token"), "term_id", "inner" if filter_missing else "left")
    return out.select("doc_id", F.explode("places").alias("pos"), "token")


def sequences(tokens: DataFrame, value: str = "token") -> DataFrame:
    """(doc_id, tokens) in order of position."""
    return tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("s")).select("doc_id", F.col(f"s.{value}").alias("tokens"))


def extreme_terms(terms: DataFrame, column: str, *, limit: float | None = None, count: int | None = None, high: bool = True, total: int | None = None) -> DataFrame:
    """Terms by a statistic.

    With ``limit``: those above it (strictly) if ``high``, else at most it; a
    limit below 1 is that part of ``total``, rounded down.  With ``count``: so many
    from the top or the bottom, ties by term id.
    """
    if (limit is None) == (count is None):
        raise ValueError("give limit or count")
    if limit is not None:
        if limit < 1:
            if total is None:
                raise ValueError("a proportion needs the total")
            limit = int(limit * total)
        return terms.where(F.col(column) > limit if high else F.col(column) <= limit)
    return terms.orderBy(F.desc(column) if high else F.col(column), "term_id").limit(count)


def head(dist: DataFrame, value: str, by: list[str], *, p: float = 1.0, n: int | None = None, eps: float | None = None) -> DataFrame:
    """The head of each distribution: eps takes values above eps of the sum; n the n largest with ties; p what is at or above the value where the rising cumulative sum passes (1-p) of the sum."""
    whole = Window.partitionBy(*by)
    if eps is not None:
        return dist.withColumn("__s", F.sum(value).over(whole)).where(F.col(value) > F.lit(eps) * F.col("__s")).drop("__s")
    if n is not None:
        return dist.withColumn("__r", F.rank().over(whole.orderBy(F.desc(value)))).where(F.col("__r") <= n).drop("__r")
    rising = dist.withColumn("__s", F.sum(value).over(whole)).withColumn("__c", F.sum(value).over(whole.orderBy(value)))
    over = F.col("__c") > (1 - p) * F.col("__s")
    return rising.withColumn("__cut", F.min(F.when(over, F.col(value))).over(whole)).where(F.col(value) >= F.col("__cut")).drop("__s", "__c", "__cut")
