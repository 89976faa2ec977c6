"""N-gram windows over arrays of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import NgramSpec

BROADCAST_ROWS = 500_000


def windows(tokens: Column, n: int, start: str | None = None, end: str | None = None, head: bool = False) -> Column:
    """Array of the contiguous n-windows, as arrays; none if there are fewer than n tokens.

    ``start`` puts (start, t1 .. t(n-1)) before them and ``end`` the mirror image
    after them (for n = 1 the pad itself); ``head`` puts the prefixes of one to
    n-1 tokens before them.
    """
    inner = F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))
    long_enough = F.size(tokens) >= n - 1
    parts = []
    if head and n > 1:
        parts += [F.when(F.size(tokens) >= k, F.array(F.slice(tokens, 1, k))).otherwise(F.array().cast("array<array<string>>")) for k in range(1, n)]
    if start is not None:
        parts.append(F.when(long_enough, F.array(F.concat(F.array(F.lit(start)), F.slice(tokens, 1, n - 1)) if n > 1 else F.array(F.lit(start)))).otherwise(F.array().cast("array<array<string>>")))
    parts.append(inner)
    if end is not None:
        tail = F.concat(F.slice(tokens, F.size(tokens) - (n - 2), n - 1), F.array(F.lit(end))) if n > 1 else F.array(F.lit(end))
        parts.append(F.when(long_enough, F.array(tail)).otherwise(F.array().cast("array<array<string>>")))
    return F.concat(*parts) if len(parts) > 1 else inner


def char_windows(text: Column, n: int) -> Column:
    """Array of the n-character substrings."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def stop_limited(grams: Column, n: int, stopwords: tuple[str, ...], most: int | None, proportion: float | None) -> Column:
    """The windows with at most min(most, int(proportion * n)) stop words; pads are none."""
    limits = [x for x in (most, None if proportion is None else int(proportion * n)) if x is not None]
    if not limits or min(limits) >= n or not stopwords:
        return grams
    words = list(stopwords)
    return F.filter(grams, lambda g: F.size(F.filter(g, lambda x: x.isin(words))) <= min(limits))


def joined(grams: Column, joiner: str | None) -> Column:
    return grams if joiner is None else F.transform(grams, lambda g: F.array_join(g, joiner))


def ngrams(tokens: Column, spec: NgramSpec, stopwords: tuple[str, ...] = (), legacy_padding: bool = False) -> Column:
    """All lengths of ``spec``, one after the other.

    Pads are put in whenever set; with ``legacy_padding`` only where the limit on
    stop words can bind.
    """
    if spec.stem:
        from ..functions.stem import stemmed

        tokens = stemmed(tokens)
    parts = []
    for n in spec.n:
        limits = [x for x in (spec.max_stopwords, None if spec.proportion is None else int(spec.proportion * n)) if x is not None]
        binds = bool(limits) and min(limits) < n
        pad = binds or not legacy_padding
        grams = windows(tokens, n, spec.start if pad else None, spec.end if pad else None)
        parts.append(joined(stop_limited(grams, n, stopwords, spec.max_stopwords, spec.proportion), spec.join))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def rolling_sum(df: DataFrame, value: str, n: int, by: list[str], order: list[str]) -> DataFrame:
    """Sums of ``n`` values in a row, at the last of them; rows with fewer before them are left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = w.rowsBetween(-(n - 1), 0)
    return df.withColumn("__k", F.row_number().over(w)).withColumn("roll_sum", F.sum(value).over(rows)).where(F.col("__k") >= n).drop("__k")


def join_collocations(tokens: DataFrame, bigrams: DataFrame, joiner: str = "_") -> DataFrame:
    """(doc_id, pos, token): neighbours that are a pair in ``bigrams(first, second)`` become one token, in chains a_b_c.

    ``tokens``: (doc_id, pos, token).  Where a pair isn't in the set a new token
    begins; tokens of a group are joined in order.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = tokens.select("doc_id", "pos", "token", F.lag("token").over(w).alias("before"))
    b = bigrams.select(F.col("first").alias("b1"), F.col("second").alias("b2"), F.lit(1).alias("hit")).distinct()
    if b.count() <= BROADCAST_ROWS:  # else tokens as common as "the" meet their pairs by a shuffle
        b = F.broadcast(b)
    t = t.join(b, (F.col("before") == F.col("b1")) & (F.col("token") == F.col("b2")), "left")
    t = t.withColumn("part", F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = t.groupBy("doc_id", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("ts"))
    return grouped.select("doc_id", (F.col("part") - 1).cast("int").alias("pos"), F.array_join(F.col("ts.token"), joiner).alias("token"))
