"""Quality filter by perplexity under an interpolated modified Kneser-Ney model.

The model is of characters, ``ORDER`` at a time, one for each language, trained
on the texts of a trusted set, in whole.  Counting and estimation are Spark joins and
aggregations of n-gram keys, sharded by the key: counts of the highest order,
numbers of different characters to the left (continuation counts) below it, three
discounts for each language and order from the counts of counts, and from them

    P(c | h) = max(n(h c) - D(n), 0) / n(h .) + gamma(h) P(c | h without its first)

down to the uniform distribution over the language's characters.  An n-gram is
one 63-bit number: a language and five symbols of 11 bits.  Each language has
symbols of its own: one for each of the ``PLAIN`` commonest characters of its
trusted texts, counted over all of them, so every script is told apart; rarer
characters of alphabets larger than that share 63 by hash.  Languages are worked
on in groups of ``GROUP``, which is what a number has room for.

The perplexity of a text sums the estimates over all its characters.  A model of
up to ``MODEL_ROWS`` rows is broadcast as sorted arrays; a larger one is met by
joins on the n-gram keys of each text (`score_by_join`), with the same results.
A text is rejected if its perplexity is above the ``quantile`` of the held-out
trusted texts of its language, by ``slack``; those, one in ``HELD_OUT``, are not
trained on, as texts that were would look better than they are.  The perplexity of
a few characters says little, so a text of n characters has ``short`` / n more room,
and held-out ones count with their perplexity less that room.  A language with fewer
than ``FEW`` held-out texts takes the quantile over those of all languages.

Defined cases: null and empty texts, and texts of a language (or null) without
trusted text to train on (none, or all of it held out), have perplexity and threshold
null and are kept; if no trusted text is held out there is no threshold; a null doc_id is
scored, but cannot be trusted; repeated rows are counted and scored as often as they
come; rows that repeat an id in the trusted set count once; with no trusted text
at all nothing is judged; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, ship
from .textkit import buffers, mix, slices

ORDER, SYMBOL_BITS = 5, 11
#: Symbols for single characters; 0 begins a text, and 63 more are shared.
PLAIN = 1984
GROUP = 255
#: Of 28 bytes each while they are brought to the driver, so 112 MB at most.
MODEL_ROWS = 4_000_000
FEW = 20
BROADCAST_ROWS = 2_000_000
#: Every so-manieth trusted id, by hash, isn't trained on but sets the threshold.
HELD_OUT = 5
FLUSH = 6_000_000
_LANG_SHIFT = ORDER * SYMBOL_BITS
RESULT = ["doc_id", "lang", "n_chars_scored", "perplexity", "threshold", "keep"]


def mask(k: int) -> int:
    return (1 << (k * SYMBOL_BITS)) - 1


def points_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, and how many each text has."""
    raw, offsets = buffers(pc.utf8_lower(texts))
    before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64), np.diff(before[offsets])


def keys_of(texts: pa.Array, code: np.ndarray, symbols: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The key of the n-gram that ends at each character of the texts, without its language; characters of each text. ``code``: the texts' languages."""
    points, counts = points_of(texts)
    known, number = symbols
    own = (np.repeat(code.astype(np.uint64), counts) << np.uint64(21)) | points
    at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
    hit = known[at] == own if len(known) else np.zeros(len(own), bool)
    symbol = np.where(hit, number[at] if len(known) else 0, np.uint64(PLAIN) + mix(points) % np.uint64(63)).astype(np.uint64)
    # four begin symbols before each text
    pad = ORDER - 1
    n, rows = len(symbol), len(counts)
    place = np.arange(n) + pad * np.repeat(np.arange(1, rows + 1), counts)
    line = np.zeros(n + pad * (rows + 1), np.uint64)
    line[place] = symbol
    key = np.zeros(n, np.uint64)
    for back in range(pad, -1, -1):
        key = (key << np.uint64(SYMBOL_BITS)) | line[place - back]
    return key, counts


def _languages(trusted: DataFrame) -> list[str]:
    """The languages that have trusted text."""
    return sorted(r.lang for r in trusted.where("lang is not null").select("lang").distinct().collect())


def symbols_of(trusted: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbol table: at most ``PLAIN`` - 1 characters of each language, the commonest of all its trusted texts, ties by code point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pc.index_in(batch.column(0), value_set=pa.array(langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.uint64)
            for a, b in slices(batch.column(1)):
                points, counts = points_of(batch.column(1)[a:b])
                k, n = np.unique((np.repeat(code[a:b], counts) << np.uint64(21)) | points, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["key", "n"])

    rows = trusted.select("lang", F.col("text").alias("t")).where(F.col("lang").isin(langs) & F.col("t").isNotNull())
    counts = rows.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(F.shiftright("key", 21)).orderBy(F.desc("n"), "key"))
    top = counts.withColumn("r", rank).where(F.col("r") < PLAIN).select("key", "r").toPandas().sort_values("key")
    return top["key"].to_numpy().astype(np.uint64), top["r"].to_numpy().astype(np.uint64)


def _counter(langs: list[str], symbols: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, back = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(back, np.concatenate(counts), minlength=len(k)).astype(np.int64)

        for batch in batches:
            code = pc.index_in(batch.column(0), value_set=pa.array(langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.uint64)
            for a, b in slices(batch.column(1)):
                key, n = keys_of(batch.column(1)[a:b], code[a:b], symbols)
                k, c = np.unique(key | np.repeat(code[a:b] << np.uint64(_LANG_SHIFT), n), return_counts=True)
                keys.append(k), counts.append(c)
                if sum(map(len, keys)) > FLUSH:
                    k, c = merged()
                    keys, counts = [k], [c]
                    if len(k) > FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c)], names=["key", "n"])
                        keys, counts = [], []
        if keys:
            k, c = merged()
            for i in range(0, len(k), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + 500_000].astype(np.int64)), pa.array(c[i : i + 500_000])], names=["key", "n"])

    return run


def count_ngrams(trusted: DataFrame, langs: list[str], symbols: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, n): how often each n-gram of the highest order comes in the trusted rows (lang, text)."""
    rows = trusted.select("lang", F.col("text").alias("t")).where(F.col("lang").isin(langs) & F.col("t").isNotNull())
    return rows.mapInArrow(_counter(langs, symbols), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _lang(key: Column) -> Column:
    return F.shiftright(key, _LANG_SHIFT)


def estimate(counts: DataFrame) -> DataFrame:
    """Back-off model rows (k, key, logp, log_gamma): log_gamma is that of the n-gram as a context, null if it is none."""
    lang_bits = ((1 << 8) - 1) << _LANG_SHIFT
    levels: dict[int, DataFrame] = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts
        levels[k] = cut(levels[k + 1].groupBy(F.col("key").bitwiseAND(F.lit(lang_bits | mask(k))).alias("key")).agg(F.count("*").alias("n")))
    discounts = reduce(
        DataFrame.union,
        [
            levels[k].groupBy(_lang(F.col("key")).alias("lang"))
            .agg(F.lit(k).alias("k"), *[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)])
            .select("k", "lang", "n1", "n2", "n3", "n4")
            for k in levels
        ],
    )
    d: dict[int, dict[int, tuple[float, float, float]]] = {k: {} for k in levels}
    for r in discounts.collect():  # one row for each language and order
        d[r.k][r.lang] = discount(r.n1, r.n2, r.n3, r.n4)

    def of(k: int, i: int) -> Column:
        table = F.create_map(*[x for lang, v in sorted(d[k].items()) for x in (F.lit(lang), F.lit(v[i]))])
        return table[_lang(F.col("key")).cast("int")]

    size = levels[1].groupBy(_lang(F.col("key")).alias("lang")).count().collect()
    uniform = F.create_map(*[x for r in sorted(size) for x in (F.lit(r["lang"]), F.lit(1.0 / (r["count"] + 1)))])
    out, lower, gammas = [], None, {}
    for k in range(1, ORDER + 1):
        level = levels[k].withColumn("ctx", F.shiftright(F.col("key").bitwiseAND(F.lit(mask(k))), SYMBOL_BITS).bitwiseOR(F.col("key").bitwiseAND(F.lit(lang_bits))))
        cut_off = F.when(F.col("n") == 1, of(k, 0)).when(F.col("n") == 2, of(k, 1)).otherwise(of(k, 2))
        context = level.withColumn("off", cut_off).groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("off").alias("off_all"))
        context = context.withColumn("gamma", F.col("off_all") / F.col("total"))
        joined = level.join(context, "ctx").withColumn("own", F.greatest(F.col("n") - cut_off, F.lit(0.0)) / F.col("total"))
        if k == 1:
            p = joined.select("key", (F.col("own") + F.col("gamma") * uniform[_lang(F.col("key")).cast("int")]).alias("p"))
        else:
            suffix = joined.withColumn("suffix", F.col("key").bitwiseAND(F.lit(lang_bits | mask(k - 1))))
            below = lower.select(F.col("key").alias("suffix"), F.col("p").alias("p_low"))
            p = suffix.join(below, "suffix").select("key", (F.col("own") + F.col("gamma") * F.col("p_low")).alias("p"))
        lower = cut(p)
        gammas[k - 1] = context.select(F.col("ctx").alias("key"), F.log("gamma").alias("log_gamma"))
        out.append((k, lower))
    # a context of the full order minus one is an n-gram of that order or begins a text, so both sides are kept
    rows = []
    for k, p in [(0, None), *out]:
        left = None if p is None else p.select("key", F.log("p").alias("logp"))
        right = gammas.get(k)
        if left is None:
            both = right.withColumn("logp", F.log(uniform[_lang(F.col("key")).cast("int")]))
        elif right is None:
            both = left.withColumn("log_gamma", F.lit(None).cast("double"))
        else:
            both = left.join(right, "key", "full")
        rows.append(both.select(F.lit(k).alias("k"), "key", "logp", "log_gamma"))
    return cut(reduce(DataFrame.union, rows))


def discount(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the counts of counts; where those are too few, half a count."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(raw))


class Tables:
    """The model's rows as sorted arrays, by order."""

    def __init__(self, k: np.ndarray, key: np.ndarray, logp: np.ndarray, gamma: np.ndarray):
        self.levels = {}
        for o in range(ORDER + 1):
            at = np.flatnonzero(k == o)
            at = at[np.argsort(key[at])]
            self.levels[o] = key[at], logp[at].astype(np.float32), gamma[at].astype(np.float32)

    def look(self, o: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """logp and log gamma, NaN where the model has none."""
        keys, logp, gamma = self.levels[o]
        if not len(keys):
            return np.full(len(key), np.nan, np.float32), np.full(len(key), np.nan, np.float32)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        return np.where(hit, logp[at], np.nan), np.where(hit, gamma[at], np.nan)

    def log_prob(self, key: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each full-order key (with its language)."""
        lang = key & ~np.int64(mask(ORDER))
        out = np.zeros(len(key))
        todo = np.arange(len(key))
        for o in range(ORDER, -1, -1):
            own = key[todo] & np.int64(mask(o)) | lang[todo]
            p, _ = self.look(o, own)
            seen = ~np.isnan(p) if o else np.ones(len(todo), bool)
            out[todo[seen]] += p[seen]
            todo, own = todo[~seen], own[~seen]
            if not len(todo):
                break
            _, g = self.look(o - 1, ((key[todo] & np.int64(mask(o))) >> np.int64(SYMBOL_BITS)) | lang[todo])
            out[todo] += np.nan_to_num(g)
        return out


def _scorer(langs: list[str], symbols: tuple[np.ndarray, np.ndarray], held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pc.fill_null(pc.index_in(batch.column(1), value_set=pa.array(langs, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(batch.column(2)):
                texts, c = batch.column(2)[a:b], code[a:b]
                if (c < 0).any():
                    texts = texts.take(pa.array(np.arange(len(c)), mask=c < 0))
                key, n = keys_of(texts, np.maximum(c, 0), symbols)
                uniq, back = np.unique(key.astype(np.int64) | (np.repeat(c, n) << _LANG_SHIFT), return_inverse=True)
                total = np.bincount(np.repeat(np.arange(b - a), n), held.value.log_prob(uniq)[back] if len(uniq) else None, minlength=b - a)
                ppl = np.exp(-total / np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n.astype(np.int64)), pa.array(ppl, mask=n == 0)], names=["doc_id", "lang", "n_chars_scored", "perplexity"])

    return run


def score_by_broadcast(docs: DataFrame, model: DataFrame, langs: list[str], symbols: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    t = model.toArrow()
    col = lambda c: t[c].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(Tables(col("k"), col("key"), col("logp").astype(float), col("log_gamma").astype(float)))
    d = docs.select(F.col("doc_id"), F.col("lang"), F.col("text").alias("t"))
    return d.mapInArrow(_scorer(langs, symbols, held), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang string, n_chars_scored long, perplexity double")


def score_by_join(docs: DataFrame, model: DataFrame, langs: list[str], symbols: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The same by joins on the keys, sharded as any join; no side is broadcast or held in memory."""
    lang_bits = ((1 << 8) - 1) << _LANG_SHIFT
    d = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("lang"), F.col("text").alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = pc.index_in(batch.column(1), value_set=pa.array(langs, pa.string())).to_numpy(zero_copy_only=False).astype(np.uint64)
            for a, b in slices(batch.column(2)):
                key, n = keys_of(batch.column(2)[a:b], code[a:b], symbols)
                key |= np.repeat(code[a:b] << np.uint64(_LANG_SHIFT), n)
                rows = np.repeat(np.arange(b - a), n)
                order = np.lexsort((key, rows))
                key, rows = key[order], rows[order]
                head = np.ones(len(key), bool)
                head[1:] = (key[1:] != key[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(head)
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(rows[at])), pa.array(key[at].astype(np.int64)), pa.array(np.diff(np.append(at, len(key))))], names=["row", "key", "n"])

    w = d.where(F.col("lang").isin(langs) & F.col("t").isNotNull()).select("row", "lang", "t").mapInArrow(run, "row long, key long, n long")
    w = w.withColumn("logp", F.lit(None).cast("double")).withColumn("back", F.lit(0.0))
    for o in range(ORDER, -1, -1):
        grams = model.where(F.col("k") == o).select(F.col("key").alias("g"), F.col("logp").alias("lp"))
        w = w.join(grams, F.col("key").bitwiseAND(F.lit(lang_bits | mask(o))) == F.col("g"), "left")
        w = w.withColumn("logp", F.coalesce("logp", F.col("lp") + F.col("back"))).drop("g", "lp")
        if o:
            ctx = model.where(F.col("k") == o - 1).select(F.col("key").alias("g"), F.col("log_gamma").alias("lg"))
            here = F.shiftright(F.col("key").bitwiseAND(F.lit(mask(o))), SYMBOL_BITS).bitwiseOR(F.col("key").bitwiseAND(F.lit(lang_bits)))
            w = w.join(ctx, here == F.col("g"), "left").withColumn("back", F.col("back") + F.coalesce("lg", F.lit(0.0))).drop("g", "lg")
    total = w.groupBy("row").agg(F.sum("n").alias("n_chars_scored"), F.sum(F.col("n") * F.col("logp")).alias("total"))
    return d.join(total, "row", "left").select("doc_id", "lang", F.coalesce("n_chars_scored", F.lit(0)).cast("long").alias("n_chars_scored"), F.exp(-F.col("total") / F.col("n_chars_scored")).alias("perplexity"))


def _trusted(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    ids = trusted_ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct()
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(side, docs["doc_id"] == F.col("__id"), "left_semi")


def classify(docs: DataFrame, trusted_ids: DataFrame, *, quantile: float = 0.995, slack: float = 1.1, short: float = 10.0, by_join: bool | None = None) -> DataFrame:
    """(doc_id, lang, n_chars_scored, perplexity, threshold, keep) for every row of docs (doc_id, lang, text).

    ``trusted_ids``: rows with the doc_id of trusted texts.
    """
    ship(docs.sparkSession)
    d = docs.select("doc_id", "lang", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    trained = _trusted(d, trusted_ids).where(~held)
    langs = _languages(trained.where("text is not null and text <> ''"))
    unknown = d.where(F.col("lang").isNull() | ~F.col("lang").isin(langs)).selectExpr("doc_id", "lang", "0L as n_chars_scored", "cast(null as double) as perplexity")
    parts = [unknown]
    for i in range(0, len(langs), GROUP):
        group = langs[i : i + GROUP]
        symbols = symbols_of(trained, group)
        model = estimate(cut(count_ngrams(trained, group, symbols)))
        join = model.count() > MODEL_ROWS if by_join is None else by_join
        parts.append((score_by_join if join else score_by_broadcast)(d.where(F.col("lang").isin(group)), model, group, symbols))
    scored = cut(reduce(DataFrame.union, parts))
    room = F.lit(float(short)) / F.greatest("n_chars_scored", F.lit(1))
    judged = _trusted(scored.where(held), trusted_ids).where("perplexity is not null").withColumn("known", F.col("perplexity") * slack / (slack + room))
    limit = lambda: F.percentile_approx("known", quantile, 100_000)
    limits = judged.groupBy(F.col("lang").alias("__lang")).agg(F.when(F.count("*") >= FEW, limit()).alias("__limit"))
    pooled = judged.agg(limit().alias("__pooled"))  # one row
    out = scored.join(F.broadcast(limits), scored["lang"] == F.col("__lang"), "left").crossJoin(F.broadcast(pooled))
    out = out.withColumn("threshold", F.when(F.col("perplexity").isNotNull(), F.coalesce("__limit", "__pooled") * (slack + room)))
    return out.select(F.col("doc_id").cast(kind), "lang", "n_chars_scored", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))
