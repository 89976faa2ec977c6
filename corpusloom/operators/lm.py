"""N-gram language models as prefix tables.

The trie of a corpus is one table (n, context, token, total): a node for each
n-gram, with the array of its first n-1 tokens.  Aggregates are made at full depth
first and rolled up, so a token is counted once for each full n-gram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import written
from .ngrams import BROADCAST_ROWS, windows


def ngram_counts(token_lists: DataFrame, depth: int, tokens: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """(by.., n, context, token, total): nodes of the trie of all ``depth``-grams.

    Every full n-gram counts once at each of its prefixes.  A document shorter
    than ``depth`` counts its proper prefixes, but not its last token.
    """
    by = by or []
    t = F.col(tokens)
    full = token_lists.select(*by, F.explode(windows(t, depth)).alias("g"))
    short = token_lists.where((F.size(t) < depth) & (F.size(t) > 1)).select(*by, F.slice(t, 1, F.size(t) - 1).alias("g"))
    counts = full.union(short).groupBy(*by, "g").agg(F.count("*").alias("total"))
    nodes = counts.select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.size("g")), lambda i: F.slice("g", 1, i))).alias("g"), "total")
    rolled = nodes.groupBy(*by, "g").agg(F.sum("total").alias("total"))
    return rolled.select(*by, F.size("g").alias("n"), F.slice("g", 1, F.size("g") - 1).alias("context"), F.element_at("g", -1).alias("token"), "total")


def all_ngrams(token_lists: DataFrame, depth: int, tokens: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """(by.., n, context, token, total): every n-gram of 1 to ``depth`` tokens where it stands, so the ends of documents count too.

    Each place counts once, with the tokens from it on, and the shorter n-grams are
    rolled up from these counts.
    """
    by = by or []
    t = F.col(tokens)
    # neighbours are zipped, not cut out by a function on each place, which Spark would interpret; so is what is left of the
    # row, as beside an exploded array the whole of it would be copied for each token
    left = F.when(F.size(t) > 0, F.sequence(F.size(t), F.lit(1), F.lit(-1))).alias("left")
    ahead = F.arrays_zip(left, *[F.slice(t, k + 1, F.size(t)).alias(str(k)) for k in range(depth)])
    at = token_lists.select(*by, F.explode(ahead).alias("__z"))
    g = F.slice(F.array(*[F.col("__z").getField(str(k)) for k in range(depth)]), 1, F.least(F.col("__z.left"), F.lit(depth)))
    counts = at.select(*by, g.alias("g")).groupBy(*by, "g").agg(F.count("*").alias("total"))
    if depth > 1:
        # asked beside the total, so that it stays above the counts and both parts read one shuffle
        whole = counts.where(F.col("total") >= F.when(F.size("g") == depth, 0))
        cut = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("g"), F.lit(depth - 1))), lambda k: F.slice("g", 1, k)))
        counts = whole.unionByName(counts.select(*by, cut.alias("g"), "total").groupBy(*by, "g").agg(F.sum("total").alias("total")))
    return counts.select(*by, F.size("g").alias("n"), F.slice("g", 1, F.size("g") - 1).alias("context"), F.element_at("g", -1).alias("token"), "total")


def train(token_lists: DataFrame, depth: int, tokens: str = "tokens", by: list[str] | None = None) -> DataFrame:
    """The table of `all_ngrams`, written to the shared folder: estimates read it several times, the texts once."""
    return written(all_ngrams(token_lists, depth, tokens, by), "ngrams")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = ["n", "context", "token"]
    return a.select(*keys, "total").unionByName(b.select(*keys, "total")).groupBy(*keys).agg(F.sum("total").alias("total"))


def prefix_totals(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by.., n, context, total, distinct_next): what stands below each context; n is the length of the n-grams."""
    return counts.groupBy(*(by or []), "n", "context").agg(F.sum("total").alias("total"), F.count("*").alias("distinct_next"))


def distinct_below(counts: DataFrame, depth: int) -> DataFrame:
    """(n, prefix, distinct_ngrams): full-depth n-grams below each node; 1 at a leaf."""
    leaf = counts.where(F.col("n") == depth).select(F.concat("context", F.array("token")).alias("g"))
    up = leaf.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("g")), lambda i: F.slice("g", 1, i))).alias("prefix"))
    return up.groupBy("prefix").agg(F.count("*").alias("distinct_ngrams")).select(F.size("prefix").alias("n"), "prefix", "distinct_ngrams")


def left_contexts(counts: DataFrame, depth: int) -> DataFrame:
    """(suffix, contexts): for every suffix of full-depth n-grams, how many different left contexts it has."""
    leaf = counts.where(F.col("n") == depth).select(F.concat("context", F.array("token")).alias("g"))
    cuts = leaf.select("g", F.explode(F.sequence(F.lit(1), F.lit(depth - 1))).alias("k"))
    s = cuts.select(F.expr("slice(g, size(g) - k + 1, k)").alias("suffix"), F.expr("slice(g, 1, size(g) - k)").alias("left"))
    return s.groupBy("suffix").agg(F.count_distinct("left").alias("contexts"))


def reversed_counts(counts: DataFrame) -> DataFrame:
    """The table read from right to left: (n, first, rest, total), rest nearest token first."""
    g = F.reverse(F.concat("context", F.array("token")))
    return counts.select("n", g[0].alias("first"), F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))).alias("rest"), "total")


# Smoothing. Each takes the n-grams to judge, (context, token) with contexts of up to n-1 tokens, and the counts of `all_ngrams`.


def _lengths(grams: DataFrame) -> DataFrame:
    return grams.select("context", "token").distinct()


def _kept(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The counts that ``wanted`` asks for, read where they lie, if these are few."""
    wanted = wanted.select(*keys).distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return counts.join(F.broadcast(wanted), keys, "left_semi") if few else counts


def _counted(grams: DataFrame, counts: DataFrame) -> DataFrame:
    c = _kept(counts, grams, ["context", "token"]).select("context", "token", F.col("total").alias("c"))
    totals = _kept(counts, grams, ["context"]).groupBy("context").agg(F.sum("total").alias("ct"), F.count("*").alias("kinds"))
    return grams.join(c, ["context", "token"], "left").join(totals, "context", "left").select(*grams.columns, F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("ct", F.lit(0)).alias("ct"), F.coalesce("kinds", F.lit(0)).alias("kinds"))


def node(counts: DataFrame, *gram: str) -> DataFrame:
    """(n, context, token, total, distinct_next, total_next) of one n-gram, no row if it was never seen: its count, and what stands below it."""
    context = F.array(*[F.lit(t) for t in gram]).cast("array<string>")
    own = counts.where((F.col("n") == len(gram)) & (F.col("context") == F.slice(context, 1, len(gram) - 1) if len(gram) > 1 else F.size("context") == 0) & (F.col("token") == gram[-1]))
    below = counts.where((F.col("n") == len(gram) + 1) & (F.col("context") == context)).agg(F.count("*").alias("distinct_next"), F.coalesce(F.sum("total"), F.lit(0)).alias("total_next"))
    return own.select("n", "context", "token", "total").crossJoin(below)  # one row each


def vocabulary_size(counts: DataFrame) -> DataFrame:
    return counts.where("n = 1").agg(F.count("*").alias("v"))


def additive(grams: DataFrame, counts: DataFrame, delta: float = 0.1, new_tokens: int = 0) -> DataFrame:
    """(context, token, p): (c + delta) / (c(context) + V delta)."""
    v = vocabulary_size(counts)
    x = _counted(_lengths(grams), counts).crossJoin(F.broadcast(v))
    return x.select("context", "token", ((F.col("c") + delta) / (F.col("ct") + (F.col("v") + new_tokens) * delta)).alias("p"))


def _chain(grams: DataFrame) -> DataFrame:
    """Each n-gram with all its suffixes: (context, token, k, ctx), k the order."""
    g = _lengths(grams)
    ks = F.explode(F.sequence(F.lit(1), F.size("context") + 1)).alias("k")
    return g.select("context", "token", ks).withColumn("ctx", F.expr("slice(context, size(context) - k + 2, k - 1)"))


def _chained(grams: DataFrame, counts: DataFrame) -> DataFrame:
    chain = _chain(grams)
    own = _counted(chain.select(F.col("ctx").alias("context"), "token").distinct(), counts)
    return chain.join(own.select(F.col("context").alias("ctx"), "token", "c", "ct", "kinds"), ["ctx", "token"])


def _folded(chained: DataFrame) -> DataFrame:
    """p by folding own + back * p from the shortest suffix up; the suffixes of an n-gram are few."""
    one = chained.groupBy("context", "token").agg(F.sort_array(F.collect_list(F.struct("k", "own", "back"))).alias("s"), F.max("base").alias("base"))
    return one.select("context", "token", F.aggregate("s", F.col("base"), lambda p, e: e["own"] + e["back"] * p).alias("p"))


def interpolated(grams: DataFrame, counts: DataFrame, lam: float = 0.1, proper: bool = False, new_tokens: int = 0) -> DataFrame:
    """(context, token, p): (1-lam) c/c(context) + lam P(suffix), recursively.

    Below the unigram stands 1, or with ``proper`` 1/V.  An unseen context gives
    (1-lam)/V as its own part.
    """
    v = vocabulary_size(counts)
    x = _chained(grams, counts).crossJoin(F.broadcast(v))
    own = F.when(F.col("ct") > 0, (1 - lam) * F.col("c") / F.when(F.col("ct") > 0, F.col("ct"))).otherwise((1 - lam) / F.col("v"))
    base = 1 / (F.col("v") + new_tokens) if proper else F.lit(1.0)
    return _folded(x.withColumn("own", own.cast("double")).withColumn("back", F.lit(float(lam))).withColumn("base", base.cast("double")))


def absolute_discount(grams: DataFrame, counts: DataFrame, delta: float = 0.1, new_tokens: int = 0) -> DataFrame:
    """(context, token, p): max(c-delta, 0)/N + delta kinds/N P(suffix), over 1/V; an unseen context leaves all to its suffix."""
    v = vocabulary_size(counts)
    x = _chained(grams, counts).crossJoin(F.broadcast(v))
    n = F.when(F.col("ct") > 0, F.col("ct"))
    own = F.coalesce(F.greatest(F.col("c") - delta, F.lit(0.0)) / n, F.lit(0.0))
    back = F.coalesce(delta * F.col("kinds") / n, F.lit(1.0))
    return _folded(x.withColumn("own", own.cast("double")).withColumn("back", back.cast("double")).withColumn("base", 1.0 / (F.col("v") + new_tokens)))


def kneser_ney(grams: DataFrame, counts: DataFrame, delta: float = 0.75, new_tokens: int = 0) -> DataFrame:
    """(context, token, p): interpolated Kneser-Ney with one discount; orders below an n-gram's own use continuation counts, and below those stands 1 / (V + new_tokens)."""
    longer = counts.where("n > 1").select(F.expr("slice(concat(context, array(token)), 2, n - 1)").alias("g"))
    cont = longer.groupBy("g").agg(F.count("*").alias("total")).select(F.size("g").alias("n"), F.expr("slice(g, 1, size(g) - 1)").alias("context"), F.element_at("g", -1).alias("token"), "total")
    chain = _chain(grams)
    top = chain.where(F.col("k") == F.size("context") + 1)
    low = chain.where(F.col("k") <= F.size("context"))

    def own(part: DataFrame, table: DataFrame) -> DataFrame:
        c = _counted(part.select(F.col("ctx").alias("context"), "token").distinct(), table)
        return part.join(c.select(F.col("context").alias("ctx"), "token", "c", "ct", "kinds"), ["ctx", "token"])

    x = own(top, counts).unionByName(own(low, cont)).crossJoin(F.broadcast(vocabulary_size(counts)))
    n = F.when(F.col("ct") > 0, F.col("ct"))
    mine = F.coalesce(F.greatest(F.col("c") - delta, F.lit(0.0)) / n, F.lit(0.0))
    back = F.coalesce(delta * F.col("kinds") / n, F.lit(1.0))
    return _folded(x.withColumn("own", mine.cast("double")).withColumn("back", back.cast("double")).withColumn("base", 1.0 / (F.col("v") + new_tokens)))


SMOOTHING = {"additive": additive, "laplace": lambda g, c, **k: additive(g, c, delta=k.pop("delta", 1.0), **k), "linear interpolation": interpolated, "absolute discount": absolute_discount, "kneser ney": kneser_ney}


def positions(token_lists: DataFrame, n: int, by: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(by, pos, context, token): each token with up to n-1 before it."""
    t = F.col(tokens)
    # only what a place needs goes with it: beside an exploded array the whole of it would be copied for each token
    back = [F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), k), t), 1, F.size(t)) for k in range(n - 1, -1, -1)]
    x = token_lists.select(by, F.posexplode(F.arrays_zip(*[c.alias(str(k)) for k, c in enumerate(back)])).alias("pos", "__z"))
    held = F.least(F.col("pos"), F.lit(n - 1))
    before = F.array(*[F.col("__z").getField(str(k)) for k in range(n - 1)]).cast("array<string>")
    context = F.slice(before, n - held, held) if n > 1 else before
    return x.select(by, "pos", context.alias("context"), F.col("__z").getField(str(n - 1)).alias("token"))


def log_prob(token_lists: DataFrame, counts: DataFrame, n: int, smoothing: str = "additive", by: str = "doc_id", **params) -> DataFrame:
    """(by, n_tokens, logp, perplexity) of each token list; perplexity is exp(-logp / n_tokens)."""
    pos = positions(token_lists, n, by)
    p = SMOOTHING[smoothing](pos, counts, **params)
    x = pos.join(p, ["context", "token"]).groupBy(by).agg(F.count("*").alias("n_tokens"), F.sum(F.log("p")).alias("logp"))
    return x.withColumn("perplexity", F.exp(-F.col("logp") / F.col("n_tokens")))


def top_tokens(contexts: DataFrame, counts: DataFrame, k: int = 10, smoothing: str = "additive", **params) -> DataFrame:
    """(context, rank, token, p): the k likeliest next tokens of each context, over the whole vocabulary; ties by token."""
    wanted = contexts.select("context").distinct()
    # What was seen after the context or a suffix of it, and the k words that lead the lowest order: any other word has k before it.
    # Additive smoothing has no lower order; its unseen words are alike and go by token, and fewer than k of the first 2k were seen where one is needed.
    tails = wanted.where(F.size("context") > 0).select("context", F.explode(F.transform(F.sequence(F.lit(1), F.size("context")), lambda i: F.slice("context", i, F.size("context")))).alias("tail"))
    after = _kept(counts, tails.select(F.col("tail").alias("context")), ["context"])
    seen = tails.join(after.select(F.col("context").alias("tail"), "token"), "tail").select("context", "token")
    words = counts.where("n = 1").select("token", "total")
    before = counts.where("n = 2").groupBy("token").agg(F.count("*").alias("total"))
    lead = reduce(DataFrame.union, [words.orderBy(F.desc("total"), "token").limit(k), before.orderBy(F.desc("total"), "token").limit(k), words.orderBy("token").limit(2 * k)])
    grams = seen.union(wanted.crossJoin(F.broadcast(lead.select("token")))).distinct()
    p = SMOOTHING[smoothing](grams, counts, **params)
    w = Window.partitionBy("context").orderBy(F.desc("p"), "token")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("context", "rank", "token", "p")


def cumulative(counts: DataFrame) -> DataFrame:
    """(n, context, token, low, high): shares of each context's total, laid end to end in order of token, for inverse sampling."""
    w = Window.partitionBy("n", "context").orderBy("token").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("n", "context")
    x = counts.withColumn("high", F.sum("total").over(w) / F.sum("total").over(total))
    return x.select("n", "context", "token", (F.col("high") - F.col("total") / F.sum("total").over(total)).alias("low"), "high")


def generate(counts: DataFrame, n: int, texts: int, max_length: int = 30, seed: int = 0, begin: list[str] | None = None, end: str | None = None) -> DataFrame:
    """(text_id, tokens): sampled texts.

    All texts grow by one token a round, each by a join with the shares of its
    context and a draw by hash of (seed, text, position); one without successors
    backs off to the suffix that has some.
    """
    from ..checkpoints import cut

    spark = counts.sparkSession
    shares = cut(cumulative(counts)).select("context", "token", "low", "high")
    first = F.array(*[F.lit(t) for t in begin or []]).cast("array<string>")
    state = spark.range(texts).select(F.col("id").alias("text_id"), first.alias("tokens"), F.lit(False).alias("done"))
    known = shares.select(F.col("context").alias("known")).distinct()
    for step in range(max_length - len(begin or [])):
        draw = F.pmod(F.xxhash64(F.lit(seed), "text_id", F.lit(step)), F.lit(1 << 30)) / float(1 << 30)
        tries = state.where("not done").select("text_id", "tokens", draw.alias("u"), F.explode(F.sequence(F.lit(0), F.least(F.size("tokens"), F.lit(n - 1)))).alias("k"))
        tries = tries.withColumn("known", F.expr("slice(tokens, size(tokens) - k + 1, k)"))
        best = tries.join(known, "known").groupBy("text_id", "tokens", "u").agg(F.max_by("known", "k").alias("context"))
        nxt = best.join(shares, "context").where("u >= low and u < high").groupBy("text_id").agg(F.min("token").alias("next"))
        state = state.join(nxt, "text_id", "left").select(
            "text_id", F.when(F.col("next").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array("next"))).alias("tokens"),
            (F.col("done") | F.col("next").isNull() | F.coalesce(F.col("next") == F.lit(end), F.lit(False))).alias("done"),
        )
        if step % 5 == 4:
            state = cut(state)
    return state.select("text_id", "tokens")
