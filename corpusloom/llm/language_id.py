"""Language identification by a linear-chain conditional random field over words.

Every word gets a label by forward-backward over the whole text, so that
code-switched text is split where its language changes.  Features of a word:
its prefixes and suffixes of one, two, three and four bytes of UTF-8, all its byte
bigrams and trigrams, and whether the lexicon of each language has it.  Transitions
are learned.  All languages that have labelled text are told apart, however many.

The chain is evaluated in blocks of ``BLOCK`` words: block transfer matrices
first, then the blocks of a text in order, then inside all blocks at once.
That is the exact forward-backward, at a cost in proportion to the words, with
a text of a million words as cheap a word as a text of ten.

A text is rejected if no language has enough of its words or the posteriors are
low, if too few of its words' features were seen in training, as in a script or
language that the model doesn't know, or if less than ``min_text`` of it is words.
That last limit is off unless asked for: a text full of symbols whose words are of
a known language has been identified, and is not this operator's to judge.

Defined cases: a null, empty or word-less text has lang null, confidence 0, no
spans, and is rejected; a null or repeated id, and repeated rows, are judged row
by row; an empty table gives an empty result; other columns are never read; repeated
labelled texts are trained on once.  Without any labelled text with words there is no
model: every text has lang null and no spans, and those with words are accepted,
as nothing speaks against them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .session import ship
from .textkit import Words, mix, slices

BLOCK = 32
TRI, AFFIX = 1 << 17, 1 << 16
RESULT = "lang string, share double, confidence double, coverage double, n_words long, accepted boolean, spans array<struct<start:int,n:int,lang:string>>"


@dataclass
class Model:
    """Weights of the features and which were seen in training, the transitions, and the lexicon as word hashes with a row of which languages have the word."""

    langs: list[str]
    weights: np.ndarray
    seen: np.ndarray
    lexicon: np.ndarray
    lex_rows: np.ndarray
    lex_weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the words at ``pick``, by label; the share of the features of each that were seen in training."""
        feats, counts = features(words, pick)
        n = len(self.langs)
        out = np.zeros((len(pick), n), np.float32)
        if not len(pick):
            return out, np.zeros(0, np.float32)
        starts = np.cumsum(counts) - counts
        for k in range(n):
            out[:, k] = np.add.reduceat(self.weights[k][feats], starts)
        known = np.add.reduceat(self.seen[feats], starts) / counts
        return out + lexical(self, words.hash[pick]) @ self.lex_weights, known


def lexical(model: Model, hashes: np.ndarray) -> np.ndarray:
    """Which lexicons have each word; a word that none has is a feature too."""
    n = len(model.langs)
    out = np.zeros((len(hashes), n + 1), np.float32)
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        out[:, :n] = model.lex_rows[at] & (model.lexicon[at] == hashes)[:, None]
    out[:, n] = ~out[:, :n].any(1)
    return out


def features(words: Words, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the picked words, one word after the other, and how many each has (never none)."""
    lens = (words.end - words.start)[pick]
    width = lens + 2  # a space on both sides
    begin = np.cumsum(width) - width
    text = np.full(int(width.sum()) + 2, 32, np.int64)
    inner = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    text[np.repeat(begin + 1, lens) + inner] = words.raw[np.repeat(words.start[pick], lens) + inner]
    two = text[:-1] * 256 + text[1:]
    three = two[:-1] * 256 + text[2:]
    tri = (mix(three.astype(np.uint64)) % np.uint64(TRI)).astype(np.int64) + 65536
    # for each byte a bigram and a trigram that start there; then the affixes
    per = 2 * width - 2 + 8
    at = np.cumsum(per) - per
    out = np.zeros(int(per.sum()), np.int64)
    pos = np.arange(int((width - 1).sum())) - np.repeat(np.cumsum(width - 1) - (width - 1), width - 1)
    where, byte = np.repeat(at, width - 1) + 2 * pos, np.repeat(begin, width - 1) + pos
    out[where] = two[byte]
    out[where + 1] = np.where(byte + 2 < np.repeat(begin + width, width - 1), tri[byte], two[byte])
    base = 65536 + TRI
    head = np.zeros(len(pick), np.uint64)
    tail = np.zeros(len(pick), np.uint64)
    for j in range(4):
        # of a shorter word the affix is the whole word again, and as such another feature
        head = np.where(j < lens, head * np.uint64(257) + text[begin + 1 + np.minimum(j, lens - 1)].astype(np.uint64) + np.uint64(1), head)
        tail = np.where(j < lens, tail * np.uint64(257) + text[begin + 1 + np.maximum(lens - 1 - j, 0)].astype(np.uint64) + np.uint64(1), tail)
        for i, h in enumerate((head, tail)):
            out[at + per - 8 + 2 * j + i] = base + (mix(h * np.uint64(8) + np.uint64(2 * j + i)) % np.uint64(AFFIX)).astype(np.int64)
    return out, per


N_FEATURES = 65536 + TRI + AFFIX


def marginals(emit: np.ndarray, transitions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word: exp-scores ``emit`` (words x labels) of texts of ``counts`` words one after the other."""
    n_labels = emit.shape[1]
    a = np.exp(transitions - transitions.max()).astype(np.float32)
    order = np.argsort(-counts, kind="stable")
    counts_o = counts[order]
    order, counts_o = order[counts_o > 0], counts_o[counts_o > 0]
    if not len(order):
        return np.zeros((0, n_labels), np.float32)
    first = (np.cumsum(counts) - counts)[order]
    blocks = -(-counts_o // BLOCK)
    block_at = np.cumsum(blocks) - blocks
    nb = int(blocks.sum())
    within = np.arange(nb) - np.repeat(block_at, blocks)
    start = np.repeat(first, blocks) + within * BLOCK
    size = np.minimum(BLOCK, np.repeat(first + counts_o, blocks) - start)
    full = int(size.max())
    # blocks of which step t is inside
    steps = [slice(None) if (size > t).all() else np.flatnonzero(size > t) for t in range(full)]
    p = [emit[(start + t)[s]] for t, s in enumerate(steps)]
    transfer = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (nb, n_labels, n_labels)).copy()
    for t, s in enumerate(steps):
        x = (transfer[s].reshape(-1, n_labels) @ a).reshape(-1, n_labels, n_labels) * p[t][:, None, :]
        x /= x.max(axis=(1, 2), keepdims=True)
        transfer[s] = x
    left = np.zeros((nb, n_labels), np.float32)
    right = np.ones((nb, n_labels), np.float32)
    state = np.full((len(order), n_labels), 1.0 / n_labels, np.float32)
    most = int(blocks[0])
    active = np.searchsorted(-blocks, -np.arange(1, most + 1), "right")  # texts that have block k
    for k in range(most):
        m = active[k]
        at = block_at[:m] + k
        left[at] = state[:m]
        x = np.einsum("di,dij->dj", state[:m], transfer[at])
        state[:m] = x / x.sum(1, keepdims=True)
    state = np.ones((len(order), n_labels), np.float32)
    for k in range(most - 1, -1, -1):
        m = active[k]
        at = block_at[:m] + k
        right[at] = state[:m]
        x = np.einsum("dij,dj->di", transfer[at], state[:m])
        state[:m] = x / x.sum(1, keepdims=True)
    out = np.empty_like(emit)
    for t, s in enumerate(steps):
        x = (left[s] @ a) * p[t]
        x /= x.sum(1, keepdims=True)
        left[s] = x
        out[(start + t)[s]] = x
    for t in range(full - 1, -1, -1):
        s = steps[t]
        at = (start + t)[s]
        beta = right[s]
        g = out[at] * beta
        out[at] = g / g.sum(1, keepdims=True)
        x = (p[t] * beta) @ a.T
        right[s] = x / x.sum(1, keepdims=True)
    return out


def label(texts: pa.Array, model: Model, **limits) -> pa.Array:
    """One struct of RESULT for each text."""
    parts = [(_label if model.langs else _unlabelled)(texts[a:b], model, **limits) for a, b in slices(texts)]
    kind = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64()), ("coverage", pa.float64()), ("n_words", pa.int64()), ("accepted", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("lang", pa.string())])))])
    return pa.concat_arrays(parts).cast(kind) if parts else pa.array([], kind)


def _unlabelled(texts: pa.Array, model: Model, **limits) -> pa.Array:
    """What can be said without a model."""
    n = np.diff(Words(texts, hashed=False).first)
    zero, spans = pa.array(np.zeros(len(n))), pa.array([[]] * len(n), pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("lang", pa.string())])))
    return pa.StructArray.from_arrays([pa.nulls(len(n), pa.string()), zero, zero, zero, pa.array(n.astype(np.int64)), pa.array(n > 0), spans], names=["lang", "share", "confidence", "coverage", "n_words", "accepted", "spans"])


def _label(texts: pa.Array, model: Model, min_share: float, min_confidence: float, min_coverage: float, min_text: float, keep: list[str] | None) -> pa.Array:
    words, n = Words(texts), len(model.langs)
    rows = len(words.first) - 1
    _, pick, code = np.unique(words.hash, return_index=True, return_inverse=True)
    scores, known = model.emissions(words, pick)
    emit = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30)) if len(pick) else scores
    counts = np.diff(words.first)
    post = marginals(emit[code], model.transitions, counts)
    best = post.argmax(1) if len(post) else np.zeros(0, np.int64)
    votes = np.bincount(words.row * n + best, minlength=rows * n).reshape(rows, n)
    some = np.maximum(counts, 1)
    mean = lambda x: np.bincount(words.row, x if len(x) else None, minlength=rows) / some
    lang = votes.argmax(1)
    share, confidence, coverage = votes.max(1) / some, mean(post.max(1) if len(post) else post), mean(known[code])
    ink = np.append(0, np.cumsum(words.raw > 32))
    ink = np.maximum(ink[words.offsets[1:]] - ink[words.offsets[:-1]], 1)
    text = np.bincount(words.row, words.end - words.start, minlength=rows) / ink
    names = np.array(model.langs, object)
    allowed = np.ones(n, bool) if keep is None else np.isin(names, keep)
    accepted = (counts > 0) & (share >= min_share) & (confidence >= min_confidence) & (coverage >= min_coverage) & (text >= min_text) & allowed[lang]
    turn = np.ones(len(best), bool)
    turn[1:] = (best[1:] != best[:-1]) | (words.row[1:] != words.row[:-1])
    at = np.flatnonzero(turn)
    length = np.diff(np.append(at, len(best)))
    offsets = np.searchsorted(at, words.first).astype(np.int32)
    labels = pa.array(model.langs, pa.string())
    spans = pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.StructArray.from_arrays(
            [pa.array((at - words.first[words.row[at]]).astype(np.int32)), pa.array(length.astype(np.int32)), labels.take(pa.array(best[at]))],
            names=["start", "n", "lang"],
        ),
    )
    return pa.StructArray.from_arrays(
        [labels.take(pa.array(lang, mask=counts == 0)), pa.array(share), pa.array(confidence), pa.array(coverage), pa.array(counts.astype(np.int64)), pa.array(accepted), spans],
        names=["lang", "share", "confidence", "coverage", "n_words", "accepted", "spans"],
    )


def train(labelled: list[tuple[str, str]], *, epochs: int = 3, rate: float = 0.25, l2: float = 1e-6, seed: int = 7) -> Model:
    """Fit by AdaGrad on the log-likelihood of word labels.

    ``labelled``: (text, language) pairs.  Their words are cut into runs of 3 to
    40 and runs of different texts joined, so that switches are seen in training.
    Without a word in them the model has no languages.
    """
    pairs = [(t, k) for t, k in labelled if t and k is not None]
    words = Words(pa.array([t for t, _ in pairs], pa.string()))
    worded = np.diff(words.first) > 0
    langs = sorted({k for (_, k), w in zip(pairs, worded) if w})
    n, rng = len(langs), np.random.default_rng(seed)
    if not langs:
        return Model([], *[np.zeros(0)] * 6)
    pairs = [x if w else (x[0], langs[0]) for x, w in zip(pairs, worded)]  # no word of these counts
    truth = np.array([langs.index(k) for _, k in pairs])[words.row]
    uniq, pick, code = np.unique(words.hash, return_index=True, return_inverse=True)
    seen = np.zeros((len(uniq), n), np.int64)
    np.add.at(seen, (code, truth), 1)
    in_lex = (seen >= 3) & (seen >= 0.1 * seen.sum(1, keepdims=True))
    keep = in_lex.any(1)
    model = Model(langs, np.zeros((n, N_FEATURES), np.float32), np.zeros(N_FEATURES, np.float32), uniq[keep], in_lex[keep], np.zeros((n + 1, n), np.float32), np.zeros((n, n), np.float32))
    feats, per = features(words, pick)
    model.seen[feats] = 1
    starts = np.cumsum(per) - per
    lex = lexical(model, uniq)
    squares, lex_sq, tr_sq = np.full_like(model.weights, 1e-6), np.full_like(model.lex_weights, 1e-6), np.full_like(model.transitions, 1e-6)
    # runs of words of one text, shuffled and joined to sequences
    cuts, at = [], 0
    for first, last in zip(words.first[:-1], words.first[1:]):
        at = first
        while at < last:
            step = int(rng.integers(3, 41))
            cuts.append((at, min(last, at + step)))
            at += step
    for _ in range(epochs):
        rng.shuffle(cuts)
        for i in range(0, len(cuts), 400):
            chunk = cuts[i : i + 400]
            index = np.concatenate([np.arange(a, b) for a, b in chunk])
            groups = [chunk[j : j + 4] for j in range(0, len(chunk), 4)]
            counts = np.array([sum(b - a for a, b in g) for g in groups])
            own, back = np.unique(code[index], return_inverse=True)
            rows = np.repeat(starts[own], per[own]) + np.arange(int(per[own].sum())) - np.repeat(np.cumsum(per[own]) - per[own], per[own])
            f, edge = feats[rows], np.cumsum(per[own]) - per[own]
            scores = np.stack([np.add.reduceat(model.weights[k][f], edge) for k in range(n)], 1) + lex[own] @ model.lex_weights
            emit = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))[back]
            post = marginals(emit, model.transitions, counts)
            y = truth[index]
            grad = post.copy()
            grad[np.arange(len(y)), y] -= 1
            by_word = np.zeros((len(own), n), np.float32)
            np.add.at(by_word, back, grad)
            for k in range(n):
                g = np.bincount(f, np.repeat(by_word[:, k], per[own]), minlength=N_FEATURES).astype(np.float32) / len(groups) + l2 * model.weights[k]
                squares[k] += g * g
                model.weights[k] -= 0.3 * rate * g / np.sqrt(squares[k])
            g = lex[own].T @ by_word / len(groups)
            lex_sq += g * g
            model.lex_weights -= rate * g / np.sqrt(lex_sq)
            # expected transitions from neighbouring posteriors under the current chain
            inside = np.ones(len(y), bool)
            inside[np.cumsum(counts) - counts] = False
            j = np.flatnonzero(inside)
            a = np.exp(model.transitions - model.transitions.max())
            pair = _pairs(emit, a, counts, j)
            real = np.zeros((n, n), np.float32)
            np.add.at(real, (y[j - 1], y[j]), 1)
            g = (pair - real) / len(groups)
            tr_sq += g * g
            model.transitions -= rate * g / np.sqrt(tr_sq)
    return model


def _pairs(emit: np.ndarray, a: np.ndarray, counts: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Expected number of each transition; sequences in lockstep, as they are few and short."""
    n = emit.shape[1]
    first, longest = np.cumsum(counts) - counts, int(counts.max())
    alpha, beta = np.zeros_like(emit), np.ones_like(emit)
    state = np.full((len(counts), n), 1.0 / n, np.float32)
    for t in range(longest):
        s = counts > t
        x = (state[s] @ a) * emit[first[s] + t]
        state[s] = alpha[first[s] + t] = x / x.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        s = counts > t + 1
        x = (emit[first[s] + t + 1] * beta[first[s] + t + 1]) @ a.T
        beta[first[s] + t] = x / x.sum(1, keepdims=True)
    xi = alpha[inner - 1][:, :, None] * a[None] * (emit[inner] * beta[inner])[:, None, :]
    return (xi / xi.sum((1, 2), keepdims=True)).sum(0)


def training_sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """About ``per_language`` different labelled texts of each language in the column lang, whole.

    They are those of the least hashes, so that the sample is the same however
    the rows are dealt to tasks: a share of each language by its number of
    different texts, half as many again as are wanted, of which the least are taken.
    """
    d = docs.select(F.col("text").alias("t"), F.col("lang").alias("k")).where("k is not null and t is not null and t <> ''").withColumn("h", F.xxhash64("t"))
    found = {r.k: r.n for r in d.groupBy("k").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not found:
        return []
    top = {k: min(1.0, (1.5 * per_language + 20) / max(1, n)) for k, n in found.items()}
    limit = F.create_map(*[x for k, share in top.items() for x in (F.lit(k), F.lit(float(share)))])
    u = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    some = d.where(u < limit[F.col("k")]).groupBy("k", "h").agg(F.first("t").alias("t")).collect()
    out: dict[str, list] = {}
    for r in sorted(some, key=lambda r: (r.k, r.h & ((1 << 64) - 1))):
        if len(out.setdefault(r.k, [])) < per_language:
            out[r.k].append((r.t, r.k))
    return [x for v in out.values() for x in v]


def fit(docs: DataFrame, per_language: int = 150) -> Model:
    """The model for a table with columns text and lang: a fit on a bounded sample, ``per_language`` texts of each language."""
    return train(training_sample(docs, per_language))


def judge(text: Column, model: Model, *, min_share: float = 0.4, min_confidence: float = 0.5, min_coverage: float = 0.5, min_text: float = 0.0, keep: list[str] | None = None, field: str | None = None) -> Column:
    """A struct of RESULT for a text column, or only its ``field``.

    A text is accepted if its most frequent label has ``min_share`` of the words,
    the words' mean posterior is ``min_confidence``, ``min_coverage`` of their
    features were seen in training, words are ``min_text`` of its non-blank
    bytes (0: any), and ``keep`` (None: any) has the language.
    """
    limits = {"min_share": min_share, "min_confidence": min_confidence, "min_coverage": min_coverage, "min_text": min_text, "keep": keep}
    if field == "accepted":
        # only the verdict crosses back to the JVM
        return arrow_udf(lambda t: label(t, model, **limits).field("accepted"), "boolean")(text)
    out = arrow_udf(lambda t: label(t, model, **limits), RESULT)(text)
    return out[field] if field else out


def identify(docs: DataFrame, model: Model, **options) -> DataFrame:
    """(doc_id, lang, share, confidence, coverage, n_words, accepted, spans) for every row: the word labels as runs."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("t"))
    return d.select("doc_id", judge(F.col("t"), model, **options).alias("r")).select("doc_id", "r.*")


def accepted(docs: DataFrame, model: Model, **options) -> DataFrame:
    """The rows, all columns as they are, whose text is accepted."""
    ship(docs.sparkSession)
    return docs.where(judge(docs["text"], model, field="accepted", **options))
