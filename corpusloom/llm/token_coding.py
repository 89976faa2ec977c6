"""Token ids as Simple-8b words.

A 64-bit word holds a selector in its top four bits and, in the other sixty, as
many ids as fit at one width.  Ids are coded in blocks of ``BLOCK``; the words of
a block begin at its offset, so a block is decoded without those before it.
Selector 0 is an escape: the word after it is one id of more than sixty bits.
Selector 1 stands for 120 zeros.  A block's last word may be filled with zeros,
as the number of ids is known.

All blocks of a batch are coded in step with one another, and all words of one
selector are decoded at once.

Defined cases: a null text has null words and no ids; an empty text has no words;
ids of all 64 bits are coded; repeated rows are coded row by row and a null doc_id
is carried as it is; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship
from .textkit import slices
from .tokenizer import VOCABULARY, encoding, read_ranks

BLOCK = 128
#: Selector -> (ids, bits).
TABLE = {0: (1, 64), 1: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
_RISING = [(s, *TABLE[s]) for s in range(15, 0, -1)]  # 1 id of 60 bits .. 120 of none


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; 0 for 0."""
    out = np.zeros(ids.shape, np.uint8)
    x = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1) << np.uint64(step)
        out += np.where(big, step, 0).astype(np.uint8)
        x = np.where(big, x >> np.uint64(step), x)
    return out + (x > 0)


def encode(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code runs of ``counts`` ids that lie one after the other: (words, words of each block, blocks of each run)."""
    ids, counts = np.asarray(ids, np.uint64), np.asarray(counts, np.int64)
    blocks = -(-counts // BLOCK)
    nb = int(blocks.sum())
    if not nb:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), blocks
    begin = np.cumsum(counts) - counts
    within = np.arange(nb) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = np.repeat(begin, blocks) + within * BLOCK
    size = np.minimum(BLOCK, np.repeat(begin + counts, blocks) - start)
    grid = np.zeros((nb, BLOCK + 120), np.uint64)
    r = np.repeat(np.arange(nb), size)
    c = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    grid[r, c] = ids
    bits = _widths(grid)
    words = np.zeros((nb, BLOCK * 2), np.uint64)
    used = np.zeros(nb, np.int64)
    at = np.zeros(nb, np.int64)
    live = np.arange(nb)
    while len(live):
        p = at[live]
        top = np.zeros(len(live), np.uint8)
        choice = np.zeros(len(live), np.int64)  # the escape
        open_, done = np.arange(len(live)), 0
        for s, n, b in _RISING:
            w = top[open_]
            for j in range(done, n):
                w = np.maximum(w, bits[live[open_], p[open_] + j])
            top[open_] = w
            ok = w <= b
            if s == 1:
                ok &= size[live[open_]] - p[open_] > 60  # zeros to the end need no longer word
            open_ = open_[ok]
            choice[open_] = s
            done = n
            if not len(open_):
                break
        for s in np.unique(choice).tolist():
            own = np.flatnonzero(choice == s)
            b_, q = live[own], p[own]
            n, width = TABLE[s]
            word = np.full(len(own), s << 60, np.uint64)
            if s == 0:
                words[b_, used[b_] + 1] = grid[b_, q]
                used[b_] += 1
                words[b_, used[b_] - 1] = word
            else:
                if width:
                    for j in range(n):
                        word |= grid[b_, q + j] << np.uint64(j * width)
                words[b_, used[b_]] = word
            used[b_] += 1
            at[b_] += n
        live = live[at[live] < size[live]]
    return words[np.arange(words.shape[1]) < used[:, None]], used, blocks


def decode(words: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` ids of words whose blocks begin at ``offsets``."""
    words, offsets = np.asarray(words, np.uint64), np.asarray(offsets, np.int64)
    if not count:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words after an escape
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    holds = np.array([TABLE[s][0] for s in range(16)])[selector]
    holds[raw] = 0
    block = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    before = np.cumsum(holds) - holds
    place = BLOCK * block + before - before[offsets][block]
    end = np.minimum(BLOCK * (block + 1), count)
    out = np.zeros(count, np.uint64)
    for s in np.unique(selector[~raw]).tolist():
        own = np.flatnonzero((selector == s) & ~raw)
        n, width = TABLE[s]
        if s == 0:
            out[place[own]] = words[own + 1]
        elif width:
            mask = np.uint64((1 << width) - 1)
            for j in range(n):
                fits = place[own] + j < end[own]
                w = own[fits]
                out[place[w] + j] = (words[w] >> np.uint64(j * width)) & mask
    return out


def _token_arrays(texts: list[str | None], ranks: bytes) -> list[np.ndarray]:
    enc = encoding(ranks)
    to_numpy = getattr(enc, "encode_to_numpy", None)
    if to_numpy is not None:
        return [to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
    return [np.array(enc.encode_ordinary(t), np.uint32) if t else np.zeros(0, np.uint32) for t in texts]


def code(texts: pa.Array, ranks: bytes) -> pa.StructArray:
    """n_tokens, words (little-endian bytes) and block_offsets of each text."""
    tokens = _token_arrays(texts.to_pylist(), ranks)
    counts = np.array([len(t) for t in tokens], np.int64)
    words, per_block, blocks = encode(np.concatenate(tokens) if len(tokens) else np.zeros(0, np.uint64), counts)
    edge = np.append(0, np.cumsum(per_block))
    first = np.append(0, np.cumsum(blocks))
    ends = edge[first]
    null = np.array(texts.is_null())
    data = pa.Array.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer((8 * ends).astype(np.int64)), pa.py_buffer(words.astype("<u8"))])
    data = data.cast(pa.binary())
    if null.any():
        data = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.binary()), data)
    offs = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array((edge[:-1] - np.repeat(ends[:-1], blocks)).astype(np.int32)))
    return pa.StructArray.from_arrays([pa.array(counts), data, offs], names=["n_tokens", "words", "block_offsets"])


def write_ids(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, words, block_offsets) for every row."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    d = docs.select(F.col("doc_id"), F.col("text").alias("txt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                s = code(batch.column(1)[a:b], held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *s.flatten()], names=["doc_id", "n_tokens", "words", "block_offsets"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, words binary, block_offsets array<int>")


def read_ids(coded: DataFrame) -> DataFrame:
    """(doc_id, ids) again."""
    d = coded.select("doc_id", "n_tokens", "words", "block_offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [
                None if w is None else decode(np.frombuffer(w, "<u8"), np.array(o, np.int64), n).astype(np.int64)
                for n, w, o in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<long>")
