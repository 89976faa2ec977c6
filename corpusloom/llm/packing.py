"""Cost-balanced packing of documents into training sequences.

The cost of a document of L tokens is ``linear`` L + ``quadratic`` L**2, the
token-wise layers and the attention within the document.  Documents go, in
descending length, to the sequence of least cost that has room for them; where
none has, a new sequence begins.  So sequences come out alike in cost, not only
in tokens.

Documents are dealt by hash to groups of about ``per_group``, and each group is
packed on its own, in memory, by one task: groups grow in number with the input,
not in size.  A document longer than a sequence is cut into pieces of full
length and a rest; no token is lost.

Defined cases: a text without tokens (null or empty) takes no room and has no
row; equal lengths go by doc_id, nulls first, then by piece; equal costs go to
the oldest sequence; repeated rows are packed as often as they come; a null
doc_id is packed and stays null; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ship
from .textkit import slices
from .tokenizer import VOCABULARY, encoding, read_ranks

#: Attention's share: 1 / (6 x model width) of the token-wise cost a token and token of context, at width 4096.
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * 4096)


def cost(n: float, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def assign(lengths: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[int]:
    """The sequence of each of the descending ``lengths``.

    Sequences with room wait in a heap by (cost, number).  One that has too
    little for the length at hand moves to a heap by room, and comes back once the
    lengths have come down to it, so each document costs a few heap operations.
    """
    first = -(-sum(lengths) // capacity)
    ready = [(0.0, k) for k in range(first)]
    room = [capacity] * first
    waiting: list[tuple[int, float, int]] = []
    out = []
    for n in lengths:
        while waiting and -waiting[0][0] >= n:
            _, c, k = heapq.heappop(waiting)
            heapq.heappush(ready, (c, k))
        while ready and room[ready[0][1]] < n:
            c, k = heapq.heappop(ready)
            heapq.heappush(waiting, (-room[k], c, k))
        if ready:
            c, k = heapq.heappop(ready)
        else:
            c, k = 0.0, len(room)
            room.append(capacity)
        room[k] -= n
        out.append(k)
        if room[k]:
            heapq.heappush(ready, (c + cost(n, linear, quadratic), k))
    return out


def token_counts(texts: pa.Array, ranks: bytes) -> pa.Array:
    encode = encoding(ranks).encode_ordinary
    return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())


def pack_lengths(lengths: DataFrame, capacity: int, per_group: int = 20_000, linear: float = LINEAR, quadratic: float = QUADRATIC, rows: int | None = None) -> DataFrame:
    """Pack rows (doc_id, n_tokens): (group, sequence, slot, doc_id, piece, start, n_tokens, cost)."""
    if capacity < 1 or per_group < 1:
        raise ValueError("capacity and per_group must be positive")
    rows = lengths.count() if rows is None else rows
    groups = max(1, -(-rows // per_group))
    key = F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(groups))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n_tokens"].to_numpy(np.int64)
        pieces = -(-n // capacity)
        pdf = pdf.loc[pdf.index.repeat(pieces)].reset_index(drop=True)
        piece = np.arange(len(pdf)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pdf["piece"], pdf["start"] = piece, piece * capacity
        pdf["n_tokens"] = np.minimum(pdf["n_tokens"] - pdf["start"], capacity)
        pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], na_position="first", kind="stable").reset_index(drop=True)
        pdf["sequence"] = assign(pdf["n_tokens"].tolist(), capacity, linear, quadratic)
        pdf["slot"] = pdf.groupby("sequence").cumcount()
        pdf["cost"] = cost(pdf["n_tokens"].to_numpy(float), linear, quadratic)
        return pdf[["group", "sequence", "slot", "doc_id", "piece", "start", "n_tokens", "cost"]]

    kind = lengths.schema["doc_id"].dataType.simpleString()
    return (
        lengths.where("n_tokens > 0").select(key.alias("group"), "doc_id", "n_tokens").groupBy("group")
        .applyInPandas(run, f"group long, sequence int, slot int, doc_id {kind}, piece int, start long, n_tokens long, cost double")
    )


def pack(docs: DataFrame, capacity: int = 8192, per_group: int = 20_000, vocabulary: str = VOCABULARY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Tokenise and pack the texts: one row for each piece, with its group, sequence and slot."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], token_counts(batch.column(1)[a:b], held.value)], names=["doc_id", "n_tokens"])

    # not a function of a column: a filter on that is moved below it with a copy of it, which tokenises all again in workers of its own
    d = docs.select(F.col("doc_id"), F.col("text").alias("txt"))
    lengths = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long")
    return pack_lengths(lengths, capacity, per_group, linear, quadratic, rows=docs.count())
