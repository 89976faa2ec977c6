"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text, h = 2h + gear[byte] modulo 2**16,
so it depends on the last 16 bytes alone.  A text is cut after each byte where
the hash's top ``cut_bits`` bits are zero, at least ``min_chunk`` bytes after the
last cut, before a byte that begins a character, and at the latest ``max_chunk``
bytes after the last cut.  An insertion moves the cuts near it only; later chunks
are the same bytes again.

*Runs.*  From each cut goes a run of as many chunks as hold ``run_words`` words.
Runs with the same 128-bit digest are the same, and a run that two documents have
is a place where they may share a passage.  Neighbouring runs with the same
partner at the same distance are chained; a chain of ``min_words`` words is a
repeated passage.

*Windows.*  Runs of a passage may have different partners, where parts of it are
in other documents too, so chains can be shorter than what is shared.  Where
runs are left over, the windows of exactly ``min_words`` words that hold no run
without a partner are compared by digest.  So a passage is reported if it has
``min_words`` words and the cuts in it leave room for a run; shorter ones never are.

A passage is reported in every document that has it: with role "repeat" where a
document with a lesser doc_id has it too, else "first".  Passages that only one
document has, in several places, are none.  `without_repeats` cuts out the repeats.

*Skew.*  Digests cross the shuffle as packed arrays, one row for each bucket and
batch; buckets grow in number with the input.  Of a run that more than ``hot``
documents of a batch have, two go to the bucket and the others are settled on
the spot, so a passage in any share of all documents comes a few times a batch.

A word is a run of non-blank bytes; one of more than 32 bytes is as many words as
it has chunks, so that texts without blanks have words too.

Defined cases: null and empty texts have no passages; rows without doc_id take no
part and are kept; rows that repeat a doc_id count as one document, each text of it
with spans of its own; a text of one repeated character is cut every ``min_chunk``
or ``max_chunk`` bytes; an empty table gives an empty result; other columns are
never read, and a rewritten row keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .session import cut, free_name, ship
from .textkit import _BYTE, _powers, buffers, mix, slices, trim

GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(777)) >> np.uint64(48)).astype(np.uint16)
BUCKET_BYTES = 24 << 20
BROADCAST_ROWS = 500_000
#: Runs that a task holds before it packs them.
FLUSH = 500_000
WINDOW, LONG_WORD = 16, 32
#: Bytes after which the cuts of a passage are taken not to depend on what stands before it.
SYNC = 4 * WINDOW
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_RUN = [("hi", "<u8"), ("lo", "<u8"), ("doc", "<i8"), ("th", "<i4"), ("start", "<i4"), ("size", "<i4"), ("u", "<i4"), ("n", "<i2")]
_MET = [("doc", "<i8"), ("th", "<i4"), ("start", "<i4"), ("size", "<i4"), ("u", "<i4"), ("n", "<i2"), ("partner", "<i8"), ("shift", "<i8")]
_MET_SCHEMA = "doc long, th int, start int, size int, u int, n short, partner long, shift long"


def gear_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; it starts anew with each text."""
    rows, n = len(offsets) - 1, len(raw)
    place = np.arange(n) + WINDOW * np.repeat(np.arange(rows), np.diff(offsets))
    h = np.zeros(n + WINDOW * rows, np.uint16)
    h[place] = GEAR[raw]
    step = 1
    while step < WINDOW:  # sums over 1, 2, 4 .. 16 bytes
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint16(step)
        h, step = longer, 2 * step
    return h[place]


def cuts(raw: np.ndarray, offsets: np.ndarray, cut_bits: int, min_chunk: int, max_chunk: int) -> np.ndarray:
    """Ends of all chunks in the bytes, ascending; every text's end is one."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    hit = (gear_hashes(raw, offsets) >> np.uint16(16 - cut_bits)) == 0
    starts_char = np.append((raw[1:] & 0xC0) != 0x80, True)
    at = np.flatnonzero(hit & starts_char) + 1
    texts = np.unique(offsets)
    place = np.searchsorted(texts, at - 1, "right")
    at = at[(at - texts[place - 1] >= min_chunk) & (at < texts[np.minimum(place, len(texts) - 1)])]
    # a cut at least min_chunk after its neighbour stands; only closer ones are looked at in order
    at = np.union1d(at, texts)
    fixed = np.zeros(len(at), bool)
    fixed[np.searchsorted(at, texts)] = True
    near = np.zeros(len(at), bool)
    near[1:] = (np.diff(at) < min_chunk) & ~fixed[1:]
    keep = ~near
    todo = np.flatnonzero(near)
    if len(todo):
        group = np.flatnonzero(np.append(True, np.diff(todo) > 1))
        lone = np.diff(np.append(group, len(todo))) == 1  # its neighbour stands, so it doesn't
        for a, b in zip(todo[group[~lone]].tolist(), np.append(todo[group[1:] - 1], todo[-1])[~lone].tolist()):
            last = at[a - 1]
            for i in range(a, b + 1):
                if at[i] - last >= min_chunk:
                    keep[i], last = True, at[i]
    at = at[keep]
    # long gaps
    gap = np.diff(at)
    extra = (gap - 1) // max_chunk
    far = np.flatnonzero(extra > 0)
    if len(far):
        more = np.repeat(at[far], extra[far]) + max_chunk * (np.arange(int(extra[far].sum())) - np.repeat(np.cumsum(extra[far]) - extra[far], extra[far]) + 1)
        while True:  # not inside a character
            inside = (raw[more] & 0xC0) == 0x80
            if not inside.any():
                break
            more = more - inside
        at = np.union1d(at, more)
    return at[at > 0]


class Digests:
    """128-bit digests of byte ranges."""

    def __init__(self, raw: np.ndarray):
        self.totals = []
        for salt, base in enumerate(_BASES):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((_BYTE[raw] + np.uint64(salt)) * _powers(base, len(raw)), out=total[1:])
            self.totals.append(total)

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        n = len(self.totals[0]) - 1
        return [mix((t[end] - t[start]) * _powers(pow(base, -1, 1 << 64), n)[start] if len(start) else t[:0]) + (end - start).astype(np.uint64) for base, t in zip(_BASES, self.totals)]


def word_edges(raw: np.ndarray, offsets: np.ndarray, cut_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    ink = raw > 32
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] = ink[heads]
    start = np.flatnonzero(begins)
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = ink[tails]
    end = np.flatnonzero(ends) + 1
    if len(end) and (end - start).max() > LONG_WORD:
        k = np.searchsorted(start, cut_at, "right") - 1
        inner = cut_at[(k >= 0) & (cut_at > start[k]) & (cut_at < end[k]) & (end[k] - start[k] > LONG_WORD)]
        start, end = np.sort(np.append(start, inner)), np.sort(np.append(end, inner))
    return start, end


class Runs:
    """All runs of a batch of texts: row, start and end in the batch's bytes, words before, whole words in it."""

    def __init__(self, texts: pa.Array, run_words: int, cut_bits: int, min_chunk: int, max_chunk: int):
        self.raw, self.offsets = buffers(texts)
        self.digests = Digests(self.raw)
        end = cuts(self.raw, self.offsets, cut_bits, min_chunk, max_chunk)
        self.word_start, self.word_end = word_edges(self.raw, self.offsets, end)
        start = np.append(0, end[:-1]) if len(end) else end
        row = np.searchsorted(self.offsets, start, "right") - 1
        before, done = np.searchsorted(self.word_start, start), np.searchsorted(self.word_end, end, "right")
        last = np.searchsorted(done, before + run_words)
        whole = np.flatnonzero(last < len(end))
        whole = whole[row[whole] == row[last[whole]]]
        self.row, self.start, self.end = row[whole], start[whole], end[last[whole]]
        self.before, self.words = before[whole], done[last[whole]] - before[whole]


def _blob(columns: dict[str, np.ndarray], form: list[tuple[str, str]], at: slice | np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(columns[n][at], t).tobytes() for n, t in form)


def _columns(blobs: list[bytes], form: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {n: [] for n, _ in form}
    item = sum(np.dtype(t).itemsize for _, t in form)
    for blob in blobs:
        n, at = len(blob) // item, 0
        for name, t in form:
            width = n * np.dtype(t).itemsize
            parts[name].append(np.frombuffer(blob[at : at + width], t))
            at += width
    return {n: np.concatenate(p) for n, p in parts.items()}


def _classes(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs that come more than once, by digest, document and start, and which of them begin a class."""
    order = np.argsort(c["hi"], kind="stable")
    hi = c["hi"][order]
    same = np.zeros(len(hi) + 1, bool)
    same[1:-1] = hi[1:] == hi[:-1]
    order = order[same[:-1] | same[1:]]
    order = order[np.lexsort((c["start"][order], c["th"][order], c["doc"][order], c["lo"][order], c["hi"][order]))]
    hi, lo = c["hi"][order], c["lo"][order]
    head = np.ones(len(order), bool)
    head[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return order, head


def partners(c: dict[str, np.ndarray], order: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs in ``order``: which have a partner, and the partner, the first run of the class in another document."""
    if not len(order):
        return order, order
    heads, klass = np.flatnonzero(head), np.cumsum(head) - 1
    doc = c["doc"][order]
    of_first = doc == doc[heads][klass]
    other = np.minimum.reduceat(np.where(of_first, len(order), np.arange(len(order))), heads)[klass]
    at = np.flatnonzero(other < len(order))
    return order[at], order[np.where(of_first[at], other[at], heads[klass[at]])]


def _met(c: dict[str, np.ndarray], at: np.ndarray, partner: np.ndarray) -> dict[str, np.ndarray]:
    out = {k: c[k][at] for k in ("doc", "th", "start", "size", "u", "n")}
    return out | {"partner": c["doc"][partner], "shift": c["start"][partner].astype(np.int64) - c["start"][at]}


def _cutter(buckets: int, options: dict, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            c = {k: np.concatenate([h[k] for h in held]) for k, _ in _RUN}
            held.clear()
            order, head = _classes(c)
            length = np.diff(np.append(np.flatnonzero(head), len(order)))
            busy = np.repeat(length > hot, length)
            keys, blobs, stay = [], [], np.ones(len(c["hi"]), bool)
            if busy.any():  # the first run of a class and its partner go on, the others are settled here
                order, head = order[busy], head[busy]
                at, partner = partners(c, order, head)
                firsts = np.unique(np.concatenate([order[head], partner]))
                rest = ~np.isin(at, firsts)
                at, partner = at[rest], partner[rest]
                stay[at] = False
                if len(at):
                    keys.append(-1 - int(c["doc"][at[0]] % buckets))
                    blobs.append(_blob(_met(c, at, partner), _MET, slice(None)))
            left = np.flatnonzero(stay)
            bucket = ((c["hi"][left] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = left[np.argsort(bucket, kind="stable")]
            at = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
            for k in np.flatnonzero(np.diff(at)):
                keys.append(int(k)), blobs.append(_blob(c, _RUN, order[at[k] : at[k + 1]]))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            docs, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(2)):
                r = Runs(batch.column(2)[a:b], **options)
                if len(r.row):
                    hi, lo = r.digests.of(r.start, r.end)
                    base = r.offsets[r.row]
                    first_word = np.searchsorted(r.word_start, base)
                    held.append({"hi": hi, "lo": lo, "doc": docs[a:b][r.row], "th": ths[a:b][r.row], "start": (r.start - base).astype(np.int32), "size": (r.end - r.start).astype(np.int32), "u": (r.before - first_word).astype(np.int32), "n": r.words.astype(np.int16)})
                    if sum(len(h["hi"]) for h in held) > FLUSH:
                        yield flush()
        if held:
            yield flush()
        trim()

    return run


def _matcher(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    if key[0] < 0:  # settled before the shuffle
        return pd.DataFrame(_columns(pdf["blob"].tolist(), _MET))
    c = _columns(pdf["blob"].tolist(), _RUN)
    out = pd.DataFrame(_met(c, *partners(c, *_classes(c))))
    trim()
    return out


def _union(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First interval and end of each union of overlapping or touching intervals; they are ascending by text and start."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = text * (1 << 33)
    reach = np.maximum.accumulate(wide + end)
    new = np.append(True, (wide + start)[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return at, (reach - wide)[np.append(at[1:], len(start)) - 1]


_FOUND = "doc long, th int, kind int, start int, stop int, u int, v int, starts array<int>, sure_start array<int>, sure_stop array<int>"


def _chainer(min_words: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc", "th", "start"])
        doc, th, start, size, u, n, partner, shift = (pdf[k].to_numpy(np.int64) for k in ("doc", "th", "start", "size", "u", "n", "partner", "shift"))
        _, text = np.unique(np.stack([doc, th]), axis=1, return_inverse=True)
        o = np.lexsort((start, shift, partner, text))
        new = np.append(True, (np.diff(text[o]) != 0) | (np.diff(partner[o]) != 0) | (np.diff(shift[o]) != 0) | (start[o][1:] > (start + size)[o][:-1]))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(o)) - 1
        a, b = o[head], o[tail]
        sure = u[b] + n[b] - u[a] >= min_words
        a, b = a[sure], b[sure]
        out = pd.DataFrame({"doc": doc[a], "th": th[a], "kind": (partner[a] > doc[a]).astype(int), "start": start[a], "stop": (start + size)[b], "u": u[a], "v": (u + n)[b]})
        # texts with runs outside of all these
        o = np.lexsort((start[a], text[a]))
        a, b = a[o], b[o]
        at, stop = _union(text[a], start[a], (start + size)[b])
        s_text, s_start = text[a][at], start[a][at]
        k = np.searchsorted(s_text * (1 << 33) + s_start, text * (1 << 33) + start, "right") - 1
        inside = (k >= 0) & (s_text[k] == text) & (stop[k] >= start + size) if len(at) else np.zeros(len(text), bool)
        left = np.unique(text[~inside])
        order = np.lexsort((start, text))
        first, edge = np.searchsorted(text[order], left), np.searchsorted(text[order], left, "right")
        s_first, s_edge = np.searchsorted(s_text, left), np.searchsorted(s_text, left, "right")
        start32, s32, e32 = start[order].astype(np.int32), s_start.astype(np.int32), stop.astype(np.int32)
        more = pd.DataFrame({
            "doc": doc[order][first], "th": th[order][first], "kind": 2, "start": 0, "stop": 0, "u": 0, "v": 0, "starts": [start32[x:y] for x, y in zip(first, edge)],
            "sure_start": [s32[x:y] for x, y in zip(s_first, s_edge)], "sure_stop": [e32[x:y] for x, y in zip(s_first, s_edge)],
        })
        out["starts"] = out["sure_start"] = out["sure_stop"] = None
        return pd.concat([out, more]) if len(out) and len(more) else more if len(more) else out

    return run


def _windows(min_words: int, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                r = Runs(batch.column(2)[a:b], **options)
                row_first = np.searchsorted(r.row, np.arange(b - a + 1))
                word_first = np.searchsorted(r.word_start, r.offsets)
                rows, words = [], []
                for i in range(b - a):
                    base, own = int(r.offsets[i]), slice(row_first[i], row_first[i + 1])
                    ws, we = r.word_start[word_first[i] : word_first[i + 1]], r.word_end[word_first[i] : word_first[i + 1]]
                    if len(ws) < min_words:
                        continue
                    ws, we = ws[: len(ws) - min_words + 1] - base, we[min_words - 1 :] - base
                    start, end = r.start[own] - base, r.end[own] - base
                    alone = ~np.isin(start, batch.column(3)[a + i].values.to_numpy())
                    # no run without a partner lies in the window, where cuts no more depend on what is before: the first that begins there doesn't end in it
                    s, e = start[alone], end[alone]
                    some = np.append(e, np.int64(1) << 40)[np.searchsorted(s, ws + SYNC)] >= we
                    # and some run with a partner does
                    s, e = start[~alone], end[~alone]
                    some &= np.append(e, np.int64(1) << 40)[np.searchsorted(s, ws)] <= we
                    cs, ce = batch.column(4)[a + i].values.to_numpy(), batch.column(5)[a + i].values.to_numpy()
                    if len(cs):
                        k = np.searchsorted(cs, ws, "right") - 1
                        some &= ~((k >= 0) & (ce[np.maximum(k, 0)] >= we))
                    w = np.flatnonzero(some)
                    rows.append(np.full(len(w), i)), words.append(w)
                if not rows or not sum(map(len, rows)):
                    continue
                row, w = np.concatenate(rows), np.concatenate(words)
                start, end = r.word_start[word_first[row] + w], r.word_end[word_first[row] + w + min_words - 1]
                hi, lo = r.digests.of(start, end)
                base, at = r.offsets[row], pa.array(a + row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32)), pa.array(w.astype(np.int32))],
                    names=["hi", "lo", "doc", "th", "start", "stop", "u"],
                )

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    doc, th, kind, start, stop, u, v = (pdf[k].to_numpy(np.int64) for k in ("doc", "th", "kind", "start", "stop", "u", "v"))
    _, text = np.unique(np.stack([doc, th]), axis=1, return_inverse=True)
    parts, known = [], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for k, role in ((0, "repeat"), (1, "first")):
        o = np.flatnonzero(kind == k)
        o = o[np.lexsort((start[o], text[o]))]
        at, end = _union(text[o], start[o], stop[o])
        if not len(at):
            continue
        words = np.maximum.reduceat(v[o], at) - u[o][at]
        at = o[at]
        if k:  # what is a repeat as a whole is no first
            p = np.searchsorted(known[0] * (1 << 33) + known[1], text[at] * (1 << 33) + start[at], "right") - 1
            ok = ~((p >= 0) & (known[0][p] == text[at]) & (known[2][p] >= end)) if len(known[0]) else np.ones(len(at), bool)
            at, end, words = at[ok], end[ok], words[ok]
        else:
            known = text[at], start[at], end
        parts.append(pd.DataFrame({"doc_id": doc[at], "th": th[at], "start_byte": start[at], "n_bytes": end - start[at], "n_words": words, "role": role}))
    return pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "th": [], "start_byte": [], "n_bytes": [], "n_words": [], "role": []})


def _spans(docs: DataFrame, min_words: int, run_words: int, cut_bits: int, min_chunk: int, max_chunk: int, hot: int) -> DataFrame:
    if not 1 <= run_words < min_words:
        raise ValueError("run_words must be less than min_words")
    ship(docs.sparkSession)
    options = {"run_words": run_words, "cut_bits": cut_bits, "min_chunk": min_chunk, "max_chunk": max_chunk}
    d = docs.select(F.col("doc_id").cast("long").alias("doc"), F.shiftright(F.xxhash64("text"), 32).cast("int").alias("th"), F.col("text").alias("txt")).where("doc is not null and txt is not null")
    total = d.agg(F.sum(F.octet_length("txt"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    met = d.mapInArrow(_cutter(buckets, options, hot), "bucket long, blob binary").groupBy("bucket").applyInPandas(_matcher, _MET_SCHEMA)
    part = F.pmod(F.xxhash64("doc"), F.lit(2 * buckets)).alias("part")
    found = cut(met.groupBy(part).applyInPandas(_chainer(min_words), _FOUND))
    open_ = found.where("kind = 2").select(F.col("doc").alias("o_doc"), F.col("th").alias("o_th"), "starts", "sure_start", "sure_stop")
    side = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
    texts = d.join(side, (d["doc"] == side["o_doc"]) & (d["th"] == side["o_th"])).select("doc", "th", "txt", "starts", "sure_start", "sure_stop")
    windows = cut(texts.mapInArrow(_windows(min_words, options), "hi long, lo long, doc long, th int, start int, stop int, u int"))
    shared = windows.groupBy("hi", "lo").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("hi", "lo", "least")
    more = windows.join(shared, ["hi", "lo"]).select("doc", "th", (F.col("doc") == F.col("least")).cast("int").alias("kind"), "start", "stop", "u", (F.col("u") + min_words).alias("v"))
    all_ = found.where("kind < 2").select("doc", "th", "kind", "start", "stop", "u", "v").union(more)
    return all_.groupBy(part).applyInPandas(_merged, "doc_id long, th int, start_byte long, n_bytes long, n_words long, role string")


def repeated_spans(docs: DataFrame, *, min_words: int = 51, run_words: int = 12, cut_bits: int = 4, min_chunk: int = 8, max_chunk: int = 256, hot: int = 8) -> DataFrame:
    """(doc_id, start_byte, n_bytes, n_words, role) of all passages of at least ``min_words`` words that another document has too."""
    return _spans(docs, min_words, run_words, cut_bits, min_chunk, max_chunk, hot).drop("th").distinct()


def without_repeats(docs: DataFrame, *, min_words: int = 51, run_words: int = 12, cut_bits: int = 4, min_chunk: int = 8, max_chunk: int = 256, hot: int = 8) -> DataFrame:
    """The same rows with the repeated passages cut out of text; the columns and their order stay."""
    doc, th, cuts_ = (free_name(docs, x) for x in ("span_doc", "span_th", "spans"))
    spans = _spans(docs, min_words, run_words, cut_bits, min_chunk, max_chunk, hot).where("role = 'repeat'")
    spans = spans.groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th)).agg(F.sort_array(F.collect_set(F.struct("start_byte", "n_bytes"))).alias(cuts_))

    def cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist()):
            if t is not None and s:
                raw, last, keep = t.encode(), 0, []
                for x in s:
                    a, b = x["start_byte"], x["start_byte"] + x["n_bytes"]
                    while a < b and raw[a] & 0xC0 == 0x80:  # whole characters only
                        a += 1
                    while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    keep.append(raw[last:a])
                    last = b
                t = b"".join([*keep, raw[last:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    joined = docs.join(spans, (docs["doc_id"] == spans[doc]) & (F.shiftright(F.xxhash64(docs["text"]), 32).cast("int") == spans[th]), "left")
    new = F.when(F.col(cuts_).isNull(), docs["text"]).otherwise(arrow_udf(cut_out, "string")(docs["text"], F.col(cuts_)))
    return joined.select(*[new.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])
