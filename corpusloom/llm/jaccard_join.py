"""Set-similarity self-join of documents on word n-grams, by PartEnum signatures.

A document is the set of its word n-grams; two are linked if their Jaccard
similarity is at least ``threshold``.  The result has one row for each document
with a link: its class, named by the least doc_id among all that links connect,
and the number of its links.  No link is lost and no list of pairs is made.

*Copies.*  Documents with equal sets are put together first, by a 128-bit digest
of the set that is aggregated before it is shuffled.  One text of each set goes
on; the others come back as members, so copies in any number cost one join.

*Bands.*  Sizes are cut into bands of ratio 1/threshold, so that two similar
sets lie in one band or in neighbouring ones.  A set signs for its own band and,
if a partner can be there, the next; a pair meets under the larger set's band.
Under a band of sizes up to r, similar sets differ in at most
k = floor(2 r (1-t)/(1+t)) n-grams.

*Signatures.*  The hashed domain is cut into n1 parts, each into n2 subparts, and
a set signs, for each part, every choice of n2-k2 of its subparts.  A part in
which two sets differ in at most k2 subparts gives them a signature in common,
so d differences leave at least ``least_matches(d)`` of them, which is more than
none for d <= k.  `plan` takes the numbers that put most n-grams into a signature
within a bounded number of signatures; at a threshold of 0.7 that is n2 = 3,
k2 = 1 for all but the smallest bands.

*Weak signatures* of few n-grams, or none, would make unrelated sets meet.  A set
leaves out its weakest as long as they are at most half of the matches that it is
sure of (the empty ones: all but one).  Weakness is a matter of the signature
alone, so of the matches of a pair only those are lost that the set with the
stricter rule leaves out.

*Candidates.*  Signatures cross the shuffle with an id, packed by bucket, without
the sets or anything of their size.  Pairs are counted where they meet; a pair
whose matches, summed over all buckets, are fewer than its sizes allow is no
candidate.  Where more than ``hot`` sets share a signature no pairs are made.
Most sets meet their partners in other signatures as often as is sure, for which
it is enough to count each set's hot groups; only the sets with as many hot
groups as matches they are sure of, those of large clusters, are chained.

*Sketches.*  Only the sets of candidates are sketched (bit h(x) mod m flipped for
each n-gram x: two sketches differ in at most as many bits as the sets do in
n-grams).  Candidate pairs, and the chained sets among one another in cells of two
blocks of ``block`` sets, are compared by them; those that may be similar are
joined to components.

*Check.*  The sets of a component are compared exactly, in cells of two blocks of
about ``grams`` n-grams, each cell on its own.  Cells give counts and a spanning
forest, from which the classes are made.

Defined cases: null or word-less texts have no n-grams, link with nothing and
are kept; a text of fewer than n words has one n-gram, of all of them; rows
without doc_id take no part in the join and are kept by the stage; repeated rows
count once; an id with several texts has the links of them all and joins their
classes; equal texts under different ids have similarity 1, in any number; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, exp, floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import cut, free_name, ship, written
from .textkit import Words, mix, slices, trim

#: Signatures in one bucket, about.
BUCKET_SIGNATURES = 5_000_000
BROADCAST_ROWS = 500_000
#: Signatures that a task holds before it packs them.
FLUSH = 1_000_000


@lru_cache(maxsize=64)
def _bands(top: int, t: float) -> tuple[tuple[int, int], ...]:
    out, low = [], 1
    while low <= top:
        high = max(low, floor(low / t + 1e-9))
        out.append((low, high))
        low = high + 1
    return tuple(out)


def band(tag: int, t: float) -> tuple[int, int]:
    """Least and largest size of a band."""
    top = 1 << 16
    while len(_bands(top, t)) <= tag:
        top <<= 4
    return _bands(top, t)[tag]


def tags_of(sizes: np.ndarray, t: float) -> np.ndarray:
    top = 1 << max(16, int(sizes.max(initial=1)).bit_length())
    return np.searchsorted(np.array([lo for lo, _ in _bands(top, t)]), sizes, "right") - 1


def apart(total: np.ndarray, t: float) -> np.ndarray:
    """Differences that two similar sets of so many n-grams together can have."""
    return np.floor((1 - t) / (1 + t) * total + 1e-9).astype(np.int64)


def least_matches(d: np.ndarray, n1: int, n2: int, k2: int) -> np.ndarray:
    """Signatures that two sets with d differences have in common at least: the differences spread evenly over the parts do most harm."""
    left = np.array([comb(n2 - j, n2 - k2) if j <= k2 else 0 for j in range(k2 + 3)])
    q, r = np.minimum(d // n1, k2 + 1), d % n1
    return (n1 - r) * left[q] + r * left[q + 1]


@lru_cache(maxsize=1024)
def plan(high: int, t: float) -> tuple[int, int, int]:
    """(n1, n2, k2) of the band with sizes up to ``high``."""
    k = int(apart(np.array(2 * high), t))
    if not k:
        return 1, 1, 0
    best = None
    for n2, k2 in [(1, 0), *((n2, k2) for n2 in range(2, 7) for k2 in range(1, n2))]:
        subsets, n1 = comb(n2, k2), k // (k2 + 1) + 1
        while True:  # spare parts for signatures that are empty in a set of the band's size
            load = high / n1 * (n2 - k2) / n2
            empty = n1 * subsets * exp(-load)
            if int(least_matches(np.array(k), n1, n2, k2)) > empty + 3 * sqrt(empty) or n1 > 2 * k + 8:
                break
            n1 += max(1, n1 // 64)
        if n2 > 1 and n1 * subsets > max(60, 0.7 * high):
            continue
        if best is None or load > best[0]:
            best = (load, n1, n2, k2)
    return best[1:]


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, ascending, and where each row's begin (one more than the rows)."""
    words = Words(texts)
    h, row, _ = words.shingles(n)
    rows = len(words.first) - 1
    order = np.lexsort((h, row)) if rows > 1 else np.argsort(h)
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(rows + 1))


def digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    size = np.diff(first).astype(np.uint64)
    out = []
    for salt in (0x51ED270B, 0xA7C15F3D):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        out.append(mix((total[first[1:]] - total[first[:-1]]) ^ size).view(np.int64))
    return out[0], out[1]


def _scaled(h: np.ndarray, n: int) -> np.ndarray:
    """Ascending hashes to ascending numbers below n."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def sign(h: np.ndarray, first: np.ndarray, docs: np.ndarray, tag: int, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets ``docs`` under the band ``tag``, the place in ``docs`` of each, and how many each set left out (-1: it signs even the empty ones)."""
    high = band(tag, t)[1]
    n1, n2, k2 = plan(high, t)
    size, nd = np.diff(first)[docs], len(docs)
    parts = n1 * n2
    x, owner = h[_ranges(first[:-1][docs], size)], np.repeat(np.arange(nd), size)
    per = np.bincount(owner * parts + _scaled(x, parts), minlength=nd * parts)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x ^ np.uint64(0xA5A5)), out=total[1:])
    ends = np.cumsum(per)
    cell = (total[ends] - total[ends - per]).reshape(nd, n1, n2)
    per = per.astype(np.int32).reshape(nd, n1, n2)
    sums, filled = [], []
    for subset in combinations(range(n2), n2 - k2):
        a, b = cell[:, :, subset[0]], per[:, :, subset[0]]
        for s in subset[1:]:
            a, b = a + cell[:, :, s], b + per[:, :, s]
        sums.append(a), filled.append(b)
    value, count = np.stack(sums, 2).reshape(nd, -1), np.stack(filled, 2).reshape(nd, -1)
    value = mix(value ^ mix((np.arange(value.shape[1]) + (tag << 40) + 1).astype(np.uint64)))
    # the weakest are left out as far as enough matches stay
    sure = least_matches(apart(size + np.minimum(np.floor(size / t + 1e-9), high), t), n1, n2, k2)
    below, omitted = np.zeros(nd, np.int64), np.full(nd, -1)
    for level in (1, 2, 3):
        weak = (count < level).sum(1)
        ok = (weak < sure if level == 1 else weak <= sure // 2) & (below == level - 1)
        below[ok], omitted[ok] = level, weak[ok]
    at = np.nonzero(count >= below[:, None])
    return value[at], at[0], omitted


def signers(sizes: np.ndarray, t: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(band, 0 for the own one or 1, places of the sets that sign for it); sets to which only equal ones are similar don't."""
    own = tags_of(sizes, t)
    for step in (0, 1):
        for tag in np.unique(own[sizes > 0]) + step:
            low, high = band(int(tag), t)
            reach = np.minimum(np.floor(sizes / t + 1e-9), high)
            docs = np.flatnonzero((own + step == tag) & (sizes > 0) & (reach >= low) & (apart(sizes + reach, t) > 0))
            if len(docs):
                yield int(tag), step, docs


def _pack(entries: np.ndarray, sig: np.ndarray, owner: np.ndarray) -> bytes:
    """One bucket's share; a signature keeps 32 bits, which the exact comparison makes good."""
    wide = np.uint16 if len(entries) < 65536 else np.uint32
    head = np.array([len(entries), len(sig), np.dtype(wide).itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, entries, sig.astype(np.uint32), owner.astype(wide)))


#: What a bucket knows of a set: its id, size, signatures left out, and 2 x band, plus 1 if the band is the next one.
_ENTRY = np.dtype([("id", "<i8"), ("size", "<i4"), ("omitted", "<i4"), ("tag", "<i4")])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ne, ns, wide = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24 + _ENTRY.itemsize * ne
    return np.frombuffer(blob, _ENTRY, ne, 24), np.frombuffer(blob[at : at + 4 * ns], np.uint32), np.frombuffer(blob[at + 4 * ns :], np.uint16 if wide == 2 else np.uint32)


def buckets_of(grams: dict[int, int], t: float) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and number of buckets of each band, by the n-grams of the sets of each size class (`_size_class`).

    A band has buckets of its own, so that a set is known in few buckets.
    """
    own: dict[int, float] = {}
    for k, n in grams.items():
        tag = int(tags_of(np.array([max(1, int(2 ** (k / 4)))]), t)[0])
        for step in (0, 1):
            own[tag + step] = own.get(tag + step, 0) + n
    count = np.array([max(1, -(-int(0.7 * own.get(tag, 0)) // BUCKET_SIGNATURES)) for tag in range(max(own, default=0) + 3)])
    return np.cumsum(count) - count, count


def _size_class(size: str = "size"):
    """Quarters of powers of two."""
    return F.floor(F.log2(F.col(size)) * 4).cast("int")


def _signer(n: int, t: float, base: np.ndarray, count: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[np.ndarray] = []
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            known, sig, owner, bucket = (np.concatenate(x) for x in (entries, sigs, owners, places))
            for x in (entries, sigs, owners, places):
                x.clear()
            held = 0
            order = np.argsort(bucket, kind="stable")
            bucket, sig, owner = bucket[order], sig[order], owner[order]
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            keys, blobs = bucket[at].astype(np.int64), []
            for a, b in zip(at, np.append(at[1:], len(bucket))):
                own, back = np.unique(owner[a:b], return_inverse=True)
                blobs.append(_pack(known[own], sig[a:b], back))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                h, first = sets_of(texts[a:b], n)
                ids, sizes = digests(h, first)[0], np.diff(first)
                for tag, step, docs in signers(sizes, t):
                    some = max(1, (1 << 21) // max(64, int(sizes[docs].max()) * 2))
                    for j in range(0, len(docs), some):
                        own = docs[j : j + some]
                        sig, owner, omitted = sign(h, first, own, tag, t)
                        e = np.empty(len(own), _ENTRY)
                        e["id"], e["size"], e["omitted"], e["tag"] = ids[own], sizes[own], omitted, 2 * tag + step
                        owners.append((owner + sum(map(len, entries))).astype(np.uint32))
                        k = min(tag, len(count) - 1)
                        places.append((base[k] + ((sig >> np.uint64(32)) * np.uint64(count[k]) >> np.uint64(32)).astype(np.int64)).astype(np.int32))
                        entries.append(e), sigs.append((sig & np.uint64((1 << 32) - 1)).astype(np.uint32))
                        held += len(sig)
                        if held > FLUSH:
                            yield flush()
        if held:
            yield flush()
        trim()

    return run


class Forest:
    """Union-find over 0..n-1 by whole arrays: roots are the least members."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, which: np.ndarray) -> np.ndarray:
        r = self.up[which]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[which] = r
                return r
            r = s

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart_ = x != y
            a, b, x, y = a[apart_], b[apart_], x[apart_], y[apart_]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def candidates(known: np.ndarray, sig: np.ndarray, owner: np.ndarray, t: float, hot: int) -> tuple[np.ndarray, ...]:
    """What the signatures of one bucket give: (a, b, n, need, band) as columns.

    A pair of ids with the number of signatures in common and that it needs in all;
    or, with n < 0, a hot group, a set in it, how many hot groups with these sets
    there are, and the matches that the set is sure of with any partner.
    """
    line = (sig.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64)
    line.sort()
    line = line[np.append(True, line[1:] != line[:-1])] if len(line) else line
    s = (line >> np.uint64(32)).astype(np.uint32)
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(s)))
    many = np.repeat(length > 1, length)  # signatures of one set alone are most of them
    who = (line[many] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = length[length > 1]
    start = np.cumsum(length) - length
    del line, s, many
    ne, pairs, counts = len(known), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.unique(length[length <= hot]).tolist():
        at = start[length == g]
        i, j = np.triu_indices(g, 1)
        step = max(1, (1 << 21) // len(i))
        for x in range(0, len(at), step):
            block = who[at[x : x + step, None] + np.arange(g)]
            p, c = np.unique(block[:, i].ravel() * ne + block[:, j].ravel(), return_counts=True)
            pairs.append(p), counts.append(c)
    p, back = np.unique(np.concatenate(pairs), return_inverse=True)
    count = np.bincount(back, np.concatenate(counts), minlength=len(p)).astype(np.int64)
    i, j = known[p // max(1, ne)], known[p % max(1, ne)]
    si, sj = i["size"].astype(np.int64), j["size"].astype(np.int64)
    # a pair counts under the larger set's band only
    ok = (i["tag"] >> 1 == j["tag"] >> 1) & ((i["tag"] & j["tag"] & 1) == 0) & (i["id"] != j["id"]) & (np.minimum(si, sj) >= t * np.maximum(si, sj) - 1e-9)
    i, j, si, sj, count = i[ok], j[ok], si[ok], sj[ok], count[ok]
    need = np.maximum(1, _by_band(i["tag"] >> 1, apart(si + sj, t), t) - np.maximum(0, np.maximum(i["omitted"], j["omitted"])))
    pair = np.minimum(i["id"], j["id"]), np.maximum(i["id"], j["id"]), count, need, i["tag"] >> 1
    # hot groups in which some set is of the band itself; equal ones once, with their number
    large = np.flatnonzero(length > hot)
    member = who[_ranges(start[large], length[large])]
    group = np.repeat(np.arange(len(large)), length[large])
    use = (np.bincount(group, 1 - (known["tag"][member] & 1), len(large)) > 0)[group] if len(large) else np.zeros(0, bool)
    member, group = member[use], np.unique(group[use], return_inverse=True)[1]
    name = np.zeros(int(group.max(initial=-1)) + 1, np.uint64)
    np.add.at(name, group, mix(known["id"][member].view(np.uint64) + known["tag"][member].astype(np.uint64)))
    _, at, times = np.unique(name, return_index=True, return_counts=True)
    mine = np.isin(group, at)
    member, group = known[member[mine]], group[mine]
    number = np.zeros(len(name), np.int64)
    number[at] = times
    size, tag = member["size"].astype(np.int64), member["tag"] >> 1
    high = np.array([band(x, t)[1] for x in range(int(tag.max(initial=0)) + 1)])[tag]
    # a partner with a stricter rule leaves out half of the matches at most, or, if this set signs empty ones, those
    least = _by_band(tag, apart(size + np.minimum(np.floor(size / t + 1e-9), high), t), t)
    sure = np.where(member["omitted"] < 0, 1, np.minimum(least - member["omitted"], least - least // 2))
    chain = mix(name).view(np.int64)[group], member["id"], -number[group], sure, tag
    return tuple(np.concatenate([x, y]) for x, y in zip(pair, chain))


def _by_band(tag: np.ndarray, d: np.ndarray, t: float) -> np.ndarray:
    out = np.zeros(len(d), np.int64)
    for k in np.unique(tag).tolist():
        m = tag == k
        out[m] = least_matches(d[m], *plan(band(k, t)[1], t))
    return out


def _matcher(t: float, hot: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in pdf["blob"]]
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        known, sig = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        owner = np.concatenate([p[2].astype(np.uint32) + np.uint32(s) for p, s in zip(parts, shift)])
        del parts, pdf
        out = candidates(known, sig, owner, t, hot)
        trim()
        return pd.DataFrame(dict(zip(("a", "b", "n", "need", "tag"), out)))

    return run


def sketch(x: np.ndarray, bits: int = 0) -> np.ndarray:
    """The parity sketch of a set, of a power of two of bits; 3 to 6 for each n-gram if not given."""
    bits = bits or max(64, 1 << int(3 * len(x)).bit_length())
    return np.packbits(np.bincount((mix(x) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """The same sketches (rows) with fewer bits."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def may_be_similar(a: list[bytes], b: list[bytes], size_a: np.ndarray, size_b: np.ndarray, t: float) -> np.ndarray:
    """Which pairs the sketches don't rule out."""
    la, lb = (np.array([len(x) // 8 for x in v], np.int64) for v in (a, b))
    far = np.zeros(len(la), np.int64)
    kinds, kind = np.unique(np.stack([la, lb], 1), axis=0, return_inverse=True) if len(la) else ([], None)
    for k, (wa, wb) in enumerate(kinds):
        at, w = np.flatnonzero(kind.ravel() == k), int(min(wa, wb))
        x, y = (folded(np.frombuffer(b"".join(v[i] for i in at), np.uint64).reshape(len(at), -1), w) for v in (a, b))
        far[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return far <= apart(size_a + size_b, t)


def near_chained(sketches: list[bytes], size: np.ndarray, split: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs i < j (with ``split``: i below it, j not) that the sketches don't rule out."""
    n = len(sketches)
    words = np.array([len(x) // 8 for x in sketches])
    wide: dict[int, np.ndarray] = {}
    for w in np.unique(words).tolist():  # all that have so many bits or more, folded
        wide[w] = np.zeros((n, w), np.uint64)
        for v in np.unique(words[words >= w]).tolist():
            at = np.flatnonzero(words == v)
            wide[w][at] = folded(np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), v), w)
    forest, left, right = Forest(n), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(split or n - 1):
        j = np.arange(max(k + 1, split), n)
        low, high = np.minimum(size[k], size[j]), np.maximum(size[k], size[j])
        j = j[(low >= t * high - 1e-9) & (forest.roots(j) != forest.roots(np.array([k]))[0])]
        for w in np.unique(np.minimum(words[j], words[k])).tolist():
            own = j[np.minimum(words[j], words[k]) == w]
            own = own[np.bitwise_count(wide[w][k] ^ wide[w][own]).sum(1, dtype=np.int64) <= apart(size[k] + size[own], t)]
            forest.join(np.full(len(own), k), own)
            left.append(np.full(len(own), k)), right.append(own)
    return np.concatenate(left), np.concatenate(right)


def similar(sets: list[np.ndarray], split: int, t: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of the sets with Jaccard similarity of at least t, exactly; with ``split``, those of i below it and j not."""
    size = np.array([len(x) for x in sets])
    flat, n = np.concatenate(sets), len(sets)
    _, code = np.unique(flat, return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(len(flat) + 1, np.int32)
    sketches = None
    if n > 64:
        words = max(1, (1 << int(1.2 * size.max()).bit_length()) // 64)
        sketches = np.stack([sketch(x, 64 * words) for x in sets])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(split or n - 1):
        j = np.arange(max(k + 1, split), n)
        low, high = np.minimum(size[k], size[j]), np.maximum(size[k], size[j])
        j = j[low >= t * high - 1e-9]
        if sketches is not None and len(j):
            j = j[np.bitwise_count(sketches[k] ^ sketches[j]).sum(1, dtype=np.int64) <= apart(size[k] + size[j], t)]
        if not len(j):
            continue
        mine = code[start[k] : start[k] + size[k]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[code[_ranges(start[j], size[j])]], np.cumsum(size[j]) - size[j])
        mark[mine] = 0
        j = j[shared / (size[k] + size[j] - shared) >= t]
        left.append(np.full(len(j), k)), right.append(j)
    return np.concatenate(left), np.concatenate(right)


_LINKED = "hi long, lo long, links long, root long"


def _checker(t: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, x, y), own in pdf.sort_values(["component", "x", "y", "block", "hi", "lo"], kind="stable").groupby(["component", "x", "y"], sort=False):
            hi, lo, n, block = (own[c].to_numpy() for c in ("hi", "lo", "n", "block"))
            new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))  # repeated rows
            hi, lo, n, block = hi[new], lo[new], n[new], block[new]
            if len(hi) < 2:
                continue
            split = int((block == x).sum()) if x != y else 0
            if x != y and split in (0, len(hi)):
                continue
            i, j = similar([np.frombuffer(b, np.uint64) for b, k in zip(own["blob"], new) if k], split, t)
            forest = Forest(len(hi))
            forest.join(i, j)
            links = np.bincount(i, n[j], len(hi)) + np.bincount(j, n[i], len(hi))
            at = np.flatnonzero(links)
            out.append(pd.DataFrame({"hi": hi[at], "lo": lo[at], "links": links[at].astype(np.int64), "root": hi[forest.roots(at)]}))
        trim()
        return pd.concat(out) if out else pd.DataFrame({"hi": [], "lo": [], "links": [], "root": []})

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("txt")).where("doc is not null and txt is not null")


def _side(df: DataFrame) -> DataFrame:
    """Broadcast if a count says that it is small; ``df`` must be cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hashed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                h, first = sets_of(batch.column(1)[a:b], n)
                some = np.flatnonzero(np.diff(first))
                hi, lo = digests(h, first)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(some)), pa.array(hi[some]), pa.array(lo[some]), pa.array(np.diff(first)[some].astype(np.int32))], names=["doc", "hi", "lo", "size"])

    return run


def _sets(n: int, sketched: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                h, first = sets_of(batch.column(0)[a:b], n)
                hi, lo = digests(h, first)
                part = batch.slice(a, b - a)
                # an id may have other texts than the one that stands for its set
                ok = np.flatnonzero((hi == part.column(1).to_numpy()) & (lo == part.column(2).to_numpy()))
                blobs = pa.array([(sketch(h[first[i] : first[i + 1]]) if sketched else h[first[i] : first[i + 1]]).tobytes() for i in ok], pa.binary())
                more, names = ([pa.array(np.diff(first)[ok].astype(np.int32))], ["size"]) if sketched else ([], [])
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(ok)) for k in range(1, part.num_columns)], blobs, *more], names=[*part.schema.names[1:], "blob", *names])

    return run


def links(docs: DataFrame, n: int = 3, threshold: float = 0.7, *, hot: int = 64, block: int = 4096, grams: int = 1_000_000) -> DataFrame:
    """(doc_id, class_id, n_links): for each document that is linked, the least doc_id of its class, and with how many others it is linked."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    ship(docs.sparkSession)
    d = _texts(docs)
    members = cut(d.mapInArrow(_hashed(n), "doc long, hi long, lo long, size int").distinct())
    classes = cut(members.groupBy("hi", "lo").agg(F.min("doc").alias("rep"), F.first("size").alias("size"), F.count("*").alias("n")))
    # texts that stand for no set needn't be signed
    copies = cut(members.select("doc").distinct().join(classes.select("rep").distinct(), F.col("doc") == F.col("rep"), "left_anti"))
    grams_of = {r.k: r.n for r in classes.groupBy(_size_class().alias("k")).agg(F.sum("size").alias("n")).collect()}  # a hundred rows or so
    signed = d.join(_side(copies), "doc", "left_anti").select("txt").mapInArrow(_signer(n, threshold, *buckets_of(grams_of, threshold)), "bucket long, blob binary")
    met = written(signed.groupBy("bucket").applyInPandas(_matcher(threshold, hot), "a long, b long, n int, need int, tag int"), "met")
    pairs, chains = _candidates(met)
    pairs, chains = cut(pairs), components(chains)
    near = components(_sketched(d, n, threshold, classes, pairs, chains, block))
    sizes = near.join(classes, near["node"] == classes["hi"]).groupBy("component").agg(F.sum("size").alias("grams"))
    wanted = cut(
        classes.join(near, classes["hi"] == near["node"]).join(sizes, "component")
        .select("component", "hi", "lo", "rep", "n", F.ceil(F.col("grams") / grams).cast("int").alias("blocks"))
    )
    rows = wanted.count()
    sets = _of_texts(d, wanted, rows, ["hi", "lo", "component", "blocks", "n"]).mapInArrow(_sets(n, False), "hi long, lo long, component long, blocks int, n long, blob binary")
    linked = cut(_celled(sets, "lo", rows // 500 + 1).applyInPandas(_checker(threshold), _LINKED))
    return _assembled(members, classes, linked)


def _of_texts(d: DataFrame, wanted: DataFrame, rows: int, columns: list[str]) -> DataFrame:
    """The texts that stand for the wanted sets; these are few, and only beyond a checked size do the texts cross a shuffle to meet them."""
    side = F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted
    return d.join(side, d["doc"] == side["rep"]).select("txt", *columns)


def _celled(rows: DataFrame, by: str, parts: int):
    """Rows with a component and its number of blocks, grouped so that any two of a component are in a cell (x, y) together."""
    rows = rows.withColumn("block", F.pmod(by, "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}).drop("other", "blocks")
    return rows.groupBy(F.pmod(F.xxhash64("component", "x", "y"), F.lit(max(1, min(parts, 1 << 20)))).alias("part"))


def _sketched(d: DataFrame, n: int, t: float, classes: DataFrame, pairs: DataFrame, chains: DataFrame, block: int) -> DataFrame:
    """Edges (a, b) that the sketches don't rule out: of the pairs, and a spanning forest of those within each component of chains."""
    chained = cut(chains.withColumnRenamed("node", "id"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(chained.select("id")).distinct()
    wanted = cut(classes.join(ids, classes["hi"] == ids["id"]).select("rep", "hi", "lo"))
    rows = wanted.count()
    known = written(_of_texts(d, wanted, rows, ["hi", "lo"]).mapInArrow(_sets(n, True), "hi long, lo long, blob binary, size int"), "sketches")
    hint = "broadcast" if rows <= BROADCAST_ROWS // 4 else "merge"
    of = lambda c: known.select(F.col("hi").alias(c), F.col("blob").alias(f"s_{c}"), F.col("size").alias(f"n_{c}")).hint(hint)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = may_be_similar(x.column("s_a").to_pylist(), x.column("s_b").to_pylist(), x.column("n_a").to_numpy().astype(np.int64), x.column("n_b").to_numpy().astype(np.int64), t)
            yield x.select(["a", "b"]).filter(pa.array(ok))

    near = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(compared, "a long, b long")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, x, y), own in pdf.sort_values(["component", "x", "y", "block", "id"], kind="stable").groupby(["component", "x", "y"], sort=False):
            split = int((own["block"] == x).sum()) if x != y else 0
            if len(own) > 1 and (x == y or 0 < split < len(own)):
                i, j = near_chained(own["blob"].tolist(), own["size"].to_numpy(np.int64), split, t)
                out.append(pd.DataFrame({"a": own["id"].to_numpy()[i], "b": own["id"].to_numpy()[j]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    blocks = chained.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cells = chained.join(blocks, "component").join(known.select(F.col("hi").alias("id"), "blob", "size").hint(hint), "id")
    return near.union(_celled(cells, "id", rows // 2000 + 1).applyInPandas(within, "a long, b long"))


def _candidates(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with the matches that they need, and the chains of hot groups, both (a, b).

    A pair may have as many of its matches in hot groups as the lesser of its sets
    is in.  A set that is in fewer than it is sure of meets all partners elsewhere too,
    so only the others are chained.
    """
    hot = met.where("n < 0").select(F.col("a").alias("group"), F.col("b").alias("id"), (-F.col("n")).alias("n"), "need", "tag")
    hots = cut(hot.groupBy("id", "tag").agg(F.sum("n").alias("h"), F.min("need").alias("sure")))
    hint = "broadcast" if hots.count() <= BROADCAST_ROWS else "merge"
    of = lambda c: hots.select(F.col("id").alias(c), "tag", F.col("h").alias(f"h_{c}")).hint(hint)
    pairs = met.where("n > 0").groupBy("a", "b", "tag").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    pairs = pairs.join(of("a"), ["a", "tag"], "left").join(of("b"), ["b", "tag"], "left")
    lost = F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0)))
    pairs = pairs.where(F.col("n") >= F.greatest(F.lit(1), F.col("need") - lost)).select("a", "b").distinct()
    must = hots.where("h >= sure").select("id", "tag").hint(hint)
    chained = hot.join(must, ["id", "tag"], "left_semi").select("group", "id").distinct()
    head = chained.groupBy("group").agg(F.min("id").alias("head"))
    chains = chained.join(head, "group").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    return pairs, chains


def _assembled(members: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """From the sets' links to the documents'."""
    several = members.groupBy("doc").agg(F.min("hi").alias("a"), F.collect_set("hi").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    joined = components(linked.select(F.col("hi").alias("a"), F.col("root").alias("b")).union(several))
    weights = linked.groupBy("hi", "lo").agg(F.sum("links").alias("links"))
    known = classes.join(weights, ["hi", "lo"], "left").join(joined.withColumnRenamed("node", "hi"), "hi", "left").where("n > 1 or component is not null")
    known = known.select("hi", "lo", "rep", F.coalesce("component", "hi").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    known = cut(known)
    names = known.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = cut(known.join(names, "component").select("hi", "lo", "class_id", "links"))
    if named.count() <= BROADCAST_ROWS:
        both = members.join(F.broadcast(named), ["hi", "lo"])
    else:  # one set may have a third of all documents
        salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
        both = members.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(32)).cast("int")).join(salted, ["hi", "lo", "salt"])
    return both.groupBy(F.col("doc").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("links").alias("n_links")).where("n_links > 0")


def one_of_each_group(docs: DataFrame, n: int = 3, threshold: float = 0.7) -> DataFrame:
    """The rows, all columns as they are, but of each class only those of its least doc_id."""
    name = free_name(docs, "gone")
    gone = cut(links(docs, n, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias(name)))
    side = _side(gone)
    return docs.join(side, docs["doc_id"] == side[name], "left_anti")
