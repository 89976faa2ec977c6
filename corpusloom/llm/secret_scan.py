"""Secret scan: sliding-window Shannon entropy of candidate strings, by character class.

A candidate is a maximal run of at least ``MIN_RUN`` characters of the Base64
alphabets.  Inside it, each class of ``CLASSES`` has its own alphabet, window and
threshold: a run of the class's characters is a finding if some window of it
reaches the threshold.  The entropy of a window follows from the last one's by
changing two counts.  An allow-list suppresses what is known to be harmless: exact
strings, and patterns that match the finding with what stands before it.

Defined cases: null and empty texts have no findings; a text of any length is
scanned whole, in time proportional to its length; repeated rows are scanned row
by row and a null doc_id is carried as it is; an empty table gives an empty
result; other columns are never read, and a redacted row keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .session import ship
from .textkit import buffers, slices

MIN_RUN = 16
#: Runs shorter than this need less entropy, in the proportion of what their length allows.
FULL_RUN = 20


@dataclass(frozen=True)
class CharClass:
    """A run of ``alphabet`` is suspicious where ``window`` characters have ``bits`` of entropy, if all patterns in ``has`` are found in it."""

    name: str
    alphabet: str
    window: int
    bits: float
    has: tuple[str, ...]


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharClass("hex", "0123456789abcdefABCDEF", 20, 2.8, ("[0-9]", "[a-fA-F]")),
    CharClass("base64", _LETTERS + "0123456789+/", 24, 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
    CharClass("base64url", _LETTERS + "0123456789-_", 24, 3.9, ("[0-9]", "[a-z]", "[A-Z]")),
    CharClass("base36", "abcdefghijklmnopqrstuvwxyz0123456789", 24, 3.8, ("[0-9].*[a-z].*[0-9].*[a-z].*[0-9]",)),
    CharClass("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 3.2, ("[0-9]", "[A-Z]")),
)
#: Patterns over the 24 characters before a finding, a NUL, and the finding; a NUL and @ if it is the userinfo of a URL.
ALLOWED = (
    r"(?i)(sha(1|256|512)?|md5|commit|checksum|digest|etag|revision)\W{0,4}\x00",
    r"(?i)data:[a-z/+.-]+;base64,\x00",
    r"\x00[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)\x00.*(example|placeholder|dummy|changeme)",
    # paths of URLs, but no userinfo, query value, fragment or webhook
    r"(?i)https?://(?!\S*(\x00@|hooks?\.|webhook|/services/))[^\s\x00:@?#=&]*(:\d{1,5}/[^\s\x00:@?#=&]*\x00|:\x00\d{1,5}/|\x00)",
)
_TABLE = np.zeros(256, bool)
_TABLE[list((_LETTERS + "0123456789+/-_").encode())] = True


def peak_entropy(s: str, window: int) -> float:
    """The highest entropy, in bits a character, of ``window`` characters in a row; of the whole string if it is shorter."""
    w = min(window, len(s))
    if not w:
        return 0.0
    part = [0.0] + [c * log2(c) for c in range(1, w + 1)]
    count: dict[str, int] = {}
    total = 0.0
    least = float("inf")
    for i, c in enumerate(s):
        k = count.get(c, 0)
        total += part[k + 1] - part[k]
        count[c] = k + 1
        if i >= w:
            old = s[i - w]
            k = count[old]
            total += part[k - 1] - part[k]
            count[old] = k - 1
        if i >= w - 1 and total < least:
            least = total
    return log2(w) - least / w


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, allowed_strings: frozenset[str] = frozenset()):
        self.classes, self.strings = classes, allowed_strings
        self.run = [re.compile(f"[{re.escape(c.alphabet)}]{{{min(c.window, MIN_RUN)},}}") for c in classes]
        self.has = [[re.compile(p) for p in c.has] for c in classes]
        self.allowed = [re.compile(p) for p in allowed]

    def judge(self, candidate: str, before: str, after: str = "") -> Iterator[tuple[int, int, str, float]]:
        """(start, length, class, entropy) of the findings in a candidate; the first class that fires at a place has it."""
        taken: list[tuple[int, int]] = []
        tail = "\x00@" if after == "@" and "://" in before else ""
        for c, run, has in zip(self.classes, self.run, self.has):
            for m in run.finditer(candidate):
                s, (a, b) = m.group(), m.span()
                if any(a < y and x < b for x, y in taken) or not all(p.search(s) for p in has):
                    continue
                bits = peak_entropy(s, c.window)
                if bits >= (c.bits if len(s) >= FULL_RUN else c.bits * min(1.0, log2(len(s)) / log2(c.window))):
                    taken.append((a, b))
                    if s in self.strings or any(p.search(f"{(before + candidate[:a])[-24:]}\x00{s}{tail}") for p in self.allowed) or any(p.search(f"{before[-24:]}\x00{candidate}{tail}") for p in self.allowed):
                        continue
                    yield a, b - a, c.name, bits

    def scan(self, texts: pa.Array) -> Iterator[tuple[int, int, str, str, float]]:
        """(row, byte offset in the row, secret, class, entropy) of every finding, in order."""
        raw, offsets = buffers(texts)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = _TABLE[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[0::2], edge[1::2]
        long_ = end - start >= MIN_RUN
        for a, b in zip(start[long_].tolist(), end[long_].tolist()):
            # a run may go on into the next texts: each has its own part
            first, last = np.searchsorted(offsets, [a, b - 1], "right") - 1
            for r in range(int(first), int(last) + 1):
                x, y = max(a, int(offsets[r])), min(b, int(offsets[r + 1]))
                if y - x >= MIN_RUN:
                    before = raw[max(int(offsets[r]), x - 24) : x].tobytes().decode("utf-8", "ignore")
                    s = raw[x:y].tobytes().decode()
                    after = raw[y : min(y + 1, int(offsets[r + 1]))].tobytes().decode("utf-8", "ignore")
                    for at, n, name, bits in sorted(self.judge(s, before, after)):
                        yield r, x - int(offsets[r]) + at, s[at : at + n], name, bits


def find(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, start, length, kind, entropy, digest): a row for each finding; start counts characters, digest is the secret's SHA-256."""
    ship(docs.sparkSession)
    scanner = scanner or Scanner()
    d = docs.select(F.col("doc_id"), F.col("text").alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = batch.column(1)[a:b]
                raw, offsets = buffers(texts)
                hits = list(scanner.scan(texts))
                if hits:
                    # characters before a byte: bytes that begin one
                    starts = [int(((raw[offsets[r] : offsets[r] + at] & 0xC0) != 0x80).sum()) for r, at, *_ in hits]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": batch.column(0)[a:b].take(pa.array([h[0] for h in hits])), "start": pa.array(starts, pa.int64()), "length": pa.array([len(h[2]) for h in hits], pa.int32()),
                        "kind": [h[3] for h in hits], "entropy": [h[4] for h in hits], "digest": [hashlib.sha256(h[2].encode()).hexdigest() for h in hits],
                    })

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, start long, length int, kind string, entropy double, digest string")


def redact(docs: DataFrame, scanner: Scanner | None = None, mask: str = "[SECRET]") -> DataFrame:
    """The same rows with each finding in text replaced by ``mask``; n_chars, if there, follows where a text changes."""
    ship(docs.sparkSession)
    scanner = scanner or Scanner()

    def changed(texts: pa.Array) -> pa.Array:
        out: list[str | None] = [None] * len(texts)
        for a, b in slices(texts):
            part = texts[a:b]
            raw, offsets = buffers(part)
            spans: dict[int, list[tuple[int, int]]] = {}
            for r, at, s, *_ in scanner.scan(part):
                spans.setdefault(r, []).append((at, at + len(s)))
            for r, cuts in spans.items():
                text, last, pieces = raw[offsets[r] : offsets[r + 1]].tobytes(), 0, []
                for x, y in cuts:
                    pieces += [text[last:x], mask.encode()]
                    last = y
                out[a + r] = b"".join([*pieces, text[last:]]).decode()
        return pa.array(out, pa.string())

    # the text crosses back from Python only where it changed
    names = docs.columns
    new = "__redacted"
    while new in names:
        new += "_"
    with_new = docs.withColumn(new, arrow_udf(changed, "string")(docs["text"]))
    cols = []
    for c in names:
        if c == "text":
            cols.append(F.coalesce(F.col(new), F.col("text")).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col(new).isNull(), F.col("n_chars")).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType)).alias("n_chars"))
        else:
            cols.append(F.col(f"`{c}`"))
    return with_new.select(*cols)
