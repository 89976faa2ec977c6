import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import chunk_dedup as C


def slow_cuts(data: bytes, bits, low, high):
    out, last, h = [], 0, 0
    for i, b in enumerate(data):
        h = (2 * h + int(C.GEAR[b])) % 2**16
        head = i + 1 == len(data) or (data[i + 1] & 0xC0) != 0x80
        if (h >> (16 - bits)) == 0 and head and i + 1 - last >= low:
            out.append(i + 1)
            last = i + 1
    if not out or out[-1] != len(data):
        out.append(len(data))
    return out


def test_cuts_equal_the_rolling_definition(make):
    rng = random.Random(3)
    texts = [make(rng, k, n) for k in ("en", "fr", "de") for n in (1, 30, 400)] + ["", "a" * 3000, "é" * 500]
    for t in texts:
        raw = t.encode()
        got = C.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5, 16, 1 << 30).tolist()
        assert got == (slow_cuts(raw, 5, 16, 0) if raw else [])


OPTIONS = {"run_words": 12, "cut_bits": 4, "min_chunk": 8, "max_chunk": 256}


def test_texts_do_not_touch_one_another(make):
    rng = random.Random(4)
    texts = [make(rng, "fr", n) for n in (3, 200, 1, 90)] + [None, "", "x y z " * 50, " \n "]
    both = C.Runs(pa.array(texts), **OPTIONS)
    for r, t in enumerate(texts):
        own, at = C.Runs(pa.array([t], pa.string()), **OPTIONS), both.row == r
        base = both.offsets[r]
        assert (both.start[at] - base).tolist() == own.start.tolist() and (both.end[at] - base).tolist() == own.end.tolist()
        assert both.words[at].tolist() == own.words.tolist() and [x[at].tolist() for x in both.digests.of(both.start, both.end)] == [x.tolist() for x in own.digests.of(own.start, own.end)]
        raw = (t or "").encode()
        for s, e, n in zip(own.start, own.end, own.words):
            inner = [w for w in words(raw) if w[0] >= s and w[1] <= e]
            assert len(inner) == n >= 12


def words(raw: bytes):
    """Start and end of each word."""
    out, at = [], None
    for i, b in enumerate(raw + b" "):
        if b > 32 and at is None:
            at = i
        elif b <= 32 and at is not None:
            out.append((at, i))
            at = None
    return out


def test_an_insertion_moves_few_cuts(make):
    t = make(random.Random(5), "en", 800)

    def digests(t):
        r = C.Runs(pa.array([t]), **OPTIONS)
        return set(r.digests.of(r.start, r.end)[0].tolist())

    a, b = digests(t), digests(t[:1000] + "inserted words " + t[1000:])
    assert len(a & b) > 0.95 * len(a)


def brute(rows, n):
    """(doc, start, end) of each word-aligned passage of at least n words that another document has."""
    where, spans = {}, {}
    for i, t in rows:
        raw = t.encode()
        w = words(raw)
        for k in range(len(w) - n + 1):
            where.setdefault(raw[w[k][0] : w[k + n - 1][1]], []).append((i, w[k][0], w[k + n - 1][1]))
    for places in where.values():
        if len({i for i, *_ in places}) > 1:
            for i, s, e in places:
                spans.setdefault(i, []).append((s, e))
    out = []
    for i, own in spans.items():
        own.sort()
        s, e = own[0]
        for x, y in own[1:] + [(1 << 60, 0)]:
            if x > e:
                out.append((i, s, e))
                s, e = x, y
            e = max(e, y)
    return out


def agrees(got, want, rows):
    """Each passage is found, by most of its bytes, and nothing else is."""
    texts = dict(rows)
    for i, s, e in want:
        assert sum(max(0, min(e, r.start_byte + r.n_bytes) - max(s, r.start_byte)) for r in got if r.doc_id == i) > 0.7 * (e - s), (i, s, e)
    for r in got:
        whole = [w for w in words(texts[r.doc_id].encode()) if w[0] >= r.start_byte and w[1] <= r.start_byte + r.n_bytes]
        assert any(i == r.doc_id and s <= whole[0][0] and whole[-1][1] <= e for i, s, e in want), r
        assert len(whole) == r.n_words


def test_every_holder_of_a_passage_is_found_and_the_later_ones_are_cut(spark, make):
    rng = random.Random(6)
    passages = {3: make(rng, "en", 51), 4: make(rng, "en", 50), 5: make(rng, "fr", 60)}
    inner = make(rng, "en", 80)
    rows = [(i, " ".join([make(rng, "en", 80), passages.get(i % 8, ""), make(rng, "en", 80)])) for i in range(40)]
    rows.append((100, " ".join([inner, make(rng, "en", 30), inner])))  # repeats inside one document
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, span_doc string")
    got = C.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} == {i for i in range(40) if i % 8 in (3, 5)}
    assert {r.doc_id for r in got if r.role == "first"} == {3, 5} and {r.doc_id for r in got if r.role == "repeat"} == {i for i in range(8, 40) if i % 8 in (3, 5)}
    agrees(got, brute(rows, 51), rows)
    new = C.without_repeats(docs)
    assert new.columns == docs.columns
    by = {r.doc_id: r.text for r in new.collect()}
    assert all((by[i] == t) == (i not in range(8, 40) or i % 8 not in (3, 5)) for i, t in rows) and all(len(by[i]) < len(t) - 150 for i, t in rows if 8 <= i < 40 and i % 8 in (3, 5))


def test_passages_equal_brute_force(spark, make, monkeypatch):
    rng = random.Random(7)
    pool = [make(rng, "de", n) for n in (20, 30, 40, 50, 60, 90)]
    rows = [(i, "  ".join(rng.choice(pool) if rng.random() < 0.5 else make(rng, "de", 15) for _ in range(9))) for i in range(80)]
    rows += [(100 + i, " ".join(pool[:3]) + " " + make(rng, "en", 5) + " " + " ".join(pool[3:])) for i in range(15)] + [(200 + i, rows[i][1]) for i in range(10)]
    want = brute(rows, 51)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = C.repeated_spans(docs).collect()
    agrees(got, want, rows)
    monkeypatch.setattr(C, "BUCKET_BYTES", 30_000)
    again = C.repeated_spans(docs, hot=2).collect()  # several buckets, and runs settled before the shuffle
    agrees(again, want, rows)


def test_short_passages_of_fifty_words_and_one(spark, make):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        p = make(rng, "fr", 51)
        rows += [(2 * k + j, " ".join([make(rng, "fr", 60), p, make(rng, "fr", 60)])) for j in (0, 1)]
    got = {r.doc_id for r in C.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) >= 0.99 * len(rows)


def test_odd_documents(spark, odd, none):
    got = C.repeated_spans(odd).collect()
    assert {(r.doc_id, r.role) for r in got} == {(1, "first"), (2, "repeat")}
    assert C.repeated_spans(none).collect() == [] and C.without_repeats(none).collect() == []
    clash = odd.select("*", *[odd["size"].alias(c) for c in ("spans", "span_doc", "span_th", "__doc", "__spans", "role", "th", "doc")])
    assert C.without_repeats(clash).count() == odd.count() and C.without_repeats(clash).columns == clash.columns
    rng = random.Random(9)
    no_blanks = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(3000))
    long_ = [(1, no_blanks), (2, "あ" + no_blanks), (3, "a b " * 20)]
    docs = spark.createDataFrame(long_, "doc_id long, text string")
    assert {r.doc_id for r in C.repeated_spans(docs).collect()} == {1, 2}
    assert [r.text for r in C.without_repeats(docs).orderBy("doc_id").collect()][::2] == [long_[0][1], long_[2][1]]
