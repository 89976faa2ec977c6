import numpy as np
import pyarrow as pa

from corpusloom.llm.textkit import Words, slices, words_of


def test_words_match_the_regular_expression():
    texts = ["The cat, the HAT", None, "", "Écoute—moi 12ab", "x", "endjoin", "join ed", "!?", "日本 語"]
    w = Words(pa.array(texts))
    for r, t in enumerate(texts):
        own = [w.raw[s:e].tobytes().decode() for s, e in zip(w.start[w.first[r] : w.first[r + 1]], w.end[w.first[r] : w.first[r + 1]])]
        assert own == words_of(t)
    the = [w.hash[i] for i in range(len(w)) if w.raw[w.start[i] : w.end[i]].tobytes() == b"the"]
    assert len(the) == 2 and the[0] == the[1]


def test_shingles_stay_in_their_rows():
    w = Words(pa.array(["a b c d", "a b", "", "b c d", "a"]))
    h, row, at = w.shingles(3)
    assert row.tolist() == [0, 0, 1, 3, 4]
    assert h[1] == h[3] and len(set(h.tolist())) == 4


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (10, 2000, 5, 5, 3000, 1)])
    cuts = list(slices(texts, 100))
    assert cuts[0][0] == 0 and cuts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    assert list(slices(texts[:0])) == []


def test_sliced_arrays_and_types():
    t = pa.array(["zero", "one two", None, "three"])[1:]
    for x in (t, t.cast(pa.large_string())):
        w = Words(x)
        assert np.diff(w.first).tolist() == [2, 0, 1]
