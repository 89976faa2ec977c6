import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import token_coding as T
from corpusloom.llm.tokenizer import VOCABULARY, encoding, read_ranks


def round_trip(runs):
    counts = np.array([len(r) for r in runs], np.int64)
    words, per, blocks = T.encode(np.array([x for r in runs for x in r], np.uint64), counts)
    edge, first = np.append(0, np.cumsum(per)), np.append(0, np.cumsum(blocks))
    for k, r in enumerate(runs):
        w, o = words[edge[first[k]] : edge[first[k + 1]]], edge[first[k] : first[k + 1]] - edge[first[k]]
        assert T.decode(w, o, len(r)).tolist() == list(r)
    return words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), max_size=5))
def test_round_trip(runs):
    round_trip(runs)


def test_words_are_as_few_as_the_greedy_rule_gives():
    assert len(round_trip([[0] * 128])) == 2 and len(round_trip([[1] * 60])) == 1 and len(round_trip([[50_000] * 9])) == 3
    assert len(round_trip([[2**63]])) == 2 and len(round_trip([[]])) == 0


def test_one_block_is_decoded_alone():
    ids = np.arange(1000)
    words, per, _ = T.encode(ids, np.array([1000]))
    at = int(per[:3].sum())
    assert T.decode(words[at : at + per[3]], np.array([0]), 128).tolist() == list(range(384, 512))


def test_table(odd, none):
    coded = T.write_ids(odd)
    rows = coded.collect()
    assert len(rows) == odd.count() and all(len(r.block_offsets) == -(-r.n_tokens // T.BLOCK) for r in rows)
    assert next(r for r in rows if r.doc_id == 3).words is None and next(r for r in rows if r.doc_id == 4).words == b""
    enc = encoding(read_ranks(VOCABULARY))
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in T.read_ids(coded).collect():
        assert (r.ids is None) == (texts[r.doc_id] is None)
        if r.ids:
            assert enc.decode(r.ids) == texts[r.doc_id]
    assert T.write_ids(none).collect() == [] and T.read_ids(T.write_ids(none)).collect() == []


@pytest.mark.parametrize("n", [1, 127, 128, 129])
def test_block_edges(n):
    round_trip([list(range(n)), list(range(n))])
