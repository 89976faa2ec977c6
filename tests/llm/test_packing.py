import pyarrow as pa
import pytest

from corpusloom.llm import packing as P


def brute(lengths, capacity):
    room, cost, out = [capacity] * -(-sum(lengths) // capacity), [0.0] * -(-sum(lengths) // capacity), []
    for n in lengths:
        fit = [(cost[k], k) for k in range(len(room)) if room[k] >= n]
        if not fit:
            room.append(capacity)
            cost.append(0.0)
            fit = [(0.0, len(room) - 1)]
        k = min(fit)[1]
        room[k] -= n
        cost[k] += P.cost(n)
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_assignment_equals_the_plain_rule(seed):
    import random

    rng = random.Random(seed)
    lengths = sorted((rng.choice([1, 5, 5, 7, rng.randint(1, 64)]) for _ in range(rng.randint(1, 200))), reverse=True)
    assert P.assign(lengths, 64) == brute(lengths, 64)


def test_lengths_are_packed_whole(spark):
    rows = [(i, n) for i, n in enumerate([5, 300, 64, 64, 1, 0, 129, 7] * 30)] + [(None, 9), (3, 64)]
    got = P.pack_lengths(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 64, per_group=50).collect()
    assert sum(r.n_tokens for r in got) == sum(n for _, n in rows)
    assert all(r.n_tokens <= 64 and r.start == 64 * r.piece for r in got)
    used = {}
    for r in got:
        used[r.group, r.sequence] = used.get((r.group, r.sequence), 0) + r.n_tokens
    assert max(used.values()) <= 64 and len({r.group for r in got}) > 1
    assert len({(r.group, r.sequence, r.slot) for r in got}) == len(got)


def test_odd_documents(odd, none):
    got = P.pack(odd, capacity=512).collect()
    ids = [r.doc_id for r in got]
    assert {3, 4}.isdisjoint(ids) and None in ids and ids.count(6) > 10
    assert sum(r.doc_id == 2 for r in got) == 2
    assert P.pack(none).collect() == []
    with pytest.raises(ValueError):
        P.pack_lengths(odd, 0)


def test_token_counts():
    from corpusloom.llm.tokenizer import VOCABULARY, encoding, read_ranks

    ranks = read_ranks(VOCABULARY)
    texts = ["Hello world", None, "", "<|endoftext|> é"]
    counts = P.token_counts(pa.array(texts), ranks).to_pylist()
    assert counts == [len(encoding(ranks).encode_ordinary(t or "")) for t in texts] and counts[1:3] == [0, 0]


def test_texts_are_tokenised_once(odd):
    plan = P.pack(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
