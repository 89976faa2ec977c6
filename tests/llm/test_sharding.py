from collections import Counter

from corpusloom.llm import sharding as S


def test_maps_and_versions(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    usage = S.slot_bytes(docs, 256)
    assert usage.count() == 256 and usage.agg({"n_bytes": "sum"}).first()[0] == sum(i % 50 for i in range(3000))
    maps = S.SlotMap(spark, f"file://{tmp_path}/map")
    assert maps.put(S.first_map(usage, 8)) == 1
    assert maps.put(S.grown_map(maps.get(1), 11)) == 2
    one, two = ({r.slot: (r.shard, r.n_bytes) for r in maps.get(v).collect()} for v in (1, 2))
    moved = [s for s in one if one[s][0] != two[s][0]]
    assert all(two[s][0] >= 8 for s in moved) and 0 < len(moved) < 256 * 3 / 11 * 1.5
    load = Counter()
    for shard, b in two.values():
        load[shard] += b
    total = sum(load.values())
    assert max(load.values()) < 1.3 * total / 11
    placed = S.assign(docs, maps.get(2), 256).collect()
    assert len(placed) == 3000 and all(two[r.slot][0] == r.shard for r in placed)


def test_odd_documents(odd, none):
    got = S.assign(odd, S.first_map(S.slot_bytes(odd), 4)).collect()
    assert len(got) == odd.count() and len({r.slot for r in got if r.doc_id == 2}) == 1
    empty = S.first_map(S.slot_bytes(none), 4)
    assert {r.shard for r in empty.collect()} == {0} and S.assign(none, empty).collect() == []
