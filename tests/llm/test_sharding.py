import hashlib

import numpy as np
import pytest

from gatewatch.llm import sharding


def plain_table(names, slots):
    """Written-out preference lists, shards taking turns."""
    prefer = []
    for s in names:
        o, k = sharding.draw("offset:" + s) % slots, sharding.draw("skip:" + s) % (slots - 1) + 1
        prefer.append([(o + j * k) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for i, p in enumerate(prefer):
            free = next((x for x in p if x not in table), None)
            if free is not None:
                table[free] = i
    return [table[x] for x in range(slots)]


def test_table_equals_brute_force_and_is_even():
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    assert table.tolist() == plain_table(names, 101)
    count = np.bincount(table)
    assert count.max() - count.min() <= 1


def test_few_slots_move_when_a_shard_goes():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(names, 10_007), sharding.lookup_table(names[:-1], 10_007)
    assert ((a != b) & (a != 19)).mean() < 0.1


def test_bad_parameters():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 1, 1)):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, slots)


def test_placement(spark):
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (None, None, 2), (7, "", 3)], "doc_id long, Shard string, _slot int")
    rows = sharding.assign_shards(df, "doc_id", names, 101).collect()
    table = sharding.lookup_table(names, 101)
    for r in rows:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    assert sorted(r["_slot"] for r in rows) == [0, 1, 2, 3]
    assert sharding.assign_shards(df.limit(0), "doc_id", names, 101).collect() == []
