import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from mixledger.llm import sharding


def sample(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["ab", "cdé", "efghij"]) for _ in range(rnd.choice([5, 50, 200]))) for _ in range(3000)]
    texts += [texts[0]] * 1500 + ["", None, None, " ", "x y " * 20000]
    rows = [(i if i % 100 else None, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x")] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, text string, size string")


def test_balance_slots_and_groups(spark):
    rows, docs = sample(spark)
    for heavy in (sharding.HEAVY_SHARE, 1 / 300):  # all on the driver; most in slices
        got = sharding.assign(docs, 8, heavy_share=heavy, slice_groups=300).collect()
        want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        loads, slots, where, weight = Counter(), defaultdict(list), defaultdict(set), Counter()
        for r in got:
            loads[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
            where[r.group].add(r.shard)
            weight[r.group] += r["size"]
        assert sorted(loads) == list(range(8))
        assert max(loads.values()) / min(loads.values()) < 1.05, loads
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        fair = sum(loads.values()) / 8
        for g, shards in where.items():
            assert len(shards) == 1 or Counter(r.group for r in got)[g] > 100, (g, weight[g] / fair)
        giant = next(r.shard for r in got if r["size"] > 50_000)
        rowcount = Counter(r.shard for r in got if r.shard != giant)
        assert max(rowcount.values()) / min(rowcount.values()) < 1.3, rowcount
    again = sharding.assign(docs.repartition(5), 8, heavy_share=1 / 300, slice_groups=300).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_small_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    got = sharding.shard_documents(docs).collect()
    assert {r.slot for r in got} == {0} and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_place_follows_the_residual_capacity():
    room = np.array([[10.0, 1.0], [1.0, 10.0]])
    got = sharding.place(np.array([[4.0, 0.0], [0.0, 4.0], [5.0, 0.0]]), room, weights=(1, 1))
    assert got.tolist() == [0, 1, 0]
    assert np.allclose(room, [[1, 1], [1, 6]])
