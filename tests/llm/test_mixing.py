import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from mixledger.llm import mixing


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        active = sum(weight[s] for s in names if s not in stopped)
        target = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / active for s in names}
        over = {s for s in names if s not in stopped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        stopped |= over


def sample(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        source = rnd.choice(["b", "b", "b", "b", "a", "é", "z", None, "tiny"]) if i % 50 else "tiny"
        text = " ".join("w" for _ in range(rnd.choice([1, 30, 400])))
        rows.append((i if i % 40 else None, text, source, "x", 1))
    rows += [(700, None, "a", "x", 1), (701, "", "nothing", "x", 1), (702, "\t \n", None, "x", 1), (703, "w " * 30000, "z", "x", 1)]
    rows += rows[5:8] + [(5, "other text", "a", "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target string, taken int")


def test_targets_and_taken(spark):
    rows, docs = sample(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, text, source, _, _ in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = slow_targets(dict(size))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= mixing.BLOCK_WORDS for s in want), (taken, want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    empty = mixing.mix(docs.limit(0))
    assert empty.count() == 0


def test_slots_use_every_block_evenly(spark):
    rows, docs = sample(spark)
    _, sizes = mixing.pack(docs)
    planned = mixing.plan(sizes)
    dealt = mixing.slots(spark, planned, 64).collect()
    by_source = defaultdict(list)
    for r in dealt:
        by_source[r.source].append((r.epoch, r.block))
    for p in planned.collect():
        mine = by_source[p.source]
        assert len(mine) == p.slots == len(set(mine))
        uses = Counter(b for _, b in mine)
        assert not mine or max(uses.values()) - min(uses.get(b, 0) for b in range(p.blocks)) <= 1
    # Slots are dealt over the shards: no shard is of one source.
    shards = defaultdict(set)
    for r in dealt:
        shards[r.shard].add(r.source)
    assert min(len(v) for v in shards.values()) > 1


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k")).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_repeated_documents_come_near_the_targets(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (i % 37 + 5), "abcd"[min(3, i % 7)], "x") for i in range(4000)], "doc_id long, text string, source string, size string"
    )
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    want = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(words[s] / want[s] - 1) < 0.1 for s in want)
    assert mixing.repeat_documents(docs.limit(0)).count() == 0
