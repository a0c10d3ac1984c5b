import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from mixledger.llm import prefixes
from mixledger.operators import scan as scans


def slow(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    for turns in own.values():
        turns.sort()
    turns = {c: [t[1:] for t in ts] for c, ts in own.items()}
    nodes, total = defaultdict(list), {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = turns.get(base, [])[:h] + mine[h:]
        total[c] = len(path)
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    out = []
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        words = len([w for w in __import__("re").split(b"[\x20\x09-\x0d]+", p[-1][1]) if w]) if p else 0
        leaves, saved = (0 if kids[p] else 1), (len(nodes[p]) - 1) * words
        for k in kids[p]:
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    for p, members in nodes.items():
        leaves, saved = below(p)
        ended = ",".join(str(c) for c in sorted(c for c in members if total[c] == len(p)))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids[p]), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(0, 90), 1000, 1019, -3, -20, -25, 10**15, 10**15 + 1]:
        if c in (40, 60):
            continue
        for t in range(rnd.choice([1, 1, 2, 3, 5, 7])):
            text = rnd.choice(["hi", "hi there", " a  b\tc", "", "é ü\x0bx", None])
            rows.append((c, rnd.choice([t, t, None]) if c % 7 == 0 else t, rnd.choice(["user", "assistant", None]), text))
    rows += [(c, t, "user", "same text") for c in range(200, 240) for t in range(6)]
    rows += rows[:5] + [(None, 1, "user", "lost"), (300, 0, "u", "word " * 30000), (301, 0, "u", "word " * 30000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_slow_version(spark, seed):
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA + ", depth int, least string")
    assert sorted(map(tuple, prefixes.prefix_trie(table).collect()), key=repr) == slow(rows)


def test_large_conversations_and_heavy_nodes_take_other_paths_to_the_same_rows(spark, monkeypatch):
    rows = conversations(3) + [(400, t // 3, "user", f"t{t % 5}") for t in range(300)]
    monkeypatch.setattr(prefixes, "HEAVY_SHARE", 20)
    plain = scans.hot_groups
    monkeypatch.setattr(scans, "hot_groups", lambda df, keys, light_rows=None: plain(df, keys, 50))
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, prefixes.prefix_trie(table).collect()), key=repr) == slow(rows)


def test_empty_and_turnless(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert prefixes.prefix_trie(table).count() == 0
    lone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "gone")]
    got = sorted(map(tuple, prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == slow(rows) and got[0][1:] == (0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())


def test_powers_and_fingerprints_compose(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*(prefixes.power(F.lit(e).cast("long")).alias(f"p{e}") for e in (0, 1, 2, 65537, 2**38 + 5))).first()
    assert list(row) == [pow(prefixes.BASE, e, prefixes.PRIME) for e in (0, 1, 2, 65537, 2**38 + 5)]
    back = spark.range(4).select(prefixes.shifted(F.lit(123456).cast("long"), F.col("id")).alias("s")).collect()
    assert [r.s * pow(prefixes.BASE, i, prefixes.PRIME) % prefixes.PRIME for i, r in enumerate(back)] == [123456] * 4


def test_equal_lanes_of_different_turns_are_found(spark, monkeypatch):
    table = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "b")], SCHEMA)
    assert not prefixes.turns_differ(table, 0)
    monkeypatch.setattr(prefixes, "PRIME", 1)
    assert prefixes.turns_differ(table, 0)
    with pytest.raises(RuntimeError):
        prefixes.prefix_trie(table)
