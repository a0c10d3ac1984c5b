import itertools
import random

import xxhash

from mixledger.llm import simhash
from mixledger.operators.graph import components


def slow_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - 2**64 if value >= 2**63 else value


def brute_components(rows):
    """Union by every pair of rows within two bits; label: the least id."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if bin((rows[i][1] ^ rows[j][1]) % 2**64).count("1") <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((k, f, least.get(find(i))) for i, (k, f) in enumerate(rows)), key=repr)


TEXTS = ["A b  c\td É", "a B c d É", "", None, " \n", "one", "one two", "x " * 5000 + "end", "é" * 300]


def test_fingerprint_matches_the_definition():
    for text in TEXTS:
        assert simhash.fingerprint(text) == slow_fingerprint(text), text


def test_components_of_texts_match_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = list(TEXTS)
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 60, 200]))]
        for _ in range(4):
            texts.append(" ".join(base))
            base[rnd.randrange(len(base))] = rnd.choice(words)
    rows = [(i if i % 9 else None, t, "extra", 1) for i, t in enumerate(texts)] + [(3, texts[9], None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component int")
    got = sorted(map(tuple, simhash.near_components(docs).collect()), key=repr)
    assert got == brute_components([(r[0], slow_fingerprint(r[1])) for r in rows])
    kept = simhash.keep_first(docs).collect()
    firsts = {c for _, _, c in got if c is not None}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(firsts)
    assert sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in rows)
    assert simhash.near_components(docs.limit(0)).count() == 0
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_near_pairs_match_brute_force(spark):
    rnd = random.Random(1)
    values = set()
    for _ in range(30):
        base = rnd.getrandbits(64)
        for _ in range(12):
            v = base
            for b in rnd.sample(range(64), rnd.choice([0, 1, 2, 3])):
                v ^= 1 << b
            values.add(v - 2**64 if v >= 2**63 else v)
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) % 2**64).count("1") <= 2}
    got = simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (900, 800), (800, 900)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(201)}, 900: 800, 800: 800}
