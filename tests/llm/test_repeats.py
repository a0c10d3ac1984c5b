import hashlib
import random

import numpy as np
import pytest

from mixledger.llm import repeats as rp

L, G = 24, 12


def brute(texts, length, later_only=False):
    """Per text the removed runs, by the definition; texts in order of place."""
    raws = [(t or "").encode() for t in texts]
    places = {}
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places.setdefault(raw[i : i + length], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for found in places.values():
        for d, i in found[1:] if later_only else found if len(found) > 1 else []:
            gone[d][i : i + length] = True
    return [(bytes(np.frombuffer(r, np.uint8)[~g]) if len(r) else b"", int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum())) for r, g in zip(raws, gone)]


def sample():
    rnd = random.Random(11)
    say = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (23, 24, 25, 60, 200)]
    texts = [None, "", "short", "a" * 100, "ab" * 60, say(400)]
    for _ in range(40):
        parts = [say(rnd.choice([0, 5, 80])) + rnd.choice(shared) for _ in range(rnd.choice([1, 2, 4]))]
        texts.append("".join(parts))
    base = list(say(300))
    for _ in range(25):  # near copies
        base[rnd.randrange(300)] = "X"
        texts.append("".join(base))
    return texts + [texts[10], texts[10], texts[5]]


def test_longest_previous_factor_matches_brute_force():
    rnd = np.random.default_rng(3)
    for size, letters in ((1, 1), (60, 2), (120, 3), (90, 1)):
        data = rnd.integers(97, 97 + letters, size).astype(np.uint8)
        cuts = np.sort(rnd.integers(0, size, 3))
        stops = np.array([next((c for c in cuts if c > i), size) for i in range(size)])
        for limit in (1, 2, 5, 8, 9, 16, 23):
            at = np.arange(size)
            got = rp.longest_previous_factor(rp.Suffixes(data, stops, limit, keep=True), at, at)
            whole = rp.longest_previous_factor(rp.Suffixes(data, stops, limit), at, at, True)
            want = []
            for i in range(size):
                best = 0
                for j in range(i):
                    k = 0
                    while k < limit and i + k < stops[i] and j + k < stops[j] and data[i + k] == data[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
            assert got.tolist() == want, (size, letters, limit)
            assert whole.tolist() == [limit * (w == limit) for w in want]


def test_previous_smaller():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 50):
        v = rnd.integers(0, 9, n)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert rp.previous_smaller(v).tolist() == want
    assert rp.previous_smaller(np.arange(1000)[::-1].copy()).max() == -1


@pytest.mark.parametrize("setting", ["plain", "small_batches", "all_by_hash"])
def test_removal_matches_brute_force(spark, monkeypatch, setting):
    if setting == "small_batches":
        monkeypatch.setattr(rp, "BATCH_BYTES", 64)
        monkeypatch.setattr(rp, "BUCKET_BYTES", 300)
    texts = sample()
    most = 0 if setting == "all_by_hash" else rp.MAX_CONTEXTS
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    for first in (False, True):
        got = sorted(rp.remove_repeats(docs, first, L, max_contexts=most, gram=G).collect())
        want = brute(texts, L, first)
        assert [(bytes(r.kept), r.n_removed, r.n_spans) for r in got] == want
        assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]


def test_repeated_and_null_ids(spark):
    text = "".join(random.Random(1).choice("abcdef") for _ in range(100))
    rows = [(1, text), (1, text), (None, text[10:60]), (2, "other"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rp.remove_repeats(docs, False, L, gram=G).collect()
    assert sorted(r.n_removed for r in got) == [0, 0, 50, 100, 100]
    assert rp.remove_repeats(docs.limit(0), False, L, gram=G).count() == 0


def test_full_length_and_long_texts(spark):
    rnd = random.Random(5)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    body = say(399)
    passage = say(450)
    texts = [say(700) + passage + say(10), passage + say(900), body + "1", body + "2", say(300_000) + passage, "z" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(rp.remove_repeats(docs).collect())
    want = brute(texts, 400)
    assert [(hashlib.sha256(r.kept).hexdigest(), r.n_removed, r.n_spans) for r in got] == [(hashlib.sha256(k).hexdigest(), n, s) for k, n, s in want]
