import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixledger.llm import maxent as me


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]  # None: the end


def trains(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def sample(spark):
    """Two made-up languages whose words follow their own kind."""
    rnd = random.Random(12)
    langs = [[f"a{i}é" for i in range(300)], [f"B{i}" for i in range(300)]]
    rows = []
    for i in range(700):
        words = langs[i % 2]
        text = " ".join(words[int(300 * rnd.random() ** 3)] for _ in range(rnd.choice([1, 20, 60])))
        rows.append((i if i % 50 else None, text + (f" only{i}" if i % 10 == 0 else ""), "x", 1))
    rows += [(1000, None, "x", 1), (1001, "", "x", 1), (1002, "\t\n", "x", 1), (1003, "a1é " * 30000, "x", 1), rows[3], rows[3], (3, "new text", "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens int")


@pytest.mark.parametrize("head", [1 << 17, 40])
def test_base_and_known_match_brute_force(spark, head):
    rows, docs = sample(spark)
    got = me.train_and_score(docs.repartition(3), head_words=head).collect()
    counts = Counter(t for i, text, *_ in rows if trains(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text, *_ in rows:
        ts = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        want.append((repr(i), not trains(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(base, 4)))
    mine = [(repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]
    assert sorted(mine) == sorted(want)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 50
    assert all(r.score < 0 for r in got)


def test_scores_are_those_of_one_distribution(spark):
    rows, docs = sample(spark)
    training = docs.where(me.is_training(F.col("doc_id")))
    counts = me.word_counts(training).cache()
    model = me.train(training, counts, head_words=200)
    c = {bytes(r.word): r.c for r in counts.collect()}
    number = {w: i for i, w in enumerate(model.vocab.words)}
    rest, unknown = model.rest_mass()
    inside = model.in_class()
    other = len(number)

    def share(word):
        """P(word | class) and the class."""
        if word is None:
            return 1.0, me.END
        k = number.get(word, other)
        if model.classes[k] != me.REST:
            return 10 ** inside[k], model.classes[k]
        return c.get(word, unknown) / (rest + unknown), me.REST

    sums = Counter()
    for word in [*c, b"unknown word", None]:
        p, k = share(word)
        sums[int(k)] += p
    used = set(model.classes.tolist())
    assert all(abs(sums[k] - 1) < 1e-6 for k in used), sums
    got = {(r.doc_id, r.h): r.score for r in me.score(docs, counts, model).collect()}
    marks = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()
    for r in marks[:120] + marks[-7:-4]:
        words = [t.encode() if t else None for t in tokens(r.text)]
        ids = np.array([other + 1 if w is None else number.get(w, other) for w in words])
        places = me.features(ids, np.array([0]), len(model.classes))
        logs = np.log(model.probabilities(places))
        assert np.allclose(np.exp(logs).sum(axis=1), 1, atol=1e-4)
        assert np.allclose(model.log_of(places, model.classes[ids]), logs[np.arange(len(ids)), model.classes[ids]], atol=1e-3)
        want = sum(logs[k][share(w)[1]] / math.log(10) + math.log10(share(w)[0]) for k, w in enumerate(words))
        assert abs(got[r.doc_id, r.h] - want) < 1e-2 * max(1, abs(want) / 100), (r.text, want)


def test_context_stops_at_the_start_of_a_text():
    ids, starts = np.array([5, 6, 9, 9, 7, 9]), np.array([0, 3, 4])
    assert me.context(ids, starts, 1, -1).tolist() == [-1, 5, 6, -1, -1, 7]
    assert me.context(ids, starts, 2, -1).tolist() == [-1, -1, 5, -1, -1, -1]


def test_sums_by_row():
    rnd = np.random.default_rng(1)
    for rows in (rnd.integers(0, 5, 100), rnd.integers(0, 900, 100), np.array([7]), np.repeat([3, 8000], 60)):
        values = rnd.random((len(rows), 4))
        which, sums, times = me._summed(values, rows)
        assert which.tolist() == sorted(set(rows.tolist()))
        assert all(np.allclose(s, values[rows == w].sum(axis=0)) and n == (rows == w).sum() for w, s, n in zip(which, sums, times))


def test_no_training_rows_and_empty_tables(spark):
    held = [i for i in range(200) if not trains(i)][:3]
    docs = spark.createDataFrame([(i, "some words here") for i in held], "doc_id long, text string")
    got = me.train_and_score(docs).collect()
    assert len(got) == 3 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)
    assert me.train_and_score(docs.limit(0)).count() == 0
