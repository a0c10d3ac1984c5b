import random
import re
from collections import Counter

from mixledger.llm import collocations as co


def slow(rows, least, share=80, top=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        inside = [
            f for (other, q), f in candidates.items()
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
        ]
        if any(100 * f >= share * a for f in inside):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def texts(seed, n=120):
    rnd = random.Random(seed)
    words = ["a", "B", "c\x01", "é", "É", "zz", "\U0001f600", "I", "i"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(40)):
            parts += rnd.choice([["a", "b", "c\x01"], ["É", "zz"], [rnd.choice(words)], ["x", "Y", "z", "q"], ["u"] * 5])
        seps = [" ", "\t", "  ", " ", " ", ". ", ",", "\n", "\x0b"]
        rows.append((rnd.choice(["en", "en", "fr", None, "und"]), "".join(p + rnd.choice(seps) for p in parts)))
    return rows + [("en", None), (None, ""), ("en", " . , "), (None, None), rows[0], rows[0]]


def test_matches_the_slow_version(spark, monkeypatch):
    rows = texts(3)
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, n string, f int")
    for least in (2, 5, 30):
        assert sorted(map(tuple, co.collocations(docs, least).collect())) == slow(rows, least)
    assert sorted(map(tuple, co.collocations(docs, 5, top=3).collect())) == slow(rows, 5, top=3)
    assert co.collocations(docs.limit(0)).count() == 0


def test_small_holds_slices_and_no_pruning_change_nothing(spark, monkeypatch):
    rows = texts(4, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = slow(rows, 4)
    plain = co.collocations(docs, 4)
    assert sorted(map(tuple, plain.collect())) == want
    # One bucket block of eight buckets prunes nothing.
    few = co.phrase_counts(docs.select("lang", "text").na.fill("und", ["lang"]).na.fill("", ["text"]), 4)
    monkeypatch.setattr(co, "MAX_BUCKET_BITS", 3)
    all_kept = co.phrase_counts(docs.select("lang", "text").na.fill("und", ["lang"]).na.fill("", ["text"]), 4)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, all_kept.collect()))


def test_tokens_do_not_depend_on_slices(monkeypatch):
    text = "Ab c.\td,é  f\n" * 50
    whole = [w for part in co.tokens(text.encode()) for w in part]
    monkeypatch.setattr(co, "SLICE", 3)
    assert [w for part in co.tokens(text.encode()) for w in part] == whole
    assert whole[:6] == [b"ab", b"c", co.BREAK, b"d", co.BREAK, "é".encode()]


def test_held_words_are_let_go_between_texts(monkeypatch):
    monkeypatch.setattr(co, "HELD_WORDS", 4)
    monkeypatch.setattr(co, "HELD_DISTINCT", 6)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 6), pa.array([f"a{i} b{i} a{i}" for i in range(6)])], names=["lang", "text"])
    held, seen = co.Held(), 0
    for _ in co._groups(iter([batch]), held):
        ids, lang = held.arrays()
        assert len(ids) == len(lang) + 3
        seen += int((ids != 0).sum())
    assert seen == 18


def test_products_past_64_bits_are_exact(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit(2**62).alias("a"), F.lit(2**62).alias("l"), F.lit(2**62 + 7).alias("r"))
    row = row.select((co._wide("a") * 2000000).alias("top"), (co._wide("l") + co._wide("r")).alias("below"))
    assert row.select(F.expr("top div below").alias("s")).first().s == 2000000 * 2**62 // (2**63 + 7)
