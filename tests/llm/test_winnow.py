import hashlib
import random

from pyspark.sql import functions as F

from mixledger.llm import winnow as wn

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def chosen(grams, window):
    """Positions by the definition: of each window the least hash, of equal ones the rightmost."""
    found = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[i : i + window]
        at = i + max(j for j, g in enumerate(part) if g == min(part))
        if at not in found:
            found.append(at)
    return found


def rows():
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(12)] + ["é", "日本"]
    texts = [None, "", " \t", "one", "a b c d", "x " * 20000, "a a a a a a a a a a"]
    for _ in range(60):
        texts.append(rnd.choice(WHITE).join(rnd.choice(vocab) for _ in range(rnd.choice([4, 9, 60, 300]))))
    out = [(i * 7 if i != 20 else None, t, "x") for i, t in enumerate(texts)]
    return out + [out[30], (210, "other text of the same id", "x"), (10**15, "far away", "x")]


def test_winnowing_matches_the_definition(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, own string")
    mask = ~((1 << wn.POSITION_BITS) - 1)
    gram = F.col("g")
    for r in docs.select("text", wn.winnow(F.col("text")).alias("got")).collect():
        w = words(r.text or "")
        grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0)]
        distinct = sorted(set(grams))
        pairs = spark.createDataFrame([(list(g),) for g in distinct] or [([],)], "g array<string>")
        hashed = pairs.select(F.xxhash64(F.transform(gram, lambda x: F.xxhash64(x))).alias("h")).collect() if len(distinct) < 400 else None
        if hashed is None:
            continue
        value = {g: h.h & mask for g, h in zip(distinct, hashed)}
        hashes = [value[g] for g in grams]
        want = [(hashes[p], p) for p in chosen(hashes, wn.WINDOW)]
        assert [(x["hash"], x.pos) for x in r.got] == want


def test_edited_texts_and_likeness(spark, monkeypatch):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, own string").repartition(3)
    for size in (500, 3):  # one chunk; many
        monkeypatch.setattr(wn, "CHUNK_ROWS", size)
        got = wn.fingerprint_edits(docs).collect()
        assert len(got) == len(data)
        prints = {}
        for r in docs.select("doc_id", "text", wn.winnow(F.col("text")).alias("v")).collect():
            prints[r.text or ""] = {x["hash"] for x in r.v}
        order = {r.h: r.text for r in docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text")).collect()}
        by_hash = {t: h for h, t in order.items()}
        ranked = sorted(((-1 if i is None else i), by_hash[t or ""], t or "") for i, t, _ in data)
        want = []
        for k, (i, _, text) in enumerate(ranked):
            nxt = ranked[(k + 1) % len(ranked)][2]
            half = len(text) // 2
            edited = text[: len(text) - half] + nxt[:half]
            a, b = prints[text], prints[nxt]
            near = len(a & b) / len(a | b) if a | b else 1.0
            want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near, 9)))
        mine = [(-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_next, 9)) for r in got]
        assert sorted(mine) == sorted(want)
        same = {}
        for r in got:
            same.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert len(same[30 * 7]) == 2  # two texts of one id; the repeated row adds none
        assert all(0 <= r.near_edited <= 1 for r in got)
    assert wn.fingerprint_edits(docs.limit(0)).count() == 0
    assert wn.fingerprint_edits(docs.where("doc_id = 49")).count() == 1


def test_shared_run_has_a_common_fingerprint(spark):
    run = " ".join(f"s{i}" for i in range(wn.GRAM_WORDS + wn.WINDOW - 1))
    docs = spark.createDataFrame([("a b c " + run + " d",), ("e " + run + " f g h",)], "text string")
    a, b = ({x["hash"] for x in r.v} for r in docs.select(wn.winnow(F.col("text")).alias("v")).collect())
    assert a & b
