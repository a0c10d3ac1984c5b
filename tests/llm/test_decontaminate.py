import random
import re

from mixledger.llm import decontaminate as dc


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, body in items:
            x = words(body)
            if not x:
                continue
            for s in range(max(1, len(x) - 12)):
                gram = x[s : s + 13]
                for i in range(len(w) - len(gram) + 1):
                    if w[i : i + len(gram)] == gram:
                        hit.update(range(i, i + len(gram)))
                        names.update([] if item is None else [item])
        out.append((doc_id, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def sample():
    rnd = random.Random(3)
    vocab = [f"Wörd{i}" for i in range(30)] + ["it's", "x-y", "9"]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(f"i{i}", " ".join(say(n))) for i, n in enumerate([30, 14, 13, 5, 2, 1, 40])]
    items += [("i0", "a second text of one item, longer than thirteen words, is read as well here indeed")]
    items += [(None, "no name"), ("blank", " .. "), ("null", None)]
    items += [(None, "a passage whose row has lost its id is still a passage of the test set"), (None, items[2][1])]
    docs = [(1, None), (2, ""), (3, " \t.."), (40, items[-2][1]), (41, "see no name here"), (None, items[1][1]), (4, "x " * 30000 + items[0][1])]
    for i in range(5, 40):
        body = say(rnd.choice([3, 40, 300]))
        if i % 2:
            body[len(body) // 2 : len(body) // 2] = rnd.choice(items[:7])[1].upper().split()
        docs.append((i, " ".join(body)))
    return docs + docs[8:11], items


def test_contamination_matches_brute_force(spark):
    docs, items = sample()
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, items string")
    tests = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id string, text string, n_words int")
    want = brute(docs, items)
    for block in (dc.BLOCK_WORDS, 40):
        got = dc.contamination(df, tests, block_words=block).collect()
        rows = [(r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got]
        assert sorted(rows, key=repr) == want, block
    kept = dc.drop_contaminated(df, tests)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r[4] for r in want)


def test_empty_tables(spark):
    docs, items = sample()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id string, text string")
    assert dc.contamination(df.limit(0), tests).count() == 0
    none = dc.contamination(df, tests.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r.contaminated for r in none)


def test_proximity_finds_reordered_words(spark):
    docs = [(1, "alpha beta gamma"), (2, "gamma one two alpha three beta"), (3, "alpha " + "x " * 40 + "beta gamma")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    tests = spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in dc.contamination(df, tests, slop=4).collect()}
    assert got == {1: (["q"], ["q"]), 2: ([], ["q"]), 3: ([], [])}


def test_sql_agrees_with_items_without_id(spark, tmp_path):
    import duckdb

    docs, items = sample()
    docs = [(i, text) for i, (_, text) in enumerate(docs)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        want = sorted(db.execute(dc.OP8_SQL).fetchall())
    got = sorted(tuple(r) for r in dc.op8_decontamination(spark, str(tmp_path)).collect())
    assert got == want and any(r[2] and not r[3] for r in got)
