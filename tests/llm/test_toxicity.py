import math
import random

import pytest

from mixledger.llm import toxicity as tx


def outcomes(text):
    scorer = tx.Scorer({w.encode(): 1.0 for w in tx.INSULTS})
    x = scorer.features(text)
    return {o: round(math.expm1(v)) for o, v in zip(tx.OUTCOMES, x[1:]) if v}


def test_clauses_are_read_as_a_whole():
    assert outcomes("A plain sentence, you know.") == {}
    assert outcomes("what scum") == {tx.INSULT: 1}
    assert outcomes("You are an IDIOT!") == {tx.AIMED: 1}
    assert outcomes("I am not an idiot") == {tx.NEGATED: 1}
    assert outcomes("not now, as it went on and on, idiot") == {tx.INSULT: 1}
    assert outcomes("the paper said idiot and scum") == {tx.REPORTED: 2}
    assert outcomes("the paper said so. idiot") == {tx.INSULT: 1}
    assert outcomes("they will hurt") == {tx.AIMED_THREAT: 1}
    assert outcomes("scum### idiot***") == {tx.INSULT: 2}
    assert outcomes(None) == outcomes("") == {}


def test_composition_equals_running_one_after_the_other():
    rnd = random.Random(1)
    parts = [tx.insult(), tx.threat(), tx.negation(), tx.reported_speech(), tx.target()]
    whole = tx.grammar()
    for _ in range(300):
        states, state = [0] * len(parts), 0
        for symbol in (rnd.choice(tx.SYMBOLS[:6]) for _ in range(12)):
            state, written, weight = whole.step(state, symbol)
            total = 0.0
            for i, part in enumerate(parts):
                states[i], symbol, w = part.step(states[i], symbol)
                total += w
            assert written == symbol and abs(weight - total) < 1e-9


def sample(spark):
    rnd = random.Random(2)
    vocab = [f"word{i}" for i in range(300)]
    slurs = ["zorgle", "blémish", "quax"]
    docs, labels = [], []
    for i in range(900):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([5, 60]))]
        toxic = i % 6 == 0
        if toxic:
            for w in rnd.sample(slurs, 2):
                words.insert(rnd.randrange(len(words)), rnd.choice([w, w.title(), w + "!!"]))
        docs.append((i, " ".join(words), "x", 0.5))
        labels.append((i, int(toxic), 1))
    docs += [(None, None, "x", 0.1), (2000, "", None, None), (2001, "you zorgle " * 20000, "x", 1.0), docs[3], docs[0]]
    labels += [(None, 1, 1), (5000, None, 1), labels[0], (7000, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string, score double"),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
    )


def test_learned_words_hold_on_held_out_rows(spark):
    docs, labels = sample(spark)
    got = tx.grade(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert len(held) > 100
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert by_id[2001].predicted == 1 and by_id[None].predicted == by_id[2000].predicted == 0
    assert not by_id[None].held_out and all(0 <= r.score <= 1 for r in got)
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)


def test_held_out_labels_are_not_read(spark):
    docs, labels = sample(spark)
    held = tx.is_held_out(tx.F.col("doc_id"))
    flipped = labels.withColumn("toxic", tx.F.when(held, 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    a, b = (sorted((repr(r.doc_id), r.score) for r in tx.grade(docs, x).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("which", ["docs", "labels"])
def test_empty_tables(spark, which):
    docs, labels = sample(spark)
    if which == "docs":
        assert tx.grade(docs.limit(0), labels).count() == 0
    else:
        got = {r.doc_id: r.predicted for r in tx.grade(docs, labels.limit(0)).collect()}
        assert got[1] == 0 and len(got) == docs.select("doc_id").distinct().count()
