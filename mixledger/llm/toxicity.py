"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

#: Labelled rows that the lexicon and the weights are fitted on, at most about so many, drawn by a hash of the id.
TRAIN_ROWS = 50_000
#: Of these, the share that fits the weights; the rest gives the lexicon.
WEIGHT_SHARE = 0.3
#: A learned word: in so many toxic texts, so much likelier there, so far beyond chance.
MIN_TEXTS, MIN_LOG_RATIO, MIN_Z = 3, 2.0, 4.5
#: Longest learned lexicon.
MAX_LEXICON = 20_000

# Words of the grammar.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown filthy vermin imbecile pig pigs coward fool ugly".split()
THREATS = "kill hurt destroy burn shoot stab beat strangle murder hang".split()
TARGETS = "you your yours yourself he him his she her hers they them their we us this that those these".split()
NEGATIONS = "not no never nobody neither nor without isn aren wasn weren don doesn didn cannot nicht kein keine nie pas jamais non nunca sin".split()
REPORTS = "said says say told called calls wrote writes quoted claims claimed alleged reported sagte dit dijo".split()

#: Letters of any script stay, A-Z become a-z, the marks that end a clause stay, the rest is space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b in b".!?;\n" else 32 for b in range(256)
)
_WORDS = bytes(32 if b in b".!?;\n" else b for b in range(256))
_CLAUSE = re.compile(rb"[.!?;\n]+")


# ------------------------------------------------------------------------------- transducers

#: What a word may be for the grammar, and what the grammar writes.
WORD, INSULT, THREAT, TARGET, NEGATION, REPORT = "w", "I", "H", "T", "N", "R"
NEGATED, REPORTED, AIMED, AIMED_THREAT = "i", "r", "A", "K"
SYMBOLS = [WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED, AIMED, AIMED_THREAT]
OUTCOMES = [INSULT, NEGATED, REPORTED, AIMED, THREAT, AIMED_THREAT]


@dataclass
class Transducer:
    """Deterministic weighted transducer: arcs[state][symbol] = (next state, written symbol, weight).

    A symbol without an arc is copied at weight 0 and leads to ``other[state]``. Every state is final.
    """

    arcs: dict[int, dict[str, tuple[int, str, float]]] = field(default_factory=dict)
    other: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get(state, {}).get(symbol) or (self.other.get(state, state), symbol, 0.0)

    def compose(self, after: Transducer) -> Transducer:
        """What ``after`` makes of what this one writes, as one transducer over the reachable pairs."""
        number, queue, out = {(0, 0): 0}, [(0, 0)], Transducer()
        while queue:
            pair = queue.pop()
            arcs = out.arcs.setdefault(number[pair], {})
            for symbol in SYMBOLS:
                a, middle, weight = self.step(pair[0], symbol)
                b, written, more = after.step(pair[1], middle)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    queue.append((a, b))
                arcs[symbol] = (number[a, b], written, weight + more)
        return out


def negation(reach: int = 3) -> Transducer:
    """An insult or threat up to ``reach`` words after a negation is negated and weighs less."""
    out = Transducer()
    for left in range(reach + 1):
        out.arcs[left] = {NEGATION: (reach, NEGATION, 0.0)}
        if left:
            out.arcs[left] |= {INSULT: (left - 1, NEGATED, -0.7), THREAT: (left - 1, NEGATED, -0.7)}
        out.other[left] = max(0, left - 1)
    return out


def reported_speech() -> Transducer:
    """After a word of reporting, the rest of the clause tells what others said."""
    told = {s: (1, REPORTED, -0.6) for s in (INSULT, THREAT)}
    return Transducer({0: {REPORT: (1, REPORT, 0.0)}, 1: told})


def target(reach: int = 4) -> Transducer:
    """An insult or threat up to ``reach`` words after somebody is aimed at them and weighs more."""
    out = Transducer()
    for left in range(reach + 1):
        out.arcs[left] = {TARGET: (reach, TARGET, 0.0)}
        if left:
            out.arcs[left] |= {INSULT: (left - 1, AIMED, 0.5), THREAT: (left - 1, AIMED_THREAT, 1.0)}
        out.other[left] = max(0, left - 1)
    return out


def insult() -> Transducer:
    return Transducer({0: {INSULT: (0, INSULT, 1.0)}})


def threat() -> Transducer:
    return Transducer({0: {THREAT: (0, THREAT, 1.0)}})


def grammar() -> Transducer:
    out = insult()
    for part in (threat(), negation(), reported_speech(), target()):
        out = out.compose(part)
    return out


# ------------------------------------------------------------------------------------- scoring


class Scorer:
    """Features of texts: what the composed grammar finds, clause by clause."""

    N = len(OUTCOMES) + 5

    def __init__(self, lexicon: dict[bytes, float]) -> None:
        self.lexicon = lexicon
        self.grammar = grammar()
        self.kind: dict[bytes, str] = {}
        for words, kind in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)):
            self.kind |= {w.encode(): kind for w in words}
        self.kind |= dict.fromkeys(lexicon, INSULT)
        self.marks = {w for w, k in self.kind.items() if k in (INSULT, THREAT)}

    def features(self, text: str | None) -> list[float]:
        """1, counts of each outcome, best clause, sum of clauses, words' weights, distinct insults."""
        out = [0.0] * self.N
        out[0] = 1.0
        folded = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
        if self.marks.isdisjoint(folded.translate(_WORDS).split()):
            return out
        counts, best, total, lexical, seen = Counter(), 0.0, 0.0, 0.0, set()
        for clause in _CLAUSE.split(folded):
            words = clause.split()
            if self.marks.isdisjoint(words):
                continue
            state, weight = 0, 0.0
            for word in words:
                state, written, w = self.grammar.step(state, self.kind.get(word, WORD))
                if w:
                    own = self.lexicon.get(word, 1.0)
                    counts[written] += 1
                    weight += w * own
                    lexical = max(lexical, own)
                    seen.add(word)
            best, total = max(best, weight), total + weight
        out[1 : 1 + len(OUTCOMES)] = [math.log1p(counts[o]) for o in OUTCOMES]
        out[-4:] = [math.log1p(max(0.0, best)), math.log1p(max(0.0, total)), lexical, math.log1p(len(seen))]
        return out


#: Weights where no labels are given: a few aimed insults in a text make it toxic.
DEFAULT_WEIGHTS = [-3.0, 0.5, 0.0, 0.0, 1.0, 0.5, 1.0, 1.0, 1.0, 0.2, 1.0]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps on the penalized likelihood; the first column is the constant."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * max(1.0, len(y) ** 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: dict[bytes, float]
    weights: list[float]


def _term_counts(train: DataFrame) -> DataFrame:
    """(term, toxic, clean): texts that hold a word, over the training texts (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_FOLD).translate(_WORDS).split()
                both[toxic].update(set(words))
        terms = list(both[0].keys() | both[1].keys())
        cols = [pa.array(terms, pa.binary()), pa.array([both[1][t] for t in terms], pa.int64()), pa.array([both[0][t] for t in terms], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["term", "toxic", "clean"])

    each = train.select("text", "toxic").mapInArrow(run, "term binary, toxic bigint, clean bigint")
    return each.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for batch in batches:
            found = [scorer.features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            cols = [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "x"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{schema}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from labelled texts (doc_id, toxic 0/1).

    At most about ``train_rows`` labels are used, drawn by a hash of the id; their ids are a bounded
    table. Texts that are copies of one another count once. Words go into the lexicon when
    they are toxic beyond chance; the weights are fitted on other texts than the lexicon, so that
    they know how far it can be trusted.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n = known.count()
    model = Model({w.encode(): 1.0 for w in INSULTS}, list(DEFAULT_WEIGHTS))
    if not n:
        return model
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30))
    some = known.where(draw < math.ceil((1 << 30) * min(1.0, train_rows / n)))
    some = some.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).join(F.broadcast(some), "doc_id")
    firsts = hashed.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("f")).select("f.doc_id", "f.toxic", "h")
    train_ids = docs.sparkSession.createDataFrame(firsts.toPandas(), "doc_id long, toxic int, h long")
    train = docs.select("doc_id", "text").join(F.broadcast(train_ids), "doc_id").where(F.xxhash64("text") == F.col("h"))
    for_weights = F.pmod(F.xxhash64("h", F.lit("fold")), F.lit(1000)) < int(1000 * WEIGHT_SHARE)
    words = train.where(~for_weights)
    share = train_ids.where(~for_weights).groupBy("toxic").count().toPandas().set_index("toxic")["count"]
    n_toxic, n_clean = float(share.get(1, 0)), float(share.get(0, 0))
    if n_toxic and n_clean:
        terms = _term_counts(words)
        ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
        expected = (F.col("toxic") + F.col("clean")) * (n_toxic / (n_toxic + n_clean))
        z = (F.col("toxic") - expected) / F.sqrt(expected)
        found = terms.where((F.col("toxic") >= MIN_TEXTS) & (ratio >= MIN_LOG_RATIO) & (z >= MIN_Z))
        top = found.select("term", ratio.alias("ratio"), z.alias("z")).orderBy(F.desc("z"), "term").limit(MAX_LEXICON)
        model.lexicon |= {bytes(r.term): float(r.ratio) for r in top.collect()}
    rows = _features(train.where(for_weights), model, ["toxic"]).toPandas()
    if rows["toxic"].nunique() == 2:
        x = np.array(rows["x"].tolist(), float)
        model.weights = fit_logistic(x, rows["toxic"].to_numpy(float)).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, h, score) for every row, h a hash of the text. Only the text is read."""
    weights = np.array(model.weights)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    found = _features(keyed, model, ["doc_id", "h"])
    terms = [F.element_at("x", i + 1) * float(w) for i, w in enumerate(weights)]
    logit = terms[0]
    for term in terms[1:]:
        logit = logit + term
    return found.select("doc_id", "h", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))).alias("score"))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels of held-out ids (crc32 of the id as text divisible by 5) are never read. Null and empty texts get
    the score of a text in which nothing is found; a null id is not held out. Without usable
    labels the default weights hold. Repeated rows get equal scores.
    """
    model = fit(docs, labels.where(~is_held_out(F.col("doc_id"))))
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return score(docs, model).select(
        "doc_id", "h", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic, in all their columns; judged where they stand."""
    short_batches(docs.sparkSession)
    model = fit(docs, labels.where(~is_held_out(F.col("doc_id"))))
    weights = np.array(model.weights)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model.lexicon)
        for texts in batches:
            x = np.array([scorer.features(t.as_py()) for t in texts]).reshape(len(texts), Scorer.N)
            yield pa.array(x @ weights < 0)

    return docs.where(clean("text"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = grade(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
