"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_words, staged, table

#: Words that tasks look up in memory; the others are counted and joined as rows.
HEAD_WORDS = 1 << 17
#: Words that get a class by their neighbours, and how many neighbours describe them.
CLASSED_WORDS = 4096
NEIGHBOURS = 32
#: Classes: the end, the rest (words without a class of their own, and unknown ones), and clusters.
CLASSES = 48
END, REST, FIRST_CLUSTER = 0, 1, 2
#: Rows of the hashed feature table.
FEATURES = 1 << 13
#: Rounds of gradient updates; each takes its own part of the training documents, so all are read once.
ROUNDS = 3
BATCH_TOKENS = 4096
RATE = 0.25
#: Tokens that one pass holds at once.
CHUNK_TOKENS = 1 << 18
#: Different words that a counting task holds before it sends them.
HELD_WORDS = 200_000
BLOCK_ROWS = 64  # feature rows or words that travel and are added up together


def is_training(doc_id: Column) -> Column:
    """Held out are ids whose crc32 as text leaves 2 modulo 7; a null id trains."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


# ------------------------------------------------------------------------------------ counting


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): how often each word occurs in all of ``docs``. Tasks add up what they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = [pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.update(lower_words(text.as_py()))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(text_col).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The head of the counts, most frequent first, and the totals of all of them."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int  # N: all training tokens, ends included
    types: int  # V: different training tokens, the end included
    ends: int
    once: int  # words seen once: the best guess of how many tokens are unknown words


def vocabulary(counts: DataFrame, ends: int, head_words: int = HEAD_WORDS) -> Vocabulary:
    """At most ``head_words`` words reach the driver: those above a count found from a histogram."""
    size = F.floor(F.log2("c") * 8).cast("int")
    rows = counts.groupBy(size.alias("size")).agg(
        F.count("*").alias("n"), F.sum("c").alias("t"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("once")
    ).collect()
    least, taken = None, 0
    for r in sorted(rows, key=lambda r: -r["size"]):
        if taken + r.n > head_words:
            break
        least, taken = r["size"], taken + r.n
    head = counts.where(size >= least).toPandas() if least is not None else pd.DataFrame({"word": [], "c": []})
    pairs = sorted(zip(map(bytes, head["word"]), head["c"].tolist()), key=lambda p: (-p[1], p[0]))
    tokens = sum(r.t for r in rows) + ends
    return Vocabulary(
        [w for w, _ in pairs], np.array([c for _, c in pairs], np.int64), tokens, sum(r.n for r in rows) + (ends > 0), ends, sum(r.once for r in rows)
    )


# ----------------------------------------------------------------------------------- tokenizing


class Reader:
    """Texts as rows of word numbers: 0 .. the head by frequency, then one number for all others."""

    def __init__(self, words: list[bytes]) -> None:
        self.index = {w: i for i, w in enumerate(words)}
        self.other, self.end = len(words), len(words) + 1

    def read(self, words: list[bytes]) -> np.ndarray:
        get, other = self.index.get, self.other
        return np.fromiter(chain(map(get, words, repeat(other)), (self.end,)), np.int32, len(words) + 1)


def context(ids: np.ndarray, starts: np.ndarray, back: int, before: int) -> np.ndarray:
    """The number ``back`` places before each place, ``before`` where the text has not so many."""
    out = np.full(len(ids), before, np.int64)
    out[back:] = ids[:-back]
    for k in range(back):
        at = starts + k
        out[at[at < len(ids)]] = before
    return out


def features(ids: np.ndarray, starts: np.ndarray, none: int) -> list[np.ndarray]:
    """Rows of the feature table: word before, two words before, and the word before last alone."""
    ids = ids.astype(np.int64)
    one, two = context(ids, starts, 1, none), context(ids, starts, 2, none)

    def row(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(len(ids), kind, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(11)).astype(np.int64) % FEATURES

    return [row(1, one), row(2, one, two), row(3, two)]


# -------------------------------------------------------------------------------------- classes


def neighbour_counts(docs: DataFrame, vocab: Vocabulary, text_col: str = "text") -> np.ndarray:
    """For each classed word, how often each of the most frequent words stands before or after it."""
    words, classed = vocab.words, min(CLASSED_WORDS, len(vocab.words))
    if not classed:
        return np.zeros((0, 2 * NEIGHBOURS))
    width = 2 * NEIGHBOURS
    blocks = math.ceil(classed / BLOCK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words[:classed])
        total = np.zeros((blocks * BLOCK_ROWS, width), np.int64)
        for batch in batches:
            for text in batch.column(0):
                ids = reader.read(lower_words(text.as_py()))[:-1].astype(np.int64)
                if len(ids) < 2:
                    continue
                near = np.minimum(ids, NEIGHBOURS - 1)
                pairs = [ids[1:] * width + near[:-1], ids[:-1] * width + NEIGHBOURS + near[1:]]
                flat = np.concatenate(pairs)
                flat = flat[flat < classed * width]
                if len(flat) > classed * width // 8:
                    total += np.bincount(flat, minlength=total.size).reshape(total.shape)
                else:
                    np.add.at(total.reshape(-1), flat, 1)
        yield _block_rows(total)

    each = docs.select(text_col).mapInArrow(run, _BLOCK_SCHEMA)
    return _added(each, blocks, width)[:classed]


_BLOCK_SCHEMA = "block int, data binary"


def _block_rows(total: np.ndarray) -> pa.RecordBatch:
    parts = total.reshape(-1, BLOCK_ROWS, total.shape[1]).astype(np.float32)
    used = np.flatnonzero(np.abs(parts).sum(axis=(1, 2)))
    return pa.RecordBatch.from_arrays(
        [pa.array(used.tolist(), pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["block", "data"]
    )


def _added(each: DataFrame, blocks: int, width: int) -> np.ndarray:
    """Blocks added up by number, one row for each at the driver: a matrix of fixed size."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK_ROWS * width, np.float64)
        for data in frame["data"]:
            total += np.frombuffer(data, np.float32)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "data": [total.astype(np.float32).tobytes()]})

    out = np.zeros((blocks, BLOCK_ROWS, width))
    for r in each.groupBy("block").applyInPandas(run, _BLOCK_SCHEMA).collect():
        out[r.block] = np.frombuffer(r.data, np.float32).reshape(BLOCK_ROWS, width)
    return out.reshape(-1, width)


def cluster(near: np.ndarray, clusters: int, rounds: int = 20, seed: int = 5) -> np.ndarray:
    """K-means over the square roots of neighbour shares; the cluster of each row."""
    n = len(near)
    if n <= clusters:
        return np.arange(n)
    x = np.sqrt(near / np.maximum(near.sum(axis=1, keepdims=True), 1))
    rnd = np.random.default_rng(seed)
    centres = [x[0]]
    far = ((x - x[0]) ** 2).sum(axis=1)
    for _ in range(clusters - 1):
        pick = rnd.choice(n, p=far / far.sum()) if far.sum() > 0 else 0
        centres.append(x[pick])
        far = np.minimum(far, ((x - x[pick]) ** 2).sum(axis=1))
    centre = np.array(centres)
    for _ in range(rounds):
        gap = (x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre**2).sum(axis=1)
        own = gap.argmin(axis=1)
        for k in range(clusters):
            if (own == k).any():
                centre[k] = x[own == k].mean(axis=0)
    return own


# ---------------------------------------------------------------------------------------- model


@dataclass
class Model:
    vocab: Vocabulary
    classes: np.ndarray  # class of every word number of the head, of the others and of the end
    weights: np.ndarray  # FEATURES x CLASSES
    bias: np.ndarray

    def _raised(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores of the classes below the best, their exponentials, the sums of these) at the rows."""
        z = np.take(self.weights, rows[0], axis=0)
        for r in rows[1:]:
            z += np.take(self.weights, r, axis=0)
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        raised = np.exp(z)
        return z, raised, raised.sum(axis=1)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """The softmax over the classes, for places with the given feature rows."""
        _, raised, total = self._raised(rows)
        raised /= total[:, None]
        return raised

    def log_of(self, rows: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of one class at each place."""
        z, _, total = self._raised(rows)
        return z[np.arange(len(z)), classes] - np.log(total)

    def in_class(self) -> np.ndarray:
        """log10 P(word | class) of every word number; for the rest class left at 0."""
        counts = np.concatenate([self.vocab.counts, [0, self.vocab.ends]]).astype(float)
        sums = np.bincount(self.classes, counts, minlength=CLASSES)
        share = np.log10(np.maximum(counts, 1) / np.maximum(sums[self.classes], 1))
        share[self.classes == REST] = 0.0
        return share

    def rest_mass(self) -> tuple[float, float]:
        """(tokens of the rest class, those kept for unknown words)."""
        own = self.classes[: len(self.vocab.words)]
        inside = float(self.vocab.counts[own != REST].sum())
        return self.vocab.tokens - self.vocab.ends - inside, float(max(1, self.vocab.once))


def _summed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, sum of the values of each, number of values of each).

    Most rows come once or a few times, so the n-th values of all rows are added together; the few
    frequent rows are added up each by itself.
    """
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ranked = rows[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    counts = np.diff(np.append(first, len(ranked)))
    values = np.take(values, order, axis=0)
    sums = np.take(values, first, axis=0)
    for k in range(1, 8):
        more = np.flatnonzero(counts > k)
        sums[more] += np.take(values, first[more] + k, axis=0)
    for g in np.flatnonzero(counts > 8).tolist():
        sums[g] += values[first[g] + 8 : first[g] + counts[g]].sum(axis=0)
    return ranked[first], sums, counts


def learn(model: Model, docs_ids: Iterator[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradient updates over the documents of one task, from the model's weights.

    Returns the change of every weight row, how often each row was used, the change of the bias and
    the number of tokens. Steps are scaled by the gradients a row has seen.
    """
    weights, bias = model.weights.copy(), model.bias.copy()
    seen = np.full(FEATURES, 1.0, np.float32)
    uses, total = np.zeros(FEATURES, np.int64), 0
    local = Model(model.vocab, model.classes, weights, bias)
    none = len(model.classes)
    for ids_list in docs_ids:
        ids = np.concatenate(ids_list)
        starts = np.cumsum([0, *map(len, ids_list[:-1])])
        rows, goal = features(ids, starts, none), model.classes[ids]
        for at in range(0, len(ids), BATCH_TOKENS):
            here = [r[at : at + BATCH_TOKENS] for r in rows]
            error = local.probabilities(here)
            error[np.arange(len(error)), goal[at : at + BATCH_TOKENS]] -= 1
            bias -= RATE * error.mean(axis=0)
            for r in here:
                which, sums, times = _summed(error, r)
                seen[which] += (sums**2).mean(axis=1)
                weights[which] -= sums * (RATE / np.sqrt(seen[which]))[:, None]
                uses[which] += times
        total += len(ids)
    return weights - model.weights, uses, bias - model.bias, np.array([total])


def _chunks(batches: Iterator[pa.RecordBatch], column: int, reader: Reader) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        for text in batch.column(column):
            held.append(reader.read(lower_words(text.as_py())))
            n += len(held[-1])
            if n >= CHUNK_TOKENS:
                yield held
                held, n = [], 0
    if held:
        yield held


def train(
    docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS
) -> Model:
    """The model of all of ``docs``: counts, classes, and gradient rounds over disjoint parts.

    In each round every task starts from the shared weights and updates its own copy on its documents;
    the changes of a row are averaged by how often the tasks used it. What travels is the feature
    table, whose size is fixed.
    """
    ends = docs.count()
    vocab = vocabulary(counts, ends, head_words)
    classes = np.full(len(vocab.words) + 2, REST, np.int64)
    own = cluster(neighbour_counts(docs, vocab, text_col), CLASSES - FIRST_CLUSTER)
    classes[: len(own)] = own + FIRST_CLUSTER
    classes[-1] = END
    sums = np.bincount(classes[:-2], vocab.counts, minlength=CLASSES).astype(float)
    sums[END] += ends
    sums[REST] = max(0, vocab.tokens - sums.sum() + sums[REST]) + max(1, vocab.once)
    bias = np.log(np.maximum(sums, 0.5) / max(1.0, sums.sum()))
    model = Model(vocab, classes, np.zeros((FEATURES, CLASSES), np.float32), bias.astype(np.float32))
    turn = F.pmod(F.xxhash64(id_col, text_col, F.lit("round")), F.lit(ROUNDS))
    width = CLASSES + 1
    for k in range(ROUNDS if ends else 0):
        now = model

        def run(batches: Iterator[pa.RecordBatch], now: Model = now) -> Iterator[pa.RecordBatch]:
            change, uses, bias_change, n = learn(now, _chunks(batches, 0, Reader(now.vocab.words)))
            # Row sums: the change times its uses, and the uses; a last block holds the bias.
            rows = np.concatenate([change * uses[:, None], uses[:, None]], axis=1)
            last = np.zeros((BLOCK_ROWS, width))
            last[0] = np.append(bias_change * n, n)
            yield _block_rows(np.concatenate([rows, last]))

        part = docs.where(turn == k).select(text_col)
        blocks = FEATURES // BLOCK_ROWS + 1
        total = _added(part.mapInArrow(run, _BLOCK_SCHEMA), blocks, width)
        rows, last = total[:FEATURES], total[FEATURES]
        weights = now.weights + rows[:, :-1] / np.maximum(rows[:, -1:], 1)
        bias = now.bias + last[:-1] / max(last[-1], 1)
        model = Model(vocab, classes, weights.astype(np.float32), bias.astype(np.float32))
    return model


# -------------------------------------------------------------------------------------- scoring


def score(docs: DataFrame, counts: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n_tokens, n_known, base_score, score) for every row; h a hash of the text.

    A task scores the words of the head. The other words leave as rows (document, word, how
    often), which are joined to the counts and added up: no task needs all counts.
    """
    vocab = model.vocab
    kind = docs.schema[id_col].dataType.simpleString()
    denominator = math.log10(vocab.tokens + vocab.types + 1)
    rest, unknown = model.rest_mass()
    rest_total = math.log10(max(rest + unknown, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(vocab.words)
        known = np.concatenate([vocab.counts, [0, vocab.ends]])
        base_of = np.log10(known + 1.0)
        inside = model.in_class()
        of_rest = model.classes == REST
        of_rest[len(vocab.words)] = False  # their share is added when their count is known
        inside[of_rest] = np.log10(np.maximum(known[of_rest], 1)) - rest_total
        none = len(model.classes)
        names = ["id", "h", "n_tokens", "n_known", "base", "model", "words", "times"]

        for batch in batches:

            def out(first: int, ids_list: list, words_list: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                ids = np.concatenate(ids_list)
                sizes = np.array([len(i) for i in ids_list])
                starts = np.cumsum(sizes) - sizes
                rows, logs = features(ids, starts, none), np.empty(len(ids))
                for at in range(0, len(ids), BATCH_TOKENS):
                    here = [r[at : at + BATCH_TOKENS] for r in rows]
                    logs[at : at + BATCH_TOKENS] = model.log_of(here, model.classes[ids[at : at + BATCH_TOKENS]])
                values = logs / math.log(10) + inside[ids]
                # The end is known if any document trains; the other words are added by the join.
                is_known = known[ids] > 0
                others = [Counter(w) for w in words_list]
                cols = [
                    batch.column(0).slice(first, len(sizes)),
                    batch.column(1).slice(first, len(sizes)),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.add.reduceat(is_known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(base_of[ids], starts) - sizes * denominator),
                    pa.array(np.add.reduceat(values, starts)),
                    pa.array([list(c.keys()) for c in others], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in others], pa.list_(pa.int64())),
                ]
                return pa.RecordBatch.from_arrays(cols, names=names)

            first, ids_list, words_list, n = 0, [], [], 0
            for k, text in enumerate(batch.column(2)):
                words = lower_words(text.as_py())
                ids_list.append(reader.read(words))
                words_list.append([words[i] for i in np.flatnonzero(ids_list[-1] == reader.other)])
                n += len(ids_list[-1])
                if n >= CHUNK_TOKENS:
                    yield out(first, ids_list, words_list)
                    first, ids_list, words_list, n = k + 1, [], [], 0
            if ids_list:
                yield out(first, ids_list, words_list)

    schema = f"id {kind}, h bigint, n_tokens bigint, n_known bigint, base double, model double, words array<binary>, times array<bigint>"
    keyed = docs.select(id_col, F.xxhash64(text_col).alias("h"), text_col)
    seen = staged(keyed.mapInArrow(run, schema))
    pairs = seen.where(F.size("words") > 0).select("id", "h", F.explode(F.arrays_zip("words", "times")).alias("p"))
    # Rows that repeat an id and a text are equal in all sums: one of them stands for all.
    pairs = pairs.select("id", "h", F.col("p.words").alias("word"), F.col("p.times").alias("t"))
    pairs = pairs.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    per = pairs.groupBy("id", "h").agg(
        F.sum("t").alias("all"),
        F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("known"),
        F.sum(F.col("t") * F.log10(c + 1)).alias("base_more"),
        F.sum(F.col("t") * (F.log10(F.when(c > 0, c).otherwise(F.lit(unknown))) - rest_total)).alias("model_more"),
    )
    copies = seen.where(F.size("words") > 0).groupBy("id", "h").agg(F.count("*").alias("copies"))
    per = per.join(copies.withColumnsRenamed({"id": "i2", "h": "h2"}), F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")))
    share = {n: F.col(n) / F.col("copies") for n in ("known", "base_more", "model_more")}
    per = per.select(F.col("id").alias("i"), F.col("h").alias("j"), *[e.alias(n) for n, e in share.items()])
    met = seen.drop("words", "times").join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j")), "left")
    zero = F.lit(0.0)
    return met.select(
        F.col("id").alias(id_col),
        "h",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", zero)).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("model_more", zero)).alias("score"),
    )


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows that ``is_training`` names and scores all. P(token) is P(class | what stands before) times P(token | class);
    every unknown word is one and the same event, as in the base, and belongs to the rest class.
    Null and empty texts are one end. Repeated rows train as often as they occur and get equal scores.
    Without training rows the base is that of no counts and the model knows classes only by guess.
    An empty table gives an empty result.
    """
    training = docs.where(is_training(F.col(id_col)))
    counts = staged(word_counts(training, text_col))
    model = train(training, counts, id_col, text_col, head_words)
    return score(docs, counts, model, id_col, text_col).select(
        id_col,
        (~is_training(F.col(id_col))).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.vocab.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op5_maxent(spark: SparkSession, folder: str) -> DataFrame:
    return train_and_score(table(spark, folder, "documents"))
