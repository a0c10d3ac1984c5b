"""Document fingerprints by winnowing, in DataFrame functions alone."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import same, table

GRAM_WORDS = 5
#: Neighbouring grams of which the least is chosen: any run of GRAM_WORDS + WINDOW - 1 words that two
#: texts share has a chosen gram in common.
WINDOW = 4
#: Bits of a chosen value that hold its position; the others hold the hash.
POSITION_BITS = 26
_POSITION = (1 << POSITION_BITS) - 1
#: Documents of a chunk of ids, and how many chunks there may be.
CHUNK_ROWS = 500
MAX_CHUNKS = 100_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often a lambda reads it."""
    return F.transform(F.array(value), use)[0]


def winnow_values(text: Column, gram_words: int = GRAM_WORDS, window: int = WINDOW) -> Column:
    """The chosen grams of a text in order, each as hash bits above its position bits.

    Every word is hashed once; the gram window rolls over these hashes. A text of fewer words
    than a gram is one gram, a text of fewer grams than a window one window; no words: none. The
    position is stored counting down, so that of equal hashes the rightmost is the least.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def rolled(of: Column, size: int, take: Callable[[Column], Column]) -> Column:
        n = F.greatest(F.size(of) - size + 1, F.lit(1))
        return F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(1), n), lambda i: take(F.slice(of, i, size)))).otherwise(
            F.array().cast("array<bigint>")
        )

    grams = _let(hashes, lambda h: rolled(h, gram_words, lambda part: F.xxhash64(part)))
    marked = F.transform(
        grams,
        lambda g, i: g.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(F.lit(_POSITION) - (i % (_POSITION + 1)).cast("bigint")),
    )
    return F.array_distinct(_let(marked, lambda v: rolled(v, window, F.array_min)))


def hash_set(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: v.bitwiseAND(F.lit(~_POSITION))))


def winnow(text: Column, gram_words: int = GRAM_WORDS, window: int = WINDOW) -> Column:
    """array<struct<hash, pos>>: chosen gram hashes and the word they start at.

    Null and blank texts give an empty array. Beyond 2 ** 26 words positions count from 0 again.
    """
    values = winnow_values(F.coalesce(text, F.lit("")), gram_words, window)
    return F.transform(
        values,
        lambda v: F.struct(
            v.bitwiseAND(F.lit(~_POSITION)).alias("hash"), (F.lit(_POSITION) - v.bitwiseAND(F.lit(_POSITION))).alias("pos")
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either).cast("double")


def digest(values: Column) -> Column:
    """One string for the chosen grams and their positions."""
    return F.sha2(F.array_join(F.transform(values, lambda v: F.hex(v)), ",").cast("binary"), 256)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """(rows id, text, extra, chunk; the window that orders them by id inside a chunk).

    Ids are cut into chunks of equal width, so the next row is a lead inside a chunk. The last row
    of a chunk sees the first row of the next one, as each chunk ends in a copy of it (extra = 1);
    the last chunk ends in the first row of all. At most ``MAX_CHUNKS`` first rows exist, so
    their keys are broadcast to find their texts; the texts themselves move once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    range_ = rows.agg(F.min("_id").alias("a"), F.max("_id").alias("b"), F.count("*").alias("n")).first()
    chunks = max(1, min(MAX_CHUNKS, math.ceil(range_["n"] / CHUNK_ROWS)))
    low = range_["a"] or 0
    width = max(1, math.ceil(((range_["b"] or 0) - low + 1) / chunks))
    at = (F.col("_id").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")
    chunk = F.coalesce(F.floor(at).cast("long"), F.lit(-1))  # null ids come first
    keyed = rows.withColumns({"h": F.xxhash64("text"), "chunk": chunk})
    firsts = keyed.groupBy("chunk").agg(F.min(F.struct("_id", "h")).alias("k"))
    every = Window.orderBy("chunk")
    prior = F.coalesce(F.lag("chunk").over(every), F.max("chunk").over(Window.partitionBy(F.lit(1))))
    heads = firsts.select(F.col("chunk").alias("c"), F.col("k._id").alias("i"), F.col("k.h").alias("j"), prior.alias("prior"))
    match = (F.col("chunk") == F.col("c")) & same(F.col("_id"), F.col("i")) & (F.col("h") == F.col("j"))
    copies = keyed.join(F.broadcast(heads), match).select("_id", "text", "h", F.col("prior").alias("chunk"))
    both = keyed.withColumn("extra", F.lit(0)).unionByName(copies.withColumn("extra", F.lit(1)))
    return both, Window.partitionBy("chunk").orderBy("extra", "_id", "h")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last half of the code points replaced by the first as many of the
    next row in ascending id order (null ids first, ties by text; after the last row the first). Null texts
    are empty. A repeated row is a row of its own. An empty table gives an empty result.
    """
    rows, order = with_next(docs, id_col, text_col)
    seen = rows.withColumn("next", F.lead("text").over(order))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    marked = seen.select(
        "_id", "h", "extra", "chunk", n.cast("long").alias("n_chars"), winnow_values(F.col("text")).alias("own"), edited.alias("edited")
    )
    found = marked.select("*", F.lead("own").over(order).alias("next_own")).where("extra = 0")
    changed = found.select(
        "_id", "n_chars", "own", "next_own", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow_values(F.col("edited")).alias("other")
    )
    own, other, following = (hash_set(F.col(c)) for c in ("own", "other", "next_own"))
    return changed.select(
        F.col("_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        digest(F.col("own")).alias("fingerprint"),
        digest(F.col("other")).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        F.size("own").cast("long").alias("n_chosen"),
    )


def op10_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))
