"""SimHash near-duplicates, found by multi-index hashing over parts of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..session import cut_lineage
from .common import lower_words, table

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 2
QUARTER_BITS = 16


def shingle_hashes(words: list[bytes], shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit hash of every shingle of a text that has words; a short text is one shingle."""
    joined = b" ".join(words)
    n = max(1, len(words) - shingle_words + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    stops = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], "<u8")


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a text; no words: 0."""
    words = lower_words(text)
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle_words, seed)
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        piece = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *keep: str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and fp for every row; null and blank texts have fingerprint 0. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(fps, pa.int64())], names=[*keep, "fp"]
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_col).mapInArrow(run, f"{kinds}, fp bigint")


def _segment(fp: Column, quarter: int) -> Column:
    """The fingerprint without one quarter; the freed bits name the quarter."""
    mask = ((1 << QUARTER_BITS) - 1) << (QUARTER_BITS * quarter)
    keep = (~mask) & (2**64 - 1)
    signed = keep - 2**64 if keep >= 2**63 else keep
    tag = (quarter + 1) << (QUARTER_BITS * quarter)
    return fp.bitwiseAND(F.lit(signed)).bitwiseOR(F.lit(tag))


def near_pairs(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most two bits apart; ``fps`` has column fp.

    Multi-index hashing. The four tables are keyed by the 48-bit segment that is left when one
    quarter is dropped. Two fingerprints that differ in one or two bits agree in such a segment up
    to one bit: drop the lower quarter that holds a differing bit. So each fingerprint asks table
    q for its own segment and for those of the Hamming ball of radius 1 over the quarters above
    q. Of two keys one bit apart one has that bit set, so clearing set bits alone meets both.
    Matches are verified by their complete distance. A bucket holds fingerprints that are equal
    in 48 bits, so it is small whatever the size of the input or of a group of copies.
    """
    fp = F.col("fp")
    quarters = range(64 // QUARTER_BITS)
    own = F.array(*[_segment(fp, q) for q in quarters])
    tables = fps.select(F.explode(own).alias("key"), fp.alias("b"))
    asked = []
    for q in quarters:
        key = _segment(fp, q)
        above = range((q + 1) * QUARTER_BITS, 64)
        flips = [key.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in above]
        cleared = [F.when(F.getbit(fp, F.lit(i)) == 1, flip) for i, flip in zip(above, flips)]
        asked.append(F.array(key, *cleared))
    probes = fps.select(F.explode(F.array_compact(F.concat(*asked))).alias("key"), fp.alias("a"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = probes.join(tables, "key").where((F.col("a") != F.col("b")) & (apart <= MAX_DISTANCE))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, columns to keep, fp, component): component is the least id linked by near fingerprints.

    Equal fingerprints are one node, so a group of copies of any size is one row of the search.
    Rows with a null id keep a row; they count as members, but their component is null only if
    no member has an id. An empty table gives an empty result; extra columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, *keep, text_col=text_col))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(near_pairs(nodes.select("fp")))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select(id_col, *keep, "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the least id.

    Of rows that repeat that id, the one with the least text hash stays. Rows without an id are
    kept, as nothing names them. Texts move once, to meet the keys that stay.
    """
    keyed = docs.withColumn("_h", F.xxhash64(text_col))
    found = near_components(keyed, id_col, text_col, ("_h",))
    firsts = found.where(F.col(id_col) == F.col("component")).groupBy(id_col).agg(F.min("_h").alias("_h"))
    named = keyed.join(firsts, [id_col, "_h"]).dropDuplicates([id_col, "_h"])
    return named.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_components(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
