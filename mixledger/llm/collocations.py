"""Collocations of two to four words: counts of padded longest windows, summed to shorter prefixes by ROLLUP."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

MIN_COUNT, SHARE, TOP = 30, 80, 2000
WORDS = 4
#: Words held before they are counted, distinct ones among them, and bytes of a text split at a time.
HELD_WORDS, HELD_DISTINCT, SLICE = 1 << 20, 1 << 18, 1 << 22
#: Text bytes for one bucket of the counts that rule windows out, the most buckets (an eighth of it in bytes goes to
#: every worker), and buckets of one block.
BYTES_PER_BUCKET, MAX_BUCKET_BITS, BLOCK_BITS = 32, 30, 16

#: What one task may say of a bucket at once; a higher threshold is lowered to it here, where it only saves work.
MOST = (1 << 16) - 1

BREAK = b"\xff"  # no byte of UTF-8
_MAP = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in range(256))
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lower case (A-Z only) with ``BREAK`` between its pieces, a slice at a time."""
    text = text.lower().translate(_MAP).replace(BREAK, b" \xff ")
    start = 0
    while start < len(text):
        end = text.find(b" ", start + SLICE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


class Held:
    """Words of several texts as numbers, each text closed by a break (number 0)."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known = defaultdict(count().__next__)
        self.known[BREAK]
        self.langs: dict[str, int] = {}
        self.empty()

    def empty(self) -> None:
        self.parts: list[np.ndarray] = []
        self.runs: list[tuple[int, int]] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        before = self.size
        for words in tokens(text):
            if words:
                part = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
                self.parts.append(part)
                self.size += len(part)
        if self.size > before:
            self.parts.append(np.zeros(1, np.int32))
            self.size += 1
            self.runs.append((self.langs.setdefault(lang, len(self.langs)), self.size - before))

    def full(self) -> bool:
        return self.size >= HELD_WORDS or len(self.known) >= HELD_DISTINCT

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers, with three breaks behind, and the language of each place."""
        ids = np.concatenate([*self.parts, np.zeros(WORDS - 1, np.int32)])
        codes, lengths = zip(*self.runs, strict=True)
        return ids, np.repeat(np.array(codes, np.int32), lengths)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of every known word and language, the same in every task."""
        words = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.known), np.uint64, len(self.known))
        langs = np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in self.langs), np.uint64, len(self.langs))
        return words, langs

    def buckets(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(is a pair, its bucket, is a triple, its bucket) for the words that start at each place."""
        ids, lang = self.arrays()
        words, langs = self.hashes()
        h, n = words[ids], len(lang)
        down = np.uint64(64 - bits)
        two = (h[:n] * _MIX + h[1 : n + 1] + langs[lang]) * _MIX
        three = (two + h[2 : n + 2]) * _SPREAD
        pair = (ids[:n] != 0) & (ids[1 : n + 1] != 0)
        triple = pair & (ids[2 : n + 2] != 0)
        return pair, (two * _SPREAD) >> down, triple, three >> down


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    texts = batch.column(1).cast(pa.binary())
    for lang, text in zip(batch.column(0), texts, strict=True):
        if text.is_valid:
            yield lang.as_py(), text.as_py()


def _groups(batches: Iterator[pa.RecordBatch], held: Held) -> Iterator[None]:
    """Fills ``held`` with whole texts and stops whenever it is full, and at the end."""
    for batch in batches:
        for lang, text in _texts(batch):
            held.add(lang, text)
            if held.full():
                yield
                held.forget() if len(held.known) >= HELD_DISTINCT else held.empty()
    if held.size:
        yield


def _packed(buckets: np.ndarray, numbers: np.ndarray) -> bytes:
    return zlib.compress(np.diff(buckets, prepend=0).astype("<u2").tobytes() + numbers.astype("<u2").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    n = len(raw) // 4
    return np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64)), np.frombuffer(raw, "<u2", n, 2 * n)


def frequent_buckets(texts: DataFrame, bits: int, least: int) -> bytes:
    """A bit for each of 2**bits buckets of hashed pairs and triples: whether ``least`` of them fell there.

    A pair or triple that occurs ``least`` times always finds its bit set; the bits only spare the later
    count the others. Tasks send sparse counts in blocks, blocks are added up apart, and what comes to the driver
    is 2**(bits - 3) bytes whatever the corpus.
    """
    block_bits, least = min(bits, BLOCK_BITS), min(least, MOST)
    width = 1 << block_bits

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for _ in _groups(batches, held):
            pair, two, triple, three = held.buckets(bits)
            found, numbers = np.unique(np.concatenate([two[pair], three[triple]]), return_counts=True)
            if not len(found):
                continue
            blocks = (found >> np.uint64(block_bits)).astype(np.int64)
            inside = (found & np.uint64(width - 1)).astype(np.int64)
            edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
            numbers = np.minimum(numbers, MOST)
            cut = list(zip(edges[:-1], edges[1:], strict=True)) or [(0, len(found))]
            data = [_packed(inside[a:b], numbers[a:b]) for a, b in cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(blocks[a]) for a, _ in cut], pa.int32()), pa.array(data, pa.binary())], names=["block", "data"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by block, so one block is open at a time.
        now, total = -1, np.zeros(width, np.int64)

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["block", "data"]
            )

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != now:
                    if now >= 0:
                        yield close()
                    now, total = block, np.zeros(width, np.int64)
                inside, numbers = _unpacked(data.as_py())
                total[inside] += numbers
        if now >= 0:
            yield close()

    told = texts.mapInArrow(tell, "block int, data binary")
    added = told.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, data binary")
    found = added.toArrow()
    step = max(width // 8, 1)
    out = bytearray(step << (bits - block_bits))
    for block, data in zip(found["block"].to_pylist(), found["data"].to_pylist(), strict=True):
        out[block * step : (block + 1) * step] = data
    return bytes(out)


def windows(texts: DataFrame, bits: int, frequent: bytes) -> DataFrame:
    """(lang, w1, w2, w3, w4, n): the window that starts at each word, counted inside the task.

    ``w2`` to ``w4`` are the words that lead it, null past the end of the piece and past a pair or triple
    that is too rare to lie in any phrase that is asked for. So every word starts one window.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    names = ["lang", "w1", "w2", "w3", "w4", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        bitmap = np.frombuffer(shared.value, "u1")
        for _ in _groups(batches, held):
            ids, lang = held.arrays()
            pair, two, triple, three = held.buckets(bits)
            n = len(lang)

            def alive(at: np.ndarray) -> np.ndarray:
                return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype("u1"))) & 1 == 1

            pair &= alive(two)
            triple &= alive(three) & pair & np.append(pair[1:], False)
            four = triple & np.append(triple[1:], False)
            starts = ids[:n] != 0
            columns = [lang, ids[:n], np.where(pair, ids[1 : n + 1], 0), np.where(triple, ids[2 : n + 2], 0), np.where(four, ids[3 : n + 3], 0)]
            counted = pa.table([pa.array(c[starts]) for c in columns], names=names[:5])
            counted = counted.group_by(names[:5], use_threads=False).aggregate([([], "count_all")])
            # 0 stands for no word.
            words = pa.array([None, *list(held.known)[1:]], pa.binary()).view(pa.string())
            langs = pa.array(list(held.langs), pa.string())
            for part in counted.to_batches(max_chunksize=1 << 16):
                cols = [part.column(part.schema.get_field_index(c)) for c in (*names[:5], "count_all")]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(cols[0]), *(words.take(c) for c in cols[1:5]), cols[5].cast(pa.int64())], names=names
                )

    return texts.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, w4 string, n bigint")


def phrase_counts(texts: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, size, phrase, f): size 0 with the words of a language, 1 to 4 with every phrase of ``least`` occurrences or more.

    One ROLLUP over (lang, w1, w2, w3, w4) adds the counts of the longest windows up to each shorter prefix;
    a prefix that ends in padding is no phrase.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max((size // BYTES_PER_BUCKET).bit_length(), 3), MAX_BUCKET_BITS)
    counted = windows(texts, bits, frequent_buckets(texts, bits, least))
    words = [f"w{i}" for i in range(1, WORDS + 1)]
    # Whole windows are added up first, so that shorter prefixes are made of each distinct window once and not in every task.
    counted = counted.groupBy("lang", *words).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *words).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    # grouping_id: 15 for the language alone, 7, 3, 1, 0 for one to four words.
    length = F.when(F.col("rolled") == 15, 0)
    for i, bit in enumerate((7, 3, 1, 0), 1):
        length = length.when((F.col("rolled") == bit) & F.col(f"w{i}").isNotNull(), i)
    rows = rolled.select("lang", length.alias("size"), F.concat_ws(" ", *words).alias("phrase"), "f")
    return rows.where(F.col("size").isNotNull() & ((F.col("size") == 0) | (F.col("f") >= least)))


def _wide(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language.

    Null texts are empty; a null language is ``und`` and joins the rows that say ``und``. Repeated rows count
    as often as they stand; empty texts and an empty table add nothing. Ties go to the higher count, then to the phrase
    that is first in byte order. Other columns are not read. A phrase is contained by whole words only.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = staged(phrase_counts(texts, min_count))
    phrases = counts.where("size > 0").select("lang", "phrase", "f")
    found = counts.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")

    # A candidate lies inside a longer one that occurs nearly as often: the highest count of those decides.
    longer = found.where("size > 2").select("lang", "a", "size", words.alias("w"))
    spans = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> concat_ws(' ', slice(w, i, k)))))")
    inside = longer.select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = found.join(inside, ["lang", "phrase"], "left").where(
        F.col("inside").isNull() | (_wide("inside") * 100 < _wide("a") * share)
    )

    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.concat_ws(" ", F.expr("slice(w, 1, k)")).alias("first"),
        F.concat_ws(" ", F.expr("slice(w, k + 1, size(w))")).alias("rest"),
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    # ``div`` of decimals is exact, and so is the product below it.
    met = met.withColumns({"top": _wide("a") * 2000000, "below": _wide("l") + _wide("r")})
    met = met.withColumn("score", F.expr("top div below").cast("long"))
    lowest = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    rows = lowest.select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents").select("lang", "text"))


OP12_SQL = r"""
with texts as (
  select row_number() over () as t, coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from texts),
numbered as (select row_number() over () as p, lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
held as (select * from numbered where len(w) > 0),
totals as (select lang, sum(len(w))::bigint as n from held group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from held),
grams as (
  select lang, k as size, array_to_string(w[i:i + k - 1], ' ') as phrase
  from starts, (select unnest([1, 2, 3, 4]) as k) where i + k - 1 <= len(w)),
counts as (select lang, size, phrase, count(*)::bigint as f from grams group by all having count(*) >= 30),
found as (select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counts where size > 1),
inner_sizes as (select *, unnest(range(2, size)) as k from found where size > 2),
inner_starts as (select *, unnest(range(1, size - k + 2)) as i from inner_sizes),
inside as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, max(a) as inside from inner_starts group by all),
kept as (
  select found.* from found left join inside using (lang, phrase)
  where inside is null or 100 * inside::hugeint < 80 * a::hugeint),
cut_at as (select *, unnest(range(1, size)) as k from kept),
cuts as (
  select lang, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:size], ' ') as tail from cut_at),
met as (
  select cuts.*, x.f as l, y.f as r, ((2000000::hugeint * a) // (x.f::hugeint + y.f))::bigint as score
  from cuts join counts x on x.lang = cuts.lang and x.phrase = head join counts y on y.lang = cuts.lang and y.phrase = tail),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as pick from met),
ranked as (
  select lang, phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from lowest where pick = 1)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""
