"""Token ids in a compact binary form: canonical length-limited Huffman blocks with checkpoints."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Longest code in bits; 2 ** MAX_BITS entries make the decoding table.
MAX_BITS = 20
#: Ids of a block, which holds whole documents: at least so many, or one longer document.
BLOCK_IDS = 1 << 16
#: Ids between two bit-offset checkpoints of a block.
CHECKPOINT_IDS = 128
#: Pieces of text whose ids a worker remembers, and bytes of text that it takes at once.
CACHE_PIECES = 900_000
BATCH_BYTES = 1 << 20

# ------------------------------------------------------------------------------- tokenization

#: A single space between characters that are not white space starts a new piece of the tokenizer.
_ODD_SPACE = re.compile(r"\s\s")
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = re.compile(r"[^\W\d_]+")
_ID = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


class PieceEncoder:
    """Ids of texts by the tokenizers library, asked once for each piece that texts share.

    No token of a byte-level vocabulary crosses a piece border. A single space between other
    characters is always such a border, and so is the end of a run of letters. So a text is split at
    spaces, every distinct piece is encoded by the library once, as the letters it begins with and
    the rest, and its ids are looked up after that. A run of letters is one word of the library's
    model and skips its splitting. The memory is bounded: when it is full, the
    pieces it does not hold are encoded each time they come.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.space = self.letters[32]
        self.limit = limit
        self.after: dict[str, int] = {}  # pieces that follow a space, without it
        self.plain: dict[str, int] = {}  # pieces that do not
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.used = self.known = 0

    def _word(self, text: str) -> list[int]:
        if not text.isascii():
            text = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        elif text[0] == " ":  # ASCII letters are written as they are
            text = self.space + text[1:]
        return list(map(_ID, self.model.tokenize(text)))

    def _library(self, texts: list[str]) -> list[list[int]]:
        out = []
        for at in range(0, len(texts), 1000):  # what the library returns is far larger than the ids
            part = self.tokenizer.encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)
            out += [e.ids for e in part]
        return out

    def _learn(self, into: dict[str, int], pieces: list[str], space: str) -> list[list[int]]:
        """Ids of pieces that follow ``space``."""
        out: list[list[int]] = []
        rests: dict[str, list[int]] = {}
        mixed: list[tuple[int, str]] = []
        word, match = self._word, _LETTERS.match
        for piece in pieces:
            if piece.isalpha():
                out.append(word(space + piece))
                continue
            found = match(piece)
            head = found[0] if found and found[0].isalpha() else ""
            at = into.get(head) if head else None
            if at is not None:  # known without what follows it
                ids = self.ids[self.first[at] : self.first[at] + self.count[at]].tolist()
            else:
                ids = word(space + head) if head else []
            rest = piece[len(head) :] if head else space + piece
            mixed.append((len(out), rest))
            rests.setdefault(rest, [])
            out.append(ids)
        rests = dict(zip(rests, self._library(list(rests))))
        for k, rest in mixed:
            out[k] = out[k] + rests[rest]
        return out

    def _add(self, into: dict[str, int], pieces: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(ids) > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        here = slice(self.known, self.known + len(ids))
        self.first[here], self.count[here] = self.used + np.cumsum(sizes) - sizes, sizes
        into.update(zip(pieces, range(self.known, self.known + len(ids))))
        self.used += total
        self.known += len(ids)

    def _look_up(self, into: dict[str, int], pieces: list[str], space: str) -> tuple[np.ndarray, list[str]]:
        where = np.fromiter(map(into.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(where < 0).tolist()
        new = list(dict.fromkeys(pieces[i] for i in missing))
        if new:
            self._add(into, new, self._learn(into, new, space))
            where[missing] = [into[pieces[i]] for i in missing]
        return where, new

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        start, used = self.known, self.used
        firsts, others, sizes = [], [], []
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            odd = _ODD_SPACE.search(text) or text[0].isspace() or text[-1].isspace()
            parts = _INNER_SPACE.split(text) if odd else text.split(" ")
            sizes.append(len(parts))
            firsts.append(parts[0])
            others += parts[1:]
        one, new_one = self._look_up(self.plain, firsts, "")
        more, new_more = self._look_up(self.after, others, " ")
        size = np.array(sizes, np.int64)
        ends = np.cumsum(size)
        where = np.empty(len(one) + len(more), np.int64)
        is_first = np.zeros(len(where), bool)
        is_first[(ends - size)[size > 0]] = True
        where[is_first], where[~is_first] = one, more
        count = self.count[where]
        total = int(count.sum())
        before = np.cumsum(count) - count
        ids = self.ids[np.repeat(self.first[where] - before, count) + np.arange(total)]
        sums = np.concatenate([[0], np.cumsum(count)])
        if self.known > self.limit:  # forget what this call has learned
            for into, new in ((self.plain, new_one), (self.after, new_more)):
                for piece in new:
                    del into[piece]
            self.known, self.used = start, used
        return ids, np.diff(sums[np.concatenate([[0], ends])])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    """The worker's encoder; its memory of pieces lasts from task to task."""
    if name not in _ENCODERS:
        import public_tokenizers

        _ENCODERS[name] = PieceEncoder(public_tokenizers.path(name))
    return _ENCODERS[name]


def tokenize(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, ids): the ids of every whole text with the end id, as little-endian integers.

    Ids below 2 ** 16 throughout a document take two bytes each (n tells them apart from four).
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)

        def out(keys: list, texts: list, key_type: pa.DataType) -> pa.RecordBatch:
            ids, counts = enc.encode(texts)
            rows = []
            for part in np.split(ids, np.cumsum(counts)[:-1]):
                wide = np.append(part, end_id)
                rows.append(wide.astype("<u2" if wide.max() < 1 << 16 else "<u4").tobytes())
            sizes = pa.array((counts + 1).tolist(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), sizes, pa.array(rows, pa.binary())], names=["id", "n", "ids"])

        for batch in batches:
            keys, texts, held = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                keys.append(key.as_py())
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    yield out(keys, texts, batch.column(0).type)
                    keys, texts, held = [], [], 0
            if keys:
                yield out(keys, texts, batch.column(0).type)

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n bigint, ids binary")


def ids_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; every task sends one row for each id it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)

        def add(parts: list[np.ndarray]) -> None:
            nonlocal total
            found = np.bincount(np.concatenate(parts), minlength=len(total))
            total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)]) + found

        for batch in batches:
            parts, held = [], 0
            for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(ids_of(raw.as_py(), n))
                held += n
                if held >= 1 << 20:
                    add(parts)
                    parts, held = [], 0
            if parts:
                add(parts)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    each = tokens.select("n", "ids").mapInArrow(run, "id bigint, n bigint")
    return each.groupBy("id").agg(F.sum("n").alias("n"))


# --------------------------------------------------------------------------------------- codes


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Best code lengths up to ``limit`` for the symbols counted, by package-merge; 0: not counted."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(symbols) < 2:
        lengths[symbols] = 1
        return lengths
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} ids do not fit codes of {limit} bits")
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    single = counts[symbols].astype(np.float64)
    level, is_single = single, [np.ones(len(single), bool)]
    for _ in range(limit - 1):
        half = len(level) // 2 * 2
        merged = np.concatenate([single, level[0:half:2] + level[1:half:2]])
        order = np.argsort(merged, kind="stable")
        level = merged[order]
        is_single.append(order < len(single))
    take = 2 * len(symbols) - 2
    for mask in reversed(is_single):
        own = int(mask[:take].sum())  # the singles taken are the rarest symbols
        lengths[symbols[:own]] += 1
        take = 2 * (take - own)
    return lengths


class Code:
    """A canonical code, rebuilt from its lengths alone."""

    def __init__(self, lengths: np.ndarray, limit: int = MAX_BITS) -> None:
        self.limit, self.lengths = limit, lengths.astype(np.int64)
        symbols = np.flatnonzero(lengths)
        order = symbols[np.lexsort((symbols, lengths[symbols]))]
        width = 1 << (limit - self.lengths[order])
        self.left = np.zeros(len(lengths), np.uint64)  # codes aligned to the left of ``limit`` bits
        self.left[order] = np.cumsum(width) - width
        entries = (self.lengths[order] << 24 | order).astype(np.uint32)
        self.table = np.zeros(1 << limit, np.uint32)
        self.table[: width.sum()] = np.repeat(entries, width)

    def encode(self, ids: np.ndarray, step: int = CHECKPOINT_IDS) -> tuple[bytes, bytes]:
        """(bits in big-endian words, bit offset of every ``step``-th id)."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        words = int(end[-1] + 31 >> 5)
        wide = self.left[ids] << np.uint64(64 - self.limit) >> (at & 31).astype(np.uint64)
        # Every word of 32 bits holds the start of a code, as no code is that long.
        first = np.flatnonzero(np.diff(at >> 5, prepend=-1))
        high = np.add.reduceat(wide >> np.uint64(32), first)
        low = np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        out = np.zeros(words + 1, np.uint64)
        out[: len(high)] += high
        out[1 : len(low) + 1] += low
        return out[:words].astype(">u4").tobytes(), at[::step].astype("<u4").tobytes()

    def decode(self, blocks: list[tuple[bytes, bytes, int]], step: int = CHECKPOINT_IDS) -> list[np.ndarray]:
        """The ids of several blocks (bits, checkpoints, number of ids), all segments side by side."""
        parts, starts, base = [], [], 0
        for bits, marks, _ in blocks:
            parts += [np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)]
            starts.append(np.frombuffer(marks, "<u4").astype(np.int64) + base)
            base += len(bits) * 8 + 64
        words = np.concatenate(parts)
        window = words[:-1] << np.uint64(32) | words[1:]
        at = np.concatenate(starts)
        out = np.empty((len(at), step), np.uint32)
        shift, last = np.uint64(64 - self.limit), (len(window) - 1) * 32
        for i in range(step):
            peek = window[at >> 5] << (at & 31).astype(np.uint64) >> shift
            entry = self.table[peek]
            out[:, i] = entry & np.uint32(0xFFFFFF)
            at = np.minimum(at + (entry >> np.uint32(24)), last)
        found, row = [], 0
        for _, marks, n in blocks:
            rows = len(marks) // 4
            found.append(out[row : row + rows].reshape(-1)[:n])
            row += rows
        return found


# --------------------------------------------------------------------------------------- files

_BLOCK_FIELDS = {
    "part": pa.int32(), "seq": pa.int64(), "n_ids": pa.int64(), "sizes": pa.list_(pa.int64()), "bits": pa.binary(), "checkpoints": pa.binary(),
}


def encode_blocks(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Blocks of whole documents in ascending id order: part and seq number them in that order.

    The range partitioning orders the parts; null ids come first, rows that tie on id are ordered by
    their ids. Each block decodes alone.
    """
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = Code(lengths), TaskContext.get().partitionId(), 0

        def out(keys: list, runs: list, key_type: pa.DataType) -> pa.RecordBatch:
            ids = np.concatenate(runs)
            bits, marks = code.encode(ids)
            row = {"part": part, "seq": seq, "n_ids": len(ids), "sizes": [len(r) for r in runs], "bits": bits, "checkpoints": marks}
            arrays = [pa.array([keys], pa.list_(key_type)), *[pa.array([row[k]], t) for k, t in _BLOCK_FIELDS.items()]]
            return pa.RecordBatch.from_arrays(arrays, names=["ids", *_BLOCK_FIELDS])

        keys, runs, held, key_type = [], [], 0, None
        for batch in batches:
            key_type = batch.column(0).type
            for key, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                keys.append(key)
                runs.append(ids_of(raw.as_py(), n))
                held += n
                if held >= BLOCK_IDS:
                    yield out(keys, runs, key_type)
                    keys, runs, held, seq = [], [], 0, seq + 1
        if keys:
            yield out(keys, runs, key_type)

    ordered = tokens.repartitionByRange("id").sortWithinPartitions("id", "n", "ids")
    schema = f"ids array<{kind}>, part int, seq bigint, n_ids bigint, sizes array<bigint>, bits binary, checkpoints binary"
    return ordered.mapInArrow(run, schema)


def decode_blocks(blocks: DataFrame, lengths: np.ndarray, take=None, schema: str | None = None) -> DataFrame:
    """Documents read back from blocks: (part, seq, id, before, n, ids).

    ``take`` may turn the ids of one document into another value, with its type in ``schema``, so
    that ids need not leave the task; ``before`` counts the ids of the block before the document.
    """
    take = take or (lambda ids: ids.astype(np.int64).tolist())
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    result = f"part int, seq bigint, id {kind}, before bigint, n bigint, value {schema or 'array<bigint>'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)

        def out(rows: list[dict], key_type: pa.DataType) -> pa.RecordBatch:
            cols: dict[str, list] = {k: [] for k in ("part", "seq", "id", "before", "n", "value")}
            decoded = code.decode([(r["bits"], r["checkpoints"], r["n_ids"]) for r in rows])
            for row, ids in zip(rows, decoded):
                before = 0
                for key, n in zip(row["ids"], row["sizes"]):
                    values = (row["part"], row["seq"], key, before, n, take(ids[before : before + n]))
                    for name, value in zip(cols, values):
                        cols[name].append(value)
                    before += n
            types = [pa.int32(), pa.int64(), key_type, pa.int64(), pa.int64(), None]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), types)], names=list(cols))

        for batch in batches:
            key_type = batch.schema.field("ids").type.value_type
            rows, held = [], 0
            for i in range(batch.num_rows):
                rows.append(batch.slice(i, 1).to_pylist()[0])
                held += rows[-1]["n_ids"]
                if held >= 16 * BLOCK_IDS:
                    yield out(rows, key_type)
                    rows, held = [], 0
            if rows:
                yield out(rows, key_type)

    return blocks.mapInArrow(run, result)


def lengths_of(counts: DataFrame) -> np.ndarray:
    """Code lengths for counts (id, n): at most one row for each id of the vocabulary."""
    rows = counts.collect()
    total = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        total[r.id] = r.n
    return code_lengths(total)


def op9_huffman(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Write the ids of all documents as Huffman files and read them back.

    Per row: id, start (ids of all documents before it), n_tokens, ids_crc32. Null and
    empty texts have the end id alone; rows with null ids come first; an empty table
    gives an empty result. Everything is taken from the files that were written.
    """
    tokens = staged(tokenize(docs, tokenizer, END_ID, id_col, text_col))
    lengths = lengths_of(id_counts(tokens))
    files = staged(encode_blocks(tokens, lengths))
    read = decode_blocks(files, lengths, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint")
    # Three running sums: over parts (few), over the blocks of a part, inside a block.
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("m"))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("m").over(up), F.lit(0)).alias("p"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("s"))
    firsts = firsts.join(parts, "part")
    return read.join(firsts, ["part", "seq"]).select(
        F.col("id").alias(id_col),
        (F.col("p") + F.col("s") + F.col("before")).alias("start"),
        F.col("n").alias("n_tokens"),
        F.col("value").alias("ids_crc32"),
    )
