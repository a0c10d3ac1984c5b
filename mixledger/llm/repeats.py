"""Repeated byte strings across and inside texts, by suffix arrays and longest-previous-factor arrays.

One suffix array over a corpus fits no machine, so the work is cut where it can be cut exactly. Every
string of ``length`` bytes names one anchor inside itself: the ``GRAM``-byte gram with the least hash,
of equal ones the rightmost. Equal strings name equal anchors at the same offset. So suffixes that can
match meet under the hash of their anchor, and what never meets has no repeat. Around each anchor the
starts that name it form one context; contexts that are equal in all bytes repeat as a whole
and need no sorting. The remaining, differing contexts of repeated anchors, each once, are packed into
buckets of bounded size, and a suffix array with its longest-previous-factor array decides every start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

LENGTH = 400
#: Bytes of an anchor gram; a string of LENGTH bytes holds LENGTH - GRAM + 1 of them.
GRAM = 200
#: Bytes that one vectorized pass takes, and the context bytes of one suffix array.
BATCH_BYTES = 1 << 20
BUCKET_BYTES = 1 << 19
#: Differing contexts of one anchor that a suffix array may take; beyond, its strings are grouped by hash.
MAX_CONTEXTS = 512

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POSITION_BITS = 21  # of a batch position: BATCH_BYTES and one overlap stay below 2 ** 21


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:  # doubling: base ** (filled + i) = base ** filled * base ** i
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * out[filled - 1 : filled] * base
        filled += step
    return out


class Anchors:
    """Anchors of many texts at once."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        n = BATCH_BYTES + 2 * length + 2
        self.power, self.inverse = _powers(_BASE, n), _powers(_BASE_INVERSE, n)

    def gram_hashes(self, data: np.ndarray) -> np.ndarray:
        """A mixed polynomial hash of every gram, from running sums."""
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        n = len(data) - self.gram + 1
        h = (sums[self.gram :] - sums[:n]) * self.inverse[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def contexts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, number of starts, anchor, anchor hash) of each run of starts with one anchor."""
        h = self.gram_hashes(data)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))  # of equal hashes the rightmost
        width = self.length - self.gram + 1
        reach = 1
        while reach < width:  # sliding minimum by doubling
            step = min(reach, width - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        anchor = (low - (least & low)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(np.append(first, len(anchor)))
        return first, count, anchor[first], h[anchor[first]]


def anchor_rows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, first, n, anchor, core, ctx) for every run of starts; ``docs``: doc_id, h, text.

    core is the hash of the anchor gram, ctx that of all bytes the starts cover and of the
    anchor's place in them. Texts beyond ``BATCH_BYTES`` are read in overlapping parts, so each start lies in one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Anchors(length, gram)
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            parts: list[tuple[int, int, bytes]] = []  # row, offset of the part, bytes
            held = 0

            def flush() -> None:
                joined = b"".join(p[2] for p in parts)
                if len(joined) < length:
                    return
                first, count, anchor, core = tool.contexts(np.frombuffer(joined, np.uint8))
                begin = np.cumsum([0, *(len(p[2]) for p in parts)])
                # Starts whose string would leave its part are cut off; a run may span several parts.
                last = first + count - 1
                for k, (row, offset, raw) in enumerate(parts):
                    lo, hi = int(begin[k]), int(begin[k + 1]) - length
                    if hi < lo:
                        continue
                    i, j = np.searchsorted(last, lo), np.searchsorted(first, hi, "right")
                    a = np.maximum(first[i:j], lo)
                    b = np.minimum(last[i:j], hi)
                    here = anchor[i:j]
                    for s, e, at, c in zip(a.tolist(), b.tolist(), here.tolist(), core[i:j].tolist()):
                        ctx = xxhash.xxh64_intdigest(joined[s : e + length], at - s)
                        rows.append((row, s - lo + offset, e - s + 1, at - lo + offset, c, ctx))

            def out() -> pa.RecordBatch:
                index = pa.array([r[0] for r in rows], pa.int32())
                numbers = np.array([r[1:4] for r in rows], np.int64).reshape(-1, 3)
                hashes = np.array([r[4:6] for r in rows], np.uint64).reshape(-1, 2).view(np.int64)
                cols = [ids.take(index), marks.take(index)]
                cols += [pa.array(numbers[:, k], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
                cols += [pa.array(np.ascontiguousarray(hashes[:, k])) for k in range(2)]
                return pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "first", "n", "anchor", "core", "ctx"])

            for row in range(batch.num_rows):
                raw = (batch.column(2)[row].as_py() or "").encode("utf-8", "surrogatepass")
                step = BATCH_BYTES - length + 1
                for at in range(0, max(1, len(raw) - length + 1), step):
                    piece = raw[at : at + step + length - 1]
                    if held + len(piece) > BATCH_BYTES and parts:
                        flush()
                        parts, held = [], 0
                        if len(rows) > 50_000:
                            yield out()
                            rows = []
                    parts.append((row, at, piece))
                    held += len(piece)
            flush()
            if rows:
                yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, h bigint, first bigint, n int, anchor bigint, core bigint, ctx bigint"
    return docs.select("doc_id", "h", "text").mapInArrow(run, schema)


# ------------------------------------------------------------------------------ suffix arrays


class Suffixes:
    """Suffixes of a byte array by their first ``limit`` bytes: equal ranks for equal prefixes.

    ``stops`` gives for each position the end of its own string: no suffix reads beyond it. The
    first ranks come from eight packed bytes; each doubling ranks pairs of ranks.
    """

    def __init__(self, data: np.ndarray, stops: np.ndarray, limit: int, keep: bool = False) -> None:
        n = len(data)
        self.limit, self.stops, self.n = limit, stops, n
        at = np.arange(n)
        packed = np.zeros(n, np.uint64)
        for i in range(8):
            ahead = np.minimum(at + i, n - 1)
            byte = np.where(at + i < stops, data[ahead], 0).astype(np.uint64)
            packed = packed << np.uint64(8) | byte
        self.packed = packed
        first = packed if limit >= 8 else packed >> np.uint64(8 * (8 - limit))
        rank = self._ranked(first)
        width = min(8, limit)
        self.levels = [(width, rank)]
        while width < limit:
            step = min(width, limit - width)  # the last step may overlap
            ahead = np.minimum(at + step, n)
            after = np.where(ahead < stops, rank[ahead], 0)
            rank = self._ranked(rank[:n] * (n + 1) + after)
            width += step
            if not keep:
                self.levels.clear()
            self.levels.append((width, rank))
        self.rank = rank[:n]

    @staticmethod
    def _ranked(values: np.ndarray) -> np.ndarray:
        """Dense ranks from 1, and a 0 behind them for what lies beyond the end."""
        order = np.argsort(values)
        ranked = values[order]
        out = np.zeros(len(values) + 1, np.int64)
        out[order] = np.cumsum(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(values)])
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, at most the limit (needs ``keep``)."""
        most = np.minimum(np.minimum(self.stops[a] - a, self.stops[b] - b), self.limit)
        length = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            fits = length + width <= most
            x, y = np.where(fits, a + length, self.n), np.where(fits, b + length, self.n)
            length += np.where(fits & (rank[x] == rank[y]), width, 0)
        last = self.n - 1
        differ = self.packed[np.minimum(a + length, last)] ^ self.packed[np.minimum(b + length, last)]
        for _ in range(7):
            same = (differ >> np.uint64(56) == 0) & (length < most)
            length += same
            differ = np.where(same, differ << np.uint64(8), np.uint64(0xFF << 56))
        return np.minimum(length, most)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each index the nearest index before it with a smaller value; -1: none.

    Jumps along earlier answers, all open indexes at once: what lies between an index and its
    candidate is never smaller, so a candidate that is not smaller gives way to its own candidate.
    """
    n = len(values)
    found = np.arange(-1, n - 1)
    padded = np.append(values, np.iinfo(np.int64).min)  # index -1 is smaller than all
    open_ = np.flatnonzero(padded[found] >= values)
    while len(open_):
        found[open_] = found[found[open_]]
        open_ = open_[padded[found[open_]] >= values[open_]]
    return found


def longest_previous_factor(
    suffixes: Suffixes, starts: np.ndarray, place: np.ndarray, whole_only: bool = False
) -> np.ndarray:
    """For each start the longest prefix that also begins at a start of smaller ``place``.

    Of all earlier starts, the neighbours in suffix order with a smaller place have the longest
    common prefix: the previous and the next smaller value in the suffix array. ``whole_only``
    tells prefixes of the full limit (equal ranks) from shorter ones, which then count as 0.
    """
    order = np.lexsort((place, suffixes.rank[starts]))
    ranked, sorted_starts = place[order], starts[order]
    n = len(order)
    before = previous_smaller(ranked)
    after = n - 1 - previous_smaller(ranked[::-1])[::-1]  # n: none
    out = np.zeros(n, np.int64)
    for near, ok in ((before, before >= 0), (after, after < n)):
        here = np.flatnonzero(ok)
        a, b = sorted_starts[here], sorted_starts[near[here]]
        if whole_only:
            room = np.minimum(suffixes.stops[a] - a, suffixes.stops[b] - b) >= suffixes.limit
            length = np.where(room & (suffixes.rank[a] == suffixes.rank[b]), suffixes.limit, 0)
        else:
            length = suffixes.common(a, b)
        np.maximum.at(out, order[here], length)
    return out


# --------------------------------------------------------------------------------- the operator


def _decide(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """Repeated starts of the contexts of one bucket, by LPF arrays over all of them.

    ``earlier``: the string also starts at an earlier place, ``any``: at any other one.
    """
    frame = frame.drop_duplicates(["core", "ctx"])  # repeated rows bring a context twice
    frame = frame.sort_values(["doc_id", "first", "core", "ctx"], kind="stable", na_position="first")
    raws = frame["raw"].tolist()
    data = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws])
    ends = np.cumsum(sizes)
    stops = np.repeat(ends, sizes)
    suffixes = Suffixes(data, stops, length)
    # Only the context's own starts are asked for: the bytes behind them are there to be read.
    counts = frame["n"].to_numpy(np.int64)
    before = np.cumsum(counts) - counts
    starts = np.repeat(ends - sizes - before, counts) + np.arange(int(counts.sum()))
    place = np.arange(len(starts))
    earlier = longest_previous_factor(suffixes, starts, place, True) >= length
    either = earlier | (longest_previous_factor(suffixes, starts, -place, True) >= length)
    rows = []
    for k, (core, ctx, n) in enumerate(zip(frame["core"], frame["ctx"], frame["n"])):
        at = before[k]
        for name, flags in (("any", either), ("earlier", earlier)):
            edge = np.diff(flags[at : at + n].astype(np.int8), prepend=0, append=0)
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                rows.append((core, ctx, name, a, b))
    return pd.DataFrame(rows, columns=["core", "ctx", "kind", "a", "b"])


_FOUND = "core bigint, ctx bigint, kind string, a int, b int"


def _context_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (doc_id, h, first, n, core, ctx) with the bytes of each context, read from its text."""
    each = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "n", "core", "ctx")).alias("spans"))
    each = each.select(F.col("doc_id").alias("i"), F.col("h").alias("j"), "spans")
    match = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))
    met = docs.join(each, match).select("doc_id", "spans", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "first", "n", "core", "ctx", "raw"]
        for batch in batches:
            kind = batch.column(0).type
            cols: list[list] = [[] for _ in names]

            def out() -> pa.RecordBatch:
                types = [kind, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

            for row in range(batch.num_rows):
                raw = (batch.column(2)[row].as_py() or "").encode("utf-8", "surrogatepass")
                for s in batch.column(1)[row].as_py():
                    piece = raw[s["first"] : s["first"] + s["n"] + length - 1]
                    values = (batch.column(0)[row].as_py(), s["first"], s["n"], s["core"], s["ctx"], piece)
                    for col, value in zip(cols, values):
                        col.append(value)
                if len(cols[0]) > 2_000:
                    yield out()
                    cols = [[] for _ in names]
            if cols[0]:
                yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(run, f"doc_id {kind}, first bigint, n int, core bigint, ctx bigint, raw binary")


def _by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated starts of contexts that are too many under one anchor for one suffix array.

    Every string of every context becomes a 128-bit hash; hashes are counted, which combines before the
    shuffle, so no task holds an anchor's contexts. The first place of a hash is the kept copy.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "first", "core", "ctx"]
        for batch in batches:
            counts = np.array(batch.column(batch.schema.get_field_index("n")).to_pylist(), np.int64)
            raws = batch.column(batch.schema.get_field_index("raw"))
            marks = []
            for raw, n in zip(raws, counts.tolist()):
                text = raw.as_py()
                marks += [xxhash.xxh3_128_digest(text[i : i + length]) for i in range(n)]
            index = pa.array(np.repeat(np.arange(len(counts)), counts))
            a = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
            cols = [batch.column(batch.schema.get_field_index(c)).take(index) for c in names]
            cols += [pa.array(a, pa.int32()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "a", "mark"])

    kind = contexts.schema["doc_id"].dataType.simpleString()
    once = contexts.dropDuplicates(["core", "ctx"])  # repeated rows bring a context twice
    each = staged(once.mapInArrow(run, f"doc_id {kind}, first bigint, core bigint, ctx bigint, a int, mark binary"))
    at = F.struct("doc_id", (F.col("first") + F.col("a")).alias("p"))
    seen = each.groupBy("mark").agg(F.count("*").alias("c"), F.min(at).alias("least")).where("c > 1")
    met = each.join(seen, "mark").withColumn("later", ~at.eqNullSafe(F.col("least")))
    kinds = F.when(F.col("later"), F.array(F.lit("any"), F.lit("earlier"))).otherwise(F.array(F.lit("any")))
    flagged = met.select("core", "ctx", "a", F.explode(kinds).alias("kind"))
    # Neighbouring starts as one run; a context has few starts, whatever the number of contexts.
    order = Window.partitionBy("core", "ctx", "kind").orderBy("a")
    runs = flagged.withColumn("run", F.col("a") - F.row_number().over(order))
    grouped = runs.groupBy("core", "ctx", "kind", "run").agg(F.min("a").alias("a"), (F.max("a") + 1).alias("b"))
    return grouped.select("core", "ctx", "kind", "a", "b")


def repeated_starts(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_contexts: int = MAX_CONTEXTS
) -> DataFrame:
    """(doc_id, h, kind, a, b): runs a .. b - 1 of starts whose ``length`` bytes repeat.

    ``docs``: doc_id, h (a hash of the text), text. kind "any": the string starts at another place too;
    kind "earlier": at an earlier one, by doc_id and position, so that removing these keeps the first.
    """
    rows = anchor_rows(docs, length, gram)
    # Anchors seen once cannot repeat. Two combined extremes tell whether all contexts are equal.
    cores = rows.groupBy("core").agg(F.count("*").alias("seen"), F.min("ctx").alias("x"), F.max("ctx").alias("y"))
    # Written first, so that both sides of the join are plain shuffles and a hot anchor can be split.
    cores = staged(cores.where("seen > 1").select("core", (F.col("x") != F.col("y")).alias("mixed")))
    near = staged(rows.join(cores, "core"))
    at = F.struct("doc_id", "first", "h", "n")
    groups = near.groupBy("core", "ctx").agg(
        F.count("*").alias("times"), F.min(at).alias("at"), F.max("mixed").alias("mixed")
    )
    groups = staged(groups)
    fine = groups.where("mixed")
    per_core = fine.groupBy("core").agg(F.count("*").alias("contexts"))
    large = per_core.where(F.col("contexts") > max_contexts).select("core")
    wanted = fine.select("at.*", "core", "ctx").distinct()
    contexts = staged(_context_bytes(docs, wanted, length))
    total = contexts.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    buckets = max(1, math.ceil(total / BUCKET_BYTES))
    crowded = contexts.join(large, "core", "left_semi")
    others = contexts.join(large, "core", "left_anti")
    packed = others.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)).cast("int"))
    cols = ["doc_id", "first", "n", "core", "ctx", "raw", "bucket"]
    found = packed.select(*cols).groupBy("bucket").applyInPandas(lambda f: _decide(f, length), _FOUND)
    found = found.unionByName(_by_hash(crowded, length))
    found = staged(found)

    # Equal contexts: each copy repeats as a whole, and all but the first are later ones.
    place = F.struct("doc_id", "first", "h", "n")
    state = groups.select("core", "ctx", "times", F.col("at").alias("least"))
    known = near.join(state, ["core", "ctx"])
    again = known.where("times > 1")
    start = F.col("first")
    spans = [
        again.select("doc_id", "h", F.lit("any").alias("kind"), start.alias("a"), (start + F.col("n")).alias("b")),
        again.where(~place.eqNullSafe(F.col("least"))).select(
            "doc_id", "h", F.lit("earlier").alias("kind"), start.alias("a"), (start + F.col("n")).alias("b")
        ),
    ]
    # What is left is the first copy of each context. (Rows that repeat an id and a text tie on the
    # place, so all of them are first.) One row for each context meets the runs found in it.
    part = known.where(F.col("mixed") & place.eqNullSafe(F.col("least"))).join(found, ["core", "ctx"])
    spans.append(part.select("doc_id", "h", "kind", (start + F.col("a")).alias("a"), (start + F.col("b")).alias("b")))
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


def _merge(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Bytes covered by strings that start in the spans, as disjoint runs in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"] + length - 1) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, keep_first: bool = False, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", max_contexts: int = MAX_CONTEXTS, gram: int = GRAM
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) for every row of ``docs``.

    Bytes covered by a string of ``length`` bytes that also starts elsewhere go; with ``keep_first`` only
    those of strings that start earlier, by id and position, so the first copy stays. Matches never
    cross documents, and strings are judged on the input. kept: the remaining bytes in order. A null text
    is empty; null ids come first; repeated rows are copies of each other. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).select("doc_id", "h", "text")
    found = repeated_starts(rows, length, gram, max_contexts).where(F.col("kind") == ("earlier" if keep_first else "any"))
    each = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    each = each.select(F.col("doc_id").alias("i"), F.col("h").alias("j"), "spans")
    match = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("j"))
    met = rows.join(each, match, "left").select("doc_id", "spans", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for row in range(batch.num_rows):
                raw = batch.column(2)[row].as_py().encode("utf-8", "surrogatepass")
                gone = _merge(batch.column(1)[row].as_py() or [], length)
                edges = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                values = (len(raw), len(raw) - len(kept), len(gone), [{"start": a, "stop": b} for a, b in gone], kept)
                for col, value in zip(cols, values):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names=[id_col, *names])

    schema = f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    return met.mapInArrow(run, schema)


def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
