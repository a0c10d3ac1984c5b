"""Benchmark decontamination over a positional inverted index of the training texts."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

WINDOW_WORDS = 13
#: A document is contaminated when at least one word in this many is hit.
HIT_SHARE = 20
#: Text bytes of one index segment; a longer document is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Words of test text that one search holds in memory; a larger test set is searched in blocks.
BLOCK_WORDS = 2_000_000
#: Unused positions between documents, so that no phrase or proximity match crosses them.
GAP = 256

#: Letters, digits and all bytes of non-ASCII code points; A-Z become a-z; the rest splits words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


# ---------------------------------------------------------------------------------------- index


def build_index(
    docs: DataFrame, vocabulary: set[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Positional postings of whole texts, one row per segment of documents. No shuffle.

    ids and n_words describe the segment's documents in order; terms, counts and postings are
    parallel: for each term the increasing positions in the segment, as differences in
    little-endian 32-bit integers. ``vocabulary`` restricts the index to words that tests name;
    None indexes every word. Null and empty texts are documents without words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"segment string, ids array<{kind}>, n_words array<int>, starts array<bigint>, "
        "terms array<binary>, counts array<bigint>, postings array<binary>"
    )

    def segment(ids: list, texts: list) -> dict:
        known: dict[bytes, int] = {word: i for i, word in enumerate(vocabulary or ())}
        parts, sizes, starts, at = [], [], [], 0
        for text in texts:
            words = words_of(text)
            if vocabulary is None:
                for word in words:
                    known.setdefault(word, len(known))
            found = np.fromiter((known.get(w, -1) for w in words), np.int32, len(words))
            here = np.flatnonzero(found >= 0)
            parts.append((found[here], here + at))
            sizes.append(len(words))
            starts.append(at)
            at += len(words) + GAP
        term = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        place = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        names = list(known)
        runs = np.split(place, first[1:]) if len(first) else []
        return {
            "segment": uuid.uuid4().hex,
            "ids": ids,
            "n_words": sizes,
            "starts": starts,
            "terms": [names[t] for t in term[first].tolist()],
            "counts": [len(r) for r in runs],
            "postings": [np.diff(r, prepend=0).astype("<u4").tobytes() for r in runs],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, texts: list) -> pa.RecordBatch:
            row = segment(ids, texts)
            fields = {
                "segment": pa.string(),
                "ids": pa.list_(id_type),
                "n_words": pa.list_(pa.int32()),
                "starts": pa.list_(pa.int64()),
                "terms": pa.list_(pa.binary()),
                "counts": pa.list_(pa.int64()),
                "postings": pa.list_(pa.binary()),
            }
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in fields.items()], list(fields))

        ids, texts, held, id_type = [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                value = text.as_py()
                if ids and held + len(value or "") > SEGMENT_BYTES:
                    yield out(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(key.as_py())
                texts.append(value)
                held += len(value or "")
        if ids:
            yield out(ids, texts)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n) over the whole index."""
    each = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return each.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))


# --------------------------------------------------------------------------------------- search


def _windows(items: list[tuple[str | None, list[bytes]]], n: int) -> dict[tuple, set[str]]:
    """The windows of the items, each with the items that hold it; an item without an id has windows but no name."""
    found: dict[tuple, set[str]] = defaultdict(set)
    for item, words in items:
        for i in range(max(1, len(words) - n + 1) if words else 0):
            found[tuple(words[i : i + n])].update([] if item is None else [item])
    return found


def search(index: DataFrame, items: list[tuple[str | None, list[bytes]]], window_words: int = WINDOW_WORDS, slop: int | None = None) -> DataFrame:
    """For every indexed document the words that windows of ``items`` hit, and the items found.

    A window starts from the postings of its globally rarest term and intersects the postings of
    the next rarest ones, shifted by their offset in the window, until none or the exact phrase is
    left. With ``slop`` the proximity matches come too: every term of the window lies within
    window length + slop words of one occurrence of the rarest term (at most ``GAP`` - 1).
    Result: segment, ordinal, id, n_words, runs (start, stop of hit words), items, near_items.
    """
    windows = _windows(items, window_words)
    counts = {bytes(r.term): r.n for r in term_counts(index).collect()}  # at most the items' words
    plans: dict[bytes, list] = defaultdict(list)
    for words, names in windows.items():
        if all(w in counts for w in words):
            order = sorted(range(len(words)), key=lambda i: (counts[words[i]], i))
            plans[words[order[0]]].append((words, order, sorted(names)))
    plans = dict(plans)
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = (
        f"segment string, ordinal int, id {id_kind}, n_words int, "
        "runs array<struct<start:int,stop:int>>, items array<string>, near_items array<string>"
    )

    def one(row: dict) -> dict:
        place = {bytes(t): i for i, t in enumerate(row["terms"])}
        starts = np.array(row["starts"], np.int64)
        sizes = np.array(row["n_words"], np.int64)
        total = int(starts[-1] + sizes[-1] + GAP)
        marks = np.zeros(total + 1, np.int32)
        names_of: list[set] = [set() for _ in sizes]
        near_of: list[set] = [set() for _ in sizes]
        read: dict[bytes, np.ndarray] = {}

        def postings(word: bytes) -> np.ndarray:
            if word not in read:
                at = place.get(word)
                raw = row["postings"][at] if at is not None else b""
                read[word] = np.cumsum(np.frombuffer(raw, "<u4").astype(np.int64))
            return read[word]

        def note(found: np.ndarray, names: list[str], into: list[set]) -> None:
            for doc in np.unique(np.searchsorted(starts, found, "right") - 1).tolist():
                into[doc].update(names)

        for rarest, plan in plans.items():
            if rarest not in place:
                continue
            for words, order, names in plan:
                left = postings(rarest) - order[0]
                for i in order[1:]:
                    if not len(left):
                        break
                    there = postings(words[i])
                    at = np.searchsorted(there, left + i)
                    at[at == len(there)] = 0
                    left = left[there[at] == left + i] if len(there) else left[:0]
                if len(left):
                    np.add.at(marks, left, 1)
                    np.add.at(marks, left + len(words), -1)
                    note(left, names, names_of)
                if slop is not None:
                    reach = min(len(words) - 1 + slop, GAP - 1)
                    around = postings(rarest)
                    for word in set(words) - {rarest}:
                        there = np.append(postings(word), np.iinfo(np.int64).max)
                        around = around[there[np.searchsorted(there, around - reach)] <= around + reach]
                    note(around, names, near_of)
        hit = (np.cumsum(marks)[:-1] > 0).astype(np.int8)
        edge = np.diff(hit, prepend=0, append=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        runs: list[list] = [[] for _ in sizes]
        for doc, a, b in zip((np.searchsorted(starts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist()):
            runs[doc].append({"start": a - row["starts"][doc], "stop": b - row["starts"][doc]})
        return {
            "segment": [row["segment"]] * len(sizes),
            "ordinal": list(range(len(sizes))),
            "id": row["ids"],
            "n_words": row["n_words"],
            "runs": runs,
            "items": [sorted(x) for x in names_of],
            "near_items": [sorted(x) for x in near_of],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                got = one(row.to_pylist()[0])
                types = {
                    "segment": pa.string(),
                    "ordinal": pa.int32(),
                    "id": row.schema.field("ids").type.value_type,
                    "n_words": pa.int32(),
                    "runs": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])),
                    "items": pa.list_(pa.string()),
                    "near_items": pa.list_(pa.string()),
                }
                yield pa.RecordBatch.from_arrays([pa.array(got[k], t) for k, t in types.items()], list(types))

    return index.mapInArrow(run, schema)


def _blocks(tests: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """The test items in blocks of bounded size, one partition at a time on the driver."""
    rows = tests.select(F.col(id_col).cast("string"), text_col)
    block, held = [], 0
    for item, text in rows.toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((item, words))
        held += len(words)
    yield block


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window_words: int = WINDOW_WORDS,
    slop: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, n_words, runs, items, near_items, n_hit, contaminated) for every row of ``docs``.

    A window is ``window_words`` consecutive words of an item; a shorter item that has words is one
    window. A word is hit when it lies inside any occurrence of a window. A test item without an
    id hits words and is not named among the items; one without words hits nothing. Null and empty texts have no words and no hits. Repeated
    document rows give a row each. A test set beyond ``block_words`` words is searched block by
    block and the hits of a document are united, so nothing about the tests is unbounded.
    """
    blocks = _blocks(tests, item_col, text_col, block_words)
    first, second = next(blocks), next(blocks, None)
    # One block asks for its own words; several blocks share an index of every word.
    vocabulary = {w for _, words in first for w in words} if second is None else None
    index = staged(build_index(docs.select(id_col, text_col), vocabulary, id_col, text_col))
    found = search(index, first, window_words, slop)
    if second is not None:
        for block in chain([second], blocks):
            found = found.unionByName(search(index, block, window_words, slop))
        found = found.groupBy("segment", "ordinal").agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("runs")).alias("runs"),  # at most one run per word and block
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
        )
    # Runs of several blocks may overlap: count from the furthest stop so far.
    swept = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["stop"] - F.greatest(r["start"], acc["to"]))).alias("n"),
            F.greatest(acc["to"], r["stop"]).alias("to"),
        ),
    )
    n_hit = swept["n"].cast("long")
    n_words = F.col("n_words").cast("long")
    return found.select(
        F.col("id").alias(id_col),
        n_words.alias("n_words"),
        "runs",
        "items",
        "near_items",
        n_hit.alias("n_hit"),
        ((n_hit > 0) & (n_hit * HIT_SHARE >= n_words)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, in all their columns.

    Verdicts are joined back by id and text, so rows that repeat an id are judged by their own text.
    """
    keyed = docs.withColumns({"_h": F.xxhash64(text_col)})
    bad = (
        contamination(docs.select(F.struct(id_col, F.xxhash64(text_col).alias("h")).alias("_k"), text_col), tests, "_k", text_col)
        .where("contaminated")
        .select(F.col(f"_k.{id_col}").alias("_id"), F.col("_k.h").alias("_bad"))
        .distinct()
    )
    match = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_bad"))
    return keyed.join(bad, match, "left_anti").select(*docs.columns)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_LETTERS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LETTERS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
with items as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, len(w[i : i + 12]) as n, array_to_string(w[i : i + 12], ' ') as gram
  from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) as i from items where len(w) > 0)
),
docs as (select doc_id, {_WORDS} as w from documents),
sizes as (select distinct n from windows),
grams as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as gram
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, sizes where len(w) >= n)
),
found as (select g.doc_id, g.i, g.n, x.item_id from grams g join windows x on g.n = x.n and g.gram = x.gram),
hits as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
),
named as (
  select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct item_id, ',' order by item_id)) as s
  from found group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs d left join hits using (doc_id) left join named using (doc_id)
"""
