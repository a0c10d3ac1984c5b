"""Two orders laid over one another: the heaviest matching that keeps both (a listing and what was heard)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import LIGHT_ROWS, Hot, Scan, hot_groups, scan

#: Entries of a set that are scanned together once a set is too large for one task.
ENTRIES = 10_000


def pieces(pairs: DataFrame, *, light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None) -> DataFrame:
    """``pairs`` plus ``piece``: parts of a set that no choice in one can spoil in another.

    pairs[set_id, entry, play, ...]. A border stands before an entry when every play that earlier entries
    could take lies before every play that this and later ones could take. Songs are listed about where they
    are heard, so a long set falls into many small pieces.
    """
    hot = hot or hot_groups(pairs, ["set_id"], light_rows)
    span = pairs.groupBy("set_id", "entry").agg(F.min("play").alias("_min"), F.max("play").alias("_max"))
    span = span.withColumn("_back", -F.col("entry"))
    part = F.floor(F.col("entry") / ENTRIES)
    span = scan(span, ["set_id"], ["entry"], part, [Scan("_low", "max_before", F.col("_max"))], hot=hot)
    # The least play from here on, as a running maximum from the other end.
    span = scan(span, ["set_id"], ["_back"], F.floor(F.col("_back") / ENTRIES), [Scan("_high", "max", -F.col("_min"))], hot=hot)
    border = F.when(F.col("_low").isNull() | (F.col("_low") < -F.col("_high")), 1).otherwise(0)
    span = scan(span, ["set_id"], ["entry"], part, [Scan("piece", "sum", border)], hot=hot)
    return pairs.join(span.select("set_id", "entry", "piece"), ["set_id", "entry"])


class Staircase:
    """Best chain that ends at or before each play: plays and values both rise from step to step."""

    def __init__(self) -> None:
        self.plays: list[int] = []
        self.values: list[tuple[int, int]] = []
        self.rows: list[int] = []

    def before(self, play: int) -> tuple[tuple[int, int], int]:
        """(value, row) of the best chain that ends before ``play``; row -1: none."""
        at = bisect_left(self.plays, play) - 1
        return (self.values[at], self.rows[at]) if at >= 0 else ((0, 0), -1)

    def add(self, play: int, value: tuple[int, int], row: int) -> None:
        at = bisect_left(self.plays, play)
        if at and self.values[at - 1] >= value:
            return
        if at < len(self.plays) and self.plays[at] == play and self.values[at] >= value:
            return
        end = at
        while end < len(self.plays) and self.values[end] <= value:
            end += 1
        self.plays[at:end], self.values[at:end], self.rows[at:end] = [play], [value], [row]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair with its number in the piece and the number of the pair before it; at the end of a piece its best last pair.

    Rows come sorted by (set, piece, entry, play downwards). Only the staircase of the open piece is held.
    """
    key, steps, n = None, Staircase(), 0

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("set_id", "piece", "entry", "play", "score", "tie")), strict=True):
            if row[:2] != key:
                if key is not None:
                    out.append((*key, n, None, None, None, None, steps.rows[-1]))
                key, steps, n = row[:2], Staircase(), 0
            entry, play, score, tie = row[2:]
            (so_far, ties), last = steps.before(play)
            steps.add(play, (so_far + score, ties + tie), n)
            out.append((*key, n, entry, play, score, tie, last))
            n += 1
        if out:
            yield _batch(out, batch.schema)
        schema = batch.schema
    if key is not None:
        yield _batch([(*key, n, None, None, None, None, steps.rows[-1])], schema)


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    kinds = [like.field("set_id").type, *[pa.int64()] * 7]
    names = ["set_id", "piece", "n", "entry", "play", "score", "tie", "last"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the chain of each piece from its end; rows come sorted by (set, piece, number downwards)."""
    key, want = None, -1
    for batch in batches:
        keep = []
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("set_id", "piece", "n", "entry", "last")), strict=True)):
            if row[:2] != key:
                key, want = row[:2], row[4]
            elif row[2] == want:
                keep.append(i)
                want = row[4]
        if keep:
            chosen = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([chosen.column(c) for c in ("set_id", "entry", "play", "score", "tie")], names=["set_id", "entry", "play", "score", "tie"])


def align(pairs: DataFrame, *, light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None) -> DataFrame:
    """set_id, entry, play, score, tie: the pairs kept, no entry and no play twice, both in rising order.

    pairs[set_id, entry, play, score, tie] with whole numbers, score above 0. Kept is a set of pairs of the highest total
    score and, among those, of the highest total tie; where both are equal, the one found first by entry, then by
    later play. A repeated pair counts once. Only pieces of a set are sorted and walked through, in one task each,
    and what a task holds is one number for each play of a piece.
    """
    kind = pairs.schema["set_id"].dataType.simpleString()
    whole = [F.col(c).cast("long").alias(c) for c in ("entry", "play", "score", "tie")]
    rows = pairs.select("set_id", *whole).groupBy("set_id", "entry", "play").agg(F.max(F.struct("score", "tie")).alias("_b"))
    rows = rows.select("set_id", "entry", "play", "_b.score", "_b.tie")
    cut = pieces(rows, light_rows=light_rows, hot=hot).select("set_id", F.col("piece").cast("long").alias("piece"), "entry", "play", "score", "tie")
    placed = cut.repartition("set_id", "piece").sortWithinPartitions("set_id", "piece", "entry", F.desc("play"))
    schema = f"set_id {kind}, piece bigint, n bigint, entry bigint, play bigint, score bigint, tie bigint, last bigint"
    chains = placed.mapInArrow(_chains, schema)
    # Rows of a piece are still together, so going back over them needs a sort and no shuffle.
    back = chains.sortWithinPartitions("set_id", "piece", F.desc("n"))
    return back.mapInArrow(_picked, f"set_id {kind}, entry bigint, play bigint, score bigint, tie bigint")


def listed_pairs(entries: DataFrame, plays: DataFrame, score: Column, *, same: list[str], reach: float) -> DataFrame:
    """Pairs of entries[set_id, entry, at, ...] and plays[set_id, play, at, ...] that agree in ``same`` within ``reach`` seconds.

    ``score`` reads the columns of ``entries`` under their names and those of ``plays`` with a ``heard_`` in front. Both meet in
    time bins, so a song that is played all through a set is not paired with itself everywhere. Of equal
    scores the nearer pair wins: ``tie`` falls by one for each thousandth of a minute, down to ten minutes.
    """
    bin = F.floor(F.col("at") / reach).cast("long")
    a = entries.withColumn("_bin", F.explode(F.sequence(bin - 1, bin + 1)))
    b = plays.withColumn("_bin", bin)
    b = b.select("set_id", "_bin", "play", *same, *(F.col(c).alias(f"heard_{c}") for c in plays.columns if c not in ("set_id", "play", *same)))
    apart = F.abs(F.col("at") - F.col("heard_at"))
    tie = -F.round(F.least(apart, F.lit(600.0)) / 60 * 1000)
    met = a.join(b, ["set_id", "_bin", *same]).where(apart <= reach)
    return met.select("set_id", "entry", "play", score.cast("long").alias("score"), tie.cast("long").alias("tie"))
