"""What listeners suggest for the IDs of a set, and the chunks a scan must cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import near

#: Seconds before an ID, the least and most after it, and its length where no end is known.
BEFORE, LEAST_AFTER, MOST_AFTER, OPEN_LENGTH = 90.0, 120.0, 600.0, 300.0


def reach_after(start: Column, end: Column, least: float = LEAST_AFTER, most: float = MOST_AFTER, length: float = OPEN_LENGTH) -> Column:
    """Seconds after the start of an ID in which a comment can mean it: its own length within bounds."""
    return F.greatest(F.least(F.coalesce(end, start + length) - start, F.lit(most)), F.lit(least))


def id_hints(
    ids: DataFrame,
    hints: DataFrame,
    named: DataFrame,
    *,
    before: float = BEFORE,
    least: float = LEAST_AFTER,
    most: float = MOST_AFTER,
    length: float = OPEN_LENGTH,
) -> DataFrame:
    """(set_id, entry_id, artist, title, mentions, likes): the songs that may be meant by each ID.

    ids[set_id, entry_id, at, end, previous, following]: start and end in seconds and the titles on either side (null: none);
    hints[set_id, seconds, artist, title, mentions, likes]; named[set_id, title]: songs of the tracklist. A hint goes
    where its title is in the tracklist, or one of its halves is the title on either side, since listeners swap
    artist and title. Titles are compared as given: fold them first. An ID without a start gets none; an end before
    the start counts as the least reach. Equal hints of an ID are added up.
    """
    free = hints.join(named.select("set_id", "title").distinct(), ["set_id", "title"], "left_anti")
    met = near(ids.where(F.col("at").isNotNull()), free, before=before, after=most)
    inside = F.col("seconds") <= F.col("at") + reach_after(F.col("at"), F.col("end"), least, most, length)

    def beside(title: str) -> Column:
        return F.coalesce((F.col(title) != "") & F.col(title).isin(F.col("artist"), F.col("title")), F.lit(False))

    return (
        met.where(inside & ~beside("previous") & ~beside("following"))
        .groupBy("set_id", "entry_id", "artist", "title")
        .agg(F.sum("mentions").alias("mentions"), F.sum("likes").alias("likes"))
    )


def fill_chunks(chunks: DataFrame, totals: DataFrame, *, length: float, skip: int = 0) -> DataFrame:
    """(set_id, at, song): every chunk of a scan, named or not.

    chunks[set_id, at, song, score] are what a service answered (chunks it could not name may be absent);
    totals[set_id, total] are lengths in seconds. A scan has a chunk at each multiple of ``length * (skip + 1)``
    that fits in whole. Of several answers at one time the best scored song stays, the least name on a tie;
    answers off the grid stay too, those without a time go.
    """
    step = length * (skip + 1)
    last = F.floor((F.col("total") - length) / step).cast("long")
    every = totals.where(F.col("total") >= length).select("set_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k"))
    grid = every.select("set_id", (F.col("_k") * step).cast("double").alias("at"))
    rank = F.struct(F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    best = (
        chunks.where(F.col("at").isNotNull())
        .groupBy("set_id", F.col("at").cast("double").alias("at"), "song")
        .agg(F.max(rank).alias("rank"))
        .groupBy("set_id", "at")
        .agg(F.min(F.when(F.col("song").isNotNull(), F.struct((-F.col("rank.score")).alias("s"), "song"))).alias("_best"))
    )
    every = grid.unionByName(best.select("set_id", "at")).distinct()
    return every.join(best, ["set_id", "at"], "left").select("set_id", "at", F.col("_best.song").alias("song"))
