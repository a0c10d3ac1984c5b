"""Joins on time: what lies near a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEFORE = 90.0
AFTER = 300.0


def near(
    moments: DataFrame, rows: DataFrame, *, before: float = BEFORE, after: float = AFTER, key: str = "set_id"
) -> DataFrame:
    """moments[key, at] with rows[key, seconds] where at - before <= seconds <= at + after.

    Both sides meet on (key, time bin), so a busy set spreads over its bins. A moment is sent to every
    bin its span touches (at most one more than span / bin width).
    """
    width = before + after
    low = F.floor((F.col("at") - before) / width)
    high = F.floor((F.col("at") + after) / width)
    left = moments.withColumn("_bin", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    right = rows.withColumn("_bin", F.floor(F.col("seconds") / width).cast("long"))
    return left.join(right, [key, "_bin"]).where(
        F.col("seconds").between(F.col("at") - before, F.col("at") + after)
    ).drop("_bin")


def rank_hints(
    mentions: DataFrame,
    moments: DataFrame | None = None,
    *,
    before: float = BEFORE,
    after: float = AFTER,
    k: int | None = None,
) -> DataFrame:
    """What listeners named near each moment (or anywhere), best first: all songs, or the first k.

    mentions[set_id, n, artist, title, song, seconds, likes]. A comment counts once per song; songs
    rank by mentions, likes, closeness and first comment.
    """
    keys = ["set_id", "song"]
    if moments is None:
        rows = mentions.withColumn("_gap", F.col("seconds"))
    else:
        keys = ["set_id", "at", "song"]
        # Mentions at one second by one comment are one row before they are paired.
        single = mentions.where(F.col("seconds").isNotNull()).groupBy("set_id", "song", "n", "seconds").agg(
            F.max("likes").alias("likes"), F.min(F.struct("artist", "title")).alias("_label")
        )
        rows = near(moments, single, before=before, after=after).select("*", "_label.*").drop("_label")
        rows = rows.withColumn("_gap", F.abs(F.col("seconds") - F.col("at")))
    per_comment = rows.groupBy(*keys, "n").agg(
        F.max("likes").alias("likes"),
        F.min(F.struct(F.col("_gap").isNull(), "_gap", "seconds")).alias("_near"),
        F.min(F.struct("artist", "title")).alias("_label"),
    )
    songs = per_comment.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("mentions"),
        F.sum("likes").alias("likes"),
        F.min("_near").alias("_near"),
        F.min("n").alias("first"),
        F.min_by("_label", "n").alias("_label"),
    )
    w = Window.partitionBy(*keys[:-1]).orderBy(
        F.desc("mentions"), F.desc("likes"), F.col("_near._gap").asc_nulls_last(), F.asc("first"), F.asc("song")
    )
    ranked = songs.withColumn("rank", F.row_number().over(w))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    return ranked.select(*keys, "_label.artist", "_label.title", "mentions", "likes", F.col("_near.seconds").alias("at_seconds"), "rank")
