"""Set identification over the events table: a user's day is a set, hours are its pace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion
from . import views
from .registry import query

PACE = dict(stride=21600.0, size=86400.0, bridge=86400.0, fold=86400.0, window=21600.0, gap=43200.0, song_seconds=43200.0, id_reach=21600.0)


def probes(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.probes(spark, folder)
    return rows.select(
        "set_id", "probe_id", "at", "error", "provider", "song_offset", "skew",
        F.when(F.col("song").isNotNull(), F.lit("Various")).alias("artist"),
        F.col("song").alias("title"),
        F.lit("").alias("version"),
    ).withColumn("song_offset", F.lit(None).cast("double"))


def listings(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's clicks and views as a description, timed; every seventh entry is an ID."""
    rows = views.probes(spark, folder).where(F.col("song").isin("click", "view") & (F.col("probe_id") % 5 == 0))
    known = F.col("probe_id") % 7 != 0
    return rows.select(
        "set_id",
        F.lit("description").alias("source"),
        F.col("probe_id").alias("position"),
        F.when(known, "named").otherwise("unknown").alias("kind"),
        F.when(known, F.lit("Various")).alias("artist"),
        F.when(known, F.col("song")).alias("title"),
        F.lit("").alias("version"),
        F.when(F.col("probe_id") % 3 != 0, F.col("at")).alias("seconds"),
    )


@query()
def identify_sets(spark: SparkSession, folder: str) -> DataFrame:
    found = fusion.identify_sets(probes(spark, folder), listings(spark, folder), **PACE)
    return found["tracks"].select("set_id", "position", "start", "approx", "kind", "title", "status", "heard")


@query()
def recognized_sets(spark: SparkSession, folder: str) -> DataFrame:
    found = fusion.identify_sets(probes(spark, folder), **PACE)
    return found["tracks"].select("set_id", "position", "start", "kind", "title", "status")


@query()
def set_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found = fusion.identify_sets(probes(spark, folder), listings(spark, folder), **PACE)
    return found["coverage"].select("set_id", "duration", "seconds_heard", "tracks", "heard", "listed_only", "ids")
