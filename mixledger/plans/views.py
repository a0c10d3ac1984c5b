"""The harness tables seen as lists, catalogs, recognition windows, histories and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import Scan, scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds_since(ts: Column, origin: str = "2024-01-01 00:00:00") -> Column:
    """Seconds from a fixed moment, whatever the session time zone."""
    span = ts.cast("timestamp_ntz") - F.lit(origin).cast("timestamp_ntz")
    parts = (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60))
    whole = sum(F.extract(F.lit(unit), span).cast("long") * size for unit, size in parts)
    micros = whole * 1_000_000 + (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("long")
    return micros / F.lit(1e6)


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as recognition windows: a user is a set, an event type is a song or an error."""
    failed = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        F.col("user_id").alias("set_id"),
        F.col("event_id").alias("probe_id"),
        seconds_since(F.col("ts")).alias("at"),
        F.when(~failed, F.col("event_type")).alias("song"),
        F.when(failed, F.lit("error")).alias("error"),
        F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("provider"),
        F.when(~failed & (F.col("event_id") % 3 != 0), F.col("value")).alias("song_offset"),
        F.lit(0.0).alias("skew"),
    )


def day_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The same windows with a day of a user as the set, at in seconds of that day."""
    rows = probes(spark, folder)
    day = F.floor(F.col("at") / 86400)
    return rows.withColumns(
        {
            "set_id": F.concat_ws("/", F.col("set_id").cast("string"), day.cast("string")),
            "at": F.col("at") - day * 86400,
        }
    )


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    key = F.col("p_partkey").cast("string")
    return part.select(
        F.lpad(key, 9, "0").alias("recording_id"),
        F.lpad(key, 9, "0").alias("revision_id"),
        F.col("p_brand").alias("artist"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("version"),
        F.concat_ws("|", "p_brand", "p_name", "p_type").alias("identity_key"),
        F.sha2(key, 256).alias("sha256"),
        F.concat(F.lit("/music/"), key).alias("path"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


def files(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Locations and inventory of a catalog: one part size in ten has changed bytes."""
    locations = catalog.select("revision_id", "path", F.lit(True).alias("managed"))
    inventory = catalog.select(
        "path",
        F.when(F.col("size") % 10 == 0, F.lit("changed")).otherwise(F.col("sha256")).alias("sha256"),
        F.lit("readable").alias("status"),
    )
    return locations, inventory


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def list_items(spark: SparkSession, folder: str, light_rows: int | None = 1_000_000) -> DataFrame:
    """Order lines as list items: some ask for another version, some are unknown."""
    line = table(spark, folder, "lineitem").select("l_orderkey", *LINE_ORDER)
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    numbered = scan(
        line,
        ["l_orderkey"],
        LINE_ORDER,
        F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1000)),
        [Scan("position", "number")],
        light_rows=light_rows,
    )
    turn = F.col("l_partkey") % 3
    return numbered.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("list_id"),
        F.col("position").cast("long").alias("position"),
        F.concat_ws("-", "l_orderkey", "position").alias("item_id"),
        F.when(F.col("l_suppkey") % 17 == 0, "unknown").otherwise("named").alias("kind"),
        F.when(turn == 1, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("artist"),
        F.when(turn == 1, F.concat("p_name", F.lit(" ["), "p_type", F.lit("]")))
        .otherwise(F.col("p_name"))
        .alias("title"),
        F.when(turn == 0, F.col("p_type")).when(turn == 1, "").otherwise("VIP Mix").alias("version"),
        F.col("l_shipdate").alias("added_at"),
    )


def _numbered(spark: SparkSession, folder: str, light_rows: int | None) -> DataFrame:
    line = table(spark, folder, "lineitem").select("l_orderkey", *LINE_ORDER)
    return scan(
        line,
        ["l_orderkey"],
        LINE_ORDER,
        F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1000)),
        [Scan("position", "number")],
        light_rows=light_rows,
    )


def numbered_ids(spark: SparkSession, folder: str, light_rows: int | None = 1_000_000) -> DataFrame:
    """Order lines as list, position and recording, where no label is asked for."""
    return _numbered(spark, folder, light_rows).select(
        F.col("l_orderkey").alias("list_id"),
        F.col("position").cast("long").alias("position"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("recording_id"),
    )


def numbered_lines(spark: SparkSession, folder: str, light_rows: int | None = 1_000_000) -> DataFrame:
    """Order lines as they are: list, position, and the part's labels."""
    numbered = _numbered(spark, folder, light_rows)
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return numbered.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("list_id"),
        F.col("position").cast("long").alias("position"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("recording_id"),
        F.col("p_brand").alias("artist"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("version"),
    )
