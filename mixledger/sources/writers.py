"""Writers. Ordered text goes out sorted by range, so no list is gathered into one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label
from ..functions.text import safe_name


def _ordered_text(lines: DataFrame, folder: str, path: str) -> None:
    """lines[folder, place, value] as text under ``folder=...``, in order within and across files."""
    ranged = lines.repartitionByRange(folder, "place").sortWithinPartitions(folder, "place")
    ranged.select(folder, "value").write.mode("overwrite").partitionBy(folder).text(path)


def write_m3u(members: DataFrame, path: str) -> None:
    """members[collection_id, position, artist, title, version, path, duration] as playlists."""
    seconds = F.coalesce(F.round("duration").cast("long"), F.lit(-1)).cast("string")
    info = F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), label("artist", "title", "version"))
    body = members.select(
        "collection_id",
        F.posexplode(F.array(info, F.col("path"))).alias("half", "value"),
        F.col("position"),
    ).select("collection_id", (F.col("position") * 2 + F.col("half") + 1).cast("long").alias("place"), "value")
    head = members.select("collection_id").distinct().select("collection_id", F.lit(-1).cast("long").alias("place"), F.lit("#EXTM3U").alias("value"))
    _ordered_text(head.unionByName(body), "collection_id", path)


def file_uri(path: Column) -> Column:
    """A local path as a URI, slashes kept and spaces as %20."""
    encoded = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("file://localhost"), encoded)


def collection_track_xml(members: DataFrame) -> DataFrame:
    """collection_id, place, value: one TRACK element per member, attributes escaped by ``to_xml``."""
    track = F.struct(
        F.col("track_id").cast("string").alias("_TrackID"),
        F.col("title").alias("_Name"),
        F.col("artist").alias("_Artist"),
        F.col("version").alias("_Mix"),
        F.round("duration").cast("long").cast("string").alias("_TotalTime"),
        file_uri(F.col("path")).alias("_Location"),
    )
    xml = F.to_xml(track, {"rowTag": "TRACK"})
    return members.select("collection_id", F.col("position").cast("long").alias("place"), xml.alias("value"))


def write_collection_xml(members: DataFrame, path: str) -> None:
    """A collection and playlist file per collection, streamed line by line in order."""
    rows = members.withColumn("track_id", F.col("position") + 1)
    counts = rows.groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"))
    n = F.col("n").cast("string")
    plain = F.col("name")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        plain = F.replace(plain, F.lit(mark), F.lit(entity))
    size = 10**12

    def line(place: int, *parts: str | Column) -> Column:
        text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
        return F.struct(F.lit(place).cast("long").alias("place"), text.alias("value"))

    heads = counts.select(
        "collection_id",
        F.inline(
            F.array(
                line(-1, '<DJ_PLAYLISTS Version="1.0.0"><COLLECTION Entries="', n, '">'),
                line(
                    size,
                    '</COLLECTION><PLAYLISTS><NODE Type="0" Name="ROOT" Count="1"><NODE Type="1" KeyType="0" Name="',
                    plain,
                    '" Entries="',
                    n,
                    '">',
                ),
                line(3 * size, "</NODE></NODE></PLAYLISTS></DJ_PLAYLISTS>"),
            )
        ),
    )
    keys = rows.select(
        "collection_id",
        (F.col("position") + size + 1).cast("long").alias("place"),
        F.concat(F.lit('<TRACK Key="'), F.col("track_id").cast("string"), F.lit('"/>')).alias("value"),
    )
    lines = heads.unionByName(collection_track_xml(rows)).unionByName(keys)
    _ordered_text(lines, "collection_id", path)


def write_manifest(members: DataFrame, path: str) -> None:
    """JSON lines: a summary per collection and one row per track."""
    summary = members.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("tracks"), F.count_distinct("recording_id").alias("unique_tracks")
    )
    summary.write.mode("overwrite").json(f"{path}/summary")
    members.write.mode("overwrite").partitionBy("collection_id").json(f"{path}/tracks")


def write_missing_report(checked: DataFrame, path: str) -> None:
    """Items of each list that are not satisfied, as JSON under the list."""
    checked.where(F.col("state") != "satisfied").write.mode("overwrite").partitionBy("list_id").json(path)


def write_tracklist_text(lines: DataFrame, path: str) -> None:
    """lines[list_id, line_no, line] as text per list."""
    _ordered_text(lines.select("list_id", F.col("line_no").cast("long").alias("place"), F.col("line").alias("value")), "list_id", path)


def write_analysis_xml(tracks: DataFrame, path: str) -> None:
    """tracks[device_id, position, path, bpm, key] of verified tracks as XML lines."""
    row = F.struct(file_uri(F.col("path")).alias("_Location"), F.format_string("%.2f", "bpm").alias("_AverageBpm"), F.col("key").alias("_Tonality"))
    lines = tracks.select("device_id", F.col("position").cast("long").alias("place"), F.to_xml(row, {"rowTag": "TRACK"}).alias("value"))
    _ordered_text(lines, "device_id", path)


def name_collisions(lists: DataFrame) -> DataFrame:
    """lists[list_id, name, created_at] plus ``file_name``: of equal safe names the oldest keeps its
    own, the others get a short code."""
    rows = lists.withColumn("_safe", safe_name("name"))
    oldest = rows.groupBy(F.lower("_safe").alias("_low")).agg(F.min_by("list_id", F.struct("created_at", "list_id")).alias("_first"))
    rows = rows.join(oldest, F.lower("_safe") == F.col("_low"))
    code = F.substring(F.sha2(F.col("list_id").cast("string"), 256), 1, 6)
    return rows.select(
        *lists.columns,
        F.when(F.col("list_id") == F.col("_first"), F.col("_safe")).otherwise(F.concat("_safe", F.lit(" "), code)).alias("file_name"),
    )
