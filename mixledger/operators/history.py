"""Listening histories: one row per song, repeats, lists of a thousand, and import marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import with_forms
from ..session import spread
from .graph import components
from .scan import LIGHT_ROWS, Hot, Scan, scan

LIST_SIZE = 1000
FIRST_FIELDS = ["artist", "title", "isrc", "shazam_key", "apple_music_id", "location"]


def with_song_keys(records: DataFrame) -> DataFrame:
    """Records plus ``isrc_key``, ``label_key`` and ``credit_key``; labels are folded once each."""
    rows = records.withColumns(
        {"_a": F.coalesce("artist", F.lit("")), "_t": F.coalesce("title", F.lit("")), "_v": F.lit("")}
    )
    known = with_forms(spread(rows.select("_a", "_t", "_v").distinct()), "_a", "_t", "_v").select(
        "_a", "_t", "label_key", "credit_key"
    )
    isrc = F.nullif(F.replace("isrc", F.lit("-"), F.lit("")), F.lit("")) if "isrc" in records.columns else F.lit(None)
    return rows.join(known, ["_a", "_t"], "left").select(
        *records.columns, isrc.cast("string").alias("isrc_key"), "label_key", "credit_key"
    )


def _fold(rows: DataFrame, keys: list[str], order: str, *more: Column) -> DataFrame:
    fields = [c for c in FIRST_FIELDS if c in rows.columns]
    last = F.coalesce("last_shazamed_at", "shazamed_at") if "last_shazamed_at" in rows.columns else F.col("shazamed_at")
    count = F.coalesce("count", F.lit(1)) if "count" in rows.columns else F.lit(1)
    when = F.struct(F.col("shazamed_at").isNull(), "shazamed_at", order)
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in fields]
    return rows.groupBy(*keys).agg(
        *firsts,
        F.min("shazamed_at").alias("shazamed_at"),
        F.max(F.greatest(last, "shazamed_at")).alias("last_shazamed_at"),
        F.sum(count).alias("count"),
        F.min(when).alias("_order"),
        *more,
    )


def with_songs(records: DataFrame, order: str = "position") -> DataFrame:
    """Records with their keys and ``song``: what shares an ISRC, a label or a credit is one song.

    Keys link directly or through other records of the user, whatever the order of the records. A record without a
    title links by its ISRC alone, and one without any key is a song of its own, so unlabelled records
    never meet in one group. A record stands under its first key; first keys are linked only where a key
    stands in records of several, to the least of them, so keys of one record alone cost no round of linking.
    """
    rows = with_song_keys(records)
    titled = F.trim(F.coalesce("title", F.lit(""))) != ""
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("i:"), F.col("isrc_key")),
            F.when(titled, F.concat(F.lit("l:"), F.col("label_key"))),
            F.when(titled, F.concat(F.lit("c:"), F.col("credit_key"))),
        )
    )
    user = F.coalesce(F.col("user_id").cast("string"), F.lit(""))
    nodes = F.transform(keys, lambda k: F.concat(user, F.lit("\u001f"), k))
    alone = F.concat(user, F.lit("\u001f"), F.lit("r:"), F.coalesce(F.col(order).cast("string"), F.lit("")))
    rows = rows.withColumns({"_nodes": nodes, "_first": F.coalesce(F.get(nodes, F.lit(0)), alone)})
    met = rows.select("_first", F.explode("_nodes").alias("_key"))
    shared = met.groupBy("_key").agg(F.min("_first").alias("_least"), F.max("_first").alias("_last")).where("_least != _last")
    edges = met.join(shared, "_key").select(F.col("_first").alias("a"), F.col("_least").alias("b"))
    roots = components(edges).select(F.col("node").alias("_first"), "root")
    label = F.when(titled, F.col("label_key"))
    return rows.join(roots, "_first", "left").select(
        *records.columns,
        "isrc_key",
        "label_key",
        "credit_key",
        F.coalesce("root", "_first").alias("song"),
        label.alias("_label"),
    )


def history_merge(records: DataFrame, *, order: str = "position") -> DataFrame:
    """One row per song and user: sums and firsts, which combine before the shuffle.

    ``song_key`` is the song's first label in text order, else its first ISRC, else its place.
    """
    rows = with_songs(records, order)
    named = F.coalesce(F.min("_label"), F.min("isrc_key"), F.first("song")).alias("song_key")
    songs = _fold(rows, ["user_id", "song"], order, named)
    return songs.select("song_key", *(c for c in songs.columns if c not in ("song_key", "_order", "song")))


#: The linked merge is the only one; the name is kept for callers.
history_merge_linked = history_merge


def since_filter(records: DataFrame, moment, *, inclusive: bool = True) -> DataFrame:
    """Records at or after a moment (strictly after unless ``inclusive``); undated ones go."""
    at = F.col("shazamed_at")
    return records.where(at >= F.lit(moment) if inclusive else at > F.lit(moment))


def unseen(records: DataFrame, cuts: DataFrame) -> DataFrame:
    """Records without repeats of songs that a cut list covered.

    cuts[user_id, since, through, until]: the songs heard from ``since`` to ``through`` were listed;
    their repeats after ``through`` and up to ``until`` were already in the history then. Cuts are
    judged against all records, one anti join for all of them.
    """
    rows = with_song_keys(records).withColumn(
        "_keys",
        F.array_compact(
            F.array(
                F.concat(F.lit("i:"), F.col("isrc_key")),
                F.concat(F.lit("l:"), F.col("label_key")),
                F.concat(F.lit("c:"), F.col("credit_key")),
            )
        ),
    )
    spread = rows.select("user_id", "shazamed_at", F.explode("_keys").alias("key")).distinct()
    listed = (
        spread.join(cuts, "user_id")
        .where(
            (F.col("shazamed_at") <= F.col("through"))
            & (F.col("since").isNull() | (F.col("shazamed_at") >= F.col("since")))
        )
        .select("user_id", "key", "through", "until")
        .distinct()
    )
    repeats = (
        spread.join(listed, ["user_id", "key"])
        .where((F.col("shazamed_at") > F.col("through")) & (F.col("shazamed_at") <= F.col("until")))
        .select("user_id", "key", "shazamed_at")
        .distinct()
    )
    gone = (
        rows.select("user_id", "shazamed_at", "label_key", "credit_key", "isrc_key", F.explode("_keys").alias("key"))
        .distinct()
        .join(repeats, ["user_id", "key", "shazamed_at"], "left_semi")
        .select("user_id", "shazamed_at", "label_key")
        .distinct()
    )
    return rows.join(gone, ["user_id", "shazamed_at", "label_key"], "left_anti").select(*records.columns)


def history_chunks(
    songs: DataFrame,
    *,
    size: int = LIST_SIZE,
    newest: bool = False,
    id: str = "song_key",
    light_rows: int | None = LIGHT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Songs plus ``list_no`` and ``place``: lists of ``size`` per user, oldest (or newest) first."""
    seconds = F.unix_micros(F.col("shazamed_at").cast("timestamp"))
    rows = songs.withColumn("_at", F.coalesce(-seconds if newest else seconds, F.lit(2**62)))
    rows = scan(
        rows,
        ["user_id"],
        ["_at", id],
        F.floor(F.col("_at") / (86400 * 10**6)),
        [Scan("_n", "number")],
        light_rows=light_rows,
        hot=hot,
    )
    return rows.withColumns(
        {"list_no": F.floor((F.col("_n") - 1) / size), "place": (F.col("_n") - 1) % size}
    ).drop("_at", "_n")


def history_import(
    records: DataFrame, marks: DataFrame, *, size: int = LIST_SIZE
) -> tuple[DataFrame, DataFrame]:
    """(lists to check, new marks): what came after each user's mark, merged and cut into lists.

    marks[user_id, through, until]. A user without a mark starts from the beginning.
    """
    known = marks.select("user_id", "through", "until")
    fresh = records.join(known, "user_id", "left").where(
        F.col("through").isNull() | (F.col("shazamed_at") > F.col("through")) | F.col("shazamed_at").isNull()
    )
    cuts = known.where(F.col("until").isNotNull()).withColumn("since", F.lit(None).cast("timestamp"))
    kept = unseen(records, cuts)
    fresh = fresh.drop("through", "until").join(
        kept.select("user_id", "position"), ["user_id", "position"], "left_semi"
    )
    lists = history_chunks(history_merge(fresh), size=size)
    done = lists.where(F.col("list_no") == 0).groupBy("user_id").agg(F.max("shazamed_at").alias("_through"))
    until = records.groupBy("user_id").agg(F.max("shazamed_at").alias("_until"))
    after = (
        until.join(known, "user_id", "full")
        .join(done, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("_through", "through").alias("through"),
            F.coalesce("_until", "until").alias("until"),
        )
    )
    return lists, after


def newest_first(records: DataFrame) -> list:
    """Sort columns: by day newest first, later entries of a day first, undated ones last."""
    day = F.to_date("shazamed_at")
    undated = day.isNull()
    return [
        day.desc_nulls_last(),
        F.when(~undated, F.col("position")).desc_nulls_last(),
        F.when(undated, F.col("position")).asc_nulls_last(),
    ]


def day_range(first, last):
    """ "12 Sep – 12 Oct", one day, or with years when they differ."""
    same_year = F.year(first) == F.year(last)
    short = F.concat(F.day(first).cast("string"), F.date_format(first, " MMM"))
    long = F.concat(F.day(last).cast("string"), F.date_format(last, " MMM"))
    years = [F.concat(x, F.lit(" "), F.year(y).cast("string")) for x, y in ((short, first), (long, last))]
    start, end = (F.when(same_year, a).otherwise(b) for a, b in ((short, years[0]), (long, years[1])))
    return F.when(F.to_date(first) == F.to_date(last), start).otherwise(F.concat(start, F.lit(" – "), end))


def normalize_history(events: DataFrame, tracks: DataFrame, artists: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Event rows with their track, its artists (joined in name order) and place."""
    names = (
        artists.select("track_id", "name")
        .distinct()
        .groupBy("track_id")
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("artist"))
    )
    rows = events.join(tracks, "track_id", "left").join(names, "track_id", "left")
    return rows if places is None else rows.join(places, "place_id", "left")


def union_histories(sources: dict[str, DataFrame]) -> DataFrame:
    """The records of several histories with their ``source``; columns that one lacks are null there."""
    named = [rows.withColumn("source", F.lit(name)) for name, rows in sources.items()]
    if not named:
        raise ValueError("A union needs a history.")
    every = named[0]
    for rows in named[1:]:
        every = every.unionByName(rows, allowMissingColumns=True)
    return every


def source_songs(records: DataFrame, *, order: str = "position", every: str = "all") -> DataFrame:
    """(user_id, source, songs, plays) of a union: songs merged within each source alone, and over all of them."""
    spread = records.withColumn("_source", F.explode(F.array(F.col("source"), F.lit(every))))
    # One merge for all: a source of a user is linked like a user of its own.
    apart = spread.withColumns({"_user": F.col("user_id"), "user_id": F.concat_ws("\u001e", "_source", "user_id")})
    songs = with_songs(apart, order).groupBy("_user", "_source", "song").agg(F.count("*").alias("plays"))
    return songs.groupBy(F.col("_user").alias("user_id"), F.col("_source").alias("source")).agg(
        F.count("*").alias("songs"), F.sum("plays").alias("plays")
    )
