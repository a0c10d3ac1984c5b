"""What was played in a set: heard songs, published lists and listener comments as one track list.

Every step is a join, an aggregate or a scan over (set, song) or (set, time bin), so neither a long set
nor a very busy one ends up in one task. Songs are compared by key: the bare title and any
credited name in common.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import with_forms
from ..session import cut_lineage, spread
from . import timeline as tl
from .hints import id_hints
from .scan import LIGHT_ROWS, Hot, Scan, hot_groups, scan

# Reach of an ID, song length, and how surely two labels name one song.
ID_REACH = 180.0
WEAK_REACH = 60.0
SONG_SECONDS = 180.0
UNIFY_SECONDS = 60.0
SAME = 0.8
JOIN = 0.6
SOURCE_ORDER = ["1001tracklists", "mixesdb", "file", "description", "chapters", "comments"]

TRACK = ["set_id", "start", "approx", "kind", "artist", "title", "version", "status", "heard", "hits", "strength", "sources", "candidates"]


def with_songs(rows: DataFrame) -> DataFrame:
    """Rows plus ``core`` (the bare title in matching form) and ``names`` (credited names)."""
    label = ["artist", "title", "version"]
    filled = rows.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in label})
    known = with_forms(spread(filled.select(*label).distinct())).select(
        *label, F.element_at(F.split("credit_base_key", r"\|"), -1).alias("core"), "names"
    )
    return filled.join(known, label, "left")


def likeness(mine: Column, theirs: Column) -> Column:
    """1 same credits, 0.9 shared credits, 0.6 the same title by others (titles already equal)."""
    return F.when(mine == theirs, 1.0).when(F.arrays_overlap(mine, theirs), 0.9).otherwise(JOIN)


def heard_plays(
    probes: DataFrame,
    *,
    stride: float | None = None,
    size: float = tl.HOUR,
    bridge: float = tl.BRIDGE_SECONDS,
    fold: float = tl.FOLD_SECONDS,
    window: float = tl.WINDOW,
    light_rows: int | None = LIGHT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """Songs heard in each set: set_id, play_id, start, end, hits, strength, label, core, names.

    probes[set_id, probe_id, at, artist, title, version, error, provider, song_offset, skew].
    """
    hot = hot or hot_groups(probes, ["set_id"], light_rows)
    known = cut_lineage(with_songs(probes))
    answered = F.col("error").isNull() & (F.col("title") != "")
    known = known.withColumn("song", F.when(answered, F.concat_ws("|", "core", F.array_join("names", ","))))
    runs = tl.heard_runs(known, stride=stride, bridge_seconds=bridge, size=size, hot=hot)
    runs = cut_lineage(tl.check_offsets(cut_lineage(runs)))
    segments = tl.fold_segments(tl.heard_segments(runs, window=window), fold=fold, size=size, hot=hot)
    plays = segments.groupBy("set_id", "song", "play").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("hits").alias("hits")
    )
    labels = (
        runs.groupBy("set_id", "song", "artist", "title", "version", "core", "names")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
        .groupBy("set_id", "song", "core", "names")
        .agg(F.max_by(F.struct("artist", "title", "version"), F.struct("n", -F.col("at"))).alias("label"))
    )
    return plays.join(labels, ["set_id", "song"]).select(
        "set_id",
        F.concat_ws("#", "song", F.col("play").cast("string")).alias("play_id"),
        "start",
        "end",
        "hits",
        tl.strength(F.col("hits")).alias("strength"),
        "label.*",
        "core",
        "names",
    )


def listed_tracks(listings: DataFrame, *, hot: Hot) -> DataFrame:
    """Entries of all listings of a set, one row per song and place: the first source names it, a
    listed time beats none. listings[set_id, source, position, kind, artist, title, version, seconds].
    """
    rank = F.coalesce(
        F.nullif(F.array_position(F.array(*(F.lit(s) for s in SOURCE_ORDER)), F.col("source")), F.lit(0)), F.lit(len(SOURCE_ORDER))
    )
    rows = with_songs(listings).withColumn("_rank", rank)
    # The n-th naming of a song in one listing is the n-th naming in another.
    rows = scan(
        rows,
        ["set_id", "source", "kind", "core"],
        ["position"],
        F.floor(F.col("position") / 10_000),
        [Scan("turn", "number")],
        hot=hot,
    )
    named = rows.where(F.col("kind") == "named")
    when = F.struct("_rank", "position")
    merged = named.groupBy("set_id", "core", "turn").agg(
        F.min_by(F.struct("artist", "title", "version", "names", "position"), when).alias("l"),
        F.min_by("seconds", F.when(F.col("seconds").isNotNull(), when)).alias("seconds"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    ).select(
        "set_id", F.lit("named").alias("kind"), "l.*", "core", "seconds", "sources",
        F.concat_ws("#", "core", F.col("turn").cast("string")).alias("entry_id"),
    )
    ids = rows.where(F.col("kind") != "named")
    first = F.min_by(F.struct("_rank", "source"), F.struct("_rank", "source"))
    lead = rows.groupBy("set_id").agg(first.alias("_lead"))
    # An ID counts from the best listing; other listings' IDs stand for the same gaps.
    unknown = ids.join(lead, "set_id").where(F.col("source") == F.col("_lead.source")).select(
        "set_id", F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("artist"),
        F.lit(None).cast("string").alias("title"), F.lit("").alias("version"),
        F.array().cast("array<string>").alias("names"), "position", F.lit("").alias("core"), "seconds",
        F.array("source").alias("sources"), F.concat(F.lit("id#"), F.col("position").cast("string")).alias("entry_id"),
    )
    return merged.unionByName(unknown)


def match_heard(entries: DataFrame, plays: DataFrame, *, hot: Hot) -> DataFrame:
    """set_id, entry_id, play_id, likeness: entries and plays that are each other's best.

    A sure match may be out of order; the same title by other artists must lie between the sure matches
    before and after it.
    """
    pairs = entries.where(F.col("kind") == "named").select(
        "set_id", "core", "entry_id", "position", "seconds", F.col("names").alias("_names")
    ).join(plays.select("set_id", "core", "play_id", "start", "hits", "names"), ["set_id", "core"])
    score = F.struct(
        likeness(F.col("_names"), F.col("names")).alias("likeness"),
        (F.least("hits", F.lit(10)) - F.coalesce(F.least(F.abs(F.col("start") - F.col("seconds")), F.lit(600.0)) / 60, F.lit(0.0))).alias("tie"),
        (-F.col("start")).alias("early"),
    )
    pairs = pairs.withColumn("_score", score)
    best_entry = pairs.groupBy("set_id", "entry_id").agg(F.max_by("play_id", F.struct("_score", "play_id")).alias("play_id"))
    best_play = pairs.groupBy("set_id", "play_id").agg(
        F.max_by("entry_id", F.struct(F.col("_score.likeness"), F.col("_score.tie"), -F.col("position"))).alias("entry_id")
    )
    both = pairs.join(best_entry, ["set_id", "entry_id", "play_id"], "left_semi").join(
        best_play, ["set_id", "entry_id", "play_id"], "left_semi"
    )
    sure = F.when(F.col("_score.likeness") >= SAME, F.col("start"))
    placed = scan(
        both,
        ["set_id"],
        ["position", "entry_id"],
        F.floor(F.col("position") / 10_000),
        [Scan("_low", "last_before", sure), Scan("_high", "first_after", sure)],
        hot=hot,
    )
    between = (F.col("start") >= F.coalesce("_low", "start")) & (F.col("start") <= F.coalesce("_high", "start"))
    return placed.where((F.col("_score.likeness") >= SAME) | between).select(
        "set_id", "entry_id", "play_id", F.col("_score.likeness").alias("likeness")
    )


def _closest_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """left[set_id, id, at] and right[set_id, other, at] within reach that are each other's nearest.

    Both meet in time bins of ``reach``; a row is sent to three bins at most.
    """
    bin = F.floor(F.col("at") / reach).cast("long")
    a = left.withColumn("_bin", F.explode(F.sequence(bin - 1, bin + 1)))
    b = right.select("set_id", "other", F.col("at").alias("_at"), F.floor(F.col("at") / reach).cast("long").alias("_bin"))
    pairs = a.join(b, ["set_id", "_bin"]).where(F.abs(F.col("at") - F.col("_at")) <= reach)
    pairs = pairs.withColumn("_gap", F.abs(F.col("at") - F.col("_at")))
    mine = pairs.groupBy("set_id", "id").agg(F.min_by("other", F.struct("_gap", "_at", "other")).alias("other"))
    theirs = pairs.groupBy("set_id", "other").agg(F.min_by("id", F.struct("_gap", "at", "id")).alias("id"))
    return mine.join(theirs, ["set_id", "id", "other"])


def identify_sets(
    probes: DataFrame,
    listings: DataFrame | None = None,
    durations: DataFrame | None = None,
    hints: DataFrame | None = None,
    *,
    stride: float | None = None,
    size: float = tl.HOUR,
    bridge: float = tl.BRIDGE_SECONDS,
    fold: float = tl.FOLD_SECONDS,
    window: float = tl.WINDOW,
    gap: float = tl.GAP_SECONDS,
    song_seconds: float = SONG_SECONDS,
    id_reach: float = ID_REACH,
    light_rows: int | None = LIGHT_ROWS,
) -> dict[str, DataFrame]:
    """tracks, coverage, gaps, sources and unplaced songs of every set.

    hints[set_id, at, artist, title, mentions]: songs listeners named, offered for IDs.
    """
    hot = hot_groups(probes, ["set_id"], light_rows)
    # What later steps read several times is written once.
    plays = cut_lineage(
        heard_plays(probes, stride=stride, size=size, bridge=bridge, fold=fold, window=window, hot=hot)
    )
    if durations is None:
        durations = probes.groupBy("set_id").agg((F.max("at") + window).alias("duration"))
    heard = F.struct("artist", "title", "version", F.col("start").alias("at"), "hits", "strength")
    if listings is None:
        named = plays.where(F.col("strength") != "weak").select(
            "set_id", "play_id", "start", "end", F.lit(False).alias("approx"), F.lit("named").alias("kind"),
            "artist", "title", "version", "hits", "strength", F.array(F.lit("audio")).alias("sources"),
            F.when(F.col("strength") == "strong", "confirmed").otherwise("likely").alias("status"), F.lit(True).alias("heard"),
        )
        tracks = cut_lineage(_open_ids(named, durations, song_seconds, size, hot))
        weak = plays.where(F.col("strength") == "weak").select("set_id", "play_id", "start", heard.alias("c"))
        tracks, unplaced = _offer(tracks, weak, WEAK_REACH)
    else:
        lists_hot = hot_groups(listings, ["set_id"], light_rows)
        entries = cut_lineage(listed_tracks(listings, hot=lists_hot))
        matched = cut_lineage(match_heard(entries, plays, hot=lists_hot))
        heard_rows = plays.select(
            "set_id", "play_id", "start", "end", "hits", "strength", F.struct("artist", "title", "version").alias("_heard")
        )
        rows = entries.join(matched, ["set_id", "entry_id"], "left").join(heard_rows, ["set_id", "play_id"], "left")
        early = (F.col("seconds") <= F.col("start")) & (F.col("start") - F.col("seconds") <= tl.STRIDE + tl.WINDOW)
        time = F.when(F.col("start").isNotNull(), F.when(early, F.col("seconds")).otherwise(F.col("start"))).otherwise(F.col("seconds"))
        rows = rows.withColumn("time", time)
        numbered = cut_lineage(
            scan(rows, ["set_id"], ["position", "entry_id"], F.floor(F.col("position") / 10_000), [Scan("place", "number")], hot=lists_hot)
        )
        spaced = tl.interpolate_times(
            numbered.select(
                "set_id", F.col("place").alias("position"), "time",
                F.coalesce("end", "time").alias("edge"), F.col("play_id").isNotNull().alias("heard"),
            ),
            durations,
            hot=lists_hot,
        ).select("set_id", F.col("position").alias("place"), F.col("time").alias("_time"), "approx")
        placed = cut_lineage(numbered.join(spaced, ["set_id", "place"]))
        free = plays.join(matched.select("set_id", "play_id"), ["set_id", "play_id"], "left_anti")
        solid = free.where(F.col("strength") != "weak")
        # An ID takes the nearest song nobody listed; a strong one beside an unheard listed song is a conflict.
        ids = placed.where(F.col("kind") == "unknown").select("set_id", F.col("entry_id").alias("id"), F.col("_time").alias("at"))
        fills = _closest_pairs(ids, solid.select("set_id", F.col("play_id").alias("other"), F.col("start").alias("at")), id_reach)
        left = solid.join(fills.select("set_id", F.col("other").alias("play_id")), ["set_id", "play_id"], "left_anti")
        unheard = placed.where((F.col("kind") == "named") & F.col("play_id").isNull()).select(
            "set_id", F.col("entry_id").alias("id"), F.col("_time").alias("at")
        )
        rivals = _closest_pairs(
            unheard, left.where(F.col("strength") == "strong").select("set_id", F.col("play_id").alias("other"), F.col("start").alias("at")), id_reach
        )
        fills, rivals = cut_lineage(fills), cut_lineage(rivals)
        links = fills.withColumn("_how", F.lit("fills")).unionByName(rivals.withColumn("_how", F.lit("rival")))
        linked = links.join(
            plays.select("set_id", F.col("play_id").alias("other"), heard.alias("_c")), ["set_id", "other"]
        ).select("set_id", F.col("id").alias("entry_id"), "_how", "_c")
        placed = placed.join(linked, ["set_id", "entry_id"], "left")
        status = (
            F.when(F.col("kind") == "unknown", F.when(F.col("_c").isNotNull(), "likely").otherwise("unidentified"))
            .when(F.col("_how") == "rival", "conflict")
            .when(F.col("play_id").isNotNull(), F.when(F.col("likeness") >= SAME, "confirmed").otherwise("likely"))
            .when(F.col("sources") == F.array(F.lit("comments")), "weak")
            .otherwise("likely")
        )
        none = F.array().cast("array<struct<artist:string,title:string,version:string,at:double,hits:bigint,strength:string>>")
        cand = F.when(F.col("_c").isNotNull(), F.array("_c")).otherwise(none)
        listed = placed.select(
            "set_id", "entry_id", F.col("_time").alias("start"), "approx", "kind", "artist", "title",
            F.when((F.col("version") == "") & F.col("play_id").isNotNull(), F.coalesce("_heard.version", "version")).otherwise(F.col("version")).alias("version"),
            status.alias("status"), F.col("play_id").isNotNull().alias("heard"), "hits", "strength",
            F.when(F.col("play_id").isNotNull(), F.concat(F.array(F.lit("audio")), "sources")).otherwise(F.col("sources")).alias("sources"),
            F.col("end"), cand.alias("candidates"),
        )
        conflicts = rivals.select("set_id", F.col("other").alias("play_id"), F.lit(True).alias("_rival"))
        own = left.join(conflicts, ["set_id", "play_id"], "left").select(
            "set_id", F.concat(F.lit("heard#"), "play_id").alias("entry_id"), "start", F.lit(False).alias("approx"),
            F.lit("named").alias("kind"), "artist", "title", "version",
            F.when(F.col("_rival"), "conflict").when(F.col("strength") == "strong", "confirmed").otherwise("likely").alias("status"),
            F.lit(True).alias("heard"), "hits", "strength", F.array(F.lit("audio")).alias("sources"), "end", none.alias("candidates"),
        )
        tracks = cut_lineage(listed.unionByName(own))
        weak = free.where(F.col("strength") == "weak").select("set_id", "play_id", "start", heard.alias("c"))
        tracks, unplaced = _offer(tracks, weak, WEAK_REACH)
    if hints is not None:
        tracks = _hint(tracks, hints, size, hot)
    tracks = cut_lineage(tracks)
    ends = tl.end_times(
        scan(
            tracks.where(F.col("start").isNotNull()), ["set_id"], ["start", "entry_id"], tl.hours("start", size), [Scan("position", "number")], hot=hot
        ).drop("end"),
        durations,
        size=size,
        hot=hot,
    )
    coverage, gaps = tl.coverage_gaps(
        plays.where(F.col("strength") != "weak").select("set_id", "start", "end"), durations, gap=gap, size=size, hot=hot
    )
    named_seconds = ends.groupBy("set_id").agg(
        F.sum(F.when(F.col("kind") == "named", F.col("end") - F.col("start"))).alias("seconds_identified")
    )
    coverage = durations.join(coverage, "set_id", "left").join(named_seconds, "set_id", "left").join(tl.heard_tally(ends), "set_id", "left")
    known = with_songs(probes).withColumn("song", F.when(F.col("error").isNull() & (F.col("title") != ""), F.col("core")))
    return {
        "tracks": ends,
        "coverage": coverage,
        "gaps": gaps,
        "sources": tl.source_report(known, plays, listings),
        "unplaced": unplaced,
    }


def _open_ids(named: DataFrame, durations: DataFrame, song_seconds: float, size: float, hot: Hot) -> DataFrame:
    """Named tracks plus an ID wherever nothing was heard for a song's length."""
    edges = scan(
        named.select("set_id", "start", "end", "play_id"),
        ["set_id"],
        ["start", "play_id"],
        tl.hours("start", size),
        [Scan("edge", "max_before", F.col("end"))],
        hot=hot,
    )
    inner = edges.where(F.col("start") - F.coalesce("edge", F.lit(0.0)) >= song_seconds).select(
        "set_id", F.coalesce("edge", F.lit(0.0)).alias("at")
    )
    last = durations.join(named.groupBy("set_id").agg(F.max("end").alias("edge")), "set_id", "left")
    closing = last.where(F.col("duration") - F.coalesce("edge", F.lit(0.0)) >= song_seconds).select(
        "set_id", F.coalesce("edge", F.lit(0.0)).alias("at")
    )
    none = F.array().cast("array<struct<artist:string,title:string,version:string,at:double,hits:bigint,strength:string>>")
    ids = inner.unionByName(closing).select(
        "set_id", F.concat(F.lit("id#"), F.col("at").cast("string")).alias("entry_id"), F.col("at").alias("start"),
        F.lit(False).alias("approx"), F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("artist"),
        F.lit(None).cast("string").alias("title"), F.lit("").alias("version"), F.lit("unidentified").alias("status"),
        F.lit(False).alias("heard"), F.lit(None).cast("bigint").alias("hits"), F.lit(None).cast("string").alias("strength"),
        F.array().cast("array<string>").alias("sources"), F.lit(None).cast("double").alias("end"), none.alias("candidates"),
    )
    return named.withColumnRenamed("play_id", "entry_id").withColumn("candidates", none).select(*ids.columns).unionByName(ids)


def _offer(tracks: DataFrame, weak: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Songs heard once go to the nearest ID within ``reach`` as candidates, or stay unplaced."""
    ids = tracks.where((F.col("kind") == "unknown") & F.col("start").isNotNull())
    bin = F.floor(F.col("start") / reach).cast("long")
    a = weak.withColumn("_bin", F.explode(F.sequence(bin - 1, bin + 1)))
    b = ids.select("set_id", "entry_id", F.col("start").alias("_at"), bin.alias("_bin"))
    pairs = a.join(b, ["set_id", "_bin"]).where(F.abs(F.col("start") - F.col("_at")) <= reach)
    owner = pairs.groupBy("set_id", "play_id").agg(
        F.min_by(F.struct("entry_id", "c"), F.struct(F.abs(F.col("start") - F.col("_at")), "entry_id")).alias("o")
    )
    unplaced = weak.join(owner.select("set_id", "play_id"), ["set_id", "play_id"], "left_anti").select("set_id", "play_id", "c.*")
    # What can lie within reach of one moment is bounded by the windows that fit there.
    given = owner.groupBy("set_id", F.col("o.entry_id").alias("entry_id")).agg(F.array_sort(F.collect_list("o.c")).alias("_more"))
    rows = tracks.join(given, ["set_id", "entry_id"], "left")
    return (
        rows.withColumns(
            {
                "candidates": F.when(F.col("_more").isNotNull(), F.concat("candidates", "_more")).otherwise(F.col("candidates")),
                "status": F.when((F.col("status") == "unidentified") & F.col("_more").isNotNull(), "weak").otherwise(F.col("status")),
            }
        ).drop("_more"),
        unplaced,
    )


def _hint(tracks: DataFrame, hints: DataFrame, size: float, hot: Hot | None) -> DataFrame:
    """The best song listeners named near an ID, unless the tracklist has it or it names the set's own neighbour there."""
    titled = F.when(F.col("kind") == "named", F.lower("title"))
    placed = tracks.where(F.col("start").isNotNull()).select("set_id", "entry_id", "kind", "start", titled.alias("_title"))
    rows = cut_lineage(
        scan(
            placed, ["set_id"], ["start", "entry_id"], tl.hours("start", size),
            [Scan("previous", "lag", F.col("_title")), Scan("_before", "lag", F.col("entry_id"))], hot=hot,
        )
    )
    after = rows.where(F.col("_before").isNotNull()).select(
        "set_id", F.col("_before").alias("entry_id"), F.col("_title").alias("following"), F.col("start").alias("end")
    )
    ids = rows.where(F.col("kind") == "unknown").select("set_id", "entry_id", F.col("start").alias("at"), "previous")
    said = hints.select(
        "set_id", F.col("at").alias("seconds"), F.lower(F.coalesce("artist", F.lit(""))).alias("artist"),
        F.lower(F.coalesce("title", F.lit(""))).alias("title"), "mentions",
        F.lit(0).alias("likes"), F.struct("artist", "title").alias("_given"),
    )
    spelled = said.groupBy("set_id", "artist", "title").agg(F.min("_given").alias("_given"))
    named = tracks.select("set_id", titled.alias("title")).where(F.col("title").isNotNull())
    found = id_hints(ids.join(after, ["set_id", "entry_id"], "left"), said.drop("_given"), named)
    best = found.join(spelled, ["set_id", "artist", "title"]).groupBy("set_id", "entry_id").agg(
        F.max_by("_given", F.struct("mentions", "_given")).alias("hint")
    )
    return tracks.join(best, ["set_id", "entry_id"], "left")
