"""Recognition windows as runs, segments, coverage and listening plans.

Every scan over a set's time line goes through ``scan`` with hour chunks, so one very long or very
busy set is spread over tasks. Constants are parameters in seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import LIGHT_ROWS, Hot, Scan, hot_groups, scan

# Seconds and counts of the listening rules.
WINDOW = 12.0
STRIDE = 30.0
BRIDGE_PROBES = 2
BRIDGE_SECONDS = 240.0
FOLD_SECONDS = 300.0
OFFSET_SLACK = 10.0
STRONG = 3
GAP_SECONDS = 90.0

HOUR = 3600.0


def hours(at: str, size: float = HOUR) -> Column:
    return F.floor(F.col(at) / size)


def strength(hits: Column) -> Column:
    return F.when(hits >= STRONG, "strong").when(hits == 2, "medium").otherwise("weak")


def set_strides(probes: DataFrame, *, size: float = HOUR, light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None) -> DataFrame:
    """set_id -> first time and the median step between distinct times."""
    hot = hot or hot_groups(probes, ["set_id"], light_rows)
    times = probes.select("set_id", "at").distinct()
    steps = scan(
        times, ["set_id"], ["at"], hours("at", size), [Scan("before", "lag", F.col("at"))], hot=hot
    )
    return steps.groupBy("set_id").agg(
        F.min("at").alias("origin"), F.median(F.col("at") - F.col("before")).alias("step")
    )


def probe_windows(
    probes: DataFrame,
    *,
    stride: float | None = None,
    size: float = HOUR,
    light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None,
) -> DataFrame:
    """Probes plus ``slot``, ``on_grid`` and ``counts`` (whether one counts as a hearing).

    A probe between two windows belongs to the one before it and counts only where that window's own
    probe failed.
    """
    hot = hot or hot_groups(probes, ["set_id"], light_rows)
    if stride is None:
        plan = set_strides(probes, size=size, hot=hot).select(
            "set_id", "origin", F.coalesce("step", F.lit(STRIDE)).alias("stride")
        )
    else:
        plan = probes.groupBy("set_id").agg(F.min("at").alias("origin")).withColumn("stride", F.lit(float(stride)))
    rows = probes.join(plan, "set_id")
    rows = rows.withColumn("slot", F.floor((F.col("at") - F.col("origin")) / F.col("stride") + 1e-6))
    rows = rows.withColumn(
        "on_grid", F.abs(F.col("at") - F.col("origin") - F.col("slot") * F.col("stride")) < 0.5
    )
    regular = rows.groupBy("set_id", "slot").agg(
        F.bool_or(F.col("error").isNull() & F.col("on_grid")).alias("_regular"),
        F.bool_and(F.col("error").isNotNull()).alias("slot_failed"),
    )
    return rows.join(regular, ["set_id", "slot"]).select(
        *probes.columns,
        "slot",
        "on_grid",
        (F.col("on_grid") | ~F.col("_regular")).alias("counts"),
        "slot_failed",
        "stride",
    )


def heard_runs(
    probes: DataFrame,
    *,
    song: str = "song",
    bridge_seconds: float = BRIDGE_SECONDS,
    bridge_windows: int = BRIDGE_PROBES,
    stride: float | None = None,
    size: float = HOUR,
    light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None,
) -> DataFrame:
    """Answered probes with the number of the run they belong to, per set and song.

    The exact-key form: a song's next hearing continues its run when it comes within
    ``bridge_seconds`` and no more than ``bridge_windows`` windows that answered lie between them.
    Windows where every try failed do not count.
    """
    hot = hot or hot_groups(probes, ["set_id"], light_rows)
    windows = probe_windows(probes, stride=stride, size=size, hot=hot)
    slots = windows.groupBy("set_id", "slot").agg(
        F.min("at").alias("slot_at"), F.bool_and("slot_failed").alias("_failed")
    )
    slots = scan(
        slots,
        ["set_id"],
        ["slot_at"],
        hours("slot_at", size),
        [
            Scan("order", "number"),
            Scan("failed", "sum", F.when(F.col("_failed"), 1).otherwise(0)),
        ],
        hot=hot,
    ).select("set_id", "slot", "slot_at", "order", "failed")
    heard = windows.where(F.col("error").isNull() & F.col(song).isNotNull())
    heard = heard.join(slots, ["set_id", "slot"])
    keys = ["set_id", song]
    order = ["at", "probe_id"]
    heard = scan(
        heard,
        keys,
        order,
        hours("at", size),
        [
            Scan("_slot_at", "lag", F.col("slot_at")),
            Scan("_order", "lag", F.col("order")),
            Scan("_failed_before", "lag", F.col("failed")),
        ],
        hot=hot,
    )
    apart = F.col("slot_at") - F.col("_slot_at")
    missing = F.round(apart / F.col("stride")) - 1
    between = F.greatest(F.col("order") - F.col("_order") - 1, missing)
    between = between - (F.col("failed") - F.col("_failed_before"))
    joins = (apart <= bridge_seconds) & (between <= bridge_windows)
    heard = heard.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    runs = scan(
        heard, keys, order, hours("at", size), [Scan("run", "sum", F.col("_new"))], hot=hot
    )
    return runs.drop("_slot_at", "_order", "_failed_before", "_new")


def check_offsets(runs: DataFrame, *, song: str = "song", slack: float = OFFSET_SLACK) -> DataFrame:
    """Runs plus ``consistent``: does a window's song offset agree with the lower median start?"""
    keys = ["set_id", song, "run", "provider"]
    start = F.col("at") - F.col("song_offset")
    offsets = runs.where(F.col("song_offset").isNotNull())
    # Lower median: the largest start with at most half the group below it, found from counts.
    by_start = offsets.groupBy(*keys, start.alias("_start")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("at").alias("_at")
    )
    ranked = scan(
        by_start, keys, ["_start"], F.floor(F.col("_start") / HOUR), [Scan("_upto", "sum", F.col("_n"))]
    )
    total = by_start.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    middle = (
        ranked.join(total, keys)
        .where((F.col("_total") > 1) & (F.col("_upto") >= F.floor((F.col("_total") + 1) / 2)))
        .groupBy(*keys)
        .agg(F.min(F.struct("_start", "_at")).alias("_middle"))
    )
    rows = runs.join(middle, keys, "left")
    room = slack + F.abs(F.coalesce("skew", F.lit(0.0))) * F.abs(F.col("at") - F.col("_middle._at"))
    fits = F.abs(start - F.col("_middle._start")) <= room
    return rows.withColumn("consistent", F.coalesce(fits, F.lit(True))).drop("_middle")


def heard_segments(runs: DataFrame, *, song: str = "song", window: float = WINDOW) -> DataFrame:
    """One row per run: when it played, in how many windows, how surely."""
    rows = runs if "consistent" in runs.columns else runs.withColumn("consistent", F.lit(True))
    length = F.coalesce("window", F.lit(window)) if "window" in runs.columns else F.lit(window)
    segments = rows.groupBy("set_id", song, "run").agg(
        F.min("at").alias("start"),
        F.max(F.col("at") + length).alias("end"),
        F.count_distinct(F.when(F.col("consistent") & F.col("counts"), F.col("slot"))).alias("_in_line"),
        F.count_distinct(F.when(F.col("counts"), F.col("slot"))).alias("_any"),
        F.bool_or("consistent").alias("_some"),
        F.count_if(~F.col("consistent")).alias("_off"),
    )
    hits = F.greatest(F.when(F.col("_some"), F.col("_in_line")).otherwise(F.col("_any")), F.lit(1))
    return segments.withColumns(
        {"hits": hits, "inconsistent": F.when(F.col("_some"), F.col("_off")).otherwise(0)}
    ).withColumn("strength", strength(F.col("hits"))).drop("_in_line", "_any", "_some", "_off")


def fold_segments(
    segments: DataFrame,
    *,
    song: str = "song",
    fold: float = FOLD_SECONDS,
    size: float = HOUR,
    light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None,
) -> DataFrame:
    """Segments with ``play``: the same song within ``fold`` seconds is one play, unless another
    song heard in two or more windows started between."""
    hot = hot or hot_groups(segments, ["set_id"], light_rows)
    solid = F.when(F.col("strength") != "weak", 1).otherwise(0)
    order = ["start", song]
    rows = scan(
        segments, ["set_id"], order, hours("start", size), [Scan("_solid", "sum", solid)], hot=hot
    )
    keys = ["set_id", song]
    rows = scan(
        rows,
        keys,
        ["start"],
        hours("start", size),
        [
            Scan("_end", "max_before", F.col("end")),
            Scan("_solid_before", "lag", F.col("_solid")),
        ],
        hot=hot,
    )
    others = F.col("_solid") - solid - F.col("_solid_before")
    joins = (F.col("start") - F.col("_end") <= fold) & (others <= 0)
    rows = rows.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = scan(rows, keys, ["start"], hours("start", size), [Scan("play", "sum", F.col("_new"))], hot=hot)
    return rows.drop("_solid", "_end", "_solid_before", "_new")


def coverage_gaps(
    spans: DataFrame,
    durations: DataFrame | None = None,
    *,
    gap: float = GAP_SECONDS,
    size: float = HOUR,
    light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(seconds heard per set, gaps of ``gap`` seconds or more) of spans[set_id, start, end]."""
    hot = hot or hot_groups(spans, ["set_id"], light_rows)
    rows = spans.select("set_id", "start", "end").distinct()
    if durations is not None:
        rows = rows.join(durations, "set_id", "left")
        rows = rows.withColumn("end", F.least("end", F.coalesce("duration", "end"))).drop("duration").distinct()
    rows = scan(
        rows,
        ["set_id"],
        ["start", "end"],
        hours("start", size),
        [Scan("edge", "max_before", F.col("end"))],
        hot=hot,
    ).withColumn("edge", F.greatest(F.coalesce("edge", F.lit(0.0)), F.lit(0.0)))
    new = F.greatest(F.col("end") - F.greatest("start", "edge"), F.lit(0.0))
    heard = rows.groupBy("set_id").agg(F.round(F.sum(new), 1).alias("seconds_heard"), F.max("end").alias("_last"))
    gaps = rows.where(F.col("start") - F.col("edge") >= gap).select(
        "set_id", F.col("edge").alias("start"), F.col("start").alias("end")
    )
    if durations is not None:
        closing = (
            durations.join(heard, "set_id", "left")
            .withColumn("_last", F.greatest(F.coalesce("_last", F.lit(0.0)), F.lit(0.0)))
            .where(F.col("duration") - F.col("_last") >= gap)
            .select("set_id", F.col("_last").alias("start"), F.col("duration").alias("end"))
        )
        gaps = gaps.unionByName(closing)
    return heard.drop("_last"), gaps


def failed_windows(probes: DataFrame, *, share: float = 0.25) -> DataFrame:
    """Windows where every try failed, per set; above ``share`` the listen failed."""
    tries = probes.groupBy("set_id", F.round("at", 3).alias("_at")).agg(
        F.bool_and(F.col("error").isNotNull()).alias("_failed"),
        F.max_by("error", F.struct("at", "probe_id")).alias("_error"),
    )
    return tries.groupBy("set_id").agg(
        F.count_if("_failed").alias("failed"),
        F.count(F.lit(1)).alias("windows"),
        F.max_by(F.when(F.col("_failed"), F.col("_error")), F.when(F.col("_failed"), F.col("_at"))).alias("last_error"),
        (F.count_if("_failed") > share * F.count(F.lit(1))).alias("failing"),
    )


def source_report(probes: DataFrame, segments: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """Per set and source: windows, matches, errors and songs; entries of each listing."""
    tries = probes.groupBy("set_id", F.round("at", 3).alias("_at")).agg(
        F.bool_and(F.col("error").isNotNull()).alias("_failed"),
        F.count_if(F.col("error").isNull() & F.col("song").isNotNull()).alias("_matched"),
    )
    audio = tries.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum("_matched").alias("matched"),
        F.count_if("_failed").alias("errors"),
    )
    songs = segments.where(F.col("strength") != "weak").groupBy("set_id").agg(F.count(F.lit(1)).alias("songs"))
    audio = audio.join(songs, "set_id", "left").select(
        "set_id",
        F.lit("audio").alias("source"),
        "windows",
        "matched",
        "errors",
        F.coalesce("songs", F.lit(0)).alias("songs"),
    )
    if listings is None:
        return audio
    listed = listings.groupBy("set_id", "source").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("kind") == "named").alias("named"),
        F.count_if(F.col("kind") != "named").alias("unknown"),
    )
    return audio.unionByName(listed, allowMissingColumns=True)


def refine_points(
    probes: DataFrame,
    *,
    min_spacing: float = 10.0,
    share: float = 0.5,
    size: float = HOUR,
    light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None,
) -> DataFrame:
    """Midpoints between neighbours that disagree, spread over a set within its budget.

    The budget is ``share`` of the set's windows. Of n points, the k-th kept one is number
    ``(2k + 1) * n / (2 * budget)``.
    """
    hot = hot or hot_groups(probes, ["set_id"], light_rows)
    times = probes.where(F.col("error").isNull()).groupBy("set_id", "at").agg(F.max("song").alias("song"))
    rows = scan(
        times,
        ["set_id"],
        ["at"],
        hours("at", size),
        [Scan("_next", "lead", F.struct("at", "song"))],
        hot=hot,
    )
    differs = ~F.col("song").eqNullSafe(F.col("_next.song"))
    points = rows.where(
        F.col("_next").isNotNull() & differs & ((F.col("_next.at") - F.col("at")) / 2 >= min_spacing)
    ).select("set_id", ((F.col("at") + F.col("_next.at")) / 2).alias("at"))
    points = scan(points, ["set_id"], ["at"], hours("at", size), [Scan("_i", "number")], hot=hot)
    budget = times.groupBy("set_id").agg(F.floor(F.count(F.lit(1)) * share).alias("_budget"))
    totals = points.groupBy("set_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = points.join(totals, "set_id").join(budget, "set_id")
    # Number i (0-based) is kept when some k has (2k + 1) * n div (2 * budget) = i.
    i, n, b = F.col("_i") - 1, F.col("_n"), F.col("_budget")
    k = F.ceil((i * 2 * b / n - 1) / 2)
    k = F.greatest(k, F.lit(0))
    kept = (n <= b) | ((k < b) & (F.floor((2 * k + 1) * n / (2 * b)) == i))
    return rows.where((b > 0) & kept).select("set_id", "at")


def placements(durations: DataFrame, *, window: float = WINDOW, stride: float = STRIDE, offset: float = 9.0) -> DataFrame:
    """Window starts over each set: every ``stride`` seconds from ``offset`` while a window fits."""
    last = F.floor((F.col("duration") - window - offset) / stride)
    steps = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long")))
    return durations.select("set_id", F.explode(steps).alias("_k")).select(
        "set_id", (F.col("_k") * stride + offset).alias("at")
    )


def interpolate_times(
    entries: DataFrame, durations: DataFrame, *, light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None
) -> DataFrame:
    """Listed songs without a time, spread evenly between their neighbours.

    entries[set_id, position, time, edge, heard]: ``edge`` is where a song stops being heard. After a
    heard song, or at the start, the first one begins at the edge; otherwise all are set apart.
    """
    hot = hot or hot_groups(entries, ["set_id"], light_rows)
    timed = F.col("time").isNotNull()
    mark = F.struct("position", "time", "edge", "heard")
    rows = scan(
        entries,
        ["set_id"],
        ["position"],
        F.floor(F.col("position") / 10_000),
        [
            Scan("_left", "last_before", F.when(timed, mark)),
            Scan("_right", "first_after", F.when(timed, mark)),
        ],
        hot=hot,
    )
    ends = entries.groupBy("set_id").agg(F.max("position").alias("_count"), F.min("position").alias("_first"))
    rows = rows.join(ends, "set_id").join(durations, "set_id", "left")
    low = F.when(F.col("_left").isNull(), 0.0).otherwise(F.coalesce("_left.edge", "_left.time"))
    high = F.coalesce("_right.time", "duration")
    before = F.coalesce("_left.position", F.col("_first") - 1)
    after = F.coalesce("_right.position", F.col("_count") + 1)
    count = after - before - 1
    step = F.col("position") - before - 1
    flush = F.col("_left").isNull() | F.col("_left.heard")
    spread = F.when(high <= low, low).when(flush, low + step * (high - low) / count).otherwise(
        low + (step + 1) * (high - low) / (count + 1)
    )
    return rows.select(
        "set_id",
        "position",
        F.coalesce("time", F.bround(spread, 1)).alias("time"),
        (~timed).alias("approx"),
    )


def end_times(tracks: DataFrame, durations: DataFrame, *, size: float = HOUR, light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None) -> DataFrame:
    """Tracks plus ``end``: the next start, else the set's end."""
    hot = hot or hot_groups(tracks, ["set_id"], light_rows)
    rows = scan(
        tracks,
        ["set_id"],
        ["start", "position"],
        hours("start", size),
        [Scan("_next", "lead", F.col("start"))],
        hot=hot,
    ).join(durations, "set_id", "left")
    end = F.coalesce("_next", "duration")
    return rows.withColumn("end", F.when(end >= F.col("start"), end)).drop("_next", "duration")


def set_pace(tracks: DataFrame) -> DataFrame:
    """set_id -> how long its named songs play, in the middle (three at least)."""
    length = F.col("end") - F.col("start")
    named = tracks.where((F.col("kind") == "named") & (length > 0))
    return named.groupBy("set_id").agg(
        F.when(F.count(F.lit(1)) >= 3, F.median(length)).alias("pace")
    )


def heard_tally(tracks: DataFrame) -> DataFrame:
    """Tracks heard, from lists only, and IDs, per set. tracks[set_id, kind, heard]."""
    return tracks.groupBy("set_id").agg(
        F.count_if((F.col("kind") == "named") & F.col("heard")).alias("heard"),
        F.count_if((F.col("kind") == "named") & ~F.col("heard")).alias("listed_only"),
        F.count_if(F.col("kind") != "named").alias("ids"),
        F.count(F.lit(1)).alias("tracks"),
    )


def listen_reason(sets: DataFrame) -> DataFrame:
    """sets[set_id, songs, ids, complete, duration, identified, minutes_per_song] -> why to listen."""
    sparse = F.col("songs") * F.col("minutes_per_song") * 60 < F.col("duration")
    reason = (
        F.when(F.col("identified"), "identified_before")
        .when(F.coalesce("songs", F.lit(0)) + F.coalesce("ids", F.lit(0)) == 0, "no_tracklist")
        .when(~F.coalesce("complete", F.lit(True)), "incomplete")
        .when(F.col("ids") > 0, "ids")
        .when(sparse, "sparse")
    )
    return sets.withColumn("reason", reason)


def page_length(sets: DataFrame) -> DataFrame:
    """Preview (under half heard) or truncated (under 97 %), where the page says how long a set is."""
    ratio = F.col("duration") / F.col("page_duration")
    return sets.withColumns(
        {
            "preview": F.coalesce(ratio < 0.5, F.lit(False)),
            "truncated": F.coalesce((ratio >= 0.5) & (ratio < 0.97), F.lit(False)),
            "total": F.when(ratio < 0.97, F.col("page_duration")).otherwise(F.col("duration")),
        }
    )


def usable_listing(entries: DataFrame) -> DataFrame:
    """set_id -> whether its list is a guide: five named songs, at least half of them timed."""
    named = F.col("kind") == "named"
    return entries.groupBy("set_id").agg(
        (
            (F.count_if(named) >= 5)
            & (2 * F.count_if(F.col("seconds").isNotNull()) >= F.count(F.lit(1)))
        ).alias("usable")
    )
