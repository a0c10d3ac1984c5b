"""Slots of a set brought to rest: turned listings, repeated plays, twins, IDs that another listing names, claims and rivals.

A set is a sequence of slots. ``slots`` holds one row each: set_id, slot (its number in the sequence), kind (named or
unknown), time, edge (where it stops being heard, else its time), approx, heard, listed. ``texts`` holds what listings say
of a slot (set_id, slot, source, seconds), ``songs`` every label it goes by (set_id, slot, artist, title, version). Every
step joins on a song, a neighbour or a time bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scan import LIGHT_ROWS, Hot, Scan, hot_groups, scan
from .songs import INSIDE, SAME_TITLE, same_songs

# Seconds within which songs, windows and IDs belong together.
ID_REACH, WEAK_REACH, FOLD_SECONDS, SONG_SECONDS, GAP_SECONDS, UNIFY_SECONDS = 180.0, 60.0, 300.0, 180.0, 90.0, 60.0
# Fixed value: lines heard only the other way round that turn a whole listing.
TITLE_FIRST = 3

#: Slots of a set that are scanned together once a set is too large for one task.
SLOTS = 10_000


def _part() -> Column:
    return F.floor(F.col("slot") / SLOTS)


def greedy_pairs(pairs: DataFrame, one: str, other: str, key: list[str], on: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """The pairs that are kept when they are taken in the order of ``key`` and either end serves once.

    In each round a pair that comes first at both of its ends is kept, which is just what the order would do, and every
    pair that shares an end with it goes. The rounds end when no pair is left; most sets need two or three.
    """
    order = F.struct(*dict.fromkeys([*key, one, other]))
    left, kept = cut_lineage(pairs), None
    while not left.isEmpty():
        mine = left.groupBy(*on, one).agg(F.min(order).alias("_k")).select(*on, one, F.col(f"_k.{other}").alias(other))
        theirs = left.groupBy(*on, other).agg(F.min(order).alias("_k")).select(*on, F.col(f"_k.{one}").alias(one), other)
        firsts = cut_lineage(mine.join(theirs, [*on, one, other]).join(left, [*on, one, other]).select(*pairs.columns))
        kept = firsts if kept is None else kept.unionByName(firsts)
        left = left.join(firsts.select(*on, one), [*on, one], "left_anti").join(firsts.select(*on, other), [*on, other], "left_anti")
        left = cut_lineage(left.select(*pairs.columns))
    return left if kept is None else kept


def turned_listings(entries: DataFrame, songs: DataFrame, *, forms: DataFrame | None = None) -> DataFrame:
    """``entries`` with lines that were heard only the other way round read that way; ``turned`` tells which.

    entries[set_id, source, position, kind, artist, title, version]; songs [set_id, slot, artist, title, version] of what was heard.
    A listing with ``TITLE_FIRST`` such lines and none heard as written is title first throughout.
    """
    keyed = entries.withColumn("id", F.struct("source", "position"))
    named = keyed.where(F.col("kind") == "named")
    label = ["id", "set_id", "artist", "title", "version"]
    heard = songs.select(F.col("slot").alias("id"), "set_id", "artist", "title", "version")
    straight = named.select(*label).withColumn("way", F.lit("straight"))
    other = named.select("id", "set_id", F.col("title").alias("artist"), F.col("artist").alias("title"), "version").withColumn("way", F.lit("turned"))
    both = straight.unionByName(other).withColumn("id", F.struct("id", "way")).drop("way")
    met = same_songs(both, heard, ["set_id"], INSIDE, forms).select("set_id", F.col("left_id.id").alias("id"), F.col("left_id.way").alias("way")).distinct()
    ways = cut_lineage(
        met.groupBy("set_id", "id").agg(F.bool_or(F.col("way") == "straight").alias("_straight"), F.bool_or(F.col("way") == "turned").alias("_turned"))
    )
    lists = ways.groupBy("set_id", F.col("id.source").alias("source")).agg(
        F.count_if(F.col("_straight")).alias("_n_straight"), F.count_if(~F.col("_straight") & F.col("_turned")).alias("_n_turned")
    )
    rows = keyed.join(ways, ["set_id", "id"], "left").join(lists, ["set_id", "source"], "left")
    whole = (F.col("_n_turned") >= TITLE_FIRST) & (F.col("_n_straight") == 0)
    turned = (F.col("kind") == "named") & F.coalesce((~F.col("_straight") & F.col("_turned")) | whole, F.lit(False))
    rows = rows.withColumn("turned", turned)
    swapped = {"artist": F.when(F.col("turned"), F.col("title")).otherwise(F.col("artist")), "title": F.when(F.col("turned"), F.col("artist")).otherwise(F.col("title"))}
    return rows.withColumns(swapped).select(*entries.columns, "turned")


def rejoined(slots: DataFrame, songs: DataFrame, *, fold: float = FOLD_SECONDS, forms: DataFrame | None = None) -> DataFrame:
    """set_id, slot, owner: heard slots no listing names that are one play with a listed and heard slot nearby.

    slots also holds start and end of what was heard. A song heard again within ``fold`` seconds before or after, even
    past another song, is more evidence for the nearest such slot, the earlier where two are as near.
    """
    heard = slots.where("heard").select("set_id", "slot", "start", "end", "listed")
    spare, anchors = heard.where("not listed"), heard.where("listed")
    far = F.greatest(F.col("start") - F.col("_end"), F.col("_start") - F.col("end"), F.lit(0.0))
    label = ["artist", "title", "version"]
    mine = songs.join(spare, ["set_id", "slot"], "left_semi").select("set_id", F.col("slot").alias("id"), *label)
    theirs = songs.join(anchors, ["set_id", "slot"], "left_semi").select("set_id", F.col("slot").alias("id"), *label)
    alike = same_songs(mine, theirs, ["set_id"], INSIDE, forms).select("set_id", F.col("left_id").alias("slot"), F.col("right_id").alias("owner")).distinct()
    met = alike.join(spare, ["set_id", "slot"]).join(
        anchors.select("set_id", F.col("slot").alias("owner"), F.col("start").alias("_start"), F.col("end").alias("_end")), ["set_id", "owner"]
    )
    near = met.withColumn("_far", far).where(F.col("_far") <= fold)
    return near.groupBy("set_id", "slot").agg(F.min_by("owner", F.struct("_far", "owner")).alias("owner"))


def listed_neighbours(slots: DataFrame, texts: DataFrame, *, hot: Hot | None = None) -> DataFrame:
    """set_id, slot, sources, before, after: the nearest slots that a listing of this one names on either side."""
    rows = texts.select("set_id", "source", "slot").distinct()
    rows = scan(
        rows, ["set_id", "source"], ["slot"], _part(),
        [Scan("_before", "lag", F.col("slot")), Scan("_after", "lead", F.col("slot"))], hot=hot,
    )
    # A slot has at most one text of each listing.
    return rows.groupBy("set_id", "slot").agg(
        F.array_sort(F.collect_set("source")).alias("sources"), F.max("_before").alias("before"), F.min("_after").alias("after")
    )


def twins(
    slots: DataFrame, texts: DataFrame, songs: DataFrame, *, unify: float = UNIFY_SECONDS, light_rows: int | None = LIGHT_ROWS,
    forms: DataFrame | None = None,
) -> DataFrame:
    """set_id, slot, keep: unheard slots that are the same song as another unheard slot ``keep``, placed apart by two listings.

    They name one song, no listing names both, and they stand within ``unify`` seconds where both have a listed time; else one of
    them must be able to move to the other without passing a song that its own listing names. Pairs are taken in
    the order of the later slot, then of the earlier; a slot serves in one pair. Call it again after joining
    until nothing is found: three listings make two pairs.
    """
    hot = hot_groups(slots, ["set_id"], light_rows)
    unheard = slots.where((F.col("kind") == "named") & F.col("listed") & ~F.col("heard")).select("set_id", "slot", "time", "approx")
    beside = listed_neighbours(slots, texts, hot=hot)
    known = cut_lineage(unheard.join(beside, ["set_id", "slot"]))
    own = songs.join(unheard, ["set_id", "slot"], "left_semi").select("set_id", F.col("slot").alias("id"), "artist", "title", "version")
    alike = same_songs(own, own, ["set_id"], INSIDE, forms).where("left_id < right_id")
    first = known.select("set_id", *(F.col(c).alias(f"a_{c}") for c in known.columns if c != "set_id"))
    second = known.select("set_id", *(F.col(c).alias(f"b_{c}") for c in known.columns if c != "set_id"))
    met = alike.select("set_id", F.col("left_id").alias("a_slot"), F.col("right_id").alias("b_slot")).distinct()
    met = met.join(first, ["set_id", "a_slot"]).join(second, ["set_id", "b_slot"]).where(~F.arrays_overlap("a_sources", "b_sources"))
    timed = ~F.col("a_approx") & ~F.col("b_approx") & F.col("a_time").isNotNull() & F.col("b_time").isNotNull()
    # The second listing names nothing between them, or the first names nothing.
    back = F.coalesce(F.col("b_before") <= F.col("a_slot"), F.lit(True))
    forth = F.coalesce(F.col("a_after") >= F.col("b_slot"), F.lit(True))
    keep = F.when(timed, F.when(F.abs(F.col("a_time") - F.col("b_time")) <= unify, F.col("a_slot")))
    keep = keep.when(back, F.col("a_slot")).when(forth, F.col("b_slot"))
    pairs = met.withColumn("keep", keep).where("keep is not null").select("set_id", "a_slot", "b_slot", "keep")
    # One end at a time: a slot may be the later one of one pair and the earlier one of another.
    ends = F.explode(F.array(F.struct(F.col("a_slot").alias("end")), F.struct(F.col("b_slot").alias("end"))))
    kept = None
    left = cut_lineage(pairs)
    while not left.isEmpty():
        order = F.struct("b_slot", "a_slot")
        best = left.select("set_id", ends.alias("e"), "a_slot", "b_slot").groupBy("set_id", "e.end").agg(F.min(order).alias("k"))
        firsts = best.groupBy("set_id", "k").count().where("count = 2").select("set_id", "k.a_slot", "k.b_slot")
        firsts = cut_lineage(left.join(firsts, ["set_id", "a_slot", "b_slot"]))
        kept = firsts if kept is None else kept.unionByName(firsts)
        used = firsts.select("set_id", F.explode(F.array("a_slot", "b_slot")).alias("end"))
        left = left.join(used.withColumnRenamed("end", "a_slot"), ["set_id", "a_slot"], "left_anti")
        left = cut_lineage(left.join(used.withColumnRenamed("end", "b_slot"), ["set_id", "b_slot"], "left_anti"))
    found = left if kept is None else kept
    gone = F.when(F.col("keep") == F.col("a_slot"), F.col("b_slot")).otherwise(F.col("a_slot"))
    return found.select("set_id", gone.alias("slot"), "keep")


def filled_ids(slots: DataFrame, texts: DataFrame, *, reach: float = ID_REACH, light_rows: int | None = LIGHT_ROWS) -> DataFrame:
    """set_id, slot, song: IDs of one listing where another listing names just one song.

    An ID is bounded by the nearest slots on both sides that its own listings name. Between them must stand one song that
    those listings do not name and that lies within ``reach``, unless either has no sure time. Of several IDs of one
    listing that would take one song the first does.
    """
    hot = hot_groups(slots, ["set_id"], light_rows)
    beside = cut_lineage(listed_neighbours(slots, texts, hot=hot))
    sizes = slots.groupBy("set_id").agg(F.max("slot").alias("_n"))
    ids = slots.where((F.col("kind") == "unknown") & F.col("listed")).join(beside, ["set_id", "slot"]).join(sizes, "set_id")
    wide = 32
    low, high = F.coalesce("before", F.lit(0)), F.coalesce("after", F.col("_n") + 1)
    ids = ids.select(
        "set_id", F.col("slot").alias("id"), F.col("time").alias("_time"), F.col("approx").alias("_approx"), F.col("sources").alias("_sources"),
        low.alias("_low"), high.alias("_high"), F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide))).alias("_bin"),
    )
    named = slots.where((F.col("kind") == "named") & F.col("listed")).join(beside.select("set_id", "slot", "sources"), ["set_id", "slot"])
    named = named.select("set_id", F.col("slot").alias("song"), "time", "approx", "sources", F.floor(F.col("slot") / wide).alias("_bin"))
    inside = (F.col("song") > F.col("_low")) & (F.col("song") < F.col("_high"))
    near = F.col("_approx") | F.col("approx") | F.coalesce(F.abs(F.col("time") - F.col("_time")) <= reach, F.lit(True))
    met = ids.join(named, ["set_id", "_bin"]).where(inside & near & ~F.arrays_overlap("sources", "_sources"))
    lone = met.groupBy("set_id", "id").agg(F.count("*").alias("n"), F.min("song").alias("song"), F.first("_sources").alias("_sources")).where("n = 1")
    # An ID that takes a song makes it one of its listing: the next ID of that listing finds it named.
    each = lone.select("set_id", "song", F.explode("_sources").alias("source"), "id")
    first = each.groupBy("set_id", "song", "source").agg(F.min("id").alias("id"))
    clear = each.join(first, ["set_id", "song", "source", "id"], "left_anti").select("set_id", "id").distinct()
    return lone.join(clear, ["set_id", "id"], "left_anti").select("set_id", F.col("id").alias("slot"), "song")


def echoes(slots: DataFrame, songs: DataFrame, *, size: float = 3600.0, light_rows: int | None = LIGHT_ROWS, forms: DataFrame | None = None) -> DataFrame:
    """set_id, slot: songs heard once that only name, in some version, the track just before or after them.

    slots also holds weak (heard once and not listed). Neighbours are the nearest slots in time that are no weak ones and go by a label.
    """
    labelled = songs.select("set_id", "slot").distinct().withColumn("_song", F.lit(True))
    timed = slots.where("time is not null").join(labelled, ["set_id", "slot"])
    hot = hot_groups(timed, ["set_id"], light_rows)
    # Among equal times a track stands before the window it may explain, as "until and with" has it.
    placed = timed.withColumn("_turn", F.col("weak").cast("int"))
    track = F.when(~F.col("weak"), F.col("slot"))
    placed = scan(
        placed.select("set_id", "slot", "time", "_turn", "weak"), ["set_id"], ["time", "_turn", "slot"], F.floor(F.col("time") / size),
        [Scan("_before", "last_before", track), Scan("_after", "first_after", track)], hot=hot,
    )
    weak = placed.where("weak").select("set_id", "slot", F.explode(F.array_compact(F.array("_before", "_after"))).alias("track"))
    weak = cut_lineage(weak)
    label = ["artist", "title", "version"]
    mine = songs.join(weak, ["set_id", "slot"], "left_semi").select("set_id", F.col("slot").alias("id"), *label)
    near = weak.select("set_id", F.col("track").alias("slot"))
    theirs = songs.join(near, ["set_id", "slot"], "left_semi").select("set_id", F.col("slot").alias("id"), *label)
    alike = same_songs(mine, theirs, ["set_id"], SAME_TITLE, forms).select("set_id", F.col("left_id").alias("slot"), F.col("right_id").alias("track"))
    return weak.join(alike, ["set_id", "slot", "track"]).select("set_id", "slot").distinct()


def settled(
    slots: DataFrame, durations: DataFrame, *, reach: float = ID_REACH, weak_reach: float = WEAK_REACH, bin: float = 600.0, light_rows: int | None = LIGHT_ROWS
) -> dict[str, DataFrame]:
    """Which heard song fills which ID, which strong one disagrees with a listed song, and where songs heard once are offered.

    slots also holds start, hits and strength of what was heard. Slots that are both heard and listed part a set into gaps, and nothing
    crosses them. fills and rivals [set_id, slot, heard]: the listed slot and the heard one; offers [set_id, heard, slot], slot null
    where no ID is near. An ID reaches from the edge of the listed slot before it to the time of the one after.
    """
    hot = hot_groups(slots, ["set_id"], light_rows)
    mark = F.when(F.col("listed") & F.col("time").isNotNull(), F.struct("time", "edge"))
    rows = scan(
        slots, ["set_id"], ["slot"], _part(),
        [
            Scan("gap", "sum", F.when(F.col("heard") & F.col("listed"), 1).otherwise(0)),
            Scan("_left", "last_before", mark), Scan("_right", "first_after", mark),
        ], hot=hot,
    ).join(durations, "set_id", "left")
    last = slots.groupBy("set_id").agg(F.max(F.coalesce("start", "time")).alias("_last"))
    rows = cut_lineage(rows.join(last, "set_id", "left"))
    heard = rows.where("heard and not listed").select("set_id", "gap", F.col("slot").alias("heard"), "start", "hits", "strength")
    listed = rows.where("listed and not heard")
    low = F.when(F.col("_left").isNull(), 0.0).otherwise(F.coalesce("_left.edge", "_left.time"))
    high = F.coalesce("_right.time", "duration", F.greatest("_last", low))
    ids = listed.where("kind = 'unknown'").withColumns({"low": low, "high": high}).select("set_id", "gap", "slot", "time", "approx", "low", "high")

    apart = F.when(F.col("time").isNull(), float("inf")).otherwise(F.abs(F.col("time") - F.col("start")))
    sure = ~F.col("approx") & F.col("time").isNotNull()
    # An ID is sent to every time bin that it can claim a song in.
    from_ = F.least(F.col("low"), F.when(sure, F.col("time") - reach).otherwise(F.col("low"))) - weak_reach
    until = F.greatest(F.col("high"), F.when(sure, F.col("time") + reach).otherwise(F.col("high")), from_) + weak_reach
    binned = ids.withColumn("_bin", F.explode(F.sequence(F.floor(from_ / bin), F.floor(until / bin))))
    pairs = binned.join(heard.withColumn("_bin", F.floor(F.col("start") / bin)), ["set_id", "gap", "_bin"]).drop("_bin")

    def claims(slack: float) -> Column:
        within = (F.col("start") >= F.col("low") - slack) & (F.col("start") <= F.col("high") + slack)
        return within | (sure & (F.abs(F.col("start") - F.col("time")) <= reach))

    rank = F.array_position(F.array(F.lit("strong"), F.lit("medium"), F.lit("weak")), F.col("strength"))
    pairs = cut_lineage(pairs.withColumns({"_apart": apart, "_rank": rank, "_hits": -F.col("hits")}).where(claims(weak_reach)))
    solid = pairs.where((F.col("strength") != "weak") & claims(0.0))
    # An ID with a time and a song near it takes none from further away.
    held = solid.where(~F.col("approx") & (F.col("_apart") <= reach)).select("set_id", "slot").distinct().withColumn("_held", F.lit(True))
    solid = solid.join(held, ["set_id", "slot"], "left").where(F.col("_held").isNull() | (F.col("_apart") <= reach))
    closest = ["_apart", "_rank", "_hits", "start"]
    fills = greedy_pairs(solid.select("set_id", "slot", "heard", *closest), "slot", "heard", closest).select("set_id", "slot", "heard")
    fills = cut_lineage(fills)

    strong = heard.where("strength = 'strong'").join(fills, ["set_id", "heard"], "left_anti")
    songs = listed.where("kind = 'named'").select("set_id", "gap", "slot", "time", "approx")
    free = F.col("approx") | F.col("time").isNull()
    # Songs with a sure time meet in time bins, the others all over their gap.
    timed = songs.where(~free).withColumn("_bin", F.explode(F.sequence(F.floor((F.col("time") - reach) / bin), F.floor((F.col("time") + reach) / bin))))
    near = timed.join(strong.withColumn("_bin", F.floor(F.col("start") / bin)), ["set_id", "gap", "_bin"]).drop("_bin").where(apart <= reach)
    loose = songs.where(free).join(strong, ["set_id", "gap"])
    against = near.unionByName(loose.select(*near.columns)).withColumns({"_apart": apart, "_rank": rank, "_hits": -F.col("hits")})
    rivals = greedy_pairs(against.select("set_id", "slot", "heard", *closest), "slot", "heard", closest).select("set_id", "slot", "heard")

    offered = pairs.where("strength = 'weak'").groupBy("set_id", "heard").agg(F.min_by("slot", F.struct("_apart", "slot")).alias("slot"))
    offers = heard.where("strength = 'weak'").select("set_id", "heard").join(offered, ["set_id", "heard"], "left")
    return {"fills": fills, "rivals": rivals, "offers": offers}


def stretches(
    slots: DataFrame, durations: DataFrame, *, between: bool, opening: Column | bool = True,
    song_seconds: float = SONG_SECONDS, size: float = 3600.0, light_rows: int | None = LIGHT_ROWS,
) -> DataFrame:
    """set_id, time, until: where nothing was heard for ``song_seconds`` after a heard song, or from the start of the set.

    A listed song that nobody heard plays as long as its listing says, so no stretch follows one. ``between``: after heard songs
    too, else only the opening, where ``opening`` (a constant, or a column of ``durations``) allows it.
    """
    opening = F.lit(opening) if isinstance(opening, bool) else opening
    sets = durations.select("set_id", "duration", opening.alias("_opening"))
    timed = slots.where("time is not null").select("set_id", "slot", "time", "edge", "heard")
    hot = hot_groups(timed, ["set_id"], light_rows)
    # The edge is the furthest end in a row of heard songs; an unheard one begins a new row, and leaves no edge.
    part = F.floor(F.col("time") / size)
    rows = scan(timed, ["set_id"], ["time", "slot"], part, [Scan("_row", "sum", F.when(F.col("heard"), 0).otherwise(1))], hot=hot)
    furthest = Scan("_far", "max", F.when(F.col("heard"), F.greatest("edge", F.when(F.col("_row") == 0, 0.0))))
    rows = scan(cut_lineage(rows), ["set_id", "_row"], ["time", "slot"], part, [furthest], hot=hot)
    behind = F.when(F.col("heard"), F.col("_far"))
    rows = scan(rows.withColumn("_behind", behind), ["set_id"], ["time", "slot"], part, [Scan("_prior", "lag", F.struct("_behind"))], hot=hot)
    rows = rows.join(sets, "set_id", "left")
    start = F.col("_prior").isNull()
    edge = F.when(start, 0.0).otherwise(F.col("_prior._behind"))
    allowed = F.when(start, F.coalesce("_opening", F.lit(False))).otherwise(F.lit(between))
    found = rows.where(allowed & (F.col("time") - edge >= song_seconds)).select("set_id", edge.alias("_from"), F.col("time").alias("until"))
    # After the last slot, up to the end of the set.
    final = rows.groupBy("set_id").agg(F.max_by(F.struct("_behind"), F.struct("time", "slot")).alias("l"))
    ends = sets.join(final, "set_id", "left")
    last = F.when(F.col("l").isNull(), F.when(F.col("_opening"), 0.0)).when(F.lit(between), F.col("l._behind"))
    closing = ends.where(F.col("duration") - last >= song_seconds).select("set_id", last.alias("_from"), F.col("duration").alias("until"))
    return found.unionByName(closing).withColumnRenamed("_from", "time")
