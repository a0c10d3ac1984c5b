"""Metadata, filters with an explicit rule for the unknown, orders, and fair samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.labels import clean_key, key_order
from .scan import LIGHT_ROWS, Scan, scan


def tag_values(tags: Column, names: Sequence[str]) -> Column:
    """Distinct values under any alias of a field, in tag order."""

    def ours(name: Column, _value: Column) -> Column:
        low = F.lower(name)
        return low.isin(*names) | F.substring_index(low, ":", 1).isin(*names)

    values = F.flatten(F.map_values(F.map_filter(tags, ours)))
    return F.array_distinct(F.filter(F.transform(values, F.trim), lambda v: v != ""))


def _known(raw: Column, parsed: Column) -> Column:
    good = F.array_distinct(F.filter(parsed, lambda v: v.isNotNull()))
    known = (F.size(good) == 1) & (F.size(raw) == 1)
    return F.struct(
        F.when(known, F.get(good, F.lit(0))).alias("value"),
        known.alias("known"),
        F.lit(False).alias("verified"),
        F.when(F.size(raw) > 0, "embedded_tag").otherwise("unknown").alias("source"),
    )


def embedded_tags(files: DataFrame, tags: str = "tags") -> DataFrame:
    """files[..., tags map<string,array<string>>] plus what its tags say."""
    rows = files.withColumns(
        {
            "_bpm": tag_values(F.col(tags), fixed.BPM_TAGS),
            "_key": tag_values(F.col(tags), fixed.KEY_TAGS),
            "embedded_genres": tag_values(F.col(tags), fixed.GENRE_TAGS),
            "embedded_comments": tag_values(F.col(tags), fixed.COMMENT_TAGS),
        }
    )

    def tempo(v: Column) -> Column:
        number = v.try_cast("double")
        return F.when((number >= 20) & (number <= 400), number)

    return rows.withColumns(
        {
            "embedded_bpm": _known(F.col("_bpm"), F.transform("_bpm", tempo)),
            "embedded_key": _known(F.col("_key"), F.transform("_key", clean_key)),
        }
    ).drop("_bpm", "_key")


def effective_metadata(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Embedded values, with the operator's own over them.

    annotations[revision_id, bpm struct<value,source,verified>, key struct<...>, genres, tags,
    set_role, energy].
    """
    ours = annotations.select(
        "revision_id",
        F.col("bpm").alias("_bpm"),
        F.col("key").alias("_key"),
        F.col("genres").alias("_genres"),
        "tags",
        "set_role",
        "energy",
    )
    rows = files.drop("tags", "set_role", "energy").join(ours, "revision_id", "left")

    def over(own: str, embedded: str) -> Column:
        mine = F.struct(
            F.col(f"{own}.value").alias("value"),
            F.lit(True).alias("known"),
            F.col(f"{own}.verified").alias("verified"),
            F.col(f"{own}.source").alias("source"),
        )
        return F.when(F.col(own).isNotNull(), mine).otherwise(F.col(embedded))

    return rows.withColumns(
        {
            "bpm": over("_bpm", "embedded_bpm"),
            "key": over("_key", "embedded_key"),
            "genres": F.coalesce("_genres", "embedded_genres"),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
        }
    ).drop("_bpm", "_key", "_genres")


def filter_reasons(
    tracks: DataFrame,
    *,
    bpm_min: float | None = None,
    bpm_max: float | None = None,
    keys: Sequence[str] = (),
    genres: Sequence[str] = (),
    tags: Sequence[str] = (),
    set_roles: Sequence[str] = (),
    require_verified: bool = False,
    unknown: str = "exclude",
) -> DataFrame:
    """``tracks`` plus ``reasons`` to leave a track out and ``unknowns`` met on the way.

    unknown: ``exclude`` counts an unknown as a reason, ``include`` does not, ``error`` fails.
    """
    reasons: list[Column] = []
    unknowns: list[Column] = []

    def judge(field: str, fails: Column, reason: str) -> None:
        known = F.coalesce(F.col(f"{field}.known"), F.lit(False))
        verified = F.coalesce(F.col(f"{field}.verified"), F.lit(False))
        open_ = F.when(~known, f"{field}_unknown")
        if require_verified:
            open_ = open_.when(~verified, f"{field}_unverified")
        unknowns.append(open_)
        settled = known & verified if require_verified else known
        reasons.append(F.when(settled & fails, reason))

    if bpm_min is not None or bpm_max is not None:
        value = F.col("bpm.value")
        low = value < bpm_min if bpm_min is not None else F.lit(False)
        high = value > bpm_max if bpm_max is not None else F.lit(False)
        judge("bpm", low | high, "bpm_outside_range")
    if keys:
        judge("key", ~F.lower("key.value").isin([k.casefold() for k in keys]), "key_not_matched")

    def overlap(values: Column, wanted: Sequence[str], field: str) -> None:
        have = F.transform(values, F.lower)
        want = F.array(*(F.lit(w.casefold()) for w in wanted))
        empty = F.coalesce(F.size(values), F.lit(0)) <= 0
        unknowns.append(F.when(empty, f"{field}_unknown"))
        reasons.append(F.when(~empty & ~F.arrays_overlap(have, want), f"{field}_not_matched"))

    if genres:
        overlap(F.col("genres"), genres, "genres")
    if tags:
        overlap(F.col("tags"), tags, "tags")
    if set_roles:
        role = F.when(F.coalesce("set_role", F.lit("")) != "", F.array("set_role"))
        overlap(role, set_roles, "set_role")

    none = F.array().cast("array<string>")
    rows = tracks.withColumns(
        {
            "reasons": F.array_compact(F.array(*reasons)) if reasons else none,
            "unknowns": F.array_compact(F.array(*unknowns)) if unknowns else none,
        }
    )
    if unknown == "exclude":
        return rows.withColumn("reasons", F.concat("reasons", "unknowns"))
    if unknown == "error":
        message = F.lit("organize: no verified value for a field that the filter needs")
        checked = F.when(F.size("unknowns") > 0, F.raise_error(message)).otherwise(F.col("reasons"))
        return rows.withColumn("reasons", checked.cast("array<string>"))
    return rows


def order_columns(order_by: str, descending: bool = False) -> list[Column]:
    """Sort columns: unknown values last either way, ties by ids."""
    value = {
        "input": lambda: F.col("position"),
        "artist": lambda: F.lower("artist"),
        "title": lambda: F.lower("title"),
        "bpm": lambda: F.col("bpm.value"),
        "key": lambda: key_order("key.value"),
        "energy": lambda: F.col("energy"),
    }[order_by]()
    sort = value.desc_nulls_last() if descending else value.asc_nulls_last()
    # Within the known ones a descending order turns the ids round as well.
    flip = value.isNotNull() if descending else F.lit(False)
    ids = [F.col("recording_id"), F.col("revision_id")]
    down = [F.when(flip, c).desc_nulls_last() for c in ids]
    up = [F.when(~flip, c).asc_nulls_last() for c in ids]
    return [sort, *down, *up]


def first_references(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first occurrence of each recording, the later ones). Two revisions of one recording in one
    selection are an error: see ``revision_conflicts``."""
    first = tracks.groupBy("recording_id").agg(F.min("position").alias("_first"))
    rows = tracks.join(first, "recording_id")
    return (
        rows.where(F.col("position") == F.col("_first")).drop("_first"),
        rows.where(F.col("position") != F.col("_first")).drop("_first"),
    )


def revision_conflicts(tracks: DataFrame) -> DataFrame:
    """Recordings selected with different byte revisions."""
    return (
        tracks.groupBy("recording_id")
        .agg(F.min("revision_id").alias("_low"), F.max("revision_id").alias("_high"))
        .where(F.col("_low") != F.col("_high"))
        .select("recording_id")
    )


def organize(
    tracks: DataFrame, *, order_by: str = "input", descending: bool = False, **filters
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected in order, excluded with reasons, histogram of reasons)."""
    first, again = first_references(tracks)
    judged = filter_reasons(first, **filters)
    selected = judged.where(F.size("reasons") == 0).orderBy(*order_columns(order_by, descending))
    excluded = (
        judged.where(F.size("reasons") > 0)
        .select("recording_id", "revision_id", "reasons")
        .unionByName(
            again.select("recording_id", "revision_id", F.array(F.lit("duplicate_reference")).alias("reasons"))
        )
    )
    histogram = (
        excluded.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    )
    return selected, excluded, histogram


def round_robin(
    memberships: DataFrame, n: int, *, light_rows: int | None = LIGHT_ROWS
) -> DataFrame:
    """The first ``n`` distinct recordings taking one from each collection in turn.

    memberships[collection_id, collection_order, position, recording_id, revision_id]. A
    collection gives at most ``n`` of its own before the turns are merged, so nothing is gathered.
    """
    turn = scan(
        memberships,
        ["collection_id"],
        ["position"],
        F.floor(F.col("position") / 100_000),
        [Scan("turn", "number")],
        light_rows=light_rows,
    )
    first = turn.groupBy("recording_id").agg(
        F.min(F.struct("turn", "collection_order", "revision_id")).alias("_f")
    )
    top = first.orderBy("_f.turn", "_f.collection_order", "recording_id").limit(n)
    w = Window.orderBy("_f.turn", "_f.collection_order", "recording_id")
    return top.select(
        "recording_id", F.col("_f.revision_id").alias("revision_id"), F.row_number().over(w).alias("rank")
    )
