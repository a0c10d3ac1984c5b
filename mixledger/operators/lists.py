"""Counts, tables, crates and comparisons of checked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.labels import label, with_forms
from ..functions.urls import shop_links
from ..session import spread
from .matching import LABEL
from .scan import LIGHT_ROWS, Hot, Scan, scan

POSITIONS = 100_000


def with_label_forms(items: DataFrame, *forms: str) -> DataFrame:
    """Items plus comparison forms, worked out once per distinct label."""
    rows = items.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in LABEL})
    known = with_forms(spread(rows.select(*LABEL).distinct())).select(*LABEL, *forms)
    return rows.join(known, LABEL, "left").select(*items.columns, *forms)


def _has(checked: DataFrame, match: str, total: str) -> Column:
    """Whether an item has such candidates: by their list, or by the count of ``check_states``."""
    if "candidates" not in checked.columns:
        return F.col(total) > 0
    return F.exists("candidates", lambda c: c["identity_match"] == match)


def own(checked: DataFrame) -> DataFrame:
    """``checked`` plus ``own``: owned, id, maybe, other_mix or missing."""
    value = (
        F.when(F.col("state").isin(fixed.OWNED_STATES), "owned")
        .when(F.col("kind") == "unknown", "id")
        .when(_has(checked, "similar_credits", "maybe_total"), "maybe")
        .when(_has(checked, "different_version", "related_total"), "other_mix")
        .otherwise("missing")
    )
    return checked.withColumn("own", value)


def list_summary(checked: DataFrame) -> DataFrame:
    """Items per state and list, and the recordings that satisfy it, each once, in id order.

    Every state is present. A row holds the ids of its list; ``satisfied_recordings`` has them as rows.
    """
    rows = checked.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        *(F.count_if(F.col("state") == s).alias(s) for s in fixed.STATES),
        F.count_if(F.col("state") != "satisfied").alias("unresolved"),
        F.array_sort(F.collect_set("accepted.recording_id")).alias("unique_satisfied_recording_ids"),
    )
    return rows.withColumn("unique_satisfied_recordings", F.size("unique_satisfied_recording_ids").cast("long"))


def satisfied_recordings(checked: DataFrame) -> DataFrame:
    """The distinct recordings a list holds, one row each (a list may hold very many)."""
    return (
        checked.where(F.col("accepted").isNotNull())
        .select("list_id", F.col("accepted.recording_id").alias("recording_id"))
        .distinct()
    )


def _tally() -> list[Column]:
    return [
        F.count_if(F.col("own") == "owned").alias("owned"),
        F.count_if(F.col("own") == "missing").alias("missing"),
        F.count_if(F.col("own") == "other_mix").alias("other_mix"),
        F.count_if(F.col("own") == "maybe").alias("maybe"),
        F.count_if(F.col("own") == "id").alias("ids"),
        F.count_if((F.col("own") == "owned") & (F.col("state") != "satisfied")).alias("to_check"),
    ]


def list_counts(checked: DataFrame) -> DataFrame:
    """A list's tally, and how many files a crate from it holds."""
    file = F.when(F.col("state") == "satisfied", F.coalesce("accepted.revision_id", "item_id"))
    return own(checked).groupBy("list_id").agg(*_tally(), F.count_distinct(file).alias("in_crate"))


def list_counts_rollup(checked: DataFrame, group: str) -> DataFrame:
    """Tallies per ``group`` and list, per ``group``, and over all."""
    return own(checked).rollup(group, "list_id").agg(*_tally())


def duplicate_of(items: DataFrame) -> DataFrame:
    """Items plus the id of the first item in the list with the same identity."""
    rows = with_label_forms(items, "identity_key")
    first = (
        rows.where(F.col("kind") == "named")
        .groupBy("list_id", "identity_key")
        .agg(F.min_by("item_id", "position").alias("_first"))
        .withColumn("kind", F.lit("named"))
    )
    found = F.when(F.col("_first") != F.col("item_id"), F.col("_first"))
    return rows.join(first, ["list_id", "identity_key", "kind"], "left").select(
        *items.columns, found.alias("duplicate_of")
    )


def collect_lists(
    checked: DataFrame, names: DataFrame | None = None, *, light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None
) -> DataFrame:
    """A crate per list: accepted files in list order, each once. ``hot``: lists that may hold very many."""
    files = (
        checked.where(F.col("state") == "satisfied")
        .groupBy("list_id", F.col("accepted.revision_id").alias("revision_id"))
        .agg(
            F.min("position").alias("listed_at"),
            F.min_by("accepted.recording_id", "position").alias("recording_id"),
        )
    )
    crates = scan(
        files,
        ["list_id"],
        ["listed_at"],
        F.floor(F.col("listed_at") / POSITIONS),
        [Scan("place", "number")],
        light_rows=light_rows,
        hot=hot,
    )
    crates = crates.withColumn("position", (F.col("place") - 1).cast("long"))
    if names is not None:
        crates = crates.join(names, "list_id", "left")
    return crates.withColumn("collection_id", F.sha2(F.concat_ws(":", F.lit("crate"), "list_id"), 256)).drop(
        "place", "listed_at"
    )


def set_table(checked: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """What a reader of a list sees per song: own, in the crate, what they hold instead, where to look for it."""
    rows = own(checked)
    named = F.col("kind") == "named"
    name = F.when(named, label("artist", "title", "version")).otherwise("ID")
    if "candidates" in checked.columns:
        held = F.filter("candidates", lambda c: c["identity_match"].isin("different_version", "similar_credits"))
        first = F.get(held, F.lit(0))
    else:
        first = F.col("instead")
    rows = rows.select(
        "list_id",
        "position",
        *(c for c in ("timestamp",) if c in checked.columns),
        name.alias("label"),
        *(F.when(named, F.col(n)).alias(n) for n in LABEL),
        "own",
        (F.col("state") == "satisfied").alias("in_crate"),
        F.when(
            F.col("own").isin("other_mix", "maybe"),
            label(first["artist"], first["title"], first["version"]),
        ).alias("you_own"),
        F.when(F.col("own").isin("missing", "other_mix", "maybe"), shop_links("artist", "title", "version")).alias("shop"),
    )
    return rows if links is None else rows.join(links, ["list_id", "position"], "left")


# The sections of a shopping list.
SECTIONS = {"missing": "missing", "other_mix": "other mix", "maybe": "maybe", "id": "ids"}


def shopping_list(table: DataFrame, mixes: DataFrame | None = None) -> DataFrame:
    """What a list lacks, one row per line, with its section; sort by list, section, position.

    ``mixes`` (see ``matching.other_mixes``) adds the names of all mixes that stand for another mix; ``you_own`` is the label
    of the first.
    """
    section = F.create_map(*(F.lit(x) for pair in SECTIONS.items() for x in pair))[F.col("own")]
    lines = table.where(F.col("own") != "owned").withColumn("section", section)
    if mixes is not None:
        lines = lines.join(mixes.withColumn("own", F.lit("other_mix")), [*LABEL, "own"], "left")
    shown = ["list_id", "section", "position", "timestamp", "label", "title", "you_own", "mixes", "shop"]
    return lines.select(*(c for c in shown if c in lines.columns))


def to_check(checked: DataFrame) -> DataFrame:
    """Owned by label, but on evidence nobody confirmed."""
    return checked.where((F.col("state") == "satisfied") & ~F.coalesce(F.col("confidence") == "confirmed", F.lit(False)))


def unchecked_items(checked: DataFrame) -> DataFrame:
    """Items with a candidate whose bytes were not read for lack of budget."""
    return checked.where(F.exists("candidates", lambda c: c["availability"] == "verification_limit"))


def list_page(items: DataFrame, list_id, offset: int, limit: int) -> DataFrame:
    """Items ``offset`` up to ``offset + limit`` of one list, by position."""
    return items.where(F.col("list_id") == list_id).orderBy("position").offset(offset).limit(limit)


def _digest(*parts: str) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def ordered_fingerprint(
    rows: DataFrame, keys: list[str], position: str, *parts: str, also: dict[str, Column] | None = None
) -> DataFrame:
    """One value per group for its ordered content, without gathering the group.

    Each row is hashed with its position; four slices of the hashes are added up as decimals, which
    combines before the shuffle, and the sums are hashed with the row count. ``also`` names more
    aggregates of a group, taken in the same pass.
    """
    hashed = rows.withColumn("_h", _digest(position, *parts))
    sums = [
        F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    return hashed.groupBy(*keys).agg(
        F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias("fingerprint"),
        *(value.alias(name) for name, value in (also or {}).items()),
    )


def list_fingerprint(items: DataFrame) -> DataFrame:
    """list_id -> fingerprint of its songs in order, as credits are compared."""
    rows = with_label_forms(items, "credit_key_exact", "credit_key")
    song = F.when(F.col("kind") == "named", F.col("credit_key"))
    rows = rows.withColumn("_song", song)
    has_songs = F.bool_or(F.col("kind") == "named")
    return ordered_fingerprint(rows, ["list_id"], "position", "_song", also={"has_songs": has_songs})


def same_list(lists: DataFrame, items: DataFrame) -> DataFrame:
    """lists[list_id, name, updated_at] -> the newest list with the same name and songs.

    A list of IDs alone names no song and is never the same as another.
    """
    rows = lists.join(list_fingerprint(items), "list_id")
    songs = rows.where("has_songs")
    newest = songs.groupBy("name", "fingerprint").agg(
        F.max_by("list_id", F.struct("updated_at", "list_id")).alias("same_as")
    )
    return songs.join(newest, ["name", "fingerprint"]).select("list_id", "name", "same_as")


def list_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items whose evidence differs between two checks."""

    def evidence(df: DataFrame, name: str) -> DataFrame:
        facts = F.sha2(
            F.to_json(
                F.struct(
                    "state",
                    F.col("accepted.revision_id"),
                    F.array_sort(
                        F.transform(
                            "candidates",
                            lambda c: F.struct(
                                F.coalesce(c["revision_id"], F.lit("")).alias("r"),
                                F.coalesce(c["identity_match"], F.lit("")).alias("m"),
                                F.coalesce(c["availability"], F.lit("")).alias("a"),
                            ),
                        )
                    ).alias("c"),
                )
            ),
            256,
        )
        return df.select("list_id", "item_id", F.col("state").alias(f"{name}_state"), facts.alias(name))

    both = evidence(before, "old").join(evidence(after, "new"), ["list_id", "item_id"])
    return both.where(F.col("old") != F.col("new")).select("list_id", "item_id", "old_state", "new_state")
