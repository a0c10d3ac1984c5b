"""Expected against observed: device contents, native playlists, hashes, stages, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import bind
from ..functions.urls import location_key, path_key
from .lists import ordered_fingerprint

# Stages of a delivery, in order.
STAGES = ["imported", "analyzed", "native_exported", "device_library_checked", "hardware_playback"]
# File system names seen under other names.
FILESYSTEMS = {"ms-dos fat32": "fat32", "ms-dos fat16": "fat16", "hfs": "hfs+", "journaled hfs+": "hfs+"}


def content_join(expected: DataFrame, files: DataFrame) -> DataFrame:
    """expected[sha256, size_bytes, ...] with the first path holding those bytes, or null.

    A renamed copy counts; the same name with other bytes does not. Copies collapse before the join.
    """
    held = files.groupBy(F.col("size").alias("size_bytes"), "sha256").agg(F.min("path").alias("path"))
    return expected.join(held, ["size_bytes", "sha256"], "left")


def sizes_to_hash(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files worth reading: only those as long as something expected."""
    return files.join(expected.select(F.col("size_bytes").alias("size")).distinct(), "size", "left_semi")


def hash_inventory(expected: DataFrame, files: DataFrame, *, keep: int | None = None) -> DataFrame:
    """Each expected hash: found or not, in how many files, and their paths (all, or the first)."""
    want = expected.select("sha256").distinct()
    here = files.join(want, "sha256", "left_semi")
    w = Window.partitionBy("sha256").orderBy("path")
    listed = here if keep is None else here.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep)
    some = (
        listed.groupBy("sha256")
        .agg(F.array_sort(F.collect_list("path")).alias("relative_paths"))
    )
    counts = here.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"))
    return (
        want.join(counts, "sha256", "left")
        .join(some, "sha256", "left")
        .select("sha256", F.col("copies").isNotNull().alias("found"), F.coalesce("copies", F.lit(0)).alias("copies"), "relative_paths")
    )


def named_playlists(playlists: DataFrame) -> DataFrame:
    """Per device and name the playlist with most tracks, and how many share the name.

    playlists[device_id, playlist_id, name, tracks].
    """
    best = F.max_by("playlist_id", F.struct("tracks", -F.col("playlist_id")))
    return playlists.groupBy("device_id", "name").agg(
        best.alias("playlist_id"), F.count(F.lit(1)).alias("same_name_playlists")
    )


def positional_diff(expected: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entry by entry: does the device's i-th entry hold the i-th expected bytes?

    expected[playlist, position, sha256, size_bytes], entries[playlist, position, path],
    files[path, size, sha256].
    """
    shown = entries.join(files, "path", "left").select(
        "playlist", "position", "path", F.col("size").alias("_size"), F.col("sha256").alias("_sha")
    )
    rows = expected.withColumn("_wanted", F.lit(True)).join(shown, ["playlist", "position"], "full")
    same = (F.col("sha256") == F.col("_sha")) & (F.col("size_bytes") == F.col("_size"))
    return rows.select(
        "playlist",
        "position",
        "path",
        F.coalesce("_wanted", F.lit(False)).alias("expected"),
        F.coalesce(same, F.lit(False)).alias("matches"),
    )


def device_check(
    expected: DataFrame, entries: DataFrame | None, files: DataFrame
) -> DataFrame:
    """Per playlist: expected, found, in order, and which check could run.

    Without a readable device library the bytes alone are looked up and the order stays unknown.
    """
    listed = positional_diff(expected, entries, files) if entries is not None else None
    names = expected.select("playlist").distinct()
    if listed is None:
        have, with_library = names.limit(0), names.limit(0)
    else:
        have = listed.groupBy("playlist").agg(
            F.count_if("expected").alias("expected"),
            F.count_if("matches").alias("found"),
            F.count_if(F.col("path").isNotNull()).alias("device_entries"),
        )
        with_library = entries.select("playlist").distinct()
    alone = content_join(expected.join(with_library, "playlist", "left_anti"), files)
    alone = alone.groupBy("playlist").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if(F.col("path").isNotNull()).alias("found")
    )
    loose = alone.select(
        "playlist",
        "expected",
        "found",
        F.lit(None).cast("boolean").alias("in_order"),
        F.lit("usb_file_hashes").alias("verified_by"),
    )
    if listed is None:
        return loose
    full = have.join(with_library, "playlist", "left_semi").select(
        "playlist",
        "expected",
        "found",
        ((F.col("found") == F.col("expected")) & (F.col("expected") == F.col("device_entries"))).alias("in_order"),
        F.lit("device_library_and_file_hashes").alias("verified_by"),
    )
    return full.unionByName(loose)


def path_join(native: DataFrame, catalog_paths: DataFrame, *, location: str = "Location") -> DataFrame:
    """Native rows matched to catalog files by exact local path; several recordings = ambiguous."""
    left = bind(native, path_key=location_key(location))
    right = catalog_paths.select(path_key("path").alias("path_key"), "recording_id", "revision_id").where(
        F.col("path_key").isNotNull()
    )
    owners = right.groupBy("path_key").agg(
        F.count_distinct("recording_id").alias("recordings"),
        F.min("recording_id").alias("recording_id"),
        F.max("revision_id").alias("revision_id"),
    )
    state = F.when(F.col("recordings").isNull(), "unmatched").when(F.col("recordings") > 1, "ambiguous").otherwise("matched")
    return left.join(owners, "path_key", "left").withColumn("state", state)


def name_join(analysis: DataFrame, catalog_paths: DataFrame) -> DataFrame:
    """Newest analysis per file name, matched where exactly one catalog file has that name."""
    newest = analysis.groupBy("name").agg(F.max_by(F.struct("bpm", "beats", "hot_cues", "memory_cues"), "mtime").alias("a"))
    base = F.regexp_extract("path", r"([^/\\]+)$", 1)
    owners = catalog_paths.groupBy(base.alias("name")).agg(
        F.count_distinct("revision_id").alias("files"), F.min("revision_id").alias("revision_id")
    )
    state = F.when(F.col("files").isNull(), "unmatched").when(F.col("files") > 1, "ambiguous").otherwise("matched")
    return newest.join(owners, "name", "left").select("name", "a.*", "revision_id", state.alias("state"))


def analysis_sync(matched: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotation changes, counts by outcome). An operator's own value is never overwritten."""
    now = annotations.select("revision_id", F.col("bpm").alias("_bpm"))
    rows = matched.join(now, "revision_id", "left")
    outcome = (
        F.when(F.col("state") != "matched", F.col("state"))
        .when(F.col("bpm").isNull(), "not_analyzed")
        .when(F.col("_bpm.source") == "operator", "kept")
        .when(F.col("_bpm.value") == F.col("bpm"), "unchanged")
        .otherwise("updated")
    )
    rows = rows.withColumn("outcome", outcome)
    counts = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    changes = rows.where(F.col("outcome") == "updated").select(
        "revision_id", F.struct(F.col("bpm").alias("value"), F.lit("native").alias("source"), F.lit(False).alias("verified")).alias("bpm")
    )
    return changes, counts


def native_diff(
    tracks: DataFrame, playlists: DataFrame, xml_tracks: DataFrame, xml_entries: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(track states, playlist states) of a native collection against a manifest.

    tracks[recording_id, path], playlists[playlist, position, recording_id],
    xml_tracks[TrackID, Location], xml_entries[playlist, node, key_type, position, key].
    """
    native = bind(xml_tracks, track_id=F.col("TrackID"), path_key=location_key("Location")).select("track_id", "path_key")
    by_id = native.where(F.col("track_id").isNotNull()).groupBy("track_id").agg(
        F.count(F.lit(1)).alias("id_n"), F.min("path_key").alias("path_key")
    )
    by_path = native.where(F.col("path_key").isNotNull()).groupBy("path_key").agg(
        F.count(F.lit(1)).alias("path_n"), F.min("track_id").alias("track_id")
    )
    single = (
        by_path.where("path_n = 1")
        .join(by_id.where("id_n = 1").select("track_id", F.col("path_key").alias("_p")), "track_id")
        .where(F.col("_p") == F.col("path_key"))
        .select("path_key", "track_id")
    )
    wanted = bind(tracks, path_key=path_key("path"))
    state = F.when(F.col("track_id").isNotNull(), "matched").when(F.col("path_n").isNull(), "missing").otherwise("ambiguous")
    track_report = (
        wanted.join(single, "path_key", "left")
        .join(by_path.select("path_key", "path_n"), "path_key", "left")
        .select("recording_id", "path", state.alias("state"), "track_id")
    )
    by_key = F.concat(F.lit("i:"), "key")
    refs = bind(
        xml_entries, _ref=F.when(F.col("key_type") == "0", by_key).otherwise(F.concat(F.lit("p:"), location_key("key")))
    )
    answers = single.select(F.concat(F.lit("i:"), "track_id").alias("_ref"), "path_key").unionByName(
        single.select(F.concat(F.lit("p:"), "path_key").alias("_ref"), "path_key")
    )
    seen = refs.join(answers, "_ref", "left")
    expected = playlists.join(wanted.select("recording_id", "path_key"), "recording_id")
    both = expected.select("playlist", "position", F.col("path_key").alias("a"), F.lit(True).alias("meant")).unionByName(
        seen.select("playlist", "position", F.col("path_key").alias("b"), F.lit(False).alias("meant")), allowMissingColumns=True
    ).where(F.col("playlist").isNotNull())
    # Bag and sequence are compared by counts of equal (path) and equal (position, path) rows. Everything is
    # added up, per path, per place, then per list, so no task sorts several tables side by side.
    n, m = F.count_if(F.col("meant")), F.count_if(~F.col("meant"))
    bags = (
        both.where(F.col("meant") | F.col("b").isNotNull())
        .groupBy("playlist", F.coalesce("a", "b").alias("_path"))
        .agg(n.alias("n"), m.alias("m"))
        .select("playlist", (F.col("n") == F.col("m")).alias("bag"), F.greatest(F.col("m") - 1, F.lit(0)).alias("repeats"))
    )
    alike = (F.count("a") == n) & (F.count("b") == m) & (F.min("a") == F.max("b")) & (F.max("a") == F.min("b"))
    places = both.groupBy("playlist", "position").agg(
        (F.coalesce(alike, F.lit(False)) & F.col("position").isNotNull()).alias("seq"), (m - F.count("b")).alias("unresolved")
    )
    nodes = xml_entries.where(F.col("playlist").isNotNull()).groupBy("playlist").agg(F.count_distinct("node").alias("nodes"))
    named = playlists.select("playlist").distinct().withColumn("_named", F.lit(True))
    facts = named
    for part in (nodes, bags, places):
        facts = facts.unionByName(part, allowMissingColumns=True)
    report = facts.groupBy("playlist").agg(
        F.max("nodes").alias("nodes"),
        F.sum("unresolved").alias("unresolved"),
        F.sum("repeats").alias("repeats"),
        F.bool_and("bag").alias("bag"),
        F.bool_and("seq").alias("seq"),
        F.max("_named").alias("_named"),
    ).where("_named")
    clean = (F.col("unresolved") == 0) & (F.col("repeats") == 0)
    report = report.withColumns({"membership_match": clean & F.col("bag"), "order_match": clean & F.col("seq")})
    problem = (
        F.when(F.col("nodes").isNull(), "playlist_missing")
        .when(F.col("nodes") > 1, "playlist_ambiguous")
        .when(F.col("unresolved") > 0, "reference_unresolved")
        .when(F.col("repeats") > 0, "track_repeated")
        .when(~F.col("membership_match"), "membership_mismatch")
        .when(~F.col("order_match"), "order_mismatch")
    )
    return track_report, report.select(
        "playlist",
        F.coalesce("nodes", F.lit(0)).alias("candidates"),
        (F.coalesce("membership_match", F.lit(False)) & (F.col("nodes") == 1)).alias("membership_match"),
        (F.coalesce("order_match", F.lit(False)) & (F.col("nodes") == 1)).alias("order_match"),
        problem.alias("problem"),
    )


def multiset_equal(one: Column, other: Column) -> Column:
    """Same members whatever their order."""
    return F.array_sort(one) == F.array_sort(other)


def differences(expected: DataFrame, observed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(missing, extra) by key."""
    return (
        expected.join(observed.select(key).distinct(), key, "left_anti"),
        observed.join(expected.select(key).distinct(), key, "left_anti"),
    )


def verify_working_files(assets: DataFrame, inventory: DataFrame) -> DataFrame:
    """unchanged, tags_only (same audio payload and format), changed or unavailable.

    assets[recording_id, path, sha256, audio_sha256, audio_format], inventory the same by path.
    """
    now = inventory.select(
        "path", F.col("sha256").alias("_s"), F.col("audio_sha256").alias("_a"), F.col("audio_format").alias("_f")
    )
    rows = assets.join(now, "path", "left")
    result = (
        F.when(F.col("_s").isNull(), "unavailable")
        .when(F.col("_s") == F.col("sha256"), "unchanged")
        .when((F.col("_a") == F.col("audio_sha256")) & (F.col("_f") == F.col("audio_format")), "tags_only")
        .otherwise("changed")
    )
    return rows.select("recording_id", "path", result.alias("result"))


def current_stages(observations: DataFrame) -> DataFrame:
    """The stages that still stand: a newer observation of an earlier stage voids later ones, and a
    passed stage needs the one before it to stand as passed.

    observations[delivery_id, stage, outcome, at]. Five stages make five columns, not five joins.
    """
    latest = observations.groupBy("delivery_id").agg(
        *(
            F.max(F.when(F.col("stage") == s, F.struct("at", "outcome"))).alias(s)
            for s in STAGES
        )
    )
    rows = latest
    for i, stage in enumerate(STAGES):
        earlier = [F.col(f"{s}.at") for s in STAGES[:i]]
        newest = F.greatest(*earlier) if len(earlier) > 1 else earlier[0] if earlier else None
        stands = F.col(stage).isNotNull()
        if newest is not None:
            stands = stands & (newest.isNull() | (F.col(f"{stage}.at") > newest))
            before = F.col(f"_ok_{STAGES[i - 1]}")
            stands = stands & ((F.col(f"{stage}.outcome") != "passed") | before)
        rows = rows.withColumn(f"_on_{stage}", F.coalesce(stands, F.lit(False)))
        rows = rows.withColumn(f"_ok_{stage}", F.col(f"_on_{stage}") & (F.col(f"{stage}.outcome") == "passed"))
        rows = rows.withColumn(f"_ok_{stage}", F.coalesce(f"_ok_{stage}", F.lit(False)))
    return rows.select("delivery_id", *(F.col(f"_ok_{s}").alias(s) for s in STAGES))


def delivery_readiness(stages: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Blockers in order, and the next step.

    deliveries[delivery_id, prepared, app_only, device_bound, readback_ok, filesystem_ok,
    partition_ok, marker_present].
    """
    rows = deliveries.join(stages, "delivery_id", "left")
    usb = ~F.col("app_only")
    done = {s: F.coalesce(s, F.lit(False)) for s in STAGES}
    blockers = [
        F.when(~F.col("prepared"), "prepare_working_copies"),
        F.when(usb & ~F.col("device_bound"), "bind_target_usb"),
        *(F.when(~done[s] & (usb if s not in STAGES[:2] else F.lit(True)), s) for s in STAGES),
        F.when(usb & ~F.col("readback_ok"), "device_audio_hash_readback"),
        F.when(~usb & ~F.col("readback_ok"), "app_working_file_readback"),
        F.when(usb & F.col("device_bound") & ~F.coalesce("filesystem_ok", F.lit(False)), "filesystem_unknown_or_unsupported"),
        F.when(usb & F.col("device_bound") & F.col("partition_ok").isNull(), "partition_scheme_unknown"),
        F.when(usb & F.col("device_bound") & ~F.col("partition_ok"), "partition_scheme_unsupported"),
        F.when(usb & done["native_exported"] & ~F.col("marker_present"), "native_library_marker_missing"),
    ]
    rows = rows.withColumn("blockers", F.array_compact(F.array(*blockers)))
    ready = F.when(F.col("app_only"), "verify_app_before_use").otherwise("verify_device_before_departure")
    return rows.select(
        "delivery_id",
        "blockers",
        F.coalesce(F.get("blockers", F.lit(0)), ready).alias("next_step"),
        (F.size("blockers") == 0).alias("requirements_met"),
    )


def media_ok(volumes: DataFrame, filesystems: list[str], unsupported_schemes: list[str]) -> DataFrame:
    """volumes[..., filesystem, partition_scheme] plus ``filesystem_ok`` and ``partition_ok``."""
    names = F.create_map(*(F.lit(x) for pair in FILESYSTEMS.items() for x in pair))
    fs = F.lower(F.coalesce("filesystem", F.lit("")))
    fs = F.coalesce(names[fs], fs)
    scheme = F.upper(F.coalesce("partition_scheme", F.lit("")))
    scheme = F.when(F.contains(scheme, F.lit("GUID")), "GPT").otherwise(scheme)
    bad = scheme.isin(*unsupported_schemes) if unsupported_schemes else F.lit(False)
    return volumes.withColumns(
        {
            "filesystem_ok": fs.isin(*(f.lower() for f in filesystems)),
            "partition_ok": F.when(scheme != "", ~bad),
        }
    )


def collection_fingerprint(members: DataFrame, also: dict[str, Column] | None = None) -> DataFrame:
    """collection_id -> fingerprint of its ordered revisions and bytes; ``also``: more aggregates of a collection."""
    return ordered_fingerprint(members, ["collection_id"], "position", "revision_id", "sha256", also=also)


def crate_readiness(members: DataFrame, receipts: DataFrame) -> DataFrame:
    """Counts of a crate and whether its import and device receipts are for what it holds now.

    members[collection_id, position, revision_id, sha256, available, bpm, key],
    receipts[collection_id, kind, fingerprint].
    """
    counts = members.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.count_if("available").alias("local_files"),
        F.count_if(F.col("bpm").isNotNull() & F.col("key").isNotNull()).alias("analyzed"),
    )
    rows = counts.join(collection_fingerprint(members), "collection_id")
    valid = receipts.join(rows.select("collection_id", "fingerprint"), ["collection_id", "fingerprint"]).groupBy(
        "collection_id"
    ).agg(
        F.bool_or(F.col("kind") == "import").alias("imported"),
        F.bool_or(F.col("kind") == "device").alias("on_device"),
    )
    return rows.join(valid, "collection_id", "left").withColumns(
        {"imported": F.coalesce("imported", F.lit(False)), "on_device": F.coalesce("on_device", F.lit(False))}
    )
