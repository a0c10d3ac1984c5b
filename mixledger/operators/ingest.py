"""New files into a catalog, changed files back to it, checks of list input, and job reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import version_markers, with_forms
from ..functions.urls import evidence_url
from ..session import spread
from .tracklists import file_name_labels

# Error patterns in the order they are tried, with code and whether a retry helps.
ERROR_RULES = [
    (r"no supported javascript runtime|javascript runtime is not supported", "JAVASCRIPT_RUNTIME_REQUIRED", False),
    (r"sign in|login required|private video|cookies", "SOURCE_AUTH_REQUIRED", False),
    (r"429|too many requests", "SOURCE_RATE_LIMITED", True),
    (r"http error 5\d\d", "SOURCE_FAILED", True),
    (r"not available|unavailable|removed|drm|geo.?restrict|does not exist|http error 404", "SOURCE_UNAVAILABLE", False),
]
ERROR_LINK = r"(?i)\b[a-z][a-z0-9+.-]*://(?:[^\s\"'<>()/@]*@)?(?:[^\s\"'<>()/.:]+\.)*([^\s\"'<>()/.:]+\.[^\s\"'<>()/.:]+)[^\s\"'<>()]*"
ERROR_HEADER = r"(?i)\b(set-cookie|cookies?|authorization)(\s*[=:]\s*).*"
ERROR_SECRET = r"(?i)\b((?:\w*_)?(?:token|signature|sig|key|password|pot|secret))([\"']?\s*[=:]\s*[\"']?)[^\s&;,()\"']+"
CONTROL = r"[\x00-\x1F\x7F]"


def ingest(inventory: DataFrame, recordings: DataFrame, revisions: DataFrame) -> dict[str, DataFrame]:
    """Readable files as recordings, revisions and locations; what a catalog knows stays.

    inventory[path, sha256, artist, title, version, stem], recordings[recording_id, identity_key,
    artist, title, version], revisions[revision_id, recording_id, sha256]. Tags name a file, else its
    file name (provisional), else its bytes. Ids are hashes of what they identify.
    """
    artist, title = file_name_labels(F.col("stem"))
    tagged = (F.coalesce("artist", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    rows = inventory.withColumn("_tagged", tagged)
    rows = rows.withColumns(
        {
            "artist": F.when(tagged, F.col("artist")).otherwise(artist),
            "title": F.when(tagged, F.col("title")).otherwise(F.when(title != "", title).otherwise(F.col("stem"))),
            "version": F.when(tagged, F.coalesce("version", F.lit(""))).otherwise(""),
        }
    )
    label = ["artist", "title", "version"]
    known = with_forms(spread(rows.select(*label).distinct())).select(*label, F.col("identity_key").alias("_identity"))
    rows = rows.join(known, label, "left").withColumn(
        "identity_key", F.when(F.col("_tagged"), F.col("_identity")).otherwise(F.concat(F.lit("provisional:"), "sha256"))
    )
    have = revisions.select("sha256", F.col("revision_id").alias("_revision"), F.col("recording_id").alias("_recording"))
    rows = rows.join(have, "sha256", "left")
    held = recordings.select("identity_key", F.col("recording_id").alias("_same"))
    rows = rows.join(held, "identity_key", "left")
    rows = rows.withColumns(
        {
            "recording_id": F.coalesce("_recording", "_same", F.sha2(F.concat(F.lit("recording:"), "identity_key"), 256)),
            "revision_id": F.coalesce("_revision", F.sha2(F.concat(F.lit("revision:"), "sha256"), 256)),
        }
    )
    new_file = F.col("_revision").isNull()
    # The bytes are known under another identity than the tags now give: a person decides.
    moved = F.col("_recording").isNotNull() & F.col("_same").isNotNull() & (F.col("_recording") != F.col("_same"))
    fresh = rows.where(new_file)
    new_recordings = (
        fresh.where(F.col("_same").isNull())
        .groupBy("recording_id", "identity_key")
        .agg(F.min_by(F.struct(*label, "_tagged"), "path").alias("l"))
        .select("recording_id", "identity_key", "l.artist", "l.title", "l.version",
                F.when(F.col("l._tagged"), "embedded_tags").otherwise("file_name").alias("labels_source"))
    )
    return {
        "recordings": new_recordings,
        "revisions": fresh.groupBy("revision_id", "sha256").agg(F.min_by("recording_id", "path").alias("recording_id")),
        "locations": rows.select("path", "revision_id"),
        "conflicts": rows.where(moved).select("path", "sha256", F.col("_recording").alias("recording_id"), F.col("_same").alias("other_recording_id")),
    }


def scan_outcome(items: DataFrame) -> DataFrame:
    """items[job_id, state, new_file, recording_id, new_recording] -> counts and outcome per job."""
    done = F.col("state") == "succeeded"
    return items.groupBy("job_id").agg(
        F.count_if(done).alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.count_if(F.col("state") == "needs_input").alias("needs_input"),
        F.count_if(done & F.col("new_file")).alias("new_tracks"),
        F.count_distinct(F.when(done, F.col("recording_id"))).alias("recordings"),
        F.count_if(done & F.col("new_recording")).alias("new_recordings"),
    ).withColumn(
        "outcome",
        F.when(F.col("needs_input") > 0, "needs_attention")
        .when((F.col("failed") > 0) | (F.col("skipped") > 0), "completed_with_gaps")
        .otherwise("complete"),
    )


def identity_conflicts(requests: DataFrame) -> DataFrame:
    """Files whose tags name other artists, another title or other mix words than asked: for review.

    requests[item_id, artist, title, version, tag_artist, tag_title, tag_version, exact_version].
    """
    asked = with_forms(requests)
    tags = with_forms(
        requests.select("item_id", *(F.col(f"tag_{n}").alias(n) for n in ("artist", "title", "version")))
    ).select("item_id", F.col("names").alias("_names"), F.col("credit_base_key").alias("_base"), F.col("title_form").alias("_form"))
    rows = asked.join(tags, "item_id")
    mine, theirs = version_markers(F.col("title_form")), version_markers(F.col("_form"))
    reason = (
        F.when(F.col("names") != F.col("_names"), "artist")
        .when(F.element_at(F.split("credit_base_key", r"\|"), -1) != F.element_at(F.split("_base", r"\|"), -1), "title")
        .when(F.col("exact_version") & (F.col("title_form") != F.col("_form")), "version")
        .when(F.array_sort(mine) != F.array_sort(theirs), "version")
    )
    return rows.select("item_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def apply_resolutions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open reviews with the newest decision on each: accepted, rejected or still open."""
    last = decisions.groupBy("review_id").agg(F.max_by("action", "at").alias("action"))
    state = F.when(F.col("action") == "accept", "accepted").when(F.col("action").isNotNull(), "rejected").otherwise("open")
    return reviews.join(last, "review_id", "left").withColumn("state", state).drop("action")


def reconcile(changes: DataFrame, inventory: DataFrame, revisions: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Intended file changes against what is there now.

    changes[path, expected_revision_id, expected_sha256, action], inventory[path, sha256,
    audio_sha256], revisions[revision_id, sha256, audio_sha256], items[list_id, item_id, accepted].
    """
    now = inventory.select("path", F.col("sha256").alias("_now"), F.col("audio_sha256").alias("_audio"))
    was = revisions.select(F.col("revision_id").alias("expected_revision_id"), F.col("sha256").alias("_was"), F.col("audio_sha256").alias("_was_audio"))
    rows = changes.join(now, "path", "left").join(was, "expected_revision_id", "left")
    error = (
        F.when(F.col("_was").isNull(), "revision_unknown")
        .when(F.col("_was") != F.col("expected_sha256"), "revision_stale")
        .when(F.col("_now").isNull(), "file_unavailable")
        .when((F.col("action") == "tag_only") & ~F.coalesce(F.col("_audio") == F.col("_was_audio"), F.lit(False)), "audio_changed")
    )
    rows = rows.withColumn("error", error)
    good = rows.where(F.col("error").isNull())
    moved = good.where(F.col("_now") != F.col("_was")).withColumn("revision_id", F.sha2(F.concat(F.lit("revision:"), "_now"), 256))
    replaced = moved.where(F.col("action") == "replace_audio").select(F.col("expected_revision_id").alias("_gone")).distinct()
    touched = moved.select(F.col("expected_revision_id").alias("_gone")).distinct()
    return {
        "revisions": moved.select("revision_id", F.col("_now").alias("sha256"), "expected_revision_id").distinct(),
        "locations": moved.select("path", "revision_id"),
        "replaced": replaced.select(F.col("_gone").alias("revision_id")),
        "invalidated": items.join(touched, F.col("accepted.revision_id") == F.col("_gone"), "left_semi").select("list_id", "item_id"),
        "errors": rows.where(F.col("error").isNotNull()).select("path", "error"),
    }


def validate_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid items, invalid ones with ``problem``)."""
    named = F.col("kind") == "named"
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    text = F.concat_ws("", "artist", "title", "version", "label")
    problem = (
        F.when(~F.col("kind").isin("named", "unknown"), "kind")
        .when(named & (blank("artist") | blank("title")), "artist_and_title_required")
        .when(~named & blank("label"), "label_required")
        .when(~named & (~blank("artist") | ~blank("title")), "unknown_must_not_guess")
        .when(text.rlike(CONTROL), "control_characters")
        .when((F.length("artist") > 500) | (F.length("title") > 1000) | (F.length("version") > 500), "too_long")
        .when(F.col("source_url").isNotNull() & ~evidence_url("source_url"), "source_url")
    )
    rows = items.withColumn("problem", problem)
    return rows.where(F.col("problem").isNull()).drop("problem"), rows.where(F.col("problem").isNotNull())


def classify_errors(lines: DataFrame) -> DataFrame:
    """lines[source, n, text] -> code, retryable and text without secrets, per source.

    Where a source has ``ERROR:`` lines, only those decide; the first rule any of them meets wins.
    """
    low = F.lower("text")
    rank: Column = F.lit(len(ERROR_RULES))
    for i, (pattern, _, _) in reversed(list(enumerate(ERROR_RULES))):
        rank = F.when(low.rlike(pattern), i).otherwise(rank)
    is_error = low.startswith("error:")
    clean = F.regexp_replace(F.regexp_replace("text", ERROR_LINK, "<$1 link>"), ERROR_HEADER, "$1$2…")
    clean = F.regexp_replace(clean, ERROR_SECRET, "$1$2…")
    per_source = lines.groupBy("source").agg(
        F.min(F.when(is_error, rank)).alias("_error_rank"),
        F.min(rank).alias("_any_rank"),
        F.max_by(clean, F.struct(is_error, "n")).alias("clean_text"),
    )
    found = F.coalesce("_error_rank", "_any_rank")
    codes = F.array(*(F.lit(c) for _, c, _ in ERROR_RULES), F.lit("SOURCE_FAILED"))
    retry = F.array(*(F.lit(r) for _, _, r in ERROR_RULES), F.lit(True))
    return per_source.select(
        "source", F.element_at(codes, found + 1).alias("code"), F.element_at(retry, found + 1).alias("retryable"), "clean_text"
    )


def failure_groups(items: DataFrame) -> DataFrame:
    """items[job_id, position, code, message] -> failed items by code, commonest first."""
    return (
        items.groupBy("job_id", "code")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("message", "position").alias("message"))
        .orderBy("job_id", F.desc("n"), "code")
    )


def items_by_state(items: DataFrame, job_id, state: str, *, after: int = -1, limit: int | None = None) -> DataFrame:
    rows = items.where((F.col("job_id") == job_id) & (F.col("state") == state) & (F.col("position") > after))
    rows = rows.orderBy("position")
    return rows if limit is None else rows.limit(limit)


def latest_added(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Rows newest first by the time they were added; a missing time or zone fails the batch."""
    stamp = F.trim("added_at")
    zoned = stamp.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    at = F.try_to_timestamp(F.when(zoned, stamp))
    checked = F.when(at.isNull(), F.raise_error(F.lit("Every row needs an added time with its offset."))).otherwise(at)
    ordered = rows.withColumn("added", checked.cast("timestamp")).orderBy(F.desc("added"), "position")
    return ordered if n is None else ordered.limit(n)


def search_results(replies: DataFrame) -> DataFrame:
    """replies[request_id, entries array<struct>] -> one row per entry with a usable address."""
    rows = replies.select("request_id", F.posexplode("entries").alias("place", "e")).select("request_id", "place", "e.*")
    return rows.where(evidence_url("url"))

