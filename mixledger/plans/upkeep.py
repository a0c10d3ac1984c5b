"""Ingest, job reports, errors and names over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as ing
from ..operators import verify
from ..sources import writers
from . import views
from .lists import norm
from .registry import query


@query(f"""with f as (select doc_id, sha256(text) as sha, doc_id % 3 <> 0 as tagged, source, lang from documents),
  k as (select *, case when tagged then {norm("source")} || '|' || {norm("'song ' || (doc_id % 40)")} || '|' else 'provisional:' || sha end as identity_key from f),
  held as (select distinct sha from f where doc_id % 5 = 0)
  select 'recordings' as kind, count(distinct identity_key) as n from k where sha not in (select sha from held)
  union all select 'revisions', count(distinct sha) from k where sha not in (select sha from held)
  union all select 'locations', count(*) from k""")
def ingest(spark: SparkSession, folder: str) -> DataFrame:
    docs = views.table(spark, folder, "documents")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    tagged = F.col("doc_id") % 3 != 0
    inventory = docs.select(
        F.col("doc_id").cast("string").alias("path"),
        sha.alias("sha256"),
        F.when(tagged, F.col("source")).alias("artist"),
        F.when(tagged, F.concat(F.lit("song "), (F.col("doc_id") % 40).cast("string"))).alias("title"),
        F.lit("").alias("version"),
        F.concat(F.lit("file_"), "doc_id").alias("stem"),
    )
    revisions = docs.where(F.col("doc_id") % 5 == 0).select(
        F.concat(F.lit("v"), sha).alias("revision_id"), F.concat(F.lit("r"), sha).alias("recording_id"), sha.alias("sha256")
    ).distinct()
    recordings = revisions.select(
        "recording_id", F.concat(F.lit("held:"), "sha256").alias("identity_key"), F.lit("x").alias("artist"), F.lit("y").alias("title"), F.lit("").alias("version")
    )
    out = ing.ingest(inventory, recordings, revisions)
    counts = [out[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("recordings", "revisions", "locations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""select user_id as job_id, count(*) filter (where event_type <> 'error') as succeeded,
  count(*) filter (where event_type = 'error') as failed,
  count(*) filter (where event_type <> 'error' and value < 20) as new_tracks,
  count(distinct case when event_type <> 'error' then floor(value) end) as recordings,
  case when count(*) filter (where event_type = 'error') > 0 then 'completed_with_gaps' else 'complete' end as outcome
  from events group by 1""")
def scan_outcome(spark: SparkSession, folder: str) -> DataFrame:
    items = views.table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("state"),
        (F.col("value") < 20).alias("new_file"),
        F.floor("value").alias("recording_id"),
        F.lit(False).alias("new_recording"),
    )
    return ing.scan_outcome(items).select("job_id", "succeeded", "failed", "new_tracks", "recordings", "outcome")


@query("""select user_id as job_id, event_type as code, count(*) as n, arg_min('m' || event_id, event_id) as message
  from events group by 1, 2""")
def failure_groups(spark: SparkSession, folder: str) -> DataFrame:
    items = views.table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("position"), F.col("event_type").alias("code"), F.concat(F.lit("m"), "event_id").alias("message")
    )
    return ing.failure_groups(items)


@query("""with l as (select user_id, event_id, event_type as t, case event_type when 'error' then 'ERROR: HTTP Error 503' when 'view' then 'WARNING: 429 too many requests'
    when 'click' then 'ERROR: private video' else 'nothing' end as text from events),
  r as (select *, case when text like 'ERROR: HTTP%' then 3 when text like 'WARNING%' then 2 when text like 'ERROR: private%' then 1 else 5 end as rank,
    text like 'ERROR:%' as e from l)
  select user_id as source, case coalesce(min(rank) filter (where e), min(rank)) when 1 then 'SOURCE_AUTH_REQUIRED' when 2 then 'SOURCE_RATE_LIMITED' else 'SOURCE_FAILED' end as code,
   coalesce(min(rank) filter (where e), min(rank)) <> 1 as retryable from r group by 1""")
def classify_errors(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    lines = views.table(spark, folder, "events").select(
        F.col("user_id").alias("source"),
        F.col("event_id").alias("n"),
        F.when(kind == "error", "ERROR: HTTP Error 503").when(kind == "view", "WARNING: 429 too many requests")
        .when(kind == "click", "ERROR: private video").otherwise("nothing").alias("text"),
    )
    return ing.classify_errors(lines).drop("clean_text")


@query("""with s as (select p_partkey, p_name, lower(p_name) as low from part),
  f as (select *, min(p_partkey) over (partition by low) as first from s)
  select p_partkey as list_id, case when p_partkey = first then p_name else p_name || ' ' || substr(sha256(p_partkey::varchar), 1, 6) end as file_name from f""")
def name_collisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "part").select(
        F.col("p_partkey").alias("list_id"), F.col("p_name").alias("name"), F.lit(0).alias("created_at")
    )
    return writers.name_collisions(rows).select("list_id", "file_name")


@query("""select p_partkey, case when p_size % 5 = 0 then 'artist_and_title_required' when p_size % 7 = 0 then 'source_url' end as problem
  from part where p_size % 5 = 0 or p_size % 7 = 0""")
def invalid_items(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    rows = views.table(spark, folder, "part").select(
        "p_partkey",
        F.lit("named").alias("kind"),
        F.when(size % 5 == 0, " ").otherwise(F.col("p_brand")).alias("artist"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("version"),
        F.lit(None).cast("string").alias("label"),
        F.when(size % 7 == 0, "http://example.com/x").otherwise("https://example.com/x").alias("source_url"),
    )
    return ing.validate_items(rows)[1].select("p_partkey", "problem")


@query("""with c as (select l_orderkey as collection_id, row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as position, l_partkey from lineitem),
  w as (select collection_id, string_agg(l_partkey::varchar, '/' order by position) as s, count(*) as n from c group by 1)
  select collection_id, n as tracks, count(*) over (partition by s) as same from w""")
def collection_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    members = views.numbered_ids(spark, folder).select(
        F.col("list_id").alias("collection_id"), "position", F.col("recording_id").alias("revision_id"), F.col("recording_id").alias("sha256")
    )
    prints = verify.collection_fingerprint(members, also={"tracks": F.count(F.lit(1))})
    same = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("same"))
    return prints.join(same, "fingerprint").select("collection_id", "tracks", "same")


@query("""with a as (select l_orderkey, l_partkey, count(*) as n from lineitem where l_linenumber <= 4 group by 1, 2),
  b as (select l_orderkey, l_partkey, count(*) as n from lineitem where l_linenumber >= 3 group by 1, 2)
  select 'missing' as side, count(*) as n from a where not exists (select 1 from b where b.l_partkey = a.l_partkey)
  union all select 'extra', count(*) from b where not exists (select 1 from a where a.l_partkey = b.l_partkey)""")
def expected_observed(spark: SparkSession, folder: str) -> DataFrame:
    line = views.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    expected = line.where("l_linenumber <= 4").select("l_orderkey", "l_partkey").distinct()
    observed = line.where("l_linenumber >= 3").select("l_orderkey", "l_partkey").distinct()
    missing, extra = verify.differences(expected, observed, "l_partkey")
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(missing, "missing").unionByName(count(extra, "extra"))


@query("""with o as (select o_orderkey, o_orderdate, o_custkey from orders)
  select o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) as list_id from o group by 1""")
def latest_list(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.catalog import newest

    orders = views.table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("list_id"), "o_orderdate")
    return newest(orders, ["o_custkey"], "o_orderdate", "list_id").select("o_custkey", "list_id")


@query("""select (select count(*) from part) as tracks, (select count(*) from part where p_partkey % 5 <> 0) as with_bpm,
  (select count(*) from part) as with_key, (select count(*) from customer) as collections, (select count(*) from orders) as request_lists,
  (select count(*) from orders where o_orderstatus = 'O') as active_jobs""")
def library_summary(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.catalog import library_summary as summary
    from .lists import tracks

    rows = tracks(spark, folder)
    notes = rows.select("revision_id", F.col("bpm.value").alias("bpm"), F.col("key.value").alias("key"))
    jobs = views.table(spark, folder, "orders").select(F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("state"))
    return summary(rows, notes, views.table(spark, folder, "customer"), views.table(spark, folder, "orders"), jobs)




@query("""select p_partkey::varchar as recording_id, case when p_size % 4 = 0 then 'unavailable' when p_size % 4 = 1 then 'unchanged'
  when p_size % 4 = 2 then 'tags_only' else 'changed' end as result from part""")
def verify_working_files(spark: SparkSession, folder: str) -> DataFrame:
    key, turn = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    part = views.table(spark, folder, "part")
    assets = part.select(
        key.alias("recording_id"), key.alias("path"), F.sha2(key, 256).alias("sha256"), F.col("p_name").alias("audio_sha256"), F.lit("pcm").alias("audio_format")
    )
    now = part.where(turn != 0).select(
        key.alias("path"),
        F.when(turn == 1, F.sha2(key, 256)).otherwise("other").alias("sha256"),
        F.when(turn == 3, "other").otherwise(F.col("p_name")).alias("audio_sha256"),
        F.lit("pcm").alias("audio_format"),
    )
    return verify.verify_working_files(assets, now).select("recording_id", "result")


@query("""with p as (select o_custkey as device_id, o_orderstatus as name, o_orderkey as playlist_id, floor(o_totalprice / 50000) as tracks from orders)
  select device_id, name, arg_max(playlist_id, (tracks, -playlist_id)) as playlist_id, count(*) as same_name_playlists from p group by 1, 2""")
def named_playlists(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("device_id"),
        F.col("o_orderstatus").alias("name"),
        F.col("o_orderkey").alias("playlist_id"),
        F.floor(F.col("o_totalprice") / 50000).alias("tracks"),
    )
    return verify.named_playlists(rows)


@query("""with n as (select l_orderkey as playlist, row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as position, l_partkey from lineitem),
  w as (select playlist, count(*) as n, count(distinct l_partkey) as d from n group by 1)
  select playlist, d = n and playlist % 3 <> 2 as membership_match, d = n and playlist % 3 <> 2 and (playlist % 3 = 0 or n = 1) as order_match from w""")
def native_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as native playlists: a third as meant, a third in reverse, a third missing."""
    part = views.table(spark, folder, "part")
    path = F.concat(F.lit("/music/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(" x.mp3"))
    id = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    tracks = part.select(id.alias("recording_id"), path.alias("path"))
    xml = part.select(id.alias("TrackID"), writers.file_uri(path).alias("Location"))
    lines = views.numbered_ids(spark, folder).select(F.col("list_id").alias("playlist"), "position", "recording_id")
    last = lines.groupBy("playlist").agg(F.max("position").alias("_last"))
    shown = lines.join(last, "playlist").where(F.col("playlist") % 3 != 2)
    entries = shown.select(
        "playlist",
        F.lit("0").alias("node"),
        F.lit("0").alias("key_type"),
        F.when(F.col("playlist") % 3 == 1, F.col("_last") + 1 - F.col("position")).otherwise(F.col("position")).alias("position"),
        F.col("recording_id").alias("key"),
    )
    return verify.native_diff(tracks, lines, xml, entries)[1].select("playlist", "membership_match", "order_match")
