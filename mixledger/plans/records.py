"""Histories, rankings, intervals, addresses and device checks over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import history as hist
from ..operators import intervals, ranking, targets, verify
from ..operators.scan import hot_groups
from . import views
from .lists import norm
from .registry import query


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a listening history: user, song (event type and a number), time."""
    return views.table(spark, folder, "events").select(
        "user_id",
        F.col("event_type").alias("artist"),
        F.concat(F.lit("Song "), F.floor(F.col("value") / 5).cast("string")).alias("title"),
        F.when(F.col("event_id") % 4 == 0, F.concat_ws("-", F.lit("US"), "event_type", F.floor(F.col("value") / 10).cast("string")))
        .alias("isrc"),
        F.col("ts").alias("shazamed_at"),
        F.col("event_id").alias("position"),
    )


RECORDS = f"""records as (
  select user_id, event_type as artist, 'Song ' || floor(value / 5)::bigint as title, ts as shazamed_at,
    event_id as position,
    case when event_id % 4 = 0 then 'US' || event_type || floor(value / 10)::bigint end as isrc,
    {norm("event_type")} || '|' || {norm("'Song ' || floor(value / 5)::bigint")} as label
  from events)"""
# Two labels that share an ISRC are one song, and so are all records of these labels.
MERGED = RECORDS + """,
codes as (select user_id, isrc, min(label) as song_key from records where isrc is not null group by 1, 2),
linked as (select user_id, label, min(song_key) as song_key from records join codes using (user_id, isrc) group by 1, 2),
songs as (select r.*, coalesce(l.song_key, r.label) as song_key from records r left join linked l using (user_id, label)),
merged as (select user_id, song_key, arg_min(artist, (shazamed_at, position)) as artist,
  arg_min(title, (shazamed_at, position)) as title, min(shazamed_at) as shazamed_at,
  max(shazamed_at) as last_shazamed_at, count(*) as count from songs group by 1, 2)"""


@query(f"""with {MERGED} select user_id, song_key, artist, title, shazamed_at, last_shazamed_at, count from merged""")
def history_merge(spark: SparkSession, folder: str) -> DataFrame:
    return hist.history_merge(records(spark, folder)).select(
        "user_id", "song_key", "artist", "title", "shazamed_at", "last_shazamed_at", "count"
    )


@query(f"""with {MERGED} select user_id, count(*) as songs, sum(count) as plays from merged group by 1""")
def history_merge_linked(spark: SparkSession, folder: str) -> DataFrame:
    songs = hist.history_merge_linked(records(spark, folder))
    return songs.groupBy("user_id").agg(F.count(F.lit(1)).alias("songs"), F.sum("count").alias("plays"))


@query(f"""with {RECORDS}, cuts as (select distinct user_id, timestamp '2024-01-10' as through,
    timestamp '2024-01-20' as until from events),
  listed as (select distinct user_id, unnest([isrc, label]) as k from records where shazamed_at <= timestamp '2024-01-10')
  select position from records r where not (shazamed_at > timestamp '2024-01-10' and shazamed_at <= timestamp '2024-01-20'
    and exists (select 1 from listed l where l.user_id = r.user_id and (l.k = r.isrc or l.k = r.label)))""")
def history_unseen(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    cuts = rows.select("user_id").distinct().select(
        "user_id",
        F.lit(None).cast("timestamp_ntz").alias("since"),
        F.lit("2024-01-10").cast("timestamp_ntz").alias("through"),
        F.lit("2024-01-20").cast("timestamp_ntz").alias("until"),
    )
    return hist.unseen(rows, cuts).select("position")


@query(f"""with {MERGED}, numbered as (select user_id, song_key,
    row_number() over (partition by user_id order by shazamed_at, song_key) - 1 as n from merged)
  select user_id, song_key, n // 20 as list_no, n % 20 as place from numbered""")
def history_chunks(spark: SparkSession, folder: str) -> DataFrame:
    source = records(spark, folder)
    merged = hist.history_merge(source)
    return hist.history_chunks(merged, size=20, hot=hot_groups(source, ["user_id"])).select(
        "user_id", "song_key", "list_no", "place"
    )


def requests_and_entries(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = views.table(spark, folder, "part")
    request = F.concat_ws("/", "p_brand", "p_name")
    remix = F.when(F.length("p_name") % 3 == 0, " (Foo Remix)").otherwise("")
    requests = part.select(
        request.alias("request_id"),
        F.concat("p_brand", F.lit(" & Somebody Else")).alias("artist"),
        F.concat("p_name", remix).alias("title"),
        F.lit("").alias("version"),
    ).distinct()
    mix = F.when(F.col("p_size") % 6 == 0, " (Live Remix)").when(F.col("p_size") % 6 == 1, " (Foo RMX)")
    mix = F.coalesce(mix.when(F.col("p_size") % 6 == 2, " (Unplugged)"), F.lit(""))
    key = F.col("p_partkey")
    entries = part.select(
        request.alias("request_id"),
        key.cast("string").alias("url"),
        F.when(key % 5 == 0, "youtube").otherwise("soundcloud").alias("provider"),
        F.concat("p_brand", F.lit(" - "), "p_name", mix).alias("title"),
        F.when(key % 4 == 0, F.concat("p_brand", F.lit(" - Topic")))
        .when(key % 4 == 1, F.concat("p_brand", F.lit(" Records")))
        .otherwise("someone")
        .alias("uploader"),
        (F.floor(F.col("p_retailprice")) / 10).alias("duration"),
        (F.col("p_size") * 1000).cast("long").alias("view_count"),
    )
    return requests, entries


@query("""with e as (
  select p_brand || '/' || p_name as request_id, p_partkey::varchar as url, floor(p_retailprice) / 10 as duration,
    p_size * 1000 as views, length(p_name) % 3 <> 0 and p_size % 6 in (0, 1, 2) as other_version,
    p_partkey % 4 = 0 as official, p_partkey % 4 = 1 as label,
    p_brand || ' - ' || p_name || case p_size % 6 when 0 then ' (Live Remix)' when 1 then ' (Foo RMX)' when 2 then ' (Unplugged)' else '' end as title,
    case when p_partkey % 4 = 0 then p_brand || ' - Topic' when p_partkey % 4 = 1 then p_brand || ' Records' else 'someone' end as uploader,
    case when p_partkey % 5 = 0 then 'youtube' else 'soundcloud' end as provider,
    0.6 + case when p_partkey % 4 = 0 then 0.15 when p_partkey % 4 = 1 then 0.06 - 0.05 else -0.05 end
     + case when p_partkey % 20 = 0 then 0.05 else 0 end
     - case when length(p_name) % 3 <> 0 and p_size % 6 in (0, 1, 2) then 0.4 else 0 end
     + 0.04 * least(log10(p_size * 1000 + 1) / 8, 1) as base
  from part where floor(p_retailprice) / 10 between 60 and 900 and (length(p_name) % 3 <> 0 or p_size % 6 = 1)),
 m as (select *, not other_version and abs(duration - (select median(duration) from e o where o.request_id = e.request_id
    and not o.other_version and o.url <> e.url)) <= 8 as near from e),
 s as (select *, round(least(greatest(base + case when near then 0.1 else 0 end, 0), 1), 3) as score,
   label and exists (select 1 from e o where o.request_id = m.request_id and o.official and not o.other_version
    and abs(o.duration - m.duration) <= 2) as vouched from m),
 r as (select *, row_number() over w as rank, lead(score) over w as s2, lead(official or label) over w as o2,
   lead(other_version) over w as v2, lead(duration) over w as d2, official or vouched as whole from s
   window w as (partition by request_id order by score desc, views desc, title, uploader, provider, url))
 select request_id, url, score, rank, other_version, rank = 1 and whole and not other_version and score >= 0.75
   and (s2 is null or round(score - s2, 3) >= 0.1 or coalesce(o2 and not v2 and abs(d2 - duration) <= 2, false) or vouched) as confident
 from r""")
def rank_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = ranking.rank_sources(*requests_and_entries(spark, folder))
    return rows.select("request_id", "url", "score", "rank", "other_version", "confident")


@query("""with m as (select user_id as set_id, event_type as song, floor(value) as n,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t, floor(value)::bigint as likes from events where event_type <> 'purchase'),
  o as (select user_id as set_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as t from events where event_type = 'purchase'),
  p as (select o.set_id, o.t as t0, m.song, m.n, max(m.likes) as likes, min(abs(m.t - o.t)) as gap
    from o join m on o.set_id = m.set_id and m.t between o.t - 21600 and o.t + 43200 group by 1, 2, 3, 4),
  s as (select set_id, t0, song, count(*) as mentions, sum(likes)::bigint as likes, min(gap) as gap, min(n) as first from p group by 1, 2, 3)
  select set_id, t0, song, mentions, likes,
    row_number() over (partition by set_id, t0 order by mentions desc, likes desc, gap, first, song) as rank from s""")
def interval_hints(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events").withColumn("seconds", views.seconds_since(F.col("ts")))
    mentions = events.where(F.col("event_type") != "purchase").select(
        F.col("user_id").alias("set_id"),
        F.floor("value").alias("n"),
        F.lit("").alias("artist"),
        F.col("event_type").alias("title"),
        F.col("event_type").alias("song"),
        "seconds",
        F.floor("value").alias("likes"),
    )
    moments = events.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("set_id"), F.col("seconds").alias("at"))
    hints = intervals.rank_hints(mentions, moments, before=21600.0, after=43200.0)
    return hints.select("set_id", F.col("at").alias("t0"), "song", "mentions", "likes", "rank")


@query(r"""with u as (select page_id, url,
    regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^(www|m|mobile|music)\.', '') as host,
    lower(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '')) as path,
    regexp_extract(url, '^[^?#]*\?(?:[^#]*&)?id=([^&#]+)', 1) as id from pages)
  select page_id, case when host <> '' and path <> '' then host || path || case when id <> '' then '?id=' || id else '' end end as url_key,
    starts_with(url, 'https://') as secure from u""")
def url_keys(spark: SparkSession, folder: str) -> DataFrame:
    pages = views.table(spark, folder, "pages")
    return pages.select("page_id", urls.url_key("url").alias("url_key"), urls.evidence_url("url").alias("secure"))


@query(r"""with l as (select page_id, unnest(list_distinct(list_transform(regexp_extract_all(url || '), then ' || url || '/more. ' ||
    replace(html, 'href="/', 'href="https://a.example/'), 'https?://[^\s<>"'']+'),
    lambda x: regexp_replace(x, '[.,;:!?)\]]+$', '')))) as link from pages) select page_id, link from l""")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    linked = F.replace("html", F.lit('href="/'), F.lit('href="https://a.example/'))
    text = F.concat("url", F.lit("), then "), "url", F.lit("/more. "), linked)
    return views.table(spark, folder, "pages").select("page_id", F.explode(urls.links_in(text)).alias("link"))


def device(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as expected bytes; a device that holds most of them under other names."""
    docs = views.table(spark, folder, "documents")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    expected = docs.select(
        F.col("source").alias("playlist"), F.col("doc_id").alias("position"), sha.alias("sha256"), F.col("n_chars").alias("size_bytes")
    )
    files = docs.where(F.col("doc_id") % 10 != 3).select(
        F.concat(F.lit("/Contents/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"),
        F.col("n_chars").alias("size"),
        sha.alias("sha256"),
    )
    return expected, files


FILES = """d as (select doc_id, source as playlist, sha256(text) as sha, n_chars from documents),
 f as (select '/Contents/' || lpad(doc_id::varchar, 12, '0') as path, sha, n_chars from d where doc_id % 10 <> 3)"""


@query(f"""with {FILES} select doc_id as position, (select min(path) from f where f.sha = d.sha and f.n_chars = d.n_chars) as path from d""")
def device_diff(spark: SparkSession, folder: str) -> DataFrame:
    return verify.content_join(*device(spark, folder)).select("position", "path")


@query(f"""with {FILES} select d.sha as sha256, max(c.n) is not null as found, coalesce(max(c.n), 0) as copies from (select distinct sha from d) d
  left join (select sha, count(*) as n from f group by 1) c on c.sha = d.sha group by 1""")
def hash_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return verify.hash_inventory(*device(spark, folder)).drop("relative_paths")


@query(f"""with {FILES}, e as (select d.playlist, d.doc_id, d.sha, d.n_chars, f.sha as fsha, f.n_chars as fn, f.path
   from d left join f on f.path = '/Contents/' || lpad((case when doc_id % 50 = 7 then doc_id + 1 else doc_id end)::varchar, 12, '0'))
  select playlist, count(*) as expected, count(*) filter (where sha = fsha and n_chars = fn) as found,
    count(*) filter (where sha = fsha and n_chars = fn) = count(*) as in_order,
    'device_library_and_file_hashes' as verified_by from e group by 1""")
def device_check(spark: SparkSession, folder: str) -> DataFrame:
    expected, files = device(spark, folder)
    shown = F.when(F.col("position") % 50 == 7, F.col("position") + 1).otherwise(F.col("position"))
    entries = expected.select(
        "playlist", "position", F.concat(F.lit("/Contents/"), F.lpad(shown.cast("string"), 12, "0")).alias("path")
    )
    return verify.device_check(expected, entries, files)


@query("""with t as (select p_partkey, case p_partkey % 6 when 0 then 'mp3' when 1 then 'aac' when 2 then 'pcm_s16le'
    when 3 then 'flac' when 4 then 'pcm_f32le' else '' end as codec, p_size as s, p_partkey % 6 as c from part)
  select p_partkey, case when c = 5 then 'TARGET_CODEC_UNKNOWN' when c = 4 then 'TARGET_CODEC_UNSUPPORTED' else
    concat_ws(',', case when s % 5 = 0 then 'TARGET_CHANNELS_UNSUPPORTED' end,
      case when c in (2, 3) and s % 2 = 0 then 'TARGET_BIT_DEPTH_UNSUPPORTED' end,
      case when c in (0, 1) and s % 7 = 0 then 'TARGET_BITRATE_UNKNOWN' end,
      case when c = 1 and s % 3 = 0 then 'TARGET_CODEC_PROFILE_UNKNOWN' end) end as issues from t""")
def assess_targets(spark: SparkSession, folder: str) -> DataFrame:
    c, s = F.col("p_partkey") % 6, F.col("p_size")
    tracks = views.table(spark, folder, "part").select(
        "p_partkey",
        F.lit("cdj-3000").alias("profile_id"),
        F.when(c == 0, "mp3").when(c == 1, "aac").when(c == 2, "pcm_s16le").when(c == 3, "flac").when(c == 4, "pcm_f32le").otherwise("").alias("codec"),
        F.when(s % 5 == 0, 6).otherwise(2).alias("channels"),
        F.lit(44100).alias("sample_rate"),
        F.when(s % 2 == 0, 32).otherwise(16).alias("bit_depth"),
        F.when(s % 7 != 0, 256000).alias("bitrate_bps"),
        F.when(s % 3 != 0, "LC").alias("codec_profile"),
        F.when(c == 0, ".mp3").when(c == 1, ".m4a").when(c == 2, ".wav").otherwise(".flac").alias("ext"),
    )
    rows = targets.assess_tracks(tracks, targets.target_rules(spark))
    return rows.select("p_partkey", F.array_join("issues", ",").alias("issues"))


@query("""with o as (select user_id as delivery_id, case event_type when 'view' then 'imported' when 'click' then 'analyzed'
     when 'purchase' then 'native_exported' when 'error' then 'device_library_checked' else 'hardware_playback' end as stage,
     case when value < 90 then 'passed' else 'failed' end as outcome, ts as t from events),
  l as (select delivery_id, stage, max(t) as t, arg_max(outcome, t) as outcome from o group by 1, 2),
  w as (select delivery_id,
    max(t) filter (where stage = 'imported') as t1, max(outcome) filter (where stage = 'imported') as o1,
    max(t) filter (where stage = 'analyzed') as t2, max(outcome) filter (where stage = 'analyzed') as o2,
    max(t) filter (where stage = 'native_exported') as t3, max(outcome) filter (where stage = 'native_exported') as o3
    from l group by 1),
  k as (select *, coalesce(o1 = 'passed', false) as imported,
    coalesce(o1 = 'passed' and o2 = 'passed' and t2 > t1, false) as analyzed from w)
  select delivery_id, imported, analyzed, coalesce(analyzed and o3 = 'passed' and t3 > greatest(t1, t2), false) as native_exported from k""")
def stage_evidence(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    rows = views.table(spark, folder, "events").select(
        F.col("user_id").alias("delivery_id"),
        F.when(kind == "view", "imported").when(kind == "click", "analyzed").when(kind == "purchase", "native_exported")
        .when(kind == "error", "device_library_checked").otherwise("hardware_playback").alias("stage"),
        F.when(F.col("value") < 90, "passed").otherwise("failed").alias("outcome"),
        F.col("ts").alias("at"),
    )
    return verify.current_stages(rows).select("delivery_id", "imported", "analyzed", "native_exported")
