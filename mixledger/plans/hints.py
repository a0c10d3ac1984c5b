"""Hints for IDs, whole scans and unions of histories over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hints, history
from . import views
from .records import RECORDS, records
from .registry import query

#: The events run over weeks, so spans are hours where a set has minutes.
BEFORE, LEAST, MOST, LENGTH = 21600.0, 43200.0, 172800.0, 86400.0
CHUNK = 21600.0


def _titled(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "events")
    return rows.select(
        F.col("user_id").alias("set_id"),
        F.col("event_id").alias("entry_id"),
        views.seconds_since(F.col("ts")).alias("at"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("song "), F.floor(F.col("value") / 10).cast("string")).alias("title"),
    )


@query(f"""
with rows as (
  select user_id as set_id, event_id as entry_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as "at",
    event_type as kind, 'song ' || floor(value / 10)::bigint as title from events),
placed as (
  select *, lead("at") over w as "end", lag(title) over w as previous, lead(title) over w as following
  from rows window w as (partition by set_id order by "at", entry_id)),
ids as (select * from placed where kind = 'error'),
hints as (
  select set_id, "at" as seconds, case when entry_id % 2 = 0 then title else kind end as artist,
    case when entry_id % 2 = 0 then kind else title end as title, 1 + entry_id % 3 as mentions, entry_id % 5 as likes
  from rows where kind <> 'error' and entry_id % 3 <> 0),
named as (select set_id, title from rows where kind <> 'error' and entry_id % 3 = 0)
select i.set_id, i.entry_id, h.artist, h.title, sum(h.mentions)::bigint as mentions, sum(h.likes)::bigint as likes
from ids i join hints h on h.set_id = i.set_id and h.seconds >= i."at" - {BEFORE}
  and h.seconds <= i."at" + greatest(least(coalesce(i."end", i."at" + {LENGTH}) - i."at", {MOST}), {LEAST})
where not exists (select 1 from named n where n.set_id = h.set_id and n.title = h.title)
  and coalesce(i.previous not in (h.artist, h.title), true) and coalesce(i.following not in (h.artist, h.title), true)
group by 1, 2, 3, 4
""")
def id_hints(spark: SparkSession, folder: str) -> DataFrame:
    rows = _titled(spark, folder)
    placed = Window.partitionBy("set_id").orderBy("at", "entry_id")
    ids = rows.withColumns(
        {"end": F.lead("at").over(placed), "previous": F.lag("title").over(placed), "following": F.lead("title").over(placed)}
    ).where("kind = 'error'").select("set_id", "entry_id", "at", "end", "previous", "following")
    even = F.col("entry_id") % 2 == 0
    said = rows.where("kind <> 'error' and entry_id % 3 <> 0").select(
        "set_id",
        F.col("at").alias("seconds"),
        F.when(even, F.col("title")).otherwise(F.col("kind")).alias("artist"),
        F.when(even, F.col("kind")).otherwise(F.col("title")).alias("title"),
        (1 + F.col("entry_id") % 3).alias("mentions"),
        (F.col("entry_id") % 5).alias("likes"),
    )
    named = rows.where("kind <> 'error' and entry_id % 3 = 0")
    return hints.id_hints(ids, said, named, before=BEFORE, least=LEAST, most=MOST, length=LENGTH)


@query(f"""
with rows as (
  select user_id as set_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as "at", event_type as song, value from events),
chunks as (select set_id, floor("at" / {CHUNK}) * {CHUNK} as "at", song, value as score from rows where song <> 'error'),
totals as (select set_id, max("at") as total from rows group by 1),
grid as (
  select set_id, k * {CHUNK}::double as "at"
  from (select set_id, unnest(range(floor((total - {CHUNK}) / {CHUNK})::bigint + 1)) as k from totals where total >= {CHUNK})),
best as (select set_id, "at", first(song order by score desc, song) as song from chunks group by 1, 2)
select set_id, "at", song from grid full join best using (set_id, "at")
""")
def scan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _titled(spark, folder)
    values = views.table(spark, folder, "events").select(F.col("event_id").alias("entry_id"), F.col("value").alias("score"))
    named = rows.where("kind <> 'error'").join(values, "entry_id")
    chunks = named.select("set_id", (F.floor(F.col("at") / CHUNK) * CHUNK).alias("at"), F.col("kind").alias("song"), "score")
    return hints.fill_chunks(chunks, rows.groupBy("set_id").agg(F.max("at").alias("total")), length=CHUNK)


@query(f"""with {RECORDS},
spread as (
  select *, case when position % 2 = 0 then 'system' else 'app' end as source from records
  union all select *, 'all' from records),
codes as (select user_id, source, isrc, min(label) as song from spread where isrc is not null group by 1, 2, 3),
linked as (select user_id, source, label, min(song) as song from spread join codes using (user_id, source, isrc) group by 1, 2, 3),
songs as (select s.user_id, s.source, coalesce(l.song, s.label) as song from spread s left join linked l using (user_id, source, label))
select user_id, source, count(distinct song) as songs, count(*) as plays from songs group by 1, 2
""")
def history_union(spark: SparkSession, folder: str) -> DataFrame:
    rows = records(spark, folder)
    parts = {
        "system": rows.where("position % 2 = 0"),
        "app": rows.where("position % 2 = 1").drop("isrc"),  # the older app keeps no code
    }
    return history.source_songs(history.union_histories(parts))
