"""Listings and heard plays laid over one another, and songs under several spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, songs
from ..operators.scan import Scan, scan
from . import views
from .registry import query

#: Seconds between a listed and a heard play of one song.
REACH = 432000.0
ARTISTS = ["Ana Lima", "Bo Carter", "Stif Mayer", "Dunya", "Robert Glasper", "Mira Sol", "Kito Jay"]


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A user's even windows as listed entries, the odd ones as heard plays, numbered in time."""
    rows = views.probes(spark, folder).where(F.col("song").isNotNull()).select("set_id", "probe_id", "at", "song")
    found = []
    for odd, name in ((0, "entry"), (1, "play")):
        half = rows.where(F.col("probe_id") % 2 == odd)
        found.append(scan(half, ["set_id"], ["at", "probe_id"], F.floor(F.col("at") / 3600), [Scan(name, "number")]))
    return found[0], found[1]


@query("""
with rows as (
  select user_id as set_id, event_id as probe_id, epoch_us(ts - timestamp '2024-01-01') / 1e6 as "at", event_type as song
  from events where event_type <> 'error'),
entries as (select *, row_number() over (partition by set_id order by "at", probe_id) as entry from rows where probe_id % 2 = 0),
plays as (select *, row_number() over (partition by set_id order by "at", probe_id) as play from rows where probe_id % 2 = 1),
pairs as (
  select e.set_id, e.entry, p.play,
         (case when e.probe_id % 3 = p.probe_id % 3 then 100 else 60 end)::bigint * 1000000000
           - round(least(abs(e."at" - p."at"), 600) / 60 * 1000)::bigint as worth
  from entries e join plays p on e.set_id = p.set_id and e.song = p.song and abs(e."at" - p."at") <= 432000),
sizes as (select e.set_id, max(entry) as n, (select count(*) from plays p where p.set_id = e.set_id) as m from entries e group by e.set_id),
grid as (
  select s.set_id, s.entry, list(worth order by s.play) as w
  from (select set_id, unnest(range(1, n + 1)) as entry, m from sizes where m > 0) g,
       lateral (select g.set_id, g.entry, unnest(range(1, g.m + 1)) as play) s
  left join pairs p on p.set_id = s.set_id and p.entry = s.entry and p.play = s.play
  group by s.set_id, s.entry),
steps as (
  with recursive best(set_id, entry, top) as (
    select set_id, 0::bigint, list_transform(range(m), lambda x: 0::bigint) from sizes where m > 0
    union all
    select b.set_id, b.entry + 1,
           list_transform(range(1, len(b.top) + 1), lambda j:
             list_max(list_transform(range(1, j + 1), lambda i:
               greatest(b.top[i], case when i > 1 then b.top[i - 1] else 0 end + g.w[i]))))
    from best b join grid g on g.set_id = b.set_id and g.entry = b.entry + 1)
  select * from best),
ends as (select steps.set_id, top[len(top)] as worth from steps join sizes using (set_id) where steps.entry = n)
select set_id, ((worth + 500000000) // 1000000000)::bigint as score,
       (worth - ((worth + 500000000) // 1000000000) * 1000000000)::bigint as tie, true as in_order
from ends where worth > 0
""")
def listing_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Per set: how much of its listing was heard in the listed order, and that nothing is used twice or out of order."""
    entries, plays = _halves(spark, folder)
    same = F.col("probe_id") % 3 == F.col("heard_probe_id") % 3
    pairs = alignment.listed_pairs(entries, plays, F.when(same, 100).otherwise(60), same=["song"], reach=REACH)
    kept = alignment.align(pairs)
    kept = scan(kept, ["set_id"], ["entry", "play"], F.floor(F.col("entry") / alignment.ENTRIES), [Scan("_last", "lag", F.struct("entry", "play"))])
    rising = F.coalesce((F.col("_last.entry") < F.col("entry")) & (F.col("_last.play") < F.col("play")), F.lit(True))
    return kept.groupBy("set_id").agg(
        F.sum("score").alias("score"), F.sum("tie").alias("tie"), F.bool_and(rising).alias("in_order")
    )


def spelled_labels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parts as labels in five spellings, and the distinct labels they stand for."""
    part = views.table(spark, folder, "part").select("p_partkey", "p_name")
    artist = F.element_at(F.array(*(F.lit(a) for a in ARTISTS)), (F.col("p_partkey") % len(ARTISTS) + 1).cast("int"))
    named = part.withColumn("artist", artist)
    turn = F.col("p_partkey") % 5

    def told(a: Column, b: Column, c: Column, d: Column, e: Column) -> Column:
        return F.when(turn == 0, a).when(turn == 1, b).when(turn == 2, c).when(turn == 3, d).otherwise(e)

    name = F.col("p_name")
    doubled = F.concat(F.substring(name, 1, 3), F.substring(name, 3, 1000))
    left = named.select(
        F.col("p_partkey").alias("id"),
        told(F.col("artist"), F.col("artist"), F.lit("Various"), F.concat("artist", F.lit(" Trio")), F.col("artist")).alias("artist"),
        told(name, doubled, F.concat_ws(" ", name, "artist"), name, F.concat(name, F.lit(" (Club Mix) [Mixed]"))).alias("title"),
        F.lit("").alias("version"),
    )
    right = named.groupBy("artist", F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("id"))
    return left, right.withColumn("version", F.lit(""))


@query("""
with named as (
  select p_partkey, lower(p_name) as title,
         lower((['Ana Lima', 'Bo Carter', 'Stif Mayer', 'Dunya', 'Robert Glasper', 'Mira Sol', 'Kito Jay'])[(p_partkey % 7 + 1)::int]) as artist,
         p_partkey % 5 as turn
  from part),
l as (
  select p_partkey as left_id, turn, title as name,
         case turn when 2 then 'various' when 3 then artist || ' trio' else artist end as artist,
         case turn when 1 then title[1:3] || title[3:] when 2 then title || ' ' || artist else title end as title
  from named),
r as (select artist, title, min(p_partkey) as right_id from named group by artist, title),
met as (
  select left_id, right_id,
         -- A name of two words or more that starts the other is the same; a single word is not.
         case when l.title = r.title and l.artist = r.artist then 1.0
              when l.title = r.title and shared then 0.9
              when l.title = r.title || ' ' || r.artist then 0.8
              when shared and turn <> 2 and (l.name = r.title or l.name = 'c' || r.title or r.title = 'c' || l.name) then 0.7 end as likeness
  from l join (select * from r) r on true,
       lateral (select l.artist = r.artist or (contains(r.artist, ' ') and l.artist = r.artist || ' trio') as shared) s)
select left_id, right_id, likeness::double as likeness from met where likeness is not null
""")
def same_songs(spark: SparkSession, folder: str) -> DataFrame:
    left, right = spelled_labels(spark, folder)
    return songs.same_songs(left, right, least=songs.CLOSE)
