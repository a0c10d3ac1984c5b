"""Slots of a set brought to rest, over the events table: a user is a set, hours are its pace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import settling
from ..operators.scan import Scan, scan
from . import views
from .registry import query

# The pace of the table: a user does something twice a day.
REACH, WEAK, FOLD, SONG, UNIFY, BIN = 43200.0, 14400.0, 86400.0, 43200.0, 86400.0, 86400.0


def parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(slots, texts, songs, durations): errors are IDs, the rest is heard, listed or both by its number."""
    rows = views.table(spark, folder, "events").select(
        F.col("user_id").alias("set_id"), F.col("event_id").alias("id"), views.seconds_since(F.col("ts")).alias("time"), "event_type",
        (F.floor("value") % 3).cast("string").alias("part"),
    )
    rows = scan(rows, ["set_id"], ["time", "id"], F.floor(F.col("time") / 3600), [Scan("slot", "number")])
    named, turn = F.col("event_type") != "error", F.col("id") % 4
    heard = named & turn.isin(0, 1)
    hits = F.col("id") % 7 + 1
    rows = rows.withColumn("slot", F.col("slot").cast("long"))
    slots = rows.select(
        "set_id", "slot", F.when(named, "named").otherwise("unknown").alias("kind"), "time", (F.col("id") % 5 == 0).alias("approx"),
        heard.alias("heard"), (~named | (turn != 0)).alias("listed"),
        F.when(heard, F.col("time") + 12).otherwise(F.col("time")).alias("edge"),
        F.when(heard, F.col("time")).alias("start"), F.when(heard, F.col("time") + 12).alias("end"), F.when(heard, hits).alias("hits"),
        F.when(heard, F.when(hits >= 3, "strong").when(hits == 2, "medium").otherwise("weak")).alias("strength"),
        (heard & (turn == 0) & (hits == 1)).alias("weak"),
    )
    own = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.floor(F.col("id") / 4) % 3 + 1).cast("int"))
    both = F.when(F.col("id") % 16 == 2, F.array(own, F.lit("d"))).otherwise(F.array(own))
    texts = rows.where(~named | (turn != 0)).select("set_id", "slot", F.explode(both).alias("source"), F.col("time").alias("seconds"))
    songs = rows.where(named).select(
        "set_id", "slot", F.lit("Various").alias("artist"), F.concat_ws(" ", "event_type", F.element_at(F.array(*map(F.lit, ("one", "two", "six"))), F.col("part").cast("int") + 1)).alias("title"),
        F.lit("").alias("version"),
    )
    return slots, texts, songs, rows.groupBy("set_id").agg((F.max("time") + 12).alias("duration"))


SLOTS_SQL = """
rows as (
  select user_id as set_id, event_id as id, epoch_us(ts - timestamp '2024-01-01') / 1e6 as t, event_type,
         row_number() over (partition by user_id order by ts, event_id) as slot,
         event_type || ' ' || (['one', 'two', 'six'])[(floor(value)::bigint % 3 + 1)::int] as title,
         event_type <> 'error' as named
  from events),
slots as (
  select set_id, slot, id, t, title, named, id % 5 = 0 as approx, named and id % 4 in (0, 1) as heard, not named or id % 4 <> 0 as listed,
         case when named and id % 4 in (0, 1) then t + 12 else t end as edge,
         id % 7 + 1 as hits, case when id % 7 + 1 >= 3 then 'strong' when id % 7 + 1 = 2 then 'medium' else 'weak' end as strength
  from rows),
texts as (
  select set_id, slot, unnest(case when id % 16 = 2 then [own, 'd'] else [own] end) as source
  from (select *, (['a', 'b', 'c'])[(id // 4 % 3 + 1)::int] as own from slots where listed)),
sets as (select set_id, max(t) + 12 as duration, max(slot) as n from slots group by set_id),
sources as (select set_id, slot, list(source order by source) as sources from texts group by all),
-- The nearest slots on both sides that a listing of this one names, by looking at every other slot.
beside as (
  select x.set_id, x.slot, max(case when y.slot < x.slot then y.slot end) as low, min(case when y.slot > x.slot then y.slot end) as high
  from texts x join texts y on x.set_id = y.set_id and x.source = y.source group by x.set_id, x.slot)
"""


@query(f"""
with {SLOTS_SQL},
ids as (select s.*, sources, coalesce(low, 0) as low, coalesce(high, n + 1) as high
  from slots s join sources using (set_id, slot) join beside using (set_id, slot) join sets using (set_id) where not named),
met as (
  select i.set_id, i.slot, x.slot as song, i.sources
  from ids i join slots x on x.set_id = i.set_id and x.named and x.listed and x.slot > i.low and x.slot < i.high
  join sources y on y.set_id = x.set_id and y.slot = x.slot
  where (i.approx or x.approx or abs(i.t - x.t) <= {REACH}) and not list_has_any(i.sources, y.sources)),
lone as (select set_id, slot, min(song) as song, any_value(sources) as sources from met group by set_id, slot having count(*) = 1)
select set_id, slot, song from lone l
where not exists (select 1 from lone e where e.set_id = l.set_id and e.song = l.song and e.slot < l.slot and list_has_any(e.sources, l.sources))
""")
def filled_ids(spark: SparkSession, folder: str) -> DataFrame:
    slots, texts, _, _ = parts(spark, folder)
    return settling.filled_ids(slots, texts, reach=REACH)


@query(f"""
with recursive {SLOTS_SQL},
unheard as (select s.*, sources, low, high from slots s join sources using (set_id, slot) join beside using (set_id, slot) where named and listed and not heard),
met as (
  select a.set_id, a.slot as one, b.slot as two,
         case when not a.approx and not b.approx then case when abs(a.t - b.t) <= {UNIFY} then a.slot end
              when coalesce(b.low <= a.slot, true) then a.slot
              when coalesce(a.high >= b.slot, true) then b.slot end as keep
  from unheard a join unheard b on a.set_id = b.set_id and a.slot < b.slot and a.title = b.title and not list_has_any(a.sources, b.sources)),
pairs as (select *, row_number() over (partition by set_id order by two, one) as n from met where keep is not null),
taken(set_id, n, used, kept) as (
  select distinct set_id, 0::bigint, []::bigint[], []::struct(slot bigint, keep bigint)[] from pairs
  union all
  select t.set_id, t.n + 1,
         case when list_has_any(t.used, [p.one, p.two]) then t.used else t.used || [p.one, p.two] end,
         case when list_has_any(t.used, [p.one, p.two]) then t.kept
              else t.kept || [{{'slot': (case when p.keep = p.one then p.two else p.one end)::bigint, 'keep': p.keep::bigint}}] end
  from taken t join pairs p on p.set_id = t.set_id and p.n = t.n + 1)
select set_id, k.slot as slot, k.keep as keep
from (select set_id, unnest(kept) as k from taken t where n = (select max(n) from pairs p where p.set_id = t.set_id))
""")
def listing_twins(spark: SparkSession, folder: str) -> DataFrame:
    slots, texts, songs, _ = parts(spark, folder)
    return settling.twins(slots, texts, songs, unify=UNIFY)


@query(f"""
with {SLOTS_SQL},
met as (
  select s.set_id, s.slot, a.slot as owner, greatest(s.t - a.t - 12, a.t - s.t - 12, 0) as far
  from slots s join slots a on a.set_id = s.set_id and a.title = s.title and s.heard and not s.listed and a.heard and a.listed)
select set_id, slot, owner from met where far <= {FOLD}
qualify row_number() over (partition by set_id, slot order by far, owner) = 1
""")
def rejoined_plays(spark: SparkSession, folder: str) -> DataFrame:
    slots, _, songs, _ = parts(spark, folder)
    return settling.rejoined(slots, songs, fold=FOLD)


@query(f"""
with {SLOTS_SQL},
weak as (select * from slots where heard and not listed and hits = 1),
tracks as (select * from slots where named and not (heard and not listed and hits = 1)),
beside_weak as (
  select w.set_id, w.slot, w.title,
         (select t.title from tracks t where t.set_id = w.set_id and t.t <= w.t order by t.t desc, t.slot desc limit 1) as before,
         (select t.title from tracks t where t.set_id = w.set_id and t.t > w.t order by t.t, t.slot limit 1) as after
  from weak w)
select set_id, slot from beside_weak where title = before or title = after
""")
def echoed_windows(spark: SparkSession, folder: str) -> DataFrame:
    slots, _, songs, _ = parts(spark, folder)
    return settling.echoes(slots, songs)


@query(f"""
with recursive {SLOTS_SQL},
steps as (select set_id, t, heard, edge, row_number() over (partition by set_id order by t, slot) as n from slots),
walk(set_id, n, edge, found, until) as (
  select set_id, 0::bigint, 0::double, null::double, null::double from sets
  union all
  select w.set_id, s.n, case when s.heard then greatest(coalesce(w.edge, 0), s.edge) end,
         case when s.t - w.edge >= {SONG} then w.edge end, s.t
  from walk w join steps s on s.set_id = w.set_id and s.n = w.n + 1),
closing as (
  select w.set_id, w.edge as time, duration as until
  from walk w join sets using (set_id) where w.n = (select max(n) from steps s where s.set_id = w.set_id) and duration - w.edge >= {SONG})
select set_id, found as time, until from walk where found is not null
union all select set_id, time, until from closing
""")
def unheard_stretches(spark: SparkSession, folder: str) -> DataFrame:
    slots, _, _, durations = parts(spark, folder)
    return settling.stretches(slots, durations, between=True, song_seconds=SONG)


def _taken(name: str, pairs: str) -> str:
    """Pairs of a set taken one by one in order; each end serves once."""
    return f"""
{name}_sorted as (select *, row_number() over (partition by set_id order by apart, rank, -hits, start, slot, heard) as n from {pairs}),
{name}_walk(set_id, n, slots, heards, kept) as (
  select distinct set_id, 0::bigint, []::bigint[], []::bigint[], []::struct(slot bigint, heard bigint)[] from {name}_sorted
  union all
  select w.set_id, p.n,
         case when list_contains(w.slots, p.slot) or list_contains(w.heards, p.heard) then w.slots else w.slots || [p.slot::bigint] end,
         case when list_contains(w.slots, p.slot) or list_contains(w.heards, p.heard) then w.heards else w.heards || [p.heard::bigint] end,
         case when list_contains(w.slots, p.slot) or list_contains(w.heards, p.heard) then w.kept
              else w.kept || [{{'slot': p.slot::bigint, 'heard': p.heard::bigint}}] end
  from {name}_walk w join {name}_sorted p on p.set_id = w.set_id and p.n = w.n + 1),
{name} as (
  select set_id, k.slot as slot, k.heard as heard
  from (select set_id, unnest(kept) as k from {name}_walk w where n = (select max(n) from {name}_sorted s where s.set_id = w.set_id)))"""


@query(f"""
with recursive {SLOTS_SQL},
placed as (
  select s.*, duration, sum(case when heard and listed then 1 else 0 end) over (partition by set_id order by slot) as gap,
         coalesce(last_value(case when listed then edge end ignore nulls)
           over (partition by set_id order by slot rows between unbounded preceding and 1 preceding), 0) as low,
         coalesce(first_value(case when listed then t end ignore nulls)
           over (partition by set_id order by slot rows between 1 following and unbounded following), duration) as high
  from slots s join sets using (set_id)),
heards as (select set_id, gap, slot as heard, t as start, hits, strength from placed where heard and not listed),
claims as (
  select i.set_id, i.gap, i.slot, i.approx, h.heard, h.start, h.hits, h.strength, abs(i.t - h.start) as apart,
         case strength when 'strong' then 1 when 'medium' then 2 else 3 end as rank,
         (h.start between i.low and i.high) or (not i.approx and abs(i.t - h.start) <= {REACH}) as sure,
         (h.start between i.low - {WEAK} and i.high + {WEAK}) or (not i.approx and abs(i.t - h.start) <= {REACH}) as loose
  from (select * exclude (hits, strength, heard) from placed where not named) i join heards h using (set_id, gap)),
solid as (select * from claims where strength <> 'weak' and sure),
held as (select distinct set_id, slot from solid where not approx and apart <= {REACH}),
fitting as (select s.* from solid s left join held h on h.set_id = s.set_id and h.slot = s.slot where h.slot is null or s.apart <= {REACH}),
{_taken("fills", "fitting")},
against as (
  select x.set_id, x.slot, h.heard, h.start, h.hits, abs(x.t - h.start) as apart, 1 as rank
  from (select * exclude (hits, strength, heard) from placed where named and listed and not heard) x join heards h using (set_id, gap)
  where h.strength = 'strong' and (x.approx or abs(x.t - h.start) <= {REACH})
    and not exists (select 1 from fills f where f.set_id = h.set_id and f.heard = h.heard)),
{_taken("rivals", "against")},
offers as (
  select h.set_id, (select c.slot from claims c where c.set_id = h.set_id and c.heard = h.heard and c.loose order by c.apart, c.slot limit 1) as slot, h.heard
  from heards h where h.strength = 'weak')
select set_id, 'fills' as part, slot, heard from fills
union all select set_id, 'rivals', slot, heard from rivals
union all select set_id, 'offers', slot, heard from offers
""")
def settled_ids(spark: SparkSession, folder: str) -> DataFrame:
    slots, _, _, durations = parts(spark, folder)
    found = settling.settled(slots, durations, reach=REACH, weak_reach=WEAK, bin=BIN)
    rows = [df.select("set_id", F.lit(name).alias("part"), "slot", "heard") for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
