"""Recognition time lines over the events table. Thresholds are scaled to its pace (hours)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as tl
from . import views
from .registry import query

STRIDE = 21600.0
WINDOW = 21600.0
BRIDGE = 86400.0
GAP = 43200.0
MONTH = 2678400.0
DAY = 86400.0

PROBES = """
probes as (
  select user_id as set_id, event_id as probe_id,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1e6 as "at",
    case when event_type <> 'error' then event_type end as song,
    case when event_type = 'error' then 'error' end as error,
    'p' || (event_id % 2) as provider,
    case when event_type <> 'error' and event_id % 3 <> 0 then value end as song_offset
  from events)
"""
WINDOWS = PROBES + f""",
gridded as (
  select *, floor(("at" - origin) / {STRIDE} + 1e-6) as slot from (
    select *, min("at") over (partition by set_id) as origin from probes)),
windows as (
  select *, not bool_or(error is null and on_grid) over w or on_grid as counts,
    bool_and(error is not null) over w as slot_failed
  from (select *, abs("at" - origin - slot * {STRIDE}) < 0.5 as on_grid from gridded)
  window w as (partition by set_id, slot))
"""
RUNS = WINDOWS + f""",
slots as (
  select *, row_number() over (partition by set_id order by slot_at) as ord,
    sum(failed) over (partition by set_id order by slot_at) as failed_sum
  from (select set_id, slot, min("at") as slot_at, max(case when slot_failed then 1 else 0 end) as failed
    from windows group by 1, 2)),
linked as (
  select w.*, s.slot_at, s.ord, s.failed_sum,
    lag(s.slot_at) over g as prev_at, lag(s.ord) over g as prev_ord, lag(s.failed_sum) over g as prev_failed
  from windows w join slots s using (set_id, slot) where w.song is not null
  window g as (partition by w.set_id, w.song order by w."at", w.probe_id)),
runs as (
  select *, sum(case when slot_at - prev_at <= {BRIDGE}
      and greatest(ord - prev_ord - 1, round((slot_at - prev_at) / {STRIDE}) - 1) - (failed_sum - prev_failed) <= 2
    then 0 else 1 end) over (partition by set_id, song order by "at", probe_id) as run
  from linked)
"""
SEGMENTS = RUNS + f""",
segments as (
  select set_id, song, run, min("at") as start, max("at" + {WINDOW}) as "end",
    greatest(count(distinct case when counts then slot end), 1) as hits
  from runs group by 1, 2, 3)
"""
STRENGTH = "case when hits >= 3 then 'strong' when hits = 2 then 'medium' else 'weak' end"


def runs_of(spark: SparkSession, folder: str) -> DataFrame:
    return tl.heard_runs(
        views.probes(spark, folder), stride=STRIDE, bridge_seconds=BRIDGE, size=DAY
    )


def segments_of(spark: SparkSession, folder: str) -> DataFrame:
    return tl.heard_segments(runs_of(spark, folder), window=WINDOW)


@query(f"""with {WINDOWS} select set_id, probe_id, slot::bigint as slot, on_grid, counts, slot_failed from windows""")
def probe_slots(spark: SparkSession, folder: str) -> DataFrame:
    return tl.probe_windows(views.probes(spark, folder), stride=STRIDE, size=DAY).select(
        "set_id", "probe_id", F.col("slot").cast("long").alias("slot"), "on_grid", "counts", "slot_failed"
    )


@query(f"""with {PROBES}, t as (select distinct set_id, "at" from probes),
  s as (select set_id, "at", "at" - lag("at") over (partition by set_id order by "at") as step from t)
  select set_id, min("at") as origin, round(median(step), 6) as step from s group by 1""")
def set_strides(spark: SparkSession, folder: str) -> DataFrame:
    rows = tl.set_strides(views.probes(spark, folder), size=DAY)
    return rows.select("set_id", "origin", F.round("step", 6).alias("step"))


@query(f"""with {RUNS} select set_id, song, probe_id, run::bigint as run from runs""")
def heard_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_of(spark, folder).select("set_id", "song", "probe_id", F.col("run").cast("long").alias("run"))


@query(f"""with {SEGMENTS} select set_id, song, start, "end", hits::bigint as hits, {STRENGTH} as strength
  from segments""")
def heard_segments_exact(spark: SparkSession, folder: str) -> DataFrame:
    return segments_of(spark, folder).select("set_id", "song", "start", "end", F.col("hits").cast("long").alias("hits"), "strength")


@query(f"""with {SEGMENTS}, solid as (
  select *, {STRENGTH} as strength, sum(case when hits >= 2 then 1 else 0 end)
    over (partition by set_id order by start, song) as solid from segments),
  chained as (select *, max("end") over (partition by set_id, song order by start
      rows between unbounded preceding and 1 preceding) as prev_end,
    lag(solid) over (partition by set_id, song order by start) as prev_solid from solid),
  plays as (select *, sum(case when start - prev_end <= {BRIDGE}
      and solid - (case when hits >= 2 then 1 else 0 end) - prev_solid <= 0 then 0 else 1 end)
    over (partition by set_id, song order by start) as play from chained)
  select set_id, song, play::bigint as play, min(start) as start, max("end") as "end", count(*) as segments
  from plays group by 1, 2, 3""")
def folded_plays(spark: SparkSession, folder: str) -> DataFrame:
    rows = tl.fold_segments(segments_of(spark, folder), fold=BRIDGE, size=DAY)
    return rows.groupBy("set_id", "song", F.col("play").cast("long").alias("play")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("segments")
    )


@query(f"""with {RUNS}, o as (select *, round("at" - song_offset, 6) as s from runs where song_offset is not null),
  m as (select *, row_number() over g as n, count(*) over (partition by set_id, song, run, provider) as total
    from o window g as (partition by set_id, song, run, provider order by s, "at")),
  mid as (select set_id, song, run, provider, s as middle from m where n = floor((total + 1) / 2) and total > 1),
  j as (select r.set_id, r.song, r.run, case when r.song_offset is null or mid.middle is null then true
      else abs(round(r."at" - r.song_offset, 6) - mid.middle) <= 7200 end as fits
    from runs r left join mid using (set_id, song, run, provider))
  select set_id, song, run::bigint as run, count(*) filter (where fits) as fits,
    count(*) filter (where not fits) as off from j group by 1, 2, 3""")
def offset_consistency(spark: SparkSession, folder: str) -> DataFrame:
    rows = tl.check_offsets(runs_of(spark, folder), slack=7200.0)
    return rows.groupBy("set_id", "song", F.col("run").cast("long").alias("run")).agg(
        F.count_if("consistent").alias("fits"), F.count_if(~F.col("consistent")).alias("off")
    )


SPANS = PROBES + f""",
spans as (select distinct set_id, "at" as start, least("at" + {WINDOW}, {MONTH}) as "end" from probes where song is not null),
edged as (select *, greatest(coalesce(max("end") over (partition by set_id order by start, "end"
    rows between unbounded preceding and 1 preceding), 0), 0) as edge from spans)
"""


def month(spark: SparkSession, folder: str) -> DataFrame:
    return (
        views.table(spark, folder, "events")
        .select(F.col("user_id").alias("set_id"))
        .distinct()
        .withColumn("duration", F.lit(MONTH))
    )


def coverage(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    spans = views.probes(spark, folder).where(F.col("song").isNotNull()).select(
        "set_id", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end")
    )
    return tl.coverage_gaps(spans, month(spark, folder), gap=GAP, size=DAY)


@query(f"""with {SPANS}, last as (select set_id, max("end") as last from spans group by 1),
  gaps as (select set_id, edge as start, start as "end" from edged where start - edge >= {GAP}
    union all select u.set_id, greatest(coalesce(last, 0), 0), {MONTH} from (select distinct set_id from probes) u
      left join last using (set_id) where {MONTH} - greatest(coalesce(last, 0), 0) >= {GAP})
  select * from gaps""")
def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(spark, folder)[1]


@query(f"""with {SPANS} select set_id, round(sum(greatest("end" - greatest(start, edge), 0)), 1) as seconds_heard
  from edged group by 1""")
def coverage_seconds(spark: SparkSession, folder: str) -> DataFrame:
    return coverage(spark, folder)[0]


@query(f"""with {PROBES}, times as (
  select set_id, "at", max(song) as song from probes where error is null group by 1, 2),
  pairs as (select *, lead("at") over w as next_at, lead(song) over w as next_song from times
    window w as (partition by set_id order by "at")),
  points as (select set_id, ("at" + next_at) / 2 as "at" from pairs
    where next_at is not null and song is distinct from next_song and (next_at - "at") / 2 >= 3600),
  numbered as (select *, row_number() over (partition by set_id order by "at") - 1 as i,
    count(*) over (partition by set_id) as n from points),
  budgets as (select set_id, floor(count(*) * 0.25)::bigint as b from times group by 1)
  select set_id, "at" from numbered join budgets using (set_id)
  where b > 0 and (n <= b or i in (select unnest(list_transform(range(b), lambda k: (2 * k + 1) * n // (2 * b)))))""")
def refine_points(spark: SparkSession, folder: str) -> DataFrame:
    return tl.refine_points(views.probes(spark, folder), min_spacing=3600.0, share=0.25, size=DAY)


@query(f"""with {PROBES}, tries as (select set_id, round("at", 3) as t, bool_and(error is not null) as failed
  from probes group by 1, 2)
  select set_id, count(*) filter (where failed) as failed, count(*) as windows,
    count(*) filter (where failed) > 0.2 * count(*) as failing from tries group by 1""")
def failed_share(spark: SparkSession, folder: str) -> DataFrame:
    return tl.failed_windows(views.probes(spark, folder), share=0.2).drop("last_error")


@query(f"""with {SEGMENTS}, tries as (select set_id, round("at", 3) as t, bool_and(error is not null) as failed,
    count(*) filter (where song is not null) as matched from probes group by 1, 2),
  songs as (select set_id, count(*) as songs from segments where hits > 1 group by 1)
  select set_id, 'audio' as source, count(*) as windows, sum(matched)::bigint as matched,
    count(*) filter (where failed) as errors, coalesce(max(songs), 0) as songs
  from tries left join songs using (set_id) group by 1""")
def source_report(spark: SparkSession, folder: str) -> DataFrame:
    return tl.source_report(views.probes(spark, folder), segments_of(spark, folder))


@query(f"""select o_orderkey as set_id, unnest(list_transform(range(
    greatest(floor((duration - 12 - 9) / 30)::bigint + 1, 0)), lambda k: k * 30.0 + 9.0))::double as "at"
  from (select *, o_totalprice / 1000 as duration from orders)""")
def placements(spark: SparkSession, folder: str) -> DataFrame:
    sets = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("set_id"), (F.col("o_totalprice") / 1000).alias("duration")
    )
    return tl.placements(sets)


ENTRIES = """entries as (
  select l_orderkey as set_id, row_number() over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as position,
    l_partkey % 2 = 0 as timed, l_partkey % 4 = 0 as heard from lineitem),
 timed as (select *, case when timed then position * 100.0 end as time,
    case when timed then position * 100.0 + case when heard then 40 else 0 end end as edge from entries)"""


@query(f"""with {ENTRIES},
  n as (select *, last_value(case when timed then position end ignore nulls) over b as lp,
    last_value(case when timed then edge end ignore nulls) over b as le,
    last_value(case when timed then heard end ignore nulls) over b as lh,
    first_value(case when timed then position end ignore nulls) over a as rp,
    first_value(case when timed then time end ignore nulls) over a as rt,
    min(position) over (partition by set_id) as lo, max(position) over (partition by set_id) as hi
   from timed
   window b as (partition by set_id order by position rows between unbounded preceding and 1 preceding),
    a as (partition by set_id order by position rows between 1 following and unbounded following)),
  v as (select *, coalesce(le, 0) as low, coalesce(rt, 2000.0) as high, coalesce(lp, lo - 1) as bp,
    coalesce(rp, hi + 1) as ap from n)
  select set_id, position, not timed as approx, round(coalesce(time, case when high <= low then low
    when lp is null or lh then low + (position - bp - 1) * (high - low) / (ap - bp - 1)
    else low + (position - bp) * (high - low) / (ap - bp) end), 0)::double as time from v""")
def interpolate_times(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.scan import Scan, scan

    line = views.table(spark, folder, "lineitem").select("l_orderkey", *views.LINE_ORDER)
    rows = scan(
        line, ["l_orderkey"], views.LINE_ORDER, F.struct("l_linenumber", F.floor(F.col("l_partkey") / 1000)), [Scan("position", "number")]
    )
    timed, heard = F.col("l_partkey") % 2 == 0, F.col("l_partkey") % 4 == 0
    time = F.when(timed, F.col("position") * 100.0)
    entries = rows.select(
        F.col("l_orderkey").alias("set_id"),
        F.col("position").cast("long").alias("position"),
        time.alias("time"),
        (time + F.when(heard, 40).otherwise(0)).alias("edge"),
        heard.alias("heard"),
    )
    durations = entries.select("set_id").distinct().withColumn("duration", F.lit(2000.0))
    found = tl.interpolate_times(entries, durations)
    return found.select("set_id", "position", "approx", F.round("time", 0).alias("time"))


@query(f"""with {PROBES}, named as (select set_id, "at", probe_id, song from probes where song is not null),
  ends as (select *, coalesce(lead("at") over (partition by set_id order by "at", probe_id), {MONTH}) as e from named)
  select set_id, count(*) as tracks, round(median(e - "at"), 3) as pace from ends where e > "at" group by 1 having count(*) >= 3""")
def set_pace(spark: SparkSession, folder: str) -> DataFrame:
    tracks = views.probes(spark, folder).where(F.col("song").isNotNull()).select(
        "set_id", F.col("at").alias("start"), F.col("probe_id").alias("position"), F.lit("named").alias("kind")
    )
    timed = tl.end_times(tracks, month(spark, folder), size=DAY)
    counts = timed.where(F.col("end") > F.col("start")).groupBy("set_id").agg(F.count(F.lit(1)).alias("tracks"))
    pace = tl.set_pace(timed).where(F.col("pace").isNotNull())
    return pace.join(counts, "set_id").select("set_id", "tracks", F.round("pace", 3).alias("pace"))
