"""Text pipelines over the harness tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comments, intervals, pages, tracklists, wiki
from ..operators.scan import hot_groups
from ..session import cut_lineage
from . import views
from .lists import ITEMS
from .registry import query


def written_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The harness lists written out as text lines with a time every two minutes."""
    rows = views.list_items(spark, folder).withColumn("start", (F.col("position") - 1) * 120.0)
    return tracklists.tracklist_lines(rows)


@query(f"""with {ITEMS} select list_id, position, kind,
  case when kind = 'named' then artist end as artist,
  case when kind = 'named' then case when version <> '' then title || ' (' || version || ')' else
      regexp_replace(title, ' \\[[^\\]]*\\]$', '') end end as title,
  case when (position - 1) * 2 >= 60 then ((position - 1) * 2 // 60)::varchar || ':' || lpad(((position - 1) * 2 % 60)::varchar, 2, '0') || ':00'
    else lpad(((position - 1) * 2)::varchar, 2, '0') || ':00' end as timestamp from items""")
def tracklist_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    line = views.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("list_id"))
    items, _, _ = tracklists.parse_tracklists(written_lists(spark, folder), hot=hot_groups(line, ["list_id"]))
    return items.select("list_id", "position", "kind", "artist", "title", "timestamp")


@query(r"""with l as (select doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) as line from documents),
  t as (select doc_id, trim(line) as line from l)
  select doc_id, count(*) filter (where line <> '') as lines from t group by 1""")
def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = tracklists.text_lines(views.table(spark, folder, "documents"), "doc_id", "text")
    return lines.groupBy(F.col("list_id").alias("doc_id")).agg(F.count_if(F.trim("line") != "").alias("lines"))


@query()
def tracklist_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = tracklists.text_lines(views.table(spark, folder, "documents"), "doc_id", "text")
    items, skipped, _ = tracklists.parse_tracklists(lines)
    return items.select("list_id", "line_no", F.lit("item").alias("role"), "kind").unionByName(
        skipped.select("list_id", "line_no", F.lit("skipped").alias("role"), F.col("reason").alias("kind"))
    )


def talk(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as comments, each also quoting a part of the catalog at a time."""
    turns = views.table(spark, folder, "conversations")
    part = views.table(spark, folder, "part")
    quoted = turns.join(part, F.col("p_partkey") == F.col("conv_id") * 7 + F.col("turn"), "left")
    song = F.concat_ws(" - ", "p_brand", "p_name")
    text = F.when(
        F.col("p_partkey").isNotNull(), F.concat(F.lit("12:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(" "), song, F.lit("\n"), "text")
    ).otherwise(F.col("text"))
    return quoted.select(
        F.col("conv_id").alias("set_id"),
        F.col("turn").alias("n"),
        text.alias("text"),
        F.lit(None).cast("double").alias("start_time"),
        F.length("text").alias("like_count"),
    )


@query()
def comment_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return comments.parse_comments(talk(spark, folder)).drop("text")


@query()
def comment_hints(spark: SparkSession, folder: str) -> DataFrame:
    mentions = comments.with_support(comments.parse_comments(talk(spark, folder)))
    return intervals.rank_hints(mentions)


PAGE_LINES = 500
PAGES = """numbered as (select l_orderkey, p_brand || ' - ' || p_name as text, row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as p
  from lineitem join part on p_partkey = l_partkey),
 songs as (select *, count(*) over (partition by set_id) as n from (
  select l_orderkey, l_orderkey * 1000000 + p // 500 as set_id, p % 500 + 1 as position, text from numbered))"""


def set_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as set pages of at most 500 lines: the lines as chapters and as a description with
    promotion between. A longer order becomes several pages."""
    lines = views.numbered_lines(spark, folder)
    page = F.floor((F.col("position") - 1) / PAGE_LINES)
    lines = lines.withColumns(
        {"set_id": F.col("list_id") * 1_000_000 + page, "position": (F.col("position") - 1) % PAGE_LINES + 1}
    )
    text = F.concat_ws(" - ", "artist", "title")
    start = (F.col("position") - 1) * 200.0
    rows = lines.groupBy("set_id").agg(
        F.array_sort(F.collect_list(F.struct("position", text.alias("text"), start.alias("start")))).alias("_l")
    )
    chapters = F.transform("_l", lambda x: F.struct(x["start"].alias("start_time"), x["text"].alias("title")))
    return rows.select(
        "set_id",
        F.lit("Some Channel").alias("uploader"),
        F.lit("Somebody in the park").alias("title"),
        F.concat(
            F.lit("Subscribe: https://example.com\n"),
            F.array_join(F.transform("_l", lambda x: x["text"]), "\n"),
            F.lit("\nRecorded live at the park\n#techno"),
        ).alias("description"),
        F.when(F.floor(F.col("set_id") / 1_000_000) % 2 == 0, chapters).otherwise(F.slice(chapters, 1, 1)).alias("chapters"),
    )


@query(f"""with {PAGES} select set_id, case when l_orderkey % 2 = 0 and n >= 3 then 'chapters' else 'description' end as source,
  text from songs""")
def published_tracklists(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages.published_tracklist(set_pages(spark, folder))
    return rows.select("set_id", "source", F.regexp_replace("line", r"^\[[\d:]+\] ", "").alias("text"))


def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as wiki pages with a file table, a player link and a marked-up track list."""
    rows = set_pages(spark, folder)
    line = lambda c: F.concat(
        F.lit("# ["), F.lpad(F.floor(c["start_time"] / 60).cast("string"), 3, "0"), F.lit("] '''[[Page|"), c["title"], F.lit("]]'''<ref>x</ref>")
    )
    return rows.where(F.size("chapters") > 1).select(
        F.col("set_id").alias("pageid"),
        F.concat(F.lit("2019-08-30 - Dj Number"), "set_id", F.lit(" @ Park Stage "), "set_id").alias("title"),
        F.concat(
            F.lit("== File details ==\n{|\n| 62:00\n|}\n{{Player|https://www.example.com/set/"),
            "set_id",
            F.lit("}}\n== Tracklist ==\n"),
            F.array_join(F.transform("chapters", line), "\n"),
            F.lit("\n...\n[[Category:Tracklist: complete]]"),
        ).alias("wikitext"),
    )


@query(f"""with {PAGES} select set_id as pageid, position, floor((position - 1) * 200 / 60) * 60.0 as seconds, text as label
  from songs where n > 1 and l_orderkey % 2 = 0""")
def parse_wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    return wiki.parse_wiki_pages(wiki_pages(spark, folder))[1]


@query(f"""with {PAGES} select distinct set_id, set_id as pageid, case when set_id % 8 = 0 then 'link' else 'title' end as "by",
  1.0 as score from songs where n > 1 and l_orderkey % 2 = 0""")
def match_pages(spark: SparkSession, folder: str) -> DataFrame:
    # The uploads are made of the facts, which are worked out once.
    facts = cut_lineage(wiki.parse_wiki_pages(wiki_pages(spark, folder))[0])
    uploads = facts.select(
        F.col("pageid").alias("set_id"),
        F.concat(F.lit("Number"), "pageid", F.lit(" live at Park Stage "), "pageid", F.lit(" 30.08.2019")).alias("title"),
        F.lit("Some Channel").alias("uploader"),
        F.lit(3700.0).alias("duration"),
        F.when(F.col("pageid") % 8 == 0, F.concat(F.lit("http://m.example.com/set/"), "pageid", F.lit("/?utm=1"))).alias("url"),
    )
    return wiki.match_pages(uploads, facts)
