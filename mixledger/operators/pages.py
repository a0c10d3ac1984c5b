"""Track lists that a set's page publishes: chapters or description, without lines about the set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.clock import clock
from ..functions.steps import bind
from ..functions.text import accent_fold, words_of
from ..session import cut_lineage, spread
from .comments import LETTER, _seconds
from .tracklists import NUMBERING, SEPARATOR, TIMESTAMP, UNKNOWN

# Page line patterns, phrases and limits.
URL = (
    r"(?i)\b(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:com|net|org|io|ly|ee|co|fm|be|link|to)\b(?:/\S*)?"
)
HASHTAG = r"(?U)(?<!\w)#[^\W\d_]\w*"
HANDLE = r"(?U)(?<![\w@])@[\w.]+"
HEADER = r"(?i)^(?:full\s+)?(?:track\s*-?\s*list(?:ing)?|set\s*list)\s*[:\-–—]?\s*"
SOCIAL = (
    r"(?i)\b(?:instagram|insta|twitter|facebook|tiktok|youtube|soundcloud|spotify|bandcamp|apple music|"
    r"beatport|patreon|discord|twitch|bluesky|website)\b"
)
PROMO = (
    r"(?i)\b(?:subscribe|follow|out now|stream(?:ing)?|download|buy|pre-?order|pre-?save|tickets?|merch|"
    r"booking|contact|management|listen|available|copyright|all rights|support|newsletter|tour dates|"
    r"mastered|artwork|filmed|recorded|video by|directed|thanks|thank you|presented by|"
    r"in (?:partnership|association) with|powered by|sponsored by|on sale)\b|[©℗]"
)
TRAILING_TIME = r"\s*[-–—|@]?\s*[\[(]?(\d{1,2}(?::[0-5]\d){1,2})[\])]?\s*$"
JUNK_TITLE = r"(?i)^(?:intro|outro|start|end|chapter\s*\d+|untitled|break)$"
PERFORMED = (
    r"(?i)^(?:(?:recorded|filmed|streamed|broadcast)\s+(?:live\b|at\b|in\b|from\b|on\b|for\b|@)"
    r"|(?:(?:dj|live|hybrid|vinyl|b2b|closing|opening|full)\s*-?\s*)+set\b)"
)
LIVE_AT = r"(?i)^(?:recorded\s+)?live\s*(?:(?:from|at|in|on|for)\b|@)"
YEAR = r"\b(?:19|20)\d{2}\b"
DATE = (
    r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,2}(?:st|nd|rd|th)?"
    r"\s*[,/.]?\s*(?:19|20)\d{2}\b|\b\d{1,2}[./]\d{1,2}[./](?:19|20)\d{2}\b|\b(?:19|20)\d{2}-\d{2}-\d{2}\b"
)
BRACKETED = r"[\(\[][^\(\)\[\]]*[\)\]]"
X_JOIN = r"(?i)\S\s+[x×]\s+\S"
SENTENCE_MARK = r"[.!?](?:\s|$)"
ABBREVIATION = r"(?i)\b(?:feat|ft|vs|vol|pt|no|op|mr|mrs|ms|dr|st|jr|sr)\."
QUOTED = r"^[\"“”‘’'](.+)[\"“”‘’']$"
PROSE_WORDS = 30
RESTATED_WORDS = 6
FEW_SONGS = 3
#: Distinct lines up to this number (about 30 MB) are sent to every executor, so that pages stay where they lie.
SENT_LINES = 100_000
LINES = "array<struct<source:string,place:int,line:string,start:double>>"


def _one_of(words: list[str]) -> str:
    return r"(?:^| )(?:" + "|".join(words) + r")(?: |$)"


def _size(text: Column) -> Column:
    return F.size(F.split(text, " "))


def _fold(text: Column) -> Column:
    return words_of(F.regexp_replace(accent_fold(text), "['’`´]", ""))


def _lines(pages: DataFrame) -> DataFrame:
    """Chapter titles and description lines as rows: source, place, line, start, and what a page's lines share."""
    chapters = F.transform(
        "chapters",
        lambda c, i: F.struct(
            F.lit("chapters").alias("source"), i.alias("place"), c["title"].alias("line"), c["start_time"].cast("double").alias("start")
        ),
    )
    description = F.transform(
        F.split(F.coalesce("description", F.lit("")), r"\R"),
        lambda line, i: F.struct(
            F.lit("description").alias("source"), i.alias("place"), line.alias("line"), F.lit(None).cast("double").alias("start")
        ),
    )
    heading = F.regexp_replace(F.coalesce("title", F.lit("")), BRACKETED, " ")
    shared = bind(
        pages.select("set_id", "title", "uploader", "description", "chapters"),
        heading_words=_fold(heading),
        host=F.regexp_replace(_fold(F.coalesce("uploader", F.lit(""))), fixed.UPLOADER_SUFFIX, ""),
        many=F.size(F.filter("chapters", lambda c: c["title"] != "")) >= FEW_SONGS,
        _rows=F.concat(F.coalesce(chapters, F.array().cast(LINES)), description),
    )
    return shared.select("set_id", "heading_words", "host", "many", F.inline("_rows"))


def set_line_filter(pages: DataFrame) -> DataFrame:
    """Lines of pages[set_id, title, uploader, description, chapters] that can be tracks.

    Links, promotion, prose, quotes, junk chapters and lines about the set itself go. The uploader
    beside a venue counts as such a line only on a page naming fewer than three songs, or when the
    uploader is a show itself.
    """
    return _filtered(pages).select("set_id", "source", "place", "seconds", "text")


def _line_facts(lines: DataFrame) -> DataFrame:
    """What lines[chapter, line] say by themselves; lines that no page lists as a track are gone."""
    chapter = F.col("chapter")
    flat = F.trim(F.regexp_replace("line", r"(?U)\s+", " "))
    rows = bind(lines, shown=F.regexp_replace(F.when(chapter, flat).otherwise(F.regexp_replace(flat, HEADER, "")), NUMBERING, ""))
    lead = F.nullif(F.regexp_extract("shown", TIMESTAMP, 1), F.lit(""))
    tail = F.nullif(F.regexp_extract("shown", TRAILING_TIME, 1), F.lit(""))
    rows = bind(rows, _lead=lead, _tail=F.when(~chapter & lead.isNull(), tail))
    rows = bind(
        rows,
        said_at=F.when(~chapter, _seconds(F.coalesce("_lead", "_tail"))),
        body=F.when(F.col("_lead").isNotNull(), F.regexp_replace("shown", TIMESTAMP, ""))
        .when(F.col("_tail").isNotNull(), F.regexp_replace("shown", TRAILING_TIME, ""))
        .otherwise(F.col("shown")),
    )
    untimed = ~chapter & F.col("said_at").isNull()
    promo = F.col("body").rlike(URL) | F.col("body").rlike(SOCIAL) | F.col("body").rlike(PROMO) | F.col("body").rlike(HANDLE)
    rows = rows.where(~(untimed & promo))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", URL, ""), HASHTAG, ""), HANDLE, "")
    text = F.regexp_replace(F.regexp_replace(text, r"^[ \t\-–—|:•·]+|[ \t\-–—|:•·]+$", ""), NUMBERING, "")
    rows = bind(rows, text=F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
    rows = rows.where(F.col("text").rlike(LETTER) & ~F.col("text").rlike(JUNK_TITLE))
    rows = bind(rows, plain=F.trim(F.regexp_replace(F.regexp_replace("text", BRACKETED, " "), r"\s+", " ")))
    parts = F.split("plain", SEPARATOR, 2)
    rows = bind(rows, _left=F.trim(F.get(parts, F.lit(0))), _right=F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))))
    rows = bind(rows, words=_fold(F.col("plain")), title_words=_fold(F.col("_right")), left_words=_fold(F.col("_left")))
    pair = F.col("_right") != ""
    title = F.col("_right")
    rows = bind(rows, pair=pair, venue=F.col("words").rlike(_one_of(fixed.VENUES)), live=pair & title.rlike(LIVE_AT))
    about = (
        F.col("words").rlike(_one_of(fixed.SET_PHRASES))
        | (pair & (title.rlike(PERFORMED) | title.rlike(DATE)))
        | (F.col("live") & (F.col("venue") | title.rlike(YEAR) | title.rlike(X_JOIN)))
        | (pair & title.rlike(YEAR) & F.col("title_words").rlike(r"^(?:" + "|".join(fixed.VENUES) + r")(?: |$)"))
    )
    said = F.regexp_extract(F.col("_left"), QUOTED, 1)
    spoken = F.regexp_replace(said, ABBREVIATION, "")
    quote = (_size(spoken) >= 5) & spoken.rlike(SENTENCE_MARK)
    open_quote = pair & (F.length(F.regexp_replace("_left", '[^"]', "")) % 2 == 1)
    prose = (_size(F.col("plain")) > PROSE_WORDS) | quote | open_quote
    rows = rows.where(~about & ~(untimed & prose) & (chapter | F.col("said_at").isNotNull() | F.col("text").rlike(SEPARATOR)))
    song = pair & ~F.col("_left").rlike(UNKNOWN) & ~F.col("_right").rlike(UNKNOWN)
    return rows.select(
        "chapter", "line", "said_at", "text", "words", "title_words", "left_words", "pair", "venue", "live", song.alias("song")
    )


def _filtered(pages: DataFrame) -> DataFrame:
    """The lines of ``set_line_filter``, with ``many``: the page has three chapters or more.

    A line that many pages hold is read once. What a page's lines decide together comes from windows over
    the page, which came as one row, so none is larger than that.
    """
    rows = _lines(pages).withColumn("chapter", F.col("source") == "chapters")
    facts = cut_lineage(_line_facts(spread(rows.where(F.col("line").isNotNull()).select("chapter", "line").distinct())))
    if facts.count() <= SENT_LINES:
        facts = F.broadcast(facts)
    rows = rows.join(facts, ["chapter", "line"])
    rows = bind(rows, seconds=F.when(F.col("chapter"), F.col("start")).otherwise(F.col("said_at")))
    fewer = _size(F.col("words")) <= _size(F.col("heading_words"))
    short = F.when(fewer, F.col("words")).otherwise(F.col("heading_words"))
    long = F.when(fewer, F.col("heading_words")).otherwise(F.col("words"))
    restates = (_size(short) >= RESTATED_WORDS) & (F.startswith(long, short) | F.endswith(long, short))
    has_host = (F.col("host") != "") & F.contains(
        F.concat(F.lit(" "), "title_words", F.lit(" ")), F.concat(F.lit(" "), "host", F.lit(" "))
    )
    rows = rows.where(~(restates | (F.col("live") & has_host)))
    same = lambda c: (c == F.col("host")) | (F.replace(c, F.lit(" "), F.lit("")) == F.replace("host", F.lit(" "), F.lit("")))
    hosted = (F.col("host") != "") & F.col("pair") & F.col("venue") & (same(F.col("left_words")) | same(F.col("title_words")))
    rows = rows.select(
        *("set_id", "source", "place", "seconds", "text", "many", "song"),
        hosted.alias("hosted"),
        F.col("host").isin(fixed.VENUES).alias("show"),
    ).repartition("set_id")
    # In a timed description, lines without a time are the set's own credits.
    page = Window.partitionBy("set_id", "source")
    timed = F.count_if(F.col("seconds").isNotNull()).over(page)
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(page), "_timed": timed})
    timed_list = (F.col("source") == "description") & (F.col("_timed") >= 2) & (F.col("_timed") * 2 >= F.col("_n"))
    rows = rows.where(~timed_list | F.col("seconds").isNotNull())
    rows = rows.withColumn("songs", F.count_if("song").over(page))
    gone = F.col("hosted") & ((F.col("songs") < FEW_SONGS) | F.col("show"))
    return rows.where(~gone)


def published_tracklist(pages: DataFrame) -> DataFrame:
    """set_id, line_no, line: the list a page publishes. Three chapters or more win, then the
    description, then any chapters. Lines keep their order; a reader of ``parse_tracklists``."""
    page = Window.partitionBy("set_id")
    has = lambda source: F.bool_or(F.col("source") == source).over(page)
    lines = _filtered(pages).withColumns(
        {"_c": has("chapters"), "_d": has("description"), "_many": F.bool_or("many").over(page)}
    )
    chosen = F.when(F.col("_many") & F.col("_c"), "chapters").when(F.col("_d"), "description").otherwise("chapters")
    time = F.when(F.col("seconds").isNotNull(), F.concat(F.lit("["), clock("seconds"), F.lit("] "))).otherwise("")
    return lines.where(F.col("source") == chosen).select(
        "set_id", "source", F.col("place").alias("line_no"), F.concat(time, "text").alias("line"), "seconds"
    )
