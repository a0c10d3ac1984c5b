"""Pasted track lists, one track per line, as list items; lines left out keep their reason.

All patterns are column expressions. What a list as a whole decides (numbered or not, numbers in
sequence, where tracks start) comes from aggregates over its lines, joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import clock
from ..functions.labels import label
from ..functions.steps import bind
from ..functions.text import safe_text
from .scan import LIGHT_ROWS, Hot, Scan, hot_groups, scan

# Line patterns and words.
SEPARATOR = r"(?U)\s+[-–—]\s+"
NUMBERING = r"(?U)^\s*(?:[-*•·]\s*|\d{1,3}\s*[.)]\s*|#\d{1,3}\s+)"
TIMESTAMP = r"(?U)^\s*[\[(]?\s*(\d{1,2}(?::\d{2}){1,2})\s*[\])]?\s*[-–—]?\s*"
TRAILING_TIMESTAMP = (
    r"(?U)\s*(?:@\s*(\d{1,2}(?::\d{2}){1,2})"
    r"|\(\s*(\d{1,2}(?::\d{2}){1,2})\s*\)"
    r"|\[\s*(\d{1,2}(?::\d{2}){1,2})\s*\])\s*$"
)
TRAILING_LABEL = r"(?U)\s*\[([^\]]*)\]\s*$"
VERSION_WORDS = (
    r"(?iU)\b(?:mix|edit|remix|dub|version|vip|rework|bootleg|instrumental|remaster(?:ed)?|live"
    r"|edition|intro|outro|rmx|refix)\b"
)
FEATURING_LABEL = r"(?iU)^\s*(?:feat\b|ft\b|featuring\b)"
UNKNOWN = r"(?i)^(?:id|\?+|unknown|unreleased id|tba)$"
PLAYED_WITH = r"(?i)^\s*w/\s*"
NUMBER_ONLY = r"^\s*\d{1,3}[.)]?\s*$"
BARE_NUMBER = r"(?U)^\d{1,3}\s+(?=\S)"
LEADING_DIGITS = r"^\s*#?(\d{1,3})"
CUT_OFF = r"(?i)^\s*(?:save|show|load|view|see|unlock)\s+(\d{1,4})\s+more(?:\s+tracks?)?\b"
LIST_LABEL = r"(?i)^(?:full\s+)?(?:track\s*list|set\s*list|tracks)\s*:?$"
LEADING_NUMBER = r"(?U)^\s*\d{1,3}(?:\s*[-.)_]\s*|\s+)(?=\S)"
HEADING = "looks like a heading"
RICH_TEXT = "rich-text formatting"
NO_SEPARATOR = "no “Artist - Title” separator"


def cut_once(text: Column, pattern: str) -> Column:
    """The text without one match at its start."""
    return F.regexp_replace(text, pattern, "")


def _with_totals(rows: DataFrame, hot: Hot, **totals: Column) -> DataFrame:
    """``rows`` with aggregates over their list: windows, so that lines are read once, while no list is large."""
    if hot.frame is None and not hot.every:
        whole = Window.partitionBy("list_id")
        return rows.withColumns({name: value.over(whole) for name, value in totals.items()})
    return rows.join(rows.groupBy("list_id").agg(*(value.alias(name) for name, value in totals.items())), "list_id")


def _with_sequence(rows: DataFrame, hot: Hot) -> DataFrame:
    """``rows`` with ``in_sequence``: the leading numbers of their list start low and go up in small steps."""
    step = F.col("number") - F.col("before")
    if hot.frame is None and not hot.every:
        order = Window.partitionBy("list_id").orderBy("line_no")
        before = F.last("number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        steady = F.when(F.col("number").isNotNull(), F.col("before").isNull() | step.between(1, 3))
        first = F.min(F.when(F.col("number").isNotNull(), F.struct("line_no", "number")))
        rows = rows.withColumn("before", before).withColumn("_steady", steady)
        rows = _with_totals(rows, hot, _numbers=F.count("number"), _low=first, _all_steady=F.bool_and("_steady"))
        found = (F.col("_numbers") >= 2) & (F.col("_low.number") <= 3) & F.col("_all_steady")
        return rows.withColumn("in_sequence", found).drop("before", "_steady", "_numbers", "_low", "_all_steady")
    numbers = scan(
        rows.where(F.col("number").isNotNull()).select("list_id", "line_no", "number"),
        ["list_id"],
        ["line_no"],
        F.floor(F.col("line_no") / 10_000),
        [Scan("before", "lag", F.col("number"))],
        hot=hot,
    )
    sequence = numbers.groupBy("list_id").agg(
        (
            (F.count(F.lit(1)) >= 2)
            & (F.min_by("number", "line_no") <= 3)
            & F.bool_and(F.col("before").isNull() | step.between(1, 3))
        ).alias("in_sequence")
    )
    return rows.join(sequence, "list_id", "left")


def parse_tracklists(
    lines: DataFrame, source_url: Column | None = None, *, light_rows: int | None = LIGHT_ROWS, hot: Hot | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, skipped lines, tracks a copied page hid) of lines[list_id, line_no, line]."""
    hot = hot or hot_groups(lines, ["list_id"], light_rows)
    rows = bind(lines.select("list_id", "line_no", "line"), raw=F.trim(safe_text("line")))
    rows = bind(rows, text=F.trim(cut_once(F.col("raw"), PLAYED_WITH)))
    used = (
        (F.col("text") != "")
        & ~F.col("text").startswith("#")
        & ~F.col("text").startswith("//")
        & ~F.col("text").rlike(NUMBER_ONLY)
        & ~F.col("text").rlike(LIST_LABEL)
    )
    hidden = (
        bind(rows, n=F.regexp_extract("text", CUT_OFF, 1).try_cast("long"))
        .groupBy("list_id")
        .agg(F.max("n").alias("hidden_tracks"))
        .where(F.col("hidden_tracks").isNotNull())
    )
    rows = bind(rows.where(used), body=cut_once(F.col("text"), NUMBERING))
    rows = bind(rows, numbered=F.col("body") != F.col("text"))
    lead = F.when(F.col("numbered") | F.col("text").rlike(BARE_NUMBER), F.regexp_extract("text", LEADING_DIGITS, 1))
    at = F.nullif(F.regexp_extract("body", TIMESTAMP, 1), F.lit(""))
    rows = bind(rows, number=lead.try_cast("int"), lead_time=at)
    rest = F.when(F.col("lead_time").isNotNull(), cut_once(F.col("body"), TIMESTAMP)).otherwise(F.col("body"))
    rows = bind(rows, body=F.trim(cut_once(rest, NUMBERING)), marked=F.col("numbered") | F.col("lead_time").isNotNull())
    tail = F.coalesce(*(F.nullif(F.regexp_extract("body", TRAILING_TIMESTAMP, i), F.lit("")) for i in (1, 2, 3)))
    rows = bind(rows, tail_time=tail, head=F.trim(F.regexp_replace("body", TRAILING_TIMESTAMP, "")))
    timed_tail = F.col("tail_time").isNotNull() & (F.col("head") != "")
    rows = bind(
        rows,
        time=F.coalesce("lead_time", F.when(timed_tail, F.col("tail_time"))),
        body=F.when(timed_tail, F.col("head")).otherwise(F.col("body")),
    )
    rows = bind(rows, bare=~F.col("marked") & F.col("body").rlike(BARE_NUMBER))
    rows = rows.select("list_id", "line_no", "raw", "body", "time", "marked", "bare", "number")

    rows = _with_sequence(rows, hot)
    turned = F.coalesce("in_sequence", F.lit(False)) & F.col("bare")
    rows = bind(
        rows,
        body=F.when(turned, cut_once(F.col("body"), BARE_NUMBER)).otherwise(F.col("body")),
        marked=F.col("marked") | turned,
    )
    rows = _with_totals(
        rows,
        hot,
        _lines=F.count(F.lit(1)),
        _marked=F.count_if("marked"),
        _first_marked=F.min(F.when(F.col("marked"), F.col("line_no"))),
        _first=F.min("line_no"),
    )
    numbered = (F.col("_marked") >= 2) & (F.col("_marked") * 2 >= F.col("_lines"))
    started = F.coalesce(F.col("line_no") >= F.col("_first_marked"), F.lit(False))
    parts = F.split("body", SEPARATOR, 2)
    rows = bind(
        rows,
        artist=F.trim(F.get(parts, F.lit(0))),
        title=F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))),
        _numbered=numbered,
        _started=started,
    )
    pair = (F.col("artist") != "") & (F.col("title") != "")
    alone = F.col("body").rlike(UNKNOWN)
    kind = (
        F.when((F.col("body") == "") & F.col("time").isNotNull(), "time")
        .when(F.col("_numbered") & ~F.col("_started"), "heading")
        .when(pair | alone, "item")
        .when((F.col("line_no") == F.col("_first")) & ~F.col("_numbered"), "heading")
        .otherwise("bare")
    )
    rows = bind(rows, role=kind, title=F.when(pair, F.col("title")).otherwise(F.col("body")), artist=F.when(pair, F.col("artist")).otherwise(F.col("body")))
    # A time on a line of its own belongs to the next item.
    marks = F.when(F.col("role").isin("time", "item"), F.struct("role", "time"))
    rows = scan(
        rows,
        ["list_id"],
        ["line_no"],
        F.floor(F.col("line_no") / 10_000),
        [
            Scan("_before", "last_before", marks),
            Scan("position", "sum", F.when(F.col("role") == "item", 1).otherwise(0)),
        ],
        hot=hot,
    )
    pending = F.when(F.col("_before.role") == "time", F.col("_before.time"))
    tag = F.regexp_extract("title", TRAILING_LABEL, 1)
    record_label = F.col("title").rlike(TRAILING_LABEL) & ~tag.rlike(VERSION_WORDS) & ~tag.rlike(FEATURING_LABEL)
    shorter = F.trim(F.regexp_replace("title", TRAILING_LABEL, ""))
    title = F.when(record_label & (shorter != ""), shorter).otherwise(F.col("title"))
    items = bind(
        rows.where(F.col("role") == "item"), time=F.coalesce("time", pending), title=title
    )
    unknown = F.col("artist").rlike(UNKNOWN) | F.col("title").rlike(UNKNOWN)
    items = items.select(
        "list_id",
        F.col("position").cast("long").alias("position"),
        "line_no",
        F.when(unknown, "unknown").otherwise("named").alias("kind"),
        F.when(~unknown, F.col("artist")).alias("artist"),
        F.when(~unknown, F.col("title")).alias("title"),
        F.when(unknown, F.col("body")).alias("label"),
        F.col("time").alias("timestamp"),
        (F.lit(None).cast("string") if source_url is None else F.when(unknown, source_url)).alias("source_url"),
    )
    rich = F.col("raw").startswith("{\\")
    reason = F.when(F.col("role") == "bare", NO_SEPARATOR).when(rich, RICH_TEXT).otherwise(HEADING)
    skipped = rows.where(F.col("role").isin("heading", "bare")).select(
        "list_id", "line_no", F.col("raw").alias("text"), reason.alias("reason")
    )
    return items, skipped, hidden


def text_lines(texts: DataFrame, list_id: str, text: str) -> DataFrame:
    """Whole texts as numbered lines."""
    return texts.select(
        F.col(list_id).alias("list_id"), F.posexplode(F.split(text, r"\R")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no") + 1)


def tracklist_lines(tracks: DataFrame, *, numbered: bool = False) -> DataFrame:
    """Tracks as "[mm:ss] Artist - Title (Version)" lines. tracks[list_id, position, kind, artist,
    title, version, start]."""
    name = F.when(F.col("kind") == "named", label("artist", "title", "version")).otherwise("ID - ID")
    time = F.when(F.col("start").isNotNull(), F.concat(F.lit("["), clock("start"), F.lit("] "))).otherwise("")
    number = F.concat(F.col("position").cast("string"), F.lit(". ")) if numbered else F.lit("")
    return tracks.select("list_id", F.col("position").alias("line_no"), F.concat(number, time, name).alias("line"))


def file_name_labels(stem: Column) -> tuple[Column, Column]:
    """(artist, title) of a file name such as "03 - Artist - Title (Mix)"; empty when it has none."""
    plain = cut_once(F.trim(F.replace(stem, F.lit("_"), F.lit(" "))), LEADING_NUMBER)
    parts = F.split(plain, SEPARATOR, 2)
    artist, title = F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    good = (artist != "") & (title != "") & ~plain.rlike(r"[\x00-\x1F]")
    return F.when(good, artist).otherwise(""), F.when(good, title).otherwise("")


def listing_source(text: Column, name: Column) -> Column:
    """Which site a pasted list came from; anything else is a file."""
    low = F.lower(text)
    return (
        F.when(F.contains(low, F.lit("1001tracklists")), "1001tracklists")
        .when(F.contains(low, F.lit("mixesdb")), "mixesdb")
        .when(name.isin("description", "chapters", "comments", "1001tracklists", "mixesdb"), name)
        .otherwise("file")
    )


def listing_overlap(one: DataFrame, other: DataFrame, *, share: float = 0.8) -> DataFrame:
    """set_id -> do two listings repeat each other (80 % of the shorter one's lines)?"""

    def lines(df: DataFrame) -> DataFrame:
        text = F.lower(F.concat_ws("|", "artist", "title"))
        return df.where(F.col("kind") == "named").select("set_id", text.alias("line")).distinct()

    a, b = lines(one), lines(other)
    size = lambda df, name: df.groupBy("set_id").agg(F.count(F.lit(1)).alias(name))
    shared = size(a.join(b, ["set_id", "line"], "left_semi"), "shared")
    return (
        size(a, "n").join(size(b, "m"), "set_id").join(shared, "set_id", "left")
        .select("set_id", (F.coalesce("shared", F.lit(0)) >= share * F.least("n", "m")).alias("same_list"))
    )
