"""Wiki pages of mixes: their track lists, lengths and links, and which upload each describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.clock import dates, same_day
from ..functions.steps import bind
from ..functions.text import accent_fold, words_of
from ..functions.urls import url_key
from ..session import cut_lineage
from .scan import Hot, Scan, scan

# Wiki markup patterns.
COMMENT = r"(?s)<!--.*?(?:-->|$)"
REF = r"(?is)<ref\b[^<>/]*/>|<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref\s*>"
TEMPLATE = r"\{\{[^{}]*\}\}"
NAMED_LINK = r"\[\[[^|\[\]]{0,300}\|([^\[\]]{0,300})\]\]"
PLAIN_LINK = r"\[\[([^|\[\]]{0,300})\]\]"
WEB_LINK = r"\[(?:https?:)?//[^\s\[\]]+(?:\s+([^\[\]]*))?\]"
TAG = r"<[^<>]{1,200}>"
LINK = r"(https?://[^\s|\[\]{}<>\"']+)"
LINK_END = r"[.,;:!)]+$"
LIST_MARK = r"^[#*]+(?![#*:;])\s*"
PLAYED_OVER = r"^\+\s+"
CUE = r"^\[\s*([\d?]{1,3}(?::[\d?]{1,2}){0,2})\s*\]\s*"
GAP = r"^(?:\.{2,}|…|-+)$"
PART = r"(?i)^(?:cd|disc|disk|part|pt\.?|side|chapter|hour|set)\s*[\w.]{0,4}\s*:?$"
TABLE_CLOCK = r"(?<![\d:])(?:(\d{1,2}):)?(\d{1,3}):([0-5]\d)(?![\d:])"
PARTS_COLUMN = r"(?i)^!\s*(?:pt|part)\b"
RADIO_SHOW = r"(?i)\{\{\s*StandardShow"
SLOT = r"(?i)\{\{\s*StandardShow(\d+)(h|min)\s*\}\}"
PLAYER = r"(?i)\{\{\s*Player\s*\|([^{}]{0,5000})\}\}"
STATUS = r"(?i)\[\[\s*Category\s*:\s*Tracklist\s*:\s*(complete|incomplete|none)\s*(?:\|[^\]]{0,300})?\]\]"
SECTION = r"^==(?!=)\s*(.*?[^=\s])\s*==+\s*$"
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—"}
MAX_NESTING = 5
# Matching thresholds and words that say nothing about which set it is.
SLACK_SECONDS = 60.0
SLACK_SHARE = 0.02
PART_SHARE = 0.9
EVENT_SHARE = 0.75
MIN_SCORE = 0.6
STRONG_SCORE = 1.0
MARGIN = 0.1
BOILERPLATE = (
    "dj djs set sets live livestream stream streamed full mix mixes mixed mixtape continuous hd hq 4k 8k uhd "
    "1080p 720p official video audio recording recorded at the in on for from with by of a an and b2b b3b x vs "
    "presents pres feat ft featuring episode ep part pt vol volume tracklist free download premiere exclusive "
    "festival stage special edition"
).split()
NAME_SPLIT = (
    r"(?i)\s*(?:,|&(?=\s)|\+|/|\bb[23]b\b|\bvs\.?(?=\s)|\band\b|\bx\b|\bfeat\.?(?=\s)|\bft\.?(?=\s)"
    r"|\bpres\.?(?=\s)|\bpresents\b)\s*"
)
LEAD_END = r"(?i)\s*(?:[|｜/@:–—(\[]|\s-\s|\b(?:live|at|for|in|dj set)\b)\s*"
PAGE_DATE = r"(?i)^(\d{4})(?:-[\dX?]{2}){0,2}\s+-\s+"
UPLOADER_SUFFIX = "(?i)" + fixed.UPLOADER_SUFFIX


def near(duration: Column, length: Column) -> Column:
    """Within a minute, or two percent of the longer set."""
    return F.abs(duration - length) <= F.greatest(F.lit(SLACK_SECONDS), SLACK_SHARE * length)


#: Text that clean-up of control characters and spaces leaves as it is.
TIDY = r"^[!-~]+(?: [!-~]+)*$"


def plain_markup(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """``rows`` with ``name``: the wiki line ``text`` without its markup.

    Each step is worked out once and looks first for the character that its pattern begins with; no step writes one
    that was not there.
    """

    def step(needs: str, *patterns: tuple[str, str]) -> Column:
        t = F.col(name)
        for pattern, instead in patterns:
            t = F.regexp_replace(t, pattern, instead)
        return F.when(F.contains(name, F.lit(needs)), t).otherwise(F.col(name))

    rows = bind(rows, **{name: text})
    rows = bind(rows, **{name: step("<", (REF, ""))})
    rows = bind(rows, **{name: step("{{", *[(TEMPLATE, "")] * MAX_NESTING)})
    rows = bind(rows, **{name: step("[[", (NAMED_LINK, "$1"))})
    rows = bind(rows, **{name: step("[[", (PLAIN_LINK, "$1"))})
    rows = bind(rows, **{name: step("//", (WEB_LINK, "$1"))})
    rows = bind(rows, **{name: step("''", ("'{2,3}", ""))})
    rows = bind(rows, **{name: step("<", (TAG, " "))})
    letters = F.col(name)
    for entity, letter in ENTITIES.items():
        letters = F.replace(letters, F.lit(entity), F.lit(letter))
    rows = bind(rows, **{name: F.when(F.contains(name, F.lit("&")), letters).otherwise(F.col(name))})
    clean = F.regexp_replace(name, r"[\p{Cc}\p{Cf}&&[^\s]]", "")
    clean = F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))
    return bind(rows, **{name: F.when(F.col(name).rlike(TIDY), F.col(name)).otherwise(clean)})


def page_lines(pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """pageid, line_no, line, section: every line, or those ``wanted``, under the top heading it belongs to.

    Headings and list tags are always kept. A page came as one row, so no window over its lines is larger than that.
    """
    text = F.regexp_replace(F.regexp_replace("wikitext", COMMENT, ""), r"(?i)(</?)list\s*>", "\n$1list>\n")
    rows = bind(pages.select("pageid", "wikitext"), _lines=F.split(text, r"\R"))
    lines = rows.select("pageid", F.posexplode("_lines").alias("line_no", "line"))
    lines = bind(lines, line=F.trim("line"))
    lines = bind(
        lines,
        _heading=F.when(F.startswith("line", F.lit("==")) & F.col("line").rlike(SECTION), F.lower(F.regexp_extract("line", SECTION, 1))),
        _list=F.when(F.col("line") == "<list>", True).when(F.col("line") == "</list>", False),
    )
    if wanted is not None:
        lines = lines.where(wanted | F.col("_heading").isNotNull() | F.col("_list").isNotNull())
    return scan(
        lines,
        ["pageid"],
        ["line_no"],
        F.floor(F.col("line_no") / 10_000),
        [
            Scan("section", "last", F.col("_heading")),
            Scan("listing", "last", F.coalesce("_list", F.when(F.col("_heading").isNotNull(), False))),
        ],
        hot=Hot(),
    )


def wiki_tracks(lines: DataFrame) -> DataFrame:
    """pageid, position, seconds, label: list items and <list> lines of track list sections.

    From the first time that goes backwards on (each CD starts again at nought) times are dropped. All of it
    comes from windows over the page in one pass, so that no line is freed of its markup twice.
    """
    rows = lines.where((F.col("section") == "tracklist") & F.col("_heading").isNull() & F.col("_list").isNull())
    marked = F.col("line").rlike(LIST_MARK)
    inside = F.coalesce("listing", F.lit(False)) & (F.col("line") != "") & ~F.col("line").rlike(r"^[=;:]")
    rows = plain_markup(rows.where(marked | inside).select("pageid", "line_no", "line"), "body", F.regexp_replace("line", LIST_MARK, ""))
    rows = bind(rows, _cue=F.regexp_extract("body", CUE, 1))
    cue = F.col("_cue")
    parts = F.transform(F.split(cue, ":"), lambda p: p.try_cast("double"))
    value = F.aggregate(F.when(F.size(parts) > 1, parts).otherwise(F.array(parts[0], F.lit(0.0))), F.lit(0.0), lambda s, p: s * 60 + p)
    rows = bind(
        rows,
        seconds=F.when((cue != "") & ~F.contains(cue, F.lit("?")), value),
        label=F.regexp_replace(F.trim(F.regexp_replace("body", CUE, "")), PLAYED_OVER, ""),
    )
    rows = rows.where((F.col("label") != "") & ~F.col("label").rlike(GAP) & ~F.col("label").rlike(PART))
    rows = scan(
        rows.select("pageid", "line_no", "seconds", "label"),
        ["pageid"],
        ["line_no"],
        F.floor(F.col("line_no") / 10_000),
        [Scan("_latest", "max_before", F.col("seconds")), Scan("position", "number")],
        hot=Hot(),
    )
    so_far = Window.partitionBy("pageid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    back = F.coalesce(F.col("seconds") < F.col("_latest"), F.lit(False))
    rows = rows.withColumn("_back", F.max(back).over(so_far))
    kept = F.when(~F.col("_back"), F.col("seconds"))
    return rows.select("pageid", F.col("position").cast("long").alias("position"), kept.alias("seconds"), "label")


#: Lines that file tables are read from.
CELLS = r"^[|!]"


def wiki_lengths(lines: DataFrame) -> DataFrame:
    """pageid -> lengths of the whole set in its file tables; a table of parts gives their total."""
    rows = lines.where(F.col("section") == "file details")
    h, m, s = (F.regexp_extract("line", TABLE_CLOCK, i).try_cast("double") for i in (1, 2, 3))
    total = F.coalesce(h, F.lit(0.0)) * 3600 + m * 60 + s
    cell = F.col("line").rlike(CELLS) & ~F.contains("line", F.lit("://")) & F.col("line").rlike(TABLE_CLOCK) & (total > 0)
    rows = rows.withColumns({"_length": F.when(cell, total), "_parts": F.col("line").rlike(PARTS_COLUMN)})
    sums = rows.groupBy("pageid").agg(
        F.bool_or("_parts").alias("parted"),
        F.count("_length").alias("n"),
        F.sum("_length").alias("sum"),
        F.max_by("_length", F.when(F.col("_length").isNotNull(), F.col("line_no"))).alias("last"),
        F.collect_list(F.when(F.col("_length").isNotNull(), F.struct("line_no", "_length"))).alias("_rows"),
    )
    every = F.array_distinct(F.transform(F.array_sort("_rows"), lambda x: x["_length"]))
    parted = F.col("parted") & (F.col("n") > 1)
    total_of_parts = F.when(near(F.col("sum") - F.col("last"), F.col("last")), F.col("last")).otherwise(F.col("sum"))
    return sums.select("pageid", F.when(parted, F.array(total_of_parts)).otherwise(every).alias("lengths"))


def parse_wiki_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts per page, tracks) of pages[pageid, title, wikitext]; whole texts are read.

    Each of the two reads the pages once and nothing is written between. The lines of file tables alone,
    with the headings, are ordered for the facts.
    """
    cells = page_lines(pages, F.col("line").rlike(CELLS))
    text = F.regexp_replace("wikitext", COMMENT, "")
    rows = bind(pages.select("pageid", "title", "wikitext"), _text=text)

    def links(of: Column) -> Column:
        return F.array_distinct(
            F.transform(F.regexp_extract_all(of, F.lit(LINK), F.lit(1)), lambda x: F.regexp_replace(x, LINK_END, ""))
        )

    bodies = F.regexp_extract_all("_text", F.lit(PLAYER), F.lit(1))
    slot = F.regexp_extract("_text", SLOT, 1).try_cast("double") * F.when(
        F.lower(F.regexp_extract("_text", SLOT, 2)) == "h", 3600.0
    ).otherwise(60.0)
    facts = rows.select(
        "pageid",
        "title",
        F.col("_text").rlike(RADIO_SHOW).alias("radio_show"),
        links(F.array_join(bodies, " ")).alias("players"),
        links(F.col("_text")).alias("links"),
        F.coalesce(F.nullif(F.lower(F.regexp_extract("_text", STATUS, 1)), F.lit("")), F.lit("unknown")).alias("tracklist"),
        slot.alias("_slot"),
    )
    facts = facts.join(wiki_lengths(cells), "pageid", "left").select(
        "pageid",
        "title",
        F.coalesce(F.get("lengths", F.lit(0)), "_slot").alias("duration_seconds"),
        F.coalesce("lengths", F.array().cast("array<double>")).alias("lengths"),
        "radio_show",
        "players",
        "links",
        "tracklist",
    )
    return facts, wiki_tracks(page_lines(pages))


def _fold(text: Column) -> Column:
    return F.split(words_of(F.regexp_replace(accent_fold(text), "['’`´]", "")), " ")


def _key_words(words: Column) -> Column:
    return F.array_distinct(
        F.filter(words, lambda w: ~w.isin(BOILERPLATE) & ~w.rlike(r"^\d+$") & (w != ""))
    )


def _numbers(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike(r"^\d{1,4}$") & ~w.rlike(r"^(?:19|20)\d\d$"))


def _undated(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?<!\d)(?:19|20)\d\d[-./]\d\d?[-./]\d\d?(?!\d)|(?<!\d)\d\d?[-./]\d\d?[-./](?:19|20)\d\d(?!\d)", " ")
    month = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
    return F.regexp_replace(t, rf"(?i)\b\d\d?(?:st|nd|rd|th)?\s+{month},?\s+(?:19|20)\d\d|\b{month}\s+\d\d?(?:st|nd|rd|th)?,?\s+(?:19|20)\d\d", " ")


def _grams(words: Column, n: int) -> Column:
    """Every run of ``n`` words."""
    last = F.greatest(F.size(words) - n + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def match_pages(uploads: DataFrame, facts: DataFrame) -> DataFrame:
    """set_id, pageid, by, score: the page about each upload, by link or clearly by title.

    uploads[set_id, title, uploader, duration, url]. Links decide first; two linking pages are no
    answer. Titles meet on a DJ's name and an event word, never all with all; the best page must lead
    by 0.1.
    """
    facts = cut_lineage(facts.withColumn("_page", F.monotonically_increasing_id()))
    uploads = cut_lineage(uploads.withColumn("_up", F.monotonically_increasing_id()))
    keys = uploads.select("set_id", "duration", url_key("url").alias("key")).where(F.col("key").isNotNull())
    linked = facts.select("pageid", "lengths", F.explode("links").alias("l")).select("pageid", "lengths", url_key("l").alias("key")).distinct()
    hits = keys.join(linked, "key")
    part = F.col("duration").isNotNull() & (F.size("lengths") > 0) & F.forall(
        "lengths", lambda n: (F.col("duration") < PART_SHARE * n) & ~near(F.col("duration"), n)
    )
    by_link = hits.groupBy("set_id").agg(
        F.count_distinct("pageid").alias("n"), F.min("pageid").alias("pageid"), F.bool_or(part).alias("_part")
    )
    by_link = cut_lineage(by_link)  # read for the answers and for the uploads left
    found = by_link.where((F.col("n") == 1) & ~F.col("_part")).select(
        "set_id", "pageid", F.lit("link").alias("by"), F.lit(1.0).alias("score")
    )

    up = uploads.join(by_link, "set_id", "left_anti")
    name = F.regexp_replace(F.coalesce("uploader", F.lit("")), UPLOADER_SUFFIX, "")
    up = bind(up, _t=_undated(F.coalesce("title", F.lit(""))), _days=dates(F.coalesce("title", F.lit(""))))
    up = bind(
        up,
        words=_fold(F.col("_t")),
        context=_fold(name),
        lead=_key_words(_fold(F.get(F.split("_t", LEAD_END, 2), F.lit(0)))),
    )
    up = bind(
        up,
        years=F.array_distinct(F.concat(F.filter("words", lambda w: w.rlike(r"^(?:19|20)\d\d$")), F.transform("_days", lambda d: F.year(d).cast("string")))),
        numbers=_numbers(F.col("words")),
        keys=F.array_distinct(F.concat("words", "context")),
    )
    page = bind(facts, _rest=F.regexp_replace("title", PAGE_DATE, ""), _pdays=dates("title"), _year=F.regexp_extract("title", PAGE_DATE, 1))
    at = F.contains("_rest", F.lit(" @ "))
    page = bind(
        page,
        _djs=F.when(at, F.split_part("_rest", F.lit(" @ "), F.lit(1))).otherwise(F.split_part("_rest", F.lit(" - "), F.lit(1))),
        _event=F.when(at, F.split("_rest", " @ ", 2)[1]).otherwise(F.coalesce(F.get(F.split("_rest", " - ", 2), F.lit(1)), F.lit(""))),
    )
    page = bind(
        page,
        page_words=_fold(F.col("_rest")),
        event=_fold(F.col("_event")),
        _folded_djs=accent_fold(F.regexp_replace("_djs", r"\([^)]*\)", " ")),
    )
    page = bind(
        page,
        names=F.filter(
            F.transform(F.split("_folded_djs", NAME_SPLIT), lambda n: F.regexp_replace(words_of(n), r"^dj (?=.)", "")),
            lambda n: n != "",
        ),
        event_keys=_key_words(F.col("event")),
        page_numbers=_numbers(F.col("event")),
    )
    page = page.where((F.size("names") > 0) & (F.size("event_keys") > 0)).select(
        "_page", "pageid", "names", "event", "event_keys", "page_words", "page_numbers", "lengths", "radio_show", "_pdays", "_year",
        F.get("names", F.lit(0)).alias("_dj"),
    )
    # Both sides are read for the pairs and again for what is compared, and cost far more than a row of them.
    up, page = cut_lineage(up), cut_lineage(page)
    # An upload and a page meet on the first DJ's whole name and a word of the event. Names have as
    # many words as the pages say, so those lengths alone are cut out of the uploads. Rows of numbers and
    # short texts meet: phrases that are no DJ's name go before they are paired with words.
    sizes = page.agg(F.collect_set(F.size(F.split("_dj", " ")))).first()[0]

    def phrases(words: Column) -> Column:
        return F.concat(F.array().cast("array<string>"), *(_grams(words, n) for n in sorted(sizes)))

    named_by = F.array_distinct(F.concat(phrases(F.col("words")), phrases(F.col("context"))))
    said = up.select("_up", F.explode(named_by).alias("_dj")).join(page.select("_dj").distinct(), "_dj", "left_semi")
    said = said.join(up.select("_up", "set_id", F.explode(_key_words(F.col("keys"))).alias("_word")), "_up")
    billed = page.select("_page", "pageid", "_dj", F.explode("event_keys").alias("_word"))
    met = said.join(billed, ["_dj", "_word"]).groupBy("set_id", "pageid").agg(F.min(F.struct("_up", "_page")).alias("_m"))
    pairs = met.select("_m.*").join(up, "_up").join(page, "_page")

    def has(words: Column, one: Column) -> Column:
        return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.concat(F.lit(" "), one, F.lit(" ")))

    lead_in_event = F.size(F.array_except("lead", "event")) == 0
    day = same_day(F.col("_days"), F.col("_pdays"))
    fits_length = F.exists("lengths", lambda n: near(F.col("duration"), n))
    possible = (
        (F.size(F.array_except("lead", "page_words")) == 0)
        & F.forall("names", lambda n: has(F.col("words"), n) | (lead_in_event & has(F.col("context"), n)))
        & ((F.size("years") == 0) | F.array_contains("years", F.col("_year")) | F.arrays_overlap("years", "event"))
        & F.coalesce(day, F.lit(True))
        & ((F.size("numbers") == 0) | (F.size("page_numbers") == 0) | F.arrays_overlap("numbers", "page_numbers"))
        & (F.col("duration").isNull() | (F.size("lengths") == 0) | fits_length)
    )
    pairs = pairs.where(possible)
    named = F.flatten(F.transform("names", lambda n: F.split(n, " ")))
    seen = _key_words(F.col("keys"))
    asked = F.array_except(_key_words(F.col("words")), named)
    event_share = F.size(F.array_intersect("event_keys", seen)) / F.size("event_keys")
    asked_share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, F.col("page_words"))) / F.size(asked)).otherwise(1.0)
    pairs = bind(
        pairs,
        _share=event_share,
        score=F.bround(0.7 * event_share + 0.3 * asked_share, 2),
        _by=F.when(F.coalesce(day, F.lit(False)), "date").when(
            F.col("duration").isNotNull() & (F.size("lengths") > 0), "duration"
        ),
    )
    good = F.when(F.col("radio_show") & ~F.col("_by").eqNullSafe("date"), False).when(
        F.col("_by").isNotNull(), (F.col("_share") >= EVENT_SHARE) & (F.col("score") >= MIN_SCORE)
    ).otherwise(F.col("score") >= STRONG_SCORE)
    # Another possible episode of the same show is a rival whatever its score.
    w = Window.partitionBy("set_id").orderBy(F.desc("_good"), F.desc("score"), "pageid")
    pairs = cut_lineage(pairs.withColumn("_good", F.coalesce(good, F.lit(False))))
    best = (
        pairs.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & F.col("_good"))
        .select("set_id", "pageid", "score", F.array_sort("names").alias("_names"), F.col("event_keys").alias("_keys"))
    )
    others = pairs.select("set_id", F.col("pageid").alias("_other"), F.col("score").alias("_score"), "_good", "names", "event_keys").join(best, "set_id")
    inside = (F.size(F.array_except("_keys", "event_keys")) == 0) | (F.size(F.array_except("event_keys", "_keys")) == 0)
    rival = (F.col("_other") != F.col("pageid")) & (
        (F.col("_good") & (F.col("_score") > F.col("score") - MARGIN)) | ((F.array_sort("names") == F.col("_names")) & inside)
    )
    beaten = others.where(rival).select("set_id").distinct()
    clear = best.join(beaten, "set_id", "left_anti").select("set_id", "pageid", F.lit("title").alias("by"), "score")
    return found.unionByName(clear)
