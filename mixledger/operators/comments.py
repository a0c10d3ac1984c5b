"""Songs that listeners name in comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import bind
from ..functions.text import accent_fold, words_of
from .tracklists import SEPARATOR, UNKNOWN

# Comment patterns and word lists.
CLOCK = r"(?U)(?<![\w:])@?(\d{1,2}(?::[0-5]\d){1,2})(?![\w:])"
RANGE_END = r"(?iU)(?<=\d)\s*(?:to|till|until|-|–|—|~)\s*@?\d{1,2}(?::[0-5]\d){1,2}(?![\w:])"
CLAUSE = r"(?U)\n|\s+[/|]\s+|[;!?]+|(?<=\w{4})\.(?:\s|$)"
LEADING = r"(?U)^[\s\-–—:=>|.,)\]]+"
FILLER = (
    r"(?:[:=\"“”]|@[\w.]+|\b(?:it['’]s|its|it|is|this|that['’]s|thats|that|was|track|tune|song|"
    r"id|yes|yeah|yep|yup|def|definitely|probably|prob|maybe|think|sure|called|playing|played|i)\b)"
)
TITLE_END = (
    r"(?U)\s+[-–—]\s+|,\s|\s+(?:is|was|goes|lol|lmao|haha|imo|btw)\b|\s+@|https?://"
    r"|\s+(?i:i think|i believe|i guess|i reckon|probably|maybe|for sure)\b"
)
TITLE_TAIL = r"(?iU)\s+(?:at|@|around|from|near|~)\s*$"
EDGES = r"^[ \t'\"“”‘’*~\-–—.,:;]+|[ \t'\"“”‘’*~\-–—.,:;]+$"
ARTIST_EDGES = r"^[ \t'\"“”‘’*~\-–—.,:;(\[]+|[ \t'\"“”‘’*~\-–—,:;(\[]+$"
QUESTION = r"(?i)^(?:what|whats|who|anyone|does|any|track\s*id|song\s*id|id\b)"
LETTER = r"\p{L}"
CHAT = "is was part drop starts starting goes hits kicks moment section stretch transition bit".split()
PRAISE = (
    "absolute absolutely amazing awesome banger bangers beautiful best chills choon crazy damn fire goat "
    "goated good goosebumps great heater huge incredible insane love magic massive mmm omg perfect sick "
    "tune tunes unreal vibe vibes wow"
).split()
SMALL_TALK = (
    "a all are bro ever haha holy is it its just lol mate mix of pure really set so song such that the "
    "this time track was what yes"
).split()
PROSE = (
    "i im me my we our you your he she they this that it its is was are be been so just from in at of for "
    "with to on about what how when where who set sets times time day night evening morning weekend music "
    "performance crowd love boys girls guys everyone cheers respect thanks thank watching listening here there"
).split()
LOOSE_ENDS = "the a an to of and or but he she it in on at for with my your".split()
SENTENCE_WORDS = ["rules", "rule", "wait", "respect", "cheers", "thanks"]


def _words(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def _seconds(clock: Column) -> Column:
    return F.aggregate(F.split(clock, ":"), F.lit(0.0), lambda s, p: s * 60 + p.try_cast("double"))


def segments(comments: DataFrame) -> DataFrame:
    """Pieces of each comment with the time each belongs to and whether it is a list entry.

    comments[set_id, n, text, start_time, like_count]. A time range counts as its start. Several
    times make a list; text comes before or after its time depending on where the letters are.
    """
    rows = bind(comments, _text=F.regexp_replace(F.coalesce("text", F.lit("")), RANGE_END, ""))
    rows = bind(
        rows,
        _pieces=F.split("_text", CLOCK),
        _times=F.transform(F.regexp_extract_all("_text", F.lit(CLOCK), F.lit(1)), _seconds),
    )
    n = F.size("_times")
    head, tail = F.get("_pieces", F.lit(0)), F.element_at("_pieces", -1)
    many = n >= 2

    def piece(text: Column, seconds: Column, listing: Column) -> Column:
        return F.struct(text.alias("piece"), seconds.alias("seconds"), listing.alias("listing"))

    text_first = head.rlike(LETTER) & ~tail.rlike(LETTER)
    index = F.sequence(F.lit(0), n - 1)
    before = F.transform(index, lambda i: piece(F.get("_pieces", i), F.get("_times", i), many))
    after = F.transform(index, lambda i: piece(F.get("_pieces", i + 1), F.get("_times", i), many))
    opening = F.when(F.trim(head) != "", F.array(piece(head, F.get("_times", F.lit(0)), F.lit(False)))).otherwise(
        F.array().cast("array<struct<piece:string,seconds:double,listing:boolean>>")
    )
    pieces = (
        F.when(n == 0, F.array(piece(F.col("_text"), F.col("start_time"), F.lit(False))))
        .when(text_first, before)
        .otherwise(F.concat(opening, after))
    )
    return rows.select("set_id", "n", "text", F.coalesce("like_count", F.lit(0)).alias("likes"), F.inline(pieces))


def _clean_title(text: Column) -> Column:
    """Up to where a title plainly ends, without emoji tails or brackets nobody closed."""
    t = F.get(F.split(text, TITLE_END, 2), F.lit(0))
    t = F.regexp_replace(t, r"[\p{So}\p{Sk}\p{Cs}\p{Co}][\s\S]*$", "")
    t = F.regexp_replace(t, r"^([^()\[\]]*(?:[\(\[][^()\[\]]*[\)\]][^()\[\]]*)*)[\)\]][\s\S]*$", "$1")
    t = F.regexp_replace(t, r"[\(\[](?=[^\)\]]*$)[\s\S]*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, EDGES, ""), TITLE_TAIL, ""))


def _clean_artist(text: Column) -> Column:
    t = F.regexp_replace(text, rf"(?isU)^.*{FILLER}", "")
    return F.trim(F.regexp_replace(t, ARTIST_EDGES, ""))


def _plausible(text: Column, most: int) -> Column:
    count = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return count.between(1, most) & text.rlike(LETTER) & ~text.rlike(UNKNOWN) & ~F.contains(text, F.lit("?"))


def parse_comments(comments: DataFrame) -> DataFrame:
    """set_id, n, artist, title, song, seconds, likes, text: every song a comment names.

    Whole comments are read. Free text must look like a credit; a list of times may give titles alone.
    """
    rows = segments(comments).withColumn("clause", F.explode(F.split("piece", CLAUSE)))
    rows = bind(rows, clause=F.regexp_replace("clause", LEADING, "")).where(F.col("clause") != "")
    parts = F.split("clause", SEPARATOR, 2)
    rows = bind(rows, _pair=F.size(parts) == 2, _left=F.get(parts, F.lit(0)), _right=F.get(parts, F.lit(1)))
    rows = rows.where(F.col("_pair") | F.col("listing"))
    rows = bind(
        rows,
        artist=F.when(F.col("_pair"), _clean_artist(F.col("_left"))).otherwise(""),
        title=_clean_title(F.coalesce("_right", "clause")),
    )
    shaped = F.when(
        F.col("_pair"), _plausible(F.col("artist"), 6) & _plausible(F.col("title"), 12)
    ).otherwise(
        _plausible(F.col("title"), 8) & ~F.col("clause").rlike(QUESTION) & ~F.contains("clause", F.lit("?"))
    )
    # Only what already looks like a name is folded.
    rows = rows.where(shaped)
    rows = bind(
        rows,
        _folded=F.split(accent_fold(F.concat_ws("\u001f", F.regexp_replace("artist", "['’`´]", ""), F.regexp_replace("title", "['’`´]", ""))), "\u001f"),
    )
    rows = bind(
        rows,
        _artist=F.split(words_of(F.get("_folded", F.lit(0))), " "),
        _title=F.split(words_of(F.get("_folded", F.lit(1))), " "),
    )
    praise = F.arrays_overlap("_title", _words(PRAISE)) & (F.size(F.array_except("_title", _words(PRAISE + SMALL_TALK))) == 0)
    sentence = (
        (F.size("_artist") > 4)
        | F.arrays_overlap("_artist", _words(PROSE))
        | F.element_at("_title", -1).isin(LOOSE_ENDS)
        | F.arrays_overlap("_title", _words(SENTENCE_WORDS))
    )
    names_id = F.array_join("_artist", " ").isin("track id", "song id")
    good = F.when(F.col("_pair"), ~praise & ~names_id & (F.col("listing") | ~sentence)).otherwise(
        ~praise & ~F.arrays_overlap("_title", _words(CHAT))
    )
    return rows.where(good).select(
        "set_id",
        "n",
        "artist",
        "title",
        F.concat_ws("|", F.array_join("_artist", " "), F.array_join("_title", " ")).alias("song"),
        "seconds",
        F.greatest("likes", F.lit(0)).alias("likes"),
        "text",
    )


def excerpt(text: Column, needle: Column, width: int = 100) -> Column:
    """The part of a text around a mention."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    found = F.instr(F.lower(flat), F.lower(needle))
    start = F.greatest(F.least(found - 31, F.length(flat) - width), F.lit(0))
    start = F.when(found > 0, start).otherwise(0)
    piece = F.trim(F.substring(flat, start + 1, F.lit(width)))
    cut = F.concat(
        F.when(start > 0, "…").otherwise(""), piece, F.when(start + width < F.length(flat), "…").otherwise("")
    )
    return F.when(F.length(flat) <= width, flat).otherwise(cut)


def with_support(mentions: DataFrame) -> DataFrame:
    """Untimed replies take the song of a timed claim they back: the same artist, the same first
    title word, and one title's words inside the other's."""
    split = mentions.withColumns({"_a": F.split_part("song", F.lit("|"), F.lit(1)), "_t": F.split(F.split_part("song", F.lit("|"), F.lit(2)), " ")})
    timed = split.where(F.col("seconds").isNotNull() & (F.col("_a") != "")).groupBy("set_id", "_a", "_t").agg(
        F.min("song").alias("_claim"), F.min("n").alias("_first")
    ).withColumn("_w", F.get("_t", F.lit(0)))
    loose = split.where(F.col("seconds").isNull()).withColumn("_w", F.get("_t", F.lit(0)))
    t = timed.select("set_id", "_a", "_w", F.col("_t").alias("_ct"), "_claim", "_first")
    backed = (
        loose.join(t, ["set_id", "_a", "_w"])
        .where((F.size(F.array_except("_t", "_ct")) == 0) | (F.size(F.array_except("_ct", "_t")) == 0))
        .groupBy("set_id", "n", "song")
        .agg(F.min_by("_claim", F.struct(F.col("_claim") != F.col("song"), "_first")).alias("_claim"))
    )
    rows = mentions.join(backed, ["set_id", "n", "song"], "left")
    use = F.col("seconds").isNull() & F.col("_claim").isNotNull()
    return rows.withColumn("song", F.when(use, F.col("_claim")).otherwise(F.col("song"))).drop("_claim")
