"""Ranking search results for a requested song."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.labels import base_title, without_artist_tags
from ..functions.steps import bind
from ..functions.text import accent_fold, words_of
from ..session import cut_lineage, spread
from .scan import Scan, scan
from .tracklists import SEPARATOR

# Lengths in seconds, score parts and words of the ranking.
MIN_SECONDS = 60
MAX_TRACK_SECONDS = 900
DURATION_TOLERANCE = 8
SAME_LENGTH = 2
CONFIDENT_SCORE = 0.75
CONFIDENT_MARGIN = 0.1
BASE_SCORE = 0.6
OFFICIAL_BONUS = 0.15
LABEL_BONUS = 0.06
AUDIO_BONUS = 0.05
DURATION_BONUS = 0.1
VIEWS_BONUS = 0.04
VERSION_PENALTY = 0.4
EXTENDED_PENALTY = 0.1
MISSING_PENALTY = 0.05
LYRICS_PENALTY = 0.03
VIDEO_PENALTY = 0.08
VERSION_TERMS = (
    "remix bootleg edit vip rework flip dub live cover karaoke instrumental acapella "
    "slowed reverb nightcore 8d mashup acoustic extended mix lyrics"
).split()
VERSION_PHRASES = {
    "unplugged": "live", "a cappella": "acapella", "sped up": "sped up", "speed up": "sped up", "mash up": "mashup", "lyric": "lyrics",
}
ALIASES = {"rmx": "remix", "remixed": "remix", "remixes": "remix", "acappella": "acapella", "accapella": "acapella"}
MIX_PHRASES = ["dj mix", "mixtape", "megamix", "continuous mix", "mixed by", "b2b"]
REASONS = {
    "live": "live recording", "venue": "festival or venue upload", "mashup": "mashup", "medley": "medley", "mix": "different mix",
}
NOT_NAMES = ["mix", "version", "original", "the", "by"]
DATED_BRACKET = r"[\(\[][^\)\]]*\b(?:19|20)\d{2}\b[^\)\]]*[\)\]]"
NOT_VENUE = r"(?i)remaster|version|edition|mix|edit|anniversary|reissue|demo"
X_JOIN = r"(?i)\S\s+[x×]\s+\S"
TWO_SONGS = r"\S\s*/\s*\S"
LABEL_WORDS = ["records", "recordings", "recs", "label"]
AUDIO = r"(?i)[\(\[]\s*(?:official\s+)?audio\s*[\)\]]|\bofficial\s+audio\b"
VIDEO = r"(?i)\b(?:official\s+)?(?:music\s+)?video\b"


def folded_words(text: Column) -> Column:
    """Words of a text without case, accents or apostrophes."""
    return F.split(words_of(_flat(text)), " ")


def _flat(text: Column) -> Column:
    """A text without case, accents and apostrophes, its other marks in place."""
    return accent_fold(F.regexp_replace(F.coalesce(text, F.lit("")), "['’`´]", ""))


def _known(words: Column) -> Column:
    """Words under the spelling that the terms use."""
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(names, w), w))


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _within(padded: Column, phrase: Column) -> Column:
    return F.contains(padded, F.concat(F.lit(" "), phrase, F.lit(" ")))


def _any(padded: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(p) for p in phrases)), lambda p: _within(padded, p))


def _markers(padded: Column, title: Column) -> Column:
    """What a padded text of known words, and the title as written, say about the version."""
    text = F.replace(padded, F.lit(" original mix "), F.lit(" "))
    terms = [*((t, t) for t in VERSION_TERMS), *VERSION_PHRASES.items()]
    every = F.array(*(F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("name")) for p, n in terms))
    said = F.transform(F.filter(every, lambda t: _within(text, t["phrase"])), lambda t: t["name"])
    parts = F.split(title, SEPARATOR, 2)
    song = F.coalesce(F.get(parts, F.lit(1)), title)
    seen = {
        "venue": (title.rlike(DATED_BRACKET) & ~title.rlike(NOT_VENUE)) | _any(text, fixed.VENUES),
        "mashup": song.rlike(X_JOIN),
        "medley": base_title(F.regexp_replace(song, fixed.FEATURED, "")).rlike(TWO_SONGS),
    }
    more = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in seen.items())))
    found = F.array_distinct(F.concat(said, more))
    return F.when(F.size(found) > 1, F.array_remove(found, "mix")).otherwise(found)


def _featured(text: Column) -> Column:
    inside, bare = (F.regexp_extract_all(text, F.lit(fixed.FEATURED), F.lit(g)) for g in (1, 2))
    return F.zip_with(inside, bare, lambda a, b: F.when(a != "", a).otherwise(b))


def _names(credits: Column) -> Column:
    """Single names of credit texts, in matching form."""
    single = F.flatten(F.transform(credits, lambda c: F.split(c, fixed.CREDIT_SEPARATOR)))
    return F.array_remove(F.array_distinct(F.transform(single, words_of)), "")


def _same(core: Column, names: Column) -> Column:
    close = F.replace(core, F.lit(" "), F.lit(""))
    return (core != "") & F.exists(names, lambda n: F.replace(n, F.lit(" "), F.lit("")) == close)


def wanted(requests: DataFrame) -> DataFrame:
    """Requests in matching form; a mix named in brackets at the end of the title is the version."""
    label = F.col("label") if "label" in requests.columns else F.lit("")
    rows = bind(
        requests.select("request_id", "artist", "title", "version", label.alias("label")),
        _a=_flat(without_artist_tags(F.coalesce("artist", F.lit("")))),
        _t=_flat(without_artist_tags(F.coalesce("title", F.lit("")))),
        _v=_flat(without_artist_tags(F.coalesce("version", F.lit("")))),
        _l=words_of(_flat(F.col("label"))),
    )
    rows = bind(rows, _song=F.trim(F.regexp_replace("_t", fixed.FEATURED, "")))
    rows = bind(rows, _base=base_title("_song"))
    rows = bind(rows, _tail=words_of(F.substring("_song", F.length("_base") + 1, F.length("_song"))))
    tail = _markers(_padded(_known(F.split("_tail", " "))), F.col("_tail"))
    named = (words_of(F.col("_v")) == "") & (F.col("_base") != F.col("_song")) & (F.size(F.array_remove(tail, "venue")) > 0)
    rows = bind(rows, _version=F.when(named, F.col("_tail")).otherwise(words_of(F.col("_v"))))
    rows = bind(rows, _version=F.when(F.col("_version").isin(fixed.ORIGINAL_VERSIONS), "").otherwise(F.col("_version")))
    rows = bind(rows, _words=F.array_remove(_known(F.split("_version", " ")), ""))
    need = F.filter("_words", lambda w: ~w.isin("mix", "version", "the"))
    remixer = F.array_join(F.filter("_words", lambda w: ~w.isin(*VERSION_TERMS, *NOT_NAMES)), " ")
    whole = F.concat_ws(" ", words_of(F.col("_a")), words_of(F.col("_t")), F.col("_version"))
    rows = bind(
        rows,
        _primary=_names(F.array(F.regexp_replace("_a", fixed.FEATURED, ""))),
        _others=F.concat(_names(F.concat(_featured(F.col("_a")), _featured(F.col("_t")))), F.array(remixer)),
        _need=F.when(F.size(need) > 0, need).otherwise(F.col("_words")),
        _text=_padded(_known(F.split(whole, " "))),
    )
    asked = F.concat("artist", F.lit(" - "), "title", F.lit(" ("), "_version", F.lit(")"))
    return rows.select(
        "request_id",
        "_primary",
        F.array_remove(F.array_distinct(F.concat("_primary", "_others")), "").alias("_credited"),
        F.array(F.col("_l")).alias("_label"),
        F.array_remove(_known(F.split(words_of(F.col("_base")), " ")), "").alias("_title"),
        "_need",
        _markers(F.col("_text"), F.coalesce(asked, F.lit(""))).alias("_asked"),
        F.col("_text").alias("_request"),
        _any(F.col("_text"), [*fixed.SET_PHRASES, *MIX_PHRASES]).alias("_is_mix"),
    )


def assess(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Request and entry pairs that can be the song, with their score before comparison, and reasons.

    requests[request_id, artist, title, version, label?], entries[request_id, url, title, uploader,
    duration, view_count, provider, artists?]. Each side is folded per row, before the sides meet. Any one of
    the credited names is enough, in the title, the uploader or the publisher's ``artists``.
    """
    credits = F.array_join("artists", " ") if "artists" in entries.columns else F.lit("")
    found = bind(
        spread(entries),
        _t=_known(folded_words(F.col("title"))),
        _u=folded_words(F.col("uploader")),
        _c=_padded(_known(folded_words(credits))),
    )
    core = F.regexp_replace(F.array_join("_u", " "), fixed.UPLOADER_SUFFIX, "")
    bare = F.trim(F.regexp_replace(core, r"vevo$", ""))
    found = bind(
        found,
        _core=F.when(bare != "", bare).otherwise(core),
        _title_text=_padded(F.col("_t")),
        _both=_padded(F.concat("_t", _known(F.col("_u")))),
        _marks=_markers(_padded(F.col("_t")), F.coalesce("title", F.lit(""))),
    )
    rows = found.join(wanted(requests), "request_id")
    words = F.split(F.trim("_both"), " ")
    phrases = F.array(*(F.lit(p) for p in fixed.SET_PHRASES))
    is_set = F.exists(phrases, lambda p: _within(F.col("_title_text"), p) & ~_within(F.col("_request"), p))
    long = F.coalesce(F.col("duration") > MAX_TRACK_SECONDS, F.lit(False))
    fits = (
        ~F.coalesce(F.col("duration") < MIN_SECONDS, F.lit(False))
        & (F.col("_is_mix") | ~(long | is_set))
        & (F.size(F.array_except("_title", words)) == 0)
        & (F.size(F.array_except("_need", words)) == 0)
    )
    rows = bind(
        rows.where(fits),
        official=_same(F.col("_core"), F.col("_credited")),
        _named=F.size(F.filter("_primary", lambda n: _within(F.col("_both"), n) | _within(F.col("_c"), n))),
    )
    by_label = _same(F.col("_core"), F.col("_label")) | F.arrays_overlap("_u", F.array(*(F.lit(w) for w in LABEL_WORDS)))
    rows = bind(rows, label=~F.col("official") & by_label)
    rows = rows.where((F.col("_named") > 0) | F.col("official") | F.col("label"))
    left = F.array_except("_marks", "_asked")
    extra = F.when(F.array_contains("_asked", "live"), F.array_remove(left, "venue")).otherwise(left)
    rows = bind(rows, _extra=extra, missing=~F.col("official") & (F.col("_named") < F.greatest(F.size("_primary"), F.lit(1))))
    rows = bind(rows, _strong=F.array_sort(F.array_except("_extra", F.array(F.lit("extended"), F.lit("lyrics")))))
    topic = (F.col("provider") == "youtube") & F.rtrim("uploader").endswith("- Topic") & F.col("official")
    audio, video = F.col("title").rlike(AUDIO), F.col("title").rlike(VIDEO)
    views = F.when(
        F.col("view_count") > 0, VIEWS_BONUS * F.least(F.log10(F.col("view_count") + 1) / 8, F.lit(1.0))
    ).otherwise(0.0)
    extended, lyrics = (F.array_contains("_extra", w) for w in ("extended", "lyrics"))
    # (condition, what it adds to the score, the reason it gives)
    parts = [
        (F.col("official"), OFFICIAL_BONUS, "official artist upload"),
        (F.col("label"), LABEL_BONUS, "label upload"),
        (F.col("missing") & (F.col("_named") == 0), -MISSING_PENALTY, "artist not in title"),
        (F.col("missing") & (F.col("_named") > 0), -MISSING_PENALTY, "credited artist missing"),
        (topic, AUDIO_BONUS, "YouTube Topic channel"),
        (audio, AUDIO_BONUS, "official audio"),
        (~audio & video, -VIDEO_PENALTY, "music video; may differ from the track"),
        (F.size("_strong") > 0, -VERSION_PENALTY, None),
        (extended, -EXTENDED_PENALTY, "extended mix not requested"),
        (lyrics, -LYRICS_PENALTY, "lyrics upload"),
        (F.col("view_count") >= 100_000, 0.0, "high view count"),
    ]
    score, reasons = F.lit(BASE_SCORE) + views, []
    said = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    strong = F.transform("_strong", lambda m: F.coalesce(F.try_element_at(said, m), F.concat(m, F.lit(" not requested"))))
    for condition, value, reason in parts:
        holds = F.coalesce(condition, F.lit(False))
        score = score + F.when(holds, value).otherwise(0.0)
        one = F.when(holds, F.array(F.lit(reason))) if reason else F.when(holds, strong)
        reasons.append(F.coalesce(one, F.array().cast("array<string>")))
    return rows.select(
        *entries.columns,
        score.alias("score"),
        "official",
        "label",
        "missing",
        ((F.size("_strong") > 0) | extended).alias("other_version"),
        F.concat(*reasons).alias("reasons"),
    )


def compare_lengths(assessed: DataFrame) -> DataFrame:
    """Adds the bonus for a length near the median of the *other* clean entries.

    Leaving one value out of n sorted ones moves the median to its neighbours, so three order
    statistics per request answer for every entry; nothing is gathered per request.
    """
    clean = ~F.col("other_version") & F.col("duration").isNotNull()
    ranked = assessed.where(clean).groupBy("request_id", "duration").agg(F.count(F.lit(1)).alias("_n"))
    totals = ranked.groupBy("request_id").agg(F.sum("_n").alias("_total"))
    upto = scan(
        ranked, ["request_id"], ["duration"], F.floor("duration"), [Scan("_upto", "sum", F.col("_n"))]
    ).join(totals, "request_id")

    def at(place: Column) -> Column:
        here = (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)
        return F.max(F.when(here, F.col("duration")))

    half = F.floor(F.col("_total") / 2)
    stats = upto.groupBy("request_id").agg(
        F.max("_total").alias("_total"),
        at(half - 1).alias("_m1"),
        at(half).alias("_0"),
        at(half + 1).alias("_1"),
        at(half + 2).alias("_2"),
    )
    rows = assessed.join(stats, "request_id", "left")
    d = F.col("duration")
    # n odd: the n - 1 others are even, their middle pair skips the entry itself.
    odd = F.col("_total") % 2 == 1
    pair = (
        F.when(d <= F.col("_0"), (F.col("_1") + F.col("_2")) / 2)
        .when(d == F.col("_1"), (F.col("_0") + F.col("_2")) / 2)
        .otherwise((F.col("_0") + F.col("_1")) / 2)
    )
    single = F.when(d <= F.col("_0"), F.col("_1")).otherwise(F.col("_0"))
    others = F.when(F.col("_total") < 2, None).when(odd, pair).otherwise(single)
    near = clean & (F.abs(d - others) <= DURATION_TOLERANCE)
    bonus = F.when(F.coalesce(near, F.lit(False)), DURATION_BONUS).otherwise(0.0)
    score = F.round(F.least(F.greatest(F.col("score") + bonus, F.lit(0.0)), F.lit(1.0)), 3)
    return rows.select(
        *(c for c in assessed.columns if c != "score"),
        score.alias("score"),
        F.coalesce(near, F.lit(False)).alias("length_agrees"),
    ).withColumn(
        "reasons",
        F.when(F.col("length_agrees"), F.array_append("reasons", F.lit("duration matches others"))).otherwise(F.col("reasons")),
    )


def rank_sources(
    requests: DataFrame, entries: DataFrame, availability: DataFrame | None = None, *, top: int | None = None
) -> DataFrame:
    """Entries per request, best first, with the one confident choice marked.

    availability[url, available]: entries known to be gone are left out but still vouch for a length.
    """
    # Texts are read once: lengths, vouching and ranks each look at the rows again.
    rows = cut_lineage(compare_lengths(cut_lineage(assess(requests, entries))))
    checked = availability is not None
    if checked:
        rows = rows.join(availability, "url", "left")
    else:
        rows = rows.withColumn("available", F.lit(None).cast("boolean"))
    # Lengths within two seconds lie in the same or a neighbouring two-second bin.
    bin = F.floor(F.col("duration") / SAME_LENGTH).cast("long")
    own = rows.where(F.col("official") & ~F.col("other_version") & F.col("duration").isNotNull()).select(
        "request_id", F.col("duration").alias("_own"), F.explode(F.sequence(bin - 1, bin + 1)).alias("_bin")
    )
    vouched = (
        rows.where("label")
        .select("request_id", "url", "duration", bin.alias("_bin"))
        .join(own.distinct(), ["request_id", "_bin"])
        .where(F.abs(F.col("duration") - F.col("_own")) <= SAME_LENGTH)
        .select("request_id", "url", F.lit(True).alias("_vouched"))
        .distinct()
    )
    rows = rows.join(vouched, ["request_id", "url"], "left").withColumn(
        "vouched", F.coalesce("_vouched", F.lit(False))
    )
    as_long = F.array_append("reasons", F.lit("same length as the artist's upload"))
    rows = rows.withColumn("reasons", F.when(F.col("vouched"), as_long).otherwise(F.col("reasons")))
    kept = rows.where(F.coalesce("available", F.lit(True))).withColumns(
        {"_score": -F.col("score"), "_views": -F.coalesce("view_count", F.lit(0))}
    )
    nxt = F.struct("score", "official", "label", "other_version", "duration")
    ranked = scan(
        kept,
        ["request_id"],
        ["_score", "_views", "title", "uploader", "provider", "url"],
        F.struct(F.floor(F.col("_score") * 1000), F.floor(F.col("_views") / 1000)),
        [Scan("rank", "number"), Scan("_next", "lead", nxt)],
    ).drop("_score", "_views", "_vouched")
    same_upload = (
        (F.col("_next.official") | F.col("_next.label"))
        & ~F.col("_next.other_version")
        & (F.abs(F.col("_next.duration") - F.col("duration")) <= SAME_LENGTH)
    )
    clear = (
        F.col("_next").isNull()
        | (F.round(F.col("score") - F.col("_next.score"), 3) >= CONFIDENT_MARGIN)
        | F.coalesce(same_upload, F.lit(False))
        | F.col("vouched")
    )
    confident = (
        (F.col("rank") == 1)
        & (~F.col("missing") | F.col("vouched"))
        & ~F.col("other_version")
        & (F.col("score") >= CONFIDENT_SCORE)
        & clear
    )
    if checked:
        confident = confident & F.coalesce("available", F.lit(False))
    ranked = ranked.withColumn("confident", confident).drop("_next")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def worth_probing(ranked: DataFrame, count: int | None = None) -> DataFrame:
    """The uploads of the requested version, best first, for an availability check: all or a few."""
    w = Window.partitionBy("request_id").orderBy("rank")
    good = ranked.where(~F.col("other_version")).withColumn("_n", F.row_number().over(w))
    return (good if count is None else good.where(F.col("_n") <= count)).drop("_n")


#: What is shown of an upload.
PICK = ["provider", "url", "title", "uploader", "duration", "score", "reasons", "available"]


def gone(entries: DataFrame, availability: DataFrame) -> DataFrame:
    """Entries that no longer play, and why: entries[request_id, url, ...], availability[url, available, reason]."""
    lost = availability.where(~F.col("available")).select("url", "reason")
    return entries.join(lost, "url").select("request_id", "provider", "url", "title", "uploader", "reason")


def plan_fetch(items: DataFrame, ranked: DataFrame, *, skipped: DataFrame | None = None, shown: int | None = None) -> DataFrame:
    """Missing items with the upload to fetch, or those to choose from and why.

    The items' own columns come first. ``picked`` and ``options`` show whole uploads; ``source`` and ``alternates`` are
    addresses, each once. ``skipped`` (see ``gone``) adds the uploads that no longer play. ``shown`` cuts the options and
    alternates of a report; ``n_options`` is their true number.
    """
    ranked = cut_lineage(ranked)  # read three times
    best = ranked.where("confident").select("request_id", F.struct(*PICK).alias("_best"))
    inside = F.lit(True) if shown is None else F.col("rank") <= shown
    options = ranked.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(inside, F.struct("rank", *PICK)))).alias("options"),
        F.count("*").alias("n_options"),
    )
    length = ranked.join(best, "request_id").where(
        (F.col("url") != F.col("_best.url"))
        & ~F.col("other_version")
        & (F.col("official") | F.col("label") | F.coalesce(F.abs(F.col("duration") - F.col("_best.duration")) <= SAME_LENGTH, F.lit(False)))
    )
    urls = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]))
    others = length.groupBy("request_id").agg((urls if shown is None else F.slice(urls, 1, shown)).alias("alternates"))
    rows = items.where(F.col("state") == "missing").join(best, "request_id", "left")
    rows = rows.join(options, "request_id", "left").join(others, "request_id", "left")
    more = []
    if skipped is not None:
        upload = F.struct("provider", "url", "title", "uploader", "reason")
        lost = skipped.groupBy("request_id").agg(F.array_sort(F.collect_set(upload)).alias("skipped"))
        rows = rows.join(lost, "request_id", "left")
        more = ["skipped"]
    return rows.select(
        *(c for c in items.columns if c != "state"),
        F.when(F.col("_best").isNotNull(), "chosen").otherwise("undecided").alias("decision"),
        F.col("_best.url").alias("source"),
        F.col("_best").alias("picked"),
        "alternates",
        F.when(F.col("_best").isNotNull(), None)
        .when(F.col("options").isNull(), "nothing found")
        .otherwise("no confident match")
        .alias("reason"),
        "options",
        F.coalesce("n_options", F.lit(0)).alias("n_options"),
        *more,
    )
