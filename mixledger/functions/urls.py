"""One spelling per page, links in text, deep links and shop links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import col, squeeze, words_of

# Patterns and link formats.
LINK = r"https?://[^\s<>\"']+"
TRAILING_MARKS = r"[.,;:!?)\]]+$"
SHOPS = {
    "beatport": "https://www.beatport.com/search?q={}",
    "bandcamp": "https://bandcamp.com/search?q={}&item_type=t",
    "traxsource": "https://www.traxsource.com/search?term={}",
}
RECORD_LABEL = r"\s*\[[^\[\]]*\]\s*$"


def url_key(url: Column | str) -> Column:
    """One spelling per upload: "youtube:<id>", else host and lower-case path without scheme,
    "www.", "m.", last slash or query, but with a parameter that names the video."""
    u = F.trim(col(url))
    host = F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^(?:www|m|mobile|music)\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")

    def parameter(name: str) -> Column:
        return F.regexp_extract(u, rf"^[^?#]*\?(?:[^#]*&)?{name}=([^&#]+)", 1)

    watch = path.rlike(r"^/watch(?:/|$)")
    video = (
        F.when(host == "youtu.be", F.regexp_extract(path, r"^/([^/]*)", 1))
        .when(watch, parameter("v"))
        .otherwise(F.regexp_extract(path, r"^/(?:embed|v|live|shorts)/([^/]*)", 1))
    )
    named = F.coalesce(
        *(F.when(parameter(n) != "", F.concat(F.lit(f"?{n}="), parameter(n))) for n in ("v", "id")),
        F.lit(""),
    )
    on_youtube = host.isin("youtu.be", "youtube.com", "youtube-nocookie.com")
    return (
        F.when(on_youtube, F.when(video.rlike(r"^[A-Za-z0-9_-]{11}$"), F.concat(F.lit("youtube:"), video)))
        .when((host != "") & (path != ""), F.concat(host, F.lower(path), named))
    )


def links_in(text: Column | str) -> Column:
    """Distinct web links of a text, in order, without trailing punctuation."""
    found = F.regexp_extract_all(col(text), F.lit(f"({LINK})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, TRAILING_MARKS, "")))


def evidence_url(url: Column | str) -> Column:
    """Is it an https address with a host and without credentials?"""
    u = col(url)
    host = F.try_parse_url(u, F.lit("HOST"))
    return (
        F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")) == "https", F.lit(False))
        & host.isNotNull()
        & F.try_parse_url(u, F.lit("USERINFO")).isNull()
    )


def set_key(url: Column | str) -> Column:
    return F.substring(F.sha2(url_key(url), 256), 1, 16)


def listen_url(url: Column | str, seconds: Column | str) -> Column:
    """The page at a moment: ``t=`` on video pages, ``#t=`` elsewhere."""
    u, s = col(url), F.floor(col(seconds)).cast("string")
    video = u.rlike(r"(?i)^https?://(?:[\w-]+\.)*(?:youtube\.com|youtu\.be)/")
    joined = F.when(F.contains(u, F.lit("?")), "&t=").otherwise("?t=")
    at = F.when(video, F.concat(u, joined, s, F.lit("s"))).otherwise(F.concat(u, F.lit("#t="), s))
    return F.when(u.isNotNull() & s.isNotNull(), at).otherwise(u)


def shop_links(artist: Column | str, title: Column | str, version: Column | str) -> Column:
    """Search pages of three shops for a song, without record label, featured names and "(Original Mix)"."""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        # A lambda's argument is a value, so no pattern runs again for each use.
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def rest(text: Column, pattern: str) -> Column:
        return once(F.trim(F.regexp_replace(text, pattern, "")), lambda kept: F.when(kept != "", kept).otherwise(text))

    def pages(query: Column) -> Column:
        pairs = [(F.lit(shop), F.replace(F.lit(page), F.lit("{}"), query)) for shop, page in SHOPS.items()]
        return F.create_map(*(x for pair in pairs for x in pair))

    name, song, mix = (F.coalesce(col(c), F.lit("")) for c in (artist, title, version))
    song = rest(F.regexp_replace(song, RECORD_LABEL, ""), fixed.ORIGINAL_SUFFIX)
    mix = F.regexp_replace(mix, RECORD_LABEL, "")
    mix = F.when(words_of(F.lower(mix)).isin(fixed.ORIGINAL_VERSIONS), "").otherwise(mix)
    words = squeeze(F.concat_ws(" ", rest(name, fixed.FEATURED), once(song, lambda s: rest(s, fixed.FEATURED)), mix))
    return once(F.replace(F.replace(F.url_encode(words), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")), pages)


def path_key(path: Column | str) -> Column:
    """``posix:/a/b`` or ``windows:C:/a/b`` of an absolute local path, or null."""
    p = col(path)
    bad = p.rlike(r"[\x00-\x1F\x7F]") | (F.length(p) > 4096)
    windows = p.rlike(r"^[A-Za-z]:[/\\]")
    forward = F.replace(p, F.lit("\\"), F.lit("/"))
    dots = F.when(windows, forward).otherwise(p).rlike(r"(?:^|/)\.{1,2}(?:/|$)")
    tidy = F.regexp_replace(F.regexp_replace(forward, r"/{2,}", "/"), r"(?<=.)/$", "")
    drive = F.concat(F.upper(F.substring(tidy, 1, 1)), F.expr("''"), F.substring(tidy, 2, 4096))
    posix = p.startswith("/") & ~p.startswith("//") & ~F.contains(p, F.lit("\\"))
    return F.when(bad | dots | p.isNull(), None).when(windows, F.concat(F.lit("windows:"), drive)).when(
        posix, F.concat(F.lit("posix:"), tidy)
    )


def location_key(uri: Column | str) -> Column:
    """``path_key`` of a local file URI, or null for anything else."""
    u = col(uri)
    local = u.rlike(r"(?i)^file://(?:localhost)?/[^?#]*$") & ~u.rlike(r"%(?![0-9A-Fa-f]{2})")
    # A plus sign is itself in a path; only percent escapes are decoded.
    raw = F.replace(F.regexp_extract(u, r"(?i)^file://(?:localhost)?(/.*)$", 1), F.lit("+"), F.lit("%2B"))
    # Each step is worked out once: a lambda's argument is a value, not a repeated expression.
    paths = F.array(F.try_url_decode(F.when(local, raw)))
    paths = F.transform(
        paths, lambda p: F.when(p.rlike(r"^/[A-Za-z]:/"), F.substring(p, 2, 4096)).otherwise(p)
    )
    return F.get(F.transform(paths, path_key), F.lit(0))
