"""One song under several spellings: how alike two labels are, and a join that finds every alike pair."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.labels import with_forms, without_artist_tags
from ..functions.steps import bind
from ..functions.text import normalize, squeeze
from ..session import cut_lineage, spread
from .tracklists import FEATURING_LABEL, VERSION_WORDS

# How surely two labels name one song in any version, and how alike spellings must be.
SAME_CREDITS, SHARED_CREDITS, INSIDE, CLOSE, SAME_TITLE = 1.0, 0.9, 0.8, 0.7, 0.6
RATIO = 0.85
# Marks of a mix compilation's copy, and a closing bracket with what it holds (two levels).
MIXED = r"(?iU)\s*[\(\[]\s*(?:mixed|mix\s*cut|continuous(?:\s+mix)?)\s*[\)\]]"
BRACKET = r"[\(\[]((?:[^()\[\]]|[\(\[](?:[^()\[\]]|[\(\[][^()\[\]]*[\)\]])*[\)\]])*)[\)\]]\s*$"

#: Letters of a gram of the spelling join; the bound in ``_prefixes`` is for two.
GRAM = 2
SONG = ["names", "core", "text"]


def display_label(artist: Column, title: Column, version: Column) -> Column:
    """struct(artist, title, version) as shown: "[Mixed]" dropped, a mix name at the end of the title split off.

    A name in brackets (one pair inside another too) or behind the last dash is a version where a version
    word stands in it; credits in brackets stay in the title.
    """
    given = F.trim(F.coalesce(version, F.lit("")))
    bare = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), MIXED, ""))
    shown = F.when(bare != "", bare).otherwise(F.trim(F.coalesce(title, F.lit(""))))
    whole = r"(?U)^(.*\S)\s*" + BRACKET
    head, tail = F.regexp_extract(shown, whole, 1), F.regexp_extract(shown, whole, 2)
    dash_head, dash_tail = F.regexp_extract(shown, r"^(.*\S.*) - (.*)$", 1), F.regexp_extract(shown, r"^(.*\S.*) - (.*)$", 2)
    in_brackets = (head != "") & tail.rlike(VERSION_WORDS) & ~tail.rlike(FEATURING_LABEL)
    by_dash = ~shown.rlike(BRACKET) & (dash_head != "") & dash_tail.rlike(VERSION_WORDS)
    parts = F.when(given != "", F.struct(shown.alias("t"), given.alias("v")))
    parts = parts.when(in_brackets, F.struct(head.alias("t"), F.trim(tail).alias("v")))
    parts = parts.when(by_dash, F.struct(F.trim(dash_head).alias("t"), F.trim(dash_tail).alias("v")))
    parts = parts.otherwise(F.struct(shown.alias("t"), F.lit("").alias("v")))
    plain = F.regexp_replace(parts["t"], fixed.ORIGINAL_SUFFIX, "")
    return F.struct(
        F.trim(F.coalesce(artist, F.lit(""))).alias("artist"),
        F.trim(F.when(plain != "", plain).otherwise(parts["t"])).alias("title"),
        F.when(F.lower(parts["v"]).isin(fixed.ORIGINAL_VERSIONS), "").otherwise(parts["v"]).alias("version"),
    )


def with_song(rows: DataFrame) -> DataFrame:
    """Rows plus ``names`` (credited, folded), ``core`` (the title without any bracket or mix name) and ``text`` (all of it folded)."""
    label = ["artist", "title", "version"]
    filled = rows.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in label})
    known = spread(filled.select(*label).distinct())
    known = known.withColumn("_mixless", without_artist_tags(F.regexp_replace("title", MIXED, "")))
    known = with_forms(known.withColumns({"_t": F.col("_mixless"), "_v": F.lit("")}), title="_t", version="_v").select(*label, "_mixless", "names")
    sung = F.trim(F.regexp_replace("_mixless", fixed.FEATURED, ""))
    known = bind(known, _sung=F.when(sung != "", sung).otherwise(F.col("_mixless")))
    # Brackets at the end go one after the other, as long as something is left.
    for _ in range(3):
        head = F.regexp_extract("_sung", r"(?U)^(.*\S)\s*" + BRACKET, 1)
        known = bind(known, _sung=F.when(head != "", head).otherwise(F.col("_sung")))
    dash = r"^(.*\S.*) - (.*)$"
    by_dash = F.regexp_extract("_sung", dash, 2).rlike(VERSION_WORDS)
    known = bind(known, _core=F.when(by_dash, F.regexp_extract("_sung", dash, 1)).otherwise(F.col("_sung")))
    known = known.select(
        *label, F.array_sort("names").alias("names"), normalize(F.col("_core")).alias("core"),
        normalize(squeeze(F.concat_ws(" ", *label))).alias("text"),
    )
    return filled.join(known, label, "left")


def close_spelling(one: str, other: str) -> bool:
    return SequenceMatcher(None, one, other).ratio() >= RATIO


@lru_cache(maxsize=65536)
def same_name(one: str, other: str) -> bool:
    """One credited name spelled two ways: as many words and nearly the same letters, or two words or more that start the other."""
    a, b = one.split(), other.split()
    common = min(len(a), len(b))
    if len(a) == len(b):
        return one == other or close_spelling(one, other)
    return common > 1 and a[:common] == b[:common]


def shared_names(mine: list[str], theirs: list[str]) -> list[str]:
    """The names of ``mine`` that ``theirs`` credits too, however either spells them."""
    return [name for name in mine if any(same_name(name, other) for other in theirs)]


def _around(inner: list[str], outer: list[str]) -> set[str] | None:
    """The words of ``outer`` beside the first run of all words of ``inner`` in it; None: no such run."""
    for at in range(len(outer) - len(inner) + 1):
        if outer[at : at + len(inner)] == inner:
            return {*outer[:at], *outer[at + len(inner) :]}
    return None


def _mentions(names: list[str], text: str) -> bool:
    words = text.split()
    return any(name and _around(name.split(), words) is not None for name in names)


def likeness_of(mine: tuple, theirs: tuple) -> float:
    """How surely two songs (names, core, text) are one: ``SAME_CREDITS`` down to ``SAME_TITLE``, else 0."""
    (names_a, title_a, all_a), (names_b, title_b, all_b) = mine, theirs
    if not (title_a and title_b):
        return 0.0
    shared = bool(shared_names(names_a, names_b))
    if title_a == title_b:
        equal = set(names_a) == set(names_b)
        return SAME_CREDITS if equal else (SAME_TITLE, SHARED_CREDITS)[shared]
    if shared or _mentions(names_a, all_b) or _mentions(names_b, all_a):
        # One title may be the other and credited names, nothing else.
        credited = set(" ".join([*names_a, *names_b]).split())
        for one, other in ((title_a, title_b), (title_b, title_a)):
            added = _around(one.split(), other.split())
            if added is not None and added <= credited:
                return INSIDE
    numbers = [re.findall(r"\d+", t) for t in (title_a, title_b)]
    return CLOSE if shared and numbers[0] == numbers[1] and close_spelling(title_a, title_b) else 0.0


@F.pandas_udf(T.DoubleType())
def likeness(names_a: pd.Series, core_a: pd.Series, text_a: pd.Series, names_b: pd.Series, core_b: pd.Series, text_b: pd.Series) -> pd.Series:
    rows = zip(names_a, core_a, text_a, names_b, core_b, text_b, strict=True)
    return pd.Series([likeness_of((list(a), b, c), (list(d), e, f)) for a, b, c, d, e, f in rows], dtype="float64")


def _spans(core: Column) -> Column:
    """Every run of whole words of a title."""
    words = F.split(core, " ")
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.size(words)),
                lambda i: F.transform(F.sequence(i, F.size(words)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " ")),
            )
        )
    )


def _grams(core: Column) -> Column:
    """Numbered runs of ``GRAM`` letters: the second "an" of a title is another gram than the first."""
    marked = F.when(F.length(core) < GRAM, F.rpad(core, GRAM, " ")).otherwise(core)
    found = F.transform(F.sequence(F.lit(1), F.length(marked) - (GRAM - 1)), lambda i: F.substring(marked, i, F.lit(GRAM)))
    numbered = F.transform(found, lambda g, i: F.concat(g, F.size(F.filter(F.slice(found, 1, i), lambda o: o == g)).cast("string")))
    return F.when(F.length(core) > 0, numbered)


def _prefixes(cores: DataFrame) -> DataFrame:
    """(core, key) for the rarest grams of every title, enough of them that two close titles share one.

    Letters that match are RATIO / 2 of both titles or more. A gram of a title is spoiled by an unmatched letter of it (two
    grams each) or by one of the other title between its letters (one gram). That is most where the other title
    is as short as it can be, RATIO / (2 - RATIO) of this one, all of it matched. In any one order of grams the first shared one then
    stands among the first so many and one. Rare grams come first.
    """
    longest = 1 - RATIO / 2 * (1 + RATIO / (2 - RATIO))
    spoiled = F.floor(F.length("core") * longest * GRAM + 1e-9)
    grams = cores.select("core", spoiled.alias("_k"), F.explode(_grams(F.col("core"))).alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    # A title has as many grams as letters, so the window sorts small groups.
    order = Window.partitionBy("core").orderBy("n", "g")
    ranked = grams.join(often, "g").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.col("_k") + 1)
    digits = F.array_join(F.regexp_extract_all("core", F.lit(r"\d+"), F.lit(0)), ",")
    return ranked.select("core", F.concat_ws("|", "g", digits).alias("key"))


def similar_titles(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on, core, other) for titles that are equal, lie in one another by whole words, or may be close spellings.

    left and right [on, core], distinct. Nothing that can reach a likeness above 0 is left out; rows that share no title run and no
    rare gram never meet.
    """
    a, b = left.where("core != ''"), right.where("core != ''").withColumnRenamed("core", "other")
    down = a.withColumn("key", F.explode(_spans(F.col("core")))).join(b.withColumn("key", F.col("other")), [*on, "key"])
    up = b.withColumn("key", F.explode(_spans(F.col("other")))).join(a.withColumn("key", F.col("core")), [*on, "key"])
    cores = a.select("core").union(b.select("other")).distinct()
    keys = cut_lineage(_prefixes(cores))
    close = a.join(keys, "core").join(b.join(keys.withColumnRenamed("core", "other"), "other"), [*on, "key"])
    near = F.least(F.length("core"), F.length("other")) * (2 - RATIO) >= F.greatest(F.length("core"), F.length("other")) * RATIO - 1e-9
    columns = [*on, "core", "other"]
    return down.select(*columns).union(up.select(*columns)).union(close.where(near).select(*columns)).distinct()


def same_songs(
    left: DataFrame, right: DataFrame, on: list[str] | None = None, least: float = SAME_TITLE, forms: DataFrame | None = None
) -> DataFrame:
    """(on, left_id, right_id, likeness) of every pair of rows that name one song, ``least`` or more.

    left and right [id, on, artist, title, version]. Titles meet first, then distinct songs are compared, and ids join
    in at the end: a label that stands in many rows is folded, met and judged once. Below ``SAME_TITLE`` + there are pairs
    of one title by others; ask for ``CLOSE`` or more where a title such as "Intro" is common. ``forms`` holds (artist, title, version, names, core,
    text) of every label, none null, where they are known already.
    """
    on = on or []
    label = ["artist", "title", "version"]
    a, b = ((with_song(x) if forms is None else x.join(forms, label)).select("id", *on, *SONG) for x in (left, right))
    a, b = cut_lineage(a), cut_lineage(b)
    mine = a.select(*on, *(F.col(c).alias(f"a_{c}") for c in SONG)).distinct()
    theirs = b.select(*on, *(F.col(c).alias(f"b_{c}") for c in SONG)).distinct()
    met = similar_titles(a.select(*on, "core").distinct(), b.select(*on, "core").distinct(), on)
    met = met.withColumnsRenamed({"core": "a_core", "other": "b_core"})
    pairs = met.join(mine, [*on, "a_core"]).join(theirs, [*on, "b_core"])
    if least > SAME_TITLE:
        # Credits decide: a pair needs a word in common between the names of one and the label of the other.
        credited = F.arrays_overlap(F.split(F.array_join("a_names", " "), " "), F.split("b_text", " ")) | F.arrays_overlap(
            F.split(F.array_join("b_names", " "), " "), F.split("a_text", " ")
        )
        pairs = pairs.where(credited | _may_be_same_name(F.col("a_names"), F.col("b_names")))
    pairs = spread(pairs).withColumn("likeness", likeness(*(f"a_{c}" for c in SONG), *(f"b_{c}" for c in SONG)))
    found = cut_lineage(pairs.where(F.col("likeness") >= least))
    one = a.select(F.col("id").alias("left_id"), *on, *(F.col(c).alias(f"a_{c}") for c in SONG))
    two = b.select(F.col("id").alias("right_id"), *on, *(F.col(c).alias(f"b_{c}") for c in SONG))
    rows = found.join(one, [*on, *(f"a_{c}" for c in SONG)]).join(two, [*on, *(f"b_{c}" for c in SONG)])
    return rows.select(*on, "left_id", "right_id", "likeness")


def _may_be_same_name(mine: Column, theirs: Column) -> Column:
    """A cheap bound of ``same_name``: names of about one length that share enough letters."""
    letters = lambda name: F.split(name, "")
    alike = lambda m, t: (
        (F.least(F.length(m), F.length(t)) * (2 - RATIO) >= F.greatest(F.length(m), F.length(t)) * RATIO - 1e-9)
        & (F.size(F.array_intersect(letters(m), letters(t))) > 0)
    )
    return F.exists(mine, lambda m: F.exists(theirs, lambda t: alike(m, t)))
