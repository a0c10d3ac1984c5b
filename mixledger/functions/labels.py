"""Label algebra: the forms in which two song labels are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .steps import bind
from .text import col, compat_fold_all, key_join, squeeze, words_of

FORMS = [
    "identity_key",
    "label_key",
    "label_key_exact",
    "credit_key",
    "credit_key_exact",
    "song_key",
    "base_key",
    "credit_base_key",
    "names",
    "title_form",
]


def without_inner_tag(text: Column) -> Column:
    return F.regexp_replace(text, fixed.INNER_TAG, "")


def without_artist_tags(text: Column) -> Column:
    return squeeze(F.regexp_replace(text, fixed.ARTIST_TAG, ""))


def base_title(title: Column | str) -> Column:
    """The title without a trailing bracketed mix name."""
    title = col(title)
    found = [F.regexp_extract(title, p, 1) for p in (fixed.TRAILING_VERSION, fixed.TAGGED_VERSION)]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found), title)


def without_and(words: Column) -> Column:
    kept = F.array_join(F.filter(F.split(words, " "), lambda w: w != "and"), " ")
    return F.when(kept != "", kept).otherwise(words)


def _rest(title: Column, kept: Column) -> Column:
    """``kept`` unless a pattern took the whole title."""
    return F.when(kept != "", kept).otherwise(title)


PIECES = [
    "_artist",
    "_title",
    "_version",
    "_plain",
    "_plain_v",
    "_plain_m",
    "_plain_vm",
    "_sung",
    "_sung_v",
    "_sung_m",
    "_sung_vm",
    "_base",
    "_sung_base",
]


def with_forms(
    df: DataFrame, artist: str = "artist", title: str = "title", version: str = "version"
) -> DataFrame:
    """``df`` plus the comparison forms of a label (``FORMS``).

    One Arrow crossing folds every piece of a label; call it on distinct labels. The pieces are
    built in steps so that no pattern runs twice.
    """

    def bracketed(name: str) -> Column:
        return F.concat(F.col(name), F.lit(" ("), F.col("_version"), F.lit(")"))

    title_text = F.coalesce(F.col(title), F.lit(""))
    rows = bind(
        df,
        _artist=F.coalesce(F.col(artist), F.lit("")),
        _title=title_text,
        _version=F.coalesce(F.col(version), F.lit("")),
        _plain=_rest(title_text, F.regexp_replace(title_text, fixed.ORIGINAL_SUFFIX, "")),
        _credit=without_artist_tags(F.coalesce(F.col(artist), F.lit(""))),
    )
    # Featured credits are cut out of three texts in one step.
    cut = {}
    for text in ("_plain", "_title", "_credit"):
        cut[f"{text}_cut"] = F.trim(F.regexp_replace(text, fixed.FEATURED, ""))
        if text != "_title":
            cut[f"{text}_in"] = F.regexp_extract_all(text, F.lit(fixed.FEATURED), F.lit(1))
            cut[f"{text}_bare"] = F.regexp_extract_all(text, F.lit(fixed.FEATURED), F.lit(2))
    rows = bind(rows, **cut)

    def found(text: str) -> Column:
        both = F.zip_with(f"{text}_in", f"{text}_bare", lambda a, b: F.when(a != "", a).otherwise(b))
        return F.when(F.col(f"{text}_cut") != "", both).otherwise(F.array().cast("array<string>"))

    rows = bind(
        rows,
        _sung=_rest(F.col("_plain"), F.col("_plain_cut")),
        _sung_title=_rest(F.col("_title"), F.col("_title_cut")),
        _credit_parts=F.concat(
            F.array(_rest(F.col("_credit"), F.col("_credit_cut"))),
            found("_credit"),
            F.transform(found("_plain"), without_artist_tags),
        ),
    )
    rows = bind(
        rows,
        _plain_v=bracketed("_plain"),
        _sung_v=bracketed("_sung"),
        _plain_m=without_inner_tag(F.col("_plain")),
        _plain_vm=without_inner_tag(bracketed("_plain")),
        _sung_m=without_inner_tag(F.col("_sung")),
        _sung_vm=without_inner_tag(bracketed("_sung")),
        _base=without_inner_tag(base_title("_title")),
        _sung_base=without_inner_tag(base_title("_sung_title")),
        _names=F.flatten(F.transform("_credit_parts", lambda p: F.split(p, fixed.CREDIT_SEPARATOR))),
    )
    rows = rows.select(
        *df.columns, compat_fold_all(F.concat(F.array(*PIECES), "_names")).alias("_folded")
    )
    rows = bind(rows, _words=F.transform("_folded", words_of))
    at = {name: F.element_at("_words", i + 1) for i, name in enumerate(PIECES)}
    bare = at["_version"].isin(fixed.ORIGINAL_VERSIONS) | (at["_version"] == "")

    def pick(name: str) -> Column:
        return F.when(bare, at[name[0]]).otherwise(at[name[1]])

    credited = F.array_remove(
        F.array_sort(F.array_distinct(F.slice("_words", len(PIECES) + 1, F.size("_words")))), ""
    )
    rows = bind(
        rows,
        _found=credited,
        _mix=without_and(pick(("_plain_m", "_plain_vm"))),
        title_form=without_and(pick(("_sung_m", "_sung_vm"))),
    )
    names = F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(at["_artist"]))
    credit = F.array_join(names, "\u001f")
    return bind(
        rows,
        names=names,
        identity_key=key_join([at["_artist"], at["_title"], at["_version"]]),
        label_key=key_join([at["_artist"], F.col("_mix")]),
        label_key_exact=key_join([at["_artist"], pick(("_plain", "_plain_v"))]),
        credit_key=key_join([credit, F.col("title_form")]),
        credit_key_exact=key_join([credit, pick(("_sung", "_sung_v"))]),
        song_key=key_join([at["_artist"], at["_title"]]),
        base_key=key_join([at["_artist"], without_and(at["_base"])]),
        credit_base_key=key_join([credit, without_and(at["_sung_base"])]),
    ).drop("_folded", "_words", "_mix", "_found")


def starts(one: Column, other: Column) -> Column:
    """One credited name spelled out further: two words or more that begin the other."""
    a, b = F.split(one, " "), F.split(other, " ")

    def begins(short: Column, long: Column) -> Column:
        return (F.size(short) >= 2) & (F.slice(long, 1, F.size(short)) == short)

    return (one == other) | begins(a, b) | begins(b, a)


def similar_credits(mine: Column, theirs: Column) -> Column:
    """Overlapping but not equal credits; titles are compared by the caller."""

    def covered(fewer: Column, more: Column) -> Column:
        return F.forall(fewer, lambda n: F.exists(more, lambda m: starts(n, m)))

    equal_size = F.size(mine) == F.size(theirs)
    return (mine != theirs) & F.when(F.size(mine) < F.size(theirs), covered(mine, theirs)).when(
        equal_size, covered(mine, theirs)
    ).otherwise(covered(theirs, mine))


def stems(names: Column) -> Column:
    """The first two words of each name: a key shared by names that start one another."""
    return F.array_distinct(F.transform(names, lambda n: F.substring_index(n, " ", 2)))


def version_markers(text: Column) -> Column:
    """Mix words in already normalized text."""
    return F.array_intersect(F.split(text, " "), F.array(*(F.lit(m) for m in fixed.VERSION_MARKERS)))


def label(artist: Column | str, title: Column | str, version: Column | str) -> Column:
    """"Artist - Title (Version)"."""
    v = F.coalesce(col(version), F.lit(""))
    return F.concat(
        col(artist), F.lit(" - "), col(title), F.when(v != "", F.concat(F.lit(" ("), v, F.lit(")"))).otherwise("")
    )


def clean_key(value: Column | str) -> Column:
    """A musical, Camelot or Open Key label, or null."""
    text = F.trim(col(value))
    return F.when(text.rlike(fixed.KEY_PATTERN), text)


def key_order(value: Column | str) -> Column:
    """Sort key of a musical key: wheel position first, then note names."""
    value = col(value)
    wheel = value.rlike(fixed.WHEEL_PATTERN)
    number = F.regexp_extract(value, fixed.WHEEL_PATTERN, 1).try_cast("int")
    letter = F.regexp_extract(value, fixed.WHEEL_PATTERN, 2)
    return F.when(
        value.isNotNull(),
        F.struct(
            F.when(wheel, 0).otherwise(1).alias("class"),
            F.when(wheel, number).otherwise(0).alias("number"),
            F.when(wheel, letter).otherwise(F.lower(value)).alias("name"),
        ),
    )
