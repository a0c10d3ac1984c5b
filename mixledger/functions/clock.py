"""Clock texts, mixed time numbers, and dates in titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Time patterns and epochs.
CLOCK = r"^(?:(\d{1,2}):)?(\d{1,3}):([0-5]\d)$"
CORE_DATA_EPOCH = 978307200
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def clock_seconds(text: Column | str) -> Column:
    """Seconds of "mm:ss" or "h:mm:ss", else null."""
    t = F.trim(col(text))
    hours, minutes, seconds = (F.regexp_extract(t, CLOCK, i).try_cast("double") for i in (1, 2, 3))
    return F.when(t.rlike(CLOCK), F.coalesce(hours, F.lit(0.0)) * 3600 + minutes * 60 + seconds)


def clock(seconds: Column | str) -> Column:
    """ "06:00" under an hour, "1:02:03" after."""
    s = F.greatest(F.bround(col(seconds)), F.lit(0.0)).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def cue_seconds(cue: Column | str) -> Column:
    """A cue of a wiki list: whole minutes ("042"), a clock, or unknown with a question mark."""
    t = F.trim(col(cue))
    minutes = F.when(t.rlike(r"^\d{1,3}$"), t.try_cast("double") * 60)
    return F.when(F.contains(t, F.lit("?")), None).otherwise(F.coalesce(clock_seconds(t), minutes))


def when(value: Column | str) -> Column:
    """A timestamp from ISO text, or a number of seconds since 2001 or 1970, or milliseconds."""
    t = F.trim(col(value).cast("string"))
    number = t.try_cast("double")
    seconds = (
        F.when(number > 1e11, number / 1000).when(number > 1e9, number).when(number > 0, number + CORE_DATA_EPOCH)
    )
    return F.when(number.isNotNull(), F.timestamp_seconds(seconds)).otherwise(F.try_to_timestamp(t))


def dates(text: Column | str) -> Column:
    """Every day a text may name; day and month are read both ways round."""
    t = F.lower(col(text))

    def read(pattern: str, *orders: tuple[int, int, int], month: str | None = None) -> Column:
        """The days of all places where the pattern stands, found once; the groups are read from each place."""

        def day(place: Column, y: int, m: int, d: int) -> Column:
            part = lambda i: F.regexp_extract(place, pattern, i)
            year = F.when(F.length(part(y)) == 2, F.concat(F.lit("20"), part(y))).otherwise(part(y))
            number = F.lit(month) if month else F.lpad(part(m), 2, "0")
            return F.try_to_date(F.concat_ws("-", year, number, F.lpad(part(d), 2, "0")), "yyyy-MM-dd")

        places = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.flatten(F.transform(places, lambda p: F.array(*(day(p, *order) for order in orders))))

    iso = r"\b((?:19|20)\d{2})[-./](\d{1,2})[-./](\d{1,2})\b"
    short = r"\b(\d{1,2})[-./](\d{1,2})[-./]((?:19|20)?\d{2})\b"
    named = []
    for number, name in enumerate(MONTHS, 1):
        first = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{name}[a-z]*\.?,?\s+((?:19|20)\d{{2}})\b"
        after = rf"\b{name}[a-z]*\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+((?:19|20)\d{{2}})\b"
        named += [read(pattern, (2, 0, 1), month=f"{number:02d}") for pattern in (first, after)]
    # A text that holds no month's name is asked once, not for every month.
    none = F.array().cast("array<date>")
    named = F.when(t.rlike("|".join(MONTHS)), F.concat(*named)).otherwise(none)
    found = F.concat(read(iso, (1, 2, 3)), read(short, (3, 2, 1), (3, 1, 2)), named)
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def same_day(one: Column, other: Column) -> Column:
    """Do two sets of possible days meet within a day? Null when either names none."""
    meets = F.exists(one, lambda a: F.exists(other, lambda b: F.abs(F.date_diff(a, b)) <= 1))
    return F.when((F.size(one) > 0) & (F.size(other) > 0), meets)
