"""Text folding and cleaning.

Spark has no Unicode NFKC, casefold or NFKD, so those three steps alone run in Arrow batches;
the rest stays in generated code. Call them on distinct labels.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _compat(text):
    if text is None:
        return None
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def _plain(text):
    if text is None:
        return None
    if text.isascii():
        return text.lower()
    split = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in split if not unicodedata.combining(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def compat_fold_all(parts: pd.Series) -> pd.Series:
    return parts.map(lambda row: None if row is None else [_compat(x) for x in row])


@F.pandas_udf(T.StringType())
def compat_fold(text: pd.Series) -> pd.Series:
    return text.map(_compat, na_action="ignore")


@F.pandas_udf(T.StringType())
def _accent_fold(text: pd.Series) -> pd.Series:
    return text.map(_plain, na_action="ignore")


def accent_fold(text: Column | str) -> Column:
    """Text without case and accents; what is ASCII already never leaves generated code."""
    text = col(text)
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(_accent_fold(F.when(~plain, text)))


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1C-\x1F]+", " "))


def words_of(folded: Column) -> Column:
    """Matching form of already folded text; a symbol-only label keeps its text."""
    words = F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))
    return F.when(words != "", words).otherwise(squeeze(folded))


def normalize(text: Column | str) -> Column:
    return words_of(compat_fold(col(text)))


def search_fold(text: Column | str) -> Column:
    """Case- and accent-insensitive search text."""
    folded = accent_fold(col(text))
    for letter, plain in fixed.FOLD_LETTERS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return squeeze(folded)


def safe_text(text: Column | str, *, lines: bool = False) -> Column:
    """Text from outside without control characters or hidden marks."""
    shown = F.regexp_replace(F.coalesce(col(text), F.lit("")), fixed.HIDDEN_MARKS, "")
    if lines:
        shown = F.regexp_replace(shown, fixed.CONTROL_SPACES_BUT_LINES, " ")
        return F.regexp_replace(shown, fixed.CONTROLS_BUT_LINES, "")
    shown = F.regexp_replace(shown, fixed.CONTROL_SPACES, " ")
    return F.regexp_replace(shown, fixed.CONTROLS, "")


def key_join(parts: Sequence[Column]) -> Column:
    """Parts joined by a pipe, with pipes and percent signs inside them escaped."""
    escaped = [F.replace(F.replace(p, F.lit("%"), F.lit("%25")), F.lit("|"), F.lit("%7C")) for p in parts]
    return F.concat_ws("|", *escaped)


def safe_name(text: Column | str, size: int = 70) -> Column:
    """A name fit for a file: ASCII letters, digits and a few marks."""
    plain = F.regexp_replace(col(text), r"[^A-Za-z0-9._ -]+", "_")
    return F.regexp_replace(F.substring(plain, 1, size), r"^[ .]+|[ .]+$", "")


def register(spark) -> None:
    """The functions that SQL users call by name."""
    spark.udf.register("compat_fold", compat_fold)
    spark.udf.register("accent_fold", _accent_fold)
