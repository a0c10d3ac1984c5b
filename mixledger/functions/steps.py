"""Named intermediate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns computed once, however often later steps use them.

    The columns come out of a one-row ``inline``. A long chain of projections would have the
    optimizer inline them into each other and derive constraints from every alias, which grows
    exponentially; a generator stops both and stays inside generated code.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*(value.alias(name) for name, value in columns.items()))
    return df.select(*kept, F.inline_outer(F.array(row)))
