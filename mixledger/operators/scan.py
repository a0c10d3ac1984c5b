"""Ordered scans over groups of any size.

A window such as ``lag() over (partition by set order by at)`` sends one whole group to one
task. Here a large group is cut into chunks along its order (``chunk`` must never decrease as the
order goes up, e.g. ``floor(at / 3600)``), each chunk is scanned on its own, and what has to cross a
chunk border travels through a small table with one row per non-empty chunk of a large group. Only
that table is scanned per whole group. Small groups keep the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = "_chunk"
LIGHT_ROWS = 1_000_000
UP = Window.unboundedPreceding
DOWN = Window.unboundedFollowing


@dataclass(frozen=True)
class Scan:
    """One value carried along the order of a group.

    kind: ``number`` (1-based position), ``lag``, ``lead``, ``sum`` and ``max`` (running, current
    row included), ``max_before`` (running, current row left out), ``last`` (latest non-null so
    far, current row included), ``last_before`` and ``first_after`` (nearest non-null neighbour,
    current row left out).
    """

    name: str
    kind: str
    value: Column | None = None


@dataclass(frozen=True)
class Hot:
    """Which groups are too large for one task: none, those in ``frame``, or every one."""

    frame: DataFrame | None = None
    every: bool = False


def hot_groups(df: DataFrame, keys: Sequence[str], light_rows: int | None = LIGHT_ROWS) -> Hot:
    """The groups above ``light_rows`` rows, found by a counting job that combines before its
    shuffle. At most rows / ``light_rows`` of them exist. ``None`` treats every group as large."""
    if light_rows is None:
        return Hot(every=True)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > light_rows).select(*keys)
    return Hot() if large.isEmpty() else Hot(cut_lineage(large))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    scans: Sequence[Scan],
    *,
    light_rows: int | None = LIGHT_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """``df`` with one column per scan. ``order`` must be unique within a group, ascending.

    Pass ``hot`` to share one look at group sizes among several scans; its columns may be a subset
    of ``keys``. While no group is large this is one plain window.
    """
    keys, order = list(keys), list(order)
    if hot is None:
        hot = hot_groups(df, keys, light_rows)
    if hot.frame is None and not hot.every:
        return _plain(df, keys, order, scans)
    if hot.every:
        rows = df.withColumn(CHUNK, chunk)
    else:
        large = hot.frame.withColumn("_hot", F.lit(True))
        rows = df.join(large, hot.frame.columns, "left").withColumn(CHUNK, F.when(F.col("_hot"), chunk))
    # The rows are read for the chunk borders and for the scan itself.
    rows = cut_lineage(rows)
    for s in scans:
        if s.value is not None:
            rows = rows.withColumn(f"_v_{s.name}", s.value)
    position = F.struct(*order)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(CHUNK)

    totals, carries, ahead, joined = [], [], [], []
    for s in scans:
        v, total, carry = F.col(f"_v_{s.name}"), f"_t_{s.name}", f"_c_{s.name}"
        if s.kind == "number":
            totals.append(F.count(F.lit(1)).alias(total))
            carries.append((carry, F.sum(total).over(across.rowsBetween(UP, -1))))
            ahead.append((f"_l_{s.name}", F.row_number().over(local)))
            joined.append(
                (s.name, F.col(f"_l_{s.name}") + F.coalesce(F.col(carry), F.lit(0)))
            )
        elif s.kind == "sum":
            totals.append(F.sum(v).alias(total))
            carries.append((carry, F.sum(total).over(across.rowsBetween(UP, -1))))
            ahead.append((f"_l_{s.name}", F.sum(v).over(local.rowsBetween(UP, 0))))
            joined.append(
                (s.name, F.coalesce(F.col(f"_l_{s.name}"), F.lit(0)) + F.coalesce(F.col(carry), F.lit(0)))
            )
        elif s.kind in ("max", "max_before"):
            last = 0 if s.kind == "max" else -1
            totals.append(F.max(v).alias(total))
            carries.append((carry, F.max(total).over(across.rowsBetween(UP, -1))))
            ahead.append((f"_l_{s.name}", F.max(v).over(local.rowsBetween(UP, last))))
            joined.append((s.name, F.greatest(F.col(f"_l_{s.name}"), F.col(carry))))
        elif s.kind in ("last", "last_before"):
            last = 0 if s.kind == "last" else -1
            totals.append(F.max_by(F.struct(v.alias("v")), F.when(v.isNotNull(), position)).alias(total))
            carries.append(
                (carry, F.last(f"{total}.v", ignorenulls=True).over(across.rowsBetween(UP, -1)))
            )
            ahead.append(
                (f"_l_{s.name}", F.last(v, ignorenulls=True).over(local.rowsBetween(UP, last)))
            )
            joined.append((s.name, F.coalesce(F.col(f"_l_{s.name}"), F.col(carry))))
        elif s.kind == "first_after":
            totals.append(F.min_by(F.struct(v.alias("v")), F.when(v.isNotNull(), position)).alias(total))
            carries.append(
                (carry, F.first(f"{total}.v", ignorenulls=True).over(across.rowsBetween(1, DOWN)))
            )
            ahead.append(
                (f"_l_{s.name}", F.first(v, ignorenulls=True).over(local.rowsBetween(1, DOWN)))
            )
            joined.append((s.name, F.coalesce(F.col(f"_l_{s.name}"), F.col(carry))))
        elif s.kind in ("lag", "lead"):
            back = s.kind == "lag"
            step, pick = (F.lag, F.max_by) if back else (F.lead, F.min_by)
            totals.append(pick(F.struct(v.alias("v")), position).alias(total))
            carries.append((carry, step(F.col(total)).over(across)["v"]))
            ahead.append((f"_l_{s.name}", step(F.struct(v.alias("v"))).over(local)))
            joined.append(
                (
                    s.name,
                    F.when(F.col(f"_l_{s.name}").isNotNull(), F.col(f"_l_{s.name}.v")).otherwise(
                        F.col(carry)
                    ),
                )
            )
        else:
            raise ValueError(f"unknown scan kind {s.kind}")

    border = rows.where(F.col(CHUNK).isNotNull()).groupBy(*keys, CHUNK).agg(*totals)
    border = border.select(*keys, CHUNK, *(c.alias(n) for n, c in carries))
    rows = rows.withColumns(dict(ahead))
    rows = rows.join(border, [*keys, CHUNK], "left").withColumns(dict(joined))
    return rows.select(*df.columns, *(s.name for s in scans))


def _plain(df: DataFrame, keys: list[str], order: list[str], scans: Sequence[Scan]) -> DataFrame:
    """The same scans as windows over whole groups."""
    w = Window.partitionBy(*keys).orderBy(*order)
    made = {}
    for s in scans:
        made[s.name] = {
            "number": lambda v: F.row_number().over(w),
            "lag": lambda v: F.lag(v).over(w),
            "lead": lambda v: F.lead(v).over(w),
            "sum": lambda v: F.coalesce(F.sum(v).over(w.rowsBetween(UP, 0)), F.lit(0)),
            "max": lambda v: F.max(v).over(w.rowsBetween(UP, 0)),
            "max_before": lambda v: F.max(v).over(w.rowsBetween(UP, -1)),
            "last": lambda v: F.last(v, ignorenulls=True).over(w.rowsBetween(UP, 0)),
            "last_before": lambda v: F.last(v, ignorenulls=True).over(w.rowsBetween(UP, -1)),
            "first_after": lambda v: F.first(v, ignorenulls=True).over(w.rowsBetween(1, DOWN)),
        }[s.kind](s.value)
    return df.select("*", *(c.alias(n) for n, c in made.items()))
