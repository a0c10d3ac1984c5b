"""Shards of near-equal bytes, tokens and rows by vector bin packing of groups of equal texts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import table, word_count

SHARDS = 40
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
#: A group above this share of any total is placed on the driver: at most three times 20,000 items.
HEAVY_SHARE = 1 / 20_000
#: A group above this share of a shard's fair load is cut into pieces; below it, it stays whole.
WHOLE_SHARE = 1 / 4
#: Light groups that one task places on average.
SLICE_GROUPS = 2_000
DIMS = ["bytes", "tokens", "n"]
#: What a dimension counts in the dot product. The law is ``bytes``: where a text is so odd that not
#: all three can be even (many tokens in few bytes), bytes decide and the others yield.
DIM_WEIGHTS = (1.0, 1 / 16, 1 / 16)


def place(
    loads: np.ndarray, room: np.ndarray, turn: int = 0, weights: tuple = DIM_WEIGHTS
) -> np.ndarray:
    """Shard of each item: where the dot product of item and residual capacity is highest.

    ``loads`` (items x dims) are placed in the given order; ``room`` (shards x dims) is what each
    shard has left, in the same units, and is lowered in place. Each dimension is scaled by its
    mean room and weighted by ``weights``. Ties go to the first shard counted from ``turn``.
    """
    scale = np.maximum(np.abs(room).mean(axis=0), 1e-9)
    rest = np.roll(room / scale, -turn, axis=0)
    items = loads / scale
    pull = np.array(weights[: loads.shape[1]])
    shards = np.empty(len(items), np.int64)
    for i, item in enumerate(items):
        best = int(np.argmax(rest @ (item * pull)))
        rest[best] -= item
        shards[i] = best
    room[:] = np.roll(rest, turn, axis=0) * scale
    return (shards + turn) % len(room)


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", heavy_share: float = HEAVY_SHARE, slice_groups: int = SLICE_GROUPS) -> DataFrame:
    """(id, size, text_crc32, shard, slot, group) for every row of ``docs``.

    Groups are equal texts; a null text is a group of its own. Each group is a vector of bytes,
    tokens and rows. Few groups can be heavier than ``heavy_share`` of a total: they are placed
    first, on the driver, largest first; one that alone is more than ``WHOLE_SHARE`` of a shard
    is cut into pieces by a hash of the id, since no shard could hold it. The light groups are
    hashed into slices of a bounded number of groups; every slice is placed by its own task into
    its own part of the room that the heavy ones left. No task sees more than one slice.

    slot numbers the rows of a shard without gaps: rows are ranked inside (shard, slice), slices
    are counted, and counts are summed in slice order. Rows that are equal in id and text are
    interchangeable. Null ids are allowed; empty tables give an empty result.
    """
    text = F.col(text_col)
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("bytes"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
            word_count(text).alias("tokens"),
            F.when(text.isNotNull(), F.md5(text.cast("binary"))).otherwise("").alias("g"),
        )
    )
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = cut_lineage(rows.groupBy("g").agg(*sums))
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS], F.count("*").alias("groups")).first()
    totals = np.array([float(total[d] or 0) for d in DIMS])
    share = F.greatest(*[F.col(d) / F.lit(max(t, 1.0)) for d, t in zip(DIMS, totals)])
    cut = max(heavy_share, 1e-12)
    heavy = groups.where(share > cut)
    pieces = F.ceil(share * shards / WHOLE_SHARE)
    big = heavy.withColumn("pieces", F.when(share * shards > WHOLE_SHARE, pieces).otherwise(1))

    # Pieces of a cut group, by a hash of the id; sums combine before the shuffle.
    piece = F.pmod(F.xxhash64("_id", F.lit("piece")), F.col("pieces")).cast("int")
    cuts = big.where("pieces > 1").select("g", "pieces")  # at most shards / WHOLE_SHARE per dimension
    parted = rows.join(F.broadcast(cuts), "g").withColumn("piece", piece)
    parts = parted.groupBy("g", "piece").agg(*sums).union(
        big.where("pieces = 1").select("g", F.lit(0).alias("piece"), *DIMS)
    )
    items = parts.toPandas()  # bounded by 3 / heavy_share groups and their pieces
    fair = totals / shards
    room = np.tile(fair, (shards, 1))
    order = (items[DIMS] / np.maximum(totals, 1)).max(axis=1)
    items = items.assign(_w=order).sort_values(["_w", "g", "piece"], ascending=[False, True, True])
    items["shard"] = place(items[DIMS].to_numpy(float).reshape(-1, 3), room)
    spark = docs.sparkSession
    schema = "g string, piece int, shard int"
    rows_of = items[["g", "piece", "shard"]].values.tolist()
    placed = spark.createDataFrame([(g, int(p), int(s)) for g, p, s in rows_of], schema)

    slices = max(1, math.ceil((total["groups"] or 0) / slice_groups))
    left = totals - items[DIMS].to_numpy(float).reshape(-1, 3).sum(axis=0)
    slice_of = F.pmod(F.xxhash64("g", F.lit("slice")), F.lit(slices)).cast("int")

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        loads = frame[DIMS].to_numpy(float)
        weight = (loads / np.maximum(totals, 1)).max(axis=1)
        order = np.lexsort((frame["g"].to_numpy(str), -weight))
        mine = room * (loads.sum(axis=0) / np.maximum(left, 1))
        turn = int(frame["slice"].iloc[0])
        out = np.empty(len(frame), np.int64)
        out[order] = place(loads[order], mine, turn % shards)
        return pd.DataFrame({"g": frame["g"], "piece": 0, "shard": out})

    light = groups.where(share <= cut).withColumn("slice", slice_of)
    light_placed = light.groupBy("slice").applyInPandas(fill, schema)

    keyed = rows.join(F.broadcast(big.select("g", "pieces")), "g", "left").withColumns(
        {"piece": F.when(F.col("pieces") > 1, piece).otherwise(0), "is_heavy": F.col("pieces").isNotNull()}
    )
    # Heavy groups are a bounded table, so their rows never meet in one task.
    of_heavy = keyed.where("is_heavy").join(F.broadcast(placed), ["g", "piece"])
    of_light = keyed.where(~F.col("is_heavy")).join(light_placed, ["g", "piece"])
    spread = F.pmod(F.xxhash64("_id", F.lit("slot")), F.lit(slices)).cast("int")
    cols = ["_id", "bytes", "crc", "g", "piece", "shard"]
    every = of_heavy.select(*cols, spread.alias("slice")).union(of_light.select(*cols, slice_of.alias("slice")))
    every = cut_lineage(every)
    counts = every.groupBy("shard", "slice").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "slice").orderBy("_id", "g")
    ranked = every.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, ["shard", "slice"]).select(
        F.col("_id").alias(id_col),
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("start") + F.col("rank")).cast("long").alias("slot"),
        F.when(F.col("g") != "", F.col("g")).alias("group"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """The digest of an assignment by the law ``bytes``: sizes near equal, no grown shard."""
    return assign(docs, shards, id_col).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_documents(table(spark, folder, "documents"))
