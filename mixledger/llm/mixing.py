"""Mixing sources to target weights by fixed-length token blocks, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import same, table, word_count

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most so often.
MAX_EPOCHS = 3
#: Words of a block.
BLOCK_WORDS = 128
#: Blocks of an output shard.
SHARD_BLOCKS = 1024
#: Rounds of the index permutation.
ROUNDS = 24
#: Documents that one task of the packing ranks on average.
CHUNK_ROWS = 500
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size): its words in the mix.

    All sizes together are shared by weight. A target stops at ``max_epochs`` times its source's
    size, and what is over is shared again by weight among the others until none is above. Sources
    reach their stop in the order of stop / weight, so a running sum over that order gives the
    common rate of those that are not stopped. The windows run over sources, not rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.select("source", "source_size", kinds[turn].alias("weight"))
    stop = (F.col("source_size") * max_epochs).cast("double")
    named = named.withColumns({"stop": stop, "at": stop / F.col("weight")})
    every = Window.orderBy("at", F.col("source").isNull(), "source")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(whole).cast("double")
    stopped = F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    active = F.sum("weight").over(every.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rate = (total - stopped) / active
    rated = named.withColumn("rate", rate)
    first = F.min(F.when(F.col("rate") <= F.col("at"), F.struct("at", "rate"))).over(whole)
    final = rated.withColumn("final", first["rate"])
    return final.select(
        "source", "source_size", F.least("stop", F.coalesce("final", F.lit(0.0)) * F.col("weight")).alias("target")
    )


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of 0 .. n - 1 at ``index``.

    Swap-or-not: every round pairs x with (k - x) mod n for a round key k, and a hash of the pair's
    larger member decides whether they change places. Each round is its own inverse, so
    the whole is one to one for every n, needs no table and can be asked at any index.
    """

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)
    # Never null: else a null filter that the optimizer infers would work the rounds out again.
    return F.coalesce(found, F.lit(0).cast("long"))


def pack(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with their place in the word stream of their source, sources with sizes).

    The stream of a source strings its documents in a pseudorandom order and is cut into blocks of
    ``block_words`` words. Places come from two running sums: inside (source, chunk), where a
    chunk is a hash bucket with a bounded number of documents, and over the chunks.
    """
    text = F.col(text_col)
    rows = cut_lineage(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            word_count(text).alias("size"),
            F.xxhash64(text).alias("h"),
        )
    )
    n = rows.count()
    chunk = F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(max(1, math.ceil(n / CHUNK_ROWS)))).cast("int")
    rows = rows.withColumn("chunk", chunk)
    in_chunk = Window.partitionBy("source", "chunk")
    order = in_chunk.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id", "size", "h")
    sums = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(over), F.lit(0)).alias("from")
    )
    inside = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("until", inside).join(
        starts, same(F.col("source"), F.col("s")) & (F.col("chunk") == F.col("c"))
    )
    stream = placed.select("_id", "source", "size", "h", (F.col("from") + F.col("until") - F.col("size")).alias("start"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return stream, sizes


def plan(sizes: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its target, its blocks, and the slots of the mix that it fills.

    slots is the target in blocks of the source's own mean length, so that a short last block
    costs nothing, and never more than ``max_epochs`` uses of each block. first_slot sums the slots of the sources
    before, in name order: together they number the slots of the mix.
    """
    sized = targets(sizes, weights, max_epochs)
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    wanted = F.round(F.col("target") * blocks / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    slots = F.least(wanted, blocks * max_epochs)
    before = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    counted = sized.withColumns({"blocks": blocks, "slots": slots})
    return counted.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def slots(spark: SparkSession, planned: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, source, block, epoch): what fills every slot of every output shard.

    The draw is without replacement: a permutation deals the slots of the sources over all
    shards, so the counts of a shard are multinomial under the condition that every source
    fills its slots exactly once over (a multivariate hypergeometric draw), and no source strays
    from its target by chance. A slot's rank in its source, mapped by the permutation of that
    source, names the block; ranks beyond the number of blocks start another epoch.
    """
    total = planned.agg(F.sum("slots")).first()[0] or 0
    index = spark.range(total).select((F.col("id") / shard_blocks).cast("long").alias("shard"), F.col("id").alias("slot"))
    drawn = index.withColumn("drawn", permuted(F.col("slot"), F.lit(max(total, 1)), F.lit(SEED)))
    # One row per source: the dealing is a range look-up in an array of the sources.
    bounds = planned.where("slots > 0").agg(
        F.array_sort(F.collect_list(F.struct("first_slot", "slots", "blocks", "source"))).alias("sources")
    )
    sources = bounds.first()["sources"]
    own = F.lit(None).cast("struct<first_slot:bigint,slots:bigint,blocks:bigint,source:string>")
    for s in reversed(sources):
        here = F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in (("first_slot", s.first_slot, "long"), ("slots", s.slots, "long"), ("blocks", s.blocks, "long"), ("source", s.source, "string"))])
        own = F.when(F.col("drawn") < s.first_slot + s.slots, here).otherwise(own)
    dealt = drawn.withColumn("own", own)
    rank = F.col("drawn") - F.col("own.first_slot")
    blocks = F.col("own.blocks")
    key = F.coalesce(F.col("own.source"), F.lit("null source"))
    return dealt.select(
        "shard",
        "slot",
        F.col("own.source").alias("source"),
        permuted(F.pmod(rank, blocks), blocks, key).alias("block"),
        (rank / blocks).cast("int").alias("epoch"),
    )


def uses(stream: DataFrame, dealt: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``stream`` with ``taken``: the words of each document that the dealt blocks use.

    Blocks are joined by (source, index) to the documents they overlap. Copies of a block are
    counted before the join, so a key of the join has one row on that side.
    """
    used = dealt.groupBy("source", "block").agg(F.count("*").alias("times"))
    size = F.lit(block_words)
    last = F.floor((F.col("start") + F.col("size") - 1) / size).cast("long")
    spans = stream.where("size > 0").select(
        "_id", "source", "size", "h", "start", F.explode(F.sequence(F.floor(F.col("start") / size).cast("long"), last)).alias("block")
    )
    upto = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
    words = upto - F.greatest(F.col("start"), F.col("block") * size)
    side = used.select(F.col("source").alias("s"), F.col("block").alias("b"), "times")
    met = spans.join(side, same(F.col("source"), F.col("s")) & (F.col("block") == F.col("b")))
    taken = met.groupBy("_id", "source", "start", "size", "h").agg(F.sum(words * F.col("times")).alias("taken"))
    keys = ["_id", "source", "start", "size", "h"]
    right = taken.select(*[F.col(k).alias(f"r_{k}") for k in keys], "taken")
    match = same(F.col("_id"), F.col("r__id")) & same(F.col("source"), F.col("r_source"))
    match = match & (F.col("start") == F.col("r_start")) & (F.col("size") == F.col("r_size"))
    return stream.join(right, match, "left").select(*keys, F.coalesce("taken", F.lit(0)).alias("taken"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, source, h) for every row of ``docs``.

    A null text has no words; a null source is a source of its own, in the last place. Rows that
    repeat an id are rows of their own. Reruns give the same mix. A source's taken
    words miss its target by less than a block. An empty table gives an empty result.
    """
    stream, sizes = pack(docs, block_words, id_col, text_col, source_col)
    stream = cut_lineage(stream)
    planned = cut_lineage(plan(sizes, block_words, weights, max_epochs))
    dealt = slots(docs.sparkSession, planned)
    counted = uses(stream, dealt, block_words)
    of = planned.select(F.col("source").alias("s"), "source_size", "target")
    return counted.join(F.broadcast(of), same(F.col("source"), F.col("s"))).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", "taken", "source", "h"
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, in all their columns.

    A row is taken taken / size times: the whole part always, the rest by a hash of its id and
    text, so the words of a source come near its target. Rows without words stay once.
    """
    mixed = mix(docs, **options).select(
        F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("h").alias("_h"), "size", "taken"
    )
    share = F.col("taken") / F.col("size")
    chance = F.pmod(F.xxhash64("_i", "_h", F.lit("rest")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = F.floor(share) + F.when(chance < share - F.floor(share), 1).otherwise(0)
    times = F.when(F.col("size") == 0, 1).otherwise(copies).cast("int")
    # Rows equal in id, source and text are one key here; each of them has a mean share.
    counted = mixed.withColumn("times", times).groupBy("_i", "_s", "_h").agg(
        F.sum("times").alias("times"), F.count("*").alias("rows")
    )
    match = same(F.col("doc_id"), F.col("_i")) & same(F.col("source"), F.col("_s")) & (F.xxhash64("text") == F.col("_h"))
    found = docs.join(counted, match)
    each = F.round(F.col("times") / F.col("rows")).cast("int")
    repeated = found.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), each)))
    return repeated.select(*docs.columns)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
