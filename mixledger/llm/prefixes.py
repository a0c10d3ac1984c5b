"""Prefix trie of conversations rebuilt from a head of another one, by composable fingerprints of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import Scan, scan
from .common import staged, table, word_count

#: A conversation borrows from the first of its block of so many ids, and at most so many turns less one.
BLOCK, HEADS = 20, 4
#: Fingerprints live in the field of this many elements, LANES independent ones beside each other, powers of one base.
PRIME, BASE, LANES = (1 << 31) - 1, 1_220_703_125, 4
#: A node that holds more than one in so many of all entries is heavy; there are never more heavy nodes than that.
HEAVY_SHARE = 10_000
SEEDS = 5

LANE = [f"x{i}" for i in range(LANES)]
SUM = [f"s{i}" for i in range(LANES)]
NODE = ["depth", "f1", "f2"]


def power(exponent: Column, base: int = BASE, bits: int = 40) -> Column:
    """``base`` to a non-negative exponent, modulo ``PRIME``, by squares that are constants."""
    product, square = F.lit(1).cast("long"), base % PRIME
    for bit in range(bits):
        chosen = F.when(F.shiftright(exponent, bit).bitwiseAND(F.lit(1)) == 1, F.lit(square)).otherwise(F.lit(1)).cast("long")
        product = product * chosen % PRIME if bit else chosen
        square = square * square % PRIME
    return product


def shifted(value: Column, back: Column) -> Column:
    """A sum of terms with all their positions lowered by ``back`` (0 to HEADS - 1)."""
    inverse, factor = pow(BASE, -1, PRIME), F.lit(1).cast("long")
    for k in range(1, HEADS):
        factor = F.when(back == k, F.lit(pow(inverse, k, PRIME)).cast("long")).otherwise(factor)
    return F.pmod(value, F.lit(PRIME)) * factor % PRIME


def packed(lanes: list[str] | list[Column]) -> tuple[Column, Column]:
    """Four lanes of 31 bits as two longs."""
    a, b, c, d = (F.col(x) if isinstance(x, str) else x for x in lanes)
    return F.shiftleft(a.cast("long"), 31).bitwiseOR(b.cast("long")), F.shiftleft(c.cast("long"), 31).bitwiseOR(d.cast("long"))


def turn_table(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, pos, x0.., s0.., words): the turns in order, their lanes, and the fingerprint of all turns up to each.

    The fingerprint of a sequence is the sum over its positions p from 1 of x * BASE**p. It composes: a
    sequence behind another one adds its own sum times BASE to the length of the first.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", word_count(F.col("text")))
    for i in range(LANES // 2):
        h = F.xxhash64(F.lit(seed), F.lit(i), "role", "text")
        rows = rows.withColumns(
            {LANE[2 * i]: F.pmod(h, F.lit(PRIME)), LANE[2 * i + 1]: F.pmod(F.shiftrightunsigned(h, 31), F.lit(PRIME))}
        )
    order = ["turn", "role", "text"]
    # Equal rows tie in every column, so their order is of no account.
    chunk = F.coalesce(F.floor(F.col("turn") / 65536), F.lit(-(1 << 40))).cast("long")
    numbered = scan(rows, ["conv_id"], order, chunk, [Scan("pos", "number")]).drop("role", "text", "turn")
    terms = numbered.withColumn("pos", F.col("pos").cast("long")).withColumn("_p", power(F.col("pos")))
    sums = [Scan(s, "sum", F.col(x) * F.col("_p") % PRIME) for s, x in zip(SUM, LANE, strict=True)]
    found = scan(terms, ["conv_id"], ["pos"], F.floor(F.col("pos") / 65536), sums)
    return staged(found.withColumns({s: F.col(s) % PRIME for s in SUM}).select("conv_id", "pos", *LANE, *SUM, "words"))


def turns_differ(conversations: DataFrame, seed: int) -> bool:
    """Whether two different turns have the same lanes: the texts of each are compared by their least and greatest."""
    one = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = conversations.select(
        *(F.xxhash64(F.lit(seed), F.lit(i), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias(f"h{i}") for i in range(2)),
        one.alias("t"),
    )
    lanes = [c for i in range(2) for c in (F.pmod(f"h{i}", F.lit(PRIME)), F.pmod(F.shiftrightunsigned(f"h{i}", 31), F.lit(PRIME)))]
    a, b = packed(lanes)
    keyed = hashed.select(a.alias("a"), b.alias("b"), "t")
    found = keyed.groupBy("a", "b").agg((F.min("t") != F.max("t")).alias("differ"))
    return not found.where("differ").isEmpty()


def borrowed(turns: DataFrame) -> DataFrame:
    """One row for each conversation: how many turns it takes from the head of its block and what its own follow on.

    ``start`` holds the fingerprint of the borrowed head less that of the turns it stands for, so the
    fingerprint of a rebuilt prefix is ``start`` plus the shifted own sum. No rebuilt text is made.
    """
    heads = [F.max(F.when(F.col("pos") == q, F.struct(*LANE, *SUM, "words"))).alias(f"t{q}") for q in range(1, HEADS)]
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"), *heads)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = staged(convs.withColumn("h", h.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("n_base"), *(F.col(f"t{q}").alias(f"b{q}") for q in range(1, HEADS)))
    met = convs.join(bases, "base", "left")
    met = met.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))).cast("int"))

    def at(kind: str, number: Column, lane: str) -> Column:
        found = F.lit(0).cast("long")
        for q in range(1, HEADS):
            found = F.when(number == q, F.col(f"{kind}{q}.{lane}")).otherwise(found)
        return found

    back = F.col("h") - F.col("head")
    # Own turns are counted only behind the first h, so shorter conversations need no own sum.
    start = {f"start{i}": F.pmod(at("b", F.col("head"), s) - shifted(F.coalesce(at("t", F.col("h"), s), F.lit(0)), back), F.lit(PRIME)) for i, s in enumerate(SUM)}
    total = (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long")
    return staged(met.withColumns(start).select("conv_id", "h", "head", total.alias("total"), *start, *(f"b{q}" for q in range(1, HEADS))))


def entry_table(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, f1, f2, x1, x2, words, total): every prefix but the root of every rebuilt conversation."""
    own = turns.join(convs.select("conv_id", "h", "head", "total", *(f"start{i}" for i in range(LANES))), "conv_id").where("pos > h")
    back = F.col("h") - F.col("head")
    prints = [(F.col(f"start{i}") + shifted(F.col(s), back)) % PRIME for i, s in enumerate(SUM)]
    f1, f2 = packed(prints)
    x1, x2 = packed(LANE)
    depth = (F.col("pos") - back).cast("long").alias("depth")
    mine = own.select("conv_id", depth, f1.alias("f1"), f2.alias("f2"), x1.alias("x1"), x2.alias("x2"), "words", "total")
    parts = [mine]
    for q in range(1, HEADS):
        f1, f2 = packed([F.col(f"b{q}.{s}") for s in SUM])
        x1, x2 = packed([F.col(f"b{q}.{x}") for x in LANE])
        part = convs.where(F.col("head") >= q).select(
            "conv_id", F.lit(q).cast("long").alias("depth"), f1.alias("f1"), f2.alias("f2"), x1.alias("x1"), x2.alias("x2"),
            F.col(f"b{q}.words").alias("words"), "total",
        )
        parts.append(part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return staged(found)


def node_table(entries: DataFrame) -> DataFrame:
    """(node, least member, members, whether nothing follows, own saving, whether its last turns are one turn)."""
    found = entries.groupBy(*NODE).agg(
        F.min("conv_id").alias("least"),
        F.count("*").alias("n_convs"),
        F.sum(F.when(F.col("depth") == F.col("total"), 1).otherwise(0)).alias("n_ends"),
        F.max("words").alias("words"),
        ((F.min("x1") == F.max("x1")) & (F.min("x2") == F.max("x2"))).alias("one_turn"),
    )
    return staged(
        found.select(
            *NODE, "least", "n_convs", (F.col("n_ends") == F.col("n_convs")).alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), "one_turn",
        )
    )


def ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): ids of a node flow through its digest in order, none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def row(key: tuple, value: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends_sha256"), (*key, value), strict=True))])

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if now is not None:
                        yield row(tuple(now), digest.hexdigest())
                    now, digest = key, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
        if now is not None:
            yield row(tuple(now), digest.hexdigest())

    placed = members.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return placed.mapInArrow(run, "depth bigint, f1 bigint, f2 bigint, ends_sha256 string")


def with_node(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries plus what their node says. Heavy nodes, ``HEAVY_SHARE`` at most, are broadcast; the others are joined."""
    known = ["least", "leaf", "saved"]
    limit = nodes.agg(F.sum("n_convs")).first()[0] or 0
    heavy = F.broadcast(nodes.where(F.col("n_convs") * HEAVY_SHARE > limit).select(*NODE, *known))
    light = nodes.where(F.col("n_convs") * HEAVY_SHARE <= limit).select(*NODE, *known)
    hot = entries.join(heavy, NODE)
    rest = entries.join(heavy.select(*NODE), NODE, "left_anti").join(light, NODE)
    return hot.unionByName(rest)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns stand in the order of (turn, role, text), null turns first, so repeated and tied rows have one order. Null roles and
    texts are empty; rows without a conv_id belong to no conversation and are left out. Other columns are not
    read. A table without conversations has no node, not even a root.

    Prefixes meet by depth and fingerprint. Each node is then held against the turns themselves: all its
    last turns must be one stored turn, and turns with equal lanes must have equal texts. As a node's fingerprint less
    its last turn is its parent's, nodes that pass at every depth hold equal prefixes only; otherwise all is done
    again with other hashes.
    """
    columns = conversations.select("conv_id", "turn", "role", "text")
    for seed in range(SEEDS):
        turns = turn_table(columns, seed)
        convs = borrowed(turns)
        entries = entry_table(turns, convs)
        nodes = node_table(entries)
        if nodes.where("not one_turn").isEmpty() and not turns_differ(columns, seed):
            return _measured(convs, entries, nodes)
    raise RuntimeError("fingerprints of different prefixes were equal under every seed")


def _measured(convs: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The measures of every node, from one pass along each conversation against its order.

    A conversation is the least member of its nodes from some depth on. So what lies under a node is, added up over
    its members, what each of them is the least member of from there on: no pairs of nodes are made.
    """
    met = with_node(entries.select(*NODE, "conv_id", "total"), nodes).withColumn("up", -F.col("depth"))
    mine = F.col("least") == F.col("conv_id")
    along = scan(
        met, ["conv_id"], ["up"], F.floor(F.col("up") / 65536),
        [
            Scan("below", "lag", F.col("least")),
            Scan("above", "lead", F.col("least")),
            Scan("under", "sum", F.when(mine, F.col("saved")).otherwise(0)),
            Scan("leads", "max", F.when(mine & F.col("leaf"), 1).otherwise(0)),
        ],
    )
    own = along.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.max(F.when(mine, F.col("above"))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(F.when(F.col("below") == F.col("conv_id"), 1).otherwise(0)).alias("n_children"),
        F.sum("leads").alias("n_leaves"),
        F.sum("under").alias("saved_tokens"),
    )
    # The root holds every conversation, so it is counted apart, from tables that combine before they move.
    below = nodes.agg(
        F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("n_children"),
        F.sum(F.when(F.col("leaf"), 1).otherwise(0)).alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    every = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = every.join(F.broadcast(below), F.lit(True)).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"),
        "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.greatest(F.coalesce("n_leaves", F.lit(0)), F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    least = F.broadcast(every.select(F.col("conv_id").alias("_root")))
    own = own.join(least, F.lit(True)).withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.col("_root")).otherwise(F.col("parent_conv_id"))
    )
    last = entries.where("depth = total").select(*NODE, "conv_id").unionByName(
        convs.where("total = 0").select(*(F.lit(0).cast("long").alias(c) for c in NODE), "conv_id")
    )
    rows = own.drop("_root").unionByName(root).join(ends(last), NODE, "left")
    counts = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return rows.select(*counts, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


OP13_SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
convs as (
  select conv_id, list({'role': role, 'text': text} order by pos) as own,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
           lambda acc, byte: list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, zero: xor(c >> 1, 3988292384::bigint * (c & 1)))), 4294967295::bigint) % 4 as h
  from turns group by conv_id),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) as path
  from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 20),
entries as (select conv_id, d, path[1:d] as node, len(path) as total from (select *, unnest(range(0, len(path) + 1)) as d from rebuilt)),
nodes as (
  select d, node, min(conv_id) as conv_id, count(*) as n_convs,
         case when d = 0 then 0 else (count(*) - 1) * len(regexp_extract_all(node[d].text, '[^\x20\x09-\x0D]+')) end as saved,
         bool_and(total = d) as leaf,
         sha256(coalesce(string_agg(case when total = d then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from entries group by d, node),
children as (select d - 1 as d, node[1:d - 1] as node, count(*) as n_children from nodes where d > 0 group by all),
under as (
  select top_d as d, node[1:top_d] as node, sum(saved) as saved_tokens, count(*) filter (leaf) as n_leaves
  from (select *, unnest(range(0, d + 1)) as top_d from nodes) group by all)
select n.conv_id::bigint as conv_id, n.d::bigint as depth, p.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs,
       coalesce(c.n_children, 0)::bigint as n_children, u.n_leaves::bigint as n_leaves, u.saved_tokens::bigint as saved_tokens,
       n.ends_sha256
from nodes n join under u on u.d = n.d and u.node = n.node
left join children c on c.d = n.d and c.node = n.node
left join nodes p on n.d > 0 and p.d = n.d - 1 and p.node = n.node[1:n.d - 1]
"""
