"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions only.

A tree has regions, racks and shards. A key descends it: of the regions, then of the
chosen region's racks, then of that rack's shards, the one with the least draw is
taken. A draw is -ln(u) / weight, with u hashed from the key and the node's own name
and the weight summed over the node's shards, so a node gets its share of the keys.
When weights change, a draw changes only at nodes above or at these shards: between
two regions, racks or shards whose weights stay, no key moves. A new shard comes in a
region of its own, so that keys move into it only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.cluster import free_name

#: Hex digits of md5 that make one draw: 48 bits, exact in a double.
DIGITS = 12
#: Copies of one row that a task makes at a time.
PIECE = 1 << 16
#: Rows that one task of the last stage aims at.
TASK_ROWS = 1_000_000


@dataclass(frozen=True)
class Tree:
    """``racks[r]`` lists region r's racks, each as a list of (shard number, weight)."""

    racks: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @classmethod
    def of(cls, shards: int, per_rack: int = 4, racks_per_region: int = 3, weights: dict[int, float] | None = None) -> Tree:
        """``shards`` shards, filled rack by rack and region by region; a shard's weight is 1 unless given."""
        leaf = [(k, float((weights or {}).get(k, 1.0))) for k in range(shards)]
        racks = [tuple(leaf[k : k + per_rack]) for k in range(0, shards, per_rack)]
        return cls(tuple(tuple(racks[k : k + racks_per_region]) for k in range(0, len(racks), racks_per_region)))

    def __post_init__(self) -> None:
        weights = [w for _, w in self.leaves()]
        if min(weights, default=0.0) < 0 or sum(weights) <= 0:
            raise ValueError("weights must not be negative, and one must be positive")

    def leaves(self) -> list[tuple[int, float]]:
        return [leaf for region in self.racks for rack in region for leaf in rack]

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region and rack of its own."""
        return Tree((*self.racks, (((1 + max(k for k, _ in self.leaves()), weight),),)))


def weight_of(node: tuple) -> float:
    """Summed weight of a region, rack or shard, added in one order whatever the tree."""
    return sum(map(weight_of, node)) if isinstance(node[0], tuple) else node[1]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight``; infinite where the weight is 0 or there is no such node."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), name).cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((bits + F.lit(1.0)) / F.lit(float(16**DIGITS))) / weight).otherwise(F.lit(float("inf")))


def _pick(draws: Column) -> Column:
    """The number of the least draw of an array, the first of equal ones."""
    return (F.array_position(draws, F.array_min(draws)) - 1).cast("int")


def _region_draws(key: Column, tree: Tree) -> list[Column]:
    return [draw(key, F.lit(str(r)), F.lit(float(weight_of(region)))) for r, region in enumerate(tree.racks)]


def _table(nodes: list, depth: int) -> Column:
    """Literal nested arrays of numbers."""
    return F.array(*[_table(x, depth - 1) if depth > 1 else F.lit(x) for x in nodes])


def assign(df: DataFrame, key: str, trees: dict[str, Tree]) -> DataFrame:
    """``df`` with one shard column for each named tree; a null key is the key ``''``. No shuffle."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    draws, region, rack = (free_name(df, c) for c in ("_draws", "_region", "_rack"))
    at = F.col(region)
    out = df
    for column, tree in trees.items():
        racks = max(len(r) for r in tree.racks)
        leaves = max(len(k) for r in tree.racks for k in r)
        # shorter lists end in nodes without weight, which are never drawn
        wide = [[list(k) + [(0, 0.0)] * (leaves - len(k)) for k in r] + [[(0, 0.0)] * leaves] * (racks - len(r)) for r in tree.racks]
        rack_weight = _table([[float(weight_of(k)) for k in r] + [0.0] * (racks - len(r)) for r in tree.racks], 2)
        leaf_weight, leaf_number = (_table([[[leaf[c] for leaf in k] for k in r] for r in wide], 3) for c in (1, 0))
        out = out.withColumn(draws, F.array(*_region_draws(name, tree))).withColumn(region, _pick(F.col(draws)))
        label = F.concat(at.cast("string"), F.lit("."))
        out = out.withColumn(draws, F.array(*[draw(name, F.concat(label, F.lit(str(k))), F.get(F.get(rack_weight, at), F.lit(k))) for k in range(racks)]))
        out = out.withColumn(rack, _pick(F.col(draws)))
        label = F.concat(label, F.col(rack).cast("string"), F.lit("."))
        own = lambda table: F.get(F.get(table, at), F.col(rack))
        out = out.withColumn(draws, F.array(*[draw(name, F.concat(label, F.lit(str(k))), F.get(own(leaf_weight), F.lit(k))) for k in range(leaves)]))
        # never null; said so, that no filter on it travels down through the levels and doubles them
        chosen = F.coalesce(F.get(own(leaf_number), _pick(F.col(draws))), F.lit(tree.leaves()[0][0]))
        out = out.withColumn(column, chosen.cast("int")).drop(draws, region, rack)
    return out


def grown_shard(key: Column, tree: Tree, shard: Column, weight: float = 1.0) -> Column:
    """Where ``tree.grown()`` puts a key that ``tree`` puts into ``shard``: only the draws of regions can differ."""
    new = tree.grown(weight)
    *old, added = _region_draws(F.coalesce(key.cast("string"), F.lit("")), new)
    return F.when(added < F.array_min(F.array(*old)), F.lit(new.leaves()[-1][0])).otherwise(shard).cast("int")


def slots(df: DataFrame, shard: str, order: list[str], digits: int, parts: int, copies: str = "_copies", out: str = "slot") -> DataFrame:
    """Each row as often as ``copies`` says, with gapless numbers from 0 within each shard in the order of ``order``.

    ``order[0]`` is a lower-case hex string. Its first ``digits`` digits make ordered
    buckets, so that a shard is numbered by many tasks: counts of the buckets before
    give the offset, and a running sum of copies the rest. Copies are made in pieces of
    PIECE, dealt over ``parts`` tasks, so that no task makes all of one row.
    """
    d = df.withColumn("_bucket", F.substring(F.col(order[0]), 1, digits))
    counts = d.groupBy(shard, "_bucket").agg(F.sum(copies).alias("_n"))
    before = counts.selectExpr(shard, "_bucket", f"sum(_n) over (partition by {shard} order by _bucket) - _n as _before")
    # both sides are dealt by (shard, bucket) already: the join adds no shuffle of rows
    placed = d.withColumn("_first", F.expr(f"sum({copies}) over (partition by {shard}, _bucket order by {', '.join(order)} rows between unbounded preceding and current row) - {copies}"))
    placed = placed.join(before, [shard, "_bucket"]).withColumn("_first", F.col("_first") + F.col("_before"))
    pieces = placed.withColumn("_piece", F.explode(F.expr(f"sequence(0L, ({copies} - 1) div {PIECE})"))).repartition(parts, shard, "_first", "_piece")
    copy = F.explode(F.expr(f"sequence(_piece * {PIECE}, least({copies}, (_piece + 1) * {PIECE}) - 1)"))
    return pieces.withColumn("_copy", copy).withColumn(out, (F.col("_first") + F.col("_copy")).cast("long")).drop("_bucket", "_first", "_before", "_piece", "_copy", copies)


def hash_tree_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", digits: int | None = None) -> DataFrame:
    """Place documents by the law ``key``: the id and the tree of shards decide.

    Returns doc_id, size (UTF-8 bytes and 8), text_crc32, law, shard, slot and
    grown_shard (with one more shard, in a region of its own). Null text has size 8
    and the checksum of no bytes; a null id is a key of its own; equal rows get
    neighbouring slots; an empty table gives no rows. Documents of equal text go where
    their ids say. Other columns are not read. Texts of any length are only measured
    and stay where they are.

    Slots follow a hash of id and checksum, so rows of one id with different texts are
    numbered by many tasks. Rows equal in all that is returned are counted where they
    are read, placed once and made again at the end, by many tasks too. digits: hex
    digits of the slot buckets; unset, enough for about 100,000 rows each.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = docs.count()
    if digits is None:
        digits = 1
        while rows > 100_000 * shards * 16**digits and digits < 6:
            digits += 1
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))
    tree = Tree.of(shards)
    once = base.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_copies"))
    placed = assign(once, "doc_id", {"shard": tree}).withColumn("grown_shard", grown_shard(F.col("doc_id"), tree, F.col("shard")))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("text_crc32").cast("string"))
    placed = placed.withColumn("_h", F.md5(name.cast("binary")))
    out = slots(placed, "shard", ["_h", "doc_id", "text_crc32", "size"], digits, parts)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
