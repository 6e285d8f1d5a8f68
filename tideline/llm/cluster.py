"""Lineage cuts, joins with hot keys and connected components, all of which survive lost executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.lineage import forget, scope, shared_folder
from tideline.operators.lineage import kept as durable

__all__ = ["HOT", "components", "durable", "forget", "free_name", "hot_keys", "lookup", "scope", "shared_folder"]

#: A key is hot if it holds more than one in so many rows. So there are never more hot keys than this.
HOT = 1024


def free_name(df: DataFrame, name: str) -> str:
    """``name``, behind as many more underscores as tell it from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def hot_keys(counts: DataFrame, key: str, n: str = "count", share: int = HOT) -> DataFrame:
    """Of (key, n), the keys with more than one in ``share`` of all: fewer than ``share``, so they may be broadcast."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(key).isNotNull() & (F.col(n) * share > F.lit(total))).select(key)


def lookup(df: DataFrame, table: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """``df`` left-joined with ``table`` (a key once) on ``key``, though some keys hold most rows.

    hot: keys for which ``hot_keys`` has proved a bound. Their rows of ``table`` are broadcast, and
    rows of ``df`` that they answer are dealt by ``spread`` in the other join, as are null
    keys, so that no task gets all rows of a key.
    """
    values = [c for c in table.columns if c != key]
    known = table.join(F.broadcast(hot), key, "left_semi").select(key, F.struct(*values).alias("_hot"))
    few = hot.select(key, F.lit(True).alias("_is_hot")).join(F.broadcast(known), key, "left")
    marked = df.join(F.broadcast(few), key, "left")
    aside = F.col("_is_hot").isNotNull() | F.col(key).isNull()
    # a salt that no row of the table has
    marked = marked.withColumn("_salt", F.when(aside, F.pmod(spread, F.lit(1 << 20)) + 1).otherwise(F.lit(0)))
    rest = table.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_zero"), F.struct(*values).alias("_cold"))
    out = marked.join(rest, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_zero")), "left")
    found = F.coalesce("_hot", "_cold")
    return out.select(*df.columns, *[found[c].alias(c) for c in values])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list, as (node, root); root is the least node.

    Large-star and small-star rounds: each round points every node at the least
    node it can see, as aggregates and equi-joins over the edges only. Nodes that
    meet no other node are absent. Null ends and loops are ignored. A node with more
    than one in HOT of all edges is looked up by broadcast, so a star's centre is no hot key.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e = durable(e)
    before = None
    while True:
        # large star: the larger neighbours of u go to the least node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("k")))
        least, hot = around.select("u", "m"), hot_keys(around, "u", "k")
        large = lookup(both.where("v > u"), least, "u", hot, F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == before:
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
        before = now
