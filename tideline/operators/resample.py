"""Folds and bootstrap draws. A draw is a hash of its key, so any engine and any task makes the same ones."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_number(key: Column) -> Column:
    """32 bits of a key's md5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_fold(group: Column, k: int, seed: int = 42) -> Column:
    """Fold 0 to k - 1 of a group; all rows of a group share it."""
    return F.pmod(hash_number(F.concat_ws("|", F.lit(str(seed)), group)), F.lit(k)).cast("int")


def fold_table(df: DataFrame, group: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(repeat, group, fold) of every distinct group."""
    groups = df.select(group).distinct()
    return groups.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select("repeat", group, F.pmod(hash_number(F.concat_ws("|", (F.col("repeat") + seed).cast("string"), F.col(group))), F.lit(k)).cast("int").alias("fold"))


def numpy_folds(groups: Sequence[str], k: int = 5, seed: int = 42) -> dict[str, int]:
    """Folds of distinct groups by NumPy's shuffle, for a group list that fits the driver."""
    import numpy as np

    names = np.array(sorted(set(groups)), dtype=object)
    np.random.RandomState(seed).shuffle(names)
    return {g: f for f, part in enumerate(np.array_split(names, min(k, len(names)))) for g in part}


def numbered(df: DataFrame, unit: str, keys: Sequence[str] = (), name: str = "_i") -> DataFrame:
    """``df`` with gapless numbers from 0 within each key, in the order of (md5 of unit, unit).

    The first hex digits of the md5 make ordered buckets, as many as leave about 100,000
    rows in each: counts of the buckets before give an offset, so that no task has to see
    all rows of a key.
    """
    digits = max(2, math.ceil(math.log(max(df.count(), 1) / 100_000 + 1, 16)))
    d = df.withColumn("_h", F.md5(F.col(unit).cast("string").cast("binary"))).withColumn("_b", F.substring("_h", 1, digits))
    counts = d.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_c")).drop("_c")
    at = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", unit)) - 1
    return d.withColumn("_at", at).join(before, [*keys, "_b"]).withColumn(name, F.col("_at") + F.col("_before")).drop("_h", "_b", "_at", "_before")


def leave_one_out(df: DataFrame, group: str) -> DataFrame:
    """One fold a group."""
    return numbered(df.select(group).distinct(), group, name="fold").select(group, F.col("fold").cast("long").alias("fold"))


def validation_groups(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """(group, validation): max(1, round(n * share)) groups of least hash are for validation; halves round to even."""
    g = df.select(group).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group)).cast("binary")))
    n = g.count()
    chosen = g.orderBy("_h", group).limit(max(1, round(n * share))).select(group, F.lit(True).alias("_v"))
    return g.join(chosen, group, "left").select(group, F.coalesce("_v", F.lit(False)).alias("validation"))


def sample_rows(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """At most k rows without replacement: those of least md5 of seed and key.

    Counts by the first four hex digits say at which of them the k-th row lies; all rows
    below are in, and only the rows that share those digits are sorted.
    """
    d = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))).withColumn("_b", F.substring("_h", 1, 4))
    counts = d.groupBy("_b").agg(F.count("*").alias("_n"))
    # 65,536 rows at most
    last = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_b"))).where(F.col("_upto") >= k).orderBy("_b").first() if k > 0 else None
    if last is None:
        return df if k > 0 else df.limit(0)
    edge = d.where(F.col("_b") == last["_b"]).orderBy("_h", key).limit(k - (last["_upto"] - last["_n"]))
    return d.where(F.col("_b") < last["_b"]).unionByName(edge).drop("_h", "_b")


def shared_groups(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that stand in more than one fold of a repeat; empty where folds are disjoint."""
    return df.groupBy("repeat", group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


#: Cumulated Poisson(1) probabilities in 65,536ths: a draw of 16 bits has a weight for each one that it reaches.
POISSON = tuple(math.floor(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))


def poisson_weight(digits: Column) -> Column:
    """A Poisson(1) weight from four hex digits."""
    u = F.conv(digits, 16, 10).cast("int")
    return sum(((u >= t).cast("int") for t in POISSON), F.lit(0))


def bootstrap_effects(deltas: DataFrame, keys: Sequence[str], unit: str, value: str = "delta", replicates: int = 200, seed: int = 42) -> DataFrame:
    """Percentile intervals of d_z over bootstrap replicates of each key.

    A row's weight in a replicate is a Poisson(1) draw, the limit of drawing with replacement,
    from the md5 of seed, key, ``unit`` and number: one md5 has eight draws. Rows of a unit share
    its draws, so their sums stand for them; replicates are summed where the units are. Keys of
    fewer than ten values get nulls.
    """
    x = F.col(value)
    rows = deltas.where(x.isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_pairs"))
    units = rows.groupBy(*keys, unit).agg(F.count("*").alias("_c"), F.sum(x).alias("_x"), F.sum(x * x).alias("_xx"))
    draws = units.select(*keys, unit, "_c", "_x", "_xx", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 8) - 1))).alias("_g"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) for k in keys], F.col(unit), F.col("_g").cast("string")).cast("binary"))
    draws = draws.withColumn("_h", h).select(*keys, "_c", "_x", "_xx", "_g", F.posexplode(F.array(*[poisson_weight(F.substring("_h", 1 + 4 * j, 4)) for j in range(8)])).alias("_j", "_w"))
    each = draws.where(f"_w > 0 and _g * 8 + _j < {replicates}").groupBy(*keys, "_g", "_j").agg(*[F.sum(F.col("_w") * F.col(c)).alias(n) for c, n in (("_c", "_n"), ("_x", "_s"), ("_xx", "_q"))])
    var = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / F.nullif(F.col("_n") - 1, F.lit(0))
    d = each.withColumn("d", F.when(var > 1e-300, F.col("_s") / F.col("_n") / F.sqrt(var)))
    ci = d.groupBy(*keys).agg(F.percentile("d", 0.025).alias("_low"), F.percentile("d", 0.975).alias("_high"))
    enough = F.col("n_pairs") >= 10
    return sizes.join(ci, list(keys), "left").select(*keys, "n_pairs", F.when(enough, F.col("_low")).alias("d_z_ci_low"), F.when(enough, F.col("_high")).alias("d_z_ci_high"))


def bootstrap_members(groups: DataFrame, group: str, replicates: int, seed: int = 42) -> DataFrame:
    """(replicate, group, times): subjects drawn with replacement, with how often."""
    rows = numbered(groups.select(group).distinct(), group).withColumn("_i", F.col("_i").cast("int"))
    n = rows.count()
    draws = groups.sparkSession.range(replicates * n).select((F.col("id") / n).cast("int").alias("replicate"), F.pmod(hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), F.lit(n)).cast("int").alias("_i"))
    return draws.groupBy("replicate", "_i").agg(F.count("*").alias("times")).join(rows, "_i").select("replicate", group, "times")
