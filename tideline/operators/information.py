"""Mutual information of continuous columns from nearest neighbours, exact and without all pairs.

For every point, the distance to its k-th neighbour (the larger of the two differences),
and on each axis the points strictly nearer than that. Points of all features are split
together into cells of a bounded number of distinct points, by quantiles of one axis and
then the other, where a cell has too many; equal points are one with a weight. A point's
own cell gives a bound of its distance; the square of that bound descends the same splits
to the other cells that it meets, and what they find settles the distance. Points on an
axis are counted by ranks: ends of intervals and values are sorted together in buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.lineage import kept
from tideline.operators.quantiles import exact_quantiles

#: Distinct points of a cell, ways of a split, rounds of splits and values of a bucket of ranks.
CELL, WAYS, ROUNDS, BUCKET = 1024, 16, 64, 65_536


def digamma(n: Column) -> Column:
    """The digamma function of positive whole numbers: six steps up, then its asymptotic series."""
    x = n.cast("double") + 6
    shift = sum((1 / (n.cast("double") + k) for k in range(6)), F.lit(0.0))
    y = 1 / (x * x)
    return F.ln(x) - 1 / (2 * x) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - shift


def _below(bounds: Column, v: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b < v))


def _split(points: DataFrame, cell: int) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Points with their cell, and of every round its axis and the cells that it split: cell, bounds, box."""
    points, rounds = points.withColumn("cell", F.concat("feature", F.lit("|"))), []
    shares = F.array(*[F.lit(k / WAYS) for k in range(1, WAYS)])
    for step in range(ROUNDS):
        axis = "xy"[step % 2]
        box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
        heavy = points.groupBy("cell").agg(F.count("*").alias("_n"), F.array_distinct(F.percentile_approx(axis, shares, F.lit(1000))).alias("bounds"), F.max(axis).alias("_top"), *box).where(F.col("_n") > cell)
        # a bound at the top would leave a part empty
        heavy = kept(heavy.select("cell", F.filter("bounds", lambda b: b < F.col("_top")).alias("bounds"), "x0", "x1", "y0", "y1"))
        if heavy.isEmpty():
            break
        rounds.append((axis, heavy))
        joined = points.join(heavy.select("cell", "bounds"), "cell", "left")
        part = F.concat_ws("/", "cell", _below(F.col("bounds"), F.col(axis)).cast("string"))
        points = kept(joined.withColumn("cell", F.when(F.col("bounds").isNull(), F.col("cell")).otherwise(part)).drop("bounds"))
    return points, rounds


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    """id and near, the k least distances (each other copy counts) to points of the cell, at most ``limit``.

    rows: cell, id, x, y, weight (0 for a visitor from another cell), limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            table = pa.Table.from_batches(held)
            ids, x, y, weight, limit = (table.column(c).to_numpy() for c in ("id", "x", "y", "weight", "limit"))
            held.clear()
            here, asking = np.flatnonzero(weight > 0), np.flatnonzero(limit >= 0)
            step = max(1, (1 << 21) // max(1, len(here)))
            for at in range(0, len(asking), step):
                own = asking[at : at + step]
                d = np.maximum(np.abs(x[own, None] - x[here]), np.abs(y[own, None] - y[here]))
                few = min(k, len(here) - 1)
                order = np.argpartition(d, few, axis=1)[:, : few + 1] if few >= 0 else np.empty((len(d), 0), dtype=np.int64)
                near = []
                for r, row in enumerate(order):
                    found = []
                    for j in row[np.argsort(d[r, row], kind="stable")].tolist():
                        same = here[j] == own[r]
                        found += [d[r, j]] * int(min(k, weight[here[j]] - same))
                    near.append([v for v in found[:k] if v <= limit[own[r]]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(near, pa.list_(pa.float64()))], names=["id", "near"])

        for batch in batches:
            start, cells = 0, batch.column(0).to_pylist()
            for end in range(1, len(cells) + 1):
                if end == len(cells) or cells[end] != cells[start]:
                    if cells[start] != now:
                        yield from close()
                        now = cells[start]
                    held.append(batch.slice(start, end - start))
                    start = end
        yield from close()

    dealt = rows.select("cell", "id", "x", "y", F.col("weight").cast("long").alias("weight"), "limit").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "id long, near array<double>")


def _merged(lists: DataFrame, k: int) -> DataFrame:
    return lists.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def _radius(points: DataFrame, k: int, cell: int) -> DataFrame:
    """Points with the distance to the k-th neighbour; every feature has more than k points."""
    points, rounds = _split(points, cell)
    own = kept(_nearest(points.withColumn("limit", F.lit(math.inf)), k))
    known = points.join(own, "id").withColumn("r", F.when(F.size("near") >= k, F.element_at("near", k)))
    # a cell of fewer points: all points of the cell that was split into it lie in its box
    corner = F.greatest(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y"))
    for _, heavy in reversed(rounds):
        parent = F.regexp_replace("cell", "/[0-9]+$", "")
        boxes = heavy.select(F.col("cell").alias("_parent"), "x0", "x1", "y0", "y1")
        known = known.withColumn("_parent", parent).join(boxes, "_parent", "left").withColumn("r", F.coalesce("r", corner)).drop("_parent", "x0", "x1", "y0", "y1")
    known = kept(known)
    # the square of each bound goes down the splits, to every cell that it meets
    visit = known.select("id", "x", "y", "r", F.col("cell").alias("home"), F.concat("feature", F.lit("|")).alias("cell"))
    for axis, heavy in rounds:
        low, high = _below(F.col("bounds"), F.col(axis) - F.col("r")), _below(F.col("bounds"), F.col(axis) + F.col("r"))
        joined = visit.join(heavy.select("cell", "bounds"), "cell", "left")
        parts = F.when(F.col("bounds").isNull(), F.array(F.col("cell"))).otherwise(F.transform(F.sequence(low, high), lambda j: F.concat_ws("/", F.col("cell"), j.cast("string"))))
        visit = joined.withColumn("cell", F.explode(parts)).drop("bounds")
    away = visit.where("cell <> home")
    boxes = points.groupBy("cell").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    meets = (F.col("x") - F.col("r") < F.col("x1")) & (F.col("x") + F.col("r") > F.col("x0")) & (F.col("y") - F.col("r") < F.col("y1")) & (F.col("y") + F.col("r") > F.col("y0"))
    away = away.join(boxes, "cell").where(meets).select("cell", "id", "x", "y", F.lit(0).alias("weight"), F.col("r").alias("limit"))
    home = points.select("cell", "id", "x", "y", "weight", F.lit(-1.0).alias("limit"))
    found = _nearest(home.unionByName(away), k).where(F.size("near") > 0)
    every = _merged(own.unionByName(found), k)
    return points.drop("cell").join(every.select("id", F.element_at("near", k).alias("r")), "id")


def _last(good: np.ndarray, bad: np.ndarray, fits: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The number furthest towards ``bad`` that fits, by halving the numbers between; all up to it from ``good`` fit."""
    mask = np.int64(0x7FFF_FFFF_FFFF_FFFF)
    whole = lambda v: (b := (v + 0.0).view(np.int64)) ^ ((b >> np.int64(63)) & mask)
    a, b = whole(good), whole(bad)
    for _ in range(64):
        middle = (a >> np.int64(1)) + (b >> np.int64(1)) + (a & b & np.int64(1))
        ok = fits((middle ^ ((middle >> np.int64(63)) & mask)).view(np.float64))
        a, b = np.where(ok, middle, a), np.where(ok, b, middle)
    return (a ^ ((a >> np.int64(63)) & mask)).view(np.float64)


def interval_ends(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest numbers not above the points strictly nearer to x than r, and among them (for r = 0: x alone).

    Differences are rounded, so the ends are those of the rounded differences.
    """
    slack = 4 * np.spacing(np.maximum(np.abs(x), r))
    low = _last(x - r - slack, x - r + slack, lambda v: x - v >= r)
    high = _last(x + r - slack, x + r + slack, lambda v: v - x < r)
    return np.where(r == 0, np.nextafter(x, -np.inf), low), np.where(r == 0, x, high)


def _within(points: DataFrame, axis: str, n: int) -> DataFrame:
    """id and the weight of points of the same feature strictly nearer than r on an axis, its own included."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low, high = interval_ends(pdf[axis].to_numpy(), pdf["r"].to_numpy())
            for v, sign in ((low, -1), (high, 1)):
                yield pd.DataFrame({"feature": pdf["feature"], "v": v, "id": pdf["id"], "sign": sign})

    ask = points.select("feature", axis, "id", "r").mapInPandas(ends, "feature string, v double, id long, sign int")
    have = points.groupBy("feature", F.col(axis).alias("v")).agg(F.sum("weight").alias("weight"))
    both = have.select("feature", "v", "weight", F.lit(None).cast("long").alias("id"), F.lit(0).alias("sign")).unionByName(ask.withColumn("weight", F.lit(0).cast("long")))
    buckets = min(4096, 5 * n // BUCKET + 1)
    if buckets > 1:
        cuts = points.groupBy("feature").agg(F.percentile_approx(axis, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10 * buckets)).alias("cuts"))
        # one row a feature, of 4,096 numbers at most
        table = {r["feature"]: np.unique(r["cuts"]) for r in cuts.collect()}

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                place = np.zeros(len(pdf), dtype=np.int64)
                for f, at in pdf.groupby("feature").indices.items():
                    place[at] = np.searchsorted(table[f], pdf["v"].to_numpy()[at])
                yield pdf.assign(bucket=place)

        both = both.mapInPandas(deal, "feature string, v double, weight long, id long, sign int, bucket long")
    else:
        both = both.withColumn("bucket", F.lit(0).cast("long"))
    both = kept(both)
    sizes = both.groupBy("feature", "bucket").agg(F.sum("weight").alias("_w"))
    before = sizes.select("feature", "bucket", (F.sum("_w").over(Window.partitionBy("feature").orderBy("bucket")) - F.col("_w")).alias("_before"))
    upto = F.sum("weight").over(Window.partitionBy("feature", "bucket").orderBy("v", F.abs("sign")))
    ranked = both.withColumn("_upto", upto).where("sign <> 0").join(before, ["feature", "bucket"])
    return ranked.groupBy("id").agg(F.sum(F.col("sign") * (F.col("_upto") + F.col("_before"))).alias(f"n_{axis}"))


def knn_information(df: DataFrame, features: Sequence[str], target: str, neighbours: int = 3, cell: int = CELL) -> DataFrame:
    """feature, n and mi, the nearest-neighbour estimate of mutual information with the target, in nats, not below 0.

    Rows without a target, or with one that is not finite, take no part; a feature's
    missing and infinite values are its median. Both are divided by their spread. Equal
    rows are neighbours at distance 0 and nothing is jittered, so the result is a
    function of the rows. Up to ``neighbours`` rows give no estimate (null).
    """
    features = list(features)
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) != math.inf), F.col(c).cast("double"))
    rows = kept(df.select(fine(target).alias("_target"), *[fine(c).alias(c) for c in features]).where("_target is not null"))
    n = rows.count()
    none = rows.sparkSession.createDataFrame([(f, n, None) for f in features], "feature string, n long, mi double")
    if n <= neighbours:
        return none
    medians = {c: q[0] for (_, c), (_, q) in exact_quantiles(rows, features, [0.5]).items()}
    filled = rows.select("_target", *[F.coalesce(c, F.lit(medians.get(c, 0.0))).alias(c) for c in features])
    spread = filled.agg(*[F.stddev_pop(c).alias(c) for c in filled.columns]).first()
    scaled = filled.select((F.col("_target") / F.lit(spread["_target"] or 1.0)).alias("y"), *[(F.col(c) / F.lit(spread[c] or 1.0)).alias(c) for c in features])
    points = scaled.unpivot(["y"], features, "feature", "x").groupBy("feature", "x", "y").agg(F.count("*").alias("weight"))
    points = kept(points.withColumn("id", F.monotonically_increasing_id()))
    known = kept(_radius(points, neighbours, cell))
    counted = known.select("id", "feature", "weight").join(_within(known, "x", n), "id").join(_within(known, "y", n), "id")
    mean = F.sum(F.col("weight") * (digamma(F.col("n_x")) + digamma(F.col("n_y")))) / F.sum("weight")
    found = digamma(F.lit(n)) + digamma(F.lit(neighbours)) - mean
    return counted.groupBy("feature").agg(F.sum("weight").alias("n"), F.greatest(F.lit(0.0), found).alias("mi"))
