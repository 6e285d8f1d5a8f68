"""Exact quantiles of many columns and groups by radix selection.

A double's bits, with the sign turned, order as its value does. The wanted order
statistics of all columns and groups are narrowed 16 bits at a time: a scan counts the
next 16 bits of the values that agree with what is known so far. Once each statistic is
among no more values than a digit has, the next scan takes all bits that are left; so
small groups need one scan and no group more than four, whatever the values are. A scan
hands on at most 65,536 counts for each statistic and task; the rows themselves are never
shuffled or sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a digit.
BITS = 16
#: Statistics that are narrowed together; more groups than that are for a plain ``percentile`` a group.
MOST = 1 << 20


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of ``x``; the two zeros are one, NaN is above all."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    b = x.view(np.int64)
    return (b ^ ((b >> np.int64(63)) & np.int64(0x7FFF_FFFF_FFFF_FFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def from_bits(u: int) -> float:
    b = u ^ 1 << 63
    b = b ^ 0x7FFF_FFFF_FFFF_FFFF if b >> 63 else b
    return float(np.uint64(b).view(np.float64))


def _counted(slot: np.ndarray, digit: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (slot, digit) with their summed counts."""
    order = np.lexsort((digit, slot))
    slot, digit, n = slot[order], digit[order], n[order]
    first = np.flatnonzero(np.append(True, (slot[1:] != slot[:-1]) | (digit[1:] != digit[:-1])))[: len(slot)]
    return slot[first], digit[first], np.add.reduceat(n, first) if len(first) else n


def _scan(rows: DataFrame, columns: list[str], known: dict[tuple[str, int], list[int]], done: int, width: int) -> DataFrame:
    """slot, digit, n: how often the next ``width`` bits follow each known prefix of ``done`` bits. known: sorted prefixes by group and column."""
    slots, total = {}, 0
    for key, prefixes in known.items():
        slots[key] = total
        total += len(prefixes)
    shared = rows.sparkSession.sparkContext.broadcast({k: (np.array(v, dtype=np.uint64), slots[k]) for k, v in known.items()})
    shift = np.uint64(64 - done - width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.empty(0, dtype=np.int64),) * 3], 0

        def merge() -> None:
            nonlocal held, size
            held, size = [_counted(*map(np.concatenate, zip(*held)))], 0

        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            names, group = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            for c in range(len(columns)):
                value = batch.column(c + 1)
                there = ~value.is_null().to_numpy(zero_copy_only=False)
                bits = ordered_bits(value.fill_null(0.0).to_numpy(zero_copy_only=False))
                for g, name in enumerate(names):
                    if (name, c) not in shared.value:
                        continue
                    prefixes, first = shared.value[name, c]
                    own = bits[there & (group == g)]
                    at = np.zeros(len(own), dtype=np.int64)
                    if done:
                        head = own >> np.uint64(64 - done)
                        at = np.minimum(np.searchsorted(prefixes, head), len(prefixes) - 1)
                        fits = prefixes[at] == head
                        own, at = own[fits], at[fits]
                    # a whole word is told as a signed number, which keeps its order
                    digit = (own ^ np.uint64(1 << 63)).view(np.int64) if width == 64 else (own >> shift & np.uint64((1 << width) - 1)).astype(np.int64)
                    found = _counted(first + at, digit, np.ones(len(own), dtype=np.int64))
                    held.append(found)
                    size += len(found[0])
            if size > 1 << 20:
                merge()
        merge()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["slot", "digit", "n"])

    parts = rows.mapInArrow(run, "slot long, digit long, n long")
    return parts.groupBy("slot", "digit").agg(F.sum("n").alias("n"))


def order_statistics(df: DataFrame, columns: Sequence[str], wanted: dict[tuple[str, str], Sequence[int]], sizes: dict[tuple[str, str], int], key: Column | None = None) -> dict[tuple[str, str, int], float]:
    """Values by rank (from 0) among the values that are not null. wanted and sizes: ranks and number of values by (group, column); group is '' without a key."""
    columns = list(columns)
    rows = df.select((F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit("\0"))).alias("_key"), *[F.col(f"`{c}`").cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    spark = df.sparkSession
    # (group, column, rank): bits so far, the rank among the values that share them, and their number
    state = {(g, columns.index(c), r): (0, r, sizes[g, c]) for (g, c), ranks in wanted.items() for r in ranks}
    done = 0
    while state and done < 64:
        width = 64 - done if max(n for _, _, n in state.values()) <= 1 << BITS else BITS
        known: dict[tuple[str, int], set[int]] = {}
        for (g, c, _), (prefix, _, _) in state.items():
            known.setdefault((g, c), set()).add(prefix)
        ordered = {k: sorted(v) for k, v in known.items()}
        number, total = {}, 0
        for k, v in ordered.items():
            number |= {(*k, p): total + i for i, p in enumerate(v)}
            total += len(v)
        asked = sorted({(number[g, c, prefix], rank) for (g, c, _), (prefix, rank, _) in state.items()})
        counts = _scan(rows, columns, ordered, done, width)
        # a slot has 65,536 digits at most
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("digit")))
        ranks = spark.createDataFrame(asked, "slot long, rank long")
        found = upto.join(F.broadcast(ranks), "slot").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        picked = {(x["slot"], x["rank"]): (x["digit"] ^ -1 << 63 if width == 64 else x["digit"], x["rank"] - (x["upto"] - x["n"]), x["n"]) for x in found.collect()}
        state = {(g, c, r): (prefix << width | digit & (1 << width) - 1, left, n) for (g, c, r), (prefix, rank, _) in state.items() for digit, left, n in [picked[number[g, c, prefix], rank]]}
        done += width
    return {(g, columns[c], r): from_bits(bits) for (g, c, r), (bits, _, _) in state.items()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], key: Column | None = None) -> dict[tuple[str, str], tuple[int, list[float]]]:
    """(group, column): number of values, and its quantiles, interpolated as ``percentile`` does.

    ``df`` is read up to five times, so it should be a table. Nulls are no values; a column
    without values in a group is absent; a null group is named NUL. Few groups only: at
    most MOST statistics are narrowed together.
    """
    named = (F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit("\0"))).alias("_key")
    sizes = df.groupBy(named).agg(*[F.count(F.col(f"`{c}`").cast("double")).alias(f"_{k}") for k, c in enumerate(columns)])
    if key is not None and 2 * len(columns) * len(shares) * (groups := sizes.count()) > MOST:
        raise ValueError(f"{groups} groups are too many to narrow together")
    n = {(r["_key"], c): r[f"_{k}"] for r in sizes.collect() for k, c in enumerate(columns) if r[f"_{k}"]}
    places = {k: [(m - 1) * s for s in shares] for k, m in n.items()}
    found = order_statistics(df, columns, {k: sorted({x for p in v for x in (math.floor(p), math.ceil(p))}) for k, v in places.items()}, n, key)

    def between(k: tuple[str, str], p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        a, b = found[*k, low], found[*k, high]
        return a if low == high else (high - p) * a + (p - low) * b

    return {k: (n[k], [between(k, p) for p in v]) for k, v in places.items()}


def quantile_table(df: DataFrame, columns: Sequence[str], shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, n, q): the quantiles of every column by group, as a small table."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]
    found = exact_quantiles(df, columns, shares, F.concat_ws("\1", *parts) if keys else None)
    kinds = dict(df.dtypes)
    rows = [(*(None if x == "\0" else x for x in g.split("\1")[: len(keys)]), c, n, q) for (g, c), (n, q) in found.items()]
    names = [f"_{k}" for k in range(len(keys))]
    table = df.sparkSession.createDataFrame(rows, ", ".join([*(f"{k} string" for k in names), "feature string", "n long", "q array<double>"]))
    return table.select(*[F.col(n).cast(kinds[k]).alias(k) for n, k in zip(names, keys)], "feature", "n", "q")
