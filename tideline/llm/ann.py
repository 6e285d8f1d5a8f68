"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately, so k centroids a half make k * k
cells. A query walks pairs of centroids in the order of their summed distance with a
heap, until the cells that it has opened hold enough rows; those rows are ranked by
exact distance. Every row is indexed; only the centroids are fitted on a sample. The
rows that a query opens grow with the square root of all rows, and it looks at no
others: its cells are slices of the rows that a task holds. It is sent to each group of
cells that holds one of them, and on vectors without structure these are nearly all.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.cluster import durable

#: Vectors that centroids are fitted on, at most about so many.
SAMPLE = 20_000
#: Rows a centroid that a half aims at, and the most centroids of a half.
CENTROID_ROWS, MOST = 8, 1024
#: A query opens cells until they hold so many times the square root of the number of rows.
OPEN = 60
#: Rows that meet their queries in one task at a time: of neighbouring cells, or a part of one cell.
TASK_ROWS = 16_384


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from a fixed choice of rows; k or fewer, where rows are fewer."""
    rng = np.random.default_rng(3)
    centre = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        size = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        full = size > 0
        centre[full] = total[full] / size[full, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    length = (centre**2).sum(axis=1)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = np.argmin(length - 2 * (x[k : k + 4096] @ centre.T), axis=1)
    return out


@dataclass
class Cells:
    """Occupied cells in order of (left, right) centroid: ``begin`` bounds each left centroid's ones."""

    codes: np.ndarray
    counts: np.ndarray
    begin: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray, lefts: int, rights: int) -> Cells:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order]
        return cls(codes, counts, np.searchsorted(codes, np.arange(lefts + 1) * rights), codes % rights)

    def walk(self, first: np.ndarray, second: np.ndarray, wanted: int) -> list[int]:
        """Numbers of cells in the order of summed distance until they hold ``wanted`` rows.

        The heap holds the next cell of every left centroid that has entered; one enters
        when its cells may come next.
        """
        order = np.argsort(first, kind="stable")
        entry = (first[order] + second.min()).tolist()
        heap: list[tuple[float, int, int, int]] = []
        lists: dict[int, tuple[list[float], list[int]]] = {}
        out, held, p = [], 0, 0
        while held < wanted:
            while p < len(entry) and (not heap or entry[p] <= heap[0][0]):
                i = int(order[p])
                p += 1
                low, high = int(self.begin[i]), int(self.begin[i + 1])
                if high > low:
                    away = second[self.right[low:high]]
                    near = np.argsort(away, kind="stable")
                    lists[i] = (first[i] + away[near]).tolist(), (low + near).tolist()
                    heapq.heappush(heap, (lists[i][0][0], lists[i][1][0], i, 0))
            if not heap:
                break
            _, cell, i, k = heapq.heappop(heap)
            out.append(cell)
            held += int(self.counts[cell])
            sums, cells = lists[i]
            if k + 1 < len(sums):
                heapq.heappush(heap, (sums[k + 1], cells[k + 1], i, k + 1))
        return out


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares added component by component in their order."""
    squares = (rows - to) ** 2
    total = squares[:, 0].copy()
    for j in range(1, squares.shape[1]):
        total += squares[:, j]
    return np.sqrt(total)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and embedding of vectors that are not null or zero and have finite components only."""
    whole = "embedding is not null and size(embedding) > 0 and not exists(embedding, x -> coalesce(isnan(x) or abs(x) = double('inf'), true)) and exists(embedding, x -> x <> 0)"
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where(f"vec_id is not null and {whole}")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", open_rows: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """The k nearest rows found for each query, its own id left out.

    Distance is Euclidean in double precision. Returns query_id, rank (from 1), vec_id
    and score (the distance), nearest first, ties to the smaller id. Vectors that are
    null, zero, or hold a null or non-finite component take no part; vectors of each
    length have an index of their own, since no distance joins two lengths. Of rows with
    equal vectors the k + 1 smallest ids are indexed: no other can be among the k nearest.
    Rows that share an id and their vector count once; a query that shares an id with
    other vectors is asked for each and reported by its nearest rows. An empty table gives
    no rows; other columns are not read. A query opens ``open_rows`` rows, by default OPEN
    times the square root of their number; where that is all of them, the result is exact.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    same = Window.partitionBy("_h", "embedding").orderBy("vec_id")
    distinct = rows.withColumn("_h", F.xxhash64("embedding")).withColumn("_n", F.dense_rank().over(same)).where(F.col("_n") <= k + 1)
    distinct = durable(distinct.select("vec_id", "embedding", "_h").dropDuplicates(["vec_id", "_h"]))
    found = None
    for d, total in sorted((r.d, r["count"]) for r in distinct.groupBy(F.size("embedding").alias("d")).count().collect()):
        part = _search(distinct.where(F.size("embedding") == d), asked.where(F.size("embedding") == d), d, total, k, math.ceil(OPEN * math.sqrt(total)) if open_rows is None else open_rows, task_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(distinct: DataFrame, asked: DataFrame, d: int, total: int, k: int, wanted: int, task_rows: int) -> DataFrame:
    """query_id, vec_id and score of the k nearest rows of each part of the index that a query opens; vectors have d components."""
    spark, half = distinct.sparkSession, (d + 1) // 2
    share = min(1.0, SAMPLE / total)
    sample = distinct.where(F.pmod("_h", F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).orderBy("vec_id", "_h").select("embedding").toArrow()
    x = _matrix(sample.column(0).combine_chunks()) if sample.num_rows else np.zeros((1, d))
    wide = int(np.clip(total // CENTROID_ROWS, 1, MOST))
    left, right = kmeans(x[:, :half], wide), kmeans(x[:, half:], wide) if half < d else np.zeros((1, 0))
    books = spark.sparkContext.broadcast((left, right))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            m = _matrix(batch.column(1))
            if len(m):
                cell = nearest(m[:, :half], one) * len(two) + (nearest(m[:, half:], two) if len(two[0]) else 0)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int64()), pa.array([r.tobytes() for r in m], pa.binary())], names=["vec_id", "cell", "vector"])

    indexed = durable(distinct.select("vec_id", "embedding").mapInArrow(encode, "vec_id long, cell long, vector binary"))
    # one number an occupied cell, and no more than MOST * MOST cells
    sizes = indexed.groupBy("cell").count().toArrow()
    index = Cells.of(sizes["cell"].to_numpy(), sizes["count"].to_numpy(), len(left), len(right))
    # neighbouring cells share a group while they fit into a task; a larger cell is a group in several parts
    group, held, now = np.zeros(len(index.codes), dtype=np.int64), 0, 0
    for cell, n in enumerate(index.counts.tolist()):
        if held and held + n > task_rows:
            held, now = 0, now + 1
        group[cell] = now
        held += n
    parts = np.maximum(1, -(-np.bincount(group, weights=index.counts).astype(np.int64) // task_rows))
    shared = spark.sparkContext.broadcast((index, group, parts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), (cells_of, grouped, pieces) = books.value, shared.value
        for batch in batches:
            m = _matrix(batch.column(1))
            for at in range(0, len(m), 64):
                out = []
                for key, v in zip(batch.column(0)[at : at + 64].to_pylist(), m[at : at + 64]):
                    cells = np.array(cells_of.walk(((one - v[:half]) ** 2).sum(axis=1), ((two - v[half:]) ** 2).sum(axis=1), wanted), dtype=np.int64)
                    own = grouped[cells]
                    for g in np.unique(own).tolist():
                        opened = np.sort(cells[own == g]).tobytes()
                        out += [(key, g, part, v.tobytes(), opened) for part in range(int(pieces[g]))]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["vec_id", "grp", "part", "vector", "cells"])

    probes = asked.mapInArrow(probe, "vec_id long, grp long, part int, vector binary, cells binary").withColumn("asks", F.lit(1)).withColumn("cell", F.lit(0).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_of, grouped, pieces = shared.value
        for batch in batches:
            cell = np.searchsorted(cells_of.codes, batch.column(1).to_numpy())
            g = grouped[cell]
            part = (batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % pieces[g]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int64()), batch.column(2), pa.array(g), pa.array(part, pa.int32())], names=["vec_id", "cell", "vector", "grp", "part"])

    dealt = indexed.mapInArrow(place, "vec_id long, cell long, vector binary, grp long, part int").withColumn("asks", F.lit(0)).withColumn("cells", F.lit(None).cast("binary"))
    together = dealt.unionByName(probes).repartition("grp", "part").sortWithinPartitions("grp", "part", "asks")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, cells, held = None, [], [], []
        state: dict[str, np.ndarray] = {}
        out: list[tuple[int, int, float]] = []

        def answer(key: int, raw: bytes, opened: np.ndarray) -> None:
            if not ids:
                return
            if not state:
                order = np.argsort(np.array(cells), kind="stable")
                state["m"], state["i"], state["c"] = np.frombuffer(b"".join(held)).reshape(len(ids), d)[order], np.array(ids)[order], np.array(cells)[order]
            # rows are in the order of cells: each opened cell is a slice of them
            low = np.searchsorted(state["c"], opened)
            size = np.searchsorted(state["c"], opened, side="right") - low
            upto = np.cumsum(size)
            seen = np.arange(upto[-1]) + np.repeat(low - (upto - size), size)
            seen = seen[state["i"][seen] != key]
            away = distances(state["m"][seen], np.frombuffer(raw))
            near = np.flatnonzero(away <= np.partition(away, k - 1)[k - 1]) if len(away) > k else np.arange(len(away))
            near = near[np.lexsort((state["i"][seen[near]], away[near]))][:k]
            out.extend((key, int(state["i"][seen[p]]), float(away[p])) for p in near)

        def found() -> pa.RecordBatch:
            q, v, s = map(list, zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["grp"], r["part"]) != now:
                    now, ids, cells, held = (r["grp"], r["part"]), [], [], []
                    state.clear()
                if r["asks"]:
                    answer(r["vec_id"], r["vector"], np.frombuffer(r["cells"], dtype=np.int64))
                    if len(out) >= 20_000:
                        yield found()
                else:
                    ids.append(r["vec_id"])
                    cells.append(r["cell"])
                    held.append(r["vector"])
        if out:
            yield found()

    return together.mapInArrow(rank, "query_id long, vec_id long, score double")
