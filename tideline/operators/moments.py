"""Gram matrices as the sufficient statistics of every linear fit here.

A pass over the rows adds [1, X]'[1, X] batch by batch; partial sums meet in two
levels. What reaches the driver has the size of folds and features, never of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KIND = "key string, task int, gram binary"


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(g) for g in pdf["gram"])
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "task": [pdf["task"].min()], "gram": [total.tobytes()]})


def sums(df: DataFrame, per_batch: Callable[[pd.DataFrame], dict[str, np.ndarray]], small: bool = False) -> dict[str, np.ndarray]:
    """The sum over all batches of named arrays; a name has one length everywhere.

    Of ``small`` arrays the driver adds the last 64 parts itself, which saves a stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, v in per_batch(batch.to_pandas()).items():
                total[k] = total[k] + v if k in total else v
        task = TaskContext.get().partitionId()
        packed = [np.ascontiguousarray(v, dtype=float).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([task] * len(total), pa.int32()), pa.array(packed, pa.binary())], names=["key", "task", "gram"])

    parts = df.mapInArrow(run, KIND)
    some = parts.groupBy("key", F.expr("task % 64").alias("g")).applyInPandas(lambda pdf: _add(pdf), KIND)
    if not small:
        some = some.groupBy("key").applyInPandas(lambda pdf: _add(pdf), KIND)
    out: dict[str, np.ndarray] = {}
    for r in sorted(some.collect()):
        v = np.frombuffer(r["gram"])
        out[r["key"]] = out[r["key"]] + v if r["key"] in out else v
    return out


def ones(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def gram(x: np.ndarray) -> np.ndarray:
    a = ones(x)
    return (a.T @ a).ravel()


def square(flat: np.ndarray) -> np.ndarray:
    n = int(round(len(flat) ** 0.5))
    return flat.reshape(n, n)


def gram_matrix(df: DataFrame, columns: Sequence[str], key: str | None = None) -> dict[str, np.ndarray]:
    """Gram of [1, columns] over rows without nulls, by key ('' without one)."""
    columns = list(columns)
    rows = df.select(*([F.col(key).cast("string").alias("_k")] if key else []), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        if key is None:
            return {"": gram(pdf[columns].to_numpy(float))}
        return {str(k): gram(g[columns].to_numpy(float)) for k, g in pdf.groupby("_k")}

    return {k: square(v) for k, v in sums(rows, part).items()}
