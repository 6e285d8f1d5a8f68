"""Feature selection on paired deltas, from aggregates of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators.effects import cohens_dz, pair_interval
from tideline.operators.lineage import kept
from tideline.operators.moments import gram_matrix
from tideline.operators.quantiles import exact_quantiles
from tideline.operators.ranking import place


def paired_deltas(long: DataFrame, features: Sequence[str], pair: str = "pair_id", visit: str = "visit") -> DataFrame:
    """One row a pair whose visits are exactly 1 and 2: deltas of all features and the interval ('annual' where the id has none)."""
    at = lambda c, v: F.min(F.when(F.col(visit) == v, F.col(c)))
    rows = long.groupBy(pair).agg(F.array_sort(F.collect_set(visit)).alias("_v"), *[(at(f, 2) - at(f, 1)).alias(f) for f in features])
    return rows.where(F.col("_v") == F.array(F.lit(1), F.lit(2))).select(pair, F.coalesce(pair_interval(F.col(pair)), F.lit("annual")).alias("interval"), *features)


def univariate_effects(deltas: DataFrame, features: Sequence[str]) -> DataFrame:
    """d12, d23, their mean and gap of every feature, ranked by |mean|, gap, name."""
    long = deltas.unpivot(["interval"], list(features), "feature", "delta")
    d = long.groupBy("feature").agg(*[cohens_dz(F.when(F.col("interval") == i, F.col("delta"))).alias(n) for i, n in (("V1->V2", "d12"), ("V2->V3", "d23"))])
    mean = F.coalesce((F.col("d12") + F.col("d23")) / 2, "d12", "d23")
    out = d.withColumn("mean_dz", mean).withColumn("abs_dz", F.abs("mean_dz")).withColumn("gap", F.abs(F.col("d12") - F.col("d23")))
    return place(out, [F.col("abs_dz").desc_nulls_last(), F.col("gap").asc_nulls_last(), "feature"], "rank")


def mrmr_features(deltas: DataFrame, features: Sequence[str], k: int = 8, penalty: float = 0.25) -> list[str]:
    """Minimum redundancy, maximum relevance: effects and correlations in Spark, the greedy walk over them here."""
    effects = {r["feature"]: r["mean_dz"] for r in univariate_effects(deltas, features).select("feature", "mean_dz").collect()}
    means = deltas.agg(*[F.avg(f).alias(f) for f in features]).first()
    filled = deltas.select(*[F.coalesce(f, F.lit(means[f])).alias(f) for f in features])
    _, _, cov = K.split(gram_matrix(filled, features)[""])
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.where(sd > 0, sd, 1)[:, None] / np.where(sd > 0, sd, 1)[None, :]
    return K.mrmr(np.array([np.nan if effects[f] is None else effects[f] for f in features]), corr, list(features), k, penalty)


def sparse_weights(deltas: DataFrame, features: Sequence[str], penalty: float = 0.01, l1_ratio: float = 0.5) -> dict[str, float]:
    """Soft-thresholded SRM weights with intervals balanced."""
    grams = gram_matrix(deltas, features, "interval")
    return dict(zip(features, K.sparse_srm([grams[k] for k in sorted(grams)], penalty, l1_ratio).tolist()))


def mml_features(df: DataFrame, features: Sequence[str], target: str) -> list[tuple[str, float]]:
    return K.mml_forward(gram_matrix(df, [*features, target])[""], list(features))


def bic_features(df: DataFrame, features: Sequence[str], target: str, most: int = 30) -> list[tuple[str, float, float]]:
    """Forward selection by BIC over median-imputed columns."""
    rows = kept(df.select(target, *features))
    medians = {c: q[0] for (_, c), (_, q) in exact_quantiles(rows, features, [0.5]).items()}
    filled = rows.select(target, *[F.coalesce(c, F.lit(medians.get(c, 0.0))).alias(c) for c in features])
    return K.bic_forward(gram_matrix(filled, [*features, target])[""], list(features), most)


def select_features(method: str, long: DataFrame, features: Sequence[str], k: int = 8, pair: str = "pair_id", visit: str = "visit", **params: float) -> list[str]:
    """Features by method: none, mi, mml, progression_univariate, progression_mrmr or sparse_srm."""
    if missing := [f for f in features if f not in long.columns]:
        raise KeyError(f"no such columns: {missing}")
    deltas = lambda: paired_deltas(long, features, pair, visit)

    def information() -> list[str]:
        from tideline.operators.stability import feature_information

        return [r["feature"] for r in place(feature_information(long, features, visit), [F.col("mi").desc_nulls_last(), "feature"], "r").where(F.col("r") <= k).orderBy("r").collect()]

    methods: dict[str, Callable[[], list[str]]] = {
        "none": lambda: list(features),
        "mi": information,
        "mml": lambda: [f for f, _ in mml_features(long.withColumn("_y", (F.col(visit) == 2).cast("double")), features, "_y")][:k],
        "progression_univariate": lambda: [r["feature"] for r in univariate_effects(deltas(), features).where(F.col("rank") <= k).orderBy("rank").collect()],
        "progression_mrmr": lambda: mrmr_features(deltas(), features, k, params.get("mrmr_redundancy_lambda", 0.25)),
        "sparse_srm": lambda: [f for f, w in sorted(sparse_weights(deltas(), features, params.get("sparse_lambda", 0.01), params.get("sparse_alpha", 0.5)).items(), key=lambda x: (-abs(x[1]), x[0])) if abs(w) > params.get("sparse_tolerance", 1e-8)][:k],
    }
    if method not in methods:
        raise ValueError(f"unknown selection method {method}")
    return methods[method]()
