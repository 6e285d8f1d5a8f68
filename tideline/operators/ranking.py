"""Ranks, top-k and the choice among candidates. Every order ends in a tie-break that is unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def place(df: DataFrame, order: Sequence[Column | str], name: str = "place", by: Sequence[str] = ()) -> DataFrame:
    """Row numbers from 1 in the given order, within each key if there are any."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, k: int, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """The first k rows of each key; Spark cuts every partition to k before it shuffles."""
    return place(df, order, "_n", by).where(F.col("_n") <= k).drop("_n")


def min_rank(df: DataFrame, by: str, name: str = "raw_rank") -> DataFrame:
    """Ranks with ties at the least, larger values first, nulls last."""
    return df.withColumn(name, F.rank().over(Window.orderBy(F.col(by).desc_nulls_last())))


def _or(df: DataFrame, column: str, default: float) -> Column:
    if column not in df.columns:
        return F.lit(default)
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.lit(default))


def near_best(candidates: DataFrame, mean: str, se: str, keys: Sequence[str] = (), order: str = "candidate_idx") -> DataFrame:
    """Candidates within one standard error of the best mean; only the best where that error is unknown."""
    known = candidates.withColumn("_mean", _or(candidates, mean, float("-inf"))).withColumn("_se", F.nanvl(F.col(se).cast("double"), F.lit(None).cast("double")))
    w = Window.partitionBy(*keys)
    first = known.withColumn("_best", F.row_number().over(w.orderBy(F.col("_mean").desc(), F.col(order))))
    bound = F.max(F.when(F.col("_best") == 1, F.col("_mean") - F.col("_se"))).over(w)
    return first.withColumn("_bound", bound).where((F.col("_best") == 1) | (F.col("_mean") >= F.col("_bound"))).drop("_bound", "_se")


def hierarchical_choice(candidates: DataFrame, mean: str = "mean_validation_annual_dz", se: str = "se_validation_dz", keys: Sequence[str] = (), order: str = "candidate_idx") -> DataFrame:
    """One candidate a key: near the best, then least gap, highest P, fewest features, most stable, highest mean."""
    inf = float("inf")
    near = near_best(candidates, mean, se, keys, order)
    c = lambda name, default: _or(near, name, default)
    ranked = [
        c("annual_interval_gap", inf).asc(),
        F.greatest(c("p_progression", -inf), c("directional_consistency", -inf)).desc(),
        c("feature_count", inf).asc(),
        c("jaccard_stability", -inf).desc(),
        F.greatest(c("sign_stability", -inf), c("coefficient_sign_stability", -inf)).desc(),
        c("score_ranking_stability", -inf).desc(),
        F.col("_mean").desc(),
        F.col(order).asc(),
    ]
    return top_k(near, 1, ranked, keys).drop("_mean", "_best")


def coefficient_table(df: DataFrame, feature: str = "feature", coef: str = "coef") -> DataFrame:
    """Absolute value, sign and rank of coefficients, largest first."""
    out = df.withColumn("abs_coef", F.abs(coef)).withColumn("sign", F.signum(coef).cast("int"))
    return place(out, [F.col("abs_coef").desc(), F.col(feature)], "rank")


def best_per_model(logs: Sequence[DataFrame], model: str = "model", score: Sequence[str] = ("annual_dz", "d_score"), gap: str = "annual_interval_gap") -> DataFrame:
    """First row of each model over logs of different columns: best score (the first known one), then least gap."""
    rows = logs[0]
    for more in logs[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    known = [F.col(s) for s in score if s in rows.columns]
    return top_k(rows.withColumn("_score", F.coalesce(*known)), 1, [F.col("_score").desc_nulls_last(), F.col(gap).asc_nulls_last(), F.col("run")], [model]).drop("_score")


def importance_labels(df: DataFrame) -> DataFrame:
    """Qualitative labels from contributions, bootstrap signs and leave-one-out losses (cut-offs at the 75th percentile)."""
    a, b = F.col("contribution_v1_v2"), F.col("contribution_v2_v3")
    size = F.coalesce((F.abs(a) + F.abs(b)) / 2, F.abs(a), F.abs(b))
    w = Window.partitionBy()
    loss = F.col("performance_loss")
    x = df.withColumn("_size", size).withColumn("_cut", F.percentile("_size", 0.75).over(w)).withColumn("_loss_cut", F.percentile(loss, 0.75).over(w))
    high = F.coalesce(F.col("_size") >= F.col("_cut"), F.lit(False))
    costly = F.coalesce((loss >= F.col("_loss_cut")) & (loss > 0), F.lit(False))
    crosses = F.coalesce((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0), F.lit(False))
    steady = F.coalesce(F.col("sign_consistency") >= 0.8, F.lit(False))
    specific = F.coalesce(F.abs(a - b) > F.abs(a + b) / 2, F.lit(False))
    label = (
        F.when(~steady | crosses, "Unstable / uncertain")
        .when(F.coalesce(F.col("redundant"), F.lit(False)) & high & ~costly, "Potentially redundant contributor")
        .when(high & costly, "Strong robust contributor")
        .when(specific & high, "Interval-specific contributor")
        .when(high | costly, "Moderate contributor")
        .otherwise("Minimal contribution")
    )
    return x.withColumn("label", label).drop("_size", "_cut", "_loss_cut")
