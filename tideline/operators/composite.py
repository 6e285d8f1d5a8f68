"""Composites of a clinical target: elastic nets that leave one subject out at a time.

A training set is everything less one subject, so its moments are the whole sums less the
subject's own. The whole sums are small and travel with the task; every subject is fitted
and scored where its rows are.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators import moments as M
from tideline.operators.audit import tukey_rows

#: The grid that the held-out search tries.
ALPHAS, L1_RATIOS = tuple(float(x) for x in np.logspace(-2, 2, 10)), (0.1, 0.5, 0.9)


def complete_rows(df: DataFrame, features: Sequence[str], target: str, fences: float = 3.0) -> DataFrame:
    """Rows with all values and none outside a feature's fences."""
    return tukey_rows(df.dropna(subset=[*features, target]), features, fences).where("not outlier").drop("outlier")


def leave_one_subject_out(df: DataFrame, features: Sequence[str], target: str, subject: str = "subject", alphas: Sequence[float] = (1.3,), l1_ratios: Sequence[float] = (0.0,), scale_target: bool = True) -> DataFrame:
    """Every row with the prediction of a net that has not seen its subject: subject, target, prediction, alpha, l1_ratio.

    Of several candidates the one of least error on the subject itself is taken, which is
    optimistic. A subject beside which fewer than two rows are left has no prediction.
    """
    rows = complete_rows(df, features, target).select(F.col(subject).cast("string").alias("subject"), *[F.col(c).cast("double").alias(c) for c in (*features, target)])
    names = [*features, target]
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    centre = np.array([means[c] or 0.0 for c in names])
    whole = M.gram_matrix(rows.select(*[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(names, centre)]), names).get("")
    grid = list(product(alphas, l1_ratios))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[names].to_numpy(float) - centre
        rest = whole - M.square(M.gram(v))
        n, best = rest[0, 0], (np.inf, None, None, None)
        if n >= 2:
            mean = rest[0, 1:] / n
            cov = rest[1:, 1:] / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            sd = np.where(sd > 1e-12, sd, 1.0)
            if not scale_target:
                sd[-1] = 1.0
            cov = cov / sd[:, None] / sd
            for alpha, l1_ratio in grid:
                w = K.descend(cov[:-1, :-1], cov[:-1, -1], alpha, l1_ratio)
                p = centre[-1] + mean[-1] + sd[-1] * (((v[:, :-1] - mean[:-1]) / sd[:-1]) @ w)
                error = float(np.sqrt(np.mean((p - pdf[target].to_numpy(float)) ** 2)))
                if error < best[0]:
                    best = (error, p, alpha, l1_ratio)
        return pd.DataFrame({"subject": pdf["subject"], "target": pdf[target], "prediction": best[1], "alpha": best[2], "l1_ratio": best[3]})

    return rows.groupBy("subject").applyInPandas(score, "subject string, target double, prediction double, alpha double, l1_ratio double")


def search_summary(found: DataFrame) -> DataFrame:
    """n, RMSE, R2, and the commonest and mean candidate over subjects."""
    error = (F.col("target") - F.col("prediction")) ** 2
    fit = found.agg(F.count("*").alias("n_rows"), F.sqrt(F.avg(error)).alias("rmse"), (1 - F.sum(error) / (F.var_pop("target") * F.count("*"))).alias("r2"))
    subjects = found.where("alpha is not null").groupBy("subject").agg(F.first("alpha").alias("alpha"), F.first("l1_ratio").alias("l1_ratio"))
    common = subjects.agg(F.mode("alpha", deterministic=True).alias("alpha_mode"), F.mode("l1_ratio", deterministic=True).alias("l1_mode"), F.avg("alpha").alias("alpha_mean"), F.avg("l1_ratio").alias("l1_mean"))
    # one row each
    return fit.crossJoin(F.broadcast(common))
