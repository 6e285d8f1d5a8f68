"""Elastic nets over a whole grid, for all folds and repeats, from one scan.

A fold's rows enter by their cross products. A training set adds those of the other
folds, and the held-out error of any candidate is a quadratic form of the fold's own, so
no row is read again. Along the grid a fit starts from its neighbour's and leaves out
columns that the strong rule says stay zero; what breaks the optimality conditions
afterwards comes back in. Training sets are solved as rows of a table, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators import moments as M
from tideline.operators.composite import complete_rows
from tideline.operators.lineage import kept
from tideline.operators.resample import hash_fold, hash_number


class Grid(NamedTuple):
    """fits: repeat, fold, alpha, l1_ratio, coefs (standard scale, by feature), n, sse. chosen: the fit of least error a fold."""

    fits: DataFrame
    chosen: DataFrame


def descend_active(a: np.ndarray, b: np.ndarray, w: np.ndarray, active: np.ndarray, l1: float, l2: float, rounds: int = 5000, tol: float = 1e-12) -> np.ndarray:
    """Coordinate descent over ``active`` columns from ``w``, which keeps its gradient beside it."""
    w = w.copy()
    g = b - a @ w
    for _ in range(rounds):
        most = 0.0
        for j in active.tolist():
            top = a[j, j] + l2
            new = K.soft(g[j] + a[j, j] * w[j], l1) / (top if top else 1.0)
            if (step := new - w[j]) != 0.0:
                g -= a[:, j] * step
                w[j] = new
                most = max(most, abs(step))
        if most < tol:
            break
    return w


def net_path(a: np.ndarray, b: np.ndarray, alphas: Sequence[float], l1_ratios: Sequence[float]) -> dict[tuple[float, float], np.ndarray]:
    """Weights by (alpha, l1_ratio) for A = X'X/n and b = X'y/n, the strongest penalty first, each from the one before."""
    every, out = np.arange(len(b)), {}
    for ratio in l1_ratios:
        w, before = np.zeros(len(b)), None
        for alpha in sorted(alphas, reverse=True):
            l1, l2 = alpha * ratio, alpha * (1 - ratio)
            slope = np.abs(b - a @ w)
            # the slope changes by no more than the penalty does
            held = every if before is None else np.flatnonzero((slope >= 2 * l1 - before) | (w != 0))
            while True:
                w = descend_active(a, b, np.where(np.isin(every, held), w, 0.0), held, l1, l2)
                broken = np.setdiff1d(np.flatnonzero(np.abs(b - a @ w) > l1 * (1 + 1e-9) + 1e-12), held)
                if not len(broken):
                    break
                held = np.union1d(held, broken)
            out[alpha, ratio], before = w, l1
    return out


def standard_moments(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, spreads and correlations of X and y from the gram of [1, X, y]; no spread counts as 1."""
    n = max(gram[0, 0], 1.0)
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    return mean, sd, cov / sd[:, None] / sd


def squared_error(gram: np.ndarray, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> float:
    """Sum of squared errors on the rows of a gram, of weights on another set's standard scale."""
    raw = sd[-1] * w / sd[:-1]
    v = np.concatenate([[mean[-1] - mean[:-1] @ raw], raw, [-1.0]])
    return max(float(v @ gram @ v), 0.0)


def _centred(df: DataFrame, features: Sequence[str], target: str, subject: str) -> tuple[DataFrame, list[str]]:
    """Complete rows within the fences with their subject, around the mean of all of them."""
    names = [*features, target]
    rows = complete_rows(df, features, target).select(F.col(subject).cast("string").alias("_s"), *[F.col(c).cast("double").alias(c) for c in names])
    means = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    return rows.select("_s", *[(F.col(c) - F.lit(float(means[c] or 0.0))).alias(c) for c in names]), names


def repeated_grid(df: DataFrame, features: Sequence[str], target: str, subject: str = "subject", alphas: Sequence[float] = (0.1, 1.0), l1_ratios: Sequence[float] = (0.0, 0.5), folds: int = 5, repeats: int = 5, seed: int = 42) -> Grid:
    """All candidates on all grouped folds of all repeats, X and y standardised by the training rows.

    The chosen candidate of a fold has the least error on its held-out rows, which is
    optimistic; ties go to the stronger penalty, then to the larger l1_ratio. A fold
    beside which fewer than two rows are left has no fit. Rows lacking a value, or
    outside a feature's fences, take no part.
    """
    rows, names = _centred(df, features, target, subject)
    rows = kept(rows.select(*names, F.array(*[hash_fold(F.col("_s"), folds, seed + r) for r in range(repeats)]).alias("_folds")))

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        x, fold = pdf[names].to_numpy(float), np.stack(pdf["_folds"].to_numpy())
        return {f"{r}/{o}": M.gram(x[fold[:, r] == o]) for r in range(repeats) for o in np.unique(fold[:, r]).tolist()}

    grams = {tuple(map(int, k.split("/"))): v for k, v in M.sums(rows, part).items()}
    table = []
    for (r, o), own in grams.items():
        rest = sum((v for (q, f), v in grams.items() if q == r and f != o), np.zeros_like(own))
        if rest[0] >= 2:
            table.append((r, o, bytearray(rest.tobytes()), bytearray(own.tobytes())))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                train, held = M.square(np.frombuffer(x.train)), M.square(np.frombuffer(x.held))
                mean, sd, corr = standard_moments(train)
                path = net_path(corr[:-1, :-1], corr[:-1, -1], alphas, l1_ratios)
                out = [(x.repeat, x.fold, a, ratio, w.tolist(), int(round(held[0, 0])), squared_error(held, mean, sd, w)) for (a, ratio), w in path.items()]
                yield pd.DataFrame(out, columns=["repeat", "fold", "alpha", "l1_ratio", "coefs", "n", "sse"])

    sets = df.sparkSession.createDataFrame(table, "repeat int, fold int, train binary, held binary").repartition(max(1, len(table)), "repeat", "fold")
    fits = kept(sets.mapInPandas(solve, "repeat int, fold int, alpha double, l1_ratio double, coefs array<double>, n long, sse double"))
    best = F.row_number().over(Window.partitionBy("repeat", "fold").orderBy("sse", F.col("alpha").desc(), F.col("l1_ratio").desc()))
    return Grid(fits, fits.withColumn("_r", best).where("_r = 1").drop("_r"))


def coefficients(fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """The fits with a row a feature: feature, coef."""
    names = F.array(*[F.lit(f) for f in features])
    return fits.select("repeat", "fold", "alpha", "l1_ratio", F.posexplode("coefs").alias("_j", "coef")).select("repeat", "fold", "alpha", "l1_ratio", F.element_at(names, F.col("_j") + 1).alias("feature"), "coef")


def grid_summary(df: DataFrame, features: Sequence[str], target: str, grid: Grid) -> DataFrame:
    """n_before, n_after, RMSE and R2 of the chosen fits over all repeats, and the commonest and mean candidate."""
    before = df.dropna(subset=[*features, target]).agg(F.count("*").alias("n_before"))
    y = complete_rows(df, features, target).agg(F.count("*").alias("n_after"), F.var_pop(target).alias("_v"))
    common = [F.mode(c, deterministic=True).alias(f"{c}_mode") for c in ("alpha", "l1_ratio")]
    one = grid.chosen.agg(F.sum("n").alias("_n"), F.sum("sse").alias("_e"), *common, F.avg("alpha").alias("alpha_mean"), F.avg("l1_ratio").alias("l1_ratio_mean"))
    # one row each
    out = one.crossJoin(F.broadcast(before)).crossJoin(F.broadcast(y))
    return out.select("n_before", "n_after", F.sqrt(F.col("_e") / F.col("_n")).alias("rmse"), (1 - F.col("_e") / F.nullif(F.col("_n") * F.col("_v"), F.lit(0.0))).alias("r2"), "alpha_mode", "l1_ratio_mode", "alpha_mean", "l1_ratio_mean")


def net_bootstrap(df: DataFrame, features: Sequence[str], target: str, subject: str = "subject", replicates: int = 201, alpha: float = 1.3, l1_ratio: float = 0.0, seed: int = 42) -> DataFrame:
    """feature, coef_mean, coef_p2_5, coef_p97_5 and pct_nonzero of a net over resamples of subjects.

    A replicate has every row of each subject that it draws at least once; a subject is
    in with 1 - 1/e, the limit of drawing with replacement, by the md5 of replicate and
    subject. So replicates are sums over the rows that they hold, from one scan, and X and
    y are standardised by each replicate's own rows.
    """
    rows, names = _centred(df, features, target, subject)
    least = int((1 - np.exp(-1)) * (1 << 32))
    member = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: hash_number(F.concat_ws("|", F.lit(str(seed)), r.cast("string"), F.col("_s"))) < least)
    rows = rows.select(*names, member.alias("_in"))

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, inside = M.ones(pdf[names].to_numpy(float)), np.stack(pdf["_in"].to_numpy())
        return {str(r): (a[inside[:, r]].T @ a[inside[:, r]]).ravel() for r in range(replicates)}

    found = []
    for v in M.sums(rows, part).values():
        gram = M.square(v)
        if gram[0, 0] >= 2:
            _, _, corr = standard_moments(gram)
            found.append(net_path(corr[:-1, :-1], corr[:-1, -1], [alpha], [l1_ratio])[alpha, l1_ratio])
    if not found:
        return df.sparkSession.createDataFrame([], "feature string, coef_mean double, coef_p2_5 double, coef_p97_5 double, pct_nonzero double")
    coefs = np.stack(found)
    low, high = np.percentile(coefs, [2.5, 97.5], axis=0)
    table = zip(features, coefs.mean(axis=0).tolist(), low.tolist(), high.tolist(), (coefs != 0).mean(axis=0).tolist())
    return df.sparkSession.createDataFrame(list(table), "feature string, coef_mean double, coef_p2_5 double, coef_p97_5 double, pct_nonzero double")
