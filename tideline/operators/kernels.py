"""Small dense numerical kernels in NumPy, for use inside grouped functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: Column | str, df: Column) -> Column:
    """Two-sided p of Student's t; null for unknown t or no degrees of freedom."""

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(k) or k <= 0 else beta_inc(k / 2, 0.5, k / (k + x * x)) for x, k in zip(t, n)], dtype="float64")

    return p(F.col(t) if isinstance(t, str) else t, df.cast("double"))


def f_survival(f: float, d1: int, d2: int) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 and d1 > 0 and d2 > 0 else float("nan")


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a linear system, by pseudo-inverse where it is singular."""
    try:
        out = np.linalg.solve(a, b)
        if np.isfinite(out).all():
            return out
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(a) @ b


def residual(a: np.ndarray, tolerance: float = 1e-10) -> float:
    """What is left of the last diagonal entry of a cross-product matrix when all other columns are swept out.

    A column of which less than ``tolerance`` is left beside those before it is passed over.
    """
    a = a.copy()
    scale = np.diag(a).copy()
    for k in range(len(a) - 1):
        if a[k, k] > tolerance * scale[k]:
            a -= np.outer(a[:, k], a[k]) / a[k, k]
    return max(float(a[-1, -1]), 0.0)


def effect(x: np.ndarray, eps: float = 0.0) -> float:
    """mean / sd (ddof 1) of finite values; NaN for fewer than two or no spread."""
    x = x[np.isfinite(x)]
    if len(x) < 2:
        return float("nan")
    sd = x.std(ddof=1) + eps
    return float(x.mean() / sd) if sd > 0 else float("nan")


def split(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, means and covariance (ddof 1) from the gram matrix of [1, X]."""
    n = float(gram[0, 0])
    if n < 1:
        return n, np.full(len(gram) - 1, np.nan), np.full((len(gram) - 1,) * 2, np.nan)
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    return n, mean, centred / (n - 1) if n > 1 else np.full_like(centred, np.nan)


def srm_weights(gram: np.ndarray, ridge: float = 1e-6, shrinkage: float = 0.0) -> np.ndarray:
    """Weights of the composite whose change is largest against its spread: (shrunk covariance + ridge)^-1 mean.

    gram is of [1, deltas]; fewer than two pairs give zeros.
    """
    n, mean, cov = split(gram)
    if n < 2:
        return np.zeros(len(gram) - 1)
    cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(len(cov))
    return solve(cov, mean)


def lda_weights(first: np.ndarray, second: np.ndarray, shrinkage: float = 0.0, ridge: float | None = None) -> np.ndarray | None:
    """Fisher's direction between two visits' grams, both with equal weight; None if one has fewer than two rows."""
    (n1, m1, c1), (n2, m2, c2) = split(first), split(second)
    if min(n1, n2) < 2:
        return None
    pooled = 0.5 * (c1 + c2)
    pooled = (1 - shrinkage) * pooled + shrinkage * np.diag(np.diag(pooled))
    if ridge is None:
        ridge = 1e-3 * np.trace(pooled) / len(pooled)
    return solve(pooled + ridge * np.eye(len(pooled)), m2 - m1)


def soft(z: float, g: float) -> float:
    return math.copysign(max(abs(z) - g, 0.0), z)


def descend(a: np.ndarray, b: np.ndarray, alpha: float, l1_ratio: float, rounds: int = 5000, tol: float = 1e-9) -> np.ndarray:
    """Cyclic coordinate descent for 1/2 w'Aw - b'w + alpha (l1 |w|_1 + (1 - l1) / 2 |w|^2), A = X'X/n and b = X'y/n."""
    w = np.zeros(len(b))
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(b)):
            top = a[j, j] + l2
            new = soft(b[j] - a[j] @ w + a[j, j] * w[j], l1) / (top if top else 1.0)
            most, w[j] = max(most, abs(new - w[j])), new
        if most < tol:
            break
    return w


def elastic_net(gram: np.ndarray, alpha: float, l1_ratio: float, intercept: bool = True) -> tuple[np.ndarray, float]:
    """Elastic net of y on X from the gram of [1, X, y]; without an intercept nothing is centred."""
    n = gram[0, 0]
    mean = gram[0, 1:-1] / n if intercept else np.zeros(len(gram) - 2)
    y = gram[0, -1] / n if intercept else 0.0
    w = descend(gram[1:-1, 1:-1] / n - np.outer(mean, mean), gram[1:-1, -1] / n - mean * y, alpha, l1_ratio)
    return w, float(y - mean @ w)


def constant_net(gram: np.ndarray, alpha: float, l1_ratio: float) -> np.ndarray:
    """Elastic net without intercept of the constant 1 on deltas, from the gram of [1, deltas]."""
    n = gram[0, 0]
    return descend(gram[1:, 1:] / n, gram[0, 1:] / n, alpha, l1_ratio)


def message_length(gram: np.ndarray, columns: list[int], ridge: float = 1e-6) -> float:
    """MML87 message length of the least-squares fit of y on some columns, from the gram of [1, X, y]; smaller is better."""
    at = [0, *[c + 1 for c in columns]]
    n, p = gram[0, 0], len(at)
    xx, xy, yy = gram[np.ix_(at, at)], gram[at, -1], gram[-1, -1]
    w = solve(xx + ridge * np.eye(p), xy)
    variance = max((yy - 2 * w @ xy + w @ xx @ w) / n, 1e-12)
    sign, log = np.linalg.slogdet(xx)
    if sign <= 0 or not np.isfinite(log):
        log = np.linalg.slogdet(xx + ridge * np.eye(p))[1]
    return float(0.5 * p * math.log(n / 12) + 0.5 * (log - p * math.log(variance)) + 0.5 * n * math.log(2 * math.pi * variance) + 0.5 * n)


def mml_forward(gram: np.ndarray, names: list[str], least: float = 1e-9) -> list[tuple[str, float]]:
    """Add the feature that shortens the message most while one does: (feature, message length)."""
    chosen: list[int] = []
    best, out = message_length(gram, chosen), []
    while len(chosen) < len(names):
        score, _, j = min((message_length(gram, [*chosen, j]), names[j], j) for j in range(len(names)) if j not in chosen)
        if best - score <= least:
            break
        best, chosen = score, [*chosen, j]
        out.append((names[j], score))
    return out


def bic_forward(gram: np.ndarray, names: list[str], most: int = 30) -> list[tuple[str, float, float]]:
    """Forward least squares by BIC from the gram of [1, X, y]: (feature, aic, bic) of each step."""
    n = gram[0, 0]

    def fit(columns: list[int]) -> tuple[float, float]:
        at = [0, *[c + 1 for c in columns]]
        xx, xy = gram[np.ix_(at, at)], gram[at, -1]
        rss = max(float(gram[-1, -1] - xy @ solve(xx, xy)), 1e-12 * n)
        return float(n * math.log(rss / n) + math.log(n) * len(at)), float(n * math.log(rss / n) + 2 * len(at))

    chosen: list[int] = []
    best, out = fit([])[0], []
    while len(chosen) < min(most, len(names)):
        (bic, aic), _, j = min((fit([*chosen, j]), names[j], j) for j in range(len(names)) if j not in chosen)
        if bic >= best:
            break
        best, chosen = bic, [*chosen, j]
        out.append((names[j], aic, bic))
    return out


def mrmr(effects: np.ndarray, corr: np.ndarray, names: list[str], k: int, penalty: float = 0.25) -> list[str]:
    """Greedy choice by effect minus ``penalty`` times the mean absolute correlation with what is chosen; ties to the first name."""
    gain = np.where(np.isfinite(effects), np.abs(effects), -np.inf)
    chosen: list[int] = []
    while len(chosen) < min(k, len(names)):
        left = [j for j in range(len(names)) if j not in chosen]
        value = {j: gain[j] - (penalty * np.abs(corr[j, chosen]).mean() if chosen else 0.0) for j in left}
        chosen.append(min(left, key=lambda j: (-value[j], names[j])))
    return [names[j] for j in chosen]


def sparse_srm(grams: list[np.ndarray], penalty: float = 0.01, l1_ratio: float = 0.5) -> np.ndarray:
    """SRM weights after a soft threshold; means and covariances of the intervals count alike."""
    parts = [(m, c) for n, m, c in map(split, grams) if n >= 2]
    if not parts:
        return np.zeros(len(grams[0]) - 1 if grams else 0)
    mean, cov = np.mean([m for m, _ in parts], axis=0), np.mean([c for _, c in parts], axis=0)
    w = solve(cov + (penalty * (1 - l1_ratio) + 1e-8) * np.eye(len(mean)), mean)
    return np.array([soft(v, penalty * l1_ratio) for v in w])
