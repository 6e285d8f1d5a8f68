"""Locked models on all data, and what their features are worth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators import moments as M
from tideline.operators import cv as C
from tideline.operators.cv import Plan
from tideline.operators.effects import pair_interval
from tideline.operators.lineage import kept
from tideline.operators.resample import hash_fold, hash_number


def locked_srm(deltas: DataFrame, features: Sequence[str], ridge: float = 1e-6, shrinkage: float = 0.0) -> dict[str, float]:
    """SRM weights of all complete pairs."""
    return dict(zip(features, K.srm_weights(M.gram_matrix(deltas, features)[""], ridge, shrinkage).tolist()))


def contributions(deltas: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean of weight * delta by feature and interval, side by side, with their gap and mean size."""
    long = deltas.unpivot(["interval"], list(weights), "feature", "delta").where("delta is not null")
    w = deltas.sparkSession.createDataFrame(list(weights.items()), "feature string, weight double")
    by = long.join(F.broadcast(w), "feature").groupBy("feature").pivot("interval", ["V1->V2", "V2->V3"]).agg(F.avg(F.col("weight") * F.col("delta")))
    a, b = F.col("`V1->V2`"), F.col("`V2->V3`")
    return by.select("feature", a.alias("contribution_v1_v2"), b.alias("contribution_v2_v3"), F.abs(a - b).alias("gap"), ((F.abs(a) + F.abs(b)) / 2).alias("mean_abs"))


def domain_rollup(table: DataFrame, domains: DataFrame) -> DataFrame:
    """Contributions summed by domain; features without one are 'Unmapped MRI'."""
    j = table.join(domains, "feature", "left").withColumn("domain", F.coalesce("domain", F.lit("Unmapped MRI")))
    return j.groupBy("domain").agg(F.count("*").alias("n_features"), *[F.sum(c).alias(c) for c in ("contribution_v1_v2", "contribution_v2_v3", "mean_abs")])


def draws(h: np.ndarray, replicate: int) -> np.ndarray:
    """How often each subject comes into a replicate: a Poisson(1) draw from the subject's hash."""
    u = ((h * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64((replicate + 1) * 0xD1B54A32D192ED03 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(np.cumsum([np.exp(-1) / np.prod(range(1, k + 1), initial=1) for k in range(12)]), u, side="right")


def subgroup_importance(pair_visits: DataFrame, features: Sequence[str], modulators: Sequence[str], subgroups: dict[str, dict[str, float]], alpha: float, l1_ratio: float, replicates: int = 201, seed: int = 42) -> DataFrame:
    """Weights of an interaction model at named profiles of its modulators, over resamples of subjects.

    Returns feature, subgroup, mean, lo and hi (95% of the replicates) and sign_consistency,
    the share of replicates with the sign of the median (null if that is 0). Every replicate
    is standardised by its own means and spreads. Both that and the products with modulators
    are linear in the sums of [x, z, x * z], so one scan serves all replicates; what it
    sums has the size of replicates and features.
    """
    x, z = list(features), list(modulators)
    p, q = len(x), len(z)
    rows = kept(C.prepare(pair_visits, Plan("interaction", tuple(x), tuple(z))).withColumn("_h", hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("subject")))))
    centre, spread = C.scales_of(rows, Plan("interaction", tuple(x), tuple(z)), [C.ALL])[0]

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        one, two = (((np.stack(pdf[c].to_numpy()).astype(float) - centre) / spread) for c in ("a", "b"))
        wide = lambda v: np.column_stack([v, (v[:, :p, None] * v[:, None, p:]).reshape(len(v), p * q)])
        d = wide(two) - wide(one)
        out = {}
        for r in range(replicates):
            times = draws(pdf["_h"].to_numpy(np.uint64), r).astype(float)
            level = times @ (one + two), times @ (one * one + two * two)
            a = M.ones(d)
            out[str(r)] = np.concatenate([*level, ((a * times[:, None]).T @ a).ravel()])
        return out

    found = []
    for r, v in M.sums(rows, part).items():
        gram = M.square(v[2 * (p + q) :])
        n = gram[0, 0]
        if n < 2:
            continue
        mean = v[: p + q] / (2 * n)
        sd = np.sqrt(np.maximum(v[p + q : 2 * (p + q)] / (2 * n) - mean**2, 0))
        sd = np.where(sd > 1e-9, sd, 1.0)
        # of [1, dx, dz, d(xz)], the columns of the standardised design
        t = np.zeros((len(gram), 1 + p + p * q))
        t[0, 0] = 1.0
        for j in range(p):
            t[1 + j, 1 + j] = 1 / sd[j]
            for m in range(q):
                at, s = 1 + p + j * q + m, sd[j] * sd[p + m]
                t[1 + p + q + j * q + m, at], t[1 + j, at], t[1 + p + m, at] = 1 / s, -mean[p + m] / s, -mean[j] / s
        w = K.constant_net(t.T @ gram @ t, alpha, l1_ratio)
        for name, profile in subgroups.items():
            at = ((np.array([profile[m] for m in z]) - centre[p:]) / spread[p:] - mean[p:]) / sd[p:]
            found += [(int(r), f, name, float(w[j] + w[p + j * q : p + (j + 1) * q] @ at)) for j, f in enumerate(x)]
    beta = pair_visits.sparkSession.createDataFrame(found, "replicate int, feature string, subgroup string, beta double")
    summary = beta.groupBy("feature", "subgroup").agg(F.avg("beta").alias("mean"), F.percentile("beta", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.collect_list("beta").alias("_all"))
    middle = F.col("q")[1]
    same = F.size(F.filter("_all", lambda b: F.signum(b) == F.signum(F.col("q")[1]))) / F.size("_all")
    return summary.select("feature", "subgroup", "mean", F.col("q")[0].alias("lo"), F.col("q")[2].alias("hi"), F.when(middle != 0, same).alias("sign_consistency"))


def bootstrap_coefficients(deltas: DataFrame, features: Sequence[str], subject: str = "subject", replicates: int = 100, ridge: float = 1e-6, seed: int = 42, least: int = 2) -> DataFrame:
    """SRM coefficients (replicate, feature, coef) over resamples of subjects with multiplicity.

    A subject's weight in a replicate is a Poisson(1) draw from a hash of both, the
    limit of drawing subjects with replacement; so one scan serves all replicates, and
    grams add up wherever the rows are.
    """
    rows = deltas.select(F.col(subject).cast("string").alias("_s"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    rows = rows.withColumn("_h", hash_number(F.concat_ws("|", F.lit(str(seed)), F.col("_s"))))
    names = list(features)

    def part(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a = M.ones(pdf[names].to_numpy(float))
        return {str(r): ((a * draws(pdf["_h"].to_numpy(np.uint64), r)[:, None]).T @ a).ravel() for r in range(replicates)}

    grams = M.sums(rows, part)
    table = [(int(r), f, float(w)) for r, g in grams.items() if g[0] >= least for f, w in zip(names, K.srm_weights(M.square(g), ridge))]
    return deltas.sparkSession.createDataFrame(table, "replicate int, feature string, coef double")


def _left_out(gram: np.ndarray, weights: np.ndarray | None, inverse: np.ndarray | None, f: int, ridge: float) -> np.ndarray:
    """SRM weights without feature f, by taking its row and column out of the inverse if there is one; f's own weight is 0."""
    rest = np.delete(np.arange(len(gram) - 1), f)
    out = np.zeros(len(gram) - 1)
    if inverse is not None and abs(inverse[f, f]) > 1e-12:
        out[rest] = weights[rest] - inverse[rest, f] * (weights[f] / inverse[f, f])
    else:
        at = np.append(0, rest + 1)
        out[rest] = K.srm_weights(gram[np.ix_(at, at)], ridge)
    return out


def leave_one_feature_out(pair_visits: DataFrame, features: Sequence[str], outer: int = 5, seed: int = 42, ridge: float = 1e-6, pair: str = "pair_id", subject: str = "subject", visit: str = "visit") -> DataFrame:
    """Loss of annual out-of-fold d_z when a feature is left out, of all features from two scans.

    The first scan sums grams by fold, of pairs with all values and of those that lack one
    feature only: without that feature they are complete, so they train and are scored
    there. The model without a feature is the fold's own with a row and a column taken out
    of the factorised gram, and is solved anew only if such pairs join it. The second scan
    scores every pair by all models at once and sums by interval. Returns feature,
    dz_v1_v2, dz_v2_v3, annual_mean_dz and performance_loss, null where an interval has
    fewer than two pairs or no spread.
    """
    names, p = list(features), len(features)
    value = lambda c, v: F.coalesce(F.max(F.when(F.col(visit) == v, F.col(c).cast("double"))), F.lit(float("nan")))
    at = lambda v: F.array(*[value(c, v) for c in names])
    interval = F.when(pair_interval(F.col(pair)) == "V1->V2", 1).when(pair_interval(F.col(pair)) == "V2->V3", 2).otherwise(0)
    rows = pair_visits.groupBy(pair, subject).agg(at(1).alias("a"), at(2).alias("b"), F.count_distinct(visit).alias("_n")).where("_n = 2")
    rows = kept(rows.select(hash_fold(F.col(subject), outer, seed).alias("fold"), interval.alias("interval"), "a", "b"))
    # any centre will do; one near the values saves digits
    some = np.array([x for r in rows.select("a").limit(1000).collect() for x in [r["a"]]], dtype=float).reshape(-1, p)
    seen = ~np.isnan(some)
    centre = np.where(seen.any(axis=0), np.where(seen, some, 0).sum(axis=0) / np.maximum(seen.sum(axis=0), 1), 0.0)

    def parts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.stack(pdf[c].to_numpy()).astype(float) - centre for c in ("a", "b"))
        lack = np.isnan(a) | np.isnan(b)
        a[lack], b[lack] = 0.0, 0.0
        return a, b, np.where(lack.sum(axis=1) == 0, -1, np.where(lack.sum(axis=1) == 1, lack.argmax(axis=1), -2)), pdf["fold"].to_numpy(), pdf["interval"].to_numpy()

    def grams(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b, lacks, fold, _ = parts(pdf)
        out = {}
        for o, f in {*zip(fold.tolist(), lacks.tolist())}:
            m = (fold == o) & (lacks == f)
            if f > -2:
                out[f"{o}/{f}"] = np.concatenate([M.gram(b[m] - a[m]), (a[m] + b[m]).sum(axis=0), (a[m] ** 2 + b[m] ** 2).sum(axis=0)])
        return out

    found = M.sums(rows, grams)
    size = (p + 1) ** 2
    total = lambda o, f: sum((found[k] for q in range(outer) if q != o and (k := f"{q}/{f}") in found), np.zeros(size + 2 * p))

    def standard(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gram of standardised deltas, and the spreads."""
        n = max(2 * v[0], 1)
        sd = np.sqrt(np.maximum(v[size + p :] / n - (v[size : size + p] / n) ** 2, 0))
        sd = np.where(sd > 1e-9, sd, 1.0)
        scale = np.append(1.0, 1 / sd)
        return M.square(v[:size]) * scale[:, None] * scale, sd

    models, usable = {}, {}
    for o in range(outer):
        whole = total(o, -1)
        gram, sd = standard(whole)
        weights, inverse = np.zeros(p), None
        if whole[0] >= 2:
            _, mean, cov = K.split(gram)
            try:
                inverse = np.linalg.inv(cov + ridge * np.eye(p))
            except np.linalg.LinAlgError:
                inverse = None
            weights = K.srm_weights(gram, ridge)
        # column 0 has all features, column 1 + f is without f; on the scale of raw deltas
        models[o], usable[o] = np.zeros((p, p + 1)), np.full(p + 1, whole[0] >= 2)
        models[o][:, 0] = weights / sd
        for f in range(p):
            more = total(o, f)
            if more[0]:
                own, spread = standard(whole + more)
                models[o][:, 1 + f] = _left_out(own, None, None, f, ridge) / spread
                usable[o][1 + f] = whole[0] + more[0] >= 2
            elif whole[0] >= 2:
                models[o][:, 1 + f] = _left_out(gram, weights, inverse, f, ridge) / sd

    def scores(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b, lacks, fold, interval = parts(pdf)
        out = np.zeros((2, 3, p + 1))
        for o in np.unique(fold).tolist():
            for t in (1, 2):
                here = (fold == o) & (interval == t)
                for f in np.unique(lacks[here]).tolist():
                    if f == -2:
                        continue
                    m = here & (lacks == f)
                    d = (b[m] - a[m]) @ models[o]
                    mine = usable[o] if f == -1 else usable[o] & (np.arange(p + 1) == 1 + f)
                    out[t - 1] += np.stack([np.full(p + 1, len(d)), d.sum(axis=0), (d * d).sum(axis=0)]) * mine
        return {"": out.ravel()}

    n, s, q = M.sums(rows, scores).get("", np.zeros(6 * (p + 1))).reshape(2, 3, p + 1).transpose(1, 0, 2)
    with np.errstate(all="ignore"):
        var = np.where(n >= 2, (q - s * s / n) / (n - 1), np.nan)
        d = np.where(var > 1e-300, s / n / np.sqrt(var), np.nan)
    mean = d.mean(axis=0)
    plain = lambda x: None if np.isnan(x) else float(x)
    table = [(f, plain(d[0, 1 + k]), plain(d[1, 1 + k]), plain(mean[1 + k]), plain(mean[0] - mean[1 + k])) for k, f in enumerate(names)]
    return pair_visits.sparkSession.createDataFrame(table, "feature string, dz_v1_v2 double, dz_v2_v3 double, annual_mean_dz double, performance_loss double")


def linear_shap(df: DataFrame, weights: dict[str, float], keep: Sequence[str]) -> DataFrame:
    """Exact SHAP values of a linear score: weight times the distance from the mean, by row and feature."""
    means = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in weights])
    j = df.crossJoin(F.broadcast(means))
    return j.select(*keep, *[(F.lit(w) * (F.col(f) - F.col(f"_m_{f}"))).alias(f) for f, w in weights.items()]).unpivot(list(keep), list(weights), "feature", "shap")


def integrated(coefs: DataFrame, *tables: DataFrame) -> DataFrame:
    """Evidence tables LEFT joined to the coefficients on feature."""
    for t in tables:
        coefs = coefs.join(t, "feature", "left")
    return coefs
