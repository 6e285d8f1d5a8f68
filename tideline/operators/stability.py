"""Stability of selections and coefficients, correlation, information and site effects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import kernels as K
from tideline.operators.effects import guarded_corr, with_average_rank
from tideline.operators.lineage import kept
from tideline.operators.quantiles import exact_quantiles, quantile_table


def jaccard_pairs(sets: DataFrame, key: str = "id", features: str = "features") -> DataFrame:
    """Jaccard of every two feature sets of a run list; both empty is 1, one empty is 0."""
    a = sets.select(F.col(key).alias("a"), F.col(features).alias("_fa"))
    b = sets.select(F.col(key).alias("b"), F.col(features).alias("_fb"))
    union = F.size(F.array_union("_fa", "_fb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("_fa", "_fb")) / union).alias("jaccard"))


def jaccard_summary(sets: DataFrame, **names: str) -> DataFrame:
    """Mean, median, quartiles, least and most of the pairwise Jaccard; one set alone is 1."""
    j = jaccard_pairs(sets, **names)
    q = F.percentile("jaccard", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = F.lit(1.0)
    return j.agg(F.count("*").alias("n_pairs"), F.coalesce(F.avg("jaccard"), one).alias("mean"), F.coalesce(q[1], one).alias("median"), F.coalesce(q[0], one).alias("q25"), F.coalesce(q[2], one).alias("q75"), F.coalesce(F.min("jaccard"), one).alias("min"), F.coalesce(F.max("jaccard"), one).alias("max"))


def selection_frequency(sets: DataFrame, universe: DataFrame, features: str = "features") -> DataFrame:
    """How often each feature of the universe was selected, zeros included."""
    total = sets.agg(F.count("*").alias("runs"))
    picked = sets.select(F.explode(F.array_distinct(features)).alias("feature")).groupBy("feature").agg(F.count("*").alias("k"))
    out = universe.join(picked, "feature", "left").crossJoin(F.broadcast(total))
    return out.select("feature", F.coalesce("k", F.lit(0)).cast("long").alias("count"), (F.coalesce("k", F.lit(0)) / F.nullif(F.col("runs"), F.lit(0))).alias("frequency"))


def sign_stability(coefs: DataFrame, feature: str = "feature", coef: str = "coef") -> DataFrame:
    """Share of each sign over runs, and the dominant one (ties: +, then -, then 0)."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = coefs.groupBy(feature).agg(share(F.col(coef) > 0).alias("positive"), share(F.col(coef) < 0).alias("negative"), share(F.col(coef) == 0).alias("zero"))
    best = F.greatest("positive", "negative", "zero")
    return out.withColumn("dominant_sign", F.when(F.col("positive") == best, 1).when(F.col("negative") == best, -1).otherwise(0)).withColumn("sign_stability", best)


def coefficient_summary(coefs: DataFrame, feature: str = "feature", coef: str = "coef") -> DataFrame:
    """Median and 95% interval over runs, whether it crosses zero, and how often a coefficient is not zero."""
    q = F.percentile(coef, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = coefs.groupBy(feature).agg(q.alias("q"), F.avg(F.when(F.col(coef) > 0, 1.0).otherwise(0.0)).alias("positive"), F.avg(F.when(F.col(coef) != 0, 1.0).otherwise(0.0)).alias("selected"))
    return out.select(feature, F.col("q")[1].alias("median"), F.col("q")[0].alias("ci_low"), F.col("q")[2].alias("ci_high"), "positive", "selected", ((F.col("q")[0] <= 0) & (F.col("q")[2] >= 0)).alias("crosses_zero"))


def ranking_stability(scores: DataFrame, run: str = "run", unit: str = "unit", score: str = "score", least: int = 3) -> DataFrame:
    """Spearman between every two runs over the units that both have."""
    d = scores.where(F.col(score).isNotNull())
    a = d.select(F.col(run).alias("a"), F.col(unit).alias("_u"), F.col(score).alias("x"))
    b = d.select(F.col(run).alias("b"), F.col(unit).alias("_v"), F.col(score).alias("y"))
    j = a.join(b, (F.col("_u") == F.col("_v")) & (F.col("a") < F.col("b")))
    j = with_average_rank(with_average_rank(j, "x", "_x", ["a", "b"]), "y", "_y", ["a", "b"])
    return j.groupBy("a", "b").agg(F.count("*").alias("n"), guarded_corr("_x", "_y").alias("rho")).where(F.col("n") >= least)


def correlation_pairs(df: DataFrame, features: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Pearson of every two columns over rows complete in all, from one aggregation; more than ``threshold`` only, if given."""
    rows = df.dropna(subset=list(features))
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    one = rows.agg(*[guarded_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    out = one.unpivot([], one.columns, "pair", "r").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")
    return out if threshold is None else out.where(F.abs("r") > threshold)


def with_quantile_bin(df: DataFrame, x: str, name: str, bins: int = 10) -> DataFrame:
    """``df`` with the right-closed quantile bin of a value, edges from exact quantiles with duplicates dropped."""
    _, edges = exact_quantiles(kept(df.select(x)), [x], [k / bins for k in range(1, bins)]).get(("", x), (0, []))
    return df.withColumn(name, sum(((F.col(x) > e).cast("int") for e in sorted(set(edges))), F.lit(0)))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """Plug-in mutual information in nats of two discrete columns, from joint counts."""
    joint = df.groupBy(x, y).agg(F.count("*").cast("double").alias("c"))
    all_, px, py = Window.partitionBy(), Window.partitionBy(x), Window.partitionBy(y)
    n = F.sum("c").over(all_)
    j = joint.select((F.col("c") / n).alias("p"), (F.sum("c").over(px) / n).alias("a"), (F.sum("c").over(py) / n).alias("b"))
    return j.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("a") * F.col("b")))).alias("mi"))


def feature_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of every feature's quantile bins with a label, features together in one plan."""
    rows = kept(df.select(label, *features))
    q = quantile_table(rows, features, [k / bins for k in range(1, bins)]).select("feature", F.array_distinct("q").alias("edges"))
    long = rows.unpivot([label], list(features), "feature", "value").where("value is not null")
    binned = long.join(F.broadcast(q), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    joint = binned.groupBy("feature", "bin", label).agg(F.count("*").cast("double").alias("c"))
    f = Window.partitionBy("feature")
    n = F.sum("c").over(f)
    j = joint.select("feature", (F.col("c") / n).alias("p"), (F.sum("c").over(Window.partitionBy("feature", "bin")) / n).alias("a"), (F.sum("c").over(Window.partitionBy("feature", label)) / n).alias("b"))
    return j.groupBy("feature").agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("a") * F.col("b")))).alias("mi"))


def site_anova(df: DataFrame, features: Sequence[str], site: str = "site", least: int = 5) -> DataFrame:
    """One-way ANOVA of each feature over sites from group moments: n, groups, F and R2."""
    long = df.unpivot([site], list(features), "feature", "value").where("value is not null")
    g = long.groupBy("feature", site).agg(F.count("*").alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("*")).alias("ss"))
    t = g.withColumn("_mean", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("feature")) / F.sum("n").over(Window.partitionBy("feature")))
    out = t.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("ss").alias("within"), F.sum(F.col("n") * (F.col("m") - F.col("_mean")) ** 2).alias("between"))
    out = out.where((F.col("n") >= least) & (F.col("groups") > 1) & (F.col("n") > F.col("groups")))
    return out.select("feature", "n", "groups", ((F.col("between") / (F.col("groups") - 1)) / F.nullif(F.col("within") / (F.col("n") - F.col("groups")), F.lit(0.0))).alias("f"), (F.col("between") / F.nullif(F.col("between") + F.col("within"), F.lit(0.0))).alias("r2"))


def site_screen(df: DataFrame, features: Sequence[str], covariates: Sequence[str], site: str = "site", least: int = 5) -> DataFrame:
    """Nested OLS of each feature: covariates, then site dummies too. n, delta R2, F and p.

    Rows enter by counts, means and covariances of [covariates, feature] at each site, one
    aggregate for all features. Dummies take the means of the sites out of everything, so
    the larger model is the covariates' within sites, and the smaller one theirs within
    and between. What a task fits has the size of sites and covariates. Null where there
    is one site, no degree of freedom or no spread, and below ``least`` rows.
    """
    z = list(covariates)
    long = df.select(site, *[F.col(c).cast("double").alias(c) for c in z], *[F.col(f).cast("double").alias(f) for f in features]).unpivot([site, *z], list(features), "feature", "_y").dropna()
    names = [*z, "_y"]
    pairs = [(a, b) for k, a in enumerate(names) for b in names[: k + 1]]
    sums = long.groupBy("feature", site).agg(F.count("*").alias("_n"), F.array(*[F.avg(c) for c in names]).alias("_m"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("_c"))

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size, mean, n = rows["_n"].to_numpy(float), np.stack(rows["_m"].to_numpy()), int(rows["_n"].sum())
        within = np.zeros((len(names), len(names)))
        within[np.tril_indices(len(names))] = size @ np.stack(rows["_c"].to_numpy())
        within += np.tril(within, -1).T
        apart = mean - size @ mean / n
        whole = within + (apart * size[:, None]).T @ apart
        rss = [K.residual(whole), K.residual(within)]
        d1, d2, total = len(rows) - 1, n - len(names) - len(rows) + 1, whole[-1, -1]
        fine = n >= least and d1 > 0 and d2 > 0 and rss[1] > 0 and total > 0
        f = ((rss[0] - rss[1]) / d1) / (rss[1] / d2) if fine else float("nan")
        return pd.DataFrame({"feature": [key[0]], "n": [n], "delta_r2": [(rss[0] - rss[1]) / total if fine else float("nan")], "f": [f], "p": [K.f_survival(f, d1, d2) if fine else float("nan")]})

    return sums.groupBy("feature").applyInPandas(fit, "feature string, n long, delta_r2 double, f double, p double")
