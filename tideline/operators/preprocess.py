"""Scaling and imputation fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.lineage import kept
from tideline.operators.quantiles import exact_quantiles, quantile_table


def zscore_by_fold(df: DataFrame, columns: Sequence[str], fold: str = "fold", folds: int = 5) -> DataFrame:
    """Every row once per outer fold, standardised by that fold's training rows (all rows of other folds).

    Returns outer, is_test and the scaled columns; sd is of ddof 0, and no spread counts
    as 1. Centred moments by fold make those of all training sets, merged around the mean
    of all rows: a training set is everything less its own fold.
    """
    own = [s for c in columns for s in (F.count(c).alias(f"_n_{c}"), F.avg(c).alias(f"_a_{c}"), F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias(f"_v_{c}"))]
    per = df.groupBy(fold).agg(*own)
    # a window over the folds, of which there are few
    w = Window.partitionBy()
    centre = {c: F.sum(F.col(f"_n_{c}") * F.col(f"_a_{c}")).over(w) / F.nullif(F.sum(f"_n_{c}").over(w), F.lit(0)) for c in columns}
    per = per.select("*", *[centre[c].alias(f"_c_{c}") for c in columns], *[(F.col(f"_n_{c}") * (F.coalesce(f"_a_{c}", F.lit(0.0)) - F.coalesce(centre[c], F.lit(0.0)))).alias(f"_s_{c}") for c in columns])
    per = per.select("*", *[(F.col(f"_v_{c}") + F.coalesce(F.col(f"_s_{c}") * F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0)), F.lit(0.0))).alias(f"_q_{c}") for c in columns])
    rest = per.select(F.col(fold).alias("outer"), *[F.col(f"_c_{c}") for c in columns], *[(F.sum(f"{m}{c}").over(w) - F.col(f"{m}{c}")).alias(f"{m}{c}") for c in columns for m in ("_n_", "_s_", "_q_")])
    mu = {c: F.col(f"_s_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0)) for c in columns}
    sd = {c: F.sqrt(F.greatest(F.col(f"_q_{c}") / F.nullif(F.col(f"_n_{c}"), F.lit(0)) - mu[c] * mu[c], F.lit(0.0))) for c in columns}
    params = rest.select("outer", *[(F.col(f"_c_{c}") + mu[c]).alias(f"_mu_{c}") for c in columns], *[F.when(sd[c] > 1e-9, sd[c]).otherwise(1.0).alias(f"_sd_{c}") for c in columns])
    # one row a fold
    both = df.crossJoin(F.broadcast(params))
    return both.select("outer", (F.col(fold) == F.col("outer")).alias("is_test"), *[c for c in df.columns if c not in columns], *[((F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")).alias(c) for c in columns])


def median_impute_by_fold(df: DataFrame, columns: Sequence[str], fold: str = "fold", fill_empty: float = 0.0) -> DataFrame:
    """Every row once per outer fold, nulls filled with the exact median of that fold's training rows."""
    folds = df.select(F.col(fold).alias("outer")).distinct()
    both = df.crossJoin(F.broadcast(folds))
    long = quantile_table(kept(both.where(F.col(fold) != F.col("outer")).select("outer", *columns)), columns, [0.5], ["outer"])
    medians = long.groupBy("outer").agg(*[F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"_m_{c}") for c in columns])
    out = both.join(F.broadcast(medians), "outer", "left")
    return out.select("outer", (F.col(fold) == F.col("outer")).alias("is_test"), *[c for c in df.columns if c not in columns], *[F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.col(f"_m_{c}"), F.lit(fill_empty)).alias(c) for c in columns])


def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean-imputed columns as z-scores of ddof 1 (of the imputed values); no spread counts as 1."""
    one = df.agg(F.count("*").alias("n"), *[a for c in columns for a in (F.avg(c).alias(f"m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"v_{c}"))]).first()
    # imputed values add nothing to the sum of squares around the mean
    sd = {c: ((one[f"v_{c}"] or 0.0) / (one["n"] - 1)) ** 0.5 if one["n"] > 1 else 0.0 for c in columns}
    scaled = {c: (F.coalesce(F.col(c), F.lit(one[f"m_{c}"])) - F.lit(one[f"m_{c}"])) / F.lit(sd[c] or 1.0) for c in columns}
    return df.select(*[c for c in df.columns if c not in columns], *[scaled[c].alias(c) for c in columns])


class ColumnScaler:
    """Train-only standard scaler: fit on one frame, transform others; sd up to ``eps`` counts as 1."""

    def __init__(self, columns: Sequence[str], eps: float = 1e-12):
        self.columns, self.eps = list(columns), eps

    def fit(self, df: DataFrame) -> ColumnScaler:
        row = df.agg(*[a for c in self.columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        self.mean = {c: row[f"m_{c}"] or 0.0 for c in self.columns}
        self.sd = {c: s if (s := row[f"s_{c}"]) and s > self.eps else 1.0 for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - self.mean[c]) / self.sd[c] for c in self.columns})


class MedianImputer:
    """Train-only imputer with exact medians; columns without any value get ``fill_empty``."""

    def __init__(self, columns: Sequence[str], fill_empty: float = 0.0):
        self.columns, self.fill_empty = list(columns), fill_empty

    def fit(self, df: DataFrame) -> MedianImputer:
        rows = kept(df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in self.columns]))
        found = exact_quantiles(rows, self.columns, [0.5])
        self.median = {c: found["", c][1][0] if ("", c) in found else self.fill_empty for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
        return df.withColumns({c: F.coalesce(fine(c), F.lit(self.median[c])) for c in self.columns})
