"""Audits of visits, missing values and outliers. Each is one aggregation over unpivoted or grouped rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import moments as M
from tideline.operators.lineage import kept
from tideline.operators.quantiles import exact_quantiles, quantile_table

#: Meanings of visit patterns.
PATTERNS = (("111", "V1, V2 and V3"), ("110", "V1 and V2"), ("101", "V1 and V3"), ("011", "V2 and V3"), ("100", "V1 only"), ("010", "V2 only"), ("001", "V3 only"), ("000", "no visit"))


def visit_patterns(df: DataFrame, subject: str = "subject_id", visit: str = "visit", visits: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """subject and pattern such as 101."""
    has = [F.max((F.col(visit) == v).cast("int")).cast("string") for v in visits]
    return df.groupBy(subject).agg(F.concat(*has).alias("pattern"))


def pattern_counts(df: DataFrame, **names: str) -> DataFrame:
    """Subjects of every pattern, zeros included (not for 000), with meaning and percent."""
    spark = df.sparkSession
    known = spark.createDataFrame(PATTERNS, "pattern string, meaning string")
    counts = visit_patterns(df, **names).groupBy("pattern").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    out = known.join(counts, "pattern", "left").crossJoin(F.broadcast(total)).withColumn("n_subjects", F.coalesce("n", F.lit(0)).cast("long"))
    return out.where("pattern <> '000' or n_subjects > 0").select("pattern", "meaning", "n_subjects", (F.lit(100.0) * F.col("n_subjects") / F.nullif(F.col("all"), F.lit(0))).alias("percent_subjects"))


def population_counts(df: DataFrame, **names: str) -> DataFrame:
    """Subjects in all, with each pair of visits, with all three."""
    p = visit_patterns(df, **names)
    n = lambda mask: F.count(F.when(F.col("pattern").rlike(mask), 1))
    one = p.agg(F.count("*").alias("all"), n("^11").alias("V1->V2"), n("^.11").alias("V2->V3"), n("^1.1").alias("V1->V3"), n("111").alias("complete"))
    return one.unpivot([], one.columns, "population", "n_subjects")


def pair_counts(pairs: DataFrame, patient: str = "patient_id") -> DataFrame:
    """N12, N23, N13 (both adjacent pairs) and pooled pairs, from ids that end in _V1V2 or _V2V3."""
    pattern = r"^(.+)_(V1V2|V2V3)$"
    d = pairs.select(F.regexp_extract(patient, pattern, 1).alias("s"), F.regexp_extract(patient, pattern, 2).alias("p")).distinct()
    per = d.groupBy("s").agg(F.max((F.col("p") == "V1V2").cast("int")).alias("a"), F.max((F.col("p") == "V2V3").cast("int")).alias("b"))
    one = per.agg(F.sum("a").alias("V1->V2"), F.sum("b").alias("V2->V3"), F.sum(F.col("a") * F.col("b")).alias("V1->V3"), F.sum(F.col("a") + F.col("b")).alias("pooled_annual"))
    return one.unpivot([], one.columns, "interval", "n")


def missingness(df: DataFrame, features: Sequence[str], visit: str = "visit", site: str = "site") -> DataFrame:
    """Share of nulls of each feature: over all, by visit, by site and by both.

    One aggregate counts by (visit, site); its few rows are then unpivoted and summed by level.
    """
    counts = df.groupBy(visit, site).agg(F.count("*").alias("_n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in features])
    long = counts.unpivot([visit, site, "_n"], list(features), "feature", "_nulls")
    sets = long.groupingSets([["feature"], ["feature", visit], ["feature", site], ["feature", visit, site]], "feature", visit, site)
    out = sets.agg(F.sum("_n").alias("n"), (F.sum("_nulls") / F.sum("_n")).alias("missing"), F.grouping_id().alias("_g"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in ((0, "visit_site"), (1, "visit"), (2, "site"), (3, "global")) for x in kv]), F.col("_g").cast("int"))
    return out.withColumn("level", label).drop("_g")


def missingness_flags(df: DataFrame, features: Sequence[str], spread: float = 0.25, **names: str) -> DataFrame:
    """Spread of a feature's missing share over the groups of each level, flagged from ``spread`` on."""
    by = missingness(df, features, **names).where("level <> 'global'").groupBy("feature", "level").agg((F.max("missing") - F.min("missing")).alias("spread"))
    return by.withColumn("concentrated", F.col("spread") >= spread)


def missingness_matrix(df: DataFrame, features: Sequence[str], groups: Sequence[str], visit: str = "visit", site: str = "site") -> DataFrame:
    """feature by visit|site: rows without a value. ``groups`` names the columns, so no job looks for them."""
    long = df.unpivot([visit, site], list(features), "feature", "value").withColumn("g", F.concat_ws("|", F.concat(F.lit("V"), F.col(visit).cast("string")), site))
    return long.groupBy("feature").pivot("g", list(groups)).agg(F.sum(F.col("value").isNull().cast("long")))


def block_missingness(combined: DataFrame, blocks: dict[str, Sequence[str]], visit: str = "visit") -> DataFrame:
    """visit (null over all), column, source_block, n rows and missing_pct, the share without a value.

    combined: the full outer join of the sources. One aggregate counts nulls by visit; its
    few rows are then unpivoted and rolled up.
    """
    columns = [c for own in blocks.values() for c in own]
    counts = combined.groupBy(visit).agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    long = counts.unpivot([visit, "_n"], columns, "column", "_nulls")
    block = F.element_at(F.create_map(*[F.lit(x) for b, own in blocks.items() for c in own for x in (c, b)]), F.col("column"))
    sets = long.groupingSets([["column"], ["column", visit]], "column", visit)
    out = sets.agg(F.sum("_n").alias("n"), (F.sum("_nulls") / F.sum("_n")).alias("missing_pct"), F.grouping(visit).alias("_all"))
    return out.select(F.when(F.col("_all") == 0, F.col(visit)).alias(visit), (F.col("_all") == 1).alias("over_all"), "column", block.alias("source_block"), "n", "missing_pct")


def block_summary(missing: DataFrame) -> DataFrame:
    """Columns of each block, and the mean and largest share missing over all visits."""
    return missing.where("over_all").groupBy("source_block").agg(F.count("*").alias("n_columns"), F.avg("missing_pct").alias("mean_missing_pct"), F.max("missing_pct").alias("max_missing_pct"))


def source_summary(sources: dict[str, DataFrame], subject: str) -> DataFrame:
    """Rows, columns and subjects of each source."""
    parts = [df.agg(F.count("*").alias("n_rows"), F.count_distinct(subject).alias("n_subjects")).select(F.lit(name).alias("source"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_subjects") for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of each column, from one aggregation."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "n_missing")


def coverage(df: DataFrame, features: Sequence[str], threshold: float = 0.2) -> DataFrame:
    """Share of rows with a value, flagged where more than ``threshold`` are missing."""
    one = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias(c) for c in features])
    return one.unpivot([], list(features), "feature", "coverage").withColumn("flag", 1 - F.col("coverage") > threshold)


def followup_numeric(df: DataFrame, variables: Sequence[str], subject: str = "subject_id", visit: str = "visit", baseline: int = 1, followup: int = 3) -> DataFrame:
    """Baseline rows with and without a follow-up visit: n, missing, mean and sd of each variable."""
    later = df.where(F.col(visit) == followup).select(subject, F.lit(True).alias("_f")).distinct()
    rows = df.where(F.col(visit) == baseline).join(later, subject, "left").withColumn("has_followup", F.coalesce("_f", F.lit(False)))
    long = rows.unpivot(["has_followup"], list(variables), "variable", "value")
    return long.groupBy("variable", "has_followup").agg(F.count("value").alias("n"), F.sum(F.col("value").isNull().cast("long")).alias("n_missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def outlier_table(df: DataFrame, features: Sequence[str], groups: Sequence[str] = ("visit", "site"), k: float = 3.0, least: int = 4) -> DataFrame:
    """Rows outside the k * IQR fences of their group, for groups of at least ``least`` values; groups with any only."""
    rows = kept(df.select(*groups, *features))
    q = quantile_table(rows, features, (0.25, 0.75), groups).where(F.col("n") >= least)
    long = rows.unpivot(list(groups), list(features), "feature", "value").where("value is not null")
    q = q.withColumn("low", F.col("q")[0] - k * (F.col("q")[1] - F.col("q")[0])).withColumn("high", F.col("q")[1] + k * (F.col("q")[1] - F.col("q")[0])).drop("q")
    # a row a group and feature, whose number has a bound
    out = long.join(F.broadcast(q), [*groups, "feature"]).groupBy(*groups, "feature", "n", "low", "high").agg(F.count(F.when((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), 1)).alias("n_outliers"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.where("n_outliers > 0").withColumn("pct", F.lit(100.0) * F.col("n_outliers") / F.col("n"))


def tukey_rows(df: DataFrame, columns: Sequence[str], k: float = 3.0) -> DataFrame:
    """``df`` with ``outlier``: any column outside its k * IQR fences; nulls never are."""
    mask = F.lit(False)
    for (_, c), (_, (low, high)) in exact_quantiles(kept(df.select(*columns)), columns, (0.25, 0.75)).items():
        mask = mask | F.coalesce((F.col(c) < low - k * (high - low)) | (F.col(c) > high + k * (high - low)), F.lit(False))
    return df.withColumn("outlier", mask)


def visit_quality(visits: DataFrame, groups: dict[str, Sequence[str]], subject: str = "subject_id", visit: str = "visit") -> DataFrame:
    """(metric, key, value): rows, subjects, rows of each visit, and the mean missing share of each group of columns."""
    shares = [(sum((F.avg(F.col(c).isNull().cast("double")) for c in columns), F.lit(0.0)) / len(columns)).alias(g) for g, columns in groups.items() if columns]
    one = visits.agg(F.count("*").cast("double").alias("rows"), F.count_distinct(subject).cast("double").alias("subjects"), *shares)
    out = one.unpivot([], ["rows", "subjects"], "metric", "value").select("metric", F.lit("").alias("key"), "value")
    missing = one.unpivot([], [g for g, columns in groups.items() if columns], "key", "value").select(F.lit("missing").alias("metric"), "key", "value")
    by = visits.groupBy(F.col(visit).cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("visit").alias("metric"), "key", "value")
    return out.unionByName(by).unionByName(missing)


def pair_quality(pairs: DataFrame, subject: str = "subject_id", pair: str = "pair") -> DataFrame:
    """(metric, key, value): rows, rows of each pair type, subjects with both types and with one."""
    by = pairs.groupBy(F.col(pair).alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit("pair").alias("metric"), "key", "value")
    kinds = pairs.groupBy(subject).agg(F.count_distinct(pair).alias("_n")).groupBy(F.when(F.col("_n") == 2, "subjects with both").otherwise("subjects with one").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    rows = pairs.agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("metric"), F.lit("").alias("key"), "value")
    return rows.unionByName(by).unionByName(kinds.select("metric", F.lit("").alias("key"), "value"))


@dataclass(frozen=True)
class Logistic:
    weights: dict[str, float]
    intercept: float
    n: int
    accuracy: float


def followup_model(df: DataFrame, variables: Sequence[str], subject: str = "subject_id", visit: str = "visit", baseline: int = 1, followup: int = 3, least: int = 8, penalty: float = 1.0) -> Logistic | None:
    """Logistic model of having a follow-up visit, of standardised baseline values, with a ridge on the weights.

    Newton's rounds: each sums gradient and curvature over the rows, so what reaches the
    driver has the size of the variables. None below ``least`` complete rows or without both outcomes.
    """
    later = df.where(F.col(visit) == followup).select(subject, F.lit(1.0).alias("_y")).distinct()
    rows = df.where(F.col(visit) == baseline).join(later, subject, "left").withColumn("_y", F.coalesce("_y", F.lit(0.0)))
    rows = kept(rows.select(*[F.col(v).cast("double").alias(v) for v in variables], "_y").dropna())
    one = rows.agg(F.count("*").alias("_n"), F.sum("_y").alias("_y"), *[x for v in variables for x in (F.avg(v).alias(f"m_{v}"), F.stddev_pop(v).alias(f"s_{v}"))]).first()
    n = one["_n"]
    if n < least or not 0 < one["_y"] < n:
        return None
    names = list(variables)
    mean, sd = np.array([one[f"m_{v}"] for v in names]), np.array([one[f"s_{v}"] or 1.0 for v in names])
    w = np.zeros(len(names) + 1)
    ridge = np.diag(np.append(0.0, np.full(len(names), 1 / penalty)))
    for _ in range(50):

        def part(pdf: pd.DataFrame, w: np.ndarray = w) -> dict[str, np.ndarray]:
            a, y = M.ones((pdf[names].to_numpy(float) - mean) / sd), pdf["_y"].to_numpy(float)
            p = 1 / (1 + np.exp(-(a @ w)))
            return {"g": a.T @ (p - y), "h": ((a * (p * (1 - p))[:, None]).T @ a).ravel(), "right": np.array([float(((p > 0.5) == (y > 0.5)).sum())])}

        found = M.sums(rows, part)
        step = np.linalg.solve(M.square(found["h"]) + ridge, found["g"] + ridge @ w)
        if np.abs(step).max() < 1e-10:
            break
        w = w - step
    return Logistic(dict(zip(names, w[1:].tolist())), float(w[0]), n, float(found["right"][0] / n))
