"""Standardised change: deltas between visits and their effect sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x where it is a finite number, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cohens_dz(x: Column) -> Column:
    """mean / sd (ddof 1) of finite values; null for fewer than two or for no spread."""
    return F.avg(finite(x)) / F.nullif(F.stddev_samp(finite(x)), F.lit(0.0))


def probability_positive(x: Column) -> Column:
    v = finite(x)
    return F.avg(F.when(v > 0, F.lit(1.0)).when(v.isNotNull(), F.lit(0.0)))


def summary(x: Column) -> list[Column]:
    v = finite(x)
    return [F.count(v).alias("n_pairs"), F.avg(v).alias("mean_change"), F.stddev_samp(v).alias("sd_change"), cohens_dz(x).alias("d_z"), probability_positive(x).alias("p_delta_positive")]


def longitudinal_deltas(scores: DataFrame, start: int, end: int, subject: str = "subject_id", visit: str = "visit", score: str = "score", time: str | None = None, annualise: bool = False) -> DataFrame:
    """Change from one visit to another of subjects with both, by conditional aggregation in one shuffle.

    A subject's least score stands for a repeated visit. elapsed is the difference of
    ``time``, or nominal years; annualised changes over no time are null.
    """
    at = lambda c, v: F.min(F.when(F.col(visit) == v, F.col(c)))
    has = [F.max((F.col(visit) == v).cast("int")) for v in (start, end)]
    out = scores.groupBy(subject).agg(has[0].alias("_a"), has[1].alias("_b"), at(score, start).alias("score_start"), at(score, end).alias("score_end"), *([at(time, start).alias("_t0"), at(time, end).alias("_t1")] if time else []))
    out = out.where("_a = 1 and _b = 1").withColumn("delta", F.col("score_end") - F.col("score_start"))
    out = out.withColumn("elapsed", F.col("_t1") - F.col("_t0") if time else F.lit(float(end - start)))
    if annualise:
        out = out.withColumn("annualised", F.col("delta") / F.nullif(F.col("elapsed"), F.lit(0.0)))
    return out.drop("_a", "_b", "_t0", "_t1")


#: (label, start, end, annualised)
INTERVALS = (("V1->V3", 1, 3, False), ("V1->V2", 1, 2, True), ("V2->V3", 2, 3, True))


def interval_deltas(scores: DataFrame, intervals: Sequence[tuple[str, int, int, bool]] = INTERVALS, keys: Sequence[str] = (), subject: str = "subject_id", visit: str = "visit", score: str = "score", time: str = "time_years") -> DataFrame:
    """All intervals of each subject from one aggregation: (keys, subject, interval, delta).

    Where a subject has several rows at a visit, each at the start meets each at the end, as in a join.
    """
    at = lambda v: F.collect_list(F.when(F.col(visit) == v, F.struct(F.col(score).alias("score"), F.col(time).alias("time")))).alias(f"_{v}")
    points = sorted({p for _, a, b, _ in intervals for p in (a, b)})
    lists = scores.where(F.col(score).isNotNull()).groupBy(*keys, subject).agg(*[at(v) for v in points])
    ends = [F.struct(F.lit(label).alias("interval"), F.lit(annual).alias("_annual"), F.col(f"_{a}").alias("_a"), F.col(f"_{b}").alias("_b")) for label, a, b, annual in intervals]
    rows = lists.select(*keys, subject, F.explode(F.array(*ends)).alias("r")).select(*keys, subject, "r.*")
    rows = rows.withColumn("_a", F.explode("_a")).withColumn("_b", F.explode("_b"))
    years = F.when(F.col("_annual"), F.col("_b.time") - F.col("_a.time")).otherwise(1.0)
    return rows.select(*keys, subject, "interval", ((F.col("_b.score") - F.col("_a.score")) / F.nullif(years, F.lit(0.0))).alias("delta")).where("delta is not null")


def interval_effects(scores: DataFrame, intervals: Sequence[tuple[str, int, int, bool]] = INTERVALS, keys: Sequence[str] = (), **names: str) -> DataFrame:
    """n, mean, sd, d_z and P(delta > 0) of every interval and key."""
    return interval_deltas(scores, intervals, keys, **names).groupBy(*keys, "interval").agg(*summary(F.col("delta")))


def two_row_deltas(long: DataFrame, subject: str, visit: str = "visit", score: str = "score", drop_null: bool = False) -> DataFrame:
    """Second minus first row by visit, of subjects with exactly two rows (counted after dropping nulls if asked)."""
    rows = long.where(F.col(score).isNotNull() & ~F.isnan(score)) if drop_null else long
    pairs = rows.groupBy(subject).agg(F.count("*").alias("n"), F.min_by(score, visit).alias("first"), F.max_by(score, visit).alias("second"))
    return pairs.where("n = 2").select(subject, "first", "second", (F.col("second") - F.col("first")).alias("delta"))


def pair_interval(pair_id: Column) -> Column:
    """'V1->V2' or 'V2->V3' by the first V<n>V<m> in an id; null for other ids."""
    found = F.regexp_extract(F.upper(pair_id), r"(V\d+V\d+)", 1)
    return F.when(found == "V1V2", "V1->V2").when(found == "V2V3", "V2->V3")


def adjacent_effects(scores: DataFrame, pair: str = "pair_id", visit: str = "visit", score: str = "score", pooled: str | None = "V1->V2 + V2->V3") -> DataFrame:
    """Effects by interval of the pair id and, if ``pooled`` names it, over both, from one grouping-sets pass.

    Where a pair id has several rows at a visit, each at visit 1 meets each at visit 2, as in a join.
    """
    at = lambda v: F.collect_list(F.when(F.col(visit) == v, F.col(score)))
    ends = scores.withColumn("interval", pair_interval(F.col(pair))).where("interval is not null").groupBy(pair, "interval").agg(at(1).alias("_a"), at(2).alias("_b"))
    d = ends.select("interval", F.explode("_a").alias("_a"), "_b").select("interval", "_a", F.explode("_b").alias("_b")).select("interval", (F.col("_b") - F.col("_a")).alias("delta"))
    if pooled is None:
        return d.groupBy("interval").agg(*summary(F.col("delta")))
    return d.rollup("interval").agg(*summary(F.col("delta")), F.grouping("interval").alias("_all")).withColumn("interval", F.when(F.col("_all") == 1, pooled).otherwise(F.col("interval"))).drop("_all")


def annual_diagnostics(effects: DataFrame, require_both: bool = True) -> DataFrame:
    """d12, d23, their mean and gap, and the mean probability, from two interval rows."""
    at = lambda c, i: F.max(F.when(F.col("interval") == i, F.col(c)))
    one = effects.agg(at("d_z", "V1->V2").alias("dz_v1_v2"), at("d_z", "V2->V3").alias("dz_v2_v3"), at("p_delta_positive", "V1->V2").alias("_p1"), at("p_delta_positive", "V2->V3").alias("_p2"))
    both = F.col("dz_v1_v2").isNotNull() & F.col("dz_v2_v3").isNotNull()
    mean = (F.col("dz_v1_v2") + F.col("dz_v2_v3")) / 2
    if not require_both:
        mean = F.coalesce(mean, "dz_v1_v2", "dz_v2_v3")
    return one.select("dz_v1_v2", "dz_v2_v3", mean.alias("annual_mean_dz"), F.when(both, F.abs(F.col("dz_v1_v2") - F.col("dz_v2_v3"))).alias("annual_interval_gap"), ((F.col("_p1") + F.col("_p2")) / 2).alias("p_progression"))


def delta_effects(pairs: DataFrame, measures: Sequence[str], by_pair: bool = True, both: str | None = "both") -> DataFrame:
    """n, mean, sd and d of delta_{m} for each measure, by pair and over both in one pass."""
    long = pairs.unpivot(["pair"], [f"delta_{m}" for m in measures], "measure", "delta").where("delta is not null")
    aggs = [F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), cohens_dz(F.col("delta")).alias("d")]
    if not by_pair:
        return long.groupBy("measure").agg(*aggs)
    if both is None:
        return long.groupBy("measure", "pair").agg(*aggs)
    sets = long.groupingSets([["measure", "pair"], ["measure"]], "measure", "pair").agg(*aggs, F.grouping("pair").alias("_all"))
    return sets.withColumn("pair", F.when(F.col("_all") == 1, both).otherwise(F.col("pair"))).drop("_all")


def rmse_r2(df: DataFrame, y: str, p: str) -> DataFrame:
    """RMSE and R2 over rows where both are finite; R2 is null for fewer than two rows or a constant y."""
    d = df.select(finite(F.col(y)).alias("y"), finite(F.col(p)).alias("p")).where("y is not null and p is not null")
    e2 = (F.col("y") - F.col("p")) ** 2
    total = F.var_pop("y") * F.count("y")
    return d.agg(F.count("*").alias("n"), F.sqrt(F.avg(e2)).alias("rmse"), F.when((F.count("*") >= 2) & (F.var_pop("y") > 1e-300), 1 - F.sum(e2) / F.nullif(total, F.lit(0.0))).alias("r2"))


def with_average_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """``df`` with the rank of a value, ties at their mean, by key.

    Buckets of values, from approximate percentiles, are ranked by different tasks: counts of the
    buckets before give an offset. No task sees all rows, and equal values are counted first.
    """
    edges = df.agg(F.percentile_approx(value, F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(1000))).first()[0] or []
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c")).withColumn("_b", sum(((F.col(value) > float(e)).cast("int") for e in sorted(set(edges))), F.lit(0)))
    before = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_t"))
    before = before.withColumn("_o", F.sum("_t").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_t")).drop("_t")
    within = F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy(value))
    ranks = counts.withColumn("_w", within).join(before, [*by, "_b"]).select(*by, value, (F.col("_o") + F.col("_w") - (F.col("_c") - 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, [*by, value])


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation; null where either has no spread, for fewer than two rows too."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    top = F.covar_pop(x, y)
    bottom = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    return F.when(n >= 2, top / bottom)


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), least: int = 3) -> DataFrame:
    """Spearman's rho and n per key; rho is null below ``least`` rows or without spread."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    d = with_average_rank(with_average_rank(d, x, "_x", keys), y, "_y", keys)
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), guarded_corr("_x", "_y").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))
