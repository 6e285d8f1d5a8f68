"""Performance tables from evidence: a fixed list of questions LEFT joined to facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.ids import effect_text

#: Questions of the performance table with metric, role and the fact that answers them.
QUESTIONS = (
    ("12-month sensitivity V1->V2", "V1->V2 paired d_z, CI, N, P(delta>0)", "Primary", "V1->V2"),
    ("12-month sensitivity V2->V3", "V2->V3 paired d_z, CI, N, P(delta>0)", "Primary temporal replication", "V2->V3"),
    ("12-month pooled annual sensitivity", "Pooled V1->V2 + V2->V3 paired d_z, CI, N, P(delta>0)", "Pooled annual diagnostic", "V1->V2 + V2->V3"),
    ("24-month cumulative sensitivity", "V1->V3 paired d_z", "Secondary", "V1->V3"),
    ("Direction consistency", "P(delta > 0)", "Secondary", "direction"),
    ("Robustness", "bootstrap CI for d_z", "Primary uncertainty", "ci"),
    ("Better than clinical scale?", "d_z composite vs FARS/SARA", "RQ1", "clinical"),
    ("Better than MRI alone?", "vs strongest individual MRI feature", "RQ1", "single"),
    ("Disease specific?", "FRDA vs control change", "Specificity", "specificity"),
    ("Clinically meaningful?", "Spearman Z vs FARS/SARA", "RQ3", "validity"),
    ("Tracks clinical change?", "Spearman delta Z vs delta FARS/SARA", "Strong RQ3", "delta_validity"),
    ("Feature robustness", "coefficient/sign/Jaccard stability", "Robustness", "stability"),
)
#: Rules that every model report follows.
CONTRACT = (
    ("Data audit", "Visit pattern, analysis population, and Feature x Visit x Site missingness displayed before modelling."),
    ("MRI QC", "Distribution by site, site-effect screen, outlier review, and harmonisation leakage policy displayed before modelling."),
    ("Outer CV", "repeated subject-level 5-fold CV"),
    ("Inner CV", "grouped subject-level CV inside outer training subjects"),
    ("Grouping", "All visits/intervals for one participant stay together: subject_id / participant group."),
    ("Leakage policy", "Imputation, scaling, feature selection, harmonisation, and tuning are fit on training subjects only."),
)


def strongest(effects: DataFrame, interval: str, fact: str) -> DataFrame:
    """The row of largest |d_z| of an interval as a fact."""
    return effects.where((F.col("interval") == interval) & F.col("d_z").isNotNull()).agg(F.max_by("d_z", F.abs("d_z")).alias("value"), F.max_by("n_pairs", F.abs("d_z")).alias("n")).select(F.lit(fact).alias("fact"), "value", "n")


def performance_rows(spark: SparkSession, model: str, facts: DataFrame) -> DataFrame:
    """Every question with the value and n of its fact, and whether there is one. facts: fact, value, n."""
    spec = spark.createDataFrame(QUESTIONS, "question string, metric string, role string, fact string")
    j = F.broadcast(spec).join(facts, "fact", "left")
    return j.select(F.lit(model).alias("model"), "question", "metric", "role", "value", "n", F.when(F.col("value").isNull(), "not available").otherwise("computed").alias("status"))


def append_models(performance: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of models that the table lacks, one a question, joined to those it has. models: model, and one column a fact."""
    spark = performance.sparkSession
    spec = spark.createDataFrame(QUESTIONS, "question string, metric string, role string, fact string")
    new = models.join(performance.select("model").distinct(), "model", "left_anti").crossJoin(F.broadcast(spec))
    value = F.when(F.col("fact") == "V1->V2", F.col("dz_v1_v2")).when(F.col("fact") == "V2->V3", F.col("dz_v2_v3")).when(F.col("fact") == "V1->V2 + V2->V3", F.col("annual_mean_dz")).when(F.col("fact") == "direction", F.col("p_progression"))
    rows = new.select("model", "question", "metric", "role", value.alias("value"), F.lit(None).cast("long").alias("n"), F.when(value.isNull(), "not available").otherwise("from log").alias("status"))
    return performance.unionByName(rows)


def effect_texts(effects: DataFrame) -> DataFrame:
    return effects.select("interval", effect_text(F.col("d_z"), F.col("d_z_ci_low"), F.col("d_z_ci_high"), F.col("p_delta_positive")).alias("text"))


def benchmark_flags(benchmarks: DataFrame, experiments: DataFrame) -> DataFrame:
    """Experiments with the best |d| of a clinical scale in the same pair type, and whether they beat it."""
    best = benchmarks.groupBy("pair").agg(F.max(F.abs("d")).alias("best_clinical"))
    return experiments.join(best, "pair", "left").withColumn("beats_best_clinical", F.abs("d") > F.col("best_clinical"))


def five_numbers(df: DataFrame, features: list[str], by: str) -> DataFrame:
    """What a box plot shows: least, quartiles and most of each feature and group."""
    long = df.unpivot([by], features, "feature", "value").where("value is not null")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return long.groupBy("feature", by).agg(F.count("*").alias("n"), F.min("value").alias("min"), q.alias("q"), F.max("value").alias("max")).select("feature", by, "n", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")
