"""Queries on performance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import effects as E
from tideline.operators import importance as M
from tideline.operators import ranking as K
from tideline.operators import report as R
from tideline.operators import reshape as S
from tideline.operators.resample import hash_fold
from tideline.plans import fixtures as X
from tideline.plans.queries_effects import _D, _PD, _RAW, _UNP
from tideline.plans.registry import query
from tideline.sources import figures as G

_QUESTIONS = "(values " + ", ".join("(" + ", ".join("'" + x + "'" for x in q) + ")" for q in R.QUESTIONS) + ") q(question, metric, role, fact)"
_FACTS = f", i as (select interval fact, {_RAW} from ({_D}) where delta is not null group by interval), a as (select 'V1->V2 + V2->V3' fact, {_RAW} from ({_PD})), c as (select arg_max(d, abs(d)) d_z, arg_max(n, abs(d)) n from (select count(delta) n, avg(delta) / nullif(stddev_samp(delta), 0) d from (unpivot pairs on {_UNP} into name measure value delta) where pair = 'V1V2' group by measure)), f as (select fact, d_z \"value\", n_pairs n from i union all select fact, d_z, n_pairs from a union all select 'direction', p_delta_positive, n_pairs from a union all select 'clinical', d_z, n from c)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = E.interval_effects(X.scores(spark, sf_dir)).select(F.col("interval").alias("fact"), F.col("d_z").alias("value"), F.col("n_pairs").alias("n"))
    pooled = E.adjacent_effects(X.pair_scores(spark, sf_dir)).where("interval like '%+%'")
    clinical = E.delta_effects(X.pairs(spark, sf_dir), X.CLINICAL, both=None).select(F.col("pair").alias("interval"), F.col("d").alias("d_z"), F.col("n").alias("n_pairs"))
    return i.unionByName(pooled.select(F.col("interval").alias("fact"), F.col("d_z").alias("value"), F.col("n_pairs").alias("n"))).unionByName(pooled.select(F.lit("direction").alias("fact"), F.col("p_delta_positive").alias("value"), F.col("n_pairs").alias("n"))).unionByName(R.strongest(clinical, "V1V2", "clinical"))


@query("performance_matrix", _FACTS + f" select 'composite' model, question, metric, role, R(f.\"value\") \"value\", f.n, case when f.\"value\" is null then 'not available' else 'computed' end status from {_QUESTIONS} left join f using (fact)")
def performance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.performance_rows(spark, "composite", _facts(spark, sf_dir))


_MODELS = [("composite", 0.1, 0.2, 0.15, 0.6), ("lda", 0.3, 0.1, 0.2, 0.7), ("net", None, 0.4, None, 0.5)]


@query("rep_02_append_models", _FACTS + f", p as (select 'composite' model, question, metric, role, f.\"value\" v, f.n, case when f.\"value\" is null then 'not available' else 'computed' end status from {_QUESTIONS} left join f using (fact)), m(model, a, b, c, d) as (values ('lda', 0.3::double, 0.1::double, 0.2::double, 0.7::double), ('net', null, 0.4, null, 0.5)), x as (select model, question, metric, role, case fact when 'V1->V2' then a when 'V2->V3' then b when 'V1->V2 + V2->V3' then c when 'direction' then d end v from m, {_QUESTIONS}) select model, question, metric, role, R(v) \"value\", n, status from p union all select model, question, metric, role, R(v), null, case when v is null then 'not available' else 'from log' end from x")
def append_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame(_MODELS, "model string, dz_v1_v2 double, dz_v2_v3 double, annual_mean_dz double, p_progression double")
    return R.append_models(R.performance_rows(spark, "composite", _facts(spark, sf_dir)), models)


@query("rep_03_cv_contract", ", n as (select count(distinct subject) subjects, count(distinct pair_id) pairs, count(*) visits from pair_visits), f as (select count(*) shared from (select subject from (select distinct subject, ('0x' || substr(md5('42|' || subject), 1, 8))::bigint % 5 fold from pair_visits) group by 1 having count(*) > 1)) select component, requirement, subjects, pairs, visits, shared from (values " + ", ".join(f"('{a}', '{b}')" for a, b in R.CONTRACT) + ") c(component, requirement), n, f")
def cv_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract beside what it is held to: subjects, pairs and visits of the study, and subjects that stand in two folds."""
    v = X.pair_visits(spark, sf_dir)
    n = v.agg(F.count_distinct("subject").alias("subjects"), F.count_distinct("pair_id").alias("pairs"), F.count("*").alias("visits"))
    folds = v.select("subject", hash_fold(F.col("subject"), 5).alias("fold")).distinct().groupBy("subject").count().agg(F.count_if(F.col("count") > 1).alias("shared"))
    # one row each
    return spark.createDataFrame(R.CONTRACT, "component string, requirement string").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(folds))


@query("rep_05_benchmark_flags", f", u as (unpivot pairs on {_UNP} into name measure value delta), b as (select pair, avg(delta) / nullif(stddev_samp(delta), 0) d from u group by measure, pair), m as (select pair, max(abs(d)) best from b group by 1), e as (select pair, avg(delta_f_view) / nullif(stddev_samp(delta_f_view), 0) d from pairs group by 1) select pair, R(d) d, R(best) best_clinical, abs(d) > best beats_best_clinical from e left join m using (pair)")
def benchmark_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pairs(spark, sf_dir)
    bench = E.delta_effects(p, X.CLINICAL, both=None)
    return R.benchmark_flags(bench, p.groupBy("pair").agg(E.cohens_dz(F.col("delta_f_view")).alias("d")))


@query("rep_06_five_numbers", ", u as (select site, feature, value from (select site, adl_total, mfars_total from visits) unpivot (value for feature in (adl_total, mfars_total))) select feature, site, count(*) n, R(min(value)) min, R(quantile_cont(value, 0.25)) q1, R(quantile_cont(value, 0.5)) median, R(quantile_cont(value, 0.75)) q3, R(max(value)) max from u group by 1, 2")
def five_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.five_numbers(X.visits(spark, sf_dir), ["adl_total", "mfars_total"], "site")


@query("nb_15_benchmark_table", f", i as (select 'composite' source, 'score' name, {_RAW} from ({_PD})), c as (select measure, pair, count(delta) n, avg(delta) / nullif(stddev_samp(delta), 0) d from (unpivot pairs on {_UNP} into name measure value delta) group by 1, 2), g as (select measure, count(delta) n, avg(delta) / nullif(stddev_samp(delta), 0) d from (unpivot pairs on {', '.join('delta_' + f for f in X.FEATURES)} into name measure value delta) group by 1) select source, name, n_pairs n, R(d_z) d from i union all select 'clinical', measure, n, R(d) from c where pair = 'V1V2' union all select * from (select 'imaging', measure, n, R(d) from g order by abs(d) desc, measure limit 1)")
def benchmark_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pairs(spark, sf_dir)
    model = E.adjacent_effects(X.pair_scores(spark, sf_dir)).where("interval like '%+%'").select(F.lit("composite").alias("source"), F.lit("score").alias("name"), F.col("n_pairs").alias("n"), F.col("d_z").alias("d"))
    clinical = E.delta_effects(p, X.CLINICAL, both=None).where("pair = 'V1V2'").select(F.lit("clinical").alias("source"), F.col("measure").alias("name"), "n", "d")
    imaging = K.top_k(E.delta_effects(p, X.FEATURES, by_pair=False), 1, [F.abs("d").desc(), "measure"]).select(F.lit("imaging").alias("source"), F.col("measure").alias("name"), "n", "d")
    return model.unionByName(clinical).unionByName(imaging)


_G = f", g as (select measure feature, count(delta) n, avg(delta) / nullif(stddev_samp(delta), 0) d from (unpivot pairs on {', '.join('delta_' + f for f in X.FEATURES)} into name measure value delta) group by 1)"


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delta_effects(X.pairs(spark, sf_dir), X.FEATURES, by_pair=False).select(F.col("measure").alias("feature"), "n", "d")


@query("nb_10_against_reference", _G + " select feature, R(g.d - r.d) difference from g, (select d from g where feature = 'delta_f_view') r where feature <> 'delta_f_view'")
def against_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _effects(spark, sf_dir)
    ref = g.where("feature = 'delta_f_view'").select(F.col("d").alias("_r"))
    return g.where("feature <> 'delta_f_view'").crossJoin(F.broadcast(ref)).select("feature", (F.col("d") - F.col("_r")).alias("difference"))


@query("nb_11_frequency_matrix", ", u as (select site, feature, value from (select site, visit, " + ", ".join(X.FEATURES) + " from visits) unpivot (value for feature in (" + ", ".join(X.FEATURES) + "))), w as (select feature, " + ", ".join(f"cast(count(*) filter (site = 'site_{k}') as bigint) site_{k}" for k in range(6)) + " from u group by 1) select *, greatest(" + ", ".join(f"site_{k}" for k in range(6)) + ") most from w")
def frequency_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = S.unpivot(X.visits(spark, sf_dir), ["site"], X.FEATURES).where("value is not null")
    sites = [f"site_{k}" for k in range(6)]
    return u.groupBy("feature").pivot("site", sites).agg(F.count(F.lit(1))).fillna(0).withColumn("most", F.greatest(*sites))


@query("nb_14_label_counts", "select label, count(*) n from embeddings group by 1", fixtures=False)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("nb_17_cohort_comparison", f", c as (select s.study_group, d.interval, d.delta from ({_D}) d join (select distinct subject_id, study_group from scores) s using (subject_id) where delta is not null), e as (select study_group, interval, avg(delta) / nullif(stddev_samp(delta), 0) d from c group by 1, 2) select a.interval, R(a.d) control_d, R(b.d) patient_d, b.d is not null matched from e a left join (select * from e where study_group = 0 and interval <> 'V1->V3') b using (interval) where a.study_group = 1")
def cohort_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.interval_effects(X.scores(spark, sf_dir), keys=["study_group"])
    patient = e.where("study_group = 0 and interval <> 'V1->V3'").select("interval", F.col("d_z").alias("patient_d"))
    return e.where("study_group = 1").select("interval", F.col("d_z").alias("control_d")).join(patient, "interval", "left").withColumn("matched", F.col("patient_d").isNotNull())


_LOG = "select 'm' || cast(o_custkey % 7 as varchar) model, o_orderkey candidate_idx, o_totalprice / 1e6 mean_validation_annual_dz, 0.002::double se_validation_dz, (o_orderkey % 13) / 10.0::double annual_interval_gap from orders"


@query("nb_18_review_per_model", f"with l as ({_LOG}), b as (select model, arg_max(mean_validation_annual_dz, (mean_validation_annual_dz, -candidate_idx)) m from l group by 1) select model, candidate_idx, R(annual_interval_gap) gap, annual_interval_gap > 0.5 warning from l join b using (model) where mean_validation_annual_dz >= m - se_validation_dz qualify row_number() over (partition by model order by annual_interval_gap, mean_validation_annual_dz desc, candidate_idx) = 1", fixtures=False)
def review_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model"), F.col("o_orderkey").alias("candidate_idx"), (F.col("o_totalprice") / 1e6).alias("mean_validation_annual_dz"), F.lit(0.002).alias("se_validation_dz"), ((F.col("o_orderkey") % 13) / 10.0).alias("annual_interval_gap"))
    return K.hierarchical_choice(o, keys=["model"]).select("model", "candidate_idx", F.col("annual_interval_gap").alias("gap"), (F.col("annual_interval_gap") > 0.5).alias("warning"))


@query("srt_06_optimization_log", "with l as (" + _LOG + ") select model, count(*) n, R(max(mean_validation_annual_dz)) best from l group by 1", fixtures=False)
def optimization_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model"), (F.col("o_totalprice") / 1e6).alias("d"))
    return o.groupBy("model").agg(F.count("*").alias("n"), F.max("d").alias("best"))


_EVIDENCE = f""", u as (select site, patient_id, pair, feature, delta from (select site, patient_id, pair, {', '.join(f'delta_{f} {f}' for f in X.FEATURES)} from pairs) unpivot (delta for feature in ({', '.join(X.FEATURES)}))),
m as (select feature, avg(case when pair = 'V1V2' then delta end) a, avg(case when pair = 'V2V3' then delta end) b, avg(delta) d, avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(*)) lo, avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(*)) hi from u group by 1),
g as (select feature, avg(case when sign(x) = sign(d) then 1.0::double else 0.0::double end) s from (select feature, site, avg(delta) x from u group by 1, 2) join m using (feature) group by 1),
t as (select feature, m.a, m.b, g.s, lo, hi, case when feature <> 'f_view' then abs(d) > 1 end r, d / 10 loss from m join g using (feature))"""


@query("srt_09_importance_labels", _EVIDENCE + ", q as (select quantile_cont((abs(a) + abs(b))::double / 2, 0.75) c, quantile_cont(loss::double, 0.75) l from t) select feature, case when s < 0.8 or (lo <= 0 and hi >= 0) then 'Unstable / uncertain' when coalesce(r, false) and (abs(a) + abs(b)) / 2 >= c and not (loss >= l and loss > 0) then 'Potentially redundant contributor' when (abs(a) + abs(b)) / 2 >= c and loss >= l and loss > 0 then 'Strong robust contributor' when abs(a - b) > abs(a + b) / 2 and (abs(a) + abs(b)) / 2 >= c then 'Interval-specific contributor' when (abs(a) + abs(b)) / 2 >= c or (loss >= l and loss > 0) then 'Moderate contributor' else 'Minimal contribution' end label from t, q")
def importance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every feature from its mean changes, their interval, and the sites that agree with their sign."""
    names = list(X.FEATURES)
    u = X.pairs(spark, sf_dir).select("site", "pair", *[F.col(f"delta_{f}").alias(f) for f in names]).unpivot(["site", "pair"], names, "feature", "delta").where("delta is not null")
    half = F.lit(1.96) * F.stddev_samp("delta") / F.sqrt(F.count("*"))
    at = lambda p: F.avg(F.when(F.col("pair") == p, F.col("delta")))
    m = u.groupBy("feature").agg(at("V1V2").alias("contribution_v1_v2"), at("V2V3").alias("contribution_v2_v3"), F.avg("delta").alias("d"), (F.avg("delta") - half).alias("ci_low"), (F.avg("delta") + half).alias("ci_high"))
    sites = u.groupBy("feature", "site").agg(F.avg("delta").alias("x"))
    # a row a feature
    g = sites.join(F.broadcast(m.select("feature", "d")), "feature").groupBy("feature").agg(F.avg(F.when(F.signum("x") == F.signum("d"), 1.0).otherwise(0.0)).alias("sign_consistency"))
    t = m.join(g, "feature").withColumn("redundant", F.when(F.col("feature") != "f_view", F.abs("d") > 1)).withColumn("performance_loss", F.col("d") / 10)
    return K.importance_labels(t).select("feature", "label")


@query("jon_06_integrated_importance", _G + ", v as (select feature, count(*) k from (select 'delta_f_view' feature union all select 'delta_f_view' union all select 'delta_f_click') group by 1) select g.feature, g.n, R(g.d) d, v.k from g left join v using (feature)")
def integrated_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = spark.createDataFrame([("delta_f_view",), ("delta_f_view",), ("delta_f_click",)], "feature string").groupBy("feature").agg(F.count("*").alias("k"))
    return M.integrated(_effects(spark, sf_dir), votes)


@query("snk_05_scatter_pixels", ", v as (select f_click x, f_view y from visits where f_click is not null and f_view is not null), b as (select min(x) x0, max(x) x1, min(y) y0, max(y) y1 from v) select cast(least(floor((x - x0) / (x1 - x0) * 64), 63) as int) px, cast(47 - least(floor((y - y0) / (y1 - y0) * 48), 47) as int) py, count(*) n from v, b group by 1, 2")
def scatter_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scatter(X.visits(spark, sf_dir), "f_click", "f_view", 64, 48)


@query("snk_05_scatter_png")
def scatter_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image of all visits as a PNG file's bytes."""
    return G.png(G.scatter(X.visits(spark, sf_dir), "f_click", "f_view"), 640, 480, "visits.png")


@query("rep_06_box_figure")
def box_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summaries of a feature by site, drawn side by side."""
    q = F.percentile("f_view", F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    table = X.visits(spark, sf_dir).groupBy("site").agg(q.alias("q")).select("site", *[F.col("q")[k].alias(n) for k, n in enumerate(("low", "q1", "median", "q3", "high"))])
    return G.png(G.boxes(table, "site", 240, 120, (0.0, 100.0)), 240, 120, "sites.png")


#: A mean difference by site, to nine places, and where its bar stands on a canvas of 48 by 30.
_BARS = ", t as (select site, round(avg(f_click - f_view), 9) v from visits group by site having avg(f_click - f_view) is not null), b as (select least(0, min(v)) lo, greatest(0, max(v)) hi, 48 // count(*) step from t), r as (select (row_number() over (order by {order}) - 1) * step + step // 4 l, step, 29 - least(floor((v - lo) / (hi - lo) * 30), 29) y, 29 - least(floor((0 - lo) / (hi - lo) * 30), 29) z from t, b) select cast(px as int) px, cast(py as int) py, count(*) n from (select unnest(range(l, l + greatest(1, step // 2))) px, y, z from r) s, range(0, 30) g(py) where py between least(y, z) and greatest(y, z) group by 1, 2"


def _site_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.visits(spark, sf_dir).groupBy("site").agg(F.round(F.avg(F.col("f_click") - F.col("f_view")), 9).alias("v"))


@query("snk_05_bar_pixels", _BARS.format(order="site"))
def bar_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bars(_site_differences(spark, sf_dir), "site", "v", 48, 30)


@query("rep_06_ranked_bar_pixels", _BARS.format(order="-v, site"))
def ranked_bar_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars from the most positive to the most negative."""
    return G.bars(_site_differences(spark, sf_dir), "site", "v", 48, 30, order=-F.col("v"))


@query("snk_05_bar_png")
def bar_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.png(G.bars(_site_differences(spark, sf_dir), "site", "v"), 640, 480, "differences.png")
