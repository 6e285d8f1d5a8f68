"""Queries on pairs, deltas and effect sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import effects as E
from tideline.operators import reshape as S
from tideline.plans import fixtures as X
from tideline.operators.resample import bootstrap_effects
from tideline.plans.registry import query


def _boot(source: str) -> str:
    from tideline.plans.queries_data import _boot_sql

    return _boot_sql(source, "interval", "subject_id", 200)

_SUMMARY = "count(delta) n_pairs, R(avg(delta)) mean_change, R(stddev_samp(delta)) sd_change, R(avg(delta) / nullif(stddev_samp(delta), 0)) d_z, R(avg(cast(case when delta > 0 then 1 else 0 end as double))) p_delta_positive"
_RAW = _SUMMARY.replace("R(", "(")
_D = "select a.subject_id, 'V1->V2' interval, (b.score - a.score) / nullif(b.time_years - a.time_years, 0) delta from scores a join scores b on a.subject_id = b.subject_id and a.visit = 1 and b.visit = 2 union all select a.subject_id, 'V2->V3', (b.score - a.score) / nullif(b.time_years - a.time_years, 0) from scores a join scores b on a.subject_id = b.subject_id and a.visit = 2 and b.visit = 3 union all select a.subject_id, 'V1->V3', b.score - a.score from scores a join scores b on a.subject_id = b.subject_id and a.visit = 1 and b.visit = 3"
_PD = "select a.pair_id, case when contains(a.pair_id, 'V1V2') then 'V1->V2' else 'V2->V3' end interval, b.score - a.score delta from pair_scores a join pair_scores b on a.pair_id = b.pair_id and a.visit = 1 and b.visit = 2 where a.score is not null and b.score is not null"


@query("interval_effect", f"select interval, {_SUMMARY} from ({_D}) where delta is not null group by interval")
def interval_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.interval_effects(X.scores(spark, sf_dir))


@query("interval_effect_ci", lambda: ", " + _boot(_D) + f" select interval, {_SUMMARY}, R(any_value(low)) d_z_ci_low, R(any_value(high)) d_z_ci_high from ({_D}) join bc on bk = interval where delta is not null group by interval")
def interval_effect_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.interval_deltas(X.scores(spark, sf_dir))
    ci = bootstrap_effects(d, ["interval"], "subject_id").drop("n_pairs")
    return d.where("delta is not null").groupBy("interval").agg(*E.summary(F.col("delta"))).join(ci, "interval", "left")


@query("interval_effect_pooled", f"select case when grouping(interval) = 1 then 'V1->V2 + V2->V3' else interval end interval, {_SUMMARY} from ({_PD}) group by rollup(interval)")
def interval_effect_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adjacent_effects(X.pair_scores(spark, sf_dir))


@query("agg_17_adjacent_pair_effects", f"select interval, {_SUMMARY} from ({_PD}) group by interval")
def adjacent_pair_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.adjacent_effects(X.pair_scores(spark, sf_dir), pooled=None)


@query("annual_diagnostics", f", e as (select interval, {_RAW} from ({_PD}) group by interval) select R(max(case when interval = 'V1->V2' then d_z end)) dz_v1_v2, R(max(case when interval = 'V2->V3' then d_z end)) dz_v2_v3, R(avg(d_z)) annual_mean_dz, R(max(d_z) - min(d_z)) annual_interval_gap, R(avg(p_delta_positive)) p_progression from e")
def annual_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.annual_diagnostics(E.adjacent_effects(X.pair_scores(spark, sf_dir), pooled=None))


@query("paired_d_two_rows", ", p as (select subject_id, arg_max(score, visit) - arg_min(score, visit) delta from scores group by subject_id having count(*) = 2) select count(*) n, R(avg(delta)) mean, R(stddev_samp(delta)) sd, R(avg(delta) / nullif(stddev_samp(delta), 0)) d from p")
def paired_d_two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.two_row_deltas(X.scores(spark, sf_dir), "subject_id")
    return d.agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), E.cohens_dz(F.col("delta")).alias("d"))


@query("agg_12_paired_deltas", "select subject_id, R(arg_min(score, visit)) \"first\", R(arg_max(score, visit)) \"second\", R(arg_max(score, visit) - arg_min(score, visit)) delta from scores group by subject_id having count(*) = 2")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.two_row_deltas(X.scores(spark, sf_dir), "subject_id", drop_null=True)


@query("agg_12_paired_t", ", p as (select arg_max(score, visit) - arg_min(score, visit) delta from scores group by subject_id having count(*) = 2) select count(delta) n, R(avg(delta) / nullif(stddev_samp(delta), 0) * sqrt(count(delta))) t, count(delta) - 1 df from p")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.two_row_deltas(X.scores(spark, sf_dir), "subject_id")
    return d.agg(F.count("delta").alias("n"), (E.cohens_dz(F.col("delta")) * F.sqrt(F.count("delta"))).alias("t"), (F.count("delta") - 1).alias("df"))


#: Two-sided p of Student's t in SQL: Simpson's rule over the density from 0 to |t|.
_P = "case when {t} is null or {n} <= 0 then null else 1 - 2 * exp(lgamma(({n} + 1) / 2.0::double) - lgamma({n} / 2.0::double)) / sqrt({n} * pi()) * (abs({t}) / 2000.0::double / 3) * list_sum(list_transform(range(0, 2001), lambda i: (case when i = 0 or i = 2000 then 1 when i % 2 = 1 then 4 else 2 end) * pow(1 + pow(abs({t}) * i / 2000.0::double, 2) / {n}, -({n} + 1) / 2.0::double))) end"


@query("agg_12_paired_ttest", ", d as (select subject_id, arg_max(score, visit) - arg_min(score, visit) delta from scores group by 1 having count(*) = 2), s as (select count(delta) n, avg(delta) / nullif(stddev_samp(delta), 0) * sqrt(count(delta)) t from d) select n, R(t) t, R(" + _P.format(t="t", n="(n - 1)") + ") p from s")
def paired_ttest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.kernels import t_two_sided

    d = E.two_row_deltas(X.scores(spark, sf_dir), "subject_id").agg(F.count("delta").alias("n"), (E.cohens_dz(F.col("delta")) * F.sqrt(F.count("delta"))).alias("t"))
    return d.withColumn("p", t_two_sided("t", F.col("n") - 1))


@query("longitudinal_delta_annualised", "select a.subject_id, R(a.score) score_start, R(b.score) score_end, R(b.score - a.score) delta, R(b.time_years - a.time_years) elapsed, R((b.score - a.score) / nullif(b.time_years - a.time_years, 0)) annualised from scores a join scores b on a.subject_id = b.subject_id where a.visit = 1 and b.visit = 3")
def longitudinal_delta_annualised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.longitudinal_deltas(X.scores(spark, sf_dir), 1, 3, time="time_years", annualise=True)


@query("prob_positive", "select R(avg(case when delta_f_view > 0 then 1.0::double else 0.0::double end)) p from pairs where delta_f_view is not null")
def prob_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).agg(E.probability_positive(F.col("delta_f_view")).alias("p"))


_UNP = ", ".join(f"delta_{c}" for c in X.CLINICAL)


@query("agg_10_delta_summary", f", u as (unpivot pairs on {_UNP} into name measure value delta) select measure, pair, count(delta) n, R(avg(delta)) mean, R(stddev_samp(delta)) sd, R(avg(delta) / nullif(stddev_samp(delta), 0)) d from u group by measure, pair union all select measure, 'both', count(delta), R(avg(delta)), R(stddev_samp(delta)), R(avg(delta) / nullif(stddev_samp(delta), 0)) from u group by measure")
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delta_effects(X.pairs(spark, sf_dir), X.CLINICAL)


@query("agg_11_cohens_d_by_feature", f", u as (unpivot pairs on {', '.join('delta_' + f for f in X.FEATURES)} into name measure value delta) select measure, count(delta) n, R(avg(delta)) mean, R(stddev_samp(delta)) sd, R(avg(delta) / nullif(stddev_samp(delta), 0)) d from u group by measure")
def cohens_d_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delta_effects(X.pairs(spark, sf_dir), X.FEATURES, by_pair=False)


@query("agg_14_reference_effects", f", u as (unpivot pairs on {', '.join('delta_' + f for f in (*X.FEATURES, *X.CLINICAL))} into name measure value delta), g as (select measure, count(delta) n, avg(delta) mean, stddev_samp(delta) sd, avg(delta) / nullif(stddev_samp(delta), 0) d from u group by measure) select measure, n, R(mean) mean, R(sd) sd, R(d) d, cast(row_number() over (order by abs(d) desc nulls last, measure) as int) place from g")
def reference_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.ranking import place

    return place(E.delta_effects(X.pairs(spark, sf_dir), [*X.FEATURES, *X.CLINICAL], by_pair=False), [F.abs("d").desc_nulls_last(), "measure"], "place")


@query("agg_14_clinical_effects", f", u as (unpivot pairs on {_UNP} into name measure value delta) select measure, pair, count(delta) n, R(avg(delta)) mean, R(stddev_samp(delta)) sd, R(avg(delta) / nullif(stddev_samp(delta), 0)) d from u group by measure, pair")
def clinical_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.delta_effects(X.pairs(spark, sf_dir), X.CLINICAL, both=None)


@query("rmse_r2", ", d as (select f_view y, f_click p from visits where f_view is not null and f_click is not null) select count(*) n, R(sqrt(avg((y - p) * (y - p)))) rmse, R(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))) r2 from d")
def rmse_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rmse_r2(X.visits(spark, sf_dir), "f_view", "f_click")


_FD = " union all ".join(f"select '{f}' feature, a.subject_id, 'V{i}->V{j}' interval, (b.{f} - a.{f}){' / 1' if j - i == 1 else ''} delta from visits a join visits b on a.subject_id = b.subject_id and a.visit = {i} and b.visit = {j}" for f in X.FEATURES for i, j in ((1, 2), (2, 3), (1, 3)))


@query("agg_20_single_feature_baselines", f"select feature, interval, {_SUMMARY} from ({_FD}) where delta is not null group by feature, interval")
def single_feature_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = S.unpivot(X.visits(spark, sf_dir), ["subject_id", "visit", "time_years"], X.FEATURES, value="score")
    return E.interval_effects(long, keys=["feature"])


@query("specificity_by_cohort", f", c as (select s.study_group, d.* from ({_D}) d join (select distinct subject_id, study_group from scores) s using (subject_id)) select case when study_group = 1 then 'control' else 'patient' end cohort, interval, {_SUMMARY} from c where delta is not null group by 1, 2")
def specificity_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = F.when(F.col("study_group") == 1, "control").otherwise("patient")
    return E.interval_effects(X.scores(spark, sf_dir).withColumn("cohort", cohort), keys=["cohort"])


@query("nb_06_control_specificity", f", c as (select s.study_group, d.* from ({_D}) d join (select distinct subject_id, study_group from scores) s using (subject_id)) select case when study_group = 1 then 'control' else 'patient' end cohort, case when grouping(interval) = 1 then 'pooled' else interval end interval, {_SUMMARY} from c where delta is not null and interval <> 'V1->V3' group by grouping sets ((study_group, interval), (study_group))")
def control_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohort = F.when(F.col("study_group") == 1, "control").otherwise("patient")
    d = E.interval_deltas(X.scores(spark, sf_dir).withColumn("cohort", cohort), E.INTERVALS[1:], ["cohort"])
    sets = d.groupingSets([["cohort", "interval"], ["cohort"]], "cohort", "interval").agg(*E.summary(F.col("delta")), F.grouping("interval").alias("_all"))
    return sets.withColumn("interval", F.when(F.col("_all") == 1, "pooled").otherwise(F.col("interval"))).drop("_all")


@query("v1v3_reconstruct", ", w as (select subject, max(case when pair_id like '%V1V2' and visit = 1 then score end) s1, max(case when pair_id like '%V2V3' and visit = 2 then score end) s3 from pair_scores group by subject) select subject, cast(1 as int) visit, R(s1) score from w where s1 is not null and s3 is not null union all select subject, cast(3 as int), R(s3) from w where s1 is not null and s3 is not null")
def v1v3_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pair_scores(spark, sf_dir)
    pick = lambda pair, v: F.max(F.when(F.col("pair_id").endswith(pair) & (F.col("visit") == v), F.col("score")))
    wide = p.groupBy("subject").agg(pick("V1V2", 1).alias("s1"), pick("V2V3", 2).alias("s3")).where("s1 is not null and s3 is not null")
    return wide.select("subject", F.explode(F.array(F.struct(F.lit(1).alias("visit"), F.col("s1").alias("score")), F.struct(F.lit(3).alias("visit"), F.col("s3").alias("score")))).alias("r")).select("subject", "r.*")


@query("nb_02_annual_clinical_effects", f", u as (unpivot pairs on {_UNP} into name measure value delta) select measure, case when grouping(pair) = 1 then 'pooled' else pair end pair, {_SUMMARY} from u group by grouping sets ((measure, pair), (measure))")
def annual_clinical_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = X.pairs(spark, sf_dir).unpivot(["pair"], [f"delta_{c}" for c in X.CLINICAL], "measure", "delta")
    sets = long.groupingSets([["measure", "pair"], ["measure"]], "measure", "pair").agg(*E.summary(F.col("delta")), F.grouping("pair").alias("_all"))
    return sets.withColumn("pair", F.when(F.col("_all") == 1, "pooled").otherwise(F.col("pair"))).drop("_all")


_RANK = "rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double"


@query("spearman_delta", ", j as (select delta_f_view a, delta_mfars_total b from pairs where delta_f_view is not null and delta_mfars_total is not null), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double rb from j) select count(*) n, R(corr(ra, rb)) rho from r")
def spearman_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spearman(X.pairs(spark, sf_dir).select("delta_f_view", "delta_mfars_total"), "delta_f_view", "delta_mfars_total")


_VALID = ", j as (select visit, score a, mfars_total b from scores join visits using (subject_id, visit)), r as (select visit, rank() over (partition by visit order by a) + (count(*) over (partition by visit, a) - 1) / 2.0::double ra, rank() over (partition by visit order by b) + (count(*) over (partition by visit, b) - 1) / 2.0::double rb from j)"


@query("jon_04_clinical_validity", _VALID + " select visit, count(*) n, R(corr(ra, rb)) rho from r group by visit")
def clinical_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = X.scores(spark, sf_dir).select("subject_id", "visit", "score").join(X.visits(spark, sf_dir).select("subject_id", "visit", "mfars_total"), ["subject_id", "visit"])
    return E.spearman(j, "score", "mfars_total", ["visit"])


@query("jon_04_clinical_validity_p", _VALID + ", c as (select visit, count(*) n, corr(ra, rb) rho from r group by visit), w as (select *, rho * sqrt((n - 2) / nullif(1 - rho * rho, 0)) t from c) select visit, n, R(rho) rho, R(t) t, R(" + _P.format(t="t", n="(n - 2)") + ") p from w")
def clinical_validity_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.kernels import t_two_sided

    r = clinical_validity(spark, sf_dir)
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") ** 2, F.lit(0.0)))
    return r.withColumn("t", t).withColumn("p", t_two_sided("t", F.col("n") - 2))


@query("mod_08_neg_srm_loss", "select R(case when count(delta_f_view) < 2 then 0 else -avg(delta_f_view) / (stddev_samp(delta_f_view) + 1e-6::double) end) loss from pairs")
def neg_srm_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("delta_f_view")
    return X.pairs(spark, sf_dir).agg(F.when(F.count(d) < 2, 0.0).otherwise(-F.avg(d) / (F.stddev_samp(d) + 1e-6)).alias("loss"))


@query("nb_12_pair_encoding", "select patient_id pair_id, cast(1 as int) visit, R(-delta_f_view / 2) score from pairs where delta_f_view is not null union all select patient_id, cast(2 as int), R(delta_f_view / 2) from pairs where delta_f_view is not null")
def pair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pairs(spark, sf_dir).where("delta_f_view is not null")
    half = F.col("delta_f_view") / 2
    rows = F.array(F.struct(F.lit(1).alias("visit"), (-half).alias("score")), F.struct(F.lit(2).alias("visit"), half.alias("score")))
    return p.select(F.col("patient_id").alias("pair_id"), F.explode(rows).alias("r")).select("pair_id", "r.*")


# layouts

_TRIP = ", ".join(f"R({c}_baseline) {c}_baseline, R({c}_followup) {c}_followup, R(delta_{c}) delta_{c}" for c in (*X.FEATURES, *X.CLINICAL))


@query("pair_wide_delta", f"select subject_id, site, study_group, pair, patient_id, {_TRIP} from pairs")
def pair_wide_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir)


@query("pair_to_long", f"select pair_id, subject, visit, site, study_group, {', '.join(f'R({c}) {c}' for c in (*X.FEATURES, *X.CLINICAL))} from pair_visits")
def pair_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pair_visits(spark, sf_dir)


_WIDE = ", ".join(f"max(case when visit = {v} then {m} end) {m}_v{v}" for m in ("f_click", "f_view", "mfars_total") for v in (1, 2, 3))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pivot_visits(X.visits(spark, sf_dir), "subject_id", ("f_click", "f_view", "mfars_total"))


@query("jon_01_pivot_visits", f"select subject_id, {', '.join(f'R({m}_v{v}) {m}_v{v}' for m in ('f_click', 'f_view', 'mfars_total') for v in (1, 2, 3))} from (select subject_id, {_WIDE} from visits group by subject_id)")
def pivot_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir)


_W = f", w as (select subject_id, {_WIDE} from visits group by subject_id)"


@query("wide_to_long", _W + " ".join(f" {'union all' if v > 1 else ''} select subject_id, cast({v} as int) visit, R(f_click_v{v}) f_click, R(f_view_v{v}) f_view, R(mfars_total_v{v}) mfars_total from w" for v in (1, 2, 3)))
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wide_to_long(_wide(spark, sf_dir), "subject_id", ("_v1", "_v2", "_v3"))


@query("rsh_02_stack_two_visits", _W + " select subject_id, cast(1 as int) visit, R(f_click_v1) click, R(f_view_v1) seen, R(mfars_total_v1) FARS from w union all select subject_id, cast(2 as int), R(f_click_v2), R(f_view_v2), R(mfars_total_v2) from w")
def stack_two_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stack_visits(_wide(spark, sf_dir), "subject_id", ("f_click_v1", "f_view_v1"), ("f_click_v2", "f_view_v2"), ("click", "seen"), targets={"FARS": ("mfars_total_v1", "mfars_total_v2")})


@query("rsh_03_two_visit_long", ", w as (select subject_id, site, " + _WIDE + " from visits group by subject_id, site) select subject_id, cast(1 as int) visit, R(f_click_v1) f_click, R(f_view_v1) f_view, R(mfars_total_v1) mfars_total, site from w union all select subject_id, cast(2 as int), R(f_click_v2), R(f_view_v2), R(mfars_total_v2), site from w")
def two_visit_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir).join(X.visits(spark, sf_dir).select("subject_id", "site").distinct(), "subject_id")
    return S.wide_to_long(wide, "subject_id", extra={"site": ("site", "site")}) if "site_v1" in wide.columns else S.wide_to_long(wide.drop(*[c for c in wide.columns if c.endswith("_v3")]), "subject_id", extra={"site": ("site", "site")})


@query("rsh_06_pairs_from_wide", _W + " select * from (" + " union all ".join(f"select subject_id, 'V{a}V{b}' pair, {', '.join(f'R({m}_v{a}) {m}_baseline, R({m}_v{b}) {m}_followup, R({m}_v{b} - {m}_v{a}) delta_{m}' for m in ('f_click', 'mfars_total'))} from w where coalesce(f_click_v{a}, f_view_v{a}) is not null and coalesce(f_click_v{b}, f_view_v{b}) is not null" for a, b in ((1, 2), (2, 3))) + ")")
def pairs_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pairs_from_wide(_wide(spark, sf_dir), ("f_click", "mfars_total"), ("f_click", "f_view"))


@query("interaction_expand", "select subject_id, visit, R(f_click * mfars_total) \"f_click × mfars_total\", R(f_click * adl_total) \"f_click × adl_total\", R(f_view * mfars_total) \"f_view × mfars_total\", R(f_view * adl_total) \"f_view × adl_total\" from visits")
def interaction_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interactions(X.visits(spark, sf_dir), ("f_click", "f_view"), ("mfars_total", "adl_total"), ("subject_id", "visit"))


@query("nb_03_visit_long_by_group", _W + " ".join(f" {'union all' if v > 1 else ''} select subject_id, cast({v} as int) visit, cast({v - 1} as double) time_years, R(f_click_v{v}) f_click, R(f_view_v{v}) f_view, R(mfars_total_v{v}) mfars_total from w where subject_id like '%0'" for v in (1, 2, 3)))
def visit_long_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir).where(F.col("subject_id").endswith("0"))
    return S.wide_to_long(wide, "subject_id", ("_v1", "_v2", "_v3")).withColumn("time_years", (F.col("visit") - 1).cast("double"))


@query("tim_01_visit_time", "select subject_id, visit, cast(case visit when 1 then 0 when 2 then 1 when 3 then 2 end as double) time_years from visits")
def visit_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.functions.ids import visit_years

    return X.visits(spark, sf_dir).select("subject_id", "visit", visit_years(F.concat(F.lit("V"), F.col("visit").cast("string"))).alias("time_years"))
