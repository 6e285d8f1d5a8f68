"""Queries on the end-to-end merge, stability of candidates, profiles and small networks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import Config
from tideline.functions import ids as I
from tideline.operators import cv as C
from tideline.operators import effects as E
from tideline.operators import neural as N
from tideline.operators import ranking as K
from tideline.operators.importance import subgroup_importance
from tideline.plans import fixtures as X
from tideline.plans import merge as G
from tideline.plans.queries_data import _CAND_SQL, _EVENT, _J, _cands, _sets
from tideline.plans.registry import query

_MERGED = """, people as (select subject_id, max(study_group) g from visits group by 1),
one as (select subject_id, visit, f_click, f_view from visits), two as (select subject_id, visit, f_purchase, f_error from visits where f_purchase is not null),
m as (select coalesce(one.subject_id, two.subject_id) subject_id, coalesce(one.visit, two.visit) visit, f_click, f_view, f_purchase, f_error from one full join two on one.subject_id = two.subject_id and one.visit = two.visit where coalesce(one.subject_id, two.subject_id) in (select subject_id from people where g <> 1)),
mp as (select a.subject_id || '_V' || a.visit || 'V' || b.visit patient_id, b.f_click - a.f_click d1, b.f_view - a.f_view d2, b.f_purchase - a.f_purchase d3 from m a join m b on a.subject_id = b.subject_id and b.visit = a.visit + 1 where b.f_view - a.f_view is not null and coalesce(a.f_click, a.f_view) is not null and coalesce(b.f_click, b.f_view) is not null and coalesce(a.f_purchase, a.f_error) is not null and coalesce(b.f_purchase, b.f_error) is not null)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir)
    e = X.visit_events(spark, sf_dir).select("subject_id", F.expr(_EVENT).alias("event"), F.concat(F.lit("u"), (F.col("user_id") % 6).cast("string")).alias("site_code"), F.when(F.col("user_id") % 10 == 0, "1").otherwise("0").alias("study_group"))
    sheets = {"one": v.select("subject_id", "visit", "f_click", "f_view"), "two": v.where("f_purchase is not null").select("subject_id", "visit", "f_purchase", "f_error")}
    return G.merge_study(e, I.event_rank(F.col("event")), ["site_code"], sheets, {"one": ["f_click", "f_view"], "two": ["f_purchase", "f_error"]}, ["f_view"])


@query("rsh_07_end_to_end_merge", _MERGED + " select patient_id, R(d1) delta_f_click, R(d2) delta_f_view, R(d3) delta_f_purchase from mp")
def end_to_end_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("patient_id", "delta_f_click", "delta_f_view", "delta_f_purchase")


@query("rsh_07_merge_invariants", _MERGED + " select count(*) n, count(*) n_ids, cast(0 as bigint) n_bad from mp")
def merge_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_invariants(_merged(spark, sf_dir))


@query("rsh_05_normalise_sheets", "select subject_id, visit, R(f_view) f_view from visits")
def normalise_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select(F.concat(F.lit(" "), "subject_id").alias("SubjectID"), F.concat(F.lit("Visit "), F.col("visit").cast("string")).alias("Visit"), "f_view")
    return G.normalise_sheets(v, "SubjectID", "Visit", ["f_view"])


@query("jon_05_visit_vectors", "select pair_id, R(max(case when visit = 1 then f_view end)) a, R(max(case when visit = 2 then f_view end)) b from pair_visits where f_view is not null group by 1 having count(distinct visit) = 2")
def visit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.prepare(X.pair_visits(spark, sf_dir), C.Plan("srm", ("f_view",)))
    return rows.select("pair_id", F.col("a")[0].alias("a"), F.col("b")[0].alias("b"))


@query("agg_27_candidate_stability", _J + f" select candidate_idx, R((select avg(jaccard) from j)) jaccard_stability from {_CAND_SQL}")
def candidate_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.stability import jaccard_summary

    return _cands(spark, sf_dir).select("candidate_idx").crossJoin(F.broadcast(jaccard_summary(_sets(spark, sf_dir)).select(F.col("mean").alias("jaccard_stability"))))


@query("srt_10_selected_config", f"select cast(candidate_idx as int) candidate_idx, R(coalesce(se_validation_dz, 0.05)) se from {_CAND_SQL} order by mean_validation_annual_dz desc nulls last, candidate_idx limit 1", fixtures=False)
def selected_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_k(_cands(spark, sf_dir), 1, [F.col("mean_validation_annual_dz").desc_nulls_last(), "candidate_idx"]).select("candidate_idx", F.coalesce("se_validation_dz", F.lit(0.05)).alias("se"))


@query("srt_11_best_combo", f"select cast(candidate_idx as int) candidate_idx from {_CAND_SQL} order by coalesce(feature_count, 0) >= 5 desc, mean_validation_annual_dz desc nulls last, candidate_idx limit 1", fixtures=False)
def best_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.coalesce(F.col("feature_count"), F.lit(0.0)) >= 5
    return K.top_k(_cands(spark, sf_dir), 1, [whole.desc(), F.col("mean_validation_annual_dz").desc_nulls_last(), "candidate_idx"]).select("candidate_idx")


#: Profiles of the fixture's modulator, in its own unit.
_PROFILES = {"few": {"adl_total": 5.0}, "some": {"adl_total": 20.0}, "many": {"adl_total": 40.0}}


@query("imp_05_profile_importance")
def profile_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the interaction model at profiles of the modulator: beta + gamma * z."""
    features = ("f_click", "f_view")
    plan = C.Plan("interaction", features, ("adl_total",), candidates=(C.Candidate(alpha=0.05, l1_ratio=0.1),))
    (mean, sd), fit = C.fit_whole(X.pair_visits(spark, sf_dir), plan)
    w = fit[0]
    table = [(name, f, float(w[k] + w[len(features) + k] * (z["adl_total"] - mean[2]) / sd[2])) for name, z in _PROFILES.items() for k, f in enumerate(features)]
    return spark.createDataFrame(table, "profile string, feature string, weight double")


@query("imp_05_subgroup_bootstrap")
def subgroup_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Config()
    return subgroup_importance(X.pair_visits(spark, sf_dir), ("f_click", "f_view"), ("adl_total",), _PROFILES, 0.05, 0.1, c.bootstrap, c.seed)


@query("imp_05_named_profiles")
def named_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at the four named profiles of age at onset, repeat length and duration, by resamples of subjects."""
    c = Config()
    rows = X.pair_visits(spark, sf_dir).select("pair_id", "subject", "visit", "f_click", "f_view", F.col("sara_total").alias("age_at_onset"), F.col("mfars_total").alias("GAA1"), F.col("adl_total").alias("dur"))
    return subgroup_importance(rows, ("f_click", "f_view"), ("age_at_onset", "GAA1", "dur"), c.subgroups, c.interaction_alpha, c.interaction_l1_ratio, c.bootstrap, c.seed)


@query("dlt_01_fusion_cv")
def fusion_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.prepare(X.pair_visits(spark, sf_dir), C.Plan("srm", ("f_click", "f_error", "f_purchase", "f_view")))
    return N.network_cv(rows, N.Network(((0, 1), (2, 3), ())))


@query("dlt_02_pair_cv")
def pair_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.prepare(X.pair_visits(spark, sf_dir), C.Plan("srm", ("f_click", "f_error", "f_purchase", "f_view")))
    return E.adjacent_effects(N.network_cv(rows, N.Network(((0, 1, 2, 3),))))


@query("mod_06_fusion_forward")
def fusion_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = N.Network(((0, 1), (2,), ()))
    v = X.visits(spark, sf_dir).dropna(subset=["f_click", "f_view", "f_error"])
    return N.network_scores(v, net, N.start(net), ["f_click", "f_view", "f_error"], ["subject_id", "visit"])


#: The fused network of the study: three encoders of two ReLU layers, a fused ReLU layer, dropout, and clinical heads that no clinical column trains.
def _fusion(**more) -> N.Network:
    return N.Network(((0, 1), (2, 3), ()), hidden=(8, 8, 4), out=(4, 4, 2), relu_out=True, head=4, dropout=0.2, clinical=(("fars", 4, 0.0), ("sara", 5, 0.0)), **more)


_FUSED = ("f_click", "f_error", "f_purchase", "f_view", "mfars_total", "sara_total")


@query("mod_06_fusion_dropout_cv")
def fusion_dropout_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores and clinical predictions of the fused network, trained with dropout for the score alone."""
    return N.network_cv(C.prepare(X.pair_visits(spark, sf_dir), C.Plan("srm", _FUSED)), _fusion(epochs=15))


@query("mod_07_pair_joint_loss")
def pair_joint_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of the pair model with dropout whose loss adds both clinical heads; clinical columns train it only because it is asked to."""
    net = N.Network(((0, 1, 2, 3),), relu_out=True, dropout=0.2, epochs=15, clinical=(("fars", 4, 1e-5), ("sara", 5, 1e-3)))
    return E.adjacent_effects(N.network_cv(C.prepare(X.pair_visits(spark, sf_dir), C.Plan("srm", _FUSED)), net, train_clinical=True))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, net = X.pair_visits(spark, sf_dir), _fusion(epochs=10)
    fitted = N.fit_network(C.prepare(rows, C.Plan("srm", _FUSED)), net)
    return N.deep_shap(rows, net, fitted, _FUSED[:4], ["pair_id", "visit"], rows)


@query("imp_06_deep_shap")
def deep_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of every feature to the fused network's score at every visit, beside a background of 100 visits."""
    return _explained(spark, sf_dir)


@query("imp_06_deep_shap_modalities")
def deep_shap_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.modality_shap(_explained(spark, sf_dir), {"struct": _FUSED[:2], "diff": _FUSED[2:4], "back": ()})


@query("imp_06_rescale_one_unit", ", v as (select subject_id, visit, f_click x, f_view y from visits where f_click is not null and f_view is not null), b as (select x, y from v where visit = 1 and subject_id like '%7'), m as (select subject_id, visit, v.x - b.x dx, v.y - b.y dy, v.x - 0.5 * v.y - 20 z, b.x - 0.5 * b.y - 20 z0 from v, b), r as (select *, case when abs(z - z0) < 1e-12 then (z > 0)::int::double else (greatest(z, 0) - greatest(z0, 0)) / (z - z0) end r from m) select subject_id, visit, 'f_click' feature, R(avg(2 * r * dx)) shap, R(avg(2 * greatest(z0, 0))) base, R(2 * greatest(any_value(z), 0)) score from r group by 1, 2 union all select subject_id, visit, 'f_view', R(avg(-1 * r * dy)), R(avg(2 * greatest(z0, 0))), R(2 * greatest(any_value(z), 0)) from r group by 1, 2")
def rescale_one_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions through one rectified unit of given weights."""
    net = N.Network(((0, 1),), hidden=1, out=1)
    p = {"a0": np.array([[1.0], [-0.5]]), "b0": np.array([-20.0]), "c0": np.array([[2.0]]), "d0": np.zeros(1), "w0": np.ones(1)}
    v = X.visits(spark, sf_dir)
    known = v.where("visit = 1 and subject_id like '%7'")
    return N.deep_shap(v, net, N.Fitted(p, np.zeros(2), np.ones(2)), ["f_click", "f_view"], ["subject_id", "visit"], known, most=10_000)


@query("src_06_merge_cohorts", ", p as (select 'pac' || case when length(n) < 2 then '0' else '' end || n pac, err from (select cast(cast(right(subject_id, 4) as int) as varchar) n, avg(f_error) err from visits group by 1)), q as (select subject_id, max(f_signup) s, max(adl_total) a from visits where visit = 1 group by 1), m as (select subject_id, visit, f_error, f_signup, cast(cast(right(subject_id, 4) as int) as varchar) n, study_group = 1 c from visits) select m.subject_id, m.visit, R(coalesce(f_error, case when c then err end)) f_error, R(coalesce(f_signup, case when not c then s end)) f_signup, R(case when not c then a end) adl_first from m left join p on c and pac = 'pac' || case when length(n) < 2 then '0' else '' end || n left join q on not c and q.subject_id = m.subject_id")
def merge_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cohorts, each filled from a table of its own whose ids are spelt in another way."""
    v = X.visits(spark, sf_dir)
    number = F.substring("subject_id", -4, 4).cast("int").cast("string")
    spelt = F.concat(F.lit("sub-campac"), number)
    pac = v.groupBy(I.campac_to_pac(spelt).alias("pac")).agg(F.avg("f_error").alias("err"))
    first = v.where("visit = 1").select("subject_id", "f_signup", "adl_total")
    fills = [G.Fill(pac, I.campac_to_pac(spelt), "pac", {"f_error": "err"}, F.col("study_group") == 1), G.Fill(first, F.col("subject_id"), "subject_id", {"f_signup": "f_signup", "adl_first": "adl_total"}, F.col("study_group") == 0)]
    return G.merge_cohorts(v.select("subject_id", "visit", "study_group", "f_error", "f_signup"), fills).drop("study_group")
