"""Queries on selection, fits, cross-validation and importance.

Queries with SQL use closed forms of one or two features; the others have no SQL and
are tested against NumPy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.config import Config
from tideline.operators import composite as O
from tideline.operators import cv as C
from tideline.operators import effects as E
from tideline.operators import importance as M
from tideline.operators import kernels as K
from tideline.operators import netpath as P
from tideline.operators import selection as L
from tideline.operators.moments import gram_matrix
from tideline.operators.ranking import place
from tideline.plans import fixtures as X
from tideline.plans.registry import query

FOUR = ("f_click", "f_error", "f_purchase", "f_view")


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pairs(spark, sf_dir)
    return p.select("patient_id", F.col("subject_id").alias("subject"), F.when(F.col("pair") == "V1V2", "V1->V2").otherwise("V2->V3").alias("interval"), *[F.col(f"delta_{f}").alias(f) for f in (*X.FEATURES, *X.CLINICAL)])


# selection

_DL = ", dl as (select case pair when 'V1V2' then 'V1->V2' else 'V2->V3' end interval, patient_id pair_id, " + ", ".join(f"delta_{f} {f}" for f in X.FEATURES) + " from pairs)"


@query("sel_02_annual_feature_deltas", _DL + " select pair_id, interval, " + ", ".join(f"R({f}) {f}" for f in X.FEATURES) + " from dl")
def annual_feature_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paired_deltas(X.pair_visits(spark, sf_dir), X.FEATURES)


_UE = _DL + f", u as (select interval, feature, delta from dl unpivot (delta for feature in ({', '.join(X.FEATURES)}))), g as (select feature, interval, avg(delta) / nullif(stddev_samp(delta), 0) d from u group by 1, 2), w as (select feature, max(case when interval = 'V1->V2' then d end) d12, max(case when interval = 'V2->V3' then d end) d23 from g group by 1), e as (select feature, d12, d23, coalesce((d12 + d23) / 2, d12, d23) m, abs(d12 - d23) gap from w)"


@query("univariate_progression_rank", _UE + " select feature, R(d12) d12, R(d23) d23, R(m) mean_dz, R(abs(m)) abs_dz, R(gap) gap, cast(row_number() over (order by abs(m) desc nulls last, gap nulls last, feature) as int) rank from e")
def univariate_progression_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.univariate_effects(_deltas(spark, sf_dir), X.FEATURES)


@query("sel_01_select_by_method")
def select_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = X.pair_visits(spark, sf_dir)
    methods = ("none", "mi", "mml", "progression_univariate", "progression_mrmr", "sparse_srm")
    return spark.createDataFrame([(m, L.select_features(m, long, list(X.FEATURES), 3)) for m in methods], "method string, features array<string>")


@query("mrmr_select")
def mrmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = L.mrmr_features(_deltas(spark, sf_dir), list(X.FEATURES), 5)
    return spark.createDataFrame(list(enumerate(names, 1)), "rank int, feature string")


@query("sparse_srm_select")
def sparse_srm_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(L.sparse_weights(_deltas(spark, sf_dir), list(X.FEATURES)).items()), "feature string, weight double")


@query("sel_05_sparse_two", ", d as (select pair, delta_f_view a, delta_f_click b from pairs where delta_f_view is not null and delta_f_click is not null), g as (select pair, avg(a) ma, avg(b) mb, var_samp(a) va, var_samp(b) vb, covar_samp(a, b) c from d group by 1), s as (select avg(ma) ma, avg(mb) mb, avg(va) + 0.005::double + 1e-8::double va, avg(vb) + 0.005::double + 1e-8::double vb, avg(c) c from g), w as (select (vb * ma - c * mb) / (va * vb - c * c) x, (va * mb - c * ma) / (va * vb - c * c) y from s) select 'f_view' feature, R(sign(x) * greatest(abs(x) - 0.005, 0)) weight from w union all select 'f_click', R(sign(y) * greatest(abs(y) - 0.005, 0)) from w")
def sparse_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(L.sparse_weights(_deltas(spark, sf_dir), ["f_view", "f_click"]).items()), "feature string, weight double")


@query("mml_select")
def mml_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _deltas(spark, sf_dir)
    return spark.createDataFrame(L.mml_features(d, list(X.FEATURES), "mfars_total"), "feature string, message_length double")


@query("sel_06_mml_null_score", ", d as (select delta_mfars_total y from pairs), s as (select count(*)::double n, var_pop(y) v from d) select R(0.5 * ln(n / 12) + 0.5 * (ln(n) - ln(v)) + 0.5 * n * ln(2 * pi() * v) + 0.5 * n) message_length from s")
def mml_null_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gram_matrix(_deltas(spark, sf_dir), ["mfars_total"])[""]
    return spark.createDataFrame([(K.message_length(g, []),)], "message_length double")


@query("sel_07_mi_top_k", ", u as (select visit, feature, value from (select visit, " + ", ".join(X.FEATURES) + " from pair_visits) unpivot (value for feature in (" + ", ".join(X.FEATURES) + "))), q as (select feature, list_distinct(quantile_cont(value, [" + ", ".join(f"{k / 10}" for k in range(1, 10)) + "])) e from u group by 1), b as (select u.feature, visit, len(list_filter(q.e, lambda z: z < value)) bin from u join q using (feature)), j as (select feature, bin, visit, count(*)::double c from b group by all), p as (select feature, c / sum(c) over (partition by feature) p, sum(c) over (partition by feature, bin) / sum(c) over (partition by feature) a, sum(c) over (partition by feature, visit) / sum(c) over (partition by feature) b from j), m as (select feature, sum(p * ln(p / (a * b))) mi from p group by 1) select feature, R(mi) mi, cast(row_number() over (order by mi desc, feature) as int) rank from m qualify rank <= 3")
def mi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.stability import feature_information

    return place(feature_information(X.pair_visits(spark, sf_dir), list(X.FEATURES), "visit"), [F.col("mi").desc(), "feature"], "rank").where("rank <= 3")


@query("sel_08_bic_forward")
def bic_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(L.bic_features(_deltas(spark, sf_dir), list(X.FEATURES), "mfars_total"), "feature string, aic double, bic double")


@query("sel_09_information_gain", _DL + ", t as (select d.*, p.delta_mfars_total y from dl d join pairs p on p.patient_id = d.pair_id), c as (select *, len(list_filter((select quantile_cont(y, [0.25, 0.5, 0.75]) from t), lambda z: z < y)) yb from t), u as (select yb, feature, value from c unpivot (value for feature in (" + ", ".join(X.FEATURES) + "))), q as (select feature, list_distinct(quantile_cont(value, [" + ", ".join(f"{k / 10}" for k in range(1, 10)) + "])) e from u group by 1), b as (select u.feature, yb, len(list_filter(q.e, lambda z: z < value)) bin from u join q using (feature)), j as (select feature, bin, yb, count(*)::double c from b group by all), p as (select feature, c / sum(c) over (partition by feature) p, sum(c) over (partition by feature, bin) / sum(c) over (partition by feature) a, sum(c) over (partition by feature, yb) / sum(c) over (partition by feature) b from j) select feature, R(sum(p * ln(p / (a * b)))) mi from p group by 1")
def information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.stability import feature_information, with_quantile_bin

    d = with_quantile_bin(_deltas(spark, sf_dir), "mfars_total", "yb", 4)
    return feature_information(d, list(X.FEATURES), "yb")


_PSI = "(-0.57721566490153286 + coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0::double / i)), 0))"
_KNN = ", t as (select delta_mfars_total y, " + ", ".join(f"coalesce(delta_{f}, (select quantile_cont(delta_{f}, 0.5) from pairs)) {f}" for f in X.FEATURES) + " from pairs), u as (select feature, x / sx x, y / sy y, row_number() over () i from (select feature, x, y, stddev_pop(x) over (partition by feature) sx, stddev_pop(y) over (partition by feature) sy from t unpivot (x for feature in (" + ", ".join(X.FEATURES) + ")))), r as (select a.feature, a.i, list_sort(list(greatest(abs(a.x - b.x), abs(a.y - b.y))))[3] r from u a join u b on a.feature = b.feature and a.i <> b.i group by 1, 2), c as (select r.feature, r.i, count(*) filter (abs(a.x - b.x) < r or (r = 0 and a.x = b.x)) nx, count(*) filter (abs(a.y - b.y) < r or (r = 0 and a.y = b.y)) ny from r join u a using (feature, i) join u b on b.feature = r.feature group by 1, 2) select feature, count(*) n, R(greatest(0, " + _PSI.format(n="count(*)") + " + 1.5 - 0.57721566490153286 - avg(" + _PSI.format(n="nx") + " + " + _PSI.format(n="ny") + "))) mi from c group by 1"


@query("sel_09_knn_information", _KNN)
def knn_information_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Information of every delta about the change of the scale, from three nearest neighbours."""
    from tideline.operators.information import knn_information

    return knn_information(_deltas(spark, sf_dir), list(X.FEATURES), "mfars_total")


# fits in closed form

@query("srm_diagonal_w", f", u as (select feature, delta from (select {', '.join(f'delta_{f} {f}' for f in FOUR)} from pairs where {' and '.join(f'delta_{f} is not null' for f in FOUR)}) unpivot (delta for feature in ({', '.join(FOUR)}))) select feature, R(avg(delta) / (var_samp(delta) + 1e-6::double)) weight from u group by 1")
def srm_diagonal_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gram_matrix(_deltas(spark, sf_dir), FOUR)[""]
    return spark.createDataFrame(list(zip(FOUR, K.srm_weights(g, 1e-6, 1.0).tolist())), "feature string, weight double")


@query("srm_p2_closed_form", ", d as (select delta_f_view a, delta_f_click b from pairs where delta_f_view is not null and delta_f_click is not null), s as (select avg(a) ma, avg(b) mb, var_samp(a) + 1e-6::double va, var_samp(b) + 1e-6::double vb, covar_samp(a, b) c from d) select 'f_view' feature, R((vb * ma - c * mb) / (va * vb - c * c)) weight from s union all select 'f_click', R((va * mb - c * ma) / (va * vb - c * c)) from s")
def srm_p2_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(M.locked_srm(_deltas(spark, sf_dir), ["f_view", "f_click"]).items()), "feature string, weight double")


@query("lda_p2_closed_form", ", v as (select visit, f_view a, f_click b from pair_visits where f_view is not null and f_click is not null), g as (select visit, avg(a) ma, avg(b) mb, var_samp(a) va, var_samp(b) vb, covar_samp(a, b) c from v group by 1), s as (select y.ma - x.ma ma, y.mb - x.mb mb, (x.va + y.va) / 2 + 1e-3::double * ((x.va + y.va) / 2 + (x.vb + y.vb) / 2) / 2 va, (x.vb + y.vb) / 2 + 1e-3::double * ((x.va + y.va) / 2 + (x.vb + y.vb) / 2) / 2 vb, (x.c + y.c) / 2 c from g x, g y where x.visit = 1 and y.visit = 2) select 'f_view' feature, R((vb * ma - c * mb) / (va * vb - c * c)) weight from s union all select 'f_click', R((va * mb - c * ma) / (va * vb - c * c)) from s")
def lda_p2_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gram_matrix(X.pair_visits(spark, sf_dir), ["f_view", "f_click"], "visit")
    return spark.createDataFrame(list(zip(("f_view", "f_click"), K.lda_weights(g["1"], g["2"]).tolist())), "feature string, weight double")


@query("mod_05_lasso_one_feature", ", d as (select delta_f_view x, delta_mfars_total y from pairs where delta_f_view is not null), s as (select covar_pop(x, y) c, var_pop(x) v, avg(x) mx, avg(y) my from d), w as (select sign(c) * greatest(abs(c) - 0.5 * 0.5, 0) / (v + 0.5 * 0.5) w, mx, my from s) select R(w) weight, R(my - w * mx) intercept from w")
def lasso_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b = K.elastic_net(gram_matrix(_deltas(spark, sf_dir), ["f_view", "mfars_total"])[""], 0.5, 0.5)
    return spark.createDataFrame([(float(w[0]), b)], "weight double, intercept double")


@query("mod_03_interaction_one_feature", ", d as (select delta_f_view x from pairs where delta_f_view is not null), s as (select avg(x) m, avg(x * x) q from d) select R(sign(m) * greatest(abs(m) - 0.05, 0) / (q + 0.05)) weight from s")
def interaction_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = K.constant_net(gram_matrix(_deltas(spark, sf_dir), ["f_view"])[""], 0.1, 0.5)
    return spark.createDataFrame([(float(w[0]),)], "weight double")


# cross-validation

def _plan(kind: str, **more) -> C.Plan:
    c = Config()
    return C.Plan(kind, more.pop("features", FOUR), **({"outer": c.folds, "inner": c.inner_folds, "seed": c.seed} | more))


@query("srm_grouped_cv")
def srm_grouped_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("srm"))[0]


_WHOLE = " and ".join(f"{f}_baseline is not null and {f}_followup is not null" for f in FOUR)
_OUT = f", o as (select unnest(range(5)) o), c as (select *, ('0x' || substr(md5('42|' || subject_id), 1, 8))::bigint % 5 fold from pairs where {_WHOLE})"
_PICKED = _OUT + f", u as (select o, pair, feature, delta from (select o, pair, {', '.join(f'delta_{f} {f}' for f in FOUR)} from c, o where fold <> o) unpivot (delta for feature in ({', '.join(FOUR)}))), g as (select o, feature, pair, avg(delta) / nullif(stddev_samp(delta), 0) d from u group by 1, 2, 3), w as (select o, feature, max(case when pair = 'V1V2' then d end) a, max(case when pair = 'V2V3' then d end) b from g group by 1, 2), k as (select *, row_number() over (partition by o order by abs(coalesce((a + b) / 2, a, b)) desc nulls last, abs(a - b) nulls last, feature) r from w) select cast(0 as int) repeat, cast(o as int) fold, string_agg(feature, ',' order by r) features from k where r <= {{k}} group by o"


def _selected(spark: SparkSession, sf_dir: str, kind: str, k: int, method: str) -> DataFrame:
    found = C.cross_validate(X.pair_visits(spark, sf_dir), _plan(kind, selection=method, k=k))
    return found.selected.withColumn("features", F.array_join("features", ","))


@query("cvr_01_selected_features", _PICKED.replace("{k}", "2"))
def srm_selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "srm", 2, "progression_univariate")


@query("cvr_04_selected_features", _PICKED.replace("{k}", "3"))
def lda_selected_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selected(spark, sf_dir, "lda", 3, "progression_univariate")


_BY_INFORMATION = _OUT + f", u as (select o, visit, feature, value from (select o, 1 visit, {', '.join(f'{f}_baseline {f}' for f in FOUR)} from c, o where fold <> o union all select o, 2, {', '.join(f'{f}_followup' for f in FOUR)} from c, o where fold <> o) unpivot (value for feature in ({', '.join(FOUR)}))), q as (select o, feature, list_distinct(quantile_cont(value, [{', '.join(f'{k / 10}' for k in range(1, 10))}])) e from u group by 1, 2), b as (select o, feature, visit, len(list_filter(e, lambda z: z < value)) bin from u join q using (o, feature)), j as (select o, feature, bin, visit, count(*)::double c from b group by all), p as (select o, feature, c / sum(c) over (partition by o, feature) p, sum(c) over (partition by o, feature, bin) / sum(c) over (partition by o, feature) a, sum(c) over (partition by o, feature, visit) / sum(c) over (partition by o, feature) b from j), k as (select o, feature, row_number() over (partition by o order by round(sum(p * ln(p / (a * b))), 9) desc, feature) r from p group by 1, 2) select cast(0 as int) repeat, cast(o as int) fold, string_agg(feature, ',' order by r) features from k where r <= 2 group by o"


@query("sel_07_information_by_fold", _BY_INFORMATION)
def information_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of most information about the visit, by exact quantile bins of each training set."""
    return _selected(spark, sf_dir, "srm", 2, "mi")


_GROUPED = _BY_INFORMATION.replace("row_number() over (partition by o order by round(sum(p * ln(p / (a * b))), 9) desc, feature) r from p group by 1, 2", "case when feature in ('f_purchase', 'f_view') then 0 else 1 end g, row_number() over (partition by o, case when feature in ('f_purchase', 'f_view') then 0 else 1 end order by round(sum(p * ln(p / (a * b))), 9) desc, feature) r from p group by 1, 2").replace("order by r) features from k where r <= 2", "order by g, r) features from k where r <= 1")


@query("sel_07_information_by_group", _GROUPED)
def information_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature of most information about the visit in each group, by each training set's own rows."""
    found = C.cross_validate(X.pair_visits(spark, sf_dir), _plan("lda", selection="mi", k=1, groups=(("f_view", "f_purchase"), ("f_click", "f_error"))))
    return found.selected.withColumn("features", F.array_join("features", ","))


@query("cvr_02_selected_nested")
def srm_selected_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a nested search whose every training set selects by redundancy and relevance."""
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("srm", selection="progression_mrmr", k=2, candidates=C.grid(shrinkage=(0.0, 1.0)))).candidates


_TWO = _OUT.replace(_WHOLE, "f_view_baseline is not null and f_view_followup is not null and f_click_baseline is not null and f_click_followup is not null") + """, m as (select o, avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy from (select o, f_view_baseline x, f_click_baseline y from c, o where fold <> o union all select o, f_view_followup, f_click_followup from c, o where fold <> o) group by o),
z as (select m.o, c.fold, c.patient_id, c.subject_id, (f_view_baseline - mx) / sx x1, (f_view_followup - mx) / sx x2, (f_click_baseline - my) / sy y1, (f_click_followup - my) / sy y2 from c, m),
"""
_TWO_END = """, w as (select o, (vq * mp - k * mq) / (vp * vq - k * k) wp, (vp * mq - k * mp) / (vp * vq - k * k) wq from s)
select cast(0 as int) repeat, cast(o as int) fold, patient_id pair_id, subject_id subject, cast(1 as int) visit, R(x1 * wp + y1 * wq) score from z join w using (o) where fold = o union all select cast(0 as int), cast(o as int), patient_id, subject_id, cast(2 as int), R(x2 * wp + y2 * wq) from z join w using (o) where fold = o"""


@query("cvr_01_srm_two_features", _TWO + "s as (select o, avg(x2 - x1) mp, avg(y2 - y1) mq, var_samp(x2 - x1) + 1e-6::double vp, var_samp(y2 - y1) + 1e-6::double vq, covar_samp(x2 - x1, y2 - y1) k from z where fold <> o group by o)" + _TWO_END)
def srm_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_validate(X.pair_visits(spark, sf_dir), C.Plan("srm", ("f_view", "f_click"))).scores


@query("cvr_04_lda_two_features", _TWO + "v as (select o, avg(x2) - avg(x1) mp, avg(y2) - avg(y1) mq, (var_samp(x1) + var_samp(x2)) / 2 a, (var_samp(y1) + var_samp(y2)) / 2 b, (covar_samp(x1, y1) + covar_samp(x2, y2)) / 2 k from z where fold <> o group by o), s as (select o, mp, mq, k, a + 1e-3::double * (a + b) / 2 vp, b + 1e-3::double * (a + b) / 2 vq from v)" + _TWO_END)
def lda_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_validate(X.pair_visits(spark, sf_dir), C.Plan("lda", ("f_view", "f_click"))).scores


@query("cvr_03_repeated_group_cv")
def repeated_group_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    oof = C.cross_validate(X.pair_visits(spark, sf_dir), _plan("srm", repeats=3)).scores
    d = oof.groupBy("repeat", "pair_id").agg((F.max_by("score", "visit") - F.min_by("score", "visit")).alias("delta"))
    return d.groupBy("repeat").agg(*E.summary(F.col("delta")))


@query("srm_nested_cv")
def srm_nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = C.grid(ridge=(1e-6,), shrinkage=(0.0, 0.5, 1.0), clip=(None, 3.0))
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("srm", candidates=grid))[1]


@query("cvr_04_lda_cv")
def lda_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("lda"))[0]


@query("lda_nested_cv")
def lda_nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("lda", candidates=C.grid(shrinkage=(0.0, 0.5), clip=(None, 2.0))))[1]


@query("interaction_cv")
def interaction_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Config()
    plan = _plan("interaction", features=("f_click", "f_view"), modulators=("adl_total",), candidates=C.grid(alpha=c.interaction_alpha_grid, l1_ratio=c.interaction_l1_grid))
    return C.cross_validate(X.pair_visits(spark, sf_dir), plan)[0]


@query("elasticnet_cd_cv")
def elasticnet_cd_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = C.Plan("regression", FOUR, target="mfars_total", candidates=C.grid(alpha=(0.01, 0.1, 1.0), l1_ratio=(0.1, 0.9)), inner=3)
    oof = C.cross_validate(X.pair_visits(spark, sf_dir), plan, metric="rmse").scores
    return E.rmse_r2(oof, "target", "score")


_PAIRED = "f_view_baseline is not null and f_view_followup is not null and {b}_baseline is not null and {b}_followup is not null"
#: Folds of three repeats side by side: fold r * 5 + f of repeat r.
_THRICE = (_TWO.replace("(select unnest(range(5)) o)", "(select unnest(range(15)) o)").replace("('0x' || substr(md5('42|' || subject_id), 1, 8))::bigint % 5 fold from pairs", "r * 5 + ('0x' || substr(md5((42 + 1000 * r) || '|' || subject_id), 1, 8))::bigint % 5 fold from pairs, (select unnest(range(3)) r)").replace("from c, o where fold <> o", "from c, o where fold <> o and fold // 5 = o // 5").replace("from c, m)", "from c, m where fold // 5 = m.o // 5)"))


@query("cvr_03_two_features", _THRICE + "s as (select o, avg(x2 - x1) mp, avg(y2 - y1) mq, var_samp(x2 - x1) + 1e-6::double vp, var_samp(y2 - y1) + 1e-6::double vq, covar_samp(x2 - x1, y2 - y1) k from z where fold <> o group by o), w as (select o, (vq * mp - k * mq) / (vp * vq - k * k) wp, (vp * mq - k * mp) / (vp * vq - k * k) wq from s), e as (select o // 5 repeat, (x2 - x1) * wp + (y2 - y1) * wq d from z join w using (o) where fold = o) select cast(repeat as int) repeat, count(*) n_pairs, R(avg(d)) mean_change, R(avg(d) / stddev_samp(d)) d_z from e group by 1")
def repeated_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of each repeat of a grouped cross-validation of two features."""
    oof = C.cross_validate(X.pair_visits(spark, sf_dir), _plan("srm", features=("f_view", "f_click"), repeats=3)).scores
    d = oof.groupBy("repeat", "pair_id").agg((F.max_by("score", "visit") - F.min_by("score", "visit")).alias("delta"))
    return d.groupBy("repeat").agg(F.count("delta").alias("n_pairs"), F.avg("delta").alias("mean_change"), E.cohens_dz(F.col("delta")).alias("d_z"))


@query("cvr_07_one_feature", _OUT.replace(_WHOLE, _PAIRED.format(b="mfars_total")) + ", t as (select o, f_view_baseline x, mfars_total_baseline y from c, o where fold <> o union all select o, f_view_followup, mfars_total_followup from c, o where fold <> o), m as (select o, avg(x) mx, stddev_pop(x) sx, avg(y) my, covar_pop(x, y) / stddev_pop(x) c from t group by o), w as (select *, sign(c) * greatest(abs(c) - 0.5 * 0.4, 0) / (1 + 0.5 * 0.6) w from m), e as (select o, 1 visit, fold, f_view_baseline x, mfars_total_baseline y, patient_id, subject_id from c, o union all select o, 2, fold, f_view_followup, mfars_total_followup, patient_id, subject_id from c, o) select cast(0 as int) repeat, cast(o as int) fold, patient_id pair_id, subject_id subject, cast(visit as int) visit, R((x - mx) / sx * w + my) score, R(y) target from e join w using (o) where fold = o")
def net_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions of an elastic net of one feature."""
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("regression", features=("f_view",), target="mfars_total", candidates=(C.Candidate(alpha=0.5, l1_ratio=0.4),))).scores


@query("cvr_06_one_feature", _OUT.replace(_WHOLE, _PAIRED.format(b="adl_total")) + ", t as (select o, f_view_baseline x, adl_total_baseline y from c, o where fold <> o union all select o, f_view_followup, adl_total_followup from c, o where fold <> o), m as (select o, avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy from t group by o), z as (select m.o, fold, patient_id, subject_id, (f_view_baseline - mx) / sx x1, (f_view_followup - mx) / sx x2, (adl_total_baseline - my) / sy y1, (adl_total_followup - my) / sy y2 from c, m), s as (select o, avg(x2 - x1) bp, avg(x2 * y2 - x1 * y1) bq, avg(pow(x2 - x1, 2)) + 0.3 p, avg(pow(x2 * y2 - x1 * y1, 2)) + 0.3 q, avg((x2 - x1) * (x2 * y2 - x1 * y1)) k from z where fold <> o group by o), w as (select o, (q * bp - k * bq) / (p * q - k * k) wp, (p * bq - k * bp) / (p * q - k * k) wq from s) select cast(0 as int) repeat, cast(o as int) fold, patient_id pair_id, subject_id subject, cast(1 as int) visit, R(x1 * wp + x1 * y1 * wq) score from z join w using (o) where fold = o union all select cast(0 as int), cast(o as int), patient_id, subject_id, cast(2 as int), R(x2 * wp + x2 * y2 * wq) from z join w using (o) where fold = o")
def interaction_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the interaction model of one feature and one modulator, with a ridge alone."""
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("interaction", features=("f_view",), modulators=("adl_total",), candidates=(C.Candidate(alpha=0.3, l1_ratio=0.0),))).scores


@query("cvr_09_tuned_by_d")
def tuned_by_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = C.Plan("regression", FOUR, target="mfars_total", candidates=C.grid(alpha=(0.01, 0.1), l1_ratio=(0.5,)))
    return C.cross_validate(X.pair_visits(spark, sf_dir), plan, metric="d")[1]


@query("cvr_09_tuned_coefficients")
def tuned_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients by fold of the candidate that the inner folds' effects choose."""
    plan = _plan("regression", target="mfars_total", candidates=C.grid(alpha=(0.01, 0.1), l1_ratio=(0.5,)))
    return C.cross_validate(X.pair_visits(spark, sf_dir), plan, metric="d").coefficients


_TWO_WEIGHTS = _TWO + "s as (select o, avg(x2 - x1) mp, avg(y2 - y1) mq, var_samp(x2 - x1) + 1e-6::double vp, var_samp(y2 - y1) + 1e-6::double vq, covar_samp(x2 - x1, y2 - y1) k from z where fold <> o group by o) select cast(0 as int) repeat, cast(o as int) fold, cast(0 as int) candidate_idx, 'f_view' term, R((vq * mp - k * mq) / (vp * vq - k * k)) coef from s union all select cast(0 as int), cast(o as int), cast(0 as int), 'f_click', R((vp * mq - k * mp) / (vp * vq - k * k)) from s"


@query("cvr_01_fold_coefficients", _TWO_WEIGHTS)
def fold_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cross_validate(X.pair_visits(spark, sf_dir), _plan("srm", features=("f_view", "f_click"))).coefficients


@query("cvr_08_held_out_grid")
def held_out_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of every candidate over the held-out folds of all repeats; taking the best of them is optimistic."""
    fits = P.repeated_grid(X.pair_visits(spark, sf_dir), FOUR, "mfars_total", alphas=(0.01, 0.1, 1.0), l1_ratios=(0.1, 0.5, 0.9)).fits
    return fits.groupBy("alpha", "l1_ratio").agg(F.sum("n").alias("n"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))


@query("cvr_08_grid_summary")
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = X.pair_visits(spark, sf_dir), Config()
    return P.grid_summary(rows, FOUR, "mfars_total", P.repeated_grid(rows, FOUR, "mfars_total", alphas=c.alpha_grid, l1_ratios=c.l1_grid, folds=c.folds, seed=c.seed))


_FENCED = ", r0 as (select subject, f_view x, mfars_total y from pair_visits where f_view is not null and mfars_total is not null), q0 as (select quantile_cont(x, 0.25) a, quantile_cont(x, 0.75) b from r0), rows_ as (select r0.* from r0, q0 where x >= a - 3 * (b - a) and x <= b + 3 * (b - a))"
_GRID = _FENCED + ", k as (select rr.r repeat, oo.o fold, aa.alpha, ll.l1 from (select unnest(range(3)) r) rr, (select unnest(range(5)) o) oo, (values (0.01::double), (0.1::double), (1.0::double)) aa(alpha), (values (0.1::double), (0.9::double)) ll(l1)), f as (select rows_.*, r, ('0x' || substr(md5((42 + r) || '|' || subject), 1, 8))::bigint % 5 o from rows_, (select unnest(range(3)) r)), m as (select k.repeat, k.fold, k.alpha, k.l1, corr(x, y) c from k join f on f.r = k.repeat and f.o <> k.fold where exists (select 1 from f h where h.r = k.repeat and h.o = k.fold) group by all) select cast(repeat as int) repeat, cast(fold as int) fold, alpha, l1 l1_ratio, 'f_view' feature, R(sign(c) * greatest(abs(c) - alpha * l1, 0) / (1 + alpha * (1 - l1))) coef from m"


@query("cvr_08_grid_one_feature", _GRID)
def grid_one_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients by repeat, fold and candidate."""
    found = P.repeated_grid(X.pair_visits(spark, sf_dir), ["f_view"], "mfars_total", alphas=(0.01, 0.1, 1.0), l1_ratios=(0.1, 0.9), repeats=3)
    return P.coefficients(found.fits, ["f_view"])


@query("cvr_08_coefficients")
def grid_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of each fold's chosen candidate."""
    return P.coefficients(P.repeated_grid(X.pair_visits(spark, sf_dir), FOUR, "mfars_total", alphas=(0.01, 0.1, 1.0), l1_ratios=(0.1, 0.5, 0.9)).chosen, FOUR)


@query("imp_04_net_bootstrap")
def net_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Config()
    return P.net_bootstrap(X.pair_visits(spark, sf_dir), FOUR, "mfars_total", replicates=c.bootstrap, alpha=c.alpha, l1_ratio=c.l1_ratio, seed=c.seed)


_NET_BOOT = _FENCED + f", b as (select r, corr(x, y) c from rows_, (select unnest(range(201)) r) where ('0x' || substr(md5('42|' || r || '|' || subject), 1, 8))::bigint < {int((1 - 2.718281828459045 ** -1) * (1 << 32))} group by r), w as (select sign(c) * greatest(abs(c) - 0.1 * 0.5, 0) / (1 + 0.1 * 0.5) w from b) select 'f_view' feature, R(avg(w)) coef_mean, R(quantile_cont(w, 0.025)) coef_p2_5, R(quantile_cont(w, 0.975)) coef_p97_5, R(avg((w <> 0)::int::double)) pct_nonzero from w"


@query("imp_04_net_bootstrap_one", _NET_BOOT)
def net_bootstrap_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.net_bootstrap(X.pair_visits(spark, sf_dir), ["f_view"], "mfars_total", alpha=0.1, l1_ratio=0.5)


@query("cvr_10_composite")
def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of |coefficient| * value over the elastic net of the target on all rows."""
    rows = X.pair_visits(spark, sf_dir).dropna(subset=[*FOUR, "mfars_total"])
    c = Config()
    w, _ = K.elastic_net(gram_matrix(rows, [*FOUR, "mfars_total"])[""], c.alpha, c.l1_ratio)
    total = sum((F.lit(abs(float(v))) * F.col(f) for f, v in zip(FOUR, w)), F.lit(0.0))
    return rows.select("pair_id", "visit", total.alias("composite"))


_LEFT = ", r0 as (select subject, f_view x, mfars_total y from pair_visits where f_view is not null and mfars_total is not null), q as (select quantile_cont(x, 0.25) a, quantile_cont(x, 0.75) b from r0), r as (select r0.* from r0, q where x >= a - 3 * (b - a) and x <= b + 3 * (b - a)), t as (select count(*)::double n, avg(x) cx, avg(y) cy from r), e as (select r.subject, x, y, x - cx u, y - cy v, n, cx, cy from r, t), a as (select count(*)::double n, sum(u) u, sum(v) v, sum(u * u) uu, sum(v * v) vv, sum(u * v) uv from e), o as (select subject, count(*)::double n, sum(u) u, sum(v) v, sum(u * u) uu, sum(v * v) vv, sum(u * v) uv from e group by 1), m as (select o.subject, a.n - o.n n, (a.u - o.u) / (a.n - o.n) mu, (a.v - o.v) / (a.n - o.n) mv, (a.uu - o.uu) / (a.n - o.n) uu, (a.vv - o.vv) / (a.n - o.n) vv, (a.uv - o.uv) / (a.n - o.n) uv from a, o) select e.subject, R(y) target, R(cy + mv + sqrt(vv - mv * mv) * (u - mu) / sqrt(uu - mu * mu) * ((uv - mu * mv) / sqrt(uu - mu * mu) / sqrt(vv - mv * mv)) / 2.3) prediction, cast(1.3 as double) alpha, cast(0 as double) l1_ratio from e join m using (subject)"


@query("cvr_10_leave_one_out", _LEFT)
def composite_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.leave_one_subject_out(X.pair_visits(spark, sf_dir), ["f_view"], "mfars_total")


@query("cvr_10_held_out_search")
def composite_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of least error on each subject itself: an optimistic bound, and labelled so."""
    found = O.leave_one_subject_out(X.pair_visits(spark, sf_dir), FOUR, "mfars_total", alphas=O.ALPHAS, l1_ratios=O.L1_RATIOS, scale_target=False)
    return O.search_summary(found)


_LDA_TWO = _TWO + "v as (select o, avg(x2) - avg(x1) mp, avg(y2) - avg(y1) mq, (var_samp(x1) + var_samp(x2)) / 2 a, (var_samp(y1) + var_samp(y2)) / 2 b, (covar_samp(x1, y1) + covar_samp(x2, y2)) / 2 k from z where fold <> o group by o), s as (select o, mp, mq, k, a + 1e-3::double * (a + b) / 2 vp, b + 1e-3::double * (a + b) / 2 vq from v), w as (select o, (vq * mp - k * mq) / (vp * vq - k * k) wp, (vp * mq - k * mp) / (vp * vq - k * k) wq from s), h as (select o, avg((x2 - x1) * wp + (y2 - y1) * wq) m from z join w using (o) where fold <> o group by o), e as (select right(patient_id, 4) pair, case when m < 0 then -1 else 1 end * ((x2 - x1) * wp + (y2 - y1) * wq) d from z join w using (o) join h using (o) where fold = o) select coalesce(case pair when 'V1V2' then 'V1->V2' when 'V2V3' then 'V2->V3' end, 'both') interval, count(*) n_pairs, R(avg(d) / stddev_samp(d)) d_z from e group by rollup (pair)"


@query("cvr_11_two_features", _LDA_TWO)
def group_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LDA of one group of two features: effects by interval and over both."""
    oof = C.cross_validate(X.pair_visits(spark, sf_dir), _plan("lda", features=("f_view", "f_click"))).scores
    return E.adjacent_effects(oof, pooled="both").select("interval", "n_pairs", "d_z")


@query("cvr_11_group_experiments")
def group_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LDA over feature groups and pair types, as one row each."""
    out = None
    for name, features in (("acts", ("f_click", "f_purchase")), ("all", FOUR)):
        oof = C.cross_validate(X.pair_visits(spark, sf_dir), C.Plan("lda", features)).scores
        part = E.adjacent_effects(oof, pooled="both").select(F.lit(name).alias("feature_group"), F.lit("lda").alias("model"), "interval", "n_pairs", "d_z")
        out = part if out is None else out.unionByName(part)
    return out


# importance

@query("feature_contribution", ", d as (select case pair when 'V1V2' then 'V1->V2' else 'V2->V3' end interval, delta_f_view a, delta_f_click b from pairs), w(feature, weight) as (values ('f_view', 0.5::double), ('f_click', -0.25::double)), u as (select 'f_view' feature, interval, a delta from d union all select 'f_click', interval, b from d), g as (select feature, interval, avg(weight * delta) c from u join w using (feature) where delta is not null group by 1, 2), s as (select feature, max(case when interval = 'V1->V2' then c end) x, max(case when interval = 'V2->V3' then c end) y from g group by 1) select feature, R(x) contribution_v1_v2, R(y) contribution_v2_v3, R(abs(x - y)) gap, R((abs(x) + abs(y)) / 2) mean_abs from s")
def feature_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contributions(_deltas(spark, sf_dir).select("interval", "f_view", "f_click"), {"f_view": 0.5, "f_click": -0.25})


_CONTRIB = _DL + f", u as (select interval, feature, delta from dl unpivot (delta for feature in ({', '.join(X.FEATURES)}))), g as (select feature, interval, avg(delta) c from u group by 1, 2), s as (select feature, max(case when interval = 'V1->V2' then c end) x, max(case when interval = 'V2->V3' then c end) y from g group by 1)"


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contributions(_deltas(spark, sf_dir).select("interval", *X.FEATURES), dict.fromkeys(X.FEATURES, 1.0))


@query("domain_rollup", _CONTRIB + " select case when feature in ('f_click', 'f_purchase') then 'acts' when feature = 'f_view' then 'looks' else 'Unmapped MRI' end \"domain\", count(*) n_features, R(sum(x)) contribution_v1_v2, R(sum(y)) contribution_v2_v3, R(sum((abs(x) + abs(y)) / 2)) mean_abs from s group by 1")
def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = spark.createDataFrame([("f_click", "acts"), ("f_purchase", "acts"), ("f_view", "looks")], "feature string, domain string")
    return M.domain_rollup(_unit(spark, sf_dir), domains)


@query("nb_13_contribution_gaps", _CONTRIB + ", r as (select feature, row_number() over (order by (abs(x) + abs(y)) / 2 desc, feature) a, row_number() over (order by abs(x) - abs(y) desc, feature) b, row_number() over (order by abs(x - y), feature) c from s) select 'strongest' list, feature, cast(a as int) place from r where a <= 2 union all select 'weakened', feature, cast(b as int) from r where b <= 2 union all select 'stable', feature, cast(c as int) from r where c <= 2")
def contribution_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _unit(spark, sf_dir)
    orders = (("strongest", F.col("mean_abs").desc()), ("weakened", (F.abs("contribution_v1_v2") - F.abs("contribution_v2_v3")).desc()), ("stable", F.col("gap").asc()))
    parts = [place(t, [o, "feature"]).where("place <= 2").select(F.lit(n).alias("list"), "feature", "place") for n, o in orders]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("imp_06_linear_shap", ", m as (select avg(f_view) a, avg(f_click) b from visits) select subject_id, visit, 'f_view' feature, R(2 * (f_view - a)) shap from visits, m union all select subject_id, visit, 'f_click', R(-1 * (f_click - b)) from visits, m")
def linear_shap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.linear_shap(X.visits(spark, sf_dir), {"f_view": 2.0, "f_click": -1.0}, ["subject_id", "visit"])


@query("imp_01_locked_srm")
def locked_srm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(M.locked_srm(_deltas(spark, sf_dir), FOUR).items()), "feature string, weight double")


_LOCKED = "d as (select pair, {who} who, delta_f_view a, delta_f_click b from pairs where delta_f_view is not null and delta_f_click is not null), s as (select avg(a) ma, avg(b) mb, var_samp(a) + 1e-6::double va, var_samp(b) + 1e-6::double vb, covar_samp(a, b) c from d where {where}), w as (select (vb * ma - c * mb) / (va * vb - c * c) wa, (va * mb - c * ma) / (va * vb - c * c) wb from s)"


@query("imp_01_locked_two", ", " + _LOCKED.format(who="0", where="true") + " select subject_id, visit, R(f_view * wa + f_click * wb) score from visits, w where f_view is not null and f_click is not null")
def locked_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visit by the weights of all pairs."""
    w = M.locked_srm(_deltas(spark, sf_dir), ["f_view", "f_click"])
    v = X.visits(spark, sf_dir).dropna(subset=list(w))
    return v.select("subject_id", "visit", sum((F.lit(x) * F.col(f) for f, x in w.items()), F.lit(0.0)).alias("score"))


@query("srm_coef_bootstrap")
def srm_coef_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.stability import coefficient_summary

    return coefficient_summary(M.bootstrap_coefficients(_deltas(spark, sf_dir), FOUR, replicates=200))


@query("lofo")
def lofo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.leave_one_feature_out(X.pair_visits(spark, sf_dir), FOUR)


_LOFO = ", o as (select unnest(range(5)) o), c as (select *, ('0x' || substr(md5('42|' || subject_id), 1, 8))::bigint % 5 fold, f_view_baseline x1, f_view_followup x2, f_error_baseline y1, f_error_followup y2 from pairs)" + """,
both_ as (select o, avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy from (select o, x1 x, y1 y from c, o where fold <> o and x1 is not null and x2 is not null and y1 is not null and y2 is not null union all select o, x2, y2 from c, o where fold <> o and x1 is not null and x2 is not null and y1 is not null and y2 is not null) group by o),
z as (select b.o, c.fold, c.pair, (x2 - x1) / sx p, (y2 - y1) / sy q from c, both_ b where x1 is not null and x2 is not null and y1 is not null and y2 is not null),
s as (select o, avg(p) mp, avg(q) mq, var_samp(p) + 1e-6::double vp, var_samp(q) + 1e-6::double vq, covar_samp(p, q) k from z where fold <> o group by o),
w as (select o, (vq * mp - k * mq) / (vp * vq - k * k) wp, (vp * mq - k * mp) / (vp * vq - k * k) wq from s),
one as (select feature, o, fold, pair, a, b from (select 'f_error' feature, fold, pair, x1 a, x2 b from c union all select 'f_view', fold, pair, y1, y2 from c), o where a is not null and b is not null),
m as (select feature, o, stddev_pop(v) sd from (select feature, o, a v from one where fold <> o union all select feature, o, b from one where fold <> o) group by 1, 2),
u as (select feature, o, avg((b - a) / sd) / (var_samp((b - a) / sd) + 1e-6::double) / any_value(sd) w from one join m using (feature, o) where fold <> o group by 1, 2),
e as (select '' feature, pair, p * wp + q * wq d from z join w using (o) where fold = o union all select feature, pair, (b - a) * w from one join u using (feature, o) where fold = o),
g as (select feature, pair, avg(d) / stddev_samp(d) d from e group by 1, 2),
r as (select feature, max(case when pair = 'V1V2' then d end) x, max(case when pair = 'V2V3' then d end) y from g group by 1)
select r.feature, R(r.x) dz_v1_v2, R(r.y) dz_v2_v3, R((r.x + r.y) / 2) annual_mean_dz, R((t.x + t.y) / 2 - (r.x + r.y) / 2) performance_loss from r, r t where r.feature <> '' and t.feature = ''"""


@query("imp_03_lofo_two_features", _LOFO)
def lofo_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.leave_one_feature_out(X.pair_visits(spark, sf_dir), ["f_view", "f_error"])


def _controls(spark: SparkSession, sf_dir: str, features: tuple[str, ...]) -> DataFrame:
    from tideline.operators.preprocess import ColumnScaler

    v = X.visits(spark, sf_dir).dropna(subset=list(features))
    scaler = ColumnScaler(features).fit(v.where("study_group = 0"))
    w = M.locked_srm(_deltas(spark, sf_dir).where("subject not like '%0'"), features)
    score = sum((F.lit(x) * F.col(f) for f, x in w.items()), F.lit(0.0))
    return scaler.transform(v.where("study_group = 1")).select("subject_id", "visit", score.alias("score"))


@query("nb_05_locked_control_scoring")
def locked_control_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of controls by a model fitted on patients, standardised by patients' means."""
    return _controls(spark, sf_dir, FOUR)


@query("nb_05_locked_control_two", ", " + _LOCKED.format(who="subject_id", where="who not like '%0'") + ", p as (select avg(f_view) ma, stddev_pop(f_view) sa, avg(f_click) mb, stddev_pop(f_click) sb from visits where study_group = 0 and f_view is not null and f_click is not null) select subject_id, visit, R((f_view - ma) / sa * wa + (f_click - mb) / sb * wb) score from visits, w, p where study_group = 1 and f_view is not null and f_click is not null")
def locked_control_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir, ("f_view", "f_click"))
