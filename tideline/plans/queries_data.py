"""Queries on names, filters, joins, audits, folds and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import ids as I
from tideline.functions import names as N
from tideline.operators import audit as A
from tideline.operators import events as V
from tideline.operators import filters as L
from tideline.operators import preprocess as P
from tideline.operators import ranking as K
from tideline.operators import resample as R
from tideline.operators import stability as T
from tideline.operators import reshape as S
from tideline.plans import fixtures as X
from tideline.operators.lineage import kept
from tideline.plans.registry import query
from tideline.sources import readers, sinks

NUM = (*X.FEATURES, *X.CLINICAL)
#: How an order's numbers n (of its customer) and w (its own last digit) are written, one way for every last two digits of its key in turn.
MESSY = ("' >' || n", "'0' || n", "''", "'nan'", "n || 'a'", "n || 'd'", "'STU-DY_X' || n", "'study_ab' || n", "'MEL' || lpad(n, 4, '0')", "' v' || w || ' '", "w || '.0'", "n", "'V' || w", "o_orderpriority", "null")
_MESSY_CASE = "case k % " + str(len(MESSY)) + " " + " ".join(f"when {k} then {t}" for k, t in enumerate(MESSY)) + " end"
_MESSY_SQL = f"(select k, {_MESSY_CASE} t from (select o_orderkey k, cast(o_custkey % 1000 as varchar) n, cast(o_orderkey % 10 as varchar) w, o_orderpriority from orders)) m"


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that ids and lenient numbers have to cope with, one an order."""
    o = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 1000).cast("string").alias("n"), (F.col("o_orderkey") % 10).cast("string").alias("w"), "o_orderpriority")
    return o.select("k", F.expr(_MESSY_CASE).cast("string").alias("t"))


# strings and ids

@query("std_col_name", "select distinct trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') name from part", fixtures=False)
def std_col_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "part").select(I.std_name(F.col("p_name")).alias("name")).distinct()


@query("id_translate", "select user_id, 'sub-campac' || case when user_id < 10 then '0' else '' end || user_id campac, 'pac' || case when user_id < 10 then '0' else '' end || user_id pac, 'sub-x' || cast(user_id as varchar) sub, 'ses-' || cast(1 + user_id % 3 as varchar) ses, user_id % 3 = 2 third, case when user_id < 100 then 'sub-melfrd' || lpad(cast(user_id as varchar), 3, '0') end melfrd from (select distinct user_id from events)", fixtures=False)
def id_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.table(spark, sf_dir, "events").select("user_id").distinct()
    sub = F.concat(F.lit("sub-campac"), F.col("user_id").cast("string"))
    name = F.concat(F.lit("x/sub-x"), F.col("user_id").cast("string"), F.lit("_ses-"), (1 + F.col("user_id") % 3).cast("string"), F.lit("_T1.nii"))
    one, two = I.bids_parts(name)
    return u.select("user_id", I.pac_to_campac(I.campac_to_pac(sub)).alias("campac"), I.campac_to_pac(sub).alias("pac"), one.alias("sub"), two.alias("ses"), I.third_session(name).alias("third"), I.clinical_to_bids((F.lit(54) + F.col("user_id") / 100).cast("decimal(6,2)").cast("string")).alias("melfrd"))


@query("str_05_participant_id", f"select k, case when t is null or trim(t) = '' then null when upper(trim(t)) like 'STUDY\\_%' escape '\\' or upper(trim(t)) like 'STU-DY\\_%' escape '\\' then replace(trim(t), 'STU-DY_', 'STUDY_') when regexp_full_match(trim(t), '[A-Z]{{2,6}}[0-9]{{2,6}}') then 'STUDY_' || trim(t) else trim(t) end id from {_MESSY_SQL}", fixtures=False)
def participant_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir).select("k", I.participant(F.col("t"), "STUDY_", "STU-DY_").alias("id"))


@query("str_06_pair_subject", "select patient_id, split_part(patient_id, '_', 1) subject from pairs")
def pair_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pairs(spark, sf_dir).select("patient_id", I.pair_subject(F.col("patient_id")).alias("subject"))


@query("coerce_numeric_text", f"select k, R(case when regexp_full_match(trim(replace(trim(t), '>', '')), '[+-]?[0-9]+([.][0-9]+)?') then try_cast(trim(replace(trim(t), '>', '')) as double) else try_cast(nullif(regexp_extract(t, '([0-9]+([.][0-9]+)?)', 1), '') as double) end) v from {_MESSY_SQL}", fixtures=False)
def coerce_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir).select("k", I.repeat_length(F.col("t")).alias("v"))


@query("visit_label", f"select k, case when t is null then '' when upper(trim(t)) like 'V%' then upper(trim(t)) when regexp_full_match(trim(t), '[+-]?[0-9]+([.][0-9]+)?') then 'V' || cast(cast(trunc(cast(trim(t) as double)) as int) as varchar) else t end label, t is null or trim(t) = '' missing from {_MESSY_SQL}", fixtures=False)
def visit_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir).select("k", I.visit_label(F.col("t")).alias("label"), I.missing(F.col("t")).alias("missing"))


@query("str_12_pair_interval", "select patient_id, case pair when 'V1V2' then 'V1->V2' when 'V2V3' then 'V2->V3' end interval from pairs")
def pair_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.effects import pair_interval as interval

    return X.pairs(spark, sf_dir).select("patient_id", interval(F.col("patient_id")).alias("interval"))


_EVENT = "case event_type when 'signup' then 'enrolment_arm_1' when 'view' then 'study_visit_1_arm_1' when 'click' then 'visit2 extra' when 'purchase' then 'STUDY VISIT_3' else event_type end"


@query("str_13_event_rank", "select event_type, cast(case event_type when 'signup' then 0 when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 999 end as int) rank from (select distinct event_type from events)", fixtures=False)
def event_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("event_type").distinct()
    return e.select("event_type", I.event_rank(F.expr(_EVENT)).alias("rank"))


_MEASURES = ("'FA_SCP_' || n", "'MD_body_' || n", "'SCP_vol'", "'csa_c1c2'", "'eTIV'", "'sFA_c3c5'", "'dentate_qsm_' || n", "'thalamus'", "'Cereb_vol'", "'Suscept_' || n", "'x_FA_' || n")
_MEASURED = f"case p_partkey % {len(_MEASURES)} " + " ".join(f"when {k} then {m}" for k, m in enumerate(_MEASURES)) + " end"


@query("str_15_feature_domain", f"with f as (select p_partkey, {_MEASURED} feature from (select p_partkey, cast(p_size as varchar) n from part)) select p_partkey, feature, case when feature = 'SCP_vol' then 'SCP morphometry' when feature = 'csa_c1c2' then 'Spinal cord structural' when feature in ('Cereb_vol', 'eTIV') then 'Brain morphometry' when feature = 'sFA_c3c5' then 'Spinal cord diffusion' when feature like 'FA\\_SCP%' escape '\\' then 'SCP diffusion' when feature like 'MD\\_%' escape '\\' then 'Brain DTI' when feature like 'dentate%' or feature like 'Suscept%' then 'Dentate/QSM or deep grey matter' when feature = 'thalamus' then 'Other MRI' else 'Unmapped MRI' end \"domain\" from f", fixtures=False)
def feature_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain of a name made from every part."""
    f = X.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("n")).select("p_partkey", F.expr(_MEASURED).alias("feature"))
    return f.select("p_partkey", "feature", N.feature_domain(F.col("feature"), listed=("thalamus",)).alias("domain"))


_TEXT_SOURCE = "select 'delta_mfars_total' measure, patient_id, delta_mfars_total delta from pairs"


@query("str_16_effect_text", lambda: ", " + _boot_sql(_TEXT_SOURCE, "measure", "patient_id", 200) + " select bk measure, case when n < 2 then 'not available' else format('{:.2f} [{:.2f}, {:.2f}]; P={:.2f}', d, low, high, p) end \"text\" from bc, (select count(delta_mfars_total) n, avg(delta_mfars_total) / nullif(stddev_samp(delta_mfars_total), 0) d, avg(cast(case when delta_mfars_total > 0 then 1 else 0 end as double)) p from pairs)")
def effect_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.effects import cohens_dz, probability_positive

    rows = X.pairs(spark, sf_dir).select(F.lit("delta_mfars_total").alias("measure"), "patient_id", F.col("delta_mfars_total").alias("delta"))
    d = rows.groupBy("measure").agg(cohens_dz(F.col("delta")).alias("d"), probability_positive(F.col("delta")).alias("p"))
    return d.join(R.bootstrap_effects(rows, ["measure"], "patient_id"), "measure").select("measure", I.effect_text(F.col("d"), F.col("d_z_ci_low"), F.col("d_z_ci_high"), F.col("p")).alias("text"))


@query("str_11_json_details", "select subject_id, '{\"adl_total\":' || cast(cast(adl_total as int) as varchar) || ',\"visit\":' || cast(visit as varchar) || '}' details from visits")
def json_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.visits(spark, sf_dir).select("subject_id", F.to_json(F.struct(F.col("adl_total").cast("int").alias("adl_total"), "visit")).alias("details"))


# filters

#: Labels by the last digit of a subject: spellings of a control, what is none, and patients.
_LABELS = ("1", " HC ", "healthy-control", "1.0", "Healthy Controls", "patient", None, "controls", "UNAFFECTED", "hc2")
_LABELLED = "([" + ", ".join("null" if x is None else f"'{x}'" for x in _LABELS) + "])[1 + cast(right(subject_id, 1) as int)]"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in _LABELS])
    return X.visits(spark, sf_dir).withColumn("diagnosis", F.get(labels, F.substring("subject_id", -1, 1).cast("int")))


_PATIENTS = f"study_group <> 1 and coalesce(replace(lower(trim({_LABELLED})), '-', '_') not in ('1', 'control', 'controls', 'healthy_control', 'healthy controls', 'healthy control', 'hc', 'unaffected'), true)"


@query("control_filter", f"select subject_id, visit from visits where {_PATIENTS}")
def control_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_controls(_labelled(spark, sf_dir)).select("subject_id", "visit")


@query("flt_05_training_guard", f"select count(*) n from visits where {_PATIENTS}")
def training_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.drop_controls(_labelled(spark, sf_dir))
    L.require_training_frame(rows, X.FEATURES, "mfars_total", allow_clinical_target=True)
    return rows.agg(F.count("*").alias("n"))


@query("flt_01_projection", "select subject_id, visit, R(mfars_total) mfars_total from visits")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.project(X.visits(spark, sf_dir), ("mfars_total", "subject_id", "visit", "absent"))


@query("flt_02_drop_by_name", "select subject_id, visit, site, study_group, R(mfars_total) mfars_total, R(sara_total) sara_total, R(adl_total) adl_total from visits")
def drop_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drop_by_name(X.visits(spark, sf_dir), ["time_years"], ["f_"], ["click", "error", "purchase", "signup", "view"])


@query("flt_03_sheet_duplicates", "select subject_id, R(f_view) f_view from visits")
def sheet_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.visits(spark, sf_dir).select("subject_id", "f_view", F.col("f_view").alias("f_view_sheet"), F.col("site").alias("Protocol"))
    return L.drop_duplicate_sheet_columns(d, "_sheet", ["Protocol"])


_FENCE = lambda c: f"coalesce({c} < q.{c}1 - 3 * (q.{c}3 - q.{c}1) or {c} > q.{c}3 + 3 * (q.{c}3 - q.{c}1), false)"
_Q = ", ".join(f"quantile_cont({c}, 0.25) {c}1, quantile_cont({c}, 0.75) {c}3" for c in NUM)


@query("tukey_filter", f", q as (select {_Q} from visits) select v.subject_id, v.visit, {' or '.join(_FENCE(c) for c in NUM)} outlier from visits v, q")
def tukey_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.tukey_rows(X.visits(spark, sf_dir), NUM).select("subject_id", "visit", "outlier")


_ALL = " and ".join(f"{c} is not null" for c in NUM)


@query("complete_pairs", f", c as (select * from pair_visits where {_ALL}) select pair_id, visit from c where pair_id in (select pair_id from c group by pair_id having count(distinct visit) = 2)")
def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.complete_cases(X.pair_visits(spark, sf_dir), NUM, "pair_id").select("pair_id", "visit")


@query("flt_08_eligible_interval", "select pair_id, visit from pair_visits where f_view is not null and pair_id in (select pair_id from pair_visits where f_view is not null group by pair_id having count(distinct visit) = 2)")
def eligible_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_visits(X.pair_visits(spark, sf_dir), ["f_view"], "pair_id").select("pair_id", "visit")


@query("flt_09_resampled_subjects", ", g as (select subject, row_number() over (order by md5(subject), subject) - 1 i, count(*) over () n from (select distinct subject from pair_visits)), d as (select distinct b.b replicate, cast(('0x' || substr(md5('42|' || cast(b.b * g.n + g.i as varchar)), 1, 8))::bigint % g.n as int) i from g, (select unnest(range(3)) b) b) select cast(d.replicate as int) replicate, p.pair_id, p.visit from d join g on d.i = g.i join pair_visits p on p.subject = g.subject")
def resampled_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.pair_visits(spark, sf_dir)
    return R.bootstrap_members(p, "subject", 3).drop("times").join(p, "subject").select("replicate", "pair_id", "visit")


@query("flt_12_feature_groups")
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = N.feature_groups(X.pairs(spark, sf_dir).columns, ["site"], ["f_view", "f_click"])
    return spark.createDataFrame([("poms", list(g.poms)), ("dti", list(g.dti)), ("other", list(g.other)), ("imaging", g.imaging())], "grp string, features array<string>")


_GROUP_COUNTS = "select case when feature in ('f_view', 'f_click') then 'poms' when regexp_matches(feature, '^(FA|MD|RD|AD)_') then 'dti' else 'other' end grp, feature, n_values from (select substr(name, 7) feature, count(v) n_values from (unpivot (select columns('^delta_') from pairs) on columns(*) into name name value v) group by 1) where feature not in ('mfars_total', 'sara_total', 'adl_total')"


@query("flt_12_group_counts", _GROUP_COUNTS)
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each imaging feature with its role and the pairs that have its change."""
    p = X.pairs(spark, sf_dir)
    g = N.feature_groups(p.columns, ["site"], ["f_view", "f_click"])
    role = {f: r for r, names in (("other", g.other), ("dti", g.dti), ("poms", g.poms)) for f in names}
    counts = p.agg(*[F.count(f"delta_{f}").alias(f) for f in role]).unpivot([], list(role), "feature", "n_values")
    # a literal map of the groups' names
    named = F.create_map(*[F.lit(x) for pair in role.items() for x in pair])
    return counts.select(named[F.col("feature")].alias("grp"), "feature", "n_values")


# joins and events

@query("event_collapse_mode", ", t as (select subject_id, event_type, cast(visit as varchar) v, dayname(ts) d, case event_type when 'signup' then 0 when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 999 end r from ev), u as (select subject_id, 'visit' c, v val, count(*) n, min(r) f from t group by all union all select subject_id, 'day', d, count(*), min(r) from t group by all), b as (select subject_id, c, arg_max(val, (n, -f, val)) val from u group by all) select subject_id, max(case when c = 'visit' then val end) visit, max(case when c = 'day' then val end) \"day\" from b group by subject_id")
def event_collapse_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.visit_events(spark, sf_dir).select("subject_id", F.expr(_EVENT).alias("event"), F.col("visit").cast("string").alias("visit"), F.date_format("ts", "EEEE").alias("day"))
    return V.collapse_events(e, "subject_id", I.event_rank(F.col("event")), ["visit", "day"])


@query("agg_01_collapse_conflicts", "select subject_id, 'visit' \"column\", count(distinct visit) n_values, count(*) n_rows from ev group by subject_id having count(distinct visit) > 1")
def collapse_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.collapse_conflicts(X.visit_events(spark, sf_dir), "subject_id", ["visit"])


@query("sheet_full_outer_merge", ", a as (select subject_id SubjectID, visit, f_click x from visits where visit < 3), b as (select case when visit = 2 then subject_id end SubjectID, visit, max(f_view) x, max(f_view) y from visits where visit > 1 group by all) select coalesce(a.SubjectID, b.SubjectID) SubjectID, coalesce(a.visit, b.visit) visit, R(a.x) x, R(b.x) x_two, R(b.y) y from a full join b on a.SubjectID is not distinct from b.SubjectID and a.visit is not distinct from b.visit")
def sheet_full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir)
    a = v.where("visit < 3").select(F.col("subject_id").alias("SubjectID"), "visit", F.col("f_click").alias("x"))
    b = v.where("visit > 1").groupBy(F.when(F.col("visit") == 2, F.col("subject_id")).alias("SubjectID"), "visit").agg(F.max("f_view").alias("x"), F.max("f_view").alias("y"))
    return V.merge_sheets({"one": a, "two": b}, ["SubjectID", "visit"])


@query("source_presence_outer", ", a as (select distinct subject_id, visit from visits where f_click is not null), b as (select distinct subject_id, visit from visits where f_error is not null) select coalesce(a.visit, b.visit) visit, case when b.subject_id is null then 'left_only' when a.subject_id is null then 'right_only' else 'both' end presence, count(*) n from a full join b using (subject_id, visit) group by 1, 2")
def source_presence_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir)
    return V.source_presence(v.where("f_click is not null"), v.where("f_error is not null"), ["subject_id", "visit"]).groupBy("visit", "presence").agg(F.count("*").alias("n"))


_SOURCES = ", c as (select subject_id, visit, mfars_total, sara_total from visits where f_click is not null), i as (select subject_id, visit, f_error, f_view, f_signup from visits where f_error > 30), b as (select coalesce(c.subject_id, i.subject_id) subject_id, coalesce(c.visit, i.visit) visit, mfars_total, sara_total, f_error, f_view, f_signup from c full join i on c.subject_id = i.subject_id and c.visit = i.visit)"
_BLOCKS = {"clinical_raw": ("mfars_total", "sara_total"), "imaging_raw": ("f_error", "f_view", "f_signup")}
_BLOCK_ROWS = " union all ".join(f"select visit, '{c}' \"column\", '{b}' source_block, {c} is null lacks from b" for b, own in _BLOCKS.items() for c in own)


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    v = X.visits(spark, sf_dir)
    clinical = v.where("f_click is not null").select("subject_id", "visit", *_BLOCKS["clinical_raw"])
    imaging = v.where("f_error > 30").select("subject_id", "visit", *_BLOCKS["imaging_raw"])
    return {"clinical": clinical, "imaging": imaging, "joined": clinical.join(imaging, ["subject_id", "visit"], "full")}


@query("jon_02_block_missingness", _SOURCES + f", l as ({_BLOCK_ROWS}) select visit, visit is null over_all, \"column\", source_block, count(*) n, R(avg(lacks::int::double)) missing_pct from l group by grouping sets ((\"column\", source_block), (\"column\", source_block, visit))")
def block_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.block_missingness(_sources(spark, sf_dir)["joined"], _BLOCKS)


@query("jon_02_block_summary", _SOURCES + f", l as ({_BLOCK_ROWS}), m as (select \"column\", source_block, avg(lacks::int::double) p from l group by 1, 2) select source_block, count(*) n_columns, R(avg(p)) mean_missing_pct, R(max(p)) max_missing_pct from m group by 1")
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.block_summary(A.block_missingness(_sources(spark, sf_dir)["joined"], _BLOCKS))


@query("jon_02_source_summary", _SOURCES + " select 'clinical' source, count(*) n_rows, cast(4 as bigint) n_columns, count(distinct subject_id) n_subjects from c union all select 'imaging', count(*), 5, count(distinct subject_id) from i union all select 'joined', count(*), 7, count(distinct subject_id) from b")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.source_summary(_sources(spark, sf_dir), "subject_id")


@query("dedup_max_nonnull", ", d as (select subject_id, visit, f_click, f_error, cast((f_click is not null)::int + (f_error is not null)::int as int) n_known from visits) select subject_id, R(f_click) f_click, R(f_error) f_error, n_known, visit from d qualify row_number() over (partition by subject_id order by n_known desc, visit) = 1")
def dedup_max_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select("subject_id", "visit", "f_click", "f_error")
    return V.fullest_row(v, ["subject_id"], ["f_click", "f_error"], ["visit"])


@query("fill_if_null", ", m as (select subject_id, avg(f_error) err from visits group by subject_id) select v.subject_id, v.visit, R(coalesce(v.f_error, case when v.visit = 2 then m.err end)) f_error from visits v left join m using (subject_id)")
def fill_if_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir)
    lookup = v.groupBy("subject_id").agg(F.avg("f_error").alias("err"))
    return V.fill_if_null(v.select("subject_id", "visit", "f_error"), lookup, "subject_id", {"f_error": "err"}, F.col("visit") == 2)


@query("src_05_bilateral_means", "select subject_id, visit, R((f_click + f_view) / 2) scp from visits")
def bilateral_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select("subject_id", "visit", F.col("f_click").alias("rscp"), F.col("f_view").alias("lscp"))
    return readers.with_bilateral_means(v, ["scp"]).select("subject_id", "visit", "scp")


@query("src_01_scan_events", "select count(*) n, count(distinct user_id) users from events", fixtures=False)
def scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, f"{sf_dir}/events.parquet").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("src_02_choose_sheet", "select 'customer' sheet", fixtures=False)
def choose_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = readers.read_sheets(spark, {n: f"{sf_dir}/{n}.parquet" for n in ("nation", "customer")})
    return spark.createDataFrame([(readers.choose_sheet(sheets, ["Customer#"], names=("c_name",)),)], "sheet string")


@query("flt_13_combinations", "with recursive g as (select r_regionkey k, r_name, string_agg(n_name, ',' order by n_nationkey) members from region join nation on n_regionkey = r_regionkey group by 1, 2), c as (select k, r_name combination, members features from g union all select g.k, combination || '+' || r_name, features || ',' || members from c join g on g.k > c.k) select combination, features from c", fixtures=False)
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of every combination of regions."""
    n = X.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("members"))
    groups = X.table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).orderBy("r_regionkey").collect()
    found = N.combinations_of({r["r_name"]: r["members"] for r in groups})
    return spark.createDataFrame([(k, ",".join(v)) for k, v in found.items()], "combination string, features string")


_QC_NULLS = " + ".join(f"({c} is null)::int" for c in X.FEATURES)


@query("agg_09_qc_visits", f"select 'rows' metric, '' \"key\", count(*)::double \"value\" from visits union all select 'subjects', '', count(distinct subject_id) from visits union all select 'visit', visit::varchar, count(*) from visits group by visit union all select 'missing', 'clinical', R(avg({' + '.join(f'({c} is null)::int' for c in X.CLINICAL)}) / {len(X.CLINICAL)}) from visits union all select 'missing', 'imaging', R(avg({_QC_NULLS}) / {len(X.FEATURES)}) from visits")
def qc_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.visit_quality(X.visits(spark, sf_dir), {"clinical": X.CLINICAL, "imaging": X.FEATURES})


@query("agg_09_qc_pairs", "select 'rows' metric, '' \"key\", count(*)::double \"value\" from pairs union all select 'pair', pair, count(*) from pairs group by pair union all select case when n = 2 then 'subjects with both' else 'subjects with one' end, '', count(*) from (select subject_id, count(distinct pair) n from pairs group by 1) group by 1")
def qc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pair_quality(X.pairs(spark, sf_dir))


def _workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook made of the tables, with two lines over each header row, so that it has to be read as one."""
    from tideline.sources import workbook as W

    v = X.visits(spark, sf_dir)
    sheets = {
        "Notes": X.table(spark, sf_dir, "nation").select("n_name"),
        "Morph": v.where("f_view is not null").select(F.concat(F.lit("TRACK-FA_"), "subject_id").alias("SubjectID"), F.col("visit").alias("Visit"), "f_view", "f_click"),
        "DTI": v.where("f_error is not null").select(F.concat(F.lit("TRACK-FA_"), "subject_id").alias("SubjectID"), F.col("visit").alias("Visit"), "f_error"),
    }
    return kept(W.workbook_bytes(sheets, {"Morph": ("SubjectID", "Visit"), "DTI": ("SubjectID", "Visit"), "Notes": ("n_name",)}, above=("exported", "")))


@query("src_02_workbook_sheet", "select 'TRACK-FA_' || subject_id SubjectID, visit::varchar Visit, R(f_view) f_view, R(f_click) f_click, 'Morph' sheet from visits where f_view is not null")
def workbook_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of a workbook that holds the study's ids, header on the third row."""
    from tideline.sources import workbook as W

    sheets = W.read_workbook(_workbook(spark, sf_dir), header=3)
    name = readers.choose_sheet(sheets, ["TRACKFA_", "TRACK-FA_"])
    return sheets[name].select("SubjectID", "Visit", F.col("f_view").cast("double").alias("f_view"), F.col("f_click").cast("double").alias("f_click"), F.lit(name).alias("sheet"))


@query("src_03_workbook_merge", "select coalesce(a.subject_id, b.subject_id) subject_id, coalesce(a.visit, b.visit)::varchar visit, R(a.f_view) f_view, R(b.f_error) f_error from (select * from visits where f_view is not null) a full join (select * from visits where f_error is not null) b on a.subject_id = b.subject_id and a.visit = b.visit")
def workbook_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sheets of a workbook, fully outer joined on their keys."""
    from tideline.sources import workbook as W

    s = W.read_workbook(_workbook(spark, sf_dir), header=3, sheets=("Morph", "DTI"))
    both = s["Morph"].select("SubjectID", "Visit", "f_view").join(s["DTI"], ["SubjectID", "Visit"], "full")
    return both.select(F.regexp_replace("SubjectID", "^TRACK-FA_", "").alias("subject_id"), F.col("Visit").alias("visit"), F.col("f_view").cast("double").alias("f_view"), F.col("f_error").cast("double").alias("f_error"))


@query("src_04_sheet_features")
def sheet_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in readers.sheet_features(X.visits(spark, sf_dir), ("subject_id", "visit", "site"))], "feature string")


_SHEET_COUNTS = "select name feature, count(v) n_values from (unpivot (select columns(* exclude (subject_id, visit, site))::varchar from visits) on columns(*) into name name value v) group by 1"


@query("src_04_sheet_counts", _SHEET_COUNTS)
def sheet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature column of a sheet with its values that are there."""
    v = X.visits(spark, sf_dir)
    features = readers.sheet_features(v, ("subject_id", "visit", "site"))
    return v.agg(*[F.count(c).alias(c) for c in features]).unpivot([], features, "feature", "n_values")


@query("snk_01_split_cohorts", "select case when subject_id like '%0' then 'controls' else 'patients' end cohort, count(*) n from visits group by 1")
def split_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sinks.split_cohorts(X.visits(spark, sf_dir), "subject_id", {"controls": "0$", "patients": "[1-9]$"})
    frames = [df.select(F.lit(name).alias("cohort")) for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).groupBy("cohort").agg(F.count("*").alias("n"))


# audits

_PAT = ", p as (select subject_id, cast(max((visit = 1)::int) as varchar) || cast(max((visit = 2)::int) as varchar) || cast(max((visit = 3)::int) as varchar) pattern from visits group by subject_id)"


@query("visit_pattern_counts", _PAT + " select k.pattern, k.meaning, count(p.subject_id) n_subjects, R(100.0::double * count(p.subject_id) / (select count(*) from p)) percent_subjects from (values " + ", ".join(f"('{a}', '{b}')" for a, b in A.PATTERNS) + ") k(pattern, meaning) left join p using (pattern) group by 1, 2 having k.pattern <> '000' or count(p.subject_id) > 0")
def visit_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pattern_counts(X.visits(spark, sf_dir))


@query("population_counts", _PAT + " select 'all' population, count(*) n_subjects from p union all select 'V1->V2', count(*) from p where pattern like '11_' union all select 'V2->V3', count(*) from p where pattern like '_11' union all select 'V1->V3', count(*) from p where pattern like '1_1' union all select 'complete', count(*) from p where pattern = '111'")
def population_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.population_counts(X.visits(spark, sf_dir))


@query("pair_count_table", ", s as (select subject_id, max((pair = 'V1V2')::int) a, max((pair = 'V2V3')::int) b from pairs group by 1) select 'V1->V2' interval, cast(sum(a) as bigint) n from s union all select 'V2->V3', cast(sum(b) as bigint) from s union all select 'V1->V3', cast(sum(a * b) as bigint) from s union all select 'pooled_annual', cast(sum(a + b) as bigint) from s")
def pair_count_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pair_counts(X.pairs(spark, sf_dir))


_U = f", u as (select visit, site, feature, value from (select visit, site, {', '.join(X.FEATURES)} from visits) unpivot include nulls (value for feature in ({', '.join(X.FEATURES)})))"


@query("missingness_grouping_sets", _U + " select feature, visit, site, count(*) n, R(avg(cast(case when value is null then 1 else 0 end as double))) missing, case when grouping(visit) = 1 and grouping(site) = 1 then 'global' when grouping(visit) = 1 then 'site' when grouping(site) = 1 then 'visit' else 'visit_site' end \"level\" from u group by grouping sets ((feature), (feature, visit), (feature, site), (feature, visit, site))")
def missingness_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missingness(X.visits(spark, sf_dir), X.FEATURES)


@query("missingness_flags", _U + ", m as (select feature, case when grouping(visit) = 1 then 'site' when grouping(site) = 1 then 'visit' else 'visit_site' end \"level\", avg(cast(case when value is null then 1 else 0 end as double)) x from u group by grouping sets ((feature, visit), (feature, site), (feature, visit, site))) select feature, \"level\", R(max(x) - min(x)) spread, max(x) - min(x) >= 0.25 concentrated from m group by all")
def missingness_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missingness_flags(X.visits(spark, sf_dir), X.FEATURES)


_GROUPS = [f"V{v}|site_{s}" for v in (1, 2, 3) for s in range(6)]


@query("missingness_matrix_pivot", _U + " select feature, " + ", ".join(f"cast(sum(case when 'V' || visit || '|' || site = '{g}' then (value is null)::int end) as bigint) \"{g}\"" for g in _GROUPS) + " from u group by feature")
def missingness_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.missingness_matrix(X.visits(spark, sf_dir), X.FEATURES, _GROUPS)


@query("agg_06_followup_logistic")
def followup_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge logistic model of a follow-up visit from baseline values: coefficients on the standard scale, n and training accuracy."""
    # a third visit counts if it has errors, as hardly any subject lacks one
    fit = A.followup_model(X.visits(spark, sf_dir).where("visit < 3 or f_error > 50"), X.CLINICAL)
    return spark.createDataFrame([(v, w, fit.intercept, fit.n, fit.accuracy) for v, w in fit.weights.items()] if fit else [], "variable string, weight double, intercept double, n long, accuracy double")


@query("followup_missingness", f", f as (select distinct subject_id from visits where visit = 3), b as (select v.*, f.subject_id is not null has_followup from visits v left join f using (subject_id) where visit = 1), u as (select has_followup, variable, value from (select has_followup, {', '.join(X.CLINICAL)} from b) unpivot include nulls (value for variable in ({', '.join(X.CLINICAL)}))) select variable, has_followup, count(value) n, cast(sum((value is null)::int) as bigint) n_missing, R(avg(value)) mean, R(stddev_samp(value)) sd from u group by 1, 2")
def followup_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.followup_numeric(X.visits(spark, sf_dir), X.CLINICAL)


@query("agg_07_null_counts", " union all ".join(f"select '{c}' \"column\", cast(sum(({c} is null)::int) as bigint) n_missing from visits" for c in NUM))
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.null_counts(X.visits(spark, sf_dir), NUM)


@query("coverage_flags", " union all ".join(f"select '{c}' feature, R(avg(cast(case when {c} is not null then 1 else 0 end as double))) coverage, 1 - avg(cast(case when {c} is not null then 1 else 0 end as double)) > 0.2 flag from visits" for c in X.FEATURES))
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.coverage(X.visits(spark, sf_dir), X.FEATURES)


@query("iqr_outlier_table", _U + ", q as (select visit, site, feature, count(*) n, quantile_cont(value, 0.25) a, quantile_cont(value, 0.75) b from u where value is not null group by all having count(*) >= 4), j as (select u.*, q.n, a - 0.5 * (b - a) lo, b + 0.5 * (b - a) hi from u join q using (visit, site, feature) where value is not null) select visit, site, feature, n, R(lo) low, R(hi) high, count(*) filter (value < lo or value > hi) n_outliers, R(min(value)) min, R(max(value)) max, R(100.0::double * count(*) filter (value < lo or value > hi) / n) pct from j group by visit, site, feature, n, lo, hi having count(*) filter (value < lo or value > hi) > 0")
def iqr_outlier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.outlier_table(X.visits(spark, sf_dir), X.FEATURES, k=0.5)


@query("nb_04_complete_intervals", f"select count(*) n from (select subject_id from visits where visit in (1, 3) and {_ALL} group by 1 having count(distinct visit) = 2)")
def complete_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_visits(X.visits(spark, sf_dir), NUM, "subject_id", (1, 3)).select("subject_id").distinct().agg(F.count("*").alias("n"))


@query("nb_07_interval_availability", ", s as (select subject_id, max((pair = 'V1V2')::int) a, max((pair = 'V2V3')::int) b from pairs group by 1) select case when a = 1 and b = 1 then 'V1,V2,V3' when a = 1 then 'V1,V2' else 'V2,V3' end visits, count(*) n from s group by 1")
def interval_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = X.pairs(spark, sf_dir).groupBy("subject_id").agg(F.collect_set("pair").alias("p"))
    return s.groupBy(F.when(F.size("p") == 2, "V1,V2,V3").when(F.array_contains("p", "V1V2"), "V1,V2").otherwise("V2,V3").alias("visits")).agg(F.count("*").alias("n"))


@query("nb_08_duplicate_keys", "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1", fixtures=False)
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("nb_09_usable_counts", f"select coalesce(pair, 'both') pair, count(*) n from pairs where {' and '.join(f'delta_{f} is not null' for f in X.FEATURES)} group by grouping sets ((pair), ())")
def usable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.pairs(spark, sf_dir).dropna(subset=[f"delta_{f}" for f in X.FEATURES])
    return rows.rollup("pair").agg(F.count("*").alias("n")).select(F.coalesce("pair", F.lit("both")).alias("pair"), "n")


# folds, scaling and stability

_FOLD = "cast(('0x' || substr(md5('42|' || subject_id), 1, 8))::bigint % 5 as int)"


@query("hash_folds", f"select cast(r.r as int) repeat, subject_id, cast(('0x' || substr(md5(cast(42 + r.r as varchar) || '|' || subject_id), 1, 8))::bigint % 5 as int) fold from (select distinct subject_id from visits), (select unnest(range(3)) r) r")
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fold_table(X.visits(spark, sf_dir), "subject_id", 5, 3)


@query("spl_05_grouped_fold_sizes", f"select {_FOLD} fold, count(*) n_rows, count(distinct subject_id) n_groups from visits group by 1")
def grouped_fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.visits(spark, sf_dir).groupBy(R.hash_fold(F.col("subject_id"), 5).alias("fold")).agg(F.count("*").alias("n_rows"), F.count_distinct("subject_id").alias("n_groups"))


@query("loo_folds", "select count(*) n, count(distinct subject_id) folds, cast(0 as bigint) least, count(*) - 1 most from (select distinct subject_id from visits)")
def loo_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leave_one_out(X.visits(spark, sf_dir), "subject_id").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), F.min("fold").alias("least"), F.max("fold").alias("most"))


@query("group_disjoint_check", "select subject_id, cast(0 as bigint) folds from visits where false")
def group_disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select("subject_id", "visit", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("repeat"))
    d = v.withColumn("fold", F.pmod(R.hash_number(F.concat_ws("|", (F.col("repeat") + 42).cast("string"), F.col("subject_id"))), F.lit(5)))
    return R.shared_groups(d, "subject_id", "fold").select("subject_id", "folds")


@query("spl_06_logo_dry_run", "select count(distinct subject_id) groups from pairs")
def logo_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.leave_one_out(X.pairs(spark, sf_dir), "subject_id").agg(F.count("*").alias("groups"))


@query("spl_08_sampled_rows", "select patient_id from pairs order by md5('42|' || patient_id), patient_id limit 25")
def sampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_rows(X.pairs(spark, sf_dir), "patient_id", 25).select("patient_id")


@query("spl_05_shared_subjects", ", f as (select subject_id, pair, case when pair = 'V1V2' then 0 else ('0x' || substr(md5('42|' || subject_id), 1, 8))::bigint % 5 end fold from pairs) select subject_id, count(distinct fold) folds from f group by 1 having count(distinct fold) > 1")
def shared_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that a careless split (first pairs into fold 0) puts into several folds."""
    p = X.pairs(spark, sf_dir).select("subject_id", F.lit(0).alias("repeat"), F.when(F.col("pair") == "V1V2", 0).otherwise(R.hash_fold(F.col("subject_id"), 5)).alias("fold"))
    return R.shared_groups(p, "subject_id", "fold").select("subject_id", "folds")


@query("spl_04_validation_groups", ", g as (select subject_id, row_number() over (order by md5('42|' || subject_id), subject_id) r, count(*) over () n from (select distinct subject_id from visits)) select subject_id, r <= greatest(1, round_even(n * 0.2, 0)) validation from g")
def validation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validation_groups(X.visits(spark, sf_dir), "subject_id")


def _boot_sql(source: str, key: str, unit: str, replicates: int) -> str:
    """bc: key, n_pairs and the 95% interval of d_z over Poisson replicates; source has the key, the unit and delta."""
    draw = "('0x' || substr(md5('42|' || bk || '|' || bu || '|' || cast(b // 8 as varchar)), 1 + 4 * (b % 8), 4))::bigint"
    return f"""br as (select {key} bk, {unit} bu, delta from ({source}) where delta is not null),
bw as (select bk, b, delta, len(list_filter({list(R.POISSON)}, lambda t: t <= {draw})) w from br, (select unnest(range({replicates})) b)),
bs as (select bk, b, sum(w)::double n, sum(w * delta) s, sum(w * delta * delta) q from bw group by 1, 2),
be as (select bk, quantile_cont(case when n > 1 and (q - s * s / n) / (n - 1) > 1e-300 then s / n / sqrt((q - s * s / n) / (n - 1)) end, [0.025, 0.975]) ci from bs group by 1),
bc as (select bk, n_pairs, case when n_pairs >= 10 then ci[1] end low, case when n_pairs >= 10 then ci[2] end high from (select bk, count(*) n_pairs from br group by 1) left join be using (bk))"""


_BOOT = ", " + _boot_sql("select pair, patient_id, delta_f_view delta from pairs", "pair", "patient_id", 100) + " select bk pair, n_pairs, R(low) d_z_ci_low, R(high) d_z_ci_high from bc"


@query("bootstrap_ci_md5", _BOOT)
def bootstrap_ci_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.pairs(spark, sf_dir).select("pair", "patient_id", F.col("delta_f_view").alias("delta"))
    return R.bootstrap_effects(d, ["pair"], "patient_id", replicates=100)


_TRAIN = f", f as (select *, {_FOLD} fold from visits), o as (select distinct fold \"outer\" from f)"


@query("train_zscore_by_fold", _TRAIN + ", m as (select o.\"outer\", avg(f_view) mu, stddev_pop(f_view) sd from o join f on f.fold <> o.\"outer\" group by 1) select m.\"outer\", f.fold = m.\"outer\" is_test, f.subject_id, f.visit, f.fold, R((f_view - mu) / case when sd > 1e-9 then sd else 1 end) f_view from f, m")
def train_zscore_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select("subject_id", "visit", "f_view", R.hash_fold(F.col("subject_id"), 5).alias("fold"))
    return P.zscore_by_fold(v, ["f_view"])


@query("median_impute_by_fold", _TRAIN + ", m as (select o.\"outer\", quantile_cont(f_error, 0.5) md from o join f on f.fold <> o.\"outer\" group by 1) select m.\"outer\", f.fold = m.\"outer\" is_test, f.subject_id, f.visit, f.fold, R(coalesce(f_error, md, 0)) f_error from f, m")
def median_impute_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select("subject_id", "visit", "f_error", R.hash_fold(F.col("subject_id"), 5).alias("fold"))
    return P.median_impute_by_fold(v, ["f_error"])


@query("pre_02_column_scaler", ", m as (select avg(f_view) mu, stddev_pop(f_view) sd from visits where visit = 1) select subject_id, visit, R((f_view - mu) / sd) f_view from visits, m")
def column_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select("subject_id", "visit", "f_view")
    return P.ColumnScaler(["f_view"]).fit(v.where("visit = 1")).transform(v)


@query("pre_03_median_imputer", ", m as (select quantile_cont(f_error, 0.5) md from visits where visit = 1) select subject_id, visit, R(coalesce(f_error, md)) f_error from visits, m")
def median_imputer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select("subject_id", "visit", "f_error")
    return P.MedianImputer(["f_error"]).fit(v.where("visit = 1")).transform(v)


@query("pre_04_standardised", ", a as (select subject_id, visit, coalesce(f_error, avg(f_error) over ()) x from visits) select subject_id, visit, R((x - avg(x) over ()) / stddev_samp(x) over ()) f_error from a")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.standardised(X.visits(spark, sf_dir).select("subject_id", "visit", "f_error"), ["f_error"])


#: A run's set: the features whose mean at a site and visit is above that of all visits; runs without any have an empty set.
_SETS_CTE = f", v as (select site || '|' || visit id, feature, value from (select site, visit, {', '.join(X.FEATURES)} from visits) unpivot (value for feature in ({', '.join(X.FEATURES)}))), mean_ as (select feature, avg(value) m from v group by 1), at_ as (select id, feature, avg(value) a from v group by 1, 2), sets_ as (select id, coalesce(list(feature order by feature) filter (a > m * 1.01), []) features from at_ join mean_ using (feature) group by 1)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.visits(spark, sf_dir).select(F.concat_ws("|", "site", "visit").alias("id"), *X.FEATURES).unpivot(["id"], list(X.FEATURES), "feature", "value").where("value is not null")
    mean = v.groupBy("feature").agg(F.avg("value").alias("m"))
    # a row a feature
    at = v.groupBy("id", "feature").agg(F.avg("value").alias("a")).join(F.broadcast(mean), "feature")
    return at.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("a") > F.col("m") * 1.01, F.col("feature")))).alias("features"))


_J = _SETS_CTE + ", j as (select a.id a, b.id b, case when len(a.features) + len(b.features) = 0 then 1.0::double else len(list_intersect(a.features, b.features))::double / len(list_distinct(list_concat(a.features, b.features))) end jaccard from sets_ a join sets_ b on a.id < b.id)"


@query("jaccard_pairs", _J + " select a, b, R(jaccard) jaccard from j")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.jaccard_pairs(_sets(spark, sf_dir))


@query("agg_23_jaccard_summary", _J + " select count(*) n_pairs, R(avg(jaccard)) mean, R(quantile_cont(jaccard, 0.5)) median, R(quantile_cont(jaccard, 0.25)) q25, R(quantile_cont(jaccard, 0.75)) q75, R(min(jaccard)) min, R(max(jaccard)) max from j")
def jaccard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.jaccard_summary(_sets(spark, sf_dir))


_UNIVERSE = "(values " + ", ".join(f"('{f}')" for f in X.FEATURES) + ") u(feature)"


@query("selection_frequency", _SETS_CTE + f", s as (select id, unnest(features) feature from sets_) select u.feature, count(s.id) count, R(count(s.id)::double / (select count(*) from sets_)) frequency from {_UNIVERSE} left join s using (feature) group by 1")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.selection_frequency(_sets(spark, sf_dir), spark.createDataFrame([(f,) for f in X.FEATURES], "feature string"))


@query("agg_28_domain_coverage", _SETS_CTE + " select id, (len(list_intersect(features, ['f_click', 'f_purchase'])) > 0)::bigint + (len(list_intersect(features, ['f_view'])) > 0)::bigint + (len(list_intersect(features, ['f_signup', 'f_error'])) > 0)::bigint domains from sets_")
def domain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that each run's set reaches."""
    domains = (("f_click", "f_purchase"), ("f_view",), ("f_signup", "f_error"))
    reached = sum((F.arrays_overlap("features", F.array(*[F.lit(f) for f in d])).cast("long") for d in domains), F.lit(0).cast("long"))
    return _sets(spark, sf_dir).select("id", reached.alias("domains"))


_UD = f", u as (unpivot (select {', '.join('delta_' + f for f in X.FEATURES)} from pairs) on * into name feature value delta)"


@query("sign_stability", _UD + ", g as (select feature, avg(cast(case when delta > 0 then 1 else 0 end as double)) p, avg(cast(case when delta < 0 then 1 else 0 end as double)) n, avg(cast(case when delta = 0 then 1 else 0 end as double)) z from u group by 1) select feature, R(p) positive, R(n) negative, R(z) zero, cast(case when p >= n and p >= z then 1 when n >= z then -1 else 0 end as int) dominant_sign, R(greatest(p, n, z)) sign_stability from g")
def sign_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.pairs(spark, sf_dir).unpivot([], [f"delta_{f}" for f in X.FEATURES], "feature", "delta").where("delta is not null")
    return T.sign_stability(u, coef="delta")


@query("agg_22_coefficient_summary", _UD + " select feature, R(quantile_cont(delta, 0.5)) median, R(quantile_cont(delta, 0.025)) ci_low, R(quantile_cont(delta, 0.975)) ci_high, R(avg(cast(case when delta > 0 then 1 else 0 end as double))) positive, R(avg(cast(case when delta <> 0 then 1 else 0 end as double))) selected, quantile_cont(delta, 0.025) <= 0 and quantile_cont(delta, 0.975) >= 0 crosses_zero from u group by 1")
def coefficient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.pairs(spark, sf_dir).unpivot([], [f"delta_{f}" for f in X.FEATURES], "feature", "delta").where("delta is not null")
    return T.coefficient_summary(u, coef="delta")


@query("agg_26_ranking_stability", _UD.replace(f"select {', '.join('delta_' + f for f in X.FEATURES)} from pairs", f"select patient_id, {', '.join('delta_' + f for f in X.FEATURES)} from pairs").replace("on *", "on columns('delta_.*')") + ", j as (select a.feature a, b.feature b, a.delta x, b.delta y from u a join u b on a.patient_id = b.patient_id and a.feature < b.feature), r as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0::double rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0::double ry from j) select a, b, count(*) n, R(corr(rx, ry)) rho from r group by 1, 2 having count(*) >= 3")
def ranking_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.pairs(spark, sf_dir).unpivot(["patient_id"], [f"delta_{f}" for f in X.FEATURES], "feature", "delta")
    return T.ranking_stability(u, "feature", "patient_id", "delta")


@query("corr_pairs", f", c as (select * from visits where {' and '.join(f + ' is not null' for f in X.FEATURES)}) " + " union all ".join(f"select '{a}' a, '{b}' b, R(corr({a}, {b})) r from c" for k, a in enumerate(X.FEATURES) for b in X.FEATURES[k + 1 :]))
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.correlation_pairs(X.visits(spark, sf_dir), X.FEATURES)


_EDGE = ", ".join(f"{k / 10}" for k in range(1, 10))


@query("mi_binned", ", u as (select visit, feature, value from (select visit, f_click, f_view from visits) unpivot (value for feature in (f_click, f_view))), q as (select feature, list_distinct(quantile_cont(value, [" + _EDGE + "])) e from u group by 1), b as (select u.feature, visit, len(list_filter(q.e, lambda z: z < value)) bin from u join q using (feature)), j as (select feature, bin, visit, count(*)::double c from b group by all), p as (select feature, c / sum(c) over (partition by feature) p, sum(c) over (partition by feature, bin) / sum(c) over (partition by feature) a, sum(c) over (partition by feature, visit) / sum(c) over (partition by feature) b from j) select feature, R(sum(p * ln(p / (a * b)))) mi from p group by 1")
def mi_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.feature_information(X.visits(spark, sf_dir), ["f_click", "f_view"], "visit")


@query("anova_site_f", ", u as (select site, feature, value from (select site, f_click, f_view from visits) unpivot (value for feature in (f_click, f_view))), g as (select feature, site, count(*) n, avg(value) m, var_pop(value) * count(*) ss from u group by 1, 2), t as (select feature, avg(value) m from u group by 1), s as (select g.feature, cast(sum(n) as bigint) n, count(*) groups, sum(ss) w, sum(n * (g.m - t.m) * (g.m - t.m)) b from g join t using (feature) group by 1) select feature, n, groups, R((b / (groups - 1)) / (w / (n - groups))) f, R(b / (b + w)) r2 from s")
def anova_site_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.site_anova(X.visits(spark, sf_dir), ["f_click", "f_view"])


_SITE_OLS = f", u as (select site, t, feature, y from (select site, time_years t, {', '.join(X.FEATURES)} from visits) unpivot (y for feature in ({', '.join(X.FEATURES)}))), s as (select feature, site, count(*)::double n, avg(t) mt, avg(y) my, var_pop(t) vt, var_pop(y) vy, covar_pop(t, y) c from u group by 1, 2), w as (select feature, cast(sum(n) as bigint) n, count(*) sites, sum(n * vt) tt, sum(n * vy) yy, sum(n * c) ty from s group by 1), a as (select feature, count(*) * var_pop(t) tt, count(*) * var_pop(y) yy, count(*) * covar_pop(t, y) ty from u group by 1), r as (select feature, w.n, w.sites, a.yy, a.yy - a.ty * a.ty / a.tt base, w.yy - w.ty * w.ty / w.tt wide from w join a using (feature)) select feature, n, R((base - wide) / yy) delta_r2, R(((base - wide) / (sites - 1)) / (wide / (n - sites - 1))) f from r"


@query("agg_31_site_screen_one", _SITE_OLS)
def site_screen_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.site_screen(X.visits(spark, sf_dir), list(X.FEATURES), ["time_years"]).drop("p")


@query("agg_31_site_screen")
def site_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.site_screen(X.visits(spark, sf_dir), list(X.FEATURES), ["time_years", "mfars_total"])


# ranking

#: Candidates made of orders: a mean, its standard error (none for some), a gap, a share and a number of features; one mean is -inf.
_CAND_SQL = "(select candidate_idx, case when candidate_idx = 12 then '-inf'::double else m end mean_validation_annual_dz, case when candidate_idx % 11 <> 3 then s end se_validation_dz, case when candidate_idx % 13 <> 5 then g end annual_interval_gap, p p_progression, case when candidate_idx % 17 <> 4 then (1 + candidate_idx % 7)::double end feature_count from (select cast(o_custkey % 40 as int) candidate_idx, avg(o_totalprice) / 1e5::double m, 2 * stddev_samp(o_totalprice) / sqrt(count(*)) / 1e5::double s, abs(avg(case when o_orderkey % 2 = 0 then o_totalprice end) - avg(case when o_orderkey % 2 = 1 then o_totalprice end)) / 1e5::double g, avg(case when o_totalprice > 150000 then 1.0::double else 0.0::double end) p from orders group by 1)) c"


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, even = F.col("o_totalprice"), F.col("o_orderkey") % 2 == 0
    o = X.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).cast("int").alias("candidate_idx"))
    o = o.agg((F.avg(price) / 1e5).alias("m"), (2 * F.stddev_samp(price) / F.sqrt(F.count("*")) / 1e5).alias("s"), (F.abs(F.avg(F.when(even, price)) - F.avg(F.when(~even, price))) / 1e5).alias("g"), F.avg(F.when(price > 150000, 1.0).otherwise(0.0)).alias("p"))
    idx = F.col("candidate_idx")
    return o.select(idx, F.when(idx == 12, float("-inf")).otherwise(F.col("m")).alias("mean_validation_annual_dz"), F.when(idx % 11 != 3, F.col("s")).alias("se_validation_dz"), F.when(idx % 13 != 5, F.col("g")).alias("annual_interval_gap"), F.col("p").alias("p_progression"), F.when(idx % 17 != 4, 1.0 + idx % 7).alias("feature_count"))


@query("one_se_choice", f"with c as (select * from {_CAND_SQL}), b as (select mean_validation_annual_dz m, se_validation_dz s from c order by m desc nulls last, candidate_idx limit 1) select cast(candidate_idx as int) candidate_idx, R(annual_interval_gap) gap from c, b where mean_validation_annual_dz >= m - coalesce(s, 0) order by annual_interval_gap nulls last, p_progression desc nulls last, feature_count nulls last, candidate_idx limit 1", fixtures=False)
def one_se_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.hierarchical_choice(_cands(spark, sf_dir)).select("candidate_idx", F.col("annual_interval_gap").alias("gap"))


@query("srt_05_near_optimal", f"with c as (select * from {_CAND_SQL}), b as (select mean_validation_annual_dz m, se_validation_dz s from c order by m desc nulls last, candidate_idx limit 1) select cast(candidate_idx as int) candidate_idx from c, b where mean_validation_annual_dz >= m - coalesce(s, 0)", fixtures=False)
def near_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.near_best(_cands(spark, sf_dir), "mean_validation_annual_dz", "se_validation_dz").select("candidate_idx")


@query("nb_16_parsimony_picks", f"with c as (select * from {_CAND_SQL}), b as (select mean_validation_annual_dz m, se_validation_dz s from c order by m desc nulls last, candidate_idx limit 1), n as (select c.* from c, b where mean_validation_annual_dz >= m - coalesce(s, 0)) select 'simplest' pick, candidate_idx from (select candidate_idx from n order by feature_count nulls last, candidate_idx limit 1) union all select 'most stable', candidate_idx from (select candidate_idx from n order by p_progression desc nulls last, candidate_idx limit 1)", fixtures=False)
def parsimony_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = K.near_best(_cands(spark, sf_dir), "mean_validation_annual_dz", "se_validation_dz")
    one = K.top_k(near, 1, [F.col("feature_count").asc_nulls_last(), "candidate_idx"]).select(F.lit("simplest").alias("pick"), "candidate_idx")
    two = K.top_k(near, 1, [F.col("p_progression").desc_nulls_last(), "candidate_idx"]).select(F.lit("most stable").alias("pick"), "candidate_idx")
    return one.unionByName(two)


@query("min_rank_review", f", u as (unpivot pairs on {', '.join('delta_' + f for f in X.FEATURES)} into name feature value delta), g as (select feature, round(avg(delta) / stddev_samp(delta), 2) d from u group by 1) select feature, R(d) d, cast(rank() over (order by d desc nulls last) as int) raw_rank from g")
def min_rank_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.operators.effects import cohens_dz

    u = X.pairs(spark, sf_dir).unpivot([], [f"delta_{f}" for f in X.FEATURES], "feature", "delta")
    return K.min_rank(u.groupBy("feature").agg(F.round(cohens_dz(F.col("delta")), 2).alias("d")), "d")


@query("topk_by_group", "select o_custkey, o_orderkey, R(o_totalprice) o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3", fixtures=False)
def topk_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.top_k(X.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), 3, [F.col("o_totalprice").desc(), "o_orderkey"], ["o_custkey"])


@query("best_per_model", "with a as (select 'm' || cast(o_custkey % 7 as varchar) model, o_orderkey run, o_totalprice / 1e5 annual_dz, null::double d_score, (o_orderkey % 13) / 10.0::double annual_interval_gap from orders where o_orderkey % 2 = 0 union all select 'm' || cast(o_custkey % 7 as varchar), o_orderkey, null, o_totalprice / 1e5, (o_orderkey % 13) / 10.0::double from orders where o_orderkey % 2 = 1) select model, run, R(coalesce(annual_dz, d_score)) score from a qualify row_number() over (partition by model order by coalesce(annual_dz, d_score) desc nulls last, annual_interval_gap nulls last, run) = 1", fixtures=False)
def best_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model"), F.col("o_orderkey").alias("run"), (F.col("o_totalprice") / 1e5).alias("s"), ((F.col("o_orderkey") % 13) / 10.0).alias("annual_interval_gap"))
    a = o.where("run % 2 = 0").withColumnRenamed("s", "annual_dz")
    b = o.where("run % 2 = 1").withColumnRenamed("s", "d_score")
    return K.best_per_model([a, b]).select("model", "run", F.coalesce("annual_dz", "d_score").alias("score"))


@query("srt_08_coefficient_table", f", u as (unpivot pairs on {', '.join('delta_' + f for f in X.FEATURES)} into name feature value delta), g as (select feature, avg(delta) coef from u group by 1) select feature, R(coef) coef, R(abs(coef)) abs_coef, cast(sign(coef) as int) sign, cast(row_number() over (order by abs(coef) desc, feature) as int) rank from g")
def coefficient_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = X.pairs(spark, sf_dir).unpivot([], [f"delta_{f}" for f in X.FEATURES], "feature", "delta")
    return K.coefficient_table(u.groupBy("feature").agg(F.avg("delta").alias("coef")))
