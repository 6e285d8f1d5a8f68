"""Edge cases of pairing, ids, ranks and guards."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import ids, names
from tideline.operators import audit, effects, events, filters, ranking, reshape
from tideline.sources import readers, sinks


def one(spark, f, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_pairing_rules_differ(spark):
    rows = [("a_1", 1, 1.0), ("a_1", 2, 2.0), ("b", 1, 1.0), ("c", 1, 1.0), ("c", 2, None), ("d", 1, 1.0), ("d", 2, 2.0), ("d", 3, 4.0), ("e", 1, 1.0), ("e", 1, 5.0)]
    df = spark.createDataFrame(rows, "s string, visit int, score double")
    two = {r.s: r.delta for r in effects.two_row_deltas(df, "s").collect()}
    assert set(two) == {"a_1", "c", "e"} and two["a_1"] == 1.0 and two["c"] is None
    assert {r.s for r in effects.two_row_deltas(df, "s", drop_null=True).collect()} == {"a_1", "e"}
    label = {r.s: r.delta for r in effects.longitudinal_deltas(df, 1, 2, subject="s").collect()}
    assert set(label) == {"a_1", "c", "d"}
    assert {r.s for r in filters.complete_cases(df, ["score"], "s").collect()} == {"a_1"}
    assert {r.s for r in filters.with_visits(df, ["score"], "s").collect()} == {"a_1", "d"}


def test_effect_size_edges(spark):
    def d(*v):
        return spark.createDataFrame([(x,) for x in v], "x double").agg(effects.cohens_dz(F.col("x")).alias("d"), effects.probability_positive(F.col("x")).alias("p")).first()

    assert d().d is None and d(1.0).d is None and d(2.0, 2.0).d is None
    assert d(1.0, 3.0, float("nan"), float("inf"), None).d == pytest.approx(2 / 2**0.5)
    assert d(1.0, -1.0, 0.0, None).p == pytest.approx(1 / 3)
    assert d(2.0, 6.0).d == pytest.approx(d(1.0, 3.0).d)


def test_ids(spark):
    assert one(spark, ids.std_name, " A  b-C_ ", "__x__", "") == ["a_b_c", "x", ""]
    assert one(spark, ids.repeat_length, " >700", "0775", "", "nan", "12a", "1d", None) == [700.0, 775.0, None, None, 12.0, 1.0, None]
    assert one(spark, ids.visit_label, None, "v2 ", "2.0", "x1") == ["", "V2", "V2", "x1"]
    assert one(spark, ids.pair_subject, "a_b_V1V2") == ["a"]
    assert one(spark, ids.campac_to_pac, "sub-campac7", "other") == ["pac07", None]
    assert one(spark, ids.pac_to_campac, "pac7", "x") == ["sub-campac07", None]
    assert one(spark, ids.clinical_to_bids, "54.07", "55", "abc", "54.125") == ["sub-melfrd007", None, None, "sub-melfrd012"]
    assert one(spark, ids.event_rank, "enrolment_arm_1", "Pre-enrol", "visit_2", "x", None) == [0, 0, 2, 999, 999]
    assert one(spark, lambda c: reshape.visit_number("t"), "V2", "visit 3", "1.0", "4", "") == [2, 3, 1, None, None]



def test_names():
    assert names.is_clinical_score("delta_mfars_total_v2") and names.is_clinical_score("FARS1") and names.is_clinical_score("sara_x")
    assert names.is_clinical_score("MFARS-total_v1") and names.is_clinical_score("delta-sara")
    assert names.split_group_column(["pair_id", "subject"], "pair_id") == "subject" and names.split_group_column(["pair_id"], "pair_id") == "pair_id"
    with pytest.raises(KeyError):
        names.split_group_column(["pair_id"], "pair_id", "site")
    assert not names.is_clinical_score("scp_vol") and not names.is_clinical_score("farsight")
    assert names.visit_bases(["a_v1", "a_v2", "a_v3", "b_v1", "c_v1", "c_v2", "c_v3"], without=["c"]) == ["a"]
    g = names.feature_groups(["FA_SCP_baseline", "delta_vol", "vol_followup", "age_baseline", "site"], ["age"], ["FA_SCP"])
    assert g.poms == ("FA_SCP",) and g.dti == ("FA_SCP",) and g.imaging() == ["FA_SCP", "vol"]
    assert names.id_column(["x", "Subject", "id"]) == "Subject" and names.first_present(["A", "b"], "B") == "b"


def test_guards(spark):
    df = spark.createDataFrame([("1", 1), ("1.0", 2), (" HC ", 3), (None, 4), ("patient", 5), ("Healthy-Control ", 6)], "group string, k int")
    assert {r.k for r in filters.drop_controls(df).collect()} == {2, 4, 5}
    with pytest.raises(ValueError):
        filters.require_no_controls(df)
    with pytest.raises(ValueError):
        filters.require_no_clinical_features(["x", "sara_total"])
    ok = df.where("k in (4, 5)")
    with pytest.raises(ValueError):
        filters.require_training_frame(ok, ["x"], "mfars_total")
    filters.require_training_frame(ok, ["x"], "mfars_total", allow_clinical_target=True)


def test_collapse_takes_mode_then_earliest(spark):
    rows = [("a", "enrolment_arm_1", "x", ""), ("a", "study_visit_1_arm_1", "y", "1"), ("a", "study_visit_2_arm_1", "y", None), ("b", "study_visit_2_arm_1", "p", None), ("b", "study_visit_1_arm_1", "q", None)]
    df = spark.createDataFrame(rows, "id string, event string, c string, d string")
    got = {r.id: (r.c, r.d) for r in events.collapse_events(df, "id", ids.event_rank(F.col("event")), ["c", "d"]).collect()}
    assert got == {"a": ("y", "1"), "b": ("q", None)}
    assert {(r.id, r.column) for r in events.collapse_conflicts(df, "id", ["c", "d"]).collect()} == {("a", "c"), ("b", "c")}


def test_null_keys_meet_in_an_outer_merge(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "SubjectID string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "SubjectID string, b int")
    assert len(events.merge_sheets({"a": a, "b": b}, ["SubjectID"]).collect()) == 3


def test_choice_with_unknown_error_keeps_the_best(spark):
    df = spark.createDataFrame([(1, 0.5, None, 0.3), (2, 0.49, 0.1, 0.0)], "candidate_idx int, m double, se double, annual_interval_gap double")
    assert ranking.hierarchical_choice(df, "m", "se").first().candidate_idx == 1
    df = spark.createDataFrame([(1, 0.5, 0.1, 0.3), (2, 0.49, 0.1, None), (3, 0.45, 0.1, 0.1), (4, 0.45, 0.1, 0.1)], df.schema)
    assert ranking.hierarchical_choice(df, "m", "se").first().candidate_idx == 3


def test_patterns_and_empty_frames(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 2)], "subject_id string, visit int")
    got = {r.pattern: r.n_subjects for r in audit.pattern_counts(df).collect()}
    assert got["101"] == 1 and got["010"] == 1 and got["111"] == 0 and "000" not in got
    empty = df.where("visit > 9")
    assert audit.null_counts(empty, ["visit"]).collect() is not None
    assert effects.two_row_deltas(empty.withColumn("score", F.lit(1.0)), "subject_id").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A1", 1.0, None), ("B1", float("nan"), " ")], "id string, x double, t string")
    clean = readers.clean_missing(df)
    assert clean.where("x is null").count() == 1 and clean.where("t is null").count() == 2
    path = sinks.write_table(df.select("id", "x"), str(tmp_path / "t.csv"), "csv")
    assert readers.read_table(spark, path).columns == ["id", "x"]
    both = sinks.write_cohorts(clean.withColumn("subject", F.lit("s")).withColumn("b", F.lit(2)), str(tmp_path / "cohorts"), "id", {"a": "^A", "b": "^B"}, first=["x", "id"])
    assert {n: readers.read_table(spark, p).columns for n, p in both.items()} == {"a": ["id", "x", "b"], "b": ["id", "b"], "combined": ["id", "x", "b"]}
    assert {"python", "pyspark", "numpy", "at"} <= set(sinks.provenance())
    parts = sinks.split_cohorts(clean, "id", {"a": "^A", "b": "^B"})
    assert parts["a"].columns == ["id", "x"] and parts["b"].columns == ["id"]
    saved = sinks.save_bundle(str(tmp_path / "run"), {"k": 1}, {"d": 0.5}, {"oof": df.select("id"), "none": None})
    assert set(saved) == {"oof"} and (tmp_path / "run" / "config.json").exists()
    assert readers.choose_sheet({"u": df, "v": df.withColumn("id", F.lit("Z_1"))}, ["Z_"], names=("id",)) == "v"


def test_numbers_are_gapless_and_follow_the_hash(spark):
    import hashlib

    from tideline.operators.resample import numbered

    df = spark.createDataFrame([(k % 3, f"s{k}") for k in range(200)], "g int, s string")
    got = {}
    for r in numbered(df, "s", ["g"]).collect():
        got.setdefault(r.g, []).append((r._i, r.s))
    for rows in got.values():
        rows.sort()
        assert [i for i, _ in rows] == list(range(len(rows)))
        assert [s for _, s in rows] == sorted((s for _, s in rows), key=lambda s: (hashlib.md5(s.encode()).hexdigest(), s))


def test_merge_of_events_and_sheets(spark):
    from tideline.plans.merge import merge_invariants, merge_study, normalise_sheets

    e = spark.createDataFrame([("a", "x", "0"), ("b", "y", "1"), ("c", "z", "0")], "subject_id string, site string, study_group string")
    one = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 2, None), ("b", 1, 1.0), ("b", 2, 2.0), ("c", 1, 1.0)], "subject_id string, visit int, f double")
    two = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("c", 2, 7.0)], "subject_id string, visit int, g double")
    out = merge_study(e, F.lit(0), ["site"], {"one": one, "two": two}, {"one": ["f"], "two": ["g"]}, ["f"])
    assert [(r.patient_id, r.site, r.delta_f, r.delta_g) for r in out.collect()] == [("a_V1V2", "x", 2.0, 1.0)]
    assert tuple(merge_invariants(out).first()) == (1, 1, 0)
    wide = spark.createDataFrame([(" a", 1.0, None, 2.0)], "ID string, f_v1 double, f_v2 double, f_v3 double")
    assert normalise_sheets(wide, "ID", None, ["f"]).count() == 3
    with pytest.raises(ValueError):
        normalise_sheets(wide, "ID", None, ["g"])


def test_entry_without_the_text_operators(tmp_path):
    """A copy without tideline/llm and tests/llm, once with corpus_pipeline.py and once without."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 100; assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
