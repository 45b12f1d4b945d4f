"""Wide clinical tables on tiny gold tables; expected rows by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from starweave.plans import wide

OLD, NEW = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
D = lambda *a: dt.datetime(*a)


def stamped(df, ts=OLD):
    return df.withColumn("updated_ts", F.lit(ts).cast("timestamp"))


@pytest.fixture(scope="module")
def t(spark):
    make = lambda rows, schema: stamped(spark.createDataFrame(rows, schema))
    admissions = [(10, 1, 21010101, D(2101, 1, 1), D(2101, 1, 3), 0, False), (11, 1, 21010115, D(2101, 1, 15), D(2101, 1, 16), 1, True), (12, 2, 21010301, D(2101, 3, 1), None, 0, False), (13, 9, None, None, None, None, None)]
    extra = {c: F.lit(None).cast("string") for c in ("admit_provider_id", "admission_type", "admission_location", "discharge_location", "insurance", "language", "marital_status", "race")}
    extra |= {c: F.lit(None).cast("double") for c in ("hospital_los_hours", "ed_los_minutes", "time_to_death_hours", "days_since_prior_discharge")} | {"death_time": F.lit(None).cast("timestamp_ntz")}
    tables = {
        "dim_patient": make([(1, "F", 60, 2100, "2008 - 2010", None), (2, "M", 40, 2150, "2011 - 2013", None), (3, "F", 50, 2120, "2011 - 2013", None)], "subject_id long, gender string, anchor_age int, anchor_year int, anchor_year_group string, dod date"),
        "fact_admission": make(admissions, "hadm_id long, subject_id long, admit_date_key int, admit_time timestamp_ntz, disch_time timestamp_ntz, hospital_expire_flag int, is_readmission_flag boolean").withColumns(extra | {"age_at_admission": F.lit(61)}),
        "fact_diagnosis": make([(10, 1, 1, "A"), (10, 1, 2, "B"), (10, 1, 1, "C"), (11, 1, 2, "A"), (None, 1, 1, "Z")], "hadm_id long, subject_id long, seq_num int, icd_code string"),
        "fact_procedure": make([(10,), (10,)], "hadm_id long"),
        "fact_drg_assignment": make([(10, 1, 4), (10, 3, None)], "hadm_id long, drg_severity int, drg_mortality int"),
        "fact_icu_stay_accumulating": make([(100, 10, 1, 21010101, 1.5, "M", "S", D(2101, 1, 1), D(2101, 1, 2), 6.0, False), (101, 10, 1, 21010201, 2.0, "S", "S", D(2101, 2, 1), None, None, True), (102, 99, 7, 21010202, None, None, None, None, None, None, False)],
            "stay_id long, hadm_id long, subject_id long, in_date_key int, los double, first_careunit string, last_careunit string, in_time timestamp_ntz, out_time timestamp_ntz, time_to_icu_hours double, is_icu_readmission_flag boolean"),
        "fact_lab_result": make([(10, True), (10, None), (10, False), (10, True), (12, None)], "hadm_id long, is_abnormal_flag boolean"),
        "fact_medication_administration": make([(11,)], "hadm_id long"),
        "fact_microbiology_result": make([(10, True), (10, True), (12, False)], "hadm_id long, is_positive_culture_flag boolean"),
        "fact_transfer": make([(10,), (11,), (11,)], "hadm_id long"),
        "agg_icu_fluid_balance_daily": make([(100, 100.0, 30.0), (100, 50.0, 0.0)], "stay_id long, intake_ml double, output_ml double"),
        "fact_chart_observation": make([(100, True), (100, None), (101, None)], "stay_id long, is_abnormal_flag boolean"),
        "fact_datetime_event": make([(101,)], "stay_id long"), "fact_input_event": make([(100,)], "stay_id long"), "fact_output_event": make([(100,)], "stay_id long"),
        "fact_procedure_event": make([(100, 30.0), (100, None)], "stay_id long, duration_minutes double"),
    }
    tables["obt_admission_features"] = stamped(wide.admission_features(tables).drop("updated_ts"))
    return tables


def test_admission_features(t):
    out = t["obt_admission_features"]
    assert len(out.columns) == 41
    r = {x.hadm_id: x for x in out.collect()}
    assert set(r) == {10, 11, 12, 13} and out.count() == 4  # two first diagnoses do not double a row
    a = r[10]
    assert (a.admit_year_month, a.gender, a.diagnosis_count, a.primary_icd_code, a.procedure_count, a.max_drg_severity, a.max_drg_mortality) == (210101, "F", 3, "A", 2, 3, 4)
    assert (a.icu_stay_count, a.total_icu_los_days, a.had_icu_stay, a.lab_count, a.abnormal_lab_count, a.abnormal_lab_rate) == (2, 3.5, True, 4, 2, 0.5)
    assert (a.positive_culture_count, a.transfer_count, a.med_admin_count) == (2, 1, 0)
    assert (r[12].lab_count, r[12].abnormal_lab_rate, r[12].had_icu_stay, r[12].total_icu_los_days) == (1, 0.0, False, 0.0)
    assert (r[13].gender, r[13].admit_year_month, r[13].lab_count, r[13].abnormal_lab_rate) == (None, None, 0, None)


def test_patient_360(t):
    out = wide.patient_360(t)
    assert len(out.columns) == 25
    r = {x.subject_id: x for x in out.collect()}
    assert set(r) == {1, 2, 3}
    p = r[1]
    assert (p.total_admission_count, p.first_admit_time, p.most_recent_disch_time, p.ever_expired_in_hospital, p.total_readmission_count) == (2, D(2101, 1, 1), D(2101, 1, 16), True, 1)
    assert (p.total_diagnosis_count, p.distinct_diagnosis_count, p.total_icu_los_days, p.overall_abnormal_lab_rate, p.total_transfer_count) == (4, 4, 3.5, 0.5, 3)
    assert (r[3].total_admission_count, r[3].ever_expired_in_hospital, r[3].total_lab_count, r[3].overall_abnormal_lab_rate) == (0, False, 0, None)


def test_stay_features(t):
    out = wide.stay_features(t)
    assert len(out.columns) == 26
    r = {x.stay_id: x for x in out.collect()}
    s = r[100]
    assert (s.in_year_month, s.gender, s.hospital_expire_flag, s.total_intake_ml, s.total_output_ml, s.net_fluid_balance_ml) == (210101, "F", 0, 150.0, 30.0, 120.0)
    assert (s.chart_observation_count, s.abnormal_chart_count, s.abnormal_chart_rate, s.procedure_event_count, s.total_procedure_duration_minutes) == (2, 1, 0.5, 2, 30.0)
    assert (r[101].abnormal_chart_rate, r[101].datetime_event_count, r[101].net_fluid_balance_ml) == (0.0, 1, 0.0)
    assert (r[102].gender, r[102].chart_observation_count, r[102].abnormal_chart_rate) == (None, 0, None)


def test_touched_keys_expand_to_whole_months(spark, t):
    assert wide.touched_admissions(t, OLD, NEW).isEmpty() and wide.touched_patients(t, OLD, NEW).isEmpty() and wide.touched_stays(t, OLD, NEW).isEmpty()
    later = t | {"fact_transfer": t["fact_transfer"].unionByName(stamped(spark.createDataFrame([(11,)], "hadm_id long"), NEW))}
    touched = wide.touched_admissions(later, OLD, NEW)
    assert [r.hadm_id for r in touched.collect()] == [11]
    keys = wide.whole_partitions(wide.admission_base(later), touched, "hadm_id", "admit_year_month", t["obt_admission_features"])
    assert sorted(r.hadm_id for r in keys.collect()) == [10, 11]  # all admissions of the month
    new = wide.admission_features(later, keys)
    full = {r.hadm_id: r.transfer_count for r in wide.admission_features(later).collect()}
    assert {r.hadm_id: r.transfer_count for r in new.collect()} == {k: full[k] for k in (10, 11)} and full[11] == 3
    # a changed patient touches all admissions; an admission that moved to another month touches both months
    patient = t | {"dim_patient": t["dim_patient"].withColumn("updated_ts", F.when(F.col("subject_id") == 1, F.lit(NEW).cast("timestamp")).otherwise(F.col("updated_ts")))}
    assert sorted(r.hadm_id for r in wide.touched_admissions(patient, OLD, NEW).collect()) == [10, 11]
    moved = wide.admission_base(t).withColumn("admit_year_month", F.when(F.col("hadm_id") == 11, F.lit(210103)).otherwise(F.col("admit_year_month")))
    both = wide.whole_partitions(moved, spark.createDataFrame([(11,)], "hadm_id long"), "hadm_id", "admit_year_month", t["obt_admission_features"])
    assert sorted(r.hadm_id for r in both.collect()) == [10, 11, 12]
    stays = t | {"fact_datetime_event": t["fact_datetime_event"].withColumn("updated_ts", F.lit(NEW).cast("timestamp"))}
    assert [r.stay_id for r in wide.touched_stays(stays, OLD, NEW).collect()] == [101]
    assert [r.stay_id for r in wide.stay_features(t, wide.touched_stays(stays, OLD, NEW)).collect()] == [101]
