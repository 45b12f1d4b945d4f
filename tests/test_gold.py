"""Gold specs on tiny clinical-shaped raw tables; expected rows by hand."""

import datetime as dt

from pyspark.sql import functions as F

from starweave.plans import gold

TS = dt.datetime
ADM = "subject_id long, hadm_id long, admittime string, dischtime string, deathtime string, admission_type string, edregtime string, edouttime string, hospital_expire_flag long"


def raws(spark):
    return {
        "patients_raw": spark.createDataFrame([(1, "F", 60, 2100, "2008 - 2010", ""), (2, "M", 40, 2150, "2011 - 2013", "2151-01-02")], "subject_id long, gender string, anchor_age long, anchor_year long, anchor_year_group string, dod string"),
        "admissions_raw": spark.createDataFrame(
            [
                (1, 10, "2101-01-01 00:00:00", "2101-01-03 12:00:00", None, "EW EMER.", "2100-12-31 22:00:00", "2101-01-01 00:30:00", 0),
                (1, 11, "2101-02-03 11:59:59", "2101-02-01 00:00:00", None, "URGENT", "", "", 0),
                (2, 12, "2149-05-05 00:00:00", None, "2149-05-06 00:00:00", "URGENT", None, None, 1),
            ],
            ADM,
        ),
        "icustays_raw": spark.createDataFrame([(1, 10, 100, "2101-01-01 06:00:00", None), (1, 10, 101, "2101-01-02 06:00:00", "2101-01-03 06:00:00"), (9, 99, 102, "2101-01-02 06:00:00", "")], "subject_id long, hadm_id long, stay_id long, intime string, outtime string"),
        "labevents_raw": spark.createDataFrame([(1, 5, "2101-01-01 00:00:00", "2101-01-01 01:30:00", 3.0, 1.0, 3.0), (2, 5, "bad", "2101-01-01 01:30:00", 3.1, 1.0, 3.0), (3, 5, None, None, None, 1.0, 3.0)], "labevent_id long, itemid long, charttime string, storetime string, valuenum double, ref_range_lower double, ref_range_upper double"),
        "microbiologyevents_raw": spark.createDataFrame([(i, "2101-01-01", n) for i, n in enumerate(["", "  ", None, "E. COLI"])], "microevent_id long, chartdate string, org_name string").withColumns({"storedate": F.lit(None).cast("string"), "charttime": F.lit(None).cast("string"), "storetime": F.lit(None).cast("string")}),
        "inputevents_raw": spark.createDataFrame([(100, 1, "2101-01-01 01:00:00", "2101-01-01 02:00:00", None, 100.0, "ml"), (100, 2, "2101-01-01 03:00:00", None, None, 50.0, "ML"), (100, 3, "2101-01-01 03:00:00", None, None, 9.0, "mg")], "stay_id long, orderid long, starttime string, endtime string, storetime string, amount double, amountuom string"),
        "outputevents_raw": spark.createDataFrame([(100, 7, "2101-01-02 01:00:00", "2101-01-02 01:10:00", 30, "mL"), (100, 7, "2101-01-02 01:00:00", None, 5, None)], "stay_id long, itemid long, charttime string, storetime string, value long, valueuom string"),
        "d_icd_diagnoses_raw": spark.createDataFrame([("0010", 9, "x")], "icd_code string, icd_version long, long_title string"),
    }


def test_gold_tables(spark):
    t = gold.build_all(raws(spark), actor="test")
    a = {r.hadm_id: r for r in t["fact_admission"].collect()}
    assert (a[10].hospital_los_hours, a[10].ed_los_minutes, a[10].age_at_admission, a[10].is_readmission_flag, a[10].admit_date_key) == (60.0, 150.0, 61, False, 21010101)
    assert (a[11].is_readmission_flag, a[11].days_since_prior_discharge, a[11].ed_los_minutes, a[11].hospital_los_hours < 0) == (True, 30, None, True)
    assert (a[12].time_to_death_hours, a[12].disch_date_key, a[12].age_at_admission, a[12].is_readmission_flag) == (24.0, None, 39, False)
    s = {r.stay_id: (r.time_to_icu_hours, r.is_icu_readmission_flag) for r in t["fact_icu_stay_accumulating"].collect()}
    assert s == {100: (6.0, False), 101: (30.0, True), 102: (None, False)}
    lab = {r.labevent_id: (r.chart_time, r.result_turnaround_minutes, r.is_abnormal_flag) for r in t["fact_lab_result"].collect()}
    assert lab == {1: (TS(2101, 1, 1), 90.0, False), 2: (None, None, True), 3: (None, None, None)}
    assert {r.microevent_id: r.is_positive_culture_flag for r in t["fact_microbiology_result"].collect()} == {0: False, 1: False, 2: False, 3: True}
    assert t["dim_diagnosis"].first().icd_code == "0010" and dict(t["dim_patient"].dtypes)["dod"] == "date"
    assert {"created_ts", "updated_ts", "created_by", "updated_by", "bucket"} <= set(t["fact_admission"].columns)


def test_daily_aggregates(spark):
    t = gold.build_all(raws(spark))
    rows = {(r.date_key, r.stay_id): (r.intake_ml, r.output_ml, r.net_ml) for r in gold.balance_daily(t["fact_input_event"], t["fact_output_event"]).collect()}
    assert rows == {(21010101, 100): (150.0, 0.0, 150.0), (21010102, 100): (0.0, 30.0, -30.0)}
    daily = {(r.date_key, r.admission_type): (r.admissions, r.discharges, r.deaths) for r in gold.admission_daily(t["fact_admission"]).collect()}
    assert daily[21490506, "URGENT"] == (0, 0, 1) and daily[21010101, "EW EMER."] == (1, 0, 0) and daily[21010201, "URGENT"] == (0, 1, 0)


def test_every_spec_names_a_source_and_grain():
    specs = gold.DIMENSIONS | gold.FACTS
    assert len(gold.FACTS) == 23 and len(gold.DIMENSIONS) == 8 and all(s.source.endswith("_raw") and s.grain for s in specs.values())


def test_calendar_dimension(spark):
    rows = {r.date_key: r for r in gold.dim_date(spark, "2100-01-01", "2100-12-31").collect()}
    assert len(rows) == 365
    r = rows[21000210]  # a Wednesday
    assert (str(r.week_start_date), str(r.week_end_date), r.day_name_short, r.month_name_short, r.quarter_name) == ("2100-02-07", "2100-02-13", "Wed", "Feb", "Q1")
    assert r.is_weekday and not r.is_weekend and not r.is_holiday and r.holiday_name is None and (r.fiscal_month, r.fiscal_quarter, r.fiscal_year) == (2, 1, 2100)
    assert rows[21000207].week_start_date == rows[21000207].full_date and rows[21000213].is_weekend
