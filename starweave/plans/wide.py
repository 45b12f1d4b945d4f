"""Wide clinical tables: one row an admission, patient or stay.

Every child shrinks to one row a key before it joins, so a key of the base stays unique whatever its children hold. `only` limits a
build to some keys: the base and all children meet it by semi-joins, so a refresh reads in proportion to what it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.functions import measures as M
from starweave.operators import joins
from starweave.operators.many_sources import Outcome, Source, by_column, refresh_many
from starweave.operators.refresh import bucket, changed, touched_keys

Tables = dict[str, DataFrame]
ADMISSION_SOURCES = ("fact_admission", "fact_diagnosis", "fact_procedure", "fact_drg_assignment", "fact_icu_stay_accumulating", "fact_lab_result", "fact_medication_administration", "fact_microbiology_result", "fact_transfer")
STAY_SOURCES = ("fact_icu_stay_accumulating", "fact_input_event", "fact_output_event", "fact_chart_observation", "fact_datetime_event", "fact_procedure_event")


def _n(name: str) -> Column:
    return F.count("*").cast("int").alias(name)


def _among(df: DataFrame, only: DataFrame | None, key: str) -> DataFrame:
    return df if only is None else df.join(only.select(key), key, "left_semi")


def whole_partitions(base: DataFrame, touched: DataFrame, key: str, partition: str, current: DataFrame | None = None) -> DataFrame:
    """Keys of every partition that a touched key is in, or was in by the target as written: what a partition-scoped overwrite
    must rebuild. Stays a DataFrame."""
    parts = base.join(touched, key, "left_semi").select(partition)
    if current is not None:
        parts = parts.union(current.join(touched, key, "left_semi").select(partition))
    return base.join(parts.distinct(), partition, "left_semi").select(key).union(touched.select(key)).distinct()


def admission_base(t: Tables) -> DataFrame:
    return t["fact_admission"].withColumn("admit_year_month", M.year_month("admit_date_key"))


def stay_base(t: Tables) -> DataFrame:
    return t["fact_icu_stay_accumulating"].withColumn("in_year_month", M.year_month("in_date_key"))


def touched_admissions(t: Tables, low: str, high: str) -> DataFrame:
    """Admissions of which a row of any source changed in (low, high]; a changed patient touches all of theirs."""
    patients = changed(t["dim_patient"], low, high).select("subject_id")
    by_patient = t["fact_admission"].join(patients, "subject_id", "left_semi")
    return touched_keys([(changed(t[n], low, high), "hadm_id") for n in ADMISSION_SOURCES] + [(by_patient, "hadm_id")], "hadm_id")


def touched_stays(t: Tables, low: str, high: str) -> DataFrame:
    """Stays of which a row of any source changed; changed admission features touch the stays of the admission."""
    of_admission = t["fact_icu_stay_accumulating"].join(changed(t["obt_admission_features"], low, high).select("hadm_id"), "hadm_id", "left_semi")
    return touched_keys([(changed(t[n], low, high), "stay_id") for n in STAY_SOURCES] + [(of_admission, "stay_id")], "stay_id")


def touched_patients(t: Tables, low: str, high: str) -> DataFrame:
    return touched_keys([(changed(t[n], low, high), "subject_id") for n in ("dim_patient", "obt_admission_features", "fact_diagnosis")], "subject_id")


def admission_features(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """obt_admission_features: context, diagnoses, procedures, severity, stays, laboratory, medication, cultures, transfers."""
    child = lambda name, *aggs: (_among(t[name], only, "hadm_id"), "hadm_id", list(aggs))
    base = joins.lookup(_among(admission_base(t), only, "hadm_id"), t["dim_patient"], "subject_id", "subject_id", ["gender", "anchor_year_group", "dod"])
    children = {
        "diagnosis": child("fact_diagnosis", _n("diagnosis_count"), F.min(F.when(F.col("seq_num") == 1, F.col("icd_code"))).alias("primary_icd_code")),
        "procedure": child("fact_procedure", _n("procedure_count")),
        "drg": child("fact_drg_assignment", F.max("drg_severity").alias("max_drg_severity"), F.max("drg_mortality").alias("max_drg_mortality")),
        "icu": child("fact_icu_stay_accumulating", _n("icu_stay_count"), F.sum("los").alias("total_icu_los_days")),
        "lab": child("fact_lab_result", _n("lab_count"), M.sum_flag("is_abnormal_flag").alias("abnormal_lab_count")),
        "med": child("fact_medication_administration", _n("med_admin_count")),
        "micro": child("fact_microbiology_result", M.sum_flag("is_positive_culture_flag").alias("positive_culture_count")),
        "transfer": child("fact_transfer", _n("transfer_count")),
    }
    counts = ("diagnosis_count", "procedure_count", "icu_stay_count", "lab_count", "abnormal_lab_count", "med_admin_count", "positive_culture_count", "transfer_count")
    out = joins.star_rollup(base, children, "hadm_id", dict.fromkeys(counts, 0) | {"total_icu_los_days": 0.0})
    now = F.current_timestamp()
    return out.select(
        "hadm_id", "subject_id", "admit_provider_id", "admit_year_month", "admit_date_key", "admit_time", "disch_time", "death_time", "admission_type", "admission_location", "discharge_location",
        "insurance", "language", "marital_status", "race", "hospital_expire_flag", "hospital_los_hours", "ed_los_minutes", "time_to_death_hours", "age_at_admission", "is_readmission_flag",
        "days_since_prior_discharge", "gender", "anchor_year_group", "dod", "diagnosis_count", "primary_icd_code", "procedure_count", "max_drg_severity", "max_drg_mortality", "icu_stay_count",
        "total_icu_los_days", (F.col("icu_stay_count") > 0).alias("had_icu_stay"), "lab_count", "abnormal_lab_count", M.share(F.col("abnormal_lab_count"), F.col("lab_count")).alias("abnormal_lab_rate"),
        "med_admin_count", "positive_culture_count", "transfer_count", now.alias("created_ts"), now.alias("updated_ts"),
    )


def patient_360(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """obt_patient_360: a roll-up of admission features; codes are counted over all admissions, which sums cannot give."""
    total = lambda c, name: F.sum(c).cast("int").alias(name)
    sums = {
        "diagnosis_count": "total_diagnosis_count", "procedure_count": "total_procedure_count", "icu_stay_count": "total_icu_stay_count", "lab_count": "total_lab_count",
        "abnormal_lab_count": "total_abnormal_lab_count", "med_admin_count": "total_med_admin_count", "positive_culture_count": "total_positive_culture_count", "transfer_count": "total_transfer_count",
    }
    admissions = [
        _n("total_admission_count"), F.min("admit_time").alias("first_admit_time"), F.max("admit_time").alias("most_recent_admit_time"), F.max("disch_time").alias("most_recent_disch_time"),
        (F.max("hospital_expire_flag") == 1).alias("ever_expired_in_hospital"), M.sum_flag("is_readmission_flag").alias("total_readmission_count"),
        *(total(c, n) for c, n in sums.items()), F.sum("total_icu_los_days").alias("total_icu_los_days"),
    ]
    children = {
        "admissions": (_among(t["obt_admission_features"], only, "subject_id"), "subject_id", admissions),
        "codes": (_among(t["fact_diagnosis"], only, "subject_id"), "subject_id", [F.count_distinct("icd_code").cast("int").alias("distinct_diagnosis_count")]),
    }
    zero = dict.fromkeys(["total_admission_count", "total_readmission_count", "distinct_diagnosis_count", *sums.values()], 0) | {"ever_expired_in_hospital": False, "total_icu_los_days": 0.0}
    out = joins.star_rollup(_among(t["dim_patient"], only, "subject_id"), children, "subject_id", zero)
    now = F.current_timestamp()
    return out.select(
        "subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod", "total_admission_count", "first_admit_time", "most_recent_admit_time", "most_recent_disch_time",
        "ever_expired_in_hospital", "total_readmission_count", "total_diagnosis_count", "distinct_diagnosis_count", "total_procedure_count", "total_icu_stay_count", "total_icu_los_days", "total_lab_count",
        "total_abnormal_lab_count", M.share(F.col("total_abnormal_lab_count"), F.col("total_lab_count")).alias("overall_abnormal_lab_rate"), "total_med_admin_count", "total_positive_culture_count",
        "total_transfer_count", now.alias("created_ts"), now.alias("updated_ts"),
    )


def stay_features(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """obt_icu_stay_features: the stay, its admission's context, fluid balance, observations, dated events and procedures.
    t has the daily balance under agg_icu_fluid_balance_daily."""
    child = lambda name, *aggs: (_among(t[name], only, "stay_id"), "stay_id", list(aggs))
    base = joins.lookup(_among(stay_base(t), only, "stay_id"), t["obt_admission_features"], "hadm_id", "hadm_id", ["age_at_admission", "gender", "hospital_expire_flag"])
    children = {
        "fluid": child("agg_icu_fluid_balance_daily", F.sum("intake_ml").alias("total_intake_ml"), F.sum("output_ml").alias("total_output_ml")),
        "chart": child("fact_chart_observation", _n("chart_observation_count"), M.sum_flag("is_abnormal_flag").alias("abnormal_chart_count")),
        "dated": child("fact_datetime_event", _n("datetime_event_count")),
        "procedures": child("fact_procedure_event", _n("procedure_event_count"), F.sum("duration_minutes").alias("total_procedure_duration_minutes")),
    }
    zero = dict.fromkeys(("chart_observation_count", "abnormal_chart_count", "datetime_event_count", "procedure_event_count"), 0)
    zero |= dict.fromkeys(("total_intake_ml", "total_output_ml", "total_procedure_duration_minutes"), 0.0)
    out = joins.star_rollup(base, children, "stay_id", zero)
    now = F.current_timestamp()
    return out.select(
        "stay_id", "subject_id", "hadm_id", "first_careunit", "last_careunit", "in_year_month", "in_date_key", "in_time", "out_time", "los", "time_to_icu_hours", "is_icu_readmission_flag",
        "age_at_admission", "gender", "hospital_expire_flag", "total_intake_ml", "total_output_ml", (F.col("total_intake_ml") - F.col("total_output_ml")).alias("net_fluid_balance_ml"),
        "chart_observation_count", "abnormal_chart_count", M.share(F.col("abnormal_chart_count"), F.col("chart_observation_count")).alias("abnormal_chart_rate"), "datetime_event_count",
        "procedure_event_count", "total_procedure_duration_minutes", now.alias("created_ts"), now.alias("updated_ts"),
    )


# -- refresh: one bound a source, whole partitions, one commit

PATIENT_BUCKETS = 64


def refresh_admissions(spark: SparkSession, path: str, t: Tables, **how) -> Outcome:
    """obt_admission_features by month of admission: a changed row of any source touches its admission, a patient all of theirs."""
    of_patient = lambda d: t["fact_admission"].join(d.select("subject_id").distinct(), "subject_id", "left_semi").select("hadm_id")
    sources = {n: by_column(t[n], "hadm_id") for n in ADMISSION_SOURCES} | {"dim_patient": Source(t["dim_patient"], of_patient)}
    return refresh_many(spark, path, sources, admission_base(t), "hadm_id", "admit_year_month", lambda only: admission_features(t, only), **how)


def refresh_patients(spark: SparkSession, path: str, t: Tables, **how) -> Outcome:
    """obt_patient_360 by a hash bucket of the patient. t has the refreshed obt_admission_features."""
    placed = lambda df: df.withColumn("subject_bucket", bucket("subject_id", PATIENT_BUCKETS))
    sources = {n: by_column(t[n], "subject_id") for n in ("dim_patient", "obt_admission_features", "fact_diagnosis")}
    return refresh_many(spark, path, sources, placed(t["dim_patient"]), "subject_id", "subject_bucket", lambda only: placed(patient_360(t, only)), **how)


def refresh_stays(spark: SparkSession, path: str, t: Tables, **how) -> Outcome:
    """obt_icu_stay_features by month of the stay; changed admission features touch the stays of the admission."""
    of_admission = lambda d: t["fact_icu_stay_accumulating"].join(d.select("hadm_id").distinct(), "hadm_id", "left_semi").select("stay_id")
    sources = {n: by_column(t[n], "stay_id") for n in STAY_SOURCES} | {"obt_admission_features": Source(t["obt_admission_features"], of_admission)}
    return refresh_many(spark, path, sources, stay_base(t), "stay_id", "in_year_month", lambda only: stay_features(t, only), **how)
