"""Gold tables as specs: a raw table is renamed and typed by rule, then gets date keys, lookups and measures.

A spec names only what the rules cannot know: the source, the grain, the date roles, the measures and the partition bucket.
`build` gives the DataFrame, `build_all` all tables in the order of their inputs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.functions import measures as M
from starweave.operators import joins, windows
from starweave.operators.refresh import bucket
from starweave.sources import io

# The published data model's names and types. Raw name to gold name, where they differ.
RENAMES = {
    "admittime": "admit_time", "dischtime": "disch_time", "deathtime": "death_time", "edregtime": "ed_reg_time", "edouttime": "ed_out_time", "charttime": "chart_time",
    "storetime": "store_time", "scheduletime": "schedule_time", "starttime": "start_time", "endtime": "end_time", "stoptime": "stop_time", "entertime": "enter_time",
    "verifiedtime": "verified_time", "ordertime": "order_time", "transfertime": "transfer_time", "intime": "in_time", "outtime": "out_time", "chartdate": "chart_date",
    "storedate": "store_date", "expirationdate": "expiration_date", "itemid": "item_id", "valuenum": "value_num", "valueuom": "value_uom", "amountuom": "amount_uom",
    "rateuom": "rate_uom", "totalamount": "total_amount", "totalamountuom": "total_amount_uom", "originalamount": "original_amount", "originalrate": "original_rate",
    "orderid": "order_id", "linkorderid": "link_order_id", "ordercategoryname": "order_category_name", "secondaryordercategoryname": "secondary_order_category_name",
    "ordercomponenttypedescription": "order_component_type_description", "ordercategorydescription": "order_category_description", "patientweight": "patient_weight",
    "isopenbag": "is_open_bag", "continueinnextdept": "continue_in_next_dept", "statusdescription": "status_description", "locationcategory": "location_category",
    "careunit": "care_unit", "eventtype": "event_type", "linksto": "links_to", "unitname": "unit_name", "lownormalvalue": "low_normal_value", "highnormalvalue": "high_normal_value",
}
# Gold types that differ from the raw ones.
TYPES = {
    **dict.fromkeys(("seq_num", "icd_version", "emar_seq", "poe_seq", "test_seq", "isolate_num", "warning", "hospital_expire_flag", "drg_severity", "drg_mortality", "is_open_bag", "continue_in_next_dept", "anchor_age", "anchor_year"), "int"),
    **dict.fromkeys(("quantity", "dose_due", "duration", "expiration_value", "fill_quantity", "form_val_disp", "doses_per_24_hrs", "basal_rate", "one_hr_max", "lockout_interval", "total_amount", "low_normal_value"), "double"),
    **dict.fromkeys(("expiration_date", "dod"), "date"), "category": "string", "icd_code": "string",
}


@dataclass
class TableSpec:
    source: str
    grain: list[str]
    dates: list[str] = field(default_factory=list)  # time columns that get a date key of the same role
    measures: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = None
    needs: tuple[str, ...] = ()
    bucket: tuple[str, int] | None = None
    types: dict[str, str] = field(default_factory=dict)


def gold_type(name: str, raw: str, own: dict[str, str]) -> str:
    if name in own or name in TYPES:
        return own.get(name) or TYPES[name]
    return "timestamp_ntz" if name.endswith(("_time", "_date")) else raw


def _role(column: str) -> str:
    return column.removesuffix("_time").removesuffix("_date") + "_date_key"


def build(spec: TableSpec, raw: DataFrame, tables: dict[str, DataFrame] | None = None, actor: str | None = None) -> DataFrame:
    names = [(s, RENAMES.get(s, s), t) for s, t in raw.dtypes]
    out = M.apply_mapping(raw, [(s, g, gold_type(g, t, spec.types)) for s, g, t in names])
    out = M.add_date_keys(out, [(_role(c), c) for c in spec.dates]) if spec.dates else out
    out = spec.measures(out, tables or {}) if spec.measures else out
    if spec.bucket:
        out = out.withColumn("bucket", bucket(*spec.bucket))
    return M.add_audit(out, actor) if actor else out


def _minutes(out: str, start: str, end: str):
    return lambda df, _: df.withColumn(out, M.duration(start, end, "minute"))


def _admission(df: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    df = joins.lookup(df, t["dim_patient"], "subject_id", "subject_id", ["anchor_age", "anchor_year"])
    df = df.withColumns({
        "hospital_los_hours": M.duration("admit_time", "disch_time", "hour"), "ed_los_minutes": M.duration("ed_reg_time", "ed_out_time", "minute"),
        "time_to_death_hours": M.duration("admit_time", "death_time", "hour"), "age_at_admission": M.age_at("anchor_age", "anchor_year", "admit_time"),
    }).drop("anchor_age", "anchor_year")
    df = windows.readmission(df, "subject_id", "admit_time", "disch_time", "hadm_id")
    return df.withColumnsRenamed({"is_repeat": "is_readmission_flag", "gap_days": "days_since_prior_discharge"})


def _lab(df: DataFrame, _) -> DataFrame:
    return df.withColumns({"result_turnaround_minutes": M.duration("chart_time", "store_time", "minute"), "is_abnormal_flag": M.abnormal("value_num", "ref_range_lower", "ref_range_upper")})


def _micro(df: DataFrame, _) -> DataFrame:
    return df.withColumns({"result_turnaround_minutes": M.duration("chart_time", "store_time", "minute"), "is_positive_culture_flag": M.present("org_name")})


def _chart(df: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    df = joins.lookup(df, t["dim_chart_item"], "item_id", "item_id", ["low_normal_value", "high_normal_value"])
    df = df.withColumns({"charting_delay_minutes": M.duration("chart_time", "store_time", "minute"), "is_abnormal_flag": M.abnormal("value_num", "low_normal_value", "high_normal_value")})
    return df.drop("low_normal_value", "high_normal_value")


def _stay(df: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    df = joins.lookup(df, t["fact_admission"], "hadm_id", "hadm_id", ["admit_time"])
    df = df.withColumn("time_to_icu_hours", M.duration("admit_time", "in_time", "hour")).drop("admit_time")
    return windows.repeat_flag(df, ["subject_id"], ["in_time", "stay_id"], "is_icu_readmission_flag")


def _transfer(df: DataFrame, _) -> DataFrame:
    return df.withColumn("transfer_duration_hours", M.duration("in_time", "out_time", "hour"))


_DELAY, _LASTED = _minutes("charting_delay_minutes", "chart_time", "store_time"), _minutes("duration_minutes", "start_time", "end_time")
_T, _SPAN = ["chart_time", "store_time"], ["start_time", "end_time", "store_time"]

DIMENSIONS = {
    "dim_hcpcs": TableSpec("d_hcpcs_raw", ["code"], types={"category": "long"}),
    "dim_diagnosis": TableSpec("d_icd_diagnoses_raw", ["icd_code", "icd_version"]),
    "dim_procedure": TableSpec("d_icd_procedures_raw", ["icd_code", "icd_version"]),
    "dim_lab_item": TableSpec("d_labitems_raw", ["item_id"]),
    "dim_patient": TableSpec("patients_raw", ["subject_id"]),
    "dim_provider": TableSpec("provider_raw", ["provider_id"]),
    "dim_caregiver": TableSpec("caregiver_raw", ["caregiver_id"]),
    "dim_chart_item": TableSpec("d_items_raw", ["item_id"]),
}
FACTS = {
    "fact_diagnosis": TableSpec("diagnoses_icd_raw", ["hadm_id", "seq_num"], bucket=("hadm_id", 16)),
    "fact_drg_assignment": TableSpec("drgcodes_raw", ["hadm_id", "drg_type", "drg_code"], bucket=("hadm_id", 8)),
    "fact_medication_administration": TableSpec("emar_raw", ["emar_id"], ["chart_time", "schedule_time", "store_time"], _minutes("admin_delay_minutes", "schedule_time", "chart_time"), bucket=("emar_seq", 32)),
    "fact_medication_administration_mini_detail": TableSpec("emar_detail_raw", ["emar_id", "emar_seq", "parent_field_ordinal"], types={"infusion_rate_adjustment_amount": "double"}, bucket=("emar_seq", 32)),
    "fact_hcpcs_event": TableSpec("hcpcsevents_raw", ["hadm_id", "seq_num"], ["chart_date"], bucket=("hadm_id", 4), types={"chart_date": "date"}),
    "fact_lab_result": TableSpec("labevents_raw", ["labevent_id"], _T, _lab, bucket=("labevent_id", 64)),
    "fact_microbiology_result": TableSpec("microbiologyevents_raw", ["microevent_id"], ["chart_date", "store_date"], _micro, bucket=("microevent_id", 8)),
    "fact_outpatient_measurement": TableSpec("omr_raw", ["subject_id", "chart_date", "seq_num", "result_name"], ["chart_date"], bucket=("subject_id", 8), types={"chart_date": "date"}),
    "fact_pharmacy_order": TableSpec("pharmacy_raw", ["pharmacy_id"], ["start_time", "stop_time", "enter_time", "verified_time"], bucket=("pharmacy_id", 16)),
    "fact_provider_order": TableSpec("poe_raw", ["poe_id"], ["order_time"], bucket=("poe_seq", 16)),
    "fact_provider_order_mini_detail": TableSpec("poe_detail_raw", ["poe_id", "field_name"], bucket=("poe_seq", 16)),
    "fact_prescription": TableSpec("prescriptions_raw", ["pharmacy_id", "drug_type", "drug"], ["start_time", "stop_time"], bucket=("pharmacy_id", 16)),
    "fact_procedure": TableSpec("procedures_icd_raw", ["hadm_id", "seq_num"], ["chart_date"], bucket=("hadm_id", 4), types={"chart_date": "date"}),
    "fact_service_assignment": TableSpec("services_raw", ["hadm_id", "transfer_time"], ["transfer_time"], bucket=("hadm_id", 4)),
    "fact_transfer": TableSpec("transfers_raw", ["transfer_id"], ["in_time", "out_time"], _transfer, bucket=("transfer_id", 8)),
    "fact_admission": TableSpec("admissions_raw", ["hadm_id"], ["admit_time", "disch_time", "death_time", "ed_reg_time", "ed_out_time"], _admission, ("dim_patient",), ("hadm_id", 4)),
    "fact_icu_stay_accumulating": TableSpec("icustays_raw", ["stay_id"], ["in_time", "out_time"], _stay, ("fact_admission",), ("stay_id", 4)),
    "fact_chart_observation": TableSpec("chartevents_raw", ["stay_id", "item_id", "chart_time"], _T, _chart, ("dim_chart_item",), ("stay_id", 8)),
    "fact_datetime_event": TableSpec("datetimeevents_raw", ["stay_id", "item_id", "chart_time"], _T, _DELAY, bucket=("stay_id", 8), types={"value": "timestamp_ntz"}),
    "fact_input_event": TableSpec("inputevents_raw", ["order_id", "item_id"], _SPAN, _LASTED, bucket=("order_id", 8)),
    "fact_ingredient_event": TableSpec("ingredientevents_raw", ["order_id", "item_id"], _SPAN, _LASTED, bucket=("order_id", 16)),
    "fact_output_event": TableSpec("outputevents_raw", ["stay_id", "item_id", "chart_time"], _T, _DELAY, bucket=("stay_id", 8)),
    "fact_procedure_event": TableSpec("procedureevents_raw", ["order_id"], _SPAN, _LASTED, bucket=("order_id", 4)),
}


# The published calendar's columns; dates of the model are shifted, so it marks no holidays and its fiscal year is
# the calendar's.
CALENDAR = {
    "date_key": "date_key", "full_date": "full_date", "day_of_week": "day_of_week", "day_name": "day_name", "day_of_month": "day_of_month", "day_of_year": "day_of_year",
    "week_of_year": "week_of_year", "week_start": "week_start_date", "week_end": "week_end_date", "month": "month_number", "month_name": "month_name",
    "month_start": "first_day_of_month", "month_end": "last_day_of_month", "quarter": "quarter_number", "year": "year", "is_weekend": "is_weekend",
}


def dim_date(spark: SparkSession, start: str = "2100-01-01", end: str = "2230-12-31", actor: str | None = None) -> DataFrame:
    """The calendar dimension: weeks begin on Sunday."""
    days = io.date_spine(spark, start, end, "sunday").select(*(F.col(s).alias(g) for s, g in CALENDAR.items()))
    out = days.withColumns({
        "day_name_short": F.date_format("full_date", "EEE"), "month_name_short": F.date_format("full_date", "MMM"), "quarter_name": F.concat(F.lit("Q"), F.col("quarter_number")),
        "is_weekday": ~F.col("is_weekend"), "is_holiday": F.lit(False), "holiday_name": F.lit(None).cast("string"),
        "fiscal_month": F.col("month_number"), "fiscal_quarter": F.col("quarter_number"), "fiscal_year": F.col("year"),
    })
    return M.add_audit(out, actor) if actor else out


def build_all(raws: dict[str, DataFrame], names: list[str] | None = None, actor: str | None = None) -> dict[str, DataFrame]:
    """The gold tables whose raw sources are given, each after the tables it needs."""
    specs, done = DIMENSIONS | FACTS, {}

    def make(name: str) -> None:
        if name in done:
            return
        spec = specs[name]
        for other in spec.needs:
            make(other)
        done[name] = build(spec, raws[spec.source], done, actor)

    for name in names or [n for n, s in specs.items() if s.source in raws]:
        make(name)
    return done


def balance_daily(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Fluid in and out per day and stay: only millilitres count, and only whole inputs (their ingredients are another table)."""
    ml = lambda c: F.lower(c) == "ml"
    i = inputs.where(ml("amount_uom")).groupBy(F.col("start_date_key").alias("date_key"), "stay_id").agg(F.sum("amount").alias("intake_ml"))
    o = outputs.where(ml("value_uom")).groupBy(F.col("chart_date_key").alias("date_key"), "stay_id").agg(F.sum("value").cast("double").alias("output_ml"))
    out = joins.full_merge({"in": i, "out": o}, ["date_key", "stay_id"], ["intake_ml", "output_ml"])
    return out.withColumn("net_ml", F.col("intake_ml") - F.col("output_ml")).withColumn("date_bucket", F.pmod("date_key", F.lit(64)))


def admission_daily(admissions: DataFrame) -> DataFrame:
    """Admitted, discharged and died per day and type, each by its own date role."""
    of = lambda key, n: admissions.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("date_key"), "admission_type").agg(F.count("*").cast("int").alias(n))
    frames = {"a": of("admit_date_key", "admissions"), "b": of("disch_date_key", "discharges"), "c": of("death_date_key", "deaths")}
    return joins.full_merge(frames, ["date_key", "admission_type"], ["admissions", "discharges", "deaths"]).withColumn("date_bucket", F.pmod("date_key", F.lit(64)))
