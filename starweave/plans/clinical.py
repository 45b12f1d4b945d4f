"""Registered queries of the clinical tables: raw tables derived from the star tables, as text where the raw files have text,
built to gold tables by their specs and to the wide tables.

Roles: customer is the patient, orders the admission (and, every third, a stay), lineitem its events, part the items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.operators import joins
from starweave.plans import gold, notes, wide
from starweave.plans.registry import Registry, Tables

R = Registry()
q = R.query
C = F.col

_TEXT = "CAST({} AS STRING)"
_AT = lambda column, hours: _TEXT.format(f"{column} {'-' if hours < 0 else '+'} INTERVAL {abs(hours)} HOUR" if hours else column)
_LINE, _LINES = "l_orderkey * 10 + l_linenumber", "{lineitem}"
_STAYS = "{lineitem} WHERE l_orderkey % 3 = 0"
_SHIP, _STORED, _ENDED = _AT("l_shipdate", 0), f"CASE WHEN l_partkey % 11 <> 0 THEN {_AT('l_shipdate', 2)} ELSE '' END", f"CASE WHEN l_partkey % 7 <> 0 THEN {_AT('l_shipdate', 9)} END"

#: Raw table to its rows, in SQL that Spark and DuckDB both read; {name} is a star table.
RAW = {
    "patients_raw": "SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, 20 + c_custkey % 60 AS anchor_age, 1980 + c_custkey % 15 AS anchor_year, '2008 - 2010' AS anchor_year_group, CASE WHEN c_custkey % 9 = 0 THEN '2001-01-01' ELSE '' END AS dod FROM {customer}",
    "admissions_raw": f"""SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, {_AT("o_orderdate", 0)} AS admittime, CASE WHEN o_orderkey % 10 <> 0 THEN {_AT("o_orderdate", 52)} END AS dischtime,
 CASE WHEN o_orderkey % 50 = 1 THEN {_AT("o_orderdate", 30)} END AS deathtime, o_orderpriority AS admission_type, o_orderstatus AS admit_provider_id, 'ER' AS admission_location, 'HOME' AS discharge_location, 'Other' AS insurance,
 'EN' AS language, 'X' AS marital_status, 'Y' AS race, {_AT("o_orderdate", -3)} AS edregtime, {_AT("o_orderdate", 0)} AS edouttime, CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS hospital_expire_flag FROM {{orders}}""",
    "icustays_raw": f"SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderkey * 10 AS stay_id, 'MICU' AS first_careunit, o_orderstatus AS last_careunit, {_AT('o_orderdate', 5)} AS intime, {_AT('o_orderdate', 41)} AS outtime, CAST(1.5 AS DOUBLE) AS los FROM {{orders}} WHERE o_orderkey % 3 = 0",
    "diagnoses_icd_raw": f"SELECT o_custkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num, p_brand AS icd_code, 10 AS icd_version FROM {_LINES} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey",
    "procedures_icd_raw": f"SELECT l_suppkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num, {_SHIP} AS chartdate, l_returnflag AS icd_code, 9 AS icd_version FROM {_LINES} WHERE l_linenumber < 3",
    "drgcodes_raw": "SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, 'APR' AS drg_type, o_orderpriority AS drg_code, o_orderkey % 4 AS drg_severity, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 END AS drg_mortality FROM {orders}",
    "emar_raw": f"SELECT l_suppkey AS subject_id, l_orderkey AS hadm_id, {_TEXT.format(_LINE)} AS emar_id, l_linenumber AS emar_seq, {_SHIP} AS charttime, {_AT('l_shipdate', -1)} AS scheduletime, {_STORED} AS storetime FROM {_LINES} WHERE l_returnflag = 'A'",
    "emar_detail_raw": f"SELECT {_TEXT.format(_LINE)} AS emar_id, l_linenumber AS emar_seq, '1.1' AS parent_field_ordinal, {_TEXT.format('l_quantity')} AS infusion_rate_adjustment_amount FROM {_LINES} WHERE l_returnflag = 'A'",
    "hcpcsevents_raw": f"SELECT l_suppkey AS subject_id, l_orderkey AS hadm_id, l_linenumber AS seq_num, {_SHIP} AS chartdate, l_linestatus AS hcpcs_cd FROM {_LINES} WHERE l_linenumber = 1",
    "labevents_raw": f"SELECT {_LINE} AS labevent_id, l_orderkey AS hadm_id, l_partkey AS itemid, {_SHIP} AS charttime, {_STORED} AS storetime, l_quantity AS valuenum, CAST(10 AS DOUBLE) AS ref_range_lower, CASE WHEN l_linenumber <> 2 THEN CAST(40 AS DOUBLE) END AS ref_range_upper FROM {_LINES}",
    "microbiologyevents_raw": f"SELECT {_LINE} AS microevent_id, l_orderkey AS hadm_id, {_SHIP} AS chartdate, {_STORED} AS storedate, {_SHIP} AS charttime, {_STORED} AS storetime, CASE WHEN l_returnflag = 'R' THEN 'E. COLI' WHEN l_returnflag = 'A' THEN ' ' END AS org_name FROM {_LINES}",
    "omr_raw": f"SELECT user_id AS subject_id, {_AT('ts', 0)} AS chartdate, event_id AS seq_num, event_type AS result_name, {_TEXT.format('user_id')} AS result_value FROM {{events}}",
    "pharmacy_raw": f"SELECT {_LINE} AS pharmacy_id, l_orderkey AS hadm_id, {_SHIP} AS starttime, {_ENDED} AS stoptime, {_SHIP} AS entertime, {_STORED} AS verifiedtime FROM {_LINES}",
    "poe_raw": f"SELECT {_TEXT.format(_LINE)} AS poe_id, l_linenumber AS poe_seq, l_orderkey AS hadm_id, {_SHIP} AS ordertime FROM {_LINES}",
    "poe_detail_raw": f"SELECT {_TEXT.format(_LINE)} AS poe_id, l_linenumber AS poe_seq, l_returnflag AS field_name, l_linestatus AS field_value FROM {_LINES}",
    "prescriptions_raw": f"SELECT {_LINE} AS pharmacy_id, l_orderkey AS hadm_id, 'MAIN' AS drug_type, l_returnflag AS drug, {_SHIP} AS starttime, {_ENDED} AS stoptime FROM {_LINES}",
    "services_raw": f"SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, {_AT('o_orderdate', 1)} AS transfertime, o_orderstatus AS curr_service FROM {{orders}}",
    "transfers_raw": f"SELECT {_LINE} AS transfer_id, l_orderkey AS hadm_id, {_SHIP} AS intime, {_ENDED} AS outtime FROM {_LINES} WHERE l_linenumber < 4",
    "chartevents_raw": f"SELECT l_orderkey * 10 AS stay_id, l_partkey AS itemid, {_SHIP} AS charttime, {_STORED} AS storetime, l_quantity AS valuenum FROM {_STAYS}",
    "datetimeevents_raw": f"SELECT l_orderkey * 10 AS stay_id, l_partkey AS itemid, {_SHIP} AS charttime, {_STORED} AS storetime, {_AT('l_shipdate', 3)} AS value FROM {_STAYS} AND l_linenumber = 1",
    "inputevents_raw": f"SELECT l_orderkey * 10 AS stay_id, {_LINE} AS orderid, l_partkey AS itemid, {_SHIP} AS starttime, {_ENDED} AS endtime, {_STORED} AS storetime, l_quantity AS amount, CASE WHEN l_linenumber = 2 THEN 'mg' ELSE 'ML' END AS amountuom FROM {_STAYS}",
    "ingredientevents_raw": f"SELECT l_orderkey * 10 AS stay_id, {_LINE} AS orderid, l_partkey AS itemid, {_SHIP} AS starttime, {_ENDED} AS endtime, {_STORED} AS storetime, l_tax AS amount FROM {_STAYS}",
    "outputevents_raw": f"SELECT l_orderkey * 10 AS stay_id, l_partkey AS itemid, {_SHIP} AS charttime, {_STORED} AS storetime, l_quantity AS value, 'ml' AS valueuom FROM {_STAYS} AND l_returnflag = 'R'",
    "procedureevents_raw": f"SELECT l_orderkey * 10 AS stay_id, {_LINE} AS orderid, {_SHIP} AS starttime, {_ENDED} AS endtime, {_STORED} AS storetime FROM {_STAYS} AND l_linenumber = 3",
    "d_hcpcs_raw": "SELECT DISTINCT l_linestatus AS code, '7' AS category, l_linestatus AS short_description FROM {lineitem}",
    "d_icd_diagnoses_raw": "SELECT DISTINCT p_brand AS icd_code, 10 AS icd_version, p_brand AS long_title FROM {part}",
    "d_icd_procedures_raw": "SELECT DISTINCT l_returnflag AS icd_code, 9 AS icd_version, l_returnflag AS long_title FROM {lineitem}",
    "d_labitems_raw": "SELECT p_partkey AS itemid, p_name AS label, p_brand AS fluid, p_type AS category FROM {part}",
    "provider_raw": "SELECT DISTINCT o_orderstatus AS provider_id FROM {orders}",
    "caregiver_raw": "SELECT s_suppkey AS caregiver_id FROM {supplier}",
    "d_items_raw": "SELECT p_partkey AS itemid, p_name AS label, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS lownormalvalue, CASE WHEN p_size % 4 > 0 THEN CAST(p_size + 20 AS DOUBLE) END AS highnormalvalue FROM {part}",
}
_STARS = ("customer", "orders", "lineitem", "part", "events", "supplier")


def raws(t: Tables) -> dict[str, DataFrame]:
    stars = {n: getattr(t, n) for n in _STARS}
    spark = stars["orders"].sparkSession
    return {n: spark.sql(text, **{s: df for s, df in stars.items() if f"{{{s}}}" in text}) for n, text in RAW.items()}


def _sql(name: str) -> str:
    return "(" + RAW[name].format(**{s: s for s in _STARS}) + ")"


def _seconds(a: str, b: str, unit: int) -> str:
    return f"date_sub('second', TRY_CAST({a} AS TIMESTAMP), TRY_CAST({b} AS TIMESTAMP)) / {unit}.0"


_ABNORMAL = "CASE WHEN v IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL THEN CAST(v < lo OR v > hi AS INTEGER) END"
_TURN, _LAST = _seconds("charttime", "storetime", 60), _seconds("starttime", "endtime", 60)
#: Gold table to its measures, and what SQL says they are on the raw rows.
MEASURES = {
    "fact_medication_administration": (["admin_delay_minutes"], _seconds("scheduletime", "charttime", 60)),
    "fact_medication_administration_mini_detail": (["infusion_rate_adjustment_amount"], "CAST(infusion_rate_adjustment_amount AS DOUBLE)"),
    "fact_microbiology_result": (["result_turnaround_minutes", "is_positive_culture_flag"], f"coalesce({_TURN}, 0) + CAST(coalesce(trim(org_name), '') <> '' AS INTEGER)"),
    "fact_transfer": (["transfer_duration_hours"], _seconds("intime", "outtime", 3600)),
    "fact_datetime_event": (["charting_delay_minutes"], _TURN), "fact_output_event": (["charting_delay_minutes"], _TURN),
    "fact_input_event": (["duration_minutes"], _LAST), "fact_ingredient_event": (["duration_minutes"], _LAST), "fact_procedure_event": (["duration_minutes"], _LAST),
    "fact_admission": (["hospital_los_hours", "ed_los_minutes", "time_to_death_hours"], f"coalesce({_seconds('admittime', 'dischtime', 3600)}, 0) + {_seconds('edregtime', 'edouttime', 60)} + coalesce({_seconds('admittime', 'deathtime', 3600)}, 0)"),
    "fact_icu_stay_accumulating": (["time_to_icu_hours"], "5.0"),
}
_BACK = {gold_name: raw for raw, gold_name in gold.RENAMES.items()}
_SPECS = gold.DIMENSIONS | gold.FACTS


def _summary_sql(name: str) -> str:
    spec = _SPECS[name]
    key = f"CAST(strftime(TRY_CAST({_BACK.get(spec.dates[0], spec.dates[0])} AS TIMESTAMP), '%Y%m%d') AS INTEGER)" if spec.dates else "CAST(NULL AS INTEGER)"
    said = MEASURES.get(name, ([], "0.0"))[1]
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, count({key}) AS n_keys, CAST(sum({key}) AS BIGINT) AS keys, round(CAST(coalesce(sum({said}), 0) AS DOUBLE), 2) AS measures FROM {_sql(spec.source)}"


# the observations' bounds come from the items
_CHARTED = f"""SELECT 'fact_chart_observation' AS table_name, count(*) AS n_rows, count(k) AS n_keys, CAST(sum(k) AS BIGINT) AS keys, round(CAST(coalesce(sum(coalesce({_TURN}, 0) + coalesce({_ABNORMAL}, 0)), 0) AS DOUBLE), 2) AS measures FROM
 (SELECT c.*, valuenum AS v, lownormalvalue AS lo, highnormalvalue AS hi, CAST(strftime(TRY_CAST(charttime AS TIMESTAMP), '%Y%m%d') AS INTEGER) AS k FROM {_sql("chartevents_raw")} c LEFT JOIN {_sql("d_items_raw")} i ON c.itemid = i.itemid)"""
_LAB = f"""SELECT 'fact_lab_result' AS table_name, count(*) AS n_rows, count(k) AS n_keys, CAST(sum(k) AS BIGINT) AS keys, round(CAST(coalesce(sum(coalesce({_TURN}, 0) + coalesce({_ABNORMAL}, 0)), 0) AS DOUBLE), 2) AS measures FROM
 (SELECT *, valuenum AS v, ref_range_lower AS lo, ref_range_upper AS hi, CAST(strftime(TRY_CAST(charttime AS TIMESTAMP), '%Y%m%d') AS INTEGER) AS k FROM {_sql("labevents_raw")})"""
_BY_HAND = {"fact_chart_observation": _CHARTED, "fact_lab_result": _LAB}
_MEASURED = {n: m[0] for n, m in MEASURES.items()} | {"fact_chart_observation": ["charting_delay_minutes", "is_abnormal_flag"], "fact_lab_result": ["result_turnaround_minutes", "is_abnormal_flag"]}


@q("gold_tables", " UNION ALL ".join(_BY_HAND.get(n) or _summary_sql(n) for n in _SPECS))
def _(t):
    """Every dimension and fact of the specs: rows, keys of the first date role, and the sum of its measures."""
    tables = gold.build_all(raws(t))

    def summary(name: str) -> DataFrame:
        df, spec = tables[name], _SPECS[name]
        key = C(gold._role(spec.dates[0])) if spec.dates else F.lit(None).cast("int")
        said = reduce(lambda a, b: a + b, (F.coalesce(C(m).cast("double"), F.lit(0.0)) for m in _MEASURED.get(name, [])), F.lit(0.0))
        return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.count(key).alias("n_keys"), F.sum(key).cast("long").alias("keys"), F.round(F.coalesce(F.sum(said), F.lit(0.0)), 2).alias("measures"))

    return reduce(DataFrame.union, (summary(n) for n in _SPECS))


def _stay_facts(t: Tables) -> dict[str, DataFrame]:
    tables = gold.build_all(raws(t))
    return tables | {"agg_icu_fluid_balance_daily": gold.balance_daily(tables["fact_input_event"], tables["fact_output_event"])}


@q("clinical_admissions", f"""WITH a AS (SELECT *, TRY_CAST(admittime AS TIMESTAMP) AS a, TRY_CAST(dischtime AS TIMESTAMP) AS d FROM {_sql("admissions_raw")}), w AS (SELECT *, lag(d) OVER (PARTITION BY subject_id ORDER BY a, hadm_id) AS before FROM a)
 SELECT w.hadm_id, CAST(strftime(a, '%Y%m') AS INTEGER) AS admit_year_month, gender, CAST(anchor_age + year(a) - anchor_year AS INTEGER) AS age_at_admission, before IS NOT NULL AS is_readmission_flag, coalesce(n_diagnosis, 0) AS diagnosis_count, primary_icd_code,
 coalesce(n_procedure, 0) AS procedure_count, w.hadm_id % 3 = 0 AS had_icu_stay, CAST(CASE WHEN w.hadm_id % 3 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS total_icu_los_days, coalesce(n_lab, 0) AS lab_count, coalesce(n_high, 0) AS abnormal_lab_count,
 coalesce(n_culture, 0) AS positive_culture_count, coalesce(n_transfer, 0) AS transfer_count, coalesce(n_med, 0) AS med_admin_count
 FROM w LEFT JOIN {_sql("patients_raw")} p USING (subject_id)
 LEFT JOIN (SELECT hadm_id, CAST(count(*) AS INTEGER) AS n_diagnosis, min(icd_code) FILTER (WHERE seq_num = 1) AS primary_icd_code FROM {_sql("diagnoses_icd_raw")} GROUP BY 1) x ON x.hadm_id = w.hadm_id
 LEFT JOIN (SELECT l_orderkey AS k, CAST(count_if(l_linenumber < 3) AS INTEGER) AS n_procedure, CAST(count(*) AS INTEGER) AS n_lab, CAST(count_if(l_linenumber <> 2 AND (l_quantity < 10 OR l_quantity > 40)) AS BIGINT) AS n_high, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS n_culture,
  CAST(count_if(l_linenumber < 4) AS INTEGER) AS n_transfer, CAST(count_if(l_returnflag = 'A') AS INTEGER) AS n_med FROM lineitem GROUP BY 1) y ON y.k = w.hadm_id""")
def _(t):
    out = wide.admission_features(_stay_facts(t))
    return out.select(
        "hadm_id", "admit_year_month", "gender", "age_at_admission", "is_readmission_flag", "diagnosis_count", "primary_icd_code", "procedure_count", "had_icu_stay", "total_icu_los_days", "lab_count",
        "abnormal_lab_count", "positive_culture_count", "transfer_count", "med_admin_count",
    )


@q("clinical_stays", f"""SELECT s.stay_id, round(coalesce(fed, 0), 4) AS total_intake_ml, round(coalesce(gone, 0), 4) AS total_output_ml, coalesce(n_chart, 0) AS chart_observation_count, coalesce(n_high, 0) AS abnormal_chart_count, coalesce(n_dated, 0) AS datetime_event_count, coalesce(n_done, 0) AS procedure_event_count
 FROM {_sql("icustays_raw")} s LEFT JOIN (SELECT l_orderkey * 10 AS k, sum(CASE WHEN l_linenumber <> 2 THEN l_quantity END) AS fed, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS gone, CAST(count(*) AS INTEGER) AS n_chart,
  CAST(count_if(p_size % 5 > 0 AND p_size % 4 > 0 AND (l_quantity < p_size OR l_quantity > p_size + 20)) AS BIGINT) AS n_high, CAST(count_if(l_linenumber = 1) AS INTEGER) AS n_dated, CAST(count_if(l_linenumber = 3) AS INTEGER) AS n_done
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1) e ON e.k = s.stay_id""")
def _(t):
    tables = _stay_facts(t)
    tables["obt_admission_features"] = joins.lookup(tables["fact_admission"], tables["dim_patient"], "subject_id", "subject_id", ["gender"])
    out = wide.stay_features(tables)
    return out.select("stay_id", F.round("total_intake_ml", 4).alias("total_intake_ml"), F.round("total_output_ml", 4).alias("total_output_ml"), "chart_observation_count", "abnormal_chart_count", "datetime_event_count", "procedure_event_count")


_NOTES = "SELECT conv_id % 500 AS subject_id, conv_id AS hadm_id, turn AS note_seq, text, CAST(turn AS STRING) AS charttime, CASE WHEN turn % 2 = 0 THEN '2101-01-02 00:00:00' ELSE 'unknown' END AS storetime FROM {conversations}"


@q("note_tables", f"""SELECT name, subject_id, hadm_id, admit_provider_id, admit_date_key, sha256(text) AS text_sha256, notes_count, last_storetime FROM (SELECT CASE WHEN role = 'user' THEN 'fact_discharge_note' ELSE 'fact_radiology_note' END AS name, conv_id % 500 AS subject_id, conv_id AS hadm_id,
 coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn, text), '') AS text, count(*) AS notes_count, max(CASE WHEN turn % 2 = 0 THEN TIMESTAMP '2101-01-02 00:00:00' END) AS last_storetime FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2, 3)
 LEFT JOIN (SELECT o_orderkey, o_orderstatus AS admit_provider_id, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS admit_date_key FROM orders) ON o_orderkey = hadm_id""")
def _(t):
    spark = t.conversations.sparkSession
    admissions = gold.build_all({"admissions_raw": raws(t)["admissions_raw"], "patients_raw": raws(t)["patients_raw"]})["fact_admission"]
    kinds = {"fact_discharge_note": "role = 'user'", "fact_radiology_note": "role <> 'user' OR role IS NULL"}
    tables = (notes.note_table(spark.sql(_NOTES, conversations=t.conversations.where(kinds[n])), admissions, n).withColumn("name", F.lit(n)) for n in notes.NOTE_TABLES)
    out = reduce(DataFrame.unionByName, tables)
    return out.select("name", "subject_id", "hadm_id", "admit_provider_id", "admit_date_key", F.sha2("text", 256).alias("text_sha256"), "notes_count", "last_storetime")
