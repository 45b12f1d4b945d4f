"""Gold tables of notes; expected rows by hand."""

import json

import pytest
from pyspark.sql import functions as F

from starweave.operators import refresh, text
from starweave.plans import notes

SCHEMA = "subject_id long, hadm_id long, admit_provider_id string, admit_date_key int, note_id string, text string"
DISCHARGE = [
    (1, 10, "P1", 21010101, "a", "Former smoker. Denies alcohol. Given nicotine patch."),
    (1, 10, "P1", 21010101, "b", "Obese, BMI 44. Father drinks beer."),
    (1, 10, "P1", 21010101, "b", "Obese, BMI 44. Father drinks beer."),
    (2, 11, None, None, "c", "Smokes daily; counseled on smoking. No obesity."),
    (3, 12, "P2", 21010102, "d", None),
    (4, None, "P2", 21010102, "e", "smoker"),
    (5, 13, "P3", 21010103, "f", "Drinking. Obesity is noted. Return if smoking."),
]
REPORT = """EXAMINATION: CT ABDOMEN AND PELVIS.
INDICATION: ___ with pain. rule out abscess; K85.9
TECHNIQUE: helical, with biopsy
FINDINGS: No pneumonia. Small pleural effusion.
Edema is seen.

DICTATED BY: nobody
IMPRESSION: Pleural effusion."""
RADIOLOGY = [
    (1, 10, "P1", 21010101, "r1", REPORT), (1, 10, "P1", 21010101, "r2", "FINAL REPORT EXAMINATION: CT ABDOMEN AND PELVIS\nFINDINGS: pleural effusion, copd.\nPROCEDURE: Biopsy\tof liver"),
    (6, 20, None, None, "r3", "a plain walk"), (7, 21, None, 21010105, "r4", None),
]


@pytest.fixture(scope="module")
def tables(spark):
    d = notes.discharge_features(spark.createDataFrame(DISCHARGE, SCHEMA).repartition(5), actor="test")
    r = notes.radiology_features(spark.createDataFrame(RADIOLOGY, SCHEMA).repartition(3), actor="test")
    return d, r


def test_longest_phrase_is_one_entity(spark):
    df = spark.createDataFrame([(1, "Smoking cessation: nicotine patch."), (2, None), (3, "")], "k long, t string")
    got = [(r.k, r.term, r.label) for r in text.tag_entities(df, "k", "t", notes.HABITS).collect()]
    assert got == [(1, "Smoking cessation", "CESSATION_COUNSEL"), (1, "nicotine patch", "CESSATION_PHARM")]
    # one phrase under two labels has the first
    assert [r.label for r in text.tag_entities(df.select("k", F.lit("edema").alias("t")).limit(1), "k", "t", notes.SIGNS).collect()] == ["SYMPTOM"]


def test_discharge_features(tables):
    rows = {r.hadm_id: r for r in tables[0].collect()}
    assert set(rows) == {10, 11, 12, 13}
    level = {k: (r.tobacco_use, r.alcohol_use, r.obesity_level, r.tobacco_cessation_cd) for k, r in rows.items()}
    assert level == {
        10: ("FORMER", "DENIES", "MORBID", "PHARMACOTHERAPY"), 11: ("CURRENT", "NOT_MENTIONED", "NONE", "COUNSELED"),
        12: ("NOT_MENTIONED", "NOT_MENTIONED", "NONE", "NA"), 13: ("NOT_MENTIONED", "CURRENT", "OBESE", "NA"),
    }
    found = json.loads(rows[10].recognized_entities)
    assert found["note_count"] == 2 and [n["note_id"] for n in found["notes"]] == ["a", "b"]
    assert [(e["text"], e["historical"], e["negated"]) for e in found["notes"][0]["entities"]] == [("smoker", True, False), ("alcohol", False, True), ("nicotine patch", False, False)]
    spans = [(e["start_char"], e["end_char"], e["text"]) for e in found["notes"][0]["entities"]]
    assert all(DISCHARGE[0][5][a:b] == t for a, b, t in spans)
    assert json.loads(rows[12].recognized_entities)["notes"] == [{"note_id": "d", "entities": []}]
    assert (rows[10].subject_id, rows[10].admit_provider_id, rows[10].admit_date_key, rows[10].hadm_bucket) == (1, "P1", 21010101, 10) and rows[11].admit_provider_id is None


def test_radiology_features(tables):
    rows = {r.hadm_id: r for r in tables[1].collect()}
    assert set(rows) == {10, 20, 21}
    r = {k: json.loads(v) if isinstance(v, str) and v[:1] in "[{" else v for k, v in rows[10].asDict().items()}
    assert r["note_count"] == 2 and r["hadm_bucket"] == 10
    assert r["radiology_procedure_types"] == [{"exam": "CT ABDOMEN AND PELVIS", "modality": "CT", "body_region": None, "note_id": "r1"}]  # r2 has the same title; the rules name no inflected region
    assert [x["reason"] for x in r["radiology_reasons"]] == ["abscess", "K85"]
    assert [(x["text"], x["negated"]) for x in r["symptoms"]] == [("pain", False), ("edema", False)]
    assert [(x["text"], x["negated"], x["note_id"]) for x in r["disorders"]] == [("abscess", False, "r1"), ("pneumonia", True, "r1"), ("pleural effusion", False, "r1"), ("copd", False, "r2")]
    assert [(x["code"], x["term"], x["source"]) for x in r["icd_codes"]] == [("K85.9", None, "cited"), ("L02.91", "abscess", "lookup"), ("J90", "pleural effusion", "lookup"), ("J44.9", "copd", "lookup")]
    assert [x["text"] for x in r["procedures"]] == ["biopsy", "Biopsy of liver"]
    assert [x["note_id"] for x in r["findings_summary"]] == ["r1", "r2"] and [x["text"] for x in r["conclusion"]] == ["Pleural effusion."]
    assert [len(n["entities"]) for n in r["ner_json"]["notes"]] == [6, 2] and r["ner_json"]["note_count"] == 2
    assert rows[20].note_count == 1 and rows[20].symptoms == "[]" and json.loads(rows[20].radiology_procedure_types) == []
    assert json.loads(rows[21].ner_json) == {"engine": "starweave", "note_count": 1, "notes": [{"note_id": "r4", "entities": []}]}


def test_radiology_features_do_not_depend_on_partitions(spark, tables):
    again = notes.radiology_features(spark.createDataFrame(RADIOLOGY * 2, SCHEMA).repartition(7))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, tables[1].select(again.columns).collect()), key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert notes.radiology_features(empty).count() == 0 and notes.discharge_features(empty).count() == 0


def test_clinician_notes(spark, tables, tmp_path):
    out = notes.clinician_notes(*tables, actor="test")
    assert len(out.columns) == 26 and sum(t == "variant" for _, t in out.dtypes) == 11
    out.write.parquet(str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    rows = {r.hadm_id: r for r in back.select("hadm_id", "subject_id", "has_discharge_note", "has_radiology_note", "tobacco_use", F.variant_get("ner_json", "$.note_count", "int").alias("n"), F.variant_get("icd_codes", "$[0].code", "string").alias("code")).collect()}
    assert set(rows) == {10, 11, 12, 13, 20, 21}
    assert tuple(rows[10])[1:] == (1, True, True, "FORMER", 2, "K85.9")
    assert tuple(rows[11])[1:] == (2, True, False, "CURRENT", None, None) and tuple(rows[20])[1:] == (6, False, True, None, 1, None)


def test_notes_refresh_touches_changed_admissions(spark, tmp_path):
    path, control = str(tmp_path / "d"), str(tmp_path / "c")
    stamp = lambda df, ts: df.withColumn("updated_ts", F.lit(ts).cast("timestamp"))
    src = stamp(spark.createDataFrame(DISCHARGE, SCHEMA).where("hadm_id IS NOT NULL"), "2024-01-01")
    of_key = lambda k: F.pmod(k, F.lit(64))
    run = lambda s, **kw: refresh.refresh(spark, "d", path, control, s, "hadm_id", lambda n: notes.discharge_features(n, actor="test"), "hadm_bucket", of_key, **kw)
    run(src, sample=2)
    assert refresh.read_watermark(spark, control, "d") == refresh.FIRST  # a trial run leaves the watermark
    assert run(src, mode="full").refreshed and not run(src).refreshed
    later = stamp(spark.createDataFrame([(5, 13, "P3", 21010103, "g", "Now quit smoking.")], SCHEMA), "2024-01-02")
    assert run(src.unionByName(later)).refreshed
    spark.catalog.refreshByPath(path)
    got = {r.hadm_id: r.tobacco_cessation_cd for r in spark.read.parquet(path).collect()}
    assert got == {10: "PHARMACOTHERAPY", 11: "COUNSELED", 12: "NA", 13: "COUNSELED"}
