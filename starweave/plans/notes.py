"""Gold tables of clinical notes: features of discharge notes, of radiology notes, and both together as variants.

Notes have subject_id, hadm_id, admit_provider_id, admit_date_key, note_id and text; those without an admission or an id are
left out. An admission becomes one row. What repeats within an admission shrinks to its first occurrence (by note_id, then
place) in an aggregation of its own before the admission's lists are put together, so copied notes cost no memory there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starweave.functions import measures as M
from starweave.operators import joins
from starweave.operators import text as T
from starweave.operators.refresh import bucket

KEYS = ["subject_id", "admit_provider_id", "admit_date_key"]

# Lexicons, headings and codes of the published note model.
HABITS = {
    "TOBACCO": ["tobacco", "tobacco use", "tobacco abuse", "tobacco dependence", "smoking", "smoker", "smokes", "cigarette", "cigarettes", "cigar", "nicotine", "nicotine dependence", "pack year",
                "pack-year", "pack years", "packs per day", "ppd", "chewing tobacco", "snuff", "vaping", "e-cigarette"],
    "ALCOHOL": ["alcohol", "alcohol use", "alcohol abuse", "alcohol dependence", "alcoholic", "alcoholism", "etoh", "drinking", "binge drinking", "beer", "wine", "liquor"],
    "OBESITY": ["obesity", "obese", "morbid obesity", "morbidly obese", "severe obesity", "class iii obesity", "adiposity", "bmi"],
    "CESSATION_COUNSEL": ["smoking cessation", "tobacco cessation", "cessation counseling", "quit smoking", "quit date", "advised to quit", "counseled on smoking"],
    "CESSATION_PHARM": ["varenicline", "chantix", "bupropion", "zyban", "nicotine patch", "nicotine gum", "nicotine lozenge", "nicotine replacement", "nicotine replacement therapy", "nrt"],
}
MORBID = r"(?i)morbid|severe|class\s*(?:iii|3)\b|BMI\s*(?:[4-9]\d|\d{3})"
HEADINGS = {
    "examination": "examination", "exam": "examination", "study": "examination", "indication": "indication", "history": "indication", "clinical history": "indication",
    "clinical information": "indication", "reason for exam": "indication", "reason for examination": "indication", "reason for study": "indication", "technique": "technique",
    "comparison": "comparison", "comparisons": "comparison", "findings": "findings", "finding": "findings", "impression": "impression", "conclusion": "impression", "interpretation": "impression",
    "procedure": "procedure", "procedure details": "procedure", "procedure comments": "procedure", "wet read": "wet_read", "recommendation": "recommendation", "recommendations": "recommendation",
    "notification": "notification", "dose": "dose",
}
SIGNS = {
    "SYMPTOM": ["pain", "chest pain", "abdominal pain", "abd pain", "flank pain", "back pain", "shortness of breath", "dyspnea", "cough", "hemoptysis", "fever", "chills", "nausea", "vomiting",
                "diarrhea", "constipation", "jaundice", "distension", "distention", "abdominal distension", "swelling", "edema", "weakness", "numbness", "dizziness", "headache", "syncope",
                "altered mental status", "confusion", "weight loss", "fatigue", "hematuria", "dysuria", "dysphagia", "melena", "hematochezia", "seizure", "vision loss"],
    "DISORDER": ["consolidation", "pneumonia", "pleural effusion", "effusion", "pneumothorax", "pulmonary edema", "edema", "atelectasis", "nodule", "pulmonary nodule", "mass", "lung mass", "opacity",
                 "ground glass opacity", "fracture", "compression fracture", "cirrhosis", "hepatomegaly", "splenomegaly", "hepatic steatosis", "steatosis", "cholelithiasis", "gallstone", "gallstones",
                 "cholecystitis", "hydronephrosis", "nephrolithiasis", "kidney stone", "renal calculus", "hemorrhage", "intracranial hemorrhage", "subdural hematoma", "subarachnoid hemorrhage",
                 "hematoma", "infarct", "infarction", "ischemia", "stroke", "aneurysm", "aortic aneurysm", "aortic dissection", "dissection", "pulmonary embolism", "embolism", "deep vein thrombosis",
                 "dvt", "thrombosis", "thrombus", "bowel obstruction", "small bowel obstruction", "obstruction", "ileus", "perforation", "free air", "abscess", "appendicitis", "diverticulitis",
                 "pancreatitis", "portal hypertension", "ascites", "malignancy", "metastasis", "metastases", "metastatic disease", "lymphadenopathy", "cardiomegaly", "emphysema", "copd",
                 "pulmonary fibrosis", "fibrosis", "hydrocephalus", "midline shift", "herniation", "mass effect", "stenosis", "bronchiectasis"],
}
CODES = {
    "pneumonia": "J18.9", "consolidation": "J18.9", "pleural effusion": "J90", "effusion": "J90", "pneumothorax": "J93.9", "pulmonary edema": "J81.1", "atelectasis": "J98.11",
    "pulmonary embolism": "I26.99", "copd": "J44.9", "emphysema": "J43.9", "pulmonary fibrosis": "J84.10", "fibrosis": "J84.10", "bronchiectasis": "J47.9", "cardiomegaly": "I51.7",
    "cirrhosis": "K74.60", "ascites": "R18.8", "hepatomegaly": "R16.0", "splenomegaly": "R16.1", "hepatic steatosis": "K76.0", "steatosis": "K76.0", "portal hypertension": "K76.6",
    "cholelithiasis": "K80.20", "gallstone": "K80.20", "gallstones": "K80.20", "cholecystitis": "K81.9", "pancreatitis": "K85.90", "appendicitis": "K37", "diverticulitis": "K57.92",
    "bowel obstruction": "K56.60", "small bowel obstruction": "K56.609", "ileus": "K56.7", "perforation": "K63.1", "hydronephrosis": "N13.30", "nephrolithiasis": "N20.0", "kidney stone": "N20.0",
    "renal calculus": "N20.0", "aortic aneurysm": "I71.9", "aortic dissection": "I71.00", "aneurysm": "I72.9", "deep vein thrombosis": "I82.409", "dvt": "I82.409",
    "intracranial hemorrhage": "I62.9", "subdural hematoma": "I62.00", "subarachnoid hemorrhage": "I60.9", "stroke": "I63.9", "infarct": "I63.9", "infarction": "I63.9", "hydrocephalus": "G91.9",
    "lymphadenopathy": "R59.9", "pulmonary nodule": "R91.1", "nodule": "R91.1", "lung mass": "R91.8", "mass": "R22.9", "metastasis": "C79.9", "metastases": "C79.9", "metastatic disease": "C79.9",
    "abscess": "L02.91",
}


# The two tables of whole notes: name to hash buckets of the admission.
NOTE_TABLES = {"fact_discharge_note": 4, "fact_radiology_note": 8}


def note_table(raw: DataFrame, admissions: DataFrame, name: str, actor: str | None = None) -> DataFrame:
    """fact_discharge_note or fact_radiology_note: per subject and admission the texts of its raw notes in order of note_seq
    (then of the text), a blank line between, their number, the last times, and the admission's provider and date.

    Raw notes have text columns; times that cannot be read are null, and a null text adds nothing but counts. Notes without
    a subject or an admission are left out; an admission that is unknown has null keys. admissions is expected to have one
    row an hadm_id. An admission's texts meet in one task: they become one value.
    """
    raw = raw.where("subject_id IS NOT NULL AND hadm_id IS NOT NULL").select(
        F.col("subject_id").cast("long"), F.col("hadm_id").cast("long"), F.col("note_seq").cast("int"), "text", *(F.try_to_timestamp(F.col(c)).alias(c) for c in ("charttime", "storetime"))
    )
    texts = F.sort_array(F.collect_list(F.struct("note_seq", "text")))
    out = raw.groupBy("subject_id", "hadm_id").agg(
        F.array_join(F.transform(texts, lambda n: n["text"]), "\n\n").alias("text"), F.count("*").alias("notes_count"), F.max("charttime").alias("last_charttime"), F.max("storetime").alias("last_storetime")
    )
    out = joins.lookup(out, admissions, "hadm_id", "hadm_id", ["admit_provider_id", "admit_date_key"]).withColumn("bucket", bucket("hadm_id", NOTE_TABLES[name]))
    out = out.select("subject_id", "hadm_id", "admit_provider_id", "admit_date_key", "text", "notes_count", "last_charttime", "last_storetime", "bucket")
    return M.add_audit(out, actor) if actor else out


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _noted(notes: DataFrame) -> DataFrame:
    return notes.where("hadm_id IS NOT NULL AND note_id IS NOT NULL").select("hadm_id", *KEYS, F.col("note_id").cast("string").alias("note_id"), "text")


def _entity(e: Column) -> Column:
    return F.struct(e["term"].alias("text"), e["label"].alias("label"), e["start_char"].alias("start_char"), e["end_char"].alias("end_char"), *(e[a].alias(a) for a in T.ASSERTIONS), e["sentence"].alias("sentence"))


def discharge_features(notes: DataFrame, n_buckets: int = 64, actor: str | None = None, max_chars: int | None = T.MAX_CHARS) -> DataFrame:
    """fact_discharge_note_nlp: per admission tobacco and alcohol use, obesity level, cessation code and all entities as JSON.

    The first max_chars characters of a note are read, 100,000 as the published table defines; None reads all. Repeated rows
    are one.
    """
    cut = _noted(notes) if max_chars is None else _noted(notes).withColumn("text", T.guard("text", max_chars))
    tagged = cut.withColumn("e", T.tagger(HABITS)(F.col("text")))
    any_of = lambda label, test: F.bool_or(F.exists("e", lambda e: (e["label"] == label) & test(e)))
    own = lambda e: ~e["hypothetical"] & ~e["family"]
    now, past, denied = lambda e: own(e) & ~e["negated"] & ~e["historical"], lambda e: own(e) & ~e["negated"] & e["historical"], lambda e: own(e) & e["negated"]
    use = lambda label: T.status_of(any_of(label, now), any_of(label, past), any_of(label, denied))
    stated = lambda e: ~e["negated"]
    obese = any_of("OBESITY", lambda e: own(e) & ~e["negated"])
    note = F.struct("note_id", F.transform("e", _entity).alias("entities"))
    out = tagged.groupBy("hadm_id").agg(
        *(F.max(k).alias(k) for k in KEYS), use("TOBACCO").alias("tobacco_use"), use("ALCOHOL").alias("alcohol_use"),
        F.when(~obese, "NONE").when(F.bool_or(F.col("text").rlike(MORBID)), "MORBID").otherwise("OBESE").alias("obesity_level"),
        T.cessation(use("TOBACCO"), any_of("CESSATION_PHARM", stated), any_of("CESSATION_COUNSEL", stated)).alias("tobacco_cessation_cd"), F.array_sort(F.collect_set(note)).alias("n"),
    )
    payload = F.struct(F.lit("starweave").alias("nlp_engine"), F.size("n").alias("note_count"), F.col("n").alias("notes"))
    out = out.withColumn("recognized_entities", _json(payload)).withColumn("hadm_bucket", bucket("hadm_id", n_buckets))
    out = out.select("subject_id", "hadm_id", "admit_provider_id", "admit_date_key", "hadm_bucket", "tobacco_use", "alcohol_use", "obesity_level", "tobacco_cessation_cd", "recognized_entities")
    return M.add_audit(out, actor) if actor else out


# List columns of radiology features, each with what makes two items of an admission the same one.
LISTS = {
    "radiology_procedure_types": lambda i: F.struct(i["exam"], i["modality"]), "radiology_reasons": lambda i: F.lower(i["reason"]), "symptoms": lambda i: F.struct(i["text"], i["negated"]),
    "disorders": lambda i: F.struct(i["text"], i["negated"]), "icd_codes": lambda i: i["code"], "procedures": lambda i: F.lower(i["text"]), "findings_summary": lambda i: i["note_id"],
    "indication_summary": lambda i: i["note_id"], "conclusion": lambda i: i["note_id"], "notes": lambda i: i["note_id"],
}


# Characters and pieces that the published model keeps.
SUMMARY_CHARS, PROCEDURE_CHARS, TITLE_CHARS, MAX_REASONS = T.CLEAN_CHARS, 400, 200, 3


def radiology_items(notes: DataFrame, whole: bool = False) -> DataFrame:
    """One row a note, with a list of structs for every name of LISTS. Summaries are cut to 2,500 characters, procedures to 400,
    titles to 200, reasons to the first three, as the published model has them; with whole nothing is cut."""
    summary_chars, procedure_chars, title_chars, most = (None,) * 4 if whole else (SUMMARY_CHARS, PROCEDURE_CHARS, TITLE_CHARS, MAX_REASONS)
    cut = _noted(notes).withColumn("s", T.sections("text", HEADINGS))
    body = lambda name: F.coalesce(F.try_element_at("s", F.lit(name)), F.lit(""))
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    cut = cut.select("*", *(body(n).alias(n) for n in ("technique", "indication", "findings", "impression", "procedure")), F.coalesce(F.nullif(body("examination"), F.lit("")), body("_preamble")).alias("examination"))
    cut = cut.withColumn("e", T.tagger(SIGNS)(F.concat_ws("\n", part("indication"), part("findings"), part("impression"))))

    exam, what = T.exam_title(F.coalesce(part("examination"), part("technique")), title_chars), F.concat_ws(" ", "examination", "technique")
    kind = F.struct(exam.alias("exam"), T.modality(what).alias("modality"), T.body_region(what).alias("body_region"), "note_id")
    one = lambda item, on: F.filter(F.array(item), lambda i: on(i))
    of = lambda label: F.filter("e", lambda e: e["label"] == label)
    said = lambda label: F.transform(of(label), lambda e: F.struct(F.lower(e["term"]).alias("text"), e["negated"].alias("negated"), F.col("note_id").alias("note_id")))
    code = lambda c, term, source: F.struct(c.alias("code"), term.cast("string").alias("term"), F.lit(source).alias("source"))
    cited = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(T.CITED_CODE), F.lit(1)), lambda c: code(c, F.lit(None), "cited"))
    table = F.create_map(*(F.lit(v) for pair in CODES.items() for v in pair))
    looked = F.filter(F.transform(F.filter(of("DISORDER"), lambda e: ~e["negated"]), lambda e: code(F.try_element_at(table, F.lower(e["term"])), F.lower(e["term"]), "lookup")), lambda c: c["code"].isNotNull())
    named = lambda t: F.struct(t.alias("text"), F.col("note_id").alias("note_id"))
    summary = lambda c: one(F.struct("note_id", T.clean_lines(F.col(c), summary_chars).alias("text")), lambda i: i["text"] != "")
    entity = lambda e: F.struct(F.lower(e["term"]).alias("text"), e["label"].alias("label"), *(e[a].alias(a) for a in ("negated", "historical", "hypothetical", "family")), e["sentence"].alias("sentence"), F.col("note_id").alias("note_id"))
    lists = {
        "radiology_procedure_types": one(kind, lambda i: i["exam"].isNotNull() | (i["modality"] != "OTHER")),
        "radiology_reasons": F.transform(T.indication_reasons(F.col("indication"), most), lambda r: F.struct(r.alias("reason"), F.col("note_id").alias("note_id"))),
        "symptoms": said("SYMPTOM"), "disorders": said("DISORDER"), "icd_codes": F.concat(cited, looked),
        "procedures": F.concat(one(named(T.clean_lines(F.col("procedure"), procedure_chars)), lambda i: i["text"] != ""), F.transform(T.procedure_terms(F.concat_ws(" ", "examination", "technique", "procedure")), named)),
        "findings_summary": summary("findings"), "indication_summary": summary("indication"), "conclusion": summary("impression"),
        "notes": F.array(F.struct("note_id", F.transform("e", entity).alias("entities"))),
    }
    return cut.select("hadm_id", *KEYS, "note_id", *(lists[n].alias(n) for n in LISTS))


def radiology_features(notes: DataFrame, n_buckets: int = 128, actor: str | None = None, whole: bool = False) -> DataFrame:
    """fact_radiology_note_nlp: per admission examinations, reasons, symptoms, disorders, codes, procedures and summaries, each a
    JSON list without repeats in order of note_id and place. Rows that repeat a note_id count as one note. whole: see radiology_items."""
    rows = radiology_items(notes, whole)
    item = lambda name: F.transform(name, lambda i, at: F.struct(F.lit(name).alias("list"), _json(F.struct(LISTS[name](i).alias("k"))).alias("same"), at.alias("at"), _json(i).alias("item")))
    flat = rows.select("hadm_id", *KEYS, "note_id", F.inline(F.concat(*(item(n) for n in LISTS))))
    first = flat.groupBy("hadm_id", "list", "same").agg(*(F.max(k).alias(k) for k in KEYS), F.min(F.struct("note_id", "at", "item")).alias("f"))
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, F.col("f")))), lambda f: f["item"])
    text = lambda name: F.concat(F.lit("["), F.array_join(listed(name), ","), F.lit("]"))
    out = first.groupBy("hadm_id").agg(*(F.max(k).alias(k) for k in KEYS), F.count_if(F.col("list") == "notes").cast("int").alias("note_count"), *(text(n).alias(n) for n in LISTS))
    ner = F.concat(F.lit('{"engine":"starweave","note_count":'), F.col("note_count"), F.lit(',"notes":'), F.col("notes"), F.lit("}"))
    out = out.withColumn("ner_json", ner).withColumn("hadm_bucket", bucket("hadm_id", n_buckets))
    out = out.select("subject_id", "hadm_id", "admit_provider_id", "admit_date_key", "hadm_bucket", "note_count", *(n for n in LISTS if n != "notes"), "ner_json")
    return M.add_audit(out, actor) if actor else out


def clinician_notes(discharge: DataFrame, radiology: DataFrame, actor: str | None = None) -> DataFrame:
    """fact_clinician_note_nlp_v: both feature tables by admission, JSON columns as VARIANT; an admission with notes of one kind
    has nulls on the other side."""
    lists = [n for n in LISTS if n != "notes"] + ["ner_json"]
    d = discharge.select("hadm_id", *(F.col(k).alias(f"d_{k}") for k in KEYS), "tobacco_use", "alcohol_use", "obesity_level", "tobacco_cessation_cd", "recognized_entities", F.lit(True).alias("d"))
    r = radiology.select("hadm_id", *(F.col(k).alias(f"r_{k}") for k in KEYS), F.col("note_count").alias("radiology_note_count"), *lists, F.lit(True).alias("r"))
    role = lambda k: F.coalesce(f"d_{k}", f"r_{k}").alias(k)
    flag = lambda c, n: F.col(c).isNotNull().alias(n)
    out = d.join(r, "hadm_id", "full_outer").select(
        role("subject_id"), "hadm_id", role("admit_provider_id"), role("admit_date_key"), flag("d", "has_discharge_note"), flag("r", "has_radiology_note"), "tobacco_use", "alcohol_use", "obesity_level",
        "tobacco_cessation_cd", F.parse_json("recognized_entities").alias("recognized_entities"), "radiology_note_count", *(F.parse_json(c).alias(c) for c in lists),
    )
    return M.add_audit(out, actor) if actor else out
