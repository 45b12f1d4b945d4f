"""Free text to features: note roll-up, sections, sentences, lexicon entities with assertions, levels, code lookup."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starweave.functions.measures import first_match

MAX_CHARS, CLEAN_CHARS = 100_000, 2_500


def note_concat(notes: DataFrame, keys: list[str], order: str, text: str, sep: str = "\n") -> DataFrame:
    """One row per keys: texts in order, their number, and the last place."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    rows = notes.where(F.col(text).isNotNull()).groupBy(*keys).agg(parts.alias("_p"), F.count("*").alias("n_notes"), F.max(order).alias("last_order"))
    return rows.select(*keys, F.concat_ws(sep, F.transform("_p", lambda p: p["t"])).alias("full_text"), "n_notes", "last_order")


def note_time(stored: str, charted: str) -> Column:
    return F.coalesce(F.try_to_timestamp(F.col(stored)), F.try_to_timestamp(F.col(charted)), F.lit("1900-01-01").cast("timestamp"))


def clean(text: str | Column, n: int = CLEAN_CHARS) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def _cut(text: Column, n: int | None) -> Column:
    return text if n is None else F.substring(text, 1, n)


def clean_lines(text: Column, n: int | None = CLEAN_CHARS) -> Column:
    """Lines kept: runs of blanks become one, of three and more newlines two; n characters of it (None: all)."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n{3,}", "\n\n"), "[ \t]+", " ")
    return _cut(F.regexp_replace(plain, r"^\s+|\s+$", ""), n)


def guard(text: str, n: int = MAX_CHARS) -> Column:
    return F.substring(F.col(text), 1, n)


def sections(text: str | Column, headers: dict[str, str]) -> Column:
    """map<name, body>: a line that starts with capitals and a colon opens a section; headers maps a heading (lower case) to its
    name, and a heading that is none of them takes the first that it begins or ends with. Bodies of a repeated section are joined;
    an unknown heading ends the body before it and is dropped with its own; what comes before the first heading is _preamble, a
    text without headings is _body."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # fixed value: the heading rule of the published model, with a stop allowed
    mark = r"(?m)^[ \t]*([A-Z][A-Z0-9 /&()_.-]{2,45}?):[ \t]*"
    titles = F.regexp_extract_all(c, F.lit(mark), F.lit(1))
    bodies = F.transform(F.split(c, mark, -1), lambda b: F.regexp_replace(F.regexp_replace(b, r"\s+\n", "\n"), r"^\s+|\s+$", ""))

    def name(title: Column) -> Column:
        low, out = F.lower(F.trim(title)), F.lit("")
        for heading, canonical in reversed(list(headers.items())):
            out = F.when(low.startswith(heading) | low.endswith(heading), canonical).otherwise(out)
        for heading, canonical in headers.items():
            out = F.when(low == heading, canonical).otherwise(out)
        return out

    named = F.zip_with(titles, F.slice(bodies, 2, F.greatest(F.size(titles), F.lit(1))), lambda t, b: F.struct(name(t).alias("k"), b.alias("b")))
    known = F.filter(named, lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(known, lambda p: p["k"]))
    joined = F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(known, lambda p: p["k"] == k), lambda p: p["b"]), "\n")))
    lead = F.element_at(bodies, 1)
    return F.when(F.size(titles) == 0, F.create_map(F.lit("_body"), F.trim(c))).otherwise(
        F.map_concat(F.map_filter(F.create_map(F.lit("_preamble"), lead), lambda _, v: v != ""), joined)
    )


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a sentence: key, place, sentence."""
    parts = F.split(F.col(text), r"(?<=[.!?])\s+|\n+")
    return df.select(key, F.posexplode(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")).alias("sentence_no", "sentence"))


def lexicon_pattern(phrases: list[str], flags: str = "iU") -> str:
    """Longest phrase first, on the bounds of words in any script (flag U is the JVM's; Python's patterns need no flag)."""
    return rf"(?{flags})(?<!\w)(" + "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")(?!\w)"


def lexicon_hits(df: DataFrame, key: str, text: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """One row a key and label: hits and distinct terms."""
    found = [F.struct(F.lit(label).alias("label"), F.transform(F.regexp_extract_all(F.col(text), F.lit(lexicon_pattern(p)), F.lit(1)), lambda t: F.lower(t)).alias("terms")) for label, p in lexicon.items()]
    rows = df.select(key, F.explode(F.array(*found)).alias("f")).where(F.size("f.terms") > 0)
    return rows.select(key, F.col("f.label").alias("label"), F.size("f.terms").alias("n_hits"), F.size(F.array_distinct("f.terms")).alias("n_terms"))


# Trigger words of the published NegEx / ConText approach: direction and scope
_BEFORE = {
    "negated": r"\b(?:no|not|denies|denied|without|never|negative for|no evidence of|absence of)\b",
    "historical": r"\b(?:history of|former|previous|prior|past)\b",
    "hypothetical": r"\b(?:if|should|in case of|return for)\b",
    "family": r"\b(?:father|mother|brother|sister|family|grandmother|grandfather)\b",
    "uncertain": r"\b(?:possible|probable|may|might|compatible with|suspicious for|cannot exclude)\b",
}
_AFTER = {"negated": r"\b(?:is ruled out|was ruled out|unlikely)\b"}
_STOP = r"\b(?:but|however|although|except|which)\b|;"
_CUT = r"(?<=[.!?])\s+|\n+"
ASSERTIONS = ("negated", "historical", "hypothetical", "family", "uncertain")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for a row, however often use names it, also inside other functions of elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column) -> Column:
    """What comes before each element of an array of numbers, summed; blocks of sqrt(n) elements keep n elements at n * sqrt(n)."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)

    def blocks(x: Column, size: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1)
        part = lambda i: F.slice(x, i * size + 1, size)
        offset = lambda sums: F.transform(sums, lambda _, i: total(F.slice(sums, 1, i)))
        inside = lambda y, before: F.transform(y, lambda _, j: before + total(F.slice(y, 1, j)))
        return let(offset(F.transform(numbers, lambda i: total(part(i)))), lambda o: F.flatten(F.transform(numbers, lambda i: let(part(i), lambda y: inside(y, F.get(o, i))))))

    return let(lengths, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda size: blocks(x, size))))


def pieces(text: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern: an array of (at, body), at being the place of the first character from 0."""
    cut = F.split(text, pattern, -1)
    between = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    return let(cut, lambda c: F.arrays_zip(running(F.zip_with(F.transform(c, lambda p: F.length(p)), between, lambda p, m: p + F.coalesce(m, F.lit(0)))).alias("at"), c.alias("body")))


def _first_end(clause: Column, pattern: str) -> Column:
    """Where the first match ends, in characters; null without one."""
    return F.length(F.element_at(F.split(clause, pattern, 2), 1)) + F.length(F.regexp_substr(clause, F.lit(pattern)))


def _last_start(clause: Column, pattern: str) -> Column:
    rest, found = F.element_at(F.split(clause, pattern, -1), -1), F.regexp_extract_all(clause, F.lit(pattern), F.lit(0))
    return F.when(F.size(found) > 0, F.length(clause) - F.length(rest) - F.length(F.try_element_at(found, F.lit(-1))))


def tagger(lexicon: dict[str, list[str]]) -> Callable[[Column], Column]:
    """A column function from a text to its entities in order of place, in DataFrame functions only: sentence_no, start_char,
    end_char, term, label, sentence, and what is asserted of each. From left to right the longest phrase of any label is one
    entity; a phrase under two labels has the first. Null: none.

    A sentence is cut at terminators (but, however, a semicolon) into clauses, which bound the scope of triggers: one holds for
    an entity if it ends before it in its clause (or, for triggers that follow, begins after it). Triggers are looked up once
    a clause, whatever its entities; a phrase does not reach over a terminator."""
    label_of = {p.lower(): label for label in reversed(lexicon) for p in lexicon[label]}
    names = F.create_map(*(F.lit(x) for pair in label_of.items() for x in pair))
    pattern = lexicon_pattern(list(label_of))

    def of_clause(number: Column, sentence: Column, clause: Column, before: Column) -> Column:
        """before: characters of the text before the clause."""
        # one place a trigger: where the first one ends, or the last one that may follow begins
        marks = F.struct(*(_first_end(clause, f"(?iU){p}").alias(f"to_{k}") for k, p in _BEFORE.items()), *(_last_start(clause, f"(?iU){p}").alias(f"from_{k}") for k, p in _AFTER.items()))
        terms = F.regexp_extract_all(clause, F.lit(pattern), F.lit(1))

        def entity(term: Column, at: Column, mark: Column) -> Column:
            end = at + F.length(term)
            holds = lambda a: F.coalesce(mark[f"to_{a}"] <= at, F.lit(False)) | (F.coalesce(mark[f"from_{a}"] >= end, F.lit(False)) if a in _AFTER else F.lit(False))
            return F.struct(
                number.alias("sentence_no"), (before + at).alias("start_char"), (before + end).alias("end_char"), term.alias("term"), F.element_at(names, F.lower(term)).alias("label"), sentence.alias("sentence"),
                *(holds(a).alias(a) for a in ASSERTIONS),
            )

        def placed(t: Column, mark: Column) -> Column:
            # a match begins where the piece before it ends
            starts = F.transform(F.slice(pieces(clause, pattern), 1, F.size(t)), lambda p: p["at"] + F.length(p["body"]))
            return F.transform(F.arrays_zip(t.alias("t"), starts.alias("s")), lambda x: entity(x["t"], x["s"], mark))

        none = F.array().cast(f"array<{ENTITY}>")
        return let(terms, lambda t: F.when(F.size(t) == 0, none).otherwise(let(marks, lambda mark: placed(t, mark))))

    def of_sentence(piece: Column, number: Column) -> Column:
        body = piece["body"]
        return F.flatten(F.transform(pieces(body, f"(?iU){_STOP}"), lambda c: of_clause(number, body, c["body"], piece["at"] + c["at"])))

    def tag(text: Column) -> Column:
        found = let(F.coalesce(text, F.lit("")), lambda x: F.flatten(F.transform(pieces(x, _CUT), of_sentence)))
        return F.when(F.coalesce(text, F.lit("")).rlike(pattern), found).otherwise(F.array().cast(f"array<{ENTITY}>"))

    return tag


ENTITY = "struct<sentence_no:int,start_char:int,end_char:int,term:string,label:string,sentence:string," + ",".join(f"{a}:boolean" for a in ASSERTIONS) + ">"


def tag_entities(df: DataFrame, key: str, text: str, lexicon: dict[str, list[str]]) -> DataFrame:
    """One row an entity: key, sentence, place, label and assertions."""
    return df.select(key, F.inline(tagger(lexicon)(F.col(text))))


def status_of(now: Column, past: Column, denied: Column) -> Column:
    return F.when(now, "CURRENT").when(past, "FORMER").when(denied, "DENIES").otherwise("NOT_MENTIONED")


def status_levels(entities: DataFrame, key: str, base: DataFrame) -> DataFrame:
    """NOT_MENTIONED, CURRENT, FORMER or DENIES per key, current over former over denied."""
    own = ~F.col("family") & ~F.col("hypothetical")
    flags = entities.where(own).groupBy(key).agg(
        F.bool_or(~F.col("negated") & ~F.col("historical")).alias("now"), F.bool_or(~F.col("negated") & F.col("historical")).alias("past"), F.bool_or("negated").alias("no")
    )
    return base.select(key).distinct().join(flags, key, "left").select(key, status_of(F.col("now"), F.col("past"), F.col("no")).alias("status"))


def cessation(status: Column, drug: Column, counsel: Column) -> Column:
    return F.when(drug, "PHARMACOTHERAPY").when(counsel, "COUNSELED").when(status.isin("CURRENT", "FORMER"), "NONE").otherwise("NA")


def severity(text: Column) -> Column:
    """From a stated index: 40 and above MORBID, 30 and above OBESE."""
    value = F.regexp_extract(F.lower(text), r"\bbmi\D{0,10}(\d{2})", 1).try_cast("int")
    return F.when((value >= 40) | F.lower(text).rlike(r"\bmorbid(?:ly)? obes"), "MORBID").when((value >= 30) | F.lower(text).rlike(r"\bobes"), "OBESE").otherwise("NONE")


# Rules of the published radiology model, tried in this order.
MODALITIES = [
    ("CT", r"(?i)\b(ct|computed tomograph|cta|ctu|cect|mdct|multidetector)\b"),
    ("MR", r"(?i)\b(mr|mri|mra|mrcp|magnetic resonance)\b"),
    ("US", r"(?i)\b(us|ultrasound|sonogra|doppler|echo)\b"),
    ("MAMMO", r"(?i)\b(mammogra|tomosynthesis)\b"),
    ("FLUORO", r"(?i)\b(fluorosc|barium|esophagram|upper gi|small bowel follow|cystogram|voiding)\b"),
    ("NM", r"(?i)\b(nuclear|scintigraph|hida|v/?q scan|bone scan|spect)\b"),
    ("PET", r"(?i)\bpet\b"),
    ("ANGIO", r"(?i)\b(angiogra|arteriogram|venogram|embolization)\b"),
    ("XR", r"(?i)\b(x-?ray|radiograph|chest pa|portable|kub|plain film|\bxr\b|frontal|lateral view|two views|single view|pa and lat|chest film|ap (chest|abdomen|pelvis|view))\b"),
]
BODY_REGIONS = [
    ("chest", r"(?i)\b(chest|thorax|thoracic|lung|pulmonary|pa and lat)\b"),
    ("abdomen", r"(?i)\b(abdom|liver|gallbladder|pancrea|renal|kidney|pelvi|paracentesis)\b"),
    ("head", r"(?i)\b(head|brain|skull|cranial|intracranial)\b"),
    ("neck", r"(?i)\b(neck|carotid|cervical spine|thyroid)\b"),
    ("spine", r"(?i)\b(spine|spinal|lumbar|thoracic spine|vertebr)\b"),
    ("extremity", r"(?i)\b(extremity|femur|tibia|humerus|hand|foot|ankle|knee|shoulder|hip|wrist|elbow)\b"),
    ("cardiac", r"(?i)\b(cardiac|coronary|echocardiogram)\b"),
]
PROCEDURES = (
    r"(?i)\b(paracentesis|thoracentesis|thoracostomy|biopsy|aspiration|drainage|drain placement|catheter placement|picc|central line|line placement|angioplasty|embolization|thrombectomy|"
    r"nephrostomy|cholecystostomy|lumbar puncture|myelogram|arthrogram|ablation|stent placement|gastrostomy|g-?tube|j-?tube|port placement|vertebroplasty|kyphoplasty)\b"
)
CITED_CODE = r"\b([A-TV-Z][0-9][0-9AB](?:\.[0-9A-Z]{1,4})?)\b"
REASON_CUES = r"(?i)//|\bfor eval\b|\beval(?:uate)? for\b|\brule out\b|\br/o\b|\bassess for\b|\bconcern for\b"


def modality(text: Column) -> Column:
    """The first kind of examination that the text names, else OTHER."""
    return first_match(text, MODALITIES, "OTHER")


def body_region(text: Column) -> Column:
    return first_match(text, BODY_REGIONS)


def procedure_terms(text: Column) -> Column:
    """Distinct procedures named, in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PROCEDURES), F.lit(1)), lambda t: F.lower(t))))


def cited_codes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row a code that a text cites."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(CITED_CODE), F.lit(1)))).alias("code"))


def payload(entities: DataFrame, key: str) -> DataFrame:
    """Per key its entities in order of place, as one JSON array of (label, term, start, end, assertions)."""
    fields = ["sentence_no", "start_char", "end_char", "label", "term", *ASSERTIONS]
    rows = entities.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
    return rows.select(key, F.size("e").alias("n_entities"), F.to_json("e").alias("entities"))


def reasons(text: Column, cue: str = r"(?i)\b(?:reason for exam|indication|history)\s*:") -> Column:
    """The first three pieces of 3 to 200 characters after the cue, cut at ends of sentences and at cues within."""
    tail = F.element_at(F.split(text, cue, 2), -1)
    parts = F.filter(F.transform(F.split(tail, REASON_CUES + r"|[.;\n]"), lambda p: F.trim(p)), lambda p: F.length(p).between(3, 200))
    return F.when(text.rlike(cue), F.slice(parts, 1, 3)).otherwise(F.array().cast("array<string>"))


def indication_reasons(text: Column, most: int | None = 3) -> Column:
    """The first `most` pieces (None: all) of 3 to 200 characters after the last cue of an indication, or of all of it where
    none is."""
    tail = F.element_at(F.split(F.coalesce(text, F.lit("")), REASON_CUES), -1)
    parts = F.transform(F.split(tail, r"[.;\n]"), lambda p: F.btrim(F.regexp_replace(p, "_{2,}", ""), F.lit(" -\t\r\n")))
    kept = F.filter(parts, lambda p: F.length(p).between(3, 200))
    return kept if most is None else F.slice(kept, 1, most)


def exam_title(text: Column, n: int | None = 200) -> Column:
    """The first line without runs of underscores and outer points and dashes, n characters at most (None: all); null if empty."""
    line = F.regexp_replace(F.substring_index(clean_lines(text, None if n is None else CLEAN_CHARS), "\n", 1), "_{2,}", "")
    return F.nullif(_cut(F.btrim(line, F.lit(" .-\t")), n), F.lit(""))


def dedup_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def code_lookup(cited: DataFrame, terms: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Codes cited in text, and codes of non-negated terms by lookup; a code's first source is kept, cited before looked up."""
    looked = terms.where("NOT negated").join(table, "term").select(key, "code", F.lit("lookup").alias("source"), F.lit(1).alias("_o"))
    said = cited.select(key, "code", F.lit("cited").alias("source"), F.lit(0).alias("_o"))
    return dedup_first(said.union(looked), [key, "code"], ["_o"]).drop("_o")


def rollup_features(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per key: each column's distinct values, sorted, as a JSON array."""
    return df.groupBy(key).agg(*(F.to_json(F.array_sort(F.collect_set(c))).alias(c) for c in columns))
