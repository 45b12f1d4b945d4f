"""The tagger's column functions against plain Python: places, sentences, longest phrases, scopes of triggers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from starweave.operators import text

LEXICON = {"a": ["pain", "chest pain", "edema"], "b": ["edema", "mass", "é"], "c": ["pack year", "x.y"]}
WORDS = [
    "pain", "chest", "chest pain", "Edema", "MASS", "é", "pack year", "x.y", "no", "denies", "No evidence of", "history of", "if", "should", "mother", "possible", "is ruled out", "unlikely", "but", "which",
    ";", ".", "!", "?", "\n", "\n\n", " ", "  ", "\t", "word", "painful", "déjà", "\U0001f600", "漢字", "", "_", "pain,", "(edema)", "but.", "however",
]


def brute(t):
    label_of = {p.lower(): label for label in reversed(LEXICON) for p in LEXICON[label]}
    phrase = re.compile(r"(?<!\w)(" + "|".join(re.escape(p) for p in sorted(label_of, key=lambda p: (-len(p), p))) + r")(?!\w)", re.I)
    out, at = [], 0
    for n, s in enumerate(re.split(text._CUT, t or "")):
        at = t.find(s, at) if t else 0
        for m in phrase.finditer(s):
            before, after = s[: m.start()], s[m.end() :]
            stops = list(re.finditer(text._STOP, before, re.I))
            before = before[stops[-1].end() :] if stops else before
            stop = re.search(text._STOP, after, re.I)
            after = after[: stop.start()] if stop else after
            said = [bool(re.search(text._BEFORE[k], before, re.I)) or (k in text._AFTER and bool(re.search(text._AFTER[k], after, re.I))) for k in text.ASSERTIONS]
            out.append((n, at + m.start(), at + m.end(), m[0], label_of[m[0].lower()], s, *said))
        at += len(s)
    return out


def test_tags_are_brute_force(spark):
    rng = random.Random(12)
    texts = [None, "", " ", "pain", "no pain", "pain is unlikely; edema", "x.y. x.y", "No pain but edema", "chest pain\n\nchest  pain"]
    texts += ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "", "\n", ". "]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(8)
    got = {r.k: [tuple(e) for e in r.e] for r in df.select("k", text.tagger(LEXICON)(F.col("t")).alias("e")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == brute(t), t
    assert sum(map(len, got.values())) > 1000
    assert "Python" not in df.select(text.tagger(LEXICON)(F.col("t")))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 99, 100, 101, 1000])
def test_running_sums(spark, n):
    df = spark.createDataFrame([([(7 * i) % 5 for i in range(n)],)], "x array<int>")
    values = [(7 * i) % 5 for i in range(n)]
    assert df.select(text.running(F.col("x")).alias("s")).first().s == [sum(values[:i]) for i in range(n)]


def test_long_texts_and_extra_columns(spark):
    long = "no pain here. " * 5000 + "x" * 100000 + "\nedema"
    df = spark.createDataFrame([(1, long)], "k int, text string").selectExpr("*", "1 AS at", "2 AS body", "3 AS t")
    rows = text.tag_entities(df, "k", "text", LEXICON).collect()
    assert len(rows) == 5001 and all(long[r.start_char : r.end_char] == r.term for r in rows) and sum(r.negated for r in rows) == 5000
