"""Operators against brute force, exact round trips and held-out accuracy; edge rows for each."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from starweave.llm import decontaminate, neardup, pii, ppm, quality, segment, token_counts, tokens, toxicity, urls
from starweave.llm.components import components

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, "", "en"), (2, None, "en"), (3, "one", None), (4, "One two three four", "en"), (5, "one two three four", "fr"), (6, " \n\t ", "en"),
    (7, "é ñ 漢字 \U0001f600 " * 30, None), (8, "word " * 3000, "xx"), (9, "x" * 20000, "en"), (9, "x" * 20000, "en"), (10, "a\n\nb\n\na\r\nb\x1c c", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Edge texts in a table with nulls, repeats and columns whose names clash with those that operators make."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string")
    return df.withColumn("score", F.lit(None).cast("double")).withColumn("n_words", F.lit("x")).withColumn("key", F.lit(None).cast("long")).withColumn("kept", F.lit(False))


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path


def empty(df):
    return df.where("false")


# 1 toxicity


def test_toxicity_holds_out_and_predicts(spark, docs):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score(big, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for k, r in got.items())
    rows = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(g.predicted == y for g, y in rows) / len(rows) > 0.9
    assert sum(g.predicted and not y for g, y in rows) <= 2
    # labels, language and order of the held-out rows change nothing
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(big.withColumn("lang", F.lit("zz")), flipped).collect()}
    assert all(math.isclose(again[k], r.score, rel_tol=1e-9) for k, r in got.items())


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot": 4.0, "achlich*": 2.0})
    at = dict(zip(toxicity.FEATURES, g.features("You are an idiot. He is not an idiot, she said idiot; I will kill you! achlichst achlich"), strict=True))
    # a hit without a target counts half, a threat with one twice as much as one without
    assert at["log_targeted"] == pytest.approx(math.log1p(4)) and at["log_negated"] == pytest.approx(math.log1p(4)) and at["log_reported"] == pytest.approx(math.log1p(4))
    assert at["log_threat"] == pytest.approx(math.log1p(2)) and at["log_direct"] == pytest.approx(math.log1p(1))
    assert sum(g.features("idiotic moronic")[:6]) == 0


def _clause_brute(words):
    """Tape sums of one clause of (class, weight) by its rules, without machines."""
    sums = collections.Counter()
    within = lambda kind, i, scope: any(c == kind for c, _ in words[max(0, i - scope) : i])
    for i, (c, w) in enumerate(words):
        threat = c in ("threat", "both") and within("intent", i, toxicity.INTENT_SCOPE)
        if not threat and c not in ("insult", "both"):
            continue
        near = any(x == "target" for x, _ in words[max(0, i - toxicity.TARGET_SCOPE) : i + toxicity.TARGET_SCOPE + 1])
        if within("report", i, toxicity.REPORT_SCOPE):
            sums["reported"] += w
        elif within("negation", i, toxicity.NEGATION_SCOPE):
            sums["negated"] += w
        elif threat:
            sums["threat"] += w * (1 if near else 0.5)
        else:
            sums["targeted" if near else "direct"] += w * (1 if near else 0.5)
    return sums


def test_composed_transducers_are_brute_force():
    import itertools
    import random

    machine = toxicity.grammar()
    classes = {"other": 0.0, "insult": 3.0, "threat": 2.0, "both": 5.0, "intent": 0.0, "target": 0.0, "negation": 0.0, "report": 0.0}
    rng = random.Random(11)
    clauses = [*itertools.product(classes, repeat=3), *([rng.choice([*classes, "other", "other"]) for _ in range(rng.randint(1, 14))] for _ in range(3000))]
    for clause in clauses:
        words = [(c, classes[c]) for c in clause]
        total, sums = machine.best(words)
        want = _clause_brute(words)
        assert {k: v for k, v in sums.items() if v} == pytest.approx({k: v for k, v in want.items() if v}) and total == pytest.approx(sum(want.values())), clause
    # the best of all paths, each followed by itself
    for clause in clauses[::97]:
        paths = [(0, 0.0)]
        for c in clause[:8]:
            paths = [(to, total + f * classes[c]) for state, total in paths for _, f, to in machine.arcs.get((state, c), ())]
        assert machine.best([(c, classes[c]) for c in clause[:8]])[0] == pytest.approx(max((t for state, t in paths if state in machine.finals), default=0.0))


def test_clauses_are_read_to_their_ends():
    g = toxicity.Grammar({"idiot": 4.0})
    far = "word " * 20000
    at = dict(zip(toxicity.FEATURES, g.features(far + "you said idiot " + far + "not an idiot " + far + " you idiot"), strict=True))
    assert at["log_reported"] == pytest.approx(math.log1p(4)) and at["log_negated"] == pytest.approx(math.log1p(4)) and at["log_targeted"] == pytest.approx(math.log1p(4))


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(4, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    out = toxicity.score(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(empty(edge), empty(labels)).count() == 0


# 2 quality


def _quality_base(t):
    t = t or ""
    words = SPACED.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_quality_base_columns(request, which):
    df = request.getfixturevalue(which)
    want = collections.Counter((r.doc_id, *_quality_base(r.text)) for r in df.collect())
    rows = quality.judge(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert not any(r.kept and r.base_failed for r in rows)


def _quality_words(t):
    """Words in lower case without one sign at their end."""
    return [w[:-1] if len(w) > 1 and w[-1] in ".,;:!?\"'()|" else w for w in SPACED.findall((t or "").translate(LOWER))]


def _word_distance(t, common):
    """Distance of a text's common words to {word: share}, the rest being one more."""
    words = _quality_words(t)
    if len(words) < quality.MIN_WORDS:
        return 0
    c = collections.Counter(w if w in common else None for w in words)
    p, q = {k: n / len(words) for k, n in c.items()}, {**common, None: max(0.0, 1 - sum(common.values()))}
    kl = lambda a, b: sum(x * math.log2(2 * x / (x + b.get(k, 0))) for k, x in a.items() if x > 0)
    return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))


def _common_words(docs):
    """{language: {word: share}} of the most frequent words of the documents that references read."""
    counts = collections.defaultdict(collections.Counter)
    for d in docs.collect():
        base = _quality_base(d.text)
        if not base[-1] and base[2] * 50 <= base[1]:
            counts[d.lang or ""].update(_quality_words(d.text))
    out = {}
    for lang, c in counts.items():
        # equal counts rank by hash, which this version leaves out: take all that the last place's count reaches
        least = sorted(c.values(), reverse=True)[: quality.WORD_TOP][-1]
        out[lang] = {w: n / sum(c.values()) for w, n in c.items() if n >= least}
    return out


def test_quality_verdict_is_the_distance_rule(docs, texts):
    refs = quality.references(docs)
    common = _common_words(docs)
    for lang, own in common.items():
        assert sorted(refs[lang]["shares"][:-1], reverse=True) == pytest.approx(sorted(own.values(), reverse=True)[: quality.WORD_TOP])
        # keep the words that the reference has, where the last place is shared
        hashed = {w: int(quality.hash_words(np.frombuffer(w.encode(), np.uint8), quality.split_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])))[0]) for w in own}
        common[lang] = {w: x for w, x in own.items() if hashed[w] in set(refs[lang]["words"].tolist())}
        assert len(common[lang]) == len(refs[lang]["words"])
    assert set(refs) == {"en", "de", "fr", "es"}
    langs = {r.doc_id: r.lang for r in docs.collect()}
    for r in quality.judge(docs).collect():
        t = texts[r.doc_id]
        classes = np.zeros(quality.N_CLASSES)
        for c in t:
            k = quality._CLASS[c.encode()[0]]
            if k < quality.N_CLASSES:
                classes[k] += 1
        n = classes.sum()
        p, q = classes / max(n, 1), refs[langs[r.doc_id]]["classes"]
        m = (p + q) / 2
        kl = lambda a, m=m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        want = math.sqrt(max(0, (kl(p) + kl(q)) / 2)) if n >= quality.MIN_CHARS else 0
        assert r.char_distance == pytest.approx(want, abs=1e-9)
        assert r.word_distance == pytest.approx(_word_distance(t, common[langs[r.doc_id]]), abs=1e-9)
        ok = r.char_distance <= quality.MAX_CHAR_DISTANCE + quality.CHAR_SLACK / math.sqrt(max(n, 1)) and r.word_distance <= quality.MAX_WORD_DISTANCE + quality.WORD_SLACK / math.sqrt(max(r.n_words, 1))
        assert r.kept == (ok and not r.base_failed)


def test_quality_follows_labels(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judge(df).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_quality_keep_is_judge(docs, edge):
    for df in (docs, edge):
        kept = collections.Counter(r.doc_id for r in quality.judge(df).collect() if r.kept)
        out = quality.keep(df)
        assert out.columns == df.columns and collections.Counter(r.doc_id for r in out.collect()) == kept
    assert quality.judge(empty(edge)).count() == 0


# 3 language model


def _ppm_brute(train, order):
    ctx = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    stream = lambda t: bytes([255] * order) + t.translate(LOWER).encode() + b"\xff"
    for t in train:
        s = stream(t)
        for i in range(order, len(s)):
            for o in range(order + 1):
                ctx[o][s[i - o : i]][s[i]] += 1

    def log_p(t):
        s, total = stream(t), 0.0
        for i in range(order, len(s)):
            out, gone = 0.0, set()
            for o in range(order, -1, -1):
                live = {a: b for a, b in ctx[o].get(s[i - o : i], {}).items() if a not in gone}
                if not live:
                    continue
                n = sum(live.values()) + len(live)
                if s[i] in live:
                    out += math.log10(live[s[i]] / n)
                    break
                out += math.log10(len(live) / n)
                gone |= set(live)
            else:
                out -= math.log10(256 - len(gone))
            total += out
        return total

    return log_p


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_ppm_is_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    tokens_of = lambda t: [*SPACED.findall(t.translate(LOWER)), "\n"]
    train = [t for k, t in rows if not held(k)]
    c = collections.Counter(w for t in train for w in tokens_of(t))
    n, v = sum(c.values()), len(c)
    log_p = _ppm_brute(train, ppm.ORDER)
    want = collections.defaultdict(list)
    for k, t in rows[:60]:
        want[k].append((held(k), len(tokens_of(t)), sum(w in c for w in tokens_of(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens_of(t)), log_p(t)))
    got = collections.defaultdict(list)
    for r in ppm.score(df).collect():
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score))
    assert sum(map(len, got.values())) == len(rows)
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_ppm_pruned_trie_and_rare_words(docs, monkeypatch):
    exact = {r.doc_id: (r.base_score, r.n_known) for r in ppm.score(docs).collect()}
    monkeypatch.setattr(ppm, "TRIE_NODES", 2000)
    monkeypatch.setattr(ppm, "WORD_NODES", 50)
    rows = ppm.score(docs).collect()
    assert all(r.n_known == exact[r.doc_id][1] and math.isclose(r.base_score, exact[r.doc_id][0], rel_tol=1e-9) for r in rows)
    assert all(r.score < 0 for r in rows)


@pytest.mark.parametrize("which", ["docs", "edge"])
@pytest.mark.parametrize("nodes", [0, 500])
def test_ppm_bounded_broadcast_keeps_every_gram(request, which, nodes, monkeypatch):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    log_p = _ppm_brute([t for k, t in rows if zlib.crc32(str(k).encode()) % 5 != 1], ppm.ORDER)
    exact = collections.defaultdict(list)
    for r in ppm.score(df).collect():
        exact[r.doc_id].append(r.score)
    monkeypatch.setattr(ppm, "TRIE_NODES", nodes)
    got = collections.defaultdict(list)
    for r in ppm.score(df).collect():
        got[r.doc_id].append(r.score)
    assert got.keys() == exact.keys()
    for k in exact:
        assert sorted(got[k]) == pytest.approx(sorted(exact[k]), rel=1e-9)
    for k, t in rows[:20]:
        assert any(x == pytest.approx(log_p(t), rel=1e-9) for x in got[k])


def test_ppm_distributions_sum_to_one():
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 101, 3000).astype(np.uint8)
    g, _ = ppm._streams(raw, np.array([0, 3000]), 2)
    levels = []
    for k in range(3):
        x, c = np.unique(g & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True)
        levels.append((x[c >= 40], c[c >= 40]))
    trie = ppm.Trie(levels)
    for ctx in (0x6161, 0x6263, 0x6162, 0x7A7A, 0x61FF):
        grams = np.uint64(ctx << 8) | np.arange(256, dtype=np.uint64)
        assert (10 ** trie.score(grams)).sum() == pytest.approx(1)


def test_ppm_without_training_rows(spark, edge):
    rows = ppm.score(edge, held_out=lambda c: c.isNotNull()).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert ppm.score(empty(edge)).count() == 0


# 4 near duplicates


def _shingles(t):
    w = SPACED.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _classes_brute(rows):
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(k, _shingles(t)) for k, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, r = sorted((find(a), find(b)))
                parent[r] = p
    return {k: find(k) for k, _ in rows}, dict(sets)


def _chained(n=60):
    """Texts of 40 words, each with one word more replaced than the one before: links only between near neighbours, one long chain."""
    words, out = [f"w{i}" for i in range(120)], []
    for i in range(n):
        out.append((1000 + i, " ".join(words)))
        words[(i * 11) % 120] = f"v{i}"
    return out


@pytest.mark.parametrize("which", ["docs", "edge", "chain", "boiler"])
def test_near_duplicates_are_brute_force(request, spark, which):
    if which == "chain":
        df = spark.createDataFrame(_chained(), "doc_id long, text string")
    elif which == "boiler":
        line = " ".join(f"b{i}" for i in range(60))
        df = spark.createDataFrame([(i, line + " " + " ".join(f"u{i}_{j}" for j in range(i % 23))) for i in range(150)], "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want, sets = _classes_brute(rows)
    out = neardup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(sets[r.doc_id]))


def test_dedup_keeps_columns_and_empty_tables(spark, edge):
    clash = edge.withColumns({"kept_id": F.lit(1), "Place": F.lit("p"), "_kept": F.lit(None).cast("string")})
    out = neardup.dedup(clash)
    assert out.schema == clash.schema and sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert neardup.near_duplicates(empty(edge)).count() == 0


def test_dedup_keeps_rows_with_null_ids(spark):
    df = spark.createDataFrame([(None, "some words here"), (2, "some words here"), (3, "some words here"), (None, "others"), (None, None)], "doc_id long, text string")
    assert collections.Counter((r.doc_id, r.text) for r in neardup.dedup(df).collect()) == {(None, "some words here"): 1, (2, "some words here"): 1, (None, "others"): 1, (None, None): 1}


def test_dedup_keeps_one_row_of_an_id(spark):
    df = spark.createDataFrame([(5, "b b"), (5, "a a"), (5, None), (5, "a a"), (1, "c c"), (1, "c c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.dedup(df).collect()) == [(1, "c c"), (5, "a a")]


def test_long_words_do_not_collide(spark):
    # equal bytes that swap places 65,536 apart
    block = "a" * 65536
    texts = ["b" + block[1:] + "c" + block[1:], "c" + block[1:] + "b" + block[1:]]
    df = spark.createDataFrame([(i, t + " one two three four") for i, t in enumerate(texts, 1)], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in neardup.near_duplicates(df).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]


@pytest.mark.parametrize("which", ["docs", "boiler"])
def test_blocks_of_a_bucket_lose_no_link(request, spark, which):
    if which == "boiler":
        line = " ".join(f"b{i}" for i in range(60))
        df = spark.createDataFrame([(i, line + " " + " ".join(f"u{i}_{j}" for j in range(i % 23))) for i in range(150)], "doc_id long, text string")
    else:
        df = request.getfixturevalue(which)
    one, many = (sorted(map(tuple, neardup.near_duplicates(df, block_rows=n).collect())) for n in (neardup.BLOCK_ROWS, 3))
    assert one == many


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 60), (7, 7), (60, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 100: 50}


# 5 personal data


def _pii_base(t):
    t, out = t or "", []
    add = lambda i, m: out.append((m.start(), i, m.end()))
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t) if "@" in t else ():
        add(0, m)
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            add(1, m)
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            add(2, m)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            add(3, m)
    return sorted(out)


HARD = [
    "a@b.c_d@e.f", "a@b@c.d x 1.2.3.4.5.6.7.8 300.1.1.1 é 001.2.3.255", "4111 1111-1111 1111  5 +1 (377) 555-0271..  +123", "1" * 50000, "1 " * 30000, "a@b" + ".c" * 30000,
    "4111111111111111, 4111 1111 1111 1112", "DE89 3704 0044 0532 0130 00 iban GB82WEST12345698765432 GB83WEST12345698765432", ' ssn 123-45-6789 then 987-65-4321 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "漢 a@b.cd 😀 x@y.zz",
]


def test_pii_base_spans(spark, docs, edge):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for df in (docs, edge, hard):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in pii.digest(pii.find(df)).collect():
            want = _pii_base(text[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
            assert {f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(",")) or not want
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(hard)).collect()}
    assert spans[7].count("iban") == 2 and spans[8].count("ssn") == 2 and spans[8].count("secret") == 1


def test_pii_redacts_and_runs_no_python(spark, edge):
    df = spark.createDataFrame([(1, "x a@b.cd y 1.2.3.4"), (2, None), (3, "clean"), (4, "a@b.c_d@e.f")], "doc_id long, text string").withColumn("spans", F.lit(1))
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "x [EMAIL] y [IP]", 2: None, 3: "clean", 4: "[EMAIL][EMAIL]"}
    plan = pii.digest(pii.find(edge))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.digest(pii.find(empty(edge))).count() == 0


@pytest.mark.parametrize("text", ["a.b@c.de, ", "é1.2.3.4 ", "x@y.zz+49 (30) 1234567;"])
def test_pii_is_fast_on_many_matches(spark, text):
    import time

    n = 100_000 // len(_pii_base(text))
    df = spark.createDataFrame([(1, text * n)], "doc_id long, text string")
    pii.redact(df.limit(0)).collect()
    began = time.time()
    row, clean = pii.digest(pii.find(df)).first(), pii.redact(df).first().text
    assert time.time() - began < 120
    want = _pii_base(text * n)
    assert row.base_sha256 == hashlib.sha256(",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
    out, at = [], 0
    for a, k, b in want:
        out += [(text * n)[at:a], f"[{pii.BASE[k].upper()}]"]
        at = b
    assert clean == "".join(out) + (text * n)[at:]


def _spans_brute(t):
    """All spans of one text, each kind by its own Python pattern and checks."""
    t = t or ""
    out = [(a, k, b, pii.BASE[k]) for a, k, b in _pii_base(t)]

    def mod97(m):
        flat = m.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1

    for k, kind in enumerate(pii.KINDS):
        if kind in pii.BASE:
            continue
        _, pattern, score, context, more = pii.KINDS[kind]
        for m in re.finditer(pattern, t):
            near = t[max(0, m.start() - pii.CONTEXT_CHARS) : m.start()].lower()
            if score + (more if re.search(context, near) else 0) >= pii.MIN_SCORE and (kind != "iban" or mod97(m[0])):
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_pii_added_spans_and_redaction_are_brute_force(spark, docs, edge):
    import random

    rng = random.Random(8)
    parts = ["123-45-6789", "ssn ", " token ", "0" * 40, "ab" * 16, "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", " ", ", ", "x", "é", "4111111111111111", "1.2.3.4", "a@b.cd", "+1 (377) 555-0271", "\n", "password: "]
    mixed = spark.createDataFrame([(i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))) for i in range(300)], "doc_id long, text string")
    for df in (docs, edge, mixed, spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in pii.digest(pii.find(df)).collect():
            assert r.spans == ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in _spans_brute(text[r.doc_id]))
        for r in pii.redact(df).collect():
            out, at, t = [], 0, text[r.doc_id] or ""
            merged = []
            for a, _, b, kind in _spans_brute(t):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b, kind])
            for a, b, kind in merged:
                out += [t[at:a], f"[{kind.upper()}]"]
                at = b
            assert r.text == (None if text[r.doc_id] is None else "".join(out) + t[at:])
    clash = mixed.withColumns({"_spans": F.lit(3), "_merged": F.lit("m"), "spans": F.lit(1.5)})
    assert pii.redact(clash).schema == clash.schema and pii.redact(clash).select("_spans", "_merged", "spans").distinct().collect() == [(3, "m", 1.5)]


# 6 decontamination


def _items(rows):
    return [(k, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for k, t in rows]


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_decontamination_is_brute_force(spark, docs, edge, block):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "one two"), (901, None), (902, "ONE, two!"), (903, "")], "item_id long, text string"))
    items = _items([(r.item_id, r.text) for r in bench.collect()])
    by = collections.defaultdict(set)
    for k, w in items:
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            by[tuple(w[i : i + n])].add(str(k))
    sizes = {len(k) for k in by}
    for df in (docs, edge):
        got = collections.Counter(tuple(r) for r in decontaminate.digest(decontaminate.scan(df, bench, block_words=block)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
        want = collections.Counter()
        for k, w in _items([(r.doc_id, r.text) for r in df.collect()]):
            hit, names = set(), set()
            for n in sizes:
                for i in range(len(w) - n + 1):
                    if (x := tuple(w[i : i + n])) in by:
                        hit |= set(range(i, i + n))
                        names |= by[x]
            want[(k, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))] += 1
        assert got == want


def test_removal_leaves_no_window(spark, docs):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    before = {r.doc_id: r for r in decontaminate.scan(docs, bench).collect()}
    out = decontaminate.remove(docs, bench)
    assert out.columns == docs.columns
    after = {r.doc_id: r.n_hit for r in decontaminate.scan(out, bench).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sum(r.n_hit > 0 for r in before.values()) and not any(after.values())
    assert all(r.text == text[r.doc_id] for r in out.collect() if not before[r.doc_id].n_hit)


def test_blocks_keep_repeated_and_null_ids_apart(spark):
    items = [" ".join(f"w{j}" for j in range(i * 12, i * 12 + 12)) for i in range(8)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame([(k, t) for k in (7, None) for t in (items[0], items[3] + " end", "clean", None, items[0])], "doc_id long, text string")
    whole, cut = (collections.Counter((r.doc_id, r.n_words, r.n_hit, *map(tuple, (r.hit_from, r.hit_to, r["items"]))) for r in decontaminate.scan(df, bench, block_words=b).collect()) for b in (4_000_000, 20))
    assert whole == cut and sum(whole.values()) == 10


@pytest.mark.parametrize("block", [4_000_000, 5])
def test_items_without_an_id_and_empty_benchmarks(spark, block):
    bench = spark.createDataFrame([(None, "one two three"), (7, "One two, three"), (3, "one two three"), (None, None), (8, "zwei")], "item_id long, text string")
    df = spark.createDataFrame([(1, "say one two three now"), (1, "say one two three now"), (2, "zwei"), (3, None), (4, "clean")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_hit, r["items"]) for r in decontaminate.scan(df, bench, block_words=block).collect())
    assert got == [(1, 3, [None, "3", "7"]), (1, 3, [None, "3", "7"]), (2, 1, ["8"]), (3, 0, []), (4, 0, [])]
    rows = decontaminate.digest(decontaminate.scan(df, bench, block_words=block)).where("doc_id = 1").collect()
    assert {(r.n_items, r.items_sha256) for r in rows} == {(3, hashlib.sha256(b"3,7").hexdigest())}
    none = decontaminate.digest(decontaminate.scan(df, empty(bench), block_words=block)).collect()
    assert len(none) == 5 and not any(r.n_hit or r.n_items for r in none)
    assert decontaminate.scan(empty(df), bench, block_words=block).count() == 0
    assert [r.text for r in decontaminate.remove(df, empty(bench), block_words=block).collect()] == [r.text for r in df.collect()]


def test_long_texts_are_scanned_whole(spark):
    item = " ".join(f"w{i}" for i in range(14))
    text = "long " * 900_000 + item + " end"
    row = decontaminate.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.n_words, row.n_hit, row.hit_from, row.hit_to) == (900_015, 14, [900_000], [900_014])


def test_removal_is_the_same_in_blocks(spark, docs, edge):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(i, " ".join(words[i * 4 : i * 4 + 12])) for i in range(12)] + [(90, "before after"), (91, "")], "item_id long, text string")
    texts = ["before " + ", ".join(words) + " after.", " ".join(words[3:30]), "é " + " ".join(words[:12]) + " x", None, "", "clean one", " ".join(words[:12])]
    df = spark.createDataFrame([(k, t, "en") for k in (1, None) for t in texts], "doc_id long, text string, lang string")
    real = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    for rows, items, block in ((df, bench, 20), (docs, real, 300), (edge, bench, 20)):
        one, many = (decontaminate.remove(rows, items, block_words=b) for b in (4_000_000, block))
        assert many.columns == rows.columns
        assert collections.Counter(map(tuple, one.collect())) == collections.Counter(map(tuple, many.collect()))


# 7 and 8 tokens


def test_encoder_keeps_added_tokens(paths):
    import random

    from tokenizers import Tokenizer

    rng, path = random.Random(4), paths("byte_bpe_50k.json")
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "see", " here", "\n", "é", "ж", "'s", "."]
    texts = ["see <|endoftext|> here", "<|endoftext|>", *("".join(rng.choice(parts) for _ in range(9)) for _ in range(600))]
    for plain in (False, True):
        library, own = Tokenizer.from_file(path), tokens.Encoder(path, plain)
        library.encode_special_tokens = plain
        for t, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_is_the_library(paths):
    import random

    from tokenizers import Tokenizer

    rng, path = random.Random(3), paths("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), tokens.Encoder(path)
    alphabets = ["ab \n.1é|", "ab . 1é,é%", "abж .²1", "ab's .", "ab \n\t'.1é \x1f　", "a×÷ɏɐᴀ'1 \n", "l'ré \x85\u2003.", "e\u0301 '\r\n1漢 \x0b", "a<|endoftext|>' "]
    texts = ["", " ", "  a", "a ", "it's 'll", "x" * 3000000, "'s" * 70000, "ab" * 40000 + " " + "ab" * 32767 + "ba" + "ab" * 7232, *("".join(rng.choice(a) for _ in range(40)) for a in alphabets for _ in range(300))]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_id_files_round_trip(request, which, paths):
    from tokenizers import Tokenizer

    df, path = request.getfixturevalue(which), paths("byte_bpe_50k.json")
    library, want, at = Tokenizer.from_file(path), collections.Counter(), 0
    for k, t in sorted((r.doc_id, r.text or "") for r in df.collect()):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want[(k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        at += len(ids)
    assert collections.Counter(tuple(r) for r in tokens.read_batches(tokens.write_batches(df, path, sequence=64, file_ids=9000)).collect()) == want
    assert tokens.read_batches(tokens.write_batches(empty(df), path)).count() == 0


def test_encoder_survives_collisions_and_a_full_store(paths, texts, monkeypatch):
    path, own = paths("byte_bpe_50k.json"), [t or "" for t in texts.values()]
    want = [x.tolist() for x in tokens.Encoder(path).encode(own)]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 100)
    small = tokens.Encoder(path)
    assert [small.encode([t])[0].tolist() for t in own] == want
    monkeypatch.setattr(tokens, "hash_bytes", lambda raw: np.zeros(len(raw), np.uint64))  # all pieces of one length collide
    bad = tokens.Encoder(path)
    assert [x.tolist() for x in bad.encode(own)] == want and bad.salt == 2


def test_sequences_are_views_of_the_mapped_file(docs, paths, tmp_path):
    import pyarrow as pa

    files = sorted(tokens.write_batches(docs, paths("byte_bpe_50k.json"), str(tmp_path), sequence=64, file_ids=5000).collect(), key=lambda r: r.start)
    want = [i for x in tokens.Encoder(paths("byte_bpe_50k.json")).encode([r.text or "" for r in docs.orderBy("doc_id", "text").collect()]) for i in [*x.tolist(), 2]]
    assert len(files) > 3 and sum(r.n_ids for r in files) == len(want)
    got = []
    for r in files:
        rows = tokens.Sequences(f"{tmp_path}/{r.name}.arrow")
        before = pa.total_allocated_bytes()
        parts = [rows.sequence(i) for i in range(len(rows))]
        assert pa.total_allocated_bytes() == before and not any(ids.flags.owndata for ids, _ in parts)
        assert all(len(ids) == len(mask) == 64 for ids, mask in parts) and all(mask.true_count == 64 for _, mask in parts[:-1])
        got += [i for ids, mask in parts for i in ids[: mask.true_count].tolist()]
        with pytest.raises(IndexError):
            rows.sequence(len(rows))
    assert got == want


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_separator_scan(docs, edge, paths, block):
    from tokenizers import Tokenizer

    path = paths("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, edge):
        want = collections.Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in df.collect())
        assert collections.Counter(tuple(r) for r in token_counts.count_tokens(df, path, block_ids=block).collect()) == want
    assert token_counts.count_tokens(empty(edge), path).count() == 0


def test_flat_files_roll_over(docs, paths):
    one = collections.Counter(tuple(r) for r in tokens.read_batches(tokens.write_batches(docs, paths("byte_bpe_50k.json"))).select("doc_id", "n_tokens").collect())
    assert collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, paths("byte_bpe_50k.json"), file_ids=3000).collect()) == one


def test_scan_counts_a_tail_without_separator(spark, tmp_path):
    np.array([5, 9, 9, 1, 2, 3, 9, 4, 4, 4, 4, 4], "<u2").tofile(tmp_path / "x.bin")
    files = spark.createDataFrame([("x", 12, 2), ("none", 0, 2)], "name string, n_ids long, width int")
    for block in (1, 2, 3, 5, 100):
        got = {(r.ordinal, r.n_tokens) for r in token_counts.scan_flat(files, str(tmp_path), 9, block).collect()}
        assert got == {(0, 2), (1, 1), (2, 4), (3, 5)}


# 9 SentencePiece


def test_samples_are_distinct_and_decode(docs, texts, paths):
    path = paths("piece_bpe_32k.model")
    rows = segment.decode(segment.encode(docs.limit(40), path, k=4), path).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert r.text == texts[r.doc_id] and 0 <= r.inclusion <= 1 and r.log_prob <= 0
        by[r.doc_id].append(tuple(r.ids))
    assert all(len(v) == len(set(v)) == 4 for v in by.values())
    again = {(r.doc_id, r["sample"]): tuple(r.ids) for r in segment.encode(docs.limit(40).repartition(5), path, k=4).collect()}
    assert again == {(r.doc_id, r["sample"]): tuple(r.ids) for r in rows}


def test_sampling_without_replacement_has_the_right_odds(paths):
    vocab, n = segment.Vocabulary(paths("piece_bpe_32k.model")), 3000
    first, pairs, log_p = collections.Counter(), collections.Counter(), {}
    for row in segment.sample_texts(vocab, list(range(n)), ["abc d"] * n, 2, 5):
        a, b = (tuple(r[0]) for r in row)
        first[a] += 1
        pairs[a, b] += 1
        log_p.update({a: row[0][1], b: row[1][1]})
    assert sum(map(math.exp, log_p.values())) <= 1 + 1e-6
    for a, k in first.most_common(3):
        p = math.exp(log_p[a])
        assert abs(k / n - p) < 4 * math.sqrt(p / n)
    for (a, b), k in pairs.most_common(3):
        p = math.exp(log_p[a] + log_p[b]) / (1 - math.exp(log_p[a]))
        assert abs(k / n - p) < 4 * math.sqrt(p / n)


def test_short_texts_run_out_of_segmentations(paths):
    vocab = segment.Vocabulary(paths("piece_bpe_32k.model"))
    for text, k in (("abc de fgh", 6), ("ab", 50), ("a", 5), ("I ", 9)):
        for row in segment.sample_texts(vocab, list(range(150)), [text] * 150, k, 5):
            assert len({tuple(r[0]) for r in row}) == len(row) <= k
            assert all(segment.decode_ids(vocab, r[0].tolist()) == text for r in row)
    assert len(segment.sample_texts(vocab, [1], ["ab"], 50, 5)[0]) == 4


def test_every_segmentation_of_short_texts_is_found(paths):
    vocab = segment.Vocabulary(paths("piece_bpe_32k.model"))
    pieces = {vocab.sp.id_to_piece(i) for i in range(vocab.sp.get_piece_size()) if not (vocab.sp.is_control(i) or vocab.sp.is_unknown(i) or vocab.sp.is_byte(i) or vocab.sp.is_unused(i))}

    def count(word):
        ways = [1] + [0] * len(word)
        for b in range(1, len(word) + 1):
            ways[b] = sum(ways[a] for a in range(b) if word[a:b] in pieces) + (ways[b - 1] if word[b - 1] not in pieces else 0)
        return ways[-1]

    for text in ("ab", "a", "the", "I ", "of", "abc de", "漢"):
        n = math.prod(count("▁" + w) if w else 1 for w in text.split(" "))
        for key in range(20):
            for k in (n - 1, n, n + 5):
                row = segment.sample_texts(vocab, [key], [text], k, 5)[0] if k else []
                assert len({tuple(r[0]) for r in row}) == len(row) == min(k, n), (text, k)
                if k >= n:
                    assert all(r[2] == 1 for r in row) and sum(math.exp(r[1]) for r in row) == pytest.approx(1, abs=1e-6)
    assert len(segment.sample_texts(vocab, [1], ["ab"], 50, 5)[0]) == 4


def _segmentations(vocab, text):
    """{ids: log probability} of a short text, by enumeration; probabilities are those of whole words, which are cut apart."""
    pieces = {vocab.sp.id_to_piece(i): i for i in range(vocab.sp.get_piece_size()) if not (vocab.sp.is_control(i) or vocab.sp.is_unknown(i) or vocab.sp.is_byte(i) or vocab.sp.is_unused(i))}
    least = math.log(1 / (vocab.sp.get_piece_size() + segment.RANK_SHIFT)) - 1

    def ways(word):
        if not word:
            return [((), 0.0)]
        out = []
        for n in range(1, len(word) + 1):
            if word[:n] in pieces:
                i = pieces[word[:n]]
                head = ((i,), -math.log(max(0.0, -vocab.sp.get_score(i)) + segment.RANK_SHIFT))
            elif n == 1:
                raw = word[0].encode()
                head = (tuple(vocab.sp.piece_to_id(f"<0x{b:02X}>") for b in raw), len(raw) * least)
            else:
                continue
            out += [(head[0] + ids, head[1] + lp) for ids, lp in ways(word[n:])]
        return out

    total = {(): 0.0}
    for word in re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁")):
        own = ways(word)
        norm = math.log(sum(math.exp(lp) for _, lp in own))
        total = {a + b: x + y - norm for a, x in total.items() for b, y in own}
    return total


def test_segmentations_are_those_of_the_enumerated_lattice(paths):
    vocab = segment.Vocabulary(paths("piece_bpe_32k.model"))
    for text, n in (("ab", 4), ("to be", 16), ("the", 8), ("I ", None), ("漢 x", None), ("é\U0001f600", None)):
        want = _segmentations(vocab, text)
        assert n in (None, len(want))
        for key in range(5):
            got = {tuple(r[0].tolist()): r for r in segment.sample_texts(vocab, [key], [text], len(want) + 2, 5)[0]}
            assert got.keys() == want.keys()
            assert all(r[1] == pytest.approx(want[ids], rel=1e-5, abs=1e-5) and r[2] == 1 for ids, r in got.items())


def test_inclusion_scores_weigh_to_one(paths):
    # of samples with inclusion scores, 1 / score is an unbiased weight: each segmentation's mean weight over keys is 1
    vocab, n = segment.Vocabulary(paths("piece_bpe_32k.model")), 4000
    weight, square = collections.Counter(), collections.Counter()
    for row in segment.sample_texts(vocab, list(range(n)), ["to be"] * n, 3, 7):
        for ids, _, score in row:
            weight[tuple(ids.tolist())] += 1 / score
            square[tuple(ids.tolist())] += 1 / score**2
    want = sorted(_segmentations(vocab, "to be").items(), key=lambda x: -x[1])
    for ids, _ in want[:4]:
        mean = weight[ids] / n
        assert abs(mean - 1) < 5 * math.sqrt((square[ids] / n - mean**2) / n) + 1e-9


def test_samples_do_not_depend_on_the_store(paths, texts, monkeypatch):
    vocab = segment.Vocabulary(paths("piece_bpe_32k.model"))
    rows = sorted(texts.items())[:40]
    keys, own = [k for k, _ in rows], [t or "" for _, t in rows]
    flat = lambda out: [(r[0].tolist(), r[1], r[2]) for row in out for r in row]
    whole = flat(segment.sample_texts(vocab, keys, own, 3, 5))
    monkeypatch.setattr(segment, "CACHE_CHARS", 10)
    assert flat([r for k, t in zip(keys, own, strict=True) for r in segment.sample_texts(vocab, [k], [t], 3, 5)]) == whole
    # a collision of word hashes starts the store anew with another salt
    vocab.lattices.clear()
    monkeypatch.setattr(segment, "place_weights", lambda place, longest: np.full(len(place), vocab.lattices.salt - 77, np.uint64))
    assert flat(segment.sample_texts(vocab, keys[:1], ["ab cd"], 2, 5)) and vocab.lattices.salt == 78


def test_segment_edges(edge, paths):
    path = paths("piece_bpe_32k.model")
    rows = segment.digest(edge, path).collect()
    assert {r.doc_id for r in rows} == {k for k, *_ in EDGE} and all(r.round_trip for r in rows)
    assert [(r.n_pieces, r.inclusion) for r in rows if r.doc_id == 2] == [(0, 1.0)]
    assert segment.encode(empty(edge), path).count() == 0
    twice = segment.decode(segment.encode(edge, path).withColumn("text", F.lit(7)), path)
    assert twice.columns == ["doc_id", "sample", "ids", "log_prob", "inclusion", "text"] and dict(twice.dtypes)["text"] == "string"
    assert {r.doc_id: r.text for r in twice.collect()} == {k: t or "" for k, t, _ in EDGE}


# 10 URLs


def test_url_rules_and_model(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y"), (2, "https://x.net/"), (3, "http://x.net"), (4, "http://q.example.com/de/5"), (5, "http://q.example.com/fr/5"), (6, "https://news.org/fr/a/b#c"),
        (7, None), (8, "no-scheme"), (9, "http://m.casino-win.example.com/en/3.html"), (10, "http://net/x"), (11, "http://subnet/x"), (12, "http://blog.thsher.example.org/en/77"), (1, "http://A.Example.NET/en/1?x#y"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("z"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("x.net", "/", "net/", "block") and got[3][:3] == ("x.net", "", None)
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2] is None and got[6] == ("news.org", "/fr/a/b", "org/fr/", "allow")
    assert got[7][:3] == ("", "", None) and got[8][:3] == ("", "", None) and got[9][3] == "block" and got[10][2] == "net/" and got[11][2] is None and got[12][3] == "allow"
    plan = urls.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_null_ids_pass(spark, paths):
    df = spark.createDataFrame([(None, "some words here"), (2, "some words here"), (None, None)], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    bench = spark.createDataFrame([(None, "some words"), (1, None)], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1)], "doc_id long, toxic int")
    assert tokens.read_batches(tokens.write_batches(df, paths("byte_bpe_50k.json"))).count() == 3
    assert token_counts.count_tokens(df, paths("byte_bpe_50k.json")).count() == 3
    for out in (quality.judge(df), ppm.score(df), neardup.near_duplicates(df), pii.digest(pii.find(df)), decontaminate.scan(df, bench), toxicity.score(df, labels)):
        assert out.count() == 3
    assert segment.encode(df, paths("piece_bpe_32k.model")).select("doc_id").distinct().count() == 2


# pipeline


def test_pipeline_is_its_stages(spark, docs, texts):
    import corpus_pipeline as cp

    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    df, seen = docs, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        df = stage(spark, df, FOLDER)
        assert df.columns == docs.columns, name
        seen.append(df.count())
    rows = df.collect()
    kept = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    want, _ = _classes_brute([(k, texts[k]) for k in sorted(kept)])
    assert {r.doc_id for r in rows} == {k for k, v in want.items() if k == v}
    assert all(r.n_chars == len(r.text) for r in rows)
    assert not any(_pii_base(r.text) for r in rows)
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.scan(df, bench)).collect())
    last = cp.run(spark, FOLDER)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in rows}


def test_pipeline_stages_on_edges(spark, edge):
    import corpus_pipeline as cp

    line = "this is a line of some ten words or a few more "
    more = [(20, line + "mail a@b.cd now", "en"), (21, line + "mail a@b.cd now", "en"), (21, line + "mail a@b.cd now", "en"), (None, line + "call +1 (377) 555-0271", None), (22, "   ", "en"), (23, line * 3000, "en")]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string")
    df = edge.unionByName(extra, allowMissingColumns=True).withColumns({"kept_id": F.lit(1), "_row_key": F.lit("r"), "hit_from": F.lit(2), "_spans": F.lit(None).cast("int")})
    for rows in (df, df.drop("lang")):
        assert {r.doc_id for r in cp.quality_rules(spark, rows, FOLDER).collect()} <= {7, 8, 20, 21, None, 23}
    got = sorted(((r.doc_id, r.text) for r in cp.near_dedup(spark, extra, FOLDER).collect()), key=str)
    assert collections.Counter(k for k, _ in got) == {20: 1, None: 1, 22: 1, 23: 1}
    assert {r.doc_id for r in cp.benchmark_decontamination(spark, df, FOLDER).collect()} == {3, 4, 5, 7, 8, 9, 10, 20, 21, None, 23}
    out = {r.doc_id: r.text for r in cp.personal_data(spark, df, FOLDER).collect()}
    assert out[20] == line + "mail [EMAIL] now" and out[None] == line + "call [PHONE]" and out[2] is None and out[1] == ""
    assert [r.ids for r in cp.sentencepiece(spark, df.where("doc_id = 2"), FOLDER).collect()] == [[]]
    for name, stage in cp.STAGES:
        done = stage(spark, df, FOLDER)
        assert name == "sentencepiece" or done.schema.names == df.columns
        assert stage(spark, empty(df), FOLDER).count() == 0


def test_entry_lists_all():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", x)[0] for x in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names
