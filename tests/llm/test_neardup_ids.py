"""Near-duplicates where ids repeat: every text of an id counts, in every order of the rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from starweave.llm import neardup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(n))


def brute(rows):
    """{doc_id: component} by all pairs of rows; the rows of an id are one document."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))})
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, (a, _)), (j, (b, _)) in itertools.combinations(enumerate(rows), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def result(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts)
    return {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}


@pytest.mark.parametrize("turn", [0, 1, 4])  # b before and after the unrelated row
def test_order_of_an_ids_rows(spark, turn):
    a, b = text(1), text(1) + " more"
    rows = list(itertools.permutations([(9, a), (5, b), (5, text(2))]))[turn]
    assert result(spark, rows) == {9: 5, 5: 5}


def test_many_repeated_ids_are_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for group in range(12):
        base = text(100 + group)
        for copy in range(4):
            rows.append((rng.randint(0, 40), base if copy % 2 else base + f" end{copy}"))
    rows += [(i, text(500 + i)) for i in range(0, 40, 3)] + [(7, None), (7, ""), (50, None), (51, " "), (52, "one two"), (53, "One  two")]
    want = brute(rows)
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        assert result(spark, rows, 1 + 4 * seed) == want


def test_dedup_drops_what_any_row_of_an_id_links(spark):
    a, b = text(1), text(1) + " more"
    for rows in ([(9, a), (5, b), (5, text(2))], [(5, text(2)), (9, a), (5, b)]):
        kept = neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
        assert [(r.doc_id, r.text) for r in kept] == [(5, min(b, text(2)))]


def test_null_ids_take_their_sets_component(spark):
    rows = [(9, text(1)), (None, text(1)), (None, text(2)), (None, ""), (3, text(1) + " more")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(9, 3), (None, 3), (None, None), (None, None), (3, 3)], key=str)


def test_recall_of_sampled_queries(spark):
    """Every row whose id is divisible by 100 against all rows: linked rows share a component, and no others' sets do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sets = {r.doc_id: ({" ".join(r.w[i : i + 5]) for i in range(max(len(r.w) - 4, min(1, len(r.w))))}) for r in docs.select("doc_id", words.alias("w")).collect()}
    asked = [d for d in sets if d % 100 == 0]
    links = [(q, d) for q in asked for d in sets if q != d and sets[q] and sets[d] and 100 * len(sets[q] & sets[d]) >= 75 * len(sets[q] | sets[d])]
    assert links and all(got[q] == got[d] for q, d in links)


def _met(rows, left, right, block_rows):
    """The pairs that meet in a cell, and the rows of both sides."""
    x, y = (df.collect() for df in neardup._cells(left, right, block_rows))
    cells = {}
    for r in x:
        cells.setdefault(r.cell, ([], []))[0].append(r.cls)
    for r in y:
        cells.setdefault(r.cell, ([], []))[1].append(r.cls)
    return {tuple(sorted((a, b))) for p, q in cells.values() for a in p for b in q if a != b}, len(x) + len(y)


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_pairs_across_components_meet(spark, block_rows):
    rng = random.Random(5)
    comp = {c: rng.choice([1, 1, 1, 1, 2, 3, c]) for c in range(40)}
    rows = sorted({(rng.randint(0, 25) // rng.randint(1, 3), c, comp[c]) for c in comp for _ in range(8)})
    got, _ = _met(rows, *neardup._meetings(spark.createDataFrame(rows, "key long, cls long, comp long")), block_rows)
    want = {tuple(sorted((a, b))) for k, a, c in rows for m, b, d in rows if k == m and c != d}
    assert want and want <= got


def test_a_large_component_is_not_dealt_out_by_bucket(spark):
    # one component in 50 buckets, and two documents outside it: 50 * 42 rows for each side where buckets are compared whole
    rows = [(k, c, 1) for k in range(50) for c in range(40)] + [(k, 100, 100) for k in range(50)] + [(0, 200, 200)]
    got, n = _met(rows, *neardup._meetings(spark.createDataFrame(rows, "key long, cls long, comp long")), 4096)
    assert got == {(c, 100) for c in range(40)} | {(c, 200) for c in range(40)} | {(100, 200)}
    assert n <= 2 + 40 + 40 + 4


def _join_rows(spark, condition, run):
    """Rows made by the joins that have condition in their description, while run() ran."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    before, made = store.executionsCount(), 0
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for i in range(before, runs.size()):
        at = runs.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for n in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in n.name() and condition in n.desc():
                metrics = n.metrics()
                rows = [m for m in (metrics.apply(j) for j in range(metrics.size())) if m.name() == "number of output rows"]
                made += sum(int(values.apply(m.accumulatorId()).replace(",", "")) for m in rows if values.contains(m.accumulatorId()))
    return made


def test_members_of_a_main_component_are_joined_once_not_once_a_bucket(spark):
    rows = [(k, c, 1) for k in range(50) for c in range(40)] + [(k, 100, 100) for k in range(50)] + [(0, 200, 200)]
    df = spark.createDataFrame(rows, "key long, cls long, comp long")
    made = _join_rows(spark, "LeftSemi", lambda: neardup._meetings(df))
    alone = _join_rows(spark, "LeftSemi", lambda: df.where("key = 0").join(df.where("key = 1").select("cls"), "cls", "left_semi").collect())
    assert alone == 41  # the count sees semi-joins
    assert 40 <= made <= 40 + 4  # 2,000 bucket rows of the component before


@pytest.mark.parametrize(
    "rows, most",
    [
        ([(i, text(i // 2) + " end" * (i % 2)) for i in range(12)], {"labels": 1, "rare": 0, "placed": 0, "left": 0}),  # no bucket is open
        ([(i, text(i)) for i in range(6)], {"labels": 1, "rare": 0, "placed": 0, "left": 0}),  # nothing is alike
    ],
)
def test_steps_with_nothing_left_run_no_jobs(spark, monkeypatch, rows, most):
    written, write = [], neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    assert result(spark, rows) == brute(rows)
    assert all(written.count(name) <= n for name, n in most.items())
