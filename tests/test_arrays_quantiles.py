"""Array features and percentiles against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from starweave.operators import arrays, quantiles

ITEMS = [(1, '[{"a":"x","b":true},{"a":"y","b":false},null,{"a":3}]'), (2, "[]"), (3, None), (4, "no json"), (5, '{"a":"x"}'), (6, '[{"a":"x","c":[1,2]}]'), (6, '[{"a":"x","c":[1,2]}]')]
WANT = [(1, 0, "x", True), (1, 1, "y", False), (1, 2, None, None), (1, 3, "3", None), (6, 0, "x", None), (6, 0, "x", None)]


@pytest.mark.parametrize("form", ["text", "variant", "array"])
def test_elements(spark, form):
    df = spark.createDataFrame(ITEMS, "id int, items string").selectExpr("*", "'t' AS a", "'e' AS value", "0 AS pos")
    if form == "variant":
        df = df.withColumn("items", F.try_parse_json("items"))
    if form == "array":
        df = df.withColumn("items", F.from_json("items", "array<struct<a string, b boolean>>"))
    fields = {"a": "string", "b": "boolean"}
    got = [tuple(r) for r in arrays.elements(df, "items", fields, ["id"], place="place").collect() if r.id != 5]
    assert sorted(got, key=str) == sorted(WANT, key=str)
    outer = [tuple(r) for r in arrays.elements(df, "items", fields, ["id"], outer=True, place="place").collect() if r.id != 5]
    assert sorted(outer, key=str) == sorted([*WANT, (2, None, None, None), (3, None, None, None), (4, None, None, None)], key=str)


def test_elements_meet_facts(spark):
    notes = spark.createDataFrame([(1, '[{"t":"edema","n":false},{"t":"edema","n":true}]'), (1, '[{"t":"edema","n":false}]'), (2, "[]"), (3, None), (9, '[{"t":"mass","n":false}]')], "adm int, found string")
    facts = spark.createDataFrame([(1, "EW"), (2, "EW"), (3, "URGENT")], "adm int, kind string")
    got = arrays.element_counts(notes, "found", {"t": "string", "n": "boolean"}, "adm", facts, "adm", ["kind", "t"], F.expr("NOT n"))
    assert [tuple(r) for r in got.collect()] == [("EW", "edema", 2)]
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "k int, at int, t string")
    back = arrays.as_json(rows, ["k"], ["at", "t"], ["at"], "items")
    assert sorted(tuple(r) for r in back.collect()) == [(1, '[{"at":1,"t":"a"},{"at":2,"t":"b"}]'), (2, '[{"at":1}]')]
    assert sorted(tuple(r) for r in arrays.elements(back, "items", {"at": "int", "t": "string"}, ["k"]).collect() if r.t) == [(1, 1, "a"), (1, 2, "b")]


def _percentile(values, p):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = p * (len(values) - 1)
    lo, hi = int(at), min(int(at) + 1, len(values) - 1)
    return values[lo] + (at - int(at)) * (values[hi] - values[lo])


@pytest.mark.parametrize(("few", "accuracy"), [(1 << 16, 2000), (40, 100), (5, 20)])
@pytest.mark.parametrize("by", [["g"], []])
def test_selection_is_exact(spark, by, few, accuracy):
    rng = random.Random(4)
    one = lambda: rng.choice([1.0, 5.0, rng.random() * 100, rng.gauss(0, 1) ** 9])
    rows = [(g, one(), None if rng.random() < 0.1 else float(rng.randint(0, 3))) for g, n in (("large", 6000), ("small", 7), (None, 900), ("same", 0)) for _ in range(n)]
    rows += [("none", None, None)] * 3 + [("same", 2.5, 2.5)] * 2000
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(6)
    targets = {"p50": ("x", 0.5), "p90": ("x", 0.9), "quarter": ("y", 0.25), "least": ("x", 0.0), "most": ("x", 1.0)}
    got = quantiles.exact(df, by, targets, few, accuracy).collect()
    groups = {r[0] for r in rows} if by else {None}
    assert len(got) == len(groups)
    for r in got:
        own = [x for x in rows if not by or x[0] == r.g]
        for name, (c, p) in targets.items():
            want = _percentile([x[1 if c == "x" else 2] for x in own], p)
            assert r[name] == want if want is None else r[name] == pytest.approx(want, rel=1e-12), (r, name)


def test_a_group_is_never_gathered(spark):
    """A window or a list holds what is in brackets, and what is below them is one row a task."""
    df = spark.range(40000).selectExpr("id % 2 AS g", "cast(id * 7919 % 40009 AS double) AS v").repartition(8)
    rows = quantiles.staged(df.selectExpr("g", "v AS v0"), "values")
    brackets = quantiles._brackets(rows, ["g"], ["m"], {"m": "v0"}, {"m": 0.5}, 64, 400, 2.0)
    for r in brackets.collect():
        inside = rows.where((F.col("g") == r.g) & F.col("v0").between(r.m_lo, r.m_hi)).count()
        assert 2 <= inside <= 600 and r.m_n == 20000
    plan = quantiles._pick(rows, brackets, ["g"], ["m"], {"m": "v0"}, {"m": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_list" not in plan


def test_empty_tables_and_sketches(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert quantiles.exact(df, ["g"], {"m": ("x", 0.5)}).collect() == []
    rows = spark.range(30000).selectExpr("id % 30 AS day", "id % 3 AS month", "cast(id AS double) AS v")
    daily = quantiles.sketches(rows, ["day", "month"], "v", "s")
    for r in quantiles.merged(daily, ["month"], "s").select("month", "s_n", quantiles.quantile("s", 0.9).alias("q")).collect():
        assert r.s_n == 10000 and abs(r.q / 30000 - 0.9) < 3 * quantiles.rank_error()
