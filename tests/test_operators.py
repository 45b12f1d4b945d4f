"""Operators on small tables with results worked out by hand."""

import datetime as dt
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from starweave.functions import measures as M
from starweave.operators import checks, joins, refresh, text, windows
from starweave.sources import io
from starweave.streaming.stream_refresh import stream_refresh

TS = dt.datetime


def test_abnormal_is_three_valued(spark):
    df = spark.createDataFrame([(1, None, 1.0, 5.0), (2, 1.0, None, 5.0), (3, 1.0, 1.0, 5.0), (4, 5.0, 1.0, 5.0), (5, 5.1, 1.0, 5.0), (6, 0.9, 1.0, 5.0)], "k int, v double, lo double, hi double")
    got = {r.k: r.a for r in df.select("k", M.abnormal("v", "lo", "hi").alias("a")).collect()}
    assert got == {1: None, 2: None, 3: False, 4: False, 5: True, 6: True}


def test_dates_and_durations(spark):
    df = spark.createDataFrame([(TS(2024, 1, 1), TS(2024, 1, 31, 23)), (TS(2024, 1, 2), TS(2024, 1, 1)), (TS(2024, 1, 1), None)], "a timestamp_ntz, b timestamp_ntz")
    rows = df.select(M.date_key("b").alias("k"), M.year_month(M.date_key("b")).alias("ym"), M.duration("a", "b", "hour").alias("h"), M.whole_days("a", "b").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(20240131, 202401, 743.0, 30), (20240101, 202401, -24.0, -1), (None, None, None, None)]


def test_mapping_keeps_unparsable_text_as_null(spark):
    df = spark.createDataFrame([("1", ""), ("x", "2024-01-02 03:04:05")], "a string, b string")
    rows = M.apply_mapping(df, [("a", "n", "int"), ("b", "t", "timestamp_ntz")]).collect()
    assert [tuple(r) for r in rows] == [(1, None), (None, TS(2024, 1, 2, 3, 4, 5))]


def test_blanks_are_absent(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), ("x",)], "a string")
    assert [r.p for r in df.select(M.present("a").alias("p")).collect()] == [False, False, False, True]
    assert [r.a for r in M.blank_to_null(df).collect()] == [None, None, None, "x"]


def test_header_rows_go(spark):
    df = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), (None, "b", 3)], "a string, b string, n int")
    assert {r.n for r in io.drop_header_rows(df).collect()} == {2, 3}


def test_csv_quotes_newlines_and_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('k,t\n1,"a, ""b""\nc"\n2,\n')
    df = io.read_csv(spark, str(tmp_path / "in"), "k int, t string", multiline=True)
    assert {(r.k, r.t) for r in df.collect()} == {(1, 'a, "b"\nc'), (2, None)}
    io.write_csv(df, str(tmp_path / "out"))
    back = io.read_csv(spark, str(tmp_path / "out"), "k string, t string", pattern="*.csv.gz")
    assert {(r.k, r.t) for r in back.collect()} == {("1", 'a, "b"\\nc'), ("2", None)}
    assert io.read_optional(spark, str(tmp_path / "none"), "k int").count() == 0


def test_calendar(spark):
    df = io.date_spine(spark, "2100-01-01", "2230-12-31")
    assert df.count() == 47846 and len(df.columns) == 25
    row = io.date_spine(spark, "2024-02-29", "2024-02-29").first()
    assert row.date_key == 20240229 and row.is_month_end and row.is_leap_year and row.day_of_week == 5 and row.quarter_end == dt.date(2024, 3, 31)


def test_partition_overwrite_keeps_others(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.range(6).select("id", (F.col("id") % 3).alias("b")), path, partition="b")
    io.overwrite_partitions(spark.createDataFrame([(100, 1)], "id long, b long"), path, "b")
    assert {(r.id, r.b) for r in spark.read.parquet(path).collect()} == {(0, 0), (3, 0), (100, 1), (2, 2), (5, 2)}


def test_readmission_uses_the_row_before(spark):
    df = spark.createDataFrame([(1, 10, TS(2024, 1, 1), TS(2024, 1, 3)), (1, 11, TS(2024, 2, 2, 23), None), (1, 12, TS(2024, 3, 1), TS(2024, 3, 2)), (2, 13, TS(2024, 1, 1), TS(2024, 1, 2))], "s int, k int, a timestamp_ntz, b timestamp_ntz")
    got = {r.k: (r.is_repeat, r.gap_days) for r in windows.readmission(df, "s", "a", "b", "k").collect()}
    assert got == {10: (False, None), 11: (True, 30), 12: (False, None), 13: (False, None)}


def test_quartiles_are_ntile(spark):
    rows = [(i, None if i % 9 == 0 else float(i % 5)) for i in range(27)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.t for r in windows.quartile(df, "v", "k", "t").collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    sizes, want = [7, 7, 7, 6], {}
    for tile, n in enumerate(sizes, 1):
        for _ in range(n):
            want[order.pop(0)[0]] = tile
    assert got == want


def test_asof_is_strict_and_bounded(spark):
    events = spark.createDataFrame([(1, TS(2024, 1, 10)), (2, TS(2024, 1, 10))], "k int, at timestamp_ntz")
    facts = spark.createDataFrame([(1, TS(2024, 1, 9), 5.0, 1), (1, TS(2024, 1, 9), 6.0, 2), (1, TS(2024, 1, 10), 7.0, 3), (2, TS(2024, 1, 1), 8.0, 4)], "k int, ft timestamp_ntz, v double, id int")
    assert {r.k: r.last_value for r in joins.asof_last(events, facts, "k", "at", "ft", "v", "id", 5).collect()} == {1: 6.0, 2: None}
    assert {r.k: r.last_value for r in joins.range_last(events, facts, "k", "at", "ft", "v", "id", 5).collect()} == {1: 6.0, 2: None}
    assert {r.k: r.last_value for r in joins.asof_last(events, facts, "k", "at", "ft", "v", "id").collect()} == {1: 6.0, 2: 8.0}


def _source(spark, rows):
    return spark.createDataFrame(rows, "id int, day int, updated_ts timestamp")


def _build(rows):
    return rows.groupBy("day").agg(F.count("*").alias("n"))


def _state(spark, path):
    spark.catalog.refreshByPath(path)
    return {(r.day, r.n) for r in spark.read.parquet(path).collect()}


def test_refresh_carries_forward_and_is_a_no_op_when_nothing_changed(spark, tmp_path):
    path, control = str(tmp_path / "t"), str(tmp_path / "c")
    args = {"key": "day", "build": _build, "partition": "bucket", "of_key": lambda k: F.pmod(k, F.lit(4)), "deletes": True}
    old = [(1, 1, TS(2024, 1, 1)), (2, 5, TS(2024, 1, 1)), (3, 2, TS(2024, 1, 1)), (4, 3, TS(2024, 1, 1))]
    assert refresh.refresh(spark, "t", path, control, _source(spark, old), **args).refreshed
    assert not refresh.refresh(spark, "t", path, control, _source(spark, old), **args).refreshed
    new = [(1, 1, TS(2024, 1, 1)), (2, 5, TS(2024, 1, 1)), (3, 7, TS(2024, 1, 5)), (5, 1, TS(2024, 1, 5))]  # 3 moved, 4 deleted, 5 came
    assert refresh.refresh(spark, "t", path, control, _source(spark, new), **args).refreshed
    assert _state(spark, path) == {(1, 2), (5, 1), (7, 1)}


def test_backfill_resumes_and_log_appends(spark, tmp_path):
    path = str(tmp_path / "t")
    src = spark.range(20).select(F.col("id").alias("k"))
    assert refresh.backfill_buckets(spark, path, src.where("k % 4 = 1"), "k", 4, lambda d: d) == [0, 1, 2, 3]
    assert refresh.backfill_buckets(spark, path, src, "k", 4, lambda d: d) == [0, 2, 3]
    log = str(tmp_path / "log")
    now = TS(2024, 1, 1)
    assert [refresh.log_run(spark, log, "p", now, now + dt.timedelta(seconds=3), 1, 2, "OK") for _ in range(2)] == [1, 2]


def test_build_order_and_cycles(spark):
    base = {"a": spark.range(3)}
    out = refresh.build_all({"c": (["b"], lambda t: t["b"].limit(1)), "b": (["a"], lambda t: t["a"])}, base)
    assert out["c"].count() == 1
    with pytest.raises(ValueError):
        refresh.build_all({"x": (["y"], None), "y": (["x"], None)}, base)


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "t")
    run = lambda cp: stream_refresh(spark, folder, "id int, day int", path, str(tmp_path / cp), "day", _build, "bucket", lambda k: F.pmod(k, F.lit(4)))
    spark.createDataFrame([(1, 1), (2, 5), (3, 2)], "id int, day int").write.mode("append").parquet(folder)
    run("c1")
    spark.createDataFrame([(4, 1)], "id int, day int").write.mode("append").parquet(folder)
    run("c1")
    assert _state(spark, path) == {(1, 2), (5, 1), (2, 1)}
    run("c2")
    assert _state(spark, path) == {(1, 2), (5, 1), (2, 1)}


def test_sections(spark):
    headers = {"finding": "findings", "impression": "impression"}
    df = spark.createDataFrame([("lead\nFINDINGS: a\nb\nOTHER: zz\nIMPRESSION: c\nFINDINGS: d",), ("no heading",), (None,), ("THE IMPRESSION: x",)], "t string")
    got = [r.s for r in df.select(text.sections("t", headers).alias("s")).collect()]
    assert got[0] == {"_preamble": "lead", "findings": "a\nb\nd", "impression": "c"}
    assert got[1] == {"_body": "no heading"} and got[2] == {"_body": ""} and got[3] == {"impression": "x"}


def test_assertions_on_golden_sentences(spark):
    lexicon = {"f": ["pleural effusion", "pneumothorax", "cirrhosis", "smoker", "tobacco", "pain"]}
    rows = [(1, "No focal consolidation, pleural effusion or pneumothorax."), (2, "Compatible with cirrhosis."), (3, "Denies tobacco but pain."), (4, "Former smoker."), (5, "Father was a smoker."), (6, "Return if pain returns.")]
    got = {(r.k, r.term.lower()): {a for a in text.ASSERTIONS if r[a]} for r in text.tag_entities(spark.createDataFrame(rows, "k int, t string"), "k", "t", lexicon).collect()}
    assert got == {
        (1, "pleural effusion"): {"negated"}, (1, "pneumothorax"): {"negated"}, (2, "cirrhosis"): {"uncertain"}, (3, "tobacco"): {"negated"}, (3, "pain"): set(),
        (4, "smoker"): {"historical"}, (5, "smoker"): {"family"}, (6, "pain"): {"hypothetical"},
    }


def test_levels(spark):
    df = spark.createDataFrame([("BMI 39",), ("bmi of 41",), ("morbidly obese",), ("thin",)], "t string")
    assert [r.s for r in df.select(text.severity(F.col("t")).alias("s")).collect()] == ["OBESE", "MORBID", "MORBID", "NONE"]


def test_compaction_and_profile(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(20).write.parquet(path)
    before = checks.fingerprint(spark.read.parquet(path))
    assert checks.profile_totals(checks.file_profile(spark, path)).first().files == 20
    assert checks.compact(spark, path) == 1
    spark.catalog.refreshByPath(path)
    assert checks.fingerprint(spark.read.parquet(path)) == before
    assert checks.file_profile(spark, path).count() == 1
    assert {r.format for r in checks.compare_formats(spark, spark.range(100).toDF("k"), str(tmp_path / "f")).collect()} == {"zstd", "snappy", "csv"}


def test_catalogue_and_declared_tables(spark, tmp_path):
    folder = str(tmp_path / "gold")
    io.create_tables(spark, folder, {"a": "k int", "log": "k int"})
    spark.range(2).selectExpr("cast(id as int) k").write.mode("append").parquet(f"{folder}/log")
    io.create_tables(spark, folder, {"a": "k int, v string", "log": "k int"}, keep=("log",))
    assert spark.read.parquet(f"{folder}/log").count() == 2 and spark.read.parquet(f"{folder}/a").columns == ["k", "v"]
    io.register(spark, "starweave_log", f"{folder}/log")
    io.register(spark, "starweave_log", f"{folder}/log")
    assert spark.table("starweave_log").count() == 2
    spark.sql("DROP TABLE starweave_log")
    io.write_json_sidecar(spark.range(2), f"{folder}/json")
    assert {r.value for r in spark.read.text(f"{folder}/json").collect()} == {'{"id":0}', '{"id":1}'}
    assert io.cap(spark.range(100), 10).count() == 10


def test_results_do_not_depend_on_partitions(spark):
    from starweave.plans import catalog

    names, folder = ("asof_last", "quartile", "note_concat", "obt_encounter"), "/root/testdata/sf0.001"
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([sorted(map(str, catalog.queries()[q](spark, folder).collect())) for q in names])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_two_source_merge_keeps_the_rest(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda d, n: lambda keys: d.join(keys, "k", "left_semi").withColumn("v", F.lit(n))
    src = spark.createDataFrame([(1,), (2,)], "k int")
    refresh.merge_two_sources(spark, path, src, "k", make(src, 1))
    refresh.merge_two_sources(spark, path, src.where("k = 2"), "k", make(src, 2))
    spark.catalog.refreshByPath(path)
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, 1), (2, 2)}


def test_radiology_rules(spark):
    df = spark.createDataFrame([
        (1, "EXAM: CT abdomen. Indication: fever; concern for abscess rule out stone\nmore", "CT ABDOMEN with biopsy and Biopsy, lumbar puncture K85.9 and N20.0, K85.9"),
        (2, "no cue", "portable chest pa"), (3, None, None), (4, "", "a walk"),
    ], "k long, note string, exam string")
    got = {r.k: r for r in df.select("k", text.modality(F.col("exam")).alias("m"), text.body_region(F.col("exam")).alias("b"), text.procedure_terms(F.col("exam")).alias("p"), text.reasons(F.col("note")).alias("r")).collect()}
    assert (got[1].m, got[1].b, got[1].p, got[1].r) == ("CT", "spine", ["biopsy", "lumbar puncture"], ["fever", "abscess", "stone"])
    assert (got[2].m, got[2].b, got[2].r) == ("XR", "chest", []) and (got[3].m, got[3].b, got[3].p) == ("OTHER", None, []) and got[4].m == "OTHER"
    codes = sorted((r.k, r.code) for r in text.cited_codes(df, "k", "exam").collect())
    assert codes == [(1, "K85.9"), (1, "N20.0")]


def test_payload_is_in_order_of_place(spark):
    notes = spark.createDataFrame([(1, "No fever. History of asthma, fever."), (2, "well")], "k long, note string")
    rows = text.payload(text.tag_entities(notes, "k", "note", {"s": ["fever"], "d": ["asthma"]}), "k").collect()
    assert [(r.k, r.n_entities) for r in rows] == [(1, 3)]
    found = json.loads(rows[0].entities)
    assert [(e["term"], e["negated"], e["historical"]) for e in found] == [("fever", True, False), ("asthma", False, True), ("fever", False, True)]


def test_lexicon_bounds_hold_in_every_script(spark):
    df = spark.createDataFrame([(1, "in éin inn In. ín in"), (2, "begin")], "k long, t string")
    assert [(r.k, r.n_hits) for r in text.lexicon_hits(df, "k", "t", {"x": ["in"]}).collect()] == [(1, 3)]


def test_compaction_keeps_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 5 < 4, F.col("id") % 5).alias("p"))
    df.repartition(40).write.partitionBy("p").parquet(path)
    checks.compact(spark, path, partition="p")
    out = spark.read.schema(df.schema).parquet(path)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert sorted(x.name for x in (tmp_path / "t").iterdir() if x.is_dir()) == ["p=0", "p=1", "p=2", "p=3", "p=__HIVE_DEFAULT_PARTITION__"]
    assert checks.file_profile(spark, path).count() == 5


def test_first_after_and_range_last_are_brute_force(spark):
    import datetime as dt
    import random

    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(hours=rng.randint(0, 200))
    keys = [1, 1, 1, 2, 3, None]
    anchors = [(i, rng.choice(keys), rng.choice([at(), at(), at(), None])) for i in range(80)]
    events = [(rng.choice(keys), rng.choice([at(), at(), at(), None]), float(i), i) for i in range(150)]
    a = spark.createDataFrame(anchors, "a long, k long, t timestamp_ntz")
    e = spark.createDataFrame(events, "k long, u timestamp_ntz, v double, e long")
    first = {r.a: r.f for r in joins.first_after(a, e.select("k", "u"), "k", "t", "u", "f").collect()}
    last = {r.a: r.last_value for r in joins.range_last(a, e, "k", "t", "u", "v", "e", 2).collect()}
    for i, k, t in anchors:
        later = [u for kk, u, *_ in events if k is not None and kk == k and t and u and u >= t]
        assert first[i] == min(later, default=None)
        near = [(u, n, v) for kk, u, v, n in events if k is not None and kk == k and t and u and t - dt.timedelta(days=2) <= u < t]
        assert last[i] == (max(near)[2] if near else None)


def test_overlay_keeps_untouched_partitions(spark):
    of_key = lambda k: F.pmod(k, F.lit(4))
    old = spark.createDataFrame([(i, 0, i % 4) for i in range(10)], "k long, v long, bucket long")
    touched = spark.createDataFrame([(1,), (9,)], "k long")
    new = spark.createDataFrame([(1, 7, 1)], "k long, v long, bucket long")  # 9 is gone
    out = refresh.overlay(refresh.carry_forward(new, old, touched, "k", "bucket", of_key), old, touched, "k", "bucket", of_key)
    assert sorted((r.k, r.v) for r in out.collect()) == [(i, 7 if i == 1 else 0) for i in range(9)]


def test_containment_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(joins, "PIECE_CHARS", 12)  # texts of several pieces
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("ab\né😀") for _ in range(n))
    texts = [(i, i % 2, some(rng.randint(0, 60))) for i in range(60)] + [(60, 0, None), (61, 1, "abab" * 9), (61, 1, "abab" * 9), (62, None, "aaa")]
    phrases = [(i, i % 2, some(rng.randint(0, 4) if i % 3 else rng.randint(5, 9))) for i in range(80)] + [(80, 1, "abab"), (80, 1, "abab"), (81, 0, None), (82, None, "a")]
    phrases += [(100 + i, g, t[k : k + 11]) for i, (_, g, t) in enumerate(texts[:60]) for k in [i % 13]]
    a, b = spark.createDataFrame(texts, "t int, g int, text string"), spark.createDataFrame(phrases, "p int, g int, phrase string")
    for n, on, most in itertools.product((1, 3, 4), ([], ["g"]), (0, 500_000)):
        if most or n == 3:
            monkeypatch.setattr(joins, "BROADCAST_CHARS", most)
            right = b if on else b.withColumnRenamed("g", "h")
            got = joins.containment(a, right, "text", "phrase", on, n).select("t", "p").collect()
            want = [(t, p) for t, g, x in texts for p, h, y in phrases if x and y and y in x and (not on or g is not None and g == h)]
            assert sorted(map(tuple, got)) == sorted(want)


def test_containment_keeps_runs_and_texts_apart(spark):
    # a text goes along with its candidates, not with each of its runs
    a = spark.createDataFrame([(1, "some words " * 4_000 + "the end of a long text"), (2, "the end")], "t int, text string")
    b = spark.createDataFrame([(1, "the end of a long text"), (2, "words some"), (3, "absent from all texts"), (4, "end")], "p int, phrase string")
    out = joins.containment(a, b, "text", "phrase", n=8)
    made = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode" in x and "[_gram#" in x]
    assert made and all(re.search(r", \[[\d, ]+\], false, \[_gram#", x) for x in made)  # the exploded array's columns end there
    assert sorted(map(tuple, out.select("t", "p").collect())) == [(1, 1), (1, 2), (1, 4), (2, 4)]
