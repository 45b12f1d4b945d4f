"""Commit records, refresh from many sources, the stream's table, backfill and run log: each stopped at every step."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from starweave.operators import many_sources, refresh
from starweave.plans import wide
from starweave.sources import io, snapshots
from starweave.streaming import stream_table
from tests.test_wide import NEW, OLD, stamped, t  # noqa: F401


class Stop(Exception):
    pass


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def stopping(monkeypatch, target, name, after=False):
    """The next call of a step raises, before it does its work or after; later calls work."""
    real, state = getattr(target, name), {"left": 1}

    def step(*a, **k):
        if state["left"] and not after:
            state["left"] = 0
            raise Stop
        out = real(*a, **k)
        if state["left"]:
            state["left"] = 0
            raise Stop
        return out

    monkeypatch.setattr(target, name, step)


def test_replace_keeps_others_and_resolves(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda r: spark.createDataFrame(r, "k long, p string")
    one = snapshots.replace(spark, path, df([(1, "a"), (2, "b/=%"), (3, None), (4, "")]), "p", {"s": "1"})
    assert rows(snapshots.read(spark, path)) == rows(df([(1, "a"), (2, "b/=%"), (3, None), (4, "")])) and len(one.folders) == 4
    two = snapshots.replace(spark, path, df([(5, "a"), (6, "c")]), "p", {"u": "2"}, ["a", None, "c"], one)
    assert rows(snapshots.read(spark, path)) == rows(df([(5, "a"), (6, "c"), (2, "b/=%"), (4, "")])) and two.marks == {"s": "1", "u": "2"}
    assert rows(snapshots.read(spark, path, one)) == rows(df([(1, "a"), (2, "b/=%"), (3, None), (4, "")]))  # an older reader goes on
    assert rows(snapshots.read(spark, path, only=["c", "zz"])) == [(6, "c")] and rows(snapshots.read(spark, path, only=["zz"])) == []
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(spark, path, df([(9, "a")]), "p", {}, ["a"], one)  # from a state that is gone
    with pytest.raises(ValueError, match="not replaced"):
        snapshots.replace(spark, path, df([(9, "b/=%")]), "p", {}, ["a"], two)
    assert snapshots.vacuum(spark, path, 1) and rows(snapshots.read(spark, path)) == rows(df([(5, "a"), (6, "c"), (2, "b/=%"), (4, "")]))
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "none"))


@pytest.mark.parametrize(("name", "after", "committed"), [("stage", False, False), ("stage", True, False), ("publish", False, False), ("publish", True, True)])
def test_a_stopped_run_leaves_a_whole_table(spark, tmp_path, monkeypatch, name, after, committed):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, 0), (2, 1)], "k long, p int")
    one = snapshots.replace(spark, path, df, "p", {"s": "1"})
    stopping(monkeypatch, snapshots, name, after)
    with pytest.raises(Stop):
        snapshots.replace(spark, path, spark.createDataFrame([(7, 1)], "k long, p int"), "p", {"s": "2"}, [1], one)
    state = snapshots.latest(spark, path)
    assert (rows(snapshots.read(spark, path)), state.marks) == (([(1, 0), (7, 1)], {"s": "2"}) if committed else ([(1, 0), (2, 1)], {"s": "1"}))


def test_a_record_that_was_cut_off_does_not_count(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, 0)], "k long, p int")
    one = snapshots.replace(spark, path, df, "p", {})
    whole = (tmp_path / "t/_commits/000000000001.json").read_text()
    (tmp_path / "t/_commits/000000000002.json").write_text(whole[: len(whole) // 2])
    assert snapshots.latest(spark, path) == one
    two = snapshots.replace(spark, path, df.withColumn("k", F.lit(5).cast("long")), "p", {}, None, one)
    assert two.version == 3 and rows(snapshots.read(spark, path)) == [(5, 0)]


def test_compaction_packs_small_files_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    text = F.sha2(F.col("id").cast("string"), 256)
    df = lambda a, b: spark.range(a, b).selectExpr("id", "CASE WHEN id % 4 < 3 THEN id % 4 END AS p").withColumn("s", text).coalesce(1)
    snapshots.replace(spark, path, df(0, 20000), "p", {"m": "1"})
    large = {r.file for r in snapshots.files(spark, path).collect()}
    for i in range(5):
        snapshots.append(spark, path, df(20000 + 40 * i, 20040 + 40 * i).where("p <> 1 OR p IS NULL"))
    snapshots.append(spark, path, df(30000, 30040).where("p = 1"))  # one small file of a partition stays
    listed = snapshots.files(spark, path)
    assert "ReadSchema: struct<>" in listed._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n_rows for r in listed.collect()) == spark.read.schema(df(0, 1).schema).parquet(f"{path}/data/*/*").count()
    before = rows(snapshots.read(spark, path))
    small = max(r.bytes for r in listed.collect() if r.file not in large) + 1
    stopping(monkeypatch, snapshots, "publish")
    with pytest.raises(Stop):
        snapshots.compact(spark, path, small)
    assert rows(snapshots.read(spark, path)) == before
    assert snapshots.compact(spark, path, small) == (4 + 15 + 1, 4 + 3 + 1)
    assert rows(snapshots.read(spark, path)) == before and snapshots.latest(spark, path).marks == {"m": "1"}
    assert large <= {r.file for r in snapshots.files(spark, path).collect()}
    assert snapshots.compact(spark, path, small) == (8, 8)
    snapshots.vacuum(spark, path, 1)
    assert rows(snapshots.read(spark, path)) == before
    # files of several bins
    for i in range(6):
        snapshots.append(spark, path, df(40000 + 40 * i, 40040 + 40 * i).where("p = 0"))
    one = min(r.bytes for r in snapshots.files(spark, path).collect())
    n = snapshots.files(spark, path).count()
    assert snapshots.compact(spark, path, small, 3 * one)[1] < n and len(rows(snapshots.read(spark, path))) == len(before) + 60


def _sources(spark, facts, dims):
    f = spark.createDataFrame(facts, "id int, k int, v int, updated_ts timestamp")
    d = spark.createDataFrame(dims, "k int, p int, updated_ts timestamp")
    sources = {"facts": many_sources.by_column(f, "k"), "dims": many_sources.by_column(d, "k")}

    def build(only):
        own = d if only is None else d.join(only, "k", "left_semi")
        return own.select("k", "p").join(f.groupBy("k").agg(F.sum("v").alias("v")), "k", "left").select("k", "p", "v")

    return sources, d, build


DAY = [dt.datetime(2024, 1, i + 1) for i in range(5)]


def test_every_source_has_its_bound(spark, tmp_path):
    path = str(tmp_path / "t")
    facts, dims = [(1, 1, 5, DAY[0]), (2, 2, 6, DAY[0])], [(1, 0, DAY[3]), (2, 0, DAY[0]), (3, 1, DAY[0])]
    run = lambda **kw: many_sources.refresh_many(spark, path, *(lambda s, d, b: (s, d, "k", "p", b))(*_sources(spark, facts, dims)), **kw)
    assert run().refreshed and not run().refreshed
    facts.append((3, 2, 10, DAY[1]))  # later than the facts' bound, earlier than the other source's
    out = run()
    assert out.refreshed and out.keys == 2 and out.partitions == 1 and out.marks == {"facts": "2024-01-02 00:00:00", "dims": "2024-01-04 00:00:00"}
    assert rows(snapshots.read(spark, path)) == [(1, 0, 5), (2, 0, 16), (3, 1, None)]
    dims[1] = (2, 1, DAY[4])  # moves to another partition: both are rebuilt
    out = run()
    assert out.partitions == 2 and out.keys == 3 and rows(snapshots.read(spark, path)) == [(1, 0, 5), (2, 1, 16), (3, 1, None)]
    dims.pop(0)
    assert not run().refreshed and run(deletes=True).refreshed and rows(snapshots.read(spark, path)) == [(2, 1, 16), (3, 1, None)]
    assert list(snapshots.latest(spark, path).folders) == ["1"]
    assert run(full=True).keys == -1 and rows(snapshots.read(spark, path)) == [(2, 1, 16), (3, 1, None)]


@pytest.mark.parametrize(("name", "after"), [("stage", False), ("stage", True), ("publish", False), ("publish", True)])
def test_a_stopped_refresh_is_repeated(spark, tmp_path, monkeypatch, name, after):
    path = str(tmp_path / "t")
    facts, dims = [(1, 1, 5, DAY[0]), (2, 2, 6, DAY[0])], [(1, 0, DAY[0]), (2, 1, DAY[0])]
    run = lambda: many_sources.refresh_many(spark, path, *(lambda s, d, b: (s, d, "k", "p", b))(*_sources(spark, facts, dims)))
    run()
    facts.append((3, 2, 10, DAY[1]))
    stopping(monkeypatch, snapshots, name, after)
    with pytest.raises(Stop):
        run()
    assert rows(snapshots.read(spark, path)) in ([(1, 0, 5), (2, 1, 6)], [(1, 0, 5), (2, 1, 16)])
    assert run().refreshed == (not (name == "publish" and after))
    assert rows(snapshots.read(spark, path)) == [(1, 0, 5), (2, 1, 16)]


def test_wide_tables_refresh_from_all_their_sources(spark, t, tmp_path):  # noqa: F811
    plain = lambda df: rows(df.drop("created_ts", "updated_ts"))
    at = {n: str(tmp_path / n) for n in ("a", "p", "s")}

    def run(tables):
        a = wide.refresh_admissions(spark, at["a"], tables)
        tables = tables | {"obt_admission_features": snapshots.read(spark, at["a"]).withColumn("updated_ts", F.when(F.col("hadm_id").isin(changed), F.lit(NEW)).otherwise(F.lit(OLD)).cast("timestamp"))}
        return tables, a, wide.refresh_patients(spark, at["p"], tables), wide.refresh_stays(spark, at["s"], tables)

    changed = []
    _, a, p, s = run(t)
    assert a.keys == p.keys == s.keys == -1
    _, a, p, s = run(t)
    assert not (a.refreshed or p.refreshed or s.refreshed)
    new = spark.createDataFrame([(11,)], "hadm_id long")
    later = t | {"fact_transfer": t["fact_transfer"].unionByName(stamped(new, NEW)), "fact_datetime_event": t["fact_datetime_event"].unionByName(stamped(spark.createDataFrame([(100,)], "stay_id long"), NEW))}
    changed = [11]
    tables, a, p, s = run(later)
    assert (a.keys, a.partitions) == (2, 1) and p.refreshed and s.refreshed
    assert plain(snapshots.read(spark, at["a"])) == plain(wide.admission_features(later))
    assert plain(snapshots.read(spark, at["p"]).drop("subject_bucket")) == plain(wide.patient_360(tables))
    assert plain(snapshots.read(spark, at["s"])) == plain(wide.stay_features(tables))


def _sum(df):
    return df.groupBy("day").agg(F.sum("v").alias("v"))


def _stream(spark, folder, path, checkpoint):
    return stream_table.stream_into(spark, folder, "id int, day int, v int", path, checkpoint, "day", _sum, "bucket", lambda k: F.pmod(k, F.lit(4)), files_per_batch=1)


@pytest.mark.parametrize(("target", "name", "after"), [(None, None, False), (stream_table, "kept_rows", False), (snapshots, "stage", False), (snapshots, "stage", True), (snapshots, "publish", False), (snapshots, "publish", True)])
def test_stream_table_survives_a_stop_at_each_step(spark, tmp_path, monkeypatch, target, name, after):
    folder, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c")
    put = lambda r: spark.createDataFrame(r, "id int, day int, v int").coalesce(1).write.mode("append").parquet(folder)
    put([(1, 1, 1), (2, 5, 2), (3, 2, 4), (4, None, 9)])
    _stream(spark, folder, path, checkpoint)
    put([(5, 1, 10), (6, 3, 7)])
    if target:
        stopping(monkeypatch, target, name, after)
        with pytest.raises(Exception, match="Stop|foreachBatch|FOREACH_BATCH"):
            _stream(spark, folder, path, checkpoint)
        assert rows(snapshots.read(spark, path).select("day", "v")) in ([(1, 1), (2, 4), (5, 2)], [(1, 11), (2, 4), (3, 7), (5, 2)])
    _stream(spark, folder, path, checkpoint)
    want = [(1, 11), (2, 4), (3, 7), (5, 2)]
    assert rows(snapshots.read(spark, path).select("day", "v")) == want
    _stream(spark, folder, path, checkpoint)
    assert rows(snapshots.read(spark, path).select("day", "v")) == want and rows(stream_table.ledger(spark, path, "day")) == [(1, 0), (1, 1), (2, 0), (3, 1), (5, 0)]


def test_a_batch_reads_the_partitions_of_its_keys(spark, tmp_path):
    path, args = str(tmp_path / "t"), ("id int, day int, v int", str(tmp_path / "t"), "day", _sum, "bucket", lambda k: F.pmod(k, F.lit(4)))
    batch = lambda r: spark.createDataFrame(r, "id int, day int, v int")
    assert stream_table.apply_batch(spark, batch([(i, i % 8, 1) for i in range(80)]), 0, *args)
    assert stream_table.apply_batch(spark, batch([(100, 3, 5)]), 1, *args) and not stream_table.apply_batch(spark, batch([(100, 3, 5)]), 1, *args)
    kept = stream_table.kept_rows(spark, path, "id int, day int, v int", [3], 1)
    files = [r[0] for r in kept.select(F.input_file_name()).distinct().collect()]
    assert files and all("_of=3/" in f for f in files)
    pruned = next(x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in x)
    assert "_of" in pruned.split("PartitionFilters: [")[1].split("]")[0]
    assert rows(snapshots.read(spark, path).select("day", "v")) == [(d, 15 if d == 3 else 10) for d in range(8)]
    assert not stream_table.apply_batch(spark, batch([(1, None, 1)]), 2, *args)


def test_backfill_deals_the_source_once(spark, tmp_path):
    path, scans = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    src = spark.range(40).select(F.col("id").alias("k")).mapInArrow(counted, "k long")
    built = []

    def build(df):
        if len(built) == 2:
            built.append(None)
            raise Stop
        built.append(1)
        return df.where("k % 4 <> 3")  # the last bucket's rows come to nothing

    with pytest.raises(Stop):
        refresh.backfill_buckets(spark, path, src, "k", 4, build)
    assert io.exists(spark, f"{path}_dealt")
    assert refresh.backfill_buckets(spark, path, src, "k", 4, build) == [2, 3]
    assert scans.value == 40 and not io.exists(spark, f"{path}_dealt")
    assert rows(spark.read.parquet(path).select("k")) == [(k,) for k in sorted((k for k in range(40) if k % 4 != 3), key=lambda k: str((k,)))]
    assert refresh.backfill_buckets(spark, path, src, "k", 4, build) == []


def test_runs_at_once_log_what_they_wrote(spark, tmp_path):
    log = str(tmp_path / "log")
    ids = []

    def one(n):
        write = lambda df: df.write.parquet(str(tmp_path / f"t{n}"))
        ids.append(refresh.logged_write(log, f"p{n}", spark.range(100 * n), lambda d: d.where("id % 2 = 0"), write))

    threads = [threading.Thread(target=one, args=(n,)) for n in (1, 2, 3)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(set(ids)) == 3
    with pytest.raises(Stop):
        refresh.logged_write(log, "bad", spark.range(3), lambda d: d, lambda df: (_ for _ in ()).throw(Stop("no")))
    got = {r.process: (r.rows_in, r.rows_out, r.status) for r in spark.read.parquet(log).collect()}
    assert got == {"p1": (100, 50, "OK"), "p2": (200, 100, "OK"), "p3": (300, 150, "OK"), "bad": (-1, -1, "FAILED")}
