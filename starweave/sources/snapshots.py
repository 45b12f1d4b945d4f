"""Tables whose partitions are replaced by one commit record, which readers resolve.

    path/data/<id>/_of=<value>/   rows of one partition, written by one run
    path/_commits/<version>.json  which folders (and single files) hold the table now, its schema, and marks (say, a bound
                                  for each source)

A run writes its partitions to a folder of its own and then one record, created only if no other run took that version. Before
the record the table is as it was, after it the table is new, and its marks with it: there is no state between. A record that
was cut off does not count. Folders that no kept record names are removed by `vacuum`, not by the run that replaces them, so a
reader that resolved an older record finishes. Partitions are few by construction (buckets, months): the driver lists them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starweave.sources.io import delete

_NULL = "\\N"


@dataclass(frozen=True)
class Snapshot:
    version: int
    schema: T.StructType
    partition: str
    folders: dict[str, list[str]]  # of each partition value, as text: folders, or single files of them
    marks: dict[str, str] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another run committed first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _record(spark: SparkSession, path: str, name: str) -> Snapshot | None:
    fs, p = _fs(spark, f"{path}/_commits/{name}")
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        r = json.loads(text)
    except ValueError:
        return None  # cut off while it was written
    return Snapshot(r["version"], T.StructType.fromJson(r["schema"]), r["partition"], r["folders"], r["marks"])


def latest(spark: SparkSession, path: str) -> Snapshot | None:
    for name in reversed(_names(spark, f"{path}/_commits")):
        if name.endswith(".json") and (found := _record(spark, path, name)):
            return found
    return None


def text_of(value) -> str:
    return _NULL if value is None else str(value)


def read(spark: SparkSession, path: str, at: Snapshot | None = None, only: list | None = None) -> DataFrame:
    """The table as its latest record (or the given one) has it; only: the partitions of these values, no others are listed."""
    at = at or latest(spark, path)
    if at is None:
        raise FileNotFoundError(f"{path} has no commit record")
    wanted = at.folders if only is None else {v: f for v, f in at.folders.items() if v in {text_of(x) for x in only}}
    if not wanted:
        return spark.createDataFrame([], at.schema)
    return spark.read.schema(at.schema).parquet(*(f"{path}/{f}" for fs in wanted.values() for f in sorted(fs)))


def stage(df: DataFrame, path: str, partition: str) -> dict[str, list[str]]:
    """Write df's partitions to a new folder: the folder of each value. Nothing reads them yet. Rows are dealt out by
    partition, and AQE splits a large one and joins small ones."""
    folder = f"data/{uuid.uuid4().hex}"
    of = F.coalesce(F.col(partition).cast("string"), F.lit(_NULL))
    df.withColumn("_of", of).hint("rebalance", "_of").write.option("compression", "zstd").partitionBy("_of").parquet(f"{path}/{folder}")
    names = [n for n in _names(df.sparkSession, f"{path}/{folder}") if n.startswith("_of=")]
    return {unquote(n[4:]): [f"{folder}/{n}"] for n in names}


def publish(spark: SparkSession, path: str, schema: T.StructType, partition: str, folders: dict[str, list[str]], marks: dict[str, str], after: Snapshot | None) -> Snapshot:
    """The commit: one record that follows `after`. Raises Conflict if another run's record is there already."""
    names = [n for n in _names(spark, f"{path}/_commits") if n.endswith(".json")]
    now = latest(spark, path)
    if (now.version if now else 0) != (after.version if after else 0):
        raise Conflict(f"{path}: version {now.version if now else 0} is there, not {after.version if after else 0}")
    # a record that was cut off keeps its number, so the next one is counted from the files
    version = 1 + max((int(n.split(".")[0]) for n in names), default=0)
    new = Snapshot(version, schema, partition, folders, marks)
    text = json.dumps({"version": version, "schema": schema.jsonValue(), "partition": partition, "folders": folders, "marks": marks})
    fs, p = _fs(spark, f"{path}/_commits/{version:012d}.json")
    try:
        stream = fs.create(p, False)
    except Exception as e:
        raise Conflict(f"{path}: version {version} was taken") from e
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return new


def replace(spark: SparkSession, path: str, df: DataFrame, partition: str, marks: dict[str, str], values: list | None = None, after: Snapshot | None = None) -> Snapshot:
    """Stage df, then commit: the partitions of values (None: all there are) hold df's rows only, the others stay.
    A row of df in a partition that is not to be replaced is an error, found before the commit."""
    new = stage(df, path, partition)
    kept: dict[str, list[str]] = {}
    if values is not None:
        named = {text_of(v) for v in values}
        if stray := sorted(set(new) - named):
            raise ValueError(f"rows for partitions that are not replaced: {stray[:5]}")
        kept = {v: f for v, f in (after.folders if after else {}).items() if v not in named}
    return publish(spark, path, df.schema, partition, kept | new, (after.marks if after else {}) | marks, after)


def append(spark: SparkSession, path: str, df: DataFrame, marks: dict[str, str] | None = None, after: Snapshot | None = None) -> Snapshot:
    """Stage df, then commit it beside the rows there are."""
    after = after or latest(spark, path)
    if after is None:
        raise FileNotFoundError(f"{path} has no commit record")
    new = stage(df.select(after.schema.names), path, after.partition)
    folders = {v: [*after.folders.get(v, []), *new.get(v, [])] for v in {**after.folders, **new}}
    return publish(spark, path, after.schema, after.partition, folders, after.marks | (marks or {}), after)


def files(spark: SparkSession, path: str, at: Snapshot | None = None) -> DataFrame:
    """(file, bytes, n_rows) of the table, file below path. No column is read: rows are counted from the footers."""
    rows = read(spark, path, at).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "bytes").agg(F.count("*").alias("n_rows")).withColumn("file", _below("file"))


def _below(column: str):
    """A file's path from data/ on, of the URI that _metadata has."""
    plain = F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))
    return F.concat(F.lit("data/"), F.regexp_extract(plain, r".*/data/([0-9a-f]{32}/_of=[^/]*/[^/]+)$", 1))


def compact(spark: SparkSession, path: str, small: int = 16 << 20, target: int = 128 << 20) -> tuple[int, int]:
    """Pack the small files of each partition into files of about target bytes, and commit: (files before, files after).

    Only files under `small` bytes are read and rewritten, where a partition has two at least; they are packed in the order of
    their sizes, by running sums, a task a bin. Larger files keep their names. The new files are compared with the old by
    count and by the sum of row hashes before the commit."""
    now = latest(spark, path)
    if now is None:
        raise FileNotFoundError(f"{path} has no commit record")
    of = F.regexp_extract("file", r"/_of=([^/]*)/", 1)
    listed = files(spark, path, now).withColumn("of", of).cache()  # a row a file
    little = listed.where(F.col("bytes") < small)
    upto = F.sum("bytes").over(Window.partitionBy("of").orderBy("bytes", "file"))
    many = F.count("*").over(Window.partitionBy("of"))
    bins = little.select("file", "of", "n_rows", F.floor((upto - F.col("bytes")) / target).alias("bin"), many.alias("many")).where("many > 1").collect()  # the driver lists files anyway
    before = listed.count()
    names = sorted({unquote(b["of"]) for b in bins})
    every = [r["file"] for r in listed.select("file").collect()] if names else []
    listed.unpersist()
    if not names:
        return before, before
    packed = {b["file"] for b in bins}
    rows = spark.read.schema(now.schema).parquet(*(f"{path}/{f}" for f in sorted(packed)))
    bin_of = spark.createDataFrame([(b["file"], b["of"], b["bin"]) for b in bins], "_name string, _value string, _bin long")
    dealt = rows.withColumn("_name", _below("_metadata.file_path")).join(F.broadcast(bin_of), "_name")
    n_bins = len({(b["of"], b["bin"]) for b in bins})
    folder = f"data/{uuid.uuid4().hex}"
    value = F.coalesce(F.col(now.partition).cast("string"), F.lit(_NULL))
    out = dealt.repartition(n_bins, "_value", "_bin").withColumn("_of", value).drop("_name", "_value", "_bin")
    out.write.option("compression", "zstd").partitionBy("_of").parquet(f"{path}/{folder}")
    made = {unquote(n[4:]): f"{folder}/{n}" for n in _names(spark, f"{path}/{folder}") if n.startswith("_of=")}
    copy = spark.read.schema(now.schema).parquet(*(f"{path}/{f}" for f in sorted(made.values())))
    if fingerprint(copy) != fingerprint(rows):
        raise RuntimeError("compaction would change rows")
    folders = dict(now.folders)
    for v in names:
        rest = [f for f in every if f not in packed and unquote(f.split("/")[2][4:]) == v]
        folders[v] = [*rest, made[v]]
    new = publish(spark, path, now.schema, now.partition, folders, now.marks, now)
    return before, files(spark, path, new).count()


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free sum of row hashes)."""
    h = F.xxhash64(*(F.col(c) for c in sorted(df.columns))).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("s")).first()
    return r["n"], int(r["s"])


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the last `keep` records, and the folders of runs that none of these names (a running run's too: call
    it when none runs). Returns the folders removed."""
    records = [(n, _record(spark, path, n)) for n in _names(spark, f"{path}/_commits") if n.endswith(".json")]
    whole = [r for _, r in records if r][-keep:]
    named = {f for r in whole for fs in r.folders.values() for f in fs}
    used = {f.split("/")[1] for f in named}
    gone = [n for n in _names(spark, f"{path}/data") if n not in used]
    # of a folder of which single files are kept only, the others go
    for folder in {f.rsplit("/", 1)[0] for f in named if f.count("/") == 3} - named:
        for name in _names(spark, f"{path}/{folder}"):
            if f"{folder}/{name}" not in named and not name.startswith("_"):
                delete(spark, f"{path}/{folder}/{name}")
    for name, r in records:
        if r is None or r.version not in {w.version for w in whole}:
            delete(spark, f"{path}/_commits/{name}")
    for name in gone:
        delete(spark, f"{path}/data/{name}")
    return gone
