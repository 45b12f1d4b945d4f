"""Reconciliation, profiling and layout jobs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starweave.sources.io import write_csv, write_table

SMALL_FILE = 1 << 20


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """One row a table, counted in one job."""
    return reduce(DataFrame.union, (f.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, f in frames.items()))


def reconcile(raw: DataFrame, gold: DataFrame) -> DataFrame:
    """(table_name, n_rows) of two layers: delta, coverage in percent, and the near misses (over 99 % but not equal)."""
    both = raw.select("table_name", F.col("n_rows").alias("raw_rows")).join(gold.select("table_name", F.col("n_rows").alias("gold_rows")), "table_name", "full_outer")
    delta = F.coalesce("gold_rows", F.lit(0)) - F.coalesce("raw_rows", F.lit(0))
    coverage = F.round(100.0 * F.col("gold_rows").cast("double") / F.nullif(F.col("raw_rows"), F.lit(0)), 4)
    return both.select("table_name", "raw_rows", "gold_rows", delta.alias("delta"), coverage.alias("coverage_pct"), ((coverage > 99) & (delta != 0)).alias("mismatch"))


def grain_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a declared key: values that repeat, and values with a null."""
    nulls = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | nulls)


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """Per file: bytes, rows, whether it is small."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "bytes").agg(F.count("*").alias("n_rows")).withColumn("small", F.col("bytes") < SMALL_FILE)


def profile_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"), F.avg("bytes").alias("avg_bytes"),
        F.count_if("small").alias("small_files"), (F.sum("bytes").cast("double") / F.sum("n_rows")).alias("bytes_per_row"),
    )


def compare_formats(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """The same rows as Parquet (zstd, snappy) and CSV (gzip): bytes, bytes a row, reduction against the largest."""
    for codec in ("zstd", "snappy"):
        write_table(df, f"{folder}/{codec}", codec=codec)
    write_csv(df, f"{folder}/csv")
    n = df.count()
    parts = []
    for name in ("zstd", "snappy", "csv"):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{name}").select(F.lit(name).alias("format"), F.col("length"))
        parts.append(files.groupBy("format").agg(F.sum("length").alias("bytes")))
    sizes = reduce(DataFrame.union, parts)
    most = F.max("bytes").over(Window.partitionBy())
    return sizes.select("format", "bytes", (F.col("bytes").cast("double") / max(1, n)).alias("bytes_per_row"), F.round(100.0 * (1 - F.col("bytes").cast("double") / most), 1).alias("reduction_pct"))


def class_share(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Bytes by table class (structured, text) and their share."""
    by = profiles.join(classes, "table_name").groupBy("kind").agg(F.sum("bytes").alias("bytes"))
    return by.withColumn("share_pct", F.round(100.0 * F.col("bytes").cast("double") / F.sum("bytes").over(Window.partitionBy()), 2))


def row_hash(df: DataFrame):
    return F.xxhash64(*(F.col(c) for c in sorted(df.columns)))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free sum of row hashes)."""
    r = df.select(row_hash(df).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("s")).first()
    return r["n"], int(r["s"])


def compact(spark: SparkSession, path: str, target_bytes: int = 128 << 20, partition: str | None = None) -> int:
    """Rewrite a table to files of about target_bytes; the new copy is checked row by hash before it replaces the old.
    A partitioned table keeps its partitions: each gets the files that its own bytes need, as its rows are dealt out by
    partition and a random part of it."""
    files = file_profile(spark, path)
    total = files.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, -(-int(total) // target_bytes))
    df = spark.read.parquet(path)
    before = fingerprint(df)
    staged = f"{path}_compact_{uuid.uuid4().hex}"
    if partition:
        sizes = files.select(F.regexp_extract("file", rf"/{partition}=([^/]*)/", 1).alias("_value"), "bytes").groupBy("_value").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / target_bytes)).cast("int").alias("_files"))
        dealt = df.join(sizes, F.coalesce(F.col(partition).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")) == F.col("_value"), "left").withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.coalesce("_files", F.lit(1))))
        dealt = dealt.repartition(max(parts, 8), partition, "_part").sortWithinPartitions(partition).select(df.columns)
        write_table(dealt, staged, partition=partition)
    else:
        write_table(df.repartition(parts), staged)
    copy = spark.read.parquet(staged)
    if fingerprint(copy) != before:
        raise RuntimeError("compaction would change rows")
    write_table(copy if partition else copy.coalesce(parts), path, partition=partition)
    p = spark._jvm.org.apache.hadoop.fs.Path(staged)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return parts
