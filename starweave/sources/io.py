"""Sources and sinks: typed delimited text, Parquet with partition-scoped overwrite, CSV, JSON sidecars, calendar."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starweave.functions.measures import all_equal_own_names


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False, pattern: str | None = None) -> DataFrame:
    """Delimited text (plain or gzip) with a declared schema. multiline: quoted fields may hold newlines and doubled quotes.
    pattern: read every matching file below path."""
    reader = spark.read.schema(schema).option("maxCharsPerColumn", -1).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if multiline:
        reader = reader.option("multiLine", True)
    if pattern:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return reader.csv(path)


def patch_schema(schema: T.StructType, types: dict[str, T.DataType]) -> T.StructType:
    """The schema with the types of named columns replaced."""
    return T.StructType([T.StructField(f.name, types.get(f.name, f.dataType), f.nullable) for f in schema])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet table, or an empty one of its schema where the source is absent."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def drop_header_rows(df: DataFrame) -> DataFrame:
    return df.where(~all_equal_own_names(df))


def cap(df: DataFrame, n: int, parts: int | None = None) -> DataFrame:
    """At most n rows, read lazily, and dealt out again (a limit leaves one partition)."""
    return df.limit(n).repartition(parts or max(8, min(200, n // 5000)))


def date_spine(spark: SparkSession, start: str, end: str, first_day: str = "monday") -> DataFrame:
    """One row a day with calendar columns; weeks begin on first_day, monday or sunday."""
    d = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("full_date"))
    c = F.col("full_date")
    q0 = F.trunc(c, "quarter")
    week0 = F.date_sub(c, {"monday": F.weekday(c), "sunday": F.dayofweek(c) - 1}[first_day])
    return d.select(
        F.date_format(c, "yyyyMMdd").cast("int").alias("date_key"), "full_date",
        F.dayofweek(c).alias("day_of_week"), F.date_format(c, "EEEE").alias("day_name"), F.dayofmonth(c).alias("day_of_month"), F.dayofyear(c).alias("day_of_year"),
        F.weekofyear(c).alias("week_of_year"), week0.alias("week_start"), F.date_add(week0, 6).alias("week_end"),
        F.month(c).alias("month"), F.date_format(c, "MMMM").alias("month_name"), F.trunc(c, "month").alias("month_start"), F.last_day(c).alias("month_end"),
        F.quarter(c).alias("quarter"), q0.alias("quarter_start"), F.date_sub(F.add_months(q0, 3), 1).alias("quarter_end"),
        F.year(c).alias("year"), F.trunc(c, "year").alias("year_start"), F.date_sub(F.add_months(F.trunc(c, "year"), 12), 1).alias("year_end"),
        (F.year(c) * 100 + F.month(c)).alias("year_month"), F.dayofweek(c).isin(1, 7).alias("is_weekend"),
        (c == F.trunc(c, "month")).alias("is_month_start"), (c == F.last_day(c)).alias("is_month_end"),
        (F.dayofyear(F.date_sub(F.add_months(F.trunc(c, "year"), 12), 1)) == 366).alias("is_leap_year"), F.date_format(c, "yyyy-MM").alias("year_month_name"),
    )


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; without the setting only a local master has one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-work-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: the plan ends there, and any executor can read it again."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, what: DataFrame | str) -> None:
    """Remove a folder, or the files of a staged table that no later plan reads."""
    folders = {what} if isinstance(what, str) else {f.rsplit("/", 1)[0] for f in what.inputFiles()}
    for folder in folders:
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cluster_for_write(df: DataFrame, column: str, n: int) -> DataFrame:
    """All rows of one partition value in one task, sorted, so each value gets one file."""
    return df.repartition(n, column).sortWithinPartitions(column)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition: str | None = None, codec: str = "zstd") -> None:
    w = df.write.mode(mode).option("compression", codec).option("partitionOverwriteMode", "static")
    (w.partitionBy(partition) if partition else w).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, column: str, n: int = 64) -> None:
    """Replace only the partitions that df has rows for."""
    cluster_for_write(df, column, n).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def for_csv(df: DataFrame) -> DataFrame:
    """Every column as text, with newlines escaped."""
    plain = lambda n: F.regexp_replace(F.regexp_replace(F.col(n).cast("string"), "\r", "\\\\r"), "\n", "\\\\n").alias(n)
    return df.select(*(plain(n) for n in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    w = for_csv(df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip")
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_sidecar(df: DataFrame, path: str) -> None:
    """One JSON line a row, by the executors."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def flatten_variant(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(F.col(c)) for c in columns})


def register(spark: SparkSession, name: str, path: str) -> None:
    """Catalogue a Parquet folder under a name, replacing an earlier entry."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")


def create_tables(spark: SparkSession, folder: str, schemas: dict[str, T.StructType | str], keep: tuple[str, ...] = ()) -> None:
    """Empty tables of declared schemas; those in keep stay as they are where they exist."""
    for name, schema in schemas.items():
        if not (name in keep and exists(spark, f"{folder}/{name}")):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")
