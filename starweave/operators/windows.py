"""Measures over ordered rows of a subject. Every order ends with a unique column, so results do not depend on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starweave.sources.io import staged


def _by(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def prior(df: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.lag(column).over(_by(by, order)))


def following(df: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    return df.withColumn(out, F.lead(column).over(_by(by, order)))


def latest_per_key(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(_by(by, order))).where(F.col("_rn") <= n).drop("_rn")


def repeat_flag(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(_by(by, order)) > 1)


def ranked(df: DataFrame, order: list[Column], rank: str, total: str) -> DataFrame:
    """df with each row's place (from 1) in one order over all rows, and their number; written to the shared folder once.

    Rows are dealt out by range of the whole order, so that one frequent value (nulls too) is split by what follows it, and
    sorted there; a place is the row's own in its range, moved by the sizes of the ranges before. No task has all rows. The
    order should end with a unique column."""
    at = "_place"
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, 33)  # such an id is a partition's number, and below it 33 bits of the row's place there
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_part", (before - F.col("_first") + 1).alias("_shift"), F.sum("_n").over(Window.partitionBy()).alias(total))
    return rows.join(F.broadcast(shifts), part == F.col("_part")).withColumn(rank, F.col(at) + F.col("_shift")).drop(at, "_part", "_shift")


def quartile(df: DataFrame, column: str, tie: str, out: str) -> DataFrame:
    """ntile(4) by (column, tie) over all rows, nulls first, without one task for all."""
    rows = ranked(df, [F.col(column).asc_nulls_first(), F.col(tie).asc_nulls_first()], "_rank", "_all")
    size, rest = F.floor(F.col("_all") / 4), F.col("_all") % 4
    head = rest * (size + 1)  # the first groups have one row more
    tile = F.when(F.col("_rank") <= head, F.ceil(F.col("_rank") / (size + 1))).otherwise(rest + F.ceil((F.col("_rank") - head) / F.greatest(size, F.lit(1))))
    return rows.withColumn(out, tile.cast("int")).drop("_rank", "_all")


def prior_visits(df: DataFrame, by: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """How often this row's value came before, within by."""
    w = Window.partitionBy(*by, value).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.count("*").over(w))


def readmission(df: DataFrame, subject: str, start: str, end: str, tie: str) -> DataFrame:
    """is_repeat if the subject's row before has an end; gap_days from it, cut to whole days."""
    out = prior(df, [subject], [start, tie], end, "_prior")
    gap = (F.timestamp_diff("SECOND", F.col("_prior"), F.col(start)).cast("double") / 86400.0).cast("int")
    return out.withColumn("is_repeat", F.col("_prior").isNotNull()).withColumn("gap_days", gap).drop("_prior")
