"""Incremental refresh of a table from many sources, on tables with commit records.

Each source has its own bound: what it was read up to, kept as marks in the table's commit record. A run freezes the upper
bound of every source in one job, unites the keys that changed rows of any source touch (through other tables where a source
has no such key), and expands them to whole partitions, those that a touched key is in and those it was in. The keys and
their partitions are written once to the shared folder; everything after reads them there. The build gets these keys only.
One record then replaces the partitions and moves all bounds together.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.operators.refresh import FIRST, changed
from starweave.sources import snapshots
from starweave.sources.io import delete, staged


@dataclass
class Source:
    rows: DataFrame
    #: changed rows to a DataFrame whose first column is the keys that they touch
    keys: Callable[[DataFrame], DataFrame]
    ts: str = "updated_ts"


@dataclass
class Outcome:
    refreshed: bool
    version: int
    marks: dict[str, str]
    keys: int  # rebuilt; -1 for all
    partitions: int


def by_column(rows: DataFrame, column: str, ts: str = "updated_ts") -> Source:
    return Source(rows, lambda d: d.select(column), ts)


def bounds(sources: dict[str, Source]) -> dict[str, str | None]:
    """The largest stamp of each source, in one job: later rows wait for the next run."""
    each = [s.rows.agg(F.max(s.ts).cast("string").alias("ts")).select(F.lit(n).alias("name"), "ts") for n, s in sources.items()]
    return {r["name"]: r["ts"] for r in reduce(DataFrame.union, each).collect()}


def touched(sources: dict[str, Source], low: dict[str, str], high: dict[str, str | None], key: str) -> DataFrame:
    """Distinct non-null keys that rows stamped in (low, high] touch, over all sources that moved."""
    moved = [n for n in sources if high[n] is not None and low.get(n, FIRST) < high[n]]
    keys = [sources[n].keys(changed(sources[n].rows, low.get(n, FIRST), high[n], sources[n].ts)) for n in moved]
    return reduce(DataFrame.union, (k.select(F.col(k.columns[0]).alias(key)) for k in keys)).where(F.col(key).isNotNull()).distinct()


def refresh_many(
    spark: SparkSession, path: str, sources: dict[str, Source], base: DataFrame, key: str, partition: str,
    build: Callable[[DataFrame | None], DataFrame], full: bool = False, deletes: bool = False,
) -> Outcome:
    """Bring the table at path up to date. base: every key and its partition (more columns are not read). build: from a table
    of keys (None: all) to their rows, the partition column included.

    Nothing changed: no job beyond the bounds and the keys, and no record. A source that is new to the table counts from the
    start. deletes: keys of the table that base no longer has are touched too (this reads the table's keys). Any failure
    before the record leaves the table and all bounds as they were, so the run is repeated.
    """
    base = base.select(key, partition)
    high = bounds(sources)
    marks = {n: ts for n, ts in high.items() if ts is not None}
    now = snapshots.latest(spark, path)
    if now is None or full:
        new = snapshots.replace(spark, path, build(None), partition, marks, None, now)
        return Outcome(True, new.version, new.marks, -1, len(new.folders))
    current = snapshots.read(spark, path, now).select(key, partition)
    work = []
    if any(now.marks.get(n, FIRST) < ts for n, ts in marks.items()):
        work.append(touched(sources, now.marks, high, key))
    if deletes:
        work.append(current.select(key).join(base, key, "left_anti").distinct())
    if not work:
        return Outcome(False, now.version, now.marks, 0, 0)
    keys = staged(reduce(DataFrame.union, work).distinct(), "touched")
    parts = base.join(keys, key, "left_semi").select(partition).union(current.join(keys, key, "left_semi").select(partition)).distinct()
    values = [r[0] for r in parts.collect()]  # few by construction
    if not values:
        delete(spark, keys)
        return Outcome(False, now.version, now.marks, 0, 0)
    among = F.col(partition).isin([v for v in values if v is not None])
    among = F.coalesce(among, F.lit(None in values))
    whole = staged(base.where(among).select(key).union(keys.join(base, key, "left_semi").select(key)).distinct(), "members")
    rows = build(whole)
    if fewer := set(now.schema.names) - set(rows.columns):
        raise ValueError(f"the build lacks columns of the table: {sorted(fewer)}")
    new = snapshots.replace(spark, path, rows.select(now.schema.names), partition, marks, values, now)
    count = whole.count()
    delete(spark, keys)
    delete(spark, whole)
    return Outcome(True, new.version, new.marks, count, len(values))
