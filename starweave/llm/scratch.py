"""Shared intermediate tables: lineage is cut by Parquet tables in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch handed to Python; with whole texts this keeps a batch to a few megabytes.
ARROW_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the setting is missing, a temporary one is made if driver and executors are one
    machine (a local master, as in tests); on a cluster that would lose files, so it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext.getCheckpointDir()
        if known is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = known or "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        if known is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/starweave/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the plan ends there, and any executor can read it again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for columns of one's own that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    return [next(n for n in (w, *(f"{w}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken) for w in wanted]


def small_batches(spark: SparkSession) -> None:
    """Lower (never raise) the session's Arrow batch length to ARROW_ROWS: batches of whole texts must stay small.

    Workers on the driver's machine also find this package where the driver found it; a cluster gets it by --py-files.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
