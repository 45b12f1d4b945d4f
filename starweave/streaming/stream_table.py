"""A table kept up to date by a file stream, reading only what a batch's keys need.

    path_rows/batch=<id>/_of=<value>/   the stream's rows, dealt out by the partition that their key is in
    path_keys/batch=<id>/               the ledger: the keys that a batch touched
    path                                the table, replaced by commit records, which carry the last batch as a mark

A batch writes its rows and keys under its own number (again, over the same folders, if it is replayed), rebuilds the
partitions of its keys from the rows of these partitions in all batches up to it, and commits. Nothing reads the stream's
folder a second time. A batch whose number the table already carries is done: a replay after a crash at any step, or of a
committed batch, gives the same table. Late and corrected rows recompute their key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starweave.sources import snapshots

BATCH = "batch"


def kept_rows(spark: SparkSession, path: str, schema, values: list, upto: int) -> DataFrame:
    """The stream's rows of some partitions, in the batches up to one: folders of other partitions are not opened."""
    rows = spark.read.schema(_with_folders(schema)).option("basePath", f"{path}_rows").parquet(f"{path}_rows")
    return rows.where((F.col(BATCH) <= upto) & F.col("_of").isin([snapshots.text_of(v) for v in values])).drop(BATCH, "_of")


def _with_folders(schema):
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([*given.fields, T.StructField(BATCH, T.LongType()), T.StructField("_of", T.StringType())])


def ledger(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, batch): what each batch touched."""
    return spark.read.option("basePath", f"{path}_keys").parquet(f"{path}_keys").select(key, BATCH)


def apply_batch(spark: SparkSession, batch: DataFrame, number: int, schema, path: str, key: str, build: Callable[[DataFrame], DataFrame], partition: str, of_key: Callable[[Column], Column]) -> bool:
    """One batch; False if it was done before. Rows without a key are left out."""
    now = snapshots.latest(spark, path)
    if now is not None and int(now.marks.get(BATCH, -1)) >= number:
        return False
    rows = batch.where(F.col(key).isNotNull())
    of = F.coalesce(of_key(F.col(key)).cast("string"), F.lit(snapshots.text_of(None)))
    rows.withColumn("_of", of).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_of").parquet(f"{path}_rows/{BATCH}={number}")
    own = spark.read.schema(_with_folders(schema)).option("basePath", f"{path}_rows").parquet(f"{path}_rows/{BATCH}={number}")
    own.select(key).distinct().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}_keys/{BATCH}={number}")
    keys = spark.read.parquet(f"{path}_keys/{BATCH}={number}")
    values = [r[0] for r in keys.select(of_key(F.col(key))).distinct().collect()]  # few by construction
    if not values:
        return False
    new = build(kept_rows(spark, path, schema, values, number)).withColumn(partition, of_key(F.col(key)))
    snapshots.replace(spark, path, new, partition, {BATCH: str(number)}, values, now)
    return True


def stream_into(spark: SparkSession, folder: str, schema, path: str, checkpoint: str, key: str, build: Callable[[DataFrame], DataFrame], partition: str, of_key: Callable[[Column], Column], files_per_batch: int | None = None):
    """Process the files that are there and stop; the checkpoint remembers them. Read the table by snapshots.read."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    each = lambda batch, number: apply_batch(spark, batch, number, schema, path, key, build, partition, of_key)
    query = reader.parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
