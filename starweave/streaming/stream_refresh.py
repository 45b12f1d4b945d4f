"""Refresh driven by a file stream: each micro-batch's keys are recomputed and replaced, so a replay changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.operators.refresh import carry_forward, delete
from starweave.sources.io import exists, overwrite_partitions, write_table


def stream_refresh(spark: SparkSession, folder: str, schema, path: str, checkpoint: str, key: str, build: Callable[[DataFrame], DataFrame], partition: str, of_key: Callable):
    """Process the files that are there and stop; the checkpoint remembers them. Late and corrected rows recompute their key."""

    def each(batch: DataFrame, _: int) -> None:
        touched = batch.select(key).where(F.col(key).isNotNull()).distinct()
        if touched.isEmpty():
            return
        rows = spark.read.schema(schema).parquet(folder).join(touched, key, "left_semi")
        new = build(rows).withColumn(partition, of_key(F.col(key)))
        if not exists(spark, path):
            write_table(new, path, partition=partition)
            return
        staged = f"{path}_staging_{uuid.uuid4().hex}"
        out = carry_forward(new, spark.read.parquet(path), touched, key, partition, of_key)
        write_table(out, staged, partition=partition)
        kept = spark.read.schema(out.schema).parquet(staged)
        emptied = touched.select(of_key(F.col(key)).alias(partition)).distinct().join(kept.select(partition).distinct(), partition, "left_anti")
        overwrite_partitions(kept, path, partition)
        for row in emptied.collect():  # partitions of the batch's keys that hold no row any more
            delete(spark, f"{path}/{partition}={row[0]}")
        delete(spark, staged)

    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
