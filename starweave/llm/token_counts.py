"""Token counts by separator scan.

Flat token files (ids of 2 or 4 bytes, nothing else) are read in blocks of BLOCK_IDS; each block finds its end-of-document
ids by one vectorised comparison and reports how many there are and where its first and last lie. A prefix scan over the
blocks numbers the documents and gives each block the ids that the document it starts in already has, so documents that
run over any number of blocks are counted whole.

Edge cases: two separators in a row are an empty document (count 1, its separator). Ids after the last separator of a file
are one more document, without a separator. A document longer than many blocks passes through them by the scan. Empty
files have no documents, an empty table has no files. Null texts are empty. Repeated rows and null ids are counted row by
row. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, new_path, small_batches
from .tokens import FILE_IDS, encoder, open_store

#: The separator is a special token of the vocabulary; texts are encoded as ordinary text, so none of them holds it.
SEPARATOR, BLOCK_IDS = 50256, 1 << 20


def _flat_writer(path: str, folder: str, separator: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, plain=True)
        store, root = open_store(folder)
        name, out, n_ids, order = "", None, 0, []

        def close() -> Iterator[pa.RecordBatch]:
            out.close()
            at = 0
            for ids in order:
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(at, at + n)), ids.cast(pa.int64()), pa.array([n_ids] * n), pa.array([np.dtype(enc.dtype).itemsize] * n, pa.int32())], names=["name", "ordinal", "doc_id", "n_ids", "width"])
                at += n

        for batch in batches:
            if out is None:
                name, n_ids, order = uuid.uuid4().hex, 0, []
                out = store.open_output_stream(f"{root}/{name}.bin")
            ids, _ = enc.encode_ended(batch.column(1), separator)
            out.write(ids.tobytes())
            n_ids += len(ids)
            order.append(batch.column(0))
            if n_ids >= file_ids:
                yield from close()
                out = None
        if out is not None:
            yield from close()

    return write


def write_flat(docs: DataFrame, path: str, separator: int, folder: str, doc_col="doc_id", text_col="text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write flat files, one a partition or several of about file_ids ids. Returns which document is which of its file: name, ordinal, doc_id, n_ids, width."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_flat_writer(path, folder, separator, file_ids), "name string, ordinal long, doc_id long, n_ids long, width int"), "flat")


def _ids(folder: str, name: str, block: int, n_ids: int, width: int, block_ids: int) -> np.ndarray:
    store, root = open_store(folder)
    with store.open_input_file(f"{root}/{name}.bin") as f:
        f.seek(block * block_ids * width)
        return np.frombuffer(f.read(min(block_ids, n_ids - block * block_ids) * width), dtype="<u2" if width == 2 else "<u4")


def _edges(folder: str, separator: int, block_ids: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_ids, width, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = _ids(folder, name, block, n_ids, width, block_ids)
                at = np.flatnonzero(ids == separator)
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                # lengths of the documents that end here; the first still lacks what blocks before hold of it
                lengths = np.diff(np.concatenate(([-1], at)))
                last = block == (n_ids - 1) // block_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([block]), pa.array([len(at)], pa.int64()), pa.array([tail], pa.int64()), pa.array([last]), pa.array([lengths], pa.list_(pa.int64()))],
                    names=["name", "block", "ends", "tail", "last", "lengths"],
                )

    return scan


def scan_flat(files: DataFrame, folder: str, separator: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """files: name, n_ids, width. Per document: name, ordinal, n_tokens (its separator included)."""
    blocks = files.where("n_ids > 0").select("name", "n_ids", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_ids - 1) div {block_ids}"))).alias("block"))
    blocks = blocks.repartition(F.col("name"), F.col("block"))
    edges = materialize(blocks.mapInArrow(_edges(folder, separator, block_ids), "name string, block long, ends long, tail long, last boolean, lengths array<long>"), "edges")
    by = Window.partitionBy("name").orderBy("block")
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    # the prefix scan, over one small row a block: documents ended before, and tails since the last separator before
    runs = edges.select("name", "block", "ends", "tail").withColumn("before", F.coalesce(F.sum("ends").over(past), F.lit(0)))
    runs = runs.withColumn("run", F.sum((F.col("ends") > 0).cast("long")).over(by))
    within = Window.partitionBy("name", "run").orderBy("block")
    # a run: a block with separators, then blocks without any; what it carries on is the sum of its tails
    runs = runs.withColumn("so_far", F.sum("tail").over(within))
    runs = runs.withColumn("carry", F.coalesce(F.lag("so_far").over(by), F.lit(0))).select("name", "block", "before", "carry", "so_far")
    both = edges.join(runs, ["name", "block"])
    done = both.select("name", "before", "carry", F.posexplode("lengths").alias("k", "n")).select(
        "name", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carry")).otherwise(0)).alias("n_tokens")
    )
    rest = both.where("last AND so_far > 0").select("name", (F.col("before") + F.col("ends")).alias("ordinal"), F.col("so_far").alias("n_tokens"))
    return done.union(rest)


def count_tokens(docs: DataFrame, path: str, separator: int = SEPARATOR, doc_col="doc_id", text_col="text", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Per document row: doc_id, n_tokens with the separator, by writing flat files and scanning them."""
    folder = new_path(docs.sparkSession, "flat")
    order = write_flat(docs, path, separator, folder, doc_col, text_col, file_ids)
    files = order.groupBy("name").agg(F.first("n_ids").alias("n_ids"), F.first("width").alias("width"))
    counts = scan_flat(files, folder, separator, block_ids)
    store, root = open_store(folder)
    store.delete_dir(root)  # the blocks' edges are a written table by now
    return order.select("name", "ordinal", "doc_id").join(counts, ["name", "ordinal"]).select("doc_id", "n_tokens")
