"""Merkle manifest of a dataset: a hash tree over every source's rows, and a proof and a verdict for each row.

A leaf is the SHA-256 of a row's fields. In a source, leaves ascend by id; every BRANCH consecutive nodes become the hash of
their digests, until one is left, the subroot. Subroots in the order of their sources give the root likewise.

The tree is built by time-forward processing. Nodes are labelled in topological order (level, place); a node's digest is a
message to its parent's label, and a queue ordered by label hands each node all its children's messages when its turn comes.
The queue is external: messages of BLOCK = BRANCH^LEVELS neighbours meet by Spark's sorting shuffle, LEVELS levels a sweep,
and its next contents are a table of one message a block; inside a task a heap of at most BLOCK messages is the queue's head.
A second sweep runs through the labels in reverse: each node hands its children its own proof suffix (the siblings from
there to the root) behind the siblings that they have beside them, down to the leaves. So a task holds BLOCK nodes at a
time, whatever a source's size, and log(n) / log(BLOCK) sweeps do.

Places come from one range-partitioned sort by (source, id, leaf) and running counts of (source, partition) pairs: a source
with a third of all rows lies in a third of the partitions.

A proof is bytes: for each level, from the leaf up, one byte (place in the run + 4 * siblings) and the siblings' digests.

Edge cases: null fields count as `-`; rows with a null source are a source of their own, the first; null ids come first in a
source and are never tampered with. Repeated ids are leaves each, in the order of their leaves; equal rows are
interchangeable. A source of one row is its own subroot, and a table of one source has its subroot as root. Very long texts
are hashed whole, in the JVM. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, materialize, small_batches

BRANCH, LEVELS = 3, 5
BLOCK = BRANCH**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its UTF-8 length, a colon and its value."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text)), 256))


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(nodes: int) -> int:
    """Levels between so many nodes and their root."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // BRANCH), levels + 1
    return levels


def forward(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """Digests by level, from the given nodes to one, by a queue of messages to the parents' labels."""
    out: list[list[bytes]] = [digests, *([] for _ in range(levels))]
    queue = [(1, i // BRANCH, i % BRANCH, d) for i, d in enumerate(digests)] if levels else []
    while queue:
        level, at = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, at):
            children.append(heapq.heappop(queue)[3])
        digest = parent(children)
        out[level].append(digest)
        if level < levels:
            heapq.heappush(queue, (level + 1, at // BRANCH, at % BRANCH, digest))
    return out


def backward(tree: list[list[bytes]], suffix: bytes) -> list[bytes]:
    """Proofs of the nodes of the lowest level, by a queue of suffixes in the reverse order of labels."""
    top = len(tree) - 1
    out = [b""] * len(tree[0])
    queue = [(-top, 0, suffix)]
    while queue:
        level, at, proof = heapq.heappop(queue)
        level, at = -level, -at
        if not level:
            out[at] = proof
            continue
        run = tree[level - 1][at * BRANCH : (at + 1) * BRANCH]
        for i in range(len(run)):
            step = bytes([i + 4 * (len(run) - 1)]) + b"".join(run[:i] + run[i + 1 :])
            heapq.heappush(queue, (1 - level, -(at * BRANCH + i), step + proof))
    return out


def steps(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, siblings left to right) by level."""
    at = 0
    while at < len(proof):
        place, many = proof[at] % 4, proof[at] // 4
        yield place, [proof[at + 1 + 32 * i : at + 33 + 32 * i] for i in range(many)]
        at += 1 + 32 * many


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    for place, siblings in steps(proof):
        digest = parent([*siblings[:place], digest, *siblings[place:]])
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (grp, pos, ...) of one block at a time; rows come sorted, and a block's rows are in one task."""
    rows, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = (row[0], row[1] // BLOCK)
            if own != key and rows:
                yield rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield rows


def _rows(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)


_LONG, _BYTES = pa.int64(), pa.binary()
_NODE = pa.schema([("grp", _LONG), ("pos", _LONG), ("left", _LONG), ("digest", _BYTES)])
_PROOF = pa.schema([("grp", _LONG), ("pos", _LONG), ("proof", _BYTES), ("subroot", _BYTES)])
_LEAF = pa.schema([("doc_id", _LONG), ("leaf", _BYTES), ("seen", _BYTES), ("subroot", _BYTES), ("proof", _BYTES)])


def _levels(left: int) -> int:
    return min(LEVELS, height(left))


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def tops():
        for rows in _blocks(batches):
            grp, pos, left, _ = rows[0]
            tree = forward([r[3] for r in rows], _levels(left))
            yield grp, pos // BLOCK, -(-left // BLOCK), tree[-1][0]

    return _rows(tops(), _NODE)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[bytes], bytes]]:
    """(the block's rows, their proofs, subroot). Rows: grp, pos, left, digest, proof, subroot, payload...; the first row of
    a block is the message to its top, with a proof and no digest."""
    for rows in _blocks(batches):
        (_, _, _, _, suffix, subroot, *_), nodes = rows[0], rows[1:]
        yield nodes, backward(forward([r[3] for r in nodes], _levels(nodes[0][2])), suffix), subroot


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _rows(((r[0], r[1], p, subroot) for nodes, proofs, subroot in _opened(batches) for r, p in zip(nodes, proofs, strict=True)), _PROOF)


def _leaves_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _rows(((r[6], r[3], r[7], subroot, p) for nodes, proofs, subroot in _opened(batches) for r, p in zip(nodes, proofs, strict=True)), _LEAF)


def _placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df, written, with grp (a number that ascends as the groups do), left (rows of the group) and pos (place in it)."""
    keys = [*group, *order]
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("part", F.shiftright("place", 33))
    runs = rows.groupBy(*group, "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    each = Window.partitionBy(*group)  # as many rows as partitions that a group lies in
    runs = runs.select(
        *(F.col(g).alias(f"of_{g}") for g in group), F.col("part").alias("of_part"), F.min("first").over(each).alias("grp"), F.sum("n").over(each).alias("left"),
        (F.sum("n").over(each.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"),
    )
    same = F.col("part") == F.col("of_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    placed = rows.join(runs, same).withColumn("pos", F.col("place") + F.col("shift"))
    placed = materialize(placed.drop("part", "of_part", "place", "shift", *(f"of_{g}" for g in group)), "placed")
    drop(rows)
    return placed


def _by_block(rows: DataFrame) -> DataFrame:
    """Whole blocks in each task, in the order of labels."""
    block = F.floor(F.col("pos") / F.lit(BLOCK))
    return rows.withColumn("block", block).repartitionByRange("grp", "block").drop("block")


def _rise(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Upward sweeps over a forest: (the queue's contents before each sweep, one node a group: its root)."""
    epochs = [nodes.select("grp", "pos", "left", "digest")]
    most = nodes.agg(F.max("left")).first()[0] or 0
    while most > 1:
        going = _by_block(epochs[-1].where("left > 1")).sortWithinPartitions("grp", "pos")
        epochs.append(materialize(going.mapInArrow(_up, "grp long, pos long, left long, digest binary"), "nodes"))
        most = -(-most // BLOCK)
    roots = epochs[0].where("left = 1")
    for e in epochs[1:]:
        roots = roots.unionByName(e.where("left = 1"))
    return epochs, roots


def _meet(nodes: DataFrame, above: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """Each block's nodes behind the message to its top. nodes: grp, pos, left, digest; above: grp, pos, proof, subroot."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    tops = above.select("grp", (F.col("pos") * BLOCK).alias("pos"), none("left", "long"), none("digest", "binary"), "proof", "subroot", *(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in payload))
    own = nodes.where("left > 1").select("grp", "pos", "left", "digest", none("proof", "binary"), none("subroot", "binary"), *payload)
    return _by_block(tops.unionByName(own)).sortWithinPartitions("grp", "pos", F.col("left").asc_nulls_first())


def _fall(epochs: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Downward sweeps as far as the first epoch's block tops. roots: grp, proof, subroot of every group.
    Gives (grp, pos, proof, subroot) of the second epoch's nodes, or of the roots where there is one epoch only."""
    above = None
    for e in reversed(epochs[1:]):
        ended = e.where("left = 1").select("grp", "pos").join(roots, "grp")
        if above is not None:
            ended = ended.unionByName(_meet(e, above, ()).mapInArrow(_down, "grp long, pos long, proof binary, subroot binary"))
        above = materialize(ended, "suffixes")
    return above


def _proved(placed: DataFrame, epochs: list[DataFrame], roots: DataFrame, payload: tuple[str, str]) -> DataFrame:
    """(doc_id, leaf, seen, subroot, proof) of every leaf."""
    alone = placed.where("left = 1").join(roots, "grp").select(F.col(payload[0]).alias("doc_id"), F.col("digest").alias("leaf"), F.col(payload[1]).alias("seen"), "subroot", "proof")
    above = _fall(epochs, roots)
    if above is None:
        return alone
    return alone.unionByName(_meet(placed, above, payload).mapInArrow(_leaves_down, "doc_id long, leaf binary, seen binary, subroot binary, proof binary"))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as a careless copy would hold it: without line ends, where 2 divides the crc32 of the id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tamper=tampered) -> DataFrame:
    """Per row: doc_id, leaf, seen (the leaf of what is verified), subroot, root, proof, all as bytes.

    fields: id, group, ..., text. tamper gives the text that is verified from (id, text); None verifies the rows themselves.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [F.col(c) for c in fields]
    changed = columns if tamper is None else [*columns[:-1], tamper(columns[0], columns[-1])]
    rows = docs.select(columns[0].cast("long").alias("doc_id"), columns[1].alias("source"), leaf(columns).alias("digest"), leaf(changed).alias("seen"))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "leaves")  # uid parts equal rows
    placed = _placed(rows, ["source"], ["doc_id", "digest", "uid"])
    drop(rows)
    epochs, subroots = _rise(placed)
    tops = _placed(subroots.select(F.col("grp").alias("source"), "digest", F.col("digest").alias("seen")), [], ["source"])
    top_epochs, root = _rise(tops)
    root = root.select("digest").first()
    root = root[0] if root else b""
    # from the root to the subroots, then to the leaves
    apex = tops.select("grp").distinct().select("grp", F.lit(b"").alias("proof"), F.lit(None).cast("binary").alias("subroot"))
    proofs = materialize(_proved(tops, top_epochs, apex, ("source", "seen")), "suffixes")
    roots = proofs.select(F.col("doc_id").alias("grp"), "proof", F.col("leaf").alias("subroot"))
    return _proved(placed, epochs, roots, ("doc_id", "seen")).withColumn("root", F.lit(root))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs = batch.column(2).to_pylist()
        digests = [hashlib.sha256("".join(d.hex() for _, siblings in steps(p) for d in siblings).encode()).hexdigest() for p in proofs]
        folded = [fold(d, p).hex() for d, p in zip(batch.column(1).to_pylist(), proofs, strict=True)]
        roots = [r.hex() for r in batch.column(5).to_pylist()]
        text = [[d.hex() for d in batch.column(k).to_pylist()] for k in (3, 4)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, (*text, roots, digests, folded)), pa.array([f == r for f, r in zip(folded, roots, strict=True)])],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
        )


def verify(proved: DataFrame) -> DataFrame:
    """Per row of a manifest: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, in hexadecimal digits."""
    rows = proved.select("doc_id", "seen", "proof", "leaf", "subroot", "root")
    return rows.mapInArrow(_judged, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
