"""SimHash near-duplicate detection by a hierarchical index in Gray order.

A document's fingerprint has a bit set where over half of the hashes of its 3-word shingles (repeats included) have it. Two
fingerprints within RADIUS = 3 bits link their documents.

1. Equal fingerprints are one class; only distinct ones go on.
2. Two fingerprints within 3 bits agree in one of four 16-bit blocks at least. Each is rotated so that each block leads once,
   and all rotations are sorted by Gray rank (the place of a code in the Gray sequence): fingerprints with an equal leading
   block stand together, and neighbours in the order share many more bits. A range partition of this order is cut in pieces.
3. In a piece, runs of FAN neighbours become a node, runs of nodes an upper node, to one node a block value. A node keeps the
   bits that all its fingerprints share and that no node above it has (a mask and a pattern). A search adds up the differing
   bits on its way down: over RADIUS, the whole group is cut off; if even the bits not yet compared keep the sum within
   RADIUS, the whole group is taken without looking further; and a group whose members are all united with the asking one
   already has nothing to add.
4. A block value that goes on in another piece (a hot one lies in many) leaves its members behind. Pieces of one block value
   are upper nodes of the same index: a pair of them is cut off by the patterns of both, or if all members are united, and
   else searched as in 3, a task each.
5. Tasks give one link for each member that is not the first of its group, never all pairs; components of the links follow.

Words are told apart by their bytes, shingles by XXH64 with seed 42, as is stated for the fingerprint.

Edge cases: lower-casing touches A-Z only. Texts with one or two words are one shingle; null, empty and blank texts have
fingerprint zero, which links like any other. Very long texts are read whole, piece by piece. Exactly half of the hashes do
not set a bit. Repeated rows of an id are one document: all its fingerprints meet in one component. Rows with a null id
link like others, but a component is never named after them (null, if it has no other id); they are not one document. An
empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import drop, materialize, small_batches
from .words import _FOLD, chunks, split_words, text_bytes

SHINGLE, RADIUS, SEED = 3, 3, 42
BLOCKS, BLOCK_BITS = 4, 16
FAN = 8
#: Fingerprints that one piece of the order holds, and pairs that a search opens at once.
PIECE, OPEN = 1 << 15, 1 << 21

# XXH64: the primes of its public specification (fixed values)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges: those under 32 bytes eight bytes at a time side by side, the others by the library."""
    import xxhash

    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    size = ends - starts
    h = np.full(len(starts), np.uint64(seed) + _P5) + size.astype(np.uint64)
    for lane in range(3):
        of = np.flatnonzero(size >= 8 * lane + 8)
        k = _rotl(eight[starts[of] + 8 * lane] * _P2, 31) * _P1
        h[of] = _rotl(h[of] ^ k, 27) * _P1 + _P4
    at = starts + (size & ~7)
    of = np.flatnonzero(size & 4)
    h[of] = _rotl(h[of] ^ ((eight[at[of]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at = at + (size & 4)
    for byte in range(3):
        of = np.flatnonzero((size & 3) > byte)
        h[of] = _rotl(h[of] ^ (raw[at[of] + byte].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if len(long):
        data = raw.tobytes()
        h[long] = [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0] - 1, 0, 1, ..."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts of one chunk."""
    raw = _FOLD[raw]
    words = split_words(raw, offsets)
    size = words.ends - words.starts
    begin = np.cumsum(size + 1) - (size + 1)  # words anew, with one space after each
    inside = _within(size)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[np.repeat(begin, size) + inside] = raw[np.repeat(words.starts, size) + inside]
    n_words = np.diff(words.first)
    n = np.maximum(n_words - (SHINGLE - 1), np.minimum(n_words, 1))
    first = np.repeat(words.first[:-1], n) + _within(n)
    last = np.minimum(first + SHINGLE - 1, np.repeat(words.first[1:] - 1, n))
    hashes = xxh64(joined, begin[first], begin[last] + size[last])
    out, full, at = np.zeros(len(n), np.uint64), np.flatnonzero(n), np.cumsum(n) - n
    step = 1 << 17  # shingles whose bits lie side by side at once
    counts = np.zeros((len(full), 64), np.int64)
    row = np.repeat(np.arange(len(full)), n[full])
    for a in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own, places = np.unique(row[a : a + step], return_index=True)
        counts[own] += np.add.reduceat(bits, places, axis=0, dtype=np.int64)
    if len(full):
        out[full] = np.packbits(2 * counts > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            fps = fingerprints_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (a long)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint, "doc_id long, fp long")


# -- the index


class Index:
    """The hierarchy over fingerprints that stand in Gray order, block value by block value.

    Level 0 is the fingerprints; a node of level k covers first[k][i] to first[k][i + 1] of level k - 1. own and pattern hold
    each node's bits that no node above it has."""

    def __init__(self, fps: np.ndarray, group: np.ndarray, fan: int = FAN):
        self.size = len(fps)
        both, any_, self.first = [fps], [fps], [np.arange(self.size + 1)]
        while len(group) and (group[1:] == group[:-1]).any():
            edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(group)) - np.repeat(edge, np.diff(np.append(edge, len(group))))
            start = np.flatnonzero(place % fan == 0)
            both.append(np.bitwise_and.reduceat(both[-1], start))
            any_.append(np.bitwise_or.reduceat(any_[-1], start))
            self.first.append(np.append(start, len(group)))
            group = group[start]
        self.groups = len(group)
        shared = [~(a ^ b) for a, b in zip(both, any_, strict=True)]
        self.pattern, self.own, self.open = both, [], [np.bitwise_count(~s) for s in shared]
        for k, mask in enumerate(shared):
            up = shared[k + 1] if k + 1 < len(shared) else None
            self.own.append(mask if up is None else mask & ~np.repeat(up, np.diff(self.first[k + 1])))
        # members of each node
        self.members = [np.arange(self.size + 1)]
        for first in self.first[1:]:
            self.members.append(self.members[-1][first])

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """By level, the label that all members of a node have, or -1."""
        lo, hi, out = label, label, [label]
        for first in self.first[1:]:
            lo, hi = np.minimum.reduceat(lo, first[:-1]), np.maximum.reduceat(hi, first[:-1])
            out.append(np.where(lo == hi, lo, -1))
        return out


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (all roots direct) with a[i] and b[i] united; a root is the least member."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = _find(parent)


def united(fps: np.ndarray, group: np.ndarray, label: np.ndarray | None = None, radius: int = RADIUS, fan: int = FAN, open_pairs: int = OPEN) -> np.ndarray:
    """For each fingerprint the first one of its component, by links inside its group. fps: in Gray order, group by group.
    Equal labels (non-negative) are united from the start."""
    n = len(fps)
    parent = np.arange(n)
    if label is not None:
        known = np.flatnonzero(label >= 0)
        _, lead, at = np.unique(label[known], return_index=True, return_inverse=True)
        parent = _unite(parent, known, known[lead[at]])
    index = Index(fps, group, fan)
    top = len(index.first) - 1
    if not top:
        return parent
    of = np.repeat(np.arange(index.groups), np.diff(index.members[top]))
    sizes = np.diff(index.members[top])[of]
    work = np.cumsum(sizes)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + open_pairs, side="right")))
        asking = np.arange(at, to)[sizes[at:to] > 1]
        at = to
        if not len(asking):
            continue
        same = index.uniform(parent)
        node, sums = of[asking], np.zeros(len(asking), np.uint8)
        for k in range(top, -1, -1):
            sums = sums + np.bitwise_count((fps[asking] ^ index.pattern[k][node]) & index.own[k][node])
            # over the radius; all before the asking one, which they ask themselves; all united with it
            keep = (sums <= radius) & (index.members[k][node + 1] > asking + 1) & (same[k][node] != parent[asking])
            asking, node, sums = asking[keep], node[keep], sums[keep]
            if k:
                whole = sums + index.open[k][node] <= radius
                if whole.any():
                    lo, hi = index.members[k][node[whole]], index.members[k][node[whole] + 1]
                    groups, one = np.unique(node[whole], return_index=True)
                    each = (hi - lo)[one]
                    mine = np.repeat(lo[one], each) + _within(each)
                    parent = _unite(parent, np.concatenate([asking[whole], mine]), np.concatenate([lo, np.repeat(lo[one], each)]))
                    asking, node, sums = asking[~whole], node[~whole], sums[~whole]
                first = index.first[k]
                many = first[node + 1] - first[node]
                node = np.repeat(first[node], many) + _within(many)
                asking, sums = np.repeat(asking, many), np.repeat(sums, many)
        parent = _unite(parent, asking, node)
    return parent


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in the Gray sequence, as a long that sorts like the unsigned number."""
    for by in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, by))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _rotated(fp: Column, block: int) -> Column:
    by = BLOCK_BITS * block
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _group(turn: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Number of each rotation and its leading block."""
    shift = (np.uint64(64 - BLOCK_BITS) - np.uint64(BLOCK_BITS) * turn.astype(np.uint64)) & np.uint64(63)
    return (turn.astype(np.int64) << BLOCK_BITS) | ((fps >> shift) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


_OUT = "kind int, piece long, grp long, a long, b long"


def _out(kind: int, piece, grp, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(a), 1 << 14):
        part = slice(at, at + (1 << 14))
        n = len(a[part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, piece, np.int64)), pa.array(np.broadcast_to(grp, len(a))[part]), pa.array(a[part].astype(np.int64)), pa.array(b[part].astype(np.int64))],
            names=["kind", "piece", "grp", "a", "b"],
        )


def _links(fps: np.ndarray, parent: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
    other = np.flatnonzero(parent != np.arange(len(parent)))
    yield from _out(0, piece, np.int64(0), fps[other].view(np.int64), fps[parent[other]].view(np.int64))


def _pieces(size: int, radius: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(turn, rank, fp) in order: kind 0, links (a, b); kind 1, members a of the groups at a piece's ends."""
        task, number, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            turn, fps = (np.concatenate(c) for c in zip(*waiting, strict=True))
            for at in range(0, len(fps), size):
                t, f, piece = turn[at : at + size], fps[at : at + size], (task << 32) + number + at // size
                group = _group(t, f)
                yield from _links(f, united(f, group, radius=radius), piece)
                ends = np.flatnonzero((group == group[0]) | (group == group[-1]))
                yield from _out(1, piece, group[ends], f[ends].view(np.int64), f[ends].view(np.int64))

        for batch in batches:
            if batch.num_rows:
                waiting.append((batch.column(0).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
                held += batch.num_rows
            if held >= 4 * size:  # whole pieces go, the rest waits
                whole = held - held % size
                turn, fps = (np.concatenate(c) for c in zip(*waiting, strict=True))
                waiting = [(turn[:whole], fps[:whole])]
                yield from done()
                number, waiting, held = number + whole // size, [(turn[whole:], fps[whole:])], held - whole
        if held:
            yield from done()

    return index


def _pairs(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(grp, p, q, rank, fp, label), whole pairs of pieces in order: links."""
        waiting: list[tuple] = []
        key = None

        def done() -> Iterator[pa.RecordBatch]:
            fps, label = (np.concatenate(c) for c in zip(*waiting, strict=True))
            _, label = np.unique(label, return_inverse=True)
            yield from _links(fps, united(fps, np.zeros(len(fps), np.int64), label, radius), 0)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            fps = batch.column(4).to_numpy().view(np.uint64)
            names = batch.column(5).to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                own = tuple(keys[a])
                if own != key and waiting:
                    yield from done()
                    waiting.clear()
                key = own
                waiting.append((fps[a:b], names[a:b]))
        if waiting:
            yield from done()

    return search


def classes(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """Per document row: doc_id, fp, component_id."""
    rows = materialize(fingerprints(docs, doc_col, text_col), "fingerprints")
    each = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links, spent = linked(each.select("fp"), radius, piece)
    # an id with several fingerprints is one document
    ids = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("one"), F.max("fp").alias("most")).where("one < most")
    links = links.unionByName(rows.join(ids.select("doc_id", "one"), "doc_id").where("fp > one").select(F.col("fp").alias("a"), F.col("one").alias("b")).distinct())
    label = materialize(components(links, "a", "b"), "labels")
    for table in spent:
        drop(table)
    named = each.join(label, each["fp"] == label["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    named = materialize(named.join(least, "class").select("fp", "component_id"), "named")
    for table in (each, label):
        drop(table)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def linked(fps: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> tuple[DataFrame, list[DataFrame]]:
    """(links (a, b) that connect what is within radius bits, the tables that they are in) of distinct fingerprints."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"blocks of {BLOCK_BITS} bits find at most {BLOCKS - 1} differing bits")
    turns = F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), gray_rank(_rotated(F.col("fp"), t)).alias("rank")) for t in range(BLOCKS))))
    order = fps.select("fp", turns.alias("t")).select("t.turn", "t.rank", "fp")
    order = order.repartitionByRange("turn", "rank").sortWithinPartitions("turn", "rank")
    found = materialize(order.mapInArrow(_pieces(piece, radius), _OUT), "pieces")
    near = found.where("kind = 0").select("a", "b")
    # groups that lie in several pieces: pieces are upper nodes with the bits that their members share
    ends = found.where("kind = 1").select("grp", "piece", F.col("a").alias("fp"))
    several = ends.groupBy("grp").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi")).where("lo < hi").select("grp")
    ends = materialize(ends.join(several, "grp"), "ends")
    spent = [found, ends]
    if ends.isEmpty():
        return near, spent
    label = materialize(components(near, "a", "b"), "labels")
    ends = ends.join(label, ends["fp"] == label["node"], "left").select("grp", "piece", "fp", F.coalesce("component", "fp").alias("label"))
    ends = materialize(ends, "ends")
    spent += [label, ends]
    node = ends.groupBy("grp", "piece").agg(F.bit_and("fp").alias("both"), F.bit_or("fp").alias("any"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    shared = F.bitwise_not(F.col("both").bitwiseXOR(F.col("any")))
    node = node.select("grp", "piece", F.col("both").alias("pattern"), shared.alias("mask"), "lo", "hi")
    side = lambda tag: node.select("grp", *(F.col(c).alias(f"{c}_{tag}") for c in node.columns[1:]))
    differ = F.bit_count(F.col("pattern_p").bitwiseXOR(F.col("pattern_q")).bitwiseAND(F.col("mask_p")).bitwiseAND(F.col("mask_q")))
    open_ = (F.least("lo_p", "lo_q") < F.greatest("hi_p", "hi_q")) & (differ <= radius) & (F.col("piece_p") < F.col("piece_q"))
    pairs = materialize(side("p").join(side("q"), "grp").where(open_).select("grp", F.col("piece_p").alias("p"), F.col("piece_q").alias("q")), "pairs")
    own = pairs.select("grp", "p", "q", F.explode(F.array("p", "q")).alias("piece"))
    meet = own.join(ends, ["grp", "piece"]).select("grp", "p", "q", _rank_of("grp", "fp").alias("rank"), "fp", "label")
    meet = meet.repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q", "rank")
    across = materialize(meet.mapInArrow(_pairs(radius), _OUT).select("a", "b"), "across")
    return near.unionByName(across), [*spent, pairs, across]


def _rank_of(group: str, fp: str) -> Column:
    """Gray rank in the rotation that a group's number names."""
    turn = F.shiftright(group, BLOCK_BITS)
    out = gray_rank(_rotated(F.col(fp), 0))
    for t in range(1, BLOCKS):
        out = F.when(turn == t, gray_rank(_rotated(F.col(fp), t))).otherwise(out)
    return out


def near_duplicates(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows = classes(docs, doc_col, text_col, radius)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
