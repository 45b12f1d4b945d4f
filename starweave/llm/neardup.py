"""MinHash near-duplicate detection with tensored banding.

A document's set is its distinct 5-word shingles. HALVES small collections of HALF_HASHES minhashes each give half keys;
a table key is a pair of half keys, so HALVES * HALF_HASHES minhashes serve HALVES * (HALVES - 1) / 2 tables of twice
HALF_HASHES hashes. A pair of similarity 0.75 shares no table key with probability under 4e-5.

1. Rows with equal sets (by a 128-bit fingerprint and the size) are one class, with a number of its own and one text.
2. Half keys that only one class has are dropped, which loses nothing; pairs of the rest are the table keys.
3. In every table bucket each member is compared with one centre only, the member whose half keys are the most shared: as
   many candidates as rows. Exact Jaccard similarity on whole sets confirms links.
4. Components of the confirmed links. Buckets that now lie in one component are done. In the rest (the open ones), pairs
   across components are confirmed by their sets too, and components formed anew. Such a pair shares a shingle with at most
   RARE holders, and is found by it, or its intersection has common shingles only, and must fit into what either side has
   of those: copies of one line or passage in else different texts end there. Signatures of both must agree in at least
   MIN_AGREE places (lost at 0.75: under 3e-5). The largest component of an open bucket is not compared with itself, and a
   member outside it meets it bucket by bucket or all of it once, whichever is less. No bucket, group or candidate list has a cap.

Words and shingles are compared by 64-bit hashes, in which all bytes of a word count, however long it is.

Edge cases: lower-casing touches A-Z only. A text with 1 to 4 words is one shingle, its whole sequence. Texts without
words, and nulls, are empty: n_shingles 0, linked with nothing, kept. Very long texts give their whole sets. Repeated rows
of one id are one document: all their texts count, in whatever order they come, and their classes meet in one component;
`dedup` keeps one row of it, the one with the least text. Rows with a null id have the component of the rows with an id and
the same set, else none, and link nothing. Ids are under 7 * 2^60. Equal similarities are no ties: all links count, and a component is named after its least id. An empty table gives
an empty one. Extra columns are not read; `dedup` passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import drop, free_names, materialize, small_batches
from .words import chunks, mix, shingle_sets, text_bytes

SHINGLE = 5
HALVES, HALF_HASHES = 24, 3
#: Shingles with at most so many holders among the open documents are looked up one by one.
RARE = 16
#: Of the 72 four-bit places of two signatures, at least so many agree.
MIN_AGREE = 40
#: Members of one side of a meeting that one task compares with as many of the other.
BLOCK_ROWS = 4096
_N = HALVES * HALF_HASHES
_rng = np.random.default_rng(4711)
_A = _rng.integers(1, 1 << 63, _N, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, _N, dtype=np.uint64)
_LONGS = -(-_N // 16)

_SIGNED = "doc_id long, n_shingles int, fp1 long, fp2 long, halves array<long>, sketch array<long>"


def _sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's shingle set: a 128-bit fingerprint, its size, and all shingles and first places."""
    gram, first = shingle_sets(raw, offsets, SHINGLE)
    sizes = np.diff(first)
    full = np.flatnonzero(sizes)
    fps = np.zeros((len(sizes), 2), dtype=np.uint64)
    if len(full):
        at = first[:-1][full]
        fps[full, 0] = np.add.reduceat(mix(gram), at)
        fps[full, 1] = np.add.reduceat(mix(gram ^ _A[0]), at)
    return fps, sizes, gram, first


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            fps, sizes, gram, first = _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            full = np.flatnonzero(sizes)
            at = first[:-1][full]
            sig = np.zeros((b - a, _N), dtype=np.uint64)
            if len(full):
                for k in range(_N):
                    h = gram * _A[k] + _B[k]
                    sig[full, k] = np.minimum.reduceat(h ^ (h >> np.uint64(32)), at)
            parts = sig.reshape(b - a, HALVES, HALF_HASHES)
            halves = np.zeros((b - a, HALVES), dtype=np.uint64)
            for k in range(HALF_HASHES):
                halves = mix(halves + parts[:, :, k] * _A[k])
            halves = mix(halves + np.arange(1, HALVES + 1, dtype=np.uint64))
            nibbles = np.zeros((b - a, _LONGS * 16), dtype=np.uint64)
            nibbles[:, :_N] = mix(sig) & np.uint64(15)
            sketch = (nibbles.reshape(b - a, _LONGS, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(sizes.astype(np.int32)), pa.array(fps[:, 0].astype(np.int64)), pa.array(fps[:, 1].astype(np.int64)), lists(halves), lists(sketch)],
                names=["doc_id", "n_shingles", "fp1", "fp2", "halves", "sketch"],
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the pairs with 100 * |A and B| >= 75 * |A or B|, on whole sets."""
    for batch in batches:
        sets = []
        for k in (2, 3):
            raw, offsets = text_bytes(batch.column(k))
            own = []
            for a, b in chunks(offsets):
                gram, first = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE)
                own += [gram[first[i] : first[i + 1]] for i in range(b - a)]
            sets.append(own)
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(*sets, strict=True)):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)
        yield batch.select([0, 1]).filter(pa.array(keep))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, text) to one row a distinct shingle."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            gram, first = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], SHINGLE)
            ids = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(gram.astype(np.int64))], names=["cls", "gram"])


def signatures(docs: DataFrame, doc_col="doc_id", text_col="text") -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sign, _SIGNED)


def _agree(x: str, y: str) -> Column:
    """Equal four-bit places of two sketches (places beyond _N are zero in both and are taken off again)."""
    total = F.lit(0)
    for k in range(_LONGS):
        d = F.col(x)[k].bitwiseXOR(F.col(y)[k])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + (F.lit(16) - F.bit_count(d))
    return total - F.lit(_LONGS * 16 - _N)


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that whole sets confirm."""
    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the key of the text's class and the text."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            fps, sizes, _, _ = _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([pa.array(fps[:, 0].astype(np.int64)), pa.array(fps[:, 1].astype(np.int64)), pa.array(sizes.astype(np.int32)), batch.column(1).slice(a, b - a)], names=["fp1", "fp2", "n_shingles", "text"])


_KEY = ["fp1", "fp2", "n_shingles"]


#: Numbers of classes that cannot be named after their least id begin here; ids are below.
_BEYOND = 7 << 60


def _texts(docs: DataFrame, doc_col: str, text_col: str, several: DataFrame | None, members: DataFrame) -> DataFrame:
    """(cls, text): one text of each class. members: cls, least (its least id) and the key of each class. several: the ids with
    more than one class, if there are any; their rows are told apart by their sets, and for all others the id names the text."""
    rows = docs.select(F.col(doc_col).cast("long").alias("least"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    one = members if several is None else members.join(several, F.col("least") == F.col("doc_id"), "left_anti")
    texts = rows.join(one.select("cls", "least"), "least").dropDuplicates(["least"]).select("cls", "text")  # by the join's key: one shuffle
    if several is not None:
        own = members.join(several, F.col("least") == F.col("doc_id"), "left_semi")
        keyed = rows.join(own.select("least").distinct(), "least", "left_semi").mapInArrow(_keyed, "fp1 long, fp2 long, n_shingles int, text string")
        texts = texts.unionByName(keyed.join(own.select("cls", *_KEY), _KEY).dropDuplicates(["cls"]).select("cls", "text"))
    return materialize(texts, "texts")


def _classes(filled: DataFrame, several: DataFrame | None) -> DataFrame:
    """One row a class: its key, least id, halves, sketch, and cls, its number: the least id, or, where an id is the least of
    several classes, that of the first only, and a number beyond all ids for the others (the id links them with the first)."""
    reps = filled.groupBy(_KEY).agg(F.min("doc_id").alias("least"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
    if several is None:
        return materialize(reps.withColumn("cls", F.col("least")), "classes")
    reps = materialize(reps, "classes")
    first = reps.groupBy(F.col("least").alias("_least")).agg(F.min(F.struct(*_KEY)).alias("_first"))
    named = reps.join(first, F.col("least") == F.col("_least"))
    cls = F.when(F.struct(*_KEY) == F.col("_first"), F.col("least")).otherwise(F.lit(_BEYOND) + F.monotonically_increasing_id())
    out = materialize(named.select(*reps.columns, cls.alias("cls")), "classes")
    drop(reps)
    return out


#: Where two sides meet: a loose member with all of a main component, or with its part in one bucket, or loose ones of a bucket.
MAIN, BUCKET, LOOSE = 0, 1, 2


def _meetings(rows: DataFrame) -> tuple[DataFrame, ...]:
    """rows: (key, cls, comp), the members of the open buckets. Two tables (kind, id, cls) in which each pair of one bucket whose
    components differ meets by an equal (kind, id): the main component of a bucket, the one with most members there, is not
    compared with itself, and where a loose member would meet a main component in bucket after bucket, as often as that has
    members or more, it meets each of these once instead, whatever the buckets. No table if no bucket has two components."""
    size = rows.groupBy("key", "comp").agg(F.count("*").alias("s"))
    main = size.groupBy("key").agg(F.max(F.struct("s", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("m.comp").alias("main"), F.col("m.s").alias("s"))
    rows = materialize(rows.join(main, "key"), "placed")
    if rows.isEmpty():
        drop(rows)
        return ()
    loose, inner = rows.where("comp <> main"), rows.where("comp = main")
    members = materialize(inner.select("main", "cls").distinct(), "members")  # else joins are pushed below the distinct, to a row a bucket
    asked = loose.groupBy("cls", "main").agg(F.sum("s").alias("cost")).join(members.groupBy("main").agg(F.count("*").alias("n")), "main").where("cost >= n").select("cls", "main")
    asked = materialize(asked, "asked")
    single = loose.join(asked, ["cls", "main"], "left_anti")
    mixed = loose.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    among = loose.join(mixed, "key", "left_semi")
    of = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"), "cls")
    left = of(asked, MAIN, "main").union(of(single, BUCKET, "key")).union(of(among, LOOSE, "key"))
    right = of(members.join(asked.select("main").distinct(), "main", "left_semi"), MAIN, "main")
    right = right.union(of(inner.join(single.select("key").distinct(), "key", "left_semi"), BUCKET, "key")).union(of(among, LOOSE, "key"))
    left, right = materialize(left, "left"), materialize(right, "right")
    for table in (rows, members, asked):
        drop(table)
    return left, right


def _cells(left: DataFrame, right: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both tables with the cell in which a row meets the other side's: large sides are dealt out in blocks, and each pair of
    blocks meets in a task of its own."""
    large = lambda df, c: df.groupBy("kind", "id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(c)).where(F.col(c) > 1)
    large_left, large_right = large(left, "m"), large(right, "n")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.join(large_left, ["kind", "id"], "left").join(large_right, ["kind", "id"], "left").fillna(1, ["m", "n"])
        df = df.withColumn("own", F.pmod(F.xxhash64("cls"), F.col(own)).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
        i, j = ("own", "other") if own == "m" else ("other", "own")
        return df.select("cls", F.struct("kind", "id", F.col(i).alias("i"), F.col(j).alias("j")).alias("cell"))

    return dealt(left, "m", "n"), dealt(right, "n", "m")


def _across(rest: DataFrame, texts: DataFrame, sketches: DataFrame, own: DataFrame, star: DataFrame, block_rows: int) -> DataFrame:
    """The confirmed links (a, b) between components in the open buckets, rest: (key, cls, n_shingles, comp)."""
    # how many holders among the open documents a shingle has: up to RARE, pairs come from the shingle itself; what a
    # document has of the others bounds every other intersection
    grams = texts.join(rest.select("cls").distinct(), "cls", "left_semi").mapInArrow(_grams, "cls long, gram long")
    rare = materialize(grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("cls").alias("one")).where(F.col("n") <= RARE), "rare")
    alone = rare.where("n = 1").groupBy(F.col("one").alias("cls")).agg(F.count("*").cast("int").alias("alone"))
    held = materialize(grams.join(rare.where("n > 1").select("gram"), "gram"), "rare")
    some = held.groupBy("cls").agg(F.count("*").cast("int").alias("held"))
    about = rest.select("cls", "n_shingles", "comp").distinct().join(alone, "cls", "left").join(some, "cls", "left").join(sketches, "cls").join(own.select("cls", "h"), "cls")
    about = materialize(about.withColumn("common", F.col("n_shingles") - F.coalesce("alone", F.lit(0)) - F.coalesce("held", F.lit(0))).drop("alone", "held"), "open")

    def side(rows: DataFrame, key: str, tag: str) -> DataFrame:
        return rows.select(key, *(F.col(c).alias(f"{c}_{tag}") for c in ("cls", "n_shingles", "comp", "sketch", "common", "h")))

    apart = (F.col("comp_a") != F.col("comp_b")) & (100 * F.least("n_shingles_a", "n_shingles_b") >= 75 * F.greatest("n_shingles_a", "n_shingles_b"))
    alike = _agree("sketch_a", "sketch_b") >= MIN_AGREE
    # without a rare shingle in common: 175 * intersection >= 75 * (size + size) must fit into what is common
    fits = apart & (175 * F.least("common_a", "common_b") >= 75 * (F.col("n_shingles_a") + F.col("n_shingles_b"))) & alike
    both = F.array_intersect("h_a", "h_b")
    first = F.xxhash64(both[0], both[1])  # of the keys that a pair shares, only the first makes a row
    shared = held.join(about, "cls")
    x, y = side(shared, "gram", "a"), side(shared, "gram", "b")
    across = x.join(y, (x["gram"] == y["gram"]) & (F.col("cls_a") < F.col("cls_b")) & apart & alike).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    met = _meetings(rest.select("key", "cls", "comp").join(about.where("100 * common >= 75 * n_shingles").select("cls"), "cls"))
    if met:
        x, y = _cells(*met, block_rows)
        x, y = side(x.join(about, "cls"), "cell", "a"), side(y.join(about, "cls"), "cell", "b")
        once = ((x["cell"]["kind"] == MAIN) | (first == x["cell"]["id"])) & ((x["cell"]["kind"] != LOOSE) | (F.col("cls_a") < F.col("cls_b")))
        across = across.union(x.join(y, (x["cell"] == y["cell"]) & fits & once).select(F.least("cls_a", "cls_b"), F.greatest("cls_a", "cls_b")))
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = materialize(_links(across.distinct().join(tried, ["a", "b"], "left_anti"), texts), "confirmed")
    for table in (rare, held, about, *met):
        drop(table)
    return more


def classes(docs: DataFrame, doc_col="doc_id", text_col="text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id."""
    signed = materialize(signatures(docs, doc_col, text_col), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = materialize(filled.groupBy("doc_id").agg(F.min(F.struct(*_KEY)).alias("lo"), F.max(F.struct(*_KEY)).alias("hi")).where("lo <> hi").select("doc_id"), "several")
    several = None if repeated.isEmpty() else repeated
    reps = _classes(filled, several)

    half = reps.select("cls", "n_shingles", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    own = half.join(shared, "half").groupBy("cls", "n_shingles").agg(F.sort_array(F.collect_list("half")).alias("h"), F.sum("n").alias("weight")).where(F.size("h") > 1)
    own = materialize(own, "halves")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("h") - 1), lambda i: F.transform(F.slice("h", i + 1, F.size("h")), lambda y: F.xxhash64(F.element_at("h", i), y))))
    rows = own.select("cls", "n_shingles", "weight", F.explode(pairs).alias("key"))
    centre = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("weight", (-F.col("cls")).alias("minus"))).alias("c")).where("n > 1").select("key", (-F.col("c.minus")).alias("centre"))
    buckets = materialize(rows.join(centre, "key").select("key", "cls", "n_shingles", "centre"), "buckets")

    members = reps.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "least", *_KEY)
    texts = _texts(docs, doc_col, text_col, several, members)

    star = buckets.where("cls <> centre").select(F.col("cls").alias("a"), F.col("centre").alias("b")).distinct()
    links = materialize(_links(star, texts), "confirmed")
    found = [links]
    label = materialize(components(links, "a", "b"), "labels")

    named = buckets.join(label, buckets["cls"] == label["node"], "left").select("key", "cls", "n_shingles", F.coalesce("component", "cls").alias("comp"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = materialize(named.join(open_keys, "key", "left_semi"), "open")
    # each step ends where it has nothing left: small tables would else cost as many jobs and plans as large ones
    if not rest.isEmpty():
        found.append(_across(rest, texts, reps.select("cls", "sketch"), own, star, block_rows))
    more = found[1:] and not found[1].isEmpty()
    if more:
        links = links.union(found[1])
    if several is not None:
        # the classes of one id are one document: each is linked with the first
        classed = filled.select("doc_id", *_KEY).join(several, "doc_id", "left_semi").distinct().join(reps.select(*_KEY, "cls"), _KEY).select("doc_id", "cls")
        links = links.union(classed.join(classed.groupBy("doc_id").agg(F.min("cls").alias("b")), "doc_id").where("cls > b").select(F.col("cls").alias("a"), "b").distinct())
    if more or several is not None:
        before, label = label, materialize(components(links, "a", "b"), "labels")
        drop(before)

    named = materialize(reps.select(*_KEY, "cls"), "named")
    for table in (reps, own, buckets, texts, *found, rest, repeated):
        drop(table)  # the result reads signatures, names and labels only
    named = signed.join(named, _KEY, "left")
    return named.join(label, named["cls"] == label["node"], "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component", "cls", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, doc_col="doc_id", text_col="text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    return classes(docs, doc_col, text_col, block_rows).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def dedup(docs: DataFrame, doc_col="doc_id", text_col="text") -> DataFrame:
    """docs with one row of one document of each component; all columns stay. Rows with a null id have no component and all stay."""
    kept_id, place = free_names(docs.columns, "kept_id", "place")
    kept = classes(docs, doc_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    named = docs.join(kept, F.col(doc_col) == F.col(kept_id), "left_semi")
    hashed = [f.name for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    order = Window.partitionBy(F.col(doc_col)).orderBy(F.col(text_col).asc_nulls_last(), F.xxhash64(*hashed))
    one = named.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return one.unionAll(docs.where(F.col(doc_col).isNull()))
