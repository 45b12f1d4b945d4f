"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every text.

Edge cases: a null or empty text (or item) has no words: n_words 0, no hits, not contaminated. An item with fewer words
than the window is one window of its own length. Repeated items and repeated rows keep their own ids and results. The
windows of items without an id hit words as others do; in items they are one null, first in order, which counts as an item
and is left out of the checksum. Texts of any length are scanned whole; an empty table gives an empty one, an empty
benchmark hits nothing. Columns of the documents table other than id and text are neither read nor returned by `scan`;
`remove` passes them through, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_names, materialize, small_batches
from .words import ALNUM, chunks, hash_words, split_words, text_bytes, whole_windows, windows

WINDOW = 10
#: Most benchmark words in one broadcast block; a larger benchmark is scanned in several blocks. A worker's table takes about
#: 55 bytes a word and as much again while it is built.
BLOCK_WORDS = 4_000_000

#: Column of the row keys that bring a row's blocks together.
_ROW = "_row_key"
_SCAN = "doc_id long, n_words long, n_hit long, hit_from array<int>, hit_to array<int>, items array<string>"


class _Windows:
    """The windows of one block of items in flat arrays: by window length, sorted hashes and the first word of each."""

    def __init__(self, items: list[str | None], texts: list[str | None], size: int):
        raw, offsets = text_bytes(pa.array(texts, pa.string()))
        self.items, self.raw, self.words = items, raw, split_words(raw, offsets, ALNUM)
        hashes, counts = hash_words(raw, self.words), np.diff(self.words.first)
        self.tables = []
        for n in np.unique(np.minimum(counts[counts > 0], size)).tolist():
            first = whole_windows(self.words, n) if n == size else self.words.first[:-1][counts == n]
            table = windows(hashes, n)[first]
            order = np.argsort(table, kind="stable")
            self.tables.append((n, table[order], first[order].astype(np.int32), {}))

    @staticmethod
    def _text(raw, words, first: int, n: int) -> bytes:
        return b" ".join([raw[a:b].tobytes() for a, b in zip(words.starts[first : first + n].tolist(), words.ends[first : first + n].tolist(), strict=True)]).lower()

    def _of_hash(self, n: int, table, first, seen: dict, place: int) -> dict[bytes, list]:
        """{window: items} of the windows that share the hash at a place; read once a worker."""
        if place not in seen:
            found: dict[bytes, set] = {}
            for p in range(place, int(np.searchsorted(table, table[place], side="right"))):
                found.setdefault(self._text(self.raw, self.words, int(first[p]), n), set()).add(self.items[self.words.doc[first[p]]])
            seen[place] = {text: list(items) for text, items in found.items()}
        return seen[place]

    def hits(self, raw, words, hashes) -> tuple[np.ndarray, list[tuple[int, list]]]:
        """(mask of the words inside a verified window, [(row, items)])."""
        mask = np.zeros(len(hashes) + 1, dtype=np.int64)
        found: list[tuple[int, list]] = []
        for n, table, starts, seen in self.tables:
            at = whole_windows(words, n)
            if not len(at):
                continue
            h = windows(hashes, n)[at]
            place = np.searchsorted(table, h)
            for k in np.flatnonzero(table[np.minimum(place, len(table) - 1)] == h).tolist():
                first = int(at[k])
                # verify: equal words, not only equal hashes
                items = self._of_hash(n, table, starts, seen, int(place[k])).get(self._text(raw, words, first, n))
                if items:
                    mask[first] += 1
                    mask[first + n] -= 1
                    found.append((int(words.doc[first]), items))
        return np.cumsum(mask[:-1]) > 0, found


def _scanner(blocks, size: int):
    """Scans (row key, id, text), or (id, text); the row key, where there is one, passes through."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Windows(*blocks.value, size)
        for batch in batches:
            keys, ids, (raw, offsets) = batch.columns[:-2], batch.column(batch.num_columns - 2), text_bytes(batch.column(batch.num_columns - 1))
            for a, b in chunks(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words = split_words(part, off, ALNUM)
                inside, found = table.hits(part, words, hash_words(part, words))
                items: list[set] = [set() for _ in range(b - a)]
                for row, names in found:
                    items[row].update(names)
                at = np.flatnonzero(inside)
                doc = words.doc[at]
                # neighbouring hit words of one text are one span, in word places within the text
                begins = np.ones(len(at), dtype=bool)
                begins[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
                ends = np.ones(len(at), dtype=bool)
                ends[:-1] = begins[1:]
                frm, to = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                for row, x, y in zip(doc[begins], at[begins], at[ends], strict=True):
                    frm[row].append(int(x - words.first[row]))
                    to[row].append(int(y - words.first[row]) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(k.slice(a, b - a) for k in keys),
                        ids.slice(a, b - a).cast(pa.int64()),
                        pa.array(np.diff(words.first)),
                        pa.array(np.bincount(doc, minlength=b - a).astype(np.int64)),
                        pa.array(frm, pa.list_(pa.int32())),
                        pa.array(to, pa.list_(pa.int32())),
                        pa.array([sorted(s, key=lambda x: (x is not None, x)) for s in items], pa.list_(pa.string())),
                    ],
                    names=[*batch.schema.names[:-2], "doc_id", "n_words", "n_hit", "hit_from", "hit_to", "items"],
                )

    return scan


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The items in blocks of bounded size, read one block at a time."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"), words.alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-int(total) // block_words))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        got = part.where("n > 0").select("item", "text").toArrow()
        yield got.column(0).to_pylist(), got.column(1).to_pylist()


def scan(docs: DataFrame, benchmark: DataFrame, doc_col="doc_id", text_col="text", item_col="item_id", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, hit spans [hit_from, hit_to) in words, and the sorted items with occurring windows."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _item_blocks(benchmark, item_col, text_col, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return narrow.mapInArrow(_scanner(spark.sparkContext.broadcast(first), size), _SCAN)
    rows = materialize(narrow.select(F.monotonically_increasing_id().alias(_ROW), "doc_id", "text"), "rows")
    return _scan_blocks(rows, itertools.chain([first, second], blocks), size).drop(_ROW)


def _scan_blocks(rows: DataFrame, blocks, size: int) -> DataFrame:
    """The scan of rows (row key, doc_id, text) over several blocks: a row's spans meet again by its key."""
    spark, both = rows.sparkSession, None
    for block in blocks:
        part = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(block), size), f"{_ROW} long, {_SCAN}")
        both = part if both is None else both.unionByName(part)
    places = F.array_distinct(F.flatten(F.transform(F.arrays_zip("hit_from", "hit_to"), lambda s: F.sequence(s["hit_from"], s["hit_to"] - 1))))
    return (
        both.withColumn("places", places)
        .groupBy(_ROW)
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("places")))).alias("p"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select(
            _ROW, "doc_id", "n_words", F.size("p").cast("long").alias("n_hit"),
            F.filter("p", lambda x: ~F.array_contains("p", x - 1)).alias("hit_from"),
            F.transform(F.filter("p", lambda x: ~F.array_contains("p", x + 1)), lambda x: x + 1).alias("hit_to"),
            "items",
        )
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _cutter(blocks, size: int, text_at: int):
    """Cuts the hits of one block, or with blocks None those that the last two columns (from and to) name."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if blocks is None else _Windows(*blocks.value, size)
        for batch in batches:
            column = batch.column(text_at)
            spans = None if blocks is not None else [c.to_pylist() for c in batch.columns[-2:]]
            raw, offsets = text_bytes(column)
            out: list[str | None] = []
            for a, b in chunks(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words = split_words(part, off, ALNUM)
                if spans is None:
                    inside, _ = table.hits(part, words, hash_words(part, words))
                else:
                    inside = np.zeros(len(words.doc), dtype=bool)
                    for row in range(b - a):
                        for x, y in zip(spans[0][a + row] or (), spans[1][a + row] or (), strict=True):
                            inside[words.first[row] + x : words.first[row] + y] = True
                dirty = np.zeros(b - a, dtype=bool)
                dirty[words.doc[inside]] = True
                for row in range(b - a):
                    whole = part[off[row] : off[row + 1]]
                    if not dirty[row]:
                        out.append(column[a + row].as_py())
                        continue
                    keep = np.ones(len(whole), dtype=bool)
                    first, last = words.first[row], words.first[row + 1]
                    for i in range(first, last):
                        if inside[i]:  # the word goes with what parts it from a hit word before it
                            frm = words.ends[i - 1] if i > first and inside[i - 1] else words.starts[i]
                            keep[frm - off[row] : words.ends[i] - off[row]] = False
                    out.append(whole[keep].tobytes().decode())
            fields = list(batch.schema)[: None if spans is None else -2]
            columns = batch.columns[: len(fields)]
            columns[text_at] = pa.array(out, batch.schema.field(text_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return cut


def remove(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with every hit word cut from its text; all columns stay, clean texts and nulls are returned as they are.

    Hits are those of the texts as given, whatever the number of blocks: with several, all blocks are scanned first, the
    spans of a row are united by a row key and cut once. Words that become neighbours by a cut are not searched again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    blocks = _item_blocks(benchmark, item_col, text_col, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return docs.mapInArrow(_cutter(spark.sparkContext.broadcast(first), size, at), docs.schema)
    own, hit_from, hit_to = free_names(docs.columns, _ROW, "hit_from", "hit_to")
    rows = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(own).alias(_ROW), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hits = _scan_blocks(texts, itertools.chain([first, second], blocks), size).where("n_hit > 0")
    found = rows.join(hits.select(F.col(_ROW).alias(own), F.col("hit_from").alias(hit_from), F.col("hit_to").alias(hit_to)), own, "left")
    return found.select(*docs.columns, hit_from, hit_to).mapInArrow(_cutter(None, size, at), docs.schema)
