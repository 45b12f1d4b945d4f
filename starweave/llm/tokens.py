"""Token ids of whole texts: one encoder, and two file formats that Spark tasks write to the shared folder.

`Encoder` gives what the tokenizers library gives for the whole text. Byte-level pre-tokenization always cuts a text at some
places (see `cuts`), so the pieces between them are encoded by the library on their own, and each distinct piece once per
worker. A text that holds an added token of the tokenizer (a string like <|endoftext|>) is one piece, unless special tokens
count as ordinary text.

`write_batches` / `read_batches`: Arrow files of fixed-size-list batches: rows of `sequence` ids with a mask, plus an index
batch file of (doc_id, place, n). Ids lie in one flat buffer, so any range of the stream is a slice without a copy;
`Sequences` maps a file into memory and gives any row so.

Files are named by a random key and only count once a task's manifest row is in the written manifest table: a task that is
lost or run twice leaves files nobody reads, never a half-written one in use.

Edge cases: null and empty texts have the end id only. Repeated doc_ids keep one entry a row (ties by the text); null ids
come first. Very long texts are encoded whole, CHUNK_BYTES at a time. An empty table writes no files. Other columns are not
read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize, new_path, small_batches
from .words import CHUNK_BYTES, hash_bytes, mix, place_weights, text_bytes

END_ID, SEQUENCE, CACHE_PIECES = 2, 2048, 1_000_000
#: Ids of one file at most; a longer partition goes on in a further file.
FILE_IDS = 1 << 24

#: Classes of bytes: unsure, Latin letter, digit or sign, apostrophe, space, other white space.
_UNSURE, _LETTER, _SIGN, _APOSTROPHE, _SPACE, _BREAK = range(6)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[0x21:0x7F] = _SIGN
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[0x27], _CLASS[0x20] = _APOSTROPHE, _SPACE
_CLASS[[9, 10, 13]] = _BREAK
#: _CUT[6 * before + after]: the text is always cut between two bytes of these classes.
_CUT = np.zeros(36, dtype=bool)
for _before, _after in ((_LETTER, _SIGN), (_LETTER, _APOSTROPHE), (_SIGN, _LETTER), *((x, y) for x in (_LETTER, _SIGN, _APOSTROPHE) for y in (_SPACE, _BREAK))):
    _CUT[6 * _before + _after] = True


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether byte-level pre-tokenization cuts before each byte, wherever that is sure from its neighbours.

    A run of letters ends at any other sign, a sign other than an apostrophe ends before a letter, and both end before white
    space. White space goes with what follows it, but a single break between two others stands alone.
    """
    kind = _CLASS[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))  # the letters from U+00C0 to U+024F, but for two signs
    lead = lead[lead + 1 < len(raw)]
    after = raw[lead + 1]
    lead = lead[~((raw[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((raw[lead] == 0xC9) & (after >= 0x90))]
    kind[lead] = kind[lead + 1] = _LETTER
    out = np.zeros(len(raw), dtype=bool)
    out[1:] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
    solid = (kind >= _LETTER) & (kind <= _APOSTROPHE)
    out[2:] |= (kind[1:-1] == _BREAK) & solid[:-2] & solid[2:]
    return out


class Encoder:
    def __init__(self, path: str, plain: bool = False):
        """plain: strings of special tokens in a text are ordinary text."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content and not (plain and t.special)]
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        self.dtype = np.uint32 if self.tokenizer.get_vocab_size() > 1 << 16 else np.uint16
        self._forget()

    def _forget(self, salt: int = 1) -> None:
        self.salt = np.uint64(salt)
        # known pieces: hashes in order and the place of each; by place: first byte and first id, and the end
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.byte_at, self.id_at = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, self.dtype)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end) of a string column, as the library gives them for each whole text with
        add_special_tokens=False; null counts as empty."""
        raw, offsets = text_bytes(column)
        cut = cuts(raw)
        if self.added:
            for m in self.added.finditer(raw.tobytes()):
                row = int(np.searchsorted(offsets, m.start(), side="right")) - 1
                if m.end() <= offsets[row + 1]:
                    cut[offsets[row] : offsets[row + 1]] = False  # the whole text goes to the library
        cut = np.append(cut, False)
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends, n_ids, out = np.append(starts[1:], len(raw)), [], []
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
            piece = self._known(raw[starts[at] : ends[to - 1]], starts[at:to] - starts[at], ends[at:to] - starts[at:to])
            n = self.id_at[piece + 1] - self.id_at[piece]
            out.append(self.ids[np.repeat(self.id_at[piece] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            n_ids.append(n)
            at = to
        if not out:
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        before = np.concatenate(([0], np.cumsum(np.concatenate(n_ids))))
        return np.concatenate(out), before[np.searchsorted(starts, offsets)]

    def _known(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place of each piece among the known ones; new pieces are encoded and added. Equal places are equal pieces:
        all are compared byte by byte, and a collision of hashes starts the store anew with others."""
        if len(self.hashes) > CACHE_PIECES or len(self.ids) > 8 * CACHE_PIECES:
            self._forget(int(self.salt))
        inside = np.arange(len(raw)) - np.repeat(starts, sizes)
        while True:
            values = hash_bytes(raw) if self.salt == 1 else mix(raw + self.salt)
            h, pick, back = np.unique(mix(np.add.reduceat(values * place_weights(inside, int(sizes.max())), starts) + sizes.astype(np.uint64)), return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, h)
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
            index = np.zeros(len(h), np.int64)
            index[known] = self.order[at[known]]
            index[~known] = len(self.hashes) + np.arange(int((~known).sum()))
            new = pick[~known]
            if len(new):
                self._add(raw, starts[new], sizes[new])
                self.hashes, self.order = np.insert(self.hashes, at[~known], h[~known]), np.insert(self.order, at[~known], index[~known])
            piece = index[back]
            if (np.diff(self.byte_at)[piece] == sizes).all() and (self.bytes[np.repeat(self.byte_at[piece] - starts, sizes) + np.arange(len(raw))] == raw).all():
                return piece
            self._forget(int(self.salt) + 1)

    def _add(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        whole = raw.tobytes()
        texts = [whole[a : a + n].decode() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        counts, ids = [], []
        for a in range(0, len(texts), 4096):
            for got in self.tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False):
                own = got.ids
                counts.append(len(own))
                ids += own
        grow = lambda bounds, n: np.concatenate([bounds, bounds[-1] + np.cumsum(n)])
        self.byte_at, self.id_at = grow(self.byte_at, sizes), grow(self.id_at, counts)
        self.bytes = np.concatenate([self.bytes, raw[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]])
        self.ids = np.concatenate([self.ids, np.array(ids, dtype=self.dtype)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, first = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, first[1:-1]) if texts else []

    def encode_ended(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """encode_column with one id more after each text."""
        ids, first = self.encode_column(column)
        return np.insert(ids, first[1:], self.dtype(end)), first + np.arange(len(first))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One a worker process, kept between tasks."""
    if (path, plain) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


def open_store(folder: str):
    """(file system, path) of a shared folder, by its scheme."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
    store.create_dir(path, recursive=True)
    return store, path


class _Out:
    """One partition's Arrow files: ids packed to equal-length rows."""

    def __init__(self, folder: str, dtype, sequence: int, file_ids: int):
        self.store, self.path = open_store(folder)
        self.files: list[tuple[str, int | None, int, int]] = []
        self.dtype, self.sequence, self.file_ids = dtype, sequence, file_ids
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self._new()

    def _new(self) -> None:
        self.waiting, self.n_waiting, self.name, self.sink, self.total, self.index = [], 0, None, None, 0, []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, first: np.ndarray) -> None:
        """Texts with their ids; a file takes whole texts, and a further one begins once it has file_ids ids."""
        at = 0
        while at < len(doc_ids):
            to = min(len(doc_ids), max(at, int(np.searchsorted(first, first[at] + self.file_ids - self.total)) - 1) + 1)
            if self.name is None:
                self.name = uuid.uuid4().hex
                self.file = self.store.open_output_stream(f"{self.path}/{self.name}.arrow")
                self.sink = pa.ipc.new_file(self.file, self.schema)
            self.index.append(pa.record_batch([doc_ids.slice(at, to - at).cast(pa.int64()), pa.array(self.total + first[at:to] - first[at]), pa.array(np.diff(first[at : to + 1]))], names=["doc_id", "at", "n"]))
            self.waiting.append(ids[first[at] : first[to]])
            self.n_waiting += len(self.waiting[-1])
            self.total += len(self.waiting[-1])
            if self.n_waiting >= 64 * self.sequence:
                self._batch(False)
            if self.total >= self.file_ids:
                self.close()
            at = to

    def _batch(self, last: bool) -> None:
        flat = np.concatenate([np.zeros(0, self.dtype), *self.waiting])
        size = self.sequence
        rows = -(-len(flat) // size) if last else len(flat) // size
        use = min(len(flat), rows * size)
        if rows:
            ids = flat[:use] if use == rows * size else np.append(flat, np.zeros(rows * size - use, self.dtype))
            mask = np.arange(rows * size) < use
            self.sink.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), size), pa.FixedSizeListArray.from_arrays(pa.array(mask), size)], schema=self.schema))
        self.waiting, self.n_waiting = [flat[use:]], len(flat) - use

    def close(self) -> None:
        if self.name is None:
            return
        self._batch(True)
        self.sink.close()
        self.file.close()
        table = pa.Table.from_batches(self.index).combine_chunks()
        with self.store.open_output_stream(f"{self.path}/{self.name}.index.arrow") as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
        self.files.append((self.name, table.column(0)[0].as_py(), len(table), self.total))
        self._new()


_MANIFEST = "folder string, name string, first_doc long, part int, seq int, n_docs long, n_ids long"


def _writer(path: str, folder: str, sequence: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), 0
        out = _Out(folder, enc.dtype, sequence, file_ids)
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            out.add(batch.column(0), *enc.encode_ended(batch.column(1), END_ID))
        out.close()
        for seq, (name, first, n_docs, n_ids) in enumerate(out.files):
            yield pa.RecordBatch.from_pylist([{"folder": folder, "name": name, "first_doc": first, "part": part, "seq": seq, "n_docs": n_docs, "n_ids": n_ids}], pa.schema([("folder", pa.string()), ("name", pa.string()), ("first_doc", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return write


def write_batches(docs: DataFrame, path: str, folder: str | None = None, doc_col="doc_id", text_col="text", sequence: int = SEQUENCE, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of docs in ascending order of doc_id. Returns the manifest: one row a file, with start, the ids before it."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "ids")
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    manifest = materialize(ordered.mapInArrow(_writer(path, folder, sequence, file_ids), _MANIFEST), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return materialize(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))), "manifest")


class Sequences:
    """The rows of one id file on a mounted path: any of them is a view of the mapped file, without a copy."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(pa.memory_map(path))
        self.batches = [self.file.get_batch(b) for b in range(self.file.num_record_batches)]  # views, too
        self.first = np.concatenate(([0], np.cumsum([b.num_rows for b in self.batches], dtype=np.int64)))

    def __len__(self) -> int:
        return int(self.first[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of row i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        b = int(np.searchsorted(self.first, i, side="right")) - 1
        ids, mask = (c.values.slice((i - int(self.first[b])) * c.type.list_size, c.type.list_size) for c in self.batches[b].columns)
        return ids.to_numpy(zero_copy_only=True), mask


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, name, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            store, path = open_store(folder)
            with store.open_input_file(f"{path}/{name}.index.arrow") as f:
                index = pa.ipc.open_file(f).read_all()
            doc_id = index.column("doc_id").combine_chunks()
            at, n = index.column("at").to_numpy(), index.column("n").to_numpy()
            crc = np.zeros(len(n), dtype=np.int64)
            with store.open_input_file(f"{path}/{name}.arrow") as f:
                file = pa.ipc.open_file(f)
                row, base, flat = 0, 0, np.zeros(0, np.uint16)
                for b in range(file.num_record_batches):
                    got = file.get_batch(b)
                    ids = got.column(0).flatten().to_numpy()
                    mask = got.column(1).flatten()
                    flat = np.concatenate([flat, ids[: mask.true_count]]) if len(flat) else ids[: mask.true_count]
                    while row < len(n) and at[row] + n[row] <= base + len(flat):
                        crc[row] = zlib.crc32(flat[at[row] - base : at[row] - base + n[row]].astype("<u4").tobytes())
                        row += 1
                    cut = (at[row] if row < len(n) else base + len(flat)) - base
                    flat, base = flat[cut:], base + cut
            for a in range(0, len(n), 4096):
                s = slice(a, a + 4096)
                yield pa.RecordBatch.from_arrays([doc_id[s], pa.array(at[s] + start), pa.array(n[s]), pa.array(crc[s])], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_batches(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    spread = manifest.select("folder", "name", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "name")
    return spread.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
