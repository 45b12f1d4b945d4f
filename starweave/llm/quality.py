"""Quality rules by distribution divergence.

Each document's histogram of character classes and of common words is compared with its language's reference by the
Jensen-Shannon distance; short documents are guarded by minimum lengths. References come from all documents of the language
that pass the base rules and hold at most one symbol in 50 word characters, in one aggregation: character classes, and the
exact counts of all words (told apart by 64-bit hashes), of which the WORD_TOP most frequent are the language's common ones.
The references come from the corpus itself: where most documents of a language are junk that passes the base rules, junk is
the norm there.

Edge cases: null and empty texts have no words and fail the base rules. A null language is a language of its own (''),
that of all rows of a table without the column.
Texts under MIN_CHARS characters or MIN_WORDS words skip the comparison that needs them; very long texts are measured
whole. A language with no document that passes the base rules has no reference and rejects nothing. Words of equal counts
rank by their hashes. Repeated rows are judged row by row. An empty table gives an empty one. Extra columns are not read;
`keep` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ppm import Counter
from .scratch import small_batches
from .words import NOT_SPACE, chunks, hash_words, split_words, text_bytes, whole_windows, windows

MIN_RULE_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
MIN_CHARS, MIN_WORDS = 40, 20
WORD_TOP = 48
#: Largest Jensen-Shannon distance (base 2, 0 to 1) to the reference. Both rise for short texts by SLACK / sqrt(length).
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.14, 1.0
MAX_WORD_DISTANCE, WORD_SLACK = 0.45, 2.5

#: Character classes by byte: continuation bytes count nothing, so each character counts once.
#: Digits are left out: a number or an account in a text says nothing about its language.
CLASSES = ("lower", "upper", "space", "stop", "mark", "symbol", "beyond")
N_CLASSES, _NO_CLASS = len(CLASSES), len(CLASSES)
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[0x80:0xC0] = _NO_CLASS
_CLASS[:0x80] = 5
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = _NO_CLASS
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 2
_CLASS[[ord(c) for c in ".,;:"]] = 3
_CLASS[[ord(c) for c in "!?\"'()-"]] = 4

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_EDGE = np.zeros(256, dtype=bool)  # not part of a common word at its ends
_EDGE[[ord(c) for c in ".,;:!?\"'()|"]] = True

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def measure(raw: np.ndarray, off: np.ndarray, lines: bool = True) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(base columns, class histogram [rows, classes], word hashes, row of each word) of a chunk of texts; without lines,
    repeated ones are not counted."""
    n = len(off) - 1
    words = split_words(raw, off, NOT_SPACE)
    hashes = hash_words(raw, words)
    lead = (raw & 0xC0) != 0x80
    inside = NOT_SPACE[raw]
    n_words = np.diff(words.first)

    exact = hash_words(raw, words, fold=False)
    at = whole_windows(words, REPEAT_WINDOW)
    gram, doc = windows(exact, REPEAT_WINDOW)[at], words.doc[at]
    order = np.lexsort((gram, doc))
    g, d = gram[order], doc[order]
    same = np.zeros(len(g) + 1, dtype=bool)
    same[1:-1] = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    twice = at[order[same[:-1] | same[1:]]]
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT_WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0

    newline = _sums(raw == 10, off)
    dup = np.zeros(n, dtype=np.int64)
    for row in np.flatnonzero(newline) if lines else ():
        dup[row] = _dup_lines(raw[off[row] : off[row + 1]].tobytes().decode())
    base = {
        "n_words": n_words,
        "word_chars": _sums(inside & lead, off),
        "n_symbols": _sums(_SYMBOL[raw], off),
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(words.doc[repeated], minlength=n).astype(np.int64),
    }
    row_of = np.repeat(np.arange(n), np.diff(off))
    width = N_CLASSES + 1
    classes = np.bincount(row_of * width + _CLASS[raw], minlength=n * width).reshape(n, width)[:, :N_CLASSES]
    # a word's punctuation at its end is not part of a common word
    trimmed = words.ends - _EDGE[raw[words.ends - 1]] if len(words.ends) else words.ends
    trimmed = np.maximum(trimmed, words.starts + 1)
    bare = type(words)(words.starts, trimmed, words.doc, words.first)
    return base, classes, hash_words(raw, bare), words.doc


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_RULE_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])


def _each(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        langs = np.array([x or "" for x in batch.column(1).to_pylist()], dtype=object)
        raw, offsets = text_bytes(batch.column(2))
        for a, b in chunks(offsets):
            yield batch.column(0).slice(a, b - a), langs[a:b], raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


_CLASS_ROW, _WORD_ROW, _TOTAL_ROW = range(3)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one partition by language: of classes, of words, and of all words."""
    classes_of: dict[str, np.ndarray] = {}
    words_of: dict[str, Counter] = {}
    for _, langs, raw, off in _each(batches):
        base, classes, hashes, doc = measure(raw, off, lines=False)
        good = ~base_failed(base) & (base["n_symbols"] * 50 <= base["word_chars"])
        for lang in set(langs[good]):
            of = good & (langs == lang)
            classes_of[lang] = classes_of.get(lang, 0) + classes[of].sum(0)
            words_of.setdefault(lang, Counter()).add(hashes[of[doc]])
    for lang, counter in words_of.items():
        counter.merge()
        words, n = counter.keys[0].astype(np.int64), counter.counts[0]
        kinds = np.concatenate([np.full(N_CLASSES, _CLASS_ROW), np.full(len(words), _WORD_ROW), [_TOTAL_ROW]]).astype(np.int32)
        keys, counts = np.concatenate([np.arange(N_CLASSES), words, [0]]), np.concatenate([classes_of[lang], n, [n.sum()]])
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys[part])), pa.array(kinds[part]), pa.array(keys[part]), pa.array(counts[part])], names=["lang", "kind", "key", "n"])


def _lang(docs: DataFrame, lang_col: str):
    """The language column; a table without one is of one language."""
    return F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")


def references(docs: DataFrame, text_col="text", lang_col="lang", doc_col="doc_id") -> dict[str, dict]:
    """{language: {"classes": shares, "words": hashes of the common words, sorted, "shares": theirs and the rest's}}; of
    bounded size per language."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_col).alias("doc_id"), _lang(docs, lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_gather, "lang string, kind int, key long, n long")
    sums = rows.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    top = sums.withColumn("at", F.row_number().over(by)).where(F.col("at") <= WORD_TOP).select("lang", "kind", "key", "n").collect()
    out: dict[str, dict] = {}
    for lang in {r["lang"] for r in top}:
        own = {kind: {r["key"]: r["n"] for r in top if r["lang"] == lang and r["kind"] == kind} for kind in range(3)}
        classes = np.array([own[_CLASS_ROW].get(c, 0) for c in range(N_CLASSES)], dtype=float)
        words = np.sort(np.array(list(own[_WORD_ROW]), dtype=np.int64).astype(np.uint64))
        shares = np.array([own[_WORD_ROW][w] for w in words.astype(np.int64).tolist()]) / max(1, own[_TOTAL_ROW].get(0, 0))
        out[lang] = {"classes": classes / max(1.0, classes.sum()), "words": words, "shares": np.append(shares, max(0.0, 1 - shares.sum()))}
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def divergences(base, classes, hashes, doc, langs, refs) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the references; 0 where a guard or a missing reference skips the comparison."""
    n = len(langs)
    chars, word = np.zeros(n), np.zeros(n)
    n_chars = classes.sum(1)
    for lang in set(langs):
        ref = refs.get(lang)
        if ref is None:
            continue
        of = langs == lang
        rows = np.flatnonzero(of & (n_chars >= MIN_CHARS))
        if len(rows):
            chars[rows] = js_distance(classes[rows] / n_chars[rows, None], ref["classes"])
        rows = np.flatnonzero(of & (base["n_words"] >= MIN_WORDS))
        if len(rows):
            width, place = len(ref["words"]) + 1, np.full(n, -1)
            place[rows] = np.arange(len(rows))
            mine = place[doc] >= 0
            h = hashes[mine]
            slot = np.searchsorted(ref["words"], h)
            slot[ref["words"][np.minimum(slot, width - 2)] != h] = width - 1  # no common word
            hist = np.bincount(place[doc[mine]] * width + slot, minlength=len(rows) * width).reshape(len(rows), width)
            word[rows] = js_distance(hist / hist.sum(1, keepdims=True), ref["shares"])
    return chars, word


def accepted(base, classes, chars: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The method's verdict."""
    n_chars, n_words = np.maximum(classes.sum(1), 1), np.maximum(base["n_words"], 1)
    return (chars <= MAX_CHAR_DISTANCE + CHAR_SLACK / np.sqrt(n_chars)) & (word <= MAX_WORD_DISTANCE + WORD_SLACK / np.sqrt(n_words))


def _judge(refs):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, langs, raw, off in _each(batches):
            base, classes, hashes, doc = measure(raw, off)
            chars, word = divergences(base, classes, hashes, doc, langs, refs.value)
            failed = base_failed(base)
            kept = ~failed & accepted(base, classes, chars, word)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), *(pa.array(base[c]) for c in BASE_COLUMNS), pa.array(failed), pa.array(kept), pa.array(chars), pa.array(word)],
                names=["doc_id", *BASE_COLUMNS, "base_failed", "kept", "char_distance", "word_distance"],
            )

    return judge


_OUT = f"doc_id long, {', '.join(f'{c} long' for c in BASE_COLUMNS)}, base_failed boolean, kept boolean, char_distance double, word_distance double"


def judge(docs: DataFrame, text_col="text", lang_col="lang", doc_col="doc_id") -> DataFrame:
    """Per document: the base columns, base_failed, kept and both distances."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, text_col, lang_col, doc_col))
    return docs.select(F.col(doc_col).alias("doc_id"), _lang(docs, lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_judge(refs), _OUT)


def _keeper(refs, lang_at: int | None, text_at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None] * batch.num_rows if lang_at is None else batch.column(lang_at).to_pylist()
            langs = np.array([x or "" for x in own], dtype=object)
            raw, offsets = text_bytes(batch.column(text_at))
            for a, b in chunks(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                base, classes, hashes, doc = measure(part, off)
                chars, word = divergences(base, classes, hashes, doc, langs[a:b], refs.value)
                yield batch.slice(a, b - a).filter(pa.array(~base_failed(base) & accepted(base, classes, chars, word)))

    return keep


def keep(docs: DataFrame, text_col="text", lang_col="lang", doc_col="doc_id") -> DataFrame:
    """docs without the rejected rows, judged in place: no join, all columns stay."""
    refs = docs.sparkSession.sparkContext.broadcast(references(docs, text_col, lang_col, doc_col))
    return docs.mapInArrow(_keeper(refs, docs.columns.index(lang_col) if lang_col in docs.columns else None, docs.columns.index(text_col)), docs.schema)
