"""Language-model scoring: prediction by partial matching over bytes, and a unigram base model.

Training documents' byte contexts up to ORDER give a counting trie. A symbol not seen in a context escapes to the next
shorter one (method C: escapes count as often as distinct symbols), where the symbols of the longer context are excluded;
below order 0 all bytes not yet excluded are equally likely. The trie is pretrained: it scores every document, and code
lengths add up per document. Texts are lower-cased (A-Z); byte 0xFF, which no text holds, ends a text and pads its start.

Counts come from all training texts, in one aggregation that grows with them, and every symbol counts at every size. What
tasks get is bounded: the whole trie where it has at most TRIE_NODES symbols an order, else the exact scores of the most
frequent TRIE_NODES longest symbols. The other symbols of the documents are then scored by joins, each distinct one once
(`scores`): the trie is a table of symbols and a table of contexts for each order, and a symbol that its context does not
have asks the next shorter one. Keys are whole symbols, or contexts that at most 2^16 distinct askers share, so no task grows
with how often a symbol or an end of a context occurs. Word counts likewise: at most WORD_NODES words, those with at least
N / WORD_NODES occurrences, are broadcast; the other words of each document meet their exact counts in a join.

Edge cases: null and empty texts have one token, the end. Very long texts and words are read whole (words are told apart by
64-bit hashes). Grams of equal counts are all broadcast or all looked up. With no training document all counts are 0 and the base score
is log10(1) = 0 a token; the trie is empty and all bytes are equally likely. Repeated rows are scored each; an empty table
gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize, small_batches
from .words import _FOLD, chunks, hash_words, split_words, text_bytes

ORDER, TRIE_NODES, WORD_NODES = 4, 1 << 21, 1 << 22
_END = 0xFF
_FLUSH = 1 << 22


def _streams(raw: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams of order + 1 bytes, one a symbol; first gram of each text): texts, each with its end symbol."""
    lengths = np.diff(off)
    n = len(lengths)
    begin = off[:-1] + np.arange(n) * (order + 1) + order
    buf = np.full(len(raw) + n * (order + 1), _END, dtype=np.uint64)
    place = np.arange(len(raw)) + np.repeat(begin - off[:-1], lengths)
    buf[place] = _FOLD[raw]
    grams = np.zeros(max(0, len(buf) - order), dtype=np.uint64)
    for k in range(order + 1):
        grams |= buf[order - k : len(buf) - k] << np.uint64(8 * k)
    own = np.ones(len(grams), dtype=bool)  # windows whose last symbol pads a start do not count
    pads = (begin[:, None] - order + np.arange(order)[None, :]).ravel() - order
    own[pads[pads >= 0]] = False
    first = off[:-1] + np.arange(n)
    return grams[own], first


class Counter:
    """Exact counts of 64-bit keys."""

    def __init__(self):
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.waiting += len(k)
        if self.waiting > _FLUSH:
            self.merge()

    def merge(self) -> None:
        if not self.keys:
            self.keys, self.counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        k, at = np.unique(keys, return_inverse=True)
        self.keys, self.counts = [k], [np.bincount(at, weights=counts, minlength=len(k)).astype(np.int64)]
        self.waiting = 0


def _gatherer(order: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of one partition: kind 0 words, kind 1 grams, kind 2 (key 0) documents."""
        both, docs = (Counter(), Counter()), 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            docs += batch.num_rows
            for a, b in chunks(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                both[0].add(hash_words(part, split_words(part, off)))
                both[1].add(_streams(part, off, order)[0])
        for kind, counter in enumerate(both):
            counter.merge()
            k, c = counter.keys[0].astype(np.int64), counter.counts[0]
            for at in range(0, len(k), 1 << 16):
                part = k[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(c[at : at + (1 << 16)])], names=["kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"])

    return gather


class _Lookup:
    """key -> place in a sorted key table, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        todo, at = np.arange(len(keys), dtype=np.int32), self._hash(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places, -1 where absent."""
        out = np.full(len(keys), -1, dtype=np.int32)
        if not len(self.keys):
            return out
        at = self._hash(keys)
        got = self.slots[at]
        hit = self.keys[got] == keys  # an empty slot's -1 reads the last key; told apart below
        np.copyto(out, got, where=hit & (got >= 0))
        todo = np.flatnonzero(~hit & (got >= 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            hit = (got >= 0) & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            more = ~hit & (got >= 0)
            todo, at = todo[more], at[more]
        return out


class Trie:
    """levels: by order, (sorted grams, counts) of the kept symbols in contexts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.grams, self.fresh, self.log_count, self.nodes, self.escape, self.total, self.after_escape, self.after_total = ([] for _ in range(8))
        per_node: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (grams, counts) in enumerate(levels):
            ctx = grams >> np.uint64(8)
            node, at = np.unique(ctx, return_inverse=True)
            n, t = np.bincount(at, weights=counts, minlength=len(node)), np.bincount(at, minlength=len(node)).astype(float)
            self.grams.append(_Lookup(grams))
            self.nodes.append(_Lookup(node))
            with np.errstate(divide="ignore"):
                self.log_count.append(np.log10(counts.astype(float)))
                self.fresh.append(self.log_count[k] - np.log10(n + t)[at])
                self.escape.append(np.log10(t / (n + t)))
            per_node.append((n, t, at))
            if k:
                # from a node to its suffix: what stays there without the node's symbols
                up = self.nodes[k - 1].find(node & np.uint64((1 << (8 * (k - 1))) - 1))
                shorter = self.grams[k - 1].find(grams & np.uint64((1 << (8 * k)) - 1))
                taken = np.bincount(at, weights=levels[k - 1][1][shorter], minlength=len(node))
                left_n, left_t = per_node[k - 1][0][up] - taken, per_node[k - 1][1][up] - t
                some = left_t > 0
                total = np.where(some, left_n + left_t, 1.0)
                self.after_total.append(np.log10(total))
                self.after_escape.append(np.where(some, np.log10(np.where(some, left_t, 1.0) / total), 0.0))
            else:
                self.after_total.append(np.zeros(len(node)))
                self.after_escape.append(np.zeros(len(node)))
        used = len(levels[0][0])
        self.uniform = -np.log10(max(1, 256 - used))

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(grams))
        found = self.grams[self.order].find(grams)
        hit = found >= 0
        out[hit] = self.fresh[self.order][found[hit]]
        todo = np.flatnonzero(~hit)
        came = np.full(len(todo), -1, dtype=np.int64)  # the node one order up that was escaped from, -1: none yet
        for k in range(self.order, -1, -1):
            if not len(todo):
                return out
            g = grams[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            if k < self.order:
                found = self.grams[k].find(g)
                hit = found >= 0
                f, c = found[hit], came[hit]
                add = np.where(c < 0, self.fresh[k][f], self.log_count[k][f] - self.after_total[k + 1][c])
                out[todo[hit]] += add
                todo, came, g = todo[~hit], came[~hit], g[~hit]
            node = self.nodes[k].find(g >> np.uint64(8))
            exists = node >= 0
            if k < self.order:
                with_node = np.where(came < 0, self.escape[k][node] if len(self.escape[k]) else 0.0, self.after_escape[k + 1][came] if len(self.after_escape[k + 1]) else 0.0)
            else:
                with_node = self.escape[k][node] if len(self.escape[k]) else np.zeros(len(node))
            out[todo] += np.where(exists, with_node, 0.0)
            came = np.where(exists, node, -1)
        out[todo] += self.uniform
        return out


class _Known:
    """The exact scores of the most frequent longest grams; NaN for all others."""

    def __init__(self, grams: np.ndarray, scores: np.ndarray):
        self.grams, self.scores = _Lookup(grams), np.append(scores, np.nan)

    def score(self, grams: np.ndarray) -> np.ndarray:
        return self.scores[self.grams.find(grams)]  # absent is -1: the NaN


def _suffix_levels(grams: np.ndarray, counts: np.ndarray, orders) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order, (sorted grams, counts): each order's counts are sums over the longest grams."""
    levels = []
    for k in orders:
        g, at = np.unique(grams & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
        levels.append((g, np.bincount(at, weights=counts, minlength=len(g)).astype(np.int64)))
    return levels


def _scorer(model, words, order: int, end_count: int, tokens: int, vocabulary: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (whole, parts), (known, known_counts) = model.value, words.value
        trie, common = (Trie if whole else _Known)(*parts), _Lookup(known)
        scale = np.log10(tokens + 0.5 * (vocabulary + 1))
        log_known = np.log10(known_counts + 0.5)
        end = np.log10(end_count + 0.5) - scale
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                grams, first = _streams(part, off, order)
                scores = trie.score(grams)
                other = np.flatnonzero(np.isnan(scores))
                scores[other] = 0.0
                ppm = np.add.reduceat(scores, first) if len(first) else np.zeros(0)
                other_ends = np.searchsorted(other, np.append(first, len(grams))).astype(np.int32)
                w = split_words(part, off)
                h = hash_words(part, w)
                at = common.find(h)
                hit = at >= 0
                n = b - a
                n_words = np.diff(w.first)
                base = np.bincount(w.doc[hit], weights=log_known[at[hit]], minlength=n) - np.bincount(w.doc[hit], minlength=n) * scale + end
                rare = h[~hit].astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.bincount(w.doc[~hit], minlength=n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n).cast(pa.int64()), pa.array(n_words + 1),
                        pa.array(np.bincount(w.doc[hit], minlength=n).astype(np.int64) + int(end_count > 0)),
                        pa.array(base), pa.array(ppm), pa.ListArray.from_arrays(pa.array(ends), pa.array(rare)),
                        pa.ListArray.from_arrays(pa.array(other_ends), pa.array(grams[other].astype(np.int64))),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "other"],
                )

    return score


def _suffix(key, size: int):
    """The last size bytes."""
    return F.col(key).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def _tables(grams: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """By order, the symbols (g, n) and the contexts (ctx, n, t) of the trie; from order 1 on with rest_n and rest_t, what the
    next shorter context has without the context's own symbols. Each order's tables are sums over the next longer ones'."""
    symbols = [materialize(grams.select(F.col("key").alias("g"), "n"), "symbols")]
    for k in range(order - 1, -1, -1):
        symbols.insert(0, materialize(symbols[0].groupBy(_suffix("g", k + 1).alias("g")).agg(F.sum("n").alias("n")), "symbols"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, own in enumerate(symbols):
        contexts = own.groupBy(F.shiftrightunsigned("g", 8).alias("ctx")).agg(F.sum("n").alias("n"), F.count("*").alias("t"))
        if k:
            shorter, above = symbols[k - 1].select(F.col("g").alias("_g"), F.col("n").alias("_n")), out[k - 1][1].select(F.col("ctx").alias("_ctx"), F.col("n").alias("_n"), F.col("t").alias("_t"))
            taken = own.join(shorter, _suffix("g", k) == F.col("_g")).groupBy(F.shiftrightunsigned("g", 8).alias("_of")).agg(F.sum("_n").alias("taken"))
            contexts = contexts.join(taken, F.col("ctx") == F.col("_of")).join(above, _suffix("ctx", k - 1) == F.col("_ctx"))
            contexts = contexts.select("ctx", "n", "t", (F.col("_n") - F.col("taken")).alias("rest_n"), (F.col("_t") - F.col("t")).alias("rest_t"))
        out.append((own, materialize(contexts, "contexts")))
    return out


def scores(grams: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, p): log10 probability of the last byte of each distinct asked symbol (key: order + 1 bytes) after the others.
    grams: (key, n), the training symbols.

    Going down an order, askers become the distinct symbols of one byte less, with the context that they escaped from in front;
    going up again, each adds what its own escape costs."""
    trie = _tables(grams, order)
    known = grams.select(_suffix("key", 1).alias("g")).distinct().count()  # at most 256
    waiting = asked.select(F.col("key").alias("w")).distinct()
    levels = []
    for k in range(order, -1, -1):
        symbols, contexts = trie[k]
        rows = waiting.withColumn("g", _suffix("w", k + 1)).withColumn("ctx", F.shiftrightunsigned("g", 8))
        rows = rows.join(symbols.select("g", F.col("n").alias("c")), "g", "left").join(contexts.select("ctx", "n", "t"), "ctx", "left")
        fresh, escape = F.log10("c") - F.log10(F.col("n") + F.col("t")), F.log10("t") - F.log10(F.col("n") + F.col("t"))
        if k < order:
            came = trie[k + 1][1].select(F.col("ctx").alias("_from"), "rest_n", "rest_t")
            rows = rows.join(came, F.shiftrightunsigned("w", 8) == F.col("_from"), "left")
            some = F.col("rest_t") > 0
            total = F.when(some, F.log10(F.col("rest_n") + F.col("rest_t"))).otherwise(0.0)
            fresh = F.when(F.col("_from").isNull(), fresh).otherwise(F.log10("c") - total)
            escape = F.when(F.col("_from").isNull(), escape).otherwise(F.when(some, F.log10("rest_t") - total).otherwise(0.0))
        done = F.col("c").isNotNull()
        cost = F.when(done, fresh).otherwise(F.when(F.col("n").isNotNull(), escape).otherwise(0.0))
        levels.append(materialize(rows.select("w", "g", done.alias("done"), cost.alias("cost")), "asked"))
        waiting = levels[-1].where("NOT done").select(F.col("g").alias("w")).distinct()
    below = None
    for rows in reversed(levels):
        if below is None:
            p = F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") + F.lit(-float(np.log10(max(1, 256 - known)))))
            below = rows.select("w", p.alias("p"))
        else:
            below = rows.join(below.select(F.col("w").alias("_w"), F.col("p").alias("_p")), (F.col("g") == F.col("_w")) & ~F.col("done"), "left").select("w", (F.col("cost") + F.coalesce("_p", F.lit(0.0))).alias("p"))
    out = materialize(below.select(F.col("w").alias("key"), "p"), "gram-scores")
    for table in [*levels, *(t for pair in trie for t in pair)]:
        drop(table)
    return out


def _counted(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = grams.select("key", "n").toArrow()
    return got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy()


def _least(grams: DataFrame, most: int) -> int:
    """A count that at most `most` grams reach, out of eight steps a power of two."""
    steps = grams.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("v"), F.max("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, seen = (steps[0]["n"] + 1 if steps else 1), 0
    for r in steps:
        seen += r["v"]
        if seen > most:
            break
        least = r["least"]
    return least


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1


def score(docs: DataFrame, doc_col="doc_id", text_col="text", order: int = ORDER, held_out=_held_out) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from rows not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = rows.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text")
    counts = materialize(train.mapInArrow(_gatherer(order), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n_docs = sums[2]["n"] if 2 in sums else 0
    tokens = (sums[0]["n"] if 0 in sums else 0) + n_docs
    vocabulary = (sums[0]["v"] if 0 in sums else 0) + int(n_docs > 0)
    least_word = -(-tokens // WORD_NODES) or 1

    grams = counts.where("kind = 1").select("key", "n")
    distinct = sums[1]["v"] if 1 in sums else 0
    whole = distinct <= TRIE_NODES  # shorter contexts never have more symbols
    if whole:
        model = (_suffix_levels(*_counted(grams), range(order + 1)),)
    else:
        # a gram seen in the longest context needs only that context's totals: n / (occurrences + distinct symbols)
        node = F.shiftrightunsigned("key", 8)
        totals = grams.groupBy(node.alias("node")).agg((F.sum("n") + F.count("*")).alias("total"))
        frequent = grams.where(F.col("n") >= _least(grams, TRIE_NODES)).withColumn("node", node).join(totals, "node")
        known = frequent.select("key", (F.log10("n") - F.log10("total")).alias("p")).toArrow()
        model = (known.column(0).to_numpy().astype(np.uint64), known.column(1).to_numpy())
    common = counts.where((F.col("kind") == 0) & (F.col("n") >= least_word)).select("key", "n").toArrow()
    words = (common.column(0).to_numpy().astype(np.uint64), common.column(1).to_numpy().astype(np.int64))

    broadcast = spark.sparkContext.broadcast
    scored = rows.mapInArrow(_scorer(broadcast((whole, model)), broadcast(words), order, n_docs, tokens, vocabulary), "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, other array<long>")
    scored = materialize(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    rare_counts = counts.where((F.col("kind") == 0) & (F.col("n") < least_word)).select(F.col("key").alias("h"), "n")
    scale = float(np.log10(tokens + 0.5 * (vocabulary + 1)))
    uncommon = scored.select("uid", F.explode("rare").alias("h")).join(rare_counts, "h", "left")
    more = uncommon.groupBy("uid").agg(F.count("n").alias("k"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5) - scale).alias("s"))
    if whole:
        scored = scored.withColumn("by_block", F.lit(0.0))
    else:
        # rows sum up by document and symbol before they meet the scores, by the whole symbol
        each = scored.select("uid", F.explode("other").alias("key")).groupBy("uid", "key").agg(F.count("*").alias("n"))
        exact = scores(grams, scored.select(F.explode("other").alias("key")), order)
        sums_of = each.join(exact, "key").groupBy("uid").agg(F.sum(F.col("p") * F.col("n")).alias("by_block"))
        scored = scored.join(sums_of, "uid", "left")
    return scored.join(more, "uid", "left").select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("s", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("by_block", F.lit(0.0))).alias("score"),
    )
