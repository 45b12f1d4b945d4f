"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice holds every way to cut it into the vocabulary's pieces. No piece crosses the start of a word (a run of
spaces and what follows it), so the lattice is a chain of word lattices; each distinct word's is built by a walk of the
piece trie and kept by the worker, up to CACHE_CHARS characters of them. A piece weighs -log(rank + RANK_SHIFT), its probability under Zipf's law (the vocabulary is a
merge list, whose scores are ranks); characters without a piece fall back to their bytes.

Sampling is a perturbed A* search. The root's Gumbel value goes to a path drawn piece by piece; what lies off the path at
each word is one branch, whose value is a Gumbel of the branch's mass truncated at the path's. The branch with the largest
value gives the next path (its first word drawn among the segmentations not excluded yet, the words after it afresh), and
so on: the first k paths are k distinct segmentations sampled without replacement. The next branch's value is the threshold
of the inclusion scores. All random numbers are hashes of (seed, row key, place), so results depend on nothing else.

Edge cases: null and empty texts have one segmentation, of no pieces, with score 1. A text with fewer segmentations than k
emits them all, with score 1. Repeated keys with equal texts get equal samples; a null key draws as key 0 and stays null.
Very long texts and words are sampled whole. An empty table gives no rows. U+2581 in a text decodes to a space. Other
columns are not read; `decode` passes them on and replaces one that has the name of its output.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches
from .words import mix, place_weights

SAMPLES, SEED, RANK_SHIFT, CHUNK_CHARS = 2, 13, 10.0, 1 << 20
#: Characters of distinct words whose lattices a worker keeps (about 60 bytes each).
CACHE_CHARS = 1 << 21
_SPACE = 0x2581
_INF = float("inf")
#: Mass off a word's path below which it is summed piece by piece, as rounding would blur 1 - exp(log_p).
_NEAR = 1e-4
#: Words of more characters (or pieces) are drawn one by one.
_LONG_PATH = 512
#: Log mass by which a branch must trail to be left out of the search: Gumbel noise in double precision spans less.
_FAR = 80.0


def _uniform(*parts) -> np.ndarray:
    """Uniform numbers in (0, 1) from a hash of integers (arrays broadcast)."""
    with np.errstate(over="ignore"):
        h = np.uint64(0x243F6A8885A308D3)
        for p in parts:
            h = mix(np.asarray(h + np.asarray(p).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Vocabulary:
    """The pieces of a SentencePiece model as a trie in hash form."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.sp, self.sp.get_piece_size()
        self.piece_bytes = [b""] * n
        self.byte_ids = np.zeros(256, dtype=np.int32)
        nodes: dict[tuple[int, int], int] = {}
        self.piece_at: list[int] = [-1]
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.byte_ids[value], self.piece_bytes[i] = i, bytes([value])
                continue
            self.piece_bytes[i] = text.replace("▁", " ").encode()
            if "▁" in text.lstrip("▁"):
                continue  # would cross the start of a word
            node = 0
            for c in text:
                key = (node, ord(c))
                if key not in nodes:
                    nodes[key] = len(self.piece_at)
                    self.piece_at.append(-1)
                node = nodes[key]
            self.piece_at[node] = i
        self.piece_at = np.array(self.piece_at, dtype=np.int32)
        rank = np.array([max(0.0, -sp.get_score(i)) for i in range(n)])
        self.weight = -np.log(rank + RANK_SHIFT)
        self.byte_weight = -np.log(n + RANK_SHIFT) - 1.0
        keys = np.array([(a << 21) | c for a, c in nodes], dtype=np.uint64)
        order = np.argsort(keys)
        from .ppm import _Lookup

        self.edges, self.targets = _Lookup(keys[order]), np.array(list(nodes.values()), dtype=np.int64)[order]
        self.lattices = _Lattices(self)
        self.flat = np.frombuffer(b"".join(self.piece_bytes), dtype=np.uint8)
        self.sizes = np.array([len(b) for b in self.piece_bytes])
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of a run of ids, place behind the bytes of each id)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))], ends


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class _Lattices:
    """The lattices of distinct words: rows are the ends after each character (word by word), edges the pieces that end there.

    edge_of has the first edge of each row; a row's edges go from the longest piece to the shortest. A store that a worker
    keeps over its batches, as a word's lattice depends on the word alone; beyond CACHE_CHARS characters it is dropped
    before the next chunk.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self, salt: int = 77) -> None:
        self.n_chars = self.n_edges = 0
        self.salt = salt
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.off_whole = np.zeros(0)  # by word: log mass of the segmentations of more than one piece
        self.chars, self.edge_of = np.zeros(0, np.uint32), np.zeros(1, np.int32)
        self.piece, self.size = np.zeros(0, np.int32), np.zeros(0, np.int16)  # by edge: id (-2: bytes), characters
        self.log_p, self.cum = np.zeros(0, np.float32), np.zeros(0, np.float32)  # log probability given the end; running sums
        self.rests: dict[tuple, float] = {}

    def words(self, cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The place in the store of each word occurrence; new words are added. Equal places are equal words: every
        occurrence is compared with the stored characters, and a collision of hashes starts the store anew with others."""
        if not len(starts):
            return np.zeros(0, np.int64)
        if self.n_chars > CACHE_CHARS or len(self.rests) > CACHE_CHARS // 8:
            self.clear(self.salt)
        place = np.arange(len(cps)) - np.repeat(starts, lengths)
        while True:
            values = mix(cps.astype(np.uint64) + np.uint64(self.salt)) * place_weights(place, int(lengths.max()))
            h, pick, back = np.unique(mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64)), return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, h)
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
            index = np.zeros(len(h), np.int64)
            index[known] = self.order[at[known]]
            index[~known] = len(self.first) + np.arange(int((~known).sum()))
            new = pick[~known]
            self._add(cps, starts[new], lengths[new])
            self.hashes = np.insert(self.hashes, at[~known], h[~known])
            self.order = np.insert(self.order, at[~known], index[~known])
            word = index[back]
            if (self.lengths[word] == lengths).all() and (self.chars[np.repeat(self.first[word] - starts, lengths) + np.arange(len(cps))] == cps).all():
                return word
            self.clear(self.salt + 1)

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        old = getattr(self, name)
        if used + len(values) > len(old):
            new = np.zeros(max(len(old) * 3 // 2, used + len(values), 1 << 16), old.dtype)
            new[:used] = old[:used]
            setattr(self, name, new)
        getattr(self, name)[used : used + len(values)] = values

    def _add(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        n, vocab = int(lengths.sum()), self.vocab
        if not n:
            return
        first = np.cumsum(lengths) - lengths
        row = np.arange(n)
        place = row - np.repeat(first, lengths)
        cps = text[np.repeat(starts, lengths) + place]
        # edges by a walk of the piece trie from every character: (row, piece, which of its row) by size
        left = np.repeat(lengths, lengths) - place
        found, taken = [], np.zeros(n, dtype=np.int32)
        start, node, size = row, np.zeros(n, dtype=np.int64), 0
        while len(start):
            at = vocab.edges.find((node.astype(np.uint64) << np.uint64(21)) | cps[start + size].astype(np.uint64))
            start, node, size = start[at >= 0], vocab.targets[at[at >= 0]], size + 1
            piece = vocab.piece_at[node]
            of = piece >= 0
            end = start[of] + size - 1
            if size == 1:  # a character without a piece is its bytes
                bare = np.ones(n, dtype=bool)
                bare[end] = False
                bare = np.flatnonzero(bare)
                end, piece, of = np.concatenate([end, bare]), np.concatenate([piece[of], np.full(len(bare), -2, np.int32)]), slice(None)
            found.append((end, piece[of], taken[end], size))
            taken[end] += 1
            inside = left[start] > size
            start, node = start[inside], node[inside]
        # the rows by place, then by word from the longest to the shortest: those of one place lie together
        rank = np.empty(len(lengths), np.int64)
        rank[np.argsort(-lengths, kind="stable")] = np.arange(len(lengths))
        level = np.concatenate(([0], np.cumsum(np.bincount(place))))
        by_level = level[place] + np.repeat(rank, lengths)
        counts = np.empty(n, np.int64)
        counts[by_level] = taken
        begin = np.concatenate(([0], np.cumsum(counts)))
        n_edges = int(begin[-1])
        weight, source, sizes, pieces, home = np.empty(n_edges), np.empty(n_edges, np.int64), np.empty(n_edges, np.int16), np.empty(n_edges, np.int32), np.empty(n_edges, np.int64)
        edge_of = np.cumsum(taken) - taken
        for end, piece, which, size in found:
            at = begin[by_level[end]] + which
            before = place[end] - size
            sizes[at], pieces[at] = size, piece
            source[at] = np.where(before >= 0, by_level[end - np.minimum(size, place[end])], n)
            weight[at] = vocab.weight[piece]
            home[at] = edge_of[end] + taken[end] - 1 - which
        bare = np.flatnonzero(pieces == -2)
        if len(bare):
            cp = np.empty(n, np.uint32)
            cp[by_level] = cps
            weight[bare] = vocab.byte_weight * _utf8_sizes(cp[np.searchsorted(begin, bare, side="right") - 1])
        alpha = np.zeros(n + 1)  # the last entry is a word's start
        log_p = np.empty(n_edges)
        for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            x, y = begin[a], begin[b]
            score = weight[x:y] + alpha[source[x:y]]
            top = np.maximum.reduceat(score, begin[a:b] - x)
            alpha[a:b] = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, counts[a:b])), begin[a:b] - x))
            log_p[x:y] = score - np.repeat(alpha[a:b], counts[a:b])
        # edges word by word, the longest of a row first; running sums end with 1
        out, out_size, out_piece = np.empty(n_edges), np.empty(n_edges, np.int16), np.empty(n_edges, np.int32)
        out[home], out_size[home], out_piece[home] = log_p, sizes, pieces
        p = np.exp(out)
        last = edge_of + taken - 1
        total = p.copy()
        for j in range(1, int(taken.max())):
            at = edge_of[taken > j] + j
            total[at] += total[at - 1]
        total /= np.repeat(total[last], taken)
        ends = first + lengths - 1
        head = edge_of[ends]  # the longest piece of a word's last row
        others = _tail_sums(p, head + (out_size[head] == lengths), head + taken[ends])
        with np.errstate(divide="ignore"):
            self.off_whole = np.concatenate([self.off_whole, np.log(others)])
        self._append("chars", self.n_chars, cps)
        self._append("edge_of", self.n_chars, np.append(edge_of, n_edges) + self.n_edges)
        for name, values in (("piece", out_piece), ("size", out_size), ("log_p", out), ("cum", total)):
            self._append(name, self.n_edges, values)
        self.first, self.lengths = np.concatenate([self.first, first + self.n_chars]), np.concatenate([self.lengths, lengths])
        self.n_chars, self.n_edges = self.n_chars + n, self.n_edges + n_edges

    def last_row(self, word):
        return self.first[word] + self.lengths[word] - 1

    def draw(self, word: np.ndarray, base: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One segmentation of each word occurrence, from its base random number: (log probability, first edge of each, edges in
        the order of the text)."""
        n = len(word)
        log_p, steps = np.zeros(n), np.zeros(n, dtype=np.int64)
        active, end, begin = np.arange(n), self.last_row(word), self.first[word]
        records, step = [], 0
        while len(active):
            h = mix(base + np.uint64((sample * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F) % (1 << 64)))
            u = (((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))).astype(np.float32)
            edge = self.edge_of.take(end)
            miss = np.flatnonzero(self.cum.take(edge) < u)
            while len(miss):
                edge[miss] += 1
                miss = miss[self.cum.take(edge[miss]) < u[miss]]
            log_p[active] += self.log_p.take(edge)
            steps[active] += 1
            records.append((active, edge))
            end = end - self.size.take(edge)
            more = np.flatnonzero(end >= begin)
            active, end, begin, base, step = active[more], end[more], begin[more], base[more], step + 1
        first = np.concatenate(([0], np.cumsum(steps)))
        flat, last = np.zeros(first[-1], dtype=np.int32), first[1:] - 1
        for s, (rows, edge) in enumerate(records):
            flat[last[rows] - s] = edge
        return log_p, first, flat

    def ids(self, first: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id of each word, ids) of a draw; characters without a piece become their bytes."""
        piece = self.piece.take(flat)
        bare = np.flatnonzero(piece == -2)
        if not len(bare):
            return first, piece
        cp = self.chars[np.searchsorted(self.edge_of[: self.n_chars], flat[bare], side="right") - 1].astype(np.int64)
        size = _utf8_sizes(cp)
        count = np.ones(len(piece), dtype=np.int64)
        count[bare] = size
        start = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(start[-1], dtype=np.int32)
        out[start[:-1]] = piece
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for i in range(4):  # the i-th byte of the characters that have it
            has = size > i
            value = cp[has] >> (6 * (size[has] - 1 - i))
            out[start[bare[has]] + i] = self.vocab.byte_ids[value & 0x3F | 0x80 if i else value | lead[size[has]]]
        return start[first], out

    def _row(self, row: int) -> tuple[int, np.ndarray]:
        """(first edge, probabilities of the edges) of a row."""
        a, b = int(self.edge_of[row]), int(self.edge_of[row + 1])
        return a, np.exp(self.log_p[a:b].astype(np.float64))

    def off_paths(self, word: int, excluded: list[list[int]]):
        """What is left of one word beside the excluded segmentations (edges from the last to the first).

        Returns the tree of their beginnings (node 0: none drawn yet), as children by edge, and each node's mass off them,
        given that it was reached: a sum of positive terms, so exact to rounding however small, and 0 only where no other
        segmentation exists.
        """
        children: list[dict[int, int]] = [{}]
        rows = [int(self.last_row(word))]
        for path in excluded:
            at = 0
            for edge in path:
                if edge not in children[at]:
                    children[at][edge] = len(children)
                    children.append({})
                    rows.append(rows[at] - int(self.size[edge]))
                at = children[at][edge]
        rest, first = [0.0] * len(children), int(self.first[word])
        for at in range(len(children) - 1, -1, -1):
            if rows[at] >= first:
                a, p = self._row(rows[at])
                for edge, to in children[at].items():
                    p[edge - a] *= rest[to]
                rest[at] = float(p.sum())
        return children, rest

    def off_mass(self, word: int, *paths: list[int]) -> float:
        """Log mass off some segmentations of a word; that off a single one is kept for the word's other occurrences."""
        key = tuple(paths[0]) if len(paths) == 1 else None
        if key in self.rests:
            return self.rests[key]
        mass = self.off_paths(word, list(paths))[1][0]
        found = float(np.log(mass)) if mass > 0 else -_INF
        if key is not None:
            self.rests[key] = found
        return found

    def draw_other(self, word: int, excluded: list[list[int]], uniform) -> list[int]:
        """A segmentation of one word (edges from the last to the first) off some, of which there is one."""
        children, rest = self.off_paths(word, excluded)
        row, out, at = int(self.last_row(word)), [], 0
        while row >= self.first[word]:
            a, p = self._row(row)
            for edge, to in (children[at] if at >= 0 else {}).items():
                p[edge - a] *= rest[to]
            total = np.cumsum(p)
            edge = a + int((total < uniform(len(out)) * total[-1]).sum())
            out.append(edge)
            at = children[at].get(edge, -1) if at >= 0 else -1
            row -= int(self.size[edge])
        return out

    def draw_others(self, words: np.ndarray, paths: list[list[int]], uniform) -> list[list[int]]:
        """draw_other for many words, with one excluded segmentation each, all at once."""
        n, steps = len(words), np.array([len(p) for p in paths])
        edges = np.zeros((n, int(steps.max())), dtype=np.int64)
        for i, p in enumerate(paths):
            edges[i, : len(p)] = p

        def masses(row: np.ndarray, hit: np.ndarray, edge: np.ndarray, rest: np.ndarray):
            """(first edges, probabilities by edge of each row); those of edge count rest times, where hit."""
            a, b = self.edge_of[row], self.edge_of[row + 1]
            at = a[:, None] + np.arange(int((b - a).max()))
            p = np.where(at < b[:, None], np.exp(self.log_p[np.minimum(at, self.n_edges - 1)].astype(np.float64)), 0.0)
            p[hit, edge[hit] - a[hit]] *= rest[hit]
            return a, p

        sizes = self.size[edges].astype(np.int64)
        rows_of = self.last_row(words)[:, None] - np.cumsum(sizes, axis=1) + sizes
        rest = np.zeros((n, edges.shape[1] + 1))
        for s in range(edges.shape[1] - 1, -1, -1):
            at = np.flatnonzero(steps > s)
            rest[at, s] = masses(rows_of[at, s], np.ones(len(at), dtype=bool), edges[at, s], rest[at, s + 1])[1].sum(1)
        out: list[list[int]] = [[] for _ in range(n)]
        who, on, row, s = np.arange(n), np.ones(n, dtype=bool), self.last_row(words), 0
        while len(who):
            on = on & (steps[who] > s)
            own = edges[who, s] if s < edges.shape[1] else np.zeros(len(who), np.int64)
            a, p = masses(row, on, own, rest[who, min(s + 1, edges.shape[1])])
            total = np.cumsum(p, axis=1)
            edge = a + (total < (uniform(who, s) * total[:, -1])[:, None]).sum(1)
            for i, e in zip(who.tolist(), edge.tolist(), strict=True):
                out[i].append(e)
            on = on & (edge == own)
            row = row - self.size[edge]
            more = row >= self.first[words[who]]
            who, on, row, s = who[more], on[more], row[more], s + 1
        return out


def _utf8_sizes(cps: np.ndarray) -> np.ndarray:
    return 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)


def _tail_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of short runs of values, each added from its first to its last."""
    out = np.zeros(len(begin))
    for j in range(int((end - begin).max(initial=0))):
        of = np.flatnonzero(begin + j < end)
        out[of] += values[begin[of] + j]
    return out


class _Path:
    """One segmentation of a text: its parts, and the branches off it.

    parts: (draw, from word, to word), or (None, word, edges from the last) for a word of its own. The branches are those of the
    words from start on; those under exp(-_FAR) of the first cannot come before it and are left out.
    """

    __slots__ = ("parts", "log_p", "value", "start", "excluded", "before", "values", "best", "at")

    def __init__(self, parts, log_p: float, value: float, start: int, excluded: list[list[int]]):
        self.parts, self.log_p, self.value, self.start, self.excluded = parts, log_p, value, start, excluded

    def branch(self, before: np.ndarray, values: np.ndarray) -> None:
        self.before, self.values = before, values
        self.choose()

    def choose(self) -> None:
        self.at = int(np.argmax(self.values)) if len(self.values) else -1
        self.best = float(self.values[self.at]) if self.at >= 0 else -_INF

    def head(self, upto: int) -> list:
        """The parts before a word."""
        return [(d, a, b) if d is None else (d, a, min(b, upto)) for d, a, b in self.parts if a < upto]


class _Sampler:
    """The search over all texts of a chunk: round n gives each text its path n, which takes draw n for the words after its
    branch, so no two paths share random numbers there."""

    def __init__(self, lat: _Lattices, keys: np.ndarray, word: np.ndarray, first_word: np.ndarray, k: int, seed: int):
        self.lat, self.keys, self.word, self.first_word, self.k, self.seed = lat, keys, word, first_word, k, seed
        n_words = np.diff(first_word)
        at = (np.arange(len(word)) - np.repeat(first_word[:-1], n_words)).astype(np.uint64)
        base = mix(mix(np.repeat(keys, n_words) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))) + at)
        self.draws = [lat.draw(word, base, s) for s in range(k)]
        self.ids = [lat.ids(d[1], d[2]) for d in self.draws]
        self.paths: list[list[_Path]] = [[] for _ in range(len(keys))]

    def run(self) -> list[float]:
        """Fills paths; returns the thresholds: the largest branch value left of each text."""
        texts = np.flatnonzero(np.diff(self.first_word))
        value = -np.log(-np.log(_uniform(self.seed, self.keys, 1 << 40)))
        for i in texts.tolist():
            lo, hi = int(self.first_word[i]), int(self.first_word[i + 1])
            self.paths[i].append(_Path([(0, lo, hi)], float(self.draws[0][0][lo:hi].sum()), float(value[i]), lo, []))
        self._branches(texts, np.zeros(len(texts)), None)
        for number in range(1, self.k):
            todo = texts
            added = []
            while len(todo):
                picked = [(i, p) for i in todo.tolist() if (p := max(self.paths[i], key=lambda p: p.best)).best > -_INF]
                if not picked:
                    break
                added += self._extend(picked, number)
                todo = np.array([i for i, _ in picked if len(self.paths[i]) == number])
            if not added:
                break
            self._branches(np.array([i for i, _, _ in added]), np.array([b for _, b, _ in added]), np.array([lp for _, _, lp in added]))
        return [max((p.best for p in paths), default=-_INF) for paths in self.paths]

    def _edges(self, path: _Path, w: int) -> list[int]:
        """A word's edges in a path, the last first."""
        for d, a, b in path.parts:
            if d is None and a == w:
                return b
            if d is not None and a <= w < b:
                _, first, flat = self.draws[d]
                return flat[first[w] : first[w + 1]][::-1].tolist()
        raise IndexError(w)

    def _extend(self, picked: list[tuple[int, _Path]], number: int) -> list[tuple[int, float, float]]:
        """Adds a path to each text from its path's best branch. Returns (text, log mass before the branch, log probability of
        the branch's word); a branch without another segmentation is struck off instead."""
        jobs = []
        for i, p in picked:
            w, value, before = p.start + p.at, p.best, float(p.before[p.at])
            excluded = p.excluded if p.at == 0 and p.excluded else [self._edges(p, w)]
            p.values[p.at] = -_INF
            p.choose()
            if len(excluded) == 1 or self.lat.off_mass(int(self.word[w]), *excluded) > -_INF:
                jobs.append((i, p, w, value, before, excluded))
        one = [j for j, job in enumerate(jobs) if len(job[5]) == 1 and len(job[5][0]) <= _LONG_PATH and self.lat.lengths[self.word[job[2]]] <= _LONG_PATH]
        others: dict[int, list[int]] = {}
        if one:
            keys = self.keys[[jobs[j][0] for j in one]]
            words = self.word[[jobs[j][2] for j in one]]
            drawn = self.lat.draw_others(words, [jobs[j][5][0] for j in one], lambda rows, s: _uniform(self.seed, keys[rows], (1 << 42) + number, s))
            others = dict(zip(one, drawn, strict=True))
        added = []
        for j, (i, p, w, value, before, excluded) in enumerate(jobs):
            key = self.keys[i]
            edges = others[j] if j in others else self.lat.draw_other(int(self.word[w]), excluded, lambda s, key=key: float(_uniform(self.seed, key, (1 << 42) + number, s)))
            lp, hi = sum(self.lat.log_p[edges].tolist()), int(self.first_word[i + 1])
            log_p = before + lp + float(self.draws[number][0][w + 1 : hi].sum())
            self.paths[i].append(_Path([*p.head(w), (None, w, edges), (number, w + 1, hi)], log_p, value, w, [*excluded, edges]))
            added.append((i, before, lp))
        return added

    def _branches(self, texts: np.ndarray, base: np.ndarray, own: np.ndarray | None) -> None:
        """The branch values of the newest path of each text. base: log mass before its first branch; own: log probability of
        the branch's word, where the path has one."""
        todo, n_columns = np.arange(len(texts)), 64
        while len(todo):
            newest = [self.paths[i][-1] for i in texts[todo].tolist()]
            number = len(self.paths[int(texts[todo[0]])]) - 1
            start, hi = np.array([p.start for p in newest]), self.first_word[texts[todo] + 1]
            place = start[:, None] + np.arange(n_columns)
            inside = place < hi[:, None]
            p = np.where(inside, self.draws[number][0].take(np.minimum(place, len(self.word) - 1)), 0.0)
            if own is not None:
                p[:, 0] = own[todo]
            total = np.cumsum(p, axis=1)
            before = np.concatenate([np.zeros((len(todo), 1)), total[:, :-1]], axis=1)
            size = (inside & (before >= -_FAR)).sum(1)
            done = (size < n_columns) | (start + n_columns >= hi)
            rows = np.flatnonzero(done)
            width = int(size[rows].max(initial=0))
            p, before, inside = p[rows, :width], before[rows, :width] + base[todo[rows]][:, None], np.arange(width) < size[rows][:, None]
            with np.errstate(divide="ignore"):
                rest = np.log(-np.expm1(np.minimum(p, 0.0)))
            near = np.argwhere((p > -_NEAR) & inside if own is None else ((p > -_NEAR) | (np.arange(width) == 0)) & inside)
            w = place[rows[near[:, 0]], near[:, 1]]
            first = self.draws[number][1]
            whole = (first[w + 1] - first[w] == 1) & ((near[:, 1] > 0) | (own is None))
            rest[near[whole, 0], near[whole, 1]] = self.lat.off_whole[self.word[w[whole]]]
            for r, c in near[~whole].tolist():
                path = newest[rows[r]]
                paths = path.excluded if path.excluded and c == 0 else [self._edges(path, path.start + c)]
                rest[r, c] = self.lat.off_mass(int(self.word[path.start + c]), *paths)
            of = texts[todo[rows]]
            u = _uniform(self.seed, self.keys[of][:, None], (1 << 41) + number, place[rows, :width] - self.first_word[of][:, None])
            bound = np.array([newest[r].value for r in rows.tolist()])[:, None]
            values = np.where(inside, _truncated(before + rest, bound, u), -_INF)
            for r, row in enumerate(rows.tolist()):
                newest[row].branch(before[r, : size[row]], values[r, : size[row]])
            todo, n_columns = todo[~done], 4 * n_columns

    def ids_of(self, path: _Path) -> np.ndarray:
        out = []
        for d, a, b in path.parts:
            if d is not None:
                first, flat = self.ids[d]
                out.append(flat[first[a] : first[b]])
                continue
            out.append(self.lat.ids(np.array([0, len(b)]), np.array(b[::-1]))[1])
        return np.concatenate(out) if len(out) > 1 else out[0]


def _truncated(phi: np.ndarray, bound, u: np.ndarray) -> np.ndarray:
    """Gumbel values of location phi, given that they are below bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.log(np.exp(-bound) - np.log(u) * np.exp(-phi))


def sample_texts(vocab: Vocabulary, keys: list[int], texts: list[str], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its sampled segmentations: (ids, log probability, inclusion score), the largest Gumbel value first."""
    full = ["" if not t else "▁" + t.replace(" ", "▁") for t in texts]
    cps = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.concatenate(([0], np.cumsum([len(t) for t in full]))).astype(np.int64)
    edge = np.zeros(len(cps) + 1, dtype=bool)
    edge[begin] = True
    space = cps == _SPACE
    starts = np.flatnonzero(edge[:-1] | (space & ~np.concatenate(([False], space[:-1]))))
    lengths = np.diff(np.concatenate([starts, [len(cps)]]))
    word = vocab.lattices.words(cps, starts, lengths)
    sampler = _Sampler(vocab.lattices, np.array(keys, dtype=np.int64).astype(np.uint64), word, np.searchsorted(starts, begin), k, seed)
    out = []
    for paths, threshold in zip(sampler.paths, sampler.run(), strict=True):
        score = [1.0 if threshold == -_INF else float(-np.expm1(-np.exp(min(p.log_p - threshold, 700.0)))) for p in paths]
        out.append([(sampler.ids_of(p), p.log_p, s) for p, s in zip(paths, score, strict=True)] or [(np.zeros(0, np.int32), 0.0, 1.0)])
    return out


def decode_ids(vocab: Vocabulary, ids) -> str:
    text = b"".join(map(vocab.piece_bytes.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _sampled(path: str, k: int, seed: int, digest: bool):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        """Rows of about CHUNK_CHARS characters, of one batch or several."""
        keys, texts, n = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text or "")
                n += len(texts[-1])
                if n >= CHUNK_CHARS:
                    yield keys, texts
                    keys, texts, n = [], [], 0
        if keys:
            yield keys, texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for keys, texts in chunks(batches):
            rows = sample_texts(vocab, [0 if x is None else x for x in keys], texts, k, seed)
            flat = [(i, place, *r) for i, row in enumerate(rows) for place, r in enumerate(row)]
            ids = np.concatenate([r[2] for r in flat])
            ends = np.concatenate(([0], np.cumsum([len(r[2]) for r in flat])))
            columns = [pa.array([keys[r[0]] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.int32())]
            names = ["doc_id", "sample"]
            if digest:
                raw, upto = vocab.bytes_of(ids)
                upto = np.concatenate(([0], upto))[ends]
                whole = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
                columns += [
                    pa.array(np.diff(ends)),
                    pa.array([zlib.crc32(r[2].astype("<i4").tobytes()) for r in flat], pa.int64()),
                    pa.array([raw[x:y].tobytes() == whole[r[0]] for r, x, y in zip(flat, upto[:-1], upto[1:], strict=True)]),
                ]
                names += ["n_pieces", "ids_crc32", "round_trip"]
            else:
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            columns += [pa.array([r[3] for r in flat]), pa.array([r[4] for r in flat])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "log_prob", "inclusion"])

    return run


def _rows(docs: DataFrame, doc_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED, doc_col="doc_id", text_col="text") -> DataFrame:
    """Up to k rows a document: doc_id, sample, ids, log_prob, inclusion."""
    return _rows(docs, doc_col, text_col).mapInArrow(_sampled(path, k, seed, False), "doc_id long, sample int, ids array<int>, log_prob double, inclusion double")


def digest(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED, doc_col="doc_id", text_col="text") -> DataFrame:
    """As encode, with the number and checksum of the ids, and whether decoding them gives the text back."""
    schema = "doc_id long, sample int, n_pieces long, ids_crc32 long, round_trip boolean, log_prob double, inclusion double"
    return _rows(docs, doc_col, text_col).mapInArrow(_sampled(path, k, seed, True), schema)


def _decoder(path: str, at: int, kept: list[int], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [decode_ids(vocab, ids or []) for ids in batch.column(at).to_pylist()]
            rest = batch.select(kept)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(texts, pa.string())], names=[*rest.schema.names, out])

    return run


def decode(encoded: DataFrame, path: str, ids_col="ids", out: str = "text") -> DataFrame:
    """encoded with the decoded text of its ids in column out, which replaces one of that name."""
    small_batches(encoded.sparkSession)
    kept = [i for i, c in enumerate(encoded.columns) if c != out]
    schema = T.StructType([*(encoded.schema.fields[i] for i in kept), T.StructField(out, T.StringType())])
    return encoded.mapInArrow(_decoder(path, encoded.columns.index(ids_col), kept, out), schema)
