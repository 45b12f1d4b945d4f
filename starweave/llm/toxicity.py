"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns the words of a clause into classes, with a weight for insults (a seed list and terms learned
from labels). Four more are composed to one machine that reads the classes: threats (a threat word in the scope of an
intent), negation and reported speech (which turn a hit in their scope into another one), and targets (which may come
before or after a hit, so this one guesses and a wrong guess ends in no final state). A clause's best path, by weight,
says how much it adds to which output tape; the sums by tape are a text's features, and a logistic regression fitted on
labelled rows turns them into a score. A hit without a target is the clause's weakest pattern; no word scores by itself.

Learning uses a bounded sample: at most TRAIN_ROWS labelled rows of the training fold, those with the least hash of
doc_id (a documented parameter); labels, language, source and id are no inputs of a score. All terms of the sample that
pass the thresholds are kept.

Edge cases: null and empty texts, and texts in which no transducer emits, get the regression's score for no clause. Texts
and clauses of any length are read to their ends. Ties between paths of one weight go to the first in order of states. No
labelled training rows: fixed start weights score. Repeated rows are scored each; a document with several labels counts
each of them. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize, small_batches

TRAIN_ROWS, THRESHOLD = 4000, 0.7
MIN_POSITIVE, MIN_LOG_ODDS, MIN_Z = 4, 1.5, 3.5
STEMS = (5, 6, 7, 8)

INSULTS = "idiot moron stupid scum trash loser worthless pathetic disgusting clown imbecile fool bastard dumb ugly idiota imbécil estúpido basura crétin abruti imbécile dummkopf trottel abschaum arschloch".split()
THREATS = "kill hurt destroy beat punish burn die töten umbringen schlagen tuer frapper matar golpear destruir".split()
INTENTS = "will gonna shall werde werden vais va voy vamos".split()
TARGETS = frozenset("you your you're u he she they them du dich ihr euch sie tu toi vous il elle ils te tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never isn't aren't nobody kein keine nicht nie pas jamais aucun ni nunca nadie".split())
REPORTS = frozenset("said says wrote quoted called reported claims sagte schrieb dit écrit dijo escribió".split())
#: Words in which a negation, a report or an intent holds.
NEGATION_SCOPE, REPORT_SCOPE, INTENT_SCOPE, TARGET_SCOPE = 3, 6, 3, 3

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = re.compile(r"[.,;:!?\n|]")
#: Words whose class a worker keeps at a time.
KNOWN_WORDS = 1 << 18
TAPES = ("direct", "targeted", "negated", "reported", "threat")
FEATURES = (*(f"log_{t}" for t in TAPES), "any", "rate", "distinct", "log_words")
#: Factor of a hit's weight by tape; a threat without a target counts half.
FACTORS = {"direct": 0.5, "targeted": 1.0, "negated": 1.0, "reported": 1.0, "threat": 1.0, "threat_alone": 0.5}
#: Weight of a threat word that is no insult.
THREAT_WEIGHT = 2.0

#: Input classes of the composed machine; BOTH is a threat word that is an insult as well.
OTHER, INSULT, THREAT, BOTH, INTENT, TARGET, NEGATION, REPORT = "other", "insult", "threat", "both", "intent", "target", "negation", "report"


_HITS, _NOTHING = frozenset((INSULT, THREAT, BOTH)), (OTHER, 0.0)


class Transducer:
    """arcs: {(state, input): [(output, factor, next state)]}. An arc emits its output with factor times the weight of what it
    reads; factors multiply along composed arcs."""

    def __init__(self, start, arcs: dict[tuple, list[tuple]], finals: set):
        self.start, self.arcs, self.finals = start, arcs, finals

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's output to other; only states that can be reached."""
        inputs: dict = {}
        for (state, x), out in self.arcs.items():
            inputs.setdefault(state, []).append((x, out))
        start = (self.start, other.start)
        arcs, seen, todo = {}, {start}, [start]
        while todo:
            a, b = state = todo.pop()
            for x, out in inputs.get(a, ()):
                for y, factor, to_a in out:
                    for z, more, to_b in other.arcs.get((b, y), ()):
                        to = (to_a, to_b)
                        arcs.setdefault((state, x), []).append((z, factor * more, to))
                        if to not in seen:
                            seen.add(to)
                            todo.append(to)
        return Transducer(start, arcs, {s for s in seen if s[0] in self.finals and s[1] in other.finals})

    def numbered(self) -> Transducer:
        """The same with numbers for states, the start first."""
        number = {self.start: 0}
        for (state, _), out in self.arcs.items():
            for s in (state, *(to for *_, to in out)):
                number.setdefault(s, len(number))
        arcs = {(number[s], x): [(z, f, number[to]) for z, f, to in out] for (s, x), out in self.arcs.items()}
        return Transducer(0, arcs, {number[s] for s in self.finals if s in number})

    def best(self, word_classes: Iterable[tuple[str, float]]) -> tuple[float, dict[str, float]]:
        """(weight, sums by output) of the heaviest path that ends in a final state."""
        active: dict = {self.start: (0.0, None)}
        for x, weight in word_classes:
            new: dict = {}
            for state in sorted(active):
                total, path = active[state]
                for out, factor, to in self.arcs.get((state, x), ()):
                    now = total + factor * weight
                    if to not in new or now > new[to][0]:
                        new[to] = (now, path if out == OTHER else (path, out, factor * weight))
            active = new
        done = [(total, path) for state, (total, path) in sorted(active.items()) if state in self.finals]
        if not done:
            return 0.0, {}
        total, path = max(done, key=lambda d: d[0])
        sums: dict[str, float] = {}
        while path is not None:
            path, out, weight = path
            sums[out] = sums.get(out, 0.0) + weight
        return total, sums


def _scoped(opener: str, scope: int, inputs: dict[str, str], inside: dict[str, str]) -> Transducer:
    """A machine whose state counts the words left of a scope that opener opens: inputs pass as they map, but as inside maps
    them within the scope; opener itself is read as other."""
    arcs = {}
    for left in range(scope + 1):
        for x, y in inputs.items():
            out = inside.get(x, y) if left else y
            arcs[left, x] = [(out, float(out != OTHER), max(0, left - 1))]
        arcs[left, opener] = [(OTHER, 0.0, scope)]
    return Transducer(0, arcs, set(range(scope + 1)))


def _targets() -> Transducer:
    """States: (words left in which a target before still counts, words left in which a guessed one must come; 0: none)."""
    arcs: dict[tuple, list] = {}
    kinds = {"insult": ("targeted", "direct", FACTORS["targeted"], FACTORS["direct"]), "threat": ("threat", "threat", FACTORS["threat"], FACTORS["threat_alone"])}
    for near in range(TARGET_SCOPE + 1):
        for due in range(TARGET_SCOPE + 1):
            state, later, waits = (near, due), max(0, near - 1), max(0, due - 1)
            arcs[state, TARGET] = [(OTHER, 0.0, (TARGET_SCOPE, 0))]
            if due == 1:
                continue  # anything but a target breaks the guess
            for x in (OTHER, "negated", "reported"):
                arcs[state, x] = [(x, FACTORS.get(x, 0.0), (later, waits))]
            for x, (aimed, bare, more, less) in kinds.items():
                if near:
                    arcs[state, x] = [(aimed, more, (later, waits))]
                else:
                    arcs[state, x] = [(bare, less, (later, waits)), (aimed, more, (later, waits or TARGET_SCOPE))]
    return Transducer((0, 0), arcs, {(n, 0) for n in range(TARGET_SCOPE + 1)})


@functools.cache
def grammar() -> Transducer:
    """The composed machine, from word classes to tapes."""
    threats = _scoped(INTENT, INTENT_SCOPE, {OTHER: OTHER, INSULT: INSULT, THREAT: OTHER, BOTH: INSULT, TARGET: TARGET, NEGATION: NEGATION, REPORT: REPORT}, {THREAT: THREAT, BOTH: THREAT})
    negations = _scoped(NEGATION, NEGATION_SCOPE, {x: x for x in (OTHER, INSULT, THREAT, TARGET, REPORT)}, {INSULT: "negated", THREAT: "negated"})
    reports = _scoped(REPORT, REPORT_SCOPE, {x: x for x in (OTHER, INSULT, THREAT, TARGET, "negated")}, {x: "reported" for x in (INSULT, THREAT, "negated")})
    return threats.compose(negations).compose(reports).compose(_targets()).numbered()


_SAID = {**dict.fromkeys(INTENTS, INTENT), **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTS, REPORT)}


class Grammar:
    """The lexical transducer of some terms ({word or stem*: weight}), in front of the composed machine."""

    def __init__(self, terms: dict[str, float]):
        self.words = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.machine = grammar()
        self.known: dict[str, tuple[str, float]] = {}

    def weight(self, word: str) -> float:
        if word in self.words:
            return self.words[word]
        for n in self.lengths:
            if len(word) > n and (w := self.stems.get(word[:n])) is not None:
                return w
        return 0.0

    def read(self, word: str) -> tuple[str, float]:
        """The class and weight of a word, kept for its next occurrence. Words of the grammar itself keep their class."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            weight = self.weight(word)
            if word in _SAID:
                found = _SAID[word], 0.0
            elif word in THREATS:
                found = (BOTH, weight) if weight else (THREAT, THREAT_WEIGHT)
            else:
                found = (INSULT, weight) if weight else _NOTHING
            self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        low = text.lower()
        tapes, seen = dict.fromkeys(TAPES, 0.0), set()
        hits = {w for w in set(_WORD.findall(low)) if self.read(w)[0] in _HITS}
        for clause in _CLAUSE_END.split(low) if hits else ():
            words = _WORD.findall(clause)
            if hits.isdisjoint(words):
                continue  # no path emits anything
            total, sums = self.machine.best(map(self.read, words))
            for tape, x in sums.items():
                tapes[tape] += x
            if total:
                seen.update(hits.intersection(words))
        n_words = low.count(" ") + low.count("\n") + 1
        total = sum(tapes.values())
        return [*(math.log1p(t) for t in tapes.values()), float(total > 0), math.log1p(100 * total / (n_words + 20)), math.log1p(len(seen)), math.log1p(n_words)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic) for each distinct word and stem of each text."""
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            out = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([toxic.as_py()] * len(out), pa.int32())], names=["term", "toxic"])


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Words and stems that mark toxic texts, with their log odds; a term that a shorter stem explains as well is left out."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    p, q = n.get(1, 0), n.get(0, 0)
    if not p or not q:
        return {}
    pos, neg = F.sum("toxic") + 0.5, F.sum(1 - F.col("toxic")) + 0.5
    rows = sample.select("text", "toxic").mapInArrow(_terms, "term string, toxic int").groupBy("term").agg(pos.alias("pos"), neg.alias("neg"))
    odds = F.log(F.col("pos") / (p + 1.0)) - F.log(F.col("neg") / (q + 1.0))
    rows = rows.where(F.col("pos") >= MIN_POSITIVE).withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / F.col("pos") + 1 / F.col("neg")))
    rows = rows.where((F.col("odds") >= MIN_LOG_ODDS) & (F.col("z") >= MIN_Z)).select("term", "odds").collect()
    found = {r["term"]: r["odds"] for r in rows}
    out: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t.rstrip("*")), t)):
        bare = term.rstrip("*")
        parent = [out[bare[:k] + "*"] for k in STEMS if k < len(bare) and bare[:k] + "*" in out]
        if not parent or found[term] > max(parent) + 0.7:
            out[term] = found[term]
    return out


def _features(grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(grammar.value)
        for batch in batches:
            rows = [g.features(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["f", "toxic"])

    return run


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps: (means, scales, weights with the bias first)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _scorer(grammar, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, (mean, scale, w) = Grammar(grammar.value), model.value
        for batch in batches:
            x = np.array([g.features(t.as_py() or "") for t in batch.column(1)]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(w[0] + (x - mean) / scale @ w[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, doc_col="doc_id", text_col="text", label_col="toxic", held_out=_held_out) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = labels.select(F.col(doc_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = fold.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(TRAIN_ROWS)
    sample = materialize(rows.join(chosen, "doc_id").select("doc_id", "text", "toxic"), "toxic_sample")
    terms = {w: 4.0 for w in INSULTS} | learn_terms(sample)
    grammar = spark.sparkContext.broadcast(terms)
    got = sample.select("text", "toxic").mapInArrow(_features(grammar), "f array<double>, toxic int").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    if len(set(y)) == 2:
        x = np.array(got.column("f").to_pylist())
        order = np.lexsort((*x.T, y))  # the sums must not depend on the order in which tasks end
        model = fit(x[order], y[order])
    else:
        w = np.zeros(len(FEATURES) + 1)
        w[0], w[1 + FEATURES.index("log_direct")], w[1 + FEATURES.index("log_targeted")] = -3.0, 2.0, 3.0
        model = (np.zeros(len(FEATURES)), np.ones(len(FEATURES)), w)
    drop(sample)
    scored = rows.mapInArrow(_scorer(grammar, spark.sparkContext.broadcast(model)), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
