"""SimHash near-duplicates against brute force."""

import collections
import re

import numpy as np
import pytest
import xxhash

from starweave.llm import simhash
from starweave.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(fps, group=None):
    """First place of each fingerprint's component, by all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in enumerate(fps):
        near = np.bitwise_count(fps ^ f) <= 3
        for j in np.flatnonzero(near if group is None else near & (group == group[i])):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def brute(rows):
    """(doc_id, fingerprint, component_id); rows of one id are one document, rows without an id are each their own."""
    fps = [fingerprint(t) for _, t in rows]
    parent = roots(np.array(fps, dtype=np.uint64))
    parent = dict(enumerate(parent))
    first = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            a, b = find(i), find(first.setdefault(doc_id, i))
            parent[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] += [] if doc_id is None else [doc_id]
    return sorted(((d, f"{f:016x}", min(least[find(i)], default=None)) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True))), key=str)


def gray(x):
    for by in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(by))
    return x


def clusters(rng, n, centres, flips):
    fps = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(fps)


def result(df, **kw):
    return sorted(map(tuple, simhash.near_duplicates(df, **kw).collect()), key=str)


def test_hashes_are_the_library(spark):
    rng = np.random.default_rng(5)
    raw, starts = rng.integers(0, 256, 5000, dtype=np.uint8), rng.integers(0, 4900, 3000)
    ends = starts + rng.integers(0, 80, 3000)
    assert simhash.xxh64(raw, starts, ends).tolist() == [xxhash.xxh64_intdigest(raw.tobytes()[a:b], 42) for a, b in zip(starts, ends, strict=True)]
    assert spark.sql("SELECT xxhash64('one two three')").first()[0] == np.uint64(xxhash.xxh64_intdigest("one two three", 42)).astype(np.int64)


@pytest.mark.parametrize("open_pairs", [40, 1 << 21])
def test_index_is_brute_force(open_pairs):
    rng = np.random.default_rng(6)
    for trial in range(25):
        fps = clusters(rng, int(rng.integers(1, 700)), int(rng.integers(1, 25)), int(rng.integers(0, 7)))
        group = (fps >> np.uint64(63 - trial % 8)).astype(np.int64)
        order = np.lexsort((gray(fps), group))
        fps, group = fps[order], group[order]
        assert simhash.united(fps, group, open_pairs=open_pairs).tolist() == roots(fps, group)
        # what is united from the start stays so
        label = np.where(rng.random(len(fps)) < 0.1, 7, -1)
        got = simhash.united(fps, group, label, open_pairs=open_pairs)
        assert len(set(got[label == 7].tolist())) <= 1


def test_pieces_do_not_matter(spark):
    rng = np.random.default_rng(7)
    fps = np.unique(np.concatenate([clusters(rng, 1500, 5, 4), clusters(rng, 300, 300, 0)]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = roots(fps)
    for piece in (40, 1 << 15):
        label = {r.node: r.component for r in components(simhash.linked(df, piece=piece)[0], "a", "b").collect()}
        got = [label.get(f, f) for f in fps.view(np.int64).tolist()]
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_documents_are_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    edited = [(1000 + i, " ".join([*base * 5, f"w{i}"] if i % 3 else [*base * 5][i:])) for i in range(40)]
    edge = [
        (2000, ""), (2001, None), (2002, " \n\t"), (2003, "One"), (2004, "one"), (2005, "one TWO"), (2006, "one two"), (2007, "one two three"), (2008, "One\ttwo  three"), (2009, "É two three"),
        (2010, "é two three"), (2011, "漢字 \U0001f600 x" * 50), (2012, "x" * 100000), (2013, "y " * 60000), (2014, "a b c d"), (2015, "x\x1cy z"), (None, "one two three"), (None, "no such text here"),
        (9, "one two three"), (2016, "no such text here either"), (2016, "one two"), (2016, "two rows of one id"), (2017, "two rows of one id"), (2017, "two rows of one id"),
    ]
    rows += edited + edge
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "'x' AS component_id", "2 AS fingerprint").repartition(5)
    want = brute(rows)
    assert result(df) == want
    assert sum(r[0] != r[2] for r in want) > 40
    assert result(df.where("false")) == []
