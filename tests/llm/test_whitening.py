"""Whitening against a whole eigendecomposition and exact sums."""

import math

import numpy as np
import pytest

from starweave.llm import whitening


def spectrum(kind, d, rng):
    return {
        "random": rng.random(d) * 40, "equal": np.full(d, 3.0), "low rank": np.r_[rng.random(min(d, 7)), np.zeros(max(0, d - 7))],
        "repeated": np.r_[[5, 5, 5, 4, 4], np.ones(max(0, d - 5))][:d], "close": 1 + 1e-9 * np.arange(d), "steep": 10.0 ** -np.arange(d) * 1e3,
    }[kind]


@pytest.mark.parametrize("kind", ["random", "equal", "low rank", "repeated", "close", "steep"])
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_leading_is_the_spectrum(kind, d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = spectrum(kind, d, rng)
    v = q * values @ q.T
    v = (v + v.T) / 2
    got, vectors = whitening.leading(v)
    want = np.sort(values)[::-1]
    sure = int((want > 1e-9 * want[0]).sum())  # of the others, rounding decides
    assert len(got) == min(16, d, sure) or kind == "steep" and sure <= len(got) <= sure + 4
    assert np.allclose(got, want[: len(got)], rtol=1e-6, atol=1e-12 * want[0])
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * want[0] and np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-12


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 8, 30):
        for _ in range(20):
            m = rng.standard_normal((d, d))
            m = m + m.T
            if rng.random() < 0.5:
                m[np.diag_indices(d)] = 0  # needs blocks of two
            s = float(rng.standard_normal()) * 3
            assert whitening.inertia(m, s) == (np.linalg.eigvalsh(m) > s).sum()


def by_hand(rows, dims, most=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained); components of one eigenvalue are not told apart."""
    x = [(i, [math.floor(64.0 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda v: np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)])
    z = np.array([centred(v) for v in fit])
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, v in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        out += [(i, k + 1, n, deviation, abs(float(centred(v) @ q[:, k])) / math.sqrt(e[k]), e[k] / e.sum()) for k in range(min(most, dims)) if e[k] > 1e-9 * e[0]]
    return sorted(out, key=lambda r: (str(r[0]), r[1], r[3], r[4]))


def result(df, **kw):
    got = [tuple(r) for r in whitening.components_of(df, **kw).collect()]
    assert all(r[6] <= 1e-9 for r in got)
    return sorted([(*r[:4], abs(r[4]), r[5]) for r in got], key=lambda r: (str(r[0]), r[1], r[3], r[4]))


def same(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-7, atol=1e-9)


def test_embeddings_are_whitened(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    same(result(df.repartition(6)), by_hand(rows, len(rows[0][1])))


def test_edge_vectors(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    inf, nan = float("inf"), float("nan")
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [nan] * 5), (103, [1.0, 2.0, -inf, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    rows = [*good, *bad, *[(200, good[0][1])] * 50, (7, good[3][1]), (None, good[4][1]), (106, [1e4, -1e4, 0.25, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS x", "'a' AS component", "2 AS whitened").repartition(4)
    want = by_hand(rows, 5)
    same(result(df), want)
    # the same columns by DataFrame functions, beside the others
    model = whitening.fit(df)
    whole = model.apply(df, out_col="white").collect()
    assert sorted(round(abs(x), 6) for r in whole for x in r.white) == sorted(round(r[4], 6) for r in want) and model.n == 61
    # one vector only, in many rows; nothing at all
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert result(one) == [] and result(one.where("false")) == [] and whitening.fit(one).n == 1 and whitening.fit(one.where("false")) is None


def test_large_entries_stay_exact():
    z, rest = np.array([[3, -5], [1 << 40, 2]], dtype=np.int64), [1, -2]
    assert whitening._deviations(z[:1], rest, 10**6) == [(3 * 10**6 - 1) ** 2 + (2 - 5 * 10**6) ** 2]
    assert whitening._deviations(z, rest, 10**6) == [(3 * 10**6 - 1) ** 2 + (2 - 5 * 10**6) ** 2, None]
