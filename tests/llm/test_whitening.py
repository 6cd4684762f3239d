from fractions import Fraction

import numpy as np
import pytest

from callglass.llm import spectra, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n string"


def polynomial(matrix):
    residues = {p: spectra.polynomial_modulo(np.array(matrix, object), p).tolist() for p in spectra.primes_for(matrix)}
    return spectra.remaindered(residues)


def plain_polynomial(matrix):
    """Faddeev and LeVerrier, in fractions."""
    d = len(matrix)
    m, c = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        for i in range(d):
            m[i][i] += c[-1]
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(m[i][i] for i in range(d)) / k)
    return [int(x) for x in reversed(c)]


def gram(rng, rows, d, size):
    a = rng.integers(-size, size + 1, (rows, d)).astype(object)
    return (a.T @ a).tolist()


@pytest.mark.parametrize(("rows", "d", "size"), [(9, 6, 5), (3, 6, 5), (40, 9, 10**9), (1, 4, 3), (8, 1, 4), (5, 2, 7)])
def test_exact_polynomial(rows, d, size):
    matrix = gram(np.random.default_rng(rows * d), rows, d, size)
    assert polynomial(matrix) == plain_polynomial(matrix)


def test_sparse_matrices_need_exchanges():
    matrix = [[2, 0, 0, 1], [0, 3, 1, 0], [0, 1, 3, 0], [1, 0, 0, 2]]
    assert polynomial(matrix) == plain_polynomial(matrix)
    assert polynomial([[5, 0, 0], [0, 5, 0], [0, 0, 7]]) == [-175, 95, -17, 1]


def test_roots_and_vectors():
    matrix = gram(np.random.default_rng(3), 30, 12, 1000)
    want = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
    roots = spectra.Roots(polynomial(matrix)).largest(8)
    assert np.allclose([r.at / 2**r.scale for r in roots], want[:8], rtol=1e-12) and all(r.times == 1 for r in roots)
    v = np.array([spectra.null_vectors(matrix, r)[0] for r in roots])
    assert np.abs(v @ v.T - np.eye(8)).max() < 1e-14
    assert np.abs(np.array(matrix, float) @ v.T - v.T * want[:8]).max() < 1e-8


def test_equal_close_and_no_roots():
    eye = [[6 if i == j else 0 for j in range(4)] for i in range(4)]
    (root,) = spectra.Roots(polynomial(eye)).largest(16)
    assert root.times == 4 and Fraction(root.at, 2**root.scale) == 6
    v = np.array(spectra.null_vectors(eye, root))
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-15
    big = 10**9
    close = [[big, 1, 0], [1, big, 0], [0, 0, 0]]
    roots = spectra.Roots(polynomial(close)).largest(16)
    assert [Fraction(r.at, 2**r.scale) for r in roots] == [big + 1, big - 1]
    assert np.allclose(np.abs(spectra.null_vectors(close, roots[0])[0]), [0.5**0.5, 0.5**0.5, 0], atol=1e-15)
    assert spectra.Roots(polynomial([[0, 0], [0, 0]])).largest(2) == []


def plain(rows, wanted=16):
    """The contract with all rows at once, in exact fractions where it asks for them."""
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in e]) for i, e, *_ in rows if e and all(c is not None and np.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(Fraction(x[k] * n - s[k], n)) for k in range(d)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return kept, n, s, e, v


def check(got, rows, wanted=16):
    kept, n, s, e, v = plain(rows)
    k = min(wanted, int((e > 1e-9 * max(1e-300, e[0])).sum()))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == k * len(kept) and set(by) == {i for i, _ in kept}
    flip = {}
    for i, x in kept:
        own = [r for r in sorted(by[i], key=lambda r: r.component)][:: max(1, len(by[i]) // k)][:k]
        for c, r in enumerate(own):
            assert r.component == c + 1 and r.n == n and r.identity_error < 1e-9
            away = sum((n * a - b) ** 2 for a, b in zip(x, s))
            assert r.deviation == (away if away < 1 << 63 else None)
            assert r.explained == pytest.approx(e[c] / e.sum(), rel=1e-9)
            want = float(np.dot([float(Fraction(a * n - b, n)) for a, b in zip(x, s)], v[:, c])) / e[c] ** 0.5
            if abs(want) > 1e-3:
                assert flip.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-7, abs=1e-7)


def made(seed, n, d, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) * scale * np.arange(1, d + 1)).tolist(), 1, "x") for i in range(n)]


@pytest.mark.parametrize(("n", "d", "scale"), [(60, 5, 1.0), (200, 20, 0.3), (4, 6, 2.0), (30, 3, 1e6), (2, 1, 1.0)])
def test_against_plain(spark, n, d, scale):
    rows = made(n, n, d, scale)
    check(whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_copies_count_once_and_bad_rows_go(spark):
    rows = made(7, 25, 4)
    copies = [(100 + i, rows[0][1], 2, "y") for i in range(400)] + [(None, rows[1][1], 1, "z")]
    bad = [(900, None, 1, "x"), (901, [], 1, "x"), (902, [1.0, None, 0.0, 0.0], 1, "x"), (903, [float("nan"), 0.0, 0.0, 0.0], 1, "x"),
           (904, [float("-inf"), 0.0, 0.0, 0.0], 1, "x"), (905, [1e300, 0.0, 0.0, 0.0], 1, "x")]
    got = whitening.whitened(spark.createDataFrame(rows + copies + bad, SCHEMA)).collect()
    assert {r.n for r in got} == {25} and not {r.vec_id for r in got} & {b[0] for b in bad}
    check(got, rows + copies)


def test_nothing_to_whiten(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 1, "x"), (2, [1.0, 2.0], 1, "x")], SCHEMA)
    assert whitening.whitened(one).collect() == [] and whitening.whitened(one.limit(0)).collect() == []
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 1, "x"), (2, [1.5, 2.0], 1, "x"), (3, [1.0], 1, "x"), (4, [2.0], 1, "x")], SCHEMA)
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in whitening.whitened(mixed).collect()) == [(i, 1, 1.0) for i in (1, 2, 3, 4)]


def test_wide_numbers_stay_exact():
    y = np.array([[1 << 51, 3], [-(1 << 51), 5]])
    assert whitening.products(y)[1, 1] == 2 << 102 and whitening.products(y)[1, 2] == -(1 << 52)
    model = whitening.Model(2, [0, 8], np.eye(2), np.ones(2), np.ones(2))
    assert model.deviations(model.scaled(y)) == [None, None] and model.deviations(model.scaled(np.array([[1, 4]]))).tolist() == [4]


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(whitening.whitened(df).collect(), rows)
