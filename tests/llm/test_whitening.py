import math
import random

import numpy as np
import pytest

from tidemeter.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, v string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, 1, 5, "x", "y") for k, v in rows], SCHEMA).repartition(parts)


def vectors(n, size=6, seed=3):
    r = np.random.default_rng(seed)
    turn = np.linalg.qr(r.standard_normal((size, size)))[0]
    return (r.standard_normal((n, size)) * np.array([2.0 ** -k for k in range(size)])) @ turn


def plain(rows, components=8):
    """Whole numbers, exact deviations, and the covariance's own eigenvectors by the linear algebra library."""
    kept = [(k, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(kept), [sum(c) for c in zip(*[x for _, x in kept])]
    off = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for _, x in kept])
    cov = off.T @ off / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1], turn[:, ::-1]
    return kept, [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept], values, off @ turn / np.sqrt(values), values / values.sum()


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("size", [2, 6, 20])
def test_as_by_the_eigenvectors_of_the_covariance(spark, parts, size):
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(vectors(300, size))] + [(5, [0.5] * size), (None, [0.25] * size)]
    odd = [(900, None), (901, [0.5] * (size - 1) + [None]), (902, [float("nan")] * size), (903, [float("inf")] + [0.0] * (size - 1)), (904, [])]
    kept, deviations, values, white, share = plain(rows)
    got = whitening.whitened(table(spark, rows + odd, parts)).collect()
    assert len(got) == len(kept) * min(size, 8)
    assert {(r.n, r.identity_error) for r in got} == {(len(kept), got[0].identity_error)} and got[0].identity_error < 1e-10
    by_row = {}
    for (k, _), d, w in zip(kept, deviations, white):
        by_row.setdefault(k, []).append((d, w))
    sign = {}
    for c in range(1, min(size, 8) + 1):
        lead = next(r for r in got if r.component == c and r.vec_id == 0)
        sign[c] = np.sign(lead.whitened * by_row[0][0][1][c - 1])
    for r in got:
        assert any(r.deviation == d and abs(sign[r.component] * r.whitened - w[r.component - 1]) < 1e-7 for d, w in by_row[r.vec_id])
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9


def test_odd_tables(spark):
    assert whitening.whitened(table(spark, [])).count() == 0
    assert whitening.whitened(table(spark, [(1, None), (2, []), (3, [None, 1.0])])).count() == 0
    same = whitening.whitened(table(spark, [(k, [0.5, 0.25]) for k in range(4)])).collect()
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(4, 0, None, None, None)} and len(same) == 8
    one = whitening.whitened(table(spark, [(9, [0.5, 0.25])])).collect()
    assert [(r.vec_id, r.component, r.deviation) for r in sorted(one, key=lambda r: r.component)] == [(9, 1, 0), (9, 2, 0)]
    flat = whitening.whitened(table(spark, [(k, [float(k), 0.5]) for k in range(4)])).collect()
    assert {r.whitened is None for r in flat if r.component == 2} == {True} and all(r.identity_error < 1e-12 for r in flat)
    mixed = whitening.whitened(table(spark, [(k, [float(k), k * k / 8]) for k in range(5)] + [(70, [1.0]), (71, [1.0, 2.0, 3.0])])).collect()
    assert {r.vec_id for r in mixed} == set(range(5))
    # beyond 64 bits the deviation has no value, and nothing else breaks
    wide = whitening.whitened(table(spark, [(k, [float(k) * 1e30, 0.5 * k]) for k in range(-2, 3)])).collect()
    assert len(wide) == 10 and any(r.deviation is None for r in wide)


@pytest.mark.parametrize("n", [1, 2, 5, 33, 64])
def test_spectrum_against_the_library(n):
    r = np.random.default_rng(n)
    turn = np.linalg.qr(r.standard_normal((n, n)))[0]
    for values in (r.random(n) * 100, np.repeat([5.0, 1.0], [n // 2, n - n // 2]), np.logspace(4, -10, n), np.ones(n), np.zeros(n), np.eye(n)[0] * 7):
        a = turn * values @ turn.T
        a = (a + a.T) / 2
        found, vectors_ = whitening.spectrum(a)
        scale = max(np.abs(a).max(), 1e-300)
        assert np.abs(found - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * n * scale
        assert np.abs(a @ vectors_ - vectors_ * found).max() <= 1e-13 * n * scale and np.abs(vectors_.T @ vectors_ - np.eye(n)).max() < 1e-13 * n


def test_polar_factor_is_the_sign_of_the_matrix():
    r = np.random.default_rng(8)
    a = r.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar_factor(a)
    values, turn = np.linalg.eigh(a)
    assert np.abs(u - turn * np.sign(values) @ turn.T).max() < 1e-12 and np.abs(u @ u - np.eye(30)).max() < 1e-13


def test_deviations_are_exact_for_large_numbers():
    r = random.Random(2)
    whole = np.array([[r.randrange(0, 2**27) for _ in range(3)] for _ in range(50)], dtype=np.int64)
    sums = [int(c) for c in whole.sum(axis=0)]
    model = whitening.Whitening(50, tuple(sums), np.zeros(3), np.eye(3), 0.0, 1.0, 0)
    exact, fits = model.deviations(whole)
    want = [sum((50 * int(x) - s) ** 2 for x, s in zip(row, sums)) for row in whole]
    assert any(w >= 2**63 for w in want) and any(w < 2**63 for w in want)
    assert [(int(e) if f else None) for e, f in zip(exact, fits)] == [w if w < 2**63 else None for w in want]
