import math
import random
from fractions import Fraction

import numpy as np
import pytest

from townsheet.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def write(spark, rows, path, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", *[f"'y' as {c}" for c in ("x", "n", "at", "whitened", "deviation", "component")])
    df.write.mode("overwrite").parquet(f"{path}/embeddings.parquet")
    return str(path)


def made(seed, n=300, d=8):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, d)) @ rnd.normal(size=(d, d)) + rnd.normal(size=d)
    return [(i, [float(x) for x in row], 0) for i, row in enumerate(v.astype(np.float32))]


def brute(rows, count=4):
    """By a general solver in doubles, and deviations in whole numbers."""
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in whole}), object)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s).astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:count]
    out = {}
    for i, x in whole:
        x = np.array(x, object)
        deviation = int(((n * x - s) ** 2).sum())
        proj = ((x * n - s).astype(float) / n) @ vectors[:, order] / np.sqrt(values[order])
        out[i] = deviation, proj
    return n, out, values[order] / values.sum()


@pytest.mark.parametrize("seed,d", [(1, 8), (2, 3), (3, 16)])
def test_like_a_general_solver(spark, tmp_path, seed, d):
    rows = made(seed, d=d)
    rows += [(i + 1000, v, 0) for i, v, _ in rows[:100]] + [(5000 + i, rows[7][1], 1) for i in range(120)]
    odd = [(9001, None, 0), (9002, [None] * d, 0), (9003, [float("nan")] + [0.0] * (d - 1), 0), (9004, [float("inf")] + [0.0] * (d - 1), None)]
    got = queries.op13_embedding_whitening(spark, write(spark, rows + odd, tmp_path, extra=True)).collect()
    k = min(4, d)
    n, want, explained = brute(rows)
    assert len(got) == len(rows) * k and n == 300
    sign = {}
    for r in got:
        deviation, proj = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        j = r.component - 1
        assert abs(r.explained - explained[j]) < 1e-9 and r.identity_error < 1e-9
        if abs(proj[j]) > 0.1:
            assert sign.setdefault(j, r.whitened * proj[j] > 0) == (r.whitened * proj[j] > 0)
        assert abs(abs(r.whitened) - abs(proj[j])) < 1e-7


def test_null_ids_and_nothing_to_fit(spark, tmp_path):
    rows = made(4, 20, 2)
    got = queries.op13_embedding_whitening(spark, write(spark, [*rows, (None, rows[0][1], None), rows[0]], tmp_path)).collect()
    assert len(got) == 22 * 2 and sum(r.vec_id is None for r in got) == 2
    for few in ([], [rows[0]], [rows[0], (7, rows[0][1], 0)], [(1, None, 0)], [(1, [], 0)]):
        found = queries.op13_embedding_whitening(spark, write(spark, few, tmp_path))
        assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with pytest.raises(Exception, match="differ in length"):
        queries.op13_embedding_whitening(spark, write(spark, [*rows, (1, [1.0], 0)], tmp_path)).collect()


def test_equal_roots_give_a_basis(spark, tmp_path):
    """Corners of a cross-polytope: all roots are equal; whitened columns are uncorrelated all the same."""
    d = 6
    rows = [(2 * i + j, [(1.0 if j else -1.0) if k == i else 0.0 for k in range(d)], 0) for i in range(d) for j in range(2)]
    got = queries.op13_embedding_whitening(spark, write(spark, rows, tmp_path)).collect()
    assert len(got) == 12 * 4 and all(abs(r.explained - 1 / 6) < 1e-12 and r.identity_error < 1e-12 for r in got)


def test_flat_data_have_fewer_components(spark, tmp_path):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 5.0], 0) for i in range(30)]
    got = queries.op13_embedding_whitening(spark, write(spark, rows, tmp_path)).collect()
    assert {r.component for r in got} == {1} and len(got) == 30 and all(abs(r.explained - 1) < 1e-12 for r in got)


def determinant(m):
    m, out = [[Fraction(x) for x in row] for row in m], Fraction(1)
    for k in range(len(m)):
        pivot = next((i for i in range(k, len(m)) if m[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            m[k], m[pivot], out = m[pivot], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_and_roots(spark, seed):
    """The polynomial is the determinant at d + 1 places; roots lie in their intervals, equal ones repeated."""
    rnd = random.Random(seed)
    d = 5
    x = [[rnd.randint(-(10 ** (2 + 4 * seed)), 10 ** (2 + 4 * seed)) for _ in range(d)] for _ in range(3 + seed)]
    a = [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]
    c = whitening.polynomial(spark, a)
    for t in range(d + 1):
        assert sum(k * t**i for i, k in enumerate(c)) == determinant([[(t if i == j else 0) - a[i][j] for j in range(d)] for i in range(d)])
    values = np.sort(np.linalg.eigvalsh(np.array(a, float)))[::-1]
    found = whitening.roots(c, d)
    assert len(found) == min(d, 3 + seed)
    for (m, s), v in zip(found, values):
        assert abs(m / 2**s - v) < 1e-9 * values[0] and whitening.above(c, m, s) < whitening.above(c, m - 1, s)


def test_equal_roots_are_counted():
    """(t - 3)^2 (t - 2)"""
    assert [m / 2**s for m, s in whitening.roots([-18, 21, -8, 1], 3)] == [3, 3, 2]
    assert [whitening.above([-18, 21, -8, 1], m, 1) for m in (3, 4, 5, 6)] == [3, 2, 2, 0]


@pytest.mark.parametrize("top", [10**3, 10**7, 10**14, 2**61])
def test_scatter_is_exact(spark, top):
    rnd = random.Random(top)
    x = [[rnd.randint(-top, top) for _ in range(3)] for _ in range(50)]
    n, sums, products = whitening.scatter(spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(5))
    assert (n, sums) == (50, [sum(r[i] for r in x) for i in range(3)])
    assert products == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]


def test_vectors_solve_an_ill_scaled_matrix(spark):
    """|A v - r v| / r is of the size of a double's rounding, where A's rows differ by factors of 10^11."""
    rnd = np.random.default_rng(8)
    x = (rnd.normal(size=(40, 12)) * 10.0 ** np.arange(12)[::-1] * 3).astype(np.int64).astype(object)
    a = (x.T @ x).tolist()
    found = whitening.roots(whitening.polynomial(spark, a), 4)
    top = Fraction(found[0][0], 2 ** found[0][1])
    for (m, s), v in zip(found, whitening.vectors(a, found)):
        r, u = Fraction(m, 2**s), [Fraction(float(t)) for t in v]
        off = [sum(a[i][j] * u[j] for j in range(12)) - r * u[i] for i in range(12)]
        assert max(abs(float(o / top)) for o in off) < 1e-15
        assert abs(float(np.linalg.norm(v)) - 1) < 1e-14
