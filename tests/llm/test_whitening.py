"""Whitening against exact fractions and numpy's own eigen-solve."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tracelode.llm import whitening
from tracelode.llm.queries import op12_embedding_whitening


def _integers(vector):
    return [int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in vector]


def _vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, x string, n int").repartition(3)


def _check(found, rows, most=16):
    """The rows found against a plain version: exact numbers, components up to their sign, covariance one."""
    good = [(i, _integers(v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(most, int((values > 1e-11 * values[0]).sum()))
    assert len(found) == kept * len(good)
    deviation = {tuple(x): sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for x in fit}
    whitened = dict(zip(fit, centred @ vectors[:, :kept] / np.sqrt(values[:kept]), strict=True))
    wanted = sorted((i is None, i or 0, k + 1, deviation[tuple(x)], round(abs(whitened[tuple(x)][k]), 7)) for i, x in good for k in range(kept))
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"], int(r["deviation"]), round(abs(r["whitened"]), 7)) for r in found) == wanted
    assert {r["n"] for r in found} == {n}
    for r in found:
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(covariance)) - 1) < 1e-9
    errors = {r["identity_error"] for r in found}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_awkward_vectors(spark):
    random = np.random.default_rng(2)
    rows = [(i, random.normal(size=5).tolist()) for i in range(60)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (100, rows[3][1]), (None, None), (70, None), (71, [1.0, None, 0.0, 0.0, 0.0]), (72, [float("nan")] * 5), (73, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (74, []), (75, [-0.0, 1 / 64, -1 / 64, 1e-9, -1e-9])]
    _check(whitening.whiten(_vectors(spark, rows)).collect(), rows)


def test_few_and_no_vectors(spark):
    assert whitening.whiten(_vectors(spark, [])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector: no variance
    two = [(1, [1.0, 2.0]), (2, [4.0, -2.0]), (3, [4.0, -2.0])]
    _check(whitening.whiten(_vectors(spark, two)).collect(), two)


def test_widths_are_fitted_apart(spark):
    random = np.random.default_rng(9)
    three, four = ([(w * 100 + i, random.normal(size=w).tolist()) for i in range(20)] for w in (3, 4))
    found = whitening.whiten(_vectors(spark, three + four)).collect()
    _check([r for r in found if r["vec_id"] < 400], three)
    _check([r for r in found if r["vec_id"] >= 400], four)


def test_a_third_of_all_rows_is_one_vector(spark):
    """Copies count once in the fit; entries of very different size, and a far offset, cost no digits."""
    random = np.random.default_rng(4)
    scale = np.array([1, 1e1, 1e2, 1e3, 1e5])
    rows = [(i, (1e7 + random.normal(size=5) * scale).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    found = whitening.whiten(_vectors(spark, rows), 5).collect()
    good = {tuple(_integers(v)) for _, v in rows}
    assert {r["n"] for r in found} == {len(good)}
    assert max(r["identity_error"] for r in found) < 1e-4
    assert len({(r["component"], r["whitened"]) for r in found if r["vec_id"] >= 1000 or r["vec_id"] == 0}) == 5


def test_a_whole_table(spark, tiny):
    table = spark.read.parquet(f"{tiny}/embeddings.parquet")
    _check(op12_embedding_whitening(spark, tiny).collect(), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_outer_products_are_exact():
    random = np.random.default_rng(6)
    x = np.unique(random.integers(999_000, 1_000_900, size=(2500, 6)), axis=0)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    model = whitening.Whitening(n, sums, np.zeros((6, 0)), np.zeros(0), 0.0)
    blocks = [whitening.outer_products(*model.centre(x[k : k + whitening.BLOCK])) for k in range(0, n, whitening.BLOCK)]
    high, low = blocks[0]
    for block in blocks[1:]:
        high, low = whitening.add_parts((high, low), block)
    exact = [[sum((Fraction(int(p)) - Fraction(sums[i], n)) * (Fraction(int(q)) - Fraction(sums[j], n)) for p, q in zip(x[:, i], x[:, j], strict=True)) for j in range(6)] for i in range(6)]
    for i in range(6):
        for j in range(6):
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact[i][j]) < exact[i][i] * Fraction(1, 1 << 75)
    assert [int(d) for d in model.deviations(x[:50])] == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x[:50]]


@pytest.mark.parametrize("kind", ["random", "one", "equal", "falling", "blocks"])
def test_eigen_solve(kind):
    random = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 33, 64):
        a = random.normal(size=(n, n))
        a = {"random": a @ a.T, "one": np.ones((n, n)), "equal": 3 * np.eye(n), "falling": a @ np.diag(10.0 ** -np.arange(n)) @ a.T, "blocks": np.kron(np.eye(3), a @ a.T)}[kind]
        values, vectors = whitening.eigen((a + a.T) / 2)
        assert (np.diff(values) <= 0).all()
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * max(1e-300, np.abs(a).sum())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * np.abs(a).sum())
