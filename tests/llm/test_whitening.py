import numpy as np
import pytest
from pyspark.sql import types as T

from opsmill.llm import whitening

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("x", T.StringType()),
        T.StructField("component", T.StringType()),
    ]
)


def frame(spark, rows):
    return spark.createDataFrame([(v, e, 1, "x", "c") for v, e in rows], SCHEMA).repartition(3)


def test_counts_of_inertia():
    random = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 33):
        for _ in range(20):
            a = random.integers(-3, 4, (n, n)).astype(float)
            a = a + a.T - np.diag(random.integers(0, 2, n) * np.diag(a) * 2)
            values = np.linalg.eigvalsh(a)
            if np.abs(values).min() > 1e-9:
                assert whitening.inertia(a) == ((values < 0).sum(), 0, (values > 0).sum())
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0, 1)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)


@pytest.mark.parametrize("kind", ["random", "repeated", "diagonal", "low rank", "close"])
def test_leading_eigenvalues(kind):
    random = np.random.default_rng(2)
    for n in (1, 2, 5, 40):
        a = random.normal(size=(n, n + 3))
        c = a @ a.T
        turn = np.linalg.qr(random.normal(size=(n, n)))[0]
        if kind == "repeated":
            c = (turn * np.array([3.0] * (n // 2) + [1.0] * (n - n // 2))) @ turn.T
        elif kind == "diagonal":
            c = np.diag(np.arange(n) % 3 * 1.0 + (n == 1))
        elif kind == "low rank":
            c = a[:, :2] @ a[:, :2].T
        elif kind == "close":
            c = (turn * (2 + np.arange(n) * 1e-9)) @ turn.T
        c = (c + c.T) / 2
        values, vectors = whitening.leading(c)
        want = np.linalg.eigvalsh(c)[::-1][:4]
        want = want[want > 1e-12 * np.trace(c)]
        assert len(values) == len(want)
        np.testing.assert_allclose(values, want, rtol=1e-10)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-12)
        np.testing.assert_allclose(c @ vectors, vectors * values, atol=1e-9 * max(1, want[0]))


def test_against_numpy(spark):
    random = np.random.default_rng(4)
    rows = [(i, (random.normal(size=7) * np.arange(1, 8)).astype("f4").tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(200)] + [rows[5], (None, rows[6][1]), (900, [1.5, -2.25]), (901, [])]
    left_out = [(902, None), (903, [None] * 7), (904, [float("nan")] * 7), (905, [float("-inf")] * 7)]
    got = whitening.whiten(frame(spark, rows + left_out)).toPandas()
    x = np.array([[int(np.floor(256 * float(c))) for c in e] + [0] * (7 - len(e)) for _, e in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    projected = (x - sums / n) @ vectors / np.sqrt(values)
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for k in range(4):
        part = got[got["component"] == k + 1]
        np.testing.assert_allclose(part["explained"], values[k] / np.trace(np.cov(fit.T, bias=True)), rtol=1e-9)
        sign = np.sign(part["whitened"].to_numpy() @ part["whitened"].to_numpy())
        assert sign == 1
        want = sorted(zip(((n * x - sums) ** 2).sum(axis=1), np.round(np.abs(projected[:, k]), 7)))
        assert sorted(zip(part["deviation"], np.round(part["whitened"].abs(), 7))) == want
        # Either sign, but one for all rows.
        of = dict(zip([v for v, _ in rows], projected[:, k]))
        signs = {np.sign(w * of[v]) for v, w in zip(part["vec_id"], part["whitened"]) if v in of and v == v and abs(w) > 1e-6}
        assert len(signs) == 1


def test_small_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    # One distinct vector has no variance, hence no component.
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    two = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert [(r["component"], r["n"], round(abs(r["whitened"]), 9), r["explained"]) for r in two] == [(1, 2, 1.0, 1.0)] * 3


def test_large_entries(spark):
    """Deviations beyond a long are null; nothing overflows on the way."""
    rows = whitening.whiten(frame(spark, [(i, [float(i) * 1e30, 1.0]) for i in range(4)])).collect()
    assert {r["vec_id"] for r in rows} == {0, 1, 2, 3}
    model = whitening.Whitening(3, [2**62, 0], np.ones(1), np.ones((2, 1)), 1.0)
    assert model.deviations(np.array([[2**61, 5]])) == [None]
    assert whitening.Whitening(3, [3, 0], np.ones(1), np.ones((2, 1)), 1.0).deviations(np.array([[2, 5]])) == [9 + 225]
