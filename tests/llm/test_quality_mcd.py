"""The estimates against a minimum covariance determinant in numpy."""

import numpy as np
import pytest

from verbaloom.llm import op02_quality as q

COLUMNS = "g string, x0 double, x1 double, x2 double, x3 double"


def floored(s):
    return s + np.diag(np.maximum(np.square(q.FLOORS) - np.diag(s), 0))


def mcd(x, h):
    """Concentration steps from many random starts; the least determinant."""
    rng, best = np.random.default_rng(1), None
    for _ in range(30):
        own = rng.choice(len(x), 25, replace=False)
        for _ in range(40):
            m, s = x[own].mean(axis=0), floored(np.cov(x[own].T, bias=True))
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m)
            own = np.argsort(d2, kind="stable")[: int(np.ceil(h * len(x)))]
        if best is None or np.linalg.det(s) < best[0]:
            best = np.linalg.det(s), d2
    return best[1] / max(1.0, float(np.median(best[1])) / q.CHI2_MEDIAN)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    mix = np.array([[0.4, 0, 0, 0], [0.3, 0.8, 0, 0], [0.2, -0.5, 1.0, 0], [0.0, 0.4, 0.3, 1.2]])
    x = rng.standard_normal((500, 4)) @ mix.T + [1.6, 2.0, 1.0, 2.0]
    x[:60] += [1.5, 6.0, -4.0, 7.0]  # a cluster of outliers
    return x


def distances(spark, x, parts, prior=0):
    table = spark.createDataFrame([("a", *map(float, r)) for r in x], COLUMNS).repartition(parts)
    params, _ = q.estimates(table.cache(), prior=prior)
    p = params.filter("g = 'a'").first()
    low = np.zeros((4, 4))
    for i, j in q.PAIRS:
        low[i, j] = p[f"l{i}{j}"]
    z = np.linalg.solve(low, (x - [p[f"m{i}"] for i in range(4)]).T)
    return (z * z).sum(axis=0) / p["c"]


def test_distances(spark, rows):
    got, want = distances(spark, rows, 3), mcd(rows, q.H)
    assert np.corrcoef(np.log(got), np.log(want))[0, 1] > 0.99
    assert np.abs(np.log(got / want))[60:].max() < 0.35  # subsets end at a bin, vectors lie on a lattice
    assert got[:60].min() > 30 and np.quantile(got[60:], 0.99) < 20


def test_estimates_do_not_depend_on_partitions(spark, rows):
    assert (distances(spark, rows, 1) == distances(spark, rows, 7)).all()


def test_small_groups_lean_on_all_texts(spark, rows):
    table = spark.createDataFrame([("a", *map(float, r)) for r in rows] + [("b", 9.0, 9.0, 9.0, 9.0)], COLUMNS)
    params = {r["g"]: r for r in q.estimates(table)[0].collect()}
    w = 1 / (1 + q.PRIOR)
    assert params["b"]["m0"] == pytest.approx(w * 9 + (1 - w) * params[""]["m0"])


def test_no_vectors(spark):
    assert q.estimates(spark.createDataFrame([("a", None, None, None, None)], COLUMNS))[0].count() == 0


def test_salted_groups_give_the_same(spark, rows, monkeypatch):
    want = distances(spark, rows, 2)
    monkeypatch.setattr(q, "BROADCAST_GROUPS", 0)
    assert (distances(spark, rows, 2) == want).all()
