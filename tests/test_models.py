"""Ridge from prefix sums and exact quantiles against numpy."""

import random

import numpy as np
import pytest

from tidemark.functions.ranks import exact_quantiles, upper_middles
from tidemark.operators import ridge


def plain_fit(x, y, l2):
    med = [(sorted(v)[len(v) // 2] if (v := [a for a in col if a is not None]) else 0.0) for col in zip(*x)]
    m = np.array([[med[j] if a is None else a for j, a in enumerate(r)] for r in x])
    mean, std = m.mean(axis=0), m.std(axis=0)
    std[std == 0] = 1
    z = (m - mean) / std
    w = np.linalg.solve(z.T @ z + l2 * np.eye(m.shape[1]), z.T @ (y - y.mean()))
    return lambda r: y.mean() + float(((np.array([med[j] if a is None else a for j, a in enumerate(r)]) - mean) / std) @ w)


@pytest.mark.parametrize("share", [0.0, 0.2])
def test_walk_forward_ridge_equals_a_fit_per_fold(spark, share):
    """With and without nulls, a constant feature, dates without labels; folds under the least number of rows are left out."""
    rng = random.Random(7)
    rows = []
    for m in range(9):
        for t in range(25):
            a, b = rng.gauss(0, 1), 10 ** rng.gauss(0, 1)
            label = None if m == 8 or rng.random() < 0.1 else 0.5 * a - 0.1 * b + rng.gauss(0, 0.1)
            rows.append((100 + m, t, None if rng.random() < share else a, None if rng.random() < share else b, 3.0, label))
    f = ["a", "b", "k"]
    panel = ridge.dated(spark.createDataFrame(rows, "m int, t int, a double, b double, k double, label double"), "m")
    got = {(r["m"], r["t"]): r["prediction"] for r in ridge.walk_forward(panel, f, ridge.monthly_folds(panel, 2), least=60).collect()}
    want = {}
    for m in range(102, 109):
        train = [r for r in rows if r[0] < m and r[5] is not None]
        if len(train) >= 60:
            say = plain_fit([r[2:5] for r in train], np.array([r[5] for r in train]), 10.0)
            want |= {(r[0], r[1]): say(r[2:5]) for r in rows if r[0] == m}
    assert got.keys() == want.keys() and 0 < len(want) < 7 * 25
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_expanding_folds(spark):
    panel = spark.range(43).withColumnRenamed("id", "i")
    got = [tuple(r) for r in ridge.expanding_folds(panel, 3, 3, 12).orderBy("fold").collect()]
    assert got == [(0, 12, 15, 24), (1, 21, 24, 33), (2, 30, 33, 42)]


def test_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(10 ** rng.gauss(0, 2), float(i % 4) if i % 3 else None, 5.0 if i == 9 else None, None) for i in range(1237)]
    df = spark.createDataFrame(rows, "wide double, tied double, single double, none double")
    got = {(r["_column"], r["i"]): r["q"] for r in exact_quantiles(df, df.columns).collect()}
    for k, name in enumerate(df.columns):
        v = [r[k] for r in rows if r[k] is not None]
        if not v:
            assert not any(c == name for c, _ in got)
            continue
        want = np.quantile(v, [i / 100 for i in range(101)])
        assert all(abs(got[name, i] - want[i]) <= 1e-9 * max(1, abs(want[i])) for i in range(101))
    mid = upper_middles(df, df.columns).first()
    for k, name in enumerate(df.columns):
        v = sorted(r[k] for r in rows if r[k] is not None)
        assert mid[name] == (v[len(v) // 2] if v else None)
