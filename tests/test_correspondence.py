import random

import numpy as np
import pytest

from folioscope.operators.evaluation import correspondence


def plain(m):
    """Coordinates of rows and columns on two axes, and shares, by a whole singular value decomposition."""
    p = m / m.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), full_matrices=False)
    sign = np.sign(vt[np.arange(len(s)), np.abs(vt).argmax(1)])
    return (u * sign * s / np.sqrt(r)[:, None])[:, :2], (vt.T * sign * s / np.sqrt(c)[:, None])[:, :2], (s**2 / (s**2).sum())[:2]


def test_against_svd(spark):
    rng = random.Random(5)
    m = np.array([[rng.choice([0, 1, 3, 9, 20]) + (40 if i % 4 == j else 0) for j in range(7)] for i in range(60)], float)
    cells = [(f"r{i:02}", f"c{j}", float(m[i, j])) for i in range(60) for j in range(7) if m[i, j]]
    cells += [(None, "c1", 5.0), ("r01", None, 5.0), ("r98", "c1", 0.0), ("r99", "c2", None)]
    got = correspondence(spark.createDataFrame(cells, "a string, b string, n double"), "a", "b").collect()
    x, y, share = plain(m)
    rows, columns = (np.array([r["coordinates"] for r in sorted(got, key=lambda r: r["item"]) if r["kind"] == kind]) for kind in ("row", "column"))
    assert rows == pytest.approx(x, abs=1e-9) and columns == pytest.approx(y, abs=1e-9)
    assert all(r["inertia"] == pytest.approx(list(share), abs=1e-9) for r in got)


def test_bounds(spark):
    cells = spark.range(30).selectExpr("id AS a", "id % 12 AS b", "1 AS n")
    assert correspondence(cells, "a", "b", most=12).count() == 42  # rows are not bounded
    with pytest.raises(ValueError, match="more than 11 columns"):
        correspondence(cells, "a", "b", most=11)
    assert correspondence(cells.limit(0), "a", "b").collect() == []
    one = correspondence(spark.createDataFrame([("r", "c", 2)], "a string, b string, n int"), "a", "b").collect()
    assert all(r["coordinates"] == pytest.approx([0.0], abs=1e-9) for r in one)
