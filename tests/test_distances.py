"""Searches of nearest rows against brute force, and how much they compare."""

import math

import numpy as np
import pytest

from sluicebox.operators import distances, gates, synthetic

R = np.random.default_rng(7)


def near_pairs(n, width):
    """Rows, and rows on the way from one of them to another, a few very near."""
    rows = R.normal(size=(n, width))
    share = np.concatenate([R.random(n - 3), [1e-5, 1e-7, 3e-7]])
    return rows + share[:, None] * (R.permutation(rows) - rows), rows


CASES = {
    "near": near_pairs(60, 8),
    "one dimension": near_pairs(60, 1),
    "grid": (R.integers(0, 3, size=(50, 6)).astype(float), R.integers(0, 3, size=(60, 6)).astype(float)),
    "copies": (np.repeat(R.normal(size=(4, 5)), 12, axis=0), np.concatenate([np.repeat(R.normal(size=(2, 5)), 30, axis=0), R.normal(size=(9, 5))])),
    "far from zero": tuple(x + 1e7 for x in near_pairs(50, 5)),
    "unlike scales": tuple(x * np.array([1e9, 1.0, 1e-6, 1.0, 0.0, 1.0]) for x in near_pairs(50, 6)),
    "no numbers": (np.where(R.random((40, 5)) < 0.1, np.nan, R.integers(0, 4, (40, 5))), np.where(R.random((40, 5)) < 0.1, np.inf, R.integers(0, 4, (40, 5)))),
    "squares overflow": (np.array([[1e200, 0.0], [1e200, 1.0], [0.0, 0.0]]), np.array([[1e200, 0.0], [3.0, 4.0], [-1e200, 0.0]])),
    "none": (np.zeros((0, 3)), R.normal(size=(5, 3))),
}


def squares(a, b):
    out = np.zeros((len(a), len(b)))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def frame(spark, points, ids=None):
    rows = [(int(i), p.tolist()) for i, p in zip(range(len(points)) if ids is None else ids, points)]
    return spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("pairs", [0, 1000])
def test_closest(spark, monkeypatch, name, pairs):
    monkeypatch.setattr(distances, "FIRST", 5)
    monkeypatch.setattr(distances, "PAIRS", pairs)
    a, b = CASES[name]
    d = np.sqrt(squares(a, b))
    d = np.where(np.isfinite(d), d, np.inf).min(axis=1, initial=np.inf)
    got = distances.closest(frame(spark, a), frame(spark, b), 1e-6).collect()
    least = d.min(initial=np.inf)
    assert [tuple(r) for r in got] == [(None if math.isinf(least) else least, int((d <= 1e-6).sum()))]


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("others", [False, True])
def test_nearest_is_exact(spark, monkeypatch, name, others):
    monkeypatch.setattr(distances, "WORK", 100)
    monkeypatch.setattr(distances, "BLOCK_NUMBERS", 1000)
    a, b = CASES[name]
    names = np.arange(len(b)) // 2 * 3  # ids that occur twice
    d = squares(a, b)
    d[~np.isfinite(d)] = np.inf
    if others:
        d[np.arange(len(a))[:, None] == names[None, :]] = np.inf
    want = []
    for i, row in enumerate(d):
        best = sorted((x, int(n)) for x, n in zip(row, names) if math.isfinite(x))[:4]
        want += [(i, n, k + 1, math.sqrt(x)) for k, (x, n) in enumerate(best)]
    got = distances.nearest(frame(spark, a), frame(spark, b, names), 4, others).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_gates_search_few_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(distances, "FIRST", 20, raising=False)
    searched, search = [], distances._search
    monkeypatch.setattr(distances, "_search", lambda block, *rest: searched.append(len(block)) or search(block, *rest))
    made, real = near_pairs(400, 6)
    columns = [f"x{i}" for i in range(6)]
    of = lambda points: spark.createDataFrame([(i, *p.tolist()) for i, p in enumerate(points)], ["id", *columns])
    got = {r.gate: r.value for r in gates.synthetic_gates(of(made), of(real), columns, "id").collect()}
    d = np.sqrt(squares(made, real)).min(axis=1)
    assert got["synthetic_dcr"] == d.min() and got["synthetic_nearest_neighbor_privacy"] == (d <= 1e-6).sum() > 0
    assert sum(searched) <= 20


def test_neighbours_are_searched_once(spark):
    rows = [(f"o{i}", float(i * i % 17), "1" if i < 9 else "0") for i in range(40)]
    made = synthetic.smote(spark.createDataFrame(rows, "id string, x double, y string"), "y", "1", ["x"], "id")
    assert "InArrow" not in made._jdf.queryExecution().toString()
