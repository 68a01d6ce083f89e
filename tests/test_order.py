"""Running totals, quantiles and numbers against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.operators import actions, order


@pytest.mark.parametrize("make", [lambda r: r.normal(size=997), lambda r: r.integers(0, 5, 500).astype(float), lambda r: r.exponential(size=300) ** 4, lambda r: np.array([3.0])])
def test_quantiles(spark, make):
    x = make(np.random.default_rng(7))
    df = spark.createDataFrame([(float(v), float(-v)) for v in x] + [(None, float("nan"))], "a double, b double").repartition(5)
    levels = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r["column"]: (r.n, r.q) for r in order.quantiles(df, ["a", "b"], levels).collect()}
    for name, v in (("a", x), ("b", -x)):
        assert got[name][0] == len(x) and np.allclose(got[name][1], np.quantile(v, levels))


def test_running_totals(spark):
    r = np.random.default_rng(8)
    rows = [(k, float(v), int(n)) for k in "xyz" for v, n in zip(r.permutation(400), r.integers(1, 9, 400))]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    for down in (False, True):
        got = {(x.k, x.v): x.run_n for x in order.running_totals(df, "v", ["n"], "k", down).collect()}
        for k in "xyz":
            run = 0
            for _, v, n in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1] if down else x[1]):
                run += n
                assert got[k, v] == run


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("key"))
    a = {x.key: x.n for x in order.numbered(df, "key", "n").collect()}
    assert sorted(a.values()) == list(range(1000)) and a == {x.key: x.n for x in order.numbered(df.repartition(9), "key", "n").collect()}


def test_medians(spark):
    r = np.random.default_rng(9)
    g, x = r.integers(0, 4, 301), r.integers(0, 40, 301).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)] + [(None, 5.0)], "g long, x double")
    got = {m.g: m["median"] for m in actions.median_by(df, "x", "g").collect()}
    assert got == {**{k: float(np.median(x[g == k])) for k in range(4)}, None: 5.0}
    assert actions.impute(df.where("x is null"), "x", "median").count() == 0
