"""Synthetic rows: interpolation of rare rows (SMOTE), a Gaussian copula, and their validation.

All randomness is a hash of the seed and the number of the row, so a result does not depend on partitions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.cells import number
from sluicebox.operators.distances import nearest
from sluicebox.operators.order import numbered, quantiles, value_counts
from sluicebox.session import stage

MARKER, SOURCE_SPLIT = "is_synthetic", "synthetic_source_split"
LEVELS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
RIDGE, CLAMP = 1e-6, 1e-6


def uniform(seed: int, stream: str, i: Column) -> Column:
    """A number in [0, 1) for row i of a named stream: 52 bits of an MD5, so that any engine gives the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{stream}:"), i.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") * 2.0**-52


def feature_columns(df: DataFrame, target: str, ids: tuple[str, ...] = ()) -> list[str]:
    """The columns whose known cells are all numbers, without ids, the target, markers and missingness flags."""
    names = [c for c in df.columns if c not in (target, MARKER, SOURCE_SPLIT, *ids) and not c.endswith("_was_missing")]
    raw = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    tests = df.agg(*[F.coalesce(F.bool_and(F.when(raw(c).isNotNull(), number(raw(c)).isNotNull())), F.lit(False)).alias(c) for c in names]).first() if names else {}
    return [c for c in names if tests[c]]


def smote_target(rare: int, majority: int, strategy: float) -> int:
    """Rare rows after the augmentation: a share of the majority, rounded half to even, never fewer than now."""
    return max(rare, round(majority * strategy))


def smote(train: DataFrame, target: str, rare: str, features: list[str], id_column: str, strategy: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """New rows of the rare class between a rare row and one of its k nearest rare rows: columns of `train`,
    markers, seed_id, neighbor_id and lambda. Only train rows must be given; other columns are the seed row's.

    Neighbours are searched once for each rare row, not once for each new row.
    """
    label = F.col(target).cast("string")
    counts = {r["label"]: r["count"] for r in train.groupBy(label.alias("label")).count().collect()}
    n = counts.get(rare, 0)
    if n < 2 or not features:
        raise ValueError("needs two rare rows and a numeric column")
    new = smote_target(n, max(counts.values()), strategy) - n
    # Features travel as one array, and are columns again at the end: code for each of many columns can't be compiled.
    cells = F.array(*[F.col(f).try_cast("double") for f in features])
    void = [c for c, t in train.dtypes if t == "void"]
    rows = train.where(label == rare).withColumn("_cells", cells).drop(*features, *void)
    keyed = stage(numbered(rows, id_column, "_k"), "rare")
    points = keyed.select(F.col("_k").alias("id"), F.transform("_cells", lambda x: F.coalesce(x, F.lit(0.0))).alias("vector"))
    near = stage(nearest(points, points, min(k, n - 1), exclude_same_id=True), "neighbours")
    i = F.col("id")
    draws = train.sparkSession.range(new).select(
        i.alias("_i"), F.floor(uniform(seed, "seed", i) * n).cast("long").alias("_seed"),
        (F.floor(uniform(seed, "neighbor", i) * min(k, n - 1)) + 1).cast("int").alias("_rank"), uniform(seed, "lambda", i).alias("lambda"),
    )
    picked = draws.join(near.select(F.col("query_id").alias("_seed"), F.col("rank").alias("_rank"), F.col("id").alias("_other")), ["_seed", "_rank"])
    other = keyed.select(F.col("_k").alias("_other"), F.col(id_column).alias("neighbor_id"), F.col("_cells").alias("_near"))
    between = F.zip_with("_cells", "_near", lambda a, b: F.coalesce(a + F.col("lambda") * (b - a), a))
    joined = picked.join(keyed.withColumnRenamed("_k", "_seed"), "_seed").join(other, "_other").withColumn("_made", between)
    kept = {f: F.col("_made")[j] for j, f in enumerate(features)} | {id_column: F.format_string("synthetic_%06d", F.col("_i"))} | {c: F.lit(None) for c in void}
    made = [kept.get(c, F.col(c)).alias(c) for c in train.columns]
    return joined.select(*made, F.lit(1).alias(MARKER), F.lit("train").alias(SOURCE_SPLIT), F.col(id_column).cast("string").alias("seed_id"), F.col("neighbor_id").cast("string").alias("neighbor_id"), "lambda")


def augmented(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Real rows, marked 0, and synthetic rows, marked 1, with the columns of the real ones and the markers."""
    marked = real.withColumn(MARKER, F.lit(0)).withColumn(SOURCE_SPLIT, F.lit(None).cast("string"))
    made = dict(synthetic.dtypes)
    # New ids are texts: where the real column is not, it becomes one.
    marked = marked.select(*[F.col(c).cast("string").alias(c) if made[c] == "string" != t else F.col(c) for c, t in marked.dtypes])
    return marked.unionByName(synthetic.select(*[F.col(c).cast(t).alias(c) for c, t in marked.dtypes]))


# --------------------------------------------------------------------------- copula


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation) of all pairs of columns in one pass; a constant column correlates with none."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    # corr itself divides by zero for a constant column.
    r = lambda a, b: F.try_divide(F.covar_pop(x(a), x(b)), F.stddev_pop(x(a)) * F.stddev_pop(x(b)))
    one = df.agg(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.lit(1.0) if a == b else F.coalesce(F.nanvl(r(a, b), F.lit(0.0)), F.lit(0.0))).alias("r"))
        for a, b in pairs
    ]).alias("m"))
    limited = F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("r"))))
    return one.select(F.inline("m")).select("a", "b", limited.alias("correlation"))


def quantile_grid(df: DataFrame, columns: list[str], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(column, level, value): quantiles by linear interpolation."""
    grid = F.array(*[F.lit(x) for x in levels])
    rows = quantiles(df, columns, list(levels))
    return rows.select("column", F.inline(F.arrays_zip(grid.alias("level"), F.col("q").alias("value")))).toDF("column", "level", "value")


def cholesky(matrix: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The lower factor of a matrix with a small ridge; it has as many rows as there are columns in the data."""
    m = matrix + ridge * np.eye(len(matrix))
    try:
        return np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        w, v = np.linalg.eigh(m)
        return np.linalg.cholesky(v @ np.diag(np.maximum(w, ridge)) @ v.T + ridge * np.eye(len(m)))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, by a rational approximation (error below 2e-7)."""
    a = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-a * a)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def inverse_ecdf(u: Column, levels: tuple[float, ...], values: list[float]) -> Column:
    """The value at a share of the distribution, linear between the levels."""
    x = F.least(F.lit(1 - CLAMP), F.greatest(F.lit(CLAMP), u))
    out = F.when(F.lit(False), F.lit(0.0))
    for (a, va), (b, vb) in zip(zip(levels, values), zip(levels[1:], values[1:])):
        out = out.when(x <= b, F.lit(float(va)) + (x - a) / (b - a) * (float(vb) - float(va)))
    return out.otherwise(F.lit(float(values[-1])))


def copula(train: DataFrame, target: str, features: list[str], id_column: str, strategy: float = 0.2, seed: int = 42) -> DataFrame:
    """New rows with the train rows' marginal distributions and correlations; labels in the proportion of the train labels.

    What is fitted is as large as the number of columns; rows are made where they lie, by number.
    """
    numbers = train.select(*[F.col(f).try_cast("double").alias(f) for f in features])
    counts = value_counts(numbers, features)
    found = {r["column"]: r["q"] for r in quantiles(numbers, features, [0.5, *LEVELS], counts).collect()}
    median = {f: q[0] for f, q in found.items()}
    filled = train.select(*[F.coalesce(F.col(f).try_cast("double"), F.lit(median.get(f)), F.lit(0.0)).alias(f) for f in features], F.col(target).cast("string").alias("_label"))
    place = {f: i for i, f in enumerate(features)}
    r = np.eye(len(features))
    for row in correlation(filled, features).collect():
        r[place[row["a"]], place[row["b"]]] = r[place[row["b"]], place[row["a"]]] = row["correlation"]
    lower = cholesky(r)
    lacking = [F.count_if(F.col(f).try_cast("double").isNull()).alias(f"_m{k}") for k, f in enumerate(features)]
    by_label = train.groupBy(F.col(target).cast("string").alias("_label")).agg(F.count("*").alias("_n"), *lacking).collect()
    missing = [(f, median.get(f, 0.0), n) for k, f in enumerate(features) if (n := sum(x[f"_m{k}"] for x in by_label))]
    if missing:  # cells that are filled weigh on their column's median
        more = train.sparkSession.createDataFrame(missing, "column string, x double, n long")
        counts = stage(counts.unionByName(more).groupBy("column", "x").agg(F.sum("n").alias("n")), "filled-counts")
        found = {r["column"]: r["q"] for r in quantiles(filled, features, [0.5, *LEVELS], counts).collect()}
    grid = {f: found[f][1:] for f in features}
    labels = sorted((x["_label"], x["_n"]) for x in by_label)
    total = sum(n for _, n in labels)
    new = max(0, round(total * (1 + strategy)) - total)
    i = F.col("id")
    # Box and Muller: two uniform numbers make a normal one.
    normal = lambda f: F.sqrt(-2 * F.ln(1 - uniform(seed, f"a{f}", i))) * F.cos(2 * math.pi * uniform(seed, f"b{f}", i))
    rows = train.sparkSession.range(new).select("id", *[normal(f).alias(f"_z{k}") for k, f in enumerate(features)])
    share, label = 0.0, F.when(F.lit(False), F.lit(""))
    for name, n in labels[:-1]:
        share += n / total
        label = label.when(uniform(seed, "label", i) < share, F.lit(name))
    label = label.otherwise(F.lit(labels[-1][0]))
    mixed = lambda k: sum((F.col(f"_z{j}") * float(lower[k, j]) for j in range(k + 1)), F.lit(0.0))
    return rows.select(
        F.format_string("synthetic_gc_%06d", i).alias(id_column),
        *[inverse_ecdf(normal_cdf(mixed(k)), LEVELS, grid[f]).alias(f) for k, f in enumerate(features)],
        label.alias(target), F.lit(1).alias(MARKER), F.lit("train").alias(SOURCE_SPLIT),
    )


def validate(real: DataFrame, synthetic: DataFrame, features: list[str], rules=()) -> DataFrame:
    """(check, status, value): schema, numeric types, share of business rules that hold, rows that equal a real one."""
    from sluicebox.operators.gates import exact_copies
    from sluicebox.operators.rules import rule_summary

    spark = synthetic.sparkSession
    lacking = [f for f in features if f not in synthetic.columns]
    rows = [("schema_match", "FAILED" if lacking else "PASSED", float(len(lacking)))]
    out = spark.createDataFrame(rows, "check string, status string, value double")
    there = [f for f in features if f in synthetic.columns]
    odd = sum((F.count_if(F.col(f).isNotNull() & number(F.col(f).cast("string")).isNull()) for f in there), F.lit(0))
    status = lambda bad: F.when(bad, "FAILED").otherwise("PASSED")
    out = out.unionByName(synthetic.agg(odd.cast("double").alias("value")).select(F.lit("type_match").alias("check"), status(F.col("value") > 0).alias("status"), "value"))
    if rules:
        rate = rule_summary(synthetic, rules).agg(F.avg("pass_rate").alias("value"))
        out = out.unionByName(rate.select(F.lit("business_rules_pass_rate").alias("check"), status(F.col("value") < 1).alias("status"), "value"))
    same = exact_copies(synthetic, real, there).agg(F.count("*").cast("double").alias("value"))
    return out.unionByName(same.select(F.lit("privacy_exact_duplicate_to_real").alias("check"), status(F.col("value") > 0).alias("status"), "value"))
