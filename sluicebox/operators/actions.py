"""Non-destructive fixes: imputation and duplicate handling. A result is a new DataFrame, the input is untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox.functions.digests import row_signature
from sluicebox.operators.order import beside, middles, quantiles
from sluicebox.session import stage

METHODS = ("median", "mode", "group_median", "missingness_indicator")


def median_decimal(df: DataFrame, column: str, scale: int = 6, by: list[str] | None = None) -> DataFrame:
    """(by..., median): the exact decimal median, the mean of the two middle values where their number is even.

    Distinct values are counted first and ranked in ranges, so that no task sorts all values, nor all of a large group.
    """
    keys, x = by or [], F.col(column).cast(f"decimal(30,{scale})")
    counts = stage(df.where(x.isNotNull()).groupBy(*keys, x.alias("x")).agg(F.count("*").alias("n")), "median-counts")
    return middles(counts, "x", keys).select(*keys, ((F.col("low") + F.col("high")) / 2).alias("median"))


def median_by(df: DataFrame, column: str, group: str) -> DataFrame:
    """(g, median) by linear interpolation; also a group of most rows is ranked in ranges."""
    x = F.col(column).cast("double")
    counts = stage(df.where(F.col(column).isNotNull()).groupBy(F.col(group).alias("g"), x.alias("x")).agg(F.count("*").alias("n")), "median-counts")
    return middles(counts, "x", ["g"]).select("g", ((F.col("low") + F.col("high")) / 2).alias("median"))


def indicator(df: DataFrame, column: str) -> DataFrame:
    """`df` with <column>_was_missing, 1 or 0."""
    name = f"{column}_was_missing"
    if name in df.columns:
        raise ValueError(f"{name} exists")
    return df.withColumn(name, F.col(column).isNull().cast("int"))


def impute(df: DataFrame, column: str, method: str, target: str | None = None, group: str | None = None, flag: bool = False) -> DataFrame:
    """`df` with the missing values of `column` filled; a group without a median takes that of all rows.

    Fill values are one row, or one row for each group: the latter is joined, and broadcast only by Spark's own size test.
    """
    if column == target:
        raise ValueError("the target is never imputed")
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    out = indicator(df, column) if flag or method == "missingness_indicator" else df
    if method == "missingness_indicator":
        return out
    if method == "mode":
        # Equal counts: the smallest value.
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_fill")).count()
        fill = counts.agg(F.min_by("_fill", F.struct(-F.col("count"), F.col("_fill"))).alias("_fill"))
    else:
        fill = quantiles(df, [column], [0.5]).select(F.col("q")[0].alias("_fill"))
    out = beside(out, fill)
    value = F.coalesce(F.col(column), F.col("_fill"))
    if method == "group_median":
        if group is None:
            raise ValueError("group_median needs a group column")
        by = median_by(df, column, group).toDF("_group", "_group_fill")
        out = out.join(by, out[group].eqNullSafe(by["_group"]), "left")
        value = F.coalesce(F.col(column), F.col("_group_fill"), F.col("_fill"))
    return out.withColumn(column, value).drop("_fill", "_group", "_group_fill")


def _place(columns: list[str], id_column: str, tie: str | None) -> tuple[Column, W]:
    order = [F.col(id_column)] + ([F.col(tie)] if tie else [])
    return row_signature(*columns), order


def remove_duplicates(df: DataFrame, columns: list[str], id_column: str, tie: str | None = None) -> DataFrame:
    """`df` with one row of each group that is equal in `columns`: that of the smallest id, then of the smallest `tie`.

    The row is found by a partial minimum and not by ranking, so a group of any size costs its tasks one row each.
    """
    signature, order = _place(columns, id_column, tie)
    rest = [c for c in df.columns if c not in (id_column, tie)]
    first = [id_column, *([tie] if tie else [])]
    whole = F.struct(*first, *rest)
    return df.select(signature.alias("_s"), whole.alias("_row")).groupBy("_s").agg(F.min("_row").alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def mark_duplicates(df: DataFrame, columns: list[str], id_column: str, tie: str | None = None) -> DataFrame:
    """`df` with is_duplicate_candidate, duplicate_group_id and is_duplicate_kept; no row goes.

    Groups are numbered in the order of their signatures. The numbering ranks duplicate groups only.
    """
    signature, order = _place(columns, id_column, tie)
    rows = df.withColumn("_s", signature)
    best = F.struct(*order)
    groups = rows.groupBy("_s").agg(F.count("*").alias("_n"), F.min(best).alias("_best")).where("_n > 1")
    # Ranks in two steps: within ranges of signatures, then by the offsets of the ranges.
    ranges = groups.withColumn("_r", F.substring("_s", 1, 2))
    offsets = ranges.groupBy("_r").count().withColumn("_off", F.coalesce(F.sum("count").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranges.withColumn("_k", F.row_number().over(W.partitionBy("_r").orderBy("_s"))).join(F.broadcast(offsets.select("_r", "_off")), "_r")
    named = numbered.select("_s", "_best", F.format_string("duplicate_group_%04d", F.col("_k") + F.col("_off") - 1).alias("_name"))
    joined = rows.join(named, "_s", "left")
    return joined.select(
        *df.columns, F.col("_name").isNotNull().alias("is_duplicate_candidate"), F.col("_name").alias("duplicate_group_id"),
        F.coalesce(best == F.col("_best"), F.lit(True)).alias("is_duplicate_kept"),
    )
