"""Tabular profiling: columns and their types, missing values, duplicates, outliers, class imbalance, leakage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions import cells
from sluicebox.functions.digests import row_signature
from sluicebox.operators.order import quantiles, value_counts

#: Names by which columns get their roles.
TARGETS = ("is_fraud", "label", "target")
GROUP_KEYS = ("customer_id_hash", "customer_id", "case_id", "case_id_hash", "household_id", "group_id")
ID_COLUMNS = ("object_id", "row_id", "transaction_id", "document_id", "support_ticket_id")
PII_NAMES = (r"(^|_)e?mail($|_)", r"(^|_)phone($|_)", r"(^|_)passport($|_)", r"(^|_)ssn($|_)", r"(^|_)full_?name($|_)", r"(^|_)address($|_)")
LEAKAGE_NAMES = (r"manual_review", r"is_fraud_predict", r"target_leak")
OUTLIER_COLUMNS = ("amount", "transaction_amount", "monthly_income")
#: The share of matches that makes a leak, the fence of outliers, the base of effective numbers.
LEAKAGE_MATCH, FENCE, BETA = 0.5, 1.5, 0.999


def target_column(columns: list[str], wanted: str | None = None) -> str | None:
    """The wanted target column, or the first known name among the columns."""
    if wanted is not None:
        return wanted if wanted in columns else None
    return next((t for t in TARGETS if t in columns), None)


def column_role(column: str, target: str | None) -> str:
    """The role of a column by its name: personal data before leakage, identity, group and target."""
    if any(re.search(p, column, re.I) for p in PII_NAMES):
        return "pii_like"
    if any(re.search(p, column, re.I) for p in LEAKAGE_NAMES):
        return "leakage_candidate"
    if column in ID_COLUMNS:
        return "id"
    if column in GROUP_KEYS:
        return "group_key"
    return "target" if column == target else "unknown"


def cells_of(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., column, value): the cells as strings, one row each."""
    keep = keep or []
    return df.select(*keep, *[F.col(c).cast("string").alias(f"_v_{c}") for c in columns]).unpivot(
        keep, [f"_v_{c}" for c in columns], "column", "value"
    ).withColumn("column", F.substring("column", 4, 1 << 20))


def column_profile(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row for each column: rows, nulls, distinct values, the first value by `order`, constancy and type.

    Cells are grouped by column and value first, with partial sums before the shuffle; the tests for types then run
    over distinct values only. Values of columns that are named like personal data are not shown.
    """
    values = cells_of(df, columns, [order]).groupBy("column", F.nullif("value", F.lit("")).alias("value")).agg(
        F.count("*").alias("n"), F.min(order).alias("at")
    )
    v, known = F.col("value"), F.col("value").isNotNull()
    integer, truth, moment = cells.is_integer(v), cells.is_truth(v), cells.is_moment(v)
    number = cells.is_number(v) & ~integer

    def seen(test: Column) -> Column:
        return F.coalesce(F.bool_or(known & test), F.lit(False))

    sums = values.groupBy("column").agg(
        F.sum("n").alias("total_count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min_by("value", F.when(known, F.col("at"))).alias("first_value"),
        seen(truth).alias("truth"), seen(integer).alias("integer"), seen(number).alias("number"), seen(moment).alias("moment"),
        seen(~(truth | integer | number | moment)).alias("text"),
        F.coalesce(F.bool_and(F.when(known, cells.is_identifier(v))), F.lit(True)).alias("identifier"),
        F.coalesce(F.bool_and(F.when(known, v.isin("0", "1"))), F.lit(False)).alias("binary"),
    )
    share = F.col("distinct_count") / (F.col("total_count") - F.col("null_count"))
    kind = (
        F.when(F.col("distinct_count") == 0, "unknown")
        .when(F.col("truth") & ~F.col("text") & ~F.col("number") & ~F.col("moment"), "boolean")
        .when(F.col("integer") & ~F.col("text") & ~F.col("number") & ~F.col("moment") & F.col("binary"), "boolean")
        .when(F.col("integer") & ~F.col("text") & ~F.col("number") & ~F.col("moment"), "numeric_integer")
        .when((F.col("number") | F.col("integer")) & ~F.col("text") & ~F.col("moment"), "numeric_float")
        .when(F.col("moment") & ~F.col("text") & ~F.col("integer") & ~F.col("number"), "datetime")
        .when(F.col("identifier") & (share >= 0.9), "identifier")
        .when(F.col("text") & (share < 0.5) & (F.col("distinct_count") <= 50), "categorical")
        .when(F.col("text"), "text")
        .otherwise("unknown")
    )
    shown = [c for c in columns if column_role(c, None) != "pii_like"]
    return sums.select(
        "column", "total_count", "null_count",
        F.when(F.col("total_count") > 0, F.col("null_count") / F.col("total_count")).otherwise(0.0).alias("null_ratio"),
        "distinct_count",
        F.when(F.col("column").isin(*shown), F.col("first_value")).alias("sample_value") if shown else F.lit(None).cast("string").alias("sample_value"),
        ((F.col("total_count") > 0) & (F.col("distinct_count") <= 1)).alias("is_constant"),
        kind.alias("inferred_type"),
    )


def missingness(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Missing cells of each column, in all rows and by each value of the group columns.

    group_column is NULL for all rows. Rows whose group value is missing count in no group of that column.
    """
    rows = cells_of(df, columns, [*groups])
    missing = F.count_if(F.col("value").isNull() | (F.col("value") == "")).alias("missing_count")
    if not groups:
        counted = rows.groupBy("column").agg(F.count("*").alias("total_count"), missing).select(
            "column", F.lit(None).cast("string").alias("group_column"), F.lit(None).cast("string").alias("group_value"), "total_count", "missing_count"
        )
    else:
        sets = [[F.col("column")], *[[F.col("column"), F.col(g)] for g in groups]]
        grouped = rows.groupingSets(sets, F.col("column"), *[F.col(g) for g in groups]).agg(
            F.count("*").alias("total_count"), missing, *[F.grouping(g).alias(f"_g_{g}") for g in groups]
        )
        name = F.coalesce(*[F.when(F.col(f"_g_{g}") == 0, F.lit(g)) for g in groups])
        value = F.coalesce(*[F.when(F.col(f"_g_{g}") == 0, F.col(g).cast("string")) for g in groups])
        counted = grouped.select("column", name.alias("group_column"), value.alias("group_value"), "total_count", "missing_count")
        counted = counted.where(F.col("group_column").isNull() | (F.coalesce("group_value", F.lit("")) != ""))
    return counted.withColumn("missing_ratio", F.col("missing_count") / F.col("total_count"))


def duplicate_groups(df: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """(signature, group_size, canonical_id) of the rows that are equal in `columns`; the smallest id stands for a group."""
    rows = df.select(row_signature(*columns).alias("signature"), F.col(id_column).alias("id"))
    return rows.groupBy("signature").agg(F.count("*").alias("group_size"), F.min("id").alias("canonical_id")).where("group_size > 1")


def duplicate_members(df: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """(id, signature, group_size, canonical_id) of every row of a duplicate group."""
    rows = df.select(row_signature(*columns).alias("signature"), F.col(id_column).alias("id"))
    return rows.join(duplicate_groups(df, columns, id_column), "signature").select("id", "signature", "group_size", "canonical_id")


def duplicate_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Duplicate groups, the rows in them, and pairs: the rows beyond the first of each group."""
    sizes = df.groupBy(row_signature(*columns).alias("signature")).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.sum("n").alias("row_count"),
        F.count_if(F.col("n") > 1).alias("group_count"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("affected_rows"),
        F.sum(F.col("n") - 1).alias("pair_count"),
    )


def fences(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """(column, n, q1, q3, low, high): quartiles by linear interpolation, and fences 1.5 interquartile ranges off."""
    stats = quantiles(df, columns, [0.25, 0.75], counts)
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return stats.select("column", "n", q1.alias("q1"), q3.alias("q3"), (q1 - FENCE * (q3 - q1)).alias("low"), (q3 + FENCE * (q3 - q1)).alias("high"))


def outliers(df: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """(id, column, value) of every value strictly outside the fences of its column."""
    bounds = fences(df, columns)
    rows = df.select(F.col(id_column).alias("id"), F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("i", "value"))
    named = rows.withColumn("column", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)).drop("i")
    # One row for each column: a side of a fixed size.
    return named.join(F.broadcast(bounds.select("column", "low", "high")), "column").where("value < low or value > high").select("id", "column", "value")


def outlier_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """The fences of each column and the number of values beyond them."""
    counts = value_counts(df, columns)
    bounds = fences(df, columns, counts)
    beyond = F.sum(F.when((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), counts["n"]).otherwise(0))
    # One row for each column: a side of a fixed size.
    joined = counts.join(F.broadcast(bounds.withColumnRenamed("n", "_known")), "column")
    return joined.groupBy("column", F.col("_known").alias("n"), "q1", "q3", "low", "high").agg(beyond.alias("outlier_count"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(label, count, effective_number) of each class; rows without a label don't count."""
    counts = df.where(F.col(target).isNotNull() & (F.col(target).cast("string") != "")).groupBy(F.col(target).cast("string").alias("label")).count()
    return counts.withColumn("effective_number", (1 - F.pow(F.lit(BETA), F.col("count"))) / (1 - BETA))


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: the rarest class (of equal ones the first by name), its share, and measures of balance."""
    rare = F.min(F.struct("count", "label"))
    one = class_counts(df, target).agg(
        F.sum("count").alias("total_samples"), F.count("*").alias("classes"), rare.alias("rare"), F.max("count").alias("most")
    ).where("total_samples > 0")
    n = F.col("rare.count")
    ratio = F.col("most") / n
    return one.select(
        "total_samples", F.col("rare.label").alias("rare_class_label"), n.alias("rare_class_count"),
        (n / F.col("total_samples")).alias("rare_class_ratio"), ratio.alias("imbalance_ratio"),
        F.least(F.lit(1.0), 1 / F.log1p(ratio)).alias("balance_score"),
        F.least(F.lit(1.0), n * F.col("classes") / F.col("total_samples")).alias("balance_score_alternative"),
    )


def leakage_candidates(df: DataFrame, target: str, candidates: list[str] | None = None) -> DataFrame:
    """(column, reason_code, target_match_rate) of the columns that are named like leaks, or of those given."""
    names = candidates if candidates is not None else [c for c in df.columns if any(re.search(p, c, re.I) for p in LEAKAGE_NAMES)]
    t = F.nullif(F.col(target).cast("string"), F.lit(""))

    def rate(c: str) -> Column:
        x = F.nullif(F.col(c).cast("string"), F.lit(""))
        return F.avg(F.when(x.isNotNull() & t.isNotNull(), (x == t).cast("double")))

    if not names:
        return df.sparkSession.createDataFrame([], "column string, reason_code string, target_match_rate double")
    rates = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), rate(c).alias("target_match_rate")) for c in names]).alias("r"))
    reason = F.when(F.col("target_match_rate") >= LEAKAGE_MATCH, "high_target_match_rate").otherwise("name_pattern_leakage_candidate")
    return rates.select(F.inline("r")).select("column", reason.alias("reason_code"), "target_match_rate")
