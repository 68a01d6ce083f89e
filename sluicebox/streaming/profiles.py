"""Streaming forms of the operators that can be kept up to date row by row: counts, missing cells, classes, rules.

Quartiles, nearest neighbours and greedy splits need all rows and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.operators import pii
from sluicebox.operators.profile import cells_of
from sluicebox.operators.rules import Rule, violations


def timed(rows: DataFrame, time: str) -> DataFrame:
    """`rows` with the event time as a timestamp, which watermarks need, also where it came without a zone."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "5 minutes", late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Rows, and the sum of a value, by time window and columns; rows later than the watermark are dropped."""
    sums = [F.count("*").alias("rows")] + ([F.sum(value).alias("total")] if value else [])
    grouped = timed(events, time).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(*sums)
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "rows", *(["total"] if value else []))


def missing_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Running totals of rows and missing cells by column; for update or complete mode."""
    return cells_of(rows, columns).groupBy("column").agg(
        F.count("*").alias("total_count"), F.count_if(F.col("value").isNull() | (F.col("value") == "")).alias("missing_count")
    )


def class_totals(rows: DataFrame, target: str) -> DataFrame:
    """Running totals by class."""
    return rows.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).count()


def rule_violations(rows: DataFrame, rules: tuple[Rule, ...], id_column: str) -> DataFrame:
    """Violations as they come; no state."""
    return violations(rows, rules, id_column)


def redacted(rows: DataFrame, text: str = "text") -> DataFrame:
    """Redacted records as they come; no state."""
    return pii.redact(rows, text)


def first_by_id(rows: DataFrame, id_column: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first record of each id within the watermark; later ones are dropped and their state with them."""
    return timed(rows, time).withWatermark(time, late).dropDuplicatesWithinWatermark([id_column])
