"""Model predictions: validity, coverage, uncertainty and label-error signals, error tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a prediction file.
SCHEMA = T.StructType([
    T.StructField("object_id", T.StringType()), T.StructField("true_label", T.StringType()), T.StructField("predicted_label", T.StringType()),
    T.StructField("predicted_proba", T.MapType(T.StringType(), T.DoubleType())), T.StructField("confidence", T.DoubleType()),
    T.StructField("split", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("model_version", T.StringType()),
    T.StructField("inference_timestamp", T.TimestampType()),
])


@dataclass(frozen=True)
class Thresholds:
    """Limits beyond which a signal becomes a reason."""

    label_error_confidence: float = 0.85
    label_error_margin: float = 0.6
    ambiguous_max_confidence: float = 0.6
    ambiguous_min_normalized_entropy: float = 0.7
    ambiguous_max_margin: float = 0.2
    label_support: float = 0.6


def reason_code(tolerance: float = 1e-6) -> Column:
    """Why a prediction row is invalid, NULL if it is not: the first of its broken invariants."""
    p = F.map_values("predicted_proba")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    best = F.array_max(p)
    return (
        F.when(F.col("object_id").isNull() | F.col("predicted_label").isNull() | F.col("predicted_proba").isNull(), "missing_required_field")
        .when((F.size("predicted_proba") == 0) | F.exists(p, lambda x: x.isNull() | ~x.between(0, 1)), "probability_out_of_range")
        .when(F.abs(total - 1) > tolerance, "probability_sum_mismatch")
        .when(F.coalesce(F.try_element_at("predicted_proba", F.col("predicted_label")), F.lit(-1.0)) < best - tolerance, "predicted_label_not_argmax")
        .when(F.abs(F.col("confidence") - best) > tolerance, "confidence_mismatch")
    )


def coverage(manifest: DataFrame, predictions: DataFrame, id_column: str = "object_id") -> DataFrame:
    """Ids in both, in predictions alone and in the manifest alone; the ratio is of the manifest's distinct ids."""
    left = manifest.select(F.col(id_column).alias("id")).distinct().withColumn("m", F.lit(1))
    right = predictions.select(F.col(id_column).alias("id")).distinct().withColumn("p", F.lit(1))
    m, p = F.col("m").isNotNull(), F.col("p").isNotNull()
    return left.join(right, "id", "full_outer").agg(
        F.count_if(m & p).alias("matched"), F.count_if(~m & p).alias("unmatched"), F.count_if(m & ~p).alias("missing"),
        F.when(F.count_if(m) > 0, F.count_if(m & p) / F.count_if(m)).otherwise(0.0).alias("coverage_ratio"),
    )


def signals(
    df: DataFrame, label: str = "true_label", neighbors: str | None = None, clusters: str | None = None, limits: Thresholds = Thresholds()
) -> DataFrame:
    """`df` with confidence, margin, entropy, conflict, scores and reason codes; needs predicted_label and predicted_proba.

    `neighbors` and `clusters` name map columns of label shares that support or contradict the prediction.
    """
    p = F.sort_array(F.map_values("predicted_proba"), asc=False)
    confidence = p[0]
    margin = F.when(F.size(p) >= 2, p[0] - F.get(p, F.lit(1))).otherwise(1.0)
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    out = (
        df.withColumn("confidence", confidence).withColumn("margin", margin).withColumn("entropy", entropy)
        .withColumn("normalized_entropy", F.when(F.size("predicted_proba") > 1, F.col("entropy") / F.ln(F.size("predicted_proba"))).otherwise(F.col("entropy")))
        .withColumn("label_conflict", F.col("predicted_label") != F.col(label))
    )
    c, m, e, bad = F.col("confidence"), F.col("margin"), F.col("normalized_entropy"), F.col("label_conflict")
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    support = [_support(n) for n in (neighbors, clusters) if n]
    parts = [c, m, F.greatest(F.lit(0.0), 1 - e), *[F.coalesce(s, F.lit(0.0)) for s in support]]
    error = sum(parts[1:], parts[0]) / len(parts)
    backed = F.lit(False)
    for s in support:
        backed = backed | F.coalesce(s >= limits.label_support, F.lit(False))
    vague = e >= limits.ambiguous_min_normalized_entropy
    reasons = F.array_compact(F.array(
        F.when((c <= limits.ambiguous_max_confidence) | (m <= limits.ambiguous_max_margin) | vague, "ambiguous_object"),
        F.when(vague, "high_model_uncertainty"),
        F.when(m <= limits.ambiguous_max_margin, "low_prediction_margin"),
        F.when(bad, "label_conflict"),
        F.when(bad & F.lit(not support), "label_support_not_available"),
        F.when(bad & backed, "neighbor_label_disagreement"),
        F.when(bad & (c >= limits.label_error_confidence), "probable_label_error"),
        F.when(bad & (c >= limits.label_error_confidence), "high_confidence_label_conflict"),
        F.when(bad & (m >= limits.label_error_margin), "large_margin_label_conflict"),
        F.when(bad & (e <= 1 - limits.label_error_margin), "low_entropy_label_conflict"),
    ))
    return (
        out.withColumn("ambiguous_object_score", unit((F.greatest(F.lit(0.0), 1 - c) + F.greatest(F.lit(0.0), 1 - m) + e) / 3))
        .withColumn("probable_label_error_score", F.when(bad, unit(error)).otherwise(0.0))
        .withColumn("reason_codes", reasons)
    )


def _support(column: str) -> Column:
    share = F.coalesce(F.try_element_at(column, F.col("predicted_label")), F.lit(0.0))
    return F.when(F.col(column).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def error_summary(df: DataFrame, label: str = "true_label") -> DataFrame:
    """Accuracy and counts over rows that have signals and a label."""
    has = lambda code: F.count_if(F.array_contains("reason_codes", code))
    return df.where(F.col(label).isNotNull()).agg(
        F.count("*").alias("evaluated"), F.avg((~F.col("label_conflict")).cast("double")).alias("accuracy"),
        F.count_if("label_conflict").alias("label_conflicts"), has("high_confidence_label_conflict").alias("high_confidence_errors"),
        has("ambiguous_object").alias("ambiguous"), has("probable_label_error").alias("probable_label_errors"),
    )


def confusion(df: DataFrame, label: str = "true_label") -> DataFrame:
    """(true_label, predicted_label, count)."""
    return df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("true_label"), "predicted_label").agg(F.count("*").alias("count"))


def error_concentration(df: DataFrame, by: str) -> DataFrame:
    """(group, evaluated, errors, error_rate) by a segment or by the true class."""
    return df.groupBy(F.col(by).cast("string").alias("group")).agg(
        F.count("*").alias("evaluated"), F.count_if("label_conflict").alias("errors"), F.avg(F.col("label_conflict").cast("double")).alias("error_rate")
    )
