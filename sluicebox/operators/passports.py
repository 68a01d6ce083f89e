"""Object passports and evidence: what is known of every object, joined from the operators' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deductions from an object's quality, confidence in signals, object types.
DEDUCTIONS = {"outlier": 0.2, "rule": 0.3, "text_issue": 0.4}
CONFIDENCE = {"technical_quality": 0.95, "duplicate_score": 0.9, "privacy_risk": 0.9}
PREDICTION_CONFIDENCE = 0.82
OBJECT_TYPES = {"tabular": "table_row", "text": "text_record", "document_ocr": "ocr_record", "image": "image_asset", "video": "video_asset", "audio": "audio_asset"}
PREDICTION_SIGNALS = (
    "label_issue_score", "model_uncertainty", "prediction_confidence", "prediction_margin", "prediction_entropy",
    "ambiguous_object_score", "probable_label_error_score",
)
SIGNALS = ("technical_quality", "privacy_risk", "duplicate_score", "rare_segment_score", "business_importance", *PREDICTION_SIGNALS)


def object_type(modality: Column) -> Column:
    """The type of an object by its modality."""
    out = F.when(F.lit(False), F.lit(""))
    for name, value in OBJECT_TYPES.items():
        out = out.when(modality == name, F.lit(value))
    return out.otherwise(F.lit("multimodal_case"))


def passports(
    manifest: DataFrame, text: DataFrame | None = None, predictions: DataFrame | None = None, duplicates: DataFrame | None = None,
    outliers: DataFrame | None = None, violations: DataFrame | None = None, rare_label: str | None = None, rare_share: float | None = None,
) -> DataFrame:
    """One row for each object of `manifest` (object_id, modality, label): quality, privacy, duplicates, learning value.

    Others are joined by object_id: `text` (has_issue, pii_risk_score, pii_token_count, is_duplicate), `predictions`
    (the columns of predictions.signals), `duplicates` (ids), `outliers` and `violations` (object_id and column or
    rule_id, any number of rows). Modalities that are not profiled get NULL signals.
    """
    profiled = F.col("modality").isin("tabular", "text", "document_ocr")
    tabular, textual = F.col("modality") == "tabular", F.col("modality").isin("text", "document_ocr")
    out = manifest
    for df, columns in ((text, ["has_issue", "pii_risk_score", "pii_token_count", "is_duplicate"]), (predictions, None)):
        if df is not None:
            out = out.join(df.select("object_id", *columns) if columns else df, "object_id", "left")
    for df, source, name in ((duplicates, None, "_dup"), (outliers, "column", "outlier_columns"), (violations, "rule_id", "rule_ids")):
        if df is not None:
            value = F.lit(True) if source is None else F.array_sort(F.collect_set(source))
            out = out.join(df.groupBy("object_id").agg(value.alias(name)), "object_id", "left")
    have = set(out.columns)
    col = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    empty = F.array().cast("array<string>")
    out = out.withColumn("outlier_columns", F.coalesce(col("outlier_columns", "array<string>"), empty))
    out = out.withColumn("rule_ids", F.coalesce(col("rule_ids", "array<string>"), empty))
    yes = lambda c: F.coalesce(c, F.lit(False))
    lost = (
        F.when(tabular & (F.size("outlier_columns") > 0), DEDUCTIONS["outlier"]).otherwise(0.0)
        + F.when(tabular & (F.size("rule_ids") > 0), DEDUCTIONS["rule"]).otherwise(0.0)
        + F.when(textual & yes(col("has_issue", "boolean")), DEDUCTIONS["text_issue"]).otherwise(0.0)
    )
    rare = F.lit(None).cast("double") if rare_share is None else F.when(
        F.coalesce(F.col("label").cast("string") == rare_label, F.lit(False)), F.lit(max(0.0, min(1.0, 1.0 - rare_share)))
    ).otherwise(0.0)
    duplicate = F.when(tabular, yes(col("_dup", "boolean"))).otherwise(yes(col("is_duplicate", "boolean")))
    return out.select(
        "object_id", "modality", object_type(F.col("modality")).alias("object_type"), F.col("label").cast("string").alias("label"), profiled.alias("profiled"),
        F.when(profiled, F.greatest(F.lit(0.0), 1 - lost)).alias("technical_quality"),
        F.when(profiled, F.when(textual, F.coalesce(col("pii_risk_score", "double"), F.lit(0.0))).otherwise(0.0)).alias("privacy_risk"),
        F.when(profiled, yes(textual & (col("pii_token_count", "long") > 0))).alias("pii_detected"),
        F.when(profiled, duplicate.cast("double")).alias("duplicate_score"),
        F.when(profiled, rare).alias("rare_segment_score"),
        F.lit(None).cast("double").alias("business_importance"),
        F.when(profiled, col("probable_label_error_score", "double")).alias("label_issue_score"),
        F.when(profiled, 1 - col("confidence", "double")).alias("model_uncertainty"),
        F.when(profiled, col("confidence", "double")).alias("prediction_confidence"),
        F.when(profiled, col("margin", "double")).alias("prediction_margin"),
        F.when(profiled, col("normalized_entropy", "double")).alias("prediction_entropy"),
        F.when(profiled, col("ambiguous_object_score", "double")).alias("ambiguous_object_score"),
        F.when(profiled, col("probable_label_error_score", "double")).alias("probable_label_error_score"),
        "outlier_columns", "rule_ids",
    ).withColumn("decision_value_score", F.greatest("rare_segment_score", "ambiguous_object_score", "probable_label_error_score")).withColumn(
        "export_eligibility", F.when(~F.col("profiled"), "policy_review_required").when(F.col("pii_detected"), "redacted_only").otherwise("allowed")
    ).withColumn("decision_hints", hints())


def hints() -> Column:
    """What a passport hints at, sorted."""
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    found = F.array_sort(F.array_compact(F.array(
        F.when(F.coalesce("pii_detected", F.lit(False)), "pii_detected"), F.when(positive("duplicate_score"), "duplicate_candidate"),
        F.when(positive("probable_label_error_score"), "probable_label_error"), F.when(positive("ambiguous_object_score"), "ambiguous_object"),
        F.when(F.coalesce(F.col("technical_quality") < 1, F.lit(False)), "technical_quality_issue"),
    )))
    return (
        F.when(~F.col("profiled"), F.array(F.lit("validated_skeleton_only")))
        .when(F.size(found) == 0, F.array(F.lit("profiled_no_blocker_candidate"))).otherwise(found)
    )


def evidence(passport: DataFrame) -> DataFrame:
    """(object_id, object_type, modality, signals, confidence): each signal a value with status and reason."""
    def signal(name: str) -> Column:
        reason = F.when(~F.col("profiled"), "skeleton_modality_not_profiled")
        if name in PREDICTION_SIGNALS:
            reason = F.when(F.col("prediction_confidence").isNull(), "prediction_manifest_not_provided").otherwise("prediction_signal_not_available")
        else:
            reason = reason.otherwise(f"{name}_not_available")
        x = F.col(name)
        return F.struct(x.alias("value"), F.when(x.isNotNull(), "available").otherwise("not_applicable").alias("status"), F.when(x.isNull(), reason).alias("reason")).alias(name)

    sure = {**CONFIDENCE, **dict.fromkeys(PREDICTION_SIGNALS, PREDICTION_CONFIDENCE)}
    pairs = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n), F.lit(v))) for n, v in sure.items()]))
    return passport.select("object_id", "object_type", "modality", F.struct(*[signal(n) for n in SIGNALS]).alias("signals"), F.map_from_entries(pairs).alias("confidence"))
