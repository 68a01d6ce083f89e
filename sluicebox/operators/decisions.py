"""Decisions: the value of every object, hard gates, recommended actions, review queues and the dataset's readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of an object's value, thresholds of the recommendation rules, order of primary reasons.
WEIGHTS = {
    "learning_value": 0.25, "rarity": 0.20, "uncertainty": 0.20, "diversity": 0.15, "business_importance": 0.10,
    "duplicate_penalty": -0.15, "quality_penalty": -0.10, "privacy_risk_penalty": -0.25, "label_risk_penalty": -0.10,
}
RULES = {
    "missing_numeric": 0.1, "exact_duplicate": 0.5, "rare_class_underrepresented": 0.7, "text_pii_detected": 0.01,
    "severe_outlier": 0.75, "ambiguous_object": 0.5, "probable_label_error": 0.5,
}
COMPONENT_REASONS = (
    ("exact_duplicate", "duplicate_penalty", 0.5), ("rare_class_underrepresented", "rarity", 0.7), ("text_pii_detected", "privacy_risk_penalty", 0.0),
    ("severe_outlier", "quality_penalty", 0.75), ("ambiguous_object", "uncertainty", 0.5), ("probable_label_error", "label_risk_penalty", 0.5),
)
PRIMARY = (
    "probable_label_error", "ambiguous_object", "text_pii_detected", "pii_unmasked", "exact_duplicate",
    "rare_class_underrepresented", "missing_numeric",
)
PII_GATE = 0.80
#: Dataset gates by their id: what blocks if its flag is set.
HARD_GATES = {
    "pii_unmasked": "BLOCK_PRIVACY_REVIEW", "target_column_missing": "BLOCK_TRAINING", "split_leakage": "BLOCK_MODEL_EVALUATION",
    "external_api_raw_pii": "BLOCK_EXTERNAL_API_CALL", "target_leakage_candidate": "BLOCK_TRAINING", "business_rule_failure": "BLOCK_RULES_REVIEW",
    "plugin_disabled": "BLOCK_PLUGIN_EXECUTION", "method_disabled_by_policy": "BLOCK_METHOD", "method_disabled_by_readiness": "BLOCK_METHOD",
}


def hard_gates(
    pii_unmasked: bool = False, target_column_missing: bool = False, split_leakage: bool = False, external_api_raw_pii: bool = False,
    target_leakage_candidate: bool = False, business_rule_failure: bool = False, plugins: dict[str, str] | None = None, methods: tuple[str, ...] = (),
) -> tuple[str, ...]:
    """The dataset's gates that facts trigger, in order; `plugins` has states by name, `methods` the states of those asked for."""
    triggered = {
        "pii_unmasked": pii_unmasked, "target_column_missing": target_column_missing, "split_leakage": split_leakage,
        "external_api_raw_pii": external_api_raw_pii, "target_leakage_candidate": target_leakage_candidate,
        "business_rule_failure": business_rule_failure, "plugin_disabled": "disabled" in (plugins or {}).values(),
        "method_disabled_by_policy": "disabled_by_policy" in methods, "method_disabled_by_readiness": "disabled_by_readiness" in methods,
    }
    return tuple(g for g in HARD_GATES if triggered[g])


def critical_blockers(decided: DataFrame, dataset_gates: tuple[str, ...] = (), examples: int = 3) -> DataFrame:
    """(code, severity, action, objects, examples): one row for each gate that blocks, the dataset's or an object's.

    `objects` counts the blocked ones; of them the first few by id stand as examples, so a row stays small.
    """
    gates = F.array(*[F.lit(g) for g in HARD_GATES])
    action = F.create_map(*[F.lit(x) for pair in HARD_GATES.items() for x in pair])
    own = decided.where("hard_blocked").select("object_id", F.explode(F.array_intersect(gates, F.col("reason_codes"))).alias("gate"))
    # Ranges of ids by hash give their first few before the shuffle; of those the first few are taken.
    part = F.pmod(F.xxhash64("object_id"), F.lit(256))
    few = own.groupBy("gate", part.alias("_p")).agg(F.count("*").alias("n"), *[F.min("object_id").alias("first")])
    counted = few.groupBy("gate").agg(F.sum("n").alias("objects"), F.slice(F.array_sort(F.collect_list("first")), 1, examples).alias("examples"))
    named = decided.sparkSession.createDataFrame([(g,) for g in dataset_gates], "gate string")
    both = named.join(counted, "gate", "full_outer")
    return both.select(
        F.upper("gate").alias("code"), F.lit("critical").alias("severity"), action[F.col("gate")].alias("action"),
        F.coalesce("objects", F.lit(0)).cast("long").alias("objects"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )


def value(name: str, default: float = 0.0) -> Column:
    """A signal of a passport, or a default where it is not available."""
    return F.coalesce(F.col(name), F.lit(default))


def object_value(passport: DataFrame) -> DataFrame:
    """`passport` with the nine components, raw_value and object_value, clamped to 0..1."""
    uncertainty = F.coalesce("model_uncertainty", "prediction_entropy", "ambiguous_object_score", 1 - F.col("prediction_confidence"), F.lit(0.0))
    rare, risk, error = value("rare_segment_score"), value("label_issue_score"), value("probable_label_error_score")
    parts = {
        "learning_value": F.greatest(rare, uncertainty, value("ambiguous_object_score"), error, risk), "rarity": rare, "uncertainty": uncertainty,
        "diversity": F.lit(0.0), "business_importance": value("business_importance"), "duplicate_penalty": value("duplicate_score"),
        "quality_penalty": 1 - value("technical_quality", 1.0), "privacy_risk_penalty": value("privacy_risk"), "label_risk_penalty": F.greatest(risk, error),
    }
    raw = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    return passport.withColumns(parts).withColumn("raw_value", raw).withColumn("object_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw_value"))))


def decide(valued: DataFrame, dataset_gates: tuple[str, ...] = ()) -> DataFrame:
    """`valued` with hard_blocked, recommended rules, action and reason_codes; gates come before scores.

    An object is blocked by a gate of the dataset, or by its own privacy risk. `missing_numeric` never applies to an object.
    """
    own = F.coalesce(F.col("privacy_risk") >= PII_GATE, F.lit(False))
    gates = F.array_compact(F.array(
        *[F.when((own | F.lit(g in dataset_gates)) if g == "pii_unmasked" else F.lit(g in dataset_gates), F.lit(g)) for g in HARD_GATES]
    ))
    at_least = lambda c, r: F.coalesce(F.col(c) >= RULES[r], F.lit(False))
    fits = {
        "exact_duplicate": at_least("duplicate_score", "exact_duplicate"),
        "rare_class_underrepresented": at_least("rare_segment_score", "rare_class_underrepresented"),
        "text_pii_detected": F.col("modality").isin("text", "document_ocr") & at_least("privacy_risk", "text_pii_detected"),
        "severe_outlier": F.coalesce(F.col("technical_quality") <= 1 - RULES["severe_outlier"], F.lit(False)),
        "ambiguous_object": at_least("ambiguous_object_score", "ambiguous_object"),
        "probable_label_error": at_least("probable_label_error_score", "probable_label_error"),
    }
    more = {"ambiguous_object": ("high_model_uncertainty", "low_prediction_margin"), "probable_label_error": ("high_confidence_label_conflict",)}
    texts = lambda *names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    recommended = F.flatten(F.array(*[F.when(test, texts(r, *more.get(r, ()))).otherwise(texts()) for r, test in fits.items()]))
    parts = F.array_compact(F.array(*[
        F.when(F.col(c) > t if t == 0 else F.col(c) >= t, F.lit(r)) for r, c, t in COMPONENT_REASONS
    ]))
    has = lambda r: F.array_contains("recommended", r)
    action = (
        F.when(F.col("hard_blocked"), "BLOCK_EXPORT")
        .when(has("probable_label_error") | has("ambiguous_object"), "SEND_TO_LABEL_REVIEW")
        .when(has("text_pii_detected"), "SEND_TO_PRIVACY_REVIEW")
        .when(has("exact_duplicate"), "REMOVE_DUPLICATE")
        .when(has("rare_class_underrepresented"), "AUGMENT_RARE_CLASS")
        .otherwise("KEEP")
    )
    codes = F.array_distinct(F.concat("recommended", "gates", parts, "gates"))
    return (
        valued.withColumn("gates", gates).withColumn("hard_blocked", F.size("gates") > 0).withColumn("recommended", recommended)
        .withColumn("action", action).withColumn("reason_codes", F.when(F.size(codes) == 0, texts("export_ready")).otherwise(codes)).drop("gates")
    )


def recommended_action() -> Column:
    """The follow-up of an object's decision: none for what stays or is blocked, but for personal data a review."""
    blocked = F.when(F.array_contains("reason_codes", "pii_unmasked"), "SEND_TO_PRIVACY_REVIEW")
    return F.when(F.col("action").isin("KEEP", "EXPORT_READY"), F.lit(None).cast("string")).when(F.col("action") == "BLOCK_EXPORT", blocked).otherwise(F.col("action"))


def primary_reason() -> Column:
    """The first reason in order of weight, else the first at all."""
    order = F.array(*[F.lit(x) for x in PRIMARY])
    return F.coalesce(F.get(F.array_intersect(order, F.col("reason_codes")), F.lit(0)), F.get("reason_codes", F.lit(0)), F.lit("review_required"))


def action_groups(decided: DataFrame) -> DataFrame:
    """(recommended_action, modality, primary_reason, objects, mean_value) of all follow-ups."""
    return (
        decided.select(recommended_action().alias("recommended_action"), "modality", primary_reason().alias("primary_reason"), "object_value")
        .where("recommended_action is not null").groupBy("recommended_action", "modality", "primary_reason")
        .agg(F.count("*").alias("objects"), F.avg("object_value").alias("mean_value"))
    )


def readiness(decided: DataFrame) -> DataFrame:
    """One row: status, score, decision and next job of the dataset."""
    one = decided.agg(F.count_if("hard_blocked").alias("blocked"), F.count(recommended_action()).alias("actions"), F.count("*").alias("objects"))
    blocked, waiting = F.col("blocked") > 0, F.col("actions") > 0
    pick = lambda a, b, c: F.when(blocked, a).when(waiting, b).otherwise(c)
    return one.select(
        "objects", "blocked", "actions", pick("BLOCKED", "NOT_READY_FOR_EXPORT", "READY_FOR_EXPORT").alias("readiness"), pick(0.0, 0.75, 1.0).alias("score"),
        pick("BLOCKED", "NEEDS_REVIEW", "READY_FOR_TRAINING").alias("decision"),
        F.when(waiting, "PREVIEW_ACTION_PLAN").when(blocked, F.lit(None).cast("string")).otherwise("EXPORT").alias("next_job"),
    )


def reason_counts(decided: DataFrame) -> DataFrame:
    """(reason_code, objects)."""
    return decided.select(F.explode("reason_codes").alias("reason_code")).groupBy("reason_code").agg(F.count("*").alias("objects"))


#: Signals that may be shown with a queued object: numbers only, never its content.
SAFE_SIGNALS = (
    "technical_quality", "privacy_risk", "duplicate_score", "rare_segment_score", "model_uncertainty", "ambiguous_object_score",
    "probable_label_error_score",
)


def safe_previews(decided: DataFrame, queue: DataFrame) -> DataFrame:
    """`queue` with a preview of each object: its type, reasons and numeric signals."""
    shown = decided.select("object_id", F.struct("object_type", "action", *[F.round(s, 6).alias(s) for s in SAFE_SIGNALS]).alias("preview"))
    return queue.join(shown, "object_id", "left")


def review_queue(decided: DataFrame) -> DataFrame:
    """(queue, object_id, reasons, priority, may_leave): an object may be in several queues, in label review twice.

    A consumer orders by queue, -priority, object_id. Missing signals count 0, a missing margin or quality 1.
    """
    has = lambda r: F.array_contains("reason_codes", r)
    texts = lambda *names: F.array(*[F.lit(n) for n in names])
    only = lambda *names: F.filter("reason_codes", lambda c: c.isin(*names))
    member = lambda test, queue, reasons, priority: F.when(
        test, F.struct(F.lit(queue).alias("queue"), reasons.alias("reasons"), priority.alias("priority"))
    )
    doubt = F.greatest(value("ambiguous_object_score"), value("model_uncertainty"), 1 - value("prediction_margin", 1.0))
    error_reasons = F.concat(texts("probable_label_error", "high_confidence_label_conflict"), only("neighbor_label_disagreement"))
    members = F.array_compact(F.array(
        member(has("ambiguous_object"), "label_review", texts("high_model_uncertainty", "low_prediction_margin", "ambiguous_object"), doubt),
        member(has("probable_label_error"), "label_review", error_reasons, F.greatest(value("probable_label_error_score"), value("prediction_confidence"))),
        member((F.col("action") == "SEND_TO_PRIVACY_REVIEW") | has("text_pii_detected") | has("pii_unmasked"), "privacy_review",
               F.concat(only("text_pii_detected", "pii_unmasked"), texts("privacy_review_required")), value("privacy_risk")),
        member((F.col("action") == "REMOVE_DUPLICATE") | has("exact_duplicate") | has("duplicate_candidate"), "duplicate_review",
               F.concat(only("exact_duplicate", "duplicate_candidate"), texts("duplicate_review_required")), value("duplicate_score")),
        member(has("missing_numeric") | has("target_column_missing") | has("business_rule_failure"), "annotation_review",
               F.concat(only("missing_numeric", "target_column_missing", "business_rule_failure"), texts("schema_review_required")), 1 - value("technical_quality", 1.0)),
    ))
    rows = decided.select("object_id", "object_type", F.inline(members))
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round("priority", 6)))
    return rows.select("queue", "object_id", "object_type", "reasons", bounded.alias("priority"), (F.col("queue") == "label_review").alias("may_leave"))
