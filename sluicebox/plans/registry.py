"""What the engine can do, and what its reason codes mean."""

from __future__ import annotations

from dataclasses import dataclass

#: Reason codes by category; those that block are listed below.
REASON_CODES = {
    "privacy": ("pii_unmasked", "external_api_raw_pii", "text_pii_detected"),
    "schema": ("target_column_missing",),
    "leakage": ("split_leakage", "target_leakage_candidate"),
    "business_rules": ("business_rule_failure",),
    "plugin_readiness": ("plugin_disabled",),
    "method_policy": ("method_disabled_by_policy", "method_disabled_by_readiness"),
    "missingness": ("missing_numeric",),
    "duplicates": ("exact_duplicate",),
    "class_balance": ("rare_class_underrepresented",),
    "outliers": ("severe_outlier", "outlier_capping_disabled_by_policy"),
    "model_error": (
        "ambiguous_object", "high_model_uncertainty", "low_prediction_margin", "probable_label_error",
        "high_confidence_label_conflict", "neighbor_label_disagreement",
    ),
}
BLOCKING = frozenset({
    "pii_unmasked", "external_api_raw_pii", "target_column_missing", "split_leakage", "target_leakage_candidate", "business_rule_failure",
})


@dataclass(frozen=True)
class Capability:
    """A family of operators: what it reads, how ready it is, and which modules hold it."""

    modalities: tuple[str, ...]
    readiness: str
    modules: tuple[str, ...]


CAPABILITIES = {
    "tabular": Capability(("tabular",), "implemented", ("operators.profile", "operators.rules", "operators.actions", "operators.splits", "operators.synthetic")),
    "text_ocr": Capability(("text", "document_ocr"), "implemented", ("operators.text", "operators.pii")),
    "predictions": Capability(("tabular", "text", "document_ocr"), "implemented", ("operators.predictions", "operators.impact")),
    "decisions": Capability(("tabular", "text", "document_ocr"), "implemented", ("operators.passports", "operators.decisions", "operators.gates")),
    "image": Capability(("image",), "contract_ready", ()),
    "audio": Capability(("audio",), "contract_ready", ()),
    "video": Capability(("video",), "contract_ready", ()),
}


def category_of(code: str) -> str | None:
    """The category of a reason code, None for an unknown one."""
    return next((k for k, codes in REASON_CODES.items() if code in codes), None)


def egress_allowed(profile: str, provider: str | None, allowlist: frozenset[str], raw_pii: bool) -> tuple[bool, str | None]:
    """Whether data may go to an outside service: never with raw personal data, else only to a listed provider.

    The engine itself calls none.
    """
    if raw_pii:
        return False, "external_api_raw_pii"
    if profile == "banking_strict" or provider is None or provider not in allowlist:
        return False, "provider_not_allowed"
    return True, None


#: Fixed value: capping of outliers is reported and never done.
OUTLIER_CAPPING = "outlier_capping_disabled_by_policy"
