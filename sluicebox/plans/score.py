"""The dataset score: weighted components and penalties, from aggregates only."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Weights of the components, penalties, and when duplicates and imbalance are severe.
WEIGHTS = {
    "completeness": 0.15, "validity": 0.15, "uniqueness": 0.12, "balance": 0.15, "privacy_safety": 0.18,
    "model_readiness": 0.15, "lineage_completeness": 0.10,
}
PENALTIES = {
    "unmasked_pii": -30.0, "split_leakage": -40.0, "target_leakage_candidate": -25.0, "severe_duplicates": -10.0,
    "severe_class_imbalance": -10.0,
}
SEVERE_DUPLICATES, SEVERE_RATIO, SEVERE_SHARE = 0.05, 10.0, 0.05


@dataclass(frozen=True)
class Facts:
    """What the score is made of; the defaults stand for reports that were not made."""

    total_cells: int = 0
    missing_cells: int = 0
    rule_pass_rates: tuple[float, ...] = ()
    has_profile: bool = False
    target_missing: bool = False
    rows: int = 0
    duplicate_rows: int = 0
    texts: int = 0
    valid_texts: int = 0
    duplicate_texts: int = 0
    pii_texts: int = 0
    redacted_texts: int = 0
    balance: float | None = None
    imbalance_ratio: float = 1.0
    minority_share: float = 1.0
    leakage_candidates: int = 0
    high_leakage: bool = False
    split_leakage: bool = False
    blockers: frozenset[str] = frozenset()
    lineage: tuple[object, ...] = ()


@dataclass(frozen=True)
class Score:
    value: float
    raw: float
    components: dict[str, float]
    weighted: dict[str, float]
    penalties: dict[str, float] = field(default_factory=dict)
    readiness: str = "ready_for_export"


def _unit(x: float) -> float:
    return min(1.0, max(0.0, round(x, 6)))


def duplicate_ratio(f: Facts) -> float:
    """The larger share of duplicates, of rows or of texts."""
    return max(f.duplicate_rows / f.rows if f.rows else 0.0, f.duplicate_texts / f.valid_texts if f.valid_texts else 0.0)


def dataset_score(f: Facts) -> Score:
    """100 times the weighted components, plus penalties, within 0 to 100."""
    validity = ([sum(f.rule_pass_rates) / len(f.rule_pass_rates)] if f.rule_pass_rates else []) + (
        [0.0 if f.target_missing else 1.0] if f.has_profile else []
    ) + ([f.valid_texts / f.texts] if f.texts else [])
    unredacted = max(0, f.pii_texts - f.redacted_texts)
    pii = "PII_UNMASKED" in f.blockers
    split = f.split_leakage or "SPLIT_LEAKAGE" in f.blockers
    leak = "TARGET_LEAKAGE_CANDIDATE" in f.blockers
    ready = 0.0 if split or leak else 0.3 if f.leakage_candidates else 0.0 if f.target_missing else 1.0
    components = {
        "completeness": _unit(1 - f.missing_cells / f.total_cells) if f.total_cells else 1.0,
        "validity": _unit(sum(validity) / len(validity)) if validity else 1.0,
        "uniqueness": _unit(1 - duplicate_ratio(f)),
        "balance": 1.0 if f.balance is None else _unit(f.balance),
        "privacy_safety": 0.0 if pii else _unit(1 - unredacted / f.valid_texts) if f.valid_texts else 1.0,
        "model_readiness": ready,
        "lineage_completeness": sum(map(bool, f.lineage)) / len(f.lineage) if f.lineage else 1.0,
    }
    weighted = {k: WEIGHTS[k] * v for k, v in components.items()}
    applied = {
        "unmasked_pii": pii or unredacted > 0, "split_leakage": split, "target_leakage_candidate": leak or f.high_leakage or f.leakage_candidates > 0,
        "severe_duplicates": duplicate_ratio(f) >= SEVERE_DUPLICATES,
        "severe_class_imbalance": f.balance is not None and (f.imbalance_ratio >= SEVERE_RATIO or f.minority_share <= SEVERE_SHARE),
    }
    penalties = {k: PENALTIES[k] for k, on in applied.items() if on}
    raw = min(100.0, max(0.0, 100 * sum(weighted.values()) + sum(penalties.values())))
    readiness = "blocked" if f.blockers else "ready_with_warnings" if penalties else "ready_for_export"
    return Score(round(raw / 100, 6), round(raw, 6), components, weighted, penalties, readiness)
