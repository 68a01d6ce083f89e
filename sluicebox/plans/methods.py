"""Recommended methods with their scores, and action plans made of them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import functions as F

from sluicebox.functions.digests import stable_digest, stable_id

#: Weights of a method's score, and for each method its status, quality, risk, cost, explainability,
#: expected model impact and policy compatibility.
WEIGHTS = {"quality": 0.30, "risk": -0.20, "cost": -0.10, "explainability": 0.10, "impact": 0.15, "policy": 0.15}
IMPUTATION = {
    "group_median": ("available", 0.72, 0.12, 0.18, 0.94, 0.72, 0.95),
    "median": ("available", 0.70, 0.08, 0.08, 0.98, 0.55, 0.95),
    "missingness_indicator": ("available", 0.66, 0.06, 0.10, 0.92, 0.58, 0.90),
    "pmm": ("disabled_by_policy", 0.86, 0.18, 0.45, 0.56, 0.70, 0.20),
}
SEGMENT_QUALITY = 0.84
RARE_CLASS = {
    "class_weights": ("recommended", 0.76, 0.05, 0.06, 0.90, 0.68, 0.95),
    "undersampling_majority": ("available", 0.62, 0.20, 0.08, 0.84, 0.52, 0.82),
    "rare_case_review": ("available", 0.70, 0.04, 0.35, 0.96, 0.50, 0.90),
    "collect_more_real_data": ("available", 0.88, 0.02, 0.82, 0.98, 0.82, 0.88),
    "smote": ("disabled_by_readiness", 0.78, 0.22, 0.22, 0.66, 0.74, 0.72),
    "gaussian_copula": ("available", 0.66, 0.28, 0.34, 0.58, 0.48, 0.64),
    "borderline_smote": ("disabled_by_readiness", 0.80, 0.30, 0.30, 0.58, 0.70, 0.46),
    "adasyn": ("disabled_by_readiness", 0.74, 0.36, 0.32, 0.52, 0.66, 0.42),
    "ctgan": ("disabled_by_policy", 0.82, 0.42, 0.70, 0.34, 0.64, 0.18),
}
#: Augmentation fills the rare class up to this share of the largest one, from so many neighbours.
AUGMENTATION = {"strategy": 0.20, "k": 3}
SEGMENT_GAP, RARE_SHARE, IMBALANCE = 0.20, 0.10, 3.0
SYNTHETIC = frozenset({"smote", "gaussian_copula", "borderline_smote", "adasyn", "ctgan"})
#: Gates that a step must pass.
GATES = ("schema_validation", "business_rules", "privacy", "split_leakage")
SYNTHETIC_GATES = (*GATES, "synthetic_dcr", "synthetic_exact_duplicate_to_real", "synthetic_nearest_neighbor_privacy", "model_impact")


@dataclass(frozen=True)
class Method:
    """A candidate method with its score."""

    method_id: str
    status: str
    score: float


@dataclass(frozen=True)
class Recommendation:
    """An action with its candidate methods; `blocked` ones can never be chosen."""

    recommendation_id: str
    action: str
    subject: str
    recommended: str
    candidates: tuple[Method, ...]
    reason_codes: tuple[str, ...]
    blocked: tuple[str, ...] = ()


def method_score(quality: float, risk: float, cost: float, explainability: float, impact: float, policy: float) -> float:
    """The weighted sum, within 0 to 1."""
    parts = dict(quality=quality, risk=risk, cost=cost, explainability=explainability, impact=impact, policy=policy)
    return min(1.0, max(0.0, round(sum(WEIGHTS[k] * v for k, v in parts.items()), 6)))


def _methods(table: dict[str, tuple]) -> tuple[Method, ...]:
    return tuple(Method(name, status, method_score(*figures)) for name, (status, *figures) in table.items())


def recommend_imputation(column: str, target: str | None, segment_ratios: Iterable[float] = ()) -> Recommendation:
    """How to fill a numeric column: by group where missing cells depend on the segment, else by the median."""
    ratios = list(segment_ratios)
    by_segment = bool(ratios) and max(ratios) - min(ratios) >= SEGMENT_GAP
    best = "group_median" if by_segment else "median"
    table = dict(IMPUTATION)
    if by_segment:
        table["group_median"] = ("available", SEGMENT_QUALITY, *table["group_median"][2:])
    methods = tuple(replace(m, status="recommended") if m.method_id == best else m for m in _methods(table))
    reasons = ("skewed_numeric_distribution", *(("segment_dependent_missingness",) if by_segment else ()), "target_safe" if target else "target_not_declared")
    return Recommendation(stable_id("rec", ["impute", column]), "IMPUTE_MISSING_VALUES", column, best, methods, reasons, ("target_imputation",))


def recommend_rare_class(target: str, share: float, ratio: float, has_split: bool = False) -> Recommendation | None:
    """What to do about a rare class, if there is one. SMOTE is ready as soon as there is a split."""
    if share > RARE_SHARE and ratio < IMBALANCE:
        return None
    methods = tuple(replace(m, status="available") if m.method_id == "smote" and has_split else m for m in _methods(RARE_CLASS))
    reasons = ("rare_class_underrepresented", "train_time_safe_no_dataset_mutation", "split_required_for_synthetic_augmentation")
    return Recommendation(stable_id("rec", ["rare", target]), "AUGMENT_RARE_CLASS", target, "class_weights", methods, reasons)


def recommendations(columns: list[dict], target: str | None, segments: dict[str, list[float]], imbalance: dict | None, has_split: bool = False) -> list[Recommendation]:
    """All recommendations from a column profile (column, inferred_type, null_count) and the class imbalance."""
    out = [
        recommend_imputation(c["column"], target, segments.get(c["column"], ()))
        for c in columns
        if c["null_count"] > 0 and c["inferred_type"] in ("numeric_integer", "numeric_float") and c["column"] != target
    ]
    rare = recommend_rare_class(target, imbalance["rare_class_ratio"], imbalance["imbalance_ratio"], has_split) if imbalance and target else None
    return out + ([rare] if rare else [])


@dataclass(frozen=True)
class Step:
    """One step of a plan, with the key that makes its execution idempotent."""

    step_id: str
    step_type: str
    method_id: str
    subject: str
    depends_on: tuple[str, ...]
    gates: tuple[str, ...]
    preconditions: tuple[str, ...]
    output: str
    random_seed: int | None
    scope: str = "candidate_only"
    idempotency_key: str = ""

    def keyed(self) -> Step:
        return replace(self, idempotency_key=stable_digest({**asdict(self), "idempotency_key": ""}))


@dataclass(frozen=True)
class Plan:
    """Steps in order; it runs only with the approval of just this plan."""

    plan_id: str
    source_version: str
    steps: tuple[Step, ...]
    mode: str = "PREVIEW_ACTION_PLAN"
    requires_approval: bool = True

    def integrity(self) -> str:
        return stable_digest(asdict(self))


def preview(recommended: list[Recommendation], source_version: str, overrides: dict[str, str] | None = None) -> Plan:
    """A plan of the recommended methods, or of those that override them; unselectable ones are refused."""
    overrides, steps = overrides or {}, []
    for r in recommended:
        name = overrides.get(r.recommendation_id, r.recommended)
        if name in r.blocked:
            raise ValueError(f"method_blocked: {name}")
        found = next((m for m in r.candidates if m.method_id == name), None)
        if found is None:
            raise ValueError(f"method_not_found: {name}")
        if found.status not in ("recommended", "available"):
            raise ValueError(f"method_not_selectable: {name}")
        weights = r.action == "AUGMENT_RARE_CLASS" and name == "class_weights"
        before = ["source_version_is_immutable"]
        before += ["target_column_not_used_for_imputation"] if r.action == "IMPUTE_MISSING_VALUES" else []
        before += ["train_split_exists", "leakage_checks_passed"] if name in SYNTHETIC else []
        steps.append(Step(
            stable_id("step", [r.recommendation_id, name]), "CONFIGURE_CLASS_WEIGHTS" if weights else r.action, name, r.subject,
            (steps[-1].step_id,) if steps else (), SYNTHETIC_GATES if name in SYNTHETIC else GATES, tuple(before),
            "TRAINING_STRATEGY_CONFIG" if weights else "CANDIDATE_DATASET_VERSION", 42 if name in SYNTHETIC else None,
        ).keyed())
    payload = {"source": source_version, "steps": [s.idempotency_key for s in steps], "overrides": overrides}
    return Plan(stable_id("action_plan", payload), source_version, tuple(steps))


def check_execution(plan: Plan, source_version: str, approval: dict | None) -> str:
    """Refuse a plan that was changed, is empty, belongs to another version, or is not approved; returns its digest."""
    if plan.source_version != source_version:
        raise ValueError("source_dataset_version_mismatch")
    if plan.mode != "PREVIEW_ACTION_PLAN":
        raise ValueError("action_plan_not_preview_mode")
    if not plan.steps:
        raise ValueError("action_plan_has_no_steps")
    for step in plan.steps:
        if step.keyed().idempotency_key != step.idempotency_key or step.scope != "candidate_only":
            raise ValueError("action_plan_step_integrity")
    digest = plan.integrity()
    if plan.requires_approval and approval is None:
        raise ValueError("approval_metadata_required")
    if approval is not None and (approval.get("plan_id") != plan.plan_id or approval.get("integrity") != digest):
        raise ValueError("approval_mismatch")
    return digest


def run_key(workflow: str, scope: dict, inputs: Iterable[str], config: str, **more) -> str:
    """The idempotency key of a run; input hashes count as a set, steps in their order."""
    return stable_digest({"workflow": workflow, "scope": scope, "inputs": sorted(set(inputs)), "config": config, **more})


def split_for(df, target: str, id_column: str, group: str | None = None):
    """(id_column, split) of every row by the group-stratified split, staged: all later uses see the same choices."""
    from sluicebox.operators import splits
    from sluicebox.session import staged_path

    key = splits.group_key(df.columns, group)
    rows = df.select(*dict.fromkeys([id_column, target, *([key] if key else [])]))
    parted = splits.group_stratified_split(rows, target, key, id_column).select(id_column, "split")
    path = staged_path(df.sparkSession, "split")
    parted.write.parquet(path)
    return df.sparkSession.read.schema(parted.schema).parquet(path)


def training_rows(df, split, content: list[str], id_column: str, group: str | None = None):
    """The train rows of `df` by the assignments `split`; refused if a row has none or the splits leak."""
    from sluicebox.operators import splits

    if splits.unassigned(df, split, id_column).limit(1).count():
        raise ValueError("split_incomplete")
    keyed = df.select(*content, *[F.col(c).alias(f"_{i}") for i, c in enumerate((id_column, group)) if c])
    parted = keyed.join(split.select(F.col(id_column).alias("_id"), F.col("split").alias("_split")), F.col("_0") == F.col("_id"))
    failed = splits.leakage_checks(parted, content, "_1" if group else None, split="_split").where("status = 'FAILED' and severity = 'BLOCKER'")
    found = sorted(r["check"] for r in failed.collect())
    if found:
        raise ValueError(f"leakage_checks_failed: {', '.join(found)}")
    return splits.split_rows(df, split, "train", id_column)


def execute(
    plan: Plan, df, target: str | None, id_column: str, approval: dict | None = None, group: str | None = None, signature: list[str] | None = None,
    split=None, split_group: str | None = None,
):
    """The candidate of an approved plan: its steps applied one after the other; lazy, and the source is untouched.

    `group` is the column of group medians. Rows are only made of train rows: by the assignments `split` (id_column,
    split), else by the group-stratified split with `split_group` or a known column as group. Equal contents or a group
    in several splits, or a row without a split, refuse the augmentation.
    """
    from sluicebox.operators import actions, splits, synthetic

    check_execution(plan, plan.source_version, approval)
    for step in plan.steps:
        content = signature or [c for c in df.columns if c != id_column]
        if step.step_type == "IMPUTE_MISSING_VALUES":
            df = actions.impute(df, step.subject, step.method_id, target, group)
        elif step.step_type == "MARK_DUPLICATES":
            df = actions.mark_duplicates(df, content, id_column)
        elif step.step_type == "REMOVE_DUPLICATES":
            df = actions.remove_duplicates(df, content, id_column)
        elif step.step_type == "AUGMENT_RARE_CLASS" and step.method_id == "smote":
            given = split_for(df, target, id_column, split_group) if split is None else split
            train = training_rows(df, given, content, id_column, splits.group_key(df.columns, split_group))
            rare = train.groupBy(target).count().orderBy("count", target).first()[0]
            features = synthetic.feature_columns(train, target, (id_column,))
            made = synthetic.smote(train, target, str(rare), features, id_column, seed=step.random_seed or 42, **AUGMENTATION)
            df = synthetic.augmented(df, made)
        elif step.step_type != "CONFIGURE_CLASS_WEIGHTS":
            raise ValueError(f"unsupported_step {step.step_type}")
    return df
