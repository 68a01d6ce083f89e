"""The two workflows: analyse a dataset without touching it, and apply an approved plan to a candidate version."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.digests import stable_digest
from sluicebox.operators import decisions, passports, pii, predictions, profile, text
from sluicebox.operators.rules import Rule, rule_summary, violations
from sluicebox.plans import methods, versions
from sluicebox.plans.score import Facts, Score, dataset_score
from sluicebox.sources.files import manifest

#: What the two runtime profiles stand for.
PROFILES = {
    "demo_strict": {"pii_detection": "regex", "audit": "artifacts", "egress": "deny_unless_configured", "policies": "static_versioned_files"},
    "banking_strict": {"pii_detection": "stronger_rules", "audit": "append_only", "egress": "deny_by_default", "policies": "versioned_admin_workflow"},
}
#: The most milliseconds that a stage of the demo dataset may take.
CEILINGS = {
    "manifest_build": 5000, "prediction_validation": 5000, "model_error_analysis": 5000, "tabular_profile": 10000,
    "text_ocr_validation": 5000, "review_queue_build": 5000,
}


@dataclass(frozen=True)
class Config:
    """Settings of a run; columns are named here and nowhere assumed."""

    dataset: str
    version: str
    target: str
    id_column: str = "object_id"
    segment: str | None = None
    group: str | None = None
    labels: dict[str, str] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    outlier_columns: tuple[str, ...] = ()
    profile: str = "demo_strict"

    def digest(self) -> str:
        return stable_digest({**self.__dict__, "rules": [r.rule_id for r in self.rules]})


class StageTimer:
    """Durations of named stages, held against ceilings: the longest of a stage counts, one that never ran is missed."""

    def __init__(self) -> None:
        self.records: list[tuple[str, float]] = []

    @contextmanager
    def measure(self, stage: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.records.append((stage, round((time.perf_counter() - began) * 1000, 3)))

    def report(self, ceilings: dict[str, float]) -> dict:
        longest: dict[str, float] = {}
        for stage, ms in self.records:
            longest[stage] = max(ms, longest.get(stage, 0.0))
        missed = [s for s in ceilings if s not in longest]
        over = {s: round(longest[s] - m, 3) for s, m in ceilings.items() if longest.get(s, 0.0) > m}
        return {"timings": self.records, "missed": missed, "over": over, "passed": not missed and not over}

    def write(self, path: str, ceilings: dict[str, float]) -> None:
        with open(path, "w", encoding="utf-8") as file:
            file.write(json.dumps(self.report(ceilings), sort_keys=True, indent=2) + "\n")


class Metrics:
    """Counters, gauges and observed values by name and labels."""

    def __init__(self) -> None:
        self.values: dict[tuple, dict[str, float]] = {}

    def _at(self, name: str, labels: dict[str, str]) -> dict[str, float]:
        return self.values.setdefault((name, tuple(sorted(labels.items()))), {})

    def count(self, name: str, n: float = 1, **labels: str) -> None:
        at = self._at(name, labels)
        at["count"] = at.get("count", 0) + n

    def gauge(self, name: str, value: float, **labels: str) -> None:
        self._at(name, labels)["value"] = value

    def observe(self, name: str, value: float, **labels: str) -> None:
        at = self._at(name, labels)
        at.update(count=at.get("count", 0) + 1, sum=at.get("sum", 0) + value, min=min(at.get("min", value), value), max=max(at.get("max", value), value))


@dataclass
class Analysis:
    """The frames of an analysis, lazy, and the small documents made of them."""

    config: Config
    manifest: DataFrame
    columns: DataFrame
    missingness: DataFrame
    duplicates: DataFrame
    imbalance: DataFrame
    leakage: DataFrame
    rules: DataFrame | None
    texts: DataFrame | None
    predictions: DataFrame | None
    passports: DataFrame
    decided: DataFrame
    queue: DataFrame
    score: Score
    recommendations: list[methods.Recommendation]
    readiness: dict
    gates: tuple[str, ...] = ()
    blockers: tuple[str, ...] = ()

    def summary(self) -> dict:
        """The report of the run: what it covered, the score, what blocks, what is recommended."""
        reasons = {r["reason_code"]: r["objects"] for r in decisions.reason_counts(self.decided).collect()}
        return {
            "dataset": self.config.dataset, "version": self.config.version, "mutates_dataset": False, "config": self.config.digest(),
            "objects": self.readiness["objects"], "modalities": sorted(r[0] for r in self.passports.select("modality").distinct().collect()),
            "decision": self.readiness["decision"], "readiness": self.readiness["readiness"], "score": self.score.value,
            "predictions": "available" if self.predictions is not None else "prediction_manifest_not_provided",
            "ambiguous": reasons.get("ambiguous_object", 0), "probable_label_errors": reasons.get("probable_label_error", 0),
            "gates": list(self.gates), "blockers": list(self.blockers),
            "recommendations": [r.action for r in self.recommendations], "next_job": self.readiness["next_job"],
        }


def analyze(
    table: DataFrame, config: Config, texts: DataFrame | None = None, predicted: DataFrame | None = None, split_checks: DataFrame | None = None,
    redact: bool = True, plugins: dict[str, str] | None = None,
) -> Analysis:
    """Analyse a raw table of string columns with optional texts (object_id, text) and predictions.

    Predictions name rows of the table by its id column; `split_checks` are rows of splits.leakage_checks. Without
    `redact` personal data stays in the texts and counts as unmasked. Nothing is written but staged counts.
    """
    columns = [c for c in table.columns if c != "_row_idx"]
    order = "_row_idx" if "_row_idx" in table.columns else config.id_column
    features = [c for c in columns if c != config.id_column]
    prof = profile.column_profile(table, columns, order)
    groups = [g for g in (config.target, config.segment) if g]
    missing = profile.missingness(table, [c for c in columns if c not in (config.id_column, *groups)], groups)
    imbalance = profile.class_imbalance(table, config.target)
    leaks = profile.leakage_candidates(table, config.target)
    rows = manifest(table, config.version, "tabular", "table", config.id_column, columns, config.target, config.labels)
    ids = rows.select("object_id", F.col("row_key").alias("_key"))

    def as_objects(df: DataFrame, key: str) -> DataFrame:
        return df.join(ids, df[key].cast("string") == ids["_key"]).drop("_key")

    copies = as_objects(profile.duplicate_members(table, features, config.id_column), "id").select("object_id")
    outlying = as_objects(profile.outliers(table, list(config.outlier_columns), config.id_column), "id").select("object_id", "column") if config.outlier_columns else None
    broken = as_objects(violations(table, config.rules, config.id_column), "id").select("object_id", "rule_id") if config.rules else None
    signals = None
    if predicted is not None:
        matched = as_objects(predicted.where(predictions.reason_code().isNull()).withColumnRenamed("object_id", "_source"), "_source")
        labelled = matched.join(rows.where("label is not null").select("object_id", "label"), "object_id")
        signals = predictions.signals(labelled, "label").select("object_id", "confidence", "margin", "normalized_entropy", "ambiguous_object_score", "probable_label_error_score")
    valid = text_signals = None
    if texts is not None:
        valid = pii.redact(text.validate(texts))
        twins = text.duplicate_texts(valid).select(F.col("text_sha256"), F.lit(True).alias("is_duplicate"))
        text_signals = valid.withColumn("text_sha256", text.text_digest(F.col("text"))).join(twins, "text_sha256", "left").select(
            "object_id", F.col("reason_code").isNotNull().alias("has_issue"), "pii_risk_score", "pii_token_count", "is_duplicate"
        )
        rows = rows.unionByName(manifest(texts, config.version, "text", "texts", "object_id", ["object_id", "text"]).withColumn("object_id", F.col("row_key")))
    facts_row = imbalance.first()
    rare = None if facts_row is None else config.labels.get(facts_row["rare_class_label"], facts_row["rare_class_label"])
    passport = passports.passports(rows, text_signals, signals, copies, outlying, broken, rare, None if facts_row is None else facts_row["rare_class_ratio"])
    summary = rule_summary(table, config.rules) if config.rules else None
    ruled = summary.collect() if summary is not None else []
    leak_rows = leaks.collect()
    totals = pii.totals(valid).first() if valid is not None else None
    unmasked = 0 if redact or totals is None else totals["pii_record_count"]
    split_leak = split_checks is not None and split_checks.where("status = 'FAILED' and severity = 'BLOCKER'").limit(1).count() > 0
    high_leak = any(r["reason_code"] == "high_target_match_rate" for r in leak_rows)
    gates = decisions.hard_gates(
        pii_unmasked=unmasked > 0, target_column_missing=config.target not in table.columns, split_leakage=split_leak,
        target_leakage_candidate=high_leak, business_rule_failure=any(r["blocker"] for r in ruled), plugins=plugins,
    )
    decided = decisions.decide(decisions.object_value(passport), gates)
    blockers = tuple(sorted(r["code"] for r in decisions.critical_blockers(decided, gates).collect()))
    ready = decisions.readiness(decided).first().asDict()
    dup = profile.duplicate_summary(table, features).first()
    cells = prof.agg(F.sum("total_count").alias("t"), F.sum("null_count").alias("m")).first()
    copies_of = 0
    if valid is not None:
        copies_of = text.duplicate_texts(valid.where("reason_code is null")).agg(F.sum("group_size")).first()[0] or 0
    stats = text.source_stats(valid).first() if valid is not None else None
    score = dataset_score(Facts(
        total_cells=cells["t"] or 0, missing_cells=cells["m"] or 0, rule_pass_rates=tuple(r["pass_rate"] for r in ruled),
        has_profile=True, target_missing=config.target not in table.columns, rows=dup["row_count"] or 0, duplicate_rows=dup["affected_rows"],
        texts=stats["record_count"] if stats else 0, valid_texts=stats["valid_count"] if stats else 0, pii_texts=totals["pii_record_count"] if totals else 0,
        redacted_texts=totals["pii_record_count"] - unmasked if totals else 0, duplicate_texts=copies_of, split_leakage=split_leak, balance=facts_row["balance_score"] if facts_row else None,
        imbalance_ratio=facts_row["imbalance_ratio"] if facts_row else 1.0, minority_share=facts_row["rare_class_ratio"] if facts_row else 1.0,
        leakage_candidates=len(leak_rows), high_leakage=high_leak,
        blockers=frozenset(blockers), lineage=(config.dataset, config.version, config.digest()),
    ))
    segments: dict[str, list[float]] = {}
    if config.segment:
        for r in missing.where(F.col("group_column") == config.segment).collect():
            segments.setdefault(r["column"], []).append(r["missing_ratio"])
    profiled = [r.asDict() for r in prof.collect()]
    advice = methods.recommendations(profiled, config.target, segments, facts_row.asDict() if facts_row else None)
    return Analysis(config, rows, prof, missing, profile.duplicate_groups(table, features, config.id_column), imbalance, leaks, summary, valid, signals, passport, decided, decisions.review_queue(decided), score, advice, ready, gates, blockers)


def apply_plan(table: DataFrame, config: Config, plan: methods.Plan, approval: dict, gates=None, split: DataFrame | None = None) -> tuple[DataFrame, versions.Candidate]:
    """The candidate of an approved plan, and its version; `gates` makes gate rows from (source, candidate).

    `split` (id column, split) says which rows augmentation may use; without it a split is made.
    """
    candidate = methods.execute(plan, table, config.target, config.id_column, approval, config.segment or config.group, split=split, split_group=config.group)
    rows = None if gates is None else [r.asDict() for r in gates(table, candidate).collect()]
    return candidate, versions.candidate_version(config.version, plan.plan_id, rows)
