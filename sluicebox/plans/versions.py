"""Candidate versions: status from gates, comparison with the source, lineage, export package and dataset card."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.digests import stable_digest, stable_id
from sluicebox.operators.order import beside
from sluicebox.plans.score import Score


@dataclass(frozen=True)
class Candidate:
    """A proposed dataset version."""

    version_id: str
    parent: str
    status: str
    blocked: bool
    blockers: tuple[str, ...]


def candidate_version(parent: str, name: str, gates: list[dict] | None) -> Candidate:
    """A candidate from its gate rows: failed without them, blocked by a blocker, for review after any failure."""
    if gates is None:
        return Candidate(stable_id("version", [parent, name]), parent, "failed", True, ())
    failed = [g for g in gates if g["status"] == "FAILED"]
    blockers = tuple(g["gate"] for g in failed if g["severity"] == "BLOCKER")
    status = "blocked" if blockers else "review_required" if failed else "proposed"
    return Candidate(stable_id("version", [parent, name, gates]), parent, status, bool(blockers), blockers)


def class_balance(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """(label, count_before, count_after, share_before, share_after, share_delta) of every class of either version."""
    def counts(df: DataFrame, side: str) -> DataFrame:
        c = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).count()
        total = c.agg(F.sum("count").alias("t"))
        return beside(c, total).select("label", F.col("count").alias(f"count_{side}"), (F.col("count") / F.col("t")).alias(f"share_{side}"))

    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = counts(before, "before").join(counts(after, "after"), "label", "full_outer")
    sb, sa = F.coalesce("share_before", F.lit(0.0)), F.coalesce("share_after", F.lit(0.0))
    return joined.select("label", zero("count_before").alias("count_before"), zero("count_after").alias("count_after"), sb.alias("share_before"), sa.alias("share_after"), (sa - sb).alias("share_delta"))


def row_counts(before: DataFrame, after: DataFrame, id_column: str) -> DataFrame:
    """One row: rows before and after, and ids that were added, removed and kept."""
    left = before.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("b"))
    right = after.groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("a"))
    return left.join(right, "id", "full_outer").agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"),
        F.count_if(F.col("b").isNull()).alias("ids_added"), F.count_if(F.col("a").isNull()).alias("ids_removed"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("ids_kept"),
    )


def changed_cells(before: DataFrame, after: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """(column, changed, filled) of the objects in both versions; ids must be unique."""
    joined = before.select(id_column, *[F.col(c).alias(f"b_{c}") for c in columns]).join(after.select(id_column, *[F.col(c).alias(f"a_{c}") for c in columns]), id_column)
    each = [
        F.struct(F.lit(c).alias("column"), F.count_if(~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))).alias("changed"),
                 F.count_if(F.col(f"b_{c}").isNull() & F.col(f"a_{c}").isNotNull()).alias("filled"))
        for c in columns
    ]
    return joined.agg(F.array(*each).alias("r")).select(F.inline("r"))


def pii_diff(before: dict | None, after: dict | None) -> dict:
    """Records with personal data, redacted and not, before and after; the arguments are pii.totals with redacted_record_count."""
    if before is None and after is None:
        return {"status": "not_applicable", "reason": "text_ocr_report_not_provided"}
    of = lambda side, name: (side or {}).get(name, 0)
    found = [of(x, "pii_record_count") for x in (before, after)]
    masked = [of(x, "redacted_record_count") for x in (before, after)]
    return {
        "status": "available", "pii_before": found[0], "pii_after": found[1], "pii_delta": found[1] - found[0], "redacted_before": masked[0],
        "redacted_after": masked[1], "unredacted_before": max(0, found[0] - masked[0]), "unredacted_after": max(0, found[1] - masked[1]),
    }


def redacted_delta(before: dict | None, after: dict | None) -> int:
    """How many more records are redacted, 0 where a side is missing or has fewer."""
    return 0 if before is None or after is None else max(0, after.get("redacted_record_count", 0) - before.get("redacted_record_count", 0))


def duplicate_diff(before: DataFrame | None, after: DataFrame | None, columns: list[str]) -> dict:
    """Pairs of duplicates, the rows beyond the first of each group, before and after."""
    from sluicebox.operators.profile import duplicate_summary

    if before is None and after is None:
        return {"status": "not_applicable", "reason": "tabular_profile_not_provided"}
    pairs = [0 if df is None else duplicate_summary(df, columns).first()["pair_count"] or 0 for df in (before, after)]
    return {"status": "available", "pairs_before": pairs[0], "pairs_after": pairs[1], "pairs_delta": pairs[1] - pairs[0]}


def imputed_fields(before: DataFrame, after: DataFrame, methods: dict[str, str]) -> DataFrame:
    """(column, method, missing_before, missing_after, imputed) of the columns with missing cells; `methods` by column."""
    missing = lambda df, side: df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in methods]).select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(m).alias("method"), F.col(c).alias(f"missing_{side}")) for c, m in methods.items()]))
    )
    both = missing(before, "before").join(missing(after, "after").drop("method"), "column")
    imputed = F.greatest(F.lit(0), F.col("missing_before") - F.col("missing_after"))
    return both.withColumn("imputed", imputed.cast("long")).where("imputed > 0 or missing_before > 0")


def gate_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(gate, status_before, status_after, blocks_after, change) of all gates of either run; a gate that was not run is absent."""
    side = lambda df, s: df.select("gate", F.col("status").alias(f"status_{s}"), F.col("blocks").alias(f"blocks_{s}"))
    both = side(before, "before").join(side(after, "after"), "gate", "full_outer")
    was, now = F.coalesce("status_before", F.lit("ABSENT")), F.coalesce("status_after", F.lit("ABSENT"))
    change = F.when(was == now, "same").when(now == "FAILED", "newly_failed").when(was == "FAILED", "resolved").otherwise("changed")
    return both.select("gate", was.alias("status_before"), now.alias("status_after"), F.coalesce("blocks_after", F.lit(False)).alias("blocks_after"), change.alias("change"))


def metric_diff(before: dict | None, after: dict | None) -> dict:
    """Differences of the metrics that both sides have as numbers; without a side they don't apply."""
    if before is None or after is None:
        return {"status": "not_applicable", "reason": "model_metrics_not_provided"}
    both = sorted(k for k in before if isinstance(before[k], (int, float)) and isinstance(after.get(k), (int, float)))
    return {"status": "available", "metrics": {k: {"before": before[k], "after": after[k], "delta": round(after[k] - before[k], 6)} for k in both}}


def score_diff(before: Score | None, after: Score | None) -> dict:
    """Components and penalties before and after; a component that is missing afterwards counts as unchanged."""
    if before is None or after is None:
        return {"status": "not_applicable"}
    parts = {n: (before.components.get(n, 0.0), after.components.get(n, before.components.get(n, 0.0))) for n in sorted({*before.components, *after.components})}
    fines = {n: (before.penalties.get(n, 0.0), after.penalties.get(n, 0.0)) for n in sorted({*before.penalties, *after.penalties})}
    return {
        "status": "available", "value_delta": round(after.value - before.value, 6),
        "components": {n: {"before": a, "after": b, "delta": round(b - a, 6)} for n, (a, b) in parts.items()},
        "penalties": {n: {"before": a, "after": b} for n, (a, b) in fines.items()},
    }


def lineage(candidate: Candidate, inputs: Iterable[dict], outputs: Iterable[dict], algorithms: Iterable[dict], started: str, completed: str, job: str) -> dict:
    """A run event in the shape of OpenLineage; without inputs the parent version is the input."""
    def dataset(ref: dict) -> dict:
        return {"namespace": "sluicebox", "name": ref["name"], "facets": {k: v for k, v in ref.items() if k != "name"}}

    ins = [dataset(r) for r in inputs] or [dataset({"name": candidate.parent, "kind": "dataset_version"})]
    outs = [dataset({"name": candidate.version_id, "kind": "candidate_dataset_version", "status": candidate.status}), *map(dataset, outputs)]
    steps = list(algorithms)
    run = stable_id("run", [candidate.version_id, job, started])
    return {
        "eventType": "COMPLETE", "eventTime": completed, "run": {"runId": run, "facets": {"startedAt": started, "algorithms": steps}},
        "job": {"namespace": "sluicebox", "name": job}, "inputs": ins, "outputs": outs,
        "input_hashes": sorted({r["hash"] for r in ins_hashes(ins)}), "output_hashes": sorted({r["hash"] for r in ins_hashes(outs)}),
    }


def ins_hashes(datasets: list[dict]) -> list[dict]:
    """The facets that carry a hash."""
    return [d["facets"] for d in datasets if "hash" in d["facets"]]


def export_gates(
    candidate: Candidate, raw_unchanged: bool | None, gates_blocked: bool | None, pii_records: int, redacted_records: int, blocked_objects: int,
    impact_eligible: bool | None, require_impact: bool, missing_artifacts: Iterable[str] = (),
) -> list[dict]:
    """The seven gates of an export; what was not checked is not applicable and does not block, unless it is required."""
    missing = list(missing_artifacts)
    states = (
        ("candidate_version", not candidate.blocked, candidate.blockers or ("candidate_blocked",)),
        ("raw_artifact_unchanged", raw_unchanged, ("raw_artifact_changed",)),
        ("validation_gates", None if gates_blocked is None else not gates_blocked, ("validation_gates_blocker_present",)),
        ("privacy", pii_records - redacted_records <= 0, ("unredacted_pii_present",)),
        ("blocked_objects", blocked_objects == 0, ("blocked_objects_present",)),
        ("model_impact", (bool(impact_eligible) if require_impact else impact_eligible), ("model_impact_not_eligible",)),
        ("required_artifacts", not missing, tuple(missing)),
    )
    status = {True: "PASSED", False: "FAILED", None: "NOT_APPLICABLE"}
    soft = {"model_impact"} if not require_impact else set()
    return [
        {"gate": n, "status": "NOT_APPLICABLE" if ok is False and n in soft else status[ok], "reasons": list(why) if ok is False else []}
        for n, ok, why in states
    ]


def export_package(candidate: Candidate, gates: list[dict], artifacts: list[dict]) -> dict:
    """The package: all artifacts, one for each uri, if no gate failed; else only the manifest."""
    blocked = any(g["status"] == "FAILED" for g in gates)
    unique = list({a["uri"]: a for a in artifacts}.values())
    kept = [a for a in unique if a.get("kind") == "manifest"] if blocked else unique
    body = {"candidate": candidate.version_id, "status": "BLOCKED" if blocked else "READY", "gates": gates, "artifacts": kept}
    return {"package_id": stable_id("export", body), "digest": stable_digest(body), **body}


# --------------------------------------------------------------------------- card

#: The sections of a card in their order.
SECTIONS = (
    "Dataset Summary", "Task Type and Target", "Modalities", "Object Counts and Split Distribution", "Applied Actions",
    "Synthetic and Augmented Provenance", "Privacy and Export Restrictions", "Blockers and Review Notes", "Validation Gates",
    "Model Impact Summary", "Lineage References",
)
INLINE_PII = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?:\+[0-9][\s().-]*)(?:[0-9][\s().-]*){8,}[0-9]", r"\b[0-9]{4}\s[0-9]{6}\b")


def cell(value: object) -> str:
    """A value as the cell of a Markdown table."""
    return str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: list[dict]) -> str:
    """Rows as a Markdown table."""
    if not rows:
        return "_none_\n"
    names = list(rows[0])
    lines = [names, ["---"] * len(names), *[[r.get(n, "") for n in names] for r in rows]]
    return "".join("| " + " | ".join(cell(x) for x in line) + " |\n" for line in lines)


def dataset_card(title: str, sections: dict[str, list[dict] | str]) -> str:
    """A Markdown card with all sections in order; a text that holds personal data is refused."""
    parts = [f"# {title}\n"]
    for name in SECTIONS:
        body = sections.get(name, [])
        parts.append(f"\n## {name}\n\n" + (body.rstrip() + "\n" if isinstance(body, str) else markdown_table(body)))
    text = "".join(parts)
    if any(re.search(p, text) for p in INLINE_PII):
        raise ValueError("the card holds personal data")
    return text
