"""Validation gates of a candidate dataset: one row (gate, status, severity, value, blocks) each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.cells import numbers
from sluicebox.functions.digests import row_signature
from sluicebox.operators import pii
from sluicebox.operators.distances import closest, vector
from sluicebox.operators.order import beside
from sluicebox.operators.rules import Rule, rule_summary

COLUMNS = ("gate", "status", "severity", "value", "blocks")
#: Gates that are declared and never computed.
NOT_COMPUTED = (
    "synthetic_distribution_similarity", "synthetic_correlation_preservation", "synthetic_missingness_comparison",
    "synthetic_tstr", "synthetic_trts", "synthetic_shap_comparison", "synthetic_tabsyndex",
)
MIN_DISTANCE, NEIGHBOR_EPSILON, COLLISION = 1e-6, 1e-6, 1e-9


def gate(one: DataFrame, name: str, value: Column, failed: Column, severity: str = "BLOCKER") -> DataFrame:
    """A gate's row from a frame of one row."""
    failed = F.coalesce(failed, F.lit(False))
    return one.select(
        F.lit(name).alias("gate"), F.when(failed, "FAILED").otherwise("PASSED").alias("status"),
        F.when(failed, severity).otherwise("INFO").alias("severity"), value.cast("double").alias("value"),
        (failed & F.lit(severity == "BLOCKER")).alias("blocks"),
    )


def not_applicable(df: DataFrame, *names: str) -> DataFrame:
    """Rows of gates that don't apply."""
    rows = [(n, "NOT_APPLICABLE", "INFO", None, False) for n in names]
    return df.sparkSession.createDataFrame(rows, "gate string, status string, severity string, value double, blocks boolean")


def exact_copies(synthetic: DataFrame, real: DataFrame, features: list[str]) -> DataFrame:
    """The synthetic rows whose features equal those of a real row."""
    known = real.select(row_signature(*features).alias("_s")).distinct()
    return synthetic.withColumn("_s", row_signature(*features)).join(known, "_s", "left_semi").drop("_s")


def schema_gate(candidate: DataFrame, declared: list[str], numeric: list[str]) -> DataFrame:
    """Declared columns must be there; cells of numeric columns that are no numbers are a warning."""
    lacking = [c for c in declared if c not in candidate.columns]
    if lacking:
        return gate(candidate.sparkSession.range(1), "schema", F.lit(float(len(lacking))), F.lit(True))
    raw = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    known = [c for c in numeric if c in candidate.columns]
    bad = F.size(F.array_compact(F.array(*[raw(c) for c in known]))) - F.size(F.array_compact(numbers(candidate, known)))
    one = candidate.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("n"))
    return gate(one, "schema", F.col("n"), F.col("n") > 0, "WARNING")


def rules_gate(candidate: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A violated critical rule blocks, any other is a warning."""
    one = rule_summary(candidate, rules).agg(F.sum("violations").alias("n"), F.bool_or("blocker").alias("b"))
    row = gate(one, "business_rules", F.col("n"), F.col("n") > 0, "WARNING")
    critical = gate(one, "business_rules", F.col("n"), F.col("b"))
    return beside(row, critical.select(F.col("blocks").alias("_b"))).select(
        "gate", "status", F.when(F.col("_b"), "BLOCKER").otherwise(F.col("severity")).alias("severity"), "value", F.col("_b").alias("blocks")
    )


def privacy_gate(candidate: DataFrame, columns: list[str], numeric: tuple[str, ...] = (), restricted: bool = True) -> DataFrame:
    """Cells that look like personal data block where it is restricted."""
    one = pii.gate_scan(candidate, columns, numeric).agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("n"))
    return gate(one, "privacy", F.col("n"), F.col("n") > 0, "BLOCKER" if restricted else "WARNING")


def split_gate(checks: DataFrame) -> DataFrame:
    """Failed blockers among the leakage checks block."""
    one = checks.agg(F.count_if((F.col("status") == "FAILED") & (F.col("severity") == "BLOCKER")).alias("n"))
    return gate(one, "split_leakage", F.col("n"), F.col("n") > 0)


def synthetic_gates(synthetic: DataFrame, real: DataFrame, features: list[str], id_column: str, least: float = MIN_DISTANCE) -> DataFrame:
    """Distance to the closest real row, exact copies of real rows, and near copies."""
    copies = exact_copies(synthetic, real, features).agg(F.count("*").alias("n"))
    points = vector(*features).alias("vector")
    d = F.col("least")
    one = closest(synthetic.select(points), real.select(points), NEIGHBOR_EPSILON).select(
        "least", F.coalesce((d < least) | (d <= COLLISION), F.lit(False)).alias("close"), "near"
    )

    def row(name: str, value: Column, failed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("gate"), F.when(failed, "FAILED").otherwise("PASSED").alias("status"), F.when(failed, "BLOCKER").otherwise("INFO").alias("severity"),
            value.cast("double").alias("value"), failed.alias("blocks"),
        )

    # Both gates are read off one row of one search.
    found = one.select(F.inline(F.array(
        row("synthetic_dcr", F.col("least"), F.col("close")), row("synthetic_nearest_neighbor_privacy", F.col("near"), F.col("near") > 0)
    )))
    return found.unionByName(gate(copies, "synthetic_exact_duplicate_to_real", F.col("n"), F.col("n") > 0))


def immutability_gate(spark, path: str, digest: str) -> DataFrame:
    """Whether the files below a path still have the digest that `sources.files.tree_digest` gave."""
    from sluicebox.sources.files import tree_digest

    return gate(spark.range(1), "raw_artifact_immutability", F.lit(None), F.lit(tree_digest(spark, path) != digest))


def run_gates(*gates: DataFrame) -> DataFrame:
    """All rows, with those of the gates that are never computed."""
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out.unionByName(not_applicable(gates[0], *NOT_COMPUTED))


def overall(gates: DataFrame) -> DataFrame:
    """One row: FAILED if any gate failed, and whether any blocks."""
    return gates.agg(
        F.when(F.bool_or(F.col("status") == "FAILED"), "FAILED").otherwise("PASSED").alias("status"), F.bool_or("blocks").alias("blocked")
    )
