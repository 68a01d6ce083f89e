"""Business rules: a small declarative language compiled to column expressions.

A rule is the conjunction of checks of fields. A check compares a cell with a number (gte, gt, lte, lt), with a text
(eq, ne) or with a set of texts (in, not_in). A missing cell fails its check, or, with allow_missing, skips it.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions import cells
from sluicebox.functions.digests import stable_digest

OPERATORS = ("gte", "gt", "lte", "lt", "eq", "ne", "in", "not_in")


@dataclass(frozen=True)
class Check:
    """One comparison of a field."""

    field: str
    op: str
    value: Any
    allow_missing: bool = False

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")
        if self.op in ("in", "not_in") and not isinstance(self.value, (list, tuple)):
            raise ValueError(f"{self.op} needs a list")


@dataclass(frozen=True)
class Rule:
    """Checks that must all hold; a violated critical rule blocks."""

    rule_id: str
    checks: tuple[Check, ...] = field(default_factory=tuple)
    severity: str = "warning"


def parse_rules(payload: list[dict[str, Any]]) -> tuple[Rule, ...]:
    """Rules from their JSON form."""
    return tuple(
        Rule(r["rule_id"], tuple(Check(**c) for c in r.get("checks", ())), r.get("severity", "warning")) for r in payload
    )


def rules_digest(rules: tuple[Rule, ...]) -> str:
    """The digest of a rule set."""
    return stable_digest([asdict(r) for r in rules])


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def passes(check: Check, types: dict[str, str] | None = None) -> Column:
    """Whether a check holds; never NULL. Numeric columns, by `types`, are compared as they are; raw cells are parsed."""
    numeric = (types or {}).get(check.field, "string").startswith(NUMERIC)
    raw = F.col(check.field) if numeric else F.nullif(F.col(check.field).cast("string"), F.lit(""))
    if check.op in ("gte", "gt", "lte", "lt"):
        x, y = (F.nanvl(raw.cast("double"), F.lit(None)) if numeric else cells.number(raw)), float(check.value)
        test = {"gte": x >= y, "gt": x > y, "lte": x <= y, "lt": x < y}[check.op]
    elif check.op in ("eq", "ne"):
        raw = raw.cast("string")
        test = raw == str(check.value) if check.op == "eq" else raw != str(check.value)
    else:
        raw = raw.cast("string")
        test = raw.isin(*[str(v) for v in check.value])
        test = test if check.op == "in" else ~test
    missing = F.lit(check.allow_missing)
    return F.when(raw.isNull(), missing).otherwise(F.coalesce(test, F.lit(False)))


def failed_field(rule: Rule, types: dict[str, str] | None = None) -> Column:
    """The field of the first check that fails; NULL if the rule holds."""
    out = F.when(F.lit(False), F.lit(""))
    for check in rule.checks:
        out = out.when(~passes(check, types), F.lit(check.field))
    return out


def violations(df: DataFrame, rules: tuple[Rule, ...], id_column: str) -> DataFrame:
    """(id, rule_id, severity, field) of every rule that a row violates."""
    each = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), failed_field(r, dict(df.dtypes)).alias("field")) for r in rules])
    return df.select(F.col(id_column).alias("id"), F.inline(each)).where("field is not null")


def rule_summary(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row for each rule: rows evaluated, violations, pass rate (1 without rows), and whether it blocks."""
    sums = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.count("*").alias("evaluated"),
            F.count_if(failed_field(r, dict(df.dtypes)).isNotNull()).alias("violations"),
        )
        for r in rules
    ]
    return df.agg(F.array(*sums).alias("r")).select(F.inline("r")).select(
        "rule_id", "severity", "evaluated", "violations",
        F.when(F.col("evaluated") > 0, 1 - F.col("violations") / F.col("evaluated")).otherwise(1.0).alias("pass_rate"),
        ((F.col("severity") == "critical") & (F.col("violations") > 0)).alias("blocker"),
    )
