"""Personal data in text: detection, redaction, risk, and the pattern sets of gates and logs.

Detectors run one after the other, each over what the earlier ones have redacted. All of it is column expressions:
a payment card's checksum is tested on the pieces between a split, so exactly the matching spans are replaced.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.digests import content_digest

#: The detectors in their order. The flag U gives \b, \d and \s their meaning for Unicode text.
DETECTORS: tuple[tuple[str, str], ...] = (
    ("secret", r"(?iU)\b(?:token|secret|password|api[_\-]?key)\s*[:=]\s*['\"]?[^'\"\s,}]+"),
    ("email", r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("passport", r"(?iU)\b(?:passport\s*[:#-]?\s*)?[A-Z]{0,2}\d{4}[\s\-]?\d{6}\b"),
    ("payment_card", r"(?U)\b(?:\d[ \-]?){12,18}\d\b"),
    ("bank_account", r"(?iU)\b(?:account|acct|iban)[:#\s\-]*([A-Z0-9]{8,34})\b"),
    ("phone", r"(?U)(?<![\d.])(?:\+?\d[\s().\-]*){9,}\d(?!\d)"),
)
#: A stricter reading of a bank account: the number must hold a digit, so "account statement" is none.
STRICT_BANK = r"(?iU)\b(?:account|acct|iban)[:#\s\-]*((?=[A-Z]*[0-9])[A-Z0-9]{8,34})\b"
WEIGHTS = {"secret": 1.0, "email": 0.5, "passport": 1.0, "payment_card": 1.0, "bank_account": 0.9, "phone": 0.5}
GATE_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"(?U)(?:\+\d[\d\s\-()]{5,}\d|\d[\d]*[\s\-()][\d\s\-()]{4,}\d)"),
    ("passport_like", r"(?U)\b\d{4}\s\d{6}\b"),
)
LOG_PATTERNS = (
    ("secret", r"(?iU)\b(?:token|secret|password|api[_-]?key)\s*[:=]\s*['\"]?[^'\"\s,}]+"),
    ("email", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone", r"(?U)(?:\+?\d[\s().-]*){10,}\d"),
    ("passport", r"(?iU)\b(?:passport\s*)?\d{4}[\s-]?\d{6}\b"),
)
SENSITIVE_KEY = re.compile(r"(raw|text|content|email|phone|passport|token|secret|password|api[_-]?key|pii)", re.I)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid checksum."""
    each = F.split(F.reverse(digits), "")
    sums = F.aggregate(
        F.transform(each, lambda c, i: F.when(c == "", 0).otherwise(_doubled(c.try_cast("int"), i))), F.lit(0), lambda a, x: a + x
    )
    return digits.rlike("^[0-9]+$") & (sums % 10 == 0)


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.coalesce(F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice), F.lit(0))


def detect(df: DataFrame, text: str = "text", strict_bank: bool = False) -> DataFrame:
    """`df` with n_<category> for each detector and redacted_text; a NULL text stays NULL with counts of 0."""
    out = df.withColumn("redacted_text", F.col(text))
    at = F.col("redacted_text")
    for name, pattern in DETECTORS:
        if name == "bank_account" and strict_bank:
            pattern = STRICT_BANK
        token = f"[REDACTED_{name.upper()}]"
        if name == "payment_card":
            out = out.withColumn("_found", F.regexp_extract_all(at, F.lit(pattern), 0))
            hits = F.filter("_found", lambda c: luhn(F.regexp_replace(c, r"[\s\-]", "")))
            new = F.transform("_found", lambda c: F.when(luhn(F.regexp_replace(c, r"[\s\-]", "")), F.lit(token)).otherwise(c))
            joined = F.array_join(F.zip_with(F.split(at, pattern, -1), F.array_append(new, F.lit("")), lambda a, b: F.concat(a, b)), "")
            out = out.withColumn(f"n_{name}", F.coalesce(F.size(hits), F.lit(0)).cast("long"))
            out = out.withColumn("redacted_text", F.when(F.col(f"n_{name}") > 0, joined).otherwise(at)).drop("_found")
        else:
            out = out.withColumn(f"n_{name}", F.coalesce(F.regexp_count(at, F.lit(pattern)), F.lit(0)).cast("long"))
            out = out.withColumn("redacted_text", F.when(F.col(f"n_{name}") > 0, F.regexp_replace(at, pattern, re.sub(r"([\\$])", r"\\\1", token))).otherwise(at))
    return out


def risk(text: str = "text") -> Column:
    """The risk of a detected record, 0 to 1: weighted findings by hundred characters, a short text counting as 100."""
    weighted = sum((F.col(f"n_{name}") * w for name, w in WEIGHTS.items()), F.lit(0.0))
    return F.least(F.lit(1.0), weighted / F.greatest(F.lit(1.0), F.coalesce(F.length(text), F.lit(0)) / 100.0))


def redact(df: DataFrame, text: str = "text", strict_bank: bool = False) -> DataFrame:
    """`df` with counts, redacted_text, pii_token_count, pii_risk_score and the digest of the redacted text."""
    out = detect(df, text, strict_bank)
    total = sum((F.col(f"n_{name}") for name, _ in DETECTORS[1:]), F.col(f"n_{DETECTORS[0][0]}"))
    return (
        out.withColumn("pii_token_count", total)
        .withColumn("pii_risk_score", risk(text))
        .withColumn("redacted_text_sha256", content_digest(F.col("redacted_text")))
    )


def totals(redacted: DataFrame) -> DataFrame:
    """Records with findings, and findings in all and by category."""
    return redacted.agg(
        F.count("*").alias("record_count"), F.count_if(F.col("pii_token_count") > 0).alias("pii_record_count"),
        F.coalesce(F.sum("pii_token_count"), F.lit(0)).alias("pii_token_count"),
        *[F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"n_{name}") for name, _ in DETECTORS],
    )


def gate_scan(df: DataFrame, columns: list[str], numeric: tuple[str, ...] = ()) -> DataFrame:
    """(column, category, cells) that look like personal data; a cell counts for the first pattern that fits."""
    texts = [c for c in columns if c not in numeric]
    found = lambda c: F.coalesce(*[F.when(F.col(c).cast("string").rlike(p), F.lit(n)) for n, p in GATE_PATTERNS])
    each = F.array(*[F.struct(F.lit(c).alias("column"), found(c).alias("category")) for c in texts])
    return df.select(F.inline(each)).where("category is not null").groupBy("column", "category").agg(F.count("*").alias("cells"))


def redact_log(text: Column) -> Column:
    """A log line with secrets and personal data masked."""
    for _, pattern in LOG_PATTERNS:
        text = F.regexp_replace(text, pattern, r"[REDACTED]")
    return text


def scan_log(text: Column) -> Column:
    """The sensitive categories in a log line, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in LOG_PATTERNS]))


def redact_payload(value: Any) -> Any:
    """A small payload of the driver with the values of sensitive keys masked, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if SENSITIVE_KEY.search(str(k)) else redact_payload(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redact_payload(v) for v in value]
    return value


def export_decision(pii_records: int, redacted_artifact: bool) -> str:
    """Whether a text export may leave: personal data must have been redacted."""
    return "BLOCKED" if pii_records > 0 and not redacted_artifact else "ALLOWED"
