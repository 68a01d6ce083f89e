"""Documents to token ids: quality rules, near duplicates, benchmark passages, secrets, SentencePiece.

Every stage works on the whole of what its predecessor has kept, and all but the last return the columns of
`documents`. A stage's result is written to the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.llm import decontaminate, line_rules, pieces, probminhash, secret_ledger
from sluicebox.llm.common import release, scope, stage, staged_path
from sluicebox.session import table


def sized_text(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars as the length of its text, which a stage may have changed."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a source repeat go, and with them the documents that the rules reject."""
    return sized_text(line_rules.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return probminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return sized_text(secret_ledger.redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become SentencePiece ids: doc_id, lang, source, ids, n_tokens, lossless."""
    return pieces.encode(docs.select("doc_id", "lang", "source", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("sentence pieces", tokens),
]

#: Near duplicates, secret offsets and piece ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, one after the other."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        path = staged_path(spark, name.replace(" ", "-"))
        with scope(spark):  # what the stage itself has staged goes with it
            docs = stage(function(spark, docs, sf_dir), name, path)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
