"""Text and OCR records: parsing of JSON lines, validity, duplicates and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.operators.order import beside

#: The reasons for which a record is refused, in the order in which they are tested.
REASONS = (
    "invalid_json", "row_not_object", "missing_required_field", "invalid_text_type", "empty_text", "text_too_short",
    "invalid_object_id_type", "invalid_ocr_confidence",
)
SPACE = r"[\s\x1c-\x1f\x85   -     　]+"


def normalize(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def parse_lines(lines: DataFrame, line: str = "value", number: str = "line_number", min_length: int = 3, ocr: bool = False) -> DataFrame:
    """Records from JSON lines: line_number, object_id, text, language, ocr_confidence and reason_code.

    reason_code is NULL for a valid record, else the first reason that applies. Blank lines are left out.
    """
    raw = F.trim(F.col(line))
    value = F.try_parse_json(raw)
    kind = F.schema_of_variant(value)
    field = lambda name, type_: F.try_variant_get(value, f"$.{name}", type_)
    kind_of = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("VOID"))
    text, confidence = field("text", "string"), field("ocr_confidence", "double")
    missing = kind_of("object_id").isin("VOID") | kind_of("text").isin("VOID")
    bad_confidence = ~kind_of("ocr_confidence").isin("VOID") & (
        ~kind_of("ocr_confidence").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") | ~F.coalesce(confidence.between(0, 1), F.lit(False))
    )
    reason = (
        F.when(value.isNull(), REASONS[0])
        .when(~kind.startswith("OBJECT"), REASONS[1])
        .when(missing, REASONS[2])
        .when(kind_of("text") != "STRING", REASONS[3])
        .when(normalize(text) == "", REASONS[4])
        .when(F.length(normalize(text)) < min_length, REASONS[5])
        .when(kind_of("object_id") != "STRING", REASONS[6])
    )
    if ocr:
        reason = reason.when(bad_confidence, REASONS[7])
    return lines.where(raw != "").select(
        F.col(number).alias("line_number"), field("object_id", "string").alias("object_id"), text.alias("text"),
        field("language", "string").alias("language"), confidence.alias("ocr_confidence"), reason.alias("reason_code"),
    )


def validate(records: DataFrame, id_column: str = "object_id", text: str = "text", min_length: int = 3, confidence: str | None = None) -> DataFrame:
    """`records` with reason_code, for records that are columns already: the same tests in the same order."""
    size = F.col("_normal_length")
    reason = (
        F.when(F.col(id_column).isNull() | F.col(text).isNull(), REASONS[2])
        .when(size == 0, REASONS[4])
        .when(size < min_length, REASONS[5])
    )
    if confidence:
        reason = reason.when(F.col(confidence).isNotNull() & ~F.col(confidence).between(0, 1), REASONS[7])
    measured = records.withColumn("_normal_length", F.length(normalize(F.col(text))))
    return measured.withColumn("reason_code", reason).drop("_normal_length")


def first_by_id(records: DataFrame, id_column: str = "object_id", order: str = "line_number") -> DataFrame:
    """`records` with first_line, the line on which their id first came, and is_repeat for later ones."""
    known = F.col(id_column).isNotNull()
    first = records.where(known).groupBy(F.col(id_column).alias("_id")).agg(F.min(order).alias("first_line"))
    named = records.where(known).join(first, F.col(id_column) == F.col("_id")).drop("_id")
    # Rows without an id stay where they are.
    unnamed = beside(records.where(~known), records.where(~known).agg(F.min(order).alias("first_line")))
    both = named.unionByName(unnamed)
    return both.withColumn("is_repeat", known & (F.col(order) > F.col("first_line")))


def text_digest(text: Column) -> Column:
    """The digest of a normalised text."""
    return F.sha2(normalize(text), 256)


def duplicate_texts(records: DataFrame, id_column: str = "object_id", text: str = "text") -> DataFrame:
    """(text_sha256, group_size, canonical_id) of the texts that occur more than once after normalisation."""
    rows = records.where(F.col(text).isNotNull()).select(text_digest(F.col(text)).alias("text_sha256"), F.col(id_column).alias("id"))
    return rows.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min("id").alias("canonical_id")).where("group_size > 1")


def source_stats(records: DataFrame, text: str = "text", confidence: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Records, valid ones and issues, and lengths of the valid texts, over all rows or by columns; needs reason_code."""
    valid, size = F.col("reason_code").isNull(), F.length(text).cast("long")
    sums = [
        F.count("*").alias("record_count"), F.count_if(valid).alias("valid_count"), F.count_if(~valid).alias("issue_count"),
        F.avg(F.when(valid, size)).alias("avg_length"), F.min(F.when(valid, size)).alias("min_length"), F.max(F.when(valid, size)).alias("max_length"),
    ]
    if confidence:
        sums.append(F.avg(F.when(valid, F.col(confidence))).alias("avg_ocr_confidence"))
    return records.groupBy(*(by or [])).agg(*sums)


def issue_counts(records: DataFrame) -> DataFrame:
    """(reason_code, count) of the records that were refused."""
    return records.where("reason_code is not null").groupBy("reason_code").count()
