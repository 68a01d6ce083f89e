"""Raw CSV and JSON lines with the order of their rows, manifests, exports, and content-addressed artifacts."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions import cells
from sluicebox.functions.digests import content_digest, object_id, record_digest
from sluicebox.operators.order import positions


def read_csv(spark: SparkSession, path: str, target: str | None = None, id_column: str | None = None) -> DataFrame:
    """A CSV file with all columns as strings, empty cells as NULL, and _row_idx, the row's place in the file, from 0.

    Without rows, or without the target column, it fails. With `id_column`, missing ids become row_<place>. A file is
    read as one piece only if a quoted cell holds a line end.
    """
    header = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    torn = spark.read.text(path).where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).limit(1).count() > 0
    df = spark.read.option("header", True).option("multiLine", torn).option("escape", '"').schema(schema).csv(path)
    if not header or df.isEmpty():
        raise ValueError("empty_tabular_source")
    if target is not None and target not in header:
        raise ValueError("missing_target_column")
    df = positions(df, "_row_idx")
    if id_column is not None:
        back = F.format_string("row_%06d", F.col("_row_idx"))
        df = df.withColumn(id_column, F.coalesce(F.col(id_column), back) if id_column in header else back)
    return df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number, value, is_utf8) of a text file; lines are numbered from 1."""
    raw = positions(spark.read.text(path), "_line")
    return raw.select((F.col("_line") + 1).alias("line_number"), "value", F.is_valid_utf8("value").alias("is_utf8"))


MANIFEST = T.StructType([
    T.StructField("object_id", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("source_system", T.StringType()),
    T.StructField("row_key", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def manifest(rows: DataFrame, version: str, modality: str, source: str, row_key: str, columns: list[str], label: str | None = None, labels: dict[str, str] | None = None, metadata: list[str] = ()) -> DataFrame:
    """Manifest rows: an object id from version, key and content, the label in its canonical form, and metadata.

    A missing key is source:line, from _row_idx or line_number. `labels` maps raw labels to canonical ones.
    """
    order = next((c for c in ("_row_idx", "line_number") if c in rows.columns), None)
    fallback = F.concat(F.lit(f"{source}:"), F.col(order).cast("string") if order else record_digest(*columns))
    key = F.coalesce(F.nullif(F.col(row_key).cast("string"), F.lit("")), fallback)
    raw = F.lit(None).cast("string") if label is None else F.nullif(F.col(label).cast("string"), F.lit(""))
    canonical = raw
    for a, b in (labels or {}).items():
        canonical = F.when(raw == a, F.lit(b)).otherwise(canonical)
    pairs = F.map_filter(F.create_map(*[x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull()) if metadata else F.create_map().cast("map<string,string>")
    digest = record_digest(*columns)
    return rows.select(
        object_id(F.lit(version), key, digest).alias("object_id"), F.lit(modality).alias("modality"), F.lit(source).alias("source_system"),
        key.alias("row_key"), digest.alias("hash"), canonical.alias("label"), pairs.alias("metadata"),
    )


def manifest_reason() -> Any:
    """Why a manifest row is invalid, NULL if it is not."""
    return (
        F.when(F.col("object_id").isNull() | F.col("modality").isNull() | F.col("hash").isNull(), "missing_required_field")
        .when(~F.col("modality").isin("tabular", "text", "image", "video", "audio", "document_ocr", "multimodal"), "schema_violation")
        .when(~F.col("hash").rlike(r"^sha256:[a-f0-9]{64}$"), "schema_violation")
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of a JSON-lines file with reason_code for those that are invalid."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", MANIFEST, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    broken = F.when(F.col("v").isNull(), "invalid_json").when(~F.schema_of_variant("v").startswith("OBJECT"), "row_not_object")
    return parsed.select("r.*", broken.alias("_b")).withColumn("reason_code", F.coalesce("_b", manifest_reason())).drop("_b")


def whole_file_rows(spark: SparkSession, path: str, version: str, modality: str, source: str) -> DataFrame:
    """Manifest rows of files that are one object each: images, audio, annotation files. Only their digests are read out."""
    each = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    digest = content_digest(F.col("content"))
    return each.select(
        object_id(F.lit(version), name, digest).alias("object_id"), F.lit(modality).alias("modality"), F.lit(source).alias("source_system"),
        name.alias("row_key"), digest.alias("hash"), F.lit(None).cast("string").alias("label"),
        F.create_map(F.lit("bytes"), F.col("length").cast("string")).alias("metadata"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows of a JSON-lines file with reason_code: NULL for a valid row, else the first broken invariant."""
    from sluicebox.operators.predictions import SCHEMA, reason_code

    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    broken = F.when(F.col("v").isNull(), "invalid_json").when(~F.schema_of_variant("v").startswith("OBJECT"), "row_not_object")
    return parsed.select("r.*", broken.alias("_b")).withColumn("reason_code", F.coalesce("_b", reason_code())).drop("_b")


def prediction_report(rows: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """One row: valid and refused predictions, coverage of the manifest, and the latest inference."""
    from sluicebox.operators.order import beside
    from sluicebox.operators.predictions import coverage

    valid = rows.where("reason_code is null")
    counts = rows.agg(F.count_if(F.col("reason_code").isNull()).alias("valid"), F.count("reason_code").alias("refused"), F.max("inference_timestamp").alias("latest"))
    return beside(counts, coverage(manifest_rows, valid))


# --------------------------------------------------------------------------- export


def typed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Raw string columns as long, double or string: the narrowest that holds every known cell."""
    columns = columns or [c for c, t in df.dtypes if t == "string"]
    if not columns:
        return df
    raw = lambda c: F.nullif(F.col(c), F.lit(""))
    every = lambda c, test: F.coalesce(F.bool_and(F.when(raw(c).isNotNull(), test)), F.lit(False))
    tests = df.agg(*[x for c in columns for x in (every(c, cells.is_integer(raw(c)) & raw(c).try_cast("long").isNotNull()).alias(f"i_{c}"), every(c, cells.number(raw(c)).isNotNull()).alias(f"f_{c}"))]).first()
    kind = {c: F.trim(raw(c)).try_cast("long") if tests[f"i_{c}"] else cells.number(raw(c)) if tests[f"f_{c}"] else raw(c) for c in columns}
    return df.withColumns(kind)


def without_blocked(df: DataFrame, blocked: DataFrame, id_column: str) -> DataFrame:
    """`df` without the rows whose id is blocked."""
    return df.join(blocked.select(id_column).distinct(), id_column, "left_anti")


def export_table(df: DataFrame, path: str, kind: str = "parquet", blocked: DataFrame | None = None, splits: DataFrame | None = None, id_column: str = "object_id") -> None:
    """Write a table as Parquet (typed, snappy) or CSV, without blocked rows; with `splits`, one folder for each split.

    Rows without a split are left out of the folders.
    """
    out = df if blocked is None else without_blocked(df, blocked, id_column)
    if splits is not None:
        out = out.join(splits.select(id_column, "split"), id_column)
    if kind == "parquet":
        writer = typed(out).write.option("compression", "snappy")
    else:
        writer = out.write.option("header", True).option("lineSep", "\n")
    writer = writer.mode("errorifexists")
    (writer.partitionBy("split") if splits is not None else writer).format(kind).save(path)


def export_text(redacted: DataFrame, path: str, blocked: DataFrame | None = None, id_column: str = "object_id", pii_only: bool = False) -> bool:
    """Write redacted records as JSON lines; without any finding nothing is written where `pii_only` is set."""
    rows = redacted if blocked is None else without_blocked(redacted, blocked, id_column)
    if pii_only:
        rows = rows.where("pii_token_count > 0")
        if rows.isEmpty():
            return False
    rows.select(id_column, "redacted_text", "pii_token_count", "redacted_text_sha256").write.mode("errorifexists").json(path)
    return True


# --------------------------------------------------------------------------- artifacts


def tree_digest(spark: SparkSession, path: str) -> str:
    """The digest of the files below a path: of the sorted digests of their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    digests = sorted(r[0] for r in files.select(F.sha2("content", 256)).collect())
    return "sha256:" + hashlib.sha256("\n".join(digests).encode()).hexdigest()


def artifact_path(base: str, name: str, payload: dict[str, Any]) -> str:
    """Where an artifact belongs: under the digest of what it depends on, its configuration included."""
    digest = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
    return f"{base.rstrip('/')}/{name}/{digest}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_artifact(df: DataFrame, base: str, name: str, payload: dict[str, Any]) -> str:
    """Write a table once under its content address; a complete earlier one is kept as it is."""
    path = artifact_path(base, name, payload)
    if not exists(df.sparkSession, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return path


def scoped(base: str, relative: str) -> str:
    """A path below `base`; anything that leads out of it is refused."""
    parts = [p for p in relative.replace("\\", "/").split("/") if p not in ("", ".")]
    if relative.startswith("/") or ".." in parts or any("\x00" in p for p in parts) or not parts:
        raise ValueError(f"unsafe path {relative!r}")
    return "/".join([base.rstrip("/"), *parts])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", content_digest(F.col("content")).alias("sha256"))


def in_scope(key: str, prefix: str) -> bool:
    """Whether a key of an object store lies below a prefix."""
    base = prefix.strip("/")
    return not base or key.strip("/") == base or key.lstrip("/").startswith(base + "/")


def list_objects(spark: SparkSession, base: str, prefix: str = "") -> DataFrame:
    """(key, length, modified) of the files below `base`/`prefix`, their contents unread; keys are relative to `base`."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath().rstrip("/")
    path = scoped(base, prefix) if prefix else base
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = F.substring_index(F.url_decode(F.regexp_replace("path", "[+]", "%2B")), root + "/", -1)
    return files.select(key.alias("key"), "length", F.col("modificationTime").alias("modified"))


def read_redacted(spark: SparkSession, path: str, id_column: str = "object_id") -> DataFrame:
    """The records that export_text has written, with reason_code where a record's text is not that of its digest."""
    rows = spark.read.schema(f"{id_column} string, redacted_text string, pii_token_count long, redacted_text_sha256 string").json(path)
    bad = ~F.col("redacted_text_sha256").eqNullSafe(content_digest(F.col("redacted_text")))
    return rows.withColumn("reason_code", F.when(bad, "digest_mismatch"))


def csv_shape(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The header of a CSV file and the number of its rows."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.columns, df.count()


def single_source(files: DataFrame, name: str = "transactions", key: str = "key") -> str:
    """The one CSV file of a name among listed files; none or several are refused."""
    stem = F.lower(F.element_at(F.split(F.col(key), "/"), -1))
    found = [r[0] for r in files.where(stem == f"{name.lower()}.csv").select(key).limit(2).collect()]
    if len(found) != 1:
        raise ValueError("transactions_source_missing" if not found else "transactions_source_ambiguous")
    return found[0]


def validated(spark: SparkSession, path: str, expected: str, kind: str = "manifest") -> DataFrame:
    """The rows of a manifest or of predictions, if the file has the expected digest and every row is valid."""
    if tree_digest(spark, path) != expected:
        raise ValueError(f"{kind}_hash_mismatch")
    rows = (read_manifest if kind == "manifest" else read_predictions)(spark, path)
    first = rows.where("reason_code is not null").select("reason_code").limit(1).collect()
    if first:
        raise ValueError(f"{kind}_invalid: {first[0][0]}")
    return rows.drop("reason_code")
