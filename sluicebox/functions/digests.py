"""Content digests and derived identities. Digests are written `sha256:<hex>`."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SHA256 = r"^sha256:[a-f0-9]{64}$"


def content_digest(content: Column) -> Column:
    """The digest of bytes or text."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def record_digest(*columns: str) -> Column:
    """The digest of a record: JSON of the columns in order of their names, nulls included."""
    record = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})
    return content_digest(record)


def row_signature(*columns: str) -> Column:
    """A signature by which equal rows are found: 64 hex digits over the columns, nulls distinct from texts."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *cells), 256)


def object_id(version: Column, row_key: Column, digest: Column) -> Column:
    """`obj_` and 24 hex digits from a dataset version, a row key and a content digest."""
    return F.concat(F.lit("obj_"), F.substring(F.sha2(F.concat_ws("\n", F.lit("v1"), version, row_key, digest), 256), 1, 24))


def stable_digest(payload: Any) -> str:
    """The digest of a small payload on the driver, by its canonical JSON."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def stable_id(prefix: str, payload: Any) -> str:
    """A short identifier that depends on the payload alone."""
    return f"{prefix}_{stable_digest(payload)[7:31]}"
