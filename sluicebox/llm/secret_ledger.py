"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. A ledger has a row for each scan of a blob:
the rules with their versions (marks) that were applied, and what they found. A run finds the pairs of blob and mark
that the ledger lacks, for all rules in one pass over hashes, scans only those, appends them, and joins the findings
back to every row that holds the blob: to all versions of all paths, if rows are versions of paths.

Defined cases. Null text is the empty blob. Rows that repeat, and rows with null ids, get their blob's findings.
An empty table adds nothing. Further columns pass through `redact`; the operator's own columns are prefixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import bound_batches, fresh, sized, stage, staged_path

#: The base kinds in the order in which they are listed, their patterns and least lengths.
BASE = ("assign", "access", "hex")
PATTERNS = {
    "assign": re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    # Runs of 16 or more, which is what remains of all maximal runs once the shorter ones are dropped.
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
}
#: One version by kind: raising it makes the ledger scan every blob again for that kind alone.
VERSIONS = {kind: 1 for kind in PATTERNS}
KINDS = tuple(PATTERNS)

LEDGER = "blob binary, scanned array<string>, found array<struct<mark:string,start:int,end:int>>"


def spans(kind: str, text: str) -> list[tuple[int, int]]:
    """Start and end (code points, end exclusive) of the matches of one kind, leftmost and not overlapping."""
    found = PATTERNS[kind].finditer(text)
    if kind == "assign":
        return [m.span() for m in found if len(m[2]) >= 12]
    if kind == "access":
        return [m.span() for m in found if m.end() - m.start() >= 18]
    return [m.span() for m in found]


def blob_id(text: str) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def mark(rule: str, version: int) -> str:
    """The name of a rule version."""
    return f"{rule}@{version}"


def _scan(versions: dict[str, int]):
    """Rows (blob, text, lacks) to rows of the ledger; bit i of `lacks` asks for the i-th rule of `versions`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [(1 << i, rule, mark(rule, version)) for i, (rule, version) in enumerate(versions.items())]
        for batch in batches:
            scanned, found = [], []
            for text, lacks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                asked = [(rule, name) for bit, rule, name in rules if lacks & bit]
                scanned.append([name for _, name in asked])
                found.append([{"mark": name, "start": s, "end": e} for rule, name in asked for s, e in spans(rule, text or "")])
            kind = pa.list_(pa.struct([("mark", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scanned, pa.list_(pa.string())), pa.array(found, kind)], names=["blob", "scanned", "found"]
            )

    return run


def unseen(docs: DataFrame, ledger: DataFrame | None, versions: dict[str, int], text: str = "text") -> DataFrame:
    """(blob, text, lacks): one row for each blob of `docs` that the ledger lacks for some rule version.

    Only hashes are shuffled to find them and their copies: texts stay where they are unless the list of the blobs
    that are asked for, or on an empty ledger of the copied ones, is too large to broadcast.
    """
    rows = docs.select(blob_id(text).alias("blob"), F.col(text).alias("text"))
    every = (1 << len(versions)) - 1
    number = rows.groupBy("blob").agg(F.count("*").alias("n"))
    if ledger is None:
        listed = sized(stage(number.where("n > 1").select("blob"), "copied-blobs"))
        single = rows.join(listed, "blob", "left_anti").withColumn("lacks", F.lit(every).cast("long"))
        several = rows.join(listed, "blob", "left_semi").withColumn("lacks", F.lit(every).cast("long"))
    else:
        bits = [F.when(F.array_contains("scanned", mark(*v)), 1 << i).otherwise(0) for i, v in enumerate(versions.items())]
        known = ledger.groupBy("blob").agg(F.bit_or(sum(bits[1:], start=bits[0]).cast("long")).alias("has"))
        lacks = F.lit(every).cast("long").bitwiseXOR(F.coalesce("has", F.lit(0)).cast("long"))
        asked = number.join(known, "blob", "left").select("blob", "n", lacks.alias("lacks")).where("lacks <> 0")
        chosen = rows.join(sized(stage(asked, "unseen-blobs")), "blob")
        single, several = (chosen.where(x).select("blob", "text", "lacks") for x in ("n = 1", "n > 1"))
    # A copied blob's text is taken once; what each task holds of it is combined before the shuffle.
    return single.unionByName(several.groupBy("blob").agg(F.max("text").alias("text"), F.max("lacks").alias("lacks")))


def scan(docs: DataFrame, ledger_path: str, versions: dict[str, int] = VERSIONS, text: str = "text") -> DataFrame:
    """Scan what the ledger at `ledger_path` lacks, append it there, and return the whole ledger."""
    spark = docs.sparkSession
    bound_batches(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(ledger_path)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if exists else None
    unseen(docs, ledger, versions, text).mapInArrow(_scan(dict(versions)), LEDGER).write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path)


def findings(docs: DataFrame, ledger: DataFrame, versions: dict[str, int] = VERSIONS, text: str = "text", keep=(), found: str = "found") -> DataFrame:
    """The columns `keep` of every row of `docs` and `found`, the sorted spans of its blob: (start, rank, end).

    `rank` is the place of the kind in KINDS. Only blobs with a finding are joined, so a clean corpus joins nothing.
    """
    current = F.array(*[F.lit(mark(k, v)) for k, v in versions.items()])
    rank = {mark(k, v): KINDS.index(k) + 1 for k, v in versions.items()}
    of = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    hits = (
        ledger.select("blob", F.filter("found", lambda x: F.array_contains(current, x["mark"])).alias("at"))
        .where(F.size("at") > 0)
        .select("blob", F.transform("at", lambda x: F.struct(x["start"].alias("start"), of[x["mark"]].alias("rank"), x["end"].alias("end"))).alias("at"))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    )
    blob, other = fresh([*keep, found], "_blob", "_hit")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], blob_id(text).alias(blob))
    listed = sized(stage(hits, "secret-hits")).toDF(other, found)
    return rows.join(listed, F.col(blob) == F.col(other), "left").drop(blob, other)


def occurrences(history: DataFrame, ledger: DataFrame, keys: tuple[str, ...], versions: dict[str, int] = VERSIONS, text: str = "text") -> DataFrame:
    """The columns `keys` (path, version, ...), kind, start and end of every finding in every version of every path."""
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = findings(history.select(*keys, text), ledger, versions, text, keys).where(F.col("found").isNotNull())
    each = rows.select(*keys, F.explode("found").alias("span"))
    return each.select(*keys, F.element_at(names, F.col("span.rank")).alias("kind"), F.col("span.start").alias("start"), F.col("span.end").alias("end"))


def listing(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined; empty if there is none."""
    names = F.array(*[F.lit(k) for k in KINDS])
    of = F.filter(found, lambda x: x["rank"] <= len(kinds)) if len(kinds) < len(KINDS) else found
    each = F.transform(of, lambda x: F.concat_ws(":", F.element_at(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string")))
    return F.coalesce(F.array_join(each, ","), F.lit(""))


def counted(found: Column, kind: str) -> Column:
    """The number of spans of one kind."""
    rank = KINDS.index(kind) + 1
    return F.coalesce(F.size(F.filter(found, lambda x: x["rank"] == rank)), F.lit(0)).cast("long")


def report(docs: DataFrame, ledger_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and list of the spans of every row."""
    ledger = scan(docs, ledger_path or staged_path(docs.sparkSession, "secret-ledger"), text=text)
    found = findings(docs, ledger, text=text, keep=(key,))
    at = F.when(F.col("found").isNull(), F.array().cast("array<struct<start:int,rank:int,end:int>>")).otherwise(F.col("found"))
    return found.select(
        key,
        *[counted(at, kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listing(at, BASE), 256).alias("base_sha256"),
        listing(at).alias("spans"),
    )


def mask(text: str | None, found: list[dict] | None) -> str | None:
    """`text` with every span replaced by its kind; overlapping spans become one, named by the first."""
    if text is None or not found:
        return text
    out, at = [], 0
    for span in sorted(found, key=lambda s: (s["start"], s["rank"])):
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[SECRET_{KINDS[span['rank'] - 1].upper()}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last two columns are the text and its spans: the text masked, the spans dropped."""
    for batch in batches:
        n = batch.num_columns
        texts = [mask(t, f) for t, f in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(n - 2)), pa.array(texts, pa.string())], names=batch.schema.names[:-1]
        )


def redact(docs: DataFrame, ledger_path: str | None = None, text: str = "text") -> DataFrame:
    """`docs` with the secrets in `text` masked. Texts without a finding don't pass through Python for it."""
    ledger = scan(docs, ledger_path or staged_path(docs.sparkSession, "secret-ledger"), text=text)
    columns = docs.columns
    (found,) = fresh(columns, "_found")
    rest = [c for c in columns if c != text]
    at = findings(docs, ledger, text=text, keep=(*rest, text), found=found)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in at.drop(found).schema.fields)
    dirty = at.where(F.col(found).isNotNull()).mapInArrow(_masked, fields)
    return at.where(F.col(found).isNull()).drop(found).unionByName(dirty).select(*[F.col(f"`{c}`") for c in columns])
