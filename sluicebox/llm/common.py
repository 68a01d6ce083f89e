"""What the corpus operators share: staged tables, checked broadcasts, and word tables over Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sluicebox

# Functions of this package travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sluicebox)

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

#: The largest side that is broadcast after its rows have been counted.
MAX_BROADCAST_BYTES = 64 << 20


# --------------------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sluicebox-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths by the scopes that are open: a scope's end removes them.
_scopes: list[list[str]] = []


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed by the innermost scope, or when the driver ends."""
    path = f"{shared_dir(spark)}/sluicebox/{label}-{uuid.uuid4().hex}"
    hadoop, system = _hadoop(spark, path)
    system.deleteOnExit(hadoop)
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    hadoop, system = _hadoop(spark, path)
    system.delete(hadoop, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end: for results that have been written by then."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for path in held:
            remove(spark, path)


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and return it as a table: lineage ends, lost executors cost one read."""
    path = path or staged_path(df.sparkSession, label)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def release(staged: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    remove(staged.sparkSession, staged._staged_at)


def stage_bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like `stage`, with the rows in files by a hash of `key`: tables with as many buckets join without a shuffle.

    The table's name leaves the catalog at once: the plan has its files and buckets by then.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    name = f"sluicebox_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(name)
    staged = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return staged


def field_bytes(value: Column, kind: T.DataType) -> Column | int:
    """The bytes of a value: a number where all values of the type have the same."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        parts = [field_bytes(value[f.name], f.dataType) for f in kind.fields]
        return sum(parts, start=0)
    if isinstance(kind, T.ArrayType):
        each = field_bytes(F.lit(None), kind.elementType)
        if isinstance(each, int):
            return F.greatest(F.size(value), F.lit(0)) * each + 16
        sums = F.aggregate(value, F.lit(0), lambda a, x: a + field_bytes(x, kind.elementType))
        return F.coalesce(sums, F.lit(0)) + 16
    if isinstance(kind, T.MapType):
        return field_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + field_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    return 8


def table_bytes(df: DataFrame) -> int:
    """The bytes of a staged table's rows, counted: fixed sizes by their number, others by their lengths."""
    sizes = [field_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    fixed = 16 + sum(x for x in sizes if isinstance(x, int))
    varied = [x for x in sizes if not isinstance(x, int)]
    if not varied:
        return df.count() * fixed
    n, total = df.select(sum(varied[1:], start=varied[0]).alias("b")).agg(F.count("*"), F.sum(F.col("b").cast("long"))).first()
    return n * fixed + (total or 0)


def sized(df: DataFrame, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its counted bytes fit `limit`, else as it is, for a shuffled join.

    `df` should be a staged table: it is read here.
    """
    return F.broadcast(df) if table_bytes(df) <= limit else df


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 500 rows and 8 MB, so that long texts don't fill a Python worker.

    The one setting of this package: plans are run later than they are made, so it holds for the whole session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names for internal columns that none of `columns` has, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


# --------------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_coefficients = np.zeros(0, U64)


def coefficients(n: int) -> np.ndarray:
    """The first `n` random 64-bit coefficients of the multilinear word hash."""
    global _coefficients
    if len(_coefficients) < n:
        size = max(256, 1 << int(n - 1).bit_length())
        _coefficients = mix(np.arange(1, size + 1, dtype=U64) * GOLDEN) | U64(1)
    return _coefficients[:n]


# --------------------------------------------------------------------------- words


def lut(separators=SPACE_BYTES) -> np.ndarray:
    """Which bytes belong to words."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


WORD = lut()
#: Letters and digits, and every byte of a character beyond ASCII.
ALNUM = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the byte offset of each row (rows + 1); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of rows of at most `most` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words_of(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD):
    """The words of some rows: the 64-bit hash of each word's bytes, and how many words each row has.

    `raw` is the rows' bytes, `offsets` their starts in it. A word never spans two rows.
    """
    rows = len(offsets) - 1
    inside = word[raw]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U64), np.zeros(rows, np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    edges = np.searchsorted(at, offsets[:-1])  # a row's first word byte begins a word
    edges = edges[edges < len(at)]
    first[edges] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(at)))
    position = np.arange(len(at)) - np.repeat(starts, sizes)
    hashes = np.add.reduceat((raw[at].astype(U64) + U64(1)) * coefficients(int(sizes.max()))[position], starts)
    counts = np.diff(np.searchsorted(at[starts], offsets))
    return mix(hashes + sizes.astype(U64) * GOLDEN), counts


def shingles_of(hashes: np.ndarray, counts: np.ndarray, k: int = 5):
    """Hashes of each row's `k`-word shingles, and their number by row.

    A row of 1 to k - 1 words has one shingle, all its words; a row without words has none.
    """
    n, rows = len(hashes), len(counts)
    row = np.repeat(np.arange(rows), counts)
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    starts = np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(starts, counts)
    begin = np.flatnonzero(place < number[row]) if n else np.zeros(0, np.int64)
    out = np.zeros(len(begin), U64)
    for j, c in enumerate(coefficients(k)):
        there = place[begin] + j < counts[row[begin]]
        out[there] += hashes[begin[there] + j] * c + GOLDEN
    return mix(out), number


def distinct_in_rows(values: np.ndarray, counts: np.ndarray):
    """Row number, value and multiplicity of the distinct values of each row, sorted by row and value."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")]
    row, values = row[order], values[order]
    if not len(values):
        return row, values, np.zeros(0, np.int64)
    new = np.ones(len(values), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(new)
    return row[at], values[at], np.diff(np.append(at, len(values)))


# --------------------------------------------------------------------------- graph


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node of `edges` (a, b): root is the smallest node of its connected component.

    Labels spread along edges and then jump to their label's label, so that long chains halve in each round.
    Every round is staged in the shared folder; only a count of changed labels reaches the driver.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), label)
    roots = held = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), label)
    while True:
        spread = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
            .join(roots, "node")
            .select("node", "root", F.least("near", "root").alias("to"))
        )
        jump = roots.select(F.col("node").alias("to"), F.col("root").alias("far"))
        moved = stage(
            spread.join(jump, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("next"), "root"), label
        )
        release(held)
        roots, held = moved.select("node", F.col("next").alias("root")), moved
        if not moved.where("next <> root").limit(1).count():
            release(both)
            return roots
