"""Running totals, quantiles and dense numbers over any number of rows, without a task that sees them all.

Distinct values are counted first and staged. They are cut into ranges of bounded size by bounds that go through the
driver, so the range of a value is the same wherever it is computed; sums run within ranges and the ranges' totals are
added. Results are exact: the bounds only deal the work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluicebox.session import stage

#: Values in a range, as a rule, and the most ranges; of more than FEW the bounds are searched as an array.
RANGE_ROWS, MOST_RANGES, FEW = 1 << 18, 4096, 64
#: Buckets of dense numbers.
BUCKETS = 4096


def beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """`df` with the columns of a frame of one row; without that row they are null."""
    return df.join(F.broadcast(one), F.lit(True), "left")


def _place(value: str, bounds: list[float]) -> Column:
    """How many of the bounds a value reaches."""
    if len(bounds) <= FEW:  # a sum of comparisons with constants stays inside generated code
        return sum(((F.col(value) >= F.lit(float(x))).cast("int") for x in bounds), F.lit(0))
    array = F.array(*[F.lit(float(x)) for x in bounds])
    return F.size(F.filter(array, lambda x: F.col(value).cast("double") >= x))


def value_range(counts: DataFrame, value: str, key: str | None = None, rows: int = RANGE_ROWS) -> Column:
    """The range of each value, growing with it; `key` has few values, each with bounds of its own."""
    name = F.col(key) if key else F.lit(0)
    sizes = counts.groupBy(name.alias("_key")).count().collect()
    ranges = min(MOST_RANGES, max([1, *(math.ceil(r["count"] / rows) for r in sizes)]))
    if ranges == 1:
        return F.lit(0)
    levels = [i / ranges for i in range(1, ranges)]
    found = counts.groupBy(name.alias("_key")).agg(F.array_distinct(F.percentile_approx(value, levels, 16 * ranges)).alias("b")).collect()
    out = F.lit(0)
    for at, b in found:
        out = _place(value, b or []) if key is None else F.when(F.col(key).eqNullSafe(F.lit(at)), _place(value, b or [])).otherwise(out)
    return out


def running_totals(counts: DataFrame, value: str, sums: list[str], keys: list[str] | str | None = None, descending: bool = False, rows: int = RANGE_ROWS) -> DataFrame:
    """`counts`, one row for each value (and keys), with run_<name> for each of `sums`: its total up to and with the row.

    One key is taken to have few values, each with its own ranges; several keys, or a list, share the ranges, so that
    there may be any number of groups and a large one still lies in many ranges. `counts` should be staged.
    """
    own = keys if isinstance(keys, str) else None
    keys = [keys] if isinstance(keys, str) else list(keys or [])
    ranged = counts.withColumn("_range", value_range(counts, value, own, rows))
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = W.partitionBy(*keys).orderBy(direction("_range")).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
    )
    if own is not None or not keys:  # ranges for each key at most: a side of a fixed size
        offsets = F.broadcast(offsets)
    same = F.col("_range") == F.col("_k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = W.partitionBy(*keys, "_range").orderBy(direction(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranged.join(offsets, same).select(*counts.columns, *[(F.sum(s).over(within) + F.col(f"_o_{s}")).alias(f"run_{s}") for s in sums])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, x, n): how often each known value of each numeric column occurs; staged, so it can be read again."""
    names = F.array(*[F.lit(c) for c in columns])
    cells = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("i", "x")).where("x is not null and not isnan(x)")
    return stage(cells.groupBy(F.element_at(names, F.col("i") + 1).alias("column"), "x").agg(F.count("*").alias("n")), "value-counts")


def quantiles(df: DataFrame, columns: list[str], levels: list[float], counts: DataFrame | None = None) -> DataFrame:
    """(column, n, q): the number of known values of each column and its quantiles by linear interpolation.

    `counts` are the columns' value_counts, if they have been made.
    """
    counts = value_counts(df, columns) if counts is None else counts
    run = running_totals(counts, "x", ["n"], "column")
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    rows = run.join(F.broadcast(total), "column")  # one row for each column
    place = [(F.col("total") - 1) * F.lit(float(q)) for q in levels]
    holds = lambda k: (F.col("run_n") > k) & (F.col("run_n") - F.col("n") <= k)
    low = [F.max(F.when(holds(F.floor(p)), F.col("x"))).alias(f"l{j}") for j, p in enumerate(place)]
    high = [F.max(F.when(holds(F.ceil(p)), F.col("x"))).alias(f"h{j}") for j, p in enumerate(place)]
    picked = rows.groupBy("column").agg(F.max("total").alias("total"), *low, *high)
    at = lambda j, p: F.col(f"l{j}") + (F.col(f"h{j}") - F.col(f"l{j}")) * (p - F.floor(p))
    return picked.select("column", F.col("total").alias("n"), F.array(*[at(j, p) for j, p in enumerate(place)]).alias("q"))


def middles(counts: DataFrame, value: str, keys: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """(keys..., low, high): the two middle values of each group from (keys..., value, n); equal for an odd number."""
    run = running_totals(counts, value, ["n"], keys, rows=rows)
    total = counts.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum("n").alias("_total"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    joined = run.join(total, same) if keys else beside(run, total)
    holds = lambda k: (F.col("run_n") >= k) & (F.col("run_n") - F.col("n") < k)
    middle = lambda k: F.max(F.when(holds(F.floor((F.col("_total") + k) / 2)), F.col(value)))
    return joined.groupBy(*keys).agg(middle(1).alias("low"), middle(2).alias("high"))


def positions(df: DataFrame, name: str) -> DataFrame:
    """`df`, read from files, with the place of each row among all, from 0.

    Rows are numbered by partition; a second pass over the files counts the partitions' rows, a row for each.
    """
    raw = df.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    sizes = raw.groupBy(part.alias("_part")).count()
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    numbered_rows = raw.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered_rows.select(*df.columns, (F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def numbered(df: DataFrame, key: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """`df` with dense numbers from 0 that depend on the rows' keys alone, which must be unique.

    Keys are put into buckets by MD5 and ranked in them; the order of the numbers is not that of the keys.
    """
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    bucket = df.withColumn("_bucket", digest % buckets)
    sizes = bucket.groupBy("_bucket").count()
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return bucket.join(F.broadcast(offsets), "_bucket").withColumn(name, (rank + F.col("_offset") - 1).cast("long")).select(*df.columns, name)
