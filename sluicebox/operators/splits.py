"""Train, validation and test splits that keep groups whole, and the checks for leaks between them."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.digests import row_signature
from sluicebox.session import staged_path

#: The splits in their order, their shares and the seed.
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
SEED = 42
#: Columns that name a row's group where none is configured.
GROUP_COLUMNS = ("customer_id_hash", "case_id")
#: The greedy assignment writes its choices in parts of so many groups; up to as many are broadcast.
PART = 200_000


def group_key(columns: list[str], wanted: str | None = None) -> str | None:
    """The wanted group column, which must be there, or the first known name among the columns."""
    if wanted is not None and wanted not in columns:
        raise ValueError(f"group_key_not_found: {wanted}")
    return wanted or next((g for g in GROUP_COLUMNS if g in columns), None)


def group_table(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, count): how many rows of each label every group has."""
    return df.groupBy(F.col(group).cast("string").alias("group"), F.col(label).cast("string").alias("label")).count()


def hash_split(df: DataFrame, group: str, ratios: dict[str, float] = RATIOS, seed: int = SEED) -> DataFrame:
    """`df` with a split for each group by a hash of its value: no shuffle, any number of groups, shares on average.

    The hash is MD5, so that any engine gives the same split. A row without a group needs a group of its own.
    """
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    edge, split = 0.0, F.when(F.lit(False), F.lit(""))
    names = list(ratios)
    for name in names[:-1]:
        edge += ratios[name]
        split = split.when(place < edge, F.lit(name))
    return df.withColumn("split", split.otherwise(F.lit(names[-1])))


def chooser(labels: Counter, ratios: dict[str, float] = RATIOS) -> Callable[[tuple[tuple[str, int], ...]], str]:
    """A function that gives the next group, by its counts of labels, the split whose size and labels it misses least.

    Ties go by the order of the splits. It keeps only what each split has so far.
    """
    total = sum(labels.values())
    size = {s: max(1, round(total * r)) for s, r in ratios.items()}
    while sum(size.values()) > max(total, len(ratios)):
        size[max(size, key=lambda s: size[s])] -= 1
    while sum(size.values()) < total:
        size[min(size, key=lambda s: size[s])] += 1
    have, have_label = dict.fromkeys(ratios, 0), {s: Counter() for s in ratios}

    def choose(counts: tuple[tuple[str, int], ...]) -> str:
        n = sum(c for _, c in counts)

        def miss(s: str) -> float:
            by_label = sum(abs(labels[k] * ratios[s] - have_label[s][k] - c) / max(1.0, labels[k] * ratios[s]) for k, c in counts)
            return abs(size[s] - have[s] - n) / max(1, size[s]) + by_label

        best = min(ratios, key=miss)
        have[best] += n
        for k, c in counts:
            have_label[best][k] += c
        return best

    return choose


def rarest(labels: Counter) -> str | None:
    """The rarest label, of equally rare ones the first."""
    return min(labels, key=lambda k: (labels[k], k)) if labels else None


def assign_groups(groups: dict[str, Counter], ratios: dict[str, float] = RATIOS, rare: str | None = None, seed: int = SEED) -> dict[str, str]:
    """A split for each group: rare groups first, then large ones, each where it misses size and labels least.

    Ties in the order go by a hash of seed and group, ties in the choice by the order of the splits.
    """
    labels = sum(groups.values(), Counter())
    rare = rarest(labels) if rare is None else rare

    def order(name: str) -> tuple:
        return rare not in groups[name], -sum(groups[name].values()), hashlib.md5(f"{seed}:{name}".encode()).hexdigest()

    choose = chooser(labels, ratios)
    return {name: choose(tuple(sorted(groups[name].items()))) for name in sorted(groups, key=order)}


def assignments(counts: DataFrame, ratios: dict[str, float] = RATIOS, seed: int = SEED) -> DataFrame:
    """(_group, split) of every group of a group table, as `assign_groups` gives them, for any number of groups.

    Spark sorts the groups; the driver reads them in that order, one sorted part at a time, and stages its choices.
    """
    spark = counts.sparkSession
    labels = Counter({r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("count").alias("n")).collect()})
    groups = counts.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("label", "count"))).alias("counts"), F.sum("count").alias("size"))
    later = ~F.exists("counts", lambda c: c["label"] == F.lit(rarest(labels)))
    ordered = groups.orderBy(later, F.desc("size"), F.md5(F.concat(F.lit(f"{seed}:"), "group"))).select("group", "counts")
    choose, path, names, chosen = chooser(labels, ratios), staged_path(spark, "assignments"), [], []

    def write() -> None:
        part = pa.table({"_group": pa.array(names, pa.string()), "split": pa.array(chosen, pa.string())})
        spark.createDataFrame(part).write.mode("append").parquet(path)
        names.clear()
        chosen.clear()

    for group, found in ordered.toLocalIterator():
        names.append(group)
        chosen.append(choose(tuple((c[0], c[1]) for c in found)))
        if len(names) == PART:
            write()
    write()
    return spark.read.schema("_group string, split string").parquet(path)


def group_stratified_split(df: DataFrame, label: str, group: str | None, id_column: str, ratios: dict[str, float] = RATIOS, seed: int = SEED) -> DataFrame:
    """`df` with a split in which no group is torn and labels are spread; each row without a group is its own.

    The rule is the same for any number of groups. Its choices follow one another, so the driver makes them.
    """
    own = F.concat(F.lit("row:"), F.col(id_column).cast("string"))
    key = own if group is None else F.coalesce(F.concat(F.lit("group:"), F.nullif(F.col(group).cast("string"), F.lit(""))), own)
    rows = df.withColumn("_group", key)
    if rows.where(F.col(label).isNull()).limit(1).count():
        raise ValueError("a split needs a label in every row")
    table = assignments(group_table(rows, "_group", label), ratios, seed)
    few = table.count() <= PART
    return rows.join(F.broadcast(table) if few else table, "_group").drop("_group").select(*df.columns, "split")


def class_distribution(df: DataFrame, label: str, split: str = "split", ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(split, label, count, ratio): the share of each label in its split; every split has each label, also at 0."""
    counts = df.groupBy(F.col(split).alias("split"), F.col(label).cast("string").alias("label")).count()
    labels = counts.select("label").distinct()
    every = labels.select(F.explode(F.array(*[F.lit(s) for s in ratios])).alias("split"), "label")
    filled = every.join(counts, ["split", "label"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    totals = counts.groupBy("split").agg(F.sum("count").alias("total"))
    return filled.join(F.broadcast(totals), "split", "left").select(
        "split", "label", "count", F.when(F.col("total") > 0, F.col("count") / F.col("total")).otherwise(0.0).alias("ratio")
    )


def unassigned(df: DataFrame, assignments: DataFrame, id_column: str) -> DataFrame:
    """The rows of `df` that no assignment names."""
    return df.join(assignments.select(id_column).distinct(), id_column, "left_anti")


def split_rows(df: DataFrame, assignments: DataFrame, split: str, id_column: str) -> DataFrame:
    """The rows of a split."""
    return df.join(assignments.where(F.col("split") == split).select(id_column).distinct(), id_column, "left_semi")


def across_splits(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """(signature, splits, rows) of the contents that lie in two splits or more.

    Rows are first counted by content and split, so that a very common content is one row for each split.
    """
    each = df.groupBy(row_signature(*columns).alias("signature"), F.col(split).alias("split")).count()
    return each.groupBy("signature").agg(F.count("*").alias("splits"), F.sum("count").alias("rows")).where("splits > 1")


def leakage_checks(df: DataFrame, content: list[str], group: str | None, leaks: DataFrame | None = None, split: str = "split") -> DataFrame:
    """(check, status, severity, affected, action): equal contents and groups in several splits, and target leaks.

    `leaks` is the result of profile.leakage_candidates. Empty group values are no group.
    """
    def row(name: str, found: DataFrame, action: str) -> DataFrame:
        n = found.agg(F.count("*").alias("affected"))
        bad = F.col("affected") > 0
        return n.select(
            F.lit(name).alias("check"), F.when(bad, "FAILED").otherwise("PASSED").alias("status"),
            F.when(bad, "BLOCKER").otherwise("INFO").alias("severity"), "affected", F.when(bad, action).alias("action"),
        )

    out = row("exact_hash", across_splits(df, content, split), "BLOCK_MODEL_EVALUATION")
    if group is None:
        skipped = df.sparkSession.range(1).select(
            F.lit("group_key").alias("check"), F.lit("NOT_APPLICABLE").alias("status"), F.lit("INFO").alias("severity"),
            F.lit(0).cast("long").alias("affected"), F.lit(None).cast("string").alias("action"),
        )
        out = out.unionByName(skipped)
    else:
        grouped = df.where(F.coalesce(F.col(group).cast("string"), F.lit("")) != "")
        out = out.unionByName(row("group_key", across_splits(grouped, [group], split), "BLOCK_MODEL_EVALUATION"))
    if leaks is not None:
        high = F.count_if(F.col("reason_code") == "high_target_match_rate")
        named = leaks.agg(F.count("*").alias("affected"), high.alias("high"))
        bad = F.col("high") > 0
        out = out.unionByName(named.select(
            F.lit("target_leakage").alias("check"), F.when(F.col("affected") > 0, "FAILED").otherwise("PASSED").alias("status"),
            F.when(bad, "BLOCKER").when(F.col("affected") > 0, "WARNING").otherwise("INFO").alias("severity"), "affected",
            F.when(bad, "BLOCK_TRAINING").alias("action"),
        ))
    return out


def leakage_risk(checks: DataFrame) -> DataFrame:
    """One row: 1 for a failed blocker, 0.5 for a warning, 0.25 for another failure, 0 without one."""
    failed = F.col("status") == "FAILED"
    value = F.when(failed & (F.col("severity") == "BLOCKER"), 1.0).when(failed & (F.col("severity") == "WARNING"), 0.5).when(failed, 0.25).otherwise(0.0)
    return checks.agg(F.max(value).alias("leakage_risk"))
