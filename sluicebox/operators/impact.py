"""Model impact: a baseline classifier on the source and on the candidate, its metrics, and a verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.functions.cells import numbers
from sluicebox.operators.order import beside, running_totals

#: How far a metric may drop, and what a dataset needs to be evaluated.
DROPS = {"rare_class_recall": 0.05, "macro_f1": 0.03, "weighted_f1": 0.03, "pr_auc": 0.03}
MIN_LABELLED, MIN_RARE, MIN_SPLITS = 50, 5, 2


def class_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, support, precision, recall, f1) of each class, from the table of label and prediction counts."""
    cells = scored.groupBy(F.col(label).cast("string").alias("l"), F.col(prediction).cast("string").alias("p")).count()
    each = cells.select(F.explode(F.array("l", "p")).alias("label"), "l", "p", "count", (F.col("l") == F.col("p")).alias("hit"))
    # A cell on the diagonal is exploded twice, as its label and as its prediction.
    sums = each.groupBy("label").agg(
        F.sum(F.when(F.col("hit"), F.col("count") / 2).otherwise(0.0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & (F.col("l") == F.col("label")), F.col("count")).otherwise(0)).alias("fn"),
        F.sum(F.when(~F.col("hit") & (F.col("p") == F.col("label")), F.col("count")).otherwise(0)).alias("fp"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return sums.select(
        "label", (tp + fn).cast("long").alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def average_precision(scored: DataFrame, positive: str, score: str = "score", label: str = "label") -> DataFrame:
    """One row, pr_auc: the mean precision over the positives, equal scores taken together."""
    hit = (F.col(label).cast("string") == positive).cast("long")
    counts = scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(hit).alias("t"))
    run = running_totals(counts, "s", ["n", "t"], descending=True)
    return run.agg(F.when(F.sum("t") > 0, F.sum(F.col("run_t") / F.col("run_n") * F.col("t")) / F.sum("t")).otherwise(0.0).alias("pr_auc"))


def metrics(scored: DataFrame, rare: str, label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """One row: recall and precision of the rare class, macro and weighted F1, accuracy and PR-AUC."""
    per = class_metrics(scored, label, prediction)
    rare_of = lambda c: F.coalesce(F.max(F.when(F.col("label") == rare, F.col(c))), F.lit(0.0))
    total = F.sum("support")
    one = per.agg(
        rare_of("recall").alias("rare_class_recall"), rare_of("precision").alias("rare_class_precision"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"), (F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"),
    )
    return beside(one, average_precision(scored, rare, score, label))


def train_and_score(train: DataFrame, test: DataFrame, features: list[str], target: str, rare: str) -> DataFrame:
    """`test` with label, prediction and score by a logistic regression that weighs the classes equally.

    Missing cells are 0. Features are not standardised. The reference's solver is another one, so figures agree in
    kind and not digit by digit.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def prepared(df: DataFrame) -> DataFrame:
        cells = F.transform(numbers(df, features), lambda x: F.coalesce(x, F.lit(0.0)))
        label = F.col(target).cast("string")
        return df.select("*", array_to_vector(cells).alias("_features"), label.alias("label"), (label == rare).cast("double").alias("_y"))

    rows = prepared(train)
    n = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("p")).first()
    if not n["n"] or n["p"] in (0, n["n"]):
        raise ValueError("the training rows hold one class only")
    weight = F.when(F.col("_y") == 1, n["n"] / (2 * n["p"])).otherwise(n["n"] / (2 * (n["n"] - n["p"])))
    model = LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="_w", maxIter=500, regParam=1.0 / n["n"], standardization=False)
    fitted = model.fit(rows.withColumn("_w", weight))
    others = rows.where("_y = 0").groupBy("label").count().agg(F.max_by("label", F.struct("count", "label"))).first()[0]
    scored = fitted.transform(prepared(test)).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("prediction", F.when(F.col("prediction") == 1, rare).otherwise(others)).select(*test.columns, "label", "prediction", "score")


def verdict(baseline: dict[str, float], candidate: dict[str, float], blocked: bool = False) -> tuple[str, list[str]]:
    """rejected, degraded, improved or requires_review, and why.

    A drop as large as its limit degrades. To improve, the recall of the rare class must rise and nothing may fall.
    """
    if blocked:
        return "rejected", ["validation_gates_blocker_present"]
    delta = {m: candidate[m] - baseline[m] for m in DROPS}
    worse = [f"{m}_degraded" for m, limit in DROPS.items() if delta[m] <= -limit]
    if worse:
        return "degraded", ["metrics_degraded", *worse]
    if delta["rare_class_recall"] > 0 and min(delta.values()) >= 0:
        return "improved", [f"{m}_improved" for m in DROPS if delta[m] > 0]
    if max(map(abs, delta.values())) <= 1e-9:
        return "requires_review", ["metrics_unchanged"]
    return "requires_review", ["mixed_metric_movement"]


def synthetic_utility(
    is_synthetic: bool, outcome: str, delta: dict[str, float], tstr_drop: float | None, trts_delta: float | None, blocked: bool,
    tstr_limit: float = 0.10, trts_limit: float = 0.15,
) -> tuple[str, list[str]]:
    """Whether synthetic rows help: not_applicable, rejected, requires_review or recommended, and why."""
    if not is_synthetic:
        return "not_applicable", []
    if blocked:
        return "rejected", ["validation_gates_blocker_present"]
    worse = ["metrics_degraded"] * (outcome == "degraded")
    worse += [f"{m}_degraded" for m in ("weighted_f1", "pr_auc") if delta[m] <= -DROPS[m]]
    if worse:
        return "rejected", worse
    if tstr_drop is None:
        return "requires_review", ["tstr_trts_not_available"]
    if tstr_drop > tstr_limit:
        return "rejected", ["tstr_macro_f1_drop_above_threshold"]
    if trts_delta is not None and abs(trts_delta) > trts_limit:
        return "requires_review", ["trts_macro_f1_unstable"]
    if outcome == "improved":
        return "recommended", ["tstr_within_threshold", "rare_class_recall_improved"]
    return "requires_review", ["metrics_inconclusive"]


def cross_training(real_train: DataFrame, real_test: DataFrame, synthetic: DataFrame, features: list[str], target: str, rare: str) -> dict[str, float]:
    """Macro F1 of training on synthetic and testing on real rows (tstr), and the other way round (trts)."""
    tstr = metrics(train_and_score(synthetic, real_test, features, target, rare), rare).first()["macro_f1"]
    trts = metrics(train_and_score(real_train, synthetic, features, target, rare), rare).first()["macro_f1"]
    return {"tstr_macro_f1": tstr, "trts_macro_f1": trts}


@dataclass(frozen=True)
class Eligibility:
    """Whether a dataset can be evaluated, and what it lacks."""

    eligible: bool
    reasons: tuple[str, ...]


def split_stats(df: DataFrame, target: str, rare: str, split: str = "split") -> DataFrame:
    """(split, rows, labelled, rare_rows)."""
    label = F.nullif(F.col(target).cast("string"), F.lit(""))
    return df.groupBy(F.col(split).alias("split")).agg(
        F.count("*").alias("rows"), F.count(label).alias("labelled"), F.count_if(F.coalesce(label == rare, F.lit(False))).alias("rare_rows")
    )


def eligibility(df: DataFrame, target: str, rare: str, split: str = "split", leakage_blocked: bool = False) -> Eligibility:
    """Labels in every row, enough rows and rare rows, two splits, and no leak between them."""
    if target not in df.columns:
        return Eligibility(False, ("target_column_missing",))
    s = split_stats(df, target, rare, split).agg(F.sum("rows"), F.sum("labelled"), F.sum("rare_rows"), F.count_if(F.col("rows") > 0)).first()
    rows, labelled, rare_rows, splits = (x or 0 for x in s)
    tests = (
        (labelled < rows, "target_labels_incomplete"), (labelled < MIN_LABELLED, "too_few_labelled_rows"), (rare_rows < MIN_RARE, "too_few_rare_rows"),
        (splits < MIN_SPLITS, "too_few_splits"), (leakage_blocked, "split_leakage_blocker"),
    )
    reasons = tuple(name for bad, name in tests if bad)
    return Eligibility(not reasons, reasons)


def excluded_columns(columns: list[str], features: list[str], target: str) -> list[str]:
    """The columns that a model neither learns from nor predicts, in their order."""
    return [c for c in columns if c not in features and c != target]


def zero_metrics(rare: str) -> dict:
    """The metrics of a model that could not be trained."""
    return {
        "rare_class_label": rare, "rare_class_recall": 0.0, "rare_class_precision": 0.0, "macro_f1": 0.0, "weighted_f1": 0.0,
        "pr_auc": None, "pr_auc_status": "not_applicable", "pr_auc_reason": "metrics_unavailable", "sample_count": 0,
    }


def fallback_readiness(version: str, candidate: str, reasons: tuple[str, ...], present: tuple[str, ...], missing: tuple[str, ...], splits: DataFrame | None = None) -> dict:
    """What stands in place of model impact where a candidate is not eligible: why, and which inputs and rows there are."""
    return {
        "fallback_kind": "readiness_only", "parent_version": version, "candidate_version": candidate, "primary_reason": reasons[0] if reasons else "not_eligible",
        "reasons": list(reasons), "inputs_present": sorted(present), "inputs_missing": sorted(missing),
        "splits": [] if splits is None else sorted((r.asDict() for r in splits.collect()), key=lambda r: r["split"]),
    }
