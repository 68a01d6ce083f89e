"""Both workflows end to end on a small dataset like the demo archive's."""

import random

import pytest

from sluicebox.functions import cells
from sluicebox.operators import gates
from sluicebox.operators.rules import parse_rules
from sluicebox.plans import methods, runs


@pytest.fixture(scope="module")
def demo(spark):
    r = random.Random(20260520)
    rows = []
    for i in range(200):
        young = i % 3 == 0
        income = "" if r.random() < (0.55 if young else 0.05) else f"{r.uniform(1000, 5000):.2f}"
        rows.append((f"txn_{i:05d}", f"c{i % 47}", f"{r.uniform(10, 500) if i not in (5, 50, 150) else r.uniform(5e4, 1e5):.2f}", income, "young_customers" if young else "regular_customers", str(int(i in (7, 70, 77, 177)))))
    for a, b in ((10, 110), (11, 111), (12, 112), (13, 113)):
        rows[b] = (rows[b][0], *rows[a][1:])
    table = cells.blank_to_null(spark.createDataFrame(rows, "object_id string, customer_id_hash string, amount string, monthly_income string, customer_segment string, is_fraud string"))
    texts = spark.createDataFrame([("m1", "Write to joe@example.com now"), ("m2", "all fine here"), ("m3", "All  fine here"), ("m4", " ")], "object_id string, text string")
    predicted = spark.createDataFrame(
        [(x[0], "fraud" if i == 20 else "not_fraud", {"fraud": 0.97, "not_fraud": 0.03} if i == 20 else {"fraud": 0.49, "not_fraud": 0.51} if i == 30 else {"fraud": 0.02, "not_fraud": 0.98}, 0.97 if i == 20 else 0.51 if i == 30 else 0.98)
         for i, x in enumerate(rows)], "object_id string, predicted_label string, predicted_proba map<string,double>, confidence double")
    return table, texts, predicted


RULES = parse_rules([{"rule_id": "amount_range", "checks": [{"field": "amount", "op": "lte", "value": 10000}]}])
CONFIG = runs.Config("ds", "v1", "is_fraud", segment="customer_segment", labels={"1": "fraud", "0": "not_fraud"}, rules=RULES, outlier_columns=("amount",))


def test_analyze(demo):
    table, texts, predicted = demo
    timer = runs.StageTimer()
    with timer.measure("tabular_profile"):
        a = runs.analyze(table.withColumn("amount", table.amount.cast("double")), CONFIG, texts, predicted)
    got = {r.object_id: r for r in a.decided.collect()}
    assert len(got) == 204 and a.duplicates.count() == 4 and a.imbalance.first().rare_class_count == 4
    actions = [r.action for r in got.values()]
    assert actions.count("SEND_TO_LABEL_REVIEW") == 6 and got["m1"].action == "SEND_TO_PRIVACY_REVIEW" and got["m2"].action == "REMOVE_DUPLICATE" and got["m4"].technical_quality == 0.6
    assert sum("severe_outlier" in r.reason_codes for r in got.values()) == 0 and sum(r.technical_quality == 0.5 for r in got.values() if r.modality == "tabular") == 3
    s = a.summary()
    assert s["objects"] == 204 and s["modalities"] == ["tabular", "text"] and s["ambiguous"] == 1 and s["probable_label_errors"] == 5 and not s["mutates_dataset"]
    assert [r.recommended for r in a.recommendations] == ["group_median", "class_weights"] and "severe_class_imbalance" in a.score.penalties
    assert timer.report({"tabular_profile": 1e9})["passed"] and not timer.report(runs.CEILINGS)["passed"]


def test_apply(demo):
    table, _, _ = demo
    raw = table.withColumn("monthly_income", table.monthly_income.cast("double"))
    a = runs.analyze(raw, CONFIG)
    plan = methods.preview(a.recommendations, "v1")
    approval = {"plan_id": plan.plan_id, "integrity": plan.integrity()}
    made, version = runs.apply_plan(raw, CONFIG, plan, approval, lambda s, c: gates.run_gates(gates.schema_gate(c, s.columns, ["monthly_income"]), gates.privacy_gate(c, ["customer_segment"])))
    assert made.where("monthly_income is null").count() == 0 and version.status == "proposed" and version.parent == "v1"
    assert runs.apply_plan(raw, CONFIG, plan, approval)[1].status == "failed"
    with pytest.raises(ValueError):
        runs.apply_plan(raw, CONFIG, plan, {"plan_id": "other", "integrity": "x"})


def test_metrics_and_timer(tmp_path):
    m = runs.Metrics()
    m.count("rows", 3, stage="a")
    m.count("rows", 2, stage="a")
    m.observe("ms", 5)
    m.observe("ms", 1)
    m.gauge("size", 7)
    assert m.values[("rows", (("stage", "a"),))]["count"] == 5 and m.values[("ms", ())] == {"count": 2, "sum": 6, "min": 1, "max": 5}
    t = runs.StageTimer()
    t.records = [("x", 5.0), ("x", 20.0)]
    t.write(str(tmp_path / "r.json"), {"x": 10})
    assert t.report({"x": 10})["over"] == {"x": 10.0} and (tmp_path / "r.json").read_text().endswith("\n")
