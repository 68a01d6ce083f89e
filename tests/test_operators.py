"""Operators on small frames with results worked out by hand, and properties that must hold."""

import json
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluicebox.functions import cells, digests
from sluicebox.operators import actions, decisions, distances, gates, impact, passports, pii, predictions, profile, rules, splits, synthetic, text
from sluicebox.plans import methods, versions
from sluicebox.plans.score import Facts, dataset_score
from sluicebox.sources import archive, files
from sluicebox.streaming import profiles


def one(df):
    return df.first().asDict()


# --------------------------------------------------------------------------- cells and profile


def test_cell_tests(spark):
    df = spark.createDataFrame([("1_000",), ("1e3",), ("1d",), ("infinity",), ("nan",), ("yes",), ("2024-01-05",), ("a-b:c",), ("-.5",)], "x string")
    got = df.select(cells.is_integer(F.col("x")), cells.is_number(F.col("x")), cells.is_truth(F.col("x")), cells.is_moment(F.col("x")), cells.is_identifier(F.col("x"))).collect()
    flags = ["".join("inumdt"[k] if v else "." for k, v in enumerate(r)) for r in got]
    assert flags == ["in..d", ".n..d", "....d", ".n..d", "....d", "..u.d", "...md", "....d", ".n..."]
    assert [r[0] for r in df.select(cells.number(F.col("x"))).collect()][:3] == [1000.0, 1000.0, None]


def test_format_number(spark):
    df = spark.createDataFrame([(3.0,), (2.5,), (0.1234567,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(cells.format_number(F.col("x"))).collect()] == ["3", "2.5", "0.123457", "-1"]


def test_column_profile(spark):
    rows = [(1, "0", "u1", "a@b.co", "x"), (2, "1", "u2", "c@d.co", None), (3, "1", "u3", "e@f.co", "x"), (4, "", "u4", None, "x")]
    df = spark.createDataFrame(rows, "i long, flag string, uid string, email string, c string")
    got = {r["column"]: r for r in profile.column_profile(df, ["flag", "uid", "email", "c"], "i").collect()}
    assert (got["flag"].inferred_type, got["flag"].null_count, got["flag"].sample_value) == ("boolean", 1, "0")
    assert got["uid"].inferred_type == "identifier" and got["c"].is_constant and got["c"].null_ratio == 0.25
    assert got["email"].sample_value is None and got["email"].inferred_type == "text"
    assert profile.column_role("email", "t") == "pii_like" and profile.column_role("manual_review_flag", None) == "leakage_candidate"
    assert profile.column_role("label", "label") == "target" and profile.target_column(["x", "target", "label"]) == "label"


def test_imbalance_of_nine_to_one(spark):
    df = spark.createDataFrame([(str(int(i == 0)),) for i in range(10)] + [(None,)], "is_fraud string")
    got = one(profile.class_imbalance(df, "is_fraud"))
    assert got["imbalance_ratio"] == 9 and got["rare_class_ratio"] == 0.1 and math.isclose(got["balance_score_alternative"], 0.2)
    assert math.isclose(got["balance_score"], 1 / math.log(10))
    assert profile.class_imbalance(df.limit(0), "is_fraud").count() == 0


def test_duplicates_and_outliers(spark):
    df = spark.createDataFrame([("r1", 5.0), ("r2", 5.0), ("r3", 6.0), ("r4", 900.0), ("r5", 7.0)], "object_id string, amount double")
    assert one(profile.duplicate_summary(df, ["amount"])) == {"row_count": 5, "group_count": 1, "affected_rows": 2, "pair_count": 1}
    assert [tuple(r)[1:] for r in profile.duplicate_groups(df, ["amount"], "object_id").collect()] == [(2, "r1")]
    assert {r.id for r in profile.duplicate_members(df, ["amount"], "object_id").collect()} == {"r1", "r2"}
    assert [tuple(r) for r in profile.outliers(df, ["amount"], "object_id").collect()] == [("r4", "amount", 900.0)]


def test_signature_tells_null_from_text(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None), ("=", "a")], "x string, y string")
    assert df.select(digests.row_signature("x", "y")).distinct().count() == 4
    assert df.select(digests.record_digest("x", "y")).distinct().count() == 4


# --------------------------------------------------------------------------- rules


def test_rules(spark):
    df = spark.createDataFrame([(1, "5", "a"), (2, "x", "b"), (3, None, "a"), (4, "50", None)], "i long, n string, s string")
    check = rules.Check
    made = (
        rules.Rule("range", (check("n", "gte", 1), check("n", "lt", 10)), "critical"), rules.Rule("skip", (check("n", "gt", 0, True),)),
        rules.Rule("set", (check("s", "in", ["a"]),)), rules.Rule("not", (check("s", "not_in", ["b"]), check("s", "ne", "z"))),
    )
    got = {r.rule_id: (r.violations, r.blocker) for r in rules.rule_summary(df, made).collect()}
    assert got == {"range": (3, True), "skip": (1, False), "set": (2, False), "not": (2, False)}
    assert one(rules.rule_summary(df.limit(0), made).limit(1))["pass_rate"] == 1.0
    assert {(r.id, r.field) for r in rules.violations(df, made[:1], "i").collect()} == {(2, "n"), (3, "n"), (4, "n")}
    with pytest.raises(ValueError):
        check("s", "in", "a")
    assert rules.rules_digest(made) == rules.rules_digest(rules.parse_rules(json.loads(json.dumps([
        {"rule_id": r.rule_id, "severity": r.severity, "checks": [c.__dict__ for c in r.checks]} for r in made]))))


# --------------------------------------------------------------------------- text and personal data


def test_json_lines(spark):
    lines = ['{"object_id":"a","text":"fine text"}', "{bad", "[1]", '{"object_id":"a"}', '{"object_id":"a","text":5}', '{"object_id":"a","text":"  "}',
             '{"object_id":"a","text":"x"}', '{"object_id":7,"text":"fine text"}', '{"object_id":"a","text":"fine text","ocr_confidence":2}', ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_number long, value string")
    got = [r.reason_code for r in text.parse_lines(df, ocr=True).orderBy("line_number").collect()]
    assert got == [None, *text.REASONS]


def test_first_record_of_an_id(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "line_number long, object_id string")
    assert [r.is_repeat for r in text.first_by_id(df).orderBy("line_number").collect()] == [False, False, True, False]


PII = "Mail me at jo.doe@example.com or +1 (415) 555-2671, passport 4512 345678, card 4111 1111 1111 1111, token=abc123 and account 12345678"


def test_redaction(spark):
    df = spark.createDataFrame([(1, PII), (2, "no card 4111 1111 1111 1112 here"), (3, None), (4, "clean")], "i long, text string")
    got = {r.i: r for r in pii.redact(df).collect()}
    r = got[1]
    assert (r.n_secret, r.n_email, r.n_passport, r.n_payment_card, r.n_bank_account, r.n_phone) == (1, 1, 1, 1, 1, 1)
    for token in ("SECRET", "EMAIL", "PASSPORT", "PAYMENT_CARD", "BANK_ACCOUNT", "PHONE"):
        assert f"[REDACTED_{token}]" in r.redacted_text
    assert got[2].n_payment_card == 0 and got[3].pii_token_count == 0 and got[4].redacted_text == "clean" and r.pii_risk_score == 1.0
    assert pii.redact(spark.createDataFrame([(r.redacted_text,)], "text string")).first().pii_token_count == 0
    strict = pii.redact(spark.createDataFrame([("Account statement",)], "text string"), strict_bank=True).first()
    assert strict.n_bank_account == 0 and pii.redact(spark.createDataFrame([("Account statement",)], "text string")).first().n_bank_account == 1


def redacted_by_hand(text):
    """Counts and redaction with the standard library's patterns, category after category."""
    plain = [
        ("secret", re.compile(r"\b(?:token|secret|password|api[_\-]?key)\s*[:=]\s*['\"]?[^'\"\s,}]+", re.I)), ("email", re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")),
        ("passport", re.compile(r"\b(?:passport\s*[:#-]?\s*)?[A-Z]{0,2}\d{4}[\s\-]?\d{6}\b", re.I)), ("payment_card", re.compile(r"\b(?:\d[ \-]?){12,18}\d\b")),
        ("bank_account", re.compile(r"\b(?:account|acct|iban)[:#\s\-]*([A-Z0-9]{8,34})\b", re.I)), ("phone", re.compile(r"(?<![\d.])(?:\+?\d[\s().\-]*){9,}\d(?!\d)")),
    ]
    counts = []

    def ok(card):
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(re.sub(r"[\s\-]", "", card)))]
        return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0

    for name, pattern in plain:
        n = 0

        def put(m):
            nonlocal n
            if name == "payment_card" and not ok(m[0]):
                return m[0]
            n += 1
            return f"[REDACTED_{name.upper()}]"

        text = pattern.sub(put, text)
        counts.append(n)
    return (*counts, text)


def test_redaction_equals_plain_patterns(spark):
    parts = [
        ".joe@example.com", "é", "joe@example.com", " ", " ", "-", "+", "1", "4111 1111 1111 1111", "4111111111111112", "1234 567890", "AB1234567890", "passport: ", "Account ", "statement",
        "DE89370400440532013000", "iban", "api_key", " = 'x1'", "TOKEN:", "+44 (20) 7946 0958", ".", "\n", "_", "名前", "$1", "\\", "token", "555-0100-222-33",
    ]
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(1500)})
    names = [f"n_{name}" for name, _ in pii.DETECTORS]
    got = {r.text: tuple(r)[1:] for r in pii.detect(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", *names, "redacted_text").collect()}
    want = {t: redacted_by_hand(t) for t in texts}
    assert got == want and all(sum(w[i] for w in want.values()) > 20 for i in range(6))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 10**15), min_size=1, max_size=20))
def test_luhn(spark, numbers):
    def ok(d):
        s = [int(c) for c in reversed(d)]
        return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(s)) % 10 == 0

    texts = [str(n) for n in numbers]
    got = spark.createDataFrame([(t,) for t in texts], "d string").select(pii.luhn(F.col("d"))).collect()
    assert [r[0] for r in got] == [ok(t) for t in texts]


def test_logs_and_payloads(spark):
    df = spark.createDataFrame([("password=abc mail a@b.co",)], "l string")
    assert df.select(pii.redact_log(F.col("l"))).first()[0] == "[REDACTED] mail [REDACTED]"
    assert df.select(pii.scan_log(F.col("l"))).first()[0] == ["secret", "email"]
    assert pii.redact_payload({"a": [{"api_key": 1, "n": 2}]}) == {"a": [{"api_key": "[REDACTED]", "n": 2}]}
    assert pii.export_decision(1, False) == "BLOCKED" and pii.export_decision(1, True) == "ALLOWED"


# --------------------------------------------------------------------------- predictions


def test_signals(spark):
    rows = [("a", "x", "x", {"x": 0.5, "y": 0.3, "z": 0.2}), ("b", "y", "x", {"x": 0.51, "y": 0.49}), ("c", "y", "x", {"x": 0.98, "y": 0.02}), ("d", "x", "x", {"x": 1.0})]
    df = spark.createDataFrame(rows, "object_id string, true_label string, predicted_label string, predicted_proba map<string,double>")
    got = {r.object_id: r for r in predictions.signals(df).collect()}
    assert math.isclose(got["a"].margin, 0.2) and math.isclose(got["a"].entropy, -sum(p * math.log(p) for p in (0.5, 0.3, 0.2)))
    assert got["b"].ambiguous_object_score > 0.7 and "ambiguous_object" in got["b"].reason_codes
    assert got["c"].probable_label_error_score > 0.7 and "high_confidence_label_conflict" in got["c"].reason_codes
    assert got["d"].margin == 1.0 and got["d"].normalized_entropy == 0.0
    backed = predictions.signals(df.withColumn("near", F.create_map(F.lit("x"), F.lit(0.9))), neighbors="near").where("object_id = 'c'").first()
    assert "neighbor_label_disagreement" in backed.reason_codes and "label_support_not_available" not in backed.reason_codes


def test_prediction_validity(spark):
    rows = [("a", "x", {"x": 0.6, "y": 0.4}, 0.6), ("b", "x", {"x": 0.6, "y": 0.5}, 0.6), ("c", "y", {"x": 0.6, "y": 0.4}, 0.6), ("d", "x", {"x": 0.6, "y": 0.4}, 0.9), (None, "x", {"x": 1.0}, 1.0), ("f", "x", {"x": 1.4}, 1.4)]
    df = spark.createDataFrame(rows, "object_id string, predicted_label string, predicted_proba map<string,double>, confidence double")
    got = [r[0] for r in df.select(predictions.reason_code()).collect()]
    assert got == [None, "probability_sum_mismatch", "predicted_label_not_argmax", "confidence_mismatch", "missing_required_field", "probability_out_of_range"]


# --------------------------------------------------------------------------- actions and splits


def test_imputation(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 3.0), (4, "b", None), (5, None, 10.0), (6, None, None)], "i long, g string, x double")
    by = {r.i: r.x for r in actions.impute(df, "x", "group_median", group="g").collect()}
    assert by == {1: 1.0, 2: 2.0, 3: 3.0, 4: 3.0, 5: 10.0, 6: 10.0}
    modes = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    assert sorted(r.x for r in actions.impute(modes, "x", "mode").collect()) == ["a", "a", "b"]
    assert [r.x_was_missing for r in actions.impute(df, "x", "missingness_indicator").orderBy("i").collect()] == [0, 1, 0, 1, 0, 1]
    with pytest.raises(ValueError):
        actions.impute(df, "x", "median", target="x")


def test_duplicate_actions(spark):
    df = spark.createDataFrame([("b", 1, "t"), ("a", 2, "t"), ("a", 1, "t"), ("c", 1, "u")], "id string, tie long, v string")
    kept = actions.remove_duplicates(df, ["v"], "id", "tie")
    assert {tuple(r) for r in kept.collect()} == {("a", 1, "t"), ("c", 1, "u")} and kept.columns == df.columns
    marked = actions.mark_duplicates(df, ["v"], "id", "tie").collect()
    assert sum(r.is_duplicate_candidate for r in marked) == 3 and sum(r.is_duplicate_kept for r in marked) == 2
    assert {r.duplicate_group_id for r in marked} == {"duplicate_group_0000", None}
    many = spark.range(600).select((F.col("id") % 200).cast("string").alias("v"), F.col("id"))
    names = {r.duplicate_group_id for r in actions.mark_duplicates(many, ["v"], "id").collect()}
    assert names == {f"duplicate_group_{i:04d}" for i in range(200)}


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.tuples(st.integers(0, 9), st.integers(0, 3)).filter(any), min_size=3, max_size=40))
def test_greedy_split(groups):
    counted = {g: Counter({k: n for k, n in zip("01", c) if n}) for g, c in groups.items()}
    out = splits.assign_groups(counted)
    assert set(out) == set(groups) and set(out.values()) <= set(splits.RATIOS)
    assert out == splits.assign_groups(dict(reversed(counted.items())))


def test_group_split_is_greedy_for_any_number_of_groups(spark):
    rows = spark.range(210_000).selectExpr("id AS i", "id div 6 * 5 + least(id % 6, 4) AS g", "IF(id % 17 = 0, 'r', IF(id % 3 = 0, 'a', 'b')) AS y")
    rows = rows.union(spark.range(210_000, 240_000).selectExpr("id AS i", "CAST(NULL AS BIGINT) AS g", "'a' AS y"))
    groups = {}
    for r in splits.group_table(rows.selectExpr("coalesce(concat('group:', g), concat('row:', i)) AS g", "y"), "g", "y").collect():
        groups.setdefault(r["group"], Counter())[r["label"]] += r["count"]
    assert len(groups) == 205_000
    want = splits.assign_groups(groups)
    got = {r.k: r.split for r in splits.group_stratified_split(rows, "y", "g", "i").selectExpr("coalesce(concat('group:', g), concat('row:', i)) AS k", "split").distinct().collect()}
    assert got == want


def test_group_split(spark):
    rows = [(i, f"g{i % 30}" if i % 5 else None, str(int(i % 10 == 0))) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, y string")
    got = splits.group_stratified_split(df, "y", "g", "i")
    assert got.count() == 300 and got.where("g is not null").groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert set(sizes) == set(splits.RATIOS) and max(sizes, key=sizes.get) == "train"
    checks = {r.check: r.status for r in splits.leakage_checks(got, ["i"], "g").collect()}
    assert checks == {"exact_hash": "PASSED", "group_key": "PASSED"}
    assert splits.unassigned(df, got.where("i < 290"), "i").count() == 10


def test_leaks_are_found(spark):
    df = spark.createDataFrame([("x", "g", "train"), ("x", "h", "test"), ("y", "h", "train")], "c string, g string, split string")
    got = splits.leakage_checks(df, ["c"], "g", profile.leakage_candidates(df.withColumn("t", F.lit("1")).withColumn("manual_review", F.lit("1")), "t"))
    assert {r.check: (r.status, r.severity) for r in got.collect()} == {"exact_hash": ("FAILED", "BLOCKER"), "group_key": ("FAILED", "BLOCKER"), "target_leakage": ("FAILED", "BLOCKER")}
    assert one(splits.leakage_risk(got))["leakage_risk"] == 1.0


# --------------------------------------------------------------------------- distances and synthetic rows


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK_NUMBERS", 12)
    r = np.random.default_rng(0)
    pts = r.integers(-9, 9, size=(60, 3)).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "id long, vector array<double>").repartition(5)
    got = sorted((x.query_id, x["rank"], x.id) for x in distances.nearest(df, df, 3, exclude_same_id=True).collect())
    d = ((pts[:, None] - pts[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = [(i, k + 1, j) for i in range(60) for k, j in enumerate(sorted(range(60), key=lambda j: (d[i, j], j))[:3])]
    assert got == want


def test_smote(spark):
    r = random.Random(1)
    rows = [(f"o{i}", r.random(), r.random(), "1" if i < 12 else "0", "k") for i in range(60)]
    df = spark.createDataFrame(rows, "object_id string, a double, b double, y string, other string")
    made = synthetic.smote(df, "y", "1", ["a", "b"], "object_id", strategy=0.5, k=3)
    got = made.collect()
    assert len(got) == 24 - 12 and {x.y for x in got} == {"1"} and len({x.object_id for x in got}) == 12
    by = {x[0]: x for x in rows}
    for x in got:
        s, n = by[x.seed_id], by[x.neighbor_id]
        assert s[0] != n[0] and math.isclose(x.a, s[1] + x["lambda"] * (n[1] - s[1])) and 0 <= x["lambda"] < 1
    assert sorted(map(str, got)) == sorted(map(str, synthetic.smote(df.repartition(7), "y", "1", ["a", "b"], "object_id", strategy=0.5, k=3).collect()))
    assert synthetic.smote_target(4, 25, 0.1) == 4 and synthetic.smote_target(1, 25, 0.1) == 2
    both = synthetic.augmented(df, made)
    assert both.where("is_synthetic = 1").count() == 12 and synthetic.feature_columns(both, "y", ("object_id",)) == ["a", "b"]
    checks = {x.check: x.status for x in synthetic.validate(df, made, ["a", "b"]).collect()}
    assert set(checks.values()) == {"PASSED"}


def test_copula_of_missing_and_constant_columns(spark):
    rows = spark.range(60).selectExpr("double(id % 7) AS a", "if(id % 5 = 0, null, double(id)) AS b", "double(null) AS c", "5.0D AS d", "string(id % 3) AS y")
    got = synthetic.copula(rows, "y", ["a", "b", "c", "d"], "object_id", strategy=1.0).toPandas()
    assert len(got) == 60 and (got["c"] == 0).all() and (got["d"] == 5).all() and not got.isna()[["a", "b"]].any().any()
    filled = rows.toPandas()["b"].fillna(31.0)  # the median of what is there
    assert filled.min() <= got["b"].min() and got["b"].max() <= filled.max()
    r = {(x["a"], x["b"]): x["correlation"] for x in synthetic.correlation(rows, ["a", "d"]).collect()}
    assert r == {("a", "a"): 1.0, ("a", "d"): 0.0, ("d", "d"): 1.0}


def test_copula(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=2000)
    rows = [(float(a), float(0.9 * a + 0.3 * e), str(int(k % 4 == 0))) for k, (a, e) in enumerate(zip(x, g.normal(size=2000)))]
    df = spark.createDataFrame(rows, "a double, b double, y string")
    got = synthetic.copula(df, "y", ["a", "b"], "object_id", strategy=1.0).toPandas()
    assert len(got) == 2000 and got.a.corr(got.b) > 0.85 and abs(got.a.median() - np.median(x)) < 0.1
    assert abs((got.y == "1").mean() - 0.25) < 0.04 and got.a.between(x.min(), x.max()).all()


def test_normal_cdf(spark):
    zs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(synthetic.normal_cdf(F.col("z"))).collect()
    assert all(abs(r[0] - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6 for r, z in zip(got, zs))


# --------------------------------------------------------------------------- gates and impact


def test_gates(spark):
    real = spark.createDataFrame([("r1", 1.0, 2.0), ("r2", 3.0, 4.0)], "object_id string, a double, b double")
    copy = spark.createDataFrame([("s1", 1.0, 2.0), ("s2", 5.0, 5.0)], "object_id string, a double, b double")
    got = {r.gate: r for r in gates.synthetic_gates(copy, real, ["a", "b"], "object_id").collect()}
    assert all(r.blocks for r in got.values()) and got["synthetic_dcr"].value == 0.0
    assert gates.schema_gate(real, ["object_id", "zz"], []).first().blocks
    bad = spark.createDataFrame([("a@b.co",)], "t string")
    row = gates.run_gates(gates.privacy_gate(bad, ["t"]), gates.schema_gate(bad, ["t"], ["t"]))
    states = {r.gate: (r.status, r.severity) for r in row.collect()}
    assert states["privacy"] == ("FAILED", "BLOCKER") and states["schema"] == ("FAILED", "WARNING") and len(states) == 9
    assert one(gates.overall(row)) == {"status": "FAILED", "blocked": True}


def test_metrics(spark):
    rows = [("1", "1", 0.9), ("1", "0", 0.4), ("0", "0", 0.1), ("0", "1", 0.8), ("0", "0", 0.2)]
    df = spark.createDataFrame(rows, "label string, prediction string, score double")
    got = one(impact.metrics(df, "1"))
    assert got["rare_class_recall"] == 0.5 and got["rare_class_precision"] == 0.5 and math.isclose(got["accuracy"], 0.6)
    assert math.isclose(got["pr_auc"], (1 / 1 + 2 / 3) / 2) and math.isclose(got["macro_f1"], (0.5 + 2 / 3) / 2)


def test_verdicts():
    base = dict(rare_class_recall=0.5, macro_f1=0.5, weighted_f1=0.5, pr_auc=0.5)
    up = lambda **k: {**base, **k}
    assert impact.verdict(base, up(rare_class_recall=0.44))[0] == "degraded" and impact.verdict(base, up(rare_class_recall=0.6))[0] == "improved"
    assert impact.verdict(base, base)[1] == ["metrics_unchanged"] and impact.verdict(base, up(macro_f1=0.51))[1] == ["mixed_metric_movement"]
    assert impact.verdict(base, base, True)[0] == "rejected"
    delta = dict.fromkeys(base, 0.0)
    assert impact.synthetic_utility(True, "improved", delta, 0.01, 0.0, False)[0] == "recommended"
    assert impact.synthetic_utility(True, "improved", delta, 0.5, 0.0, False)[0] == "rejected" and impact.synthetic_utility(False, "", delta, None, None, False)[0] == "not_applicable"


def test_model_and_eligibility(spark):
    r = random.Random(2)
    rows = [(str(r.gauss(3 if i % 4 == 0 else 0, 0.7)), str(int(i % 4 == 0)), "train" if i % 3 else "test") for i in range(240)]
    df = spark.createDataFrame(rows, "x string, y string, split string")
    scored = impact.train_and_score(df.where("split = 'train'"), df.where("split = 'test'"), ["x"], "y", "1")
    assert one(impact.metrics(scored, "1"))["rare_class_recall"] > 0.9
    assert impact.eligibility(df, "y", "1").eligible and impact.eligibility(df.limit(20), "y", "1").reasons
    assert impact.eligibility(df, "zz", "1").reasons == ("target_column_missing",)


# --------------------------------------------------------------------------- decisions and documents


def test_decisions(spark):
    manifest = spark.createDataFrame([("a", "text", "1"), ("b", "text", "0"), ("c", "tabular", "0"), ("d", "image", None)], "object_id string, modality string, label string")
    texts = spark.createDataFrame([("a", False, 0.9, 3, False), ("b", True, 0.0, 0, True)], "object_id string, has_issue boolean, pii_risk_score double, pii_token_count long, is_duplicate boolean")
    out = spark.createDataFrame([("c", "amount"), ("c", "income")], "object_id string, column string")
    bad = spark.createDataFrame([("c", "r1")], "object_id string, rule_id string")
    p = passports.passports(manifest, texts, None, None, out, bad, "1", 0.1)
    got = {r.object_id: r for r in p.collect()}
    assert got["b"].technical_quality == 0.6 and got["c"].technical_quality == 0.5 and got["c"].outlier_columns == ["amount", "income"]
    assert got["a"].rare_segment_score == 0.9 and got["a"].export_eligibility == "redacted_only" and got["d"].decision_hints == ["validated_skeleton_only"]
    decided = decisions.decide(decisions.object_value(p))
    by = {r.object_id: r for r in decided.collect()}
    assert by["a"].hard_blocked and by["a"].action == "BLOCK_EXPORT" and by["b"].action == "REMOVE_DUPLICATE" and by["d"].reason_codes == ["export_ready"]
    queue = {(r.queue, r.object_id) for r in decisions.review_queue(decided).collect()}
    assert queue == {("privacy_review", "a"), ("duplicate_review", "b")}
    assert one(decisions.readiness(decided))["decision"] == "BLOCKED"
    preview = decisions.safe_previews(decided, decisions.review_queue(decided)).where("object_id = 'b'").first().preview
    assert preview.duplicate_score == 1.0 and preview.action == "REMOVE_DUPLICATE"
    assert {r.reason_code for r in decisions.reason_counts(decided).collect()} >= {"pii_unmasked", "exact_duplicate"}
    e = {r.object_id: r for r in passports.evidence(p).collect()}
    assert e["a"].signals.privacy_risk.status == "available" and e["a"].confidence["privacy_risk"] == 0.9
    assert e["a"].signals.prediction_margin.reason == "prediction_manifest_not_provided"


def test_score():
    s = dataset_score(Facts(total_cells=100, missing_cells=10, rows=100, duplicate_rows=6, balance=0.5, imbalance_ratio=12, minority_share=0.04, has_profile=True))
    assert s.components["completeness"] == 0.9 and set(s.penalties) == {"severe_duplicates", "severe_class_imbalance"} and s.readiness == "ready_with_warnings"
    assert math.isclose(s.raw, 100 * sum(s.weighted.values()) - 20, abs_tol=1e-6) and dataset_score(Facts()).value == 1.0
    assert versions.score_diff(s, dataset_score(Facts()))["components"]["completeness"]["delta"] == 0.1


def test_plans():
    r = methods.recommendations([{"column": "income", "inferred_type": "numeric_float", "null_count": 3}], "y", {"income": [0.5, 0.1]}, {"rare_class_ratio": 0.02, "imbalance_ratio": 49})
    assert [x.recommended for x in r] == ["group_median", "class_weights"]
    plan = methods.preview(r, "v1")
    assert plan.steps[1].depends_on == (plan.steps[0].step_id,) and plan.steps[1].step_type == "CONFIGURE_CLASS_WEIGHTS"
    approval = {"plan_id": plan.plan_id, "integrity": plan.integrity()}
    assert methods.check_execution(plan, "v1", approval) == plan.integrity()
    for broken, version, given_ in ((plan, "v2", approval), (plan, "v1", None), (plan, "v1", {"plan_id": "x"})):
        with pytest.raises(ValueError):
            methods.check_execution(broken, version, given_)
    for name in ("target_imputation", "pmm", "nothing"):
        with pytest.raises(ValueError):
            methods.preview(r, "v1", {r[0].recommendation_id: name})
    assert methods.run_key("A", {}, ["b", "a", "a"], "c") == methods.run_key("A", {}, ["a", "b"], "c")


def test_execute_plan(spark):
    df = spark.createDataFrame([(f"o{i}", None if i == 3 else float(i), f"g{i % 3}") for i in range(9)], "object_id string, income double, g string")
    plan = methods.preview([methods.recommend_imputation("income", None)], "v1")
    done = methods.execute(plan, df, None, "object_id", {"plan_id": plan.plan_id, "integrity": plan.integrity()}, "g")
    assert done.where("income is null").count() == 0 and df.where("income is null").count() == 1
    assert {r["column"]: r.filled for r in versions.changed_cells(df, done, "object_id", ["income"]).collect()} == {"income": 1}


def test_execute_augmentation(spark):
    rows = [(f"o{i:03}", f"c{i // 2}", float(i), float(i * i % 97), "1" if i % 16 < 2 else "0") for i in range(320)]
    df = spark.createDataFrame(rows, "object_id string, case_id string, x double, y double, label string")
    found = methods.recommend_rare_class("label", 0.05, 15.0, has_split=True)
    plan = methods.preview([found], "v1", {found.recommendation_id: "smote"})
    approval = {"plan_id": plan.plan_id, "integrity": plan.integrity()}
    split = methods.split_for(df, "label", "object_id")
    place = {r.object_id: r.split for r in split.collect()}
    assert len(place) == 320 and all(place[f"o{i:03}"] == place[f"o{i + 1:03}"] for i in range(0, 320, 2))
    train = [r for r in rows if place[r[0]] == "train"]
    counts = Counter(r[4] for r in train)
    done = methods.execute(plan, df, "label", "object_id", approval).collect()
    made = [r for r in done if r["is_synthetic"] == 1]
    assert len(done) - len(made) == 320 and len(made) == max(0, round(counts["0"] * 0.2) - counts["1"]) > 0
    xs, ys = ([r[k] for r in train if r[4] == "1"] for k in (2, 3))
    assert all(r.label == "1" and min(xs) <= r.x <= max(xs) and min(ys) <= r.y <= max(ys) for r in made)
    torn = split.selectExpr("object_id", "case when object_id = 'o000' then 'test' when object_id = 'o001' then 'train' else split end as split")
    twins = df.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0)).drop("case_id")
    bad = [(df, torn, None, "leakage_checks_failed: group_key"), (twins, None, None, "leakage_checks_failed: exact_hash"), (df, split.where("object_id <> 'o007'"), None, "split_incomplete"), (df, None, "none", "group_key_not_found")]
    for table, given_, group, reason in bad:
        with pytest.raises(ValueError, match=reason):
            methods.execute(plan, table, "label", "object_id", approval, split=given_, split_group=group)


def test_versions_and_card():
    failed = [{"gate": "privacy", "status": "FAILED", "severity": "BLOCKER"}]
    c, good = versions.candidate_version("v1", "n", failed), versions.candidate_version("v1", "n", [])
    assert c.status == "blocked" and c.blockers == ("privacy",) and versions.candidate_version("v1", "n", None).status == "failed"
    g = versions.export_gates(good, True, False, 3, 3, 0, None, False)
    assert {x["status"] for x in g} == {"PASSED", "NOT_APPLICABLE"}
    arts = [{"uri": "a", "kind": "data"}, {"uri": "a", "kind": "data"}, {"uri": "m", "kind": "manifest"}]
    assert len(versions.export_package(good, g, arts)["artifacts"]) == 2
    blocked = versions.export_package(c, versions.export_gates(c, None, True, 3, 1, 2, False, True, ["x"]), arts)
    assert blocked["status"] == "BLOCKED" and [a["kind"] for a in blocked["artifacts"]] == ["manifest"]
    event = versions.lineage(good, [], [{"name": "o", "hash": "h"}], [{"name": "dedup"}], "t0", "t1", "job")
    assert event["inputs"][0]["name"] == "v1" and event["output_hashes"] == ["h"]
    card = versions.dataset_card("Card", {"Dataset Summary": [{"rows": 3, "name": "a|b"}]})
    assert all(f"## {s}" in card for s in versions.SECTIONS) and "a\\|b" in card
    with pytest.raises(ValueError):
        versions.dataset_card("Card", {"Modalities": "mail me@x.org"})


# --------------------------------------------------------------------------- sources


def test_archive(spark, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("d/transactions.csv", "object_id,amount,is_fraud\nt1,5,1\n,,0\n")
        z.writestr("ocr_records.jsonl", '{"object_id":"o"}\n')
    entries = {r.name: r for r in archive.open_archive(spark, str(path), str(tmp_path / "out")).collect()}
    assert entries["d/transactions.csv"].kind == "transactions" and entries["ocr_records.jsonl"].media_type == "application/x-ndjson"
    rows = files.read_csv(spark, entries["d/transactions.csv"].path, "is_fraud", "object_id").orderBy("_row_idx").collect()
    assert [(r.object_id, r.amount) for r in rows] == [("t1", "5"), ("row_000001", None)]
    with pytest.raises(ValueError):
        files.read_csv(spark, entries["d/transactions.csv"].path, "nope")
    with pytest.raises(archive.UnsafeArchive) as e:
        archive.open_archive(spark, str(path), str(tmp_path / "o2"), archive.Policy(max_files=1))
    assert e.value.code == "too_many_files" and archive.archive_handle(b"x").startswith("raw_archive:")


@pytest.mark.parametrize("name,code", [("../x.csv", "path_traversal"), ("/x.csv", "absolute_path"), ("C:/x.csv", "absolute_path"), ("x.exe", "extension_not_allowed")])
def test_unsafe_entries(name, code):
    with pytest.raises(archive.UnsafeArchive) as e:
        archive.check_entry(zipfile.ZipInfo(name))
    assert e.value.code == code


def test_links_are_refused():
    info = zipfile.ZipInfo("x.csv")
    info.external_attr = 0o120777 << 16
    with pytest.raises(archive.UnsafeArchive):
        archive.check_entry(info)


def test_manifest_export_and_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("t1", "5", "1"), ("t2", "6.5", "0"), ("t3", None, None)], "object_id string, amount string, is_fraud string")
    m = files.manifest(df, "v1", "tabular", "csv", "object_id", df.columns, "is_fraud", {"1": "fraud", "0": "not_fraud"}, ["amount"])
    assert sorted(str(r.label) for r in m.collect()) == ["None", "fraud", "not_fraud"] and m.select("object_id").distinct().count() == 3
    m.write.json(str(tmp_path / "m"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{oops\n[1]\n{"object_id":"a"}\n')
    assert files.read_manifest(spark, str(tmp_path / "m")).where("reason_code is not null").count() == 0
    assert sorted(r.reason_code for r in files.read_manifest(spark, str(tmp_path / "bad")).collect()) == ["invalid_json", "missing_required_field", "row_not_object"]
    blocked, parts = df.where("object_id = 't3'"), spark.createDataFrame([("t1", "train"), ("t2", "test")], "object_id string, split string")
    files.export_table(df, str(tmp_path / "p"), blocked=blocked, splits=parts)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert dict(back.dtypes)["amount"] == "double" and {(r.object_id, r.split) for r in back.collect()} == {("t1", "train"), ("t2", "test")}
    files.export_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3
    redacted = pii.redact(spark.createDataFrame([("a", "x@y.co"), ("b", "clean")], "object_id string, text string"))
    assert files.export_text(redacted, str(tmp_path / "t"), pii_only=True) and spark.read.json(str(tmp_path / "t")).count() == 1
    assert not files.export_text(redacted.where("object_id = 'b'"), str(tmp_path / "t2"), pii_only=True)
    a = files.save_artifact(df, str(tmp_path / "art"), "n", {"config": 1})
    before = files.tree_digest(spark, a)
    assert files.save_artifact(df, str(tmp_path / "art"), "n", {"config": 1}) == a and files.tree_digest(spark, a) == before
    assert files.artifact_path("b", "n", {"config": 2}) != files.artifact_path("b", "n", {"config": 1})
    assert gates.immutability_gate(spark, a, before).first().status == "PASSED"
    for unsafe in ("../x", "/x", "", "a/../../b"):
        with pytest.raises(ValueError):
            files.scoped("base", unsafe)


def test_prediction_files_and_whole_files(spark, tmp_path):
    line = '{"object_id":"%s","predicted_label":"x","predicted_proba":{"x":%s,"y":0.1},"confidence":0.9,"inference_timestamp":"2024-05-0%dT00:00:00+00:00"}'
    (tmp_path / "p.jsonl").write_text("\n".join([line % ("a", 0.9, 1), line % ("b", 0.9, 2), line % ("c", 0.8, 3), "{x", ""]))
    rows = files.read_predictions(spark, str(tmp_path / "p.jsonl"))
    assert sorted(str(r.reason_code) for r in rows.collect()) == ["None", "None", "invalid_json", "probability_sum_mismatch"]
    got = one(files.prediction_report(rows, spark.createDataFrame([("a",), ("z",)], "object_id string")))
    assert (got["valid"], got["refused"], got["matched"], got["unmatched"], got["missing"], got["coverage_ratio"]) == (2, 2, 1, 1, 1, 0.5)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"xyz")
    r = files.whole_file_rows(spark, str(tmp_path / "img"), "v1", "image", "images").first()
    assert r.row_key == "a.png" and r.metadata == {"bytes": "3"} and r.object_id.startswith("obj_")


# --------------------------------------------------------------------------- streaming


def test_streams(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = run(profiles.class_totals(stream(), "event_type"), "classes", "complete")
    assert {(r.label, r["count"]) for r in got.collect()} == {(r.event_type, r["count"]) for r in batch.groupBy("event_type").count().collect()}
    cells_ = run(profiles.missing_cells(stream(), ["event_type", "props"]), "missing", "complete")
    assert {r.total_count for r in cells_.collect()} == {batch.count()}
    windows = run(profiles.windowed_counts(stream(), "ts", ["event_type"], "1 day", "1 day", "value"), "windows", "append")
    daily = {(r.d, r.event_type): r.n for r in batch.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert windows.count() > 0 and all(daily[r.window_start, r.event_type] == r["rows"] for r in windows.collect())
    bad = run(profiles.rule_violations(stream(), (rules.Rule("v", (rules.Check("value", "gte", 50),)),), "event_id"), "bad", "append")
    assert bad.count() == batch.where("value < 50").count()
    first = run(profiles.first_by_id(stream(), "user_id", "ts"), "firsts", "append")
    assert first.select("user_id").distinct().count() == batch.select("user_id").distinct().count()
