"""Facts of an analysis: gates, blockers and penalties; differences of versions; sources by name and digest."""

import decimal

import pytest
from pyspark.sql import functions as F

from sluicebox.functions import cells
from sluicebox.functions.digests import content_digest
from sluicebox.operators import actions, decisions, distances, gates, impact, order, pii, splits, text
from sluicebox.operators.rules import parse_rules
from sluicebox.plans import runs, versions
from sluicebox.sources import files


@pytest.fixture(scope="module")
def small(spark):
    rows = [(f"r{i}", str(i % 7), str(i), "1" if i % 4 == 0 else "0") for i in range(60)]
    table = spark.createDataFrame(rows, "object_id string, kind string, amount string, is_fraud string")
    texts = spark.createDataFrame([("t1", "write to joe@example.com"), ("t2", "all fine here"), ("t3", "All  fine here"), ("t4", "one more text")], "object_id string, text string")
    return table, texts


def test_each_fact_reaches_the_score(small):
    table, texts = small
    config = runs.Config("ds", "v1", "is_fraud")
    plain = runs.analyze(table, config, texts)
    # Two of four texts are copies of each other.
    assert plain.score.components["uniqueness"] == 0.5 and "severe_duplicates" in plain.score.penalties
    assert plain.gates == () and plain.blockers == () and plain.score.components["privacy_safety"] == 1.0
    bare = runs.analyze(table, config, texts, redact=False)
    assert bare.gates == ("pii_unmasked",) and bare.blockers == ("PII_UNMASKED",) and "unmasked_pii" in bare.score.penalties
    assert bare.score.components["privacy_safety"] == 0.0 and bare.summary()["decision"] == "BLOCKED"
    rules = parse_rules([{"rule_id": "small", "severity": "critical", "checks": [{"field": "amount", "op": "lte", "value": 10}]}])
    broken = runs.analyze(table.withColumn("amount", F.col("amount").cast("double")), runs.Config("ds", "v1", "is_fraud", rules=rules))
    assert broken.blockers == ("BUSINESS_RULE_FAILURE",) and broken.readiness["readiness"] == "BLOCKED"
    parted = table.withColumn("split", F.when(F.col("kind") == "1", "test").otherwise("train"))
    leaking = runs.analyze(table, config, split_checks=splits.leakage_checks(parted, ["is_fraud"], None))
    assert leaking.gates == ("split_leakage",) and leaking.score.components["model_readiness"] == 0.0 and "split_leakage" in leaking.score.penalties
    leaky = runs.analyze(table.withColumn("manual_review_flag", F.col("is_fraud")), config)
    assert leaky.gates == ("target_leakage_candidate",) and "TARGET_LEAKAGE_CANDIDATE" in leaky.blockers
    assert runs.analyze(table, config, plugins={"ocr": "disabled"}).gates == ("plugin_disabled",)


def test_all_gates_have_a_trigger():
    every = decisions.hard_gates(True, True, True, True, True, True, {"x": "disabled"}, ("disabled_by_policy", "disabled_by_readiness"))
    assert every == tuple(decisions.HARD_GATES) and decisions.hard_gates() == ()


def test_blockers_of_objects(spark):
    rows = spark.createDataFrame([(f"o{i}", ["pii_unmasked"] if i % 2 else ["export_ready"], bool(i % 2)) for i in range(40)], "object_id string, reason_codes array<string>, hard_blocked boolean")
    got = {r.code: r for r in decisions.critical_blockers(rows, ("split_leakage",)).collect()}
    assert got["PII_UNMASKED"].objects == 20 and len(got["PII_UNMASKED"].examples) == 3 and got["SPLIT_LEAKAGE"].objects == 0
    assert got["PII_UNMASKED"].action == "BLOCK_PRIVACY_REVIEW"


def test_differences_of_versions(spark):
    assert versions.pii_diff(None, None)["status"] == "not_applicable"
    diff = versions.pii_diff({"pii_record_count": 4, "redacted_record_count": 1}, {"pii_record_count": 4, "redacted_record_count": 4})
    assert (diff["unredacted_before"], diff["unredacted_after"], diff["pii_delta"]) == (3, 0, 0)
    assert versions.redacted_delta({"redacted_record_count": 5}, {"redacted_record_count": 2}) == 0 and versions.redacted_delta(None, {}) == 0
    before = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, x string")
    assert versions.duplicate_diff(before, actions.remove_duplicates(before, ["x"], "id"), ["x"])["pairs_delta"] == -1
    g = "gate string, status string, severity string, value double, blocks boolean"
    a = spark.createDataFrame([("schema", "PASSED", "INFO", 0.0, False), ("privacy", "FAILED", "BLOCKER", 1.0, True)], g)
    b = spark.createDataFrame([("schema", "FAILED", "WARNING", 1.0, False), ("privacy", "PASSED", "INFO", 0.0, False), ("new", "PASSED", "INFO", 0.0, False)], g)
    assert {r.gate: r.change for r in versions.gate_diff(a, b).collect()} == {"schema": "newly_failed", "privacy": "resolved", "new": "changed"}
    assert versions.metric_diff({"f1": 0.5, "n": "x"}, {"f1": 0.75, "n": "x"})["metrics"] == {"f1": {"before": 0.5, "after": 0.75, "delta": 0.25}}


def test_sources_by_name_and_digest(spark, tmp_path):
    base = tmp_path / "in"
    base.mkdir()
    (base / "transactions.csv").write_text('a,b\n1,"two\nlines"\n3,x\n')
    (base / "other.csv").write_text("a\n1\n")
    found = files.list_objects(spark, f"file://{base}")
    assert sorted(r.key for r in found.collect()) == ["other.csv", "transactions.csv"]
    assert files.single_source(found) == "transactions.csv"
    with pytest.raises(ValueError, match="missing"):
        files.single_source(found, "support")
    assert files.csv_shape(spark, f"file://{base}/transactions.csv") == (["a", "b"], 2)
    rows = files.read_csv(spark, f"file://{base}/transactions.csv", id_column="row").collect()
    assert sorted((r._row_idx, r.row, r.b) for r in rows) == [(0, "row_000000", "two\nlines"), (1, "row_000001", "x")]
    assert files.in_scope("/a/b/c", "a/b") and not files.in_scope("a/bc", "a/b") and files.in_scope("x", "")
    texts = pii.redact(spark.createDataFrame([("1", "mail joe@example.com"), ("2", "fine")], "object_id string, text string"))
    files.export_text(texts, f"file://{tmp_path}/out")
    back = files.read_redacted(spark, f"file://{tmp_path}/out")
    assert back.count() == 2 and back.where("reason_code is not null").count() == 0
    digest = "sha256:" + "a" * 64
    line = '{"object_id":"o1","modality":"text","source_system":"s","row_key":"1","hash":"%s","label":null,"metadata":{}}\n' % digest
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.jsonl").write_text(line)
    good = files.tree_digest(spark, f"file://{tmp_path}/m")
    assert files.validated(spark, f"file://{tmp_path}/m", good).count() == 1
    with pytest.raises(ValueError, match="hash_mismatch"):
        files.validated(spark, f"file://{tmp_path}/m", "sha256:0")


def test_rows_are_numbered_by_their_place(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k} {i}\n" for i in range(50)))
    got = files.read_lines(spark, f"file://{tmp_path}").collect()
    assert sorted(r.line_number for r in got) == list(range(1, 151))
    for k in range(3):
        numbers = [r.line_number for r in sorted((r for r in got if r.value.startswith(f"{k} ")), key=lambda r: int(r.value.split()[1]))]
        assert numbers == list(range(numbers[0], numbers[0] + 50))


def test_decimals(spark):
    rows = [decimal.Decimal(x) for x in ("12.500000", "3.000000", "0.000000", "-7.100000", "0.000001")]
    got = spark.createDataFrame([(x,) for x in rows], "x decimal(30,6)").select(cells.format_decimal(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == ["12.5", "3", "0", "-7.1", "0.000001"]


def test_medians_in_ranges(spark):
    rows = [("big", float(i % 700)) for i in range(2000)] + [("small", 1.0), ("small", 4.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    counts = df.groupBy("g", "x").agg(F.count("*").alias("n"))
    got = {r.g: (r.low + r.high) / 2 for r in order.middles(counts, "x", ["g"], rows=50).collect()}
    values = sorted(i % 700 for i in range(2000))
    assert got == {"big": (values[999] + values[1000]) / 2, "small": 2.5, None: 7.0}
    assert {r.g: r.median for r in actions.median_by(df, "x", "g").collect()} == got


def test_first_lines_without_ids(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), (None, 2), (None, 5)], "object_id string, line_number long")
    got = sorted((r.object_id or "", r.line_number, r.first_line, r.is_repeat) for r in text.first_by_id(rows).collect())
    assert got == [("", 2, 2, False), ("", 5, 2, False), ("a", 1, 1, False), ("a", 3, 1, True)]


def test_nearest_in_small_steps(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i * i % 97), float(i % 5)]) for i in range(300)], "id long, vector array<double>")
    want = sorted(map(tuple, distances.nearest(rows.where("id < 20"), rows, 3, True).collect()))
    monkeypatch.setattr(distances, "WORK", 64)
    monkeypatch.setattr(distances, "BLOCK_NUMBERS", 512)
    assert sorted(map(tuple, distances.nearest(rows.where("id < 20"), rows, 3, True).collect())) == want


def test_gates_of_one_search(spark):
    real = spark.createDataFrame([(f"a{i}", float(i)) for i in range(10)], "id string, x double")
    made = spark.createDataFrame([("s1", 3.0), ("s2", 4.5)], "id string, x double")
    got = {r.gate: (r.status, r.value) for r in gates.synthetic_gates(made, real, ["x"], "id").collect()}
    assert got == {"synthetic_dcr": ("FAILED", 0.0), "synthetic_nearest_neighbor_privacy": ("FAILED", 1.0), "synthetic_exact_duplicate_to_real": ("FAILED", 1.0)}


def test_model_fallbacks(spark):
    assert impact.excluded_columns(["id", "x", "y", "t"], ["x"], "t") == ["id", "y"]
    assert impact.zero_metrics("1")["sample_count"] == 0 and impact.zero_metrics("1")["pr_auc"] is None
    report = impact.fallback_readiness("v1", "v2", ("no_split",), ("labels",), ("split", "model"))
    assert report["primary_reason"] == "no_split" and report["inputs_missing"] == ["model", "split"]
    assert content_digest is not None
