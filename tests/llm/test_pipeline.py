"""The pipeline's stages against brute force, one after the other, and the SQL of those queries that have it."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluicebox.llm import decontaminate, line_rules, probminhash, queries
from sluicebox.llm.common import stage
from sluicebox.session import TABLES, table
from tests.llm.test_methods import brute_classes, brute_rules, brute_spans


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = []
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, sf_dir), "test-stage")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    rules, near, clean, secret, tokens = kept
    source = [(r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").collect()]
    assert set(rules) == {x[0] for x in brute_rules(source, line_rules.Limits()) if x[7]}
    ids = sorted(rules)
    roots = brute_classes([rules[i].text for i in ids])
    assert set(near) == {ids[k] for k in set(roots)}
    word = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [word.findall(t.lower())] for i in range(len(w) - 4)}
    items = [shingles(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = {i for i in near if any(len(q & shingles(near[i].text)) >= 0.8 * len(q) for q in items)}
    assert set(clean) == set(near) - hit
    assert set(secret) == set(clean) == set(tokens)
    assert not any(brute_spans(r.text) for r in secret.values())
    for i, r in secret.items():
        assert r.n_chars == len(r.text) and (r.text == clean[i].text) == (not brute_spans(clean[i].text))
    assert all(r.lossless and len(r.ids) == r.n_tokens for r in tokens.values())


def test_run_is_the_last_stage(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "lossless"] and rows.count() > 0


def test_stages_keep_other_columns(spark):
    rows = [(1, " ".join(f"word{i}" for i in range(30)), "en", "a", 1), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["_node", "_words", "_LINES", "_key", "_gone", "_lost", "_found", "node", "kept", "h", "row", "blob", "band"]
    for c in names:
        docs = docs.withColumn(c, F.lit(f"my {c}"))
    columns = docs.columns
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, "/root/testdata/sf0.001"), "test-stage")
        assert docs.columns == columns
        (only,) = docs.collect()
        assert only.doc_id == 1 and all(only[c] == f"my {c}" for c in names)
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, none, "/root/testdata/sf0.001").collect() == []


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_every_operator_is_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
    assert decontaminate.SHINGLE == probminhash.SHINGLE == 5
