"""Every corpus operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from sluicebox.llm import arc_to_warc, cotrain, decontaminate, html_region, interpolated_lm, langid, line_rules, pieces, probminhash, secret_ledger

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten " * 3, "en", "a", 147),
    (1, "one two three four five six seven eight nine ten " * 3, "en", "a", 147),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "  \n\t ", "fr", None, 5),
    (None, "alpha beta gamma delta epsilon zeta", "fr", "b", 35),
    (5, LONG, "de", "b", len(LONG)),
    (6, "été où ça 日本語 😀 password = abcdefghijkl", None, "b", 40),
    (7, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    known = lambda d: langid.train(d.where("lang is not null"))
    return {
        "cotrain": (lambda d: cotrain.score(d, cotrain.train(d, labels)), "good", 9),
        "pieces": (lambda d: pieces.encode(d), "ids", 9),
        "unpieces": (lambda d: pieces.decode(pieces.encode(d)), "text", 9),
        "rules": (lambda d: line_rules.verdicts(d), "kept", 9),
        "clean": (lambda d: line_rules.clean(d), "text", 1),
        "ledger": (lambda d: secret_ledger.report(d), "spans", 9),
        "redact": (lambda d: secret_ledger.redact(d), "text", 9),
        "langid": (lambda d: langid.predict(d, *known(d)), "lang_pred", 9),
        "decontaminate": (lambda d: decontaminate.matches(d, bench), "containment", 2),
        "decontaminated": (lambda d: decontaminate.clean(d, bench), "text", 7),
        "lm": (lambda d: interpolated_lm.score(d.withColumn("train", F.lit(True)), "train"), "score", 9),
        "html": (lambda d: html_region.extract(d.withColumnRenamed("text", "html")), "n_chars", 9),
        "minhash": (lambda d: probminhash.label(d), "class_id", 9),
        "keep_one": (lambda d: probminhash.keep_one(d), "text", 8),
        "warc": (lambda d: arc_to_warc.round_trip(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html")), 2), "payload_digest", 9),
    }


NAMES = ["cotrain", "pieces", "unpieces", "rules", "clean", "ledger", "redact", "langid", "decontaminate", "decontaminated", "lm", "html", "minhash", "keep_one", "warc"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, name):
    run, column, rows = operators(spark)[name]
    out = run(docs)
    assert column in out.columns
    assert len(out.collect()) == rows


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, none, name):
    run, column, _ = operators(spark)[name]
    out = run(none)
    assert column in out.columns
    assert out.collect() == []


#: Columns of the user's with the names of results, which are replaced, and with those of internal columns, which stay.
CLASHES = {
    "cotrain": (["good", "quality_score"], ["label", "_lang", "node"]), "pieces": (["ids", "n_tokens"], ["model"]), "unpieces": ([], ["pieces"]),
    "rules": (["kept", "N_Words"], ["gone", "line", "_words", "_Lines", "_key", "_gone", "_gone_key", "_lost"]),
    "clean": ([], ["kept", "n_words", "gone", "_words", "_lines", "_key", "_gone", "_own_kept"]),
    "redact": ([], ["found", "_found", "blob", "_blob", "_hit"]), "langid": (["score", "lang_pred"], []), "decontaminated": ([], ["item_id", "_node", "doc"]),
    "lm": (["score", "n_tokens"], ["_train", "_text", "_TEXT_", "chunk", "body"]), "html": (["n_chars"], ["weights"]),
    "minhash": (["class_id"], ["node", "_node", "_id", "_other", "h", "g"]), "keep_one": ([], ["class_id", "node", "n", "_node", "_win", "_same", "id", "_row"]),
}


def plain(rows, columns):
    return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(CLASHES))
def test_clashing_columns(spark, docs, name):
    run, column, rows = operators(spark)[name]
    replaced, kept = CLASHES[name]
    few = docs if name == "clean" else docs.where("doc_id is null or doc_id <> 5")
    more = few
    for c in (*replaced, *kept):
        more = more.withColumn(c, F.lit(f"my {c}"))
    want, got = run(few), run(more)
    assert column in got.columns and len({c.lower() for c in got.columns}) == len(got.columns)
    out = got.collect()
    columns = [c for c in want.columns if c in got.columns]
    assert plain(out, columns) == plain(want.collect(), columns)
    assert out and all(r[c] == f"my {c}" for r in out for c in kept)


def test_values_of_odd_rows(spark, docs):
    few = docs.where("doc_id is null or doc_id <> 5")
    rules = {(r.doc_id, r.text): r for r in line_rules.verdicts(few).collect()}
    assert (rules[2, None].n_words, rules[2, None].n_lines_removed, rules[2, None].kept) == (0, 0, False)
    labels = {(r.doc_id, r.source, r.n_chars): r.class_id for r in probminhash.label(few).collect()}
    assert labels[1, "a", 147] == 1 and labels[None, "b", 35] is None and labels[None, None, 5] is None and labels[3, None, 0] == 3
    assert sorted(str(r.doc_id) for r in probminhash.keep_one(few).collect()) == sorted(["1", "2", "3", "None", "None", "6", "7"])
    spans = {r.doc_id: r for r in secret_ledger.report(few.where("doc_id is not null")).collect()}
    at = ROWS[7][1].index("password")
    assert spans[6].spans == f"assign:{at}:{at + 23}" and spans[2].spans == "" and spans[2].n_hex == 0
    scores = {r.doc_id: r for r in interpolated_lm.score(few.where("doc_id in (2, 3)").withColumn("train", F.lit(False)), "train").collect()}
    assert (scores[2].n_tokens, scores[2].n_known, scores[2].train_tokens, scores[2].base_score, scores[2].score) == (1, 0, 0, 0.0, 0.0)
    # Posteriors that are equal go to the language that sorts first.
    twin = spark.createDataFrame([(1, "abc", "nl"), (2, "abc", "af")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, round(r.score, 9)) for r in langid.predict(twin.drop("lang"), *langid.train(twin)).collect()} == {("af", 0.5)}
    pages = spark.createDataFrame([(1, "u", "x" * 1500), (1, "v", "x" * 1500), (0, "w", "x" * 1500)], "page_id long, url string, html string").repartition(3)
    kinds = sorted((r.page_id, r.target, r.record_type, r.refers_to) for r in arc_to_warc.round_trip(pages).collect())
    assert kinds == [(0, "w", "revisit", 1), (1, "u", "response", None), (1, "v", "response", None)]
