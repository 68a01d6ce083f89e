"""The thin queries of the corpus operators over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluicebox.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its own name."""
    QUERIES[function.__name__] = function
    return function


# --------------------------------------------------------------------------- 3: quality rules


@query
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and cross-document line frequency over all documents."""
    from sluicebox.llm import line_rules

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_rules.verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_left", "n_lines_removed",
    )


#: The rules as DuckDB SQL over a relation `src(rid, doc_id, source, text)`; ends in a relation `ruled`.
RULES_SQL = r"""
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM src),
runs AS (SELECT rid, i, array_to_string(ws[i : i + 7], chr(32)) AS run
         FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT rid, run FROM runs GROUP BY rid, run HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM runs JOIN again USING (rid, run), generate_series(0, 7) AS g(k) GROUP BY rid),
raw_lines AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS raw FROM src WHERE text IS NOT NULL),
dup AS (SELECT rid, count(*) - count(DISTINCT raw) AS n FROM raw_lines WHERE regexp_matches(raw, '[^\x20\x09-\x0D]') GROUP BY rid),
lines AS (SELECT rid, source, line, len(string_split(line, ' ')) AS lw FROM
          (SELECT rid, source, trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM raw_lines) WHERE line <> ''),
texts AS (SELECT rid, source, sha256(text) AS h FROM src WHERE rid IN (SELECT rid FROM lines)),
hosts AS (SELECT source, count(DISTINCT h) AS n FROM texts GROUP BY source),
held AS (SELECT l.source, line, count(DISTINCT h) AS documents FROM lines l JOIN texts USING (rid) GROUP BY l.source, line),
freq AS (SELECT held.source, line FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source
         WHERE documents > 5 AND 10 * documents > least(n, 200) AND 1000 * documents > n),
lost AS (SELECT l.rid, sum(l.lw) AS n, count(*) AS k FROM lines l JOIN freq f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.rid),
based AS (
  SELECT w.rid, w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    (len(ws) - coalesce(lost.n, 0))::BIGINT AS n_left, coalesce(lost.k, 0)::BIGINT AS n_lines_removed
  FROM w LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)),
ruled AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_left < 20 AND n_left < 0.5 * n_words) AS kept
  FROM based)
"""

ORACLE["op3_line_frequency"] = (
    "WITH src AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),"
    + RULES_SQL
    + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_left, n_lines_removed FROM ruled"
)

# --------------------------------------------------------------------------- 5: secret scans


@query
def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, through a blob ledger that begins empty. Not for SQL: RE2 gives no offsets."""
    from sluicebox.llm import secret_ledger

    return secret_ledger.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --------------------------------------------------------------------------- 9: HTML extraction


@query
def op9_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Not for SQL: a scan over tags with learned scores."""
    from sluicebox.llm import html_region

    return html_region.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


# --------------------------------------------------------------------------- 6: language identification


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two thirds of them. Checked by held-out accuracy."""
    from pyspark.sql import functions as F

    from sluicebox.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    languages, model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), languages, model)


# --------------------------------------------------------------------------- 10: near duplicates


@query
def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document. Not for SQL at full size: tested against all pairs."""
    from sluicebox.llm import probminhash

    return probminhash.label(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --------------------------------------------------------------------------- 7: benchmark decontamination


@query
def op7_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    from sluicebox.llm import decontaminate

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.matches(docs.select("doc_id", "text"), items)


#: Shingles of five words (letters and digits in lower case) of `src(id, text)`, distinct by id; one shorter shingle
#: for texts of one to four words. Items of fewer than five words don't occur in the benchmark.
SHINGLES_SQL = r"""
SELECT DISTINCT id, array_to_string(ws[i : i + 4], chr(32)) AS s
FROM (SELECT id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i
      FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS ws FROM {src}))
"""

LEAKS_SQL = f"""
item_s AS ({SHINGLES_SQL.format(src="(SELECT item_id AS id, text FROM benchmark)")}),
item_n AS (SELECT id, count(*) AS n FROM item_s GROUP BY id),
doc_s AS ({SHINGLES_SQL.format(src="leak_src")}),
leaks AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(n.n) AS item_shingles
  FROM doc_s d JOIN item_s i USING (s) JOIN item_n n ON n.id = i.id
  GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n) - 1e-9)
"""

ORACLE["op7_containment_search"] = f"""
WITH leak_src AS (SELECT doc_id AS id, text FROM documents), {LEAKS_SQL}
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM leaks
"""


# --------------------------------------------------------------------------- 8: language-model scoring


@query
def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document. Not for SQL: weights are learned by EM; tested against brute force."""
    from pyspark.sql import functions as F

    from sluicebox.llm import interpolated_lm

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), (~held_out).alias("train"), "text")
    return interpolated_lm.score(docs, "train")


# --------------------------------------------------------------------------- 2: SentencePiece


@query
def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text. Not for SQL: tested against the library."""
    from sluicebox.llm import pieces

    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --------------------------------------------------------------------------- 1: quality classifier


@query
def op1_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from `labels`. Not for SQL: checked by held-out accuracy."""
    from sluicebox.llm import cotrain

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = cotrain.train(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model).selectExpr("doc_id", "text_score", "meta_score", "quality_score", "good AS kept")


# --------------------------------------------------------------------------- 4: web archives


@query
def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, from a legacy archive through the converter to WARC and back."""
    from sluicebox.llm import arc_to_warc

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return arc_to_warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op4_arc_to_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
top AS (SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN top USING (payload_digest)
"""
