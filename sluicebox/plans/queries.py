"""Queries of the engine's operators over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.functions import cells, digests
from sluicebox.operators import actions, decisions, distances, gates, impact, passports, pii, predictions, profile, rules, splits, synthetic, text
from sluicebox.plans import versions
from sluicebox.session import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with the SQL that checks it."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


# --------------------------------------------------------------------------- stand-ins for tables that don't exist


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw string cells; every seventh value is missing."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 7 != 0, F.col("value").cast("decimal(18,3)").cast("string"))
    return e.select(
        "event_id", F.col("event_id").cast("string").alias("event_key"), F.col("user_id").cast("string").alias("user_id"), "event_type",
        value.alias("value"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "props", F.when(F.col("event_id") % 2 == 0, "0").otherwise("1").alias("flag"),
    )


RAW_EVENTS = """raw_events AS (SELECT event_id, event_id::VARCHAR AS event_key, user_id::VARCHAR AS user_id, event_type,
  CASE WHEN event_id % 7 <> 0 THEN value::DECIMAL(18,3)::VARCHAR END AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, props,
  CASE WHEN event_id % 2 = 0 THEN '0' ELSE '1' END AS flag FROM events)"""


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with a missing balance in every fifth row, more often in one segment."""
    c = table(spark, sf_dir, "customer")
    gone = (F.col("c_custkey") % 5 == 0) | ((F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 2 == 0))
    return c.select("c_custkey", "c_mktsegment", "c_nationkey", F.when(~gone, F.col("c_acctbal")).alias("c_acctbal"))


BALANCES = """balances AS (SELECT c_custkey, c_mktsegment, c_nationkey,
  CASE WHEN NOT (c_custkey % 5 = 0 OR (c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0)) THEN c_acctbal END AS c_acctbal FROM customer)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for labelled documents: a probability made of the id, three classes."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    p, q = (F.col("doc_id") * 37 + 11) % 101 / 100.0, (F.col("doc_id") * 13 + 5) % 11 / 100.0
    a, b, c = F.col("p") * (1 - F.col("q")), (1 - F.col("p")) * (1 - F.col("q")), F.col("q")
    rows = labels.join(docs, "doc_id").withColumn("p", p).withColumn("q", q).withColumn("a", a).withColumn("b", b).withColumn("c", c)
    best = F.when((F.col("a") >= F.col("b")) & (F.col("a") >= F.col("c")), "1").when(F.col("b") >= F.col("c"), "0").otherwise("2")
    return rows.select(
        F.col("doc_id").cast("string").alias("object_id"), F.col("quality").cast("string").alias("true_label"), best.alias("predicted_label"), "lang",
        F.create_map(F.lit("1"), F.col("a"), F.lit("0"), F.col("b"), F.lit("2"), F.col("c")).alias("predicted_proba"),
    )


SCORED = """base AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
doc_lang AS (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY doc_id),
pq AS (SELECT doc_id, quality, lang, ((doc_id * 37 + 11) % 101) / 100.0::DOUBLE AS p, ((doc_id * 13 + 5) % 11) / 100.0::DOUBLE AS q FROM base JOIN doc_lang USING (doc_id)),
abc AS (SELECT *, p * (1 - q) AS a, (1 - p) * (1 - q) AS b, q AS c FROM pq),
preds AS (SELECT doc_id::VARCHAR AS object_id, quality::VARCHAR AS true_label, lang, a, b, c,
  CASE WHEN a >= b AND a >= c THEN '1' WHEN b >= c THEN '0' ELSE '2' END AS predicted_label FROM abc),
sig0 AS (SELECT *, greatest(a, b, c) AS confidence, greatest(a, b, c) - list_sort([a, b, c])[2] AS margin,
  -(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END) AS entropy FROM preds),
sig AS (SELECT *, entropy / ln(3) AS nent, predicted_label <> true_label AS label_conflict FROM sig0),
signals AS (SELECT *, least(1, greatest(0, ((1 - confidence) + (1 - margin) + nent) / 3)) AS ambiguous_object_score,
  CASE WHEN label_conflict THEN least(1, greatest(0, (confidence + margin + greatest(0, 1 - nent)) / 3)) ELSE 0 END AS probable_label_error_score FROM sig)"""


# --------------------------------------------------------------------------- profile

COLUMNS = ["event_key", "user_id", "event_type", "value", "ts", "props", "flag"]


@query(f"""
WITH {RAW_EVENTS}, cells AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, event_id, {c} AS v FROM raw_events" for c in COLUMNS)}),
n AS (SELECT col, event_id, nullif(v, '') AS v FROM cells),
t AS (SELECT *, lower(trim(v)) IN ('true','false','yes','no') AS tr, regexp_full_match(trim(v), '[+-]?[0-9]+(_[0-9]+)*') AS i,
  regexp_full_match(trim(v), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AS f, try_strptime(v, '%Y-%m-%d %H:%M:%S') IS NOT NULL AS d,
  regexp_full_match(trim(v), '[A-Za-z0-9][A-Za-z0-9_:\\-]*') AS ident FROM n),
s AS (SELECT col, count(*) AS total_count, (count(*) FILTER (v IS NULL))::BIGINT AS null_count, count(DISTINCT v) AS distinct_count,
  arg_min(v, event_id) FILTER (v IS NOT NULL) AS sample_value, coalesce(bool_or(tr), false) AS tr, coalesce(bool_or(i), false) AS i, coalesce(bool_or(f AND NOT i), false) AS f,
  coalesce(bool_or(d), false) AS d, coalesce(bool_or(NOT (tr OR i OR f OR d)), false) AS x, coalesce(bool_and(ident), true) AS ident, coalesce(bool_and(v IN ('0','1')), false) AS bin FROM t GROUP BY col)
SELECT col AS "column", total_count, null_count, null_count / total_count AS null_ratio, distinct_count, sample_value, total_count > 0 AND distinct_count <= 1 AS is_constant,
  CASE WHEN distinct_count = 0 THEN 'unknown' WHEN tr AND NOT x AND NOT f AND NOT d THEN 'boolean' WHEN i AND NOT x AND NOT f AND NOT d AND bin THEN 'boolean'
    WHEN i AND NOT x AND NOT f AND NOT d THEN 'numeric_integer' WHEN (f OR i) AND NOT x AND NOT d THEN 'numeric_float' WHEN d AND NOT x AND NOT i AND NOT f THEN 'datetime'
    WHEN ident AND distinct_count / (total_count - null_count) >= 0.9 THEN 'identifier'
    WHEN x AND distinct_count / (total_count - null_count) < 0.5 AND distinct_count <= 50 THEN 'categorical' WHEN x THEN 'text' ELSE 'unknown' END AS inferred_type FROM s
""")
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(raw_events(spark, sf_dir), COLUMNS, "event_id")


@query(f"""
WITH {BALANCES}, g AS (SELECT c_mktsegment AS seg, GROUPING(c_mktsegment) AS a, count(*) AS total_count, count(*) FILTER (c_acctbal IS NULL) AS missing_count
  FROM balances GROUP BY GROUPING SETS ((), (c_mktsegment)))
SELECT 'c_acctbal' AS "column", CASE WHEN a = 0 THEN 'c_mktsegment' END AS group_column, seg AS group_value, total_count, missing_count, missing_count / total_count AS missing_ratio FROM g
""")
def missingness_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.missingness(balances(spark, sf_dir), ["c_acctbal"], ["c_mktsegment"])


@query("""
WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT sum(n)::BIGINT AS row_count, count(*) FILTER (n > 1) AS group_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS affected_rows, sum(n - 1)::BIGINT AS pair_count FROM g
""")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
SELECT min(doc_id) AS canonical_id, count(*) AS group_size FROM documents GROUP BY text, lang HAVING count(*) > 1
""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.duplicate_groups(table(spark, sf_dir, "documents"), ["text", "lang"], "doc_id").select("canonical_id", "group_size")


@query("""
WITH v AS (SELECT 'l_extendedprice' AS c, l_extendedprice AS x FROM lineitem UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem),
q AS (SELECT c, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY c),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT f.c AS "column", any_value(n) AS n, any_value(q1) AS q1, any_value(q3) AS q3, any_value(low) AS low, any_value(high) AS high,
  count(*) FILTER (x < low OR x > high) AS outlier_count FROM f JOIN v USING (c) GROUP BY f.c
""")
def outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.outlier_summary(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id AS id, 'value' AS "column", value FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
""")
def outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.outliers(table(spark, sf_dir, "events"), ["value"], "event_id")


@query("""
WITH c AS (SELECT toxic::VARCHAR AS label, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY toxic),
s AS (SELECT sum(n)::BIGINT AS total, max(n) AS most, count(*) AS k, arg_min(label, (n, label)) AS rare, min(n) AS few FROM c)
SELECT total AS total_samples, rare AS rare_class_label, few AS rare_class_count, few / total AS rare_class_ratio, most / few AS imbalance_ratio,
  least(1.0, 1 / ln(1 + most / few)) AS balance_score, least(1.0, few * k / total) AS balance_score_alternative FROM s
""")
def class_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_imbalance(table(spark, sf_dir, "labels"), "toxic")


@query("""
SELECT label::VARCHAR AS label, count(*) AS count, (1 - pow(0.999, count(*))) / (1 - 0.999) AS effective_number FROM embeddings WHERE label IS NOT NULL GROUP BY label
""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.class_counts(table(spark, sf_dir, "embeddings"), "label")


@query("""
SELECT 'toxic' AS "column", CASE WHEN r >= 0.5 THEN 'high_target_match_rate' ELSE 'name_pattern_leakage_candidate' END AS reason_code, r AS target_match_rate
FROM (SELECT avg((toxic = quality)::INT) AS r FROM labels)
""")
def leakage_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.leakage_candidates(table(spark, sf_dir, "labels"), "quality", ["toxic"])


RULES = rules.parse_rules([
    {"rule_id": "price_positive", "severity": "critical", "checks": [{"field": "l_extendedprice", "op": "gt", "value": 0}]},
    {"rule_id": "small_discount", "checks": [{"field": "l_discount", "op": "lte", "value": 0.05}, {"field": "l_quantity", "op": "gte", "value": 5}]},
    {"rule_id": "known_flag", "checks": [{"field": "l_returnflag", "op": "in", "value": ["A", "N"]}]},
    {"rule_id": "not_open", "checks": [{"field": "l_linestatus", "op": "ne", "value": "O"}]},
])


@query("""
WITH r AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(l_extendedprice > 0, false)) AS a, count(*) FILTER (NOT (l_discount <= 0.05 AND l_quantity >= 5)) AS b,
  count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS c, count(*) FILTER (l_linestatus = 'O') AS d FROM lineitem)
SELECT rule_id, severity, n AS evaluated, v AS violations, 1 - v / n AS pass_rate, severity = 'critical' AND v > 0 AS blocker FROM (
  SELECT 'price_positive' AS rule_id, 'critical' AS severity, n, a AS v FROM r UNION ALL SELECT 'small_discount', 'warning', n, b FROM r
  UNION ALL SELECT 'known_flag', 'warning', n, c FROM r UNION ALL SELECT 'not_open', 'warning', n, d FROM r)
""")
def rules_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_summary(table(spark, sf_dir, "lineitem"), RULES)


@query("""
SELECT o_orderkey AS id, 'urgent_value' AS rule_id, 'warning' AS severity,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN 'o_orderpriority' ELSE 'o_totalprice' END AS field FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_totalprice < 100000
""")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = (rules.Check("o_orderpriority", "eq", "1-URGENT"), rules.Check("o_totalprice", "gte", 100000))
    return rules.violations(table(spark, sf_dir, "orders"), (rules.Rule("urgent_value", checks),), "o_orderkey")


# --------------------------------------------------------------------------- text and personal data


@query(r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)
SELECT sha256(t) AS text_sha256, count(*) AS group_size, min(doc_id) AS canonical_id FROM n GROUP BY t HAVING count(*) > 1
""")
def text_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.duplicate_texts(table(spark, sf_dir, "documents"), "doc_id")


@query(r"""
WITH v AS (SELECT source, text, CASE WHEN doc_id IS NULL OR text IS NULL THEN 'missing_required_field' WHEN trim(regexp_replace(lower(text), '\s+', ' ', 'g')) = '' THEN 'empty_text'
  WHEN length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) < 100 THEN 'text_too_short' END AS r FROM documents)
SELECT source, count(*) AS record_count, count(*) FILTER (r IS NULL) AS valid_count, count(*) FILTER (r IS NOT NULL) AS issue_count, avg(length(text)) FILTER (r IS NULL) AS avg_length,
  min(length(text)) FILTER (r IS NULL) AS min_length, max(length(text)) FILTER (r IS NULL) AS max_length FROM v GROUP BY source
""")
def text_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("object_id", F.col("doc_id").cast("string"))
    return text.source_stats(text.validate(docs, "object_id", "text", 100), by=["source"])


@query("""
SELECT (event_id % 3)::BIGINT AS kind, count(*) AS records, count(*) FILTER (event_id % 3 <> 0) AS issues FROM events GROUP BY 1
""")
def jsonl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of three kinds: valid, without a text, not JSON."""
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("object_id"), F.concat(F.lit("event "), "event_type").alias("text")))
    line = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_id").cast("string").alias("object_id")))).otherwise(F.lit("{broken"))
    parsed = text.parse_lines(e.select(F.col("event_id").alias("line_number"), line.alias("value")))
    return parsed.groupBy((F.col("line_number") % 3).alias("kind")).agg(F.count("*").alias("records"), F.count("reason_code").alias("issues"))


@query("""
SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS first_line, turn > min(turn) OVER (PARTITION BY conv_id) AS is_repeat FROM conversations
""")
def first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.first_by_id(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "first_line", "is_repeat")


@query(r"""
WITH t0 AS (SELECT doc_id, text AS t FROM documents),
p AS (SELECT '(?i)\b(?:token|secret|password|api[_\-]?key)[ \t\r\n\f]*[:=][ \t\r\n\f]*[''"]?[^''" \t\r\n\f,}]+' AS secret, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b' AS email,
  '(?i)\b(?:passport[ \t\r\n\f]*[:#-]?[ \t\r\n\f]*)?[A-Z]{0,2}[0-9]{4}[ \t\r\n\f\-]?[0-9]{6}\b' AS passport, '\b(?:[0-9][ \-]?){12,18}[0-9]\b' AS card),
t1 AS (SELECT doc_id, len(regexp_extract_all(t, '(?i)\b(?:token|secret|password|api[_\-]?key)[ \t\r\n\f]*[:=][ \t\r\n\f]*[''"]?[^''" \t\r\n\f,}]+')) AS n_secret,
  regexp_replace(t, '(?i)\b(?:token|secret|password|api[_\-]?key)[ \t\r\n\f]*[:=][ \t\r\n\f]*[''"]?[^''" \t\r\n\f,}]+', '[REDACTED_SECRET]', 'g') AS t FROM t0),
t2 AS (SELECT doc_id, n_secret, len(regexp_extract_all(t, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b')) AS n_email,
  regexp_replace(t, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b', '[REDACTED_EMAIL]', 'g') AS t FROM t1),
t3 AS (SELECT doc_id, n_secret, n_email, len(regexp_extract_all(t, '(?i)\b(?:passport[ \t\r\n\f]*[:#-]?[ \t\r\n\f]*)?[A-Z]{0,2}[0-9]{4}[ \t\r\n\f\-]?[0-9]{6}\b')) AS n_passport,
  regexp_replace(t, '(?i)\b(?:passport[ \t\r\n\f]*[:#-]?[ \t\r\n\f]*)?[A-Z]{0,2}[0-9]{4}[ \t\r\n\f\-]?[0-9]{6}\b', '[REDACTED_PASSPORT]', 'g') AS t FROM t2),
c AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(t, '\b(?:[0-9][ \-]?){12,18}[0-9]\b'), lambda x: regexp_replace(x, '[ \-]', '', 'g'))) AS d FROM t3),
l AS (SELECT doc_id, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT
  WHEN substr(d, i, 1)::INT * 2 > 9 THEN substr(d, i, 1)::INT * 2 - 9 ELSE substr(d, i, 1)::INT * 2 END)) % 10 = 0 AS ok FROM c),
k AS (SELECT doc_id, count(*) AS n FROM l WHERE ok GROUP BY doc_id)
SELECT t3.doc_id, n_secret::BIGINT AS n_secret, n_email::BIGINT AS n_email, n_passport::BIGINT AS n_passport, coalesce(k.n, 0) AS n_payment_card FROM t3 LEFT JOIN k USING (doc_id)
""")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_secret", "n_email", "n_passport", "n_payment_card")


def redacted_sql(source: str, keys: str) -> str:
    """WITH clauses that end in `redacted`: `keys`, text, t (its redaction) and n_<category> by category.

    DuckDB's patterns have no look-behind: a phone number takes the character before it along and puts it back. What
    follows its last digit is no digit in any case, since the run is as long as it can be.
    """
    plain = {
        "secret": r"""(?i)\b(?:token|secret|password|api[_\-]?key)\s*[:=]\s*[''"]?[^''"\s,}]+""", "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        "passport": r"(?i)\b(?:passport\s*[:#-]?\s*)?[A-Z]{0,2}[0-9]{4}[\s\-]?[0-9]{6}\b", "payment_card": r"\b(?:[0-9][ \-]?){12,18}[0-9]\b",
        "bank_account": r"(?i)\b(?:account|acct|iban)[:#\s\-]*(?:[A-Z0-9]{8,34})\b", "phone": r"(^|[^0-9.])(?:\+?[0-9][\s().\-]*){9,}[0-9]",
    }
    steps, last, counts = [], f"(SELECT {keys}, text, text AS t FROM {source})", ""
    for name, pattern in plain.items():
        token, more = f"[REDACTED_{name.upper()}]", f"{counts}, " if counts else ""
        if name == "payment_card":
            # A candidate is replaced if its checksum holds; the text is cut at all candidates and put together again.
            digit = "substr(d, i, 1)::INT"
            steps += [
                f"""c1 AS (SELECT *, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS pieces FROM {last})""",
                f"""c2 AS (SELECT *, list_transform(list_transform(found, lambda x: regexp_replace(x, '[\\s\\-]', '', 'g')), lambda d: list_sum(list_transform(range(1, len(d) + 1),
  lambda i: CASE WHEN (len(d) - i) % 2 = 0 THEN {digit} WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0) AS ok FROM c1)""",
                f"""d_{name} AS (SELECT {keys}, text, {more}coalesce(len(list_filter(ok, lambda x: x)), 0) AS n_{name}, CASE WHEN len(found) = 0 THEN t ELSE
  array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || CASE WHEN i > len(found) THEN '' WHEN ok[i] THEN '{token}' ELSE found[i] END), '') END AS t FROM c2)""",
            ]
        else:
            put = "\\1" + token if name == "phone" else token
            steps.append(f"d_{name} AS (SELECT {keys}, text, {more}coalesce(len(regexp_extract_all(t, '{pattern}')), 0) AS n_{name}, regexp_replace(t, '{pattern}', '{put}', 'g') AS t FROM {last})")
        last, counts = f"d_{name}", f"{more}n_{name}"
    total = " + ".join(f"n_{name}" for name in plain)
    return ",\n".join([*steps, f"redacted AS (SELECT *, ({total})::BIGINT AS pii_token_count FROM {last})"])


REDACTED = f"""t AS redacted_text, pii_token_count, 'sha256:' || sha256(t) AS redacted_text_sha256,
  least(1.0, ({" + ".join(f"n_{name} * {w}" for name, w in pii.WEIGHTS.items())})::DOUBLE / greatest(1.0, coalesce(length(text), 0) / 100.0)) AS pii_risk_score FROM redacted"""


@query(f"""
WITH {redacted_sql("conversations", "conv_id, turn")}
SELECT conv_id, turn, {REDACTED}
""")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "redacted_text", "pii_token_count", "pii_risk_score", "redacted_text_sha256")


@query(f"""
WITH {redacted_sql("documents", "doc_id")}
SELECT doc_id, {REDACTED}
""")
def pii_redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "redacted_text", "pii_token_count", "pii_risk_score", "redacted_text_sha256")


@query(f"""
WITH {redacted_sql("documents", "doc_id")}
SELECT count(*) AS record_count, count(*) FILTER (pii_token_count > 0) AS pii_record_count, coalesce(sum(pii_token_count), 0)::BIGINT AS pii_token_count,
  {", ".join(f"coalesce(sum(n_{name}), 0)::BIGINT AS n_{name}" for name in pii.WEIGHTS)} FROM redacted
""")
def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.totals(pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(r"""
WITH c AS (SELECT CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'email'
  WHEN regexp_matches(text, '(?:\+[0-9][0-9\s\-()]{5,}[0-9]|[0-9][0-9]*[\s\-()][0-9\s\-()]{4,}[0-9])') THEN 'phone' WHEN regexp_matches(text, '\b[0-9]{4}\s[0-9]{6}\b') THEN 'passport_like' END AS category FROM documents)
SELECT 'text' AS "column", category, count(*) AS cells FROM c WHERE category IS NOT NULL GROUP BY category
""")
def gate_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.gate_scan(table(spark, sf_dir, "documents").select("text"), ["text"])


# --------------------------------------------------------------------------- predictions


@query(f"""
WITH {SCORED} SELECT object_id, confidence, margin, entropy, nent AS normalized_entropy, label_conflict, ambiguous_object_score, probable_label_error_score,
  concat_ws(',', CASE WHEN confidence <= 0.6 OR margin <= 0.2 OR nent >= 0.7 THEN 'ambiguous_object' END, CASE WHEN nent >= 0.7 THEN 'high_model_uncertainty' END,
    CASE WHEN margin <= 0.2 THEN 'low_prediction_margin' END, CASE WHEN label_conflict THEN 'label_conflict,label_support_not_available' END,
    CASE WHEN label_conflict AND confidence >= 0.85 THEN 'probable_label_error,high_confidence_label_conflict' END,
    CASE WHEN label_conflict AND margin >= 0.6 THEN 'large_margin_label_conflict' END, CASE WHEN label_conflict AND nent <= 0.4 THEN 'low_entropy_label_conflict' END) AS reason_codes FROM signals
""")
def prediction_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.signals(scored_labels(spark, sf_dir)).select(
        "object_id", "confidence", "margin", "entropy", "normalized_entropy", "label_conflict", "ambiguous_object_score", "probable_label_error_score",
        F.array_join("reason_codes", ",").alias("reason_codes"),
    )


@query(f"WITH {SCORED} SELECT true_label, predicted_label, count(*) AS count FROM preds GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.confusion(scored_labels(spark, sf_dir))


@query(f"""WITH {SCORED} SELECT lang AS "group", count(*) AS evaluated, count(*) FILTER (label_conflict) AS errors, avg(label_conflict::INT) AS error_rate FROM sig GROUP BY lang""")
def error_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.error_concentration(predictions.signals(scored_labels(spark, sf_dir)), "lang")


@query(f"""
WITH {SCORED} SELECT count(*) AS evaluated, avg((NOT label_conflict)::INT) AS accuracy, count(*) FILTER (label_conflict) AS label_conflicts,
  count(*) FILTER (label_conflict AND confidence >= 0.85) AS high_confidence_errors, count(*) FILTER (confidence <= 0.6 OR margin <= 0.2 OR nent >= 0.7) AS ambiguous,
  count(*) FILTER (label_conflict AND confidence >= 0.85) AS probable_label_errors FROM sig
""")
def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.error_summary(predictions.signals(scored_labels(spark, sf_dir)))


@query("""
WITH m AS (SELECT DISTINCT doc_id FROM documents), p AS (SELECT DISTINCT doc_id + 5 AS doc_id FROM labels)
SELECT count(*) FILTER (m.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS matched, count(*) FILTER (m.doc_id IS NULL) AS unmatched, count(*) FILTER (p.doc_id IS NULL) AS missing,
  count(*) FILTER (m.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) / count(*) FILTER (m.doc_id IS NOT NULL) AS coverage_ratio FROM m FULL JOIN p ON m.doc_id = p.doc_id
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = table(spark, sf_dir, "labels").select((F.col("doc_id") + 5).alias("doc_id"))
    return predictions.coverage(table(spark, sf_dir, "documents"), shifted, "doc_id")


@query(f"""
WITH {SCORED} SELECT CASE WHEN object_id::BIGINT % 10 = 0 THEN 'probability_sum_mismatch' ELSE 'valid' END AS reason_code, count(*) AS rows FROM preds GROUP BY 1
""")
def prediction_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of which every tenth has probabilities that don't sum to one."""
    rows = predictions.signals(scored_labels(spark, sf_dir))
    broken = F.when(F.col("object_id").cast("long") % 10 == 0, F.transform_values("predicted_proba", lambda k, v: v / 2)).otherwise(F.col("predicted_proba"))
    rows = rows.withColumn("predicted_proba", broken)
    return rows.groupBy(F.coalesce(predictions.reason_code(), F.lit("valid")).alias("reason_code")).agg(F.count("*").alias("rows"))


# --------------------------------------------------------------------------- actions


@query(f"WITH {BALANCES} SELECT c_custkey, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM balances)) AS c_acctbal FROM balances")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.impute(balances(spark, sf_dir), "c_acctbal", "median").select("c_custkey", "c_acctbal")


@query(f"""
WITH {BALANCES}, m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM balances GROUP BY 1)
SELECT c_custkey, coalesce(c_acctbal, m, (SELECT median(c_acctbal) FROM balances)) AS c_acctbal, (c_acctbal IS NULL)::INT AS c_acctbal_was_missing FROM balances JOIN m USING (c_mktsegment)
""")
def impute_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.impute(balances(spark, sf_dir), "c_acctbal", "group_median", group="c_mktsegment", flag=True).select("c_custkey", "c_acctbal", "c_acctbal_was_missing")


@query("""
WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders), m AS (SELECT p FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS o_orderpriority FROM o
""")
def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    return actions.impute(rows, "o_orderpriority", "mode")


@query(f"WITH {BALANCES} SELECT c_custkey, c_acctbal, (c_acctbal IS NULL)::INT AS c_acctbal_was_missing FROM balances")
def missing_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.impute(balances(spark, sf_dir), "c_acctbal", "missingness_indicator").select("c_custkey", "c_acctbal", "c_acctbal_was_missing")


@query(f"""
WITH {BALANCES}, x AS (SELECT c_mktsegment, c_acctbal::DECIMAL(30,6) AS x, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n
  FROM balances WHERE c_acctbal IS NOT NULL) SELECT c_mktsegment, avg(x)::DOUBLE AS median FROM x WHERE i IN ((n + 1) // 2, (n + 2) // 2) GROUP BY 1
""")
def exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.median_decimal(balances(spark, sf_dir), "c_acctbal", by=["c_mktsegment"]).withColumn("median", F.col("median").cast("double"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def dedup_keep_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.remove_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query("""
SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate_candidate, doc_id = min(doc_id) OVER (PARTITION BY text) AS is_duplicate_kept FROM documents
""")
def dedup_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions.mark_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], "doc_id").select("doc_id", "is_duplicate_candidate", "is_duplicate_kept")


# --------------------------------------------------------------------------- splits

SPLIT_SQL = """split_orders AS (SELECT *, CASE WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, ('0x' || substr(md5('42:' || o_custkey), 1, 8))::BIGINT / 4294967296.0 AS h FROM orders))"""


@query(f"WITH {SPLIT_SQL} SELECT o_orderkey, split FROM split_orders")
def split_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_split(table(spark, sf_dir, "orders"), "o_custkey").select("o_orderkey", "split")


@query(f"""
WITH {SPLIT_SQL}, c AS (SELECT split, o_orderstatus AS label, count(*) AS n FROM split_orders GROUP BY 1, 2)
SELECT s.split, l.label, coalesce(n, 0) AS count, coalesce(n / sum(n) OVER (PARTITION BY s.split), 0) AS ratio
FROM (VALUES ('train'), ('validation'), ('test')) s(split), (SELECT DISTINCT label FROM c) l LEFT JOIN c ON c.split = s.split AND c.label = l.label
""")
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.class_distribution(splits.hash_split(table(spark, sf_dir, "orders"), "o_custkey"), "o_orderstatus")


@query()
def split_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group-stratified split of orders by customer: sequential by nature, so rows only; tested for whole groups."""
    return splits.group_stratified_split(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "split")


@query("""
WITH d AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM documents),
a AS (SELECT count(*) AS n FROM (SELECT text FROM d GROUP BY text HAVING count(DISTINCT split) > 1)), b AS (SELECT count(*) AS n FROM (SELECT source FROM d WHERE source <> '' GROUP BY source HAVING count(DISTINCT split) > 1))
SELECT 'exact_hash' AS "check", CASE WHEN n > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, CASE WHEN n > 0 THEN 'BLOCKER' ELSE 'INFO' END AS severity, n AS affected, CASE WHEN n > 0 THEN 'BLOCK_MODEL_EVALUATION' END AS action FROM a
UNION ALL SELECT 'group_key', CASE WHEN n > 0 THEN 'FAILED' ELSE 'PASSED' END, CASE WHEN n > 0 THEN 'BLOCKER' ELSE 'INFO' END, n, CASE WHEN n > 0 THEN 'BLOCK_MODEL_EVALUATION' END FROM b
""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    return splits.leakage_checks(docs.withColumn("split", split), ["text"], "source")


# --------------------------------------------------------------------------- distances and synthetic rows


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


PAIRS = """e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE id % 50 = 0),
d AS (SELECT q.id AS query_id, e.id, sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda z: (z[1] - z[2]) ** 2))) AS distance FROM q, e)"""


@query(f"""
WITH {PAIRS}, n AS (SELECT query_id, min(distance) AS m FROM d WHERE id % 50 <> 0 GROUP BY query_id)
SELECT count(*) AS synthetic_count, min(m) AS min_distance, avg(m) AS mean_distance, median(m) AS median_distance, count(*) FILTER (m <= 1e-9) AS collisions FROM n
""")
def dcr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return distances.closest_record_stats(v.where("id % 50 = 0"), v.where("id % 50 <> 0"))


@query(f"""
WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d WHERE id <> query_id) SELECT query_id, id, rank::INT AS rank, distance FROM r WHERE rank <= 5
""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return distances.nearest(v.where("id % 50 = 0"), v, 5, exclude_same_id=True)


DIMENSIONS = [f"x{i}" for i in range(64)]


def flat_vectors(spark: SparkSession, sf_dir: str, id_name: str = "vec_id") -> DataFrame:
    """embeddings with a column for each dimension, and one class against the rest as the target."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias(id_name), *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(DIMENSIONS)], F.when(F.col("label") == 0, "1").otherwise("0").alias("target"))


@query(f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN label = 0 THEN '1' ELSE '0' END AS target FROM embeddings),
r AS (SELECT vec_id, v, row_number() OVER (ORDER BY ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT % 4096, vec_id) - 1 AS k FROM e WHERE target = '1'),
c AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT max(m) FROM (SELECT count(*) AS m FROM e GROUP BY target)) AS most),
near AS (SELECT a.k AS seed, b.k AS other, row_number() OVER (PARTITION BY a.k ORDER BY list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)), b.k) AS rank FROM r a, r b WHERE a.k <> b.k),
i AS (SELECT unnest(range(0, greatest(n, round_even(most * 0.5, 0)::BIGINT) - n)) AS i, n FROM c),
u AS (SELECT i, n, ('0x' || substr(md5('42:seed:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS a, ('0x' || substr(md5('42:neighbor:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS b,
  ('0x' || substr(md5('42:lambda:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS l FROM i),
d AS (SELECT i, l, floor(a * n)::BIGINT AS seed, floor(b * least(5, n - 1))::BIGINT + 1 AS rank FROM u)
SELECT 'synthetic_' || lpad(i::VARCHAR, 6, '0') AS vec_id, {", ".join(f"s.v[{j + 1}] + l * (o.v[{j + 1}] - s.v[{j + 1}]) AS {x}" for j, x in enumerate(DIMENSIONS))},
  '1' AS target, 1 AS is_synthetic, 'train' AS synthetic_source_split, s.vec_id::VARCHAR AS seed_id, o.vec_id::VARCHAR AS neighbor_id, l AS lambda
FROM d JOIN near USING (seed, rank) JOIN r s ON s.k = d.seed JOIN r o ON o.k = near.other
""")
def smote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for the smallest of two classes of vectors, drawn by MD5."""
    return synthetic.smote(flat_vectors(spark, sf_dir), "target", "1", DIMENSIONS, "vec_id", strategy=0.5)


@query()
def copula_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows like orders. Random by hash; tested for marginal distributions and correlations."""
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", F.col("l_returnflag").alias("target"))
    return synthetic.copula(rows, "target", ["l_quantity", "l_extendedprice", "l_discount"], "object_id")


@query("""
SELECT a, b, CASE WHEN a = b THEN 1 ELSE greatest(-0.999999, least(0.999999, r)) END AS correlation FROM (
  SELECT 'l_quantity' AS a, 'l_quantity' AS b, 1.0 AS r UNION ALL SELECT 'l_quantity', 'l_extendedprice', (SELECT corr(l_quantity, l_extendedprice) FROM lineitem)
  UNION ALL SELECT 'l_quantity', 'l_discount', (SELECT corr(l_quantity, l_discount) FROM lineitem) UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0
  UNION ALL SELECT 'l_extendedprice', 'l_discount', (SELECT corr(l_extendedprice, l_discount) FROM lineitem) UNION ALL SELECT 'l_discount', 'l_discount', 1.0)
""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("correlation", F.round("correlation", 9))


@query("""
SELECT 'o_totalprice' AS "column", l::DOUBLE AS level, quantile_cont(o_totalprice, l) AS value FROM orders, (SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS l) GROUP BY l
""".replace("quantile_cont(o_totalprice, l)", "CASE l WHEN 0.0 THEN min(o_totalprice) WHEN 0.1 THEN quantile_cont(o_totalprice, 0.1) WHEN 0.25 THEN quantile_cont(o_totalprice, 0.25) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5) WHEN 0.75 THEN quantile_cont(o_totalprice, 0.75) WHEN 0.9 THEN quantile_cont(o_totalprice, 0.9) ELSE max(o_totalprice) END"))
def quantile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.quantile_grid(table(spark, sf_dir, "orders"), ["o_totalprice"])


# --------------------------------------------------------------------------- gates and model impact


@query("""
WITH s AS (SELECT *, l_orderkey % 997 = 0 AS syn FROM lineitem), real AS (SELECT DISTINCT l_quantity, l_discount, l_tax FROM s WHERE NOT syn)
SELECT count(*) AS copies FROM s JOIN real USING (l_quantity, l_discount, l_tax) WHERE syn
""")
def gate_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    made = F.col("l_orderkey") % 997 == 0
    return gates.exact_copies(rows.where(made), rows.where(~made), ["l_quantity", "l_discount", "l_tax"]).agg(F.count("*").alias("copies"))


@query()
def validation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates of a candidate made of vectors. Its parts have SQL of their own."""
    flat, features = flat_vectors(spark, sf_dir, "object_id"), DIMENSIONS
    made = synthetic.augmented(flat, stage(synthetic.smote(flat, "target", "1", features, "object_id", strategy=0.5), "made"))
    parted = splits.hash_split(flat, "object_id")
    return gates.run_gates(
        gates.schema_gate(made, ["object_id", *features, "target"], features),
        gates.rules_gate(made, (rules.Rule("known_target", (rules.Check("target", "in", ["0", "1"]),), "critical"),)),
        gates.privacy_gate(made, ["target"]),
        gates.split_gate(splits.leakage_checks(parted, features, "object_id")),
        gates.synthetic_gates(made.where("is_synthetic = 1"), flat, features, "object_id"),
    )


@query(f"""
WITH {SCORED}, m AS (SELECT unnest(['0', '1', '2']) AS label), s AS (SELECT label, count(*) FILTER (true_label = label AND predicted_label = label)::DOUBLE AS tp,
  count(*) FILTER (true_label = label AND predicted_label <> label) AS fn, count(*) FILTER (true_label <> label AND predicted_label = label) AS fp FROM m, preds GROUP BY label)
SELECT label, (tp + fn)::BIGINT AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM s WHERE tp + fn + fp > 0
""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.class_metrics(scored_labels(spark, sf_dir), "true_label", "predicted_label")


@query(f"""
WITH {SCORED}, c AS (SELECT a AS s, count(*) AS n, count(*) FILTER (true_label = '0') AS t FROM preds GROUP BY a),
r AS (SELECT t, sum(t) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC) AS p FROM c) SELECT sum(p * t) / sum(t) AS pr_auc FROM r
""")
def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scored_labels(spark, sf_dir).withColumn("score", F.col("predicted_proba")["1"])
    return impact.average_precision(scored, "0", "score", "true_label")


@query()
def model_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a baseline model that tells one class of vectors from the rest."""
    flat, features = flat_vectors(spark, sf_dir), DIMENSIONS
    parted = splits.hash_split(flat, "vec_id", {"train": 0.7, "test": 0.3})
    scored = impact.train_and_score(parted.where("split = 'train'"), parted.where("split = 'test'"), features, "target", "1")
    return impact.metrics(scored, "1")


@query(f"""
WITH {SPLIT_SQL} SELECT split, count(*) AS rows, count(nullif(o_orderstatus, '')) AS labelled, count(*) FILTER (o_orderstatus = 'P') AS rare_rows FROM split_orders GROUP BY split
""")
def eligibility_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.split_stats(splits.hash_split(table(spark, sf_dir, "orders"), "o_custkey"), "o_orderstatus", "P")


# --------------------------------------------------------------------------- decisions


def document_passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passports of labelled documents: text signals, exact copies and predictions."""
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    objects = docs.select(F.col("doc_id").cast("string").alias("object_id"), "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("label")).select(F.col("doc_id").cast("string").alias("object_id"), "label")
    manifest = objects.select("object_id", F.lit("text").alias("modality")).join(labels, "object_id", "left")
    copies = objects.groupBy("text").count().where("count > 1").select("text", F.lit(True).alias("is_duplicate"))
    emails = F.coalesce(F.regexp_count("text", F.lit(pii.GATE_PATTERNS[0][1])), F.lit(0)).cast("long")
    signals = objects.select("object_id", "text", (F.length("text") < 100).alias("has_issue"), emails.alias("pii_token_count")).withColumn(
        "pii_risk_score", F.least(F.lit(1.0), 0.5 * F.col("pii_token_count") / F.greatest(F.lit(1.0), F.length("text") / 100.0))
    ).join(copies, "text", "left")
    predicted = predictions.signals(scored_labels(spark, sf_dir)).select(
        "object_id", "confidence", "margin", "normalized_entropy", "ambiguous_object_score", "probable_label_error_score"
    )
    return passports.passports(manifest, signals, predicted, rare_label="0", rare_share=0.15)


PASSPORT_SQL = SCORED + r""",
d1 AS (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id),
cp AS (SELECT text FROM d1 GROUP BY text HAVING count(*) > 1),
tx AS (SELECT d1.doc_id::VARCHAR AS object_id, length(d1.text) < 100 AS has_issue, len(regexp_extract_all(d1.text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS k, length(d1.text) AS n,
  cp.text IS NOT NULL AS dup, l.quality::VARCHAR AS label FROM d1 LEFT JOIN cp ON cp.text = d1.text LEFT JOIN base l ON l.doc_id = d1.doc_id),
ps AS (SELECT tx.object_id, CASE WHEN has_issue THEN 0.6 ELSE 1.0 END AS technical_quality, least(1.0, 0.5 * k / greatest(1.0, n / 100.0)) AS privacy_risk, dup::INT::DOUBLE AS duplicate_score,
  CASE WHEN coalesce(label = '0', false) THEN 0.85 ELSE 0.0 END AS rare, s.confidence, s.margin, s.nent, s.ambiguous_object_score AS amb, s.probable_label_error_score AS err FROM tx LEFT JOIN signals s USING (object_id)),
ov AS (SELECT *, coalesce(1 - confidence, nent, amb, 0) AS unc, greatest(rare, coalesce(1 - confidence, nent, amb, 0), coalesce(amb, 0), coalesce(err, 0)) AS lv FROM ps),
val AS (SELECT *, 0.25 * lv + 0.20 * rare + 0.20 * unc - 0.15 * duplicate_score - 0.10 * (1 - technical_quality) - 0.25 * privacy_risk - 0.10 * coalesce(err, 0) AS raw_value FROM ov),
dec AS (SELECT *, greatest(0, least(1, raw_value)) AS object_value, privacy_risk >= 0.8 AS hard_blocked, CASE WHEN privacy_risk >= 0.8 THEN 'BLOCK_EXPORT' WHEN coalesce(err >= 0.5, false) OR coalesce(amb >= 0.5, false) THEN 'SEND_TO_LABEL_REVIEW'
  WHEN privacy_risk >= 0.01 THEN 'SEND_TO_PRIVACY_REVIEW' WHEN duplicate_score >= 0.5 THEN 'REMOVE_DUPLICATE' WHEN rare >= 0.7 THEN 'AUGMENT_RARE_CLASS' ELSE 'KEEP' END AS action FROM val)"""


@query(f"WITH {PASSPORT_SQL} SELECT object_id, raw_value, object_value FROM dec")
def object_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.object_value(document_passports(spark, sf_dir)).select("object_id", "raw_value", "object_value")


@query(f"WITH {PASSPORT_SQL} SELECT action, hard_blocked, count(*) AS objects, avg(object_value) AS mean_value FROM dec GROUP BY 1, 2")
def object_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(decisions.object_value(document_passports(spark, sf_dir)))
    return decided.groupBy("action", "hard_blocked").agg(F.count("*").alias("objects"), F.avg("object_value").alias("mean_value"))


@query(f"""
WITH {PASSPORT_SQL}, q AS (
  SELECT 'label_review' AS queue, object_id, greatest(amb, coalesce(1 - confidence, 0), 1 - coalesce(margin, 1)) AS p FROM dec WHERE amb >= 0.5 OR unc >= 0.5
  UNION ALL SELECT 'label_review', object_id, greatest(coalesce(err, 0), coalesce(confidence, 0)) FROM dec WHERE err >= 0.5
  UNION ALL SELECT 'privacy_review', object_id, privacy_risk FROM dec WHERE privacy_risk > 0 UNION ALL SELECT 'duplicate_review', object_id, duplicate_score FROM dec WHERE duplicate_score >= 0.5)
SELECT queue, object_id, round(least(1, greatest(0, p)), 6) AS priority, queue = 'label_review' AS may_leave FROM q
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decisions.decide(decisions.object_value(document_passports(spark, sf_dir)))
    return decisions.review_queue(decided).select("queue", "object_id", "priority", "may_leave")


CODES_SQL = """codes AS (SELECT *, list_distinct(list_filter([CASE WHEN duplicate_score >= 0.5 THEN 'exact_duplicate' END, CASE WHEN rare >= 0.7 THEN 'rare_class_underrepresented' END,
  CASE WHEN privacy_risk >= 0.01 OR privacy_risk > 0 THEN 'text_pii_detected' END, CASE WHEN 1 - technical_quality >= 0.75 THEN 'severe_outlier' END,
  CASE WHEN amb >= 0.5 OR unc >= 0.5 THEN 'ambiguous_object' END, CASE WHEN err >= 0.5 THEN 'probable_label_error' END, CASE WHEN hard_blocked THEN 'pii_unmasked' END], lambda x: x IS NOT NULL)) AS reasons FROM dec),
groups AS (SELECT *, CASE WHEN action = 'KEEP' THEN NULL WHEN action = 'BLOCK_EXPORT' THEN 'SEND_TO_PRIVACY_REVIEW' ELSE action END AS recommended_action,
  coalesce(list_filter(['probable_label_error', 'ambiguous_object', 'text_pii_detected', 'pii_unmasked', 'exact_duplicate', 'rare_class_underrepresented'], lambda x: list_contains(reasons, x))[1], reasons[1]) AS primary_reason FROM codes)"""


@query(f"""
WITH {PASSPORT_SQL}, {CODES_SQL} SELECT recommended_action, 'text' AS modality, primary_reason, count(*) AS objects, avg(object_value) AS mean_value FROM groups
WHERE recommended_action IS NOT NULL GROUP BY ALL
""")
def decision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.action_groups(decisions.decide(decisions.object_value(document_passports(spark, sf_dir))))


@query(f"""
WITH {PASSPORT_SQL}, s AS (SELECT count(*) AS objects, count(*) FILTER (hard_blocked) AS blocked, count(*) FILTER (action <> 'KEEP') AS actions FROM dec)
SELECT objects, blocked, actions, CASE WHEN blocked > 0 THEN 'BLOCKED' WHEN actions > 0 THEN 'NOT_READY_FOR_EXPORT' ELSE 'READY_FOR_EXPORT' END AS readiness, CASE WHEN blocked > 0 THEN 0 WHEN actions > 0 THEN 0.75 ELSE 1 END AS score,
  CASE WHEN blocked > 0 THEN 'BLOCKED' WHEN actions > 0 THEN 'NEEDS_REVIEW' ELSE 'READY_FOR_TRAINING' END AS decision, CASE WHEN actions > 0 THEN 'PREVIEW_ACTION_PLAN' WHEN blocked > 0 THEN NULL ELSE 'EXPORT' END AS next_job FROM s
""")
def dataset_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.readiness(decisions.decide(decisions.object_value(document_passports(spark, sf_dir))))


@query(f"""
WITH {PASSPORT_SQL}, x AS (SELECT object_id, unnest([{{'s': 'technical_quality', 'v': technical_quality}}, {{'s': 'privacy_risk', 'v': privacy_risk}}, {{'s': 'duplicate_score', 'v': duplicate_score}},
  {{'s': 'rare_segment_score', 'v': rare}}, {{'s': 'business_importance', 'v': NULL}}, {{'s': 'label_issue_score', 'v': err}}, {{'s': 'model_uncertainty', 'v': 1 - confidence}}, {{'s': 'prediction_confidence', 'v': confidence}},
  {{'s': 'prediction_margin', 'v': margin}}, {{'s': 'prediction_entropy', 'v': nent}}, {{'s': 'ambiguous_object_score', 'v': amb}}, {{'s': 'probable_label_error_score', 'v': err}}]) AS p, confidence IS NULL AS bare FROM dec)
SELECT object_id, p.s AS signal, p.v::DOUBLE AS value, CASE WHEN p.v IS NULL THEN 'not_applicable' ELSE 'available' END AS status,
  CASE WHEN p.v IS NOT NULL THEN NULL WHEN p.s IN ('technical_quality', 'privacy_risk', 'duplicate_score', 'rare_segment_score', 'business_importance') THEN p.s || '_not_available'
    WHEN bare THEN 'prediction_manifest_not_provided' ELSE 'prediction_signal_not_available' END AS reason,
  CASE WHEN p.v IS NULL THEN NULL WHEN p.s = 'technical_quality' THEN 0.95 WHEN p.s IN ('duplicate_score', 'privacy_risk') THEN 0.9 WHEN p.s IN ('rare_segment_score', 'business_importance') THEN NULL ELSE 0.82 END::DOUBLE AS confidence FROM x
""")
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of every document, a row for each signal."""
    bundles = passports.evidence(document_passports(spark, sf_dir))
    each = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(f"signals.{n}").alias("of")) for n in passports.SIGNALS])
    rows = bundles.select("object_id", "confidence", F.explode(each).alias("x"))
    return rows.select("object_id", "x.signal", "x.of.value", "x.of.status", "x.of.reason", F.col("confidence")[F.col("x.signal")].alias("confidence"))


@query(f"""
WITH {PASSPORT_SQL}, g AS (SELECT count(*) FILTER (privacy_risk >= 0.8) AS own, (SELECT count(*) > 0 FROM lineitem WHERE NOT coalesce(l_discount <= 0.09, false)) AS broken FROM dec), n AS (SELECT count(*) AS n FROM dec)
SELECT 'BUSINESS_RULE_FAILURE' AS code, 'critical' AS severity, 'BLOCK_RULES_REVIEW' AS action, n AS objects FROM g, n WHERE broken
UNION ALL SELECT 'PII_UNMASKED', 'critical', 'BLOCK_PRIVACY_REVIEW', own FROM g WHERE own > 0
""")
def hard_gate_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What blocks the documents if a critical rule of another table fails."""
    rule = rules.Rule("discount", (rules.Check("l_discount", "lte", 0.09),), "critical")
    broken = rules.rule_summary(table(spark, sf_dir, "lineitem"), (rule,)).first()["blocker"]
    triggered = decisions.hard_gates(business_rule_failure=broken)
    decided = decisions.decide(decisions.object_value(document_passports(spark, sf_dir)), triggered)
    return decisions.critical_blockers(decided, triggered).drop("examples")


@query("""
WITH d AS (SELECT count(*) AS rows, coalesce(sum(n) FILTER (n > 1), 0) AS dup FROM (SELECT count(*) AS n FROM labels GROUP BY quality, toxic)),
r AS (SELECT sum(n) AS rows, coalesce(sum(n) FILTER (n > 1), 0) AS dup FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)),
c AS (SELECT min(n) AS few, max(n) AS most, sum(n) AS total FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)),
p AS (SELECT 1 - dup / rows AS uniqueness, least(1.0, 1 / ln(1 + most / few)) AS balance, dup / rows >= 0.05 AS severe, most / few >= 10 OR few / total <= 0.05 AS uneven FROM r, c)
SELECT round(least(100, greatest(0, 100 * (0.15 + 0.15 + 0.12 * round(uniqueness, 6) + 0.15 * round(balance, 6) + 0.18 + 0.15 + 0.10) - CASE WHEN severe THEN 10 ELSE 0 END - CASE WHEN uneven THEN 10 ELSE 0 END)), 6) AS score,
  round(uniqueness, 6) AS uniqueness, round(balance, 6) AS balance, concat_ws(',', CASE WHEN severe THEN 'severe_duplicates' END, CASE WHEN uneven THEN 'severe_class_imbalance' END) AS penalties FROM p
""")
def dataset_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of a dataset whose rows are those of lineitem and whose classes are those of labels."""
    from sluicebox.plans.score import Facts
    from sluicebox.plans.score import dataset_score as score_of

    dup = profile.duplicate_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).first()
    classes = profile.class_imbalance(table(spark, sf_dir, "labels"), "toxic").first()
    found = score_of(Facts(
        rows=dup["row_count"], duplicate_rows=dup["affected_rows"], balance=classes["balance_score"], imbalance_ratio=classes["imbalance_ratio"],
        minority_share=classes["rare_class_ratio"],
    ))
    row = (found.raw, found.components["uniqueness"], found.components["balance"], ",".join(found.penalties))
    return spark.createDataFrame([row], "score double, uniqueness double, balance double, penalties string")


@query(f"""
WITH {BALANCES} SELECT 'c_acctbal' AS "column", 'median' AS method, count(*) FILTER (c_acctbal IS NULL) AS missing_before, 0::BIGINT AS missing_after, count(*) FILTER (c_acctbal IS NULL) AS imputed FROM balances
""")
def version_compare_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = balances(spark, sf_dir)
    return versions.imputed_fields(before, actions.impute(before, "c_acctbal", "median"), {"c_acctbal": "median"})


# --------------------------------------------------------------------------- versions, identity, export


@query("""
WITH b AS (SELECT quality::VARCHAR AS label, count(*) AS n FROM labels GROUP BY 1), a AS (SELECT quality::VARCHAR AS label, count(*) AS n FROM labels WHERE toxic = 0 GROUP BY 1)
SELECT label, coalesce(b.n, 0) AS count_before, coalesce(a.n, 0) AS count_after, coalesce(b.n / (SELECT sum(n) FROM b), 0) AS share_before, coalesce(a.n / (SELECT sum(n) FROM a), 0) AS share_after,
  coalesce(a.n / (SELECT sum(n) FROM a), 0) - coalesce(b.n / (SELECT sum(n) FROM b), 0) AS share_delta FROM b FULL JOIN a USING (label)
""")
def version_compare_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return versions.class_balance(labels, labels.where("toxic = 0"), "quality")


@query("""
SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0) AS rows_after, 0::BIGINT AS ids_added,
  (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey % 4 = 0) AS ids_removed, (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey % 4 <> 0) AS ids_kept
""")
def version_compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return versions.row_counts(orders, orders.where("o_orderkey % 4 <> 0"), "o_orderkey")


@query(f"""WITH {BALANCES} SELECT 'c_acctbal' AS "column", count(*) FILTER (c_acctbal IS NULL) AS changed, count(*) FILTER (c_acctbal IS NULL) AS filled FROM balances""")
def version_compare_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = balances(spark, sf_dir)
    return versions.changed_cells(before, actions.impute(before, "c_acctbal", "median"), "c_custkey", ["c_acctbal"])


@query("""
SELECT n_nationkey, 'obj_' || substr(sha256('v1' || chr(10) || 'ds_1' || chr(10) || n_nationkey || chr(10) || 'sha256:' || sha256(n_name)), 1, 24) AS object_id, 'sha256:' || sha256(n_name) AS content_digest FROM nation
""")
def object_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("content_digest", digests.content_digest(F.col("n_name")))
    return n.select("n_nationkey", digests.object_id(F.lit("ds_1"), F.col("n_nationkey").cast("string"), F.col("content_digest")).alias("object_id"), "content_digest")


@query(f"""
WITH {RAW_EVENTS} SELECT event_id, event_key::BIGINT AS event_key, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, flag::BIGINT AS flag FROM raw_events WHERE event_id % 11 <> 0
""")
def export_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells without blocked rows, each column in the narrowest type that holds it."""
    from sluicebox.sources.files import typed, without_blocked

    rows = raw_events(spark, sf_dir).drop("ts", "props")
    blocked = rows.where("event_id % 11 = 0").select("event_id")
    return typed(without_blocked(rows, blocked, "event_id"))


@query("""
SELECT 'tabular' AS modality, o_orderstatus AS label, count(*) AS objects, count(DISTINCT o_orderkey) AS keys FROM orders GROUP BY o_orderstatus
""")
def asset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sluicebox.sources.files import manifest

    orders = table(spark, sf_dir, "orders")
    rows = manifest(orders, "ds_1", "tabular", "orders", "o_orderkey", orders.columns, "o_orderstatus", metadata=["o_custkey"])
    return rows.groupBy("modality", "label").agg(F.count("*").alias("objects"), F.count_distinct("row_key").alias("keys"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g')) AS slug, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR
  ELSE regexp_replace(printf('%.6f', p_retailprice), '\.?0+$', '') END AS price FROM part
""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", cells.slug(F.col("p_type")).alias("slug"), cells.format_number(F.col("p_retailprice")).alias("price"))
