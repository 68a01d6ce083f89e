"""Quality rules from cross-document line frequency, in DataFrame functions only.

A line that many documents of one host repeat is boilerplate: menus, notices, license lines. Lines are
normalised and hashed, the distinct documents that hold each are counted by host, lines above the host's limit are
removed, and a document that keeps too little is rejected. Documents of one host with the same text are one
document, so that exact copies do not make their own text boilerplate.

The limit follows the host: a tenth of its documents, but five at least, from 200 documents on 20 of them, and a
thousandth of them where that is more. So a small host's menu is found, and in a host of any size a line must be in
a fixed share of the documents.

Defined cases. Null text has no words and fails the base rules. A null host is a host of its own. Every row is a
document, also where doc_id is null or repeats; equal rows get equal verdicts. An empty table gives an empty
result. Further columns pass through `clean`, whatever their names; `verdicts` replaces columns of its results' names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import fresh, sized, stage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


@dataclass(frozen=True)
class Limits:
    """Limits of the rules."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: A line is removed if it is in more distinct documents of a host than one in `one_in` of them, or than
    #: `max_documents` where that is less; but not below `min_documents`, nor below one in `one_in_large`.
    min_documents: int = 5
    one_in: int = 10
    max_documents: int = 20
    one_in_large: int = 1000
    #: A document is depleted if its remaining words are below `min_words` and below this share of all.
    min_share: float = 0.5


def words(text: Column) -> Column:
    """The words of a text: maximal runs without ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def normal_line(line: Column) -> Column:
    """A line in lower case with its white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once: a lambda's argument is bound, where a column would be expanded."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int) -> Column:
    """Words that lie in a `window`-word run found twice or more; overlapping runs count a word once.

    Runs are compared by a 64-bit hash of their words' hashes. Only a text with an equal pair pays for the sort.
    """

    def covered(runs: Column) -> Column:
        placed = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, repeats)

    def repeats(placed: Column) -> Column:
        # Sorted by hash and place: a run is repeated if the one before or after it has its hash.
        after = F.zip_with(placed, F.slice(placed, 2, F.size(placed)), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
        return let(after, lambda after: count(F.zip_with(
            placed,
            F.zip_with(after, F.concat(F.array(F.lit(False)), after), lambda x, y: F.coalesce(x, F.lit(False)) | y),
            lambda run, again: F.when(again, run["i"]),
        )))

    def count(places: Column) -> Column:
        return F.aggregate(
            F.array_sort(F.array_compact(places)),
            F.struct(F.lit(0).alias("n"), F.lit(-1_000_000).alias("at")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a["n"],
        )

    def runs(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window))
        )

    found = let(
        let(F.transform(words, lambda w: F.xxhash64(w)), runs),
        lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), 0).otherwise(covered(r)),
    )
    return F.when(F.size(words) <= window, 0).otherwise(found).cast("long")


def base_rules(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    raw = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w, lines = fresh(docs.columns, "_words", "_lines")
    return (
        docs.withColumn(w, words(F.col(text)))
        .withColumn(lines, raw)
        .withColumn("n_words", F.size(w).cast("long"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("long"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .withColumn("n_repeat_words", repeat_words(F.col(w), limits.window))
        .withColumn(
            "base_failed",
            (F.col("n_words") < limits.min_words)
            | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")),
        )
        .drop(w, lines)
    )


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: x != "")


def row_key(host: str, text: str) -> Column:
    """96 bits of a row's host and text: all that a verdict depends on."""
    both = (F.coalesce(F.col(host), F.lit("\x00")), F.coalesce(F.col(text), F.lit("\x00")))
    return F.struct(F.xxhash64(*both).alias("a"), F.hash(*both, F.lit("\x01")).alias("b"))


def document_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, key, line): one row for each different line of each document; `line` is a hash, `key` that of the row."""
    hashes = F.array_distinct(F.transform(normal_lines(F.col(text)), lambda x: F.xxhash64(x)))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), row_key(host, text).alias("key"), hashes.alias("lines"))
    return rows.select("host", "key", F.explode("lines").alias("line"))


def frequent_lines(lines: DataFrame, limits: Limits) -> DataFrame:
    """(host, line, documents) of the lines that are in more distinct documents of their host than its limit.

    Every step combines before it shuffles, so neither a large host nor a very common line fills one task.
    """
    counted = (
        lines.groupBy("host", "line", "key").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("*").alias("documents"))
        .where(F.col("documents") > limits.min_documents)
    )
    hosts = lines.groupBy("host", "key").agg(F.lit(1).alias("one")).groupBy(F.col("host").alias("h")).agg(F.count("*").alias("n"))
    above = (limits.one_in * F.col("documents") > F.least(F.col("n"), F.lit(limits.one_in * limits.max_documents))) & (
        limits.one_in_large * F.col("documents") > F.col("n")
    )
    return counted.join(sized(stage(hosts, "hosts")), F.col("host").eqNullSafe(F.col("h"))).where(above).select("host", "line", "documents")


def removals(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """(key, gone) of every document text with a line above the limit: the hashes of its removed lines.

    Rows of equal host and text share a key; what a task holds of a key is combined before the shuffle.
    """
    lines = stage(document_lines(docs, text, host), "lines")  # hashes, read again; texts are split and normalised once
    frequent = stage(frequent_lines(lines, limits), "frequent-lines")
    hit = lines.join(
        sized(frequent).select(F.col("host").alias("h"), F.col("line").alias("l")),
        F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")),
    )
    return stage(hit.groupBy("key").agg(F.collect_set("line").alias("gone")), "removals")


def verdicts(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source", gone: str | None = None) -> DataFrame:
    """`docs` with the columns of `base_rules`, n_left (words outside removed lines), n_lines_removed and kept.

    With `gone` also a column of that name, the hashes of the removed lines.
    """
    key, gone_key, hashes, lost = fresh(docs.columns, "_key", "_gone_key", gone or "_gone", "_lost")
    keyed = docs.withColumn(key, row_key(host, text))
    joined = keyed.join(sized(removals(docs, limits, text, host)).toDF(gone_key, hashes), F.col(key) == F.col(gone_key), "left")
    lines = normal_lines(F.coalesce(F.col(text), F.lit("")))
    taken = F.filter(lines, lambda x: F.array_contains(hashes, F.xxhash64(x)))
    words_lost = F.when(
        F.col(hashes).isNotNull(),
        F.aggregate(taken, F.lit(0), lambda a, x: a + F.size(F.split(x, " "))),
    ).otherwise(0)
    out = base_rules(joined.withColumn(lost, words_lost), limits, text)
    return (
        out.withColumn("n_left", F.col("n_words") - F.col(lost))
        .withColumn("n_lines_removed", F.when(F.col(hashes).isNotNull(), F.size(taken)).otherwise(0).cast("long"))
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & ~((F.col("n_left") < limits.min_words) & (F.col("n_left") < limits.min_share * F.col("n_words"))),
        )
        .drop(key, gone_key, lost, *(() if gone else (hashes,)))
    )


def clean(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """The kept rows of `docs`, the lines above the limit removed from their text."""
    columns = docs.columns
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "n_lines_removed", "kept")
    clash = [c for c in columns if c.lower() in own]
    aside = dict(zip(clash, fresh([*columns, *own], *(f"_own_{c}" for c in clash))))
    (gone,) = fresh([*columns, *own, *aside.values()], "_gone")
    verdict = verdicts(docs.withColumnsRenamed(aside), limits, aside.get(text, text), aside.get(host, host), gone).where("kept")
    body = aside.get(text, text)
    left = F.filter(
        F.split(F.col(body), "\n"),
        lambda x: ~F.array_contains(gone, F.xxhash64(normal_line(x))),
    )
    cleaned = F.when(F.col("n_lines_removed") > 0, F.array_join(left, "\n")).otherwise(F.col(body))
    return verdict.withColumn(body, cleaned).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in columns])
