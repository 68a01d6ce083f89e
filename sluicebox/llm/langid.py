"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams by language are summed over all training rows; the matrix of log probabilities has a fixed
number of buckets and is broadcast in blocks of languages. Rows are scored in numpy, sparse: only the buckets that a
text holds are gathered, block after block, with the best language and the sum of the posteriors so far. So any
number of languages takes the same way; the matrix grows by 256 KB for each.

Defined cases. A text that is null or has no letter is `und` with score 0, and teaches nothing. Rows without a
language teach nothing. With no training row at all, every text is `und`. Equal posteriors go to the language that
sorts first. Repeated rows count as often as they occur; a null doc_id belongs to the training part but is scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import U64, bound_batches, mix, slices, stage, text_bytes

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages in a block of the matrix.
BLOCK = 64
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of some texts, sorted by row, and whether each row has a letter.

    Texts are in lower case, everything but letters is one space; grams don't cross texts.
    """
    rows = len(texts)
    points = np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t.lower()) for t in texts), np.int64, rows)
    row = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    alpha = letters()[points]
    has = np.bincount(row[alpha], minlength=rows) > 0
    first = np.ones(len(points), bool)
    first[1:] = row[1:] != row[:-1]
    keep = alpha.copy()
    keep[1:] |= alpha[:-1] & ~first[1:]  # of a run of other characters, the first
    point = np.where(alpha, points, 32)[keep].astype(U64)
    row = row[keep]
    out = []
    h = np.zeros(len(point), U64)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            point = point[1:] if len(point) else point
            same = row[: len(point)] == row[len(row) - len(point) :]
        else:
            same = np.ones(len(point), bool)
        h = (h[: len(point)] + point + U64(1)) * U64(0x9E3779B97F4A7C15)
        if n in ORDERS:
            bucket = (mix(h ^ U64(n)) >> U64(64 - 15)).astype(np.int32)
            out.append((row[: len(point)][same], bucket[same]))
    rows_, buckets = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(rows_, kind="stable")
    return buckets[order], rows_[order], has


def _counts(languages: list[str]):
    """The n-grams of each language: rows (code, bucket, n), added up by block of languages while they are few."""
    place = {x: i for i, x in enumerate(languages)}
    few = len(languages) <= BLOCK

    def sums(code: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(code.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["code", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS) if few else (0, BUCKETS), np.int64)
        for batch in batches:
            column, lang = batch.column(0), np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            _, offsets = text_bytes(column)
            for a, b in slices(offsets, 2 << 20):
                bucket, row, _ = grams(column.slice(a, b - a).to_pylist())
                cell = lang[a:b][row] * BUCKETS + bucket
                if few:
                    total += np.bincount(cell, minlength=total.size).reshape(total.shape)
                else:  # sums by slice: a task holds no matrix
                    cell, n = np.unique(cell, return_counts=True)
                    yield sums(cell // BUCKETS, cell % BUCKETS, n)
        code, bucket = np.nonzero(total)
        if len(code):
            yield sums(code, bucket, total[code, bucket])

    return run


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], list]:
    """The languages in order, and broadcast blocks of the log probabilities of every bucket, log priors last.

    Learns from all rows: every task sums its own counts; the driver holds one block's sums at a time.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    prior = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    languages, number = sorted(prior), sum(prior.values())
    if not languages:
        return [], []
    bound_batches(labelled.sparkSession)
    sums = rows.mapInArrow(_counts(languages), "code int, bucket int, n long").groupBy("code", "bucket").agg(F.sum("n").alias("n"))
    if len(languages) > BLOCK:
        sums = stage(sums, "language-counts")
    blocks = []
    for first in range(0, len(languages), BLOCK):
        here = languages[first : first + BLOCK]
        counts = np.zeros((len(here), BUCKETS))
        found = sums.where(F.col("code").between(first, first + BLOCK - 1)).toPandas()
        counts[found["code"] - first, found["bucket"]] = found["n"]
        blocks.append(labelled.sparkSession.sparkContext.broadcast(log_probabilities(counts, np.array([prior[x] for x in here]), number)))
    return languages, blocks


def log_probabilities(counts: np.ndarray, prior: np.ndarray, number: int) -> np.ndarray:
    """The smoothed log probability of every bucket by language, and in the last column that of the language."""
    weights = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    return np.hstack([weights, np.log(prior / number).reshape(-1, 1)])


def score(texts: list[str], languages: list[str], blocks: list[np.ndarray]) -> tuple[list[str], list[float]]:
    """The most probable language of each text and its posterior probability."""
    bucket, row, has = grams(texts)
    n = len(texts)
    if not languages:
        return [UNKNOWN] * n, [0.0] * n
    best, top, total, first = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n), 0
    for model in blocks:
        logs = np.empty((n, len(model)))
        for j in range(len(model)):
            logs[:, j] = np.bincount(row, model[j, :-1][bucket], minlength=n) + model[j, -1]
        here = logs.argmax(axis=1)
        most = logs[np.arange(n), here]
        higher = most > top  # equal ones stay with the language that sorts first
        above = np.where(higher, most, top)
        total = total * np.exp(top - above) + np.exp(logs - above[:, None]).sum(axis=1)
        best, top, first = np.where(higher, first + here, best), above, first + len(model)
    return (
        [languages[b] if h else UNKNOWN for b, h in zip(best, has)],
        [float(1.0 / p) if h else 0.0 for p, h in zip(total, has)],
    )


def _score(languages: list[str], blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = [b.value for b in blocks]
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, offsets = text_bytes(column)
            lang, posterior = [], []
            for a, b in slices(offsets, 2 << 20):
                found = score([t or "" for t in column.slice(a, b - a).to_pylist()], languages, model)
                lang += found[0]
                posterior += found[1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(lang, pa.string()), pa.array(posterior, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, languages: list[str], blocks: list, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score in place of `text`; columns of those names are replaced."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "score")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema.fields)
    return docs.select(*kept, F.col(text)).mapInArrow(_score(languages, blocks), fields + "lang_pred string, score double")
