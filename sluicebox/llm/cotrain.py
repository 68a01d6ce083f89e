"""A quality classifier by co-training of two views.

The first view sees the text only: hashed words and word pairs, and the shape of the text. The second sees the page's
metadata only: language, source and length. Both begin with the labelled documents. Over some rounds each view labels
the unlabelled documents that it is most sure of, by class, and the other view learns from them. At last both views are
calibrated on labelled documents that neither has learned from, and their log odds are added.

Only the labelled documents are a bounded sample, and the features are hashed to a bounded number. The unlabelled
documents are all that there are: their features are staged once, and every round passes over them. A first pass counts
them by certainty, which gives the limits of what is passed on; further passes add up gradients over all that was passed.
Which documents a view was given is found again from the weights and limits of the rounds before, so rows keep no state.
The driver sees sums alone. It fits a view to its labelled documents and to a quadratic bound of the loss of the others.

Defined cases. A null text is an empty one, a null language or source a value of its own, and a null length is 0.
Without a label of each class every score is the share of good labels (0.5 without any). Documents labelled twice
take the smaller label. Samples are chosen by a hash of the id, so they don't depend on the order of rows. An unlabelled
row that repeats counts as often as it does; of equally sure rows a hash of the id chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import LOWER, U64, bound_batches, distinct_in_rows, mix, sized, slices, stage, text_bytes, words_of

#: Buckets of the hashed words, and of the hashed metadata.
TEXT_BUCKETS, META_BUCKETS = 1 << 14, 1 << 10
SHAPES = 6
#: Indicators of a row's metadata.
METAS = 5
#: Certainties are counted in steps of the log odds.
STEPS = 64
#: Who passes documents on to whom.
GIVES = (("text", "meta"), ("meta", "text"))


@dataclass(frozen=True)
class Settings:
    """Bounds and steps of the training."""

    labelled: int = 3000
    #: So many labelled documents all unlabelled ones weigh at most, however many they are.
    pool: int = 3000
    #: Every which labelled document is kept for the calibration.
    calibrate: int = 4
    rounds: int = 5
    #: Documents that a view passes on in a round for each `pool` of them, and how sure it must be of them.
    passed: int = 200
    sure: float = 0.9
    #: Passes over the unlabelled documents for the gradients of a round.
    passes: int = 2
    #: Steps of the first fit; later rounds begin with the last weights and take a third.
    steps: int = 90
    ridge: float = 1e-3


class Rows:
    """Sparse rows: feature numbers and values, and the row of each."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int, features: int):
        self.row, self.feature, self.value, self.rows, self.features = row, feature, value, rows, features

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.feature], self.rows)

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.feature, self.value * residual[self.row], self.features)


def text_rows(raw: np.ndarray, offsets: np.ndarray) -> Rows:
    """The features of some rows, made slice by slice and kept in narrow types."""
    parts = [_text_rows(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    if not parts:
        return Rows(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), 0, TEXT_BUCKETS + SHAPES)
    first = np.cumsum([0] + [p.rows for p in parts])
    return Rows(
        np.concatenate([(p.row + f).astype(np.int32) for p, f in zip(parts, first)]), np.concatenate([p.feature.astype(np.int32) for p in parts]),
        np.concatenate([p.value.astype(np.float32) for p in parts]), int(first[-1]), TEXT_BUCKETS + SHAPES,
    )


def _text_rows(raw: np.ndarray, offsets: np.ndarray) -> Rows:
    return damped(*text_counts(raw, offsets))


def text_counts(raw: np.ndarray, offsets: np.ndarray):
    """Row, bucket and number of the words and neighbouring words of some rows, and the shapes of their texts."""
    rows = len(offsets) - 1
    hashes, counts = words_of(LOWER[raw], offsets)
    row = np.repeat(np.arange(rows), counts)
    same = row[1:] == row[:-1]
    pairs = mix(hashes[1:] * U64(0x9E3779B97F4A7C15) + hashes[:-1])[same]
    values = np.concatenate([hashes, pairs]) % U64(TEXT_BUCKETS)
    all_rows = np.concatenate([row, row[1:][same]])
    order = np.argsort(all_rows, kind="stable")
    number = np.bincount(all_rows, minlength=rows)
    r, f, n = distinct_in_rows(values[order], number)
    size = np.maximum(np.diff(offsets), 1)

    def share(bytes_: str) -> np.ndarray:
        hit = np.isin(raw, np.frombuffer(bytes_.encode(), np.uint8))
        return np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets]) / size

    r_distinct, _, _ = distinct_in_rows(hashes, counts)
    distinct = np.bincount(r_distinct, minlength=rows) / np.maximum(counts, 1)
    shapes = np.stack([
        np.log1p(counts) / 10, 4 * share("#*$%&|<>"), 4 * share("0123456789"), 10 * share("\n"), distinct, np.ones(rows),
    ])
    return r, f, n, shapes


def damped(r: np.ndarray, f: np.ndarray, n: np.ndarray, shapes: np.ndarray) -> Rows:
    """Features from counts, damped and of length one in each row, and from shapes."""
    rows = shapes.shape[1]
    v = np.log1p(n)
    norm = np.sqrt(np.bincount(r, v * v, rows))
    v = v / np.maximum(norm[r], 1e-9)
    return Rows(
        np.concatenate([r, np.tile(np.arange(rows), SHAPES)]),
        np.concatenate([f.astype(np.int64), np.repeat(TEXT_BUCKETS + np.arange(SHAPES), rows)]),
        np.concatenate([v, shapes.ravel()]), rows, TEXT_BUCKETS + SHAPES,
    )


def meta_rows(meta: pd.DataFrame) -> Rows:
    """Language, source, their pair, and the power of two of the length, as hashed indicators."""
    rows = len(meta)
    length = np.floor(np.log2(meta["n_chars"].fillna(0).to_numpy(float).clip(1))).astype(int)
    texts = [
        [f"l={x}" for x in meta["lang"].fillna("\x00")], [f"s={x}" for x in meta["source"].fillna("\x00")],
        [f"n={x}" for x in length], [f"ln={a}/{b}" for a, b in zip(meta["lang"].fillna("\x00"), length)], ["bias"] * rows,
    ]
    column = pa.array([x for part in texts for x in part])
    raw, offsets = text_bytes(column)
    hashes, _ = words_of(raw, offsets, np.ones(256, bool)) if rows else (np.zeros(0, U64), None)
    return Rows(np.tile(np.arange(rows), len(texts)), (hashes % U64(META_BUCKETS)).astype(np.int64), np.ones(len(hashes)), rows, META_BUCKETS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Given:
    """What a view was given, added up by class: the number of documents, and gradient and bound of the curvature of
    their loss at the weights `at`; each document weighs `weight`."""

    at: np.ndarray
    number: np.ndarray
    gradient: np.ndarray
    bound: np.ndarray
    weight: float


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, settings: Settings, start: np.ndarray | None = None, given: Given | None = None) -> np.ndarray:
    """Logistic regression with balanced classes, by gradient steps of adaptive size (Adam), from `start` if given.

    Of the documents of `given` the loss is its quadratic bound, which is exact in value and slope at its weights.
    """
    weight = weight.astype(float).copy()
    slope, bend = np.zeros(rows.features), np.zeros(rows.features)
    for k in (0, 1):
        here = target == k
        total = weight[here].sum() + (given.weight * given.number[k] if given else 0.0)
        if total:
            weight[here] /= 2 * total
            if given:
                slope += given.gradient[k] * given.weight / (2 * total)
                bend += given.bound[k] * given.weight / (2 * total)
    w = np.zeros(rows.features) if start is None else start.copy()
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, (settings.steps if start is None else settings.steps // 3) + 1):
        g = rows.back(weight * (sigmoid(rows.dot(w)) - target)) + settings.ridge * w
        if given:
            g = g + slope + bend * (w - given.at)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def calibrate(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Platt's two numbers: the log odds are slope * margin + offset. Newton steps on smoothed targets."""
    good, bad = target.sum(), len(target) - target.sum()
    goal = np.where(target == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(50):
        p = sigmoid(x @ beta)
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - goal) + 1e-6 * beta)
        beta = beta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Model:
    """The weights of both views, their calibration, and the log odds of the classes."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float
    passed: list[tuple[int, int]]


@dataclass
class Turn:
    """A round: the views' weights, and by view and class the bin of the least certainty and the share taken of it."""

    weights: dict[str, np.ndarray]
    gates: dict[tuple[str, int], tuple[int, float]]


def certainty(margin: np.ndarray, k: int) -> np.ndarray:
    """The bin of the log odds of class `k`."""
    return np.floor(np.clip(margin if k else -margin, -35, 35) * STEPS).astype(np.int64)


def least_bin(settings: Settings) -> int:
    return int(np.ceil(np.log(settings.sure / (1 - settings.sure)) * STEPS))


def targets(views: dict[str, Rows], place: np.ndarray, turns: list[Turn]) -> dict[str, np.ndarray]:
    """What each view was given in `turns`: the class of each row, -1 for none. `place` is each row's hash, 0 to 1."""
    out = {v: np.full(len(place), -1, np.int8) for v in views}
    for turn in turns:
        for v, other in GIVES:
            margin, free = views[v].dot(turn.weights[v]), out[other] < 0
            for k in (1, 0):
                gate, share = turn.gates[v, k]
                at = certainty(margin, k)
                out[other][free & ((at > gate) | ((at == gate) & (place < share)))] = k
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, lang, source, n_chars, text) to (node, words, times, shapes, metas), numbers as bytes."""

    def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(values.tobytes())])

    for batch in batches:
        raw, offsets = text_bytes(batch.column(4))
        meta = pd.DataFrame({k: batch.column(1 + i).to_pandas() for i, k in enumerate(("lang", "source", "n_chars"))})
        metas = meta_rows(meta).feature.reshape(METAS, -1).T.astype(np.uint16)
        for a, b in slices(offsets):
            row, bucket, times, shapes = text_counts(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            number, each = np.bincount(row, minlength=b - a), np.ones(b - a, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), packed(bucket.astype(np.uint16), number), packed(np.minimum(times, 65535).astype(np.uint16), number),
                    packed(np.ascontiguousarray(shapes.T, np.float32), SHAPES * each), packed(np.ascontiguousarray(metas[a:b]), METAS * each),
                ],
                names=["node", "words", "times", "shapes", "metas"],
            )


def unpacked(batch: pa.RecordBatch) -> tuple[dict[str, Rows], np.ndarray]:
    """The views of staged rows, and each row's hash as a number from 0 to 1."""
    n = batch.num_rows

    def numbers(i: int, kind) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(i).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        whole = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        return whole.view(kind) if len(whole) else np.zeros(0, kind), np.diff(ends) // np.dtype(kind).itemsize

    bucket, counts = numbers(1, np.uint16)
    text = damped(np.repeat(np.arange(n), counts), bucket, numbers(2, np.uint16)[0], numbers(3, np.float32)[0].reshape(n, SHAPES).T.astype(float))
    metas = numbers(4, np.uint16)[0].astype(np.int64)
    meta = Rows(np.repeat(np.arange(n), METAS), metas, np.ones(len(metas)), n, META_BUCKETS)
    node = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
    return {"text": text, "meta": meta}, (mix(node) >> U64(11)).astype(float) * 2.0**-53


class Pool:
    """All unlabelled documents, as staged features; passes over them give sums."""

    def __init__(self, rows: DataFrame):
        bound_batches(rows.sparkSession)
        self.rows = stage(rows.mapInArrow(_features, "node long, words binary, times binary, shapes binary, metas binary"), "unlabelled")
        self.number = self.rows.count()

    def _sums(self, add: Callable, size: int) -> np.ndarray:
        """The sum over all rows of what `add` adds to an array for a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    add(total, *unpacked(batch))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "x"])

        found = self.rows.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros(size)
        out[found["at"].to_numpy(int)] = found["x"].to_numpy(float)
        return out

    def certainties(self, turns: list[Turn], weights: dict[str, np.ndarray], least: int) -> dict[tuple[str, int], np.ndarray]:
        """By view and class, how many documents that the other view wasn't given are in each bin from `least` on."""
        bins = 35 * STEPS + 1 - least
        keys = [(v, other, k) for v, other in GIVES for k in (1, 0)]

        def add(total: np.ndarray, views: dict[str, Rows], place: np.ndarray) -> None:
            given = targets(views, place, turns)
            for i, (v, other, k) in enumerate(keys):
                at = certainty(views[v].dot(weights[v]), k)[given[other] < 0]
                total[i * bins : (i + 1) * bins] += np.bincount(at[at >= least] - least, minlength=bins)

        sums = self._sums(add, len(keys) * bins).reshape(len(keys), bins)
        return {(v, k): sums[i] for i, (v, _, k) in enumerate(keys)}

    def given(self, turns: list[Turn], weights: dict[str, np.ndarray], weight: float) -> dict[str, Given]:
        """What the views were given, at their present weights."""
        sizes = {v: len(w) for v, w in weights.items()}
        width = {v: 2 * (1 + 2 * n) for v, n in sizes.items()}
        first = {"text": 0, "meta": width["text"]}

        def add(total: np.ndarray, views: dict[str, Rows], place: np.ndarray) -> None:
            given = targets(views, place, turns)
            for v, rows in views.items():
                away = sigmoid(rows.dot(weights[v]))
                # The curvature is at most a quarter, and its matrix at most its sums by row, as no feature is negative.
                length = 0.25 * np.bincount(rows.row, rows.value, rows.rows)
                part = total[first[v] : first[v] + width[v]].reshape(2, -1)
                for k in (0, 1):
                    here = given[v] == k
                    if here.any():
                        part[k, 0] += here.sum()
                        part[k, 1 : 1 + sizes[v]] += rows.back(np.where(here, away - k, 0.0))
                        part[k, 1 + sizes[v] :] += rows.back(np.where(here, length, 0.0))

        sums = self._sums(add, sum(width.values()))
        parts = {v: sums[first[v] : first[v] + width[v]].reshape(2, -1) for v in weights}
        return {v: Given(weights[v], p[:, 0], p[:, 1 : 1 + sizes[v]], p[:, 1 + sizes[v] :], weight) for v, p in parts.items()}


def gate_of(numbers: np.ndarray, most: float, least: int) -> tuple[int, float, int]:
    """The bin from which the `most` surest documents are taken, the share of that bin, and how many they are."""
    above = np.cumsum(numbers[::-1])[::-1]
    if above[0] <= most:
        return least, 1.0, int(above[0])
    at = int(np.flatnonzero(above > most)[-1])
    return least + at, float((most - (above[at] - numbers[at])) / numbers[at]), int(most)


def co_train(text: Rows, meta: Rows, label: np.ndarray, fresh: np.ndarray, unlabelled: Callable[[], Pool], settings: Settings = Settings()) -> Model:
    """Both views from labelled rows (0 or 1), of which `fresh` ones calibrate, and from all unlabelled ones."""
    known = ~fresh
    good, total = int((label == 1).sum()), len(label)
    prior = float(np.log((good + 1) / (total - good + 1)))
    views = {"text": text, "meta": meta}
    if not all(((label == k) & known).any() and ((label == k) & fresh).any() for k in (0, 1)):
        share = 0.0 if not total else prior
        return Model(np.zeros(text.features), np.zeros(meta.features), (0.0, share), (0.0, share), share, [])
    base, pool = label[known].mean(), unlabelled()
    scale, least = max(1.0, pool.number / settings.pool), least_bin(settings)
    weights = {v: fit(views[v], label, known, settings) for v in views}
    turns: list[Turn] = []
    passed = []
    for _ in range(settings.rounds if pool.number else 0):
        numbers = pool.certainties(turns, weights, least)
        most = {k: max(1, round(settings.passed * scale * (base if k else 1 - base))) for k in (0, 1)}
        gates = {key: gate_of(numbers[key], most[key[1]], least) for key in numbers}
        passed.append(tuple(sum(gates[v, k][2] for k in (0, 1)) for v, _ in GIVES))
        if not any(passed[-1]):
            break
        turns.append(Turn(weights, {key: gate[:2] for key, gate in gates.items()}))
        for _ in range(settings.passes):
            given = pool.given(turns, weights, 0.5 / scale)
            weights = {v: fit(views[v], label, known, settings, weights[v], given[v]) for v in views}
    scales = {v: calibrate(views[v].dot(weights[v])[fresh], label[fresh]) for v in views}
    return Model(weights["text"], weights["meta"], scales["text"], scales["meta"], prior, passed)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> Model:
    """A model of `label` (0 or 1) from a bounded sample of the labelled `docs` and all unlabelled ones."""
    ids = docs.select("doc_id", "lang", "source", "n_chars", "text")
    by_id = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(17))
    labelled = stage(docs.where("doc_id is not null").select("doc_id").distinct().join(by_id, "doc_id"), "labelled")
    chosen = F.broadcast(labelled.orderBy(order, "doc_id").limit(settings.labelled))
    found = ids.join(chosen, "doc_id").groupBy("doc_id").agg(
        F.first("label").alias("label"), F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")
    )
    rows = found.select("doc_id", "label", "row.text", "row.lang", "row.source", "row.n_chars").toPandas().sort_values("doc_id")

    def unlabelled() -> Pool:
        rest = ids.join(sized(labelled.select("doc_id")), "doc_id", "left_anti")
        return Pool(rest.select(F.xxhash64("doc_id", F.lit(17)).alias("node"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "text"))

    raw, offsets = text_bytes(pa.array(rows["text"].where(rows["text"].notna(), ""), pa.large_string()))
    y = rows["label"].to_numpy(int)
    fresh = np.arange(len(y)) % settings.calibrate == 0
    return co_train(text_rows(raw, offsets), meta_rows(rows), y, fresh, unlabelled, settings)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            text = text_rows(*text_bytes(batch.column(n - 1))).dot(model.text)
            names = batch.schema.names
            meta = pd.DataFrame({k: batch.column(n - 4 + i).to_pandas() for i, k in enumerate(("lang", "source", "n_chars"))})
            odds_text = model.text_scale[0] * text + model.text_scale[1]
            odds_meta = model.meta_scale[0] * meta_rows(meta).dot(model.meta) + model.meta_scale[1]
            # Both views' log odds hold the prior once; given the class they are taken as independent.
            both = sigmoid(odds_text + odds_meta - model.prior)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n - 4)), *(pa.array(x) for x in (sigmoid(odds_text), sigmoid(odds_meta), both, both >= 0.5))],
                names=[*names[: n - 4], "text_score", "meta_score", "quality_score", "good"],
            )

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` without its text, with text_score, meta_score, quality_score (0 to 1) and good (0.5 or more)."""
    bound_batches(docs.sparkSession)
    results = ("text_score", "meta_score", "quality_score", "good")
    kept = [c for c in docs.columns if c not in (text, *results)]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema.fields)
    rows = docs.select(
        *kept, F.col("lang").alias("_view_lang"), F.col("source").alias("_view_source"), F.col("n_chars").cast("long").alias("_view_n_chars"), F.col(text).alias("_view_text")
    )
    return rows.mapInArrow(_score(model), fields + "text_score double, meta_score double, quality_score double, good boolean")
